"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns mark what they match. Around every token with a digit or an at sign a window of tokens
is cut out, and the random field scores each run of up to ``MAX_TOKENS`` tokens as a whole (shape,
digits, separators, checksum, the token before it) for each kind; dynamic programming over bounded
runs chooses boundaries and kinds together, over the whole of a row of windows that touch. Its spans are
added where they overlap no base span: numbers in local forms, credentials. Fixed patterns add what has
neither digit nor at sign: written-out addresses and values of named credentials.

The field is trained where the job starts: on windows of a bounded sample of documents, marked by the
base patterns, and on made windows of the kinds and of look-alikes (dates, versions, amounts).
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.llm.tables import slices

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents sampled for training (of so many characters at most), and windows made of each kind.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 20_000
MADE_WINDOWS = 60
MAX_TOKENS = 6
CONTEXT = 2
EPOCHS = 12
#: Tokens of a training window, and characters of a run of several tokens, at most.
WINDOW = 48
MAX_CHARS = 120
#: A span is added when its score exceeds that of plain text by so much.
MARGIN = 2.0


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


#: ``IP`` without looking at any run of digits more than four times: a match starts where one starts.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``EMAIL``, found from the at signs instead of from every word."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


#: Fixed patterns of what has neither digit nor at sign: written-out addresses, credentials given by name;
#: and web tokens.
_AT = re.compile(r"(?i)[(\[{]\s*at\s*[)\]}]\s*")
_DOT_PARTS = re.compile(r"(?i)[a-z0-9-]+(?:(?:\s*[(\[{]\s*dot\s*[)\]}]\s*|\.)[a-z0-9-]+)+")
_NAMED = re.compile(r"(?i)\b(?:(?:pass(?:word|wd|phrase)|pwd|api[_-]?key)\s*[=:]|(?:token|secret)\s*=)\s*[\"']?([^\s\"'\[\]<>]{4,})")
_BEARER = re.compile(r"\bBearer\s+([A-Za-z0-9._~+/=-]{16,})")
#: A part of a web token and, seen ahead, the two behind it; parts are runs, so none is read more than three times.
_WEB_PARTS = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)(?=\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
_WEB_HEAD = re.compile(r"\beyJ[A-Za-z0-9_-]")


def local_start(text: str, stop: int) -> int:
    """Start of the written-out local part that ends at ``stop``, ``stop`` if there is none: local characters,
    and before them a written-out dot with more, as far as they go."""
    start = stop
    while True:
        pos = start
        while pos and text[pos - 1] in _LOCAL_CHARS:
            pos -= 1
        if pos == start:
            return stop  # only at the first turn: behind a dot there is such a character
        start = pos
        while pos and text[pos - 1].isspace():
            pos -= 1
        before = _dot_before(text, pos)
        if before is None or not before or text[before - 1] not in _LOCAL_CHARS:
            return start
        start = before


def _dot_before(text: str, pos: int) -> int | None:
    """Where a written-out dot that ends at ``pos`` begins, with the blanks before it; None if there is none."""
    def blanks(p: int) -> int:
        while p and text[p - 1].isspace():
            p -= 1
        return p

    if not pos or text[pos - 1] not in ")]}":
        return None
    pos = blanks(pos - 1)
    if text[max(0, pos - 3): pos].lower() != "dot":
        return None
    pos = blanks(pos - 3)
    return blanks(pos - 1) if pos and text[pos - 1] in "([{" else None


def spelled(text: str) -> list[tuple[int, int, str]]:
    """Written-out addresses ("john (at) example (dot) com") and values of named credentials, apart and in order."""
    out = []
    for m in _AT.finditer(text):
        stop = m.start()
        while stop and text[stop - 1].isspace():
            stop -= 1
        start, domain = local_start(text, stop), _DOT_PARTS.match(text, m.end())
        if start < stop and domain:
            out.append((start, domain.end(), "email"))
    found = [m.span(1) for r in (_NAMED, _BEARER) for m in r.finditer(text)]
    if "eyJ" in text:
        for m in _WEB_PARTS.finditer(text):
            head = _WEB_HEAD.search(text, *m.span(1))
            if head:
                found.append((head.start(), m.end(3)))
    for s, e in found:
        while e > s and text[e - 1] in TRIM:
            e -= 1
        if e - s >= 4:
            out.append((s, e, "secret"))
    kept: list[tuple[int, int, str]] = []
    for x in sorted(out):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end, kind of every base match, by start and then kind."""
    found = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


TRIM = ".,;:!?\"'()<>[]{}"
_TOKEN = re.compile(r"\S+")
_ANCHOR = re.compile(r"[0-9@]+")
_SECRET_NAME = re.compile(r"(?i)(pass(word|wd)?|pwd|token|secret|api_?key|apikey|key|auth)\W*\Z")
_SECRET_ASSIGN = re.compile(r"(?i)(pass(word|wd)?|pwd|token|secret|api_?key|apikey|key|auth)\W*[=:]")
_PHONE_NAME = re.compile(r"(?i)(tel|phone|call|fax|mobile|cell|t[ée]l[ée]phone|telefon|tel[ée]fono)\W*\Z")
_DATE = re.compile(r"\d{1,4}([-/.])\d{1,2}\1\d{1,4}\Z")


@dataclass
class Window:
    """Tokens (start, end in the text) around an anchor and the runs that may be spans."""
    text: str
    tokens: list[tuple[int, int]]
    gold: dict[tuple[int, int], str] = field(default_factory=dict)


def windows(text: str) -> Iterator[Window]:
    """Training windows of a text, in order and apart; a long row of anchors goes on in the next window."""
    for w in whole_areas(text):
        for k in range(0, len(w.tokens), WINDOW):
            yield Window(text, w.tokens[k: k + WINDOW])


def whole_areas(text: str) -> Iterator[Window]:
    """Areas around the anchors of a text, in order and apart, each whole."""
    areas: list[list[int]] = []
    m = _ANCHOR.search(text)
    while m:
        stop = _right(text, m.end(), 0)
        floor = areas[-1][1] if areas else 0
        area = [_left(text, m.start(), CONTEXT, floor), _right(text, stop, CONTEXT)]
        if areas and area[0] <= areas[-1][1]:
            areas[-1][1] = max(areas[-1][1], area[1])
        else:
            areas.append(area)
        m = _ANCHOR.search(text, stop)
    for start, stop in areas:
        yield Window(text, [t.span() for t in _TOKEN.finditer(text, start, stop)])


def _left(text: str, pos: int, words: int, floor: int) -> int:
    """Start of the token ``words`` tokens before that at ``pos``, not before ``floor``."""
    for k in range(words + 1):
        if k:
            while pos > floor and text[pos - 1].isspace():
                pos -= 1
        while pos > floor and not text[pos - 1].isspace():
            pos -= 1
    return pos


def _right(text: str, pos: int, words: int) -> int:
    for k in range(words + 1):
        if k:
            while pos < len(text) and text[pos].isspace():
                pos += 1
        while pos < len(text) and not text[pos].isspace():
            pos += 1
    return pos


def runs(w: Window, first: int = 0, last: int | None = None) -> list[tuple[int, int, int, int]]:
    """First and last-plus-one token and trimmed place of every run that may be a span (with a digit or @).

    ``first`` and ``last`` bound the tokens at which runs start; they may end behind ``last``.
    """
    out = []
    for i in range(first, len(w.tokens) if last is None else min(last, len(w.tokens))):
        for j in range(i + 1, min(len(w.tokens), i + MAX_TOKENS) + 1):
            start, end = w.tokens[i][0], w.tokens[j - 1][1]
            if end - start > MAX_CHARS and j > i + 1:  # a single token may have any length
                break
            while start < end and w.text[start] in TRIM and w.text[start] != "(":
                start += 1
            while start < end and w.text[end - 1] in TRIM:
                end -= 1
            if _ANCHOR.search(w.text, start, end) and "\n" not in w.text[start:end]:
                out.append((i, j, start, end))
    return out


def features(text: str, start: int, end: int, n_tokens: int) -> np.ndarray:
    """Whole-span features of one run."""
    s = text[start:end]
    before = text[max(0, start - 24): start]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, letters = len(digits), sum(c.isalpha() for c in s)
    parts = s.split(".")
    local, _, domain = s.partition("@")
    compact = s.replace('"', "").replace("'", "")
    return np.array([
        1.0,
        "@" in s, bool(local) and "." in domain.strip("."), s.count("@") > 1, " " in s and "@" in s,
        n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 11, 12 <= n <= 13, 14 <= n <= 19, n > 19,
        14 <= n <= 19 and not letters and luhn(digits),
        len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts),
        s.startswith("+"), "(" in s and ")" in s, s.count("-") == 2, "/" in s, ":" in s,
        letters == 0, letters > 0 and n > 0, 0 < letters <= 4, letters > 12,
        letters == 0 and n == len(s), bool(_DATE.match(s)), len(parts) == 2 and letters == 0,
        len(s) < 4, len(s) >= 16, len(s) >= 20 and s.isalnum() and letters > 0 and n > 0,
        s.isalnum() and s.upper() == s and letters > 8 and n > 0,
        bool(_SECRET_NAME.search(before)), bool(_SECRET_ASSIGN.match(s)), bool(_PHONE_NAME.search(before)),
        n_tokens == 1, n_tokens == 2, n_tokens == 3, n_tokens > 3,
        9 <= n <= 11 and letters == 0 and (s.count("-") == 2 or "(" in s), bool(re.match(r"\w+[=:]", compact)),
        bool(re.search(r"[$€£%]", s + text[end: end + 1] + before[-1:])), s.startswith("(") != ("(" in s),
    ], np.float64)


WIDTH = len(features("x1", 0, 2, 1))


def lattice(w: Window, weights: np.ndarray | None = None):
    """Runs of a window, their feature matrix and (with weights) their scores by kind."""
    found = runs(w)
    x = np.array([features(w.text, s, e, j - i) for i, j, s, e in found]).reshape(len(found), WIDTH)
    return found, x, None if weights is None else x @ weights


def train(examples: list[Window], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights (features x kinds) by stochastic gradient on the likelihood of whole segmentations (AdaGrad)."""
    weights = np.zeros((WIDTH, len(KINDS)))
    seen = np.full(weights.shape, 1e-6)
    prepared = []
    for w in examples:
        found, x, _ = lattice(w)
        gold = np.zeros((len(found), len(KINDS)))
        for r, (_, _, s, e) in enumerate(found):
            if (s, e) in w.gold:
                gold[r, KINDS.index(w.gold[(s, e)])] = 1
        if len(found):
            prepared.append((len(w.tokens), found, x, gold))
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(prepared)):
            n, found, x, gold = prepared[k]
            step = x.T @ (gold - marginals(n, found, x @ weights)) - decay * weights
            seen += step ** 2
            weights += rate * step / np.sqrt(seen)
    return weights


def marginals(n: int, found: list, scores: np.ndarray) -> np.ndarray:
    """Probability of every (run, kind) under the field: forward and backward sums over bounded runs."""
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    whole = np.logaddexp.reduce(scores, axis=1)
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for r, (i, j, _, _) in enumerate(found):
        ends[j].append(r)
        starts[i].append(r)
    for t in range(1, n + 1):  # a token outside all spans scores 0
        forward[t] = np.logaddexp.reduce([forward[t - 1], *[forward[found[r][0]] + whole[r] for r in ends[t]]])
    for t in range(n - 1, -1, -1):
        backward[t] = np.logaddexp.reduce([backward[t + 1], *[backward[found[r][1]] + whole[r] for r in starts[t]]])
    i, j = np.array([f[0] for f in found]), np.array([f[1] for f in found])
    return np.exp(forward[i][:, None] + scores + backward[j][:, None] - forward[n])


def decode(w: Window, weights: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, str]]:
    """Best segmentation of a window or a whole area: its spans with start, end and kind.

    Runs are scored by those that start in ``WINDOW`` tokens, and only those above the margin are kept:
    the others can't be in the best segmentation.
    """
    n = len(w.tokens)
    ends: dict[int, list[tuple[int, float, tuple[int, int, str]]]] = {}
    for k in range(0, n, WINDOW):
        found = runs(w, k, k + WINDOW)
        if not found:
            continue
        scores = np.array([features(w.text, s, e, j - i) for i, j, s, e in found]) @ weights
        kind, value = scores.argmax(axis=1), scores.max(axis=1) - margin
        for r in np.flatnonzero(value > 0):
            i, j, s, e = found[r]
            ends.setdefault(j, []).append((i, value[r], (s, e, KINDS[kind[r]])))
    if not ends:
        return []
    best, back = np.zeros(n + 1), {}
    for t in range(1, n + 1):
        best[t] = best[t - 1]
        for i, value, span in ends.get(t, ()):
            if best[i] + value > best[t]:
                best[t], back[t] = best[i] + value, (i, span)
    out, t = [], n
    while t:
        if t in back:
            t, span = back[t]
            out.append(span)
        else:
            t -= 1
    return out[::-1]


def made_windows(seed: int = 11, each: int = MADE_WINDOWS) -> list[Window]:
    """Windows of made spans in made words: what is personal in forms beside the base patterns, and
    look-alikes that are not."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    low = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    mixed = lambda n, a: "".join(r.choice(a) for _ in range(n))

    def card() -> str:
        body = r.choice("3456") + digits(14)
        last = next(d for d in "0123456789" if luhn(body + d))
        full = body + last
        return r.choice([full, " ".join(full[k: k + 4] for k in range(0, 16, 4)), "-".join(full[k: k + 4] for k in range(0, 16, 4))])

    def bad_card() -> str:
        body = r.choice("3456") + digits(14)
        return body + next(d for d in "0123456789" if not luhn(body + d))

    upper, lowhex = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
    spans = {
        "email": lambda: f"{low(r.randint(2, 8))}{r.choice(['', '.' + digits(2), '_' + low(3)])}@{low(5)}.{r.choice(['com', 'org', 'example.net'])}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice(["+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "+44 {} {} {}"]).format(digits(3), digits(3), digits(4)),
        "secret": lambda: r.choice([
            "AKIA" + mixed(12, upper) + digits(1) + mixed(3, upper), "password=" + mixed(10, lowhex) + digits(4) + mixed(4, lowhex),
            'token="' + mixed(38, lowhex) + digits(2), "api_key=" + mixed(24, lowhex) + digits(1), "secret: " + mixed(20, lowhex) + digits(3)]),
        "": lambda: r.choice([
            digits(r.randint(1, 9)), f"{r.randint(1, 12)}.{r.randint(0, 9)}", f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
            f"{r.randint(1, 23)}:{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", f"${digits(3)}.{digits(2)}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
            bad_card(), digits(20), f"{r.randint(256, 999)}.{digits(3)}.{digits(2)}.{digits(1)}", f"@{low(6)}", f"{digits(3)}-{digits(4)}", f"{low(4)}{digits(2)}", f"{digits(4)} {digits(3)} {digits(2)}",
            f"{r.randint(1, 99)}%", f"ISBN {digits(9)}", f"{digits(1)},{digits(3)},{digits(3)}", f"{low(9)}{digits(1)}", f"section {digits(1)}", f"#{digits(4)}"]),
    }
    out = []
    for kind, make in spans.items():
        for _ in range(each * (4 if not kind else 1)):
            s = make()
            lead = " ".join(low(r.randint(1, 9)).capitalize() if r.random() < 0.2 else low(r.randint(1, 9)) for _ in range(2))
            text = f"{lead}{r.choice([' ', ' ', ', '])}{s}{r.choice(['', '.', ',', ''])} {low(5)} {low(3)}"
            if kind == "secret" and s.startswith("token") and r.random() < 0.5:
                text = text.replace('token="', 'token = "')
            at = text.index(s if s in text else s.removeprefix('token="'))
            end = at + len(s if s in text else s.removeprefix('token="'))
            for w in windows(text):
                if kind:
                    w.gold[(at, end)] = kind
                out.append(w)
    # Tokens longer than MAX_CHARS: keys, and addresses of pages and rows of numbers, which are none.
    for k in range(each):
        long = [mixed(r.randint(90, 220), lowhex) + digits(3), mixed(r.randint(90, 220), upper.lower() + upper) + digits(3),
                "https://" + "/".join(low(6) for _ in range(20)) + digits(3), ",".join(digits(2) for _ in range(50)), digits(r.randint(90, 220)),
                "-" * 90 + digits(1) + "-" * 40][k % 6]
        text = f"{low(5)} {r.choice(['key', low(4)]) if k % 6 < 2 else low(4)} {long} {low(5)} {low(3)}"
        for w in windows(text):
            if k % 6 < 2:
                at = text.index(long)
                w.gold[(at, at + len(long))] = "secret"
            out.append(w)
    return out


def model(docs: DataFrame) -> np.ndarray:
    """The trained field: made windows and those of ``SAMPLE_DOCS`` documents with a digit or an at sign."""
    docs = docs.select(*[c for c in ("doc_id", "text") if c in docs.columns])
    rows = docs.where("text rlike '[0-9@]'").where(F.length("text") <= SAMPLE_CHARS)
    n = rows.count()
    # By a hash of the row, so that a group of copies counts by its size; twice the number is a guard.
    share = int(min(1.0, SAMPLE_DOCS / max(n, 1)) * 1e9)
    drawn = rows.where(F.pmod(F.xxhash64(*docs.columns), F.lit(1_000_000_000)) < share).select("text")
    texts = [r.text for r in drawn.limit(2 * SAMPLE_DOCS).collect()]
    examples = made_windows()
    for text in texts:
        marked = {(s, e): k for s, e, k in base_spans(text)}
        for w in windows(text):
            inside = {p: k for p, k in marked.items() if w.tokens[0][0] <= p[0] and p[1] <= w.tokens[-1][1]}
            if inside:  # windows without a base span may hold what the base doesn't know
                w.gold.update(inside)
                examples.append(w)
    return train(examples)


def spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """Base spans and all spans of a text, each by start and then kind."""
    base = base_spans(text)
    added = []
    taken = sorted((s, e) for s, e, _ in base)
    # Base spans by start, with the furthest end so far: one look tells whether a span overlaps one.
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    free = lambda s, e: not (k := bisect_left(starts, e)) or reach[k - 1] <= s
    for w in whole_areas(text):
        added += [x for x in decode(w, weights) if free(x[0], x[1])]
    taken = sorted([*taken, *[(s, e) for s, e, _ in added]])
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    added += [x for x in spelled(text) if free(x[0], x[1])]
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def find(docs: DataFrame, weights: np.ndarray, key: str = "doc_id") -> DataFrame:
    """``n_email, n_ip, n_card, n_phone`` (base matches), ``base`` and ``spans`` as kind:start:end lists, and
    ``n_added``, the number of spans beside the base.

    Places are code points, ends exclusive. NULL and empty texts have no spans; repeated rows stay;
    columns other than the key and text are left out; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # features x kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                both = [spans(t or "", shared.value) for t in part.column("text").to_pylist()]
                counts = [pa.array([sum(s[2] == k for s in b) for b, _ in both], pa.int64()) for k in BASE_KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), *counts, pa.array([listed(b) for b, _ in both], pa.string()),
                     pa.array([listed(a) for _, a in both], pa.string()), pa.array([len(a) - len(b) for b, a in both], pa.int64())],
                    [key, *[f"n_{k}" for k in BASE_KINDS], "base", "spans", "n_added"])

    counted = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, {counted}, base string, spans string, n_added long")


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans give one mark."""
    out, at = [], 0
    for s, e, kind in found:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with personal data masked in ``text`` (NULL stays NULL); all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [None if t is None else masked(t, spans(t, shared.value)[1]) for t in part.column("text").to_pylist()]
                yield part.set_column(at, part.schema.names[at], pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
