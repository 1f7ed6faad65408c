"""Near words, forms and roots against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from voltweave.llm import fmindex, spelling


def near(a, b):
    """One inserted, deleted or replaced letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def vocabulary(r, n, letters="abcé", least=6):
    words = {"".join(r.choice(letters) for _ in range(r.randint(least, 9))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        k = r.randrange(len(w))
        words |= {w[:k] + w[k + 1:], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1:]}
    return sorted(w for w in words if len(w) >= least)


def test_ranks_count():
    r = np.random.default_rng(1)
    text = np.append(r.integers(1, 5, 500), 0)
    ranks = fmindex.Ranks(text, 5)
    order = sorted(range(len(text)), key=lambda k: [*text[k:], *text[:k]])
    assert fmindex.rotations(text).tolist() == order
    last = text[np.array(order) - 1]
    for c in range(5):
        for i in (0, 1, 63, 64, 65, 300, 501):
            assert ranks._count(ranks._bits, ranks._sums, np.array([c]), np.array([i]))[0] == (last[:i] == c).sum()
            assert ranks._count(ranks._less, ranks._less_sums, np.array([c]), np.array([i]))[0] == (last[:i] < c).sum()


def test_schemes_find_every_near_word_once():
    r = random.Random(2)
    for case in range(30):
        words = vocabulary(r, r.choice([1, 5, 60]), r.choice(["a", "ab", "abcé"]), least=2)
        index = fmindex.Index(words)
        asked = words + ["abxxba", "aaaaaaa", "zzzzzz"]
        for length in {len(w) for w in asked}:
            some = [w for w in asked if len(w) == length]
            half = length // 2
            for tail in (False, True):
                rows, ranks = index.near(some, half, tail)
                got = sorted((some[i], words[k]) for i, k in zip(rows, ranks))
                known = sorted((a, b) for a in some for b in words if near(a, b) and same_half(a, b, half, tail))
                assert got == known, (length, tail)


def same_half(a, b, half, tail):
    n = len(a) - half if tail else half
    a, b = (a[::-1], b[::-1]) if tail else (a, b)
    return a[:n] == b[:n]


def expected(words):
    out = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = (form, n, len(close), words[form] if form else None)
    rows = {}
    for w, (form, n, size, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, size, form_n)
    return rows


def test_near_words_over_many_blocks(spark):
    r = random.Random(5)
    words = {w: r.choice([5, 5, 30, 200, 2000]) for w in vocabulary(r, 150)}
    words |= {"abcabc" + x: 7 for x in vocabulary(r, 40)}  # a frequent beginning
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    known = expected(words)
    for block in (7, 10_000):
        got = {x.word: (x.n_near, x.near_n) for x in spelling.near_words(df, block).collect()}
        assert got == {w: (v[3], max(words[x] for x in words if near(w, x))) for w, v in known.items() if v[3]}


def texts():
    r = random.Random(9)
    base = ["letters", "éclairs", "Wörterbuch", "straßen", "ÀÉÎÕÜÿ", "abcdef", "abcdeg", "abcdefg"]
    out = []
    for _ in range(300):
        out.append(" ".join(r.choice(["", "x-", "'"]) + r.choice(base) + r.choice(["", "s", ",", "×", "1", "Ÿ"]) for _ in range(60)))
    return out


def brute(texts, every=199):
    found = Counter()
    for k, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{k}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += 1
    return expected({w: n for w, n in found.items() if len(w) >= 6 and n >= 5})


def test_whole_operator(docs_of, odd_texts):
    every = odd_texts + texts()
    got = spelling.variants(docs_of(every, extra=True).repartition(3), block=5).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(every)
    assert len(got) == len({r.word for r in got}) and any(r.form for r in got)


def test_chains_of_forms(spark):
    rows = [(f"w{k}", f"w{k + 1}") for k in range(27)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {f"w{k}": "w27" for k in range(27)}


def test_nulls_and_empty_table(docs_of, spark):
    assert spelling.variants(docs_of(["a"]).limit(0)).collect() == []
    assert spelling.variants(docs_of([None, "", "short w"])).collect() == []
    docs = spark.createDataFrame([(None, "Letters letters")] * 3 + [(1, "x" * 3000 + " ")] * 5, "doc_id long, text string")
    assert {(r.word, r.n) for r in spelling.variants(docs).collect()} == {("letters", 6), ("x" * 3000, 5)}
