"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns words into classes: insult, threat, target, negation, reported speech. Five small
transducers read the classes of a clause; each multiplies or adds to the weight of what it matches,
and their product is compiled into one transition table, which runs over the class codes of a text.
An insult or threat counts by its learned weight, more when it stands with a target in its clause, less
under a negation or in reported speech; so clauses are scored, not words alone.

Insult words and stems and their weights are learned from a bounded sample of labelled documents, and so
is the curve that turns the summed clause weights into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltweave.llm.tables import slices
from voltweave.runtime import cut

#: Function words of the grammar in English, German, French and Spanish.
TARGETS = ["you", "your", "you're", "youre", "he", "she", "they", "him", "her", "them", "his", "their",
           "du", "dich", "dir", "dein", "ihr", "euch", "tu", "te", "toi", "ton", "vous", "votre", "usted", "ustedes", "tú", "ti", "tus"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "don't", "doesn't", "without", "nicht", "kein", "keine", "nie",
             "ne", "pas", "jamais", "sans", "nunca", "jamás", "sin"]
REPORTS = ["said", "says", "say", "told", "called", "calls", "quoted", "quote", "wrote", "claimed", "allegedly",
           "sagte", "sagt", "nannte", "schrieb", "dit", "disait", "appelé", "écrit", "dijo", "dice", "llamó", "escribió"]
THREATS = ["kill", "hurt", "destroy", "beat", "burn", "murder", "töten", "umbringen", "tuer", "frapper", "matar", "golpear"]

#: Labelled documents of each label that the lexicon and the curve are fitted on at most.
SAMPLE_PER_LABEL = 2000
MIN_DOCS = 4
MIN_WEIGHT = 2.2
STEMS = (4, 5, 6, 7, 8)
#: Different words that a stem must have been seen in.
STEM_WORDS = 4
THRESHOLD = 0.7
THREAT_WEIGHT = 1.5
#: Factors of the grammar.
TARGETED, NEGATED, REPORTED = 1.3, 0.6, 0.7

NEUTRAL, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
MIXED = 6  # a chunk of several words, one of them of the grammar: it is taken apart
END = 8  # added to a code: the clause ends behind this word


def _flag(trigger: int, factor: float) -> dict:
    """A transducer that remembers a class in the clause and then multiplies the matches behind it."""
    return {"states": 2, "next": lambda s, c: 1 if c == trigger else s,
            "factor": lambda s, c: factor if s and c in (INSULT, THREAT) else 1.0}


def _harm(trigger: int) -> dict:
    """A transducer that passes the own weight of a class and remembers the match for a target behind it."""
    return {"states": 2, "next": lambda s, c: 1 if c == trigger else s, "factor": lambda s, c: 1.0}


GRAMMAR = {
    "insult": _harm(INSULT), "threat": _harm(THREAT), "target": _flag(TARGET, TARGETED),
    "negation": _flag(NEGATION, NEGATED), "reported": _flag(REPORT, REPORTED),
}


@dataclass
class Table:
    """The composed transducer: next state and factor by (state, class), and what a late target adds."""
    step: list[list[int]]
    factor: list[list[float]]
    late: list[list[float]]


def compose() -> Table:
    """The product of the transducers of ``GRAMMAR``."""
    parts = list(GRAMMAR.values())
    names = list(GRAMMAR)
    states = list(product(*[range(p["states"]) for p in parts]))
    number = {s: k for k, s in enumerate(states)}
    step, factor, late = [], [], []
    for s in states:
        seen = dict(zip(names, s))
        step.append([number[tuple(p["next"](x, c) for p, x in zip(parts, s))] for c in range(6)])
        factor.append([math.prod(p["factor"](x, c) for p, x in zip(parts, s)) for c in range(6)])
        # A first target behind an insult or threat raises what the clause has so far.
        behind = (seen["insult"] or seen["threat"]) and not seen["target"]
        late.append([TARGETED if c == TARGET and behind else 1.0 for c in range(6)])
    return Table(step, factor, late)


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    slope: float
    offset: float


_EDGES = ".,;:!?\"'()[]{}<>*_`«»„“”…-"
_CLAUSE_ENDS = ".;:!?…"
#: What ``learn`` splits words at besides white space.
_MARKS = r"!-/:-@\[-`{-~«»„“”…"
_END = re.compile(f"[{_MARKS}]*\\Z")
_EITHER = re.compile(f"\\A[{_MARKS}]+|[{_MARKS}]+\\Z")
#: A word with the marks behind it; in the first an apostrophe is part of the word.
_PART = re.compile(f"(?:[^{_MARKS}]|(?<=[^{_MARKS}])'(?=[^{_MARKS}]))+[{_MARKS}]*")
_APOSTROPHE = re.compile(f"[^{_MARKS}]+[{_MARKS}]*")


def _word(part: str) -> str:
    return _EITHER.sub("", part.lower())



class _Lexicon(dict):
    """Code and weight of every chunk between white space, and of the words in it, looked up once per worker."""

    def __init__(self, model: Model, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.classes = {**dict.fromkeys(THREATS, THREAT), **dict.fromkeys(TARGETS, TARGET),
                        **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(REPORTS, REPORT)}

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        parts = self.parts(chunk)
        codes = [self.one(p) for p in parts]
        code = MIXED if len(parts) > 1 and any(codes) else codes[0]
        if code != MIXED and (len(chunk) > 1 and chunk[-2] in _CLAUSE_ENDS or any(c in _CLAUSE_ENDS for c in _END.search(chunk).group())):
            code += END
        self[chunk] = code
        return code

    def one(self, part: str) -> int:
        return INSULT if self.weight(part) else self.classes.get(part.lower().strip(_EDGES), self.classes.get(_word(part), NEUTRAL))

    def parts(self, chunk: str) -> list[str]:
        """Words of a chunk as ``learn`` splits them, each with the marks behind it; one at least.

        A word of the grammar with an apostrophe ("isn't") stays one.
        """
        out = []
        for word in _PART.findall(chunk):
            whole = "'" not in word or word.lower().strip(_EDGES) in self.classes
            out += [word] if whole else _APOSTROPHE.findall(word)
        return out or [chunk]

    def weight(self, chunk: str) -> float:
        word = _word(chunk)
        best = self.model.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                best = max(best, self.model.stems.get(word[:n], 0.0))
        return best


_SEEN = re.compile(b"[^\\x00]")


def clause_weights(text: str, lexicon: _Lexicon, table: Table) -> list[float]:
    """Weight of every clause with a match, in order."""
    chunks = text.split()
    codes = bytes(map(lexicon.__getitem__, chunks))
    if MIXED in codes:
        chunks = [p for chunk, c in zip(chunks, codes) for p in (lexicon.parts(chunk) if c == MIXED else [chunk])]
        codes = bytes(map(lexicon.__getitem__, chunks))
    if not any(c in codes for c in (INSULT, THREAT, INSULT + END, THREAT + END)):
        return []
    out, state, total = [], 0, 0.0
    for m in _SEEN.finditer(codes):
        code = m.group()[0]
        c = code & 7
        if c == INSULT:
            total += table.factor[state][c] * lexicon.weight(chunks[m.start()])
        elif c == THREAT:
            total += table.factor[state][c] * THREAT_WEIGHT
        total *= table.late[state][c]
        state = table.step[state][c]
        if code & END:
            if total:
                out.append(total)
            state, total = 0, 0.0
    return [*out, total] if total else out


def learn(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, key: str = "doc_id") -> Model:
    """Fit on the texts of ``docs`` that ``labels`` (the key and ``label``, 1: toxic) names.

    The sample is drawn from the labels alone, about ``per_label`` of each, so only its texts are moved.
    Labels other than 0 and 1, NULL texts and NULL keys don't count; without texts of both labels nothing
    is toxic.
    """
    labels = labels.where(F.col("label").isin(0, 1) & F.col(key).isNotNull()).select(key, "label")
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model({}, {}, 1.0, -4.0)
    million = F.lit(1_000_000)
    share = F.when(F.col("label") == 1, int(min(1, per_label / counts[1]) * 1e6)).otherwise(int(min(1, per_label / counts[0]) * 1e6))
    drawn = labels.where(F.pmod(F.xxhash64(key, F.lit("tox")), million) < share).limit(4 * per_label)
    # A local table of bounded size: it goes to the documents, not they to it.
    drawn = docs.sparkSession.createDataFrame(drawn.toArrow())
    picked = cut(docs.join(drawn, key).where("text IS NOT NULL").select("text", "label"))
    counts = {r[0]: r[1] for r in picked.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model({}, {}, 1.0, -4.0)
    words = F.filter(F.split(F.lower("text"), r"[\s\p{Punct}«»„“”…]+"), lambda w: F.length(w) > 1)
    units = [F.transform(words, lambda w: F.concat(F.lit("0"), w)), *[_stems(words, n) for n in STEMS]]
    unit = picked.select("label", F.explode(F.array_distinct(F.concat(*units))).alias("unit"))
    seen = unit.groupBy("unit").agg(F.sum("label").alias("bad"), F.count("*").alias("all"))
    seen = seen.where("bad >= 2 AND all <= 2 * bad").selectExpr("int(left(unit, 1)) AS n", "substr(unit, 2) AS unit", "bad", "all")
    n1, n0 = counts[1], counts[0]
    words_, stems, spread = {}, {}, Counter()
    found = seen.collect()  # units of the bounded sample
    for r in found:
        if not r.n:
            spread.update(r.unit[:n] for n in STEMS if len(r.unit) >= n)
    for r in found:
        weight = math.log((r.bad + 0.5) / (n1 + 1)) - math.log((r["all"] - r.bad + 0.5) / (n0 + 1))
        # A weight must stand out of chance: its lower bound counts.
        weight -= 1.5 * math.sqrt(1 / (r.bad + 0.5) + 1 / (r["all"] - r.bad + 0.5))
        if r.bad >= MIN_DOCS and weight >= MIN_WEIGHT and (not r.n or spread[r.unit] >= STEM_WORDS):
            (stems if r.n else words_)[r.unit] = min(weight, 6.0)
    model = Model(words_, stems, 1.0, -4.0)
    # Counted by label and weight: a group of copies is one row of the bounded sample.
    scored = weigh(picked.select("label", "text"), model, ["label"]).groupBy("label", "weight").count().toPandas()
    model.slope, model.offset = _curve(
        np.log1p(scored["weight"].to_numpy(float)), scored["label"].to_numpy(float), scored["count"].to_numpy(float))
    return model


def _stems(words: Column, n: int) -> Column:
    long_enough = F.filter(words, lambda w: F.length(w) >= n)
    return F.transform(long_enough, lambda w: F.concat(F.lit(str(n)), F.substring(w, 1, n)))


def _curve(x: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """Logistic fit of two parameters by Newton steps, with a weak pull to (1, -2)."""
    if not len(x):
        return 1.0, -4.0
    p = np.array([1.0, -2.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-design @ p))
        slope = design.T @ ((y - q) * times) - 0.05 * (p - [1.0, -2.0])
        curve = (design * (q * (1 - q) * times)[:, None]).T @ design + 0.05 * np.eye(2)
        p = p + np.clip(np.linalg.solve(curve, slope), -1, 1)
    return float(max(p[0], 0.1)), float(p[1])


def weigh(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """The key columns, ``weight`` (sum over clauses) and ``clauses`` (how many matched) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # entries of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, table = _Lexicon(shared.value), compose()
        for batch in batches:
            for part in slices(batch):
                found = [clause_weights(t or "", lexicon, table) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in keys], pa.array([sum(f) for f in found], pa.float64()),
                     pa.array([len(f) for f in found], pa.int32())], [*keys, "weight", "clauses"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{schema}, weight double, clauses int")


def score(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """The key columns, ``score`` (0 to 1), ``predicted`` (score at least ``THRESHOLD``), ``clauses``.

    NULL and empty texts have no match and so the lowest score; texts are read whole; repeated rows stay;
    an empty table gives an empty result.
    """
    logit = F.lit(model.slope) * F.log1p("weight") + F.lit(model.offset)
    scored = weigh(docs, model, keys).withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select(*keys, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "clauses")
