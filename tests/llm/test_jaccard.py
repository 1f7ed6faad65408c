"""Near copies of the pipeline against all pairs."""

import random

import numpy as np

import corpus_pipeline as cp
from voltweave.llm import jaccard as jc


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k: k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    sets, group = [plain_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return sorted(set(group))


def near_texts():
    r = random.Random(6)
    base = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 90)) for _ in range(r.randint(20, 300))) for _ in range(40)]
    near = []
    for t in base:
        for edits in (1, 2, 4, 7):
            w = t.split()
            for _ in range(edits):
                w[r.randrange(len(w))] = f"changed{r.randint(0, 999)}"
            near.append(" ".join(w))
    line = " this one line stands in very many texts and makes them no copies"
    return base + near + [b + line for b in base[:20]] + [f"own{k} words{k}" + line for k in range(60)] + ["a b", "A  B", "a c", "a b c d e", None, "", " "]


def test_copies_equal_all_pairs(spark, docs_of, odd_texts, monkeypatch):
    monkeypatch.setattr(jc, "PAIRS", 16)
    monkeypatch.setattr(jc, "HUB_MEMBERS", 2)
    texts = near_texts() + odd_texts
    docs = docs_of(texts, extra=True).repartition(5)
    docs = docs.unionByName(docs.where("doc_id < 9"))
    kept = cp.near_duplicates(spark, docs, "/none")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(x.doc_id for x in rows) == brute(texts) and all(x.text == texts[x.doc_id] for x in rows)
    assert cp.near_duplicates(spark, docs.limit(0), "/none").collect() == []


def test_bitmaps_never_part_alike_sets():
    r = np.random.default_rng(3)
    parted = 0
    for _ in range(3000):
        n = int(r.integers(0, 700))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        keep = a[r.random(len(a)) < r.choice([0.3, 0.8, 0.9, 1.0])]
        b = np.unique(np.concatenate([keep, r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 5))).astype(np.uint64)]))
        may = jc.may_be_alike(jc.bitmap(a), jc.bitmap(b), len(a) + len(b))
        assert may == jc.may_be_alike(jc.bitmap(b), jc.bitmap(a), len(a) + len(b))
        assert may or not jc.alike(a, b)
        parted += not may
    assert parted > 500


def test_bitmaps_of_many_pairs():
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 1 << 63, int(m)).astype(np.uint64)) for m in r.integers(1, 900, 12)]
    sets = [s[r.random(len(s)) < p] for s in base for p in (1, 0.97, 0.9, 0.85)]
    bits, n = [jc.bitmap(s) for s in sets], np.array([len(s) for s in sets])
    i, j = np.nonzero((5 * n[:, None] >= 4 * n) & (4 * n[:, None] <= 5 * n))
    got = jc.near_bitmaps(bits, n, i, j)
    assert got.tolist() == [jc.may_be_alike(bits[a], bits[b], int(n[a] + n[b])) for a, b in zip(i, j)]
    assert 48 < got.sum() < len(i)
