"""What the pipeline's near-duplicate stage hands on between its steps."""

import random

import numpy as np

import corpus_pipeline as cp
from test_jaccard import brute
from voltweave.llm import jaccard as jc
from voltweave.llm import simhash_dedup as sd


def copies(n, edits, words=150, seed=2):
    r = random.Random(seed)
    base = [f"word{r.randint(0, 999)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"own{k}x{r.randint(0, 99)}"
        out.append(" ".join(w))
    return out


def test_a_pair_leaves_one_of_its_keys(spark, docs_of, monkeypatch):
    """Copies that share nearly all keys: a row for each pair, not for each pair and key."""
    texts = copies(60, 2) + copies(30, 3, 400, 5)
    counted, whole = [], jc._by_key

    def by_key(filed, found, schema):
        out = whole(filed, found, schema)
        if found is jc._apart:
            counted.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(jc, "_by_key", by_key)
    monkeypatch.setattr(jc, "HUB_MEMBERS", 2)
    kept = cp.near_duplicates(spark, docs_of(texts), "/none").collect()
    assert sorted(x.doc_id for x in kept) == brute(texts)
    rows, pairs = counted[0]
    assert pairs > 0 and rows <= 2 * pairs


def test_texts_unlike_by_far_are_parted_by_their_bitmaps():
    r = np.random.default_rng(1)
    for n in (140, 380):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        kept = 0
        for _ in range(200):
            b = np.concatenate([a[r.permutation(n)[: int(0.82 * n)]], r.integers(0, 1 << 63, n - int(0.82 * n)).astype(np.uint64)])  # 0.7 alike
            kept += jc.may_be_alike(jc.bitmap(a), jc.bitmap(np.unique(b)), 2 * n)
        assert kept < 10


def test_operator_8_goes_first(spark, docs_of, monkeypatch):
    texts = copies(20, 1, 600, 7) + copies(20, 9, 300, 8) + ["", None, "a b"]
    asked, links, checked, linked = [], sd.links, [], jc._linked
    monkeypatch.setattr(sd, "links", lambda fps, *a: asked.append(fps.count()) or links(fps, *a))

    def spy(pairs, *a):
        out = linked(pairs, *a)
        checked.append(out.count())
        return out

    monkeypatch.setattr(jc, "_linked", spy)
    kept = cp.near_duplicates(spark, docs_of(texts), "/none").collect()
    assert sorted(x.doc_id for x in kept) == brute(texts)
    assert asked and asked[0] > 1 and checked[0] > 0


def test_a_key_of_many_near_copies_hands_on_forests(monkeypatch):
    """Pairs by members of a key, not by their square, that join what all near pairs join."""
    sets = sorted((jc.shingles(t) for t in copies(150, 1, 300, 3) + copies(50, 1, 310, 4)), key=len)
    m = len(sets)
    rows = {"key": np.full(m, 7), "set": np.arange(1, m + 1), "n": np.array([len(s) for s in sets]), "component": np.arange(1, m + 1),
            "bits": np.array([jc.bitmap(s) for s in sets], object), **{f"ahead{k}": np.zeros(m, np.int64) for k in range(jc.AHEAD)}}
    rows["component"][:4] = 1
    i, j = np.triu_indices(m, 1)
    near = jc.near_bitmaps(rows["bits"], rows["n"], i, j)
    edges = [(i[near], j[near])]
    for pairs in (100_000, 500):
        monkeypatch.setattr(jc, "PAIRS", pairs)
        found = [b.to_pydict() for b in jc._apart(rows, np.array([0, m]))]
        edges.append(tuple(np.array([x - 1 for b in found for x in b[end]]) for end in ("hub", "member")))
    groups = []
    for a, b in edges:
        label = rows["component"] - 1
        jc._joins(label, a, b)
        groups.append(label.tolist())
    assert groups[0] == groups[1] == groups[2] and 1 < len(set(groups[0])) < m
    assert len(edges[0][0]) > 10 * m
    assert all(len(set(zip(*e))) == len(e[0]) <= 4 * (m - 1) for e in edges[1:])
