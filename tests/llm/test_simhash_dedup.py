"""Near-duplicate groups against brute force."""

import random

import numpy as np
import xxhash

from voltweave.llm import simhash_dedup as sd


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[k: k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, ids, radius=3):
    group = {k: k for k in range(len(fps))}
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = {k: new if g == old else g for k, g in group.items()}
    return [min((ids[k] for k in group if group[k] == group[i] and ids[k] is not None), default=None) for i in range(len(fps))]


def sample_texts(odd):
    r = random.Random(2)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) + str(r.randint(0, 60)) for _ in range(150)) for _ in range(25)]
    near = []
    for t in base[:12]:
        for _ in range(6):
            w = t.split()
            w[r.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    return odd[:7] + odd[9:] + base + near + base[:5] + ["İ ẞ Ünï", "A\x0bB\x1cC d e"]


def test_groups_equal_brute_force(docs_of, odd_texts):
    texts = sample_texts(odd_texts)
    got = sorted(sd.near_duplicates(docs_of(texts, extra=True).repartition(5)).collect(), key=lambda r: r.doc_id)
    fps = [plain_fingerprint(t) for t in texts]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in got] == brute(fps, list(range(len(texts))))


def test_one_of_each_group_stays(docs_of, odd_texts):
    texts = sample_texts(odd_texts)
    docs = docs_of(texts, extra=True)
    docs = docs.unionByName(docs.where("doc_id < 9"))  # repeated rows
    kept = sd.deduplicate(docs)
    assert kept.columns == docs.columns
    want = set(brute([plain_fingerprint(t) for t in texts], list(range(len(texts)))))
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == sorted(want) and all(r.text == texts[r.doc_id] for r in rows)


def test_rows_without_id_and_empty_tables(spark, docs_of):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "x y z"), (None, None)], "doc_id long, text string")
    got = {r.fingerprint: r.component_id for r in sd.near_duplicates(docs).collect()}
    assert got["0" * 16] is None and 7 in got.values()
    kept = {(r.doc_id, r.text) for r in sd.deduplicate(docs).collect()}
    assert kept == {(7, "a b c d"), (None, "x y z"), (None, None)}
    assert sd.near_duplicates(docs_of(["a"]).limit(0)).collect() == []
    assert sd.deduplicate(docs_of(["a"]).limit(0)).collect() == []


def test_every_link_of_a_dense_bucket_is_found(monkeypatch):
    rng = np.random.default_rng(4)
    center = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    fps = np.unique(np.array([center ^ np.uint64(sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 5), replace=False))) for _ in range(900)]))
    monkeypatch.setattr(sd, "BLOCK", 64)
    pairs = [p for t in sd.forest(fps, 3) for p in zip(*t)]
    assert all(bin(int(a) ^ int(b)).count("1") <= 64 for a, b in pairs)

    def groups(links):
        label = {int(f): int(f) for f in fps}
        while True:
            before = dict(label)
            for a, b in links:
                label[int(a)] = label[int(b)] = min(label[int(a)], label[int(b)])
            if before == label:
                return label

    want = groups([(a, b) for k, a in enumerate(fps) for b in fps[:k] if bin(int(a ^ b)).count("1") <= 3])
    assert groups(pairs) == want


def test_keys_hold_every_pair_within_the_radius():
    rng = random.Random(9)
    masks = sd.key_masks(3)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(x & m == 0 for m in masks)
        assert sd.within(np.array([x], np.uint64), 3)[0]
