"""Runs against their definition, word by word."""

import hashlib
import random
import zlib

import numpy as np

from voltweave.llm import runs


def plain_runs(words, least=12):
    """Every stretch with its smallest period: maximal stretches of each period, unless a smaller one has them."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(
                    all(words[k] == words[k + s] for k in range(i, i + length - s)) for s in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out)


def test_runs_equal_their_definition():
    r = random.Random(3)
    for case in range(1500):
        words = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randint(0, 40))]
        if case % 3 == 0:
            block = words[: r.randint(1, 9)]
            words = words[:5] + block * r.randint(1, 6) + words[-4:]
        assert runs.runs_of(words, 2) == plain_runs(words, 2), words
        assert runs.runs_of(words) == plain_runs(words), words


def test_access_recolours_whole_paths():
    """Last ends of all states, against walking every path."""
    r = random.Random(4)
    for _ in range(60):
        machine = runs.Automaton([r.randrange(2) for _ in range(60)])
        tree, colour = runs.LastEnds(machine.link), [-1] * len(machine.link)
        for end, state in enumerate(machine.ends):
            path, x = [], state
            while x >= 0:
                path.append(x)
                x = machine.link[x]
            expected = [(x, colour[x]) for k, x in enumerate(path) if not k or colour[x] != colour[path[k - 1]]]
            got = tree.access(state, end)
            # Neighbouring segments of one colour, as at the start, count as one.
            assert [s for k, s in enumerate(got) if not k or s[1] != got[k - 1][1]] == expected
            for x in path:
                colour[x] = end


def plain(text):
    words = (text or "").encode().split()
    found = plain_runs(words)
    dropped = {k for s, n, p in found for k in range(s + p, s + n)}
    return found, b" ".join(w for k, w in enumerate(words) if k not in dropped)


def texts():
    r = random.Random(8)
    out = []
    for k in range(250):
        words = [f"w{r.randrange(r.choice([2, 5, 400]))}" for _ in range(r.randint(0, 90))]
        if k % 2:
            cut = r.randrange(len(words) + 1)
            words = words[:cut] + words[: r.randint(1, 12)] * r.randint(1, 5) + words[cut:]
        out.append(r.choice([" ", "\n", " \t"]).join(words))
    return out + ["a " * 500, "x y " * 40 + "a\x85b " * 30, "é\xa0ß " * 20]


def rows(docs):
    return {r.doc_id: r for r in runs.digests(runs.find(docs)).collect()}


def test_whole_texts(docs_of, odd_texts):
    every = odd_texts + texts()
    got = rows(docs_of(every, extra=True).repartition(3))
    assert len(got) == len(every)
    for k, t in enumerate(every):
        if t and len(t) > 20_000:
            continue
        found, kept = plain(t)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        r = got[k]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best), t
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()


def test_planted_texts(docs_of):
    every = texts() + [None, "", " ", "one"]
    got = {r.doc_id: r.text for r in runs.planted(docs_of(every * 4)).collect()}
    changed = 0
    for k, t in enumerate(every * 4):
        words, h = (t or "").encode().split(), zlib.crc32(str(k).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert (got[k] or "").encode().split() == words, k
    assert changed > 50


def test_long_periodic_text_and_stretches(docs_of):
    long = " ".join(f"w{k % 30_000}" for k in range(100_000))
    r = rows(docs_of([long]))[0]
    assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 100_000, 30_000)
    words = np.array([*range(50), *range(10, 20), *range(100, 130)] * 1, np.uint64)
    # The ten words stand again, but in no common stretch.
    assert len(runs.stretches(words, np.zeros(len(words), np.int64))) == 0


def test_nulls_ties_and_empty_table(docs_of, spark):
    assert runs.find(docs_of(["a"]).limit(0)).collect() == []
    two = "a b " * 6 + "c d " * 6
    docs = spark.createDataFrame([(None, two), (None, two), (1, None)], "doc_id long, text string")
    got = runs.digests(runs.find(runs.planted(docs))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_runs, r.start, r.length, r.period) for r in got] == [
        (None, 2, 0, 12, 2), (None, 2, 0, 12, 2), (1, 0, None, None, None)]
