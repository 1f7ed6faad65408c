"""Pfair schedule: windows, deviation, whole results."""

import pytest

from voltweave.llm import mixing as mx


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1}, {str(k): 1 + k % 7 for k in range(40)}, {"x": 99.0, "y": 0.001}])
def test_every_block_runs_inside_its_window(weights):
    share = mx.shares(weights, mx.GRAIN)
    assert sum(share.values()) == mx.GRAIN and min(share.values()) >= 1
    plan = mx.period(share)
    assert [p[2] for p in plan] == list(range(mx.GRAIN))
    done = dict.fromkeys(share, 0)
    for source, i, slot, release, deadline in plan:
        assert done[source] == i and release <= slot < deadline
        done[source] += 1
        assert all(abs(done[s] - share[s] * (slot + 1) / mx.GRAIN) < 1 for s in share)


def test_all_rows_once_and_in_order(docs_of):
    docs = docs_of([f"text {k}" for k in range(900)] + [None], extra=True, source=lambda k: None if k % 50 == 0 else "hot" if k % 3 else f"s{k % 5}")
    out = mx.mix(docs, block=8).collect()
    assert sorted(r.doc_id for r in out) == list(range(901)) and len({(r.slot, r.place) for r in out}) == 901
    sizes = {}
    for r in out:
        sizes.setdefault((r.source, r.block), set()).add((r.slot, r.place))
    for (source, block), places in sizes.items():
        assert len({s for s, _ in places}) == 1 and {p for _, p in places} == set(range(len(places)))
        assert len(places) == 8 or block == max(b for s, b in sizes if s == source)
    ordered = mx.mixed(docs, block=8)
    assert ordered.columns == docs.columns
    assert [r.doc_id for r in ordered.collect()] == [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.place))]


def test_prefix_shares_follow_the_weights(docs_of):
    docs = docs_of(["t"] * 2000, source=lambda k: "a" if k % 2 else "b")
    rows = mx.mixed(docs, {"a": 0.75, "b": 0.25}, block=4).limit(800).collect()
    assert abs(sum(r.source == "a" for r in rows) / 800 - 0.75) < 0.01


def test_repeated_rows_missing_weights_and_empty_tables(docs_of):
    docs = docs_of(["t"] * 5)
    assert mx.mix(docs.unionByName(docs)).count() == 10
    with pytest.raises(ValueError):
        mx.mix(docs, {"s0": 1.0})
    assert mx.mix(docs.limit(0)).collect() == [] and mx.mixed(docs.limit(0)).collect() == []
