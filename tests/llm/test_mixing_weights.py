"""The schedule against the weights as given, over many periods."""

import time

import pytest

from voltweave.llm import mixing as mx


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.4999, "c": 0.0001}, {str(k): 1.0 for k in range(20)}, {"a": 2 ** 0.5, "b": 3 ** 0.5, "c": 17.0}])
def test_less_than_one_block_off_the_exact_weights(weights):
    slots, total = 30_000, sum(weights.values())
    done, t = dict.fromkeys(weights, 0), 0
    for t, (source, i, slot, _, _) in enumerate(mx.schedule(weights, dict.fromkeys(weights, slots))):
        if t == slots:
            break
        assert slot == t and done[source] == i
        done[source] += 1
        assert abs(done[source] - weights[source] / total * (t + 1)) < 1 + 1e-6
        if t % 97 == 0:
            assert all(abs(done[s] - w / total * (t + 1)) < 1 + 1e-6 for s, w in weights.items())


def test_rows_of_a_mixture_follow_the_exact_weights(docs_of):
    weights = {"a": 0.5, "b": 0.4999, "c": 0.0001}
    docs = docs_of(["t"] * 12_003, source=lambda k: "c" if k > 12_000 else "a" if k % 2 else "b")
    slots = sorted({(r.slot, r.source) for r in mx.mix(docs, weights, block=1).collect()})
    done = dict.fromkeys(weights, 0)
    for slot, source in slots[:11_900]:
        done[source] += 1
        assert abs(done[source] - weights[source] * (slot + 1)) < 1 + 1e-6


@pytest.mark.parametrize("small", [1e-5, 1e-12])
def test_a_tiny_weight_takes_no_longer(small):
    began = time.perf_counter()
    plan = list(mx.schedule({"a": 1.0, "b": small, "c": 0.5}, {"a": 500, "b": 20, "c": 0}))
    assert time.perf_counter() - began < 1 and len(plan) == 520
    assert [p[2] for p in plan] == sorted({p[2] for p in plan})
    assert all(release <= slot < deadline for _, _, slot, release, deadline in plan)
    last = [p for p in plan if p[0] == "b"][-1]
    assert last[1] == 19 and abs(last[2] * small / (1.5 + small) - 19) < 1


def test_windows_hold_when_sources_run_out():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    plan = list(mx.schedule(weights, {"a": 7, "b": 90, "c": 3, "d": 40}))
    assert len(plan) == 140 and all(release <= slot < deadline for _, _, slot, release, deadline in plan)
