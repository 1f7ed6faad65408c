"""Texts that made the patterns slow, and forms of any length."""

import random
import re
import time

import numpy as np
import pytest

from voltweave.llm import pii

WEIGHTS = np.zeros((pii.WIDTH, len(pii.KINDS)))
MB = 1_000_000


@pytest.mark.parametrize("text", [
    "1" * MB, " " * MB, "." * MB, "(" * MB, "( " * (MB // 2), "[at" * (MB // 3), "-eyJ" * (MB // 4), "eyJa." * (MB // 5), "@" * MB, "a@" * (MB // 2),
    "a" * MB + " (at) b", "x (dot) " * (MB // 8) + "(at) b.c", "(at) " * (MB // 5), "password" + " " * MB, "Bearer" + " " * MB, "+1" + " " * MB, "a(at)" * (MB // 5),
    "." + "1." * (MB // 2), "\n" * MB + "(at)"], ids=lambda t: repr(t[:12]))
def test_a_million_characters(text):
    began = time.perf_counter()
    pii.base_spans(text)
    pii.spelled(text)
    assert time.perf_counter() - began < 5


def test_ips_equal_the_plain_pattern():
    r = random.Random(2)
    for _ in range(20_000):
        text = "".join(r.choice("12.0.5 9.a") for _ in range(r.randint(0, 30)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in pii.IP.finditer(text)], text


LOCAL_PARTS = re.compile(r"(?i)[a-z0-9._%+-]+(?:\s*[(\[{]\s*dot\s*[)\]}]\s*[a-z0-9._%+-]+)*\Z")


def test_local_parts_equal_the_plain_pattern():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice(["a", "b.c", " ", "(dot)", "[ DOT ]", "(", "dot", ")", "é", "\n", "(at)"]) for _ in range(r.randint(0, 12)))
        m = LOCAL_PARTS.search(text)
        assert pii.local_start(text, len(text)) == (m.start() if m else len(text)), text


def test_long_local_part_is_whole():
    name = "first" * 60 + "x"
    assert pii.spelled(f"write to {name} (at) example (dot) org now") == [(9, 9 + len(name) + len(" (at) example (dot) org"), "email")]
    token = "eyJ" + "a" * 500 + ".bb.cc"
    assert pii.spelled(f"x-{token} z") == [(2, 2 + len(token), "secret")]


def test_added_spans_are_counted(docs_of):
    docs = docs_of(["call 1.2.3.4", "password = horse77battery", None])
    got = {r.doc_id: (r.n_ip, r.n_added) for r in pii.find(docs, WEIGHTS).collect()}
    assert got == {0: (1, 0), 1: (0, 1), 2: (0, 0)}
