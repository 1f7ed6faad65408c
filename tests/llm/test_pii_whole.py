"""Spans that limits used to cut: long tokens, places between windows, forms without digit or at sign."""

import pytest

from voltweave.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.made_windows())


def test_tokens_of_any_length(field):
    jwt = "eyJhbGciOiJIUzI1NiJ9." + "eyJzdWIiOiIxMjM0NTY3ODkwIn" * 8 + ".SflKxwRJSMeKKF2QT4fwpM"
    for text, secret in [(f"see {jwt} ok", jwt), (f"Authorization: Bearer {'a1B2' * 50}", "a1B2" * 50), ("key " + "0a1b2c3d" * 20 + " x", "0a1b2c3d" * 20)]:
        at = text.index(secret)
        assert pii.spans(text, field)[1] == [(at, at + len(secret), "secret")], text[:30]
    for text in ["see https://example.com/" + "segment/" * 20 + "page1.html now", "1" * 3000, "12," * 80]:
        assert pii.spans(text, field)[1] == [], text[:30]


def test_phones_at_every_place_of_a_long_row(field):
    for k in range(40, 56):
        text = "12 " * k + "call (212) 555-0199 now " + "34 " * 40
        at = text.index("(212)")
        assert (at, at + 14, "phone") in pii.spans(text, field)[1], k


def test_forms_without_digit_or_at(field):
    assert pii.spans("password: correcthorse", field)[1] == [(10, 22, "secret")]
    assert pii.spans("mail john (at) example (dot) com now", field)[1] == [(5, 32, "email")]
    assert pii.spans("look at example dot com, the password is wrong (at times)", field)[1] == []
