"""Repetition measures against plain Python."""

import re
from collections import Counter

from voltweave.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {k + d for k in range(len(words) - 2) if grams[tuple(words[k: k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n5 = Counter(tuple(words[k: k + 5]) for k in range(len(words) - 4))
    cover = {k + d for k in range(len(words) - 4) if n5[tuple(words[k: k + 5])] > 1 for d in range(5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside), sum(len(words[k]) for k in cover))


def test_measures(docs_of, odd_texts):
    texts = odd_texts + ["a b c\na b c\n\n a b c", "x\n\nx\n \nx", "#*| a < b\n#*| a < b", "ä ö ü " * 40, "a b c d e f " * 3, "\na\n", "a\x1cb a\x85b"]
    got = {r.doc_id: r for r in quality.verdict(quality.repetition(docs_of(texts, extra=True).repartition(2))).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.cover_5) == plain(t), k
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_clean_text_stays_and_repetition_goes(docs_of):
    clean = " ".join(f"word{k}" for k in range(300))
    lines = clean + "\n" + "\n".join(["the same line again"] * 40)
    got = {r.doc_id: r.kept for r in quality.verdict(quality.repetition(docs_of([clean, lines, "ab " * 100]))).collect()}
    assert got == {0: True, 1: False, 2: False}
    assert quality.repetition(docs_of(["a"]).limit(0)).collect() == []
