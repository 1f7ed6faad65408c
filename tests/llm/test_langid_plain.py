"""Language ID against counting and multiplying letter by letter."""

import math
import random

from voltweave.llm import langid

MASK = (1 << 32) - 1


def plain_grams(text):
    """(order, bucket) of every n-gram: letters in lower case, one border for anything between them."""
    letters = []
    for c in text or "":
        low = c.lower()
        v = (ord(low) if len(low) == 1 else ord(c)) if c.isalpha() else 0
        if v or not letters or letters[-1]:
            letters.append(v)
    out = []
    for k, n in enumerate(langid.ORDERS):
        for i in range(len(letters) - n + 1):
            w = letters[i: i + n]
            if all(w[1:-1]) and (w[0] or w[-1]):
                h = 0
                for v in w:
                    h = (h * 0x01000193 + v) & MASK
                h = ((h ^ (h >> 15)) * 0x85EBCA6B) & MASK
                out.append((k, h >> 17))
    return out


def plain_model(rows):
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            own = counts.setdefault(lang, {})
            for g in plain_grams(text):
                own[g] = own.get(g, 0) + 1
    return counts


def plain_prediction(counts, text):
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    logs = {}
    for lang in sorted(counts):
        totals = [sum(n for (k, _), n in counts[lang].items() if k == order) for order in range(len(langid.ORDERS))]
        logs[lang] = sum(math.log((counts[lang].get(g, 0) + langid.SMOOTHING) / (totals[g[0]] + langid.SMOOTHING * langid.BUCKETS)) for g in plain_grams(text))
    best = max(sorted(logs), key=logs.get)
    return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())


def test_predictions_equal_the_plain_ones(spark):
    r = random.Random(5)
    words = {"en": "the cat sat on mat with house İ".split(), "de": "der Hund und die Straße ÄRGER groß".split(), "fr": "le chât où été ça LES".split()}
    make = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", ",", " 12", "-"]) for _ in range(n))
    train = [(make(lang, 30), lang) for lang in words for _ in range(4)] + [(None, "en"), ("text", None), ("", "fr"), (make("en", 9),) * 1 + ("en",)]
    rows = [(k, t, lang) for k, (t, lang) in enumerate(train)]
    schema = "doc_id long, text string, lang string"
    model = langid.train(spark.createDataFrame(rows, schema).repartition(3))
    counts = plain_model(train)
    texts = [make(r.choice(list(words)), r.randint(1, 4)) for _ in range(150)] + ["", None, " 1 ", "a", "aß", "the und", "the und", "x" * 500]
    got = langid.predict(spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], schema), model).collect()
    assert len(got) == len(texts)
    for x in got:
        lang, score = plain_prediction(counts, texts[x.doc_id])
        assert x.lang_pred == lang and abs(x.score - score) < 1e-3, texts[x.doc_id]


def test_equal_scores_go_to_the_first_language(spark):
    rows = [(0, "same words", "b"), (1, "same words", "a"), (2, "same words", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.train(docs)).collect()
    assert [x.lang_pred for x in got] == ["a"] * 3 and all(abs(x.score - 1 / 3) < 1e-6 for x in got)
