"""The agenda against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest

from voltweave.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def tool():
    return pieces.codec(PATH)


def texts():
    r = random.Random(5)
    odd = ["  two  spaces ", "▁x ▁▁y", "<s>a</s><unk><0x41>", "a\x00b\r\n\tc", "ﬁ   　 Å", "😀👍🏽 中文 हिन्दी ½ Ⅳ",
           "x" * 5000, " " * 3001, "ab " * 2000, "﻿​‮", "naïve café ÀÉÎ", "a" + " " * 17 + "b", "aaaaaaaaaaaaaaaaa bbbbbbb"]
    alphabet = "aabcehinorst'ABéüñΣß1½_-. \n▁😀中  "
    return odd + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(800)]


def test_equals_the_library(docs_of, tool, odd_texts):
    every = odd_texts + texts()
    got = pieces.digests(pieces.encode_decode(docs_of(every, extra=True).repartition(3), PATH)).collect()
    assert len(got) == len(every)
    for r in got:
        ids = tool.library.encode(every[r.doc_id] or "", add_bos=True, add_eos=True)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest()), every[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(tool.library.decode(ids).encode()).hexdigest()


def test_agenda_takes_the_best_pair_first(tool):
    """Against rescanning all pairs for the best score, leftmost first."""
    r = random.Random(2)
    for _ in range(500):
        parts = list("".join(r.choice("▁aehinorst") for _ in range(r.randint(1, 20))))
        text = "".join(parts)
        while True:
            found = [(tool.place[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in tool.place]
            if not found:
                break
            k = min(found)[1]
            parts[k: k + 2] = [parts[k] + parts[k + 1]]
        assert pieces.unpacked(tool._agenda(text)).tolist() == [tool.ids[p] for p in parts], text


def test_decode_of_any_ids(tool):
    r = random.Random(3)
    for _ in range(3000):
        ids = [r.choice([0, 1, 2, r.randint(3, 258), 259, 28705, r.randint(261, 31999)]) for _ in range(r.randint(0, 12))]
        assert tool.decode(ids) == tool.library.decode(ids), ids


def test_batches_are_checked(docs_of, odd_texts, tool):
    docs = docs_of(odd_texts + texts()[:50])
    assert pieces.encode_decode(docs, PATH, check=True).count() == docs.count()
    with pytest.raises(ValueError, match="ids differ"):
        pieces.compare(tool, ["a b"], [tool.encode("a c")], ["a b"])
    with pytest.raises(ValueError, match="decoding differs"):
        pieces.compare(tool, ["a b"], [tool.encode("a b")], ["a c"])


def test_nulls_and_empty_table(docs_of, spark):
    assert pieces.encode_decode(docs_of(["a"]).limit(0), PATH).collect() == []
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    got = pieces.digests(pieces.encode_decode(rows, PATH)).collect()
    assert sorted(r.n_tokens for r in got) == [2, 4, 4]
