"""The automaton against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voltweave.llm import bpe

PATH = public_tokenizers.path(bpe.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    r = random.Random(5)
    odd = ["aaaaaaa aaa", "Σίσυφος ΟΔΟΣ", "İstanbul ﬁ", "<|endoftext|>Hi<|startoftext|>there<|END|>", "a\x1cb\x1f\x85c\xa0d",
           "😀👍🏽 中文 हिन्दी ½ Ⅳ _a_", "é Å", "'S'T don't CAN'T've"]
    alphabet = "aabcehinorst'ABéüñΣß1½_-. \n😀中"
    return odd + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(400)]


def test_round_trip_equals_the_library(docs_of, library, odd_texts):
    all_texts = odd_texts + texts()
    got = bpe.digests(bpe.encode_decode(docs_of(all_texts, extra=True).repartition(3), PATH)).collect()
    assert len(got) == len(all_texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, all_texts[r.doc_id])


def test_empty_table(docs_of):
    assert bpe.digests(bpe.encode_decode(docs_of(["a"]).limit(0), PATH)).collect() == []


def test_automaton_equals_merging_by_rank():
    merges = [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "a"), ("aa", "b"), ("c", "ab"), ("aa", "aa"), ("bc", "a")]
    vocab = {t: k for k, t in enumerate(["a", "b", "c", *dict.fromkeys(u + v for u, v in merges)])}
    automaton = bpe.Automaton(vocab, merges)
    rank = {m: k for k, m in enumerate(merges)}
    r = random.Random(1)
    for _ in range(2000):
        word = "".join(r.choice("aabc") for _ in range(r.randint(1, 14)))
        parts = list(word)
        while True:
            best = min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                break
            parts[best[1]: best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert [vocab[p] for p in parts] == automaton.tokens(word), word
