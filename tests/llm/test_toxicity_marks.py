"""Words beside any punctuation are seen by the scorer as by the learner."""

import string

from voltweave.llm import toxicity as tx

MODEL = tx.Model({"idiot": 4.0}, {"fools": 3.0}, 5.0, -4.0)


def weights(text):
    return tx.clause_weights(text, tx._Lexicon(MODEL), tx.compose())


def test_marks_on_and_in_chunks():
    for mark in [*string.punctuation, *"«»„“”…", "###", "$$$"]:
        assert sum(weights(f"so idiot{mark} then")) == 4.0, mark
        assert sum(weights(f"so {mark}idiot then")) == 4.0, mark
        assert sum(weights(f"x{mark}idiot")) == 4.0, mark
        assert sum(weights(f"idiot{mark}foolsgold")) == 7.0, mark
    for text in ("you,idiot", "you/idiot", "idiot/you", "you're,idiot", "idiot,you're"):
        assert weights(text) == [4.0 * tx.TARGETED], text
    assert weights("isn't,idiot") == [4.0 * tx.NEGATED] and weights("idiot's") == [4.0]
    assert weights("you!idiot") == [4.0] and weights("idiot###. you") == [4.0]
    assert weights("so 3.5 of a.b/c") == []
