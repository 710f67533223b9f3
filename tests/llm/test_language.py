"""Languages without spaces, and languages without calibration documents."""

import random

import numpy as np

from graphloom.llm import language


def test_pieces_hold_each_long_gram_once():
    for n in (1, 3, 60, 66, 67, 68, 69, 130, 133, 500):
        word = language.START + "".join(chr(0x4E00 + k) for k in range(n)) + language.STOP
        pieces = language._pieces(word)
        grams = [p[k : k + language.ORDER] for p in pieces for k in range(len(p) - language.ORDER + 1)]
        assert grams == [word[k : k + language.ORDER] for k in range(len(word) - language.ORDER + 1)]
        assert pieces[0][0] == language.START and pieces[-1][-1] == language.STOP and max(map(len, pieces)) < 70


def test_languages_without_spaces_are_learned(spark):
    rng = random.Random(4)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(300))
    rows = [(k, text("abcdefgh" if k % 2 else "ijklmnop"), "aa" if k % 2 else "bb") for k in range(120)]
    models = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(k, text("abcdefgh" if k % 2 else "ijklmnop")) for k in range(20)]
    out = language.identify(spark.createDataFrame(asked, "doc_id long, text string"), models).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") and not r.rejected for r in out)


def test_language_without_calibration_documents_rejects(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(30)), "aa") for k in range(120)] + [(500 + k, "xyz zyx", "cc") for k in range(3)]
    models = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert np.isfinite(models.allowed).all()
    noise = "".join(rng.choice("xyzqwvutsr") for _ in range(400))
    assert language.identify(spark.createDataFrame([(1, noise)], "doc_id long, text string"), models).first().rejected


def test_kept_models_go_with_the_next_operator():
    from graphloom.llm import shared

    own = shared.kept("language")
    assert own is language._SCORERS
    own[0] = "models"
    shared.let_go("language")
    assert own
    shared.let_go()
    assert not own
