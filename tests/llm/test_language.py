"""Language ID: Viterbi against brute force, edge rows, held-out accuracy."""

import itertools

import numpy as np

from fleetlens.llm import catalog, language

SF = "/root/testdata/sf0.01"


def slow_viterbi(s, switch):
    best = max(itertools.product(range(s.shape[1]), repeat=len(s)),
               key=lambda path: sum(s[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:])))
    return list(best)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    lengths = np.array([0, 5, 1, 7, 3, 0, 6])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    got, at = language.viterbi(scores, lengths, 1.0), 0
    for n in lengths:
        assert got[at:at + n].tolist() == slow_viterbi(scores[at:at + n], 1.0) if n else True
        at += n


def test_pieces_do_not_cut_words(monkeypatch):
    text = "Straße Привет мир " * 40 + "x" * 100 + " 123 -- ñandú"
    whole = list(language.word_pieces(text))
    monkeypatch.setattr(language, "PIECE_CHARS", 7)
    parts = list(language.word_pieces(text))
    assert np.array_equal(np.concatenate([f for f, _, _ in parts]), whole[0][0])
    assert np.array_equal(np.concatenate([s for _, _, s in parts]), whole[0][2])


def test_mixed_text_scripts_and_edges(spark):
    english = "the quick brown fox jumps over the lazy dog while the rain keeps falling on the old stone house "
    german = "der schnelle braune fuchs springt über den faulen hund während der regen auf das alte haus fällt "
    russian = "быстрая коричневая лиса прыгает через ленивую собаку пока дождь падает на старый дом "
    train = spark.createDataFrame([("en", english * 9), ("de", german * 9), ("ru", russian * 9), (None, english), ("en", None), ("en", "")],
                                  "lang string, text string")
    model = language.learn(train)
    assert model.languages == ["de", "en", "ru"]
    rows = [(1, english * 2), (2, german), (3, russian), (4, None), (5, ""), (6, "123 -- !!"), (7, english * 3 + german * 2 + russian),
            (8, "ελληνικά"), (None, english), (1, english * 2), (9, (english + german) * 2000)]
    docs = spark.createDataFrame([(*r, "zz", 5.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = language.predict(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[i].lang_pred for i in (1, 2, 3, None)] == ["en", "de", "ru", "en"]
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].spans == [] for i in (4, 5, 6))
    assert by[8].lang_pred in model.languages and by[1].score == 1
    assert [s.lang for s in by[7].spans] == ["en", "de", "ru"] and by[7].lang_pred == "en" and 0.4 < by[7].score < 0.7
    assert sum(s.words for s in by[9].spans) == len((english + german).split()) * 2000


def test_nothing_learnt_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.learn(none)
    assert model.languages == [] and language.predict(none, model).count() == 0
    docs = spark.createDataFrame([(1, "words here")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language.predict(docs, model).collect()] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    got = catalog.QUERIES["op8_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and len(r.text.split()) > 5]
    right = sum(r.lang == r.lang_pred for r in held)
    print(right, len(held))
    assert 100 < len(held) < 350 and right >= 0.97 * len(held)
