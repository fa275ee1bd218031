"""Language ID with more languages than a byte can number."""

import numpy as np

from fleetlens.llm import language


def test_viterbi_numbers_300_languages():
    rng = np.random.default_rng(5)
    lengths = np.array([6, 0, 9, 1, 4])
    path = rng.integers(0, 300, lengths.sum())
    path[:3] = 299, 256, 280
    scores = np.where(path[:, None] == np.arange(300), 0, -50).astype(np.float32)
    assert language.viterbi(scores, lengths, 1.0).tolist() == path.tolist()


def test_300_languages_are_told_apart(spark):
    word = lambda k: "".join(chr(0x4E00 + 8 * k + j) for j in range(8))
    rows = [(k, f"l{k:03d}", " ".join([word(k)] * 5)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.learn(docs, script_share=0.0)
    mixed = spark.createDataFrame([(1000, " ".join([word(299)] * 6 + [word(43)] * 3 + [word(0)] * 2))], "doc_id long, text string")
    got = language.predict(docs.select("doc_id", "text").union(mixed), model).collect()
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in range(300)] == [f"l{k:03d}" for k in range(300)]
    assert [(s.start, s.words, s.lang) for s in by[1000].spans] == [(0, 6, "l299"), (6, 3, "l043"), (9, 2, "l000")]
    assert language.keep_labelled(docs, model).count() == 300
