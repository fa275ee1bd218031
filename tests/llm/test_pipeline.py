"""The pipeline against brute-force versions of its stages, on the small table and on edge rows."""

import public_tokenizers
import tiktoken
import xxhash

import corpus_pipeline as P
from fleetlens.llm import bpe, language
from .test_native import slow_contained
from .test_simhash import slow_print
from .test_substrings import slow

SF = "/root/testdata/sf0.001"


def slow_run(spark, docs, items):
    """{doc_id: (lang, source, ids)} and what each stage keeps."""
    model = language.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    lang, score, _ = model.labels(language.pa.array([d[1] for d in docs], language.pa.string()))
    first = [d for d, x, s in zip(docs, lang, score) if x != "und" and s >= 0.5]
    second = slow_near(first)
    third = []
    # a number for every row: its place by id, null ids and later texts of one id after all others
    order = sorted(set((d[0], d[1]) for d in second), key=lambda k: slow_key(*k))
    seen, late, numbers = set(), [], {}
    for k in order:
        if k[0] is None or k[0] in seen:
            late.append(k)
        else:
            numbers[k] = k[0]
        seen.add(k[0])
    top = max([k[0] for k in order if k[0] is not None], default=0)
    numbers.update({k: top + 1 + i for i, k in enumerate(late)})
    left = {int(r[0]): r for r in slow([(numbers[d[0], d[1]], d[1]) for d in second], 13)} if second else {}
    for d in second:
        rest = left[numbers[d[0], d[1]]]
        if rest[2] == 0:
            third.append(d)
        elif rest[3]:
            third.append((d[0], rest[3], d[2], d[3], len(rest[3])))
    gone = {r[0] for r in slow_contained([(i, d[1]) for i, d in enumerate(third)], items)}
    fourth = [d for i, d in enumerate(third) if i not in gone]
    return first, second, third, fourth


def slow_key(i, text):
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    return i is None, i or 0, signed(xxhash.xxh64_intdigest((text or "").encode(), 42))


def slow_near(rows):
    """One row of every group of prints within 3 bits of each other, by a walk over all pairs."""
    prints = sorted({slow_print(d[1]) for d in rows})
    group = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {p: new if g == old else g for p, g in group.items()}
    best = {}
    for d in rows:
        g = group[slow_print(d[1])]
        rank = (*slow_key(d[0], d[1]), [(x is not None, x) for x in d])
        if g not in best or rank < best[g][0]:
            best[g] = rank, d
    return [d for _, d in best.values()]


def check(spark, docs, items, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(docs, schema)
    key = lambda rows: sorted(map(str, rows))
    for (name, stage), want in zip(P.STAGES, slow_run(spark, docs, items), strict=False):
        got = stage(spark, frame, sf_dir)
        assert got.columns == P.COLUMNS
        rows = [tuple(r) for r in got.collect()]
        assert key(rows) == key(want), name
        frame = spark.createDataFrame(rows, schema)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(P.VOCABULARY), special_tokens={})
    got = P.STAGES[4][1](spark, frame, sf_dir).collect()
    want = [(d[0], d[2], d[3], theirs.encode_ordinary(d[1])) for d in want]
    assert key((r.doc_id, r.lang, r.source, r.ids) for r in got) == key(want) and all(len(r.ids) == r.n_tokens for r in got)
    return [len(x) for x in slow_run(spark, docs, items)]


def test_stages_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 ...", None, "s", 7), (903, "x " + items[0][1] + " y", "es", None, 3),
             (None, "a text without an id " + docs[3][1][:200], "en", "s", 1)]
    # clashing, repeated and null ids: other texts under a known id, copies of them, exact repeats, benchmark items without an id
    docs += [(docs[3][0], docs[5][1], "en", "s", 1), (5000, docs[3][1], "en", "s", 1), (5000, "an own text under an id that another row has", "en", "s", 1),
             (5001, "said more than once, word for word", "en", "b", 2), (5001, "said more than once, word for word", "en", "a", 1),
             (None, "no id here " + items[1][1], "en", "s", 1), (None, "nor here, yet another story " + docs[7][1], "en", "s", 1), (None, docs[8][1], "en", "s", 1)]
    counts = check(spark, docs, items, SF)
    assert counts[0] < len(docs) and counts[1] < counts[0] and counts[3] < counts[2]


def test_run_equals_its_stages(spark):
    got = P.run(spark, SF).collect()
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        frame = stage(spark, frame, SF)
    assert sorted(map(str, got)) == sorted(map(str, frame.collect())) and got


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.count() == 0
