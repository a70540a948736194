"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from quillgate.llm import hamming, hnsw, line_dedup, minhash, mixing, packing, pii, token_store, toxicity, url_filter
from quillgate.llm.scratch import Scratch

DOC = "doc_id bigint, text string, source string, lang string, n_chars bigint, h string, row string, score double"
LONG = "word and other " * 30_000
ROWS = [
    (0, "one two three four five six", "a", "en", 1, "x", "r", 0.1), (1, "one two three four five six", "b", "en", 1, "x", "r", 0.1), (2, None, "a", None, None, None, None, None),
    (3, "", None, "en", 0, "", "", 0.0), (4, "   \n ", "b", "en", 0, "", "", 0.0), (5, LONG, "a", "en", 9, "", "", 0.0), (6, "one two three four five six", "b", "en", 1, "x", "r", 0.1),
    (6, "one two three four five six", "b", "en", 1, "x", "r", 0.1), (7, "two words", None, "en", 9, "", "", 0.0), (None, "no id here at all now", "c", None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_mixing(docs, none):
    plan, _ = mixing.mix(docs)
    rows = plan.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in rows)
    assert mixing.mix(none)[0].count() == 0 and mixing.mixed_documents(none).count() == 0


def test_line_dedup(spark, docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == len(ROWS)
    assert line_dedup.dedup_lines(none).count() == 0
    rows = [(i, f"own line {i}\nshared by all sites\nanother own {i} line", f"s{i}") for i in range(12)] + [(20, "shared by all sites", "s0"), (21, "few\nown", "s1"), (22, "few\nown two", "s2")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[3].text == "own line 3\nanother own 3 line" and (got[3].n_lines, got[3].n_removed) == (3, 1)
    assert got[20].text == "shared by all sites" and got[20].n_removed == 0  # a copy stays whole
    assert got[21].text == "few\nown"


def test_near_duplicates(docs, none):
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert [rows[i].component_id for i in range(8)] == [0, 0, 2, 3, 4, 5, 0, 7]
    assert [rows[i].n_shingles for i in (0, 2, 3, 4, 7)] == [2, 0, 0, 0, 1] and not rows[1].kept and rows[2].kept
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 7  # 0, 2, 3, 4, 5, 7 and the row without an id
    assert minhash.near_duplicates(none).count() == 0


def test_token_store(spark, docs, none):
    rows = token_store.read_store(token_store.write_store(docs, Scratch(spark, "t"))).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 4, 5, 6, 6, 7] and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert token_store.read_store(token_store.write_store(none, Scratch(spark, "t"))).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs).collect()
    full = {}
    for r in rows:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in full.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 1024
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 5)
    assert all(n == 1024 for _, _, n in long[1:]) and [s for _, s, _ in long] == [sum(n for _, _, n in long[:i]) for i in range(len(long))]
    assert packing.pack_documents(none).count() == 0


def test_toxicity(spark, docs, none):
    model = toxicity.fit([("you idiot", 1), ("fine day", 0)] * 5)
    out = toxicity.score_documents(docs, model)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.score_documents(none, model).count() == 0
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.score_documents(docs, toxicity.train(docs, empty)).count() == len(ROWS)


def test_pii(docs, none):
    rows = pii.find_personal_data(docs, pii.train()).collect()
    assert len(rows) == len(ROWS) and all(r.base == "" for r in rows)
    assert pii.find_personal_data(none, pii.train()).count() == 0


def test_url_filter(spark):
    schema = "page_id bigint, url string, verdict string, host int"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "no scheme.com/en/", "x", 1), (4, "http://A.COM/en/x?q#f", "x", 1), (5, "http://a.example.com/en/7", "x", 1), (6, "http://u.example.net/de/81", "x", 1), (7, "http://" + "a" * 5000 + ".net/de/", "x", 1), (7, "http://a.netx/de/", "x", 1), (8, "x://b.org?/es/", "x", 1)]
    pages = spark.createDataFrame(rows, schema)
    model = url_filter.train(url_filter.labelled_urls(spark), trees=2)
    got = [(r.page_id, r.host, r.path, r.rule) for r in url_filter.judge_urls(pages, model).orderBy("page_id").collect()]
    assert got[:6] == [(1, "", "", None), (2, "", "", None), (3, "", "", None), (4, "a.com", "/en/x", "com/en/"), (5, "a.example.com", "/en/7", "example.com/en/7"), (6, "u.example.net", "/de/81", "example.net/de/8")]
    assert {g[3] for g in got if g[0] == 7} == {"net/de/", None} and got[-1] == (8, "b.org", "", None)
    verdicts = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, model).collect()}
    assert (verdicts[4], verdicts[5], verdicts[6]) == ("block", "allow", "block")
    assert url_filter.judge_urls(pages.limit(0), model).count() == 0
    assert url_filter.train(spark.createDataFrame([], "url string, label int")).trees == ()


VECTORS = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [2.0, 1.0], 1), (3, [1.0, 0.5], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.5], None), (9, [1.0, 0.5, 0.0], 1), (10, [-1.0, 0.5], 1), (None, [1.0, 0.5], 1)]


def test_embeddings(spark):
    frame = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.link_embeddings(frame).collect()}
    assert rows[0] == (2, 0, True) and rows[1] == (2, 0, False) and rows[2] == (2, 0, False)
    assert all(rows[i] == (0, i, True) for i in range(3, 11))
    assert hnsw.link_embeddings(frame.limit(0)).count() == 0


def test_hamming(spark):
    frame = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>, label int")
    codes = hamming.sign_codes(frame, "vec_id", "embedding")
    assert sorted(r.id for r in codes.collect()) == [0, 1, 2, 3, 5, 8, 9, 10]
    rows = hamming.top_k(codes, codes.filter("id = 0"), k=3).orderBy("rank").collect()
    assert [(r.rank, r.id, r.distance) for r in rows] == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert hamming.top_k(codes.limit(0), codes.limit(0)).count() == 0
    assert hamming.top_k(codes, codes.filter("id = 0"), k=50).count() == 7


ODD = "doc_id bigint, text string, source string, lang string, n_chars int, n_lines int, n_removed int, score double, predicted int, `a.b` string, `row` string, `h` string, `cut` string"


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    boiler = "the same line on every site of them all"
    rows = [(i, None if i == 1 else "" if i == 2 else f"own text number {i} of some length here\n{boiler}", f"s{i}" if i != 3 else None, "en", 7, -5, -6, 0.25, 9, f"dot {i}", "r", "h", "c") for i in range(14)]
    rows += [rows[4], (None, *rows[5][1:]), (50, "word " * 40_000, *rows[5][2:])]
    docs = spark.createDataFrame(rows, ODD)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, "/root/testdata/sf0.001")
            got = out.collect()
            if name == "packing":
                assert {r.doc_id for r in got} == {r.doc_id for r in frame.collect()}
                continue
            assert out.schema.names == frame.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in frame.schema]
            assert all((r.n_lines, r.n_removed, r.score, r.predicted, r["a.b"][:4], r.h, r.cut) == (-5, -6, 0.25, 9, "dot ", "h", "c") for r in got)
            if name == "line_dedup" and got:
                assert len(got) == len(rows) and {r.n_chars for r in got if r.text and boiler not in r.text and r.doc_id != 50} == {len("own text number 5 of some length here"), len("own text number 11 of some length here")}
                assert all(r.n_chars == 7 for r in got if r.doc_id in (1, 2, 50)) and not any(boiler in (r.text or "") for r in got)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from quillgate.llm.scratch import scratch_root

    conf = SimpleNamespace(get=lambda key, default=None: None)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_root(SimpleNamespace(conf=conf, sparkContext=context))
