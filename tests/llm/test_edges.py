"""Every operator and pipeline stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamstat.llm import decontamination, jaccard_join, license_scan, media_chunks, mixing, quality, queries, sampling, token_counts, toxicity, warc
from loamstat.llm.chat_format import digests, format_conversations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, `__t` string, copies int, sig long"
LABELS = "doc_id long, quality int, toxic int"


def words(n: int, at: int = 0) -> str:
    return " ".join(f"w{(i * 7919 + at * 31) % 10007}x{i % 13}" for i in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    extra = (0.5, 1, "t", 3, 7)
    rows = [
        (1, words(40), "en", "a", 1, *extra),
        (1, words(40), "en", "a", 1, *extra),  # a repeated row
        (2, words(40), "en", "b", 1, *extra),  # an exact copy
        (3, None, None, None, None, *extra),
        (4, "", "en", "a", 0, *extra),
        (4, "", "en", "a", 0, *extra),
        (None, "no id here at all", "en", None, 1, *extra),
        (None, None, None, None, None, *extra),
        (5, words(30_000, 5), "en", "a", 1, *extra),  # a very long text
        (6, "x" * 50_000, "en", "c", 1, *extra),  # a very long word
        (7, " \t\n ", "en", "c", 1, *extra),
        (8, "under the MIT License, idiot. größer ñandú 東京", "de", "c", 1, *extra),
        (9, words(12, 9), "en", "c", 1, *extra),
    ] + [(100 + i, words(60, 100 + i) + (" idiot" if i % 2 else ""), "en", "d", 1, *extra) for i in range(40)]
    labels = [(100 + i, 1 - i % 3 // 2, i % 2) for i in range(40)] + [(1, None, None), (None, 1, 1), (100, 1, 0), (999, 1, 1)]
    bench = [(1, words(12, 9)), (1, words(12, 9)), (2, None), (3, ""), (None, "no id here"), (4, "the the the the the the the the the the the the")]
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    kinds = {
        "documents": (rows, DOCS),
        "labels": (labels, LABELS),
        "benchmark": (bench, "item_id long, text string"),
        "pages": ([(1, None, None), (2, "http://a", ""), (None, "http://b\nc", "<p>x<script>never closed"), (2, "http://a", "")], "page_id long, url string, html string"),
        "conversations": (
            [(1, 0, "user", None), (1, 1, "assistant", "a</turn>\n### x"), (1, 1, "assistant", "a</turn>\n### x"), (2, 0, None, "\\h \\\\e"), (None, None, "assistant", ""), (3, 5, "a\nb", "y" * 100_000)],
            "conv_id long, turn long, role string, text string",
        ),
    }
    for name, (data, schema) in kinds.items():
        spark.createDataFrame(data, schema).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty), len(rows)


PER_DOC = ["op1_toxicity", "op5_quality", "op6_ngram_jaccard_join", "op7_license_scan", "op8_mixing", "op9_decontamination", "op10_media_chunks"]


@pytest.mark.parametrize("name", PER_DOC)
def test_one_row_per_document(spark, tables, name):
    full, empty, n = tables
    got = queries.QUERIES[name](spark, full).toPandas()
    assert len(got) == n
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op2_chat_formatting", "op3_warc_derivatives", "op4_token_counts"])
def test_other_queries(spark, tables, name):
    full, empty, _ = tables
    assert queries.QUERIES[name](spark, full).count() > 0
    assert queries.QUERIES[name](spark, empty).count() == (1 if name.startswith("op2") else 0)


def test_components_of_edge_rows(spark, tables):
    got = jaccard_join.jaccard_components(spark.read.parquet(f"{tables[0]}/documents.parquet"), 3, 9, 10).toPandas()
    by = {i: g for i, g in got.groupby("doc_id")}
    assert set(by[2].component_id) == {1} and set(by[1].component_id) == {1} and len(by[1]) == 2
    assert set(by[4].component_id) == {4} and set(by[4].n_shingles) == {0} and set(by[3].n_shingles) == {0}
    none = got[got.doc_id.isna()]
    assert none.component_id.isna().all() and len(none) == 2


def test_media_of_edge_rows(spark, tables):
    got = media_chunks.media_features(spark.read.parquet(f"{tables[0]}/documents.parquet")).toPandas()
    assert (got.payload_bytes % 64 == 0).all() and (got.payload_bytes >= 64).all() and (got.payload_bytes >= got.n_bytes).all()
    assert got[got.doc_id.isin([3, 4])].media_sha256.nunique() == 1


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_pipeline_stages(spark, tables, name, stage):
    full, empty, n = tables
    for path in (full, empty):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        out = stage(spark, docs, path)
        assert set(docs.columns) <= set(out.columns)
        if name != "mixing":
            assert out.columns == docs.columns
        rows = out.toPandas()
        assert len(rows) == 0 if path == empty else len(rows) > 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_keep_extra_columns(spark, tables, name, stage):
    """Dotted names, and the names that stages use themselves."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    extra = ["a.b", "a b", "copy", "key", "row_key", "rows", "times", "stays", "doc", "sig", "__key", "__stays", "__copies", "__rows"]
    for c in extra:
        docs = docs.withColumn(c, docs.doc_id + 1)
    out = stage(spark, docs, tables[0])
    assert out.columns == docs.columns + (["copy_"] if name == "mixing" else [])
    rows = out.toPandas()
    known = rows[rows.doc_id.notna()]
    assert len(known) and all((known[c] == known.doc_id + 1).all() for c in extra)


def test_repeated_rows_and_ids_are_mixed_alike(spark):
    """A third of all rows are one row; copies stay within the bound and reruns agree."""
    rows = [(1, "a", "x y z")] * 900 + [(2, "a", f"u{i} v") for i in range(600)] + [(None, None, None)] * 300 + [(i, "b", "w " * (i % 40)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one = mixing.mix_sources(docs, block=64).toPandas()
    two = mixing.mix_sources(docs.repartition(5), block=64).toPandas()
    key = ["doc_id", "size", "source_size", "taken"]
    assert one[key].fillna(-1).sort_values(key).values.tolist() == two[key].fillna(-1).sort_values(key).values.tolist()
    assert len(one) == len(rows) and (one.taken <= 2 * one["size"]).all()
    for total, g in one[one.source_size > 0].groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 40
    taken = mixing.repeat_mixed(docs, block=64)
    again = mixing.repeat_mixed(docs.repartition(3), block=64)
    assert sorted(map(repr, taken.collect())) == sorted(map(repr, again.collect()))
    assert taken.count() == one.copies.sum()


def test_a_repeated_id_does_not_widen_a_training_sample(spark):
    docs = spark.createDataFrame([(7, f"text {i % 5}") for i in range(500)] + [(8, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    sample = sampling.labelled_sample(docs, labels, "toxic", F.lit(True), 10, 10)
    assert sorted(r.doc_id for r in sampling.one_per_id(sample).collect()) == [7, 8]


@pytest.mark.parametrize("piece", ["<script>", "<script", " <!--", "<head>", "<title>", "<a ", "<a href", "<html ", "<p", "</script ", "&", "<style></script>"])
def test_malformed_pages_take_linear_time(piece):
    began = time.time()
    for page in (piece * 60_000, piece * 60_000 + ">"):
        warc.plain_text(page)
        warc.page_fields(page)
    assert time.time() - began < 8


def test_stage_decisions(spark, tables):
    full = tables[0]
    docs = spark.read.parquet(f"{full}/documents.parquet")
    near = corpus_pipeline.drop_near_copies(spark, docs, full).toPandas()
    assert (near.doc_id == 1).sum() == 1 and (near.doc_id == 2).sum() == 0 and (near.doc_id == 4).sum() == 2
    assert near.doc_id.isna().sum() == 2
    clean = corpus_pipeline.drop_benchmark_leaks(spark, docs, full).toPandas()
    assert (clean.doc_id == 9).sum() == 0 and (clean.doc_id == 1).sum() == 2
    assert (clean.text == "no id here at all").sum() == 0  # a short item is one window


def test_whole_pipeline(spark, tables):
    out = corpus_pipeline.run(spark, tables[0]).toPandas()
    assert len(out) and (out["copy"] >= 1).all() and out.groupby(["doc_id", "text"], dropna=False)["copy"].max().max() <= 2


def test_operators_ignore_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for name in ("doc", "rowkey", "comp", "size", "target", "taken", "n", "__key", "file", "terms", "shard", "y", "copy"):
        docs = docs.withColumn(name, docs.lang)
    labels = spark.read.parquet(f"{tables[0]}/labels.parquet")
    n = docs.count()
    assert toxicity.toxicity_scores(docs, labels).count() == n
    assert quality.quality_scores(docs, labels).count() == n
    assert jaccard_join.jaccard_components(docs).count() == n
    assert license_scan.license_scan(docs).count() == n
    assert mixing.mix_sources(docs).count() == n
    assert decontamination.contamination(docs, spark.read.parquet(f"{tables[0]}/benchmark.parquet")).count() == n
    assert token_counts.token_attribution(docs).count() > 0
    turns = spark.read.parquet(f"{tables[0]}/conversations.parquet").selectExpr("*", "role AS transcript", "text AS body")
    assert digests(format_conversations(turns)).count() == 4
