"""Token files: ids against whole-text encoding, layout of the files, selective reads, edge cases."""

from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from loamstat.llm import common, queries, token_files

TEXTS = [
    None,
    "",
    " \t\n ",
    "Hello hello HELLO don't DON'T, it's",
    "a<|endoftext|>b <|ENDOFTEXT|> <|endoftext|>",
    "größer ñandú 東京 é ́x Å b c ΟΔΟΣ οδος İI",
    "x" * 30_000,
    "word " * 40_000,
    "\x00\x1f 12345 ½ 🙂🙂 <| |> <|start",
]


@pytest.fixture(scope="module")
def vocabulary() -> Tokenizer:
    return Tokenizer.from_file(token_files.vocabulary_path())


def write(spark, tmp_path, texts, name="t", **options) -> str:
    path = f"{tmp_path}/{name}"
    spark_rows = spark.createDataFrame(texts, "doc_id long, text string, ids string, part string, `a.b` int")
    token_files.write_token_files(spark_rows.repartition(3), f"file://{path}", **options)
    return path


def rows_of(texts):
    return [(i, t, "x", "y", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("encoding", token_files.ENCODINGS)
def test_digests_equal_whole_text_encoding(spark, tmp_path, vocabulary, encoding):
    rng = random.Random(3)
    texts = TEXTS + [" ".join("".join(rng.choices("abCÉ9<|>-'", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    data = rows_of(texts)
    rng.shuffle(data)
    path = write(spark, tmp_path, data, encoding=encoding, file_bytes=200_000)
    assert len(glob.glob(f"{path}/part-*.parquet")) > 1
    got = token_files.token_digests(spark, f"file://{path}").toPandas().sort_values("doc_id")
    at = 0
    for i, row in enumerate(got.itertuples()):
        ids = vocabulary.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        assert (row.doc_id, row.start, row.n_tokens) == (i, at, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    meta = token_files.read_metadata(spark, f"file://{path}").toPandas().sort_values("doc_id")
    assert meta.start.tolist() == got.start.tolist() and meta.n_tokens.tolist() == got.n_tokens.tolist()


def test_files_have_the_layout_asked_for(spark, tmp_path):
    rng = random.Random(5)
    data = rows_of([" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=40)) for _ in range(4_000)])
    path = write(spark, tmp_path, data, row_group_bytes=60_000, page_rows=100, file_bytes=1 << 20)
    files = sorted(glob.glob(f"{path}/part-*.parquet"))
    last = -1
    for f in files:
        meta = pq.ParquetFile(f).metadata
        names = [meta.row_group(0).column(i).path_in_schema for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            ids, doc = group.column(names.index("ids.list.element")), group.column(names.index("doc_id"))
            assert "RLE_DICTIONARY" in ids.encodings and "DELTA_BINARY_PACKED" in doc.encodings
            assert ids.has_offset_index and doc.has_column_index and doc.has_offset_index
            assert last < doc.statistics.min <= doc.statistics.max
            last = doc.statistics.max
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > len(files)
    delta = write(spark, tmp_path, data[:50], "d", encoding="delta")
    meta = pq.ParquetFile(glob.glob(f"{delta}/part-*.parquet")[0]).metadata.row_group(0)
    kinds = {meta.column(i).path_in_schema: meta.column(i).encodings for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in kinds["ids.list.element"] and "RLE_DICTIONARY" not in kinds["ids.list.element"]
    with pytest.raises(ValueError, match="encoding"):
        write(spark, tmp_path, data[:2], "no", encoding="plain")


def test_selective_reads(spark, tmp_path, vocabulary):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["one", "two", "three", "mississippi"], k=rng.randint(0, 30))) for _ in range(300)]
    path = "file://" + write(spark, tmp_path, rows_of(texts), file_bytes=3_000)
    lists = [vocabulary.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    all_ids = [i for one in lists for i in one]
    for first, last in ((0, 1), (17, 18), (100, 900), (0, len(all_ids)), (len(all_ids) - 3, len(all_ids) + 50), (5, 5), (len(all_ids), len(all_ids) + 2)):
        got = token_files.read_tokens(spark, path, first, last).orderBy("start").collect()
        assert [i for r in got for i in r.ids] == all_ids[first:last]
        assert all(r.start == first + sum(len(q.ids) for q in got[:k]) for k, r in enumerate(got))
    some = token_files.read_documents(spark, path, 40, 43)
    assert {r.doc_id: r.ids for r in some.collect()} == {i: lists[i] for i in range(40, 44)}
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,40)" in plan
    meta = token_files._rows(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in meta


def test_repeated_rows_null_ids_and_empty_tables(spark, tmp_path):
    data = [(7, "same same", "", "", 0)] * 400 + [(None, "no id", "", "", 0)] * 3 + [(7, "other", "", "", 0), (1, "a", "", "", 0), (9, None, "", "", 0)]
    path = "file://" + write(spark, tmp_path, data, file_bytes=1_000)
    got = token_files.token_digests(spark, path).toPandas().sort_values("start")
    assert len(got) == len(data) and got.doc_id[:3].isna().sum() + got.doc_id.isna().sum() >= 3
    assert got.doc_id.isna().tolist()[:3] == [True] * 3 and got.doc_id.iloc[-1] == 9 and got.doc_id.iloc[3] == 1
    assert (got.start.diff().iloc[1:].to_numpy() == got.n_tokens.iloc[:-1].to_numpy()).all()
    assert token_files.file_totals(spark, path).count() > 2  # the repeated row lies in several files
    none = "file://" + write(spark, tmp_path, [], "none")
    assert token_files.token_digests(spark, none).count() == 0 and token_files.read_tokens(spark, none, 0, 9).count() == 0


def test_known_pieces_are_forgotten_and_learnt_again(vocabulary):
    with open(token_files.vocabulary_path(), "rb") as f:
        encoder = token_files.PieceEncoder(f.read(), most=50)
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randint(0, 90)}" for _ in range(rng.randint(0, 25))) for _ in range(6)]
        data, offs = common.flat_bytes(__import__("pyarrow").array(texts))
        flat, cut = encoder.texts(data, offs, 1)
        for i, t in enumerate(texts):
            assert flat[cut[i] : cut[i + 1]].tolist() == vocabulary.encode(t, add_special_tokens=False).ids + [1]


def test_query_on_whole_table(spark, vocabulary):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_token_files(spark, sf).toPandas().sort_values("start")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.doc_id.tolist() == sorted(docs)
    at = 0
    for row in got.itertuples():
        ids = vocabulary.encode(docs[row.doc_id], add_special_tokens=False).ids + [1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
