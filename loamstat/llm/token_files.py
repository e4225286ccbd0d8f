"""Token ids as Parquet list columns, for selective reads of tokens and metadata.

*Write.*  Rows are range-partitioned by ``doc_id`` and sorted, each partition is
encoded and becomes one file, so files in name order hold ascending ids.  A row
is ``doc_id, part, at, n_tokens, ids``: the file's number and the place of the
document among the file's ids make every row addressable without its list.
The list column is dictionary-encoded (a vocabulary is a small dictionary), the
sorted columns are delta-encoded; row groups have a size in bytes and pages a
number of rows, and the writer stores column and offset indexes for the pages.

*Read.*  ``read_metadata`` reads the flat columns only.  ``read_documents`` and
``read_tokens`` push ranges of ids or token positions into the scan, where row
group statistics and page indexes leave most pages unread.  ``token_digests``
reads everything back.

*Encoding.*  This vocabulary's pre-tokenizer drops white space and nothing
joins across it (composition of characters neither), so a text's ids are those
of its white-space-separated pieces.  Each task passes every distinct piece to
the ``tokenizers`` library once and keeps the ids of up to ``KNOWN_PIECES``
pieces; the first text of every batch is encoded whole too, and a difference
is an error.

Edge cases: null texts are empty, an empty text has the end id only; null ids
come first; rows that share an id are ordered by the digest of their text and
then by their place in the input, so a repeated row may be split over files;
very long texts are encoded piece by piece and never cut otherwise; empty
tables give files without rows; further columns of ``docs`` are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamstat.llm.common import checkpoint_root, materialize, small_batches, text_slices
from loamstat.llm.wordhash import SPACED, words

#: Id that ends every document.
END_ID = 1
#: Bytes of text that one file covers at most, at even lengths of the texts.
FILE_BYTES = 128 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 1_000
PAGE_BYTES = 256 << 10
#: Distinct pieces whose ids a Python worker keeps (some 50 MB).
KNOWN_PIECES = 1_000_000

ENCODINGS = ("dictionary", "delta")
_ROW = "doc_id long, part int, at long, n_tokens int, ids array<int>"


def vocabulary_path() -> str:
    """The default vocabulary's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ragged_take(values: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a ragged array, flat, and their lengths."""
    size = offs[rows + 1] - offs[rows]
    begin = np.cumsum(size) - size
    return values[np.repeat(offs[rows] - begin, size) + np.arange(size.sum())], size


class PieceEncoder:
    """Ids of texts by their distinct pieces; pieces are told apart by 128-bit digests."""

    def __init__(self, vocabulary: bytes, most: int = KNOWN_PIECES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.ids, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.array([len(i) for i in found], np.int64)
        flat = np.fromiter((i for one in found for i in one), np.int32, int(size.sum()))
        return flat, size

    def _learn(self, raw: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray, c: np.ndarray) -> None:
        flat, size = self._encode([raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        row = np.concatenate([self.row, len(self.offs) - 1 + np.arange(len(h))])
        self.ids = np.concatenate([self.ids, flat])
        self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(size)])
        hash, check = np.concatenate([self.hash, h]), np.concatenate([self.check, c])
        order = np.argsort(hash, kind="stable")
        self.hash, self.check, self.row = hash[order], check[order], row[order]

    def _known(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key would stand among the known ones, and whether it stands there."""
        if not len(self.hash):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        near = np.minimum(np.searchsorted(self.hash, key), len(self.hash) - 1)
        return near, self.hash[near] == key

    def texts(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows of a slice, each row's with the end id, and their offsets."""
        w = words(data, offs, SPACED, checked=True)
        rows = len(offs) - 1
        raw = data.tobytes()
        # letters' case is folded in the digests, as in this vocabulary; control strings keep theirs
        marked = np.zeros(len(w.hash), bool)
        at = raw.find(b"<|")
        while at >= 0:
            marked[np.searchsorted(w.start, at, "right") - 1] = True
            at = raw.find(b"<|", at + 1)
        key = w.hash.copy()
        for i in np.flatnonzero(marked):
            key[i] ^= np.uint64(zlib.crc32(raw[w.start[i] : w.end[i]]) * 2 + 1)
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if (w.check[first][inverse] != w.check).any():
            return self._plain(raw, offs, end_id)
        near, known = self._known(uniq)
        if len(self.hash) + (~known).sum() > self.most:
            self._forget()
            near, known = self._known(uniq)
        if known.any() and (self.check[near] != w.check[first])[known].any():
            return self._plain(raw, offs, end_id)
        if not known.all():
            new = first[~known]
            self._learn(raw, w.start[new], w.end[new], uniq[~known], w.check[new])
            near, _ = self._known(uniq)
        flat, size = _ragged_take(self.ids, self.offs, self.row[near][inverse] if len(uniq) else np.zeros(0, np.int64))
        per_row = np.bincount(w.doc, size, rows).astype(np.int64) if len(w.doc) else np.zeros(rows, np.int64)
        ends = np.cumsum(per_row)
        return np.insert(flat, ends, end_id).astype(np.int32), np.concatenate([[0], ends + np.arange(1, rows + 1)])

    def _plain(self, raw: bytes, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Every text as a whole: where two pieces share a 64-bit digest."""
        lists = [self.whole(raw[a:b].decode()) + [end_id] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return np.array([i for one in lists for i in one], np.int32), np.cumsum([0, *map(len, lists)])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


_encoders: dict[int, PieceEncoder] = {}


def _encoder(vocabulary: bytes) -> PieceEncoder:
    key = hash(vocabulary)
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        _encoders.clear()
        _encoders[key] = PieceEncoder(vocabulary)
    return _encoders[key]


def encode_sorted(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rows of the files: partition k of the result is file k, ascending by id inside and across partitions."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary or vocabulary_path(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(-(-size // file_bytes), min(spark.sparkContext.defaultParallelism, 1 + (size >> 20)))
    order = ["doc_id", "mark", "place"]
    marked = source.withColumn("mark", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = marked.repartitionByRange(int(files), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        encoder = _encoder(shared.value)
        told = False
        for rows, data, offs in text_slices(batches, "text"):
            flat, cut = encoder.texts(data, offs, end_id)
            if not told and offs[1] < (1 << 16):
                if flat[: cut[1] - 1].tolist() != encoder.whole(data[: offs[1]].tobytes().decode()):
                    raise ValueError("this vocabulary joins pieces across white space")
                told = True
            n = np.diff(cut)
            begin = at + cut[:-1]
            at += int(cut[-1])
            ids = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(begin.astype(np.int64)), pa.array(n.astype(np.int32)), ids], ["doc_id", "part", "at", "n_tokens", "ids"]
            )

    return dealt.mapInArrow(encode, _ROW)


def write_token_files(
    docs: DataFrame,
    path: str,
    encoding: str = "dictionary",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_rows: int = PAGE_ROWS,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode ``docs`` and write one file a partition to ``path``.

    ``encoding`` is that of the ids: ``dictionary`` (delta where a dictionary
    grows too large) or ``delta``.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    rows = encode_sorted(docs, vocabulary, end_id, id_col, text_col, file_bytes)
    (
        rows.write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("parquet.page.size", str(page_bytes))
        .parquet(path)
    )


def _rows(spark: SparkSession, path: str) -> DataFrame:
    small_batches(spark)
    return spark.read.schema(_ROW).parquet(path)


def file_totals(spark: SparkSession, path: str) -> DataFrame:
    """``part, docs, tokens, before``: one row per file, with the ids of all files before it.

    Reads two flat columns; the running sum goes over one row per file.
    """
    per = _rows(spark, path).groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("n_tokens").cast("long")).alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return materialize(per.withColumn("before", F.coalesce(before, F.lit(0)).cast("long")), "token-files")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, start, n_tokens`` without any ids."""
    totals = file_totals(spark, path).select("part", "before")
    return _rows(spark, path).join(totals, "part").select("doc_id", "part", (F.col("before") + F.col("at")).alias("start"), "n_tokens")


def read_documents(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """``doc_id, n_tokens, ids`` of the documents with ids from ``low`` to ``high``; the range reaches the page indexes."""
    return _rows(spark, path).where(F.col("doc_id").between(low, high)).select("doc_id", "n_tokens", "ids")


def read_tokens(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``start, doc_id, ids``: the ids at places ``first`` to before ``last`` of the whole sequence, cut to it.

    Files outside the range and, in them, pages outside are not read.
    """
    held = file_totals(spark, path).where((F.col("before") < last) & (F.col("before") + F.col("tokens") > first))
    span = held.agg(F.min(F.struct("part", "before")).alias("lo"), F.max(F.struct("part", "before")).alias("hi")).first()
    rows = _rows(spark, path)
    if span["lo"] is None or first >= last:
        return rows.where(F.lit(False)).select(F.col("at").alias("start"), "doc_id", "ids")
    lo, hi = span["lo"], span["hi"]
    kept = rows.where(F.col("part").between(lo["part"], hi["part"]) & ((F.col("part") < hi["part"]) | (F.col("at") < last - hi["before"])))
    placed = kept.join(held.select("part", "before"), "part").withColumn("start", F.col("before") + F.col("at"))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    take = F.least(F.lit(last) - F.col("start"), F.col("n_tokens").cast("long")) - skip
    return placed.where(take > 0).select((F.col("start") + skip).alias("start"), "doc_id", F.slice("ids", (skip + 1).cast("int"), take.cast("int")).alias("ids"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<u4").view(np.uint8)
            cut = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]) * 4
            crc = [zlib.crc32(flat[a:z]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            n = pa.array(np.diff(cut) // 4, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n, pa.array(crc, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    read = _rows(spark, path).select("doc_id", "part", "at", "ids").mapInArrow(digest, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    totals = file_totals(spark, path).select("part", "before")
    return read.join(totals, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_of(docs: DataFrame, tag: str = "token-ids", **options) -> DataFrame:  # noqa: ANN003
    """Write ``docs`` as token files to the shared work folder and return the digests read back."""
    import uuid

    path = f"{checkpoint_root(docs.sparkSession)}/work/{tag}-{uuid.uuid4().hex}"
    write_token_files(docs, path, **options)
    return token_digests(docs.sparkSession, path)
