"""Shared helpers: work tables, Arrow text slices, Bloom prefilters, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; keeps NumPy temporaries small.
SLICE_BYTES = 1 << 21


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in one process (tests) a
    temporary folder is made and set; a cluster without it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Rows of an Arrow batch of texts: Spark's default of 10,000 would hold tens
#: of megabytes in the JVM and in every Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size where it is above BATCH_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def materialize(df: DataFrame, tag: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to a work table in the shared folder and read it back.

    Cuts the lineage, survives lost executors and lets several later plans
    read one computation.  Rows of megabytes need small ``group_rows``: Spark
    writes and reads up to a whole row group in memory, and Parquet's writer
    looks at a group's size every 100 rows only.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_root(spark)}/work/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", str(group_rows))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into runs of whole rows of about ``limit`` bytes.

    A single longer text makes a run of its own: texts are never cut.
    """
    for batch in batches:
        at = 0
        n = batch.num_rows
        if n == 0:
            continue
        _, offs = flat_bytes(batch.column(batch.schema.get_field_index(column)))
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
            to = min(n, max(to, at + 1))
            part = batch.slice(at, to - at)
            data, own = flat_bytes(part.column(part.schema.get_field_index(column)))
            yield part, data, own
            at = to


# --- private columns ----------------------------------------------------------


def quoted(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of ``df`` has."""
    return _apart({c.lower() for c in df.columns}, names)


def _apart(taken: set[str], names: Iterable[str]) -> list[str]:
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` that keeps the columns, also those whose names ``mapInArrow`` can't resolve."""
    plain = df.toDF(*_apart(set(), [re.sub(r"\W", "_", c) for c in df.columns]))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


# --- Bloom prefilter -------------------------------------------------------

#: Bits of a filter for each of its keys (2 % false alarms or fewer with four probes).
BLOOM_BITS_PER_KEY = 12
#: The largest filter, 64 MB.  Some 60 million keys and more fill it, which only lets more rows
#: through to the exact join behind it.
BLOOM_MOST_BITS = 1 << 29
_BLOOM_HASHES = 4


def bloom_bits(keys: int, most: int = BLOOM_MOST_BITS) -> int:
    """The power of two that gives ``keys`` keys their bits, 2^16 at least and ``most`` at most."""
    return min(most, 1 << max(16, (keys * BLOOM_BITS_PER_KEY - 1).bit_length()))


def key_longs(column: pa.Array) -> np.ndarray:
    """Longs of a column of longs, or the first eight bytes of a column of 16-byte digests; no nulls."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    data, _ = flat_bytes(column)
    return data.reshape(-1, 16)[:, :8].copy().view("<i8").ravel()


def bloom_build(keys: DataFrame, most: int = BLOOM_MOST_BITS) -> np.ndarray:
    """One-column frame of longs or 16-byte digests -> bit filter, sized by the number of keys.

    ``keys`` is read twice and should be a work table.  Every task folds its
    keys into a bit array and emits its used pieces; Spark ORs them by piece,
    so the driver gets the filter's size at most.
    """
    bits = bloom_bits(keys.count(), most)
    piece = min(1 << 17, bits // 8)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 8, np.uint8)
        for b in batches:
            k = key_longs(b.column(0).drop_null())
            if len(k):
                base, step = _bloom_hash(k)
                for i in range(_BLOOM_HASHES):
                    p = _bloom_place(base, step, i, bits)
                    np.bitwise_or.at(seen, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
        parts = seen.reshape(-1, piece)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["i", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(piece, np.uint8)
        for x in table.column("bits"):
            total |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"i": table.column("i").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})

    schema = "i int, bits binary"
    got = keys.mapInArrow(fold, schema).groupBy("i").applyInArrow(merge, schema).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in got:
        out[r["i"] * piece : (r["i"] + 1) * piece] = np.frombuffer(r["bits"], np.uint8)
    return out


def _bloom_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(keys.view(np.uint64) if keys.dtype == np.int64 else keys.astype(np.uint64))
    return x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)


def _bloom_place(base: np.ndarray, step: np.ndarray, i: int, bits: int) -> np.ndarray:
    return ((base + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def bloom_has(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter; later probes look at the survivors of earlier ones only."""
    base, step = _bloom_hash(keys)
    left = np.arange(len(keys))
    for i in range(_BLOOM_HASHES):
        p = _bloom_place(base[left], step[left], i, len(bloom) * 8)
        left = left[(bloom[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(keys), bool)
    out[left] = True
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 128-bit digest (16 bytes) of a row's id and text; nulls have values of their own."""
    return digest_of(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def digest_of(*columns: Column) -> Column:
    """A 128-bit digest (16 bytes) of a row's values; the last column may hold any text."""
    *heads, last = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")) for c in columns]
    marked = [part for c in heads for part in (F.length(c).cast("string"), c)]
    return F.unhex(F.md5(F.concat(*marked, last)))


def sieve(bloom: np.ndarray, spark: SparkSession, place: int, wanted: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over Arrow batches that keeps the rows whose key (column ``place``) may be in the filter, or surely is not."""
    shared = spark.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = bloom_has(shared.value, key_longs(b.column(place))) == wanted
                if keep.any():
                    yield b.filter(pa.array(keep))

    return run


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """``(surely without, maybe with)`` a key among ``keys`` (one column), and the key's column in the second.

    Two maps over ``df`` by a Bloom filter, so that only the second part need
    be shuffled to an exact join.
    """
    spark = df.sparkSession
    bloom = bloom_build(keys)
    (name,) = fresh(df, "row_key")
    keyed = df.withColumn(name, key)
    last = len(df.columns)
    return map_rows(keyed, sieve(bloom, spark, last, False)).select(*quoted(df)), map_rows(keyed, sieve(bloom, spark, last)), name


def drop_keys(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not among ``keys`` (a work table of one column)."""
    sure, maybe, name = split_by_keys(df, key, keys)
    return sure.unionByName(maybe.join(keys.toDF(name), name, "left_anti").select(*quoted(df)))


# --- 64-bit mixing ----------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# --- connected components ---------------------------------------------------


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge list."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an edge list ``(a long, b long)``: rows ``(node, comp)``.

    ``comp`` is the smallest node reachable.  Alternating large-star and
    small-star rounds (each a grouped minimum over the edges, spread by
    node), a work table after every round, until no edge changes (some
    log^2 of the longest path).  The driver sees three numbers a round.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    mark = _mark(now)
    while True:
        # large star: hang every larger neighbour on the smallest of the neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: hang the node and its smaller neighbours on the smallest one
        large = large.where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        new = materialize(small, "cc")
        mark, before = _mark(new), mark
        now = new
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)
