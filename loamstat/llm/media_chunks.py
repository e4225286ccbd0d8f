"""Media columns by content-defined payload chunking.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64,
are the samples of an 8-bit mono WAV file: 44 header bytes and the payload.
The stored form is a list of chunks:

1. *Cuts.*  A gear hash (each byte adds a fixed random value to twice the
   hash, so it sees the last 32 bytes) cuts where its top bits are zero, with
   a least and a largest chunk size.  Equal stretches of different files get
   equal chunks, wherever they stand.
2. *Digests.*  Chunks are named by a 128-bit digest.  Spark counts the digests
   over all distinct files; those met more than once are shared chunks.
3. *Store.*  Each distinct file keeps an ordered chunk list.  Chunks of its
   own are stored with it; shared chunks are stored once, in a chunk table
   keyed by digest.  Which chunks are shared is told to the writing scan by a
   Bloom filter: a false alarm only sends a chunk to the chunk
   table, where it is stored once all the same.
4. *Read back.*  Files without shared chunks are put together from their own
   row.  The others join the chunk table by digest.  Every file read back is
   verified against its digest; features come from the samples read.

Edge cases: a null text is empty (64 zero samples); equal texts share all
their chunks and are read back once; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstat.llm.common import bloom_build, bloom_has, key_longs, materialize, text_slices

RATE = 8000
_GEAR = np.random.Generator(np.random.PCG64(4099)).integers(0, 1 << 32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class ChunkParams:
    """Chunk sizes in bytes: least, mean above the least (a power of two), largest."""

    least: int = 512
    mean: int = 2048
    most: int = 16384


def wav(payload: bytes) -> bytes:
    """An 8-bit mono PCM WAV file with the payload as samples."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload


def wav_payload(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this writer")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def padded(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash at all places at once, by doubling windows of 1, 2, 4, .. 32 bytes."""
    h = _GEAR[data]
    reach = 1
    while reach < 32 and reach < len(h):
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    return h


def cut_points(length: int, candidates: list[int], p: ChunkParams) -> list[int]:
    """Chunk ends of one file from the places where the gear hash would cut."""
    ends, last = [], 0
    for c in candidates:
        while c - last > p.most:
            last += p.most
            ends.append(last)
        if c - last >= p.least:
            last = c
            ends.append(last)
    while length - last > p.most:
        last += p.most
        ends.append(last)
    if last < length:
        ends.append(length)
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(media: bytes) -> dict[str, float]:
    """Sample statistics of the read-back file: mean, standard deviation, zero crossings, peak."""
    x = np.frombuffer(wav_payload(media), np.uint8).astype(np.int16) - 128
    return {
        "samples": len(x),
        "mean": float(x.mean()),
        "sd": float(x.std()),
        "crossings": int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum()),
        "peak": int(np.abs(x).max()),
    }


def _files(batches: Iterator[pa.RecordBatch], p: ChunkParams) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[bytes]], list[int]]]:
    """The files of a slice with their chunks.

    The hash runs over all files of a slice together: no cut lies in a file's
    first ``least`` (over 32) bytes, so none depends on the file before.
    """
    for part, data, offs in text_slices(batches, "text"):
        raw = data.tobytes()
        media = [wav(padded(raw[offs[r] : offs[r + 1]])) for r in range(part.num_rows)]
        begin = np.concatenate([[0], np.cumsum([len(m) for m in media])])
        cuts = np.flatnonzero(gear_hash(np.frombuffer(b"".join(media), np.uint8)) < np.uint32((1 << 32) // p.mean)) + 1
        split = np.searchsorted(cuts, begin, "right")
        pieces = []
        for r, m in enumerate(media):
            ends = cut_points(len(m), (cuts[split[r] : split[r + 1]] - begin[r]).tolist(), p)
            pieces.append([m[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        yield part, media, pieces, np.diff(offs).tolist()


def _lists(rows: list[list[bytes | None]]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array([x for r in rows for x in r], pa.binary()))


_RESULT = pa.schema(
    [
        ("file", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ]
)
_RESULT_DDL = "file binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(name: bytes, pieces: list[bytes]) -> dict:
    """What is known of a file that was read back; raises if it isn't what was stored."""
    media, chunks = b"".join(pieces), len(pieces)
    if digest(media) != name:
        raise ValueError("a file read back differs from what was stored")
    payload = wav_payload(media)
    f = features(media)
    return {
        "file": name,
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"chunks={chunks};mean={f['mean']:.4f};sd={f['sd']:.4f};crossings={f['crossings']};peak={f['peak']}",
    }


@dataclass(frozen=True)
class MediaStore:
    """``files``: (doc_id, n_bytes, file) of every row; ``lists``: (file, digests,
    own), ordered chunk lists with the chunks of the file's own and null for
    shared ones; ``shared``: (digest, bytes), each shared chunk once."""

    files: DataFrame
    lists: DataFrame
    shared: DataFrame


def store_media(docs: DataFrame, p: ChunkParams = ChunkParams()) -> MediaStore:
    """Write the chunked store; see the module's docstring, steps 1-3."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, media, pieces, sizes in _files(batches, p):
            names = pa.array([digest(m) for m in media], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), names, _lists([[digest(c) for c in own] for own in pieces])], ["doc_id", "n_bytes", "file", "digests"]
            )

    recipes = materialize(source.mapInArrow(name, "doc_id long, n_bytes long, file binary, digests array<binary>"), "recipes")
    met = recipes.select(F.explode("digests").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("k"))
    several = docs.sparkSession.sparkContext.broadcast(bloom_build(materialize(met.where("k > 1").select("d"), "several")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, media, pieces, _ in _files(batches, p):
            marks = [[digest(c) for c in own] for own in pieces]
            flat = [d for own in marks for d in own]
            far = bloom_has(several.value, key_longs(pa.array(flat, pa.binary())))
            common: dict[bytes, bytes] = {}
            lists, at = [], 0
            for own, mark in zip(pieces, marks, strict=True):
                out: list[bytes | None] = []
                for c, d in zip(own, mark, strict=True):
                    if far[at]:
                        common[d] = c
                    out.append(None if far[at] else c)
                    at += 1
                lists.append(out)
            for kind, keys, digests, chunks in (
                (0, [digest(m) for m in media], marks, lists),
                (1, list(common), [[] for _ in common], [[c] for c in common.values()]),
            ):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(keys), pa.int32()), pa.array(keys, pa.binary()), _lists(digests), _lists(chunks)], ["kind", "key", "digests", "own"]
                )

    written = materialize(source.mapInArrow(write, "kind int, key binary, digests array<binary>, own array<binary>"), "chunks")
    shared = written.where("kind = 1").select(F.col("key").alias("digest"), F.element_at("own", 1).alias("bytes")).dropDuplicates(["digest"])
    return MediaStore(
        recipes.select("doc_id", "n_bytes", "file"),
        written.where("kind = 0").select(F.col("key").alias("file"), "digests", "own"),
        materialize(shared, "shared"),
    )


def read_media(store: MediaStore) -> DataFrame:
    """``(file, media)`` rebuilt from the store, one row per distinct file."""
    whole = ~F.exists("own", lambda c: c.isNull())
    alone = store.lists.where(whole).select("file", "own")
    # files with shared chunks: once per distinct file, whatever the number of copies
    rest = store.lists.where(~whole).dropDuplicates(["file"])
    pieces = rest.select("file", F.posexplode(F.arrays_zip("digests", "own")).alias("seq", "c")).select("file", "seq", F.col("c.digests").alias("digest"), F.col("c.own").alias("bytes"))
    fetched = pieces.where("bytes is null").drop("bytes").join(store.shared, "digest").select("file", "seq", "bytes")
    joined = pieces.where("bytes is not null").select("file", "seq", "bytes").unionByName(fetched)
    ordered = joined.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "bytes"))).alias("own")).select("file", F.col("own.bytes").alias("own"))
    return alone.unionByName(ordered)


def media_features(docs: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """Store every text as chunked media, read it back, verify and describe it."""
    store = store_media(docs, p)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [_describe(f.as_py(), own.as_py()) for f, own in zip(part.column(0), part.column(1), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=_RESULT)

    told = read_media(store).mapInArrow(describe, _RESULT_DDL)
    return store.files.join(told, "file").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
