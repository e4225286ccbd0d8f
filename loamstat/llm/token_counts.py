"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole, so its tokens are those a trainer
sees.  Token byte lengths give each token's span, mapped to characters.  The
spans of all documents of a slice are interval-joined with all their sections
at once, both sides sorted.  A token inside one section counts there.  A
token across a boundary is allocated by an explicit rule:

* ``start`` / ``end``: to the section of its first / last character;
* ``majority``: to the section with most of its characters, the earlier on ties;
* ``split``: to all, in proportion to their characters.

Characters outside all sections belong to the section ``None`` (null).

Sections are a table ``(doc_id, section, lo, hi)`` of character ranges, or by
default each text's first line, last line and the lines between.  A document's
sections must not overlap; what reaches beyond the text is cut off.

The vocabulary file (fixed size) is read by the driver and broadcast; the
encoder is ``tiktoken``.

Edge cases: null and empty texts give no rows unless a section table names
sections for them; repeated rows are counted each; a token that holds part of
a character counts as touching it; null ids meet the sections of null ids; very
long texts are encoded whole, also runs of millions of spaces; an empty table
gives no rows; of clashing columns, ``sections`` is replaced by
``with_sections`` and the others are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstat.llm.common import text_slices

#: Where the vocabulary lies on the driver; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of white space (as the pattern's ``\s`` has it) that are cut out before the pattern is applied.
_LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")

RULES = ("start", "end", "majority", "split")

_encoders: dict[int, tuple] = {}


_SECTIONS = "array<struct<lo:bigint,hi:bigint,section:string>>"


def line_sections(text: Column) -> Column:
    """First line (``head``), lines between (``body``), last line (``tail``), each with its line feed; empty ones left out."""
    length = F.length(text).cast("long")
    first = F.locate("\n", text).cast("long")
    back = F.locate("\n", F.reverse(F.substr(text, F.lit(1), (length - 1).cast("int")))).cast("long")
    last = F.when(back > 0, length - back).otherwise(F.lit(0))
    part = lambda name, lo, hi: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(name).alias("section"))
    end = F.greatest(first, last)
    some = F.array(part("head", F.lit(0), F.when(first > 0, first).otherwise(length)), part("body", first, F.when(first > 0, end).otherwise(first)), part("tail", F.when(first > 0, end).otherwise(length), length))
    return F.filter(some, lambda s: s["lo"] < s["hi"]).cast(_SECTIONS)


def _encoder(vocabulary: bytes) -> tuple:
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            sizes[rank] = len(piece)
        _encoders.clear()
        _encoders[key] = (tiktoken.Encoding("offset-mapped", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _encoders[key]


def _encoded(text: str, encoder) -> Iterator[list[int]]:  # noqa: ANN001
    """Ids of a text in runs, cut where the pattern itself cuts long white space: it backtracks over such a
    run and overflows its stack.  All of a run but its last character (all of it at the text's end) is one piece.
    """
    at = 0
    for run in _LONG_SPACE.finditer(text):
        to = run.end() - (run.end() < len(text))
        yield encoder.encode_ordinary(text[at : run.start()])
        yield encoder._encode_single_piece(text[run.start() : to])
        at = to
    yield encoder.encode_ordinary(text[at:])


def token_spans(text: str, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [from, to) of the tokens of a text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    encoder, sizes = _encoder(vocabulary)
    ids = np.concatenate([np.asarray(one, np.int64) for one in _encoded(text, encoder)])
    end = np.cumsum(sizes[ids])
    start = end - sizes[ids]
    raw = np.frombuffer(text.encode(), np.uint8)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    # the character that byte b belongs to is lead[b + 1] - 1
    return lead[start + 1] - 1, lead[end]


def allocate(start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which token gives which section (-1: outside all) how much; spans and sections are sorted, sections disjoint."""

    def holder(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(lo, at, "right") - 1
        return np.where((k >= 0) & (at < np.append(hi, 0)[k]), k, -1)

    first, last = holder(start), holder(end - 1)
    one = first == last
    # both ends outside: a section may still lie between
    one &= (first >= 0) | (np.searchsorted(lo, start) == np.searchsorted(lo, end))
    whole = np.ones(len(start), bool) if rule in ("start", "end") else one
    token = [np.flatnonzero(whole)]
    section, share = [(last if rule == "end" else first)[whole]], [np.ones(whole.sum())]
    for i in np.flatnonzero(~whole):
        k = np.arange(np.searchsorted(hi, start[i], "right"), np.searchsorted(lo, end[i], "left"))
        own = np.minimum(hi[k], end[i]) - np.maximum(lo[k], start[i])
        k, own = np.append(k, -1), np.append(own, end[i] - start[i] - own.sum())
        if rule == "majority":
            k, own = k[[own.argmax()]], np.ones(1)
        keep = own > 0
        token.append(np.full(keep.sum(), i))
        section.append(k[keep])
        share.append(own[keep] / own.sum())
    return np.concatenate(token), np.concatenate(section), np.concatenate(share)


def attribute(start: np.ndarray, end: np.ndarray, sections: list[tuple[str, int, int]], rule: str) -> dict[str | None, float]:
    """Tokens per section name of one text."""
    lo, hi = np.array([s[1] for s in sections], np.int64), np.array([s[2] for s in sections], np.int64)
    out: dict[str | None, float] = {s[0]: 0.0 for s in sections}
    _, section, share = allocate(start, end, lo, hi, rule)
    for k, amount in zip(section, share, strict=True):
        name = sections[k][0] if k >= 0 else None
        out[name] = out.get(name, 0.0) + float(amount)
    return out


def with_sections(docs: DataFrame, sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``sections`` from a table ``(doc_id, section, lo, hi)``; one array a document."""
    entry = F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("section").cast("string").alias("section"))
    per = sections.groupBy(F.col("doc_id").alias("__doc")).agg(F.array_sort(F.collect_list(entry)).alias("sections"))
    joined = docs.alias("d").join(per.alias("s"), F.col(f"d.{id_col}").eqNullSafe(F.col("s.__doc")), "left")
    kept = [F.col("d.`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() != "sections"]
    return joined.select(*kept, F.coalesce("s.sections", F.array().cast(_SECTIONS)).alias("sections"))


def token_attribution(docs: DataFrame, sections: DataFrame | None = None, rule: str = "majority", vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, section, n_chars, n_tokens, split_tokens``, a row per document and section.

    ``n_tokens`` follows ``rule``; ``split_tokens`` always shares boundary
    tokens in proportion.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in text_slices(batches, "text"):
            texts = part.column(1).to_pylist()
            size = np.array([len(t) for t in texts], np.int64)
            base = np.concatenate([[0], np.cumsum(size)])  # where each text begins among all characters of the slice
            spans = [token_spans(t, shared.value) for t in texts]
            start = np.concatenate([s + b for (s, _), b in zip(spans, base, strict=False)])
            end = np.concatenate([e + b for (_, e), b in zip(spans, base, strict=False)])
            doc = np.repeat(np.arange(len(texts)), [len(s) for s, _ in spans])
            found = part.column(2)
            held = np.repeat(np.arange(len(texts)), found.value_lengths().to_numpy(zero_copy_only=False))
            flat = found.flatten()
            lo, hi = (base[held] + np.clip(flat.field(n).to_numpy(), 0, size[held]) for n in ("lo", "hi"))
            if (lo[1:] < hi[:-1]).any() or (lo > hi).any():
                raise ValueError("sections of a document overlap or end before they start")
            rows: dict[tuple[int, str | None], list[float]] = {}
            for d, name, n in zip(held.tolist(), flat.field("section").to_pylist(), (hi - lo).tolist(), strict=True):
                rows.setdefault((d, name), [0, 0.0, 0.0])[0] += n
            outside = size - np.bincount(held, hi - lo, len(texts)).astype(np.int64)
            names = flat.field("section").to_pylist()
            for place, how in ((1, rule), (2, "split")):
                token, section, share = allocate(start, end, lo, hi, how)
                inner = section >= 0
                for k, amount in enumerate(np.bincount(section[inner], share[inner], len(names)).tolist()):
                    rows[int(held[k]), names[k]][place] += amount
                rest = np.bincount(doc[token[~inner]], share[~inner], len(texts))
                for d in np.flatnonzero(rest):
                    rows.setdefault((int(d), None), [int(outside[d]), 0.0, 0.0])[place] += float(rest[d])
            keys = sorted(rows, key=lambda k: k[0])
            columns = list(zip(*[rows[k] for k in keys], strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array([k[0] for k in keys], pa.int64())), pa.array([k[1] for k in keys], pa.string()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())],
                ["doc_id", "section", "n_chars", "n_tokens", "split_tokens"],
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if sections is None:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("sections", line_sections(F.col("text")))
    else:
        source = with_sections(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")), sections)
    return source.mapInArrow(scan, "doc_id long, section string, n_chars long, n_tokens double, split_tokens double")
