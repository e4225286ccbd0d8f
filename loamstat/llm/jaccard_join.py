"""N-gram Jaccard self-join by a token-group matrix.

Documents become sets of word-shingle hashes.  Pairs with
``|A & B| / |A | B| >= num / den`` are linked and linked documents form
components.  The steps:

1. *Sets.*  Each document's shingles become 128-bit digests in its scan task,
   told apart by all their bits.  Equal sets share a 128-bit signature and are
   one node from here on, so exact copies, however many, cost one row each.
2. *Coarse tokens.*  If two sets of at most U shingles link, they differ in
   at most ``d = floor(2U (den-num) / (den+num))`` shingles.  The hash space
   is cut into more than ``d`` parts; a linked pair must agree on all
   shingles of one part at least.  The digest of a part is a coarse token.  U comes from
   size bands; a set also emits the tokens of all bands that a larger
   partner may lie in.  Agreement by chance needs a whole part to be equal, so words,
   lines or passages that many documents share make no hot token.
3. *Groups.*  Sets that share a coarse token with others take the smallest
   signature met there as group label: similar documents fall together.
   A label with much text is dealt into several groups of bounded volume.
4. *Inside groups.*  A task compares a group's sets: pivots first, each with all
   sets, so that a family of near copies becomes one tree by few comparisons;
   then only sets that may link outside their own tree.  The trees of a label
   that was dealt out meet by one representative each, dealt and compared in
   the same way, until nothing falls together any more.
5. *Token-group matrix.*  The union of coarse tokens of every group, one row
   per (token, group).  A query set meets a foreign group only if it shares as
   many coarse tokens with the union as it would with a linked set, counting
   only tokens that the group has from another component than the query's; each
   unordered pair of groups is met once.
6. *Open.*  A task gets a group's members and a block of its queries, builds
   the union of the members' shingles and keeps a query only if its overlap
   with the union reaches ``num / den`` of its size - the most any member
   could share.  Only groups with such a query are opened for those queries,
   and members and queries are compared exactly there; links come out as a
   spanning forest, never as all pairs.
7. *Components* of the forest edges, joined back to all documents.

Thresholds of 2/3 and more are meant; lower ones stay exact, but step 2 then
takes time and tokens with the square of a set's size.

Every bound is exact: no link is lost and no bucket is capped.  What takes
place of the words are 128-bit digests; 64-bit ones only find candidates.

Edge cases: null and word-less texts have no shingles, are linked with
nothing and are their own component; fewer words than the shingle length give
one shingle of the whole sequence; repeated rows are nodes of one set; a null
id never becomes a component id unless its component has no other id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstat.llm.common import bloom_build, bloom_has, connected_components, fresh, materialize, mix64, quoted, row_key, sieve, split_by_keys, text_slices
from loamstat.llm.wordhash import SPACED, Words, as_long, ngram_checks, ngrams, words

#: Shingles that one group, or one block of queries, holds at most (unless a
#: single set is larger): bounds a task's memory.
GROUP_VOLUME = 400_000

#: Shingles per range of the coarse-token count (about half as many tokens).
RANGE_TOKENS = 2_000_000

#: Coarse tokens that a scan task holds before it deals them out (8 bytes each).
HELD_TOKENS = 4_000_000

#: Probes between two reckonings of which sets may still link outside their tree.
PROBES = 256

_PART = np.uint64(0x8CB92BA72F3D8DD7)
_SIGN = np.uint64(0x2545F4914F6CDD1D)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


class Shingles(NamedTuple):
    """A set of shingles, ascending by its first lane: both 64-bit lanes of every shingle's digest."""

    hash: np.ndarray
    check: np.ndarray

    @property
    def size(self) -> int:
        return len(self.hash)


def _distinct(h: np.ndarray, c: np.ndarray) -> Shingles:
    """Distinct 128-bit shingles; sorted by the second lane too only where first lanes tie."""
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    tied = h[1:] == h[:-1]
    if (c[1:][tied] != c[:-1][tied]).any():
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        tied = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    keep = np.concatenate([np.ones(min(len(h), 1), bool), ~tied])
    return Shingles(h[keep], c[keep])


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int, kind: np.ndarray = SPACED) -> list[Shingles]:
    """The distinct shingles of every row of a slice."""
    w = words(data, offs, kind, checked=True)
    h, at = ngrams(w, n)
    c = ngram_checks(w, at, n)
    doc = w.doc[at]
    rows = len(offs) - 1
    counts = np.bincount(w.doc, minlength=rows) if len(w.doc) else np.zeros(rows, np.int64)
    cut = np.searchsorted(doc, np.arange(rows + 1))
    first = np.searchsorted(w.doc, np.arange(rows))
    out = []
    for r in range(rows):
        if counts[r] >= n:
            own = slice(cut[r], cut[r + 1])
            out.append(_distinct(h[own], c[own]))
        elif counts[r]:
            own = slice(first[r], first[r] + counts[r])
            few = Words(w.start[own], w.end[own], w.doc[own], w.hash[own], w.check[own])
            whole, start = ngrams(few, int(counts[r]))
            out.append(Shingles(whole, ngram_checks(few, start, int(counts[r]))))
        else:
            out.append(Shingles(np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    return out


def signature(s: Shingles) -> tuple[int, int]:
    """Order-free 128-bit digest of a set, as two longs."""
    joint = mix64(s.hash ^ _SIGN) + mix64(s.check ^ _PART)
    first = np.add.reduce(mix64(joint), dtype=np.uint64) + np.uint64(s.size)
    second = np.add.reduce(mix64(joint ^ _SECOND), dtype=np.uint64)
    return tuple(as_long(mix64(np.array([first, second], np.uint64))).tolist())


def node_of(mark: tuple[int, int], clashes: frozenset[int]) -> int:
    """The node of a set: the first half of its signature, or a mix of both halves if different sets share the first."""
    if mark[0] not in clashes:
        return mark[0]
    both = np.array(mark, np.int64).view(np.uint64)
    return int(as_long(mix64(mix64(both[:1]) ^ both[1:]))[0])


def size_bands(num: int, den: int, upto: int) -> list[int]:
    """Upper edges of the size bands, up to one that covers ``upto`` and its partners."""
    gap = den - num
    edge = (den + num - 1) // (2 * gap) if gap else upto  # d = 0 up to here: only equal sets link
    edges = [max(edge, 1)]
    while edges[-1] * num < upto * den:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return edges


def coarse_tokens(tokens: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """48-bit digests of the parts of one set, for its band and those of larger partners, and its need:
    how many of them a set that links with it shares at least.

    Digests that fall together by chance only make sets meet that then fail the exact comparison;
    where two of one set do, its need falls too.
    """
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.uint64), 1
    edges = size_bands(num, den, n)
    band = int(np.searchsorted(edges, n))
    # a pair meets in the band of its larger set
    bands = range(band, int(np.searchsorted(edges, n * den // num)) + 1)
    out, need = [], n
    mixed = mix64(tokens ^ _PART)
    for b in bands:
        differ = 2 * edges[b] * (den - num) // (den + num)
        if differ == 0:
            continue  # such pairs link only when equal, and equal sets are one node
        parts = differ + 1 + differ // 16
        place = (mixed % np.uint64(parts)).astype(np.int64)
        total = np.zeros(parts, np.uint64)
        np.add.at(total, place, mix64(mixed))
        filled = np.bincount(place, minlength=parts) > 0
        name = mix64(np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b + 1))
        full = mix64(total + name)
        out.append(full[filled])
        most = (n + min(n * den // num, edges[b])) * (den - num) // (den + num)
        # at most ``most`` of the filled parts can differ from a partner's
        need = min(need, max(1, int(filled.sum()) - most))
        if filled.sum() <= most:
            # all filled parts may differ, so the agreement may be on a part that is empty on both
            # sides (then both come here); it counts with a part of a second division
            again = mix64(mixed ^ _SECOND)
            second = np.zeros(parts, np.uint64)
            np.add.at(second, (again % np.uint64(parts)).astype(np.int64), mix64(again))
            for p in np.flatnonzero(~filled):
                out.append(mix64(mix64(second + name) ^ ~full[p]))
    if not out:
        return np.zeros(0, np.uint64), 1
    every = np.concatenate(out)
    some = np.unique(every >> np.uint64(16))
    return some, max(1, need - (len(every) - len(some)))


def _ragged(rows: list[np.ndarray]) -> pa.Array:
    offs = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offs[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(as_long(flat)))


def document_sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """One row per document: ``id, rowkey, n, sig, sig2``: set size and signature (null without shingles)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            sets = shingle_sets(data, offs, n)
            marks = [signature(s) if s.size else (None, None) for s in sets]
            columns = [pa.array(x, pa.int64()) for x in ([s.size for s in sets], [m[0] for m in marks], [m[1] for m in marks])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["id", "rowkey", "n", "sig", "sig2"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rowkey"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(scan, "id long, rowkey binary, n long, sig long, sig2 long")


def with_nodes(sets: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """``(id, rowkey, n, sig)`` with one ``sig`` for each 128-bit signature, and the first halves that
    different sets share.

    Among N sets some N^2 / 2^65 first halves fall together by chance: none
    below a billion sets, a handful at a hundred billion.
    """
    halves = sets.where("sig is not null").groupBy("sig").agg(F.min("sig2").alias("lo"), F.max("sig2").alias("hi"))
    clashes = frozenset(r["sig"] for r in halves.where("lo <> hi").select("sig").collect())
    if clashes:
        mixed = F.udf(lambda a, b: node_of((a, b), clashes), "long")  # for those few rows only
        sets = sets.withColumn("sig", F.when(F.col("sig").isin(list(clashes)), mixed("sig", "sig2")).otherwise(F.col("sig")))
    return sets.select("id", "rowkey", "n", "sig"), clashes


class OneEach(NamedTuple):
    """Documents with one row standing for all rows of an equal set: those of ``docs`` whose key is
    not in the filter ``skip``, and the rows of ``rest``.  Both have ``(rowkey, text)``."""

    docs: DataFrame
    skip: np.ndarray
    rest: DataFrame

    def scan(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        kept = sieve(self.skip, self.docs.sparkSession, 0, False)
        return self.docs.mapInArrow(lambda batches: run(kept(batches)), schema).unionByName(self.rest.mapInArrow(run, schema))


def one_each(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> OneEach:
    """Rows that a Bloom filter of the copies' keys holds back go through an exact join, once."""
    several = sets.where("sig is not null").groupBy("sig").agg(F.min("rowkey").alias("stays"), F.max("rowkey").alias("last")).where("stays < last")
    several = materialize(several, "several")  # a table of its own, so Spark can split the join at a hot set
    copies = materialize(sets.join(several, "sig").where("rowkey <> stays").select("rowkey").distinct(), "copies")
    keyed = docs.select(row_key(id_col, text_col).alias("rowkey"), F.col(text_col).cast("string").alias("text"))
    skip = bloom_build(copies)
    rest = keyed.mapInArrow(sieve(skip, docs.sparkSession, 0), "rowkey binary, text string").join(copies, "rowkey", "left_anti")
    return OneEach(keyed, skip, materialize(rest, "rest"))


def document_coarse(docs: OneEach, n: int, num: int, den: int, bloom: np.ndarray, clashes: frozenset[int]) -> DataFrame:
    """``(c, sig, need)``: the coarse tokens of every document that may be in a Bloom filter.

    Documents with fewer such tokens than their need link with nothing and are left out.
    """
    shared = docs.docs.sparkSession.sparkContext.broadcast(bloom)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for _, data, offs in text_slices(batches, "text"):
            sets = [s for s in shingle_sets(data, offs, n) if s.size]
            coarse, need = [], []
            for s in sets:
                c, least = coarse_tokens(s.hash, num, den)
                coarse.append(c)
                need.append(least)
            flat = np.concatenate(coarse) if coarse else np.zeros(0, np.uint64)
            keep = bloom_has(have, flat) if len(flat) else np.zeros(0, bool)
            cut = np.concatenate([[0], np.cumsum([len(c) for c in coarse])]).astype(np.int64)
            coarse = [flat[a:b][keep[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            used = [i for i, c in enumerate(coarse) if len(c) >= need[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(signature(sets[i]), clashes) for i in used], pa.int64()), pa.array([need[i] for i in used], pa.int64()), _ragged([coarse[i] for i in used])], ["sig", "need", "coarse"]
            )

    return docs.scan(scan, "sig long, need long, coarse array<long>").select(F.explode("coarse").alias("c"), "sig", "need")


def shared_coarse(docs: OneEach, n: int, num: int, den: int, ranges: int) -> DataFrame:
    """``(c)``: coarse tokens met more than once over all documents.

    A scan task deals its tokens, six bytes each, into ``ranges`` equal ranges of the token space
    (a power of two); one task per range counts them.  Tokens are digests, so ranges are even, and of
    one token at most two copies leave a task for every ``HELD_TOKENS`` it has made.
    """
    bits = ranges.bit_length() - 1

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        c = np.sort(np.concatenate(held))
        c = c[np.concatenate([np.ones(min(len(c), 2), bool), c[2:] != c[:-2]])]
        place = (c >> np.uint64(48 - bits)).astype(np.int64)
        cut = np.searchsorted(place, np.arange(ranges + 1))
        six = c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        used = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([six[cut[p] : cut[p + 1]].tobytes() for p in used], pa.binary())], ["range", "tokens"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0
        for _, data, offs in text_slices(batches, "text"):
            held += [coarse_tokens(s.hash, num, den)[0] for s in shingle_sets(data, offs, n)]
            have += sum(len(c) for c in held[1 - len(offs) :])
            if have >= HELD_TOKENS:
                yield dealt(held)
                held, have = [], 0
        if have:
            yield dealt(held)

    def count(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(x.as_py() for x in table.column("tokens")), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        c = np.sort(wide.view("<u8").ravel())
        again = c[1:][c[1:] == c[:-1]]
        return pa.table({"c": pa.array(np.unique(again).astype(np.int64))})

    return docs.scan(deal, "range int, tokens binary").groupBy("range").applyInArrow(count, "c long")


def _fetch_sets(docs: DataFrame, id_col: str, text_col: str, n: int, wanted: DataFrame, clashes: frozenset[int]) -> DataFrame:
    """``(sig, tokens, checks)`` of the wanted signatures, from the texts of one document each."""
    spark = docs.sparkSession
    kept = sieve(bloom_build(wanted.select("rowkey")), spark, 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in text_slices(kept(batches), "text"):
            sets = [s for s in shingle_sets(data, offs, n) if s.size]
            marks = pa.array([node_of(signature(s), clashes) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([marks, _ragged([s.hash for s in sets]), _ragged([s.check for s in sets])], ["sig", "tokens", "checks"])

    keyed = docs.select(row_key(id_col, text_col).alias("rowkey"), F.col(text_col).cast("string").alias("text"))
    found = keyed.mapInArrow(scan, "sig long, tokens array<long>, checks array<long>")
    return found.join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])


def _local_ids(tokens: list[np.ndarray], checks: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Numbers from 0 for the 128-bit shingles of a task, flat, and how many there are."""
    h, c = np.concatenate(tokens), np.concatenate(checks)
    order = np.argsort(h, kind="stable")
    tied = h[order][1:] == h[order][:-1]
    same = c[order][1:] == c[order][:-1]
    if not same[tied].all():
        order = np.lexsort((c, h))
        tied = h[order][1:] == h[order][:-1]
        same = c[order][1:] == c[order][:-1]
    number = np.concatenate([[0], np.cumsum(~(tied & same))])
    local = np.empty(len(h), np.int64)
    local[order] = number
    return local, int(number[-1]) + 1


class _Trees:
    """Union-find over the sets of a task."""

    def __init__(self, label: np.ndarray) -> None:
        _, first, place = np.unique(label, return_index=True, return_inverse=True)
        self.parent = first[place].tolist()

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))], np.int64)


class _Group:
    """Shingles of a task's sets, and which sets may still link with one of another tree."""

    def __init__(self, tokens: list[np.ndarray], checks: list[np.ndarray], num: int, den: int) -> None:
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.owner = np.repeat(np.arange(len(tokens)), self.size)
        self.local, self.shingles = _local_ids(tokens, checks)
        self.starts = np.concatenate([[0], np.cumsum(self.size)])
        self.num, self.den = num, den

    def enough(self, used: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Live sets with num/den of their shingles among the used places."""
        return alive & (np.bincount(self.owner[used], minlength=len(self.size)) * self.den >= self.size * self.num)

    def across(self, alive: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Live sets that have enough shingles that live sets of several trees hold, and the places of those shingles."""
        root = roots[self.owner]
        while True:
            live = alive[self.owner]
            lo, hi = np.full(self.shingles, len(self.size)), np.full(self.shingles, -1)
            np.minimum.at(lo, self.local[live], root[live])
            np.maximum.at(hi, self.local[live], root[live])
            used = live & (lo < hi)[self.local]
            nxt = self.enough(used, alive)
            if (nxt == alive).all():
                return alive, used
            alive = nxt

    def postings(self, used: np.ndarray) -> None:
        order = np.argsort(self.local[used], kind="stable")
        self.posting = self.owner[used][order]
        self.begins = np.searchsorted(self.local[used][order], np.arange(self.shingles + 1))

    def linked(self, x: int, allowed: np.ndarray) -> np.ndarray:
        """Sets that link with ``x``, of those allowed."""
        own = self.local[self.starts[x] : self.starts[x + 1]]
        lo, hi = self.begins[own], self.begins[own + 1]
        take = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
        common = np.bincount(self.posting[take], minlength=len(self.size))
        fits = common * (self.den + self.num) >= self.num * (self.size[x] + self.size)  # I/U >= num/den
        fits[x] = False
        return np.flatnonzero(fits & allowed)


def open_group(sigs: np.ndarray, tokens: list[np.ndarray], checks: list[np.ndarray], member: np.ndarray, inner: bool, num: int, den: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of one group's task that join trees, as a spanning forest.

    ``member`` marks the group's own sets, the others are queries and are
    compared with members.  Queries below the overlap bound are dropped before
    the group is opened.  ``inner`` also links members with members.  ``label``
    names the tree that a set is in already (by default each its own).

    Members are joined by pivots first: sets with the most common shingles, each
    compared with all.  Afterwards a set is compared only while it has enough
    shingles from other trees, and those of the largest tree not at all: every
    link between two trees has an end outside the largest.
    """
    if len(member) < 2:
        return []
    group = _Group(tokens, checks, num, den)
    trees = _Trees(np.arange(len(member)) if label is None else label)
    links: list[tuple[int, int]] = []

    def join(x: int, allowed: np.ndarray) -> np.ndarray:
        found = group.linked(x, allowed)
        for y in found.tolist():
            a, b = trees.root(x), trees.root(y)
            if a != b:
                trees.parent[a] = b
                links.append((int(sigs[x]), int(sigs[y])))
        return found

    union = np.zeros(group.shingles, bool)
    union[group.local[member[group.owner]]] = True
    alive = member | group.enough(union[group.local], np.ones(len(member), bool))
    alive, used = group.across(alive, trees.roots())
    done = ~alive | (member & (not inner))
    if inner and alive.any():
        group.postings(used)
        common = np.bincount(group.local[used], minlength=group.shingles)
        fame = np.bincount(group.owner[used], common[group.local[used]], len(member)) / np.maximum(group.size, 1)
        met = done | ~member
        for x in np.argsort(-fame, kind="stable").tolist():
            if not met[x]:
                met[join(x, alive & member)] = True
                met[x] = done[x] = True
    while True:
        roots = trees.roots()
        alive, used = group.across(alive, roots)
        left = alive & ~done
        if member.all() and left.any():
            left &= roots != np.bincount(roots[alive]).argmax()
        if not left.any():
            return links
        group.postings(used)
        trees_size = np.bincount(roots[alive], minlength=len(member))[roots]
        batch = np.flatnonzero(left)
        for x in batch[np.argsort(trees_size[batch], kind="stable")][:PROBES].tolist():
            join(x, alive & member)
            done[x] = True


def jaccard_components(
    docs: DataFrame,
    n: int = 5,
    num: int = 8,
    den: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_volume: int = GROUP_VOLUME,
) -> DataFrame:
    """Link documents whose n-word shingle sets have Jaccard >= num/den.

    Returns one row per input row: ``doc_id``, ``n_shingles`` (set size) and
    ``component_id`` (smallest id reachable by links, itself included).  See
    the module's docstring for the method and the edge cases.
    """
    labelled = _labelled(docs, n, num, den, id_col, text_col, group_volume)
    # written first, so that the join below is one that Spark can split at a hot component
    least = materialize(labelled.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least")), "least")
    return labelled.join(least, "comp", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
    )


def _labelled(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, group_volume: int) -> DataFrame:
    """``(id, rowkey, n, comp)`` of every row; ``comp`` is null without shingles."""
    sets, clashes = with_nodes(materialize(document_sets(docs, id_col, text_col, n), "sets"))
    comps = similar_components(docs, sets, clashes, n, num, den, id_col, text_col, group_volume)
    joined = sets.join(comps.withColumnRenamed("node", "sig"), "sig", "left")
    return joined.select("id", "rowkey", "n", F.coalesce("comp", "sig").alias("comp"))


def deduplicate(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", group_volume: int = GROUP_VOLUME) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the
    smallest id (null ids last).  Rows without shingles all stay.

    Only rows of components of two rows or more take part in a join.
    """
    labelled = materialize(_labelled(docs, n, num, den, id_col, text_col, group_volume), "labelled")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rowkey")
    several = labelled.where("comp is not null").groupBy("comp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = materialize(several.select("comp", F.col("first.rowkey").alias("kept")), "several")
    marks = materialize(labelled.join(several, "comp").groupBy("rowkey").agg(F.max(F.col("rowkey") == F.col("kept")).alias("stays")), "marks")
    sure, maybe, key = split_by_keys(docs, row_key(id_col, text_col), marks.select("rowkey"))
    (stays,) = fresh(maybe, "stays")
    told = maybe.join(marks.toDF(key, stays), key, "left")
    once = told.where(F.col(stays)).dropDuplicates([key])  # equal rows are one
    return sure.unionByName(told.where(F.col(stays).isNull()).select(*quoted(docs))).unionByName(once.select(*quoted(docs)))


def _needed(tokens: DataFrame) -> DataFrame:
    """Rows of the sets that still have as many shared tokens as they need."""
    enough = tokens.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.min("need").alias("least")).where("k >= least").select("sig")
    return tokens.join(enough, "sig", "left_semi")


def _dealt(level: DataFrame, group_volume: int) -> DataFrame:
    """Groups of bounded volume for rows ``(sig, n, rowkey, label)``; adds ``g``, ``weight`` and the label's number of ``groups``."""
    volume = level.groupBy("label").agg(F.sum("n").alias("total"))
    deal = F.ceil(F.col("total") / group_volume).cast("long")
    return level.join(volume, "label").select(
        "sig", "n", "rowkey", "label", F.xxhash64("label", F.pmod(F.xxhash64("sig", F.lit(7)), deal)).alias("g"), F.least("total", F.lit(group_volume)).alias("weight"), deal.alias("groups")
    )


def _opened(tasks: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` found by the tasks ``(sig, g, block, member, comp)``."""

    def verify(table: pa.Table) -> pa.Table:
        sig = table.column("sig").to_numpy()
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        member, comp = (table.column(c).to_numpy()[order] for c in ("member", "comp"))
        lanes = []
        for lane in ("tokens", "checks"):
            flat = table.column(lane).combine_chunks()
            values, offs = flat.values.to_numpy(), flat.offsets.to_numpy()
            lanes.append([values[offs[i] : offs[i + 1]] for i in order])
        links = open_group(sig, *lanes, member, bool(member.all()), num, den, comp)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    several = tasks.groupBy("g", "block").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g", "block")
    return tasks.join(several, ["g", "block"], "left_semi").join(texts, "sig").groupBy("g", "block").applyInArrow(verify, "a long, b long")


def _within_groups(label: DataFrame, texts: DataFrame, num: int, den: int, group_volume: int) -> tuple[DataFrame, DataFrame]:
    """The groups of the labelled sets, and the links inside them and between representatives of their trees (step 4)."""
    level, groups, links = label, None, None
    while True:
        dealt = materialize(_dealt(level, group_volume), "groups")
        groups = groups or dealt
        tasks = dealt.select("sig", "g", F.lit(0).cast("long").alias("block"), F.lit(True).alias("member"), F.col("sig").alias("comp"))
        found = materialize(_opened(tasks, texts, num, den), "links")
        links = found if links is None else links.unionByName(found)
        wide = dealt.where("groups > 1").select("sig", "n", "rowkey", "label")
        before = wide.count()
        if not before:
            return groups, links
        # one set of each tree goes on to the next round
        trees = connected_components(found.join(wide.select(F.col("sig").alias("a")), "a", "left_semi").select("a", "b"))
        level = materialize(wide.join(trees.where("node <> comp").select(F.col("node").alias("sig")), "sig", "left_anti"), "representatives")
        if level.count() == before:
            return groups, links


def similar_components(docs: DataFrame, sets: DataFrame, clashes: frozenset[int], n: int, num: int, den: int, id_col: str, text_col: str, group_volume: int) -> DataFrame:
    """``(node, comp)`` of the signatures that link with others (steps 2-7)."""
    unique = one_each(docs, sets, id_col, text_col)
    shingles = sets.agg(F.sum("n")).first()[0] or 0
    ranges = 1 << max(4, int(shingles // RANGE_TOKENS).bit_length())
    shared = materialize(shared_coarse(unique, n, num, den, ranges), "shared")
    # few tokens are shared: a filter keeps most others out of the exact join
    some = document_coarse(unique, n, num, den, bloom_build(shared), clashes)
    pairs = materialize(_needed(some.join(shared, "c").select("c", "sig", "need").distinct()), "pairs")
    ends = pairs.groupBy("c").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi").select("c", "lo")
    met = materialize(_needed(pairs.join(ends, "c")), "met")

    # groups of similar sets, of bounded volume
    sizes = sets.where("sig is not null").groupBy("sig").agg(F.min("n").alias("n"), F.min("rowkey").alias("rowkey"))
    label = materialize(met.groupBy("sig").agg(F.min("lo").alias("label")).join(sizes, "sig").select("sig", "n", "rowkey", "label"), "label")
    texts = materialize(_fetch_sets(docs, id_col, text_col, n, label.select("sig", "rowkey"), clashes), "shingles")
    grouped, links = _within_groups(label, texts, num, den, group_volume)
    comps = materialize(connected_components(links), "comps")

    # the token-group matrix, and the foreign groups each query meets there
    told = materialize(grouped.join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "n", "g", "weight", F.coalesce("comp", "sig").alias("comp")), "told")
    placed = met.select("c", "sig", "need").join(told.drop("n"), "sig")
    matrix = placed.groupBy("c", "g").agg(F.max("weight").alias("weight"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    query = placed.select("c", "sig", "need", "comp", F.col("g").alias("own"), F.col("weight").alias("own_weight"))
    meets = (
        query.join(matrix, "c")
        .where("own <> g and (own_weight < weight or (own_weight = weight and own < g)) and (lo <> comp or hi <> comp)")
        .groupBy("sig", "g")
        .agg(F.count(F.lit(1)).alias("overlap"), F.min("need").alias("need"))
        .where("overlap >= need")
        .select("sig", "g")
    )
    meets = materialize(meets.join(told.select("sig", "n", "comp"), "sig"), "meets")
    if not meets.limit(1).count():
        return comps
    load = meets.groupBy("g").agg(F.sum("n").alias("load"))
    blocks = F.ceil(F.col("load") / group_volume).cast("long")
    asked = meets.join(load, "g").select("sig", "g", F.pmod(F.xxhash64("sig", F.lit(11)), blocks).alias("block"), F.lit(False).alias("member"), "comp")
    own = told.join(load, "g").select("sig", "g", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(True).alias("member"), "comp")
    foreign = materialize(_opened(asked.unionByName(own), texts, num, den), "foreign")
    if not foreign.limit(1).count():
        return comps
    return connected_components(foreign.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
