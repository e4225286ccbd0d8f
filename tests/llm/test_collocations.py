"""Counting quotient filters and collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstat.llm import collocations as co
from loamstat.llm import quotient_filter as qf


def keys(values: list[int]) -> qf.Keys:
    return qf.Keys(np.array([v >> 64 for v in values], np.uint64), np.array([v & (2**64 - 1) for v in values], np.uint64))


def numbers(k: qf.Keys) -> list[int]:
    return [(int(h) << 64) | int(x) for h, x in zip(k.high, k.low, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 128).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), min_size=1, max_size=60))), st.integers(0, 9))
def test_filters_are_lossless(drawn, block_bits):
    bits, values = drawn
    block_bits = min(block_bits, bits)
    k = keys(values)
    mixed = qf.permute(k, bits)
    assert numbers(qf.restore(mixed, bits)) == values
    assert len(set(numbers(mixed))) == len(set(values)) and max(numbers(mixed)) < 2**bits
    weight = np.array([1 + v % 600 for v in values], np.int64)
    distinct, n = qf.counted(mixed, weight)
    want = Counter()
    for v, c in zip(values, weight.tolist(), strict=True):
        want[v] += c
    assert dict(zip(numbers(qf.restore(distinct, bits)), n.tolist(), strict=True)) == want
    block = qf.blocks_of(distinct, bits, block_bits)
    for b in set(block.tolist()):
        own = np.flatnonzero(block == b)
        raw = qf.seal(distinct.take(own), n[own], bits, block_bits)
        read, counts = qf.unseal(raw)
        assert numbers(read) == numbers(distinct.take(own)) and counts.tolist() == n[own].tolist()
        for i in own[:5]:
            assert qf.count_in(raw, distinct.take(np.array([i]))) == n[i]
        twice = qf.merge([raw, raw, raw])
        assert numbers(qf.unseal(twice)[0]) == numbers(read) and qf.unseal(twice)[1].tolist() == (3 * n[own]).tolist()
    absent = qf.permute(keys([(values[0] + 1) % 2**bits]), bits)
    if numbers(absent)[0] not in numbers(distinct):
        assert qf.count_in(qf.seal(distinct.take(np.flatnonzero(block == block[0])), n[block == block[0]], bits, block_bits), absent) == 0


@pytest.mark.parametrize(("size", "bits"), [(1, 1), (2, 32), (3, 17), (4, 31), (4, 32), (3, 32)])
def test_packing(size, bits):
    rng = np.random.default_rng(size * bits)
    ids = [rng.integers(0, 2**bits, 50) for _ in range(size)]
    assert all((a == b).all() for a, b in zip(qf.unpack(qf.pack(ids, bits), size, bits), ids, strict=True))


def test_filters_are_compact():
    rng = np.random.default_rng(2)
    k, n = qf.counted(qf.permute(qf.pack([rng.integers(0, 1 << 17, 100_000) for _ in range(2)], 17), 34))
    assert len(qf.seal(k, n, 34, 0)) < 5 * len(n)  # a packed key and a counter alone take 4.25 + 1 bytes


def brute(rows, least, top):
    words, grams = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        f = grams.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in grams.items():
        rows = []
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        cover = Counter()
        for g, a in cand.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    cover[g[i : i + m]] = max(cover[g[i : i + m]], a)
        for g, a in cand.items():
            if 100 * cover[g] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, g, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


SCHEMA = "lang string, text string, word string, n int, `a.b` int"


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["new", "New", "york", "city", "of", "the", "ÄÖ", "東京", "a\x00b", "x-1", "\x0b", "rare"]
    rows = []
    for i in range(400):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(vocabulary[: 3 + i % 9] + ["new york city", "of the of the"]) + rng.choice([" ", " ", "\t", ". ", ",", "\n", "  "])
        rows.append((rng.choice(["en", "en", None, "und", "", "de"]), text))
    rows += [(None, None), ("en", ""), ("fr", "only once here"), ("en", " ".join(["la la"] * 3_000)), ("de", "zwei wörter, " * 4_000)]
    docs = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA).repartition(5)
    want = brute(rows, 7, 15)
    for slice_bytes, held, block_keys in ((co.SLICE, co.HELD_KEYS, co.BLOCK_KEYS), (900, 40, 50)):
        got = co.collocations(docs, least=7, top=15, slice_bytes=slice_bytes, held=held, block_keys=block_keys)
        assert sorted(map(tuple, got.collect())) == want
    assert any(" " in w[2] for w in want) and len(want) > 15


def test_a_hot_language_and_long_texts(spark):
    rows = [("en", "hot phrase here. " * 20_000)] + [("en", f"hot phrase u{i}") for i in range(500)] + [("de", "kalt")]
    got = co.collocations(spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA), slice_bytes=4_096, held=1_000, block_keys=64).collect()
    assert [tuple(r) for r in got] == brute(rows, 30, 2000)


def test_word_numbers_tell_clashing_digests_apart():
    from loamstat.llm.wordhash import Words

    z = np.zeros(5, np.int64)
    w = Words(z, z, z, np.array([7, 7, 7, 7, 8], np.uint64), np.array([1, 2, 1, 1, 1], np.uint64))
    first, number, n = co._distinct(w, np.array([0, 0, 1, 0, 0]))
    assert len(first) == 4 and number[0] == number[3] and len(set(number.tolist())) == 4 and sorted(n.tolist()) == [1, 1, 1, 2]


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert co.collocations(spark.createDataFrame([("en", "nothing repeats", "", 0, 0)], SCHEMA)).count() == 0


def test_work_tables_of_slices_have_small_row_groups(spark):
    """Spark reads a row group's rows at once: of slices of megabytes a task must not hold its whole share of the table."""
    rows = [(i, " ".join(f"w{(i * j) % 9}" for j in range(30)), "en") for i in range(60)]
    root = co.materialize(spark.createDataFrame([(0,)], "a int"), "probe").inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0].replace("//", "/")
    before = set(Path(root).iterdir())
    got = co.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), slice_bytes=64)
    assert got.count()
    for tag in ("slices", "sequences"):
        groups = [f.row_group(g).num_rows for d in set(Path(root).glob(f"{tag}-*")) - before for p in d.glob("*.parquet") for f in [pq.ParquetFile(p).metadata] for g in range(f.num_row_groups)]
        assert sum(groups) == 60 and max(groups) <= co.GROUP_SLICES
