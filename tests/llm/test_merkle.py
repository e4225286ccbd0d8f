"""Merkle manifests against a tree built on the driver."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loamstat.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf string, `a.b` int"


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def build(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {t: build([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in order}
    top = build([built[t][-1][0] for t in order])
    out = []
    for place, t in enumerate(order):
        for i, (_, _, digest, r) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            now = leaf((r[0], r[1], r[2], r[3] + 1, r[4])) if changed else digest
            said = ""
            for levels, at in ((built[t], i), (top, place)):
                for nodes in levels[:-1]:
                    other = at ^ 1
                    if other < len(nodes):
                        said += nodes[other]
                        now = h(nodes[other], now) if at & 1 else h(now, nodes[other])
                    else:
                        now = h(now)
                    at >>= 1
            out.append((r[0], digest, built[t][-1][0], top[-1][0], h(said), now, now == top[-1][0]))
    return sorted(map(repr, out))


def verified(spark, rows, height):
    docs = spark.createDataFrame([(*r, "t", "l", 1) for r in rows], SCHEMA).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = mm.verify(mm.document_leaves(docs, tampered, ("n_chars", F.col("n_chars") + 1)), height=height)
    return sorted(repr(tuple(r)) for r in got.collect())


def sample(rng, n, langs):
    return [(rng.choice([i, i, i, None]) if i % 9 == 0 else i, rng.choice(["a", None, "ü:1"]), rng.choice(langs), rng.choice([3, 12, None]), rng.choice([None, "", "x" * rng.randint(0, 50), "größe:1"])) for i in range(n)]


@pytest.mark.parametrize(("n", "langs", "height"), [(130, ["en", "en", "en", None, "de", "", "é"], 2), (65, ["en"], 3), (33, ["en", None], 12), (1, [None], 2), (2, ["b", "a"], 1), (300, [f"l{i}" for i in range(40)], 1)])
def test_proofs_equal_brute_force(spark, n, langs, height):
    rows = sample(random.Random(n), n, langs)
    rows += rows[:3] * 2  # repeated rows
    assert verified(spark, rows, height) == brute(rows)


def test_a_hot_tree_of_equal_rows(spark):
    rows = [(5, "s", "en", 4, "same")] * 700 + [(i, "s", "en", 4, f"t{i}") for i in range(300)] + [(1, "s", "de", None, None)]
    assert verified(spark, rows, 4) == brute(rows)


def test_untouched_rows_verify_and_changed_ones_do_not(spark):
    rows = sample(random.Random(4), 120, ["en", "de"])
    docs = spark.createDataFrame([(*r, "t", "l", 1) for r in rows], SCHEMA)
    assert mm.verify(mm.document_leaves(docs), height=3).where("not verified").count() == 0
    long = docs.withColumn("text", F.when(F.col("doc_id") == 50, F.repeat(F.lit("long "), 2_000_000)).otherwise(F.col("text")))
    one = mm.verify(mm.document_leaves(long, F.col("doc_id") == 50, ("text", F.concat("text", F.lit(" ")))), height=3)
    assert [r.doc_id for r in one.where("not verified").collect()] == [50]


def test_empty_table(spark):
    assert mm.verify(mm.document_leaves(spark.createDataFrame([], SCHEMA))).count() == 0
