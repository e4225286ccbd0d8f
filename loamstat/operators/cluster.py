"""Iterative clustering of rows with an array column ``v`` and an integer key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstat.functions import blocks
from loamstat.functions.work import materialize
from loamstat.operators.factor import cross_products, signed
from loamstat.operators.stats import nmi

DISTANCES = ("euclid", "manhattan", "matching", "cosine")


def _assign(df: DataFrame, centres: list[tuple[int, list[float]]], dist: str):  # noqa: ANN202
    """Adds ``cluster`` and ``distance``: the nearest centre (k x d numbers, in the plan), ties to the lowest id."""
    terms = {
        "euclid": lambda a, b: (a - b) * (a - b),
        "manhattan": lambda a, b: F.abs(a - b),
        "matching": lambda a, b: F.when(a == b, 0.0).otherwise(1.0),
        "cosine": lambda a, b: a * b,
    }[dist]
    ids = F.array(*[F.struct(F.lit(i).cast("int").alias("id"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for i, c in centres])
    total = lambda c: F.aggregate(F.zip_with("v", c, terms), F.lit(0.0), lambda s, x: s + x)
    final = {"euclid": F.sqrt, "cosine": lambda x: 1 - x}.get(dist, lambda x: x)
    best = F.array_min(F.transform(ids, lambda e: F.struct(final(total(e["c"])).alias("d"), e["id"].alias("id"))))
    return df.withColumn("__best", best).withColumns({"cluster": F.col("__best.id"), "distance": F.col("__best.d")}).drop("__best")


def _centres(assigned: DataFrame, rep: str) -> list[tuple[int, list[float]]]:
    """New centres: one row per (cluster, dimension) from a grouped aggregate."""
    each = assigned.select("cluster", F.posexplode("v").alias("dim", "x"))
    if rep == "mode":
        counts = each.groupBy("cluster", "dim", "x").agg(F.count(F.lit(1)).alias("n"))
        one = counts.groupBy("cluster", "dim").agg(F.min(F.struct((-F.col("n")).alias("n"), "x"))["x"].alias("c"))
    else:
        one = each.groupBy("cluster", "dim").agg((F.avg("x") if rep == "mean" else F.percentile("x", F.lit(0.5))).alias("c"))
    got = one.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("s")).select("cluster", F.col("s.c").alias("c"))
    return sorted((r["cluster"], list(r["c"])) for r in got.collect())  # k centres of d numbers


def first_centres(df: DataFrame, k: int, key: str, seed: int | None = None) -> list[tuple[int, list[float]]]:
    """k rows as starting centres: the first by key, or by a seeded hash of it."""
    order = F.col(key) if seed is None else F.xxhash64(key, F.lit(seed))
    return [(i, list(r["v"])) for i, r in enumerate(df.orderBy(order, key).limit(k).select("v").collect())]


def k_representatives(df: DataFrame, k: int, init: list[tuple[int, list[float]]] | None = None, dist: str = "euclid", rep: str = "mean", n_iter: int = 10, key: str = "vec_id") -> tuple[DataFrame, list]:
    """Lloyd's loop with a chosen distance and centre (mean, median or mode); stops when centres stay.

    Empty clusters are dropped.  Returns rows with ``cluster`` and ``distance``, and the centres.
    """
    centres = init or first_centres(df, k, key)
    for _ in range(n_iter):
        new = _centres(_assign(df, centres, dist), rep)
        same = len(new) == len(centres) and all(np.allclose(a[1], b[1]) for a, b in zip(new, centres, strict=True))
        centres = new
        if same:
            break
    return _assign(df, centres, dist), centres


def unit_rows(df: DataFrame) -> DataFrame:
    """Vectors scaled to unit length; zero vectors stay."""
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    # the norm is bound to a variable, so it is computed once a row
    return df.withColumn("v", F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform("v", lambda x: x / n)).otherwise(F.col("v")))[0])


def spherical_kmeans(df: DataFrame, k: int, init: list[tuple[int, list[float]]] | None = None, n_iter: int = 10, empty: str = "drop", redraw_after: int = 1, key: str = "vec_id", seed: int = 1) -> tuple[DataFrame, list]:
    """K-means on unit vectors by cosine.  Empty clusters are dropped (``drop``), keep their
    centre (``keep``) or, empty ``redraw_after`` rounds in a row, take a keyed row (``redraw``)."""
    unit = materialize(unit_rows(df), "unit")
    centres = init or first_centres(unit, k, key, seed)
    idle: dict[int, int] = {}
    for r in range(n_iter):
        got = dict(_centres(_assign(unit, centres, "cosine"), "mean"))
        new = []
        for i, c in centres:
            if i in got:
                n = np.linalg.norm(got[i])
                new.append((i, list(np.asarray(got[i]) / (n or 1.0))))
                idle[i] = 0
            elif empty != "drop":
                idle[i] = idle.get(i, 0) + 1
                if empty == "redraw" and idle[i] >= redraw_after:
                    c, idle[i] = first_centres(unit, 1, key, seed + 1000 * (r + 1) + i)[0][1], 0
                new.append((i, c))
        centres = new
    return _assign(unit, centres, "cosine"), centres


def kmeans_objective(assigned: DataFrame) -> DataFrame:
    """Mean squared distance to the own centre."""
    return assigned.agg(F.avg(F.col("distance") ** 2).alias("objective"))


def kmeans_repeats(df: DataFrame, k: int, seeds: list[int], truth: str, n_iter: int = 20) -> tuple[float, float]:
    """Best and mean normalised mutual information of ``ml.KMeans`` over several seeds; the input is written once."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = materialize(df.select(F.col(truth).alias("truth"), F.col("v").cast("array<double>").alias("v")), "points")
    points = rows.select("truth", array_to_vector("v").alias("features"))
    scores = []
    for s in seeds:
        model = KMeans(k=k, seed=s, maxIter=n_iter).fit(points)
        scores.append(nmi(model.transform(points), "truth", "prediction").first()["nmi"])
    return max(scores), float(np.mean(scores))


def keyed_rows(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``(node, v)``: n rows by a seeded hash of their key, as a work table."""
    first = df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
    return materialize(first.select(F.col(key).cast("long").alias("node"), F.col("v").cast("array<double>").alias("v")), "sample")


def buckshot_init(df: DataFrame, k: int, seed: int = 1, key: str = "vec_id", sample: int | None = None) -> list[tuple[int, list[float]]]:
    """sqrt(k N) keyed rows, average-linkage groups of them, one member per group as centre.

    The sample's k N distances are rows, and the groups are made in rounds on Spark; the driver
    gets the k members that become centres.
    """
    n = max(sample or int(np.sqrt(k * df.count())), k)
    drawn = keyed_rows(df, n, key, seed)
    groups = average_linkage(_pair_distances(drawn), drawn.select("node"), k)
    members = drawn.join(groups, "node").groupBy("cluster").agg(F.min_by("v", "node").alias("v")).orderBy("cluster")
    return [(i, list(r["v"])) for i, r in enumerate(members.collect())]


def _pair_distances(rows: DataFrame, block: int = 500) -> DataFrame:
    """``(i, j, distance)``, i < j, of all pairs of ``(node, v)``, block by block."""
    parts = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    placed = dealt.withColumns({"bi": F.least("b", "o"), "bj": F.greatest("b", "o")})

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = pdf.bi.iloc[0], pdf.bj.iloc[0]
        a, b = (pdf[pdf.b == c].sort_values("node") for c in (bi, bj))
        if a.empty or b.empty:
            return pd.DataFrame({"i": [], "j": [], "distance": []}).astype({"i": "int64", "j": "int64", "distance": "float64"})
        u, v = np.stack(a.v.to_numpy()), np.stack(b.v.to_numpy())
        d = np.sqrt(np.maximum((u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * u @ v.T, 0))
        na, nb = a.node.to_numpy(), b.node.to_numpy()
        x, y = np.nonzero(na[:, None] < nb[None, :] if bi == bj else np.ones(d.shape, bool))
        return pd.DataFrame({"i": np.minimum(na[x], nb[y]), "j": np.maximum(na[x], nb[y]), "distance": d[x, y]})

    return placed.drop("o").groupBy("bi", "bj").applyInPandas(pairs, "i long, j long, distance double")


def average_linkage(pairs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``(node, cluster)``: average-linkage groups of all ``nodes``, cut at k, from all pairs ``(i, j, distance)``.

    Every round merges all pairs of clusters that are each other's nearest; merging such pairs in any order gives the
    same tree, since no average falls by a merge.  Clusters carry their sizes, pairs the sums of their
    distances.  The lowest merges are those of the cut; a cluster is named by its smallest node.
    """
    from loamstat.operators.correlate import components

    total = nodes.count()
    sizes = nodes.select("node", F.lit(1).cast("long").alias("size"))
    now = materialize(pairs.select("i", "j", F.col("distance").alias("sum")), "sums")
    merges = None
    while True:
        mean = now.join(sizes.toDF("i", "ni"), "i").join(sizes.toDF("j", "nj"), "j").select("i", "j", (F.col("sum") / (F.col("ni") * F.col("nj"))).alias("height"))
        both = mean.unionByName(mean.select(F.col("j").alias("i"), F.col("i").alias("j"), "height"))
        near = both.groupBy("i").agg(F.min(F.struct("height", "j")).alias("n")).select("i", F.col("n.j").alias("near"), F.col("n.height").alias("height"))
        back = near.select(F.col("i").alias("near"), F.col("near").alias("back"))
        found = materialize(near.join(back, "near").where("back = i and i < near").select(F.col("near").alias("old"), F.col("i").alias("new"), "height"), "merges")
        if not found.limit(1).count():
            break
        merges = found if merges is None else merges.unionByName(found)
        moved = found.select("old", "new")
        to = lambda c: moved.toDF(c, f"n{c}")
        sizes = materialize(sizes.join(to("node"), "node", "left").groupBy(F.coalesce("nnode", "node").alias("node")).agg(F.sum("size").alias("size")), "sizes")
        placed = now.join(to("i"), "i", "left").join(to("j"), "j", "left").select(F.coalesce("ni", "i").alias("i"), F.coalesce("nj", "j").alias("j"), "sum").where("i <> j")
        now = materialize(placed.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "sum").groupBy("i", "j").agg(F.sum("sum").alias("sum")), "sums")
    alone = nodes.select("node", F.col("node").alias("cluster"))
    if merges is None or total <= k:
        return alone
    cut = materialize(merges.orderBy("height", "new", "old").limit(total - k).select(F.col("new").alias("i"), F.col("old").alias("j")), "cut")
    named = components(cut)
    return alone.drop("cluster").join(named, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def average_groups(x: np.ndarray, k: int) -> np.ndarray:
    """Average-linkage groups of the rows, cut at k; a group is named by its first row."""
    n = len(x)
    square = (x * x).sum(1)
    d = x @ x.T
    d *= -2
    d += square[:, None]
    d += square[None, :]
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        u = chain[-1]
        v = int(np.argmin(d[u]))
        if len(chain) > 1 and d[u, chain[-2]] <= d[u, v]:
            v = chain[-2]
        if len(chain) < 2 or v != chain[-2]:
            chain.append(v)
            continue
        del chain[-2:]
        u, v = sorted((u, v))
        merges.append((float(d[u, v]), u, v))
        merged = (d[u] * size[u] + d[v] * size[v]) / (size[u] + size[v])
        merged[[u, v]] = np.inf
        d[u, :] = d[:, u] = merged
        d[v, :] = d[:, v] = np.inf
        size[u] += size[v]
        alive[v] = False
    # heights never fall towards the root, so the lowest merges are those of the cut
    owner = np.arange(n)
    for _, u, v in sorted(merges, key=lambda m: m[0])[: max(n - k, 0)]:
        owner[owner == owner[v]] = owner[u]
    return owner


def noisy_vq(df: DataFrame, k: int, delta: float, repeat: int = 0, key: str = "vec_id", seed: int = 1, recall: float | None = None) -> DataFrame:
    """Every row plus keyed noise is replaced by the mean of its k nearest rows; ``(key, v)``.

    ``repeat`` further rounds quantise the means of the round before in the same way.  With ``recall`` the
    neighbours come from the two-level index at that recall, without from all rows.
    """

    now = df.select(key, F.col("v").cast("array<double>").alias("v"))
    for r in range(repeat + 1):

        def noisy(pdfs, r: int = r):  # noqa: ANN001, ANN202
            for pdf in pdfs:
                moved = [np.asarray(v) + delta * np.random.Generator(np.random.PCG64([seed, r, abs(int(name))])).normal(size=len(v)) for name, v in zip(pdf[key], pdf.v, strict=True)]
                yield pd.DataFrame({key: -pdf[key] - 1, "v": moved})  # names that no row has: a query's own row may be near it

        near = _neighbours(now.mapInPandas(noisy, f"{key} long, v array<double>"), now, k, "euclid", key, recall)
        each = near.join(now.select(F.col(key).alias("neighbour"), F.posexplode("v").alias("dim", "x")), "neighbour")
        mean = each.groupBy("key", "dim").agg(F.avg("x").alias("x")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("s"))
        now = materialize(mean.select((-F.col("key") - 1).alias(key), F.col("s.x").alias("v")), "quantised")
    return now


def quantised_labels(labels: DataFrame, cells: DataFrame, label: str, key: str = "vec_id", cell: str = "cluster") -> DataFrame:
    """``(cell, label)``: the majority label of the rows in each cell of a quantisation; ties to the smaller label."""
    votes = labels.select(key, label).join(cells.select(key, cell), key).groupBy(cell, label).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(cell).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l")))["l"].alias(label))


def _neighbours(x: DataFrame, y: DataFrame, k: int, metric: str, key: str, recall: float | None) -> DataFrame:
    from loamstat.operators.joins import knn, knn_two_level

    return knn(x, y, k, metric, key, "v") if recall is None else knn_two_level(x, y, k, None, metric, key, "v", recall=recall)


def similarity_graph(df: DataFrame, metric: str = "rbf", gamma: float = 1.0, k: int = 10, key: str = "vec_id", recall: float | None = None) -> DataFrame:
    """Symmetric k-nearest-neighbour edges ``(i, j, weight)``: rbf, laplacian or cosine similarity.

    With ``recall`` the neighbours come from the two-level index at that recall, without from all rows.  The
    edges are a work table, since what follows reads them several times.
    """
    near = _neighbours(df, df, k, "cosine" if metric == "cosine" else "euclid", key, recall)
    d = F.col("distance")
    weight = {"rbf": F.exp(-gamma * d * d), "laplacian": F.exp(-gamma * d), "cosine": 1 - d}[metric]
    one = near.select(F.least("key", "neighbour").alias("i"), F.greatest("key", "neighbour").alias("j"), weight.alias("weight"))
    return materialize(one.groupBy("i", "j").agg(F.max("weight").alias("weight")), "graph")


def laplacian(edges: DataFrame, kind: str = "sym") -> DataFrame:
    """Entries (i, j, value) of the plain, ``rw`` or ``sym`` graph Laplacian, both triangles and the diagonal."""
    both = edges.union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
    degree = both.groupBy("i").agg(F.sum("weight").alias("d"))
    out = both.join(degree, "i").join(degree.toDF("j", "dj"), "j")
    value = {"plain": -F.col("weight"), "rw": -F.col("weight") / F.col("d"), "sym": -F.col("weight") / F.sqrt(F.col("d") * F.col("dj"))}[kind]
    diagonal = degree.select("i", F.col("i").alias("j"), (F.col("d") if kind == "plain" else F.lit(1.0)).alias("value"))
    return out.select("i", "j", value.alias("value")).union(diagonal)


def spectral_embedding(edges: DataFrame, k: int, n_iter: int = 30, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """``(id, v)``, the nodes' places in the ``k`` leading eigenvectors of I + D^-1/2 W D^-1/2, and the
    eigenvalues (of W's normalised form, descending).

    Block power iteration: a round is one join of the edges with the nodes' k numbers, a grouped sum and a
    k x k cross-product that the driver factors.  The constant direction comes first.
    """
    both = edges.union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
    degree = both.groupBy("i").agg(F.sum("weight").alias("d"))
    joined = both.join(degree, "i").join(degree.toDF("j", "dj"), "j")
    walk = materialize(joined.select("i", "j", (F.col("weight") / F.sqrt(F.col("d") * F.col("dj"))).alias("w")), "walk")
    names = [f"x{c}" for c in range(k)]
    start = lambda c: (F.pmod(F.xxhash64("i", F.lit(seed), F.lit(c)), F.lit(1 << 40)) + 0.5) / float(1 << 39) - 1
    now = degree.select(F.col("i").alias("id"), *[F.sqrt("d").alias(names[0]) if c == 0 else start(c).alias(n) for c, n in enumerate(names)])
    values = np.zeros(k)

    def turned(df: DataFrame, m: np.ndarray) -> DataFrame:
        return df.select("id", *[sum((F.col(a) * float(m[r, c]) for r, a in enumerate(names)), F.lit(0.0)).alias(n) for c, n in enumerate(names)])

    def gram(df: DataFrame) -> np.ndarray:
        return cross_products(df, F.array(*names))[0][2]

    def stepped(df: DataFrame) -> DataFrame:
        pulled = walk.join(df.withColumnRenamed("id", "j"), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])
        both = pulled.withColumnRenamed("i", "id").union(df)  # I + W
        return both.groupBy("id").agg(*[F.sum(n).alias(n) for n in names])

    for _ in range(n_iter):
        new = materialize(stepped(now), "power")
        now = turned(new, np.linalg.inv(np.linalg.cholesky(gram(new))).T)
    # Rayleigh-Ritz: the eigenvectors inside the block
    now = materialize(now, "power")
    pulled = stepped(now).toDF("id", *[f"y{c}" for c in range(k)]).join(now, "id")
    both = cross_products(pulled, F.array(*names, *[f"y{c}" for c in range(k)]))[0][2]
    cross = both[:k, k:]
    values, vectors = np.linalg.eigh((cross + cross.T) / 2)
    order = np.argsort(values)[::-1]
    return turned(now, signed(vectors[:, order])).select("id", F.array(*names).alias("v")), values[order] - 1


def spectral_clusters(edges: DataFrame, k: int, n_iter: int = 20) -> DataFrame:
    """``(id, cluster)`` by power iteration on the normalised similarity graph."""
    from pyspark.ml.clustering import PowerIterationClustering

    return PowerIterationClustering(k=k, maxIter=n_iter, initMode="degree", weightCol="weight").assignClusters(edges.select(F.col("i").alias("src"), F.col("j").alias("dst"), "weight"))


def class_distances(df: DataFrame, label: str, bins: int, hi: float, key: str = "vec_id", block: int | None = None) -> DataFrame:
    """Histogram of pair distances within and between classes: ``(within, bin, n)``.

    Pairs are met block by block and counted in the task, tile by tile: no pair leaves it.
    """

    def count(first: pa.Table, second: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        ka, u = first.column("k").to_numpy(), blocks.matrix(first)
        kb, v = (ka, u) if same else (second.column("k").to_numpy(), blocks.matrix(second))
        codes = pd.factorize(pd.concat([first.column("label").to_pandas(), second.column("label").to_pandas()]))[0]
        la, lb = codes[: len(ka)], codes[len(ka) :]
        la = np.where(la < 0, -2, la)  # a row without a label is in no class
        uu, vv, double = (u * u).sum(1), (v * v).sum(1), -2 * v
        n = np.zeros(2 * bins, np.int64)
        for x, y in blocks.tiles(len(ka), len(kb), same):
            d = uu[x, None] + vv[None, y]
            d += u[x] @ double[y].T
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            d /= hi
            d *= bins
            slot = np.minimum(d.astype(np.int64), bins - 1)
            slot += (la[x, None] == lb[None, y]) * np.int64(bins)
            n += np.bincount(slot[ka[x, None] < kb[None, y]] if same else slot.ravel(), minlength=2 * bins)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at >= bins), pa.array((at % bins).astype(np.int32)), pa.array(n[at])], names=["within", "bin", "n"])

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(label).alias("label"), F.col("v").cast("array<double>").alias("v"))
    return blocks.met_in_blocks(rows, count, "within boolean, bin int, n long", block=block).groupBy("within", "bin").agg(F.sum("n").alias("n"))
