"""Near-duplicate embeddings by lattice hashing.

In each of `TABLES` tables a vector of unit length is projected to 8 random directions, shifted, and decoded to the
nearest point of the E8 lattice: that is its home cell. It also visits the `PROBES` neighbouring lattice points that come
next in distance. Two vectors meet where one is at home and the other at home or visiting; each meeting is verified by
cosine in double precision. A pair that meets often is counted only at its first meeting, which both cells can tell from
the vectors alone, so no list of pairs is built. Measured recall of one pair at cosine 0.93 is 0.66 a table.

Equal vectors of one label are one class with a multiplicity, from the start; a class has a number of its own, and vec_id
only names components. A cell of more than `CELL` rows is cut into blocks by hash, and each pair of blocks is a task of its
own: nothing is dropped.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with null label or
null vec_id, link with nothing: n_links 0 and component_id the own vec_id. Vectors of different lengths don't link. Every
row is a vector of its own, also where vec_id repeats with the same vector or another one: each gets a row, and repeated
rows count as each other's links. Components as large or small as a double holds don't change a cosine: vectors are scaled
by their largest component first. Vectors of any length are compared whole. A cosine of exactly the threshold links. Other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm.common import components, small_batches, spread_join, stored, table, tidy

TABLES, PROBES, SCALE, THRESHOLD, CELL, SEED = 5, 4, 0.7, 0.93, 2000, 8


@lru_cache(1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    ends = [[a if k == i else b if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for a in (1.0, -1.0) for b in (1.0, -1.0)]
    halves = [list(x) for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array(ends + halves)


def nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest integer point whose coordinates have an even sum."""
    f = np.rint(y)
    gap = y - f
    worst = np.abs(gap).argmax(1)
    odd = np.flatnonzero(f.sum(1) % 2)
    f[odd, worst[odd]] += np.where(gap[odd, worst[odd]] >= 0, 1, -1)
    return f


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest lattice point: E8 is the even points and their shift by a half."""
    a, b = nearest_even(y), nearest_even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(16)
def projections(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    random = np.random.default_rng([SEED, size])
    return [(random.normal(size=(size, 8)) * SCALE, random.random(8) * 2) for _ in range(TABLES)]


def cells(unit: np.ndarray) -> np.ndarray:
    """(vectors, tables, 1 + probes): numbers of the home cell and the visited ones."""
    out = np.empty((len(unit), TABLES, 1 + PROBES), dtype=np.int64)
    base = np.random.default_rng(SEED).integers(1 << 63, size=8, dtype=np.uint64) | np.uint64(1)
    for t, (p, shift) in enumerate(projections(unit.shape[1])):
        y = unit @ p + shift
        home = nearest_e8(y)
        gain = (y - home) @ shortest().T
        near = np.argsort(-gain, axis=1, kind="stable")[:, :PROBES]
        points = np.concatenate([home[:, None], home[:, None] + shortest()[near]], axis=1)
        x = ((points * 2).astype(np.int64).astype(np.uint64) * base).sum(2, dtype=np.uint64)
        out[:, t] = (x ^ (x >> np.uint64(29))).astype(np.int64)
    return out


def units(column: pa.Array) -> np.ndarray:
    """Vectors of length 1; scaled by the largest component first, so that no square overflows or vanishes."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_size(batch: pa.RecordBatch, column: str):
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for n in np.unique(sizes):
        yield batch.filter(pa.array(sizes == n)) if (sizes != n).any() else batch


def classes(vectors: DataFrame) -> DataFrame:
    """id (a number of its own), name (smallest vec_id), m (rows), label, v: distinct vectors that can link."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"))
    grouped_rows = rows.groupBy("label", "v").agg(F.min("vec_id").alias("name"), F.count("*").alias("m"))
    return grouped_rows.select(F.monotonically_increasing_id().alias("id"), "name", "m", "label", "v")


def grouped(batches, names: list[str]):
    """Slices of equal leading columns out of sorted batches, each whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if held and any(held[-1].column(n)[-1].as_py() != b.column(n)[0].as_py() for n in names):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        at = 0
        for c in cuts.tolist():
            own = b.slice(at, c - at)
            if held:
                own = pa.Table.from_batches([*held, own]).combine_chunks().to_batches()[0]
                held = []
            yield own
            at = c
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def linked(batch: pa.RecordBatch, t: int, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one cell or pair of blocks: positions a, b of linked rows whose first meeting this is, and all ids."""
    home, block = batch.column("home").to_numpy(zero_copy_only=False), batch.column("block").to_numpy(zero_copy_only=False)
    ids = batch.column("id").to_numpy()
    two = batch.column("b1")[0].as_py() != batch.column("b2")[0].as_py()
    none = np.zeros(0, np.int64)
    if len(ids) < 2 or not home.any():
        return none, none, ids
    unit = units(batch.column("v"))
    found = []
    order = np.argsort(~home, kind="stable")
    h = int(home.sum())
    for i in range(0, h, 512):
        own = order[i : min(i + 512, h)]
        a, b = np.nonzero(unit[own] @ unit[order].T >= THRESHOLD)
        found.append((own[a], order[b]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = ids[a] != ids[b]
    if two:
        keep &= block[a] != block[b]
    keep &= ~home[b] | (ids[a] < ids[b])
    a, b = a[keep], b[keep]
    if not len(a):
        return none, none, ids
    used, inverse = np.unique(np.r_[a, b], return_inverse=True)
    at = cells(unit[used])
    x, y = at[inverse[: len(a)]], at[inverse[len(a) :]]
    x_home_y, y_home_x = (x[:, :, :1] == y).any(2), (y[:, :, :1] == x).any(2)
    first = ~(x_home_y[:, :t] | y_home_x[:, :t]).any(1)
    # the visitor's own home also shows the pair if the first one visits there: the smaller id's home counts
    first &= home[b] | ~y_home_x[:, t] | (ids[a] < ids[b])
    return a[first], b[first], ids


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row."""
    spark = vectors.sparkSession
    small_batches(spark)
    vectors = vectors.select("vec_id", "label", "embedding")
    known = stored(classes(vectors), "vectors")  # written once, so each class keeps its number

    def place(batches):
        for whole in batches:
            for b in by_size(whole, "v"):
                c = cells(units(b.column("v")))
                n, per = len(c), TABLES * (1 + PROBES)
                at = pa.array(np.repeat(np.arange(n), per))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(at), b.column("label").take(at), pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), n)), pa.array(c.ravel()), pa.array(np.tile([True] + [False] * PROBES, n * TABLES))],
                    ["id", "label", "t", "cell", "home"],
                )

    kind = known.schema["label"].dataType.simpleString()
    placed = stored(known.select("id", "label", "v").mapInArrow(tidy(place), f"id long, label {kind}, t int, cell long, home boolean"), "cells")
    full = placed.groupBy("label", "t", "cell").agg(F.count("*").alias("n")).where(f"n > {CELL}")
    rows = placed.join(full, ["label", "t", "cell"], "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / CELL).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.join(known.select("id", "m", "v"), "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", "t", "cell", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "id", "m", "home", "v")
    keys = ["label", "t", "cell", "b1", "b2"]

    def link(batches):
        for g in grouped(batches, keys):
            if g.num_rows < 2:
                continue
            for own in by_size(g, "v"):
                a, b, ids = linked(own, own.column("t")[0].as_py(), own.column("cell")[0].as_py())
                if not len(a):
                    continue
                m = own.column("m").to_numpy()
                n = np.bincount(a, m[b], len(ids)) + np.bincount(b, m[a], len(ids))
                some = np.flatnonzero(n)
                ends = forest(a, b, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[ids[some], ids[ends[0]]]), pa.array([None] * len(some) + ids[ends[1]].tolist(), pa.int64()), pa.array(np.r_[n[some], np.zeros(len(ends[0]))].astype(np.int64))], ["a", "b", "n"]
                )

    met = rows.repartition(*keys).sortWithinPartitions(*keys)
    met = stored(met.mapInArrow(tidy(link), "a long, b long, n long"), "meetings")
    counts = met.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(known.select("id", "name"), met.where("b is not null").select("a", "b"))
    names = roots.groupBy("component").agg(F.min("name").alias("least"))
    found = roots.select("id", "component").join(names, "component").join(counts, "id", "left")
    rep = known.join(found, "id").select("label", "v", F.col("m").alias("copies"), F.col("least").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"))
    rows = rows.withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label")))
    found = spread_join(rows, rep, ["label", "v"], vectors.count(), "vec_id")
    component = F.coalesce("component", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Enough of the links to connect what they connect."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        low = low[low]
        while (low != low[low]).any():
            low = low[low]
        new = low[root]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(n))
    return other, root[other]


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
