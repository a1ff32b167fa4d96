"""Exact Jaccard join of word-shingle sets in the metric space of Jaccard distance.

1. Sets. A text's words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; its set holds the 64-bit hashes of its
   distinct shingles. Equal sets are one class from the start, represented by the smallest doc_id.
2. Regions that cannot be reached from each other. Sets that link differ in at most (|A| + |B|) (1 - p) / (1 + p) shingles,
   a 19th for p = 0.9 and a 9th for 0.8. Shingles are dealt by hash into two more parts than that bound for the larger size
   class, so linked sets agree on at least two whole parts; classes that agree on none are never compared. This replaces
   distances to pivots where all are 1: sets without common shingles are equally far from every pivot. At 0.9 frequent
   shingles draw nothing together, as a part holds several. Where parts hold few, there are a third more of them, and
   those without a rare shingle are left out if those with one outnumber the bound: then linked sets still agree on one.
   Parts are those of a size class; a set is at home in its own class and a guest in the next, and each class has regions of
   its own, so that chains of agreements don't run through sets of all sizes.
3. Voronoi cells. In each region of connected classes, pivots are chosen; each class is at home at the nearest pivot and a
   guest wherever the distance exceeds its own by at most twice the threshold, which the triangle inequality shows to be
   enough. Cells are joined in the same way until they are small or stop shrinking, and there sets are compared whose
   distances to the pivots differ by the threshold at most. Classes already known to be connected aren't compared again.
   Regions of more than `REGION` classes or `WEIGHT` shingles are linked to pivots by Spark: classes connected that way
   aren't compared with each other any more. Where many are left, they are dealt into Voronoi cells, in `LEVELS` rounds at
   most; where few are left, or in the end, they are compared with all in blocks. A task never holds more than two blocks,
   and no region is too large.

Links only travel as enough edges to connect what they connect. Nothing is dropped or capped.

Defined results: null text, or text without words, has an empty set, n_shingles 0, and is its own component; texts of
fewer words than a shingle have one shingle; rows with equal doc_id are one document; a null doc_id takes part with its
set but can't name a component; a similarity of exactly the threshold links; repeated rows each get a row and the same
result; texts of any length are read whole; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm.bpe import Cache
from boardsift.llm.common import components, discard, mixed, small_batches, spread_join, stored, table, tidy
from boardsift.llm.embeddings import grouped
from boardsift.shared import shuffles_removed

SHINGLE, PERCENT, REGION, WEIGHT, SLICE, LEVELS, LEAF, PIVOTS = 3, 90, 3000, 2_000_000, 200_000, 2, 40, 12
#: Parts are shuffled in so many rounds, by their keys, where there are more than `ROUND_ROWS` documents: nearly all of them meet no other, and together they take more room than the texts.
ROUNDS, ROUND_ROWS = 4, 20_000
#: Broadcasts hold at most so many rows of 24 bytes.
BROADCAST_ROWS = 2_000_000
#: Shingles in `COMMON` of a sample are common, the `LISTED` most frequent ones at most. The sample is one document in `SHARE`, but about
#: `SAMPLE` at least: then a rare shingle is in so many documents however large the table is, and regions don't grow together.
SAMPLE, SHARE, COMMON, LISTED = 10_000, 10, 10, 500_000
NONE = np.zeros(0, np.uint64)


def _learn(words: list[bytes]) -> list[int]:
    return [int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in words]


def word_hashes() -> Cache:
    return Cache(_learn)


def shingle_sets(texts: list[str | None], words: Cache, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and how many each has."""
    cut = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    get = words.add(cut).__getitem__
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = np.fromiter(map(get, chain.from_iterable(cut)), np.uint64, int(sizes.sum()))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # words from here to the end of the text
    owner = np.repeat(np.arange(len(cut)), sizes)
    whole = sizes[owner]
    h = mixed(flat, 101)
    for i in range(1, k):
        after = np.r_[flat[i:], np.zeros(min(i, len(flat)), np.uint64)][: len(flat)]
        h = np.where(left > i, mixed(h * np.uint64(3) + after, 101 + i), h)
    first = left == whole
    keep = (left >= k) | (first & (whole < k))
    h, owner = h[keep], owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])][: len(h)]
    return h[new], np.bincount(owner[new], minlength=len(cut))


@lru_cache(8)
def size_classes(percent: int = PERCENT) -> np.ndarray:
    """Smallest size of each class: linked sets lie in the same or in neighbouring classes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def thin(percent: int) -> bool:
    """Whether parts hold fewer than 8 shingles, so that some are empty and common shingles often have one to themselves."""
    return 100 + percent < 16 * (100 - percent)


def part_keys(h: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, common: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the parts of all sets, for the own size class and then the next one; how many each set has, and how many of the own class."""
    bounds, found = size_classes(percent), []
    own = np.searchsorted(bounds, sizes, side="right") - 1
    rare = ~np.isin(h, common) if len(common) else np.ones(len(h), bool)
    for step in (0, 1):
        c = own + step
        largest = bounds[c + 1] - 1
        apart = 2 * largest * (100 - percent) // (100 + percent)  # the most shingles in which linked sets differ
        parts = np.where(sizes > 0, apart + 2 + (apart // 3 if thin(percent) else 0), 0)
        base = np.cumsum(parts) - parts
        at = np.repeat(base, sizes) + (h % np.repeat(parts, sizes).astype(np.uint64)).astype(np.int64)
        total, filled, strong = np.zeros(int(parts.sum()), np.uint64), np.zeros(int(parts.sum()), bool), np.zeros(int(parts.sum()), bool)
        np.add.at(total, at, mixed(h, 7))
        filled[at] = True
        strong[at[rare]] = True
        owner = np.repeat(np.arange(len(sizes)), parts)
        nth = np.cumsum(strong)
        nth -= (nth - strong)[np.minimum(base, max(len(nth) - 1, 0))][owner] if len(nth) else 0
        firm, full = (np.bincount(owner[x], minlength=len(sizes)) > apart for x in (strong, filled))
        # of more strong parts than can differ, so many and one agree in one; else all filled parts count, else all
        keep = np.where(firm[owner], strong & (nth <= apart[owner] + 1), filled | ~full[owner])
        key = mixed(total + (c[owner].astype(np.uint64) << np.uint64(32)) + (np.arange(len(owner)) - base[owner]).astype(np.uint64), 9)
        found.append((owner[keep], key[keep].astype(np.int64)))
    first = np.bincount(found[0][0], minlength=len(sizes))
    owner, key = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(owner, kind="stable")
    return key[order], np.bincount(owner, minlength=len(sizes)), first


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat, kind))


class Sets:
    """Sets of one region as small token numbers."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, root: np.ndarray | None = None):
        self.percent = percent
        self.sizes = sizes.astype(np.int64)
        names, self.flat = np.unique(flat, return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.mark = np.zeros(len(names), bool)
        self.root = np.arange(len(sizes)) if root is None else np.unique(root, return_inverse=True)[1]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def common(self, one: int, rows: np.ndarray) -> np.ndarray:
        """Shingles that each row shares with one set."""
        own = self.flat[self.starts[one] : self.starts[one] + self.sizes[one]]
        self.mark[own] = True
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(ends[-1])
        out = np.add.reduceat(self.mark[self.flat[at]], ends - sizes, dtype=np.int64)
        self.mark[own] = False
        return out

    def near(self, one: int, rows: np.ndarray, both: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (self.sizes[one] + self.sizes[rows] - both)

    def link(self, one: int, rows: np.ndarray) -> None:
        rows = rows[self.root[rows] != self.root[one]]
        if len(rows):
            self.edges.append((np.full(len(rows), one), rows))
            old = np.unique(np.r_[self.root[rows], self.root[one]])
            self.root[np.isin(self.root, old)] = old[0]

    def join(self, rows: np.ndarray, home: np.ndarray, depth: int = 0) -> None:
        """All links of a row at home with any other, as far as they connect something."""
        tau = 1 - self.percent / 100 + 1e-9
        if not home.any() or (self.root[rows] == self.root[rows[0]]).all():
            return
        pivots = rows[home][np.unique(np.linspace(0, home.sum() - 1, min(PIVOTS, int(home.sum()))).astype(int))]
        far = np.empty((len(rows), len(pivots)))
        for k, p in enumerate(pivots):
            both = self.common(p, rows)
            far[:, k] = 1 - both / (self.sizes[p] + self.sizes[rows] - both)
            self.link(p, rows[self.near(p, rows, both)])
        if (self.root[rows] == self.root[rows[0]]).all() or len(pivots) == home.sum():
            return
        nearest = far.argmin(1)
        if len(rows) > LEAF and depth < 12:
            cells = [(far[:, k] <= far.min(1) + 2 * tau) | (home & (nearest == k)) for k in range(len(pivots))]
            if sum(c.sum() for c in cells) < 2 * len(rows):
                for k, c in enumerate(cells):
                    self.join(rows[c], (home & (nearest == k))[c], depth + 1)
                return
        for i in np.flatnonzero(home):
            x = rows[i]
            open_ = self.root[rows] != self.root[x]
            n, m = self.sizes[rows], self.sizes[x]
            open_ &= (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (np.abs(far - far[i]).max(1) <= tau)
            other = rows[open_]
            if len(other):
                self.link(x, other[self.near(x, other, self.common(x, other))])


def with_sets(docs: DataFrame, id_: str, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The kept columns and `s`, the set of ``text``."""

    def work(batches):
        words = word_hashes()
        for b in batches:
            h, sizes = shingle_sets(b.column("text").to_pylist(), words, shingle)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), _lists(h.astype(np.int64), sizes, pa.int64())], [*keep, "s"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(tidy(work), f"{schema}, s array<long>")


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted shingles that are frequent in a sample. Any list would do for the result: it only keeps regions small."""
    step = max(1, min(docs.count() // SAMPLE, SHARE))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0)
    with shuffles_removed(docs.sparkSession):
        counts = with_sets(some, "doc_id", ["doc_id"], shingle).select(F.explode("s").alias("x")).groupBy("x").count().where(f"count >= {COMMON}")
        return np.sort(counts.orderBy(F.desc("count"), "x").limit(LISTED).select("x").toArrow().column("x").to_numpy().astype(np.uint64))


def described(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, key (hash of its text), n (set size), k1 and k2 (the set's 128-bit key), parts, of which the first `own` are of the own size class."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle) if thin(percent) else NONE)

    def work(batches):
        words = word_hashes()
        for b in batches:
            h, sizes = shingle_sets(b.column("text").to_pylist(), words, shingle)
            owner, keys = np.repeat(np.arange(len(sizes)), sizes), []
            for seed in (21, 22):
                total = np.zeros(len(sizes), np.uint64)
                np.add.at(total, owner, mixed(h, seed))
                keys.append(pa.array(total.astype(np.int64)))
            parts, count, first = part_keys(h, sizes, percent, shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(sizes, pa.int64()), *keys, pa.array(first, pa.int32()), _lists(parts, count, pa.int64())], ["doc_id", "key", "n", "k1", "k2", "own", "parts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(tidy(work), "doc_id long, key long, n long, k1 long, k2 long, own int, parts array<long>")


def agreeing(rows: DataFrame) -> DataFrame:
    """(part, guest, id) -> (a, b): each id with the smallest one at home that shares a part; parts where none is at home don't count."""

    def work(batches):
        last_part, last_id, last_home = None, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            part, ids, home = b.column("part").to_numpy(), b.column("id").to_numpy(), ~b.column("guest").to_numpy(zero_copy_only=False)
            new = np.r_[last_part is None or part[0] != last_part, part[1:] != part[:-1]]
            at = np.maximum.accumulate(np.where(new, np.arange(len(part)), -1))
            low, ok = np.where(at >= 0, ids[np.maximum(at, 0)], last_id), np.where(at >= 0, home[np.maximum(at, 0)], last_home)
            last_part, last_id, last_home = part[-1], low[-1], bool(ok[-1])
            pairs = np.unique(np.c_[ids, low][(ids != low) & ok], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return rows.repartition("part").sortWithinPartitions("part", "guest", "id").mapInArrow(tidy(work), "a long, b long").distinct()


def verified(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(region, cell, home, id, root, s) -> (a, b): enough links to connect what is linked in each cell, beyond what roots say."""
    keys = ["region", "cell"]

    def work(batches):
        for g in grouped(batches, keys):
            if g.num_rows < 2:
                continue
            s = g.column("s")
            sets = Sets(s.flatten().to_numpy(), np.diff(s.offsets.to_numpy()), percent, g.column("root").to_numpy())
            ids = g.column("id").to_numpy()
            sets.join(np.arange(len(ids)), g.column("home").to_numpy(zero_copy_only=False))
            if sets.edges:
                a, b = (np.concatenate(x) for x in zip(*sets.edges, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return members.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(tidy(work), "a long, b long")


_MEMBERS = "region long, cell long, home boolean, id long, root long, s array<long>"


def to_pivots(pivots: list[np.ndarray], s: pa.Array) -> np.ndarray:
    """Shingles that each set shares with each pivot."""
    names = np.unique(np.concatenate(pivots))
    holds = np.zeros((len(names) + 1, len(pivots)), np.int32)  # the last row stands for shingles of no pivot
    for k, p in enumerate(pivots):
        holds[np.searchsorted(names, p), k] = 1
    flat = s.flatten().to_numpy()
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    at = np.where(names[at] == flat, at, len(names))
    sizes = np.diff(s.offsets.to_numpy())
    return np.add.reduceat(holds[at], np.cumsum(sizes) - sizes)


def load(n, weight):
    """Tasks that so many classes with so many shingles together make."""
    return F.greatest(F.ceil(n / REGION), F.ceil(weight / WEIGHT), F.lit(1)).cast("int")


def to_pivot_cells(members: DataFrame, large: DataFrame, level: int, percent: int, cells: bool) -> DataFrame:
    """Members of large cells against about `PIVOTS` classes at home there: who links to which (`to`), and, if asked for, the
    members in the Voronoi cells of these.

    A cell's members are dealt over tasks by hash; its pivots travel to each of these.
    """
    tau = 1 - percent / 100 + 1e-9
    keys = ["region", "cell"]
    rows = members.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, keys)
    tasks = load(F.col("n"), F.col("weight"))
    # classes that aren't of the cell's largest component yet
    pool = F.greatest(F.ceil((F.col("n") - F.col("most")) / PIVOTS), F.lit(1))
    picked = rows.where(F.col("home") & (F.col("root") != F.col("largest")) & (F.pmod(F.xxhash64("id", F.lit(level)), pool) == 0))
    picked = picked.withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1)))
    both = picked.withColumn("member", F.lit(0)).unionByName(rows.withColumn("task", F.pmod(F.xxhash64("id"), tasks).cast("int")).withColumn("member", F.lit(1)))

    def slices(own):
        """So many rows at a time that their sets have about `SLICE` shingles."""
        sizes = np.diff(own.column("s").offsets.to_numpy())
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1))
        for i, z in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
            yield own.slice(i, z - i)

    def work(batches):
        for g in grouped(batches, [*keys, "task"]):
            first = int(np.searchsorted(g.column("member").to_numpy(), 1))
            head = g.slice(0, first)
            names, pivots = head.column("id").to_numpy(), [x.values.to_numpy() for x in head.column("s")]
            for own in slices(g.slice(first)):
                if not first:
                    if cells:
                        yield pa.RecordBatch.from_arrays([*(own.column(k) for k in out[:-1]), pa.nulls(own.num_rows, pa.int64())], out)
                    continue
                s, ids = own.column("s"), own.column("id").to_numpy()
                sizes = np.diff(s.offsets.to_numpy())
                shared = to_pivots(pivots, s)
                union = sizes[:, None] + np.array([len(p) for p in pivots]) - shared
                near = (100 * shared >= percent * union) & (names != ids[:, None])
                if not cells:
                    at, k = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(names[k])], out)
                    continue
                far = 1 - shared / union
                nearest = far.argmin(1)
                at, k = np.nonzero((far <= far.min(1)[:, None] + 2 * tau) | (np.arange(len(pivots)) == nearest[:, None]))
                where = mixed(own.column("cell").to_numpy()[at].astype(np.uint64) + mixed(names[k], 41), 42).astype(np.int64)
                home = own.column("home").to_numpy(zero_copy_only=False)[at] & (nearest[at] == k)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([own.column("region").take(take), pa.array(where), pa.array(home), pa.array(ids[at]), own.column("root").take(take), s.take(take), pa.array(names[k], mask=~near[at, k])], out)

    out = [*keys, "home", "id", "root", "s", "to"] if cells else ["a", "b"]
    both = both.select(*keys, "task", "member", "home", "id", "root", "s").repartition(*keys, "task").sortWithinPartitions(*keys, "task", "member", "id")
    return both.mapInArrow(tidy(work), f"{_MEMBERS}, to long" if cells else "a long, b long")


def in_blocks(members: DataFrame, large: DataFrame) -> DataFrame:
    """Members of large cells in pairs of blocks: those of the largest component meet all others, but not each other."""
    rows = members.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, ["region", "cell"])
    few, many = load(F.col("n") - F.col("most"), F.col("weight") - F.col("heaviest")), load(F.col("most"), F.col("heaviest"))
    rows = rows.withColumns({"few": few, "many": many, "rest": F.col("root") != F.col("largest")})
    block = F.when(F.col("rest"), F.pmod(F.xxhash64("id"), F.col("few"))).otherwise(F.pmod(F.xxhash64("id"), F.col("many"))).cast("int")
    rows = rows.withColumn("block", block)
    # a task (i, j) joins block i of the rest with block j of it or, from `few` on, of the largest component
    for_rest = F.transform(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1), lambda j: F.when(j < F.col("few"), F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))).otherwise(F.struct(F.col("block").alias("i"), j.alias("j"))))
    for_most = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: F.struct(i.alias("i"), (F.col("few") + F.col("block")).alias("j")))
    rows = rows.withColumn("task", F.explode(F.when(F.col("rest"), for_rest).otherwise(for_most)))
    return rows.select("region", F.xxhash64("cell", "task.i", "task.j").alias("cell"), "home", "id", "root", "s")


def joined(members: DataFrame, percent: int, spare: list[DataFrame]) -> DataFrame:
    """(region, home, id, s) -> (a, b): enough links to connect what is linked in each region, however large. What is written on the way goes to `spare`."""

    def kept(df, name):
        spare.append(stored(df, name))
        return spare[-1]

    members = kept(members.select("region", F.lit(0).cast("long").alias("cell"), "home", "id", F.col("id").alias("root"), "s"), "members")
    weights = members.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("weight")).where(f"n > {REGION} or weight > {WEIGHT}").select("region")
    weights = kept(weights, "large")
    side = F.broadcast(weights) if weights.count() <= BROADCAST_ROWS else weights
    whole = members.join(side, "region", "left_anti")
    split = not weights.isEmpty()
    alone = split and whole.isEmpty()  # all regions are large
    done, edges = [] if alone else [whole], []
    rest = None if not split else members if alone else kept(members.join(side, "region", "left_semi"), "members")
    for level in range(LEVELS + 1 if rest else 0):
        for cells in (False, True):
            sizes = rest.groupBy("region", "cell", "root").agg(F.count("*").alias("m"), F.sum(F.size("s")).alias("w"))
            best = F.max(F.struct("m", "w", "root"))
            sizes = sizes.groupBy("region", "cell").agg(F.sum("m").alias("n"), F.sum("w").alias("weight"), best.alias("b"))
            sizes = kept(sizes.select("region", "cell", "n", "weight", F.col("b.m").alias("most"), F.col("b.w").alias("heaviest"), F.col("b.root").alias("largest")).where(f"n > {REGION} or weight > {WEIGHT}"), "sizes")
            own = sizes.select("region", "cell")
            small = rest.join(F.broadcast(own) if own.count() <= BROADCAST_ROWS else own, ["region", "cell"], "left_anti")
            if not cells:
                done.append(kept(small, "small"))
                large = sizes.where("n > most")  # where all classes are connected, nothing is left to do
                if large.isEmpty():
                    rest = None
                    break
                links = kept(to_pivot_cells(rest, large, level, percent, False), "links")
                edges.append(links)
                before, rest = rest, kept(rerooted(rest.join(large.select("region", "cell"), ["region", "cell"], "left_semi"), links), "members")
                if alone or before is not members:  # else the regions that are whole are still read from there
                    discard(before)
                continue
            few = sizes.where(f"n > most and (n - most <= {REGION} or {level} = {LEVELS})")
            many = sizes.where(f"n > most and n - most > {REGION} and {level} < {LEVELS}")
            if not few.isEmpty():
                done.append(in_blocks(rest, few))
            if many.isEmpty():
                rest = None
                break
            next_ = kept(to_pivot_cells(rest, many, level, percent, True), "members")
            links = kept(next_.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")), "links")
            edges.append(links)
            before, rest = rest, kept(rerooted(next_.drop("to"), links), "members")
            discard(next_)
            if few.isEmpty():  # else its blocks are still to be read
                discard(before)
        if rest is None:
            break
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    out = verified(every, percent)
    for x in edges:
        out = out.unionByName(x)
    return out


def rerooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with the smallest id that they are known to be connected to."""
    known = members.select(F.col("root").alias("id")).unionByName(members.select("id")).distinct()
    roots = components(known, links.unionByName(members.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b"))))
    return members.drop("root").join(roots.withColumnRenamed("component", "root"), "id").select("region", "cell", "home", "id", "root", "s")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, key (hash of its text), n_shingles, component_id of every document, by shingles of so many words and links from so many percent on."""
    small_batches(docs.sparkSession)
    known = stored(described(docs, shingle, percent), "sets")
    reps = stored(known.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    # documents that only repeat the set of another one are left out: they are fewer than those that stay
    named_ids = reps.where("id is not null and n > 0").select(F.col("id").alias("doc_id")).distinct()
    again = spread_join(known.select("doc_id", "n", "k1", "k2"), reps, ["n", "k1", "k2"], known.count(), "doc_id").where("n > 0 and doc_id <> id")
    again = stored(again.select("doc_id").distinct().join(named_ids, "doc_id", "left_anti"), "again")
    rows = known.where("doc_id is not null and n > 0").join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, "doc_id", "left_anti")
    # a document stands in its own size class and in the next; a clash of these numbers would only make a region larger
    sides = rows.select("doc_id", "own", F.posexplode("parts").alias("at", "part")).withColumn("guest", F.col("at") >= F.col("own"))
    sides = sides.select("part", "guest", F.xxhash64("doc_id", "guest").alias("id"))
    rounds = ROUNDS if known.count() > ROUND_ROWS else 1
    met = [stored(agreeing(sides.where(F.pmod("part", F.lit(rounds)) == k)), "agreeing") for k in range(rounds)]
    pairs = reduce(DataFrame.unionByName, met)
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    regions = components(nodes, pairs).withColumnRenamed("component", "region")
    names = rows.select("doc_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("guest")).withColumn("id", F.xxhash64("doc_id", "guest"))
    regions = stored(regions.join(names, "id").select("region", F.col("doc_id").alias("id"), (~F.col("guest")).alias("home")).distinct(), "regions")
    everything, known = known, stored(known.drop("own", "parts"), "documents")
    for x in (*met, everything):
        discard(x)
    ids = regions.select("id").distinct()
    weights = regions.join(known.select(F.col("doc_id").alias("id"), "n").where("n > 0"), "id").groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("weight"))
    large = stored(weights.where(f"m > {REGION} or weight > {WEIGHT}").select("region"), "large")
    side = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large

    def members(some: DataFrame, few: bool) -> DataFrame:
        """Sets of the classes in some regions."""
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(some) if few else some, "id")
        return with_sets(texts, "id", ["region", "home", "id"], shingle).where("size(s) > 0")

    # sets are what takes most room: those of ordinary regions are shuffled in rounds and not written, and only links stay of them
    whole, few = regions.join(side, "region", "left_anti"), regions.count() <= BROADCAST_ROWS * rounds
    edges = []
    for k in range(rounds):
        now = members(whole.where(F.pmod(F.xxhash64("region"), F.lit(rounds)) == k), few)
        edges.append(stored(verified(now.select("region", F.lit(0).cast("long").alias("cell"), "home", "id", F.col("id").alias("root"), "s"), percent), "edges"))
    if not large.isEmpty():
        spare: list[DataFrame] = []
        rest = regions.join(side, "region", "left_semi")
        edges.append(stored(joined(members(rest, rest.count() <= BROADCAST_ROWS), percent, spare), "edges"))
        for x in spare:
            discard(x)
    edges = reduce(DataFrame.unionByName, edges)
    linked = components(ids, edges)
    # the classes learn their component, one row each, before they meet their documents
    named = reps.where("n > 0").join(linked, "id", "left").unionByName(reps.where("n = 0"), allowMissingColumns=True)
    found = spread_join(known.select("doc_id", "key", "n", "k1", "k2"), named, ["n", "k1", "k2"], known.count(), "doc_id")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key")
