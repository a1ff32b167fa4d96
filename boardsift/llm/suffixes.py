"""Repeated byte strings across all texts, by merging Burrows-Wheeler transforms of shards.

A byte goes if any `LENGTH`-byte string that covers it also starts elsewhere, in the same text or another. Strings are
judged on the input; texts are UTF-8 and no string crosses their ends.

1. Equal texts are one, with a multiplicity; they are told apart by 128 bits.
2. Every string of `LENGTH` bytes is routed by content: its anchor is the first `GRAM`-byte string inside it with the
   smallest hash, so equal strings have equal anchors. Consecutive strings with the same anchor form a fragment, which has
   300 bytes at most. A fragment whose anchor occurs nowhere else can't repeat. This only says what must meet; it finds
   no repeat.
3. Fragments that are equal as a whole (by 128 bits) are one, with a multiplicity; the others share its verdict.
4. All fragments of an anchor meet in one place, dealt by text to `SHARDS` shards. Each shard's suffixes are sorted on their
   own, and what is kept of that is its transform. The transforms are merged by interleave refinement
   (Holt and McMillan, 2014): each round takes `STEP` steps of the last-to-first mapping in every shard and so sorts the
   interleave by as many more bytes; blocks of equal prefixes split on the way, which gives the common prefixes without the
   texts, and those whose weight falls below 2 are left. After `LENGTH` bytes the blocks that are left are the repeated
   intervals. Nothing else decides that a string repeats.

What a batch of texts repeats is found the same way from the batch alone, and one fragment stands for all of it from then on.

An anchor may be in a third of all texts. Which ones are frequent is read off a sample of `SAMPLE` texts; their fragments are
dealt by content and text until equal ones are one. Where more than `HOT` different fragments share an anchor even so, a merge
would need them all in one place, so there, and only there, strings are compared by 128 bits each, counted by Spark.

Defined results: null text is empty; repeated rows and equal texts are removed in full where they have `LENGTH` bytes;
rows with equal doc_id are told apart by their text; a null doc_id is a document like others; texts of any length are
judged whole; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm.common import mixed, small_batches, spread_join, stored, table, tidy
from boardsift.llm.embeddings import grouped

LENGTH, GRAM, CHUNK, SHARDS, STEP = 200, 60, 300_000, 3, 8
#: Broadcasts hold at most so many rows of 48 bytes.
BROADCAST_ROWS = 1_000_000
#: Different fragments of one anchor that one task merges; rows of one anchor that a task holds at once.
HOT, HELD, SALTS = 8_000, 500_000, 16
#: Texts whose anchors are counted beforehand, and the count from which an anchor is frequent.
SAMPLE, FREQUENT = 4000, 20
_FACTOR = 0x9E3779B97F4A7C15
_BYTES, _OTHER = (np.random.default_rng(k).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (5, 6))


@lru_cache(2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the factor and of its inverse, up to 1 << size."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(1 << size, x, np.uint64)]) for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))


class Rolling:
    """Two hashes of all byte strings of a buffer: differences of prefix sums, brought to one exponent."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        power, self.back = powers(max(20, n.bit_length()))
        self.sums, self.other = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[raw] * power[:n], out=self.sums[1:])
        np.cumsum(_OTHER[raw] * power[:n], out=self.other[1:])

    def all(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size], 31)

    def some(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, back = (end - start).astype(np.uint64), self.back[start]
        return mixed((self.sums[end] - self.sums[start]) * back + size, 32), mixed((self.other[end] - self.other[start]) * back + size, 33)


def lows(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values."""
    n = len(h)
    x = np.full(-(-n // width) * width, np.uint64((1 << 64) - 1))
    x[:n] = h
    x = x.reshape(-1, width)
    ahead = np.minimum.accumulate(x, 1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1]).ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def fragments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all texts: owner, start and length of each fragment, its anchor and its own two hashes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if sizes.max(initial=0) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    roll = Rolling(raw)
    grams = roll.all(GRAM)
    anchor = lows(grams, LENGTH - GRAM + 1)
    ends = np.cumsum(sizes)
    inside = np.flatnonzero((np.repeat(ends, sizes) - np.arange(len(raw)) >= LENGTH)[: len(anchor)])
    found = anchor[inside]
    left = grams[inside] == found  # the anchor is at the start: the next string has another, maybe an equal one
    new = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (inside[1:] != inside[:-1] + 1) | left[:-1]])
    a, z = inside[new], inside[np.r_[new[1:] - 1, len(inside) - 1]] + LENGTH
    owner = np.searchsorted(ends, a, side="right")
    return owner, a - (ends - sizes)[owner], z - a, found[new], *roll.some(a, z)


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Starts in order of their suffixes, by doubling. A closing 0 ranks by its string, so no two suffixes are alike."""
    closed, depth, n = np.flatnonzero(text == 0), 1, len(text)
    rank = text.astype(np.int64) + len(closed)
    rank[closed] = np.arange(len(closed))
    while True:
        after = np.zeros(n, np.int64)
        after[: n - depth] = rank[depth:] + 1 if depth < n else 0
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key)
        key = key[order]
        fresh = np.r_[False, key[1:] != key[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        depth *= 2
        if fresh[1:].all():
            return order


class Shard:
    """A transform of strings: the byte before each suffix, in suffix order, plus 1; 0 where a string starts.

    Strings are closed by a 0 and count in the order given. `order` says which suffix each rank is; merging doesn't use it.
    """

    def __init__(self, strings: list[bytes]):
        raw = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8)  # no byte of UTF-8
        text = np.where(raw == 0xFF, 0, raw + 1).astype(np.uint8)
        self.order = sorted_suffixes(text) if len(text) else np.zeros(0, np.int64)
        ends = np.flatnonzero(text == 0)
        self.transform = text[self.order - 1] if len(text) else text
        self.transform[np.isin(self.order, np.r_[0, ends[:-1] + 1])] = 0

    def steps(self, base: int, stop: int) -> np.ndarray:
        """The last-to-first mapping, with ranks counted from `base`; `stop` where a string starts."""
        order = np.argsort(self.transform, kind="stable")
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order)) + base
        # as many strings start as end, and the suffixes that are closing 0s come first
        out[self.transform == 0] = stop
        return out


def merged(shards: list[Shard], weights: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of all transforms to the given depth, of repeated prefixes only: ranks (of one shard after the other) and their blocks.

    `weights` says how much each rank counts; blocks of a total below 2 fall out some time after they have split off. It
    begins at the ranks from which the mapping can take `depth` steps.
    """
    n = sum(len(x.transform) for x in shards)
    bases = np.cumsum([0, *(len(x.transform) for x in shards)]).tolist()
    to = np.r_[*(x.steps(base, n) for x, base in zip(shards, bases, strict=False)), n]
    symbol = np.r_[*(x.transform for x in shards), 0].astype(np.uint64)
    for k in range(STEP.bit_length() - 1):  # 1, 2, 4 ... steps at once; what runs past a start ends at `n`, whose symbol is 0
        symbol = symbol[to] << np.uint64(8 << k) | symbol
        to = to[to]
    rank = np.unique(symbol, return_inverse=True)[1].astype(np.int64) << 32
    rounds = depth // STEP
    end, far, left = np.arange(n + 1), to, rounds
    while left:  # where `rounds` jumps end
        if left & 1:
            end = far[end]
        far, left = far[far], left >> 1
    at = np.flatnonzero(end < n)
    block = np.zeros(len(at), np.int64)
    for i in range(1, rounds + 1):
        if not len(at):
            break
        key = rank[at] | block
        order = np.argsort(key)
        key, at = key[order], to[at[order]]
        new = np.r_[True, key[1:] != key[:-1]]
        block = np.cumsum(new) - 1
        if i % 6 == 1 or i == rounds:
            keep = np.add.reduceat(weights[at], np.flatnonzero(new))[block] >= 2
            at, block = at[keep], block[keep]
    return at, np.unique(block, return_inverse=True)[1]


def repeated(strings: list[bytes], weights: np.ndarray, owners: np.ndarray | None = None) -> list[np.ndarray]:
    """For each string, which of its starts begin a `LENGTH`-byte string of total weight 2 or more. Strings of one owner are in one shard."""
    dealt = (np.arange(len(strings)) if owners is None else owners) % SHARDS
    order = np.argsort(dealt, kind="stable")
    parts = [order[dealt[order] == k] for k in range(SHARDS)]
    shards = [Shard([strings[i] for i in part.tolist()]) for part in parts]
    sizes = np.array([len(x) for x in strings], np.int64)[order]
    base = np.cumsum(sizes + 1) - sizes - 1
    shift = np.cumsum([0, *(len(x.transform) for x in shards)])
    place = np.concatenate([x.order + b for x, b in zip(shards, shift, strict=False)])
    owner = np.repeat(np.arange(len(order)), sizes + 1)[place]
    at, _ = merged(shards, np.asarray(weights, float)[order][owner])
    hit = np.zeros(int(shift[-1]), bool)
    hit[place[at]] = True
    out: list = [None] * len(strings)
    for i, b, n in zip(order.tolist(), base.tolist(), sizes.tolist(), strict=True):
        out[i] = hit[b : b + n]
    return out


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First byte and length of what each run of starts covers."""
    x = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [(int(s), int(e) - 1 + LENGTH - int(s)) for s, e in zip(x[::2], x[1::2], strict=True)]


_ROW = {"h": pa.int64(), "t": pa.int64(), "u": pa.int64(), "d": pa.int64(), "e": pa.int64(), "a": pa.int32(), "n": pa.int32(), "c": pa.int32()}
_ROWS = "h long, t long, u long, d long, e long, a int, n int, c int"
_SPANS = "array<struct<s:int,n:int>>"


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """Sorted anchors that many texts of a sample hold. Any list would do for the result: it only says how rows are dealt."""
    step = max(1, docs.count() // SAMPLE)

    def work(batches):
        for b in batches:
            owner, _, _, anchor, _, _ = fragments([t.encode("utf-8", "replace") for t in b.column("text").to_pylist()])
            pairs = np.unique(np.c_[owner, anchor.astype(np.int64)], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1], pa.int64())], ["h"])

    some = docs.where(F.pmod("e", F.lit(step)) == 0).select("text").mapInArrow(tidy(work), "h long")
    often = some.groupBy("h").count().where(f"count >= {FREQUENT}").orderBy(F.desc("count"), "h").limit(10_000)
    return np.sort(np.array([r.h for r in often.collect()], np.int64))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """d, e (128 bits of a text), spans (a, n: ranges of bytes to remove) of distinct texts with at least one. docs: d, e, text."""
    docs = docs.where(f"octet_length(text) >= {LENGTH}").select("d", "e", "text")
    often = docs.sparkSession.sparkContext.broadcast(frequent_anchors(docs))

    def cut(batches):
        for b in batches:
            d, e = (b.column(k).to_numpy() for k in ("d", "e"))
            texts = [t.encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            owner, a, n, anchor, t, u = fragments(texts)
            if not len(t):
                continue
            order = np.lexsort((u, t))
            new = np.r_[True, (t[order][1:] != t[order][:-1]) | (u[order][1:] != u[order][:-1])]
            group, nth = np.cumsum(new) - 1, np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            count = np.bincount(group)[group]
            state, spans = np.ones(len(t), np.int64), []
            twice = order[(count > 1) & (nth < 2)]
            if len(twice):
                # what this batch repeats: two of each go through a merge of their own, the others share the verdict
                hits = repeated([texts[o][s : s + k] for o, s, k in zip(owner[twice].tolist(), a[twice].tolist(), n[twice].tolist(), strict=True)], np.ones(len(twice)), owner[twice])
                open_ = {int(g) for g, h, i in zip(group[(count > 1) & (nth < 2)], hits, twice, strict=True) if not h[: n[i] - LENGTH + 1].all()}
                settled = (count > 1) & ~np.isin(group, list(open_))
                state[order[settled]] = 0
                state[order[settled & (nth == 0)]] = 2
                own = order[settled]
                own = own[np.lexsort((a[own], owner[own]))]
                spans = own
            keep = np.flatnonzero(state > 0)
            h = anchor.astype(np.int64)
            cols = {"h": h[keep], "t": t[keep].astype(np.int64), "u": u[keep].astype(np.int64), "d": d[owner[keep]], "e": e[owner[keep]], "a": a[keep], "n": n[keep], "c": state[keep]}
            if len(spans):
                z = a[spans] + n[spans]
                new = np.r_[True, (owner[spans][1:] != owner[spans][:-1]) | (a[spans][1:] > z[:-1])]
                first, last = spans[new], z[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]
                spread = mixed(d[owner[first]].astype(np.uint64) + a[first].astype(np.uint64), 3).astype(np.int64)  # settled rows go anywhere
                zero = np.zeros(len(first), np.int64)
                done = {"h": spread, "t": zero, "u": zero, "d": d[owner[first]], "e": e[owner[first]], "a": a[first], "n": last - a[first], "c": zero}
                cols = {k: np.r_[cols[k], done[k]] for k in cols}
            where = np.where(np.isin(cols["h"], often.value), cols["h"] ^ cols["t"] ^ (cols["d"] % SALTS), cols["h"])
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[k], _ROW[k]) for k in _ROW), pa.array(where, pa.int64())], [*_ROW, "where"])

    rows = docs.mapInArrow(tidy(cut), f"{_ROWS}, `where` long").repartition("where").sortWithinPartitions("h", "t", "u", F.desc("c"))

    def alike(batches):
        held, open_ = None, False  # open_: rows of the held anchor have gone on already
        for b in batches:
            cols = {k: b.column(k).to_numpy() for k in _ROW}
            settled = cols["c"] == 0
            if settled.any():
                yield told({k: v[settled] for k, v in cols.items()}, np.zeros((3, int(settled.sum())), np.int64))
                cols = {k: v[~settled] for k, v in cols.items()}
            if held is not None:
                cols = {k: np.r_[held[k], v] for k, v in cols.items()}
            held = None
            if not len(cols["h"]):
                continue
            rest = int(np.searchsorted(cols["h"], cols["h"][-1]))
            if rest:
                yield from chosen({k: v[:rest] for k, v in cols.items()}, open_)
                open_ = False
            held = {k: v[rest:] for k, v in cols.items()}
            if len(held["h"]) > HELD:
                yield from chosen(held, True)
                held, open_ = None, True
        if held is not None:
            yield from chosen(held, open_)

    def told(cols, marks):
        return pa.RecordBatch.from_arrays([*(pa.array(cols[k], _ROW[k]) for k in _ROW), *(pa.array(x, pa.int32()) for x in marks)], [*_ROW, "w", "crowd", "copies"])

    def chosen(cols, flushed):
        """Rows that share their anchor with others. Marks: the weight of one row that stands for its equals, else 0; whether
        its anchor is dealt over tasks (1) or has too many different fragments (2); how many equal rows await its verdict."""
        h, t, u, c = (cols[k] for k in ("h", "t", "u", "c"))
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_t = new_h | np.r_[True, (t[1:] != t[:-1]) | (u[1:] != u[:-1])]
        gh, gt = np.cumsum(new_h) - 1, np.cumsum(new_t) - 1
        dealt, single = np.isin(h, often.value), c == 1
        crowded = (flushed & (h == h[0])) | (~dealt & (np.bincount(gh, new_t)[gh] > HOT))
        alive = dealt | crowded | ((np.bincount(gh, c)[gh] > 1) & (np.bincount(gh, single)[gh] > 0))
        singles = np.bincount(gt, single).astype(np.int64)[gt]
        rank = np.cumsum(single) - single
        first = single & (rank == rank[np.flatnonzero(new_t)][gt])
        rep = np.where(singles > 0, first, new_t)
        weight = np.where(rep, np.minimum(np.bincount(gt, c)[gt], 2), 0).astype(np.int64)
        keep = np.flatnonzero(alive & (single | rep))
        if len(keep):
            yield told({k: v[keep] for k, v in cols.items()}, [weight[keep], np.where(crowded, 2, dealt)[keep], singles[keep]])

    shared = stored(rows.mapInArrow(tidy(alike), f"{_ROWS}, w int, crowd int, copies int"), "fragments")

    def bytes_of(reps):
        """The reps with x, their bytes."""
        per_text = reps.groupBy("d", "e").agg(F.collect_list(F.struct("h", "t", "u", "a", "n", "w", "copies")).alias("fs"))
        texts = docs.join(per_text, ["d", "e"])
        return texts.select("d", "text", "fs").mapInArrow(tidy(take), "h long, t long, u long, w int, copies int, d long, x binary")

    def take(batches):
        names = ("h", "t", "u", "w", "copies")
        for b in batches:
            fs = b.column("fs")
            flat, counts = fs.flatten(), np.diff(fs.offsets.to_numpy())
            at, size = (flat.field(k).to_numpy() for k in ("a", "n"))
            own = np.repeat(np.arange(len(counts)), counts)
            raws = [t.encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            x = [raws[o][s : s + n] for o, s, n in zip(own.tolist(), at.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(flat.field(k) for k in names), pa.array(b.column("d").to_numpy()[own]), pa.array(x, pa.binary())], [*names, "d", "x"])

    def judge(batches):
        held, size = [], 0
        for g in grouped(batches, ["h"]):
            held.append(g)
            size += g.column("x").nbytes
            if size >= CHUNK:
                yield verdicts(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield verdicts(pa.Table.from_batches(held))

    def verdicts(g):
        hits, copies = repeated(g.column("x").to_pylist(), g.column("w").to_numpy(), g.column("d").to_numpy()), g.column("copies").to_numpy()
        at = pa.array([i for i in np.flatnonzero(copies).tolist() if hits[i].any()], pa.int64())
        spans = pa.array([[{"s": s, "n": n} for s, n in _runs(hits[i])] for i in at.to_pylist()], pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())])))
        return pa.RecordBatch.from_arrays([*(g.column(k).combine_chunks().take(at) for k in ("h", "t", "u", "copies")), spans], ["h", "t", "u", "copies", "spans"])

    def hashed(batches):
        """Every string of each fragment: 128 bits, where it starts."""
        for b in batches:
            x = b.column("x").to_pylist()
            sizes = np.array([len(v) for v in x], np.int64)
            count = sizes - LENGTH + 1
            own = np.repeat(np.arange(len(x)), count)
            s = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            start = s + (np.cumsum(sizes) - sizes)[own]
            p, q = Rolling(np.frombuffer(b"".join(x), np.uint8)).some(start, start + LENGTH)
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(q.astype(np.int64)), pa.array(s, pa.int32()), *(b.column(k).take(at) for k in ("h", "t", "u", "w", "copies"))], ["p", "q", "s", "h", "t", "u", "w", "copies"])

    reps = shared.where("w > 0")
    # anchors that were dealt are in the sample's list, so those of them that are crowded are few
    crowded = reps.where("crowd = 1").groupBy("h").agg(F.count("*").alias("different")).where(f"different > {HOT}").select("h", F.lit(2).alias("all"))
    reps = reps.join(F.broadcast(crowded), "h", "left").withColumn("crowd", F.coalesce("all", "crowd"))
    found = bytes_of(reps.where("crowd < 2")).repartition("h").sortWithinPartitions("h", "t", "u").mapInArrow(tidy(judge), f"h long, t long, u long, copies int, spans {_SPANS}")
    hot = stored(reps.where("crowd = 2"), "crowded")
    if not hot.isEmpty():
        strings = stored(bytes_of(hot).mapInArrow(tidy(hashed), "p long, q long, s int, h long, t long, u long, w int, copies int"), "strings")
        counts = strings.groupBy("p", "q").agg(F.sum("w").alias("weight"), F.count("*").alias("copies")).where("weight > 1")
        starts = spread_join(strings.where("copies > 0").withColumnRenamed("copies", "rows"), counts, ["p", "q"], strings.count(), "t").where("weight is not null")
        starts = starts.groupBy("h", "t", "u").agg(F.max("rows").alias("copies"), F.transform(F.array_sort(F.collect_set("s")), lambda s: F.struct(s.alias("s"), F.lit(LENGTH).alias("n"))).alias("spans"))
        found = found.unionByName(starts)
    # rows that were dealt by text may have several that stand for them, with one verdict
    found = found.groupBy("h", "t", "u").agg(F.sum("copies").alias("copies"), F.first("spans").alias("spans"))
    found = stored(found, "verdicts")
    told_rows = spread_join(shared.where("c = 1").select("h", "t", "u", "d", "e", "a"), found, ["h", "t", "u"], shared.count(), "d").where("spans is not null")
    told_rows = told_rows.select("d", "e", "a", F.inline("spans")).select("d", "e", (F.col("a") + F.col("s")).alias("a"), "n")
    spans = told_rows.unionByName(shared.where("c = 0").select("d", "e", "a", "n"))
    return spans.groupBy("d", "e").agg(F.collect_list(F.struct("a", "n")).alias("spans"))


def without_repeats(docs: DataFrame, keep: tuple[str, ...] = (), text: bool = False) -> DataFrame:
    """doc_id, other columns to keep, n_bytes, kept (bytes that stay; as text, their whole letters), n_spans (removed runs): a row for each row."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"d": F.xxhash64("text"), "e": F.xxhash64(F.lit(1), "text")})
    counts = rows.groupBy("d", "e").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"))
    copies = stored(counts.where("copies > 1"), "copies")
    if copies.count() <= BROADCAST_ROWS:
        marked = rows.join(F.broadcast(copies), ["d", "e"], "left")
    else:
        marked = spread_join(rows, copies, ["d", "e"], rows.count(), "doc_id")
    copied = F.col("copies").isNotNull()
    first = marked.where("copies is null or doc_id <=> one").select("d", "e", "text")
    spans = stored(repeated_spans(first), "spans")
    # equal texts go in full, so they look for no spans: dealt by doc_id, with a key that matches nothing
    alone = marked.withColumn("d", F.when(copied, F.xxhash64("doc_id")).otherwise(F.col("d"))).withColumn("e", F.when(~copied, F.col("e")))
    found = alone.join(spans, ["d", "e"], "left")

    def remove(batches):
        for b in batches:
            out = []
            for text, copied, own in zip(*(b.column(k).to_pylist() for k in ("text", "copied", "spans")), strict=True):
                raw = text.encode("utf-8", "replace")
                cut = [(0, len(raw))] if copied and len(raw) >= LENGTH else covered([(s["a"], s["a"] + s["n"]) for s in own or []])
                ends = [0, *(x for c in cut for x in c), len(raw)]
                left = b"".join(raw[s:e] for s, e in zip(ends[::2], ends[1::2], strict=True))
                out.append((len(raw), left.decode("utf-8", "ignore") if as_text else left, len(cut)))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in same), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string() if as_text else pa.binary()), pa.array(cols[2], pa.int64())], [*same, "n_bytes", "kept", "n_spans"])

    same, as_text = ("doc_id", *keep), text
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in same)
    found = found.select(*same, "text", copied.alias("copied"), "spans")
    return found.mapInArrow(tidy(remove), f"{kinds}, n_bytes long, kept {'string' if text else 'binary'}, n_spans long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
