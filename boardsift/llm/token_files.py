"""Token-id files with a minimal perfect hash index.

A file set is a table of shards, one row each: the shard's documents in ascending doc_id order, their ids as raw
little-endian integers, and an index. The index hashes a document key through levels of bit arrays: a key that is alone
in its bit at a level owns that bit, the others go to the next level, and the number of set bits before the own one is
the key's slot. A slot holds a 16-bit fingerprint, which turns away almost all foreign keys, the key's place, and so its
offset and length in the payload. A lookup costs a constant number of reads however many documents there are.

Documents are dealt to parts, ranges of (doc_id, hash of text) cut by a sample of the rows, `PARTS` of them at most; a part is
one task and is streamed into shards of about `shard_bytes` of ids each, so no task holds more than a shard. Rows that are
equal to one or several cuts are dealt over all parts between them, so that a doc_id (or none) that a third of the rows have
makes many parts. Documents are encoded where they are read and only ids are shuffled. The payload is written once to
the shared folder, so losing an executor loses no shard. Where a document starts is known from the sizes of parts, of which
there are few, and the place that its shard remembers.

Defined results: null text counts as empty and holds the end id only; a null doc_id sorts first and isn't in the index;
documents with equal doc_id follow each other by text hash, and their key yields them all; repeated rows each have ids of
their own; a document longer than a shard is a shard by itself, whole; other columns are ignored, whatever their names; an
empty table makes no shards.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardsift.llm import bpe
from boardsift.llm.common import mixed, small_batches, stored, table, tidy
from boardsift.llm.tokens import byte_words, library, tokenizer_file

#: Bytes of ids a shard, of text a part; most parts; sampled rows a part, which says how evenly they are cut; words a task remembers.
SHARD_BYTES, PART_BYTES, PARTS, PER_PART, WORDS = 4 << 20, 32 << 20, 20_000, 100, 400_000
#: low, high: smallest and largest doc_id; base: ids of the same part before this shard.
SHARD_SCHEMA = "part int, shard int, low long, high long, base long, n_docs long, n_ids long, payload binary, index binary"
_GAMMA, _LEVELS = 2.0, 48


class Encoder:
    """Ids of whole texts by the tokenizers library: its model is asked once for each distinct word that a task remembers."""

    def __init__(self, path: str):
        self.library = library(path)
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.code, self.kind = ("H", "<u2") if self.library.get_vocab_size() <= 1 << 16 else ("I", "<u4")
        self.letters = str.maketrans(dict(enumerate(bpe.byte_letters())))
        self.cache = bpe.Cache(self.learn, WORDS)

    def learn(self, words: list[str]) -> list[bytes]:
        split, letters, code, special, space = self.library.model.tokenize, self.letters, self.code, self.specials, self.letters[32]

        def spelt(w: str) -> str:
            """The word in the letters that stand for bytes."""
            if w.isascii():
                if w.isalnum():
                    return w
                if w[0] == " " and w[1:].isalnum():
                    return space + w[1:]
            return w.encode().decode("latin-1").translate(letters)

        return [array(code, [special[w]] if w in special else [t.id for t in split(spelt(w))]).tobytes() for w in words]

    def texts(self, texts: list[str | None], end: int) -> list[bytes]:
        cut = [byte_words(t or "", self.specials, self.split) for t in texts]
        get, tail = self.cache.add(cut).__getitem__, array(self.code, [end]).tobytes()
        return [b"".join(map(get, ws)) + tail for ws in cut]


class KeyIndex:
    """Minimal perfect hash over distinct keys; `places[slot]` is a key's position among the sorted ones."""

    def __init__(self, levels: list[np.ndarray], marks: np.ndarray, places: np.ndarray):
        self.levels, self.marks, self.places = levels, marks, places
        self.before = [np.r_[0, np.cumsum(x)] for x in levels]
        self.base = np.r_[0, np.cumsum([x.sum() for x in levels])].astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> KeyIndex:
        levels, left = [], keys.astype(np.int64)
        while len(left):
            if len(levels) == _LEVELS:
                raise ValueError("keys of an index must be distinct")
            size = max(64, int(_GAMMA * len(left)))
            at = (mixed(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        index = cls(levels, np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint32))
        slots = index._slots(keys)
        index.marks[slots] = (mixed(keys, 0) >> np.uint64(48)).astype(np.uint16)
        index.places[slots] = np.arange(len(keys), dtype=np.uint32)
        return index

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has its bit."""
        slots = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mixed(keys[open_], k + 1) % np.uint64(len(bits))).astype(np.int64)
            own = bits[at]
            slots[open_[own]] = self.base[k] + self.before[k][at[own]]
            open_ = open_[~own]
        return slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for one whose bit or fingerprint isn't there."""
        keys = keys.astype(np.int64)
        slots = self._slots(keys)
        known = slots >= 0
        known[known] = self.marks[slots[known]] == (mixed(keys[known], 0) >> np.uint64(48)).astype(np.uint16)
        return np.where(known, self.places[np.where(known, slots, 0)].astype(np.int64) if len(self.places) else -1, -1)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    head = json.dumps([[k, v.dtype.str, len(v)] for k, v in arrays.items()]).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(v.tobytes() for v in arrays.values())


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    n, out = int.from_bytes(data[:4], "little"), {}
    at = 4 + n
    for k, kind, count in json.loads(data[4:at]):
        out[k] = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += out[k].nbytes
    return out


def built_shard(ids: np.ndarray, null: int, payloads: list[bytes], kind: str) -> bytes:
    """Index of one shard: doc_id of the rows after the first `null` ones, in ascending order, and all rows' payloads."""
    sizes = np.array([len(x) for x in payloads], np.int64) // np.dtype(kind).itemsize
    keys, first = np.unique(ids, return_index=True)
    index = KeyIndex.build(keys)
    arrays = {"kind": np.frombuffer(kind.encode(), np.uint8), "keys": keys, "first": first.astype(np.uint32) + np.uint32(null), "starts": np.r_[0, np.cumsum(sizes)].astype(np.int64)}
    arrays |= {"marks": index.marks, "places": index.places} | {f"level{k}": np.packbits(x) for k, x in enumerate(index.levels)} | {"sizes": np.array([len(x) for x in index.levels], np.int64)}
    return packed(arrays)


class Shard:
    """Keyed access to one shard's documents."""

    def __init__(self, payload: bytes, index: bytes):
        a = unpacked(index)
        self.kind, self.keys, self.starts, self.payload = a["kind"].tobytes().decode(), a["keys"], a["starts"], payload
        self.first = np.r_[a["first"], len(self.starts) - 1].astype(np.int64)
        self.index = KeyIndex([np.unpackbits(a[f"level{k}"])[:n].astype(bool) for k, n in enumerate(a["sizes"].tolist())], a["marks"], a["places"])

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one row of each key's documents; equal where the key isn't here."""
        at = self.index.find(keys)
        at = np.where((at >= 0) & (self.keys[np.maximum(at, 0)] == keys), at, -1) if len(self.keys) else np.full(len(keys), -1)
        return np.where(at >= 0, self.first[at], 0), np.where(at >= 0, self.first[np.minimum(at + 1, len(self.first) - 1)], 0)

    def ids(self, row: int) -> np.ndarray:
        a, b = self.starts[row : row + 2].tolist()
        size = np.dtype(self.kind).itemsize
        return np.frombuffer(self.payload, dtype=self.kind, count=b - a, offset=a * size)


def cut_points(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, h) at which `n` parts of about equal numbers of rows part, from a sample of at most about `PER_PART` rows a part."""
    rows = docs.count()
    some = docs.select("doc_id", "h").where("doc_id is not null or h is not null")
    some = some.sample(fraction=min(1.0, n * PER_PART / max(1, rows)), seed=9).collect()  # about PARTS * PER_PART rows of two numbers at most
    keys = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.h) for r in some)
    cuts = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []
    return np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)


def parts_of(ids: np.ndarray, h: np.ndarray, cuts: tuple[np.ndarray, np.ndarray], seen: dict) -> np.ndarray:
    """Part of each row; rows equal to cuts take turns over the parts that those bound."""
    if not len(cuts[0]):
        return np.zeros(len(ids), np.int64)
    both = np.rec.fromarrays(cuts)
    rows = np.rec.fromarrays([ids, h], dtype=both.dtype)
    low, high = np.searchsorted(both, rows, side="left"), np.searchsorted(both, rows, side="right")
    for i in np.flatnonzero(high > low).tolist():
        seen[low[i]] = seen.get(low[i], -1) + 1
        low[i] += seen[low[i]] % (high[i] - low[i] + 1)
    return low


def write_shards(docs: DataFrame, path: str, end: int = 0, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Encode, write and reopen: a table of shards (see SHARD_SCHEMA)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(PARTS, -(-total // part_bytes)))
    cuts = spark.sparkContext.broadcast(cut_points(rows, n) if n > 1 else (np.zeros(0, np.int64),) * 2)
    kind = Encoder(path).kind

    def encode(batches):
        own, seen = Encoder(path), {}
        for b in batches:
            ids, h = b.column("doc_id"), b.column("h")
            part = parts_of(ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), h.to_numpy(), cuts.value, seen)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, h, pa.array(own.texts(b.column("text").to_pylist(), end), pa.binary())], ["part", "doc_id", "h", "ids"])

    def build(batches):
        part, shard, base, held, keys, size = None, 0, 0, [], [], 0

        def row():
            null = sum(k is None for k in keys)
            ids = np.array(keys[null:], np.int64)
            count = size // np.dtype(kind).itemsize
            cells = [part, shard, int(ids[0]) if len(ids) else None, int(ids[-1]) if len(ids) else None, base, len(held), count, b"".join(held), built_shard(ids, null, held, kind)]
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary()]
            return count, pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], ["part", "shard", "low", "high", "base", "n_docs", "n_ids", "payload", "index"])

        for b in batches:
            for p, key, x in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if held and (p != part or size + len(x) > shard_bytes):
                    count, out = row()
                    yield out
                    shard, base, held, keys, size = (shard + 1, base + count, [], [], 0) if p == part else (0, 0, [], [], 0)
                part = p
                held.append(x)
                keys.append(key)
                size += len(x)
        if held:
            yield row()[1]

    encoded = rows.mapInArrow(tidy(encode), "part int, doc_id long, h long, ids binary")
    dealt = encoded.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "h")
    return stored(dealt.mapInArrow(tidy(build), SHARD_SCHEMA), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document of the files, found through the index: doc_id, start, n_tokens, ids_crc32."""
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row a part: PARTS at most

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                shard = Shard(r["payload"], r["index"])
                first, last = shard.rows(shard.keys)
                null = len(shard.starts) - 1 - int((last - first).sum())
                ids = [None] * null + np.repeat(shard.keys, last - first).tolist()
                at = [*range(null), *np.repeat(first - np.r_[0, np.cumsum(last - first)[:-1]], last - first).__add__(np.arange(int((last - first).sum()))).tolist()] if len(shard.keys) else [*range(null)]
                crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(shard.starts[at] + r["before"] + r["base"], pa.int64()), pa.array(np.diff(shard.starts)[at], pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    joined = shards.join(F.broadcast(starts), "part").select("payload", "index", "base", "before")
    return joined.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of the documents with the given keys (column doc_id): doc_id, ids.

    A key goes to the parts whose range it is in (there are `PARTS` at most, and more than one only where the key is in
    several), there to the shards whose range it is in, and in a shard through the index.
    """
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ranges = shards.groupBy("part").agg(F.min("low").alias("first"), F.max("high").alias("last"))
    wanted = wanted.join(F.broadcast(ranges), (F.col("doc_id") >= F.col("first")) & (F.col("doc_id") <= F.col("last"))).select("part", "doc_id")
    places = wanted.join(shards.select("part", "shard", "low", "high"), "part").where("doc_id between low and high")
    both = shards.join(places.groupBy("part", "shard").agg(F.collect_list("doc_id").alias("want")), ["part", "shard"]).select("payload", "index", "want")

    def look(batches):
        for b in batches:
            for r in b.to_pylist():
                shard, want = Shard(r["payload"], r["index"]), np.array(r["want"], dtype=np.int64)
                first, last = shard.rows(want)
                rows = [(k, shard.ids(i).tolist()) for k, a, z in zip(want.tolist(), first, last, strict=True) for i in range(a, z)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return both.mapInArrow(look, "doc_id long, ids array<long>")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))
