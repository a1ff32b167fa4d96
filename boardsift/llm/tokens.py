"""Encoding, decoding and counting of tokens with public tokenizer files.

Texts are cut into words, which merges never cross; a task encodes a distinct word once, in numpy merge rounds
(`bpe.Merges`), and looks the others up while it remembers them. Special tokens written in a text count as those tokens, as
the library has it by default.

Defined results: null text counts as empty; an empty text has no tokens; repeated rows each get a row; other columns are
ignored; an empty table gives no rows. The path of the tokenizer file is a parameter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boardsift.llm import bpe
from boardsift.llm.common import small_batches, table, tidy


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCodec:
    """Lower-casing BPE with word ends. A task keeps the ids of distinct words."""

    def __init__(self, path: str):
        self.m = bpe.merges(path)
        self.cache = bpe.Cache(self.learn)
        self.normal, self.cut = library(path).normalizer.normalize_str, library(path).pre_tokenizer.pre_tokenize_str
        self.kind = np.uint16 if max(self.m.tokens) < 1 << 16 else np.uint32
        self.names = [str(i) for i in range(max(self.m.tokens) + 1)]

    def learn(self, words: list[str]) -> list[bytes]:
        special = self.m.specials
        symbols, counts = self.m.encode([b"" if w in special else w.encode() for w in words])
        data, size = symbols.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        ends = (np.cumsum(counts) * size).tolist()
        return [self.kind(special[w]).tobytes() if w in special else data[z - n * size : z] for w, n, z in zip(words, counts.tolist(), ends, strict=True)]

    def words(self, text: str) -> list[str]:
        """Normalised and split; beyond Latin texts by the library's own tables."""
        if bpe.latin(text):
            return bpe.latin_words(text)
        text = self.normal(text)
        return [text[a:b] for _, (a, b) in self.cut(text)]

    def texts(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: tokens, ids joined by spaces, decoded text."""
        cut = [self._words(t or "") for t in texts]
        get, name, token = self.cache.add(cut).__getitem__, self.names.__getitem__, self.m.tokens.__getitem__
        out = []
        for ws in cut:
            ids = np.frombuffer(b"".join(map(get, ws)), self.kind).tolist()
            out.append((len(ids), " ".join(map(name, ids)), " ".join(map(token, ids))))
        return out

    def _words(self, text: str) -> list[str]:
        if not any(s in text for s in self.m.specials):
            return self.words(text)
        cut, at = [], 0
        for m in self.m.split.finditer(text):
            cut += [*self.words(text[at : m.start()]), m[0]]
            at = m.end()
        return cut + self.words(text[at:])

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.m.tokens[i] for i in ids)


def byte_words(text: str, specials: dict, split) -> list[str]:
    """Pre-tokens of a byte-level file; special tokens are words of their own."""
    if not any(s in text for s in specials):
        return bpe.byte_words(text)
    cut, at = [], 0
    for m in split.finditer(text):
        cut += [*bpe.byte_words(text[at : m.start()]), m[0]]
        at = m.end()
    return cut + bpe.byte_words(text[at:])


class ByteCounter:
    """Byte-level BPE: how many symbols survive in each text."""

    def __init__(self, path: str):
        self.m = bpe.merges(path)
        self.cache = bpe.Cache(self.learn)

    def learn(self, words: list[str]) -> list[int]:
        special = self.m.specials
        _, counts = self.m.encode([b"x" if w in special else w.encode() for w in words])
        return counts.tolist()

    def texts(self, texts: list[str | None]) -> list[int]:
        cut = [byte_words(t or "", self.m.specials, self.m.split) for t in texts]
        get = self.cache.add(cut).__getitem__
        return [sum(map(get, ws)) for ws in cut]


@lru_cache(4)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def encode_texts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns and, of ``text``: n_tokens, ids (joined by spaces), decoded."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, "text")

    def work(batches):
        codec = WordCodec(path)
        for b in batches:
            n, ids, text = zip(*codec.texts(b.column("text").to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], [*keep, "n_tokens", "ids", "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(tidy(work), f"{schema}, n_tokens long, ids string, decoded string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)

    def work(batches):
        counter = ByteCounter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counter.texts(b.column("text").to_pylist()), pa.int64()), b.column("n_bytes")], ["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(work), f"doc_id {kind}, n_tokens long, n_bytes long").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
