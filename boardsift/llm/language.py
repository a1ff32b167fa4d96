"""Language of words and texts by a linear-chain conditional random field.

Each word's state is a language. A word speaks for its states through affixes (first and last 1 to 4 letters), letter
n-grams (1 to 3, with word ends marked) and lexicon membership (in which languages' lists of frequent words it is);
transitions between the states of neighbouring words are learnt. Forward-backward over the whole text gives each word's
posterior, and a text's language is the one with the largest mean posterior.

Training: at most `SAMPLE` labelled rows and `SAMPLE_BYTES` of text, those with the smallest hash of doc_id and text (a row that
would exceed the bytes is passed over, whole); from their words code-switched sequences of known labels are spliced, and
the conditional likelihood is maximised by gradient steps.

Scoring: a worker scores the emissions of a distinct word once. Long texts are cut into blocks of `BLOCK` words; products
of transfer matrices carry exact messages across blocks, so the chain is that of the whole text, computed for many
blocks at once.

Defined results: `und` with score 0 for null text, text without a letter, or when nothing could be learnt; rows with null
lang or null doc_id don't teach; texts and words of any length are read whole; ties between languages go to the
alphabetically first; repeated rows each get a row and the same prediction, and teach once; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm.common import held_out, small_batches, table, tidy

SAMPLE, SAMPLE_BYTES, BUCKETS, SEQUENCES, LENGTH, STEPS, BLOCK, WORDS, LEXICON, SEED = 1200, 32 << 20, 1 << 15, 4000, 40, 40, 64, 300_000, 300, 3
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    found = _WORD.findall((text or "").lower())
    if not all(map(str.isalpha, found)):
        found = list(chain.from_iterable("".join(c if c.isalpha() else " " for c in w).split() for w in found))
    return found


class Features:
    def __init__(self, lexicons: list[set[str]]):
        self.lexicons = lexicons

    def __call__(self, word: str) -> list[int]:
        w, n = f"<{word}>", len(word)
        names = [f"p{word[:k]}" for k in range(1, min(4, n) + 1)] + [f"s{word[-k:]}" for k in range(1, min(4, n) + 1)]
        names += {w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1)}
        names += [f"lexicon {k}" for k, known in enumerate(self.lexicons) if word in known]
        return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in names]

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all words, one after the other, and where each word's begin."""
        found = [self(w) for w in words]
        return np.fromiter(chain.from_iterable(found), np.int64), np.r_[0, np.cumsum([len(x) for x in found])[:-1]].astype(np.int64)


def posteriors(e: np.ndarray, a: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Marginals of every word's state: e (words, states) emissions in probability space, a transitions, docs words a text (none 0)."""
    n, k = e.shape
    blocks = -(-docs // BLOCK)
    s = int(blocks.sum())
    doc = np.repeat(np.arange(len(docs)), blocks)
    nth = np.arange(s) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(np.cumsum(docs) - docs, blocks) + nth * BLOCK
    size = np.minimum(BLOCK, docs[doc] - nth * BLOCK)
    order = np.argsort(-size, kind="stable")  # blocks that still have words come first at every step
    rank = np.empty(s, np.int64)
    rank[order] = np.arange(s)
    start, size = start[order], size[order]
    alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(BLOCK)]
    through = np.tile(np.eye(k), (s, 1, 1))
    for t in range(BLOCK):
        m = alive[t]
        if not m:
            break
        p = (through[:m].reshape(-1, k) @ a).reshape(m, k, k) * e[start[:m] + t][:, None, :]
        through[:m] = p / p.sum((1, 2), keepdims=True)
    first, last = np.cumsum(blocks) - blocks, np.cumsum(blocks) - 1
    ahead, behind = np.full((s, k), 1 / k), np.full((s, k), 1 / k)
    for j in range(1, int(blocks.max(initial=0))):
        here = rank[first[blocks > j] + j]
        before = rank[first[blocks > j] + j - 1]
        x = np.einsum("si,sij->sj", ahead[before], through[before])
        ahead[here] = x / x.sum(1, keepdims=True)
        here = rank[last[blocks > j] - j]
        after = rank[last[blocks > j] - j + 1]
        x = np.einsum("sij,sj->si", through[after], behind[after])
        behind[here] = x / x.sum(1, keepdims=True)
    out = np.empty((n, k))
    for t in range(BLOCK):
        m = alive[t]
        if not m:
            break
        x = (ahead[:m] @ a) * e[start[:m] + t]
        ahead[:m] = x / x.sum(1, keepdims=True)
        out[start[:m] + t] = ahead[:m]
    for t in range(BLOCK - 1, -1, -1):
        m = alive[t]
        if not m:
            continue
        at = start[:m] + t
        x = out[at] * behind[:m]
        out[at] = x / x.sum(1, keepdims=True)
        x = (behind[:m] * e[at]) @ a.T
        behind[:m] = x / x.sum(1, keepdims=True)
    return out


class Crf:
    def __init__(self, labels: list[str], features: Features, weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.features, self.weights, self.transitions = labels, features, weights, transitions
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(labels)), dtype=np.float32)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "rows": self.rows[:0]}

    def emissions(self, texts: list[list[str]]) -> np.ndarray:
        """exp(score) of every word, each row scaled to 1 at most."""
        met = set(chain.from_iterable(texts))
        new = list(met - self.known.keys())
        if len(self.known) + len(new) > WORDS:
            kept = [w for w in met if w in self.known]
            self.rows = self.rows[[self.known[w] for w in kept]]
            self.known = {w: i for i, w in enumerate(kept)}
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.scores(new)])
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64)
        return self.rows[at].astype(float)

    def scores(self, words: list[str]) -> np.ndarray:
        flat, starts = self.features.flat(words)
        e = np.add.reduceat(self.weights[flat], starts)
        return np.maximum(np.exp(e - e.max(1, keepdims=True)), 1e-12).astype(np.float32)

    def label_words(self, texts: list[list[str]]) -> np.ndarray:
        """Posterior of each language for every word of all texts."""
        return posteriors(self.emissions(texts), np.exp(self.transitions - self.transitions.max()), np.array([len(t) for t in texts]))

    def label_texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        cut = [words_of(t) for t in texts]
        out = [(UNKNOWN, 0.0)] * len(texts)
        full = [i for i, ws in enumerate(cut) if ws]
        if full and self.labels:
            sizes = np.array([len(cut[i]) for i in full])
            p = np.add.reduceat(self.label_words([cut[i] for i in full]), np.cumsum(sizes) - sizes) / sizes[:, None]
            for i, row in zip(full, p, strict=True):
                out[i] = (self.labels[int(row.argmax())], float(min(1.0, row.max())))
        return out


def fit(rows: list[tuple[str, str]]) -> Crf:
    """From (text, language) pairs."""
    rows = [(words_of(t), y) for t, y in rows]
    labels = sorted({y for ws, y in rows if ws})
    k = len(labels)
    streams = [list(chain.from_iterable(ws for ws, y in rows if y == lang)) for lang in labels]
    features = Features([{w for w, _ in Counter(s).most_common(LEXICON)} for s in streams])
    if k < 2:
        return Crf(labels, features, np.zeros((BUCKETS, k)), np.zeros((k, k)))
    random = np.random.default_rng(SEED)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(streams)))}
    streams = [np.array([vocabulary[w] for w in s]) for s in streams]
    x, y = np.empty((SEQUENCES, LENGTH), np.int64), np.empty((SEQUENCES, LENGTH), np.int64)
    for i in range(SEQUENCES):
        cuts = [0, *sorted(random.integers(1, LENGTH, random.integers(0, 3))), LENGTH]
        for a, b in zip(cuts, cuts[1:], strict=False):
            lang = random.integers(k)
            at = random.integers(len(streams[lang]))
            x[i, a:b], y[i, a:b] = np.take(streams[lang], range(at, at + b - a), mode="wrap"), lang
    used, x = np.unique(x, return_inverse=True)
    names = list(vocabulary)
    flat, starts = features.flat([names[i] for i in used])
    word = np.repeat(np.arange(len(used)), np.diff(np.r_[starts, len(flat)]))
    w, a = np.zeros((BUCKETS, k)), np.zeros((k, k))
    x, gold = x.reshape(SEQUENCES, LENGTH), np.eye(k)[y]
    truth = np.stack([np.bincount(x.ravel(), gold[..., j].ravel(), len(used)) for j in range(k)], 1)
    moves = np.einsum("sti,stj->ij", gold[:, :-1], gold[:, 1:])
    memory = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
    total = x.size
    for step in range(1, STEPS + 1):
        e = np.add.reduceat(w[flat], starts)
        p = np.exp(e - e.max(1, keepdims=True))[x]
        t = np.exp(a)
        forward, backward = np.empty_like(p), np.ones_like(p)
        at = p[:, 0]
        for i in range(LENGTH):
            at = p[:, 0] if i == 0 else (at @ t) * p[:, i]
            at = at / at.sum(1, keepdims=True)
            forward[:, i] = at
        at = np.ones((SEQUENCES, k))
        expected = np.zeros((k, k))
        for i in range(LENGTH - 1, 0, -1):
            ahead = p[:, i] * at
            pair = forward[:, i - 1, :, None] * t * ahead[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            at = ahead @ t.T
            at = at / at.sum(1, keepdims=True)
            backward[:, i - 1] = at
        post = forward * backward
        post /= post.sum(2, keepdims=True)
        gap = truth - np.stack([np.bincount(x.ravel(), post[..., j].ravel(), len(used)) for j in range(k)], 1)
        gw = np.stack([np.bincount(flat, gap[word, j], BUCKETS) for j in range(k)], 1) / total - 1e-6 * w
        ga = (moves - expected) / total - 1e-6 * a
        for value, g, m, v in ((w, gw, memory[0], memory[1]), (a, ga, memory[2], memory[3])):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(labels, features, w, a)


def learn(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Crf:
    """Fit on a bounded sample of the training folds' labelled rows."""
    known = docs.where("text is not null and lang is not null").where(~F.coalesce(held_out(), F.lit(True)))
    known = known.select(F.xxhash64(F.col("doc_id").cast("string"), "text", "lang").alias("h"), F.octet_length("text").alias("n"), "text", "lang")
    sizes = known.groupBy("h").agg(F.first("n").alias("n")).orderBy("h").limit(sample).collect()  # at most `sample` rows of two numbers
    chosen, left = [], sample_bytes
    for r in sizes:
        if r.n <= left:
            chosen.append(r.h)
            left -= r.n
    texts = known.where(F.col("h").isin(chosen)).groupBy("h").agg(F.first("text").alias("text"), F.first("lang").alias("lang"))
    return fit([(r.text, r.lang) for r in sorted(texts.collect())] if chosen else [])


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score of whole texts."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            found = shared.value.label_texts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(work), f"doc_id {kind}, lang_pred string, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
