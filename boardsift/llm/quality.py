"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Each text becomes a row of document statistics. Random Fourier features (Rahimi and Recht, 2007) of the standardised
statistics approximate a Gaussian kernel; every partition sums its share of the normal equations, the sums are added up
in a tree of which every node adds `FAN`, so the driver gets one sum however many partitions there are, and it solves one
small ridge system per calibration fold.
Isotonic regression (pooled adjacent violators) on out-of-fold ridge scores turns them into probabilities.

What learns: rows of ``labels`` joined by doc_id, of training folds only (crc32(doc_id) mod 5 <> 0). Inputs of a score:
the text alone.

Defined results: null text counts as empty and is scored like an empty text; labels without a document, or null, are
unused; several labels of one document each count; documents with equal doc_id, repeated rows too, each get a row and
each learn from the labels of that id; texts of any length are measured whole; statistics beyond 6 deviations count as 6;
equal raw scores get equal scores; with no usable label or only one kind, every score is the share of label 1 (0.5 without
labels); other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm.common import held_out, small_batches, stored, table, tidy

FEATURES, GAMMA, RIDGE, FOLDS, FAN, BINS, THRESHOLD, SEED = 384, 0.04, 1e-3, 4, 16, 2000, 0.3, 20
_PUNCT = str.maketrans("", "", string.punctuation)
_VOWEL = re.compile(r"[aeiouyäöüáéíóúàèêâôû]+", re.I)


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text, all in small ranges."""
    text = text or ""
    n = len(text)
    words, lines = text.split(), text.split("\n")
    w, full = max(1, len(words)), [x for x in lines if x.strip()]
    length = max(1, n)
    counts = Counter(words)
    bare = text.translate(_PUNCT)
    raw = text.encode("utf-8", "replace")
    squeezed = len(zlib.compress(raw, 1)) / max(64, len(raw))
    letters = sum(map(str.isalpha, words))
    sizes, per, long = list(map(len, counts)), list(counts.values()), list(map(len, words))
    line_counts = Counter(full)
    ends = sum(x.rstrip().endswith((".", "!", "?", ":", "…")) for x in full)
    return [
        np.log1p(n) / 10,
        np.log1p(len(words)) / 8,
        (n - len(bare)) / length * 5,
        sum(map(text.count, "!?")) / w,
        text.count("|") / w,
        sum(map(text.count, "#$%&*@^~=+<>{}[]\\/_")) / w,
        sum(map(text.count, ".,;:")) / w,
        sum(map(text.count, "0123456789")) / length * 5,
        sum(map(str.isupper, words)) / w,
        sum(map(str.istitle, words)) / w,
        letters / w,
        sum(map(str.isupper, text)) / length * 5,
        n / w / 10,
        float(np.std(long)) / 8 if words else 0.0,
        len(counts) / w,
        max(per, default=0) / w,
        sum(x for x in per if x > 1) / w,
        (sum(sizes) / len(sizes) / 10) if sizes else 0.0,
        len(lines) / w,
        np.log1p(w / max(1, len(full))) / 5,
        (len(full) - len(line_counts)) / max(1, len(full)),
        max(line_counts.values(), default=0) / max(1, len(full)),
        ends / max(1, len(full)),
        squeezed,
        len(_VOWEL.findall(text)) / length * 2,
        (len(bare) - len(bare.encode("ascii", "ignore"))) / length * 5,
        long.count(1) / w,
        sum(x > 14 for x in long) / w,
        (text.count("http") + text.count("www.") + text.count("@")) / w,
        len(set(text)) / 100,
    ]


N = len(statistics("a"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of its text) and x, the text's statistics."""
    small_batches(docs.sparkSession)

    def work(batches):
        for b in batches:
            x = pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), x], ["doc_id", "key", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(tidy(work), f"doc_id {kind}, key long, x array<double>")


class Fourier:
    """cos(x'W + b) of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        random = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = random.normal(size=(N, FEATURES)) * np.sqrt(2 * GAMMA)
        self.b = random.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b
        return np.c_[np.cos(z) * np.sqrt(2 / FEATURES), np.ones(len(x))]


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N)


def summed(rows: DataFrame, partial, names: int) -> list[np.ndarray]:
    """Add up arrays over all partitions: each makes its own sums, `FAN` of which meet in a task, and so on until one is left."""
    columns = [f"s{i}" for i in range(names)]
    schema = "p int, " + ", ".join(f"{c} binary" for c in columns)

    def row(p, sums):
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in sums)], ["p", *columns])

    def work(batches):
        sums = None
        for b in batches:
            if b.num_rows:
                own = partial(b)
                sums = own if sums is None else [s + o for s, o in zip(sums, own, strict=True)]
        if sums is not None:
            yield row(0, sums)

    def add(batches):
        sums, p = None, 0
        for b in batches:
            for i in range(b.num_rows):
                p = b.column("p")[i].as_py()
                own = [np.frombuffer(b.column(c)[i].as_py(), "<f8") for c in columns]
                sums = own if sums is None else [s + o for s, o in zip(sums, own, strict=True)]
        if sums is not None:
            yield row(p // FAN, sums)

    left = max(2, len(rows.inputFiles()))
    parts = rows.mapInArrow(tidy(work), schema).withColumn("p", F.spark_partition_id())
    while left > 1:
        left = -(-left // FAN)
        parts = parts.repartitionById(left, F.floor(F.col("p") / FAN).cast("int")).sortWithinPartitions("p").mapInArrow(tidy(add), schema)
    one = parts.drop("p").collect()  # one row
    return [np.frombuffer(x, "<f8") for x in one[0]] if one else []


def isotonic(score: np.ndarray, weight: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over ascending scores: block centres and their levels."""
    blocks: list[list[float]] = []
    for s, w, y in zip(score, weight, label, strict=True):
        blocks.append([s * w, w, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([a / w for a, w, _ in blocks]), np.array([(y + 0.5) / (w + 1) for _, w, y in blocks])


class Model:
    def __init__(self, fourier=None, weights=None, centres=None, levels=None, share=0.5):
        self.fourier, self.weights, self.centres, self.levels, self.share = fourier, weights, centres, levels, share

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.fourier(x) @ self.weights, self.centres, self.levels), 0, 1)


def fit(train: DataFrame) -> Model:
    """From (fold, x, y): y is 0 or 1."""

    def moments(b):
        x, y = matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False)
        return [np.r_[len(x), y.sum(), x.sum(0), (x * x).sum(0)]]

    sums = summed(train, moments, 1)
    if not sums or not 0 < sums[0][1] < sums[0][0]:
        return Model(share=float(sums[0][1] / sums[0][0]) if sums else 0.5)
    n, mean = sums[0][0], sums[0][2 : 2 + N] / sums[0][0]
    scale = np.sqrt(np.maximum(sums[0][2 + N :] / n - mean**2, 1e-6))
    fourier, size = Fourier(mean, scale), FEATURES + 1
    upper = np.triu_indices(size)

    def normal(b):
        z, y, fold = fourier(matrix(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False)
        parts = [(z[fold == k], y[fold == k]) for k in range(FOLDS)]
        return [np.concatenate([(a.T @ a)[upper] for a, _ in parts]), np.concatenate([a.T @ t for a, t in parts])]

    half, xy = summed(train, normal, 2)
    xx, xy = np.empty((FOLDS, size, size)), xy.reshape(FOLDS, size)
    for full, own in zip(xx, half.reshape(FOLDS, -1), strict=True):
        full[upper] = full.T[upper] = own
    penalty = np.eye(size) * RIDGE * max(n, 2000)
    penalty[-1, -1] = 1e-9

    def solved(a, b):
        return np.linalg.solve(a + penalty * a[-1, -1] / n, b)

    folds = np.stack([solved(xx.sum(0) - xx[k], xy.sum(0) - xy[k]) for k in range(FOLDS)])

    def histogram(b):
        z, y, fold = fourier(matrix(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False)
        score = (z * folds[fold]).sum(1)
        at = np.clip(((score + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return [np.bincount(at, score, BINS), np.bincount(at, minlength=BINS).astype(float), np.bincount(at, y, BINS)]

    s, w, y = summed(train, histogram, 3)
    full = w > 0
    centres, levels = isotonic(s[full] / w[full], w[full], y[full])
    return Model(fourier, solved(xx.sum(0), xy.sum(0)), centres, levels, float(sums[0][1] / n))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, key (hash of its text), score: one row per document."""
    x = stored(measured(docs), "statistics")
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("y")).where(~F.coalesce(held_out(), F.lit(True)))
    train = x.join(known, "doc_id").select((F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("/fold"))) % FOLDS).cast("int").alias("fold"), "x", "y")
    model = fit(stored(train, "training"))

    def work(batches):
        for b in batches:
            score = model(matrix(b.column("x"))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(score, pa.float64())], ["doc_id", "key", "score"])

    kind = x.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(tidy(work), f"doc_id {kind}, key long, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
