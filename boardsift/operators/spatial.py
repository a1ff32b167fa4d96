"""Joins by distance, through a grid so that they run as hash joins; and boards that meet in kernels, many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.functions import boxes as B


def within(a: DataFrame, b: DataFrame, key: str, reach: float) -> DataFrame:
    """Pairs of points (x, y) with equal key at most `reach` apart, and distance2: each b is put in the nine cells around it."""

    def cell(c):
        return F.floor(F.col(c) / reach)

    left = a.withColumn("_gx", cell("x")).withColumn("_gy", cell("y")).withColumnsRenamed({"x": "ax", "y": "ay"})
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = b.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    right = right.withColumn("_gx", cell("x") + F.col("_dx")).withColumn("_gy", cell("y") + F.col("_dy")).drop("_dx", "_dy")
    j = left.join(right, [key, "_gx", "_gy"]).withColumn("distance2", F.pow(F.col("ax") - F.col("x"), 2) + F.pow(F.col("ay") - F.col("y"), 2))
    return j.where(F.col("distance2") <= reach * reach).drop("_gx", "_gy")


def touching(a: DataFrame, b: DataFrame, key: str, left: str, right: str, size: float = 48.0) -> DataFrame:
    """Pairs of boxes (struct columns) with equal key that overlap.

    Boxes are put in all cells of a grid that they cover; a pair meets in several and counts in the one that holds the
    corner where their overlap begins.
    """

    def cells(df, c, x, y):
        at = [F.sequence(F.floor(F.col(f"{c}.{k}1") / size), F.floor(F.col(f"{c}.{k}2") / size)) for k in ("x", "y")]
        return df.withColumn(x, F.explode(at[0])).withColumn(y, F.explode(at[1]))

    j = cells(a, left, "_gx", "_gy").join(cells(b, right, "_gx", "_gy"), [key, "_gx", "_gy"])
    begins = [F.floor(F.greatest(F.col(f"{left}.{k}1"), F.col(f"{right}.{k}1")) / size) for k in ("x", "y")]
    return j.where((F.col("_gx") == begins[0]) & (F.col("_gy") == begins[1]) & B.touch(F.col(left), F.col(right))).drop("_gx", "_gy")


def by_board(rows: DataFrame) -> DataFrame:
    """Rows dealt by board over as many tasks as the session shuffles to. Kernels cost time, not bytes, so small tables are not to be put into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "board_id")


def in_runs(rows: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Whole boards through a kernel, as many at a time as a batch holds: one shuffle, and the cost of a call is shared by its boards."""

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if f.empty:
                continue
            b = f.board_id.to_numpy()
            cut = int(np.searchsorted(b, b[-1]))
            if cut or (held and held[-1].board_id.iloc[-1] != b[0]):
                yield kernel(pd.concat([*held, f.iloc[:cut]], ignore_index=True))
                held = []
            held.append(f.iloc[cut:])
        if held:
            yield kernel(pd.concat(held, ignore_index=True))

    return by_board(rows.where("board_id is not null")).sortWithinPartitions("board_id").mapInPandas(runs, schema)


def near(ab: np.ndarray, ax: np.ndarray, ay: np.ndarray, bb: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of points of one board that differ by `reach` at most in x and in y; a few that differ by more may be among them.

    Points are sorted by board, strip and x, and each looks up a range in three strips.
    """
    a, b = np.flatnonzero(np.isfinite(ax) & np.isfinite(ay)), np.flatnonzero(np.isfinite(bx) & np.isfinite(by))
    none = np.empty(0, dtype=np.int64)
    if not len(a) or not len(b):
        return none, none
    height = max(reach, 1e-9)
    # boards and strips that hold a point of b, numbered in order; other places can't have a pair
    sb, sa = np.floor(by[b] / height), np.floor(ay[a] / height)
    order = np.lexsort((bx[b], sb, bb[b]))
    b, sb = b[order], sb[order]
    x, board = bx[b], bb[b]
    first = np.flatnonzero(np.r_[True, (board[1:] != board[:-1]) | (sb[1:] != sb[:-1])])
    strips = {k: i for i, k in enumerate(zip(board[first].tolist(), sb[first].tolist(), strict=True))}
    ends = np.r_[first[1:], len(b)]
    out_a, out_b = [none], [none]
    at_board, slack = ab[a].tolist(), reach * (1 + 1e-9)
    for step in (-1.0, 0.0, 1.0):
        strip = np.array([strips.get(k, -1) for k in zip(at_board, (sa + step).tolist(), strict=True)])
        i = np.flatnonzero(strip >= 0)
        # the part of a strip within reach, found by bisection of all at once
        low = _bisect(x, first[strip[i]], ends[strip[i]], ax[a[i]] - slack, "left")
        high = _bisect(x, first[strip[i]], ends[strip[i]], ax[a[i]] + slack, "right")
        n = np.maximum(high - low, 0)
        out_a.append(np.repeat(a[i], n))
        out_b.append(b[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return np.concatenate(out_a), np.concatenate(out_b)


def _bisect(x: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, side: str) -> np.ndarray:
    """`np.searchsorted` of each value in its own sorted range of x."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        there = x[np.minimum(mid, len(x) - 1)]
        right = open_ & ((there < value) if side == "left" else (there <= value))
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low
