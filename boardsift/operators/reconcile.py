"""What should be on a board against what is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.functions import boxes as B
from boardsift.functions import text as T
from boardsift.operators import assign
from boardsift.operators.assign import greedy
from boardsift.operators.spatial import within


def by_count(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Class by class, where positions aren't known: what is short and what is too much."""
    e = expected.where(T.informative(F.col("part_class"))).groupBy("board_id", "part_class").agg(F.count("*").alias("want"))
    o = observed.where(T.informative(F.col("label"))).groupBy("board_id", F.col("label").alias("part_class")).agg(F.count("*").alias("got"))
    j = e.join(o, ["board_id", "part_class"], "full").na.fill(0, ["want", "got"]).where("want <> got")
    return j.select("*", F.when(F.col("got") < F.col("want"), "missing").otherwise("unexpected").alias("kind"))


def candidates(placements: DataFrame, found: DataFrame, reach: float, penalty: float = 0.0, keep: int | None = None) -> DataFrame:
    """Pairs close enough, with their cost: a class that differs counts `penalty` times the reach."""
    c = placements.select("board_id", "cad_no", "part_class", F.col("cx").alias("x"), F.col("cy").alias("y"))
    d = found.select("board_id", "no", "label", B.center_x(B.of()).alias("x"), B.center_y(B.of()).alias("y"))
    j = within(c, d, "board_id", reach)
    cost = F.bround(F.sqrt("distance2"), 9) + F.when(T.agree(F.col("part_class"), F.col("label")), 0.0).otherwise(penalty * reach)
    return j.select("board_id", "cad_no", "no", "part_class", "label", cost.alias("cost"))


def matched(placements: DataFrame, found: DataFrame, reach: float, penalty: float = 0.5) -> DataFrame:
    """One to one, cheapest first: board_id, cad_no, no."""
    return greedy(candidates(placements, found, reach, penalty), "board_id", "cad_no", "no", "cost")


def met(placements: DataFrame, found: DataFrame, pads: DataFrame, boards: DataFrame, reach: float, penalty: float = 0.5) -> DataFrame:
    """Every placement and detection of the given boards once, pairs of `matched` in one row.

    board_id, cad_no or null, no or null, part_class and label (as `text.class_word` gives them), pads (null where not given), dx and dy
    from placement to detection, scale. All that a board has comes to one place by a single shuffle and is paired there.
    """
    def some(df, kind, id=F.lit(None), word=F.lit(None), x=F.lit(None), y=F.lit(None), value=F.lit(None)):
        return df.select("board_id", F.lit(kind).cast("byte").alias("kind"), id.cast("int").alias("id"), word.cast("string").alias("word"), x.cast("double").alias("x"), y.cast("double").alias("y"), value.cast("double").alias("value"))

    rows = some(boards, 0, value=F.col("scale")).unionByName(some(pads, 1, id=F.col("cad_no"), value=F.col("pads")))
    rows = rows.unionByName(some(placements, 2, id=F.col("cad_no"), word=T.class_word(F.col("part_class")), x=F.col("cx"), y=F.col("cy")))
    rows = rows.unionByName(some(found, 3, id=F.col("no"), word=T.class_word(F.col("label")), x=B.center_x(B.of()), y=B.center_y(B.of())))
    return assign.pairs_met(rows, reach, penalty)


def findings(placements: DataFrame, found: DataFrame, reach: float, shift: float, complete: bool = True) -> DataFrame:
    """missing, unexpected, class_mismatch and shifted, with their severity."""
    pairs = matched(placements, found, reach)
    p = pairs.join(placements, ["board_id", "cad_no"]).join(found, ["board_id", "no"])
    away = F.hypot(F.col("cx") - B.center_x(B.of()), F.col("cy") - B.center_y(B.of()))
    none = F.lit(None).cast("int")

    def rows(df, kind, severity, cad="cad_no", no="no"):
        return df.select("board_id", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), (F.col(cad) if cad else none).alias("cad_no"), (F.col(no) if no else none).alias("no"))

    return (
        rows(placements.join(pairs, ["board_id", "cad_no"], "left_anti"), "missing", "error", no=None)
        .unionByName(rows(found.join(pairs, ["board_id", "no"], "left_anti"), "unexpected", "error" if complete else "info", cad=None))
        .unionByName(rows(p.where(~T.agree(F.col("part_class"), F.col("label"))), "class_mismatch", "warning"))
        .unionByName(rows(p.where(away > shift), "shifted", "review"))
    )
