"""Records of foreign shape, read by the names their fields may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of a box and of a confidence.
BOX, SCORE = ("bbox", "xyxy", "box", "bounds"), ("confidence", "score", "conf", "probability", "prob")


def coerced(rows: DataFrame, json: str, keys: list[str], w: int, h: int) -> DataFrame:
    """Box in whole pixels, inside the image and one pixel wide and high at least, and the score; the first name that is there counts."""

    def first(names, tail=""):
        return F.coalesce(*(F.get_json_object(json, f"$.{n}{tail}") for n in names)).cast("double")

    def side(name, low, high):
        return F.least(F.greatest(F.bround(first(BOX, f".{name}"), 0), F.lit(low)), F.lit(high)).cast("int")

    x1, y1 = side("x1", 0, w - 1), side("y1", 0, h - 1)
    x2, y2 = F.greatest(side("x2", 0, w), x1 + 1), F.greatest(side("y2", 0, h), y1 + 1)
    return rows.select(*keys, x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), first(SCORE).alias("score"))
