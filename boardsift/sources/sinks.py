"""Text of exported tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsift.functions import boxes as B
from boardsift.functions import text as T


def yolo_line(class_id: Column, b: Column, w: int, h: int) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, B.center_x(b) / w, B.center_y(b) / h, B.width(b) / w, B.height(b) / h)


def fixed(c: Column, digits: int) -> Column:
    """Fixed decimals; nothing for null."""
    return F.when(c.isNull(), "").otherwise(F.format_string(f"%.{digits}f", c) if digits else c.cast("string"))


def csv_lines(rows: DataFrame, columns: dict[str, Column], guard: bool = True) -> DataFrame:
    """One column `line`: cells joined by commas, quoted where they must be, kept from being taken for formulas."""

    def cell(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        c = T.guarded_cell(c) if guard else c
        return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return rows.select(F.concat_ws(",", *(cell(c) for c in columns.values())).alias("line"))


def publish(rows: DataFrame, path: str) -> None:
    """Write as a whole or not at all, and never over something."""
    rows.write.mode("errorifexists").parquet(path)


def bundles(rows: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """A ZIP archive a key, of its named texts in name order: key, files, archive. Equal rows give equal bytes."""
    import io
    import zipfile

    import pandas as pd

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for n, c in sorted(zip(pdf[name], pdf[content], strict=True)):
                z.writestr(zipfile.ZipInfo(n), c)
        return pd.DataFrame([[pdf[key].iloc[0], len(pdf), out.getvalue()]], columns=[key, "files", "archive"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, name, content).groupBy(key).applyInPandas(kernel, f"{key} {kind}, files int, archive binary")
