"""Inspection tables derived from the driver's tables, in SQL that Spark and DuckDB read alike.

Boards are ranges of order keys, so their number grows with the data and their size doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boardsift import shared

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_ALL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

#: name -> (views it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "li": ((), f"""
        SELECT *, CAST(floor(l_orderkey / 36) AS INT) AS board_id,
          CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 36) ORDER BY {_ALL}) AS INT) AS no
        FROM (SELECT DISTINCT {_ALL} FROM lineitem) t"""),
    "det": (("li",), """
        SELECT board_id, no, CONCAT('d', CAST(no AS VARCHAR(9))) AS detection_id,
          CASE l_partkey % 8 WHEN 0 THEN 'resistor' WHEN 1 THEN 'capacitor' WHEN 2 THEN 'ic' WHEN 3 THEN 'led' WHEN 4 THEN 'diode'
            WHEN 5 THEN 'connector' WHEN 6 THEN 'pads' ELSE 'component_candidate' END AS label,
          CAST(l_partkey % 8 AS INT) AS class_id, 0.5 + l_discount * 5 AS confidence,
          CAST((l_partkey * 37 + l_linenumber * 11) % 200 AS DOUBLE) AS x1, CAST((l_suppkey * 53 + l_linenumber * 17) % 150 AS DOUBLE) AS y1,
          CAST((l_partkey * 37 + l_linenumber * 11) % 200 AS DOUBLE) + 10 + l_quantity AS x2,
          CAST((l_suppkey * 53 + l_linenumber * 17) % 150 AS DOUBLE) + 8 + l_partkey % 20 AS y2
        FROM li"""),
    "feat": (("li",), """
        SELECT board_id, no, CAST(floor(no / 4) AS INT) AS part_no, CONCAT('j', CAST(no AS VARCHAR(9))) AS joint_id,
          CASE WHEN no % 9 = 0 THEN 'body' ELSE 'joint' END AS kind,
          CASE WHEN floor(no / 4) % 3 = 0 THEN 'two_terminal' ELSE 'multi_pin' END AS geometry,
          CONCAT(CASE WHEN floor(no / 4) % 2 = 0 THEN 'top' ELSE 'left' END, '_pin', CAST(no % 4 AS VARCHAR(9))) AS position,
          CAST(no % 4 AS INT) AS pin_index,
          l_discount * 10 AS solder_ratio, l_quantity / 50 AS span_ratio, l_tax / 4 AS specular_ratio, l_tax AS contrast,
          CAST(l_partkey % 100 AS DOUBLE) / 100 AS centroid_offset_ratio, CAST(l_suppkey % 100 AS DOUBLE) / 100 AS edge_contact_start,
          CAST(l_partkey % 64 AS DOUBLE) / 64 AS edge_contact_end, CAST(l_partkey % 7 AS INT) AS model_no,
          CAST(l_suppkey % 41 AS DOUBLE) / 40 AS model_probability
        FROM li"""),
    "cad": (("det",), """
        SELECT board_id, no AS cad_no, CONCAT(CASE class_id WHEN 0 THEN 'R' WHEN 1 THEN 'C' WHEN 2 THEN 'U' WHEN 3 THEN 'LED' WHEN 4 THEN 'D' WHEN 5 THEN 'J' WHEN 6 THEN 'TP' ELSE 'ZZ' END, CAST(no AS VARCHAR(9))) AS designator,
          CASE WHEN no % 13 = 0 THEN 'relay' ELSE CASE class_id WHEN 7 THEN 'unknown' ELSE label END END AS part_class,
          (x1 + x2) / 2 + CASE WHEN no % 7 = 0 THEN 3.0 ELSE 0.25 END + CASE WHEN no % 11 = 0 THEN 5000.0 ELSE 0.0 END AS cx,
          (y1 + y2) / 2 + CASE WHEN no % 7 = 0 THEN 2.0 ELSE 0.5 END AS cy
        FROM det WHERE no % 10 <> 0"""),
    "logit": (("li",), """
        SELECT board_id, no, k, CAST((no * 7919 + board_id * 31 + k * 104729) % 1000 AS DOUBLE) / 100 AS z
        FROM li, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks"""),
    "tile": (("det",), """
        SELECT board_id, no, detection_id, label, class_id, confidence, x1, y1, x2, y2,
          CASE WHEN no % 4 = 0 THEN 'full' ELSE 'tile' END AS pass,
          CASE WHEN no % 4 = 0 THEN NULL ELSE CAST(floor(x1 / 100) + 2 * floor(y1 / 75) AS INT) END AS tile_id,
          100 * floor(x1 / 100) - 20 AS tx1, 75 * floor(y1 / 75) - 20 AS ty1, 100 * floor(x1 / 100) + 120 AS tx2, 75 * floor(y1 / 75) + 95 AS ty2
        FROM det"""),
    "sample": ((), """
        SELECT d.doc_id, d.source, CONCAT(d.lang, CASE WHEN l.toxic = 1 THEN '-Toxic!' WHEN d.doc_id % 5 = 0 THEN ' Raw' ELSE '' END) AS raw_label,
          CASE WHEN d.doc_id % 10 < 6 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
          CONCAT('img_', CAST(d.doc_id % 300 AS VARCHAR(9))) AS image, l.quality, l.toxic, d.n_chars,
          CAST(d.n_chars % 640 AS INT) AS width, CAST(d.doc_id % 480 AS INT) AS height, d.text
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
}


def _order(names: tuple[str, ...] | list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_order(VIEWS[n][0]), n]:
            if x not in out:
                out.append(x)
    return out


def base(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names or BASE:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


#: Where a derived table was written, by application and folder of its tables.
_WRITTEN: dict[tuple[str, str], tuple[str, StructType]] = {}


def numbered(lineitem: DataFrame) -> DataFrame:
    """The view `li` with one shuffle: equal rows are of one board, so dealt by board they are found and numbered in one place."""
    columns = _ALL.split(", ")
    rows = lineitem.select(*columns, F.floor(F.col("l_orderkey") / 36).alias("board")).repartition("board").distinct()
    no = F.row_number().over(Window.partitionBy("board").orderBy(*columns))
    return rows.select(*columns, F.col("board").cast("int").alias("board_id"), no.cast("int").alias("no"))


def _li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`li` costs a shuffle of the whole table and most views start from it, so an application writes it once, while the files are there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN or not shared.exists(spark, _WRITTEN[key][0]):
        rows, path = numbered(table(spark, sf_dir, "lineitem")), shared.folder(spark, "li")
        with shared.shuffles_removed(spark):
            rows.write.parquet(path)
        _WRITTEN[key] = path, rows.schema
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base(spark, sf_dir)
    order = _order([name])
    if "li" in order:
        _li(spark, sf_dir).createOrReplaceTempView("li")
        order.remove("li")
    return spark.sql(("WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order) if order else "") + f" SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(sql: str, *names: str) -> str:
    """DuckDB query over the views."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in _order(names))
    sql = sql.strip()
    if not ctes:
        return sql
    return f"WITH RECURSIVE {ctes}, {sql[5:].removeprefix('RECURSIVE ')}" if sql.upper().startswith("WITH ") else f"WITH {ctes} {sql}"
