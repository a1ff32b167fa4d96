"""Readers of placement, bill-of-material, netlist and label files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardsift.functions import text as T


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't comments, with their number in the file: file, line, value."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    cut = raw.select("file", F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("line", "value"))
    return cut.where((F.trim("value") != "") & ~F.ltrim(F.col("value")).startswith("#"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with the canonical names of its known columns, text as written, and line numbers."""
    text = lines(spark, path)
    header = text.orderBy("file", "line").select("value").first()
    if header is None:
        raise ValueError(f"{path}: no header row")
    names = next(_split(header.value))
    known = T.column_names(names)
    if "designator" not in known:
        raise ValueError(f"{path}: no designator column")
    schema = ", ".join(f"`{n}` string" for n in names)
    body = text.where(F.col("value") != header.value)
    cells = body.select("file", "line", F.from_csv("value", F.lit(schema)).alias("c"))
    quantity = next((n for n in names if n.strip().lower() in T.QUANTITY), None)
    extra = [F.col("c").getField(quantity).alias("quantity")] if quantity else []
    return cells.select("file", "line", *(F.col("c").getField(h).alias(k) for k, h in known.items()), *extra)


def _split(line: str):
    import csv as plain

    return plain.reader([line])


def _length(c: str, units: str) -> Column:
    return T.number(F.col(c), None) * T.unit_scale(F.col(c), T.UNITS.get(units, 1.0))


def _optional(df: DataFrame, name: str, default=None) -> Column:
    return F.col(name) if name in df.columns else F.lit(default).cast("string")


def placements(spark: SparkSession, path: str, units: str = "mm") -> DataFrame:
    """A row a part."""
    t = csv(spark, path)
    return t.select("designator", _length("x", units).alias("x"), _length("y", units).alias("y"), T.number(_optional(t, "rotation")).alias("rotation"), T.side(_optional(t, "side")).alias("side"), T.part_class(F.col("designator")).alias("part_class"))


def _mean(c: str) -> Column:
    """A mean that doesn't depend on the order of rows: of decimals with 12 places, unless a value has none."""
    exact = F.col(c).try_cast("decimal(28,12)")
    return F.when(F.count(exact) == F.count(c), F.avg(exact).cast("double")).otherwise(F.avg(c))


def pads(spark: SparkSession, path: str, units: str = "mm") -> DataFrame:
    """A row a part with its pads; its place is their mean, its turn their principal axis."""
    t = csv(spark, path)
    p = t.select("designator", "pin", _length("x", units).alias("x"), _length("y", units).alias("y"), T.side(_optional(t, "side")).alias("side"))
    turn = F.bround(F.degrees(0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))), 6)
    turn = F.when(turn == -90, 90.0).otherwise(turn)  # one axis; the sign of a covariance of zero is an error in its last bit
    return p.groupBy("designator").agg(_mean("x").alias("x"), _mean("y").alias("y"), turn.alias("rotation"), F.array_sort(F.collect_list(F.struct("pin", "x", "y"))).alias("pads"), F.min("side").alias("side")).orderBy("designator")


def bom(spark: SparkSession, path: str, units: str = "mm") -> DataFrame:
    """An entry for each designator, the first of repeated ones; positions that aren't given are null."""
    t = csv(spark, path)
    near = F.coalesce(*([T.unit_scale(F.col("x"), T.UNITS.get(units, 1.0))] if "x" in t.columns else []), F.lit(T.UNITS.get(units, 1.0)))

    def size(name):
        return T.number(_optional(t, name), None) * near

    d = t.select("line", F.posexplode(T.designators(F.col("designator"))).alias("place", "designator"), F.size(T.designators(F.col("designator"))).alias("listed"), T.number(_optional(t, "quantity"), None).alias("declared"),
                 _optional(t, "value").alias("value"), _optional(t, "footprint").alias("footprint"), size("x").alias("x"), size("y").alias("y"), size("width").alias("width"), size("height").alias("height"), T.side(_optional(t, "side")).alias("side"))
    w = W.partitionBy(F.upper("designator")).orderBy("line", "place")
    return d.withColumn("nth", F.row_number().over(w)).withColumn("part_class", T.part_class(F.col("designator"))).withColumn("quantity_differs", F.coalesce(F.col("declared").cast("int") != F.col("listed"), F.lit(False)))


def ipc356(spark: SparkSession, path: str) -> DataFrame:
    """Test points of a netlist: designator, pin, net, x, y in millimetres, side."""
    t = lines(spark, path)
    unit = F.regexp_extract("value", r"^P\s+UNITS\s+CUST\s+(\d)", 1)
    scale = F.when(unit == "0", 0.00254).when(unit == "1", 0.001).when(unit == "2", 0.00254)
    t = t.withColumn("scale", F.last(scale, True).over(W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)))
    r = t.where(F.substring("value", 1, 3).isin("317", "327", "367"))
    at = r"X([+-]\d+)Y([+-]\d+)"
    ref = r"([A-Za-z]+\d+)\s*-\s*(\w+)"
    tail = F.substring("value", 18, 200)
    name = F.when(F.regexp_extract(tail, ref, 1) != "", F.regexp_extract(tail, ref, 1)).otherwise(F.regexp_extract("value", ref, 1))
    pin = F.when(F.regexp_extract(tail, ref, 1) != "", F.regexp_extract(tail, ref, 2)).otherwise(F.regexp_extract("value", ref, 2))
    s = F.coalesce("scale", F.lit(0.00254))
    return r.select(name.alias("designator"), pin.alias("pin"), F.trim(F.substring("value", 4, 14)).alias("net"), (F.regexp_extract("value", at, 1).cast("double") * s).alias("x"), (F.regexp_extract("value", at, 2).cast("double") * s).alias("y"),
                    F.when(F.regexp_extract("value", r"A(\d\d)", 1) == "02", "bottom").otherwise("top").alias("side")).where("designator <> ''")


def board_json(spark: SparkSession, path: str) -> DataFrame:
    """Parts of saved boards, a row a part and pad; parts without pads stay."""
    schema = "units string, components array<struct<designator:string,x:double,y:double,rotation:double,side:string,pads:array<struct<pin:string,x:double,y:double>>>>"
    b = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("components").alias("c"))
    return b.select("c.designator", "c.x", "c.y", "c.side", F.explode_outer("c.pads").alias("p")).select("designator", "x", "y", "side", F.col("p.pin").alias("pin"), F.col("p.x").alias("pad_x"), F.col("p.y").alias("pad_y"))


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pads_csv": pads, "placement_csv": placements, "ipc356": ipc356, "cad_json": board_json, "bom": bom}


def sniffed(spark: SparkSession, path: str) -> str:
    """What a placement file is, by its name and first lines."""
    if path.endswith(".json"):
        return "cad_json"
    head = [r.value for r in lines(spark, path).orderBy("line").limit(40).collect()]
    if head and head[0].lstrip().startswith("{"):
        return "cad_json"
    if any(x[:3] in ("317", "327", "367") or x.startswith("P  UNITS") or x.startswith("P UNITS") for x in head):
        return "ipc356"
    known = T.column_names(next(_split(head[0]))) if head else {}
    if "pin" in known and "designator" in known:
        return "pads_csv"
    if "designator" in known and "x" in known:
        return "placement_csv"
    raise ValueError(f"{path}: not a known placement format")


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return LOADERS[kind or sniffed(spark, path)](spark, path)


def layout(files: DataFrame) -> DataFrame:
    """How a data set is laid out, by the heads of its files (path, head): root, layout."""
    j, h = F.col("path").endswith(".json"), F.col("head")
    rank = (
        F.when(j & h.contains('"annotations"') & h.contains('"images"'), 5)
        .when(j & h.contains('"shapes"'), 4)
        .when(F.col("path").endswith(".txt") & h.rlike(r"^\d+( [0-9.]+){4}"), 3)
        .when(F.col("path").endswith(".csv"), 2)
        .when(F.col("path").rlike(r"\.(png|jpe?g|bmp)$"), 1)
        .otherwise(0)
    )
    name = F.element_at(F.array(*map(F.lit, ("unknown", "folder_per_class", "csv", "yolo", "labelme", "coco"))), F.max(rank) + 1)
    return files.groupBy(F.regexp_extract("path", "^([^/]*)/", 1).alias("root")).agg(name.alias("layout"))


def coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations with their image and class name, whole-pixel corners."""
    schema = "images array<struct<id:long,file_name:string>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>>>, categories array<struct<id:long,name:string>>"
    c = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("in_file"), "images", "annotations", "categories")
    images = c.select("in_file", F.explode("images").alias("i")).select("in_file", F.col("i.id").alias("image_id"), "i.file_name")
    names = c.select("in_file", F.explode("categories").alias("k")).select("in_file", F.col("k.id").alias("category_id"), "k.name")
    a = c.select("in_file", F.explode("annotations").alias("a")).select("in_file", "a.id", "a.image_id", "a.category_id", "a.bbox")
    j = a.join(images, ["in_file", "image_id"]).join(names, ["in_file", "category_id"], "left")  # numbers count within their file
    b = [F.col("bbox")[i] for i in range(4)]
    return j.select("id", "file_name", F.coalesce("name", F.lit("unknown")).alias("label"), *(v.cast("int").alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (b[0], b[1], b[0] + b[2], b[1] + b[3]), strict=True)))


def labelme(spark: SparkSession, path: str) -> DataFrame:
    """Shapes as boxes: the hull of points, a circle by its centre and a point of its rim; empty ones go."""
    s = spark.read.schema("imagePath string, shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>").json(path, multiLine=True)
    s = s.select("imagePath", F.explode("shapes").alias("s")).select("imagePath", "s.label", "s.shape_type", "s.points")
    x, y, p = F.transform("points", lambda q: q[0]), F.transform("points", lambda q: q[1]), F.col("points")
    r = F.hypot(p[1][0] - p[0][0], p[1][1] - p[0][1])
    round_ = F.col("shape_type") == "circle"
    sides = {"x1": F.when(round_, p[0][0] - r).otherwise(F.array_min(x)), "y1": F.when(round_, p[0][1] - r).otherwise(F.array_min(y)), "x2": F.when(round_, p[0][0] + r).otherwise(F.array_max(x)), "y2": F.when(round_, p[0][1] + r).otherwise(F.array_max(y))}
    return s.select(F.col("imagePath").alias("file_name"), "label", *(v.alias(k) for k, v in sides.items())).where("x2 > x1 and y2 > y1")


def yolo(spark: SparkSession, path: str, names: dict[int, str], w: int, h: int) -> DataFrame:
    """Lines `class cx cy w h`; what can't be read is left out."""
    t = lines(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("file_name"), F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") >= 5)
    n = [F.expr(f"try_cast(v[{i}] as double)") for i in range(5)]
    t = t.select("file_name", *(x.alias(f"n{i}") for i, x in enumerate(n))).where("n0 is not null and n1 is not null and n2 is not null and n3 is not null and n4 is not null")
    label = F.coalesce(F.try_element_at(T.mapped(names), F.col("n0").cast("int")), F.concat(F.lit("class_"), F.col("n0").cast("int").cast("string")))
    return t.select("file_name", label.alias("label"), ((F.col("n1") - F.col("n3") / 2) * w).alias("x1"), ((F.col("n2") - F.col("n4") / 2) * h).alias("y1"), ((F.col("n1") + F.col("n3") / 2) * w).alias("x2"), ((F.col("n2") + F.col("n4") / 2) * h).alias("y2"))


def class_of_folder(files: DataFrame) -> DataFrame:
    """Listed files by the name of their folder; folders named after splits aren't classes."""
    f = files.withColumn("label", F.element_at(F.split("path", "/"), -2))
    return f.where(~F.lower("label").isin("train", "val", "valid", "test", "images", "labels"))


def folder_classes(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return class_of_folder(f)


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """File, label and group of a table of labels, under whichever names they go; rows without a label are left out."""
    t = spark.read.csv(path, header=True)

    def first(*names):
        found = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in t.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    file = first("crop_path", "path", "file", "image")
    rows = t.select(file.alias("file"), first("defect_class", "label", "class").alias("label"), first("source_image", "board", "group").alias("group"))
    return rows.where("file is not null and label is not null").withColumn("group", F.coalesce("group", T.source_group(F.col("file"))))
