"""Readers at work: files are written from the tables to the shared folder and read by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardsift import shared
from boardsift.catalog import query
from boardsift.functions import boxes as B
from boardsift.operators import gates
from boardsift.sources import assets, contracts, readers, sinks
from boardsift.views import table, view

#: Boards in a file.
FILE = "floor(board_id / 40)"
PATH_SQL = "CASE c_custkey % 5 WHEN 0 THEN 'flags/' || (c_custkey % 30) WHEN 1 THEN 'flags/./x/../' || (c_custkey % 30) WHEN 2 THEN '../flags/' || (c_custkey % 30) WHEN 3 THEN '/flags/' || (c_custkey % 30) ELSE 'flags/../../' || (c_custkey % 30) END"


@query("S3", f"""
WITH w AS (SELECT c_custkey, c_custkey % 5 AS k, {PATH_SQL} AS path FROM customer)
SELECT c_custkey, path, n_name AS content, n_name IS NOT NULL AS found FROM w LEFT JOIN nation ON k < 2 AND n_nationkey = c_custkey % 30""")
def asset_read(spark, sf_dir):
    """Names from outside against files under a root: what isn't under it, or not there, is missing."""
    n = table(spark, sf_dir, "nation")
    root = shared.text_files(n, F.col("n_nationkey"), F.col("n_nationkey"), F.col("n_name"), "assets")
    listing = assets.globbed(spark, [root]).select(F.concat(F.lit("flags/"), F.regexp_extract("path", r"file=(\d+)/", 1)).alias("path"), F.trim(F.regexp_replace(F.decode("content", "UTF-8"), "\n", " ")).alias("content")).where("path <> 'flags/'")
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.expr(PATH_SQL).alias("path"))
    return assets.read_under(wanted, "path", listing)


@query("S21", "SELECT 'n' || n_nationkey AS name, octet_length(encode(n_name)) + 1 AS bytes FROM nation")
def image_glob(spark, sf_dir):
    """Folder and glob patterns that overlap: each file once."""
    n = table(spark, sf_dir, "nation")
    root = shared.text_files(n, F.col("n_nationkey"), F.col("n_nationkey"), F.col("n_name"), "images")
    found = assets.globbed(spark, [root, f"{root}/file=1*", f"{root}/file=*/part-*"]).where("path like '%/part-%'")
    return found.select(F.concat(F.lit("n"), F.regexp_extract("path", r"file=(\d+)/", 1)).alias("name"), F.col("length").alias("bytes"))


@query("S17", """
WITH w AS (SELECT doc_id, doc_id % 40 AS k, CASE WHEN doc_id % 3 = 0 THEN 'img_' || (doc_id % 40) ELSE 'old/place/img_' || (doc_id % 40) END AS want FROM documents)
SELECT doc_id, CASE WHEN k < 25 AND doc_id % 3 = 0 AND k % 2 = 0 THEN 'second/img_' || k WHEN k < 25 THEN 'first/img_' || k END AS found FROM w""")
def image_resolver(spark, sf_dir):
    """Files under two roots, the second root first in line; other names by their last part."""
    n = table(spark, sf_dir, "nation")
    first = shared.text_files(n, F.col("n_nationkey"), F.lit(0), F.lit("x"), "first")
    second = shared.text_files(n.where("n_nationkey % 2 = 0"), F.col("n_nationkey"), F.lit(0), F.lit("x"), "second")
    name = lambda root, path: assets.globbed(spark, [path]).where("path like '%/part-%'").select(F.concat(F.lit(f"{root}/img_"), F.regexp_extract("path", r"file=(\d+)/", 1)).alias("path"))
    listing = name("first", first).unionByName(name("second", second))
    k = (F.col("doc_id") % 40).cast("string")
    wanted = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("img_"), k)).otherwise(F.concat(F.lit("old/place/img_"), k)).alias("want"))
    return assets.resolved(wanted, "want", listing, ["second", "first"]).select("doc_id", "found")


PADS = """WITH p AS (SELECT 'R' || l_orderkey AS designator, l_linenumber AS pin, l_quantity AS x, (l_partkey % 100) * 0.0254 AS y, CASE WHEN l_orderkey % 2 = 0 THEN 'bottom' ELSE 'top' END AS side FROM lineitem) """


def pad_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("board_id", F.floor(F.col("l_orderkey") / 36))
    cells = [F.concat(F.lit(" R"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"), F.concat(F.col("l_quantity").cast("string"), F.lit(" mm")), F.concat((F.col("l_partkey") % 100).cast("string"), F.lit("mil")), F.when(F.col("l_orderkey") % 2 == 0, "Bot").otherwise("T")]
    cells = [F.coalesce(c, F.lit("")) for c in cells]  # `concat_ws` leaves out what is null, and the next cell would take its column
    line = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("  # a remark\n"), F.concat_ws(",", *cells))).otherwise(F.concat_ws(",", *cells))
    return shared.text_files(li, F.expr(FILE), F.struct("l_orderkey", "l_linenumber", "l_partkey"), line, "pads", "# exported\nRef Des,Pin Number,Center X,Center-Y,Layer\n")


@query("S4 S10 P48", PADS + "SELECT designator, round_even(avg(x), 6) AS x, round_even(avg(y), 6) AS y, round_even(degrees(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))), 6) + 0.0 AS rotation, count(*) AS pads, min(side) AS side FROM p GROUP BY designator")
def pads_csv(spark, sf_dir):
    """A pad table under other names of its columns, with units in its cells and remarks between its lines.

    Means of 16 pads may lie between two values of 6 places; they are rounded as binary numbers, like in the SQL.
    """
    p = readers.pads(spark, pad_rows(spark, sf_dir))
    return p.select(F.trim("designator").alias("designator"), *((F.rint(F.col(c) * 1e6) / 1e6).alias(c) for c in "xy"), (F.col("rotation") + 0.0).alias("rotation"), F.size("pads").cast("long").alias("pads"), "side")


@query("S5 F8 P25", """SELECT 'C' || c_custkey AS designator, round_even(CAST(c_custkey % 500 AS DOUBLE) * 25.4::DOUBLE, 6) AS x, CAST(c_nationkey - 10 AS DOUBLE) AS y, CAST(c_custkey % 360 AS DOUBLE) AS rotation, 'top' AS side, 'capacitor' AS part_class FROM customer WHERE c_custkey % 3 <> 0""")
def placement_csv(spark, sf_dir):
    """A placement table in inches and millimetres; parts on top."""
    c = table(spark, sf_dir, "customer")
    cells = [F.concat(F.lit("C"), F.col("c_custkey").cast("string")), F.concat((F.col("c_custkey") % 500).cast("string"), F.lit("in")), F.concat((F.col("c_nationkey") - 10).cast("string"), F.lit(" mm")), (F.col("c_custkey") % 360).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "back").otherwise("Top Side")]
    path = shared.text_files(c, F.floor(F.col("c_custkey") / 2000), F.col("c_custkey"), F.concat_ws(",", *cells), "placements", "Designator,Mid X,Mid Y,Rotation,TB\n")
    p = readers.placements(spark, path).where("side = 'top'")
    return p.select("designator", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"), F.bround("rotation", 6).alias("rotation"), "side", "part_class")


@query("S7", """
SELECT 'U' || o_orderkey AS designator, CAST(o_custkey % 300 AS DOUBLE) AS x, CAST(o_orderkey % 200 AS DOUBLE) AS y, 'top' AS side, CAST(l_linenumber AS VARCHAR) AS pin, l_quantity AS pad_x, CAST(l_partkey % 50 AS DOUBLE) AS pad_y
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderkey % 4 <> 0""")
def board_json(spark, sf_dir):
    """Saved boards: parts with their pads, and parts without any."""
    pads = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("pin"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 50).cast("double").alias("y"))).alias("pads"))
    o = table(spark, sf_dir, "orders").join(pads, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    part = F.to_json(F.struct(F.concat(F.lit("U"), F.col("o_orderkey").cast("string")).alias("designator"), (F.col("o_custkey") % 300).cast("double").alias("x"), (F.col("o_orderkey") % 200).cast("double").alias("y"), F.lit("top").alias("side"), "pads"))
    path = shared.text_files(o, F.floor(F.col("o_orderkey") / 4000), F.col("o_orderkey"), part, "boards", '{"units": "mm", "components": [', "]}", ",")
    return readers.board_json(spark, path)


@query("S8", "SELECT * FROM (VALUES ('pads_csv', 'pads_csv', 25), ('placement_csv', 'placement_csv', 25), ('ipc356', 'ipc356', 25), ('cad_json', 'cad_json', 25), ('nonsense', 'error', 0)) t(written, found, parts)")
def format_sniffing(spark, sf_dir):
    """Each format is told from the file itself and loaded by its reader; what is none of them is an error."""
    n = table(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey").cast("string"), F.concat(F.lit("R"), F.col("n_nationkey").cast("string"))
    lines = {
        "pads_csv": (F.concat_ws(",", name, F.lit("1"), k, k), "ref,pin,x,y\n", "", "\n"),
        "placement_csv": (F.concat_ws(",", name, k, k), "ref,x,y\n", "", "\n"),
        "ipc356": (F.concat(F.lit("317NET00000000000   "), name, F.lit("   -1     A01X+0100Y-0200")), "P  UNITS CUST 1\n", "", "\n"),
        "cad_json": (F.to_json(F.struct(name.alias("designator"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))), '{"units": "mm", "components": [', "]}", ","),
        "nonsense": (k, "colour,taste\n", "", "\n"),
    }
    rows = []
    for kind, (line, head, tail, between) in lines.items():
        path = shared.text_files(n, F.lit(0), F.col("n_nationkey"), line, "sniffed", head, tail, between)
        try:
            rows.append((kind, readers.sniffed(spark, path), readers.load(spark, path).count()))
        except ValueError:
            rows.append((kind, "error", 0))
    return spark.createDataFrame(rows, "written string, found string, parts int")


LAYOUTS = {
    "coco": ("a.json", '{"images": [], "annotations": []}'), "labelme": ("b.json", '{"shapes": []}'), "yolo": ("c.txt", "3 0.5 0.5 0.1 0.2"), "csv": ("d.csv", "crop_path,label"),
    "folder_per_class": ("e.png", "x"), "unknown": ("f.md", "notes"),
}


@query("S11", "SELECT * FROM (VALUES ('coco', 'coco'), ('labelme', 'labelme'), ('yolo', 'yolo'), ('csv', 'csv'), ('folder_per_class', 'folder_per_class'), ('unknown', 'unknown'), ('mixed', 'coco')) t(root, layout)")
def layout_probe(spark, sf_dir):
    """Folders of files of one kind each, and one of all kinds: what each is, from the heads of its files."""
    path = shared.folder(spark, "layouts")
    for root, names in {**{k: [k] for k in LAYOUTS}, "mixed": list(LAYOUTS)}.items():
        for k in names:
            shared.bytes_file(spark, f"{path}/{root}/{LAYOUTS[k][0]}", LAYOUTS[k][1].encode())
    found = assets.globbed(spark, [path]).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), F.decode(F.substring("content", 1, 4096), "UTF-8").alias("head"))
    return readers.layout(found)


@query("S12", "SELECT DISTINCT label FROM det UNION SELECT 'val_like'", ("det",))
def folder_classes(spark, sf_dir):
    """Classes by folder; folders of splits aren't classes."""
    d = view(spark, sf_dir, "det").select("label").distinct()
    names = d.unionByName(spark.createDataFrame([("val_like",), ("train",), ("VAL",)], "label string"))
    path = shared.folder(spark, "classes")
    names.select(F.lit("x").alias("value"), "label").write.partitionBy("label").text(path)
    files = assets.globbed(spark, [path]).where("path like '%/part-%'").select(F.regexp_replace("path", "label=", "").alias("path"), "length")
    return readers.class_of_folder(files).select("label").distinct()


@query("S13 J2", """SELECT board_id * 1000 + no AS id, 'board_' || board_id || '.png' AS file_name, CASE WHEN class_id < 7 THEN label ELSE 'unknown' END AS label, CAST(trunc(x1) AS INT) AS x1, CAST(trunc(y1) AS INT) AS y1, CAST(trunc(x2) AS INT) AS x2, CAST(trunc(y2) AS INT) AS y2 FROM det WHERE board_id % 9 <> 0""", ("det",))
def coco_rows(spark, sf_dir):
    """Annotations of images that are listed, with the names of classes that are listed."""
    d = view(spark, sf_dir, "det").withColumn("board_id", F.col("board_id").cast("long"))
    image = F.struct(F.col("board_id").alias("id"), F.format_string("board_%d.png", "board_id").alias("file_name"))
    box = F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    note = F.struct((F.col("board_id") * 1000 + F.col("no")).alias("id"), F.col("board_id").alias("image_id"), F.col("class_id").alias("category_id"), box.alias("bbox"))
    kind = F.struct(F.col("class_id").alias("id"), F.col("label").alias("name"))
    doc = F.to_json(F.struct(F.collect_set(F.when(F.col("board_id") % 9 != 0, image)).alias("images"), F.collect_list(note).alias("annotations"), F.collect_set(F.when(F.col("class_id") < 7, kind)).alias("categories")))
    path = shared.folder(spark, "coco")
    d.groupBy(F.expr(FILE).alias("file")).agg(doc.alias("value")).write.partitionBy("file").text(path)
    return readers.coco(spark, path)


@query("S14", """SELECT 'board_' || board_id || '.png' AS file_name, label, CASE WHEN no % 3 = 0 THEN x1 - 5 ELSE x1 END AS x1, CASE WHEN no % 3 = 0 THEN y1 - 5 ELSE y1 END AS y1, CASE WHEN no % 3 = 0 THEN x1 + 5 ELSE x2 END AS x2, CASE WHEN no % 3 = 0 THEN y1 + 5 ELSE y2 END AS y2 FROM det WHERE no % 3 = 0 OR no % 10 <> 1""", ("det",))
def labelme_rows(spark, sf_dir):
    """Rectangles by two corners, polygons, circles by centre and rim; shapes without an area go."""
    at = lambda x, y: F.array(F.col(x), F.col(y))
    third, flat = F.col("no") % 3, F.col("no") % 10 == 1
    points = F.when(third == 0, F.array(at("x1", "y1"), F.array(F.col("x1") + 3, F.col("y1") + 4))).when(flat, F.array(at("x1", "y1"), at("x1", "y2"))).when(third == 1, F.array(at("x2", "y2"), at("x1", "y1"))).otherwise(F.array(at("x1", "y2"), at("x2", "y1"), at("x2", "y2"), at("x1", "y1")))
    d = view(spark, sf_dir, "det").withColumn("s", F.struct("label", F.when(third == 0, "circle").when(third == 1, "rectangle").otherwise("polygon").alias("shape_type"), points.alias("points")))
    doc = F.to_json(F.struct(F.format_string("board_%d.png", "board_id").alias("imagePath"), F.collect_list("s").alias("shapes")))
    boards = d.groupBy("board_id").agg(doc.alias("doc"))
    return readers.labelme(spark, shared.text_files(boards, F.expr(FILE), F.col("board_id"), F.col("doc"), "labelme", "[", "]", ","))


@query("S16 P59", """
SELECT coalesce(CASE class_id WHEN 0 THEN 'r' WHEN 1 THEN 'c' END, 'class_' || class_id) AS label, round_even((cx - w / 2) * 250, 4) AS x1, round_even((cy - h / 2) * 250, 4) AS y1, round_even((cx + w / 2) * 250, 4) AS x2, round_even((cy + h / 2) * 250, 4) AS y2 FROM (
  SELECT class_id, CAST(format('{:.6f}', (x1 + x2) / 2 / 250) AS DOUBLE) AS cx, CAST(format('{:.6f}', (y1 + y2) / 2 / 250) AS DOUBLE) AS cy, CAST(format('{:.6f}', (x2 - x1) / 250) AS DOUBLE) AS w, CAST(format('{:.6f}', (y2 - y1) / 250) AS DOUBLE) AS h FROM det) t""", ("det",))
def yolo_rows(spark, sf_dir):
    """Label files with lines that can't be read, and classes without a name."""
    line = F.concat(sinks.yolo_line(F.col("class_id"), B.of(), 250, 250), F.when(F.col("no") % 5 == 0, "\nnot a box\n1 0.5 0.5\n3 a b c d").otherwise(""))
    path = shared.text_files(view(spark, sf_dir, "det"), F.expr(FILE), F.struct("board_id", "no"), line, "yolo")
    return readers.yolo(spark, path, {0: "r", 1: "c"}, 250, 250).select("label", *(F.bround(k, 4).alias(k) for k in B.SIDES))


@query("S18", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'wrong_version' WHEN 2 THEN 'wrong_version' WHEN 3 THEN 'missing:production' WHEN 4 THEN 'malformed' ELSE 'missing:name' END AS status FROM events""")
def versioned_documents(spark, sf_dir):
    """Saved documents: right, of another version, of none, with a text for a boolean, broken, and with a field missing."""
    k, name = F.col("event_id") % 6, F.col("event_type")
    doc = (
        F.when(k == 1, F.format_string('{"schema_version": "recipe/0.9", "name": "%s", "production": true}', name))
        .when(k == 2, F.format_string('{"name": "%s", "production": true}', name))
        .when(k == 3, F.format_string('{"schema_version": "recipe/1.1", "name": "%s", "production": "true"}', name))
        .when(k == 4, F.format_string('{"schema_version": "recipe/1.1", "name": "%s", ', name))
        .when(k == 5, F.lit('{"schema_version": "recipe/1.1", "production": false}'))
        .otherwise(F.format_string('{"schema_version": "recipe/1.1", "name": "%s", "production": false}', name))
    )
    return table(spark, sf_dir, "events").select("event_id", contracts.status(doc, "schema_version string, name string, production boolean", "recipe/1.1", ("name", "production")).alias("status"))


@query("S19", """
SELECT p_partkey, CASE p_partkey % 9 WHEN 1 THEN 'malformed' WHEN 2 THEN 'no_classes' WHEN 3 THEN 'repeated_class' WHEN 4 THEN 'unknown_task' WHEN 5 THEN 'threshold_range' WHEN 6 THEN 'threshold_order' WHEN 7 THEN 'wrong_digest' WHEN 8 THEN 'too_large' END AS fault FROM part""")
def manifest_rules(spark, sf_dir):
    """A model's manifest for each part, most of them broken in one way."""
    k, digest = F.col("p_partkey") % 9, F.sha2("p_name", 256)
    text = F.format_string(
        '{"classes": %s, "task": "%s", "accept_threshold": %s, "review_threshold": %s, "sha256": "%s"}%s',
        F.when(k == 2, "[]").when(k == 3, '["a", "b", "a"]').otherwise('["a", "b"]'),
        F.when(k == 4, "cooking").otherwise("solder"),
        F.when(k == 5, "1.5").otherwise("0.8"),
        F.when(k == 6, "0.9").otherwise("0.5"),
        F.when(k == 7, "0").otherwise(digest),
        F.when(k == 8, F.repeat(F.lit(" "), 1 << 20)).otherwise(""),
    )
    return table(spark, sf_dir, "part").select("p_partkey", contracts.manifest_fault(F.when(k == 1, F.substring(text, 1, 30)).otherwise(text), digest).alias("fault"))


CATALOG_SQL = "CASE p_partkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'library' ELSE 'archive' END || '/' || CASE p_size % 2 WHEN 0 THEN 'component' ELSE 'solder' END || '/g' || (p_partkey % 50)"


@query("S20 J13 T3", f"""
WITH f AS (SELECT p_partkey, {CATALOG_SQL} AS dir, 'm' || p_partkey AS stem, p_size AS created FROM part),
g AS (SELECT DISTINCT dir FROM f WHERE p_partkey % 7 = 0)
SELECT f.dir || '/' || stem || '.onnx' AS path, split_part(f.dir, '/', 2) AS kind, CASE WHEN p_partkey % 4 = 0 THEN f.dir || '/' || stem || '.json' WHEN p_partkey % 4 = 1 THEN f.dir || '/' || stem || '.manifest.json' WHEN g.dir IS NOT NULL THEN f.dir || '/manifest.json' END AS manifest,
  row_number() OVER (PARTITION BY split_part(f.dir, '/', 2) ORDER BY CASE split_part(f.dir, '/', 1) WHEN 'active' THEN 0 WHEN 'library' THEN 1 ELSE 2 END, created DESC, f.dir || '/' || stem || '.onnx') AS place
FROM f LEFT JOIN g ON f.dir = g.dir""")
def model_catalog(spark, sf_dir):
    """A listing of models and of manifests beside them, under any of three names."""
    from pyspark.sql import Window as W

    f = table(spark, sf_dir, "part").select("p_partkey", F.expr(CATALOG_SQL).alias("dir"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("stem"), F.col("p_size").alias("created"))
    row = lambda df, *name: df.select(F.concat("dir", F.lit("/"), *name).alias("path"), "created")
    shared_one = f.where("p_partkey % 7 = 0").groupBy("dir").agg(F.max("created").alias("created"))
    listing = row(f, F.col("stem"), F.lit(".onnx")).unionByName(row(f.where("p_partkey % 4 = 0"), F.col("stem"), F.lit(".json"))).unionByName(row(f.where("p_partkey % 4 = 1"), F.col("stem"), F.lit(".manifest.json"))).unionByName(row(shared_one, F.lit("manifest.json")))
    place = F.row_number().over(W.partitionBy("kind").orderBy(assets.origin_rank(F.col("origin")), F.desc("created"), "path"))
    return assets.models(listing).select("path", "kind", "manifest", place.alias("place"))


@query("S22", """SELECT page_id, octet_length(encode(html)) * 9000 <= 67108864 AND (page_id % 90) * 100 * (page_id % 70) * 100 <= 50000000 AS accepted, (page_id % 90) * 100 < 1280 OR (page_id % 70) * 100 < 960 AS small FROM pages""")
def upload_gates(spark, sf_dir):
    """Bytes and pixels of an upload, and whether its resolution is low."""
    p = table(spark, sf_dir, "pages")
    w, h = F.col("page_id") % 90 * 100, F.col("page_id") % 70 * 100
    accepted, small = gates.upload(F.octet_length("html").cast("long") * 9000, w, h)
    return p.select("page_id", accepted.alias("accepted"), small.alias("small"))
