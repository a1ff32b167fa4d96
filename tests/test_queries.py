from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from boardsift import catalog
from boardsift.views import BASE

SF = "/root/testdata/sf0.001"
# a query of each kind; all of them are compared by the driver
NAMES = ["pads_csv", "board_json", "coco_rows", "labelme_rows", "manifest_rules", "model_catalog", "joints_csv", "verdicts_csv", "findings_csv", "fusion_driver", "stage_status", "best_checkpoint", "iou_pairs", "lead_assign", "group_split", "dataset_fingerprint", "ab_match", "registration", "rules_verdict_counts", "fusion_decision", "tile_plan", "nms_boxes", "bom_position_match", "lead_fusion", "source_class_cube", "ipc356_parse", "group_split", "stream_daily_counts"]


def rounded(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    got = got.select(*columns).collect()
    assert got and rounded([tuple(str(x) for x in r) if name == "source_class_cube" else tuple(r) for r in got]) == rounded([tuple(str(x) for x in r) if name == "source_class_cube" else r for r in want.fetchall()])


def test_box_cut_with_odd_boxes_matches_its_sql(spark, tmp_path):
    """Boxes without width, turned over, unknown, or covered by others."""
    con = duckdb.connect()
    for t in BASE:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    (tmp_path / "lineitem.parquet").unlink()
    odd = "case l_partkey % 6 when 0 then -10 when 1 then -25 when 2 then null when 3 then 150 else l_quantity end"
    con.execute(f"copy (select * replace ({odd} as l_quantity) from '{SF}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = con.execute(catalog.oracle_sql()["box_cut"])
    columns = [c[0] for c in want.description]
    got = catalog.queries()["box_cut"](spark, str(tmp_path))
    met = catalog.queries()["iou_pairs"](spark, str(tmp_path)).count()
    got = sorted(map(tuple, got.select(*columns).collect()))
    assert got == sorted(want.fetchall()) and 0 < len(got) < met


def test_pads_csv_with_unknown_cells_matches_its_sql(spark, tmp_path):
    """A cell that isn't known is empty, and those after it stay in their columns."""
    con = duckdb.connect()
    odd = ", ".join(f"case when (l_orderkey * 7 + l_linenumber * 3) % 11 = {i} then null else {c} end as {c}" for i, c in enumerate(("l_quantity", "l_partkey", "l_linenumber", "l_orderkey")))
    con.execute(f"copy (select * replace ({odd}) from '{SF}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = con.execute(catalog.oracle_sql()["pads_csv"])
    columns = [c[0] for c in want.description]
    got = catalog.queries()["pads_csv"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_box_cut_measures_no_slab_in_its_join_and_is_compiled(spark):
    """A join's condition is asked of every candidate, and the JVM only interprets methods of more than 8,000 bytes."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("false", "-1"), strict=True):
            spark.conf.set(n, v)
        run = catalog.queries()["box_cut"](spark, SF)._jdf.queryExecution()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode
        plan, code = (run.explainString(mode.fromString(m)) for m in ("simple", "codegen"))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert "array" not in join and "struct" not in join and "CASE" not in join
    assert "array_max" not in plan
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000


def test_without_the_tokenizer_libraries_other_queries_stay():
    """The entry point in a process where those libraries can't be imported."""
    code = """
import sys
for name in ("tokenizers", "public_tokenizers", "regex"):
    sys.modules[name] = None
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 150 and not any(n.startswith("op1_") or n == "pipeline" for n in names), len(names)
assert set(entry.oracle_sql()) <= set(names)
"""
    root = Path(__file__).parent.parent
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_items_of_the_inventory_have_a_query():
    """Every item that the README doesn't list as missing; each item of files, exports, pixels and models has one of its own."""
    catalog.queries()
    owners: dict[str, list[str]] = {}
    for name, items in catalog.COVERS.items():
        for item in items.split():
            owners.setdefault(item, []).append(name)
    most = {"S": 22, "K": 15, "P": 60, "F": 21, "J": 21, "A": 28, "W": 12, "T": 9, "U": 7, "G": 11, "I": 17, "M": 6, "R": 14, "D": 14}
    assert not [f"{k}{n}" for k, m in most.items() for n in range(1, m + 1) if f"{k}{n}" not in owners]
