from __future__ import annotations

import json
import time
from itertools import permutations

import pytest

from boardsift.sources import readers


def test_pads_and_placements(spark, tmp_path):
    p = tmp_path / "pads.csv"
    p.write_text("﻿# made by hand\ndesignator,pin,x_mm,y_mm,side\n  # more\nR1,1,0,0,top\nR1,2,2,0,top\nU1,1,5mm,1,Bottom\n", encoding="utf-8")
    assert readers.sniffed(spark, str(p)) == "pads_csv"
    r1, u1 = readers.load(spark, str(p)).collect()
    assert (r1.designator, r1.x, r1.y, len(r1.pads), r1.rotation) == ("R1", 1.0, 0.0, 2, 0.0)
    assert u1.side == "bottom"
    q = tmp_path / "place.csv"
    q.write_text("Designator,Mid X,Mid Y,Rotation,Layer\nR1,100mil,1,90,T\n")
    r = readers.load(spark, str(q)).first()
    assert (round(r.x, 3), r.y, r.part_class, r.side) == (2.54, 1.0, "resistor", "top")


def test_mean_of_pads_is_exact(spark, tmp_path):
    """1.3382625 mm lies between two values of 6 places, so an error in the last bit would show."""
    mils = [71, 86, 12, 77, 35, 80, 46, 88, 20, 61, 99, 3, 50, 44, 37, 34]
    for n, order in enumerate((mils, mils[::-1], sorted(mils), mils[5:] + mils[:5], sorted(mils)[::-1], mils[::2] + mils[1::2])):
        p = tmp_path / f"{n}.csv"
        p.write_text("ref,pin,x,y\n" + "".join(f"R1,{i},0,{m}mil\n" for i, m in enumerate(order)))
        assert readers.pads(spark, str(p)).first().y == sum(mils) * 254 / 160000


def test_upright_axis_has_one_sign(spark, tmp_path):
    for n, order in enumerate(permutations([(7, 42), (8, 11), (8, 73)])):
        p = tmp_path / f"{n}.csv"
        p.write_text("ref,pin,x,y\n" + "".join(f"R1,{i},{x},{m}mil\n" for i, (x, m) in enumerate(order)))
        assert readers.pads(spark, str(p)).first().rotation == 90


def test_unknown_format_is_an_error(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.load(spark, str(p))


def test_bom(spark, tmp_path):
    p = tmp_path / "bom.csv"
    p.write_text('Comment,Designator,Footprint,Quantity\n10k,"R1;R2",0402,2\n100n,"C1, C2, C5",0402,5\nx,r1,0402,1\n')
    rows = readers.bom(spark, str(p)).orderBy("line", "place").collect()
    assert [r.designator for r in rows if r.nth == 1] == ["R1", "R2", "C1", "C2", "C5"]
    assert [r.designator for r in rows if r.nth > 1] == ["r1"]
    assert {r.designator for r in rows if r.quantity_differs} == {"C1", "C2", "C5"}
    assert all(r.x is None for r in rows)


def test_netlist(spark, tmp_path):
    p = tmp_path / "b.ipc"
    p.write_text("C  comment\nP  UNITS CUST 1\n327GND              R1    -1          A01X+001000Y-000500X0400Y0400\n327VCC              U2    -14         A02X+002000Y+000100X0400Y0400\n")
    rows = readers.load(spark, str(p)).orderBy("designator").collect()
    assert [(r.designator, r.pin, r.net, r.x, r.y, r.side) for r in rows] == [("R1", "1", "GND", 1.0, -0.5, "top"), ("U2", "14", "VCC", 2.0, 0.1, "bottom")]


def test_label_files(spark, tmp_path):
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"images": [{"id": 1, "file_name": "a.png"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1.9, 2, 3, 4]}, {"id": 6, "image_id": 9, "category_id": 2, "bbox": [0, 0, 1, 1]}], "categories": []}))
    (r,) = readers.coco(spark, str(c)).collect()
    assert (r.file_name, r.label, r.x1, r.x2) == ("a.png", "unknown", 1, 4)
    s = tmp_path / "l.json"
    s.write_text(json.dumps({"imagePath": "b.png", "shapes": [{"label": "x", "shape_type": "circle", "points": [[5, 5], [8, 9]]}, {"label": "y", "shape_type": "rectangle", "points": [[4, 4], [1, 2]]}, {"label": "z", "shape_type": "rectangle", "points": [[1, 1], [1, 2]]}]}))
    rows = readers.labelme(spark, str(s)).orderBy("label").collect()
    assert [(r.label, r.x1, r.y2) for r in rows] == [("x", 0.0, 10.0), ("y", 1.0, 4.0)]
    y = tmp_path / "y.txt"
    y.write_text("0 0.5 0.5 0.5 0.5\n7 0.5 0.5 1 1\nbad line here now 1\n")
    rows = readers.yolo(spark, str(y), {0: "pad"}, 100, 100).orderBy("label").collect()
    assert [(r.label, r.x1) for r in rows] == [("class_7", 0.0), ("pad", 25.0)]


def test_numbered_rows_take_one_shuffle(spark):
    from boardsift import views

    views.base(spark, "/root/testdata/sf0.001", "lineitem")
    lineitem = spark.table("lineitem")
    got = views.numbered(lineitem.unionByName(lineitem.limit(50)))
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert got.exceptAll(spark.sql(views.VIEWS["li"][1])).isEmpty() and got.count() == lineitem.distinct().count()


def test_written_rows_leave_no_shuffle_files(spark):
    from pathlib import Path

    from boardsift import shared

    before = spark.conf.get(shared.CLEANUP)
    where = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    files = lambda: {f for f in where.rglob("shuffle_*.data")}
    old = files()
    assert shared.written(spark.range(1000).repartition(3, "id"), "rows").count() == 1000
    deadline = time.time() + 10
    while any("shuffle" in f.name for f in files() - old) and time.time() < deadline:
        time.sleep(0.2)
    left = files() - old
    assert len(left) <= 4 and spark.conf.get(shared.CLEANUP) == before  # of the count alone
