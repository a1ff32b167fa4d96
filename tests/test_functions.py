from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from boardsift.functions import boxes as B
from boardsift.functions import numbers as N
from boardsift.functions import text as T


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def box(*v):
    return B.box(*map(float, v))


def test_overlap_measures(spark):
    a, b = box(0, 0, 10, 10), box(5, 0, 15, 10)
    assert one(spark, B.iou(a, b)) == pytest.approx(1 / 3)
    assert one(spark, B.ios(a, box(2, 2, 4, 4))) == 1.0
    assert one(spark, B.iou(a, box(20, 20, 30, 30))) == 0.0
    assert one(spark, B.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0


def test_cut_keeps_the_largest_slab(spark):
    assert tuple(one(spark, B.without(box(0, 0, 10, 10), box(6, 0, 12, 12)))) == (0, 0, 6, 10)
    assert one(spark, B.without(box(0, 0, 10, 10), box(-1, -1, 11, 11))) is None
    assert tuple(one(spark, B.without(box(0, 0, 10, 10), box(4, -1, 6, 11)))) == (0, 0, 4, 10)  # left before right


def test_cut_of_odd_boxes(spark):
    assert one(spark, B.without(box(5, 0, 5, 10), box(0, 2, 10, 4))) is None  # no width
    assert tuple(one(spark, B.without(box(0, 0, 10, 10), box(12, 0, 14, 10)))) == (0, 0, 10, 10)  # apart
    assert tuple(one(spark, B.without(box(0, 0, 10, 10), box(-1, 4, 11, 6)))) == (0, 0, 10, 4)  # above before below
    assert [one(spark, B.uncovered(box(0, 0, 10, 10), b)) for b in (box(0, 0, 10, 10), box(-1, -1, 11, 11), box(0, 0, 10, 9))] == [False, False, True]


def test_halves_cut_the_shorter_side(spark):
    p, q = B.halves(box(0, 0, 10, 10), box(8, 0, 20, 10))
    assert tuple(one(spark, p)) == (0, 0, 9, 10)
    assert tuple(one(spark, q)) == (9, 0, 20, 10)


@pytest.mark.parametrize("cell, value", [("12,5mm", 12.5), ("1,234.5", 1.234), ("-3e1", -30.0), ("", 0.0), ("n/a", 0.0), (None, 0.0)])
def test_lenient_numbers(spark, cell, value):
    assert one(spark, T.number(F.lit(cell).cast("string"))) == value


@pytest.mark.parametrize("cell, scale", [("10mil", 0.0254), ("1 in", 25.4), ("5", 1.0), ("3parsec", 1.0)])
def test_units(spark, cell, scale):
    assert one(spark, T.unit_scale(F.lit(cell))) == scale


@pytest.mark.parametrize("name, found", [("LED3", "led"), ("L3", "inductor"), ("R1", "resistor"), ("CN2", "connector"), ("ZZ9", None), ("9", None), ("rv1", "potentiometer")])
def test_longest_prefix(spark, name, found):
    assert one(spark, T.part_class(F.lit(name))) == found


def test_designator_lists(spark):
    assert one(spark, T.designators(F.lit("C1, C2;C3  C4"))) == ["C1", "C2", "C3", "C4"]
    assert one(spark, T.designators(F.lit("CONN 1"))) == ["CONN 1"]


def test_labels_agree_unless_both_name_a_class(spark):
    assert one(spark, T.agree(F.lit("unknown"), F.lit("ic")))
    assert not one(spark, T.agree(F.lit("resistor"), F.lit("ic")))


def test_headers():
    assert T.column_names(["Designator", "Mid X", "Mid Y", "Layer", "Comment"]) == {"designator": "Designator", "x": "Mid X", "y": "Mid Y", "side": "Layer", "value": "Comment"}


def test_angles_wrap(spark):
    assert one(spark, N.wrapped(F.lit(90.0))) == -90.0
    assert one(spark, N.wrapped(F.lit(-90.0))) == -90.0
    assert one(spark, N.axis_gap(F.lit(89.0), F.lit(-89.0))) == 2.0


def test_softmax_and_rank(spark):
    p = one(spark, N.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert p == [0.5, 0.5]
    top = one(spark, N.ranked(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)), 2))
    assert [t.label for t in top] == ["b", "c"]


def test_formula_guard(spark):
    assert one(spark, T.guarded_cell(F.lit("=1"))) == "'=1"
    assert one(spark, T.guarded_cell(F.lit("a=1"))) == "a=1"
