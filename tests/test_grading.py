from __future__ import annotations

import pytest

from boardsift.operators import grading

SCHEMA = "board_id int, no int, part_no int, kind string, geometry string, position string, pin_index int, solder_ratio double, span_ratio double, specular_ratio double, contrast double, centroid_offset_ratio double, edge_contact_start double, edge_contact_end double, model_label string, model_probability double"


def joint(no=1, **more):
    base = dict(board_id=1, no=no, part_no=1, kind="joint", geometry="multi_pin", position=f"top_pin{no}", pin_index=no, solder_ratio=0.5, span_ratio=0.9, specular_ratio=0.1, contrast=0.3, centroid_offset_ratio=0.1, edge_contact_start=0.0, edge_contact_end=0.0, model_label=None, model_probability=None)
    return base | more


def graded(spark, *rows):
    out = grading.graded(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)).orderBy("no").collect()
    return out


@pytest.mark.parametrize(
    "more, label",
    [
        ({}, "good"),
        ({"solder_ratio": 0.04}, "missing_solder"),
        ({"solder_ratio": 0.1}, "insufficient_solder"),
        ({"span_ratio": 0.3}, "insufficient_solder"),
        ({"solder_ratio": 0.9}, "excess_solder"),
        ({"specular_ratio": 0.0, "contrast": 0.01}, "cold_joint"),
        ({"centroid_offset_ratio": 0.6}, "insufficient_solder"),
        ({"kind": "body", "solder_ratio": 0.01}, "missing_component"),
        ({"kind": "body"}, "ok"),
    ],
)
def test_rules(spark, more, label):
    assert graded(spark, joint(**more))[0].rule_label == label


def test_bridge_needs_both_facing_edges(spark):
    a, b = graded(spark, joint(1, edge_contact_end=0.4), joint(2, edge_contact_start=0.4))
    assert a.rule_label == b.rule_label == "solder_bridge"
    a, b = graded(spark, joint(1, edge_contact_end=0.4), joint(2, edge_contact_start=0.2))
    assert a.rule_label == b.rule_label == "good"
    a, b = graded(spark, joint(1, edge_contact_end=0.4), joint(3, edge_contact_start=0.4))
    assert a.rule_label == "good"


def test_tombstone_marks_the_weaker_end(spark):
    rows = graded(spark, joint(1, geometry="two_terminal", position="start"), joint(2, geometry="two_terminal", position="end", solder_ratio=0.03))
    assert [r.rule_label for r in rows] == ["good", "missing_solder"]


@pytest.mark.parametrize(
    "more, label, decision, by",
    [
        ({"model_label": "good", "model_probability": 0.9}, "good", "accept", "agreement"),
        ({"model_label": "good", "model_probability": 0.5}, "good", "review", "agreement"),
        ({"model_label": "solder_bridge", "model_probability": 0.9}, "solder_bridge", "review", "conflict"),
        ({"model_label": "good", "model_probability": 0.9, "solder_ratio": 0.9}, "excess_solder", "review", "conflict"),
        ({}, "good", "accept", "rules"),
    ],
)
def test_fusion(spark, more, label, decision, by):
    r = graded(spark, joint(**more))[0]
    assert (r.label, r.decision, r.decided_by) == (label, decision, by)
