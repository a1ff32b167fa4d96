from __future__ import annotations

import io
import json
import struct
import time
import zlib
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boardsift.operators import assign, enhance, fusion, golden, images, inference, onnx_files, pixels, spatial, training, vision
from boardsift.operators import registration as R

BOX = st.tuples(st.integers(0, 30), st.integers(0, 30), st.integers(1, 15), st.integers(1, 15)).map(lambda b: [float(b[0]), float(b[1]), float(b[0] + b[2]), float(b[1] + b[3])])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(BOX, st.integers(1, 4)), max_size=12))
def test_suppression_leaves_a_maximal_set(rows):
    boxes, score = np.array([b for b, _ in rows]).reshape(-1, 4), np.array([s for _, s in rows], float)
    kept = assign.suppressed(boxes, score, np.arange(len(rows)), 0.45).tolist()
    for i in range(len(rows)):
        over = [k for k in kept if k != i and assign.ious(boxes[[k]], boxes[i])[0][0] > 0.45]
        if i in kept:
            assert not over
        else:
            assert any((score[k], -k) > (score[i], -i) for k in over)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 3), st.integers(0, 3)), st.tuples(st.integers(0, 1), st.integers(0, 9)), max_size=10))
def test_matching_is_as_good_as_any(costs):
    edges = [(a, b, c) for (a, b), c in costs.items()]
    found = [p for part in assign.connected(edges) for p in assign.best_matching(part)]
    best = (0, (0, 0))
    for order in permutations(range(4)):
        for mask in range(16):
            pairs = [(a, order[a]) for a in range(4) if mask >> a & 1 and (a, order[a]) in costs]
            total = tuple(map(sum, zip(*(costs[p] for p in pairs), strict=True))) if pairs else (0, 0)
            best = min(best, (-len(pairs), total))
    total = tuple(map(sum, zip(*(costs[p] for p in found), strict=True))) if found else (0, 0)
    assert (-len(found), total) == best


def tile(no, box, **more):
    return {"no": no, "label": "resistor", "confidence": 0.9, "score": 0.9 - no / 100, "pass": "tile", "tile_id": no, "border": True, "own": True, **dict(zip(assign.SIDES, box, strict=True)), **more}


def test_seam_fragments_become_one():
    kept, why = assign.merge_tiles([tile(0, (65, 30, 100, 55)), tile(1, (80, 30, 115, 55))])
    assert [[k[s] for s in assign.SIDES] for k in kept] == [[65, 30, 115, 55]]
    assert why["seam"] == 1


def test_same_box_in_two_tiles_is_one():
    kept, why = assign.merge_tiles([tile(0, (80, 30, 100, 55), border=False), tile(1, (80, 30, 100, 55), border=False)])
    assert len(kept) == 1 and why["contained"] == 1


def test_regions_are_cut_apart():
    joints = [{"part": 1, "joint": "end", "box": [0, 0, 20, 20]}, {"part": 2, "joint": "start", "box": [16, 0, 40, 20]}]
    a, b = assign.apart(joints, [])
    assert a["box"][2] == b["box"][0] == 18 and not a["open"]
    (c,) = assign.apart(joints[:1], [{"part": 2, "box": [-5, -5, 25, 25]}])
    assert c["open"] and c["box"] == [0, 0, 20, 20]


def test_known_transforms_come_back():
    p = np.array([[10, 30], [25, 30], [41, 29], [11, 14], [27, 15], [44, 16]], float)
    m = np.array([[7.9, -1.1, 40], [1.1, 7.9, 30], [0, 0, 1]])
    out = R.register(p, list("RRCRCU"), R.apply(m, p), list("RRCRCU"), tolerance=10)
    assert out["usable"] and np.allclose(out["matrix"], m, atol=1e-6)
    for n in (2, 3, 4):
        found, residual = R.from_fiducials(p[[0, 2, 4, 5][:n]], R.apply(m, p)[[0, 2, 4, 5][:n]])
        assert residual < 1e-6 and np.allclose(R.apply(found, p), R.apply(m, p), atol=1e-4)


@pytest.mark.parametrize("dx, dy", [(0, 0), (3, 2), (-4, 1)])
def test_shift_is_measured(dx, dy):
    image = np.random.default_rng(1).random((60, 80)) * 255
    x, y, score = pixels.shift(np.roll(image, (dy, dx), (0, 1)), image[20:40, 20:50])
    assert round(x - 20, 1) == dx and round(y - 20, 1) == dy and score > 0.99


GREEN, GREY = (40, 90, 40), (215, 215, 215)


def region(*boxes, size=(40, 80)):
    image = np.full((*size, 3), GREEN, np.uint8)
    for x1, y1, x2, y2 in boxes:
        image[y1:y2, x1:x2] = GREY
    return image


def test_solder_on_green():
    image = region((20, 10, 60, 30))
    m = pixels.measured(image)
    assert set(m) == set(pixels.FEATURES) and len(m) == 13
    assert (m["solder_ratio"], m["solder_area_px"], m["span_ratio"], m["width_ratio"]) == (0.25, 800, 0.5, 0.5)
    assert m["centroid_offset_ratio"] == pytest.approx(abs(39.5 - 40) / 40) and m["edge_contact_start"] == m["edge_contact_end"] == 0
    assert m["contrast"] == pytest.approx((215 - 90) / 255) and m["specular_ratio"] == 1.0
    profile = np.repeat([0.0, 0.5, 0.0], [20, 40, 20])
    assert m["uniformity"] == pytest.approx(max(0.0, 1 - profile.std() / (profile.mean() + 1e-6)))
    assert pixels.refined(image) == (20, 10, 60, 30)
    assert pixels.letterboxed(image, 128, 128).shape == (128, 128, 3)


def test_solder_is_measured_along_its_axis():
    across = pixels.measured(region((0, 10, 80, 30)))
    assert across["edge_contact_start"] == across["edge_contact_end"] == 0.5 and across["span_ratio"] == 1
    down = pixels.measured(region((0, 10, 80, 30)).transpose(1, 0, 2))
    assert all(down[k] == pytest.approx(across[k]) for k in pixels.FEATURES)
    assert pixels.measured(region((0, 10, 80, 30)), "y")["span_ratio"] == 0.5
    left = pixels.measured(region((0, 10, 20, 30)))
    assert left["centroid_offset_ratio"] > 0.7 and left["edge_contact_start"] > 0 == left["edge_contact_end"]


def test_regions_without_solder():
    assert pixels.measured(np.zeros((0, 0, 3), np.uint8))["solder_area_px"] == 0 and pixels.measured(np.zeros((1, 9, 3), np.uint8))["mean_value"] == 0
    bare = pixels.measured(region())
    assert bare["solder_ratio"] == bare["contrast"] == 0 and bare["mean_value"] == pytest.approx(90 / 255) and bare["mean_saturation"] > 0.5
    dots = np.full((40, 40, 3), 30, np.uint8)
    dots[[10, 20, 31], [10, 25, 7]] = 245
    assert pixels.solder(dots).any()
    dull = region((5, 5, 75, 35))
    dull[dull == 215] = 150
    assert pixels.measured(dull)["specular_ratio"] == 0 < pixels.measured(region((5, 5, 75, 35)))["specular_ratio"]


def test_lens():
    image = np.random.default_rng(0).integers(0, 255, (40, 60, 3)).astype(np.uint8)
    camera = np.array([[50.0, 0, 30], [0, 50, 20], [0, 0, 1]])
    same, valid = enhance.undistorted(image, camera, (0.0,))
    assert (same == image).all() and valid.all()
    assert not enhance.undistorted(image, camera, (0.5, 0.1, 0.01, 0.01, 0.0))[1].all()
    assert pixels.camera_for(camera, (60, 40), (120, 80))[0, 0] == 100
    with pytest.raises(ValueError):
        pixels.camera_for(camera, (60, 40), (120, 40))


def test_enhancement_steps():
    image = np.random.default_rng(0).integers(60, 120, (48, 64, 3)).astype(np.uint8)
    assert np.ptp(enhance.stretched(image)) > np.ptp(image) and enhance.sharpened(image).std() > image.std() > enhance.bilateral(image).std()
    assert enhance.local_contrast(image).shape == image.shape and np.allclose(enhance.gaussian(np.full((20, 20), 7.0), 2), 7)
    assert enhance.preprocessed(image, most=32)[1:] == (["resize", "white_balance", "stretch"], 0.5)
    with pytest.raises(ValueError):
        enhance.preprocessed(image, noise="magic")


def test_views_of_one_image_are_alike():
    image = np.random.default_rng(3).integers(0, 255, (40, 50, 3)).astype(np.uint8)
    same = vision.compared(image, image)
    assert same["ssim"] == pytest.approx(1) and same["colour"] == 0 and same["blobs"] == 0 and same["edges"] == 1
    assert not vision.compared(image, image, np.zeros((40, 50), bool))["valid"]
    assert np.allclose(vision.lab(np.array([[[255, 255, 255], [0, 0, 0], [0, 0, 255]]], np.uint8))[0], [[100, 0, 0], [0, 0, 0], [53.24, 80.09, 67.2]], atol=0.05)


def test_hull_and_least_rectangle():
    y, x = np.mgrid[:60, :60] - 29.5
    t = np.radians(30)
    bar = (np.abs(x * np.cos(t) + y * np.sin(t)) <= 25) & (np.abs(y * np.cos(t) - x * np.sin(t)) <= 8)
    cx, cy, long, short, turn = vision.least_rectangle(vision.outline(bar))
    assert abs(cx - 30) < 0.6 and abs(cy - 30) < 0.6 and abs(long - 50) < 2.5 and abs(short - 16) < 2.5 and abs(turn - 30) < 2


def test_pins_and_bands():
    band = np.full((8, 60, 3), 30, np.uint8)
    for x in (5, 20, 35):
        band[:, x : x + 7] = 220
    band[:, 38] = 30  # a crack in the third pin
    assert vision.pins(band) == [(5, 12), (20, 27), (35, 42)]
    assert vision.kept_bands([band, np.full((8, 60, 3), 30, np.uint8), band[:0]]) == [True, False, False]
    assert vision.kept_bands([np.full((8, 60, 3), 30, np.uint8)] * 2) == [True, True]


@settings(max_examples=50, deadline=None)
@given(BOX, BOX)
def test_clipped_area_of_boxes(a, b):
    want = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    assert R.clipped_area([(a[0], a[1]), (a[2], a[1]), (a[2], a[3]), (a[0], a[3])], tuple(b)) == pytest.approx(want)


def test_registration_with_noise_strangers_and_a_mirrored_axis():
    r = np.random.default_rng(5)
    p = r.uniform(0, 100, (40, 2))
    kinds = r.choice(list("RCUD"), 40).tolist()
    for flip in (1, -1):
        m = np.array([[3.0, -0.4, 50], [0.4, 3.0, 20], [0, 0, 1]]) @ np.diag([1, flip, 1])
        seen = np.r_[R.apply(m, p)[5:] + r.normal(size=(35, 2)) * 0.5, r.uniform(0, 300, (6, 2))]
        out = R.register(p, kinds, seen, kinds[5:] + ["R"] * 6)
        assert out["usable"] and out["matched"] >= 34 and np.abs(R.apply(out["matrix"], p) - R.apply(m, p)).max() < 2
    assert not R.register(p[:1], ["R"], p, kinds)["usable"]
    assert not R.register(p, kinds, r.uniform(0, 300, (3, 2)), ["R"] * 3)["usable"]


def test_calibration_with_distortion():
    r = np.random.default_rng(2)
    k, lens = np.array([[800.0, 0, 320], [0, 820, 240], [0, 0, 1]]), (-0.05, 0.01)
    board = np.stack(np.meshgrid(np.arange(8) * 20.0, np.arange(6) * 20.0), -1).reshape(-1, 2)
    views = []
    for _ in range(12):
        a, b = r.uniform(-0.5, 0.5, 2)
        turn = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]]) @ np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
        q = np.c_[board - [70, 50], np.zeros(len(board))] @ turn.T + [*r.uniform(-20, 20, 2), r.uniform(500, 700)]
        u = q[:, :2] / q[:, 2:]
        rr = (u**2).sum(1, keepdims=True)
        views.append((u * (1 + lens[0] * rr + lens[1] * rr * rr)) @ k[:2, :2].T + k[:2, 2])
    found, _, error = enhance.calibrated(board, views)
    assert np.abs(found - k).max() < 25 and error < 0.2


def test_model_files_run():
    mean, scale, w, b = np.array([1.0, 2]), np.array([2.0, 4]), np.array([[1.0, 0, -1], [0.5, 2, 0]]), np.array([0.1, 0.2, 0.3])
    x = np.array([[3.0, 6], [0, 0], [1, 2]])
    assert np.allclose(inference.from_file(onnx_files.linear(mean, scale, w, b))(x), (x - mean) / scale @ w + b, atol=1e-5)
    with pytest.raises(Exception):  # noqa: B017
        inference.from_file(b"no model")(x)
    image = np.zeros((32, 64, 3), np.uint8)
    image[8:16, 40:48] = 255
    (found,) = inference.detected(image, onnx_files.bright_cells(64, 8), 999, 0.9)
    assert found[:4] == (40, 8, 48, 16)


def test_training_separates_what_can_be():
    r = np.random.default_rng(0)
    y = r.choice(["good", "bad", "worse"], 400)
    x = r.normal(size=(400, 3)) + np.stack([y == "bad", y == "worse", y == "good"], 1) * 6
    raw, manifest = training.trained(x[:300], y[:300].tolist(), x[300:], y[300:].tolist(), "good")
    manifest = json.loads(manifest)
    said = np.array(manifest["classes"])[inference.from_file(raw)(x[300:]).argmax(1)]
    assert (said == y[300:]).mean() > 0.97 and manifest["score"] > 2.9


def test_failures_stay_with_their_row():
    calls = []

    def model(rows):
        calls.append(len(rows))
        if 7 in rows:
            raise RuntimeError
        return [r * 2 for r in rows] if len(rows) != 3 else [0]

    assert inference.isolated(list(range(11)), model) == [r * 2 if r != 7 else None for r in range(11)]
    assert calls[:2] == [4, 4]


def test_images_come_back(tmp_path):
    image = np.random.default_rng(0).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    raw = images.encoded(image)
    (tmp_path / "a.png").write_bytes(raw)
    for source in (raw, io.BytesIO(raw), tmp_path / "a.png", image):
        assert (images.decoded(source) == image).all()
    for bad in (b"", b"no image", raw[:-20], raw[:45] + bytes([raw[45] ^ 1]) + raw[46:], tmp_path / "none.png"):
        with pytest.raises(ValueError):
            images.decoded(bad)


def test_every_row_filter_is_undone():
    rgb = np.random.default_rng(1).integers(0, 256, (5, 6, 3))
    p = np.pad(rgb, ((1, 0), (1, 0), (0, 0)))
    a, b, c = p[1:, :-1], p[:-1, 1:], p[:-1, :-1]
    near = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
    paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), a, np.where(near[1] <= near[2], b, c))
    rows = b"".join(bytes([y]) + ((rgb - f) & 255)[y].astype(np.uint8).tobytes() for y, f in enumerate([0 * a, a, b, (a + b) // 2, paeth]))
    raw = images._HEAD + images._chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + images._chunk(b"IDAT", zlib.compress(rows)) + images._chunk(b"IEND", b"")
    assert (images.decoded(raw) == rgb[:, :, ::-1]).all()


def test_all_parts_of_a_board_are_drawn():
    from boardsift.plans.pixels import _frame

    parts = pd.DataFrame([(n, n % 3, 20.0 * n, 10.0, 20.0 * n + 8, 18.0) for n in range(6)], columns=["no", "class_id", "x1", "y1", "x2", "y2"])
    assert _frame(parts)[14, 4:120:20, 0].tolist() == [150 + 12 * (n % 3) for n in range(6)]


@pytest.mark.parametrize("points", [
    [(0, 0), (4, 2), (10, 5)],  # three on a line
    [(0, 0), (0, 7), (0, 9), (0, 30), (0, 41)],
    [(1, 1), (5, 5), (9, 9), (20, 3)],  # all but one on a line
    [(3, 0), (3, 8), (3, 40), (3, 55), (90, 7)],
    [(5, 5), (5, 5), (60, 9), (60, 9)],  # repeated
    [(5, 5), (60, 9), (5, 5), (31, 80), (60, 9)],
])
def test_fiducials_that_leave_a_matrix_open(points):
    p = np.array(points, float)
    t = 2.5 * np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    m, residual = R.from_fiducials(p, p @ t.T + [30.0, 20.0])
    assert np.allclose(m, np.r_[np.c_[t, [30.0, 20.0]], [[0, 0, 1]]], atol=1e-6) and residual < 1e-6


def fastest(f, times=5):
    """Seconds of the fastest of some calls."""

    def once():
        began = time.perf_counter()
        f()
        return time.perf_counter() - began

    return min(once() for _ in range(times))


def test_votes_are_counted_faster_than_rows_are_sorted():
    cells = np.random.default_rng(3).integers(-150, 150, (20_000, 2))
    cells[:400] = (7, -3)
    cells[400:420] = (8, -4)
    assert R.voted(cells, 1)[0].tolist() == np.flatnonzero((np.abs(cells - [7, -3]) <= 1).all(1)).tolist()
    assert fastest(lambda: R.voted(cells, 4)) < 0.7 * fastest(lambda: np.unique(cells, axis=0, return_inverse=True, return_counts=True))


def region_images():
    """Frames of boxes and noise, and regions of all shapes in them: of one pixel, empty, high and wide ones."""
    for seed in range(12):
        random = np.random.default_rng(seed)
        rows = np.c_[random.integers(0, 90, (25, 2)), random.integers(0, 60, 25)]
        image = pixels.drawn(np.c_[rows[:, :2], rows[:, :2] + random.integers(1, 40, (25, 2)), random.integers(60, 256, 25)], 110, 140)
        if seed % 3:
            image = np.clip(image.astype(int) + random.integers(-60, 61, image.shape if seed % 3 == 1 else image.shape[:2] + (1,)), 0, 255).astype(np.uint8)
        if seed > 9:
            image[::2, ::3] = random.integers(0, 256, 3)
        x, y = random.integers(0, 130, 60), random.integers(0, 100, 60)
        yield image, [*zip(x.tolist(), y.tolist(), (x + random.integers(0, 45, 60)).tolist(), (y + random.integers(0, 45, 60)).tolist(), strict=True), (0, 0, 140, 110), (3, 3, 3, 9)]


def test_regions_of_an_image_are_measured_together():
    for image, boxes in region_images():
        together = pixels.Crops(image, boxes, turn=True).measured()
        for k, (x1, y1, x2, y2) in enumerate(boxes):
            one = pixels.measured(image[y1:y2, x1:x2])
            assert {f: round(float(together[f][k]), 9) for f in pixels.FEATURES} == {f: round(float(one[f]), 9) for f in pixels.FEATURES}, (boxes[k],)
    assert pixels.Crops(image, []).measured()["contrast"].tolist() == []


def test_regions_of_an_image_are_refined_together():
    some = 0
    for image, boxes in region_images():
        found, ok = pixels.Crops(image, boxes).refined()
        some += ok.sum()
        for k, (x1, y1, x2, y2) in enumerate(boxes):
            assert (tuple(found[k].tolist()) if ok[k] else None) == pixels.refined(image[y1:y2, x1:x2]), (boxes[k],)
    assert some > 50


def test_kernels_of_small_tables_run_in_many_tasks(spark):
    from boardsift.operators.spatial import by_board

    rows = by_board(spark.range(40).selectExpr("cast(id as int) as board_id")).groupBy("board_id").applyInPandas(lambda p: p, "board_id int")
    assert rows.rdd.getNumPartitions() == 4


def test_boxes_that_overlap_are_found_in_blocks():
    """`merge_tiles` measures what overlaps instead of all that is left: the same pairs and measures as box by box, odd boxes too."""
    from boardsift.operators import assign

    rng = np.random.default_rng(4)
    at = rng.integers(0, 60, (90, 2))
    boxes = np.hstack([at, at + rng.integers(-2, 25, (90, 2))]).astype(float)
    boxes[7, 2] = np.nan
    for block in (1 << 20, 500, 1):
        assert assign.overlapping(boxes, block) == [assign._near(boxes, boxes[i], i + 1) for i in range(len(boxes))]
    assert assign.overlapping(boxes[:0]) == [] and assign.merge_tiles([]) == ([], {"seam": 0, "contained": 0, "overlap": 0})


POINTS = st.lists(st.tuples(st.integers(0, 2), st.sampled_from([-5.0, -0.25, 0.0, 1.5, 4.0, 8.0, 1e5, float("nan")]), st.integers(-6, 6)), max_size=14)


@settings(max_examples=100, deadline=None)
@given(POINTS, POINTS, st.sampled_from([1.0, 2.5, 6.0]))
def test_near_finds_all_pairs_within_reach_once(a, b, reach):
    one, other = (np.array(v, dtype=float).reshape(-1, 3).T for v in (a, b))
    found = list(zip(*(v.tolist() for v in spatial.near(*one, *other, reach)), strict=True))
    assert len(found) == len(set(found))
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] == q[0] and abs(p[1] - q[1]) <= reach and abs(p[2] - q[2]) <= reach}
    assert want <= set(found) and all(a[i][0] == b[j][0] for i, j in found)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)), st.tuples(st.integers(0, 1), st.sampled_from([0.25, 0.5, 3.0]), st.integers(1, 5)), max_size=10))
def test_edges_taken_at_once_are_those_of_the_matching(costs):
    edges = [(a, b, c) for (a, b), c in sorted(costs.items())]
    a, b, *parts = (np.array(v) for v in zip(*((a, b, *c) for a, b, c in edges), strict=True)) if edges else (np.empty(0, dtype=int),) * 5
    at = assign.matched_edges(a, b, *parts)
    assert sorted((int(a[i]), int(b[i])) for i in at) == sorted(p for part in assign.connected(edges) for p in assign.best_matching(part))


def exchanges(df):
    """Rows dealt anew, and joins, in a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("RepartitionByExpression"), plan.count("Join")


def test_slots_and_detections_meet_by_one_shuffle(spark):
    """Two slots compete for two detections; a class that differs counts first; the window is half open; other boards don't matter."""
    slots = spark.createDataFrame([(1, 1, "ic", 0.0, 0.0), (1, 2, "led", 3.0, 0.0), (2, 1, "unknown", 0.0, 0.0), (3, 1, "ic", 0.0, 0.0), (4, 1, "ic", None, 0.0)], "board_id int, cad_no int, part_class string, cx double, cy double")
    at = lambda board, no, label, x, y: (board, no, label, x - 1.0, y - 1.0, x + 1.0, y + 1.0)
    found = spark.createDataFrame([at(1, 7, "led", 1.0, 0.0), at(1, 8, "ic", 2.0, 0.0), at(2, 5, "led", -4.0, 0.0), at(3, 5, "ic", 4.0, 0.0), at(4, 1, "ic", 0.0, 0.0)], "board_id int, no int, label string, x1 double, y1 double, x2 double, y2 double")
    got = golden.matched(slots, found, 4.0)
    assert exchanges(got) == (1, 0)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 8), (1, 2, 7), (2, 1, 5)]


def test_boards_split_over_batches_stay_whole(spark):
    """Batches of 3 rows over boards of 1 to 9."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.range(1, 10).selectExpr("cast(id as int) as board_id", "explode(sequence(1, id)) as n")
        count = lambda pdf: pdf.groupby("board_id", as_index=False).n.count()
        assert sorted(map(tuple, spatial.in_runs(rows, count, "board_id int, n long").collect())) == [(i, i) for i in range(1, 10)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_fusion_pairs_boards_by_one_shuffle(spark):
    """A pair, a part that is missing, one that is unexpected, a board with nothing but a part or a detection, and a board whose registration is poor."""
    cad = spark.createDataFrame([(1, 1, "ic", 0.0, 0.0), (1, 2, "ic", 90.0, 0.0), (2, 1, "led", 0.0, 0.0), (4, 1, "ic", 0.0, 0.0)], "board_id int, cad_no int, part_class string, cx double, cy double")
    det = spark.createDataFrame([(1, 7, "led", 0.0, 0.0, 2.0, 4.0), (1, 8, "ic", 50.0, 0.0, 52.0, 4.0), (3, 1, "led", 0.0, 0.0, 2.0, 2.0), (4, 1, "ic", 0.0, 0.0, 2.0, 2.0)], "board_id int, no int, label string, x1 double, y1 double, x2 double, y2 double")
    pads = spark.createDataFrame([(1, 1, 0), (1, 2, 2)], "board_id int, cad_no int, pads int")
    boards = spark.createDataFrame([(1, 2.0, 0.9, 3.0), (2, 2.0, 0.9, 3.0), (3, 2.0, 0.9, 3.0), (4, 2.0, 0.1, 3.0)], "board_id int, scale double, inliers double, residual double")
    got = fusion.drive(cad, det, pads, boards, 6.0)
    assert exchanges(got) == (1, 0)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        (1, "matched", "ok", 1, 7, 1.0, 2.0, 2, "derived"),
        (1, "shifted_component", "review", 1, 7, 0.0, 0.0, 0, None),
        (1, "class_mismatch", "info", 1, 7, 0.0, 0.0, 0, None),
        (1, "missing_component", "defect", 2, None, 0.0, 0.0, 2, "cad_only_component"),
        (1, "unexpected_component", "info", None, 8, 0.0, 0.0, 0, "derived"),
        (2, "missing_component", "defect", 1, None, 0.0, 0.0, 0, "cad_only_component"),
        (3, "unexpected_component", "info", None, 1, 0.0, 0.0, 0, "derived"),
        (4, "registration_rejected", "warning", None, None, 0.0, 0.0, 0, None),
    ], key=str)
