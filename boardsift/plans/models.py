"""Models trained, kept as files, and run over crops of scenes."""

from __future__ import annotations

import json

import numpy as np

from boardsift.catalog import query
from boardsift.operators import inference, onnx_files, pixels, training, vision
from boardsift.plans.vision import H, SCENE, W, scene, scenes, visible

#: Parts that no other is drawn over.
ALONE = """ WHERE NOT EXISTS (SELECT 1 FROM supplier o WHERE o.s_nationkey = n_nationkey AND o.s_suppkey <> supplier.s_suppkey AND o.s_suppkey * 37 % 8 = supplier.s_suppkey * 37 % 8 AND o.s_suppkey * 53 % 6 = supplier.s_suppkey * 53 % 6)"""
#: Scenes that a model is trained on: the first 25 nations that have parts, generated ones beside them.
TRAINING_SCENES = 25


def look(crop: np.ndarray) -> np.ndarray:
    """A crop's brightness on 8 by 8 fields, letterboxed."""
    return pixels.luminance(pixels.letterboxed(crop, 64, 64)).reshape(8, 8, 8, 8).mean((1, 3)).ravel() / 255


def shade(k: int) -> str:
    return f"shade{k % 5}"


def component_model() -> tuple[bytes, str]:
    """Trained on scenes of its own, of numbers that no nation has."""
    import pandas as pd

    x, y = [], []
    for n in range(TRAINING_SCENES):
        image, parts = scene(1000 + n, pd.DataFrame({"s_suppkey": np.arange(24) * 49 + n * 7}))
        for p in visible(parts).itertuples():
            for v in inference.flips(image[p.y1 : p.y2, p.x1 : p.x2]):
                x.append(look(v))
                y.append(shade(p.id))
    x, held = np.array(x), np.arange(len(y)) % 5 == 0
    return training.trained(x[~held], [c for c, h in zip(y, held, strict=True) if not h], x[held], [c for c, h in zip(y, held, strict=True) if h])


@query("M3", f"""SELECT n_nationkey, s_suppkey AS id, 'shade' || (s_suppkey % 5) AS label, TRUE AS decided, 3 AS ranked FROM nation JOIN supplier ON s_nationkey = n_nationkey{ALONE}""")
def family_classes(spark, sf_dir):
    """Parts of all scenes by a model trained beforehand: four views of each, mean probability, decision."""
    raw, manifest = component_model()
    manifest = json.loads(manifest)

    def kernel(n, image, parts):
        shown = list(visible(parts).itertuples())
        found = inference.classified([image[p.y1 : p.y2, p.x1 : p.x2] for p in shown], inference.from_file(raw), look, manifest)
        for p, f in zip(shown, found, strict=True):
            yield p.id, f["label"], f["decision"] in ("accept", "review"), len(f["top_k"])

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, id int, label string, decided boolean, ranked int")


def features_of(image: np.ndarray, p) -> np.ndarray:
    m = pixels.measured(image[p.y1 : p.y2, p.x1 : p.x2])
    return np.array([m[k] for k in pixels.FEATURES], float)


@query("M4", f"""SELECT n_nationkey, s_suppkey AS id, CASE WHEN s_suppkey % 4 = 1 THEN 'missing_solder' ELSE 'good' END AS label, TRUE AS whole FROM nation JOIN supplier ON s_nationkey = n_nationkey{ALONE}""")
def solder_classes(spark, sf_dir):
    """Joints of all scenes, some starved of solder, by a model of their 13 measurements: the whole distribution."""
    import pandas as pd

    def starved(image, p):
        out = image.copy()
        if p.id % 4 == 1:
            out[p.y1 : p.y2, p.x1 : p.x2] = np.minimum(out[p.y1 : p.y2, p.x1 : p.x2], 60)
        return out

    x, y = [], []
    for n in range(TRAINING_SCENES):
        image, parts = scene(2000 + n, pd.DataFrame({"s_suppkey": np.arange(24) * 49 + n * 5}))
        for p in visible(parts).itertuples():
            x.append(features_of(starved(image, p), p))
            y.append("missing_solder" if p.id % 4 == 1 else "good")
    held = np.arange(len(y)) % 5 == 0
    raw, manifest = training.trained(np.array(x)[~held], [c for c, h in zip(y, held, strict=True) if not h], np.array(x)[held], [c for c, h in zip(y, held, strict=True) if h], "good")
    classes = json.loads(manifest)["classes"]

    def kernel(n, image, parts):
        for p in visible(parts).itertuples():
            (prob,) = training.softmax(inference.from_file(raw)(features_of(starved(image, p), p)[None]))
            yield p.id, classes[int(prob.argmax())], bool(abs(prob.sum() - 1) < 1e-6 and len(prob) == len(classes))

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, id int, label string, whole boolean")


@query("M1", "SELECT n_nationkey, 64 AS model_size, TRUE AS inside, TRUE AS brightest_shown, 'failed' AS broken FROM nation")
def detector_adapter(spark, sf_dir):
    """A detector of fixed size on each scene: its size counts, boxes come back in the scene's pixels, and a broken file is an error."""
    raw = onnx_files.bright_cells(64, 8)

    def kernel(n, image, parts):
        marked = image.copy()
        marked[60:130, 100:180] = 255
        found = inference.detected(marked, raw, 640, 0.7)
        try:
            inference.detected(image, raw[:50])
            broken = "passed"
        except Exception:  # noqa: BLE001
            broken = "failed"
        yield inference.loaded(raw).get_inputs()[0].shape[-1], all(0 <= b[0] < b[2] <= W and 0 <= b[1] < b[3] <= H for b in found), any(b[0] >= 90 and b[2] <= 190 and b[1] >= 50 and b[3] <= 140 for b in found), broken

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, model_size int, inside boolean, brightest_shown boolean, broken string")


@query("M5 J18", """SELECT n_nationkey, s_suppkey AS id, CASE WHEN s_suppkey % 11 = 3 THEN 'failed' WHEN s_suppkey % 2 = 0 THEN 'small' ELSE 'searched' END AS state FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def lead_detection(spark, sf_dir):
    """Leads in crops of parts, four at a time: a crop that the model fails on costs no other; small crops aren't searched."""
    raw = onnx_files.bright_cells(32, 4)

    def model(crops):
        if any(c is None for c in crops):
            raise ValueError("broken crop")
        return [[b for b in inference.detected(c, raw, 640, 0.25) if b[2] - b[0] >= 1 and b[3] - b[1] >= 1] for c in crops]

    def kernel(n, image, parts):
        large = []
        for p in parts.itertuples():
            c = vision.crop(image, (p.x1, p.y1, p.x2, p.y2), 0.5 if p.id % 2 else -0.1)
            large.append((p.id, None if p.id % 11 == 3 else c, p.id % 11 == 3 or (p.id % 2 == 1 and max(c.shape[:2]) >= 24)))
        wanted = [(i, c) for i, c, big in large if big]
        found = dict(zip([i for i, _ in wanted], inference.isolated([c for _, c in wanted], model), strict=True))
        for i, _, big in large:
            yield i, "small" if not big else "failed" if found[i] is None else "searched"

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, id int, state string")


@query("K15", "SELECT n_nationkey, s_suppkey AS id FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0")
def overlay_rows(spark, sf_dir):
    """Frames with the boxes of chosen parts drawn on them: which parts' outlines are there."""
    def kernel(n, image, parts):
        chosen = parts[parts.id % 3 != 0]
        drawn = pixels.outlined(image, [(p.x1, p.y1, p.x2, p.y2) for p in chosen.itertuples()], (0, 0, 255))
        for p in parts.itertuples():
            edge = np.concatenate([drawn[p.y1, p.x1 : p.x2], drawn[p.y2 - 1, p.x1 : p.x2]])
            if (edge == (0, 0, 255)).all() and p.id % 3:
                yield (p.id,)

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, id int")
