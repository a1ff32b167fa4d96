"""Models over batches of rows, keyed by id: results never depend on the order in which a batch comes back."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame


def predicted(rows: DataFrame, keys: list[str], features: list[str], model: Callable[[np.ndarray], np.ndarray], batch: int = 32) -> DataFrame:
    """The keys and `logits` of each row."""

    def work(frames):
        for pdf in frames:
            x = pdf[features].to_numpy(dtype=float)
            parts = [model(x[i : i + batch]) for i in range(0, len(x), batch)]
            for i, p in enumerate(parts):
                if len(p) != len(x[i * batch : (i + 1) * batch]):
                    raise ValueError("the model's results don't match its inputs")
            yield pdf[keys].assign(logits=[y.tolist() for p in parts for y in p])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.select(*keys, *features).mapInPandas(work, f"{schema}, logits array<double>")


@lru_cache(4)
def loaded(raw: bytes):
    """A session from a model file's bytes, kept by the worker."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(raw, options, providers=["CPUExecutionProvider"])


def from_file(raw: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """The model in a file's bytes; broken files are an error, never replaced by another model."""

    def run(x: np.ndarray) -> np.ndarray:
        s = loaded(raw)
        return s.run(None, {s.get_inputs()[0].name: x.astype(np.float32)})[0]

    return run


def onnx_model(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """The model in a file; a missing file is an error, never replaced by another model."""
    return from_file(Path(path).read_bytes())


def flips(image: np.ndarray) -> list[np.ndarray]:
    """An image, mirrored across, down, and both."""
    return [image, image[:, ::-1], image[::-1], image[::-1, ::-1]]


def classified(images: list[np.ndarray], model: Callable, features: Callable, manifest: dict, by_class: dict[str, float] | None = None, temperature: float = 1.0, averaged: bool = True, batch: int = 32, k: int = 3) -> list[dict]:
    """Label, probability, ranking and decision of each image: accept, review or unknown.

    Images go through the model in batches, each also mirrored if `averaged`; probabilities are the mean over its views.
    """
    from boardsift.operators.training import softmax

    views = [flips(i) if averaged else [i] for i in images]
    flat = [features(v) for vs in views for v in vs]
    rows = [softmax(model(np.stack(flat[i : i + batch])), temperature) for i in range(0, len(flat), batch)]
    p = np.concatenate(rows).reshape(len(images), -1, len(manifest["classes"])).mean(1) if flat else np.zeros((0, 1))
    out = []
    for own in p:
        order = np.argsort(-own, kind="stable")[:k]
        label, best = manifest["classes"][order[0]], float(own[order[0]])
        accept = (by_class or {}).get(label, manifest["accept_threshold"])
        decision = "accept" if best >= accept else "review" if best >= manifest["review_threshold"] else "unknown"
        out.append({"label": label, "probability": best, "decision": decision, "top_k": [(manifest["classes"][i], float(own[i])) for i in order]})
    return out


def detected(image: np.ndarray, raw: bytes, configured: int = 640, least: float = 0.25) -> list[tuple[float, float, float, float, float]]:
    """Boxes and confidences in the image's own pixels, from a model whose head has suppressed already.

    A model of fixed size decides about the size, whatever is configured. What a model fails on is an error here.
    """
    from boardsift.operators.pixels import letterboxed

    s = loaded(raw)
    fixed = s.get_inputs()[0].shape[-1]
    size = fixed if isinstance(fixed, int) else configured
    x = letterboxed(image, size, size)[..., ::-1].transpose(2, 0, 1)[None] / 255.0
    found = s.run(None, {s.get_inputs()[0].name: x.astype(np.float32)})[0]
    if found.ndim != 3 or found.shape[2] != 6:
        raise ValueError(f"not a detector that suppresses by itself: {found.shape}")
    scale = min(size / image.shape[0], size / image.shape[1])
    nh, nw = max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale))
    y, x0 = (size - nh) // 2, (size - nw) // 2
    out = []
    for x1, y1, x2, y2, score, _ in found[0].tolist():
        box = [(min(max(v - o, 0), n)) / scale for v, o, n in ((x1, x0, nw), (y1, y, nh), (x2, x0, nw), (y2, y, nh))]
        if score >= least and box[2] - box[0] >= 1 and box[3] - box[1] >= 1:
            out.append((*box, score))
    return out


def isolated(rows: list, model: Callable[[list], list], batch: int = 4) -> list:
    """The model's result for each row, in batches; where a batch fails or has another number of results, its rows go one by one,
    and those that fail alone have none."""
    out: list = []
    for i in range(0, len(rows), batch):
        part = rows[i : i + batch]
        try:
            found = model(part)
            if len(found) != len(part):
                raise ValueError("the model's results don't match its inputs")
        except Exception:  # noqa: BLE001 - whatever the model does, other rows mustn't suffer
            found = []
            for r in part:
                try:
                    (one,) = model([r])
                except Exception:  # noqa: BLE001
                    one = None
                found.append(one)
        out += found
    return out
