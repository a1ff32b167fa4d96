"""Pixel kernels over synthetic boards, an image a board."""

from __future__ import annotations

import numpy as np
import pandas as pd

from boardsift.catalog import query
from boardsift.functions import boxes as B
from boardsift.operators import images, pixels
from boardsift.operators.spatial import by_board
from boardsift.views import view


def frames(spark, sf_dir):
    return view(spark, sf_dir, "det").select("board_id", "no", "class_id", *B.SIDES)


def _frame(pdf: pd.DataFrame) -> np.ndarray:
    parts = pdf.sort_values("no", kind="stable")
    return pixels.drawn(np.c_[parts[list(B.SIDES)].to_numpy(), 150 + 12 * parts.class_id.to_numpy()])


def _regions(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[list(B.SIDES)].to_numpy().astype(int)


def _kinds() -> str:
    return ", ".join(f"{k} {'int' if k == 'solder_area_px' else 'double'}" for k in pixels.FEATURES)


@query("I9 I10")
def solder_measure(spark, sf_dir):
    """All 13 measurements of each part, from the pixels of its board as they come back from an encoded image."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pixels.Crops(images.decoded(images.encoded(_frame(pdf))), _regions(pdf).tolist(), turn=True).measured()
        return pdf[["board_id", "no"]].assign(**{k: [round(x, 5) for x in m[k].tolist()] for k in pixels.FEATURES})

    return by_board(frames(spark, sf_dir)).groupBy("board_id").applyInPandas(kernel, f"board_id int, no int, {_kinds()}")


@query("I11 T6")
def refine_to_metal(spark, sf_dir):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = _regions(pdf)
        boxes, found = pixels.Crops(_frame(pdf), whole.tolist()).refined()
        boxes = np.where(found[:, None], boxes + whole[:, [0, 1, 0, 1]], whole)
        return pdf[["board_id", "no"]].assign(**dict(zip(B.SIDES, boxes.T, strict=True)), refined=found)

    return by_board(frames(spark, sf_dir)).groupBy("board_id").applyInPandas(kernel, "board_id int, no int, x1 int, y1 int, x2 int, y2 int, refined boolean")
