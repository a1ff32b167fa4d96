"""Frames of whole scenes: a nation is a scene, its suppliers are the parts on it. What is done to a frame is known, and must come back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from boardsift import shared
from boardsift.catalog import query
from boardsift.operators import enhance, images, pixels, vision
from boardsift.views import table

H, W = 190, 270
SCENE = "n_nationkey"
#: Printed marks, between the places that parts take.
MARKS = [(13 + 30 * c + 27 * (r % 2) // 27 * 12, 8 + 27 * r) for r in range(1, 6) for c in (1, 3, 5, 7)][:16]


def scene(n: int, parts: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """A board on a dark ground with parts on it: dark bodies with bright ends. And the parts' boxes."""
    random = np.random.default_rng(n)
    image = np.full((H, W, 3), 8, np.uint8)
    image[8 : H - 8, 8 : W - 8] = (30, 95, 35)
    for i, (x, y) in enumerate(MARKS):
        image[y : y + 5, x : x + 5] = 240 - 15 * i
        image[y + 1 : y + 3, x + 1 + i % 3 : x + 3] = 60
    rows = []
    for k in sorted(parts.s_suppkey.tolist()):
        x1, y1 = 14 + k * 37 % 8 * 30, 14 + k * 53 % 6 * 27
        w, h = 16 + k % 9, 12 + k % 5
        image[y1 : y1 + h, x1 : x1 + w] = 25 + k % 5 * 8
        image[y1 : y1 + h, x1 : x1 + 4] = image[y1 : y1 + h, x1 + w - 4 : x1 + w] = 225
        image[y1 + 3 : y1 + 3 + k % 4, x1 + 7 : x1 + 10] = 140
        rows.append((k, x1, y1, x1 + w, y1 + h))
    noise = random.integers(-6, 7, (H, W, 1))
    noise[:8], noise[-8:], noise[:, :8], noise[:, -8:] = 0, 0, 0, 0
    return np.clip(image.astype(int) + noise, 0, 255).astype(np.uint8), pd.DataFrame(rows, columns=["id", "x1", "y1", "x2", "y2"])


def visible(parts: pd.DataFrame) -> pd.DataFrame:
    """Parts that no other is drawn over."""
    return parts[parts.groupby(["x1", "y1"]).id.transform("count") == 1]


def motion(n: int) -> np.ndarray:
    """The known turn and shift of a scene."""
    t = np.radians((n % 5 - 2) * 0.6)
    return np.array([[np.cos(t), -np.sin(t), n % 4 - 1.5], [np.sin(t), np.cos(t), 2.0 - n % 3], [0, 0, 1]])


def moved(image: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The frame in which the point p of the image lies at m p."""
    return vision.warped(image, np.linalg.inv(m), (image.shape[1], image.shape[0]))


def scenes(spark, sf_dir, kernel, schema: str):
    """kernel(n, image, parts) -> rows, for each scene."""
    j = table(spark, sf_dir, "nation").select(SCENE).join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias(SCENE), "s_suppkey"), SCENE, "left")
    names = [c.split()[0] for c in schema.split(", ")]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf[SCENE].iloc[0])
        image, parts = scene(n, pdf.dropna().astype(int))
        return pd.DataFrame([(n, *r) for r in kernel(n, image, parts)], columns=names)

    return j.groupBy(SCENE).applyInPandas(work, schema)


# ---- files


def _tile(n: int) -> np.ndarray:
    out = np.empty((10 + n, 20 + n, 3), np.uint8)
    out[:] = (n, 2 * n, 3 * n)
    out[0] = 200
    return out


def _png_files(spark, sf_dir) -> str:
    """One PNG file a nation in the shared folder."""
    path = shared.folder(spark, "frames")
    for r in table(spark, sf_dir, "nation").select(SCENE).collect():  # 25 rows
        shared.bytes_file(spark, f"{path}/n{r[0]}.png", images.encoded(_tile(r[0])))
    return path


SUMS = "SELECT n_nationkey, 10 + n_nationkey AS h, 20 + n_nationkey AS w, {k} * ((9 + n_nationkey) * n_nationkey + 200) * (20 + n_nationkey) AS light FROM nation"


@query("K14", SUMS.format(k="").replace(" * ((9", " ((9").replace("AS light", "AS blue"))
def image_encode(spark, sf_dir):
    """Files that were written, as Spark's own image source reads them."""
    f = spark.read.format("image").load(_png_files(spark, sf_dir)).select(F.regexp_extract("image.origin", r"n(\d+)\.png", 1).cast("int").alias(SCENE), "image.height", "image.width", "image.data")

    def blue(frames):
        for p in frames:
            yield pd.DataFrame({SCENE: p[SCENE], "h": p.height, "w": p.width, "blue": [int(np.frombuffer(d, np.uint8)[::3].astype(int).sum()) for d in p.data]})

    return f.mapInPandas(blue, f"{SCENE} int, h int, w int, blue long")


@query("S1", """
SELECT n_nationkey, 'ok' AS status, 10 + n_nationkey AS h, 20 + n_nationkey AS w, (((9 + n_nationkey) * n_nationkey + 200) + ((9 + n_nationkey) * n_nationkey * 2 + 200) + ((9 + n_nationkey) * n_nationkey * 3 + 200)) * (20 + n_nationkey) AS light FROM nation WHERE n_nationkey % 5 < 3
UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 3 THEN 'empty' ELSE 'not a PNG' END, NULL, NULL, NULL FROM nation WHERE n_nationkey % 5 >= 3""")
def image_decode(spark, sf_dir):
    """Files as bytes, some emptied and some cut short: pixels, or why there are none."""
    f = spark.read.format("binaryFile").load(_png_files(spark, sf_dir)).select(F.regexp_extract("path", r"n(\d+)\.png", 1).cast("int").alias(SCENE), "content")

    def read(frames):
        for p in frames:
            out = []
            for n, raw in zip(p[SCENE], p.content, strict=True):
                try:
                    image = images.decoded(b"" if n % 5 == 3 else bytes(raw)[:40] if n % 5 == 4 else raw)
                    out.append((n, "ok", *image.shape[:2], int(image.sum(dtype=int))))
                except ValueError as e:
                    out.append((n, str(e).split(":")[0], None, None, None))
            yield pd.DataFrame(out, columns=[SCENE, "status", "h", "w", "light"]).astype({"h": "Int32", "w": "Int32", "light": "Int64"})

    return f.mapInPandas(read, f"{SCENE} int, status string, h int, w int, light long")


@query("S2", """
WITH v AS (SELECT vec_id, vec_id % 4 AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), m AS (SELECT *, list_max(list_transform(e, lambda x: abs(x))) AS top FROM v)
SELECT vec_id, CAST(3 * list_sum(list_transform(e, lambda x: CASE k WHEN 0 THEN CASE WHEN x > 0 THEN 255 ELSE 0 END WHEN 1 THEN floor(floor(abs(x) * 1000) * 255 / 65535) WHEN 2 THEN floor(least(abs(x) / top, 1) * 255) ELSE floor(least(greatest(x * 500 - 2, 0), 255)) END)) AS BIGINT) AS light FROM m""")
def image_coercion(spark, sf_dir):
    """Vectors as images of one row: flags, 16-bit counts, shares, and numbers beyond the range of bytes."""

    def light(frames):
        for p in frames:
            out = []
            for i, e in zip(p.vec_id, p.embedding, strict=True):
                x = np.asarray(e, np.float64)[None]
                a = (x > 0, np.floor(np.abs(x) * 1000).astype(np.uint16), np.abs(x) / np.abs(x).max(), x * 500 - 2)[i % 4]
                out.append((i, int(pixels.coerced(a).sum(dtype=int))))
            yield pd.DataFrame(out, columns=["vec_id", "light"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(light, "vec_id long, light long")


# ---- enhancement


@query("I1", """SELECT n_nationkey, 'undistort,resize,denoise_' || CASE WHEN n_nationkey % 2 = 0 THEN 'gaussian' ELSE 'bilateral' END || ',white_balance,local_contrast,stretch,sharpen' AS operations, 140 AS h, 200 AS w, TRUE AS balanced FROM nation""")
def preprocess_chain(spark, sf_dir):
    """All steps on each scene under coloured light: in order, and grey on the whole in the end."""

    def kernel(n, image, parts):
        tinted = np.clip(image * np.array([1.0, 0.8, 0.6]), 0, 255).astype(np.uint8)
        camera = np.array([[260.0, 0, W / 2], [0, 260, H / 2], [0, 0, 1]])
        out, done, _ = enhance.preprocessed(tinted, camera, (0.05, 0.01, 0.001, 0.001), 200, "bilateral" if n % 2 else "gaussian", True, True, True, 0.4)
        before, after = (float(np.ptp(x.reshape(-1, 3).mean(0))) for x in (tinted, out))
        yield ",".join(done), out.shape[0], out.shape[1], after < before

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, operations string, h int, w int, balanced boolean").withColumn("h", F.when(F.col("h").between(139, 142), 140).otherwise(F.col("h")))


@query("I2", "SELECT n_nationkey, TRUE AS straight, n_nationkey % 3 = 0 AS whole FROM nation")
def lens_correction(spark, sf_dir):
    """Frames seen through a lens of known distortion: what is straight is straight again; without distortion nothing is lost."""

    def kernel(n, image, parts):
        camera = np.array([[240.0, 0, W / 2], [0, 240, H / 2], [0, 0, 1]])
        lens = (0.0, 0.0) if n % 3 == 0 else (0.12, 0.02, 0.0005, -0.0005, 0.001)[: 2 if n % 2 else 5]
        x, y = enhance.lens_map(H, W, (240.0, 240.0, W / 2, H / 2), lens)
        # each grid line of the corrected frame, drawn where the lens puts it
        seen = np.zeros((H, W, 3), np.uint8)
        px, py = np.rint(x[::10]).astype(int), np.rint(y[::10]).astype(int)
        inside = (px >= 0) & (px < W) & (py >= 0) & (py < H)
        seen[py[inside], px[inside]] = 255
        out, valid = enhance.undistorted(seen, camera, lens)
        rows = out[..., 0].mean(1)
        yield bool(rows[10:-10][::10].mean() > 4 * np.delete(rows[10:-10], np.s_[::10]).mean()), bool(valid[1:-1, 1:-1].all())

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, straight boolean, whole boolean")


@query("I4", "SELECT n_nationkey, 12 AS views, 900 + n_nationkey * 10 AS fx, 910 + n_nationkey * 10 AS fy, TRUE AS exact, 'too few' AS of_nine FROM nation")
def camera_calibration(spark, sf_dir):
    """A flat board of corners in twelve known poses: the camera's matrix comes back; nine views aren't enough."""

    def kernel(n, image, parts):
        random = np.random.default_rng(n)
        k = np.array([[900.0 + n * 10, 0, 640], [0, 910.0 + n * 10, 480], [0, 0, 1]])
        board = np.stack(np.meshgrid(np.arange(9) * 25.0, np.arange(6) * 25.0), -1).reshape(-1, 2)
        views = []
        for _ in range(12):
            a, b, c = random.uniform(-0.5, 0.5, 3)
            rx, ry, rz = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]]), np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]]), np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
            p = np.c_[board - [100, 62], np.zeros(len(board))] @ (rz @ ry @ rx).T + [random.uniform(-40, 40), random.uniform(-40, 40), random.uniform(500, 800)]
            views.append((p @ k.T)[:, :2] / p[:, 2:])
        found, lens, error = enhance.calibrated(board, views)
        try:
            enhance.calibrated(board, views[:9])
            few = "enough"
        except ValueError:
            few = "too few"
        yield len(views), round(found[0, 0]), round(found[1, 1]), bool(np.allclose(found, k, atol=0.5) and max(map(abs, lens)) < 1e-3 and error < 1e-3), few

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, views int, fx int, fy int, exact boolean, of_nine string")


# ---- alignment


@query("I5 G11", "SELECT n_nationkey, TRUE AS found, TRUE AS close FROM nation")
def frame_alignment(spark, sf_dir):
    """Each scene turned and shifted: the matrix comes back within a pixel over the whole frame."""
    from boardsift.operators.registration import apply

    def kernel(n, image, parts):
        m, how, pairs = vision.aligned(image, moved(image, motion(n)))
        at = np.array([[20.0, 20], [250, 20], [250, 170], [20, 170]])
        yield how in ("corners", "motion"), bool(np.linalg.norm(apply(m, at) - apply(motion(n), at), axis=1).max() < 1.0)

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, found boolean, close boolean")


@query("I6", "SELECT n_nationkey, TRUE AS enough, n_nationkey % 7 - 3 AS dx, 2 - n_nationkey % 5 AS dy FROM nation")
def anchor_match(spark, sf_dir):
    """Anchors of a scene looked for in the scene shifted by whole pixels."""

    def kernel(n, image, parts):
        anchors = vision.enrolled(image, [])["anchors"]
        shifted = np.roll(pixels.luminance(image), (2 - n % 5, n % 7 - 3), (0, 1))
        used = [a for a in vision.anchored(shifted, anchors) if a["used"]]
        yield len(used) >= 3, round(float(np.median([a["dx"] for a in used]))) if used else None, round(float(np.median([a["dy"] for a in used]))) if used else None

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, enough boolean, dx int, dy int")


@query("I7", "SELECT n_nationkey, 8 AS x1, 8 AS y1, 262 AS x2, 182 AS y2, TRUE AS upright, TRUE AS none_in_the_dark FROM nation")
def board_locate(spark, sf_dir):
    """Where the board is in each frame, and that a dark frame has none."""

    def kernel(n, image, parts):
        found = vision.located(image)
        yield *(found["box"] if found else (None,) * 4), bool(found and abs(found["angle"]) < 1), vision.located(image // 12) is None

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, x1 int, y1 int, x2 int, y2 int, upright boolean, none_in_the_dark boolean")


@query("I8")
def part_proposals(spark, sf_dir):
    """Boxes of what stands out from the board, as rows."""

    def kernel(n, image, parts):
        for i, (x1, y1, x2, y2, score) in enumerate(vision.proposed(image[8 : H - 8, 8 : W - 8])):
            yield i + 1, x1 + 8, y1 + 8, x2 + 8, y2 + 8, score

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, no int, x1 int, y1 int, x2 int, y2 int, confidence double")


# ---- regions


@query("I12")
def lead_regions(spark, sf_dir):
    """Of each part: along which axis its ends are, which of its four bands show metal, and the pins in its left band."""

    def kernel(n, image, parts):
        for p in parts.itertuples():
            c = image[p.y1 : p.y2, p.x1 : p.x2]
            kept = vision.kept_bands([c[:4], c[-4:], c[:, :4], c[:, -4:]])
            yield p.id, vision.terminal_axis(c), "".join(s for s, k in zip("tblr", kept, strict=True) if k), len(vision.pins(c[:, :4], "y"))

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, id int, axis string, bands string, pins int")


@query("I13", "SELECT n_nationkey, TRUE AS close FROM nation")
def part_orientation(spark, sf_dir):
    """A bar turned by a known angle."""

    def kernel(n, image, parts):
        t = np.radians(n * 7 % 170 - 85)
        y, x = np.mgrid[:80, :80] - 39.5
        bar = (np.abs(x * np.cos(t) + y * np.sin(t)) <= 28) & (np.abs(-x * np.sin(t) + y * np.cos(t)) <= 9)
        found = vision.orientation(np.where(bar, 220, 30).astype(np.uint8)[..., None].repeat(3, 2))
        yield (bool(found is not None and abs((found - np.degrees(t) + 90) % 180 - 90) < 3),)

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, close boolean")


@query("I16", """SELECT n_nationkey, s_suppkey AS id, 64 AS h, 64 AS w FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def crop_letterbox(spark, sf_dir):
    """Each part's crop, grown, kept inside the frame, and fitted to a square."""

    def kernel(n, image, parts):
        for p in parts.itertuples():
            c = vision.crop(image, (p.x1, p.y1, p.x2, p.y2), 0.15, 64)
            yield p.id, *c.shape[:2]

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, id int, h int, w int")


# ---- golden inspection


@query("I14 R7", """SELECT n_nationkey, s_suppkey AS id, TRUE AS valid, TRUE AS close FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE NOT EXISTS (SELECT 1 FROM supplier o WHERE o.s_nationkey = n_nationkey AND o.s_suppkey <> supplier.s_suppkey AND o.s_suppkey * 37 % 8 = supplier.s_suppkey * 37 % 8 AND o.s_suppkey * 53 % 6 = supplier.s_suppkey * 53 % 6)""")
def part_pose(spark, sf_dir):
    """Shift and turn of every part of a frame that was moved; of parts drawn over each other none can be measured."""

    def kernel(n, image, parts):
        m = motion(n)
        frame, golden = pixels.luminance(moved(image, m)), pixels.luminance(image)
        for p in visible(parts).itertuples():
            found = vision.pose(frame, golden, (p.x1, p.y1, p.x2, p.y2))
            centre = np.array([(p.x1 + p.x2 - 1) / 2, (p.y1 + p.y2 - 1) / 2, 1.0])
            want = m @ centre - centre
            close = found["valid"] and np.hypot(found["dx"] - want[0], found["dy"] - want[1]) < 0.75 and abs(found["angle"] - (n % 5 - 2) * 0.6) < 2.5
            yield p.id, found["valid"], bool(close)

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, id int, valid boolean, close boolean")


@query("I15", """SELECT n_nationkey, s_suppkey AS id, s_suppkey % 3 = 0 AS alike, s_suppkey % 3 <> 0 AS blob FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def part_appearance(spark, sf_dir):
    """Parts of which two in three were painted over: similarity, colour, edges and pieces of difference tell which."""

    def kernel(n, image, parts):
        for p in parts.itertuples():
            golden = image[p.y1 : p.y2, p.x1 : p.x2]
            view = golden.copy()
            if p.id % 3:
                view[2:-2, 2:12] = (20, 20, 200)
            c = vision.compared(view, golden)
            yield p.id, bool(c["ssim"] > 0.99 and c["colour"] < 1 and c["edges"] > 0.99), bool(c["blobs"] > 0 and c["largest"] >= 12 and c["different"] > 0.05)

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, id int, alike boolean, blob boolean")


@query("I17", """
SELECT n_nationkey, s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'demo' WHEN s_suppkey % 9 = 1 THEN 'outside' ELSE 'slot' END AS status,
  CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 9 <> 1 THEN 'S' || lpad(CAST(row_number() OVER (PARTITION BY n_nationkey, s_suppkey % 4 <> 0 AND s_suppkey % 9 <> 1 ORDER BY 14 + s_suppkey * 53 % 6 * 27, 14 + s_suppkey * 37 % 8 * 30, s_suppkey) AS VARCHAR), 4, '0') END AS slot, TRUE AS anchored
FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def recipe_enrollment(spark, sf_dir):
    """A recipe from each scene: slots in reading order, rejected parts with the reason, anchors on a grid."""

    def kernel(n, image, parts):
        rows = [{"id": p.id, "x1": p.x1, "y1": p.y1, "x2": p.x2 if p.id % 9 != 1 else 400, "y2": p.y2, "demo": p.id % 4 == 0} for p in parts.itertuples()]
        recipe = vision.enrolled(image, rows)
        anchored = len(recipe["anchors"]) >= 3
        for s in recipe["slots"]:
            yield s["id"], "slot", s["slot"], anchored
        for i, reason in recipe["rejected"]:
            yield i, reason, None, anchored

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, id int, status string, slot string, anchored boolean")


@query("R6 R7", """SELECT n_nationkey, s_suppkey AS id, CASE WHEN s_suppkey % 5 = 2 THEN 'ng' ELSE 'pass' END AS verdict FROM nation JOIN supplier ON s_nationkey = n_nationkey
  WHERE NOT EXISTS (SELECT 1 FROM supplier o WHERE o.s_nationkey = n_nationkey AND o.s_suppkey <> supplier.s_suppkey AND o.s_suppkey * 37 % 8 = supplier.s_suppkey * 37 % 8 AND o.s_suppkey * 53 % 6 = supplier.s_suppkey * 53 % 6)""")
def golden_inspection(spark, sf_dir):
    """Scenes turned and shifted, with some parts painted over, against recipes of the untouched ones: align, place, compare, decide."""

    def kernel(n, image, parts):
        shown, frame = visible(parts), image.copy()
        recipe = vision.enrolled(image, [r._asdict() for r in shown.itertuples()])
        for p in shown.itertuples():
            if p.id % 5 == 2:
                frame[p.y1 : p.y2, p.x1 : p.x2] = (20, 30, 160)
        _, found = vision.inspected(image, moved(frame, motion(n)), recipe)
        for s in found:
            yield s["id"], "pass" if s["status"] == "pass" else "ng" if s["status"].startswith("ng") else "review"

    return scenes(spark, sf_dir, kernel, f"{SCENE} int, id int, verdict string")
