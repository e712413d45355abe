"""Distributed per-image jobs: numpy kernels over rows (path, height, width, data), grey images with a byte a pixel.

Spark deals the rows; a kernel sees one image. A bad image gives a null result and an error text, never a made-up score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import boxes, keyed, scores
from tallyforge.operators import metrics

ZONES = ("interior", "edge", "exterior")
#: Images of a batch whose results a worker holds at once.
AT_ONCE = 256


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches' rows, AT_ONCE at a time; an empty batch stays one."""
    for pdf in batches:
        for i in range(0, max(1, len(pdf)), AT_ONCE):
            yield pdf.iloc[i : i + AT_ONCE]


def pixels(row) -> np.ndarray:
    """The image of a row as height x width doubles; an error if its bytes don't fit."""
    x = np.frombuffer(row.data, np.uint8)
    if len(x) != row.height * row.width or not len(x):
        raise ValueError(f"{len(x)} bytes for {row.height} x {row.width}")
    return x.reshape(row.height, row.width).astype(float)


def as_bytes(x: np.ndarray) -> bytes:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8).tobytes()


def shrink(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the boxes of a height x width grid, parts of pixels counting in part."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        left, right = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
        w = np.maximum(right - left, 0)
        return w / w.sum(axis=1, keepdims=True)

    return weights(x.shape[0], height) @ x @ weights(x.shape[1], width).T


def each(rows: DataFrame, kernel: Callable, fields: Sequence[tuple[str, str]], drop: Sequence[str] = ("data",)) -> DataFrame:
    """rows (less the dropped columns) with the fields that kernel(row) returns as a tuple, and error."""
    kept = [c for c in rows.columns if c not in drop]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"`{n}` {t}" for n, t in fields] + ["error string"])
    names = [n for n, _ in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            found = []
            for row in pdf.itertuples(index=False):
                try:
                    found.append((*kernel(row), None))
                except Exception as e:  # one bad image must not end the job
                    found.append((*[None] * len(names), f"{type(e).__name__}: {e}"[:200]))
            out = pdf[kept].reset_index(drop=True)
            got = pd.DataFrame({n: pd.Series([f[i] for f in found], dtype=object) for i, n in enumerate([*names, "error"])})
            yield pd.concat([out, got], axis=1)

    return rows.mapInPandas(run, schema)


def content_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content", F.sha2("data", 256))


COSINES = np.cos(np.pi / 32 * (np.arange(32)[None, :] + 0.5) * np.arange(8)[:, None])


def perceptual_hash(rows: DataFrame) -> DataFrame:
    """phash: 64 bits, which of the 8 x 8 lowest cosine terms of a 32 x 32 mean image are above their median."""

    def kernel(row):
        low = COSINES @ shrink(pixels(row), 32, 32) @ COSINES.T
        bits = (low > np.median(low)).reshape(-1)
        return (int(np.packbits(bits).view(">i8")[0]),)

    return each(rows, kernel, [("phash", "bigint")])


def export_low(rows: DataFrame, size: int, seed: int | str = 42) -> DataFrame:
    """id, export_height, export_width, blob: images shrunk to a long side of at most size, under opaque ids."""
    scale = boxes.export_scale(F.greatest("height", "width").cast("double"), size)
    sized = rows.withColumn("export_height", boxes.scaled_side(F.col("height"), scale)).withColumn("export_width", boxes.scaled_side(F.col("width"), scale)).withColumn("id", keyed.opaque_id(F.lit(str(seed)), F.col("path")))
    return each(sized, lambda row: (as_bytes(shrink(pixels(row), row.export_height, row.export_width)),), [("blob", "binary")])


def proposals(rows: DataFrame, key: str, size: int, tries: int = 12, seed: int | str = 42) -> DataFrame:
    """rows (key, height, width, bbox) with zone, try, x, y: patches proposed inside, on the edge of and outside the box, kept in the frame, from keyed uniforms."""
    e = rows.withColumn("zone", F.explode(F.array(*map(F.lit, ZONES)))).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    u = [keyed.uniform(f"{seed}-{i}", F.concat_ws("|", key, "zone", "try")) for i in range(3)]
    x1, y1, x2, y2 = boxes.sides(F.col("bbox"))
    # a point of the perimeter by its length, moved out by a patch for the exterior
    w, h = x2 - x1, y2 - y1
    t = u[0] * 2 * (w + h)
    px = F.when(t < w, x1 + t).when(t < w + h, x2).when(t < 2 * w + h, x1 + t - w - h).otherwise(x1)
    py = F.when(t < w, y1).when(t < w + h, y1 + t - w).when(t < 2 * w + h, y2).otherwise(y1 + t - 2 * w - h)
    out_x, out_y = F.signum(px - (x1 + x2) / 2), F.signum(py - (y1 + y2) / 2)
    cx = F.when(F.col("zone") == "interior", x1 + u[0] * w).when(F.col("zone") == "edge", px + (u[1] - 0.5) * size / 2).otherwise(px + out_x * size * (0.6 + u[1]))
    cy = F.when(F.col("zone") == "interior", y1 + u[1] * h).when(F.col("zone") == "edge", py + (u[2] - 0.5) * size / 2).otherwise(py + out_y * size * (0.6 + u[2]))
    place = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(c - size / 2.0).cast("int"), F.col(n).cast("int") - size))
    out = e.withColumn("x", place(cx, "width")).withColumn("y", place(cy, "height"))
    patch = F.array(*[c.cast("double") for c in (F.col("x"), F.col("y"), F.col("x") + size, F.col("y") + size)])
    found = boxes.zone(patch, F.col("bbox"))
    return out.where((F.col("width") >= size) & (F.col("height") >= size)).withColumn("is_valid", F.coalesce(found == F.col("zone"), F.lit(False)))


def accepted(proposed: DataFrame, key: str, size: int, per_zone: int, least_distance: float) -> DataFrame:
    """Valid proposals of each image in order of (zone, try) whose centres stay apart, at most per_zone of a zone: a bounded walk over an image's own proposals."""
    own = proposed.where("is_valid").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("zone", "try", "x", "y"))).alias("p"))
    struct = "array<struct<zone:string,try:int,x:int,y:int>>"
    far = lambda acc, p: F.forall(acc, lambda a: F.hypot((a["x"] - p["x"]).cast("double"), (a["y"] - p["y"]).cast("double")) >= least_distance)
    room = lambda acc, p: F.size(F.filter(acc, lambda a: a["zone"] == p["zone"])) < per_zone
    walk = F.aggregate("p", F.array().cast(struct), lambda acc, p: F.when(far(acc, p) & room(acc, p), F.concat(acc, F.array(p))).otherwise(acc))
    return own.select(key, F.explode(walk).alias("s")).select(key, "s.zone", "s.x", "s.y").withColumn("size", F.lit(size))


def crop_patches(rows: DataFrame, planned: DataFrame, key: str, flat: float = 0.0) -> DataFrame:
    """key, height, width, planned's columns, grey_std, patch, error: the planned crops (x, y, size); patches flatter than flat are left out.

    An image's plan goes to it as one list, so an image is moved and decoded once, however many patches it gives.
    """
    names = [c for c in planned.columns if c != key]
    plan = planned.groupBy(key).agg(F.collect_list(F.struct(*names)).alias("planned"))  # a list of one image's patches
    lists = {c: F.col("planned")[c].cast("array<long>") for c in ("x", "y", "size")}
    j = rows.select(key, "height", "width", "data").join(plan, key).select("*", *[v.alias(f"all_{c}") for c, v in lists.items()])

    def kernel(row):
        image, stds, patches, errors = pixels(row), [], [], []
        for x, y, size in zip(row.all_x, row.all_y, row.all_size, strict=True):
            try:
                p = image[y : y + size, x : x + size]
                found = (float(p.std()), as_bytes(p), None)
            except Exception as e:  # one bad patch must not take the others along
                found = (None, None, f"{type(e).__name__}: {e}"[:200])
            for out, value in zip((stds, patches, errors), found, strict=True):
                out.append(value)
        return stds, patches, errors

    cut = each(j, kernel, [("stds", "array<double>"), ("patches", "array<binary>"), ("errors", "array<string>")], drop=("data", "all_x", "all_y", "all_size"))
    one = cut.select(key, "height", "width", "stds", "patches", "errors", "error", F.posexplode("planned").alias("i", "p"))
    at = {new: F.get(old, F.col("i")) for old, new in (("stds", "grey_std"), ("patches", "patch"))}
    one = one.select(key, "height", "width", *[F.col(f"p.{c}").alias(c) for c in names], *[v.alias(c) for c, v in at.items()], F.coalesce("error", F.get("errors", F.col("i"))).alias("error"))
    return one.where(F.col("error").isNotNull() | (F.col("grey_std") >= flat))


_sessions: dict = {}


def onnx_model(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """Scores of images by an ONNX file, with one session and one thread in a worker."""

    def run(x: np.ndarray) -> np.ndarray:
        if path not in _sessions:
            import onnxruntime as ort

            options = ort.SessionOptions()
            options.intra_op_num_threads = 1
            _sessions[path] = ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        s = _sessions[path]
        return np.asarray(s.run(None, {s.get_inputs()[0].name: x[None].astype(np.float32)})[0]).reshape(-1)

    return run


def linear_model(weights: np.ndarray, bias: float = 0.0) -> Callable[[np.ndarray], np.ndarray]:
    """One logit from a weight for each pixel of a square input."""
    return lambda x: np.array([(x * weights).sum() + bias])


def viewed(x: np.ndarray, size: int, rotate: int, band: tuple[float, float] | None) -> np.ndarray:
    """An image turned, without a frequency band, shrunk to size x size, in [0, 1]."""
    x = np.rot90(x, rotate // 90)
    if band:
        f = np.fft.fftshift(np.fft.fft2(x))
        r = np.hypot(*np.meshgrid(*[np.linspace(-1, 1, n) for n in f.shape], indexing="ij"))
        x = np.fft.ifft2(np.fft.ifftshift(np.where((r >= band[0]) & (r < band[1]) & (r > 0), 0, f))).real
    return shrink(x, size, size) / 255


def score_variants(rows: DataFrame, variants: dict[str, tuple[Callable, int, tuple[float, float] | None]], size: int) -> DataFrame:
    """rows (less data) with variant, logit, score and error, a row for each of variants: name -> (model, turn in degrees, band to remove or None).

    An image (cropped to bbox where there is one) is moved and decoded once for all of them.
    """
    has_box, names = "bbox" in rows.columns, list(variants)

    def kernel(row):
        x = pixels(row)
        if has_box and row.bbox is not None:
            x1, y1, x2, y2 = (int(v) for v in row.bbox)
            x = x[y1:y2, x1:x2]
        logits, errors = [], []
        for model, rotate, band in variants.values():
            try:
                logits.append(float(model(viewed(x, size, rotate, band))[0]))
                errors.append(None)
            except Exception as e:  # one model's trouble must not take the others along
                logits.append(None)
                errors.append(f"{type(e).__name__}: {e}"[:200])
        return logits, errors

    found = each(rows, kernel, [("logits", "array<double>"), ("errors", "array<string>")])
    kept = [c for c in found.columns if c not in ("logits", "errors", "error")]
    one = found.select("*", F.posexplode(F.array(*map(F.lit, names))).alias("i", "variant"))
    z = F.get("logits", F.col("i"))
    return one.select(*kept, "variant", z.alias("logit"), scores.sigmoid(z).alias("score"), F.coalesce("error", F.get("errors", F.col("i"))).alias("error"))


def score(rows: DataFrame, model: Callable[[np.ndarray], np.ndarray], size: int, rotate: int = 0, band: tuple[float, float] | None = None) -> DataFrame:
    """rows with logit, score and error of one variant."""
    return score_variants(rows, {"": (model, rotate, band)}, size).drop("variant")


def rotation_sweep(rows: DataFrame, models: dict[str, Callable], size: int, rotations: Sequence[int] = (0, 90, 180, 270)) -> DataFrame:
    """model, rotate and the metric row of each pair, from one pass over the images."""
    variants = {f"{turn} {name}": (model, turn, None) for name, model in models.items() for turn in rotations}
    found = score_variants(rows, variants, size).select("label", "score", "variant")
    split = F.split("variant", " ", 2)
    return metrics.metric_row(found.select("label", "score", split[1].alias("model"), split[0].cast("int").alias("rotate")), 0.5, ["model", "rotate"])


def band_sweep(rows: DataFrame, model: Callable, size: int, bands: dict[str, tuple[float, float] | None]) -> DataFrame:
    """rows with band, logit, score and error: the model without each of the bands (None: whole), from one pass over the images."""
    return score_variants(rows, {name: (model, 0, band) for name, band in bands.items()}, size).withColumnRenamed("variant", "band")


def detect(rows: DataFrame, detector: Callable[[np.ndarray], Sequence[tuple]], best_only: bool = False) -> DataFrame:
    """rows with detections (box, score), best first, and best_box; an image with an error has none."""

    def kernel(row):
        found = sorted(detector(pixels(row)), key=lambda d: (-d[4], d[:4]))[: 1 if best_only else None]
        return ([{"box": [float(v) for v in d[:4]], "score": float(d[4])} for d in found],)

    out = each(rows, kernel, [("detections", "array<struct<box:array<double>,score:double>>")])
    return out.withColumn("best_box", F.try_element_at("detections", F.lit(1))["box"])


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    i = boxes.intersection(a, b)
    return i / (boxes.area(a) + boxes.area(b) - i)


def suppressed(rows: DataFrame, detections: str, threshold: float = 0.5, top: int = 100) -> DataFrame:
    """rows whose detections, best first, overlap no better one that stays by more than threshold; at most top."""
    element = rows.schema[detections].dataType.simpleString()
    walk = F.aggregate(F.col(detections), F.array().cast(element), lambda acc, d: F.when(F.forall(acc, lambda a: overlap(a["box"], d["box"]) <= threshold), F.concat(acc, F.array(d))).otherwise(acc))
    return rows.withColumn(detections, F.slice(walk, 1, top))


def spectral(rows: DataFrame, bands: int = 8, turns: int = 4) -> DataFrame:
    """spectrum: log power of a windowed image in bands of radius x orientations, less its mean."""

    def kernel(row):
        x = pixels(row)
        w = np.outer(np.hanning(x.shape[0]), np.hanning(x.shape[1]))
        p = np.abs(np.fft.fftshift(np.fft.fft2((x - x.mean()) * w))) ** 2
        yy, xx = np.meshgrid(*[np.linspace(-1, 1, n) for n in p.shape], indexing="ij")
        r = np.minimum((np.hypot(yy, xx) / np.sqrt(2) * bands).astype(int), bands - 1)
        t = np.minimum((np.mod(np.arctan2(yy, xx), np.pi) / np.pi * turns).astype(int), turns - 1)
        cell = (r * turns + t).reshape(-1)
        mean = np.bincount(cell, p.reshape(-1), bands * turns) / np.maximum(np.bincount(cell, minlength=bands * turns), 1)
        v = np.log(mean + 1e-6)
        return ((v - v.mean()).tolist(),)

    return each(rows, kernel, [("spectrum", "array<double>")])


def thumbnails(rows: DataFrame, size: int) -> DataFrame:
    """thumb: the image in a square of size, as bytes."""
    return each(rows, lambda row: (as_bytes(shrink(pixels(row), size, size)),), [("thumb", "binary")])


def anonymised(rows: DataFrame, hows: Sequence[str], share: float = 0.05, cells: int = 4) -> DataFrame:
    """rows (less data) with how, blob and error for each of hows: the box's interior (less a band of share) set to its mean (mask) or to a cells x cells
    mosaic (pixelate), or all of the image as a mosaic (downscale). An image is moved and decoded once.
    """

    def mosaic(x: np.ndarray) -> np.ndarray:
        h, w = min(cells, x.shape[0]), min(cells, x.shape[1])
        return shrink(x, h, w)[np.minimum(np.arange(x.shape[0]) * h // x.shape[0], h - 1)][:, np.minimum(np.arange(x.shape[1]) * w // x.shape[1], w - 1)]

    def changed(x: np.ndarray, box, how: str) -> bytes:
        if how == "downscale":
            return as_bytes(mosaic(x))
        x = x.copy()
        x1, y1, x2, y2 = box
        mx, my = (x2 - x1) * share, (y2 - y1) * share
        a, b, c, d = int(y1 + my), int(y2 - my), int(x1 + mx), int(x2 - mx)
        x[a:b, c:d] = x[a:b, c:d].mean() if how == "mask" else mosaic(x[a:b, c:d])
        return as_bytes(x)

    def kernel(row):
        x, blobs, errors = pixels(row), [], []
        for how in hows:
            try:
                blobs.append(changed(x, row.bbox, how))
                errors.append(None)
            except Exception as e:
                blobs.append(None)
                errors.append(f"{type(e).__name__}: {e}"[:200])
        return blobs, errors

    found = each(rows, kernel, [("blobs", "array<binary>"), ("errors", "array<string>")])
    kept = [c for c in found.columns if c not in ("blobs", "errors", "error")]
    one = found.select("*", F.posexplode(F.array(*map(F.lit, hows))).alias("i", "how"))
    return one.select(*kept, "how", F.get("blobs", F.col("i")).alias("blob"), F.coalesce("error", F.get("errors", F.col("i"))).alias("error"))
