"""Queries over the image jobs. The frames are 32 x 32 grey images that Spark derives from the embeddings' 64 components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyforge.operators import aggregates as A
from tallyforge.operators import images as I
from tallyforge.operators import metrics as X
from tallyforge.operators import relating as J
from tallyforge.operators import sampling as S
from tallyforge.plans import tables as T
from tallyforge.plans.catalog import register
from tallyforge.plans.detection import r6


def frames(s, d):
    """vec_id, path, label, domain, height, width, bbox, data."""
    rows = T.samples(s, d).select("vec_id", "domain", "label", "embedding")

    def draw(batches):
        for pdf in I.pieces(batches):
            x = np.stack(pdf["embedding"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 64))
            grey = np.clip(np.rint(127 + 400 * x[:, :64]), 0, 255).astype(np.uint8).reshape(-1, 8, 8)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "domain": pdf["domain"], "label": pdf["label"], "data": [np.kron(g, np.ones((4, 4), np.uint8)).tobytes() for g in grey]})

    drawn = rows.mapInPandas(draw, "vec_id long, domain string, label int, data binary")
    box = F.array(*[(F.lit(float(b)) + F.col("vec_id") % 4).cast("double") for b in (6, 5, 22, 25)])
    return drawn.select("vec_id", F.concat(F.lit("/frames/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), "label", "domain", F.lit(32).alias("height"), F.lit(32).alias("width"), box.alias("bbox"), "data")


WEIGHTS = np.linspace(-1, 1, 64).reshape(8, 8)
MODEL, OTHER = I.linear_model(WEIGHTS, 0.0), I.linear_model(WEIGHTS.T, 0.1)


def bright(x: np.ndarray):
    """Boxes of the 8 x 8 cells that stand out, a little enlarged."""
    cell = I.shrink(x, 8, 8)
    for i, j in np.argwhere(cell > cell.mean() + cell.std()):
        yield (max(0, 4 * j - 2), max(0, 4 * i - 2), min(32, 4 * j + 6), min(32, 4 * i + 6), cell[i, j] / 255)


register("i01_content_hash")(lambda s, d: I.content_hash(frames(s, d)).select("vec_id", "content"))
register("i01_content_leakage")(lambda s, d: (lambda h: J.same_content(h.where("vec_id % 5 < 4"), h.where("vec_id % 5 = 4"), "content"))(I.content_hash(frames(s, d))))
register("i02_perceptual_hash")(lambda s, d: I.perceptual_hash(frames(s, d)).select("vec_id", "phash", "error"))


@register("i02_near_leakage")
def near_leakage(s, d):
    """Near-duplicate frames between splits: perceptual hashes of all frames, joined within a Hamming distance of 3; changed copies of some frames stand in the test split."""
    own = frames(s, d)
    flat = np.zeros(32 * 32, np.uint8)
    flat[:16] = 3  # a few pixels a little brighter: a near copy

    def lit(batches):
        for pdf in I.pieces(batches):
            data = [np.clip(np.frombuffer(x, np.uint8).astype(int) + flat, 0, 255).astype(np.uint8).tobytes() for x in pdf["data"]]
            yield pdf.assign(data=data)

    copies = own.where("vec_id % 25 = 0").mapInPandas(lit, own.schema)
    h = lambda t: I.perceptual_hash(t).where("error IS NULL").select(F.col("phash").alias("h"))
    return J.near_hashes(h(own.where("vec_id % 5 < 4")), h(own.where("vec_id % 5 = 4").unionByName(copies)), 3)


register("i03_low_resolution_export")(lambda s, d: I.export_low(frames(s, d), 12).select("id", "path", "export_height", "export_width", "blob"))
register("g13_patch_proposals")(lambda s, d: I.proposals(frames(s, d).drop("data"), "path", 8).select("path", "zone", "try", "x", "y", "is_valid"))
register("g14_accepted_patches")(lambda s, d: I.accepted(I.proposals(frames(s, d).drop("data"), "path", 8), "path", 8, 2, 4.0))
register("i04_patches")(lambda s, d: I.crop_patches(frames(s, d), I.accepted(I.proposals(frames(s, d).drop("data"), "path", 8), "path", 8, 2, 4.0), "path", 2.0).select("path", "zone", "x", "y", F.round("grey_std", 6).alias("grey_std"), F.sha2("patch", 256).alias("patch_hash")))
register("i05_batch_scores")(lambda s, d: r6(I.score(frames(s, d), MODEL, 8).select("path", "label", "logit", "score", "error"), "logit", "score"))
register("i06_rotation_sweep")(lambda s, d: r6(I.rotation_sweep(frames(s, d), {"first": MODEL, "second": OTHER}, 8, (0, 90)).select("model", "rotate", "bpcer", "apcer", "eer"), "bpcer", "apcer", "eer"))
register("i07_detections")(lambda s, d: I.detect(frames(s, d), bright).select("path", F.size("detections").alias("n"), "best_box", "error"))
register("i08_suppressed_detections")(lambda s, d: I.suppressed(I.detect(frames(s, d), bright), "detections", 0.1).select("path", F.size("detections").alias("n")))


@register("i09_embedding_extraction")
def extraction(s, d):
    """Sampled rows whose signature isn't stored yet, embedded."""
    rows = S.cell_sample(frames(s, d), ["domain", "label"], "path", 1, 20, "vec_id").withColumn("sig", J.signature(["path", "height", "width"]))
    fresh = J.not_yet(rows, rows.where("vec_id % 2 = 0").select("sig"), "sig")
    return I.each(fresh, lambda row: (I.shrink(I.pixels(row), 4, 4).reshape(-1).tolist(),), [("feats", "array<double>")]).select("vec_id", "domain", "label", "feats")


register("i10_spectral_effects")(lambda s, d: r6(A.cohens_d(I.spectral(frames(s, d)), "spectrum"), "d"))


@register("i11_band_removed")
def band_removed(s, d):
    out = I.band_sweep(frames(s, d), MODEL, 8, {"none": None, "low": (0.0, 0.4), "high": (0.4, 2.0)}).select("label", "score", "band", F.lit("all").alias("split"))
    return r6(X.change_from(X.eer(out, ["split", "band"]).select("split", "band", "eer"), ["split"], "band", "none", "eer"), "eer", "change")


register("i12_thumbnails")(lambda s, d: I.thumbnails(frames(s, d), 8).select("path", F.sha2("thumb", 256).alias("thumb_hash")))
register("i13_anonymised_frames")(lambda s, d: I.anonymised(frames(s, d), ["mask", "pixelate", "downscale"]).select("path", "how", F.sha2("blob", 256).alias("blob_hash")))


@register("k07_leak_report")
def leak_report(s, d):
    """Pairs of content between splits, as the report that is written only if it has rows; an empty table otherwise."""
    from tallyforge.sources import sinks
    from tallyforge.sources.staging import fresh_path

    h = I.content_hash(frames(s, d).unionByName(frames(s, d).where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 4)))
    found = J.same_content(h.where("vec_id % 5 < 4"), h.where("vec_id % 5 = 4"), "content")
    path = sinks.non_empty(found, fresh_path(s, "leaks"))
    return s.read.parquet(path) if path else found


@register("s07_image_files")
def image_files(s, d):
    """Files that Spark wrote from the frames, listed by suffix."""
    from tallyforge.sources import manifests, sinks
    from tallyforge.sources.staging import fresh_path

    folder = sinks.write(frames(s, d).select("vec_id", "data").repartition(4), fresh_path(s, "files"))
    found = manifests.image_files(s, folder, suffixes=("parquet",))
    return found.agg(F.count("*").alias("n_files"), (F.min("length") > 0).alias("all_have_bytes"))
