"""Image queries without SQL, on the whole smallest table, against plain computations over the same frames."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from tallyforge.operators import images
from tallyforge.plans import catalog, imaging
from tallyforge.plans.tables import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding").toPandas()
    return {v: np.kron(np.clip(np.rint(127 + 400 * np.asarray(e, float)[:64]), 0, 255).astype(np.uint8).reshape(8, 8), np.ones((4, 4), np.uint8)) for v, e in zip(rows["vec_id"], rows["embedding"], strict=True)}


def hashed(frame):
    k, n = np.mgrid[0:8, 0:32]
    c = np.cos(np.pi / 32 * (n + 0.5) * k)
    low = c @ frame.astype(float) @ c.T
    return low > np.median(low)


def test_content_hash(spark, frames):
    got = dict(catalog.QUERIES["i01_content_hash"](spark, SF).toPandas().itertuples(index=False, name=None))
    assert got == {v: hashlib.sha256(f.tobytes()).hexdigest() for v, f in frames.items()}


def test_perceptual_hash(spark, frames):
    got = catalog.QUERIES["i02_perceptual_hash"](spark, SF).toPandas()
    assert set(got["vec_id"]) == set(frames) and got["error"].isna().all()
    # a term on the median itself may fall on either side by rounding: at most one of the 64
    for v, h in zip(got["vec_id"], got["phash"], strict=True):
        bits = np.array([int(b) for b in format(int(h) & (1 << 64) - 1, "064b")], bool)
        assert (bits != hashed(frames[v]).reshape(-1)).sum() <= 1


def test_accepted_patches_are_the_walk(spark):
    proposed = images.proposals(imaging.frames(spark, SF).drop("data"), "path", 8).where("is_valid").select("path", "zone", "try", "x", "y").toPandas()
    want = []
    for path, own in proposed.sort_values(["zone", "try", "x", "y"]).groupby("path"):
        taken = []
        for r in own.itertuples():
            if all(math.hypot(r.x - a.x, r.y - a.y) >= 4 for a in taken) and sum(a.zone == r.zone for a in taken) < 2:
                taken.append(r)
        want += [(path, r.zone, r.x, r.y) for r in taken]
    got = catalog.QUERIES["g14_accepted_patches"](spark, SF).select("path", "zone", "x", "y").toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want) and len(want)


def test_thumbnails(spark, frames):
    got = dict(catalog.QUERIES["i12_thumbnails"](spark, SF).toPandas().itertuples(index=False, name=None))
    assert set(got) == {f"/frames/{v}.png" for v in frames} and pd.Series(got).str.len().eq(64).all()


def test_one_pass_over_images(spark):
    """All variants, patches and transforms of an image from one row; bad images and bad patches give errors of their own."""
    rng = np.random.default_rng(3)
    blobs = [rng.integers(0, 256, 12 * 16, dtype=np.uint8).tobytes() for _ in range(4)] + [b"short"]
    rows = spark.createDataFrame([(f"p{i}", 12, 16, b, i % 2, [2.0, 2.0, 14.0, 10.0] if i else None) for i, b in enumerate(blobs)], "path string, height int, width int, data binary, label int, bbox array<double>")
    models = {"mean": lambda x: np.array([x.mean()]), "corner": lambda x: np.array([x[0, 0]]), "bad": lambda x: 1 / 0}
    got = {(r["path"], r["variant"]): r for r in images.score_variants(rows, {f"{n}{t}": (m, t, None) for n, m in models.items() for t in (0, 90)}, 4).collect()}
    assert len(got) == 5 * 6
    for i, blob in enumerate(blobs):
        for name in models:
            for turn in (0, 90):
                r = got[f"p{i}", f"{name}{turn}"]
                if i == 4 or name == "bad":
                    assert r["score"] is None and ("ValueError" if i == 4 else "ZeroDivisionError") in r["error"]
                    continue
                x = np.frombuffer(blob, np.uint8).reshape(12, 16).astype(float)
                x = images.shrink(np.rot90(x[2:10, 2:14] if i else x, turn // 90), 4, 4) / 255
                assert r["error"] is None and abs(r["logit"] - models[name](x)[0]) < 1e-12 and abs(r["score"] - 1 / (1 + np.exp(-r["logit"]))) < 1e-12
    plan = spark.createDataFrame([(f"p{i}", "edge", x, 3, 4) for i in range(5) for x in (0, 5)] + [("p0", "edge", 99, 3, 4), ("p9", "edge", 0, 0, 4)], "path string, zone string, x int, y int, size int")
    cut = {(r["path"], r["x"]): r for r in images.crop_patches(rows, plan, "path").collect()}
    for i in range(4):
        for x in (0, 5):
            p = np.frombuffer(blobs[i], np.uint8).reshape(12, 16)[3:7, x : x + 4]
            assert bytes(cut[f"p{i}", x]["patch"]) == p.tobytes() and abs(cut[f"p{i}", x]["grey_std"] - p.std()) < 1e-12 and cut[f"p{i}", x]["error"] is None
    assert "ValueError" in cut["p4", 0]["error"] and len([k for k in cut if k[0] == "p9"]) == 0
    changed = {(r["path"], r["how"]): r for r in images.anonymised(rows, ["mask", "downscale"]).collect()}
    assert len(changed) == 10 and changed["p0", "mask"]["error"] and not changed["p0", "downscale"]["error"]  # without a box there is no interior
    x = np.frombuffer(blobs[1], np.uint8).reshape(12, 16)
    y = np.frombuffer(changed["p1", "mask"]["blob"], np.uint8).reshape(12, 16)
    assert (y[:2] == x[:2]).all() and len(set(y[3:9, 3:13].ravel())) == 1
