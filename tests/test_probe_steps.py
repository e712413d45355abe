"""A step of the probes' fits sums rows where they stand."""

import numpy as np
from pyspark.sql import functions as F

from tallyforge.operators import probes


def test_fits_move_no_vectors(spark, monkeypatch):
    """The weights are those of one batch, whatever the chunks; no step deals vectors over tasks again."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    rows = [(f"c{i % 2}", f"g{i}", int(y[i]), i % 3, x[i].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "c string, g string, y int, fold int, v array<double>")
    dealt, kind = [], type(df)
    grouped = kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *by: (dealt.append("v" in self.columns and "chunk" in by), grouped(self, *by))[1])
    whole = probes.fitted(df, 3, 1.0)
    monkeypatch.setattr(probes, "CHUNK", 7)
    parts = probes.fitted(df.repartition(5), 3, 1.0)
    assert not any(dealt) and set(whole) == set(parts) == {"c0", "c1"}
    for cell in whole:
        assert np.allclose(whole[cell], parts[cell], atol=1e-6)
    for cell, w in whole.items():
        own = df.where(F.col("c") == cell).toPandas()
        xo, yo = probes.design(own["v"]), own["y"].to_numpy()
        for fold in range(3):
            seen = own["fold"].to_numpy() != fold
            n = np.bincount(yo[seen], minlength=2)
            p = 1 / (1 + np.exp(-(xo @ w[fold])))
            s = seen * (seen.sum() / (2 * n))[yo]
            gradient = xo.T @ (s * (p - yo)) + np.r_[w[fold][:-1], 0]
            assert np.abs(gradient).max() < 1e-4
