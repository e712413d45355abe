"""Linear probes of many cells side by side: balanced, regularised logistic fits, out of fold, checked by their AUC."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import metrics
from tallyforge.operators.sampling import balanced_folds, placed
from tallyforge.sources.staging import staged

#: Rows of a pair of sides that stand together and are summed up at a time, and partial sums that one task adds up.
CHUNK, PARTIALS = 8_192, 64
TOLERANCE, STEPS = 1e-9, 60


def pairs(rows: DataFrame, cell: list[str], side: Column, match: str, vector: str, group: str, key: str, side_cap: int | None, least: int, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Cells with their sizes, and the rows of each cell that can be probed (y 0) with those of the side it is held against (y 1) and their folds.

    A side's rows are repeated for each cell that is held against them, as folds are dealt anew in each cell.
    """
    own = rows.select(*dict.fromkeys([*cell, match, key]), F.col(group).cast("string").alias("_g"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), F.coalesce(side, F.lit(False)).alias("_side"))
    own = own.withColumn("c", F.to_json(F.struct(*cell), {"ignoreNullFields": "false"}))
    against = own.where("_side").drop("c")
    if side_cap is not None:
        against = placed(against, key, seed, [match]).where(F.col("place") < side_cap).drop("place")
    sizes = own.where("NOT _side").groupBy("c", *cell).agg(F.count("*").alias("n"), F.count_distinct("_g").alias("n_groups"))
    theirs = against.groupBy(F.col(match).alias("_m")).agg(F.count("*").alias("n_side"), F.count_distinct("_g").alias("side_groups"))
    sizes = staged(sizes.join(theirs, F.col(match) == F.col("_m"), "left").drop("_m"), "cells")
    # folds keep groups together where both sides have enough of them, else they deal rows
    fits = sizes.where(f"n >= {least} AND n_side >= {least}").select("c", F.col(match).alias("_m"), (F.least("n_groups", "side_groups") >= k).alias("whole"))
    row = ["c", "whole", "y", key, "_g", "v"]
    zero = own.where("NOT _side").join(fits.drop("_m"), "c").withColumn("y", F.lit(0)).select(*row)
    one = against.join(fits, F.col(match) == F.col("_m")).withColumn("y", F.lit(1)).select(*row)
    both = staged(zero.unionByName(one).withColumn("g", F.when(F.col("whole"), F.col("_g")).otherwise(F.concat_ws("|", F.lit("row"), "y", key))).drop("whole", "_g"), "probe-rows")
    return sizes, staged(balanced_folds(both, "g", k, "y", ["c"], seed), "probe-pairs")


def design(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy())
    return np.c_[x, np.ones(len(x))]


def logistic_sums(x: np.ndarray, y: np.ndarray, s: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """For the fits of w (one a row), by the rows' weights s (rows x fits): loss, gradient and Hessian of the logistic loss."""
    z = x @ w.T
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    curve = s * p * (1 - p)
    loss = (s * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
    return [loss, ((p - y[:, None]) * s).T @ x, np.stack([x.T @ (x * curve[:, [f]]) for f in range(w.shape[0])])]


def fitted(rows: DataFrame, k: int, c: float) -> dict[str, np.ndarray]:
    """Weights (fold x dimension, the last for the constant) of each cell's fits, each by Newton's method on the rows outside its fold.

    A step is one job over all cells and folds: partial sums of losses, gradients and Hessians of the rows where they stand (dealt by cell and chunk
    once), added up in two steps, solved in the tasks. The driver has the weights alone: cells x folds x dimensions numbers.
    """
    counted = rows.groupBy("c", "fold", "y").agg(F.count("*").alias("n"), F.first(F.size("v")).alias("d")).collect()  # cells x folds x 2
    share: dict[str, np.ndarray] = {}
    width = 1 + max((r["d"] for r in counted), default=0)
    for r in counted:
        share.setdefault(r["c"], np.zeros((k, 2)))[r["fold"], r["y"]] = r["n"]
    # balanced: a class weighs as much as the other, among the rows that a fit sees
    seen = {cell: n.sum(0)[None, :] - n for cell, n in share.items()}
    weight = {cell: np.where(n > 0, n.sum(1, keepdims=True) / (2 * np.maximum(n, 1)), 0) for cell, n in seen.items()}
    state = {cell: (np.zeros((k, width)), np.zeros((k, width)), np.full(k, np.inf)) for cell in share}  # tried, kept, the kept one's loss
    done: dict[str, np.ndarray] = {}
    sizes = rows.groupBy("c").agg(F.count("*").alias("_n"))
    chunked = rows.join(sizes, "c").withColumn("chunk", F.pmod(F.xxhash64("g"), F.ceil(F.col("_n") / CHUNK))).drop("_n")
    chunked = staged(chunked.select("c", "chunk", "y", "fold", "v").repartition("c", "chunk").sortWithinPartitions("c", "chunk"), "probe-chunks")

    for _ in range(STEPS):
        if not state:
            break
        now = {cell: s[0] for cell, s in state.items()}

        def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A row of sums for each run of rows of a cell."""
            cell, part, total = None, 0, None
            row = lambda: pd.DataFrame({"c": [cell], "part": [part], "sums": [total.tobytes()]})
            for pdf in parts:
                for c_, whole in pdf.groupby("c", sort=False):
                    for i in range(0, len(whole), CHUNK):
                        own = whole.iloc[i : i + CHUNK]
                        y, fold = own["y"].to_numpy(), own["fold"].to_numpy()
                        s = weight[c_].T[y] * (fold[:, None] != np.arange(k)[None, :])
                        sums = np.concatenate([x.ravel() for x in logistic_sums(design(own["v"]), y, s, now[c_])])
                        if total is not None and c_ != cell:
                            yield row()
                            total = None
                        cell, part, total = c_, int(own["chunk"].iloc[0]) % PARTIALS, sums if total is None else total + sums
            if total is not None:
                yield row()

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"c": pdf["c"].iloc[:1], "part": [0], "sums": [sum(np.frombuffer(b) for b in pdf["sums"]).tobytes()]})

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            cell = pdf["c"].iloc[0]
            flat = sum(np.frombuffer(b) for b in pdf["sums"])
            w = now[cell]
            loss, gradient, hessian = flat[:k], flat[k : k + k * width].reshape(k, width), flat[k + k * width :].reshape(k, width, width)
            ridge = np.r_[np.ones(width - 1), 0.0] / c
            loss = loss + (ridge * w * w).sum(1) / 2
            step = np.stack([np.linalg.lstsq(h + np.diag(ridge), g + ridge * x, rcond=None)[0] for h, g, x in zip(hessian, gradient, w, strict=True)])
            return pd.DataFrame({"c": [cell], "loss": [loss.tobytes()], "step": [step.tobytes()]})

        sums = chunked.where(F.col("c").isin(list(state))).mapInPandas(partial, "c string, part int, sums binary")
        sums = sums.groupBy("c", "part").applyInPandas(add, "c string, part int, sums binary")
        for r in sums.groupBy("c").applyInPandas(solve, "c string, loss binary, step binary").collect():
            (tried, kept, best), loss, step = state[r["c"]], np.frombuffer(r["loss"]), np.frombuffer(r["step"]).reshape(k, width)
            better = loss <= best + 1e-12 * np.abs(loss)
            # a step that made a fit worse is halved
            following = np.where(better[:, None], tried - step, (tried + kept) / 2)
            state[r["c"]] = (following, np.where(better[:, None], tried, kept), np.where(better, loss, best))
            if np.abs(following - tried).max() < TOLERANCE:
                done[r["c"]] = following
                del state[r["c"]]
    return done | {cell: s[1] for cell, s in state.items()}


def out_of_fold(data: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """The rows' other columns with z and p: the log-odds and chance of y = 1 by the fit that hasn't seen the row."""
    rest = [f for f in data.schema if f.name != "v"]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.stack([weights[a][f] for a, f in zip(pdf["c"], pdf["fold"], strict=True)])
        z = (design(pdf["v"]) * w).sum(1)
        return pdf[[f.name for f in rest]].assign(z=z, p=1 / (1 + np.exp(-np.clip(z, -700, 700))))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return data.mapInPandas(lambda parts: (score(p) for p in parts if len(p)), f"{kinds}, z double, p double")


def cell_probes(rows: DataFrame, cell: list[str], side: Column, match: str, vector: str = "embedding", group: str = "grp", key: str = "vec_id", side_cap: int | None = None, least: int = 20, k: int = 5, c: float = 1.0, seed: int = 42) -> DataFrame:
    """cell, n, auc: of each cell of the rows outside the side, how well a linear probe tells it from the side's rows with its value of match.

    Logistic fits with balanced weights and inverse regularisation c, one for each fold, judged by the AUC of the rows that they haven't seen. Folds keep
    groups together where the cell and the side both have k groups or more. A cell and its side have all their rows, unless side_cap is given: then a
    side is cut to so many rows for each value of match, in keyed order. auc is null under `least` rows of either, and for a null match. Many cells are one
    job a step; building the result runs the jobs. An empty table gives an empty result.
    """
    sizes, data = pairs(rows, cell, side, match, vector, group, key, side_cap, least, k, seed)
    scored = out_of_fold(data, fitted(data, k, c))
    return sizes.join(metrics.auc(scored, ["c"], "z", "y"), "c", "left").select(*cell, "n", "auc")
