"""Writers; each returns the path or paths that it wrote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import keyed, scores


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if kind == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(kind).save(path)
    return path


def score_table(df: DataFrame) -> DataFrame:
    return df.select("path", "label", "score")


def prediction_table(df: DataFrame, logit: str = "logit") -> DataFrame:
    """All columns with score and prediction from the logit."""
    return df.withColumn("score", scores.sigmoid(F.col(logit))).withColumn("prediction", scores.hard(F.col(logit)))


def public_private(df: DataFrame, path: str, key: str, shared: Sequence[str], seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    """A shareable table (id, relative_path and the shared columns, without sources) and the private map from ids to sources; both in keyed order."""
    ident = keyed.opaque_id(F.lit(str(seed)), F.col(key).cast("string"), F.col(path))
    rows = df.withColumn("id", ident).withColumn("relative_path", blob_path(F.col("label"), F.col("id")))
    rows = rows.withColumn("_o", keyed.shuffle_key(seed, F.col("id"))).orderBy("_o").drop("_o")
    return rows.select("id", "relative_path", *shared), rows.select("id", key, path)


def blob_path(label: Column, ident: Column) -> Column:
    """label/two hexadecimal digits/id."""
    return F.concat_ws("/", label.cast("string"), F.substring(ident, 1, 2), ident)


def non_empty(df: DataFrame, path: str, kind: str = "parquet") -> str | None:
    """Writes unless there are no rows."""
    return None if df.isEmpty() else write(df, path, kind)


def summary_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("summary"))


def trial_table(parts: Sequence[DataFrame]) -> DataFrame:
    """The union of all columns seen."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
