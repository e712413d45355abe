"""A store of computed rows by source: only sources whose signature has changed are computed and written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SignedStore:
    """Rows by (key, signature) in a folder that all executors see, and the list of those that are current.

    A run writes the changed sources' partitions beside the old ones, then a new list, then removes partitions that no list names. A run that ends
    between two steps leaves the last list in force: readers never see half a source, and the next run does the rest.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _folder(self, name: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), folder

    def _names(self, name: str) -> list[str]:
        fs, folder = self._folder(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _version(self) -> int:
        """The last list that was written whole; 0 for none."""
        whole = [n for n in self._names("lists") if "_SUCCESS" in self._names(f"lists/{n}")]
        return max((int(n.removeprefix("list-")) for n in whole), default=0)

    def signatures(self) -> DataFrame:
        """key, signature of the current sources."""
        kind, version = f"{self.key} string, signature string", self._version()
        return self.spark.read.schema(kind).parquet(f"{self.path}/lists/list-{version:09d}") if version else self.spark.createDataFrame([], kind)

    def update(self, current: DataFrame, compute: Callable[[DataFrame], DataFrame], force: bool = False) -> dict[str, int]:
        """Brings the store to current (key, signature; keys are distinct and not null), and returns how many sources were computed, kept and removed.

        compute gets the (key, signature) rows to compute and returns their rows with the key as text; it isn't called if there are none. A source without
        rows is current with none. force computes all. Sources are few: the numbers of partitions and of listed sources are alike.
        """
        current = current.select(F.col(self.key).cast("string").alias(self.key), F.col("signature").cast("string").alias("signature"))
        old = self.signatures()
        changed = current if force else current.join(old, [self.key, "signature"], "left_anti")
        gone = old.join(current, self.key, "left_anti")
        n = {"computed": changed.count(), "kept": 0, "removed": gone.count()}
        n["kept"] = current.count() - n["computed"]
        if n["computed"]:
            rows = compute(changed).join(changed, self.key)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key, "signature").parquet(f"{self.path}/rows")
        if n["computed"] or n["removed"]:
            version = self._version() + 1
            current.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/list-{version:09d}")
            self._clean(version)
        return n

    def _clean(self, version: int) -> None:
        """Removes older lists and the partitions that the last list doesn't name."""
        live = {(r[self.key], r["signature"]) for r in self.signatures().collect()}  # a row for each source
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        value = lambda folder: name(folder.split("=", 1)[1])
        for source in (x for x in self._names("rows") if "=" in x):
            of = [x for x in self._names(f"rows/{source}") if "=" in x]
            stale = [x for x in of if (value(source), value(x)) not in live]
            for x in [f"rows/{source}"] if len(stale) == len(of) else [f"rows/{source}/{x}" for x in stale]:
                fs, folder = self._folder(x)
                fs.delete(folder, True)
        for x in self._names("lists"):
            if int(x.removeprefix("list-")) < version:
                fs, folder = self._folder(f"lists/{x}")
                fs.delete(folder, True)

    def read(self, schema: str) -> DataFrame:
        """The current sources' rows with the given columns, the key and the signature."""
        if not self._names("rows"):
            return self.spark.createDataFrame([], f"{schema}, {self.key} string, signature string")
        rows = self.spark.read.schema(f"{schema}, {self.key} string, signature string").parquet(f"{self.path}/rows")
        return rows.join(self.signatures(), [self.key, "signature"], "left_semi")
