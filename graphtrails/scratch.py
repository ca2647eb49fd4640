"""Written intermediate tables.

Iterative operators cut their lineage by writing a Parquet table into the shared folder that the
session names in ``spark.checkpoint.dir`` and reading it back. A lost executor then costs a re-read,
never a re-run of earlier rounds, and each table is computed once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def one_row(*tables: DataFrame) -> DataFrame:
    """Tables of one row side by side, in one row."""
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for t in tables for c in t.columns])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only for a ``local`` master without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="graphtrails-")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


class Scratch:
    """A private folder of intermediate tables of one session."""

    _by_app: dict[str, "Scratch"] = {}

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.root = f"{folder or shared_folder(spark)}/graphtrails-{uuid.uuid4().hex}"
        self._n = 0

    @classmethod
    def of(cls, spark: SparkSession) -> "Scratch":
        """The session's default scratch folder."""
        app = spark.sparkContext.applicationId
        if app not in cls._by_app:
            cls._by_app[app] = cls(spark)
        return cls._by_app[app]

    def save(self, df: DataFrame, name: str, by: str | None = None, **metrics: Column) -> DataFrame | tuple[DataFrame, dict]:
        """Write ``df`` and read it back; ``metrics`` are aggregates observed during the same write.

        With ``by`` the table has a folder for each value of that column, so a filter on it reads only these.
        """
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        watch = None
        out = df
        if metrics:
            watch = Observation()
            out = df.observe(watch, *[c.alias(n) for n, c in metrics.items()])
        (out.write.partitionBy(by) if by else out.write).parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        if by:
            saved = saved.select(df.columns)
        saved._scratch_path = path
        return (saved, {k: v or 0 for k, v in watch.get.items()}) if metrics else saved

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` itself if it is a table made by ``save``, else the same written: for what several jobs read."""
        return df if hasattr(df, "_scratch_path") else self.save(df, name)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by ``save`` that nothing reads any more."""
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                self._delete(path)

    def close(self) -> None:
        """Delete everything; results that still read from here become unusable."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        if not path.startswith(self.root):
            raise ValueError(f"{path} is not below {self.root}")
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
