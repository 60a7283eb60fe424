"""Tables in the shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application, in local mode only
_open: list[Scratch] = []  # the innermost last


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset a local master (driver and executors in one process)
    gets a temporary folder; on a cluster that would be wrong, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        base = _own.get(key) or _own.setdefault(key, tempfile.mkdtemp(prefix="tidewright-"))
    return base.rstrip("/")


class Scratch:
    """Remembers the tables that are kept inside it and removes them at its end.

    ``with Scratch(spark): some_query(spark, folder).write.parquet(path)`` leaves
    nothing but the result.  A result that is read later still needs its tables,
    so it must be written before the end.  ``clear`` removes those kept so far.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)
        self.clear()

    def clear(self) -> None:
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """As ``keep``, for this scope and no other."""
        spark, path = df.sparkSession, shared_path(df.sparkSession, name, self)
        df.write.options(**options).parquet(path)
        return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str, scope: Scratch | None = None) -> str:
    """A new path in the shared folder; the innermost open ``Scratch``, or ``scope``, removes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scope = scope or (_open[-1] if _open else None)
    if scope is not None:
        scope.paths.append(path)
    return path


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
