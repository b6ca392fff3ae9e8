"""Reading the tables and keeping intermediate ones."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; with the columns kept by callers this is some tens of MB at most.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    A temporary one is made only where the setting is absent and the session runs on one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        global _own
        _own = _own or "file://" + tempfile.mkdtemp(prefix="symgrid-")
        found = _own
    return found.rstrip("/")


_own: str | None = None
_written: dict[str, SparkSession] = {}


def _delete(path: str, spark: SparkSession) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone
        pass


def _clean() -> None:
    for path, spark in _written.items():
        _delete(path, spark)


atexit.register(_clean)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts the lineage and survives lost executors.

    What is kept stays until ``forget`` or the end of the interpreter.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/symgrid/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def forget(*kept: DataFrame | None) -> None:
    """Deletes what ``keep`` wrote, for rounds of a loop that nothing reads any more. Frames that weren't kept are left alone."""
    for df in kept:
        path = getattr(df, "_kept_at", None)
        if path in _written:
            _delete(path, _written.pop(path))


class Pile:
    """A table that grows by parts in the shared folder: a round writes its own rows only, and all are one scan."""

    def __init__(self, name: str) -> None:
        self.name, self.parts = name, []

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a part and returns it."""
        self.parts.append(keep(df, self.name))
        return self.parts[-1]

    def all(self) -> DataFrame:
        first = self.parts[0]
        return first.sparkSession.read.schema(first.schema).parquet(*[p._kept_at for p in self.parts])


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (counted), else unchanged for a shuffled join.

    Meant for kept or small sources: another plan would run once for the count and once for the join.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
