"""Tables written between jobs, and joins whose small side is measured first."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side up to so many bytes may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
_written: list[tuple[object, object]] = []
_fallback: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where that is unset, as in tests, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="tesselon-"))
        folder = _fallback[0]
    return folder.rstrip("/")


def store(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tesselon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    _written.append((target, target.getFileSystem(spark._jsc.hadoopConfiguration())))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = target
    return out


def forget(df: DataFrame) -> None:
    """Deletes a stored table that nothing will read again."""
    target = getattr(df, "_stored", None)
    for entry in [e for e in _written if e[0] is target]:
        entry[1].delete(target, True)
        _written.remove(entry)


@atexit.register
def _clean() -> None:
    for target, fs in _written:
        try:
            fs.delete(target, True)
        except Exception:  # the JVM may be gone
            return


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, with a broadcast hint if its counted rows fit the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def private_names(columns: list[str], *names: str) -> list[str]:
    """Names for columns of one's own that none of ``columns`` has, however written."""
    taken, prefix = {c.lower() for c in columns}, "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
