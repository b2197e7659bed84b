"""Tables written between the rounds of an iteration."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side up to so many bytes may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
_written: dict[str, tuple] = {}
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset a local session, as in tests, gets
    a temporary one; a cluster's executors would not see that, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tesselon-"))
        folder = _own[0]
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """A new folder name that all executors see; what is written there goes when the program ends."""
    path = f"{shared_folder(spark)}/tesselon-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    _written[path] = (target, target.getFileSystem(spark._jsc.hadoopConfiguration()))
    return path


def store(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = own_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a stored table that nothing will read again."""
    target, fs = _written.pop(getattr(df, "_stored", ""), (None, None))
    if target is not None:
        fs.delete(target, True)


@atexit.register
def _clean() -> None:
    for target, fs in _written.values():
        try:
            fs.delete(target, True)
        except Exception:  # the JVM may be gone
            return


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, with a broadcast hint if its counted rows are small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def private_names(columns: list[str], *names: str) -> list[str]:
    """Names for columns of one's own that none of ``columns`` has, however written."""
    taken, prefix = {c.lower() for c in columns}, "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]
