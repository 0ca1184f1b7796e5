"""What several training-data operators share: table reading and tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows in an Arrow batch to Python; texts may be long, and Spark's default of 10,000 holds too many of them.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends this library to the executors' Python once for a session, and sets smaller Arrow batches for long texts.

    The batch size changes only where the session has Spark's default. It is read when a result is computed, which may be
    long after this call, so it stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_rosterloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="rosterloom-")  # the driver's; Spark serves the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/rosterloom.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(f"{folder}/rosterloom.zip")
    sc._rosterloom_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of a broadcast table in memory at most; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``; a temporary one only on a single machine without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    own = tempfile.mkdtemp(prefix="rosterloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the table; its lineage is a plain scan.

    The table goes when the driver's JVM ends, or earlier with ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for table in tables:
        at, files = _hadoop(table.sparkSession, table.kept_path)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


class Scratch:
    """Kept tables of one computation; ``clear`` deletes them but for those that its result reads."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(keep(df, name))
        return self.tables[-1]

    def clear(self, *but: DataFrame) -> None:
        drop(*(t for t in self.tables if all(t is not b for b in but)))
        self.tables = [t for t in self.tables if any(t is b for b in but)]


def fits(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a kept table take at most ``limit`` bytes as a hashed relation: the check before a broadcast.

    row_bytes: of a row's values; a row of a hashed relation has some 48 bytes besides (pointers, lengths, hash slots).
    """
    return table.count() * (row_bytes + 48) <= limit


def hinted(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` (a kept table) as a broadcast if it fits ``limit`` bytes, else to be shuffled."""
    return F.broadcast(small) if fits(small, row_bytes, limit) else small


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, lengthened until no column of ``taken`` has that name (Spark's names ignore case)."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def words_pattern() -> str:
    """Runs of anything but space and the five ASCII white-space controls."""
    return r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
