"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the one that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  In plain local mode
    a temporary one stands in where it is unset; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="meetpoint-")
    return f"{root.rstrip('/')}/meetpoint-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in either case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialise(df: DataFrame, compression: str = "snappy", *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: the rows survive lost executors, are computed once
    however often they are read, and the planner knows their size.  Each value of
    the columns ``folders`` has a folder of its own.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path, partitionBy=list(folders), compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of at most ``rows`` rows for the session, since texts are long.

    A Python worker holds a batch in several forms at once; Spark's own limit of
    10,000 rows would take it some hundred MB with documents of tens of KB.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > rows or int(df.sparkSession.conf.get(key)) <= 0:
        df.sparkSession.conf.set(key, rows)
    return df


def byte_blocks(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges (a, b) of the texts that end at ``offsets``, of at most ``most`` bytes each or of one text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage, since only then Spark's cleaner deletes the shuffle files of ended queries.

    Twice, with a second between, as the first time frees little of a query that has just ended (measured).
    """
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    spark.sparkContext._jvm.System.gc()


def delete_shared(df: DataFrame) -> None:
    """Delete the files that ``materialise`` wrote for ``df``."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text (0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus
