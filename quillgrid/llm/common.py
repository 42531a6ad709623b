"""What the operators share: table access, shared temporary tables, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Put the folder of this package on the Python path of the session's workers."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only where the master is this machine and none is named is one made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quillgrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores, if it is read in fewer pieces than there are cores.

    Only tables of fewer bytes than one split a core are read so, as a file's row groups are not split; a larger one
    passes as it is, without a shuffle. So does what comes from a shuffle or broadcast, which has its own partitions.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; this cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table that stage() made and that no pending plan reads."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def own_names(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """docs with columns named c0_, c1_, ..., and what the wanted ones are called there.

    So no column that only passes through can have the name of one that an operator adds.
    """
    names = [f"c{i}_" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(c)] for c in wanted]


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """Maximal runs without ASCII white space (x20, x09-x0D), as UTF-8; lower changes A-Z only.

    bytes.split() splits at exactly these six characters, bytes.lower() maps exactly A-Z.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def remainder(key, modulus: int) -> int | None:
    """crc32 of the key as text, modulo modulus; None for a null key."""
    return None if key is None else zlib.crc32(str(key).encode()) % modulus


def bounded(batches, rows: int, chars: int, column: str):
    """Slice Arrow batches so that each slice has at most `rows` rows and, but for single rows, `chars` bytes of column."""
    for batch in batches:
        col = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        start = 0
        while start < len(sizes):
            run = np.cumsum(sizes[start : start + rows])
            n = max(1, int(np.searchsorted(run, chars, side="right")))
            yield batch.slice(start, n)
            start += n


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
