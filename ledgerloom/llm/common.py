"""Small helpers that the corpus operators share: table paths, shared storage, hashing constants."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression for one white-space character of the word definition.
WS = r"[\x20\x09-\x0D]"
#: The same characters, for btrim().
WS_CHARS = " \t\n\x0b\f\r"


@lru_cache(maxsize=8)
def _ship(context: SparkContext) -> None:
    top = Path(__file__).resolve().parents[2]
    at = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom_tasks.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted((top / "ledgerloom").rglob("*.py")):
            z.write(f, f.relative_to(top))
    context.addPyFile(str(at))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the package goes to the executors with it, for the tasks that run Python."""
    _ship(spark.sparkContext)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset on a single machine (tests) a local folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if (known := spark.sparkContext.getCheckpointDir()) is not None:
            return known
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, label: str, level: int = 3) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, executors may be lost.

    level is that of the zstd compression.
    """
    return stored(df, label, level)[0]


def stored(df: DataFrame, label: str, level: int = 3) -> tuple[DataFrame, str]:
    """materialize(), and the path for discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of stored() that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bind(value: Column, body) -> Column:
    """Evaluate value once for each row and hand it to body as a variable (for use inside lambdas)."""
    return F.transform(F.array(value), body)[0]
