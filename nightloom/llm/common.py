"""Small helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "nightloom.shipped"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per context."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), "nightloom_pkg.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(target)
    setattr(context, _SHIPPED, True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for materialised results; a local one only where none is set and one machine runs all."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="nightloom-checkpoint-"))
    return shared or context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: store the rows in the shared folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def in_fold(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def free_name(df: DataFrame, wanted: str) -> str:
    """The name, or with the first number that makes it different from all columns."""
    taken, name, n = {c.lower() for c in df.columns}, wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name
