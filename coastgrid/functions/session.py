"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from coastgrid.errors import ValidationError

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on a local master may go without the setting; it then gets a
    new temporary folder, which is remembered in the session configuration.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder is None:
        folder = spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValidationError(
                f"{CHECKPOINT_SETTING} is not set; iterative operators need a folder all executors share"
            )
        folder = tempfile.mkdtemp(prefix="coastgrid-")
        spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    Used instead of row checkpoints in loops: the columnar copy is smaller, keeps
    column pruning, and gives the next round real size statistics.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/coastgrid/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` for rows that were exploded out of fewer: its next join shuffles both sides.

    Catalyst takes the output of a generator for as small as its input, so it would send all
    cells of a small table of domains through the driver.  A hint costs nothing where no join follows.
    """
    return df.hint("merge")


def summary_table(df: DataFrame) -> DataFrame:
    """A per-key summary, computed once and written, so that its true size is known.

    Joining a summary back to its big table would otherwise shuffle that table by a
    handful of keys, since the size of an aggregate is only guessed.  From the written
    table Catalyst broadcasts it when it is below the broadcast threshold, and falls
    back to a skew-handled shuffle join when it is not.
    """
    return materialise(df)
