"""Row order at scale: dense positions and scans in order, without a window over the whole table.

Rows are split by range of the order key; every pass over a part stays inside it, and the parts meet only as one
summary row each, whose running totals are broadcast back.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.functions.cells import unique

PART, PLACE = "_part", "_place"


def ordered_parts(df: DataFrame, order_by: list[Column | str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_part`` (ascending with the order key) and ``_place`` (1.. inside the part); checkpointed, since all passes over it must see the same parts.

    One exchange deals the rows by range into ``parts`` (the session's shuffle partitions); each range is then sorted
    where it is, and rows are numbered by how many their task has given out before.
    """
    if not order_by:
        raise ValueError("an order is needed")
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # the number of a row is its task's number in the upper bits, and in the lower 33 its place
    number = F.monotonically_increasing_id()
    return persisted(ranged.withColumns({PART: F.shiftright(number, 33).cast("int"), PLACE: number.bitwiseAND((1 << 33) - 1) + 1}))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share; where none is set a local one is made, which serves a local master alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = context.getConf().get("spark.checkpoint.dir")
        if own is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def persisted(df: DataFrame) -> DataFrame:
    """Saved in the shared folder, so that lost executors change nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def running(parts: DataFrame, totals: list[Column]) -> DataFrame:
    """``parts`` joined with the sums of ``totals`` (aliased aggregates) over all earlier parts, under their aliases."""
    summary = parts.groupBy(PART).agg(*totals)
    names = [c for c in summary.columns if c != PART]
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    earlier = summary.select(PART, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names])
    return parts.join(F.broadcast(earlier), PART)


def with_position(df: DataFrame, order_by: list[Column | str], name: str = "_pos") -> DataFrame:
    """Adds the 0-based place of each row in the order."""
    if name in df.columns:
        raise ValueError(f"column {name} is there already; try {unique(name, df.columns)}")
    parts = ordered_parts(df, order_by)
    return running(parts, [F.count(F.lit(1)).alias("_before")]).withColumn(name, F.col("_before") + F.col(PLACE) - 1).select(*df.columns, name)


def with_running_sum(df: DataFrame, value: Column, order_by: list[Column | str], name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and with each."""
    parts = ordered_parts(df.withColumn("_value", value), order_by)
    inside = F.sum("_value").over(Window.partitionBy(PART).orderBy(PLACE))
    return running(parts, [F.sum("_value").alias("_before")]).withColumn(name, F.col("_before") + inside).select(*df.columns, name)
