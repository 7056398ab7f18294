"""Following a folder of delimited files: each new file's rows are appended, bad ones set aside, oddities reported."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabwright.operators.filters import Condition, Group, compile_filter
from tabwright.sources.delimited import Dialect, changed_files, csv_options, file_listing

CORRUPT, BATCH = "_corrupt", "_batch_id"


def follow(spark: SparkSession, folder: str, columns: list[str], dialect: Dialect = Dialect(), spec: Condition | Group | None = None, max_files: int | None = None) -> DataFrame:
    """A stream of text rows with _file and _corrupt (the line of a record of another width, else null). Files are read once, when they appear.

    A filter spec works as on tables; it is stateless, so it may be any.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    read = spark.readStream.schema(schema).options(**csv_options(dialect)).option("header", str(dialect.header_rows == 1).lower()).option("enforceSchema", "true").option("columnNameOfCorruptRecord", CORRUPT)
    if max_files:
        read = read.option("maxFilesPerTrigger", max_files)
    rows = read.csv(folder).withColumn("_file", F.col("_metadata.file_path"))
    return rows if spec is None else rows.filter(F.col(CORRUPT).isNotNull() | compile_filter(rows, spec))


def split_batch(batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows with _batch_id, rows set aside, alerts) of one micro-batch."""
    text = F.concat_ws("", *[F.col(f"`{c}`") for c in batch.columns if c != "_file"])
    damaged = text.contains("�") | text.contains("\x00")
    marked = batch.withColumn("_alert", F.when(F.col(CORRUPT).isNotNull(), "widthChanged").when(damaged, "encodingChanged"))
    good = marked.filter("_alert IS NULL").drop("_alert", CORRUPT).withColumn(BATCH, F.lit(batch_id).cast("long"))
    bad = marked.filter("_alert IS NOT NULL").withColumn(BATCH, F.lit(batch_id).cast("long"))
    alerts = bad.groupBy("_file", "_alert").agg(F.count(F.lit(1)).alias("records")).select(F.lit(batch_id).cast("long").alias("batch"), F.col("_file").alias("file"), F.col("_alert").alias("alert"), "records")
    return good, bad, alerts


def start(stream: DataFrame, out: str, checkpoint: str, quarantine: str, alerts: str, available_now: bool = False, every: str = "500 milliseconds", on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends good rows to ``out`` (Parquet), others to ``quarantine``, counts to ``alerts``. Stop and start again on the same checkpoint to pause; nothing is lost or read twice.

    Each batch overwrites its own partition, so a batch that is repeated after a failure replaces what it had written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good, bad, told = split_batch(batch, batch_id)
            good.drop(BATCH).write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")
            if bad.limit(1).count():
                bad.drop(BATCH).write.mode("overwrite").json(f"{quarantine}/{BATCH}={batch_id}")
                told.write.mode("overwrite").json(f"{alerts}/{BATCH}={batch_id}")
            if on_batch:
                on_batch(good, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def new_rows(spark: SparkSession, out: str, after_batch: int) -> DataFrame:
    """Rows of batches after a given one."""
    return spark.read.parquet(out).filter(F.col(BATCH) > after_batch)


def changed_files_alerts(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, alert: files that were rewritten (rotated, truncated) or are missing between two listings; a stream never reads those again."""
    found = changed_files(before, now)
    return found.filter(F.col("status").isin("removed", "changed")).select("path", F.when(F.col("status") == "removed", "missing").otherwise("rewritten").alias("alert"))


# --- rewritten and missing files, inside the stream ------------------------------------------------------------------

SNAPSHOT = "path string, length long, modified timestamp, listed timestamp"
#: Listings are at least so far apart; nearer ones count as one.
GAP = "100 milliseconds"
ALERT = "file string, alert string, listed timestamp, length_before long, length_now long"
_STATE = "length long, modified double, listed double"


def note_listing(spark: SparkSession, folder: str, listings: str, number: int | None = None) -> None:
    """Adds what files a folder has now to the snapshots in ``listings``; a snapshot appears there as a whole, by one rename. ``number`` names it, so that a repeated one replaces itself.

    A row without a path tells that a listing was made even where no file is left. Only names, sizes and times are read;
    files without a byte are not listed, so one that is emptied counts as missing.
    """
    now = F.lit(datetime.datetime.now(datetime.timezone.utc))
    files = file_listing(spark, folder).select("path", "length", F.col("modificationTime").alias("modified"), now.alias("listed"))
    mark = spark.range(1).select(F.lit("").alias("path"), F.lit(0).cast("long").alias("length"), now.alias("modified"), now.alias("listed"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    made = hadoop.Path(f"{listings}/_{uuid.uuid4().hex}")
    files.unionByName(mark).write.parquet(made.toString())
    place = hadoop.Path(f"{listings}/snapshot={uuid.uuid4().hex if number is None else number}")
    store = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(place, True)
    if not store.rename(made, place):
        raise OSError(f"{place} could not be written")


def watch(spark: SparkSession, folder: str, listings: str, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Notes the folder's files again and again; the clock is a stream of its own, so a stopped one goes on from its checkpoint."""
    ticks = spark.readStream.format("rate").load()
    return ticks.writeStream.foreachBatch(lambda _, number: note_listing(spark, folder, listings, number)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def file_alerts(spark: SparkSession, listings: str) -> DataFrame:
    """A stream over snapshots: file, alert (rewritten: its size or time has changed; missing: a later listing is without it), listed, length_before, length_now.

    Every file is a key whose state is what was last seen of it; a listing sets the file's timer, and as listings move
    the watermark on, the timer of a file that none of them has seen again runs out. A file that comes back is new.
    """

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            length, _, listed = state.get
            if key[0]:
                out.append((key[0], "missing", str(listed), str(length), None))
            state.remove()
        else:
            seen = sorted({(row.listed.timestamp(), row.modified.timestamp(), int(row.length)) for frame in frames for row in frame.itertuples()})
            before = state.get if state.exists else None
            for listed, modified, length in seen:
                if before and key[0] and (length, modified) != (before[0], before[1]):
                    out.append((key[0], "rewritten", str(listed), str(before[0]), str(length)))
                before = (length, modified, listed)
            state.update(before)
            state.setTimeoutTimestamp(int(before[2] * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=names)

    names = [f.split(" ")[0] for f in ALERT.split(", ")]
    rows = spark.readStream.schema(SNAPSHOT).parquet(listings).withWatermark("listed", GAP)
    found = rows.groupBy("path").applyInPandasWithState(check, ", ".join(f"{n} string" for n in names), _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("file", "alert", F.col("listed").cast("double").cast("timestamp").alias("listed"), *[F.col(c).cast("long").alias(c) for c in names[3:]])


def start_alerts(stream: DataFrame, alerts: str, checkpoint: str, available_now: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Appends ``file_alerts`` to ``alerts`` (Parquet), each once; stop and start again on the same checkpoint to pause."""
    writer = stream.writeStream.format("parquet").option("path", alerts).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
