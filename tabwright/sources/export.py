"""Writing tables: delimited text, splits with manifests, JSON, row renderers, encoding checks."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.cells import col, text_of
from tabwright.operators.order import with_position, with_running_sum
from tabwright.sources.delimited import CP1252

#: Names that can't be file names on some systems.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


@dataclass(frozen=True)
class Export:
    """quote: necessary or always. if_exists: error, ignore or overwrite."""

    delimiter: str = ","
    quote: str = "necessary"
    line_end: str = "\n"
    header: bool = True
    encoding: str = "utf-8"
    bom: bool = False
    gzip: bool = False
    if_exists: str = "error"


@dataclass(frozen=True)
class Split:
    """kind: rows (n each), bytes (about n each) or column (one output per value)."""

    kind: str
    n: int = 0
    column: str = ""


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*[text_of(df, c).alias(c) for c in df.columns])


def _written(df: DataFrame, options: Export):
    if options.quote not in ("necessary", "always"):
        raise ValueError(f"quote style {options.quote!r} can't be written without loss")
    encoding = options.encoding.lower()
    if encoding in ("windows-1252", "cp1252"):
        used = [(x, chr(0x80 + i)) for i, x in enumerate(CP1252) if x != " "]
        df = df.select(*[F.translate(col(c), "".join(a for a, _ in used), "".join(b for _, b in used)).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else col(c) for c in df.columns])
        encoding = "ISO-8859-1"
    if options.bom and options.header:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    writer = df.write.mode({"error": "errorifexists"}.get(options.if_exists, options.if_exists))
    writer = writer.option("sep", options.delimiter).option("quoteAll", str(options.quote == "always").lower()).option("lineSep", options.line_end).option("header", str(options.header).lower())
    writer = writer.option("encoding", encoding).option("escape", '"').option("emptyValue", '""' if options.quote == "always" else "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    return writer.option("compression", "gzip") if options.gzip else writer


def write_delimited(df: DataFrame, path: str, options: Export = Export(), split: Split | None = None, order_by: list[str] | None = None, scope: Column | None = None, columns: list[str] | None = None) -> None:
    """Writes a folder of delimited files; with a split, one sub-folder ``part=...`` per output."""
    rows = df if scope is None else df.filter(scope)
    names = [c for c in df.columns if columns is None or c in columns]
    if split is None:
        if order_by:
            rows = rows.orderBy(*order_by)
        _written(_texts(rows.select(*map(col, names))), options).csv(path)
        return
    labelled = split_labels(rows, split, order_by)
    texts = labelled.select(*[text_of(rows, c).alias(c) for c in names], F.col("part"), *([F.struct(*order_by).alias("_order")] if order_by else []))
    # a part's rows needn't fit one task: range partitions cut large parts, and each task writes its parts in order
    dealt = texts.repartitionByRange("part", "_order").sortWithinPartitions("part", "_order").drop("_order") if order_by else texts.repartition("part", F.pmod(F.xxhash64(*names), F.lit(8)))
    _written(dealt, options).partitionBy("part").csv(path)


def write_folders(df: DataFrame, number: str, folders: dict[int, str], work: str, options: Export) -> None:
    """Writes the rows of each ``number`` to a folder of its own, all in one job that keeps their order inside a task; rows of other numbers are left out.

    The job writes to ``work``, and when it is done the folders are renamed, so a failed one leaves nothing behind them.
    """
    spark = df.sparkSession
    texts = df.filter(F.col(number).isin(list(folders))).select(*[text_of(df, c).alias(c) for c in df.columns if c != number], F.col(number))
    names = [c for c in texts.columns if c != number]
    _written(texts, Export(**{**options.__dict__, "if_exists": "error"})).partitionBy(number).csv(work)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(work)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i, folder in folders.items():
        made, place = hadoop.Path(f"{work}/{number}={i}"), hadoop.Path(folder)
        if options.if_exists == "overwrite":
            store.delete(place, True)
        if not store.exists(made):
            _written(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in names)), options).csv(folder)
        elif store.exists(place) or not store.rename(made, place):
            raise FileExistsError(folder)
    store.delete(top, True)


def split_labels(df: DataFrame, split: Split, order_by: list[str] | None = None) -> DataFrame:
    """Adds ``part``: 001, 002... (as wide as the last part's number needs) for splits by rows or bytes, a safe unique file label for splits by a column's value."""
    if split.kind == "column":
        labels = value_labels(df.select(text_of(df, split.column).alias("value")).distinct())
        joined = df.withColumn("_own", text_of(df, split.column)).join(labels.withColumnRenamed("value", "_value"), F.col("_own") == F.col("_value"))
        return joined.select(*map(col, df.columns), F.col("label").alias("part"))
    if split.n < 1 or not order_by:
        raise ValueError("a split by rows or bytes needs a size and an order")
    if split.kind == "rows":
        at = F.floor(F.col("_at") / split.n)
        placed = with_position(df, list(order_by), "_at")
    elif split.kind == "bytes":
        size = sum((F.octet_length(text_of(df, c)) + 1 for c in df.columns), F.lit(1)).cast("long")
        placed = with_running_sum(df, size, list(order_by), "_at")
        at = F.floor((F.col("_at") - 1) / split.n)
    else:
        raise ValueError(f"unknown split {split.kind!r}")
    numbered = placed.withColumn("_part_", (at + 1).cast("string"))
    width = numbered.agg(F.max(F.char_length("_part_"))).first()[0] or 0
    return numbered.select(*map(col, df.columns), F.lpad("_part_", max(width, 3), "0").alias("part"))


def value_labels(values: DataFrame) -> DataFrame:
    """value, label: file labels without characters that file systems refuse; values that would share one get -2, -3..."""
    # fixed values: the characters and the length
    safe = F.substring(F.regexp_replace(F.col("value"), r'[\x00-\x1f\x7f<>:"/\\|?*]', "_"), 1, 64)
    safe = F.trim(F.regexp_replace(safe, r"[. ]+\z", ""))
    safe = F.when(safe == "", "(blank)").when(F.upper(safe).isin(*RESERVED), F.concat(F.lit("_"), safe)).otherwise(safe)
    own = values.filter(F.col("value").isNotNull()).withColumn("_safe", safe)
    first = own.withColumn("_k", F.row_number().over(Window.partitionBy(F.lower("_safe")).orderBy("value")))
    numbered = first.withColumn("_label", F.when(F.col("_k") == 1, F.col("_safe")).otherwise(F.concat("_safe", F.lit("-"), F.col("_k"))))
    # a numbered label may be another value's own; then the value's digest tells them apart
    again = F.row_number().over(Window.partitionBy(F.lower("_label")).orderBy("_k", "value"))
    return numbered.withColumn("_again", again).select("value", F.when(F.col("_again") == 1, F.col("_label")).otherwise(F.concat("_label", F.lit("-"), F.substring(F.sha2("value", 256), 1, 12))).alias("label"))


def manifest(spark: SparkSession, path: str, options: Export = Export()) -> DataFrame:
    """file, bytes, sha256, rows, options of every file written under a path. A file is hashed in one row, so parts should stay under a gigabyte."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    hashed = found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").option("multiLine", "true").option("header", str(options.header).lower()).option("sep", options.delimiter).option("escape", '"').schema("_c string").csv(path)
    rows = lines.groupBy(F.col("_metadata.file_path").alias("_p")).agg(F.count(F.lit(1)).alias("rows"))
    joined = hashed.join(rows, F.regexp_replace("path", "^file:/+", "/") == F.regexp_replace("_p", "^file:/+", "/"), "left")
    return joined.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "path", "bytes", "sha256", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(json.dumps(options.__dict__, sort_keys=True)).alias("options"))


def write_json_lines(df: DataFrame, path: str, if_exists: str = "error") -> None:
    """One object per row; nulls are written."""
    df.write.mode({"error": "errorifexists"}.get(if_exists, if_exists)).option("ignoreNullFields", "false").json(path)


def render_rows(df: DataFrame, form: str) -> DataFrame:
    """One string per row (column ``value``): jsonObject, jsonArray, sqlValues or markdown."""
    cells = [text_of(df, c) for c in df.columns]
    if form == "jsonObject":
        value = F.to_json(F.struct(*[c.alias(n) for c, n in zip(cells, df.columns)]))
    elif form == "jsonArray":
        value = F.to_json(F.array(*cells))
    elif form == "sqlValues":
        value = F.concat(F.lit("("), F.concat_ws(", ", *[F.when(c == "", "NULL").otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))) for c in cells]), F.lit(")"))
    elif form == "markdown":
        made = [F.regexp_replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", "<br>") for c in cells]
        value = F.concat(F.lit("| "), F.concat_ws(" | ", *made), F.lit(" |"))
    else:
        raise ValueError(f"unknown form {form!r}")
    return df.select(value.alias("value"))


def markdown_head(columns: list[str]) -> list[str]:
    """The two lines that stand before rendered rows."""
    safe = [c.replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>") for c in columns]
    return ["| " + " | ".join(safe) + " |", "|" + " --- |" * len(safe)]


def unencodable(df: DataFrame, encoding: str, key: str, samples: int = 100) -> tuple[DataFrame, DataFrame]:
    """(column, cells) counts, and a sample (key, column, value), of cells that an encoding can't hold."""
    name = encoding.lower()
    if name.startswith("utf"):
        bad = lambda c: F.lit(False)
    elif name in ("windows-1252", "cp1252"):
        bad = lambda c: c.rlike(f"[^\\x00-\\x7F\\xA0-\\xFF{CP1252.replace(' ', '')}]")
    elif name in ("iso-8859-1", "latin1"):
        bad = lambda c: c.rlike(r"[^\x00-\xFF]")
    elif name in ("ascii", "us-ascii"):
        bad = lambda c: c.rlike(r"[^\x00-\x7F]")
    else:
        raise ValueError(f"unknown encoding {encoding!r}")
    flat = df.agg(*[F.count(F.when(bad(text_of(df, c)), 1)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    counts = flat.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("cells")) for i, c in enumerate(df.columns)]))).filter("cells > 0")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text_of(df, c).alias("value"), bad(text_of(df, c)).alias("bad")) for c in df.columns])
    found = df.select(key, F.inline(cells)).filter("bad").drop("bad").orderBy(key, "column").limit(samples)
    return counts, found
