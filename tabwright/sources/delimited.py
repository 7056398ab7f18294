"""Reading delimited text: dialects, encodings, ragged records, header rows, and jobs over sets of files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.cells import col, num, strip, uniquified
from tabwright.operators.order import persisted, with_position

#: Delimiters that are tried, in order of preference; windows-1252 code points 0x80 to 0x9F (blank: not used).
DELIMITERS = (",", "\t", ";", "|")
CP1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"
SAMPLE_LINES = 50
MOST_PROFILES = 10_000
ROW, FILE, RECORD = "_row", "_file", "_record"
#: Texts that no file holds: the first, so that no cell is taken for null; the second ends a record whose fields are counted.
NO_NULL, END = "\x00\x01null\x01\x00", "\ue0f1end\ue0f2"
#: Byte order marks and the encodings that they name.
MARKS = {b"\xef\xbb\xbf": "utf-8", b"\xff\xfe": "utf-16le", b"\xfe\xff": "utf-16be"}
#: Fields of a record that are counted at first; wider records are counted again with more.
FIELDS = 32
#: Rows of a table with one for each file that may be sent to all tasks.
MOST_FILES = 200_000
#: Files that the driver holds open at once for their first bytes.
OPENED = 16


@dataclass(frozen=True)
class Dialect:
    """quote: None for no quoting. escape: '\"' for doubled quotes. header_rows: how many first records make up the header (0: none). marks: whether a file's byte order mark overrules the encoding."""

    delimiter: str = ","
    quote: str | None = '"'
    escape: str | None = '"'
    comment: str | None = None
    encoding: str = "utf-8"
    header_rows: int = 1
    header_joiner: str = " "
    skip_first: int = 0
    skip_last: int = 0
    multi_line: bool = False
    marks: bool = True


def csv_options(d: Dialect) -> dict[str, str]:
    encoding = d.encoding.lower()
    out = {"sep": d.delimiter, "encoding": "ISO-8859-1" if encoding in ("windows-1252", "cp1252") else d.encoding, "mode": "PERMISSIVE", "header": "false", "emptyValue": "", "nullValue": NO_NULL, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    out["quote"] = d.quote if d.quote is not None else "\x00"
    out["escape"] = d.escape if d.escape is not None else "\x00"
    if d.comment:
        out["comment"] = d.comment
    if d.multi_line or encoding.startswith("utf-16"):
        out["multiLine"] = "true"  # whole files: many files rather than huge ones
    return out


def _decoded(c: Column, d: Dialect) -> Column:
    if d.encoding.lower() not in ("windows-1252", "cp1252"):
        return c
    used = [(chr(0x80 + i), x) for i, x in enumerate(CP1252) if x != " "]
    return F.translate(c, "".join(a for a, _ in used), "".join(b for _, b in used))


def first_bytes(spark: SparkSession, paths: str | list[str], n: int = 3) -> DataFrame:
    """_file, head: the first ``n`` bytes of each file that isn't empty, decompressed.

    Every file is opened for these bytes alone, so files of any size cost the same. A task that hands a file's bytes to
    Python can't do that: it reads on to the end after Python has left. So the driver, which has the list of the files
    for every read of them, opens them, some at a time.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)

    def head(file: str) -> tuple[str, bytearray]:
        path = hadoop.fs.Path(file)
        codec, stream = codecs.getCodec(path), path.getFileSystem(conf).open(path)
        try:
            # with the outer stream the inner one is closed, too
            stream = codec.createInputStream(stream) if codec else stream
            return file, bytearray(takewhile(lambda byte: byte >= 0, (stream.read() for _ in range(n))))
        finally:
            stream.close()

    files = [r["path"] for r in file_listing(spark, paths).filter("length > 0").select("path").collect()]
    with ThreadPoolExecutor(OPENED) as pool:
        return spark.createDataFrame([x for x in pool.map(head, files) if x[1]], f"{FILE} string, head binary")


def byte_order_marks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """_file, mark: the encoding that each file's byte order mark names, null without one. Empty files are left out."""
    mark = reduce(lambda rest, m: F.when(F.startswith("head", F.lit(m)), MARKS[m]).otherwise(rest), reversed(MARKS), F.lit(None).cast("string"))
    return first_bytes(spark, paths, max(map(len, MARKS))).select(FILE, mark.alias("mark"))


class Files(list):
    """(paths, dialect) of files that are read in the same way."""


def in_encodings(spark: SparkSession, paths: str | list[str] | Files, d: Dialect) -> Files:
    """The files by encoding: that of a file's byte order mark, if it has one, else the dialect's. Only where a folder mixes encodings are its files named one by one."""
    if isinstance(paths, Files):
        return paths
    if not d.marks:
        return Files([(paths, d)])
    # a mark of the dialect's own encoding is left out by the reader
    own = d.encoding.lower().replace("_", "-")
    mark = F.when(F.col("mark") != own, F.col("mark"))
    found = byte_order_marks(spark, paths).select(FILE, mark.alias("mark"))
    kinds = [r["mark"] for r in found.select("mark").distinct().collect()]
    if not any(kinds):
        return Files([(paths, d)])
    if len(kinds) == 1:
        return Files([(paths, replace(d, encoding=kinds[0]))])
    by: dict[str | None, list[str]] = {}
    for r in found.collect():
        by.setdefault(r["mark"], []).append(r[FILE])
    return Files([(sorted(by[k]), replace(d, encoding=k) if k else d) for k in sorted(by, key=str)])


def with_bom(spark: SparkSession, paths: str | list[str], d: Dialect) -> Dialect:
    """The dialect with the encoding that the files' byte order mark names, if they have one; files of several encodings are refused."""
    files = in_encodings(spark, paths, d)
    if len(files) > 1:
        raise ValueError("the files have byte order marks of several encodings")
    return files[0][1]


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def raw_records(spark: SparkSession, paths: str | list[str] | Files, dialect: Dialect, width: int, header: bool = False) -> DataFrame:
    """c0.. (null where a record is short), _file, and _row: an order key that follows the files' own order. ``header``: without the first record of each file."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    row = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))

    def one(where, d: Dialect) -> DataFrame:
        read = spark.read.options(**csv_options(d)).option("header", header).schema(schema).csv(where)
        return read.select(*[_decoded(F.col(f"c{i}"), d).alias(f"c{i}") for i in range(width)], F.col("_metadata.file_path").alias(FILE), row.alias(ROW))

    return _united([one(*x) for x in in_encodings(spark, paths, dialect)])


def _texts_of_records(spark: SparkSession, paths: str | list[str] | Files, dialect: Dialect) -> DataFrame:
    """c0, value (the record as it stands, null for one of a single field), _file, _at (an order key). Records are the reader's own: a quoted line end is none of theirs, empty lines and comments are left out."""
    schema = T.StructType([T.StructField("c0", T.StringType()), T.StructField("_whole", T.StringType())])
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))

    def one(where, d: Dialect) -> DataFrame:
        # a record wider than the schema is kept whole in the column for corrupt records
        read = spark.read.options(**csv_options(d)).option("columnNameOfCorruptRecord", "_whole").option("enforceSchema", "true").schema(schema).csv(where)
        return read.select("c0", _decoded(F.col("_whole"), d).alias("value"), F.col("_metadata.file_path").alias(FILE), at.alias("_at"))

    return _united([one(*x) for x in in_encodings(spark, paths, dialect)])


def _record_widths(spark: SparkSession, paths: str | list[str] | Files, d: Dialect, most: int) -> DataFrame:
    """_file, _at, c0, value, fields of every record (null: more than ``most``).

    The reader itself counts: a last cell of a text that no file holds is put behind each record, and where it comes out
    when the record is read on its own tells the fields before it, empty ones too. Behind a quote that isn't closed it
    becomes the end of the last cell.
    """
    # as JSON, which leaves out nulls, the last cell that there is comes last; as single fields they would be parsed one by one
    cells = F.to_json(_cells(F.col("value"), d, most + 1))
    place = F.regexp_extract(cells, '(?s)^.*[{,]"c(\\d+)":".*' + END + '"\\}$', 1)
    fields = F.when(place == "", None).otherwise(place.cast("int") + F.when(F.endswith(cells, F.lit(f':"{END}"}}')), 0).otherwise(1))
    # the reader gives the column of whole records only beside another, which is why c0 is asked
    one = F.when(F.col("value").isNull(), F.least(F.lit(1), F.length(F.coalesce("c0", F.lit(""))) + 1))
    return _texts_of_records(spark, paths, d).select(FILE, "_at", "c0", "value", one.otherwise(fields).alias("fields"))


def _cells(value: Column, d: Dialect, n: int) -> Column:
    """The first ``n`` cells of a record's text, and END behind its last one, as a struct."""
    options = {k: v for k, v in csv_options(d).items() if k not in ("encoding", "header", "multiLine")}
    ended = F.concat(F.regexp_replace(value, "[\r\n]+$", ""), F.lit(d.delimiter + END))
    return F.from_csv(ended, ", ".join(f"c{i} string" for i in range(n)), options)


def shapes(spark: SparkSession, paths: str | list[str] | Files, dialect: Dialect) -> DataFrame:
    """_file, records, fields (of its widest record), first (the cells of its first record) of every file that has records."""
    files = in_encodings(spark, paths, dialect)
    most = widest(spark, files, dialect)
    first = F.min_by(F.struct("c0", "value", "fields"), "_at").alias("_first")
    each = _record_widths(spark, files, dialect, most).groupBy(FILE).agg(F.count(F.lit(1)).alias("records"), F.max("fields").alias("fields"), first)
    named = F.from_json(F.to_json(_cells(F.col("_first.value"), dialect, most + 1)), "map<string,string>")
    cell = lambda i: F.regexp_replace(F.coalesce(F.try_element_at("_named", F.concat(F.lit("c"), i)), F.lit("")), f"{END}$", "")
    several = F.transform(F.sequence(F.lit(0), F.col("_first.fields") - 1), cell)
    alone = F.array(F.coalesce("_first.c0", F.lit("")))
    return each.withColumn("_named", named).select(FILE, "records", "fields", F.when(F.col("_first.value").isNull(), alone).otherwise(several).alias("first"))


def field_counts(spark: SparkSession, paths: str | list[str] | Files, dialect: Dialect) -> DataFrame:
    """fields, records: how many records have how many fields. Quoted delimiters and line ends don't count; quotes inside plain cells are characters like others."""
    files = in_encodings(spark, paths, dialect)
    return _record_widths(spark, files, dialect, widest(spark, files, dialect)).groupBy("fields").agg(F.count(F.lit(1)).alias("records"))


def widest(spark: SparkSession, paths: str | list[str] | Files, dialect: Dialect) -> int:
    """The most fields of a record; one pass unless records are wider than FIELDS."""
    files, most = in_encodings(spark, paths, dialect), FIELDS
    while True:
        found = _record_widths(spark, files, dialect, most).agg(F.max("fields").alias("most"), F.max(F.col("fields").isNull()).alias("wider")).first()
        if not found["wider"]:
            return found["most"] or 1
        most *= 4


def _first_record(spark: SparkSession, files: Files, dialect: Dialect, width: int) -> list[str | None] | None:
    """The cells of the first record of the first file that isn't empty, which is left after it; None if that file has no record."""
    listed = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).filter("length > 0").agg(F.min("_metadata.file_path").alias("first")) for where, _ in files]
    name = _united(listed).agg(F.min("first")).first()[0]
    # a file that isn't split is read in its order
    found = raw_records(spark, files, dialect, width).filter(F.col(FILE) == name).drop(FILE, ROW).limit(1).collect()
    return list(found[0]) if found else None


def read_delimited(spark: SparkSession, paths: str | list[str] | Files, dialect: Dialect = Dialect(), width: int | None = None, keep_row: bool = False, record_numbers: bool = False) -> DataFrame:
    """All cells as text; short records are padded with empty cells, up to the widest record. Fully empty lines don't count.

    Headers come from the first file's header rows (joined, blanks skipped, made unique); without any they are
    ``Column 1..n``. ``keep_row`` keeps _file and _row; ``record_numbers`` adds
    _record, the number of each record in its file (from 1, counted before any are skipped). A file's byte order mark
    overrules the dialect's encoding, file by file. Only header rows reach the driver.
    """
    paths = in_encodings(spark, paths, dialect)
    width = width or widest(spark, paths, dialect)
    lead = dialect.skip_first + dialect.header_rows
    # where files aren't split and one record makes up the header, the reader itself leaves it out
    alone = lead == dialect.header_rows == 1 and not record_numbers and all("multiLine" in csv_options(d) for _, d in paths)
    top = _first_record(spark, paths, dialect, width) if alone else None
    rows = raw_records(spark, paths, dialect, width, header=top is not None)
    if record_numbers:
        placed = with_position(rows, [ROW], "_at")
        starts = placed.groupBy(FILE).agg(F.min("_at").alias("_from"))
        rows = placed.join(starts, FILE).withColumn(RECORD, F.col("_at") - F.col("_from") + 1).drop("_at", "_from")
    first, last = dialect.skip_first, dialect.skip_last
    cells = [f"c{i}" for i in range(width)]
    names = [f"Column {i + 1}" for i in range(width)]
    if top is not None:
        lead, names = 0, header_names([top])
    if lead or last:
        # one row for each file: sent to all tasks where the files are few
        each = F.broadcast if len(rows.inputFiles()) <= MOST_FILES else lambda table: table
        # the few first and last records of each file, by partial aggregates of order keys
        found = rows
        if lead:
            head = _ends(found, lead, True)
            found = found.join(each(head), FILE).filter(F.col(ROW) > F.col("_edge"))
            if dialect.header_rows:
                top = rows.join(each(head), FILE).filter(F.col(ROW) <= F.col("_edge")).orderBy(ROW).limit(lead).collect()
                names = header_names([[r[c] for c in cells] for r in top[first:]], dialect.header_joiner)
            found = found.drop("_edge")
        if last:
            tail = _ends(rows, last, False)
            found = found.join(each(tail), FILE).filter(F.col(ROW) < F.col("_edge")).drop("_edge")
        rows = found
    out = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in zip(cells, names)]
    return rows.select(*out, *([FILE, ROW] if keep_row else []), *([RECORD] if record_numbers else []))


def _ends(rows: DataFrame, n: int, start: bool) -> DataFrame:
    """_file, _edge: the order key of each file's n-th record from the start or the end. Spark cuts to n rows a task before it shuffles."""
    order = F.col(ROW).asc() if start else F.col(ROW).desc()
    ranked = rows.select(FILE, ROW).withColumn("_k", F.row_number().over(Window.partitionBy(FILE).orderBy(order))).filter(F.col("_k") <= n)
    return ranked.groupBy(FILE).agg((F.max if start else F.min)(ROW).alias("_edge"))


def header_names(records: list[list[str | None]], joiner: str = " ") -> list[str]:
    """One name per column from header records; blank ones are ``Column i``."""
    width = max((len(r) for r in records), default=0)
    names = []
    for i in range(width):
        parts = [(r[i] or "").strip() for r in records if i < len(r) and (r[i] or "").strip()]
        names.append(joiner.join(parts) or f"Column {i + 1}")
    return uniquified(names)


def has_header(spark: SparkSession, paths: str | list[str], dialect: Dialect = Dialect()) -> DataFrame:
    """_file, header: whether no cell of the file's first record that isn't blank is a number."""
    paths = in_encodings(spark, paths, dialect)
    width = widest(spark, paths, dialect)
    rows = raw_records(spark, paths, dialect, width)
    cells = F.array(*[F.col(f"c{i}") for i in range(width)])
    first = rows.groupBy(FILE).agg(F.min_by(cells, ROW).alias("_cells"))
    return first.select(FILE, F.forall(F.transform("_cells", lambda c: num(c).isNull()), lambda x: x).alias("header"))


def ragged_report(spark: SparkSession, paths: str | list[str], dialect: Dialect = Dialect()) -> DataFrame:
    """One row: expected (the most frequent field count, of ties the larger), records, ragged."""
    counts = field_counts(spark, paths, dialect)
    return counts.agg(F.max_by("fields", F.struct("records", "fields")).alias("expected"), F.sum("records").alias("records"), F.max("records").alias("_mode")).select("expected", "records", (F.col("records") - F.col("_mode")).alias("ragged"))


def ragged_sample(spark: SparkSession, paths: str | list[str], dialect: Dialect = Dialect(), n: int = 100) -> DataFrame:
    """_file, record (its number in the file, from 1), fields, expected: the first ``n`` records that have another number of fields than most."""
    files = in_encodings(spark, paths, dialect)
    widths = persisted(_record_widths(spark, files, dialect, widest(spark, files, dialect)).drop("c0", "value"))
    expected = widths.groupBy("fields").agg(F.count(F.lit(1)).alias("c")).agg(F.max_by("fields", F.struct("c", "fields"))).first()[0]
    odd = with_position(widths, ["_at"], "_pos")
    starts = odd.groupBy(FILE).agg(F.min("_pos").alias("_from"))
    found = odd.filter(F.col("fields") != expected).orderBy("_at").limit(n)
    return found.join(starts, FILE).select(FILE, (F.col("_pos") - F.col("_from") + 1).alias("record"), "fields", F.lit(expected).alias("expected")).orderBy(FILE, "record")


def infer_delimiters(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """_file, delimiter: by the first 50 lines that aren't blank of each file; most lines with the modal count win, then the larger count. A comma where nothing tells."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias(FILE), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"), "value")
    files = lines.select(FILE).distinct()
    top = lines.filter(strip(F.col("value")) != "").withColumn("_k", F.row_number().over(Window.partitionBy(FILE).orderBy("_at"))).filter(F.col("_k") <= SAMPLE_LINES)
    bare = F.regexp_replace(F.col("value"), '"[^"]*("|$)', "")
    counts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d"), (F.char_length(bare) - F.char_length(F.replace(bare, F.lit(d), F.lit("")))).alias("n")) for i, d in enumerate(DELIMITERS)])
    each = top.select(FILE, F.inline(counts)).groupBy(FILE, "i", "d", "n").agg(F.count(F.lit(1)).alias("lines"))
    modes = each.groupBy(FILE, "i", "d").agg(F.max_by(F.struct("n", "lines"), F.struct("lines", "n")).alias("m")).filter("m.n > 0")
    best = modes.groupBy(FILE).agg(F.max_by("d", F.struct((F.col("m.lines") + F.col("m.n") * 0.01).alias("s"), (-F.col("i")).alias("i"))).alias("delimiter"))
    return files.join(best, FILE, "left").select(FILE, F.coalesce("delimiter", F.lit(",")).alias("delimiter"))


def null_token_counts(df: DataFrame, tokens: list[str], columns: list[str] | None = None) -> DataFrame:
    """column, tokens: how many cells (trimmed) are one of the tokens. Nothing is changed."""
    names = list(columns or df.columns)
    flat = df.agg(*[F.count(F.when(strip(col(c)).isin([t.strip() for t in tokens]), 1)).alias(f"n{i}") for i, c in enumerate(names)])
    return flat.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("tokens")) for i, c in enumerate(names)])))


def damaged_cells(df: DataFrame) -> DataFrame:
    """column, damaged: cells with a replacement character, which decoding puts where bytes made no sense."""
    flat = df.agg(*[F.count(F.when(col(c).contains("\ufffd"), 1)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return flat.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("damaged")) for i, c in enumerate(df.columns)])))


def file_issues(spark: SparkSession, paths: str | list[str], dialect: Dialect = Dialect()) -> DataFrame:
    """issue, column, count, detail, as ``diagnose`` gives them, of what only files have: raggedRows (detail: the expected number of fields) and, by column, decodeErrors."""
    paths = in_encodings(spark, paths, dialect)
    ragged = ragged_report(spark, paths, dialect).select(F.lit("raggedRows").alias("issue"), F.lit("").alias("column"), F.col("ragged").alias("count"), F.col("expected").cast("string").alias("detail"))
    damaged = damaged_cells(read_delimited(spark, paths, dialect)).select(F.lit("decodeErrors").alias("issue"), "column", F.col("damaged").alias("count"), F.lit("").alias("detail"))
    return ragged.unionByName(damaged).filter("count > 0")


# --- sets of files --------------------------------------------------------------------------------------------------


def file_listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length, modificationTime; the files' content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, status (added, removed, changed, same) of two listings."""
    b = before.select(F.col("path"), F.struct("length", "modificationTime").alias("_b"))
    n = now.select(F.col("path"), F.struct("length", "modificationTime").alias("_n"))
    return b.join(n, "path", "full").select("path", F.when(F.col("_b").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_b") == F.col("_n"), "same").otherwise("changed").alias("status"))


def line_ends(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """_file, crlf, lf, cr: how many line ends of each kind every file has, by one pass over its bytes that splits files as usual.

    Lines are cut at LF alone; whether a file's last line ends with one is told by the file's size. In UTF-16 LF is that
    byte too, and CR the byte before and a zero. Compressed files count as ending with one.
    """
    read = spark.read.option("lineSep", "\n").text(paths)
    raw = F.col("value").cast("binary")
    size = F.octet_length("value")
    wide = (F.substring(raw, -2, 2) == F.lit(b"\r\x00")) | (F.substring(raw, -3, 3) == F.lit(b"\x00\r\x00"))
    rows = read.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_size").alias("all"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        size.alias("size"),
        ((F.substring(raw, -1, 1) == F.lit(b"\r")) | wide).alias("after"),
        (size - F.octet_length(F.replace("value", F.lit("\r"), F.lit("")))).alias("crs"),
    )
    each = rows.groupBy(FILE).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("all").alias("all"), F.count(F.when(F.col("after"), 1)).alias("after"), F.sum("crs").alias("crs"), F.max_by("after", "at").alias("last"))
    # the reader leaves out a mark of three bytes
    packed = F.rlike(FILE, F.lit("[.](gz|bz2|zst|lz4|snappy|deflate)$"))
    open_ = ~packed & ~(F.col("all") - F.col("bytes") - F.col("n")).isin(0, 3)
    lone = (open_ & F.col("last")).cast("long")
    crlf = F.col("after") - lone
    return each.select(FILE, crlf.alias("crlf"), (F.col("n") - open_.cast("long") - crlf).alias("lf"), (F.col("crs") - crlf).alias("cr"))


def reading_differences(spark: SparkSession, paths: str | list[str], a: Dialect, b: Dialect, paths_b: str | list[str] | None = None) -> DataFrame:
    """what, a, b: where two ways to read files differ (delimiter, encoding, bom, lineEnd, header, columns, rows). The same files, or with ``paths_b`` what has become of them."""
    seen = []
    for where, d in ((paths, a), (paths if paths_b is None else paths_b, b)):
        files = in_encodings(spark, where, d)
        df = read_delimited(spark, files, d)
        bom = d.marks and bool(byte_order_marks(spark, where).filter("mark IS NOT NULL").limit(1).count())
        crlf = bool(line_ends(spark, where).filter("crlf > 0").limit(1).count())
        encodings = ",".join(sorted({x.encoding.lower() for _, x in files}))
        seen.append({"delimiter": d.delimiter, "encoding": encodings, "bom": str(bom).lower(), "lineEnd": "crlf" if crlf else "lf", "header": "\x1f".join(df.columns), "columns": str(len(df.columns)), "rows": str(df.count())})
    rows = [(k, seen[0][k], seen[1][k]) for k in seen[0] if seen[0][k] != seen[1][k]]
    return spark.createDataFrame(rows, "what string, a string, b string")


def match_profiles(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """path, profile: the best of the profiles (profile, kind, pattern) that match each path; exactPath before directory, extension and glob. Every file meets every profile, so more than MOST_PROFILES are refused."""
    if profiles.limit(MOST_PROFILES + 1).count() > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    p = F.col("pattern")
    glob = F.concat(F.lit("^"), F.regexp_replace(F.replace(F.replace(F.regexp_replace(p, r"([.\\+^$(){}|\[\]])", r"\\$1"), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), "a^", ""), F.lit("$"))
    name = F.regexp_extract("path", "[^/]*$", 0)
    hit = (
        F.when(F.col("kind") == "exactPath", F.col("path") == p)
        .when(F.col("kind") == "directory", F.col("path").startswith(F.concat(F.rtrim(p, F.lit("/")), F.lit("/"))))
        .when(F.col("kind") == "extension", F.lower(F.col("path")).endswith(F.concat(F.lit("."), F.lower(F.ltrim(p, F.lit("."))))))
        .when(F.col("kind") == "glob", F.regexp_like(name, glob))
    )
    rank = F.array_position(F.array(*map(F.lit, ("exactPath", "directory", "glob", "extension"))), F.col("kind"))
    return files.select("path").join(F.broadcast(profiles), hit).groupBy("path").agg(F.min_by("profile", F.struct(rank, "profile")).alias("profile"))

