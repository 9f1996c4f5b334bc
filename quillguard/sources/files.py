"""Files as DataFrames: discovery, sniffing, parsing into segments, archives, and native readers for what Spark reads itself."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MAX_FILE_SIZE, SEGMENT, WARNING
from . import formats

_PARSED = T.StructType([T.StructField("segments", T.ArrayType(SEGMENT)), T.StructField("warnings", T.ArrayType(WARNING)), T.StructField("error_kind", T.StringType()), T.StructField("error", T.StringType())])


def glob_regex(pattern: str) -> str:
    """For rlike: ** crosses folders, * doesn't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() else "\\" + c
            i += 1
    return f"^{out}$"


def glob_filter(path: Column, include=(), exclude=(), basename: bool = True) -> Column:
    """Excludes win; without includes all are in. A pattern holds for the whole path, or with basename for the name too."""
    name = F.element_at(F.split(path, "/"), -1)
    test = lambda p: path.rlike(glob_regex(p)) | path.rlike(glob_regex("**/" + p)) | (name.rlike(glob_regex(p)) if basename else F.lit(False))
    hit = lambda ps: F.exists(F.array(*[test(p) for p in ps]), lambda x: x) if ps else F.lit(False)
    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def read_files(spark: SparkSession, *paths: str, recursive: bool = True, max_depth: int | None = None, include=(), exclude=(), max_size: int | None = None) -> DataFrame:
    """path, size_bytes, modified, content of files and folders. Filters on path and length reach the reader, which then leaves contents unread. Empty files give no row. max_depth 1: the files of the folders themselves."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(list(paths))
    df = df.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
    if max_size is not None:
        df = df.where(F.col("size_bytes") <= max_size)
    if include or exclude:
        df = df.where(glob_filter(F.col("path"), include, exclude))
    if max_depth is not None:
        base = min(p.rstrip("/").count("/") for p in paths)
        df = df.where(F.size(F.split(F.regexp_replace("path", "^file:", ""), "/")) - 1 - base <= max_depth)
    return _fewer(df)


def _fewer(df: DataFrame) -> DataFrame:
    """Spark counts each file as some megabytes at least, so small files make a task for every few of them: these become a few tasks a core. Splits of larger files stay as they are."""
    spark = df.sparkSession
    size, most = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, 2 * -(-size // most)))


def sniffed(files: DataFrame) -> DataFrame:
    """Adds format and encoding."""
    return files.withColumn("format", formats.detect_format(F.col("content"), F.col("path"))).withColumn("encoding", formats.encoding_of(F.col("content")))


#: Parsed segments leave a worker in portions of some bytes (or those of one file): the file's own, and so many for each segment.
FLUSH, SEGMENT_WEIGHT = 8 << 20, 400


def parsed(files: DataFrame, max_size: int = MAX_FILE_SIZE, **options) -> DataFrame:
    """files with content and format: content gone, segments, warnings, error_kind and error in its place. Too large a file is an error, not read further."""
    big = F.col("size_bytes") > max_size if "size_bytes" in files.columns else F.length("content") > max_size
    small = F.coalesce(~big, F.lit(False))
    rest = [f for f in files.schema if f.name != "content"]
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in rest], *_PARSED])

    def run(batches):
        import pyarrow as pa

        from quillguard.sources.parsers import ParseError, parse_bytes

        def one(content, format):
            try:
                return *parse_bytes(bytes(content or b""), format, **options.get(format, {})), None, None
            except ParseError as e:
                return [], [], e.kind, str(e)
            except Exception as e:  # a damaged file must not end the job
                return [], [], "parse_error", f"{type(e).__name__}: {e}"

        for b in batches:
            content, form, ok = (b.column(b.schema.get_field_index(n)) for n in ("content", "format", "_small"))
            kept = [b.column(b.schema.get_field_index(f.name)) for f in rest]
            start, found, weight = 0, [], 0
            for i in range(b.num_rows):
                raw = content[i].as_py()
                found.append(one(raw, form[i].as_py()) if ok[i].as_py() else ([], [], "file_too_large", "the file is too large"))
                weight += SEGMENT_WEIGHT * len(found[-1][0]) + len(raw or b"")
                if weight >= FLUSH or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*[c.slice(start, len(found)) for c in kept], *_arrays(found)], out.names)
                    start, found, weight = i + 1, [], 0

    # not a function of a column: a filter on its result would be inferred and run it a second time, before the rows are dealt out
    return files.withColumns({"_small": small, "content": F.when(small, F.col("content"))}).mapInArrow(run, out)


def _arrays(found: list[tuple]) -> list:
    """The columns of _PARSED of (segments, warnings, error_kind, error), column by column: places have few of their fields."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in _PARSED]
    one = kinds[0].value_type
    place = one.field("position").type
    try:
        flat, ends = [x for f in found for x in f[0]], [0, *accumulate(len(f[0]) for f in found)]
        used = {n for x in flat for n in x["position"]}
        at = [pa.array([x["position"].get(f.name) for x in flat], f.type) if f.name in used else pa.nulls(len(flat), f.type) for f in place]
        made = pa.StructArray.from_arrays([pa.array([x["content"] for x in flat], one.field("content").type), pa.StructArray.from_arrays(at, fields=list(place))], fields=list(one))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made, type=kinds[0]), *[pa.array([f[i] for f in found], kinds[i]) for i in (1, 2, 3)]]
    except (pa.ArrowException, UnicodeError, OverflowError) as e:  # what no column can hold, as half a surrogate pair: an error of its file alone
        if len(found) > 1:
            return [pa.concat_arrays(x) for x in zip(*[_arrays([f]) for f in found])]
        if found[0][2]:
            return _arrays([([], [], found[0][2], ascii(found[0][3]))])
        return _arrays([([], [], "parse_error", f"{type(e).__name__}: {ascii(str(e))}")])


def segments(parsed: DataFrame, keep: tuple[str, ...] = ("path", "format")) -> DataFrame:
    """One row a segment."""
    return parsed.select(*keep, F.posexplode("segments").alias("segment_index", "s")).select(*keep, "segment_index", "s.content", "s.position")


def parse_files(spark: SparkSession, *paths: str, **options) -> DataFrame:
    return parsed(sniffed(read_files(spark, *paths, **options)))


# Large text and CSV files, read by Spark itself: a file is many splits, none of which is held as one value.


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds row: the place of each row in its file, from 1. Splits of a file are numbered apart, then moved by the rows of those before."""
    from pyspark.sql import Window

    own = rows.withColumn("_in", F.row_number().over(Window.partitionBy("path", "_block").orderBy("_id")))
    counts = own.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return own.join(before, ["path", "_block"]).withColumn("row", (F.col("_in") + F.col("_before")).cast("long")).drop("_in", "_before", "_block", "_id")



def _placed(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), *columns)


def text_stream(spark: SparkSession, *paths: str) -> DataFrame:
    """path, line, content of large UTF-8 text files, one row a line."""
    return _numbered(_placed(spark.read.text(list(paths)), F.regexp_replace("value", "\r$", "").alias("content"))).select("path", F.col("row").alias("line"), "content")


def csv_stream(spark: SparkSession, *paths: str, delimiter: str = ",", has_headers: bool = True) -> DataFrame:
    """path, row, column, header, content of large CSV files with rows of one line, one row a cell. Rows from 2 if there are headers; missing cells are empty ones."""
    df = spark.read.csv(list(paths), sep=delimiter, header=has_headers, quote='"', escape='"')
    cells = F.array(*[F.struct(F.lit(c if has_headers else None).cast("string").alias("header"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("content")) for c in df.columns])
    rows = _numbered(_placed(df, cells.alias("cells")))
    one = rows.select("path", (F.col("row") + int(has_headers)).alias("row"), F.posexplode("cells").alias("column", "c"))
    return one.select("path", "row", "column", "c.header", "c.content")


def _starts(lengths: Column) -> Column:
    @F.udf("array<int>", useArrow=True)
    def run(ns):
        return [0, *accumulate(n + 1 for n in ns[:-1])] if ns is not None else None

    return run(lengths)


def text_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One segment a line of a text column, with line number from 1 and the character offset of its start. Only lengths leave the JVM."""
    lines = documents.select(key, F.split(F.col(text), "\n").alias("_l"))
    placed = lines.withColumn("_s", _starts(F.transform("_l", F.length)))
    one = placed.select(key, F.posexplode(F.arrays_zip("_l", "_s")).alias("i", "x"))
    return one.select(key, F.col("i").alias("segment_index"), (F.col("i") + 1).alias("line"), F.col("x._s").alias("char_offset"), F.regexp_replace("x._l", "\r$", "").alias("content"))


def json_strings(documents: DataFrame, key: str, column: str, *paths: str) -> DataFrame:
    """Native: strings at known paths ($.a.b, $.a[0]) of a JSON column."""
    got = F.array(*[F.struct(F.lit(p).alias("path"), F.get_json_object(F.col(column), p).alias("content")) for p in paths])
    return documents.select(key, F.explode(got).alias("s")).select(key, "s.path", "s.content").where(F.col("content").isNotNull())


def html_segments(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """One segment a text node of a page."""

    @F.udf("array<string>", useArrow=True)
    def texts(h):
        from quillguard.sources.parsers import html_texts

        return html_texts(h or "")

    return pages.select(key, F.posexplode(texts(F.col(column))).alias("segment_index", "content"))


def archive_entries(files: DataFrame, max_depth: int = 5, password: bytes | None = None) -> DataFrame:
    """Files inside ZIP files (path, content) as files of their own: path!/name. Nested ones to a depth; office documents aren't archives here."""
    kind = "array<struct<path:string,size_bytes:long,content:binary,warning:string>>"

    @F.udf(kind, useArrow=True)
    def entries(path, content):
        import zipfile
        import zlib

        from quillguard.sources import parsers as P

        out = []

        def walk(prefix, raw, depth):
            try:
                z = P.open_archive(bytes(raw))
            except P.ParseError as e:
                out.append((prefix, None, None, str(e)))
                return
            for i in z.infolist():
                if i.is_dir():
                    continue
                name = f"{prefix}!/{i.filename}"
                try:
                    data = z.read(i, pwd=password)
                except (RuntimeError, NotImplementedError, EOFError, zipfile.BadZipFile, zlib.error) as e:  # of this entry alone
                    out.append((name, i.file_size, None, f"{type(e).__name__}: {e}"))
                    continue
                if data[:4] == b"PK\x03\x04" and not any(p in data for p in (b"word/document.xml", b"xl/workbook.xml", b"ppt/presentation.xml")):
                    if depth < max_depth:
                        walk(name, data, depth + 1)
                    else:
                        out.append((name, i.file_size, None, "nested too deep"))
                else:
                    out.append((name, i.file_size, data, None))

        walk(path, content, 1)
        return out

    zipped = files.where(F.hex(F.substring("content", 1, 4)) == "504B0304")
    return zipped.select(F.explode(entries("path", "content")).alias("e")).select("e.*")
