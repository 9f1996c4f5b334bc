"""Where sensitive values are: scans of folders, inventories by file and category, and their reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MAX_FILE_SIZE, SAMPLE_SIZE
from ..sources import files as S
from .detectors import Registry, with_findings

ERROR_KINDS = {"file_too_large": "too_large", "encrypted": "access", "corrupted": "corrupted", "unsafe": "corrupted", "unsupported_format": "unsupported", "parse_error": "parse"}


@dataclass(frozen=True)
class Options:
    recursive: bool = True
    max_depth: int | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ("**/.git/**", "**/node_modules/**", "**/target/**")
    max_file_size: int = 10 * 1024 * 1024
    sample_size: int = SAMPLE_SIZE
    include_snippets: bool = False


def sampled(files: DataFrame, o: Options) -> DataFrame:
    """Larger files are cut to a sample before anything looks at them."""
    return files.withColumn("content", F.when(F.col("size_bytes") > o.max_file_size, F.substring("content", 1, o.sample_size)).otherwise(F.col("content")))


def scan(spark: SparkSession, *paths: str, options: Options | None = None, registry: Registry | None = None) -> DataFrame:
    """One row a file: path, format, size_bytes, modified, findings (with segment_index), error_kind, error."""
    o = options or Options()
    files = S.read_files(spark, *paths, recursive=o.recursive, max_depth=o.max_depth, exclude=o.exclude)
    if o.include:
        files = files.where(S.glob_filter(F.col("path"), o.include, (), basename=False))
    read = S.parsed(S.sniffed(sampled(files, o)), max_size=MAX_FILE_SIZE)
    return scan_parsed(read, registry)


def scan_parsed(parsed: DataFrame, registry: Registry | None = None) -> DataFrame:
    reg = registry or Registry()
    keep = [c for c in parsed.columns if c not in ("segments", "warnings")]
    per = parsed.select(*keep, F.posexplode_outer("segments").alias("segment_index", "_s")).select(*keep, "segment_index", F.col("_s.content").alias("content"))
    found = with_findings(per, reg).select(*keep, "segment_index", F.when(F.size("findings") > 0, F.col("findings")).alias("f"))
    with_index = found.withColumn("f", F.transform("f", lambda x: F.struct(F.col("segment_index").alias("segment_index"), x["category"].alias("category"), x["start"].alias("start"), x["end"].alias("end"), x["matched_text"].alias("matched_text"), x["confidence"].alias("confidence"), x["validation"].alias("validation"))))
    others = [F.first(c).alias(c) for c in keep if c != "path"]
    return with_index.groupBy("path").agg(*others, F.flatten(F.array_sort(F.collect_list("f"))).alias("findings"))


def locations(scanned: DataFrame, snippets: bool = False) -> DataFrame:
    """One row a finding; the value only where snippets are asked for."""
    rows = scanned.select("path", F.explode_outer("findings").alias("f")).where(F.col("f").isNotNull())
    return rows.select("path", "f.segment_index", "f.category", "f.start", "f.end", F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("column"), "f.confidence", (F.col("f.matched_text") if snippets else F.lit(None).cast("string")).alias("snippet"))


def categories_of(findings: Column) -> Column:
    """Distinct, in the order of their first finding."""
    return F.array_distinct(F.transform(findings, lambda f: f["category"]))


def inventory(scanned: DataFrame) -> DataFrame:
    """category, findings, files: one pass, partial sums before the shuffle."""
    per_file = scanned.select("path", F.explode_outer("findings").alias("f")).where(F.col("f").isNotNull()).groupBy("path", F.col("f.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("category").agg(F.sum("n").cast("long").alias("findings"), F.count(F.lit(1)).alias("files"))


def rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts by the keys and their prefixes, the total included."""
    return findings.rollup(*keys).agg(F.count(F.lit(1)).alias("findings"))


def statistics(scanned: DataFrame) -> DataFrame:
    """One row: files scanned, with findings, skipped, bytes, findings; errors by kind."""
    kinds = F.create_map(*[F.lit(x) for kv in ERROR_KINDS.items() for x in kv])
    ok = F.col("error_kind").isNull()
    return scanned.select(ok.alias("ok"), F.coalesce(F.element_at(kinds, F.col("error_kind")), F.when(~ok, "other")).alias("kind"), F.coalesce(F.size("findings"), F.lit(0)).alias("n"), "size_bytes").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("files_scanned"), F.count_if(~F.col("ok")).alias("files_skipped"), F.count_if(F.col("n") > 0).alias("files_with_findings"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("findings"),
        *[F.count_if(F.col("kind") == k).alias(f"errors_{k}") for k in ("too_large", "access", "corrupted", "unsupported", "parse", "other")],
    )


def outcome(parsed: DataFrame) -> Column:
    """ok, error, or skipped (too large, unsupported)."""
    return F.when(F.col("error_kind").isNull(), "ok").when(F.col("error_kind").isin("file_too_large", "unsupported_format"), "skipped").otherwise("error")


def batch_summary(parsed: DataFrame) -> DataFrame:
    """One row: files by outcome, segments and characters (in bytes)."""
    chars = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s["content"]))
    rows = parsed.select(outcome(parsed).alias("o"), F.size("segments").alias("n"), chars.alias("c"))
    return rows.agg(*[F.count_if(F.col("o") == k).alias(a) for k, a in (("ok", "successful"), ("error", "failed"), ("skipped", "skipped"))], F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_segments"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("total_chars"))


def scan_output(scanned: DataFrame, include_values: bool = False, acknowledge_exposure: bool = False) -> DataFrame:
    """One JSON line a file. Values are hidden unless asked for and the exposure is acknowledged."""
    if include_values and not acknowledge_exposure:
        raise PermissionError("values are shown only with acknowledge_exposure=True")
    one = lambda f: F.struct(f["category"].alias("category"), *([f["matched_text"].alias("text")] if include_values else []), F.concat_ws("..", f["start"], f["end"]).alias("position"), F.round(f["confidence"].cast("double"), 4).alias("confidence"))
    return scanned.select(F.to_json(F.struct(F.col("path").alias("file"), "format", F.size("findings").alias("findings_count"), F.transform("findings", one).alias("findings"))).alias("value"))


def report(scanned: DataFrame, form: str = "summary") -> str:
    """json, text, summary or csv, from aggregates only (csv: a line for each file and category, through the driver)."""
    import json

    stats = statistics(scanned).first().asDict()
    by = sorted((r.asDict() for r in inventory(scanned).collect()), key=lambda r: (-r["findings"], r["category"]))
    if form == "json":
        return json.dumps({"statistics": stats, "categories": by}, indent=2)
    if form == "csv":
        rows = scanned.select("path", F.explode(categories_of(F.col("findings"))).alias("category"), "findings").select("path", "category", F.size(F.filter("findings", lambda f: f["category"] == F.col("category"))).alias("n"))
        return "\n".join(["path,category,count", *[f"{r['path']},{r['category']},{r['n']}" for r in rows.orderBy("path", "category").toLocalIterator()]])
    head = [f"{k.replace('_', ' ')}: {v}" for k, v in stats.items() if form == "text" or not k.startswith("errors_")]
    return "\n".join([*head, *[f"{r['category']}: {r['findings']} in {r['files']} files" for r in by]])
