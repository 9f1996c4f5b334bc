"""One text in, plain Python out: for notebooks and services. Values are hidden unless the exposure is acknowledged."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.detectors import Registry, with_findings
from .operators.policy import Policy, default_policy, filter_findings
from .operators.redact import Redaction, Style, redact
from .schema import CATEGORIES, MIN_CONFIDENCE
from .sources.formats import SUPPORTED

MAX_BYTES = 50 * 1024 * 1024


def supported_formats() -> list[str]:
    return list(SUPPORTED)


def available_categories() -> list[str]:
    own = {d.category for d in Registry().enabled}
    return [c for c in CATEGORIES if c in own]


def _checked(content: bytes | str) -> bytes:
    raw = content.encode() if isinstance(content, str) else content
    if not 1 <= len(raw) <= MAX_BYTES:
        raise ValueError(f"the content has {len(raw)} bytes; from 1 to {MAX_BYTES} are taken")
    return raw


def _segments(spark: SparkSession, raw: bytes, format: str):
    from .sources.files import parsed, segments

    df = spark.createDataFrame([("content", format, raw, len(raw))], "path string, format string, content binary, size_bytes long")
    p = parsed(df).cache()
    if error := p.first()["error"]:
        raise ValueError(error)
    return segments(p)


def scan(spark: SparkSession, content: bytes | str, format: str = "text", categories: tuple[str, ...] = (), min_confidence: float = MIN_CONFIDENCE, include_values: bool = False, acknowledge_exposure: bool = False) -> dict:
    """findings and stats (total, by category, segments)."""
    if include_values and not acknowledge_exposure:
        raise PermissionError("values are shown only with acknowledge_exposure=True")
    found = with_findings(_segments(spark, _checked(content), format), Registry().for_categories(categories))
    keep = lambda f: (f["confidence"].cast("double") >= min_confidence) & (f["category"].isin(*categories) if categories else F.lit(True))
    rows = found.select("segment_index", F.filter("findings", keep).alias("f")).collect()
    findings = [{"segment_index": r["segment_index"], **{k: v for k, v in x.asDict().items() if k != "matched_text" or include_values}} for r in rows for x in r["f"]]
    by: dict[str, int] = {}
    for x in findings:
        by[x["category"]] = by.get(x["category"], 0) + 1
    return {"findings": findings, "stats": {"total": len(findings), "segments": len(rows), "category_counts": by}}


def protect(spark: SparkSession, content: str, style: str = "label", policy: Policy | None = None) -> dict:
    """text and stats of one text, replaced at the places of the findings."""
    p = policy or default_policy()
    df = spark.createDataFrame([(_checked(content).decode(),)], "content string")
    found = with_findings(df, Registry().for_categories(p.categories)).withColumn("findings", filter_findings(F.col("findings"), p))
    r = redact(found, Redaction(Style(style))).first()["redacted"]
    return {"text": r["text"], "stats": {"redactions": len(r["redactions"])}}
