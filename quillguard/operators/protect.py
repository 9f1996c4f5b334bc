"""Documents written again with their values replaced: text and HTML in place, CSV by cell, JSON by string."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detectors import Registry, with_findings
from .policy import Policy, default_policy, filter_findings
from .redact import Redaction, redact

WRITABLE = ("text", "html", "csv", "json")


def protect_text(df: DataFrame, text: str = "content", policy: Policy | None = None, config: Redaction | None = None, registry: Registry | None = None, into: str = "protected") -> DataFrame:
    """A text column with what the policy admits replaced; only detectors that the policy can need are in the plan."""
    p = policy or default_policy()
    reg = (registry or Registry()).for_categories(p.categories)
    found = with_findings(df, reg, text, "_findings").withColumn("_findings", filter_findings(F.col("_findings"), p))
    return redact(found, config, text, "_findings", "_r").withColumn(into, F.col("_r.text")).drop("_findings", "_r")


def protect_columns(df: DataFrame, columns: list[str], policy: Policy | None = None, config: Redaction | None = None) -> DataFrame:
    """Cells of a table."""
    for c in columns:
        df = protect_text(df.withColumnRenamed(c, "_cell"), "_cell", policy, config, into=c).drop("_cell")
    return df


def protect_files(parsed: DataFrame, policy: Policy | None = None, config: Redaction | None = None) -> DataFrame:
    """path, format, output of parsed files (path, format, content as text): CSV and JSON keep their structure.

    Strings and cells are found by the parsers, replaced as rows, and put back by their place.
    """
    cells = "array<struct<i:int,content:string>>"

    @F.udf(cells, useArrow=True)
    def pick(content, format):
        from quillguard.sources import rewrite

        return [(i, x) for i, x in enumerate(rewrite.strings(content or "", format))]

    @F.udf("string", useArrow=True)
    def put(content, format, values):
        from quillguard.sources import rewrite

        return rewrite.replaced(content or "", format, [v["v"] for v in sorted(values or [], key=lambda v: v["i"])])

    known = parsed.where(F.col("format").isin(*WRITABLE))
    rows = known.select("path", "format", F.explode_outer(pick("content", "format")).alias("c")).select("path", F.col("c.i").alias("i"), F.col("c.content").alias("cell"))
    done = protect_text(rows, "cell", policy, config, into="v").groupBy("path").agg(F.collect_list(F.struct("i", "v")).alias("values"))
    return known.join(done, "path", "left").select("path", "format", put("content", "format", "values").alias("output"))
