"""Redaction as column expressions: overlap resolution, styles, splicing, and the record of what was replaced where."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions.building import quick
from ..functions.validators import chars

APPLIED = "struct<category:string,orig_start:int,orig_end:int,new_start:int,new_end:int,replacement:string,original_hash:string,original_length:int>"


@dataclass(frozen=True)
class Mask:
    """Shows the first and last characters; a text no longer than both stays as it is."""

    show_first: int = 1
    show_last: int = 4
    char: str = "*"
    preserve: str = ""

    def apply(self, x: Column) -> Column:
        n = F.length(x)
        hide = lambda c, i: F.when((i < self.show_first) | (i >= n - self.show_last) | (F.lit(self.preserve).contains(c) if self.preserve else F.lit(False)), c).otherwise(F.lit(self.char))
        return F.when(n <= self.show_first + self.show_last, x).otherwise(F.array_join(F.transform(chars(x), hide), ""))


@dataclass(frozen=True)
class Style:
    """label: [CATEGORY]; bar: a block for each character; mask; custom: a fixed text."""

    kind: str = "label"
    text: str = ""
    bar: str = "█"
    mask: Mask = Mask()

    def __post_init__(self):
        if self.kind not in ("label", "bar", "mask", "custom"):
            raise ValueError(f"unknown style: {self.kind}")

    def replacement(self, f: Column) -> Column:
        if self.kind == "label":
            return F.concat(F.lit("["), F.upper(f["category"]), F.lit("]"))
        if self.kind == "bar":
            return F.repeat(F.lit(self.bar), F.length(f["matched_text"]))
        return self.mask.apply(f["matched_text"]) if self.kind == "mask" else F.lit(self.text)


@dataclass
class Redaction:
    """A default style and styles by category."""

    default: Style = Style()
    by_category: dict[str, Style] = field(default_factory=dict)
    hmac_key: bytes | None = None

    def with_style(self, category: str, style: Style) -> "Redaction":
        return Redaction(self.default, self.by_category | {category: style}, self.hmac_key)

    def replacement(self, f: Column) -> Column:
        out = self.default.replacement(f)
        for category, style in self.by_category.items():
            out = F.when(f["category"] == category, style.replacement(f)).otherwise(out)
        return out


def _order(a: Column, b: Column) -> Column:
    """By start, longer first, surer first, category."""
    la, lb = a["end"] - a["start"], b["end"] - b["start"]
    up = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    return F.coalesce(up(a["start"], b["start"]), up(lb, la), up(b["confidence"], a["confidence"]), up(a["category"], b["category"]), F.lit(0))


def resolve(findings: Column, kind: str) -> Column:
    """Findings that don't overlap. One is dropped if a kept one that it overlaps is as long or surer, else it takes their place.

    kind: type of the array.
    """

    def overlap(x: Column, y: Column) -> Column:
        return (x["start"] < y["end"]) & (y["start"] < x["end"])

    def step(kept: Column, f: Column) -> Column:
        size = lambda x: x["end"] - x["start"]
        beaten = F.exists(kept, lambda k: overlap(k, f) & ((size(k) >= size(f)) | (k["confidence"] > f["confidence"])))
        return F.when(beaten, kept).otherwise(F.concat(F.filter(kept, lambda k: ~overlap(k, f)), F.array(f)))

    return F.aggregate(F.array_sort(findings, _order), F.array().cast(kind), step)


def _hash(x: Column, key: bytes | None) -> Column:
    if key is None:
        return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))
    return F.concat(F.lit("hmac-sha256:"), crypto.hmac_sha256(x.cast("binary"), key))


def splice(text: Column, kept: Column, config: Redaction) -> Column:
    """struct<text, redactions array<...>, position map inside them>: replaces from left to right; findings out of bounds are left out."""
    inside = F.filter(kept, lambda f: (f["start"] >= 0) & (f["end"] <= F.length(text)) & (f["start"] < f["end"]))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast(f"array<{APPLIED}>").alias("done"))

    def step(acc: Column, f: Column) -> Column:
        new = config.replacement(f)
        head = F.concat(acc["out"], F.substring(text, acc["at"] + 1, f["start"] - acc["at"]))
        one = F.struct(
            f["category"].alias("category"), f["start"].alias("orig_start"), f["end"].alias("orig_end"), F.length(head).alias("new_start"),
            (F.length(head) + F.length(new)).alias("new_end"), new.alias("replacement"), _hash(f["matched_text"], config.hmac_key).alias("original_hash"),
            F.octet_length(f["matched_text"]).alias("original_length"),
        )
        return F.struct(f["end"].alias("at"), F.concat(head, new).alias("out"), F.concat(acc["done"], F.array(one)).alias("done"))

    return F.aggregate(inside, zero, step, lambda a: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))).alias("text"), a["done"].alias("redactions")))


@quick
def redact(df: DataFrame, config: Redaction | None = None, text: str = "content", findings: str = "findings", into: str = "redacted") -> DataFrame:
    """Adds struct<text, redactions>; null text stays null."""
    kind = df.schema[findings].dataType.simpleString()
    config = config or Redaction()
    kept = resolve(F.coalesce(F.col(findings), F.array().cast(kind)), kind)
    return df.withColumn("_kept", kept).withColumn(into, F.when(F.col(text).isNotNull(), F.when(F.size("_kept") > 0, splice(F.col(text), F.col("_kept"), config)).otherwise(F.struct(F.col(text).alias("text"), F.array().cast(f"array<{APPLIED}>").alias("redactions"))))).drop("_kept")


def map_position(redactions: Column, at: Column) -> Column:
    """Where a place of the original is in the redacted text; inside a replaced span, its start."""
    inside = F.element_at(F.concat(F.filter(redactions, lambda r: (at >= r["orig_start"]) & (at < r["orig_end"])), F.array(F.lit(None))), 1)
    delta = F.aggregate(redactions, F.lit(0), lambda s, r: s + F.when(r["orig_end"] <= at, (r["new_end"] - r["new_start"]) - (r["orig_end"] - r["orig_start"])).otherwise(0))
    return F.coalesce(inside["new_start"], at + delta)


def verify_original(redaction: Column, original: Column, hmac_key: bytes | None = None) -> Column:
    """Whether the record is that of this original; records with a bare hash count too."""
    kept, plain = redaction["original_hash"], F.sha2(original.cast("binary"), 256)
    keyed = F.lit(False) if hmac_key is None else kept == _hash(original, hmac_key)
    return (kept == F.concat(F.lit("sha256:"), plain)) | (kept == plain) | keyed


def restore(redacted: Column, redactions: Column, originals: Column) -> Column:
    """Puts originals (in the order of redactions) back: the inverse of splice."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    pairs = F.zip_with(redactions, originals, lambda r, o: F.struct(r.alias("r"), o.alias("o")))
    step = lambda a, p: F.struct(p["r"]["new_end"].alias("at"), F.concat(a["out"], F.substring(redacted, a["at"] + 1, p["r"]["new_start"] - a["at"]), p["o"]).alias("out"))
    return F.aggregate(pairs, zero, step, lambda a: F.concat(a["out"], F.substring(redacted, a["at"] + 1, F.length(redacted))))
