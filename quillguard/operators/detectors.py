"""Pattern detectors as column expressions, and the registry that makes one projection of them.

A detector finds candidates by its patterns in order of priority, drops those that its shape rule or an earlier match
excludes, validates each, and gives array<struct<category,start,end,matched_text,confidence,validation,reason>>. Confidence
is single precision: the base if valid, 0.3 of it if not, 0.8 of it if there is nothing to check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regexkit as R
from ..functions import validators as V
from ..functions.building import quick
from ..schema import FINDING, INVALID, UNVALIDATED, VALID

Verdict = Column  # struct<validation,reason>


def verdict(*checks: tuple[Column, Column | str], otherwise: str = VALID) -> Verdict:
    """The reason of the first check that fails, else valid (or unvalidated)."""
    ok = F.struct(F.lit(otherwise).alias("validation"), F.lit(None).cast("string").alias("reason"))
    if not checks:
        return ok
    out = None
    for test, reason in checks:
        bad = F.struct(F.lit(INVALID).alias("validation"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
        out = F.when(~test, bad) if out is None else out.when(~test, bad)
    return out.otherwise(ok)


@dataclass(frozen=True)
class Detector:
    name: str
    category: str
    base: float
    patterns: tuple[str, ...]
    #: What a text with a match must hold; cheaper than the patterns.
    guard: str | None = None
    #: None: matches of one pattern don't overlap; False, True: as first_wins.
    overlap: bool | None = None
    keep: Callable[[Column], Column] | None = None
    validate: Callable[[Column], Verdict] = lambda m: verdict(otherwise=UNVALIDATED)
    sort: bool = False
    #: In place of patterns: a function of the text that gives array<struct<start,end,text>>, built-in or an Arrow UDF.
    find: Callable[[Column], Column] | None = None

    def matches(self, text: Column) -> Column:
        if self.find:
            return self.find(text)
        found = R.find_all_of(text, self.patterns) if len(self.patterns) > 1 else R.find_all(text, self.patterns[0])
        if self.keep:
            found = F.filter(found, lambda m: self.keep(m["text"]))
        if self.overlap is not None:
            found = R.first_wins(found, self.overlap)
        return R.by_start(found) if self.sort else found

    def confidence(self, validation: Column) -> Column:
        base = F.lit(self.base).cast("float")
        return F.when(validation == VALID, base).when(validation == INVALID, base * F.lit(0.3).cast("float")).otherwise(base * F.lit(0.8).cast("float"))

    def findings(self, text: Column) -> Column:
        def finding(x: Column) -> Column:
            m, v = x["m"], x["v"]
            return F.struct(
                F.lit(self.category).alias("category"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("matched_text"),
                self.confidence(v["validation"]).cast("float").alias("confidence"), v["validation"].alias("validation"), v["reason"].alias("reason"),
            )

        # the verdict is computed once, and then used
        judged = F.transform(self.matches(text), lambda m: F.struct(m.alias("m"), self.validate(m["text"]).alias("v")))
        out = F.transform(judged, finding).cast(f"array<{FINDING}>")
        return F.when(text.rlike(self.guard), out).otherwise(R.empty(FINDING)) if self.guard else F.coalesce(out, R.empty(FINDING))


def _n(m: Column) -> Column:
    return F.length(R.digits_of(m))


def _email(m: Column) -> Verdict:
    return R.let(F.element_at(F.split(m, "@", 2), 2), lambda h: verdict((h.contains(".") & ~h.startswith(".") & ~h.endswith("."), "the domain isn't one")))


def _ssn(m: Column) -> Verdict:
    return R.let(
        R.digits_of(m),
        lambda d: verdict(
            (F.length(d) == 9, "not nine digits"), (~d.startswith("000"), "area 000"), (~d.startswith("666"), "area 666"), (~d.startswith("9"), "area from 900"),
            (F.substring(d, 4, 2) != "00", "group 00"), (F.substring(d, 6, 4) != "0000", "serial 0000"),
        ),
    )


def _document(m: Column) -> Verdict:
    return verdict((m.rlike("[0-9]"), "no digit"), (~m.rlike("[^0-9A-Za-z]"), "other than letters and digits"))


def _tax_de(m: Column) -> Verdict:
    return R.let(R.digits_of(m), lambda d: verdict((F.length(d) == 11, "not eleven digits"), (V.tax_id_de_distribution(d), "digit distribution"), (V.iso7064_11_10(d, 11), "check digit")))


def _ahv(m: Column) -> Verdict:
    return R.let(R.digits_of(m), lambda d: verdict((F.length(d) == 13, "not thirteen digits"), (d.startswith("756"), "country isn't 756"), (V.ean13(d), "check digit")))


def _vat(m: Column) -> Verdict:
    def judge(v: Column) -> Column:
        return R.let(F.struct(F.when(v.startswith("ATU"), F.lit("AT")).when(v.startswith("CHE"), F.lit("CH")).otherwise(F.substring(v, 1, 2)).alias("c"), F.when(v.startswith("ATU"), F.substring(v, 4, 99)).otherwise(F.substring(v, 3, 99)).alias("n"), R.digits_of(v).alias("d")), of)

    def of(x: Column) -> Column:
        c, n, d = x["c"], F.length(x["n"]), x["d"]
        ok = (
            F.when(c == "DE", R.let(d, lambda e: V.iso7064_11_10(e, 9))).when(c == "AT", R.let(d, V.vat_at)).when(c == "CH", n >= 9).when(c.isin("FR", "IT"), n == 11)
            .when(c == "ES", n == 9).when(c == "NL", n == 12).when(c.isin("BE", "PL"), n == 10).when(c == "GB", n.isin(9, 12))
        )
        return R.let(F.struct(c.alias("c"), ok.alias("ok")), said)

    def said(y: Column) -> Column:
        ok = y["ok"]
        reason = F.when(~ok, F.concat(F.lit("format or check digit of "), y["c"]))
        return F.struct(F.when(ok, VALID).when(~ok, INVALID).otherwise(UNVALIDATED).alias("validation"), reason.alias("reason"))

    return R.let(F.upper(R.alnum_of(m)), judge)


def _words(*patterns: str) -> tuple[str, ...]:
    """Between word boundaries."""
    return tuple(rf"\b{p}\b" for p in patterns)


_SEP = r"[\s.-]"


def _phones() -> tuple[str, ...]:
    tail, o = r"\s?[-/\d\s]{7,15}", _SEP + "?"
    three, four = r"\d{3}", r"\d{4}"
    dach = "(?:4[139])"
    return (
        rf"\+{dach}{tail}", rf"00{dach}{tail}",
        rf"\+1{o}{three}{o}{three}{o}{four}", rf"1{_SEP}{three}{_SEP}{three}{_SEP}{four}", rf"\({three}\){o}{three}{o}{four}", rf"{three}{_SEP}{three}{_SEP}{four}",
        rf"\+44{o}\d{{2,4}}{o}\d{{3,4}}{o}\d{{3,6}}", rf"07{three}{o}\d{{6}}",
        r"\+33" + o + r"\d" + (o + r"\d{2}") * 4,
        rf"\+[1-9]\d{{6,14}}", r"0\d{1,4}[-/\s]?\d{4,10}", rf"\(0\d{{1,4}}\)\s?\d{{3,10}}",
    )


#: Country and what follows it (with or without white space); Switzerland's has separators and a suffix.
_VAT = {
    "DE": r"\d{9}", "ATU": r"\d{8}", "CHE": None, "FR": r"[A-Z0-9]{2}\s?\d{9}", "IT": r"\d{11}", "ES": r"[A-Z]\d{7}[0-9A-Z]", "NL": r"\d{9}B\d{2}",
    "BE": r"[01]\d{9}", "PL": r"\d{10}", "GB": r"\d{9}(?:\d{3})?", "LU": r"\d{8}", "IE": r"\d{7}[A-Z]{1,2}", "PT": r"\d{9}", "EL": r"\d{9}",
    "CZ": r"\d{8,10}", "HU": r"\d{8}", "RO": r"\d{2,10}", "SE": r"\d{12}", "DK": r"\d{8}", "FI": r"\d{8}",
}


def _vats() -> tuple[str, ...]:
    s = r"[-.\s]?"
    swiss = rf"(?i)\bCHE(?:{s}\d{{3}}){{3}}(?:\s?(?:MWST|TVA|IVA))?\b"
    return tuple(swiss if v is None else rf"(?i)\b{k}\s?{v}\b" for k, v in _VAT.items())


def _length(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(R.alnum_of(m)).between(low, high)


_IDENTITY = "CFGHJKLMNPRTVWXY"

DEFAULT: dict[str, Detector] = {
    d.name: d
    for d in (
        Detector("email", "email", 1.0, (r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",), guard="@", validate=_email),
        Detector("iban", "iban", 1.0, (r"(?i)\b[A-Z]{2}\s?\d{2}\s?(?:[0-9A-Z]\s?){11,30}\b",), guard=r"[a-zA-Z]{2}\s?\d\d", validate=lambda m: verdict((V.iban(m), "shape or check digits"))),
        Detector("phone", "phone", 0.9, _phones(), guard=r"(?:\d[\s./()+-]{0,15}){7}", overlap=False, keep=lambda m: _n(m) >= 7, validate=lambda m: R.let(_n(m), lambda n: verdict((n.between(7, 15), F.concat(n.cast("string"), F.lit(" digits"))), otherwise=UNVALIDATED)), sort=True),
        Detector("credit_card", "credit_card", 1.0, (r"\b(?:\d[-\s]?){13,19}\b",), guard=r"(?:\d[\s-]?){13}", keep=lambda m: _n(m).between(13, 19), validate=lambda m: R.let(R.digits_of(m), lambda d: verdict((V.luhn(d), "check digit")))),
        Detector("ssn", "ssn", 0.95, _words(r"\d{3}-\d\d-\d{4}", r"\d{3} \d\d \d{4}"), guard=r"\d{3}[- ]\d\d[- ]\d{4}", overlap=True, validate=_ssn),
        Detector("passport", "passport", 0.85, _words(r"[A-Z]\d{8}", r"\d{9}", r"[A-Z0-9]{9}", r"[A-Z][A-Z]?\d{6,7}"), guard=r"[A-Z0-9]{6}\d|\d[A-Z0-9]{6}|[A-Z0-9]{9}", overlap=True, keep=lambda m: F.length(m).between(6, 9) & m.rlike("[0-9]"), validate=_document),
        Detector("drivers_license", "drivers_license", 0.8, _words(r"[A-Z]\d{12}", r"[A-Z]\d{11}", r"\d{9}", r"\d{8}", r"[A-Z]\d{7}"), guard=r"\d{7}", overlap=True, keep=_length(7, 13), validate=_document),
        Detector("tax_id_de", "tax_id_de", 0.95, _words(r"[1-9]\d{10}"), guard=r"\d{11}", validate=_tax_de),
        Detector("ahv_ch", "ahv_ch", 0.95, _words(r"756(?:\.\d{4}){2}\.\d\d", r"756(?:\s\d{4}){2}\s\d\d", r"756\d{10}"), guard="756", overlap=False, validate=_ahv),
        Detector("national_id_de", "national_id_de", 0.9, (rf"(?i)\b[{_IDENTITY}][0-9{_IDENTITY}]{{8}}\d\b",), guard=rf"(?i)[0-9{_IDENTITY}]{{9}}\d", validate=lambda m: verdict((V.weighted_731(m), "check digit"))),
        Detector("vat_number", "vat_number", 0.95, _vats(), guard=rf"(?i)\b(?:{'|'.join(_VAT)})[-.\s]?(?:[0-9A-Z]{{1,2}}\s?)?\d", overlap=False, validate=_vat),
    )
}


@dataclass
class Registry:
    """Detectors by name. Only those enabled are in the plan."""

    detectors: dict[str, Detector] = field(default_factory=lambda: dict(DEFAULT))
    disabled: set[str] = field(default_factory=set)

    def register(self, d: Detector) -> "Registry":
        self.detectors[d.name] = d
        return self

    def enable(self, name: str) -> "Registry":
        self.disabled.discard(name)
        return self

    def disable(self, name: str) -> "Registry":
        if name in self.detectors:
            self.disabled.add(name)
        return self

    def is_enabled(self, name: str) -> bool:
        return name in self.detectors and name not in self.disabled

    @property
    def names(self) -> list[str]:
        return sorted(self.detectors)

    @property
    def enabled(self) -> list[Detector]:
        return [self.detectors[n] for n in self.names if n not in self.disabled]

    def only(self, names: Iterable[str]) -> "Registry":
        """An allow-list, without regard to case; an unknown name is an error."""
        wanted = [n.strip().lower() for n in names]
        if unknown := sorted(set(wanted) - set(self.detectors)):
            raise ValueError(f"unknown detectors: {', '.join(unknown)}; there are {', '.join(self.names)}")
        return Registry({n: self.detectors[n] for n in wanted})

    def for_categories(self, categories: Iterable[str]) -> "Registry":
        """What a policy on these categories needs."""
        own = set(categories)
        return Registry({n: d for n, d in self.detectors.items() if d.category in own and n not in self.disabled}) if own else self

    @quick
    def findings(self, text: Column) -> Column:
        """All findings of a text by start. Equal starts are in the order of category and end."""
        if not self.enabled:
            return R.empty(FINDING)
        # one look for a digit spares most texts the looks of those that need one
        numeric = [d for d in self.enabled if d.guard and ("\\d" in d.guard or d.guard.isdigit())]
        parts = [d.findings(text) for d in self.enabled if d not in numeric]
        if numeric:
            parts.append(F.when(text.rlike("[0-9]"), F.concat(*[d.findings(text) for d in numeric])).otherwise(R.empty(FINDING)))
        return F.array_sort(F.concat(*parts), _by_start)


def _by_start(a: Column, b: Column) -> Column:
    def order(x: Column, y: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    first, second, third = order(a["start"], b["start"]), order(a["category"], b["category"]), order(a["end"], b["end"])
    return F.when(first != 0, first).when(second != 0, second).otherwise(third)


def with_findings(df: DataFrame, registry: Registry | None = None, text: str = "content", into: str = "findings") -> DataFrame:
    """Adds the array of findings: no shuffle, no Python."""
    return df.withColumn(into, (registry or Registry()).findings(F.col(text)))


def detect(segments: DataFrame, registry: Registry | None = None, text: str = "content") -> DataFrame:
    """One row a finding, with the segment's other columns."""
    rest = [c for c in segments.columns if c != text]
    # explode() would add a filter on the size of the array, and with it find everything twice
    found = with_findings(segments, registry, text, "_f").select(*rest, F.explode_outer("_f").alias("_f"))
    return found.where(F.col("_f").isNotNull()).select(*rest, "_f.*")


def detect_in_text(spark, text: str, registry: Registry | None = None) -> list[dict]:
    """Of one string; for trying things out."""
    df = spark.createDataFrame([(text,)], "content string")
    return [r.asDict() for r in detect(df, registry).collect()]


def is_valid(findings: Column) -> Column:
    """Those not found invalid."""
    return F.filter(findings, lambda f: f["validation"] != INVALID)


def with_base(d: Detector, base: float) -> Detector:
    return replace(d, base=base)
