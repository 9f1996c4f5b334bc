"""Postal addresses over the lines of a text: a street, a town on the next line or the same, a country after.

Lines are an array with their offsets; the lines after one are looked up by index, so a text needs no explode and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.building import quick
from ..functions.regexkit import let

COMPONENT = "struct<type:string,text:string,start:int,end:int>"
BLOCK = f"struct<format:string,start:int,end:int,full_text:string,confidence:float,components:array<{COMPONENT}>>"

_DE, _FR = "A-Za-zäöüÄÖÜß", "A-Za-zàâäçéèêëîïôöùûü"
_dotted = lambda *w: "|".join(x + r"\.?" for x in w)


def _run(letters: str, more: int, between: str = r"\s+") -> str:
    """A word of the letters and so many more at most: bounded, as such patterns backtrack."""
    word = f"[{letters}]+"
    return word + f"(?:{between}{word})" + "{0,%d}" % more


_NUMBER, _WAYS = r"\b\d" + "{1,5}", "Avenue|Boulevard|Circle|Court|Drive|Lane|Place|Road|Street|Way"
STREET = {
    "en": "(?i)" + _NUMBER + r"\s+(?:[ENSW][.]?\s+)?" + _run("A-Za-z", 5) + rf"\s+(?:{_WAYS}|{_dotted('Ave', 'Blvd', 'Cir', 'Ct', 'Dr', 'Ln', 'Pl', 'Rd', 'St')})\b",
    "de": rf"(?i)\b[{_DE}]+(?:allee|damm|gasse|platz|ring|straße|str\.?|weg)\s+" + r"\d" + "{1,5}" + r"[a-z]?\b",
    "fr": "(?i)" + _NUMBER + rf"(?:,?\s+(?:ter|bis))?\s+(?:allée|avenue|boulevard|chemin|impasse|passage|place|rue|{_dotted('av', 'bd', 'pl')})\s+" + _run(_FR, 5) + r"\b",
}
_FIVE = r"\d" + "{5}"
#: Groups: what precedes and is each part, so that lengths give offsets.
TOWN = {
    "en": (r"(?i)\b(" + _run("A-Za-z", 4) + r")(,\s*)([A-Z]{2})(\s+)(" + _FIVE + r"(?:-\d{4})?)\b", ("city", None, "state", None, "postal_code")),
    "de": (rf"\b({_FIVE})(\s+)({_run(_DE, 4)})\b", ("postal_code", None, "city")),
    "fr": (rf"\b({_FIVE})(\s+)({_run(_FR, 4, '[- ]')})\b", ("postal_code", None, "city")),
}
#: What a line with a street or a town holds at least.
STREET_GUARD = {k: r"\d" for k in STREET}
TOWN_GUARD = {"en": r"[A-Za-z]\s+" + _FIVE, "de": _FIVE + r"\s", "fr": _FIVE + r"\s"}
_NATIONS = "Australia;Austria;Belgique;Belgium;Canada;Deutschland;España;France;Germany;Italien;Italy;Netherlands;Österreich;Poland;Polen;Schweiz;Spain;Spanien;Suisse;Switzerland;U.S.A.;UK;USA;United Kingdom;United States"
COUNTRY = r"(?i)\b(?:" + "|".join(n.replace(".", r"\.") for n in _NATIONS.split(";")) + r")\b"


def _component(kind: str, text: Column, start: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"), start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"))


def _none() -> Column:
    return F.array().cast(f"array<{COMPONENT}>")


def _found(line: Column, pattern: str, kind: str, offset: Column, guard: str | None = None) -> Column:
    """At most one component. guard: a cheaper pattern that a line with a match holds."""
    at = offset + F.regexp_instr(line, F.lit(pattern)) - 1
    one = lambda m: F.when(m != "", let(at, lambda i: F.array(_component(kind, m, i))))
    found = let(F.regexp_extract(line, pattern, 0), one)
    return F.coalesce(F.when(line.rlike(guard), found) if guard else found, _none()).cast(f"array<{COMPONENT}>")


#: Between the parts of a match; no part of a town can hold it.
_SEP = "\x01"


def _town(line: Column, form: str, offset: Column) -> Column:
    pattern, kinds = TOWN[form]
    flags, bare = ("(?is)", pattern[4:]) if pattern.startswith("(?i)") else ("(?s)", pattern)
    # one pass for what precedes the match and its parts
    whole = F.regexp_replace(line, f"{flags}^(.*?){bare}.*", _SEP.join(f"${i}" for i in range(1, len(kinds) + 2)))

    def placed(x: Column) -> Column:
        """The parts of a match, from the ends of what lies before them; what precedes the match can hold the separator too."""
        g = F.slice(F.split(x["all"], _SEP), -len(kinds), len(kinds))
        sizes = F.aggregate(g, F.lit(0), lambda n, y: n + F.length(y))
        start = offset + F.length(x["all"]) - sizes - len(kinds)
        return let(F.struct(g.alias("g"), start.alias("at")), split)

    def split(x: Column) -> Column:
        at, parts = x["at"], []
        for i, kind in enumerate(kinds):
            if kind:
                parts.append(_component(kind, x["g"][i], at))
            at = at + F.length(x["g"][i])
        return F.array(*parts)

    found = F.when(line.rlike(pattern), let(F.struct(whole.alias("all")), placed))
    return F.coalesce(F.when(line.rlike(TOWN_GUARD[form]), found), _none()).cast(f"array<{COMPONENT}>")


def _confidence(parts: Column) -> Column:
    has = lambda k: F.exists(parts, lambda p: p["type"] == k)
    score = F.when(F.size(parts) > 0, 0.2).otherwise(0.0)
    for kind, w in (("street", 0.25), ("city", 0.2), ("postal_code", 0.2), ("country", 0.15)):
        score = score + F.when(has(kind), w).otherwise(0.0)
    return F.least(score, F.lit(1.0)).cast("float")


def _valid(b: Column) -> Column:
    return (F.size(b["components"]) >= 2) & (b["confidence"] >= F.lit(0.4).cast("float"))


def _placed(text: Column) -> Column:
    """array<struct<line,at>>: carriage returns belong to their line."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<line:string,at:int>>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(F.regexp_replace(x, "\r$", "").alias("line"), a["at"].alias("at")))).alias("out"))
    return F.aggregate(F.split(text, "\n"), zero, step, lambda a: a["out"])


def _looked(lines: Column, form: str) -> Column:
    """Of each line with a street: the street, the ends of the line and of the two below, and these lines. Only they are looked at further."""
    place = lambda x: F.struct(x["line"].alias("line"), x["at"].alias("at"), (x["at"] + F.length(x["line"])).alias("end"))

    def one(x: Column, i: Column) -> Column:
        street = _found(x["line"], STREET[form], "street", x["at"], STREET_GUARD[form])
        near = lambda s: F.struct(s.alias("street"), place(x).alias("own"), place(F.get(lines, i + 1)).alias("one"), place(F.get(lines, i + 2)).alias("two"))
        return let(street, lambda s: F.when(F.size(s) > 0, near(s)))

    return F.filter(F.transform(lines, one), lambda x: x.isNotNull())


def _made(looked: Column, form: str) -> Column:
    """Parts and end of the block that starts on each line with a street."""
    towns = lambda x, k: F.coalesce(_town(x[k]["line"], form, x[k]["at"]), _none())
    nation = lambda x, k: F.coalesce(_found(x[k]["line"], COUNTRY, "country", x[k]["at"]), _none())
    order = ("two", "one", "own") if form == "de" else ("two",)

    def known(x: Column) -> Column:
        return F.struct(x["street"].alias("street"), *[x[k]["end"].alias(f"end_{k}") for k in ("own", "one", "two")], towns(x, "own").alias("town_own"), towns(x, "one").alias("town_one"), *[nation(x, k).alias(f"country_{k}") for k in order])

    def block(x: Column) -> Column:
        some = lambda k: F.size(x[k]) > 0
        country, end = _none(), F.when(some("town_one"), x["end_one"]).otherwise(x["end_own"])
        for k in reversed(order):
            country, end = F.when(some(f"country_{k}"), x[f"country_{k}"]).otherwise(country), F.when(some(f"country_{k}"), x[f"end_{k}"]).otherwise(end)
        parts = F.concat(x["street"], F.when(some("town_one"), x["town_one"]).otherwise(x["town_own"]), country)
        return F.struct(parts.alias("parts"), end.alias("end"))

    return F.transform(F.transform(looked, known), block)


def _finish(text: Column, made: Column, form: str) -> Column:
    def block(parts: Column, start: Column, end: Column) -> Column:
        return F.struct(F.lit(form).alias("format"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(text, start + 1, end - start).alias("full_text"), _confidence(parts).alias("confidence"), parts.alias("components"))

    multi = F.filter(F.transform(made, lambda b: block(b["parts"], F.get(b["parts"], F.lit(0))["start"], b["end"])), _valid).cast(f"array<{BLOCK}>")
    # one town of the whole text besides, unless a block has it
    one = lambda parts: F.when(F.size(parts) > 0, F.array(block(parts, F.get(parts, F.lit(0))["start"], F.element_at(parts, -1)["end"])))
    alone = F.coalesce(let(_town(text, form, F.lit(0)), one), F.array()).cast(f"array<{BLOCK}>")
    return F.aggregate(F.filter(alone, _valid), multi, lambda acc, b: F.when(F.exists(acc, lambda m: (m["start"] <= b["start"]) & (m["end"] >= b["end"])), acc).otherwise(F.concat(acc, F.array(b))))


@quick
def detect_addresses(df: DataFrame, form: str = "auto", text: str = "content", into: str = "addresses") -> DataFrame:
    """Adds the array of address blocks. form: en, de, fr, or auto for all three."""
    if form not in ("en", "de", "fr", "auto"):
        raise ValueError(f"unknown address format: {form}")
    forms = ("en", "de", "fr") if form == "auto" else (form,)
    rest = df.columns
    # each step is a column, so that it is computed once; texts without a digit have no lines to look at
    out = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_lines", F.when(F.col("_t").rlike("[0-9]"), _placed(F.col("_t"))).otherwise(F.array().cast("array<struct<line:string,at:int>>")))
    out = out.select("*", *[_looked(F.col("_lines"), k).alias(f"_looked_{k}") for k in forms])
    out = out.select("*", *[_made(F.col(f"_looked_{k}"), k).alias(f"_made_{k}") for k in forms])
    return out.select(*rest, F.concat(*[_finish(F.col("_t"), F.col(f"_made_{k}"), k) for k in forms]).alias(into))
