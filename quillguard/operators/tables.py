"""Tables inside texts: the header row says what a column holds and how much surer its findings are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.building import quick

HEADER = "struct<name:string,category:string,column_index:int,boost:float,start:int,end:int>"
DELIMITERS = (",", "\t", "|", ";")
_GROUPS = {
    ("email", 0.4): "correo e_mail email email_address emailaddress mail",
    ("phone", 0.4): "cell mobile phone phone_number phonenumber tel telefon telephone téléphone",
    ("PersonName", 0.35): "customer_name customername first_name firstname full_name fullname last_name lastname nachname name nom prénom vorname",
    ("SSN", 0.5): "social_security socialsecurity ss_number ssn ssnumber",
    ("credit_card", 0.55): "card_number cardnumber cc_number ccnumber credit_card creditcard payment_card",
    ("Address", 0.35): "addr address adresse anschrift street street_address streetaddress",
    ("ipv4", 0.4): "client_ip clientip ip ip_address ipaddress source_ip sourceip",
    ("ID", 0.15): "customer_id customerid id user_id userid",
    ("DateOfBirth", 0.35): "birth_date birthdate date_of_birth dateofbirth dob geburtsdatum",
}
MAPPINGS: dict[str, tuple[str, float]] = {name: key for key, names in _GROUPS.items() for name in names.split()}


def normalize(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def _headers(text: Column, delimiter: str, mappings: dict) -> Column:
    """Null if there is no table with this delimiter."""
    cut = "\\" + delimiter if delimiter == "|" else delimiter
    lines = F.split(text, "\r?\n")
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    cells = F.split(first, cut, -1)
    names = F.transform(cells, F.trim)
    score = F.size(F.filter(names, lambda c: (c != "") & c.rlike(r"^[\p{L}_ -]*$") & (F.octet_length(c) <= 30)))
    more = (F.size(lines) > 1) & ~((F.size(lines) == 2) & (second == ""))
    ok = (F.size(cells) >= 2) & (~more | (F.size(F.split(second, cut, -1)) == F.size(cells))) & (score >= F.floor(F.size(cells) / 2))
    known = F.create_map(*[F.lit(x) for k, (c, b) in mappings.items() for x in (k, f"{c}\t{b}")])

    def header(c: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(cells, 1, i), F.lit(0), lambda a, x: a + F.length(x) + 1)
        start = before + F.length(c) - F.length(F.ltrim(c))
        key = F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")
        hit = F.element_at(known, key)
        return F.struct(
            F.trim(c).alias("name"), F.split(hit, "\t")[0].alias("category"), i.cast("int").alias("column_index"),
            F.coalesce(F.split(hit, "\t")[1].cast("float"), F.lit(0).cast("float")).alias("boost"), start.cast("int").alias("start"), (start + F.length(F.trim(c))).cast("int").alias("end"),
        )

    return F.when(ok, F.transform(cells, header).cast(f"array<{HEADER}>"))


@quick
def detect_table(df: DataFrame, text: str = "content", into: str = "table", extra: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Adds struct<delimiter,column_count,headers>, null for texts without a table. extra: further headers."""
    mappings = MAPPINGS | {normalize(k): v for k, v in (extra or {}).items()}
    out = None
    for d in DELIMITERS:
        h = _headers(F.col(text), d, mappings)
        one = F.struct(F.lit(d).alias("delimiter"), F.size(h).alias("column_count"), h.alias("headers"))
        out = F.when(h.isNotNull(), one) if out is None else out.when(h.isNotNull(), one)
    return df.withColumn(into, out)


def column_boost(text: Column, table: Column, position: Column) -> Column:
    """Of the column at a position of the text; 0 in the header row and outside tables. Quotes aren't looked at."""
    before = F.substring(text, 1, position)
    row = F.length(before) - F.length(F.replace(before, F.lit("\n")))
    in_line = F.element_at(F.split(before, "\n", -1), -1)
    col = F.length(in_line) - F.length(F.replace(in_line, table["delimiter"]))
    on = (F.substring(text, position + 1, 1) != table["delimiter"]) & (F.substring(text, position + 1, 1) != "\n")
    zero = F.lit(0).cast("float")
    return F.when(table.isNull() | (row == 0) | ~on, zero).otherwise(F.coalesce(F.get(table["headers"], col.cast("int"))["boost"], zero))
