"""Seeded pseudonyms: the same value, kind, locale and seed give the same pseudonym, on any partition and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST = {"de": ("Anna", "Ben", "Clara", "David", "Emma", "Felix", "Greta", "Hannes", "Ida", "Jonas", "Klara", "Lukas", "Mia", "Noah", "Paula", "Rosa"), "en": ("Alice", "Blake", "Chloe", "Dylan", "Ella", "Finn", "Grace", "Henry", "Isla", "Jack", "Lily", "Mason", "Nora", "Owen", "Ruby", "Sam")}
LAST = {"de": ("Adler", "Baum", "Castner", "Dorn", "Eberle", "Falk", "Gruber", "Hahn", "Imhof", "Kern", "Lang", "Moser", "Nowak", "Pichler", "Reiter", "Sommer"), "en": ("Archer", "Bennett", "Carter", "Dalton", "Ellis", "Foster", "Grant", "Hayes", "Ingram", "Keller", "Lawson", "Mercer", "Norris", "Parker", "Quinn", "Reed")}
CITY = {"de": ("Altenau", "Birkfeld", "Eichberg", "Felsburg", "Grünstadt", "Hohenau", "Lindental", "Neukirch"), "en": ("Ashford", "Brookvale", "Clearwater", "Dunmore", "Eastfield", "Fairview", "Lakewood", "Milton")}
STREET = {"de": ("Lindenweg", "Hauptstraße", "Gartenallee", "Bergweg"), "en": ("Oak Street", "Main Road", "Hill Lane", "Park Avenue")}
KINDS = ("name", "first_name", "last_name", "email", "phone", "street", "city", "postal_code", "company", "iban")


def _part(h: Column, i: int, n: int) -> Column:
    """A number below n from the hash's i-th eight digits."""
    return (F.conv(F.substring(h, 8 * i + 1, 7), 16, 10).cast("long") % n).cast("int")


def _of(h: Column, i: int, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), _part(h, i, len(names)) + 1)


def _digits(h: Column, i: int, n: int) -> Column:
    return F.lpad((F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") % 10**n).cast("string"), n, "0")


def pseudonym(value: Column, kind: str = "name", locale: str = "en", seed: int | None = None) -> Column:
    """kind: one of KINDS; locale: de... or en. Without a seed the value alone decides."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    lang = "de" if locale.startswith("de") else "en"
    h = F.sha2(F.concat_ws("\x1f", F.lit("" if seed is None else str(seed)), F.lit(kind), value), 256)
    first, last = _of(h, 0, FIRST[lang]), _of(h, 1, LAST[lang])
    out = {
        "name": lambda: F.concat_ws(" ", first, last),
        "first_name": lambda: first,
        "last_name": lambda: last,
        "email": lambda: F.concat(F.lower(first), F.lit("."), F.lower(last), _digits(h, 2, 3), F.lit("@example.org")),
        "phone": lambda: F.concat(F.lit("+49 30 " if lang == "de" else "+1 555 "), _digits(h, 2, 7)),
        "street": lambda: F.concat(_of(h, 2, STREET[lang]), F.lit(" "), (_part(h, 3, 199) + 1).cast("string")) if lang == "de" else F.concat((_part(h, 3, 199) + 1).cast("string"), F.lit(" "), _of(h, 2, STREET[lang])),
        "city": lambda: _of(h, 2, CITY[lang]),
        "postal_code": lambda: _digits(h, 2, 5),
        "company": lambda: F.concat(last, F.lit(" GmbH" if lang == "de" else " Ltd")),
        "iban": lambda: _iban(F.concat(_digits(h, 2, 8), _digits(h, 3, 9), F.lit("0"))),
    }[kind]()
    return F.when(value.isNotNull(), out)


def _iban(account: Column) -> Column:
    """DE with 18 digits of account and right check digits."""
    rest = F.aggregate(F.filter(F.split(F.concat(account, F.lit("131400")), ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    return F.concat(F.lit("DE"), F.lpad((98 - rest).cast("string"), 2, "0"), account)
