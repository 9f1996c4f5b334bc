"""Context rules: markers near findings raise or lower their confidence.

Markers of a text are found once, as arrays, and applied to all of its findings: no join and no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regexkit as R
from ..functions.building import quick

BOOST, SUPPRESS, NEUTRAL = "boost", "suppress", "neutral"
MARKER = "struct<start:int,end:int,text:string,action:string,weight:float,category:string>"
WINDOW = 200


@dataclass(frozen=True)
class Rule:
    pattern: str
    action: str = BOOST
    weight: float = 0.3
    category: str | None = None
    language: str | None = None
    description: str = ""
    window_size: int = WINDOW

    @property
    def compiles(self) -> bool:
        """Not too long, no nested or trailing quantifier in a group, and a regular expression; others are left out."""
        if len(self.pattern.encode()) > 1000 or unsafe(self.pattern):
            return False
        try:
            re.compile(self.pattern)
            return True
        except re.error:
            return False

    def applies_to(self, language: str) -> bool:
        return self.language is None or self.language == language

    def markers(self, text: Column) -> Column:
        extra = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit(self.action).alias("action"), F.lit(self.weight).cast("float").alias("weight"), F.lit(self.category).cast("string").alias("category"))
        return F.transform(R.find_all(text, self.pattern), extra).cast(f"array<{MARKER}>")


def unsafe(pattern: str) -> bool:
    """A quantifier right before a closing parenthesis, or a quantified group that holds one."""
    if re.search(r"[+*?}]\s*\)", pattern):
        return True
    open_groups: list[bool] = []
    for i, c in enumerate(pattern):
        if c == "(":
            open_groups.append(False)
        elif c == ")" and open_groups:
            if open_groups.pop() and pattern[i + 1 : i + 2] in ("+", "*", "{"):
                return True
        elif c in "+*" and open_groups and pattern[i - 1] != "\\":
            open_groups[-1] = True
    return False


def _any(*words: str) -> str:
    return "(" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


def _rules(language: str, titles, greeting, roles, mail, phone, orders, streets, places, own=()) -> list[Rule]:
    """What the three languages have in common, with their words. titles and own come as whole patterns."""
    colon, dot = r"\s*[:]\s*", r"\s*[:.]?\s*"
    made = [
        (titles, BOOST, 0.3, None), (rf"\b{_any(*greeting[1])}\s+", BOOST, greeting[0], None), (_any(*roles) + colon, BOOST, 0.35, None),
        (_any(*mail) + colon, BOOST, 0.4, "email"), (_any(*phone) + colon, BOOST, 0.4, "phone"), (rf"\b{_any('version', 'ver', 'v')}\s+\d", SUPPRESS, 0.6, "ipv4"),
        (orders, SUPPRESS, 0.7, "credit_card"), (_any(*streets) + dot, BOOST, 0.3, None), (_any(*places) + colon, BOOST, 0.35, None), *own,
    ]
    return [Rule("(?i)" + p, a, w, c, None if language == "*" else language) for p, a, w, c in made]


def builtin_rules(language: str) -> list[Rule]:
    """For en, de and fr; others have none."""
    if language == "en":
        return _rules(
            "en", r"\b" + _any("mr", "mrs", "ms", "miss", "dr", "prof", "professor") + r"\.\s+", (0.2, ("dear", "hello", "hi")),
            ("contact person", "signed by", "from", "to", "cc", "name", "patient name", "customer name", "author"), ("email", "e-mail", "mail"),
            ("phone", "tel", "telephone", "mobile", "cell"), r"\border\s*" + _any("#", "number", "no", "nr"),
            ("street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "lane", "ln", "drive", "dr"), ("address", "addr", "location", "residence"),
            ((r"\b" + _any("sir", "madam", "lord", "lady") + r"\s+", BOOST, 0.25, None), (r"\binternal\s+" + _any("ip", "address"), SUPPRESS, 0.3, "ipv4"),
             (r"\b" + _any("sku", "product code", "item #"), SUPPRESS, 0.6, "credit_card"), (r"\bisbn" + r"[\s-]*(13|10)?", SUPPRESS, 0.8, None)),
        )
    if language == "de":
        return _rules(
            "de", r"\b" + _any("herr", "frau", "dr", "prof") + r"\.\s+", (0.25, ("sehr geehrte[rs]?|sehr geehrte", "liebe[rs]?|liebe", "hallo")),
            ("kontaktperson", "unterzeichnet von", "von", "an", "name", "patientenname", "kundenname"), ("e-?mail", "mail"), ("telefon", "tel", "mobil", "handy"),
            r"\b" + _any("bestellung", "auftrag", "bestell-?nr", "auftrags-?nr"), ("straße", "strasse", "str", "weg", "platz", "allee", "gasse"), ("adresse", "anschrift", "wohnort"),
        )
    if language == "fr":
        return _rules(
            "fr", r"\b" + _any("monsieur", "madame", "mademoiselle", r"m\.", "mme", "mlle", "dr", "prof") + r"\s+", (0.25, ("cher", "chère", "bonjour", "salut")),
            ("personne de contact", "signé par", "de", "à", "nom", "nom du patient", "nom du client"), ("e-?mail", "courriel", "mail"), ("téléphone", "tél", "portable", "mobile"),
            r"\b" + _any("commande", "numéro de commande", "n° commande"), ("rue", "avenue", "av", "boulevard", "bd", "place", "pl", "chemin", "allée"), ("adresse", "domicile", "résidence"),
        )
    return []


def all_rules() -> list[Rule]:
    return [r for k in ("en", "de", "fr") for r in builtin_rules(k)]


#: Categories by the names that rule files use.
ALIASES = {"ssn": "SSN", "person_name": "PersonName", "name": "PersonName", "address": "Address", "date_of_birth": "DateOfBirth"}


def parse_rules(text: str) -> list[Rule]:
    """YAML of version 1.0: language, rules with pattern, action, weight, category, description."""
    import yaml

    raw = yaml.safe_load(text)
    if str(raw.get("version")) != "1.0":
        raise ValueError(f"rules of version {raw.get('version')} aren't supported")
    out = []
    for r in raw.get("rules") or ():
        try:
            re.compile(r["pattern"])
        except re.error as e:
            raise ValueError(f"pattern {r['pattern']!r}: {e}") from None
        if not 0 <= float(r["weight"]) <= 1:
            raise ValueError(f"weight {r['weight']} isn't between 0 and 1")
        action = str(r["action"]).lower()
        if action not in (BOOST, SUPPRESS, NEUTRAL):
            raise ValueError(f"unknown action {action}")
        category = r.get("category")
        out.append(Rule(r["pattern"], action, float(r["weight"]), ALIASES.get(str(category).lower(), category) if category else None, raw.get("language"), r.get("description", ""), int(r.get("window_size", WINDOW))))
    return out


def load_rules(*paths: str) -> list[Rule]:
    return [r for p in paths for r in parse_rules(Path(p).read_text())]


def sample_rules() -> str:
    import yaml

    return yaml.safe_dump({"version": "1.0", "language": "en", "description": "sample", "rules": [{"pattern": r"(?i)\bpatient\b", "action": BOOST, "weight": 0.3, "category": "person_name", "description": "a patient"}]}, sort_keys=False)


@quick
def markers(text: Column, rules: list[Rule], language: str = "en") -> Column:
    """All matches of the language's rules by start; rules that don't compile are left out."""
    own = [r.markers(text) for r in rules if r.applies_to(language) and r.compiles]
    return F.array_sort(F.concat(*own)) if own else F.array().cast(f"array<{MARKER}>")


def near(marker: Column, f: Column, window: int = WINDOW) -> Column:
    """Within the window before or after, or overlapping."""
    return (marker["start"] - f["end"] <= window) & (f["start"] - marker["end"] <= window)


@quick
def analyze(df: DataFrame, rules: list[Rule], language: str = "en", text: str = "content", findings: str = "findings", scoped: bool = False) -> DataFrame:
    """Findings with adjusted confidence and context_reasoning.

    By default every marker of the text counts for each of its findings, whatever the marker's category: that is what the
    rules' published behaviour comes to. scoped=True keeps to the window and the category of each rule.
    """
    rules = [r for r in rules if r.action != NEUTRAL]

    def adjusted(f: Column) -> Column:
        own = F.col("_m")
        if scoped:
            own = F.filter(own, lambda m: near(m, f) & (m["category"].isNull() | (m["category"] == f["category"])))
        boost = F.aggregate(F.filter(own, lambda m: m["action"] == BOOST), F.lit(0).cast("float"), lambda a, m: (a + m["weight"]).cast("float"))
        keep = F.aggregate(F.filter(own, lambda m: m["action"] == SUPPRESS), F.lit(1).cast("float"), lambda a, m: (a * (F.lit(1).cast("float") - m["weight"])).cast("float"))
        raised = F.when(boost > 0, F.least(F.lit(1).cast("float"), f["confidence"] + boost)).otherwise(f["confidence"])
        why = F.transform(own, lambda m: F.concat(F.when(m["action"] == BOOST, "Boosted").otherwise("Suppressed"), F.lit(" by context marker '"), m["text"], F.lit("' at position "), m["start"].cast("string")))
        return F.struct(*[f[n].alias(n) for n in ("category", "start", "end", "matched_text")], (raised * keep).cast("float").alias("confidence"), f["validation"].alias("validation"), f["reason"].alias("reason"), why.alias("context_reasoning"))

    # texts without findings aren't searched for markers
    m = F.when(F.size(findings) > 0, markers(F.col(text), rules, language)).otherwise(F.array().cast(f"array<{MARKER}>"))
    return df.withColumn("_m", m).withColumn(findings, F.transform(findings, adjusted)).drop("_m")
