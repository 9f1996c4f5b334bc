"""Declarative policies: which findings count, and how values are protected.

A policy is a small driver object. Its detection rules become one predicate over the array of findings; its protection rules one
CASE in the order of the rules.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions.building import quick
from ..schema import MIN_CONFIDENCE
from .redact import Mask, Redaction, Style

LOCALES = ("de-at", "de-de", "de-ch", "en")
ACTIONS = ("redact", "mask", "hash", "encrypt", "pseudonymize", "tokenize")
STYLES = {"label": "label", "black_bar": "bar", "bar": "bar", "mask": "mask"}


@dataclass(frozen=True)
class DetectionRule:
    #: Categories; none: all.
    types: tuple[str, ...] = ()
    confidence_threshold: float = MIN_CONFIDENCE
    enabled: bool = True

    def admits(self, f: Column) -> Column:
        sure = f["confidence"] >= F.lit(self.confidence_threshold).cast("float")
        return f["category"].isin(*self.types) & sure if self.types else sure


@dataclass(frozen=True)
class ProtectionRule:
    types: tuple[str, ...] = ()
    action: str = "redact"
    style: str | None = None
    consistent: bool = False
    key_ref: str | None = None

    def applies(self, f: Column) -> Column:
        return f["category"].isin(*self.types) if self.types else F.lit(True)


@dataclass(frozen=True)
class Policy:
    version: str = "1.0"
    name: str = ""
    locale: str | None = None
    detection: tuple[DetectionRule, ...] = ()
    protection: tuple[ProtectionRule, ...] = ()

    @property
    def version_supported(self) -> bool:
        return self.version.startswith("1.")

    def admits(self, f: Column) -> Column:
        """Any enabled rule that admits a finding is enough; without rules all count."""
        if not self.detection:
            return F.lit(True)
        out = F.lit(False)
        for r in self.detection:
            if r.enabled:
                out = out | r.admits(f)
        return out

    @property
    def categories(self) -> tuple[str, ...]:
        """Those that can count; none if all can. Only their detectors need to be in a plan."""
        rules = [r for r in self.detection if r.enabled]
        return tuple(sorted({t for r in rules for t in r.types})) if rules and all(r.types for r in rules) else ()


def default_policy() -> Policy:
    own = ("email", "iban", "phone", "credit_card")
    return Policy("1.0", "default", None, (DetectionRule(own),), (ProtectionRule(own, "redact", "label"),))


def filter_findings(findings: Column, policy: Policy) -> Column:
    return F.filter(findings, policy.admits)


def parse_policy(text: str) -> Policy:
    """YAML; unknown keys are ignored."""
    import yaml

    raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or "version" not in raw or "name" not in raw:
        raise ValueError("a policy has a version and a name")

    def rule(kind, r):
        if "types" not in r:
            raise ValueError("a rule has types")
        own = {k: v for k, v in r.items() if k in kind.__dataclass_fields__}
        return kind(**(own | {"types": tuple(t.lower() for t in r["types"] or ())}))

    p = Policy(
        str(raw["version"]), str(raw["name"]), raw.get("locale"),
        tuple(rule(DetectionRule, r) for r in raw.get("detection") or ()), tuple(rule(ProtectionRule, r) for r in raw.get("protection") or ()),
    )
    if not p.version_supported:
        raise ValueError(f"policy version {p.version} isn't supported")
    return p


def load_policy(path: str) -> Policy:
    return parse_policy(Path(path).read_text())


@dataclass
class Validation:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not self.errors


def validate_policy(p: Policy) -> Validation:
    v = Validation()
    if not p.version_supported:
        v.errors.append(f"version {p.version} isn't supported")
    if not p.name:
        v.errors.append("no name")
    if p.locale and p.locale not in LOCALES:
        v.errors.append(f"unknown locale {p.locale}")
    v.errors += [f"threshold {r.confidence_threshold} isn't between 0 and 1" for r in p.detection if not 0 <= r.confidence_threshold <= 1]
    v.errors += [f"unknown action {r.action}" for r in p.protection if r.action not in ACTIONS]
    v.errors += ["encryption without key_ref" for r in p.protection if r.action == "encrypt" and not r.key_ref]
    v.warnings += ["no detection rules: all findings count"] * (not p.detection) + ["no protection rules"] * (not p.protection)
    return v


def resolve_key(ref: str) -> bytes:
    """env://NAME or file:///path: base64, or the bytes themselves."""
    scheme, _, rest = ref.partition("://")
    if scheme == "env":
        if (raw := os.environ.get(rest)) is None:
            raise KeyError(f"{rest} isn't set")
        data = raw.encode()
    elif scheme == "file":
        data = Path(rest).read_bytes().strip()
    else:
        raise ValueError(f"unknown key reference: {scheme}")
    try:
        key = base64.b64decode(data, validate=True)
        return key if len(key) in (16, 24, 32) else data
    except ValueError:
        return data


def redaction_config(p: Policy) -> Redaction:
    """Styles by category of the policy's redact and mask rules, the first rule of a category counting."""
    styles: dict[str, Style] = {}
    default = Style()
    for r in reversed(p.protection):
        if r.action in ("redact", "mask"):
            name = r.style or ("mask" if r.action == "mask" else "label")
            style = Style(STYLES[name]) if name in STYLES else Style("custom", f"[{name}]")
            if r.types:
                styles |= {t: style for t in r.types}
            else:
                default = style
    return Redaction(default, styles)


def protected_value(rule: ProtectionRule, f: Column, locale: str | None = None, salt: bytes | None = None) -> Column:
    """The value in place of a finding's text. Tokens and pseudonyms here are keyed hashes; vault.tokenize() makes reversible ones."""
    x = f["matched_text"]
    if rule.action == "redact":
        if rule.style in (None, "label"):
            return F.lit("[REDACTED]")
        if rule.style in STYLES:
            return Style(STYLES[rule.style]).replacement(f)
        return F.lit(f"[{rule.style.upper()}]")
    if rule.action == "mask":
        return Mask().apply(x)
    if rule.action == "hash":
        return crypto.digest(x, salt=salt)
    if rule.action == "encrypt":
        return crypto.encrypt(x, resolve_key(rule.key_ref))
    if rule.action == "tokenize":
        key = resolve_key(rule.key_ref) if rule.key_ref else salt or b"token"
        return F.concat(F.lit("tok_"), F.substring(crypto.hmac_sha256(x, key), 1, 32))
    if rule.action == "pseudonymize":
        from .pseudonym import pseudonym

        return pseudonym(x, "name", locale or "en")
    raise ValueError(f"unknown action: {rule.action}")


@quick
def execute(df: DataFrame, policy: Policy, text: str = "content", findings: str = "findings", into: str = "protected", salt: bytes | None = None) -> DataFrame:
    """Filters findings and replaces each by its first rule's value, at its own span; findings without a rule stay.

    Equal values get equal replacements (all but encryption's are functions of the value), which is what consistency asks for.
    Adds struct<text, actions array<struct<category,action,replacement>>>.
    """
    from .redact import resolve

    kind = df.schema[findings].dataType.simpleString()
    rules = policy.protection

    def pick(f: Column) -> Column:
        action, value = F.lit(None).cast("string"), f["matched_text"]
        for r in reversed(rules):
            action = F.when(r.applies(f), F.lit(r.action)).otherwise(action)
            value = F.when(r.applies(f), protected_value(r, f, policy.locale, salt)).otherwise(value)
        return F.struct(f["start"].alias("start"), f["end"].alias("end"), f["category"].alias("category"), action.alias("action"), value.alias("value"))

    chosen = F.transform(resolve(filter_findings(F.col(findings), policy), kind), pick)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.col(text)

    def step(a: Column, p: Column) -> Column:
        return F.struct(p["end"].alias("at"), F.concat(a["out"], F.substring(body, a["at"] + 1, p["start"] - a["at"]), p["value"]).alias("out"))

    out = df.withColumn("_p", chosen)
    done = F.aggregate("_p", zero, step, lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))))
    actions = F.transform(F.filter("_p", lambda p: p["action"].isNotNull()), lambda p: F.struct(p["category"].alias("category"), p["action"].alias("action"), p["value"].alias("replacement")))
    return out.withColumn(into, F.struct(done.alias("text"), actions.alias("actions"))).drop("_p")
