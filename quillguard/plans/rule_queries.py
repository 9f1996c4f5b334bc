"""Queries of the other forms of the detectors, of overlaps, policies with every action, vaults, rules from YAML and the audit table."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import crypto
from ..operators import audit, context, dictionary, policy, protect, pseudonym, redact, vault
from ..operators.detectors import Registry, detect, with_findings
from ..sources import storage
from .catalog import CARD_SQL, MAIL, MAIL_SQL, _either, _k, _k_sql, built, conf_sql, digit_sql, documents, hmac_sql, query, rounded, table, weights_sql

_N = "(SELECT o_orderkey AS k, o_orderkey FROM orders)"


def _forms(name: str, category: str, forms: list[tuple[list, str]], base: float) -> None:
    """Over all orders, the key's remainder choosing the form. forms: parts (strings, or numbers of digits from the key) and the verdict in SQL of x."""

    def column(parts: list) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else _k(p, 7919 + 31 * i) for i, p in enumerate(parts)])

    def sql(parts: list) -> str:
        return " || ".join(f"'{p}'" if isinstance(p, str) else _k_sql(p, 7919 + 31 * i) for i, p in enumerate(parts))

    n = len(forms)
    made = "CASE k % {n} ".format(n=n) + " ".join(f"WHEN {i} THEN {sql(p)}" for i, (p, _) in enumerate(forms)) + " END"
    verdict = f"CASE k % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(forms)) + " END"
    rows = f"SELECT k, x, {verdict} AS validation FROM (SELECT k, {made} AS x FROM {_N})"

    @query(name, f"SELECT k, '{category}' AS category, CAST(0 AS INTEGER) AS start, CAST(length(x) AS INTEGER) AS \"end\", x AS matched_text, validation, {conf_sql(base)} AS confidence FROM ({rows})")
    def run(spark, d):
        text = F.coalesce(*[F.when(F.col("o_orderkey") % n == i, column(p)) for i, (p, _) in enumerate(forms)])
        return rounded(detect(built(spark, d, text), Registry().only([category])).select("k", "category", "start", "end", "matched_text", "validation", "confidence"))


_OPEN, _OK = "'unvalidated'", "'valid'"
_forms("detect_phone_forms", "phone", [(p, _OPEN) for p in (
    ["+43 664 ", 7], ["0049 89 ", 7], ["+1 555 ", 3, " ", 4], ["1-555-", 3, "-", 4], ["(555) ", 3, "-", 4], ["555-", 3, ".", 4],
    ["+44 20 ", 4, " ", 4], ["07", 3, " ", 6], ["+33 1 ", 2, " ", 2, " ", 2, " ", 2], ["+351", 9], ["0664/", 7], ["(0664) 2", 6],
)], 0.9)
_forms("detect_vat_forms", "vat_number", [
    (["FRAB", 9], _OK), (["IT", 11], _OK), (["ESA", 7, "B"], _OK), (["NL", 9, "B", 2], _OK), (["BE0", 9], _OK), (["PL", 10], _OK), (["GB", 9], _OK), (["GB", 12], _OK), (["CHE-", 3, ".", 3, ".", 3, " MWST"], _OK),
    *[(p, _OPEN) for p in (["LU", 8], ["IE", 7, "W"], ["PT", 9], ["EL", 9], ["CZ", 10], ["HU", 8], ["RO", 6], ["SE", 12], ["DK", 8], ["FI", 8])],
], 0.95)
_forms("detect_passport_forms", "passport", [(["C", 8], _OK), ([9], _OK), (["AB", 7], _OK), (["AB", 6], _OK), (["X", 7], _OK), (["A1B", 6], _OK)], 0.85)
_forms("detect_licence_forms", "drivers_license", [(["B", 12], _OK), (["B", 11], _OK), ([9], _OK), ([8], _OK), (["B", 7], _OK)], 0.8)
_SSN = _either("substr(x, 1, 3) NOT IN ('000', '666') AND substr(x, 1, 1) <> '9' AND substr(x, 5, 2) <> '00' AND substr(x, 8, 4) <> '0000'")
_forms("detect_ssn_spaces", "ssn", [([3, " ", 2, " ", 4], _SSN), ([3, "-", 2, "-", 4], _SSN)], 0.95)
_AHV = "(SELECT " + _either(f"(10 - ({weights_sql('d', [1, 3] * 6)}) % 10) % 10 = {digit_sql('d', '13')}") + " FROM (SELECT regexp_replace(x, '[^0-9]', '', 'g') AS d))"
_forms("detect_ahv_forms", "ahv_ch", [(["756 ", 4, " ", 4, " ", 2], _AHV), (["756", 10], _AHV), (["756.", 4, ".", 4, ".", 2], _AHV)], 0.95)


# Overlaps and places.


def _finding(category: str, start: int, end: int, confidence: float, text: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.substring(text, start + 1, end - start).alias("matched_text"), F.lit(confidence).cast("float").alias("confidence"), F.lit("valid").alias("validation"), F.lit(None).cast("string").alias("reason"))


#: Findings of four kinds of overlap, and what is left of 'abcdefghijkl'.
_OVERLAPS = [
    ([("a", 0, 6, 0.5), ("b", 4, 8, 0.9)], "[A]ghijkl"),  # the later one is shorter
    ([("a", 0, 3, 0.5), ("b", 2, 8, 0.6)], "ab[B]ijkl"),  # the later one is longer and as sure
    ([("a", 0, 3, 0.9), ("b", 2, 8, 0.4)], "[A]defghijkl"),  # longer, but the first is surer
    ([("a", 0, 3, 0.5), ("b", 3, 6, 0.5), ("c", 2, 9, 0.6), ("d", 20, 30, 1.0)], "ab[C]jkl"),  # one evicts two; one lies outside
]


@query("redact_overlaps", "SELECT o_orderkey AS k, CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(_OVERLAPS)) + " END || o_orderkey AS redacted FROM orders")
def _overlaps(spark, d):
    text = F.concat(F.lit("abcdefghijkl"), F.col("k").cast("string"))
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).withColumn("content", text)
    f = F.coalesce(*[F.when(F.col("k") % 4 == i, F.array(*[_finding(*x, F.col("content")) for x in xs])) for i, (xs, _) in enumerate(_OVERLAPS)])
    return redact.redact(t.withColumn("findings", f)).select("k", F.col("redacted.text").alias("redacted"))


@query("redact_positions", f"SELECT doc_id, CAST(length(regexp_replace(text, '{MAIL}', '[EMAIL]', 'g')) AS INTEGER) AS end_at, CAST(len(string_split_regex(text, '{MAIL}')) - 1 AS INTEGER) AS verified, 0 AS wrong FROM documents WHERE regexp_matches(text, '{MAIL}')")
def _positions(spark, d):
    """Where the end of a text is afterwards; records hold for their originals only."""
    found = with_findings(documents(spark, d), Registry().only(["email"])).where(F.size("findings") > 0)
    r = redact.redact(found, redact.Redaction(hmac_key=b"k"))
    ok = lambda change: F.size(F.filter(F.arrays_zip("r", "findings"), lambda x: redact.verify_original(x["r"], change(x["findings"]["matched_text"]), b"k"))).cast("int")
    r = r.select("doc_id", "content", "findings", F.col("redacted.redactions").alias("r"))
    return r.select("doc_id", redact.map_position(F.col("r"), F.length("content")).cast("int").alias("end_at"), ok(lambda x: x).alias("verified"), ok(lambda x: F.concat(x, F.lit("x"))).alias("wrong"))


@query("protect_columns", "SELECT c_custkey, '[EMAIL]' AS mail, regexp_replace(c_name, '[0-9]{9}', '[PHONE]') AS name FROM customer")
def _cells(spark, d):
    """Nine digits with a leading zero are a phone number to the default policy."""
    t = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("mail"), F.col("c_name").alias("name"))
    return protect.protect_columns(t, ["mail", "name"])


# Policies.

_SALT, _KEY = b"0123456789abcdef", bytes(range(1, 33))
_VALUE = "'u' || c_custkey || '@example.org'"


def _acted(spark, d, action: str, style: str | None = None, key_ref: str | None = None):
    p = policy.Policy(name="p", detection=(policy.DetectionRule(("email",)),), protection=(policy.ProtectionRule(("email",), action, style, key_ref=key_ref), policy.ProtectionRule((), "redact")))
    t = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("to u"), F.col("c_custkey").cast("string"), F.lit("@example.org, ok")).alias("content"))
    return policy.execute(with_findings(t, Registry().only(["email"])), p, salt=_SALT).select("c_custkey", F.col("protected.text").alias("text"), F.col("protected.actions")[0]["action"].alias("action"))


_ACTIONS = {
    "redact": "'[REDACTED]'", "mask": f"'u' || repeat('*', length({_VALUE}) - 5) || right({_VALUE}, 4)", "hash": f"sha256('{_SALT.decode()}' || {_VALUE})",
    "tokenize": f"'tok_' || substr({hmac_sql(_VALUE, _SALT)}, 1, 32)",
}
_HEX = f"sha256(chr(31) || 'name' || chr(31) || {_VALUE})"
_PICK = lambda i, names: f"[{', '.join(map(repr, names))}][CAST(('0x' || substr({_HEX}, {8 * i + 1}, 7))::BIGINT % {len(names)} + 1 AS BIGINT)]"
_ACTIONS["pseudonymize"] = f"{_PICK(0, pseudonym.FIRST['en'])} || ' ' || {_PICK(1, pseudonym.LAST['en'])}"

for _action, _sql in _ACTIONS.items():

    @query(f"policy_{_action}", f"SELECT c_custkey, 'to ' || {_sql} || ', ok' AS text, '{_action}' AS action FROM customer")
    def _by_action(spark, d, action=_action):
        return _acted(spark, d, action)


@query("policy_encrypt", f"SELECT c_custkey, {_VALUE} AS back, CAST(28 + length({_VALUE}) AS INTEGER) AS n, 'encrypt' AS action FROM customer")
def _encrypt(spark, d):
    """Under the key that a reference to the environment names."""
    import base64

    os.environ["QUILLGUARD_QUERY_KEY"] = base64.b64encode(_KEY).decode()
    t = _acted(spark, d, "encrypt", key_ref="env://QUILLGUARD_QUERY_KEY").withColumn("x", F.regexp_extract("text", "^to (.*), ok$", 1))
    return t.select("c_custkey", crypto.decrypt(F.col("x"), _KEY).alias("back"), F.length(F.unbase64("x")).alias("n"), "action")


@query("policy_consistency", "SELECT o_custkey AS customer, count(*) AS n, 1 AS tokens FROM orders GROUP BY o_custkey")
def _consistent(spark, d):
    """Equal values get equal replacements, wherever they stand."""
    p = policy.Policy(name="p", protection=(policy.ProtectionRule(("email",), "tokenize", consistent=True),))
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@example.org")).alias("content"))
    done = policy.execute(with_findings(t, Registry().only(["email"])), p, salt=_SALT)
    return done.groupBy("customer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("protected.text").cast("int").alias("tokens"))


_YAML = """
version: "1.0"
name: two
locale: de-at
detection:
  - types: [EMAIL]
    confidence_threshold: 0.5
  - types: [credit_card]
    confidence_threshold: 0.9
  - types: [iban]
    enabled: false
protection:
  - types: [email]
    action: redact
    style: other
  - types: [credit_card]
    action: mask
"""


@query("policy_yaml", f"SELECT category, count(*) AS n FROM (SELECT * FROM ({MAIL_SQL}) WHERE validation = 'valid' UNION ALL SELECT * FROM ({CARD_SQL}) WHERE validation = 'valid') GROUP BY category")
def _yaml(spark, d):
    """An invalid value has 0.3 of its detector's confidence, below both thresholds; a rule that is off admits nothing."""
    p = policy.parse_policy(_YAML)
    if not policy.validate_policy(p).valid:
        raise ValueError("the policy isn't valid")
    found = with_findings(documents(spark, d), Registry().for_categories(p.categories))
    return found.select(F.explode(policy.filter_findings(F.col("findings"), p)).alias("f")).groupBy("f.category").agg(F.count(F.lit(1)).alias("n"))


@query("policy_redaction_styles", f"SELECT doc_id, regexp_replace(text, '{MAIL}', '[other]', 'g') AS redacted FROM documents")
def _styles(spark, d):
    c = policy.redaction_config(policy.parse_policy(_YAML))
    return redact.redact(with_findings(documents(spark, d), Registry().only(["email"])), c).select("doc_id", F.col("redacted.text").alias("redacted"))


# Vaults.


def _vaulted(spark, d, v: vault.Vault):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("value"))
    t = vault.tokenize(c, "value", v, "hex32", "t_")
    again = vault.tokenize(c.select("value").distinct(), "value", v, "hex32", "t_").withColumnRenamed("token", "second")
    return t.join(again, "value").select("c_custkey", "token", (F.col("token") == F.col("second")).alias("consistent"), F.col("token").rlike("^t_[0-9a-f]{32}$").alias("formed"))


_BACK = "SELECT c_custkey, c_name AS back, true AS consistent, true AS formed FROM customer"


@query("vault_file", _BACK)
def _file_vault(spark, d):
    v = vault.FileVault(spark, storage.scratch(spark), allow_plaintext=True)
    return vault.detokenize(_vaulted(spark, d, v), "token", v, into="back").select("c_custkey", "back", "consistent", "formed")


@query("vault_encrypted_rotated", "SELECT c_custkey, c_name AS back, true AS consistent, true AS formed, (SELECT count(*) FROM customer) AS opened FROM customer")
def _sealed_vault(spark, d):
    """Tokens are made under one key, which is rotated; a vault opened with the new key gives the originals. Rows hold no plain original."""
    path, old, new = storage.scratch(spark), crypto.generate_key(), crypto.generate_key()
    v = vault.EncryptedVault(spark, path, old)
    t = storage.settled(_vaulted(spark, d, v))
    v.rotate_key(new)
    names = table(spark, d, "customer").select(F.col("c_name").alias("original"))
    sealed = vault.EncryptedVault(spark, path, new)._raw().join(names, "original", "left_anti").count()
    return vault.detokenize(t, "token", vault.EncryptedVault(spark, path, new), into="back").select("c_custkey", "back", "consistent", "formed", F.lit(sealed).cast("long").alias("opened"))


@query("vault_delete", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS back FROM customer")
def _deleted(spark, d):
    v = vault.FileVault(spark, storage.scratch(spark), allow_plaintext=True)
    t = vault.tokenize(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("value")), "value", v)
    v.delete(t.where("c_custkey % 5 = 0").select("token"))
    return vault.detokenize(t, "token", v, into="back").select("c_custkey", "back")


@query("vault_lookup", "SELECT c_name AS original, 1 AS found FROM customer WHERE c_custkey % 2 = 0")
def _lookups(spark, d):
    """By token, and by original."""
    v = vault.Vault(spark)
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("original"))
    t = vault.tokenize(c, "original", v).where("c_custkey % 2 = 0")
    both = v.lookup(t.select("token")).select("original", "token").intersect(v.find_by_original(t.select("original")).select("original", "token"))
    return both.groupBy("original").agg(F.count(F.lit(1)).cast("int").alias("found"))


# Context rules.

_RULES = r"""
version: "1.0"
language: en
rules:
  - {pattern: '(?i)\bticket\b', action: suppress, weight: 0.5, category: phone}
  - {pattern: '(?i)\bcall\b', action: boost, weight: 0.2}
  - {pattern: '(?i)\bcitizen\b', action: boost, weight: 0.2, category: ssn}
"""


@query("context_rules_yaml", "SELECT o_orderkey AS k, round(CAST(CASE o_orderkey % 4 WHEN 0 THEN CAST(0.72 AS FLOAT) * CAST(0.5 AS FLOAT) WHEN 1 THEN CAST(0.72 AS FLOAT) + CAST(0.2 AS FLOAT) ELSE CAST(0.72 AS FLOAT) END AS DOUBLE), 4) AS confidence FROM orders")
def _rules(spark, d):
    """Scoped: a marker counts within its window and for its category; one that names another category or is far away doesn't."""
    marks = ("ticket ", "call ", "citizen ", "ticket" + " " * 250)
    text = F.concat(F.coalesce(*[F.when(F.col("o_orderkey") % 4 == i, F.lit(x)) for i, x in enumerate(marks)]), F.lit("+49 89 "), _k(8, 7919))
    found = with_findings(built(spark, d, text), Registry().only(["phone"]))
    return context.analyze(found, context.parse_rules(_RULES), scoped=True).select("k", F.round(F.col("findings")[0]["confidence"].cast("double"), 4).alias("confidence"))


@query("context_unsafe_rules", "SELECT o_orderkey AS k, CAST(0 AS INTEGER) AS markers FROM orders")
def _unsafe(spark, d):
    """Rules with nested or trailing quantifiers in groups, too long ones and broken ones are left out."""
    rules = [context.Rule(p) for p in ("(a+)+", r"(\w+)", "(?:a*)*", "[", "a" * 1001)]
    return built(spark, d, F.concat(F.lit("aaaa"), _k(8, 7919))).select("k", F.size(context.markers(F.col("content"), rules)).cast("int").alias("markers"))


# Dictionaries.

_LIST = "# own\nAnna\t0.9\nAnnabella\t0.6\nbo\t0.4\n"


def _registry() -> dictionary.DictionaryRegistry:
    return dictionary.DictionaryRegistry(dictionary.load_dictionary(_LIST, "own", "first_name", "de"))


@query("dictionary_substrings", "SELECT o_orderkey AS k, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['Anna'] WHEN 1 THEN ['ANNA', 'anna'] ELSE [] END) AS matched_text, unnest(CASE o_orderkey % 3 WHEN 0 THEN [2] WHEN 1 THEN [0, 4] ELSE [] END) AS start FROM orders")
def _inside(spark, d):
    """Boundaries off: terms in words, the surest of those with one start; what isn't sure enough hides nothing."""
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("xxAnnabella"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.lit("ANNAannax")).otherwise(F.lit("bobo"))
    c = dictionary.Config(("first_name",), require_word_boundaries=False)
    return dictionary.detect_names(built(spark, d, text), _registry(), c).select("k", "matched_text", "start")


@query("dictionary_boundaries", "SELECT o_orderkey AS k, 'Anna' AS matched_text, CAST(0 AS INTEGER) AS start, round(CAST(CAST(0.9 * 1.05 AS FLOAT) AS DOUBLE), 4) AS confidence FROM orders WHERE o_orderkey % 2 = 0")
def _whole(spark, d):
    """A name in a longer word is none."""
    text = F.when(F.col("o_orderkey") % 2 == 0, "Anna, (x)").otherwise("xAnnay Annaxyzxyz")
    return rounded(dictionary.detect_names(built(spark, d, text), _registry(), dictionary.Config(("first_name",)).without_fuzzy())).select("k", "matched_text", "start", "confidence")


# Audit.


def _log(spark, d):
    o = table(spark, d, "orders").select(
        (F.col("o_orderkey") + 1).alias("seq"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(F.col("o_orderkey") % 2 == 0, "scan").otherwise("protect").alias("operation"), F.concat(F.lit("/in/"), (F.col("o_custkey") % 10).cast("string")).alias("i"), F.concat(F.lit("/out/"), (F.col("o_custkey") % 7).cast("string")).alias("o"),
    )
    return o.withColumn("parameters", F.struct(F.col("i").alias("input"), F.col("o").alias("output"))).drop("i", "o")


@query("audit_filter", "SELECT o_orderkey + 1 AS seq FROM orders WHERE o_orderkey % 2 = 0 AND strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') BETWEEN '1997-01-01' AND '1999-12-31' AND (o_custkey % 10 = 3 OR o_custkey % 7 = 4)")
def _filtered(spark, d):
    return audit.Filter(("scan",), "1997-01-01", "1999-12-31", ("/in/3", "/out/4")).on(_log(spark, d)).select("seq")


@query("audit_tampered_order", "SELECT CAST(o_orderkey + 1 AS BIGINT) AS seq, 'link' AS problem FROM orders WHERE (o_orderkey + 1) % 1000 = 1 AND o_orderkey > 0")
def _cut(spark, d):
    """Entries taken out of the chain (each thousandth) are found by the link of the next."""
    log = audit.chain(_log(spark, d).withColumn("outcome", F.struct(F.lit(True).alias("success"))), b"key")
    return audit.verify_chain(log.where("seq % 1000 != 0"), b"key").select("seq", "problem")


@query("findings_summary", f"SELECT category, count(*) AS n FROM ({MAIL_SQL} UNION ALL {CARD_SQL}) GROUP BY category UNION ALL SELECT 'total', count(*) FROM ({MAIL_SQL} UNION ALL {CARD_SQL})")
def _sums(spark, d):
    s = audit.summary(detect(documents(spark, d), Registry().only(["email", "credit_card"])))
    return spark.createDataFrame([*s["by_category"].items(), ("total", s["total"])], "category string, n long")


@query("dictionary_presets", "SELECT o_orderkey AS k, 'names' AS preset, 'Anna' AS matched_text FROM orders UNION ALL SELECT o_orderkey, 'places', 'Berlin' FROM orders UNION ALL SELECT o_orderkey, 'all', unnest(['Anna', 'Berlin']) FROM orders")
def _presets(spark, d):
    """What each preset of categories looks for; a dictionary that is taken out of the registry isn't looked into."""
    text, c = built(spark, d, F.lit("Anna xqz Berlin Wien")), dictionary.Config
    registry = dictionary.builtin_registry()
    registry.unload("cities_at")
    out = [dictionary.detect_names(text, registry, p.without_fuzzy()).select("k", F.lit(n).alias("preset"), "matched_text") for n, p in (("names", c.names_only()), ("places", c.locations_only()), ("all", c.all_categories()))]
    return out[0].unionByName(out[1]).unionByName(out[2])
