"""Registered queries and, where SQL can express them, the same in SQL.

Detectors of formats that the documents don't hold run over strings built from keys, on both sides alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions import validators as V
from ..operators import address, audit, context, dictionary, discovery, policy, protect, pseudonym, redact, tables, vault
from ..operators.detectors import Registry, detect, with_findings
from ..sources import files, formats
from ..streaming import scan as stream

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: A table below this size can be one row group, which one task would read.
SPREAD_BYTES = 256 << 20


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Small tables are dealt out to all cores; larger ones have row groups enough, and aren't shuffled."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("content"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.round(F.col("confidence").cast("double"), 4))


# SQL that several oracles share.

#: Letters outside ASCII as word characters, which RE2's \b doesn't know.
MASKED = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"


def found_sql(pattern: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """key, start, end, matched_text of all matches."""
    return f"""(SELECT {key}, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS s, ms[i] AS matched_text
  FROM (SELECT {key}, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gs FROM {source})))"""


def digit_sql(x: str, i: str) -> str:
    return f"TRY_CAST(substr({x}, CAST({i} AS BIGINT), 1) AS INTEGER)"


def luhn_sql(x: str) -> str:
    d = digit_sql(x, "i")
    return f"(list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN (length({x}) - i) % 2 = 1 THEN (CASE WHEN {d} > 4 THEN {d} * 2 - 9 ELSE {d} * 2 END) ELSE {d} END)) % 10 = 0)"


def iso_sql(x: str, n: int) -> str:
    step = "CASE WHEN (c + p) % 10 = 0 THEN 20 % 11 ELSE (((c + p) % 10) * 2) % 11 END"
    return f"((11 - list_reduce(list_transform(range(1, {n}), lambda i: {digit_sql(x, 'i')}), lambda p, c: {step}, 10)) % 10 = {digit_sql(x, str(n))})"


def weights_sql(x: str, weights) -> str:
    return " + ".join(f"{w} * {digit_sql(x, str(i))}" for i, w in enumerate(weights, 1))


def conf_sql(base: float, v: str = "validation") -> str:
    return f"round(CAST(CAST({base} AS FLOAT) * CASE {v} WHEN 'valid' THEN CAST(1 AS FLOAT) WHEN 'invalid' THEN CAST(0.3 AS FLOAT) ELSE CAST(0.8 AS FLOAT) END AS DOUBLE), 4)"


def _blob(b: bytes) -> str:
    return f"from_hex('{b.hex()}')"


def hmac_sql(x: str, key: bytes) -> str:
    inner, outer = (bytes(c ^ p for c in key.ljust(64, b"\0")) for p in (0x36, 0x5C))
    return f"sha256({_blob(outer)} || from_hex(sha256({_blob(inner)} || encode({x}))))"


CARD = r"\b(?:\d[-\s]?){13,19}\b"
MAIL = r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IBAN = r"(?i)\b[A-Z]{2}\s?\d{2}\s?(?:[0-9A-Z]\s?){11,30}\b"
MAIL_SQL = f"SELECT doc_id, 'email' AS category, s, matched_text, CASE WHEN split_part(matched_text, '@', 2) LIKE '%.%' AND split_part(matched_text, '@', 2) NOT LIKE '.%' AND split_part(matched_text, '@', 2) NOT LIKE '%.' THEN 'valid' ELSE 'invalid' END AS validation FROM {found_sql(MAIL)}"
CARD_SQL = f"SELECT doc_id, 'credit_card' AS category, s, matched_text, CASE WHEN {luhn_sql('d')} THEN 'valid' ELSE 'invalid' END AS validation FROM (SELECT *, regexp_replace(matched_text, '[^0-9]', '', 'g') AS d FROM {found_sql(CARD, text=MASKED)}) WHERE length(d) BETWEEN 13 AND 19"


def _iban_sql(x: str) -> str:
    """mod 97 of the number in two parts, as it can be too long for one."""
    digits = f"list_reduce(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN substr({x}, CAST(i AS BIGINT), 1) >= 'A' THEN ascii(substr({x}, CAST(i AS BIGINT), 1)) - 55 ELSE ascii(substr({x}, CAST(i AS BIGINT), 1)) - 48 END), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0)"
    return f"({digits} = 1)"


IBAN_SQL = f"SELECT doc_id, 'iban' AS category, s, matched_text, CASE WHEN length(v) BETWEEN 15 AND 34 AND {_iban_sql('w')} THEN 'valid' ELSE 'invalid' END AS validation FROM (SELECT *, substr(v, 5) || substr(v, 1, 4) AS w FROM (SELECT *, upper(regexp_replace(matched_text, '[^0-9A-Za-z]', '', 'g')) AS v FROM {found_sql(IBAN, text=MASKED)}))"
_END = "s AS start, s + length(matched_text) AS \"end\""


def detector_query(name: str, sql: str, base: float) -> None:
    @query(f"detect_{name}", f"SELECT doc_id, category, {_END}, matched_text, validation, {conf_sql(base)} AS confidence FROM ({sql})")
    def run(spark, d):
        return rounded(detect(documents(spark, d), Registry().only([name])).select("doc_id", "category", "start", "end", "matched_text", "validation", "confidence"))


detector_query("email", MAIL_SQL, 1.0)
detector_query("credit_card", CARD_SQL, 1.0)
detector_query("iban", IBAN_SQL, 1.0)


# Detectors over strings built from keys.


def built(spark: SparkSession, d: str, made: Column) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), made.alias("content"))


def _k(n: int, mul: int, add: int = 0) -> Column:
    """n digits from the key."""
    return F.lpad(((F.col("o_orderkey") * mul + add) % 10**n).cast("string"), n, "0")


def _k_sql(n: int, mul: int, add: int = 0) -> str:
    return f"lpad(CAST((o_orderkey * {mul} + {add}) % {10**n} AS VARCHAR), {n}, '0')"


def built_query(name: str, made: Column, made_sql: str, base: float, verdict_sql: str, text_sql: str = "x", start: int = 0) -> None:
    """One match a row, at a known place. verdict_sql: of x, the built string."""
    v = f"(SELECT o_orderkey AS k, {made_sql} AS x FROM orders)"
    sql = f"SELECT k, '{name}' AS category, CAST({start} AS INTEGER) AS start, CAST({start} + length({text_sql}) AS INTEGER) AS \"end\", {text_sql} AS matched_text, validation, {conf_sql(base)} AS confidence FROM (SELECT *, {verdict_sql} AS validation FROM {v})"

    @query(f"detect_{name}", sql)
    def run(spark, d):
        return rounded(detect(built(spark, d, made()), Registry().only([name])).select("k", "category", "start", "end", "matched_text", "validation", "confidence"))


def _either(test: str) -> str:
    return f"CASE WHEN {test} THEN 'valid' ELSE 'invalid' END"


built_query("phone", lambda: F.concat(F.lit("+49 89 "), _k(8, 7919)), f"'+49 89 ' || {_k_sql(8, 7919)}", 0.9, "'unvalidated'")
built_query(
    "ssn", lambda: F.concat_ws("-", _k(3, 31), _k(2, 7), _k(4, 13)), f"{_k_sql(3, 31)} || '-' || {_k_sql(2, 7)} || '-' || {_k_sql(4, 13)}", 0.95,
    _either("substr(x, 1, 3) NOT IN ('000', '666') AND substr(x, 1, 1) <> '9' AND substr(x, 5, 2) <> '00' AND substr(x, 8, 4) <> '0000'"),
)
built_query("passport", lambda: F.concat(F.lit("C"), _k(8, 7919)), f"'C' || {_k_sql(8, 7919)}", 0.85, "'valid'")
built_query("drivers_license", lambda: F.concat(F.lit("B"), _k(11, 7919)), f"'B' || {_k_sql(11, 7919)}", 0.8, "'valid'")
_DIST = " + ".join(f"CASE WHEN length(h) - length(replace(h, '{i}', '')) = {{n}} THEN 1 ELSE 0 END" for i in range(10))
_TAX = "(SELECT ({t} = 0) AND (({a} = 1 AND {b} = 0) OR ({a} = 0 AND {b} = 1)) FROM (SELECT substr(x, 1, 10) AS h))".format(
    a=f"({_DIST.format(n=2)})", b=f"({_DIST.format(n=3)})", t=" + ".join(f"CASE WHEN length(h) - length(replace(h, '{i}', '')) > 3 THEN 1 ELSE 0 END" for i in range(10)).join("()")
)
built_query("tax_id_de", lambda: F.concat(F.lit("8"), _k(10, 613651)), f"'8' || {_k_sql(10, 613651)}", 0.95, _either(f"{_TAX} AND {iso_sql('x', 11)}"))
built_query(
    "ahv_ch", lambda: F.concat_ws(".", F.lit("756"), _k(4, 31), _k(4, 17), _k(2, 7)), f"'756.' || {_k_sql(4, 31)} || '.' || {_k_sql(4, 17)} || '.' || {_k_sql(2, 7)}", 0.95,
    "(SELECT " + _either(f"(10 - ({weights_sql('d', [1, 3] * 6)}) % 10) % 10 = {digit_sql('d', '13')}") + " FROM (SELECT replace(x, '.', '') AS d))",
)
built_query(
    "national_id_de", lambda: F.concat(F.lit("L"), _k(9, 7919)), f"'L' || {_k_sql(9, 7919)}", 0.9,
    _either("(147 + " + " + ".join(f"{(7, 3, 1)[i % 3]} * {digit_sql('x', str(i + 1))}" for i in range(1, 9)) + f") % 10 = {digit_sql('x', '10')}"),
)
built_query(
    "vat_number", lambda: F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("DE"), _k(9, 7919))).otherwise(F.concat(F.lit("ATU"), _k(8, 7919)))),
    f"CASE WHEN o_orderkey % 2 = 0 THEN 'DE' || {_k_sql(9, 7919)} ELSE 'ATU' || {_k_sql(8, 7919)} END", 0.95,
    "CASE WHEN x LIKE 'DE%' THEN (SELECT " + _either(iso_sql("d", 9)) + " FROM (SELECT substr(x, 3) AS d)) ELSE (SELECT "
    + _either("(10 - (4 + " + " + ".join(f"(CASE WHEN {w} * {digit_sql('d', str(i))} > 9 THEN {w} * {digit_sql('d', str(i))} - 9 ELSE {w} * {digit_sql('d', str(i))} END)" for i, w in enumerate((1, 2, 1, 2, 1, 2, 1), 1)) + f") % 10) % 10 = {digit_sql('d', '8')}") + " FROM (SELECT CASE WHEN x LIKE 'ATU%' THEN substr(x, 4) ELSE '00000000' END AS d)) END",
)


@query("detect_nine_digits", "SELECT c_custkey, unnest(['drivers_license', 'passport']) AS category, substr(c_name, -9) AS matched_text FROM customer")
def _nine(spark, d):
    """Nine digits are a passport and a licence."""
    return detect(table(spark, d, "customer").select("c_custkey", F.substring("c_name", -9, 9).alias("content")), Registry().only(["passport", "drivers_license"])).select("c_custkey", "category", "matched_text")


@query("detect_all")
def _all(spark, d):
    return rounded(detect(documents(spark, d)))


_THREE = ("email", "credit_card", "iban")
_FOUND = f"({MAIL_SQL} UNION ALL {CARD_SQL} UNION ALL {IBAN_SQL})"


@query("inventory_by_language", f"SELECT lang, category, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM {_FOUND} JOIN documents USING (doc_id) WHERE validation = 'valid' GROUP BY lang, category")
def _inventory(spark, d):
    """Valid values by language and category: the default policy's filter pushed into the arrays, then one aggregate."""
    found = with_findings(documents(spark, d), Registry().only(_THREE)).withColumn("findings", policy.filter_findings(F.col("findings"), policy.default_policy()))
    rows = found.select("doc_id", "lang", F.explode_outer("findings").alias("f")).where(F.col("f").isNotNull())
    per = rows.groupBy("lang", F.col("f.category").alias("category"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("lang", "category").agg(F.sum("n").cast("long").alias("findings"), F.count(F.lit(1)).alias("documents"))


@query("inventory_rollup", f"SELECT lang, category, count(*) AS findings FROM {_FOUND} JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, category)")
def _rollup(spark, d):
    return discovery.rollup(detect(documents(spark, d), Registry().only(_THREE)), "lang", "category")


@query("categories_of_document", f"SELECT doc_id, string_agg(category, ',' ORDER BY s, category) AS categories FROM (SELECT doc_id, category, min(s) AS s FROM {_FOUND} GROUP BY doc_id, category) GROUP BY doc_id")
def _categories(spark, d):
    found = with_findings(documents(spark, d), Registry().only(_THREE)).where(F.size("findings") > 0)
    return found.select("doc_id", F.concat_ws(",", discovery.categories_of(F.col("findings"))).alias("categories"))


@query("findings_with_labels", f"SELECT quality, toxic, category, count(*) AS n FROM {_FOUND} JOIN labels USING (doc_id) GROUP BY quality, toxic, category")
def _labels(spark, d):
    return detect(documents(spark, d), Registry().only(_THREE)).join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic", "category").agg(F.count(F.lit(1)).alias("n"))


@query("policy_default_filter", f"SELECT category, validation, count(*) AS n FROM {_FOUND} WHERE validation = 'valid' GROUP BY category, validation")
def _default_policy(spark, d):
    found = with_findings(documents(spark, d), Registry().only(_THREE))
    kept = found.select(F.explode(policy.filter_findings(F.col("findings"), policy.default_policy())).alias("f"))
    return kept.groupBy("f.category", "f.validation").agg(F.count(F.lit(1)).alias("n"))


@query("policy_threshold_drops_phones", "SELECT o_orderkey AS k, 0 AS n_08, 1 AS n_07 FROM orders")
def _threshold(spark, d):
    """An unvalidated phone is 0.72: in at 0.7, out at 0.8."""
    found = with_findings(built(spark, d, F.concat(F.lit("+49 89 "), _k(8, 7919))), Registry().only(["phone"]))
    n = lambda t: F.size(policy.filter_findings(F.col("findings"), policy.Policy(name="t", detection=(policy.DetectionRule(("phone",), t),)))).cast("int")
    return found.select("k", n(0.8).alias("n_08"), n(0.7).alias("n_07"))


# Redaction.


@query("redact_label", f"SELECT doc_id, regexp_replace(text, '{MAIL}', '[EMAIL]', 'g') AS redacted FROM documents")
def _label(spark, d):
    found = with_findings(documents(spark, d), Registry().only(["email"]))
    return redact.redact(found).select("doc_id", F.col("redacted.text").alias("redacted"))


@query("redact_bar", "SELECT o_orderkey AS k, 'SSN: ' || repeat('█', 11) || '.' AS redacted FROM orders")
def _bar(spark, d):
    found = with_findings(built(spark, d, F.concat(F.lit("SSN: "), F.concat_ws("-", _k(3, 31), _k(2, 7), _k(4, 13)), F.lit("."))), Registry().only(["ssn"]))
    return redact.redact(found, redact.Redaction(redact.Style("bar"))).select("k", F.col("redacted.text").alias("redacted"))


@query("redact_mask", f"SELECT o_orderkey AS k, substr('4' || {_k_sql(15, 7919)}, 1, 1) || repeat('*', 11) || substr({_k_sql(15, 7919)}, -4) AS redacted FROM orders")
def _mask(spark, d):
    found = with_findings(built(spark, d, F.concat(F.lit("4"), _k(15, 7919))), Registry().only(["credit_card"]))
    return redact.redact(found, redact.Redaction(redact.Style("mask"))).select("k", F.col("redacted.text").alias("redacted"))


@query("redact_by_category", "SELECT o_orderkey AS k, 'mail [EMAIL] card <card>' AS redacted FROM orders")
def _by_category(spark, d):
    text = F.concat(F.lit("mail a"), F.col("o_orderkey").cast("string"), F.lit("@example.org card 4"), _k(15, 7919))
    found = with_findings(built(spark, d, text), Registry().only(["email", "credit_card"]))
    return redact.redact(found, redact.Redaction().with_style("credit_card", redact.Style("custom", "<card>"))).select("k", F.col("redacted.text").alias("redacted"))


@query("redact_records", f"SELECT doc_id, category, s AS orig_start, s + length(matched_text) AS orig_end, '[' || upper(category) || ']' AS replacement, 'sha256:' || sha256(matched_text) AS original_hash, strlen(matched_text) AS original_length FROM ({MAIL_SQL})")
def _records(spark, d):
    found = with_findings(documents(spark, d), Registry().only(["email"]))
    r = redact.redact(found).select("doc_id", F.explode_outer("redacted.redactions").alias("r")).where(F.col("r").isNotNull())
    return r.select("doc_id", "r.category", "r.orig_start", "r.orig_end", "r.replacement", "r.original_hash", F.col("r.original_length").cast("long").alias("original_length"))


@query("redact_restores", "SELECT doc_id, md5(text) AS digest FROM documents")
def _restores(spark, d):
    """The redactions undone give the text."""
    found = with_findings(documents(spark, d), Registry().only(_THREE))
    r = redact.redact(found)
    kind = found.schema["findings"].dataType.simpleString()
    originals = F.transform(redact.resolve(F.col("findings"), kind), lambda f: f["matched_text"])
    return r.select("doc_id", F.md5(redact.restore(F.col("redacted.text"), F.col("redacted.redactions"), originals).cast("binary")).alias("digest"))


@query("redact_leaves_none", "SELECT doc_id, 0 AS left_over FROM documents")
def _leaves_none(spark, d):
    """Redacted text has no e-mail address."""
    p = protect.protect_text(documents(spark, d), policy=policy.Policy(name="e", detection=(policy.DetectionRule(("email",)),)))
    return with_findings(p.select("doc_id", F.col("protected").alias("content")), Registry().only(["email"])).select("doc_id", F.size("findings").cast("int").alias("left_over"))


@query("policy_execute_custom", f"SELECT doc_id, regexp_replace(text, '{MAIL}', '[MASKED]', 'g') AS protected FROM documents")
def _execute(spark, d):
    p = policy.Policy(name="m", detection=(policy.DetectionRule(("email",)),), protection=(policy.ProtectionRule(("email",), "redact", "masked"),))
    found = with_findings(documents(spark, d), Registry().only(["email"]))
    return policy.execute(found, p).select("doc_id", F.col("protected.text").alias("protected"))


# Crypto, tokens, pseudonyms.

_SALT, _KEY = b"0123456789abcdef", bytes(range(32))


@query("hash_sha256_salted", f"SELECT c_custkey, sha256('{_SALT.decode()}' || c_name) AS h FROM customer")
def _hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", crypto.digest(F.col("c_name"), salt=_SALT).alias("h"))


@query("hmac_verified", f"SELECT c_custkey, {hmac_sql('c_name', _SALT)} AS h, true AS ok FROM customer")
def _hmac(spark, d):
    """A keyed hash holds for its value only."""
    h = crypto.keyed_hash(F.col("c_name"), _SALT)
    return table(spark, d, "customer").select("c_custkey", h.alias("h"), (crypto.verify_hash(F.col("c_name"), h, _SALT, keyed=True) & ~crypto.verify_hash(F.concat("c_name", F.lit("x")), h, _SALT, keyed=True)).alias("ok"))


@query("encrypt_decrypt", "SELECT c_custkey, c_name AS back, CAST(12 + strlen(c_name) + 16 AS INTEGER) AS n FROM customer")
def _encrypt(spark, d):
    e = table(spark, d, "customer").withColumn("e", crypto.encrypt(F.col("c_name"), _KEY))
    return e.select("c_custkey", crypto.decrypt(F.col("e"), _KEY).alias("back"), F.length(F.unbase64("e")).alias("n"))


@query("encode_hex_base64", "SELECT c_custkey, lower(hex(c_name)) AS h, to_base64(CAST(c_name AS BLOB)) AS b FROM customer")
def _encode(spark, d):
    raw = F.col("c_name").cast("binary")
    return table(spark, d, "customer").select("c_custkey", crypto.encode(raw).alias("h"), crypto.encode(raw, "base64").alias("b"))


@query("tokenize_detokenize", "SELECT o_orderkey AS k, o_custkey AS back, true AS consistent FROM orders")
def _tokens(spark, d):
    v = vault.Vault(spark)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("value"))
    t = vault.detokenize(vault.tokenize(o, "value", v), "token", v, into="back")
    n = t.groupBy("value").agg(F.count_distinct("token").alias("n"))
    return t.join(n, "value").select("k", F.col("back").cast("long").alias("back"), (F.col("n") == 1).alias("consistent"))


@query("pseudonym_iban_valid", "SELECT c_custkey, true AS ok FROM customer")
def _pseudonym(spark, d):
    """Seeded pseudonyms are the same again, others with another seed, and keep the checks of their kind."""
    p = lambda s: pseudonym.pseudonym(F.col("c_name"), "iban", "de-de", s)
    return table(spark, d, "customer").select("c_custkey", (V.iban(p(1)) & (p(1) == p(1)) & (p(1) != p(2))).alias("ok"))


@query("validate_luhn", f"SELECT o_orderkey AS k, {luhn_sql('x')} AS ok FROM (SELECT o_orderkey, {_k_sql(16, 7919)} AS x FROM orders)")
def _luhn(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), V.luhn(_k(16, 7919)).alias("ok"))


@query("validate_iban", f"SELECT o_orderkey AS k, {_iban_sql('w')} AS ok FROM (SELECT o_orderkey, {_k_sql(16, 7919)} || 'DE' || {_k_sql(2, 7)} AS w FROM orders)")
def _viban(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), V.iban(F.concat(F.lit("DE"), _k(2, 7), _k(16, 7919))).alias("ok"))


# Context, tables, addresses, dictionaries.


@query("context_boost", "SELECT o_orderkey AS k, round(CAST(least(1, CAST(0.72 AS FLOAT) + CAST(0.4 AS FLOAT)) AS DOUBLE), 4) AS boosted, round(CAST(CAST(0.9 AS FLOAT) * CAST(0.8 AS FLOAT) * (CAST(1 AS FLOAT) - CAST(0.8 AS FLOAT)) AS DOUBLE), 4) AS suppressed FROM orders")
def _context(spark, d):
    def conf(prefix):
        found = with_findings(built(spark, d, F.concat(F.lit(prefix), F.lit("+49 89 "), _k(8, 7919))), Registry().only(["phone"]))
        return context.analyze(found, context.builtin_rules("en")).select("k", F.round(F.col("findings")[0]["confidence"].cast("double"), 4).alias("c"))

    return conf("phone: ").withColumnRenamed("c", "boosted").join(conf("ISBN ").withColumnRenamed("c", "suppressed"), "k")


@query("context_markers", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)(?:wohnort|anschrift|adresse)\s*:\s*')) + len(regexp_extract_all(text, '(?i)(?:handy|mobil|telefon|tel)\s*:\s*')) AS INTEGER) AS n FROM documents")
def _markers(spark, d):
    rules = [r for r in context.builtin_rules("de") if "anschrift" in r.pattern or "handy" in r.pattern]
    return documents(spark, d).select("doc_id", F.size(context.markers(F.col("content"), rules, "de")).cast("int").alias("n"))


@query("table_header_boost", "SELECT c_custkey, 'PersonName' AS c0, 'email' AS c1, round(CAST(CAST(0.4 AS FLOAT) AS DOUBLE), 4) AS boost FROM customer")
def _table(spark, d):
    text = F.concat(F.lit("Name,E-Mail,Other\n"), F.col("c_name"), F.lit(",a@b.org,x"))
    t = tables.detect_table(table(spark, d, "customer").select("c_custkey", text.alias("content"), F.length("c_name").alias("n")))
    return t.select("c_custkey", F.col("table.headers")[0]["category"].alias("c0"), F.col("table.headers")[1]["category"].alias("c1"), F.round(tables.column_boost(F.col("content"), F.col("table"), F.col("n") + 20).cast("double"), 4).alias("boost"))


def part(components: str, kind: str) -> Column:
    return F.filter(components, lambda x: x["type"] == kind)[0]["text"].alias(kind)


@query("address_en", "SELECT o_orderkey AS k, CAST(o_orderkey % 9999 + 1 AS VARCHAR) || ' Main Street' AS street, 'New York' AS city, 'NY' AS state, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS postal_code, 'United States' AS country FROM orders")
def _address_en(spark, d):
    text = F.concat((F.col("o_orderkey") % 9999 + 1).cast("string"), F.lit(" Main Street\nNew York, NY "), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"), F.lit("\nUnited States"))
    a = address.detect_addresses(built(spark, d, text), "en").select("k", F.col("addresses")[0]["components"].alias("c"))
    return a.select("k", *[part("c", n) for n in ("street", "city", "state", "postal_code", "country")])


@query("address_de", "SELECT o_orderkey AS k, 'Hauptstr. ' || CAST(o_orderkey % 99 + 1 AS VARCHAR) AS street, 'Muenchen' AS city, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS postal_code, CAST(1 AS DOUBLE) AS confidence FROM orders")
def _address_de(spark, d):
    text = F.concat(F.lit("Hauptstr. "), (F.col("o_orderkey") % 99 + 1).cast("string"), F.lit("\r\n"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"), F.lit(" Muenchen\r\nGermany"))
    a = address.detect_addresses(built(spark, d, text), "de").select("k", F.col("addresses")[0].alias("a"))
    return a.select("k", *[part("a.components", n) for n in ("street", "city", "postal_code")], F.round(F.col("a.confidence").cast("double"), 4).alias("confidence"))


def _names(spark, d):
    words = ["Anna", "Annna", "Peter", "Mueller", "Zzyzx", "Berlin"]
    pick = F.element_at(F.array(*map(F.lit, words)), (F.col("o_orderkey") % len(words) + 1).cast("int"))
    return built(spark, d, F.concat(F.lit("Herr "), pick))


_DICT = ", ".join(f"('{t}', {f})" for i, c, loc, terms in dictionary.shipped() if c == "first_name" for t, f in terms)


@query("dictionary_exact", f"SELECT o_orderkey AS k, t AS term, CAST(round(least(1, f * 1.2), 4) AS DOUBLE) AS confidence FROM (SELECT o_orderkey, ['Anna', 'Annna', 'Peter', 'Mueller', 'Zzyzx', 'Berlin'][CAST(o_orderkey % 6 + 1 AS BIGINT)] AS w FROM orders) JOIN (VALUES {_DICT}) AS v(t, f) ON w = t")
def _dict_exact(spark, d):
    c = dictionary.Config(("first_name",)).without_fuzzy()
    return rounded(dictionary.detect_names(_names(spark, d), config=c)).select("k", "term", "confidence")


_GRAMS = "CASE WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, CAST(i AS BIGINT), 3))) END"
#: Exact, else similar terms among those that share a fifth of the word's trigrams, else among all.
_FUZZY = f"""WITH w AS (SELECT w, lower(w) AS k, {_GRAMS.format(x="lower(w)")} AS g FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)),
t AS (SELECT t, lower(t) AS k, {_GRAMS.format(x="lower(t)")} AS g FROM (VALUES {_DICT}) AS v(t, f)),
p AS (SELECT w, t, w.k = t.k AS same, len(list_intersect(w.g, t.g)) >= greatest(1, ceil(0.2 * len(w.g))) AS may, jaro_winkler_similarity(w.k, t.k) AS s FROM w, t),
q AS (SELECT *, max(may) OVER (PARTITION BY w) AS found, max(same) OVER (PARTITION BY w) AS exact FROM p)
SELECT w, t AS term, round(s, 6) AS similarity FROM q WHERE CASE WHEN exact THEN same ELSE s >= 0.85 AND may = found END"""


@query("dictionary_fuzzy", _FUZZY)
def _dict_fuzzy(spark, d):
    """All words of the documents that are ASCII letters."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    return dictionary.lookup(words, dictionary.builtin_registry(), dictionary.Config(("first_name",))).select(F.col("word").alias("w"), "term", F.round("similarity", 6).alias("similarity"))


@query("dictionary_names")
def _dict_documents(spark, d):
    return rounded(dictionary.detect_names(documents(spark, d), config=dictionary.Config.all_categories()))


# Sources, discovery, audit, streams.


@query("sniff_format", "SELECT page_id, 'html' AS format, 'UTF-8' AS encoding FROM pages")
def _sniff(spark, d):
    raw = F.col("html").cast("binary")
    return table(spark, d, "pages").select("page_id", formats.detect_format(raw).alias("format"), formats.encoding_of(raw).alias("encoding"))


@query("text_lines", "SELECT doc_id, CAST(i AS INTEGER) AS line, ls[i] AS content, CAST(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS INTEGER) AS char_offset FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
def _lines(spark, d):
    return files.text_lines(table(spark, d, "documents")).select("doc_id", "line", "content", "char_offset")


@query("json_strings", "SELECT event_id, '$.' || k AS path, json_extract_string(props, '$.' || k) AS content FROM events, (VALUES ('page'), ('ref'), ('k'), ('device')) AS v(k) WHERE json_extract_string(props, '$.' || k) IS NOT NULL")
def _json(spark, d):
    return files.json_strings(table(spark, d, "events"), "event_id", "props", "$.page", "$.ref", "$.k", "$.device")


@query("html_segments_scan")
def _html(spark, d):
    return rounded(detect(files.html_segments(table(spark, d, "pages"))))


@query("glob_filter", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def _glob(spark, d):
    path = F.concat(F.lit("/data/"), F.when(F.col("c_custkey") % 3 == 0, "in/a.txt").when(F.col("c_custkey") % 3 == 1, "in/b.log").otherwise("tmp/c.txt"))
    return table(spark, d, "customer").where(files.glob_filter(path, ["*.txt"], ["**/tmp/**"])).select("c_custkey")


def _scanned(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("text").alias("format"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("error_kind"), F.col("text").alias("content"))
    return with_findings(docs, Registry().only(_THREE)).drop("content")


@query("discovery_inventory", f"SELECT category, count(*) AS findings, count(DISTINCT doc_id) AS files FROM {_FOUND} GROUP BY category")
def _discovery(spark, d):
    return discovery.inventory(_scanned(spark, d))


@query("discovery_statistics", f"SELECT (SELECT count(*) FROM documents) AS files, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS bytes, count(*) AS findings, count(DISTINCT doc_id) AS files_with_findings FROM {_FOUND}")
def _statistics(spark, d):
    return discovery.statistics(_scanned(spark, d)).select("files", "bytes", "findings", "files_with_findings")


@query("audit_chain_verify", "SELECT 500 AS seq, 'checksum' AS problem")
def _audit(spark, d):
    """One changed entry of a chain over all orders is found."""
    o = audit.numbered(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), "o_orderkey")
    e = o.select("seq", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.lit("scan").alias("operation"), F.struct(F.col("o_custkey").cast("string").alias("input")).alias("parameters"), F.struct(F.lit(True).alias("success")).alias("outcome"))
    log = audit.chain(e, b"key")
    tampered = log.withColumn("id", F.when(F.col("seq") == 500, F.lit("x")).otherwise(F.col("id")))
    return audit.verify_chain(tampered, b"key").select(F.col("seq").cast("int").alias("seq"), "problem")


@query("audit_sanitize", "SELECT c_custkey, 'cannot read /home/[USER]/x for [EMAIL], [SSN]' AS m FROM customer")
def _sanitize(spark, d):
    text = F.concat(F.lit("cannot read /home/u"), F.col("c_custkey").cast("string"), F.lit("/x for u@example.org, 123-45-6789"))
    return table(spark, d, "customer").select("c_custkey", audit.sanitize(text).alias("m"))


@query("findings_per_day", "SELECT date_trunc('day', ts) AS start, count(*) AS n FROM events WHERE event_id % 7 = 0 GROUP BY 1")
def _rate(spark, d):
    """Findings by window of event time; the same plan runs on a stream with a watermark."""
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org"))).otherwise("none")
    s = stream.scan_lines(table(spark, d, "events").select("event_id", "ts", text.alias("value")), Registry().only(["email"]))
    return stream.rate_by_window(s, size="1 day").select("start", F.col("count").alias("n"))


@query("stream_equals_batch", f"SELECT category, count(*) AS n FROM ({MAIL_SQL} UNION ALL {CARD_SQL}) GROUP BY category")
def _stream(spark, d):
    """Documents read as a stream of files, counted with state to the end."""
    import uuid

    own = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    name = "t" + uuid.uuid4().hex
    q = stream.run(stream.totals(stream.scan_lines(own.select("doc_id", F.col("text").alias("value")), Registry().only(["email", "credit_card"]))), name, "complete")
    q.awaitTermination()
    return spark.table(name).select("category", F.col("count").alias("n"))


