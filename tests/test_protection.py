"""Redaction, policies, crypto, vaults, pseudonyms and the audit chain."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from quillguard.functions import crypto
from quillguard.operators import audit, policy, protect, pseudonym, redact, vault
from quillguard.operators.detectors import Registry, with_findings
from quillguard.schema import FINDING

KIND = f"array<{FINDING}>"
POLICY = """
{name: gdpr, version: "1.0", locale: de-at,
 detection: [{confidence_threshold: 0.8, types: [email, phone, iban]}],
 protection: [{action: redact, style: label, types: [email]}, {action: mask, types: [iban]}]}
"""


def resolved(findings):
    """The rule, one finding after the other."""
    kept = []
    for f in sorted(findings, key=lambda f: (f[1], -(f[2] - f[1]), -f[4], f[0])):
        over = [k for k in kept if k[1] < f[2] and f[1] < k[2]]
        if any(k[2] - k[1] >= f[2] - f[1] or k[4] > f[4] for k in over):
            continue
        kept = [k for k in kept if k not in over] + [f]
    return kept


def test_overlap_resolution(spark):
    rng = random.Random(1)
    text, rows = "abcdefghijklmnopqrstuvwxyz", []
    for i in range(200):
        fs = []
        for _ in range(rng.randrange(7)):
            s = rng.randrange(24)
            e = rng.randrange(s + 1, 27)
            fs.append((rng.choice(["email", "iban", "ssn"]), s, e, text[s:e], float(rng.choice([0.25, 0.5, 1.0])), "valid", None))
        rows.append((i, text, fs))
    df = spark.createDataFrame(rows, f"id long, content string, findings {KIND}")
    for r in redact.redact(df).collect():
        want, at, out = sorted(resolved([tuple(f) for f in r["findings"]]), key=lambda f: f[1]), 0, ""
        for f in want:
            out, at = out + text[at : f[1]] + f"[{f[0].upper()}]", f[2]
        assert r["redacted"]["text"] == out + text[at:]
        for x in r["redacted"]["redactions"]:
            assert r["redacted"]["text"][x["new_start"] : x["new_end"]] == x["replacement"]
            assert x["original_hash"] == "sha256:" + hashlib.sha256(text[x["orig_start"] : x["orig_end"]].encode()).hexdigest()


def test_styles(spark):
    df = with_findings(spark.createDataFrame([("card 4111111111111111 a@b.de",), (None,), ("",)], "content string"), Registry().only(["credit_card", "email"]))
    text = lambda c: [r["redacted"] and r["redacted"]["text"] for r in redact.redact(df, c).collect()]
    assert text(None) == ["card [CREDIT_CARD][EMAIL]", None, ""]
    assert text(redact.Redaction(redact.Style("mask", mask=redact.Mask(1, 4))))[0].startswith("card 4***")
    with pytest.raises(ValueError):
        redact.Style("x")
    short = spark.createDataFrame([("12345",), ("123456",), ("12-456789",)], "x string").select(redact.Mask().apply(F.col("x")).alias("m"), redact.Mask(preserve="-").apply(F.col("x")).alias("p")).collect()
    assert [r["m"] for r in short] == ["12345", "1*3456", "1****6789"] and short[2]["p"] == "1*-**6789"


def test_positions_and_keyed_hashes(spark):
    df = with_findings(spark.createDataFrame([("x a@b.de y",)], "content string"), Registry().only(["email"]))
    r = redact.redact(df, redact.Redaction(hmac_key=b"k"))
    got = r.select(
        *[redact.map_position(F.col("redacted.redactions"), F.lit(i)).alias(f"p{i}") for i in (0, 3, 9)],
        redact.verify_original(F.col("redacted.redactions")[0], F.lit("a@b.de"), b"k").alias("ok"), redact.verify_original(F.col("redacted.redactions")[0], F.lit("a@b.dx"), b"k").alias("no"),
    ).first()
    assert (got["p0"], got["p3"], got["p9"], got["ok"], got["no"]) == (0, 2, 10, True, False)


def test_policy(spark, monkeypatch, tmp_path):
    p = policy.parse_policy(POLICY)
    assert p.categories == ("email", "iban", "phone") and policy.validate_policy(p).valid
    df = with_findings(spark.createDataFrame([("a@b.de +43 664 1234567 DE89370400440532013000.",)], "content string"), Registry().for_categories(p.categories))
    kept = df.select(F.transform(policy.filter_findings(F.col("findings"), p), lambda f: f["category"]).alias("c")).first()["c"]
    assert kept == ["email", "iban"]  # a phone is 0.72
    out = policy.execute(df, p).first()["protected"]
    assert out["text"] == "[REDACTED] +43 664 1234567 D*****************3000." and [a["action"] for a in out["actions"]] == ["redact", "mask"]
    c = policy.redaction_config(p)
    assert c.by_category["email"].kind == "label" and c.by_category["iban"].kind == "mask"
    for bad in ("version: '2.0'\nname: x", "name: x", "version: '1.0'\nname: x\ndetection: [{confidence_threshold: 1}]"):
        with pytest.raises(ValueError):
            policy.parse_policy(bad)
    assert policy.validate_policy(policy.Policy(name="x")).warnings and policy.parse_policy("version: '1.0'\nname: x\nrules: []").admits(None) is not None
    monkeypatch.setenv("K", "A" * 43 + "=")
    assert policy.resolve_key("env://K") == bytes(32)
    (tmp_path / "k").write_bytes(b"raw key!")
    assert policy.resolve_key(f"file://{tmp_path}/k") == b"raw key!"
    with pytest.raises(ValueError):
        policy.resolve_key("http://x")


def test_protect_files(spark):
    rows = [("a.csv", "csv", "name,mail\nAnn,a@b.de\n"), ("b.json", "json", '{"m": ["c@d.ef", 1], "n": {"x": "no"}}'), ("c.txt", "text", "mail g@h.ij"), ("d.pdf", "pdf", "x")]
    got = {r["path"]: r["output"] for r in protect.protect_files(spark.createDataFrame(rows, "path string, format string, content string")).collect()}
    assert got["a.csv"] == "name,mail\nAnn,[EMAIL]\n" and '"[EMAIL]"' in got["b.json"] and got["c.txt"] == "mail [EMAIL]" and "d.pdf" not in got
    cells = protect.protect_columns(spark.createDataFrame([(1, "a@b.de")], "id long, mail string"), ["mail"]).first()
    assert cells.asDict() == {"id": 1, "mail": "[EMAIL]"}


def test_crypto(spark):
    df = spark.createDataFrame([("héllo",), ("",), (None,)], "x string")
    x, key = F.col("x"), bytes(range(32))
    r = df.select(crypto.hmac_sha256(x, b"k").alias("h"), crypto.hmac_sha512(x, b"k" * 200).alias("h5"), crypto.digest(x, "sha512", b"s", "base64").alias("d"), crypto.decrypt(crypto.encrypt(x, key, "hex"), key, "hex").alias("back"), crypto.decrypt(crypto.encrypt(x, key), bytes(32)).alias("wrong")).collect()
    assert r[0]["h"] == hmac.new(b"k", "héllo".encode(), hashlib.sha256).hexdigest() and r[0]["h5"] == hmac.new(b"k" * 200, "héllo".encode(), hashlib.sha512).hexdigest()
    assert [i["back"] for i in r] == ["héllo", "", None] and r[0]["wrong"] is None and r[2]["h"] is None
    with pytest.raises(ValueError):
        crypto.encrypt(x, b"short")
    v = df.limit(1).select(crypto.hash_value(x).alias("v")).first()["v"]
    assert df.limit(1).select(crypto.verify_hash(x, F.lit(v["value"]), bytes.fromhex(v["salt"]))).first()[0]


def test_vaults(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "x string")
    key = crypto.generate_key()
    for v in (vault.Vault(spark), vault.FileVault(spark, f"{tmp_path}/f", allow_plaintext=True), vault.EncryptedVault(spark, f"{tmp_path}/e", key)):
        t = vault.tokenize(df, "x", v, "hex16").cache()
        rows = t.collect()
        assert len({r["token"] for r in rows if r["x"] == "a"}) == 1 and len(v) == 2 and all(r["token"] is None or len(r["token"]) == 20 for r in rows)
        again = {r["x"]: r["token"] for r in vault.tokenize(df, "x", v).collect()}
        assert again == {r["x"]: r["token"] for r in rows}
        assert sorted((r["x"], r["original"]) for r in vault.detokenize(t.where("x is not null"), "token", v).collect()) == [("a", "a"), ("a", "a"), ("b", "b")]
        v.delete(t.where("x = 'b'").select("token"))
        assert len(v) == 1 and v.find_by_original(spark.createDataFrame([("a",)], "original string")).count() == 1
    new = crypto.generate_key()
    v.rotate_key(new)
    assert vault.EncryptedVault(spark, f"{tmp_path}/e", new).read().first()["original"] == "a"
    with pytest.raises(ValueError):
        vault.EncryptedVault(spark, f"{tmp_path}/e", key)
    with pytest.raises(PermissionError):
        vault.FileVault(spark, f"{tmp_path}/g")
    keys = vault.LocalKeys(f"{tmp_path}/keys.json")
    one = keys.create("k")
    assert keys.rotate("k") != one and vault.LocalKeys(f"{tmp_path}/keys.json").get("k", 1) == one and [k.active for k in keys.list()] == [False, True]
    monkeypatch.setenv("QUILLGUARD_KEY_X", "y")
    assert vault.EnvKeys().get("x") == b"y" and "x" in [k.id for k in vault.EnvKeys().list()]


def test_pseudonyms(spark):
    df = spark.createDataFrame([("Ann",), ("Bob",), (None,)], "x string")
    for kind in pseudonym.KINDS:
        rows = df.select(*[pseudonym.pseudonym(F.col("x"), kind, loc, seed).alias(n) for n, loc, seed in (("a", "en", 1), ("b", "en", 1), ("c", "en", 2), ("d", "de-at", None))]).collect()
        assert all(r["a"] == r["b"] for r in rows) and rows[2]["a"] is None and all(rows[0])


def test_audit(spark, tmp_path):
    log = audit.AuditLog(spark, str(tmp_path), key=b"k")
    for i, op in enumerate(("scan", "protect", "scan")):
        log.log(op, {"input": f"/in/{i}", "metadata": {"n": str(i)}}, {"success": True, "findings": {"total": 1, "by_category": {"email": 1}}})
    again = audit.AuditLog(spark, str(tmp_path), key=b"k")
    again.log("export")
    assert again.verify().count() == 0 and again.read().count() == 4
    assert again.query(audit.Filter(("scan",), paths=("/in/2",))).count() == 1 and again.query(audit.Filter(start="2999-01-01")).count() == 0
    assert audit.AuditLog(spark, str(tmp_path), key=b"other").verify().count() == 4
    f = next(tmp_path.glob("*.jsonl"))
    assert f.stat().st_mode & 0o777 == 0o600
    lines = f.read_text().splitlines()
    f.write_text("\n".join([lines[0], lines[2], lines[3]]) + "\n")
    assert [(r["seq"], r["problem"]) for r in audit.AuditLog(spark, str(tmp_path), key=b"k").verify().collect()] == [(3, "link")]
    secret = audit.AuditLog(spark, f"{tmp_path}/s", data_key=bytes(32))
    secret.log("scan", {"input": "/secret"})
    assert "secret" not in next((tmp_path / "s").glob("*.enc.jsonl")).read_text() and secret.read().first()["parameters"]["input"] == "/secret" and secret.verify().count() == 0
    with pytest.raises(ValueError):
        log.log("x")


def test_chain_by_ranges(spark, monkeypatch):
    """No task sorts all entries; ranges of the order give the chain of one pass."""
    import hashlib
    import hmac

    n, schema = 95, "seq long, id string, timestamp string, operation string, parameters struct<input:string>, outcome struct<success:boolean>"
    rows = [(i * 3, f"id{i}", "2024-01-01", "scan", (f"/in/é{i}",), (True,)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows[::-1], schema).repartition(5)
    for size in (10, 1000):
        monkeypatch.setattr(audit, "RANGE", size, raising=False)
        for key in (b"k", None):
            log = audit.chain(df, key)
            plan = log._jdf.queryExecution().toString()
            assert "Coalesce 1" not in plan and "SinglePartition" not in plan and log.columns == [*df.columns, "checksum", "previous_checksum"]
            last = None
            for r in sorted(log.select("*", audit._content().alias("c")).collect(), key=lambda r: r["seq"]):
                data = f"{r['c']}|{last or ''}".encode()
                want = hmac.new(key, data, "sha256").hexdigest() if key else hashlib.sha256(data).hexdigest()
                assert (r["previous_checksum"], r["checksum"]) == (last, want)
                last = want
            assert log.count() == n and audit.verify_chain(log, key).count() == 0
        got = audit.numbered(df.select("seq"), "seq", "n").collect()
        assert sorted((r["n"], r["seq"]) for r in got) == [(i, i * 3) for i in range(1, n + 1)]
    assert audit.chain(df.limit(0), b"k").count() == 0
