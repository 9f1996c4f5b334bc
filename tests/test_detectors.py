"""Value cases of each detector, and the expressions against a plain model."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillguard.operators.detectors import DEFAULT, Detector, Registry, detect, detect_in_text, is_valid, with_findings

CASES = [
    ("Contact: test@example.com", "email", "test@example.com", "valid", 1.0), ("a@.b.com", "email", "a@.b.com", "invalid", 0.3), ("DE89370400440532013000", "iban", "DE89370400440532013000", "valid", 1.0),
    ("DE89370400440532013001", "iban", "DE89370400440532013001", "invalid", 0.3), ("ch9300762011623852957", "iban", "ch9300762011623852957", "valid", 1.0),
    ("IBAN: DE89370400440532013000 for wire transfers.", "iban", "DE89370400440532013000 for wire ", "invalid", 0.3), ("4111111111111111", "credit_card", "4111111111111111", "valid", 1.0),
    ("4111-1111-1111-1112", "credit_card", "4111-1111-1111-1112", "invalid", 0.3), ("0000000000000000", "credit_card", "0000000000000000", "valid", 1.0), ("+43 664 1234567", "phone", "+43 664 1234567", "unvalidated", 0.72),
    ("01/2345678", "phone", "01/2345678", "unvalidated", 0.72), ("+1-555-123-4567", "phone", "+1-555-123-4567", "unvalidated", 0.72), ("(555) 123-4567", "phone", "(555) 123-4567", "unvalidated", 0.72),
    ("07911 123456", "phone", "07911 123456", "unvalidated", 0.72), ("+33 1 23 45 67 89", "phone", "+33 1 23 45 67 89", "unvalidated", 0.72), ("+919876543210", "phone", "+919876543210", "unvalidated", 0.72),
    ("+1 (743) 555-3824", "phone", "(743) 555-3824", "unvalidated", 0.72), ("123-45-6789", "ssn", "123-45-6789", "valid", 0.95), ("123 45 6789", "ssn", "123 45 6789", "valid", 0.95),
    ("000-12-3456", "ssn", "000-12-3456", "invalid", 0.285), ("666-12-3456", "ssn", "666-12-3456", "invalid", 0.285), ("123-00-3456", "ssn", "123-00-3456", "invalid", 0.285), ("123-45-0000", "ssn", "123-45-0000", "invalid", 0.285),
    ("C1234567D", "passport", "C1234567D", "valid", 0.85), ("12AB34567", "passport", "12AB34567", "valid", 0.85), ("A1234567", "drivers_license", "A1234567", "valid", 0.8), ("A123456789012", "drivers_license", "A123456789012", "valid", 0.8),
    ("86095742719", "tax_id_de", "86095742719", "valid", 0.95), ("12345678903", "tax_id_de", "12345678903", "invalid", 0.285), ("86095742710", "tax_id_de", "86095742710", "invalid", 0.285), ("756.1234.5678.97", "ahv_ch", "756.1234.5678.97", "valid", 0.95),
    ("7561234567897", "ahv_ch", "7561234567897", "valid", 0.95), ("l01x00t471", "national_id_de", "l01x00t471", "valid", 0.9), ("DE123456789", "vat_number", "DE123456789", "invalid", 0.285), ("DE136695976", "vat_number", "DE136695976", "valid", 0.95),
    ("ATU13585627", "vat_number", "ATU13585627", "valid", 0.95), ("ATU12345678", "vat_number", "ATU12345678", "invalid", 0.285), ("ro 12", "vat_number", "ro 12", "unvalidated", 0.76), ("CHE-123.456.789 MWST", "vat_number", "CHE-123.456.789 MWST", "valid", 0.95),
]
NONE = [("ABCDEFGHI", "passport"), ("no digits here", "phone"), ("12345", "phone"), ("a@b", "email"), ("", "email"), (None, "iban")]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)] + [(1000 + i, t, k) for i, (t, k) in enumerate(NONE)], "id long, content string, kind string")
    got: dict = {}
    for r in detect(df).where("category = kind").collect():
        got.setdefault(r["id"], []).append((r["matched_text"], r["validation"], pytest.approx(r["confidence"], abs=1e-6)))
    for i, (text, _, match, validation, confidence) in enumerate(CASES):
        assert got.get(i) == [(match, validation, confidence)], text
    assert not [k for k in got if k >= 1000]


def test_offsets(spark):
    text = "é x@y.de, ünd 4111 1111 1111 1111; z@w.org\nSSN 123-45-6789"
    for r in detect_in_text(spark, text):
        assert text[r["start"] : r["end"]] == r["matched_text"]
    assert [r["category"] for r in detect_in_text(spark, text)] == ["email", "credit_card", "email", "ssn"]


def _model(d: Detector, text: str) -> list[str]:
    """Candidates in order of patterns; the first wins."""
    kept: list = []
    for p in d.patterns:
        for m in re.finditer(p, text, re.A):
            s, e = m.span()
            if d.name == "phone" and sum(c.isdigit() for c in m[0]) < 7:
                continue
            if d.name == "passport" and not (6 <= len(m[0]) <= 9 and re.search(r"\d", m[0])):
                continue
            clash = any((s < b and e > a) if d.overlap else (a <= s < b or a < e <= b) for a, b, _ in kept)
            if not clash:
                kept.append((s, e, m[0]))
    return [(s, t) for s, _, t in sorted(kept)]


@pytest.mark.parametrize("name", ["phone", "passport", "ssn", "ahv_ch", "vat_number"])
def test_overlaps_against_a_model(spark, name):
    rng = random.Random(name)
    alphabet = {"phone": "0123456789 +-/()", "passport": "AB12345678 ", "ssn": "123-45 6789", "ahv_ch": "756. 1234", "vat_number": "DEATU0123456789 IT"}[name]
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300)] + ["+49 30 1234567 030/1234567 +1 555 123 4567", "A12345678 123456789 AB1234567", "756.1234.5678.97 7561234567897"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {r["id"]: sorted((f["start"], f["matched_text"]) for f in r["findings"]) for r in with_findings(df, Registry().only([name])).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _model(DEFAULT[name], t), t


def test_registry(spark):
    r = Registry().disable("phone")
    assert not r.is_enabled("phone") and r.enable("phone").is_enabled("phone") and len(r.names) == 11
    with pytest.raises(ValueError, match="unknown"):
        r.only(["nope"])
    assert list(r.only(["EMAIL", " iban"]).detectors) == ["email", "iban"]
    own = Registry().register(Detector("tag", "tag", 0.5, (r"#\w+",)))
    assert [x["category"] for x in detect_in_text(spark, "a #b c@d.ef", own)] == ["tag", "email"]

    def words(text):
        @F.udf("array<struct<start:int,end:int,text:string>>", useArrow=True)
        def run(t):
            return [(m.start(), m.end(), m[0]) for m in re.finditer("secret", t)]

        return run(text)

    assert [x["matched_text"] for x in detect_in_text(spark, "a secret", Registry({"w": Detector("w", "w", 1.0, (), find=words)}))] == ["secret"]


def test_plan_is_native(spark):
    df = spark.createDataFrame([("x",)], "content string")
    plan = detect(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    n = with_findings(spark.createDataFrame([("a@.b.com c@d.ef",)], "content string")).select(F.size(is_valid(F.col("findings")))).first()[0]
    assert n == 1
