"""python -m quillguard.cli scan|protect|batch|discover|crypto|stream|policy ..."""

from __future__ import annotations

import argparse
import base64
import sys


def _spark():
    from pyspark.sql import SparkSession

    from .functions.crypto import secure_session

    spark = secure_session(SparkSession.builder.appName("quillguard").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _policy(path: str | None):
    from .operators.policy import default_policy, load_policy, validate_policy

    p = load_policy(path) if path else default_policy()
    if errors := validate_policy(p).errors:
        sys.exit("; ".join(errors))
    return p


SAMPLE_POLICY = """version: "1.0"
name: sample
detection:
  - types: [email, iban, phone, credit_card, ssn]
    confidence_threshold: 0.5
protection:
  - types: [email, iban, phone, credit_card, ssn]
    action: redact
    style: label
"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillguard")
    c = p.add_subparsers(dest="command", required=True)
    scan = c.add_parser("scan")
    scan.add_argument("paths", nargs="+")
    scan.add_argument("--policy")
    scan.add_argument("--detect", help="detectors, parted by commas")
    scan.add_argument("--format", choices=("json", "text"), default="text")
    scan.add_argument("--include-values", action="store_true")
    scan.add_argument("--yes", action="store_true", help="values may be shown")
    scan.add_argument("--fail-on-findings", action="store_true")
    protect = c.add_parser("protect")
    protect.add_argument("file")
    protect.add_argument("--output")
    protect.add_argument("--policy")
    protect.add_argument("--style", choices=("label", "bar", "mask"), default="label")
    batch = c.add_parser("batch")
    batch.add_argument("paths", nargs="+")
    batch.add_argument("--include", action="append", default=[])
    batch.add_argument("--exclude", action="append", default=[])
    discover = c.add_parser("discover")
    discover.add_argument("paths", nargs="+")
    discover.add_argument("--report", choices=("json", "text", "summary", "csv"), default="summary")
    crypto = c.add_parser("crypto")
    crypto.add_argument("action", choices=("keygen", "hash", "encrypt", "decrypt"))
    crypto.add_argument("value", nargs="?", default="")
    crypto.add_argument("--key", help="env://NAME or file:///path")
    stream = c.add_parser("stream")
    stream.add_argument("folder")
    policy = c.add_parser("policy")
    policy.add_argument("action", choices=("init", "validate", "show"))
    policy.add_argument("file", nargs="?")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "policy":
        if a.action == "init":
            print(SAMPLE_POLICY)
            return 0
        from .operators.policy import load_policy, validate_policy

        p = load_policy(a.file)
        if a.action == "show":
            print(p)
            return 0
        v = validate_policy(p)
        print("\n".join([*[f"error: {e}" for e in v.errors], *[f"warning: {w}" for w in v.warnings]]) or "valid")
        return 0 if v.valid else 1
    from pyspark.sql import functions as F

    from .functions import crypto as C
    from .operators import discovery as D
    from .operators.detectors import Registry
    from .operators.policy import filter_findings, resolve_key
    from .sources import files as S

    if a.command == "crypto" and a.action == "keygen":
        print(base64.b64encode(C.generate_key()).decode())
        return 0
    if a.command == "scan" and a.include_values and not a.yes and (not sys.stdin.isatty() or input("Show values? [y/N] ").lower() != "y"):
        sys.exit("values are shown only with --yes")
    spark = _spark()
    if a.command == "crypto":
        x = F.lit(a.value)
        out = {"hash": lambda: C.digest(x), "encrypt": lambda: C.encrypt(x, resolve_key(a.key)), "decrypt": lambda: C.decrypt(x, resolve_key(a.key))}[a.action]()
        print(spark.range(1).select(out).first()[0])
        return 0
    if a.command == "scan":
        policy = _policy(a.policy)
        reg = Registry().only(a.detect.split(",")) if a.detect else Registry().for_categories(policy.categories)
        found = D.scan(spark, *a.paths, registry=reg).withColumn("findings", filter_findings(F.col("findings"), policy)).cache()
        for r in D.scan_output(found, a.include_values, a.yes or a.include_values).toLocalIterator():
            print(r["value"])
        n = found.agg(F.sum(F.size("findings"))).first()[0] or 0
        if a.format == "text":
            print(f"{n} findings", file=sys.stderr)
        return 2 if a.fail_on_findings and n else 0
    if a.command == "protect":
        from .operators.protect import WRITABLE, protect_files
        from .operators.redact import Redaction, Style

        f = S.sniffed(S.read_files(spark, a.file)).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
        r = protect_files(f, _policy(a.policy), Redaction(Style(a.style))).first()
        if r is None:
            sys.exit(f"only {', '.join(WRITABLE)} can be written")
        if a.output:
            with open(a.output, "w") as out:
                out.write(r["output"])
        else:
            print(r["output"])
        return 0
    if a.command == "batch":
        print(D.batch_summary(S.parse_files(spark, *a.paths, include=a.include, exclude=a.exclude)).toJSON().first())
        return 0
    if a.command == "discover":
        print(D.report(D.scan(spark, *a.paths).cache(), a.report))
        return 0
    from .streaming.scan import read_lines, run, scan_lines

    run(scan_lines(read_lines(spark, a.folder)), "lines").awaitTermination()
    for r in spark.table("lines").where("size(findings) > 0").select(F.to_json(F.transform("findings", lambda f: F.struct(f["category"].alias("category"), f["start"].alias("start"), f["end"].alias("end"))))).toLocalIterator():
        print(r[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
