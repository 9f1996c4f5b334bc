"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillguard.operators import protect
from quillguard.plans import catalog

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = (
    "detect_all", "detect_email", "detect_credit_card", "detect_iban", "detect_phone", "inventory_by_language", "inventory_rollup", "redact_label", "policy_execute_custom", "context_markers",
    "address_en", "dictionary_names", "html_segments_scan", "text_lines", "hash_sha256_salted", "encrypt_decrypt", "tokenize_detokenize", "audit_chain_verify", "stream_equals_batch",
)


def protect_documents(spark, d):
    return protect.protect_text(catalog.documents(spark, d)).select("doc_id", "protected")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.minPartitionNum", CPUS).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: catalog.QUERIES[n] for n in NAMES} | {"protect_documents": protect_documents}
    mb = catalog.table(spark, SF, "documents").agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
    times = {}
    for name, run in queries.items():
        took = []
        for _ in range(2):  # the first also compiles
            began = time.time()
            run(spark, SF).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        times[name] = round(min(took), 3)
    rates = {f"{n}_mb_s": round(mb / times[n], 2) for n in ("detect_all", "detect_email", "detect_credit_card", "protect_documents", "dictionary_names")}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF.rpartition("sf")[2], "documents_mb": round(mb, 2), "rates": rates}))


if __name__ == "__main__":
    main()
