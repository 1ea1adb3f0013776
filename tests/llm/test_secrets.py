"""Secrets are matched whole, and found in texts without digits."""

from tidemark.llm import pii


def test_long_secrets_and_keys_of_letters(spark):
    long, key = "token=" + "aB3_" * 250, "AKIA" + "ABCDEFGH" * 2
    docs = spark.createDataFrame([(1, f"see {long} here"), (2, f"see {key} here"), (3, "secret=" + "x" * 200000)], "doc_id long, text string")
    got = {r["doc_id"]: [f["s"] for f in r["found"] if f["kind"] == 4] for r in pii.matches(docs).collect()}
    assert got == {1: [long], 2: [key], 3: ["secret=" + "x" * 200000]}
