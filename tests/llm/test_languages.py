"""Language identification against a plain version, and with very many labels."""

import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import lang_id

M32 = 0xFFFFFFFF


def bucket(gram):
    """The published hash of an n-gram, one character at a time."""
    h = len(gram) * 0x9E3779B1 & M32
    for c in gram:
        h = (h ^ (ord(c) if c != " " else 0)) * 0x85EBCA6B & M32
        h ^= h >> 15
    return h & (lang_id.BUCKETS - 1)


def grams(text):
    folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in "  " + text)
    folded = "".join(c for i, c in enumerate(folded) if c != " " or i == 0 or folded[i - 1] != " ")
    return [folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1) if folded[i : i + n].strip(" ")]


def test_equals_a_plain_naive_bayes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    counts, prior = defaultdict(Counter), Counter()
    for d, t, lang in rows:
        if not held(d) and t is not None and lang is not None:
            prior[lang] += 1
            counts[lang].update(map(bucket, grams(t)))
    total = {x: sum(c.values()) + 0.5 * lang_id.BUCKETS for x, c in counts.items()}
    got = {r["doc_id"]: r for r in lang_id.identify(docs).collect()}
    for d, t, _ in rows[::3]:
        r = got[d]
        assert r["held_out"] == held(d)
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = Counter(map(bucket, grams(t)))
        log = {x: math.log(prior[x] / sum(prior.values())) + sum(n * math.log((counts[x][b] + 0.5) / total[x]) for b, n in own.items()) / 3 for x in prior}
        best = max(sorted(log), key=log.__getitem__)
        score = 1 / sum(math.exp(v - log[best]) for v in log.values())
        assert r["lang_pred"] == best and abs(r["score"] - score) < 1e-2


def test_many_labels_change_nothing_for_the_others(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100000)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 200000))
    dirty = spark.range(9000).select((F.col("id") + 10**6).alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("~"), "id").alias("lang"))
    want = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(docs).collect()}
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(docs.unionByName(dirty)).filter("doc_id < 1000000").collect()}
    assert sum(got[d] != want[d] for d in want) <= 0.01 * len(want)
