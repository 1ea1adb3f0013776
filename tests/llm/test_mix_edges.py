"""The mix on clashing names and columns without a hash of their own."""

from pyspark.sql import functions as F

from tidemark.llm import cube_mix


def test_names_and_maps(stored):
    docs = stored.withColumn("copies", F.lit(7)).withColumn("mix_row_key", F.lit("k")).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    out = cube_mix.apply_mix(docs)
    assert out.columns == [*docs.columns, "copies_"] and out.count() > 0
    assert out.filter("copies != 7 OR mix_row_key != 'k' OR copies_ < 1").count() == 0
    plain = {r["doc_id"]: r["copies"] for r in cube_mix.apply_mix(stored).collect()}
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in stored.collect()} and plain


def test_the_mix_is_a_rounding_of_the_rates(spark, sf_dir):
    """Every document's copies are its source's rate, rounded down or up; each source is near its target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = cube_mix.mix(docs).collect()
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    by = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] == r["copies"] * r["size"]
        rate = min(2.0, r["target"] / r["source_size"]) if r["source_size"] else 0.0
        assert r["copies"] in (int(rate + 1e-9), int(rate + 1e-9) + (rate - int(rate + 1e-9) > 1e-9))
        by.setdefault((r["source"], r["target"]), []).append(r["taken"])
    largest = max(size.values())
    assert all(abs(sum(v) - t) <= largest for (_, t), v in by.items())
