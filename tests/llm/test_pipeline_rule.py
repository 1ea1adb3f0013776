"""The pipeline by the rule its near-dedup stage is asked to follow, five words and a similarity of 0.8, and its last stage."""

import brute
import corpus_pipeline
from test_near_copies import kept_by_all_pairs
from tidemark.llm import cube_mix, line_dedup
from tidemark.llm.common import written


def test_stages_at_the_similarity_asked(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got, df = [], docs
    for _, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, sf_dir))
        got.append(df)
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in got]
    assert set(texts[2]) == kept_by_all_pairs(texts[1]) and all(texts[1][d] == t for d, t in texts[2].items())
    assert texts[3] == {d: t for d, t in texts[2].items() if not brute.contamination(t, items)[1]}
    # The last stage takes what the plan takes, as often as the plan says.
    plan = {r["doc_id"]: r["copies"] for r in cube_mix.mix(got[3]).collect()}
    assert {r["doc_id"]: r["copies"] for r in got[4].collect()} == {d: n for d, n in plan.items() if n}
    assert corpus_pipeline.run(spark, sf_dir).count() == got[4].count()


def test_edges(spark, stored, empty, tmp_path):
    """Nulls, repeats, clashing names and empty tables pass through all stages."""
    for name, docs in (("some", stored), ("none", stored.limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "quick brown"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= docs.count()
        assert (out.count() == 0) == (name == "none")
    assert line_dedup.report(empty).count() == 0
