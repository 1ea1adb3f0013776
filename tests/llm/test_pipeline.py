"""The pipeline against a plain version of its first four stages."""

import brute
import corpus_pipeline
from tidemark.llm import lang_id
from tidemark.llm.common import written


def test_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    got = []
    df = docs
    for _, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, sf_dir))
        got.append({r["doc_id"]: r["text"] for r in df.collect()})
    assert df.columns == [*columns, "copies"]

    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = {r["doc_id"] for r in lang_id.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    rows = {d: t for d, t in sorted(rows.items()) if d in model}
    assert got[0] == rows

    removed = brute.later_line_copies(rows.items(), 2)
    clean = {}
    for d, t in rows.items():
        lines = [x for i, x in enumerate(t.split("\n")) if i not in removed.get(d, ())]
        if lines:
            clean[d] = "\n".join(lines)
    assert got[1] == clean

    fps = {d: brute.simhash(t) for d, t in clean.items()}
    pairs = [(a, b) for a, x in fps.items() for b, y in fps.items() if a < b and (x ^ y).bit_count() <= 2]
    tops = brute.components(pairs, fps)
    single = {d: t for d, t in clean.items() if tops[d] == d}
    assert got[2] == single

    assert got[3] == {d: t for d, t in single.items() if not brute.contamination(t, items)[1]}
    assert set(got[4]) <= set(got[3]) and len(got[4]) > 0.5 * len(got[3])
