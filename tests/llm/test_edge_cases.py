"""Every operator on nulls, empty and long texts, repeats, clashing names and empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from tidemark.llm import bloom_lm, components, cube_mix, decontaminate, lang_id, line_dedup, merkle, pii, simhash, span_dedup

N = 15
ITEMS = [(1, "it was a fine day for all of them a second line"), (2, "the dog ran"), (None, "naß"), (3, None), (4, "..."), (2, "the dog ran")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS gram", "2 AS items")


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_decontamination(stored, bench, empty):
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.report(stored, bench).collect())
    want = []
    for d, t in texts(stored):
        n, hit, ids = brute.contamination(t, ITEMS)
        ids = sorted(str(i) for i in ids if i is not None)
        want.append((d or -1, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    assert got == sorted(want)
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(stored, bench.limit(0)).filter("contaminated").count() == 0
    kept = decontaminate.keep_clean(stored, bench)
    assert kept.columns == stored.columns and kept.count() == sum(not x[-1] for x in want)


def test_line_dedup(stored, empty):
    for n in (1, 2, 3, 5):
        got = {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in line_dedup.report(stored, n).collect()}
        rows = {}
        for d, t in sorted(set(texts(stored)), key=lambda x: (x[0] is not None, x[0] or 0)):
            rows[d] = t
        removed = brute.later_line_copies(rows.items(), n)
        assert got == {(d, len(t.split("\n")) if t is not None else 0, len(removed.get(d, ()))) for d, t in rows.items()}
    assert line_dedup.report(empty).count() == 0
    out = line_dedup.remove_repeats(stored)
    assert out.columns == stored.columns
    ids = {r["doc_id"] for r in out.collect()}
    assert 1 in ids and 2 not in ids and {3, 4, 9, None} <= ids  # all lines of 2 are copies of those of 1
    (long,) = out.filter("doc_id = 8").collect()
    assert long["n_chars"] == len(long["text"])


def test_span_dedup(stored, empty):
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["removed"]) for r in span_dedup.report(stored).collect()}
    assert got[3] == (0, 0, "") and got[1] == (5, 0, "") and got[2] == (5, 5, "0,1,2,3,4") and got[10][2] == ""
    assert span_dedup.report(stored).count() == N and span_dedup.report(empty).count() == 0
    out = span_dedup.remove_repeats(stored)
    assert out.columns == stored.columns and out.count() == N
    assert {r["doc_id"]: r["text"] for r in out.collect()}[2] == ""


def test_pii(stored, empty):
    rows = pii.report(stored).collect()
    assert len(rows) == N
    want = {}
    for d, t in texts(stored):
        want[d] = brute.base_spans(t)
    for r in rows:
        base = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b.startswith(k) for b in base) for k in ("email", "ip", "card", "phone")]
        assert set(base) <= set(r["spans"].split(","))
    assert pii.report(empty).count() == 0


@pytest.mark.parametrize("text", ["joe (at) " + "b." * 10000 + "com", "a@" + "b." * 10000 + "com", "1" * 20000, "1." * 10000 + "1", "+1" + "2-" * 10000 + "3"])
def test_pii_long_matches(spark, text):
    """One match over a whole long text needs neither deep stacks nor quadratic time."""
    (r,) = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    base = brute.base_spans(text)
    assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_simhash(stored, empty):
    rows = simhash.near_duplicates(stored).collect()
    assert len(rows) == N
    want = {}
    for d, t in texts(stored):
        want.setdefault(d, set()).add(brute.simhash(t))
    assert all(r["fp"] & (1 << 64) - 1 in want[r["doc_id"]] for r in rows)
    fps = [(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in rows if r["doc_id"] is not None]
    pairs = [(a, b) for a, x in fps for b, y in fps if (x ^ y).bit_count() <= 2]
    tops = brute.components(pairs, {d for d, _ in fps})
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == tops
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one_of_each(stored)
    assert kept.columns == stored.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*set(tops.values()), None, None])


def test_bloom_lm(stored, empty):
    rows = bloom_lm.score(stored).collect()
    assert len(rows) == N
    words = lambda t: brute.blank_words(brute.lower(t)) + [""]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in texts(stored) if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = {d: (held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for d, t in texts(stored)}
    for r in rows:
        got = (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], pytest.approx(r["base_score"]))
        assert want[r["doc_id"]] == got and r["score"] < 0
    assert bloom_lm.score(empty).count() == 0


def test_cube_mix(stored, empty):
    rows = cube_mix.mix(stored).collect()
    assert len(rows) == N and {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in rows)
    assert sorted(rows) == sorted(cube_mix.mix(stored.repartition(7)).collect())
    assert cube_mix.mix(empty).count() == 0
    out = cube_mix.apply_mix(stored)
    assert out.columns == [*stored.columns, "copies"] and out.filter("copies < 1").count() == 0
    assert out.count() <= N


def test_language_id(stored, empty):
    rows = lang_id.identify(stored).collect()
    assert len(rows) == N
    by = {r["doc_id"]: r for r in rows}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (3, 4, 5, 9))
    assert all(0 <= r["score"] <= 1 for r in rows) and by[12]["lang_pred"] != "und"
    assert lang_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(stored.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = lang_id.keep_identified(stored)
    assert kept.columns == stored.columns and not {3, 4, 5, 9} & {r["doc_id"] for r in kept.collect()}


def test_merkle(stored, documents, empty):
    rows = merkle.fingerprints(stored).collect()
    assert len(rows) == N and merkle.fingerprints(empty).count() == 0
    order = sorted(((d, t or "") for d, t in texts(documents)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = Counter()
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        want[d, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0
    assert by[3]["fingerprint"] == by[4]["fingerprint"] and all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    (one,) = merkle.fingerprints(documents.filter("doc_id = 7")).collect()
    assert one["near_next"] == 1.0


def test_components(spark):
    schema = "a long, b long"
    path = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    links = spark.createDataFrame(path + star + [(7, 7), (500, 500), (2, 1), (None, 3)], schema)
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = brute.components(path + star, {*range(1, 41), *range(100, 160), 500})
    assert got == want
    assert components.components(links.limit(0)).count() == 0
