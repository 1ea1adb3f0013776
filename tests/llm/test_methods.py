"""What the methods promise, on cases made for them."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from compare import connect, rows_of, rows_of_sql
from tidemark.llm import bloom_lm, cube_mix, decontaminate, lang_id, merkle, pii, simhash, token_rollup
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), ORACLES[name])


def test_ten_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


def test_no_shared_window_is_missed(spark):
    """Random spans of ten words, at random places, among few words: many ties for winnowing."""
    rng = random.Random(3)
    word = lambda: rng.choice("abc")
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(12)]
    docs = []
    for d in range(60):
        w = [word() if rng.random() < 0.7 else rng.choice("xyz") for _ in range(rng.randint(0, 40))]
        if d % 2:
            w[rng.randint(0, len(w)) : 0] = rng.choice(items)[1].split()[:10]
        docs.append((d, " ".join(w)))
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    for r in got.collect():
        n, hit, ids = brute.contamination(docs[r["doc_id"]][1], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(ids))


def test_join_without_broadcast_gives_the_same(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = rows_of(decontaminate.report(docs, bench))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert rows_of(decontaminate.report(docs, bench)) == want


def near(rng, fp, bits):
    for k in rng.choice(64, bits, replace=False):
        fp ^= 1 << int(k)
    return fp


@pytest.mark.parametrize("blocks", [2, 3])
def test_anchors_find_all_links(spark, blocks, monkeypatch):
    """Chains, a dense ball and unrelated fingerprints, against all pairs."""
    if blocks == 3:
        monkeypatch.setattr(simhash, "TWO_BLOCKS", 0)
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 200)]
    for start in fps[:20]:
        fp = start
        for _ in range(6):
            fps.append(fp := near(rng, fp, 2))
    fps += [near(rng, fps[30], int(k)) for k in rng.integers(1, 5, 150)] + [near(rng, fps[31], 3) for _ in range(50)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    got = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in got]
    want = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2]
    assert brute.components(got, fps) == brute.components(want, fps)


def test_dense_anchor_is_searched_by_its_balls():
    rng = np.random.default_rng(6)
    fps = np.unique(np.array([near(rng, 0, int(k)) for k in rng.integers(0, 5, 6000)], np.uint64))
    assert len(fps) > 2081
    anchor, home = np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    parent = simhash._compare(anchor, fps, home)
    few = fps[:: len(fps) // 300]
    for x in few.tolist():
        for y in fps[np.bitwise_count(fps ^ np.uint64(x)) <= 2].tolist():
            assert x == y or simhash._find(parent, x) == simhash._find(parent, y)


def test_covering_radius():
    a = simhash.Anchors(3)
    fps = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    homes = {}
    for at, anchor, home in a.of(fps):
        for i, x in zip(at.tolist(), anchor.tolist()):
            if home:
                assert i not in homes
                homes[i] = x
                d = int(fps[i]) ^ x
                assert (d & (1 << 23) - 1).bit_count() <= 3 and (d >> 23 & (1 << 23) - 1).bit_count() <= 3 and (d >> 46 & (1 << 15) - 1).bit_count() <= 1
    assert len(homes) == 500


def test_targets_by_water_filling(spark):
    sizes = {"a": 100, "b": 5000, "c": 300, "d": 10, "é": 0, None: 700}
    got = cube_mix.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= share
    assert {r["source"]: r["target"] for r in got} == {s: pytest.approx(t) for s, t in target.items()}


def test_mix_meets_targets_and_balances(spark, sf_dir):
    """With blocks so small that there are three levels."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([1, 5, 50, 400]), rng.choice("aaab")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cube_mix.BLOCK, cube_mix.FAN_IN, keep = 64, 16, (cube_mix.BLOCK, cube_mix.FAN_IN)
    try:
        got = cube_mix.mix(docs)
        by = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("want"), F.sum("copies").alias("n"), F.count("*").alias("all"), F.max("source_size").alias("size")).collect()
        assert got.count() == 3000
    finally:
        cube_mix.BLOCK, cube_mix.FAN_IN = keep
    for r in by:
        assert abs(r["t"] - r["want"]) <= 200  # half of the largest document
        assert abs(r["n"] - r["all"] * r["want"] / r["size"]) <= 4


def test_flight_leaves_two_fractions_and_keeps_sums():
    rng = np.random.default_rng(2)
    p, z = rng.random(500), rng.integers(1, 300, 500).astype(float)
    q = p.copy()
    cube_mix._flight(q, z, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2 and q.sum() == pytest.approx(p.sum()) and (q * z).sum() == pytest.approx((p * z).sum())


def test_language_id_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lang_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_filter_gives_counts_back():
    """Every n-gram held reads back its level or more; few of those not held read back any."""
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    level = rng.integers(1, 6, len(keys)).astype(np.uint8)
    bits = int(np.ceil(np.log2(level.sum() * bloom_lm.BITS_PER_ENTRY)))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([bloom_lm._pack_sorted(keys)]), pa.array([bloom_lm._planes(level)])], ["region", "order", "a", "b"])
    (out,) = bloom_lm._fill((1, 2), 63, bits)(iter([batch]))
    m = bloom_lm.Model(1, 1, 0.1, (1, 2), 63, bits, np.frombuffer(out.column(1)[0].as_py(), np.uint8))
    assert (m.levels(0, keys) >= level).all()
    strange = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    assert (m.levels(0, strange) > 0).mean() < 0.1


def test_model_beats_the_base_on_held_out_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = bloom_lm.score(docs).filter("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert s["m"] > s["b"]


def test_filter_has_a_bound(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(bloom_lm, "FILTER_BITS", 1 << 14)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert bloom_lm.score(docs).filter("score < 0").count() == docs.count()


def test_merkle_tree_locates_an_edit():
    rng = random.Random(1)
    text = "\n".join(" ".join("".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(40)) for _ in range(30))
    edited = text[:3000] + "EDIT" + text[3004:]
    a, b = merkle.Tree(text), merkle.Tree(edited)
    assert a.root != b.root and str(a) != str(b) and merkle.likeness(a.leaves, b.leaves) > 0.95
    differing = merkle.differing_leaves(str(a), str(b))
    assert 1 <= len(differing) <= 3
    assert merkle.differing_leaves(str(a), str(a)) == []
    assert [x for s in merkle.parse(str(a)) for p in s for x in p] == a.leaves


def test_likeness_tells_edits_from_strangers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = merkle.fingerprints(docs)
    assert got.count() == docs.count()
    q = got.filter("n_chars > 40").agg(F.percentile("near_edited", F.lit(0.05)), F.percentile("near_next", F.lit(0.9))).first()
    assert q[0] > 0.6 and q[1] < 0.2


def test_ranges_of_documents_do_not_matter(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = rows_of(merkle.fingerprints(docs))
    monkeypatch.setattr(merkle, "RANGE_BYTES", 1 << 14)
    assert rows_of(merkle.fingerprints(docs)) == want


def test_expectation_maximisation_finds_reliable_labelers():
    rng = random.Random(0)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = [0] * len(pii.LABELERS)
        for j, right in ((0, 0.95), (1, 0.8), (3, 0.55)):
            votes[j] = (1 if y else -1) if rng.random() < right else (-1 if y else 1)
        counts[4, tuple(votes)] = counts.get((4, tuple(votes)), 0) + 1
    post, tables = pii.estimate(counts)
    assert tables[0][1, 1] > tables[1][1, 1] > tables[3][1, 1]
    sure = tuple(1 if j in (0, 1, 3) else 0 for j in range(len(pii.LABELERS)))
    assert post[4, sure] > 0.95 and post[4, tuple(-v for v in sure)] < 0.1


def test_secrets_are_added_to_base_spans(spark):
    texts = [f"hello {i} password={i:08d}abcdef and token = \"{i:010d}deadbeef\" mail a{i}@mail.com here" for i in range(40)] + ["version 2.0 of 2019-05-06 is out"] * 20
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all("secret:" in r["spans"] and "email:" in r["spans"] for r in rows if r["doc_id"] < 40)
    assert all(r["spans"] == "" for r in rows if r["doc_id"] >= 40)


def test_base_spans_of_hard_texts(spark):
    texts = ["a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "1.2.3.4 01.002.003.0255 1.2.3.256", "4111111111111111 4111 1111-1111 1111 2", "+1 (555) 123-4567+2 3", "+12345678", "9" * 4000, "a" * 4000 + "@" + "b" * 300, "é😀x@y.zz 1.1.1.1", "@@a@b@c.d", "1-2-3 " * 500]
    rng = random.Random(9)
    texts += ["".join(rng.choice("a1.@-+ ()9 é") for _ in range(60)) for _ in range(300)]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    import hashlib

    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(",".join(brute.base_spans(texts[r["doc_id"]])).encode()).hexdigest(), texts[r["doc_id"]]


def test_rollup_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([("a", "en", 5), ("a", None, 7), (None, "en", None)], "source string, lang string, n long")
    r = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    load, fix = token_rollup.inserts(docs, "t1", F.col("n")), token_rollup.revisions(docs, "t1", F.lit(10), F.col("n"))
    assert r.commit("load", load) and not r.commit("load", load) and r.commit("fix", fix) and r.commit("none", load.limit(0))
    want = [(None, "en", "t1", 1, 10), ("a", None, "t1", 1, 10), ("a", "en", "t1", 1, 10)]
    read = lambda: sorted(map(tuple, r.totals().collect()), key=str)
    assert read() == sorted(want, key=str)
    r.compact()
    assert read() == sorted(want, key=str) and not r.commit("load", load) and not r.commit("none", load)
    assert r.commit("drop", token_rollup.deletes(docs, "t1", F.lit(10))) and read() == []
    r.compact()
    assert read() == [] and not r.commit("fix", fix)
    with pytest.raises(ValueError):
        r.commit("../x", load)
