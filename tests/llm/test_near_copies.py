"""The near-copy stage against all pairs."""

import random

import brute
from tidemark.llm import simhash


def shingles(text):
    w = brute.blank_words(brute.lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_all_pairs(docs):
    sets = {d: shingles(t) for d, t in docs.items()}
    alike = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    tops = brute.components([(a, b) for a in docs for b in docs if a < b and alike(sets[a], sets[b])], docs)
    return {d for d in docs if tops[d] == d}


def test_all_near_copies_are_found(spark):
    """Copies with few and many edits, a large group of them, lengths around the limit and common passages."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(40)]
    texts = []
    for k in range(60):
        base = [word() for _ in range(rng.choice([3, 5, 8, 30, 90, 300]))]
        texts.append(base)
        for _ in range(40 if k == 7 else 4):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            texts.append(w[: len(w) - rng.choice([0, 0, len(w) // 8])])
        texts.append(passage + [word() for _ in range(rng.randint(5, 15))])
    rng.shuffle(texts)
    docs = {i: " ".join(w) for i, w in enumerate(texts)}
    got = {r["doc_id"] for r in simhash.keep_one_of_each(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    want = kept_by_all_pairs(docs)
    assert got == want and len(want) < 0.9 * len(docs)


def test_near_copies_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = kept_by_all_pairs({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()} == want


def test_unlike_texts_of_one_id_are_kept(spark):
    rows = [(1, "one text of some six words", "b"), (1, "quite another text of seven words here", "a"), (1, "one text of some six words", "a"), (2, "one text of some six words", "a")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        got = sorted(map(tuple, simhash.keep_one_of_each(docs).collect()))
        assert [r[:2] for r in got] == sorted({r[:2] for r in rows[:2]})
        first = got if order is rows else first
        assert got == first
