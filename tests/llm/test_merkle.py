"""Fingerprints: the same change scores alike wherever it is, and is located."""

import random
import statistics

from tidemark.llm import merkle


def test_place_of_a_change_does_not_matter(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect() if r["text"]]
    likes = {0: [], 1: [], 3: []}
    for text, other in zip(texts, texts[1:]):
        n = len(text) // 4
        if n < 10 or len(other) < n or text == other:
            continue
        tree = merkle.Tree(text)
        for k in likes:
            edited = text[: k * n] + other[:n] + text[(k + 1) * n :]
            likes[k].append(tree.like(merkle.Tree(edited)))
    median = [statistics.median(v) for v in likes.values()]
    assert max(median) - min(median) < 0.1 and min(median) > 0.6


def test_likeness_by_codes_is_that_by_leaves():
    rng = random.Random(5)
    for _ in range(50):
        a, b = ("".join(rng.choice("ab \n") for _ in range(rng.randint(0, 400))) for _ in range(2))
        x, y = merkle.Tree(a), merkle.Tree(b)
        assert x.like(y) == merkle.likeness(x.leaves, y.leaves) and (x.root == y.root) == (a == b)
        assert sum(int(c[-2:], 16) for c in x.leaves) == len(a.encode())


def test_edit_is_located():
    rng = random.Random(2)
    text = "\n".join(" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30)) for _ in range(40))
    edited = text[:4000] + "QQQQ" + text[4004:]
    sections, paragraphs, leaves, first, last = merkle.Tree(edited).edits(merkle.Tree(text))
    assert paragraphs == 1 and 1 <= sections <= 2 and 1 <= leaves <= 3 and first <= 4000 and 4004 <= last <= 4100
    assert len(merkle.differing_leaves(str(merkle.Tree(edited)), str(merkle.Tree(text)))) == leaves
    assert merkle.Tree(text).edits(merkle.Tree(text)) == (0, 0, 0, -1, -1)


def test_long_words_are_cut():
    t = merkle.Tree("x" * 100000 + " y")
    assert len(t.leaves) == 394 and t.like(merkle.Tree("x" * 100000 + " z")) > 0.99
