"""The language model against a plain version, whose next-word probabilities add up to 1."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

import brute
from tidemark.llm import bloom_lm


def stands(c):
    """The count that a quantised count stands for."""
    return 1.5 * 2 ** (c.bit_length() - 1) - 0.5 if c > 1 else c


class Plain:
    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for t in texts:
            w = [*brute.blank_words(brute.lower(t)), ""]
            self.one.update(w)
            for a, b in zip(w, w[1:]):
                self.two[a][b] += 1
        self.n = sum(stands(c) for c in self.one.values())

    def alone(self, w):
        return (stands(self.one[w]) + 1) / (self.n + len(self.one) + 1)

    def after(self, h, w):
        own = self.two.get(h)
        if not own:
            return self.alone(w)
        s = sum(stands(c) for c in own.values())
        return (stands(own[w]) + len(own) * self.alone(w)) / (s + len(own))

    def score(self, text):
        w = [*brute.blank_words(brute.lower(text)), ""]
        return math.log10(self.alone(w[0])) + sum(math.log10(self.after(a, b)) for a, b in zip(w, w[1:]))


@pytest.mark.parametrize("spread", [False, True])
def test_scores_are_those_of_a_distribution(spark, sf_dir, monkeypatch, spread):
    if spread:
        monkeypatch.setattr(bloom_lm, "SAMPLE", 1)
        monkeypatch.setattr(bloom_lm, "FREQUENT_SHARE", 0.01)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    plain = Plain(t for d, t in rows.items() if zlib.crc32(str(d).encode()) % 7 != 2)
    got = {r["doc_id"]: r["score"] for r in bloom_lm.score(docs).collect()}
    assert got.keys() == rows.keys()
    for d, t in rows.items():
        assert got[d] == pytest.approx(plain.score(t), rel=1e-6)
    for h in list(plain.two)[::400]:
        assert sum(plain.after(h, w) for w in plain.one) + plain.after(h, "never seen") == pytest.approx(1)


def test_model_is_well_above_the_base(spark, sf_dir):
    rows = bloom_lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("NOT held_out AND n_tokens > 20").collect()
    assert all(r["score"] > r["base_score"] for r in rows)


def test_small_regions_read_the_same(spark, sf_dir, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 61, 5000).astype(np.uint64))
    level = rng.integers(0, 5, len(keys))
    for bits in (1 << 24, 1 << 12):
        monkeypatch.setattr(bloom_lm, "FILTER_BITS", bits)
        assert (bloom_lm._read_back(keys, level, 1, 3) == level).all()
