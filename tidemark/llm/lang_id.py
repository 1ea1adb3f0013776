"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are folded to lower-case letters with one blank between words; n-grams of
one to three characters are hashed to ``buckets``. Training adds up bucket counts
of all labelled rows; the matrix of log probabilities (languages x buckets) has a
fixed size bound and is broadcast. Scoring looks n-grams up in it, batch by batch.
Orders overlap, so the evidence of an n-gram counts a third: this tempers the score,
not the order of languages of equal priors.

``MOST_LANGUAGES`` labels are learned: those of most rows, on ties the first in
code-point order. Rows of rarer labels are predicted and not learned from; what is
learned of the others does not depend on how many labels there are.

Edge cases: null text and text without a letter is ``und`` with score 0; rows with
a null language are predicted and never learned from; without any labelled row
everything is ``und``; ties go to the language first in code-point order; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_arrow

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Labels that are learned; with the buckets the bound of the broadcast matrix (float32, 32 MB).
MOST_LANGUAGES = 256
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Characters worked on at a time inside an Arrow batch.
CHUNK_CHARS = 1 << 20


def _letter_table() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, or 0."""
    out = np.zeros(0x10000, np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _codes(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts and, for each, the number of its text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # Two blanks before each text keep the n-grams of neighbours apart.
    raw = np.frombuffer("".join("  " + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), lengths + 2)
    code = letters[np.minimum(raw, 0xFFFF)]
    high = np.flatnonzero(raw > 0xFFFF)
    if len(high):
        code = code.copy()
        code[high] = [x if chr(x).isalpha() else 0 for x in raw[high].tolist()]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (doc[1:] != doc[:-1])
    return code[keep], doc[keep]


def _grams(code: np.ndarray, doc: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of the n-grams of each order; those of blanks only are left out."""
    for n in ORDERS:
        if len(code) < n:
            return
        m = len(code) - n + 1
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        seen = np.zeros(m, bool)
        for k in range(n):
            c = code[k : k + m]
            h = (h ^ c) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            seen |= c != 0
        seen &= doc[:m] == doc[n - 1 :]
        yield (h[seen] & np.uint32(buckets - 1)).astype(np.int64), doc[:m][seen]


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
            chars += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


@dataclass
class Model:
    languages: list[str]
    buckets: int
    log_prior: np.ndarray
    log_prob: np.ndarray


def train(labelled: DataFrame) -> Model:
    """Fit on all rows of ``labelled`` (text, lang); rows with a null in either are left out."""
    spark = labelled.sparkSession
    bounded_arrow(spark)
    labelled = labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    most = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    prior = {r["lang"]: r["n"] for r in most.collect()}
    languages, buckets = sorted(prior), BUCKETS
    labelled = labelled.filter(F.col("lang").isin(languages)) if languages else labelled
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letter_table()
        total = np.zeros(len(number) * buckets, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            langs = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for at, part in _chunks(texts):
                code, doc = _codes(part, letters)
                for bucket, d in _grams(code, doc, buckets):
                    total += np.bincount(langs[at + d] * buckets + bucket, minlength=len(total))
        cell = np.flatnonzero(total)
        for i in range(0, len(cell), 1 << 16):
            part = cell[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "n"])

    counts = np.zeros((len(languages), buckets))
    if languages:
        cells = labelled.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        got = cells.toArrow()
        counts.reshape(-1)[got["cell"].to_numpy()] = got["n"].to_numpy()
    log_prob = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * buckets)
    log_prior = np.log(np.array([prior[x] for x in languages], float) / max(1, sum(prior.values())))
    return Model(languages, buckets, log_prior, np.ascontiguousarray(log_prob.T.astype(np.float32)))


def predict(docs: DataFrame, model: Model, passed: list[str]) -> DataFrame:
    """``passed`` columns of ``docs`` with lang_pred and score (posterior of the prediction)."""
    bounded_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    sent = passed if "text" in passed else [*passed, "text"]
    at_text, n_passed = sent.index("text"), len(passed)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, letters = Model(**shared.value), _letter_table()
        for batch in batches:
            texts = [t or "" for t in batch.column(at_text).to_pylist()]
            pred, conf = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for at, part in _chunks(texts) if m.languages else ():
                code, doc = _codes(part, letters)
                letter = np.bincount(doc[code != 0], minlength=len(part)) > 0
                total = np.tile(m.log_prior, (len(part), 1))
                for bucket, d in _grams(code, doc, m.buckets):
                    for k in range(len(m.languages)):
                        # Orders overlap: each has its share of the evidence.
                        total[:, k] += np.bincount(d, m.log_prob[bucket, k], len(part)) / len(ORDERS)
                best = total.argmax(axis=1)
                post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i in np.flatnonzero(letter).tolist():
                    pred[at + i], conf[at + i] = m.languages[best[i]], post[i]
            names = [*batch.schema.names[:n_passed], "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_passed], pa.array(pred, pa.string()), pa.array(conf)], names)

    # By position, since names may clash with the new ones or differ in case only.
    fields = docs.select(*passed).schema.fields
    kinds = ", ".join(f"p{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    out = docs.select(*[F.col(c).alias(f"p{i}") for i, c in enumerate(sent)])
    out = out.mapInArrow(score, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(f"p{i}").alias(c) for i, c in enumerate(passed)], "lang_pred", "score")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id, as text, leaves ``part`` modulo ``parts`` (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learned from the rows not held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Rows whose language is determined with at least ``least_score``; columns as they were."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    found = predict(docs, model, docs.columns)
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = found.toDF(*names, "pred", "conf").filter((F.col("pred") != UNDETERMINED) & (F.col("conf") >= least_score))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
