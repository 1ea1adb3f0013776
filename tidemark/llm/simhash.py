"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link if they differ in at most ``THRESHOLD`` bits.
Anchors are the words of a covering code: a product of perfect codes, two Golay
(23, 12) codes of covering radius 3 on bits 0-45 and, for very many fingerprints, a
Hamming (15, 11) code of radius 1 on bits 46-60; the remaining bits of an anchor are
zero. Each fingerprint has one home, the anchor that its blocks decode to. It is
replicated to every anchor whose blocks lie within covering radius plus that block's
part of the threshold, so that it meets the home of each fingerprint it links with.
Pairs are compared per anchor only.

Equal fingerprints are one node from the start, so groups of copies cost nothing;
where documents meet the component of a fingerprint that very many of them share, it is
broadcast.
Within an anchor, links are reduced to a spanning forest before they leave the task;
an anchor with very many homes is searched by enumerating the ball of 2,081 words
around each home instead of comparing all pairs.

Edge cases: null and blank texts have no words and fingerprint zero, linked like any
other; repeated rows are kept; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import near_copies
from tidemark.llm.common import blocks_for, bounded_arrow, join_counted, written
from tidemark.llm.components import components

THRESHOLD = 2
SHINGLE = 3
SEED = 42
#: Shingle hashes whose bits are counted at a time.
CHUNK = 1 << 14
#: Distinct fingerprints up to which two code blocks keep anchors sparse.
TWO_BLOCKS = 1 << 26
#: (first bit, length, check bits, generator polynomial, covering radius) of the code blocks.
GOLAY = (23, 11, 0b110001110101, 3)
HAMMING = (15, 4, 0b10011, 1)
BLOCKS = ((0, *GOLAY), (23, *GOLAY), (46, *HAMMING))


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's word shingles; ASCII letters are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(ones * 2 > n).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, for every row."""
    bounded_arrow(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(hashed, "doc_id long, fp long")


def _remainder(x: np.ndarray, n: int, check: int, poly: int) -> np.ndarray:
    x = x.copy()
    for k in range(n - 1, check - 1, -1):
        x ^= np.where(x >> k & 1, poly << (k - check), 0)
    return x


def _patterns(n: int, check: int, poly: int, radius: int) -> list[np.ndarray]:
    """For e = 0, 1, 2 and each syndrome: the differences, -1 for none, that lead to the
    code words within radius + e but not within radius + e - 1."""
    out, low = [], 0
    for e in range(THRESHOLD + 1):
        words = np.array([sum(1 << i for i in c) for w in range(low, radius + e + 1) for c in combinations(range(n), w)], np.int64)
        syndrome = _remainder(words, n, check, poly)
        order = np.argsort(syndrome, kind="stable")
        syndrome, words = syndrome[order], words[order]
        count = np.bincount(syndrome, minlength=1 << check)
        rows = np.full((1 << check, count.max()), -1, np.int64)
        rows[syndrome, np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)] = words
        out.append(rows)
        low = radius + e + 1
    return out


class Anchors:
    """Maps fingerprints to their anchors."""

    def __init__(self, n_blocks: int):
        self.blocks = BLOCKS[:n_blocks]
        kinds = {b[1:]: _patterns(*b[1:]) for b in self.blocks}
        self.patterns = [kinds[b[1:]] for b in self.blocks]

    def of(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(positions in ``fps``, anchors, whether they are the homes), in parts."""
        parts, syndromes = [], []
        for first, n, check, poly, _ in self.blocks:
            w = (fps >> np.uint64(first) & np.uint64((1 << n) - 1)).astype(np.int64)
            parts.append(w)
            syndromes.append(_remainder(w, n, check, poly))

        def product(k: int, left: int, at: np.ndarray, anchor: np.ndarray, spent: int):
            if k == len(self.blocks):
                yield at, anchor, spent == 0
                return
            for e in range(left + 1):
                table = self.patterns[k][e][syndromes[k][at]]
                row, col = np.nonzero(table >= 0)
                word = parts[k][at[row]] ^ table[row, col]
                yield from product(k + 1, left - e, at[row], anchor[row] | word << self.blocks[k][0], spent + e)

        yield from product(0, THRESHOLD, np.arange(len(fps)), np.zeros(len(fps), np.int64), 0)


def _find(parent: dict[int, int], x: int) -> int:
    top = x
    while parent.setdefault(top, top) != top:
        top = parent[top]
    while parent[x] != top:
        parent[x], x = top, parent[x]
    return top


def _join(parent: dict[int, int], a: np.ndarray, b: np.ndarray) -> None:
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = _find(parent, x), _find(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def _ball() -> np.ndarray:
    one = [1 << i for i in range(64)]
    return np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)


def _compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int = 1 << 20) -> dict[int, int]:
    """Links among the members of each anchor, as a forest."""
    parent: dict[int, int] = {}
    order = np.lexsort((fp, ~home, anchor))
    anchor, fp, home = anchor[order], fp[order], home[order]
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[start, len(anchor)])
    homes = np.add.reduceat(home.astype(np.int64), start)
    start, size, homes = (x[(homes > 0) & (size > 1)] for x in (start, size, homes))
    dense = homes > 2081
    for a, n, h in zip(start[dense], size[dense], homes[dense]):
        # Homes, like all members, are distinct; homes come first and are sorted.
        own, rest = fp[a : a + h], fp[a : a + n]
        for mask in _ball()[1:]:
            other = rest ^ mask
            at = np.minimum(np.searchsorted(own, other), h - 1)
            hit = own[at] == other
            _join(parent, own[at[hit]], rest[hit])
    start, size, homes = start[~dense], size[~dense], homes[~dense]
    pairs = size * homes
    done = np.cumsum(pairs)
    i = 0
    while i < len(start):
        # As many anchors as make about ``most`` pairs.
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + most, "right")))
        p, s = pairs[i:j], size[i:j]
        k = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
        base, wide = np.repeat(start[i:j], p), np.repeat(s, p)
        x, y = fp[base + k // wide], fp[base + k % wide]
        near = (x < y) & (np.bitwise_count(x ^ y) <= THRESHOLD)
        _join(parent, x[near], y[near])
        i = j
    return parent


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links among the distinct fingerprints of ``distinct`` (fp), enough to connect all that link."""
    spark = distinct.sparkSession
    bounded_arrow(spark)
    n = distinct.count()
    n_blocks = 2 if n <= TWO_BLOCKS else 3

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(n_blocks)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at, anchor, home in anchors.of(fps):
                for i in range(0, len(at), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[part]), pa.array(fps[at[part]].view(np.int64)), pa.array(np.full(len(at[part]), home))], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches]
        if got:
            anchor, fp, home = (np.concatenate(x) for x in zip(*got))
            got.clear()
            parent = _compare(anchor, fp.view(np.uint64), home)
            pairs = np.array([(x, _find(parent, x)) for x in list(parent) if parent[x] != x], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    # About 60 replicas of 17 bytes each, 150 with three blocks.
    tasks = blocks_for(n * 17 * (60 if n_blocks == 2 else 150), 4 << 20)
    spread = distinct.select("fp").repartition(min(tasks, blocks_for(n * 8, 1 << 18)), "fp")
    replicas = spread.mapInArrow(replicate, "anchor long, fp long, home boolean")
    return replicas.repartition(tasks, "anchor").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable over links."""
    fps = written(fingerprints(docs))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = written(components(links(nodes)))
    linked = written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "least", "root"))
    tops = written(linked.groupBy("root").agg(F.min("least").alias("top"), F.count(F.lit(1)).alias("n")))
    of_fp = join_counted(linked, tops, "root", linked.count()).select("fp", "top")
    of_fp = written(nodes.join(of_fp, "fp", "left").select("fp", F.coalesce("top", "least").alias("component_id"), "n"))
    return join_counted(fps, of_fp, "fp", fps.count()).select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Near copies have a Jaccard similarity of 0.8 or more over 5-word shingles. Pairs come
    from fingerprints that differ in ``THRESHOLD`` bits or fewer, by ``links``, and are
    confirmed by that similarity. Most near copies differ in more bits, up to 11 and
    beyond: ``near_copies`` adds those, so that none is missed.
    Rows that repeat doc_id and text count as one document, of which the row whose columns hash least stays; rows of one doc_id and
    unlike texts are told apart. Rows without a doc_id, which a group cannot name, are all
    kept.
    """
    found = near_copies.grouped(docs.filter("doc_id IS NOT NULL"), fingerprint, links)
    kept = found.filter(F.struct("doc_id", "text_hash") == F.col("top")).select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = docs.toDF(*names).withColumn("text_hash", F.xxhash64(text))
    fixed = F.xxhash64(*[F.to_json(F.struct(n)) for n in names if n != text])
    order = Window.partitionBy(at, "text_hash").orderBy(fixed)
    same = (F.col(at) == F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    kept_rows = rows.join(kept, same, "left_semi").withColumn("place", F.row_number().over(order)).filter("place = 1")
    kept_rows = kept_rows.select(*names).unionByName(rows.filter(F.col(at).isNull()).select(*names))
    return kept_rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
