"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

Paragraphs are lines. A paragraph's leaves are runs of words that end where the bytes
before a blank say so, two words on average and alike all over a text, so that a text
without line breaks can be compared too. Sections are runs of paragraphs that end where
a paragraph's digest says so. Cut points depend on content alone: an edit changes the
leaves it touches and no others, and weighs as many bytes wherever it is.

The fingerprint is ``root:section/section/...``; a section is ``paragraph,...``; a
paragraph is its leaves, eight hex digits each: six of the digest, two of the length.
Roots test equality; branches that differ locate an edit (``differing_leaves``). The
likeness of two fingerprints is the share of bytes under leaves of both: equal sections
and paragraphs are leaves that are equal, so it is the same by branches or by leaves.

Edge cases: null text counts as empty, an empty text is one empty leaf; repeated
ids follow each other in the order of their texts; null ids come first; a single
document is its own next; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_arrow

#: Bytes of text per range of documents, and the bound on the number of ranges.
RANGE_BYTES = 8 << 20
MOST_RANGES = 1 << 16
#: Longest leaf in bytes; a text without blanks is cut there.
MOST_LEAF = 255
#: A blank ends a leaf if the hash of the bytes before it has these bits clear; a paragraph a section, by its digest.
LEAF_BITS = 1
SECTION_BITS = 7
#: Hex digits of a leaf, the last two of them its length.
LEAF_HEX = 8


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _leaf_ends(data: bytes) -> np.ndarray:
    """Ends of the leaves, ascending; the last is the length."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((b == 32) | (b == 10))
    # A blank that follows a word.
    at = at[(at == 0) | ((b[at - 1] != 32) & (b[at - 1] != 10)) | (b[at] == 10)]
    padded = np.concatenate([np.zeros(4, np.uint32), b.astype(np.uint32)])
    h = np.zeros(len(at), np.uint32)
    for k in range(1, 5):
        h = (h ^ padded[at + 4 - k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    ends = at[(b[at] == 10) | (h & np.uint32(LEAF_BITS) == 0)] + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    wide = np.diff(ends, prepend=0) > MOST_LEAF
    if wide.any():
        starts = np.r_[0, ends[:-1]]
        ends = np.union1d(ends, np.concatenate([np.arange(s + MOST_LEAF, e, MOST_LEAF) for s, e in zip(starts[wide], ends[wide])]))
    return ends


class Tree:
    """Merkle tree of one text.

    ``codes`` has a number for each leaf, its digest's bits above the eight of its
    length; ``paragraphs`` and ``sections`` count the leaves up to their ends.
    """

    __slots__ = ("codes", "paragraphs", "sections", "root", "_counted")

    def __init__(self, text: str):
        data = text.encode("utf-8", "surrogatepass")
        ends = _leaf_ends(data)
        starts = np.r_[0, ends[:-1]]
        hashed = xxhash.xxh3_128_digest
        digests = [hashed(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        flat = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
        self.codes = (flat[:, 0].astype(np.uint32) << 24) | (flat[:, 1].astype(np.uint32) << 16) | (flat[:, 2].astype(np.uint32) << 8) | (ends - starts).astype(np.uint32)
        raw = np.frombuffer(data, np.uint8)
        closes = raw[ends - 1] == 10 if len(data) else np.ones(1, bool)
        closes[-1] = True
        self.paragraphs = (np.flatnonzero(closes) + 1).tolist()
        self.sections, top, of_section, low = [], [], [], 0
        for high in self.paragraphs:
            d = _digest(b"".join(digests[low:high]))
            of_section.append(d)
            if high == len(digests) or d[0] & SECTION_BITS == 0:
                top.append(_digest(b"".join(of_section)))
                of_section = []
                self.sections.append(high)
            low = high
        self.root = _digest(b"".join(top)).hex()
        self._counted = None

    @property
    def leaves(self) -> list[str]:
        text = self.codes.astype(">u4").tobytes().hex()
        return [text[i : i + LEAF_HEX] for i in range(0, len(text), LEAF_HEX)]

    def __str__(self) -> str:
        text, ends, parts, low = self.codes.astype(">u4").tobytes().hex(), set(self.sections), [], 0
        for high in self.paragraphs:
            parts += [text[low * LEAF_HEX : high * LEAF_HEX], "/" if high in ends else ","]
            low = high
        return self.root + ":" + "".join(parts[:-1])

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        if self._counted is None:
            self._counted = np.unique(self.codes, return_counts=True)
        return self._counted

    def like(self, other: Tree) -> float:
        """Share of bytes under leaves that both have (repeats count), 0 to 1."""
        if self.root == other.root:
            return 1.0
        (a, m), (b, n) = self.counted(), other.counted()
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        total = int((self.codes & np.uint32(255)).sum(dtype=np.int64) + (other.codes & np.uint32(255)).sum(dtype=np.int64))
        return 2.0 * int(((both & np.uint32(255)) * np.minimum(m[i], n[j])).sum()) / total

    def edits(self, other: Tree) -> tuple[int, int, int, int, int]:
        """(sections, paragraphs, leaves) that ``other`` lacks, the first byte of the first such leaf and the end of the last (-1: none)."""
        if self.root == other.root:
            return 0, 0, 0, -1, -1
        ends = np.cumsum(self.codes & np.uint32(255), dtype=np.int64)
        absent = ~np.isin(self.codes, other.counted()[0])
        theirs = _branches(other, other.sections), _branches(other, other.paragraphs)
        n = [sum(x not in t for x in _branches(self, e)) for e, t in zip((self.sections, self.paragraphs), theirs)]
        at = np.flatnonzero(absent)
        first, last = (int(ends[at[0]] - (self.codes[at[0]] & np.uint32(255))), int(ends[at[-1]])) if len(at) else (-1, -1)
        return n[0], n[1], len(at), first, last


def _branches(tree: Tree, ends: list[int]) -> Counter:
    low, out = 0, Counter()
    for high in ends:
        out[tree.codes[low:high].tobytes()] += 1
        low = high
    return out


def likeness(a: list[str], b: list[str]) -> float:
    """Share of bytes under the leaves that two lists have in common (repeats count), 0 to 1."""
    if a == b:
        return 1.0
    size = lambda x: int(x[-2:], 16)
    return 2.0 * sum(n * size(x) for x, n in (Counter(a) & Counter(b)).items()) / sum(map(size, [*a, *b]))


def parse(fingerprint: str) -> list[list[list[str]]]:
    """Sections, their paragraphs, their leaves."""
    body = fingerprint.partition(":")[2]
    return [[[p[i : i + LEAF_HEX] for i in range(0, len(p), LEAF_HEX)] for p in s.split(",")] for s in body.split("/")]


def differing_leaves(a: str, b: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, leaf) of the leaves of ``a`` that are not in ``b``.

    Equal branches are skipped whole: sections first, then paragraphs.
    """
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    other = parse(b)
    sections = Counter(",".join("".join(p) for p in s) for s in other)
    paragraphs = Counter("".join(p) for s in other for p in s)
    leaves = Counter(x for s in other for p in s for x in p)
    out = []
    for i, s in enumerate(parse(a)):
        if sections[",".join("".join(p) for p in s)]:
            continue
        for j, p in enumerate(s):
            if not paragraphs["".join(p)]:
                out += [(i, j, k) for k, x in enumerate(p) if not leaves[x]]
    return out


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds that are at most ``key``, by a search in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    if not bounds:
        return F.lit(0)
    listed = lambda xs: F.expr(f"cast(split('{','.join(map(str, xs))}', ',') AS array<bigint>)")
    coarse = listed(bounds[step - 1 :: step])
    skipped = F.size(F.filter(coarse, lambda x: x <= key)) * step
    fine = F.slice(listed(bounds), skipped + 1, step)
    return skipped + F.size(F.filter(fine, lambda x: x <= key))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_sections", "edit_paragraphs", "edit_leaves", "edit_first", "edit_last"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), *[pa.int64()] * 5]
    last = None  # (range, doc_id, text, tree) of the row that waits for its next
    for batch in batches:
        rows: list[tuple] = []
        for where, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if extra and (last is None or last[0] != where):
                continue  # a copy of a range's first row, already used
            tree = Tree(text)
            if last is not None and last[0] == where:
                _, own_id, own, own_tree = last
                cut = len(own) // 4
                edited = own[: len(own) - cut] + text[:cut]
                edited_tree = Tree(edited) if edited != own else own_tree
                rows.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(own_tree), str(edited_tree), own_tree.like(edited_tree), own_tree.like(tree), *edited_tree.edits(own_tree)))
            last = None if extra else (where, doc_id, text, tree)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row and of its edited text, with their likeness and that to the next row.

    ``edit_sections``, ``edit_paragraphs`` and ``edit_leaves`` count the branches of the
    edited text that are not in the text, ``edit_first`` and ``edit_last`` are the bytes
    of the edited text from which and up to which such leaves reach (-1: none).

    Texts are shuffled once, to ranges of ids. A range's first row is also sent to
    the range before it, so that each row meets its next within its own range; each
    range is read as a stream in the order of ids.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    ranges = max(1, min(MOST_RANGES, size[1], -(-(size[0] or 0) // RANGE_BYTES)))
    ids = docs.select(key.alias("key"))
    bounds: list[int] = []
    if ranges > 1:
        cuts = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(ids.agg(F.percentile_approx("key", cuts, 10 * ranges + 10000)).first()[0]))
    at = _range_of(F.col("key"), bounds)
    first = {r["at"]: r["key"] for r in ids.groupBy(at.alias("at")).agg(F.min("key").alias("key")).collect()}
    present = sorted(first) or [0]
    before = dict(zip(present, [present[-1], *present[:-1]]))
    n = present[-1] + 1
    listed = lambda xs: F.expr(f"cast(split('{','.join(map(str, xs))}', ',') AS array<bigint>)")
    # Ranges without a row are never looked up.
    firsts, befores = listed([first.get(i, 0) for i in range(n)]), listed([before.get(i, 0) for i in range(n)])

    rows = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("at", at)
    own = F.struct(F.col("at").alias("at"), F.lit(0).alias("extra"))
    copy = F.struct(F.get(befores, F.col("at")).cast("int").alias("at"), F.lit(1).alias("extra"))
    to = F.when(F.col("key") == F.get(firsts, F.col("at")), F.array(own, copy)).otherwise(F.array(own))
    rows = rows.withColumn("to", F.explode(to)).select("to.at", "to.extra", "key", "doc_id", "text")
    rows = rows.repartitionById(n, F.col("at")).sortWithinPartitions("at", "extra", "key", "text")
    return rows.select("at", "extra", F.col("doc_id").cast("long"), "text").mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_sections long, edit_paragraphs long, edit_leaves long, edit_first long, edit_last long")
