"""Language-model scores from a log-frequency Bloom filter.

Counting. Tasks turn blocks of documents into sorted arrays of hashed n-grams with
their counts in the block, cut into shards by hash. A shard's task adds the arrays
up. A frequent word is one entry of each block, so no key is hot, and rows are blocks
rather than words. Bigrams go to the shard of their first word, which so sees all that
may follow it; those of the words that a sample finds frequent go by their second word,
and what is known of their first is added up over shards.

Filter. An n-gram of count c has level 1 + floor(log2 c). The filter holds the pairs
(n-gram, 1) up to (n-gram, level) of every unigram and bigram; a count is read back by
probing levels until one is missing, and stands for its level's middle. The filter grows
with the corpus, so it is not broadcast as a whole: a shard's task builds the part of
its n-grams, region by region, probes it for the n-grams of all blocks, and sends each
block the levels read. No n-gram is left out at any size.

Score. log10 of an interpolated bigram model (Witten and Bell): of the S followers of a
word h counted in the filter, T different ones,
    p(w | h) = (c(h w) + T p(w)) / (S + T),  p(w) = (c(w) + 1) / (N + V + 1),
with one unknown word. S, T and N are sums of the counts that the filter stands for, so
the probabilities of all next words add up to 1, but for the filter's false positives (of
``HASHES`` bits each). The first word, and words after an unknown one, have p(w).

Edge cases: null and blank texts are the end token alone; rows without an id are
training rows; repeated rows are scored, and learned from, one by one; without
training rows every word is unknown; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_arrow, scan_id, written

#: Text bytes per shard.
SHARD_BYTES = 16 << 20
#: Bound on the bits of one region of the filter; bits for an entry, bits set for an entry.
FILTER_BITS = 1 << 24
BITS_PER_ENTRY = 40
HASHES = 28
#: Least level held of unigrams and bigrams.
LEAST_LEVEL = (1, 1)
LEVELS = 48
#: One text of so many is read to find frequent words: those of more than this share of a shard's words, and the most of them.
SAMPLE = 64
FREQUENT_SHARE = 0.05
MOST_FREQUENT = 1 << 16
END = b""
PARTS, HELD_OUT = 7, 2

#: Kinds of rows: n-grams of a block; a block's tokens; totals, levels and follower sums for a block; sums of frequent words; levels counted.
UNIGRAMS, BIGRAMS, SPREAD, TOKENS, TOTALS, LEVELS_1, LEVELS_2, LEVELS_S, FOLLOWERS, FREQUENT, COUNTED = range(11)
BLOCK = "kind int, shard int, block long, x long, y long, a binary, b binary, c binary, d binary"


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an array by significance, compressed; the many zero bytes of small numbers lie together. The raw length comes first."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unplanes(b: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], size, codec="zstd", asbytes=True) if size else b""
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b, np.uint64), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, ascending; each token's place among them; each token's text)."""
    vocabulary, ids, lengths = _Vocabulary(), [], []
    number = vocabulary.__getitem__
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        words.append(END)
        ids.append(np.fromiter(map(number, words), np.int64, len(words)))
        lengths.append(len(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return hashes[order], rank[np.concatenate(ids)], np.repeat(np.arange(len(texts)), lengths)


def _pairs(hashes: np.ndarray, place: np.ndarray, doc: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, positions of the second words, whether the first is frequent) of all bigrams within texts.

    A key is 32 bits of either word's hash, the first word's above; of bigrams of a
    frequent first word the second word's above.
    """
    at = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    first, second = (hashes[place[x]] >> np.uint64(32) for x in (at - 1, at))
    spread = _among(first, frequent)
    return np.where(spread, second << np.uint64(32) | first, first << np.uint64(32) | second), at, spread


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _row(kind: int, shard: int = 0, block: int = 0, x: int = 0, y: int = 0, *blobs: bytes) -> tuple:
    return (kind, shard, block, x, y, *blobs, *[None] * (4 - len(blobs)))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["kind", "shard", "block", "x", "y", "a", "b", "c", "d"])


def _count_blocks(shard_bits: int, told):
    shift = np.uint64(64 - shard_bits)

    def cut(kind: int, block: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
        if not len(keys):
            return []
        shards = keys >> shift
        # Only shards that the block has words of: at most as many as words, however many there are.
        starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
        out = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            out.append(_row(kind, int(shards[start]), block, 0, 0, _pack_sorted(keys[start:end]), _planes(counts[start:end].astype(np.uint32))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = told.value
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column(2).to_numpy(zero_copy_only=False)
            hashes, place, doc = _tokens(batch.column(3).to_pylist())
            learn = ~held[doc]
            rows = cut(UNIGRAMS, block, hashes, np.bincount(place[learn], minlength=len(hashes)))
            keys, at, spread = _pairs(hashes, place, doc, frequent)
            for kind, own in ((BIGRAMS, ~spread), (SPREAD, spread)):
                distinct, which = np.unique(keys[own], return_inverse=True)
                rows += cut(kind, block, distinct, np.bincount(which[learn[at[own]]], minlength=len(distinct)))
            ids = batch.column(1)
            known = np.asarray(ids.is_valid())
            about = [batch.column(0).to_numpy().astype(np.int64), ids.fill_null(0).to_numpy().astype(np.int64)]
            flags = known.astype(np.uint8) | held.astype(np.uint8) << 1
            lengths = np.bincount(doc, minlength=batch.num_rows).astype(np.int64)
            rows.append(_row(TOKENS, block % 65521, block, batch.num_rows, len(hashes), _pack_sorted(hashes), _planes(place.astype(np.uint32)), _planes(np.concatenate([lengths, *about])), flags.tobytes()))
            for i in range(0, len(rows), 256):
                yield _record(rows[i : i + 256])
            block += 1

    return run


def _level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), 0 for none."""
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def _read_back(keys: np.ndarray, level: np.ndarray, order: int, shard_bits: int) -> np.ndarray:
    """Levels of a shard's ascending keys as its part of the filter gives them, built and probed region by region."""
    own = keys & np.uint64((1 << (64 - shard_bits)) - 1)
    need = max(1, int(level.sum())) * BITS_PER_ENTRY
    parts = max(0, (-(-need // FILTER_BITS) - 1).bit_length())
    shift = 64 - shard_bits - parts
    out = np.zeros(len(keys), np.int64)
    bounds = np.searchsorted(own, np.arange((1 << parts) + 1, dtype=np.uint64) << np.uint64(shift)) if parts else [0, len(own)]
    for start, end in zip(bounds[:-1], bounds[1:]):
        entries = int(level[start:end].sum())
        if not entries:
            continue
        low = own[start:end] & np.uint64((1 << shift) - 1)
        bits = max(6, (entries * BITS_PER_ENTRY - 1).bit_length())
        held = level[start:end] > 0
        batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([order], pa.int32()), pa.array([_pack_sorted(low[held])]), pa.array([_planes(level[start:end][held].astype(np.uint8))])], ["region", "order", "a", "b"])
        (region,) = _fill(LEAST_LEVEL, shift, bits)(iter([batch]))
        part = Model(0, 0, 0.0, LEAST_LEVEL, shift, bits, np.frombuffer(region.column(1)[0].as_py(), np.uint8))
        out[start:end] = part.levels(order, low)
    return out


def _add_up(shard_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        for batch in batches:
            for kind, shard, block, x, y, a, b, c, d in zip(*(col.to_pylist() for col in batch.columns)):
                if kind == TOKENS:
                    yield _record([(kind, shard, block, x, y, a, b, c, d)])
                else:
                    got[kind, shard].append((block, a, b))
        for kind, shard in sorted(got):
            parts = sorted(got.pop((kind, shard)), key=lambda p: p[0])
            lists = [_unpack_sorted(p[1]) for p in parts]
            keys, place = np.unique(np.concatenate(lists), return_inverse=True)
            total = np.bincount(place, np.concatenate([_unplanes(p[2], np.uint32) for p in parts]), len(keys)).astype(np.int64)
            true = _level(total)
            read = _read_back(keys, true, min(kind, BIGRAMS), shard_bits).astype(np.uint8)
            rows = []
            if kind == UNIGRAMS:
                rows += [_row(COUNTED, kind, q, int((true == q).sum()), int(total[true == q].sum())) for q in np.unique(true[true > 0]).tolist()]
            else:
                followed = _counts(true)
                first = keys >> np.uint64(32) if kind == BIGRAMS else keys & np.uint64(0xFFFFFFFF)
                names, group = np.unique(first, return_inverse=True)
                sums = np.bincount(group, followed, len(names))
                different = np.bincount(group, true > 0, len(names))
                if kind == SPREAD:
                    rows.append(_row(FREQUENT, 0, 0, len(names), 0, _planes(names), _planes(sums), _planes(different)))
            start = 0
            for (block, _, _), own in zip(parts, lists):
                mine = place[start : start + len(own)]
                start += len(own)
                if kind == UNIGRAMS:
                    rows.append(_row(TOTALS, shard, block, 0, 0, _planes(total[mine].astype(np.uint64))))
                rows.append(_row((LEVELS_1, LEVELS_2, LEVELS_S)[kind], shard, block, 0, 0, _planes(read[mine])))
                if kind == BIGRAMS:
                    g = group[mine]
                    g = g[np.r_[True, g[1:] != g[:-1]]]
                    rows.append(_row(FOLLOWERS, shard, block, 0, 0, _planes(sums[g]), _planes(different[g])))
                if len(rows) >= 256:
                    yield _record(rows)
                    rows = []
            if rows:
                yield _record(rows)

    return run


@dataclass
class Model:
    """A part of the filter, and counts of its corpus."""

    n: int
    v: int
    weight: float
    least: tuple[int, int]
    region_shift: int
    region_bits: int
    filter: np.ndarray

    def levels(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Level of each key, by probing until a level is missing (0: the first is)."""
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for level in range(1, LEVELS):
            base, g, step = _start(keys[alive], order, level, self.region_shift, self.region_bits)
            for _ in range(HASHES):
                at = base | (g & np.uint64((1 << self.region_bits) - 1))
                there = self.filter[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
                if not there.all():
                    alive, base, g, step = alive[there], base[there], g[there], step[there]
                    if not len(alive):
                        return out
                g = g + step
            out[alive] = level
        return out


def _start(keys: np.ndarray, order: int, level: int, region_shift: int, region_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first bit of the keys' regions, and the first and the step of their hashes at a level."""
    g = _mixed(keys + np.uint64((order * 64 + level) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    base = keys >> np.uint64(region_shift) << np.uint64(region_bits) if region_shift < 64 else np.zeros(len(keys), np.uint64)
    return base, g, (g >> np.uint64(32)) | np.uint64(1)


def _counts(level: np.ndarray) -> np.ndarray:
    """The count that stands for a level."""
    return np.where(level > 1, 1.5 * 2.0 ** (level - 1) - 0.5, level)


def _fill(least: tuple[int, int], region_shift: int, region_bits: int):
    """Regions of the filter, each from its tables of n-grams and levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions: dict[int, np.ndarray] = {}
        for batch in batches:
            for region, order, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                bits = regions.setdefault(region, np.zeros(1 << region_bits, bool))
                keys, held = _unpack_sorted(a), _unplanes(b, np.uint8)
                keys, held = keys[held >= least[order]], held[held >= least[order]]
                for level in range(1, int(held.max(initial=0)) + 1):
                    _, g, step = _start(keys[held >= level], order, level, region_shift, region_bits)
                    for _ in range(HASHES):
                        bits[(g & np.uint64((1 << region_bits) - 1)).astype(np.int64)] = True
                        g = g + step
        for region, bits in regions.items():
            yield pa.RecordBatch.from_arrays([pa.array([region], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["region", "bitmap"])

    return run


def _frequent(docs: DataFrame, shards: int) -> np.ndarray:
    """Hashes (upper 32 bits), ascending, of the words that a sample finds frequent; they decide where counts are added up, not what they are."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes, place, _ = _tokens(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array((hashes >> np.uint64(32)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(hashes)))], ["h", "n"])

    counted = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = written(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    few = counted.filter(F.col("n") > total * FREQUENT_SHARE / shards).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT)
    return np.sort(few.select("h").toArrow()["h"].to_numpy().astype(np.uint64))


def _known(added: DataFrame) -> dict:
    """What all blocks need: exact n and v, the sum that the unigrams' levels stand for, and followers of the frequent words (bounded)."""
    levels = added.filter(F.col("kind") == COUNTED).groupBy("block").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()
    stands = sum(int(r["x"]) * float(_counts(np.array([r["block"]]))[0]) for r in levels)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, c in zip(*(col.to_pylist() for col in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(_unplanes(a, np.uint64).astype(np.int64)), pa.array(_unplanes(b, np.float64)), pa.array(_unplanes(c, np.float64))], ["h", "s", "t"])

    rows = added.filter(F.col("kind") == FREQUENT).select("a", "b", "c").mapInArrow(listed, "h long, s double, t double")
    got = rows.groupBy("h").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).orderBy("h").toArrow()
    followers = tuple(got[c].to_numpy() for c in ("h", "s", "t"))
    return {"n": sum(r["y"] for r in levels), "v": sum(r["x"] for r in levels), "stands": stands, "followers": followers}


SCORED = "row_key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score_blocks(told, shared):
    """Scores of each block's documents, from its tokens and what the shards sent it."""

    def finish(tokens: tuple, sent: dict[int, list[tuple]]) -> pa.RecordBatch:
        frequent, known = told.value, shared.value
        rows, _, a, b, c, flags = tokens

        def joined(kind: int, column: int, of: type) -> np.ndarray:
            parts = [_unplanes(p[column], of) for p in sorted(sent.get(kind, ()))]
            return np.concatenate(parts) if parts else np.empty(0, of)

        hashes, place = _unpack_sorted(a), _unplanes(b, np.uint32).astype(np.int64)
        lengths, row_key, doc_id = _unplanes(c, np.int64).reshape(3, rows)
        flags = np.frombuffer(flags, np.uint8)
        doc = np.repeat(np.arange(rows), lengths)
        total = joined(TOTALS, 1, np.uint64).astype(float)
        base = np.bincount(doc, np.log10(total + 1)[place], rows) - lengths * np.log10(known["n"] + known["v"] + 1)
        seen = np.bincount(doc, (total > 0)[place], rows).astype(np.int64)

        alone = (_counts(joined(LEVELS_1, 1, np.uint8).astype(np.int64)) + 1) / (known["stands"] + known["v"] + 1)
        p = alone[place]
        keys, at, spread = _pairs(hashes, place, doc, frequent)
        for kind, own in ((LEVELS_2, ~spread), (LEVELS_S, spread)):
            if not own.any():
                continue
            distinct, which = np.unique(keys[own], return_inverse=True)
            counts = _counts(joined(kind, 1, np.uint8).astype(np.int64))[which]
            if kind == LEVELS_2:
                first = distinct >> np.uint64(32)
                run = np.cumsum(np.r_[True, first[1:] != first[:-1]]) - 1
                s, t = (joined(FOLLOWERS, k, np.float64)[run][which] for k in (1, 2))
            else:
                names, sums, different = known["followers"]
                where = np.searchsorted(names, (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64))
                s, t = sums[where][which], different[where][which]
            use = s > 0
            here = at[own][use]
            p[here] = (counts[use] + t[use] * p[here]) / (s[use] + t[use])
        score = np.bincount(doc, np.log10(p), rows)
        ids = pa.array(doc_id, mask=flags & 1 == 0)
        return pa.RecordBatch.from_arrays([pa.array(row_key), ids, pa.array(flags & 2 > 0), pa.array(lengths), pa.array(seen), pa.array(base), pa.array(score)], [c.split()[0] for c in SCORED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tokens, sent = None, None, defaultdict(list)
        for batch in batches:
            for kind, shard, at, x, y, a, b, c, d in zip(*(col.to_pylist() for col in batch.columns)):
                if at != block:
                    if tokens:
                        yield finish(tokens, sent)
                    block, tokens, sent = at, None, defaultdict(list)
                if kind == TOKENS:
                    tokens = (x, y, a, b, c, d)
                else:
                    sent[kind].append((shard, a, b))
        if tokens:
            yield finish(tokens, sent)

    return run


def score(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``docs``."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % PARTS == HELD_OUT, F.lit(False))
    rows = docs.select(scan_id().alias("row_key"), F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard_bits = max(3, (max(1, -(-size // SHARD_BYTES)) - 1).bit_length())
    told = spark.sparkContext.broadcast(_frequent(docs, 1 << shard_bits))
    counted = rows.mapInArrow(_count_blocks(shard_bits, told), BLOCK)
    # Shards spread by number; a block's tokens only pass through and are spread likewise.
    added = written(counted.repartitionById(1 << shard_bits, F.col("shard")).mapInArrow(_add_up(shard_bits), BLOCK))
    known = _known(added)
    parts = added.filter(F.col("kind").between(TOKENS, FOLLOWERS))
    parts = parts.repartition(1 << shard_bits, "block").sortWithinPartitions("block")
    out = parts.mapInArrow(_score_blocks(told, spark.sparkContext.broadcast(known)), SCORED)
    return out.select("row_key", "doc_id", "held_out", "n_tokens", "n_known", F.lit(known["n"]).cast("long").alias("train_tokens"), "base_score", "score")
