"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of the hashes of all runs of ``GRAM`` words, winnowing keeps the least one (the
rightmost on ties) of every ``WINDOW - GRAM + 1`` consecutive ones. Any shared span
of ``WINDOW`` words therefore shares a kept hash at the same place. Documents keep
the grams whose hash a bitmap of the benchmark's kept hashes knows and that
winnowing selects; each is extended to the windows that selected it, and these are
joined with the benchmark's windows on kept hash and hash of the whole window.

Items shorter than a window are one window of their own length; documents look for
those at every place, by the bitmap of that length.

Edge cases: null text has no words; items without words are left out; items without
an id count as hits and are not listed; repeated windows and items are one; repeated
rows of documents are answered one by one; an empty benchmark or document table
gives clean documents or none; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, scan_id, written

WINDOW = 10
GRAM = 5
#: Bits of the bitmap by which documents skip grams that no benchmark window kept: eight a window, within these bounds. It decides no result.
BITMAP_BITS, MOST_BITMAP_BITS = 1 << 18, 1 << 22
#: Benchmark windows, and item ids in them, up to which they are broadcast (about 100 MB).
BROADCAST_WINDOWS = 500_000
BROADCAST_IDS = 4_000_000
#: Everything below 0x80 that is neither digit nor letter, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text (null: none)."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _hashed(df: DataFrame) -> DataFrame:
    """Adds ``wh``, the word hashes, and ``g``, the gram hashes."""
    df = df.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))
    picks = ", ".join(f"get(wh, i + {k})" for k in range(GRAM))
    grams = f"CASE WHEN size(wh) >= {GRAM} THEN transform(sequence(0, size(wh) - {GRAM}), i -> xxhash64({picks})) ELSE cast(array() AS array<bigint>) END"
    return df.withColumn("g", F.expr(grams))


SPAN = WINDOW - GRAM + 1


def windows(benchmark: DataFrame) -> DataFrame:
    """(gram, span, len, items): the distinct windows of all items with the ids that hold them."""
    items = _hashed(benchmark.select("item_id", words(F.col("text")).alias("words")).filter("size(words) > 0"))
    long = f"transform(sequence(0, size(wh) - {WINDOW}), j -> named_struct('gram', array_min(slice(g, j + 1, {SPAN})), 'span', xxhash64(slice(wh, j + 1, {WINDOW})), 'len', {WINDOW}))"
    short = "array(named_struct('gram', 0L, 'span', xxhash64(wh), 'len', size(wh)))"
    rows = items.select("item_id", F.explode(F.expr(f"CASE WHEN size(wh) >= {WINDOW} THEN {long} ELSE {short} END")).alias("w"))
    return rows.groupBy("w.gram", "w.span", "w.len").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _bits_for(n: int) -> int:
    return min(MOST_BITMAP_BITS, max(BITMAP_BITS, 1 << (8 * n - 1).bit_length()))


def _bitmap(hashes: DataFrame, size: int) -> str:
    """SQL text of an array of 64-bit words in which the bits of ``hashes`` (h) are set, of ``size`` bits in all."""
    word = F.shiftright(F.col("h").bitwiseAND(F.lit(size - 1)), 6)
    bit = F.expr("shiftleft(1L, cast(h & 63 AS int))")
    rows = hashes.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits")).collect()
    out = [0] * (size // 64)
    for r in rows:
        out[r["w"]] = r["bits"]
    return f"cast(split('{','.join(map(str, out))}', ',') AS array<bigint>)"


def _known(bitmap: str, h: str, size: int) -> str:
    return f"(shiftright(get({bitmap}, cast(shiftright({h} & {size - 1}L, 6) AS int)), cast({h} & 63 AS int)) & 1) = 1"


def _candidates(bench: DataFrame) -> str:
    """SQL text: the windows of a document (wh, g) that the benchmark may hold."""
    parts = []
    lengths = {r["len"]: _bits_for(r["n"]) for r in bench.groupBy("len").agg(F.count(F.lit(1)).alias("n")).orderBy("len").collect()}
    if WINDOW in lengths:
        bitmap = _bitmap(bench.filter(F.col("len") == WINDOW).select(F.col("gram").alias("h")), lengths[WINDOW])
        first, last = f"greatest(0, i - {SPAN - 1})", f"least(i, size(wh) - {WINDOW})"
        # Gram i is what winnowing keeps of window j: none to its left is less, none to its right as little.
        kept = f"forall(sequence(j, j + {SPAN - 1}), t -> CASE WHEN t <= i THEN get(g, t) >= get(g, i) ELSE get(g, t) > get(g, i) END)"
        own = f"transform(filter(sequence({first}, {last}), j -> {kept}), j -> named_struct('gram', get(g, i), 'span', xxhash64(slice(wh, j + 1, {WINDOW})), 'start', j, 'len', {WINDOW}))"
        known = f"filter(sequence(0, size(g) - 1), i -> {_known(bitmap, 'get(g, i)', lengths[WINDOW])})"
        parts.append((WINDOW, f"flatten(transform({known}, i -> {own}))"))
    for n in (n for n in lengths if n < WINDOW):
        bitmap = _bitmap(bench.filter(F.col("len") == n).select(F.col("span").alias("h")), lengths[n])
        spans = f"transform(sequence(0, size(wh) - {n}), j -> named_struct('gram', 0L, 'span', xxhash64(slice(wh, j + 1, {n})), 'start', j, 'len', {n}))"
        parts.append((n, f"filter({spans}, x -> {_known(bitmap, 'x.span', lengths[n])})"))
    none = "cast(array() AS array<struct<gram: bigint, span: bigint, start: int, len: int>>)"
    return "concat(" + ", ".join([none, *(f"CASE WHEN size(wh) >= {n} THEN {x} ELSE {none} END" for n, x in parts)]) + ")"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row_key, text_hash, doc_id, n_words, n_hit, items) for every row of ``docs``."""
    bench = written(windows(benchmark))
    size = bench.agg(F.count(F.lit(1)), F.sum(F.size("items"))).first()
    found = _hashed(docs.select(scan_id().alias("row_key"), F.xxhash64("text").alias("text_hash"), "doc_id", words(F.col("text")).alias("words")))
    found = written(found.select("row_key", "text_hash", "doc_id", F.size("wh").cast("long").alias("n_words"), F.expr(_candidates(bench)).alias("found")))
    small = size[0] <= BROADCAST_WINDOWS and (size[1] or 0) <= BROADCAST_IDS
    bench = bench.select("gram", "span", "len", "items")
    seeds = found.select("row_key", F.explode("found").alias("f")).select("row_key", "f.*")
    hits = seeds.join(F.broadcast(bench) if small else bench, ["gram", "span", "len"])
    hits = hits.groupBy("row_key").agg(
        F.collect_set(F.struct("start", "len")).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.flatten(F.transform("at", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))
    hits = hits.select("row_key", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), "items")
    none = F.array().cast(hits.schema["items"].dataType)
    out = found.drop("found").join(hits, "row_key", "left")
    return out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", none))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``contamination``, a row per document."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that no benchmark window occurs in; columns as they were."""
    bad = contamination(docs, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = rows.join(bad, doc_id.eqNullSafe(F.col("bad_id")) & (F.xxhash64(text) == F.col("bad_hash")), "left_anti")
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS k
       FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(j) WHERE len(w) > 0),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, j, array_to_string(w[j:j + m - 1], ' ') AS k FROM d, lens, unnest(range(1, len(w) - m + 2)) AS u(j)),
hit AS (SELECT dw.doc_id, dw.j, dw.m, bw.item_id FROM dw JOIN bw USING (m, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + m)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
