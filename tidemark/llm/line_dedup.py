"""Line dedup by a suffix array over line ids, in DataFrame operations only.

Each line is an id (its hash); the corpus is the sequence of all documents' lines in
the order of doc_id, and a suffix ends with its document. Prefix doubling sorts the
suffixes: the rank of the first 2k lines of a suffix comes from the ranks of its first k
lines and of the k lines that follow. Ranks are given by a range-partitioned sort of the
distinct pairs, never by a window over everything. Suffixes whose rank is theirs alone
are unique from there on and drop out; doubling ends when none is left.

The ranks of all rounds then give the intervals of common prefixes, from the longest
down: suffixes that agree in the next 2^k lines move to an interval that much deeper,
and the first of them stays behind to stand for them where they came from. What a suffix
shares with an earlier one, its repeat, is the depth of the deepest interval in which it
isn't first. A repeat that is no tail of the one a line before is a maximal run.

The lines of all repeats of ``min_lines`` or more are deleted: later copies go, the
first occurrence stays.

Edge cases: null text has no lines and stays; an empty text is one empty line; runs
do not cross documents; rows that repeat both doc_id and text are one document;
documents with equal ids follow each other by the hash of their text; null ids come
first; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_counted, without, written

#: Shortest run of lines whose later copies are deleted.
MIN_LINES = 2
KEY = ["doc_id", "text_hash"]


def line_table(docs: DataFrame) -> DataFrame:
    """(pos, i, left, line, doc_id, text_hash): line ids; pos rises with the order of the corpus, by one within a document.

    ``i`` is a line's number and ``left`` how many lines there are from it on.
    """
    ids = F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), ids.alias("ids")).filter("ids IS NOT NULL").dropDuplicates(KEY)
    rows = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    lines = rows.select(*KEY, F.size("ids").alias("n"), F.posexplode("ids").alias("i", "line"))
    # The id follows partition and place in the sorted partition; a document lies within one.
    return lines.select(F.monotonically_increasing_id().alias("pos"), "i", (F.col("n") - F.col("i")).alias("left"), "line", *KEY)


def _ranked(rows: DataFrame, key: list[str]) -> tuple[DataFrame, int]:
    """Rows (pos, left, *key) of shared keys, with ``rank`` in their order and ``first``, the first pos of each; and how many rows."""
    classes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).filter("n > 1")
    classes = written(classes.repartitionByRange(*key).sortWithinPartitions(*key).select(*key, "n", F.monotonically_increasing_id().alias("rank"), "first"))
    n = classes.agg(F.sum("n")).first()[0] or 0
    if len(key) > 1:
        # One column to join on, so that frequent classes can be joined where their rows are.
        both = F.struct(*key).alias("key")
        rows, classes = rows.select("pos", "left", both), classes.select(both, "n", "rank", "first")
        key = ["key"]
    return join_counted(rows, classes, key[0], n).select("pos", "left", "rank", "first"), n


def suffix_ranks(lines: DataFrame) -> tuple[list[DataFrame], int]:
    """For k = 0, 1, ...: (pos, left, rank, first) of the suffixes that share their first 2^k lines with another; and how many for k = 0."""
    ranks, n = _ranked(lines.select("pos", "left", "line"), ["line"])
    out, total = [], n
    while n:
        out.append(written(ranks))
        step = 1 << len(out) - 1
        on = out[-1].select((F.col("pos") - step).alias("pos"), F.col("rank").alias("r2"))
        pairs = out[-1].filter(F.col("left") > step).join(on, "pos").select("pos", "left", F.col("rank").alias("r1"), "r2")
        ranks, n = _ranked(written(pairs), ["r1", "r2"])
    return out, total


def _deeper(intervals: DataFrame, ranks: DataFrame, step: int, total: int) -> DataFrame:
    """Intervals (at, pos, left, depth) after those of their suffixes that agree in ``step`` lines more have an interval of their own."""
    on = ranks.select(F.col("pos").alias("then"), "rank")
    rows = written(intervals.withColumn("then", F.when(F.col("left") > F.col("depth"), F.col("pos") + F.col("depth"))).join(on, "then", "left").drop("then"))
    split = rows.filter("rank IS NOT NULL").withColumn("to", F.xxhash64("at", "rank", F.lit(step)))
    groups = written(split.groupBy("to").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("least")))
    split = join_counted(split, groups.withColumn("many", F.col("n") > 1), "to", total)
    down = split.filter("many").select(F.col("to").alias("at"), "pos", "left", (F.col("depth") + step).alias("depth"))
    kept = ["at", "pos", "left", "depth"]
    return down.unionByName(split.filter("pos = least").select(*kept)).unionByName(rows.filter("rank IS NULL").select(*kept))


def repeats(lines: DataFrame) -> DataFrame:
    """(pos, length): for each suffix that shares lines with an earlier one, the most that it shares."""
    levels, total = suffix_ranks(lines)
    intervals, longer = None, None
    for k in range(len(levels) - 1, -1, -1):
        if intervals is not None:
            intervals = _deeper(intervals, levels[k], 1 << k, total)
        # Later copies at twice the depth are in an interval below; the others start here.
        here = levels[k] if longer is None else levels[k].join(longer, "pos", "left_anti")
        here = here.select(F.xxhash64("rank", F.lit(-1 - k)).alias("at"), "pos", "left", F.lit(1 << k).alias("depth"))
        intervals = written(here if intervals is None else intervals.unionByName(here))
        longer = levels[k].filter("pos != first").select("pos")
    if intervals is None:
        return lines.select("pos", F.lit(0).alias("length")).limit(0)
    least = written(intervals.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("least")))
    later = join_counted(intervals, least, "at", total).filter("pos != least")
    return written(later.groupBy("pos").agg(F.max("depth").alias("length")))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text_hash, runs, maximal): for each document with later copies the islands (a, b) of such lines, and its maximal runs (a, b)."""
    lines = written(line_table(docs))
    found = repeats(lines).join(lines.select("pos", "i", *KEY), "pos")
    # A document's lines follow each other, so its first pos names it.
    found = found.withColumn("doc", F.col("pos") - F.col("i"))
    order = Window.partitionBy("doc").orderBy("i")
    before = F.when(F.lag("i").over(order) == F.col("i") - 1, F.lag("length").over(order))
    found = found.withColumn("maximal", (F.col("length") >= F.coalesce(before, F.lit(0))))
    found = found.filter(F.col("length") >= min_lines).withColumn("end", F.col("i") + F.col("length") - 1)
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce(F.col("i") > reach + 1, F.lit(True)).cast("int"))
    found = found.withColumn("run", F.sum("new").over(order))
    of_run = found.groupBy("doc", *KEY, "run").agg(F.min("i").alias("a"), F.max("end").alias("b"), F.collect_list(F.when(F.col("maximal"), F.struct(F.col("i").alias("a"), F.col("end").alias("b")))).alias("m"))
    by = of_run.groupBy("doc", *KEY).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"), F.sort_array(F.flatten(F.collect_list("m"))).alias("maximal"))
    return by.drop("doc")


def cleaned(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs``, by position c0, c1, ..., with n_lines, runs and maximal (null if none) and clean_text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    runs = repeated_runs(docs, min_lines).select(F.col("doc_id").alias("run_id"), F.col("text_hash").alias("run_hash"), "runs", "maximal")
    rows = rows.join(runs, doc_id.eqNullSafe(F.col("run_id")) & (F.xxhash64(text) == F.col("run_hash")), "left")
    lines = F.split(text, "\n")
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["a"], r["b"])))
    clean = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(without(lines, gone), "\n"))
    return rows.select(*names, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), "runs", "maximal", clean.alias("clean_text"))


def _removed() -> Column:
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"] + 1)
    return F.coalesce(total, F.lit(0).cast("long"))


def report(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, longest_run, clean_sha256) for every row; runs are maximal ones."""
    got = cleaned(docs.select("doc_id", "text"), min_lines)
    longest = F.array_max(F.transform("maximal", lambda r: r["b"] - r["a"] + 1))
    return got.select(
        F.col("c0").alias("doc_id"),
        F.when(F.col("c1").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        _removed().alias("n_removed"),
        F.coalesce(F.size("maximal"), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce(longest, F.lit(0)).cast("long").alias("longest_run"),
        F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"),
    )


def remove_repeats(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` without later copies of runs of lines; n_chars, if there, follows the text.

    Documents of which no line is left are dropped.
    """
    got = cleaned(docs, min_lines).filter(F.col("runs").isNull() | (_removed() < F.col("n_lines")))
    out = []
    for i, c in enumerate(docs.columns):
        col = F.col(f"c{i}")
        if c == "text":
            col = F.col("clean_text")
        elif c == "n_chars":
            col = F.when(F.col("runs").isNull(), col).otherwise(F.char_length("clean_text").cast(docs.schema[c].dataType))
        out.append(col.alias(c))
    return got.select(*out)


ORACLE = """
WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, i, line, dense_rank() OVER (ORDER BY line) AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(ls) WITH ORDINALITY AS u(line, i)),
r(d, doc_id, i, c) AS (SELECT 1, doc_id, i, c FROM (SELECT *, count(*) OVER (PARTITION BY c) AS n FROM l) WHERE n > 1
  UNION ALL SELECT d, doc_id, i, dense_rank() OVER (ORDER BY c, nc) FROM (SELECT r.d + 1 AS d, r.doc_id, r.i, r.c, l.c AS nc, count(*) OVER (PARTITION BY r.c, l.c) AS n FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + r.d) WHERE n > 1),
lpf AS (SELECT doc_id, i, max(d) AS len FROM (SELECT *, row_number() OVER (PARTITION BY d, c ORDER BY doc_id, i) AS k FROM r) WHERE k > 1 GROUP BY doc_id, i),
del AS (SELECT DISTINCT doc_id, unnest(range(i, i + len)) AS i FROM lpf WHERE len >= 2),
gone AS (SELECT doc_id, count(*) AS n_removed FROM del GROUP BY doc_id),
runs AS (SELECT a.doc_id, count(*) AS n_runs, max(a.len) AS longest FROM lpf a LEFT JOIN lpf b ON b.doc_id = a.doc_id AND b.i = a.i - 1 WHERE a.len >= 2 AND a.len > coalesce(b.len, 0) - 1 GROUP BY a.doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM l ANTI JOIN del USING (doc_id, i) GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest, 0) AS BIGINT) AS longest_run, sha256(coalesce(t, '')) AS clean_sha256
FROM documents d LEFT JOIN gone USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
