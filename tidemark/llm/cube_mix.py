"""Mixing sources to target weights by cube-method balanced sampling.

Every document has an expected number of copies: its source's target over its
source's size. The whole part is taken outright; the fractional part is an
inclusion probability. The flight phase of the cube method moves the vector of
these probabilities along the null space of the balancing constraints (documents
and words of a source) until at most two fractions are left; these few are the
landing problem.

The flight runs in bounded blocks of one source (a block is one task's work, a
hot source simply has more blocks). The fractions that a block leaves go to the
next, coarser level; each level shrinks them by three orders of magnitude, so two
or three levels do for any corpus.

Edge cases: null or blank text has size 0 and is never taken; the null source is a
source of its own and comes last; repeated rows are sampled as separate units; an
empty table gives an empty mix; further columns are ignored by ``mix`` and kept by
``apply_mix``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all sizes that the mix amounts to.
BUDGET = 1.5
#: No source, and no document, is taken more often than this.
MOST_COPIES = 2.0
#: Documents whose fractions one task settles at a time.
BLOCK = 4096
#: Blocks that the next level joins into one; each leaves two fractions at most.
FAN_IN = 1024
#: Documents that the landing decides besides those that the last flight leaves.
LANDING = 12
#: Below this a fraction counts as 0, above its complement as 1.
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST_COPIES,
) -> DataFrame:
    """(source, source_size, n_docs, target): one row per source.

    Resharing the excess by weight until no source is above its bound is water
    filling: target = min(level * weight, most * size). Sources in the order of
    most * size / weight fill up first, so one running sum finds the level.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (F.lit(float(budget)) * total - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    by = by.withColumn("level", level)
    # The first source that its share does not fill settles the level of all later ones.
    settled = F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct(F.col("bound") / F.col("weight"), F.col("level")))).over(Window.partitionBy())
    by = by.withColumn("settled", settled["level"])
    target = F.coalesce(F.least(F.col("settled") * F.col("weight"), F.col("bound")), F.col("bound"))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def _flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Flight phase in place: afterwards at most two entries are fractions."""
    live: list[int] = []
    p = prob.tolist()
    z = size.tolist()
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            # Null space of the rows (1, 1, 1) and (z_a, z_b, z_c).
            u = (z[b] - z[c], z[c] - z[a], z[a] - z[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = math.inf
            for k, x in zip(live, u):
                if x > 0:
                    up, down = min(up, (1 - p[k]) / x), min(down, p[k] / x)
                elif x < 0:
                    up, down = min(up, p[k] / -x), min(down, (1 - p[k]) / -x)
            step = up if next(draws, 0.5) * (up + down) < down else -down
            for k, x in zip(live, u):
                p[k] += step * x
                if p[k] < EPS or p[k] > 1 - EPS:
                    p[k] = float(round(p[k]))
            live = [k for k in live if 0 < p[k] < 1]
    prob[:] = p


def _land(prob: np.ndarray, size: np.ndarray) -> None:
    """Landing in place: of all roundings of the open entries the one nearest in words and documents."""
    open_ = np.flatnonzero((prob > EPS) & (prob < 1 - EPS))
    picks = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    words = np.abs(picks @ size[open_] - prob[open_] @ size[open_])
    count = np.abs(picks.sum(axis=1) - prob[open_].sum())
    prob[open_] = picks[np.argmin(words / max(1.0, size.mean()) + 0.1 * count)]
    prob[:] = np.round(prob)


def _settle(last: bool, seed: int):
    def block(key: tuple, rows: pa.Table) -> pa.Table:
        size, tie = rows["size"].to_numpy().astype(float), rows["tie"].to_numpy()
        # Long documents first: the fractions left over then belong to short ones.
        order = np.lexsort((tie, -size))
        prob = rows["prob"].to_numpy()[order]
        size = size[order]
        fly = np.ones(len(prob), bool)
        if last or key[1].as_py() == 0:
            # Some of each size stay out of all flights, so that the landing can even out what they leave.
            fly[np.unique(np.linspace(0, len(prob) - 1, LANDING).astype(int))] = False
        flown = prob[fly]
        _flight(flown, size[fly], np.random.default_rng([seed, int(tie.min()) & 0xFFFFFFFF, len(tie)]))
        prob[fly] = flown
        if last:
            _land(prob, size)
        out = np.empty_like(prob)
        out[order] = prob
        return rows.set_column(rows.schema.get_field_index("prob"), "prob", pa.array(out))

    return block


def _row_key(docs: DataFrame) -> Column:
    """Hash of all columns by position; of what has no hash of its own (maps), that of its JSON."""
    parts = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        parts.append(F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c)
    return F.xxhash64(*parts)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """(row_key, doc_id, source, size, source_size, target, copies, taken), a row per row of ``docs``.

    ``row_key`` is a hash of the row's content; draws and blocks follow it alone,
    so that reruns agree however the rows are dealt over tasks.
    """
    sized = written(docs.select(_row_key(docs).alias("row_key"), "doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = written(source_targets(sized, weights, budget, most))
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    levels = [max(1, -(-largest // BLOCK))]
    while levels[-1] > 1:
        levels.append(-(-levels[-1] // FAN_IN))

    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "n_docs")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    units = sized.join(t, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("rate", rate)
    units = units.withColumn("whole", F.floor(F.col("rate") + F.lit(EPS)))
    units = units.withColumn("prob", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    units = units.withColumn("tie", F.xxhash64("row_key", F.lit(seed)))
    # A source's own number of blocks keeps every block full; level k joins FAN_IN of them.
    own = F.greatest(F.ceil(F.col("n_docs") / F.lit(BLOCK)), F.lit(1))
    kept = ["row_key", "doc_id", "source", "size", "source_size", "target", "whole", "prob", "tie", "block"]
    units = units.withColumn("block", F.pmod(F.col("tie"), own)).select(*kept)

    settled: list[DataFrame] = []
    for k, n in enumerate(levels):
        units = units.groupBy("source", "block").applyInArrow(_settle(n == 1, seed + k), units.schema)
        if n > 1:
            units = written(units)
            fraction = (F.col("prob") > 0) & (F.col("prob") < 1)
            settled.append(units.filter(~fraction))
            units = units.filter(fraction).withColumn("block", F.floor(F.col("block") / F.lit(FAN_IN))).select(*kept)
    for part in settled:
        units = units.unionByName(part)
    copies = F.col("whole") + F.round("prob").cast("long")
    return units.select("row_key", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, each once, with ``copies``: how often it is to be read.

    Rows that repeat each other in every column come as one row with their copies added
    up. Where ``docs`` has a column ``copies``, the new one has underscores at its end.
    """
    def free(name: str) -> str:
        while name in {c.lower() for c in docs.columns}:
            name += "_"
        return name

    # Columns keep their names: aliases of all that the key hashes would be substituted in it, in every combination.
    key, added = free("mix_row_key"), free("copies")
    plan = mix(docs, **options).filter("copies > 0").groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").alias(added))
    return docs.withColumn(key, _row_key(docs)).join(plan, key).dropDuplicates([key]).select(*docs.columns, added)
