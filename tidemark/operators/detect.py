"""The five signatures, as expressions over a pair of profiles.

A pair is one row: a column's profile before (struct b) and after (struct c). All
values of a profile (50 at most) are in that row, so signatures, precedence and
confidence need no shuffle; whatever the number of assets and columns, the only
exchange is the one that pairs the profiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.stats import is_finite, noise_floor, quantile_noise, sigmoid
from tidemark.functions.text import normal_spelling

EVIDENCE = {
    "kind": "string",
    "lost": "double",
    "gained": "double",
    "match": "double",
    "respelled": "int",
    "total_variation": "double",
    "distance": "double",
    "median_shift": "double",
    "factor": "double",
    "offset": "double",
    "residual": "double",
    "sources": "array<string>",
    "targets": "array<string>",
}
FIELDS = {"signature": "string", "detector_ord": "int", "magnitude": "double", "from_value": "string", "to_value": "string", **EVIDENCE}


def pair(before: DataFrame, after: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(asset, by, column, column_ord, b, c): columns profiled on both sides."""
    inner = ["row_count", "null_count", "distinct_count", "top_k", "numeric"]
    keys = ["asset", *by, "column"]
    b = before.select(*keys, "column_ord", F.struct(*inner).alias("b"))
    c = after.select(*keys, F.struct(*inner).alias("c"))
    return b.join(c, keys)


def _q(side: str, i: int) -> Column:
    return F.get(F.col(f"{side}.numeric.q"), F.lit(i))


def _all_finite() -> Column:
    both = F.concat("b.numeric.q", "c.numeric.q")
    return F.coalesce((F.size(both) == 10) & F.forall(both, lambda x: is_finite(x)), F.lit(False))


def quantile_scale() -> Column:
    """The baseline's spread, or its deviation where that is degenerate; null where both are."""
    floor = C.RELATIVE_SPREAD_EPS * F.greatest(F.abs(_q("b", 2)), F.lit(1.0))
    spread, deviation = _q("b", 4) - _q("b", 0), F.col("b.numeric.stddev")
    return F.when(spread > floor, spread).when(deviation > floor, deviation)


def quantile_distance(scale: Column | None = None) -> Column:
    """Mean absolute quantile move over the baseline's scale; null where it has none."""
    scale = quantile_scale() if scale is None else scale
    moved = sum((F.abs(_q("c", i) - _q("b", i)) for i in range(5)), F.lit(0.0)) / 5
    # Finite quantiles over a scale above zero give a finite distance, unless the sum overflows.
    return F.when(_all_finite() & (moved < F.lit(float("inf"))), moved / scale)


def _d(x: float) -> str:
    return f"{float(x)!r}D"


def _share_sql(count: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN coalesce({count}, 0) / {n} ELSE 0D END"


def _floor_sql(share: str) -> str:
    """Move of a share that sampling explains; 0 where a side is empty."""
    p = f"greatest(0D, least(1D, {share}))"
    return f"CASE WHEN nb > 0 AND nc > 0 THEN {_d(C.SIGNIFICANCE_Z)} * sqrt({p} * (1 - {p}) * (1 / nb + 1 / nc)) ELSE 0D END"


def _symptom_sql(signature: str, **fields: str) -> str:
    fields = {"signature": f"'{signature}'", "detector_ord": str(C.DETECTORS.index(signature)), **fields}
    return "named_struct(" + ", ".join(f"'{k}', cast({fields.get(k, 'NULL')} AS {t})" for k, t in FIELDS.items()) + ")"


_SUM = "aggregate(transform({}, m -> m.{}), 0D, (s, x) -> s + x)"
_FINITE = "coalesce(NOT isnan(x) AND abs(x) < double('Infinity'), false)"

#: What the signatures read, stage by stage: (name, expression, signatures that need it). A stage is one projection.
_BY_MASS, _BY_SPELLING, _BY_QUANTILES = (C.VALUE_SUBSTITUTION, C.SPLIT_MERGE), (C.CASE_FORMAT,), (C.UNIT_SCALE, C.DISTRIBUTION_SHIFT)
_CATEGORICAL = _BY_MASS + _BY_SPELLING


def _covered_sql(side: str, n: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN aggregate(map_values({side}.top_k), 0L, (s, x) -> s + x) / {n} ELSE 0D END) >= {_d(C.MIN_COVERAGE)}"


def _group_sql(side: str, spelled: str, n: str) -> str:
    own = f"filter({spelled}, e -> e.norm = g)"
    return (
        f"'share_{side}', {_share_sql(f'aggregate({own}, 0L, (s, e) -> s + e.n)', n)}, "
        f"'raw_{side}', array_min(transform({own}, e -> named_struct('k', -e.n, 'raw', e.raw))).raw"
    )


_SHARE, _SHIFT = _d(C.MIN_SHARE), _d(C.MIN_SHIFT)
_STAGES = (
    (
        ("nb", "b.row_count - b.null_count", C.DETECTORS),
        ("nc", "c.row_count - c.null_count", C.DETECTORS),
        ("qb", "b.numeric.q", C.DETECTORS),
        ("qc", "c.numeric.q", C.DETECTORS),
        ("counts", "transform(array_union(map_keys(b.top_k), map_keys(c.top_k)), v -> named_struct('value', v, 'b', coalesce(b.top_k[v], 0L), 'c', coalesce(c.top_k[v], 0L)))", _BY_MASS),
        ("norms", "array_distinct(transform(concat(spelled_b, spelled_c), e -> e.norm))", _BY_SPELLING),
    ),
    (
        ("covered", f"{_covered_sql('b', 'nb')} AND {_covered_sql('c', 'nc')} AND size(b.top_k) > 0 AND size(c.top_k) > 0", _CATEGORICAL),
        ("moves", f"transform(counts, m -> named_struct('value', m.value, 'was', {_share_sql('m.b', 'nb')}, 'now', {_share_sql('m.c', 'nc')}, 'least', greatest({_SHIFT}, {_floor_sql('CASE WHEN nb + nc > 0 THEN (m.b + m.c) / (nb + nc) ELSE 0D END')})))", _BY_MASS),
        ("groups", f"transform(norms, g -> named_struct('norm', g, {_group_sql('b', 'spelled_b', 'nb')}, {_group_sql('c', 'spelled_c', 'nc')}))", _BY_SPELLING),
        ("comparable", f"coalesce(size(concat(qb, qc)) = 10 AND forall(concat(qb, qc), x -> {_FINITE}), false)", _BY_QUANTILES),
        ("spread_b", "get(qb, 4) - get(qb, 0)", _BY_QUANTILES),
        ("spread_c", "get(qc, 4) - get(qc, 0)", _BY_QUANTILES),
        ("size_b", "greatest(abs(get(qb, 2)), 1D)", _BY_QUANTILES),
    ),
    (
        ("dropped", f"transform(filter(moves, m -> m.now - m.was <= -m.least AND m.was >= {_SHARE}), m -> named_struct('k', -(m.was - m.now), 'value', m.value, 'mass', m.was - m.now))", _BY_MASS),
        ("gained", f"transform(filter(moves, m -> m.now - m.was >= m.least AND m.now >= {_SHARE}), m -> named_struct('k', -(m.now - m.was), 'value', m.value, 'mass', m.now - m.was))", _BY_MASS),
        ("one_sided", f"exists(groups, g -> (g.share_b >= {_SHARE} AND g.raw_c IS NULL) OR (g.share_c >= {_SHARE} AND g.raw_b IS NULL))", _BY_SPELLING),
        ("variation", "aggregate(transform(groups, g -> abs(g.share_b - g.share_c)), 0D, (s, x) -> s + x) / 2", _BY_SPELLING),
        ("respelled", f"filter(groups, g -> g.share_b >= {_SHARE} AND g.raw_b IS NOT NULL AND g.raw_c IS NOT NULL AND g.raw_b != g.raw_c)", _BY_SPELLING),
        ("affine", f"comparable AND spread_b > 0 AND spread_c > 0 AND spread_b >= {_d(C.NARROW_SPREAD_FLOOR)} * size_b", (C.UNIT_SCALE,)),
        ("moved", "CASE WHEN comparable THEN aggregate(transform(sequence(0, 4), i -> abs(get(qc, i) - get(qb, i))), 0D, (s, x) -> s + x) / 5 END", (C.DISTRIBUTION_SHIFT,)),
        ("scale", f"CASE WHEN spread_b > {_d(C.RELATIVE_SPREAD_EPS)} * size_b THEN spread_b WHEN b.numeric.stddev > {_d(C.RELATIVE_SPREAD_EPS)} * size_b THEN b.numeric.stddev END", (C.DISTRIBUTION_SHIFT,)),
    ),
    (
        ("from_", "array_min(transform(dropped, m -> named_struct('k', m.k, 'value', m.value)))", (C.VALUE_SUBSTITUTION,)),
        ("lost", _SUM.format("dropped", "mass"), (C.SPLIT_MERGE,)),
        ("won", _SUM.format("gained", "mass"), (C.SPLIT_MERGE,)),
        ("split", "size(dropped) = 1 AND size(gained) >= 2", (C.SPLIT_MERGE,)),
        ("merge", "size(dropped) >= 2 AND size(gained) = 1", (C.SPLIT_MERGE,)),
        ("sources", "transform(sort_array(dropped), m -> m.value)", (C.SPLIT_MERGE,)),
        ("targets", "transform(sort_array(gained), m -> m.value)", (C.SPLIT_MERGE,)),
        ("changed", _SUM.format("respelled", "share_b"), _BY_SPELLING),
        ("largest", "array_min(transform(respelled, g -> named_struct('k', -g.share_b, 'norm', g.norm, 'raw_b', g.raw_b, 'raw_c', g.raw_c)))", _BY_SPELLING),
        ("factor", "CASE WHEN affine THEN spread_c / spread_b END", (C.UNIT_SCALE,)),
        ("shift", "CASE WHEN affine THEN get(qc, 2) - get(qb, 2) END", (C.UNIT_SCALE,)),
        ("distance", "CASE WHEN moved < double('Infinity') THEN moved / scale END", (C.DISTRIBUTION_SHIFT,)),
    ),
    (
        ("to_", "array_min(transform(gained, m -> named_struct('k', abs(m.mass + from_.k), 'value', m.value, 'mass', m.mass)))", (C.VALUE_SUBSTITUTION,)),
        ("mult", "CASE WHEN affine THEN array_max(transform(sequence(0, 4), i -> abs(get(qc, i) - factor * get(qb, i)))) / spread_c END", (C.UNIT_SCALE,)),
        ("add", "CASE WHEN affine THEN array_max(transform(sequence(0, 4), i -> abs(get(qc, i) - (get(qb, i) + shift)))) / spread_c END", (C.UNIT_SCALE,)),
        ("reach", "CASE WHEN affine THEN abs(shift) / spread_b END", (C.UNIT_SCALE,)),
    ),
    (
        ("match", "least(-from_.k, to_.mass) / greatest(-from_.k, to_.mass)", (C.VALUE_SUBSTITUTION,)),
        ("is_mult", f"mult <= {_d(C.FIT_TOLERANCE)} AND abs(factor - 1) >= {_d(C.MULTIPLY_TOLERANCE)}", (C.UNIT_SCALE,)),
        ("is_add", f"add <= {_d(C.FIT_TOLERANCE)} AND reach >= {_d(C.ADD_TOLERANCE)}", (C.UNIT_SCALE,)),
    ),
)
_AS_MULT = "is_mult AND (NOT is_add OR mult <= add)"
_QUANTILE_NOISE = f"CASE WHEN least(b.numeric.count, c.numeric.count) > 0 THEN {_d(C.SIGNIFICANCE_Z * C.QUANTILE_NOISE_SD)} / sqrt(least(b.numeric.count, c.numeric.count)) ELSE 0D END"
#: When each signature fires, and what it says.
_RULES = {
    C.VALUE_SUBSTITUTION: (
        f"covered AND size(dropped) > 0 AND size(gained) > 0 AND (size(dropped) = 1) = (size(gained) = 1) AND match >= {_d(1 - C.MASS_MATCH_TOLERANCE)}",
        _symptom_sql(C.VALUE_SUBSTITUTION, magnitude="(-from_.k + to_.mass) / 2", from_value="from_.value", to_value="to_.value", lost="-from_.k", gained="to_.mass", match="match"),
    ),
    C.CASE_FORMAT: (
        f"covered AND NOT one_sided AND variation <= {_d(C.RESPELL_MASS_TOLERANCE)} AND size(respelled) > 0",
        _symptom_sql(C.CASE_FORMAT, magnitude="least(1D, changed)", from_value="largest.raw_b", to_value="largest.raw_c", lost="changed", respelled="size(respelled)", total_variation="variation"),
    ),
    C.SPLIT_MERGE: (
        f"covered AND (split OR merge) AND least(lost, won) / greatest(lost, won) >= {_d(1 - C.CONSERVE_TOLERANCE)}",
        _symptom_sql(
            C.SPLIT_MERGE,
            magnitude="least(1D, (lost + won) / 2)",
            from_value="array_join(sources, ' + ')",
            to_value="array_join(targets, ' + ')",
            kind="CASE WHEN split THEN 'split' ELSE 'merge' END",
            lost="lost",
            gained="won",
            sources="sources",
            targets="targets",
        ),
    ),
    C.UNIT_SCALE: (
        "affine AND (is_mult OR is_add)",
        _symptom_sql(
            C.UNIT_SCALE,
            magnitude=f"least(1D, CASE WHEN {_AS_MULT} THEN abs(log10(factor)) ELSE reach END)",
            kind=f"CASE WHEN {_AS_MULT} THEN 'multiplicative' ELSE 'additive' END",
            factor="factor",
            offset="shift",
            residual=f"CASE WHEN {_AS_MULT} THEN mult ELSE add END",
        ),
    ),
    C.DISTRIBUTION_SHIFT: (
        f"distance >= greatest(limit_, {_QUANTILE_NOISE})",
        _symptom_sql(C.DISTRIBUTION_SHIFT, magnitude="least(1D, distance)", distance="distance", median_shift="get(qc, 2) - get(qb, 2)"),
    ),
}


def detect(
    before: DataFrame,
    after: DataFrame,
    *,
    by: Sequence[str] = (),
    threshold: float | Column = C.DISTRIBUTION_THRESHOLD,
    precedence: bool = True,
    signatures: Sequence[str] = C.DETECTORS,
) -> DataFrame:
    """Symptoms of all columns profiled on both sides, with what scoring needs of the profiles.

    Rows: asset, by, column, column_ord, the fields of a symptom, n_before and n_after
    (rows not null), finite_before and finite_after, q_before and q_after.
    """
    return detect_pairs(pair(before, after, by), by=by, threshold=threshold, precedence=precedence, signatures=signatures)


def detect_pairs(pairs: DataFrame, *, by: Sequence[str] = (), threshold: float | Column = C.DISTRIBUTION_THRESHOLD, precedence: bool = True, signatures: Sequence[str] = C.DETECTORS) -> DataFrame:
    asked = [s for s in C.DETECTORS if s in signatures]
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))

    def spelled(side: str) -> Column:
        return F.transform(F.map_entries(f"{side}.top_k"), lambda e: F.struct(normal_spelling(e["key"]).alias("norm"), e["key"].alias("raw"), e["value"].alias("n"))).alias(f"spelled_{side}")

    kept = ["asset", *by, "column", "column_ord", "b", "c"]
    df = pairs.select(*kept, limit.alias("limit_"), *([spelled("b"), spelled("c")] if C.CASE_FORMAT in asked else []))
    for stage in _STAGES:
        df = df.select("*", *[F.expr(e).alias(name) for name, e, of in stage if set(of) & set(asked)])
    fired = ", ".join(f"CASE WHEN {_RULES[s][0]} THEN {_RULES[s][1]} END" for s in asked)
    found = ["nb AS n_before", "nc AS n_after", "b.numeric.count AS finite_before", "c.numeric.count AS finite_after", "qb AS q_before", "qc AS q_after"]
    keys = [f"`{k}`" for k in ("asset", *by, "column", "column_ord")]
    df = df.selectExpr(*keys, f"filter(array({fired}), s -> s IS NOT NULL) AS fired", *found)
    if precedence:
        silenced = " OR ".join(f"(s.signature = '{loser}' AND exists(fired, t -> t.signature = '{winner}'))" for winner, loser in C.SUPPRESSES.items())
        df = df.withColumn("fired", F.expr(f"filter(fired, s -> NOT ({silenced}))"))
    names = [x.rsplit(" ", 1)[1] for x in found]
    # Outer, and filtered after: of an inner one the optimizer would infer a condition and push all of it below the stages.
    return df.selectExpr(*keys, "inline_outer(fired)", *names).filter("signature IS NOT NULL")


def with_features(symptoms: DataFrame) -> DataFrame:
    """Adds significance_margin and log10_n."""
    n_a, n_b = F.col("n_before"), F.col("n_after")
    shares = noise_floor(F.col("magnitude"), n_a, n_b)
    shift = F.greatest(F.lit(C.DISTRIBUTION_THRESHOLD), quantile_noise(F.col("finite_before"), F.col("finite_after")))
    floor = F.when(F.col("signature") == C.DISTRIBUTION_SHIFT, shift).when(F.col("signature") == C.UNIT_SCALE, F.lit(C.MULTIPLY_TOLERANCE)).otherwise(shares)
    value = F.when(F.col("signature") == C.DISTRIBUTION_SHIFT, F.bround("distance", 4)).otherwise(F.col("magnitude"))
    margin = F.when(floor > 0, F.least(F.lit(C.MARGIN_CAP), value / floor)).otherwise(F.lit(C.MARGIN_CAP))
    log_n = F.log10(F.greatest(F.lit(1), F.least(n_a, n_b)).cast("double"))
    return symptoms.withColumn("significance_margin", margin).withColumn("log10_n", log_n)


def with_confidence(symptoms: DataFrame, weights=C.MODEL_WEIGHTS, intercept=C.MODEL_INTERCEPT, means=C.MODEL_MEANS, stds=C.MODEL_STDS) -> DataFrame:
    """Adds confidence: the frozen (or a given) logistic model over the features. It never changes what is detected."""
    z = F.lit(intercept)
    for name, w, m, s in zip(C.FEATURE_NAMES, weights, means, stds):
        z = z + F.lit(w) * ((F.col(name) - F.lit(m)) / F.lit(s))
    return with_features(symptoms).withColumn("confidence", sigmoid(z))
