"""SQL for the catalogue's queries, written independently of the operators they are held against."""

from __future__ import annotations

from collections.abc import Sequence


def stats_sql(table: str, columns: Sequence[str]) -> str:
    """Statistics of numeric columns of a table or subquery, a row each."""
    rows = []
    for c in columns:
        d = f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"
        q = ", ".join(f"round(quantile_cont({d}, {p}), 6) AS p{round(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
        rows.append(
            f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, "
            f"count({d}) AS finite_count, round(avg({d}), 4) AS mean, round(coalesce(stddev_samp({d}), 0), 4) AS stddev, round(min({d}), 6) AS minimum, round(max({d}), 6) AS maximum, {q} FROM {table}"
        )
    return " UNION ALL ".join(rows)


def topk_sql(table: str, column: str, k: int = 50) -> str:
    return (
        f"SELECT '{column}' AS \"column\", value, n, round(n / CAST(total AS DOUBLE), 6) AS share FROM "
        f"(SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n, sum(count(*)) OVER () AS total FROM {table} WHERE {column} IS NOT NULL GROUP BY 1) ORDER BY n DESC, value LIMIT {k}"
    )


def _categorical(before: str, after: str, c: str) -> str:
    def top(name: str, src: str) -> str:
        return (
            f"{name}v AS (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM ({src}) WHERE {c} IS NOT NULL GROUP BY 1), "
            f"t_{name} AS (SELECT coalesce(sum(n), 0) AS n FROM {name}v), {name}k AS (SELECT v, n FROM {name}v ORDER BY n DESC, v LIMIT 50)"
        )

    return f"""{top('b', before)}, {top('a', after)},
tot AS (SELECT CAST(t_b.n AS DOUBLE) AS nb, CAST(t_a.n AS DOUBLE) AS na FROM t_b, t_a),
cov AS (SELECT (SELECT sum(n) FROM bk) / nb >= 0.9 AND (SELECT sum(n) FROM ak) / na >= 0.9 AS ok FROM tot),
mv AS (SELECT v, coalesce(bk.n, 0) / nb AS s0, coalesce(ak.n, 0) / na AS s1, (coalesce(bk.n, 0) + coalesce(ak.n, 0)) / (nb + na) AS p FROM bk FULL JOIN ak USING (v) CROSS JOIN tot),
fl AS (SELECT v, s0, s1, greatest(0.02, 3 * sqrt(p * (1 - p) * (1 / nb + 1 / na))) AS f FROM mv CROSS JOIN tot),
dr AS (SELECT v, s0 - s1 AS x FROM fl WHERE s1 - s0 <= -f AND s0 >= 0.03),
ga AS (SELECT v, s1 - s0 AS x FROM fl WHERE s1 - s0 >= f AND s1 >= 0.03),
cnt AS (SELECT (SELECT count(*) FROM dr) AS nd, (SELECT count(*) FROM ga) AS ng, (SELECT sum(x) FROM dr) AS lost, (SELECT sum(x) FROM ga) AS gained)"""


def value_substitution_sql(before: str, after: str, c: str) -> str:
    return f"""SELECT * FROM (WITH {_categorical(before, after, c)},
fr AS (SELECT v, x FROM dr ORDER BY x DESC, v LIMIT 1),
tt AS (SELECT ga.v, ga.x FROM ga, fr ORDER BY abs(ga.x - fr.x), ga.v LIMIT 1)
SELECT '{c}' AS "column", 'value_substitution' AS signature, round((fr.x + tt.x) / 2, 6) AS magnitude, fr.v AS from_value, tt.v AS to_value FROM fr, tt, cnt, cov
WHERE ok AND (nd = 1) = (ng = 1) AND least(fr.x, tt.x) / greatest(fr.x, tt.x) >= 0.65)"""


def split_merge_sql(before: str, after: str, c: str) -> str:
    return f"""SELECT * FROM (WITH {_categorical(before, after, c)}
SELECT '{c}' AS "column", 'category_split_merge' AS signature, round(least(1.0, (lost + gained) / 2), 6) AS magnitude,
       (SELECT string_agg(v, ' + ' ORDER BY x DESC, v) FROM dr) AS from_value, (SELECT string_agg(v, ' + ' ORDER BY x DESC, v) FROM ga) AS to_value FROM cnt, cov
WHERE ok AND ((nd = 1 AND ng >= 2) OR (nd >= 2 AND ng = 1)) AND least(lost, gained) / greatest(lost, gained) >= 0.85)"""


def case_format_sql(before: str, after: str, c: str) -> str:
    norm = r"lower(trim(regexp_replace(v, '\s+', ' ', 'g')))"
    return f"""SELECT * FROM (WITH {_categorical(before, after, c)},
bn AS (SELECT {norm} AS k, sum(n) AS n, arg_min(v, (-n, v)) AS r FROM bk GROUP BY 1),
an AS (SELECT {norm} AS k, sum(n) AS n, arg_min(v, (-n, v)) AS r FROM ak GROUP BY 1),
g AS (SELECT k, coalesce(bn.n, 0) / nb AS s0, coalesce(an.n, 0) / na AS s1, bn.r AS r0, an.r AS r1 FROM bn FULL JOIN an USING (k) CROSS JOIN tot),
re AS (SELECT * FROM g WHERE s0 >= 0.03 AND r0 <> r1),
one AS (SELECT r0, r1 FROM re ORDER BY s0 DESC, k LIMIT 1)
SELECT '{c}' AS "column", 'case_format_normalization' AS signature, round(least(1.0, (SELECT sum(s0) FROM re)), 6) AS magnitude, r0 AS from_value, r1 AS to_value FROM one, cov
WHERE ok AND (SELECT sum(abs(s0 - s1)) / 2 FROM g) <= 0.05
  AND NOT EXISTS (SELECT 1 FROM g WHERE (s0 >= 0.03 AND r1 IS NULL) OR (s1 >= 0.03 AND r0 IS NULL)))"""


def _numeric(before: str, after: str, c: str) -> str:
    def q(src: str) -> str:
        d = f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"
        return f"SELECT quantile_cont({d}, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q, count({d}) AS n, coalesce(stddev_samp({d}), 0) AS sd FROM ({src})"

    return f"p0 AS ({q(before)}), p1 AS ({q(after)})"


def distance_sql(before: str, after: str, c: str) -> str:
    """CTEs giving dist(d, least_n)."""
    return f"""{_numeric(before, after, c)},
sc AS (SELECT CASE WHEN p0.q[5] - p0.q[1] > 0.0001 * greatest(abs(p0.q[3]), 1) THEN p0.q[5] - p0.q[1] WHEN p0.sd > 0.0001 * greatest(abs(p0.q[3]), 1) THEN p0.sd END AS s FROM p0),
dist AS (SELECT list_sum(list_transform([1, 2, 3, 4, 5], lambda i: abs(p1.q[i] - p0.q[i]))) / 5 / s AS d, least(p0.n, p1.n) AS least_n FROM p0, p1, sc)"""


def distribution_shift_sql(before: str, after: str, c: str) -> str:
    return f"""SELECT * FROM (WITH {distance_sql(before, after, c)}
SELECT '{c}' AS "column", 'numeric_distribution_shift' AS signature, round(least(1.0, d), 6) AS magnitude, CAST(NULL AS VARCHAR) AS from_value, CAST(NULL AS VARCHAR) AS to_value
FROM dist WHERE d >= greatest(0.1, 3 * 0.38 / sqrt(least_n)))"""


def unit_scale_sql(before: str, after: str, c: str) -> str:
    return f"""SELECT * FROM (WITH {_numeric(before, after, c)},
w AS (SELECT p0.q AS b, p1.q AS a, p0.q[5] - p0.q[1] AS sb, p1.q[5] - p1.q[1] AS sa FROM p0, p1),
k AS (SELECT *, sa / sb AS f, a[3] - b[3] AS o FROM w WHERE sb > 0 AND sa > 0 AND sb >= 0.001 * greatest(abs(b[3]), 1)),
r AS (SELECT *, list_max(list_transform([1, 2, 3, 4, 5], lambda i: abs(a[i] - f * b[i]))) / sa AS rm, list_max(list_transform([1, 2, 3, 4, 5], lambda i: abs(a[i] - (b[i] + o)))) / sa AS ra FROM k),
h AS (SELECT *, rm <= 0.05 AND abs(f - 1) >= 0.2 AS m, ra <= 0.05 AND abs(o) / sb >= 0.2 AS d FROM r)
SELECT '{c}' AS "column", 'unit_scale_shift' AS signature, round(least(1.0, CASE WHEN m AND (NOT d OR rm <= ra) THEN abs(log10(f)) ELSE abs(o) / sb END), 6) AS magnitude,
       CAST(NULL AS VARCHAR) AS from_value, CAST(NULL AS VARCHAR) AS to_value FROM h WHERE m OR d)"""


def all_signatures_sql(before: str, after: str, text: Sequence[str], numeric: Sequence[str], precedence: bool = True) -> str:
    parts = [f(before, after, c) for c in [*text, *numeric] for f in (value_substitution_sql, case_format_sql, split_merge_sql)]
    parts += [f(before, after, c) for c in numeric for f in (unit_scale_sql, distribution_shift_sql)]
    every = " UNION ALL ".join(parts)
    if not precedence:
        return every
    return f"""WITH every AS ({every})
SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM every w WHERE w."column" = e."column" AND
 ((w.signature = 'unit_scale_shift' AND e.signature = 'numeric_distribution_shift') OR (w.signature = 'case_format_normalization' AND e.signature = 'value_substitution')))"""


def grouped_signatures_sql(long: str) -> str:
    """CTEs giving fired(g, col, signature) of all groups at once, from rows (g, side, col, v, d): value as text and as number, side 0 or 1."""
    norm = r"lower(trim(regexp_replace(v, '\s+', ' ', 'g')))"
    return f"""long AS MATERIALIZED ({long}),
cnt AS (SELECT g, col, side, v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL),
top AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY g, col, side ORDER BY n DESC, v) <= 50),
tot AS (SELECT g, col, CAST(sum(n) FILTER (side = 0) AS DOUBLE) AS nb, CAST(sum(n) FILTER (side = 1) AS DOUBLE) AS na FROM cnt GROUP BY g, col),
kept AS (SELECT g, col, sum(n) FILTER (side = 0) AS kb, sum(n) FILTER (side = 1) AS ka FROM top GROUP BY g, col),
cov AS (SELECT tot.* FROM tot JOIN kept USING (g, col) WHERE kb / nb >= 0.9 AND ka / na >= 0.9),
mv AS (SELECT g, col, v, coalesce(sum(n) FILTER (side = 0), 0) AS b, coalesce(sum(n) FILTER (side = 1), 0) AS a FROM top GROUP BY g, col, v),
fl AS (SELECT g, col, v, b / nb AS s0, a / na AS s1, (a + b) / (na + nb) AS p, nb, na FROM mv JOIN cov USING (g, col)),
gap AS (SELECT g, col, v, s0, s1, s1 - s0 AS x, greatest(0.02, 3 * sqrt(p * (1 - p) * (1 / nb + 1 / na))) AS f FROM fl),
dr AS (SELECT g, col, v, -x AS x FROM gap WHERE x <= -f AND s0 >= 0.03),
ga AS (SELECT g, col, v, x FROM gap WHERE x >= f AND s1 >= 0.03),
lost AS (SELECT g, col, count(*) AS nd, sum(x) AS l, max(x) AS fx FROM dr GROUP BY g, col),
won AS (SELECT g, col, count(*) AS ng, sum(x) AS w FROM ga GROUP BY g, col),
near AS (SELECT g, col, arg_min(ga.x, (abs(ga.x - fx), ga.v)) AS tx FROM ga JOIN lost USING (g, col) GROUP BY g, col),
spelled AS (SELECT g, col, side, {norm} AS k, sum(n) AS n, arg_min(v, (-n, v)) AS r FROM top GROUP BY ALL),
grp AS (SELECT g, col, k, coalesce(max(n) FILTER (side = 0), 0) / any_value(nb) AS s0, coalesce(max(n) FILTER (side = 1), 0) / any_value(na) AS s1, max(r) FILTER (side = 0) AS r0, max(r) FILTER (side = 1) AS r1 FROM spelled JOIN cov USING (g, col) GROUP BY g, col, k),
quant AS (SELECT g, col, side, quantile_cont(d, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q, count(d) AS n, coalesce(stddev_samp(d), 0) AS sd FROM long WHERE d IS NOT NULL GROUP BY ALL),
num AS (SELECT b.g, b.col, b.q AS b, a.q AS a, b.q[5] - b.q[1] AS sb, a.q[5] - a.q[1] AS sa, b.sd, least(a.n, b.n) AS n FROM quant b JOIN quant a ON a.g = b.g AND a.col = b.col AND b.side = 0 AND a.side = 1),
fit AS (SELECT g, col, abs(sa / sb - 1) AS f, abs(a[3] - b[3]) / sb AS reach, list_max(list_transform([1, 2, 3, 4, 5], lambda i: abs(a[i] - sa / sb * b[i]))) / sa AS rm, list_max(list_transform([1, 2, 3, 4, 5], lambda i: abs(a[i] - (b[i] + a[3] - b[3])))) / sa AS ra FROM num WHERE sb > 0 AND sa > 0 AND sb >= 0.001 * greatest(abs(b[3]), 1)),
dist AS (SELECT g, col, n, list_sum(list_transform([1, 2, 3, 4, 5], lambda i: abs(a[i] - b[i]))) / 5 / CASE WHEN sb > 0.0001 * greatest(abs(b[3]), 1) THEN sb WHEN sd > 0.0001 * greatest(abs(b[3]), 1) THEN sd END AS d FROM num),
every AS (
 SELECT g, col, 'value_substitution' AS signature FROM lost JOIN won USING (g, col) JOIN near USING (g, col) WHERE (nd = 1) = (ng = 1) AND least(fx, tx) / greatest(fx, tx) >= 0.65
 UNION ALL SELECT g, col, 'category_split_merge' FROM lost JOIN won USING (g, col) WHERE ((nd = 1 AND ng >= 2) OR (nd >= 2 AND ng = 1)) AND least(l, w) / greatest(l, w) >= 0.85
 UNION ALL SELECT g, col, 'case_format_normalization' FROM grp GROUP BY g, col HAVING count(*) FILTER (s0 >= 0.03 AND r0 <> r1) > 0 AND sum(abs(s0 - s1)) / 2 <= 0.05 AND count(*) FILTER ((s0 >= 0.03 AND r1 IS NULL) OR (s1 >= 0.03 AND r0 IS NULL)) = 0
 UNION ALL SELECT g, col, 'unit_scale_shift' FROM fit WHERE (rm <= 0.05 AND f >= 0.2) OR (ra <= 0.05 AND reach >= 0.2)
 UNION ALL SELECT g, col, 'numeric_distribution_shift' FROM dist WHERE d >= greatest(0.1, 3 * 0.38 / sqrt(n))),
fired AS (SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM every w WHERE w.g = e.g AND w.col = e.col AND ((w.signature = 'unit_scale_shift' AND e.signature = 'numeric_distribution_shift') OR (w.signature = 'case_format_normalization' AND e.signature = 'value_substitution'))))"""
