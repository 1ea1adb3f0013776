"""Personal data by weak supervision, in DataFrame operations only.

Base spans are what four patterns find and their checks let pass. Looser patterns add
candidates: numbers and addresses in other spellings, and secrets. Labelers of three
kinds vote on every candidate (for, against, or not at all): patterns on the match,
gazetteers (tables of words, by token) in it and before it, and cues in the text before it. Expectation
maximisation over the counted vote patterns estimates how reliable each labeler is
and how probable each pattern's candidates are to be personal data. With these
probabilities as labels a logistic span classifier is fitted on features of the
spans; a candidate that it scores at ``LEAST`` or more is a span, unless it overlaps
a base span or an earlier candidate. Base spans always stay.

The counted tables have a fixed bound (kinds times vote patterns, and feature
patterns), so both fits run on the driver whatever the size of the corpus.

Edge cases: null and empty texts have no spans; repeated rows are answered one by
one; without candidates, or without any vote, nothing is added; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scan_id, written

#: Kinds in the order of the digest; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE = 4
#: Characters of text before a match that context labelers read.
CONTEXT = 40
#: Probability from which a candidate is a span.
LEAST = 0.5

# Base patterns. Each match starts where a run of its first class starts or the match
# before ended, which is where the leftmost match is, and possessive runs do not
# backtrack: long runs cost time in proportion. What they match.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates beyond the base. Possessive here too: a greedy run of groups needs stack for each.
_MASKED = r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++\s?(?:\(at\)|\[at\]|\{at\})\s?[a-z0-9-]++(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\.)\s?[a-z0-9-]++)++"
_LOCAL = r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4})?(?![0-9A-Za-z])"
_SECRET = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i)(?<![a-z])(?:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?\"?[^\s\"]{8,}+\"?"
_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: (kind, base, cheap test of the text, pattern)
PATTERNS = (
    (0, True, "contains(text, '@')", _EMAIL),
    (1, True, r"text RLIKE '[0-9][.][0-9]'", _IP),
    (2, True, r"text RLIKE '[0-9](?:[ -]?[0-9]){12}'", _CARD),
    (3, True, "contains(text, '+')", _PHONE),
    (0, False, r"text RLIKE '(?i)[(\\[{]at[)\\]}]'", _MASKED),
    (3, False, r"text RLIKE '[0-9][ .)-]+[0-9]{2}'", _LOCAL),
    (4, False, r"contains(text, 'AKIA') OR text RLIKE '(?i)(?:word|passwd|secret|token|key) ?[=:]'", _SECRET),
    (5, False, r"text RLIKE '[0-9]-[0-9]{2}-[0-9]'", _ID),
)

# Gazetteers and cues: plain words, chosen by us.
_PROVIDERS = r"(?i)(?:mail|inbox|post)|\.(?:com|org|net|edu|gov|de|fr|es|uk)(?![a-z])"
_KEY_WORDS = r"(?i)AKIA|password|passwd|secret|token|key"
_PLACEHOLDERS = r"(?i)xxxx|0000000|1234567|example_|changeme|your[_-]"
_CUES = r"(?i)(?:mail|contact|write|phone|tel|call|mobile|fax|card|visa|account|iban|address|login|user|password|secret|token|key|ssn|passport|name)\W*(?:\w+\W+){0,3}$"
_NOT_CUES = r"(?i)(?:version|release|license|licence|chapter|section|page|figure|table|isbn|issn|doi|copyright|price|total|year)\W*(?:\w+\W+){0,2}$"

# Gazetteers: tables of words, looked up by token in the last words before a match or in the match.
GAZETTEERS = {
    "phone": ("phone", "phones", "telephone", "tel", "call", "calls", "ring", "dial", "mobile", "cell", "fax", "sms", "text", "whatsapp", "hotline", "telefon", "handy", "anrufen", "rufnummer", "téléphone", "appelez", "portable", "teléfono", "llame", "móvil"),
    "mail": ("mail", "email", "e-mail", "write", "contact", "reach", "reply", "send", "schreiben", "kontakt", "écrire", "contacter", "courriel", "escribir", "correo", "contacto"),
    "identity": ("ssn", "social", "security", "passport", "taxpayer", "citizen", "identity", "id", "license", "ausweis", "steuernummer", "sozialversicherung", "passeport", "identité", "pasaporte", "dni"),
    "secret": ("password", "passwd", "secret", "token", "key", "apikey", "credential", "login", "passwort", "kennwort", "schlüssel", "mot", "passe", "clé", "contraseña", "clave"),
    "count": ("total", "sum", "price", "amount", "isbn", "issn", "doi", "page", "pages", "version", "release", "build", "chapter", "section", "figure", "table", "year", "on", "dated", "order", "invoice", "part", "serial", "model", "lot", "room", "seite", "kapitel", "preis", "jahr", "prix", "année", "página", "precio", "año", "copyright"),
    "placeholder": ("changeme", "changeme1", "example", "sample", "dummy", "test", "placeholder", "none", "null", "redacted", "undefined", "your", "xxxx", "password1"),
}


def _words_in(text: str, name: str) -> str:
    """SQL text: whether a word of a gazetteer is among the tokens of ``text``."""
    listed = ", ".join(f"'{w}'" for w in GAZETTEERS[name])
    return rf"arrays_overlap(split(lower({text}), '[^\p{{L}}\p{{N}}-]+'), array({listed}))"


#: The last three words before a match, and what a secret's name is followed by.
_NEAR = r"regexp_extract(before, '((?:[^\p{L}\p{N}]*[\p{L}\p{N}-]+){0,3})[^\p{L}\p{N}]*$', 1)"
_VALUE = "regexp_extract(s, '[=:](.*)$', 1)"
_OWN_WORD = f"CASE kind WHEN 0 THEN {_words_in(_NEAR, 'mail')} WHEN 3 THEN {_words_in(_NEAR, 'phone')} WHEN 4 THEN {_words_in(_NEAR, 'secret')} WHEN 5 THEN {_words_in(_NEAR, 'identity')} ELSE false END"
_COUNT_WORD = f"kind IN (2, 3, 5) AND {_words_in(_NEAR, 'count')}"
_PLACEHOLDER_WORD = f"kind = 4 AND {_words_in('s', 'placeholder')}"

_DIGITS = "regexp_replace(s, '[^0-9]', '')"
#: Votes: 1 for, -1 against, 0 none. The first three read the match's shape, the next two its words, the last two its context.
LABELERS = (
    ("shape", "CASE WHEN base THEN IF(valid, 1, -1) ELSE 0 END"),
    ("digits", f"CASE WHEN kind = 3 AND length({_DIGITS}) = 9 THEN 0 WHEN kind IN (2, 3, 5) THEN IF(length({_DIGITS}) BETWEEN 9 AND 19, 1, -1) WHEN kind = 4 AND s RLIKE '^AKIA' THEN 1 WHEN kind = 4 THEN IF(length(regexp_replace({_VALUE}, '[^0-9]', '')) >= 3, 1, -1) ELSE 0 END"),
    ("grouping", r"CASE WHEN kind = 3 AND s RLIKE '^[0-9]{4}[ .-][0-9]{2}[ .-][0-9]{2}$' THEN -1 WHEN kind = 3 AND s RLIKE '[()]|[0-9]{3}.[0-9]{3}.[0-9]{4}$' THEN 1 WHEN kind = 1 AND s RLIKE '^[0-9][.][0-9][.][0-9][.][0-9]$' THEN -1 ELSE 0 END"),
    ("gazetteer", f"CASE WHEN kind = 0 AND s RLIKE '{_PROVIDERS}' THEN 1 WHEN kind = 4 AND s RLIKE '{_KEY_WORDS}' THEN 1 ELSE 0 END"),
    ("placeholder", f"CASE WHEN s RLIKE '{_PLACEHOLDERS}' THEN -1 ELSE 0 END"),
    ("cue", f"CASE WHEN before RLIKE '{_CUES}' THEN 1 ELSE 0 END"),
    ("other_cue", f"CASE WHEN before RLIKE '{_NOT_CUES}' THEN -1 ELSE 0 END"),
    ("own_word", f"IF({_OWN_WORD}, 1, 0)"),
    ("count_word", f"IF({_COUNT_WORD}, -1, 0)"),
    ("placeholder_word", f"IF({_PLACEHOLDER_WORD}, -1, 0)"),
)
#: Features of the span classifier: each a condition.
FEATURES = (
    *(f"kind = {k}" for k in range(len(KINDS))),
    "base",
    "valid",
    "length(s) >= 12",
    "length(s) >= 20",
    "s RLIKE '[A-Z]'",
    "s RLIKE '[=:\"]'",
    "s RLIKE '[()]'",
    f"length({_DIGITS}) * 2 > length(s)",
    f"before RLIKE '{_CUES}'",
    f"before RLIKE '{_NOT_CUES}'",
    _OWN_WORD,
    _COUNT_WORD,
    f"({_PLACEHOLDER_WORD}) OR s RLIKE '{_PLACEHOLDERS}'",
    f"kind = 3 AND length({_DIGITS}) > 9",
    f"kind = 4 AND length(regexp_replace({_VALUE}, '[^0-9]', '')) < 3 AND NOT s RLIKE '^AKIA'",
)


def _text(sql: str) -> str:
    """A pattern as it must stand between quotes in SQL."""
    return sql.replace("\\", "\\\\").replace("'", "\\'")


def _sql(expression: str) -> Column:
    return F.expr(expression.replace("\\", "\\\\"))


_LUHN = """aggregate(sequence(1, length(d)), 0, (t, j) -> t +
 CASE WHEN j % 2 = 1 THEN cast(substr(d, length(d) - j + 1, 1) AS int)
      ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substr(d, length(d) - j + 1, 1) AS int) + 1) END) % 10 = 0"""
_VALID = f"""CASE kind
 WHEN 1 THEN forall(split(s, '[.]'), x -> coalesce(try_cast(x AS int) <= 255, false))
 WHEN 2 THEN CASE WHEN length(d) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END
 WHEN 3 THEN length(d) BETWEEN 9 AND 15
 ELSE true END"""


NO_MATCHES = "cast(array() AS array<struct<pattern: int, kind: int, base: boolean, k: int, s: string, gap: int, before: string>>)"


def matches(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, found): for each row the matches of all patterns, in text order by pattern."""
    rows = docs.select(scan_id().alias("row_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hot = r"text RLIKE '[0-9@]|AKIA|(?i)[(\\\\[{]at[)\\\\]}]|(?:word|passwd|secret|token|key) ?[=:]'"
    lists = []
    for i, (kind, base, test, pattern) in enumerate(PATTERNS):
        p, known = _text(pattern), f"({hot}) AND ({test})"
        rows = rows.withColumn(f"m{i}", F.expr(f"CASE WHEN {known} THEN regexp_extract_all(text, '{p}', 0) END"))
        rows = rows.withColumn(f"p{i}", F.expr(f"CASE WHEN {known} THEN split(text, '{p}', -1) END"))
        # One gap more than there are matches: the text after the last.
        entry = f"named_struct('pattern', {i}, 'kind', {kind}, 'base', {str(base).lower()}, 'k', k, 's', x.m{i}, 'gap', length(x.p{i}), 'before', right(x.p{i}, {CONTEXT}))"
        lists.append(f"coalesce(transform(filter(arrays_zip(m{i}, p{i}), x -> x.m{i} IS NOT NULL), (x, k) -> {entry}), {NO_MATCHES})")
    return rows.select("row_key", "doc_id", F.expr(f"concat({', '.join(lists)})").alias("found"))


def candidates(found: DataFrame) -> DataFrame:
    """(row_key, kind, base, valid, a, b, s, before): one row per match; a and b count code points."""
    rows = found.select("row_key", F.explode("found").alias("f")).select("row_key", "f.*")
    order = Window.partitionBy("row_key", "pattern").orderBy("k")
    upto = F.sum(F.col("gap") + F.length("s")).over(order).cast("int")
    rows = rows.withColumn("b", upto).withColumn("a", F.col("b") - F.length("s"))
    rows = rows.withColumn("d", F.expr(_DIGITS)).withColumn("valid", F.expr(_VALID))
    # A base match that fails its check is dropped; other spellings may still cover its place.
    return rows.select("row_key", "kind", "base", "valid", "a", "b", "s", "before")


def estimate(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 40) -> tuple[dict[tuple[int, tuple[int, ...]], float], list[dict]]:
    """Expectation maximisation over counted votes {(kind, votes): n}.

    Returns the probability of each pattern's candidates to be personal data, and for
    each labeler its estimated vote frequencies given either answer.
    """
    n_labelers = len(LABELERS)
    # Pseudo-counts in proportion to the candidates: cast votes are held to be right more often than wrong, at every size.
    weight = max(30.0, 0.05 * sum(counts.values()))
    believed = {True: 0.6 * weight, False: 0.1 * weight}
    post = {key: min(0.95, max(0.05, 0.5 + 0.25 * sum(key[1]))) for key in counts}
    tables: list[dict] = []
    for _ in range(rounds):
        prior: dict[int, list[float]] = defaultdict(lambda: [1.0, 1.0])
        tables = [{(y, v): 0.3 * weight if v == 0 else believed[(v == 1) == (y == 1)] for y in (0, 1) for v in (-1, 0, 1)} for _ in range(n_labelers)]
        for (kind, votes), n in sorted(counts.items()):
            p = post[kind, votes]
            prior[kind][1] += n * p
            prior[kind][0] += n * (1 - p)
            for j, v in enumerate(votes):
                tables[j][1, v] += n * p
                tables[j][0, v] += n * (1 - p)
        for t in tables:
            for y in (0, 1):
                total = sum(t[y, v] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    t[y, v] /= total
        for kind, votes in counts:
            odds = math.log(prior[kind][1] / prior[kind][0])
            # Abstaining says nothing of its own; only cast votes count.
            odds += sum(math.log(tables[j][1, v] / tables[j][0, v]) for j, v in enumerate(votes) if v)
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, tables


def fit(rows: list[tuple[int, float, float]], steps: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Logistic regression on (feature bits, number, expected positives); the last weight is the intercept."""
    n = len(FEATURES)
    w = [0.0] * (n + 1)
    total = sum(r[1] for r in rows) or 1.0
    for _ in range(steps):
        grad = [ridge * x for x in w]
        for bits, number, positive in rows:
            on = [j for j in range(n) if bits >> j & 1]
            z = w[n] + sum(w[j] for j in on)
            err = (number / (1 + math.exp(-max(-30.0, min(30.0, z)))) - positive) / total
            for j in on:
                grad[j] += err
            grad[n] += err
        w = [x - rate * g for x, g in zip(w, grad)]
    return w


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (row_key, doc_id) and their spans (row_key, kind, a, b, base)."""
    found = written(matches(docs))
    votes = F.array(*[_sql(e).cast("int") for _, e in LABELERS])
    bits = sum((F.when(_sql(e), F.lit(1 << i)).otherwise(F.lit(0)) for i, e in enumerate(FEATURES)), F.lit(0))
    cand = written(candidates(found.filter(F.size("found") > 0)).withColumn("votes", votes).withColumn("bits", bits).drop("s", "before"))
    counts = {(r["kind"], tuple(r["votes"])): r["n"] for r in cand.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = cand.filter("base AND valid").select("row_key", "kind", "a", "b", "base")
    if not any(any(v) for _, v in counts):
        return found.select("row_key", "doc_id"), base
    post, _ = estimate(counts)
    code = F.concat_ws(",", F.col("kind").cast("string"), F.col("votes").cast("array<string>"))
    known = F.create_map(*[x for (k, v), p in sorted(post.items()) for x in (F.lit(",".join(map(str, (k, *v)))), F.lit(p))])
    expected = cand.groupBy("bits", "kind", "votes").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.element_at(known, code))
    rows = expected.groupBy("bits").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("y")).orderBy("bits").collect()
    w = fit([(r["bits"], float(r["n"]), r["y"]) for r in rows])
    z = F.lit(w[-1])
    for j, x in enumerate(w[:-1]):
        z = z + F.when(F.col("bits").bitwiseAND(1 << j) != 0, F.lit(x)).otherwise(F.lit(0.0))
    added = cand.filter("NOT base").filter(1 / (1 + F.exp(-z)) >= LEAST).select("row_key", "kind", "a", "b", "base")
    both = base.unionByName(added)
    order = Window.partitionBy("row_key").orderBy("a", F.col("base").desc(), "kind", "b")
    before = F.max(F.when(F.col("base"), F.col("b"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("a"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = both.withColumn("clash", ~F.col("base") & ((F.coalesce(before, F.lit(-1)) > F.col("a")) | (F.coalesce(after, F.col("b")) < F.col("b"))))
    both = both.filter("NOT clash")
    earlier = F.max(F.when(~F.col("base"), F.col("b"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("clash", ~F.col("base") & (F.coalesce(earlier, F.lit(-1)) > F.col("a")))
    return found.select("row_key", "doc_id"), both.filter("NOT clash").drop("clash")


def _listed(found: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(found), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["a"].cast("string"), x["b"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The digest of ``spans``, a row per document."""
    rows, found = spans(docs)
    one = F.struct("kind", "a", "b")
    counts = [F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{KINDS[i]}") for i in range(BASE)]
    by = found.groupBy("row_key").agg(*counts, F.collect_list(F.when(F.col("base"), one)).alias("base"), F.collect_list(one).alias("all"))
    by = by.select("row_key", *[f"n_{KINDS[i]}" for i in range(BASE)], _listed("base").alias("base"), _listed("all").alias("spans"))
    out = rows.join(by, "row_key", "left")
    zero = [F.coalesce(f"n_{KINDS[i]}", F.lit(0)).cast("long").alias(f"n_{KINDS[i]}") for i in range(BASE)]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
