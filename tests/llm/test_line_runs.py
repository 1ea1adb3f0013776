"""Maximal repeated runs of lines against a plain version, and planted runs."""

import random

from tidemark.llm import line_dedup


def plain(docs, least):
    """{doc: (removed lines, maximal runs)} by comparing every place with every earlier one."""
    places = [(d, i) for d, ls in docs for i in range(len(ls))]
    text = dict(docs)
    out = {}
    length = {}
    for k, (d, i) in enumerate(places):
        best = 0
        for e, j in places[:k]:
            n = 0
            while i + n < len(text[d]) and j + n < len(text[e]) and text[d][i + n] == text[e][j + n]:
                n += 1
            best = max(best, n)
        length[d, i] = best
    for (d, i), n in length.items():
        if n >= least:
            gone, runs = out.setdefault(d, (set(), set()))
            gone.update(range(i, i + n))
            if n > length.get((d, i - 1), 0) - 1:
                runs.add((i, i + n - 1))
    return out


def check(spark, docs, least=2):
    df = spark.createDataFrame([(d, "\n".join(ls)) for d, ls in docs], "doc_id long, text string")
    want = plain(docs, least)
    rows = line_dedup.repeated_runs(df, least).collect()
    got = {r["doc_id"]: ({x for run in r["runs"] for x in range(run["a"], run["b"] + 1)}, {(m["a"], m["b"]) for m in r["maximal"]}) for r in rows}
    assert got == want


def test_runs_that_adjoin(spark):
    df = spark.createDataFrame([(1, "A\nB"), (2, "C\nD"), (3, "A\nB\nC\nD")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_runs"], r["longest_run"], r["n_removed"]) for r in line_dedup.report(df).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), 3: (2, 2, 4)}


def test_runs_whose_pairs_come_from_different_places(spark):
    check(spark, [(1, list("AB")), (2, list("BC")), (3, list("ABC")), (4, list("ABC")), (5, list("XABCABCY")), (6, list("CABC"))])


def test_random_lines_and_repeats(spark):
    rng = random.Random(6)
    for few in ("ab", "abcdefgh"):
        docs = [(d, [rng.choice(few) for _ in range(rng.randint(1, 12))]) for d in range(25)]
        docs += [(100 + k, ["x"] * n) for k, n in enumerate((1, 7, 20))]
        check(spark, docs)
        check(spark, docs, 4)


def test_planted_runs_are_found(spark):
    rng = random.Random(7)
    line = lambda: "".join(rng.choices("abcdefghij", k=20))
    docs, planted = [], {}
    for k in range(40):
        run = [line() for _ in range(rng.randint(2, 70))]
        docs.append((2 * k, [line() for _ in range(rng.randint(0, 5))] + run + [line() for _ in range(rng.randint(0, 5))]))
        before = rng.randint(0, 5)
        docs.append((2 * k + 1, [line() for _ in range(before)] + run + [line()]))
        planted[2 * k + 1] = (before, before + len(run) - 1)
    df = spark.createDataFrame([(d, "\n".join(ls)) for d, ls in docs], "doc_id long, text string")
    got = {r["doc_id"]: [(m["a"], m["b"]) for m in r["maximal"]] for r in line_dedup.repeated_runs(df).collect()}
    assert got == {d: [run] for d, run in planted.items()}
