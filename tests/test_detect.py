import pytest

from tidemark import constants as C
from tidemark.plans.analyze import ColumnProfile, NumericStats, detect_one, detect_symptoms_from_profiles


def cat(counts, rows=None):
    n = sum(counts.values())
    return ColumnProfile("v", rows or n, 0, len(counts), dict(counts))


def num(q, n=1000, sd=10.0):
    return ColumnProfile("v", n, 0, n, {}, NumericStats(n, q[2], sd, q[0], q[4], dict(zip(C.QUANTILE_NAMES, map(float, q)))))


BASE = [0, 25, 50, 75, 100]
MANY = {f"v{i}": 4 for i in range(50)}
CASES = [
    # signature, before, after, (from, to) or True or None
    (C.VALUE_SUBSTITUTION, dict(US=620, UK=200, DE=120, FR=60), {"US": 622, "United Kingdom": 198, "DE": 122, "FR": 58}, ("UK", "United Kingdom")),
    (C.VALUE_SUBSTITUTION, dict(US=380, UK=120, DE=84), dict(US=382, UK=118, DE=85), None),
    (C.VALUE_SUBSTITUTION, dict(US=400, UK=100), dict(US=200, UK=50), None),
    (C.VALUE_SUBSTITUTION, dict(US=500, UK=499, ZZ=1), dict(US=500, UK=499, QQ=1), None),
    (C.VALUE_SUBSTITUTION, dict(AA=250, BB=250, US=500), dict(XX=250, YY=250, US=500), ("AA", "XX")),
    (C.VALUE_SUBSTITUTION, dict(X=300, A=400, B=300), dict(X=50, P=200, Q=50, A=400, B=300), None),
    (C.VALUE_SUBSTITUTION, dict(A=500, B=300, C=200), dict(A=500, B=260, C=200, D=40), ("B", "D"), 10),
    (C.CASE_FORMAT, dict(US=600, UK=200, DE=200), dict(us=600, uk=200, de=200), ("US", "us")),
    (C.CASE_FORMAT, {"active": 700, "inactive": 300}, {"active ": 700, "inactive": 300}, ("active", "active ")),
    (C.CASE_FORMAT, dict(US=620, UK=200, DE=180), {"US": 620, "United Kingdom": 198, "DE": 182}, None),
    (C.CASE_FORMAT, dict(US=600, UK=200, DE=195), dict(us=600, uk=200, de=190, zz=5), True),
    (C.CASE_FORMAT, dict(US=600, UK=395, zz=5), dict(US=600, UK=395, ZZ=5), None),
    (C.CASE_FORMAT, dict(Ideal=400, Premium=340, Good=228, Fair=32), dict(IDEAL=402, PREMIUM=338, GOOD=234, FAIR=26), True),
    (C.CASE_FORMAT, dict(US=600, UK=400), dict(us=500, uk=400, CA=100), None),
    (C.CASE_FORMAT, dict(US=490, UK=475, XX=35), dict(us=475, uk=475, xx=15, CA=35), None),
    (C.CASE_FORMAT, dict(US=500, UK=465, RARE=35), dict(us=500, uk=480, rare=20), True),
    (C.CASE_FORMAT, {"Straße": 600, "Weg": 400}, {"STRASSE": 600, "Weg": 400}, ("Straße", "STRASSE")),
    (C.SPLIT_MERGE, dict(Electronics=500, Books=300, Toys=200), {"Consumer Electronics": 300, "Home Electronics": 200, "Books": 300, "Toys": 200}, ("Electronics", "Consumer Electronics + Home Electronics")),
    (C.SPLIT_MERGE, {"Consumer Electronics": 300, "Home Electronics": 200, "Books": 300, "Toys": 200}, dict(Electronics=500, Books=300, Toys=200), ("Consumer Electronics + Home Electronics", "Electronics")),
    (C.SPLIT_MERGE, dict(US=620, UK=200, DE=180), dict(US=620, GB=200, DE=180), None),
]


@pytest.mark.parametrize("case", CASES, ids=str)
def test_categorical(spark, case):
    signature, before, after, want, *scale = case
    k = scale[0] if scale else 1
    before, after = ({v: n * k for v, n in x.items()} for x in (before, after))
    found = detect_one(spark, signature, cat(before), cat(after))
    if want is None:
        assert found is None
    else:
        assert found and found.signature == signature and 0 < found.magnitude <= 1
        if want is not True:
            assert (found.from_value, found.to_value) == want


def test_small_samples_and_low_coverage_are_silent(spark):
    assert detect_one(spark, C.VALUE_SUBSTITUTION, cat(dict(A=125, B=75, C=50)), cat(dict(A=125, B=65, C=50, D=10))) is None
    assert detect_one(spark, C.SPLIT_MERGE, cat(dict(A=140, B=60)), cat(dict(A=140, B=48, D=6, E=6))) is None
    assert detect_one(spark, C.SPLIT_MERGE, cat(dict(A=14000, B=6000)), cat(dict(A=14000, B=4800, D=600, E=600))).evidence["kind"] == "split"
    assert detect_one(spark, C.VALUE_SUBSTITUTION, cat(MANY, 1000), cat({**MANY, "v0": 0, "new": 4}, 1000)) is None


NUMERIC = [
    (C.DISTRIBUTION_SHIFT, num([30, 42, 50, 58, 70]), num([50, 62, 70, 78, 90]), 0.5),
    (C.DISTRIBUTION_SHIFT, num([45, 48, 50, 52, 55]), num([20, 40, 50, 60, 80]), True),
    (C.DISTRIBUTION_SHIFT, num([30, 42, 50, 58, 70]), num([31, 42, 50, 59, 70]), None),
    (C.DISTRIBUTION_SHIFT, num(BASE, 40), num([x + 11.5 for x in BASE], 40), None),
    (C.DISTRIBUTION_SHIFT, num(BASE, 5000), num([x + 11.5 for x in BASE], 5000), True),
    (C.DISTRIBUTION_SHIFT, num([100] * 4 + [100.0001], 100000, 5e-5), num([100] * 4 + [100.0002], 100000, 5e-5), None),
    (C.DISTRIBUTION_SHIFT, num([0, 25, float("nan"), 75, 100]), num([50, 75, 100, 125, 150]), None),
    (C.UNIT_SCALE, num([5, 20, 50, 80, 120]), num([500, 2000, 5000, 8000, 12000]), 1.0),
    (C.UNIT_SCALE, num([0, 6, 12, 18, 23]), num([5, 11, 17, 23, 28]), True),
    (C.UNIT_SCALE, num([45, 48, 50, 52, 55]), num([20, 40, 50, 60, 80]), None),
    (C.UNIT_SCALE, num([59.2, 61.0, 61.8, 62.5, 63.8]), num([59.4, 61.1, 61.9, 62.5, 63.6]), None),
    (C.UNIT_SCALE, num([60.98, 60.99, 61.0, 61.01, 61.02]), num([61.0, 61.01, 61.02, 61.03, 61.04]), None),
]


@pytest.mark.parametrize("case", NUMERIC, ids=lambda c: c[0][:9])
def test_numeric(spark, case):
    signature, before, after, want = case
    found = detect_one(spark, signature, before, after)
    assert (found is None) == (want is None)
    if isinstance(want, float):
        assert found.magnitude == pytest.approx(want, abs=1e-12)


def test_kinds_of_rescaling(spark):
    found = detect_one(spark, C.UNIT_SCALE, num([5, 20, 50, 80, 120]), num([500, 2000, 5000, 8000, 12000]))
    assert found.evidence["kind"] == "multiplicative" and found.evidence["factor"] == 100.0
    found = detect_one(spark, C.UNIT_SCALE, num([0, 6, 12, 18, 23]), num([5, 11, 17, 23, 28]))
    assert found.evidence["kind"] == "additive" and found.evidence["offset"] == 5.0


def test_precedence_and_confidence_do_not_meet(spark):
    from tidemark.operators.calibration import LogisticModel

    before, after = {"v": num([5, 20, 50, 80, 120])}, {"v": num([500, 2000, 5000, 8000, 12000])}
    both = detect_symptoms_from_profiles(spark, before, after, precedence=False)
    assert [s.signature for s in both] == [C.UNIT_SCALE, C.DISTRIBUTION_SHIFT]
    plain = detect_symptoms_from_profiles(spark, before, after)
    scored = detect_symptoms_from_profiles(spark, before, after, model=LogisticModel())
    assert [s.signature for s in plain] == [s.signature for s in scored] == [C.UNIT_SCALE]
    assert plain[0].confidence is None and scored[0].confidence > 0.9


def test_folding_agrees_with_case_folding(spark):
    """Two letters fold alike here if and only if they do in Python, over the letters of European scripts."""
    from pyspark.sql import functions as F

    from tidemark.functions.text import case_fold

    letters = [chr(i) for i in (*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)) if chr(i).isalpha()]
    rows = spark.createDataFrame([(c,) for c in letters], "c string").select("c", case_fold(F.col("c")).alias("f")).collect()
    ours, theirs = {}, {}
    for r in rows:
        ours.setdefault(r["f"], set()).add(r["c"])
        theirs.setdefault(r["c"].casefold(), set()).add(r["c"])
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


SCENARIOS = [
    ("country", dict(US=400, UK=200, DE=200, FR=200), {"US": 400, "United Kingdom": 200, "DE": 200, "FR": 200}, C.VALUE_SUBSTITUTION),
    ("status", dict(active=600, pending=250, closed=150), dict(ACTIVE=600, PENDING=250, CLOSED=150), C.CASE_FORMAT),
    ("category", dict(Electronics=500, Books=300, Toys=200), dict(Consumer=300, Home=200, Books=300, Toys=200), C.SPLIT_MERGE),
    ("amount", None, lambda x: x * 2 if x > 55 else x, C.DISTRIBUTION_SHIFT),
    ("amount", None, lambda x: x * 100, C.UNIT_SCALE),
    ("country", dict(US=400, UK=200, DE=200, FR=200), dict(US=398, UK=204, DE=199, FR=199), None),
    ("amount", None, lambda x: x + 4, None),
    ("status", dict(active=600, pending=250, closed=150), dict(active=604, pending=248, closed=148), None),
    ("country", dict(US=400, UK=200, DE=200, FR=200), dict(US=800, UK=400, DE=400, FR=400), None),
    ("country", dict(US=400, UK=200, DE=200, FR=200), dict(US=394, UK=197, DE=197, FR=197, MX=15), None),
    ("amount", None, lambda x: x * 1.15 if x > 55 else x, None),
    ("amount", None, lambda x: x + 6, None),
]


def test_labelled_scenarios(spark):
    """Recall 1 and no false alarm; a looser threshold has false alarms."""
    from tidemark.operators.profile import profile
    from tidemark.operators.detect import detect

    rows = {"before": [], "after": []}
    for i, (_, before, after, _) in enumerate(SCENARIOS):
        if before is None:
            values = [10 + k % 91 for k in range(1000)]
            rows["before"] += [(i, None, float(x)) for x in values]
            rows["after"] += [(i, None, float(after(x))) for x in values]
        else:
            for side, counts in (("before", before), ("after", after)):
                rows[side] += [(i, v, None) for v, n in counts.items() for _ in range(n)]
    b, a = (profile(spark.createDataFrame(r, "trial int, text string, amount double"), ["text", "amount"], by=["trial"]) for r in rows.values())
    found = {}
    for r in detect(b, a, by=["trial"]).collect():
        found.setdefault(r["trial"], []).append(r["signature"])
    assert found == {i: [s[3]] for i, s in enumerate(SCENARIOS) if s[3]}
    loose = {r["trial"] for r in detect(b, a, by=["trial"], threshold=0.03).collect()}
    assert loose & {i for i, s in enumerate(SCENARIOS) if s[3] is None}
