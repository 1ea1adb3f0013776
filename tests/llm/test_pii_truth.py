"""Precision and recall of the spans that weak supervision adds, on planted truth."""

import random

from tidemark.llm import pii


def planted(rng, n=1500):
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    code = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    name = lambda: rng.choice(["anna", "jo.smith", "p_lee", "max99"])
    filler = lambda: " ".join(rng.choices("the river stone walks over green house and was".split(), k=rng.randint(3, 12)))
    personal = [
        lambda: ("mail me at ", f"{name()} [at] mail{rng.randint(1, 9)} (dot) com"),
        lambda: ("call ", f"({digits(3)}) {digits(3)}-{digits(4)}"),
        lambda: ("phone: ", f"{digits(3)}.{digits(3)}.{digits(4)}"),
        lambda: ("ssn ", f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: ("", f"password={code(12)}"),
        lambda: ("", f"api_key: {code(24)}"),
        lambda: ("key ", "AKIA" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ234567", k=16))),
    ]
    other = [
        lambda: f"on 20{digits(2)} 05 {rng.randint(10, 28)}",
        lambda: f"version {digits(2)}.{digits(2)}.{digits(3)}",
        lambda: f"isbn {digits(3)}-{digits(2)}-{digits(4)}",
        lambda: "token: xxxxxxxxxxxx",
        lambda: f"total {digits(3)} {digits(3)} {digits(3)}",
        lambda: "password = changeme1",
        lambda: f"page {digits(3)}.{digits(3)}.{digits(3)}",
    ]
    rows, truth = [], {}
    for i in range(n):
        text, spans = filler() + " ", []
        for _ in range(rng.randint(0, 2)):
            cue, x = rng.choice(personal)()
            text += cue
            spans.append((len(text), len(text) + len(x)))
            text += x + " " + filler() + " "
        for _ in range(rng.randint(0, 2)):
            text += rng.choice(other)() + " " + filler() + " "
        rows.append((i, text))
        truth[i] = spans
    return rows, truth


def test_added_spans_against_planted_truth(spark):
    rows, truth = planted(random.Random(1))
    hit = missed = wrong = 0
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x]
        meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
        found = sum(any(meets(s, g) for g in got) for s in truth[r["doc_id"]])
        hit, missed = hit + found, missed + len(truth[r["doc_id"]]) - found
        wrong += sum(not any(meets(s, g) for s in truth[r["doc_id"]]) for g in got)
    assert hit / (hit + missed) >= 0.95 and hit / (hit + wrong) >= 0.95
