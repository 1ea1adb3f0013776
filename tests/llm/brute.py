"""Plain Python versions of the operators."""

import re

import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}


def lower(t):
    return (t or "").translate(UPPER)


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def blank_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def contamination(text, items):
    """(n_words, n_hit, ids) of one text."""
    w = bench_words(text)
    hit, ids = set(), set()
    for item_id, item in items:
        x = bench_words(item)
        n = min(10, len(x))
        if not n:
            continue
        windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)}
        for j in range(len(w) - n + 1):
            if tuple(w[j : j + n]) in windows:
                hit.update(range(j, j + n))
                ids.add(item_id)
    return len(w), len(hit), ids


def simhash(text):
    w = blank_words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def luhn(digits):
    total = 0
    for j, c in enumerate(reversed(digits)):
        x = int(c) * (2 if j % 2 else 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t) if ok(m.group())]


def later_line_copies(docs, min_lines):
    """{doc number: removed line numbers} for texts in order."""
    seen, out = set(), {}
    for d, t in docs:
        if t is None:
            continue
        lines = t.split("\n")
        for i in range(len(lines) - min_lines + 1):
            k = tuple(lines[i : i + min_lines])
            if k in seen:
                out.setdefault(d, set()).update(range(i, i + min_lines))
            seen.add(k)
    return out
