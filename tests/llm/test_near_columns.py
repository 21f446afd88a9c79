"""The likeness columns of fingerprints against a slow edit distance, ties and repeated rows included; and the mix with ties."""

import math

from test_operators import rng


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def like(x, y):
    if x == y:
        return 1.0
    (a, a1, a2), (b, b1, b2) = x.split(":"), y.split(":")
    pairs = [(a1, b1), (a2, b2)] if a == b else [(a1, b2)] if int(a) == 2 * int(b) else [(a2, b1)] if int(b) == 2 * int(a) else []
    return max([0.0, *(1 - distance(p, q) / max(len(p), len(q)) for p, q in pairs if p and q)])


def test_likeness_columns(spark):
    from millrace.llm.fuzzy import fingerprint, fingerprints

    base = "".join(rng.choices("abcdefgh ", k=3000))
    texts = [base, base[:1500] + "x" + base[1500:], base, "", None, base[:900], "".join(rng.choices("xyz ", k=3000)), base[:2500], "short"]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(0, base)]
    got = sorted(tuple(r) for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    order = sorted((i, t or "") for i, t in rows)
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        own, edited = fingerprint(t.encode()), fingerprint((t[: len(t) - half] + after[:half]).encode())
        want.append((i, len(t), own, edited, like(own, edited), like(own, fingerprint(after.encode()))))
    assert len(got) == len(want)
    for g, w in zip(sorted((g[0], g[1], *g[3:]) for g in got), sorted(want), strict=True):
        assert g[:4] == w[:4] and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(g[4:], w[4:], strict=True))


def test_mix_with_ties_and_without_ids(spark):
    """Blocks and slots worked out in plain Python: running sizes in order of id and size, earliest deadline first."""
    from millrace.llm.mixing import mix

    rows = [(k % 7 if k % 5 else None, "x" * (5 * (k % 11)), f"s{k % 3}" if k % 4 else None) for k in range(60)]
    got = sorted((tuple(r) for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), block_chars=40, parts=12).collect()), key=str)
    sources = sorted({s or "" for _, _, s in rows})
    sizes = {s: sum(len(t) for _, t, x in rows if (x or "") == s) for s in sources}
    q = {s: max(1, math.floor(sizes[s] ** 0.9 * 12 / sum(round(v**0.9, 6) for v in sizes.values()) + 1e-9)) for s in sources}
    n = sum(q.values())
    done, slots = dict.fromkeys(sources, 0), {}
    for t in range(n):
        ready = [(-(-(done[s] + 1) * n // q[s]), s) for s in sources if done[s] * n // q[s] <= t]
        s = min(ready)[1]
        slots[s, done[s]] = t
        done[s] += 1
    assert all(done[s] == q[s] for s in sources)
    at = lambda s, b: b // q[s] * n + slots[s, b % q[s]]
    ends = min(at(s, -(-max(sizes[s], 1) // 40)) for s in sources)
    want = []
    for s in sources:
        total = 0
        for i, size in sorted(((i, len(t)) for i, t, x in rows if (x or "") == s), key=lambda x: (-1 if x[0] is None else x[0], x[1])):
            b = total // 40
            want.append((i, s, size, b, at(s, b), at(s, b) < ends))
            total += size
    assert got == sorted(want, key=str)
