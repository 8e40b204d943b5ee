"""Centroid clustering and conversation repair against brute force, with nulls, empty texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from pairsignal.llm import centroids, conversations


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            cents[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    own = {n: sum(d for _, d, m in found if m == n) for n in range(k)}
    total = sum(d for _, d, _ in found)
    return sorted(((i, n, d, own[n], total, hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def test_clusters(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(64)]) for i in range(150)]
    rows += [rows[4], rows[4], (200, rows[4][1]), (None, rows[5][1]), (201, None), (202, [0.1] * 63), (203, [None] + [0.1] * 63)]
    rows += [(204, [math.inf] + [0.1] * 63), (205, [math.nan] + [0.1] * 63), (206, [-0.0] * 64)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, cluster int")
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(table).collect()), key=str)
    assert got == brute_clusters(rows)
    few = table.filter("vec_id < 5")
    assert centroids.cluster(few).count() == few.count()
    assert centroids.cluster(table.limit(0)).columns == centroids.cluster(table).columns and centroids.cluster(table.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert [r.distance for r in centroids.cluster(huge).collect()] == [0, 0]


SPACE = " \t\n\r\x0b\x0c"


def brute_rows(table):
    found = {}
    for conv, turn, role, text in table:
        rows = found.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"={r[1]}\x01={r[2]}".encode()).digest())
    return {c: sorted(rows, key=key) for c, rows in found.items()}


def brute_repair(rows):
    """Cheapest cost and first initials by dynamic programming over all edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}
    def insert(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    to = step.get((state, role[0]))
                    if to and (cost + 5, audit + "I") < best.get(to, (1 << 60, ""))[:2]:
                        best[to] = (cost + 5, audit + "I", (*out, role + ":"))
    for (_, role, text), fault in zip(rows, faults):
        insert(best)
        after = {}
        def offer(state, value):
            if value[:2] < after.get(state, (1 << 60, ""))[:2]:
                after[state] = value
        for state, (cost, audit, out) in best.items():
            offer(state, (cost + 2, audit + "D", out))
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                if (to := step.get((state, role[0]))):
                    offer(to, (cost + extra, audit + "K", (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (to := step.get((state, new[0]))):
                        offer(to, (cost + extra + 1, audit + "R", (*out, f"{new}:{text}")))
        best = after
    insert(best)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    wrong = sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, wrong, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(7)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "University"]
    roles = [r or (None if r is None else "x") for r in roles]
    texts = ["Hello there.", "Well?", "no end", " ", "", None, "\t\n", "Yes!  \n", "é. ", "Fine.", "So it is."]
    rows = []
    for conv in range(120):
        for turn in range(draw.randrange(0, 9)):
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), draw.choice(roles[:4] if conv % 2 else roles), draw.choice(texts) if conv % 3 else f"text {turn}."))
    rows += [(None, t, "user" if t % 2 else "assistant", "Hi.") for t in range(5)] + [(500, t, draw.choice(roles), f"{draw.choice(texts)}{t // 3}.") for t in range(700)]
    rows += [(501, 2, "user", "x" * 300000 + ".")] + [(502, t, "system", "Same.") for t in range(40)]
    return rows + rows[10:30]


@pytest.mark.parametrize("block", [1, 5, 128])
def test_conversations(spark, talks, block):
    table = spark.createDataFrame([(*r, "k", 0) for r in talks], "conv_id long, turn long, role string, text string, conv string, rank int")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r[n] for n in names) for r in conversations.repair(table, block).collect()}
    assert got == {c: brute_repair(rows) for c, rows in brute_rows(talks).items()}
    assert conversations.repair(table.limit(0), block).count() == 0


def test_prices_of_small_lattices():
    """All rows of three kinds and faults: the auction's cost is that of trying every edit."""
    for codes in itertools.product([0, 4, 5, 8, 9, 10, 12], repeat=4):
        rows = []
        for n, code in enumerate(codes):
            kind, fault = divmod(code, 4)
            rows.append((n, ["system", "user", "assistant", "tool"][kind], "" if fault == 2 else f"t{n}" + ("." if fault == 0 else "")))
        lattice = conversations.Lattice(codes, conversations.AT_END, True)
        assert (lattice.solve(0), lattice.trace(0)[0]) == brute_repair(rows)[5:7]
