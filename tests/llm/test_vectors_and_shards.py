"""Hard negatives, sharding and whitening against brute-force versions and on odd tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import hard_negatives, sharding, vectors, whitening

VECTORS = "vec_id long, embedding array<double>, label int"
ODD = [None, [], [None, 0.1, 0.2], [math.nan, 0.1, 0.2], [math.inf, 0.1, 0.2], [-math.inf, 0.1, 0.2]]


def whole(rows):
    """(vec_id, x) of the rows that take part, by plain Python."""
    return [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]


# ---- hard negatives


def brute_negatives(rows):
    part = [(i, x, (label + 1) % 10 if i % 7 == 0 else label) for i, x, label in whole([r for r in rows if r[0] is not None and r[2] is not None])]
    product = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a in part:
        if a[0] % 100:
            continue
        alike = sorted((-product(a[1], b[1]), b[0]) for b in part if b is not a and b[2] == a[2])[:5]
        for score, positive in alike:
            others = sorted((-product(a[1], b[1]), b[0]) for b in part if b[2] != a[2])
            fitting = [(-s, i) for s, i in others if 30 * -score <= 100 * -s <= 90 * -score][:10]
            out += [(a[0], positive, n, i, -score, s) for n, (s, i) in enumerate(fitting, 1)]
    return sorted(out)


def negative_rows(entries, n, dims=5, seed=1, step=100):
    r = random.Random(seed)
    rows = [(i * step // 20, [entries(r) for _ in range(dims)], r.choice([0, 1, 1, 1, 2, 9])) for i in range(n)]
    return list({row[0]: row for row in rows}.values())


@pytest.mark.parametrize(
    "entries",
    [lambda r: r.gauss(0, 0.2), lambda r: r.choice([-1, 0, 1]) / 256, lambda r: r.uniform(0, 3000.0), lambda r: -r.random(), lambda r: 0.0],
    ids=["normal", "ties", "large", "negative", "zero"],
)
def test_hard_negatives_against_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 70)
    monkeypatch.setattr(hard_negatives, "LEAST_GROUP_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "CHUNK", 32)
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    rows = negative_rows(entries, 300)
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert sorted(tuple(g) for g in got) == brute_negatives(rows)
    assert got or entries(random.Random(0)) <= 0


def test_hard_negatives_on_odd_tables(spark):
    rows = negative_rows(lambda r: r.gauss(0, 0.2), 120, dims=3)
    odd = [(50_000 + 100 * i, v, 1) for i, v in enumerate(ODD)] + [(60_000, [0.1, 0.2, 0.3], None), (None, [0.1, 0.2, 0.3], 1), (60_100, [1.0, 2.0], 1), (60_200, [1e30, 0.0, 0.0], 1)]
    table = spark.createDataFrame(rows + odd, VECTORS)
    got = hard_negatives.mine(table.withColumns({c: F.lit("mine") for c in ("row", "x", "anchor", "band", "score", "rank", "group", "kind", "low", "high", "chosen")}))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(g) for g in got.collect()) == brute_negatives(rows)
    assert hard_negatives.mine(table.where("false")).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, [0.5], 1)], VECTORS)).count() == 0
    repeated = hard_negatives.mine(spark.createDataFrame([(100, [0.5], 1)] * 2 + [(1, [0.25], 2)] * 2, VECTORS)).collect()
    assert sorted(tuple(g) for g in repeated) == [(100, 100, n, 1, 128 * 128, 128 * 64) for n in (1, 1, 2, 2)]


@pytest.mark.parametrize("seed", range(12))
def test_search_drops_no_pair_that_counts(monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "SPARSE", [0.0, 1 / 16, 1.0][seed % 3])
    g = np.random.default_rng(seed)
    scale, k = (2, 40, 30_000)[seed % 3], 3
    anchors, x = g.integers(-scale, scale + 1, (7, 6)), g.integers(-scale, scale + 1, (50, 6))
    allowed, exact = g.random((7, 50)) < 0.8, anchors @ x.T
    low = np.sort(g.integers(-6 * scale * scale, 6 * scale * scale, (7, 2)), axis=1)
    high, floor = low + 4 * scale * scale, np.full((7, 2), -hard_negatives.ALL)
    rows, columns, scores = hard_negatives.search(anchors, x.astype(np.int32), allowed, low, high, floor, k)
    assert (exact[rows, columns] == scores).all() and allowed[rows, columns].all()
    for i in range(7):
        for b in range(2):
            want = sorted((s for s, a in zip(exact[i], allowed[i]) if a and low[i, b] <= s <= high[i, b]), reverse=True)[:k]
            assert sorted((s for s in scores[rows == i] if low[i, b] <= s <= high[i, b]), reverse=True)[:k] == want


# ---- sharding


def brute_shards(spark, keys, shards, vnodes):
    """Rows of each shard by key counts, row after row round the ring; a row goes on to the next virtual node whose shard has room."""
    slot = {r.k: r.s for r in spark.createDataFrame([(k,) for k in {*keys, *(f"{s}/{c}" for s in range(shards) for c in range(vnodes))}], "k string").select("k", sharding.ring_slot(F.col("k")).alias("s")).collect()}
    owner = {}
    for s in reversed(range(shards)):
        owner |= {slot[f"{s}/{c}"]: s for c in range(vnodes)}
    nodes = sorted(owner)
    node = lambda k: next((n for n in nodes if n >= slot[k]), nodes[0])
    load = dict.fromkeys(nodes, 0)
    for k in keys:
        load[node(k)] += 1
    own = {s: sum(load[n] for n in nodes if owner[n] == s) for s in range(shards)}
    ranked = sorted(own, key=lambda s: (-own[s], s))
    room = {s: len(keys) // shards + (ranked.index(s) < len(keys) % shards) for s in own}
    at = dict.fromkeys(nodes, None)
    over = {}
    for n in nodes:
        stay = min(load[n], room[owner[n]])
        room[owner[n]] -= stay
        at[n], over[n] = {owner[n]: stay}, load[n] - stay
    for i, n in enumerate(nodes):
        for m in nodes[i:] + nodes[:i]:
            took = min(over[n], room[owner[m]])
            room[owner[m]] -= took
            over[n] -= took
            if took:
                at[n][owner[m]] = at[n].get(owner[m], 0) + took
    return node, {n: {s: c for s, c in of.items() if c} for n, of in at.items()}


@pytest.mark.parametrize(("n", "hot", "cell"), [(500, 0, 20), (400, 300, 20), (5, 0, 50_000), (40, 40, 3)])
def test_sharding_against_brute_force(spark, n, hot, cell):
    """With a key that fills much of the table, which repeats whole rows, and with cells that must be split."""
    keys = [str(i) for i in range(n)] + ["7"] * hot
    rows = spark.createDataFrame([(int(k), i % 3) for i, k in enumerate(keys)], "doc_id long, size int").repartition(5)
    got = sharding.assign(rows, shards=6, vnodes=8, cell_rows=cell).collect()
    node, want = brute_shards(spark, keys, 6, 8)
    found = {}
    for g in got:
        of = found.setdefault(node(str(g.doc_id)), {})
        of[g.shard] = of.get(g.shard, 0) + 1
    assert found == {m: of for m, of in want.items() if of}
    slots = {s: sorted(g.slot for g in got if g.shard == s) for s in range(6)}
    assert all(v == list(range(len(v))) for v in slots.values())
    counts = [len(v) for v in slots.values()]
    assert sum(counts) == len(keys) and max(counts) - min(counts) <= 1


def test_sharding_is_stable(spark):
    """However rows are dealt the result is the same; one more shard moves few rows besides those that it takes."""
    rows = spark.createDataFrame([(i,) for i in range(4000)], "doc_id long")
    by = lambda df: {r.doc_id: (r.shard, r.slot) for r in df.collect()}
    first = by(sharding.assign(rows.repartition(2), cell_rows=10))
    assert first == by(sharding.assign(rows.repartition(7), cell_rows=10))
    more = by(sharding.assign(rows, shards=17))
    moved = sum(first[d][0] != more[d][0] for d in first)
    taken = sum(s == 16 for s, _ in more.values())
    assert taken == 4000 // 17 + (4000 % 17 > 0) or taken == 4000 // 17
    assert moved < 2.5 * taken


def test_sharding_on_odd_tables(spark):
    r = random.Random(3)
    texts = [None, "", "a", "a", "x" * 100_000] + ["t" * r.randrange(50) for _ in range(40)]
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)] + [(None, None)] * 60, "doc_id long, text string")
    clashing = docs.withColumns({c: F.lit("mine") for c in ("shard", "slot", "node", "mark", "salt", "row", "number", "cell", "first", "of", "n")})
    got = sharding.assign(clashing, cell_rows=2)
    assert got.columns == [c for c in clashing.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = got.collect()
    assert sorted((str(g.doc_id), str(g.text)) for g in rows) == sorted((str(d.doc_id), str(d.text)) for d in docs.collect())
    counts = [sum(g.shard == s for g in rows) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(g.slot for g in rows if g.shard == s) == list(range(counts[s])) for s in range(16))
    assert sharding.assign(docs.where("false")).count() == 0


# ---- whitening


def brute_whitening(rows):
    x = np.array([v for _, v, _ in whole(rows)], dtype=np.int64)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, x, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize(("dims", "spread"), [(6, 0.3), (3, 4.0), (20, 0.05)])
def test_whitening_against_brute_force(spark, dims, spread):
    r = random.Random(dims)
    rows = [(i, [r.gauss(0.1 * d, spread * (d + 1)) for d in range(dims)], 0) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(150)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(4)).orderBy("vec_id", "component").collect()
    n, sums, x, values, axes = brute_whitening(rows)
    kept = min(4, dims)
    assert n == 300 and len(got) == kept * len(rows) and {g.n for g in got} == {300}
    found = np.array([g.whitened for g in got]).reshape(-1, kept)
    want = (x - sums / n) @ axes[:, :kept] / np.sqrt(values[:kept])
    assert np.abs(np.abs(found) - np.abs(want)).max() < 1e-9
    assert [int(g.deviation) for g in got[::kept]] == [sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums)) for v in x]
    assert np.allclose([g.explained for g in got[:kept]], values[:kept] / values.sum(), rtol=1e-9)
    assert got[0].identity_error < 1e-9
    signs = {tuple(np.sign(np.round(f * w, 9))) for f, w in zip(found, want) if np.abs(f).min() > 1e-6}
    assert len(signs) == 1  # the same signs for all rows


def test_whitening_on_odd_tables(spark):
    r = random.Random(8)
    good = [(i, [r.random(), r.random(), 0.5], 0) for i in range(50)]
    odd = [(100 + i, v, 0) for i, v in enumerate(ODD)] + [(200, [1.0, 2.0], 0), (None, good[3][1], None)]
    table = spark.createDataFrame(good + odd, VECTORS)
    got = whitening.whiten(table.withColumns({c: F.lit("mine") for c in ("x", "n", "component", "whitened", "deviation", "at", "centred")})).collect()
    # the third entry has no variance: two components; the row without an id stays
    assert sorted({g.component for g in got}) == [1, 2] and len(got) == 2 * 51 and {g.n for g in got} == {50}
    assert sum(g.vec_id is None for g in got) == 2 and all(math.isfinite(g.whitened) for g in got)
    for rows in ([], [(1, [0.5, 0.5], 0)] * 3, [(1, None, 0)], [(1, [], 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e12, 0.0], 0), (2, [0.0, 1.0], 0)], VECTORS)).orderBy("vec_id").collect()
    x = 256 * 10**12
    # the square of an entry that large isn't in a long
    assert [g.deviation for g in huge] == [None, (2 * 0 - x) ** 2 + (2 * 256 - 256) ** 2] and [g.component for g in huge] == [1, 1]


def test_finite_vectors(spark):
    rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate([*ODD, [-0.0, 0.5, -0.001]])], VECTORS)
    assert [(r.vec_id, list(r.x)) for r in vectors.with_integers(rows).collect()] == [(1, []), (6, [0, 128, -1])]
