"""Listwise trees against a plain version with rows in lists, and their odd inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import boosting as B

FEATURES = [f"f{i}" for i in range(1, 5)]
SCHEMA = "session long, item long, label int, " + ", ".join(f"{f} double" for f in FEATURES)


def lists_of(sessions, items=8, seed=3):
    r = random.Random(seed)
    rows = []
    for s in range(sessions):
        for i in range(items):
            f = [round(r.random(), 3), float(r.random() < 0.3), 0.0, r.random()]
            rows.append((s, i, int(f[0] > 0.6) + int(f[0] > 0.8 and f[1] > 0), *f))
    return rows


def plain_gradients(own, scores):
    ideal = sum((2 ** v - 1) / math.log2(k + 2) for k, v in enumerate(sorted((x[2] for x in own), reverse=True)))
    order = sorted(range(len(own)), key=lambda j: (-scores[j], own[j][1]))
    place = {j: p for p, j in enumerate(order)}
    out = []
    for a, x in enumerate(own):
        g = h = 0.0
        for b, y in enumerate(own):
            if x[2] != y[2] and ideal:
                change = abs((2 ** x[2] - 2 ** y[2]) * (1 / math.log2(place[a] + 2) - 1 / math.log2(place[b] + 2))) / ideal
                up = x[2] > y[2]
                rho = 1 / (1 + math.exp(scores[a] - scores[b] if up else scores[b] - scores[a]))
                g, h = g + (rho if up else -rho) * change, h + rho * (1 - rho) * change
        out.append((round(g * 2**30) / 2**30, round(h * 2**30) / 2**30))
    return out


def plain_trees(rows, how, cuts):
    by = {}
    for x in rows:
        by.setdefault(x[0], []).append(x)
    by = {s: own for s, own in by.items() if any(x[2] for x in own)}
    scores = {s: [0.0] * len(own) for s, own in by.items()}
    made = []
    for _ in range(how.rounds):
        data = [(x[3:], g, h, s, j) for s, own in by.items() for j, (x, (g, h)) in enumerate(zip(own, plain_gradients(own, scores[s])))]

        def best(part):
            G, H = sum(d[1] for d in part), sum(d[2] for d in part)
            found = None
            for f in range(len(FEATURES)):
                for c in cuts[f]:
                    left = [d for d in part if d[0][f] <= c]
                    hl, gl = sum(d[2] for d in left), sum(d[1] for d in left)
                    if min(len(left), len(part) - len(left)) < how.least or min(hl, H - hl) < B.LEAST_WEIGHT:
                        continue
                    gain = gl * gl / hl + (G - gl) ** 2 / (H - hl) - G * G / H
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, f, c)
            return found

        leaves, level, splits = {0: data}, [0], []
        for _ in range(how.depth):
            wins = sorted(((w, leaf) for leaf in level if (w := best(leaves[leaf]))), key=lambda c: (-c[0][0], c[1]))[: how.leaves - len(leaves)]
            level = []
            for (_, f, c), leaf in wins:
                new, part = len(leaves), leaves[leaf]
                leaves[leaf], leaves[new] = [d for d in part if d[0][f] <= c], [d for d in part if d[0][f] > c]
                splits.append((f, c))
                level += [leaf, new]
        values = []
        for leaf in range(len(leaves)):
            v = how.rate * sum(d[1] for d in leaves[leaf]) / sum(d[2] for d in leaves[leaf])
            values.append(v)
            for d in leaves[leaf]:
                scores[d[3]][d[4]] += v
        made.append((splits, values))
    return made, {(s, x[1]): v for s, own in by.items() for x, v in zip(own, scores[s])}


def test_trees_are_those_of_a_plain_version(spark):
    rows = lists_of(500)
    how = B.Growth(rounds=10, leaves=6, depth=3, rate=0.3, bins=16, watched=0.0)
    table = spark.createDataFrame(rows, SCHEMA)
    cuts = B.quantile_cuts(table, FEATURES, how.bins)
    assert cuts[1] == [0.0] and cuts[2] == []
    for f in (0, 3):
        values = sorted(x[3 + f] for x in rows)
        assert cuts[f] == sorted({values[math.ceil(i * len(values) / 16) - 1] for i in range(1, 16)})
    want, scores = plain_trees(rows, how, cuts)
    model = B.boost(table.repartition(5), FEATURES, how)
    assert len(model.trees) == 10 > B.TREES_ON_THE_FLY
    for got, (splits, values) in zip(model.trees, want, strict=True):
        assert list(zip(map(int, got["split_feature"]), got["threshold"], strict=True)) == splits
        assert got["leaf_value"] == pytest.approx(values, abs=1e-6)
    on = table.withColumn("v", B.trees_sum(model.trees, FEATURES)).collect()
    assert {(x.session, x.item): x.v for x in on if (x.session, x.item) in scores} == {k: pytest.approx(v, abs=1e-5) for k, v in scores.items()}
    assert model.trees == B.boost(table.repartition(2, "item"), FEATURES, how).trees


def test_training_stops_when_watched_sessions_stop_gaining(spark):
    r = random.Random(9)
    noise = [(s, i, r.randint(0, 2), *[r.random() for _ in FEATURES]) for s in range(60) for i in range(6)]
    how = B.Growth(rounds=12, leaves=4, depth=2, rate=0.5, bins=8, patience=2, watched=0.3)
    model = B.boost(spark.createDataFrame(noise, SCHEMA), FEATURES, how)
    best = max(range(len(model.watched)), key=lambda i: (model.watched[i], -i))
    assert len(model.trees) == best + 1 and len(model.watched) in (best + 3, 12)
    apart = spark.createDataFrame(noise, SCHEMA).withColumn("score", B.trees_sum(model.trees, FEATURES))
    lists = B.listed(apart.where(F.pmod(F.xxhash64("session", F.lit("watched")), F.lit(1 << 20)) < int(0.3 * (1 << 20))), [])
    assert B.mean_ndcg(lists, 10) == pytest.approx(model.watched[best])


def test_odd_lists(spark):
    how = B.Growth(rounds=2, leaves=4, depth=2, rate=0.3, bins=8, watched=0.0)
    none = spark.createDataFrame([], SCHEMA)
    assert B.boost(none, FEATURES, how).trees == [] and B.mean_ndcg(B.listed(none.withColumn("score", F.lit(0.0)), []), 5) == 0.0
    alike = spark.createDataFrame([(s, i, 1, 0.1 * i, 0.0, 0.0, 0.0) for s in range(9) for i in range(4)], SCHEMA)
    assert B.boost(alike, FEATURES, how).trees == []
    rows = lists_of(40)
    odd = [*rows, (None, 1, 1, 0.5, 0.0, 0.0, 0.0), (7, None, 1, 0.5, 0.0, 0.0, 0.0)]
    clash = spark.createDataFrame(odd, SCHEMA).withColumns({"score": F.lit(5.0), "bins": F.lit("x"), "_part": F.lit(1), "items": F.lit(2), "ideal": F.lit(3)})
    assert B.boost(clash, FEATURES, how).trees == B.boost(spark.createDataFrame(rows, SCHEMA), FEATURES, how).trees
    null = spark.createDataFrame([*rows, (50, 1, None, None, None, None, None), (50, 2, 2, None, None, None, None)], SCHEMA)
    assert B.boost(null, FEATURES, how).trees == B.boost(null.na.fill(0), FEATURES, how).trees != []
    one = [(1, i, i % 3, i / 900, 0.0, 0.0, 0.0) for i in range(900)]
    parts = B.listed(spark.createDataFrame(one, SCHEMA).withColumn("score", F.lit(0.0)), [], longest=100).select(F.size("items").alias("n")).collect()
    assert sum(p.n for p in parts) == 900 and len(parts) == 9 and max(p.n for p in parts) < 200


def test_saved_model_scores_alike(spark, tmp_path):
    model = B.boost(spark.createDataFrame(lists_of(40), SCHEMA), FEATURES, B.Growth(rounds=3, leaves=4, depth=2, rate=0.3, bins=8))
    model.save(spark, f"{tmp_path}/m", 1)
    again = B.Boosted.load(spark, f"{tmp_path}/m")
    assert again == model and again.importance()[0][0] == "f1"
