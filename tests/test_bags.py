"""Distances, eps-join, clustering, scaling, splits and evaluation on small inputs and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagloom.functions import vectors as V
from bagloom.operators import accessors, cluster, epsjoin, evaluate, largebags, projection, sampling, scaling
from bagloom.sources import synthetic

BAGS = "pos long, bag_id string, label string, instances array<array<double>>"


def bags_of(spark, bags, labels=None):
    return spark.createDataFrame([(i, f"b{i}", (labels or {}).get(i, "0"), b) for i, b in enumerate(bags)], BAGS)


def brute(a, b):
    if not a or not b:
        return math.inf
    if any(math.isnan(v) for p in a + b for v in p):
        return math.nan
    return max(max(min(math.dist(p, q) for q in b) for p in a), max(min(math.dist(p, q) for q in a) for p in b))


def random_bags(n, seed, dims=2, spread=4.0):
    r = random.Random(seed)
    return [[[r.uniform(0, spread) for _ in range(dims)] for _ in range(r.randint(1, 3))] for _ in range(n)]


EDGES = [
    ([[0.0, 0.0]], [[3.0, 4.0]], 5.0),
    ([[0.0, 0.0], [1.0, 1.0]], [[0.0, 3.0]], 3.0),
    ([[1.0], [1.0]], [[1.0]], 0.0),
    ([], [[1.0, 2.0]], math.inf),
    ([[1.0, float("nan")]], [[1.0, 2.0]], math.nan),
]


def test_distance_columns_and_kernel_agree(spark):
    pairs = [(x, y) for x, y, _ in EDGES[:2] + EDGES[3:]] + [(a, b) for a, b in zip(random_bags(20, 1), random_bags(20, 2))]
    df = spark.createDataFrame([(i, i, a, b) for i, (a, b) in enumerate(pairs)], "a long, b long, x array<array<double>>, y array<array<double>>")
    want = [brute(x, y) for x, y in pairs]
    columns = [r.d for r in df.orderBy("a").select(V.hausdorff(F.col("x"), F.col("y"), 2).alias("d")).collect()]
    kernel = [r.dist for r in epsjoin._measured(df, 2, "hausdorff").orderBy("a").collect()]
    for w, c, k in zip(want, columns, kernel):
        assert (math.isnan(w) and math.isnan(c) and math.isnan(k)) or (w == pytest.approx(c) == pytest.approx(k))


def test_directed_is_not_symmetric(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [1.0, 1.0]], [[0.0, 3.0]])], "x array<array<double>>, y array<array<double>>")
    r = df.select(V.directed_hausdorff(F.col("x"), F.col("y"), 2).alias("u"), V.directed_hausdorff(F.col("y"), F.col("x"), 2).alias("v")).first()
    assert r.u == pytest.approx(3.0) and r.v == pytest.approx(math.sqrt(5))


def test_unknown_metric_lists_known_ones():
    with pytest.raises(ValueError, match="hausdorff"):
        V.metric("minkowski")


@pytest.mark.parametrize("eps", [0.4, 9.0])
def test_eps_join_is_all_pairs(spark, eps):
    bags = random_bags(60, 3, spread=10.0) + [[], [[float("nan"), 1.0]]]
    found = {(r.a, r.b) for r in epsjoin.links(bags_of(spark, bags), eps, 2).collect()}
    want = {(i, j) for i in range(len(bags)) for j in range(i + 1, len(bags)) if brute(bags[i], bags[j]) <= eps}
    assert found == want


@pytest.mark.parametrize(("busy", "crowded", "rows", "pairs"), [(1, 3, 50, 7), (0, 10**6, 10**6, 10**6), (10, 1, 1, 1), (10**9, 5, 100, 50)])
def test_eps_join_in_parts(spark, monkeypatch, busy, crowded, rows, pairs):
    """Crowded cells dealt into parts, and sweeps of few rows, change no pair; each pair comes once."""
    for name, value in (("BUSY", busy), ("CROWDED", crowded), ("ROWS", rows), ("PAIRS", pairs)):
        monkeypatch.setattr(epsjoin, name, value)
    bags = random_bags(90, 11, dims=3, spread=2.0) + [[[0.5, 0.5, 0.5]]] * 25 + [[[float("inf"), 0.0, 0.0]], [[1e300, 0.0, 0.0]], []]
    r = random.Random(3)
    bags += [[[v + r.uniform(-0.3, 0.3) for v in p] for p in b] for b in bags[:20]]
    df = bags_of(spark, bags).repartition(3)
    found = sorted((x.a, x.b) for x in epsjoin.links(df, 0.5, 3).collect())
    assert found == [(i, j) for i in range(len(bags)) for j in range(i + 1, len(bags)) if brute(bags[i], bags[j]) <= 0.5]
    a, b = df.where("pos < 40"), df.where("pos >= 30")
    got = sorted((x.pos_a, x.pos_b) for x in epsjoin.near(a, b, 0.4, 3).collect())
    assert got == [(i, j) for i in range(40) for j in range(30, len(bags)) if i == j and brute(bags[i], bags[i]) == 0 or i != j and brute(bags[i], bags[j]) <= 0.4]


def test_eps_join_makes_few_candidates(spark):
    bags = random_bags(1500, 12, dims=3, spread=3.0)
    boxes = epsjoin._boxed(bags_of(spark, bags), 3, 0.3)
    links = sum(1 for i in range(300) for j in range(i + 1, 300) if brute(bags[i], bags[j]) <= 0.3)
    made = epsjoin.candidates(boxes, boxes, 0.3, once=True)
    assert made.count() < 20_000 and made.where("pos_b < 300").count() >= links


def test_all_pairs_are_dealt_evenly(spark):
    bags = random_bags(30, 13)
    found = {(r.a, r.b): r.dist for r in epsjoin.all_pairs(bags_of(spark, bags)).collect()}
    assert set(found) == {(i, j) for i in range(30) for j in range(i + 1, 30)} and all(d == pytest.approx(brute(bags[i], bags[j])) for (i, j), d in found.items())
    assert "Cartesian" not in epsjoin.all_pairs(bags_of(spark, bags))._jdf.queryExecution().toString() and "NestedLoop" not in epsjoin.all_pairs(bags_of(spark, bags))._jdf.queryExecution().toString()


@pytest.mark.parametrize("part", [3, 512])
def test_bags_in_parts(spark, monkeypatch, part):
    """One bag holds most instances; parts give what whole bags give; NaN counts."""
    monkeypatch.setattr(largebags, "PART", part)
    monkeypatch.setattr(largebags, "CELLS", 16)
    bags = [b * 1 for b in random_bags(6, 15)] + [[p for b in random_bags(30, 16) for p in b], [[1.0, float("nan")], [2.0, 2.0]]]
    rows = spark.createDataFrame([(i, p) for i, b in enumerate(bags) for p in b], "pos long, features array<double>")
    directed = {(r.a, r.b): r.dist for r in largebags.directed(rows, 2).collect()}
    whole = {(r.a, r.b): r.dist for r in largebags.hausdorff(rows, 2).collect()}
    ends = {(r.a, r.b): (r.least, r.most) for r in largebags.extremes(rows, 2).where("b < 7").collect()}
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            if i == j:
                continue
            if 7 in (i, j):
                assert math.isnan(directed[i, j]) and math.isnan(whole[min(i, j), max(i, j)])
                continue
            assert directed[i, j] == pytest.approx(max(min(math.dist(p, q) for q in b) for p in a))
            if i < j:
                every = [math.dist(p, q) for p in a for q in b]
                assert whole[i, j] == pytest.approx(brute(a, b)) and ends[i, j] == pytest.approx((min(every), max(every)))


def test_other_metrics_compare_all_pairs(spark, monkeypatch):
    monkeypatch.setitem(V.METRICS, "first", lambda a, b, dims: F.abs(a[0][0] - b[0][0]))
    bags = random_bags(20, 14)
    found = {(r.a, r.b) for r in epsjoin.links(bags_of(spark, bags), 0.5, 2, "first").collect()}
    assert found == {(i, j) for i in range(20) for j in range(i + 1, 20) if abs(bags[i][0][0] - bags[j][0][0]) <= 0.5}


def test_ragged_instances_raise(spark):
    with pytest.raises(ValueError, match="dimensions"):
        epsjoin.dimensions(bags_of(spark, [[[1.0, 2.0]], [[1.0]]]))


def scan(bags, eps, min_pts, mode):
    """Plain scan over a full matrix."""
    n = len(bags)
    near = [[j for j in range(n) if i == j or brute(bags[i], bags[j]) <= eps] for i in range(n)]
    core = [len(x) >= min_pts for x in near]
    label, c = [None] * n, 0
    for i in range(n):
        if label[i] is not None or (mode == "strict" and not core[i]):
            continue
        todo, label[i] = [i], c
        for at in todo:
            if core[at] or (mode == "compat" and at == i):
                for j in near[at]:
                    if label[j] is None and (mode == "compat" or core[j]):
                        label[j] = c
                        todo.append(j)
        c += 1
    if mode == "strict":
        label = [x if x is not None else min((label[j] for j in near[i] if core[j]), default=-1) for i, x in enumerate(label)]
    return label, core


@pytest.mark.parametrize(("mode", "min_pts"), [("strict", 3), ("compat", 2), ("compat", 3), ("compat", 1)])
def test_fit_matches_a_plain_scan(spark, mode, min_pts):
    bags = random_bags(50, 5) + [[]]
    model = cluster.fit(bags_of(spark, bags), 0.9, min_pts, mode, dims=2)
    rows = {r.pos: r for r in model.assignments.collect()}
    label, core = scan(bags, 0.9, min_pts, mode)
    assert [rows[i].cluster_id for i in range(len(bags))] == label
    assert [rows[i].is_core for i in range(len(bags))] == core
    assert model.cluster_count == len({x for x in label if x >= 0})


def test_predict_nearest_core_and_ties(spark):
    train = [[[0.0]], [[0.25]], [[2.0]], [[2.25]]]
    model = cluster.fit(bags_of(spark, train), 0.875, 2, "strict", dims=1)
    test = bags_of(spark, [[[0.5]], [[1.125]], [[9.0]], []])
    found = {r.pos: r.cluster_id for r in model.predict(test).collect()}
    assert found == {0: 0, 1: 0, 2: -1, 3: -1}  # 1.125 is as far from 0.25 as from 2: the lesser id
    assert model.statistics().first().clusters == 2
    assert {r.pos for r in model.members(1).collect()} == {2, 3}


def test_no_cores_predict_noise_only(spark):
    far = bags_of(spark, [[[0.0]], [[10.0]], [[20.0]]])
    compat = cluster.fit(far, 0.5, 2, "compat", dims=1)
    assert compat.cluster_count == 3 and compat.cores.count() == 0
    assert {r.cluster_id for r in compat.predict(far).collect()} == {-1}
    strict = cluster.fit(far, 0.5, 2, "strict", dims=1)
    assert strict.cluster_count == 0 and strict.noise().count() == 3


def test_guards(spark):
    bags = bags_of(spark, [[[0.0]]])
    for eps, min_pts, mode in ((0, 2, "strict"), (1, 0, "strict"), (1, 2, "loose")):
        with pytest.raises(ValueError):
            cluster.fit(bags, eps, min_pts, mode)
    with pytest.raises(ValueError):
        cluster.fit(bags.limit(0), 1, 2)
    with pytest.raises(ValueError):
        cluster.fit(bags, 1, 1, dims=1).predict(bags.limit(0))


def test_scalers(spark):
    bags = bags_of(spark, [[[1.0, 5.0], [2.0, 5.0]], [[4.0, 5.0]]])
    values = lambda df: [v for r in df.orderBy("pos").collect() for p in r.instances for v in p]
    m = scaling.MinMax(low=0.0, high=10.0).fit(bags)
    assert values(m.transform(bags)) == pytest.approx([0, 0, 10 / 3, 0, 10, 0])
    assert values(m.inverse(m.transform(bags))) == pytest.approx(values(bags))
    z = scaling.ZScore().fit(bags)
    assert values(z.transform(bags))[::2] == pytest.approx([-1.06904, -0.26726, 1.33631], abs=1e-4)
    assert values(z.transform(bags))[1::2] == [0, 0, 0]
    assert values(scaling.MinMax(numeric=[1]).fit_transform(bags))[::2] == [1, 2, 4]
    with pytest.raises(scaling.NotFitted):
        scaling.MinMax().transform(bags)
    with pytest.raises(ValueError):
        scaling.MinMax(low=1.0, high=1.0)
    with pytest.raises(ValueError):
        scaling.ZScore().fit(bags_of(spark, [[]]))


def test_splits_have_exact_sizes(spark):
    bags = bags_of(spark, random_bags(35, 7))
    train, test = sampling.exact_split(bags, 70, 42)
    order = list(range(35))
    random.Random(42).shuffle(order)
    assert [r.bag_id for r in train.orderBy("pos").collect()] == [f"b{i}" for i in order[:24]]
    assert [r.bag_id for r in test.orderBy("pos").collect()] == [f"b{i}" for i in order[24:]]
    a, b = sampling.hash_split(bags, 70, 42)
    assert (a.count(), b.count()) == (24, 11) and a.join(b, "pos").count() == 0


def test_majority_tie_goes_to_the_lesser_class(spark):
    found = spark.createDataFrame([(0, 0, 1), (1, 0, 0), (2, 1, 1), (3, 1, 1), (4, -1, 0)], "pos long, cluster_id int, truth int")
    assert {r.cluster_id: r.class_id for r in evaluate.class_map(found).collect()} == {0: 0, 1: 1, -1: 0}
    m = evaluate.metrics(found).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (2, 0, 1, 2)
    assert (m.precision, m.recall, m.specificity) == (1.0, pytest.approx(2 / 3), 1.0) and m.f1 == pytest.approx(0.8)
    none = evaluate.metrics(found.where("truth = 0")).first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)
    assert "cluster 1 -> class 1" in evaluate.report(found)


def test_accessors(spark):
    bags = bags_of(spark, [[[1.0, 2.0], [3.0, 4.0]]], {0: "pos"})
    r = bags.select(accessors.instance_at(F.col("instances"), 1).alias("i"), V.put(F.col("instances")[0], 0, F.lit(9.0)).alias("p"), accessors.contains(F.col("instances"), F.array(F.lit(3.0), F.lit(4.0))).alias("c"), F.size(accessors.appended(F.col("instances"), F.array(F.lit(0.0), F.lit(0.0)))).alias("n")).first()
    assert (r.i, r.p, r.c, r.n) == ([3.0, 4.0], [9.0, 2.0], True, 3)
    assert accessors.positive(bags).count() == 1 and accessors.negative(bags).count() == 0
    assert accessors.bag_at(bags, 0).first().bag_id == "b0" and accessors.bag_at(bags, 1).isEmpty()
    with pytest.raises(IndexError):
        accessors.bag_at(bags, -1)
    assert accessors.relabelled(bags, F.lit(0)).first().label == "0"
    assert [r.weight for r in accessors.with_weight(accessors.unnested(bags)).collect()] == [1.0, 1.0]
    assert [r.weight for r in accessors.with_weight(accessors.unnested(bags), F.get("features", 0)).collect()] == [1.0, 3.0]
    with pytest.raises(Exception, match="out of range"):
        bags.select(accessors.instance_at(F.col("instances"), -1)).collect()
    with pytest.raises(Exception, match="out of range"):
        bags.select(V.put(F.col("instances")[0], 2, F.lit(9.0))).collect()


def test_pca_and_tsne(spark):
    data = synthetic.two_clouds(spark)
    xy = {r.bag_id: (r.x, r.y) for r in projection.pca(data.bags).collect()}
    assert len(xy) == 35
    mean = [sum(v[k] for v in xy.values()) / 35 for k in (0, 1)]
    assert mean == pytest.approx([0, 0], abs=1e-9)
    x = np.array([np.mean(r.instances, axis=0) for r in data.bags.orderBy("pos").collect()])
    x = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    v *= np.sign(v[range(2), np.abs(v).argmax(axis=1)])[:, None]
    assert np.allclose([xy[r.bag_id] for r in data.bags.orderBy("pos").select("bag_id").collect()], x @ v.T)
    assert projection.tsne(data.bags, rounds=20).count() == 35
    model = cluster.fit(data.bags, 3.0, 2, "strict")
    assert projection.plot_table(data.bags, model.assignments).count() == 35
