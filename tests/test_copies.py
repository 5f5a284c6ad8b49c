"""Bags with many copies: pairs are measured between classes only, and give what all pairs give."""

import math
import random

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import pytest

from bagloom.operators import cluster, copies, epsjoin, sampling
from test_bags import bags_of, brute, random_bags, scan


def copied(n, seed):
    """Bags with copies in another order of instances, copies of bags without neighbours, and near bags."""
    r = random.Random(seed)
    kinds = random_bags(n, seed) + [[], [[float("nan"), 1.0]], [[float("inf"), 1.0]]]
    bags = [r.sample(b, len(b)) for b in kinds for _ in range(r.randint(1, 4))]
    r.shuffle(bags)
    return bags


def test_links_of_classes_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(copies, "LISTED", 2)
    bags = copied(25, 21) + [[[9.0, 9.0]]] * 30
    of = copies.classes(bags_of(spark, bags).repartition(3))
    sound = [b for b in bags if b and all(math.isfinite(v) for p in b for v in p)]
    assert of.reps.count() == len({str(sorted(b)) for b in sound}) + len(bags) - len(sound)
    got = sorted((x.a, x.b, x.dist) for x in copies.expanded(epsjoin.links(of.reps, 0.9, 2), of).collect())
    want = [(i, j) for i in range(len(bags)) for j in range(i + 1, len(bags)) if brute(bags[i], bags[j]) <= 0.9]
    assert [x[:2] for x in got] == want and all(d == pytest.approx(brute(bags[i], bags[j])) for i, j, d in got)
    some = copies.restricted(of, of.members.where("pos % 3 = 0"))
    kept = sorted((x.a, x.b) for x in copies.expanded(epsjoin.links(some.reps, 0.9, 2), some).collect())
    assert kept == [(i, j) for i, j in want if i % 3 == j % 3 == 0]


@pytest.mark.parametrize(("mode", "min_pts"), [("strict", 4), ("compat", 2), ("compat", 4), ("compat", 5)])
def test_fit_measures_classes(spark, monkeypatch, mode, min_pts):
    """Copies are clustered as a plain scan does; only one bag of each class is joined."""
    boxed, sizes = epsjoin._boxed, []
    monkeypatch.setattr(epsjoin, "_boxed", lambda bags, *a: sizes.append(bags.count()) or boxed(bags, *a))
    bags = copied(18, 22)
    model = cluster.fit(bags_of(spark, bags), 0.8, min_pts, mode, dims=2)
    rows = {r.pos: r for r in model.assignments.collect()}
    label, core = scan(bags, 0.8, min_pts, mode)
    assert [rows[i].cluster_id for i in range(len(bags))] == label and [rows[i].is_core for i in range(len(bags))] == core
    assert sizes[0] < 0.6 * len(bags)
    s = model.statistics().first()
    assert (s.total, s.cores, s.noise) == (len(bags), sum(core), label.count(-1))
    assert {r.cluster_id: r.n for r in model.sizes().collect()} == {c: label.count(c) for c in set(label)}
    if mode == "strict":
        other = copied(8, 22) + random_bags(4, 23)
        nearest = lambda b: min(((brute(b, x), label[j]) for j, x in enumerate(bags) if core[j] and brute(b, x) <= 0.8), default=(0, -1))[1]
        assert {r.pos: r.cluster_id for r in model.predict(bags_of(spark, other)).collect()} == {i: nearest(b) for i, b in enumerate(other)}


def test_components_are_scanned_from_a_stream():
    """Components across batches, and many in one, give what each gives by itself; no group of a component is made."""
    links = [(c * 100 + i, c * 100 + j) for c, n in enumerate((2, 5, 3, 40, 2)) for i in range(n) for j in range(n) if abs(i - j) == 1]
    rows = pa.table({"component": [a // 100 * 100 for a, _ in links], "pos": [a for a, _ in links], "other": [b for _, b in links], "is_core": [a % 3 == 1 for a, _ in links]})
    alone = {}
    for c in range(5):
        found = cluster._scan(rows.filter(pa.compute.equal(rows.column("component"), c * 100)))
        alone |= dict(zip(*(found.column(k).to_pylist() for k in (0, 1)), strict=True))
    for size in (1, 3, 7, 1000):
        streamed = list(cluster._scanned(iter([*rows.to_batches(max_chunksize=size), rows.to_batches()[0].slice(0, 0)])))
        pairs = [p for b in streamed for p in zip(*(b.column(k).to_pylist() for k in (0, 1)), strict=True)]
        assert len(pairs) == len(alone) and dict(pairs) == alone


def test_hash_split_keeps_all_columns(spark):
    bags = bags_of(spark, copied(6, 24))
    train, test = sampling.hash_split(bags, 70, 42)
    assert train.columns == test.columns == bags.columns
    assert sorted(map(str, train.union(test).collect())) == sorted(map(str, bags.collect()))
