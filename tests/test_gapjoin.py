"""Bags whose values leave gaps are joined by the regions that they occupy, and give the pairs that all comparisons give."""

import random

import pytest

from bagloom.operators import cluster, components, copies, epsjoin, gapjoin
from bagloom.plans import queries
from test_bags import bags_of, brute, scan

EPS = 0.11


def rated(n, seed):
    """Bags like those of line items: quantities and discounts without gaps wider than eps, taxes with."""
    r = random.Random(seed)
    return [[[r.randint(1, 8) / 50, r.randint(0, 3) / 100 * 10, r.randint(0, 2) / 100 * 12.5] for _ in range(r.choice((1, 1, 2, 2, 3, 4)))] for _ in range(n)]


@pytest.mark.parametrize(("leaf", "crowded"), [(1, 100_000), (60, 5), (1 << 14, 20)])
def test_links_by_regions(spark, monkeypatch, leaf, crowded):
    monkeypatch.setattr(gapjoin, "LEAF", leaf)
    monkeypatch.setattr(gapjoin, "CROWDED", crowded)
    monkeypatch.setattr(gapjoin, "PARTS", 1000)
    monkeypatch.setattr(epsjoin, "candidates", lambda *a: pytest.fail("no regions were used"))
    bags = [*rated(160, 41), [], [[float("nan"), 0.0, 0.0]]]
    df = bags_of(spark, bags).repartition(3)
    want = {(i, j): brute(bags[i], bags[j]) for i in range(160) for j in range(i + 1, 160) if brute(bags[i], bags[j]) <= EPS}
    got = [(x.a, x.b, x.dist) for x in epsjoin.links(df, EPS, 3).collect()]
    assert len(got) == len(want) and {x[:2] for x in got} == set(want) and all(d == pytest.approx(want[a, b]) for a, b, d in got)
    assert any(len(bags[a]) > 1 for a, _ in want)
    near = sorted((x.pos_a, x.pos_b) for x in epsjoin.near(df.where("pos % 3 = 0"), df.where("pos % 3 <> 0"), EPS, 3).collect())
    assert near == sorted((i, j) if i % 3 == 0 else (j, i) for i, j in want if (i % 3 == 0) != (j % 3 == 0))


def test_groups_too_large_for_parts_and_no_gaps(spark, monkeypatch):
    bags = rated(60, 42)
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if brute(bags[i], bags[j]) <= EPS)
    monkeypatch.setattr(gapjoin, "CROWDED", 1)
    monkeypatch.setattr(gapjoin, "PARTS", 1)
    assert sorted((x.a, x.b) for x in epsjoin.links(bags_of(spark, bags), EPS, 3).collect()) == want
    assert gapjoin.gaps(bags_of(spark, [[[v / 10, 0.0]] for v in range(9)]), 2, EPS) is None


@pytest.mark.parametrize(("mode", "min_pts"), [("strict", 3), ("strict", 6), ("compat", 2), ("compat", 4)])
def test_clusters_by_regions(spark, mode, min_pts):
    bags = rated(90, 43)
    model = cluster.fit(bags_of(spark, bags), EPS, min_pts, mode, dims=3)
    label, core = scan(bags, EPS, min_pts, mode)
    assert [(r.cluster_id, r.is_core) for r in sorted(model.assignments.collect())] == list(zip(label, core, strict=True))


def test_tasks_contract_links(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(components, "HELD", 40)
    r = random.Random(44)
    links = [(r.randrange(90), r.randrange(90)) for _ in range(400)] + [(100 + i, 101 + i) for i in range(30)]
    batches = pa.table({"a": [a for a, _ in links], "b": [b for _, b in links]}).to_batches(max_chunksize=7)
    left = [p for b in components._contracted(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    whole = lambda rows: next(components._joined(iter([pa.record_batch({"a": [a for a, _ in rows], "b": [b for _, b in rows]})]))).to_pydict()
    assert whole(left) == whole(links) and len(left) < len(links)


def test_classes_hold_all_bags(spark):
    """Bags of many rows lie across batches; labels, copies and instances are all there."""
    bags = rated(70, 45) + [[[i % 7 / 50, 0.1, 0.125] for i in range(3000)]] * 2
    rows = [(i, *p) for i, b in enumerate(bags) for p in b]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        of = copies.classes_of_rows(spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "pos long, v0 double, v1 double, v2 double"), spark.createDataFrame([(i, "x" if i % 2 else None) for i in range(len(bags))], "pos long, label string"))
        found = {r.pos: r for r in of.bags().collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(found[i].instances == sorted(b) and found[i].label == ("x" if i % 2 else None) for i, b in enumerate(bags)) and len(found) == len(bags)
    assert sum(r.n for r in of.reps.collect()) == len(bags) and {r.rep for r in of.members.where("n > 1 and pos >= 70").collect()} == {70}


def test_queries_build_bags_once(spark, monkeypatch):
    monkeypatch.setattr(queries, "kept_orders", lambda *a: pytest.fail("bags were built a second time"))
    monkeypatch.setattr(queries, "_made", {})
    for name in ("cluster_members", "noise_bags", "fit_predict", "predict", "param_grid"):
        assert getattr(queries, name)(spark, "/root/testdata/sf0.001").count() > 0
