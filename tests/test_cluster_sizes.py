"""Cluster sizes come from classes of rows: no bags are built for them, and small graphs and few boxes take one task."""

import random

import pytest

from bagloom.operators import components, copies, epsjoin
from bagloom.plans import queries
from test_bags import bags_of
from test_copies import copied


def rows_of(spark, bags):
    rows = [(i, *p) for i, b in enumerate(bags) for p in b]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "pos long, v0 double, v1 double")


def test_classes_of_rows_are_those_of_bags(spark):
    """Also with values that are null or no numbers, bags that no label names, labels without a bag, and labels that come twice."""
    bags = [b for b in copied(25, 31) if b] + [[[1.0, 2.0], [1.0, 2.0]], [[1.0, 2.0]], [[2.0, 1.0]], [[1.0, 2.0], [1.0, 2.0]], [[None, 2.0]], [[None, 2.0]], [[2.0, None]], [[float("-inf"), 0.0]]]
    known = [(i, str(i % 2)) for i in range(len(bags)) if i % 5] + [(1, "1"), (len(bags) + 7, "1"), (None, "0")]
    of = copies.classes_of_rows(rows_of(spark, bags).union(spark.createDataFrame([(None, 1.0, 1.0)], "pos long, v0 double, v1 double")), spark.createDataFrame(known, "pos long, label string"))
    plain = copies.classes(bags_of(spark, bags).where("pos % 5 <> 0"))
    want = {r.pos: (r.bag_id, r.rep, r.n) for r in plain.members.collect()}
    got = of.members.collect()
    assert len(got) == len(want) and {r.pos: (str(r.pos), r.rep, r.n) for r in got} == {pos: (str(pos), *v[1:]) for pos, v in want.items()}
    assert all(r.bag_id == str(r.pos) and r.label == str(r.pos % 2) for r in got)
    held = lambda c: {r.pos: (r.n, str(sorted(r.instances, key=str))) for r in c.reps.collect()}
    assert held(of) == held(plain)


def test_cluster_sizes_build_no_bags(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, 10.0 * (k % 3), 0.0, 0.0) for k in range(7)] + [(8, 50.0, 0.1, 0.0)], "l_orderkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "F") for k in (0, 1, 2, 3, 4, 6, 8, 9)], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(queries, "kept_orders", lambda *a: pytest.fail("bags were built"))
    made = copies.keep
    monkeypatch.setattr(copies, "keep", lambda df, name: made(df, name) if name in ("classes", "reps") else pytest.fail(f"{name} were written"))
    assert sorted(tuple(r) for r in queries.cluster_sizes(spark, str(tmp_path)).select("cluster_id", "n").collect()) == [(-1, 4), (0, 3)]


def test_small_graphs_have_the_components_of_all(spark):
    r = random.Random(33)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + (i * 37) % 101, 1000 + ((i + 1) * 37) % 101) for i in range(100)] + [(5, 5), (7, 8), (8, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    want = sorted(map(tuple, components.components(df).collect()))
    assert sorted(map(tuple, components.components(df, 10_000).collect())) == want and want
    assert components.components(df.where("a = -1"), 10_000).collect() == []


@pytest.mark.parametrize("busy", [0, 2, 500])
def test_few_boxes_are_cut_like_many(spark, monkeypatch, busy):
    monkeypatch.setattr(epsjoin, "BUSY", busy)
    r = random.Random(34)
    bags = [[[r.gauss(0, 1) * (k + 1) for k in range(3)] for _ in range(r.randint(1, 4))] for _ in range(200)]
    boxes = epsjoin._boxed(bags_of(spark, bags), 3, 0.2)
    assert epsjoin._cut_few(boxes, 0.2) == epsjoin._cut(boxes, 0.2)
    line = epsjoin._boxed(bags_of(spark, [[[float(v)]] for v in range(9)]), 1, 0.2)
    assert epsjoin._cut_few(line, 0.2) == epsjoin._cut(line, 0.2)
