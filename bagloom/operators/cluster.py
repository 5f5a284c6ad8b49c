"""Density clustering of bags, and prediction by the nearest core bag.

Two bags are neighbours within eps (inclusive); a bag counts itself. It is core with at least min_pts neighbours.

- strict: cores that are neighbours share a cluster; a bag that is not core takes the least cluster id among its
  core neighbours, and is noise (-1) without one. Clusters are numbered from 0 by their least core position.
- compat: every unvisited bag in order of position seeds a cluster, core or not, and takes all unvisited bags that
  it reaches through cores; so training labels hold no noise and lone bags are clusters of their own.

All pairs are of classes of copies (`copies`), weighted by their sizes. strict, and compat up to min_pts 2 (where it is the connected components), run as joins. compat from 3 depends on the
order of bags, but never crosses a component: each component is scanned by one task (the quirk cannot be split
further, so a component must fit a task; strict has no such bound)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import keep
from . import copies, epsjoin
from .components import components
from .copies import Classes
from .ranking import with_rank

NOISE = -1
MODES = ("compat", "strict")
#: Links whose components one task finds.
ALONE = 8_000_000


@dataclass
class Model:
    """What a fit gives: `assignments` (pos, bag_id, cluster_id, is_core), `cores` (pos, bag_id, cluster_id, instances), and
    the same by classes of copies: `groups` (pos, n, cluster_id, is_core) and `core_groups` (pos, cluster_id, instances)."""

    eps: float
    min_pts: int
    dims: int
    metric: str
    mode: str
    cluster_count: int
    assignments: DataFrame
    cores: DataFrame
    groups: DataFrame
    core_groups: DataFrame
    noise_label: int = NOISE
    is_fitted: bool = True

    @property
    def labels(self) -> DataFrame:
        return self.assignments.select("bag_id", "cluster_id")

    def sizes(self) -> DataFrame:
        return sizes(self.groups)

    def noise(self) -> DataFrame:
        return self.members(NOISE)

    def members(self, cluster_id: int) -> DataFrame:
        return self.assignments.where(F.col("cluster_id") == cluster_id).select("pos", "bag_id")

    def statistics(self) -> DataFrame:
        count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
        total, noise = F.coalesce(F.sum("n"), F.lit(0)), count(F.col("cluster_id") == NOISE)
        return self.groups.agg(F.lit(self.eps).alias("eps"), F.lit(self.min_pts).alias("min_pts"), total.alias("total"), F.lit(self.cluster_count).cast("long").alias("clusters"), count(F.col("is_core")).alias("cores"), noise.alias("noise"), F.coalesce(F.try_divide(noise * 100.0, total), F.lit(0.0)).alias("noise_pct"))

    def predict(self, bags: DataFrame, classes: Classes | None = None) -> DataFrame:
        """(pos, bag_id, cluster_id): that of the nearest core within eps, the lesser id at equal distance, else -1. classes: those of the bags, if at hand."""
        if bags.isEmpty():
            raise ValueError("no bags to predict")
        if self.metric != "hausdorff" or not self.dims:
            return predict(bags, self.cores, self.eps, self.dims, self.metric)
        classes = classes or copies.classes(bags)
        return nearest(classes.members, self.near(classes), self.core_groups, "rep")

    def near(self, classes: Classes) -> DataFrame:
        """(pos_a, pos_b, dist) of classes of other bags and of cores within eps."""
        return epsjoin.near(classes.reps, self.core_groups, self.eps, self.dims)

    def predict_fitted(self, bags: DataFrame, links: DataFrame, classes: Classes | None = None) -> DataFrame:
        """As `predict`, of the bags that were fitted, by their links (a, b, dist), or those of their classes if given; a core bag's own distance is 0."""
        known = self.assignments.where("is_core") if classes is None else self.core_groups
        own = known.select(F.col("pos").alias("pos_a"), F.col("pos").alias("pos_b"), F.lit(0.0).alias("dist"))
        near = links.where(F.col("dist") <= self.eps)
        both = near.select("a", "b", "dist").union(near.select("b", "a", "dist")).toDF("pos_a", "pos_b", "dist").union(own)
        return nearest(bags, both, known) if classes is None else nearest(classes.members, both, known, "rep")

    def __repr__(self) -> str:
        return f"Model(eps={self.eps}, min_pts={self.min_pts}, mode={self.mode}, clusters={self.cluster_count})"


def sizes(groups: DataFrame) -> DataFrame:
    """(cluster_id, n) of what `grouped` gives: the bags of each cluster."""
    return groups.groupBy("cluster_id").agg(F.sum("n").alias("n"))


def predict(bags: DataFrame, cores: DataFrame, eps: float, dims: int, metric: str = "hausdorff") -> DataFrame:
    near = epsjoin.near(bags, cores, eps, dims, metric) if dims else bags.sparkSession.createDataFrame([], "pos_a long, pos_b long, dist double")
    return nearest(bags, near, cores)


def nearest(bags: DataFrame, near: DataFrame, cores: DataFrame, by: str = "pos") -> DataFrame:
    """(pos, bag_id, cluster_id) of bags, by the distances (pos_a, pos_b, dist) of what column `by` names to cores."""
    known = cores.select(F.col("pos").alias("pos_b"), "cluster_id")
    best = near.join(known, "pos_b").groupBy("pos_a").agg(F.min(F.struct("dist", "cluster_id")).alias("best"))
    found = best.select(F.col("pos_a").alias("_by"), F.col("best.cluster_id").alias("cluster_id"))
    return bags.select("pos", "bag_id", F.col(by).alias("_by")).join(found, "_by", "left").select("pos", "bag_id", F.coalesce("cluster_id", F.lit(NOISE)).cast("int").alias("cluster_id"))


def neighbour_counts(bags: DataFrame, links: DataFrame) -> DataFrame:
    """(pos, neighbours), each counting itself; rows of classes count `n`, if there is such a column; links may hold it as n_a, n_b."""
    size = F.col("n") if "n" in bags.columns else F.lit(1)
    sized = bags.select("pos", size.cast("long").alias("n"))
    if "n" in bags.columns and {"n_a", "n_b"} <= set(links.columns):
        ends = links.select(F.col("a").alias("pos"), F.col("n_b").alias("others")).union(links.select("b", "n_a"))
    else:
        ends = links.select(F.col("a").alias("pos"), F.col("b").alias("other")).union(links.select("b", "a"))
        ends = ends.join(sized.withColumnsRenamed({"pos": "other", "n": "others"}), "other")
    others = ends.groupBy("pos").agg(F.sum("others").alias("others"))
    return sized.join(others, "pos", "left").select("pos", (F.coalesce("others", F.lit(0)) + F.col("n")).alias("neighbours"))


def _numbered(seeded: DataFrame) -> tuple[DataFrame, int]:
    """Rows (pos, seed, ...) with cluster_id by ascending seed; null seeds are noise."""
    seeds = with_rank(seeded.where("seed is not null").select("seed").distinct(), "seed", "cluster_id")
    seeds = keep(seeds.select("seed", F.col("cluster_id").cast("int").alias("cluster_id")), "seeds")
    return seeded.join(seeds, "seed", "left").drop("seed").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(NOISE))), seeds.count()


def _scan(rows: pa.Table) -> pa.RecordBatch:
    """The order-dependent scan of whole components: their classes with their neighbours among each other. A class is reached
    as a whole, since what reaches one member is a neighbour of all, and a seed takes its own copies first."""
    pos, other = (rows.column(c).to_pylist() for c in ("pos", "other"))
    near: dict[int, list[int]] = {}
    for a, b in zip(pos, other, strict=True):
        near.setdefault(a, []).append(b)
    core = set(rows.filter(rows.column("is_core")).column("pos").to_pylist())
    seed_of: dict[int, int] = {}
    for seed in sorted(near):
        if seed in seed_of:
            continue
        seed_of[seed] = seed
        reached = [seed]
        for at in reached:
            if at == seed or at in core:
                new = [b for b in near[at] if b not in seed_of]
                seed_of.update(dict.fromkeys(new, seed))
                reached += new
    return pa.RecordBatch.from_arrays([pa.array(list(seed_of), pa.int64()), pa.array(list(seed_of.values()), pa.int64())], names=["pos", "comp"])


def _scanned(batches):
    """Rows (component, pos, other, is_core) sorted by component: the last one may go on, all before it are scanned together."""
    waiting, open_one = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        component = batch.column(0).to_numpy()
        begins = int(np.searchsorted(component, component[-1]))
        if waiting and (begins or component[0] != open_one):
            yield _scan(pa.Table.from_batches([*waiting, batch.slice(0, begins)]))
            waiting = []
        elif begins:
            yield _scan(pa.Table.from_batches([batch.slice(0, begins)]))
        waiting.append(batch.slice(begins))
        open_one = component[-1]
    if waiting:
        yield _scan(pa.Table.from_batches(waiting))


def grouped(nodes: DataFrame, links: DataFrame, eps: float, min_pts: int, mode: str = "strict") -> tuple[DataFrame, int]:
    """(pos, n, cluster_id, is_core) of bags or classes of copies (pos, n, ...) by their written links (a, b, dist) at eps or a larger one, and the number of clusters."""
    edges = links.where(F.col("dist") <= eps)
    counted = neighbour_counts(nodes, edges).join(nodes.select("pos", "n"), "pos")
    counted = keep(counted.select("pos", "n", "neighbours", (F.col("neighbours") >= min_pts).alias("is_core")), "counted")
    core = counted.where("is_core").select("pos")
    if mode == "strict":
        ends = [core.select(F.col("pos").alias(side), F.lit(True).alias(f"core_{side}")) for side in "ab"]
        marked = keep(edges.drop("dist", "n_a", "n_b").join(ends[0], "a", "left").join(ends[1], "b", "left").where("core_a or core_b"), "marked")
        joined = components(marked.where("core_a and core_b"), ALONE).select(F.col("node").alias("pos"), "comp")
        seeds = keep(core.join(joined, "pos", "left").select("pos", F.coalesce("comp", "pos").alias("seed")), "core-seeds")
        lone = marked.where("core_a is null or core_b is null").select(F.when(F.col("core_a").isNull(), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("core_a").isNull(), F.col("b")).otherwise(F.col("a")).alias("b"))
        border = lone.join(seeds.withColumnRenamed("pos", "b"), "b").groupBy("a").agg(F.min("seed").alias("near"))
        seeded = counted.join(seeds, "pos", "left").join(border.withColumnRenamed("a", "pos"), "pos", "left").withColumn("seed", F.coalesce("seed", "near")).drop("near")
    else:
        joined = components(edges, ALONE).select(F.col("node").alias("pos"), "comp")
        if min_pts >= 3:  # components are many and mostly small, so a task scans its own ones from a sorted stream
            both = edges.select(F.col("a").alias("pos"), F.col("b").alias("other")).union(edges.select("b", "a"))
            placed = joined.join(counted.select("pos", "is_core"), "pos").select(F.col("comp").alias("component"), "pos", "is_core")
            rows = both.join(placed, "pos").select("component", "pos", "other", "is_core")
            tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            joined = keep(rows.repartition(tasks, "component").sortWithinPartitions("component", "pos").mapInArrow(_scanned, "pos long, comp long"), "scanned")
        seeded = counted.join(joined, "pos", "left").withColumn("seed", F.coalesce("comp", "pos")).drop("comp")
    numbered, count = _numbered(seeded)
    return keep(numbered.select("pos", "n", "cluster_id", "is_core"), "groups"), count


def fit(bags: DataFrame, eps: float, min_pts: int, mode: str = "strict", metric: str = "hausdorff", dims: int | None = None, links: DataFrame | None = None, classes: Classes | None = None, groups: tuple[DataFrame, int] | None = None) -> Model:
    """Clusters bags (pos, bag_id, label, instances). classes: those of the bags, if at hand. links: pairs (a, b, dist) already at hand, at this eps or a larger one, of classes if these are given, else of bags. groups: what `grouped` gave for these."""
    if not eps > 0:
        raise ValueError("eps must be positive")
    if min_pts < 1:
        raise ValueError("min_pts must be at least 1")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    V.metric(metric)
    if bags.isEmpty():
        raise ValueError("no bags to fit")
    dims = dims or epsjoin.dimensions(bags)
    if links is None:
        if classes is None and metric.lower() == "hausdorff":
            classes = copies.classes(bags)
        links = keep(epsjoin.links(classes.reps if classes else bags, eps, dims, metric), "links")
    nodes = classes.reps if classes else bags.select("pos", F.lit(1).cast("long").alias("n"), "instances")
    groups, count = groups or grouped(nodes, links, eps, min_pts, mode)
    if classes:
        found = classes.members.select("pos", "bag_id", "rep").join(groups.select(F.col("pos").alias("rep"), "cluster_id", "is_core"), "rep")
    else:
        found = bags.select("pos", "bag_id").join(groups, "pos")
    assignments = found.select("pos", "bag_id", "cluster_id", "is_core")
    core_of = lambda df: df.where("is_core").select("pos", "cluster_id")
    cores = bags.select("pos", "bag_id", "instances").join(core_of(assignments), "pos")
    core_groups = nodes.select("pos", "instances").join(core_of(groups), "pos")
    return Model(eps, min_pts, dims, metric.lower(), mode, count, assignments, cores, groups, core_groups)


def fit_predict(train: DataFrame, test: DataFrame, eps: float, min_pts: int, mode: str = "strict", metric: str = "hausdorff") -> DataFrame:
    return fit(train, eps, min_pts, mode, metric).predict(test)
