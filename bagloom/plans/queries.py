"""Named queries: every operator over whole tables turned into bags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import accessors, cluster, copies, epsjoin, evaluate, largebags, projection, sampling, scaling
from ..sources import adapters, arff, synthetic
from ..storage import keep, shared_dir, table

EPS, MIN_PTS, DIMS, SEED, PERCENT = 0.11, 3, 3, 42, 70


def rounded(c: str, places: int = 6):
    return F.round(F.col(c), places).alias(c)


def orders(spark, d: str) -> DataFrame:
    return adapters.order_bags(spark, d)


#: Tables that several queries of one session need: bags, their links, models. Each is written once.
_made: dict[tuple, object] = {}


def _once(spark, d: str, name: str, make):
    key = spark.sparkContext.applicationId, d, name
    if key not in _made:
        _made[key] = make()
    return _made[key]


def kept_orders(spark, d: str) -> DataFrame:
    return _once(spark, d, "bags", lambda: keep(orders(spark, d), "bags"))


def kept_classes(spark, d: str) -> copies.Classes:
    """Orders with equal line items as one."""
    return _once(spark, d, "classes", lambda: copies.classes_of_rows(*adapters.order_rows(spark, d)))


def kept_links(spark, d: str) -> DataFrame:
    """Links of classes."""
    return _once(spark, d, "links", lambda: keep(epsjoin.links(kept_classes(spark, d).reps, EPS, DIMS), "links"))


def by_dimension(bags: DataFrame) -> DataFrame:
    """pos, inst_idx, dim, v of all values, rounded."""
    return accessors.unnested(bags).select("pos", "inst_idx", F.posexplode("features").alias("dim", "v")).select("pos", "inst_idx", "dim", rounded("v"))


def bag_build(spark, d):
    return orders(spark, d).select("pos", "bag_id", "label", F.size("instances").cast("long").alias("n"), F.round(F.aggregate("instances", F.lit(0.0), lambda s, p: s + p[0] + p[1] + p[2]), 6).alias("total"))


def bag_size(spark, d):
    return orders(spark, d).select("pos", F.size("instances").cast("long").alias("n"))


def bag_unnest(spark, d):
    return accessors.unnested(orders(spark, d)).select("pos", "inst_idx", *[F.round(F.get("features", k), 6).alias(f"v{k}") for k in range(DIMS)])


def bag_at(spark, d):
    """The bag in one place."""
    return accessors.bag_at(orders(spark, d), 5).select("pos", "bag_id", "label", F.size("instances").cast("long").alias("n"))


def bag_first_instance(spark, d):
    first = accessors.instance_at(F.col("instances"), 0)
    return orders(spark, d).select("pos", *[F.round(F.get(first, k), 6).alias(f"v{k}") for k in range(DIMS)])


def bag_append(spark, d):
    """Each bag with one more instance, its own mean."""
    more = accessors.appended(F.col("instances"), V.centroid(F.col("instances"), DIMS))
    return orders(spark, d).select("pos", F.size(more).cast("long").alias("n"), F.round(F.get(F.element_at(more, -1), 0), 6).alias("last"))


def bag_contains(spark, d):
    """Which bags hold the instance (0.5, 0, 0.5)."""
    return orders(spark, d).select("pos", accessors.contains(F.col("instances"), F.array(F.lit(0.5), F.lit(0.0), F.lit(0.5))).alias("holds"))


def bag_matrix(spark, d):
    """Rows and columns of each bag's matrix."""
    return orders(spark, d).select("pos", F.size("instances").cast("long").alias("instances"), F.size(F.get("instances", 0)).cast("long").alias("attributes"))


def bag_relabel(spark, d):
    return accessors.relabelled(orders(spark, d), F.when(F.col("label") == "1", "neg").otherwise("pos")).select("pos", "bag_id", "label")


def instance_weight(spark, d):
    """Instances weigh one, those of positive bags two; the weight of each bag."""
    weighted = accessors.with_weight(accessors.unnested(orders(spark, d)), F.when(F.col("label") == "1", 2.0).otherwise(1.0))
    return weighted.groupBy("pos").agg(F.sum("weight").alias("weight"))


def bag_renumber(spark, d):
    """Places in the order of a hash of the id."""
    return sampling.hash_ranked(orders(spark, d), SEED).select("pos", "place")


def dataset_contains(spark, d):
    """Whether a dataset holds bags of given ids."""
    data = arff.Dataset("orders", kept_orders(spark, d), [])
    return spark.createDataFrame([(i, i in data) for i in ("1", "5", "-3", "x")], "bag_id string, holds boolean")


def feature_get(spark, d):
    return accessors.unnested(orders(spark, d)).select("pos", "inst_idx", F.round(accessors.value_at(F.col("features"), -1), 6).alias("value"))


def feature_set(spark, d):
    changed = accessors.unnested(orders(spark, d)).withColumn("features", V.put(F.col("features"), 1, F.lit(0.5)))
    return changed.select("pos", "inst_idx", *[F.round(F.get("features", k), 6).alias(f"v{k}") for k in range(DIMS)])


def label_list(spark, d):
    return orders(spark, d).select("pos", "label")


def label_cast(spark, d):
    return table(spark, d, "orders").select("o_orderkey", evaluate.as_class((F.col("o_totalprice") / 100000).cast("string")).alias("class_id"))


def positive_bags(spark, d):
    return accessors.positive(orders(spark, d)).select("pos")


def negative_bags(spark, d):
    return accessors.negative(orders(spark, d)).select("pos")


def class_balance(spark, d):
    return accessors.totals(orders(spark, d))


def type_check(spark, d):
    """Texts of several kinds against types."""
    value = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 4 == 1, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).when(F.col("o_orderkey") % 4 == 2, F.col("o_orderstatus")).otherwise(F.concat(F.lit("-"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", accessors.fits_type(value, "integer").alias("is_integer"), accessors.fits_type(value, "real").alias("is_real"), accessors.fits_type(value, "nominal", ["F", "O"]).alias("in_domain"))


def numeric_attrs(spark, d):
    """The columns of a table as attributes."""
    rows = [(i, a.name, a.attr_type, a.is_numeric) for i, a in enumerate(arff.attributes_of(table(spark, d, "orders")))]
    return spark.createDataFrame(rows, "idx int, name string, attr_type string, is_numeric boolean")


def nominal_attribute(spark, d):
    """Order statuses as a nominal attribute, coded by their place in the domain, decoded again, and left alone by a scaler."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.array(F.array(F.col("o_totalprice").cast("string"), "o_orderstatus")).alias("texts"))
    kinds = [arff.Attribute("price", "real"), arff.Attribute("status", "nominal", ("F", "O", "P"))]
    data = arff.Dataset("statuses", rows.select("pos", "texts", arff.instances_of(F.col("texts"), kinds).alias("instances")), kinds)
    scaled = scaling.MinMax().fit_transform(data).bags
    code = F.get(F.get("instances", 0), 1)
    return scaled.select("pos", F.round(F.get(F.get("instances", 0), 0), 6).alias("price"), code.alias("code"), F.element_at(F.array(*[F.lit(v) for v in kinds[1].values]), (code + 1).cast("int")).alias("status"))


def minmax_stats(spark, d):
    return scaling.dimension_stats(orders(spark, d)).select("dim", rounded("low"), rounded("high"), rounded("range"))


def zscore_stats(spark, d):
    return scaling.dimension_stats(orders(spark, d)).select("dim", rounded("mean"), rounded("std"))


def minmax_scale(spark, d):
    bags = kept_orders(spark, d)
    return by_dimension(scaling.MinMax(low=0.0, high=10.0).fit_transform(bags))


def minmax_inverse(spark, d):
    bags = kept_orders(spark, d)
    scaler = scaling.MinMax(low=0.0, high=10.0).fit(bags)
    return by_dimension(scaler.inverse(scaler.transform(bags)))


def zscore_scale(spark, d):
    return by_dimension(scaling.ZScore().fit_transform(kept_orders(spark, d)))


def zscore_inverse(spark, d):
    bags = kept_orders(spark, d)
    scaler = scaling.ZScore().fit(bags)
    return by_dimension(scaler.inverse(scaler.transform(bags)))


def hash_split(spark, d):
    train, test = sampling.hash_split(kept_orders(spark, d), PERCENT, SEED)
    return train.select("pos", F.lit("train").alias("part")).union(test.select("pos", F.lit("test")))


def exact_split(spark, d):
    nations = adapters.nation_bags(spark, d)
    train, test = sampling.exact_split(nations, PERCENT, SEED)
    return train.select("bag_id", "pos", F.lit("train").alias("part")).union(test.select("bag_id", "pos", F.lit("test")))


def instance_distance(spark, d):
    found = largebags.extremes(adapters.embedding_rows(spark, d), 64)
    return found.select("a", "b", rounded("least"), rounded("most"))


def directed_hausdorff(spark, d):
    return largebags.directed(adapters.nation_rows(spark, d), 1).select("a", "b", rounded("dist"))


def hausdorff_pairs(spark, d):
    return largebags.hausdorff(adapters.embedding_rows(spark, d), 64).select("a", "b", rounded("dist"))


def hausdorff_matrix(spark, d):
    """All pairs of bags that fit a row each, and the same by columns."""
    bags = adapters.nation_bags(spark, d)
    found = epsjoin.all_pairs(bags, 1).select("a", "b", rounded("dist"))
    x, y = (bags.select(F.col("pos").alias(n), F.col("instances").alias(f"{n}_bag")) for n in "ab")
    return found.join(x, "a").join(y, "b").select("a", "b", "dist", F.round(V.hausdorff(F.col("a_bag"), F.col("b_bag"), 1), 6).alias("by_columns"))


def customer_eps_neighbours(spark, d):
    """Similar purchase histories: customers as one-dimensional bags."""
    return epsjoin.links(adapters.customer_bags(spark, d), 0.2003, 1).select("a", "b", rounded("dist", 8))


def order_eps_neighbours(spark, d):
    return copies.expanded(kept_links(spark, d).select("a", "b", rounded("dist")), kept_classes(spark, d))


def neighbour_count(spark, d):
    classes = kept_classes(spark, d)
    found = cluster.neighbour_counts(classes.reps, kept_links(spark, d)).withColumnRenamed("pos", "rep")
    return classes.members.select("pos", "rep").join(found, "rep").select("pos", "neighbours")


def core_bags(spark, d):
    return neighbour_count(spark, d).where(F.col("neighbours") >= MIN_PTS).select("pos")


def _groups(spark, d, mode: str = "strict", min_pts: int = MIN_PTS) -> tuple[DataFrame, int]:
    """Clusters of classes; no bags are made for them."""
    return _once(spark, d, f"groups {mode} {min_pts}", lambda: cluster.grouped(kept_classes(spark, d).reps, kept_links(spark, d), EPS, min_pts, mode))


def _model(spark, d, mode: str = "strict", min_pts: int = MIN_PTS) -> cluster.Model:
    return _once(spark, d, f"model {mode} {min_pts}", lambda: cluster.fit(kept_classes(spark, d).bags(), EPS, min_pts, mode, dims=DIMS, links=kept_links(spark, d), classes=kept_classes(spark, d), groups=_groups(spark, d, mode, min_pts)))


def fit_strict(spark, d):
    return _model(spark, d).assignments.select("pos", "cluster_id", "is_core")


def fit_compat(spark, d):
    return _model(spark, d, "compat", 2).assignments.select("pos", "cluster_id", "is_core")


def fit_compat_ordered(spark, d):
    """compat with min_pts 3 depends on the order of bags; SQL does not express its scan."""
    return _model(spark, d, "compat").assignments.select("pos", "cluster_id", "is_core")


def cluster_sizes(spark, d):
    return cluster.sizes(_groups(spark, d)[0])


def noise_bags(spark, d):
    return _model(spark, d).noise().select("pos")


def cluster_members(spark, d):
    return _model(spark, d).members(0).select("pos")


def distinct_clusters(spark, d):
    return _model(spark, d).groups.select("cluster_id").distinct()


def model_stats(spark, d):
    return _model(spark, d).statistics().select("eps", "min_pts", "total", "clusters", "cores", "noise", rounded("noise_pct", 4))


def _split_model(spark, d):
    """A model of the training part, the classes of the test part and their distances to cores."""

    def made():
        whole = kept_classes(spark, d)
        train, test = (copies.restricted(whole, part) for part in sampling.hash_split(whole.members, PERCENT, SEED))
        model = cluster.fit(whole.bags(), EPS, MIN_PTS, "strict", dims=DIMS, classes=train)
        return model, test, keep(model.near(test), "near")

    return _once(spark, d, "split", made)


def predict(spark, d):
    model, test, near = _split_model(spark, d)
    return cluster.nearest(test.members, near, model.core_groups, "rep").select("pos", "cluster_id")


def nearest_core(spark, d):
    _, test, near = _split_model(spark, d)
    least = near.groupBy(F.col("pos_a").alias("rep")).agg(F.round(F.min("dist"), 6).alias("dist"))
    return test.members.select("pos", "rep").join(least, "rep").select("pos", "dist")


def fit_predict(spark, d):
    return _model(spark, d).predict_fitted(kept_classes(spark, d).members, kept_links(spark, d), kept_classes(spark, d)).select("pos", "cluster_id")


def predict_noise_rate(spark, d):
    found = predict(spark, d)
    return found.agg(F.count("*").alias("total"), F.count_if(F.col("cluster_id") == -1).alias("noise"), F.round(F.avg(F.when(F.col("cluster_id") == -1, 100.0).otherwise(0.0)), 4).alias("noise_pct"))


def _labelled(spark, d) -> DataFrame:
    groups = _model(spark, d).groups.select(F.col("pos").alias("rep"), "cluster_id")
    assigned = kept_classes(spark, d).members.join(groups, "rep")
    return assigned.select("pos", "cluster_id", evaluate.as_class(F.col("label")).alias("truth")).where("truth is not null")


def cluster_class_map(spark, d):
    return evaluate.class_map(_labelled(spark, d))


def confusion(spark, d):
    return evaluate.confusion(_labelled(spark, d))


def metrics(spark, d):
    return evaluate.metrics(_labelled(spark, d)).select(*[rounded(c) for c in ("precision", "recall", "f1", "specificity")])


def interpretation(spark, d):
    """What numbers of clusters and F1 values say; customers and prices stand for both."""
    clusters, f1 = F.col("o_custkey") % 4, F.least(F.lit(1.0), F.col("o_totalprice") / 400000)
    return table(spark, d, "orders").select("o_orderkey", evaluate.interpretation(clusters, f1).alias("says"))


def param_grid(spark, d):
    """Clusters and noise for each eps and min_pts; links are computed once."""
    links, classes = kept_links(spark, d), kept_classes(spark, d)
    bags = classes.bags()
    rows = []
    for eps in (0.07, EPS):
        for min_pts in (2, 3):
            s = cluster.fit(bags, eps, min_pts, "strict", dims=DIMS, links=links, classes=classes).statistics().first()
            rows.append((eps, min_pts, s.clusters, s.cores, s.noise))
    return spark.createDataFrame(rows, "eps double, min_pts int, clusters long, cores long, noise long")


def bag_centroid(spark, d):
    return projection.centroids(orders(spark, d), DIMS).select("pos", *[F.round(F.get("centroid", k), 6).alias(f"v{k}") for k in range(DIMS)])


def pca_coords(spark, d):
    return projection.pca(kept_orders(spark, d), DIMS).select("pos", rounded("x"), rounded("y"))


def arff_roundtrip(spark, d):
    """Bags of nations written as ARFF and read back."""
    import uuid

    bags = adapters.nation_bags(spark, d)
    path = f"{shared_dir(spark)}/bagloom/arff-{uuid.uuid4().hex}"
    arff.write_arff(arff.Dataset("nations", bags, [arff.Attribute("balance", "real")]), path)
    back = arff.read_arff(spark, path)
    return back.bags.select("bag_id", "label", F.size("instances").cast("long").alias("n"), F.round(F.aggregate("instances", F.lit(0.0), lambda s, p: s + p[0]), 6).alias("total"))


def synthetic_bags(spark, d):
    bags = synthetic.two_clouds(spark).bags
    total = lambda k: F.round(F.aggregate("instances", F.lit(0.0), lambda s, p: s + p[k]), 2)
    return bags.select("pos", "bag_id", "label", F.size("instances").cast("long").alias("n"), total(0).alias("x"), total(1).alias("y"))


ALL = [
    bag_build, bag_size, bag_unnest, bag_at, bag_first_instance, bag_append, bag_contains, bag_matrix, bag_relabel, instance_weight, bag_renumber, dataset_contains, feature_get, feature_set, label_list, label_cast, positive_bags, negative_bags, class_balance,
    type_check, numeric_attrs, nominal_attribute, minmax_stats, zscore_stats, minmax_scale, minmax_inverse, zscore_scale, zscore_inverse, hash_split, exact_split,
    instance_distance, directed_hausdorff, hausdorff_pairs, hausdorff_matrix, customer_eps_neighbours, order_eps_neighbours, neighbour_count, core_bags,
    fit_strict, fit_compat, fit_compat_ordered, cluster_sizes, noise_bags, cluster_members, distinct_clusters, model_stats, predict, nearest_core,
    fit_predict, predict_noise_rate, cluster_class_map, confusion, metrics, interpretation, param_grid, bag_centroid, pca_coords, arff_roundtrip, synthetic_bags,
]
