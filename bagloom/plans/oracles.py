"""DuckDB SQL that must give the rows of the queries, over the same tables."""

from __future__ import annotations

EPS, MIN_PTS = 0.11, 3
_I = """i AS MATERIALIZED (SELECT l_orderkey AS pos, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity/50, l_discount*10, l_tax*12.5) - 1 AS INT) AS r,
 [l_quantity/50, l_discount*10, l_tax*12.5] AS x, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
bags AS MATERIALIZED (SELECT pos, CAST(pos AS VARCHAR) AS bag_id, max(label) AS label, count(*) AS n FROM i GROUP BY pos)"""
_BOX = "bx AS MATERIALIZED (SELECT pos, min(x[1]) a0, max(x[1]) a1, min(x[2]) b0, max(x[2]) b1, min(x[3]) c0, max(x[3]) c1 FROM i GROUP BY pos)"
_CLOSE = " AND ".join(f"abs(x.{c} - y.{c}) <= {EPS} + 1e-9" for c in ("a0", "a1", "b0", "b1", "c0", "c1"))


def _distances(left: str, right: str, on: str, tag: str = "") -> str:
    """Hausdorff distances of candidate pairs; on: what a pair of positions x, y must fulfil."""
    return f"""c{tag} AS MATERIALIZED (SELECT x.pos a, y.pos b FROM {left} x JOIN {right} y ON {on} AND {_CLOSE}),
p{tag} AS MATERIALIZED (SELECT c.a, c.b, i.r ar, j.r br, list_distance(i.x, j.x) d FROM c{tag} c JOIN i ON i.pos = c.a JOIN i j ON j.pos = c.b),
e{tag} AS MATERIALIZED (SELECT a, b, greatest(u.h, v.h) AS dist FROM (SELECT a, b, max(m) h FROM (SELECT a, b, ar, min(d) m FROM p{tag} GROUP BY ALL) GROUP BY a, b) u
 JOIN (SELECT a, b, max(m) h FROM (SELECT a, b, br, min(d) m FROM p{tag} GROUP BY ALL) GROUP BY a, b) v USING (a, b) WHERE greatest(u.h, v.h) <= {EPS})"""


_E = f"{_I}, {_BOX}, {_distances('bx', 'bx', 'x.pos < y.pos')}"


def _fitted(who: str = "bags", edges: str = "e", min_pts: int = MIN_PTS, eps: float = EPS, tag: str = "") -> str:
    """Strict clusters of the positions in a table, over links."""
    return f"""l{tag} AS MATERIALIZED (SELECT a, b FROM {edges} WHERE dist <= {eps} UNION ALL SELECT b, a FROM {edges} WHERE dist <= {eps}),
k{tag} AS MATERIALIZED (SELECT g.pos, 1 + count(l.b) AS neighbours FROM {who} g LEFT JOIN l{tag} l ON l.a = g.pos GROUP BY g.pos),
cc{tag} AS MATERIALIZED (SELECT l.a, l.b FROM l{tag} l JOIN k{tag} x ON x.pos = l.a AND x.neighbours >= {min_pts} JOIN k{tag} y ON y.pos = l.b AND y.neighbours >= {min_pts}),
r{tag} AS (SELECT pos AS node, pos AS root FROM k{tag} WHERE neighbours >= {min_pts} UNION SELECT cc.b, r.root FROM r{tag} r JOIN cc{tag} cc ON cc.a = r.node),
s{tag} AS MATERIALIZED (SELECT node AS pos, min(root) AS seed FROM r{tag} GROUP BY node),
w{tag} AS (SELECT k.pos, k.neighbours, coalesce(s.seed, (SELECT min(t.seed) FROM l{tag} l JOIN s{tag} t ON t.pos = l.b WHERE l.a = k.pos)) AS seed FROM k{tag} k LEFT JOIN s{tag} s USING (pos)),
f{tag} AS MATERIALIZED (SELECT pos, neighbours >= {min_pts} AS is_core, CAST(CASE WHEN seed IS NULL THEN -1 ELSE n.id END AS INT) AS cluster_id FROM w{tag}
 LEFT JOIN (SELECT seed, dense_rank() OVER (ORDER BY seed) - 1 AS id FROM (SELECT DISTINCT seed FROM s{tag})) n USING (seed))"""


_FIT = f"WITH RECURSIVE {_E}, {_fitted()}"
_SPLIT = "o AS MATERIALIZED (SELECT pos, row_number() OVER (ORDER BY md5(bag_id || ':42'), bag_id) - 1 AS place, floor((SELECT count(*) FROM bags) * (70 / 100.0::DOUBLE)) AS cut FROM bags), train AS MATERIALIZED (SELECT pos FROM o WHERE place < cut), test AS MATERIALIZED (SELECT pos FROM o WHERE place >= cut)"
_TRAINED = f"WITH RECURSIVE {_I}, {_BOX}, {_SPLIT}, bt AS (SELECT bx.* FROM bx JOIN train USING (pos)), {_distances('bt', 'bt', 'x.pos < y.pos')}, {_fitted('train')}"
_PREDICTED = _TRAINED + f", bq AS (SELECT bx.* FROM bx JOIN test USING (pos)), bc AS (SELECT bx.* FROM bx JOIN f USING (pos) WHERE is_core), {_distances('bq', 'bc', 'true', 'q')}, z AS MATERIALIZED (SELECT t.pos, coalesce(arg_min(f.cluster_id, (q.dist, f.cluster_id)), -1) AS cluster_id, min(q.dist) AS dist FROM test t LEFT JOIN eq q ON q.a = t.pos LEFT JOIN f ON f.pos = q.b GROUP BY t.pos)"
_SELF = _FIT + f", bc AS (SELECT bx.* FROM bx JOIN f USING (pos) WHERE is_core), {_distances('bx', 'bc', 'true', 'q')}, z AS MATERIALIZED (SELECT t.pos, coalesce(arg_min(f.cluster_id, (q.dist, f.cluster_id)), -1) AS cluster_id FROM bags t LEFT JOIN eq q ON q.a = t.pos LEFT JOIN f ON f.pos = q.b GROUP BY t.pos)"
_MAPPED = _FIT + ", m AS MATERIALIZED (SELECT cluster_id, class_id FROM (SELECT cluster_id, CAST(label AS INT) AS class_id, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, CAST(label AS INT)) AS o FROM f JOIN bags USING (pos) GROUP BY 1, 2) WHERE o = 1), q AS MATERIALIZED (SELECT count_if(label = '0' AND class_id = 0) AS tn, count_if(label = '0' AND class_id = 1) AS fp, count_if(label = '1' AND class_id = 0) AS fn, count_if(label = '1' AND class_id = 1) AS tp FROM f JOIN bags USING (pos) JOIN m USING (cluster_id))"
_VALUES = f"WITH {_I}, v AS MATERIALIZED (SELECT pos, r AS inst_idx, CAST(unnest([0, 1, 2]) AS INT) AS dim, unnest(x) AS v FROM i), t AS (SELECT dim, min(v) AS low, max(v) AS high, avg(v) AS mean, stddev_pop(v) AS std FROM v GROUP BY dim)"
_NATION = "n AS MATERIALIZED (SELECT CAST(s_nationkey AS BIGINT) AS pos, row_number() OVER () AS r, s_acctbal/1000 AS x FROM supplier JOIN nation ON n_nationkey = s_nationkey)"
_EMBEDDED = "g AS MATERIALIZED (SELECT CAST(label AS BIGINT) AS pos, vec_id AS r, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS MATERIALIZED (SELECT a.pos a, b.pos b, a.r ar, b.r br, list_distance(a.x, b.x) d FROM g a JOIN g b ON a.pos < b.pos)"
_GRID = " UNION ALL ".join(f"SELECT CAST({e} AS DOUBLE) AS eps, CAST({m} AS INT) AS min_pts, (SELECT count(DISTINCT cluster_id) FROM f{t} WHERE cluster_id >= 0) AS clusters, (SELECT count(*) FROM f{t} WHERE is_core) AS cores, (SELECT count(*) FROM f{t} WHERE cluster_id = -1) AS noise" for t, e, m in (("g1", 0.07, 2), ("g2", 0.07, 3), ("g3", 0.11, 2), ("g4", 0.11, 3)))
_RATIOS = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity"

ALL = {
    "bag_build": f"WITH {_I} SELECT bags.pos, bag_id, bags.label, n, t AS total FROM bags JOIN (SELECT pos, round(sum(x[1] + x[2] + x[3]), 6) AS t FROM i GROUP BY pos) USING (pos)",
    "bag_size": "SELECT l_orderkey AS pos, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "bag_unnest": f"WITH {_I} SELECT pos, r AS inst_idx, round(x[1], 6) AS v0, round(x[2], 6) AS v1, round(x[3], 6) AS v2 FROM i",
    "bag_at": f"WITH {_I} SELECT pos, bag_id, label, n FROM bags WHERE pos = 5",
    "bag_first_instance": f"WITH {_I} SELECT pos, round(x[1], 6) AS v0, round(x[2], 6) AS v1, round(x[3], 6) AS v2 FROM i WHERE r = 0",
    "bag_append": f"WITH {_I} SELECT pos, count(*) + 1 AS n, round(avg(x[1]), 6) AS last FROM i GROUP BY pos",
    "bag_contains": f"WITH {_I} SELECT pos, bool_or(x = [0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE]) AS holds FROM i GROUP BY pos",
    "bag_matrix": f"WITH {_I} SELECT pos, count(*) AS instances, CAST(max(len(x)) AS BIGINT) AS attributes FROM i GROUP BY pos",
    "bag_relabel": f"WITH {_I} SELECT pos, bag_id, CASE WHEN label = '1' THEN 'neg' ELSE 'pos' END AS label FROM bags",
    "instance_weight": f"WITH {_I} SELECT pos, CAST(sum(CASE WHEN label = '1' THEN 2 ELSE 1 END) AS DOUBLE) AS weight FROM i GROUP BY pos",
    "bag_renumber": f"WITH {_I} SELECT pos, row_number() OVER (ORDER BY md5(bag_id || ':42'), bag_id) - 1 AS place FROM bags",
    "dataset_contains": f"WITH {_I} SELECT v AS bag_id, v IN (SELECT bag_id FROM bags) AS holds FROM (VALUES ('1'), ('5'), ('-3'), ('x')) AS t(v)",
    "feature_get": f"WITH {_I} SELECT pos, r AS inst_idx, round(x[3], 6) AS value FROM i",
    "feature_set": f"WITH {_I} SELECT pos, r AS inst_idx, round(x[1], 6) AS v0, CAST(0.5 AS DOUBLE) AS v1, round(x[3], 6) AS v2 FROM i",
    "label_list": f"WITH {_I} SELECT pos, label FROM bags",
    "label_cast": "SELECT o_orderkey, CAST(trunc(o_totalprice / 100000) AS INT) AS class_id FROM orders",
    "positive_bags": f"WITH {_I} SELECT pos FROM bags WHERE label = '1'",
    "negative_bags": f"WITH {_I} SELECT pos FROM bags WHERE label = '0'",
    "class_balance": f"WITH {_I} SELECT count(*) AS bags, CAST(sum(n) AS BIGINT) AS instances, count_if(label = '1') AS positive, count_if(label = '0') AS negative FROM bags",
    "type_check": "SELECT o_orderkey, regexp_full_match(v, '-?[0-9]+') AS is_integer, TRY_CAST(v AS DOUBLE) IS NOT NULL AS is_real, v IN ('F', 'O') AS in_domain FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) WHEN 2 THEN o_orderstatus ELSE '-' || o_orderkey || o_orderstatus END AS v FROM orders)",
    "numeric_attrs": "SELECT CAST(cid AS INT) AS idx, name, k AS attr_type, k IN ('integer', 'real') AS is_numeric FROM (SELECT *, CASE WHEN type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'integer' WHEN type IN ('FLOAT', 'DOUBLE') OR type LIKE 'DECIMAL%' THEN 'real' WHEN type = 'DATE' OR type LIKE 'TIMESTAMP%' THEN 'date' ELSE 'string' END AS k FROM pragma_table_info('orders'))",
    "nominal_attribute": "SELECT o_orderkey AS pos, round((o_totalprice - l) / CASE WHEN h = l THEN 1 ELSE h - l END, 6) AS price, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS DOUBLE) AS code, o_orderstatus AS status FROM orders, (SELECT min(o_totalprice) AS l, max(o_totalprice) AS h FROM orders)",
    "minmax_stats": f"{_VALUES} SELECT dim, round(low, 6) AS low, round(high, 6) AS high, round(CASE WHEN high = low THEN 1 ELSE high - low END, 6) AS range FROM t",
    "zscore_stats": f"{_VALUES} SELECT dim, round(mean, 6) AS mean, round(CASE WHEN high = low THEN 1 ELSE std END, 6) AS std FROM t",
    "minmax_scale": f"{_VALUES} SELECT pos, inst_idx, dim, round((v - low) / CASE WHEN high = low THEN 1 ELSE high - low END * 10, 6) AS v FROM v JOIN t USING (dim)",
    "minmax_inverse": f"{_VALUES} SELECT pos, inst_idx, dim, round(v, 6) AS v FROM v",
    "zscore_scale": f"{_VALUES} SELECT pos, inst_idx, dim, round((v - mean) / CASE WHEN high = low THEN 1 ELSE std END, 6) AS v FROM v JOIN t USING (dim)",
    "zscore_inverse": f"{_VALUES} SELECT pos, inst_idx, dim, round(v, 6) AS v FROM v",
    "hash_split": f"WITH {_I}, {_SPLIT} SELECT pos, CASE WHEN place < cut THEN 'train' ELSE 'test' END AS part FROM o",
    "instance_distance": f"WITH {_EMBEDDED} SELECT a, b, round(min(d), 6) AS least, round(max(d), 6) AS most FROM p GROUP BY a, b",
    "directed_hausdorff": f"WITH {_NATION} SELECT a, b, round(max(m), 6) AS dist FROM (SELECT x.pos a, y.pos b, x.r, min(abs(x.x - y.x)) m FROM n x JOIN n y ON x.pos <> y.pos GROUP BY 1, 2, 3) GROUP BY a, b",
    "hausdorff_pairs": f"WITH {_EMBEDDED} SELECT a, b, round(greatest(max(u), max(v)), 6) AS dist FROM (SELECT a, b, min(d) AS u, NULL AS v FROM p GROUP BY a, b, ar UNION ALL SELECT a, b, NULL, min(d) FROM p GROUP BY a, b, br) GROUP BY a, b",
    "hausdorff_matrix": f"WITH {_NATION}, p AS MATERIALIZED (SELECT x.pos a, y.pos b, x.r ar, y.r br, abs(x.x - y.x) d FROM n x JOIN n y ON x.pos < y.pos) SELECT a, b, round(greatest(max(u), max(v)), 6) AS dist, round(greatest(max(u), max(v)), 6) AS by_columns FROM (SELECT a, b, min(d) AS u, NULL AS v FROM p GROUP BY a, b, ar UNION ALL SELECT a, b, NULL, min(d) FROM p GROUP BY a, b, br) GROUP BY a, b",
    "synthetic_bags": """WITH h AS (SELECT pos, k, n, [CAST('0x' || substr(md5('42:' || s || ':' || pos || ':' || k), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE FOR s IN [1, 2, 5, 6]] AS u FROM
 (SELECT pos, n, unnest(range(1, n + 1)) AS k FROM (SELECT pos, CAST('0x' || substr(md5('42:99:' || pos), 1, 12) AS BIGINT) % 3 + CASE WHEN pos >= 30 THEN 1 ELSE 2 END AS n FROM range(35) AS t(pos)))),
v AS (SELECT pos, n, k, CASE WHEN pos >= 30 THEN u[1] * 100 - 50 ELSE c + sqrt(-2 * ln(1 - u[1])) * cos(2 * pi() * u[2]) END AS x, CASE WHEN pos >= 30 THEN u[3] * 100 - 50 ELSE c + sqrt(-2 * ln(1 - u[3])) * cos(2 * pi() * u[4]) END AS y FROM (SELECT *, CASE WHEN pos < 15 THEN 10 ELSE -10 END AS c FROM h))
SELECT pos, 'bag_' || pos AS bag_id, CASE WHEN pos < 15 THEN '1' WHEN pos < 30 THEN '0' ELSE CAST(CAST('0x' || substr(md5('42:77:' || pos), 1, 12) AS BIGINT) % 2 AS VARCHAR) END AS label, count(*) AS n, round(sum(round(x, 2)), 2) AS x, round(sum(round(y, 2)), 2) AS y FROM v GROUP BY pos""",
    "customer_eps_neighbours": "WITH i AS MATERIALIZED (SELECT o_custkey AS pos, row_number() OVER () AS r, o_totalprice/100000 AS x FROM orders JOIN customer ON c_custkey = o_custkey), b AS MATERIALIZED (SELECT pos, min(x) AS l, max(x) AS h FROM i GROUP BY pos), p AS MATERIALIZED (SELECT x.pos a, y.pos b, i.r ar, j.r br, abs(i.x - j.x) d FROM b x JOIN b y ON x.pos < y.pos AND abs(x.l - y.l) <= 0.2004 AND abs(x.h - y.h) <= 0.2004 JOIN i ON i.pos = x.pos JOIN i j ON j.pos = y.pos) SELECT a, b, round(greatest(max(u), max(v)), 8) AS dist FROM (SELECT a, b, min(d) AS u, NULL AS v FROM p GROUP BY a, b, ar UNION ALL SELECT a, b, NULL, min(d) FROM p GROUP BY a, b, br) GROUP BY a, b HAVING greatest(max(u), max(v)) <= 0.2003",
    "order_eps_neighbours": f"WITH {_E} SELECT a, b, round(dist, 6) AS dist FROM e",
    "neighbour_count": f"{_FIT} SELECT pos, neighbours FROM k",
    "core_bags": f"{_FIT} SELECT pos FROM f WHERE is_core",
    "fit_strict": f"{_FIT} SELECT pos, cluster_id, is_core FROM f",
    "fit_compat": f"WITH RECURSIVE {_E}, l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT pos AS node, pos AS root FROM bags UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node), s AS MATERIALIZED (SELECT node AS pos, min(root) AS seed FROM r GROUP BY node) SELECT pos, CAST(dense_rank() OVER (ORDER BY seed) - 1 AS INT) AS cluster_id, EXISTS (SELECT 1 FROM l WHERE l.a = s.pos) AS is_core FROM s",
    "cluster_sizes": f"{_FIT} SELECT cluster_id, count(*) AS n FROM f GROUP BY 1",
    "noise_bags": f"{_FIT} SELECT pos FROM f WHERE cluster_id = -1",
    "cluster_members": f"{_FIT} SELECT pos FROM f WHERE cluster_id = 0",
    "distinct_clusters": f"{_FIT} SELECT DISTINCT cluster_id FROM f",
    "model_stats": f"{_FIT} SELECT CAST({EPS} AS DOUBLE) AS eps, CAST({MIN_PTS} AS INT) AS min_pts, count(*) AS total, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS clusters, count_if(is_core) AS cores, count_if(cluster_id = -1) AS noise, round(count_if(cluster_id = -1) * 100.0::DOUBLE / count(*), 4) AS noise_pct FROM f",
    "predict": f"{_PREDICTED} SELECT pos, cluster_id FROM z",
    "nearest_core": f"{_PREDICTED} SELECT pos, round(dist, 6) AS dist FROM z WHERE dist IS NOT NULL",
    "fit_predict": f"{_SELF} SELECT pos, cluster_id FROM z",
    "predict_noise_rate": f"{_PREDICTED} SELECT count(*) AS total, count_if(cluster_id = -1) AS noise, round(count_if(cluster_id = -1) * 100.0::DOUBLE / count(*), 4) AS noise_pct FROM z",
    "cluster_class_map": f"{_MAPPED} SELECT cluster_id, class_id FROM m",
    "confusion": f"{_MAPPED} SELECT tn, fp, fn, tp FROM q",
    "metrics": f"{_MAPPED} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(specificity, 6) AS specificity FROM (SELECT {_RATIOS} FROM q)",
    "interpretation": "SELECT o_orderkey, CASE WHEN c = 2 AND f > 0.8 THEN 'excellent' WHEN c > 2 THEN 'over-segmented' WHEN c = 1 THEN 'under-segmented' WHEN c = 0 THEN 'all noise' ELSE 'poor' END AS says FROM (SELECT o_orderkey, o_custkey % 4 AS c, least(1, o_totalprice / 400000) AS f FROM orders)",
    "param_grid": f"WITH RECURSIVE {_E}, {_fitted(min_pts=2, eps=0.07, tag='g1')}, {_fitted(min_pts=3, eps=0.07, tag='g2')}, {_fitted(min_pts=2, tag='g3')}, {_fitted(min_pts=3, tag='g4')} {_GRID}",
    "bag_centroid": f"WITH {_I} SELECT pos, round(avg(x[1]), 6) AS v0, round(avg(x[2]), 6) AS v1, round(avg(x[3]), 6) AS v2 FROM i GROUP BY pos",
    "arff_roundtrip": "SELECT CAST(s_nationkey AS VARCHAR) AS bag_id, CAST(n_regionkey % 2 AS VARCHAR) AS label, count(*) AS n, round(sum(s_acctbal/1000), 6) AS total FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2",
}
