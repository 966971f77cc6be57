"""The registered queries of the library and their SQL counterparts.

Each query is a function of the session and the folder of the tables, with the DuckDB SQL that gives the same rows where
SQL can express it. Names start with the operator's id in the blueprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotweave.functions import vectors as V
from spotweave.operators import baseline, experiment, graph, hierarchical, losses, metrics, mixture, neighbours, pivots, preprocess, sampling
from spotweave.plans import fixtures as X
from spotweave.sources import shared, tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _long(name: str, alias: str | None = None):
    return F.col(name).cast("long").alias(alias or name)


def _weighted(s, d):
    """Spots, their weighted graph over components 3 to 32, and the spots' narrow features."""
    spots = X.spots(s, d)
    narrow = spots.select("spot_id", F.slice("feat", 3, 30).alias("feat"))
    edges = shared.written(graph.place_knn(spots, 6))  # the graph is used several times below
    return spots, shared.written(graph.expression_weights(edges, narrow)), narrow


def _xy(spots: DataFrame) -> DataFrame:
    return spots.select("spot_id", F.array("x", "y").alias("feat"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """The graph chain: neighbours, weights, normalised adjacency, two products, one row for each spot."""
    spots, weights, _ = _weighted(s, d)
    adj = shared.written(graph.normalize_adj(weights, spots))
    two = graph.multihop(adj, _xy(spots), 2, 2)[-1]
    return two.select("spot_id", V.r6(F.col("feat")[0]).alias("x2"), V.r6(F.col("feat")[1]).alias("y2"))


# --- neighbours

_PAIRS = "CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j"
_NEAR = f"SELECT {_PAIRS}, CAST(rank AS BIGINT) AS rank, round(d2, 6) + 0.0 AS d2 FROM near"


def _near(found: DataFrame) -> DataFrame:
    return found.select(_long("i"), _long("j"), _long("rank"), V.r6("d2").alias("d2"))


@query(f"WITH {X.SPOTS}, {X.near(6)} {_NEAR}")
def jn1_place_knn(s, d):
    return _near(neighbours.grid_neighbours(X.spots(s, d), 6))


@query(f"WITH {X.SPOTS}, {X.near(4, 'array_row', 'array_col')} SELECT {_PAIRS}, CAST(rank AS BIGINT) AS rank, CAST(d2 AS DOUBLE) AS d2 FROM near")
def jn1_place_knn_grid_ties(s, d):
    return _near(neighbours.grid_neighbours(X.spots(s, d), 4, x="array_row", y="array_col"))


@query(f"WITH {X.SPOTS}, {X.near(7, include_self=True)} {_NEAR}")
def jn2_knn_self(s, d):
    return _near(neighbours.grid_neighbours(X.spots(s, d), 7, include_self=True))


@query(f"WITH {X.SPOTS}, {X.near_feat(6, include_self=False)} {_NEAR}")
def jn3_knn_embedding(s, d):
    spots = X.spots(s, d)
    return _near(pivots.pivot_neighbours(spots, spots, 6))


@query(f"WITH {X.SPOTS}, {X.near(1)} SELECT {_PAIRS}, round(d2, 6) + 0.0 AS d2 FROM near")
def tk1_nearest(s, d):
    return neighbours.grid_neighbours(X.spots(s, d), 1).select(_long("i"), _long("j"), V.r6("d2").alias("d2"))


# --- graphs


@query(f"WITH {X.SPOTS}, {X.near(6)}, {X.EDGES} SELECT {_PAIRS} FROM edges")
def set1_symmetrise(s, d):
    return graph.place_knn(X.spots(s, d), 6).select(_long("i"), _long("j"))


@query(f"WITH {X.GRAPH} SELECT {_PAIRS}, round(w, 6) + 0.0 AS w FROM weights")
def gr2_expression_weights(s, d):
    return _weighted(s, d)[1].select(_long("i"), _long("j"), V.r6("w").alias("w"))


@query(f"WITH {X.GRAPH} SELECT round(tau, 6) + 0.0 AS tau FROM tau")
def ag4_median_tau(s, d):
    spots = X.spots(s, d)
    narrow = spots.select("spot_id", F.slice("feat", 3, 30).alias("feat"))
    tau = graph.scale_of(shared.written(graph.edge_distances(graph.place_knn(spots, 6), narrow)))
    return s.range(1).select(V.r6(F.lit(tau)).alias("tau"))


@query(f"WITH {X.GRAPH}, {X.ADJ} SELECT {_PAIRS}, round(v, 6) + 0.0 AS v FROM adj")
def gr4_normalize_adj(s, d):
    spots, weights, _ = _weighted(s, d)
    return graph.normalize_adj(weights, spots).select(_long("i"), _long("j"), V.r6("v").alias("v"))


@query(f"WITH {X.GRAPH} SELECT CAST(i AS BIGINT) AS i, round(sum(w), 6) + 0.0 AS degree, CAST(count(*) AS BIGINT) AS n FROM weights GROUP BY i")
def ag5_degree(s, d):
    return _weighted(s, d)[1].groupBy("i").agg(V.r6(F.sum("w")).alias("degree"), F.count(F.lit(1)).alias("n")).select(_long("i"), "degree", "n")


_MNN = f"""{X.SPOTS}, u AS (SELECT i, batch, list_transform(feat, lambda v: v / (sqrt(list_sum(list_transform(feat, lambda w: w * w))) + 1e-8)) AS f FROM spots),
far AS (SELECT a.i, b.i AS j, b.batch AS g, list_sum(list_transform(list_zip(a.f, b.f), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM u a JOIN u b ON a.batch <> b.batch),
best AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i, g ORDER BY d2, j) AS r FROM far) WHERE r <= 3),
mnn AS (SELECT x.i, x.j FROM best x JOIN best y ON x.i = y.j AND x.j = y.i)"""


@query(f"WITH {_MNN} SELECT {_PAIRS} FROM mnn")
def jn4_mnn_edges(s, d):
    return graph.mnn_edges(X.spots(s, d), 3).select(_long("i"), _long("j"))


@query(f"WITH {_MNN}, {X.near(6)}, {X.EDGES} SELECT {_PAIRS}, 1.0::DOUBLE AS w FROM (SELECT i, j FROM edges UNION SELECT i, j FROM mnn)")
def set3_union_graph(s, d):
    spots = X.spots(s, d)
    return graph.union_graph(graph.place_knn(spots, 6), graph.mnn_edges(spots, 3)).select(_long("i"), _long("j"), "w")


@query(f"WITH {X.GRAPH}, both_w AS (SELECT i, j, w FROM weights UNION ALL SELECT j, i, w FROM weights WHERE i < j) SELECT {_PAIRS}, round(sum(w), 6) + 0.0 AS w FROM both_w GROUP BY i, j")
def ag16_coalesce(s, d):
    weights = _weighted(s, d)[1]
    doubled = weights.union(weights.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return graph.coalesce(doubled).select(_long("i"), _long("j"), V.r6("w").alias("w"))


@query(f"WITH {X.GRAPH}, {X.ADJ} SELECT CAST(adj.i AS BIGINT) AS i, round(sum(v * x), 6) + 0.0 AS x1, round(sum(v * y), 6) + 0.0 AS y1 FROM adj JOIN spots ON spots.i = adj.j GROUP BY adj.i")
def jn7_spmm(s, d):
    spots, weights, _ = _weighted(s, d)
    one = graph.propagate(graph.normalize_adj(weights, spots), _xy(spots), 2)
    return one.select(_long("spot_id", "i"), V.r6(F.col("feat")[0]).alias("x1"), V.r6(F.col("feat")[1]).alias("y1"))


@query(f"WITH {X.GRAPH}, {X.ADJ} SELECT CAST(a.i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM adj a JOIN adj b ON a.j = b.i GROUP BY a.i, b.j")
def jn8_spgemm(s, d):
    spots, weights, _ = _weighted(s, d)
    adj = shared.written(graph.normalize_adj(weights, spots))
    return graph.spgemm(adj, adj).select(_long("i"), _long("j"), V.r6("v").alias("v"))


_HOPS = f"{X.GRAPH}, {X.ADJ}, h1 AS (SELECT adj.i, sum(v * x) AS x, sum(v * y) AS y FROM adj JOIN spots ON spots.i = adj.j GROUP BY adj.i), h2 AS (SELECT adj.i, sum(v * h1.x) AS x, sum(v * h1.y) AS y FROM adj JOIN h1 ON h1.i = adj.j GROUP BY adj.i)"


@query(f"WITH {_HOPS} SELECT CAST(i AS BIGINT) AS spot_id, round(x, 6) + 0.0 AS x2, round(y, 6) + 0.0 AS y2 FROM h2")
def gr6_multihop(s, d):
    return flagship(s, d).select(_long("spot_id"), "x2", "y2")


@query(f"""WITH {X.GRAPH}, f2 AS (SELECT i, list_transform(f, lambda v: v / (sqrt(list_sum(list_transform(f, lambda u: u * u))) + 1e-8)) AS u FROM (SELECT i, feat[33:64] AS f FROM spots)),
d2 AS (SELECT e.i, e.j, 1 - list_inner_product(a.u, b.u) AS d FROM edges e JOIN f2 a ON a.i = e.i JOIN f2 b ON b.i = e.j), t2 AS (SELECT median(d) + 1e-8 AS tau FROM d2)
SELECT CAST(w.i AS BIGINT) AS i, CAST(w.j AS BIGINT) AS j, round(0.5 * greatest(0.05, least(1.0, exp(-d2.d / t2.tau))) + 0.5 * w.w, 6) + 0.0 AS w FROM weights w JOIN d2 ON d2.i = w.i AND d2.j = w.j, t2""")
def gr7_refine_graph(s, d):
    spots, weights, _ = _weighted(s, d)
    fresh = graph.expression_weights(weights, spots.select("spot_id", F.slice("feat", 33, 32).alias("feat")))
    return graph.refine_graph(weights, fresh, 0.5).select(_long("i"), _long("j"), V.r6("w").alias("w"))


@query(f"WITH {_HOPS} SELECT CAST(i AS BIGINT) AS spot_id, round(1 / (1 + exp(-x)), 6) + 0.0 AS sx, round(1 / (1 + exp(-y)), 6) + 0.0 AS sy FROM h1")
def gr9_summary(s, d):
    spots, weights, _ = _weighted(s, d)
    out = graph.neighbourhood_summary(graph.normalize_adj(weights, spots), _xy(spots), 2)
    return out.select(_long("spot_id"), V.r6(F.col("feat")[0]).alias("sx"), V.r6(F.col("feat")[1]).alias("sy"))


@query(f"""WITH {_HOPS}, s3 AS (SELECT spots.i, 0 AS hop, tanh(spots.x) * 1.5 - tanh(spots.y) AS s FROM spots UNION ALL SELECT i, 1, tanh(x) * 1.5 - tanh(y) FROM h1 UNION ALL SELECT i, 2, tanh(x) * 1.5 - tanh(y) FROM h2),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY i)) AS e FROM s3)
SELECT CAST(i AS BIGINT) AS spot_id, CAST(hop AS BIGINT) AS hop, round(e / sum(e) OVER (PARTITION BY i), 6) + 0.0 AS weight FROM e""")
def wn2_hop_softmax(s, d):
    spots, weights, _ = _weighted(s, d)
    hops = graph.multihop(shared.written(graph.normalize_adj(weights, spots)), _xy(spots), 2, 2)
    score = F.tanh(F.col("feat")[0]) * F.lit(1.5) - F.tanh(F.col("feat")[1])
    rows = [h.select("spot_id", F.lit(n).cast("long").alias("hop"), score.alias("s")) for n, h in enumerate(hops)]
    return graph.hop_softmax(rows[0].union(rows[1]).union(rows[2])).select(_long("spot_id"), "hop", V.r6("weight").alias("weight"))


# --- metrics

_CELLS = f"""{X.SPOTS}, cells AS (SELECT truth, pred, CAST(count(*) AS DOUBLE) AS n FROM spots WHERE truth IS NOT NULL GROUP BY 1, 2),
a AS (SELECT sum(n) AS s FROM cells GROUP BY truth), b AS (SELECT sum(n) AS s FROM cells GROUP BY pred), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS tp, sum(n * ln(n)) AS hc FROM cells),
pa AS (SELECT sum(s * (s - 1) / 2) AS pa, sum(s * ln(s)) AS ha FROM a), pb AS (SELECT sum(s * (s - 1) / 2) AS pb, sum(s * ln(s)) AS hb FROM b)"""
_ARI = "round((tp - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) + 0.0 AS ari"
_NMI = "round(2 * (ln(t) + hc / t - ha / t - hb / t) / (ln(t) - ha / t + ln(t) - hb / t), 6) + 0.0 AS nmi"
_FMS = "round(tp / sqrt(pa * pb), 6) + 0.0 AS fms"


@query(f"WITH {_CELLS} SELECT truth, CAST(pred AS BIGINT) AS pred, CAST(n AS BIGINT) AS n FROM cells")
def ag10_contingency(s, d):
    return metrics.contingency(X.spots(s, d)).select("truth", _long("pred"), _long("n"))


@query(f"WITH {_CELLS} SELECT {_ARI} FROM t, pa, pb")
def mt1_ari(s, d):
    return metrics.agreement(X.spots(s, d)).select(V.r6("ari").alias("ari"))


@query(f"WITH {_CELLS} SELECT {_NMI} FROM t, pa, pb")
def mt2_nmi(s, d):
    return metrics.agreement(X.spots(s, d)).select(V.r6("nmi").alias("nmi"))


@query(f"WITH {_CELLS} SELECT {_FMS} FROM t, pa, pb")
def mt3_fms(s, d):
    return metrics.agreement(X.spots(s, d)).select(V.r6("fms").alias("fms"))


_SIL = f"""{X.SPOTS}, far AS (SELECT a.i, a.pred AS own, b.pred AS other, sqrt(list_sum(list_transform(list_zip(a.feat, b.feat), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM spots a JOIN spots b ON true),
m AS (SELECT i, own, other, sum(d) AS s, count(*) AS n FROM far GROUP BY 1, 2, 3),
ab AS (SELECT i, max(CASE WHEN own = other THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM m GROUP BY i)"""


@query(f"WITH {_SIL} SELECT round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS silhouette FROM ab")
def mt4_silhouette(s, d):
    return metrics.silhouette(X.spots(s, d), sample=None).select(V.r6("silhouette").alias("silhouette"))


@query(f"WITH {X.SPOTS}, {X.near_feat(30)}, c AS (SELECT near.i, s.batch, CAST(count(*) AS DOUBLE) AS c FROM near JOIN spots s ON s.i = near.j GROUP BY 1, 2) SELECT CAST(i AS BIGINT) AS i, round(sum(c) * sum(c) / sum(c * c), 6) + 0.0 AS ilisi FROM c GROUP BY i")
def mt5_ilisi(s, d):
    return metrics.mixing(X.spots(s, d)).select(_long("i"), V.r6("ilisi").alias("ilisi"))


@query(f"WITH {_CELLS}, {_SIL.replace(X.SPOTS + ', ', '')} SELECT {_ARI}, {_NMI}, {_FMS}, (SELECT round(avg((b - a) / greatest(a, b)), 6) + 0.0 FROM ab) AS sc FROM t, pa, pb".replace("a AS (SELECT sum(n) AS s FROM cells GROUP BY truth)", "ta AS (SELECT sum(n) AS s FROM cells GROUP BY truth)").replace("AS ha FROM a)", "AS ha FROM ta)"))
def mt6_evaluate(s, d):
    spots = X.spots(s, d)
    both = metrics.agreement(spots).crossJoin(metrics.silhouette(spots, sample=None))  # one row each
    return both.select(V.r6("ari").alias("ari"), V.r6("nmi").alias("nmi"), V.r6("fms").alias("fms"), V.r6("silhouette").alias("sc"))


_VOTE = "c AS (SELECT near.i, s.pred AS l, count(*) AS n FROM near JOIN spots s ON s.i = near.j GROUP BY 1, 2), top AS (SELECT i, arg_max(l, n * 1000 - l) AS l, max(n) AS votes FROM c GROUP BY i)"
_VOTED = "SELECT CAST(s.i AS BIGINT) AS spot_id, CAST(s.pred AS BIGINT) AS pred, CAST(CASE WHEN votes > 3 THEN l ELSE s.pred END AS BIGINT) AS pred_refined, CAST(votes AS BIGINT) AS votes FROM spots s JOIN top ON top.i = s.i"


@query(f"WITH {X.SPOTS}, {X.near_feat(7)}, {_VOTE} {_VOTED}")
def ag8_majority_vote(s, d):
    spots = X.spots(s, d)
    near = pivots.pivot_neighbours(spots, spots, 7, include_self=True)
    return metrics.vote(spots, near.select("i", "j")).select(_long("spot_id"), _long("pred"), _long("pred_refined"), _long("votes"))


@query(f"WITH {X.SPOTS}, {X.near(7, include_self=True)}, {_VOTE} {_VOTED}")
def cl2_place_refine(s, d):
    spots = X.spots(s, d)
    return metrics.refine(spots, spots).select(_long("spot_id"), _long("pred"), _long("pred_refined"), _long("votes"))


@query(f"WITH {X.SPOTS} SELECT CAST(i AS BIGINT) AS spot_id, truth FROM spots WHERE truth IS NOT NULL")
def fil4_labelled_only(s, d):
    return metrics.labelled_only(X.spots(s, d)).select(_long("spot_id"), "truth")


# --- counts

_GENES = f"{X.COUNTS}, per_gene AS (SELECT gene, count(*) FILTER (cnt > 0) AS cells, sum(cnt) AS total FROM counts GROUP BY gene)"
_KEPT = f"{_GENES}, kept AS (SELECT c.* FROM counts c JOIN per_gene g ON g.gene = c.gene WHERE g.cells >= 50)"
_NORMAL = f"{_KEPT}, x AS (SELECT spot_id, gene, cnt * 10000.0 / sum(cnt) OVER (PARTITION BY spot_id) AS x FROM kept)"
_MOMENTS = f"{_NORMAL}, l AS (SELECT spot_id, gene, ln(1 + x) AS x FROM x), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents), m AS (SELECT gene, sum(x) / any_value(n) AS mean, (sum(x * x) - any_value(n) * (sum(x) / any_value(n)) * (sum(x) / any_value(n))) / (any_value(n) - 1) AS variance FROM l, n GROUP BY gene)"


def _kept(s, d):
    return preprocess.filter_genes(X.counts(s, d), 50)


def _logged(s, d):
    return preprocess.log1p(preprocess.normalize_total(_kept(s, d)))


def _logged_once(s, d):
    """The same as a written table, for queries that use it several times."""
    return shared.written(_logged(s, d))


def _n_spots(s, d):
    return X.document_spots(s, d).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_KEPT} SELECT gene, CAST(count(*) AS BIGINT) AS spots, sum(cnt) AS total FROM kept GROUP BY gene")
def fil1_min_cells(s, d):
    return _kept(s, d).groupBy("gene").agg(F.count(F.lit(1)).alias("spots"), F.sum("cnt").alias("total"))


@query(f"WITH {_GENES} SELECT gene, CAST(cells AS BIGINT) AS spots, total FROM per_gene WHERE total >= 100")
def fil2_min_counts(s, d):
    return preprocess.filter_genes(X.counts(s, d), min_counts=100).groupBy("gene").agg(F.count(F.lit(1)).alias("spots"), F.sum("cnt").alias("total"))


@query(f"WITH {_NORMAL} SELECT CAST(spot_id AS BIGINT) AS spot_id, gene, round(x, 6) + 0.0 AS x FROM x")
def ag1_normalize_total(s, d):
    return preprocess.normalize_total(_kept(s, d)).select(_long("spot_id"), "gene", V.r6("x").alias("x"))


@query(f"WITH {_NORMAL} SELECT CAST(spot_id AS BIGINT) AS spot_id, gene, round(ln(1 + x), 6) + 0.0 AS x FROM x")
def st3_log1p(s, d):
    return _logged(s, d).select(_long("spot_id"), "gene", V.r6("x").alias("x"))


@query(f"WITH {_MOMENTS} SELECT gene, round(mean, 6) + 0.0 AS mean, round(variance, 6) + 0.0 AS variance FROM m")
def ag2_gene_moments(s, d):
    return preprocess.gene_moments(_logged(s, d), _n_spots(s, d)).select("gene", V.r6("mean").alias("mean"), V.r6("variance").alias("variance"))


@query(f"""WITH {_MOMENTS}
SELECT CAST(d.doc_id AS BIGINT) AS spot_id, m.gene, round(least(10.0, (coalesce(l.x, 0.0) - mean) / sqrt(variance)), 5) + 0.0 AS z FROM documents d CROSS JOIN m LEFT JOIN l ON l.spot_id = d.doc_id AND l.gene = m.gene""")
def st4_scale_clip(s, d):
    logged, n = _logged_once(s, d), _n_spots(s, d)
    return preprocess.scale(logged, preprocess.gene_moments(logged, n), X.document_spots(s, d), digits=5).select(_long("spot_id"), "gene", "z")


@query(f"WITH {X.COUNTS}, n AS (SELECT count(DISTINCT slice) AS n FROM counts) SELECT gene, CAST(count(*) AS BIGINT) AS spots FROM counts GROUP BY gene HAVING count(DISTINCT slice) = (SELECT n FROM n)")
def jn10_gene_intersect(s, d):
    return preprocess.shared_genes(X.counts(s, d)).groupBy("gene").agg(F.count(F.lit(1)).alias("spots"))


@query("WITH o AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents GROUP BY source) SELECT CAST(d.doc_id AS BIGINT) AS spot_id, CAST(o.code AS BIGINT) AS batch, CAST(d.doc_id AS VARCHAR) || '-' || d.source AS name FROM documents d JOIN o ON o.source = d.source")
def prj3_batch_codes(s, d):
    spots = X.document_spots(s, d)
    order = [r["slice"] for r in spots.groupBy("slice").agg(F.min("spot_id").alias("first")).orderBy("first").collect()]  # a name for each slice
    return tables.batch_codes(spots, order).select(_long("spot_id"), _long("batch"), F.concat_ws("-", F.col("spot_id").cast("string"), "slice").alias("name"))


@query(f"WITH {X.SPOTS}, s AS (SELECT max(x) - min(x) AS span FROM spots) SELECT CAST(i AS BIGINT) AS spot_id, round(x + batch * span * 1.5, 6) + 0.0 AS x FROM spots, s")
def prj4_slice_offset(s, d):
    return tables.shifted(X.spots(s, d)).select(_long("spot_id"), V.r6("x").alias("x"))


@query(f"WITH {X.SPOTS} SELECT CAST(i AS BIGINT) AS spot_id, CAST(batch = 0 AS DOUBLE) AS b0, CAST(batch = 1 AS DOUBLE) AS b1, CAST(batch = 2 AS DOUBLE) AS b2 FROM spots")
def prj7_one_hot(s, d):
    hot = X.spots(s, d).select("spot_id", V.one_hot("batch", 3).alias("h"))
    return hot.select(_long("spot_id"), *[F.col("h")[k].alias(f"b{k}") for k in range(3)])


@query("SELECT CAST(doc_id AS BIGINT) AS pos, CASE WHEN n > 0 THEN source || '-' || CAST(n AS VARCHAR) ELSE source END AS gene FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def src3_unique_names(s, d):
    return tables.unique_names(X.document_spots(s, d).select(F.col("slice").alias("gene"), _long("spot_id", "pos"))).select("pos", "gene")


# --- losses and soft assignments

_DEC = f"""{X.SPOTS}, c AS (SELECT pred AS k, avg(x) AS cx, avg(y) AS cy FROM spots GROUP BY pred), r AS (SELECT i, k, 1 / (1 + (x - cx) * (x - cx) + (y - cy) * (y - cy)) AS q FROM spots, c),
q AS (SELECT i, k, q / sum(q) OVER (PARTITION BY i) AS q FROM r), f AS (SELECT *, q * q / sum(q) OVER (PARTITION BY k) AS p FROM q), p AS (SELECT i, k, q, p / sum(p) OVER (PARTITION BY i) AS p FROM f)"""


def _soft(s, d):
    spots = X.spots(s, d)
    centres = spots.groupBy(F.col("pred").alias("k")).agg(F.array(F.avg("x"), F.avg("y")).alias("centre"))
    return losses.student_t(_xy(spots), centres)


@query(f"WITH {_DEC} SELECT CAST(i AS BIGINT) AS spot_id, CAST(k AS BIGINT) AS k, round(q, 6) + 0.0 AS q FROM q")
def l16_student_t(s, d):
    return _soft(s, d).select(_long("spot_id"), _long("k"), V.r6("q").alias("q"))


@query(f"WITH {_DEC} SELECT CAST(i AS BIGINT) AS spot_id, CAST(k AS BIGINT) AS k, round(p, 6) + 0.0 AS p FROM p")
def wn6_dec_target(s, d):
    return losses.sharpened_target(_soft(s, d)).select(_long("spot_id"), _long("k"), V.r6("p").alias("p"))


@query(f"WITH {_DEC} SELECT round(avg(p * (ln(p) - ln(q))) * 1e6, 3) + 0.0 AS kl_millionths FROM p")
def ls13_dec_kl(s, d):
    return losses.assignment_kl(losses.sharpened_target(_soft(s, d))).select((F.round(F.col("kl") * F.lit(1e6), 3) + F.lit(0.0)).alias("kl_millionths"))


_COS = "(list_inner_product(p, q) / ((sqrt(list_inner_product(p, p)) + 1e-8) * (sqrt(list_inner_product(q, q)) + 1e-8)))"
_HALVES = f"{X.SPOTS}, h AS (SELECT i, feat[1:32] AS p, feat[33:64] AS q FROM spots)"


def _halves(s, d):
    return X.spots(s, d).select("spot_id", F.slice("feat", 1, 32).alias("p"), F.slice("feat", 33, 32).alias("q"))


@query(f"WITH {_HALVES} SELECT round(avg((1 - {_COS}) * (1 - {_COS})), 6) + 0.0 AS sce2, round(avg(pow(1 - {_COS}, 3)), 6) + 0.0 AS sce3 FROM h")
def ls1_sce(s, d):
    rows = _halves(s, d)
    both = losses.scaled_cosine_error(rows, "p", "q", 2).withColumnRenamed("sce", "a").crossJoin(losses.scaled_cosine_error(rows, "p", "q", 3))
    return both.select(V.r6("a").alias("sce2"), V.r6("sce").alias("sce3"))


_MASK = "substr(md5(CAST(i AS VARCHAR) || '|1|7'), 1, 8) < '4ccccccc'"


@query(f"WITH {_HALVES} SELECT round(avg((1 - {_COS}) * (1 - {_COS})) FILTER ({_MASK}) + 0.1 * sum(list_sum(list_transform(list_zip(p, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / sum(len(p)), 6) + 0.0 AS rec FROM h")
def ls5_reconstruction(s, d):
    rows = _halves(s, d).withColumn("m", sampling.bernoulli_mask(0.3, "spot_id", F.lit(1), F.lit(7)))
    return losses.reconstruction(rows, "p", "q", "m").select(V.r6("rec").alias("rec"))


_SAMPLE = "SELECT i FROM spots ORDER BY substr(md5(CAST(i AS VARCHAR) || '|9'), 1, 8), i LIMIT 64"


@query(f"""WITH {X.SPOTS}, s AS (SELECT i, x / sqrt(x * x + y * y) AS x, y / sqrt(x * x + y * y) AS y FROM spots WHERE i IN ({_SAMPLE})),
l AS (SELECT a.i, b.i AS j, (a.x * b.y + a.y * b.x) / 0.5 AS l FROM s a, s b),
zi AS (SELECT i, max(l) AS m FROM l GROUP BY i), zj AS (SELECT j, max(l) AS m FROM l GROUP BY j),
ci AS (SELECT l.i, any_value(m) + ln(sum(exp(l - m))) AS z FROM l JOIN zi ON zi.i = l.i GROUP BY l.i), cj AS (SELECT l.j, any_value(m) + ln(sum(exp(l - m))) AS z FROM l JOIN zj ON zj.j = l.j GROUP BY l.j)
SELECT round(((SELECT avg(z - l) FROM ci JOIN l ON l.i = ci.i AND l.i = l.j) + (SELECT avg(z - l) FROM cj JOIN l ON l.j = cj.j AND l.i = l.j)) / 2, 6) + 0.0 AS nce FROM (SELECT 1)""")
def ls3_info_nce(s, d):
    sample = sampling.contrast_sample(X.spots(s, d), 64, 9)
    rows = shared.written(sample.select("spot_id", F.array("x", "y").alias("a"), F.array("y", "x").alias("b")))
    return losses.info_nce(rows, "a", "b").select(V.r6("nce").alias("nce"))


@query(f"WITH {X.SPOTS} SELECT round(avg(list_sum(list_transform(list_zip(feat[1:32], feat[33:64]), lambda z: -0.5 * (1 + z[2] - z[1] * z[1] - exp(z[2]))))), 6) + 0.0 AS kl FROM spots")
def ls4_kl(s, d):
    return losses.kl_normal(_halves(s, d), "p", "q").select(V.r6("kl").alias("kl"))


_FORM, _BIAS = [[0.5, -0.25], [1.0, 0.75]], 0.125
_FORMED = "{z}.x * (0.5 * {s}.x - 0.25 * {s}.y) + {z}.y * ({s}.x + 0.75 * {s}.y) + 0.125"
_ORDERED = "(SELECT i, x, y, row_number() OVER (ORDER BY substr(md5(CAST(i AS VARCHAR) || '|{}'), 1, 8), i) - 1 AS at, count(*) OVER () AS n FROM spots)"


def _bce(logit: str, label: int) -> str:
    return f"greatest({logit}, 0.0) - ({logit}) * {label} + ln(1 + exp(-abs({logit})))"


def _ls7() -> str:
    pairs = [("z", "s", 1), ("o", "t", 1), ("o", "s", 0), ("z", "t", 0)]
    each = " + ".join(f"({_bce(_FORMED.format(z=a, s=b), y)})" for a, b, y in pairs)
    summed = "{} AS (SELECT adj.i, 1 / (1 + exp(-sum(v * x))) AS x, 1 / (1 + exp(-sum(v * y))) AS y FROM adj JOIN {} f ON f.i = adj.j GROUP BY adj.i)"
    ordered = _ORDERED.format(4)
    return f"""WITH {X.GRAPH}, {X.ADJ}, o AS (SELECT a.i, b.x, b.y FROM {ordered} a JOIN {ordered} b ON b.at = (a.at + 1) % a.n),
{summed.format("s", "spots")}, {summed.format("t", "o")} SELECT round(avg({each}) / 2, 6) + 0.0 AS lg FROM spots z JOIN o ON o.i = z.i JOIN s ON s.i = z.i JOIN t ON t.i = z.i"""


@query(_ls7())
def ls7_bce(s, d):
    spots, weights, _ = _weighted(s, d)
    adj = shared.written(graph.normalize_adj(weights, spots))
    own, other = _xy(spots), shared.written(sampling.permuted(_xy(spots), 4))
    rows = own.withColumnRenamed("feat", "z").join(other.withColumnRenamed("feat", "o"), "spot_id")
    for view, name in ((own, "s"), (other, "t")):
        rows = rows.join(graph.neighbourhood_summary(adj, view, 2).withColumnRenamed("feat", name), "spot_id")
    return losses.local_global(rows, "z", "s", "o", "t", _FORM, _BIAS).select(V.r6("lg").alias("lg"))


_HALF_COS = "list_inner_product(p, q) / (sqrt(list_inner_product(p, p)) * sqrt(list_inner_product(q, q)))"


@query(f"WITH {X.SPOTS}, h AS (SELECT i, feat[1:32] AS p, feat[33:64] AS q FROM spots) SELECT round(-avg({_HALF_COS}), 6) + 0.0 AS xlevel FROM h")
def ls6_cross_level(s, d):
    return losses.cross_level(_halves(s, d), "p", "q").select(V.r6("xlevel").alias("xlevel"))


def _drawn(epoch) -> str:
    """Edges with the other end drawn by hash: a place in the order of the spots' hashes."""
    return f"""{X.SPOTS}, {X.near(6)}, {X.EDGES}, placed AS {_ORDERED.format(0)},
neg AS (SELECT e.i, p.i AS j FROM edges e JOIN placed p ON p.at = CAST(('0x' || substr(md5(CAST(e.i AS VARCHAR) || '|' || CAST(e.j AS VARCHAR) || '|{epoch}'), 1, 8)) AS BIGINT) % p.n)"""


_NEGATIVE = _drawn(3)


def _negative(s, d, epoch=3):
    spots = X.spots(s, d)
    edges = shared.written(graph.place_knn(spots, 6))
    return spots, edges, sampling.negative_edges(edges, spots, epoch)


@query(f"WITH {_NEGATIVE} SELECT {_PAIRS}, CAST(count(*) AS BIGINT) AS n FROM neg GROUP BY i, j")
def sm4_negative_edges(s, d):
    return _negative(s, d)[2].groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).select(_long("i"), _long("j"), "n")


@query(f"WITH {_drawn('once')} SELECT {_PAIRS}, CAST(count(*) AS BIGINT) AS n FROM neg GROUP BY i, j")
def sm5_negative_once(s, d):
    return _negative(s, d, None)[2].groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).select(_long("i"), _long("j"), "n")


@query(f"""WITH {_NEGATIVE}, all_e AS (SELECT i, j, 1.0 AS y FROM edges UNION ALL SELECT i, j, 0.0 FROM neg),
l AS (SELECT e.y, list_inner_product(a.feat, b.feat) / (sqrt(list_inner_product(a.feat, a.feat)) * sqrt(list_inner_product(b.feat, b.feat))) / 0.5 AS l FROM all_e e JOIN spots a ON a.i = e.i JOIN spots b ON b.i = e.j)
SELECT round(avg({_bce('l', 1)}) FILTER (y = 1) + avg({_bce('l', 0)}) FILTER (y = 0), 6) + 0.0 AS edge FROM l""")
def ls8_edge_bce(s, d):
    spots, edges, negative = _negative(s, d)
    labelled = edges.select("i", "j", F.lit(1.0).alias("label")).unionAll(negative)
    return losses.edge_bce(labelled, spots).select(V.r6("edge").alias("edge"))


@query(f"WITH {X.SPOTS} SELECT round(-0.5 / count(*) * avg(list_sum(list_transform(list_zip(feat[1:32], feat[33:64]), lambda z: 1 + 2 * z[2] - z[1] * z[1] - exp(2 * z[2])))), 9) + 0.0 AS kl FROM spots")
def ls10_gcn_kl(s, d):
    return losses.kl_log_std(_halves(s, d), "p", "q").select((F.round("kl", 9) + F.lit(0.0)).alias("kl"))


@query(f"WITH {X.SPOTS}, {X.near(6)}, {X.EDGES}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM spots), e AS (SELECT count(*) AS e FROM edges) SELECT round(n * n / (2 * (n * n - e - n)), 6) + 0.0 AS scale FROM n, e")
def ag12_class_balance(s, d):
    spots = X.spots(s, d)
    return losses.class_balance(graph.place_knn(spots, 6), spots).select(V.r6("scale").alias("scale"))


# --- samples


@query(f"WITH {X.SPOTS} SELECT CAST(i AS BIGINT) AS spot_id, {_MASK} AS masked FROM spots")
def sm1_mask(s, d):
    return X.spots(s, d).select(_long("spot_id"), sampling.bernoulli_mask(0.3, "spot_id", F.lit(1), F.lit(7)).alias("masked"))


@query(f"WITH {X.SPOTS} SELECT CAST(i AS BIGINT) AS spot_id, row_number() OVER (ORDER BY substr(md5(CAST(i AS VARCHAR) || '|5'), 1, 8), i) <= floor(0.8 * count(*) OVER ()) AS masked FROM spots")
def sm2_exact_mask(s, d):
    return sampling.exact_mask(X.spots(s, d).select("spot_id"), 0.8, 5).select(_long("spot_id"), "masked")


@query(f"WITH {X.SPOTS} SELECT CAST(i AS BIGINT) AS spot_id FROM spots ORDER BY substr(md5(CAST(i AS VARCHAR) || '|9'), 1, 8), i LIMIT 64")
def sm3_contrast_sample(s, d):
    return sampling.contrast_sample(X.spots(s, d).select("spot_id"), 64, 9).select(_long("spot_id"))


# --- experiments

_JOBS = f"""{X.RUNS}, seeds AS (SELECT DISTINCT CAST(doc_id % 3 AS INTEGER) AS seed FROM documents), slices AS (SELECT DISTINCT source AS slice FROM documents), methods AS (SELECT DISTINCT lang AS method FROM documents),
jobs AS (SELECT method, slice, seed FROM seeds, slices, methods)"""


def _jobs(s, d):
    docs = X.table(s, d, "documents")
    lists = [docs.select(F.col("lang").alias("method")).distinct(), docs.select(F.col("source").alias("slice")).distinct(), docs.select((F.col("doc_id") % 3).cast("int").alias("seed")).distinct()]
    return experiment.job_grid(*lists)


@query(f"WITH {_JOBS} SELECT method, slice, seed, 'adaptive' AS model FROM jobs")
def jn14_job_grid(s, d):
    return _jobs(s, d).select("method", "slice", "seed", "model")


@query(f"WITH {_JOBS} SELECT j.method, j.slice, j.seed FROM jobs j LEFT JOIN (SELECT * FROM runs WHERE CAST(time AS BIGINT) % 2 = 0) r ON r.method = j.method AND r.slice = j.slice AND r.seed = j.seed WHERE r.method IS NULL")
def jn13_pending_runs(s, d):
    finished = X.runs(s, d).where(F.col("time").cast("long") % 2 == 0)  # of all groups, those of an even number of documents
    return experiment.pending(_jobs(s, d), finished).select("method", "slice", "seed")


@query(f"""WITH {X.RUNS}, p AS (SELECT method, slice, avg(ARI) AS a, avg(NMI) AS n, avg(FMS) AS f FROM runs GROUP BY 1, 2), med AS (SELECT method, median(a) AS a, median(n) AS n, median(f) AS f FROM p GROUP BY 1)
SELECT r.method, round(any_value(med.a), 6) + 0.0 AS median_ari, round(any_value(med.n), 6) + 0.0 AS median_nmi, round(any_value(med.f), 6) + 0.0 AS median_fms, round(avg(ARI), 6) + 0.0 AS mean_ari, round(stddev_pop(ARI), 6) + 0.0 AS std_ari, round(avg(time), 6) + 0.0 AS mean_time, CAST(count(*) AS BIGINT) AS n_runs FROM runs r JOIN med ON med.method = r.method GROUP BY r.method""")
def ag17_run_summary(s, d):
    out = metrics.summary(X.runs(s, d))
    return out.select("method", *[V.r6(c).alias(c) for c in out.columns if c not in ("method", "n_runs")], _long("n_runs"))


@query(f"WITH {X.RUNS}, p AS (SELECT method, slice, count(*) AS n FROM runs GROUP BY 1, 2) SELECT method, slice, rank() OVER (PARTITION BY method ORDER BY n) + (count(*) OVER (PARTITION BY method, n) - 1) / 2.0::DOUBLE AS rank FROM p")
def wn7_average_ranks(s, d):
    per = X.runs(s, d).groupBy("method", "slice").agg(F.count(F.lit(1)).alias("n"))
    return metrics.ranks_with_ties(per, "n", "method").select("method", "slice", F.col("rank").cast("double").alias("rank"))


@query(f"""WITH RECURSIVE {X.RUNS}, p AS (SELECT method, slice, avg(ARI) AS v FROM runs GROUP BY 1, 2),
d AS (SELECT x.method AS a, y.method AS b, round(x.v - y.v, 9) AS d FROM p x JOIN p y ON x.slice = y.slice AND x.method < y.method),
r AS (SELECT a, b, d > 0 AS up, CAST(2 * rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + count(*) OVER (PARTITION BY a, b, abs(d)) - 1 AS BIGINT) AS t, row_number() OVER (PARTITION BY a, b ORDER BY abs(d), d) AS k FROM d WHERE d <> 0),
w AS (SELECT a, b, count(*) AS n, sum(CASE WHEN up THEN t ELSE 0 END) AS plus, sum(t) AS every FROM r GROUP BY 1, 2),
chance AS (SELECT a, b, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS s, 1.0::DOUBLE AS c FROM w
  UNION ALL SELECT h.a, h.b, h.k + 1, h.s + CASE WHEN coin = 1 THEN r.t ELSE 0 END, sum(h.c) / 2 FROM chance h JOIN r ON r.a = h.a AND r.b = h.b AND r.k = h.k + 1, (VALUES (0), (1)) AS v(coin) GROUP BY h.a, h.b, h.k, h.s + CASE WHEN coin = 1 THEN r.t ELSE 0 END)
SELECT w.a, w.b, CAST(any_value(n) AS BIGINT) AS n, any_value(plus) / 2.0::DOUBLE AS w_plus, any_value(every - plus) / 2.0::DOUBLE AS w_minus,
  round(least(1.0, 2 * least(sum(CASE WHEN s <= plus THEN c ELSE 0 END), sum(CASE WHEN s >= plus THEN c ELSE 0 END))), 6) + 0.0 AS p
FROM w JOIN chance h ON h.a = w.a AND h.b = w.b AND h.k = w.n GROUP BY w.a, w.b""")
def ag18_signed_ranks(s, d):
    per = X.runs(s, d).groupBy("method", "slice").agg(F.avg("ARI").alias("v"))
    other = per.select(F.col("method").alias("b"), "slice", F.col("v").alias("w"))
    pairs = per.withColumnRenamed("method", "a").join(other, "slice").where("a < b").select("a", "b", F.round(F.col("v") - F.col("w"), 9).alias("d"))
    out = metrics.signed_ranks(pairs, "d", "a", "b")
    return out.select("a", "b", "n", "w_plus", "w_minus", V.r6("p").alias("p"))


@query("SELECT CAST(event_id AS BIGINT) AS event_id, event_type AS name, json_extract_string(props, '$.k') AS k, event_type || '=' || props AS line FROM events")
def or4_config_json(s, d):
    events = X.table(s, d, "events")
    lines = events.select(_long("event_id"), F.concat_ws("=", "event_type", "props").alias("line"))
    found = experiment.parse_variants(lines, keep=("event_id", "line"))
    return found.select("event_id", "name", F.col("options")["k"].alias("k"), "line")


@query("SELECT CAST(event_id AS BIGINT) AS event_id, event_type AS name, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '' WHEN event_id % 3 = 0 THEN 'k,odd' ELSE 'k' END AS unknown FROM events")
def set6_unknown_options(s, d):
    """Options of each event's line; of every third, one more that no method takes, beside one that methods take."""
    more = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r"\}$", ', "odd": 1, "fusion": true}')).otherwise(F.col("props"))
    lines = X.table(s, d, "events").select(_long("event_id"), F.concat_ws("=", "event_type", more).alias("line"))
    found = experiment.unknown_options(experiment.parse_variants(lines, keep=("event_id",)), keep=("event_id",))
    return found.select("event_id", "name", F.array_join("unknown", ",").alias("unknown"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS spot_id, CAST(o_custkey AS BIGINT) AS customer, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def jn9_strict_lookup(s, d):
    orders = X.table(s, d, "orders").select(_long("o_orderkey", "spot_id"), _long("o_custkey", "customer"))
    names = X.table(s, d, "customer").select(_long("c_custkey", "customer"), F.col("c_name").alias("name"))
    return tables.strict_lookup(orders, names, "customer").select("spot_id", "customer", "name")


@query(f"WITH {X.SPOTS} SELECT CAST(i AS BIGINT) AS spot_id, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) + 0.0 AS elu, round(greatest(x, 0), 6) + 0.0 AS relu FROM spots")
def sc8_activations(s, d):
    return X.spots(s, d).select(_long("spot_id"), V.r6(V.elu("x")).alias("elu"), V.r6(V.relu("x")).alias("relu"))


_FOUR = ", ".join(f"list_inner_product(feat[{1 + 16 * k}:{16 * k + 16}], feat[{1 + 16 * k}:{16 * k + 16}]) AS l{k}" for k in range(4))


@query(f"""WITH {X.SPOTS}, l AS (SELECT i, x, y, {_FOUR} FROM spots)
SELECT CAST(i AS BIGINT) AS spot_id, round(exp(-x) * l0 + x + exp(-y) * l1 + y + exp(-x) * l2 + x + exp(-y) * l3 + y, 6) + 0.0 AS kendall,
  round(l0 / greatest(l1, 0.001) + l1 / greatest(l2, 0.001) + l2 / greatest(l3, 0.001) + l3 / greatest(l0, 0.001), 6) + 0.0 AS init, round(10 * l0 + 0.3 * l1 + 1 * l2 + 0.1 * l3, 6) + 0.0 AS manual FROM l""")
def ls9_balanced(s, d):
    """The total of four losses (the squares of each spot's features, by sixteens) in each mode of balance."""
    each = {k: V.dot(F.slice("feat", 1 + 16 * n, 16), F.slice("feat", 1 + 16 * n, 16)) for n, k in enumerate(hierarchical.LOSSES)}
    names = list(each)
    rows = X.spots(s, d).select("spot_id", "x", "y", *[v.alias(k) for k, v in each.items()])
    held = {k: F.col(k) for k in names}
    spread = {k: F.col("xy"[n % 2]) for n, k in enumerate(names)}
    first = {k: F.col(names[(n + 1) % 4]) for n, k in enumerate(names)}
    modes = {"kendall": losses.balanced(held, "kendall", log_vars=spread), "init": losses.balanced(held, "init", first=first), "manual": losses.balanced(held, "manual")}
    return rows.select(_long("spot_id"), *[V.r6(v).alias(k) for k, v in modes.items()])


@query(f"WITH {X.SPOTS}, w AS (SELECT i, exp(x) / (exp(x) + exp(y)) AS a, exp(y) / (exp(x) + exp(y)) AS b FROM spots) SELECT CAST(i AS BIGINT) AS spot_id, round(a * (ln(a) - ln(0.7::DOUBLE)) + b * (ln(b) - ln(0.3::DOUBLE)), 6) + 0.0 AS kl FROM w")
def ls11_hop_prior(s, d):
    weights = V.softmax(F.array("x", "y"))
    return X.spots(s, d).select(_long("spot_id"), V.r6(losses.hop_prior_kl(weights, [0.7, 0.3])).alias("kl"))


# --- fitted operators: tests hold them against NumPy


def _document_pcs(s, d, k=20, n_top=300):
    return preprocess.preprocess(X.counts(s, d), X.document_spots(s, d), n_top, k)


@query()
def st2_variable_genes(s, d):
    return preprocess.variable_genes(shared.written(_kept(s, d)), _n_spots(s, d), 300)  # gone through twice


@query()
def st5_pca(s, d):
    return _document_pcs(s, d)


@query()
def tr5_kmeans(s, d):
    feats = shared.written(_document_pcs(s, d))
    centres, cost = mixture.kmeans(feats, 4)
    return s.createDataFrame([(k, c.tolist(), cost) for k, c in enumerate(centres)], "k int, centre array<double>, cost double")


@query()
def cl1_tied_gmm(s, d):
    feats = shared.written(_document_pcs(s, d))
    return mixture.cluster(feats, 4, n_pcs=10)


@query()
def tr2_adaptive_vae(s, d):
    """The two-level model over all spots, a few epochs: the embedding and the shares of hops and levels."""
    config = hierarchical.Config(hid=16, f0=8, z=4, out=4, epochs=2, rate=0.01)
    model = hierarchical.Model(X.spots(s, d), config).fit()
    return model.embed().join(model.attention(), "spot_id")


@query()
def tr4_baseline_vae(s, d):
    """Both phases of the baseline over all spots, a few epochs each."""
    config = baseline.Config(n_clusters=4, hidden1=16, hidden2=8, graph1=8, graph2=4, first_epochs=2, second_epochs=1)
    return baseline.Model(X.spots(s, d), config).fit().embed()
