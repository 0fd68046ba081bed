"""Queries of the market operators. Panels: 25 brands and 5 segments by month, daily event bars;
windows: the correlation windows of h0_features and graph_metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import streaming as S
from .. import engine as E
from ..engine import StressConfig
from ..functions import rules as R
from ..operators import matrix as M
from ..operators import strategy as X
from ..operators import topology as T
from ..session import cut, finite, new_path, table
from ..sources import panels as P

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, others: str = "", doubles: str = ""):
    """Register a query; its doubles are rounded to six decimals on both sides."""

    def register(f):
        names = doubles.split()

        def run(spark: SparkSession, d: str) -> DataFrame:
            df = f(spark, d)
            return df.select(*others.split(), *((F.round(F.col(k), 6) + F.lit(0.0)).alias(k) for k in names)) if sql else df

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            with_part, _, body = sql.rpartition("||")
            cols = ", ".join([*others.split(), *(f"round({k}, 6) + 0.0 AS {k}" for k in names)])
            SQL[f.__name__] = f"{with_part} SELECT {cols} FROM ({body})"
        return run

    return register


def _panel_sql(p: str, prices: str) -> str:
    return f"""{p}p AS MATERIALIZED ({prices}),
    {p}t AS (SELECT t, (row_number() OVER (ORDER BY t) - 1)::BIGINT AS seq FROM (SELECT DISTINCT t FROM {p}p)),
    {p}m AS (SELECT a.asset, {p}t.t, seq, last_value(price IGNORE NULLS) OVER (PARTITION BY a.asset ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM (SELECT DISTINCT asset FROM {p}p) a CROSS JOIN {p}t LEFT JOIN {p}p ON {p}p.asset = a.asset AND {p}p.t = {p}t.t),
    {p}r AS MATERIALIZED (SELECT *, price / lag(price) OVER (PARTITION BY asset ORDER BY seq) - 1 AS ret FROM {p}m),
    {p}pair AS (SELECT a.seq, a.asset AS i, b.asset AS j, a.ret AS x, b.ret AS y FROM {p}r a JOIN {p}r b ON a.seq = b.seq AND a.asset < b.asset WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
    {p}c AS MATERIALIZED (SELECT seq AS window_id, i, j, CASE WHEN NOT isnan(c) THEN c END AS c FROM (SELECT seq, i, j, corr(x, y) OVER w AS c, count(*) OVER w AS n FROM {p}pair WINDOW w AS (PARTITION BY i, j ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n = 20)"""


B = "WITH RECURSIVE " + _panel_sql("b", "SELECT p_brand AS asset, date_trunc('month', l_shipdate)::DATE AS t, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
G = "WITH RECURSIVE " + _panel_sql("s", "SELECT c_mktsegment AS asset, date_trunc('month', o_orderdate)::DATE AS t, avg(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
BARS = "WITH e AS (SELECT event_type AS asset, ts::DATE AS t, value, ts, event_id FROM events), bars AS (SELECT asset, t, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::BIGINT AS volume, (row_number() OVER (PARTITION BY asset ORDER BY t) - 1)::BIGINT AS seq FROM e GROUP BY 1, 2)"
EDGES = B + ", nodes AS (SELECT DISTINCT window_id, unnest([i, j]) AS node FROM bc), e AS MATERIALIZED (SELECT window_id, i, j, abs(c) AS w FROM bc WHERE round(abs(c), 9) >= 0.3), e2 AS (SELECT window_id, i AS a, j AS b, w FROM e UNION ALL SELECT window_id, j, i, w FROM e), deg AS (SELECT n.window_id, n.node, coalesce(sum(w), 0) AS deg, count(w)::BIGINT AS k FROM nodes n LEFT JOIN e2 ON e2.window_id = n.window_id AND a = node GROUP BY 1, 2)"
REACH = EDGES + ", reach AS (SELECT window_id, node, node AS c FROM nodes UNION SELECT r.window_id, e2.b, r.c FROM reach r JOIN e2 ON e2.window_id = r.window_id AND e2.a = r.node), comp AS (SELECT window_id, node, min(c) AS component FROM reach GROUP BY 1, 2)"
TRI = REACH + ", tri AS (SELECT x.window_id, unnest([x.i, x.j, y.j]) AS node FROM e x JOIN e y ON y.window_id = x.window_id AND y.i = x.j JOIN e z ON z.window_id = x.window_id AND z.i = x.i AND z.j = y.j), loc AS (SELECT d.window_id, d.node, k, (SELECT count(*) FROM tri WHERE tri.window_id = d.window_id AND tri.node = d.node) AS tri FROM deg d), gm AS (SELECT l.window_id, count(*)::BIGINT AS n_nodes, (sum(k) / 2)::BIGINT AS n_edges, sum(k) / (count(*) * (count(*) - 1)) AS density, avg(CASE WHEN k > 1 THEN 2.0 * tri / (k * (k - 1)) ELSE 0 END) AS avg_clustering, avg(k) / (count(*) - 1) AS avg_degree_centrality, any_value(nc)::BIGINT AS n_components FROM loc l JOIN (SELECT window_id, count(DISTINCT component) AS nc FROM comp GROUP BY 1) q ON q.window_id = l.window_id GROUP BY 1)"
H0 = B + ", d AS MATERIALIZED (SELECT window_id, i, j, 1 - abs(c) AS d, row_number() OVER (PARTITION BY window_id ORDER BY round(1 - abs(c), 9), i, j) AS m FROM bc WHERE c IS NOT NULL), m0 AS MATERIALIZED (SELECT window_id, i, j, m FROM d UNION ALL SELECT window_id, j, i, m FROM d)" + "".join(
    f", m{k} AS MATERIALIZED (SELECT window_id, i, j, min(m) AS m FROM (SELECT * FROM m{k - 1} UNION ALL SELECT a.window_id, a.i, b.j, greatest(a.m, b.m) FROM m{k - 1} a JOIN m{k - 1} b ON a.window_id = b.window_id AND a.j = b.i WHERE a.i <> b.j) GROUP BY 1, 2, 3)" for k in range(1, 6)
) + ", h0 AS MATERIALIZED (SELECT d.window_id, 0.0::DOUBLE AS birth, d AS death FROM d JOIN m5 ON m5.window_id = d.window_id AND m5.i = d.i AND m5.j = d.j AND m5.m = d.m), ft AS (SELECT window_id, count(*)::BIGINT AS n, max(death) AS max_persistence, avg(death) AS mean_persistence, stddev_pop(death) AS std_persistence, sum(death) AS total_persistence, ln(sum(death)) - sum(CASE WHEN death > 0 THEN death * ln(death) ELSE 0 END) / sum(death) AS persistence_entropy FROM h0 GROUP BY 1)"
_FIN = lambda c: f"max(CASE WHEN isfinite({c}) THEN {c} END)"
WIN = f"WITH hh AS (SELECT window_id, max(num_components) AS n0, {_FIN('max_persistence')} AS max0, {_FIN('mean_persistence')} AS mean0, {_FIN('total_persistence')} AS total0 FROM h0_features WHERE window_id IS NOT NULL GROUP BY 1), gg AS (SELECT window_id, max(n_nodes) AS nn, max(n_edges) AS ne, max(n_components) AS nc, {_FIN('density')} AS density, {_FIN('avg_clustering')} AS clustering, {_FIN('spectral_gap')} AS gap FROM graph_metrics WHERE window_id IS NOT NULL GROUP BY 1), ws AS (SELECT window_id, n0, max0, mean0, total0, greatest(ne - nn + nc, 0) AS n1, gap / 4 AS max1, density AS p, nc, density, clustering FROM hh JOIN gg USING (window_id) WHERE max0 > 0 AND mean0 > 0 AND mean0 <= max0 AND gap BETWEEN 0 AND 2 AND density BETWEEN 0 AND 1 AND clustering BETWEEN 0 AND 1 AND total0 > 0 AND n0 IS NOT NULL AND nn IS NOT NULL AND ne IS NOT NULL AND nc IS NOT NULL)"
_HALF = lambda c: f"(CASE WHEN {c} THEN 0.5 ELSE 0 END)"
RULE = WIN + f", sc AS (SELECT *, {_HALF('n0 <= 2')} + {_HALF('max1 < 0.05')} AS s, {_HALF('n0 > 2 AND n0 < 4')} + {_HALF('max1 > 0.05 AND max1 < 0.2')} AS tr, {_HALF('n0 >= 4')} + {_HALF('max1 > 0.2')} AS st FROM ws), rr AS (SELECT *, CASE WHEN s >= tr AND s >= st THEN 'stable' WHEN tr >= st THEN 'transitioning' ELSE 'stressed' END AS regime, CASE WHEN s + tr + st > 0 THEN greatest(s, tr, st) / (s + tr + st) ELSE 1.0 / 3 END AS confidence, least(greatest(0.4 * (CASE WHEN n0 > 0 THEN 0.5 / (1 + n0) ELSE 0 END + 0.5 * least(max0, 1)) + 0.6 * greatest(0, 1 - abs(max1 - 0.2) / 0.2), 0), 1) AS stability FROM sc), er AS (SELECT *, (n0 > 3 OR max0 > 0.3) AS apart, (n1 > 0 AND max1 > 0.2) AS cycles, least(greatest(max0, max1) / 2, 1) AS score, least(0.4 * (1 - density) + CASE WHEN nc > 1 THEN 0.3 * least(nc / 5.0, 1) ELSE 0 END + 0.3 * (1 - clustering), 1) AS leak FROM rr), eng AS (SELECT *, CASE WHEN apart AND cycles THEN 'Stressed' WHEN cycles THEN 'Trending' WHEN apart THEN 'Fragmented' ELSE 'Stable' END AS state, CASE WHEN cycles THEN least(max1 / 0.2, 1) WHEN apart THEN least(max0 / 0.3, 1) ELSE 1 END AS state_confidence FROM er)"


def brand_returns(spark, d) -> DataFrame:
    return P.with_returns(P.brand_month(spark, d))


def segment_returns(spark, d) -> DataFrame:
    return P.with_returns(P.segment_month(spark, d))


def brand_corr(spark, d) -> DataFrame:
    return cut(M.rolling_correlation(brand_returns(spark, d)))


def segment_corr(spark, d) -> DataFrame:
    return cut(M.rolling_correlation(segment_returns(spark, d)))


def abs_distances(corr: DataFrame) -> DataFrame:
    return corr.select("window_id", "i", "j", R.abs_distance("c").alias("d"))


def brand_h0(spark, d) -> DataFrame:
    return cut(T.diagrams(abs_distances(brand_corr(spark, d)), top_dim=0))


def brand_h1(spark, d) -> DataFrame:
    return cut(T.diagrams(abs_distances(brand_corr(spark, d)), top_dim=1))


def window_states(spark, d) -> DataFrame:
    """Sound correlation windows: components, loops (independent cycles of the graph), persistences, graph metrics."""
    fin = lambda c, a: F.max(finite(c)).alias(a)
    h = table(spark, d, "h0_features").where("window_id is not null").groupBy("window_id").agg(F.max("num_components").alias("n0"), fin("max_persistence", "max0"), fin("mean_persistence", "mean0"), fin("total_persistence", "total0"))
    g = table(spark, d, "graph_metrics").where("window_id is not null").groupBy("window_id").agg(F.max("n_nodes").alias("nn"), F.max("n_edges").alias("ne"), F.max("n_components").alias("nc"), fin("density", "density"), fin("avg_clustering", "clustering"), fin("spectral_gap", "gap"))
    j = h.join(g, "window_id").where("max0 > 0 and mean0 > 0 and mean0 <= max0 and gap between 0 and 2 and density between 0 and 1 and clustering between 0 and 1 and total0 > 0 and n0 is not null and nn is not null and ne is not null and nc is not null")
    return j.select("window_id", "n0", "max0", "mean0", "total0", F.greatest(F.col("ne") - F.col("nn") + F.col("nc"), F.lit(0)).alias("n1"), (F.col("gap") / 4).alias("max1"), F.col("density").alias("p"), "nc", "density", "clustering")


def rule_states(spark, d) -> DataFrame:
    w = window_states(spark, d)
    return w.withColumns(R.rule_regime("n0", "max1") | {"stability": R.stability_score("n0", "max0", "n1", "max1")})


def engine_states(spark, d) -> DataFrame:
    w = rule_states(spark, d)
    e = R.engine_regime("n0", "max0", "n1", "max1")
    score = R.instability_score({"max": "max0"}, {"max": "max1"})
    return w.withColumns({"state": e["regime"], "state_confidence": e["confidence"], "score": score, "leak": R.leakage_score("density", "nc", "clustering")})


# ---------------------------------------------------------------- panels and correlation


@query(B + "|| SELECT * FROM bm", "asset seq", "price")
def panel_scaffold(spark, d):
    return P.brand_month(spark, d)


@query(B + "|| SELECT * FROM br WHERE ret IS NOT NULL", "asset seq", "price ret")
def panel_returns(spark, d):
    return brand_returns(spark, d).where("ret is not null")


@query(G + "|| SELECT * FROM sr WHERE ret IS NOT NULL AND seq > (SELECT max(seq) FROM sr) - 40", "asset seq", "ret")
def panel_lookback(spark, d):
    """The last 40 periods."""
    return P.last_periods(segment_returns(spark, d), 40).where("ret is not null")


@query(BARS + "|| SELECT * FROM bars", "asset seq volume", "open high low close")
def event_ohlcv_bars(spark, d):
    return P.event_bars(table(spark, d, "events"))


@query(B + "|| SELECT * FROM bc", "window_id i j", "c")
def rolling_corr(spark, d):
    return M.rolling_correlation(brand_returns(spark, d))


@query(B + "|| SELECT a.asset AS i, b.asset AS j, corr(a.ret, b.ret) AS c FROM br a JOIN br b ON a.seq = b.seq AND a.asset <= b.asset WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2", "i j", "c")
def corr_matrix_full(spark, d):
    return M.correlation_matrix(brand_returns(spark, d))


@query(BARS + ", u AS (UNPIVOT (SELECT asset AS entity, seq, open AS Open, high AS High, low AS Low, close AS Close, volume::DOUBLE AS Volume FROM bars) ON Open, High, Low, Close, Volume INTO NAME field VALUE price), r AS (SELECT entity, field, seq, price / lag(price) OVER (PARTITION BY entity, field ORDER BY seq) - 1 AS ret FROM u) || SELECT a.entity AS asset, a.field AS i, b.field AS j, corr(a.ret, b.ret) AS c FROM r a JOIN r b ON a.entity = b.entity AND a.seq = b.seq AND a.field <= b.field WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2, 3", "asset i j", "c")
def corr_of_fields(spark, d):
    """Every asset's five bar fields as assets of a market of their own."""
    f = P.fields_as_assets(P.event_bars(table(spark, d, "events")))
    r = f.withColumn("ret", F.try_divide("price", F.lag("price").over(W.partitionBy("entity", "asset").orderBy("seq"))) - 1).where("ret is not null")
    a, b = (r.select("entity", "seq", F.col("asset").alias(k), F.col("ret").alias(x)) for k, x in (("i", "x"), ("j", "y")))
    sd = F.stddev_pop("x") * F.stddev_pop("y")
    return a.join(b, ["entity", "seq"]).where("i <= j").groupBy(F.col("entity").alias("asset"), "i", "j").agg(F.try_divide(F.covar_pop("x", "y"), F.when(sd > 0, sd)).alias("c"))


@query(B + "|| SELECT window_id, i, j, 1 - abs(c) AS d FROM bc", "window_id i j", "d")
def corr_distance_abs(spark, d):
    return abs_distances(M.rolling_correlation(brand_returns(spark, d)))


@query(B + "|| SELECT window_id, i, j, sqrt(2 * least(greatest(1 - c, 0), 2)) AS d FROM bc", "window_id i j", "d")
def corr_distance_signed(spark, d):
    return M.rolling_correlation(brand_returns(spark, d)).select("window_id", "i", "j", R.signed_distance("c").alias("d"))


@query(B + ", mid AS (SELECT max(seq) / 2 AS mid FROM br), pr AS (SELECT seq, i, j, x, y FROM bpair), h AS (SELECT i, j, corr(x, y) FILTER (WHERE seq <= mid) AS c0, corr(x, y) FILTER (WHERE seq > mid) AS c1 FROM pr, mid GROUP BY 1, 2) || SELECT max(abs(c0 - c1)) AS max_diff, avg(abs(c0 - c1)) AS mean_diff, max(abs(c0 - c1)) <= 0.15 AS is_valid FROM h", "is_valid", "max_diff mean_diff")
def corr_preservation(spark, d):
    """The panel's two halves as the two samples."""
    r = brand_returns(spark, d)
    r = r.crossJoin(F.broadcast(r.agg((F.max("seq") / 2).alias("mid"))))  # one row
    return X.correlation_preservation(M.correlation_matrix(r.where("seq <= mid")), M.correlation_matrix(r.where("seq > mid")))


# ---------------------------------------------------------------- graph and diffusion


@query(EDGES + "|| SELECT * FROM e", "window_id i j", "w")
def graph_edges(spark, d):
    return M.threshold_edges(M.rolling_correlation(brand_returns(spark, d)))


def _brand_graph(spark, d):
    c = brand_corr(spark, d)
    return cut(M.threshold_edges(c)), cut(M.nodes_of(c))


@query(EDGES + "|| SELECT window_id, node AS i, node AS j, deg AS value FROM deg UNION ALL SELECT window_id, a, b, -w FROM e2", "window_id i j", "value")
def laplacian_combinatorial(spark, d):
    return M.laplacian(*_brand_graph(spark, d))


@query(EDGES + "|| SELECT window_id, node AS i, node AS j, CASE WHEN deg > 0 THEN 1.0 ELSE 0.0 END AS value FROM deg UNION ALL SELECT e2.window_id, a, b, -w / sqrt(x.deg * y.deg) FROM e2 JOIN deg x ON x.window_id = e2.window_id AND x.node = a JOIN deg y ON y.window_id = e2.window_id AND y.node = b", "window_id i j", "value")
def laplacian_normalized(spark, d):
    return M.laplacian(*_brand_graph(spark, d), normalized=True)


@query(REACH + "|| SELECT * FROM comp", "window_id node component")
def graph_components(spark, d):
    return M.components(*_brand_graph(spark, d))


def _metrics(spark, d):
    e, n = _brand_graph(spark, d)
    return M.graph_metrics(e, n, M.components(e, n))


@query(TRI + "|| SELECT * FROM gm", "window_id n_nodes n_edges n_components", "density avg_clustering avg_degree_centrality")
def graph_metrics(spark, d):
    return _metrics(spark, d)


@query(TRI + "|| SELECT window_id, least(0.4 * (1 - density) + CASE WHEN n_components > 1 THEN 0.3 * least(n_components / 5.0, 1) ELSE 0 END + 0.3 * (1 - avg_clustering), 1) AS leakage FROM gm", "window_id", "leakage")
def leakage_score(spark, d):
    return _metrics(spark, d).select("window_id", R.leakage_score("density", "n_components", "avg_clustering").alias("leakage"))


@query()
def graph_spectrum(spark, d):
    return M.spectral_summary(M.laplacian(*_brand_graph(spark, d), normalized=True))


@query(EDGES + ", l AS (SELECT window_id, node AS i, node AS j, CASE WHEN deg > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM deg UNION ALL SELECT e2.window_id, a, b, -w / sqrt(x.deg * y.deg) FROM e2 JOIN deg x ON x.window_id = e2.window_id AND x.node = a JOIN deg y ON y.window_id = e2.window_id AND y.node = b) || SELECT window_id, (SELECT count(*) FROM nodes n WHERE n.window_id = l.window_id) AS eigenvalues, sum(CASE WHEN i = j THEN v ELSE 0 END) AS total, sum(v * v) AS squares, 0.0 AS least FROM l GROUP BY 1", "window_id eigenvalues", "total squares least")
def graph_spectrum_sums(spark, d):
    """The eigenvalues' number, sum, sum of squares and least, which the matrix gives without them."""
    s = M.spectrum(M.laplacian(*_brand_graph(spark, d), normalized=True))
    return s.groupBy("window_id").agg(F.count(F.lit(1)).alias("eigenvalues"), F.sum("eigenvalue").alias("total"), F.sum(F.col("eigenvalue") * F.col("eigenvalue")).alias("squares"), F.min("eigenvalue").alias("least"))


def _walk_sql() -> str:
    steps = "".join(f", w{s} AS MATERIALIZED (SELECT n.window_id, n.node, coalesce(sum(x.x * e2.w / o.o), 0) AS x FROM nodes n LEFT JOIN e2 ON e2.window_id = n.window_id AND e2.b = n.node LEFT JOIN o ON o.window_id = e2.window_id AND o.a = e2.a LEFT JOIN w{s - 1} x ON x.window_id = e2.window_id AND x.node = e2.a GROUP BY 1, 2)" for s in range(1, 11))
    return EDGES + ", o AS (SELECT window_id, a, sum(w) AS o FROM e2 GROUP BY 1, 2), w0 AS (SELECT window_id, node, 1.0 / count(*) OVER (PARTITION BY window_id) AS x FROM nodes)" + steps


@query(_walk_sql() + "|| SELECT window_id, node, 10 AS step, x FROM w10", "window_id node step", "x")
def random_walk_10(spark, d):
    return M.random_walk(*_brand_graph(spark, d))


@query(_walk_sql() + "|| " + " UNION ALL ".join(f"SELECT window_id, node, {s} AS step, x FROM w{s}" for s in range(11)), "window_id node step", "x")
def random_walk_trajectory(spark, d):
    return M.random_walk(*_brand_graph(spark, d), trajectory=True)


def _segment_heat(spark, d):
    c = segment_corr(spark, d)
    nodes = cut(M.nodes_of(c))
    lap = cut(M.laplacian(c.select("window_id", "i", "j", F.abs("c").alias("w")), nodes))
    start = nodes.withColumn("x", (F.col("node") == F.min("node").over(W.partitionBy("window_id"))).cast("double"))
    return lap, nodes, cut(start)


def _heat_sql() -> str:
    base = G + ", nodes AS MATERIALIZED (SELECT DISTINCT window_id, unnest([i, j]) AS node FROM sc), e2 AS (SELECT window_id, i AS a, j AS b, abs(c) AS w FROM sc UNION ALL SELECT window_id, j, i, abs(c) FROM sc), lap AS MATERIALIZED (SELECT window_id, a AS i, b AS j, -w AS v FROM e2 UNION ALL SELECT window_id, a, a, sum(w) FROM e2 GROUP BY 1, 2), t0 AS MATERIALIZED (SELECT window_id, node, CASE WHEN node = min(node) OVER (PARTITION BY window_id) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM nodes)"
    for k in range(1, 41):
        base += f", t{k} AS MATERIALIZED (SELECT l.window_id, l.i AS node, sum(l.v * t.x) * {-1.0 / k!r} AS x FROM lap l JOIN t{k - 1} t ON t.window_id = l.window_id AND t.node = l.j GROUP BY 1, 2)"
    return base + ", heat AS (SELECT window_id, node, sum(x) AS x FROM (" + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(41)) + ") GROUP BY 1, 2)"


@query(_heat_sql() + "|| SELECT * FROM heat", "window_id node", "x")
def heat_diffusion_taylor(spark, d):
    lap, _, start = _segment_heat(spark, d)
    return M.heat_taylor(lap, start)


@query(_heat_sql() + "|| SELECT heat.window_id, heat.node, heat.x - t0.x AS change, CASE WHEN round(heat.x - t0.x, 9) > 0.1 THEN 'sink' WHEN round(heat.x - t0.x, 9) < -0.1 THEN 'source' ELSE 'neutral' END AS kind FROM heat JOIN t0 ON t0.window_id = heat.window_id AND t0.node = heat.node", "window_id node kind", "change")
def sinks_sources(spark, d):
    lap, nodes, start = _segment_heat(spark, d)
    return M.sinks_and_sources(start, M.heat_diffusion(lap, nodes, start))


@query()
def heat_kernel(spark, d):
    return M.heat_kernel(M.laplacian(*_brand_graph(spark, d)))


@query(EDGES + "|| SELECT window_id, node, 1.0::DOUBLE AS mass FROM nodes", "window_id node", "mass")
def heat_kernel_mass(spark, d):
    """Heat is neither lost nor made: every row of a kernel sums to 1."""
    return heat_kernel(spark, d).groupBy("window_id", F.col("i").alias("node")).agg(F.sum("value").alias("mass"))


# ---------------------------------------------------------------- topology


@query(H0 + "|| SELECT * FROM h0", "window_id", "birth death")
def h0_diagram(spark, d):
    return T.finite_bars(brand_h0(spark, d), 0)


@query(H0 + "|| SELECT death - birth AS length, death, window_id FROM h0", "window_id", "death length")
def barcode_h0(spark, d):
    return T.finite_bars(brand_h0(spark, d), 0).withColumn("length", F.col("death") - F.col("birth"))


def _features(spark, d, dim=0):
    g = brand_h0(spark, d) if dim == 0 else brand_h1(spark, d)
    return T.diagram_features(g, dim, g)


@query(H0 + "|| SELECT * FROM ft", "window_id n", "max_persistence mean_persistence std_persistence persistence_entropy")
def h0_features(spark, d):
    return _features(spark, d)


@query(H0.replace("1 - abs(c)", "sqrt(2 * least(greatest(1 - c, 0), 2))") + "|| SELECT * FROM ft", "window_id n", "max_persistence mean_persistence std_persistence total_persistence")
def h0_features_root(spark, d):
    """On signed distances, no edge longer than 2."""
    c = brand_corr(spark, d).select("window_id", "i", "j", R.signed_distance("c").alias("d"))
    g = cut(T.diagrams(c, top_dim=0, longest=2.0))
    return T.diagram_features(g, 0, g)


@query(H0 + "|| SELECT window_id, persistence_entropy FROM ft", "window_id", "persistence_entropy")
def persistence_entropy(spark, d):
    return _features(spark, d)


@query()
def h1_diagram(spark, d):
    return brand_h1(spark, d).where("dim = 1")


@query()
def h1_features(spark, d):
    return _features(spark, d, 1)


@query(H0 + ", sp AS (SELECT window_id, min(birth) AS a, max(death) AS z FROM h0 GROUP BY 1), gr AS (SELECT window_id, x_idx::INT AS x_idx, a + x_idx * (z - a) / 99.0 AS x FROM sp, range(100) t(x_idx)), te AS (SELECT g.window_id, x_idx, least(x - birth, death - x) AS v, row_number() OVER (PARTITION BY g.window_id, x_idx ORDER BY least(x - birth, death - x) DESC) AS k FROM gr g JOIN h0 ON h0.window_id = g.window_id AND x >= birth AND x <= death) || SELECT g.window_id, kk::INT AS k, g.x_idx, coalesce(v, 0) AS value FROM gr g CROSS JOIN range(1, 6) q(kk) LEFT JOIN te ON te.window_id = g.window_id AND te.x_idx = g.x_idx AND te.k = kk", "window_id k x_idx", "value")
def persistence_landscape(spark, d):
    return T.landscape(brand_h0(spark, d), 0)


@query(H0 + ", sp AS (SELECT window_id, min(birth) AS x0, max(birth) AS x1, min(death - birth) AS y0, max(death - birth) AS y1 FROM h0 GROUP BY 1), gr AS (SELECT window_id, r::INT AS row, c::INT AS col, x0 - 0.1 * (x1 - x0) + c * 1.2 * (x1 - x0) / 19.0 AS x, y0 + r * (y1 - y0 + CASE WHEN y1 > y0 THEN 0.1 * (y1 - y0) ELSE 0.1 END) / 19.0 AS y FROM sp, range(20) a(r), range(20) b(c)) || SELECT g.window_id, row, col, sum((death - birth) * exp(-((x - birth) * (x - birth) + (y - death + birth) * (y - death + birth)) / 0.02)) AS value FROM gr g JOIN h0 ON h0.window_id = g.window_id GROUP BY 1, 2, 3", "window_id row col", "value")
def persistence_image(spark, d):
    return T.image(brand_h0(spark, d), 0)


@query()
def vectorize_statistics(spark, d):
    g = brand_h1(spark, d)
    return T.vectorize(g, g)


@query()
def embedding_cloud_h1(spark, d):
    """Loops among every label's vectors, by cosine distance, in clouds of about 24 by hash: all vectors, no pairs beyond a cloud."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding").where("label is not null and embedding is not null")
    clouds = e.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / 24).alias("clouds"))  # a row per label
    e = e.join(clouds, "label").withColumn("label", F.col("label").cast("bigint") * 1_000_000 + F.pmod(F.xxhash64("vec_id"), "clouds"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    e = e.withColumn("len", F.sqrt(dot("embedding", "embedding")))
    a, b = (e.select("label", F.format_string("%09d", "vec_id").alias(k), F.col("embedding").alias(f"e{k}"), F.col("len").alias(f"l{k}")) for k in "ij")
    pairs = a.join(b, "label").where("i < j").select(F.col("label").cast("bigint").alias("window_id"), "i", "j", (1 - F.try_divide(dot("ei", "ej"), F.col("li") * F.col("lj"))).alias("d"))
    return T.diagrams(pairs, top_dim=1).where("dim = 1")


@query(H0 + ", q AS (SELECT window_id, least(max_persistence / 2, 1) AS score FROM ft), w AS (SELECT *, avg(score) OVER v AS m, stddev_pop(score) OVER v AS s, count(*) OVER v AS baseline_count FROM q WINDOW v AS (ORDER BY window_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) || SELECT window_id, baseline_count::BIGINT AS baseline_count, baseline_count >= 5 AS adaptive, CASE WHEN baseline_count >= 5 THEN m + 2 * s ELSE 0.5 END AS threshold, CASE WHEN baseline_count >= 5 AND s > 1e-12 THEN (score - m) / s ELSE 0 END AS z_score, round(score - CASE WHEN baseline_count >= 5 THEN m + 2 * s ELSE 0.5 END, 9) > 0 AS is_anomaly FROM w", "window_id baseline_count adaptive is_anomaly", "threshold z_score")
def adaptive_threshold(spark, d):
    f = _features(spark, d).select(F.col("window_id"), F.col("window_id").alias("seq"), F.least(F.col("max_persistence") / 2, F.lit(1.0)).alias("score"), F.lit("brands").alias("universe"))
    return T.adaptive_threshold(f, ["universe"])


# ---------------------------------------------------------------- regimes, risk and gating over the windows


@query(RULE + "|| SELECT * FROM rr", "window_id regime", "confidence")
def regime_rule_based(spark, d):
    return rule_states(spark, d)


@query(WIN + "|| SELECT window_id, CASE WHEN n0 >= 3 AND n1 > 0 AND max1 >= 0.1 THEN 'Fragmented with feedback loops' WHEN n0 >= 3 THEN 'Fragmented (multiple clusters)' WHEN n1 > 0 AND max1 >= 0.1 THEN 'Connected with feedback loops' ELSE 'Unified (single connected market)' END AS regime FROM ws", "window_id regime")
def regime_descriptive(spark, d):
    return window_states(spark, d).withColumn("regime", R.described_regime("n0", "n1", "max1"))


@query(RULE + "|| SELECT window_id, state, state_confidence FROM eng", "window_id state", "state_confidence")
def regime_engine(spark, d):
    return engine_states(spark, d)


@query(WIN + "|| SELECT window_id, least(greatest(max0, max1) / 2, 1) AS by_max, least((mean0 + max1) / 2 / 2, 1) AS by_mean, least((total0 + max1) / 2 / 2, 1) AS by_total FROM ws", "window_id", "by_max by_mean by_total")
def instability_score(spark, d):
    h0, h1 = {"max": "max0", "mean": "mean0", "total": "total0"}, {"max": "max1", "mean": "max1", "total": "max1"}
    return window_states(spark, d).withColumns({f"by_{k}": R.instability_score(h0, h1, k) for k in h0})


@query(RULE + "|| SELECT window_id, stability FROM rr", "window_id", "stability")
def stability_score(spark, d):
    return rule_states(spark, d)


@query(RULE + "|| SELECT window_id, (p - 0.5) * least(greatest((1 + 2 * stability) * CASE regime WHEN 'stable' THEN 1.5 WHEN 'stressed' THEN 0.3 ELSE 1 END * confidence, 0.1), 3) AS position FROM rr", "window_id", "position")
def position_sizing(spark, d):
    return rule_states(spark, d).withColumn("signal", F.col("p") - 0.5).withColumn("position", R.position_size("signal", "stability", "regime", "confidence"))


@query(RULE + "|| SELECT window_id, 100 - CASE WHEN p > 0.5 THEN 1 ELSE -1 END * mean0 * (2 - stability) AS stop, 100 + CASE WHEN p > 0.5 THEN 1 ELSE -1 END * mean0 * (2 + stability) AS target FROM rr", "window_id", "stop target")
def stop_loss_take_profit(spark, d):
    s = rule_states(spark, d).withColumns({"price": F.lit(100.0), "position": F.col("p") - 0.5})
    stop, target = R.stop_and_target("price", "position", "mean0", "stability")
    return s.withColumns({"stop": stop, "target": target})


@query(RULE + "|| SELECT regime, sum(abs((p - 0.5) * max0 * mean0)) / sum(abs((p - 0.5) * max0)) AS heat FROM rr GROUP BY 1", "regime", "heat")
def portfolio_heat(spark, d):
    s = rule_states(spark, d).withColumns({"position": F.col("p") - 0.5, "value": F.col("max0"), "volatility": F.col("mean0")})
    return X.portfolio_heat(s, ["regime"])


@query(WIN + "|| SELECT window_id, CASE WHEN mean0 >= 0.2 THEN 0.5 * (p - 0.5) ELSE (p - 0.5) * least(1, (0.2 - mean0) / 0.2) END AS position FROM ws", "window_id", "position")
def heat_adjusted(spark, d):
    return window_states(spark, d).withColumn("raw", F.col("p") - 0.5).withColumn("position", R.heat_adjusted("raw", "mean0"))


@query(RULE + "|| SELECT window_id, CASE WHEN max0 > 0 THEN least(greatest((p * max0 - (1 - p)) / max0, 0), 1) * 0.25 * stability ELSE 0 END AS stake FROM rr", "window_id", "stake")
def kelly(spark, d):
    return rule_states(spark, d).withColumn("stake", R.kelly("p", "max0", "stability"))


_GATE = RULE + ", gt AS (SELECT *, round(score - 0.5, 9) > 0 AS odd, CASE state WHEN 'Stable' THEN 1 WHEN 'Trending' THEN 0.8 WHEN 'Fragmented' THEN 0.3 ELSE 0.1 END AS weight FROM eng), gs AS (SELECT *, round(0.5 + (p - 0.5) * weight, 9) AS drawn FROM gt), gc AS (SELECT *, CASE WHEN odd THEN 'NEUTRAL' WHEN drawn > 0.55 THEN 'LONG' WHEN drawn < 0.45 THEN 'SHORT' ELSE 'NEUTRAL' END AS final_signal, CASE WHEN odd THEN 'H1_instability_exceeded_threshold' WHEN drawn > 0.55 THEN 'NN_prediction_bullish' WHEN drawn < 0.45 THEN 'NN_prediction_bearish' ELSE 'NN_prediction_neutral' END AS reason, least(greatest(CASE WHEN odd THEN 0.2 ELSE (abs(p - 0.5) * 1.2 + (1 - score) * 0.4) * weight END * (1 - CASE WHEN leak > 0.5 THEN 0.2 * leak ELSE 0 END), 0), 1) AS confidence_score FROM gs)"


def gated(spark, d) -> DataFrame:
    return engine_states(spark, d).withColumns(R.gate("p", "score", "state", leak="leak", n0="n0", max1="max1"))


@query(_GATE + "|| SELECT * FROM gc", "window_id final_signal reason", "confidence_score")
def gated_signal(spark, d):
    return gated(spark, d)


@query(_GATE + "|| SELECT window_id, greatest(0, p - (1 - confidence_score) / 2) AS low, least(1, p + (1 - confidence_score) / 2) AS high FROM gc", "window_id", "low high")
def confidence_interval(spark, d):
    lo, hi = R.confidence_interval("p", "confidence_score")
    return gated(spark, d).withColumns({"low": lo, "high": hi})


@query(RULE + "|| SELECT window_id, CASE WHEN state IN ('Fragmented', 'Stressed') THEN 'VX_FUT' WHEN state = 'Trending' THEN 'SECTOR_ETF' ELSE 'CASH' END AS instrument, round_even(least((score + leak) / 2 * CASE state WHEN 'Stable' THEN 0.5 WHEN 'Trending' THEN 0.7 WHEN 'Fragmented' THEN 1.2 ELSE 1.5 END, 1), 3) AS ratio FROM eng", "window_id instrument", "ratio")
def hedge_ratio(spark, d):
    return engine_states(spark, d).withColumns(R.hedge("score", "leak", "state"))


def predictions(states: DataFrame) -> DataFrame:
    """The prediction record as one JSON text a row."""
    lo, hi = R.confidence_interval("p", "confidence_score")
    h = R.hedge("score", "leak", "state")
    record = F.struct(F.col("at").alias("timestamp"), "final_signal", "confidence_score", F.array(lo, hi).alias("confidence_interval"), F.col("state").alias("regime_classification"), F.col("p").alias("nn_predict_proba"), F.col("score").alias("persistence_score"), F.col("leak").alias("graph_leakage"), F.struct(h["instrument"].alias("instrument"), h["ratio"].alias("ratio")).alias("suggested_hedge"), "reason", "reason_details")
    return states.select("window_id", F.to_json(record, {"pretty": "true"}).alias("prediction"))


_TAGS = "concat_ws(',', 'static_threshold', CASE WHEN odd AND max1 > 0.2 THEN 'H1_max_persistence' END, CASE WHEN odd AND n0 > 3 THEN 'H0_fragmentation' END, CASE WHEN NOT odd THEN 'nn_proba,regime,regime_weight' END, CASE WHEN leak > 0.5 THEN 'graph_leakage_penalty' END)"


@query(_GATE + f"|| SELECT window_id, {_TAGS} AS tags FROM gc", "window_id tags")
def gate_reasons(spark, d):
    """What a decision's details speak of."""
    return gated(spark, d).withColumn("tags", F.concat_ws(",", F.transform("reason_details", lambda x: F.substring_index(x, "=", 1))))


_UNIVERSE = ", hu AS (SELECT window_id, max(universe) AS universe FROM h0_features WHERE window_id IS NOT NULL GROUP BY 1), ad0 AS (SELECT eng.*, universe FROM eng JOIN hu USING (window_id) WHERE universe IS NOT NULL), ad1 AS (SELECT *, avg(score) OVER v AS m, stddev_pop(score) OVER v AS sd, count(*) OVER v AS k FROM ad0 WINDOW v AS (PARTITION BY universe ORDER BY window_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), ad2 AS (SELECT *, k >= 5 AS adaptive, CASE WHEN k >= 5 THEN m + 2 * sd ELSE 0.5 END AS lim, round(0.5 + (p - 0.5) * CASE state WHEN 'Stable' THEN 1 WHEN 'Trending' THEN 0.8 WHEN 'Fragmented' THEN 0.3 ELSE 0.1 END, 9) AS drawn FROM ad1)"


@query(RULE + _UNIVERSE + "|| SELECT window_id, adaptive, lim AS threshold, CASE WHEN round(score - lim, 9) > 0 THEN 'NEUTRAL' WHEN drawn > 0.55 THEN 'LONG' WHEN drawn < 0.45 THEN 'SHORT' ELSE 'NEUTRAL' END AS final_signal FROM ad2", "window_id adaptive final_signal", "threshold")
def gated_adaptive(spark, d):
    """Gated by the rolling baseline of the window's universe."""
    u = table(spark, d, "h0_features").where("window_id is not null").groupBy("window_id").agg(F.max("universe").alias("universe")).where("universe is not null")
    s = T.adaptive_threshold(engine_states(spark, d).join(u, "window_id").withColumn("seq", F.col("window_id")), ["universe"])
    return s.withColumns(R.gate("p", "score", "state", leak="leak", threshold="threshold", baseline="baseline_mean", adaptive="adaptive"))


@query(_GATE + ", pf AS (SELECT *, CASE WHEN state IN ('Fragmented', 'Stressed') THEN 'VX_FUT' WHEN state = 'Trending' THEN 'SECTOR_ETF' ELSE 'CASH' END AS instrument, greatest(0, p - (1 - confidence_score) / 2) AS low, least(1, p + (1 - confidence_score) / 2) AS high FROM gc) || SELECT window_id, final_signal, reason, state AS regime, instrument, confidence_score AS confidence, low, high, p, score, leak FROM pf", "window_id final_signal reason regime instrument", "confidence low high p score leak")
def prediction_fields(spark, d):
    """The fields read back from the JSON texts."""
    j = lambda path, t="double": F.get_json_object("prediction", f"$.{path}").cast(t)
    return prediction_json(spark, d).select("window_id", j("final_signal", "string").alias("final_signal"), j("reason", "string").alias("reason"), j("regime_classification", "string").alias("regime"), j("suggested_hedge.instrument", "string").alias("instrument"), j("confidence_score").alias("confidence"), j("confidence_interval[0]").alias("low"), j("confidence_interval[1]").alias("high"), j("nn_predict_proba").alias("p"), j("persistence_score").alias("score"), j("graph_leakage").alias("leak"))


@query()
def prediction_json(spark, d):
    return predictions(gated(spark, d).withColumn("at", F.col("window_id").cast("string")))


# ---------------------------------------------------------------- signals, ensembles


@query(B + ", q AS (SELECT asset, seq, ret, avg(ret) OVER (PARTITION BY asset ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS expected FROM br WHERE ret IS NOT NULL) || SELECT asset, seq, expected, ret - expected AS residual FROM q", "asset seq", "expected residual")
def rolling_expected_residuals(spark, d):
    return _residuals(spark, d)


def _residuals(spark, d):
    r = brand_returns(spark, d).where("ret is not null")
    return r.withColumn("expected", F.avg("ret").over(W.partitionBy("asset").orderBy("seq").rowsBetween(-9, 0))).withColumn("residual", F.col("ret") - F.col("expected"))


@query(B + ", q AS (SELECT asset, seq, ret - avg(ret) OVER (PARTITION BY asset ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS residual FROM br WHERE ret IS NOT NULL), s AS (SELECT avg(sd) AS lim FROM (SELECT stddev_samp(residual) AS sd FROM q GROUP BY asset)) || SELECT asset, seq, residual FROM q, s WHERE round(abs(residual) - 2 * lim, 9) > 0", "asset seq", "residual")
def mispricing_outliers(spark, d):
    q = _residuals(spark, d)
    lim = q.groupBy("asset").agg(F.stddev_samp("residual").alias("sd")).agg(F.avg("sd").alias("lim"))
    return q.crossJoin(F.broadcast(lim)).where(F.round(F.abs("residual") - 2 * F.col("lim"), 9) > 0).orderBy(F.desc(F.abs("residual")))  # one row


def _mom(k: int) -> str:
    return f"coalesce(close / nullif(lag(close, {k}) OVER w, 0) - 1, 0) AS momentum_{k}"


def _vol(k: int) -> str:
    v = f"OVER (PARTITION BY asset ORDER BY seq ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"coalesce(CASE WHEN count(r) {v} = {k} THEN stddev_samp(r) {v} END, 0) AS volatility_{k}"


def _ma(k: int) -> str:
    v = f"OVER (PARTITION BY asset ORDER BY seq ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"coalesce(CASE WHEN count(close) {v} = {k} THEN close / nullif(avg(close) {v}, 0) - 1 END, 0) AS price_to_ma_{k}"


_NN = BARS + ", rb AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY seq), 0) - 1 AS r FROM bars), nf AS (SELECT asset, seq, close, " + ", ".join([*map(_mom, (5, 10, 20)), "coalesce(volume / nullif(lag(volume) OVER w, 0) - 1, 0) AS volume_change", *map(_vol, (5, 10)), *map(_ma, (10, 20)), "coalesce((high - low) / nullif(close, 0), 0) AS hl_spread"]) + " FROM rb WINDOW w AS (PARTITION BY asset ORDER BY seq))"


@query(_NN + "|| SELECT * FROM nf", "asset seq", " ".join(X.FEATURES))
def nn_features(spark, d):
    return X.nn_features(P.event_bars(table(spark, d, "events")))


@query(BARS + "|| SELECT asset, seq, (later > close)::INT AS target FROM (SELECT *, lead(close) OVER (PARTITION BY asset ORDER BY seq) AS later FROM bars) WHERE later IS NOT NULL", "asset seq target")
def nn_targets(spark, d):
    return X.nn_targets(P.event_bars(table(spark, d, "events")))


def _nn(spark, d):
    """Trained on the bars of the first asset by name, as one model prices one asset; it scores all."""
    f = cut(X.nn_features(P.event_bars(table(spark, d, "events"))))
    first = f.agg(F.min("asset")).first()[0]
    return X.predict_up(X.train_classifier(X.nn_targets(f.where(F.col("asset") == first))), f)


@query()
def nn_predict(spark, d):
    p = _nn(spark, d)
    return p.select("asset", "seq", "p_up", R.threshold_signal("p_up", 0.55).alias("signal"))


_FUSED = ["max0", "mean0", "total0", "density", "clustering", "max1"]


@query(WIN + ", a AS (SELECT " + ", ".join(f"avg({k}) AS m_{k}, stddev_pop({k}) AS s_{k}" for k in _FUSED) + " FROM ws) || SELECT window_id, " + ", ".join(f"({k} - m_{k}) / CASE WHEN s_{k} > 1e-12 THEN s_{k} ELSE 1 END * 0.5 AS {k}_f" for k in _FUSED) + " FROM ws, a", "window_id", " ".join(f"{k}_f" for k in _FUSED))
def feature_fusion(spark, d):
    """Global (persistence) and local (graph) blocks, each scaled and weighted by a half."""
    return X.standardise(window_states(spark, d), _FUSED, suffix="_f", weight=0.5)


@query()
def regime_gmm(spark, d):
    return X.fit_regimes(cut(X.standardise(window_states(spark, d), _FUSED)), _FUSED, "gmm").select("window_id", "label", "regime", "confidence")


@query()
def regime_kmeans(spark, d):
    return X.fit_regimes(cut(X.standardise(window_states(spark, d), _FUSED)), _FUSED, "kmeans").select("window_id", "label", "regime")


@query()
def kmeans_proba(spark, d):
    return X.fit_regimes(cut(X.standardise(window_states(spark, d), _FUSED)), _FUSED, "kmeans").select("window_id", "label", "confidence")


def _votes(spark, d):
    w = window_states(spark, d)
    models = F.array(*(F.struct(F.lit(i).alias("model_idx"), s.alias("signal"), c.alias("confidence"), F.lit(x).alias("weight")) for i, (s, c, x) in enumerate(((F.round(F.col("p") - 0.5, 9), F.round("density", 9), 0.5), (F.round(F.col("clustering") - 0.5, 9), F.round("clustering", 9), 0.3), (F.round(0.25 - F.col("max1"), 9), F.round(F.least("max0", F.lit(1.0)), 9), 0.2)))))
    return w.select("window_id", F.explode(models).alias("v")).select("window_id", "v.*")


_VOTES = WIN + ", v AS (SELECT window_id, 0 AS k, round(p - 0.5, 9) AS signal, round(density, 9) AS conf, 0.5 AS weight FROM ws UNION ALL SELECT window_id, 1, round(clustering - 0.5, 9), round(clustering, 9), 0.3 FROM ws UNION ALL SELECT window_id, 2, round(0.25 - max1, 9), round(least(max0, 1), 9), 0.2 FROM ws)"


@query(_VOTES + "|| SELECT window_id, sum(weight * signal) / sum(weight) AS weighted_avg FROM v GROUP BY 1", "window_id", "weighted_avg")
def ens_weighted_avg(spark, d):
    return X.ensemble(_votes(spark, d), ["window_id"])


@query(_VOTES + "|| SELECT window_id, avg(sign(signal)) AS majority FROM v GROUP BY 1", "window_id", "majority")
def ens_majority(spark, d):
    return X.ensemble(_votes(spark, d), ["window_id"])


@query(_VOTES + "|| SELECT window_id, signal AS max_confidence FROM v QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY conf DESC, k) = 1", "window_id", "max_confidence")
def ens_max_confidence(spark, d):
    return X.ensemble(_votes(spark, d), ["window_id"])


@query(WIN + "|| SELECT window_id, CASE WHEN density + clustering > 0 THEN (density * (p - 0.5) + clustering * (0.25 - max1)) / (density + clustering) ELSE (p - 0.25 - max1) / 2 END AS weighted, CASE WHEN density > clustering THEN p - 0.5 ELSE 0.25 - max1 END AS most, (p - 0.25 - max1) / 2 AS average FROM ws", "window_id", "weighted most average")
def ens_combine(spark, d):
    w = window_states(spark, d).withColumns({"a": F.col("p") - 0.5, "b": 0.25 - F.col("max1")})
    return w.withColumns({n: R.combined_signal("a", "density", "b", "clustering", how) for n, how in (("weighted", "weighted"), ("most", "max"), ("average", "average"))})


_META = ["mean0", "clustering"]


@query(WIN + ", c AS (SELECT count(*) * covar_pop(mean0, mean0) + 1 AS a, count(*) * covar_pop(mean0, clustering) AS b, count(*) * covar_pop(clustering, clustering) + 1 AS e, count(*) * covar_pop(mean0, density) AS y0, count(*) * covar_pop(clustering, density) AS y1 FROM ws), w AS (SELECT (e * y0 - b * y1) / (a * e - b * b) AS w0, (a * y1 - b * y0) / (a * e - b * b) AS w1 FROM c) || SELECT 'mean0' AS feature, w0 / (abs(w0) + abs(w1)) AS weight FROM w UNION ALL SELECT 'clustering', w1 / (abs(w0) + abs(w1)) FROM w", "feature", "weight")
def meta_ridge_weights(spark, d):
    w = X.weighted_average_weights(window_states(spark, d), _META, "density")
    return spark.createDataFrame(list(w.items()), "feature string, weight double")


_RIDGE = WIN + ", c AS (SELECT count(*) * covar_pop(mean0, mean0) + 1 AS a, count(*) * covar_pop(mean0, clustering) AS b, count(*) * covar_pop(clustering, clustering) + 1 AS e, count(*) * covar_pop(mean0, density) AS y0, count(*) * covar_pop(clustering, density) AS y1, avg(mean0) AS x0, avg(clustering) AS x1, avg(density) AS y FROM ws), w AS (SELECT *, (e * y0 - b * y1) / (a * e - b * b) AS w0, (a * y1 - b * y0) / (a * e - b * b) AS w1 FROM c)"


@query(_RIDGE + "|| SELECT window_id, w0 * (mean0 - x0) + w1 * (clustering - x1) + y AS prediction FROM ws, w", "window_id", "prediction")
def meta_ridge_stacking(spark, d):
    return X.stacked_regressor(window_states(spark, d), _META, "density")


@query(_RIDGE + "|| SELECT 'mean0' AS feature, abs(w0) / (abs(w0) + abs(w1)) AS importance FROM w UNION ALL SELECT 'clustering', abs(w1) / (abs(w0) + abs(w1)) FROM w", "feature", "importance")
def importance_weights(spark, d):
    w = X.feature_importance(X.weighted_average_weights(window_states(spark, d), _META, "density"), _META)
    return spark.createDataFrame(list(w.items()), "feature string, importance double")


@query()
def importance_learners(spark, d):
    """Of the boosted trees and the logistic regression."""
    w = cut(window_states(spark, d).withColumn("up", (F.col("density") > 0.5).cast("int")))
    rows = [(k, n, x) for k, m in (("boosting", X.boosted(w, _META, "density")), ("stacking", X.stacked_classifier(w, _META, "up"))) for n, x in X.feature_importance(m, _META).items()]
    return spark.createDataFrame(rows, "learner string, feature string, importance double")


@query(WIN + ", a AS (SELECT " + ", ".join(f"avg({k}) AS m_{k}, stddev_pop({k}) AS s_{k}" for k in _FUSED) + " FROM ws WHERE window_id % 2 = 0) || SELECT window_id, " + ", ".join(f"({k} - m_{k}) / CASE WHEN s_{k} > 1e-12 THEN s_{k} ELSE 1 END * 0.5 AS {'global' if k in _FUSED[:3] else 'local'}_{k}" for k in _FUSED) + " FROM ws, a", "window_id", " ".join(f"{'global' if k in _FUSED[:3] else 'local'}_{k}" for k in _FUSED))
def fusion_fit_transform(spark, d):
    """Fitted on the even windows, applied to all."""
    w = window_states(spark, d)
    return X.Fusion().fit(w.where("window_id % 2 = 0"), _FUSED[3:], _FUSED[:3]).transform(w)


@query(B + ", q AS (SELECT asset, seq, ret, avg(ret) OVER (PARTITION BY asset ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS expected FROM br WHERE ret IS NOT NULL), r AS (SELECT seq AS window_id, row_number() OVER (PARTITION BY seq ORDER BY asset) - 1 AS pos, count(*) OVER (PARTITION BY seq) AS n, expected, ret - expected AS residual FROM q) || SELECT window_id, pos::BIGINT AS k, residual AS x FROM r UNION ALL SELECT window_id, (n + pos)::BIGINT, expected FROM r", "window_id k", "x")
def local_vectors(spark, d):
    """Residuals, then expectations, of a period's assets in one vector."""
    v = X.local_vector(_residuals(spark, d).select(F.col("seq").alias("window_id"), F.col("asset").alias("node"), "residual", "expected"), ["residual", "expected"])
    return v.select("window_id", F.posexplode("vector").alias("k", "x")).withColumn("k", F.col("k").cast("bigint"))


@query()
def global_vectors(spark, d):
    """Eleven numbers of the H0 and H1 diagrams."""
    g = brand_h1(spark, d)
    return X.global_vector(T.diagram_features(g, 0, g), T.diagram_features(g, 1, g))


@query(WIN + "|| SELECT window_id, unnest([0, 1, 2])::BIGINT AS k, unnest([density, clustering, max0]) AS x FROM ws", "window_id k", "x")
def flattened_features(spark, d):
    """Two groups, graph and topology, as one vector by the groups' names."""
    v = X.flatten_features(window_states(spark, d), {"topology": ["max0"], "graph": ["density", "clustering"]})
    return v.select("window_id", F.posexplode("vector").alias("k", "x")).withColumn("k", F.col("k").cast("bigint"))


@query(B + ", q AS (SELECT asset, seq, CASE WHEN count(ret) OVER a = 10 THEN avg(ret) OVER a END AS m, CASE WHEN count(ret) OVER z = 20 THEN stddev_samp(ret) OVER z END AS s FROM br WINDOW a AS (PARTITION BY asset ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), z AS (PARTITION BY asset ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) || SELECT asset, seq, coalesce(tanh(m / nullif(s, 0)), 0) AS signal FROM q", "asset seq", "signal")
def momentum_signals(spark, d):
    return X.momentum_signals(brand_returns(spark, d))


@query()
def meta_stacking(spark, d):
    w = cut(window_states(spark, d).withColumn("up", (F.col("density") > 0.5).cast("int")))
    return X.stacked_classifier(w, _META, "up").transform(w).select("window_id", "up", "prediction")


@query()
def meta_boosting(spark, d):
    w = cut(window_states(spark, d))
    return X.boosted(w, _META, "density").transform(w).select("window_id", "density", "prediction")


# ---------------------------------------------------------------- backtests


def _strategies(spark, d):
    r = brand_returns(spark, d)
    s = F.array(F.struct(F.lit("momentum").alias("strategy"), F.signum(F.round("ret", 9)).alias("k")), F.struct(F.lit("reversal").alias("strategy"), (-F.signum(F.round("ret", 9))).alias("k")))
    return r.select("asset", "seq", "ret", F.explode(s).alias("s")).select("s.strategy", "asset", "seq", "ret", F.coalesce(F.col("s.k") / 25, F.lit(0.0)).alias("signal"))


def _bt_sql(signals: str, keys: str = "strategy", every: int = 1) -> str:
    k = keys
    return f"""{signals}, bq AS (SELECT *, last_value(CASE WHEN seq % {every} = 0 THEN least(greatest(signal, -1), 1) END IGNORE NULLS) OVER (PARTITION BY {k}, asset ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM sg),
    bl AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY {k}, asset ORDER BY seq), 0) AS before FROM bq),
    ba AS (SELECT {k}, seq, sum(before * coalesce(ret, 0)) AS r0, sum(abs(position - before)) AS turnover FROM bl GROUP BY ALL),
    bb AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {k} ORDER BY seq) = 1 THEN 0 ELSE r0 END AS r, CASE WHEN row_number() OVER (PARTITION BY {k} ORDER BY seq) = 1 THEN 1 ELSE (1 + r0) * (1 - 0.0015 * turnover) END AS factor FROM ba),
    be AS (SELECT *, 100000 * product(factor) OVER (PARTITION BY {k} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM bb),
    bz AS (SELECT *, coalesce(lag(equity) OVER (PARTITION BY {k} ORDER BY seq) * (1 + r), 100000) * 0.0015 * turnover AS paid, coalesce(equity / lag(equity) OVER (PARTITION BY {k} ORDER BY seq) - 1, 0) AS period_return FROM be),
    curve AS (SELECT *, 100000 - sum(paid) OVER (PARTITION BY {k} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cash, equity / max(equity) OVER (PARTITION BY {k} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS fall FROM bz),
    bm1 AS (SELECT {k}, arg_max(equity, seq) AS final_value, count(*) AS n, coalesce(stddev_samp(period_return), 0) * sqrt(252) AS volatility, coalesce(stddev_samp(period_return) FILTER (WHERE period_return < 0), 0) * sqrt(252) AS down, min(fall) AS max_drawdown, avg((period_return > 0)::INT) AS win_rate FROM curve GROUP BY ALL),
    bm2 AS (SELECT *, final_value / 100000 - 1 AS total_return, CASE WHEN final_value > 0 THEN pow(final_value / 100000, 252.0 / n) - 1 ELSE -1 END AS annualized_return FROM bm1),
    metrics AS (SELECT *, CASE WHEN volatility > 0 THEN annualized_return / volatility ELSE 0 END AS sharpe_ratio, CASE WHEN down > 0 THEN annualized_return / down ELSE 0 END AS sortino_ratio, CASE WHEN abs(max_drawdown) > 0 THEN annualized_return / abs(max_drawdown) ELSE 0 END AS calmar_ratio FROM bm2)"""


_SG = B + ", sg AS (SELECT strategy, asset, seq, ret, coalesce(CASE strategy WHEN 'momentum' THEN sign(round(ret, 9)) ELSE -sign(round(ret, 9)) END / 25.0, 0) AS signal FROM br, (SELECT unnest(['momentum', 'reversal']) AS strategy))"
_BT = _bt_sql(_SG)
METRICS = "total_return annualized_return volatility sharpe_ratio sortino_ratio max_drawdown calmar_ratio win_rate final_value"


@query(_BT + "|| SELECT * FROM curve", "strategy seq", "equity cash turnover period_return")
def backtest_equity(spark, d):
    return X.backtest(_strategies(spark, d))


@query(_bt_sql(_SG, every=5) + "|| SELECT * FROM bq", "strategy asset seq", "position")
def backtest_positions(spark, d):
    """Rebalanced every fifth period."""
    return X.positions(_strategies(spark, d), every=5)


@query(_BT + "|| SELECT * FROM metrics WHERE strategy = 'momentum'", "", METRICS)
def backtest_metrics(spark, d):
    return X.backtest_metrics(X.backtest(_strategies(spark, d).where("strategy = 'momentum'")), ["strategy"])


@query(_BT + "|| SELECT * FROM metrics", "strategy", METRICS)
def compare_strategies(spark, d):
    return X.backtest_metrics(X.backtest(_strategies(spark, d)), ["strategy"])


_ROLL = _bt_sql(_SG.replace("sg AS (", "sg0 AS (") + ", sg AS (SELECT strategy || '-' || ((seq - 20) // 12) AS strategy, asset, seq - 20 - ((seq - 20) // 12) * 12 AS seq, ret, signal FROM sg0 WHERE seq >= 20 AND ((seq - 20) // 12 + 1) * 12 + 20 <= (SELECT max(seq) + 1 FROM sg0))")


def _rolled(spark, d):
    s = X.rolling_windows(_strategies(spark, d), 20, 12)
    s = s.withColumn("strategy", F.concat("strategy", F.lit("-"), F.col("window_id").cast("string")))
    return X.backtest_metrics(X.backtest(s), ["strategy"])


@query(_ROLL + "|| SELECT * FROM metrics", "strategy", METRICS)
def rolling_backtest(spark, d):
    """Every 12 periods after 20 as a backtest of their own."""
    return _rolled(spark, d)


@query(_ROLL + ", l AS (UNPIVOT (SELECT split_part(strategy, '-', 1) AS strategy, total_return::DOUBLE AS total_return, max_drawdown::DOUBLE AS max_drawdown, win_rate::DOUBLE AS win_rate FROM metrics) ON total_return, max_drawdown, win_rate INTO NAME metric VALUE v) || SELECT strategy, metric, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max FROM l GROUP BY 1, 2", "strategy metric", "mean std min max")
def wf_aggregate(spark, d):
    m = _rolled(spark, d).withColumn("strategy", F.substring_index("strategy", "-", 1))
    return X.summarise(m, ["strategy"], ["total_return", "max_drawdown", "win_rate"])


_FITS = _bt_sql(B + ", wn AS (SELECT unnest(range(20, max(seq) + 1 - 12 + 1, 12)) AS pos FROM br), sg AS (SELECT printf('%04d', (pos - 20) // 12) AS strategy, br.asset, br.seq - pos AS seq, ret, coalesce(sign(round(m, 9)) / 25.0, 0) AS signal FROM wn JOIN br ON br.seq >= pos AND br.seq < pos + 12 LEFT JOIN (SELECT pos, asset, avg(ret) AS m FROM wn JOIN br ON br.seq >= pos - 20 AND br.seq < pos GROUP BY ALL) f USING (pos, asset))")


@query(_FITS + "|| SELECT * FROM metrics", "strategy", METRICS)
def rolling_fit_backtest(spark, d):
    """Every 12 periods with the sign of the mean return of the 20 before, fitted anew."""
    fit = lambda x: cut(x.groupBy("asset").agg(F.avg("ret").alias("m")))
    use = lambda m, x: x.join(m, "asset", "left").withColumn("signal", F.coalesce(F.signum(F.round("m", 9)) / 25, F.lit(0.0)))
    return E.rolling_fits(cut(brand_returns(spark, d)), fit, use, 20, 12)


@query("|| SELECT n::BIGINT AS period, greatest(1, floor(n * 0.01))::BIGINT AS n FROM (SELECT unnest([1, 99, 100, 250, 1000]) AS n)", "period n")
def wf_embargo(spark, d):
    """Embargoed periods after tests of several lengths."""
    return spark.createDataFrame([(n,) for n in (1, 99, 100, 250, 1000)], "period bigint").withColumn("n", X.embargo(F.col("period")).cast("bigint"))


@query(B + ", x AS (SELECT min(t) AS a, max(t) AS z, max(seq) + 1 AS n FROM br) || SELECT m::BIGINT AS months, (m * 21)::BIGINT AS undated, floor(m * 30 * n / date_diff('day', a, z))::BIGINT AS dated FROM x, (SELECT unnest([1, 6, 12, 36]) AS m)", "months undated dated")
def wf_months(spark, d):
    """Periods of so many months, without dates and by the panel's density."""
    r = brand_returns(spark, d).agg(F.date_diff(F.max("t"), F.min("t")).alias("days"), (F.max("seq") + 1).alias("n")).first()
    return spark.createDataFrame([(m, X.months_to_periods(m, None), X.months_to_periods(m, r["days"], r["n"])) for m in (1, 6, 12, 36)], "months bigint, undated bigint, dated bigint")


_SPLITS = B + ", sn AS (SELECT (max(seq) + 1)::BIGINT AS n FROM br), sp AS (SELECT (row_number() OVER (ORDER BY ts) - 1)::BIGINT AS split_id, 0::BIGINT AS train_start, ts AS train_end, ts AS test_start, ts + 12 AS test_end, greatest(0, ts - greatest(1, floor(12 * 0.02)))::BIGINT AS purge_start, (ts + 12 + greatest(1, floor(12 * 0.02)))::BIGINT AS purge_end FROM (SELECT unnest(range(24, n - 12 + 1, 6)) AS ts FROM sn))"


def _periods(spark, d):
    r = brand_returns(spark, d)
    return r, int(r.agg(F.max("seq")).first()[0] or -1) + 1


@query(_SPLITS + "|| SELECT * FROM sp", "split_id train_start train_end test_start test_end purge_start purge_end")
def wf_splits(spark, d):
    return X.walk_forward_splits(spark, _periods(spark, d)[1], 24, 12, 6, least=12)


@query(_SPLITS + "|| SELECT split_id, CASE WHEN seq >= test_start THEN 'test' ELSE 'train' END AS role, count(*)::BIGINT AS n FROM sp JOIN br ON (seq >= train_start AND seq < train_end AND NOT (seq >= purge_start AND seq < purge_end)) OR (seq >= test_start AND seq < test_end) GROUP BY 1, 2", "split_id role n")
def wf_purged_train_counts(spark, d):
    r, n = _periods(spark, d)
    return X.split_rows(r, X.walk_forward_splits(spark, n, 24, 12, 6, least=12)).groupBy("split_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query(B + ", n AS (SELECT (max(seq) + 1)::BIGINT AS n FROM br), g AS (SELECT g, g * (n // 5) AS a, CASE WHEN g < 4 THEN (g + 1) * (n // 5) ELSE n END AS z FROM n, range(5) t(g)), k AS (SELECT (row_number() OVER (ORDER BY x.g, y.g) - 1)::BIGINT AS split_id, x.g AS g1, y.g AS g2, x.a AS ta, y.z AS tz FROM g x JOIN g y ON x.g < y.g), q AS (SELECT DISTINCT seq FROM br), r AS (SELECT split_id, seq, CASE WHEN g.g IN (g1, g2) THEN 'test' WHEN seq >= greatest(0, ta - greatest(1, floor((tz - ta) * 0.02))) AND seq < tz + greatest(1, floor((tz - ta) * 0.02)) THEN 'purged' ELSE 'train' END AS role FROM k, q JOIN g ON seq >= g.a AND seq < g.z) || SELECT split_id, role, count(*)::BIGINT AS n FROM r WHERE role <> 'purged' GROUP BY 1, 2", "split_id role n")
def cpcv_splits(spark, d):
    """Periods in every split's test and purged training part."""
    _, n = _periods(spark, d)
    return X.cpcv_splits(spark, n).groupBy("split_id", "role").agg(F.sum(F.col("seq_end") - F.col("seq_start")).alias("n"))


# ---------------------------------------------------------------- stress


_DRAW = lambda *k: "('0x' || substr(md5(concat_ws('-', " + ", ".join(k) + ")), 1, 8))::BIGINT"
_SIMS = StressConfig().simulations
_BOOT = B + f", rr AS MATERIALIZED (SELECT seq, asset, ret FROM br WHERE ret IS NOT NULL), nn AS (SELECT min(seq) AS lo, (max(seq) - min(seq) + 1)::BIGINT AS n, least(20, greatest(5, (max(seq) - min(seq) + 1) // 20))::BIGINT AS b FROM rr), ix AS (SELECT sim_id, seq, lo + {_DRAW('42', 'sim_id', 'seq // b')} % greatest(1, n - b) + seq % b AS at FROM nn, range({_SIMS}) s(sim_id), range(0, (SELECT n FROM nn)) q(seq)), boot AS (SELECT sim_id, ix.seq, asset, ret FROM ix JOIN rr ON rr.seq = ix.at)"


def _simulated(method: str, sql: str | None = None):
    def f(spark, d):
        return X.simulate(brand_returns(spark, d), method, sims=_SIMS)

    f.__name__ = {"bootstrap": "mc_block_bootstrap"}.get(method, f"mc_{method}")
    return query(sql, *(("sim_id seq asset", "ret") if sql else ()))(f)


_simulated("bootstrap", _BOOT + "|| SELECT * FROM boot")
_simulated("shuffle", B + f", rr AS MATERIALIZED (SELECT seq, asset, ret FROM br WHERE ret IS NOT NULL), ix AS (SELECT sim_id, seq, row_number() OVER (PARTITION BY sim_id ORDER BY md5(concat_ws('-', 42, sim_id, seq)), seq) - 1 AS pos FROM (SELECT DISTINCT seq FROM rr), range({_SIMS}) s(sim_id)) || SELECT sim_id, pos::BIGINT AS seq, asset, ret FROM ix JOIN rr USING (seq)")
for _m in ("gbm", "copula", "parametric"):
    _simulated(_m)


def _stress(spark, d):
    """Three metrics of the bootstrapped panels against those of the panel."""
    r = cut(brand_returns(spark, d).where("ret is not null"))
    cols = lambda: [F.avg("ret").alias("mean_return"), F.stddev_samp("ret").alias("volatility"), F.max("ret").alias("best")]
    long = lambda x, v, *k: x.select(*k, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.round(F.col(n), 12).alias(v)) for n in ("mean_return", "volatility", "best")))).alias("m")).select(*k, "m.*")
    return X.stress_aggregate(long(X.simulate(r, "bootstrap", sims=_SIMS).groupBy("sim_id").agg(*cols()), "value", "sim_id"), long(r.agg(*cols()), "original"))


_ST = _BOOT + ", u AS (UNPIVOT (SELECT sim_id, round(avg(ret), 12) AS mean_return, round(stddev_samp(ret), 12) AS volatility, round(max(ret), 12) AS best FROM boot GROUP BY 1) ON mean_return, volatility, best INTO NAME metric VALUE v), o AS (UNPIVOT (SELECT round(avg(ret), 12) AS mean_return, round(stddev_samp(ret), 12) AS volatility, round(max(ret), 12) AS best FROM rr) ON mean_return, volatility, best INTO NAME metric VALUE ov), st AS (SELECT u.metric, max(ov) AS original, avg(v) AS mean, stddev_samp(v) AS std, median(v) AS median, min(v) AS min, max(v) AS max, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.95) AS p95, avg((abs(v) >= abs(ov))::INT) AS p_value FROM u JOIN o ON u.metric = o.metric GROUP BY 1)"


@query(_ST + "|| SELECT * FROM st", "metric", "original mean std median min max p05 p95 p_value")
def stress_aggregate(spark, d):
    return _stress(spark, d)


@query(_ST + ", rb AS (SELECT metric, p_value < 0.05 AS differs, original > 0 AND mean < 0.5 * original AS degrades FROM st) || SELECT *, NOT bool_or(differs OR degrades) OVER () AS is_robust FROM rb", "metric differs degrades is_robust")
def robustness(spark, d):
    return X.robustness(_stress(spark, d))


@query()
def stress_test(spark, d):
    """Block-bootstrapped panels under the momentum strategy, against the panel as it was."""
    r = brand_returns(spark, d)
    sim = X.simulate(r, "bootstrap", sims=StressConfig().simulations).withColumn("strategy", F.col("sim_id").cast("string"))
    real = r.where("ret is not null").select("seq", "asset", "ret", F.lit("original").alias("strategy"))
    signals = sim.select("seq", "asset", "ret", "strategy").unionByName(real).withColumn("signal", F.signum("ret") / 25)
    m = cut(X.backtest_metrics(X.backtest(signals), ["strategy"]))
    long = m.select("strategy", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in METRICS.split()))).alias("x")).select("strategy", "x.*")
    return X.stress_aggregate(long.where("strategy <> 'original'"), long.where("strategy = 'original'").select("metric", F.col("value").alias("original")))


# ---------------------------------------------------------------- pipelines and streams


@query()
def engine_predictions(spark, d):
    """The gated engine over the daily bars of all assets: a window of 60 days, diagrams up to dimension 2, the classifier of the first asset."""
    bars = cut(P.daily_bars(spark, d))
    e = E.GatedEngine(E.EngineConfig(window=60)).fit(bars, rounds=100)
    return predictions(e.predict(bars).withColumnRenamed("regime", "state"))


def _mutual(spark, d):
    m = E.MutualModel()
    return m, cut(m.run(brand_returns(spark, d)))


@query()
def mmm_signals(spark, d):
    """Residuals spread over the correlation graph by heat, fused with topology into regimes (mixture) and positions."""
    return _mutual(spark, d)[1]


@query()
def mmm_external_positions(spark, d):
    """Momentum signals sized by the model's regimes and stability."""
    m, details = _mutual(spark, d)
    return m.risk_adjusted(details, X.momentum_signals(brand_returns(spark, d)).select(F.col("seq").alias("window_id"), "asset", "signal"))


@query(B + ", q AS (SELECT asset, seq, CASE WHEN count(ret) OVER a = 10 THEN avg(ret) OVER a END AS m, CASE WHEN count(ret) OVER z = 20 THEN stddev_samp(ret) OVER z END AS s FROM br WINDOW a AS (PARTITION BY asset ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), z AS (PARTITION BY asset ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) || SELECT seq AS window_id, avg(coalesce(tanh(m / nullif(s, 0)), 0)) AS signal FROM q GROUP BY 1", "window_id", "signal")
def market_signal(spark, d):
    """The market's mean signal, of the momentum signals."""
    return E.market_signal(X.momentum_signals(brand_returns(spark, d)).withColumnRenamed("seq", "window_id"))


@query()
def change_point_market(spark, d):
    return P.change_point_market(spark)


@query()
def random_correlation_market(spark, d):
    return P.random_correlation_market(spark)


@query()
def panel_diagrams(spark, d):
    """Up to dimension 2, of the whole panel: assets by correlation, periods by distance."""
    r = brand_returns(spark, d)
    one = T.diagrams_of_returns(r, 2, signed=True, longest=2.0).withColumn("of", F.lit("assets"))
    return one.unionByName(T.diagrams_of_returns(r, 1, use_correlation=False).withColumn("of", F.lit("periods")))


@query()
def synthetic_market(spark, d):
    return P.synthetic_market(spark)


@query()
def scenario_regimes(spark, d):
    """The descriptive regime of three model markets."""
    c = P.scenario_correlations(spark)
    names = {"unified": 0, "fragmented": 1, "crisis": 2}
    c = c.select(R.pick("scenario", names, -1).cast("bigint").alias("window_id"), F.format_string("%02d", "i").alias("i"), F.format_string("%02d", "j").alias("j"), R.abs_distance("c").alias("d"))
    dg = cut(T.diagrams(c, 1))
    f = [T.diagram_features(dg, k, dg).select("window_id", F.col("n").alias(f"n{k}"), F.col("max_persistence").alias(f"max{k}")) for k in (0, 1)]
    return f[0].join(f[1], "window_id").withColumn("regime", R.described_regime("n0", "n1", "max1"))


@query(BARS + "|| SELECT * FROM bars", "asset volume", "open high low close")
def stream_bars(spark, d):
    """Daily bars as a stream; in update mode a bar's last state counts."""
    folder = new_path(spark, "stream")
    out = S.run_to_table(spark, S.stream_bars(S.read_events(spark, d)), "update", folder)
    last = out.groupBy("asset", "t").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "batch_no").alias("b"))
    return last.select("asset", "b.*")


@query(WIN + ", hu AS (SELECT window_id, max(universe) AS universe FROM h0_features WHERE window_id IS NOT NULL GROUP BY 1), q AS (SELECT universe, window_id, round(least(greatest(max0, max1) / 2, 1), 9) AS score FROM ws JOIN hu USING (window_id) WHERE universe IS NOT NULL), w AS (SELECT *, avg(score) OVER v AS m, stddev_pop(score) OVER v AS s, count(*) OVER v AS k FROM q WINDOW v AS (PARTITION BY universe ORDER BY window_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) || SELECT universe AS key, window_id AS seq, score, CASE WHEN k >= 5 THEN m + 2 * s ELSE 0.5 END AS threshold FROM w", "key seq", "score threshold")
def stream_baseline(spark, d):
    """The rolling baseline of every universe as keyed state of a stream of scores, in three micro-batches."""
    folder = new_path(spark, "stream")
    u = table(spark, d, "h0_features").where("window_id is not null").groupBy("window_id").agg(F.max("universe").alias("key")).where("key is not null")
    scores = window_states(spark, d).join(u, "window_id").select("key", F.col("window_id").alias("seq"), F.round(R.instability_score({"max": "max0"}, {"max": "max1"}), 9).alias("score"))
    scores = cut(scores)
    thirds = scores.agg(F.percentile_approx("seq", F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0] or [0, 0]
    for part in (scores.where(F.col("seq") <= thirds[0]), scores.where((F.col("seq") > thirds[0]) & (F.col("seq") <= thirds[1])), scores.where(F.col("seq") > thirds[1])):
        part.coalesce(1).sortWithinPartitions("seq").write.mode("append").parquet(f"{folder}/in")  # files of rising age: a micro-batch each
    stream = spark.readStream.schema("key string, seq bigint, score double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return S.run_to_table(spark, S.stream_baseline(stream), "append", folder)
