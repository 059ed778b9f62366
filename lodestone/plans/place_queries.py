"""Places, access and the longer chains of joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checks as C
from ..operators import geography as G
from ..operators import joins as J
from ..operators import linkage as L
from ..operators import resolution as O
from .registry import query
from .table_queries import r, t

_BOX = "lon >= n_nationkey % 5 * 2.03 AND lon < n_nationkey % 5 * 2.03 + 2.5 AND lat >= n_regionkey * 1.77 AND lat < n_regionkey * 1.77 + 1.5"
_POINTS = "SELECT c_custkey, c_acctbal / 1000.0 AS lon, (c_custkey % 97) / 10.0 AS lat FROM customer"


def _points(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("lon"), ((F.col("c_custkey") % 97) / 10.0).alias("lat"))


def _boxes(spark, sf_dir) -> DataFrame:
    x, y = F.col("n_nationkey") % 5 * F.lit(2.03), F.col("n_regionkey") * F.lit(1.77)
    ring = F.array(F.array(x, y), F.array(x + 2.5, y), F.array(x + 2.5, y + 1.5), F.array(x, y + 1.5))
    return t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("polygon_id"), (F.col("n_nationkey") * 7 % 26).alias("score"), ring.alias("ring"))


@query("J26_in_any_polygon", f"SELECT c_custkey, EXISTS (SELECT 1 FROM nation WHERE {_BOX}) AS inside FROM ({_POINTS})")
def _(spark, sf_dir):
    return G.in_any_polygon(_points(spark, sf_dir), _boxes(spark, sf_dir), "c_custkey").select("c_custkey", "inside")


@query("J27_greatest_in_polygons", f"SELECT c_custkey, max(n_nationkey * 7 % 26) AS score FROM ({_POINTS}) JOIN nation ON {_BOX} GROUP BY 1")
def _(spark, sf_dir):
    return G.greatest_in_polygons(_points(spark, sf_dir), _boxes(spark, sf_dir), "c_custkey", "score")


_STATES = "SELECT c_custkey, c_nationkey % 6 AS a, CASE WHEN c_custkey % 4 > 0 THEN CASE WHEN c_custkey % 7 = 0 THEN (c_nationkey + 1) % 6 ELSE c_nationkey % 6 END END AS z, CASE WHEN c_custkey % 5 > 0 THEN CASE WHEN c_custkey % 11 = 0 THEN (c_nationkey + 2) % 6 ELSE c_nationkey % 6 END END AS c FROM customer"


def _states(spark, sf_dir) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    z = F.when(k % 4 > 0, F.when(k % 7 == 0, (n + 1) % 6).otherwise(n % 6))
    c = F.when(k % 5 > 0, F.when(k % 11 == 0, (n + 2) % 6).otherwise(n % 6))
    return t(spark, sf_dir, "customer").select("c_custkey", (n % 6).alias("a"), z.alias("z"), c.alias("c"))


@query("G03_state_consistency", f"SELECT c_custkey, coalesce(a <> z, false) OR coalesce(a <> c, false) OR coalesce(z <> c, false) AS differs FROM ({_STATES})")
def _(spark, sf_dir):
    return _states(spark, sf_dir).select("c_custkey", G.state_disagreement(F.col("a"), F.col("z"), F.col("c")).alias("differs"))


@query("G04_thresholds", f"WITH s AS ({_STATES}) SELECT 'coordinate_coverage' AS rule, round(avg(CAST(c IS NOT NULL AS INTEGER)), 6) AS share, avg(CAST(c IS NOT NULL AS INTEGER)) >= 0.75 AS ok FROM s UNION ALL SELECT 'cross_state', round(avg(CAST(coalesce(a <> z, false) OR coalesce(a <> c, false) OR coalesce(z <> c, false) AS INTEGER)), 6), avg(CAST(coalesce(a <> z, false) OR coalesce(a <> c, false) OR coalesce(z <> c, false) AS INTEGER)) <= 0.005 FROM s")
def _(spark, sf_dir):
    return G.thresholds(_states(spark, sf_dir), {"coordinate_coverage": (F.col("c").isNotNull(), 0.75, True), "cross_state": (G.state_disagreement(F.col("a"), F.col("z"), F.col("c")), 0.005, False)}).select("rule", r("share"), "ok")


@query("G05_wrong_source", f"SELECT w, count(*) AS n FROM (SELECT CASE WHEN z IS NULL OR c IS NULL THEN 'incomplete' WHEN a = z AND z = c THEN 'all_agree' WHEN a = z THEN 'coordinate_wrong' WHEN a = c THEN 'postal_wrong' WHEN z = c THEN 'address_wrong' ELSE 'all_differ' END AS w FROM ({_STATES})) GROUP BY 1")
def _(spark, sf_dir):
    w = G.wrong_source(F.col("a"), F.col("z"), F.col("c"))
    return _states(spark, sf_dir).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"))


@query("G06_coordinate_fitness", f"SELECT 'cached' AS name, count(*) AS rows, count(*) FILTER (a IS NOT NULL AND z IS NOT NULL) AS with_coordinates, count(c) AS with_place FROM ({_STATES}) UNION ALL SELECT 'fresh', count(*), count(*) FILTER (a IS NOT NULL AND c IS NOT NULL), count(c) FROM ({_STATES}) WHERE a > 1")
def _(spark, sf_dir):
    s = _states(spark, sf_dir)
    return G.coordinate_fitness({"cached": s.select(F.col("a").alias("lat"), F.col("z").alias("lon"), "c"), "fresh": s.filter("a > 1").select(F.col("a").alias("lat"), F.col("c").alias("lon"), "c")}, "lat", "lon", "c")


@query("G09_nesting", "WITH x AS (SELECT n_nationkey AS k, 2.5 * 1.5 * pow(111.195, 2) * cos(radians(n_regionkey * 1.77 + 0.75)) AS km2 FROM nation) SELECT k, round(greatest(0.0, km2 * CASE WHEN k % 3 = 0 THEN 1.01 ELSE 0.9 END - km2), 4) AS excess, greatest(0.0, km2 * CASE WHEN k % 3 = 0 THEN 1.01 ELSE 0.9 END - km2) <= 100 AS ok FROM x")
def _(spark, sf_dir):
    outer = _boxes(spark, sf_dir).select(F.col("polygon_id").cast("int").alias("k"), G.ring_area_km2(F.col("ring")).alias("km2"))
    inner = outer.withColumn("km2", F.col("km2") * F.when(F.col("k") % 3 == 0, 1.01).otherwise(0.9))
    return G.nesting(inner, outer, "k").select("k", r("excess", 4), "ok")


@query("G11_access_share", "WITH x AS (SELECT c_nationkey % 3 AS rural, c_custkey % 10 AS w, c_acctbal > 2000 AS near, c_acctbal > -500 AS far FROM customer) SELECT rural, CAST(sum(w) AS BIGINT) AS total, 'b30' AS band, CAST(coalesce(sum(w) FILTER (near), 0) AS BIGINT) AS with_access, round(100 * coalesce(sum(w) FILTER (near), 0) / sum(w), 1) AS pct FROM x GROUP BY 1 UNION ALL SELECT rural, CAST(sum(w) AS BIGINT), 'b60', CAST(coalesce(sum(w) FILTER (far), 0) AS BIGINT), round(100 * coalesce(sum(w) FILTER (far), 0) / sum(w), 1) FROM x GROUP BY 1")
def _(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("rural"), (F.col("c_custkey") % 10).alias("w"), (F.col("c_acctbal") > 2000).alias("near"), (F.col("c_acctbal") > -500).alias("far"))
    return G.access_share(c, {"b30": "near", "b60": "far"}, "w", ["rural"])


@query("G12_geometry_rules", "WITH x AS (SELECT CASE WHEN c_custkey % 50 > 0 THEN c_acctbal / 100 END AS lat, CASE WHEN c_custkey % 77 = 0 THEN 0 ELSE c_custkey % 200 END AS lon FROM customer) SELECT 'present' AS rule, count(*) FILTER (lat IS NULL) AS n, count(*) FILTER (lat IS NULL) = 0 AS ok FROM x UNION ALL SELECT 'in_range', count(*) FILTER (NOT coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false)), count(*) FILTER (NOT coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false)) = 0 FROM x UNION ALL SELECT 'not_null_island', count(*) FILTER (NOT coalesce(NOT (abs(lat) < 1e-9 AND abs(lon) < 1e-9), false)), count(*) FILTER (NOT coalesce(NOT (abs(lat) < 1e-9 AND abs(lon) < 1e-9), false)) = 0 FROM x")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    x = t(spark, sf_dir, "customer").select(F.when(k % 50 > 0, F.col("c_acctbal") / 100).alias("lat"), F.when(k % 77 == 0, 0).otherwise(k % 200).alias("lon"))
    return C.rule_counts(x, G.geometry_rules("lat", "lon"))


@query("G14_band_completeness", "SELECT l_suppkey, l_returnflag, array_to_string(list_sort(list(DISTINCT b)), '/') AS bands_present, CAST(count(DISTINCT b) AS INTEGER) AS n_bands, count(DISTINCT b) = 4 AS complete FROM (SELECT l_suppkey, l_returnflag, CASE WHEN l_quantity < 2 THEN 30 WHEN l_quantity < 4 THEN 60 WHEN l_quantity < 6 THEN 120 WHEN l_quantity < 50 THEN NULL ELSE 180 END AS b FROM lineitem) WHERE b IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    q = F.col("l_quantity")
    b = F.when(q < 2, 30).when(q < 4, 60).when(q < 6, 120).when(q >= 50, 180)
    return G.band_completeness(t(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", b.alias("b")), ["l_suppkey", "l_returnflag"], "b", 4)


# ---------------------------------------------------------------- chains


@query("H01_covariates", """
WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1),
x AS (SELECT n_nationkey, r_name, customers, balance FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey)
SELECT 'r_name' AS column, count(r_name) AS filled, count(*) AS rows FROM x UNION ALL SELECT 'customers', count(customers), count(*) FROM x UNION ALL SELECT 'balance', count(balance), count(*) FROM x""")
def _(spark, sf_dir):
    base = t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r"))
    base = J.left_join(base, t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), "r_name"), ["r"])
    for df, key, value, least in ((t(spark, sf_dir, "customer"), "c_nationkey", F.count(F.lit(1)).alias("customers"), 0.85), (t(spark, sf_dir, "supplier"), "s_nationkey", F.round(F.sum("s_acctbal"), 2).alias("balance"), 0.3)):
        base = J.left_join(base, df.groupBy(F.col(key).alias("n_nationkey")).agg(value), ["n_nationkey"], min_coverage=least)
    return C.completeness(base, ["r_name", "customers", "balance"])


@query("H03_H09_place_fallback", "WITH e AS (SELECT n_nationkey AS k, n_name AS place FROM nation WHERE n_nationkey % 2 = 0), f AS (SELECT n_regionkey AS k2, min(n_name) AS place FROM nation WHERE n_regionkey <> 3 GROUP BY 1) SELECT c_custkey, coalesce(e.place, f.place) AS place, CASE WHEN e.place IS NOT NULL THEN 'cached' WHEN f.place IS NOT NULL THEN 'city_centre' END AS place_source FROM customer JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN e ON e.k = c_nationkey LEFT JOIN f ON f.k2 = n.n_regionkey")
def _(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    cached = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    centre = n.filter("n_regionkey <> 3").groupBy("n_regionkey").agg(F.min("n_name").alias("place"))
    c = t(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    return J.cascade_join(c, [(cached, ["c_nationkey"], "cached"), (centre, ["n_regionkey"], "city_centre")], "place").select("c_custkey", "place", "place_source")


@query("H04_education_rollup", "SELECT o_custkey, string_agg(DISTINCT upper(substr(o_orderpriority, 3)), '|' ORDER BY upper(substr(o_orderpriority, 3))) AS schools, count(DISTINCT substr(o_orderpriority, 3)) AS n_schools, count(DISTINCT substr(o_orderpriority, 3)) > 1 AS conflicting FROM orders GROUP BY 1")
def _(spark, sf_dir):
    name = S.school(F.concat(F.lit("The "), F.substring("o_orderpriority", 3, 30)))
    per = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(name)).alias("s"))
    return per.select("o_custkey", F.array_join("s", "|").alias("schools"), F.size("s").cast("long").alias("n_schools"), (F.size("s") > 1).alias("conflicting"))


@query("H06_two_tier_names", """
WITH l AS (SELECT p_partkey AS id, p_name, p_brand FROM part WHERE p_size <= 10), g AS (SELECT p_partkey AS npi, p_name, p_brand FROM part WHERE p_size > 40),
e AS (SELECT id, min(npi) AS npi, 'exact' AS tier FROM l JOIN g USING (p_name, p_brand) GROUP BY 1),
k AS (SELECT id, min(npi) AS npi, 'token' AS tier FROM (SELECT id, p_brand, unnest(list_filter(string_split(upper(p_name), ' '), lambda z: length(z) >= 4)) AS w FROM l) JOIN (SELECT npi, p_brand, unnest(list_filter(string_split(upper(p_name), ' '), lambda z: length(z) >= 4)) AS w FROM g) USING (p_brand, w) WHERE id NOT IN (SELECT id FROM e) GROUP BY 1)
SELECT * FROM e UNION ALL SELECT * FROM k""")
def _(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("tokens", S.surname_tokens(F.col("p_name")))
    left, right = p.filter("p_size <= 10").withColumnRenamed("p_partkey", "id"), p.filter("p_size > 40").withColumnRenamed("p_partkey", "npi")
    exact = left.select("id", "p_name", "p_brand").join(right.select("npi", "p_name", "p_brand"), ["p_name", "p_brand"]).select("id", "npi", F.lit(1).alias("tier"))
    token = J.token_join(left, right, "tokens", ["p_brand"], ("id", "npi")).withColumn("tier", F.lit(2))
    best = exact.unionByName(token).groupBy("id").agg(F.min(F.when(F.col("tier") == 1, F.col("npi"))).alias("e"), F.min(F.when(F.col("tier") == 2, F.col("npi"))).alias("k"))
    return best.select("id", F.coalesce("e", "k").alias("npi"), F.when(F.col("e").isNotNull(), "exact").otherwise("token").alias("tier"))


_VERSIONS = "SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN p_size % 4 END AS a, CASE WHEN p_size < 45 THEN CASE WHEN p_size % 9 = 0 THEN 1 ELSE p_size % 4 END END AS b FROM part"


def _versions(spark, sf_dir) -> DataFrame:
    s = F.col("p_size")
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(s > 5, s % 4).alias("a"), F.when(s < 45, F.when(s % 9 == 0, 1).otherwise(s % 4)).alias("b"))


@query("H08_version_compare", f"SELECT a AS tier_a, b AS tier_b, count(*) AS n FROM ({_VERSIONS}) GROUP BY 1, 2")
def _(spark, sf_dir):
    return _versions(spark, sf_dir).groupBy(F.col("a").alias("tier_a"), F.col("b").alias("tier_b")).agg(F.count(F.lit(1)).alias("n"))


@query("H10_arm_gate", f"SELECT CASE WHEN a = b THEN 'same link' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'different link' WHEN a IS NOT NULL THEN 'lost' WHEN b IS NOT NULL THEN 'gained' ELSE 'still open' END AS transition, count(*) AS n FROM ({_VERSIONS}) GROUP BY 1")
def _(spark, sf_dir):
    v = _versions(spark, sf_dir)
    C.enforce(C.invariants(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), v, "id"))
    return v.groupBy(L.transition(F.col("a"), F.col("b")).alias("transition")).agg(F.count(F.lit(1)).alias("n"))


@query("H11_practice_setting", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'hospital' WHEN c_nationkey = 7 THEN 'birth_centre' WHEN c_acctbal > 5000 THEN 'group' ELSE 'unknown' END AS setting FROM customer")
def _(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    h = t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    c = J.with_membership(c, h, ["c_custkey"], "hospital")
    first, _every = O.first_cause([(F.col("hospital"), "hospital"), (F.col("c_nationkey") == 7, "birth_centre"), (F.col("c_acctbal") > 5000, "group")], "unknown")
    return c.select("c_custkey", first.alias("setting"))


@query("H12_payment_status", "SELECT o_custkey, round(sum(o_totalprice), 2) AS paid, CASE WHEN sum(o_totalprice) >= 3000000 THEN 'high' WHEN sum(o_totalprice) >= 1000000 THEN 'middle' ELSE 'low' END AS status FROM orders GROUP BY 1")
def _(spark, sf_dir):
    per = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return per.select("o_custkey", F.round("s", 2).alias("paid"), S.band(F.col("s"), [1000000, 3000000], ["low", "middle", "high"]).alias("status"))


@query("H13_address_then_city", """
WITH c AS (SELECT c_custkey AS id, c_nationkey AS zip, c_mktsegment AS city FROM customer), h AS (SELECT s_suppkey AS org, s_nationkey AS zip, CASE s_suppkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'FURNITURE' WHEN 2 THEN 'MACHINERY' ELSE 'X' || s_suppkey END AS city FROM supplier WHERE s_nationkey > 3),
a AS (SELECT id, min(org) AS org, 'zip' AS tier FROM c JOIN h USING (zip) GROUP BY 1 HAVING count(DISTINCT org) = 1), b AS (SELECT id, min(org) AS org, 'city' AS tier FROM c JOIN h USING (city) WHERE id NOT IN (SELECT id FROM a) GROUP BY 1 HAVING count(DISTINCT org) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def _(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("zip"), F.col("c_mktsegment").alias("city"))
    k = F.col("s_suppkey")
    city = F.when(k % 5 == 0, "BUILDING").when(k % 5 == 1, "FURNITURE").when(k % 5 == 2, "MACHINERY").otherwise(F.concat(F.lit("X"), k.cast("string")))
    h = t(spark, sf_dir, "supplier").filter("s_nationkey > 3").select(k.alias("org"), F.col("s_nationkey").alias("zip"), city.alias("city"))
    return L.waterfall(c, [("zip", h.select("org", "zip"), ["zip"]), ("city", h.select("org", "city"), ["city"])], "id", "org")


@query("H14_address_by_source", "SELECT c_custkey, CASE WHEN b IS NULL AND c IS NULL THEN 'alone' WHEN a = b AND a = c THEN 'both_agree' WHEN a = b OR a = c THEN 'one_agrees' ELSE 'none_agrees' END AS verdict FROM (SELECT c_custkey, c_nationkey AS a, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey - c_custkey % 2 END AS b, CASE WHEN c_custkey % 5 > 1 THEN c_nationkey - CAST(c_custkey % 7 = 0 AS INTEGER) END AS c FROM customer)")
def _(spark, sf_dir):
    k, a = F.col("c_custkey"), F.col("c_nationkey")
    b, c = F.when(k % 3 > 0, a - k % 2), F.when(k % 5 > 1, a - (k % 7 == 0).cast("int"))
    agree = lambda x: F.coalesce(a == x, F.lit(False)).cast("int")
    n = agree(b) + agree(c)
    return t(spark, sf_dir, "customer").select("c_custkey", F.when(b.isNull() & c.isNull(), "alone").when(n == 2, "both_agree").when(n == 1, "one_agrees").otherwise("none_agrees").alias("verdict"))


@query("H15_boundary_vintage", "SELECT o_orderkey, CASE WHEN year(o_orderdate) + 25 >= 2020 THEN 2020 ELSE 2010 END AS vintage FROM orders")
def _(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", G.boundary_vintage(F.year("o_orderdate") + 25, [2010, 2020]).alias("vintage"))


@query("H17_district_counts", f"SELECT n_nationkey AS polygon_id, '118' AS vintage, count(*) AS n FROM ({_POINTS}) JOIN nation ON {_BOX} GROUP BY 1 UNION ALL SELECT n_nationkey, '119', count(*) FROM ({_POINTS}) JOIN nation ON {_BOX} WHERE n_nationkey % 2 = 0 GROUP BY 1")
def _(spark, sf_dir):
    points, boxes = _points(spark, sf_dir), _boxes(spark, sf_dir)
    count = lambda b, v: G.points_in_polygons(points, b).groupBy(F.col("polygon_id").cast("int").alias("polygon_id")).agg(F.lit(v).alias("vintage"), F.count(F.lit(1)).alias("n"))
    return count(boxes, "118").unionByName(count(boxes.filter("polygon_id % 2 = 0"), "119"))


@query("H18_group_summary", "SELECT n_regionkey, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS middle, count(*) FILTER (c_acctbal IS NULL) AS missing FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def _(spark, sf_dir):
    from ..operators.statistics import quantiles

    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = t(spark, sf_dir, "customer").join(n, "c_nationkey")
    by = ["n_regionkey", "c_mktsegment"]
    sums = c.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.count_if(F.col("c_acctbal").isNull()).alias("missing"))
    return sums.join(quantiles(c, "c_acctbal", {"middle": 0.5}, by), by).select(*by, "n", "mean", r("middle", 4), "missing")


@query("H19_attempt_audit", "SELECT user_id, count(*) AS attempts, count(DISTINCT event_type) AS providers, arg_max(event_type, event_id) AS last_provider, count(*) FILTER (event_type = 'error') AS failures, count(DISTINCT round(value)) > 1 AS conflicting FROM events GROUP BY 1")
def _(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("event_type").alias("providers"), F.max_by("event_type", "event_id").alias("last_provider"), F.count_if(F.col("event_type") == "error").alias("failures"), (F.count_distinct(F.round("value")) > 1).alias("conflicting"))


@query("H20_review_draw", "SELECT c_custkey, risk, place FROM (SELECT c_custkey, risk, row_number() OVER (PARTITION BY risk ORDER BY md5('review:' || c_custkey), c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 1000 THEN 2 ELSE 3 END AS risk FROM customer)) WHERE place <= 25")
def _(spark, sf_dir):
    b = F.col("c_acctbal")
    c = t(spark, sf_dir, "customer").select("c_custkey", F.when(b < 0, 1).when(b < 1000, 2).otherwise(3).alias("risk"))
    order = F.md5(F.concat_ws(":", F.lit("review"), F.col("c_custkey").cast("string")))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("risk").orderBy(order, "c_custkey"))).filter("place <= 25").select("c_custkey", "risk", F.col("place").cast("long").alias("place"))


@query("H21_recovery_accounting", "SELECT o_orderstatus, count(*) AS wanted, count(*) FILTER (o_totalprice > 150000) AS recovered, round(100.0 * count(*) FILTER (o_totalprice > 150000) / count(*), 4) AS pct FROM orders GROUP BY 1")
def _(spark, sf_dir):
    per = t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("o_totalprice") > 150000).alias("recovered"))
    return per.withColumn("pct", F.round(100.0 * F.col("recovered") / F.col("wanted"), 4))


@query("H22_vintage_manifest", "SELECT y, rows, ids, total, row_number() OVER (PARTITION BY rows, ids, total ORDER BY y) > 1 AS republished FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS rows, count(DISTINCT o_custkey) AS ids, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1)")
def _(spark, sf_dir):
    from ..operators.panel import fingerprints

    o = t(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return fingerprints(o, "y", {"rows": F.count(F.lit(1)), "ids": F.count_distinct("o_custkey"), "total": F.sum("o_orderkey")})


@query("H23_roster_export", "SELECT n_regionkey, count(*) AS people, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS linked, round(100.0 * count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) / count(*), 4) AS pct FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def _(spark, sf_dir):
    c = t(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    c = J.with_membership(c, t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], "linked")
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    per = c.join(n, "c_nationkey").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("people"), F.count_if("linked").alias("linked"))
    return per.withColumn("pct", F.round(100.0 * F.col("linked") / F.col("people"), 4))


@query("H24_matcher_diagnostics", f"SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'neither' WHEN a IS NULL THEN 'second_only' WHEN b IS NULL THEN 'first_only' WHEN a = b THEN 'agree' ELSE 'disagree' END AS verdict, count(*) AS n, count(DISTINCT a) AS orgs_a, count(DISTINCT b) AS orgs_b FROM ({_VERSIONS}) GROUP BY 1")
def _(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    verdict = F.when(a.isNull() & b.isNull(), "neither").when(a.isNull(), "second_only").when(b.isNull(), "first_only").when(a == b, "agree").otherwise("disagree")
    return _versions(spark, sf_dir).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("orgs_a"), F.count_distinct("b").alias("orgs_b"))


@query("H25_H27_queue", "SELECT user_id, row_number() OVER (ORDER BY md5('queue:' || user_id), user_id) AS turn FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60))")
def _(spark, sf_dir):
    from ..operators.statistics import counts_before
    from ..streaming.ingest import todo

    e = t(spark, sf_dir, "events")
    rest = todo(e.select("user_id").distinct(), e.filter("event_type = 'purchase' AND value > 60"), "user_id")
    turn = F.md5(F.concat_ws(":", F.lit("queue"), F.col("user_id").cast("string")))
    rest = rest.withColumn("h", turn).withColumn("place", F.conv(F.substring("h", 1, 15), 16, 10).cast("long"))
    return rest.join(counts_before(rest, "place"), "place").select("user_id", (F.col("before") + 1).alias("turn"))


@query("H26_panel_geocode", f"""
WITH p AS ({_POINTS}), k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS zip, c_nationkey % 7 AS city FROM customer),
a AS (SELECT n_nationkey AS zip, CAST(n_nationkey AS DOUBLE) / 3 AS lon, CAST(n_regionkey AS DOUBLE) * 1.77 + 0.5 AS lat FROM nation), b AS (SELECT n_nationkey % 7 AS city, min(CAST(n_nationkey AS DOUBLE) / 3) AS lon, min(CAST(n_regionkey AS DOUBLE) * 1.77 + 0.5) AS lat FROM nation GROUP BY 1),
m AS (SELECT id, coalesce(a.lon, b.lon) AS lon, coalesce(a.lat, b.lat) AS lat FROM k LEFT JOIN a USING (zip) LEFT JOIN b USING (city))
SELECT id, min(n_nationkey) AS polygon_id FROM m JOIN nation ON {_BOX} GROUP BY 1""")
def _(spark, sf_dir):
    n = F.col("n_nationkey")
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("zip"), (F.col("c_nationkey") % 7).alias("city"))
    places = t(spark, sf_dir, "nation").select(n.alias("zip"), (n % 7).alias("city"), (n.cast("double") / 3).alias("lon"), (F.col("n_regionkey").cast("double") * 1.77 + 0.5).alias("lat"))
    exact = places.select("zip", F.col("lon").alias("x"), F.col("lat").alias("y"))
    loose = places.groupBy("city").agg(F.min("lon").alias("x2"), F.min("lat").alias("y2"))
    m = c.join(exact, "zip", "left").join(loose, "city", "left").select("id", F.coalesce("x", "x2").alias("lon"), F.coalesce("y", "y2").alias("lat"))
    hits = G.points_in_polygons(m, _boxes(spark, sf_dir))
    return G.first_polygon(hits, "id").select("id", F.col("polygon_id").cast("int").alias("polygon_id"))


@query("H02_latest_certified", "SELECT s_nationkey, count(*) FILTER (q >= 25) AS yes, count(*) FILTER (q < 25) AS no FROM (SELECT l_suppkey, arg_max(l_quantity, CAST(l_shipdate AS VARCHAR) || lpad(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 12, '0')) AS q FROM lineitem GROUP BY 1) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def _(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    latest = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max_by("l_quantity", F.struct("l_shipdate", F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("q"))
    s = t(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(latest, "s_suppkey")
    return s.groupBy("s_nationkey").agg(F.count_if(F.col("q") >= 25).alias("yes"), F.count_if(F.col("q") < 25).alias("no"))


@query("C03_union_of_years", "SELECT y, count(*) AS n FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf_dir):
    from functools import reduce

    o = t(spark, sf_dir, "orders", "o_custkey", "o_orderdate").withColumn("y", F.year("o_orderdate"))
    years = sorted(x["y"] for x in o.select("y").distinct().collect())  # a few years
    tables = [o.filter(F.col("y") == y).select("o_custkey", F.lit(y).alias("y")) for y in years]
    return reduce(DataFrame.unionByName, tables).distinct().groupBy("y").agg(F.count(F.lit(1)).alias("n"))
