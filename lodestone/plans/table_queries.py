"""Scalars, panels, organizations, geography, statistics and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import geography as G
from ..operators import joins as J
from ..operators import panel as P
from ..operators import resolution as O
from ..operators import statistics as X
from ..streaming.ingest import todo
from .registry import query


def t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


@query("F01_F12_name_keys", """
SELECT p_partkey, trim(regexp_replace(upper(p_name), '\\s+', ' ', 'g')) AS name_key, substr(upper(p_name), 1, 1) AS initial, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS letters,
  upper(split_part(p_name, ' ', 1)) AS given, nullif(upper(split_part(p_name, ' ', 2)), '') AS rest FROM part""")
def _(spark, sf_dir):
    n = F.col("p_name")
    given, rest = S.split_given(n)
    return t(spark, sf_dir, "part").select("p_partkey", S.name_key(n).alias("name_key"), S.first_initial(n).alias("initial"), S.letters_only(n).alias("letters"), given.alias("given"), rest.alias("rest"))


@query("F05_F06_surname_tokens", "SELECT p_partkey, t FROM (SELECT p_partkey, unnest(list_distinct(list_filter(string_split(upper(p_name), ' '), lambda x: length(x) >= 4))) AS t FROM part) WHERE t IS NOT NULL")
def _(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.explode(S.surname_tokens(F.col("p_name"))).alias("t"))


@query("F13_F15_licence_keys", """
SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'OH' WHEN 1 THEN 'TX' END || '::' || upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS k FROM customer""")
def _(spark, sf_dir):
    state = F.when(F.col("c_nationkey") % 3 == 0, "ohio").when(F.col("c_nationkey") % 3 == 1, "TX").otherwise("nowhere")
    return t(spark, sf_dir, "customer").select("c_custkey", S.licence_key(state, F.col("c_name")).alias("k"))


@query("F16_F20_identifiers", """
WITH x AS (SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS d, c_nationkey FROM customer)
SELECT c_custkey, CASE WHEN length('1' || d) = 10 THEN '1' || d END AS npi, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS fips, substr(d, 1, 5) AS zip5, CASE WHEN length(d) = 9 THEN d END AS zip9, CASE WHEN length('1' || d) = 10 THEN '1' || d END AS phone FROM x""")
def _(spark, sf_dir):
    one = F.concat(F.lit("1"), F.col("c_name"))
    return t(spark, sf_dir, "customer").select("c_custkey", S.npi(one).alias("npi"), S.pad(F.col("c_nationkey"), 5).alias("fips"), S.zip5_strict(F.col("c_name")).alias("zip5"), S.zip9(F.col("c_name")).alias("zip9"), S.phone10(one).alias("phone"))


@query("F17_npi_luhn", """
WITH x AS (SELECT c_custkey, '80840' || '1' || regexp_replace(c_name, '[^0-9]', '', 'g') AS s FROM customer),
d AS (SELECT c_custkey, s, unnest(range(1, length(s) + 1)) AS i FROM x),
v AS (SELECT c_custkey, CAST(substr(s, length(s) + 1 - i, 1) AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) AS v FROM d)
SELECT c_custkey, sum(CASE WHEN v > 9 THEN v - 9 ELSE v END) % 10 = 0 AS ok FROM v GROUP BY c_custkey""")
def _(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", S.npi_valid(F.concat(F.lit("1"), S.digits(F.col("c_name")))).alias("ok"))


@query("F21_F26_addresses", """
SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(p_size || ' ' || p_name || ' Street, Suite ' || p_size), '[.,#]', ' ', 'g'), '\\s+', ' ', 'g'))
   .regexp_replace('\\bSTREET\\b', 'ST').regexp_replace('\\bSUITE\\b', 'STE') AS street, trim(upper(p_size || ' ' || p_name || ' ST')) AS no_unit FROM part""")
def _(spark, sf_dir):
    a = F.concat_ws(" ", F.col("p_size").cast("string"), "p_name", F.lit("Street, Suite"), F.col("p_size").cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", S.address(a).alias("street"), S.address_without_unit(a).alias("no_unit"))


@query("F25_organization", "SELECT s_suppkey, trim(regexp_replace(upper(regexp_replace(s_name, '[^A-Za-z0-9]', ' ', 'g')), '\\s+', ' ', 'g')) AS org FROM supplier")
def _(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", S.organization(F.concat(F.lit("The "), F.col("s_name"), F.lit(", Inc."))).alias("org"))


@query("F27_F29_bands", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN a < 0 OR a > 25 THEN NULL WHEN a < 5 THEN '<5 years' WHEN a < 10 THEN '5-9 years' WHEN a < 15 THEN '10-14 years' WHEN a < 20 THEN '15-19 years' ELSE '>=20 years' END AS band
FROM (SELECT *, 2010 - year(o_orderdate) AS a FROM orders)""")
def _(spark, sf_dir):
    y = S.year_of(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t(spark, sf_dir, "orders").select("o_orderkey", y.alias("y"), S.band_years_since_enumeration(2010 - y).alias("band"))


@query("F28_suppressed", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS DOUBLE) END AS value, CASE WHEN o_orderkey % 7 = 0 THEN 'suppressed' ELSE 'ok' END AS flag FROM orders")
def _(spark, sf_dir):
    x = F.when(F.col("o_orderkey") % 7 == 0, "Suppressed").otherwise(F.format_number("o_orderkey", 0))
    return t(spark, sf_dir, "orders").select("o_orderkey", S.suppressed_count(x).alias("s")).select("o_orderkey", "s.value", "s.flag")


@query("F31_G13_coordinates", """
WITH x AS (SELECT c_custkey, -130.0 + c_nationkey * 3 AS lon, 17.0 + c_nationkey * 1.5 AS lat FROM customer)
SELECT c_custkey, CASE WHEN (lon BETWEEN -68 AND -64 AND lat BETWEEN 17 AND 19) OR (lon BETWEEN -171 AND -168 AND lat BETWEEN -15 AND -13) OR (lon BETWEEN 144 AND 147 AND lat BETWEEN 13 AND 21) THEN 'territory'
  WHEN (lon BETWEEN -180 AND -129 AND lat BETWEEN 51 AND 72) OR (lon BETWEEN -161 AND -154 AND lat BETWEEN 18 AND 23) THEN 'noncontiguous' WHEN lon BETWEEN -125 AND -66 AND lat BETWEEN 24 AND 50 THEN 'conus' ELSE 'implausible' END AS place,
  printf('%.6f_%.6f', CAST(lat AS DOUBLE), CAST(lon AS DOUBLE)) AS k FROM x""")
def _(spark, sf_dir):
    lon, lat = F.lit(-130.0) + F.col("c_nationkey") * 3, F.lit(17.0) + F.col("c_nationkey") * 1.5
    return t(spark, sf_dir, "customer").select("c_custkey", S.classify_coordinate(lon, lat).alias("place"), S.coordinate_key(lat, lon).alias("k"))


@query("F32_haversine", "SELECT n_nationkey, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(n_nationkey) / 2), 2) + cos(radians(10.0)) * cos(radians(10.0 + n_nationkey)) * pow(sin(radians(n_regionkey) / 2), 2)))), 4) AS km FROM nation")
def _(spark, sf_dir):
    n = F.col("n_nationkey")
    return t(spark, sf_dir, "nation").select("n_nationkey", F.round(S.haversine_km(F.lit(10.0), F.lit(0.0), F.lit(10.0) + n, F.col("n_regionkey").cast("double")), 4).alias("km"))


@query("F33_jaro_winkler", "SELECT p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) AS jw FROM part")
def _(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.round(S.jaro_winkler(F.col("p_name"), F.col("p_type")), 6).alias("jw"))


@query("F34_safe_divide", "SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_discount) < 1e-10 THEN NULL ELSE l_tax / l_discount END, 6) AS ratio, round_even(CASE WHEN abs(l_discount) < 1e-10 THEN 0.0 ELSE l_tax / l_discount END * 100, 1) AS pct FROM lineitem")
def _(spark, sf_dir):
    a, b = F.col("l_tax"), F.col("l_discount")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.safe_divide(a, b), 6).alias("ratio"), S.safe_percent(a, b).alias("pct"))


@query("P01_P14_projection", """
SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS most, CAST(l_discount > 0.05 AS INTEGER) + CAST(l_tax > 0.05 AS INTEGER) AS flags, CASE WHEN l_quantity BETWEEN 1 AND 40 THEN l_quantity END AS plausible,
  l_returnflag IN ('A', 'R') AS allowed FROM lineitem WHERE regexp_matches(l_linestatus, '^[OF]$') AND l_discount > 0.01 AND l_tax > 0.01""")
def _(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").filter(F.col("l_linestatus").rlike("^[OF]$") & (F.col("l_discount") > 0.01) & (F.col("l_tax") > 0.01))
    flags = (F.col("l_discount") > 0.05).cast("int") + (F.col("l_tax") > 0.05).cast("int")
    return rows.select("l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("most"), flags.alias("flags"), F.when(F.col("l_quantity").between(1, 40), F.col("l_quantity")).alias("plausible"), F.col("l_returnflag").isin("A", "R").alias("allowed"))


@query("P16_X12_stratified_sample", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('sample:' || event_id), event_id) AS n FROM events) WHERE n <= 10")
def _(spark, sf_dir):
    return X.stratified_sample(t(spark, sf_dir, "events", "event_id", "event_type"), "event_type", "event_id", 10)


_DAYS = "SELECT DISTINCT user_id, event_type AS org, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS d FROM events"
_SPELL = f"""
WITH x AS ({_DAYS}), y AS (SELECT *, CASE WHEN d - lag(d) OVER w = 1 THEN 0 ELSE 1 END AS nw FROM x WINDOW w AS (PARTITION BY user_id, org ORDER BY d)),
z AS (SELECT *, sum(nw) OVER (PARTITION BY user_id, org ORDER BY d) AS spell_index FROM y),
s AS (SELECT user_id, org, CAST(spell_index AS BIGINT) AS spell_index, min(d) AS first_seen, max(d) AS last_seen, count(*) AS n_seen FROM z GROUP BY ALL)
"""


def days(spark, sf_dir) -> DataFrame:
    d = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("org"), d.alias("d")).distinct()


@query("W06_W07_spells", _SPELL + ", b AS (SELECT min(d) AS lo, max(d) AS hi FROM x) SELECT user_id, org, spell_index, first_seen, last_seen, n_seen, first_seen = lo AS left_censored, last_seen = hi AS right_censored, CASE WHEN last_seen < hi THEN last_seen END AS ended_between_start, CASE WHEN last_seen < hi THEN (SELECT min(d) FROM x WHERE d > last_seen) END AS ended_between_end FROM s, b")
def _(spark, sf_dir):
    rows = days(spark, sf_dir)
    spell = P.spells(rows.withColumn("o", F.col("d")), ["user_id", "org"], "d", "o")
    periods = rows.select("d").distinct().withColumn("ordinal", F.col("d"))
    return P.censored(spell, periods, "d").select("user_id", "org", "spell_index", "first_seen", "last_seen", "n_seen", "left_censored", "right_censored", "ended_between_start", "ended_between_end")


@query("W08_reentries", _SPELL + "SELECT user_id, org, count(*) AS n_spells FROM s GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    rows = days(spark, sf_dir)
    return P.reentries(P.spells(rows.withColumn("o", F.col("d")), ["user_id", "org"], "d", "o"), ["user_id", "org"])


@query("W09_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events")
def _(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return P.forward_fill(e, ["user_id"], ["ts", "event_id"], "v").select("event_id", "v")


@query("W10_min_rank", "SELECT n_nationkey, CAST(rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3) AS INTEGER) AS rank FROM nation")
def _(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", F.rank().over(Window.partitionBy("n_regionkey").orderBy(F.col("n_nationkey") % 3)).alias("rank"))


@query("W11_O26_republication", f"WITH x AS ({_DAYS}), p AS (SELECT d, count(*) AS rows, count(DISTINCT user_id) AS users FROM x GROUP BY d) SELECT d, rows, users, row_number() OVER (PARTITION BY rows, users ORDER BY d) > 1 AS republished FROM p")
def _(spark, sf_dir):
    return P.fingerprints(days(spark, sf_dir), "d", {"rows": F.count(F.lit(1)), "users": F.count_distinct("user_id")})


@query("W12_set_change", f"""
WITH x AS ({_DAYS}), e AS (SELECT user_id, min(d) AS a, max(d) AS b FROM x GROUP BY 1), m AS (SELECT x.user_id, org, bool_or(d = a) AS a, bool_or(d = b) AS b FROM x JOIN e USING (user_id) GROUP BY 1, 2)
SELECT user_id, CAST(sum(CAST(b AND NOT a AS INTEGER)) AS BIGINT) AS gained, CAST(sum(CAST(a AND NOT b AS INTEGER)) AS BIGINT) AS lost, CAST(sum(CAST(a AND b AS INTEGER)) AS BIGINT) AS kept FROM m GROUP BY 1""")
def _(spark, sf_dir):
    return P.set_change(days(spark, sf_dir), "user_id", "org", "d")


@query("W13_observation_span", f"WITH x AS ({_DAYS}) SELECT user_id, min(d) AS first, max(d) AS last, count(DISTINCT d) AS n_periods FROM x GROUP BY 1")
def _(spark, sf_dir):
    return P.observation_span(days(spark, sf_dir), "user_id", "d")


@query("W01_W03_W05_windows", "SELECT o_orderkey, row_number() OVER w AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS finished FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("finished"))


@query("C01_concurrent", f"WITH x AS ({_DAYS}), p AS (SELECT user_id, d, count(DISTINCT org) AS n FROM x GROUP BY 1, 2) SELECT user_id, max(n) AS most_orgs, CAST(sum(CAST(n > 1 AS INTEGER)) AS BIGINT) AS periods_with_several FROM p GROUP BY 1")
def _(spark, sf_dir):
    return P.concurrent(days(spark, sf_dir), "user_id", "d", "org")


@query("C02_participation", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count_distinct("o_custkey").alias("n"))


@query("C04_C05_activity_state", """
WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey, greatest(a.n, b.n) AS most, CASE WHEN greatest(a.n, b.n) > 0 THEN 'observed' WHEN c_nationkey < 10 THEN 'ascertainable_zero' ELSE 'unknown' END AS state FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def _(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.nullif(F.count_if(F.col("o_orderstatus") == "F"), F.lit(0)).alias("a"), F.nullif(F.count_if(F.col("o_orderstatus") == "O"), F.lit(0)).alias("b"))
    most = F.greatest("a", "b")
    return t(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", most.alias("most"), P.activity_state(most, F.col("c_nationkey") < 10).alias("state"))


@query("C06_effective_share", """
WITH p AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), q AS (SELECT *, sum(v) OVER (PARTITION BY l_partkey) AS total FROM p)
SELECT l_partkey, l_suppkey, round(CASE WHEN total > 0 THEN v / total END, 10) AS share, round(least(total / 100, 1.0) * CASE WHEN total > 0 THEN v / total END, 10) AS fte FROM q""")
def _(spark, sf_dir):
    per = t(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("l_quantity"))
    return P.effective_share(per, "l_partkey", "l_suppkey", "l_quantity").select("l_partkey", "l_suppkey", r("share", 10), r("fte", 10))


@query("C07_modal", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS n FROM events GROUP BY 1, 2) WHERE n = 1")
def _(spark, sf_dir):
    return P.modal(t(spark, sf_dir, "events").withColumn("w", F.lit(1)), "user_id", "event_type", "w")


@query("C08_projection", """
WITH RECURSIVE f AS (SELECT 2025 AS year, CAST(1000.0 AS DOUBLE) AS opening UNION ALL SELECT year + 1, opening - opening * 0.05 + 60.0 FROM f WHERE year < 2034)
SELECT year, round(opening, 6) AS opening, round(opening * 0.05, 6) AS exits, CAST(60.0 AS DOUBLE) AS entries, round(opening - opening * 0.05 + 60.0, 6) AS closing FROM f""")
def _(spark, sf_dir):
    return P.cohort_projection(spark, 1000.0, 60.0, 0.05, list(range(2025, 2035))).select("year", r("opening"), r("exits"), "entries", r("closing"))


_FAM = "WITH l AS (SELECT p_partkey AS id, p_brand, p_type, p_size FROM part), s AS (SELECT s_suppkey AS org, 'Brand#' || (1 + s_suppkey % 25) AS p_brand, CAST(1 + s_nationkey * 2 AS INTEGER) AS p_size, s_nationkey FROM supplier), pr AS (SELECT id, org, 'brand' AS family FROM l JOIN s USING (p_brand) UNION SELECT id, org, 'size' FROM l JOIN s USING (p_size) UNION SELECT id, org, 'brand_size' FROM l JOIN s USING (p_brand, p_size))"


def _org_pairs(spark, sf_dir, left: DataFrame) -> DataFrame:
    s = t(spark, sf_dir, "supplier")
    right = s.select(F.col("s_suppkey").alias("org"), F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 25).cast("string")).alias("p_brand"), (1 + F.col("s_nationkey") * 2).cast("int").alias("p_size"))
    return O.key_candidates(left, right, {"brand": ["p_brand"], "size": ["p_size"], "brand_size": ["p_brand", "p_size"]}, "id", "org")


def _parts(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size")


def org_pairs(spark, sf_dir) -> DataFrame:
    return _org_pairs(spark, sf_dir, _parts(spark, sf_dir))


def alike_org_pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The pairs of one part of each group with the same keys, and who stands for whom."""
    rows, members = J.alike(_parts(spark, sf_dir), "id", ["p_brand", "p_size"])
    return _org_pairs(spark, sf_dir, rows), members


@query("O01_key_candidates", _FAM + " SELECT family, count(*) AS n FROM pr GROUP BY 1")
def _(spark, sf_dir):
    return org_pairs(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("O02_promiscuity_cap", _FAM + " SELECT id, org, family FROM (SELECT *, count(*) OVER (PARTITION BY id, family) AS n FROM pr) WHERE n <= 3")
def _(spark, sf_dir):
    return O.cap_promiscuous(org_pairs(spark, sf_dir), "id", 3)


@query("O03_unique_strong", _FAM + " SELECT id, min(org) AS org FROM pr WHERE family = 'brand_size' GROUP BY id HAVING count(DISTINCT org) = 1")
def _(spark, sf_dir):
    return O.unique_key(org_pairs(spark, sf_dir), "id", "org", ["brand_size"])


@query("O04_multi_key", _FAM + ", g AS (SELECT id, org, count(DISTINCT family) AS f FROM pr GROUP BY 1, 2 HAVING count(DISTINCT family) >= 2) SELECT id, min(org) AS org, min(f) AS families FROM g GROUP BY id HAVING count(*) = 1")
def _(spark, sf_dir):
    pairs, members = alike_org_pairs(spark, sf_dir)
    return J.each(O.multi_key(pairs, "id", "org"), members, "id")


@query("O05_O08_tiers", _FAM + """
, a AS (SELECT id, min(org) AS org, 'unique_strong' AS tier FROM pr WHERE family = 'brand_size' GROUP BY id HAVING count(DISTINCT org) = 1),
r1 AS (SELECT * FROM pr WHERE id NOT IN (SELECT id FROM a)), g AS (SELECT id, org, count(DISTINCT family) AS f FROM r1 GROUP BY 1, 2 HAVING count(DISTINCT family) >= 2),
b AS (SELECT id, min(org) AS org, 'multi_key' AS tier FROM g GROUP BY id HAVING count(*) = 1), r2 AS (SELECT * FROM r1 WHERE id NOT IN (SELECT id FROM b)),
c AS (SELECT id, min(org) AS org, 'class_exclusion' AS tier FROM r2 WHERE family = 'brand_size' AND org NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) GROUP BY id HAVING count(DISTINCT org) = 1),
r3 AS (SELECT * FROM r2 WHERE id NOT IN (SELECT id FROM c)), d AS (SELECT id, min(org) AS org, 'weak' AS tier FROM r3 WHERE family = 'size' GROUP BY id HAVING count(DISTINCT org) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""")
def _(spark, sf_dir):
    bad = t(spark, sf_dir, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("org"))
    pairs, members = alike_org_pairs(spark, sf_dir)
    return O.resolve_tiers(pairs, "id", "org", ["brand_size"], ["size"], bad, members=members)


@query("O10_address_status", "SELECT c.c_custkey AS id, count(DISTINCT s_suppkey) AS n, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN min(s_suppkey) END AS org, CASE count(DISTINCT s_suppkey) WHEN 0 THEN 'no_match' WHEN 1 THEN 'unique_exact' ELSE 'multiple_plausible' END AS status, coalesce(string_agg(DISTINCT s_suppkey, '|' ORDER BY s_suppkey), '') AS orgs FROM customer c LEFT JOIN supplier s ON s_nationkey = c_nationkey GROUP BY 1")
def _(spark, sf_dir):
    left = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"))
    right = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("org"), F.col("s_nationkey").alias("k"))
    return O.address_status(left, right, ["k"], "id", "org")


@query("O11_O12_precedence", _FAM + ", k AS (SELECT *, CASE family WHEN 'brand_size' THEN 1 WHEN 'brand' THEN 2 ELSE 3 END AS rank FROM pr), m AS (SELECT *, min(rank) OVER (PARTITION BY id) AS best FROM k) SELECT id, min(rank) AS rank, count(DISTINCT org) AS n, CASE WHEN count(DISTINCT org) = 1 THEN min(org) END AS org FROM m WHERE rank = best GROUP BY id")
def _(spark, sf_dir):
    return O.precedence(org_pairs(spark, sf_dir), "id", "org", ["brand_size", "brand", "size"])


@query("O14_two_hop", "SELECT c_custkey, min(s_suppkey) AS org FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def _(spark, sf_dir):
    o = t(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    li, s, c = t(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey"), t(spark, sf_dir, "supplier", "s_suppkey"), t(spark, sf_dir, "customer", "c_custkey")
    rows = li.join(s, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").join(o, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("l_suppkey").alias("org"))
    return rows.join(c, "c_custkey", "left_semi")


@query("O17_rollup_arms", """
WITH a AS (SELECT l_suppkey, l_returnflag AS arm, l_shipdate, l_partkey, 'P' || l_partkey AS name FROM lineitem)
SELECT l_suppkey, first(name ORDER BY length(name) DESC, name) AS name, array_to_string(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), '|') AS ids, min(l_shipdate) AS least_evidence, max(l_shipdate) AS most_evidence, count(DISTINCT arm) AS n_arms FROM a GROUP BY 1""")
def _(spark, sf_dir):
    a = t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("arm"), "l_shipdate", "l_partkey", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"))
    return O.rollup_arms(a, ["l_suppkey"], "name", "l_partkey", "l_shipdate")


@query("O19_suppression", "SELECT n_regionkey, CASE WHEN count(*) >= 5 THEN count(*) END AS n, count(*) < 5 AS suppressed FROM nation WHERE n_nationkey > 7 GROUP BY 1")
def _(spark, sf_dir):
    per = t(spark, sf_dir, "nation").filter("n_nationkey > 7").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("c"))
    value, flag = O.suppress(F.col("c"), 5)
    return per.select("n_regionkey", value.alias("n"), flag.alias("suppressed"))


@query("O21_A11_share", "SELECT o_orderstatus, o_orderpriority, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    return O.share_within(t(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "o_orderstatus", "n").select("o_orderstatus", "o_orderpriority", r("share"))


@query("O22_R02_best_level", "SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) WHEN 1 THEN 'F' WHEN 2 THEN 'P' ELSE 'O' END AS o_orderstatus FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return O.best_level(t(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "P", "O"])


_CARD = "WITH x AS (SELECT DISTINCT strftime(l_shipdate, '%Y') AS p, l_partkey AS a, l_suppkey AS b FROM lineitem), c AS (SELECT *, count(*) OVER (PARTITION BY p, a) AS n_b_for_a, count(*) OVER (PARTITION BY p, b) AS n_a_for_b FROM x)"


def _card(spark, sf_dir) -> DataFrame:
    return O.cardinality_snapshot(t(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("p"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), "a", "b", "p")


@query("O24_W04_cardinality", _CARD + " SELECT * FROM c")
def _(spark, sf_dir):
    return _card(spark, sf_dir)


@query("O25_cardinality_ever", _CARD + " SELECT a, b, min(p) AS first_seen, max(p) AS last_seen, count(DISTINCT p) AS n_snapshots, bool_or(n_b_for_a = 1 AND n_a_for_b = 1) AS ever_unique, bool_or(NOT (n_b_for_a = 1 AND n_a_for_b = 1)) AS ever_ambiguous, arg_max(n_b_for_a, p) AS n_b_at_latest FROM c GROUP BY 1, 2")
def _(spark, sf_dir):
    return O.cardinality_ever(_card(spark, sf_dir), "a", "b", "p")


@query("O27_bands", "SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n BETWEEN 3 AND 9 THEN '3-9' ELSE '10+' END AS band, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def _(spark, sf_dir):
    per = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(O.cardinality_band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("customers"))


@query("O28_coverage_matrix", "SELECT c_custkey, f, o, CAST(f AS INTEGER) + CAST(o AS INTEGER) AS n_arms, CASE CAST(f AS INTEGER) + CAST(o AS INTEGER) WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'several' END AS class FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS f, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS o FROM customer)")
def _(spark, sf_dir):
    arm = lambda s: t(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    return O.coverage_matrix(t(spark, sf_dir, "customer"), {"f": arm("F"), "o": arm("O")}, "c_custkey")


@query("A01_A04_aggregates", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_tax > 0.04) AS taxed, max(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS open_most FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_tax") > 0.04).alias("taxed"), F.max(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("open_most"))


@query("A05_A07_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, greatest(count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'P')) - least(count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'P')) AS spread FROM orders GROUP BY 1")
def _(spark, sf_dir):
    wide = t(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    wide = wide.toDF("o_orderpriority", "f", "o", "p")
    return wide.withColumn("spread", F.greatest("f", "o", "p") - F.least("f", "o", "p"))


@query("A06_unpivot", "SELECT p_partkey, k, v FROM (SELECT p_partkey, unnest([{'k': 'p_brand', 'v': p_brand}, {'k': 'p_type', 'v': p_type}], recursive := true) FROM part)")
def _(spark, sf_dir):
    return t(spark, sf_dir, "part").unpivot("p_partkey", ["p_brand", "p_type"], "k", "v")


@query("A08_A09_sorted_strings", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities, arg_min(o_orderpriority, o_orderkey) AS first FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"), F.min_by("o_orderpriority", "o_orderkey").alias("first"))


@query("A10_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def _(spark, sf_dir):
    return t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


_WEIGHT = "WITH w AS (SELECT s_nationkey AS src, s_suppkey % 7 AS tgt, sum(s_acctbal + 2000) AS w FROM supplier GROUP BY 1, 2)"


def _weights(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 7).alias("tgt")).agg(F.sum(F.col("s_acctbal") + 2000).alias("w"))


@query("A12_A13_apportion", _WEIGHT + ", n AS (SELECT src, tgt, w / sum(w) OVER (PARTITION BY src) AS w FROM w), v AS (SELECT c_nationkey AS src, count(*) AS v FROM customer WHERE c_nationkey < 20 GROUP BY 1) SELECT tgt, round(CASE WHEN count(*) = count(v * w) THEN sum(v * w) END, 6) AS v FROM n LEFT JOIN v USING (src) GROUP BY 1")
def _(spark, sf_dir):
    values = t(spark, sf_dir, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("src")).agg(F.count(F.lit(1)).alias("v"))
    return G.apportion(values, G.normalised_weights(_weights(spark, sf_dir), "src", "w"), "src", "tgt", "v", "w").select("tgt", r("v"))


@query("A14_unique_mapping", _WEIGHT + " SELECT src, count(*) AS n, round(max(w) / sum(w), 6) AS top_share, CASE WHEN count(*) = 1 THEN min(tgt) END AS tgt FROM w GROUP BY 1")
def _(spark, sf_dir):
    return G.unique_mapping(_weights(spark, sf_dir), "src", "tgt", "w").select("src", "n", r("top_share"), "tgt")


@query("A15_dominant_mapping", _WEIGHT + " SELECT src, tgt, round(w, 4) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, tgt) AS n FROM w) WHERE n = 1")
def _(spark, sf_dir):
    return G.dominant_mapping(_weights(spark, sf_dir), "src", "tgt", "w").select("src", "tgt", r("w", 4))


@query("G02_hierarchy", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey WHEN c_nationkey < 10 THEN c_nationkey END AS place, CASE WHEN c_custkey % 3 = 0 THEN 'coordinate' WHEN c_nationkey < 10 THEN 'zip_unambiguous' ELSE 'none' END AS source FROM customer")
def _(spark, sf_dir):
    place, source = G.hierarchy(F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")), F.when(F.col("c_nationkey") < 10, F.col("c_nationkey")))
    return t(spark, sf_dir, "customer").select("c_custkey", place.alias("place"), source.alias("source"))


_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
_CONFLICT = """
WITH e AS (SELECT event_id, CAST(user_id AS BIGINT) * 40 + event_id // 3 % 40 AS key, 40 + (event_id * 7919 % 97) * 0.00012 AS lat, -80 + (event_id * 104729 % 89) * 0.00012 AS lon, CAST(event_id % 4 AS DOUBLE) AS quality FROM events),
s AS (SELECT a.key, max({km}) AS spread FROM e a JOIN e b USING (key) GROUP BY 1),
k AS (SELECT key, count(*) AS n, max(quality) AS top, min([lat, lon]) AS first FROM e GROUP BY 1),
q AS (SELECT e.key, count(*) AS n_top, min(e.lat) AS lat, min(e.lon) AS lon FROM e JOIN k ON e.key = k.key AND quality = top GROUP BY 1),
r AS (SELECT k.*, n_top, q.lat AS qlat, q.lon AS qlon, CASE WHEN n = 1 THEN 'unique' WHEN spread <= 1 THEN 'within_tolerance' WHEN n_top = 1 THEN 'by_quality' ELSE 'refused' END AS status FROM k JOIN s USING (key) JOIN q USING (key))
SELECT key, n, status, round(CASE status WHEN 'refused' THEN NULL WHEN 'by_quality' THEN qlat ELSE first[1] END, 6) AS lat, round(CASE status WHEN 'refused' THEN NULL WHEN 'by_quality' THEN qlon ELSE first[2] END, 6) AS lon FROM r""".replace("{km}", _KM.format(a="a", b="b"))


@query("G01_geocode_conflicts", _CONFLICT)
def _(spark, sf_dir):
    i = F.col("event_id")
    key = F.col("user_id").cast("long") * 40 + F.expr("event_id div 3") % 40
    e = t(spark, sf_dir, "events").select(key.alias("key"), (40 + (i * 7919 % 97) * 0.00012).alias("lat"), (-80 + (i * 104729 % 89) * 0.00012).alias("lon"), (i % 4).cast("double").alias("quality"))
    return G.resolve_conflicts(e, "key").select("key", "n", "status", r("lat"), r("lon"))


@query("J25_G07_points_in_polygons", "SELECT c_custkey, CAST(n_nationkey AS BIGINT) AS polygon_id FROM (SELECT c_custkey, c_acctbal / 1000.0 AS lon, (c_custkey % 97) / 10.0 AS lat FROM customer) JOIN nation ON lon >= n_nationkey % 5 * 2.03 AND lon < n_nationkey % 5 * 2.03 + 2.5 AND lat >= n_regionkey * 1.77 AND lat < n_regionkey * 1.77 + 1.5")
def _(spark, sf_dir):
    points = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("lon"), ((F.col("c_custkey") % 97) / 10.0).alias("lat"))
    x, y = F.col("n_nationkey") % 5 * F.lit(2.03), F.col("n_regionkey") * F.lit(1.77)
    ring = F.array(F.array(x, y), F.array(x + 2.5, y), F.array(x + 2.5, y + 1.5), F.array(x, y + 1.5))
    polygons = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("polygon_id"), ring.alias("ring"))
    return G.points_in_polygons(points, polygons).select("c_custkey", "polygon_id")


_NEAR = """
WITH p AS (SELECT c_custkey AS id, c_acctbal / 400.0 + 47 AS lat, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 97) / 97.0 - 180 ELSE (c_custkey % 97) / 97.0 * 0.7 + 179.3 END AS lon FROM customer),
o AS (SELECT s_suppkey AS origin_id, s_acctbal / 400.0 + 47 AS lat, (s_suppkey % 89) / 89.0 - 180 AS lon FROM supplier),
d AS (SELECT id, origin_id, {km} AS km FROM p a, o b)
SELECT id, origin_id, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, origin_id) AS n FROM d WHERE km <= 20) WHERE n = 1""".replace("{km}", _KM.format(a="a", b="b"))


@query("J28_nearest", _NEAR)
def _(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    pts = t(spark, sf_dir, "customer").select(k.alias("id"), (F.col("c_acctbal") / 400.0 + 47).alias("lat"), F.when(k % 2 == 0, (k % 97) / 97.0 - 180).otherwise((k % 97) / 97.0 * 0.7 + 179.3).alias("lon"))
    org = t(spark, sf_dir, "supplier").select(s.alias("origin_id"), (F.col("s_acctbal") / 400.0 + 47).alias("lat"), ((s % 89) / 89.0 - 180).alias("lon"))
    return G.nearest(pts, org, 20.0).select("id", "origin_id", r("km"))


@query("X01_X02_wilson_ppv", """
WITH p AS (SELECT l_returnflag, CAST(sum(CAST(l_tax > 0.02 AS INTEGER)) AS BIGINT) AS k, count(*) AS n FROM lineitem GROUP BY 1), q AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM p)
SELECT l_returnflag, k, n, round(p, 6) AS ppv, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS high FROM q""")
def _(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").withColumn("ok", F.col("l_tax") > 0.02)
    return X.ppv(rows, "l_returnflag", "ok").select("l_returnflag", "k", "n", r("ppv"), r("low"), r("high"))


@query("X03_smd", "SELECT round((avg(v) FILTER (g) - avg(v) FILTER (NOT g)) / sqrt((var_samp(v) FILTER (g) + var_samp(v) FILTER (NOT g)) / 2), 6) AS smd FROM (SELECT l_quantity AS v, l_returnflag = 'A' AS g FROM lineitem)")
def _(spark, sf_dir):
    return X.smd_continuous(t(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "A", "l_quantity").select(r("smd"))


@query("X04_ols", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem")
def _(spark, sf_dir):
    return X.ols(t(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity").select(r("slope", 4), r("intercept", 3), r("r2"), "n")


@query("X07_spearman", """
WITH x AS (SELECT *, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho FROM x""")
def _(spark, sf_dir):
    return X.spearman(t(spark, sf_dir, "lineitem", "l_quantity", "l_tax"), "l_quantity", "l_tax").select(r("rho"))


@query("X08_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS q2 FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return X.quantiles(t(spark, sf_dir, "lineitem"), "l_extendedprice", {"q1": 0.25, "q2": 0.5}, ["l_returnflag"]).select("l_returnflag", r("q1", 4), r("q2", 4))


@query("X09_rates", "SELECT l_returnflag, round(CASE WHEN count(*) >= 100 THEN sum(CAST(l_tax > 0.04 AS INTEGER)) / count(*) * 1000 END, 6) AS rate FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    per = t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_tax") > 0.04).alias("k"), F.count(F.lit(1)).alias("n"))
    return per.select("l_returnflag", F.round(X.rate_with_floor(F.col("k"), F.col("n"), 100), 6).alias("rate"))


@query("X11_table_block", "WITH p AS (SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'Unknown' END AS level, count(*) AS n FROM orders GROUP BY 1) SELECT CASE level WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS place, level, n, round(CASE WHEN level <> 'Unknown' THEN 100.0 * n / sum(CASE WHEN level <> 'Unknown' THEN n END) OVER () END, 6) AS pct FROM p")
def _(spark, sf_dir):
    return X.table_block(t(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"]).select("place", "level", "n", r("pct"))


@query("U01_U03_sets", "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def _(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "c_custkey"), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    n = lambda op, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n("union", c.union(o).distinct()).unionByName(n("intersect", c.intersect(o))).unionByName(n("except", c.subtract(o)))


@query("U05_flow", "SELECT s, count(*) AS n FROM (SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'kept' WHEN a IS NOT NULL THEN 'left' ELSE 'added' END AS s FROM (SELECT DISTINCT o_custkey AS k, 1 AS a FROM orders WHERE year(o_orderdate) = 1997) FULL JOIN (SELECT DISTINCT o_custkey AS k, 1 AS b FROM orders WHERE year(o_orderdate) = 1998) USING (k)) GROUP BY 1")
def _(spark, sf_dir):
    year = lambda y, n: t(spark, sf_dir, "orders").filter(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k"), F.lit(1).alias(n)).distinct()
    state = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "kept").when(F.col("a").isNotNull(), "left").otherwise("added")
    return year(1997, "a").join(year(1998, "b"), "k", "full").groupBy(state.alias("s")).agg(F.count(F.lit(1)).alias("n"))


@query("R01_R03_top_report", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def _(spark, sf_dir):
    return t(spark, sf_dir, "customer", "c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")).limit(20)


@query("T02_todo", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def _(spark, sf_dir):
    e = t(spark, sf_dir, "events", "event_id", "event_type")
    return todo(e, e.filter("event_type = 'click'"), "event_id").select("event_id")


@query("S16_json_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("S20_html_links", "SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS n_links, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def _(spark, sf_dir):
    links = F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    return t(spark, sf_dir, "pages").select("page_id", links.cast("long").alias("n_links"), F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"))


@query("H02_facility_counts", "SELECT s_nationkey, count(*) FILTER (s_acctbal >= 5000) AS yes, count(*) FILTER (s_acctbal < 5000) AS no, count(*) FILTER (s_acctbal IS NULL) AS unknown FROM supplier GROUP BY 1")
def _(spark, sf_dir):
    b = F.col("s_acctbal")
    return t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count_if(b >= 5000).alias("yes"), F.count_if(b < 5000).alias("no"), F.count_if(b.isNull()).alias("unknown"))


@query("H05_person_rollup", "SELECT o_custkey, count(*) AS n, bool_or(o_orderstatus = 'P') AS any_pending, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'mixed' END AS label FROM orders GROUP BY 1")
def _(spark, sf_dir):
    s = F.col("o_orderstatus")
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(s == "P").alias("any_pending"), F.when(F.count_distinct(s) == 1, F.min(s)).otherwise("mixed").alias("label"))


@query("H07_state_rollup", "SELECT n_regionkey, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, round(avg(CAST(c_acctbal > 5000 AS INTEGER)), 6) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, sf_dir):
    c, n = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.round(F.avg((F.col("c_acctbal") > 5000).cast("int")), 6).alias("share"))


@query("H16_disjoint_classes", "WITH u AS (SELECT DISTINCT o_custkey AS k, 'urgent' AS class FROM orders WHERE o_orderpriority = '1-URGENT'), r AS (SELECT DISTINCT o_custkey AS k, 'other' AS class FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_custkey NOT IN (SELECT k FROM u)) SELECT * FROM u UNION ALL SELECT * FROM r")
def _(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    return o.select("k", F.when(F.col("u"), "urgent").otherwise("other").alias("class"))
