"""Identity resolution over ``part`` as two registers: even keys are the roster, odd ones the register.

Some parts' names are written with a letter or a given name changed, so that fuzzy and
initial matches occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import linkage as L
from .registry import query


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    last = F.concat_ws("-", F.substring_index("p_name", " ", -1), "p_type")
    last = F.when(F.col("p_size") <= 10, F.concat(F.left(last, F.length(last) - 1), F.lit("x"))).otherwise(last)
    first = F.substring_index("p_name", " ", 1)
    first = F.when(F.col("p_size").between(11, 15), F.concat(F.left(first, F.lit(1)), F.lit("ane"))).otherwise(first)
    return p.select("p_partkey", first.alias("first"), F.substring(F.regexp_replace("p_brand", "[^0-9]", ""), 1, 1).alias("middle"), last.alias("last"), "p_type", "p_size", "p_brand")


def registers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = people(spark, sf_dir)
    k = lambda df: L.keyed(df, "p_partkey", "first", "middle", "last")
    return k(p.filter("p_partkey % 2 = 0")), k(p.filter("p_partkey % 2 = 1"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.candidates(*registers(spark, sf_dir)).withColumn("evidence_class", L.evidence_class(F.col("strategy"), F.col("middle_match")))


PEOPLE = """
WITH plain AS (SELECT *, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', -1) || '-' || p_type AS l FROM part),
people AS (
  SELECT p_partkey AS person, upper(CASE WHEN p_size BETWEEN 11 AND 15 THEN substr(f, 1, 1) || 'ane' ELSE f END) AS first, nullif(substr(regexp_replace(p_brand, '[^0-9]', '', 'g'), 1, 1), '') AS middle,
         upper(CASE WHEN p_size <= 10 THEN substr(l, 1, length(l) - 1) || 'x' ELSE l END) AS last, p_type, p_size FROM plain),
k AS (SELECT *, substr(first, 1, 1) AS initial, list_distinct(list_filter(string_split(regexp_replace(last, '[^A-Z'']+', ' ', 'g'), ' '), lambda t: length(t) >= 4)) AS tokens FROM people),
a AS (SELECT person AS id, first, middle, last, initial, tokens FROM k WHERE person % 2 = 0 AND first <> '' AND last <> ''),
b AS (SELECT person AS npi, first, middle, last, initial, tokens FROM k WHERE person % 2 = 1),
s AS (
  SELECT a.id, b.npi, 1 AS strategy, a.middle AS am, b.middle AS bm FROM a JOIN b ON a.last = b.last AND a.first = b.first
  UNION ALL SELECT a.id, b.npi, 2, a.middle, b.middle FROM a JOIN b ON a.last = b.last AND a.initial = b.initial AND a.first <> b.first
  UNION ALL SELECT a.id, b.npi, 3, a.middle, b.middle FROM a JOIN b ON a.first = b.first WHERE levenshtein(a.last, b.last) BETWEEN 1 AND 2 AND length(a.last) >= 5
  UNION ALL SELECT DISTINCT a.id, b.npi, 5, a.middle, b.middle
    FROM (SELECT *, unnest(tokens) AS t FROM a) a JOIN (SELECT *, unnest(tokens) AS t FROM b) b ON a.t = b.t AND a.first = b.first AND a.last <> b.last),
v AS (SELECT DISTINCT id, npi, strategy, CASE WHEN am = bm THEN 1 ELSE 0 END AS middle_match FROM s WHERE NOT coalesce(am <> bm, false)),
c AS (SELECT *, CASE WHEN strategy = 1 AND middle_match = 1 THEN 1 WHEN strategy = 1 THEN 2 WHEN strategy = 2 THEN 3 WHEN strategy = 3 THEN 4 ELSE 5 END AS evidence_class FROM v),
n AS (SELECT id, npi, min(evidence_class) AS evidence_class, max(middle_match) AS middle_match FROM c GROUP BY id, npi),
st AS (SELECT id, count(*) AS n_candidates, min(evidence_class) AS best_class, sum(CASE WHEN evidence_class = best THEN 1 ELSE 0 END)::BIGINT AS n_at_best
       FROM (SELECT *, min(evidence_class) OVER (PARTITION BY id) AS best FROM n) GROUP BY id),
r AS (SELECT n.id, n.npi, n.evidence_class, CASE WHEN n.evidence_class = 1 THEN 'unique_best_class_with_middle' ELSE 'unique_best_class' END AS resolution,
        CAST(CASE n.evidence_class WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.7 WHEN 4 THEN 0.5 ELSE 0.35 END AS DOUBLE) AS confidence
      FROM n JOIN st USING (id) WHERE n.evidence_class = st.best_class AND st.n_at_best = 1)
"""


def _strategy(n: int):
    return lambda spark, sf_dir: L.candidates(*registers(spark, sf_dir)).filter(F.col("strategy") == n).select("id", "npi", "middle_match")


for _name, _n in (("L01_exact", 1), ("L02_initial", 2), ("L03_fuzzy", 3), ("L04_surname_component", 5)):
    query(_name, PEOPLE + f"SELECT id, npi, middle_match FROM v WHERE strategy = {_n}")(_strategy(_n))


@query("L05_L06_classes_after_veto", PEOPLE + "SELECT evidence_class, count(*) AS n, count(DISTINCT id) AS ids FROM c GROUP BY evidence_class")
def _(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("evidence_class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("L07_per_npi", PEOPLE + "SELECT id, npi, evidence_class, middle_match FROM n")
def _(spark, sf_dir):
    rows, ids, npis = L.alike_pairs(*registers(spark, sf_dir))
    return J.spread(rows.select("id", "npi", "evidence_class", "middle_match"), ids, npis, ("id", "npi"))


@query("L08_pool_stats", PEOPLE + "SELECT * FROM st")
def _(spark, sf_dir):
    rows, ids, npis = L.alike_pairs(*registers(spark, sf_dir))
    sizes = npis.filter("npi = rep").select("npi", "n")
    return J.each(L.pool_stats(rows.join(sizes, "npi"), F.col("n")), ids, "id")


@query("L09_resolve_best_class", PEOPLE + "SELECT * FROM r")
def resolved(spark, sf_dir):
    return L.resolve_best_class(pairs(spark, sf_dir))


@query("L10_quarantine", PEOPLE + "SELECT DISTINCT id FROM n WHERE id NOT IN (SELECT id FROM r)")
def _(spark, sf_dir):
    return L.quarantined(pairs(spark, sf_dir))


@query("L11_L12_greedy_allocation", PEOPLE + "SELECT *, row_number() OVER (PARTITION BY npi ORDER BY confidence DESC, id) = 1 AS kept FROM r")
def _(spark, sf_dir):
    return L.greedy_allocation(resolved(spark, sf_dir))


@query("L13_contested_allocation", PEOPLE + "SELECT id, npi, count(*) OVER (PARTITION BY npi) AS claimants, CASE WHEN count(*) OVER (PARTITION BY npi) > 1 THEN 'ambiguous_contested' ELSE 'accepted' END AS status FROM r")
def _(spark, sf_dir):
    return L.contested_allocation(resolved(spark, sf_dir)).select("id", "npi", "claimants", "status")


_OWN = PEOPLE + """
, sc AS (SELECT id, npi, CAST(confidence_of AS DOUBLE) AS score, CASE WHEN middle_match = 1 THEN 'strong' WHEN evidence_class <= 2 THEN 'weak' ELSE 'none' END AS evidence
  FROM (SELECT *, CASE evidence_class WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.7 WHEN 4 THEN 0.5 ELSE 0.35 END AS confidence_of FROM n)),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, npi) AS place, lead(score) OVER (PARTITION BY id ORDER BY score DESC, npi) AS second, count(*) OVER (PARTITION BY id) AS n FROM sc)
SELECT id, npi, score, evidence, n,
  CASE WHEN score >= fl AND NOT (second IS NULL OR score - second >= 0.02) THEN 'ambiguous' WHEN score >= fl AND (evidence <> 'none' OR n = 1) THEN 'accept' WHEN score >= 0.75 THEN 'review' ELSE 'reject' END AS decision
FROM (SELECT *, CASE evidence WHEN 'strong' THEN 0.82 WHEN 'weak' THEN 0.88 ELSE 0.95 END AS fl FROM w) WHERE place = 1
"""


@query("L14_L16_own_evidence", _OWN)
def _(spark, sf_dir):
    rows, ids, npis = L.alike_pairs(*registers(spark, sf_dir))
    score = F.element_at(F.array(*map(F.lit, L.CONFIDENCE)), F.col("evidence_class").cast("int"))
    tier = F.when(F.col("middle_match") == 1, "strong").when(F.col("evidence_class") <= 2, "weak").otherwise("none")
    rows = rows.select("id", F.col("npi").alias("rep"), score.alias("score"), tier.alias("evidence")).join(L.two_least(npis), "rep")
    return J.each(L.own_evidence(rows, weight=F.col("weight")), ids, "id")


_TIER = PEOPLE + """
SELECT i.id, CASE WHEN r.npi IS NOT NULL AND r.evidence_class = 5 THEN 'name_component' WHEN r.npi IS NOT NULL AND r.evidence_class = 4 THEN 'fuzzy'
   WHEN r.npi IS NOT NULL AND t.kind = 'second' THEN 'second_class' WHEN r.npi IS NOT NULL AND t.kind = 'first' THEN 'primary'
   WHEN r.npi IS NOT NULL THEN 'unknown_class' WHEN q.id IS NOT NULL THEN 'quarantined' ELSE 'unmatched' END AS tier,
  CASE WHEN r.npi IS NOT NULL THEN 'one candidate at class ' || r.evidence_class WHEN q.id IS NOT NULL THEN 'several candidates at class ' || q.best_class ELSE 'no candidate' END AS reason
FROM (SELECT person AS id FROM people WHERE person % 2 = 0) i LEFT JOIN r USING (id) LEFT JOIN st q USING (id)
LEFT JOIN (SELECT person, CASE WHEN p_size <= 20 THEN 'first' WHEN p_size <= 40 THEN 'second' END AS kind FROM people) t ON t.person = r.npi
"""


@query("L18_L22_linkage_tier", _TIER)
def _(spark, sf_dir):
    roster, _ = registers(spark, sf_dir)
    pool = L.best_pool(pairs(spark, sf_dir)).withColumn("npi", F.when(F.col("low") == F.col("high"), F.col("low")))
    kind = people(spark, sf_dir).select(F.col("p_partkey").alias("npi"), F.when(F.col("p_size") <= 20, "first").when(F.col("p_size") <= 40, "second").alias("kind"))
    out = roster.select(F.col("person").alias("id")).join(pool, "id", "left").join(kind, "npi", "left")
    linked, best = F.col("npi").isNotNull(), F.col("best_class")
    ladder = [(best == 5, "name_component"), (best == 4, "fuzzy"), (F.col("kind") == "second", "second_class"), (F.col("kind") == "first", "primary")]
    said = F.when(linked, F.concat(F.lit("one candidate at class "), best.cast("string"))).when(best.isNotNull(), F.concat(F.lit("several candidates at class "), best.cast("string"))).otherwise("no candidate")
    return out.select("id", L.linkage_tier(linked, ladder, best.isNotNull(), "unknown_class").alias("tier"), said.alias("reason"))


@query("L25_key_cardinality", "SELECT p_brand, p_size, count(DISTINCT p_partkey) AS n FROM part GROUP BY p_brand, p_size")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand", "p_size").agg(F.count_distinct("p_partkey").alias("n"))


_WATER = """
WITH l AS (SELECT p_partkey AS id, p_brand, p_type, p_size, p_name FROM part WHERE p_partkey % 2 = 0), g AS (SELECT p_partkey AS npi, p_brand, p_type, p_size, p_name FROM part WHERE p_partkey % 2 = 1),
a AS (SELECT id, min(npi) AS npi, 'brand_type_size' AS tier FROM l JOIN g USING (p_brand, p_type, p_size) GROUP BY id HAVING count(DISTINCT npi) = 1),
b AS (SELECT id, min(npi) AS npi, 'name_brand' AS tier FROM l JOIN g USING (p_name, p_brand) WHERE id NOT IN (SELECT id FROM a) GROUP BY id HAVING count(DISTINCT npi) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b
"""


@query("L27_waterfall", _WATER)
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    left = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size", "p_name")
    right = p.filter("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "npi")
    tiers = [("brand_type_size", right.select("npi", "p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"]), ("name_brand", right.select("npi", "p_name", "p_brand"), ["p_name", "p_brand"])]
    return L.waterfall(left, tiers, "id", "npi")


@query("L28_collision_quarantine", "SELECT p_partkey FROM part WHERE (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM part GROUP BY p_brand, p_size HAVING count(DISTINCT p_name) > 1)")
def _(spark, sf_dir):
    return L.collision_quarantine(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_brand", "p_size"], "p_name")[1].select("p_partkey")


@query("L29_D03_slots_to_long", "SELECT p_partkey, slot, code FROM (SELECT p_partkey, unnest([{'slot': 1, 'code': p_brand}, {'slot': 2, 'code': p_type}, {'slot': 3, 'code': NULL}], recursive := true) FROM part) WHERE nullif(trim(code), '') IS NOT NULL")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("code_1"), F.col("p_type").alias("code_2"))
    return L.slots_to_long(p, "p_partkey", {"code": "code_"}, 3)


_FORMER = """
WITH x AS (SELECT p_partkey, upper(split_part(p_name, ' ', 2)) AS c, upper(split_part(p_name, ' ', 2) || ';' || p_type) AS f FROM part),
r AS (SELECT p_partkey, c AS surname, true AS cur, false AS frm FROM x UNION ALL SELECT p_partkey, trim(unnest(string_split(f, ';'))), false, true FROM x)
SELECT p_partkey, surname, CASE WHEN bool_or(cur) AND bool_or(frm) THEN 'both' WHEN bool_or(cur) THEN 'current' ELSE 'former' END AS kind FROM r WHERE surname <> '' GROUP BY p_partkey, surname
"""


@query("L30_former_names", _FORMER)
def former(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    last = F.element_at(F.split("p_name", " "), 2)
    return L.former_names(p.select("p_partkey", last.alias("last"), F.concat_ws(";", last, "p_type").alias("former")), "p_partkey", "last", "former")


@query("L31_former_names_joined", _FORMER.replace("SELECT p_partkey, surname, CASE", ", g AS (SELECT p_partkey, surname, CASE") + ") SELECT p_partkey, string_agg(surname, '|' ORDER BY surname) AS surnames, string_agg(kind, '|' ORDER BY surname) AS kinds FROM g GROUP BY 1")
def _(spark, sf_dir):
    return L.joined_names(former(spark, sf_dir), "p_partkey")


@query("L20_latest_attribute", "SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS n FROM events WHERE event_type IS NOT NULL) WHERE n = 1")
def _(spark, sf_dir):
    return L.latest_attribute(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type", "ts")


@query("L21_any_class_rollup", "SELECT user_id, bool_or(event_type = 'purchase') AS ever_purchase FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("ever_purchase"))


@query("L33_fitted_window", """
WITH g AS (SELECT event_type, value AS gap FROM events), o AS (SELECT event_type, count(gap) AS n, quantile_cont(gap, 0.1) AS l, quantile_cont(gap, 0.9) AS h FROM g GROUP BY event_type),
p AS (SELECT quantile_cont(gap, 0.1) AS l, quantile_cont(gap, 0.9) AS h FROM g)
SELECT o.event_type, n, round(CASE WHEN n >= 5 THEN o.l ELSE p.l END, 6) AS low, round(CASE WHEN n >= 5 THEN o.h ELSE p.h END, 6) AS high FROM o, p""")
def _(spark, sf_dir):
    out = L.fitted_window(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value")
    return out.select("event_type", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("L37_W02_top_two_margin", """
SELECT o_custkey, round(max(CASE WHEN n = 1 THEN o_totalprice END), 2) AS first, round(max(CASE WHEN n = 2 THEN o_totalprice END), 2) AS second,
  round(max(CASE WHEN n = 1 THEN o_totalprice END) - max(CASE WHEN n = 2 THEN o_totalprice END), 2) AS margin
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2 GROUP BY o_custkey""")
def _(spark, sf_dir):
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), F.col("o_orderkey").asc()))).filter("n <= 2")
    at = lambda k: F.max(F.when(F.col("n") == k, F.col("o_totalprice")))
    return o.groupBy("o_custkey").agg(F.round(at(1), 2).alias("first"), F.round(at(2), 2).alias("second"), F.round(at(1) - at(2), 2).alias("margin"))


@query("L39_identity_flips", """
SELECT id, a.v AS before, b.v AS after FROM (SELECT p_partkey AS id, p_brand AS v FROM part) a FULL JOIN (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'Brand#0' ELSE p_brand END AS v FROM part WHERE p_size > 1) b USING (id) WHERE a.v IS DISTINCT FROM b.v""")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    a = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("v"))
    b = p.filter("p_size > 1").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 40, "Brand#0").otherwise(F.col("p_brand")).alias("v"))
    return L.identity_flips(a, b, "id", "v")


@query("L40_best_slot", """
SELECT p_partkey, rank, CASE rank WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 2 END AS slot, CASE rank WHEN 1 THEN p_type WHEN 3 THEN p_type WHEN 2 THEN 'ECONOMY' ELSE 'PROMO' END AS code
FROM (SELECT *, CASE WHEN p_type = 'ECONOMY' THEN 1 WHEN p_size <= 10 THEN 2 WHEN p_type IN ('PROMO', 'SMALL') THEN 3 WHEN p_size >= 45 THEN 4 END AS rank FROM part) WHERE rank IS NOT NULL""")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    second = F.when(F.col("p_size") <= 10, "ECONOMY").when(F.col("p_size") >= 45, "PROMO").otherwise("-")
    slots = F.array(F.struct(F.lit(1).alias("slot"), F.col("p_type").alias("code"), F.lit(True).alias("is_primary")), F.struct(F.lit(2).alias("slot"), second.alias("code"), F.lit(False).alias("is_primary")))
    return p.select("p_partkey", L.best_slot(slots, ["ECONOMY"], ["PROMO", "SMALL"]).alias("s")).filter("s IS NOT NULL").select("p_partkey", "s.rank", "s.slot", "s.code")


def _contract(left: str, right: str, lk: str, rk: str, where: str = "true"):
    def run(spark, sf_dir):
        a = spark.read.parquet(f"{sf_dir}/{left}.parquet").select(F.col(lk).alias("k"))
        b = spark.read.parquet(f"{sf_dir}/{right}.parquet").filter(where).select(F.col(rk).alias("k"))
        return J.coverage(a, b, ["k"]).select("left_rows", "matched_rows", "out_rows", F.round("coverage", 6).alias("coverage"), F.round("fan_out", 6).alias("fan_out"))

    sql = f"""
WITH a AS (SELECT {lk} AS k FROM {left}), b AS (SELECT {rk} AS k, count(*) AS n FROM {right} WHERE {where} GROUP BY 1)
SELECT count(*) AS left_rows, count(b.n) AS matched_rows, CAST(sum(coalesce(b.n, 1)) AS BIGINT) AS out_rows, round(count(b.n) / count(*), 6) AS coverage, round(sum(coalesce(b.n, 1)) / count(*), 6) AS fan_out FROM a LEFT JOIN b USING (k)"""
    return run, sql


for _name, _args in {"J10_J14_coverage_orders_customer": ("orders", "customer", "o_custkey", "c_custkey"), "J11_coverage_customer_orders": ("customer", "orders", "c_custkey", "o_custkey"), "J12_coverage_lineitem_part": ("lineitem", "part", "l_partkey", "p_partkey", "p_size > 20")}.items():
    _run, _sql = _contract(*_args)
    query(_name, _sql)(_run)


@query("J01_J08_left_declared", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), "c_name")
    return J.left_join(o, c, ["k"]).select("o_orderkey", "c_name")


@query("J10_checked_left", "SELECT o_orderkey, c_name, n_name, CAST(c_custkey IS NULL AS INTEGER) AS unmatched FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), "c_name", F.col("c_nationkey").alias("n"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("n"), "n_name")
    out = J.checked_left_join(J.checked_left_join(o, c, ["k"], max_unmatched=0).rows, n, ["n"])
    return out.rows.select("o_orderkey", "c_name", "n_name", F.col("c_name").isNull().cast("int").alias("unmatched"))


_SMALL = "p_size > 20"


@query("J10_unmatched_report", f"SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE {_SMALL}) ORDER BY 1 LIMIT 5000")
def _(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("k"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").filter(_SMALL).select(F.col("p_partkey").alias("k"))
    return J.checked_left_join(li, p, ["k"], min_coverage=0.1).unmatched


@query("J11_checked_inner", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("k"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), "n_name")
    return J.checked_inner_join(s, n, ["k"], unique_left=False).rows.select("s_suppkey", "n_name")


@query("J12_checked_semi", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE {_SMALL})")
def _(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").filter(_SMALL).select(F.col("p_partkey").alias("k"))
    return J.checked_semi_join(li, p, ["k"], min_kept=0.3).rows.select("l_orderkey", "l_linenumber")


@query("J13_checked_anti", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 20)")
def _(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size <= 20").select(F.col("p_partkey").alias("k"))
    return J.checked_anti_join(li, p, ["k"], max_matched=0.6).rows.select("l_orderkey", "l_linenumber")


@query("J22_lookup", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("k"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), "n_name")
    return J.lookup(s, n, ["k"]).select("s_suppkey", "n_name")


@query("J03_full_outer_counts", "SELECT k, coalesce(a, 0) AS before, coalesce(b, 0) AS after FROM (SELECT c_custkey AS k, 1::BIGINT AS a FROM customer) FULL JOIN (SELECT o_custkey AS k, count(*) AS b FROM orders GROUP BY 1) USING (k)")
def _(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.lit(1).cast("long").alias("a"))
    b = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("before"), F.coalesce("b", F.lit(0)).alias("after"))


@query("J04_J12_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, sf_dir):
    return J.semi_join(*_cust(spark, sf_dir), ["c_custkey"])


@query("J05_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R')")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return J.anti_join(p, spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity = 50 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("J06_membership", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_order FROM customer")
def _(spark, sf_dir):
    return J.with_membership(*_cust(spark, sf_dir), ["c_custkey"], "has_order")


def _cust(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return c, spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"))


@query("J15_J16_key_problems", "SELECT o_custkey, o_orderstatus, count(*) AS rows, count(DISTINCT o_orderpriority) AS payloads FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    return J.key_problems(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderstatus", "o_orderpriority"), ["o_custkey", "o_orderstatus"])


@query("J17_token_join", PEOPLE + "SELECT DISTINCT a.id, b.npi FROM (SELECT *, unnest(tokens) AS t FROM a) a JOIN (SELECT *, unnest(tokens) AS t FROM b) b ON a.t = b.t AND a.first = b.first")
def _(spark, sf_dir):
    a, b = registers(spark, sf_dir)
    return J.token_join(a.withColumnRenamed("person", "id"), b.withColumnRenamed("person", "npi"), "tokens", ["first"], ("id", "npi"))


@query("J18_edit_join", PEOPLE + "SELECT a.id, b.npi FROM a JOIN b ON a.first = b.first WHERE levenshtein(a.last, b.last) BETWEEN 1 AND 2 AND length(a.last) >= 5 AND length(b.last) >= 5")
def _(spark, sf_dir):
    a, b = registers(spark, sf_dir)
    a, b = a.select("first", F.col("person").alias("id"), F.col("last").alias("la")), b.select("first", F.col("person").alias("npi"), F.col("last").alias("lb"))
    return J.edit_join(a, b, ("la", "lb"), ["first"]).select("id", "npi")


@query("J19_ordered_pairs", "SELECT a.user_id, a.event_type AS event_type_a, b.event_type AS event_type_b FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type")
def _(spark, sf_dir):
    return J.ordered_pairs(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type").distinct(), "user_id", "event_type")


@query("J20_J21_cascade", """
SELECT l.p_partkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'exact' WHEN b.v IS NOT NULL THEN 'loose' END AS v_source FROM part l
LEFT JOIN (SELECT p_brand, p_size, min(p_name) AS v FROM part WHERE p_size < 20 GROUP BY 1, 2) a USING (p_brand, p_size) LEFT JOIN (SELECT p_brand, min(p_name) AS v FROM part WHERE p_size < 5 GROUP BY 1) b USING (p_brand)""")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    exact = p.filter("p_size < 20").groupBy("p_brand", "p_size").agg(F.min("p_name").alias("v"))
    loose = p.filter("p_size < 5").groupBy("p_brand").agg(F.min("p_name").alias("v"))
    return J.cascade_join(p.select("p_partkey", "p_brand", "p_size"), [(exact, ["p_brand", "p_size"], "exact"), (loose, ["p_brand"], "loose")], "v").select("p_partkey", "v", "v_source")


@query("J07_renamed_keys", "SELECT l_orderkey, l_linenumber, o_orderdate AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus")
def _(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_linestatus")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("day"))
    return J.join_renamed(li, o, {"l_orderkey": "o_orderkey", "l_linestatus": "o_orderstatus"}, "inner").select("l_orderkey", "l_linenumber", "day")


@query("J21_period_then_ever", """
WITH s AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), e AS (SELECT o_custkey AS k, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
p AS (SELECT c_custkey AS k, 1992 + c_custkey % 7 AS y FROM customer)
SELECT p.k, coalesce(s.v, e.v) AS v, CASE WHEN s.v IS NOT NULL THEN 'snapshot' WHEN e.v IS NOT NULL THEN 'ever' END AS v_source FROM p LEFT JOIN s ON s.k = p.k AND s.y = p.y LEFT JOIN e ON e.k = p.k""")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("v"))
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), (1992 + F.col("c_custkey") % 7).cast("int").alias("y"))
    return J.cascade_join(p, [(o.groupBy("k", "y").agg(F.min("v").alias("v")), ["k", "y"], "snapshot"), (o.groupBy("k").agg(F.min("v").alias("v")), ["k"], "ever")], "v").select("k", "v", "v_source")
