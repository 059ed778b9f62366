"""Scored linkage, licence bridges, controls and organization affiliations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checks as C
from ..operators import joins as J
from ..operators import linkage as L
from ..operators import resolution as O
from ..operators import scoring as R
from .linkage_queries import PEOPLE, people
from .registry import query
from .table_queries import r, t

# Parts as people: even keys are the roster, odd ones the register; both meet on brand and a band of sizes.
_SIDES = """
WITH plain AS (SELECT *, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', -1) || '-' || p_type AS l FROM part),
x AS (SELECT p_partkey AS k, upper(CASE WHEN p_size BETWEEN 11 AND 15 THEN substr(f, 1, 1) || 'ane' ELSE f END) AS first, CASE WHEN p_size % 3 > 0 THEN substr(p_type, 1, 1) ELSE '' END AS middle,
  upper(CASE WHEN p_size <= 10 THEN substr(l, 1, length(l) - 1) || 'x' ELSE l END) AS last, p_brand || '/' || (p_size // 10) AS block, p_size, p_type FROM plain),
a AS (SELECT k AS id, first AS a_first, middle AS a_middle, last AS a_last, block FROM x WHERE k % 2 = 0),
b AS (SELECT k AS npi, first AS b_first, middle AS b_middle, last AS b_last, block, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'strong' WHEN p_type = 'PROMO' THEN 'weak' ELSE 'none' END AS evidence FROM x WHERE k % 2 = 1 AND p_size <> 50)
"""
_SIMILAR = _SIDES + """
, p AS (SELECT id, npi, a_first, b_first, a_middle, b_middle, a_last, b_last, evidence, a_middle <> '' AND b_middle <> '' AND a_middle <> b_middle AS conflict FROM a JOIN b USING (block)),
q AS (SELECT *, a_first = b_first AND a_last = b_last AND NOT conflict AS exact FROM p),
u AS (SELECT *, sum(CAST(exact AS INTEGER)) OVER (PARTITION BY id) AS n_exact FROM q),
v AS (SELECT *, exact AND n_exact = 1 AND evidence <> 'none' AS sure FROM u),
w AS (SELECT *, bool_or(sure) OVER (PARTITION BY id) AS settled, jaro_winkler_similarity(a_last, b_last) AS ls, jaro_winkler_similarity(a_first, b_first) AS fs FROM v),
c AS (SELECT *, 0.50 * ls + 0.38 * fs AS cheap, evidence <> 'none' AS shown FROM w WHERE NOT settled AND ls >= 0.70),
"""
_SHORT = """d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cheap DESC, npi, b_first, b_last, b_middle) AS pp, row_number() OVER (PARTITION BY id, shown ORDER BY cheap DESC, npi, b_first, b_last, b_middle) AS qq FROM c),
"""
_SCORE = """e AS (SELECT *, least(1.0, CASE WHEN a_middle = '' AND b_middle = '' THEN cheap / (0.50 + 0.38) ELSE cheap + 0.12 * CASE WHEN a_middle <> '' AND b_middle <> '' THEN 1.0 WHEN (a_middle <> '') <> (b_middle <> '') THEN 0.5 ELSE 0.0 END END
    + CASE WHEN a_last <> b_last AND list_has_any(list_filter(string_split(a_last, '-'), lambda z: length(z) >= 4), list_filter(string_split(b_last, '-'), lambda z: length(z) >= 4)) THEN 0.10 ELSE 0.0 END) AS score
"""
_BEST = """s AS (SELECT id, npi, CAST(1.0 AS DOUBLE) AS score, evidence, 'exact' AS stage FROM w WHERE sure UNION ALL SELECT id, npi, max(score), max(evidence), 'fuzzy' FROM e GROUP BY 1, 2)
"""
_SCORED = _SIMILAR + _SHORT + _SCORE + "  FROM d WHERE (pp <= 40 OR (shown AND qq <= 40)) AND NOT conflict),\n" + _BEST
# Without the shortlist.
_SCORED_ALL = _SIMILAR + _SCORE + "  FROM c WHERE NOT conflict),\n" + _BEST


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = people(spark, sf_dir)
    block = F.when(F.col("first").isNotNull() & F.col("p_type").isNotNull(), F.concat("p_brand", F.lit("/"), F.expr("CAST(p_size div 10 AS STRING)")))  # who lacks a name, type, brand or size meets nobody
    middle = F.when(F.col("p_size") % 3 > 0, F.left("p_type", F.lit(1))).otherwise("")
    x = p.select("p_partkey", F.upper("first").alias("first"), middle.alias("middle"), F.upper("last").alias("last"), block.alias("block"), "p_size", "p_type")
    evidence = F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "strong").when(F.col("p_type") == "PROMO", "weak").otherwise("none")
    a = x.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), "first", "middle", "last", "block")
    b = x.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("npi"), "first", "middle", "last", "block", evidence.alias("evidence"), (F.col("p_size") == 50).alias("vetoed"))
    return a, b


def _decided(spark, sf_dir) -> DataFrame:
    scored, members = R.score_alike(*_sides(spark, sf_dir), ["block"])
    return J.each(R.decide(scored), members, "id")


@query("L15_scored_candidates", _SCORED + "SELECT id, npi, round(score, 6) AS score, evidence, stage FROM s")
def _(spark, sf_dir):
    return R.score_candidates(*_sides(spark, sf_dir), ["block"]).select("id", "npi", r("score"), "evidence", "stage")


_DECISIONS = """
, m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, npi) AS place, lead(score) OVER (PARTITION BY id ORDER BY score DESC, npi) AS second, count(*) OVER (PARTITION BY id) AS n,
  CASE evidence WHEN 'strong' THEN 0.82 WHEN 'weak' THEN 0.88 ELSE 0.95 END AS fl FROM s WHERE stage = 'fuzzy'),
dec AS (SELECT id, npi, score, evidence, 'accept' AS decision FROM s WHERE stage = 'exact' UNION ALL
  SELECT id, npi, score, evidence, CASE WHEN score >= fl AND NOT (second IS NULL OR score - second >= 0.02) THEN 'ambiguous' WHEN score >= fl AND (evidence <> 'none' OR n = 1) THEN 'accept' WHEN score >= 0.75 THEN 'review' ELSE 'reject' END
  FROM m WHERE place = 1)
"""
_DECIDED = _SCORED + _DECISIONS


@query("L15_decisions", _DECIDED + "SELECT id, npi, evidence, decision FROM dec")
def _(spark, sf_dir):
    return _decided(spark, sf_dir).select("id", "npi", "evidence", "decision")


@query("L16_evidence", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(ECO|STAN)') OR contains(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), 'REDRING') THEN 'strong' WHEN regexp_matches(p_type, '^PROMO') OR contains(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), 'BOLT') THEN 'weak' ELSE 'none' END AS evidence FROM part")
def _(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", R.evidence_of(F.col("p_type"), F.col("p_name"), ("^(ECO|STAN)", "REDRING"), ("^PROMO", "BOLT")).alias("evidence"))


@query("L17_promotion", _SIDES + """
, dup AS (SELECT npi, b_first, b_last, evidence FROM b UNION ALL SELECT k, first, last, NULL FROM x WHERE FALSE),
sec AS (SELECT k AS npi, first, last FROM x WHERE k % 2 = 1 AND p_size % 4 = 0 UNION SELECT k, first, 'FORMER ' || last FROM x WHERE k % 2 = 1 AND p_size % 4 = 0)
SELECT npi, b_first AS first, b_last AS last, CASE WHEN npi IN (SELECT npi FROM sec) THEN 'strong' ELSE evidence END AS evidence FROM dup
UNION ALL SELECT npi, first, last, 'strong' FROM sec WHERE (npi, first, last) NOT IN (SELECT (npi, b_first, b_last) FROM b)""")
def _(spark, sf_dir):
    _, b = _sides(spark, sf_dir)
    listed = people(spark, sf_dir).filter("p_partkey % 2 = 1 AND p_size % 4 = 0").select(F.col("p_partkey").alias("npi"), F.upper("first").alias("first"), F.upper("last").alias("last"))
    second = listed.unionByName(listed.withColumn("last", F.concat(F.lit("FORMER "), F.col("last"))))
    return R.promote(b.filter("NOT vetoed"), second).select("npi", "first", "last", "evidence")


_KEYED = """
WITH ro AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 > 0 THEN 'N' || (c_nationkey % 5) END AS last FROM customer),
br AS (SELECT DISTINCT o_custkey AS id, o_orderpriority || '/' || (o_custkey % 40) AS key FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority < '3'),
li AS (SELECT p_partkey AS npi, CASE p_size % 2 WHEN 0 THEN '1-URGENT' ELSE '2-HIGH' END || '/' || (p_partkey % 60) AS key, 'N' || (p_partkey % 5) AS last FROM part WHERE p_size < 4),
kn AS (SELECT key, count(DISTINCT npi) AS n_npi FROM li GROUP BY 1),
j AS (SELECT br.id, br.key, li.npi, n_npi, coalesce(ro.last <> li.last, false) AS clash FROM br JOIN ro USING (id) LEFT JOIN li USING (key) LEFT JOIN kn USING (key)),
pe AS (SELECT id, count(DISTINCT key) AS n_keys, count(DISTINCT npi) AS n_candidates, count(DISTINCT CASE WHEN clash THEN npi END) AS n_conflicts, min(CASE WHEN n_npi = 1 AND NOT clash THEN npi END) AS np, min(CASE WHEN n_npi = 1 AND NOT clash THEN key END) AS ke FROM j GROUP BY 1),
bridge AS (SELECT ro.id, CASE WHEN n_candidates = 1 AND np IS NOT NULL THEN 'licence_exact' WHEN n_candidates IS NULL THEN 'no_licence' WHEN n_candidates = 0 THEN 'licence_not_found' WHEN n_candidates > 1 THEN 'licence_conflict' WHEN n_conflicts >= 1 THEN 'surname_conflict' ELSE 'unresolved' END AS status,
  CASE WHEN n_candidates = 1 THEN np END AS npi, CASE WHEN n_candidates = 1 AND np IS NOT NULL THEN ke END AS key, coalesce(n_keys, 0) AS n_keys, coalesce(n_candidates, 0) AS n_candidates FROM ro LEFT JOIN pe USING (id))
"""


def _bridge(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    roster = t(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 11 > 0, F.concat(F.lit("N"), (F.col("c_nationkey") % 5).cast("string"))).alias("last"))
    keys = t(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_orderpriority < '3'").select(F.col("o_custkey").alias("id"), F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("key")).distinct()
    p = F.col("p_partkey")
    licences = t(spark, sf_dir, "part").filter("p_size < 4").select(p.alias("npi"), F.concat_ws("/", F.when(F.col("p_size") % 2 == 0, "1-URGENT").otherwise("2-HIGH"), (p % 60).cast("string")).alias("key"), F.concat(F.lit("N"), (p % 5).cast("string")).alias("last"))
    return R.licence_bridge(roster, keys, licences)


@query("L24_licence_bridge", _KEYED + "SELECT * FROM bridge")
def _(spark, sf_dir):
    return _bridge(spark, sf_dir)


@query("L26_combined_tiers", _KEYED + """
, pr AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS npi FROM customer)
SELECT b.id, CASE WHEN b.npi <> pr.npi THEN NULL ELSE coalesce(b.npi, pr.npi) END AS npi, CASE WHEN b.npi <> pr.npi THEN 'conflicts_with_prior' WHEN b.npi IS NOT NULL THEN 'licence_exact' WHEN pr.npi IS NOT NULL THEN 'prior_match' ELSE 'unresolved' END AS method, b.npi IS NOT NULL AND pr.npi IS NULL AS rescued FROM bridge b LEFT JOIN pr USING (id)""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    return R.combine_tiers(_bridge(spark, sf_dir), t(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, k).alias("npi")))


def _authors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = t(spark, sf_dir, "part")
    last = F.concat("p_type", (F.col("p_size") % 5).cast("string"))
    names = F.split("p_name", " ")
    a = p.filter("p_size <= 25").select(F.col("p_partkey").alias("id"), last.alias("last"), F.concat(names, F.array("p_brand")).alias("given"))
    b = p.filter("p_size > 45").select(F.col("p_partkey").alias("author"), last.alias("last"), F.concat(F.reverse(names), F.array("p_brand")).alias("given"))
    return a, b


@query("L32_author_links", """
WITH pe AS (SELECT p_partkey AS id, p_type || (p_size % 5) AS last, list_append(string_split(p_name, ' '), p_brand) AS given FROM part WHERE p_size <= 25),
au AS (SELECT p_partkey AS author, p_type || (p_size % 5) AS last, list_append(list_reverse(string_split(p_name, ' ')), p_brand) AS given FROM part WHERE p_size > 45),
a AS (SELECT id, last, given[1] AS af, unnest(given) AS tok FROM pe), b AS (SELECT author, last, given[1] AS bf, unnest(given) AS tok FROM au),
j AS (SELECT id, author, max(CAST(tok = af AS INTEGER) + CAST(tok = bf AS INTEGER)) AS pos FROM a JOIN b USING (last, tok) GROUP BY 1, 2),
n AS (SELECT id, count(*) OVER (PARTITION BY last, given[1]) AS n_same_name FROM pe)
SELECT id, author, CASE pos WHEN 2 THEN 'both_first' WHEN 1 THEN 'one_first' ELSE 'both_middle' END AS position, n_same_name FROM j JOIN n USING (id)""")
def _(spark, sf_dir):
    return R.author_links(*_authors(spark, sf_dir))


_SHUFFLED = """
WITH h AS (SELECT p_partkey, p_brand, CAST(('0x' || substr(md5('control1:' || p_partkey), 1, 15)) AS BIGINT) AS h1, CAST(('0x' || substr(md5('control2:' || p_partkey), 1, 15)) AS BIGINT) AS h2 FROM part),
m AS (SELECT *, row_number() OVER (ORDER BY h1, p_partkey) AS n1, row_number() OVER (ORDER BY h2, p_partkey) AS n2 FROM h)
SELECT a.p_partkey, b.p_brand FROM m a JOIN m b ON a.n1 = b.n2"""


@query("L34_permuted_control", _SHUFFLED)
def _(spark, sf_dir):
    return R.permuted(t(spark, sf_dir, "part", "p_partkey", "p_brand"), "p_brand", "p_partkey")


@query("L35_unique_then_place", """
WITH c AS (SELECT c_custkey AS id, c_mktsegment AS name, c_nationkey AS place FROM customer), s AS (SELECT s_suppkey AS npi, CASE s_suppkey % 9 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'MACHINERY' WHEN 3 THEN 'HOUSEHOLD' ELSE 'S' || s_suppkey END AS name, s_nationkey AS place FROM supplier),
a AS (SELECT id, min(npi) AS npi, 'unique_name' AS tier FROM c JOIN s USING (name) GROUP BY 1 HAVING count(DISTINCT npi) = 1), b AS (SELECT id, min(npi) AS npi, 'name_and_place' AS tier FROM c JOIN s USING (name, place) WHERE id NOT IN (SELECT id FROM a) GROUP BY 1 HAVING count(DISTINCT npi) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def _(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("place"))
    k = F.col("s_suppkey")
    name = F.when(k % 9 == 0, "BUILDING").when((k % 9).isin(1, 2), "MACHINERY").when(k % 9 == 3, "HOUSEHOLD").otherwise(F.concat(F.lit("S"), k.cast("string")))
    s = t(spark, sf_dir, "supplier").select(k.alias("npi"), name.alias("name"), F.col("s_nationkey").alias("place"))
    return L.waterfall(c, [("unique_name", s.select("npi", "name"), ["name"]), ("name_and_place", s, ["name", "place"])], "id", "npi")


_STATE = "CASE WHEN a_middle = '' AND b_middle = '' THEN 'both_missing' WHEN b_middle = '' THEN 'missing_right' WHEN a_middle = '' THEN 'missing_left' WHEN a_middle = b_middle THEN 'initial_agreement' ELSE 'conflict' END"


@query("L36_perturbed_scores", _SCORED + f"""
, pm AS (SELECT s.*, {_STATE} AS state FROM s JOIN a USING (id) JOIN b USING (npi))
SELECT id, npi, state, round(score - CASE WHEN stage = 'fuzzy' AND state = 'missing_right' THEN 0.04 WHEN stage = 'fuzzy' AND state = 'missing_left' THEN 0.024 ELSE 0 END, 6) AS score_b FROM pm""")
def _(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    scored, members = R.score_alike(a, b, ["block"])
    rows = scored.join(a.select("id", F.col("middle").alias("ma")), "id").join(b.select("npi", F.col("middle").alias("mb")), "npi")
    rows = rows.withColumn("state", R.middle_state(F.col("ma"), F.col("mb")))
    rows = rows.select("id", "npi", "state", F.round(R.perturbed_score(F.col("score"), F.col("state"), F.col("stage") == "fuzzy"), 6).alias("score_b"))
    return J.each(rows, members, "id")


@query("L38_anchor_tiers", _SCORED_ALL + _DECISIONS + """
, an AS (SELECT id, decision, evidence, CASE WHEN npi % 4 = 0 OR npi % 4 = 1 THEN CASE WHEN pa.p_size = pn.p_size THEN 'zip' WHEN pa.p_type = pn.p_type THEN 'state' ELSE 'conflict' END ELSE 'not_available' END AS anchor
  FROM dec JOIN part pa ON pa.p_partkey = id JOIN part pn ON pn.p_partkey = npi)
SELECT id, anchor, CASE WHEN decision <> 'accept' THEN NULL WHEN anchor = 'zip' THEN 'Gold' WHEN anchor = 'state' THEN 'Silver' WHEN anchor = 'conflict' OR evidence = 'strong' THEN 'Bronze' ELSE 'Lead' END AS tier FROM an""")
def _(spark, sf_dir):
    place = lambda own, p: t(spark, sf_dir, "part").select(F.col("p_partkey").alias(own), F.col("p_size").cast("string").alias(f"{p}_zip"), F.concat(F.lit("type "), "p_type").alias(f"{p}_state"))
    decided, members = R.decide_alike(*_sides(spark, sf_dir), ["block"])
    rows = J.each(decided, members, "id").join(place("id", "a"), "id").join(place("npi", "b"), "npi")
    rows = rows.withColumn("anchor", R.anchor((F.col("npi") % 4).isin(0, 1), F.col("a_zip"), F.col("b_zip"), F.col("a_state"), F.col("b_state")))
    return rows.select("id", "anchor", R.anchor_tier(F.col("decision") == "accept", F.col("anchor"), F.col("evidence")).alias("tier"))


@query("L19_absence_demotion", PEOPLE + """
, ve AS (SELECT DISTINCT a.id, b.npi FROM a JOIN b ON a.last = b.last AND a.first = b.first WHERE coalesce(a.middle <> b.middle, false)),
ri AS (SELECT id, count(DISTINCT npi) AS n FROM ve GROUP BY 1)
SELECT r.id, r.evidence_class, coalesce(ri.n, 0) AS n_rivals, r.evidence_class = 5 AND coalesce(ri.n, 0) > 0 AND a.middle IS NULL AS demoted FROM r JOIN a USING (id) LEFT JOIN ri USING (id)""")
def _(spark, sf_dir):
    from .linkage_queries import registers, resolved

    a, b = registers(spark, sf_dir)
    vetoed = a.alias("a").join(b.alias("b"), ["last", "first"]).filter("a.middle <> b.middle").select(F.col("a.person").alias("id"), F.col("b.person").alias("npi")).distinct()
    out = L.absence_demotion(resolved(spark, sf_dir), vetoed, a)
    return out.select("id", "evidence_class", F.coalesce("n_rivals", F.lit(0)).alias("n_rivals"), "demoted")


@query("L23_invariants", "SELECT * FROM (VALUES ('same_ids', 0::BIGINT, true), ('same_rows', 0, true), ('unique', 0, true), ('one_class', 0, true)) v(rule, n, ok)")
def _(spark, sf_dir):
    b = _bridge(spark, sf_dir)
    found = F.col("npi").isNotNull()
    return C.invariants(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), b, "id", {"linked": found, "open": ~found})


@query("L41_vocabulary", "SELECT id, CASE status WHEN 'licence_exact' THEN 'confirmed' WHEN 'licence_conflict' THEN 'review' WHEN 'surname_conflict' THEN 'review' ELSE 'none' END AS word FROM (" + _KEYED + "SELECT * FROM bridge)")
def _(spark, sf_dir):
    return _bridge(spark, sf_dir).select("id", R.vocabulary(F.col("status"), {"licence_exact": "confirmed", "licence_conflict": "review", "surname_conflict": "review"}, "none").alias("word"))


@query("J24_quota_join", """
WITH w AS (SELECT event_type, CAST(user_id % 3 AS INTEGER) AS bin, count(*) AS n_want FROM events WHERE value > 20 GROUP BY 1, 2),
q AS (SELECT e.event_id, e.event_type, CAST(user_id % 3 AS INTEGER) AS bin, row_number() OVER (PARTITION BY e.event_type, user_id % 3 ORDER BY event_id) AS n FROM events e WHERE value <= 20)
SELECT event_id, event_type, bin FROM q JOIN w USING (event_type, bin) WHERE n <= n_want""")
def _(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 3).cast("int").alias("bin"), "value")
    wanted = e.filter("value > 20").groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n_want"))
    return R.quota_sample(e.filter("value <= 20"), wanted, ["event_type", "bin"], "event_id").select("event_id", "event_type", "bin")


# ---------------------------------------------------------------- organizations

_FAMILIES = "WITH l AS (SELECT p_partkey AS id, p_brand, p_type, p_size FROM part), s AS (SELECT s_suppkey AS org, 'Brand#' || (1 + s_suppkey % 25) AS p_brand, CAST(1 + s_nationkey * 2 AS INTEGER) AS p_size, s_nationkey FROM supplier), pr AS (SELECT id, org, 'brand' AS family FROM l JOIN s USING (p_brand) UNION SELECT id, org, 'size' FROM l JOIN s USING (p_size) UNION SELECT id, org, 'brand_size' FROM l JOIN s USING (p_brand, p_size))"


@query("O06_cross_source", _FAMILIES + """
, sup AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS org FROM lineitem WHERE l_quantity >= 45),
x AS (SELECT id, min(org) FILTER (family = 'brand_size') AS a, max(org) FILTER (family = 'brand_size') AS b FROM pr GROUP BY 1), f AS (SELECT id, org, count(DISTINCT family) AS n FROM pr GROUP BY 1, 2), m AS (SELECT id, min(org) AS a, max(org) AS b FROM f WHERE n >= 2 GROUP BY 1),
z AS (SELECT id, min(org) AS a, max(org) AS b FROM pr JOIN sup USING (id, org) GROUP BY 1), y AS (SELECT id, min(org) AS a, max(org) AS b FROM pr WHERE family = 'size' GROUP BY 1)
SELECT id, org, tier FROM (SELECT x.id, CASE WHEN x.a = x.b THEN x.a WHEN m.a = m.b THEN m.a WHEN z.a = z.b THEN z.a WHEN y.a = y.b THEN y.a END AS org,
  CASE WHEN x.a = x.b THEN 'unique_strong' WHEN m.a = m.b THEN 'multi_key' WHEN z.a = z.b THEN 'cross_source' WHEN y.a = y.b THEN 'weak' END AS tier FROM x LEFT JOIN m USING (id) LEFT JOIN z USING (id) LEFT JOIN y USING (id)) WHERE tier IS NOT NULL""")
def _(spark, sf_dir):
    from .table_queries import alike_org_pairs

    second = t(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("org"))
    pairs, members = alike_org_pairs(spark, sf_dir)
    return O.resolve_tiers(pairs, "id", "org", ["brand_size"], ["size"], agreed=second, members=members)


@query("O09_distribution_shift", "SELECT k AS org, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, coalesce(b.n, 0) - coalesce(a.n, 0) AS gain FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1) b USING (k)")
def _(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("org"), (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")).alias("early"))
    return O.distribution_shift(li.filter("early"), li.filter("NOT early"), "org")


@query("O13_without_deactivated", "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS d, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 3 - 1) END AS r FROM orders) SELECT o_orderkey FROM x WHERE d IS NULL OR (r IS NOT NULL AND r >= d)")
def _(spark, sf_dir):
    back = F.expr("o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 3 - 1 AS INT))")
    o = t(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))).withColumn("re", F.when(F.col("o_orderstatus") == "P", back))
    return O.without_deactivated(o, "d", "re").select("o_orderkey")


@query("O15_location_pick", "SELECT k, state, city, zip FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY state NULLS LAST, city NULLS LAST, zip NULLS LAST) AS n FROM (SELECT DISTINCT o_custkey AS k, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS state, o_orderpriority AS city, CAST(o_orderkey % 9 AS INTEGER) AS zip FROM orders)) WHERE n = 1")
def _(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    rows = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), state.alias("state"), F.col("o_orderpriority").alias("city"), (F.col("o_orderkey") % 9).cast("int").alias("zip"))
    return O.pick_first(rows, "k", ["state", "city", "zip"])


@query("O16_affiliation_strength", "SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN 'target_unidentified' WHEN s_nationkey % 4 = 0 THEN 'confirmed_solo_practitioner' ELSE 'confirmed_billing' END AS strength FROM supplier")
def _(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", O.affiliation_strength(F.col("s_acctbal") > 0, F.col("s_nationkey") % 4 == 0).alias("strength"))


_ARMS = "SELECT l_suppkey AS a, l_partkey % 500 AS b, bool_or(l_returnflag = 'A') AS fa, bool_or(l_returnflag = 'R' AND l_quantity > 25) AS fr, bool_or(l_linestatus = 'F' AND l_discount > 0.08) AS ff FROM lineitem GROUP BY 1, 2"


@query("O18_affiliation_classes", f"SELECT a, b, CASE WHEN CAST(fa AS INTEGER) + CAST(fr AS INTEGER) + CAST(ff AS INTEGER) >= 2 THEN 'several_sources' WHEN fa THEN 'reassigned_only' WHEN fr THEN 'listed_only' WHEN ff THEN 'facility_only' ELSE 'unresolved' END AS class, CASE WHEN (fa OR fr) AND ff THEN 'both_layers' WHEN fa OR fr THEN 'billing_only' WHEN ff THEN 'place_only' ELSE 'none' END AS layer FROM ({_ARMS})")
def _(spark, sf_dir):
    flag, any_ = F.col("l_returnflag"), F.bool_or
    arms = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 500).alias("b")).agg(any_(flag == "A").alias("fa"), any_((flag == "R") & (F.col("l_quantity") > 25)).alias("fr"), any_((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.08)).alias("ff"))
    kind, layer = O.affiliation_classes({"reassigned": F.col("fa"), "listed": F.col("fr")}, {"facility": F.col("ff")})
    return arms.select("a", "b", kind.alias("class"), layer.alias("layer"))


_SOURCES = "SELECT DISTINCT o_custkey AS id, o_orderstatus AS source, arg_min(o_orderpriority, o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS name, CASE WHEN (min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus)) % 5 > 0 THEN (min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus)) % 4 END AS org FROM orders"


@query("O20_reconciliation", f"""
WITH x AS ({_SOURCES})
SELECT a.id, a.source AS source_a, b.source AS source_b, CASE WHEN a.org = b.org AND a.name = b.name THEN 'same_identity' WHEN a.org = b.org THEN 'renamed_identity' WHEN (a.org IS NULL OR b.org IS NULL) AND a.name = b.name THEN 'same_name_unidentified'
  WHEN a.org IS NULL OR b.org IS NULL THEN 'one_side_unidentified' WHEN a.name = b.name THEN 'same_name_new_identity' ELSE 'different' END AS class FROM x a JOIN x b ON a.id = b.id AND a.source < b.source""")
def _(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("source")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("name"), F.min("o_orderkey").alias("k"))
    return O.reconcile_names(o.withColumn("org", F.when(F.col("k") % 5 > 0, F.col("k") % 4)), "id", "source", "name", "org")


@query("O23_conserved", "SELECT CAST(NULL AS VARCHAR) AS o_orderpriority, CAST(NULL AS VARCHAR) AS o_orderstatus, 0::BIGINT AS before, 0::BIGINT AS after WHERE FALSE UNION ALL SELECT o_orderpriority, o_orderstatus, count(*), CAST(sum(CASE WHEN o_totalprice > 40000 THEN 1 ELSE 0 END) AS BIGINT) FROM orders GROUP BY 1, 2 HAVING count(*) <> sum(CASE WHEN o_totalprice > 40000 THEN 1 ELSE 0 END)")
def _(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return C.conserved(o, o.filter("o_totalprice > 40000"), ["o_orderpriority", "o_orderstatus"])


_HOSP = """
WITH p AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS org FROM lineitem WHERE l_quantity = 50), e AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS org FROM lineitem WHERE l_quantity BETWEEN 46 AND 49), n AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS org FROM lineitem WHERE l_quantity < 10),
pp AS (SELECT id, min(org) AS p FROM p GROUP BY 1), ee AS (SELECT id, min(org) AS e FROM e GROUP BY 1), nn AS (SELECT id, min(org) AS s, count(DISTINCT org) AS k FROM n GROUP BY 1),
h AS (SELECT p_partkey AS id, coalesce(p, e, CASE WHEN k = 1 THEN s END) AS org, CASE WHEN p IS NOT NULL THEN 'privilege' WHEN e IS NOT NULL THEN 'exact_address' WHEN k = 1 THEN 'sole_nearby' WHEN k > 1 THEN 'several_nearby' ELSE 'none' END AS tier
  FROM part LEFT JOIN pp ON pp.id = p_partkey LEFT JOIN ee ON ee.id = p_partkey LEFT JOIN nn ON nn.id = p_partkey)
"""


def _attributed(spark, sf_dir) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("org"), "l_quantity")
    q = F.col("l_quantity")
    return O.attribution(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), li.filter(q == 50), li.filter(q.between(46, 49)), li.filter(q < 10), "id", "org")


@query("O29_match_with_enrolment", _HOSP + "SELECT id, org, tier, org IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AS enrolled FROM h WHERE org IS NOT NULL")
def _(spark, sf_dir):
    listed = t(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("org"), F.lit(True).alias("e"))
    return _attributed(spark, sf_dir).filter("org IS NOT NULL").join(listed, "org", "left").select("id", "org", "tier", F.coalesce("e", F.lit(False)).alias("enrolled"))


@query("O30_attribution", _HOSP + "SELECT * FROM h")
def _(spark, sf_dir):
    return _attributed(spark, sf_dir)


@query("O31_latest_reported", "SELECT o_custkey, y, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC, n DESC, o_orderpriority) AS k FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2, 3)) WHERE k = 1")
def _(spark, sf_dir):
    return O.latest_reported(t(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), "o_custkey", "y", "o_orderpriority")


_CAUSES = [("source_differs", "l_discount > 0.08"), ("same_name", "l_returnflag = 'N' AND l_quantity > 40"), ("same_address", "l_tax = 0.02"), ("weak_key", "l_linenumber > 5")]


@query("O32_disagreement_causes", "SELECT l_orderkey, l_linenumber, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _CAUSES) + " ELSE 'other' END AS primary_cause, coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CAUSES) + "], lambda z: z IS NOT NULL), '+'), ''), 'other') AS causes FROM lineitem")
def _(spark, sf_dir):
    first, every = O.first_cause([(F.expr(c), n) for n, c in _CAUSES])
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", first.alias("primary_cause"), every.alias("causes"))


@query("O33_by_priority", "SELECT c_custkey, coalesce(a, b, c) AS v, CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' WHEN c IS NOT NULL THEN 'third' END AS source FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS a, CASE WHEN c_nationkey < 8 THEN 'N' || c_nationkey END AS b, CASE WHEN c_acctbal > 0 THEN 'balance' END AS c FROM customer)")
def _(spark, sf_dir):
    a, b, c = F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).otherwise(" "), F.when(F.col("c_nationkey") < 8, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))), F.when(F.col("c_acctbal") > 0, "balance")
    value, source = O.by_priority([("first", a), ("second", b), ("third", c)])
    return t(spark, sf_dir, "customer").select("c_custkey", value.alias("v"), source.alias("source"))


@query("F36_building_types", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'main_campus' WHEN c_nationkey = 4 OR c_custkey % 50 = 0 THEN 'birth_centre' WHEN c_custkey % 7 = 0 THEN 'medical_office' ELSE 'clinic' END AS kind FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    address = F.when(k % 50 == 0, "8 Quarry Rd Birthing Center").when(k % 7 == 0, "9 Quarry Medical Plaza").otherwise("10 Quarry Rd")
    return t(spark, sf_dir, "customer").select("c_custkey", O.building_type(address, F.col("c_nationkey") == 3, F.col("c_nationkey") == 4).alias("kind"))


@query("F37_sentences", "SELECT n_nationkey, n_name || ' ranks ' || rk || ' of ' || total || ' with ' || n || ' customers' || CASE WHEN n >= 60 THEN ', one of the largest' ELSE '' END || '.' AS sentence FROM (SELECT n_nationkey, n_name, count(c_custkey) AS n, rank() OVER (ORDER BY count(c_custkey) DESC) AS rk, count(*) OVER () AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)")
def _(spark, sf_dir):
    from pyspark.sql import Window

    per = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = t(spark, sf_dir, "nation", "n_nationkey", "n_name").join(per, "n_nationkey", "left").na.fill(0, ["n"])  # a row a nation
    rows = rows.withColumn("rk", F.rank().over(Window.orderBy(F.col("n").desc()))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    return rows.select("n_nationkey", S.sentence("{n_name} ranks {rk} of {total} with {n} customers", F.when(F.col("n") >= 60, "one of the largest")).alias("sentence"))


@query("F08_F11_person_names", "SELECT p_partkey, upper(split_part(p_name, ' ', 2)) AS first, CASE WHEN p_size > 25 THEN upper(p_type) END AS middle, upper(split_part(p_name, ' ', 1)) AS last, trim(p_name || ' ' || p_type) AS plain, upper(p_name) || ' ' || p_size AS normal FROM part")
def _(spark, sf_dir):
    a, b = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    written = F.when(F.col("p_size") > 25, F.concat_ws(" ", F.concat(a, F.lit(",")), b, "p_type", F.lit("MSN"))).otherwise(F.concat_ws(" ", F.lit("Dr."), b, a, F.lit("RN")))
    noisy = F.concat_ws(" ", F.lit("Mrs."), "p_name", "p_type", F.lit("PhD"))
    return t(spark, sf_dir, "part").select("p_partkey", S.parse_person(written).alias("n"), S.strip_name_noise(noisy).alias("plain"), S.normalise_text(F.concat_ws("--", "p_name", F.col("p_size").cast("string"))).alias("normal")).select("p_partkey", "n.first", "n.middle", "n.last", "plain", "normal")


@query("F10_person_matches", "SELECT a.p_partkey, a.p_type = b.p_type AND list_has_any(string_split(a.p_name, ' '), string_split(b.p_name, ' ')) AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(spark, sf_dir):
    p = t(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n"), F.col("p_type").alias("t"))
    return p.join(b, "p_partkey").select("p_partkey", S.same_person(F.col("p_type"), F.col("p_name"), F.col("t"), F.col("n")).alias("same"))


@query("F02_F23_F26_keys", "SELECT s_suppkey, s_nationkey % 2 = 0 AS named, CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey || ' QUARRY ST_OH' END AS key, 'ACADEMY OF ARTS AND ' || upper(s_name) AS school FROM supplier")
def _(spark, sf_dir):
    street = F.when(F.col("s_nationkey") % 2 == 0, F.concat_ws(" ", F.col("s_suppkey").cast("string"), F.lit("Quarry Street Apt 4"))).otherwise("  ")
    return t(spark, sf_dir, "supplier").select("s_suppkey", S.has_name(street).alias("named"), S.address_key(street, F.lit(" oh")).alias("key"), S.school(F.concat(F.lit("The Academy of  Arts & "), F.col("s_name"))).alias("school"))


@query("F24_standard_addresses", "SELECT s_suppkey, s_suppkey || ' N QUARRY TER STE ' || s_nationkey || CASE WHEN s_nationkey > 12 THEN ' NW' ELSE '' END AS street FROM supplier")
def _(spark, sf_dir):
    street = F.concat_ws(" ", F.col("s_suppkey").cast("string"), F.lit("North Quarry Terrace, Suite"), F.col("s_nationkey").cast("string"), F.when(F.col("s_nationkey") > 12, "Northwest"))
    return t(spark, sf_dir, "supplier").select("s_suppkey", S.standard_address(street).alias("street"))


@query("F29_other_bands", "SELECT p_partkey, CASE WHEN p_size < 5 THEN '<5 years' WHEN p_size < 10 THEN '5-9 years' WHEN p_size < 15 THEN '10-14 years' ELSE '>=15 years' END AS observed, CASE WHEN p_size BETWEEN 1 AND 3 THEN 'Metropolitan (RUCC 1-3)' WHEN p_size BETWEEN 4 AND 6 THEN 'Nonmetropolitan, adjacent (RUCC 4-6)' WHEN p_size BETWEEN 7 AND 9 THEN 'Nonmetropolitan, remote (RUCC 7-9)' END AS rural, CASE WHEN p_size < 35 THEN '<35' WHEN p_size < 45 THEN '35-44' ELSE '45-54' END AS age, CAST(p_size // 10 * 10 AS VARCHAR) || 's' AS decade FROM part")
def _(spark, sf_dir):
    x = F.col("p_size")
    return t(spark, sf_dir, "part").select("p_partkey", S.band_years_observed(x).alias("observed"), S.band_rurality(x).alias("rural"), S.band_age(x).alias("age"), S.decade(x).alias("decade"))


@query("F30_transliteration", "SELECT n_nationkey, 'AAEOUNSZCL' || upper(n_name) AS k FROM nation")
def _(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", S.transliterate(F.concat(F.lit("āÅệőǚñșżčł"), F.col("n_name"))).alias("k"))


@query("F19_zip_rules", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS padded, CASE WHEN c_custkey % 2 = 0 THEN substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 1, 5) END AS run FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    run = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ZIP "), F.lpad(k, 9, "0"))).otherwise("no 123")
    return t(spark, sf_dir, "customer").select("c_custkey", S.zip5_padded(k).alias("padded"), S.zip5_first_run(run).alias("run"))


@query("P11_P13_predicates", "SELECT p_partkey FROM part WHERE upper(p_name) LIKE '%RING%' AND (p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') OR p_type IN ('Brand#1', 'Brand#2', 'Brand#3') OR p_type = 'ECONOMY') AND NOT regexp_matches(p_type, '^(PRO|LAR)')")
def _(spark, sf_dir):
    p = t(spark, sf_dir, "part").filter(F.upper("p_name").like("%RING%"))
    slots, wanted = F.array("p_brand", "p_type"), F.array(*map(F.lit, ("Brand#1", "Brand#2", "Brand#3", "ECONOMY")))
    return O.without_prefixes(p.filter(F.arrays_overlap(slots, wanted)), "p_type", ["PRO", "LAR"]).select("p_partkey")


@query("P03_across", "SELECT l_orderkey, l_linenumber, round(l_quantity * 2, 4) AS l_quantity, round(l_discount * 2, 4) AS l_discount, round(l_tax * 2, 4) AS l_tax FROM lineitem")
def _(spark, sf_dir):
    return S.across(t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"], lambda c: F.round(c * 2, 4))


@query("P15_constant_columns", "SELECT 'r' AS column, 2 AS values UNION ALL SELECT 'fixed', 1 UNION ALL SELECT 'none', 0")
def _(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("r"), F.lit(7).alias("fixed"), F.lit(None).cast("string").alias("none"))
    return C.non_constant(li, ["r", "fixed", "none"])


def _pct(spark, sf_dir) -> DataFrame:
    o = t(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 200000).alias("num"), F.count(F.lit(1)).alias("den"))
    return o.withColumn("pct", 100.0 * F.col("num") / F.col("den"))


@query("X13_table_rules", "SELECT * FROM (VALUES ('pct_in_range', 0::BIGINT, true), ('num_within_den', 0, true), ('not_negative', 0, true)) v(rule, n, ok)")
def _(spark, sf_dir):
    return C.rule_counts(_pct(spark, sf_dir), C.table_rules("num", "den", "pct"))


@query("X13_strata_sum", "SELECT o_orderstatus, count(*) AS parts, count(*) AS whole, true AS ok FROM orders GROUP BY 1")
def _(spark, sf_dir):
    whole = t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("den"))
    return C.strata_sum(_pct(spark, sf_dir), whole, ["o_orderstatus"], "den")


@query("U04_partition", "SELECT * FROM (VALUES ('covered', 0::BIGINT, true), ('disjoint', 0, true), ('inside', 0, true)) v(rule, n, ok)")
def _(spark, sf_dir):
    o = t(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return C.set_partition(o, {s: o.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}, "o_orderkey")


@query("V09_same_keys", "SELECT * FROM (VALUES ('same_ids', (SELECT count(*) FROM customer WHERE c_acctbal < 0), (SELECT count(*) FROM customer WHERE c_acctbal < 0) = 0), ('same_rows', (SELECT count(*) FROM customer WHERE c_acctbal < 0), (SELECT count(*) FROM customer WHERE c_acctbal < 0) = 0), ('unique', 0, true)) v(rule, n, ok)")
def _(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    return C.invariants(c, c.filter("c_acctbal >= 0"), "c_custkey")
