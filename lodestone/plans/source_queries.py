"""Readers, sinks and provenance: each query writes a table to the shared folder and reads it back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T
from ..streaming import ingest
from .registry import query
from .table_queries import r, t


def _text(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")


_NATION = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"


@query("S01_S29_csv_text", _NATION)
def _(spark, sf_dir):
    path = T.scratch_path(spark, "csv")
    T.write_csv(_nation(spark, sf_dir), path)
    return T.read_text_csv(spark, path)


@query("S02_S07_csv_typed", "SELECT n_nationkey, n_name, CAST(NULL AS INTEGER) AS bad FROM nation")
def _(spark, sf_dir):
    path = T.scratch_path(spark, "headless")
    _text(_nation(spark, sf_dir)).select("n_nationkey", "n_name", F.lit("n/a").alias("bad")).write.option("header", False).csv(path)
    return T.typed(T.read_text_csv(spark, path, ["n_nationkey", "n_name", "bad"], header=False), {"n_nationkey": "int", "bad": "int"})


@query("S03_csv_projection", "SELECT n_name FROM nation")
def _(spark, sf_dir):
    path = T.scratch_path(spark, "csv")
    T.write_csv(_nation(spark, sf_dir), path)
    return T.read_text_csv(spark, path, select=["n_name"])


@query("S04_pipe_delimited", _NATION)
def _(spark, sf_dir):
    path = T.scratch_path(spark, "pipe") + ".txt"
    _nation(spark, sf_dir).write.option("header", True).option("sep", "|").csv(path)
    return T.read_any(spark, path)


@query("S05_footer", "SELECT n_name AS \"Name\", CAST(n_nationkey AS VARCHAR) AS \"Key\", 'registry of nations' AS source FROM nation")
def _(spark, sf_dir):
    path = T.scratch_path(spark, "footer") + ".csv"
    rows = ["Name,Key", *(f'"{x["n_name"]}",{x["n_nationkey"]}' for x in _nation(spark, sf_dir).collect()), '"Source: registry of nations"', "Note: small"]  # a file of a few rows
    T.write_note(spark, path, "\n".join(rows) + "\n")
    body, notes = T.read_csv_with_footer(spark, path, ("Source",))
    return body.withColumn("source", F.lit(notes["Source"]))


@query("S06_snake_case", "SELECT n_nationkey AS nation_key, n_name AS full_name FROM nation")
def _(spark, sf_dir):
    return T.snake_case(_nation(spark, sf_dir).select(F.col("n_nationkey").alias("nationKey"), F.col("n_name").alias("Full Name")))


@query("S08_encoding_fallback", "SELECT n_nationkey, n_name || ' é' AS n FROM (SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation)")
def _(spark, sf_dir):
    path = T.scratch_path(spark, "latin")
    _text(_nation(spark, sf_dir)).select("n_nationkey", F.concat("n_name", F.lit(" é")).alias("n")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return T.read_with_fallback(spark, path)


@query("S09_snapshots", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS snapshot FROM orders")
def _(spark, sf_dir):
    path = T.scratch_path(spark, "snapshots")
    o = t(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumn("y", F.year("o_orderdate"))
    years = [x["y"] for x in o.select("y").distinct().collect()]  # a few years
    for y in years:
        o.filter(F.col("y") == y).select("o_orderkey").write.option("header", True).csv(f"{path}/list_{y}-01")
    found = T.dated_snapshots(spark, f"{path}/list_*")
    return T.read_snapshots(spark, {k[:4]: p for k, p in found.items()})


@query("S10_S13_formats", "SELECT unnest(['parquet', 'orc', 'jsonl', 'csv']) AS format, (SELECT count(*) FROM nation) AS n, (SELECT CAST(sum(n_nationkey) AS BIGINT) FROM nation) AS total")
def _(spark, sf_dir):
    df, out = _nation(spark, sf_dir), None
    for kind in ("parquet", "orc", "jsonl", "csv"):
        path = f"{T.scratch_path(spark, kind)}.{kind}"
        df.write.format({"jsonl": "json"}.get(kind, kind)).option("header", True).save(path)
        one = T.read_any(spark, path).agg(F.lit(kind).alias("format"), F.count(F.lit(1)).alias("n"), F.sum(F.col("n_nationkey").cast("long")).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("S14_xml", "SELECT n_nationkey, n_name, n_name || '<&>' AS note, first_value(CASE WHEN n_nationkey % 5 = 0 THEN n_name END) OVER (PARTITION BY n_nationkey // 5 ORDER BY n_nationkey) AS label FROM nation")
def _(spark, sf_dir):
    from ..operators.panel import forward_fill

    n = _nation(spark, sf_dir)
    element = T.request_text("<row><name>{name}</name><note>{note}</note><label>{label}</label></row>", name=F.col("n_name"), note=F.concat("n_name", F.lit("<&>")), label=F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")))
    rows = T.xml_rows(n.select("n_nationkey", element.alias("e")), "e", "name string, note string, label string", ["n_nationkey"])
    rows = rows.withColumn("label", F.nullif(F.col("label"), F.lit(""))).withColumn("span", F.expr("n_nationkey div 5"))
    return forward_fill(rows, ["span"], ["n_nationkey"], "label").select("n_nationkey", F.col("name").alias("n_name"), "note", "label")


@query("S15_json_table", "SELECT * FROM (VALUES ('01', 'a'), ('02', NULL)) v(code, name)")
def _(spark, sf_dir):
    return T.json_table(spark, [["code", "name"], ["01", "a"], ["02", None]])


@query("S16_json_nested", "SELECT event_id, event_type AS item_kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_at_k, user_id AS item_at_user FROM events")
def _(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("user_id").alias("user")).alias("at"))).alias("j"))
    return T.flatten(e.select("event_id", F.from_json("j", "kind string, at struct<k: long, user: long>").alias("item")))


@query("S17_S32_resume", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf_dir):
    n, path = _nation(spark, sf_dir).select("n_nationkey", "n_name"), T.scratch_path(spark, "done")
    ingest.resume(n.filter("n_nationkey < 9"), path, "n_nationkey", lambda x: x)
    T.append_rows(n.filter("n_nationkey < 15"), path, "n_nationkey")
    return ingest.resume(n, path, "n_nationkey", lambda x: x)


@query("S19_split_searches", """
WITH w AS (SELECT lower(p_name) AS w, count(*) AS n FROM part GROUP BY 1), e AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS l FROM w),
c AS (SELECT substr(w, 1, l) AS prefix, CAST(sum(n) AS BIGINT) AS n, max(CASE WHEN l = length(w) THEN n END) AS whole FROM e GROUP BY 1),
r AS (SELECT c.*, p.n AS above FROM c LEFT JOIN c p ON p.prefix = substr(c.prefix, 1, length(c.prefix) - 1) WHERE length(c.prefix) = 1 OR p.n > 60)
SELECT prefix, n > 60 AS exact, CASE WHEN n > 60 THEN whole ELSE n END AS n FROM r WHERE n <= 60 OR whole IS NOT NULL""")
def _(spark, sf_dir):
    return T.split_searches(t(spark, sf_dir, "part", "p_name"), "p_name", 60)


@query("S20_html_cells", "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS a, s_name AS b FROM supplier")
def _(spark, sf_dir):
    html = F.concat(F.lit("<table><tr><th>key</th><th>name</th></tr>\n<tr class='x'><td> "), F.col("s_suppkey").cast("string"), F.lit("</td><TD><b>"), F.col("s_name"), F.lit("</b></TD></tr></table>"))
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", T.table_cells(html).alias("c"))
    return rows.select("s_suppkey", F.get(F.get("c", 1), 0).alias("a"), F.get(F.get("c", 1), 1).alias("b"))


@query("S21_embedded_json", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 3 > 0 THEN event_type || ' & more' END AS kind FROM events")
def _(spark, sf_dir):
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.concat("event_type", F.lit(" & more")).alias("kind")))
    coded = F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    html = F.concat(F.lit("<html><script>var x = {};</script>"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit('<script type="application/ld+json">'), coded, F.lit("</script>"))).otherwise(""), F.lit("<p>text</p></html>"))
    return t(spark, sf_dir, "events").select("event_id", T.embedded_json(html, "k long, kind string").alias("j")).select("event_id", "j.k", "j.kind")


@query("S24_gzip", _NATION)
def _(spark, sf_dir):
    path = T.scratch_path(spark, "zipped") + ".csv.gz"
    _nation(spark, sf_dir).write.option("header", True).option("compression", "gzip").csv(path)
    return T.read_any(spark, path)


@query("S25_shapes", "SELECT CAST(n_nationkey + 1 AS INTEGER) AS record, n_nationkey * 1.5 AS west, n_regionkey + 2.0 AS north, CAST(5 AS INTEGER) AS points FROM nation")
def _(spark, sf_dir):
    rows = sorted((x["n_nationkey"], x["n_regionkey"]) for x in _nation(spark, sf_dir).collect())  # a file of a few shapes
    box = lambda x, y: [(x, y), (x, y + 2), (x + 1, y + 2), (x + 1, y), (x, y)]
    path = T.scratch_path(spark, "shapes") + ".shp"
    T.write_bytes(spark, path, T.shapefile([[box(n * 1.5, float(r))] for n, r in rows]))
    x, y = F.transform("ring", lambda p: F.get(p, 0)), F.transform("ring", lambda p: F.get(p, 1))
    return T.read_shapes(spark, path).select("record", F.array_min(x).alias("west"), F.array_max(y).alias("north"), F.size("ring").alias("points"))


@query("S26_S28_registered", "SELECT 'lodestone_nation_1' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'lodestone_nation_2', (SELECT count(*) FROM region)")
def _(spark, sf_dir):
    T.register({"lodestone_nation_1": _nation(spark, sf_dir), "lodestone_nation_2": t(spark, sf_dir, "region"), "lodestone_other": t(spark, sf_dir, "region")})
    names = T.tables_like(spark, "lodestone_nation_.*")
    out = None
    for name in names:
        one = spark.sql(f"SELECT '{name}' AS name, count(*) AS n FROM {name}")
        out = one if out is None else out.unionByName(one)
    return out


@query("S27_T03_vintages", "SELECT CAST(CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 ELSE n_nationkey END AS INTEGER) AS n_nationkey, CAST(n_regionkey AS INTEGER) AS vintage FROM nation")
def _(spark, sf_dir):
    n = _nation(spark, sf_dir).select("n_nationkey", F.col("n_regionkey").alias("vintage"))
    inbox, table, mark = (T.scratch_path(spark, x) for x in ("inbox", "vintages", "mark"))
    n.write.parquet(inbox)
    ingest.ingest_vintages(spark, inbox, n.schema, table, mark)
    T.overwrite_vintage(n.filter("vintage = 1").withColumn("n_nationkey", F.col("n_nationkey") + 100), table, "vintage")
    return spark.read.parquet(table).select("n_nationkey", F.col("vintage").cast("int").alias("vintage"))


@query("S30_atomic", "SELECT n_nationkey FROM nation")
def _(spark, sf_dir):
    path = T.scratch_path(spark, "atomic")
    T.atomic_write(_nation(spark, sf_dir).select("n_nationkey"), path, lambda df: T.require_columns(df, "n_nationkey"))
    return spark.read.parquet(path)


@query("S31_V01_V03_provenance", "SELECT 'stale before' AS what, 0::BIGINT AS n UNION ALL SELECT 'stale after', 1 UNION ALL SELECT 'frozen', 1")
def _(spark, sf_dir):
    source, table = T.scratch_path(spark, "source"), T.scratch_path(spark, "made")
    T.write_note(spark, source, "one")
    T.write_with_provenance(_nation(spark, sf_dir), table, [source], rule="all")
    before = len(T.stale_inputs(spark, table))
    fs, at = T.storage(spark, source)
    fs.delete(at, False)
    T.write_note(spark, source, "two")
    after = len(T.stale_inputs(spark, table))
    try:
        T.freeze(_nation(spark, sf_dir), table)
        frozen = 0
    except T.ContractError:
        frozen = 1
    return spark.createDataFrame([("stale before", before), ("stale after", after), ("frozen", frozen)], "what string, n long")


@query("V01_file_hash", "SELECT sha256(encode('nation by nation')) AS hash")
def _(spark, sf_dir):
    path = T.scratch_path(spark, "note")
    T.write_note(spark, path, "nation by nation")
    return spark.createDataFrame([(T.file_hash(spark, path),)], "hash string")


_PART = lambda row, a: f"CAST(('0x' || substr(md5({row}), {a}, 8)) AS BIGINT)"
_HASHED = lambda name, row: f"SELECT '{name}' AS name, count(*) AS n, CAST(sum({_PART(row, 1)}) AS BIGINT) AS total, bit_xor({_PART(row, 9)}) AS parity FROM {name}"


@query("V04_content_hash", " UNION ALL ".join((_HASHED("region", "concat_ws('|', r_name, r_regionkey)"), _HASHED("nation", "concat_ws('|', n_name, n_nationkey, n_regionkey)"), _HASHED("orders", "concat_ws('|', o_custkey, o_orderkey, o_orderpriority, o_orderstatus)"))))
def _(spark, sf_dir):
    frames = {"region": t(spark, sf_dir, "region"), "nation": t(spark, sf_dir, "nation"), "orders": t(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")}
    out = None
    for name, df in frames.items():
        one = T.content_rows(df).select(F.lit(name).alias("name"), "n", "total", "parity")
        out = one if out is None else out.unionByName(one)
    return out


@query("V05_V06_manifest", "SELECT 'nation_level-best_year-2024' AS name, 'nation' AS tab, count(*) AS rows FROM nation")
def _(spark, sf_dir):
    folder = T.scratch_path(spark, "run")
    path = T.spec_path(folder, "nation", year="2024", level="best")
    T.freeze(_nation(spark, sf_dir), path)
    T.write_manifest(spark, f"{folder}/manifest.json", "r1", {"nation": path})
    made = json.loads(T.read_note(spark, f"{folder}/manifest.json"))["tables"]
    return spark.createDataFrame([(x["path"].rsplit("/", 1)[-1], name, x["rows"]) for name, x in made.items()], "name string, tab string, rows long")


@query("J09_harmonised_keys", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf_dir):
    from ..operators.joins import harmonise

    s = t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    n = _nation(spark, sf_dir).select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    s, n = harmonise(s, n, ["k"])
    return s.join(n, "k").select("s_suppkey", "n_name")


@query("X06_fisher", "SELECT * FROM (VALUES (0.002759)) v(p)")
def _(spark, sf_dir):
    from ..operators.statistics import fisher_exact

    return spark.createDataFrame([(round(fisher_exact(1, 9, 11, 3), 6),)], "p double")


_LOGIT = "SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity / 50 AS q FROM lineitem"


@query("X05_logistic_means", f"SELECT round(avg(y), 4) AS mean_label, round(avg(y), 4) AS mean_fitted FROM ({_LOGIT})")
def _(spark, sf_dir):
    from ..operators.statistics import logistic

    rows = t(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("q"))
    fit = logistic(rows, "y", ["q"])
    p = 1 / (1 + F.exp(-(fit["(intercept)"] + fit["q"] * F.col("q"))))  # the fitted mean of a model with an intercept is the label's
    return rows.agg(F.round(F.avg("y"), 4).alias("mean_label"), F.round(F.avg(p), 4).alias("mean_fitted"))


@query("X10_difference", "SELECT round(a.k / a.n - b.k / b.n, 6) AS d, round(a.k / a.n - b.k / b.n - 1.959963984540054 * sqrt(a.k / a.n * (1 - a.k / a.n) / a.n + b.k / b.n * (1 - b.k / b.n) / b.n), 6) AS low FROM (SELECT count(*) FILTER (l_tax > 0.04) AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A') a, (SELECT count(*) FILTER (l_tax > 0.04) AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R') b")
def _(spark, sf_dir):
    from ..operators.statistics import difference_interval

    n = lambda f, taxed: F.count_if((F.col("l_returnflag") == f) & (F.col("l_tax") > 0.04)) if taxed else F.count_if(F.col("l_returnflag") == f)
    per = t(spark, sf_dir, "lineitem").agg(n("A", True).alias("k1"), n("A", False).alias("n1"), n("R", True).alias("k2"), n("R", False).alias("n2"))
    d, low, _high = difference_interval(*map(F.col, ("k1", "n1", "k2", "n2")))
    return per.select(F.round(d, 6).alias("d"), F.round(low, 6).alias("low"))


@query("X03_smd_binary", "SELECT round((p - q) / sqrt((p * (1 - p) + q * (1 - q)) / 2), 6) AS smd FROM (SELECT avg(CAST(l_tax > 0.04 AS INTEGER)) FILTER (l_linestatus = 'O') AS p, avg(CAST(l_tax > 0.04 AS INTEGER)) FILTER (l_linestatus <> 'O') AS q FROM lineitem)")
def _(spark, sf_dir):
    from ..operators.statistics import smd_binary

    return smd_binary(t(spark, sf_dir, "lineitem"), F.col("l_linestatus") == "O", F.col("l_tax") > 0.04).select(r("smd"))


@query("X04_imputed", "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS p FROM lineitem), f AS (SELECT regr_slope(p, q) AS s, regr_intercept(p, q) AS i FROM x) SELECT l_orderkey, l_linenumber, round(coalesce(p, s * q + i), 2) AS p, p IS NULL AS imputed FROM x, f")
def _(spark, sf_dir):
    from ..operators.statistics import impute_linear

    x = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("p"))
    return impute_linear(x, "p", "q").select("l_orderkey", "l_linenumber", F.round("p", 2).alias("p"), "imputed")
