"""Queries over graphs, gain matrices, design tables, and the integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import checks, design, graph, spectral
from ..sources import views
from .registry import query


def _checks(df):
    return df.select("check", "passed", rnd("observed").alias("observed"), rnd("threshold").alias("threshold"))


def _sql_checks(rows: list[tuple[str, str, str, str]], source: str = "") -> str:
    """SQL text: rows of (name, passed, observed, threshold), each over the same FROM clause."""
    return "\nUNION ALL ".join(
        f"SELECT '{n}' AS \"check\", {p} AS passed, CAST({o} AS DOUBLE) AS observed, CAST({t} AS DOUBLE) AS threshold {source}"
        for n, p, o, t in rows)


def _zero(name: str, column: str) -> tuple[str, str, str, str]:
    return name, f"{column} = 0", column, "0"


def weighted(spark, sf):
    """edges with a weight column."""
    return graph.scale_edges(views.edges(spark, sf), "log1p", "region_sum")


_WEIGHTED = """
w AS (SELECT src, dst, count, length, ln(1 + count) / (SELECT max(s) FROM (SELECT sum(ln(1 + count)) AS s FROM fx_edges GROUP BY src)) AS weight FROM fx_edges)
"""


@query("validate_edges", """
o AS (SELECT * FROM fx_edges WHERE count > 3),
m AS (SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, coalesce(a.count, 0) AS a, coalesce(b.length, 0) AS b
      FROM fx_edges a FULL JOIN o b ON a.src = b.src AND a.dst = b.dst),
c AS (SELECT count(*) FILTER (x.src < x.dst AND abs(x.a - coalesce(y.a, 0)) > 1e-10) AS sa, count(*) FILTER (x.src < x.dst AND abs(x.b - coalesce(y.b, 0)) > 1e-10) AS sb,
        count(*) FILTER (x.src = x.dst AND abs(x.a) > 1e-10) AS da, count(*) FILTER (x.src = x.dst AND abs(x.b) > 1e-10) AS db,
        count(*) FILTER (x.a < 0) AS na, count(*) FILTER (x.b < 0) AS nb, count(*) FILTER ((x.a > 0) <> (x.b > 0)) AS sup
      FROM m x LEFT JOIN m y ON x.src = y.dst AND x.dst = y.src)
""" + _sql_checks([_zero("first_symmetric", "sa"), _zero("second_symmetric", "sb"), _zero("first_zero_diagonal", "da"), _zero("second_zero_diagonal", "db"),
                   _zero("first_non_negative", "na"), _zero("second_non_negative", "nb"), _zero("same_support", "sup")], "FROM c"), ("fx_edges",))
def validate_edges(spark, sf):
    edges = views.edges(spark, sf)
    first = edges.select("src", "dst", F.col("count").alias("value"))
    second = edges.where("count > 3").select("src", "dst", F.col("length").alias("value"))
    return _checks(checks.validate_edges(first, second))


@query("validate_keys", """
c AS (SELECT min(s_suppkey) AS lo, max(s_suppkey) AS hi, count(*) AS n, count(*) - count(DISTINCT s_suppkey) AS dup FROM supplier)
""" + _sql_checks([_zero("unique", "dup"), ("starts_at_first", "lo = 0", "lo", "0"), ("dense", "hi - lo + 1 = n", "hi - lo + 1 - n", "0")], "FROM c"))
def validate_keys(spark, sf):
    return _checks(checks.validate_keys(views.table(spark, sf, "supplier"), "s_suppkey", 0))


@query("check_axes", """
a AS (SELECT count(*) AS n FROM (SELECT channel, count(DISTINCT recording_id) AS c FROM fx_cells GROUP BY 1) WHERE c <> (SELECT count(DISTINCT recording_id) FROM fx_cells)),
b AS (SELECT count(*) AS n FROM (SELECT t, count(DISTINCT recording_id) AS c FROM fx_cells GROUP BY 1) WHERE c <> (SELECT count(DISTINCT recording_id) FROM fx_cells))
""" + _sql_checks([_zero("same_channels", "n")], "FROM a") + "\nUNION ALL " + _sql_checks([_zero("same_times", "n")], "FROM b"), ("fx_cells",))
def check_axes(spark, sf):
    cells = views._event_cells(spark, sf, F.floor(F.col("user_id") / 10).cast("bigint"))
    return _checks(checks.check_axes(cells, "recording_id", {"channels": ["channel"], "times": ["t"]}))


@query("check_partition", """
t AS (SELECT doc_id FROM labels WHERE quality = 1), h AS (SELECT doc_id FROM labels WHERE toxic = 1),
u AS (SELECT doc_id, count(*) AS s FROM (SELECT * FROM t UNION ALL SELECT * FROM h) GROUP BY 1),
c AS (SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM u)) AS a, (SELECT count(*) FROM u WHERE s > 1) AS b,
        (SELECT count(*) FROM u WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS d)
""" + _sql_checks([_zero("covers_every_id", "a"), _zero("each_id_once", "b"), _zero("no_unknown_id", "d")], "FROM c"))
def check_partition(spark, sf):
    labels = views.table(spark, sf, "labels")
    return _checks(checks.check_partition(labels, labels.where("quality = 1"), labels.where("toxic = 1"), "doc_id"))


@query("subset_entities", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def subset_entities(spark, sf):
    good = views.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return checks.subset_entities(views.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), good, "doc_id")


_BOUNDS = {"p1": (1.0, 45.0), "p2": (900.0, 2000.0), "p3": (1.0, 25.0)}


@query("check_bounds", "c AS (SELECT count(*) AS n, " + ", ".join(
    f"count(*) FILTER ({p} IS NULL OR isnan({p})) AS f_{p}, count(*) FILTER ({p} < {lo} OR {p} > {hi}) AS r_{p}" for p, (lo, hi) in _BOUNDS.items())
    + " FROM fx_candidates)\n" + _sql_checks([("at_least_two_rows", "n >= 2", "n", "2")] + [_zero(f"{p}_finite", f"f_{p}") for p in _BOUNDS]
                                            + [_zero(f"{p}_in_range", f"r_{p}") for p in _BOUNDS], "FROM c"), ("fx_candidates",))
def check_bounds(spark, sf):
    return _checks(checks.check_bounds(views.candidates(spark, sf), _BOUNDS))


# The stored collection of these checks: parts as candidates, line items as replicates, part prices as seen in the line items. Its
# defects are those of the data: sizes of 50, prices off the list, one order status too many, a line number that some orders lack.


def _collection(spark, sf):
    part, line, orders = (views.table(spark, sf, t) for t in ("part", "lineitem", "orders"))
    priced = F.col("l_extendedprice") / F.col("l_quantity")
    return {
        "candidates": part.select(F.col("p_partkey").alias("candidate_id"), "p_size", "p_retailprice", F.when(F.col("p_size") == 50, 1.0).otherwise(0.0).alias("offset")),
        "prices": part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_retailprice").alias("value")),
        "seen": line.groupBy(F.col("l_partkey").alias("candidate_id")).agg(F.avg(priced).alias("value")),
        "replicates": line.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 49, float("nan")).otherwise(F.col("l_extendedprice")).alias("value")),
        "statuses": orders.select("o_orderstatus", "o_orderkey"), "nations": views.table(spark, sf, "nation")}


def _record(spark, sf):
    """Metadata as a writer would have kept it: counted from the tables, with one entry left out."""
    return {"nations": views.table(spark, sf, "nation").count(), "regions": views.table(spark, sf, "region").count()}


_SEEN = "seen AS (SELECT l_partkey AS candidate_id, avg(l_extendedprice / l_quantity) AS value FROM lineitem GROUP BY 1)"
_LINES = "lines AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2)"


def _violations(rows):
    return "\nUNION ALL ".join(f"SELECT '{n}' AS \"check\", v = 0 AS passed, CAST(v AS DOUBLE) AS observed, 0.0::DOUBLE AS threshold FROM (SELECT ({q}) AS v)" for n, q in rows)


@query("check_bank", f"{_SEEN}, {_LINES}," + """
st AS (SELECT o_orderstatus AS s, row_number() OVER (ORDER BY min(o_orderkey)) AS i FROM orders GROUP BY 1),
v AS (""" + _violations([
    ("candidates_present", "SELECT abs(count(*) - 2000) FROM part"), ("offset_is_zero", "SELECT count(*) FROM part WHERE p_size = 50"), ("candidates_usable", "SELECT count(*) FROM part WHERE p_size IS NULL OR p_retailprice IS NULL"),
    ("values_usable", "SELECT count(*) FROM lineitem WHERE l_quantity > 49"),
    ("lines_once", "SELECT sum(c - 1) + greatest(0, (SELECT 7 * count(DISTINCT o_orderkey) FROM orders) - count(*)) FROM lines"),
    ("prices_agree", "SELECT count(*) FROM (SELECT p_partkey AS k, p_retailprice AS a FROM part) p FULL JOIN seen ON k = candidate_id WHERE NOT coalesce(abs(a - value) <= 400, false)"),
    ("status_axis", "SELECT greatest((SELECT count(*) FROM st), 3) - count(*) FROM st JOIN (VALUES (1, 'O'), (2, 'F'), (3, 'P')) e(i, s) ON e.i = st.i AND e.s = st.s"),
    ("nation_axis", "SELECT count(*) FROM nation WHERE n_nationkey NOT BETWEEN 0 AND 24"), ("nations_recorded", "SELECT CAST(count(*) <> 25 AS INT) FROM nation"),
    ("regions_recorded", "SELECT CAST(count(*) <> 6 AS INT) FROM region"), ("checksum_recorded", "SELECT 1")]) + """)
SELECT * FROM v""")
def check_bank(spark, sf):
    """Eleven rules over a stored collection; the data breaks several of them."""
    tables, record = _collection(spark, sf), _record(spark, sf)
    orders = tables["statuses"].select("o_orderkey").distinct().count()
    return _checks(checks.check_tables(tables, [
        checks.rule_rows("candidates_present", "candidates", 2000), checks.rule_held("offset_is_zero", "candidates", "offset", 0.0), checks.rule_usable("candidates_usable", "candidates", ["p_size", "p_retailprice"]),
        checks.rule_usable("values_usable", "replicates", ["value"]), checks.rule_once("lines_once", "replicates", ["l_orderkey", "l_linenumber"], 7 * orders), checks.rule_agree("prices_agree", "prices", "seen", ["candidate_id"], "value", 400.0),
        checks.rule_axis("status_axis", "statuses", "o_orderstatus", "o_orderkey", ["O", "F", "P"]), checks.rule_axis("nation_axis", "nations", "n_nationkey", "n_nationkey", list(range(25))),
        checks.rule_recorded("nations_recorded", record, "nations", 25), checks.rule_recorded("regions_recorded", record, "regions", 6), checks.rule_recorded("checksum_recorded", record, "checksum", "none")]))


@query("release_checks", f"{_LINES}," + """
v AS (""" + _violations([
    ("order_rows", "SELECT abs(count(*) - 15000) FROM orders"), ("no_pending_orders", "SELECT count(*) FROM orders WHERE o_orderstatus = 'P'"), ("lines_once", "SELECT sum(c - 1) + greatest(0, (SELECT count(*) FROM lineitem) - count(*)) FROM lines"),
    ("prices_usable", "SELECT count(*) FROM orders WHERE o_totalprice IS NULL OR isnan(o_totalprice)"), ("regions_recorded", "SELECT CAST(count(*) <> 5 AS INT) FROM region"), ("approval_recorded", "SELECT 1")]) + """)
SELECT * FROM v""")
def release_checks(spark, sf):
    """What must hold before a collection is handed on."""
    orders, line = views.table(spark, sf, "orders"), views.table(spark, sf, "lineitem")
    tables, record = {"orders": orders.withColumn("pending", F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)), "lines": line}, _record(spark, sf)
    return _checks(checks.check_tables(tables, [
        checks.rule_rows("order_rows", "orders", 15000), checks.rule_held("no_pending_orders", "orders", "pending", 0), checks.rule_once("lines_once", "lines", ["l_orderkey", "l_linenumber"], line.count()),
        checks.rule_usable("prices_usable", "orders", ["o_totalprice"]), checks.rule_recorded("regions_recorded", record, "regions", 5), checks.rule_recorded("approval_recorded", record, "approval", "yes")]))


@query("read_dimension", """
SELECT s_suppkey AS node_id, s_name AS name, s_acctbal AS value FROM supplier
""")
def read_dimension(spark, sf):
    from ..sources import files

    source = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))
    members = views.table(spark, sf, "nation").join(views.table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("node_id"))
    return files.check_dimension(source, ["node_id", "name", "value"], "node_id", ["value"], members)


@query("quarantine_failures", """
SELECT 'p' || p_partkey AS item, CASE WHEN p_size % 7 = 0 THEN 'size is a multiple of seven' END AS error,
       CASE WHEN p_size % 7 <> 0 THEN round(p_retailprice / p_size, 6) END AS value FROM part
""")
def quarantine_failures(spark, sf):
    results = views.table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item"),
        F.when(F.col("p_size") % 7 != 0, F.round(F.col("p_retailprice") / F.col("p_size"), 6)).alias("value"),
        F.when(F.col("p_size") % 7 == 0, "size is a multiple of seven").alias("error"))
    good, failed = checks.split_failures(results)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(failed.withColumn("value", F.lit(None).cast("double"))).select("item", "error", "value")


@query("parse_block_label", "SELECT node_id, label, block, split_part(label, '_', 2) AS hemisphere FROM fx_nodes", ("fx_nodes",))
def parse_block_label(spark, sf):
    return graph.parse_block_label(views.nodes(spark, sf), 5).select("node_id", "label", "block", "hemisphere")


@query("node_multipliers", """
SELECT node_id, round(1.5 * CASE block WHEN 'ASIA' THEN 1.2 WHEN 'EUROPE' THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS drive,
       round(2.0 * CASE block WHEN 'ASIA' THEN 0.5 ELSE 1.0 END, 6)::DOUBLE AS noise FROM fx_nodes
""", ("fx_nodes",))
def node_multipliers(spark, sf):
    nodes = views.block_nodes(spark, sf).select("node_id", "block", F.lit(1.5).alias("drive"), F.lit(2.0).alias("noise"))
    factors = nodes.groupBy("block").agg(F.expr(
        "filter(array(named_struct('t', 'drive', 'f', CASE block WHEN 'ASIA' THEN 1.2D WHEN 'EUROPE' THEN 0.8D END), named_struct('t', 'noise', 'f', CASE block WHEN 'ASIA' THEN 0.5D END)), x -> x.f IS NOT NULL)").alias("x"))
    factors = factors.select("block", F.explode("x").alias("x")).select("block", F.col("x.t").alias("target"), F.col("x.f").alias("factor"))
    return graph.node_multipliers(nodes, factors, ["drive", "noise"]).select("node_id", rnd("drive").alias("drive"), rnd("noise").alias("noise"))


@query("scale_edges", _WEIGHTED + "SELECT src, dst, round(weight, 8) AS weight FROM w", ("fx_edges",))
def scale_edges(spark, sf):
    return weighted(spark, sf).select("src", "dst", rnd("weight", 8).alias("weight"))


_GAINS = {"AFRICA": 0.9, "AMERICA": 1.1, "ASIA": 1.3, "EUROPE": 0.7, "MIDDLE EAST": 1.0}


def _gain_table(nodes, gains):
    pairs = F.create_map(*[F.lit(x) for k, v in gains.items() for x in (k, v)])
    return nodes.select("block").distinct().withColumn("gain", F.element_at(pairs, F.col("block")))


_GAIN_ROWS = ", ".join(f"('{b}', {g}::DOUBLE)" for b, g in _GAINS.items())


@query("endpoint_gain", _WEIGHTED + f""",
g(block, gain) AS (VALUES {_GAIN_ROWS})
SELECT w.src, w.dst, round(weight * sqrt(gs.gain * gd.gain), 8) AS weight FROM w
JOIN fx_nodes s ON s.node_id = w.src JOIN fx_nodes d ON d.node_id = w.dst JOIN g gs ON gs.block = s.block JOIN g gd ON gd.block = d.block
""", ("fx_edges", "fx_nodes"))
def endpoint_gain(spark, sf):
    nodes = views.block_nodes(spark, sf)
    return graph.endpoint_gain(weighted(spark, sf), nodes, _gain_table(nodes, _GAINS)).select("src", "dst", rnd("weight", 8).alias("weight"))


def _pair_gains(nodes):
    return nodes.select("block").distinct().where("block <> 'AFRICA'").select(
        F.lit("AFRICA").alias("b1"), F.col("block").alias("b2"), (F.lit(1.0) + F.length("block") / 10.0).alias("gain"))


@query("pair_gain", _WEIGHTED + """,
g AS (SELECT r_name AS b2, 1.0::DOUBLE + length(r_name) / 10.0::DOUBLE AS gain FROM region WHERE r_name <> 'AFRICA'),
x AS (SELECT w.src, w.dst, w.weight, coalesce(g.gain, 1.0) AS gain FROM w JOIN fx_nodes s ON s.node_id = w.src JOIN fx_nodes d ON d.node_id = w.dst
      LEFT JOIN g ON (s.block = 'AFRICA' AND d.block = g.b2) OR (d.block = 'AFRICA' AND s.block = g.b2))
SELECT src, dst, round(weight * gain * (SELECT sum(weight) / sum(weight * gain) FROM x), 8) AS weight FROM x
""", ("fx_edges", "fx_nodes"))
def pair_gain(spark, sf):
    nodes = views.block_nodes(spark, sf)
    return graph.pair_gain(weighted(spark, sf), nodes, _pair_gains(nodes)).select("src", "dst", rnd("weight", 8).alias("weight"))


@query("mode_loadings", """
r AS (SELECT r_name AS b FROM region)
SELECT candidate_id, p.b AS b1, q.b AS b2, round((1 + (p1 / 500) * CASE WHEN 'ASIA' IN (p.b, q.b) THEN 1 ELSE 0 END)
  * (1 + (p3 / 250) * CASE WHEN 'EUROPE' IN (p.b, q.b) AND 'AFRICA' NOT IN (p.b, q.b) THEN 1 WHEN 'AFRICA' IN (p.b, q.b) AND 'EUROPE' NOT IN (p.b, q.b) THEN -1 ELSE 0 END), 8) AS gain
FROM fx_candidates CROSS JOIN r p JOIN r q ON p.b <= q.b
""", ("fx_candidates",))
def mode_loadings(spark, sf):
    coefficients = views.candidates(spark, sf).select("candidate_id", (F.col("p1") / 500).alias("a"), (F.col("p3") / 250).alias("b"))
    return graph.mode_loadings(coefficients, list(_GAINS), "ASIA", "EUROPE", "AFRICA").withColumn("gain", rnd("gain", 8))


@query("graph_audit", _WEIGHTED + """,
e2 AS (SELECT src, dst FROM fx_edges WHERE count > 2),
k AS (SELECT src, dst, count, length, weight FROM w WHERE count > 2),
cc AS (SELECT node_id AS n, node_id AS l FROM fx_nodes UNION SELECT e2.dst, cc.l FROM cc JOIN e2 ON e2.src = cc.n)
SELECT (SELECT count(*) FROM fx_nodes) AS nodes, count(*) FILTER (src < dst) AS undirected_edges,
  round(count(*)::DOUBLE / ((SELECT count(*) FROM fx_nodes) * ((SELECT count(*) FROM fx_nodes) - 1)), 6) AS density,
  (SELECT count(DISTINCT m) FROM (SELECT n, min(l) AS m FROM cc GROUP BY n)) AS components,
  min(count) AS count_min, median(count) AS count_median, max(count) AS count_max, min(length) AS length_min, median(length) AS length_median,
  max(length) AS length_max, round(max(length) / 3.0, 6) AS max_delay, round(max(weight), 8) AS weight_max,
  (SELECT round(max(s), 8) FROM (SELECT sum(weight) AS s FROM k GROUP BY src)) AS strength_max
FROM k
""", ("fx_edges", "fx_nodes"), recursive=True)
def graph_audit(spark, sf):
    out = graph.graph_audit(views.nodes(spark, sf), weighted(spark, sf).where("count > 2"), 3.0)
    return out.select(*[rnd(c, 8 if c in ("weight_max", "strength_max") else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def trade_graph(spark, sf):
    """Customers and suppliers linked to their nation; nations are negative ids and have very many neighbours."""
    customers = views.table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("src"), (-1 - F.col("c_nationkey")).cast("bigint").alias("dst"))
    suppliers = views.table(spark, sf, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("src"), (-1 - F.col("s_nationkey")).cast("bigint").alias("dst"))
    edges = customers.unionByName(suppliers)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes, edges


@query("connected_components", """
e AS (SELECT c_custkey * 2 AS src, -1 - c_nationkey AS dst FROM customer UNION ALL SELECT s_suppkey * 2 + 1, -1 - s_nationkey FROM supplier),
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
cc AS (SELECT DISTINCT src AS n, src AS l FROM b UNION SELECT b.dst, cc.l FROM cc JOIN b ON b.src = cc.n)
SELECT CAST(n AS BIGINT) AS node_id, CAST(min(l) AS BIGINT) AS component FROM cc GROUP BY 1
""", recursive=True)
def connected_components(spark, sf):
    return graph.connected_components(*trade_graph(spark, sf))


@query("mean_one_contrast", """
n AS (SELECT block, count(*) AS n, CASE block WHEN 'ASIA' THEN 1.3::DOUBLE WHEN 'EUROPE' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS raw FROM fx_nodes GROUP BY 1),
t AS (SELECT sum(n) AS a, sum(n) FILTER (block = 'AMERICA') AS t FROM n)
SELECT block, round(raw / (SELECT sum(n * raw) / sum(n) FROM n), 8) AS multiplier,
       round(CASE WHEN block = 'AMERICA' THEN 1.25::DOUBLE ELSE (a - t * 1.25::DOUBLE) / (a - t) END, 8) AS counter FROM n CROSS JOIN t
""", ("fx_nodes",))
def mean_one_contrast(spark, sf):
    nodes = views.block_nodes(spark, sf)
    counter = graph.counter_gain(nodes, "AMERICA", 1.25).withColumnRenamed("multiplier", "counter")
    return graph.mean_one_contrast(nodes, {"ASIA": 0.3, "EUROPE": -0.2}).join(counter, "block").select(
        "block", rnd("multiplier", 8).alias("multiplier"), rnd("counter", 8).alias("counter"))


@query("block_noise_map", """
SELECT candidate_id, b.block, round(CASE b.block WHEN 'ASIA' THEN p1 WHEN 'EUROPE' THEN p2 ELSE 0 END + p3 * b.l1 + p1 * b.l2, 6) + 0.0 AS contrast
FROM fx_candidates CROSS JOIN (VALUES ('AFRICA', 0.5::DOUBLE, 0.0::DOUBLE), ('ASIA', -0.25::DOUBLE, 0.0::DOUBLE), ('EUROPE', 0.0::DOUBLE, 1.5::DOUBLE)) b(block, l1, l2)
""", ("fx_candidates",))
def block_noise_map(spark, sf):
    return graph.block_noise_map(views.candidates(spark, sf), {"ASIA": "p1", "EUROPE": "p2"},
                                 {"p3": {"AFRICA": 0.5, "ASIA": -0.25}, "p1": {"EUROPE": 1.5}}).withColumn("contrast", rnd("contrast"))


@query("sensor_source_gain", "SELECT sensor, node_id, round(g, 8) + 0.0 AS g, floored FROM fx_gain", ("fx_gain",))
def sensor_source_gain(spark, sf):
    return views.sensor_gain(spark, sf).withColumn("g", rnd("g", 8))


def node_samples(spark, sf):
    """samples of the nodes: shipped quantity per supplier and half year."""
    ship = views.table(spark, sf, "lineitem")
    return ship.groupBy(F.lit(0).alias("recording_id"), F.col("l_suppkey").alias("node_id"),
                        (F.year("l_shipdate") * 2 + F.floor((F.month("l_shipdate") - 1) / 6)).cast("bigint").alias("t")).agg((F.sum("l_quantity") / 100.0).alias("value"))


@query("project_matrix", """
s AS (SELECT l_suppkey AS node_id, CAST(year(l_shipdate) * 2 + (month(l_shipdate) - 1) // 6 AS BIGINT) AS t, sum(l_quantity) / 100.0 AS value FROM lineitem GROUP BY 1, 2),
p AS (SELECT t, sensor, sum(value * g) AS v FROM s JOIN fx_gain USING (node_id) GROUP BY 1, 2)
SELECT 0 AS recording_id, sensor AS channel, t, round(v - avg(v) OVER (PARTITION BY t), 6) + 0.0 AS value FROM p
""", ("fx_gain",))
def project_matrix(spark, sf):
    return graph.project_matrix(node_samples(spark, sf), views.sensor_gain(spark, sf)).select("recording_id", "channel", "t", rnd("value").alias("value"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _detail(spark, sf):
    orders = views.table(spark, sf, "orders")
    wide = orders.groupBy(F.col("o_custkey").alias("vertex")).agg(*[
        F.coalesce(F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))), F.lit(0.0)).alias(p) for p in _PRIORITIES])
    return wide.select("vertex", F.explode(F.array(*[F.struct(F.lit(p).alias("sensor"), (F.col(f"`{p}`") / 1000000.0).alias("value")) for p in _PRIORITIES])).alias("c")).select(
        "c.sensor", "vertex", "c.value")


@query("weighted_rollup", f"""
d AS (SELECT p.sensor, v.vertex, coalesce(sum(o_totalprice) FILTER (o_orderpriority = p.sensor), 0) / 1000000.0 AS value
      FROM (SELECT DISTINCT o_custkey AS vertex FROM orders) v CROSS JOIN (VALUES {', '.join(f"('{p}')" for p in _PRIORITIES)}) p(sensor)
      LEFT JOIN orders ON o_custkey = v.vertex GROUP BY 1, 2),
m AS (SELECT c_custkey AS vertex, c_nationkey AS parcel, abs(c_acctbal) + 1 AS area FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
w AS (SELECT vertex, parcel, area / sum(area) OVER (PARTITION BY parcel) AS w FROM m),
r AS (SELECT sensor, parcel, sum(w * value) AS value FROM d JOIN w USING (vertex) GROUP BY 1, 2),
vn AS (SELECT parcel, sum(w * n) AS mean_norm FROM (SELECT vertex, stddev_pop(value) * sqrt(5) AS n FROM d GROUP BY 1) JOIN w USING (vertex) GROUP BY 1),
rn AS (SELECT parcel, stddev_pop(value) * sqrt(5) AS norm FROM r GROUP BY 1)
SELECT sensor, parcel, round(value, 6) + 0.0 AS value, round(norm / mean_norm, 6) AS retention FROM r JOIN vn USING (parcel) JOIN rn USING (parcel)
""")
def weighted_rollup(spark, sf):
    customers = views.table(spark, sf, "customer")
    membership = customers.select(F.col("c_custkey").alias("vertex"), F.col("c_nationkey").alias("parcel"), (F.abs("c_acctbal") + 1).alias("area"))
    rollup, audit = graph.weighted_rollup(_detail(spark, sf), membership, views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("parcel")))
    return rollup.join(audit.select("parcel", "retention"), "parcel").select("sensor", "parcel", rnd("value").alias("value"), rnd("retention").alias("retention"))


_GAIN2 = "b AS (SELECT sensor, node_id, g * (1 + 0.3::DOUBLE * cos(node_id)) + 0.001::DOUBLE * sin(node_id * 1.7::DOUBLE) AS g FROM fx_gain)"


def _second_gain(gain):
    return gain.withColumn("g", F.col("g") * (F.lit(1.0) + F.cos("node_id") * 0.3) + F.sin(F.col("node_id") * 1.7) * 0.001)


@query("matrix_compare", _GAIN2 + """,
j AS (SELECT a.sensor, a.node_id, a.g AS a, b.g AS b FROM fx_gain a JOIN b ON a.sensor = b.sensor AND a.node_id = b.node_id),
c AS (SELECT node_id, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS c FROM j GROUP BY 1),
gm AS (SELECT x.sensor, y.sensor AS other, sum(x.a * y.a) AS ga, sum(x.b * y.b) AS gb FROM j x JOIN j y ON x.node_id = y.node_id AND x.sensor < y.sensor GROUP BY 1, 2)
SELECT (SELECT round(corr(a, b), 6) FROM j) AS flat_correlation, round(median(c), 6) AS cosine_median, round(quantile_cont(c, 0.05), 6) AS cosine_p05,
       round(quantile_cont(c, 0.95), 6) AS cosine_p95, round(avg(CASE WHEN c < 0 THEN 1.0 ELSE 0.0 END), 6) AS cosine_negative,
       (SELECT round(corr(ga, gb), 6) FROM gm) AS gram_correlation FROM c
""", ("fx_gain",))
def matrix_compare(spark, sf):
    gain = views.sensor_gain(spark, sf)
    out = graph.matrix_compare(gain, _second_gain(gain))
    return out.select(*[rnd(c).alias(c) for c in ("flat_correlation", "cosine_median", "cosine_p05", "cosine_p95", "cosine_negative", "gram_correlation")])


@query("angular_difference", """
SELECT node_id, round(degrees(acos(greatest(-1, least(1, (x * (x + 1) + y * (y - 0.5) + z * z)
  / (sqrt(x * x + y * y + z * z) * sqrt((x + 1) ** 2 + (y - 0.5) ** 2 + z * z)))))), 6) AS degrees FROM fx_nodes
""", ("fx_nodes",))
def angular_difference(spark, sf):
    nodes = views.nodes(spark, sf)
    moved = nodes.select("node_id", (F.col("x") + 1).alias("x"), (F.col("y") - 0.5).alias("y"), "z")
    return graph.angular_difference(nodes, moved, "node_id").withColumn("degrees", rnd("degrees"))


_BASIS = "pb AS (SELECT sensor, block, p / avg(p) OVER (PARTITION BY block) AS value FROM (SELECT sensor, block, sum(g * g) AS p FROM {g} JOIN fx_nodes USING (node_id) GROUP BY 1, 2))"


@query("power_basis", _BASIS.format(g="fx_gain") + "SELECT sensor, block, round(value, 6) AS value FROM pb", ("fx_gain",))
def power_basis(spark, sf):
    return graph.power_basis(views.sensor_gain(spark, sf), views.block_nodes(spark, sf)).withColumn("value", rnd("value"))


@query("mode_map_cosine", _GAIN2 + ",\n" + _BASIS.format(g="fx_gain") + ",\n" + _BASIS.format(g="b").replace("pb AS", "pc AS") + """,
l(mode, block, loading) AS (VALUES ('m1', 'ASIA', 1.0::DOUBLE), ('m1', 'EUROPE', -0.5::DOUBLE), ('m2', 'AFRICA', 0.7::DOUBLE), ('m2', 'ASIA', 0.2::DOUBLE)),
mp AS (SELECT basis, mode, sensor, sum(value * loading) AS v FROM (SELECT 'first' AS basis, * FROM pb UNION ALL SELECT 'second', * FROM pc) JOIN l USING (block) GROUP BY 1, 2, 3),
ct AS (SELECT basis, mode, sensor, v - avg(v) OVER (PARTITION BY basis, mode) AS v FROM mp)
SELECT x.mode, x.basis, round(sum(x.v * y.v) / (sqrt(sum(x.v * x.v)) * sqrt(sum(y.v * y.v))), 6) AS cosine
FROM ct x JOIN ct y ON y.basis = 'first' AND x.mode = y.mode AND x.sensor = y.sensor GROUP BY 1, 2
""", ("fx_gain",))
def mode_map_cosine(spark, sf):
    gain, nodes = views.sensor_gain(spark, sf), views.block_nodes(spark, sf)
    bases = graph.power_basis(gain, nodes).withColumn("basis", F.lit("first")).unionByName(
        graph.power_basis(_second_gain(gain), nodes).withColumn("basis", F.lit("second")))
    loadings = F.expr("CASE block WHEN 'ASIA' THEN map('m1', 1.0D, 'm2', 0.2D) WHEN 'EUROPE' THEN map('m1', -0.5D) WHEN 'AFRICA' THEN map('m2', 0.7D) END")
    modes = nodes.select("block").distinct().select("block", F.explode(loadings).alias("mode", "loading"))
    return graph.mode_map_cosine(bases, modes, "first").withColumn("cosine", rnd("cosine"))


# --- parameter designs -------------------------------------------------------------------------

_RANGES = {"p1": (1.0, 50.0), "p2": (900.0, 2200.0), "p3": (1.0, 25.0)}


@query("range_map", """
SELECT candidate_id, round(2 * ln(p1 / 1.0) / ln(50.0::DOUBLE) - 1, 6) + 0.0 AS p1, round(2 * (p2 - 900) / 1300 - 1, 6) + 0.0 AS p2, round(2 * (p3 - 1) / 24 - 1, 6) + 0.0 AS p3,
       round(p1, 6) AS back_p1, round(p2, 6) AS back_p2, round(p3, 6) AS back_p3 FROM fx_candidates
""", ("fx_candidates",))
def range_map(spark, sf):
    normal = design.range_map(views.candidates(spark, sf), _RANGES, {"p1"}, "normalize")
    both = normal.select("candidate_id", *[F.col(p).alias(f"n_{p}") for p in _RANGES], *_RANGES)
    back = design.range_map(both, _RANGES, {"p1"}, "denormalize")
    return back.select("candidate_id", *[rnd(f"n_{p}").alias(p) for p in _RANGES], *[rnd(p).alias(f"back_{p}") for p in _RANGES])


@query("mean_one_gains", """
u AS (SELECT candidate_id, b.block, (candidate_id * b.f + b.o) - floor(candidate_id * b.f + b.o) AS u FROM fx_candidates
      CROSS JOIN (VALUES ('AFRICA', 0.37::DOUBLE, 0.1::DOUBLE), ('ASIA', 0.71::DOUBLE, 0.3::DOUBLE), ('EUROPE', 0.13::DOUBLE, 0.77::DOUBLE)) b(block, f, o)),
c AS (SELECT candidate_id, block, u * 2 - 1 - avg(u * 2 - 1) OVER (PARTITION BY candidate_id) AS c FROM u),
d AS (SELECT candidate_id, block, 1 + 0.2::DOUBLE * c / greatest(1, max(abs(c)) OVER (PARTITION BY candidate_id)) AS g FROM c)
SELECT candidate_id, block, round(g - (avg(g) OVER (PARTITION BY candidate_id) - 1), 6) AS gain FROM d
""", ("fx_candidates",))
def mean_one_gains(spark, sf):
    rows = F.array(*[F.struct(F.lit(b).alias("block"), (F.col("candidate_id") * f + o).alias("v")) for b, f, o in (("AFRICA", 0.37, 0.1), ("ASIA", 0.71, 0.3), ("EUROPE", 0.13, 0.77))])
    raw = views.candidates(spark, sf).select("candidate_id", F.explode(rows).alias("r")).select("candidate_id", "r.block", (F.col("r.v") - F.floor("r.v")).alias("u"))
    return design.mean_one_gains(raw, 0.2).withColumn("gain", rnd("gain"))


def _unit_points(spark, sf):
    """Design points from two tables: parts per size (global) and nations (spatial)."""
    sizes = views.table(spark, sf, "part").groupBy((F.col("p_size") - 1).alias("idx")).agg(
        (F.avg("p_retailprice") / 2500.0).alias("p2"), (F.count(F.lit(1)) / (F.count(F.lit(1)) + 50.0)).alias("p1"))
    spatial = views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("idx"), ((F.col("n_nationkey") + 0.5) / 25.0).alias("p3"))
    return sizes, spatial


@query("factorized_design", """
g AS (SELECT p_size - 1 AS idx, avg(p_retailprice) / 2500.0 AS p2, count(*) / (count(*) + 50.0::DOUBLE) AS p1 FROM part GROUP BY 1)
SELECT CAST(g.idx * 25 + n_nationkey AS BIGINT) AS candidate_id, round(CASE WHEN g.idx = 0 THEN 7.0::DOUBLE ELSE exp(p1 * ln(50.0::DOUBLE)) END, 6) AS p1,
       round(CASE WHEN g.idx = 0 THEN 1000.0::DOUBLE ELSE 900 + p2 * 1300 END, 6) AS p2,
       round(CASE WHEN n_nationkey = 0 THEN 5.0::DOUBLE ELSE 1 + (n_nationkey + 0.5) / 25.0 * 24 END, 6)::DOUBLE AS p3
FROM g CROSS JOIN nation
""")
def factorized_design(spark, sf):
    sizes, spatial = _unit_points(spark, sf)
    out = design.factorized_design(sizes.select("idx", "p1", "p2"), spatial, _RANGES, {"p1"}, {"p1": 7.0, "p2": 1000.0, "p3": 5.0}, {})
    return out.select("candidate_id", *[rnd(p).alias(p) for p in ("p1", "p2", "p3")])


@query("parameter_grid", """
SELECT candidate_id, tau, CAST(scale AS DOUBLE) AS scale, mode FROM fx_candidates CROSS JOIN (VALUES (1), (5), (20)) a(tau) CROSS JOIN (VALUES (0.9), (1.1)) b(scale) CROSS JOIN (VALUES ('x'), ('y')) c(mode)
""", ("fx_candidates",))
def parameter_grid(spark, sf):
    return design.parameter_grid(views.candidates(spark, sf).select("candidate_id"), {"tau": [1, 5, 20], "scale": [0.9, 1.1], "mode": ["x", "y"]})


@query("nuisance_grid", """
SELECT candidate_id || '#' || lpad(CAST(a.i * 12 + b.i * 4 + c.i * 2 + d.i AS VARCHAR), 4, '0') AS state_id, candidate_id, CAST(a.v AS DOUBLE) AS noise_fraction,
       CAST(b.v AS DOUBLE) AS noise_exponent, CAST(c.v AS DOUBLE) AS source_fraction, CAST(d.v AS DOUBLE) AS source_exponent
FROM fx_candidates CROSS JOIN (VALUES (0, 0.0), (1, 0.3)) a(i, v) CROSS JOIN (VALUES (0, 0.0), (1, 1.0), (2, 2.0)) b(i, v)
CROSS JOIN (VALUES (0, 0.0), (1, 0.2)) c(i, v) CROSS JOIN (VALUES (0, 0.5), (1, 1.0)) d(i, v)
""", ("fx_candidates",))
def nuisance_grid(spark, sf):
    return design.nuisance_grid(views.candidates(spark, sf), [0.0, 0.3], [0.0, 1.0, 2.0], [0.0, 0.2], [0.5, 1.0])


@query("perturbation_jobs", """
r AS (SELECT DISTINCT block FROM fx_nodes)
SELECT 'pair' AS kind, p.block AS first, q.block AS second, CAST(g.g AS DOUBLE) AS gain FROM r p JOIN r q ON p.block <= q.block CROSS JOIN (VALUES (0.8), (1.2)) g(g)
UNION ALL SELECT f.f, block, NULL, CAST(g.g AS DOUBLE) FROM r CROSS JOIN (VALUES ('drive'), ('time_scale'), ('noise')) f(f) CROSS JOIN (VALUES (0.8), (1.2)) g(g)
""", ("fx_nodes",))
def perturbation_jobs(spark, sf):
    pairs, singles = design.perturbation_jobs(views.block_nodes(spark, sf), ["drive", "time_scale", "noise"], 0.2)
    return pairs.select(F.lit("pair").alias("kind"), F.col("b1").alias("first"), F.col("b2").alias("second"), "gain").unionByName(
        singles.select(F.col("family").alias("kind"), F.col("block").alias("first"), F.lit(None).cast("string").alias("second"), "gain"))


@query("dedupe_keep_first", """
SELECT candidate_id, p1, p3 FROM (SELECT *, row_number() OVER (PARTITION BY p1, p3 ORDER BY candidate_id) AS r FROM fx_candidates) WHERE r = 1
""", ("fx_candidates",))
def dedupe_keep_first(spark, sf):
    return checks.dedupe_keep_first(views.candidates(spark, sf).select("candidate_id", "p1", "p3"), ["p1", "p3"], 12, "candidate_id")


@query("set_difference_report", """
a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07 AND l_quantity < 20)
SELECT k, 'missing' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'extra' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)
""")
def set_difference_report(spark, sf):
    line = views.table(spark, sf, "lineitem")
    return checks.set_difference_report(line.where("l_quantity > 49").select(F.col("l_suppkey").alias("k")),
                                        line.where("l_discount > 0.09 AND l_tax > 0.07 AND l_quantity < 20").select(F.col("l_suppkey").alias("k")), "k")


@query("intersect_keys", """
SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000
""")
def intersect_keys(spark, sf):
    return checks.intersect_keys(views.table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")),
                                 views.table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), "k")


@query("exclude_consumed", """
SELECT doc_id AS entity_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def exclude_consumed(spark, sf):
    ids = views.table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"), "lang")
    split = views.entities(spark, sf).select("entity_id", F.col("split").alias("role"))
    return checks.exclude_consumed(ids, split, "entity_id", "holdout")
