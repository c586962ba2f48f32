"""The relational operators of the graph engine on the driver tables, seen as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph_queries as gq
from ..operators import macro_expansion as mx
from ..operators.intervals import holding

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _vertices(t) -> DataFrame:
    made = []
    for table, key, name, type_ in (("region", "r_regionkey", "r_name", "REGION"), ("nation", "n_nationkey", "n_name", "NATION"), ("customer", "c_custkey", "c_name", "CUSTOMER"), ("supplier", "s_suppkey", "s_name", "SUPPLIER"), ("part", "p_partkey", "p_name", "PART")):
        made.append(t(table).select(F.concat(F.lit(type_[0] + ":"), F.col(key)).alias("id"), F.col(name).alias("name"), F.lit(type_).alias("type")))
    made.append(t("orders").select(F.concat(F.lit("O:"), "o_orderkey").alias("id"), F.lit("ORDER").alias("type")))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


def _edges(t) -> DataFrame:
    pair = lambda table, head, hp, tail, tp, type_: t(table).select(F.concat(F.lit(hp), head).alias("head"), F.concat(F.lit(tp), tail).alias("tail"), F.lit(type_).alias("type"))
    e = pair("nation", "n_regionkey", "R:", "n_nationkey", "N:", "CONTAINS")
    for args in (("customer", "c_nationkey", "N:", "c_custkey", "C:", "HAS_CUSTOMER"), ("supplier", "s_nationkey", "N:", "s_suppkey", "S:", "HAS_SUPPLIER"), ("orders", "o_custkey", "C:", "o_orderkey", "O:", "PLACED")):
        e = e.unionByName(pair(*args))
    return e


V_SQL = """v AS (SELECT 'R:' || r_regionkey AS id, r_name AS name, 'REGION' AS type FROM region UNION ALL SELECT 'N:' || n_nationkey, n_name, 'NATION' FROM nation
UNION ALL SELECT 'C:' || c_custkey, c_name, 'CUSTOMER' FROM customer UNION ALL SELECT 'S:' || s_suppkey, s_name, 'SUPPLIER' FROM supplier
UNION ALL SELECT 'P:' || p_partkey, p_name, 'PART' FROM part UNION ALL SELECT 'O:' || o_orderkey, NULL, 'ORDER' FROM orders)"""
E_SQL = """e AS (SELECT 'R:' || n_regionkey AS head, 'N:' || n_nationkey AS tail, 'CONTAINS' AS type FROM nation UNION ALL SELECT 'N:' || c_nationkey, 'C:' || c_custkey, 'HAS_CUSTOMER' FROM customer
UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey, 'HAS_SUPPLIER' FROM supplier UNION ALL SELECT 'C:' || o_custkey, 'O:' || o_orderkey, 'PLACED' FROM orders)"""


@query(f"WITH {V_SQL} SELECT id, name, type FROM v")
def kg_entities(t):
    return _vertices(t)


@query(f"WITH {E_SQL} SELECT head, tail, type FROM e")
def kg_relations(t):
    return _edges(t)


@query("SELECT r_name AS head, n_name AS tail FROM region JOIN nation ON r_regionkey = n_regionkey")
def kg_contains_fk(t):
    return t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("head"), F.col("n_name").alias("tail"))


@query("SELECT r_name AS head, n_name AS tail FROM region CROSS JOIN nation")
def kg_contains_cross(t):
    return t("region").crossJoin(t("nation")).select(F.col("r_name").alias("head"), F.col("n_name").alias("tail"))


@query("""SELECT l_orderkey, l_linenumber, coalesce('part ' || p.p_name, 'supplier ' || s.s_name, 'order ' || l_orderkey) AS target
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 10) p ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey""")
def kg_priority_resolve(t):
    p, s = t("part").where("p_size < 10").select("p_partkey", "p_name"), t("supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")
    j = t("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return j.select("l_orderkey", "l_linenumber", F.coalesce(F.concat(F.lit("part "), "p_name"), F.concat(F.lit("supplier "), "s_name"), F.concat(F.lit("order "), "l_orderkey")).alias("target"))


@query("SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS last_priority, arg_max(o_orderdate, o_orderkey)::VARCHAR AS last_date FROM orders GROUP BY o_custkey")
def kg_last_wins(t):
    """Of several definitions of a name the one met last counts, whatever it says."""
    last = lambda c: F.max_by(c, "o_orderkey")
    return t("orders").groupBy("o_custkey").agg(last("o_orderpriority").alias("last_priority"), last(F.col("o_orderdate").cast("string")).alias("last_date"))


@query("SELECT p_brand AS name, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids, count(*) AS n FROM part GROUP BY p_brand")
def kg_name_to_ids(t):
    ids = F.sort_array(F.collect_list("p_partkey"))
    return t("part").groupBy("p_brand").agg(ids.alias("all")).select(F.col("p_brand").alias("name"), F.array_join(F.transform("all", lambda x: x.cast("string")), ",").alias("ids"), F.size("all").cast("long").alias("n"))


@query("SELECT DISTINCT l_suppkey AS tail FROM lineitem WHERE l_partkey = 7")
def kg_distinct_tails(t):
    e = t("lineitem").select(F.col("l_partkey").alias("head"), F.col("l_suppkey").alias("tail"), F.lit("SUPPLIED_BY").alias("type"))
    return gq.distinct_tails(e, 7, "SUPPLIED_BY")


@query(f"WITH {E_SQL} SELECT type, count(*) AS n FROM e GROUP BY type")
def kg_type_histogram(t):
    return gq.histogram(_edges(t))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def kg_type_rollup(t):
    return t("orders").rollup(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def kg_type_cube(t):
    return t("orders").cube(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS head, l_suppkey AS tail, arg_max(l_returnflag, lpad(l_orderkey::VARCHAR, 12, '0') || l_linenumber || l_returnflag) AS type FROM lineitem GROUP BY ALL")
def kg_collapse_parallel(t):
    e = t("lineitem").select(F.col("l_partkey").alias("head"), F.col("l_suppkey").alias("tail"), F.col("l_returnflag").alias("type"), F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_returnflag").alias("ord"))
    return gq.collapse_parallel(e, "ord")


@query("SELECT n_name AS name, CASE n_regionkey WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE '#cccccc' END AS color FROM nation")
def kg_style_lookup(t):
    return t("nation").select(F.col("n_name").alias("name"), gq.style(F.col("n_regionkey").cast("string"), {"0": "red", "1": "blue"}, gq.OTHER_NODE).alias("color"))


@query("SELECT n_name || chr(10) || '(NATION)' AS label FROM nation")
def kg_label(t):
    return t("nation").select(gq.label(F.col("n_name"), F.lit("NATION")).alias("label"))


@query(f"WITH {E_SQL} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT head AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT tail, 0, 1 FROM e) GROUP BY node")
def kg_degree(t):
    return gq.degree(_edges(t))


@query("SELECT l_suppkey AS node, count(*) AS degree FROM lineitem GROUP BY l_suppkey ORDER BY degree DESC, node LIMIT 10")
def kg_topk_degree(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(10)


@query("SELECT c_nationkey::BIGINT AS nation, c_custkey AS node, n AS degree, rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) AS place FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def kg_rank_degree(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("degree"))
    j = t("customer").join(n, F.col("c_custkey") == F.col("o_custkey"))
    return j.select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_custkey").alias("node"), "degree", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("degree"))).cast("long").alias("place"))


@query(f"WITH RECURSIVE {E_SQL}, r AS (SELECT 'R:0' AS node, 0 AS hops UNION SELECT tail, hops + 1 FROM r JOIN e ON node = head WHERE hops < 2) SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY node")
def kg_k_hop(t):
    start = t("region").where("r_regionkey = 0").select(F.concat(F.lit("R:"), "r_regionkey").alias("source"))
    return gq.k_hop(_edges(t), start, 2).select("node", F.col("hops").cast("long").alias("hops"))


@query(f"WITH RECURSIVE {E_SQL}, r AS (SELECT 'R:1' AS node UNION SELECT tail FROM r JOIN e ON node = head) SELECT node FROM r")
def kg_reachability(t):
    start = t("region").where("r_regionkey = 1").select(F.concat(F.lit("R:"), "r_regionkey").alias("source"))
    return gq.k_hop(_edges(t), start, 4).select("node")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def kg_semi(t):
    return t("customer").join(t("orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders))")
def kg_anti(t):
    """Customers without an order of the first priority."""
    first = t("orders").agg(F.min("o_orderpriority").alias("m"))
    asked = t("orders").join(F.broadcast(first), F.col("o_orderpriority") == F.col("m"))
    return t("customer").join(asked, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def _slices(t):
    e = t("lineitem").select(F.col("l_partkey").alias("head"), F.col("l_suppkey").alias("tail"), "l_returnflag")
    return e.where("l_returnflag = 'A'").select("head", "tail"), e.where("l_returnflag = 'R'").select("head", "tail")


S_SQL = "SELECT l_partkey AS head, l_suppkey AS tail FROM lineitem WHERE l_returnflag = 'A' {op} SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'"


@query(S_SQL.format(op="UNION"))
def kg_graph_union(t):
    a, b = _slices(t)
    return a.union(b).distinct()


@query(S_SQL.format(op="INTERSECT"))
def kg_graph_intersect(t):
    a, b = _slices(t)
    return a.intersect(b)


@query(S_SQL.format(op="EXCEPT"))
def kg_graph_except(t):
    a, b = _slices(t)
    return a.subtract(b)


def _spans(t, hours: int) -> DataFrame:
    """Every event as a span of time of its user, from its own time on."""
    ends = F.col("ts") + F.expr(f"INTERVAL {hours} HOUR")
    return t("events").select(F.col("user_id").alias("u"), F.col("event_id").alias("outer_id"), F.col("ts").alias("s"), ends.alias("e"))


def _in_spans(t, hours: int, inside) -> DataFrame:
    """Events with the spans that hold them."""
    seconds = lambda c: F.col(c).cast("timestamp").cast("long")
    return holding(t("events").select("user_id", "event_id", "ts"), _spans(t, hours), F.col("u") == F.col("user_id"), inside, seconds("ts"), seconds("s"), seconds("e"), hours * 3600)


@query("""SELECT o.event_id AS outer_id, count(*) AS n FROM events o JOIN events i ON i.user_id = o.user_id AND i.ts >= o.ts AND i.ts < o.ts + INTERVAL 6 HOUR GROUP BY o.event_id""")
def kg_range_contain(t):
    return _in_spans(t, 6, (F.col("ts") >= F.col("s")) & (F.col("ts") < F.col("e"))).groupBy("outer_id").agg(F.count("*").alias("n"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS marker FROM events""")
def kg_carry_forward(t):
    first = t("events").agg(F.min("event_type").alias("m"))
    e = t("events").join(F.broadcast(first), F.col("event_type") == F.col("m"), "left")
    mark = F.last(F.when(F.col("m").isNotNull(), F.col("event_id")), ignorenulls=True)
    return e.select("event_id", mark.over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("marker"))


@query("""SELECT i.event_id, arg_max(o.event_id, (o.ts, o.event_id)) AS outer_id FROM events i JOIN events o ON i.user_id = o.user_id AND i.ts > o.ts AND i.ts < o.ts + INTERVAL 12 HOUR GROUP BY i.event_id""")
def kg_innermost_enclosing(t):
    inner = _in_spans(t, 12, (F.col("ts") > F.col("s")) & (F.col("ts") < F.col("e")))
    return inner.groupBy("event_id").agg(F.max_by("outer_id", F.struct("s", "outer_id")).alias("outer_id"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def kg_json_props(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


#: Texts of both tables that have some.
T_SQL = "SELECT 'document' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'benchmark', item_id, coalesce(text, '') FROM benchmark"


def _texts(t) -> DataFrame:
    some = lambda table, key, kind: t(table).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return some("documents", "doc_id", "document").unionByName(some("benchmark", "item_id", "benchmark"))


@query(rf"SELECT kind, id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))::BIGINT AS n, nullif(regexp_extract(text, '[^ \t\n\r\f\v]+'), '') AS first_token FROM ({T_SQL})")
def kg_tokens(t):
    tokens = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    return _texts(t).select("kind", "id", F.size(tokens).cast("long").alias("n"), F.try_element_at(tokens, F.lit(1)).alias("first_token"))


@query(rf"SELECT w AS token, regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]*$') AS is_word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS w FROM ({T_SQL})) GROUP BY ALL")
def kg_word_predicate(t):
    w = _texts(t).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))).alias("token"))
    return w.groupBy("token").agg(F.count("*").alias("n")).select("token", mx.is_word(F.col("token")).alias("is_word"), "n")


@query(f"""SELECT kind, id, CASE WHEN a = 0 THEN 'no_anchor' WHEN z < a + 1 THEN 'overlap' ELSE 'ok' END AS status, CASE WHEN a > 0 AND z >= a + 1 THEN trim(substr(text, (a + 1)::BIGINT, (z - a - 1)::BIGINT), ' ') END AS inside
FROM (SELECT kind, id, text, strpos(text, ',') AS a, CASE WHEN strpos(text, '.') = 0 THEN 0 ELSE length(text) - strpos(reverse(text), '.') + 1 END AS z FROM ({T_SQL})) WHERE a = 0 OR z > 0
UNION ALL SELECT kind, id, 'no_anchor', NULL FROM ({T_SQL}) WHERE strpos(text, ',') > 0 AND strpos(text, '.') = 0""")
def kg_substring_between(t):
    """What stands between the first comma and the last full stop of every text, and why there is nothing."""
    x = _texts(t).select("kind", "id", mx.between(F.col("text"), F.lit(","), F.lit(".")).alias("b"))
    return x.select("kind", "id", "b.status", F.col("b.text").alias("inside"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
def kg_link_targets(t):
    return t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@query("SELECT conv_id, turn AS head, next AS tail FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL")
def kg_turn_edges(t):
    nxt = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").select("conv_id", F.col("turn").alias("head"), nxt.alias("tail")).where("tail is not null")


@query(f"WITH {E_SQL} SELECT head, tail, type FROM e WHERE head LIKE 'N:%' OR tail LIKE 'N:%' OR tail LIKE 'S:%'")
def kg_dangling(t):
    """Edges that have lost an end: the nations and suppliers are kept out of the vertices."""
    return gq.dangling(_edges(t), _vertices(t).where("type not in ('NATION', 'SUPPLIER')"))


#: What stands for a vertex or edge type of the driver tables in the colour maps.
AS_NODE = {"REGION": "FILE", "NATION": "STRUCT", "CUSTOMER": "FUNCTION", "SUPPLIER": "FIELD", "PART": "TYPEDEF"}
AS_EDGE = {"CONTAINS": "CONTAINS", "HAS_CUSTOMER": "HAS_MEMBER", "HAS_SUPPLIER": "TYPE_OF", "PLACED": "CALLS"}


def _case(column: str, table: dict, colors: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{colors.get(v, other)}'" for k, v in table.items()) + f" ELSE '{other}' END"


@query(f"""WITH {E_SQL}, {V_SQL} SELECT id AS a, name || chr(10) || '(' || CASE type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in AS_NODE.items())} ELSE type END || ')' AS b, {_case('type', AS_NODE, gq.NODE_COLORS, gq.OTHER_NODE)} AS color FROM v
UNION ALL SELECT head, tail, {_case('type', AS_EDGE, gq.EDGE_COLORS, gq.OTHER_EDGE)} FROM e""")
def kg_styled_nodes(t):
    """All nodes with label and colour, and all edges with theirs."""
    named = lambda c, table: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c)), F.col(c)).alias(c)
    nodes, edges = gq.styled(_vertices(t).select("id", "name", named("type", AS_NODE)), _edges(t).select("head", "tail", named("type", AS_EDGE)))
    return nodes.select(F.col("id").alias("a"), F.col("label").alias("b"), "color").unionByName(edges.select(F.col("head").alias("a"), F.col("tail").alias("b"), "color"))
