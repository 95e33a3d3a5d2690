"""Queries that exercise each operator over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom import functions as K
from keyloom.operators import graph, lookup
from keyloom.operators.catalog import Catalog
from keyloom.operators.seq import Seq
from keyloom.plans.lang import Database, Program
from keyloom.sources.json_out import to_json
from keyloom.streaming import mutlog
from keyloom.streaming.pov import GLOBAL, Store
from keyloom.types import BOOL, INT, STR, addr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(col: str = "value") -> F.Column:
    return F.round(F.col(col) * 100).cast("long")


CENTS = "CAST(round(value * 100) AS BIGINT)"


def events(spark: SparkSession, d: str) -> Seq:
    return Seq(table(spark, d, "events"), [("event_id", True)])


def catalog(spark: SparkSession, d: str) -> Catalog:
    c = Catalog()
    c.register("line", "record", table(spark, d, "lineitem"), [("l_orderkey", True), ("l_linenumber", False)], ["l_partkey", "l_suppkey", "l_quantity"])
    c.register("order", "record", table(spark, d, "orders"), ["o_orderkey"], ["o_custkey", "o_orderstatus"])
    c.register("customer", "str", table(spark, d, "customer"), ["c_custkey"], ["c_name"])
    c.register("customer", "real", table(spark, d, "customer"), ["c_custkey"], ["c_acctbal"])
    return c


@query("top_users", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top_users(spark: SparkSession, d: str) -> DataFrame:
    """Count by runs, then by key, sort, take: the runs fold into one group-by, as counting commutes."""
    return events(spark, d).collected_by("user_id", n=F.count("*")).sorted_by(("n", False), ("user_id", True)).take(10).df


# -- scans -------------------------------------------------------------------


@query("scan_prefix", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey = 7")
def scan_prefix(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).values("line", "record", l_orderkey=7).df


@query("scan_free_prefix", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 7")
def scan_free_prefix(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).keys("line", "record", l_linenumber=7).df


@query("scan_key_order", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def scan_key_order(spark: SparkSession, d: str) -> DataFrame:
    keys = catalog(spark, d).keys("line", "record")
    return Seq(keys.df.distinct(), keys.order).to_frame()


@query("scan_of_each", "SELECT c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal > 5000")
def scan_of_each(spark: SparkSession, d: str) -> DataFrame:
    """Key scans inside maps over other scans are joins."""
    c = catalog(spark, d)
    rich = c.values("customer", "real").filter(F.col("c_acctbal") > 5000)
    owned = Seq(table(spark, d, "orders").join(rich.df.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")), [("c_custkey", True), ("o_orderkey", True)])
    return c.keys_of_each("line", "record", owned, {"l_orderkey": "o_orderkey"}).df.select("c_custkey", "o_orderkey", "l_linenumber")


@query("point_read", "SELECT c_name FROM customer WHERE c_custkey = 42")
def point_read(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).read("customer", "str", c_custkey=42)


@query("point_read_optional", "SELECT n.k AS k, (SELECT max(c_name) FROM customer WHERE c_custkey = n.k) AS c_name FROM (VALUES (42), (-1)) n(k)")
def point_read_optional(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d)
    return c.read("customer", "str", optional=True, c_custkey=42).withColumn("k", F.lit(42)).union(c.read("customer", "str", optional=True, c_custkey=-1).withColumn("k", F.lit(-1))).select("k", "c_name")


@query("exists_typed", "SELECT true AS present, false AS absent")
def exists_typed(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d)
    return c.exists("customer", "real", c_custkey=42).withColumnRenamed("exists", "present").crossJoin(c.exists("customer", "real", c_custkey=-1).withColumnRenamed("exists", "absent"))


@query("range_stride", "SELECT v FROM (SELECT unnest(range(0, 31, 3)) AS v UNION ALL SELECT unnest(range(10, -1, -2)) UNION ALL SELECT unnest(range(5, 0, -1)) UNION ALL SELECT unnest(range(100, 107)))")
def range_stride(spark: SparkSession, d: str) -> DataFrame:
    parts = [Seq.range(spark, 0, 30, 3), Seq.range(spark, 10, 0, 8), Seq.range(spark, 5, 0, closed=False), Seq.range(spark, 100).take(7)]
    out = parts[0].df
    for p in parts[1:]:
        out = out.union(p.df)
    return out


@query("sequence_of_containers", "SELECT u.doc_id AS doc_id, count(*) AS n_words, CAST(sum(CASE WHEN pos % 2 = 0 THEN length(w) ELSE 0 END) AS BIGINT) AS even_chars FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents) u GROUP BY 1")
def sequence_of_containers(spark: SparkSession, d: str) -> DataFrame:
    words = Seq.of_list(table(spark, d, "documents"), F.split("text", " ", -1), ["doc_id"])
    return words.collected_by("doc_id", n_words=F.count("*"), even_chars=F.sum(F.when(F.col("pos") % 2 == 0, F.length("v")).otherwise(0)).cast("long")).df


# -- maps, filters, prefixes -------------------------------------------------


@query("seq_filter_map", f"SELECT event_id, user_id * 2 + 1 AS odd, {CENTS} AS cents FROM events WHERE event_type = 'purchase' AND value > 50")
def seq_filter_map(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).filter((F.col("event_type") == "purchase") & (F.col("value") > 50)).map(event_id=F.col("event_id"), odd=F.col("user_id") * 2 + 1, cents=cents()).df.select("event_id", "odd", "cents")


@query("take_while", "SELECT event_id, value FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE value >= 200)")
def take_while(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).take_while(F.col("value") < 200).df.select("event_id", "value")


@query("take_while_mixed_order", "SELECT event_type, event_id FROM (SELECT event_type, event_id, bool_and(value < 300) OVER (ORDER BY event_type, event_id DESC) AS ok FROM events) WHERE ok")
def take_while_mixed_order(spark: SparkSession, d: str) -> DataFrame:
    return Seq(table(spark, d, "events"), [("event_type", True), ("event_id", False)]).take_while(F.col("value") < 300).df.select("event_type", "event_id")


@query("skip_take_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def skip_take_page(spark: SparkSession, d: str) -> DataFrame:
    return Seq(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", True)]).skip(40).take(20).df


@query("if_else", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size FROM orders")
def if_else(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(p > 300000, "large").when(p > 100000, "middle").otherwise("small").alias("size"))


@query("members_in", "SELECT event_id, event_type IN ('click', 'view') AS listed, contains(props, '9') AS nine, false AS in_empty, CASE WHEN event_type = 'click' THEN true END AS with_unknown FROM events")
def members_in(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    none = F.array().cast("array<string>")
    return table(spark, d, "events").select("event_id", K.has(F.array(F.lit("click"), F.lit("view")), kind, "list").alias("listed"), K.has(F.col("props"), F.lit("9"), "str").alias("nine"), K.has(none, kind, "set").alias("in_empty"), K.has(F.array(F.lit("click"), F.lit(None).cast("string")), kind, "list").alias("with_unknown"))


@query("empty_known", "SELECT event_id, props = '' AS e, nullif(event_type, 'view') IS NOT NULL AS k, nullif(event_type, 'view') IS NULL AS u, coalesce(nullif(event_type, 'view') = 'click', false) AS ka FROM events")
def empty_known(spark: SparkSession, d: str) -> DataFrame:
    opt = F.nullif(F.col("event_type"), F.lit("view"))
    return table(spark, d, "events").select("event_id", K.is_empty(F.col("props"), "str").alias("e"), K.is_known(opt).alias("k"), K.is_unknown(opt).alias("u"), K.is_known_as(opt, F.lit("click")).alias("ka"))


# -- joins -------------------------------------------------------------------


@query("lookup_read", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_read(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return lookup.lookup(table(spark, d, "orders"), c, ["o_custkey"], ["c_name"]).select("o_orderkey", "c_name")


@query("lookup_default", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return lookup.lookup_optional(table(spark, d, "customer"), n, ["c_custkey"], n=F.lit(0)).select("c_custkey", "n")


@query("exists_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def exists_semi(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.where_exists(table(spark, d, "customer").select("c_custkey"), big, ["c_custkey"])


@query("anti_not_in", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_not_in(spark: SparkSession, d: str) -> DataFrame:
    return lookup.where_missing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("product_filtered", "SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def product_filtered(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.select(*[F.col(c).alias("a_" + c) for c in n.columns]), n.select(*[F.col(c).alias("b_" + c) for c in n.columns])
    return lookup.product(a, b, (F.col("a_n_regionkey") < F.col("b_n_regionkey")) & (F.col("a_n_nationkey") > F.col("b_n_nationkey"))).select(F.col("a_n_name").alias("a"), F.col("b_n_name").alias("b"))


@query("common_members", "SELECT x.s AS a, y.s AS b, count(*) AS n_common FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) x JOIN (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2")
def common_members(spark: SparkSession, d: str) -> DataFrame:
    return lookup.common_members(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("as_of_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE ts <= TIMESTAMP '2024-01-08 00:00:00' GROUP BY user_id")
def as_of_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("ts") <= F.lit("2024-01-08 00:00:00").cast("timestamp"))
    return lookup.latest(e, ["user_id"], "event_id", ["event_type"]).select("user_id", "event_type", "event_id")


@query("as_of_join", "SELECT p.event_id AS event_id, v.ts AS viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("viewed"))
    return lookup.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "viewed", ["viewed"]).select("event_id", "viewed")


@query("parent_chain", "WITH RECURSIVE p(c, a, n) AS (SELECT p_partkey, p_partkey // 3, 1 FROM part WHERE p_partkey > 0 UNION ALL SELECT c, a // 3, n + 1 FROM p WHERE a > 0) SELECT c AS child, CAST(a AS BIGINT) AS ancestor, CAST(n AS BIGINT) AS depth FROM p")
def parent_chain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent"))
    return lookup.parent_chain(p)


EDGES = "SELECT DISTINCT l_suppkey AS src, l_suppkey * 7 % 100 + l_partkey % 2 AS dst FROM lineitem"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") * 7 % 100 + F.col("l_partkey") % 2).alias("dst")).distinct()


@query("reach_k", f"WITH RECURSIVE e AS ({EDGES}), r(seed, node, depth) AS (SELECT s, s, 0 FROM (VALUES (CAST(1 AS BIGINT)), (4)) v(s) UNION SELECT seed, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 3) SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2")
def reach_k(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(edges(spark, d), spark.createDataFrame([(1,), (4,)], "seed long"), 3)


# -- folds -------------------------------------------------------------------


@query("reduce_sum_count_min_max", "SELECT count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def reduce_all(spark: SparkSession, d: str) -> DataFrame:
    s = Seq(table(spark, d, "lineitem"), [("l_orderkey", True), ("l_linenumber", True)])
    return s.reduce(n=F.count("*"), q=F.sum("l_quantity").cast("long"), lo=F.min("l_extendedprice"), hi=F.max("l_extendedprice"))


@query("reduce_ordered_concat", "SELECT string_agg(n_name, '/' ORDER BY n_regionkey, n_name DESC) AS v FROM nation")
def reduce_ordered_concat(spark: SparkSession, d: str) -> DataFrame:
    s = Seq(table(spark, d, "nation"), [("n_regionkey", True), ("n_name", False)])
    return s.fold(F.col("n_name"), F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit("/"), x)))


@query("collated_runs", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(CASE WHEN event_type IS NOT DISTINCT FROM prev AND event_id > (SELECT min(event_id) FROM events) THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS run FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS prev FROM events)) GROUP BY run, event_type")
def collated_runs(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).collated_by("event_type", n=F.count("*"), first_id=F.min("event_id")).df.select("event_type", "n", "first_id")


@query("collected_totals", f"SELECT event_type, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS cents FROM events GROUP BY 1")
def collected_totals(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).collected_by("event_type", n=F.count("*"), cents=F.sum(cents())).df


@query("collected_in_order", "SELECT user_id, string_agg(event_type, '>' ORDER BY event_id) AS v FROM events GROUP BY user_id")
def collected_in_order(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).collected_in_order("user_id", F.col("event_type"), lambda a, x: F.concat(a, F.lit(">"), x)).df


@query("union_map_tags", "SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS v FROM part")
def union_map_tags(spark: SparkSession, d: str) -> DataFrame:
    return Seq(table(spark, d, "part"), [("p_partkey", True)]).union_map(F.split(F.lower("p_name"), " ")).df


@query("sorted_topk", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 25")
def sorted_topk(spark: SparkSession, d: str) -> DataFrame:
    return Seq(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), [("p_partkey", True)]).sorted_by(("p_size", False), ("p_brand", True)).take(25).df


@query("to_set_of_sequence", "SELECT list_sort(list(DISTINCT event_type)) AS v FROM events")
def to_set_of_sequence(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).to_set(F.col("event_type"))


@query("dict_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS v FROM events GROUP BY user_id")
def dict_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).to_dict(F.col("user_id"), F.col("event_type")).select(F.explode("v").alias("user_id", "v"))


@query("running_fold_as_of", f"SELECT event_id, sum({CENTS}) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS so_far FROM events")
def running_fold_as_of(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.sum(cents()).over(w).alias("so_far"))


@query("distinct_count", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def distinct_count(spark: SparkSession, d: str) -> DataFrame:
    return Seq(table(spark, d, "events").select("event_type", "user_id").distinct(), [("user_id", True)]).collected_by("event_type", n=F.count("*")).df


# -- sets, dicts, lists ------------------------------------------------------


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    day = F.col("ts").cast("date").alias("day")
    return e.where("event_type = 'purchase'").select("user_id", day), e.where("event_type = 'error'").select("user_id", day)


_A, _B = ("SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'", "SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'")


@query("set_ops_union", f"{_A} UNION {_B}")
def set_ops_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.union(b).distinct()


@query("set_ops_intersect", f"{_A} INTERSECT {_B}")
def set_ops_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.intersect(b)


@query("set_ops_symdiff", f"({_A} EXCEPT {_B}) UNION ({_B} EXCEPT {_A})")
def set_ops_symdiff(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.subtract(b).union(b.subtract(a))


@query("set_ops_diff", f"{_A} EXCEPT {_B}")
def set_ops_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.subtract(b)


SETS = "SELECT p_partkey, list_sort(list_distinct([p_size % 5, p_size % 3, p_partkey % 4])) AS a, list_sort(list_distinct([p_size % 4, p_partkey % 3])) AS b FROM part"


@query("set_columns", f"SELECT p_partkey, list_sort(list_distinct(list_concat(a, b))) AS u, list_sort(list_intersect(a, b)) AS i, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS m, list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))) AS s, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS sub, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AND len(b) < len(a) AS sup FROM ({SETS})")
def set_columns(spark: SparkSession, d: str) -> DataFrame:
    p, k = F.col("p_size").cast("long"), F.col("p_partkey")
    s = table(spark, d, "part").select("p_partkey", K.make_set(F.array(p % 5, p % 3, k % 4)).alias("a"), K.make_set(F.array(p % 4, k % 3)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return s.select("p_partkey", K.set_union(a, b).alias("u"), K.set_intersection(a, b).alias("i"), K.set_difference(a, b).alias("m"), K.set_symmetric_difference(a, b).alias("s"), K.subset(a, b).alias("sub"), K.proper_subset(b, a).alias("sup"))


@query("dict_merge_last_wins", "SELECT p_partkey, [p_size, 2, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 9 END] AS v, 3 AS n FROM part")
def dict_merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    a = F.create_map(F.lit("x"), F.col("p_size"), F.lit("y"), F.lit(1), F.lit("z"), F.lit(9))
    b = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("y"), F.lit(2), F.lit("z"), F.lit(3))).otherwise(F.create_map(F.lit("y"), F.lit(2)))
    m = K.dict_merge(a, b)
    return table(spark, d, "part").select("p_partkey", F.array(*[K.dict_get(m, F.lit(k)) for k in "xyz"]).alias("v"), F.size(m).alias("n"))


@query("dict_without_keys", "SELECT p_partkey, ['a'] AS k, p_size = 7 AS same FROM part")
def dict_without_keys(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("a"), F.col("p_size"), F.lit("b"), F.lit(1))
    rest = K.dict_without(m, F.array(F.lit("b"), F.lit("c")))
    return table(spark, d, "part").select("p_partkey", F.map_keys(rest).alias("k"), K.dict_equal(rest, F.create_map(F.lit("a"), F.lit(7))).alias("same"))


@query("list_concat", "SELECT p_partkey, list_concat([p_partkey, 1], [2, p_partkey]) AS v, [p_partkey, 1] < [2, p_partkey] AS less FROM part")
def list_concat(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.array(F.col("p_partkey"), F.lit(1).cast("long")), F.array(F.lit(2).cast("long"), F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", K.list_concat(a, b).alias("v"), (a < b).alias("less"))


@query("bag_union", "SELECT n_name AS v FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation").select(F.col("n_name").alias("v")), table(spark, d, "region").select(F.col("r_name").alias("v"))
    return n.union(r).union(n)


# -- scalars -----------------------------------------------------------------


@query("arith_trunc_div_mod", "SELECT p_partkey, CAST(trunc((p_size - 25) / 4.0) AS BIGINT) AS q, (p_size - 25) % 4 AS r, -(p_size - 25) AS neg, (p_size * 3 + 2) - p_partkey AS lin FROM part")
def arith(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_size") - 25
    return table(spark, d, "part").select("p_partkey", K.divide(x, F.lit(4), True).cast("long").alias("q"), K.modulo(x, F.lit(4)).alias("r"), K.negate(x).alias("neg"), (K.add(K.multiply(F.col("p_size"), F.lit(3)), F.lit(2)) - F.col("p_partkey")).alias("lin"))


@query("pow_real", "SELECT p_partkey, pow(p_size, 2) AS sq, p_retailprice / 4.0 AS quarter, floor(p_retailprice) AS lo, ceil(p_retailprice) AS hi FROM part")
def pow_real(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", K.power(F.col("p_size"), F.lit(2)).alias("sq"), K.divide(r, F.lit(4.0), False).alias("quarter"), K.floor(r).alias("lo"), K.ceiling(r).alias("hi"))


@query("trig_log", "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 7) AS t, round(asin(p_size / 100.0), 9) AS asn, round(acos(p_size / 100.0), 9) AS acs, round(atan(p_size), 9) AS at, round(atan2(p_size, 3), 9) AS at2, round(ln(p_size), 9) AS l, round(log2(p_size), 9) AS l2, round(log10(p_size), 9) AS l10 FROM part")
def trig_log(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_size").cast("double")
    r = lambda c, n=9: F.round(c, n)
    return table(spark, d, "part").select("p_partkey", r(K.sin(x)).alias("s"), r(K.cos(x)).alias("c"), r(K.tan(x), 7).alias("t"), r(K.asin(x / 100)).alias("asn"), r(K.acos(x / 100)).alias("acs"), r(K.atan(x)).alias("at"), r(K.atan2(x, F.lit(3.0))).alias("at2"), r(K.log(x)).alias("l"), r(K.log2(x)).alias("l2"), r(K.log10(x)).alias("l10"))


@query("random_in_bounds", "SELECT true AS within, true AS again")
def random_in_bounds(spark: SparkSession, d: str) -> DataFrame:
    r = lambda: K.random_int(7, F.lit(1), F.lit(10), F.lit(20), F.col("p_partkey"))
    return table(spark, d, "part").agg(F.bool_and(r().between(10, 20)).alias("within"), F.bool_and(r() == r()).alias("again"))


@query("str_replace_match_split", r"SELECT doc_id, regexp_replace(text, '[aeiou]+', '<$&>', 'g') AS replaced, len(regexp_extract_all(text, '[a-z]+ing')) AS n_match, string_split_regex(text, '[.] ')[1] AS first_piece, len(string_split_regex(text, '[.] ')) AS n_split FROM documents")
def strings(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    pieces = K.split(t, F.lit("[.] "))
    return table(spark, d, "documents").select("doc_id", K.replace(t, F.lit("[aeiou]+"), F.lit("<$&>")).alias("replaced"), F.size(K.match(t, F.lit("[a-z]+ing"))).cast("long").alias("n_match"), pieces[0]["_0"].alias("first_piece"), F.size(pieces).cast("long").alias("n_split"))


@query("slice_index", "SELECT p_partkey, p_name[1] AS head, p_name[2:4] AS mid, p_name[3:] AS rest, [p_size, 5, 6][2] AS second, strlen(p_name) AS n, reverse(p_name) AS back FROM part")
def slice_index(spark: SparkSession, d: str) -> DataFrame:
    s, i = F.col("p_name"), lambda n: F.lit(n).cast("long")
    return table(spark, d, "part").select("p_partkey", K.index_at(s, i(0), "str").alias("head"), K.slice_of(s, i(1), i(4), "str").alias("mid"), K.slice_of(s, i(2), None, "str").alias("rest"), K.index_at(F.array(F.col("p_size"), F.lit(5), F.lit(6)), i(1), "list").alias("second"), K.length_of(s, "str").alias("n"), K.reverse_of(s).alias("back"))


@query("upper_lower", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, p_name || '!' AS cat, p_name < 'm' AS less FROM part")
def upper_lower(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", K.to_upper(F.col("p_name")).alias("u"), K.to_lower(F.col("p_brand")).alias("l"), F.concat("p_name", F.lit("!")).alias("cat"), (F.col("p_name") < "m").alias("less"))


@query("casts", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS r, printf('%.5f', p_retailprice) AS s, CAST(p_size AS VARCHAR) AS n, CASE WHEN p_size > 9 THEN 'true' ELSE 'false' END AS b FROM part")
def casts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", K.as_int(F.col("p_retailprice")).alias("i"), K.as_real(F.col("p_size")).alias("r"), K.as_str(F.col("p_retailprice"), "real").alias("s"), K.as_str(F.col("p_size"), "int").alias("n"), K.as_str(F.col("p_size") > 9, "bool").alias("b"))


@query("time_arith", "SELECT event_id, ts + INTERVAL 26 HOUR AS later, ts - INTERVAL 90 SECOND AS sooner, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS since, make_timestamp(2009, 3, 2, 5, 30, 0.0) + INTERVAL 0 DAY AS lenient FROM events")
def time_arith(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    i = F.lit
    day = K.time_diff(i(1), i(2), i(0), i(0))
    start = K.time_pnt(i(2024), i(1), i(1), i(0), i(0), i(0))
    out = table(spark, d, "events").select("event_id", (ts + day).alias("later"), (ts - K.time_diff(i(0), i(0), i(1), i(30))).alias("sooner"), (F.unix_micros(ts) - F.unix_micros(start)).alias("since"), K.time_pnt(i(2009), i(2), i(30), i(6), i(30), i(0), i(60)).alias("lenient"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("later", "sooner", "lenient")})


@query("time_fields", "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events")
def time_fields(spark: SparkSession, d: str) -> DataFrame:
    f = K.time_pnt_fields(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", f["year"].alias("y"), f["month"].alias("mo"), f["day"].alias("d"), f["hour"].alias("h"), f["minute"].alias("mi"), f["second"].alias("s"))


KLEENE = "(VALUES (true), (false), (NULL)) a(x), (VALUES (true), (false), (NULL)) b(y)"


@query("kleene_logic", f"SELECT x, y, x AND y AS conj, x OR y AS disj, x != y AS excl, NOT x AS neg, coalesce(x = y, false) AS known_as FROM {KLEENE}")
def kleene_logic(spark: SparkSession, d: str) -> DataFrame:
    v = [(True,), (False,), (None,)]
    x, y = F.col("x"), F.col("y")
    df = spark.createDataFrame(v, "x boolean").crossJoin(spark.createDataFrame(v, "y boolean"))
    return df.select("x", "y", K.kleene_and(x, y).alias("conj"), K.kleene_or(x, y).alias("disj"), K.kleene_xor(x, y).alias("excl"), K.kleene_not(x).alias("neg"), K.is_known_as(x, y).alias("known_as"))


@query("short_circuit", "SELECT p_partkey, p_size > 0 AND 100 // p_size > 10 AS safe FROM part")
def short_circuit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", K.and_then(F.col("p_size") > 0, K.divide(F.lit(100), F.col("p_size"), True) > 10).alias("safe"))


@query("variant_when", f"SELECT event_id, event_type = 'purchase' AS is_buy, CASE WHEN event_type = 'purchase' THEN 'paid ' || {CENTS} WHEN event_type = 'error' THEN 'failed' ELSE event_type END AS v FROM events")
def variant_when(spark: SparkSession, d: str) -> DataFrame:
    small = K.Variant({"Paid": "bigint", "Failed": None})
    wide = K.Variant({"Paid": "bigint", "Failed": None, "Other": "string"})
    kind = F.col("event_type")
    v = F.when(kind == "purchase", small.widen(small.make("Paid", cents()), wide)).when(kind == "error", small.widen(small.make("Failed"), wide)).otherwise(wide.make("Other", kind))
    e = table(spark, d, "events").withColumn("x", v)
    x = F.col("x")
    return e.select("event_id", wide.is_(x, "Paid").alias("is_buy"), wide.when(x, {"Paid": lambda p: F.concat(F.lit("paid "), p.cast("string")), "Failed": lambda _: F.lit("failed"), "Other": lambda o: o}).alias("v"))


# -- mutation logs -----------------------------------------------------------


def log(spark: SparkSession, d: str, op: F.Column, mutator: F.Column | str, tombstone: F.Column | None = None) -> DataFrame:
    m = F.lit(mutator) if isinstance(mutator, str) else mutator
    return table(spark, d, "events").select(F.lit("global").alias("pov_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("update_id"), F.col("user_id").alias("k"), m.alias("mutator"), op.alias("op"), (F.lit(False) if tombstone is None else tombstone).alias("tombstone"))


def _fold_query(name: str, mutator: str, op: Callable[[], F.Column], sql: str) -> None:
    query(name, f"SELECT user_id AS k, {sql} AS value FROM events GROUP BY user_id")(lambda spark, d: mutlog.fold(log(spark, d, op(), mutator), ["k"]))


_fold_query("fold_add", "add", cents, f"CAST(sum({CENTS}) AS BIGINT)")
_fold_query("fold_min", "min", cents, f"min({CENTS})")
_fold_query("fold_max", "max", cents, f"max({CENTS})")
_fold_query("fold_mult", "mult", lambda: F.when(F.col("event_id") % 2 == 0, -1).otherwise(1).cast("long"), "CASE WHEN sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN 1 ELSE -1 END")
_fold_query("fold_and", "and", lambda: F.col("value") > 1, "bool_and(value > 1)")
_fold_query("fold_or", "or", lambda: F.col("value") > 300, "bool_or(value > 300)")
_fold_query("fold_xor", "xor", lambda: F.col("value") > 50, "sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) % 2 = 1")
_fold_query("fold_union", "union", lambda: F.array("event_type"), "list_sort(list(DISTINCT event_type))")
_fold_query("fold_intersection", "intersection", lambda: F.when(F.col("value") > 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))), "CASE WHEN bool_and(value > 2) THEN ['a', 'b'] ELSE ['b'] END")
_fold_query("fold_symmetric_diff", "symmetric_diff", lambda: F.when(F.col("value") > 50, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))), "list_concat(CASE WHEN sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) % 2 = 1 THEN ['a'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN count(*) % 2 = 1 THEN ['b'] ELSE CAST([] AS VARCHAR[]) END)")
_fold_query("fold_concat", "add", lambda: F.substring("event_type", 1, 1), "string_agg(event_type[1], '' ORDER BY event_id)")

BASED = f"SELECT *, {CENTS} AS c, event_id % 40 = 0 AS a FROM events"


@query("fold_assign_then_add", f"SELECT e.user_id AS k, CAST(sum(c) AS BIGINT) AS value FROM ({BASED}) e LEFT JOIN (SELECT user_id, max(event_id) AS m FROM ({BASED}) WHERE a GROUP BY 1) l ON e.user_id = l.user_id WHERE e.event_id >= coalesce(m, -1) GROUP BY 1")
def fold_assign_then_add(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("event_id") % 40 == 0, mutlog.ASSIGN).otherwise("add")
    return mutlog.fold(log(spark, d, cents(), m), ["k"])


@query("fold_tombstone", f"SELECT e.user_id AS k, CAST(sum(c) AS BIGINT) AS value FROM ({BASED}) e LEFT JOIN (SELECT user_id, max(event_id) AS m FROM ({BASED}) WHERE a GROUP BY 1) l ON e.user_id = l.user_id WHERE e.event_id > coalesce(m, -1) GROUP BY 1")
def fold_tombstone(spark: SparkSession, d: str) -> DataFrame:
    return mutlog.fold(log(spark, d, cents(), "add", F.col("event_id") % 40 == 0), ["k"])


@query("fold_other_mutator_stops", f"SELECT e.user_id AS k, CASE WHEN arg_max(a, event_id) THEN max(CASE WHEN event_id > stop THEN c END) ELSE CAST(sum(CASE WHEN event_id > stop THEN c END) AS BIGINT) END AS value FROM ({BASED}) e JOIN (SELECT x.user_id, max(CASE WHEN x.a != y.la THEN x.event_id ELSE -1 END) AS stop FROM ({BASED}) x JOIN (SELECT user_id, arg_max(event_id % 40 = 0, event_id) AS la FROM events GROUP BY 1) y ON x.user_id = y.user_id GROUP BY 1) s ON e.user_id = s.user_id GROUP BY 1")
def fold_other_mutator_stops(spark: SparkSession, d: str) -> DataFrame:
    return mutlog.fold(log(spark, d, cents(), F.when(F.col("event_id") % 40 == 0, "max").otherwise("add")), ["k"])


@query("fold_duplicate_updates", f"SELECT user_id AS k, CAST(sum({CENTS}) AS BIGINT) AS value FROM events GROUP BY 1")
def fold_duplicate_updates(spark: SparkSession, d: str) -> DataFrame:
    x = log(spark, d, cents(), "add")
    return mutlog.fold(x.union(x.withColumn("pov_id", F.lit("child"))), ["k"])


@query("resolve_sub_div_mod", f"SELECT user_id AS k, CAST(sum({CENTS}) AS BIGINT) - 7 AS sub, CAST(sum({CENTS}) AS BIGINT) // 10 AS div, CAST(sum({CENTS}) AS BIGINT) % 10 AS mod FROM events GROUP BY 1")
def resolve_all(spark: SparkSession, d: str) -> DataFrame:
    v = mutlog.fold(log(spark, d, cents(), "add"), ["k"])
    out = None
    for m, x in (("sub", 7), ("div", 10), ("mod", 10)):
        r = mutlog.resolve(v, ["k"], v.select("k", F.lit(x).cast("long").alias("op")), m).withColumnRenamed("op", m)
        out = r if out is None else out.join(r, "k")
    return out


def stakes(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """One update of a mutation a user: what their events of this kind add."""
    e = table(spark, d, "events").where(F.col("event_type") == kind)
    return e.groupBy(F.col("user_id").alias("k")).agg(F.sum(cents()).alias("op")).withColumns({"mutator": F.lit("add"), "tombstone": F.lit(False)})


@query("pov_chain_read", f"SELECT user_id AS k, CAST(sum({CENTS}) AS BIGINT) AS value FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY 1")
def pov_chain_read(spark: SparkSession, d: str) -> DataFrame:
    """A branch of a branch sees its own rows and its ancestors', not their other children's."""
    s = Store(spark, [("k", "long")], "long")
    child = s.new_pov()
    mine, other, uncle = s.new_pov(child), s.new_pov(child), s.new_pov()
    for kind, pov in (("view", GLOBAL), ("click", child), ("signup", mine), ("purchase", other), ("error", uncle)):
        s.append(stakes(spark, d, kind), pov)
    return s.read(mine)


@query("promote_batch", f"SELECT k, CAST(sum(v) AS BIGINT) AS value FROM (SELECT user_id AS k, {CENTS} AS v FROM events WHERE event_type = 'view' UNION ALL SELECT * FROM (VALUES (1, 100), (2, 100), (-1, 7), (-1, 1)) u(k, v)) GROUP BY 1")
def promote_batch(spark: SparkSession, d: str) -> DataFrame:
    """Updates of a branch, one of them behind a condition that its parent meets too, moved into the parent; what another branch did stays there."""
    s = Store(spark, [("k", "long")], "long")
    s.append(stakes(spark, d, "view"))
    mine, other = s.new_pov(), s.new_pov()
    s.call(mine, lambda c: [c.mutate((k,), "add", 100) for k in (1, 2)])
    s.call(mine, lambda c: c.mutate((-1,), "add", 7 if c.check(c.get(-1) is None) else 1000))
    s.call(other, lambda c: c.mutate((2,), "add", 5000))
    s.promote(mine)
    s.call(GLOBAL, lambda c: c.mutate((-1,), "add", 1))
    return s.read()


@query("compact_whole_and_part", f"SELECT user_id AS k, CAST(sum({CENTS}) AS BIGINT) AS value FROM events GROUP BY 1")
def compact_whole_and_part(spark: SparkSession, d: str) -> DataFrame:
    x = log(spark, d, cents(), "add")
    low, high = mutlog.compact(x.where("seq < 3000"), ["k"]), mutlog.compact(x.where("seq >= 3000"), ["k"], whole=False)
    return mutlog.fold(low.unionByName(high), ["k"])


# -- the idioms of whole programs --------------------------------------------


@query("kgrams_top", "SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT string_split(lower(text), ' ') AS w FROM documents)) GROUP BY 1 ORDER BY n DESC, gram LIMIT 20")
def kgrams_top(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.split(F.lower("text"), " ", -1).alias("w"))
    grams = F.zip_with(F.col("w"), F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    g = w.where(F.size("w") > 1).select(F.explode(F.slice(grams, F.lit(1), F.size("w") - 1)).alias("gram"))
    return Seq(g, [("gram", True)]).collected_by("gram", n=F.count("*")).sorted_by(("n", False), ("gram", True)).take(20).df


AS_OF = "2024-01-15 12:00:00"


@query("market_price_as_of", f"SELECT user_id AS market, event_type AS outcome, CAST(sum({CENTS}) AS BIGINT) * 10000 // (CAST(sum(sum({CENTS})) OVER (PARTITION BY user_id) AS BIGINT)) AS price_bp FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2")
def market_price_as_of(spark: SparkSession, d: str, as_of: str = AS_OF) -> DataFrame:
    """Shares of the stakes that were placed up to a time, in basis points."""
    stake = events(spark, d).filter(F.col("ts").cast("timestamp_ntz") <= F.lit(as_of).cast("timestamp_ntz")).df.groupBy(F.col("user_id").alias("market"), F.col("event_type").alias("outcome")).agg(F.sum(cents()).alias("s"))
    total = stake.groupBy("market").agg(F.sum("s").alias("t"))
    return lookup.lookup(stake, total, ["market"], ["t"]).select("market", "outcome", K.divide(F.col("s") * 10000, F.col("t"), True).alias("price_bp"))


@query("balance_at_fork", f"SELECT user_id AS k, CAST(sum(CASE WHEN event_type = 'click' AND event_id < 4000 THEN {CENTS} WHEN event_type = 'view' THEN {CENTS} END) AS BIGINT) AS balance FROM events WHERE (event_type = 'click' AND event_id < 4000) OR event_type = 'view' GROUP BY 1")
def balance_at_fork(spark: SparkSession, d: str) -> DataFrame:
    """Branch view forked from branch click at height 4000: its own entries and its parent's below the fork."""
    chain = spark.createDataFrame([("view", None), ("click", 4000)], "event_type string, below long")
    e = table(spark, d, "events").join(F.broadcast(chain), "event_type").where(F.col("below").isNull() | (F.col("event_id") < F.col("below")))
    return e.groupBy(F.col("user_id").alias("k")).agg(F.sum(cents()).alias("balance"))


@query("crdt_render", "SELECT user_id AS doc, string_agg(event_type[1], '' ORDER BY value, event_id) AS text FROM events e WHERE event_type != 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND x.event_id = e.event_id + 1) GROUP BY 1")
def crdt_render(spark: SparkSession, d: str) -> DataFrame:
    """Inserted characters without the deleted ones, in the order of their positions."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    gone = e.where("event_type = 'error'").select("user_id", (F.col("event_id") - 1).alias("event_id"))
    live = lookup.where_missing(e.where("event_type != 'error'"), gone, ["user_id", "event_id"])
    chars = F.sort_array(F.collect_list(F.struct("value", "event_id", F.substring("event_type", 1, 1).alias("ch"))))
    return live.groupBy(F.col("user_id").alias("doc")).agg(F.array_join(F.transform(chars, lambda c: c["ch"]), "").alias("text"))


@query("hourly_views", f"SELECT event_type AS page, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS hour, CAST(sum({CENTS}) AS BIGINT) AS v FROM events GROUP BY 1, 2")
def hourly_views(spark: SparkSession, d: str) -> DataFrame:
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / F.lit(3_600_000_000)).cast("long")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("page"), hour.alias("hour")).agg(F.sum(cents()).alias("v"))


@query("result_json", "SELECT r_regionkey, '{\"key\":' || r_regionkey || '.0,\"name\":\"' || r_name || '\"}' AS json FROM region")
def result_json(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "region").select("r_regionkey", F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).alias("json"))
    return to_json(records, "json")


# -- programs of the language over stored tables ------------------------------

PROGRAM = """
customers = keys (int) @ <['nation', free::(int)]>;
lines = keys (int) @ <[free::(int), free::(int)]>;
visits = keys (str) @ <[free::(int), free::(int)]>;
region_of = (*<['region', *<['nation', c]>::(int)]>::(int)) where { c = given::(int); };
nation_or = ((*<['nation', c]>::(int) if *<['nation', c]>::(int?) is known else -1)) where { c = given::(int); };
bought = ((keys (bool) @ <['order', c, free::(int)]>) reduce start (empty {int}) | {that.2}) where { c = given::(int); };
"""


def program(spark: SparkSession, d: str) -> Program:
    """Tables as indexes: each key type and value type has one, in which a name in front tells kinds of entries apart."""
    db = Database(spark)
    entry = lambda name, t, k, v: table(spark, d, t).select(F.lit(name).alias("k0"), F.col(k).cast("long").alias("k1"), F.col(v).cast("long").alias("v"))
    db.attach(addr((STR, True), (INT, True)), INT, entry("nation", "customer", "c_custkey", "c_nationkey").union(entry("region", "nation", "n_nationkey", "n_regionkey")))
    db.attach(addr((STR, True), (INT, True), (INT, True)), BOOL, table(spark, d, "orders").select(F.lit("order").alias("k0"), F.col("o_custkey").cast("long").alias("k1"), F.col("o_orderkey").cast("long").alias("k2"), F.lit(True).alias("v")))
    db.attach(addr((INT, True), (INT, True)), INT, table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("k0"), F.col("l_linenumber").cast("long").alias("k1")).agg(F.max("l_quantity").cast("long").alias("v")))
    db.attach(addr((INT, True), (INT, True)), STR, table(spark, d, "events").select(F.col("user_id").cast("long").alias("k0"), F.col("event_id").cast("long").alias("k1"), F.col("event_type").alias("v")))
    return Program(spark, PROGRAM, db)


def lang(name: str, expr: str, sql: str, *columns: str) -> None:
    """Registers an expression over program(): of each element the members by these names, or all of it by one."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = program(spark, d).frame(expr)
        return out.select(*[F.col(f"v._{k}").alias(c) for k, c in enumerate(columns)]) if len(columns) > 1 else out.withColumnRenamed("v", columns[0])

    query(name, sql)(run)


LINES = "(SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)"
lang("lang_read_in_map", "<[customers.1, region_of(.c: customers.1)]>", "SELECT c_custkey AS custkey, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey", "custkey", "region")
lang("lang_read_in_fold", "customers reduce start 0 + region_of(.c: that.1)", "SELECT CAST(sum(n_regionkey) AS BIGINT) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey", "total")
lang("lang_read_guarded", "<[customers.1, nation_or(.c: customers.1 * 2)]>", "SELECT c.c_custkey AS custkey, coalesce(x.c_nationkey, -1) AS nation FROM customer c LEFT JOIN customer x ON x.c_custkey = c.c_custkey * 2", "custkey", "nation")
lang("lang_read_in_filter", "((customers if region_of(.c: that.1) == 2).1)", "SELECT c_custkey AS custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2", "custkey")
lang("lang_exists_in_map", "<[customers.1, exists (int) @ <['nation', customers.1 + 1]>]>", "SELECT c_custkey AS custkey, c_custkey + 1 IN (SELECT c_custkey FROM customer) AS found FROM customer", "custkey", "found")
lang("lang_range_reads", "[0..24] reduce start 0 + *<['region', that]>::(int)", "SELECT CAST(sum(n_regionkey) AS BIGINT) AS total FROM nation", "total")
lang("lang_collated", "visits collated_by start 0 + 1 having that.0", "SELECT user_id, count(*) AS n FROM events GROUP BY 1", "user_id", "n")
lang("lang_collected", "**(<[*lines::(int), 1]> collected_by lhs + rhs)", f"SELECT q AS quantity, count(*) AS n FROM {LINES} GROUP BY 1", "quantity", "n")
lang("lang_union_map", "**(lines union_map {*<[that.0, that.1]>::(int), -1})", f"SELECT DISTINCT q FROM {LINES} UNION SELECT -1", "q")
lang("lang_frontier", "**(customers union_map bought(.c: that.1))", "SELECT DISTINCT o_orderkey AS orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)", "orderkey")
lang("lang_scan_of_each", "keys (int) @ <[(keys (bool) @ <['order', free::(int), free::(int)]>).2, free::(int)]>", f"SELECT l_orderkey AS orderkey, l_linenumber AS line FROM {LINES} JOIN orders ON o_orderkey = l_orderkey", "orderkey", "line")
lang("lang_all_of", "lines reduce start true and *<[that.0, that.1]>::(int) > 0", f"SELECT bool_and(q > 0) AS ok FROM {LINES}", "ok")
lang("lang_while", "((customers while region_of(.c: that.1) < 4).1)", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey < coalesce((SELECT min(c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey >= 4), 9223372036854775807)", "custkey")
