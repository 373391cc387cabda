"""Relational queries over the driver's tables: scans, filters, joins, aggregates, windows, sorts, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from polyquarry.operators import relational as ops
from polyquarry.plans.registry import registry
from polyquarry.sources.tables import table

QUERIES, ORACLES, query = registry()


def cents(column: str):
    """Money as whole cents: sums don't depend on the order of addition."""
    return F.round(F.col(column) * 100).cast("long")


@query(
    "rel_top_nations",
    """SELECT n_name, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final,
              CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       GROUP BY n_name ORDER BY total_cents DESC NULLS LAST, n_name LIMIT 10""",
)
def top_nations(spark, d):
    """Joins, filtered aggregate and top-k in one plan."""
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count("*").alias("n_orders"), F.expr("count(*) FILTER (WHERE o_orderstatus = 'F')").alias("n_final"), F.sum(cents("o_totalprice")).alias("total_cents"))
        .orderBy(F.desc_nulls_last("total_cents"), "n_name")
        .limit(10)
    )


@query("scan_count", "SELECT count(*) AS n FROM lineitem")
def scan_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("scan_property_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def scan_property_count(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.count("*").alias("n"))


@query("scan_property_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def scan_property_order(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@query("scan_property_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12.5")
def scan_property_range(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 10 AND l_quantity < 12.5").select("l_orderkey", "l_linenumber", "l_quantity")


@query("scan_compound", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey")
def scan_compound(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query("scan_by_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def scan_by_id(spark, d):
    return table(spark, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name")


@query(
    "expr_predicates",
    """SELECT p_partkey, p_size, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class,
              upper(p_brand) || '/' || lower(p_type) AS tag, -p_size AS negative, p_size % 7 AS rest,
              coalesce(nullif(p_size, 1), 0) AS size_or_0
       FROM part WHERE p_size BETWEEN 5 AND 45 AND NOT (p_size IN (7, 9, 11)) AND p_name LIKE '%a%' AND p_brand ILIKE 'brand%' AND p_type IS NOT NULL""",
)
def expr_predicates(spark, d):
    p = table(spark, d, "part").where(F.col("p_size").between(5, 45) & ~F.col("p_size").isin(7, 9, 11) & F.col("p_name").like("%a%") & F.col("p_brand").ilike("brand%") & F.col("p_type").isNotNull())
    return p.select(
        "p_partkey",
        "p_size",
        F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large").alias("class"),
        F.concat(F.upper("p_brand"), F.lit("/"), F.lower("p_type")).alias("tag"),
        (-F.col("p_size")).alias("negative"),
        (F.col("p_size") % 7).alias("rest"),
        F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(0)).alias("size_or_0"),
    )


@query(
    "expr_casts",
    """SELECT event_id, CAST(event_id AS VARCHAR) AS id_text, CAST(trunc(value) AS BIGINT) AS whole, value > 50 AS high,
              ts + INTERVAL 2 DAY AS later, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""",
)
def expr_casts(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.col("event_id").cast("string").alias("id_text"), F.col("value").cast("long").alias("whole"), (F.col("value") > 50).alias("high"), (F.col("ts") + F.expr("INTERVAL 2 DAY")).alias("later"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"))


@query(
    "expr_nulls",
    """WITH v(x) AS (VALUES (1), (2), (NULL)) SELECT a.x AS a, b.x AS b, a.x = b.x AS eq, a.x < b.x AS lt, a.x IS NOT DISTINCT FROM b.x AS safe,
       (a.x = 1) AND (b.x = 1) AS both, (a.x = 1) OR (b.x = 1) AS some, NOT (a.x = 1) AS neg FROM v a CROSS JOIN v b""",
)
def expr_nulls(spark, d):
    """Three-valued logic over all pairs of 1, 2 and null (nine inline rows)."""
    v = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    a, b = v.select(F.col("x").alias("a")), v.select(F.col("x").alias("b"))
    one = lambda c: F.col(c) == 1
    return a.crossJoin(b).select("a", "b", (F.col("a") == F.col("b")).alias("eq"), (F.col("a") < F.col("b")).alias("lt"), F.col("a").eqNullSafe(F.col("b")).alias("safe"), (one("a") & one("b")).alias("both"), (one("a") | one("b")).alias("some"), (~one("a")).alias("neg"))


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    @query(
        f"join_{_how}",
        f"""SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) c
            {_sql} (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey""",
    )
    def join_kind(spark, d, how=_how):
        c = table(spark, d, "customer").where("c_acctbal > 0")
        o = table(spark, d, "orders").where("o_totalprice > 200000")
        return ops.equi_join(c, o, [("c_custkey", "o_custkey")], how).select("c_custkey", "o_orderkey")


@query("join_multi_key", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND floor(s_acctbal / 500) = floor(c_acctbal / 500)")
def join_multi_key(spark, d):
    s = table(spark, d, "supplier").withColumn("sb", F.floor(F.col("s_acctbal") / 500))
    c = table(spark, d, "customer").withColumn("cb", F.floor(F.col("c_acctbal") / 500))
    return ops.equi_join(s, c, [("s_nationkey", "c_nationkey"), ("sb", "cb")]).select("s_suppkey", "c_custkey")


@query("join_theta", "SELECT r.r_name, n.n_name FROM region r JOIN nation n ON n.n_regionkey > r.r_regionkey")
def join_theta(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return r.join(n, F.col("n_regionkey") > F.col("r_regionkey")).select("r_name", "n_name")


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@query("join_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def join_lookup(spark, d):
    """Few outer rows probe a large table by key; the outer side's size is counted before it is broadcast."""
    outer = table(spark, d, "orders").where("o_totalprice > 400000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return ops.lookup_join(outer, table(spark, d, "customer"), "c_custkey", outer.count()).select("o_orderkey", "c_name")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_semi(spark, d):
    return ops.in_subquery(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey")).select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_anti(spark, d):
    return ops.in_subquery(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"), negated=True).select("c_custkey")


@query("join_anti_nulls", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END FROM orders)")
def join_anti_nulls(spark, d):
    """NOT IN a set with a null keeps nothing."""
    values = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    return ops.in_subquery(table(spark, d, "customer"), "c_custkey", values, negated=True).select("c_custkey")


@query(
    "join_asof",
    """SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) c ON p.user_id = c.user_id AND p.ts >= c.ts""",
)
def join_asof(spark, d):
    """Each purchase with its user's last click: one sort, no pairs."""
    e = table(spark, d, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    return ops.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", ["click_id"]).select("event_id", "click_id")


@query(
    "join_range",
    """WITH bands(low, high, name) AS (VALUES (0.0, 10000.0, 'a'), (5000.0, 60000.0, 'b'), (60000.0, 250000.0, 'c'), (250000.0, 1000000.0, 'd'))
       SELECT o_orderkey, name FROM orders JOIN bands ON o_totalprice >= low AND o_totalprice < high""",
)
def join_range(spark, d):
    bands = spark.createDataFrame([(0.0, 10000.0, "a"), (5000.0, 60000.0, "b"), (60000.0, 250000.0, "c"), (250000.0, 1000000.0, "d")], "low double, high double, name string")
    return ops.range_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 50_000).select("o_orderkey", "name")


@query(
    "join_correlated",
    "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
)
def join_correlated(spark, d):
    """EXISTS as a semi join; the scalar subquery is one row."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity > 49")
    mean = F.broadcast(o.agg(F.avg("o_totalprice").alias("mean")))  # one row
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").crossJoin(mean).where("o_totalprice > mean").select("o_orderkey")


@query(
    "agg_pricing",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents,
              min(l_discount) AS min_discount, max(l_shipdate) AS last_ship, round(avg(l_tax), 6) AS avg_tax, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def agg_pricing(spark, d):
    line = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"),
        F.sum(cents("l_extendedprice")).alias("sum_cents"),
        F.min("l_discount").alias("min_discount"),
        F.max("l_shipdate").alias("last_ship"),
        F.round(F.avg("l_tax"), 6).alias("avg_tax"),
        F.count("*").alias("n"),
        F.countDistinct("l_suppkey").alias("suppliers"),
    )


@query(
    "agg_nulls",
    "WITH v(g, x) AS (VALUES ('a', 1), ('a', NULL), ('a', 1), ('b', NULL)) SELECT g, count(*) AS n, count(x) AS known, count(DISTINCT x) AS kinds, CAST(sum(x) AS BIGINT) AS total, min(x) AS low FROM v GROUP BY g",
)
def agg_nulls(spark, d):
    v = spark.createDataFrame([("a", 1), ("a", None), ("a", 1), ("b", None)], "g string, x int")
    return v.groupBy("g").agg(F.count("*").alias("n"), F.count("x").alias("known"), F.countDistinct("x").alias("kinds"), F.sum("x").alias("total"), F.min("x").alias("low"))


@query("agg_array", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey), ',') AS names FROM nation GROUP BY 1")
def agg_array(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(ops.array_agg("n_name", ["n_nationkey"]), ",").alias("names"))


@query("agg_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 50")
def agg_having(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n > 50")


@query("agg_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def agg_rollup(spark, d):
    return table(spark, d, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "window_ranking",
    """SELECT c_custkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr
       FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey), v AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""",
)
def window_ranking(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey")
    v = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(v).cast("long").alias("rk"), F.dense_rank().over(v).cast("long").alias("dr"))


@query(
    "window_frames",
    """SELECT event_id, count(*) OVER w AS n, CAST(sum(event_id) OVER w AS BIGINT) AS s, min(event_id) OVER p AS low, max(event_id) OVER r AS high,
              round(avg(event_id) OVER w, 6) AS mean
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), p AS (PARTITION BY user_id),
       r AS (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING)""",
)
def window_frames(spark, d):
    u = Window.partitionBy("user_id")
    w, r = u.orderBy("event_id").rowsBetween(-2, 0), u.orderBy("event_id").rangeBetween(-100, 100)
    e = table(spark, d, "events")
    return e.select("event_id", F.count("*").over(w).alias("n"), F.sum("event_id").over(w).alias("s"), F.min("event_id").over(u).alias("low"), F.max("event_id").over(r).alias("high"), F.round(F.avg("event_id").over(w), 6).alias("mean"))


@query(
    "window_offsets",
    """SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, first_value(event_id) OVER w AS first_id, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def window_offsets(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"), F.first("event_id").over(w).alias("first_id"), F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query("sort_nulls", "WITH v(x, y) AS (VALUES (1, 1), (NULL, 2), (1, NULL), (2, 1)) SELECT x, y, row_number() OVER (ORDER BY x DESC NULLS LAST, y ASC NULLS FIRST) AS place FROM v")
def sort_nulls(spark, d):
    v = spark.createDataFrame([(1, 1), (None, 2), (1, None), (2, 1)], "x int, y int")
    return v.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("x"), F.asc_nulls_first("y"))).cast("long"))


@query("limit_offset", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 30")
def limit_offset(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").offset(30).limit(20)


@query("page_cursor", "SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey > 5 OR (c_nationkey = 5 AND c_custkey > 100) ORDER BY c_nationkey, c_custkey LIMIT 15")
def page_cursor(spark, d):
    return ops.cursor_page(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], [5, 100], 15)


@query("distinct_all", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_all(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC NULLS LAST, o_orderkey")
def distinct_on(spark, d):
    return ops.distinct_on(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc_nulls_last("o_totalprice"), "o_orderkey"])


@query("set_operations", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1 INTERSECT SELECT 1")
def set_operations(spark, d):
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select("s_nationkey")
    out = table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey").intersect(spark.range(1).select(F.lit(1)))
    return c.union(s).distinct().exceptAll(out.distinct())


@query(
    "cte_reuse",
    """WITH totals AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), top AS (SELECT max(n) AS m FROM totals)
       SELECT k, n FROM totals, top WHERE n >= m - 2""",
)
def cte_reuse(spark, d):
    for t in ("orders",):
        table(spark, d, t).createOrReplaceTempView("cte_orders")
    return spark.sql("WITH totals AS (SELECT o_custkey AS k, count(*) AS n FROM cte_orders GROUP BY 1), top AS (SELECT max(n) AS m FROM totals) SELECT k, n FROM totals, top WHERE n >= m - 2")


@query("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t")
def cte_recursive(spark, d):
    return spark.sql("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t")


@query("derived_table", "SELECT n_name, x.n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) x JOIN nation ON n_nationkey = x.c_nationkey")
def derived_table(spark, d):
    x = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).alias("x")
    return x.join(table(spark, d, "nation"), F.col("x.c_nationkey") == F.col("n_nationkey")).select("n_name", "x.n")


@query("lateral_map", "SELECT n_nationkey, n_name, length(n_name) * 2 AS doubled FROM nation")
def lateral_map(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name").withColumn("doubled", F.length("n_name").cast("long") * 2)


@query("parameters", "SELECT p_partkey FROM part WHERE p_size = 15 AND p_retailprice > 1000")
def parameters(spark, d):
    table(spark, d, "part").createOrReplaceTempView("param_part")
    return spark.sql("SELECT p_partkey FROM param_part WHERE p_size = :size AND p_retailprice > :price", args={"size": 15, "price": 1000})


@query("select_without_from", "SELECT 1 + 1 AS two, upper('x') AS letter")
def select_without_from(spark, d):
    return spark.range(1).select(F.lit(1 + 1).alias("two"), F.upper(F.lit("x")).alias("letter"))


@query("empty_plan", "SELECT 1 AS id, 'x' AS name WHERE false")
def empty_plan(spark, d):
    return ops.empty(spark, "id int, name string")


@query("top_per_group", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) WHERE k <= 3")
def top_per_group(spark, d):
    return ops.top_per_group(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc_nulls_last("value"), "event_id"], 3)


@query("metadata_tables", "SELECT 'meta_region' AS name, 'r_name' AS column_name")
def metadata_tables(spark, d):
    """The catalog as a table: text columns of a registered view."""
    table(spark, d, "region").createOrReplaceTempView("meta_region")
    rows = [("meta_region", c.name) for c in spark.catalog.listColumns("meta_region") if c.dataType == "string"]
    return spark.createDataFrame(rows, "name string, column_name string")
