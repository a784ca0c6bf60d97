"""Every query of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import limits
from tessera.functions.lineage import cut
from tessera.operators import bloom, caches, counting, graphs, intervals, lookup, ordering, placement, ranges, sequences, text, topk, trees
from tessera.sources.tables import cents, day, middle_halves, series, spans, supply_graph, table, trade_graph, vertices

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


DAY = "date_diff('day', DATE '1970-01-01', {}::DATE)"
CENTS = "CAST(round({} * 100) AS BIGINT)"
SPANS = f"SELECT o_custkey AS grp, least({DAY.format('o_orderdate')}, {DAY.format('l_shipdate')}) AS s, greatest({DAY.format('o_orderdate')}, {DAY.format('l_shipdate')}) AS e, l_orderkey, l_linenumber, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def merged_sql(source: str) -> str:
    return f"""SELECT grp, min(s) AS s, max(e) AS e FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY grp ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY grp ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({source})))
    GROUP BY grp, island"""


# Intervals


@query("interval_merge", merged_sql(SPANS))
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge(spans(spark, d))


@query("interval_insert", merged_sql(f"SELECT grp, s, e FROM ({SPANS}) UNION ALL SELECT c_custkey AS grp, 9131 + c_custkey % 365 AS s, 9161 + c_custkey % 365 AS e FROM customer"))
def interval_insert(spark: SparkSession, d: str) -> DataFrame:
    """A month's window of each customer goes into its coalesced spans."""
    start = F.lit(9131).cast("long") + F.col("c_custkey") % 365
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("grp"), start.alias("s"), (start + 30).alias("e"))
    return intervals.insert(intervals.merge(spans(spark, d)), new)


@query("interval_self_overlap", f"""WITH x AS (SELECT grp, s, e, l_orderkey * 8 + l_linenumber AS id FROM ({SPANS}))
  SELECT a.grp, b.s, least(a.e, b.e) AS e FROM x a JOIN x b ON a.grp = b.grp AND b.s <= a.e AND (a.s < b.s OR a.s = b.s AND a.id < b.id)""")
def interval_self_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("a"))
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", day("l_shipdate").alias("b"))
    rows = i.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return intervals.self_overlap(rows.select(F.col("o_custkey").alias("grp"), F.least("a", "b").alias("s"), F.greatest("a", "b").alias("e"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")))


_A, _R = (merged_sql(f"SELECT grp, s, e FROM ({SPANS}) WHERE l_returnflag = '{f}'") for f in "AR")


@query("interval_intersect", f"WITH a AS ({_A}), r AS ({_R}) SELECT a.grp, greatest(a.s, r.s) AS s, least(a.e, r.e) AS e FROM a JOIN r ON a.grp = r.grp AND a.s <= r.e AND r.s <= a.e")
def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    return intervals.intersect(spans(spark, d, "A"), spans(spark, d, "R"))


# Counting


@query("multiset_counts", "SELECT user_id AS key, count(*) AS cnt FROM events GROUP BY 1")
def multiset_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.multiset(table(spark, d, "events"), "user_id")


@query("multiset_net", "SELECT user_id AS key, CAST(sum(CASE WHEN event_type IN ('error', 'signup') THEN -1 ELSE 1 END) AS BIGINT) AS cnt FROM events GROUP BY 1 HAVING sum(CASE WHEN event_type IN ('error', 'signup') THEN -1 ELSE 1 END) > 0")
def multiset_net(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("event_type").isin("error", "signup"), -1).otherwise(1)
    return counting.multiset_net(table(spark, d, "events").select(F.col("user_id").alias("key"), delta.alias("delta")))


@query("multiset_size", "SELECT count(DISTINCT user_id) AS size, count(*) AS total FROM events")
def multiset_size(spark: SparkSession, d: str) -> DataFrame:
    return counting.multiset(table(spark, d, "events"), "user_id").agg(F.count("*").alias("size"), F.sum("cnt").alias("total"))


@query("majority_per_group", """SELECT grp, candidate, n, top > n // 2 AS is_majority FROM (
  SELECT l_suppkey AS grp, first(f ORDER BY c DESC, f) AS candidate, CAST(sum(c) AS BIGINT) AS n, max(c) AS top FROM (
    SELECT l_suppkey, l_returnflag AS f, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1)""")
def majority_per_group(spark: SparkSession, d: str) -> DataFrame:
    return counting.majority(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


@query("fold_sum", "SELECT l_orderkey AS grp, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(max(CAST(l_quantity AS BIGINT)) AS BIGINT) AS most FROM lineitem GROUP BY 1")
def fold_sum(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("grp")).agg(F.collect_list(F.col("l_quantity").cast("long")).alias("q"))
    zero = F.lit(0).cast("long")
    return lists.select("grp", counting.fold(F.col("q"), zero, lambda a, x: a + x).alias("total"), counting.fold(F.col("q"), zero, lambda a, x: F.greatest(a, x)).alias("most"))


# Heaps


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("total"))


for _name, _way in (("min", "ASC"), ("max", "DESC")):
    @query(f"topk_global_{_name}", f"SELECT o_orderkey, {CENTS.format('o_totalprice')} AS total FROM orders ORDER BY total {_way}, o_orderkey LIMIT 100")
    def topk_global(spark: SparkSession, d: str, way: str = _way) -> DataFrame:
        by = F.col("total").asc() if way == "ASC" else F.col("total").desc()
        return topk.top(_totals(spark, d).select("o_orderkey", "total"), [by, F.col("o_orderkey")], 100)


@query("topk_per_group", f"SELECT o_custkey, o_orderkey, total, rank FROM (SELECT o_custkey, o_orderkey, {CENTS.format('o_totalprice')} AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY {CENTS.format('o_totalprice')} DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_per_group(_totals(spark, d), "o_custkey", [F.col("total").desc(), F.col("o_orderkey")], 3)


@query("priority_pairs", f"SELECT o_custkey, min_total, first_key FROM (SELECT o_custkey, min({CENTS.format('o_totalprice')}) AS min_total, arg_min(o_orderkey, [{CENTS.format('o_totalprice')}, o_orderkey]) AS first_key FROM orders GROUP BY 1)")
def priority_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The root of each customer's heap of (priority, value) pairs."""
    pair = F.min(F.struct(F.col("total").alias("prior"), F.col("o_orderkey").alias("val")))
    return _totals(spark, d).groupBy("o_custkey").agg(pair.alias("p")).select("o_custkey", F.col("p.prior").alias("min_total"), F.col("p.val").alias("first_key"))


# Sorting


@query("sort_asc", "SELECT p_partkey, CAST(p_size AS BIGINT) AS size, row_number() OVER (ORDER BY p_size, p_partkey) AS rank FROM part")
def sort_asc(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    return ordering.ranked(parts, F.col("size"), ["p_partkey"])


@query("sort_desc", "SELECT p_partkey, CAST(p_size AS BIGINT) AS size, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part")
def sort_desc(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    return ordering.ranked(parts, F.col("size"), ["p_partkey"], ascending=False)


@query("parallel_sort", f"SELECT o_orderkey, {DAY.format('o_orderdate')} AS d, row_number() OVER (ORDER BY {DAY.format('o_orderdate')}, o_orderkey) AS rank FROM orders")
def parallel_sort(spark: SparkSession, d: str) -> DataFrame:
    return ordering.ranked(table(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("d")), F.col("d"), ["o_orderkey"])


@query("digit_histogram", "SELECT CAST(substr(reverse(k), i + 1, 1) AS BIGINT) AS digit, i AS place, count(*) AS n FROM (SELECT CAST(p_partkey AS VARCHAR) AS k, unnest(range(0, len(CAST(p_partkey AS VARCHAR)))) AS i FROM part) GROUP BY 1, 2")
def digit_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ordering.digit_histogram(table(spark, d, "part"), "p_partkey")


SERIES = f"SELECT o_custkey AS grp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, {CENTS.format('o_totalprice')} AS val FROM orders"
HALVES = f"SELECT grp, count(*) // 4 AS l, least(3 * count(*) // 4, count(*) - 1) AS r FROM ({SERIES}) GROUP BY grp"


@query("is_sorted", f"SELECT grp, bool_and(ok) AS sorted FROM (SELECT grp, coalesce(lag(val) OVER (PARTITION BY grp ORDER BY pos) <= val, true) AS ok FROM ({SERIES})) GROUP BY grp")
def is_sorted(spark: SparkSession, d: str) -> DataFrame:
    return ordering.is_sorted(series(spark, d))


@query("is_sorted_desc", f"SELECT grp, bool_and(ok) AS sorted FROM (SELECT grp, coalesce(lag(val) OVER (PARTITION BY grp ORDER BY pos) >= val, true) AS ok FROM ({SERIES})) GROUP BY grp")
def is_sorted_desc(spark: SparkSession, d: str) -> DataFrame:
    return ordering.is_sorted(series(spark, d), ascending=False)


@query("list_round_trip", f"SELECT grp, pos, val FROM ({SERIES})")
def list_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Series to arrays and back."""
    return ordering.from_lists(ordering.to_lists(series(spark, d)))


@query("integer_limits", "SELECT * FROM (VALUES ('tinyint', -128::BIGINT, 127::BIGINT), ('smallint', -32768, 32767), ('int', -2147483648, 2147483647), ('bigint', -9223372036854775808, 9223372036854775807)) t(type, least, greatest)")
def integer_limits(spark: SparkSession, d: str) -> DataFrame:
    return limits.table_of_limits(spark)


@query("reverse_series", f"SELECT grp, count(*) OVER (PARTITION BY grp) - 1 - pos AS pos, val FROM ({SERIES})")
def reverse_series(spark: SparkSession, d: str) -> DataFrame:
    return ordering.reverse(series(spark, d))


@query("fill_series", f"SELECT grp, pos, CAST(7 AS BIGINT) AS val FROM ({SERIES})")
def fill_series(spark: SparkSession, d: str) -> DataFrame:
    return ordering.fill(series(spark, d), 7)


# Lookups

_VALUES = f"WITH e AS (SELECT {CENTS.format('o_totalprice')} AS v FROM orders), q AS (SELECT DISTINCT {CENTS.format('s_acctbal')} * 20 AS v FROM supplier)"


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "supplier").select((cents("s_acctbal") * 20).alias("v")).distinct()
    return lookup.value_bounds(_totals(spark, d).select(F.col("total").alias("v")), asked)


@query("lower_bound", _VALUES + " SELECT q.v, count(*) FILTER (e.v < q.v) AS lower FROM q, e GROUP BY 1")
def lower_bound(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d).select("v", "lower")


@query("upper_bound", _VALUES + " SELECT q.v, count(*) FILTER (e.v <= q.v) AS upper FROM q, e GROUP BY 1")
def upper_bound(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d).select("v", "upper")


@query("binary_search", "WITH e AS (SELECT CAST(p_size AS BIGINT) AS v FROM part), q AS (SELECT DISTINCT l_linenumber::BIGINT * 9 AS v FROM lineitem) SELECT q.v, CASE WHEN count(*) FILTER (e.v = q.v) > 0 THEN count(*) FILTER (e.v < q.v) ELSE -1 END AS found FROM q, e GROUP BY 1")
def binary_search(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "lineitem").select((F.col("l_linenumber").cast("long") * 9).alias("v")).distinct()
    return lookup.value_bounds(table(spark, d, "part").select(F.col("p_size").cast("long").alias("v")), asked).select("v", "found")


@query("lower_bound_by", f"SELECT grp, count(*) FILTER (val // 1000 < 15000) AS at FROM ({SERIES}) GROUP BY grp")
def lower_bound_by(spark: SparkSession, d: str) -> DataFrame:
    """Where a predicate, not a value, marks the place in each customer's ordered totals."""
    return lookup.partition_point(series(spark, d), F.floor(F.col("val") / 1000) < 15000)


@query("asof_backward", """WITH p AS (SELECT user_id AS grp, epoch_us(ts) AS t, event_id AS id, event_type, CAST(round(value * 100) AS BIGINT) AS val FROM events)
  SELECT a.grp, a.t, a.id, b.val FROM (SELECT * FROM p WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM p WHERE event_type = 'view') b ON a.grp = b.grp AND a.t >= b.t""")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the value of the user's last view before it."""
    e = table(spark, d, "events").select(F.col("user_id").alias("grp"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"), "event_type", cents("value").alias("val"))
    return lookup.asof_backward(e.filter("event_type = 'purchase'").select("grp", "t", "id"), e.filter("event_type = 'view'").select("grp", "t", "val"))


_STATE = "SELECT key, val FROM (SELECT user_id AS key, arg_max(event_type, ts) AS op, arg_max(CAST(round(value * 100) AS BIGINT), ts) AS val FROM events GROUP BY 1) WHERE op <> 'error'"


def _state(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return lookup.map_state(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("seq"), op.alias("op"), cents("value").alias("val")))


@query("ordered_map_state", _STATE)
def ordered_map_state(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)


@query("ordered_map_get", f"SELECT c_custkey AS key, val, key IS NOT NULL AS ok FROM customer LEFT JOIN ({_STATE}) ON key = c_custkey")
def ordered_map_get(spark: SparkSession, d: str) -> DataFrame:
    return lookup.map_get(_state(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("key")))


@query("sorted_list_find", f"""WITH x AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY val DESC, pos) - 1 AS pos, val FROM ({SERIES})), t AS (SELECT c_custkey AS grp, CAST(round(c_acctbal * 100) AS BIGINT) * 30 AS target FROM customer)
  SELECT t.grp, t.target, coalesce(min(x.pos), -1) AS pos, coalesce(bool_or(x.val = t.target), false) AS contains FROM t LEFT JOIN x ON x.grp = t.grp AND x.val <= t.target GROUP BY 1, 2""")
def sorted_list_find(spark: SparkSession, d: str) -> DataFrame:
    down = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("val"), "pos")) - 1
    lists = series(spark, d).select("grp", down.cast("long").alias("pos"), "val")
    return lookup.find_at_most(lists, table(spark, d, "customer").select(F.col("c_custkey").alias("grp"), (cents("c_acctbal") * 30).alias("target")))


@query("stack_depth", """SELECT grp, seq, CAST(run - least(min(run) OVER (PARTITION BY grp ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS depth FROM (
  SELECT user_id AS grp, event_id AS seq, sum(CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)""")
def stack_depth(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("event_type").isin("view", "click", "signup"), 1).otherwise(-1)
    return lookup.stack_tops(table(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("seq"), delta.alias("delta")))


@query("stack_values", """WITH x AS (SELECT user_id AS grp, event_id AS seq, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1 ELSE -1 END AS delta, CAST(round(value * 100) AS BIGINT) AS val FROM events),
  y AS (SELECT *, sum(delta) OVER (PARTITION BY grp ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM x),
  z AS (SELECT *, run - least(min(run) OVER (PARTITION BY grp ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS depth FROM y),
  b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY grp ORDER BY seq), 0) AS before FROM z)
  SELECT a.grp, a.seq, any_value(CASE WHEN a.delta < 0 AND a.before > 0 THEN (SELECT arg_max(p.val, p.seq) FROM z p WHERE p.grp = a.grp AND p.delta > 0 AND p.seq < a.seq AND p.depth = a.before) END) AS popped,
    any_value(CASE WHEN a.delta > 0 THEN a.val WHEN a.depth > 0 THEN (SELECT arg_max(p.val, p.seq) FROM z p WHERE p.grp = a.grp AND p.delta > 0 AND p.seq < a.seq AND p.depth = a.depth) END) AS top FROM b a GROUP BY 1, 2""")
def stack_values(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("event_type").isin("view", "click", "signup"), 1).otherwise(-1)
    return lookup.stack_values(table(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("seq"), delta.alias("delta"), cents("value").alias("val")))


@query("list_insert_remove", f"""WITH x AS (SELECT grp, pos, val, 0 AS late FROM ({SERIES}) UNION ALL SELECT c_custkey AS grp, 0 AS pos, {CENTS.format('c_acctbal')} AS val, 1 AS late FROM customer),
  y AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY pos, late) - 1 AS pos, val FROM x) SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY pos) - 1 AS pos, val FROM y WHERE pos <> 3""")
def list_insert_remove(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's balance goes behind the first node of its totals, then the node behind the third goes."""
    c = table(spark, d, "customer")
    more = lookup.insert_after(series(spark, d), c.select(F.col("c_custkey").alias("grp"), F.lit(0).cast("long").alias("pos"), cents("c_acctbal").alias("val")))
    return lookup.remove_after(more, c.select(F.col("c_custkey").alias("grp"), F.lit(2).cast("long").alias("pos")))


# Range queries


@query("prefix_sum", f"SELECT grp, pos, CAST(sum(val) OVER (PARTITION BY grp ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS acc FROM ({SERIES})")
def prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    return ranges.prefix(series(spark, d))


for _name, _sql, _fold in (("min", "min(val)", F.min), ("max", "max(val)", F.max), ("xor", "bit_xor(val)", F.bit_xor), ("or", "bit_or(val)", F.bit_or), ("and", "bit_and(val)", F.bit_and)):
    @query(f"range_{_name}", f"WITH s AS ({SERIES}), q AS ({HALVES}) SELECT q.grp, l, r, {_sql} AS res FROM q JOIN s ON s.grp = q.grp AND pos BETWEEN l AND r GROUP BY 1, 2, 3")
    def range_fold(spark: SparkSession, d: str, fold=_fold) -> DataFrame:
        s = series(spark, d)
        return ranges.range_fold(s, middle_halves(s), fold)


@query("range_sum", f"WITH s AS ({SERIES}), q AS ({HALVES}) SELECT q.grp, l, r, CAST(sum(val) AS BIGINT) AS res FROM q JOIN s ON s.grp = q.grp AND pos BETWEEN l AND r GROUP BY 1, 2, 3")
def range_sum(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d)
    return ranges.range_sum(s, middle_halves(s))


@query("range_gcd", f"WITH s AS ({SERIES}), q AS ({HALVES}) SELECT q.grp, l, r, list_reduce(list(val ORDER BY pos), lambda a, b: gcd(a, b)) AS res FROM q JOIN s ON s.grp = q.grp AND pos BETWEEN l AND r GROUP BY 1, 2, 3")
def range_gcd(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d)
    return ranges.range_fold(s, middle_halves(s), lambda c: ranges.gcd(F.collect_list(c)))


_QUANTITIES = "SELECT l_orderkey AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS pos, CAST(l_quantity AS BIGINT) AS val FROM lineitem"


@query("range_lcm", f"WITH s AS ({_QUANTITIES}), q AS (SELECT grp, count(*) // 4 AS l, least(3 * count(*) // 4, count(*) - 1) AS r FROM s GROUP BY grp) SELECT q.grp, l, r, list_reduce(list(val ORDER BY pos), lambda a, b: lcm(a, b)) AS res FROM q JOIN s ON s.grp = q.grp AND pos BETWEEN l AND r GROUP BY 1, 2, 3")
def range_lcm(spark: SparkSession, d: str) -> DataFrame:
    """Of the quantities in the middle of each order."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity")) - 1
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), place.cast("long").alias("pos"), F.col("l_quantity").cast("long").alias("val"))
    found = ranges.range_fold(s, middle_halves(s), ranges.lcm_fold)
    return found.withColumn("res", F.nullif("res", F.lit(ranges.PAST).cast("long")))


@query("point_add_range", f"WITH s AS ({SERIES}), q AS ({HALVES}) SELECT q.grp, l, r, CAST(sum(CASE WHEN pos = l THEN val + 12 ELSE val END) AS BIGINT) AS res FROM q JOIN s ON s.grp = q.grp AND pos BETWEEN l AND r GROUP BY 1, 2, 3")
def point_add_range(spark: SparkSession, d: str) -> DataFrame:
    """5 and then 7 are added at each customer's first place of the range; then ranges are summed."""
    s = series(spark, d)
    q = middle_halves(s)
    log = q.select("grp", F.col("l").alias("pos"), F.explode(F.array(F.lit(5).cast("long"), F.lit(7).cast("long"))).alias("delta"))
    return ranges.range_sum(ranges.point_add(s, log), q)


@query("point_update_range", f"WITH s AS ({SERIES}), q AS ({HALVES}) SELECT q.grp, l, r, CAST(sum(CASE WHEN pos = l THEN 0 ELSE val END) AS BIGINT) AS res FROM q JOIN s ON s.grp = q.grp AND pos BETWEEN l AND r GROUP BY 1, 2, 3")
def point_update_range(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's first place of the range is set to 5, then to 0; then ranges are summed."""
    s = series(spark, d)
    q = middle_halves(s)
    log = q.select("grp", F.col("l").alias("pos"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit(5).cast("long").alias("val")), F.struct(F.lit(2).alias("seq"), F.lit(0).cast("long").alias("val")))).alias("u"))
    return ranges.range_sum(ranges.point_assign(s, log.select("grp", "pos", "u.seq", "u.val")), q)


@query("sparse_table_levels", f"WITH s AS ({SERIES}), n AS (SELECT grp, count(*) AS n FROM s GROUP BY 1), k AS (SELECT unnest(range(0, 30)) AS k) SELECT a.grp, k, a.pos, max(b.val) AS val FROM n JOIN k ON (1 << k::INT) <= n.n JOIN s a ON a.grp = n.grp AND a.pos + (1 << k::INT) <= n.n JOIN s b ON b.grp = a.grp AND b.pos >= a.pos AND b.pos < a.pos + (1 << k::INT) GROUP BY 1, 2, 3")
def sparse_table_levels(spark: SparkSession, d: str) -> DataFrame:
    return ranges.sparse_table(cut(series(spark, d)))


@query("rmq_sparse", SQL["range_max"])
def rmq_sparse(spark: SparkSession, d: str) -> DataFrame:
    s = cut(series(spark, d))
    return ranges.sparse_query(ranges.sparse_table(s), middle_halves(s))


# Text

_DOCS = "coalesce(text, '')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("levenshtein_pairs", "WITH n AS (SELECT DISTINCT p_name AS n FROM part) SELECT a.n AS a, b.n AS b, CAST(levenshtein(a.n, b.n) AS BIGINT) AS dist FROM n a JOIN n b ON split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1) AND a.n < b.n")
def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distances of distinct part names that share their first word."""
    names = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct().withColumn("w", F.split_part("a", F.lit(" "), F.lit(1)))
    met = names.join(names.withColumnRenamed("a", "b"), "w").filter("a < b")
    return met.select("a", "b", text.edit_distance(F.col("a"), F.col("b")).cast("long").alias("dist"))


_LETTERS = "list_transform(range(1, len({0}) + 1), lambda i: [ascii(substr({0}, i::INT, 1))::BIGINT, i - 1])"


def _table_sql(a: str, b: str, first: str, start: str, cell: str) -> str:
    return f"list_reduce({_LETTERS.format(a)}, lambda prev, x: list_reduce({_LETTERS.format(b)}, lambda cur, y: cur || [{cell}], {start}), {first})[-1]"


@query("weighted_edit", "SELECT DISTINCT p_name, p_type, " + _table_sql("p_name", "p_type", "list_transform(range(0, len(p_type) + 1), lambda j: j * 2)", "[prev[1] + 3]", "least(prev[y[2] + 1] + CASE WHEN x[1] = y[1] THEN 0 ELSE 4 END, prev[y[2] + 2] + 3, cur[-1] + 2)") + " AS cost FROM part")
def weighted_edit(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_name", "p_type").distinct()
    return parts.withColumn("cost", text.weighted_edit_distance(F.col("p_name"), F.col("p_type"), insert=2, delete=3, replace=4))


@query("substring_first", f"SELECT doc_id, CAST(instr({_DOCS}, 'ther') - 1 AS BIGINT) AS pos FROM documents")
def substring_first(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.find_first(F.col("text"), "ther").alias("pos"))


_FOUND = f"SELECT doc_id, unnest(list_filter(range(0, len({_DOCS})), lambda i: substr({_DOCS}, i::INT + 1, {{1}}) = '{{0}}')) AS p FROM documents WHERE contains({_DOCS}, '{{0}}')"


@query("kmp_all", f"SELECT doc_id, p + 3 AS pos FROM ({_FOUND.format('thth', 4)})")
def kmp_all(spark: SparkSession, d: str) -> DataFrame:
    return text.find_all(_docs(spark, d), "text", "thth").select("doc_id", "pos")


@query("kmp_count", f"SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT doc_id AS i, count(*) AS n FROM ({_FOUND.format('thth', 4)}) GROUP BY 1) ON i = doc_id")
def kmp_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.find_count(F.col("text"), "thth").alias("n"))


@query("kmp_first", f"SELECT doc_id, CAST(CASE WHEN instr({_DOCS}, 'thth') = 0 THEN -1 ELSE instr({_DOCS}, 'thth') + 2 END AS BIGINT) AS pos FROM documents")
def kmp_first(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.find_first_end(F.col("text"), "thth").alias("pos"))


PATTERNS = ["tion", "onthe", "ation", "ing", "inge", "est", "chen", "ción", "eaux"]


@query("multi_pattern_matches", " UNION ALL ".join(f"SELECT doc_id, p AS pos, CAST({k} AS BIGINT) AS pid FROM ({_FOUND.format(p, len(p))})" for k, p in enumerate(PATTERNS)))
def multi_pattern_matches(spark: SparkSession, d: str) -> DataFrame:
    return text.find_patterns(_docs(spark, d), "text", PATTERNS).select("doc_id", "pos", "pid")


@query("multi_pattern_first", "SELECT doc_id, coalesce(x.pos, -1) AS pos, x.pid AS pid FROM (SELECT doc_id, list_sort(list_filter([" + ", ".join(f"CASE WHEN instr({_DOCS}, '{p}') > 0 THEN {{'e': instr({_DOCS}, '{p}')::BIGINT + {len(p) - 2}, 'n': -{len(p)}, 'pos': instr({_DOCS}, '{p}')::BIGINT - 1, 'pid': {k}::BIGINT}} END" for k, p in enumerate(PATTERNS)) + "], lambda z: z IS NOT NULL))[1] AS x FROM documents)")
def multi_pattern_first(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.find_first_pattern(F.col("text"), PATTERNS).alias("x")).select("doc_id", "x.pos", "x.pid")


@query("prefix_lookup", "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), p AS (SELECT DISTINCT lower(substr(c_mktsegment, 1, k)) AS prefix FROM customer, (SELECT unnest(range(1, 4)) AS k)) SELECT prefix, count(word) AS n_words, coalesce(bool_or(word = prefix), false) AS has_word FROM p LEFT JOIN w ON starts_with(word, prefix) GROUP BY 1")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    segments = table(spark, d, "customer").select("c_mktsegment").distinct()
    asked = segments.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.lower(F.substring(F.col("c_mktsegment"), F.lit(1), k)))).alias("prefix")).distinct()
    return text.prefix_search(words, asked)


_WORD_LOG = "SELECT word, p_partkey AS seq, CASE WHEN p_size > 40 THEN 'delete' ELSE 'add' END AS op FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word, p_partkey, p_size FROM part)"


def _word_log(spark: SparkSession, d: str) -> DataFrame:
    """Parts add the words of their names, large ones delete them."""
    op = F.when(F.col("p_size") > 40, "delete").otherwise("add")
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"), F.col("p_partkey").alias("seq"), op.alias("op")).distinct()


@query("dictionary_words", f"SELECT word FROM ({_WORD_LOG}) GROUP BY word HAVING arg_max(op, seq) = 'add'")
def dictionary_words(spark: SparkSession, d: str) -> DataFrame:
    return text.dictionary(_word_log(spark, d))


@query("dictionary_deletes", f"SELECT word, seq, found FROM (SELECT word, seq, op, coalesce(lag(op) OVER (PARTITION BY word ORDER BY seq) = 'add', false) AS found FROM ({_WORD_LOG})) WHERE op = 'delete'")
def dictionary_deletes(spark: SparkSession, d: str) -> DataFrame:
    return text.deletions(_word_log(spark, d))


@query("repeated_pattern", "WITH t AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s FROM orders), q AS (SELECT *, instr(substr(s || s, 2), s) AS k FROM t) SELECT o_orderkey, CASE WHEN k < len(s) THEN substr(s, 1, k::INT) ELSE '' END AS pattern, k < len(s) AS repeats FROM q")
def repeated_pattern(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "orders").select("o_orderkey", text.repeated_pattern(F.col("o_orderkey").cast("string")).alias("pattern"))
    return found.withColumn("repeats", F.col("pattern") != "")


# Sequences


@query("lcs_len", "SELECT DISTINCT p_name, p_type, " + _table_sql("lower(p_name)", "lower(p_type)", "list_transform(range(0, len(p_type) + 1), lambda j: 0::BIGINT)", "[0::BIGINT]", "CASE WHEN x[1] = y[1] THEN prev[y[2] + 1] + 1 ELSE greatest(prev[y[2] + 2], cur[-1]) END") + " AS lcs FROM part")
def lcs_len(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_name", "p_type").distinct()
    letters = lambda c: F.split(F.lower(c), "")
    return parts.withColumn("lcs", sequences.lcs_length(letters("p_name"), letters("p_type")))


@query("lis_len", f"SELECT grp, CAST(len(list_reduce(list([val] ORDER BY pos), lambda t, v: CASE WHEN len(list_filter(t, lambda y: y < v[1])) = len(t) THEN t || v ELSE list_transform(t, lambda y, i: CASE WHEN i = len(list_filter(t, lambda z: z < v[1])) + 1 THEN v[1] ELSE y END) END, []::BIGINT[])) AS BIGINT) AS lis FROM ({SERIES}) GROUP BY grp")
def lis_len(spark: SparkSession, d: str) -> DataFrame:
    lists = series(spark, d).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "val"))), lambda x: x["val"]).alias("v"))
    return lists.select("grp", sequences.lis_length(F.col("v"), "long").alias("lis"))


@query("lcs_letters")
def lcs_letters(spark: SparkSession, d: str) -> DataFrame:
    """One longest common subsequence of the letters of each part's name and type."""
    parts = table(spark, d, "part").select("p_name", "p_type").distinct()
    letters = lambda c: F.split(F.lower(c), "")
    return parts.withColumn("common", F.array_join(sequences.lcs_column(letters("p_name"), letters("p_type"), "string"), ""))


@query("lis_values")
def lis_values(spark: SparkSession, d: str) -> DataFrame:
    """One longest increasing subsequence of each customer's totals."""
    return ordering.to_lists(series(spark, d)).select("grp", sequences.lis_column(F.col("vals"), "bigint").alias("rising"))


# Placement

_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_PAIRS = f"SELECT c_custkey, n_name, n_nationkey, {_HASH.format(chr(39).join(['c_custkey::VARCHAR || ', '|', ' || n_name']))} AS h FROM customer, nation"


def _nodes(spark: SparkSession, d: str) -> list[str]:
    return [r[0] for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]  # the configured nodes


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey")


_HRW = f"SELECT c_custkey, n_nationkey::BIGINT AS node FROM ({_PAIRS}) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY h DESC, n_nationkey) = 1"


@query("hrw_assign", _HRW)
def hrw_assign(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("c_custkey", placement.hrw(F.col("c_custkey").cast("string"), _nodes(spark, d)).cast("long").alias("node"))


@query("placement_variance", f"SELECT count(*) AS nodes, CAST(sum(n) AS BIGINT) AS keys, (count(*) * sum(n * n) - sum(n) * sum(n))::DOUBLE / (count(*) * count(*) * sum(n) * sum(n))::DOUBLE AS variance FROM (SELECT node, count(*)::HUGEINT AS n FROM ({_HRW}) GROUP BY 1)")
def placement_variance(spark: SparkSession, d: str) -> DataFrame:
    per_node = hrw_assign(spark, d).groupBy("node").agg(F.count("*").alias("n"))
    return per_node.agg(F.count("*").alias("nodes"), F.sum("n").alias("keys"), placement.variance(F.col("n").cast("decimal(18,0)")).alias("variance"))


_WEIGHTS = "SELECT n_name, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT)::DOUBLE AS w FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"


@query("wrh_assign", f"SELECT c_custkey, n_name AS node FROM ({_PAIRS}) JOIN ({_WEIGHTS}) USING (n_name) WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY -ln((h + 1)::DOUBLE / 1152921504606846976::DOUBLE) / w, n_name) = 1")
def wrh_assign(spark: SparkSession, d: str) -> DataFrame:
    """Nations as nodes, their suppliers' balance as weight; those at or below zero take no keys."""
    nation = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    weights = {r[0]: float(r[1]) for r in nation.groupBy("n_name").agg(F.sum(cents("s_acctbal"))).collect()}  # a row a node
    return _keys(spark, d).select("c_custkey", placement.wrh(F.col("c_custkey").cast("string"), weights).alias("node"))


def _ring_sql(nodes: str) -> str:
    return f"""SELECT c_custkey, coalesce(node, first_node) AS node FROM (
      SELECT c_custkey, {_HASH.format('c_custkey::VARCHAR')} AS h FROM customer) ASOF LEFT JOIN (
      SELECT {_HASH.format(chr(39).join(['n_name || ', '#', ' || i::VARCHAR']))} AS h, n_name AS node FROM ({nodes}), (SELECT unnest(range(0, 100)) AS i)) p USING (h)
    , (SELECT arg_min(n_name, {_HASH.format(chr(39).join(['n_name || ', '#', ' || i::VARCHAR']))}) AS first_node FROM ({nodes}), (SELECT unnest(range(0, 100)) AS i))""".replace("USING (h)", "ON k.h <= p.h").replace("FROM customer) ASOF", "FROM customer) k ASOF")


@query("ring_assign", _ring_sql("SELECT n_name FROM nation"))
def ring_assign(spark: SparkSession, d: str) -> DataFrame:
    ring = placement.Ring(_nodes(spark, d))
    return _keys(spark, d).select("c_custkey", ring.node(F.col("c_custkey").cast("string")).alias("node"))


@query("ring_rebalance", f"SELECT a.c_custkey, a.node AS before, b.node AS after FROM ({_ring_sql('SELECT n_name FROM nation')}) a JOIN ({_ring_sql('SELECT n_name FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation)')}) b USING (c_custkey) WHERE a.node <> b.node")
def ring_rebalance(spark: SparkSession, d: str) -> DataFrame:
    """Keys that move, and where to, when the first node goes."""
    nodes = _nodes(spark, d)
    key = F.col("c_custkey").cast("string")
    moved = _keys(spark, d).select("c_custkey", placement.Ring(nodes).node(key).alias("before"), placement.Ring(nodes[1:]).node(key).alias("after"))
    return moved.filter("before <> after")


@query("hrw_xxh64")
def hrw_xxh64(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("c_custkey", placement.hrw(F.col("c_custkey").cast("string"), _nodes(spark, d), "xxh64").alias("node"))


@query("wrh_xxh64")
def wrh_xxh64(spark: SparkSession, d: str) -> DataFrame:
    weights = {n: float(1 + k % 4) for k, n in enumerate(_nodes(spark, d))}
    return _keys(spark, d).select("c_custkey", placement.wrh(F.col("c_custkey").cast("string"), weights, "xxh64").alias("node"))


@query("ring_xxh64")
def ring_xxh64(spark: SparkSession, d: str) -> DataFrame:
    ring = placement.Ring(_nodes(spark, d), family="xxh64")
    return _keys(spark, d).select("c_custkey", ring.node(F.col("c_custkey").cast("string")).alias("node"))


# Bloom filter

HASHES = 4
_BITS = "(SELECT 1::BIGINT << ceil(log2(16 * greatest(count(*), 1)))::INT FROM part WHERE p_size > 40)"
_BIT = f"({_HASH.format(chr(39).join(['i::VARCHAR || ', ':', ' || k::VARCHAR']))} % {_BITS})"


@query("bloom_semi_filter", f"WITH i AS (SELECT unnest(range(0, {HASHES})) AS i), b AS (SELECT DISTINCT {_BIT} AS bit FROM (SELECT p_partkey AS k FROM part WHERE p_size > 40), i) SELECT k AS l_partkey FROM (SELECT k, {_BIT} AS bit FROM (SELECT DISTINCT l_partkey AS k FROM lineitem), i) SEMI JOIN b USING (bit) GROUP BY k HAVING count(*) = {HASHES}")
def bloom_semi_filter(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "part").filter("p_size > 40")
    bits = bloom.bits_for(keys.count())
    return bloom.might_contain(table(spark, d, "lineitem"), "l_partkey", bloom.build(keys, "p_partkey", bits, HASHES), bits, HASHES)


# Caches

CAPACITY = 50
#: Of each of the caches that hold values.
VALUES = 5


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("cache_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"))


@query("lru_hits", f"""WITH x AS (SELECT event_type AS cache_id, event_id AS seq, user_id AS key, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id))
  SELECT a.cache_id, a.seq, any_value(a.key) AS key, any_value(a.before) IS NOT NULL AND count(b.seq) < {CAPACITY} AS hit
  FROM x a LEFT JOIN x b ON b.cache_id = a.cache_id AND b.seq > a.before AND b.seq < a.seq AND (b.after IS NULL OR b.after >= a.seq) GROUP BY 1, 2""")
def lru_hits(spark: SparkSession, d: str) -> DataFrame:
    return caches.lru_hits(_log(spark, d), CAPACITY)


@query("lfu_hits")
def lfu_hits(spark: SparkSession, d: str) -> DataFrame:
    return caches.lfu_hits(_log(spark, d), CAPACITY)


def _ops(spark: SparkSession, d: str) -> DataFrame:
    """Purchases and signups put a user's value in one of 64 caches, other events ask for it."""
    op = F.when(F.col("event_type").isin("purchase", "signup"), "put").otherwise("get")
    return table(spark, d, "events").select((F.col("user_id") % 64).alias("cache_id"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), cents("value").alias("val"))


@query("lru_replay")
def lru_replay(spark: SparkSession, d: str) -> DataFrame:
    return caches.replay(_ops(spark, d), caches.LRU, VALUES)


@query("lfu_replay")
def lfu_replay(spark: SparkSession, d: str) -> DataFrame:
    return caches.replay(_ops(spark, d), caches.LFU, VALUES)


# Graphs

_EDGES = f"""SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, min({CENTS.format('l_extendedprice')}) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""
_WITH = f"WITH RECURSIVE e AS MATERIALIZED ({_EDGES}), v AS (SELECT n_nationkey::BIGINT AS id FROM nation)"
_REACH = ", r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cut(trade_graph(spark, d)), vertices(spark, d)


@query("reverse_edges", _WITH + " SELECT dst, string_agg(src::VARCHAR, ',' ORDER BY src) AS sources FROM e GROUP BY 1")
def reverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return graphs.in_lists(trade_graph(spark, d))


@query("connected_components", _WITH + ", u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, u.dst FROM r JOIN u ON u.src = r.b) SELECT a AS id, min(b) AS comp FROM r GROUP BY 1")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.components(*_graph(spark, d))


@query("has_cycle", _WITH + _REACH + " SELECT count(*) > 0 AS has_cycle FROM r WHERE a = b")
def has_cycle(spark: SparkSession, d: str) -> DataFrame:
    return graphs.has_cycle(_graph(spark, d)[0])


@query("cycle_vertices", _WITH + _REACH + " SELECT DISTINCT a AS id FROM r WHERE a = b")
def cycle_vertices(spark: SparkSession, d: str) -> DataFrame:
    return graphs.cycle_vertices(*_graph(spark, d))


@query("scc", _WITH + _REACH + " SELECT id, least(id, coalesce(min(x.b), id)) AS comp FROM v LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON p.a = q.b AND p.b = q.a) x ON x.a = id GROUP BY 1")
def scc(spark: SparkSession, d: str) -> DataFrame:
    return graphs.scc(*_graph(spark, d))


@query("topo_level", _WITH + ", p AS (SELECT id, 0::BIGINT AS n FROM v UNION SELECT e.dst, p.n + 1 FROM p JOIN e ON e.src = p.id WHERE e.src < e.dst) SELECT id, max(n) AS level FROM p GROUP BY 1")
def topo_level(spark: SparkSession, d: str) -> DataFrame:
    e, v = _graph(spark, d)
    return graphs.topological_levels(e.filter("src < dst"), v)


_ROOT = "(SELECT min(id) FROM v)"


@query("shortest_dist", _WITH + f", p AS (SELECT {_ROOT} AS id, 0::BIGINT AS dist, 0 AS hops UNION SELECT e.dst, min(p.dist + e.w), p.hops + 1 FROM p JOIN e ON e.src = p.id WHERE p.hops < 25 GROUP BY e.dst, p.hops) SELECT v.id, min(p.dist) AS dist FROM v LEFT JOIN p USING (id) GROUP BY 1")
def shortest_dist(spark: SparkSession, d: str) -> DataFrame:
    e, v = _graph(spark, d)
    return graphs.shortest_paths(e, v, v.agg(F.min("id")).first()[0]).select("id", "dist")


_DIST = f", p AS (SELECT {_ROOT} AS id, 0::BIGINT AS dist, 0 AS hops UNION SELECT e.dst, min(p.dist + e.w), p.hops + 1 FROM p JOIN e ON e.src = p.id WHERE p.hops < 25 GROUP BY e.dst, p.hops), d AS MATERIALIZED (SELECT id, min(dist) AS dist FROM p GROUP BY 1)"


@query("shortest_path", _WITH + _DIST + f""", up AS (SELECT e.dst AS id, min(e.src) AS parent FROM e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst WHERE a.dist + e.w = b.dist AND e.src <> e.dst AND e.dst <> {_ROOT} GROUP BY 1),
  c AS (SELECT id AS target, id AS vertex, parent, 0 AS back FROM up UNION ALL SELECT c.target, up.id, up.parent, c.back + 1 FROM c JOIN up ON up.id = c.parent)
  SELECT target, count(*) OVER (PARTITION BY target) - back AS pos, vertex FROM c""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """The vertices on the shortest path to every vertex."""
    e, v = _graph(spark, d)
    return graphs.paths_to(graphs.shortest_paths(e, v, v.agg(F.min("id")).first()[0]), v)


_SUPPLY = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, min({CENTS.format('l_extendedprice')}) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  u AS MATERIALIZED (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e), v AS (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier)"""


@query("supply_components", _SUPPLY + ", c(id, comp) USING KEY (id) AS (SELECT id, id FROM v UNION (SELECT u.dst, min(c.comp) FROM c JOIN u ON u.src = c.id JOIN recurring.c AS k ON k.id = u.dst WHERE c.comp < k.comp GROUP BY 1)) SELECT id, comp FROM c")
def supply_components(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers that are connected by orders."""
    e, v = supply_graph(spark, d)
    return graphs.components(e, v)


@query("supply_dist", _SUPPLY + ", c(id, dist) USING KEY (id) AS (SELECT id, CASE WHEN id = (SELECT min(id) FROM v) THEN 0 ELSE 9223372036854775807 END FROM v UNION (SELECT u.dst, min(c.dist + u.w) FROM c JOIN u ON u.src = c.id JOIN recurring.c AS k ON k.id = u.dst WHERE c.dist < 9223372036854775807 - u.w AND c.dist + u.w < k.dist GROUP BY 1)) SELECT id, CASE WHEN dist < 9223372036854775807 THEN dist END AS dist FROM c")
def supply_dist(spark: SparkSession, d: str) -> DataFrame:
    """Distances from the first customer along orders, either way."""
    e, v = supply_graph(spark, d)
    both = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    return graphs.shortest_paths(both, v, v.agg(F.min("id")).first()[0]).select("id", "dist")


@query("msf_edges", _WITH + ", t AS (SELECT src, dst, w, row_number() OVER (ORDER BY w, src, dst) AS k FROM e WHERE src <> dst), u AS (SELECT src, dst, k FROM t UNION ALL SELECT dst, src, k FROM t), r AS (SELECT k AS edge, src AS at FROM t UNION SELECT r.edge, u.dst FROM r JOIN u ON u.src = r.at AND u.k < r.edge) SELECT src, dst, w FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.edge = t.k AND r.at = t.dst)")
def msf_edges(spark: SparkSession, d: str) -> DataFrame:
    return graphs.spanning_forest(*_graph(spark, d))


@query("mst_weight", "SELECT count(*) AS edges, CAST(sum(w) AS BIGINT) AS weight FROM (" + SQL["msf_edges"] + ")")
def mst_weight(spark: SparkSession, d: str) -> DataFrame:
    """The tree turned away from its root, and its weight: parents and edges agree in number."""
    e, v = _graph(spark, d)
    forest = graphs.spanning_forest(e, v)
    tree = graphs.rooted(forest, v, v.agg(F.min("id")).first()[0])
    met = forest.join(tree.select("id", "parent"), ((F.col("id") == F.col("src")) & (F.col("parent") == F.col("dst"))) | ((F.col("id") == F.col("dst")) & (F.col("parent") == F.col("src"))))
    return met.agg(F.count("*").alias("edges"), F.sum("w").alias("weight"))


@query("prim_parents", "WITH RECURSIVE m AS MATERIALIZED (" + SQL["msf_edges"] + "), u AS (SELECT src, dst FROM m UNION ALL SELECT dst, src FROM m), p AS (SELECT (SELECT min(n_nationkey)::BIGINT FROM nation) AS id, -1::BIGINT AS parent UNION SELECT u.dst, u.src FROM p JOIN u ON u.src = p.id AND u.dst <> p.parent) SELECT n_nationkey::BIGINT AS id, parent FROM nation LEFT JOIN p ON p.id = n_nationkey")
def prim_parents(spark: SparkSession, d: str) -> DataFrame:
    e, v = _graph(spark, d)
    return graphs.rooted(graphs.spanning_forest(e, v), v, v.agg(F.min("id")).first()[0])


# Trees


def _part_tree(spark: SparkSession, d: str) -> DataFrame:
    return trees.from_level_order(table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("at")), "at", "p_partkey")


_N = "(SELECT count(*) FROM part)"


@query("tree_lca", f"""WITH RECURSIVE a AS (SELECT p_partkey AS id, p_partkey AS anc FROM part UNION ALL SELECT id, (anc - 1) // 2 FROM a WHERE anc > 0),
  q AS (SELECT p_partkey AS u, (p_partkey * 7 + 3) % {_N} AS v FROM part) SELECT u, v, max(x.anc) AS lca FROM q JOIN a x ON x.id = u JOIN a y ON y.id = v AND y.anc = x.anc GROUP BY 1, 2""")
def tree_lca(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").count()
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("u"), ((F.col("p_partkey") * 7 + 3) % n).alias("v"))
    return trees.lca(_part_tree(spark, d), asked)


@query("bst_lca", f"""WITH t AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS key, 6 - bit_count(CAST((p_size & -p_size) - 1 AS INT))::BIGINT AS depth FROM part),
  q AS (SELECT DISTINCT a.p_size::BIGINT AS u, b.p_size::BIGINT AS v FROM part a JOIN part b ON b.p_partkey = (a.p_partkey * 7 + 3) % {_N})
  SELECT u, v, arg_min(t.key, t.depth * 1000 + t.key) AS lca FROM q JOIN t ON t.key BETWEEN least(u, v) AND greatest(u, v) GROUP BY 1, 2""")
def bst_lca(spark: SparkSession, d: str) -> DataFrame:
    """Part sizes in the perfect search tree of 1 to 63, where a key's depth follows from its trailing zeros."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    keys = parts.select(F.col("size").alias("key")).distinct()
    tree = keys.withColumn("depth", (6 - F.bit_count(F.col("key").bitwiseAND(-F.col("key")) - 1)).cast("long") * 1000 + F.col("key"))
    other = parts.select(F.col("p_partkey").alias("other"), F.col("size").alias("v"))
    asked = parts.withColumn("other", (F.col("p_partkey") * 7 + 3) % parts.count()).join(other, "other").select(F.col("size").alias("u"), "v").distinct()
    return trees.search_tree_lca(tree, asked)


@query("bst_search", "SELECT DISTINCT l_linenumber::BIGINT * 9 AS key, l_linenumber * 9 IN (SELECT p_size FROM part) AS found FROM lineitem")
def bst_search(spark: SparkSession, d: str) -> DataFrame:
    tree = trees.from_level_order(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("key")), "p_partkey", "key")
    return trees.search(tree, table(spark, d, "lineitem").select((F.col("l_linenumber").cast("long") * 9).alias("key")).distinct())
