"""Named queries over the star schema and the events table, one or more for each operator, with the SQL they equal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import sources
from .frame import Frame, concat
from .functions import all_columns, as_struct, by_dtype, col, ends_with, if_else, length, lit, map_batches, map_values, matches, numeric, starts_with
from .series import from_series
from .sql import SqlContext
from .streaming import session_windows, tumbling

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (read) as a query: read(name) gives a table's frame."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda name: Frame(spark.read.parquet(f"{sf_dir}/{name}.parquet")))
            return out.df if isinstance(out, Frame) else out

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r(e, digits: int = 4):
    return e.cast("double").round(digits)


def scratch() -> str:
    """A folder that all executors see."""
    from .session import active

    root = active().conf.get("spark.checkpoint.dir", None)
    if root is None and not active().sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or f"file://{tempfile.gettempdir()}"
    return f"{root}/tessera-{uuid.uuid4().hex}"


# scan, filter, project, group


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    f = t("lineitem").filter(col("l_shipdate") <= lit("1998-09-02").cast("timestamp_ntz"))
    revenue = (col("l_extendedprice") * (1 - col("l_discount"))).sum()
    return f.group_by("l_returnflag", "l_linestatus").agg(col("l_quantity").sum().alias("sum_qty"), r(revenue, 2).alias("revenue"), r(col("l_discount").mean(), 6).alias("avg_disc"), length().alias("n")).sort("l_returnflag", "l_linestatus")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount > 0.05")
def filter_project(t):
    return t("lineitem").filter(col("l_quantity").is_between(10, 20) & (col("l_discount") > 0.05)).select("l_orderkey", "l_linenumber", (col("l_extendedprice") * (1 - col("l_discount"))).alias("net"))


@query("SELECT o_orderkey, o_totalprice, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders), 10) AS share FROM orders")
def aggregate_beside_columns(t):
    return t("orders").select("o_orderkey", "o_totalprice", (col("o_totalprice") / col("o_totalprice").sum()).round(10).alias("share"))


@query("SELECT count(*) AS n, sum(o_totalprice > 100000)::BIGINT AS big, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high FROM orders")
def aggregate_select(t):
    return t("orders").select(length().alias("n"), (col("o_totalprice") > 100000).sum().alias("big"), col("o_totalprice").min().round(2).alias("low"), col("o_totalprice").max().round(2).alias("high"))


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS std, round(var_pop(l_quantity), 6) AS var0, median(l_extendedprice) AS med, count(l_tax) AS n,
  count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag""")
def aggregates(t):
    return t("lineitem").group_by("l_returnflag").agg(r(col("l_quantity").std(), 6).alias("std"), r(col("l_quantity").var(0), 6).alias("var0"), col("l_extendedprice").median().alias("med"), col("l_tax").count().alias("n"), col("l_suppkey").n_unique().alias("suppliers"))


_Q = {"linear": "quantile_cont(o_totalprice, 0.3)", "lower": "s[floor((n - 1) * 0.3)::INT + 1]", "higher": "s[ceil((n - 1) * 0.3)::INT + 1]", "nearest": "s[floor((n - 1) * 0.3 + 0.5)::INT + 1]", "midpoint": "(s[floor((n - 1) * 0.3)::INT + 1] + s[ceil((n - 1) * 0.3)::INT + 1]) / 2"}


@query("SELECT o_orderpriority, round(lin, 4) AS linear, " + ", ".join(f"round({e}, 4) AS {k}" for k, e in _Q.items() if k != "linear") + " FROM (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.3) AS lin, list_sort(list(o_totalprice)) AS s, count(*) AS n FROM orders GROUP BY 1)")
def quantiles(t):
    return t("orders").group_by("o_orderpriority").agg(*[r(col("o_totalprice").quantile(0.3, k)).alias(k) for k in _Q])


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 2")
def group_lists(t):
    return t("orders").ordered_by("o_orderkey").group_by("o_custkey").agg(col("o_orderkey").alias("keys"), length().alias("n")).filter(col("n") > 2)


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def first_last(t):
    return t("events").ordered_by("ts", "event_id").group_by("user_id").agg(col("event_type").first().alias("first_type"), col("event_type").last().alias("last_type"))


# joins


@query("SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
def join_inner(t):
    return t("customer").select("c_custkey", "c_name").join(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), left_on="c_custkey", right_on="o_custkey")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
def join_left(t):
    return t("customer").select("c_custkey").join(t("orders").filter(col("o_totalprice") > 300000).select("o_orderkey", "o_custkey"), left_on="c_custkey", right_on="o_custkey", how="left")


@query("SELECT s.s_suppkey, s.s_name, c.c_custkey, c.c_name FROM (SELECT * FROM supplier) s FULL JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON s.s_suppkey = c.c_custkey")
def join_full(t):
    return t("supplier").select("s_suppkey", "s_name").join(t("customer").filter(col("c_custkey") % 3 == 0).select("c_custkey", "c_name"), left_on="s_suppkey", right_on="c_custkey", how="full")


@query("SELECT s.s_suppkey, s.s_name, c.c_key, c.c_name FROM supplier s FULL JOIN (SELECT c_custkey + 5 AS c_key, c_name FROM customer) c ON s.s_suppkey = c.c_key")
def join_full_shifted(t):
    return t("supplier").select("s_suppkey", "s_name").join(t("customer").select((col("c_custkey") + 5).alias("c_key"), "c_name"), left_on="s_suppkey", right_on="c_key", how="full")


@query("SELECT n_name, r_name FROM nation, region")
def join_cross(t):
    return t("nation").select("n_name").join(t("region").select("r_name"), how="cross")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(t):
    return t("customer").select("c_custkey").join(t("orders"), left_on="c_custkey", right_on="o_custkey", how="semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t):
    return t("customer").select("c_custkey").join(t("orders"), left_on="c_custkey", right_on="o_custkey", how="anti")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti_some(t):
    return t("customer").select("c_custkey", "c_name").join(t("orders").filter(col("o_totalprice") > 200000), left_on="c_custkey", right_on="o_custkey", how="anti")


@query("SELECT a.o_orderkey, a.o_custkey, b.o_orderkey AS o_orderkey_right FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus")
def join_keys_suffix(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.join(o, on=["o_custkey", "o_orderstatus"]).drop("o_orderstatus")


_P = "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'"
_C = "SELECT user_id, ts, max(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY 1, 2"


def _sides(t):
    e = t("events")
    p = e.filter(col("event_type") == "purchase").select("event_id", "user_id", "ts")
    c = e.filter(col("event_type") == "click").group_by("user_id", "ts").agg(col("event_id").max().alias("click"))
    return p, c


@query(f"SELECT p.event_id, p.user_id, c.click FROM ({_P}) p ASOF LEFT JOIN ({_C}) c ON p.user_id = c.user_id AND p.ts >= c.ts")
def asof_backward(t):
    p, c = _sides(t)
    return p.join_asof(c, "ts", by=["user_id"]).drop("ts")


@query(f"SELECT p.event_id, p.user_id, c.click FROM ({_P}) p ASOF LEFT JOIN ({_C}) c ON p.user_id = c.user_id AND p.ts <= c.ts")
def asof_forward(t):
    p, c = _sides(t)
    return p.join_asof(c, "ts", by=["user_id"], strategy="forward").drop("ts")


@query(f"""SELECT b.event_id, b.user_id, CASE WHEN b.t IS NULL OR f.t - b.ts < b.ts - b.t THEN coalesce(f.click, b.click) ELSE b.click END AS click FROM
  (SELECT p.*, c.click, c.ts AS t FROM ({_P}) p ASOF LEFT JOIN ({_C}) c ON p.user_id = c.user_id AND p.ts >= c.ts) b JOIN
  (SELECT p.event_id, c.click, c.ts AS t FROM ({_P}) p ASOF LEFT JOIN ({_C}) c ON p.user_id = c.user_id AND p.ts <= c.ts) f USING (event_id)""")
def asof_nearest(t):
    p, c = _sides(t)
    return p.join_asof(c, "ts", by=["user_id"], strategy="nearest").drop("ts")


@query(f"SELECT p.event_id, p.user_id, CASE WHEN p.ts - c.ts <= INTERVAL 2 HOUR THEN c.click END AS click FROM ({_P}) p ASOF LEFT JOIN ({_C}) c ON p.user_id = c.user_id AND p.ts >= c.ts")
def asof_tolerance(t):
    p, c = _sides(t)
    return p.join_asof(c, "ts", by=["user_id"], tolerance="2h").drop("ts")


# windows


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS above, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def over_partition(t):
    return t("orders").select("o_orderkey", (col("o_totalprice") - col("o_totalprice").mean().over("o_custkey")).round(6).alias("above"), length().over("o_custkey").alias("n"))


_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@query(f"SELECT event_id, lag(value, 1) {_W}) AS before, lead(value, 1) {_W}) AS after, round(value - lag(value, 1) {_W}), 6) AS diff FROM events")
def shift_diff(t):
    e = t("events").ordered_by("ts", "event_id")
    return e.select("event_id", col("value").shift(1).over("user_id").alias("before"), col("value").shift(-1).over("user_id").alias("after"), col("value").diff(1).over("user_id").round(6).alias("diff"))


@query(f"""SELECT event_id, last_value(v IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS ffill, first_value(v IGNORE NULLS) {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill,
  last_value(v IGNORE NULLS) {_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS ffill1 FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)""")
def fills(t):
    e = t("events").ordered_by("ts", "event_id").with_columns(if_else(col("event_type") == "purchase", col("value"), None).alias("v"))
    return e.select("event_id", col("v").forward_fill().over("user_id").alias("ffill"), col("v").fill_null_strategy("bfill").over("user_id").alias("bfill"), col("v").forward_fill(1).over("user_id").alias("ffill1"))


@query(f"""SELECT event_id, round(avg(value) {_W} ROWS 2 PRECEDING), 6) AS m, round(sum(value) {_W} ROWS 2 PRECEDING), 6) AS s, min(value) {_W} ROWS 2 PRECEDING) AS lo,
  CASE WHEN count(value) {_W} ROWS 2 PRECEDING) >= 3 THEN max(value) {_W} ROWS 2 PRECEDING) END AS hi FROM events""")
def rolling_rows(t):
    e, v = t("events").ordered_by("ts", "event_id"), col("value")
    return e.select("event_id", v.rolling_mean(3).over("user_id").round(6).alias("m"), v.rolling_sum("3i").over("user_id").round(6).alias("s"), v.rolling_min(3).over("user_id").alias("lo"), v.rolling_max(3, min_periods=3).over("user_id").alias("hi"))


_T = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN"
_U = "INTERVAL 1 MICROSECOND"


@query(f"""SELECT event_id, round(sum(value) {_T} (INTERVAL 6 HOUR - {_U}) PRECEDING AND CURRENT ROW), 6) AS r_right, count(value) {_T} INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n_both,
  round(avg(value) {_T} INTERVAL 6 HOUR PRECEDING AND {_U} PRECEDING), 6) AS m_left, max(value) {_T} (INTERVAL 6 HOUR - {_U}) PRECEDING AND {_U} PRECEDING) AS x_none FROM events""")
def rolling_time(t):
    v = col("value")
    both = if_else(v.is_not_null(), 1, 0).rolling_sum_by("6h", "ts", closed="both").over("user_id")
    return t("events").select("event_id", v.rolling_sum_by("6h", "ts", closed="right").over("user_id").round(6).alias("r_right"), both.alias("n_both"), v.rolling_mean_by("6h", "ts").over("user_id").round(6).alias("m_left"), v.rolling_max_by("6h", "ts", closed="none").over("user_id").alias("x_none"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS ts, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def dynamic_tumbling(t):
    return t("events").group_by_dynamic("ts", "1h", by=["event_type"]).agg(length().alias("n"), col("value").sum().round(4).alias("v"))


@query("""WITH e AS (SELECT *, min(ts) OVER (PARTITION BY event_type) AS f FROM events),
  x AS (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM e)
  SELECT event_type, s AS _lower_boundary, s + INTERVAL 2 HOUR AS _upper_boundary, s AS ts, count(*) AS n FROM x WHERE s >= time_bucket(INTERVAL 1 HOUR, f) GROUP BY 1, 2""")
def dynamic_sliding(t):
    return t("events").group_by_dynamic("ts", "1h", "2h", by=["event_type"], include_boundaries=True).agg(length().alias("n"))


@query("""SELECT user_id, s + INTERVAL 1 DAY AS ts, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts - INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND) + INTERVAL 6 HOUR AS s FROM events) GROUP BY 1, 2""")
def dynamic_right_offset(t):
    return t("events").group_by_dynamic("ts", "1d", offset="6h", by=["user_id"], closed="right", label="right").agg(length().alias("n"))


@query("""SELECT event_type, min(ts) AS ts, count(*) AS n FROM (SELECT *, floor(epoch_us(ts - f) / 7200000000.0) AS k, epoch_us(ts - f) % 7200000000 AS o FROM (SELECT *, min(ts) OVER (PARTITION BY event_type) AS f FROM events)) WHERE o < 3600000000 GROUP BY event_type, k""")
def dynamic_gaps_from_data(t):
    return t("events").group_by_dynamic("ts", "2h", "1h", by=["event_type"], label="data_point", start_by="data_point").agg(length().alias("n"))


@query("SELECT date_trunc('week', ts) + INTERVAL 2 DAY - CASE WHEN isodow(ts) < 3 THEN INTERVAL 7 DAY ELSE INTERVAL 0 DAY END AS ts, count(*) AS n FROM events GROUP BY 1")
def dynamic_weekday(t):
    return t("events").group_by_dynamic("ts", "7d", start_by="wednesday").agg(length().alias("n"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, k")
def sessions(t):
    from pyspark.sql import functions as F

    return session_windows(t("events").df, "ts", "6 hours", [F.count("*").alias("n")], ["user_id"])


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(t):
    from pyspark.sql import functions as F

    return tumbling(t("events").df, "ts", "30 minutes", [F.count("*").alias("n")], ["event_type"])


# sort, reshape


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(t):
    return t("orders").select("o_orderkey", "o_totalprice").sort("o_totalprice", "o_orderkey", descending=[True, False]).limit(25)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail(t):
    return t("orders").select("o_orderkey").ordered_by("o_orderkey").tail(7)


@query("SELECT user_id, " + ", ".join(f"sum(CASE WHEN event_type = '{k}' THEN 1 END) AS {k}" for k in ("click", "error", "purchase")) + " FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1")
def pivot(t):
    e = t("events").filter(col("event_type").is_in(["click", "error", "purchase"])).with_columns(lit(1).cast("long").alias("one"))
    return e.pivot(["user_id"], "event_type", ["one"], "sum", ["click", "error", "purchase"])


@query("SELECT s_suppkey, 'a' AS variable, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'b', s_acctbal FROM supplier")
def unpivot(t):
    return t("supplier").select("s_suppkey", col("s_nationkey").alias("a"), col("s_acctbal").alias("b")).unpivot(["s_suppkey"])


@query("SELECT c_custkey AS k, c_name AS n FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def concat_rows(t):
    return concat([t("customer").select(col("c_custkey").alias("k"), col("c_name").alias("n")), t("supplier").select(col("s_suppkey").alias("k"), col("s_name").alias("n"))])


@query("SELECT c_custkey AS k, c_name AS n, NULL::DOUBLE AS b FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def concat_diagonal(t):
    return concat([t("customer").select(col("c_custkey").alias("k"), col("c_name").alias("n")), t("supplier").select(col("s_suppkey").alias("k"), col("s_acctbal").alias("b"))], "diagonal")


@query("SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)")
def concat_columns(t):
    return concat([t("nation").ordered_by("n_nationkey"), t("region").ordered_by("r_regionkey")], "horizontal").select("n_name", "r_name")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode_words(t):
    return t("part").select("p_partkey", col("p_name").str.split(" ").alias("word")).explode("word")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t):
    return t("orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("""SELECT * FROM (SELECT unnest(['count', 'null_count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS statistic,
  round(unnest([count(o_totalprice), 0, avg(o_totalprice), stddev_samp(o_totalprice), min(o_totalprice), list_sort(list(o_totalprice))[floor((count(*) - 1) * 0.25 + 0.5)::INT + 1], median(o_totalprice), list_sort(list(o_totalprice))[floor((count(*) - 1) * 0.75 + 0.5)::INT + 1], max(o_totalprice)]), 4) AS o_totalprice FROM orders)""")
def describe(t):
    return t("orders").select("o_totalprice").describe().with_columns(col("o_totalprice").round(4))


@query()
def sample(t):
    return t("orders").sample(n=100, seed=7)


# scalar functions


@query("""SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 6) AS ln, round(log10(o_totalprice), 6) AS lg, round(exp(-o_totalprice / 1e5), 8) AS e, round(pow(o_totalprice, 0.25), 6) AS p,
  floor(o_orderkey / 7.0)::BIGINT AS fd, o_orderkey % 7 AS rem, o_orderkey / 7.0::DOUBLE AS d, abs(500 - o_orderkey) AS a, (o_orderkey > 5) <> (o_totalprice > 1e5) AS x FROM orders""")
def arithmetic(t):
    p, k = col("o_totalprice"), col("o_orderkey")
    return t("orders").select("o_orderkey", p.sqrt().round(6).alias("root"), p.log().round(6).alias("ln"), p.log(10).round(6).alias("lg"), (-p / 1e5).exp().round(8).alias("e"), (p**0.25).round(6).alias("p"), (k // 7).alias("fd"), (k % 7).alias("rem"), (k / 7).alias("d"), (500 - k).abs().alias("a"), ((k > 5) ^ (p > 1e5)).alias("x"))


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, strlen(p_name) AS n, substr(p_name, 2, 4) AS mid, substr(p_name, -3) AS tail, replace(p_name, 'a', '_') AS lit, regexp_replace(p_name, '[aeiou]+', '*', 'g') AS re,
  CASE WHEN regexp_matches(p_brand, '#\\d+') THEN regexp_extract(p_brand, '#(\\d+)', 1) END AS num, regexp_matches(p_type, '^[A-M]') AS early, starts_with(p_brand, 'Brand') AS b, p_type LIKE '%L' AS l, trim(p_name, 'aeiou') AS strip,
  CASE WHEN starts_with(p_brand, 'Brand') THEN substr(p_brand, 6) ELSE p_brand END AS cut, p_name || '/' || p_brand AS both FROM part""")
def strings(t):
    n, b, k = col("p_name"), col("p_brand"), col("p_type")
    return t("part").select("p_partkey", n.str.to_upper().alias("up"), k.str.to_lower().alias("low"), n.str.len().alias("n"), n.str.slice(1, 4).alias("mid"), n.str.slice(-3).alias("tail"), n.str.replace_all("a", "_").alias("lit"), n.str.replace_all("[aeiou]+", "*", regex=True).alias("re"), b.str.extract(r"#(\d+)").alias("num"), k.str.contains("^[A-M]").alias("early"), b.str.starts_with("Brand").alias("b"), k.str.ends_with("L").alias("l"), n.str.strip_chars("aeiou").alias("strip"), b.str.strip_prefix("Brand").alias("cut"), (n + lit("/") + b).alias("both"))


@query("""SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, dayofyear(ts)::INT AS od, isodow(ts)::INT AS wd, (microsecond(ts) % 1000000)::INT AS us,
  ts::DATE AS date, strftime(ts, '%Y/%m/%d %H:%M') AS text, time_bucket(INTERVAL 15 MINUTE, ts) AS tr, time_bucket(INTERVAL 1 HOUR, ts + INTERVAL 30 MINUTE) AS ro, ts + INTERVAL 1 DAY - INTERVAL 2 HOUR AS off, date_trunc('month', ts)::TIMESTAMP AS m1, ts + INTERVAL 1 MONTH AS next, epoch_us(ts) AS us_epoch, epoch_us(ts) // 1000 AS ms_epoch FROM events""")
def times(t):
    d = col("ts").dt
    return t("events").select("event_id", d.year().alias("y"), d.month().alias("mo"), d.day().alias("d"), d.hour().alias("h"), d.minute().alias("mi"), d.second().alias("s"), d.ordinal_day().alias("od"), d.weekday().alias("wd"), d.microsecond().alias("us"), d.date().alias("date"), d.to_string("%Y/%m/%d %H:%M").alias("text"), d.truncate("15m").alias("tr"), d.round("1h").alias("ro"), d.offset_by("1d").dt.offset_by("-2h").alias("off"), d.truncate("1mo").alias("m1"), d.offset_by("1mo").alias("next"), d.timestamp("us").alias("us_epoch"), d.timestamp("ms").alias("ms_epoch"))


@query("SELECT event_id, ts + INTERVAL 8 HOUR AS there, ts - INTERVAL 8 HOUR AS instant FROM events")
def time_zones(t):
    return t("events").select("event_id", col("ts").dt.convert_time_zone("Asia/Shanghai").alias("there"), col("ts").dt.replace_time_zone("Asia/Shanghai").alias("instant"))


@query("SELECT event_id, try_strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d')::DATE AS d, NULL::TIMESTAMP AS none FROM events")
def parse_times(t):
    text = col("ts").dt.to_string("%Y-%m-%d")
    return t("events").select("event_id", text.str.to_date("%Y-%m-%d").alias("d"), text.str.to_datetime("%d/%m/%Y %H:%M:%S").alias("none"))


@query("""SELECT event_id, date_trunc('second', ts) AS back, date_trunc('month', ts)::TIMESTAMP AS month, CAST(floor(microsecond(ts) % 1000000 / 1000) AS INTEGER) AS ms,
  (microsecond(ts) % 1000000)::BIGINT * 1000 AS ns FROM events""")
def parse_datetimes(t):
    back = col("ts").dt.to_string("%d/%m/%Y %H:%M:%S").str.to_datetime("%d/%m/%Y %H:%M:%S")
    return t("events").select("event_id", back.alias("back"), col("ts").dt.truncate("1mo").alias("month"), col("ts").dt.millisecond().alias("ms"), col("ts").dt.nanosecond().alias("ns"))


@query(r"""SELECT p_partkey, p_retailprice AS price, regexp_replace(p_name, '(\w+) (\w+)', '\2 \1', 'g') AS swapped, p_name AS name_x FROM part""")
def rename_and_swap(t):
    swapped = col("p_name").str.replace_all(r"(\w+) (\w+)", "${2} ${1}", regex=True)
    return t("part").select("p_partkey", "p_retailprice", "p_name", swapped.alias("swapped")).rename("p_retailprice", "price").rename("p_name", "name_x")


@query("""SELECT vec_id, embedding[1] AS head, embedding[-1] AS last, NULL::FLOAT AS out, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(list_avg(embedding::DOUBLE[]), 6) AS mean, list_min(embedding) AS low, list_max(embedding) AS high,
  list_reverse_sort(embedding)[1] AS top, list_contains(embedding, embedding[3]) AS has FROM embeddings""")
def lists(t):
    e = col("embedding").list
    return t("embeddings").select("vec_id", e.first().alias("head"), e.get(-1).alias("last"), e.get(500).alias("out"), e.len().alias("n"), e.sum().round(4).alias("total"), e.mean().round(6).alias("mean"), e.min().alias("low"), e.max().alias("high"), e.sort(descending=True).list.first().alias("top"), e.contains(e.get(2)).alias("has"))


@query("SELECT s_suppkey AS key, s_name AS title, '{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\"}' AS json, array_to_string([s_name, NULL, 'x'], '-') AS joined FROM supplier")
def structs(t):
    from pyspark.sql import functions as F

    s = as_struct("s_suppkey", "s_name")
    named = s.struct.rename_fields(["key", "title"])
    many = as_struct("s_name").map(lambda c: F.array(c["s_name"], F.lit(None), F.lit("x")))
    return t("supplier").select(named.struct.field("key"), named.struct.field(1), s.struct.json_encode().alias("json"), many.list.join("-").alias("joined"))


@query("SELECT event_id, coalesce(TRY_CAST(x AS BIGINT), -1) AS n, x IS NULL AS none, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS level FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR WHEN event_id % 3 = 1 THEN 'bad' END AS x FROM events)")
def casts(t):
    k = col("event_id")
    e = t("events").with_columns(if_else(k % 3 == 0, k.cast("string"), if_else(k % 3 == 1, lit("bad"), None)).alias("x"))
    return e.select("event_id", col("x").cast("long").fill_null(-1).alias("n"), col("x").is_null().alias("none"), if_else(col("value") > 50, lit("high"), lit("low")).alias("level"))


@query("SELECT event_id, value FROM events WHERE props IS NOT NULL AND value IS NOT NULL")
def drop_nulls(t):
    return t("events").drop_nulls("props", "value").select("event_id", "value")


# selectors


@query("SELECT o_orderkey * 2 AS o_orderkey_x2, o_custkey * 2 AS o_custkey_x2 FROM orders")
def selector_names(t):
    return t("orders").select(((ends_with("key") * 2).name.suffix("_x2")))


@query("SELECT l_quantity, l_extendedprice, l_discount FROM lineitem")
def selector_sets(t):
    from pyspark.sql import types as T

    return t("lineitem").select((by_dtype(T.DoubleType) & numeric()) - matches("tax$"))


@query("SELECT p_name AS x_p_name, p_brand AS x_p_brand, p_type AS x_p_type FROM part")
def selector_types(t):
    from pyspark.sql import types as T

    return t("part").select((by_dtype(T.StringType) | starts_with("zzz")).name.prefix("x_"))


@query("SELECT n_nationkey, n_name FROM nation")
def selector_exclude(t):
    return t("nation").select((~matches("regionkey")))


# UDFs, SQL, sources and sinks


@query("SELECT o_orderkey, o_orderkey * 2 AS twice, 'hi ' || o_orderstatus AS hi FROM orders")
def udfs(t):
    return t("orders").select("o_orderkey", map_batches(col("o_orderkey"), lambda s: s * 2).alias("twice"), map_values(col("o_orderstatus"), lambda s: "hi " + s).alias("hi"))


_TEXT = "SELECT o_orderpriority, sum(o_totalprice) AS total, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority"


@query(f"SELECT o_orderpriority, round(total, 2) AS total, n FROM ({_TEXT})")
def sql_text(t):
    return SqlContext().register("orders", t("orders")).execute(_TEXT + " ORDER BY total DESC").with_columns(col("total").round(2))


@query("SELECT count(*) AS n, sum(s_suppkey)::BIGINT AS k, round(sum(s_acctbal), 2) AS b FROM supplier")
def csv_round_trip(t):
    at = scratch()
    sources.write_csv(t("supplier"), at)
    return sources.read_csv(at).select(length().alias("n"), col("s_suppkey").cast("long").sum().alias("k"), col("s_acctbal").sum().round(2).alias("b"))


@query("SELECT c_custkey, c_name FROM customer")
def json_round_trip(t):
    at = scratch()
    sources.write_json(t("customer").select("c_custkey", "c_name"), at)
    return sources.read_json(at).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer")
def ndjson_round_trip(t):
    at = scratch()
    sources.write_ndjson(t("customer").select("c_custkey", "c_name"), at)
    return sources.read_ndjson(at, "c_custkey long, c_name string")


@query("SELECT n_nationkey, n_name FROM nation")
def ipc_round_trip(t):
    at = scratch().removeprefix("file:").replace("///", "/")
    sources.write_ipc(t("nation").select("n_nationkey", "n_name"), at)
    return sources.read_ipc(at)


@query("SELECT * FROM region")
def parquet_round_trip(t):
    at = scratch()
    sources.write_parquet(t("region").select(all_columns()), at)
    return sources.read_parquet(at)


# series, and orders that groups keep


@query("SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS off, c_acctbal > 0 AS credit FROM customer")
def series_arithmetic(t):
    f = t("customer").ordered_by("c_custkey")
    balance = f.column("c_acctbal")
    off = balance - balance.mean()
    return from_series(f.column("c_custkey"), off.rename("off"), (balance > 0).rename("credit")).with_columns(col("off").round(4))


@query("""SELECT c.k AS c_custkey, s.k AS o_orderkey, c.k + s.k AS both FROM
  (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) c JOIN
  (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) s USING (n)""")
def series_of_two_frames(t):
    left = t("customer").ordered_by("c_custkey").column("c_custkey")
    right = t("orders").ordered_by("o_orderkey").column("o_orderkey").slice(0, len(left))
    return from_series(left, right, (left + right).rename("both"))


@query("""SELECT CASE WHEN s IS NULL THEN -1 ELSE s END AS s, count(*) AS n, count(s) AS some FROM
  (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 END AS s FROM orders) GROUP BY 1""")
def fill_nan_groups(t):
    key = if_else(col("o_orderkey") % 7 == 0, lit(float("nan")), (col("o_orderkey") % 5).cast("double"))
    f = t("orders").with_columns(key.alias("s")).with_columns(col("s").fill_nan(-1.0).alias("filled"), col("s").is_not_nan().alias("some"))
    return f.group_by(col("filled").cast("long").alias("s")).agg(length().alias("n"), col("some").sum().alias("some"))


@query("SELECT c_custkey, c_name AS name, c_nationkey AS nation FROM customer")
def unnest_struct(t):
    packed = as_struct(col("c_name").alias("name"), col("c_nationkey").alias("nation"))
    return t("customer").select("c_custkey", packed.alias("of")).unnest("of")


@query("SELECT o_orderpriority, min(o_orderkey) AS first_key, count(*) AS n FROM orders GROUP BY ALL ORDER BY first_key")
def group_stable(t):
    return t("orders").ordered_by("o_orderkey").group_by_stable("o_orderpriority").agg(col("o_orderkey").first().alias("first_key"), length().alias("n"))


@query("""SELECT o_orderkey, o_orderdate::TIMESTAMP + CASE o_orderkey % 4 WHEN 0 THEN INTERVAL 90 MINUTE WHEN 1 THEN INTERVAL '1 month' WHEN 2 THEN INTERVAL '-3 days'
  ELSE INTERVAL '5 milliseconds' END AS at FROM orders""")
def offset_by_rows(t):
    by = if_else(col("o_orderkey") % 4 == 0, lit("1h30m"), if_else(col("o_orderkey") % 4 == 1, lit("1mo"), if_else(col("o_orderkey") % 4 == 2, lit("-3d"), lit("5ms"))))
    return t("orders").select("o_orderkey", col("o_orderdate").dt.offset_by(by).alias("at"))
