"""Projections, filters, ordering and date features."""

from pyspark.sql import functions as F

from duskveil.operators.shape import (
    date_like_columns,
    drop_missing_numbers,
    expand_dates,
    filter_rows,
    numeric_columns,
    preview,
    rename_columns,
    sanitise_features,
    select_columns,
    sort_rows,
    tidy_names,
    transform_table,
)
from queries.anonymity import LINE_KEY
from queries.registry import query, read


@query("select_columns_orders", "SELECT o_orderkey, o_totalprice FROM orders")
def select_columns_orders(spark, sf_dir):
    return select_columns(read(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"])


@query("rename_columns_region", "SELECT r_regionkey AS id, r_name AS region FROM region")
def rename_columns_region(spark, sf_dir):
    return rename_columns(read(spark, sf_dir, "region"), {"r_regionkey": "id", "r_name": "region"})


@query(
    "filter_rows_orders",
    "SELECT * FROM orders WHERE o_totalprice > 300000 AND nullif(o_orderstatus, 'P') <> 'F'",
)
def filter_rows_orders(spark, sf_dir):
    return filter_rows(
        read(spark, sf_dir, "orders"),
        lambda t: (t.o_totalprice > 300000) & (F.nullif(t.o_orderstatus, F.lit("P")) != "F"),
    )


@query(
    "transform_table_lineitem",
    "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem",
)
def transform_table_lineitem(spark, sf_dir):
    return transform_table(
        read(spark, sf_dir, "lineitem"),
        lambda t: t.select("l_orderkey", (t.l_extendedprice * (1 - t.l_discount)).alias("revenue")),
        check_rows=True,
    )


@query("sort_rows_customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST")
def sort_rows_customer(spark, sf_dir):
    return sort_rows(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", False)


@query("preview_lineitem", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100")
def preview_lineitem(spark, sf_dir):
    return preview(read(spark, sf_dir, "lineitem"), LINE_KEY[:4])


@query("numeric_columns_customer", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def numeric_columns_customer(spark, sf_dir):
    return numeric_columns(read(spark, sf_dir, "customer"))


@query("tidy_names_nation", "SELECT n_nationkey, n_name AS nation, n_regionkey FROM nation")
def tidy_names_nation(spark, sf_dir):
    return tidy_names(read(spark, sf_dir, "nation").withColumnRenamed("n_name", " NATION "))


@query("drop_missing_numbers_part", "SELECT p_partkey, p_size FROM part WHERE p_size <> 3")
def drop_missing_numbers_part(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(3)).alias("p_size"))
    return drop_missing_numbers(part, "p_size")


@query(
    "date_like_columns_events",
    """SELECT column_name FROM (
         SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props', 'ts_text']) AS column_name,
           unnest([false, bool_and(ts IS NOT NULL), false, bool_and(try_cast(event_type AS timestamp) IS NOT NULL), false,
             bool_and(try_cast(props AS timestamp) IS NOT NULL), bool_and(try_cast(ts::varchar AS timestamp) IS NOT NULL)]) AS dated
         FROM events) WHERE dated""",
)
def date_like_columns_events(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("ts_text", F.col("ts").cast("string"))
    return date_like_columns(events)


@query(
    "expand_dates_orders",
    """SELECT o_orderkey, o_orderstatus, year(o_orderdate)::int AS o_orderdate_year,
       month(o_orderdate)::int AS o_orderdate_month, day(o_orderdate)::int AS o_orderdate_day,
       year(o_orderdate)::int AS text_year, month(o_orderdate)::int AS text_month, day(o_orderdate)::int AS text_day
       FROM orders""",
)
def expand_dates_orders(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate",
        F.col("o_orderdate").cast("date").cast("string").alias("text"),
    )
    return expand_dates(orders)


@query(
    "sanitise_features_stays",
    """SELECT l_linenumber::double AS l_linenumber, round(coalesce(q, avg(q) OVER w), 6) AS q,
       round(coalesce(a, avg(a) OVER w), 6) AS admit_ord, d AS disch_ord,
       round(coalesce(d - a, avg(d - a) OVER w), 6) AS los_days
       FROM (SELECT l_linenumber, CASE WHEN l_quantity <> 10 THEN l_quantity END AS q,
           CASE WHEN l_tax <> 0.04 THEN date_diff('day', date '0001-01-01', l_shipdate::date) + 1 END::double AS a,
           (date_diff('day', date '0001-01-01', l_shipdate::date) + 1 + l_quantity)::double AS d FROM lineitem)
       WINDOW w AS (PARTITION BY l_linenumber)""",
)
def sanitise_features_stays(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    stays = lines.select(
        "l_linenumber",
        F.when(F.col("l_quantity") != 10, F.col("l_quantity")).alias("q"),
        F.when(F.col("l_tax") != 0.04, day.cast("string")).alias("came"),
        F.date_add(day, F.col("l_quantity").cast("int")).alias("left"),
        F.col("l_returnflag"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in LINE_KEY]).alias("row"),
    )
    done = sanitise_features(stays, ["row"], "l_linenumber", ("came", "left"))
    return done.withColumns({c: F.round(c, 6) for c in ("q", "admit_ord", "los_days")})
