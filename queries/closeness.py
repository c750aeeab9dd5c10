"""t-closeness and the independent verifier."""

from pyspark.sql import functions as F

from duskveil.operators.closeness import (
    class_distances,
    distribution,
    suppress_violations,
    total_variation,
    violating_classes,
)
from duskveil.operators.verify import check_k, check_l, check_t, frequency_distances, verify_release
from queries.registry import query, read


@query(
    "distribution_order_status",
    """SELECT value, round(p, 9) AS p FROM (SELECT o_orderstatus AS value,
       count(*)::double / sum(count(*)) OVER () AS p FROM orders
       WHERE o_orderstatus <> 'F' GROUP BY 1)""",
)
def distribution_order_status(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn(
        "o_orderstatus", F.when(F.col("o_orderstatus") == "F", "***").otherwise(F.col("o_orderstatus"))
    )
    return distribution(orders, "o_orderstatus").withColumn("p", F.round("p", 9))


@query(
    "total_variation_events",
    """WITH p AS (SELECT event_type AS v, count(*)::double / sum(count(*)) OVER () AS p FROM events GROUP BY 1),
       q AS (SELECT event_type AS v, count(*)::double / sum(count(*)) OVER () AS q FROM events
             WHERE value > 20 AND event_type <> 'click' GROUP BY 1)
       SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 9) AS tvd FROM p FULL JOIN q USING (v)""",
)
def total_variation_events(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    part = events.where("value > 20 and event_type <> 'click'")
    gap = total_variation(distribution(events, "event_type"), distribution(part, "event_type"))
    return gap.select(F.round("tvd", 9).alias("tvd"))


def distance_sql(table: str, quasi: str, sensitive: str) -> str:
    """(quasi, n, tvd) with a class without usable values at 0.5."""
    return f"""SELECT {quasi}, n, coalesce(tvd, 0.5) AS tvd FROM
        (SELECT {quasi}, count(*) AS n FROM {table} WHERE {quasi} IS NOT NULL GROUP BY {quasi})
        LEFT JOIN (SELECT {quasi}, sum(greatest(inside - everywhere, 0)) AS tvd FROM
            (SELECT {quasi}, {sensitive} AS v, count(*)::double / sum(count(*)) OVER (PARTITION BY {quasi}) AS inside
             FROM {table} WHERE {sensitive} <> '***' GROUP BY 1, 2)
            JOIN (SELECT {sensitive} AS v, count(*)::double / sum(count(*)) OVER () AS everywhere
                  FROM {table} WHERE {sensitive} <> '***' GROUP BY 1) USING (v) GROUP BY {quasi})
        USING ({quasi})"""


@query(
    "class_distances_customer",
    f"""SELECT c_nationkey, n, round(tvd, 9) AS tvd
        FROM ({distance_sql('customer', 'c_nationkey', 'c_mktsegment')})""",
)
def class_distances_customer(spark, sf_dir):
    found = class_distances(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")
    return found.withColumn("tvd", F.round("tvd", 9))


GAPS = """(SELECT event_id, nullif(user_id % 40, 7) AS q,
    CASE WHEN user_id % 40 = 9 THEN '***' WHEN user_id % 40 = 11 THEN NULL ELSE event_type END AS s,
    value FROM events)"""


def _with_gaps(spark, sf_dir):
    bucket = F.col("user_id") % 40
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.nullif(bucket, F.lit(7)).alias("q"),
        F.when(bucket == 9, "***").when(bucket == 11, None).otherwise(F.col("event_type")).alias("s"),
        "value",
    )


@query(
    "violating_classes_events",
    f"SELECT q, n, round(tvd, 9) AS tvd FROM ({distance_sql(GAPS, 'q', 's')}) WHERE tvd > 0.0667",
)
def violating_classes_events(spark, sf_dir):
    found = violating_classes(_with_gaps(spark, sf_dir), ["q"], "s", 0.0667)
    return found.withColumn("tvd", F.round("tvd", 9))


@query(
    "suppress_violations_events",
    f"""WITH bad AS (SELECT q FROM ({distance_sql(GAPS, 'q', 's')}) WHERE tvd > 0.0667)
        SELECT event_id, q, CASE WHEN q IN (SELECT q FROM bad) THEN '***' ELSE s END AS s, value FROM {GAPS}""",
)
def suppress_violations_events(spark, sf_dir):
    return suppress_violations(_with_gaps(spark, sf_dir), ["q"], "s", 0.0667, ["event_id"])


@query(
    "suppress_violations_customer",
    f"""WITH bad AS (SELECT c_nationkey FROM
            ({distance_sql('customer', 'c_nationkey', 'c_mktsegment')}) WHERE tvd > 0.1111)
        SELECT c_custkey, c_name, c_nationkey, c_acctbal,
            CASE WHEN c_nationkey IN (SELECT c_nationkey FROM bad) THEN '***' ELSE c_mktsegment END AS c_mktsegment
        FROM customer""",
)
def suppress_violations_customer(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    return suppress_violations(customer, ["c_nationkey"], "c_mktsegment", 0.1111, ["c_custkey"])


@query(
    "check_k_customer",
    """SELECT coalesce(min(n) >= 5, false) AS k_ok FROM
       (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)""",
)
def check_k_customer(spark, sf_dir):
    return check_k(read(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 5)


@query(
    "check_l_orders",
    """SELECT bool_and(n >= 400) AS l_ok FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders
       GROUP BY o_orderstatus, o_orderpriority)""",
)
def check_l_orders(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return check_l(orders, ["o_orderstatus", "o_orderpriority"], "o_custkey", 400)


def frequency_sql(table: str, quasi: str, sensitive: str) -> str:
    """(quasi, distance): mean difference of the two frequency lists, both in order."""
    return f"""WITH g AS (SELECT {sensitive} AS v, count(*)::double / sum(count(*)) OVER () AS p
            FROM {table} WHERE {sensitive} IS NOT NULL GROUP BY 1),
        c AS (SELECT {quasi} AS k, {sensitive} AS v, count(*)::double / sum(count(*)) OVER (PARTITION BY {quasi}) AS q
            FROM {table} WHERE {sensitive} IS NOT NULL AND {quasi} IS NOT NULL GROUP BY 1, 2),
        ks AS (SELECT DISTINCT {quasi} AS k FROM {table} WHERE {quasi} IS NOT NULL),
        both_lists AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY p) AS r, p,
            coalesce(q, 0) AS q FROM ks CROSS JOIN g LEFT JOIN c USING (k, v)),
        other AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY q) AS r, q FROM both_lists)
        SELECT b.k AS {quasi}, avg(abs(b.p - o.q)) AS distance
        FROM both_lists b JOIN other o ON b.k = o.k AND b.r = o.r GROUP BY b.k"""


@query(
    "frequency_distances_customer",
    f"""SELECT c_nationkey, round(distance, 9) AS distance
        FROM ({frequency_sql('customer', 'c_nationkey', 'c_mktsegment')})""",
)
def frequency_distances_customer(spark, sf_dir):
    found = frequency_distances(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")
    return found.withColumn("distance", F.round("distance", 9))


@query(
    "frequency_distances_many_values",
    f"""SELECT q, round(distance, 9) AS distance FROM ({frequency_sql(
        "(SELECT nullif(o_custkey % 60, 5) AS q, CASE WHEN o_custkey % 60 <> 8 THEN o_custkey END AS s FROM orders)",
        'q', 's')})""",
)
def frequency_distances_many_values(spark, sf_dir):
    bucket = F.col("o_custkey") % 60
    orders = read(spark, sf_dir, "orders").select(
        F.nullif(bucket, F.lit(5)).alias("q"), F.when(bucket != 8, F.col("o_custkey")).alias("s")
    )
    return frequency_distances(orders, ["q"], "s").withColumn("distance", F.round("distance", 9))


@query(
    "check_t_customer",
    f"""SELECT bool_and(distance <= 0.0712) AS t_ok
        FROM ({frequency_sql('customer', 'c_nationkey', 'c_mktsegment')})""",
)
def check_t_customer(spark, sf_dir):
    return check_t(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", 0.0712)


@query(
    "verify_release_customer",
    f"""SELECT (SELECT min(n) >= 4 FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)) AS k_ok,
        (SELECT bool_and(n >= 3) FROM (SELECT count(DISTINCT c_mktsegment) AS n FROM customer
         GROUP BY c_nationkey)) AS l_ok,
        (SELECT bool_and(distance <= 0.2) FROM
         ({frequency_sql('customer', 'c_nationkey', 'c_mktsegment')})) AS t_ok""",
)
def verify_release_customer(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").withColumnsRenamed({"c_nationkey": " C_NationKey "})
    return verify_release(customer, ["C_NATIONKEY", "absent"], "C_mktsegment ")
