"""Noise, gated release, date shifts and secure sums. The draws are keyed
hashes, so SQL checks what must hold of them rather than their values."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from duskveil.operators.perturb import laplace_noise, lock_down, release, shift_dates
from duskveil.operators.secure import masked_contributions, secure_sum
from queries.anonymity import LINE_KEY
from queries.registry import query, read

SEED = "a secret of the data owner"


@query(
    "laplace_noise_lineitem",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax, true AS noised, true AS near
       FROM lineitem""",
)
def laplace_noise_lineitem(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_quantity", "l_tax")
    noisy = laplace_noise(
        lines.withColumn("was", F.col("l_quantity")),
        {"l_quantity": 2.0, "absent": 1.0},
        LINE_KEY,
        SEED,
    )
    gap = F.abs(F.col("l_quantity") - F.col("was"))
    # 49 / 2 is the scale; no draw of 52 bits reaches 37 scales
    return noisy.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax",
        (gap > 0).alias("noised"), (gap < 37 * 49 / 2.0).alias("near"),
    )


@query(
    "laplace_noise_moments",
    "SELECT count(*) AS n, true AS centred, true AS spread_fits FROM lineitem",
)
def laplace_noise_moments(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(*LINE_KEY, F.lit(0.0).alias("x"))
    noisy = laplace_noise(lines, {"x": 0.5}, LINE_KEY, SEED, bounds={"x": (0.0, 1.0)})
    error = F.lit(6.0) * 2 * F.sqrt(F.lit(2.0)) / F.sqrt(F.count("*"))
    return noisy.agg(
        F.count("*").alias("n"),
        (F.abs(F.avg("x")) < error).alias("centred"),
        (F.abs(F.avg(F.abs("x")) - 2.0) < error).alias("spread_fits"),
    )


@query(
    "lock_down_customer",
    """SELECT count(*) AS n, true AS text_gone, true AS numbers_moved FROM customer""",
)
def lock_down_customer(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    locked = lock_down(customer.withColumn("was", F.col("c_acctbal").cast("string")), ["c_custkey"], SEED)
    return locked.agg(
        F.count("*").alias("n"),
        F.bool_and((F.col("c_name") == "***") & (F.col("c_mktsegment") == "***")).alias("text_gone"),
        (F.stddev_samp("c_acctbal") > 1e5).alias("numbers_moved"),
    )


@query("release_authorised", "SELECT * FROM supplier")
def release_authorised(spark, sf_dir):
    return release(read(spark, sf_dir, "supplier"), True, ["s_suppkey"], SEED)


@query(
    "release_unauthorised",
    "SELECT '***' AS s_name, count(*) AS n, true AS moved FROM supplier GROUP BY 1",
)
def release_unauthorised(spark, sf_dir):
    given = release(read(spark, sf_dir, "supplier"), False, ["s_suppkey"], SEED)
    return given.groupBy("s_name").agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("s_acctbal") != F.round("s_acctbal", 2)).alias("moved"),
    )


@query(
    "shift_dates_orders",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
       date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
                 o_orderdate) AS gap, true AS in_range FROM orders""",
)
def shift_dates_orders(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("was", F.col("o_orderdate"))
    moved = shift_dates(orders, "o_custkey", ["o_orderdate", "absent"], 45, SEED)
    subject = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return moved.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.datediff("o_orderdate", F.lag("o_orderdate").over(subject)).cast("bigint").alias("gap"),
        (F.abs(F.datediff("o_orderdate", "was")) <= 45).alias("in_range"),
    )


@query(
    "shift_dates_events_text",
    """SELECT event_id, user_id % 50 = 3 OR event_id % 9 = 0 AS missing, true AS time_kept FROM events""",
)
def shift_dates_events_text(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("user_id") % 50 != 3, F.col("user_id")).alias("subject"),
        "ts",
        F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("string")).otherwise("junk").alias("at"),
    )
    moved = shift_dates(events, "subject", ["at"], 20, SEED)
    days = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("at")) % 86_400_000_000
    return moved.select(
        "event_id", F.col("at").isNull().alias("missing"), (F.coalesce(days, F.lit(0)) == 0).alias("time_kept")
    )


@query(
    "masked_contributions_customer",
    """SELECT row_number() OVER (ORDER BY c_custkey) AS party_id, c_acctbal AS private_value,
       true AS ring_closed, true AS adds_up, true AS in_range FROM customer WHERE c_acctbal > 0""",
)
def masked_contributions_customer(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").withColumn(
        "c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    )
    parties = masked_contributions(customer, "c_acctbal", ["c_custkey"], SEED, 25.0)
    received = parties.select(
        (F.col("party_id") + 1).alias("party_id"), F.col("outgoing_mask").alias("sent")
    )
    off = F.col("masked_contribution") - (
        F.col("private_value") + F.col("outgoing_mask") - F.col("incoming_mask")
    )
    return parties.join(received, "party_id", "left").select(
        "party_id",
        "private_value",
        F.coalesce(F.col("sent") == F.col("incoming_mask"), F.lit(True)).alias("ring_closed"),
        (F.abs(off) < 1e-9).alias("adds_up"),
        (F.abs("outgoing_mask") < 25).alias("in_range"),
    )


@query(
    "secure_sum_lineitem",
    """SELECT count(*) AS parties, round(sum(l_quantity), 2) AS recovered_sum,
       round(sum(l_quantity), 2) AS actual_sum, true AS hidden FROM lineitem""",
)
def secure_sum_lineitem(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_quantity")
    sums = secure_sum(masked_contributions(lines, "l_quantity", LINE_KEY, SEED), SEED)
    return sums.select(
        "parties",
        F.round("recovered_sum", 2).alias("recovered_sum"),
        F.round("actual_sum", 2).alias("actual_sum"),
        (F.col("masked_sum") != F.col("actual_sum")).alias("hidden"),
    )
