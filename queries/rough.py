"""Cells that clean tables lack: null keys, not-a-number, long numbers, other date spellings."""

from pyspark.sql import functions as F

from duskveil.operators.closeness import suppress_violations_with_info
from duskveil.operators.context import mask_adjacent, mask_adjacent_consistently, mask_cyclic
from duskveil.operators.cover import cover_columns
from duskveil.operators.federated import client_rows, fit_average
from duskveil.operators.kanon import kanonymize, kanonymize_with_info
from duskveil.operators.perturb import laplace_noise, shift_dates
from duskveil.operators.profile import dataset_header
from duskveil.operators.secure import grouped_secure_sums, masked_contributions, secure_sum
from duskveil.operators.shape import (
    date_like_columns, drop_missing_numbers, expand_dates, sanitise_features,
)
from duskveil.plans.scratch import scratch_path
from duskveil.sources.tables import read_csv, read_table, write_csv
from queries.registry import query, read

#: One row of each table loses its key.
_KEYS = {
    "microaggregate": lambda df: kanonymize(df, ["p_size"], 5, ["p_partkey"]),
    "mondrian": lambda df: kanonymize(df, ["p_size"], 5, ["p_partkey"], "mondrian"),
    "adjacent": lambda df: mask_adjacent(df, ["p_brand"], 2, ["p_partkey"]),
    "consistent": lambda df: mask_adjacent_consistently(df, ["p_brand"], 2, ["p_partkey"]),
    "cyclic": lambda df: mask_cyclic(df, ["p_brand"], 2, ["p_partkey"]),
    "cover": lambda df: cover_columns(df, ["p_brand"], 2, ["p_partkey"]),
}


@query(
    "null_keys_keep_rows",
    f"""SELECT unnest([{", ".join(f"'{n}'" for n in _KEYS)}]) AS operator, count(*) AS rows,
        count(nullif(p_partkey, 3)) AS keys, sum(p_retailprice::decimal(18, 2))::double AS prices FROM part""",
)
def null_keys_keep_rows(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(
        F.nullif("p_partkey", F.lit(3)).alias("p_partkey"), "p_size", "p_brand",
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
    )
    out = None
    for name, operator in _KEYS.items():
        line = operator(part).agg(
            F.lit(name).alias("operator"), F.count("*").alias("rows"),
            F.count("p_partkey").alias("keys"), F.sum("price").cast("double").alias("prices"),
        )
        out = line if out is None else out.unionByName(line)
    return out


def _with_nan(spark, sf_dir):
    price = F.when(F.col("p_size") == 7, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", price.alias("price"))


_GAP = "(SELECT p_partkey, p_size, CASE WHEN p_size <> 7 THEN p_retailprice END AS price FROM part)"


@query("drop_missing_nan", f"SELECT * FROM {_GAP} WHERE price IS NOT NULL")
def drop_missing_nan(spark, sf_dir):
    return drop_missing_numbers(_with_nan(spark, sf_dir), "price")


@query("laplace_noise_nan", f"SELECT count(price) AS finite_cells, count(*) AS rows FROM {_GAP}")
def laplace_noise_nan(spark, sf_dir):
    noisy = laplace_noise(_with_nan(spark, sf_dir), {"price": 1.0}, ["p_partkey"], 5)
    return noisy.agg(
        F.count_if(F.abs("price") < float("inf")).alias("finite_cells"), F.count("*").alias("rows")
    )


@query("secure_sum_nan", f"SELECT count(price) AS parties, round(sum(price), 4) AS total FROM {_GAP}")
def secure_sum_nan(spark, sf_dir):
    parties = masked_contributions(_with_nan(spark, sf_dir), "price", ["p_partkey"], 5)
    return secure_sum(parties, 5).select("parties", F.round("recovered_sum", 4).alias("total"))


@query(
    "secure_sum_by_size",
    "SELECT p_size, count(*) AS parties, round(sum(p_retailprice), 4) AS total FROM part GROUP BY p_size HAVING count(*) > 1",
)
def secure_sum_by_size(spark, sf_dir):
    sums = grouped_secure_sums(read(spark, sf_dir, "part"), "p_retailprice", ["p_size"], ["p_partkey"], 5)
    return sums.select("p_size", "parties", F.round("recovered_sum", 4).alias("total"))


@query(
    "sanitise_features_nan",
    f"SELECT p_partkey::double AS p_partkey, p_size::double AS p_size, round(coalesce(price, avg(price) OVER ()), 6) AS price FROM {_GAP}",
)
def sanitise_features_nan(spark, sf_dir):
    done = sanitise_features(_with_nan(spark, sf_dir), ["p_partkey"])
    return done.withColumn("price", F.round("price", 6))


@query(
    "kanonymize_nan",
    f"""SELECT unnest(['micro', 'mondrian']) AS strategy, count(*) AS rows, true AS k_reached FROM {_GAP}""",
)
def kanonymize_nan(spark, sf_dir):
    out = None
    for strategy in ("micro", "mondrian"):
        done = kanonymize(_with_nan(spark, sf_dir), ["price"], 5, ["p_partkey"], strategy)
        line = done.groupBy("price").agg(F.count("*").alias("n")).agg(
            F.lit(strategy).alias("strategy"), F.sum("n").alias("rows"),
            ((F.min("n") >= 5) & ~F.bool_or(F.col("price").contains("NaN"))).alias("k_reached"),
        )
        out = line if out is None else out.unionByName(line)
    return out


@query(
    "fit_clients_nan",
    f"""SELECT row_number() OVER (ORDER BY f)::int AS client, n AS rows, round(my - n * r / (n + 1) * sy * mx / sx, 3) AS intercept,
        round(n * r / (n + 1) * sy / sx, 5) AS slope FROM (
          SELECT min(p_partkey) AS f, count(*) AS n, avg(p_partkey) AS my, avg(x) AS mx, stddev_pop(x) AS sx,
            stddev_pop(p_partkey) AS sy, corr(x, p_partkey) AS r
          FROM (SELECT p_partkey, p_partkey % 3 AS g, coalesce(price, avg(price) OVER (PARTITION BY p_partkey % 3)) AS x FROM {_GAP})
          GROUP BY g)""",
)
def fit_clients_nan(spark, sf_dir):
    part = _with_nan(spark, sf_dir).select((F.col("p_partkey") % 3).cast("string").alias("g"), "p_partkey", "price")
    models, _ = fit_average(part, "g", "p_partkey", ["p_partkey"], 3)
    rows, _ = client_rows(part, "g", "p_partkey", ["p_partkey"], 3)
    counts = rows.groupBy("client").agg(F.count("*").alias("rows"))
    return models.join(counts, "client").select(
        F.col("client").cast("int").alias("client"), "rows", F.round("intercept", 3).alias("intercept"),
        F.round(F.col("coefficients")["price"], 5).alias("slope"),
    )


@query("csv_round_trip_long_numbers", "SELECT 1234567890123456789 - c_custkey AS id, c_name FROM customer")
def csv_round_trip_long_numbers(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select(
        (F.lit(1234567890123456789) - F.col("c_custkey")).alias("id"), "c_name"
    )
    return read_csv(spark, write_csv(customer, scratch_path(spark)))


@query("csv_given_schema", "SELECT c_custkey::int AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS balance FROM customer")
def csv_given_schema(spark, sf_dir):
    balance = F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("string")).otherwise("NA")
    path = write_csv(read(spark, sf_dir, "customer").select("c_custkey", balance.alias("balance")), scratch_path(spark))
    return read_csv(spark, path, schema="c_custkey int, balance double")


#: Four spellings of the order date.
_SPELT = {"us": "MM/dd/yyyy", "eu": "dd/MM/yyyy", "dotted": "d.M.yyyy", "words": "d MMM yyyy"}


def _spelt(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", *[F.date_format("o_orderdate", f).alias(c) for c, f in _SPELT.items()], "o_orderstatus"
    )


_DAYS = ", ".join(f"o_orderdate::date AS {c}" for c in _SPELT)


@query("shift_spelt_dates", f"SELECT o_orderkey, {_DAYS} FROM orders")
def shift_spelt_dates(spark, sf_dir):
    return shift_dates(_spelt(spark, sf_dir), "o_orderkey", list(_SPELT), 0, 3, drop_time=True).drop("o_orderstatus")


@query(
    "date_like_spelt",
    f"SELECT unnest([{', '.join(repr(c) for c in _SPELT)}]) AS column_name FROM (SELECT count(o_orderdate) AS n FROM orders) WHERE n > 0",
)
def date_like_spelt(spark, sf_dir):
    return date_like_columns(_spelt(spark, sf_dir))


@query(
    "expand_spelt_dates",
    "SELECT o_orderkey, o_orderstatus, "
    + ", ".join(f"{part}(o_orderdate)::int AS {c}_{part}" for c in _SPELT for part in ("year", "month", "day"))
    + " FROM orders",
)
def expand_spelt_dates(spark, sf_dir):
    return expand_dates(_spelt(spark, sf_dir))


@query(
    "sanitise_spelt_dates",
    "SELECT o_orderkey::double AS o_orderkey, (date_diff('day', date '0001-01-01', o_orderdate::date) + 1)::double AS admit_ord, "
    "(date_diff('day', date '0001-01-01', o_orderdate::date) + 1)::double AS disch_ord, 0::double AS los_days FROM orders",
)
def sanitise_spelt_dates(spark, sf_dir):
    return sanitise_features(_spelt(spark, sf_dir).select("o_orderkey", "us", "eu"), ["o_orderkey"], date_pair=("us", "eu"))


@query("csv_spelt_dates", "SELECT o_orderkey, o_orderdate::date::timestamp AS order_date FROM orders")
def csv_spelt_dates(spark, sf_dir):
    orders = _spelt(spark, sf_dir).select("o_orderkey", F.col("us").alias("order_date"))
    return read_table(spark, write_csv(orders, scratch_path(spark) + ".csv"), ["o_orderkey", "order_date"])


@query(
    "header_after_kanonymity",
    "SELECT count(*) AS num_rows, 8 AS num_columns, true AS k_anonymized, false AS l_diversity, 5::bigint AS k_value, NULL::bigint AS l_value FROM customer",
)
def header_after_kanonymity(spark, sf_dir):
    table, info = kanonymize_with_info(
        read(spark, sf_dir, "customer").withColumn("one", F.lit(1)), ["c_acctbal", "c_nationkey"], 5, ["c_custkey"], keep_backup=True
    )
    return dataset_header(table, info)


@query(
    "closeness_info",
    "SELECT 0.2::double AS t, 'c_nationkey' AS t_columns, 'c_mktsegment' AS sensitive, count(*) AS rows FROM customer",
)
def closeness_info(spark, sf_dir):
    table, info = suppress_violations_with_info(
        read(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", 0.2, ["c_custkey"]
    )
    return table.agg(
        F.lit(info.t).alias("t"), F.lit(",".join(info.t_columns)).alias("t_columns"),
        F.lit(info.sensitive).alias("sensitive"), F.count("*").alias("rows"),
    )
