"""Ridge models per client, their average and its predictions."""

from pyspark.sql import functions as F

from duskveil.operators.federated import (
    apply_model,
    average_models,
    client_rows,
    coefficient_matrix,
    federated_regression,
    fit_average,
    fit_clients,
)
from duskveil.operators.relations import analyse
from queries.registry import query, read


def one_feature_sql(table: str, group: str, x: str, y: str, clients: int) -> str:
    """(client, g, slope, intercept): ridge with one varying standardised feature."""
    return f"""SELECT row_number() OVER (ORDER BY {group}) AS client, {group} AS g, slope,
            my - slope * mx AS intercept FROM
        (SELECT {group}, avg({x}) AS mx, avg({y}) AS my,
            count(*) * covar_pop({x}, {y}) / (var_pop({x}) * (count(*) + 1)) AS slope
         FROM {table} GROUP BY {group} ORDER BY {group} LIMIT {clients})"""


@query(
    "client_rows_lineitem",
    """SELECT cast(client AS int) AS client, rows, l_linenumber::double AS l_linenumber, l_quantity, l_extendedprice
       FROM lineitem JOIN (SELECT l_linenumber, count(*) AS rows,
           row_number() OVER (ORDER BY min(l_extendedprice)) AS client FROM lineitem GROUP BY 1) USING (l_linenumber)
       WHERE client <= 3""",
)
def client_rows_lineitem(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice")
    rows, _ = client_rows(lines, "l_linenumber", "l_quantity", ["l_extendedprice"], 3)
    return rows


@query(
    "fit_clients_suppliers",
    f"""SELECT cast(client AS int) AS client, round(intercept, 4) AS intercept, round(slope, 6) AS slope,
        0.0::double AS group_slope FROM ({one_feature_sql('lineitem', 'l_suppkey', 'l_quantity', 'l_extendedprice', 1000)})""",
)
def fit_clients_suppliers(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    rows, features = client_rows(lines, "l_suppkey", "l_extendedprice", ["l_suppkey"], 1000)
    models = fit_clients(rows, features, "l_extendedprice")
    return models.select(
        "client",
        F.round("intercept", 4).alias("intercept"),
        F.round(F.col("coefficients")["l_quantity"], 6).alias("slope"),
        F.col("coefficients")["l_suppkey"].alias("group_slope"),
    )


TWO = """SELECT l_linenumber, n, my, mx, mz, sx, sz,
        ((n + 1) * n * cxy / sx - n * r * n * czy / sz) / ((n + 1) * (n + 1) - n * r * n * r) / sx AS a,
        ((n + 1) * n * czy / sz - n * r * n * cxy / sx) / ((n + 1) * (n + 1) - n * r * n * r) / sz AS b FROM
    (SELECT l_linenumber, count(*)::double AS n, avg(l_quantity) AS mx, avg(l_discount) AS mz,
        avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS sx, stddev_pop(l_discount) AS sz,
        corr(l_quantity, l_discount) AS r, covar_pop(l_quantity, l_extendedprice) AS cxy,
        covar_pop(l_discount, l_extendedprice) AS czy
     FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 4)"""


def _two(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"
    )


@query(
    "average_models_lineitem",
    f"""SELECT round(avg(my - a * mx - b * mz), 4) AS intercept, round(avg(a), 5) AS quantity,
        round(avg(b), 4) AS discount FROM ({TWO})""",
)
def average_models_lineitem(spark, sf_dir):
    rows, features = client_rows(_two(spark, sf_dir), "l_linenumber", "l_extendedprice", ["l_linenumber"])
    model = average_models(fit_clients(rows, features, "l_extendedprice"))
    return model.select(
        F.round("intercept", 4).alias("intercept"),
        F.round(F.col("coefficients")["l_quantity"], 5).alias("quantity"),
        F.round(F.col("coefficients")["l_discount"], 4).alias("discount"),
    )


@query(
    "coefficient_matrix_lineitem",
    f"""WITH m AS (SELECT l_linenumber, a, b FROM ({TWO})),
        long AS (SELECT l_linenumber, 'l_quantity' AS feature, a AS w FROM m
            UNION ALL SELECT l_linenumber, 'l_discount', b FROM m
            UNION ALL SELECT l_linenumber, 'l_linenumber', 0 FROM m)
        SELECT feature, round(max(w) FILTER (l_linenumber = 1), 4) AS client_1,
            round(max(w) FILTER (l_linenumber = 2), 4) AS client_2,
            round(max(w) FILTER (l_linenumber = 3), 4) AS client_3,
            round(max(w) FILTER (l_linenumber = 4), 4) AS client_4 FROM long GROUP BY feature""",
)
def coefficient_matrix_lineitem(spark, sf_dir):
    rows, features = client_rows(_two(spark, sf_dir), "l_linenumber", "l_extendedprice", ["l_linenumber"])
    table = coefficient_matrix(fit_clients(rows, features, "l_extendedprice"))
    return table.select(
        "feature", *[F.round(f"client_{i}", 4).alias(f"client_{i}") for i in range(1, 5)]
    )


@query(
    "apply_model_lineitem",
    f"""WITH m AS (SELECT avg(my - a * mx - b * mz) AS i, avg(a) AS a, avg(b) AS b FROM ({TWO}))
        SELECT l_linenumber, l_quantity, l_discount, round(i + a * l_quantity + b * l_discount, 3) AS l_extendedprice
        FROM lineitem, m""",
)
def apply_model_lineitem(spark, sf_dir):
    lines = _two(spark, sf_dir)
    _, model = fit_average(lines, "l_linenumber", "l_extendedprice", ["l_linenumber"])
    guessed = apply_model(lines, model, "l_extendedprice")
    return guessed.withColumn("l_extendedprice", F.round("l_extendedprice", 3))


@query(
    "federated_regression_numeric",
    f"""WITH m AS (SELECT avg(intercept) AS i, avg(slope) AS s FROM
            ({one_feature_sql('customer', 'c_nationkey', "(c_custkey % 97)", 'c_acctbal', 6)}))
        SELECT c_nationkey, c_custkey % 97 AS score, round(i + s * (c_custkey % 97), 4) AS c_acctbal FROM customer, m""",
)
def federated_regression_numeric(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select(
        "c_name", "c_nationkey", (F.col("c_custkey") % 97).alias("score"), "c_acctbal"
    )
    done = federated_regression(customer, "numeric", "c_nationkey", "c_acctbal", ["c_nationkey"], 6)
    return done.withColumn("c_acctbal", F.round("c_acctbal", 4))


@query(
    "federated_regression_dates",
    """SELECT count(*) AS rows, count(DISTINCT year(o_orderdate)) AS years,
       count(DISTINCT month(o_orderdate))::int AS months, abs(avg(o_totalprice) / 250000 - 1) < 0.1 AS near_mean FROM orders""",
)
def federated_regression_dates(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.length("o_orderpriority").alias("size"),
        F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"), "o_totalprice",
    )
    done = federated_regression(orders, "date", "size", "o_totalprice", ["o_orderkey"], 5)
    return done.agg(
        F.count("*").alias("rows"),
        F.countDistinct("o_orderdate_year").alias("years"),
        F.countDistinct("o_orderdate_month").cast("int").alias("months"),
        (F.abs(F.avg("o_totalprice") / F.lit(250_000.0) - 1) < 0.1).alias("near_mean"),
    )


@query(
    "analyse_lineitem",
    f"""WITH m AS (SELECT avg(my - a * mx - b * mz) AS i, avg(a) AS a, avg(b) AS b FROM ({TWO}))
        SELECT round(avg(i + a * l_quantity + b * l_discount), 3) AS mean_prediction,
            round(4 + 2 * (corr(l_linenumber, l_quantity) + corr(l_linenumber, l_discount) + corr(l_linenumber, l_extendedprice)
              + corr(l_quantity, l_discount) + corr(l_quantity, l_extendedprice) + corr(l_discount, l_extendedprice)), 6) AS correlations,
            (SELECT count(*) FROM (DESCRIBE SELECT l_linenumber, l_quantity, l_discount, l_extendedprice FROM lineitem)) AS r2_rows,
            round(greatest(abs(corr(l_quantity, l_extendedprice)), abs(corr(l_quantity, l_discount)), abs(corr(l_linenumber, l_quantity)),
              abs(corr(l_linenumber, l_discount)), abs(corr(l_linenumber, l_extendedprice)), abs(corr(l_discount, l_extendedprice))), 3)
              AS top_correlation FROM lineitem, m""",
)
def analyse_lineitem(spark, sf_dir):
    found = analyse(_two(spark, sf_dir), "l_linenumber", "l_extendedprice", ["l_linenumber"])
    return found.predictions.agg(
        F.round(F.avg("l_extendedprice"), 3).alias("mean_prediction"),
        found.correlations.agg(F.round(F.sum("corr"), 6)).scalar().alias("correlations"),
        found.r2.agg(F.count("*")).scalar().alias("r2_rows"),
        found.top.where(~F.col("predictors").contains(","))
        .agg(F.max(F.abs("value"))).scalar().alias("top_correlation"),
    )
