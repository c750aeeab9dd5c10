"""Correlations, R² and the strongest relationships."""

from itertools import combinations, permutations

from pyspark.sql import functions as F

from duskveil.operators.relations import (
    best_relationships,
    correlation_matrix,
    r2_on_all_others,
    search_relationships,
    top_relationships,
)
from queries.registry import query, read

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GAPPED = """(SELECT CASE WHEN l_quantity > 3 THEN l_quantity END AS l_quantity,
    CASE WHEN l_discount <> 0.02 THEN l_discount END AS l_discount,
    l_extendedprice + 900 * l_quantity AS l_extendedprice, l_tax, 5 AS flat FROM lineitem)"""


def _gapped(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_discount") != 0.02, F.col("l_discount")).alias("l_discount"),
        (F.col("l_extendedprice") + 900 * F.col("l_quantity")).alias("l_extendedprice"),
        "l_tax",
        F.lit(5).alias("flat"),
    )


def _safe(expression: str) -> str:
    return f"CASE WHEN isnan({expression}) THEN NULL ELSE {expression} END"


def _matrix_sql(table: str, columns: list[str]) -> str:
    lines = [
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
        + f"round(coalesce({_safe(f'corr({a}, {b})')}, 0), 9) AS corr FROM {table}"
        for a in columns
        for b in columns
    ]
    return " UNION ALL ".join(lines)


def _pair_r2(table: str, target: str, a: str, b: str, where: str = "true") -> str:
    """R² of target on two predictors, from the three correlations."""
    return f"""(SELECT (x * x + y * y - 2 * x * y * z) / (1 - z * z) FROM
        (SELECT corr({target}, {a}) AS x, corr({target}, {b}) AS y, corr({a}, {b}) AS z
         FROM {table} WHERE {where}))"""


def _relations_sql(table: str, columns: list[str]) -> str:
    """(t, target, size, p, predictors, metric, value) on complete rows."""
    lines = []
    for t, target in enumerate(columns):
        others = [(i, c) for i, c in enumerate(columns) if i != t]
        for i, c in others:
            lines.append(
                f"SELECT {t} AS t, '{target}' AS target, 1 AS size, [{i}] AS p, '{c}' AS predictors,"
                f" 'corr' AS metric, (SELECT corr({target}, {c}) FROM {table}) AS value"
            )
        for (i, a), (j, b) in combinations(others, 2):
            full = f"{target} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL"
            lines.append(
                f"SELECT {t}, '{target}', 2, [{i}, {j}], '{a}, {b}', 'R2',"
                f" {_pair_r2(table, target, a, b, full)}"
            )
    return " UNION ALL ".join(lines)


@query("correlation_matrix_lineitem", _matrix_sql("lineitem", NUMBERS))
def correlation_matrix_lineitem(spark, sf_dir):
    found = correlation_matrix(read(spark, sf_dir, "lineitem"), NUMBERS)
    return found.withColumn("corr", F.round("corr", 9))


@query("correlation_matrix_missing", _matrix_sql(GAPPED, ["l_quantity", "l_discount", "l_extendedprice", "flat"]))
def correlation_matrix_missing(spark, sf_dir):
    columns = ["l_quantity", "l_discount", "l_extendedprice", "flat"]
    found = correlation_matrix(_gapped(spark, sf_dir), columns)
    return found.withColumn("corr", F.round("corr", 9))


WITH_LINK = """(SELECT l_quantity, l_extendedprice + 900 * l_quantity AS l_extendedprice, l_discount FROM lineitem)"""


@query(
    "r2_on_all_others_lineitem",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS target, '{a}, {b}' AS features,
            cast(round_even({_pair_r2(WITH_LINK, t, a, b)}, 4) AS double) AS r2"""
        for t, a, b in (
            ("l_quantity", "l_extendedprice", "l_discount"),
            ("l_extendedprice", "l_quantity", "l_discount"),
            ("l_discount", "l_quantity", "l_extendedprice"),
        )
    ),
)
def r2_on_all_others_lineitem(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        "l_quantity", (F.col("l_extendedprice") + 900 * F.col("l_quantity")).alias("l_extendedprice"), "l_discount"
    )
    return r2_on_all_others(lines)


@query(
    "top_relationships_lineitem",
    f"""SELECT metric, target, predictors, round(value, 3) AS value FROM ({_relations_sql('lineitem', NUMBERS)})
        ORDER BY abs(round(value, 3)) DESC, t, size, p LIMIT 10""",
)
def top_relationships_lineitem(spark, sf_dir):
    return top_relationships(read(spark, sf_dir, "lineitem"), NUMBERS)


@query(
    "search_relationships_missing",
    f"""SELECT target, predictors, metric, round(value, 7) AS value
        FROM ({_relations_sql(GAPPED, ['l_quantity', 'l_discount', 'l_extendedprice', 'l_tax'])})""",
)
def search_relationships_missing(spark, sf_dir):
    columns = ["l_quantity", "l_discount", "l_extendedprice", "l_tax"]
    found = search_relationships(_gapped(spark, sf_dir), columns, predictors=2)
    return found.withColumn("value", F.round("value", 7))


EIGHT = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMBERS]


def _determinant(spots: tuple[int, ...]) -> str:
    """Determinant of the correlations of some columns, written out by permutations."""
    terms = []
    for order in permutations(range(len(spots))):
        swaps = sum(order[i] > order[j] for i in range(len(order)) for j in range(i + 1, len(order)))
        cells = [
            f"c{min(spots[i], spots[j])}_{max(spots[i], spots[j])}" for i, j in enumerate(order) if i != j
        ]
        terms.append(("-" if swaps % 2 else "+") + "*".join(["1.0::double", *cells]))
    return "(" + "".join(terms) + ")"


def _search_sql(table: str, columns: list[str], predictors: int) -> str:
    """R² is 1 minus the ratio of the determinants with and without the target."""
    pairs = [
        f"corr({columns[i]}, {columns[j]}) AS c{i}_{j}" for i, j in combinations(range(len(columns)), 2)
    ]
    lines = []
    for t, target in enumerate(columns):
        others = [i for i in range(len(columns)) if i != t]
        for size in range(1, predictors + 1):
            for combo in combinations(others, size):
                names = ", ".join(columns[i] for i in combo)
                value = (
                    f"c{min(t, combo[0])}_{max(t, combo[0])}"
                    if size == 1
                    else f"1 - {_determinant((t, *combo))} / {_determinant(combo)}"
                )
                metric = "corr" if size == 1 else "R2"
                lines.append(
                    f"SELECT '{target}' AS target, '{names}' AS predictors, '{metric}' AS metric,"
                    f" round({value}, 9) AS value FROM c"
                )
    return f"WITH c AS (SELECT {', '.join(pairs)} FROM {table}) " + " UNION ALL ".join(lines)


@query("search_relationships_three", _search_sql("lineitem", EIGHT, 3))
def search_relationships_three(spark, sf_dir):
    found = search_relationships(read(spark, sf_dir, "lineitem"))
    return found.withColumn("value", F.round("value", 9))


@query(
    "best_relationships_lineitem",
    f"""SELECT target, predictors, metric, value FROM (SELECT *, row_number() OVER (
            PARTITION BY target, len(string_split(predictors, ',')) ORDER BY abs(value) DESC) AS place
            FROM ({_search_sql('lineitem', EIGHT, 3)})) WHERE place <= 2""",
)
def best_relationships_lineitem(spark, sf_dir):
    found = best_relationships(read(spark, sf_dir, "lineitem"), predictors=3, rows=2)
    return found.withColumn("value", F.round("value", 9))


WIDE_GAPS = [f"g{i}" for i in range(20)]
_GAP_SQL = "(SELECT " + ", ".join(
    f"CASE WHEN (l_orderkey * {2 * i + 3} + l_linenumber * {i + 1}) % 7 > 1 THEN"
    f" {NUMBERS[i % len(NUMBERS)]} + (l_orderkey % {i + 2}) END AS g{i}"
    for i in range(20)
) + " FROM lineitem)"


@query("correlation_matrix_many_gaps", _matrix_sql(_GAP_SQL, WIDE_GAPS))
def correlation_matrix_many_gaps(spark, sf_dir):
    """Twenty columns whose gaps make thousands of patterns."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    lines = read(spark, sf_dir, "lineitem").select(
        *[
            F.when(
                (order * (2 * i + 3) + line * (i + 1)) % 7 > 1,
                F.col(NUMBERS[i % len(NUMBERS)]) + order % (i + 2),
            ).alias(name)
            for i, name in enumerate(WIDE_GAPS)
        ]
    )
    return correlation_matrix(lines, WIDE_GAPS).withColumn("corr", F.round("corr", 9))
