"""Profiles, chart data and before/after comparisons."""

from pyspark.sql import functions as F

from duskveil.operators.charts import (
    QUARTILES,
    before_after,
    box_summary,
    category_counts,
    grouped_boxes,
    histogram,
    numeric_cells,
    scatter_pairs,
    scatter_sample,
)
from duskveil.operators.kanon import microaggregate
from duskveil.operators.masks import mask_tail
from duskveil.operators.profile import (
    changed_columns,
    column_profile,
    dataset_header,
    summary_report,
    top_values,
)
from duskveil.plans.release import ReleaseInfo
from queries.anonymity import micro_sql
from queries.registry import query, read

CUSTOMER = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
    "c_mktsegment": "string",
}


@query(
    "dataset_header_customer",
    """SELECT count(*) AS num_rows, 5 AS num_columns, true AS k_anonymized, true AS l_diversity,
       (SELECT min(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)) AS k_value,
       3::bigint AS l_value FROM customer""",
)
def dataset_header_customer(spark, sf_dir):
    info = ReleaseInfo(k_columns=("c_nationkey",), l=3)
    return dataset_header(read(spark, sf_dir, "customer"), info)


def _gaps(spark, sf_dir):
    return read(spark, sf_dir, "customer").withColumn(
        "c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    )


GAPS = "(SELECT * REPLACE (CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal) FROM customer)"


def profile_sql(table: str, types: dict[str, str]) -> str:
    lines = []
    for name, kind in types.items():
        mean = f"cast(round_even(avg({name}), 2) AS double)" if kind != "string" else "NULL::double"
        std = f"cast(round_even(stddev_samp({name}), 2) AS double)" if kind != "string" else "NULL::double"
        lines.append(
            f"""SELECT '{name}' AS column_name, '{kind}' AS dtype, count(*) - count({name}) AS missing,
            count({name}) AS non_null, count(DISTINCT {name}) AS "distinct", {mean} AS mean, {std} AS std
            FROM {table}"""
        )
    return " UNION ALL ".join(lines)


@query("column_profile_customer", profile_sql(GAPS, CUSTOMER))
def column_profile_customer(spark, sf_dir):
    return column_profile(_gaps(spark, sf_dir))


def top_sql(table: str, columns, rows: int = 10) -> str:
    lines = [
        f"""SELECT column_name, value, n, cast(r AS int) AS rank FROM
        (SELECT '{c}' AS column_name, cast({c} AS varchar) AS value, count(*) AS n,
         row_number() OVER (ORDER BY count(*) DESC, cast({c} AS varchar)) AS r
         FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r <= {rows}"""
        for c in columns
    ]
    return " UNION ALL ".join(lines)


@query("top_values_customer", top_sql(GAPS, CUSTOMER))
def top_values_customer(spark, sf_dir):
    return top_values(_gaps(spark, sf_dir))


@query(
    "top_values_orders",
    top_sql("(SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders)",
            ["o_custkey", "o_orderstatus", "o_orderpriority"]),
)
def top_values_orders(spark, sf_dir):
    return top_values(read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query(
    "changed_columns_customer",
    """SELECT column_name FROM (
         SELECT unnest(['c_name', 'c_acctbal', 'c_mktsegment', 'c_nationkey']) AS column_name,
           unnest([bool_or(left(c_name, greatest(length(c_name) - 2, 0)) || '**' <> c_name),
             bool_or(c_custkey = 3 AND c_acctbal IS NOT NULL), bool_or(c_mktsegment = 'BUILDING'), false]) AS changed
         FROM customer) WHERE changed""",
)
def changed_columns_customer(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    released = mask_tail(customer, ["c_name"], 2).withColumn(
        "c_acctbal", F.when(F.col("c_custkey") != 3, F.col("c_acctbal"))
    ).withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return changed_columns(released, customer, ["c_custkey"])


@query(
    "summary_report_nation",
    f"""WITH p AS ({profile_sql('nation', {'n_nationkey': 'int', 'n_name': 'string', 'n_regionkey': 'int'})}),
        t AS ({top_sql('nation', ['n_nationkey', 'n_name', 'n_regionkey'])})
        SELECT 'dataset' AS section, 'num_rows' AS metric, cast(count(*) AS varchar) AS value FROM nation
        UNION ALL SELECT 'dataset', 'num_columns', '3' UNION ALL SELECT 'dataset', 'k_anonymized', 'false'
        UNION ALL SELECT 'dataset', 'l_diversity', 'false'
        UNION ALL SELECT column_name, 'dtype', dtype FROM p
        UNION ALL SELECT column_name, 'missing', cast(missing AS varchar) FROM p
        UNION ALL SELECT column_name, 'non_null', cast(non_null AS varchar) FROM p
        UNION ALL SELECT column_name, 'distinct', cast("distinct" AS varchar) FROM p
        UNION ALL SELECT column_name, 'mean', cast(mean AS varchar) FROM p WHERE mean IS NOT NULL
        UNION ALL SELECT column_name, 'std', cast(std AS varchar) FROM p WHERE std IS NOT NULL
        UNION ALL SELECT column_name, 'count of ' || value, cast(n AS varchar) FROM t""",
)
def summary_report_nation(spark, sf_dir):
    return summary_report(read(spark, sf_dir, "nation"))


@query(
    "category_counts_events",
    """SELECT CASE WHEN event_type = 'click' THEN 'N/A' WHEN event_type = 'error' THEN 'N/A' ELSE event_type END AS label,
       count(*) AS n FROM events GROUP BY 1""",
)
def category_counts_events(spark, sf_dir):
    kind = F.col("event_type")
    events = read(spark, sf_dir, "events").select(
        F.when(kind == "error", "").when(kind != "click", kind).alias("kind")
    )
    return category_counts(events, "kind")


LABELLED = micro_sql("customer", ["c_custkey"], ["c_acctbal", "c_nationkey"], [], [], [], 5)


@query(
    "numeric_cells_labels",
    f"""SELECT c_custkey, (cast(regexp_extract(c_acctbal, '^(-?\\d+)–(-?\\d+)$', 1) AS double)
            + cast(regexp_extract(c_acctbal, '^(-?\\d+)–(-?\\d+)$', 2) AS double)) / 2 AS c_acctbal,
        (cast(split_part(c_nationkey, '–', 1) AS double) + cast(split_part(c_nationkey, '–', 2) AS double)) / 2 AS c_nationkey
        FROM ({LABELLED})""",
)
def numeric_cells_labels(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    labelled = microaggregate(customer, ["c_acctbal", "c_nationkey"], 5, ["c_custkey"])
    return numeric_cells(labelled, ["c_acctbal", "c_nationkey"])


@query(
    "numeric_cells_spellings",
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN (p_size + p_size + 10) / 2.0
       WHEN 2 THEN (p_size + p_size + 4) / 2.0 WHEN 5 THEN (2019 + 6) / 2.0 WHEN 6 THEN -p_size END::double AS v FROM part""",
)
def numeric_cells_spellings(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_partkey") % 7
    text = size.cast("string")
    spelled = (
        F.when(kind == 0, F.concat(F.lit("  "), text, F.lit(",5 ")))
        .when(kind == 1, F.concat(text, F.lit(" To "), (size + 10).cast("string")))
        .when(kind == 2, F.concat(text, F.lit(" – "), (size + 4).cast("string")))
        .when(kind == 3, F.lit(" * "))
        .when(kind == 4, F.concat(text, F.lit(" pieces")))
        .when(kind == 5, F.lit("2019-06"))
        .otherwise(F.concat(F.lit("-"), text))
    )
    part = read(spark, sf_dir, "part").select("p_partkey", spelled.alias("v"))
    return numeric_cells(part, ["v"])


def histogram_sql(table: str, x: str, bins: int) -> str:
    return f"""SELECT bin, round(low + width * (bin - 1), 6) AS low, round(low + width * bin, 6) AS high, count(*) AS n
        FROM (SELECT cast(least(floor((v - low) / width), {bins - 1}) + 1 AS int) AS bin, low, width FROM
            (SELECT {x} AS v FROM {table} WHERE {x} IS NOT NULL),
            (SELECT min({x}) AS low, (max({x}) - min({x})) / {bins} AS width FROM {table}))
        GROUP BY bin, low, width"""


def _rounded(found):
    return found.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("histogram_quantity", histogram_sql("lineitem", "l_quantity", 20))
def histogram_quantity(spark, sf_dir):
    return _rounded(histogram(read(spark, sf_dir, "lineitem"), "l_quantity"))


@query("histogram_balances", histogram_sql("customer", "c_acctbal", 7))
def histogram_balances(spark, sf_dir):
    return _rounded(histogram(read(spark, sf_dir, "customer"), "c_acctbal", 7))


def box_sql(table: str, label: str, x: str, groups: str) -> str:
    """Box per group; ``label`` is the select expression of the group."""
    by = f"GROUP BY {groups}" if groups else ""
    on = f"USING ({groups})" if groups else "ON true"
    lead = f"{groups}, " if groups else ""
    return f"""SELECT {label}, n, low, q1, median, q3, high,
            min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
            max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
            count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM (SELECT {lead}count({x}) AS n, min({x})::double AS low, quantile_cont({x}, 0.25) AS q1,
            quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3, max({x})::double AS high FROM {table} {by})
        JOIN (SELECT {lead}{x} AS v FROM {table} WHERE {x} IS NOT NULL) {on}
        GROUP BY ALL"""


def _round_box(found):
    return found.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


def _round_box_sql(sql: str, label: str) -> str:
    return f"""SELECT {label}, n, low, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, high,
        whisker_low, whisker_high, outliers FROM ({sql})"""


@query(
    "box_summary_lineitem",
    _round_box_sql(
        box_sql("lineitem", "'l_quantity' AS column_name", "l_quantity", "")
        + " UNION ALL "
        + box_sql("(SELECT l_extendedprice * l_quantity AS l_extendedprice FROM lineitem)",
                  "'l_extendedprice' AS column_name", "l_extendedprice", ""),
        "column_name",
    ),
)
def box_summary_lineitem(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        "l_quantity", (F.col("l_extendedprice") * F.col("l_quantity")).alias("l_extendedprice")
    )
    return _round_box(box_summary(lines))


@query(
    "grouped_boxes_orders",
    _round_box_sql(box_sql("orders", "o_orderpriority AS label", "o_totalprice", "o_orderpriority"), "label"),
)
def grouped_boxes_orders(spark, sf_dir):
    return _round_box(grouped_boxes(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))


@query(
    "box_sketch_ranks_lineitem",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{q}' AS quartile, count({c}) AS n, true AS near FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
        for q in ("low", "q1", "median", "q3", "high")
    ),
)
def box_sketch_ranks_lineitem(spark, sf_dir):
    """Quartiles by sketch, each checked against the exact ranks of its value."""
    accuracy = 100
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    lines = read(spark, sf_dir, "lineitem").select(*columns)
    boxes = box_summary(lines, accuracy=accuracy)
    cells = lines.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in columns])))
    quartiles = boxes.select(
        "column_name",
        F.inline(F.array(*[F.struct(F.lit(q).alias("quartile"), F.lit(p).alias("p"), F.col(q).alias("at")) for q, p in QUARTILES.items()])),
    )
    ranks = cells.join(F.broadcast(quartiles), "column_name").groupBy("column_name", "quartile", "p").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("v") < F.col("at")).alias("below"),
        F.count_if(F.col("v") <= F.col("at")).alias("upto"),
    )
    wanted, slack = F.col("p") * F.col("n"), F.col("n") / accuracy + 1
    near = (F.col("upto") > F.col("below")) & (F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)
    return ranks.select("column_name", "quartile", "n", near.alias("near"))


@query(
    "scatter_sample_orders",
    """WITH p AS (SELECT o_custkey::double AS x, o_totalprice AS y, md5('7:' || o_orderkey) AS h FROM orders),
        e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p)
        SELECT x, y FROM p, e QUALIFY row_number() OVER (PARTITION BY
            least(floor((x - lx) / ((hx - lx) / 12)), 11), least(floor((y - ly) / ((hy - ly) / 12)), 11)
            ORDER BY h) <= 3""",
)
def scatter_sample_orders(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return scatter_sample(orders, "o_custkey", "o_totalprice", ["o_orderkey"], per_cell=3, grid=12, seed=7)


@query(
    "top_values_long_texts",
    top_sql("(SELECT 'a text that many values share, up to its last letter, which is ' || o_orderkey % 40 AS shared, "
            "repeat('x', 70) || o_orderkey AS lone, o_orderkey FROM orders)", ["shared", "lone", "o_orderkey"]),
)
def top_values_long_texts(spark, sf_dir):
    """Long values that differ behind the characters they are told by; ties by value."""
    orders = read(spark, sf_dir, "orders").select(
        F.concat(
            F.lit("a text that many values share, up to its last letter, which is "), (F.col("o_orderkey") % 40).cast("string")
        ).alias("shared"),
        F.concat(F.lit("x" * 70), F.col("o_orderkey").cast("string")).alias("lone"),
        "o_orderkey",
    )
    return top_values(orders)


@query(
    "scatter_pairs_part",
    "SELECT p_size::double AS x, p_retailprice AS y FROM part WHERE p_size <> 7 AND p_retailprice < 1000",
)
def scatter_pairs_part(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(
        F.when(F.col("p_size") == 7, "seven").otherwise(F.col("p_size").cast("string")).alias("size"),
        F.when(F.col("p_retailprice") < 1000, F.col("p_retailprice")).alias("price"),
    )
    return scatter_pairs(part, "size", "price")


@query(
    "before_after_balances",
    f"""SELECT *, 'before' AS version FROM ({histogram_sql('customer', 'c_acctbal', 10)})
        UNION ALL SELECT *, 'after' AS version FROM ({histogram_sql(
            "(SELECT (cast(regexp_extract(c_acctbal, '^(-?[0-9]+)–(-?[0-9]+)$', 1) AS double)"
            " + cast(regexp_extract(c_acctbal, '^(-?[0-9]+)–(-?[0-9]+)$', 2) AS double)) / 2 AS c_acctbal"
            f" FROM ({LABELLED}))", 'c_acctbal', 10)})""",
)
def before_after_balances(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    labelled = microaggregate(customer, ["c_acctbal", "c_nationkey"], 5, ["c_custkey"])
    return _rounded(before_after(customer, labelled, lambda t: histogram(t, "c_acctbal", 10)))
