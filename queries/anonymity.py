"""k-anonymity: metric, microaggregation, Mondrian, restore."""

from pyspark.sql import functions as F

from duskveil.operators.kanon import k_metric, kanonymize, microaggregate, put_back, restore
from duskveil.operators.mondrian import mondrian
from queries.registry import query, read

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@query(
    "k_metric_customer",
    """SELECT min(n) AS k FROM
       (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)""",
)
def k_metric_customer(spark, sf_dir):
    return k_metric(read(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query(
    "k_metric_null_keys",
    """SELECT min(n) AS k FROM (SELECT count(*) AS n FROM
       (SELECT nullif(o_orderstatus, 'P') AS s, o_orderpriority FROM orders) GROUP BY s, o_orderpriority)""",
)
def k_metric_null_keys(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(
        F.nullif("o_orderstatus", F.lit("P")).alias("s"), "o_orderpriority"
    )
    return k_metric(orders, ["s", "o_orderpriority"])


def number_label(low: str, high: str, k: int) -> str:
    gap = max(1, k // 2)
    return f"""CASE WHEN {low} IS NULL THEN ''
        WHEN {low} <> {high} THEN {low} || '–' || {high}
        WHEN {low} >= 0 THEN greatest({low} - {gap}, 0) || '–' || ({high} + {gap})
        ELSE ({low} - {gap}) || '–' || ({high} + {gap}) END"""


def date_label(low: str, high: str) -> str:
    first, last = f"strftime({low}, '%Y-%m-%d')", f"strftime({high}, '%Y-%m-%d')"
    return f"""CASE WHEN {low} IS NULL THEN '' WHEN {low} = {high} THEN {first}
        ELSE {first} || ' – ' || {last} END"""


def micro_sql(table, key, numbers, dates, texts, others, k):
    """SQL of microaggregation: ``numbers``, ``dates`` and ``texts`` are the quasi-identifiers."""
    base = [f"cast(round_even({c}, 0) AS bigint) AS {c}" for c in numbers]
    base += [f"cast({c} AS date) AS {c}" for c in dates] + list(texts)
    axis = {c: f"cast({c} AS double)" for c in numbers}
    axis |= {c: f"cast(date_diff('day', date '1970-01-01', {c}) AS double)" for c in dates}
    moments = [f"avg({a}) AS m_{c}, stddev_pop({a}) AS s_{c}" for c, a in axis.items()]
    score = " + ".join(f"({a} - m_{c}) / coalesce(nullif(s_{c}, 0), 1)" for c, a in axis.items())
    ends = [f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in [*numbers, *dates]]
    modes = "".join(
        f""", t_{c} AS (SELECT g, {c} AS mode_{c} FROM
            (SELECT g, {c}, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, {c}) AS r
             FROM grouped WHERE {c} IS NOT NULL GROUP BY g, {c}) WHERE r = 1)"""
        for c in texts
    )
    labels = [f"{number_label(f'lo_{c}', f'hi_{c}', k)} AS {c}" for c in numbers]
    labels += [f"{date_label(f'lo_{c}', f'hi_{c}')} AS {c}" for c in dates]
    labels += [f"coalesce(mode_{c}, '') AS {c}" for c in texts]
    joins = "".join(f" LEFT JOIN t_{c} USING (g)" for c in texts)
    keys = ", ".join(f"{c} AS k{i}" for i, c in enumerate(key))
    order = ", ".join(f"k{i}" for i in range(len(key)))
    back = ", ".join(f"k{i} AS {c}" for i, c in enumerate(key) if c not in {*numbers, *dates, *texts})
    rest = "".join(f", {c}" for c in others)
    return f"""WITH base AS (SELECT {keys}, {', '.join(base)}{rest} FROM {table}),
        known AS (SELECT count(*) AS n, {', '.join(moments)} FROM base),
        numbered AS (SELECT base.*, n,
            row_number() OVER (ORDER BY round({score}, 9) ASC NULLS LAST, {order}) AS rn
            FROM base, known),
        grouped AS (SELECT *, least((rn - 1) // {k}, greatest(n // {k} - 1, 0)) AS g FROM numbered),
        ends AS (SELECT g, {', '.join(ends) or 'count(*) AS c'} FROM grouped GROUP BY g){modes}
        SELECT {back}, {', '.join(labels)}{rest} FROM
            (SELECT g, {order}{rest} FROM grouped) JOIN ends USING (g){joins}"""


@query(
    "microaggregate_customer",
    micro_sql("customer", ["c_custkey"], ["c_acctbal", "c_nationkey"], [], [],
              ["c_name", "c_mktsegment"], 5),
)
def microaggregate_customer(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    return microaggregate(customer, ["c_acctbal", "c_nationkey"], 5, ["c_custkey"])


@query(
    "microaggregate_lineitem_dates",
    micro_sql("lineitem", LINE_KEY[:5] + ["l_shipdate"], ["l_quantity"], ["l_shipdate"], [], ["l_tax"], 12),
)
def microaggregate_lineitem_dates(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_quantity", "l_tax")
    return microaggregate(lines, ["l_quantity", "l_shipdate"], 12, LINE_KEY)


@query(
    "microaggregate_part_text",
    micro_sql("part", ["p_partkey"], ["p_size"], [], ["p_brand"], ["p_name", "p_type"], 8),
)
def microaggregate_part_text(spark, sf_dir):
    part = read(spark, sf_dir, "part").drop("p_retailprice")
    return microaggregate(part, ["p_size", "p_brand"], 8, ["p_partkey"])


@query(
    "microaggregate_missing_values",
    micro_sql(
        "(SELECT s_suppkey, nullif(s_nationkey, 3) AS s_nationkey, "
        "CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal FROM supplier)",
        ["s_suppkey"], ["s_nationkey", "s_acctbal"], [], [], [], 4,
    ),
)
def microaggregate_missing_values(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.nullif("s_nationkey", F.lit(3)).alias("s_nationkey"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("s_acctbal"),
    )
    return microaggregate(supplier, ["s_nationkey", "s_acctbal"], 4, ["s_suppkey"])


@query(
    "kanonymize_reaches_k",
    "SELECT count(*) AS rows, true AS k_reached FROM customer",
)
def kanonymize_reaches_k(spark, sf_dir):
    quasi = ["c_acctbal", "c_nationkey", "c_mktsegment"]
    done = kanonymize(read(spark, sf_dir, "customer"), quasi, 7, ["c_custkey"], "micro")
    sizes = done.groupBy(*quasi).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("rows"), (F.min("n") >= 7).alias("k_reached"))


def mondrian_sql(table: str, key: str, codes: dict[str, str], k: int, others: list[str]) -> str:
    """Median cuts level by level; ``codes`` maps each column to its number."""
    spots = dict(enumerate(codes.items()))
    coded = ", ".join(f"cast({code} AS double) AS c{i}" for i, (_, code) in spots.items())
    scale = ", ".join(f"max(c{i}) - min(c{i}) AS s{i}" for i in spots)
    seen = ", ".join(
        f"(max(c{i}) OVER w - min(c{i}) OVER w) / s{i} AS w{i}, quantile_disc(c{i}, 0.5) OVER w AS m{i}"
        for i in spots
    )
    sizes = ", ".join(
        f"count(*) FILTER (c{i} <= m{i}) OVER (PARTITION BY path) AS l{i}" for i in spots
    )
    fits = {i: f"(l{i} >= {k} AND n - l{i} >= {k})" for i in spots}
    # widest side that can be cut, the first of equals
    best = (
        "list_max([" + ", ".join(f"CASE WHEN {fits[i]} THEN {{'w': w{i}, 'd': {-i}}} END" for i in spots) + "])"
    )
    side = " ".join(f"WHEN {-i} THEN c{i} <= m{i}" for i in spots)
    columns = ", ".join(f"c{i}" for i in spots)
    labels = ", ".join(
        f"CASE WHEN min({c}) = max({c}) THEN cast(min({c}) AS varchar)"
        f" ELSE min({c}) || '–' || max({c}) END AS l{i}"
        for i, (c, _) in spots.items()
    )
    out = ", ".join(f"l{i} AS {c}" for i, (c, _) in spots.items())
    return f"""WITH RECURSIVE coded AS (SELECT {key}, {coded} FROM {table}),
        scale AS (SELECT {scale} FROM coded),
        cuts AS (SELECT {key}, '' AS path, {columns}, false AS done FROM coded
            UNION ALL
            SELECT {key}, CASE WHEN best IS NULL THEN path
                WHEN (CASE best.d {side} END) THEN path || 'l' ELSE path || 'r' END, {columns}, best IS NULL
            FROM (SELECT *, {best} AS best FROM (SELECT *, {sizes} FROM
                (SELECT {key}, path, {columns}, count(*) OVER w AS n, {seen} FROM cuts, scale WHERE NOT done
                 WINDOW w AS (PARTITION BY path))))),
        final AS (SELECT {key}, path FROM cuts WHERE done),
        labels AS (SELECT path, {labels} FROM final JOIN {table} USING ({key}) GROUP BY path)
        SELECT {key}, {out}{"".join(f", {c}" for c in others)} FROM {table} JOIN final USING ({key})
        JOIN labels USING (path)"""


@query(
    "mondrian_part",
    mondrian_sql(
        "(SELECT *, dense_rank() OVER (ORDER BY p_brand) AS brand_rank FROM part)", "p_partkey",
        {"p_size": "p_size", "p_brand": "brand_rank", "p_retailprice": "p_retailprice"}, 10, ["p_name"],
    ),
)
def mondrian_part(spark, sf_dir):
    part = read(spark, sf_dir, "part").drop("p_type")
    key = ["p_partkey"]
    labelled, names = mondrian(part, ["p_size", "p_brand", "p_retailprice"], 10, key, local_rows=300)
    return put_back(part, labelled, names, key, keep_backup=False)


@query(
    "mondrian_customer",
    mondrian_sql("customer", "c_custkey", {"c_nationkey": "c_nationkey", "c_acctbal": "c_acctbal"}, 6,
                 ["c_name", "c_mktsegment"]),
)
def mondrian_customer(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    return kanonymize(customer, ["c_nationkey", "c_acctbal"], 6, ["c_custkey"], "mondrian")


@query(
    "mondrian_part_reaches_k",
    """SELECT count(*) AS rows, count(*) >= 10 AS k_reached, count(*) > 100 AS was_cut,
       bool_and(p_size BETWEEN 1 AND 50) AS labels_hold FROM part""",
)
def mondrian_part_reaches_k(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    quasi = ["p_size", "p_retailprice", "p_type"]
    labelled, names = mondrian(part, quasi, 10, ["p_partkey"], local_rows=400)
    sizes = labelled.groupBy(*names.values()).agg(F.count("*").alias("n"))
    ends = F.split(names["p_size"], "–")
    low, high = ends[0].cast("int"), F.element_at(ends, -1).cast("int")
    inside = labelled.join(part, "p_partkey").agg(
        F.bool_and(F.col("p_size").between(low, high)).alias("ok")
    )
    return sizes.agg(
        F.sum("n").alias("rows"),
        (F.min("n") >= 10).alias("k_reached"),
        (F.count("*") > 10).alias("was_cut"),
        inside.scalar().alias("labels_hold"),
    )


@query("kanonymize_mondrian_orders", "SELECT count(*) AS rows, true AS k_reached FROM orders")
def kanonymize_mondrian_orders(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    quasi = ["o_totalprice", "o_orderdate", "o_orderpriority"]
    done = kanonymize(orders, quasi, 25, ["o_orderkey"], "mondrian")
    sizes = done.groupBy(*quasi).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("rows"), (F.min("n") >= 25).alias("k_reached"))


@query("restore_customer", "SELECT * FROM customer")
def restore_customer(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    quasi = ["c_acctbal", "c_mktsegment"]
    return restore(microaggregate(customer, quasi, 6, ["c_custkey"], keep_backup=True))
