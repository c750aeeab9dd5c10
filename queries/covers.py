"""Column-wide masks: near numbers, positional cover, spread, and their compositions."""

import math

from pyspark.sql import functions as F

from duskveil.operators.cover import (
    cover_columns,
    cover_positions,
    finalise_mask,
    ldiversity_columns,
    mask_near_numbers,
    spread_masks,
)
from duskveil.plans.release import ReleaseInfo
from queries.masks import ALNUM, share_sql
from queries.registry import query, read


def near_sql(table: str, key: str, column: str, l: int) -> str:
    """(key, v): whole numbers in reach of another row's number become stars."""
    reach = (
        "{l} * power(10, greatest(length(cast(cast(trunc(abs({x})) AS bigint) AS varchar)) - 2, 0))"
    )
    mine, theirs = reach.format(l=l, x="r.x"), reach.format(l=l, x="o.x")
    return f"""SELECT {key}, CASE WHEN EXISTS (SELECT 1 FROM {table} o_ JOIN
            (SELECT {key} AS k, cast({column} AS double) AS x FROM {table}) o ON o.k = o_.{key}
            WHERE o.k <> r.{key} AND (abs(r.x - o.x) <= {mine} OR abs(r.x - o.x) <= {theirs}))
        THEN repeat('*', length(v)) ELSE v END AS v
        FROM (SELECT {key}, cast({column} AS double) AS x, cast({column} AS varchar) AS v FROM {table}) r"""


@query(
    "mask_near_numbers_customer",
    f"""SELECT c_custkey, v AS c_acctbal, c_mktsegment FROM customer
        JOIN ({near_sql('customer', 'c_custkey', 'c_acctbal', 1)}) USING (c_custkey)""",
)
def mask_near_numbers_customer(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return mask_near_numbers(customer, ["c_acctbal"], 1)


@query(
    "mask_near_numbers_supplier",
    f"""SELECT s_suppkey, x.v AS s_acctbal, y.v AS s_nationkey FROM
        ({near_sql('supplier', 's_suppkey', 's_acctbal', 2)}) x
        JOIN ({near_sql('supplier', 's_suppkey', 's_nationkey', 2)}) y USING (s_suppkey)""",
)
def mask_near_numbers_supplier(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return mask_near_numbers(supplier, ["s_acctbal", "s_nationkey"], 2)


@query(
    "mask_equal_numbers_orders",
    """SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_totalprice) > 1
        THEN repeat('*', length(cast(o_totalprice AS varchar)))
        ELSE cast(o_totalprice AS varchar) END AS o_totalprice FROM orders""",
)
def mask_equal_numbers_orders(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return mask_near_numbers(orders, ["o_totalprice"], 0, ["o_orderkey"])


def _cover_pass(source: str, name: str, key: str, l: int, side: str) -> str:
    share = min(0.9, 0.35 + 0.05 * max(1, min(l, 10)))
    lengths = [max(1, min(n, math.ceil(n * share))) for n in range(1, l + 1)]
    place = "v[length(v) - n + 1]" if side == "right" else "v[n]"
    cut = (
        "v[:length(v) - c] || repeat('*', c)" if side == "right" else "repeat('*', c) || v[c + 1:]"
    )
    return f"""{name}_e AS (SELECT {key}, short, n, lower({place}) AS ch FROM
            (SELECT *, unnest(range(1, least({l}, length(v)) + 1)) AS n FROM {source})),
        {name}_n AS (SELECT n, ch, count(*) AS many FROM {name}_e
            WHERE ch <> '*' AND regexp_matches(ch, {ALNUM}) GROUP BY n, ch),
        {name}_s AS (SELECT DISTINCT n AS star FROM {name}_e WHERE ch = '*'),
        {name}_t AS (SELECT {key}, max(CASE WHEN short THEN n ELSE {lengths}[n] END) AS c
            FROM {name}_e JOIN {name}_n USING (n, ch) LEFT JOIN {name}_s ON star = n
            WHERE many >= 2 OR star IS NOT NULL GROUP BY {key}),
        {name} AS (SELECT {key}, short, {cut} AS v FROM
            (SELECT {key}, short, v, coalesce(c, 0) AS c FROM {source} LEFT JOIN {name}_t USING ({key})))"""


def cover_ctes(source: str, prefix: str, key: str, l: int) -> str:
    """CTEs ``{prefix}_in`` … ``{prefix}_l`` from rows (key, v)."""
    return f"""{prefix}_in AS (SELECT {key}, v, regexp_matches(v, '^[0-9]{{2,3}}$') AS short FROM ({source})),
        {_cover_pass(f'{prefix}_in', f'{prefix}_r', key, l, 'right')},
        {_cover_pass(f'{prefix}_r', f'{prefix}_l', key, l, 'left')}"""


def spread_sql(source: str, key: str, l: int) -> str:
    """(key, v): the characters are lists here, long texts need quick access by place."""

    def near(side: str) -> str:
        right = f"(length({side}) - (length(c) - i))"
        return (
            f"coalesce(list_contains({side}[greatest(i - 1, 1):i + 1], '*'), false)"
            f" OR coalesce(list_contains({side}[greatest({right} - 1, 1):greatest({right} + 1, 0)], '*'), false)"
        )

    return f"""SELECT {key}, array_to_string([CASE WHEN (i <= {l} OR length(c) - i < {l})
            AND regexp_matches(c[i], {ALNUM}) AND ({near('b')} OR {near('a')})
            THEN '*' ELSE c[i] END for i in range(1, length(c) + 1)], '') AS v
        FROM (SELECT {key}, c, lag(c) OVER w AS b, lead(c) OVER w AS a FROM
              (SELECT {key}, string_split(v, '') AS c FROM ({source})) WINDOW w AS (ORDER BY {key}))"""


def columns_sql(table: str, key: str, column: str, l: int, prefix: str, number: bool) -> str:
    """CTEs ending in ``{prefix}_out`` (key, v): the whole column cover."""
    source = (
        near_sql(table, key, column, l) if number else f"SELECT {key}, {column} AS v FROM {table}"
    )
    return f"""{cover_ctes(source, prefix, key, l)},
        {prefix}_out AS ({spread_sql(f'SELECT {key}, v FROM {prefix}_l', key, l)})"""


@query(
    "cover_positions_customer",
    f"""WITH {cover_ctes('SELECT c_custkey, c_name AS v FROM customer', 'a', 'c_custkey', 5)},
        {cover_ctes('SELECT c_custkey, cast(c_acctbal AS varchar) AS v FROM customer', 'b', 'c_custkey', 5)}
        SELECT c_custkey, a_l.v AS c_name, b_l.v AS c_acctbal FROM a_l JOIN b_l USING (c_custkey)""",
)
def cover_positions_customer(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return cover_positions(customer, ["c_name", "c_acctbal"], 5)


@query(
    "cover_positions_nation",
    f"""WITH {cover_ctes('SELECT n_nationkey, n_name AS v FROM nation', 'a', 'n_nationkey', 4)},
        {cover_ctes("SELECT n_nationkey, cast(n_nationkey * 7 AS varchar) AS v FROM nation", 'b', 'n_nationkey', 4)}
        SELECT n_nationkey, a_l.v AS n_name, b_l.v AS number FROM a_l JOIN b_l USING (n_nationkey)""",
)
def cover_positions_nation(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", (F.col("n_nationkey") * 7).alias("number")
    )
    return cover_positions(nation, ["n_name", "number"], 4)


@query(
    "spread_masks_documents",
    spread_sql("SELECT doc_id, replace(text, 'e', '*') AS v FROM documents", "doc_id", 6).replace(
        " AS v\n", " AS text\n", 1
    ),
)
def spread_masks_documents(spark, sf_dir):
    documents = read(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit("e"), F.lit("*")).alias("text")
    )
    return spread_masks(documents, ["text"], 6, ["doc_id"])


@query(
    "cover_columns_part",
    f"""WITH {columns_sql('part', 'p_partkey', 'p_name', 3, 'a', False)},
        {columns_sql('part', 'p_partkey', 'p_type', 3, 'b', False)}
        SELECT p_partkey, a_out.v AS p_name, p_brand, b_out.v AS p_type FROM part
        JOIN a_out USING (p_partkey) JOIN b_out USING (p_partkey)""",
)
def cover_columns_part(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return cover_columns(part, ["p_name", "p_type"], 3, ["p_partkey"])


@query(
    "cover_columns_balances",
    f"""WITH {columns_sql('customer', 'c_custkey', 'c_acctbal', 1, 'a', True)}
        SELECT c_custkey, v AS c_acctbal FROM a_out""",
)
def cover_columns_balances(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return cover_columns(customer, ["c_acctbal"], 1, ["c_custkey"])


@query(
    "ldiversity_mask_customer",
    f"""WITH {columns_sql('customer', 'c_custkey', 'c_name', 2, 'a', False)},
        {columns_sql('customer', 'c_custkey', 'c_acctbal', 2, 'b', True)}
        SELECT c_custkey, a_out.v AS c_name, c_nationkey, b_out.v AS c_acctbal,
            {share_sql('c_mktsegment', 50)} AS c_mktsegment
        FROM customer JOIN a_out USING (c_custkey) JOIN b_out USING (c_custkey)""",
)
def ldiversity_mask_customer(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    columns = ["c_mktsegment", "c_name", "c_acctbal"]
    return ldiversity_columns(customer, columns, 2, ["c_custkey"])


@query(
    "finalise_mask_supplier",
    f"""WITH {columns_sql('supplier', 's_suppkey', 's_name', 3, 'a', False)}
        SELECT s_suppkey, v AS s_name, s_nationkey, 3 AS l FROM supplier JOIN a_out USING (s_suppkey)""",
)
def finalise_mask_supplier(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", "s_nationkey", F.col("s_name").alias("backup_s_name")
    )
    info = ReleaseInfo(backups={"s_name": "backup_s_name"})
    masked, done = finalise_mask(supplier, ["s_name"], 3, ["s_suppkey"], info)
    return masked.withColumn("l", F.lit(done.l))
