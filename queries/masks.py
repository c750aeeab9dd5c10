"""Masks that look at one cell, and masks that compare adjacent rows."""

from pyspark.sql import functions as F

from duskveil.operators.context import mask_adjacent, mask_adjacent_consistently, mask_cyclic
from duskveil.operators.masks import mask_share, mask_tail, mask_word_tails, suppress_text
from queries.registry import query, read

ALNUM = r"'^[\p{L}\p{N}]$'"


def share_sql(column: str, percent: int) -> str:
    hidden = f"greatest(cast(round_even(length({column}) * {percent} / 100.0, 0) AS int), 1)"
    return f"""CASE WHEN {percent} >= 100 THEN repeat('*', length({column}))
        ELSE {column}[:greatest(length({column}) - {hidden}, 0)] || repeat('*', {hidden}) END"""


def tail_sql(column: str, count: int) -> str:
    return f"""({column}[:greatest(length({column}) - {count}, 0)]
        || repeat('*', least(length({column}), {count})))"""


@query(
    "mask_share_levels",
    f"""SELECT p_partkey, {share_sql('p_name', 25)} AS light, {share_sql('p_name', 50)} AS medium,
        {share_sql('p_name', 75)} AS heavy, {share_sql('p_name', 100)} AS sensitive FROM part""",
)
def mask_share_levels(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    out = part.select(
        "p_partkey", *[F.col("p_name").alias(n) for n in ("light", "medium", "heavy", "sensitive")]
    )
    for level in ("light", "medium", "heavy", "sensitive"):
        out = mask_share(out, [level], level)
    return out


@query(
    "mask_tail_customer",
    f"""SELECT c_custkey, {tail_sql('c_name', 4)} AS c_name, c_nationkey, c_acctbal,
        {tail_sql('c_mktsegment', 4)} AS c_mktsegment FROM customer""",
)
def mask_tail_customer(spark, sf_dir):
    return mask_tail(read(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], 4)


@query(
    "mask_word_tails_documents",
    """SELECT doc_id, array_to_string([w[:greatest(length(w) - 3, 0)] || repeat('*', least(length(w), 3))
       for w in string_split(text, ' ')], ' ') AS text FROM documents""",
)
def mask_word_tails_documents(spark, sf_dir):
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return mask_word_tails(documents, ["text", "absent"], 3)


@query(
    "suppress_customer_text",
    "SELECT c_custkey, '***' AS c_name, c_nationkey, c_acctbal, '***' AS c_mktsegment FROM customer",
)
def suppress_customer_text(spark, sf_dir):
    return suppress_text(read(spark, sf_dir, "customer"))


def _hit(own: str, other: str) -> str:
    return f"coalesce({other} = '*' OR lower({other}) = lower({own}), false)"


def adjacent_sql(table: str, key: str, column: str, count: int) -> str:
    """(key, t, hits): hits is the list of hidden offsets from the right."""
    own = "t[length(t) - n + 1]"
    before = "CASE WHEN length(b) >= n THEN b[length(b) - n + 1] END"
    after = "CASE WHEN length(a) >= n THEN a[length(a) - n + 1] END"
    return f"""SELECT {key}, t, [n for n in range(1, least({count}, length(t)) + 1)
            if regexp_matches({own}, {ALNUM}) AND ({_hit(own, f'({before})')} OR {_hit(own, f'({after})')})] AS hits
        FROM (SELECT {key}, {column} AS t, lag({column}) OVER w AS b, lead({column}) OVER w AS a
              FROM {table} WINDOW w AS (ORDER BY {key}))"""


def shown_sql() -> str:
    return """array_to_string([CASE WHEN list_contains(hits, length(t) - i + 1) THEN '*' ELSE t[i] END
        for i in range(1, length(t) + 1)], '')"""


@query(
    "mask_adjacent_part",
    f"""WITH x AS ({adjacent_sql('part', 'p_partkey', 'p_name', 4)}),
        y AS ({adjacent_sql('part', 'p_partkey', 'p_type', 4)})
        SELECT p_partkey, n AS p_name, m AS p_type, p_size FROM part
        JOIN (SELECT p_partkey, {shown_sql()} AS n FROM x) USING (p_partkey)
        JOIN (SELECT p_partkey, {shown_sql()} AS m FROM y) USING (p_partkey)""",
)
def mask_adjacent_part(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return mask_adjacent(part, ["p_name", "p_type"], 4, ["p_partkey"])


@query(
    "mask_adjacent_consistently_part",
    f"""WITH x AS ({adjacent_sql('part', 'p_partkey', 'p_name', 3)}),
        marks AS (SELECT lower(t) AS f, list_distinct(flatten(list(hits))) AS hits,
                  arg_max(t, p_partkey) AS t FROM x GROUP BY 1),
        shown AS (SELECT f, {shown_sql()} AS s FROM marks)
        SELECT p_partkey, s AS p_name, p_brand FROM part JOIN shown ON lower(p_name) = f""",
)
def mask_adjacent_consistently_part(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return mask_adjacent_consistently(part, ["p_name"], 3, ["p_partkey"])


@query(
    "mask_cyclic_part",
    """SELECT p_partkey, rtrim(array_to_string([CASE WHEN t[i] <> ' '
            AND ((i <= length(b) AND b[i] = t[i]) OR (i <= length(a) AND a[i] = t[i])) THEN '*' ELSE t[i] END
            for i in range(1, length(t) + 1)], '')) AS p_name, p_type
       FROM (SELECT p_partkey, p_type, p_name AS t,
             coalesce(lag(p_name) OVER w, last_value(p_name) OVER all_rows) AS b,
             coalesce(lead(p_name) OVER w, first_value(p_name) OVER all_rows) AS a FROM part
             WINDOW w AS (ORDER BY p_partkey), all_rows AS (ORDER BY p_partkey
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
)
def mask_cyclic_part(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return mask_cyclic(part, ["p_name"], 2, ["p_partkey"])
