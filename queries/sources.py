"""Sources and sinks: whole tables written by Spark and read back."""

from pyspark.sql import functions as F

from duskveil.plans.scratch import scratch_path
from duskveil.sources.arrays import arrays_to_rows
from duskveil.sources.catalogue import dataset_names, dataset_versions, read_catalogue
from duskveil.sources.tables import read_csv, read_table, write_csv, write_parquet
from queries.registry import query, read


@query(
    "csv_round_trip_customer",
    "SELECT c_custkey, c_name, c_nationkey::bigint AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def csv_round_trip_customer(spark, sf_dir):
    path = write_csv(read(spark, sf_dir, "customer"), scratch_path(spark))
    return read_csv(spark, path)


@query(
    "csv_round_trip_documents",
    "SELECT doc_id, text, lang FROM documents",
)
def csv_round_trip_documents(spark, sf_dir):
    path = write_csv(read(spark, sf_dir, "documents").drop("n_chars"), scratch_path(spark))
    return read_csv(spark, path, ["doc_id", "text", "lang"], multi_line=True)


@query(
    "csv_dates_orders",
    "SELECT o_orderkey, o_orderdate FROM orders",
)
def csv_dates_orders(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    path = write_csv(orders, scratch_path(spark) + ".csv")
    return read_table(spark, path, ["o_orderkey", "o_orderdate"])


@query(
    "csv_keeps_text_identifiers",
    """SELECT l_orderkey, l_linenumber::bigint AS l_linenumber, l_linenumber || 'd' AS day, l_linenumber || 'f' AS floor,
              l_quantity, CASE WHEN l_linenumber = 1 THEN 'Infinity'::double ELSE l_tax END AS bound,
              '0x' || l_linenumber || 'p3' AS code FROM lineitem""",
)
def csv_keeps_text_identifiers(spark, sf_dir):
    """Identifiers that a cast would read as numbers, beside numbers."""
    number = F.col("l_linenumber").cast("string")
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(number, F.lit("d")).alias("day"),
        F.concat(number, F.lit("f")).alias("floor"),
        "l_quantity",
        F.when(F.col("l_linenumber") == 1, "Infinity").otherwise(F.col("l_tax").cast("string")).alias("bound"),
        F.concat(F.lit("0x"), number, F.lit("p3")).alias("code"),
    )
    return read_csv(spark, write_csv(lines, scratch_path(spark)))


@query("parquet_round_trip_lineitem", "SELECT * FROM lineitem")
def parquet_round_trip_lineitem(spark, sf_dir):
    path = write_parquet(read(spark, sf_dir, "lineitem"), scratch_path(spark))
    return spark.read.parquet(path)


def _catalogue(spark, sf_dir):
    """The sources of the documents as datasets, their languages as versions."""
    entries = (
        read(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("name"))
        .agg(F.array_sort(F.collect_set("lang")).alias("versions"))
        .agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "versions")))).alias("value"))
    )
    path = scratch_path(spark)
    entries.write.text(path)
    return read_catalogue(spark, path)


@query("catalogue_names", "SELECT DISTINCT source AS name FROM documents")
def catalogue_names(spark, sf_dir):
    return dataset_names(_catalogue(spark, sf_dir))


@query(
    "catalogue_versions",
    """SELECT DISTINCT lang AS version FROM documents
       WHERE source = (SELECT min(source) FROM documents)""",
)
def catalogue_versions(spark, sf_dir):
    first = read(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    return dataset_versions(_catalogue(spark, sf_dir), first)


@query(
    "arrays_to_rows_embeddings",
    """SELECT vec_id, cast(i - 1 AS int) AS pos, embedding[i] AS a, embedding[i + 8] AS b FROM
       (SELECT vec_id, embedding, unnest(range(1, length(embedding) - 8 + 1)) AS i FROM embeddings)""",
)
def arrays_to_rows_embeddings(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("embedding").alias("a"),
        F.slice("embedding", F.lit(9), F.size("embedding")).alias("b"),
        F.col("label"),
    )
    return arrays_to_rows(vectors, ["a", "b", "label", "absent"], keep=["vec_id"])
