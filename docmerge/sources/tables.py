"""Warehouse tables seen as files, extraction results, raw keys and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmerge.operators.ordering import with_small_positions
from docmerge.schemas import PivotPreset, TemplateColumn

# Template of the order documents: four single columns, five repeating ones.
ORDER_TEMPLATE = [
    *[TemplateColumn(k, "string", k) for k in ("customer", "segment", "status", "priority")],
    *[TemplateColumn(k, "string", k, repeating=True) for k in ("line", "flag", "linestatus", "qty", "part")],
]
ORDER_PRESET = PivotPreset(pivot_key="linestatus", prefix="flag", values=("qty", "part"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_from_table(
    df: DataFrame, file_id: str, file_name: str, text: str, seq: str | None = None, session: str | None = None
) -> DataFrame:
    """Any table with inline text as a files table."""
    return df.select(
        (F.col(session) if session else F.lit(None).cast("string")).alias("session_id"),
        F.col(file_id).cast("string").alias("file_id"),
        F.col(file_name).alias("file_name"),
        F.col(seq or file_id).cast("bigint").alias("file_seq"),
        F.octet_length(text).cast("bigint").alias("size"),
        F.lit("text/plain").alias("mime"),
        F.col(text).alias("text"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table with file names that fall into one group per source."""
    stem, n = F.concat("source", F.lit("x")), F.col("doc_id").cast("string")
    name = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(stem, F.lit("-"), n, F.lit(".txt")))
        .when(F.col("doc_id") % 5 == 1, F.concat(stem, F.lit(" ("), n, F.lit(").txt")))
        .when(F.col("doc_id") % 5 == 2, F.concat(stem, F.lit("_"), n, F.lit(".md")))
        .when(F.col("doc_id") % 5 == 3, F.concat(stem, F.lit("_copy.txt")))
        .otherwise(F.concat(stem, F.lit(" copy "), n, F.lit(".txt")))
    )
    docs = table(spark, sf_dir, "documents").withColumn("name", name)
    return documents_from_table(docs, "doc_id", "name", "text", session="lang")


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extraction result per order; the group is the customer."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    cust = F.concat(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("x"))
    header = F.to_json(
        F.struct(
            F.col("c_name").alias("customer"),
            F.col("c_mktsegment").alias("segment"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
        )
    )
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_custkey").cast("string").alias("session_id"),
        cust.alias("group_id"),
        F.col("o_orderkey").cast("string").alias("file_id"),
        F.concat(cust, F.lit("-"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("file_name"),
        F.col("o_orderkey").alias("file_seq"),
        ((F.col("o_orderkey") % 17 != 0) & (F.col("o_custkey") % 101 != 0)).alias("success"),
        header.alias("header_json"),
        F.col("o_orderdate").alias("created_at"),
    )


def order_lines(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """Line items as a long entry table.

    Lines are placed in their order by one window; an order that holds a large share of all lines is
    counted per (order, line number, part) bucket.
    """
    lines = table(spark, sf_dir, "lineitem")
    entry = F.to_json(
        F.struct(
            F.col("l_linenumber").alias("line"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("linestatus"),
            F.col("l_quantity").cast("bigint").alias("qty"),
            F.col("l_partkey").alias("part"),
        )
    )
    if numbered:
        order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
        lines = with_small_positions(
            lines.select("l_orderkey", *order, "l_returnflag", "l_linestatus"),
            ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")], order, out="entry_idx",
        )
        entry_idx = F.col("entry_idx")
    else:
        entry_idx = F.lit(0).cast("bigint")
    return lines.select(
        F.col("l_orderkey").cast("string").alias("file_id"), entry_idx.alias("entry_idx"), entry.alias("entry_json")
    )


def raw_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names decorated the way models decorate them: (key_id, raw_key)."""
    parts = table(spark, sf_dir, "part")
    base = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(
        F.col("p_name")
    )
    m = F.col("p_partkey") % 8
    decorated = (
        F.when(m == 0, base)
        .when(m == 1, F.concat(F.lit("1-"), base))
        .when(m == 2, F.concat(F.lit("12—"), base, F.lit("{")))
        .when(m == 3, F.concat(F.lit("检验结果4-"), base, F.lit("{:")))
        .when(m == 4, F.concat(F.lit("血常规-"), base, F.lit(",'")))
        .when(m == 5, F.concat(F.lit("基本信息-2-"), base, F.lit(" ")))
        .when(m == 6, F.translate(base, "ABCDEabcde#", "ＡＢＣＤＥａｂｃｄｅ＃"))
        .otherwise(F.concat(F.lit("　"), base, F.lit("　:")))
    )
    return parts.select(F.col("p_partkey").alias("key_id"), decorated.alias("raw_key"))


def number_like_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names among measurements, dates and numbers that stand where a name should be."""
    parts = table(spark, sf_dir, "part")
    price, n = F.round(F.col("p_retailprice") * 100).cast("bigint"), F.col("p_partkey").cast("string")
    cents = F.concat((price / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((price % 100).cast("string"), 2, "0"))
    m = F.col("p_partkey") % 12
    key = (
        F.when(m == 0, F.concat(cents, F.lit("L/L")))
        .when(m == 1, F.concat(cents, F.lit("%{")))
        .when(m == 2, cents)
        .when(m == 3, F.concat(F.lit("16.22."), (F.col("p_partkey") % 256).cast("string"), F.lit(".45")))
        .when(m == 4, F.lit("2024/01/15"))
        .when(m == 5, F.lit("08:30"))
        .when(m == 6, n)
        .when(m == 7, F.substring("p_name", 1, 1))
        .when(m == 8, F.lit("T"))
        .when(m == 9, F.lit("↑"))
        .when(m == 10, F.concat(n, F.lit("mmol("), cents, F.lit(")")))
        .otherwise(F.col("p_name"))
    )
    return parts.select(F.col("p_partkey").alias("key_id"), key.alias("raw_key"))


def result_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three attempts per order with their success and field count."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k, a = F.col("o_orderkey"), F.col("attempt")
    attempts = F.filter(
        F.array(
            F.lit(1), F.when(k % 3 == 0, F.lit(2)), F.when(k % 7 == 0, F.lit(3))
        ),
        lambda x: x.isNotNull(),
    )
    return orders.withColumn("attempt", F.explode(attempts)).select(
        F.col("o_custkey").cast("string").alias("session_id"),
        k.cast("string").alias("file_id"),
        F.concat(F.lit("order-"), k.cast("string"), F.lit(".txt")).alias("file_name"),
        F.concat(F.lit("g"), a.cast("string")).alias("group_id"),
        k.alias("file_seq"),
        a.alias("attempt"),
        a.cast("bigint").alias("result_seq"),
        ((k + a) % 4 != 0).alias("success"),
        ((k * a) % 6).alias("n_fields"),
        F.when((k + a) % 4 == 0, F.concat(F.lit("attempt "), a.cast("string"), F.lit(" failed"))).alias("error"),
        F.col("o_orderdate").alias("created_at"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a run log."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("event"), F.col("props").alias("data"), "ts", F.col("user_id").cast("string").alias("file_id")
    )


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers and totals wrapped in the ways models wrap JSON."""
    orders = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    body = F.to_json(F.struct(status.alias("status"), priority.alias("priority"), F.col("o_custkey").alias("customer")))
    m = F.col("o_orderkey") % 8
    text = (
        F.when(m == 0, body)
        .when(m == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(m == 2, F.concat(F.lit("The result is "), body, F.lit(" as asked.")))
        .when(m == 3, F.concat(F.lit('{"a":1} then '), body))
        .when(m == 4, F.concat(F.lit("["), body, F.lit("]")))
        .when(m == 5, F.concat(F.lit("status: "), status, F.lit(", priority: "), priority))
        .when(m == 6, F.concat(F.lit("状态："), status, F.lit("，优先级："), priority))
        .otherwise(F.lit(" "))
    )
    return orders.select(F.col("o_orderkey").cast("string").alias("file_id"), F.col("o_orderkey").alias("file_seq"), text.alias("response"))
