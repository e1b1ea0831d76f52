"""Problems and completions derived from the order tables, as sample inputs.

One problem per order and one completion per line item.  The completions run
through the format's variants, right and wrong, in a fixed pattern, so the
outcome of every operator on them is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldsieve.operators.numbering import with_row_no

VARIANTS = 15
# Lines of an order that one task sorts; longer orders are numbered by many tasks.
LONG_ORDER = 1 << 20
KEY_GROUPS = 1 << 12


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _gold() -> Column:
    return F.floor("o_totalprice").cast("bigint")


def derived_problems(spark: SparkSession, folder: str) -> DataFrame:
    """``problem_id, question, answer, gold, teacher, mode``, one row per order.

    A problem with key % 101 = 7 has no gold.
    """
    key, gold = F.col("o_orderkey"), _gold()
    solution = (
        F.when(key % 50 == 7, "Add the lines.")
        .when(key % 3 == 0, F.concat(F.lit("Add the lines.\n#### "), F.format_number(gold, 0)))
        .when(key % 3 == 1, F.concat(F.lit("Add the lines.\r\n#### "), gold.cast("string")))
        .otherwise(F.concat(F.lit("Add the lines.\n#### "), gold.cast("string")))
    )
    return table(spark, folder, "orders").select(
        key.alias("problem_id"),
        F.concat(F.lit("Order "), key.cast("string"), F.lit(": what is the total?")).alias(
            "question"
        ),
        solution.alias("answer"),
        F.when(key % 101 != 7, gold.cast("string")).alias("gold"),
        F.col("o_orderpriority").alias("teacher"),
        F.col("o_orderstatus").alias("mode"),
    )


def _with_text(samples: DataFrame) -> DataFrame:
    """Add the completion's ``text``, from ``variant, sample_no, _gold``.

    Its parts are columns of their own, so that each is computed once, by code small
    enough to be compiled.
    """
    variant, number = F.col("variant"), F.col("_gold").cast("string")
    reason, answer, whole = F.col("_reason"), F.col("_answer"), F.col("_whole")
    closing = F.rtrim(F.repeat(F.lit("hum "), 10))
    answered = (
        F.when(variant == 5, F.format_number("_gold", 0))
        .when(variant == 6, F.concat(number, F.lit(".0")))
        .when(variant == 7, F.concat(F.lit("$"), number))
        .when(variant == 8, (F.col("_gold") + 1).cast("string"))
        .when(variant == 14, " ")
        .otherwise(number)
    )
    reasoned = F.when(variant == 11, "hm").otherwise(
        F.rtrim(F.repeat(F.lit("drift "), F.lit(6) + F.col("sample_no")))
    )
    first = F.concat(F.lit("<trip_before>"), reason, F.lit("</trip_before>"))
    second = F.when(
        variant == 10, F.concat(F.lit("The answer is "), answer, F.lit("."))
    ).otherwise(F.concat(F.lit("<answer>"), answer, F.lit("</answer>")))
    last = F.concat(
        F.lit("<end>"),
        F.when(variant == 13, " \n ").otherwise(closing),
        F.when(variant.isin(1, 13), "").otherwise("</end>"),
    )
    upper = F.concat_ws(
        "\n",
        F.concat(F.lit("<TRIP_BEFORE>"), reason, F.lit("</TRIP_BEFORE>")),
        F.concat(F.lit("<ANSWER>"), answer, F.lit("</ANSWER>")),
        F.concat(F.lit("<END>"), closing, F.lit("</END>")),
    )
    escaped = F.replace(
        F.replace(whole, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")
    )
    text = (
        F.when(variant == 2, F.concat(F.lit("```xml\n"), whole, F.lit("\n```")))
        .when(variant == 3, escaped)
        .when(variant == 9, F.concat(F.lit("Sure:\n"), whole))
        .when(variant == 12, F.concat(whole, F.lit("\nbye")))
        .otherwise(whole)
    )
    return (
        samples.withColumns({"_reason": reasoned, "_answer": answered})
        .withColumn(
            "_whole", F.when(variant == 4, upper).otherwise(F.concat_ws("\n", first, second, last))
        )
        .withColumn("text", text)
        .drop("_reason", "_answer", "_whole")
    )


def _long_orders(keys: DataFrame) -> list:
    """The keys in more than ``LONG_ORDER`` lines: at most one in so many lines.

    Lines are counted by ``KEY_GROUPS`` groups of keys first, which moves a few rows a task;
    keys are counted only in groups that have so many lines.
    """
    many = F.col("count") > LONG_ORDER
    group = F.pmod(F.xxhash64("l_orderkey"), F.lit(KEY_GROUPS))
    groups = [row[0] for row in keys.groupBy(group.alias("group")).count().where(many).collect()]
    if not groups:
        return []
    counted = keys.where(group.isin(groups)).groupBy("l_orderkey").count()
    return [row[0] for row in counted.where(many).collect()]


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """``l_orderkey, sample_no`` of every line that has an order key.

    An order's lines meet in one task, which keeps them by spilling.  Orders of more than
    ``LONG_ORDER`` lines take a global row number less the first one of the order.
    """
    long = _long_orders(lines.where("l_orderkey IS NOT NULL").select("l_orderkey"))
    is_long = F.col("l_orderkey").isin(long) if long else F.lit(False)
    columns = [name for name in lines.columns if name != "l_orderkey"]
    in_order = Window.partitionBy("l_orderkey").orderBy(*columns)
    short = lines.where(F.col("l_orderkey").isNotNull() & ~is_long).select(
        "l_orderkey", F.row_number().over(in_order).alias("sample_no")
    )
    if not long:
        return short
    placed = with_row_no(
        lines.where(is_long), lines.columns, keep=["l_orderkey"], spread_ties=True
    )
    starts = placed.groupBy("l_orderkey").agg(F.min("row_no").alias("_start"))
    numbered = placed.join(starts, "l_orderkey").select(
        "l_orderkey", (F.col("row_no") - F.col("_start") + 1).cast("int").alias("sample_no")
    )
    return short.unionByName(numbered)


def derived_completions(spark: SparkSession, folder: str) -> DataFrame:
    """``problem_id, sample_no, variant, text``, one row per line item, and orphans.

    The completions of an order with key % 89 = 3 come once more under the negative
    key, which no problem has.
    ``sample_no`` counts the lines of an order from 1, in the order of all
    their columns.
    """
    placed = _numbered_lines(table(spark, folder, "lineitem"))
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), _gold().alias("_gold")
    )
    key = F.col("l_orderkey")
    ids = F.when(key % 89 == 3, F.array(key, -key)).otherwise(F.array(key))
    samples = placed.join(orders, "l_orderkey").select(
        F.explode(ids).alias("problem_id"),
        "sample_no",
        "_gold",
    )
    variant = ((F.abs("problem_id") + F.col("sample_no")) % VARIANTS).cast("int")
    return _with_text(samples.withColumn("variant", variant)).select(
        "problem_id", "sample_no", "variant", "text"
    )
