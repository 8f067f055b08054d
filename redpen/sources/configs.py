"""Reviewers' rule files: JSON in, clean rule tables out, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from redpen.functions import text as t

# The keys of rule files.
IGNORE_KEYS = {
    "ignore_deprecated_phrases": "deprecated_phrase",
    "ignore_rewrite_from_phrases": "rewrite_from",
    "ignore_diagnostic_codes": "code",
    "ignore_message_contains": "message",
}
REWRITE_KEYS = {"accepted_rewrites": "accept", "rejected_rewrites": "reject"}
DIAGNOSTIC_KEYS = {"accepted_diagnostics": "accept", "rejected_diagnostics": "reject"}


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one ``json`` text per row; none when nothing is there."""
    found = spark.read.format("binaryFile").load(path) if _exists(spark, path) else None
    if found is None:
        return spark.createDataFrame([], "json string")
    return found.select(F.decode("content", "UTF-8").alias("json"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _items(configs: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
    """One row per array item under the given keys, as a variant."""
    lists = F.array(
        *[
            F.struct(
                F.lit(value).alias(name),
                F.try_variant_get("config", f"$.{key}", "array<variant>").alias("items"),
            )
            for key, value in keys.items()
        ]
    )
    keep = [c for c in configs.columns if c != "json"]
    opened = configs.select(*keep, F.try_parse_json("json").alias("config")).select(*keep, F.inline(lists))
    return opened.select(*keep, name, F.posexplode("items").alias("pos", "item"))


def _field(name: str) -> Column:
    return t.strip(F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit("")))


def ignore_rules(configs: DataFrame) -> DataFrame:
    """kind, pos, value; blank values are dropped."""
    rules = _items(configs, IGNORE_KEYS, "kind").withColumn("value", F.try_variant_get("item", "$", "string"))
    return rules.filter(t.strip(F.col("value")) != "").drop("item")


def feedback_rewrites(configs: DataFrame) -> DataFrame:
    """decision, pos, from_text, to_text; both texts are needed."""
    rules = _items(configs, REWRITE_KEYS, "decision").withColumns({"from_text": _field("from"), "to_text": _field("to")})
    return rules.filter("from_text <> '' and to_text <> ''").drop("item")


def feedback_diagnostics(configs: DataFrame) -> DataFrame:
    """decision, pos, code, message_contains; one of the two is needed."""
    rules = _items(configs, DIAGNOSTIC_KEYS, "decision").withColumns(
        {"code": _field("code"), "message_contains": _field("message_contains")}
    )
    return rules.filter("code <> '' or message_contains <> ''").drop("item")


def suppression_rules(feedback: DataFrame, ignored: DataFrame) -> DataFrame:
    """Diagnostic decisions and ignore rules as one table for ``checks.suppress``."""
    kinds = ignored.filter("kind in ('code', 'message')").select(
        F.lit("ignore").alias("decision"),
        F.when(F.col("kind") == "code", F.col("value")).otherwise("").alias("code"),
        F.when(F.col("kind") == "message", F.col("value")).otherwise("").alias("message_contains"),
    )
    return feedback.select("decision", "code", "message_contains").unionByName(kinds)
