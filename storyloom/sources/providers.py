"""Model providers as a table: which of them can be asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live(providers: DataFrame, exhausted: DataFrame) -> DataFrame:
    """Providers with a key that isn't blank, less those that have run out of quota."""
    return providers.where(F.trim(F.coalesce("key", F.lit(""))) != "").join(exhausted, "provider", "left_anti")


def zero_cost(models: DataFrame) -> DataFrame:
    """Models whose two prices are numbers and zero, by falling context length."""
    free = (F.col("prompt").try_cast("double") == 0) & (F.col("completion").try_cast("double") == 0)
    return models.where(F.coalesce(free, F.lit(False))).orderBy(F.desc("context"), "model")


def key_status(providers: DataFrame) -> DataFrame:
    """One row: NAME=set or NAME=MISSING for each key, in order of names."""
    each = providers.groupBy("key_env").agg(F.bool_or(F.trim(F.coalesce("key", F.lit(""))) != "").alias("ok"))
    word = F.concat("key_env", F.lit("="), F.when(F.col("ok"), "set").otherwise("MISSING"))
    return each.agg(F.array_join(F.array_sort(F.collect_list(word)), " ").alias("status"))
