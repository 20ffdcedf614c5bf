"""Keys of a score along dimensions, and the statistics of every key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def legacy_keys(metric: Column, dirs: Column, root: Column, kind: Column | None = None) -> Column:
    """label@directory for every directory above the file, and label@root@type where there is a type."""
    keys = F.transform(dirs, lambda d: F.concat(metric, F.lit("@"), d))
    if kind is None:
        return keys
    typed = F.when(kind.isNotNull(), F.array(F.concat_ws("@", metric, root, kind))).otherwise(F.array().cast("array<string>"))
    return F.concat(keys, typed)


def dimension_keys(metric: Column, dimensions: list[tuple[str, Column, bool]], hierarchical: bool = False) -> Column:
    """label@dimension:value of every dimension (name, value, whether the value is a list); null gives none.

    The hierarchical form adds the joined key of all dimensions, from the first
    element of lists, where no value is missing.
    """
    def labelled(label: Column) -> Callable[[Column], Column]:
        return lambda v: F.concat(metric, F.lit("@"), label, v)  # a second parameter would be the element's index

    flat, parts = [], []
    for name, value, many in dimensions:
        label = F.lit(f"{name}:")
        values = value if many else F.array(value)
        flat.append(F.transform(F.filter(values, lambda v: v.isNotNull()), labelled(label)))
        first = F.when(F.size(values) > 0, F.element_at(values, 1)) if many else value
        parts.append(F.concat(label, first))
    keys = [F.coalesce(k, F.array().cast("array<string>")) for k in flat]
    if hierarchical and len(dimensions) > 1:
        whole = F.concat(metric, F.lit("@"), parts[0], *[F.concat(F.lit("/"), p) for p in parts[1:]])
        keys.append(F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array().cast("array<string>")))
    return F.concat(*keys)


def statistics(keyed: DataFrame, key: str = "key") -> DataFrame:
    """(key, n_total, mean, median, std, n_ref) from (key, value, n_ref): exact median, population deviation."""
    return keyed.groupBy(key).agg(
        F.count("*").alias("n_total"),
        F.avg("value").alias("mean"),
        F.median("value").alias("median"),
        F.stddev_pop("value").alias("std"),
        F.sum("n_ref").alias("n_ref"),
    )


def cleaned_statistics(keyed: DataFrame, key: str = "key", fence: float = 1.5, standard: bool = False, least_std: float = 1.0) -> DataFrame:
    """`statistics`, and the same without outliers where any were dropped (n_cleaned, mean_cleaned, ...).

    Keys of more than one value and a deviation of at least `least_std` are
    cleaned: quartiles are the medians below and above the median, and values
    stay from the first quartile less `fence` ranges to the first (with
    `standard`: the third) plus as many. Without a value on a side of the
    median there is no quartile, and no value stays.

    Two aggregations and two joins on the key; all carry the same partitioning.
    """
    whole = statistics(keyed, key)
    middle = whole.where((F.col("n_total") > 1) & (F.col("std") >= least_std)).select(key, F.col("median").alias("m"))
    near = keyed.join(middle, key)
    quartile = near.groupBy(key).agg(F.median(F.when(F.col("value") < F.col("m"), F.col("value"))).alias("q1"), F.median(F.when(F.col("value") > F.col("m"), F.col("value"))).alias("q3"))
    reach = fence * (F.col("q3") - F.col("q1"))
    kept = near.join(quartile, key).where((F.col("value") >= F.col("q1") - reach) & (F.col("value") <= (F.col("q3") if standard else F.col("q1")) + reach))
    again = statistics(kept.select(key, "value", "n_ref"), key)
    for c in ("mean", "median", "std", "n_ref"):
        again = again.withColumnRenamed(c, f"{c}_cleaned")
    again = again.withColumnRenamed("n_total", "n_cleaned")
    judged = whole.join(middle.select(key, F.lit(True).alias("judged")), key, "left").join(again, key, "left")
    n = F.when(F.col("judged"), F.coalesce("n_cleaned", F.lit(0)))
    dropped = n < F.col("n_total")
    shown = [F.when(dropped, F.col(f"{c}_cleaned")).alias(f"{c}_cleaned") for c in ("mean", "median", "std", "n_ref")]
    return judged.select(key, "n_total", "mean", "median", "std", "n_ref", F.when(dropped, n).alias("n_cleaned"), *shown)


def report(stats: DataFrame, key: str = "key") -> DataFrame:
    """(key, line): the printed form of every key's statistics, in order of the keys."""
    plain = F.format_string("%s n:%d refs:%d mean:%.2f [median:%.2f std:%.2f]", F.col(key), F.col("n_total"), F.col("n_ref"), F.col("mean"), F.col("median"), F.col("std"))
    return stats.select(F.col(key).alias("key"), plain.alias("line")).orderBy("key")
