"""Labels, masks, ranges and other things that results are written as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def header_labels(name: str, comment: str | None = None, delimiter: str | None = None) -> Column:
    """Labels of a sequence header: name (and comment), split at the delimiter."""
    whole = F.col(name) if comment is None else F.concat_ws(" ", F.col(name), F.when(F.col(comment) != "", F.col(comment)))
    return F.split(whole, f"\\Q{delimiter}\\E") if delimiter else F.array(whole)


def typed(value: Column) -> Column:
    """A property's value as JSON text: nan is null, numbers are floats, the rest strings."""
    as_number = value.try_cast("float")
    return F.when(value == "nan", F.lit(None).cast("string")).when(as_number.isNotNull(), as_number.cast("string")).otherwise(value)


def label_json(label: str) -> Column:
    """``sample;key=value;...`` as a struct: sample and a map of properties."""
    parts = F.split(label, ";")
    pairs = F.filter(F.slice(parts, 2, 1 << 20), lambda p: F.contains(p, F.lit("=")))
    properties = F.map_from_arrays(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)), F.transform(pairs, lambda p: typed(F.regexp_replace(p, "^[^=]*=", ""))))
    return F.struct(parts[0].alias("sample"), properties.alias("properties"))


def mask_rle(mask: Column | str) -> Column:
    """A mask of 1 and 0 as runs: 11100110 is x3o2x2o1."""
    runs = F.regexp_extract_all(mask, F.lit("0+|1+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.when(F.startswith(r, F.lit("1")), "x").otherwise("o"), F.char_length(r).cast("string"))), "")


def mask_score(mask: Column | str, k: int, match: int = 1, mismatch: int = 2) -> Column:
    """Similarity from a presence mask: runs of ones lose two at their end, missing runs are charged as likely single differences."""
    t = float(k + 3)
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a variable is evaluated once, an expression wherever it stands

    def charge(n: Column) -> Column:
        low = n / t
        snps = F.greatest(n - t + 1, low) * 0.05 + low
        return (n - snps * mismatch) * match - snps * mismatch

    def scored(lengths: Column, length: Column) -> Column:
        ones = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + F.when(x.one, x.n).otherwise(0.0)) * match
        zeros = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + F.when(x.one, 0.0).otherwise(charge(x.n)))
        return F.when((length == 0) | (ones == 0), F.lit(0)).otherwise(F.greatest((ones + zeros) * (length + k - 1) / length, F.lit(0.0)).cast("int"))

    def whole(m: Column) -> Column:
        eroded = F.replace(F.replace(F.replace(m, F.lit("110"), F.lit("zz0")), F.lit("10"), F.lit("z0")), F.lit("z"), F.lit("0"))
        each = lambda runs: F.transform(runs, lambda r, i: F.struct(F.startswith(r, F.lit("1")).alias("one"), (F.char_length(r) + F.when(i < F.size(runs) - 1, 1).otherwise(0)).cast("double").alias("n")))
        return once(once(F.regexp_extract_all(eroded, F.lit("0+|1+"), F.lit(0)), each), lambda lengths: once(F.char_length(m), lambda length: scored(lengths, length)))

    return once(F.col(mask) if isinstance(mask, str) else mask, whole)


def islands(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """by, value, first and last of the runs of consecutive pos with equal value."""
    run = F.col(pos) - F.row_number().over(Window.partitionBy(*by, value).orderBy(pos))
    return df.withColumn("_run", run).groupBy(*by, value, "_run").agg(F.min(pos).alias("first"), F.max(pos).alias("last")).drop("_run")


def count_runs(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """by and abundances: ``first-last=value`` (or ``pos=value``) of the runs of non-zero values, by place, colon-joined."""
    runs = islands(df.where(F.col(value) > 0), by, pos, value)
    shown = F.concat(F.col("first").cast("string"), F.when(F.col("last") > F.col("first"), F.concat(F.lit("-"), F.col("last").cast("string"))).otherwise(""), F.lit("="), F.col(value).cast("string"))
    return runs.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", shown.alias("s")))), lambda x: x.s), ":").alias("abundances"))


def coordinate_ranges(df: DataFrame, by: list[str], pos: str, coord: str) -> DataFrame:
    """by and coords: ``start-first-last`` of the runs along diagonals, by (end of the run, last coordinate), colon-joined."""
    runs = islands(df.withColumn("_d", F.col(coord) - F.col(pos)), by, pos, "_d")
    last = F.when(F.col("last") > F.col("first"), F.concat(F.lit("-"), (F.col("last") + F.col("_d")).cast("string"))).otherwise("")
    shown = F.concat(F.col("first").cast("string"), F.lit("-"), (F.col("first") + F.col("_d")).cast("string"), last)
    return runs.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("last", (F.col("last") + F.col("_d")).alias("c"), shown.alias("s")))), lambda x: x.s), ":").alias("coords"))


def quantile(histogram: DataFrame, by: list[str], value: str, count: str, q: float) -> DataFrame:
    """by and quantile: the first value whose running count reaches q of the total."""
    w = Window.partitionBy(*by).orderBy(value)
    total = F.sum(count).over(Window.partitionBy(*by))
    return histogram.withColumn("_run", F.sum(count).over(w)).withColumn("_all", total).where(F.col("_run") >= F.lit(q) * F.col("_all")).groupBy(*by).agg(F.min(value).alias("quantile"))


def smooth(by: list[str], pos: str, value: str, window: int) -> Column:
    """Centred moving average, the left side longer when the window is even, rounded half away from zero."""
    left = window // 2
    return F.round(F.avg(value).over(Window.partitionBy(*by).orderBy(pos).rowsBetween(-left, window - left - 1))).cast("long")
