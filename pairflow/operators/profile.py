"""Dataset reports: crosstabs, validation, sample statistics, feature summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions.text import blank_word_count
from pairflow.operators.ranges import carried_in, inside, ranged
from pairflow.workspace import broadcast_if_small, materialize

LABEL_COLUMNS = domain.LABELS + [domain.UNKNOWN_LABEL]


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts and shares, most frequent first.

    The column may have any number of values, so the total is a scalar subquery over the counts
    rather than a window without partition.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.col("n").desc(), col)


def value_counts_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, share) of several columns from one pass over the source."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # Every row counts once per column, so the total is the same for all of them.
    total = counts.agg(F.sum("n") / len(columns)).scalar()
    return counts.withColumn("share", F.col("n") / total)


def crosstab(df: DataFrame, row: str = "genre", col: str = "label", values: list[str] | None = None) -> DataFrame:
    values = values or LABEL_COLUMNS
    return df.groupBy(row).pivot(col, values).count().fillna(0, values)


def crosstab_with_margins(df: DataFrame, row: str = "genre", col: str = "label",
                          values: list[str] | None = None) -> DataFrame:
    """As crosstab, with an "All" row and column; the cube runs over the counted cells."""
    values = values or LABEL_COLUMNS
    cells = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    cube = cells.cube(row, col).agg(F.sum("n").alias("n"), F.grouping(row).alias("_gr"), F.grouping(col).alias("_gc"))
    named = cube.select(
        F.when(F.col("_gr") == 1, F.lit("All")).otherwise(F.col(row)).alias(row),
        F.when(F.col("_gc") == 1, F.lit("All")).otherwise(F.col(col)).alias(col), "n")
    names = values + ["All"]
    return named.groupBy(row).pivot(col, names).agg(F.sum("n")).fillna(0, names)


def validation_report(df: DataFrame) -> DataFrame:
    """Rows, genres, nulls per column, label counts and unknown labels in one row."""
    nulls = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in df.columns}
    cells = df.groupBy("genre", "label").agg(
        F.count(F.lit(1)).alias("n"), *[e.alias(a) for a, e in nulls.items()])
    genres = F.sort_array(F.collect_set("genre"))  # one row per (genre, label) is left here
    unknown = F.sum(F.when(F.col("label") == domain.UNKNOWN_LABEL, F.col("n")))
    return cells.agg(
        F.sum("n").alias("total_samples"),
        F.count_distinct("genre").alias("unique_genres"),
        F.array_join(genres, ",").alias("genres"),
        F.coalesce(unknown, F.lit(0)).cast("long").alias("unknown_labels"),
        *[F.coalesce(F.sum(F.when(F.col("label") == l, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{l}") for l in domain.LABELS],
        *[F.sum(a).alias(a) for a in nulls])


def sample_statistics(df: DataFrame) -> DataFrame:
    """Per genre: total and a label -> count map; plus the whole table's size, label counts and mean word counts.

    The whole table's figures are scalar subqueries, as genres may be of any number.
    """
    cells = df.groupBy("genre", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(blank_word_count("premise")).alias("_p"),
        F.sum(blank_word_count("hypothesis")).alias("_h"))
    per_genre = cells.groupBy("genre").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("labels"),
        F.sum("_p").alias("_p"), F.sum("_h").alias("_h"))
    whole = lambda value: cells.agg(value).scalar()
    total = whole(F.sum("n"))
    count_of = lambda l: F.coalesce(whole(F.sum(F.when(F.col("label") == l, F.col("n")))), F.lit(0))
    return per_genre.withColumns({
        "total_samples": total, "avg_premise_words": whole(F.sum("_p")) / total, "avg_hypothesis_words": whole(F.sum("_h")) / total,
        **{f"all_{l}": count_of(l).cast("long") for l in domain.LABELS},
    }).drop("_p", "_h")


def mean_word_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(blank_word_count("premise")).alias("avg_premise_words"),
                  F.avg(blank_word_count("hypothesis")).alias("avg_hypothesis_words"))


def split_check(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows, genres and label counts of each stored split."""
    cells = df.groupBy(split, "genre", "label").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(split).agg(
        F.sum("n").alias("samples"), F.count_distinct("genre").alias("genres"),
        *[F.coalesce(F.sum(F.when(F.col("label") == l, F.col("n"))), F.lit(0)).cast("long").alias(l)
          for l in domain.LABELS])


def mean_by_genre(df: DataFrame, col: str = "total_negations", key: str = "genre") -> DataFrame:
    return df.groupBy(key).agg(F.avg(col).alias(f"mean_{col}")).orderBy(F.col(f"mean_{col}").desc(), key)


def correlations(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of features, both ways and with the diagonal.

    One aggregate; each pair ignores only the rows in which one of its own two features is null, and a feature
    without variance has no correlation. The columns are written once, as the aggregate names each of them many
    times and would otherwise work out the features anew for every mention.
    """
    names = names or domain.MODEL_FEATURES
    df = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in names]), "features")
    n = len(names)
    value = lambda i: F.col(names[i]).cast("double")

    def correlation(i: int, j: int) -> Column:
        # The built-in corr divides by a variance of zero, which is an error in ANSI mode.
        x = F.when(value(j).isNotNull(), value(i))
        y = F.when(value(i).isNotNull(), value(j))
        return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))

    wide = df.agg(*[correlation(i, j).alias(f"_{i}_{j}") for i in range(n) for j in range(i, n)])
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                      F.col(f"_{min(i, j)}_{max(i, j)}").alias("correlation"))
             for i, a in enumerate(names) for j, b in enumerate(names)]
    return wide.select(F.inline(F.array(*cells)))


# --- exact quantiles -------------------------------------------------------------------------

def value_table(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, value, n): distinct values with their counts, combined before the shuffle.

    Written once: quantiles and moments then read this small table and never the source again.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*keys, F.inline(entries)).where(F.col("value").isNotNull())
    return materialize(long.groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("n")), "values")


def exact_quantiles(values: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles (one column each) of (keys, feature, value, n).

    The built-in exact percentile gathers a group's values in one buffer. Here the distinct values are written in
    ranges of equal shares; counts per range tell which ranges hold the wanted positions, and only those are ranked.
    """
    group = [*keys, "feature"]
    cut = ranged(values, *group, "value")
    parts = cut.groupBy(*group, "_range").agg(F.sum("n").alias("_n"))
    cumulative = parts.join(carried_in(parts, group, _start=F.sum("_n")), [*group, "_range"]).withColumns({
        "_start": F.coalesce("_start", F.lit(0)), "_total": F.sum("_n").over(W.partitionBy(*group))})
    cumulative = cumulative.withColumn("_end", F.col("_start") + F.col("_n"))
    positions = F.array(*[
        F.struct(F.lit(name).alias("_q"), ((F.col("_total") - 1) * F.lit(float(p))).alias("_pos"))
        for name, p in probabilities.items()])
    # Position p needs the values at floor(p) and ceil(p), which may lie in different ranges.
    wanted = cumulative.select(*group, "_range", "_start", "_end", F.inline(positions))
    wanted = wanted.select(*group, "_range", "_start", "_end", "_q", "_pos", F.explode(
        F.array(F.floor("_pos"), F.ceil("_pos"))).alias("_at"))
    wanted = wanted.where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_end")))
    needed = wanted.groupBy(*group, "_range").agg(
        F.max("_start").alias("_start"), F.collect_set(F.struct("_q", "_pos", "_at")).alias("_wants"))
    ranked = cut.join(broadcast_if_small(needed), [*group, "_range"]).withColumn(
        "_hi", F.col("_start") + F.sum("n").over(inside(group, "value")))
    hits = ranked.select(*group, "value", "n", "_hi", F.inline("_wants")).where(
        (F.col("_at") < F.col("_hi")) & (F.col("_at") >= F.col("_hi") - F.col("n")))
    low = F.max(F.when(F.col("_at") == F.floor("_pos"), F.col("value")))
    high = F.max(F.when(F.col("_at") == F.ceil("_pos"), F.col("value")))
    share = F.max(F.col("_pos") - F.floor("_pos"))
    per_q = hits.groupBy(*group, "_q").agg((low + (high - low) * share).alias("_v"))
    return per_q.groupBy(*group).agg(*[
        F.max(F.when(F.col("_q") == name, F.col("_v"))).alias(name) for name in probabilities])


def feature_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of each feature, all from the table of distinct values."""
    columns = columns or domain.MODEL_FEATURES
    values = value_table(df, columns, [])
    quartiles = exact_quantiles(values, [], {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    n, v = F.col("n"), F.col("value")
    first = values.groupBy("feature").agg(
        F.sum("n").alias("count"), F.try_divide(F.sum(n * v), F.sum("n")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    squares = values.join(first.select("feature", "mean"), "feature").groupBy("feature").agg(
        F.sum(n * F.pow(v - F.col("mean"), 2)).alias("_ss"))
    moments = first.join(squares, "feature").withColumn(
        "std", F.sqrt(F.try_divide(F.col("_ss"), F.col("count") - 1))).drop("_ss")
    return moments.join(quartiles, "feature", "left").select(
        "feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def box_stats(df: DataFrame, column: str, key: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and outlier count of each group.

    Whiskers are looked up in the distinct values of a group rather than in its rows.
    """
    values = value_table(df, [column], [key])
    q = exact_quantiles(values, [key], {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    iqr = F.col("q75") - F.col("q25")
    inside = (F.col("value") >= F.col("q25") - 1.5 * iqr) & (F.col("value") <= F.col("q75") + 1.5 * iqr)
    return values.join(q, [key, "feature"]).groupBy(key, "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("long").alias("n_outliers"),
        F.sum("n").alias("n"))
