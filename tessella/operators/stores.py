"""Operations on stored rows: differences, request keys, replacements, numbering, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut


def differences(written: DataFrame, now: DataFrame) -> DataFrame:
    """(side, id): ids only `written` has (lost) and only `now` has (new), each once; null ids are left out."""
    only = lambda rows, other, side: rows.filter("id is not null").distinct().join(other, "id", "left_anti").select(F.lit(side).alias("side"), "id")
    return only(written, now, "lost").unionByName(only(now, written, "new"))


def request_key(parts: dict[str, Column]) -> Column:
    """SHA-256 of the JSON of `parts` with its keys sorted, without blanks, nulls left out."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))), 256)


def merged(json: Column, more: dict[str, str]) -> Column:
    """The map of a JSON object with `more` over it; null where it is no object."""
    held = F.from_json(json, "map<string,string>")
    kept = F.map_filter(held, lambda k, _: ~k.isin(*more))
    return F.map_concat(kept, F.create_map(*(F.lit(x) for pair in more.items() for x in pair)))


def names_subject(question: Column, title: Column) -> Column:
    """Whether they share a word of three letters or more; nulls share none."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    return F.coalesce(F.arrays_overlap(words(question), words(title)), F.lit(False))


def numbered(rows: DataFrame, group: str, by: str) -> DataFrame:
    """`rows` with `number`, from 1 in each group in the order of `by`, which is unique in a group.

    Rows are counted by range of the order first, so that no group has to fit one task:
    a range's rows are numbered apart, and start where the ranges before it end. The ranges are
    written down, as they have to be the same for both uses.
    """
    ranged = cut(rows.repartitionByRange(group, by).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy(group, "range").agg(F.count("*").alias("held"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(group, "range").orderBy(by))
    return ranged.withColumn("inside", inside).join(starts, [group, "range"]).select(*rows.columns, (F.col("inside") + F.col("start")).cast("int").alias("number"))


def replaced(broken: DataFrame, unused: DataFrame) -> DataFrame:
    """(id, type, replacement): the n-th broken item of a type gets its n-th unused one; null where none is left."""
    given = numbered(unused.select("id", "type"), "type", "id").select(F.col("id").alias("replacement"), "type", "number")
    return numbered(broken.select("id", "type"), "type", "id").join(given, ["type", "number"], "left").select("id", "type", "replacement")


def set_problems(rows: DataFrame) -> DataFrame:
    """(run_id, n, n_wrong, problems) of sets (run_id, gold_type, f1): 12 to 16 items, three types with
    four each, two wrong at least. A null score isn't wrong."""
    types = rows.groupBy("run_id", "gold_type").agg(F.count("*").alias("n"), F.count_if(F.col("f1") < 0.5).alias("wrong"))
    sets = types.groupBy("run_id").agg(
        F.sum("n").alias("n"), F.sum("wrong").alias("n_wrong"), F.count_if(F.col("gold_type").isNotNull() & (F.col("n") >= 4)).alias("types")
    )
    rules = (F.when(~F.col("n").between(12, 16), "size"), F.when(F.col("types") < 3, "types"), F.when(F.col("n_wrong") < 2, "too few wrong"))
    return sets.select("run_id", "n", "n_wrong", F.concat_ws(", ", *rules).alias("problems"))


def compared(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, accuracy, macro_f1, cost, median_ms) of rows with gold_type and predicted_type, neither null."""
    right = (F.col("gold_type") == F.col("predicted_type")).cast("int")
    sides = rows.select(by, F.explode(F.array("gold_type", "predicted_type")).alias("label"), right.alias("right"))
    f1 = sides.groupBy(by, "label").agg((F.sum("right") / F.count("*")).alias("f1")).groupBy(by).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    stats = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(F.col("cost_usd").cast("double")), 10).alias("cost"),
        F.round(F.percentile("latency_ms", 0.5), 4).alias("median_ms"),
    )
    return stats.join(f1, by).select(by, "n", "accuracy", "macro_f1", "cost", "median_ms")


def verdicts(diffs: DataFrame) -> DataFrame:
    """(run_id, n, diff, verdict) by the normal 95 % interval of the mean of `diff`; one row alone is too few."""
    half = 1.96 * F.stddev_samp("diff") / F.sqrt(F.count("*"))
    rows = diffs.groupBy("run_id").agg(F.count("*").alias("n"), F.avg("diff").alias("mid"), half.alias("half"))
    word = F.when(F.col("half").isNull(), "too few").when(F.col("mid") - F.col("half") > 0, "better").when(F.col("mid") + F.col("half") < 0, "worse")
    return rows.select("run_id", "n", F.round("mid", 6).alias("diff"), word.otherwise("no clear difference").alias("verdict"))


def mismatches(rows: DataFrame, least: float) -> DataFrame:
    """(vec_id, cosine) of rows whose vectors v and w have a cosine under `least`."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "w") / F.sqrt(dot("v", "v") * dot("w", "w"))
    return rows.select("vec_id", cosine.alias("c")).filter(F.col("c") < least).select("vec_id", F.round("c", 8).alias("cosine"))
