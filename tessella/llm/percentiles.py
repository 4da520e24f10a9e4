"""Problem 4: percentiles per group with bounded error, in sketches that can be merged.

Method: deterministic buffer collapsing. A sketch holds sorted buffers of `size` values; a
buffer of level l stands for 2^l values each. Two buffers of one level collapse into one of
the next: of their 2 x size merged values each second one stays, beginning at the first or the
second in turn. A collapse of level l shifts a rank by at most 2^l; each sketch carries the sum
of these, so its error bound is known. Buffers of n values collapse along a binary tree:
at most n/(2 size) is added on each of its log2(n/size) levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 4_096
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Sketches merged in one task; more are merged in rounds.
FAN_IN = 64
#: Fixed value: what the recorders write where they have no latency.
SENTINEL = 2_147_483_647


class Buffers:
    """The buffers of one sketch, at most one for each level above the raw values."""

    def __init__(self, size: int):
        self.size, self.error, self.full, self.raw, self.n_raw = size, 0, {}, [], 0

    def add(self, values: np.ndarray) -> None:
        self.raw.append(values)
        self.n_raw += len(values)
        if self.n_raw >= self.size:
            values = np.concatenate(self.raw)
            whole = len(values) // self.size * self.size
            for at in range(0, whole, self.size):
                self.push(0, np.sort(values[at : at + self.size]))
            self.raw, self.n_raw = [values[whole:]], len(values) - whole

    def push(self, level: int, values: np.ndarray) -> None:
        while level in self.full:
            both = np.sort(np.concatenate([self.full.pop(level), values]), kind="stable")
            self.error += 1 << level
            # First or second of each pair in turn, by how many collapses this level has seen.
            turns = self.full.setdefault(("turn", level), [0])
            values, turns[0] = both[turns[0] % 2 :: 2], turns[0] + 1
            level += 1
        self.full[level] = values

    def rows(self) -> list[tuple[int, int, np.ndarray]]:
        """(level, error, values); -1 marks values that fill no buffer yet."""
        out = [(lv, 0, v) for lv, v in self.full.items() if not isinstance(lv, tuple)]
        out.append((-1, self.error, np.sort(np.concatenate(self.raw)) if self.raw else np.empty(0)))
        return out


def merged(rows: pd.DataFrame, size: int) -> Buffers:
    """One sketch of the buffers in `rows`, in an order that doesn't depend on arrival."""
    sketch = Buffers(size)
    order = rows.assign(first=[v[0] if len(v) else -np.inf for v in rows["vals"]], total=[float(np.sum(v)) for v in rows["vals"]])
    for row in order.sort_values(["level", "first", "total"], kind="stable").itertuples():
        values = np.asarray(row.vals, np.float64)
        sketch.error += int(row.error)
        if row.level < 0:
            sketch.add(values)
        else:
            sketch.push(int(row.level), values)
    return sketch


def _frame(key: dict, sketch: Buffers) -> pd.DataFrame:
    levels, errors, values = zip(*sketch.rows())
    return pd.DataFrame({**{k: [v] * len(levels) for k, v in key.items()}, "level": levels, "error": errors, "vals": values})


def sketch_values(values: DataFrame, keys: list[str], value_col: str, size: int = SIZE) -> DataFrame:
    """(keys, part, level, error, vals): the sketches that each task makes of its own rows.

    Null values are left out. The rows of a task are sorted first, so that it holds one group
    at a time and its sketch doesn't depend on the order of arrival.
    """
    names = [f"k{i}" for i in range(len(keys))]
    slim = values.select(
        *(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(value_col).cast("double").alias("v")
    ).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    types = {n: slim.schema[n].dataType.simpleString() for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, sketch = None, None

        def out() -> pa.RecordBatch:
            rows = sketch.rows()
            return pa.RecordBatch.from_arrays(
                [
                    *(pa.array([x] * len(rows), t) for x, t in zip(now, arrow_types)),
                    pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64())),
                ],
                names=[*names, "part", "level", "error", "vals"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            arrow_types = [batch.schema.field(n).type for n in names]
            numbers = batch.column(len(names)).to_numpy()
            codes = [batch.column(i).dictionary_encode() for i in range(len(names))]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for c in codes:
                # Nulls have the code -1.
                at = c.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= at[1:] != at[:-1]
            starts = np.flatnonzero(change)
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(batch.column(i)[int(a)].as_py() for i in range(len(names)))
                if key != now:
                    if now is not None:
                        yield out()
                    now, sketch = key, Buffers(size)
                sketch.add(numbers[a:b])
        if now is not None:
            yield out()

    columns = ", ".join(f"{n} {types[n]}" for n in names)
    made = slim.sortWithinPartitions(*names, "v").mapInArrow(run, f"{columns}, part int, level int, error long, vals array<double>")
    return made.withColumnsRenamed(dict(zip(names, keys)))


def merge_sketches(sketches: DataFrame, keys: list[str], parts: int, size: int = SIZE, fan_in: int = FAN_IN) -> DataFrame:
    """One sketch for each group of `keys`, merged along a tree: at most `fan_in` in a task.

    `parts` is an upper bound of the numbers in the column part that tell a group's sketches apart.
    """
    types = {k: sketches.schema[k].dataType.simpleString() for k in keys}
    schema = ", ".join(f"{k} {t}" for k, t in types.items()) + ", part int, level int, error long, vals array<double>"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key = {k: rows[k].iloc[0] for k in [*keys, "part"]}
        return _frame(key, merged(rows, size))[[*keys, "part", "level", "error", "vals"]]

    result = sketches.select(*keys, "part", "level", "error", "vals")
    while True:
        parts = -(-parts // fan_in)
        result = result.withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
        result = result.groupBy(*keys, "part").applyInPandas(run, schema)
        if parts <= 1:
            return result.drop("part")


def percentiles(sketches: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(keys, n, max_rank_error, quantile, value): nearest-rank percentiles of each sketch."""
    types = {k: sketches.schema[k].dataType.simpleString() for k in keys}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.asarray(v, np.float64) for v in rows["vals"]])
        weights = np.repeat(np.where(rows["level"] < 0, 1, 2.0 ** rows["level"].clip(lower=0)), rows["vals"].map(len))
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        n, error = int(weights.sum()), int(rows["error"].sum())
        at = [min(np.searchsorted(ranks, np.ceil(q * n)), len(order) - 1) for q in quantiles]
        return pd.DataFrame({**{k: [rows[k].iloc[0]] * len(quantiles) for k in keys}, "n": n, "max_rank_error": error, "quantile": quantiles, "value": values[order][at]})

    schema = ", ".join(f"{k} {t}" for k, t in types.items()) + ", n long, max_rank_error long, quantile double, value double"
    # A sketch's error stands in the row of its raw values, which is empty where all of them fill buffers.
    return sketches.filter((F.size("vals") > 0) | (F.col("error") > 0)).groupBy(*keys).applyInPandas(run, schema)


def clean_route(route: Column) -> Column:
    """A route in lower case without blanks around; null where there is none."""
    plain = F.lower(F.trim(route))
    return F.when(plain != "", plain)


def latency_rows(results: DataFrame) -> DataFrame:
    """(route, day, latency): one row for each result with a usable latency.

    Rows sent twice whole count once. Null, negative and sentinel latencies are no latencies;
    those at the time limit are. Results without a route form the group null.
    """
    rows = results.filter("latency_ms >= 0").filter(F.col("latency_ms") < SENTINEL).select(
        "run_id", "question_id", clean_route(F.col("route_taken")).alias("route"), "recorded_at", "latency_ms"
    )
    return rows.distinct().select("route", F.to_date("recorded_at").alias("day"), F.col("latency_ms").alias("latency"))


def daily_sketches(results: DataFrame, size: int = SIZE) -> DataFrame:
    """(route, day, level, error, vals): a sketch for each route and day, to keep and combine."""
    spark = results.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return merge_sketches(sketch_values(latency_rows(results), ["route", "day"], "latency", size), ["route", "day"], parts, size)


def combine_days(daily: DataFrame, size: int = SIZE) -> DataFrame:
    """(route, level, error, vals): the sketches of all days combined, along a tree by day."""
    days = 1 << 16  # days since 1970 until the year 2149
    part = F.coalesce(F.pmod(F.unix_date("day"), F.lit(days)), F.lit(0)).cast("int")
    return merge_sketches(daily.withColumn("part", part), ["route"], days, size)
