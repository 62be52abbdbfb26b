"""Exact positions inside groups and lookups on keys, both safe when one key holds a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.plans.shared import checkpointed, stored


def _run_counter(group: str, weight: str | None):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        seen, last, before_n, before_w = 0, None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = batch.column(group).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[True], codes[1:] != codes[:-1]])
            first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
            head = (batch.column(group)[0].as_py(),)
            if head != last:
                before_n = before_w = 0
            on = first == 0
            count = np.arange(n) - first + np.where(on, before_n, 0)
            out = [*batch.columns, pa.array(np.full(n, pid, dtype=np.int32)), pa.array(np.arange(seen, seen + n, dtype=np.int64)), pa.array(count.astype(np.int64))]
            names = [*batch.schema.names, "_pid", "_at", "group_pos"]
            if weight:
                w = batch.column(weight).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(w) - w
                before = upto - upto[first] + np.where(on, before_w, 0)
                out.append(pa.array(before.astype(np.int64)))
                names.append("group_before")
                before_w = int(before[-1] + w[-1])
            before_n, seen, last = int(count[-1]) + 1, seen + n, (batch.column(group)[n - 1].as_py(),)
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def ordered_positions(df: DataFrame, group: str, order: list[Column], weight: str | None = None, cheap: bool = False) -> DataFrame:
    """Adds ``group_pos`` (0, 1, ... inside each value of ``group``) and, with ``weight`` (whole numbers, null as 0), ``group_before``: the weight of the group's earlier rows.

    One global range sort by (group, order); each sorted partition counts its own runs while it streams by, and a
    prefix over one summary row per partition carries a group that spans partitions. A group of any size is spread
    over as many partitions as its rows need; only the per-partition summary reaches the driver. ``order`` must end
    in a unique key, or equal rows get positions in either order. A null group is a group of its own; an empty
    table gives an empty table. A range sort reads its input twice, for the bounds and for the rows: the input is
    stored first, unless it is ``cheap`` to read again (a table, a checkpoint).
    """
    spark = df.sparkSession
    df = df if cheap else stored(df)
    by = [F.col(group).asc_nulls_first(), *order]
    extra = [T.StructField("_pid", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("group_pos", T.LongType())]
    if weight:
        extra.append(T.StructField("group_before", T.LongType()))
    schema = T.StructType([*df.schema.fields, *extra])
    runs = checkpointed(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_run_counter(group, weight), schema))
    end = [F.col("group_pos") + 1, (F.col("group_before") + F.coalesce(F.col(weight), F.lit(0))) if weight else F.lit(0).cast("long")]
    ends = runs.groupBy("_pid").agg(
        F.min_by(F.struct(group), "_at").alias("head"),
        F.max_by(F.struct(F.col(group).alias("g"), end[0].alias("n"), end[1].cast("long").alias("w")), "_at").alias("tail"),
        F.count(F.lit(1)).alias("rows"),
    )
    carry, last, n, w = [], None, 0, 0
    for row in sorted(ends.collect(), key=lambda r: r["_pid"]):  # one row per partition
        if (row["head"][0],) == last and n:
            carry.append((row["_pid"], row["head"][0], n, w))
        else:
            n = w = 0
        whole = row["tail"]["n"] == row["rows"]
        n, w = row["tail"]["n"] + (n if whole else 0), row["tail"]["w"] + (w if whole else 0)
        last = (row["tail"]["g"],)
    carried = spark.createDataFrame(carry, T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_g", df.schema[group].dataType), T.StructField("_n", T.LongType()), T.StructField("_w", T.LongType())]))
    out = runs.join(F.broadcast(carried), (F.col("_pid") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    out = out.withColumn("group_pos", F.col("group_pos") + F.coalesce("_n", F.lit(0)))
    if weight:
        out = out.withColumn("group_before", F.col("group_before") + F.coalesce("_w", F.lit(0)))
    return out.drop("_pid", "_at", "_p", "_g", "_n", "_w")


#: Values of a column that may be treated as frequent at once; the sketch behind it holds HEAVY_TRACKED counters, so
#: every value with more than 1 in 1,000 of the rows is among them.
HEAVY_KEYS, HEAVY_TRACKED = 1_000, 10_000
#: Sketches are merged in so many groups before they meet in one task.
HEAVY_GROUPS = 128
#: Rows of one key that one task should get: a fair share of all, within these bounds.
LEAST_ROWS, MOST_ROWS = 1_000, 2_000_000


def task_rows(spark: SparkSession, rows: int) -> int:
    """Rows of a table of ``rows`` that one task should get."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(MOST_ROWS, max(LEAST_ROWS, -(-rows // tasks)))


def key_loads(df: DataFrame, *keys: str) -> list[dict]:
    """For each column, its values that hold more rows than one task should get, with the number of tasks to spread them over.

    One pass without a shuffle of rows; sketches of the tasks are merged in two steps. At most HEAVY_KEYS values come
    to the driver. A value that the sketch misses is not spread, but no row is lost: its task sorts and spills.
    """
    spark = df.sparkSession
    sketch = lambda k: F.expr(f"approx_top_k_accumulate(`{k}`, {HEAVY_TRACKED}) FILTER (WHERE `{k}` IS NOT NULL)")
    parts = df.select(*dict.fromkeys(keys)).groupBy((F.spark_partition_id() % HEAVY_GROUPS).alias("_g")).agg(F.count(F.lit(1)).alias("n"), *[sketch(k).alias(f"_s{i}") for i, k in enumerate(keys)])
    got = parts.groupBy(F.lit(0).alias("_one")).agg(F.sum("n").alias("n"), *[F.expr(f"approx_top_k_estimate(approx_top_k_combine(_s{i}, {HEAVY_TRACKED}), {HEAVY_KEYS})").alias(f"t{i}") for i in range(len(keys))]).first()
    if got is None:  # no rows
        return [{} for _ in keys]
    fair = task_rows(spark, got["n"] or 0)
    return [{x["item"]: -(-x["count"] // fair) for x in got[f"t{i}"] or [] if x["count"] > fair} for i in range(len(keys))]


def salted(left: DataFrame, right: DataFrame, key: str, loads: dict, spread: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt``: rows of loaded keys on the left are spread over as many values as the key has tasks, the right ones repeated for each."""
    if not loads:
        return left.withColumn("_salt", F.lit(0)), right.withColumn("_salt", F.lit(0))
    spark, kind = left.sparkSession, left.schema[key].dataType
    tasks = F.broadcast(spark.createDataFrame(list(loads.items()), T.StructType([T.StructField("_hot", kind), T.StructField("_tasks", T.IntegerType())])))  # HEAVY_KEYS rows at most
    left = left.join(tasks, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_tasks")).cast("int"), F.lit(0))).drop("_hot", "_tasks")
    right = right.join(tasks, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1))).drop("_hot", "_tasks")
    return left, right


def merge_lookup(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left", loads: dict | None = None) -> DataFrame:
    """Sort-merge join of ``left`` with ``right``, which has each key once; frequent keys of ``left`` are salted by their size.

    Both sides are partitioned and sorted by (key, salt) and merged as streams, so neither side has to fit anywhere.
    Without ``loads`` (from ``key_loads`` of ``left``) the left side is stored and its keys are sketched, so that it is
    computed once.
    """
    if loads is None:
        left = stored(left)
        loads = key_loads(left, key)[0]
    left, right = salted(left, right, key, loads, spread)
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


def adaptive_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right``, which has each key once, by a sort-merge join without salt.

    Hot partitions are cut by the adaptive skew join, by the sizes that the shuffle has just measured, also inside one
    key: for tables whose frequent keys change with every step, where no sketch would hold.
    """
    return left.join(right.hint("merge"), key, how)
