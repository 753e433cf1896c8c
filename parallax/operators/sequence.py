"""Positional operators: line numbers, ranks, chunks, ordered concatenation.

Spark rows have no position, and a `Window` without `partitionBy` runs in one task.  A global
position is built from Spark's own range partitioning: `repartitionByRange` + a sort inside the
partitions is evaluated once and kept (`caches.keep`); `monotonically_increasing_id()` then holds
(partition, index in the partition); one aggregate counts rows by partition; a window over that
small table (one row per partition) gives offsets, which a broadcast join adds back.  The offset
table has as many rows as there are partitions, so its broadcast is bounded by the job's
parallelism, not by the data.  No job runs while a plan is built, the input is evaluated once,
and the work per row does not depend on the number of partitions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..caches import keep

_LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id = partition << 33 | index


def _split_id(df: DataFrame, id_col: str) -> DataFrame:
    mid = F.monotonically_increasing_id()
    return df.withColumn(id_col, mid).withColumns(
        {
            f"{id_col}_part": F.shiftright(F.col(id_col), 33),
            f"{id_col}_local": F.col(id_col).bitwiseAND(F.lit(_LOW_BITS)),
        }
    )


def _sort_order(order_by: list) -> list[Column]:
    """Sort columns: names (ascending, nulls first), `-name` (descending, nulls last) or Columns."""
    out = []
    for o in order_by:
        if isinstance(o, str):
            out.append(F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc())
        else:
            out.append(o)
    return out


def range_sorted(df: DataFrame, order_by: list, partitions: int | None = None) -> DataFrame:
    """Global order as range partitions, each sorted (equal keys share a partition)."""
    order = _sort_order(order_by)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def _offsets(parts: DataFrame, size_col: str) -> DataFrame:
    """Exclusive running sum of `size_col` over the table of partitions."""
    w = Window.orderBy("_mid_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_offset", F.coalesce(F.sum(size_col).over(w), F.lit(0)))


def with_position(
    df: DataFrame, name: str = "pos", order_by: list | None = None, base: int = 1, partition_by: list | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add a contiguous position (1-based by default) in `order_by` order, optionally per group.

    Without `order_by` the rows are numbered in the order in which `df` delivers them (a file
    read, or a sorted frame); it is evaluated once.  Pass a unique key last: rows with equal keys
    keep no particular order.  Null keys come first (last for `-name`).  `buckets` is the number
    of range partitions (default: the session's shuffle partitions).
    """
    keys = list(partition_by or [])
    rows = range_sorted(df, [*keys, *order_by], buckets) if order_by else df
    tagged = keep(_split_id(rows, "_mid"))
    parts = tagged.groupBy("_mid_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = _offsets(parts, "_n").select("_mid_part", "_offset")
    out = tagged.join(F.broadcast(parts), "_mid_part")  # one row per partition
    place = F.col("_offset") + F.col("_mid_local")
    if keys:
        # a group is a run of the global order: its first place is subtracted
        first = tagged.groupBy(*keys, "_mid_part").agg(F.min("_mid_local").alias("_mid_local"))
        first = first.join(F.broadcast(parts), "_mid_part").groupBy(*keys).agg(F.min(place).alias("_first"))
        same = [F.col(f"_f_{k}").eqNullSafe(F.col(k)) for k in keys]
        first = first.withColumnsRenamed({k: f"_f_{k}" for k in keys})
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        out = out.join(first, cond).drop(*[f"_f_{k}" for k in keys])
        place = place - F.col("_first")
    out = out.withColumn(name, (place + F.lit(base)).cast("bigint"))
    return out.drop("_mid", "_mid_part", "_mid_local", "_offset", "_first")


def line_number(df: DataFrame, name: str = "line_no") -> DataFrame:
    """Contiguous 1-based position in the order in which `df` delivers its rows."""
    return with_position(df, name)


def rank_by_score(df: DataFrame, score: str = "ced", tie: str = "line_no", name: str = "rank") -> DataFrame:
    """Position of each row in ascending score order (ties by `tie`)."""
    return with_position(df, name, order_by=[score, tie])


def running_sum(df: DataFrame, value: Column | str, order_by: list, name: str = "cum", inclusive: bool = True,
                buckets: int | None = None) -> DataFrame:
    """Global running sum of `value` in `order_by` order, without a single-task window.

    Partition totals of the kept range order (a small table) give exclusive offsets; inside a
    partition a window sums in order.
    """
    v = F.col(value) if isinstance(value, str) else value
    tagged = keep(_split_id(range_sorted(df.withColumn("_v", v), list(order_by), buckets), "_mid"))
    sums = tagged.groupBy("_mid_part").agg(F.sum("_v").alias("_s"))
    sums = _offsets(sums, "_s").select("_mid_part", "_offset")
    frame_end = Window.currentRow if inclusive else -1
    w = Window.partitionBy("_mid_part").orderBy("_mid_local").rowsBetween(Window.unboundedPreceding, frame_end)
    out = tagged.join(F.broadcast(sums), "_mid_part").withColumn(  # one row per partition
        name, F.col("_offset") + F.coalesce(F.sum("_v").over(w), F.lit(0))
    )
    return out.drop("_v", "_mid", "_mid_part", "_mid_local", "_offset")


def balanced_chunks(df: DataFrame, n: int, text: str = "text", key: str = "line_no", name: str = "chunk") -> DataFrame:
    """Split into `n` chunks of about equal bytes, lines whole and in `key` order.

    A line starting at byte offset `start` (running byte count before it, with the
    newline) goes to chunk `least(n-1, floor(start * n / total))`.
    """
    nbytes = (F.octet_length(F.col(text)) + F.lit(1)).cast("bigint")
    cum = running_sum(df, nbytes, [key], name="_start", inclusive=False)
    total = df.agg(F.sum(nbytes)).scalar()
    chunk = F.least(F.lit(n - 1), F.floor(F.col("_start") * F.lit(n) / total)).cast("int")
    return cum.withColumn(name, chunk).drop("_start")


def ordered_concat(chunks: DataFrame, chunk: str = "chunk", key: str = "line_no", name: str = "out_line_no") -> DataFrame:
    """Put chunk outputs back in chunk order and renumber them contiguously."""
    return with_position(chunks, name, order_by=[chunk, key])


def row_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (n_a, n_b, same). `assert_parity` raises on a mismatch."""
    na = b.agg(F.count(F.lit(1))).scalar()
    return a.agg(F.count(F.lit(1)).alias("n_a")).select("n_a", na.alias("n_b"), (F.col("n_a") == na).alias("same"))


def assert_parity(a: DataFrame, b: DataFrame) -> int:
    """A13 action: fail unless both sides have the same row count; return it."""
    r = row_parity(a, b).first()
    if not r["same"]:
        raise ValueError(f"row counts differ: {r['n_a']} vs {r['n_b']}")
    return int(r["n_a"])


def sort_by_score(df: DataFrame, score: str = "ced", tie: str = "line_no") -> DataFrame:
    """O1: ascending score, ties by `tie` (a range-partitioned global sort)."""
    return df.orderBy(F.col(score).asc(), F.col(tie).asc())


def select_lowest(df: DataFrame, n: int, score: str = "ced", tie: str = "line_no", max_take: int | None = None) -> DataFrame:
    """O2: the first `n` rows of the ascending order; rows without a score are never selected.

    Small `n` is a TakeOrdered (per-task top-n, then a merge of n rows per task); a large `n`
    numbers the range-partitioned sort and filters on the number, so no task holds the
    selection.  Both give the same rows in the same order.
    """
    return _select_first(df, n, [score, tie], score, max_take)


def select_highest(df: DataFrame, n: int, score: str = "ced", tie: str = "line_no", max_take: int | None = None) -> DataFrame:
    """O3: the first `n` rows read from the other end (descending on both keys)."""
    return _select_first(df, n, ["-" + score, "-" + tie], score, max_take)


TAKE_ORDERED_MAX = 100_000  # rows a TakeOrdered may hold per task; a larger selection is numbered


def _select_first(df: DataFrame, n: int, order: list[str], score: str, max_take: int | None) -> DataFrame:
    df = df.filter(F.col(score).isNotNull())
    if n <= (TAKE_ORDERED_MAX if max_take is None else max_take):
        return df.orderBy(*_sort_order(order)).limit(n)
    return with_position(df, "_sel", order_by=order).filter(F.col("_sel") <= F.lit(n)).orderBy("_sel").drop("_sel")


def head_n(df: DataFrame, n: int, key: str = "line_no") -> DataFrame:
    """First `n` rows by position (no scoring): a pushed-down filter on the position key."""
    return df.filter(F.col(key) <= F.lit(n))


def shuffle_key(seed: int, key: str) -> Column:
    """Reproducible pseudo-random sort key for O5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def seeded_shuffle(df: DataFrame, seed: int = 0, key: str = "line_no", name: str = "shuffled_no") -> DataFrame:
    """Reproducible random order; the new position is a column (not an implicit order)."""
    return with_position(df.withColumn("_shuf", shuffle_key(seed, key)), name, order_by=["_shuf", key]).drop("_shuf")
