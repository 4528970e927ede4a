"""Positions and running sums inside of groups of any size.

A plain window sorts one whole group in one task.  ``scan_totals`` is a prefix scan: rows are dealt out by ranges of
(group, order), whatever the order's values are, each range is summed, and a range starts where the earlier ones of its group end.
``with_running_total`` needs no sampled ranges where an order has natural buckets: it sums those, and only the
rows of one bucket meet in one window.  ``with_small_positions`` is for groups that are small as a rule: only rows that share
a hash bucket with a large group take the longer way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmerge.session import checkpointed


def group_struct(keys: Sequence[str]) -> Column:
    """Keys as one struct: unlike null keys, structs with null fields meet in joins."""
    return F.struct(F.lit(0).alias("one"), *keys)


def scan_totals(
    rows: DataFrame, group: Sequence[str], order_by: Sequence[Column | str], weight: Column | None = None, out: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of the same group, by a distributed prefix scan.

    Without ``weight`` it is the 0-based position of the row in its group.  ``order_by`` must tell the rows of a group apart and holds
    plain ascending columns; rows with null keys are a group, rows with a null order come first.  The dealt rows are stored
    once, so give only the columns that are needed.  A window holds the part of one group in one range.  ``total`` names
    a column for the sum of the whole group.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    marked = rows.withColumns({"__weight": weight, "__group": group_struct(group)})
    # Stored, because ranges are sampled: the sums and the rows have to come from the same ones.
    dealt = checkpointed(marked.repartitionByRange("__group", *order_by).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy("__part", "__group").agg(F.sum("__weight").alias("__sum"))
    earlier = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    started = sums.withColumn("__start", F.sum("__sum").over(earlier))
    part = Window.partitionBy("__part", "__group")
    inside = part.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__inside", F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    if total is None:
        # Only the first group of a range can have begun before it: at most one row per range is broadcast.
        starts = started.where("__start != 0").select("__part", "__group", "__start")
    else:
        # Only the first and the last group of a range can reach beyond it: at most two rows per range are broadcast.
        whole = Window.partitionBy("__group")
        starts = started.withColumns({"__parts": F.count(F.lit(1)).over(whole), "__all": F.sum("__sum").over(whole)}).where("__parts > 1")
        starts = starts.select("__part", "__group", "__start", "__all")
        placed = placed.withColumn("__own", F.sum("__weight").over(part))
    found = placed.join(F.broadcast(starts), ["__part", "__group"], "left").withColumn(out, F.coalesce("__start", F.lit(0)) + F.col("__inside"))
    if total is None:
        return found.select(*rows.columns, out)
    return found.withColumn(total, F.coalesce("__all", "__own")).select(*rows.columns, out, total)


def with_running_total(
    df: DataFrame,
    group: Sequence[str],
    levels: Sequence[Column],
    order_by: Sequence[Column | str],
    weight: Column | None = None,
    out: str = "pos",
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of the same group.

    ``levels`` are expressions, coarse to fine, that never fall while ``order_by``
    rises; ``order_by`` must tell the rows of a group apart.  Without ``weight`` the
    result is the 0-based position of the row in its group.  Rows with null keys are a group, rows
    with a null order come first.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    marks = [f"__level{i}" for i in range(len(levels))]
    marked = df.withColumns({m: F.struct(level) for m, level in zip(marks, levels)} | {"__weight": weight, "__group": group_struct(group)})
    group = ["__group"]

    # Sums per finest bucket once; coarser sums are taken from these, so they share one shuffle.
    totals = marked.groupBy(*group, *marks).agg(F.sum("__weight").alias("__total"))
    base = None  # total of the earlier buckets, per prefix of the levels
    for depth in range(1, len(marks) + 1):
        outer, mark = [*group, *marks[: depth - 1]], marks[depth - 1]
        sums = totals if depth == len(marks) else totals.groupBy(*outer, mark).agg(F.sum("__total").alias("__total"))
        before = Window.partitionBy(*outer).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
        step = sums.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
        if base is not None:
            step = step.join(base, outer).withColumn("__before", F.col("__before") + F.col("__base"))
        base = step.select(*outer, mark, F.col("__before").alias("__base"))

    bucket = [*group, *marks]
    inside = Window.partitionBy(*bucket).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("__inside", F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    return (
        placed.join(base, bucket)
        .withColumn(out, F.col("__base") + F.col("__inside"))
        .select(*df.columns, out)
    )


#: Hash buckets that groups are counted in, and the rows that a bucket may hold beside four times the mean.
_BUCKETS, _FEW = 4096, 10_000


def with_small_positions(df: DataFrame, group: Sequence[str], levels: Sequence[Column], order_by: Sequence[Column | str], out: str = "pos") -> DataFrame:
    """0-based position of each row in its group, for groups that are small as a rule: one shuffle and one window.

    Groups are counted in hash buckets before. Rows of a bucket that is much larger than others, so that one of its groups may hold any
    share of all rows, are placed by ``with_running_total`` along ``levels``.
    """
    bucket = F.pmod(F.xxhash64(*group), F.lit(_BUCKETS)).cast("int")
    sizes = {r["bucket"]: r["n"] for r in df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()}
    most = _FEW + 4 * sum(sizes.values()) // _BUCKETS
    large = [b for b, n in sizes.items() if n > most]
    place = (F.row_number().over(Window.partitionBy(*group).orderBy(*order_by)) - 1).cast("bigint")
    if not large:
        return df.withColumn(out, place)
    few = df.where(~bucket.isin(large)).withColumn(out, place)
    return few.unionByName(with_running_total(df.where(bucket.isin(large)), group, levels, order_by, out=out))


def with_position(
    df: DataFrame, group: Sequence[str], seq: str = "file_seq", tie: Sequence[str] = (), out: str = "pos", total: str | None = None
) -> DataFrame:
    """0-based position in the group along an order column of any scale, and the group's ``total`` of rows if it is named."""
    return scan_totals(df, group, [seq, *tie], out=out, total=total)
