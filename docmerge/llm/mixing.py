"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each source gets a token target. The document rates that differ least (in relative entropy) from one and meet the target are
exponentially tilted, ``rate = min(most, exp(lambda * size / mean size))``; the convex dual has one
``lambda`` per source, which Newton steps find, kept inside a bracket. Every step is one aggregate over cells of
equal source and size. Rates become whole copies by systematic rounding per cell, and a few cells of each size class take
one copy more or less until the source's words meet its target to within a small document.

Nulls: a null text has size 0; a null source is a source of its own, last in order; null ids are kept. Documents of size 0 take 0 words.
Ties: documents of equal source and size are interchangeable and share copies in the order of a hash of their
id. Repeated rows count as documents of their own. An empty table gives an empty result. Other columns are ignored.
The greatest float error of a target is that of one sum over the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmerge.llm.common import ranked, text_of, words_of
from docmerge.operators.identity import row_hash
from docmerge.session import checkpointed

#: Size classes are half powers of two; the repair may use so many cells of each class of a source.
REPAIR_CELLS = 4


def _source_key() -> F.Column:
    """Orders sources by code point, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))


def source_targets(cells: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source key: ``source_size``, ``n`` documents and ``target``.

    Targets share ``share`` of all sizes by weight; none is above ``most`` times its source, and what is above is
    shared again. In the order of size per weight the sources at their limit come first, so running sums solve it.
    One row per source: the windows below see sources only, never documents.
    """
    sources = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    place = (F.row_number().over(Window.orderBy("key")) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(limit / F.col("weight"), "key")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sources = sources.withColumns({
        "used": F.coalesce(F.sum(limit).over(before), F.lit(0.0)),
        "left": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(whole) * F.lit(float(share)),
    })
    capped = limit * F.col("left") <= F.col("weight") * (F.col("all") - F.col("used"))
    sources = sources.withColumn("capped", capped)
    free = (F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), limit)).over(whole), F.lit(0.0))) / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    target = F.when(F.col("capped"), limit).otherwise(F.least(limit, free * F.col("weight")))
    return sources.select("key", "source_size", "n", target.alias("target"))


def _exact_sum(value: F.Column) -> F.Column:
    """A sum that does not depend on the order of the rows, so that reruns agree to the last bit."""
    return F.sum(value.cast("decimal(30,9)")).cast("double")


def tilts(cells: DataFrame, sources: DataFrame, most: float, tolerance: float = 1e-8, steps: int = 80) -> DataFrame:
    """Per source key the dual variable ``tilt``; null where the target is the limit itself (every rate is ``most``)."""
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    open_ = F.col("target") < F.col("source_size") * most
    state = checkpointed(sources.where("source_size > 0").select(
        "key", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.when(open_, zero).alias("tilt"), none.alias("low"), none.alias("high"),
        F.when(open_, F.abs(F.col("source_size") - F.col("target")) / F.col("source_size")).otherwise(zero).alias("error"),
    ))
    for _ in range(steps):
        if (state.agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        weight = F.col("n") * F.col("size")
        sums = cells.join(state, "key").where("tilt is not null").groupBy("key", "target", "mean", "tilt", "low", "high").agg(
            _exact_sum(weight * F.least(raw, F.lit(float(most)))).alias("value"),
            _exact_sum(F.when(raw < most, weight * raw * x).otherwise(zero)).alias("slope"),
        )
        gap = F.col("value") - F.col("target")
        sums = sums.withColumns({"gap": gap, "low": F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))})
        newton = F.col("tilt") - F.col("gap") / F.nullif("slope", zero)
        halved = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        inside = newton.isNotNull() & (F.coalesce(newton >= F.col("low"), F.lit(True))) & (F.coalesce(newton <= F.col("high"), F.lit(True)))
        done = F.abs("gap") <= F.col("target") * tolerance
        moved = sums.select(
            "key", "target", "mean", F.when(done, F.col("tilt")).when(inside, newton).otherwise(halved).alias("tilt"), "low", "high", (F.abs("gap") / F.col("target")).alias("error")
        )
        state = checkpointed(moved.unionByName(state.where("tilt is null")))
    return state.select("key", "mean", F.round("tilt", 9).alias("tilt"))


def cell_copies(cells: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """``cells`` with ``rate`` and whole ``copies`` for all their documents together, near the targets."""
    tilted = cells.join(sources.drop("n"), "key").join(tilts(cells, sources, most), "key", "left")
    rate = F.when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(700.0)))))
    tilted = tilted.withColumns({"rate": rate, "class": F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * 2).cast("int")})
    running = Window.partitionBy("key", "class").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    tilted = tilted.withColumn("sum", F.sum(F.col("n") * F.col("rate")).over(running))
    rounded = F.floor(F.col("sum") + 0.5) - F.floor(F.col("sum") - F.col("n") * F.col("rate") + 0.5)
    tilted = checkpointed(tilted.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("n") * most, rounded)).cast("long")).drop("sum", "mean", "tilt"))
    return tilted.join(_repairs(tilted, most), ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change", "class")


def _repairs(cells: DataFrame, most: int) -> DataFrame:
    """Changes of copies by (key, size) that close the gap between a source's words and its target, largest sizes first."""
    gaps = cells.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    room = F.when(F.col("gap") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
    usable = cells.join(gaps, "key").withColumn("room", room).where("room > 0 and size > 0 and size <= abs(gap)")
    first = F.row_number().over(Window.partitionBy("key", "class").orderBy("size"))
    # At most REPAIR_CELLS cells of each of some 60 classes: the arrays do not grow with the documents.
    chosen = usable.withColumn("place", first).where(F.col("place") <= REPAIR_CELLS)
    lists = chosen.groupBy("key").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.struct("size", "room")), asc=False).alias("cells"))
    start = F.struct(F.abs("gap").alias("left"), F.array().cast("array<struct<size:bigint,change:bigint>>").alias("changes"))

    def step(state, cell):
        change = F.least(cell["room"], F.floor(state["left"] / cell["size"])).cast("long")
        return F.struct(
            (state["left"] - change * cell["size"]).cast("double").alias("left"),
            F.array_append(state["changes"], F.struct(cell["size"].cast("long").alias("size"), change.alias("change"))).alias("changes"),
        )

    changes = F.aggregate("cells", start, step, lambda state: state["changes"])
    return lists.select("key", F.signum("gap").cast("long").alias("sign"), F.explode(changes).alias("c")).select("key", "c.size", (F.col("sign") * F.col("c.change")).alias("change"))


def mix(documents: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``rate``, ``copies`` (0 to ``most``) and ``taken`` words."""
    sizes = checkpointed(documents.select("doc_id", _source_key().alias("key"), F.size(words_of(text_of())).cast("long").alias("size")))
    cells = checkpointed(sizes.groupBy("key", "size").agg(F.count("*").alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    sources = checkpointed(source_targets(cells, weights, share, most))
    placed = ranked(sizes, ["key", "size"], ["doc_id"], "rank", cell_copies(cells, sources, most), total)
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("rank") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return placed.select("doc_id", "key", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(documents: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``documents`` with every row as often as the mix takes it; rows that differ in id, source or size keep their own copies.

    Rows of equal id, source and size share their copies evenly, which needs their number and the sum of their copies only;
    they are ranked in buckets of their content, so that only rows alike in everything meet in one task.
    Rows without id are kept once each.
    """
    taken = mix(documents, weights, share, most).where("doc_id is not null")
    taken = checkpointed(taken.groupBy("doc_id", "key", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")))
    # Whole rows in one column: no name can clash. Rows of one id, source and size go by their content, in buckets of it.
    rows = documents.select("doc_id", _source_key().alias("key"), F.size(words_of(text_of())).cast("long").alias("size"), F.struct("*").alias("row"), row_hash(documents).alias("content"))
    found = rows.join(taken, ["doc_id", "key", "size"])
    repeated = found.where("n = 1").select("row", F.col("copies").alias("times"))
    if not taken.where("n > 1").isEmpty():
        several = ranked(found.where("n > 1").withColumn("group", F.struct("doc_id", "key", "size")), ["group"], ["content"], "place")
        times = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("place") < F.col("copies") % F.col("n"), 1).otherwise(0)
        repeated = repeated.unionByName(several.select("row", times.alias("times")))
    repeated = repeated.where("times > 0")
    repeated = repeated.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return repeated.select("row").unionByName(rows.where("doc_id is null").select("row")).select("row.*")
