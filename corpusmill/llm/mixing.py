"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document is an item of its source's queue, twice: the second pass holds the repeats.
Queues are shuffled by a hash. An item's virtual finish time is the source's running word
count, itself included, divided by the source's target; items are served in the order of
that time until the total budget is spent, so every source is served in proportion.

Running sums never put a source into one task: a queue is cut into 4,096 slices by its hash,
slices are summed first, and only the slices' totals (at most 4,096 a source) are summed in
order. The global cut works alike over 131,072 slices of virtual time: whole slices are in or
out, and only the one in which the budget ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.shared import cut

#: A word, as everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
SLICES = 4096
#: Slices of virtual time up to 1, where targets are met; as many again follow.
TIMES = 65536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Targets of the rows (skey, source_size): ``share`` of all words, dealt by repeating ``weights``.

    No target passes ``most`` times its source's size; what is cut off is dealt again by weight.
    All rounds have one fixed point, min(weight * level, cap): the level is found by going
    through the sources by cap / weight.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("_n", F.row_number().over(Window.orderBy("skey")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    rows = (
        ranked.withColumn("_w", weight)
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    )
    order = Window.orderBy("_ratio", "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    level = F.coalesce(F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything), F.lit(float("inf")))
    return rows.withColumn("_top", level).select("skey", "source_size", F.least(F.col("_w") * F.col("_top"), F.col("_cap")).alias("target"), "_budget")


def mix_sources(
    docs: DataFrame,
    weights: list[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken.

    ``size`` counts words (null text: 0). ``taken`` is 0, 1 or 2 times ``size`` (``most`` 2).
    Sources are ordered by code point, null last, and are a source each, null too. Repeated
    rows are documents of their own; rows alike in id, source and size may be taken one for
    the other. A null id is shuffled like any other. Other columns are left out, whatever
    their names. An empty table gives an empty result; sources without words have target 0.
    """
    passes = int(most)
    assert passes == most and passes >= 1, "most is a whole number of passes"
    items = docs.select(
        F.col(id_col).alias("doc_id"),
        word_count(F.col(text_col)).alias("size"),
        F.col(source_col).cast("string").alias("source"),
    ).withColumns(
        {
            # '0' + name sorts before '1', the null source
            "skey": F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))),
            "_h": F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))),
        }
    )
    # from here on a row is a few dozen bytes; the texts are read once
    items = cut(items.withColumn("_slice", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")))

    slices = items.groupBy("skey", "_slice").agg(F.sum("size").alias("_words"))
    running = Window.partitionBy("skey").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)))
    sizes = slices.groupBy("skey").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, list(weights), share, most)

    inside = Window.partitionBy("skey", "_slice").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        items.withColumn("_run", F.sum("size").over(inside))
        .join(slices.select("skey", "_slice", "_before"), ["skey", "_slice"])
        .join(targets, "skey")
        .withColumn("_pos", F.col("_before") + F.col("_run"))
    )
    timed = queued.withColumns(
        {f"_time{k}": (F.col("_pos") + k * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target")) for k in range(passes)}
    )
    # time 1 is where a target is met; what lies past 2 can't be reached within the budget
    timed = timed.withColumns({f"_t{k}": F.floor(F.least(F.col(f"_time{k}") * TIMES, F.lit(2.0 * TIMES))).cast("int") for k in range(passes)})
    item = [
        F.struct(F.col(f"_t{k}").alias("t"), F.col(f"_time{k}").alias("time"), "skey", F.col("_h").alias("h"), F.col("doc_id").alias("id"), "size")
        for k in range(passes)
    ]
    served = timed.select(F.explode(F.array(*item)).alias("i"), F.col("_budget").alias("budget")).filter("i.t is not null")
    times = served.groupBy("i.t").agg(F.sum("i.size").alias("words"), F.first("budget").alias("budget"))
    order = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    times = times.withColumn("end", F.sum("words").over(order)).filter(F.col("end") > F.col("budget"))
    edge = times.agg(F.min_by(F.struct("t", (F.col("end") - F.col("words")).alias("start"), "budget"), "t").alias("edge"))

    exact = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        served.join(F.broadcast(edge), F.col("i.t") == F.col("edge.t"))
        .withColumn("run", F.col("edge.start") + F.sum("i.size").over(exact))
        .filter(F.col("run") <= F.col("edge.budget"))
        .agg(F.max("i").alias("last"))
    )
    bounds = edge.crossJoin(last)  # one row: the slice of time in which the budget ends, and the last item served there
    taken = sum(
        F.when(F.coalesce(F.col("edge").isNull() | (i["t"] < F.col("edge.t")) | ((i["t"] == F.col("edge.t")) & (i <= F.col("last"))), F.lit(False)), F.col("size")).otherwise(0)
        for i in item
    )
    return timed.crossJoin(F.broadcast(bounds)).select(
        "doc_id", "size", "source", F.col("source_size").cast("long"), F.col("target").cast("double"), taken.cast("long").alias("taken")
    )
