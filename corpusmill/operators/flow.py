"""Flow over graphs in levels: reaching definitions, states that pass along dependencies, and greedy walks.

Each level is a few joins over what changed in the last one, for all functions, capabilities or
starts at once; the number of levels is the longest path's, not the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.tables import cut

#: States of capabilities, worst first, and the reason a dependency's state gives (fixed values).
STATES = ("stale", "failed", "unavailable", "limited", "ready")
REASONS = {"stale": "DEPENDENCY_STALE", "failed": "DEPENDENCY_FAILED", "unavailable": "DEPENDENCY_UNAVAILABLE", "limited": "DEPENDENCY_LIMITED"}


def reaching_definitions(flow: DataFrame, definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """(function, name, definition, use): the definitions of a name that reach each use of it on some path.

    flow: (function, source, target) edges between a function's statements, loops included;
    definitions and uses: (function, node, name). A definition leaves its own statement
    and goes on through statements that don't define the name anew; a use reads what comes in,
    so a statement that uses and defines a name doesn't see its own value unless a loop brings it back.
    Parameters are definitions of the entry. Rows that repeat count once.
    """
    step = cut(flow.select("function", F.col("source").alias("node"), F.col("target").alias("_to")).distinct())
    made = cut(definitions.select("function", "node", "name").distinct())
    key = ["function", "node", "name", "definition"]
    # what comes in at a statement; in each round only what is new goes on
    front = cut(made.withColumn("definition", F.col("node")).join(step, ["function", "node"]).select("function", F.col("_to").alias("node"), "name", "definition").distinct())
    seen = front
    while not front.isEmpty():
        through = front.join(made, ["function", "node", "name"], "left_anti")
        there = through.join(step, ["function", "node"]).select("function", F.col("_to").alias("node"), "name", "definition").distinct()
        front = cut(there.join(seen, key, "left_anti"))
        seen = seen.union(front)
    asked = uses.select("function", "node", "name").distinct()
    return seen.join(asked, ["function", "node", "name"]).select("function", "name", "definition", F.col("node").alias("use"))


def dependency_states(specs: DataFrame, states: DataFrame) -> DataFrame:
    """(capability, state, level, reasons): each capability's state after those that it depends on.

    specs: (capability, depends_on array); states: (capability, state). A capability that is stale, failed or unavailable
    stays so. Else a stale dependency makes it stale, a failed or unavailable one
    unavailable, a limited one limited, each with its reason. An unknown dependency counts as unavailable, with the reason
    UNKNOWN_DEPENDENCY; a capability without a state is unavailable too. Capabilities are peeled level by level
    once all that they depend on are settled; those on a cycle or behind one get the state ``cycle`` and no level.
    """
    rank = lambda c: F.array_position(F.array(*map(F.lit, STATES)), c).cast("int")
    own = specs.select("capability").distinct().join(states.groupBy("capability").agg(F.min_by("state", rank(F.col("state"))).alias("state")), "capability", "left").fillna("unavailable", ["state"])
    pairs = specs.select("capability", F.explode("depends_on").alias("on")).distinct()
    known = own.select(F.col("capability").alias("on"), F.lit(True).alias("_k"))
    pairs = cut(pairs.join(known, "on", "left"))
    links = pairs.filter("_k").select("capability", "on")
    told = pairs.groupBy("capability").agg(F.count_if("_k").alias("left"), F.coalesce(F.bool_or(F.col("_k").isNull()), F.lit(False)).alias("unknown"))
    # ``seen`` are the states of settled dependencies
    waiting = own.join(told, "capability", "left").select("capability", "state", F.coalesce("left", F.lit(0).cast("long")).alias("left"), F.coalesce("unknown", F.lit(False)).alias("unknown"), F.array().cast("array<string>").alias("seen"))
    done, level = None, 0
    waiting = cut(waiting)
    while True:
        now = waiting.filter("left = 0")
        bad = F.col("state").isin("stale", "failed", "unavailable")
        has = lambda s: F.array_contains("seen", s)
        state = F.when(bad, F.col("state")).when(has("stale"), "stale").when(F.col("unknown") | has("failed") | has("unavailable"), "unavailable").when(has("limited"), "limited").otherwise(F.col("state"))
        first = F.when(has("stale"), REASONS["stale"]).when(has("failed"), REASONS["failed"]).when(has("unavailable"), REASONS["unavailable"]).when(has("limited"), REASONS["limited"])
        reasons = F.when(bad, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.when(F.col("unknown"), "UNKNOWN_DEPENDENCY"), first)))
        settled = cut(now.select("capability", state.alias("state"), F.lit(level).alias("level"), reasons.alias("reasons")))
        done = settled if done is None else done.union(settled)
        if settled.isEmpty():
            break
        came = links.join(settled.select(F.col("capability").alias("on"), F.col("state").alias("_s")), "on").groupBy("capability").agg(F.count("*").alias("_n"), F.collect_set("_s").alias("_new"))
        rest = waiting.filter("left > 0").join(came, "capability", "left")
        waiting = cut(rest.select("capability", "state", (F.col("left") - F.coalesce("_n", F.lit(0))).alias("left"), "unknown", F.array_union("seen", F.coalesce("_new", F.array().cast("array<string>"))).alias("seen")))
        level += 1
    stuck = waiting.filter("left > 0").select("capability", F.lit("cycle").alias("state"), F.lit(None).cast("int").alias("level"), F.array(F.lit("DEPENDENCY_CYCLE")).alias("reasons"))
    return done.union(stuck)


def walks(starts: DataFrame, links: DataFrame, order: list[Column | str], most: int = 6, barred: tuple[str, ...] = ()) -> DataFrame:
    """(start, step, node, support): a greedy walk from each start, itself step 0, over ``most`` nodes at most.

    links: (source, target, support, ...). A step goes to the first target by ``order``, then by name, that the walk has not seen and that isn't ``barred``.
    All walks take a step in one ranked join; a walk without a step left ends. A start that comes twice walks once.
    """
    front = cut(starts.select("start").filter("start is not null").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("_seen")))
    found = front.select("start", F.lit(0).alias("step"), "node", F.lit("confirmed").alias("support"))
    ranked = cut(links.groupBy("source", "target").agg(F.min(F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{n}") for n, o in enumerate(order)], F.col("support").alias("support"))).alias("_o")))
    ranked = ranked.filter(~F.col("target").isin(*barred)) if barred else ranked
    for step in range(1, most):
        open_ = front.join(ranked, F.col("node") == F.col("source")).filter(~F.array_contains("_seen", F.col("target")))
        best = F.min(F.struct("_o", "target", "_seen")).alias("b")  # one walk has one front
        front = cut(open_.groupBy("start").agg(best).select("start", F.col("b.target").alias("node"), F.array_append("b._seen", F.col("b.target")).alias("_seen"), F.col("b._o.support").alias("support")))
        if front.isEmpty():
            break
        found = found.union(front.select("start", F.lit(step), "node", "support"))
        front = front.drop("support")
    return found
