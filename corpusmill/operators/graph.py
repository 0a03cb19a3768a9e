"""Property graphs as two tables: filters, de-duplication, normalisation, traversal, projections and starting points.

nodes: id, type, label, file_path, role, start_line, ...; edges: source, target, type, confidence,
evidence_level and, where order matters, seq. Traversals are loops over levels of bounded
depth; each level is two joins and an anti-join against what has been visited, and lineage is
cut by tables in the session's shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import paths as P
from corpusmill.functions.tables import cut, numbered
from corpusmill.functions.text import cases

# Fixed values.
NODE_TYPES = (
    "folder file module class schema model function method component endpoint api_call call_site builtin_call stdlib_call framework_call external_call "
    "unresolved_call cfg_node dfg_node unknown"
).split()
EDGE_TYPES = (
    "contains defines imports imports_internal calls calls_api contains_call exposes_endpoint calls_builtin calls_stdlib calls_framework calls_external "
    "calls_unresolved cfg_next cfg_true cfg_false cfg_return dfg_parameter dfg_defines dfg_reaches dfg_uses dfg_computed_from dfg_returned dfg_argument "
    "dfg_argument_to_parameter dfg_return dfg_return_to_call_result dfg_call_result_to_definition uses_model uses_schema reads_config tested_by documents related_to"
).split()
COVERAGE = ("mapped", "analyzing", "deep_indexed", "skipped", "failed")
EVIDENCE = ("map", "deep", "inferred")
MAP_NODES = "folder file module class schema model component endpoint function".split()
CALL_EDGES = ("calls", "calls_builtin", "calls_stdlib", "calls_framework", "calls_external", "calls_unresolved")
MAX_NODES, MAX_EDGES, MAX_DEPTH = 220, 520, 6


@dataclass(frozen=True)
class Request:
    """Limits and filters of a projection; lists are trimmed, distinct and sorted, empty lists filter nothing."""

    roots: tuple[str, ...] = ()
    direction: str = "both"
    depth: int = 2
    nodes: int = MAX_NODES
    edges: int = MAX_EDGES
    node_types: tuple[str, ...] = ()
    edge_types: tuple[str, ...] = ()
    levels: tuple[str, ...] = ()
    confidence: float = 0.0
    offset: int = 0
    seeds: int = 24

    def __post_init__(self):
        if not 0 <= self.depth <= MAX_DEPTH or not 1 <= self.nodes <= MAX_NODES or not 0 <= self.edges <= MAX_EDGES:
            raise ValueError("depth, nodes or edges out of bounds")
        if not 0 <= self.confidence <= 1 or self.direction not in ("incoming", "outgoing", "both") or not 1 <= self.seeds <= 100 or self.offset < 0:
            raise ValueError("confidence, direction, seeds or offset out of bounds")
        for name in ("roots", "node_types", "edge_types", "levels"):
            values = tuple(sorted({v.strip() for v in getattr(self, name) if v.strip()}))
            if any(len(v) > 200 for v in values):
                raise ValueError("filter values have 200 characters at most")
            object.__setattr__(self, name, values)


# --- filters ----------------------------------------------------------------------------------------


def filtered(nodes: DataFrame, edges: DataFrame, r: Request) -> tuple[DataFrame, DataFrame]:
    """Nodes of the wanted types; edges with both ends among them, of wanted type and level, and confident enough."""
    n = nodes.filter(F.col("type").isin(*r.node_types)) if r.node_types else nodes
    e = edges.filter(F.col("confidence") >= r.confidence)
    e = e.filter(F.col("type").isin(*r.edge_types)) if r.edge_types else e
    e = e.filter(F.col("evidence_level").isin(*r.levels)) if r.levels else e
    return n, with_ends(n, e)


def with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that lack an end, with the message of their diagnostic."""
    ids = nodes.select("id").distinct().withColumn("_k", F.lit(True))
    e = edges.join(ids.select(F.col("id").alias("source"), F.col("_k").alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.col("_k").alias("_t")), "target", "left")
    text = F.concat(F.lit("Dropped graph edge with missing endpoint: "), "source", F.lit(" -["), "type", F.lit("]-> "), "target")
    return e.filter("_s is null or _t is null").select("source", "target", "type", text.alias("message"))


def ends(edges: DataFrame) -> DataFrame:
    """Distinct ids of all ends."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def view_map(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = nodes.filter(F.col("type").isin(*MAP_NODES))
    return n, with_ends(n, edges.filter(F.col("type").isin("contains", "defines", "exposes_endpoint")))


def view_dependencies(nodes: DataFrame, edges: DataFrame, scope: str = "adaptive", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Import edges and their ends: internal ones, all ones, or (``adaptive``) internal ones where there are any."""
    imports = edges.filter(F.col("type").isin("imports", "imports_internal"))
    internal = imports.filter("type = 'imports_internal'").select(F.lit(True).alias("_any")).limit(1)
    if scope == "adaptive":
        some = imports.crossJoin(F.broadcast(internal.agg(F.count("*").alias("_n")))).filter((F.col("_n") == 0) == (F.col("type") == "imports")).drop("_n")
    else:
        some = imports.filter(F.col("type") == ("imports_internal" if scope == "internal" else "imports"))
    if path is not None:
        own = nodes.filter((F.col("file_path") == path)).select("id")
        hit = some.join(own.withColumnRenamed("id", "source"), "source", "left_semi").union(some.join(own.withColumnRenamed("id", "target"), "target", "left_semi").select(some.columns))
        some = hit.distinct()
    return nodes.join(ends(some), "id", "left_semi"), with_ends(nodes, some)


def view_api_flow(nodes: DataFrame, edges: DataFrame, endpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    e = edges.filter(F.col("type").isin("calls_api", "exposes_endpoint", "contains_call", "calls"))
    if endpoint is not None:
        e = e.filter((F.col("source") == endpoint) | (F.col("target") == endpoint))
    keep = ends(e).withColumn("_k", F.lit(True))
    n = nodes.join(keep, "id", "left").filter(F.col("_k").isNotNull() | F.col("type").isin("endpoint", "api_call", "call_site")).drop("_k")
    return n, with_ends(n, e)


def view_function_flow(nodes: DataFrame, edges: DataFrame, symbol: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Call edges; with a root those that touch its two-step neighbourhood, so what is three steps away shows too."""
    e = edges.filter(F.col("type").isin(*CALL_EDGES))
    if symbol is not None:
        near = reachable(e, symbol, 2)
        e = _touching(e, near)
    keep = ends(e).withColumn("_k", F.lit(True))
    n = nodes.join(keep, "id", "left").filter(F.col("_k").isNotNull() | F.col("type").isin("function", "method")).drop("_k")
    return n, with_ends(n, e)


def view_data_flow(nodes: DataFrame, edges: DataFrame, symbol: str | None = None) -> tuple[DataFrame, DataFrame]:
    n, e = nodes.filter("type = 'dfg_node'"), edges.filter(F.col("type").startswith("dfg_"))
    if symbol is not None:
        near = reachable(e, symbol, 3)
        n, e = n.join(near, "id", "left_semi"), _touching(e, near)
    return n, with_ends(n, e)


def _touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    a = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(edges.columns)
    b = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)
    return a.union(b).distinct()


# --- de-duplication and normalisation ---------------------------------------------------------------


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, type): the most confident, the first (seq) of equals."""
    rest = [c for c in edges.columns if c not in ("source", "target", "type")]
    best = edges.groupBy("source", "target", "type").agg(F.max_by(F.struct(*rest), F.struct("confidence", -F.col("seq"))).alias("b"), F.min("seq").alias("first_seq"))
    return best.select("source", "target", "type", *[F.col("b")[c].alias(c) for c in rest], "first_seq")


def normal_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with known types and the defaults of their type, path and label."""
    kind = F.when(F.col("type").isin(*NODE_TYPES), F.col("type")).otherwise("unknown")
    path = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    return nodes.select(
        "id",
        kind.alias("type"),
        F.when(kind != F.col("type"), F.col("type")).alias("original_type"),
        F.substring("label", 1, 180).alias("label"),
        path.alias("file_path"),
        P.node_summary(kind, F.col("label"), path).alias("summary"),
        F.array_join(P.clean_tags(P.inferred_tags(kind, path, F.col("label"))), ",").alias("tags"),
        P.kind_complexity(kind).alias("complexity"),
        P.layer(kind, path).alias("layer"),
        F.coalesce("role", P.node_role(kind)).alias("role"),
    )


def normal_edges(edges: DataFrame) -> DataFrame:
    kind = F.when(F.col("type").isin(*EDGE_TYPES), F.col("type")).otherwise("related_to")
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    level = F.when(F.col("evidence_level").isin(*EVIDENCE), F.col("evidence_level")).otherwise("inferred")
    return edges.select("source", "target", kind.alias("type"), F.when(kind != F.col("type"), F.col("type")).alias("original_type"), sure.alias("confidence"), level.alias("evidence_level"), F.round(sure, 4).alias("weight"))


def merged_nodes(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """One node for each id: of every attribute the first value in arrival order that isn't empty; tags are united."""
    first = lambda c, bad=None: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.lit(True) if bad is None else F.col(c) != bad), F.col(seq)))
    return nodes.groupBy("id").agg(
        F.coalesce(first("type", "unknown"), F.max("type")).alias("type"), first("label").alias("label"), first("file_path").alias("file_path"), first("role").alias("role"),
        F.coalesce(first("coverage", "mapped"), F.max("coverage")).alias("coverage"),
        F.array_join(P.clean_tags(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(seq, "tags"))), lambda x: x["tags"]))), ",").alias("tags"),
    )


# --- degrees ---------------------------------------------------------------------------------------


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out, degree) of every node; a loop counts on both sides."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    sums = sides.groupBy("x.id").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))
    rows = nodes.select("id").join(sums, "id", "left").fillna(0, ["n_in", "n_out"])
    return rows.select("id", "n_in", "n_out", (F.col("n_in") + F.col("n_out")).alias("degree"))


def degree_threshold(degree: DataFrame) -> DataFrame:
    """One row: the nearest-rank 75th percentile of degrees, and the least degree of a starting point."""
    tally = degree.groupBy("degree").agg(F.count("*").alias("_n"))  # a row for each degree there is
    summed = tally.withColumns({"_sum": F.sum("_n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(Window.partitionBy())})
    n = summed.agg(F.coalesce(F.max("_all"), F.lit(0)).alias("n"), F.coalesce(F.min(F.when(4 * F.col("_sum") >= 3 * F.col("_all"), F.col("degree"))), F.lit(0)).cast("long").alias("threshold"))
    return n.select("threshold", F.when(F.col("n") <= 3, F.greatest(F.lit(1), "threshold")).otherwise(F.greatest(F.lit(2), "threshold")).alias("least"))


# --- traversal -------------------------------------------------------------------------------------


def _both(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    step = out if direction == "outgoing" else back if direction == "incoming" else out.union(back)
    return step.distinct()


def traverse(nodes: DataFrame, edges: DataFrame, roots: DataFrame, direction: str = "both", depth: int = 2) -> DataFrame:
    """(id, depth): nodes within ``depth`` steps of any of ``roots`` (id) that is a node; roots have depth 0.

    ``depth`` is 6 at most. Each level joins the frontier with the edges and takes off what
    has been seen, so no path is followed twice.
    """
    step = cut(_both(with_ends(nodes, edges), direction))  # joined once a level
    seen = nodes.select("id").join(roots.select("id").distinct(), "id", "left_semi").distinct().withColumn("depth", F.lit(0))
    front = seen
    for level in range(1, min(depth, MAX_DEPTH) + 1):
        found = front.select(F.col("id").alias("a")).join(step, "a").select(F.col("b").alias("id")).distinct()
        front = cut(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def visit_order(visited: DataFrame) -> DataFrame:
    """``visited`` with ``visit_no`` from 0: by depth, then id."""
    return numbered(visited, ["depth", "id"], "visit_no").withColumn("visit_no", F.col("visit_no").cast("int"))


def reachable(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(id): what lies within ``depth`` undirected steps of the root, the root itself even if no edge has it."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(root,)], "id string")
    return traverse(ends(edges).union(start).distinct(), edges, start, "both", depth).select("id")


def project(nodes: DataFrame, edges: DataFrame, r: Request) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges within the request's bounds, in order, and one row of counts.

    Filter, traverse (without roots: everything), order nodes by visit, type and id and edges
    by type, ends and confidence, cut both to their budgets. ``truncation`` names what was
    cut; ``missing_roots`` are those that no node has.
    """
    n, e = filtered(nodes, edges, r)
    spark = nodes.sparkSession
    if r.roots:
        roots = spark.createDataFrame([(x,) for x in r.roots], "id string")
        n = n.join(cut(traverse(n, e, roots, r.direction, r.depth)), "id")
        e = with_ends(n, e)
        missing = roots.join(nodes.select("id"), "id", "left_anti")
    else:
        n = n.withColumn("depth", F.lit(0))
        missing = None
    order = ["depth", "id"] if r.roots else ["type", "id"]
    kept = n.orderBy(*order).limit(r.nodes)
    # places of the nodes kept are those among all visited, as what is kept comes first
    place = F.row_number().over(Window.orderBy(*order)) - 1 if r.roots else F.lit(0)
    kept = kept.withColumn("visit_no", place).drop("depth")
    fit = with_ends(kept, e)
    shown = fit.orderBy("type", "source", "target", F.desc("confidence")).limit(r.edges)
    counts = [
        n.agg(F.count("*").alias("available_nodes")), kept.agg(F.count("*").alias("included_nodes")), e.agg(F.count("*").alias("available_edges")),
        fit.agg(F.count("*").alias("_fit")), shown.agg(F.count("*").alias("included_edges")),
        missing.agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("missing_roots")) if missing is not None else spark.range(1).select(F.lit("").alias("missing_roots")),
    ]
    row = counts[0]
    for c in counts[1:]:
        row = row.crossJoin(c)
    cut_n, cut_e = F.col("available_nodes") > F.col("included_nodes"), F.col("_fit") > F.col("included_edges")
    reason = F.when(cut_n & cut_e, "node_and_edge_budget").when(cut_n, "node_budget").when(cut_e, "edge_budget")
    more = (cut_n & F.lit(r.nodes < MAX_NODES)) | (cut_e & F.lit(r.edges < MAX_EDGES))
    state = F.when(cut_n | cut_e | (F.col("missing_roots") != ""), "limited").otherwise("ready")
    row = row.withColumns({"truncation": reason, "can_expand": more, "state": state}).drop("_fit")
    return kept, shown, row


def neighbour_page(nodes: DataFrame, edges: DataFrame, root: str, r: Request) -> tuple[DataFrame, DataFrame]:
    """A page of the root's neighbours after ``offset``, the root first; and counts of what is left."""
    n, e = filtered(nodes, edges, r)
    start = nodes.sparkSession.createDataFrame([(root,)], "id string")
    visited = n.join(cut(traverse(n, e, start, r.direction, 1)), "id")
    order = [F.col("id") != root, "depth", "id", "type"]
    first = visited.orderBy(*order).limit(r.offset + r.nodes)
    ranked = first.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("visit_no", F.col("_n")).drop("depth")
    page = ranked.filter((F.col("_n") == 0) & (F.col("id") == root) | (F.col("_n") > r.offset) & (F.col("_n") < r.offset + r.nodes)).drop("_n")
    inn = e.filter(F.col("target") == root).select(F.col("source").alias("id"), F.lit("in").alias("side"))
    out = e.filter(F.col("source") == root).select(F.col("target").alias("id"), F.lit("out").alias("side"))
    wanted = {"incoming": inn, "outgoing": out, "both": inn.union(out)}[r.direction].select("id").distinct()
    shown = wanted.join(page.filter(F.col("id") != root).select("id"), "id", "left_semi")
    row = (
        inn.select("id").distinct().agg(F.count("*").alias("incoming")).crossJoin(out.select("id").distinct().agg(F.count("*").alias("outgoing")))
        .crossJoin(wanted.agg(F.count("*").alias("available"))).crossJoin(shown.agg(F.count("*").alias("included")))
    )
    left = F.greatest(F.lit(0), F.col("available") - r.offset - F.col("included"))
    row = row.withColumns({"remaining": left, "next_offset": F.when(left > 0, F.lit(r.offset) + F.col("included")), "leaf": F.col("available") == 0})
    return page, row


# --- starting points -----------------------------------------------------------------------------


def _reasons(pairs: list[tuple[Column, str]], default: str | None = None) -> Column:
    found = F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]))
    joined = F.array_join(found, ",")
    return F.when(joined == "", default).otherwise(joined) if default else joined


def _page(rows: DataFrame, order: list, r: Request) -> DataFrame:
    """Rows numbered from 1 after ``offset``, as many as ``seeds``."""
    n = F.row_number().over(Window.orderBy(*order))
    return rows.orderBy(*order).limit(r.offset + min(r.seeds, r.nodes)).withColumn("position", n).filter((F.col("position") > r.offset) & (F.col("position") <= r.offset + min(r.seeds, r.nodes)))


def dependency_seeds(nodes: DataFrame, edges: DataFrame, endpoint_paths: DataFrame, r: Request) -> DataFrame:
    """Files to start from: entrypoints, endpoint owners and nodes of high degree, one of each region first.

    endpoint_paths: (file_path). Scores 8 for an entrypoint, 6 for an endpoint's owner, 4 for a
    bridge, twice the edges in and the edges out.
    """
    n, e = filtered(nodes, edges, r)
    degree = cut(degrees(n, e))
    limits = F.broadcast(degree_threshold(degree))
    owner = endpoint_paths.select("file_path").distinct().withColumn("_owner", F.lit(True))
    rows = n.join(degree, "id").join(owner, "file_path", "left").crossJoin(limits).withColumn("_owner", F.coalesce("_owner", F.lit(False)))
    last = F.lower(P.name(F.coalesce("file_path", F.lit(""))))
    entry = F.lower(F.coalesce("role", F.lit(""))).contains("entrypoint") | last.isin("main.py", "app.py", "server.py", "main.ts", "main.tsx")
    bridge = (F.col("n_in") > 0) & (F.col("n_out") > 0)
    many = F.greatest(F.lit(2), "threshold")
    pairs = [(entry, "application_entrypoint"), (F.col("_owner"), "endpoint_owner"), (bridge, "dependency_bridge"), (F.col("n_in") >= many, "many_dependents"), (F.col("n_out") >= many, "many_dependencies")]
    rows = rows.filter(entry | F.col("_owner") | (F.col("degree") >= F.col("least")))
    points = F.when(entry, 8).otherwise(0) + F.when(F.col("_owner"), 6).otherwise(0) + F.when(bridge, 4).otherwise(0) + 2 * F.col("n_in") + F.col("n_out")
    area = P.region(F.coalesce("file_path", "id"), F.col("type"))
    rows = rows.select("id", area.alias("region"), points.alias("score"), _reasons(pairs, "graph_region_representative").alias("reasons"), "n_in", "n_out")
    one = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("score"), "id"))
    rows = rows.withColumn("_again", one > 1)
    return _page(rows, ["_again", F.desc("score"), "region", "id"], r).drop("_again")


def _sided(nodes: DataFrame, edges: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """``nodes`` with n_in and n_out over all ``edges`` and flags that any outgoing edge has."""
    inn = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out"), *[F.bool_or(c).alias(k) for k, c in flags.items()])
    rows = nodes.join(inn, "id", "left").join(out, "id", "left").fillna(0, ["n_in", "n_out"])
    return rows.fillna(False, list(flags)) if flags else rows


def _eligible(edges: DataFrame, r: Request) -> DataFrame:
    e = edges.filter(F.col("confidence") >= r.confidence)
    e = e.filter(F.col("type").isin(*r.edge_types)) if r.edge_types else e
    return e.filter(F.col("evidence_level").isin(*r.levels)) if r.levels else e


def request_seeds(nodes: DataFrame, edges: DataFrame, r: Request) -> tuple[DataFrame, DataFrame]:
    """Entry points of requests, resolved ones first; and counts of endpoints, calls, resolved and matched ones."""
    every = nodes.filter(F.col("type").isin("endpoint", "api_call"))
    rows = _sided(every, _eligible(edges, r), {"_exposes": F.col("type") == "exposes_endpoint", "_calls": F.col("type") == "calls_api"})
    server = F.col("type") == "endpoint"
    ok = F.when(server, F.col("_exposes")).otherwise(F.col("_calls"))
    counts = rows.agg(
        F.count_if(server).alias("endpoints"), F.count_if(~server).alias("client_calls"), F.count_if(server & ok).alias("resolved_handlers"), F.count_if(~server & ok).alias("matched_calls")
    )
    wanted = [t for t in r.node_types if t in ("endpoint", "api_call")] or ["endpoint", "api_call"]
    first = F.when(server & ok, 0).when(~server & ok, 1).when(server, 2).otherwise(3)
    reasons = F.when(server, F.when(ok, "server_endpoint,handler_resolved").otherwise("server_endpoint,handler_unresolved")).otherwise(
        F.when(ok, "client_api_call,client_call_matched").otherwise("client_api_call,client_call_unmatched")
    )
    rows = rows.filter(F.col("type").isin(*wanted)).select("id", "type", F.lower("label").alias("_l"), first.alias("priority"), reasons.alias("reasons"), "n_in", "n_out")
    return _page(rows, ["priority", (F.col("type") != "endpoint"), "_l", "id"], r).drop("_l"), counts


def call_seeds(nodes: DataFrame, edges: DataFrame, endpoint_paths: DataFrame, r: Request) -> tuple[DataFrame, DataFrame]:
    """Functions and methods to start from: 10 for an endpoint's file, 8 for recursion, twice the callers, the callees."""
    e = _eligible(edges, r)
    rows = _sided(nodes.filter(F.col("type").isin("function", "method")), e, {"_self": F.col("source") == F.col("target")})
    owner = endpoint_paths.select("file_path").distinct().withColumn("_owner", F.lit(True))
    rows = rows.join(owner, "file_path", "left").fillna(False, ["_owner"])
    pairs = [(F.col("_owner"), "endpoint_handler"), (F.col("n_in") >= 2, "many_callers"), (F.col("n_out") >= 2, "many_callees"), (F.col("_self"), "direct_recursion"), (F.col("n_in") == 0, "no_supported_internal_caller")]
    points = F.when(F.col("_owner"), 10).otherwise(0) + F.when(F.col("_self"), 8).otherwise(0) + 2 * F.col("n_in") + F.col("n_out")
    counts = rows.agg(F.count("*").alias("callables"), F.count_if("_self").alias("recursive")).crossJoin(
        e.agg(
            F.count_if(F.col("type") == "calls").alias("resolved"), F.count_if(F.col("type").isin("calls_builtin", "calls_stdlib", "calls_framework", "calls_external")).alias("external"),
            F.count_if(F.col("type") == "calls_unresolved").alias("unresolved"),
        )
    )
    rows = rows.select("id", F.lower("label").alias("_l"), points.alias("score"), _reasons(pairs, "indexed_callable").alias("reasons"), "n_in", "n_out")
    return _page(rows, [F.desc("score"), "_l", "id"], r).drop("_l"), counts


def value_context(path: Column, line: Column, label: Column, ident: Column, root: str) -> Column:
    """Whether a value node is the root, or lies in the context that the root names.

    A context is ``trace:`` and URL-encoded JSON: a token (f path, l line, v value) or a scope
    (f path, s first and e last line).
    """
    prefix = "value-context:"
    if not root.startswith(prefix):
        return ident == root
    c = F.from_json(F.url_decode(F.lit(root[len(prefix) :])), "k string, f string, v string, l int, s int, e int")
    value = F.trim(F.regexp_replace(label, "^[^:]*:", ""))
    token = (c["k"] == "token") & (c["l"] == line) & (c["v"] == value)
    scope = (c["k"] == "scope") & (c["s"] > 0) & (line >= c["s"]) & (line <= F.coalesce(c["e"], c["s"]))
    return F.coalesce((ident == root) | ((c["f"] == path) & (token | scope)), F.lit(False))


def value_seeds(nodes: DataFrame, edges: DataFrame, r: Request) -> tuple[DataFrame, DataFrame]:
    """Values that match a root or context, by role, degree and place; and counts by role."""
    n, e = filtered(nodes, edges, r)
    hit = F.lit(False)
    for root in r.roots:
        hit = hit | value_context(F.col("file_path"), F.coalesce("start_line", F.lit(0)), F.col("label"), F.col("id"), root)
    rows = _sided(n.filter(hit), e, {})
    role = F.lower(F.coalesce("role", F.lit("unresolved")))
    known = role.isin("parameter", "definition", "use")
    first = cases([(role == "parameter", 0), (role == "definition", 1), (role == "use", 2)], 3)
    reasons = F.concat_ws(",", F.when(known, F.concat(F.lit("value_"), role)).otherwise("value_role_unresolved"), F.when(F.col("n_in") > 0, "has_supported_origin"), F.when(F.col("n_out") > 0, "has_supported_use"), F.when(F.col("n_out") >= 2, "multiple_supported_uses"))
    counts = rows.agg(F.count("*").alias("values"), *[F.count_if(role == x).alias(x) for x in ("parameter", "definition", "use")])
    rows = rows.select("id", first.alias("priority"), (F.col("n_in") + F.col("n_out")).alias("degree"), F.lower(F.coalesce("file_path", F.lit(""))).alias("_p"), F.coalesce("start_line", F.lit(0)).alias("_s"), reasons.alias("reasons"), "n_in", "n_out")
    return _page(rows, ["priority", F.desc("degree"), "_p", "_s", "id"], r).drop("_p", "_s"), counts


# --- building ----------------------------------------------------------------------------------------


def folder_chain(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder nodes (id, path, label, role) for every prefix of the paths and contains edges parent to child to file."""
    segments = F.slice(P.parts(F.col("path")), 1, F.size(P.parts(F.col("path"))) - 1)
    at = files.select("path", segments.alias("s")).select("path", "s", F.explode(F.when(F.size("s") > 0, F.sequence(F.lit(1), F.size("s")))).alias("n"))
    folder = F.array_join(F.slice("s", 1, F.col("n")), "/")
    above = F.when(F.col("n") > 1, F.array_join(F.slice("s", 1, F.col("n") - 1), "/")).otherwise(".")
    found = at.select(folder.alias("path"), above.alias("parent"), F.element_at("s", F.col("n")).alias("label")).distinct()
    ident = lambda kind, c: F.concat(F.lit(kind + "_"), F.substring(F.sha1(c), 1, 10))
    folders = found.select(ident("folder", F.col("path")).alias("id"), "path", "label", P.folder_role(F.col("path")).alias("role"))
    up = found.select(ident("folder", F.col("parent")).alias("source"), ident("folder", F.col("path")).alias("target"), F.lit(0.85).alias("confidence"))
    home = F.coalesce(F.nullif(F.array_join(segments, "/"), F.lit("")), F.lit("."))
    leaf = files.select(ident("folder", home).alias("source"), ident("file", F.col("path")).alias("target"), F.lit(0.95).alias("confidence"))
    return folders, up.union(leaf).withColumn("type", F.lit("contains"))


def file_tree(files: DataFrame) -> DataFrame:
    """(path, parent, depth, kind) of all folders and files."""
    folders, _ = folder_chain(files)
    rows = folders.select("path", F.lit("folder").alias("kind")).union(files.select("path", F.lit("file")))
    depth = F.size(P.parts(F.col("path")))
    parent = F.when(depth > 1, F.array_join(F.slice(P.parts(F.col("path")), 1, depth - 1), "/")).otherwise(".")
    return rows.select("path", parent.alias("parent"), depth.alias("depth"), "kind")


def match_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(call_id, endpoint_id) for calls (call_id, label) that fit exactly one endpoint (endpoint_id, method, route).

    By method and route shape; calls without any such endpoint fit those whose shape ends
    theirs, ``/`` excepted. Suffixes are found by an equi-join over the endings of the call's route.
    """
    from corpusmill.functions import text as X

    c = calls.select("call_id", X.call_method(F.col("label")).alias("method"), X.route_shape(X.call_route(F.col("label"))).alias("shape")).filter("method is not null")
    e = endpoints.select("endpoint_id", F.upper("method").alias("method"), X.route_shape(F.col("route")).alias("shape"))
    direct = c.join(e, ["method", "shape"]).select("call_id", "endpoint_id")
    rest = c.join(direct, "call_id", "left_anti")
    tails = rest.select("call_id", "method", F.explode(F.transform(F.sequence(F.lit(1), F.length("shape")), lambda i: F.substr("shape", i))).alias("shape"))
    loose = tails.join(e.filter("shape <> '/'"), ["method", "shape"]).select("call_id", "endpoint_id")
    both = direct.union(loose)
    return both.groupBy("call_id").agg(F.count("*").alias("n"), F.min("endpoint_id").alias("endpoint_id")).filter("n = 1").select("call_id", "endpoint_id")


def handler_symbols(endpoints: DataFrame, symbols: DataFrame) -> DataFrame:
    """(endpoint_id, symbol_id): the last (seq) function or method of the handler's name in the endpoint's file."""
    last = symbols.filter(F.col("symbol_type").isin("function", "method")).groupBy("path", F.col("name").alias("handler")).agg(F.max_by("symbol_id", "seq").alias("symbol_id"))
    return endpoints.join(last, ["path", "handler"]).select("endpoint_id", "symbol_id")
