"""Lifecycles as joins and windows: phases with resume, import sessions, imports with quarantine, clients behind aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.tables import cut

# --- phases ----------------------------------------------------------------------------------------


def phase_key(run: Column, phase: Column, version: Column, configuration: Column, artifacts: Column) -> Column:
    """A phase's idempotency key: sha256 over its identity and its inputs, ``artifacts`` being (type, sha256) structs in any order."""
    told = F.transform(F.array_sort(artifacts), lambda a: F.concat_ws("=", a["type"], a["sha256"]))
    return F.sha2(F.concat_ws("|", run.cast("string"), phase, version, configuration, F.array_join(told, ",")), 256)


def resume(phases: DataFrame, initial: DataFrame, checkpoints: DataFrame, stored: DataFrame, configuration: Column) -> DataFrame:
    """(run, next_phase, reused, stopped_by): for every run how many phases are reused, which, and why the next one isn't.

    phases: (ordinal, phase, version, inputs array of artifact types), the same for all runs; initial: (run, type, sha256);
    checkpoints: (run, ordinal, phase, key, type, sha256), one row for each output of a
    phase; stored: (run, type, sha256) as found now. A phase is reused if all before it are, its checkpoint is of that
    phase, its key follows from its inputs as they stand, and its outputs are stored unchanged. A phase's inputs are the
    latest outputs of earlier phases, else the initial artifacts; a key thus changes with everything it comes from.
    ``stopped_by`` is missing_checkpoint, other_phase, missing_input, other_key or damaged_output; null if all phases are reused.
    """
    runs = initial.select("run").distinct()
    wanted = runs.crossJoin(phases.select("ordinal", "phase", "version", "inputs"))  # a row for each phase of each run
    needs = wanted.select("run", "ordinal", F.explode_outer("inputs").alias("type"))
    offers = initial.select("run", "type", "sha256", F.lit(-1).alias("_at")).union(checkpoints.select("run", "type", "sha256", "ordinal"))
    met = needs.join(offers, ["run", "type"], "left").filter("_at is null or _at < ordinal").groupBy("run", "ordinal", "type").agg(F.max_by("sha256", "_at").alias("sha256"))
    pool = met.groupBy("run", "ordinal").agg(F.collect_list(F.when(F.col("sha256").isNotNull(), F.struct("type", "sha256"))).alias("_in"))
    kept = stored.select("run", "type", F.col("sha256").alias("_now"))
    have = checkpoints.join(kept, ["run", "type"], "left").groupBy("run", "ordinal").agg(F.first("phase").alias("_phase"), F.first("key").alias("_key"), F.bool_and(F.coalesce(F.col("sha256") == F.col("_now"), F.lit(False))).alias("_sound"))
    rows = wanted.join(pool, ["run", "ordinal"], "left").join(have, ["run", "ordinal"], "left")
    inputs = F.coalesce("_in", F.array().cast("array<struct<type:string,sha256:string>>"))
    key = phase_key(F.col("run"), F.col("phase"), F.col("version"), configuration, inputs)
    wrong = F.when(F.col("_key").isNull(), "missing_checkpoint").when(F.col("_phase") != F.col("phase"), "other_phase").when(F.size(inputs) < F.size("inputs"), "missing_input").when(F.col("_key") != key, "other_key").when(~F.col("_sound"), "damaged_output")
    first = rows.select("run", "ordinal", "phase", wrong.alias("_w")).withColumn("_bad", F.max(F.col("_w").isNotNull()).over(Window.partitionBy("run").orderBy("ordinal")))
    reused = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_bad"), F.struct("ordinal", "phase")))), lambda x: x["phase"]), ",")
    return first.groupBy("run").agg(F.count_if(~F.col("_bad")).cast("int").alias("next_phase"), reused.alias("reused"), F.min_by(F.when(F.col("_bad"), F.col("_w")), F.when(F.col("_bad"), F.col("ordinal"))).alias("stopped_by"))


# --- import sessions ---------------------------------------------------------------------------------


def import_sessions(events: DataFrame, gap: str = "6 hours", by: str = "user_id", late: str | None = None) -> DataFrame:
    """(by, opened, expires, events, files, failed, status): import sessions of an event stream or table (by, event_id, ts, event_type).

    A session goes on while the next event of its owner comes before ``gap`` has passed, and expires that long after its last. Types: ``view``
    and ``click`` add files, ``error`` is a failed file, ``purchase`` confirms, ``signup`` cancels. The session is cancelled if any event cancels
    it, else confirmed if any confirms, else failed if all its files have failed, else expired. Events that repeat an event_id count once. On a stream
    ``late`` is how late an event may come: a session is told once the watermark has passed its end, and what comes later is left out.
    """
    rows = events.select(by, "event_id", "ts", "event_type")
    rows = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if late else rows.dropDuplicates(["event_id"])
    window = F.session_window("ts", gap)
    kind = F.col("event_type")
    some = rows.groupBy(by, window.alias("_s")).agg(F.count("*").alias("events"), F.count_if(kind.isin("view", "click")).alias("files"), F.count_if(kind == "error").alias("failed"), F.bool_or(kind == "signup").alias("_no"), F.bool_or(kind == "purchase").alias("_yes"))
    status = F.when(F.col("_no"), "cancelled").when(F.col("_yes"), "confirmed").when((F.col("files") == 0) & (F.col("failed") > 0), "failed").otherwise("expired")
    return some.select(by, F.col("_s.start").alias("opened"), F.col("_s.end").alias("expires"), "events", "files", "failed", status.alias("status"))


# --- imports with quarantine ----------------------------------------------------------------------------


def quarantine(tables: dict[str, tuple[DataFrame, str]], references: list[tuple[str, str, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Accepted rows by table, and refused ones (table, key, reason), of tables (rows, key column) that refer to each other.

    references: (table, column, parent table), without cycles, parents before children in ``tables``. A row is refused if its key is null or comes twice, or if a reference
    is null, names no row of the parent, or names one that is refused itself, through any number of tables. The first
    reason in that order, then in the order of the references, counts.
    """
    kept, refused = {}, None
    for name, (rows, key) in tables.items():
        many = rows.groupBy(key).agg(F.count("*").alias("_many"))
        some = rows.join(many, key, "left")
        reasons = [F.when(F.col(key).isNull(), "null_key").when(F.col("_many") > 1, "duplicate_key")]
        for n, (_, column, parent) in enumerate(r for r in references if r[0] == name):
            if parent not in kept:
                raise ValueError(f"{parent} comes before {name}")
            there = tables[parent][0].select(F.col(tables[parent][1]).alias(column)).distinct().withColumn(f"_there{n}", F.lit(True))
            good = kept[parent].select(F.col(tables[parent][1]).alias(column)).withColumn(f"_good{n}", F.lit(True))
            some = some.join(there, column, "left").join(good, column, "left")
            reasons.append(F.when(F.col(column).isNull(), f"null:{column}").when(F.col(f"_there{n}").isNull(), f"missing:{column}").when(F.col(f"_good{n}").isNull(), f"refused:{column}"))
        told = cut(some.select(*rows.columns, F.coalesce(*reasons).alias("_reason")))
        kept[name] = told.filter("_reason is null").drop("_reason")
        bad = told.filter("_reason is not null").select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.col("_reason").alias("reason"))
        refused = bad if refused is None else refused.union(bad)
    return kept, refused


# --- clients -------------------------------------------------------------------------------------------


def client_routes(bindings: DataFrame, calls: DataFrame, roots: tuple[str, ...] = ("axios",)) -> DataFrame:
    """(file, line, client, method, route): calls of HTTP clients by full route, through aliases, imports and base URLs of any number of files.

    bindings: (file, name, kind, of, module, base): ``alias`` and ``create`` bind a name to another of the file, ``create`` with a base path;
    ``import`` binds it to the name ``of`` of the file ``module``, or to the package itself where that is a root. calls: (file, line, client, method, route). A later binding
    of a name in a file (by ``line``) shadows earlier ones. Base paths join from the root on; names that never lead to a root, loops included, are no clients.
    """
    last = bindings.withColumn("_n", F.row_number().over(Window.partitionBy("file", "name").orderBy(F.desc("line")))).filter("_n = 1")
    base = F.regexp_replace(F.coalesce("base", F.lit("")), r"^[a-z]+://[^/]*|/+$", "")
    last = cut(last.select("file", "name", "kind", "of", "module", base.alias("base")))
    package = (F.col("kind") == "import") & F.col("module").isin(*roots)
    direct = (F.col("kind") != "import") & F.col("of").isin(*roots)
    own = last.select("file", F.col("name").alias("of"), F.lit(True).alias("_own"))
    shadowed = last.join(own, ["file", "of"], "left")
    front = cut(shadowed.filter(package | (direct & F.col("_own").isNull())).select("file", "name", F.when(F.col("kind") == "create", F.col("base")).otherwise("").alias("path")))
    found = front
    source = F.when(F.col("kind") == "import", F.col("module")).otherwise(F.col("file"))
    links = cut(last.filter(~package).select("file", "name", source.alias("_f"), F.col("of").alias("_o"), F.when(F.col("kind") == "create", F.col("base")).otherwise("").alias("_b")))
    while True:
        at = front.select(F.col("file").alias("_f"), F.col("name").alias("_o"), "path")
        front = cut(links.join(at, ["_f", "_o"]).select("file", "name", F.concat("path", "_b").alias("path")).join(found.select("file", "name"), ["file", "name"], "left_anti"))
        if front.isEmpty():
            break
        found = found.union(front)
    known = found.select("file", F.col("name").alias("client"), "path")
    every = calls.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, roots))).alias("client"), F.lit("").alias("path")).join(last.select("file", F.col("name").alias("client")), ["file", "client"], "left_anti")
    route = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("route", r"^[a-z]+://[^/]*|[?#].*$", ""), r"^/+|/+$", ""))
    full = F.regexp_replace(F.concat("path", F.when((F.col("path") != "") & (route == "/"), "").otherwise(route)), r"/+$", "")
    return calls.join(known.union(every), ["file", "client"]).select("file", "line", "client", F.upper("method").alias("method"), F.when(full == "", "/").otherwise(full).alias("route"))
