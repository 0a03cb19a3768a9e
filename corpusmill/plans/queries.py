"""Registered queries over the lifted tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import paths as P
from corpusmill.functions import text as X
from corpusmill.functions.tables import cut
from corpusmill.operators import architecture as A
from corpusmill.operators import diff as D
from corpusmill.operators import evaluation as EV
from corpusmill.operators import evidence as E
from corpusmill.operators import files as FI
from corpusmill.operators import fusion as FU
from corpusmill.operators import graph as G
from corpusmill.operators import impact as I
from corpusmill.operators import jobs as J
from corpusmill.operators import retrieval as R
from corpusmill.plans import lift as L
from corpusmill.plans.lift import with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
col, lit = F.col, F.lit


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def listed(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


# --- text functions ---------------------------------------------------------------------------------


@query(
    with_sql(
        ["chunks"],
        r"""SELECT chunk_id, CASE WHEN length(t) <= 420 THEN t ELSE left(t, 420) || '...' END AS preview, sha256(content) AS hash, 'chunk_' || left(sha1(path), 10) AS node,
  left(sha1(path || chr(31) || line), 16) AS stable, 'frag_' || left(sha256(path || chr(31) || line), 32) AS prod, greatest(1, (length(content) + 3) // 4)::INT AS memory_tokens,
  (24 + ceil(length(content) / 4))::INT AS evidence_tokens, line || '-' || (line + 2) AS span,
  'evidence_' || left(sha256('["repo","v1","' || path || '",' || line || ',' || (line + 2) || ']'), 24) AS evidence
  FROM (SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS t FROM chunks)""",
    )
)
def text_ids(spark, sf_dir):
    """Previews, hashes, ids and token estimates of chunks."""
    c = L.chunks(spark, sf_dir)
    return c.select(
        "chunk_id", X.preview(col("content")).alias("preview"), X.content_hash(col("content")).alias("hash"), X.node_id(lit("chunk"), col("path")).alias("node"),
        X.joined_hash([col("path"), col("line")]).alias("stable"), X.production_id("frag_", [col("path"), col("line")]).alias("prod"),
        X.memory_tokens(col("content")).alias("memory_tokens"), X.evidence_tokens(col("content")).alias("evidence_tokens"), X.line_range(col("line"), col("line") + 2).alias("span"),
        X.evidence_id([lit("repo"), lit("v1"), col("path")], [col("line"), col("line") + 2]).alias("evidence"),
    )


_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_/.-]+')"
_STOP = listed(X.STOPWORDS)


def _terms(c: str) -> str:
    """Distinct query terms in order of first occurrence."""
    t = _TOKENS.format(c)
    return f"list_transform(list_sort(list_distinct(list_transform(list_filter({t}, lambda w: length(w) > 1 AND w NOT IN {_STOP}), lambda w: {{'p': list_position({t}, w), 'w': w}}))), lambda s: s.w)"


@query(with_sql(["questions"], f"SELECT query_id, array_to_string({_TOKENS.format('query')}, ' ') AS tokens, array_to_string({_terms('query')}, ' ') AS terms FROM questions"))
def query_terms(spark, sf_dir):
    q = L.questions(spark, sf_dir)
    return q.select("query_id", F.array_join(X.tokens(col("query")), " ").alias("tokens"), F.array_join(X.query_terms(col("query")), " ").alias("terms"))


def _classify_sql() -> str:
    hit = lambda s: f"contains(lower(q), '{s}')"
    kinds = " ".join(f"WHEN {' OR '.join(map(hit, sig))} THEN '{k}'" for k, sig in X.QUESTION_RULES)
    why = " ".join(
        f"WHEN {' OR '.join(map(hit, sig))} THEN concat_ws(',', {', '.join(f'CASE WHEN {hit(s)} THEN {chr(39)}matched:{s}{chr(39)} END' for s in sig)})" for _, sig in X.QUESTION_RULES
    )
    words = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.REPAIR_WORDS.items())
    return f"""SELECT id, kind, CASE WHEN kind = 'code_question' THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence, CASE {why} ELSE 'default:code_question' END AS reasons,
  trim(q) || ' ' || CASE kind {words} ELSE 'source definition reference' END AS repair, CASE WHEN kind IN ('flow_tracing', 'api_question', 'impact_analysis') THEN 2 ELSE 1 END AS required
  FROM (SELECT id, q, CASE {kinds} ELSE 'code_question' END AS kind FROM asked)"""


_ASKED = """asked AS (SELECT conv_id || ':' || turn AS id, text || ['', ' API error', ' flow overview', ' table model', ' impact', ' 401', ' onboarding'][turn % 7 + 1] AS q FROM conversations)"""


@query("WITH " + _ASKED + "\n" + _classify_sql())
def question_types(spark, sf_dir):
    tail = F.element_at(F.array(*map(lit, ["", " API error", " flow overview", " table model", " impact", " 401", " onboarding"])), (col("turn") % 7 + 1).cast("int"))
    rows = L.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat("text", tail).alias("q"))
    kind = X.question_type(col("q"))
    return rows.select(
        "id", kind.alias("kind"), X.question_confidence(col("q")).alias("confidence"), X.question_reasons(col("q")).alias("reasons"), X.repair_query(kind, col("q")).alias("repair"), X.required_evidence(kind).alias("required")
    )


_ROUTE = "coalesce(nullif(regexp_replace(CASE WHEN starts_with(lower(trim({0})), '/api') THEN substr(lower(trim({0})), 5) ELSE lower(trim({0})) END, '/+$', ''), ''), '/')"
_SHAPE = r"regexp_replace(regexp_replace(" + _ROUTE.format("split_part({0}, '?', 1)") + r", '\{{[^/{{}}]+\}}', '{{}}', 'g'), ':[A-Za-z_$][A-Za-z0-9_$]*', '{{}}', 'g')"
_PAGE_ROUTES = r"""routes AS (SELECT page_id, ['', '/api', '/API/v1', ' /apix'][page_id % 4 + 1] || regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '#.*$', '') || ['', '/', '/{id}', '/:key/'][page_id % 4 + 1] AS raw FROM pages)"""


def _routes(spark, sf_dir):
    pick = lambda items: F.element_at(F.array(*map(lit, items)), (col("page_id") % 4 + 1).cast("int"))
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "#.*$", "")
    return L.table(spark, sf_dir, "pages").select("page_id", F.concat(pick(["", "/api", "/API/v1", " /apix"]), path, pick(["", "/", "/{id}", "/:key/"])).alias("raw"))


@query(
    "WITH " + _PAGE_ROUTES + f"""
SELECT page_id, {_ROUTE.format('raw')} AS route, {_SHAPE.format('raw')} AS shape,
  CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'GET' END AS method, CASE WHEN page_id % 3 = 0 THEN NULL ELSE trim(raw) END AS call_route,
  ends_with({_SHAPE.format('raw')}, '/{{}}') AS is_item FROM routes"""
)
def routes(spark, sf_dir):
    """Routes of page URLs: normalised, as shapes, and as the call labels that would ask for them."""
    rows = _routes(spark, sf_dir).withColumn("label", F.concat(F.when(col("page_id") % 3 == 0, "FETCH ").otherwise("get "), "raw"))
    return rows.select(
        "page_id", X.normalize_route(col("raw")).alias("route"), X.route_shape(col("raw")).alias("shape"), X.call_method(col("label")).alias("method"), X.call_route(col("label")).alias("call_route"),
        X.suffix_match(X.route_shape(col("raw")), lit("/{}")).alias("is_item"),
    )


@query(
    r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(left(m, 16000), '(?i)\b(bearer\s+)[a-z0-9._~+/=-]{8,}', '\1[REDACTED]', 'g'), '\b(?:sk[-_]|ghp_|github_pat_)[A-Za-z0-9_-]{8,}\b', '[REDACTED]', 'g'),
  '(?i)\b(password|passwd|api[_-]?key|access[_-]?token|secret)\b(\s*[:=]\s*)([^\s,;]+)', '\1\2[REDACTED]', 'g') AS message
  FROM (SELECT conv_id, turn, text || [' api_key=' || md5(text), ' Bearer ' || md5(text), ' sk-' || md5(text), ' secret : x,y', ''][turn % 5 + 1] AS m FROM conversations)"""
)
def redaction(spark, sf_dir):
    h = F.md5("text")
    tail = F.element_at(F.array(F.concat(lit(" api_key="), h), F.concat(lit(" Bearer "), h), F.concat(lit(" sk-"), h), lit(" secret : x,y"), lit("")), (col("turn") % 5 + 1).cast("int"))
    rows = L.table(spark, sf_dir, "conversations").withColumn("m", F.concat("text", tail))
    return rows.select("conv_id", "turn", X.redact(col("m")).alias("message"))


@query("SELECT event_id, least(60000, 1000 * 2 ** (event_id % 9))::BIGINT AS delay, (CASE WHEN event_type = 'signup' THEN 100 ELSE floor(100 * (event_id % 50) / greatest(user_id % 60, 1)) END)::INT AS progress FROM events")
def job_numbers(spark, sf_dir):
    e = L.table(spark, sf_dir, "events")
    return e.select("event_id", X.retry_delay(col("event_id") % 9 + 1).alias("delay"), J.progress(col("event_id") % 50, col("user_id") % 60, col("event_type") == "signup").alias("progress"))


# --- paths ------------------------------------------------------------------------------------------------

_NAME = "list_last(string_split(path, '/'))"
_SUFFIX = r"lower(regexp_extract(" + _NAME + r", '^.+(\.[^.]+)$', 1))"


def _language_sql() -> str:
    named = " ".join(f"WHEN {_NAME} = '{n}' THEN '{k}'" for k, (_, _, names, _) in P.LANGUAGES.items() for n in names)
    return f"CASE {named} " + " ".join(f"WHEN {_SUFFIX} IN {listed(s)} THEN '{k}'" for k, (_, s, _, _) in P.LANGUAGES.items() if s) + " ELSE 'unknown' END"


_TYPE = "CASE WHEN contains(lower(path), 'test') THEN 'test' WHEN lang IN {0} THEN 'source' WHEN lang = 'markdown' THEN 'document' ELSE 'config' END".format(listed([k for k, v in P.LANGUAGES.items() if v[3] == "source"]))
_DIRS = "string_split(path, '/')[:-2]"
_SECRET = f"(lower({_NAME}) <> '.env.example' AND (lower({_NAME}) = '.env' OR " + " OR ".join(f"contains(lower({_NAME}), '{s}')" for s in P.SECRETS) + "))"
_SKIP = f"CASE WHEN list_has_any({_DIRS}, [{', '.join(repr(d) for d in P.IGNORED_DIRS)}]) THEN 'ignored_directory' WHEN {_SECRET} THEN 'secret_file' WHEN lang = 'unknown' THEN 'unsupported_type' WHEN size_bytes > 1000000 THEN 'file_too_large' END"
_SAFE = (
    f"NOT (list_has_any(string_split(lower(path), '/')[:-2], [{', '.join(repr(d) for d in P.UNSAFE_DIRS)}]) OR starts_with(lower({_NAME}), '.env') OR contains(lower({_NAME}), 'secret') "
    f"OR contains(lower({_NAME}), 'credential') OR {_SUFFIX} IN {listed(P.UNSAFE_SUFFIXES)})"
)
SCANNED = f"scanned AS (SELECT *, {_TYPE} AS file_type, {_SKIP} AS skip_reason FROM (SELECT *, {_language_sql()} AS lang FROM catalogue))"


@query(with_sql(["catalogue"], SCANNED + f" SELECT seq, path, lang AS language, file_type, skip_reason, {_SAFE} AS safe, {_SECRET} AS secret FROM scanned"))
def file_rules(spark, sf_dir):
    """Language, type, reason to skip, and safety of catalogue files."""
    return FI.scan(L.catalogue(spark, sf_dir)).select("seq", "path", "language", "file_type", "skip_reason", P.safe_source(col("path")).alias("safe"), P.secret(col("path")).alias("secret"))


@query(with_sql(["catalogue"], SCANNED + " SELECT count(*) AS files, sum(size_bytes)::BIGINT AS size, count(*) FILTER (skip_reason IS NULL) AS supported, coalesce(sum(size_bytes) FILTER (skip_reason IS NULL), 0)::BIGINT AS supported_size FROM scanned"))
def scan_totals(spark, sf_dir):
    return FI.scan_totals(FI.scan(L.catalogue(spark, sf_dir)))


@query(with_sql(["catalogue"], SCANNED + " SELECT skip_reason, count(*) AS n FROM scanned WHERE skip_reason IS NOT NULL GROUP BY 1"))
def skip_summary(spark, sf_dir):
    return FI.skip_summary(FI.scan(L.catalogue(spark, sf_dir)))


@query(with_sql(["catalogue"], SCANNED + " SELECT lang AS language, count(*) AS files, count(*) FILTER (file_type = 'test') AS tests, sum(size_bytes)::BIGINT AS size FROM scanned WHERE skip_reason IS NULL GROUP BY 1"))
def language_counts(spark, sf_dir):
    return FI.language_counts(FI.scan(L.catalogue(spark, sf_dir)))


@query(
    with_sql(
        ["catalogue"],
        SCANNED + " SELECT greatest(1, ceil(round(0.03 * count(*) FILTER (skip_reason IS NULL) + 0.15 * coalesce(sum(size_bytes) FILTER (skip_reason IS NULL), 0) / 1048576 + coalesce(sum(CASE WHEN lang IN ('python', 'typescript', 'javascript') THEN 0.02 WHEN lang = 'java' THEN 0.015 ELSE 0 END) FILTER (skip_reason IS NULL), 0), 6)))::BIGINT AS seconds FROM scanned",
    )
)
def index_seconds(spark, sf_dir):
    return FI.index_seconds(FI.scan(L.catalogue(spark, sf_dir)))


def _cases_sql(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


_LOW = "lower(path)"
_LAYER = _cases_sql(
    [
        (f"list_has_any(string_split({_LOW}, '/'), ['frontend', 'client', 'ui'])", "'frontend'"), (f"list_has_any(string_split({_LOW}, '/'), ['backend', 'api', 'server'])", "'backend'"),
        (f"contains({_LOW}, 'test')", "'tests'"), (f"list_contains(string_split({_LOW}, '/'), 'docs')", "'documentation'"),
    ],
    "'application'",
)
_REGION = "lower(CASE WHEN len(s) >= 2 AND lower(s[1]) IN {0} THEN s[1] || '/' || s[2] ELSE coalesce(s[1], 'file') END)".format(listed(P.ROOT_DIRS))
_STEM = r"regexp_replace(" + _NAME + r", '^(.+)\.[^.]+$', '\1')"


def _domain_sql(role: str) -> str:
    out = listed([role, *P.REMOVABLE])
    more = listed([role, *P.REMOVABLE, *P.PLAIN_DIRS])
    words = r"list_filter(regexp_split_to_array(lower(regexp_replace(" + _STEM + r", '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[_\-.]+'), lambda w: w NOT IN " + out + ")"
    folders = f"list_filter(list_transform({_DIRS}, lambda w: lower(w)), lambda w: w NOT IN {more})"
    slug = lambda v: f"coalesce(nullif(regexp_replace(regexp_replace(lower({v}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'application')"
    return f"CASE WHEN len({words}) > 0 AND ({words})[1] NOT IN {listed(P.PLAIN_STEMS)} THEN {slug(f'array_to_string({words}, chr(45))')} ELSE {slug(f'coalesce(({folders})[-1], {chr(39)}application{chr(39)})')} END"


_IMPORTANT = _cases_sql(
    [
        (f"starts_with(lower({_NAME}), 'readme')", "0"), (f"lower({_NAME}) IN ('main.py', 'app.py', 'main.ts', 'main.tsx', 'index.ts', 'index.tsx')", "1"),
        (f"contains({_LOW}, 'router') OR contains({_LOW}, 'routes')", "2"), (f"contains('/' || {_LOW}, '/services/') OR ends_with(lower({_NAME}), '_service.py') OR ends_with(lower({_NAME}), 'service.ts') OR ends_with(lower({_NAME}), 'service.tsx')", "3"),
        (f"contains('/' || {_LOW}, '/repositories/') OR contains('/' || {_LOW}, '/models/') OR contains('/' || {_LOW}, '/schemas/')", "4"),
    ],
    "NULL",
)
_TAGS = "array_to_string(list_concat(['file'], list_filter([" + ", ".join(f"'{t}'" for t in P.TAG_WORDS) + f"], lambda t: contains(lower(path || ' ' || {_NAME}), t))), ',')"
_TITLE = lambda c: f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"


@query(
    with_sql(
        ["catalogue"],
        f"SELECT seq, {_LAYER} AS layer, {_REGION} AS region, {_domain_sql('api')} AS domain, {_IMPORTANT}::INT AS important, {_TAGS} AS tags, 'Source file ' || path || '.' AS summary, "
        f"(starts_with({_LOW}, 'tests/') OR contains({_LOW}, '/tests/') OR starts_with(lower({_NAME}), 'test_')) AS is_test, "
        f"CASE WHEN len(s) > 30 THEN 'too_deep' WHEN regexp_matches(path, '(^|/)\\.{{1,2}}(/|$)') THEN 'traversal' END AS path_error FROM (SELECT *, string_split(path, '/') AS s FROM catalogue)",
    )
)
def path_rules(spark, sf_dir):
    """Layer, region, domain, importance, tags and summary of catalogue files."""
    p = col("path")
    return L.catalogue(spark, sf_dir).select(
        "seq", P.layer(lit("file"), p).alias("layer"), P.region(p, lit("file")).alias("region"), P.domain(p, "api").alias("domain"), P.important_rank(p).alias("important"),
        F.array_join(P.clean_tags(P.inferred_tags(lit("file"), p, P.name(p))), ",").alias("tags"), P.node_summary(lit("file"), P.name(p), p).alias("summary"), P.is_test_path(p).alias("is_test"),
        P.relative_path_error(p).alias("path_error"),
    )


_REASONS = "['Project overview and setup', 'Application entrypoint candidate', 'API boundary', 'Application service', 'Data or schema boundary'][r + 1]"


@query(with_sql(["catalogue"], f"SELECT (row_number() OVER (ORDER BY r, path))::INT AS position, path, {_REASONS} AS reason FROM (SELECT DISTINCT path, {_IMPORTANT}::INT AS r FROM catalogue) WHERE r IS NOT NULL QUALIFY position <= 8"))
def important_files(spark, sf_dir):
    return FI.important(L.catalogue(spark, sf_dir).select("path").distinct())


@query(with_sql(["catalogue"], f"SELECT (row_number() OVER (ORDER BY r, path))::INT AS position, path, 'Read ' || {_NAME} AS title, round(0.95 - 0.05 * (position - 1), 2)::DOUBLE AS confidence FROM (SELECT DISTINCT path, {_IMPORTANT}::INT AS r FROM catalogue) WHERE r IS NOT NULL QUALIFY position <= 7"))
def reading_path(spark, sf_dir):
    return FI.reading_path(L.catalogue(spark, sf_dir).select("path").distinct())


@query(with_sql(["catalogue"], "SELECT CASE WHEN len(s) > 1 THEN s[-2] ELSE 'root' END AS module, count(*) AS files FROM (SELECT string_split(path, '/') AS s FROM catalogue) GROUP BY 1 ORDER BY 1 LIMIT 8"))
def modules(spark, sf_dir):
    return FI.modules(L.catalogue(spark, sf_dir))


@query(with_sql(["catalogue"], f"SELECT DISTINCT n AS name FROM (SELECT " + _cases_sql([(f"lang = '{k}'", f"'{v[0]}'") for k, v in P.LANGUAGES.items() if k != "config"], "NULL") + f" AS n FROM (SELECT {_language_sql()} AS lang FROM catalogue)) WHERE n IS NOT NULL UNION SELECT f FROM (SELECT unnest([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(content), {chr(39)}{m}{chr(39)}) OR contains(lower(path), {chr(39)}{m}{chr(39)})' for m in ms)} THEN '{k}' END" for k, ms in A.FRAMEWORKS.items()) + "]) AS f FROM catalogue) WHERE f IS NOT NULL"))
def stack(spark, sf_dir):
    """Languages and frameworks of the catalogue."""
    c = L.catalogue(spark, sf_dir)
    return FI.stack(c, A.frameworks(c))


@query(with_sql(["catalogue"], "SELECT 'No FastAPI endpoint was detected.' AS gap WHERE EXISTS (SELECT 1 FROM catalogue) UNION ALL SELECT 'Repository has no README indexed.' WHERE NOT EXISTS (SELECT 1 FROM catalogue WHERE starts_with(lower(list_last(string_split(path, '/'))), 'readme')) UNION ALL SELECT 'No test files were detected.' WHERE NOT EXISTS (SELECT 1 FROM catalogue WHERE contains(lower(path), 'test'))"))
def documentation_gaps(spark, sf_dir):
    c = L.catalogue(spark, sf_dir)
    return FI.gaps(c, c.limit(0))


@query(
    with_sql(
        ["catalogue"],
        "r AS (SELECT seq, path, count(*) OVER w AS running_files, sum(size_bytes) OVER w AS running_bytes FROM catalogue WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT seq, path, running_files, running_bytes::BIGINT AS running_bytes, CASE WHEN running_files > 700 THEN 'file_count_exceeded' WHEN running_bytes > 500000000 THEN 'size_exceeded' ELSE 'ok' END AS state FROM r",
    )
)
def import_quota(spark, sf_dir):
    return FI.quota(L.catalogue(spark, sf_dir), 700, 500_000_000)


@query(with_sql(["catalogue"], "SELECT seq, path FROM catalogue QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY seq) > 1"))
def duplicate_paths(spark, sf_dir):
    return FI.duplicates(L.catalogue(spark, sf_dir)).select("seq", "path")


@query(with_sql(["catalogue"], SCANNED + " SELECT path, 'file_summary' AS chunk_type, path || ' (' || lang || ', ' || file_type || ')' AS content FROM scanned WHERE seq % 3 <> 0 AND path NOT IN (SELECT path FROM catalogue WHERE seq % 3 = 0)"))
def summary_chunks(spark, sf_dir):
    """Summary chunks of files that have none; every third file has one."""
    s = FI.scan(L.catalogue(spark, sf_dir))
    return FI.summary_chunks(s.filter("seq % 3 <> 0"), s.filter("seq % 3 = 0").withColumn("chunk_type", lit("file_summary")))


@query(
    with_sql(
        ["catalogue"],
        f"SELECT path, 'semantic_summary' AS chunk_type, 'File ' || path || '. Symbols: ' || array_to_string(list(n ORDER BY seq, n)[1:8], ', ') || '. Layer: ' || {_LAYER} || '.' AS content FROM (SELECT path, seq, 's' || seq AS n FROM catalogue) GROUP BY path",
    )
)
def semantic_summaries(spark, sf_dir):
    c = L.catalogue(spark, sf_dir)
    symbols = c.select("path", "seq", F.concat(lit("s"), col("seq").cast("string")).alias("name"))
    none = c.limit(0).select("path", "seq", col("path").alias("route"))
    return FI.semantic_summaries(c.select("path").distinct(), symbols, none)


@query(with_sql(["files"], r"SELECT language, sha256(string_agg(path || chr(0) || size_bytes || chr(0) || content_hash || chr(10), '' ORDER BY path)) AS fingerprint, count(*) AS files FROM files GROUP BY language"))
def project_fingerprint(spark, sf_dir):
    """Fingerprint of the files of each language."""
    return D.fingerprint(L.files(spark, sf_dir), ["language"])


# --- folders ------------------------------------------------------------------------------------------------

_FOLDERS = """cut AS (SELECT DISTINCT path, string_split(path, '/')[:-2] AS s FROM catalogue), pre AS (SELECT DISTINCT s[:n] AS p FROM (SELECT s, unnest(generate_series(1, len(s))) AS n FROM cut WHERE len(s) > 0))"""


@query(
    with_sql(
        ["catalogue"],
        _FOLDERS + """ SELECT 'folder_' || left(sha1(CASE WHEN len(p) > 1 THEN array_to_string(p[:-2], '/') ELSE '.' END), 10) AS source, 'folder_' || left(sha1(array_to_string(p, '/')), 10) AS target, 0.85 AS confidence, 'contains' AS type FROM pre
  UNION ALL SELECT 'folder_' || left(sha1(CASE WHEN len(s) > 0 THEN array_to_string(s, '/') ELSE '.' END), 10), 'file_' || left(sha1(path), 10), 0.95, 'contains' FROM cut""",
    )
)
def folder_edges(spark, sf_dir):
    return G.folder_chain(L.catalogue(spark, sf_dir).select("path").distinct())[1]


@query(with_sql(["catalogue"], _FOLDERS + " SELECT array_to_string(p, '/') AS path, CASE WHEN len(p) > 1 THEN array_to_string(p[:-2], '/') ELSE '.' END AS parent, len(p)::INT AS depth, 'folder' AS kind FROM pre UNION ALL SELECT path, CASE WHEN len(s) > 0 THEN array_to_string(s, '/') ELSE '.' END, (len(s) + 1)::INT, 'file' FROM cut"))
def file_tree(spark, sf_dir):
    return G.file_tree(L.catalogue(spark, sf_dir).select("path").distinct())


# --- retrieval ------------------------------------------------------------------------------------------------


def _lines(spark, sf_dir) -> DataFrame:
    """Each chunk once. Ids are of path and line, so just documents that share a number can have one twice: only their lines are shuffled."""
    c = L.chunks(spark, sf_dir)
    again = cut(L.table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id"))
    if again.isEmpty():
        return c
    some = col("doc_id").isNull()
    shared = c.filter(some).unionByName(c.join(again, "doc_id", "left_semi").select(c.columns)).dropDuplicates(["chunk_id"])
    return c.filter(~some).join(again, "doc_id", "left_anti").select(c.columns).unionByName(shared)


def _chunk_rows(spark, sf_dir) -> DataFrame:
    """Lines as chunks of four types; the first is a file's summary, and all but text and summaries are named by their first word."""
    c = _lines(spark, sf_dir)
    kind = F.when(col("line") == 1, "file_summary").otherwise(F.element_at(F.array(*map(lit, ["text", "function", "endpoint", "method"])), (col("line") % 4 + 1).cast("int")))
    symbol = F.when(col("chunk_type").isin("function", "endpoint", "method"), F.regexp_extract("content", "([A-Za-z]{3,})", 1)).otherwise("")
    c = c.withColumn("chunk_type", kind).withColumn("symbol", symbol).withColumns({"start_line": col("line"), "end_line": col("line")})
    return c.withColumn("haystack", X.haystack([col("path"), col("symbol"), col("chunk_type"), col("content")]))


_QT = f"q AS (SELECT query_id, query, {_terms('query')} AS terms FROM questions)"
_HAY = f"""hay AS (SELECT *, {_TOKENS.format('h')} AS toks FROM (SELECT *, lower(path || ' ' || symbol || ' ' || chunk_type || ' ' || content) AS h FROM (
  SELECT *, CASE WHEN chunk_type IN ('function', 'endpoint', 'method') THEN regexp_extract(content, '([A-Za-z]{{3,}})', 1) ELSE '' END AS symbol FROM (
  SELECT DISTINCT ON (chunk_id) *, CASE WHEN line = 1 THEN 'file_summary' ELSE ['text', 'function', 'endpoint', 'method'][line % 4 + 1] END AS chunk_type FROM chunks))))"""
_IDF = f"""{_QT}, {_HAY}, stats AS (SELECT greatest(count(*), 1) AS n, coalesce(avg(len(toks)), 0) AS av FROM hay), asked AS (SELECT DISTINCT unnest(terms) AS term FROM q),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM hay) WHERE term IN (SELECT term FROM asked) GROUP BY term),
idf AS (SELECT a.term, coalesce(df, 0) AS df, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM asked a LEFT JOIN df USING (term), stats)"""


@query(with_sql(["chunks", "questions"], _IDF + " SELECT term, df::BIGINT AS df, round(idf, 9) AS idf FROM idf"))
def term_idf(spark, sf_dir):
    return R.term_idf(_chunk_rows(spark, sf_dir), L.questions(spark, sf_dir)).select("term", "df", F.round("idf", 9).alias("idf"))


_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(query), {chr(39)}{x}{chr(39)})' for x in sig)} THEN '{k}'" for k, sig in X.QUESTION_RULES) + " ELSE 'code_question' END"
_BOOST = "CASE " + " ".join(f"WHEN kind = '{k}' AND chunk_type = '{c}' THEN {v}" for k, by in X.CHUNK_BOOSTS.items() for c, v in by.items()) + " ELSE 0.0 END"
# ratios of terms and tokens: the longest common block (first in the term, then in the token), then what lies before and behind it
_BLOCK = "list_max(flatten(list_transform(range(1, length({0}) + 1), lambda i: list_filter(list_transform(range(1, length({0}) - i + 2), lambda k: {{'k': k, 'i': -i}}), lambda s: instr({1}, substr({0}, -s.i, s.k)) > 0))))"
_PAIR_GRAMS = "list_concat(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr({0}, i, 2)), CASE WHEN length({0}) = 3 THEN [left({0}, 1) || right({0}, 1)] ELSE [] END)"


def _fuzzy_sql(words: str) -> str:
    """fz (term, token, v): what alike terms and tokens add; ``words`` selects tokens."""
    return f"""wd AS (SELECT DISTINCT token FROM ({words})), ft AS (SELECT DISTINCT unnest(terms) AS term FROM q),
alike AS (SELECT DISTINCT term, token FROM (SELECT term, unnest({_PAIR_GRAMS.format('term')}) AS g FROM ft) JOIN (SELECT token, unnest({_PAIR_GRAMS.format('token')}) AS g FROM wd) USING (g) WHERE 2 * least(length(term), length(token)) >= 0.76 * (length(term) + length(token)) - 1e-9),
rp AS (SELECT term, token, term AS a, token AS b, {_BLOCK.format('term', 'token')} AS s FROM alike UNION ALL
  SELECT term, token, p.a, p.b, {_BLOCK.format('p.a', 'p.b')} FROM (SELECT term, token, unnest([{{'a': left(a, -s.i - 1), 'b': left(b, instr(b, substr(a, -s.i, s.k)) - 1)}}, {{'a': substr(a, -s.i + s.k), 'b': substr(b, instr(b, substr(a, -s.i, s.k)) + s.k)}}]) AS p FROM rp WHERE s IS NOT NULL) WHERE p.a <> '' AND p.b <> ''),
fz AS (SELECT term, token, CASE WHEN r >= 0.88 THEN 1.2 ELSE 0.55 END::DOUBLE AS v FROM (SELECT term, token, 2.0::DOUBLE * sum(s.k) / (length(term) + length(token)) AS r FROM rp WHERE s IS NOT NULL GROUP BY term, token) WHERE r >= 0.76)"""


_CHUNK_WORDS = "SELECT unnest(toks) AS token FROM hay"
# every chunk against every question, scored term by term; fz comes before
_LEX = f"""qt AS (SELECT query_id, query, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM q),
hit AS (SELECT query_id, chunk_id, pos, qt.term, idf, len(list_filter(toks, lambda x: x = qt.term)) AS tf, len(toks) AS ln FROM hay JOIN qt ON contains(h, qt.term) JOIN idf ON idf.term = qt.term),
lex AS (SELECT query_id, chunk_id, sum(CASE WHEN tf > 0 THEN idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ln / greatest(av, 1))) ELSE 0 END) + 0.65 * sum(CASE WHEN tf > 0 THEN 2.0 ELSE 0.75 END) AS s, string_agg(term, ' ' ORDER BY pos) AS matched FROM hit, stats GROUP BY query_id, chunk_id),
fuz AS (SELECT query_id, chunk_id, sum(v) AS f FROM (SELECT query_id, chunk_id, qt.term, max(v) AS v FROM (SELECT DISTINCT chunk_id, unnest(toks) AS token FROM hay) JOIN fz USING (token) JOIN qt USING (term) GROUP BY ALL) GROUP BY ALL),
boosted AS (SELECT query_id, chunk_id, round(coalesce(s, 0) + 0.8::DOUBLE * coalesce(f, 0) + {_BOOST} + CASE WHEN symbol <> '' AND contains(lower(query), lower(symbol)) THEN 3.0 ELSE 0.0 END + CASE WHEN contains(lower(query), lower(path)) THEN 3.0 ELSE 0.0 END
  + CASE WHEN chunk_type = 'endpoint' AND s IS NOT NULL THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(query), 'login') AND (contains(h, 'login') OR contains(h, 'auth')) THEN 3.0 ELSE 0.0 END, 6) AS score, coalesce(matched, '') AS matched
  FROM (SELECT *, {_KIND} AS kind FROM q WHERE len(terms) > 0) CROSS JOIN hay LEFT JOIN lex USING (query_id, chunk_id) LEFT JOIN fuz USING (query_id, chunk_id)),
lexical AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM boosted WHERE score > 0)"""
_NO_FUZZY = "fz AS (SELECT '' AS term, '' AS token, 0.0::DOUBLE AS v WHERE false)"
_PAIRS = f"{_IDF}, {_NO_FUZZY}, {_LEX}"


@query(with_sql(["chunks", "questions"], _PAIRS + " SELECT query_id, chunk_id, score, rank, matched FROM lexical WHERE rank <= 10"))
def bm25_topk(spark, sf_dir):
    """The ten best chunks of each benchmark question by the lexical retriever."""
    return R.lexical(_chunk_rows(spark, sf_dir), L.questions(spark, sf_dir), k=10).select("query_id", "chunk_id", "score", "rank", "matched")


@query(with_sql(["chunks", "questions"], f"{_IDF}, {_fuzzy_sql(_CHUNK_WORDS)}, {_LEX} SELECT query_id, chunk_id, score, rank, matched FROM lexical WHERE rank <= 10"))
def lexical_fuzzy(spark, sf_dir):
    """The lexical retriever with its fuzzy term."""
    return R.lexical(_chunk_rows(spark, sf_dir), L.questions(spark, sf_dir), fuzzy=True, k=10).select("query_id", "chunk_id", "score", "rank", "matched")


_SPARSE_TOK = r"flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9_/.-]+'), lambda t: list_concat([t], list_filter(regexp_split_to_array(t, '[/_.-]+'), lambda p: length(p) > 1))))"


def _sparse_sql(name: str, key: str, text: str, source: str) -> str:
    return f"""{name}_t AS (SELECT {key}, unnest({_SPARSE_TOK.format(text)}) AS t FROM {source}),
{name} AS (SELECT {key}, term, sum(w)::DOUBLE AS weight FROM (SELECT {key}, t AS term, 1.0::DOUBLE AS w FROM {name}_t UNION ALL SELECT {key}, substr(t, i, 4), 0.35::DOUBLE FROM (SELECT {key}, t, unnest(generate_series(1, length(t) - 3)) AS i FROM {name}_t WHERE length(t) >= 5)) GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(weight * weight)) AS norm FROM {name} GROUP BY 1)"""


_SPARSE = f"""sc AS (SELECT DISTINCT ON (chunk_id) chunk_id, seq, path || '  text ' || content AS body FROM chunks),
{_sparse_sql('cv', 'chunk_id', 'body', 'sc')}, {_sparse_sql('qv', 'query_id', 'query', 'questions')},
sparse AS (SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, chunk_id))::INT AS rank FROM (
  SELECT query_id, chunk_id, round(sum(c.weight * v.weight) / (any_value(cv_n.norm) * any_value(qv_n.norm)), 9) AS score FROM cv c JOIN qv v USING (term) JOIN cv_n USING (chunk_id) JOIN qv_n USING (query_id) GROUP BY 1, 2) JOIN sc USING (chunk_id) WHERE score > 0)"""


def _with_body(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("body", F.concat("path", lit("  text "), "content"))


def _bodies(spark, sf_dir) -> DataFrame:
    return _with_body(_chunk_rows(spark, sf_dir))


@query(with_sql(["chunks", "questions"], _SPARSE + " SELECT * FROM sparse WHERE rank <= 10"))
def sparse_topk(spark, sf_dir):
    return R.sparse(_bodies(spark, sf_dir), L.questions(spark, sf_dir), 10)


@query(with_sql(["chunks", "questions"], _SPARSE + " SELECT query_id, chunk_id, array_to_string(list(term ORDER BY -round(v.weight, 6), term)[1:8], ' ') AS terms FROM cv JOIN qv v USING (term) GROUP BY 1, 2"))
def sparse_terms(spark, sf_dir):
    return R.sparse_terms(_bodies(spark, sf_dir), L.questions(spark, sf_dir))


_COS = "round(list_dot_product(c.e, q.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(q.e, q.e))), 6)"
_DENSE = f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), dense AS (SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, {_COS} AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id) WHERE score > 0)"""


@query("WITH " + _DENSE + " SELECT * FROM dense WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    v = L.table(spark, sf_dir, "embeddings")
    return R.dense(v, v.filter("vec_id % 50 = 0"), 10)


def _entities(spark, sf_dir, c: DataFrame | None = None) -> dict[str, DataFrame]:
    """What the entity retrievers look through: functions and methods, endpoints, files, and graph nodes of files and functions."""
    c = _chunk_rows(spark, sf_dir) if c is None else c
    named = c.filter("symbol <> ''")
    symbols = named.filter("chunk_type <> 'endpoint'").select(col("chunk_id").alias("symbol_id"), "path", col("symbol").alias("name"), col("chunk_type").alias("symbol_type"), F.concat("symbol", lit("("), col("line").cast("string"), lit(")")).alias("signature"), "start_line", "end_line")
    endpoints = named.filter("chunk_type = 'endpoint'").select(col("chunk_id").alias("endpoint_id"), "path", lit("GET").alias("method"), F.concat(lit("/"), "symbol").alias("route"), col("symbol").alias("handler"), lit("owner corpus").alias("metadata"))
    files = L.files(spark, sf_dir).select("path", "language", lit("document").alias("file_type")).distinct()
    blank = [lit("").alias(x) for x in ("role", "summary", "layer", "tags")]
    nodes = files.select(col("path").alias("id"), F.regexp_extract("path", "([^/]*)$", 1).alias("label"), lit("file").alias("type"), col("path").alias("file_path"), *blank, lit(None).cast("int").alias("start_line"), lit(None).cast("int").alias("end_line"))
    nodes = nodes.union(named.filter("chunk_type = 'function'").select("chunk_id", "symbol", "chunk_type", "path", *blank, "start_line", "end_line"))
    return {"symbol": R.symbol_entities(symbols, c), "endpoint": R.endpoint_entities(endpoints, c), "metadata": R.file_entities(files, c), "graph": R.node_entities(nodes, c)}


_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_SUMMARY = "SELECT path, arg_min(chunk_id, (CASE WHEN chunk_type = 'file_summary' THEN 0 ELSE 1 END) * 1000000000000000 + seq) AS chunk_id FROM hay GROUP BY path"
_ENTITY_SQL = {
    "symbol": "SELECT s.chunk_id AS entity_id, arg_min(c.chunk_id, c.seq) AS chunk_id, s.symbol AS title, s.path, lower(s.symbol || ' ' || s.chunk_type || ' ' || s.symbol || '(' || s.line || ') ' || s.path) AS eh FROM hay s JOIN hay c ON s.path = c.path AND (c.symbol = s.symbol OR c.line = s.line) WHERE s.symbol <> '' AND s.chunk_type <> 'endpoint' GROUP BY ALL",
    "endpoint": "SELECT s.chunk_id AS entity_id, arg_min(c.chunk_id, c.seq) AS chunk_id, 'GET /' || s.symbol AS title, s.path, lower('GET /' || s.symbol || ' ' || s.symbol || ' ' || s.path || ' owner corpus') AS eh FROM hay s JOIN hay c ON s.path = c.path AND c.chunk_type = 'endpoint' AND (c.symbol = s.symbol OR contains(c.content, '/' || s.symbol)) WHERE s.symbol <> '' AND s.chunk_type = 'endpoint' GROUP BY ALL",
    "metadata": f"SELECT DISTINCT path AS entity_id, chunk_id, path AS title, path, lower(path || ' ' || {_NAME} || ' ' || language || ' document') AS eh FROM files JOIN ({_SUMMARY}) USING (path)",
    "graph": f"SELECT DISTINCT path AS entity_id, chunk_id, {_NAME} AS title, path, lower({_NAME} || ' file ' || path || '    ') AS eh FROM files JOIN ({_SUMMARY}) USING (path) UNION ALL SELECT chunk_id, chunk_id, symbol, path, lower(symbol || ' function ' || path || '    ') FROM hay WHERE symbol <> '' AND chunk_type = 'function'",
}


def _entity_rows(kind: str) -> str:
    return f"{kind}_e AS ({_ENTITY_SQL[kind]}), {kind}_t AS (SELECT *, {_TOKENS.format('eh')} AS et FROM {kind}_e)"


def _entity_sql(kind: str) -> str:
    """Seeds of one kind, after its rows and fz."""
    return f"""{kind}_f AS (SELECT query_id, entity_id, sum(v) AS f FROM (SELECT query_id, entity_id, q1.term, max(v) AS v FROM (SELECT DISTINCT entity_id, unnest(et) AS token FROM {kind}_t) JOIN fz USING (token) JOIN (SELECT query_id, unnest(terms) AS term FROM q) q1 USING (term) GROUP BY ALL) GROUP BY ALL),
{kind}_s AS (SELECT query_id, query, chunk_id, title, path, round(s + {R.OFFSETS[kind]}, 6)::DOUBLE AS score FROM (SELECT query_id, query, chunk_id, title, path, coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN list_contains(et, t) THEN 2.0 WHEN contains(eh, t) THEN 0.75 ELSE 0.0 END)), 0)
  + CASE WHEN trim(query) <> '' AND contains(eh, lower(trim(query))) THEN 2.0 ELSE 0.0 END + coalesce(f, 0) AS s FROM q CROSS JOIN {kind}_t LEFT JOIN {kind}_f USING (query_id, entity_id)) WHERE s > 0)"""


_FIRST = "(SELECT query_id, chunk_id, title, score FROM {0} QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, title) = 1)"


def _entity_rank(kind: str, source: str) -> str:
    return f"{kind} AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM {_FIRST.format(source)})"


_ROWS = ", ".join(_entity_rows(k) for k in _ENTITY_SQL)
_ENTITY_WORDS = " UNION ALL ".join(f"SELECT unnest(et) AS token FROM {k}_t" for k in _ENTITY_SQL)
_EXACT = "exact_s AS (" + " UNION ALL ".join(
    f"SELECT * FROM {k}_s WHERE (title <> '' AND contains(lower(query), lower(title))) OR contains(lower(query), lower(path))" for k in _ENTITY_SQL if k != "graph"
) + "), " + _entity_rank("exact", "exact_s")
_SEEDS = ", ".join(f"{_entity_sql(k)}, {_entity_rank(k, k + '_s')}" for k in _ENTITY_SQL) + ", " + _EXACT
_ENTITY_TABLES = ["chunks", "questions", "files"]


def _entity_query(kind: str):
    def run(spark, sf_dir):
        found = R.entity_seeds(_entities(spark, sf_dir)[kind], L.questions(spark, sf_dir), kind, 10).filter("list = 'all'")
        return R.entity_rank(found, 10).select("query_id", "chunk_id", "title", "score", "rank")

    run.__name__, run.__doc__ = f"{kind}_topk", f"The ten best chunks of each question by the {kind} retriever."
    words = f"SELECT unnest(et) AS token FROM {kind}_t"
    return query(with_sql(_ENTITY_TABLES, f"{_QT}, {_HAY}, {_entity_rows(kind)}, {_fuzzy_sql(words)}, {_entity_sql(kind)}, {_entity_rank(kind, kind + '_s')} SELECT query_id, chunk_id, title, score, rank FROM {kind} WHERE rank <= 10"))(run)


for _k in _ENTITY_SQL:
    _entity_query(_k)

#: Retrievers that the exact one goes through.
NAMED = ("symbol", "endpoint", "metadata")


def _slim(chunks: DataFrame) -> DataFrame:
    """What entities need of chunks: all but the text, which stays where an endpoint's route, that has a slash, can be in it."""
    held = F.when((col("chunk_type") == "endpoint") & col("content").contains("/"), col("content"))
    return chunks.select("chunk_id", "seq", "doc_id", "path", "line", "start_line", "end_line", "chunk_type", "symbol", held.alias("content"))


def _seeds(spark, sf_dir, chunks: DataFrame, k: int, q: DataFrame, kinds=tuple(R.OFFSETS)) -> dict[str, DataFrame]:
    """What the ``k`` best chunks of each entity retriever come from."""
    entities, rows = _entities(spark, sf_dir, chunks), None
    for kind in kinds:
        one = R.entity_seeds(entities[kind], q, kind, k).withColumn("kind", lit(kind))
        rows = one if rows is None else rows.unionByName(one)
    rows = cut(rows)
    return {kind: rows.filter(col("kind") == kind).drop("kind") for kind in kinds}


def _exact(found: dict[str, DataFrame], k: int) -> DataFrame:
    rows = found[NAMED[0]]
    for kind in NAMED[1:]:
        rows = rows.union(found[kind])
    return R.entity_rank(rows.filter("list = 'named'"), k)


@query(with_sql(_ENTITY_TABLES, f"{_QT}, {_HAY}, {_ROWS}, {_fuzzy_sql(_ENTITY_WORDS)}, {_SEEDS} SELECT query_id, chunk_id, title, score, rank FROM exact WHERE rank <= 10"))
def exact_topk(spark, sf_dir):
    """Chunks of entities that a question names."""
    found = _seeds(spark, sf_dir, cut(_slim(_chunk_rows(spark, sf_dir))), 10, L.questions(spark, sf_dir), NAMED)
    return _exact(found, 10).select("query_id", "chunk_id", "title", "score", "rank")


REASONS = {"lexical": "lexical_chunk_match", "semantic": "semantic_sparse_vector_match", "symbol": "symbol_match", "endpoint": "endpoint_match", "metadata": "file_metadata_match", "graph": "graph_node_match", "exact": "exact_named_target"}
CONTEXT = "graph_context_neighbor"


def _file_graph(spark, sf_dir, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, file_path) of files and of functions, and edges: imports of files, and a file's functions."""
    functions = chunks.filter("chunk_type = 'function' and symbol <> ''")
    nodes = chunks.select(col("path").alias("id"), col("path").alias("file_path")).distinct().union(functions.select("chunk_id", "path"))
    return nodes, L.file_links(spark, sf_dir).union(functions.select("path", "chunk_id"))


def _retrieved(spark, sf_dir, q: DataFrame | None = None) -> DataFrame:
    """For the benchmark's questions, or ``q``: the best 50 candidates of all seven retrievers, then chunks of files next to theirs in the graph; the entity is the line, the source the document."""
    q, texts = L.questions(spark, sf_dir) if q is None else q, _chunk_rows(spark, sf_dir)
    chunks = cut(_slim(texts))
    found = _seeds(spark, sf_dir, chunks, 50, q)
    ranked = {k: R.entity_rank(f.filter("list = 'all'"), 50) for k, f in found.items()} | {"exact": _exact(found, 50)}
    ranked |= {"lexical": R.lexical(texts, q, True, 50), "semantic": R.sparse(_with_body(texts), q, 50)}
    rows = None
    for kind, r in ranked.items():
        r = r.select("query_id", "chunk_id", "rank", lit(kind).alias("retriever"), F.array(lit(REASONS[kind])).alias("reasons"), lit({"graph": "static_resolved", "semantic": "heuristic"}.get(kind, "source_exact")).alias("support"))
        rows = r if rows is None else rows.unionByName(r)
    rows = cut(rows.join(chunks.select("chunk_id", "doc_id", "line", "path"), "chunk_id"))
    nodes, edges = _file_graph(spark, sf_dir, chunks)
    taken = rows.filter("retriever = 'graph'").groupBy("query_id").agg(F.count("*").alias("n"))
    near = R.graph_context(rows.select("query_id", "path", "chunk_id"), edges, nodes, chunks, taken, 50)
    near = near.select("query_id", "chunk_id", "rank", lit("graph").alias("retriever"), F.array(lit(CONTEXT)).alias("reasons"), lit("static_resolved").alias("support"))
    rows = rows.unionByName(near.join(chunks.select("chunk_id", "doc_id", "line", "path"), "chunk_id"))
    return cut(rows.select(
        "query_id", F.concat_ws("|", "retriever", "chunk_id").alias("candidate_id"), "retriever", F.concat(lit("line:"), "chunk_id").alias("entity_key"), F.concat(lit("file:v1:"), "path").alias("source_key"),
        col("line").alias("start_line"), col("line").alias("end_line"), "rank", "support", "reasons", "doc_id", "chunk_id",
    ))


_CAND_TABLES = ["chunks", "questions", "files", "file_links"]
_FOUND = f"""{_IDF}, {_ROWS}, {_fuzzy_sql(_CHUNK_WORDS + ' UNION ALL ' + _ENTITY_WORDS)}, {_LEX}, {_SPARSE}, {_SEEDS}, first_round AS ({" UNION ALL ".join(f"SELECT query_id, chunk_id, rank, '{k}' AS retriever, { {'graph': 1, 'semantic': 2}.get(k, 0)} AS s FROM {'sparse' if k == 'semantic' else k} WHERE rank <= 50" for k in REASONS)}),
gn AS (SELECT DISTINCT path AS id, path AS file_path FROM hay UNION ALL SELECT chunk_id, path FROM hay WHERE chunk_type = 'function' AND symbol <> ''),
ge AS (SELECT source, target FROM file_links UNION ALL SELECT path, chunk_id FROM hay WHERE chunk_type = 'function' AND symbol <> ''),
file_steps AS (SELECT DISTINCT x.file_path AS path, y.file_path AS nxt FROM (SELECT source, target FROM ge UNION ALL SELECT target, source FROM ge) b JOIN gn x ON b.source = x.id JOIN gn y ON b.target = y.id),
file_nexts AS (SELECT DISTINCT query_id, nxt AS path FROM (SELECT DISTINCT query_id, path FROM first_round JOIN hay USING (chunk_id)) JOIN file_steps USING (path)),
around AS (SELECT query_id, chunk_id, ((row_number() OVER (PARTITION BY query_id ORDER BY chunk_id)) + coalesce((SELECT count(*) FROM first_round g WHERE g.query_id = x.query_id AND retriever = 'graph'), 0))::INT AS rank
  FROM (SELECT query_id, chunk_id FROM file_nexts JOIN hay USING (path) WHERE chunk_type IN {listed(R.CONTEXT_TYPES)}) x ANTI JOIN first_round USING (query_id, chunk_id)),
cand AS (SELECT *, false AS near FROM first_round UNION ALL SELECT query_id, chunk_id, rank, 'graph', 1, true FROM around WHERE rank <= 50)"""


@query(with_sql(_CAND_TABLES, _FOUND + " SELECT query_id, retriever, chunk_id, rank, near FROM cand"))
def retrieve_candidates(spark, sf_dir):
    """What all seven retrievers hand to fusion, and what the graph adds to it."""
    return _retrieved(spark, sf_dir).select("query_id", "retriever", "chunk_id", "rank", F.array_contains("reasons", CONTEXT).alias("near"))


_CANDS = f"""{_FOUND},
fused AS (SELECT query_id, chunk_id, round(sum((CASE retriever WHEN 'semantic' THEN 2.0 ELSE 1.0 END) / (60 + rank)) * CASE WHEN bool_or(retriever = 'semantic') THEN 1.1 ELSE 1.0 END, 12) AS fused, min(rank)::INT AS best_rank, min(s) AS s, string_agg(retriever, ',' ORDER BY retriever) AS retrievers, bool_or(near) AS near FROM cand GROUP BY 1, 2),
placed AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, s, best_rank, 'line:' || chunk_id))::INT AS position FROM fused)"""
POLICY = FU.Policy(weights=dict.fromkeys(FU.RETRIEVERS, 1.0) | {"semantic": 2.0}, boosts={"semantic_sparse_vector_match": 1.1})


@query(
    with_sql(_CAND_TABLES, _CANDS + " SELECT query_id, chunk_id, fused, least(1.0, round(fused / (8.0 / 61), 12)) AS normalised, best_rank, ['source_exact', 'static_resolved', 'heuristic'][s + 1] AS support, retrievers, near, position FROM placed WHERE position <= 20",
    )
)
def hybrid_search(spark, sf_dir):
    """Candidates of all seven retrievers and of the graph around them, fused by weighted reciprocal ranks."""
    f = FU.fuse(_retrieved(spark, sf_dir), POLICY)
    return f.select("query_id", F.substring("entity_key", 6, 100).alias("chunk_id"), "fused", "normalised", "best_rank", "support", F.array_join("retrievers", ",").alias("retrievers"), F.array_contains("reason_codes", CONTEXT).alias("near"), "position")


@query(
    with_sql(_CAND_TABLES, _CANDS + """, half AS (SELECT *, position % 2 AS side FROM placed WHERE position <= 20), merged AS (SELECT query_id % 20 AS query_id, chunk_id, max(fused) AS fused, count(*) AS n FROM half GROUP BY 1, 2)
  SELECT query_id, chunk_id, fused, (row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, 'line:' || chunk_id))::INT AS position FROM merged""",
    )
)
def merged_search(spark, sf_dir):
    """Fused lists of pairs of questions merged into one; support and ranks are made equal so that ties fall to the entity."""
    f = FU.fuse(_retrieved(spark, sf_dir), POLICY).withColumns({"config": lit("c"), "query_id": col("query_id") % 20, "support": lit("heuristic"), "best_rank": lit(1)})
    a, b = f.filter("position % 2 = 0").drop("position"), f.filter("position % 2 = 1").drop("position")
    return FU.merge(a, b).select("query_id", F.substring("entity_key", 6, 100).alias("chunk_id"), "fused", "position")


@query("WITH " + _DENSE + """, lab AS (SELECT query_id, vec_id, rank FROM dense WHERE rank <= 50), other AS (SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY vec_id))::INT AS rank FROM lab),
  s AS (SELECT query_id, vec_id AS key, round(sum(w / (60 + rank)), 12) AS fused FROM (SELECT *, 1.0 AS w FROM lab UNION ALL SELECT *, 2.0 FROM other) GROUP BY 1, 2) SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, key))::INT AS position FROM s""")
def weighted_rrf(spark, sf_dir):
    """Dense ranks and an order by id fused with weights 1 and 2."""
    v = L.table(spark, sf_dir, "embeddings")
    lab = R.dense(v, v.filter("vec_id % 50 = 0"), 50).select("query_id", lit("dense").alias("retriever"), col("vec_id").alias("key"), "rank")
    other = lab.select("query_id", lit("order").alias("retriever"), "key", F.row_number().over(Window.partitionBy("query_id").orderBy("key")).alias("rank"))
    return FU.weighted_rrf(lab.union(other), {"dense": 1.0, "order": 2.0})


@query(
    with_sql(
        ["chunks", "questions", "nodes", "edges"],
        """m AS (SELECT query_id, 'src/nation/' || (query_id % 25) || '.py' AS path, 'x' || query_id AS chunk_id FROM questions), c AS (SELECT id AS chunk_id, file_path AS path, type AS chunk_type FROM nodes WHERE type IN ('function', 'method', 'endpoint') AND file_path IS NOT NULL),
  b AS (SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges), st AS (SELECT DISTINCT x.file_path AS path, y.file_path AS nxt FROM b JOIN nodes x ON b.source = x.id JOIN nodes y ON b.target = y.id ),
  near AS (SELECT DISTINCT m.query_id, nxt AS path FROM m JOIN st USING (path)) SELECT query_id, count(*) AS n, min(chunk_id) AS first_chunk FROM near JOIN c USING (path) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = near.query_id AND m.chunk_id = c.chunk_id) GROUP BY 1""",
    )
)
def graph_context(spark, sf_dir):
    """How many chunks the neighbour files of a matched file bring, and the first in rank."""
    m = L.questions(spark, sf_dir).select("query_id", F.concat(lit("src/nation/"), (col("query_id") % 25).cast("string"), lit(".py")).alias("path"), F.concat(lit("x"), col("query_id").cast("string")).alias("chunk_id"))
    n = L.nodes(spark, sf_dir)
    c = n.filter("type in ('function', 'method', 'endpoint') and file_path is not null").select(col("id").alias("chunk_id"), col("file_path").alias("path"), col("type").alias("chunk_type"))
    found = R.graph_context(m, L.edges(spark, sf_dir), n, c)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by("chunk_id", "rank").alias("first_chunk"))


# --- evaluation ------------------------------------------------------------------------------------------------


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = FU.fuse(_retrieved(spark, sf_dir), POLICY)
    rel = cut(L.relevance(spark, sf_dir))
    doc = F.regexp_extract("source_key", r"doc_(\d+)\.txt$", 1).cast("long")
    items = f.select(col("query_id").alias("case_id"), lit("hybrid").alias("method"), col("position").alias("rank"), doc.alias("doc_id"), "source_key", "start_line", "end_line")
    items = items.join(rel.select(col("query_id").alias("case_id"), "doc_id", lit(True).alias("_r")), ["case_id", "doc_id"], "left").select("case_id", "method", "rank", F.concat(lit("doc:"), "doc_id").alias("entity_key"), "source_key", "start_line", "end_line", F.coalesce("_r", lit(False)).alias("relevant"))
    n = rel.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    cases = L.questions(spark, sf_dir).join(n, "query_id", "left").select(col("query_id").alias("case_id"), lit("hybrid").alias("method"), F.coalesce("n_relevant", lit(0)).alias("n_relevant"), (F.coalesce("n_relevant", lit(0)) > 0).alias("should_answer"))
    return items, cases


_JUDGED = _CANDS + """, items AS (SELECT p.query_id AS case_id, position AS rank, doc_id, path, line, r.doc_id IS NOT NULL AS relevant FROM (SELECT placed.*, hay.doc_id, hay.path, hay.line FROM placed JOIN hay USING (chunk_id)) p LEFT JOIN relevance r USING (query_id, doc_id) WHERE position <= 5),
cases AS (SELECT query_id AS case_id, count(r.doc_id) AS nr FROM questions LEFT JOIN relevance r USING (query_id) GROUP BY 1),
hits AS (SELECT case_id, count(*) AS ents, min(rank) AS er, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT case_id, doc_id, min(rank) AS rank FROM items WHERE relevant GROUP BY 1, 2) GROUP BY 1),
tops AS (SELECT case_id, count(*) AS n, count(*) FILTER (relevant) AS nh, count(DISTINCT path) AS srcs, count(DISTINCT (path, line)) AS spans FROM items GROUP BY 1),
scores AS (SELECT case_id, 'hybrid' AS method, 5 AS k, CASE WHEN nr > 0 THEN round(coalesce(ents, 0) / nr, 12) END AS recall, CASE WHEN nr > 0 THEN round(coalesce(nh, 0) / 5, 12) END AS "precision", CASE WHEN nr > 0 THEN coalesce(round(1 / er, 12), 0) END AS reciprocal_rank,
  CASE WHEN nr > 0 THEN round(coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(nr, 5)), lambda i: 1 / log2(i + 1))), 12) END AS ndcg, CASE WHEN nr > 0 THEN er END AS exact_rank, coalesce(round(srcs / n, 12), 0) AS source_diversity, coalesce(round(1 - spans / n, 12), 0) AS duplicate_rate,
  CASE WHEN nr = 0 THEN (coalesce(n, 0) = 0)::INT::DOUBLE END AS insufficient FROM cases LEFT JOIN hits USING (case_id) LEFT JOIN tops USING (case_id))"""


@query(with_sql([*_CAND_TABLES, "relevance"], _JUDGED + " SELECT * FROM scores"))
def retrieval_metrics(spark, sf_dir):
    return EV.score(*_judged(spark, sf_dir), 5)


_AGG = "agg AS (SELECT method, k, " + ", ".join(f'round(avg("{m}"), 12) AS "{m}"' for m in EV.METRICS) + ", count(*) AS cases FROM scores GROUP BY 1, 2)"


@query(with_sql([*_CAND_TABLES, "relevance"], _JUDGED + ", " + _AGG + " SELECT * FROM agg"))
def metric_means(spark, sf_dir):
    return EV.aggregate(EV.score(*_judged(spark, sf_dir), 5))


RULES = [("r1", "hybrid", 5, "recall", "gte", 0.1), ("r2", "hybrid", 5, "ndcg", "lte", 0.01), ("r3", "hybrid", 5, "duplicate_rate", "eq", 0.0), ("r4", "other", 5, "recall", "gte", 0.5)]


@query(
    with_sql([*_CAND_TABLES, "relevance"],
        _JUDGED + ", " + _AGG + ", longed AS (" + " UNION ALL ".join(f"SELECT method, k, '{m}' AS metric, \"{m}\" AS value FROM agg" for m in EV.METRICS) + "), rules(rule_id, method, k, metric, comparison, bound) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{d}', '{e}', {f}::DOUBLE)" for a, b, c, d, e, f in RULES)
        + "), told AS (SELECT r.*, value, CASE WHEN value IS NULL THEN 'missing' WHEN (comparison = 'gte' AND value >= bound) OR (comparison = 'lte' AND value <= bound) OR (comparison = 'eq' AND value = bound) THEN 'ok' ELSE 'violated' END AS outcome FROM rules r LEFT JOIN longed USING (method, k, metric)) SELECT *, (SELECT bool_and(outcome = 'ok') FROM told) AS passed FROM told",
    )
)
def regression_gate(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule_id string, method string, k int, metric string, comparison string, bound double")
    return EV.gate(EV.aggregate(EV.score(*_judged(spark, sf_dir), 5)), rules)


@query("SELECT event_type, list_sort(list(value))[greatest(ceil(0.95 * count(value)), 1)::INT] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def percentile_95(spark, sf_dir):
    return L.table(spark, sf_dir, "events").filter("value is not null").groupBy("event_type").agg(EV.percentile(col("value")).alias("p95"))


# --- graph ------------------------------------------------------------------------------------------------

_EDGE_COLS = "source, target, type, confidence, evidence_level"


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return L.nodes(spark, sf_dir), L.edges(spark, sf_dir)


def _shown(edges: DataFrame) -> DataFrame:
    return edges.select("seq", "source", "target", "type", "confidence", "evidence_level")


_ENDS = "source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)"


@query(with_sql(["nodes", "edges"], f"n AS (SELECT * FROM nodes WHERE type IN ('function', 'method', 'endpoint', 'call_site')) SELECT seq, {_EDGE_COLS} FROM edges WHERE confidence >= 0.6 AND evidence_level IN ('map', 'deep') AND type IN ('calls', 'contains_call', 'calls_api') AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)"))
def projection_filter(spark, sf_dir):
    r = G.Request(node_types=("function", "method", "endpoint", "call_site"), edge_types=("calls", "contains_call", "calls_api"), levels=("map", "deep"), confidence=0.6)
    return _shown(G.filtered(*_graph(spark, sf_dir), r)[1])


def _view(sql_nodes: str, sql_edges: str):
    return with_sql(["nodes", "edges"], f"e AS ({sql_edges}), n AS ({sql_nodes}) SELECT id AS source, '' AS target, type FROM n UNION ALL SELECT source, target, type FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)")


def _both(view: tuple[DataFrame, DataFrame]) -> DataFrame:
    n, e = view
    return n.select(col("id").alias("source"), lit("").alias("target"), "type").union(e.select("source", "target", "type"))


@query(_view("SELECT * FROM nodes WHERE type IN " + listed(G.MAP_NODES), "SELECT * FROM edges WHERE type IN ('contains', 'defines', 'exposes_endpoint')"))
def view_project_map(spark, sf_dir):
    return _both(G.view_map(*_graph(spark, sf_dir)))


@query(_view("SELECT * FROM nodes WHERE id IN (SELECT source FROM e UNION SELECT target FROM e)", "SELECT * FROM edges WHERE type = 'imports_internal'"))
def view_dependencies(spark, sf_dir):
    return _both(G.view_dependencies(*_graph(spark, sf_dir)))


@query(_view("SELECT * FROM nodes WHERE type IN ('endpoint', 'api_call', 'call_site') OR id IN (SELECT source FROM e UNION SELECT target FROM e)", "SELECT * FROM edges WHERE type IN ('calls_api', 'exposes_endpoint', 'contains_call', 'calls') AND (source = 'p7' OR target = 'p7')"))
def view_api_flow(spark, sf_dir):
    return _both(G.view_api_flow(*_graph(spark, sf_dir), "p7"))


_CALLS = listed(G.CALL_EDGES)


def _reach_sql(source: str, root: str, depth: int) -> str:
    steps = [f"l0 AS (SELECT '{root}' AS id)"]
    for k in range(1, depth + 1):
        steps.append(f"l{k} AS (SELECT id FROM l{k - 1} UNION SELECT target FROM {source} JOIN l{k - 1} ON source = id UNION SELECT source FROM {source} JOIN l{k - 1} ON target = id)")
    return ", ".join(steps)


@query(
    with_sql(
        ["nodes", "edges"],
        f"ce AS (SELECT * FROM edges WHERE type IN {_CALLS}), {_reach_sql('ce', 'c8', 2)}, e AS (SELECT DISTINCT * FROM ce WHERE source IN (SELECT id FROM l2) OR target IN (SELECT id FROM l2)), n AS (SELECT * FROM nodes WHERE type IN ('function', 'method') OR id IN (SELECT source FROM e UNION SELECT target FROM e)) SELECT id AS source, '' AS target, type FROM n UNION ALL SELECT source, target, type FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)",
    )
)
def view_function_flow(spark, sf_dir):
    return _both(G.view_function_flow(*_graph(spark, sf_dir), "c8"))


@query(
    with_sql(
        ["nodes", "edges"],
        f"de AS (SELECT * FROM edges WHERE starts_with(type, 'dfg_')), {_reach_sql('de', 'v201', 3)}, e AS (SELECT DISTINCT * FROM de WHERE source IN (SELECT id FROM l3) OR target IN (SELECT id FROM l3)), n AS (SELECT * FROM nodes WHERE type = 'dfg_node' AND id IN (SELECT id FROM l3)) SELECT id AS source, '' AS target, type FROM n UNION ALL SELECT source, target, type FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)",
    )
)
def view_data_flow(spark, sf_dir):
    return _both(G.view_data_flow(*_graph(spark, sf_dir), "v201"))


@query(with_sql(["nodes", "edges"], f"SELECT source, target, type, 'Dropped graph edge with missing endpoint: ' || source || ' -[' || type || ']-> ' || target AS message FROM edges WHERE NOT ({_ENDS})"))
def dangling_edges(spark, sf_dir):
    return G.dangling(*_graph(spark, sf_dir))


@query(with_sql(["edges"], "SELECT source, target, type, arg_max(seq, (confidence, -seq)) AS seq, max(confidence) AS confidence, min(seq) AS first_seq FROM edges GROUP BY 1, 2, 3"))
def distinct_edges(spark, sf_dir):
    return G.distinct_edges(L.edges(spark, sf_dir)).select("source", "target", "type", "seq", "confidence", "first_seq")


@query(
    with_sql(
        ["nodes", "edges"],
        "d AS (SELECT id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT source AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges) GROUP BY 1) SELECT id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) + coalesce(n_out, 0) AS degree FROM nodes LEFT JOIN d USING (id)",
    )
)
def node_degrees(spark, sf_dir):
    return G.degrees(*_graph(spark, sf_dir))


@query(with_sql(["nodes", "edges"], "d AS (SELECT id, coalesce(c, 0) AS degree FROM nodes LEFT JOIN (SELECT id, count(*) AS c FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1) USING (id)) SELECT (list_sort(list(degree))[ceil(0.75 * count(*))::INT])::BIGINT AS threshold, greatest(2, threshold) AS least FROM d"))
def degree_threshold(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return G.degree_threshold(G.degrees(n, e))


@query(
    with_sql(
        ["nodes"],
        "t AS (SELECT *, CASE WHEN type IN " + listed(G.NODE_TYPES) + " THEN type ELSE 'unknown' END AS k FROM nodes) SELECT id, k AS type, label, CASE k WHEN 'folder' THEN 'low' WHEN 'file' THEN 'low' WHEN 'module' THEN 'low' WHEN 'dfg_node' THEN 'medium' ELSE 'unknown' END AS complexity, "
        "CASE WHEN list_contains(string_split(lower(coalesce(file_path, '')), '/'), 'client') THEN 'frontend' WHEN k = 'endpoint' THEN 'api' WHEN k = 'module' THEN 'external' ELSE 'application' END AS layer, "
        "coalesce(role, CASE k WHEN 'folder' THEN 'Project area' WHEN 'file' THEN 'Source file' WHEN 'module' THEN 'Import target' WHEN 'endpoint' THEN 'API endpoint' WHEN 'api_call' THEN 'Frontend or client API call' WHEN 'dfg_node' THEN 'Data flow node' WHEN 'call_site' THEN 'Call Site' WHEN 'function' THEN 'Function' ELSE 'Method' END) AS role FROM t",
    )
)
def normal_nodes(spark, sf_dir):
    return G.normal_nodes(L.nodes(spark, sf_dir)).select("id", "type", "label", "complexity", "layer", "role")


@query(with_sql(["edges"], "SELECT source, target, CASE WHEN seq % 5 = 0 THEN 'related_to' ELSE type END AS type, CASE WHEN seq % 5 = 0 THEN 'odd' END AS original_type, least(1.0, confidence * 2 - 0.9 + 0.25) AS c2, round(least(1.0, confidence * 2 - 0.65), 4) AS weight, evidence_level FROM edges"))
def normal_edges(spark, sf_dir):
    e = L.edges(spark, sf_dir).withColumns({"type": F.when(col("seq") % 5 == 0, "odd").otherwise(col("type")), "confidence": col("confidence") * 2 - 0.65})
    n = G.normal_edges(e)
    return n.select("source", "target", "type", "original_type", (F.least(lit(1.0), col("confidence"))).alias("c2"), "weight", "evidence_level")


def _bfs_sql(depth: int, direction: str = "both", roots: str = "('r1'), ('s5')") -> str:
    both = "SELECT source AS a, target AS b FROM ge UNION SELECT target, source FROM ge" if direction == "both" else "SELECT source AS a, target AS b FROM ge" if direction == "outgoing" else "SELECT target AS a, source AS b FROM ge"
    out = [f"ge AS (SELECT * FROM edges WHERE {_ENDS})", f"st AS ({both})", f"b0 AS (SELECT DISTINCT id, 0 AS depth FROM nodes WHERE id IN (SELECT * FROM (VALUES {roots})))"]
    for k in range(1, depth + 1):
        out.append(f"b{k} AS (SELECT * FROM b{k - 1} UNION ALL SELECT DISTINCT b, {k} FROM st JOIN b{k - 1} p ON p.id = a AND p.depth = {k - 1} WHERE b NOT IN (SELECT id FROM b{k - 1}))")
    return ", ".join(out)


@query(with_sql(["nodes", "edges"], _bfs_sql(4) + " SELECT id, depth::INT AS depth, (row_number() OVER (ORDER BY depth, id) - 1)::INT AS visit_no FROM b4"))
def bounded_traversal(spark, sf_dir):
    """Nodes within four steps of two roots, with their order of visit."""
    n, e = _graph(spark, sf_dir)
    return G.visit_order(G.traverse(n, e, spark.createDataFrame([("r1",), ("s5",), ("nowhere",)], "id string"), "both", 4))


@query(with_sql(["nodes", "edges"], _bfs_sql(3, "outgoing") + " SELECT id, depth::INT AS depth FROM b3"))
def outgoing_traversal(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return G.traverse(n, e, spark.createDataFrame([("r1",), ("s5",)], "id string"), "outgoing", 3)


_PROJECT = _bfs_sql(2) + ", v AS (SELECT n.*, row_number() OVER (ORDER BY depth, b.id) AS no FROM nodes n JOIN b2 b USING (id)), kept AS (SELECT * FROM v ORDER BY no, type, id LIMIT 100)"


@query(with_sql(["nodes", "edges"], _PROJECT + " SELECT id, type FROM kept"))
def project_nodes(spark, sf_dir):
    return G.project(*_graph(spark, sf_dir), G.Request(roots=("r1", "s5"), nodes=100, edges=60))[0].select("id", "type")


@query(with_sql(["nodes", "edges"], _PROJECT + f" SELECT {_EDGE_COLS} FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept) ORDER BY type, source, target, confidence DESC LIMIT 60"))
def project_edges(spark, sf_dir):
    return G.project(*_graph(spark, sf_dir), G.Request(roots=("r1", "s5"), nodes=100, edges=60))[1].select("source", "target", "type", "confidence", "evidence_level")


@query(
    with_sql(
        ["nodes", "edges"],
        _PROJECT + ", fit AS (SELECT * FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)) SELECT (SELECT count(*) FROM v) AS available_nodes, (SELECT count(*) FROM kept) AS included_nodes, (SELECT count(*) FROM edges WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)) AS available_edges, least(60, (SELECT count(*) FROM fit)) AS included_edges, 'zzz' AS missing_roots, "
        "CASE WHEN (SELECT count(*) FROM v) > 100 AND (SELECT count(*) FROM fit) > 60 THEN 'node_and_edge_budget' WHEN (SELECT count(*) FROM v) > 100 THEN 'node_budget' WHEN (SELECT count(*) FROM fit) > 60 THEN 'edge_budget' END AS truncation, ((SELECT count(*) FROM v) > 100 OR (SELECT count(*) FROM fit) > 60) AS can_expand, 'limited' AS state",
    )
)
def project_counts(spark, sf_dir):
    return G.project(*_graph(spark, sf_dir), G.Request(roots=("r1", "s5", "zzz"), nodes=100, edges=60))[2]


_PAGE = _bfs_sql(1, "both", "('n3')") + ", v AS (SELECT id, type, row_number() OVER (ORDER BY (id <> 'n3'), depth, id) - 1 AS no FROM nodes JOIN b1 USING (id))"


@query(with_sql(["nodes", "edges"], _PAGE + " SELECT id, type FROM v WHERE no = 0 OR (no > 5 AND no < 25)"))
def neighbour_page(spark, sf_dir):
    return G.neighbour_page(*_graph(spark, sf_dir), "n3", G.Request(nodes=20, offset=5))[0].select("id", "type")


@query(
    with_sql(
        ["nodes", "edges"],
        _PAGE + ", i AS (SELECT DISTINCT source AS id FROM ge WHERE target = 'n3'), o AS (SELECT DISTINCT target AS id FROM ge WHERE source = 'n3'), w AS (SELECT * FROM i UNION SELECT * FROM o), s AS (SELECT w.id FROM w JOIN v USING (id) WHERE no > 5 AND no < 25), z AS (SELECT (SELECT count(*) FROM i) AS incoming, (SELECT count(*) FROM o) AS outgoing, (SELECT count(*) FROM w) AS available, (SELECT count(*) FROM s) AS included) SELECT *, greatest(0, available - 5 - included) AS remaining, CASE WHEN available - 5 - included > 0 THEN 5 + included END AS next_offset, available = 0 AS leaf FROM z",
    )
)
def neighbour_counts(spark, sf_dir):
    return G.neighbour_page(*_graph(spark, sf_dir), "n3", G.Request(nodes=20, offset=5))[1]


_FE = f"fe AS (SELECT * FROM edges WHERE {_ENDS} AND confidence >= 0.5), din AS (SELECT target AS id, count(*) AS n_in FROM fe GROUP BY 1), dout AS (SELECT source AS id, count(*) AS n_out FROM fe GROUP BY 1)"
_DEG = "deg AS (SELECT n.*, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM nodes n LEFT JOIN din USING (id) LEFT JOIN dout USING (id))"
_OWN = "own AS (SELECT DISTINCT file_path FROM nodes WHERE type = 'endpoint' AND start_line < 5)"


def _owners(spark, sf_dir) -> DataFrame:
    return L.nodes(spark, sf_dir).filter("type = 'endpoint' and start_line < 5").select("file_path")


@query(
    with_sql(
        ["nodes", "edges"],
        f"""{_FE}, {_DEG}, {_OWN}, th AS (SELECT list_sort(list(n_in + n_out))[ceil(0.75 * count(*))::INT] AS t FROM deg), f AS (SELECT *, contains(lower(coalesce(role, '')), 'entrypoint') AS entry, file_path IN (SELECT * FROM own) IS TRUE AS owner, n_in > 0 AND n_out > 0 AS bridge, greatest(2, t) AS many FROM deg, th),
  s AS (SELECT id, lower(CASE WHEN len(p) >= 2 AND lower(p[1]) IN {listed(P.ROOT_DIRS)} THEN p[1] || '/' || p[2] ELSE p[1] END) AS region, (CASE WHEN entry THEN 8 ELSE 0 END + CASE WHEN owner THEN 6 ELSE 0 END + CASE WHEN bridge THEN 4 ELSE 0 END + 2 * n_in + n_out)::BIGINT AS score,
  coalesce(nullif(concat_ws(',', CASE WHEN entry THEN 'application_entrypoint' END, CASE WHEN owner THEN 'endpoint_owner' END, CASE WHEN bridge THEN 'dependency_bridge' END, CASE WHEN n_in >= many THEN 'many_dependents' END, CASE WHEN n_out >= many THEN 'many_dependencies' END), ''), 'graph_region_representative') AS reasons, n_in, n_out
  FROM (SELECT *, string_split(coalesce(file_path, id), '/') AS p FROM f) WHERE entry OR owner OR n_in + n_out >= many)
  SELECT *, (row_number() OVER (ORDER BY again, score DESC, region, id))::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, id) > 1 AS again FROM s) QUALIFY position <= 24""".replace("SELECT *, (row_number() OVER (ORDER BY again", "SELECT id, region, score, reasons, n_in, n_out, (row_number() OVER (ORDER BY again"),
    )
)
def dependency_seeds(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return G.dependency_seeds(n, e, _owners(spark, sf_dir), G.Request(confidence=0.5))


_SIDE = "ee AS (SELECT * FROM edges WHERE confidence >= 0.7), din AS (SELECT target AS id, count(*) AS n_in FROM ee GROUP BY 1), dout AS (SELECT source AS id, count(*) AS n_out, bool_or(type = 'exposes_endpoint') AS ex, bool_or(type = 'calls_api') AS ca, bool_or(source = target) AS self FROM ee GROUP BY 1), side AS (SELECT n.*, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(ex, false) AS ex, coalesce(ca, false) AS ca, coalesce(self, false) AS self FROM nodes n LEFT JOIN din USING (id) LEFT JOIN dout USING (id))"


@query(
    with_sql(
        ["nodes", "edges"],
        _SIDE + """ SELECT id, type, CASE WHEN type = 'endpoint' AND ex THEN 0 WHEN type <> 'endpoint' AND ca THEN 1 WHEN type = 'endpoint' THEN 2 ELSE 3 END AS priority, CASE WHEN type = 'endpoint' THEN 'server_endpoint,handler_' || CASE WHEN ex THEN 'resolved' ELSE 'unresolved' END ELSE 'client_api_call,client_call_' || CASE WHEN ca THEN 'matched' ELSE 'unmatched' END END AS reasons, n_in, n_out,
  (row_number() OVER (ORDER BY priority, type <> 'endpoint', lower(label), id))::INT AS position FROM side WHERE type IN ('endpoint', 'api_call') QUALIFY position > 10 AND position <= 34""",
    )
)
def request_seeds(spark, sf_dir):
    return G.request_seeds(*_graph(spark, sf_dir), G.Request(confidence=0.7, offset=10))[0]


@query(with_sql(["nodes", "edges"], _SIDE + " SELECT count(*) FILTER (type = 'endpoint') AS endpoints, count(*) FILTER (type = 'api_call') AS client_calls, count(*) FILTER (type = 'endpoint' AND ex) AS resolved_handlers, count(*) FILTER (type = 'api_call' AND ca) AS matched_calls FROM side"))
def request_counts(spark, sf_dir):
    return G.request_seeds(*_graph(spark, sf_dir), G.Request(confidence=0.7))[1]


@query(
    with_sql(
        ["nodes", "edges"],
        _SIDE + f""", {_OWN} SELECT id, (CASE WHEN owner THEN 10 ELSE 0 END + CASE WHEN self THEN 8 ELSE 0 END + 2 * n_in + n_out)::BIGINT AS score, coalesce(nullif(concat_ws(',', CASE WHEN owner THEN 'endpoint_handler' END, CASE WHEN n_in >= 2 THEN 'many_callers' END, CASE WHEN n_out >= 2 THEN 'many_callees' END, CASE WHEN self THEN 'direct_recursion' END, CASE WHEN n_in = 0 THEN 'no_supported_internal_caller' END), ''), 'indexed_callable') AS reasons,
  n_in, n_out, (row_number() OVER (ORDER BY score DESC, lower(label), id))::INT AS position FROM (SELECT *, file_path IN (SELECT * FROM own) AS owner FROM side WHERE type IN ('function', 'method')) QUALIFY position <= 24""",
    )
)
def call_seeds(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return G.call_seeds(n, e, _owners(spark, sf_dir), G.Request(confidence=0.7))[0]


@query(with_sql(["nodes", "edges"], _SIDE + " SELECT (SELECT count(*) FROM side WHERE type IN ('function', 'method')) AS callables, (SELECT count(*) FROM side WHERE type IN ('function', 'method') AND self) AS recursive, count(*) FILTER (type = 'calls') AS resolved, count(*) FILTER (type IN ('calls_builtin', 'calls_external')) AS external, count(*) FILTER (type = 'calls_unresolved') AS unresolved FROM ee"))
def call_counts(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return G.call_seeds(n, e, _owners(spark, sf_dir), G.Request(confidence=0.7))[1]


_CONTEXTS = ("value-context:%7B%22k%22%3A%22scope%22%2C%22f%22%3A%22src%2Fnation%2F0.py%22%2C%22s%22%3A1%2C%22e%22%3A30%7D", "value-context:%7B%22k%22%3A%22token%22%2C%22f%22%3A%22src%2Fnation%2F5.py%22%2C%22l%22%3A1%2C%22v%22%3A%22N%22%7D", "v401")


@query(
    with_sql(
        ["nodes", "edges"],
        f"""ve AS (SELECT * FROM edges WHERE {_ENDS}), din AS (SELECT target AS id, count(*) AS n_in FROM ve GROUP BY 1), dout AS (SELECT source AS id, count(*) AS n_out FROM ve GROUP BY 1),
  m AS (SELECT n.*, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM nodes n LEFT JOIN din USING (id) LEFT JOIN dout USING (id) WHERE id = 'v401' OR (file_path = 'src/nation/0.py' AND start_line BETWEEN 1 AND 30) OR (file_path = 'src/nation/5.py' AND start_line = 1 AND trim(regexp_replace(label, '^[^:]*:', '')) = 'N'))
  SELECT id, CASE lower(coalesce(role, '')) WHEN 'parameter' THEN 0 WHEN 'definition' THEN 1 WHEN 'use' THEN 2 ELSE 3 END AS priority, n_in + n_out AS degree, concat_ws(',', CASE WHEN lower(coalesce(role, '')) IN ('parameter', 'definition', 'use') THEN 'value_' || lower(role) ELSE 'value_role_unresolved' END, CASE WHEN n_in > 0 THEN 'has_supported_origin' END, CASE WHEN n_out > 0 THEN 'has_supported_use' END, CASE WHEN n_out >= 2 THEN 'multiple_supported_uses' END) AS reasons,
  n_in, n_out, (row_number() OVER (ORDER BY priority, degree DESC, lower(coalesce(file_path, '')), start_line, id))::INT AS position FROM m QUALIFY position <= 24""",
    )
)
def value_seeds(spark, sf_dir):
    return G.value_seeds(*_graph(spark, sf_dir), G.Request(roots=_CONTEXTS))[0]


@query(
    "WITH " + _PAGE_ROUTES + f""", calls AS (SELECT page_id AS call_id, 'GET ' || trim(raw) AS label, {_SHAPE.format('trim(raw)')} AS shape FROM routes), ends AS (SELECT page_id AS endpoint_id, {_SHAPE.format("regexp_replace(raw, '^.*(/[^/]*/[^/]*)$', '" + chr(92) + "1')")} AS shape FROM routes WHERE page_id % 5 = 0),
  direct AS (SELECT call_id, endpoint_id FROM calls JOIN ends USING (shape)), loose AS (SELECT call_id, endpoint_id FROM calls c JOIN ends e ON e.shape <> '/' AND ends_with(c.shape, e.shape) WHERE call_id NOT IN (SELECT call_id FROM direct))
  SELECT call_id, min(endpoint_id) AS endpoint_id FROM (SELECT * FROM direct UNION ALL SELECT * FROM loose) GROUP BY 1 HAVING count(*) = 1"""
)
def call_matching(spark, sf_dir):
    """Client calls matched to the one endpoint that fits them."""
    r = _routes(spark, sf_dir)
    calls = r.select(col("page_id").alias("call_id"), F.concat(lit("GET "), F.trim("raw")).alias("label"))
    ends = r.filter("page_id % 5 = 0").select(col("page_id").alias("endpoint_id"), lit("get").alias("method"), F.regexp_replace("raw", "^.*(/[^/]*/[^/]*)$", "$1").alias("route"))
    return G.match_calls(calls, ends)


# --- impact ------------------------------------------------------------------------------------------------


def _impact_sql(depth: int) -> str:
    out = [
        "sides AS (SELECT s.a, s.b, s.type, s.confidence, s.adj FROM (SELECT source AS a, target AS b, type, confidence, seq * 2 AS adj FROM edges UNION ALL SELECT target, source, type, confidence, seq * 2 + 1 FROM edges) s WHERE b IN (SELECT id FROM nodes))",
        "i0 AS (SELECT id, 0 AS depth, row_number() OVER (ORDER BY id) AS no, 1.0::DOUBLE AS confidence, NULL::VARCHAR AS via, '' AS path FROM nodes WHERE id IN ('p7', 'p11'))",
    ]
    for k in range(1, depth + 1):
        out.append(
            f"s{k} AS (SELECT b AS id, min((no, adj)) AS m, arg_min((floor(p.confidence * s.confidence * 10000 + 0.5) / 10000), (no, adj)) AS confidence, arg_min(type, (no, adj)) AS via, arg_min(CASE WHEN path = '' THEN type ELSE path || '>' || type END, (no, adj)) AS path FROM i{k - 1} p JOIN sides s ON s.a = p.id WHERE p.depth = {k - 1} AND b NOT IN (SELECT id FROM i{k - 1}) GROUP BY 1), "
            f"i{k} AS (SELECT * FROM i{k - 1} UNION ALL SELECT id, {k}, row_number() OVER (ORDER BY m, id), confidence, via, path FROM s{k})"
        )
    return ", ".join(out)


def _hits(spark, sf_dir, depth: int = 3) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    roots = spark.createDataFrame([("p11", 1), ("p7", 2)], "id string, no long")
    return I.traverse(n, e, roots, depth)


@query(with_sql(["nodes", "edges"], _impact_sql(3) + " SELECT id, depth::INT AS depth, confidence, via, path FROM i3 WHERE depth > 0"))
def impact_traversal(spark, sf_dir):
    """First arrivals within three steps of two parts, with path and confidence."""
    return _hits(spark, sf_dir)


_HITS = _impact_sql(2) + ", hits AS (SELECT i.*, n.type, n.label, n.file_path FROM i2 i JOIN nodes n USING (id) WHERE depth > 0)"


@query(
    with_sql(
        ["nodes", "edges"],
        _HITS + ", c AS (SELECT count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS indirect, count(DISTINCT id) FILTER (type = 'endpoint') AS endpoints, count(*) FILTER (starts_with(lower(coalesce(file_path, '')), 'tests/')) AS tests, coalesce(bool_or(depth = 1 AND via IN " + listed(I.RISKY) + "), false) AS risky FROM hits) SELECT *, least(100, least(100, 8 * direct + 3 * indirect + 14 * endpoints) + CASE WHEN tests = 0 AND direct + indirect > 0 THEN 12 ELSE 0 END + CASE WHEN risky THEN 10 ELSE 0 END)::BIGINT AS risk_score, CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 35 THEN 'medium' WHEN risk_score > 0 THEN 'low' ELSE 'unknown' END AS risk_level FROM c",
    )
)
def impact_risk(spark, sf_dir):
    return I.risk(I.items(_hits(spark, sf_dir, 2), L.nodes(spark, sf_dir)))


@query(
    with_sql(
        ["nodes", "edges"],
        _HITS + ", k AS (SELECT *, row_number() OVER (PARTITION BY coalesce(file_path, id) ORDER BY depth, confidence DESC, label, id) AS nth FROM hits WHERE type = 'file' OR (file_path IS NOT NULL AND file_path <> 'src/nation/7.py')) SELECT id, file_path, depth::INT AS depth, confidence FROM k WHERE nth = 1 ORDER BY depth, confidence DESC, label, id LIMIT 20",
    )
)
def impact_files(spark, sf_dir):
    rows = I.items(_hits(spark, sf_dir, 2), L.nodes(spark, sf_dir))
    return I.affected(rows, "src/nation/7.py")["files"].select("id", "file_path", "depth", "confidence")


@query(with_sql(["nodes", "edges"], _HITS + " SELECT id, CASE WHEN via = 'imports_internal' THEN 'Connected through an internal import relation.' WHEN via = 'calls' THEN 'Connected through a function or method call.' WHEN via = 'calls_api' THEN 'Connected through a frontend or client API call.' WHEN via = 'exposes_endpoint' THEN 'Connected to an API endpoint handler.' WHEN via = 'defines' THEN 'Defined by an affected file.' WHEN via = 'contains' THEN 'Contained in an affected project area.' WHEN starts_with(via, 'dfg_') THEN 'Connected through data-flow analysis.' ELSE 'Connected through the project graph.' END AS reason FROM hits"))
def impact_reasons(spark, sf_dir):
    return I.items(_hits(spark, sf_dir, 2), L.nodes(spark, sf_dir)).select("id", "reason")


@query(with_sql(["nodes"], "SELECT id FROM nodes WHERE type = 'endpoint' AND (id = 'parts/19' OR contains(lower(label), 'parts/19'))"))
def impact_targets(spark, sf_dir):
    return I.resolve(L.nodes(spark, sf_dir), "endpoint", " parts/19 ").select("id")


# --- snapshots ------------------------------------------------------------------------------------------------

_DIMS = "concat_ws(',', " + ", ".join(f"CASE WHEN b.{k}_sha256 <> a.{k}_sha256 THEN '{k}' END" for k in D.KINDS) + ")"
_CHANGES = f"""kept AS (SELECT a.file_key, {_DIMS} AS dims, b.content_sha256 <> a.content_sha256 OR b.normalized_sha256 <> a.normalized_sha256 OR b.byte_size <> a.byte_size AS body FROM before b JOIN after a USING (file_key)),
old AS (SELECT file_key, content_sha256 AS h FROM before WHERE file_key NOT IN (SELECT file_key FROM after)), new AS (SELECT file_key, content_sha256 AS h FROM after WHERE file_key NOT IN (SELECT file_key FROM before)),
pairs AS (SELECT * FROM (SELECT h, count(*) AS o_n, min(file_key) AS o FROM old GROUP BY 1) JOIN (SELECT h, count(*) AS n_n, min(file_key) AS n FROM new GROUP BY 1) USING (h)), moves AS (SELECT o, n FROM pairs WHERE o_n = 1 AND n_n = 1),
changes AS (SELECT file_key AS previous_key, file_key AS current_key, CASE WHEN dims = '' THEN 'content' ELSE dims END AS kinds FROM kept WHERE dims <> '' OR body UNION ALL SELECT o, n, 'moved' FROM moves
  UNION ALL SELECT NULL, file_key, 'added' FROM new WHERE file_key NOT IN (SELECT n FROM moves) UNION ALL SELECT file_key, NULL, 'deleted' FROM old WHERE file_key NOT IN (SELECT o FROM moves))"""


@query(with_sql(["before", "after"], _CHANGES + " SELECT * FROM changes"))
def snapshot_changes(spark, sf_dir):
    return D.classify(*L.snapshots(spark, sf_dir))[0]


@query(with_sql(["before", "after"], _CHANGES + " SELECT coalesce(bool_or(o_n > 1 OR n_n > 1), false) AS ambiguous FROM pairs"))
def ambiguous_moves(spark, sf_dir):
    return D.classify(*L.snapshots(spark, sf_dir))[1]


@query(with_sql(["before", "after"], "SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' WHEN a.content_sha256 <> b.content_sha256 THEN 'changed' ELSE 'unchanged' END AS state FROM before b FULL JOIN after a USING (path)"))
def file_states(spark, sf_dir):
    return D.compare_files(*L.snapshots(spark, sf_dir))


def _closure_sql(depth: int) -> str:
    out = ["c0 AS (SELECT DISTINCT current_key AS file_key, 0 AS depth FROM changes WHERE current_key IS NOT NULL)", "f0 AS (SELECT previous_key AS file_key FROM changes WHERE previous_key IS NOT NULL UNION SELECT current_key FROM changes WHERE current_key IS NOT NULL)"]
    for k in range(1, depth + 1):
        out.append(f"f{k} AS (SELECT DISTINCT source_file_key AS file_key FROM dependencies JOIN f{k - 1} ON target_file_key = file_key WHERE source_file_key IN (SELECT file_key FROM after) AND source_file_key NOT IN (SELECT file_key FROM c{k - 1})), c{k} AS (SELECT * FROM c{k - 1} UNION ALL SELECT file_key, {k} FROM f{k})")
    return ", ".join(out)


@query(with_sql(["before", "after", "dependencies"], _CHANGES + ", " + _closure_sql(3) + " SELECT file_key, depth::INT AS depth FROM c3"))
def dependency_closure(spark, sf_dir):
    """Files to rebuild: changed ones and what depends on changes, two levels and the one past the limit."""
    before, after = L.snapshots(spark, sf_dir)
    return D.closure(D.classify(before, after)[0], L.dependencies(spark, sf_dir), after, 2)


@query(with_sql(["before", "after"], "d AS (SELECT file_key FROM before WHERE file_key NOT IN (SELECT file_key FROM after)) SELECT file_key, 'rebuild' AS action FROM after UNION ALL SELECT file_key, 'delete' FROM d"))
def incremental_plan(spark, sf_dir):
    """The plan of the change, a full one since some moves can't be told."""
    before, after = L.snapshots(spark, sf_dir)
    return D.plan(before, after, L.dependencies(spark, sf_dir), D.Limits())[2]


@query(with_sql(["before", "after", "dependencies"], "known AS (SELECT file_key FROM before UNION SELECT file_key FROM after) SELECT (SELECT count(*) - count(DISTINCT (source_file_key, target_file_key, relation)) FROM dependencies) AS duplicates, (SELECT count(*) FROM dependencies WHERE source_file_key NOT IN (SELECT * FROM known) OR target_file_key NOT IN (SELECT * FROM known)) AS unknown_ends"))
def dependency_validity(spark, sf_dir):
    return D.valid_dependencies(L.dependencies(spark, sf_dir), *L.snapshots(spark, sf_dir))


_FAMILY = "SELECT ['file', 'symbol', 'chunk'][length(path) % 3 + 1] AS family, file_key AS canonical_key, content_sha256 AS sha256 FROM "


@query(with_sql(["before", "after"], f"f AS ({_FAMILY} after), i AS ({_FAMILY} before) SELECT family, canonical_key, CASE WHEN f.sha256 IS NULL THEN 'missing_from_full' WHEN i.sha256 IS NULL THEN 'missing_from_incremental' ELSE 'digest_mismatch' END AS difference FROM f FULL JOIN i USING (family, canonical_key) WHERE f.sha256 IS DISTINCT FROM i.sha256"))
def equivalence(spark, sf_dir):
    before, after = L.snapshots(spark, sf_dir)
    shape = lambda df: df.select(F.element_at(F.array(lit("file"), lit("symbol"), lit("chunk")), F.length("path") % 3 + 1).alias("family"), col("file_key").alias("canonical_key"), col("content_sha256").alias("sha256"))
    return D.equivalence(shape(after), shape(before))


@query(with_sql(["before", "after"], "s AS (SELECT path FROM before b FULL JOIN after a USING (path) WHERE a.content_sha256 IS DISTINCT FROM b.content_sha256) SELECT path, 'old' AS version FROM before WHERE path NOT IN (SELECT path FROM s) UNION ALL SELECT path, 'new' FROM after WHERE path IN (SELECT path FROM s)"))
def incremental_merge(spark, sf_dir):
    """Rows of unchanged files kept, those of changed and added files taken from the new snapshot."""
    before, after = L.snapshots(spark, sf_dir)
    touched = D.compare_files(before, after).filter("state <> 'unchanged'")
    parsed = after.join(touched, "path", "left_semi").select("path", lit("new").alias("version"))
    return D.merge(before.select("path", lit("old").alias("version")), parsed, touched)


# --- evidence ------------------------------------------------------------------------------------------------


def _fused_sources(spark, sf_dir, fused: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and skipped files of fused candidates, by their ``source_key``."""
    paths = fused.select(F.expr("substring(source_key, 9)").alias("path")).distinct()
    doc = L.files(spark, sf_dir).join(F.broadcast(paths), "path", "left_semi")
    files = doc.filter("seq % 31 <> 0").select("path", F.when(col("seq") % 37 == 0, "stale").otherwise(col("content_hash")).alias("indexed_hash"), F.when(col("seq") % 41 == 0, lit(None)).otherwise(col("content")).alias("content"))
    return files, doc.filter("seq % 43 = 0").select("path")


def _evidence(spark, sf_dir, f: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (those fused in ``f``), files and skipped files; rules on ids spoil some of each."""
    f = FU.fuse(_retrieved(spark, sf_dir), POLICY) if f is None else f
    # fused lists have a stated number of rows a question, and go to the corpus
    f = cut(f.withColumn("chunk_id", F.substring("entity_key", 6, 100)))
    c = L.chunks(spark, sf_dir).join(F.broadcast(f.select("chunk_id").distinct()), "chunk_id", "left_semi").dropDuplicates(["chunk_id"]).select("chunk_id", "doc_id", "path", col("content"))
    kind = F.element_at(F.array(*map(lit, ["api_question", "flow_tracing", "onboarding", "code_question"])), (col("query_id") % 4 + 1).cast("int"))
    rows = cut(f.join(c, "chunk_id")).withColumn("kind", kind)
    good = F.sha2(F.concat_ws(":", "path", col("start_line").cast("string"), col("end_line").cast("string"), F.trim("content")), 256)
    rows = rows.select(
        "query_id", "chunk_id", F.col("chunk_id").alias("candidate_id"), "kind", "path", F.when(col("doc_id") % 19 == 0, "file:v0").otherwise(col("source_key")).alias("source_key"), (col("start_line") + F.when(col("doc_id") % 23 == 0, 100_000).otherwise(0)).alias("start_line"),
        (col("end_line") + F.when(col("doc_id") % 23 == 0, 100_000).otherwise(0)).alias("end_line"), "content", F.when(col("doc_id") % 29 == 0, F.sha2("content", 256)).otherwise(good).alias("chunk_hash"), "support", "retrievers", "reason_codes", lit("text").alias("chunk_type"), "fused", "best_rank", "entity_key",
        "candidate_ids", "normalised",
    )
    return rows, *_fused_sources(spark, sf_dir, f)


_EV = _CANDS + """, ev AS (SELECT p.query_id, p.chunk_id, doc_id, path, line, content, s, retrievers, fused, best_rank, ['api_question', 'flow_tracing', 'onboarding', 'code_question'][p.query_id % 4 + 1] AS kind FROM placed p JOIN hay USING (chunk_id) WHERE position <= 20),
checked AS (SELECT *, CASE WHEN doc_id % 43 = 0 THEN 'blocked_source' WHEN doc_id % 31 = 0 OR doc_id % 19 = 0 THEN 'source_not_in_current_index' WHEN doc_id % 41 = 0 THEN 'source_missing' WHEN doc_id % 37 = 0 THEN 'source_hash_changed' WHEN doc_id % 23 = 0 THEN 'range_invalid' WHEN doc_id % 29 = 0 THEN 'chunk_hash_changed' END AS reason,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE kind WHEN 'code_question' THEN 0 WHEN 'api_question' THEN CASE WHEN contains(retrievers, 'endpoint') THEN 0 ELSE 1 END WHEN 'flow_tracing' THEN CASE WHEN contains(retrievers, 'graph') THEN 0 ELSE 1 END ELSE 1 END, CASE WHEN contains(retrievers, 'exact') THEN 0 ELSE 1 END, s, fused DESC, best_rank, chunk_id) AS pos FROM ev),
sound AS (SELECT *, 24 + ceil(length(content) / 4) AS cost, row_number() OVER (PARTITION BY query_id ORDER BY again, pos) AS no FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY pos) > 1 AS again FROM checked WHERE reason IS NULL)),
lists AS (SELECT query_id, list({'c': chunk_id, 'k': cost::BIGINT, 'o': ''} ORDER BY no) AS l FROM sound GROUP BY 1),
walk AS (SELECT query_id, l, 1 AS i, 0::BIGINT AS used, 0 AS n, NULL::VARCHAR AS cid, NULL::VARCHAR AS outcome FROM lists)"""


def _pack_sql(budget: int, most: int) -> str:
    why = f"CASE WHEN n >= {most} THEN 'evidence_limit_reached' WHEN l[i].k > {budget} THEN 'block_exceeds_token_budget' WHEN used + l[i].k > {budget} THEN 'token_budget_exceeded' ELSE 'selected' END"
    return (
        f", steps AS (SELECT * FROM walk UNION ALL SELECT query_id, l, i + 1, used + CASE WHEN {why} = 'selected' THEN l[i].k ELSE 0 END, n + CASE WHEN {why} = 'selected' THEN 1 ELSE 0 END, l[i].c, {why} FROM steps WHERE i <= len(l))"
    )


_EVIDENCE = with_sql(_CAND_TABLES, _EV + _pack_sql(250, 6))


@query(_EVIDENCE + " SELECT query_id, cid AS candidate_id, outcome FROM steps WHERE cid IS NOT NULL UNION ALL SELECT query_id, chunk_id, reason FROM checked WHERE reason IS NOT NULL")
def evidence_selection(spark, sf_dir):
    """What becomes of each ranked candidate: a reason to reject it, or its place under the budget."""
    return E.select(*_evidence(spark, sf_dir), most=6, budget=250)[0]


@query(
    _EVIDENCE + """, o AS (SELECT query_id, cid AS c, outcome FROM steps WHERE cid IS NOT NULL UNION ALL SELECT query_id, chunk_id, reason FROM checked WHERE reason IS NOT NULL), t AS (SELECT query_id, max(used)::BIGINT AS used_tokens FROM steps GROUP BY 1)
  SELECT query_id, CASE WHEN kind IN ('api_question', 'flow_tracing') THEN 2 ELSE 1 END AS required, count(*) FILTER (outcome = 'selected') AS selected, count(*) FILTER (outcome <> 'selected') AS rejected, coalesce(any_value(used_tokens), 0) AS used_tokens, CASE WHEN selected < required THEN 'insufficient' WHEN rejected > 0 THEN 'limited' ELSE 'ready' END AS status FROM (SELECT DISTINCT query_id, kind FROM ev) JOIN o USING (query_id) LEFT JOIN t USING (query_id) GROUP BY query_id, kind"""
)
def evidence_status(spark, sf_dir):
    return E.select(*_evidence(spark, sf_dir), most=6, budget=250)[1]


@query(_EVIDENCE + ", o AS (SELECT query_id, cid AS c, outcome FROM steps WHERE cid IS NOT NULL UNION ALL SELECT query_id, chunk_id, reason FROM checked WHERE reason IS NOT NULL) SELECT query_id, outcome AS reason, count(*) AS n FROM o WHERE outcome <> 'selected' GROUP BY 1, 2")
def evidence_omissions(spark, sf_dir):
    return E.omissions(E.select(*_evidence(spark, sf_dir), most=6, budget=250)[0])


_SUFF = """, sel AS (SELECT st.query_id, path, s, retrievers FROM steps st JOIN ev ON ev.query_id = st.query_id AND ev.chunk_id = st.cid WHERE outcome = 'selected'), have AS (SELECT query_id, count(*) AS n, count(DISTINCT path) AS src, bool_or(contains(retrievers, 'endpoint')) AS e, bool_or(contains(retrievers, 'graph')) AS g FROM sel WHERE s < 2 GROUP BY 1),
r AS (SELECT query_id, query, ['api_question', 'flow_tracing', 'onboarding', 'code_question'][query_id % 4 + 1] AS kind, coalesce(n, 0) AS n, coalesce(src, 0) AS src, coalesce(e, false) AS e, coalesce(g, false) AS g FROM questions LEFT JOIN have USING (query_id)),
m AS (SELECT *, concat_ws(',', CASE WHEN kind IN ('api_question', 'flow_tracing') AND n < 2 THEN 'required_strong_evidence_count:2' END, CASE WHEN kind = 'api_question' AND NOT e THEN 'required_retriever:endpoint' WHEN kind = 'flow_tracing' AND NOT g THEN 'required_retriever:graph' END, CASE WHEN kind = 'onboarding' AND src < 2 THEN 'required_distinct_sources:2' END, CASE WHEN kind = 'code_question' AND n = 0 THEN 'required_strong_evidence_count:1' END) AS missing FROM r)"""


@query(
    _EVIDENCE + _SUFF + " SELECT query_id, kind, CASE WHEN missing = '' THEN 'answer' WHEN kind <> 'code_question' THEN 'repair' ELSE 'insufficient' END AS action, missing, CASE WHEN missing <> '' AND kind <> 'code_question' THEN trim(query) || ' ' || CASE kind "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.REPAIR_WORDS.items()) + " END END AS repair_query FROM m"
)
def sufficiency(spark, sf_dir):
    c, files, skipped = _evidence(spark, sf_dir)
    chosen = E.select(c, files, skipped, most=6, budget=250)[0].filter("outcome = 'selected'")
    blocks = c.join(chosen, ["query_id", "candidate_id"], "left_semi").select("query_id", "path", "support", "retrievers")
    kind = F.element_at(F.array(*map(lit, ["api_question", "flow_tracing", "onboarding", "code_question"])), (col("query_id") % 4 + 1).cast("int"))
    return E.sufficiency(blocks, L.questions(spark, sf_dir).withColumn("kind", kind))


@query(
    """WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, conv_id % 3 <> 0 AS stale FROM conversations), total AS (SELECT conv_id, count(*) AS total, bool_or(stale) AS stale_history FROM m GROUP BY 1),
  live AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS no FROM m WHERE NOT (stale AND role = 'assistant')), last AS (SELECT conv_id, no, CASE WHEN role IN ('operator', 'user') THEN 'operator' ELSE 'assistant' END || ': ' || trim(coalesce(text, '')) AS line FROM live WHERE no <= 8),
  lists AS (SELECT conv_id, list({'t': line, 'k': greatest(1, (length(line) + 3) // 4)} ORDER BY no) AS l FROM last GROUP BY 1),
  walk AS (SELECT conv_id, l, 1 AS i, 0::BIGINT AS used, 0 AS n, []::VARCHAR[] AS got FROM lists UNION ALL SELECT conv_id, l, i + 1, used + CASE WHEN used + l[i].k <= 200 THEN l[i].k ELSE 0 END, n + CASE WHEN used + l[i].k <= 200 THEN 1 ELSE 0 END, CASE WHEN used + l[i].k <= 200 THEN list_concat([l[i].t], got) ELSE got END FROM walk WHERE i <= len(l))
  SELECT conv_id, coalesce(array_to_string(got, chr(10)), '') AS text, coalesce(n, 0)::INT AS messages_used, coalesce(used, 0)::BIGINT AS tokens_used, coalesce(n, 0) < total AS truncated, stale_history FROM total LEFT JOIN (SELECT * FROM walk WHERE i = len(l) + 1) USING (conv_id)"""
)
def conversation_memory(spark, sf_dir):
    m = L.table(spark, sf_dir, "conversations")
    latest = m.select("conv_id", (lit(1) + F.when(col("conv_id") % 3 != 0, 0).otherwise(1)).alias("index_version")).distinct()
    return E.memory(m, latest, 2, budget=200)


@query(
    with_sql(
        ["files"],
        "e AS (SELECT seq AS evidence_id, CASE WHEN seq % 5 = 0 THEN 1 ELSE 2 END AS v, CASE WHEN seq % 7 = 0 THEN 'gone' ELSE path END AS path, (seq % 9)::INT AS a, (seq % 9 + seq % 4)::INT AS b FROM files), h AS (SELECT path, CASE WHEN seq % 11 = 0 THEN NULL ELSE len(string_split(content, chr(10))) END AS n FROM files) SELECT evidence_id, CASE WHEN v <> 2 THEN 'stale_index_version' WHEN h.path IS NULL THEN 'file_not_in_current_index' WHEN n IS NULL THEN 'source_file_missing' WHEN a < 1 OR b < a OR b > n THEN 'line_range_out_of_bounds' ELSE 'valid' END AS state FROM e LEFT JOIN h USING (path)",
    )
)
def evidence_freshness(spark, sf_dir):
    f = L.files(spark, sf_dir)
    ev = f.select(col("seq").alias("evidence_id"), F.when(col("seq") % 5 == 0, 1).otherwise(2).alias("index_version"), F.when(col("seq") % 7 == 0, "gone").otherwise(col("path")).alias("path"), (col("seq") % 9).cast("int").alias("start_line"), (col("seq") % 9 + col("seq") % 4).cast("int").alias("end_line"))
    return E.freshness(ev, f.select("path", F.when(col("seq") % 11 == 0, lit(None)).otherwise(col("content")).alias("content")), 2).select("evidence_id", "state")


@query(
    """WITH ev AS (SELECT doc_id AS id, doc_id % 4 <> 0 AS sel, doc_id % 6 <> 0 AS ok, 'v' || doc_id % 2 AS scope FROM documents WHERE doc_id % 9 <> 0), claims AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'x' END AS text, 'v' || doc_id % 2 AS scope, CASE doc_id % 5 WHEN 0 THEN [] WHEN 1 THEN [doc_id] WHEN 2 THEN [doc_id, doc_id] WHEN 3 THEN [doc_id, doc_id + 1] ELSE [doc_id, doc_id + 2] END AS cited FROM documents),
  one AS (SELECT doc_id, c.scope, unnest(cited) AS id FROM claims c), f AS (SELECT doc_id, bool_or(e.id IS NULL) AS unk, bool_or(coalesce(NOT sel, false)) AS uns, bool_or(coalesce(NOT ok, false)) AS inv, bool_or(coalesce(e.scope <> one.scope, false)) AS dif FROM one LEFT JOIN ev e USING (id) GROUP BY 1)
  SELECT doc_id AS claim_id, concat_ws(',', CASE WHEN trim(text) = '' THEN 'empty_claim' END, CASE WHEN len(list_distinct(cited)) < len(cited) THEN 'duplicate_citation' END, CASE WHEN len(cited) = 0 THEN 'citation_missing' END, CASE WHEN unk THEN 'unknown_evidence' END, CASE WHEN uns THEN 'evidence_not_selected' END, CASE WHEN inv THEN 'evidence_invalid' END, CASE WHEN dif THEN 'scope_mismatch' END) AS reasons, reasons = '' AS valid FROM claims LEFT JOIN f USING (doc_id)"""
)
def citation_checks(spark, sf_dir):
    d = L.table(spark, sf_dir, "documents").select("doc_id")
    i = col("doc_id")
    ev = d.filter("doc_id % 9 <> 0").select(i.alias("evidence_id"), (i % 4 != 0).alias("selected"), (i % 6 != 0).alias("valid"), F.concat(lit("v"), (i % 2).cast("string")).alias("scope"))
    cited = X.cases([(i % 5 == 0, F.array().cast("array<bigint>")), (i % 5 == 1, F.array(i)), (i % 5 == 2, F.array(i, i)), (i % 5 == 3, F.array(i, i + 1))], F.array(i, i + 2))
    claims = d.select(i.alias("claim_id"), F.when(i % 13 == 0, " ").otherwise("x").alias("text"), F.concat(lit("v"), (i % 2).cast("string")).alias("scope"), cited.alias("cited"))
    return E.citations(claims, ev)


# --- architecture ------------------------------------------------------------------------------------------------


def _any_sql(c: str, marks: list[str], how: str = "contains") -> str:
    return "(" + (" OR ".join(f"{how}({c}, '{m}')" for m in marks) or "false") + ")"


def _roles_sql() -> str:
    out = []
    for role, (kind, layer, parts, ends, marks, langs, base) in A.ROLES.items():
        a, b, c = _any_sql("'/' || lower(path)", parts), _any_sql(f"lower({_NAME})", ends, "ends_with"), _any_sql("lower(content)", marks)
        lang = f"lang IN {listed(langs)}" if langs else "true"
        out.append(f"SELECT path, '{role}' AS role, '{kind}' AS kind, '{layer}' AS layer, {A.LAYERS.index(layer)} AS o, {_domain_sql(role)} AS domain, {base} + CASE WHEN {a} THEN 35 ELSE 0 END + CASE WHEN {b} THEN 30 ELSE 0 END + CASE WHEN {c} THEN 40 ELSE 0 END AS score FROM src WHERE ({a} OR {b} OR {c}) AND {lang}")
    return f"src AS (SELECT path, any_value(lang) AS lang, min(content) AS content FROM (SELECT *, {_language_sql()} AS lang FROM catalogue) GROUP BY path), scores AS (SELECT * EXCLUDE (o) FROM (" + " UNION ALL ".join(out) + ") QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, o, role) = 1)"


def _sources(spark, sf_dir) -> DataFrame:
    return L.catalogue(spark, sf_dir).groupBy("path").agg(F.min("content").alias("content")).withColumn("language", P.language(col("path")))


@query(with_sql(["catalogue"], _roles_sql() + " SELECT path, role, kind, layer, domain, score FROM scores"))
def role_scores(spark, sf_dir):
    return A.role_scores(_sources(spark, sf_dir))


@query(with_sql(["catalogue"], _roles_sql() + f" SELECT role, domain, any_value(kind) AS kind, any_value(layer) AS layer, count(*) AS files, sum(score)::BIGINT AS score FROM scores GROUP BY 1, 2 ORDER BY list_position([{', '.join(repr(x) for x in A.LAYERS)}], any_value(layer)), domain, role LIMIT 20"))
def components(spark, sf_dir):
    return A.components(A.role_scores(_sources(spark, sf_dir)))


_TECH = "tech AS (" + " UNION ALL ".join(f"SELECT path, '{k}' AS technology, '{c}' AS category FROM spiced WHERE {_any_sql('lower(content)', m)} OR {_any_sql('lower(path)', m)}" for k, (c, m) in A.TECHNOLOGIES.items()) + ")"
_SPICED = "spiced AS (SELECT path, content || [' import redis', ' psycopg', '', ' kafka client', ''][length(path) % 5 + 1] AS content FROM src)"


def _spiced(spark, sf_dir) -> DataFrame:
    add = F.element_at(F.array(*map(lit, [" import redis", " psycopg", "", " kafka client", ""])), F.length("path") % 5 + 1)
    return _sources(spark, sf_dir).withColumn("content", F.concat("content", add))


@query(with_sql(["catalogue"], _roles_sql() + f", {_SPICED}, {_TECH} SELECT technology, category, count(*) AS n, array_to_string(list(path ORDER BY path)[1:8], ',') AS paths FROM tech GROUP BY 1, 2"))
def technologies(spark, sf_dir):
    return A.technologies(_spiced(spark, sf_dir))


@query(with_sql(["catalogue"], _roles_sql() + """, parts AS (SELECT DISTINCT kind, domain FROM scores), conv(a, b, label) AS (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in A.CONVENTIONS) + """), single AS (SELECT kind, min(domain) AS lone FROM parts GROUP BY 1 HAVING count(*) = 1)
  SELECT a || ':' || p.domain AS source, b || ':' || coalesce(t.domain, lone) AS target, label FROM conv JOIN parts p ON p.kind = a AND p.domain <> 'operational' LEFT JOIN parts t ON t.kind = b AND t.domain = p.domain LEFT JOIN single ON single.kind = b WHERE coalesce(t.domain, lone) IS NOT NULL"""))
def convention_relations(spark, sf_dir):
    return A.convention_relations(A.role_scores(_sources(spark, sf_dir)))


@query(
    with_sql(
        ["nodes", "edges"],
        "own AS (SELECT DISTINCT file_path AS path, ['api:a', 'application:b', 'domain:c'][length(file_path) % 3 + 1] AS component FROM nodes WHERE file_path IS NOT NULL), places AS (SELECT id, component FROM nodes JOIN own ON path = file_path) SELECT s.component AS source, t.component AS target, CASE e.type "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.RELATION_LABELS.items()) + " ELSE replace(e.type, '_', ' ') END AS label, CASE WHEN bool_or(evidence_level <> 'inferred' AND confidence >= 0.75) THEN 'confirmed' ELSE 'inferred' END AS support, count(*) AS n FROM edges e JOIN places s ON s.id = source JOIN places t ON t.id = target WHERE e.type <> 'contains' AND s.component <> t.component GROUP BY 1, 2, 3",
    )
)
def component_relations(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    own = n.filter("file_path is not null").select(col("file_path").alias("path")).distinct().withColumn("component", F.element_at(F.array(lit("api:a"), lit("application:b"), lit("domain:c")), F.length("path") % 3 + 1))
    return A.relations(e, n, own)


@query(with_sql(["catalogue"], _roles_sql() + f", {_SPICED}, {_TECH}, pref(category, want) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in A.OWNER_ROLES.items()) + f") SELECT technology, arg_min(kind || ':' || domain, (kind <> want, list_position([{', '.join(repr(x) for x in A.LAYERS)}], layer), domain, role)) FILTER (kind IS NOT NULL) AS component FROM tech JOIN pref USING (category) LEFT JOIN (SELECT * FROM scores WHERE kind NOT IN ('presentation', 'api')) USING (path) GROUP BY 1"))
def technology_owners(spark, sf_dir):
    s = _spiced(spark, sf_dir)
    body, path = F.lower("content"), F.lower("path")
    found = F.array_compact(F.array(*[F.when(X.any_of([body.contains(m) | path.contains(m) for m in ms]), F.struct(lit(k).alias("technology"), lit(c).alias("category"))) for k, (c, ms) in A.TECHNOLOGIES.items()]))
    rows = s.select("path", F.explode(found).alias("t")).select("path", "t.technology", "t.category")
    return A.technology_owner(rows, A.role_scores(_sources(spark, sf_dir)))


_STYLE = f"""spiced AS (SELECT path, content FROM src), {_TECH}, k AS (SELECT {', '.join(f"coalesce(bool_or(kind = '{x}'), false) AS {x}" for x in ('messaging', 'presentation', 'api', 'application'))}, count(DISTINCT domain) FILTER (kind = 'api' AND domain <> 'operational') AS domains FROM scores),
f AS (SELECT {', '.join(f"coalesce(bool_or(contains('/' || lower(path), '/{x}/')), false) AS {x}" for x in ('views', 'controllers', 'models'))}, coalesce(bool_or({_any_sql('lower(content)', ['argparse', 'click.command', 'commander', 'cobra.command', 'system.commandline'])}), false) AS cli,
  coalesce(bool_or(lower({_NAME}) IN ('lib.rs', 'setup.py', 'pyproject.toml', 'package.json', 'go.mod', 'pom.xml')), false) AS package FROM spiced), b AS (SELECT coalesce(bool_or(category = 'message_broker'), false) AS broker FROM tech)
SELECT CASE WHEN messaging AND broker THEN 'event_driven' WHEN presentation AND api THEN 'layered_web' WHEN views AND controllers AND models THEN 'mvc' WHEN api AND domains >= 3 AND application THEN 'modular' WHEN api THEN 'backend_api' WHEN cli THEN 'cli' WHEN package THEN 'library' ELSE 'package_map' END AS style FROM k, f, b"""


@query(with_sql(["catalogue"], _roles_sql().replace("min(content) AS content", "min(content) || [' import redis', ' psycopg', '', ' kafka client', ''][length(path) % 5 + 1] AS content") + ", " + _STYLE))
def architecture_style(spark, sf_dir):
    """How a corpus is built, by the kinds of its components, its folders and its technologies."""
    s = _spiced(spark, sf_dir)
    return A.style(A.role_scores(s), s, A.technologies(s))


# --- jobs and conversations ------------------------------------------------------------------------------------------------

_KINDS = {"signup": "claim", "view": "heartbeat", "error": "fail", "purchase": "complete", "click": "cancel"}


def _job_events(spark, sf_dir) -> DataFrame:
    kind = X.cases([(col("event_type") == k, v) for k, v in _KINDS.items()], "heartbeat")
    return L.table(spark, sf_dir, "events").select(col("user_id").alias("job_id"), col("event_id").alias("seq"), kind.alias("kind"), F.unix_micros(col("ts").cast("timestamp")).cast("double").alias("at")).withColumn("at", col("at") / 1e6)


@query()
def lease_replay(spark, sf_dir):
    """Outcome of every job event under the lease rules."""
    return J.replay(_job_events(spark, sf_dir))


@query("SELECT user_id AS job_id, event_id AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS attempt FROM events WHERE event_type = 'signup'")
def job_attempts(spark, sf_dir):
    return J.attempts(_job_events(spark, sf_dir)).select("job_id", "seq", "attempt")


@query("SELECT user_id AS job_id, event_id AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::INT AS position FROM events QUALIFY position <= 3")
def job_history(spark, sf_dir):
    return J.history(_job_events(spark, sf_dir), 3).select("job_id", "seq", "position")


def _allowed_sql() -> str:
    ok = " OR ".join(f"(a = '{a}' AND b IN {listed(bs)})" for a, bs in J.TRANSITIONS.items() if bs)
    states = "['queued', 'running', 'retry_scheduled', 'completed', 'failed', 'cancelled']"
    return f"SELECT event_id, a, b, ({ok}) AS allowed FROM (SELECT event_id, {states}[event_id % 6 + 1] AS a, {states}[(event_id // 6) % 6 + 1] AS b FROM events)"


@query(_allowed_sql())
def job_transitions(spark, sf_dir):
    states = F.array(*map(lit, ["queued", "running", "retry_scheduled", "completed", "failed", "cancelled"]))
    rows = L.table(spark, sf_dir, "events").select("event_id", F.element_at(states, (col("event_id") % 6 + 1).cast("int")).alias("a"), F.element_at(states, (F.floor(col("event_id") / 6) % 6 + 1).cast("int")).alias("b"))
    return rows.withColumn("allowed", J.allowed(col("a"), col("b")))


@query("SELECT user_id AS job_id, event_id % 5 AS v, CASE WHEN event_id % 5 = 3 THEN NULL WHEN event_id % 2 = 0 THEN 'not_validated' WHEN event_id % 7 <> 3 THEN 'active_version_changed' END AS error FROM events")
def activation_checks(spark, sf_dir):
    e = L.table(spark, sf_dir, "events")
    err = J.activation_error(col("event_id") % 5, col("event_id") % 7, lit(3).cast("long"), F.when(col("event_id") % 2 == 0, "building").otherwise("validated"))
    return e.select(col("user_id").alias("job_id"), (col("event_id") % 5).alias("v"), err.alias("error"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'failed' WHEN 'purchase' THEN 'indexed' ELSE 'indexing' END) ELSE 'indexed_with_warnings' END AS status FROM events")
def repaired_status(spark, sf_dir):
    e = L.table(spark, sf_dir, "events")
    job = X.cases([(col("event_type") == "error", "failed"), (col("event_type") == "click", "cancelled"), (col("event_type") == "purchase", "completed")], "running")
    return e.select("event_id", J.repaired_status(job, F.when(col("event_id") % 4 == 0, "indexing").otherwise("indexed_with_warnings")).alias("status"))


@query("SELECT conv_id, count(*) AS messages, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS questions, bool_and(turn = no) AS contiguous FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 + (SELECT min(turn) FROM conversations) AS no FROM conversations) GROUP BY 1 ORDER BY last_turn DESC, conv_id LIMIT 50")
def conversation_list(spark, sf_dir):
    """Conversations by their last turn, the first fifty, with counts and whether turns have no holes."""
    m = L.table(spark, sf_dir, "conversations")
    low = m.agg(F.min("turn").alias("low"))
    rows = m.crossJoin(F.broadcast(low)).withColumn("no", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1 + col("low"))
    out = rows.groupBy("conv_id").agg(F.count("*").alias("messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_if(col("role") == "user").alias("questions"), F.bool_and(col("turn") == col("no")).alias("contiguous"))
    return out.orderBy(F.desc("last_turn"), "conv_id").limit(50)


@query("SELECT doc_id, r AS rule FROM (SELECT doc_id, unnest([CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source_shape' END, CASE WHEN n_chars > 3000 THEN 'size' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'language' END, CASE WHEN length(text) <> n_chars THEN 'length' END]) AS r FROM documents) WHERE r IS NOT NULL")
def contract_violations(spark, sf_dir):
    """Rows that break a table's contract, one for each rule."""
    d = L.table(spark, sf_dir, "documents")
    rules = {"source_shape": col("source").rlike("^src[0-9]$"), "size": col("n_chars") <= 3000, "language": col("lang").isin("en", "fr"), "length": F.length("text") == col("n_chars")}
    return FI.violations(d, rules, "doc_id")


# --- candidates, contracts, transcripts ------------------------------------------------------------------------------------------------

from corpusmill.operators import assistant as AS  # noqa: E402
from corpusmill.operators import candidates as CA  # noqa: E402
from corpusmill.operators import contracts as CO  # noqa: E402

_CANDIDATES = """cnd AS (SELECT seq, 'edge' AS kind, NULL AS type, source || '|' || type || '|' || target AS key, CASE WHEN seq % 11 = 0 THEN target ELSE source END AS source, CASE WHEN seq % 11 = 0 THEN source ELSE target END AS target,
    CASE WHEN seq % 11 = 0 AND type = 'calls' THEN 'calls' WHEN seq % 13 = 0 THEN 'odd' ELSE type END AS relation, CASE WHEN seq % 17 = 0 THEN 'guess' ELSE 'parser' END AS producer, CASE WHEN seq % 19 <> 0 THEN 'own' END AS owner, confidence + CASE WHEN seq % 23 = 0 THEN 1 ELSE 0 END AS confidence, CASE WHEN seq % 29 = 0 THEN 'a' ELSE 'b' END AS digest FROM edges
  UNION ALL SELECT 0, 'node', type, id, NULL, NULL, NULL, 'parser', 'own', 1.0, 'b' FROM nodes)"""


def _graph_candidates(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    s = col("seq")
    turned = s % 11 == 0
    edges = e.select(
        "seq", lit("edge").alias("kind"), lit(None).cast("string").alias("type"), F.concat_ws("|", "source", "type", "target").alias("key"), F.when(turned & (col("type") != "calls"), col("target")).otherwise(col("source")).alias("source"),
        F.when(turned & (col("type") != "calls"), col("source")).otherwise(col("target")).alias("target"), F.when(turned & (col("type") == "calls"), "called_by").when(s % 13 == 0, "odd").otherwise(col("type")).alias("relation"),
        F.when(s % 17 == 0, "guess").otherwise("parser").alias("producer"), F.when(s % 19 != 0, "own").alias("owner"), (col("confidence") + F.when(s % 23 == 0, 1).otherwise(0)).alias("confidence"), F.when(s % 29 == 0, "a").otherwise("b").alias("digest"),
    )
    none = lit(None).cast("string")
    return edges.unionByName(n.select(lit(0).cast("long").alias("seq"), lit("node").alias("kind"), "type", col("id").alias("key"), none.alias("source"), none.alias("target"), none.alias("relation"), lit("parser").alias("producer"), lit("own").alias("owner"), lit(1.0).alias("confidence"), lit("b").alias("digest")))


_NORMAL = _CANDIDATES + """, ids AS (SELECT id FROM nodes), chk AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY seq) AS nth, count(DISTINCT digest) OVER (PARTITION BY kind, key) AS dig FROM cnd),
told AS (SELECT seq, kind, key, CASE WHEN producer = 'guess' THEN 'unknown_producer' WHEN owner IS NULL THEN 'owner_missing' WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence_range' WHEN kind = 'edge' AND relation = 'odd' THEN 'unknown_relation' WHEN kind = 'edge' AND (source NOT IN (SELECT id FROM ids) OR target NOT IN (SELECT id FROM ids)) THEN 'dangling' WHEN dig > 1 THEN 'conflict' WHEN confidence < 0.6 THEN 'low_confidence' WHEN nth > 1 THEN 'duplicate' END AS issue FROM chk)"""


@query(with_sql(["nodes", "edges"], _NORMAL + " SELECT seq, key, CASE WHEN issue IS NULL THEN 'active' WHEN issue = 'duplicate' THEN 'duplicate' ELSE 'rejected' END AS status, issue FROM told WHERE kind = 'edge'"))
def graph_candidates(spark, sf_dir):
    """Status and issue of every edge candidate."""
    return CA.normalise(_graph_candidates(spark, sf_dir), 0.6).filter("kind = 'edge'").select("seq", "key", "status", "issue")


@query(with_sql(["nodes", "edges"], _NORMAL + " SELECT count(*) AS issues, count(*) FILTER (issue = 'conflict') AS critical FROM told WHERE issue IS NOT NULL AND issue <> 'duplicate'"))
def candidate_issues(spark, sf_dir):
    return CA.issues(CA.normalise(_graph_candidates(spark, sf_dir), 0.6))[1]


@query("SELECT l.l_orderkey * 10 + l.l_linenumber AS call_id, a.arg AS source, p.nm AS target FROM lineitem l, (VALUES (0, 'x'), (1, 'y'), (2, 'z')) a(n, arg), (VALUES (0, 'first'), (1, 'second')) p(n, nm) WHERE a.n = p.n")
def argument_binding(spark, sf_dir):
    """Arguments of calls bound to parameters by place."""
    calls = L.table(spark, sf_dir, "lineitem").select((col("l_orderkey") * 10 + col("l_linenumber")).alias("call_id"), lit("f").alias("callee"), F.array(lit("x"), lit("y"), lit("z")).alias("arguments"))
    parameters = spark.range(1).select(lit("f").alias("callee"), F.array(lit("self"), lit("first"), lit("second")).alias("names"))  # of a size that is known, unlike a local list's
    return CA.bind_arguments(calls, parameters)


_CALL_SIDE = "SELECT o_orderkey AS {0}, o_custkey % 7 AS caller, o_orderstatus AS name, ((o_orderkey + {1}) % 5)::INT AS line, row_number() OVER (PARTITION BY o_custkey % 7, o_orderstatus, (o_orderkey + {1}) % 5 ORDER BY o_orderkey) AS n FROM orders"


@query(f"WITH r AS ({_CALL_SIDE.format('ref_id', 0)}), e AS ({_CALL_SIDE.format('expr_id', 2)}) SELECT ref_id, expr_id FROM r JOIN e USING (caller, name, line, n)")
def call_pairs(spark, sf_dir):
    """References and call expressions, two places of every order, paired by their occurrence."""
    side = lambda key, by: L.table(spark, sf_dir, "orders").select(col("o_orderkey").alias(key), (col("o_custkey") % 7).alias("caller"), col("o_orderstatus").alias("name"), ((col("o_orderkey") + by) % 5).cast("int").alias("line"))
    return CA.pair_calls(side("ref_id", 0), side("expr_id", 2))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'hybrid_retrieval' WHEN turn % 2 = 0 THEN 'exact_lookup' ELSE 'exact_lookup,hybrid_retrieval' END AS tools FROM conversations")
def tool_plans(spark, sf_dir):
    m = L.table(spark, sf_dir, "conversations")
    return m.select("conv_id", "turn", AS.tools(F.when(col("turn") % 3 == 0, "flow_tracing").otherwise("code_question"), col("turn") % 2 == 0).alias("tools"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE conv_id % 5 <> 0) WHERE n <= 3")
def transcripts(spark, sf_dir):
    m = L.table(spark, sf_dir, "conversations").withColumn("deleted", col("conv_id") % 5 == 0)
    return AS.transcript(m, 3).select("conv_id", "turn", "position")


@query("SELECT conv_id, count(*) AS n FROM (SELECT DISTINCT ON (conv_id, role, lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) conv_id FROM conversations) GROUP BY 1")
def distinct_calls(spark, sf_dir):
    """Different questions of each conversation, as equal tool calls are made once."""
    m = L.table(spark, sf_dir, "conversations").select(col("conv_id").alias("turn_id"), col("turn").alias("seq"), col("role").alias("tool"), col("text").alias("query"))
    return AS.distinct_calls(m).groupBy(col("turn_id").alias("conv_id")).agg(F.count("*").alias("n"))


@query(
    with_sql(
        ["files"],
        "a AS (SELECT seq AS anchor_id, CASE WHEN seq % 7 = 0 THEN 'gone' ELSE path END AS path, CASE WHEN seq % 5 = 0 THEN 'old' ELSE content_hash END AS h, (seq % 4)::INT AS s, (seq % 9)::INT AS e, CASE WHEN seq % 2 = 0 THEN CASE WHEN seq % 3 = 0 THEN 'f' ELSE 'g' END END AS symbol FROM files) SELECT anchor_id, CASE WHEN f.path IS NULL THEN 'file_unknown' WHEN a.h <> f.content_hash THEN 'hash_changed' WHEN s < 1 OR e < s OR e > len(string_split(content, chr(10))) THEN 'range_invalid' WHEN symbol = 'g' THEN 'symbol_unknown' END AS error FROM a LEFT JOIN files f USING (path)",
    )
)
def anchor_checks(spark, sf_dir):
    f = L.files(spark, sf_dir)
    s = col("seq")
    anchors = f.select(s.alias("anchor_id"), F.when(s % 7 == 0, "gone").otherwise(col("path")).alias("path"), F.when(s % 5 == 0, "old").otherwise(col("content_hash")).alias("file_hash"), (s % 4).cast("int").alias("start_line"), (s % 9).cast("int").alias("end_line"), F.when(s % 2 == 0, F.when(s % 3 == 0, "f").otherwise("g")).alias("symbol"))
    return AS.anchor_error(anchors, f, f.select("path", lit("f").alias("name")))


@query(with_sql(["before"], "SELECT file_key, unnest(list_filter([CASE WHEN byte_size * (length(path) % 2 * 2 - 1) < 0 THEN 'size_positive' END, CASE WHEN contains(path, 'en/') THEN 'path_plain' END], lambda x: x IS NOT NULL)) AS rule FROM before"))
def fingerprint_contract(spark, sf_dir):
    """Fingerprints that break their contract; a rule makes some sizes negative and some paths absolute."""
    b = L.snapshots(spark, sf_dir)[0].withColumn("byte_size", col("byte_size") * (F.length("path") % 2 * 2 - 1)).withColumn("path", F.when(col("path").contains("en/"), F.concat(lit("/"), "path")).otherwise(col("path")))
    return FI.violations(b, CO.fingerprints(), "file_key")


@query("SELECT vec_id, r AS rule FROM (SELECT vec_id, unnest(CASE WHEN vec_id % 7 = 0 THEN ['dimension'] WHEN vec_id % 11 = 0 THEN ['norm'] ELSE [] END) AS r FROM embeddings)")
def vector_contract(spark, sf_dir):
    v = L.table(spark, sf_dir, "embeddings")
    e = F.when(col("vec_id") % 7 == 0, F.slice("embedding", 1, 5)).when(col("vec_id") % 11 == 0, F.transform("embedding", lambda x: (x * 0).cast("float"))).otherwise(col("embedding"))
    return FI.violations(v.withColumn("embedding", e), CO.vectors(64), "vec_id")


@query("SELECT c_nationkey AS nation, round(count(*) FILTER (c_acctbal > 0) / count(*), 6) AS coverage FROM customer GROUP BY 1")
def coverage_shares(spark, sf_dir):
    c = L.table(spark, sf_dir, "customer").groupBy(col("c_nationkey").alias("nation")).agg(F.count_if(col("c_acctbal") > 0).alias("s"), F.count("*").alias("t"))
    return c.select("nation", CO.coverage(col("s"), col("t")).alias("coverage"))


from corpusmill.plans import answering, building, checks, flow, lifecycle  # noqa: E402, F401  (they register their queries)
