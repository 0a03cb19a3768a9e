"""Text functions as column expressions: tokens, routes, ids, previews, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of queries (fixed values).
STOPWORDS = "the and for with that this what where when how can you toi cua cho nao nhu hoat dong".split()
#: Question types and the substrings that decide them, first match wins (fixed values).
QUESTION_RULES = (
    ("architecture_overview", ("kien truc", "architecture", "overview", "tong the")),
    ("flow_tracing", ("luong", "flow", "hoat dong")),
    ("api_question", ("api", "endpoint", "post", "get")),
    ("database_question", ("database", "model", "table", "migration")),
    ("debugging", ("error", "loi", "401", "500", "exception")),
    ("onboarding", ("doc file nao", "moi join", "onboarding")),
    ("impact_analysis", ("impact", "anh huong", "neu sua")),
)
#: Extra score of a chunk type under a question type (fixed values).
CHUNK_BOOSTS = {
    "api_question": {"endpoint": 2.0, "function": 0.5, "method": 0.5},
    "flow_tracing": {"endpoint": 1.0, "function": 1.0, "method": 1.0},
    "architecture_overview": {"doc_section": 1.5, "file_summary": 1.0},
    "debugging": {"function": 0.8, "method": 0.8, "file_summary": 0.4},
}
#: Words that a repair query appends (fixed values).
REPAIR_WORDS = {
    "flow_tracing": "endpoint handler caller callee graph relation",
    "api_question": "endpoint handler route source",
    "impact_analysis": "dependency reference caller callee graph relation",
    "architecture_overview": "readme entrypoint configuration module architecture",
    "onboarding": "readme documentation entrypoint setup module",
}
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD")


def cases(rules: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first rule that holds."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(default) if out is not None else default


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def empty(c: Column) -> Column:
    """Null as an empty string: haystacks and hashes treat them alike."""
    return F.coalesce(c, F.lit(""))


# --- previews and hashes -------------------------------------------------------------------------


def preview(content: Column, length: int = 420) -> Column:
    flat = F.trim(F.regexp_replace(content, r"\s+", " "))
    return F.when(F.length(flat) <= length, flat).otherwise(F.concat(F.substring(flat, 1, length), F.lit("...")))


def content_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def node_id(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit("_"), F.substring(F.sha1(value), 1, 10))


def joined_hash(parts: list[Column], length: int = 16) -> Column:
    """sha1 over parts joined by the unit separator, cut to ``length``; nulls are empty."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[empty(p.cast("string")) for p in parts])), 1, length)


def production_id(prefix: str, parts: list[Column]) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[empty(p.cast("string")) for p in parts]), 256), 1, 32))


def candidate_id(parts: list[Column]) -> Column:
    return F.concat(F.lit("cand_"), F.substring(F.sha2(F.concat_ws("|", *[empty(p.cast("string")) for p in parts]), 256), 1, 24))


def evidence_id(texts: list[Column], numbers: list[Column]) -> Column:
    """sha256 prefix over the compact JSON list of texts, then numbers; texts hold plain ASCII."""
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for t in texts]
    body = F.concat(F.lit("["), F.concat_ws(",", *quoted, *[n.cast("string") for n in numbers]), F.lit("]"))
    return F.concat(F.lit("evidence_"), F.substring(F.sha2(body, 256), 1, 24))


# --- tokens ----------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_/.-]+)"), 1)


def query_terms(query: Column) -> Column:
    return F.array_distinct(F.filter(tokens(query), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS)))


def sparse_tokens(text: Column) -> Column:
    """ASCII tokens, each followed by its parts of over one character (a token without separators is its own part)."""
    whole = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_/.-]+)"), 1)
    return F.flatten(F.transform(whole, lambda t: F.concat(F.array(t), F.filter(F.split(t, "[/_.-]+"), lambda p: F.length(p) > 1))))


def four_grams(token: Column) -> Column:
    """Substrings of four characters of tokens of five or more."""
    none = F.array().cast("array<string>")
    return F.when(F.length(token) >= 5, F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - 3, F.lit(1))), lambda i: F.substr(token, i, F.lit(4)))).otherwise(none)


def matched_terms(terms: Column, haystack: Column) -> Column:
    """Terms that occur in the (lower-case) haystack: every token is a substring, so that covers both cases."""
    return F.filter(terms, lambda t: haystack.contains(t))


def lexical_score(terms: Column, haystack: Column, seen: Column | None = None) -> Column:
    """2 for each term that is a token (``seen``, if they are at hand), 0.75 for one that is only a substring."""
    seen = tokens(haystack) if seen is None else seen
    return F.aggregate(
        terms, F.lit(0.0), lambda acc, t: acc + F.when(F.array_contains(seen, t), 2.0).when(haystack.contains(t), 0.75).otherwise(0.0)
    )


def haystack(parts: list[Column]) -> Column:
    return F.lower(F.concat_ws(" ", *[empty(p) for p in parts]))


# --- questions -------------------------------------------------------------------------------------


def question_type(question: Column) -> Column:
    low = F.lower(question)
    return cases([(any_of([low.contains(s) for s in signals]), kind) for kind, signals in QUESTION_RULES], "code_question")


def question_confidence(question: Column) -> Column:
    return F.when(question_type(question) == "code_question", 0.5).otherwise(0.9)


def question_reasons(question: Column) -> Column:
    """``matched:`` and each signal of the deciding rule, in rule order, joined by commas."""
    low = F.lower(question)

    def hits(signals):
        return F.array_join(F.filter(F.array(*[F.when(low.contains(s), F.lit(f"matched:{s}")) for s in signals]), lambda x: x.isNotNull()), ",")

    return cases([(any_of([low.contains(s) for s in signals]), hits(signals)) for _, signals in QUESTION_RULES], "default:code_question")


def chunk_boost(question_kind: Column, chunk_type: Column) -> Column:
    return cases([((question_kind == q) & (chunk_type == c), v) for q, by in CHUNK_BOOSTS.items() for c, v in by.items()], 0.0)


def repair_query(question_kind: Column, question: Column) -> Column:
    words = cases([(question_kind == k, v) for k, v in REPAIR_WORDS.items()], "source definition reference")
    return F.concat(F.trim(question), F.lit(" "), words)


def required_evidence(question_kind: Column) -> Column:
    return F.when(question_kind.isin("flow_tracing", "api_question", "impact_analysis"), 2).otherwise(1)


# --- routes ------------------------------------------------------------------------------------------


def normalize_route(route: Column) -> Column:
    """Trimmed, lower-case, without a leading ``/api`` (of ``/apix`` too) and trailing slashes; ``/`` at least."""
    low = F.lower(F.trim(route))
    cut = F.when(low.startswith("/api"), F.substr(low, F.lit(5))).otherwise(low)
    return F.coalesce(F.nullif(F.regexp_replace(cut, "/+$", ""), F.lit("")), F.lit("/"))


def route_shape(route: Column) -> Column:
    plain = normalize_route(F.split(route, r"\?", 2)[0])
    return F.regexp_replace(F.regexp_replace(plain, r"\{[^/{}]+\}", "{}"), r":[A-Za-z_$][A-Za-z0-9_$]*", "{}")


def call_method(label: Column) -> Column:
    """Method of a ``METHOD route`` label, null where it has none or no route."""
    parts = F.split(F.trim(label), " ", 2)
    method = F.upper(parts[0])
    return F.when((F.size(parts) == 2) & method.isin(*METHODS) & (F.trim(F.get(parts, F.lit(1))) != ""), method)


def call_route(label: Column) -> Column:
    return F.when(call_method(label).isNotNull(), F.trim(F.get(F.split(F.trim(label), " ", 2), F.lit(1))))


def suffix_match(client: Column, endpoint: Column) -> Column:
    return (endpoint != "/") & client.endswith(endpoint)


def client_route(raw: Column, base: Column) -> Column:
    """A client's URL as a route: ``${x}`` as ``{x}``, path only, base path before it, no trailing slash."""
    templ = F.regexp_replace(raw, r"\$\{([^}]*)\}", "{$1}")
    path = F.regexp_replace(F.regexp_replace(templ, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    full = F.concat(F.regexp_replace(empty(base), "/+$", ""), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    return F.coalesce(F.nullif(F.regexp_replace(full, "/+$", ""), F.lit("")), F.lit("/"))


# --- messages ----------------------------------------------------------------------------------------


#: Shapes of credentials, and what stands for each (fixed values).
CREDENTIALS = (
    (r"(?i)\b(bearer\s+)[a-z0-9._~+/=-]{8,}", "$1[REDACTED]"),
    (r"\b(?:sk[-_]|ghp_|github_pat_)[A-Za-z0-9_-]{8,}\b", "[REDACTED]"),
    (r"(?i)\b(password|passwd|api[_-]?key|access[_-]?token|secret)\b(\s*[:=]\s*)([^\s,;]+)", "$1$2[REDACTED]"),
)


def redact(message: Column, most: int = 16_000) -> Column:
    """The first ``most`` characters with credentials of three shapes made ``[REDACTED]``."""
    out = F.substring(message, 1, most)
    for shape, instead in CREDENTIALS:
        out = F.regexp_replace(out, shape, instead)
    return out


def memory_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("int")


def evidence_tokens(content: Column) -> Column:
    return (F.lit(24) + F.ceil(F.length(content) / 4)).cast("int")


def conversation_key(given: Column) -> Column:
    """A given id where it has the right shape, else one made from its hash; null stays null."""
    return F.when(given.rlike(r"^conv_[A-Za-z0-9_-]{1,64}$"), given).when(given.isNotNull(), F.concat(F.lit("conv_"), F.substring(F.sha2(given, 256), 1, 32)))


def retry_delay(attempt: Column) -> Column:
    return F.least(F.lit(60_000.0), F.lit(1000.0) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def line_range(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull(), F.concat(start.cast("string"), F.lit("-"), F.coalesce(end, start).cast("string")))


def bounded_strings(values: Column, most: int = 32, length: int = 128) -> Column:
    return F.transform(F.slice(values, 1, most), lambda v: F.substring(v, 1, length))
