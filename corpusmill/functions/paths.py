"""Rules over file paths as column expressions: languages, types, secrets, layers, roles, domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import any_of, cases, empty

# Fixed values from here on.
IGNORED_DIRS = (
    ".git .svn .hg node_modules venv .venv env .env dist build .next .nuxt coverage .pytest_cache .mypy_cache __pycache__ .cache "
    ".ai-codebase .idea .vscode target"
).split()
SECRETS = (".env", "secrets.", "credentials.", ".pem", ".key")
#: Language: display name, suffixes, file names, type.
LANGUAGES = {
    "python": ("Python", [".py"], [], "source"),
    "html": ("HTML", [".html", ".htm"], [], "source"),
    "css": ("CSS", [".css"], [], "source"),
    "javascript": ("JavaScript", [".js", ".jsx"], [], "source"),
    "typescript": ("TypeScript", [".ts", ".tsx"], [], "source"),
    "go": ("Go", [".go"], [], "source"),
    "rust": ("Rust", [".rs"], [], "source"),
    "java": ("Java", [".java"], [], "source"),
    "kotlin": ("Kotlin", [".kt", ".kts"], [], "source"),
    "c": ("C", [".c", ".h"], [], "source"),
    "cpp": ("C++", [".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"], [], "source"),
    "csharp": ("C#", [".cs"], [], "source"),
    "php": ("PHP", [".php"], [], "source"),
    "ruby": ("Ruby", [".rb"], [], "source"),
    "swift": ("Swift", [".swift"], [], "source"),
    "markdown": ("Markdown docs", [".md"], [], "document"),
    "docker": ("Docker", [], ["Dockerfile"], "config"),
    "config": ("Config", [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg"], ["docker-compose.yml"], "config"),
}
UNSAFE_DIRS = (".git", "node_modules", "venv", ".venv", "dist", "build", "secrets", "credentials")
UNSAFE_SUFFIXES = (".pem", ".key", ".p12", ".pfx")
ROOT_DIRS = ("src", "app", "backend", "frontend", "packages", "apps")
REMOVABLE = (
    "service services controller controllers router routes handler handlers repository repositories client adapter provider model models schema schemas "
    "store storage view views component components api impl implementation consumer consumers producer producers worker workers job jobs"
).split()
PLAIN_DIRS = "src app backend frontend internal pkg cmd".split()
PLAIN_STEMS = "index main base program application".split()
OPERATIONAL = "debug health metrics metric ready readiness live liveness status ops internal".split()
DOMAIN_NAMES = {
    "auth": "Authentication", "users": "User", "user": "User", "operational": "Operational", "models": "Data",
    "application": "Application", "config": "Configuration", "gemini": "Gemini",
}
TAG_WORDS = ("auth", "login", "config", "database", "api", "test")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot, lower-case; none for names that only begin with a dot."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"^(.+)\.[^.]+$", "$1")


def ignored(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, IGNORED_DIRS)))


def secret(path: Column) -> Column:
    low = F.lower(name(path))
    return (low != ".env.example") & ((low == ".env") | any_of([low.contains(s) for s in SECRETS]))


def language(path: Column) -> Column:
    """A file name decides before a suffix; ``unknown`` without either."""
    named = [(name(path) == n, k) for k, (_, _, names, _) in LANGUAGES.items() for n in names]
    return cases(named + [(suffix(path).isin(*s), k) for k, (_, s, _, _) in LANGUAGES.items() if s], "unknown")


def supported(path: Column) -> Column:
    return language(path) != "unknown"


def file_type(path: Column) -> Column:
    lang = language(path)
    kinds = [(lang.isin(*[k for k, v in LANGUAGES.items() if v[3] == t]), t) for t in ("source", "document", "config")]
    return cases([(F.lower(path).contains("test"), "test"), *kinds], "config")


def skip_reason(path: Column, size: Column, most: int = 1_000_000) -> Column:
    """Why a scan passes over a file, by the first rule that holds; null: it is taken."""
    dirs = F.slice(parts(path), 1, F.greatest(F.size(parts(path)) - 1, F.lit(0)))
    return cases(
        [
            (F.arrays_overlap(dirs, F.array(*map(F.lit, IGNORED_DIRS))), "ignored_directory"),
            (secret(path), "secret_file"),
            (~supported(path), "unsupported_type"),
            (size > most, "file_too_large"),
        ],
        F.lit(None).cast("string"),
    )


def safe_source(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    segments = F.filter(parts(low), lambda p: p != "")
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    dirs = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    bad = F.arrays_overlap(dirs, F.array(*map(F.lit, UNSAFE_DIRS)))
    return ~(bad | last.startswith(".env") | last.contains("secret") | last.contains("credential") | F.regexp_extract(last, r"^.+(\.[^.]+)$", 1).isin(*UNSAFE_SUFFIXES))


def layer(kind: Column, path: Column) -> Column:
    low = F.lower(empty(path))
    has = lambda *names: F.arrays_overlap(parts(low), F.array(*map(F.lit, names)))
    return cases(
        [
            (has("frontend", "client", "ui"), "frontend"),
            (has("backend", "api", "server"), "backend"),
            (has("tests") | low.contains("test"), "tests"),
            (has("docs") | ((kind == "folder") & low.contains("doc")), "documentation"),
            (kind == "endpoint", "api"),
            (kind.isin("module", "external_call", "framework_call", "stdlib_call", "builtin_call"), "external"),
        ],
        "application",
    )


def kind_complexity(kind: Column) -> Column:
    return cases([(kind.isin("cfg_node", "dfg_node", "unresolved_call"), "medium"), (kind.isin("folder", "file", "module"), "low")], "unknown")


def title(kind: Column) -> Column:
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def node_role(kind: Column) -> Column:
    known = {
        "folder": "Project area", "file": "Source file", "module": "Import target", "endpoint": "API endpoint",
        "api_call": "Frontend or client API call", "cfg_node": "Control flow node", "dfg_node": "Data flow node",
    }
    return cases([(kind == k, v) for k, v in known.items()], title(kind))


def node_summary(kind: Column, label: Column, path: Column) -> Column:
    return cases(
        [
            ((kind == "file") & (empty(path) != ""), F.concat(F.lit("Source file "), path, F.lit("."))),
            (kind == "folder", F.concat(F.lit("Project folder "), label, F.lit("."))),
            (kind == "endpoint", F.concat(F.lit("API endpoint "), label, F.lit("."))),
        ],
        F.concat(title(kind), F.lit(" "), label, F.lit(".")),
    )


def clean_tags(tags: Column) -> Column:
    """Trimmed, lower-case, blanks as underscores, first occurrences in order, none empty."""
    made = F.transform(tags, lambda t: F.replace(F.lower(F.trim(t)), F.lit(" "), F.lit("_")))
    return F.array_distinct(F.filter(made, lambda t: t != ""))


def inferred_tags(kind: Column, path: Column, label: Column) -> Column:
    low = F.lower(F.concat(empty(path), F.lit(" "), label))
    return F.concat(F.array(kind), F.filter(F.array(*map(F.lit, TAG_WORDS)), lambda t: low.contains(t)))


def region(path: Column, kind: Column) -> Column:
    """First folder of a path, the first two under a known root folder; the kind where there is none."""
    segments = F.filter(parts(F.replace(path, F.lit("\\"), F.lit("/"))), lambda p: p != "")
    first = F.try_element_at(segments, F.lit(1))
    two = (F.size(segments) >= 2) & F.lower(first).isin(*ROOT_DIRS)
    return F.lower(F.when(two, F.array_join(F.slice(segments, 1, 2), "/")).otherwise(F.coalesce(first, kind)))


def slug(value: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("application"))


def domain(path: Column, role: str) -> Column:
    """What a file is about: its name's words without those of its role, else its deepest telling folder."""
    removable = [role, *REMOVABLE]
    camel = F.lower(F.regexp_replace(stem(path), "([a-z0-9])([A-Z])", "$1_$2"))
    words = F.filter(F.split(camel, r"[_\-.]+"), lambda w: ~w.isin(*removable))
    segments = F.slice(parts(path), 1, F.greatest(F.size(parts(path)) - 1, F.lit(0)))
    folders = F.filter(F.transform(segments, F.lower), lambda w: ~w.isin(*removable, *PLAIN_DIRS))
    first = F.try_element_at(words, F.lit(1))
    return F.when(first.isNotNull() & ~first.isin(*PLAIN_STEMS), slug(F.array_join(words, "-"))).otherwise(
        slug(F.coalesce(F.try_element_at(folders, F.lit(-1)), F.lit("application")))
    )


def endpoint_domain(route: Column, path: Column) -> Column:
    segments = F.filter(F.transform(F.split(route, "/"), F.lower), lambda p: (p != "") & ~p.startswith("{") & ~p.isin("api", "v1", "v2", "v3"))
    value = F.when(F.size(segments) > 1, segments[0]).otherwise(domain(path, "api"))
    return F.when(value.isin(*OPERATIONAL), "operational").otherwise(slug(value))


def display_domain(value: Column) -> Column:
    return cases([(value == k, v) for k, v in DOMAIN_NAMES.items()], F.initcap(F.regexp_replace(value, "[_-]", " ")))


def important_rank(path: Column) -> Column:
    """0 to 4 for files to read first, null for others."""
    low, last = F.lower(path), F.lower(name(path))
    rooted = F.concat(F.lit("/"), low)
    ends = any_of([last.endswith(x) for x in ("_service.py", "service.ts", "service.tsx")])
    return cases(
        [
            (last.startswith("readme"), 0),
            (last.isin("main.py", "app.py", "main.ts", "main.tsx", "index.ts", "index.tsx"), 1),
            (low.contains("router") | low.contains("routes"), 2),
            (rooted.contains("/services/") | ends, 3),
            (any_of([rooted.contains(x) for x in ("/repositories/", "/models/", "/schemas/")]), 4),
        ],
        F.lit(None).cast("int"),
    )


def important_reason(rank: Column) -> Column:
    names = ["Project overview and setup", "Application entrypoint candidate", "API boundary", "Application service", "Data or schema boundary"]
    return cases([(rank == k, v) for k, v in enumerate(names)], F.lit(None).cast("string"))


def file_role(path: Column, lang: Column) -> Column:
    last, low = F.lower(name(path)), F.lower(path)
    return cases(
        [
            (last.startswith("readme"), "Documentation"),
            (last.isin("main.py", "app.py", "server.py"), "Entrypoint"),
            (low.contains("route") | low.contains("controller"), "API routing"),
        ],
        F.concat(F.initcap(lang), F.lit(" file")),
    )


def folder_role(path: Column) -> Column:
    low = F.lower(path)
    return cases(
        [
            (low.contains("frontend") | low.startswith("apps/web"), "Frontend area"),
            (low.contains("backend") | low.contains("service"), "Backend service"),
            (low.contains("test"), "Tests"),
            (low.contains("doc"), "Documentation"),
        ],
        "Project area",
    )


def relative_path_error(path: Column) -> Column:
    """Why a path is no plain relative path, null where it is one."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return cases(
        [
            (empty(p) == "", "empty"),
            (p.startswith("/") | p.rlike("^[A-Za-z]:"), "absolute"),
            (p.rlike(r"[\x00-\x1f\x7f]"), "control_character"),
            (p.rlike(r"(^|/)\.{1,2}(/|$)"), "traversal"),
            (F.size(parts(p)) > 30, "too_deep"),
        ],
        F.lit(None).cast("string"),
    )


def is_test_path(path: Column) -> Column:
    low = F.lower(F.replace(empty(path), F.lit("\\"), F.lit("/")))
    return low.startswith("tests/") | low.contains("/tests/") | name(low).startswith("test_")


# --- git sources ----------------------------------------------------------------------------------

# Shapes of owners and repositories, and what a reference may not hold.
GIT_OWNER = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?"
GIT_REPOSITORY = r"[A-Za-z0-9_.-]{1,100}"
REF_FORBIDDEN = ("..", "@{", "\\", " ", "~", "^", ":", "?", "*", "[", "//")


def git_source(url: Column) -> Column:
    """``owner/repository`` of a public HTTPS address of the supported host; null for any other, and with user, port, query or fragment."""
    plain = F.trim(url)
    owner = F.regexp_extract(plain, rf"^(?i:https://(?:www\.)?github\.com)/+({GIT_OWNER})/+({GIT_REPOSITORY})/*$", 1)
    name = F.regexp_replace(F.regexp_extract(plain, rf"^(?i:https://(?:www\.)?github\.com)/+({GIT_OWNER})/+({GIT_REPOSITORY})/*$", 2), r"\.git$", "")
    return F.when((owner != "") & ~name.isin("", ".", ".."), F.concat_ws("/", owner, name))


def git_ref_valid(ref: Column) -> Column:
    """Whether a branch or tag name is sound; null, for the default branch, is."""
    c = F.trim(ref)
    bad = (c == "") | (F.length(c) > 255) | c.rlike(r"^[-./]") | c.rlike(r"(?:\.|/|\.lock)$") | c.rlike(r"[\x00-\x1f\x7f]")
    for token in REF_FORBIDDEN:
        bad = bad | c.contains(token)
    return F.coalesce(~bad, F.lit(True))
