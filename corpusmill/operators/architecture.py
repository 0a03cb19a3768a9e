"""Architecture of a corpus from file paths and contents: roles, components, technologies, relations, flows, style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import paths as P
from corpusmill.functions.text import any_of, cases
from corpusmill.operators.flow import walks

# Fixed values from here on.
LAYERS = "entrypoint presentation api application domain data_access messaging integration".split()
#: Role: kind, layer, path parts, name endings, source markers, languages, base score.
ROLES = {
    "presentation": ("presentation", "presentation", "/frontend/ /client/ /components/ /pages/ /views/ /screens/".split(), [], ["react", "@component", "vue", "svelte"], ["typescript", "javascript", "html"], 20),
    "api": ("api", "api", "/routes/ /routers/ /controllers/ /endpoints/ /handlers/".split(), ["controller.java", "controller.kt", "controller.cs"], ["@restcontroller", "@controller", "[apicontroller]", "router.", "app.route", "gin.context", "http.handler"], [], 30),
    "application": ("application", "application", "/services/ /usecases/ /use_cases/ /application/".split(), "service.py service.ts service.java service.kt service.cs service.go handler.cs".split(), ["@service", "@injectable", "irequesthandler", "mediatr"], [], 25),
    "domain": ("domain", "domain", "/domain/ /entities/ /aggregates/ /valueobjects/ /value_objects/".split(), ["entity.java", "entity.cs"], ["@entity", "aggregate root", "valueobject"], [], 25),
    "data_access": ("data_access", "data_access", "/repositories/ /repository/ /persistence/ /storage/ /dao/".split(), "repository.py repository.ts repository.java repository.kt repository.cs repository.go store.go".split(), ["jparepository", "dbcontext", "sqlalchemy", "prisma", "mongoose", "gorm.", "database/sql", ".commit("], [], 30),
    "data_model": ("data_access", "data_access", "/models/ /schemas/ /entities/".split(), [], ["@entity", "basemodel", "db.model", "models.model", "dbset<"], [], 15),
    "messaging": ("messaging", "messaging", "/consumers/ /producers/ /events/ /workers/ /jobs/".split(), [], ["@kafkalistener", "kafka", "nats", "rabbitmq", "celery.task", "@task", "backgroundservice"], [], 35),
    "external_adapter": ("external_adapter", "integration", "/clients/ /integrations/ /adapters/ /providers/".split(), "client.py client.ts client.java client.cs client.go".split(), ["httpclient", "webclient", "requests.", "httpx.", "axios.", "fetch(", "openai", "generativeai"], [], 20),
    "entrypoint": ("entrypoint", "entrypoint", [], "main.py main.go main.rs lib.rs index.ts index.js program.cs application.java application.kt manage.py".split(), ["if __name__", "static void main", "func main()", "webapplication.createbuilder"], [], 40),
}
#: Technology: category, markers.
TECHNOLOGIES = {
    "postgresql": ("database", ["postgresql", "postgres://", "psycopg", "asyncpg", "npgsql"]),
    "mysql": ("database", ["mysql", "pymysql", "mysqlconnector"]),
    "mongodb": ("database", ["mongodb", "mongoose", "pymongo"]),
    "redis": ("cache", ["redis", "stackexchange.redis"]),
    "qdrant": ("vector_store", ["qdrant"]),
    "kafka": ("message_broker", ["kafka", "@kafkalistener"]),
    "rabbitmq": ("message_broker", ["rabbitmq", "amqp", "masstransit"]),
    "object_storage": ("object_store", ["boto3", "minio", "s3client", "blobserviceclient"]),
    "openai": ("external_api", ["openai"]),
    "gemini": ("external_api", ["generativeai", "google.genai", "gemini"]),
}
FRAMEWORKS = {
    "React": ["react", ".tsx", ".jsx"], "Next.js": ["next", "next.config"], "NestJS": ["@nestjs/", "@controller("], "Express": ["express", "express.router"],
    "FastAPI": ["fastapi", "apirouter"], "Django": ["django", "models.model"], "Flask": ["flask", "@app.route", "blueprint("],
    "Spring Boot": ["spring-boot", "@restcontroller", "@springbootapplication"], "ASP.NET Core": ["[apicontroller]", "webapplication.createbuilder", "controllerbase"],
    "Go HTTP": ["net/http", "gin-gonic", "go-chi", "labstack/echo", "gofiber"],
}
OWNER_ROLES = {"database": "data_access", "cache": "data_access", "vector_store": "data_access", "message_broker": "messaging", "external_api": "external_adapter", "object_store": "data_access"}
CONVENTIONS = (("api", "application", "calls"), ("application", "domain", "uses"), ("application", "data_access", "reads / writes"), ("domain", "data_access", "uses"))
RELATION_LABELS = {
    "calls_api": "HTTP / JSON", "exposes_endpoint": "routes to", "calls": "calls", "imports": "imports", "depends_on": "depends on", "reads": "reads from",
    "writes": "writes to", "implements": "implements", "publishes": "publishes", "consumes": "consumes",
}
MOST = {"components": 28, "relations": 40, "flows": 3, "technologies": 12, "unknowns": 8}


def layer_order(layer: Column) -> Column:
    return cases([(layer == x, k) for k, x in enumerate(LAYERS)], 9)


def role_scores(files: DataFrame) -> DataFrame:
    """(path, role, kind, layer, domain, score): the best role of each file (path, language, content) that has any sign of one.

    A role's base score, 35 for its folders, 30 for its name endings, 40 for its first source
    marker. Ties go to the earlier layer, then by name.
    """
    path, last, body = F.lower(F.concat(F.lit("/"), "path")), F.lower(P.name(F.col("path"))), F.lower(F.coalesce("content", F.lit("")))
    options = []
    for role, (kind, layer, parts, ends, marks, langs, base) in ROLES.items():
        a, b, c = any_of([path.contains(x) for x in parts]), any_of([last.endswith(x) for x in ends]), any_of([body.contains(x) for x in marks])
        fits = (a | b | c) & (F.col("language").isin(*langs) if langs else F.lit(True))
        score = base + F.when(a, 35).otherwise(0) + F.when(b, 30).otherwise(0) + F.when(c, 40).otherwise(0)
        options.append(F.when(fits, F.struct((-score).alias("neg"), F.lit(LAYERS.index(layer)).alias("at"), F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.lit(layer).alias("layer"), P.domain(F.col("path"), role).alias("domain"))))
    best = files.select("path", F.array_min(F.array_compact(F.array(*options))).alias("b")).filter("b is not null")
    return best.select("path", "b.role", "b.kind", "b.layer", "b.domain", (-F.col("b.neg")).alias("score"))


def components(scores: DataFrame, most: int = 20) -> DataFrame:
    """(role, domain, kind, layer, files, score): files of one role and domain, in layer order."""
    rows = scores.groupBy("role", "domain").agg(F.first("kind").alias("kind"), F.first("layer").alias("layer"), F.count("*").alias("files"), F.sum("score").alias("score"))
    return rows.orderBy(layer_order(F.col("layer")), "domain", "role").limit(most)


def technologies(files: DataFrame, most: int = 8) -> DataFrame:
    """(technology, category, n, paths): files that hold a marker in path or content; the first ``most`` paths by name."""
    body, path = F.lower(F.coalesce("content", F.lit(""))), F.lower("path")
    found = F.array_compact(F.array(*[F.when(any_of([body.contains(m) | path.contains(m) for m in marks]), F.struct(F.lit(k).alias("technology"), F.lit(cat).alias("category"))) for k, (cat, marks) in TECHNOLOGIES.items()]))
    rows = files.select("path", F.explode(found).alias("t")).select("path", "t.technology", "t.category").distinct()
    n = F.row_number().over(Window.partitionBy("technology").orderBy("path"))
    rows = rows.withColumn("_n", n)
    return rows.groupBy("technology", "category").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col("path")))), ",").alias("paths")
    )


def frameworks(files: DataFrame) -> DataFrame:
    """(framework) with a marker in any path or content."""
    body, path = F.lower(F.coalesce("content", F.lit(""))), F.lower("path")
    found = F.array_compact(F.array(*[F.when(any_of([body.contains(m) | path.contains(m) for m in marks]), F.lit(k)) for k, marks in FRAMEWORKS.items()]))
    return files.select(F.explode(found).alias("framework")).distinct()


def ownership(scores: DataFrame) -> DataFrame:
    """(path, component): the component ``kind:domain`` of each file."""
    return scores.select("path", F.concat_ws(":", "kind", "domain").alias("component"))


def relations(edges: DataFrame, nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """(source, target, label, support, n): graph edges between files of different components; confirmed if any is sure enough."""
    at = nodes.filter("file_path is not null").select("id", F.col("file_path").alias("path")).join(owners, "path").select("id", "component")
    rows = edges.filter(~F.lower("type").isin("contains", "defined_in"))
    rows = rows.join(at.select(F.col("id").alias("source"), F.col("component").alias("s")), "source").join(at.select(F.col("id").alias("target"), F.col("component").alias("t")), "target").filter("s <> t")
    label = cases([(F.lower("type") == k, v) for k, v in RELATION_LABELS.items()], F.lower(F.replace(F.col("type"), F.lit("_"), F.lit(" "))))
    sure = (F.col("evidence_level") != "inferred") & (F.col("confidence") >= 0.75)
    return rows.groupBy(F.col("s").alias("source"), F.col("t").alias("target"), label.alias("label")).agg(F.when(F.bool_or(sure), "confirmed").otherwise("inferred").alias("support"), F.count("*").alias("n"))


def technology_owner(tech_files: DataFrame, scores: DataFrame) -> DataFrame:
    """(technology, component): of the components with a marked file one of the kind that goes with its category, else the first; null without any.

    tech_files: technology, category, path.
    """
    preferred = F.create_map(*[F.lit(x) for kv in OWNER_ROLES.items() for x in kv])[F.col("category")]
    fit = scores.filter(~F.col("kind").isin("presentation", "api"))
    rows = tech_files.join(fit, "path", "left")
    order = F.struct(F.col("kind") != preferred, layer_order(F.col("layer")), "domain", "role")
    return rows.groupBy("technology").agg(F.min_by(F.concat_ws(":", "kind", "domain"), F.when(F.col("kind").isNotNull(), order)).alias("component"))


def convention_relations(parts: DataFrame) -> DataFrame:
    """(source, target, label) by layering: a component and the one of its domain in the next layer, else the only one there."""
    rows = parts.select("kind", "domain").distinct()
    single = rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("domain").alias("only"))
    out = None
    for a, b, label in CONVENTIONS:
        source = rows.filter((F.col("kind") == a) & (F.col("domain") != "operational"))
        same = rows.filter(F.col("kind") == b).select(F.col("domain").alias("d"))
        lone = single.filter((F.col("kind") == b) & (F.col("n") == 1)).select("only")
        found = source.join(same, F.col("domain") == F.col("d"), "left").join(F.broadcast(lone), F.lit(True), "left").withColumn("t", F.coalesce("d", "only")).filter("t is not null")
        some = found.select(F.concat(F.lit(a + ":"), "domain").alias("source"), F.concat(F.lit(b + ":"), "t").alias("target"), F.lit(label).alias("label"))
        out = some if out is None else out.union(some)
    return out


def flows(starts: DataFrame, links: DataFrame, most: int = 6) -> DataFrame:
    """(start, step, node, support): the walk from each component along its best relations: confirmed first, by layer, by name."""
    sure, layer = F.col("support") != "confirmed", layer_order(F.substring_index("target", ":", 1))
    return walks(starts, links, [sure, layer], most, ("presentation:web", "container:backend"))


def style(parts: DataFrame, files: DataFrame, tech: DataFrame) -> DataFrame:
    """One row (style) by ordered rules over kinds, domains, paths and contents."""
    kinds = parts.agg(
        *[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(k) for k in ("messaging", "presentation", "api", "application")],
        F.count_distinct(F.when((F.col("kind") == "api") & (F.col("domain") != "operational"), F.col("domain"))).alias("domains"),
    )
    path, last, body = F.lower(F.concat(F.lit("/"), "path")), F.lower(P.name(F.col("path"))), F.lower(F.coalesce("content", F.lit("")))
    seen = files.agg(
        *[F.coalesce(F.bool_or(path.contains(f"/{d}/")), F.lit(False)).alias(d) for d in ("views", "controllers", "models")],
        F.coalesce(F.bool_or(any_of([body.contains(m) for m in ("argparse", "click.command", "commander", "cobra.command", "system.commandline")])), F.lit(False)).alias("cli"),
        F.coalesce(F.bool_or(last.isin("lib.rs", "setup.py", "pyproject.toml", "package.json", "go.mod", "pom.xml")), F.lit(False)).alias("package"),
    )
    broker = tech.agg(F.coalesce(F.bool_or(F.col("category") == "message_broker"), F.lit(False)).alias("broker"))
    c = F.col
    rule = cases(
        [
            (c("messaging") & c("broker"), "event_driven"), (c("presentation") & c("api"), "layered_web"), (c("views") & c("controllers") & c("models"), "mvc"),
            (c("api") & (c("domains") >= 3) & c("application"), "modular"), (c("api"), "backend_api"), (c("cli"), "cli"), (c("package"), "library"),
        ],
        "package_map",
    )
    return kinds.crossJoin(seen).crossJoin(broker).select(rule.alias("style"))
