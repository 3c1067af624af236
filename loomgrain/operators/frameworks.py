"""Web frameworks as a table of patterns: routes, places where input enters, how to tell which framework a project uses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Framework:
    """``routes`` has the method as group 1 and the path as group 2 (or none: the file's path is the route); ``points`` name the value as group 1."""

    name: str
    packages: tuple[str, ...]
    routes: str
    points: tuple[tuple[str, str], ...]
    bodies: tuple[str, ...] = ()
    auth: str = "bearer"
    start: str = "npm run dev"
    prefix: str | None = None


Q = r"""\s*\(\s*['"`]"""
# What marks routes and inputs of each framework. Projects are told apart in this order.
FRAMEWORKS = [
    Framework("nextjs", ("next",), r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b()", (("body", r"req\.body\.(\w+)"), ("query", r"req\.query\.(\w+)"), ("query", r"""searchParams\.get\(['"](\w+)['"]"""), ("path", r"\bparams\.(\w+)")), ("request.json()", "req.json()"), start="npx next dev"),
    Framework("remix", ("@remix-run/node", "@remix-run/react"), r"export\s+(?:async\s+)?function\s+(loader|action)\b()", (("query", r"""searchParams\.get\(['"](\w+)['"]"""), ("path", r"\bparams\.(\w+)"), ("form", r"""formData\.get\(['"](\w+)['"]""")), ("request.json()", "request.formData()"), auth="cookie", start="npx remix dev"),
    Framework("sveltekit", ("@sveltejs/kit",), r"export\s+(?:const|async\s+function)\s+(GET|POST|PUT|DELETE|PATCH)\b()", (("query", r"""url\.searchParams\.get\(['"](\w+)['"]"""), ("path", r"\bparams\.(\w+)")), ("request.json()",), auth="cookie"),
    Framework("astro", ("astro",), r"\b(?:app|router|server)\.(get|post|put|delete|patch|all)" + Q + r"([^'\"`]+)", (("body", r"req\.body\.(\w+)"), ("query", r"req\.query\.(\w+)"), ("path", r"req\.params\.(\w+)"))),
    Framework("nestjs", ("@nestjs/core",), r"@(Get|Post|Put|Delete|Patch)\s*\(\s*['\"`]?([^'\"`)]*)", (("path", r"""@Param\(['"](\w+)['"]"""), ("query", r"""@Query\(['"](\w+)['"]"""), ("header", r"""@Headers\(['"](\w+)['"]"""), ("body", r"\bbody\.(\w+)")), ("@Body()",), prefix=r"@Controller\s*\(\s*['\"`]?([^'\"`)]*)"),
    Framework("fastify", ("fastify",), r"\b(?:fastify|server|app)\.(get|post|put|delete|patch)" + Q + r"([^'\"`]+)", (("body", r"request\.body\.(\w+)"), ("query", r"request\.query\.(\w+)"), ("path", r"request\.params\.(\w+)"), ("header", r"request\.headers\.(\w+)")), ("request.body",)),
    Framework("hono", ("hono",), r"\b(?:app|router)\.(get|post|put|delete|patch)" + Q + r"([^'\"`]+)", (("path", r"""c\.req\.param\(['"](\w+)['"]"""), ("query", r"""c\.req\.query\(['"](\w+)['"]"""), ("header", r"""c\.req\.header\(['"]([^'"]+)['"]""")), ("c.req.json()", "c.req.parseBody()")),
    Framework("express", ("express", "@trpc/server"), r"\b(?:app|router|server)\.(get|post|put|delete|patch|all)" + Q + r"([^'\"`]+)", (("body", r"req\.body\.(\w+)"), ("query", r"req\.query\.(\w+)"), ("path", r"req\.params\.(\w+)"), ("header", r"""req\.headers\[?\.?['"]?(\w[\w-]*)"""), ("cookie", r"req\.cookies\.(\w+)")), ("req.body",)),
]
METHODS = {"loader": "GET", "action": "POST", "all": "ANY"}


def detect(dependencies: DataFrame) -> DataFrame:
    """``(project, framework)`` from ``dependencies(project, package)``: the first framework one of whose packages is there, else express."""
    rank = F.lit(len(FRAMEWORKS))
    for i, f in reversed(list(enumerate(FRAMEWORKS))):
        rank = F.when(F.col("package").isin(*f.packages), i).otherwise(rank)
    best = dependencies.groupBy("project").agg(F.min(rank).alias("r"))
    name = F.try_element_at(F.array(*[F.lit(f.name) for f in FRAMEWORKS]), F.col("r") + 1)
    return best.select("project", F.coalesce(name, F.lit("express")).alias("framework"))


def _matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern of two groups, as structs."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("method"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("path"))


def framework_routes(files: DataFrame) -> DataFrame:
    """``(file_id, framework, method, route)`` of ``files(file_id, file_path, content, framework)``; file-based routes are the folders of the path."""
    parts = []
    for f in FRAMEWORKS:
        rows = files.where(F.col("framework") == f.name).select("file_id", "file_path", F.col("content"), F.explode(_matches(F.coalesce("content", F.lit("")), f.routes)).alias("m"))
        folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.coalesce("file_path", F.lit("")), r"^.*?(?:app|pages|routes)/", ""), r"/?(?:route|page|index|\+server)?\.\w+$", ""))
        own = F.concat(F.lit("/"), F.regexp_replace(F.col("m.path"), r"^/", "")) if f.name not in ("nextjs", "remix", "sveltekit") else folder
        if f.prefix:
            base = F.regexp_replace(F.regexp_extract(F.coalesce("content", F.lit("")), f.prefix, 1), r"^/|/$", "")
            own = F.when(base != "", F.concat(F.lit("/"), base, F.when(own != "/", own).otherwise(""))).otherwise(own)
        method = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in METHODS.items() for x in (F.lit(k), F.lit(v))]), F.col("m.method")), F.upper("m.method"))
        parts.append(rows.select("file_id", F.lit(f.name).alias("framework"), method.alias("method"), own.alias("route")))
    return reduce(DataFrame.unionByName, parts).distinct()


def injection_points(functions: DataFrame) -> DataFrame:
    """``(fn_id, location, name)``: where input enters the bodies of ``functions(fn_id, framework, body)``; a body read as a whole has no name."""
    parts = []
    for f in FRAMEWORKS:
        rows = functions.where(F.col("framework") == f.name)
        for location, pattern in f.points:
            parts.append(rows.select("fn_id", F.lit(location).alias("location"), F.explode(F.regexp_extract_all("body", F.lit(pattern), 1)).alias("name")))
        if f.bodies:
            parts.append(rows.where(reduce(lambda a, b: a | b, [F.contains("body", F.lit(w)) for w in f.bodies])).select("fn_id", F.lit("body").alias("location"), F.lit(None).cast("string").alias("name")))
    return reduce(DataFrame.unionByName, parts).distinct()


def conventions(frameworks: DataFrame) -> DataFrame:
    """``(..., auth, start)`` beside a ``framework`` column: how requests authenticate and how the project is started."""
    auth, start = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in FRAMEWORKS:
        auth, start = F.when(F.col("framework") == f.name, f.auth).otherwise(auth), F.when(F.col("framework") == f.name, f.start).otherwise(start)
    return frameworks.withColumns({"auth": auth, "start": start})
