"""What a project says about itself: declared domains, path aliases, frameworks and stack."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.extract import imports
from tessella.sources.formats import requirements

#: Packages and the label each is told by.
PYTHON_STACK = {
    "fastapi": "FastAPI", "django": "Django", "flask": "Flask", "sqlalchemy": "SQLAlchemy", "boto3": "AWS", "openai": "OpenAI", "anthropic": "Claude API", "google.generativeai": "Gemini",
    "google-generativeai": "Gemini", "redis": "Redis", "celery": "Celery", "pydantic": "Pydantic", "stripe": "Stripe",
}
SCRIPT_STACK = {
    "next": "Next.js", "express": "Express", "fastify": "Fastify", "react": "React", "@prisma/client": "Prisma", "prisma": "Prisma", "mongoose": "MongoDB", "sequelize": "Sequelize", "drizzle-orm": "Drizzle",
    "drizzle": "Drizzle", "redis": "Redis", "ioredis": "Redis", "openai": "OpenAI", "@anthropic-ai/sdk": "Claude API", "anthropic": "Claude API", "stripe": "Stripe", "firebase": "Firebase", "firebase-admin": "Firebase",
    "@supabase/supabase-js": "Supabase", "supabase": "Supabase", "@clerk/nextjs": "Clerk", "@clerk/clerk-sdk-node": "Clerk", "clerk": "Clerk", "next-auth": "NextAuth", "nextauth": "NextAuth",
}
#: Fixed values: (ecosystem, package, framework) in order of preference within a language.
FRAMEWORKS = (
    ("pypi", "fastapi", "fastapi"), ("pypi", "django", "django"), ("pypi", "flask", "flask"), ("npm", "next", "nextjs"), ("npm", "express", "express"), ("npm", "react", "react"),
    ("go", "github.com/gin-gonic/gin", "gin"), ("go", "github.com/labstack/echo", "echo"), ("go", "github.com/go-chi/chi", "chi"), ("go", "github.com/gofiber/fiber", "fiber"),
)
MOST_LABELS = 6


def read_config(text: str | None) -> dict[str, dict[str, list[str]]] | None:
    """Declared domains by upper-case name, each with ``keywords``, ``anchor`` and ``globs``; a bare list means keywords. Null if the text is no such configuration."""
    try:
        domains = json.loads(text or "")["domains"]
    except (ValueError, KeyError, TypeError):
        return None
    if not isinstance(domains, dict):
        return None
    strings = lambda value: [str(x) for x in value] if isinstance(value, list) else []
    out = {}
    for name, value in domains.items():
        if isinstance(value, (list, dict)):
            given = {"keywords": value} if isinstance(value, list) else value
            out[name.upper()] = {part: strings(given.get(part)) for part in ("keywords", "anchor", "globs")}
    return out


_COMMENT = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.S)


def read_jsonc(text: str | None) -> dict:
    """An object out of JSON with comments and commas before closing brackets; empty if it is none."""
    bare = re.sub(r",(\s*[}\]])", r"\1", _COMMENT.sub(lambda m: m[1] or "", text or ""))
    try:
        value = json.loads(bare)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def path_aliases(configs: Mapping[str, str], name: str) -> dict[str, str]:
    """``{prefix: folder}`` of the compiler configuration ``name`` among ``configs`` (path to text), with what it extends; its own entries win.

    A pattern ``@app/*`` for ``src/*`` gives ``@app/`` for ``src/``, relative to ``baseUrl``. Configurations that are missing or extend each other in a circle end the chain.
    """
    chain, seen = [], set()
    while name in configs and name not in seen:
        seen.add(name)
        chain.append((name, read_jsonc(configs[name])))
        parent = chain[-1][1].get("extends")
        if not isinstance(parent, str):
            break
        name = _joined(name.rpartition("/")[0], parent if parent.endswith(".json") else parent + ".json")
    out: dict[str, str] = {}
    base = "."
    for place, value in reversed(chain):
        options = value.get("compilerOptions") or {}
        folder = place.rpartition("/")[0]
        base = _joined(folder, options["baseUrl"]) if isinstance(options.get("baseUrl"), str) else base if base != "." else folder
        for pattern, targets in (options.get("paths") or {}).items():
            if targets:
                out[pattern.removesuffix("*")] = _joined(base, str(targets[0]).removesuffix("*")) + ("/" if pattern.endswith("/*") else "")
    return out


def _joined(folder: str, path: str) -> str:
    steps: list[str] = []
    for step in f"{folder}/{path}".split("/"):
        if step == "..":
            steps = steps[:-1]
        elif step not in ("", "."):
            steps.append(step)
    return "/".join(steps)


def workspace_packages(contents: DataFrame) -> DataFrame:
    """``name, folder`` of the packages that manifests below the root declare."""
    rows = contents.where(F.col("file").rlike("(^|/)package\\.json$"))
    return rows.select(F.get_json_object("content", "$.name").alias("name"), F.regexp_replace("file", "/?package\\.json$", "").alias("folder")).where("name is not null")


def stack(contents: DataFrame) -> DataFrame:
    """``label`` of the known packages that manifests declare and sources import, in order, at most six."""
    parts = []
    for ecosystem, labels, suffix in (("pypi", PYTHON_STACK, r"\.py$"), ("npm", SCRIPT_STACK, r"\.[mc]?[jt]sx?$")):
        told = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        target = F.col("target")
        package = F.when(target.startswith("@"), F.substring_index(target, "/", 2)).otherwise(F.substring_index(target, "/", 1)) if ecosystem == "npm" else target
        parts.append(requirements(contents).where(F.col("ecosystem") == ecosystem).select(told[F.lower("name")].alias("label")))
        used = imports(contents.where(F.col("file").rlike(suffix)))
        parts.append(used.select(F.coalesce(told[package], told[F.substring_index(target, ".", 1)]).alias("label")))
    return reduce(DataFrame.unionByName, parts).where("label is not null").distinct().orderBy("label").limit(MOST_LABELS)


def framework(contents: DataFrame) -> DataFrame:
    """``language, framework, confidence`` per language of the manifests: the most preferred package declared for use; one that only development needs gives ``low``, and never ``react``.

    A script project is TypeScript if it has more TypeScript than JavaScript sources, declarations left out. A manifest without a known package gives the language's ``generic`` at low confidence.
    """
    found = requirements(contents)
    names = F.get_json_object("content", "$.devDependencies")
    dev = contents.where(F.col("file").rlike("package\\.json$")).select("file", F.explode(F.map_keys(F.from_json(names, "map<string,string>"))).alias("name"), F.lit(True).alias("dev"))
    rated = found.join(dev, ["file", "name"], "left").withColumn("dev", F.coalesce("dev", F.lit(False)))
    order = F.create_map(*[F.lit(x) for i, (e, n, _) in enumerate(FRAMEWORKS) for x in (f"{e}:{n}", i)])
    label = F.create_map(*[F.lit(x) for e, n, f in FRAMEWORKS for x in (f"{e}:{n}", f)])
    key = F.concat_ws(":", "ecosystem", F.when(F.col("ecosystem") == "go", F.regexp_replace("name", r"/v\d+$", "")).otherwise(F.lower("name")))
    ranked = rated.withColumn("rank", order[key]).withColumn("framework", label[key])
    usable = F.col("rank").isNotNull() & ~(F.col("dev") & (F.col("framework") == "react"))
    best = ranked.groupBy("ecosystem").agg(F.min_by(F.struct("framework", "dev"), F.when(usable, F.col("rank") + F.when(F.col("dev"), 100).otherwise(0))).alias("b"))
    base = F.lower("file")
    ends = lambda pattern: F.count(F.when(base.rlike(pattern) & ~base.rlike(r"\.d\.ts$"), 1))
    sizes = contents.agg(ends(r"\.tsx?$").alias("ts"), ends(r"\.[mc]?jsx?$").alias("js"))
    script = F.when(F.col("ts") > F.col("js"), "typescript").otherwise("javascript")
    language = F.when(F.col("ecosystem") == "pypi", "python").when(F.col("ecosystem") == "go", "go").when(F.col("ecosystem") == "npm", script)
    return best.join(F.broadcast(sizes), F.lit(True)).select(
        language.alias("language"), F.coalesce("b.framework", F.lit("generic")).alias("framework"), F.when(F.col("b.framework").isNull() | F.col("b.dev"), "low").otherwise("high").alias("confidence")
    ).where("language is not null")
