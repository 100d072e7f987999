"""Facts out of source texts: routes, models, functions, environment names, tables and imports, by patterns per language.

All patterns run in the JVM over ``file, content``; a text may be of any size and a file without a match gives no row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.tree import language_of

_JS = ("javascript", "typescript")
_Q = r"[`'\"]"

#: A member of a procedure router: its name, a builder called some procedure, the builder's steps with their arguments, and the step that ends it.
_STEP = r"\s*+\.\s*+(?!(?:query|mutation|subscription)\b)\w++\s*+\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_PROCEDURE = r"(\w+)\s*:\s*(?:\w+\.)*\w*[pP]rocedure\b(?:" + _STEP.replace("{", "{{").replace("}", "}}") + r")*+\s*\.\s*{}\s*\("

#: Fixed values: (languages, framework, pattern, group of the method or the method itself, group of the path).
ROUTES = (
    (_JS, "express", rf"\b(?:app|router|server|api|route)\.(get|post|put|patch|delete|all)\s*\(\s*{_Q}(/[^`'\"\s]*){_Q}", 1, 2),
    (_JS, "nest", rf"@(Get|Post|Put|Patch|Delete|All)\(\s*{_Q}([^`'\"]*){_Q}", 1, 2),
    *[(_JS, f"trpc-{kind}", _PROCEDURE.format(kind), method, 1) for kind, method in (("query", "GET"), ("mutation", "POST"), ("subscription", "SUBSCRIBE"))],
    (_JS, "react-router", r"<Route\b[^>]*\bpath=\{?[\"'](/[^\"']*)[\"']", "NAV", 1),
    (("python",), "decorator", r"@\w+\.(get|post|put|patch|delete)\(\s*[\"'](/[^\"']*)[\"']", 1, 2),
    (("python",), "flask", r"@\w+\.route\(\s*[\"'](/[^\"']*)[\"'](?![^)\n]*methods)", "GET", 1),
    (("python",), "flask", r"@\w+\.route\(\s*[\"']/[^\"']*[\"'][^)\n]*methods\s*=\s*\[\s*[\"'](\w+)[\"']", 1, 0),
    (("python",), "django", r"\bpath\(\s*[\"']([^\"']*)[\"']\s*,", "GET", 1),
    (("go",), "gin", r"\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*\"(/[^\"]*)\"", 1, 2),
    (("go",), "net/http", r"\bHandle(?:Func)?\(\s*\"(/[^\"]*)\"", "ALL", 1),
    (("rust",), "actix", r"#\[(get|post|put|patch|delete)\(\s*\"([^\"]*)\"", 1, 2),
    (("rust",), "axum", r"\.route\(\s*\"(/[^\"]*)\"\s*,\s*(?:get|post|put|patch|delete)\b", "ALL", 1),
    (("java", "kotlin"), "spring", r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"", 1, 2),
    (("java",), "jax-rs", r"@Path\(\s*\"([^\"]*)\"\s*\)", "ALL", 1),
    (("kotlin",), "ktor", r"\b(get|post|put|patch|delete)\(\s*\"(/[^\"]*)\"\s*\)\s*\{", 1, 2),
    (("csharp",), "attribute", r"\[Http(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\"", 1, 2),
    (("csharp",), "minimal", r"\.Map(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\"", 1, 2),
    (("ruby",), "rails", r"(?m)^\s*(get|post|put|patch|delete)\s+[\"'](/?[^\"']*)[\"']", 1, 2),
    (("php",), "laravel", r"Route::(get|post|put|patch|delete|any)\(\s*[\"']([^\"']*)[\"']", 1, 2),
    (("php",), "symfony", r"(?:#\[|@)Route\(\s*[\"']([^\"']*)[\"']", "ALL", 1),
    (("swift",), "vapor", r"\b(?:app|routes)\.(get|post|put|patch|delete)\(\s*\"([^\"]*)\"", 1, 2),
    (("dart",), "shelf", r"\brouter\.(get|post|put|patch|delete)\(\s*'([^']*)'", 1, 2),
    (("r",), "plumber", r"#\*\s*@(get|post|put|patch|delete)\s+(/\S*)", 1, 2),
)

#: Fixed values: (languages, kind, pattern, group of the name).
MODELS = (
    (("python",), "pydantic", r"(?m)^class\s+(\w+)\((?:[\w.]+,\s*)*(?:\w+\.)?BaseModel\b", 1),
    (("python",), "django", r"(?m)^class\s+(\w+)\((?:\w+\.)?models\.Model\b|(?m)^class\s+(\w+)\(models\.Model\)", 1),
    (("python",), "sqlalchemy", r"(?m)^class\s+(\w+)\((?:[\w.]+,\s*)*(?:\w+\.)?(?:Base|DeclarativeBase)\)", 1),
    (_JS, "zod", r"\b(?:const|let)\s+(\w+)\s*=\s*z\.object\(", 1),
    (_JS, "drizzle", r"\bconst\s+(\w+)\s*=\s*(?:pg|mysql|sqlite)Table\(", 1),
    (("typescript",), "interface", r"\binterface\s+(\w+)", 1),
    (("typescript",), "type", r"\btype\s+(\w+)\s*=\s*\{", 1),
    (("go",), "struct", r"(?m)^type\s+(\w+)\s+struct\b", 1),
    (("rust",), "struct", r"\bstruct\s+(\w+)", 1),
    (("java",), "entity", r"@Entity\b[\s\S]{0,200}?\bclass\s+(\w+)", 1),
    (("java", "csharp"), "record", r"\brecord\s+(\w+)\s*\(", 1),
    (("kotlin",), "data-class", r"\bdata\s+class\s+(\w+)", 1),
    (("csharp",), "class", r"\bpublic\s+(?:sealed\s+|partial\s+)*class\s+(\w+)", 1),
    (("ruby",), "active-record", r"(?m)^\s*class\s+(\w+)\s*<\s*(?:ApplicationRecord|ActiveRecord::Base)", 1),
    (("php",), "eloquent", r"\bclass\s+(\w+)\s+extends\s+(?:\w+\\)*Model\b", 1),
    (("swift",), "struct", r"\b(?:struct|final class|class)\s+(\w+)\s*:\s*[^{]*\b(?:Codable|Content|Model)\b", 1),
    (("dart",), "widget", r"\bclass\s+(\w+)\s+extends\s+State(?:less|ful)Widget", 1),
    (("cpp",), "struct", r"(?m)^\s*(?:struct|class)\s+(\w+)\s*(?::[^{;]*)?\{", 1),
    (("prisma",), "prisma", r"(?m)^model\s+(\w+)\s*\{", 1),
    (("r",), "class", r"\b(?:setClass|R6Class|new_class)\(\s*[\"'](\w+)[\"']", 1),
)
FUNCTIONS = (
    (("python",), "function", r"(?m)^(?:async\s+)?def\s+(\w+)", 1),
    (_JS, "function", r"\bfunction\s*\*?\s*(\w+)\s*\(", 1),
    (_JS, "arrow", r"\b(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", 1),
    (("go",), "function", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", 1),
    (("rust",), "function", r"\bfn\s+(\w+)", 1),
    (("kotlin",), "function", r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(", 1),
    (("swift",), "function", r"\bfunc\s+(\w+)", 1),
    (("ruby",), "function", r"(?m)^\s*def\s+(?:self\.)?(\w+[?!]?)", 1),
    (("php",), "function", r"\bfunction\s+(\w+)\s*\(", 1),
    (("r",), "function", r"(?m)^(\w[\w.]*)\s*(?:<-|=)\s*function\b", 1),
)
VARIABLES = (
    (_JS, "process.env", r"\bprocess\.env\.([A-Z_][A-Z0-9_]*)", 1),
    (_JS, "process.env", r"\bprocess\.env\[\s*['\"](\w+)['\"]", 1),
    (("python",), "os.environ", r"\bos\.(?:getenv\(|environ(?:\.get\(|\[))\s*['\"](\w+)['\"]", 1),
    (("go", "php", "cpp"), "getenv", r"\b[gG]etenv\(\s*['\"](\w+)['\"]", 1),
    (("rust",), "env", r"\benv(?:::var\(|!\()\s*\"(\w+)\"", 1),
    (("java", "kotlin"), "getenv", r"\bSystem\.getenv\(\s*\"(\w+)\"", 1),
    (("csharp",), "GetEnvironmentVariable", r"\bGetEnvironmentVariable\(\s*\"(\w+)\"", 1),
    (("ruby",), "ENV", r"\bENV(?:\.fetch\(|\[)\s*['\"](\w+)['\"]", 1),
    (("swift",), "environment", r"\benvironment\[\s*\"(\w+)\"", 1),
    (("dart",), "environment", r"\bPlatform\.environment\[\s*'(\w+)'", 1),
    (("r",), "Sys.getenv", r"\bSys\.getenv\(\s*[\"'](\w+)[\"']", 1),
)
TABLES = (
    (("python",), "tablename", r"__tablename__\s*=\s*['\"](\w+)['\"]", 1),
    (_JS, "table", r"\b(?:pg|mysql|sqlite)Table\(\s*['\"](\w+)['\"]", 1),
    (("prisma",), "map", r"@@map\(\s*\"(\w+)\"", 1),
    (("java", "kotlin"), "table", r"@Table\(\s*name\s*=\s*\"(\w+)\"", 1),
)
IMPORTS = (
    (_JS, "import", r"(?m)^\s*(?:import|export)\s[^'\";]*?\bfrom\s*['\"]([^'\"]+)['\"]", 1),
    (_JS, "import", r"(?m)^\s*import\s*['\"]([^'\"]+)['\"]", 1),
    (_JS, "require", r"\b(?:require|import)\(\s*['\"]([^'\"]+)['\"]\s*\)", 1),
    (("python",), "from", r"(?m)^\s*from\s+([.\w]+)\s+import\b", 1),
    (("python",), "import", r"(?m)^\s*import\s+([\w.]+)", 1),
    (("go",), "import", r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", 1),
    (("rust",), "use", r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", 1),
    (("rust",), "mod", r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;", 1),
    (("java", "kotlin"), "import", r"(?m)^import\s+(?:static\s+)?([\w.]+)", 1),
    (("ruby",), "require", r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", 1),
    (("cpp",), "include", r"(?m)^\s*#include\s+\"([^\"]+)\"", 1),
    (("csharp",), "using", r"(?m)^using\s+(?:static\s+)?([\w.]+)\s*;", 1),
    (("r",), "source", r"\bsource\(\s*[\"']([^\"']+)[\"']", 1),
)


def _typed(contents: DataFrame) -> DataFrame:
    return contents if "language" in contents.columns else contents.withColumn("language", language_of(F.col("file")))


def _named(contents: DataFrame, rules: tuple, name: str) -> DataFrame:
    rows = _typed(contents)
    parts = [rows.where(F.col("language").isin(*langs)).select("file", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(pattern), group)).alias(name)) for langs, kind, pattern, group in rules]
    return reduce(DataFrame.unionByName, parts).where(F.col(name) != "").distinct()


def routes(contents: DataFrame) -> DataFrame:
    """Distinct ``file, method, path, framework``."""
    rows = _typed(contents)
    parts = []
    for langs, framework, pattern, method, path in ROUTES:
        text = F.col("content")
        if path == 0:  # the whole match tells path and method
            whole = F.explode(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)).alias("w")
            part = rows.where(F.col("language").isin(*langs)).select("file", whole).select("file", F.upper(F.regexp_extract("w", pattern, 1)).alias("method"), F.regexp_extract("w", r"[\"'](/[^\"']*)[\"']", 1).alias("path"))
        else:
            paths = F.regexp_extract_all(text, F.lit(pattern), path)
            methods = F.regexp_extract_all(text, F.lit(pattern), method) if isinstance(method, int) else F.array_repeat(F.lit(method), F.size(paths))
            part = rows.where(F.col("language").isin(*langs)).select("file", F.explode(F.arrays_zip(methods.alias("m"), paths.alias("p"))).alias("x")).select("file", F.upper("x.m").alias("method"), F.col("x.p").alias("path"))
        parts.append(part.withColumn("path", F.when(F.lit(framework).startswith("trpc"), F.concat(F.lit("/trpc/"), "path")).otherwise(F.col("path"))).withColumn("framework", F.lit(framework)))
    return reduce(DataFrame.unionByName, parts).distinct()


def models(contents: DataFrame) -> DataFrame:
    return _named(contents, MODELS, "name")


def functions(contents: DataFrame) -> DataFrame:
    return _named(contents, FUNCTIONS, "name")


def variables(contents: DataFrame) -> DataFrame:
    return _named(contents, VARIABLES, "name")


def tables(contents: DataFrame) -> DataFrame:
    return _named(contents, TABLES, "name")


def imports(contents: DataFrame) -> DataFrame:
    return _named(contents, IMPORTS, "target")


#: What may follow an extensionless import, in order of preference.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".go", ".rs", ".rb", ".java", ".h", ".hpp", "/index.ts", "/index.tsx", "/index.js", "/__init__.py", "/mod.rs")


def normal_path(path: Column) -> Column:
    """A path with its ``.`` and ``..`` steps taken."""
    step = lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == ".") | (x == "") | (x == ".."), acc).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_imports(found: DataFrame, listing: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``file, target, resolved``: each import with the listed file it means, or null for packages and what is missing.

    Instead of asking whether files exist, each import becomes its ordered candidates, which meet the listing in one join; the first found counts.
    ``aliases`` maps a prefix of the target to a folder.
    """
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    t = F.col("target")
    base = F.when(t.startswith("."), F.concat_ws("/", folder, F.when(t.rlike(r"^\.+\w"), F.concat(F.regexp_replace(F.regexp_extract(t, r"^\.(\.*)", 1), r"\.", "../"), F.lit(""), F.translate(F.regexp_replace(t, r"^\.+", ""), ".", "/"))).otherwise(t)))
    python = F.translate(t, ".", "/")
    for prefix, place in (aliases or {}).items():
        base = F.coalesce(base, F.when(t.startswith(prefix), F.concat(F.lit(place), F.substring(t, len(prefix) + 1, 100_000))))
    starts = F.array_distinct(F.filter(F.array(normal_path(base), normal_path(F.concat_ws("/", folder, t)), F.when(~t.contains("/"), python), F.regexp_replace(t, r"^crate::|::", "/"), t), lambda x: x.isNotNull()))
    options = F.flatten(F.transform(starts, lambda s: F.transform(F.array(*[F.lit(e) for e in ENDINGS]), lambda e: F.concat(s, e))))
    tried = found.select("file", "target", F.posexplode(options).alias("at", "candidate"))
    hits = tried.join(listing.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("file", "target").agg(F.min_by("candidate", "at").alias("resolved"))
    return found.select("file", "target").distinct().join(hits, ["file", "target"], "left")


# ---- extension point -----------------------------------------------------------------------------------------------------------

Extractor = Callable[[str, str], list[dict]]
_EXTRACTORS: dict[str, Extractor] = {}


def register_extractor(extensions: str | tuple[str, ...], function: Extractor) -> None:
    """``function(content, file)`` returns rows of ``kind`` and ``name`` for files of the extensions; the first registration of an extension holds."""
    if not callable(function):
        raise TypeError("an extractor is a function of content and file")
    for e in (extensions,) if isinstance(extensions, str) else extensions:
        _EXTRACTORS.setdefault(e.lstrip(".").lower(), function)


def run_extractors(contents: DataFrame) -> DataFrame:
    """``file, kind, name, error`` of the registered extractors; a failing one gives its error and stops nothing."""
    known = dict(_EXTRACTORS)

    def run(batches):
        for batch in batches:
            out = []
            for file, content in zip(batch["file"], batch["content"]):
                function = known.get(file.rsplit(".", 1)[-1].lower()) if file and "." in file else None
                if function is None or content is None:
                    continue
                try:
                    out += [(file, str(r.get("kind")), str(r.get("name")), None) for r in function(content, file)]
                except Exception as e:  # noqa: BLE001
                    out.append((file, None, None, f"{type(e).__name__}: {e}"[:2000]))
            yield pd.DataFrame(out, columns=["file", "kind", "name", "error"])

    return contents.select("file", "content").mapInPandas(run, "file string, kind string, name string, error string")
