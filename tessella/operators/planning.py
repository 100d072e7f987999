"""From a wish in words to the places of a code base it concerns, and what is known about one file."""

from __future__ import annotations

import re
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.words import identifier_words
from tessella.operators.graph import reach
from tessella.operators.structure import top_per_group
from tessella.storage import materialize

#: Words of a wish that tell no place.
STOPWORDS = frozenset((
    "the", "and", "for", "with", "from", "into", "that", "this", "your", "you", "have", "will", "would", "should", "could", "can", "add", "fix", "make", "use", "using",
    "when", "then", "want", "need", "get", "set", "put", "let", "what", "how", "why", "who", "where", "these", "those", "some", "also", "only", "just",
    "every", "each", "any", "all", "they", "their", "them", "our", "its", "it", "to", "in", "on", "of", "as", "at", "is", "an", "be", "do", "if", "or", "no", "not", "but",
    "by", "via", "about", "around", "my", "me", "we", "us", "was", "were", "been", "so", "such", "than", "too", "very", "more", "most", "less", "least",
))
VERBS = frozenset(("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"))
MOST_TOKENS = 50
#: What a wish is made of: a path, or a word.
_PART = re.compile(r"(?P<path>/[\w{}:/-]+)|(?P<word>[^\W_]+)", re.ASCII)


def intent(text: str | None) -> dict[str, list[str]]:
    """``content``, ``verbs`` and ``paths`` of a wish: the telling words of two letters and more, those of the prose before those of its paths, its HTTP verbs and its route paths."""
    prose: dict[str, None] = {}
    paths: dict[str, None] = {}
    for part in _PART.finditer((text or "").lower()):
        (paths if part.lastgroup == "path" else prose)[part[0]] = None
    telling = (w for w in (*prose, *re.findall(r"[a-z0-9]+", " ".join(paths))) if len(w) > 1 and w not in STOPWORDS)
    return {"content": list(dict.fromkeys(telling))[:MOST_TOKENS], "verbs": [w.upper() for w in prose if w.upper() in VERBS], "paths": list(paths)}


def anchors(files: DataFrame, symbols: DataFrame, tokens: list[str], limit: int = 8, file_weight: float = 30.0, symbol_weight: float = 25.0) -> DataFrame:
    """``id, path, score, reasons``: the files whose path words or symbols the tokens name, rare words weighing more.

    A token's weight is its inverse document frequency over files, ``ln((N+1)/(df+1)) + 1``; a file counts each token once per kind of place. Ties by path.
    """
    words = files.where("path is not null").select("id", "path", F.array_distinct(identifier_words(F.col("path"))).alias("w"))
    hit = words.select("id", F.explode(F.array_intersect("w", F.array(*[F.lit(t) for t in tokens]).cast("array<string>"))).alias("token"), F.lit("path").alias("place"))
    named = symbols.select(F.col("file_id").alias("id"), F.explode(F.array_intersect(identifier_words(F.col("name")), F.array(*[F.lit(t) for t in tokens]).cast("array<string>"))).alias("token"), F.lit("symbol").alias("place")).distinct()
    n = files.count()
    df = hit.unionByName(named).groupBy("token").agg(F.count_distinct("id").alias("df"))
    weights = {r["token"]: r["df"] for r in df.collect()}
    if not weights:
        return files.limit(0).select("id", "path", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("reasons"))
    idf = F.create_map(*[x for t, d in weights.items() for x in (F.lit(t), F.log(F.lit((n + 1.0) / (d + 1))) + 1)])
    points = F.when(F.col("place") == "path", file_weight).otherwise(symbol_weight) * idf[F.col("token")]
    scored = hit.unionByName(named).groupBy("id").agg(F.round(F.sum(points), 4).alias("score"), F.array_sort(F.collect_set(F.concat_ws(":", "place", "token"))).alias("reasons"))
    return scored.join(files.select("id", "path"), "id").select("id", "path", "score", "reasons").orderBy(F.desc("score"), "path", "id").limit(limit)


#: Abbreviations of three letters that match the beginning of a longer word.
SHORT = (
    "sql", "jwt", "mcp", "csv", "ssl", "api", "env", "orm", "dns", "jpa", "tcp", "udp", "xml", "oop", "cli", "cdn", "aws", "gcp", "kms", "iam", "s3", "rpc", "dao", "dto",
)


def matches_word(token: str, words: Column) -> Column:
    """Whether a token is one of the words, or begins a longer one; only tokens of four letters and more, and known abbreviations, may begin one."""
    whole = F.array_contains(words, token)
    return whole | F.exists(words, lambda w: w.startswith(token) & (F.length(w) > len(token))) if len(token) >= 4 or token in SHORT else whole


def with_synonyms(tokens: list[str]) -> list[str]:
    """The tokens, and the words for throttling where both rate and limit are spoken of."""
    more = ("ratelimit", "throttle", "throttling") if "rate" in tokens and any(t.startswith("limit") for t in tokens) else ()
    return [*tokens, *(t for t in more if t not in tokens)]


def select_anchors(files: DataFrame, symbols: DataFrame, routes: DataFrame, wish: dict[str, list[str]], limit: int = 8) -> DataFrame:
    """``id, path, kind, score, reasons``: the files a wish concerns, each by its best reason, all reasons told.

    Routes that hold a named path score 100; without named paths, routes by their words, 60 a token's weight and 40 for each token beyond the first; files by the words of
    their path, 30 a weight, or 10 where the token only begins a word; symbols by the words of their name, 25 a weight; the three first files of a domain the
    wish names, 15. A verb in the wish excludes routes of other methods. A token's weight is ``ln((N + 1) / (df + 1)) + 1`` over files and symbols as documents, 1 for an unknown one.
    """
    tokens, verbs = wish["content"], wish["verbs"]
    known = files.where("path is not null").select("id", "path", "domain", identifier_words(F.col("path")).alias("w"))
    named = symbols.where("exported and name is not null").select(F.col("file_id").alias("id"), "name", identifier_words(F.col("name")).alias("w"))
    served = routes.where(F.col("method").isin(*verbs)) if verbs else routes
    asked = with_synonyms(tokens)
    counts = known.select("w").unionByName(named.select("w")).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.array_contains("w", t), 1)).alias(f"d{i}") for i, t in enumerate(asked)]).head()
    weight = {t: log((counts["n"] + 1) / (counts[f"d{i}"] + 1)) + 1 if counts[f"d{i}"] else 1.0 for i, t in enumerate(asked)}
    none = F.lit(0.0)
    plus = lambda parts: reduce(lambda x, y: x + y, parts, none)
    list_ = lambda tests: F.array_join(F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in tests]), lambda x: x.isNotNull()), ",") if tests else F.lit("")
    found = []

    def told(df: DataFrame, kind: str, score: Column, reason: Column) -> None:
        found.append(df.select("id", F.lit(kind).alias("kind"), F.round(score, 4).alias("score"), F.concat(F.lit(kind + ":"), reason).alias("reason")).where("score > 0"))

    if wish["paths"]:
        for p in wish["paths"]:
            told(served.where(F.lower("path").contains(p)).select(F.col("file").alias("id"), "path"), "route", F.lit(100.0), F.lit(p))
    elif tokens:
        rows = served.select(F.col("file").alias("id"), identifier_words(F.col("path")).alias("w"))
        tests = [(t, matches_word(t, F.col("w"))) for t in asked if len(t) >= 3]
        hits = plus([c.cast("int") for _, c in tests])
        told(rows, "route", plus([F.when(c, 60 * weight[t]).otherwise(0.0) for t, c in tests]) + 40 * F.greatest(hits - 1, none), list_(tests))
    whole = [(t, F.array_contains("w", t)) for t in tokens]
    begun = [(t, matches_word(t, F.col("w"))) for t in tokens]
    told(known, "file", plus([F.when(c, 30 * weight[t]).when(b, 10 * weight[t]).otherwise(0.0) for (t, c), (_, b) in zip(whole, begun)]), list_(begun))
    told(named, "symbol", plus([F.when(c, 25 * weight[t]).otherwise(0.0) for t, c in whole]), list_(whole))
    lower = F.lower("domain")
    spoken = reduce(lambda x, y: x | y, [lower.contains(t) | F.lit(t).contains(lower) for t in tokens], F.lit(False))
    told(top_per_group(known.where("domain is not null").where(spoken).select("id", "path", "domain"), ["domain"], [F.col("path"), F.col("id")], 3), "domain", F.lit(15.0), F.col("domain"))
    union = reduce(DataFrame.unionByName, found)
    best = union.groupBy("id").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return best.join(files.select("id", "path"), "id").select("id", "path", "kind", "score", "reasons").orderBy(F.desc("score"), "path", "id").limit(limit)


def plan_change(anchors: DataFrame, files: DataFrame, edges: DataFrame, most: int = 10, blast: int = 15, crossing: int = 8) -> DataFrame:
    """``role, path, detail`` of the files a change touches, from its anchors (:func:`select_anchors`).

    ``anchor`` with its confidence (high from half of the best score on), ``forward`` what they import and ``review`` what imports them (``most`` each), ``blast`` the nearest
    dependents of the five best within five hops, with the hop, ``domain`` the domains of all of them, and ``cross`` the neighbours in other domains. Ties by path.
    """
    held = materialize(anchors, "plan-anchors")
    top = held.agg(F.max("score")).head()[0]
    if top is None:
        return held.select(F.lit("").alias("role"), "path", F.lit("").alias("detail")).limit(0)
    named = files.select("id", "path", "domain")
    ids = held.select("id")
    part = lambda df, role, detail: df.select(F.lit(role).alias("role"), "path", detail.cast("string").alias("detail"))
    near = []
    for role, mine, other in (("forward", "src", "dst"), ("review", "dst", "src")):
        step = edges.where("src <> dst").select(F.col(mine).alias("id"), F.col(other).alias("other")).join(ids, "id", "left_semi")
        near.append((role, step))
    both = {role: step.select(F.col("other").alias("id")).distinct().join(named, "id") for role, step in near}
    hops = reach(edges, held.orderBy(F.desc("score"), "path", "id").limit(5).select("id")).join(ids, "id", "left_anti").join(named, "id").orderBy("hop", "path", "id").limit(blast)
    scope = ids.unionByName(both["forward"].select("id")).unionByName(both["review"].select("id")).distinct().join(named, "id").where("domain is not null")
    links = reduce(DataFrame.unionByName, [step for _, step in near]).distinct()
    crossed = links.join(named.select("id", F.col("domain").alias("mine")), "id").join(named.select(F.col("id").alias("other"), "path", "domain"), "other").where("mine <> domain")
    parts = [
        part(held, "anchor", F.when(F.col("score") >= 0.5 * top, "high").otherwise("maybe")),
        *[part(rows.orderBy("path", "id").limit(most), role, F.col("domain")) for role, rows in both.items()],
        part(hops, "blast", F.col("hop")),
        part(scope.select(F.col("domain").alias("path")).distinct(), "domain", F.lit(None)),
        part(crossed.select("path", F.concat_ws(">", "mine", "domain").alias("d")).distinct().orderBy("path", "d").limit(crossing), "cross", F.col("d")),
    ]
    return reduce(DataFrame.unionByName, parts)


def file_context(files: DataFrame, edges: DataFrame, symbols: DataFrame, seeds: DataFrame, most: int = 50) -> DataFrame:
    """One row per seed file: domain, exported names, what it imports and who imports it; lists in order, at most ``most`` each."""
    wanted = files.join(seeds.select("id").distinct(), "id", "left_semi")
    paths = files.select(F.col("id").alias("other"), F.col("path").alias("other_path"))

    def side(of: str, to: str, name: str) -> DataFrame:
        near = edges.select(F.col(of).alias("id"), F.col(to).alias("other")).join(seeds.select("id").distinct(), "id", "left_semi").where("id <> other").join(paths, "other")
        return top_per_group(near.select("id", "other_path", "other"), ["id"], [F.col("other_path"), F.col("other")], most).groupBy("id").agg(F.array_sort(F.collect_list("other_path")).alias(name))

    exported = symbols.where("exported").select(F.col("file_id").alias("id"), "name").join(seeds.select("id").distinct(), "id", "left_semi").distinct()
    names = top_per_group(exported, ["id"], [F.col("name")], most).groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("exports"))
    out = wanted.select("id", "path", "domain").join(names, "id", "left").join(side("src", "dst", "imports"), "id", "left").join(side("dst", "src", "imported_by"), "id", "left")
    none = F.array().cast("array<string>")
    return out.select("id", "path", "domain", *[F.coalesce(c, none).alias(c) for c in ("exports", "imports", "imported_by")])


def stale(docs: DataFrame, key: str, written: str, now: Column, days: int = 30, limit: int = 50) -> DataFrame:
    """``key, age_days`` of the oldest documents last written more than ``days`` before ``now``."""
    age = F.datediff(now.cast("date"), F.col(written).cast("date"))
    return docs.select(key, age.alias("age_days")).where(F.col("age_days") > days).orderBy(F.desc("age_days"), key).limit(limit)


def breaches(drifted: DataFrame, share: float = 0.2, least: int = 3) -> DataFrame:
    """Rows of a drift report that moved by ``share`` and by ``least`` files."""
    return drifted.where((F.col("before") > 0) & (F.abs("delta") / F.col("before") >= share) & (F.abs("delta") >= least))


def payload_line(payload: Column, keys: tuple[str, ...]) -> Column:
    """One line ``key=value`` for the keys a JSON payload has."""
    return F.concat_ws(" ", *[F.when(F.get_json_object(payload, f"$.{k}").isNotNull(), F.concat(F.lit(f"{k}="), F.get_json_object(payload, f"$.{k}"))) for k in keys])
