"""Source files that do not parse: told from the tools' messages, and from the text where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.grammar import Grammar, bad_nesting, bad_pairs, lex
from tessella.operators.rows import latest
from tessella.operators.skew import present_in

#: Spellings of a language.
LANGUAGES = {
    "py": "python", "python3": "python", "python2": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "node": "javascript", "golang": "go",
    "rs": "rust", "c#": "csharp", "cs": "csharp", "c++": "cpp", "cxx": "cpp", "cc": "cpp", "rb": "ruby", "kt": "kotlin",
}


def language_name(language: Column) -> Column:
    """One spelling per language; null and blank read as ``unknown``."""
    bare = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    spelled = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(bare == "", "unknown").otherwise(F.coalesce(spelled[bare], bare))


# The language of remarks that accept the file's text. Its terminals, over lower-case messages without code frames:
#   tool    the tool and its surroundings: plugins, options, limits, workers, file system, module lookup
#   keep    an outcome that leaves the text accepted
#   defect  something wrong, missing or out of place
#   code    a part of source text
#   verdict a complete statement about the text
# A remark may name parts of code and may speak of defects, but a clause holds only one of them, and a tool or an outcome stands
# between clauses: the permitted pairs hold no defect beside code. What a whole statement is about, the reductions below decide.
REMARKS = Grammar(
    terminals=(
        ("verdict", r"<{4,}[^\n']*|>{4,}[^\n']*|={7}|conflict markers?|unfinished merge|unresolved merge"),
        ("verdict", r"no statement accepted|not (?:[\w+#]{1,20} )?(?:text|source|code)\b|cannot be (?:tokeni[sz]ed|decoded|lexed|parsed)|(?:is )?not (?:valid|well-formed)(?: [\w+#]+)?"),
        ("verdict", r"(?:code|source|text) (?:was )?expected|root element|syntax ?error|indentation ?error|tab ?error|error nodes?|parse error|null bytes?|nul bytes?|binary (?:content|data|file)"),
        ("verdict", r"[;,})\]] expected|unexpected (?:eof|end(?: of (?:file|input|line|text|stream))?)|(?:premature|reached) end of (?:file|input)|(?:is|was) (?:cut off|cut short|truncated)(?: after| at)|already been declared|redeclared|already declared|duplicate (?:declaration|identifier)"),
        ("verdict", r"does not match any outer indentation|inconsistent (?:indentation|use of tabs)|never closed|not closed|never terminated|left open"),
        ("tool", r"plugin(?:s|\.\w+)?\b|options?\b|workers?\b|(?:parser )?pool\b|\block\b|alias\b|path map|workspace|manifest|credentials|extractor|stripper|handler bug|import rows|import statements|re-?exports?|routes array|not a function|of undefined|of null|is null\b|call stack|stack size|recursion limit|out of memory|heap|timed out|timeout|enoent|eacces|eperm|emfile|enospc|eisdir|permission denied|no such file|vanished|(?:cannot|can't|could not|unable to) (?:resolve|find|load|open|read)|cannot resolve|has no export|not loaded|could not be loaded|low confidence|limit is|attempt|unreadable|stopped after|cache|config(?:uration)?\b|network|socket|disk|deprecated|busy|settings?\b|internal error|extension|registry|killed|exited|crashed|signal\b|warning|hint\b|lint\b"),
        ("keep", r"ignored|skipped|kept|fell back|falling back|fallback|mode used|cleanly|list cut off|all else read|not read|accepted|recovered|disabled|registration kept|continuing|tolerated|inserted"),
        ("defect", r"unexpected|expected|unterminated|unclosed|unbalanced|unmatched|mismatched|missing|invalid|illegal|malformed|truncated|cut off|leftover|stray|expecting|not allowed|not permitted|must be|reserved|cannot|found|unfinished|undeclared|garbage|duplicate|unknown"),
        ("code", r"eof\b|end of (?:file|input|line|source)|\btokens?\b|strings?\b|templates?\b|semicolons?|braces?\b|brackets?\b|parenthes[ie]s|delimiters?|quotes?\b|declarations?|statements?\b|expressions?\b|identifiers?|indentation|indent|block comment|comment\b|directive|jsx|tag\b|literal|clause|unqualified-id|syntax\b|source\b|newline|bytes?\b|blob\b|character|escape|operator|keyword|merge\b|types?\b|to find\b|end\b|start\b"),
        ("code", r"'[^\w\s']+'|`[^\w\s`]+`|\"[^\w\s\"]+\""),
    ),
    rules={
        "remark": (("clause",), ("clause", "mark", "remark")),
        "mark": (("tool",), ("keep",)),
        "clause": ((), ("parts",), ("faults",)),
        "parts": (("code",), ("code", "parts")),
        "faults": (("defect",), ("defect", "faults")),
    },
    start="remark",
)


def message_text(message: Column) -> Column:
    """A message in lower case without stack lines, code frames and the places it points at."""
    # Possessive runs that begin only where a word begins keep every pattern linear, however long a message is.
    bare = F.regexp_replace(F.lower(message), r"(?m)^[ \t]*+(?:at |file \"|>?[ \t]*+\d++ \||\^|\|)[^\n]*+$", "")
    bare = F.regexp_replace(bare, r"(?<![\w.@+-])[\w.@+-]++(?:[/\\][\w.@+-]++)++|(?<![\w+.-])[\w+-]++\.(?:py|ts|tsx|js|jsx|mjs|java|go|rs|cs|cpp|cc|h|dart|json|ya?ml|toml)\b", "path")
    return F.regexp_replace(bare, r"'[a-z@][\w.@:-]*+'", "'name'")


def judged_messages(errors: DataFrame) -> DataFrame:
    """``error_id, file_id, malformed`` for each error row; each id is read once.

    The lexed message is malformed - it denies that the text is well-formed source - if it states so outright or holds an adjacent pair of defect and code that
    the remark grammar does not permit, unless the statement is about the tool or leaves the text accepted. Empty and null messages say nothing.
    """
    rows = latest(errors.where(F.col("id").isNotNull()).select("id", "file_id", "error_message"), ["id"]).withColumnRenamed("id", "error_id")
    tokens = lex(rows, "error_id", message_text(F.col("error_message")), REMARKS)
    wrong = bad_pairs(tokens, "error_id", REMARKS).groupBy("error_id").agg(
        F.max((F.col("cls").isin("defect", "code") & F.col("next").isin("defect", "code")).cast("int")).alias("denied"),
    )
    makeup = tokens.groupBy("error_id").agg(
        F.max((F.col("cls") == "verdict").cast("int")).alias("stated"),
        F.max((F.col("cls") == "tool").cast("int")).alias("tool"),
        F.max((F.col("cls") == "keep").cast("int")).alias("keep"),
        F.min_by("cls", "pos").alias("opening"),
    )
    about_tool = (F.col("tool") == 1) | (F.col("keep") == 1)
    verdict = F.coalesce(((F.col("stated") == 1) | (F.coalesce("denied", F.lit(0)) == 1)) & ~about_tool, F.lit(False))
    return rows.join(makeup, "error_id", "left").join(wrong, "error_id", "left").select("error_id", "file_id", verdict.alias("malformed"))


def unparsable_files(errors: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id`` of each file of ``files`` with at least one error row that calls its text malformed."""
    bad = judged_messages(errors).where("malformed and file_id is not null").select("file_id").distinct()
    return present_in(bad, "file_id", files, "id").select("file_id").distinct()


def rates(errors: DataFrame, files: DataFrame) -> DataFrame:
    """``repo_name, language, files, unparsable, rate`` over all files; the latest delivery of a file holds."""
    heads = latest(files.where(F.col("id").isNotNull()).select("id", "repo_name", "language", "last_indexed_at"), ["id"], ["last_indexed_at"])
    bad = unparsable_files(errors, files).withColumn("bad", F.lit(1))
    counted = heads.join(bad, heads["id"] == bad["file_id"], "left").groupBy("repo_name", language_name(F.col("language")).alias("language"))
    return counted.agg(F.count(F.lit(1)).alias("files"), F.count("bad").alias("unparsable")).withColumn("rate", F.col("unparsable") / F.col("files"))


# Source text itself, for languages with C-like or Python-like tokens: enough grammar to tell what no such language permits.
SOURCE = Grammar(
    terminals=(
        ("skip", r"(?s:/\*.*?\*/)|//[^\n]*+|# [^\n]*+"),
        ("conflict", r"(?:<{7}|>{7}) [^\n]*|={7}\n"),
        ("word", r"(?s:\"\"\".*?\"\"\")|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`|[\w$@]++"),
        ("(", r"\("), (")", r"\)"), ("[", r"\["), ("]", r"\]"), ("{", r"\{"), ("}", r"\}"),
        (";", r";"), (",", r","), ("quote", r"[\"`]"), ("op", r"[^\w\s()\[\]{};,\"`]+"),
    ),
    rules={
        "text": ((), ("item", "text")),
        "item": (("word",), ("op",), (";",), (",",), ("(", "text", ")"), ("[", "text", "]"), ("{", "text", "}")),
    },
    start="text",
    brackets={"(": ")", "[": "]", "{": "}"},
)


def unparsable_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, conflict, open_string, nesting`` for each text that no C-like or Python-like grammar accepts.

    ``conflict``: a merge-conflict marker stands alone on its line; ``open_string``: a quotation mark that nothing closes; ``nesting``: brackets that do
    not nest. Null and empty texts are accepted. Whole texts are lexed.
    """
    tokens = lex(df.where(F.col(key).isNotNull()), key, F.col(text), SOURCE).where("cls <> 'skip'")
    line = Window.partitionBy(key).orderBy("pos")
    tokens = tokens.withColumn("pos", F.row_number().over(line) - 1)
    wrong = bad_pairs(tokens, key, SOURCE)
    seen = (F.col("cls"), F.col("next"))
    told = wrong.groupBy(key).agg(*[F.max((seen[0] == c) | (seen[1] == c)).alias(n) for c, n in (("conflict", "conflict"), ("quote", "open_string"))])
    nested = bad_nesting(tokens, key, SOURCE).withColumn("nesting", F.lit(True))
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("conflict", "open_string", "nesting")]
    return told.join(nested, key, "full_outer").select(key, *flags).where("conflict or open_string or nesting")
