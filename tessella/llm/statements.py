"""Statement grammars: lines of tokens with their brackets collapsed, checked by permitted neighbours and by whole productions.

The tokens between two brackets, and those of one statement outside all brackets, are lines; a bracket inside a line is one token of it. A line is thus of a
regular language, given as rules in a small notation. From the rules follow both the pairs of neighbours that some line permits and an expression for whole lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.grammar import END, START, Grammar, bad_nesting, lex
from tessella.storage import materialize

#: Open brackets, and what a bracket with its content is called in a line.
GROUPS = {"(": "paren", "[": "brack", "{": "brace"}
CLOSES = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Lines:
    """Terminals as (class, pattern), ``words`` that are a class of their own whatever pattern found them, and rules as text: names of classes or of earlier rules, ``( | ) ? * +``.

    ``kinds`` gives the rule for statements (``top``) and inside each bracket.
    """

    terminals: tuple[tuple[str, str], ...]
    rules: dict[str, str]
    kinds: dict[str, str]
    words: dict[str, str] = field(default_factory=dict)

    @cached_property
    def classes(self) -> list[str]:
        return list(dict.fromkeys([c for c, _ in self.terminals] + list(self.words.values()) + list(GROUPS.values())))

    def code(self, cls: str) -> str:
        """The character that stands for a class in the text of a line."""
        return chr(0xE000 + self.classes.index(cls))

    def _expanded(self, rule: str) -> list[str]:
        out: list[str] = []
        for part in re.findall(r"[\w]+|[()|?*+]", rule):
            if part in self.rules:
                out += ["(", *self._expanded(self.rules[part]), ")"]
            elif part in "()|?*+":
                out.append(part)
            else:
                self.code(part)  # an unknown class is an error of the grammar
                out.append(part)
        return out

    def pattern(self, kind: str) -> str:
        """An expression for the whole text of a line of a kind."""
        return "^(?:" + "".join("(?:" if p == "(" else p if p in ")|?*+" else self.code(p) for p in self._expanded(self.rules[self.kinds[kind]])) + ")$"

    def pairs(self, kind: str) -> set[tuple[str, str]]:
        """Every two neighbours that occur in some line of a kind, borders included."""
        parts = self._expanded(self.rules[self.kinds[kind]])
        found: set[tuple[str, str]] = set()
        at = 0

        def union(a, b):
            return a[0] | b[0], a[1] | b[1], a[2] or b[2]

        def sequence():
            nonlocal at
            first, last, empty = set(), set(), True
            while at < len(parts) and parts[at] not in "|)":
                if parts[at] == "(":
                    at += 1
                    f, l, e = choice()
                else:
                    f, l, e = {parts[at]}, {parts[at]}, False
                at += 1
                while at < len(parts) and parts[at] in "?*+":
                    if parts[at] in "*+":
                        found.update((x, y) for x in l for y in f)
                    e = e or parts[at] in "?*"
                    at += 1
                found.update((x, y) for x in last for y in f)
                first = first | f if empty else first
                last = last | l if e else l
                empty = empty and e
            return first, last, empty

        def choice():
            nonlocal at
            out = sequence()
            while at < len(parts) and parts[at] == "|":
                at += 1
                out = union(out, sequence())
            return out

        first, last, empty = choice()
        return found | {(START, x) for x in first} | {(x, END) for x in last} | ({(START, END)} if empty else set())


def lines_of(tokens: DataFrame, key: str) -> DataFrame:
    """``key, kind, line, pos, cls``: tokens by the line they belong to; line breaks inside brackets are dropped, a bracket's token stands where it opens."""
    order = Window.partitionBy(key).orderBy("pos")
    opens, closes = F.col("cls").isin(*GROUPS), F.col("cls").isin(*CLOSES.values())
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order)
    placed = tokens.withColumn("after", depth).where(~closes).withColumn("level", F.when(opens, F.col("after") - 1).otherwise(F.col("after")))
    groups = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    inner = placed.where(opens).select(key, "pos", (F.col("level") + 1).alias("level"), F.lit(None).cast("string").alias("cls"), groups[F.col("cls")].alias("kind"))
    own = placed.select(key, "pos", "level", F.coalesce(groups[F.col("cls")], F.col("cls")).alias("cls"), F.lit(None).cast("string").alias("kind"))
    place = Window.partitionBy(key, "level").orderBy("pos", F.col("kind").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = own.unionByName(inner).withColumns(
        {"opened": F.last(F.when(F.col("kind").isNotNull(), F.col("pos")), ignorenulls=True).over(place), "of": F.coalesce(F.last("kind", ignorenulls=True).over(place), F.lit("top")), "breaks": F.sum((F.col("cls") == "nl").cast("int")).over(place)}
    )
    line = F.when(F.col("level") == 0, F.coalesce("breaks", F.lit(0))).otherwise(F.col("opened"))
    return marked.where("cls is not null and cls <> 'nl'").select(key, "level", F.col("of").alias("kind"), line.alias("line"), "pos", "cls")


def bad_lines(tokens: DataFrame, key: str, grammar: Lines) -> DataFrame:
    """``key, kind, line`` of the lines with neighbours that the grammar does not permit, or that no production gives as a whole."""
    spark = tokens.sparkSession
    lines = lines_of(tokens, key)
    by = [key, "level", "kind", "line"]
    order = Window.partitionBy(*by).orderBy("pos")
    after = lines.select(*by, "cls", F.coalesce(F.lead("cls").over(order), F.lit(END)).alias("next"))
    begin = lines.select(*by, F.lit(START).alias("cls"), F.col("cls").alias("next"), F.row_number().over(order).alias("n")).where("n = 1").drop("n")
    permitted = spark.createDataFrame(sorted((k, a, b) for k in grammar.kinds for a, b in grammar.pairs(k)), "kind string, cls string, next string")
    apart = after.unionByName(begin).join(F.broadcast(permitted), ["kind", "cls", "next"], "left_anti").select(key, "kind", "line")
    codes = F.create_map(*[F.lit(x) for c in grammar.classes for x in (c, grammar.code(c))])
    whole = lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", codes[F.col("cls")].alias("c")))), lambda x: x["c"]), "").alias("text"))
    fits = F.lit(False)
    for kind in grammar.kinds:
        fits = F.when(F.col("kind") == kind, F.col("text").rlike(grammar.pattern(kind))).otherwise(fits)
    return apart.unionByName(whole.where(~fits).select(key, "kind", "line")).distinct()


_WORD = r"[A-Za-z_\u0080-\uffff][\w\u0080-\uffff]*+"
_KEYWORDS = ("def", "class", "if", "elif", "else", "for", "in", "not", "is", "lambda", "return", "raise", "import", "from", "as", "with", "while", "except", "del", "assert", "yield", "await", "async")

#: The statements of Python and what may stand in its brackets.
PYTHON = Lines(
    terminals=(
        ("skip", r"#[^\n]*+|\\\n"),
        ("str", r"(?i:[rbuf]{0,2})(?:\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|\"[^\"\\\n]*+(?:\\(?s:.)[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+')"),
        ("num", r"(?:\d|\.\d)(?:[eE][+-]\d|[\w.])*+"),
        ("name", _WORD),
        ("nl", r"\n[ \t]*+"),
        ("bad", r"->|:=|\.\.\.|(?:\*\*|//|<<|>>|[-+*/%@&|^])=?|[=!<>]=|[^\s]"),
    ),
    words={
        **{k: k for k in _KEYWORDS}, "and": "bool", "or": "bool", "try": "try", "finally": "try", "pass": "bare", "break": "bare", "continue": "bare", "global": "scope", "nonlocal": "scope",
        **{x: "aug" for x in ("**=", "//=", "<<=", ">>=", "-=", "+=", "*=", "/=", "%=", "@=", "&=", "|=", "^=")}, **{x: "op" for x in ("==", "!=", "<=", ">=", "//", "<<", ">>", "/", "%", "&", "|", "^", "<", ">")},
        "->": "arrow", ":=": "walrus", "=": "assign", "*": "star", "**": "star", "-": "sign", "+": "sign", "~": "tilde", "@": "at", "...": "dots", ".": "dot", ",": "comma", ":": "colon", ";": "semi",
        **{x: x for x in (*GROUPS, *CLOSES.values())},
    },
    rules={
        "atom": "name | num | str+ | dots | paren | brack | brace",
        "primary": "atom (dot name | paren | brack)*",
        "head": "lambda ((name | star) (assign primary)? comma?)* colon",
        "prefix": "sign | tilde | not | await | star | head | yield from?",
        "infix": "op | sign | star | at | bool | in | not in | is not? | if | else | walrus | async? for",
        "expr": "prefix* primary (infix prefix* primary)* | yield",
        "exprs": "expr (comma expr)* comma?",
        "dotted": "name (dot name)*",
        "renamed": "dotted (as name)?",
        "source": "(dot | dots)* dotted | (dot | dots)+",
        "simple": "exprs (colon expr)? ((assign | aug) exprs)* | return exprs? | raise (expr (from expr)?)? | bare | del exprs | assert expr (comma expr)? | scope name (comma name)* | import renamed (comma renamed)* | from source import (paren | star | renamed (comma renamed)*)",
        "many": "simple (semi simple)* semi?",
        "block": "async? def name brack? paren (arrow expr)? | class name brack? paren? | (if | elif | while) expr | else | try | async? for exprs | async? with expr (as primary)? (comma expr (as primary)?)* | except star? (exprs (as name)?)? | name exprs (if expr)?",
        "statement": "many | block colon many? | at expr",
        "item": "star | op | expr? (colon expr?)? (colon expr?)? (assign expr)?",
        "items": "item (comma item)*",
        "imported": "renamed (comma renamed)* comma?",
        "inside": "items | imported",
    },
    kinds={"top": "statement", "paren": "inside", "brack": "items", "brace": "items"},
)


def python_faults(df: DataFrame, key: str, text: Column | str) -> DataFrame:
    """``key, nesting, statement, layout`` of the texts that are no well-formed Python by these rules.

    ``nesting``: brackets that do not nest; ``statement``: a line of no production, open quotation marks and foreign characters among them; ``layout``: a line that is
    deeper than the one before without a colon that opens a block, or a block that never comes, at the end of the text too. Null, empty and blank texts are accepted; whole texts are lexed.
    """
    lexer = Grammar(PYTHON.terminals, {}, "", dict(CLOSES))
    words = F.create_map(*[F.lit(x) for pair in PYTHON.words.items() for x in pair])
    found = lex(df.where(F.col(key).isNotNull()), key, F.regexp_replace(text, "\r\n?", "\n"), lexer).where("cls <> 'skip'")
    tokens = materialize(found.select(key, "pos", F.when(F.col("cls") == "nl", F.col("lexeme")).alias("lexeme"), F.coalesce(words[F.col("lexeme")], "cls").alias("cls")), "source-tokens")
    nested = bad_nesting(tokens, key, lexer).select(key, F.lit("nesting").alias("fault"))
    wrong = bad_lines(tokens, key, PYTHON).select(key, F.lit("statement").alias("fault"))
    faults = nested.unionByName(wrong).unionByName(_layout(tokens, key).select(key, F.lit("layout").alias("fault"))).distinct()
    return faults.groupBy(key).agg(*[F.max((F.col("fault") == f).cast("int")).cast("boolean").alias(f) for f in ("nesting", "statement", "layout")])


def _layout(tokens: DataFrame, key: str) -> DataFrame:
    """Keys of the texts whose lines are indented otherwise than their blocks say. A line's depth is that of its first token, told by the spaces after the break before it."""
    order = Window.partitionBy(key).orderBy("pos")
    opens, closes = F.col("cls").isin(*GROUPS), F.col("cls").isin(*CLOSES.values())
    deep = tokens.withColumn("after", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order))
    top = deep.where((F.col("after") - F.when(opens, 1).otherwise(0)) <= 0).withColumn("line", F.sum(((F.col("cls") == "nl") & (F.col("after") == 0)).cast("int")).over(order))
    top = top.withColumn("column", F.coalesce(F.length(F.last(F.when(F.col("cls") == "nl", F.col("lexeme")), ignorenulls=True).over(order)) - 1, F.lit(0))).where("cls <> 'nl'")
    lines = top.groupBy(key, "line").agg(F.max_by("cls", "pos").alias("ends"), F.min_by("column", "pos").alias("indent"))
    row = Window.partitionBy(key).orderBy("line")
    told = lines.select(key, "indent", F.lag("indent").over(row).alias("was"), F.lag("ends").over(row).alias("ended"), "ends", F.lead("line").over(row).isNull().alias("last"))
    opened = F.coalesce(F.col("ended") == "colon", F.lit(False))
    wrong = (opened & (F.col("indent") <= F.col("was"))) | (~opened & (F.col("indent") > F.coalesce("was", F.lit(0)))) | (F.col("last") & (F.col("ends") == "colon"))
    return told.where(wrong).select(key).distinct()


def looks_like_python(text: Column) -> Column:
    """Whether a text has Python's definitions or imports at the beginning of a line, and none of the marks of languages with braces."""
    ours = text.rlike(r"(?m)^\s*(?:async )?def \w+\(|^class \w+[(:]|^from [\w.]+ import |^import [\w.]+$")
    return F.coalesce(ours & ~text.rlike(r"(?m)^(?:func |package |export |const |let |import .*['\"];?$)|[{;]$"), F.lit(False))
