"""Checking texts against a small grammar with relational means only.

A text is lexed into rows of terminals; the adjacent pairs of terminals are anti-joined against the pairs the grammar permits, and
what pairs cannot tell - nesting and the makeup of a whole statement - is decided by windowed and grouped reductions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, END = "^", "$"


@dataclass(frozen=True)
class Grammar:
    """Terminals as (class, pattern) in order of preference, and productions over classes and rule names.

    ``rules`` maps a name to its alternatives; an empty alternative means nothing. ``pairs`` holds every (class, next class) that
    occurs in some sentence derived from ``start``, with ``^`` and ``$`` as borders.
    """

    terminals: tuple[tuple[str, str], ...]
    rules: dict[str, tuple[tuple[str, ...], ...]]
    start: str
    brackets: dict[str, str] = field(default_factory=dict)

    @cached_property
    def pairs(self) -> frozenset[tuple[str, str]]:
        names = set(self.rules)
        empty: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in names}
        last: dict[str, set[str]] = {n: set() for n in names}
        edge = lambda sets, s: sets[s] if s in names else {s}
        changed = True
        while changed:
            before = (len(empty), sum(map(len, first.values())), sum(map(len, last.values())))
            for name, options in self.rules.items():
                for option in options:
                    if all(s in empty for s in option):
                        empty.add(name)
                    for sets, line in ((first, option), (last, option[::-1])):
                        for s in line:
                            sets[name] |= edge(sets, s)
                            if s not in empty:
                                break
            changed = before != (len(empty), sum(map(len, first.values())), sum(map(len, last.values())))
        found = set()
        for options in [*self.rules.values(), ((START, self.start, END),)]:
            for option in options:
                for i, s in enumerate(option):
                    for t in option[i + 1 :]:
                        found |= {(a, b) for a in edge(last, s) for b in edge(first, t)}
                        if t not in empty:
                            break
        return frozenset(found)

    def permitted(self, spark: SparkSession) -> DataFrame:
        """``cls, next``: as many rows as the square of the classes at most."""
        return spark.createDataFrame(sorted(self.pairs), "cls string, next string")


def lex(df: DataFrame, key: str, text: Column, grammar: Grammar) -> DataFrame:
    """``key, pos, lexeme, cls``: the terminals of each text in order; what no pattern matches is skipped.

    One alternation of all patterns is searched, then each match is named by the first pattern that matches it whole. Texts that are null
    or hold no terminal give no row. Runs in the JVM.
    """
    whole = "|".join(f"(?:{p})" for _, p in grammar.terminals)
    lexeme = F.col("lexeme")
    name = F.lit(None).cast("string")
    for cls, pattern in reversed(grammar.terminals):
        name = F.when(lexeme.rlike(f"(?s)^(?:{pattern})$"), cls).otherwise(name)
    matches = df.select(F.col(key), F.posexplode(F.regexp_extract_all(text, F.lit(f"({whole})"), 1)).alias("pos", "lexeme"))
    return matches.withColumn("cls", name)


def bad_pairs(tokens: DataFrame, key: str, grammar: Grammar) -> DataFrame:
    """``key, pos, cls, next`` for each adjacent pair that the grammar does not permit, borders included."""
    line = Window.partitionBy(key).orderBy("pos")
    after = tokens.select(key, "pos", "cls", F.coalesce(F.lead("cls").over(line), F.lit(END)).alias("next"))
    begin = tokens.where("pos = 0").select(key, F.lit(-1).alias("pos"), F.lit(START).alias("cls"), F.col("cls").alias("next"))
    permitted = grammar.permitted(tokens.sparkSession)
    return after.unionByName(begin).join(F.broadcast(permitted), ["cls", "next"], "left_anti").select(key, "pos", "cls", "next")


def bad_nesting(tokens: DataFrame, key: str, grammar: Grammar) -> DataFrame:
    """``key`` of the texts whose brackets do not nest: one left open, one never opened, or two that do not belong together."""
    opens, closes = list(grammar.brackets), list(grammar.brackets.values())
    step = F.when(F.col("cls").isin(opens), 1).when(F.col("cls").isin(closes), -1)
    line = Window.partitionBy(key).orderBy("pos")
    deep = tokens.withColumn("step", step).where(F.col("step").isNotNull()).withColumn("after", F.sum("step").over(line))
    level = deep.withColumn("level", F.when(F.col("step") == 1, F.col("after")).otherwise(F.col("after") + 1))
    pair = Window.partitionBy(key, "level").orderBy("pos")
    partner = F.lag("cls").over(pair)
    wanted = F.lit(None).cast("string")
    for o, c in grammar.brackets.items():
        wanted = F.when(F.col("cls") == c, o).otherwise(wanted)
    judged = level.withColumn("clash", (F.col("step") == -1) & ~F.coalesce(partner == wanted, F.lit(False)))
    return judged.groupBy(key).agg(F.min("after").alias("low"), F.sum("step").alias("rest"), F.max("clash").alias("clash")).where("low < 0 or rest <> 0 or clash").select(key)
