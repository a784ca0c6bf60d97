"""String search, edit distances and prefix dictionaries. Positions are 0-based code points unless said otherwise.

A null text gives a null distance and first place, no occurrences (a count of 0), and no pattern; an empty one is
searched like any other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import bind, occurrences
from tessera.functions.automaton import Automaton


def as_bytes(text: Column) -> Column:
    """A string with a character for each UTF-8 byte, so that built-ins count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def edit_distance(a: Column, b: Column, unit: str = "byte") -> Column:
    """Levenshtein distance with unit costs."""
    return F.levenshtein(as_bytes(a), as_bytes(b)) if unit == "byte" else F.levenshtein(a, b)


def weighted_edit_distance(a: Column, b: Column, insert: int = 1, delete: int = 1, replace: int = 1) -> Column:
    """Least cost of turning ``a`` into ``b``: rows of the table folded over a's characters, cells over b's."""
    letters = lambda s: F.when(F.char_length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))

    def table(xs: Column, ys: Column) -> Column:
        first = F.transform(F.sequence(F.lit(0), F.size(ys)), lambda j: (j * insert).cast("int"))

        def row(prev: Column, x: Column) -> Column:
            def cell(cur: Column, j: Column) -> Column:
                swap = F.get(prev, j) + F.when(F.get(ys, j) == x, 0).otherwise(replace)
                return F.concat(cur, F.array(F.least(swap, F.get(prev, j + 1) + delete, F.element_at(cur, -1) + insert)))

            places = F.when(F.size(ys) > 0, F.sequence(F.lit(0), F.size(ys) - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(places, F.array(F.get(prev, F.lit(0)) + delete), cell)

        return F.aggregate(xs, first, row, lambda last: F.element_at(last, -1))

    return bind(letters(a), lambda xs: bind(letters(b), lambda ys: table(xs, ys))).cast("long")


def prefix_function(pattern: str) -> list[int]:
    """For each prefix the length of its longest border."""
    out = [0] * len(pattern)
    for i in range(1, len(pattern)):
        k = out[i - 1]
        while k and pattern[i] != pattern[k]:
            k = out[k - 1]
        out[i] = k + (pattern[i] == pattern[k])
    return out


def find_all(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """The rows with ``pos``: inclusive end of each occurrence of the pattern, overlapping ones too."""
    ends = F.transform(occurrences(F.col(text), pattern), lambda p: (p + len(pattern) - 1).cast("long"))
    return df.withColumn("pos", F.explode(ends))


def find_count(text: Column, pattern: str) -> Column:
    return F.size(occurrences(text, pattern)).cast("long")


def find_first_end(text: Column, pattern: str) -> Column:
    """Inclusive end of the first occurrence, or -1."""
    at = F.locate(pattern, text)
    return F.when(at == 0, -1).otherwise(at + len(pattern) - 2).cast("long")


def find_first(text: Column, pattern: str) -> Column:
    """Start of the first occurrence, or -1; an empty pattern is nowhere."""
    return (F.instr(text, pattern) - 1).cast("long") if pattern else F.lit(-1).cast("long")


FOUND = "struct<pos:bigint,pid:bigint>"


def find_patterns(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """The rows with ``pos`` and ``pid`` of every occurrence of every pattern; a pattern listed twice keeps its last id.

    One automaton of all patterns passes once over each text, in Arrow batches, so the cost doesn't grow with their
    number. A null text has none.
    """
    automaton = Automaton({p: k for k, p in enumerate(patterns)})

    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [(end - n + 1, k) for end, k, n in automaton.matches(t)] for t in texts], dtype=object)

    return df.withColumn("m", F.explode(F.pandas_udf(found, f"array<{FOUND}>")(F.col(text)))).withColumns({"pos": F.col("m.pos"), "pid": F.col("m.pid")}).drop("m")


def find_first_pattern(text: Column, patterns: list[str]) -> Column:
    """Struct (pos, pid) of the occurrence that ends first, the longest of those; pos -1 and pid null if none."""
    automaton = Automaton({p: k for k, p in enumerate(patterns)})

    def first(texts: pd.Series) -> pd.DataFrame:
        hits = [None if t is None else next(automaton.matches(t), None) for t in texts]
        return pd.DataFrame({"pos": [-1 if h is None else h[0] - h[2] + 1 for h in hits], "pid": pd.array([None if h is None else h[1] for h in hits], dtype="Int64")})

    return F.pandas_udf(first, "pos bigint, pid bigint")(text)


def prefixes_of(words: DataFrame, longest: int) -> DataFrame:
    """word, prefix: every prefix of up to ``longest`` characters, the empty one too, so that prefix search is an equi-join."""
    n = F.least(F.char_length("word"), F.lit(longest))
    cut = F.transform(F.sequence(F.lit(0), n), lambda k: F.substring(F.col("word"), F.lit(1), k))
    return words.filter("word <> ''").select("word", F.explode(cut).alias("prefix"))


def prefix_search(words: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, n_words, has_word: how many words begin with each prefix (an empty one: all), and whether one equals it.

    Words are cut to prefixes as long as the longest asked for; null and empty words are none, a null prefix finds none.
    """
    longest = prefixes.agg(F.max(F.char_length("prefix"))).first()[0] or 0
    found = prefixes_of(words, longest).groupBy("prefix").agg(F.count("*").alias("n_words"), F.bool_or(F.col("word") == F.col("prefix")).alias("has_word"))
    out = prefixes.join(found, "prefix", "left")
    return out.select("prefix", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("has_word", F.lit(False)).alias("has_word"))


def dictionary(log: DataFrame) -> DataFrame:
    """word of what a log (word, seq, op) of adds and deletes leaves; a delete unmarks the word only, not its prefixes'
    other words."""
    last = log.groupBy("word").agg(F.max_by("op", "seq").alias("op"))
    return last.filter("op <> 'delete'").select("word")


def deletions(log: DataFrame) -> DataFrame:
    """word, seq, found of each delete in a log (word, seq, op): whether the word was there when it was deleted."""
    before = F.lag("op").over(Window.partitionBy("word").orderBy("seq"))
    return log.withColumn("found", F.coalesce(before != "delete", F.lit(False))).filter("op = 'delete'").select("word", "seq", "found")


def repeated_pattern(text: Column) -> Column:
    """The shortest string that the text repeats at least twice, or an empty one."""
    n = F.char_length(text)
    period = F.position(text, F.substring(F.concat(text, text), F.lit(2), n * 2))
    return F.when((n > 0) & (period < n), F.substring(text, F.lit(1), period)).otherwise(F.lit(""))
