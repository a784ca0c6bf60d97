"""Spans of regular expressions as column expressions: positions in code points, JVM functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import bind, running_max, running_sums

#: Characters of a piece of text.
BLOCK = 256

def matches(text: Column, pattern: str, context: int = 0, group: int = 0) -> Column:
    """The leftmost non-overlapping matches: array of (start, stop, value, part, before, after).

    ``part`` is a group's text; ``before`` and ``after`` are up to ``context`` characters around the match, as far as
    the neighbouring matches. The text between matches comes from a split by the same pattern, and positions from
    running sums of lengths.
    """
    p = F.lit(pattern)

    def spans(found: Column) -> Column:
        return bind(F.split(text, pattern, -1), lambda gaps: bind(
            running_sums(F.transform(found, lambda v, k: F.char_length(F.get(gaps, k)) + F.when(k > 0, F.char_length(F.get(found, k - 1))).otherwise(0))),
            lambda starts: bind(F.regexp_extract_all(text, p, F.lit(group)) if group else found, lambda parts: F.transform(found, lambda v, k: F.struct(
                F.get(starts, k).alias("start"),
                (F.get(starts, k) + F.char_length(v)).alias("stop"),
                v.alias("value"),
                F.get(parts, k).alias("part"),
                (F.right(F.get(gaps, k), F.lit(context)) if context else F.lit("")).alias("before"),
                (F.left(F.get(gaps, k + 1), F.lit(context)) if context else F.lit("")).alias("after"),
            )))))

    some = bind(F.regexp_extract_all(text, p, F.lit(0)), spans)
    none = F.array().cast("array<struct<start:int,stop:int,value:string,part:string,before:string,after:string>>")
    return F.when(F.regexp_like(text, p), some).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total: Column, k: Column) -> Column:
        d = F.substring(number, F.lit(0) - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(number), F.lit(1))), F.lit(0), step) % 10 == 0


def shown(found: Column, kinds: list[str]) -> Column:
    """kind:start:stop of spans (start, kind, stop), sorted, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def clear_of(more: Column, base: Column) -> Column:
    """The spans of ``more``, which don't overlap each other, that overlap none of ``base``; by sorting, not by pairs.

    In the order of base spans' starts and the others' stops, a span overlaps one before it if the furthest stop of the
    base spans so far lies beyond its start.
    """
    base_ends = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("late"), b["stop"].alias("stop"), F.lit(-1).alias("i")))
    more_ends = F.transform(more, lambda m, i: F.struct(m["stop"].alias("at"), F.lit(0).alias("late"), F.lit(0).alias("stop"), i.alias("i")))

    def kept(events: Column) -> Column:
        reach = running_max(F.transform(events, lambda e: e["stop"]))
        seen = bind(reach, lambda r: F.transform(events, lambda e, k: F.struct(e["i"].alias("i"), F.get(r, k).alias("reach"))))
        return F.transform(F.filter(seen, lambda x: (x["i"] >= 0) & (x["reach"] <= F.get(more, x["i"])["start"])), lambda x: F.get(more, x["i"]))

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(bind(F.array_sort(F.concat(base_ends, more_ends)), kept))


def replaced(text: Column, spans: Column, mask: str) -> Column:
    """The text with ``mask`` for each span (start, stop) of a sorted array; overlapping ones make one.

    The text is cut into pieces of BLOCK characters once, so that a place costs no walk from the text's start.
    """
    def cut(pieces: Column, start: Column, stop: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        some = F.array_join(F.slice(pieces, first + 1, F.floor((stop - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(stop > start, F.substring(some, start - first * BLOCK + 1, stop - start)).otherwise("")

    def joined(pieces: Column) -> Column:
        def around(reach: Column) -> Column:
            before = lambda k: F.coalesce(F.get(reach, k - 1), F.lit(0))
            parts = F.transform(spans, lambda s, k: F.when(s["start"] >= before(k), F.concat(cut(pieces, before(k), s["start"]), F.lit(mask))).otherwise(""))
            return F.concat(F.array_join(parts, ""), cut(pieces, F.element_at(reach, -1), F.char_length(text)))

        return bind(running_max(F.transform(spans, lambda s: s["stop"])), around)

    return F.when(F.size(spans) > 0, bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), joined)).otherwise(text)
