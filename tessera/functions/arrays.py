"""Array expressions: positions, running sums, and search in sorted literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, step) -> Column:
    """Inclusive running folds of an array of ints from 0 by an associative ``step``, in blocks, so that its length
    costs no square."""

    def within(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(step(x, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))))))

    def joined(bs: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(bs, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0))))
        return bind(within(ends), lambda off: F.flatten(F.transform(bs, lambda b, k: F.transform(b, lambda x: step(x, F.get(off, k))))))

    starts = lambda ns: F.sequence(F.lit(1), F.greatest(F.size(ns), F.lit(1)), F.lit(BLOCK))
    return bind(numbers, lambda ns: bind(F.transform(starts(ns), lambda k: within(F.slice(ns, k, BLOCK))), joined))


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array of ints."""
    return running(numbers, lambda x, y: x + y)


def running_max(numbers: Column) -> Column:
    """Inclusive running maxima of an array of non-negative ints."""
    return running(numbers, F.greatest)


def occurrences(text: Column, pattern: str) -> Column:
    """0-based starts of all occurrences of a string, overlapping ones too, in code points; none of an empty one.

    The text is cut before every occurrence by a zero-width split, so the cost is linear in its length.
    """
    none = F.array().cast("array<int>")
    if not pattern:
        return none
    quoted = "(?=\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E)"
    pieces = F.split(text, quoted, -1)
    ends = bind(pieces, lambda ps: F.slice(running_sums(F.transform(ps, lambda p: F.char_length(p))), F.lit(1), F.size(ps) - 1))
    first = F.when(F.startswith(text, F.lit(pattern)), F.array(F.lit(0))).otherwise(none)
    return F.when(F.contains(text, F.lit(pattern)), F.concat(first, ends)).otherwise(none)


def count_below(value: Column, ordered: list, inclusive: bool = False) -> Column:
    """How many of a sorted list of literals are below (or at) a value: two scans of a root of its length each."""
    if not ordered:
        return F.lit(0)
    width = max(1, int(len(ordered) ** 0.5))
    groups = [ordered[k : k + width] for k in range(0, len(ordered), width)]
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    test = (lambda x: x <= value) if inclusive else (lambda x: x < value)
    major = F.size(F.filter(lit([g[0] for g in groups]), test))
    inner = F.size(F.filter(F.get(F.array(*[lit(g) for g in groups]), major - 1), test))
    return F.when(major == 0, F.lit(0)).otherwise((major - 1) * width + inner)
