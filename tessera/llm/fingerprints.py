"""Document fingerprints by threshold-scaled sketches, in column expressions alone.

A sketch keeps every hash of a five-word shingle below a fixed fraction of the hash range, and the least hash, so that
no text with words has an empty one. Sketches of parts merge by union, and the share of one's hashes in the other
estimates containment however unequal the documents are.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, bind, clean_text, table

#: One in SCALE hashes is kept; words of a shingle.
SCALE, WORDS = 8, 5
#: Rows of a range of ids that one task orders; ranges at most.
RANGE_ROWS, RANGES = 2000, 65536
LEAST = -(1 << 63)


def sketch(text: Column) -> Column:
    """Sorted distinct hashes of a text's shingles under the threshold, and the least; a text without words has none.

    Words are runs of anything but ASCII white space, as they stand; fewer than five make one shingle.
    """
    limit = F.lit(LEAST + (1 << 64) // SCALE)

    def hashed(words: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - (WORDS - 1), F.lit(1)))
        hashes = F.transform(at, lambda k: F.xxhash64(F.slice(words, k, WORDS)))
        kept = bind(hashes, lambda h: bind(F.array_min(h), lambda low: F.filter(h, lambda x: (x < limit) | (x == low))))
        return F.when(F.size(words) == 0, F.array().cast("array<long>")).otherwise(F.array_sort(F.array_distinct(kept)))

    return bind(F.filter(F.split(text, SPACES + "+"), lambda w: w != ""), hashed)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller sketch's shingles that the larger has; of an empty one, none."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(both, F.least(F.size(a), F.size(b)).cast("double")), F.lit(0.0))


def fingerprint(text: Column) -> Column:
    return as_text(sketch(text))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.hex(h)), ",")


def _ranges(ids: DataFrame) -> tuple[list[int], dict[int, int], int]:
    """Ascending ids that cut the rows into ranges of about RANGE_ROWS, at most RANGES of them; of an id that has several
    ranges' rows itself, how many; and how many ranges the rows without an id make."""
    n, some = ids.agg(F.count("*"), F.count("doc_id")).first()
    k = max(1, min(RANGES, some // RANGE_ROWS))
    found = ids.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 100 * k)).first()[0] if k > 1 else []
    times = Counter(found or [])
    return sorted(times), {x: m for x, m in times.items() if m > 1}, max(1, min(RANGES, (n - some) // RANGE_ROWS))


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the id: in two steps, through every 256th bound; -1 without an id."""
    if not bounds:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0))
    groups = [bounds[k : k + 256] for k in range(0, len(bounds), 256)]
    low = F.array(*[F.lit(g[0]) for g in groups])
    all_groups = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    below = lambda a: F.size(F.filter(a, lambda x: x <= doc_id))
    major = below(low)
    return F.when(doc_id.isNull(), F.lit(-1)).when(major == 0, F.lit(0)).otherwise((major - 1) * 256 + below(F.get(all_groups, major - 1)))


def _place(doc_id: Column, name: Column, hot: dict[int, int], nulls: int) -> Column:
    """Within a range the part: rows of an id that has several ranges' rows, and rows without one, are dealt by the order
    of their texts' names; what follows such an id comes after."""
    dealt = lambda k: F.floor((F.shiftright(name, 32) + (1 << 31)) * k / (1 << 32)).cast("int")
    out = F.when(doc_id.isNull(), dealt(F.lit(nulls)))
    if hot:
        times = F.get(F.array(*[F.lit(m) for _, m in sorted(hot.items())]), F.array_position(F.array(*[F.lit(x) for x in sorted(hot)]), doc_id).cast("int") - 1)
        out = out.when(times.isNotNull(), dealt(times))
    return out.otherwise(F.lit(RANGES))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, a (its sketch), and ``next`` and ``c``, text and sketch of the document that follows by id (of the
    last: the first's).

    Null ids come first; rows of one id follow each other by a hash of their text, then by text. Ids are cut into ranges
    by their quantiles, those of many rows by that hash too, each ordered by itself, and the first row of each range also
    goes to the range before it, so one exchange suffices.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), clean_text().alias("text"))
    named = rows.withColumn("h", F.xxhash64("text"))
    ids = rows.select("doc_id")
    bounds, hot, nulls = _ranges(ids)
    at = lambda df: df.withColumn("r", _range_of(F.col("doc_id"), bounds)).withColumn("q", _place(F.col("doc_id"), F.col("h"), hot, nulls))
    firsts = at(named.select("doc_id", "h")).groupBy("r", "q").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")).alias("first")).orderBy("r", "q").collect()  # a row a range
    before = [(x["first"]["doc_id"], x["first"]["h"], firsts[k - 1]["r"], firsts[k - 1]["q"], k == 0) for k, x in enumerate(firsts)]
    wanted = docs.sparkSession.createDataFrame(before, "id long, name long, br int, bq int, last boolean")
    # A row a range, at most twice RANGES: safe to broadcast.
    extra = named.join(F.broadcast(wanted), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("name") == F.col("h")))
    extra = extra.select("doc_id", "text", "h", F.col("br").alias("r"), F.col("bq").alias("q"), F.when(F.col("last"), 2).otherwise(1).alias("copy"))
    own = at(named).withColumn("copy", F.lit(0))
    order = Window.partitionBy("r", "q").orderBy("copy", F.col("doc_id").isNotNull(), "doc_id", "h", "text")
    both = own.unionByName(extra).withColumn("a", sketch(F.col("text")))
    out = both.withColumns({"next": F.lead("text").over(order), "c": F.lead("a").over(order)})
    return out.filter("copy = 0").select("doc_id", "text", "a", "next", "c")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, contained_edited.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many first ones of the next
    document, or all of them. A null text is empty; an empty text's fingerprint is an empty string, like only to
    another's; rows of one id follow each other by a hash of their text, a null id comes before all; an empty table gives an empty
    table; other columns are ignored.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next", half)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", sketch(F.col("edited")).alias("b"), "c")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), containment(F.col("a"), F.col("b")).alias("contained_edited"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
