"""Mixing sources to target weights along a low-discrepancy schedule.

Each source's documents, in a hashed order, make one circular stream of words, cut into blocks of equal length. A
golden-ratio sequence of points, mapped through the cumulative shares of the sources, says which source fills each slot
of the mix; the slots of a source, ranked, take its blocks in turn, so that any prefix of the mix is close to the
target weights. Every global rank is made of two levels of sums, so no source needs a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, clean_text, kept, scratch, table, written

WEIGHTS = (3, 1, 2)
#: Words of a block; hash buckets that a source's order is cut into; cells of the unit interval in the schedule.
BLOCK, BUCKETS, CELLS, CHUNK = 1024, 4096, 4096, 16384
#: The golden ratio's fraction times 2**32: the points are multiples of it modulo 2**32.
GOLDEN, UNIT = 2654435769, 1 << 32


def _order(doc_id: Column) -> Column:
    """60 bits that shuffle the documents, the same in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, ratio: tuple[int, int] = (3, 2), cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from one row a source.

    Sources by code point, null last, take the weights in turn and share ratio[0]/ratio[1] of all words; a target stops
    at ``cap`` times its source's size and the rest is shared anew by weight. Sources in the order of size over weight
    reach their cap first, so one pass over running sums finds the level of the others. A table of a row a source is
    all that is ordered in one task.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long"))
    # Exact integers: cap * size / weight compared after both are multiplied out by the product of the weights.
    by_weight = F.lit(1)
    for w in set(weights):
        by_weight = by_weight * w
    total = F.sum("source_size").over(everything)
    level = weighted.withColumns({"pool": total * ratio[0], "ceiling": F.col("source_size") * cap, "mark": (F.col("source_size") * cap * by_weight / F.col("weight")).cast("decimal(38,0)")})
    up_to = Window.orderBy("mark", F.col("source").isNull(), "source")
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    after = up_to.rowsBetween(0, Window.unboundedFollowing)
    rest = level.withColumns({"full": F.coalesce(F.sum("ceiling").over(before), F.lit(0)), "left": F.sum("weight").over(after)})
    # Capped while the shared level would lift this source over its ceiling, given that all before it are capped.
    capped = rest.withColumn("capped", (F.col("pool") - ratio[1] * F.col("full")) * F.col("weight") >= F.col("ceiling") * ratio[1] * F.col("left"))
    stop = F.min(F.when(~F.col("capped"), F.struct("mark", F.col("source").isNull().alias("none"), "source", (F.col("pool") - ratio[1] * F.col("full")).alias("share"), F.col("left").alias("left")))).over(everything)
    return capped.withColumn("stop", stop).select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("ceiling").cast("double"))
        .otherwise(F.col("weight").cast("double") * F.col("stop.share").cast("double") / (F.lit(float(ratio[1])) * F.col("stop.left").cast("double")))
        .alias("target"),
    )


def point(position: Column) -> Column:
    """position * GOLDEN modulo UNIT, in 16-bit limbs, so that no position overflows a long."""
    p = position % UNIT
    high = (F.shiftright(p, 16) * F.lit(GOLDEN)) % UNIT
    return ((high * 65536) + (p % 65536) * F.lit(GOLDEN)) % UNIT


def schedule(spark: SparkSession, shares: DataFrame) -> DataFrame:
    """source, rank (from 0), position of every slot; ``shares`` has source and its number of ``slots``.

    As many points as slots are drawn; of a source's points those beyond its slots go, and the few it lacks (the
    sequence's discrepancy, a handful whatever the length) follow at the end.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    cut = shares.withColumns({
        "high": F.sum("slots").over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        "all": F.sum("slots").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).withColumn("low", F.col("high") - F.col("slots")).filter("slots > 0")
    edge = lambda c: F.expr(f"(cast({c} AS decimal(20,0)) * {UNIT} + `all` - 1) div nullif(`all`, 0)")
    cut = cut.withColumns({"from": edge("low"), "to": edge("high")})
    cut = written(cut.select("source", "slots", "from", "to"), "shares")
    n = cut.agg(F.sum("slots")).first()[0] or 0
    width = UNIT // CELLS
    # A share below 1/UNIT has no points; all its slots follow at the end.
    cells = cut.filter("to > from").withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))))
    points = spark.range(n).select(F.col("id").alias("position"), point(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    drawn = points.join(cells, "cell").filter("point >= from AND point < to").withColumn("chunk", F.floor(F.col("position") / CHUNK))
    counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = written(counts, "slots")
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("position")) - 1
    ranked = drawn.withColumn("inside", inside).join(counts.withColumnRenamed("source", "s").withColumnRenamed("chunk", "c"), F.col("s").eqNullSafe(F.col("source")) & (F.col("c") == F.col("chunk")))
    ranked = ranked.select("source", (F.col("earlier") + F.col("inside")).alias("rank"), "position", "slots").filter("rank < slots").drop("slots")
    got = counts.groupBy("source").agg(F.sum("n").alias("got")).withColumnRenamed("source", "s")
    lacking = cut.join(got, F.col("s").eqNullSafe(F.col("source")), "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    tail = lacking.select("source", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank")).select("source", "rank", (F.lit(n) + F.col("rank")).alias("position"))
    return ranked.unionByName(tail)


def mix_sources(docs: DataFrame, ratio: tuple[int, int] = (3, 2), cap: int = 2, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, and row_<name> of columns to ``carry``, for every row of ``docs`` (doc_id, text, source).

    ``taken`` is how many of the document's words the mix takes, repeats counted; ``first_slot`` the first slot of the
    schedule that takes some (null: none). A null text is empty and takes nothing; a null source is one more source,
    after the others; rows that repeat, a null doc_id included, stay rows of their own and stand side by side in the
    order; an empty table gives an empty table; other columns are ignored. Runs agree.
    """
    spark = docs.sparkSession
    size = F.regexp_count(clean_text(), F.lit(WORD)).cast("long")
    keep = [docs[c].alias("row_" + c) for c in carry]
    base = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"), *keep)
    base = base.withColumn("key", _order(F.col("doc_id"))).withColumn("bucket", F.col("key") % BUCKETS)
    base = written(base, "sizes")
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = written(sums, "buckets")
    targets = written(source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), ratio, cap, weights), "targets")
    # Floating sums never decide what is taken: whole words of the target are.
    targets = targets.withColumn("words", F.floor("target")).withColumn("slots", F.ceil(F.col("words") / block).cast("long"))

    def named(df: DataFrame, **names: str) -> DataFrame:
        return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])

    place = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("offset", F.coalesce(F.sum("size").over(place), F.lit(0)))
    starts = named(sums.drop("n"), source="s", bucket="b")
    placed = placed.join(starts, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("bucket")))
    placed = placed.withColumn("offset", F.col("offset") + F.col("start")).drop("s", "b", "start", "key", "bucket")
    sized = placed.join(named(targets, source="s"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    sized = written(sized, "placed")
    # A source's stream unrolled: at pass p a document's words begin at offset + p * source_size.
    passes = sized.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    passes = passes.withColumn("begin", F.col("offset") + F.col("pass") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words"))).filter("begin < words")
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    slots = named(schedule(spark, targets.select("source", "slots")), source="s", rank="r")
    met = pieces.join(slots, (F.col("r") == F.col("rank")) & F.col("s").eqNullSafe(F.col("source")))
    words = F.least("end", (F.col("rank") + 1) * block) - F.greatest("begin", F.col("rank") * block)
    taken = met.groupBy("source", "offset").agg(F.sum(words).alias("taken"), F.min("position").alias("first_slot"))
    taken = named(taken, source="s", offset="o")
    # Only documents with words are found again by where they begin; an empty one may begin at the same word.
    out = sized.join(taken, F.col("s").eqNullSafe(F.col("source")) & (F.col("o") == F.col("offset")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", *["row_" + c for c in carry])


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: words taken over size, rounded half up; none of no words.

    Rows are found again by id and text, so those that repeat share their copies evenly. Null ids, texts and sources and
    empty tables as in :func:`mix_sources`; other columns, whatever their names, come along.
    """
    names = docs.columns
    hashed = F.xxhash64("text")
    with scratch(docs.sparkSession):
        found = mix_sources(docs.select("doc_id", "text", "source", hashed.alias("at")), carry=("at",))
        times = found.groupBy("doc_id", "row_at").agg(F.avg((F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")).alias("times"))
        times = times.select(F.col("doc_id").alias("i"), F.col("row_at").alias("a"), F.floor(F.col("times") + 0.5).cast("int").alias("times")).filter("times > 0")
        times = kept(times, "times")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col("doc_id").alias("id"), hashed.alias("hash"))
    met = rows.join(times, F.col("i").eqNullSafe(F.col("id")) & (F.col("a") == F.col("hash")))
    return met.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col(f"doc.`{c}`").alias(c) for c in names])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


#: The same rows from running sums and the exact schedule: the first floor(target) words of a source's circular stream
#: are taken, and a document's first word lies in the block, and so the slot, of its offset.
SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key % 4096, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o
  FROM base),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighted AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, sum(source_size) OVER () AS s FROM src),
level AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY 12 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_,
         sum(w) OVER (ORDER BY 12 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS left_
  FROM weighted),
capped AS (SELECT *, (3 * s - 2 * full_) * w >= 4 * source_size * left_ AS c FROM level),
stop AS (SELECT (3 * s - 2 * full_)::DOUBLE AS share, left_::DOUBLE AS left_ FROM capped WHERE NOT c ORDER BY 12 * source_size / w, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN c THEN (2 * source_size)::DOUBLE ELSE w::DOUBLE * (SELECT share FROM stop) / (2.0::DOUBLE * (SELECT left_ FROM stop)) END AS target FROM capped),
shares AS (SELECT source, (floor(target)::BIGINT + 1023) // 1024 AS slots FROM targets),
edges AS (
  SELECT *, sum(slots) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)::HUGEINT AS high, sum(slots) OVER ()::HUGEINT AS n FROM shares),
cuts AS (
  SELECT source, slots, n::BIGINT AS n, ((high - slots) * 4294967296 + n - 1) // n AS lo, (high * 4294967296 + n - 1) // n AS hi FROM edges WHERE slots > 0),
points AS (
  SELECT p AS position, p::HUGEINT * 2654435769 % 4294967296 AS point FROM (SELECT unnest(range(0, (SELECT max(n) FROM cuts))) AS p)),
drawn AS (
  SELECT source, slots, position, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS rank FROM points JOIN cuts ON point >= lo AND point < hi),
lacking AS (
  SELECT cuts.source, n, unnest(range(coalesce(got, 0), slots)) AS rank FROM cuts LEFT JOIN (SELECT source, count(*) AS got FROM drawn GROUP BY 1) g ON g.source IS NOT DISTINCT FROM cuts.source),
slots AS (
  SELECT source, rank, position FROM drawn WHERE rank < slots UNION ALL SELECT source, rank, n + rank FROM lacking)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(o + size, floor(target)::BIGINT) - o) + greatest(0, least(o + size, floor(target)::BIGINT - source_size) - o))::BIGINT AS taken,
       position AS first_slot
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
LEFT JOIN slots ON slots.source IS NOT DISTINCT FROM placed.source AND size > 0 AND o < floor(target)::BIGINT AND rank = o // 1024
"""
