"""Secret scans by a battery of randomness tests, in column expressions alone.

Contract patterns give spans that always stay. Other long tokens are tested: an encoding is inferred (hexadecimal,
base 32, base 64, letters and digits), then three statistics are taken over its alphabet: chi-squared distance from
uniform use, the number of runs of letters and digits, and the correlation of neighbouring characters. Each is compared
with what ordinary text of the same length and alphabet would give, the three are combined to one p-value, and
Benjamini and Hochberg's procedure within each class of lengths keeps the share of false discoveries below ``RATE``.
The driver sees a histogram of p-values of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, clean_text, table, written
from .spans import clear_of, matches, replaced, shown

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "random"]
PATTERNS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
#: Tokens that the battery tests; at least this long, with a letter and a digit. Only a token's own characters bar an end;
#: signs of equality pad it where no more of them and no token follow.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Inferred encodings in the order they are tried: what the token must be, and its alphabet's size.
ENCODINGS = [
    (r"^(?:[0-9]++|[a-z]++|[A-Z]++)$", 0), (r"^(?:[0-9a-f]++|[0-9A-F]++)$", 16), (r"^[A-Z2-7]++={0,2}$", 32), (r"^[a-z0-9]++$", 36),
    (r"^[A-Za-z0-9]++={0,2}$", 62), (r"", 64),
]
RATE = 0.01
#: Ordinary text: the chance that two of its characters agree is this much above 1/alphabet (that of English letters, 0.0667,
#: less 1/26); the chance that a letter follows a digit or the other way round (names with a number or date, of one change
#: in eight characters); the correlation of neighbours.
EXCESS, SWITCH, NEIGHBOURS = 0.028, 0.12, 0.0
#: Classes of lengths, by their least length; bins of -log10 p and their width.
LENGTHS = [20, 24, 32, 40, 64, 128]
BINS, WIDTH = 400, 0.05


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a logistic fit that is within 2e-4."""
    return 1 / (1 + F.exp(F.least(F.lit(1.5976) * z + F.lit(0.070566) * z * z * z, F.lit(600.0))))


def _tested(m: Column) -> Column:
    token = m["value"]
    core = F.regexp_replace(token, "=+$", "")
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, size in reversed(ENCODINGS[:-1]):
        alphabet = F.when(F.regexp_like(token, F.lit(pattern)), size).otherwise(alphabet)

    def measure(c: Column) -> Column:
        n, a = F.char_length(c).cast("double"), alphabet.cast("double")
        letters = F.split(c, "")
        squares = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, x: s + F.pow(n - F.char_length(F.replace(c, x, F.lit(""))), F.lit(2.0)))
        chi = a / n * squares - n
        # Of ordinary text, agreement q = 1/a + EXCESS: mean and spread of the statistic over n characters.
        q = 1 / a + EXCESS
        mean, spread = a * (1 - q) + n * a * EXCESS, F.sqrt(2 * a + 4 * n * a * EXCESS)
        uniform = (mean - chi) / spread
        classes = F.regexp_replace(F.regexp_replace(c, "[A-Za-z+/_-]", "a"), "[0-9]", "0")
        switches = F.char_length(F.regexp_replace(classes, "a+|0+", "x")) - 1
        runs = (switches - (n - 1) * SWITCH) / F.sqrt((n - 1) * SWITCH * (1 - SWITCH))
        codes = F.transform(letters, lambda x: F.ascii(x).cast("double"))

        def serial(v: Column) -> Column:
            mid = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
            over = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mid) * (x - mid))
            both = F.aggregate(F.zip_with(v, F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(1))), lambda x, y: F.coalesce((x - mid) * (y - mid), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
            return F.when(over > 0, both / over).otherwise(F.lit(1.0))

        r = bind(codes, serial)
        # Chance alone moves the correlation by 1/sqrt(n); beyond three times that the token is no random string.
        plain = (F.abs(r) > 3 / F.sqrt(n)) | (chi - (a - 1) > 4 * F.sqrt(2 * (a - 1))) | (alphabet == 0)
        z = (uniform + runs + (NEIGHBOURS - F.abs(r)) * F.sqrt(n) * 0.25) / math.sqrt(3)
        p = F.when(plain, F.lit(1.0)).otherwise(_upper_tail(z))
        return F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.char_length(token).alias("size"), p.alias("p"), alphabet.alias("alphabet"))

    return bind(core, measure)


def _level(size: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(LENGTHS):
        out = F.when(size >= least, k).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    """Bins of -log10 p, rounded down: a p-value counts as the largest of its bin."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / WIDTH), F.lit(BINS - 1)).cast("int")


def thresholds(counts: list[tuple[int, int, int]]) -> list[int]:
    """For each class of lengths the lowest bin whose tokens are discoveries; BINS where none are."""
    out = []
    for k in range(len(LENGTHS)):
        mine = {b: n for level, b, n in counts if level == k}
        total, seen, best = sum(mine.values()), 0, BINS
        for b in sorted(mine, reverse=True):
            seen += mine[b]
            if 10 ** (-b * WIDTH) <= RATE * seen / total:
                best = b
        out.append(best)
    return out


def _base(text: Column) -> Column:
    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(BASE.index(kind)).alias("kind"), m["stop"].alias("stop")))

    assigned = F.filter(matches(text, PATTERNS["assign"], group=1), lambda m: F.char_length(m["part"]) >= 6)
    return F.concat(of("assign", assigned), of("access", matches(text, PATTERNS["access"])), of("hex", matches(text, PATTERNS["hex"])))


def _found(rows: DataFrame) -> DataFrame:
    """Columns ``base`` and ``more`` added to rows with ``text``: spans, and tested tokens outside them."""
    text = F.col("text")
    tokens = F.filter(matches(text, TOKEN), lambda m: F.regexp_like(m["value"], F.lit("[0-9]")) & F.regexp_like(m["value"], F.lit("[A-Za-z]")))
    found = rows.withColumns({"base": _base(text), "more": F.transform(tokens, _tested)})
    return found.withColumn("more", clear_of(F.col("more"), F.col("base")))


def _discovered(found: DataFrame) -> DataFrame:
    """``more`` cut to what false-discovery control lets pass, over all rows."""
    tested = found.select(F.explode("more").alias("m")).groupBy(_level(F.col("m.size")).alias("level"), _bin(F.col("m.p")).alias("bin")).agg(F.count("*").alias("n"))
    least = F.array(*map(F.lit, thresholds([tuple(r) for r in tested.collect()])))  # at most classes x BINS rows
    return found.withColumn("more", F.filter("more", lambda m: _bin(m["p"]) >= F.get(least, _level(m["size"]))))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base: array of (start, kind, stop), more: array of (start, stop, size, p, alphabet) of discoveries.

    For every row of ``docs`` (doc_id, text); positions are code points, ends exclusive; ``kind`` indexes ``KINDS``. A
    null text is empty and has no spans; repeated rows, null ids and an empty table are kept as they are; other columns
    are ignored. Tokens that overlap a contract span aren't tested.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), clean_text().alias("text"))
    return _discovered(written(_found(rows).drop("text"), "secrets"))


def masked(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret's span replaced in ``text``; overlapping spans make one.

    Null stays null, repeated rows and other columns, whatever their names, are kept as they are."""
    names = docs.columns
    found = _found(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")))
    found = _discovered(written(found.select("row", "text", "base", "more"), "secrets"))
    spans = F.array_sort(F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop"))),
        F.transform("more", lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop")))))
    text = replaced(F.col("text"), spans, mask)
    return found.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in names])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")
    more = F.transform("more", lambda m: F.struct(m["start"].alias("start"), F.lit(len(BASE)).alias("kind"), m["stop"].alias("stop")))
    return found.select("doc_id", *map(of, range(len(BASE))), F.sha2(shown(F.col("base"), KINDS), 256).alias("base_sha256"), shown(F.concat(F.col("base"), more), KINDS).alias("spans"))
