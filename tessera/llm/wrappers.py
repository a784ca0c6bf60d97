"""HTML extraction by inferred wrappers.

A page is a stream of text blocks, each named by the path of its open elements. All distinct streams of a host's pages
are aligned into one union-free regular expression: what repeats becomes a repeated group, what some pages lack an
optional one, and every leaf is a slot. Each page is matched against the expression, which gives a slot to each of its
blocks. Over all distinct pages the wrapper then knows of every slot whether its text ever changes, how much text it
has and how much of that is links. Slots are the wrapper's own, not the article's, where their text never changes, where
they are mostly short links, or where an element or a name says menu, footer, comments and the like. Of the others those
inside an article or main element come first, then those in the innermost container that holds most of the text, then
the rest; a page's text are its blocks of the best kind that it has.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Expressions of a host that one step merges; what the steps gave is merged again until one is left.
MERGED = 64
#: Pages that must agree on a slot's text, and differ outside menus and the like, before it counts as the wrapper's own.
CONSTANT = 3
#: A container holds most of a host's text from this share on; a slot is links when this share of it is, in blocks of so
#: few characters on average.
MOST, LINKS, SHORT = 0.6, 0.6, 80

RAW = "script style noscript template iframe svg textarea title select object math".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OUT_TAGS = set("nav aside footer form menu button head header dialog".split())
OUT_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|side-?bar|footer|site-?header|masthead|breadcrumbs?|cookies?|notices?|consent|popup|modal|newsletter|subscribe|share|social|related|comments?|replies|respond|login|search|widget|toolbar|pagination|copyright)(?:$|[-_\s])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
SPACE = re.compile(r"\s+")
DIGIT = re.compile(r"\d")
HEADING = re.compile(r"h[1-6](?:$|[#.@])")


@lru_cache(20_000)
def _name(names: str) -> str:
    """The names of a class, id or role attribute without those that hold digits, which number one page's elements."""
    return " ".join([x for x in names.split() if not DIGIT.search(x)])


def blocks(page: str, links: list[float] | None = None) -> list[tuple[str, str]]:
    """(path, text) of a page's blocks of text in order; character references decoded, white space single, no markup.

    The share of each block that is links goes to ``links``.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    where, at, n, linked, link = "", 0, len(page), 0, False

    def end() -> None:
        nonlocal linked
        if text:
            line = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if line:
                out.append((where, line))
                if links is not None:
                    links.append(linked / max(1, sum(map(len, text))))
            text.clear()
            linked = 0

    while at < n:
        m = TOKEN.match(page, at)
        if not m:  # a tag that never ends
            text.append(page[at])
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            if not text:
                where = ">".join([s for _, s in stack])
            text.append(m[4])
            linked += len(m[4]) if link else 0
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            close = RAW_END[tag].search(page, at)
            at = close.end() if close else n
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                link = not m[1]
            continue
        end()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
        while stack and stack[-1][0] in SIBLINGS.get(tag, ()):
            stack.pop()
        names = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[3])} if m[3] else {}
        step = tag + "".join(f"{mark}{_name(names[k])}" for k, mark in (("id", "#"), ("class", "."), ("role", "@")) if names.get(k) and _name(names[k]))
        if not m[3].endswith("/"):
            stack.append((tag, step))
    end()
    return out


def outside(path: str) -> bool:
    """Whether a path leads through a menu, header, footer, sidebar, notice, advert, form or comments."""
    for step in path.split(">"):
        tag, *names = re.split(r"[#.@]", step)
        if tag in OUT_TAGS or any(OUT_NAMES.search(x) for x in names):
            return True
    return False


def inside(path: str) -> bool:
    return any(re.split(r"[#.@]", s)[0] in ("article", "main") or s.endswith("@main") for s in path.split(">"))


def _tandem(codes: np.ndarray, size: int) -> bool:
    """Whether some run of ``size`` items is followed by itself."""
    same = np.r_[False, codes[size:] == codes[:-size], False]
    edge = np.flatnonzero(same[1:] != same[:-1])
    return bool(len(edge)) and int((edge[1::2] - edge[::2]).max()) >= size


def collapse(stream: list) -> list:
    """Tandem repeats as groups ("+", ...), shortest first, until none is left."""
    items, again = list(stream), True
    while again:
        again, known = False, {}
        codes = np.array([known.setdefault(x, len(known)) for x in items], np.int64)
        if len(known) == len(items):
            break
        for size in range(1, 1 + len(items) // 2):
            if not _tandem(codes, size):
                continue
            k, out = 0, []
            while k < len(items):
                body, times = items[k : k + size], 1
                while len(body) == size and items[k + times * size : k + (times + 1) * size] == body:
                    times += 1
                if times > 1:
                    out.append(body[0] if size == 1 and body[0][0] == "+" else ("+", *body))
                    k += times * size
                else:
                    out.append(items[k])
                    k += 1
            items, again = out, True
            break
    return items


def bare(x: tuple) -> tuple:
    return x[1] if x[0] == "?" else x


def tight(items: list) -> list:
    """Neighbours that differ in marks alone are one repeated item."""
    core = lambda x: bare(x)[1:] if bare(x)[0] == "+" else (bare(x),)
    out: list = []
    for x in items:
        if out and core(out[-1]) == core(x):
            both = ("+", *core(x))
            out[-1] = ("?", both) if out[-1][0] == x[0] == "?" else both
        else:
            out.append(x)
    return out


def align(one: list, two: list) -> list:
    """One expression for both: what only one has is optional, an item that the other repeats is repeated."""
    plain = [bare(x) for x in (*one, *two)]
    repeated = {x[1:] for x in plain if x[0] == "+"}
    lift = lambda xs: [("?", lift([x[1]])[0]) if x[0] == "?" else ("+", x) if (x,) in repeated else x for x in xs]
    one, two = lift(one), lift(two)
    out: list = []
    for op, a, b, c, d in SequenceMatcher(None, [bare(x) for x in one], [bare(x) for x in two], autojunk=False).get_opcodes():
        if op == "equal":
            out += [x if x[0] == "?" else y for x, y in zip(one[a:b], two[c:d])]
        else:
            out += [x if x[0] == "?" else ("?", x) for x in (*one[a:b], *two[c:d])]
    return tight(out)


def written_out(items: list | tuple) -> str:
    """The expression as text."""
    def show(x) -> str:
        if x[0] == "=":
            return f"<{x[1]}>"
        return "(" + " ".join(map(show, x[1:])) + ")" + x[0]

    return " ".join(map(show, items))


def merged(expressions: list[list]) -> list:
    wrapper: list = []
    for k, items in enumerate(expressions):
        wrapper = items if k == 0 else align(wrapper, items)
    return wrapper


def infer(streams: list[list[str]]) -> list:
    return merged([collapse([("=", x) for x in s]) for s in streams])


def thawed(x) -> tuple:
    """An expression's item as read from JSON, hashable again."""
    return tuple(thawed(y) if isinstance(y, list) else y for y in x)


class Wrapper:
    """An expression as an automaton: its slots are its leaves from left to right, ``paths`` names each one's path."""

    def __init__(self, items: list):
        self.paths: list[str] = []
        self.follow: list[set[int]] = []
        _, self.first, _ = self._sequence(items)
        self.at: dict[str, list[int]] = {}
        for k, p in enumerate(self.paths):
            self.at.setdefault(p, []).append(k)

    def _sequence(self, items) -> tuple[bool, set[int], set[int]]:
        empty, first, last = True, set(), set()
        for x in items:
            if x[0] == "=":
                self.paths.append(x[1])
                self.follow.append(set())
                e, f, z = False, {len(self.paths) - 1}, {len(self.paths) - 1}
            else:
                e, f, z = self._sequence(x[1:])
                if x[0] == "+":
                    for k in z:
                        self.follow[k] |= f
                e = e or x[0] == "?"
            for k in last:
                self.follow[k] |= f
            first, last, empty = (first | f if empty else first), (last | z if e else z), empty and e
        return empty, first, last

    def match(self, stream: list[str]) -> list[int]:
        """The slot of each block of a stream, by the fewest steps that the expression doesn't have.

        The expression has every path of the streams it is made of. A step forward past others costs 1, one back 2.
        """
        if not stream:
            return []
        costs = {k: int(k not in self.first) for k in self.at[stream[0]]}
        back: list[dict[int, int]] = []
        for path in stream[1:]:
            new, via = {}, {}
            for k in self.at[path]:
                new[k], via[k] = min((c + (0 if k in self.follow[j] else 1 if j < k else 2), j) for j, c in costs.items())
            costs = new
            back.append(via)
        out = [min(costs, key=lambda k: (costs[k], k))]
        for via in reversed(back):
            out.append(via[out[-1]])
        return out[::-1]


class Matcher:
    """Slots of streams by the wrappers of many hosts; wrappers and matched streams are remembered, a bounded number."""

    def __init__(self):
        self.wrappers: dict[str, Wrapper] = {}
        self.known: dict[tuple, list[int]] = {}

    def wrapper(self, expression: str) -> Wrapper:
        if expression not in self.wrappers:
            if len(self.wrappers) > 2000:
                self.wrappers.clear()
            self.wrappers[expression] = Wrapper([thawed(x) for x in json.loads(expression)])
        return self.wrappers[expression]

    def slots(self, expression: str, stream: list[str]) -> list[int]:
        key = expression, tuple(stream)
        if key not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            self.known[key] = self.wrapper(expression).match(stream)
        return self.known[key]


def under(path: str, container: str) -> bool:
    return not container or path == container or path.startswith(container + ">")


def main_container(paths: list[str], mass: list[float]) -> str:
    """The innermost container that holds MOST of the mass; the whole page, an empty path, if none does."""
    held: dict[str, float] = {}
    for path, m in zip(paths, mass):
        steps = path.split(">")
        for k in range(1, len(steps)):
            outer = ">".join(steps[:k])
            held[outer] = held.get(outer, 0.0) + m
    total = sum(mass)
    return max([c for c, m in held.items() if total and m >= MOST * total], key=lambda c: (c.count(">"), c), default="")


def judge(paths: list[str], seen: dict[int, tuple[bool, float, float, int]]) -> list[int]:
    """What slots are, of their paths and what is ``seen`` of them over distinct pages: whether the text is always the
    same, its characters, those in links, and blocks. 3 in an article or main element, 2 in the container of most text,
    or a heading right above it, 1 elsewhere, 0 the wrapper's own."""
    kinds, mass = [], []
    for k, path in enumerate(paths):
        same, chars, linked, n = seen.get(k, (False, 0.0, 0.0, 1))
        own = outside(path) or (not inside(path) and (same or (linked > LINKS * chars and chars < SHORT * n)))
        kinds.append(0 if own else 3 if inside(path) else 1)
        mass.append(chars if kinds[-1] == 1 else 0.0)
    container = main_container(paths, mass)
    for k, path in enumerate(paths):
        outer, _, leaf = path.rpartition(">")
        if kinds[k] == 1 and (under(path, container) or (HEADING.match(leaf) and under(container, outer))):
            kinds[k] = 2
    return kinds


def article(kinds: list[int]) -> list[bool]:
    """Which blocks of a page are its article, of its blocks' slots as judged."""
    least = max([*kinds, 1])
    return [k >= least for k in kinds]


def _number(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def _merged(streams: DataFrame) -> DataFrame:
    """host, expression (JSON) of distinct (host, expression) rows: parts of a host are merged, then what they gave."""

    def merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            out = [json.dumps(merged([[thawed(x) for x in json.loads(e)] for e in sorted(es, key=lambda e: (-len(e), e))])) for es in f.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array(out, pa.string())], ["host", "expression"])

    while True:
        sizes = streams.groupBy("host").agg(F.count("*").alias("n"))
        if sizes.filter("n > 1").isEmpty():
            return streams
        part = F.pmod(F.xxhash64("expression"), F.ceil(F.col("n") / MERGED))
        parts = streams.join(sizes, "host").groupBy("host", part.alias("part")).agg(F.collect_list("expression").alias("expressions"))
        streams = written(parts.select("host", "expressions").mapInArrow(merge, "host string, expression string"), "expressions")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, expression (JSON), slots (JSON: each one's kind by :func:`judge`) of every host of ``pages`` (url, html)."""
    rows = pages.select(host_of(pages["url"]).alias("host"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    of_blocks = "paths array<string>, texts array<long>, sizes array<int>, links array<float>"

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, str] = {}
        left_out = lru_cache(10_000)(outside)
        for f in frames:
            streams, contents, paths, texts, sizes, links = [], [], [], [], [], []
            for h in f.column(1):
                linked: list[float] = []
                found = blocks(h.as_py(), linked)
                stream = tuple([p for p, _ in found])
                if stream not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[stream] = json.dumps(collapse([("=", p) for p in stream]))
                streams.append(known[stream])
                contents.append(_number(json.dumps([b for b in found if not left_out(b[0])]).encode()))
                paths.append(stream)
                texts.append([_number(t.encode("utf-8", "surrogatepass")) for _, t in found])
                sizes.append([len(t) for _, t in found])
                links.append(linked)
            yield pa.RecordBatch.from_arrays(
                [f.column(0), pa.array(streams, pa.string()), pa.array(contents, pa.int64()), pa.array(paths, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(links, pa.list_(pa.float32()))],
                ["host", "expression", "content", "paths", "texts", "sizes", "links"])

    seen = written(rows.mapInArrow(read, "host string, expression string, content long, " + of_blocks), "streams")
    found = _merged(written(seen.select("host", "expression").distinct(), "expressions"))
    kind = pa.struct([("slot", pa.int64()), ("text", pa.int64()), ("chars", pa.float64()), ("linked", pa.float64()), ("n", pa.int64())])

    def match(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher()
        for f in frames:
            slots = []
            for e, paths, *columns in zip(*[f.column(k).to_pylist() for k in range(1, 6)]):
                of: dict[int, list[tuple]] = {}
                for k, *block in zip(matcher.slots(e, paths), *columns):
                    of.setdefault(k, []).append(block)
                slots.append([
                    {"slot": k, "text": _number(b"".join([t.to_bytes(8, "little", signed=True) for t, _, _ in bs])), "chars": float(sum(n for _, n, _ in bs)), "linked": float(sum(n * a for _, n, a in bs)), "n": len(bs)}
                    for k, bs in of.items()])
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array(slots, pa.list_(kind))], ["host", "slots"])

    # Copies, which agree outside menus and the like, are one page: what never changes there would be all of it.
    unlike = seen.groupBy("host", "content").agg(F.min(F.struct("paths", "texts", "sizes", "links")).alias("x")).select("host", "x.*")
    met = unlike.join(found, "host").select("host", "expression", "paths", "texts", "sizes", "links")
    slots = met.mapInArrow(match, "host string, slots array<struct<slot:long,text:long,chars:double,linked:double,n:long>>")
    slots = slots.select("host", F.explode("slots").alias("s")).groupBy("host", "s.slot").agg(
        F.count("*").alias("pages"), F.min("s.text").alias("a"), F.max("s.text").alias("b"), F.sum("s.chars").alias("chars"), F.sum("s.linked").alias("linked"), F.sum("s.n").alias("n"))
    same = (F.col("pages") >= CONSTANT) & (F.col("a") == F.col("b"))
    # A row a slot of the expression, however many pages there are.
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("slot", same.alias("same"), "chars", "linked", "n")).alias("slots"))

    def fit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher()
        for f in frames:
            judged = [json.dumps(judge(matcher.wrapper(e).paths, {x["slot"]: (x["same"], x["chars"], x["linked"], x["n"]) for x in xs or []})) for e, xs in zip(f.column(1).to_pylist(), f.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), pa.array(judged, pa.string())], ["host", "expression", "slots"])

    both = found.join(slots, "host", "left").select("host", "expression", "slots")
    return written(both.mapInArrow(fit, "host string, expression string, slots string"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space within a block is one space, blocks stand one a line. A null html is
    empty and gives an empty text; a null url is one more host; repeated rows stay; an empty table gives an empty one;
    other columns are ignored; pages are read whole.
    """
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"), host_of(pages["url"]).alias("host"))
    known = wrappers(pages).select("host", "expression", "slots")

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, judged = Matcher(), {}
        for f in frames:
            texts = []
            for h, e, s in zip(f.column(2), f.column(3).to_pylist(), f.column(4).to_pylist()):
                if s not in judged:
                    if len(judged) > 2000:
                        judged.clear()
                    judged[s] = json.loads(s)
                found, good = blocks(h.as_py()), judged[s]
                kept = article([good[k] for k in matcher.slots(e, [p for p, _ in found])])
                texts.append("\n".join([t for (_, t), ok in zip(found, kept) if ok]))
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)["page_id"]
    met = rows.join(known, "host", "left").select("page_id", "url", "html", "expression", "slots")
    return met.mapInArrow(cut, f"page_id {kind}, url string, text string, n_chars long")


def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
