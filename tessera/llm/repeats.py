"""Exact removal of repeated byte strings by prefix-free parsing.

Rolling hashes choose triggers: of every 100-byte window the 32-byte string of least hash. Consecutive windows with one
trigger make a phrase, which overlaps the next by 99 bytes, so no phrase begins another of its trigger's by accident
and a phrase holds whole every window that starts in it. The dictionary, the distinct phrases, is dealt by trigger, as
equal windows have one trigger at one place. A phrase that the parse has before is a repeat in all its windows. Where a
trigger has several phrases, the suffix array of their bytes is built to a depth of 100, equal suffixes in the order of
the parse: so the windows stand in corpus order, and each that agrees in 100 bytes with the one before it (a longest
common prefix of 100 or more) is a repeat.

No trigger's phrases need to fit one task. Parts of the parse that a frequent trigger makes large are dealt again by
phrase, and a trigger of many phrases is dealt by what stands around it: the windows that hold the trigger in their
first half by the trigger and the bytes after it, the others by the bytes before it and the trigger, again and again
until a key has few phrases or all 100 bytes are in the key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_text, kept, release, scratch, table, written

#: Bytes of a repeat, of a trigger; bytes of phrases that a reduce group should hold; characters parsed at once.
LONG, GRAM, GROUP_BYTES, CHUNK = 100, 32, 6_000_000, 400_000
#: Phrases of a trigger (or of a longer key) that one task compares; bytes compared at once; entries of a blob; how far
#: above the mean, and above how many bytes, a part of the parse is dealt again.
MANY, AT_ONCE, ENTRIES, SKEW, SKEW_BYTES = 4096, 1 << 19, 1024, 4, 1_000_000
SPAN = LONG - GRAM + 1
M1, M2, M3 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
BYTES = (np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
ENTRY = np.dtype([("ref", "<u2"), ("lo", "<u4"), ("len", "u1"), ("a", "u1", 5), ("s", "<i8")])
MARK = np.dtype([("ref", "<u2"), ("lo", "<u4"), ("len", "u1")])


def _join(x: np.ndarray, step: int) -> np.ndarray:
    """Hashes of strings twice as long; the last ``step`` places hold nothing of use."""
    y = x * M1
    y[: len(x) - step] += x[step:]
    y ^= y >> np.uint64(31)
    y *= M2
    y ^= y >> np.uint64(29)
    return y


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and 64 bytes from each place."""
    x = BYTES[data]
    for step in (1, 2, 4, 8, 16):
        x = _join(x, step) if len(x) > step else x
    return x, _join(x, 32) if len(x) > 32 else x


def least_places(h: np.ndarray) -> np.ndarray:
    """For each place the leftmost of the least hashes among SPAN places from it (whole windows only)."""
    v, p, size = h, np.arange(len(h), dtype=np.int64), 1
    while size < SPAN:
        step = min(size, SPAN - size)
        n = len(v) - step
        if n <= 0:
            return np.empty(0, np.int64)
        right = v[step : step + n] < v[:n]
        p = np.where(right, p[step : step + n], p[:n])
        v = np.minimum(v[:n], v[step : step + n])
        size += step
    return p


def phrases(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: each phrase's text, first place, number of windows, trigger hash and own hash."""
    none = np.empty(0, np.int64)
    if len(data) < LONG:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h32, h64 = grams(data)
    place = least_places(h32)[: len(data) - LONG + 1]
    text = np.searchsorted(ends, np.arange(len(place)), side="right")
    valid = np.arange(len(place)) + LONG <= ends[np.minimum(text, len(ends) - 1)]
    where = np.flatnonzero(valid)
    if not len(where):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.r_[True, (place[where[1:]] != place[where[:-1]]) | (text[where[1:]] != text[where[:-1]])]
    lo = where[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(where)])
    size = count + LONG - 1
    own = (h64[lo] * M1 + h64[lo + (size - 64) // 2]) * M2 + h64[lo + size - 64] * M3 + size.astype(np.uint64)
    own ^= own >> np.uint64(32)
    trigger = h32[place[lo]] * M3
    return text[lo], lo, count, trigger ^ (trigger >> np.uint64(32)), own


def _blobs(part: np.ndarray, first: np.ndarray, found: tuple[np.ndarray, ...], base: np.ndarray, o: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """part, blob of entries in the order of their parts; those that are ``first`` of their phrase are ENTRYs and the others MARKs."""
    text, lo, count, trigger, own = found
    blobs, which = [], []
    edge = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (first[1:] != first[:-1]), True]) if len(lo) else np.zeros(1, np.int64)
    for x, y in zip(edge[:-1], edge[1:]):
        for a in range(x, y, ENTRIES):
            b = min(y, a + ENTRIES)
            mine, ref = np.unique(text[a:b], return_inverse=True)
            rows = np.zeros(b - a, ENTRY if first[a] else MARK)
            rows["ref"], rows["lo"], rows["len"] = ref, lo[a:b] - base[text[a:b]], count[a:b]
            if first[a]:
                rows["a"] = trigger[a:b].view(np.uint8).reshape(-1, 8)[:, :5]
                rows["s"] = own[a:b].view(np.int64)
            sizes = [len(mine), b - a, 0] if first[a] else [len(mine), 0, b - a]
            blobs.append(b"".join([np.array(sizes, "<u4").tobytes(), o[mine].tobytes(), at[mine].tobytes(), rows.tobytes()]))
            which.append(part[a])
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _read(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A blob's document ids, text hashes, entries and marks."""
    nd, n1, n2 = np.frombuffer(raw, "<u4", 3).tolist()
    ids, at = np.frombuffer(raw, np.int64, nd, 12), np.frombuffer(raw, np.int64, nd, 12 + 8 * nd)
    return ids, at, np.frombuffer(raw, ENTRY, n1, 12 + 16 * nd), np.frombuffer(raw, MARK, n2, 12 + 16 * nd + n1 * ENTRY.itemsize)


def _trigger(one: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(one), 8), np.uint8)
    wide[:, :5] = one["a"]
    return wide.view(np.int64).ravel()


def _parsed(docs: DataFrame, parts: int) -> DataFrame:
    """part, blob: phrases dealt by trigger. A phrase that a batch has before is a repeat and goes along as a mark, in
    any part."""

    def pack(rank: np.ndarray, o: np.ndarray, at: np.ndarray, found: tuple[np.ndarray, ...], base: np.ndarray) -> pa.RecordBatch:
        text, lo, count, trigger, own = found
        part = ((trigger >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((lo, rank[text], own, trigger, part))
        found = tuple(x[order] for x in found)
        trigger, own, part = found[3], found[4], part[order]
        first = np.r_[True, (trigger[1:] != trigger[:-1]) | (own[1:] != own[:-1])] if len(order) else np.empty(0, bool)
        part[~first] = int(at[0]) % parts if len(at) else 0
        order = np.lexsort((part, first))
        return _blobs(part[order], first[order], tuple(x[order] for x in found), base, o, at)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for f in frames:
            o, at, more = (f.column(k).to_numpy() for k in range(3))
            held, size = [], 0
            for k in range(len(o) + 1):
                if held and (k == len(o) or size > CHUNK or len(held) > 60_000):
                    raw = [f.column(3)[i].as_py().encode("utf-8") for i in held]
                    ends = np.cumsum([len(r) for r in raw])
                    base = np.r_[0, ends[:-1]]
                    mine = np.array(held)
                    rank = np.empty(len(mine), np.int64)
                    rank[np.lexsort((at[mine], o[mine]))] = np.arange(len(mine))
                    yield pack(rank, o[mine], at[mine], phrases(np.frombuffer(b"".join(raw), np.uint8), ends), base)
                    held, size = [], 0
                if k < len(o):
                    # A copy of a text that this task has had under a smaller id adds nothing.
                    a, i = (int(at[k]), int(more[k])), int(o[k])
                    if seen.get(a, i + 1) <= i:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[a] = i
                    held.append(k)
                    size += len(f.column(3)[k].as_py())
        release()

    return docs.select("o", "at", "bt", "text").mapInArrow(batches, "part long, blob binary")


def _spread(blobs: DataFrame) -> DataFrame:
    """Blobs with parts that are far larger than the mean dealt again, by phrase, to parts with numbers below zero."""
    sizes = blobs.groupBy("part").agg(F.sum(F.octet_length("blob")).alias("n"))
    total, held = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(SKEW * total // max(held, 1), SKEW_BYTES)
    large = sizes.filter(F.col("n") > least).agg(F.collect_list("part"), F.sum("n")).first()  # a fraction of 1/SKEW of the parts at most
    if not large[0]:
        return blobs
    again = 1 + large[1] // max(total // max(held, 1), SKEW_BYTES // SKEW)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for x in f.column(1):
                ids, at, one, two = _read(x.as_py())
                whole = np.r_[one["ref"].astype(np.int64), two["ref"].astype(np.int64)]
                lo, count = np.r_[one["lo"], two["lo"]].astype(np.int64), np.r_[one["len"], two["len"]].astype(np.int64)
                trigger = np.r_[_trigger(one), np.zeros(len(two), np.int64)].view(np.uint64)
                own = np.r_[one["s"], np.zeros(len(two), np.int64)].view(np.uint64)
                part = -1 - ((own * M1) >> np.uint64(33)).astype(np.int64) % again
                first = np.arange(len(part)) < len(one)
                order = np.lexsort((part, first))
                yield _blobs(part[order], first[order], tuple(v[order] for v in (whole, lo, count, trigger, own)), np.zeros(len(ids), np.int64), ids, at)

    hot = F.col("part").isin(large[0]) if len(large[0]) < 100 else F.array_contains(F.lit(sorted(large[0])), F.col("part"))
    return blobs.filter(~hot).unionByName(blobs.filter(hot).mapInArrow(batches, "part long, blob binary"))


def _resolved(blobs: DataFrame) -> DataFrame:
    """o, at, lo, len, trigger, many: repeats (trigger null) and first phrases of a trigger that has several; ``many``
    where it has more than one task should compare, or may have phrases in other parts."""

    def group(t: pa.Table) -> pa.Table:
        ids, ats, ones, twos, shift = [], [], [], [], 0
        for x in t.column("blob"):
            i, at, one, two = _read(x.as_py())
            ids.append(i)
            ats.append(at)
            ones.append((one["ref"].astype(np.int64) + shift, one["lo"].astype(np.int64), one["len"].astype(np.int64), _trigger(one), one["s"].astype(np.int64)))
            twos.append((two["ref"].astype(np.int64) + shift, two["lo"].astype(np.int64), two["len"].astype(np.int64)))
            shift += len(i)
        ids, ats = np.concatenate(ids), np.concatenate(ats)
        ref, lo, count, a, s = (np.concatenate(x) for x in zip(*ones))
        mref, mlo, mcount = (np.concatenate(x) for x in zip(*twos))
        part = t.column("part")[0].as_py()
        if part >= 0:  # only triggers met more than once
            some = np.argsort(a, kind="stable")
            same = np.zeros(len(a), bool)
            eq = a[some[1:]] == a[some[:-1]]
            same[1:] |= eq
            same[:-1] |= eq
            some = some[same]
            ref, lo, count, a, s = (x[some] for x in (ref, lo, count, a, s))
        order = np.lexsort((lo, ats[ref], ids[ref], s, a))
        ref, lo, count, a, s = (x[order] for x in (ref, lo, count, a, s))
        if len(a):  # a row that is there twice has its phrases once
            once = np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (ids[ref[1:]] != ids[ref[:-1]]) | (ats[ref[1:]] != ats[ref[:-1]]) | (lo[1:] != lo[:-1])]
            ref, lo, count, a, s = (x[once] for x in (ref, lo, count, a, s))
        fresh = np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])] if len(a) else np.empty(0, bool)
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        kinds = np.repeat(np.add.reduceat(fresh.astype(np.int64), starts), np.diff(np.r_[starts, len(a)])) if len(a) else starts
        asked = fresh & (kinds > 1) if part >= 0 else fresh
        again = ~fresh
        r = np.concatenate([mref, ref[again], ref[asked]])
        release()
        key = np.concatenate([np.zeros(len(mref) + again.sum(), np.int64), a[asked] * np.int64(1 << 20) + np.int64(part % (1 << 20))])
        null = np.zeros(len(r), bool)
        null[: len(mref) + again.sum()] = True
        many = np.zeros(len(r), bool)
        many[len(mref) + again.sum() :] = (kinds[asked] > MANY) | (part < 0)
        return pa.table({
            "o": pa.array(ids[r]), "at": pa.array(ats[r]), "lo": pa.array(np.concatenate([mlo, lo[again], lo[asked]]).astype(np.int32)),
            "len": pa.array(np.concatenate([mcount, count[again], count[asked]]).astype(np.int32)), "trigger": pa.array(key, pa.int64(), mask=null), "many": pa.array(many),
        })

    return blobs.groupBy("part").applyInArrow(group, "o long, at long, lo int, len int, trigger long, many boolean")


def _packed(docs: DataFrame) -> DataFrame:
    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for f in frames:
            for k in range(0, f.num_rows, 1000):
                part = f.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([z.compress(t.as_py().encode("utf-8")) for t in part.column(2)], pa.binary())], ["o", "at", "z"])
        release()

    return docs.select("o", "at", "text").mapInArrow(pack, "o long, at long, z binary")


PIECE = "key long, o long, at long, lo int, raw binary, pos int, held int"


def halves(raw: bytes, pos: int, held: int) -> Iterator[tuple[int, int, bytes, int, int]]:
    """A piece of consecutive windows that all hold the ``held`` bytes at ``pos``, dealt by more bytes: (key, first
    window, bytes, pos, held) of the windows that have those in their first half, with the bytes after them, and of
    the others, with the bytes before them. Equal windows go the same way and have one key."""
    rest = LONG - held
    half, count = rest // 2, len(raw) - LONG + 1
    low = max(0, pos - half)
    if low < count:
        yield xxhash.xxh3_64_intdigest(raw[pos : pos + LONG - half], 2 * held) - (1 << 63), low, raw[low:], pos - low, LONG - half
    high = min(count, pos - half)
    if high > 0:
        at = pos - half - 1
        yield xxhash.xxh3_64_intdigest(raw[at : pos + held], 2 * held + 1) - (1 << 63), 0, raw[: high + LONG - 1], at, held + half + 1


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 7
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "o", "at", "lo", "raw", "pos", "held"])


def _cut(met: DataFrame) -> DataFrame:
    """The bytes of the phrases asked for: whole under their trigger, those of a trigger of many phrases in halves."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for f in frames:
            rows, size = [], 0
            for o, at, packed, asked in zip(*[f.column(k).to_pylist() for k in range(4)]):
                raw = z.decompress(packed)
                for x in asked:
                    lo, phrase = x["lo"], raw[x["lo"] : x["lo"] + x["len"] + LONG - 1]
                    if x["many"]:
                        trigger = int(np.argmin(grams(np.frombuffer(phrase, np.uint8))[0][:SPAN]))
                        rows += [(k, o, at, lo + s, part, p, h) for k, s, part, p, h in halves(phrase, trigger, GRAM)]
                    else:
                        rows.append((x["trigger"], o, at, lo, phrase, 0, 0))
                    size += len(phrase)
                if size > 8_000_000:
                    yield _pieces(rows)
                    rows, size = [], 0
            yield _pieces(rows)
        release()

    return met.select("o", "at", "z", "asked").mapInArrow(batches, PIECE)


def _halved(pieces: DataFrame) -> DataFrame:
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            yield _pieces([(k, o, at, lo + s, part, p, h) for o, at, lo, raw, pos, held in zip(*[f.column(c).to_pylist() for c in range(1, 7)]) for k, s, part, p, h in halves(raw, pos, held)])

    return pieces.select("key", "o", "at", "lo", "raw", "pos", "held").mapInArrow(batches, PIECE)


def _ordered(value: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by value, then by place, and whether each value differs from the one before."""
    if bits == 21:  # value and place fit one number: sorting numbers is several times faster than sorting by them
        both = np.sort((value << np.uint64(21)) | place.astype(np.uint64))
        order, value = (both & np.uint64((1 << 21) - 1)).astype(np.int64), both >> np.uint64(21)
    else:
        by = np.argsort(value, kind="stable")
        order, value = place[by], value[by]
    new = np.ones(len(order), bool)
    new[1:] = value[1:] != value[:-1]
    return order, new


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of phrases laid end to end, ``ends`` naming each place's: the places of whole windows, ordered by their 100 bytes
    and then by place, and whether each has a common prefix of 100 bytes with the one before.

    Ranks by the first 5 bytes are doubled to 10, 20, 40 and 80, and those of 80 bytes 20 apart give 100.
    """
    bits = 21 if len(data) < 1 << 21 else 32
    room = ends - np.arange(len(data))
    place = np.flatnonzero(room >= 5)
    value = np.zeros(len(place), np.uint64)
    for k in range(5):
        value = (value << np.uint64(8)) | data[place + k].astype(np.uint64)
    rank = np.zeros(len(data), np.uint64)
    order, new = _ordered(value, place, bits)
    for depth, step in ((10, 5), (20, 10), (40, 20), (80, 40), (LONG, 20)):
        rank[order] = np.cumsum(new).astype(np.uint64)
        place = np.flatnonzero(room >= depth)
        order, new = _ordered((rank[place] << np.uint64(bits)) | rank[place + step], place, bits)
    return order, ~new


def _suffixes(pieces: DataFrame, parts: int) -> DataFrame:
    """o, at, lo, len: runs of windows that a phrase of the same key has earlier in the parse."""

    def group(t: pa.Table) -> pa.Table:
        key, o, at, lo = (t.column(k).to_numpy() for k in ("key", "o", "at", "lo"))
        raw = pa.concat_arrays([c for c in t.column("raw").chunks])
        edge = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        bytes_, begin, size = np.frombuffer(raw.buffers()[2], np.uint8), edge[:-1], np.diff(edge)
        rows = np.lexsort((lo, at, o, key))  # the order of the parse within each key
        once = np.r_[True, (np.diff(key[rows]) != 0) | (np.diff(o[rows]) != 0) | (np.diff(at[rows]) != 0) | (np.diff(lo[rows]) != 0)]
        rows = rows[once]  # each phrase once
        first = np.flatnonzero(np.r_[True, np.diff(key[rows]) != 0])
        upto = np.r_[np.cumsum(size[rows])[np.r_[first[1:] - 1, len(rows) - 1]]]
        out: list[tuple[np.ndarray, ...]] = []
        k = 0
        while k < len(first):
            done = upto[k - 1] if k else 0
            n = max(k + 1, int(np.searchsorted(upto, done + AT_ONCE, side="right")))
            mine = rows[first[k] : first[n] if n < len(first) else len(rows)]
            width = size[mine]
            stop = np.cumsum(width)
            data = bytes_[np.repeat(begin[mine] - (stop - width), width) + np.arange(stop[-1])]
            places, again = suffix_array(data, np.repeat(stop, width))
            gone = np.sort(places[again])
            row = np.searchsorted(stop, gone, side="right")
            new = np.r_[True, (row[1:] != row[:-1]) | (gone[1:] != gone[:-1] + 1)] if len(gone) else np.empty(0, bool)
            who = mine[row[new]]
            length = np.diff(np.r_[np.flatnonzero(new), len(gone)])
            out.append((o[who], at[who], lo[who] + (gone[new] - (stop - width)[row[new]]), length))
            k = n
        cols = [np.concatenate(c) for c in zip(*out)]
        release()
        return pa.table({"o": pa.array(cols[0]), "at": pa.array(cols[1]), "lo": pa.array(cols[2].astype(np.int32)), "len": pa.array(cols[3].astype(np.int32))})

    dealt = pieces.select("key", "o", "at", "lo", "raw").withColumn("p", F.pmod(F.xxhash64("key"), F.lit(parts)))
    return dealt.groupBy("p").applyInArrow(group, "o long, at long, lo int, len int")


def _compared(pieces: DataFrame, parts: int) -> DataFrame:
    """o, at, lo, len: repeats among the pieces' windows, those of keys with many pieces halved again and again.

    Windows whose key is all their bytes are equal: all but the first in the parse are repeats.
    """
    found = _suffixes(pieces.filter("held = 0"), parts)
    hot = pieces.filter("held > 0")
    while not hot.isEmpty():
        known = hot.join(hot.groupBy("key").agg(F.count("*").alias("n")), "key")
        few = F.col("n") <= MANY
        found = found.unionByName(_suffixes(known.filter(few), parts))
        whole = known.filter(~few & (F.col("held") == LONG))
        firsts = whole.groupBy("raw").agg(F.min(F.struct("o", "at", "lo")).alias("x")).select("x.*")
        found = found.unionByName(whole.join(firsts, ["o", "at", "lo"], "left_anti").select("o", "at", "lo", F.lit(1).alias("len")))
        hot = written(_halved(known.filter(~few & (F.col("held") < LONG))), "pieces")
    return found


def _kept(met: DataFrame) -> DataFrame:
    """o, at, n_removed, n_spans, kept: what is left of each text, marks applied."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for f in frames:
            removed, spans, kept = [], [], []
            for packed, marks in zip(f.column(2).to_pylist(), f.column(3)):
                raw = z.decompress(packed)
                if marks.is_valid and len(marks.values):
                    lo = marks.values.field(0).to_numpy().astype(np.int64)
                    hi = lo + marks.values.field(1).to_numpy() + (LONG - 1)
                    change = np.bincount(lo, minlength=len(raw) + 1)[: len(raw) + 1] - np.bincount(hi, minlength=len(raw) + 1)[: len(raw) + 1]
                    gone = np.cumsum(change[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["o", "at", "n_removed", "n_spans", "kept_sha256"])

    return met.select("o", "at", "z", "marks").mapInArrow(batches, "o long, at long, n_removed long, n_spans long, kept_sha256 string")


def _repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (o, at, doc_id, text), one line a distinct (o, at) with counts and whether it is its text's first, marks."""
    spark = docs.sparkSession
    text = clean_text()
    o = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(o.alias("o"), F.xxhash64(text).alias("at"), F.xxhash64(F.lit(1), text).alias("bt"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    base = rows.select("o", "at", "bt", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.octet_length("text") < LONG, F.sha2("text", 256)).alias("sha"))
    base = written(base, "texts")
    total = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total * 24 // 36 // GROUP_BYTES)
    long_ = rows.filter(F.octet_length("text") >= LONG)
    found = written(_resolved(_spread(written(_parsed(long_, parts), "parse"))), "marks")
    asked = found.filter("trigger IS NOT NULL").groupBy("o", "at").agg(F.collect_list(F.struct("lo", "len", "trigger", "many")).alias("asked"))
    pieces = written(_cut(_packed(long_).join(asked, ["o", "at"])), "pieces")
    more = written(_compared(pieces, parts), "marks")
    marks = found.filter("trigger IS NULL").select("o", "at", "lo", "len").union(more)
    lines = base.groupBy("o", "at", "bt").agg(F.count("*").alias("rows"), F.min("doc_id").alias("doc_id"), F.min("n_bytes").alias("n_bytes"), F.min("sha").alias("sha"))
    # Of equal texts, named by two hashes, the first has the least id; the others are found by it, not by their text.
    firsts = lines.groupBy("at", "bt").agg(F.min("o").alias("o")).withColumn("is_first", F.lit(True))
    lines = lines.join(firsts, ["o", "at", "bt"], "left").withColumn("is_first", F.coalesce("is_first", F.lit(False))).drop("bt")
    return rows, lines, marks


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    Every byte goes that lies in 100 bytes which also start earlier: in a row of smaller id, or earlier in the same
    text. A null text is empty; texts under 100 bytes lose nothing; a null id comes before all; of rows that share an id
    a text's hash decides which is earlier, and of equal rows all but one lose what a copy loses; an empty table gives
    an empty table; other columns are ignored.
    """
    with scratch(docs.sparkSession):
        rows, lines, marks = _repeats(docs)
        lines = kept(lines, "lines")
        listed = marks.groupBy("o", "at").agg(F.collect_list(F.struct("lo", "len")).alias("marks"))
        wanted = lines.filter(F.col("is_first") & (F.col("n_bytes") >= LONG)).select("o", "at").join(listed, ["o", "at"], "left")
        packed = _packed(rows.filter(F.octet_length("text") >= LONG)).join(wanted, ["o", "at"])
        left = kept(_kept(packed), "kept").dropDuplicates(["o", "at"])
    out = lines.join(left, ["o", "at"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    whole = F.col("is_first") & (F.col("copy") == 1)
    short = F.col("n_bytes") < LONG
    return out.select(
        "doc_id", "n_bytes",
        F.when(short, 0).when(whole, F.col("n_removed")).otherwise(F.col("n_bytes")).cast("long").alias("n_removed"),
        F.when(short, 0).when(whole, F.col("n_spans")).otherwise(1).cast("long").alias("n_spans"),
        F.when(short, F.col("sha")).when(whole, F.col("kept_sha256")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("kept_sha256"),
    )


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
