"""N-gram Jaccard join by parity sketches.

Every shingle of a document flips one bit of its sketch, so the Hamming distance of two sketches never exceeds the size
of the sets' symmetric difference. Sets that reach the threshold differ by at most (|A| + |B|) / 7 shingles. Within a
size band all sketches are cut into the same chunks, more than that many of them non-zero, so by the pigeonhole
principle two such sets agree in a non-zero chunk; what is joined is a prefix of each document's non-zero chunks in one
global order, chunks of frequent shingles last. The chunk's bits are too many to store (2**64), so its bit set is named
by the XOR of its bits' hashes. Candidates are pruned by the Hamming distance of short dense sketches and verified on
whole shingle sets.

Texts of one shingle set are one node, named by 128 bits. A small bucket of nodes that share a chunk gives its pairs; a
large one gives a star. After the verified links are resolved to components only large buckets that still hold several
are looked at: more stars join what hangs together; then, unless comparing what is left is cheap, their members are
bucketed again, alone, with the chunks of the largest buckets last in the order, so that they meet by chunks that fewer
share; and what is still in large buckets is compared pair by pair, tile by tile, in numpy. So no link is lost and no group's pairs are all written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graphs import roots as components

from .common import bounded_broadcasts, clean_text, kept, release, scratch, table, text_key, written

#: Words of a shingle; sets link when 100 * intersection >= 75 * union.
WORDS, PERCENT = 5, 75
#: Sizes of a band lie within a factor of 4; below FIRST every shingle is a chunk; shingles a chunk of the largest sets.
FIRST, FILL = 64, 2.0
#: Buckets up to this size give all their pairs; tiles of larger ones; bytes of chunk keys a reduce group should hold.
SMALL, TILE, GROUP_BYTES = 24, 2048, 16_000_000
#: Turns of stars and new orders before what is left in large buckets is compared pair by pair; or sooner, where that is no
#: more than so many pairs of sketches a document, less work than making its set.
TURNS, CHEAP = 2, 4000
#: Documents in the sample that says which shingles are frequent (an order of chunks, never a filter), and how many count as such.
SAMPLED, FREQUENT = 20_000, 200_000
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * K2
    x = (x ^ (x >> np.uint64(27))) * K3
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, known: Words) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    s = mix(h[:n] + np.uint64(min(len(h), WORDS) * int(K1) % 2**64))
    for k in range(1, min(WORDS, len(h))):
        s = mix(s * K1 + h[k : k + n])
    return np.unique(s)


def signature(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def sketch(s: np.ndarray) -> bytes:
    """Parity bits, at least two for each shingle: 64 or a larger power of two, at most 65,536."""
    bits = min(65536, max(64, 1 << int(2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((mix(s ^ K1) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """A longer sketch is folded to the length of the shorter."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), len(a)
    while n > len(b):
        n //= 2
        x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def most_apart(m: int, n: int) -> int:
    """The largest symmetric difference of sets of m and n that link."""
    return (m + n) * (100 - PERCENT) // (100 + PERCENT)


def near_pairs(n: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers x < y of sets, ascending in size ``n``, whose sketches are no farther apart than sets that link can be.

    Sketches of a length make a matrix; sets that link have sizes within a third, so lengths that are the same or next.
    """
    long_ = np.array([len(b) for b in sketches])
    matrix = {w: np.frombuffer(b"".join([b for b in sketches if len(b) == w]), "<u8").reshape(-1, w // 8) for w in np.unique(long_).tolist()}
    begin = {w: int(np.searchsorted(long_, w)) for w in matrix}  # lengths ascend as sizes do
    for w, a in matrix.items():
        for v in (w, 2 * w):
            if v in matrix:
                b = matrix[v] if v == w else matrix[v][:, : w // 8] ^ matrix[v][:, w // 8 :]
                step = max(1, 4_000_000 // max(1, len(b) * (w // 8)))
                for k in range(0, len(a), step):
                    apart = np.bitwise_count(a[k : k + step, None] ^ b[None]).sum(2, dtype=np.int64)
                    x, y = np.arange(k, min(k + step, len(a))) + begin[w], np.arange(len(b)) + begin[v]
                    both = n[x][:, None] + n[y][None]
                    ok = (apart <= both * (100 - PERCENT) // (100 + PERCENT)) & (x[:, None] < y[None]) & (100 * n[x][:, None] >= PERCENT * n[y][None])
                    i, j = np.nonzero(ok)
                    yield x[i], y[j]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both) > 0


def band(n: int) -> int:
    k = 0
    while n >= FIRST * 4**k:
        k += 1
    return k


def codes(key: np.ndarray, parts: int) -> np.ndarray:
    """What is kept of chunk keys: 40 bits, and the part that the others choose."""
    return ((key >> np.uint64(40)) % np.uint64(parts) << np.uint64(40)) | (key & np.uint64((1 << 40) - 1))


def among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def chunk_keys(s: np.ndarray, frequent: np.ndarray, parts: int = 1, last: np.ndarray = np.empty(0, np.uint64)) -> np.ndarray:
    """What the set is joined by: the first chunks of each of its bands, as 64-bit numbers.

    The order: chunks with a shingle that isn't frequent, other chunks, and those whose codes are in ``last``.
    """
    n = len(s)
    larger = n * 100 // PERCENT
    need = most_apart(n, larger) + 1
    common = among(frequent, s)
    out = []

    def first(key: np.ndarray, common: np.ndarray) -> np.ndarray:
        if len(key) <= need:
            return key
        turn = common.astype(np.int8)
        if len(last):
            turn[among(last, codes(key, parts))] = 2
        return key[np.lexsort((key, turn))[:need]]

    for k in {band(n), band(larger)}:
        spot = mix(s * K1 + np.uint64(k))  # the shingle's bit, as its chunk and the bit's hash
        single = n and k == 0
        if not single:
            chunks = int(FIRST * 4**k / FILL)
            where = (spot >> np.uint64(32)) * np.uint64(chunks) >> np.uint64(32)
            order = np.argsort(where, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(where[order]) > 0])
            value = np.bitwise_xor.reduceat(mix(spot ^ K2)[order], start)
            key = mix(value + where[order][start] * K3 + np.uint64(k))[value != 0]
            single = len(key) < need  # too few chunks: of two such sets, both are also joined shingle by shingle
            out.append(first(key, np.bitwise_and.reduceat(common[order], start)[value != 0]))
        if single:
            out.append(first(mix(spot + K1), common))
    return np.unique(np.concatenate(out))


class Blobs:
    """Chunk keys of sets dealt to ``parts`` groups: (part, blob) rows; of a key 40 bits are kept, what they confuse is
    verified."""

    def __init__(self, parts: int):
        self.parts, self.keys, self.sigs, self.sizes, self.held = parts, [], [], [], 0

    def add(self, keys: np.ndarray, sig: bytes, size: int) -> bool:
        """Whether it is time to write them."""
        self.keys.append(keys)
        self.sigs.append(sig)
        self.sizes.append(size)
        self.held += len(keys)
        return self.held > 500_000 or len(self.keys) >= 60_000

    def rows(self) -> tuple[np.ndarray, list[bytes]]:
        if not self.keys:
            return np.empty(0, np.int64), []
        k, o = np.concatenate(self.keys), np.repeat(np.arange(len(self.keys)), list(map(len, self.keys)))
        part = ((k >> np.uint64(40)) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        k, o, part = k[order], o[order], part[order]
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        names, sizes = np.frombuffer(b"".join(self.sigs), "V16"), np.array(self.sizes, np.uint32)
        blobs = []
        for a, b in zip(edge[:-1], edge[1:]):
            mine, ref = np.unique(o[a:b], return_inverse=True)
            blobs.append(b"".join([np.uint32(len(mine)).tobytes(), names[mine].tobytes(), sizes[mine].tobytes(), ref.astype(np.uint16).tobytes(), k[a:b].view(np.uint8).reshape(-1, 8)[:, :5].tobytes()]))
        self.keys, self.sigs, self.sizes, self.held = [], [], [], 0
        return part[edge[:-1]], blobs


def _sketched(docs: DataFrame, parts: int, frequent) -> DataFrame:
    """In one pass over docs (doc_id, text, at) two kinds of rows: doc_id, n, sig, sketch, at of every row, and part, blob
    of the sets' chunk keys."""
    schema = "doc_id long, n long, sig binary, sketch binary, at binary, part long, blob binary"
    names = ["doc_id", "n", "sig", "sketch", "at", "part", "blob"]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done, common, blobs = Words(), set(), frequent.value, Blobs(parts)

        def written_out() -> pa.RecordBatch:
            which, held = blobs.rows()
            none = [pa.nulls(len(held), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(which, pa.int64()), pa.array(held, pa.binary())], names)

        for whole in frames:
            for k in range(0, whole.num_rows, 2000):
                frame = whole.slice(k, 2000)
                n, sigs, bits = [], [], []
                for t in frame.column(1):
                    s = shingles(t.as_py() or "", known)
                    sig = signature(s)
                    n.append(len(s))
                    sigs.append(sig)
                    bits.append(sketch(s))
                    if len(s) and sig not in done:
                        if len(done) > 100_000:
                            done.clear()
                        done.add(sig)
                        if blobs.add(chunk_keys(s, common, parts), sig, len(s)):
                            yield written_out()
                none = [pa.nulls(len(n), t) for t in (pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bits, pa.binary()), frame.column(2), *none], names)
        yield written_out()
        release()

    return docs.mapInArrow(batches, schema)


def _frequent(docs: DataFrame, rows: int) -> np.ndarray:
    """Shingles in several of a bounded sample of documents; at most FREQUENT of them."""
    every = max(1, rows // SAMPLED)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(every)) == 0)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for frame in frames:
            found = [shingles(t.as_py() or "", known) for t in frame.column(1)]
            which, count = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(which.view(np.int64)), pa.array(count.astype(np.int64))], ["s", "n"])

    counts = some.mapInArrow(batches, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(4, SAMPLED // 4000))
    top = counts.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toPandas()["s"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def _bucketed(texts: DataFrame, parts: int, frequent, last) -> DataFrame:
    """part, blob of the sets of texts (sig, z), chunks with codes in ``last`` coming last."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, known, blobs = zstandard.ZstdDecompressor(), Words(), Blobs(parts)

        def written_out() -> pa.RecordBatch:
            which, held = blobs.rows()
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(held, pa.binary())], ["part", "blob"])

        for f in frames:
            for sig, raw in zip(f.column(0), f.column(1)):
                s = shingles(z.decompress(raw.as_py()).decode("utf-8", "surrogatepass"), known)
                if blobs.add(chunk_keys(s, frequent.value, parts, last.value), sig.as_py(), len(s)):
                    yield written_out()
        yield written_out()
        release()

    return texts.select("sig", "z").mapInArrow(batches, "part long, blob binary")


def _named(names: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(names), [None, pa.py_buffer(np.ascontiguousarray(names).tobytes())]).cast(pa.binary())


def _candidates(blobs: DataFrame) -> DataFrame:
    """a, b, key: pairs of nodes to compare (key null), and the members a of buckets that are too large for that (b null)."""

    def group(t: pa.Table) -> pa.Table:
        key, doc, names, sizes, shift = [], [], [], [], 0
        for x in t.column("blob"):
            raw = x.as_py()
            n = int.from_bytes(raw[:4], "little")
            at = 4 + 20 * n
            count = (len(raw) - at) // 7
            wide = np.zeros((count, 8), np.uint8)
            wide[:, :5] = np.frombuffer(raw, np.uint8, 5 * count, at + 2 * count).reshape(-1, 5)
            key.append(wide.view(np.int64).ravel())
            doc.append(np.frombuffer(raw, np.uint16, count, at).astype(np.int32) + shift)
            names.append(np.frombuffer(raw, "V16", n, 4))
            sizes.append(np.frombuffer(raw, np.uint32, n, 4 + 16 * n))
            shift += n
        key, doc, names, sizes = (np.concatenate(x) for x in (key, doc, names, sizes))
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        many = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        many[1:] |= same
        many[:-1] |= same
        key, doc = key[many], doc[many]
        # Sets by number, in the order of their names.
        halves = names.view(">u8").reshape(-1, 2)
        by = np.lexsort((halves[:, 1], halves[:, 0]))
        fresh = np.r_[True, (halves[by[1:]] != halves[by[:-1]]).any(1)] if len(by) else np.empty(0, bool)
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(fresh) - 1
        names, sizes, node = names[by[fresh]], sizes[by[fresh]].astype(np.int64), number[doc]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.empty(0, bool)
        key, node = key[new], node[new]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        length = np.diff(np.r_[edge, len(key)])
        pairs, hot = [np.empty((0, 2), np.int64)], [np.empty((0, 2), np.int64)]
        for m in range(2, SMALL + 1):
            start = edge[length == m]
            if len(start):
                i, j = np.triu_indices(m, 1)
                pairs.append(np.stack([(start[:, None] + i).ravel(), (start[:, None] + j).ravel()], 1))
        for a, m in zip(edge[length > SMALL], length[length > SMALL]):
            pairs.append(np.stack([np.full(m - 1, a), np.arange(a + 1, a + m)], 1))
            hot.append(np.stack([node[a : a + m], key[a : a + m]], 1))
        pairs, hot = node[np.concatenate(pairs)], np.concatenate(hot)
        p, q = sizes[pairs[:, 0]], sizes[pairs[:, 1]]
        pairs = pairs[100 * np.minimum(p, q) >= PERCENT * np.maximum(p, q)]
        pairs = np.unique(pairs[:, 0] * np.int64(len(names)) + pairs[:, 1])
        first, second = pairs // max(len(names), 1), pairs % max(len(names), 1)
        none = np.zeros(len(pairs) + len(hot), bool)
        none[: len(pairs)] = True
        b = pa.concat_arrays([_named(names[second]), pa.nulls(len(hot), pa.binary())])
        release()
        return pa.table({
            "a": _named(names[np.r_[first, hot[:, 0]]]), "b": b,
            "key": pa.array(np.r_[np.zeros(len(pairs), np.int64), hot[:, 1]], pa.int64(), mask=none),
            "part": pa.array(np.full(len(none), t.column("part")[0].as_py()), pa.int64()),
        })

    return blobs.groupBy("part").applyInArrow(group, "a binary, b binary, key long, part long")


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches are no farther apart than sets that link can be."""
    bits = nodes.select("sig", "n", "sketch")
    both = pairs.join(bits.toDF("a", "na", "sa"), "a").join(bits.toDF("b", "nb", "sb"), "b")

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            c = {k: f.column(k).to_pylist() for k in ("na", "nb", "sa", "sb")}
            keep = [hamming(x, y) <= most_apart(m, n) for m, n, x, y in zip(c["na"], c["nb"], c["sa"], c["sb"])]
            yield f.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(batches, "a binary, b binary")


def _texts(sigs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """sig, z: a compressed text of each set asked for."""
    needed = sigs.distinct().join(nodes.select("sig", "at"), "sig")

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for f in frames:
            for k in range(0, f.num_rows, 1000):
                part = f.slice(k, 1000)
                texts = [z.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], ["at", "z"])
        release()

    packed = docs.select("at", "text").mapInArrow(pack, "at binary, z binary")
    return written(packed.join(needed, "at").dropDuplicates(["sig"]).select("sig", "z"), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that link: both texts are brought together and their whole shingle sets compared."""
    texts = _texts(pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b"))), docs, nodes)
    both = pairs.join(texts.toDF("b", "zb"), "b").join(texts.toDF("a", "za"), "a")

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, known, sets = zstandard.ZstdDecompressor(), Words(), {}

        def of(sig: bytes, raw: bytes) -> np.ndarray:
            if sig not in sets:
                found = shingles(z.decompress(raw).decode("utf-8", "surrogatepass"), known)
                if len(sets) > 2000 or len(found) > 4000:  # long ones are few; they are made again
                    sets.clear()
                sets[sig] = found
            return sets[sig]

        for f in frames:
            keep = [linked(of(a.as_py(), x.as_py()), of(b.as_py(), y.as_py())) for a, x, b, y in zip(*[f.column(k) for k in ("a", "za", "b", "zb")])]
            yield f.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    return both.select("a", "b", "za", "zb").mapInArrow(batches, "a binary, b binary")


def _across(hot: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (a, root, and the number m) of large buckets that hold more than one component."""
    known = hot.join(roots.toDF("a", "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    mixed = known.groupBy("part", "key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).filter("x <> y").drop("x", "y")
    return known.join(mixed.hint("merge"), ["part", "key"])  # files of buckets are small, their rows many


def _starred(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's members with a member of its largest component, unless they are of that component.

    The member is the one of a pseudo-random rank that all buckets share, so buckets of the same group mostly agree.
    """
    parts = members.groupBy("part", "key", "root").agg(F.count("*").alias("n"), F.max(F.struct(F.xxhash64("a", F.lit(turn)), F.col("a"))).alias("first"))
    lead = parts.groupBy("part", "key").agg(F.max(F.struct("n", "first", "root")).alias("x")).select("part", "key", F.col("x.first.a").alias("lead"), F.col("x.root").alias("r"))
    pairs = members.join(lead.hint("merge"), ["part", "key"]).filter("root <> r")
    return pairs.select(F.least("a", "lead").alias("a"), F.greatest("a", "lead").alias("b")).distinct()


def _tiled(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of one bucket and different roots whose sketches are near enough, each tile against each.

    Of the buckets that two nodes share only the first by ``k`` gives their pair.
    """
    members = members.withColumn("k", F.xxhash64("part", "key"))
    members = members.join(members.groupBy("a").agg(F.collect_set("k").alias("ks")).hint("merge"), "a")  # no more than a node's chunk keys
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    rows = members.join(nodes.select(F.col("sig").alias("a"), "n", "sketch").hint("merge"), "a").withColumn("tile", F.pmod(F.xxhash64("a"), tiles).cast("int"))
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    rows = rows.withColumn("other", other).select("k", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "a", "root", "n", "sketch", "ks")

    def group(t: pa.Table) -> pa.Table:
        i, k = t.column("i")[0].as_py(), t.column("k")[0].as_py()
        one = t.column("j")[0].as_py() == i
        t = t.take(np.argsort(t.column("n").to_numpy(), kind="stable"))
        names, keys = t.column("a").to_pylist(), [set(x) for x in t.column("ks").to_pylist()]
        roots: dict[bytes, int] = {}
        root = np.array([roots.setdefault(r, len(roots)) for r in t.column("root").to_pylist()])
        n, tile, pairs = t.column("n").to_numpy(), t.column("tile").to_numpy(), []
        for x, y in near_pairs(n, t.column("sketch").to_pylist()):
            ok = (root[x] != root[y]) & (one | (tile[x] != tile[y]))
            pairs += [(min(names[u], names[v]), max(names[u], names[v])) for u, v in zip(x[ok].tolist(), y[ok].tolist()) if min(keys[u] & keys[v]) == k]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    return rows.groupBy("k", "i", "j").applyInArrow(group, "a binary, b binary").distinct()


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), clean_text().alias("text"), text_key().alias("at"))


def _largest(mixed: DataFrame) -> np.ndarray:
    """Codes of the largest buckets, at most FREQUENT."""
    top = mixed.groupBy("part", "key").agg(F.max("m").alias("m")).orderBy(F.desc("m"), "part", "key").limit(FREQUENT).toPandas()
    return np.sort((top["part"].to_numpy(np.uint64) << np.uint64(40)) | top["key"].to_numpy(np.uint64))


def jaccard_join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, sig, at) of ``docs`` (doc_id, text); verified links (a, b) of sets; (node, root) of linked sets.

    Rows of one shingle set have one ``sig``, 128 bits of the set's hash, and ``at`` is :func:`common.text_key`. Links are
    all those that decide the components: pairs in small buckets, stars in large ones, and there every pair that the stars
    leave in different components.
    """
    with scratch(docs.sparkSession), bounded_broadcasts(docs.sparkSession):
        base, links, roots = _joined(_prepared(docs))
        return kept(base.select("doc_id", "n", "sig", "at"), "sets"), kept(links, "links"), kept(roots, "roots")


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = docs.sparkSession
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    frequent = spark.sparkContext.broadcast(_frequent(docs, rows))  # at most FREQUENT numbers
    # About a shingle for 6 bytes of text, a chunk key of 7 bytes for every third.
    parts = min(1 << 22, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size * 7 // 18 // GROUP_BYTES))
    sketched = written(_sketched(docs, parts, frequent), "sets")
    base = sketched.filter("n IS NOT NULL").select("doc_id", "n", "sig", "sketch", "at")
    found = written(_candidates(sketched.filter("part IS NOT NULL").select("part", "blob")), "candidates")
    nodes = base.filter("n > 0").groupBy("sig").agg(F.min(F.struct("at", "n", "sketch")).alias("x")).select("sig", "x.*")
    nodes = written(nodes, "nodes")

    def checked(pairs: DataFrame) -> DataFrame:
        return written(_verified(written(_near(pairs, nodes), "near"), docs, nodes), "links")

    links = checked(found.filter("key IS NULL").select("a", "b").distinct())
    roots, last = components(links), np.empty(0, np.uint64)
    for turn in range(TURNS + 1):
        mixed = written(_across(found.filter("key IS NOT NULL").select("part", "key", "a"), roots), "mixed")
        if mixed.isEmpty():
            break
        # Stars around other members join most of what is left.
        links = links.union(checked(_starred(mixed, turn)))
        roots = components(links)
        mixed = written(_across(mixed.select("part", "key", "a"), roots), "mixed")
        if mixed.isEmpty():
            break
        pairs = mixed.groupBy("part", "key").agg(F.max("m").cast("double").alias("m")).agg(F.sum(F.col("m") * F.col("m"))).first()[0]
        if turn == TURNS or pairs <= CHEAP * rows:
            links = links.union(checked(_tiled(mixed, nodes)))
            roots = components(links)
            break
        # Any two of these that link meet again in the new order, in a bucket that is small or still large.
        last = np.union1d(last, _largest(mixed))  # at most TURNS x FREQUENT numbers
        texts = _texts(mixed.select(F.col("a").alias("sig")), docs, nodes)
        found = written(_candidates(_bucketed(texts, parts, frequent, spark.sparkContext.broadcast(last))), "candidates")
        links = links.union(checked(found.filter("key IS NULL").select("a", "b").distinct()))
        roots = components(links)
    return base, links, roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links, the row's own included. A null text is empty; an empty
    one, or one of spaces alone, has no shingles and its own doc_id as component; rows that repeat stay; a row without
    a doc_id takes part, and where nothing it reaches has one its component is null; an empty table gives an empty
    table; other columns are ignored. Texts are taken whole.
    """
    base, _, roots = jaccard_join(docs)
    least = base.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    # These joins run in the caller's session; a row a set is too much for the driver.
    rooted = least.join(roots.toDF("sig", "root").hint("merge"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")).hint("merge"), "root").select("sig", "component_id")
    out = base.select("doc_id", "n", "sig").join(named.hint("merge"), "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same rows from all pairs that share a shingle, and components by labels that fall.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
  JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b WHERE 100 * both_ >= 75 * (u.n + v.n - both_)),
c(id, comp) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM d UNION
  (SELECT l.b, min(c.comp) FROM c JOIN l ON l.a = c.id JOIN recurring.c AS k ON k.id = l.b WHERE c.comp < k.comp GROUP BY 1))
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.comp AS component_id FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
