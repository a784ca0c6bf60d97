"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round finds the merge rank of every adjacent pair by
binary search over the sorted pair keys, takes each word's lowest rank, merges its occurrences and compacts the array;
words without a mergeable pair drop out. A worker keeps a bounded dictionary of the words it has met of late.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import clean_text, release, table

#: Words and characters that a worker remembers at most, beside those of the texts in hand; the ones longest unused go first.
CACHED_WORDS, CACHED_CHARS = 150_000, 3_000_000
#: Characters that are encoded at once, and rows whose texts become Python strings at once.
CHUNK_CHARS, CHUNK_ROWS = 500_000, 50
NONE = np.iinfo(np.int64).max
#: Runs of letters and digits that Unicode has assigned since version 16, first and last of each.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class WordBPE:
    """A word-level BPE model read from a tokenizers JSON file; picklable, made of arrays."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [""] * size
        for token, k in [*vocab.items(), *self.special.items()]:
            self.tokens[k] = token
        names = byte_alphabet()
        self.inner = np.array([vocab.get(c, -1) for c in names], np.int64)
        self.final = np.array([vocab.get(c + end, -1) for c in names], np.int64)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges), dtype=np.int64)
        self.base = np.int64(size)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], rank[order], made
        # Every occurrence of a pair may merge in one round unless a pair with its product ranks before it.
        first = np.full(size, NONE)
        np.minimum.at(first, left, rank)
        np.minimum.at(first, right, rank)
        self.at_once = first[made] > rank
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern, self.exact = pattern, self.without_newer(pattern)
        self.cut = "(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")"

    @staticmethod
    def without_newer(pattern: str) -> str:
        """The pattern with only the letters and digits that Unicode 16 has, as the library's."""
        listed = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)
        out = pattern.replace(r"[^\s\p{L}\p{N}]", "@")
        for c in "LN":
            out = out.replace(f"[\\p{{{c}}}]", f"[\\p{{{c}}}--[{listed}]]")
        return "(?V1)" + out.replace("@", rf"[[^\s\p{{L}}\p{{N}}]||[{listed}]]")

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and each word's number of ids."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(raw)), sizes)
        done_word, done_symbol, done_place = [], [], []
        place = np.arange(len(symbols))
        while len(symbols):
            same = np.empty(len(symbols), bool)
            same[-1] = False
            np.equal(word[1:], word[:-1], out=same[:-1])
            pair = np.full(len(symbols), -1, np.int64)
            pair[:-1] = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == pair), self.ranks[at], NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(word)])
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < NONE, lengths)
            if not live.all():
                done_word.append(word[~live])
                done_symbol.append(symbols[~live])
                done_place.append(place[~live])
                symbols, word, place, rank = symbols[live], word[live], place[live], rank[live]
                lengths, best = lengths[best < NONE], best[best < NONE]
                if not len(symbols):
                    break
                starts = np.cumsum(lengths) - lengths
            hit = rank == np.repeat(best, lengths)
            single = ~self.at_once[best]
            if single.any():  # only the leftmost occurrence
                where = np.flatnonzero(hit)
                firsts = where[np.r_[True, word[where[1:]] != word[where[:-1]]]]
                only = np.zeros(len(hit), bool)
                only[firsts] = True
                hit &= only | ~np.repeat(single, lengths)
            # Of a run of overlapping occurrences (x x x) every other one merges.
            where = np.flatnonzero(hit)
            if len(where) > 1 and (np.diff(where) == 1).any():
                run = np.r_[True, np.diff(where) != 1]
                begin = np.maximum.accumulate(np.where(run, where, 0))
                where = where[(where - begin) % 2 == 0]
            symbols = symbols.copy()
            symbols[where] = self.made[rank[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, word, place = symbols[keep], word[keep], place[keep]
        if not done_word:
            return np.empty(0, np.int64), sizes
        order = np.argsort(np.concatenate(done_place), kind="stable")
        owner = np.concatenate(done_word)[order]
        return np.concatenate(done_symbol)[order], np.bincount(owner, minlength=len(raw))


class Encoder:
    """Texts to ids and decoded strings, with a bounded memory of words."""

    def __init__(self, model: WordBPE):
        self.model = model
        self.plain, self.exact = regex.compile(model.pattern), regex.compile(model.exact)
        self.cut = regex.compile(model.cut) if model.special else None
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, bytes] = {}  # of words met since the last turn
        self.older: dict[str, bytes] = {}  # and of those met only before it
        self.held = 0

    def turn(self) -> None:
        """Once half of what may be remembered is new, words not met since the last turn go."""
        if len(self.ids) > CACHED_WORDS // 2 or self.held > CACHED_CHARS // 2:
            self.ids, self.older, self.held = {}, self.ids, 0

    def split(self, text: str) -> list[str]:
        """Pieces in order: special tokens as they stand, other text normalised and cut into words."""
        out: list[str] = []
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        for part in parts:
            if part in self.model.special:
                out.append(part)
            elif part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                try:
                    part.encode("latin-1")
                    words = self.plain
                except UnicodeEncodeError:
                    words = self.exact
                out += words.findall(part.lower())
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, str]]:
        """For each text: number of ids, ids as little-endian 32-bit integers, decoded text."""
        self.turn()
        pieces = [self.split(t) for t in texts]
        known, older, tokens = self.ids, self.older, self.model.tokens
        fresh = []
        for w in {w for p in pieces for w in p if w not in known}:
            self.held += len(w)
            if w in older:
                known[w] = older.pop(w)
            elif w in self.model.special:
                known[w] = np.array([self.model.special[w]], "<u4").tobytes()
            else:
                fresh.append(w)
        if fresh:
            ids, counts = self.model.encode_words(fresh)
            data, begin = ids.astype("<u4").tobytes(), 0
            for w, end in zip(fresh, np.cumsum(counts).tolist()):
                known[w] = data[4 * begin : 4 * end]
                begin = end
        for p in pieces:
            ids = b"".join([known[w] for w in p])
            yield len(ids) // 4, ids, " ".join([tokens[k] for k in np.frombuffer(ids, "<u4").tolist()])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("decoded", T.StringType()),
])


def _texts(column: pa.Array) -> Iterator[str]:
    for k in range(0, len(column), CHUNK_ROWS):
        yield from column.slice(k, CHUNK_ROWS).to_pylist()


def _chunks(texts: Iterable[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, so that working arrays stay small."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def _run(docs: DataFrame, path: str | None, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    with open(path or default_path(), encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(WordBPE(f.read()))  # as large as the vocabulary file, whatever the data

    def batches(frames):
        release()  # what the worker's earlier tasks have left
        encoder = Encoder(model.value)
        for frame in frames:
            ids, done = frame.column(0), 0
            for part in _chunks(_texts(frame.column(1))):
                rows = list(encoder.encode(part))
                n = pa.array([r[0] for r in rows], pa.int64())
                if digests:
                    a = pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string())
                    b = pa.array([hashlib.sha256(r[2].encode("utf-8")).hexdigest() for r in rows], pa.string())
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    a, b = pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())
                    names = ["doc_id", "n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(part)), n, a, b], names)
                done += len(part)
            release()
        encoder.forget()
        release()

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), clean_text().alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA
    return chosen.mapInArrow(batches, schema)


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers), decoded, for every row of ``docs`` (doc_id, text).

    ``path`` is a vocabulary file in the format of the tokenizers library (the driver reads it). A null or empty text
    has no ids and decodes to an empty string; a null doc_id stays null; repeated rows give repeated rows; other
    columns are ignored; an empty table gives an empty table. Texts are encoded whole, whatever their length.
    """
    return _run(docs, path, digests=False)


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As :func:`bpe_encode`, with SHA-256 digests of ids and decoded text made where the ids are."""
    return _run(docs, path, digests=True)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))
