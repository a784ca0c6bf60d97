"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts their common subsequences of three characters, gaps allowed, each discounted by the
length it spans; so an insult with inserted or missing characters stays close to the insult. Labels are of whole
documents: a toxic document has some toxic word, a clean one none. Training alternates between choosing each toxic
document's most telling word and fitting a linear SVM on the Nyström map of a few hundred landmark words. As a
landmark's kernel is a sum over subsequences, the fitted function folds into one table of a weight per subsequence,
which scores a word by lookups. A document scores by its most toxic words.
"""

from __future__ import annotations

import heapq
import pickle
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_text, table

#: Labelled documents of either class that training takes at most, the first by hash; landmarks; clean words of a fit,
#: and those that the hardest of them are sought among.
SAMPLE = {1: 1200, 0: 2400}
LANDMARKS, NEGATIVES, MINED, ROUNDS, SEED = 240, 6_000, 60_000, 3, 20
#: The least score of a word, and that of a text without one.
LOW = -3.0
#: Characters a subsequence may span; discount for each character skipped; longest unit, and the step of longer ones.
SPAN, DECAY, UNIT = 6, 0.6, 24
#: Codes of Latin letters, digits and ends, whose triples have numbers of their own; others' are hashed to HASHED more.
LETTERS, HASHED = 32, 1 << 20
SIZE = LETTERS**3 + HASHED
START, END = 30, 31
#: Categories of characters that separate: controls, invisible ones, spaces, punctuation.
GAPS = set("Cc Cf Zs Zl Zp Pc Pd Ps Pe Pi Pf Po".split())
#: Distinct words a worker remembers the scores of.
CACHED = 200_000
STEPS = [(a, b) for a, b in combinations(range(1, SPAN), 2)]

_spaced = re.compile(r"(?<!\S)(?:[^\W\d_][ \t]){2,}[^\W\d_](?!\S)")
_outer = re.compile(r"^[\W_]+|[\W_]+$")


@lru_cache(1)
def _codes() -> np.ndarray:
    """A code for every character: a to z 1 to 26, digits 27, other letters and signs 32 and up, each its own; 0 is a gap:
    controls, spaces and punctuation, and below 0x250 all signs."""
    out = np.arange(LETTERS, LETTERS + sys.maxunicode + 1, dtype=np.uint32)
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if "a" <= c <= "z":
            out[k] = 1 + k - ord("a")
        elif k < 0x250 and c.isdigit():
            out[k] = 27
        elif (k < 0x250 and not c.isalpha()) or unicodedata.category(c) in GAPS:
            out[k] = 0
    out[1], out[2] = START, END
    return out


def units(text: str) -> list[str]:
    """The lower-case words, and letters set apart by spaces joined to one."""
    text = text.lower()
    found = text.split()
    if _spaced.search(text):
        found += [m[0].replace(" ", "").replace("\t", "") for m in _spaced.finditer(text)]
    return found


def pieces(word: str) -> list[str]:
    word = _outer.sub("", word)
    if len(word) <= UNIT:
        return [word] if word else []
    return [word[k : k + UNIT] for k in range(0, len(word) - UNIT // 2, UNIT // 2)]


def _numbers(x: np.ndarray, y: np.ndarray, z: np.ndarray, latin: bool) -> np.ndarray:
    """The numbers of subsequences below SIZE: exact for codes below LETTERS, else by a hash of the three codes."""
    out = (x * LETTERS + y) * LETTERS + z
    if not latin:
        far = np.flatnonzero((x | y | z) >= LETTERS)
        mixed = ((x[far] << 42) | (y[far] << 21) | z[far]).astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[far] = LETTERS**3 + (mixed >> np.uint64(44)).astype(np.int64)
    return out


def entries(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the subsequences of all words: the word, the subsequence's number, its discount."""
    text = "".join([f"\x01{w}\x02" for w in words])
    flat = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    code = _codes()[flat]
    owner = np.cumsum(flat == 1) - 1
    who, which, weight = [], [], []
    n = len(code)
    wide = code.astype(np.int64)
    latin = code.max(initial=0) < LETTERS
    for a, b in STEPS:
        if n <= b:
            continue
        x, y, z = wide[: n - b], wide[a : n - b + a], wide[b:]
        ok = np.flatnonzero((owner[: n - b] == owner[b:]) & (x > 0) & (y > 0) & (z > 0))
        who.append(owner[ok])
        which.append(_numbers(x[ok], y[ok], z[ok], latin))
        weight.append(np.full(len(ok), DECAY ** (b - 2), np.float32))
    if not who:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.float32)
    return np.concatenate(who), np.concatenate(which), np.concatenate(weight)


def norms(n: int, who: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.sqrt(np.bincount(who, weight.astype(np.float64) ** 2, n)) + 1e-9


def folded(marks: list[str], alpha: np.ndarray) -> np.ndarray:
    """The table of a weight per subsequence that gives the sum of the landmarks' normalised kernels times ``alpha``."""
    who, which, weight = entries(marks)
    return np.bincount(which, weight * (alpha / norms(len(marks), who, weight))[who], SIZE)


class Model:
    """The folded table: score of a word = sum of its subsequences' weights over its norm, plus the offset."""

    def __init__(self, table: np.ndarray, offset: float):
        self.table, self.offset = table.astype(np.float32), offset
        self.slope, self.shift = np.zeros(3), 0.0  # of the class probability, from a text's features

    def words(self, words: list[str]) -> np.ndarray:
        out = []
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            who, which, weight = entries(part)
            out.append(np.bincount(who, weight * self.table[which], len(part)) / norms(len(part), who, weight) + self.offset)
        return np.concatenate(out) if out else np.empty(0)

    def features(self, texts: list[str], known: dict[str, float] | None = None) -> np.ndarray:
        """Of each text the highest and the third highest score of a word, repeats counted, and the log of its words."""
        known = {} if known is None else known
        if len(texts) > 100:
            return np.vstack([self.features(texts[k : k + 100], known) for k in range(0, len(texts), 100)])
        if len(known) > CACHED:
            known.clear()
        lists = [units(t) for t in texts]
        fresh = list({w for x in lists for w in x if w not in known})
        cut = [(w, p) for w in fresh for p in pieces(w)]
        known.update(dict.fromkeys(fresh, LOW))
        for (w, _), s in zip(cut, self.words([p for _, p in cut]).tolist()):
            if s > known[w]:
                known[w] = s
        out = np.empty((len(texts), 3))
        for k, words in enumerate(lists):
            top = heapq.nlargest(3, map(known.__getitem__, words)) if words else []
            top += [LOW] * (3 - len(top))
            out[k] = top[0], top[2], np.log1p(len(words))
        return np.clip(out, LOW, None)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.slope + self.shift, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Newton steps on the squared hinge loss; the last weight is the offset, hardly penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(30):
        on = y * (x @ w) < 1
        xa = x[on] * c[on, None]
        new = np.linalg.solve(np.diag(ridge) + xa.T @ x[on], xa.T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of the class probability, with smoothed targets so that separable data stay finite."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.diag([1e-1] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + ridge, x1.T @ (p - t) + ridge @ w)
        w = w - step * min(1.0, 5 / np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def grams(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[k : k + 6] for k in range(max(1, len(w) - 5))}


def _noisy(word: str, rng: np.random.Generator) -> str:
    """The word with a character inserted, or all set apart by a mark."""
    k = int(rng.integers(1, max(2, len(word))))
    kind = int(rng.integers(4))
    if kind == 0:
        return word[:k] + "-*._x"[int(rng.integers(5))] + word[k:]
    if kind == 1:
        return word[:k] + word[k - 1] + word[k:]
    return "-*._"[int(rng.integers(4))].join(word) if kind == 2 else word


def _signs(bags: list[list[str]], labels: np.ndarray) -> list[list[str]]:
    """Each toxic document's words that have one of its most telling runs of six characters: those whose share among
    toxic documents most exceeds that among clean ones, in standard errors."""
    bad = [b for b, k in zip(bags, labels) if k]
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    # A run in fewer than three toxic documents can't exceed by three standard errors, so it isn't kept.
    toxic = Counter()
    for b in bad:
        toxic.update({g for w in b for g in grams(w)})
    toxic = {g: n for g, n in toxic.items() if n > 2}
    clean = Counter()
    for b, k in zip(bags, labels):
        if not k:
            clean.update({g for w in b for g in grams(w) if g in toxic})

    def excess(g: str) -> float:
        p, q = (toxic[g] + 0.5) / (n1 + 1), (clean[g] + 0.5) / (n0 + 1)
        return (p - q) / np.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0)

    value = {g: excess(g) for g in toxic}
    out = []
    for b in bad:
        found = {g for w in b for g in grams(w) if g in value}
        if found:
            least = max(3.0, 0.5 * max(map(value.get, found)))
            best = {g for g in found if value[g] >= least}
            out.append([w for w in b if not best.isdisjoint(grams(w))])
    return out


def _fit_words(bags: list[list[str]], labels: np.ndarray, rng: np.random.Generator) -> Model:
    good = Counter(w for b, k in zip(bags, labels) if not k for w in b)
    clean = sorted(good)
    common = sorted(clean, key=lambda w: (-good[w], w))[: NEGATIVES // 6]
    clean = [clean[k] for k in rng.permutation(len(clean))[:MINED]]
    negatives = list(dict.fromkeys([*common, *clean[: NEGATIVES - len(common)]])) or ["a"]
    bad = [b for b, k in zip(bags, labels) if k and b]
    chosen = [w for ws in _signs(bags, labels) for w in ws] or [w for b in bad for w in b]
    for turn in range(ROUNDS):
        counted = Counter(chosen)
        positives = sorted(counted)
        varied = [v for w in positives for v in [_noisy(w, rng) for _ in range(3)]]
        marks = sorted(positives, key=lambda w: (-counted[w], w))[: LANDMARKS // 2]
        marks = sorted({*marks, *negatives[-(LANDMARKS - len(marks)) :]})
        who, which, weight = entries(marks)
        # A row for each subsequence of the landmarks; row 0 stands for all others.
        held = np.unique(which)
        row = np.zeros(SIZE, np.int32)
        row[held] = 1 + np.arange(len(held))
        basis = np.zeros((1 + len(held), len(marks)), np.float32)
        np.add.at(basis, (row[which], who), weight)
        basis /= norms(len(marks), who, weight)
        gram = np.zeros((len(marks), len(marks)))
        for k in range(0, len(basis), 2048):
            part = basis[k : k + 2048].astype(np.float64)
            gram += part.T @ part
        values, vectors = np.linalg.eigh(gram)
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        words = [*positives, *varied, *negatives]
        kernel = []
        for k in range(0, len(words), 250):
            part = words[k : k + 250]
            who, which, weight = entries(part)
            order = np.argsort(who, kind="stable")
            who, rows = who[order], basis[row[which[order]]] * weight[order, None]
            out = np.zeros((len(part), len(marks)))
            if len(who):
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                out[who[first]] = np.add.reduceat(rows, first, axis=0)
            kernel.append(out / norms(len(part), who, weight[order])[:, None])
        x = np.vstack(kernel) @ root
        signs = np.r_[np.ones(len(positives) + len(varied)), -np.ones(len(negatives))]
        heavy = np.sqrt([min(counted[w], 100) for w in positives])
        cost = 4 * np.r_[heavy, np.repeat(heavy, 3) * 0.3, np.sqrt([min(good[w], 100) for w in negatives])]
        w = _svm(x, signs, cost)
        model = Model(folded(marks, root @ w[:-1]), float(w[-1]))
        if turn < ROUNDS - 1:
            known = {w for b in bad for w in b}
            known = dict(zip(known, model.words(list(known)).tolist()))
            chosen = [w for b in bad for top in [max(map(known.get, b))] if top > -0.3 for w in b if known[w] > max(0.0, top - 0.5) or known[w] == top]
            chosen = chosen or [max(b) for b in bad]
            hard = model.words(clean)
            worst = [clean[k] for k in np.argsort(-hard, kind="stable")[: NEGATIVES // 3]]
            negatives = list(dict.fromkeys([*negatives[: NEGATIVES - len(worst)], *worst]))
    return model


def train(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled texts; one class alone gives a constant one, its share of the labels the probability."""
    y = np.array(labels, float)
    if len(y) < 4 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 2)
        model = Model(np.zeros(SIZE), 0.0)
        model.shift = float(np.log(p / (1 - p)))
        return model
    bags = [sorted({p for w in set(units(t)) for p in pieces(w)}) for t in texts]
    half = np.empty(len(y), bool)
    for k in (0, 1):  # halves of either class
        half[y == k] = np.arange((y == k).sum()) % 2 == 0
    rng = np.random.default_rng(SEED)
    seen, of = [], []
    for part in (half, ~half):  # the probability is fitted on words' scores by the half that a text isn't in
        if y[part].min() < y[part].max():
            model = _fit_words([b for b, k in zip(bags, part) if k], y[part], rng)
            seen.append(model.features([t for t, k in zip(texts, part) if not k]))
            of.append(y[~part])
    model = _fit_words(bags, y, rng)
    if not seen:
        seen, of = [model.features(texts)], [y]
    model.slope, model.shift = _logistic(np.vstack(seen), np.concatenate(of))
    return model


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the rows of ``labels`` (doc_id, toxic) that are not held out and their texts.

    A bounded sample: of either class the first documents by the hash of their id, ``SAMPLE`` says how many.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.filter(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.struct(F.xxhash64("doc_id"), F.col("doc_id"))
    taken = None
    for toxic, most in SAMPLE.items():
        part = marked.filter(F.col("toxic") == toxic).orderBy(order).limit(most)
        taken = part if taken is None else taken.unionByName(part)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), clean_text().alias("text"))
    rows = texts.join(F.broadcast(taken), "doc_id").withColumn("all", F.lit(0))  # at most as many ids as SAMPLE has

    def learn(t: pa.Table) -> pa.Table:
        first = {}
        for d, text, toxic in sorted(zip(*[t.column(k).to_pylist() for k in ("doc_id", "text", "toxic")])):
            first.setdefault(d, (text, toxic))
        model = train([x for x, _ in first.values()], [k for _, k in first.values()])
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # The sample is one group, so training is one task and the driver gets the table of weights alone.
    found = rows.groupBy("all").applyInArrow(learn, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else train([], [])


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (double, 0 to 1) in a column named ``into``, from ``text`` alone, whole.

    Null and empty texts score as a text without words; repeated rows score alike; empty tables stay empty. A column
    of ``docs`` that has the name already is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of SIZE weights
    kept = docs.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())])
    at = kept.columns.index("text")

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        fitted = shared.value
        for frame in frames:
            texts = frame.column(at)
            out = []
            for k in range(0, len(texts), 100):
                out.append(fitted.probability(fitted.features([t or "" for t in texts.slice(k, 100).to_pylist()], known)))
            scores = pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*frame.columns, scores], [*frame.schema.names, into])

    return kept.mapInArrow(batches, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); ``labels`` has doc_id, toxic.

    A null doc_id counts as not held out.
    """
    model = fit(docs, labels)
    rows = score(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), model)
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
