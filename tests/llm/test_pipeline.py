"""The whole pipeline against a plain version: loops over rows, regular expressions and the tokenizers library."""

import hashlib
import re
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import components, secret_spans

from tessera.llm import bpe, secrets, toxicity

DATA = "/root/testdata/sf0.001"


def shuffled(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def taken_words(rows):
    """Of (doc_id, source, size) rows the words that the mix takes: the first of each source's circular stream."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    size = {s: sum(r[2] for r in by[s]) for s in sources}
    pool, free, target = 1.5 * sum(size.values()), set(sources), {}
    while free:
        level = pool / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * size[s]}
        for s in full or free:
            target[s] = 2 * size[s] if full else level * weight[s]
        pool -= sum(target[s] for s in full)
        free = free - full if full else set()
    out = {}
    for s in sources:
        at, words = 0, int(target[s] + 1e-9)
        for doc_id, _, n in sorted(by[s], key=lambda r: (shuffled(r[0]) % 4096, shuffled(r[0]), r[0])):
            out[doc_id] = sum(max(0, min(b + n, words) - b) for b in (at, at + size[s]))
            at += n
    return out


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]
    rows = [r for r in rows if model.probability(model.features([r[1]]))[0] < 0.5]
    first = {d: c for d, n, c in components([r[:2] for r in rows]) if n}
    rows = [r for r in rows if first.get(r[0], r[0]) == r[0]]
    more = {r["doc_id"]: [(m["start"], m["stop"]) for m in r["more"]] for r in secrets.secrets(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    masked = []
    for d, t, s in rows:
        out, at = "", 0
        for a, b in sorted([(a, b) for a, _, b in secret_spans(t)] + more[d]):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        masked.append((d, out + t[at:], s))
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, _ in masked}
    taken = taken_words([(d, s, size[d]) for d, _, s in masked])
    library, want = Tokenizer.from_file(bpe.default_path()), []
    for d, t, _ in masked:
        e = library.encode(t, add_special_tokens=False)
        want += [(d, len(e.ids), np.array(e.ids, "<u4").tobytes(), library.decode(e.ids, skip_special_tokens=False))] * int(taken[d] / max(size[d], 1) + 0.5)
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got) == sorted(want)


def test_one_of_each_group_stays_whatever_the_ids(spark):
    words = lambda k, n=60: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [
        (1, words(1)), (2, words(2)), (2, words(3)), (2, words(1)),  # an id with two unlinked texts and one linked to id 1
        (3, words(4)), (3, words(4)), (None, words(4)),  # equal rows, and a copy without an id
        (None, words(5)), (None, words(5)), (None, words(5) + " more"), (None, words(6)),  # copies without ids
        (None, ""), (4, None), (4, None),
    ]
    got = corpus_pipeline.keep_one_of_group(spark, spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string"), DATA)
    assert got.columns == ["doc_id", "text", "source"]
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    want = [(1, words(1)), (2, words(2)), (2, words(3)), (3, words(4)), (None, words(6)), (None, ""), (4, None), (4, None)]
    assert len(left) == len(want) + 1
    near = [r for r in left if r not in want]
    assert len(near) == 1 and near[0] in [(None, words(5)), (None, words(5) + " more")]
    assert sorted(map(repr, (r for r in left if r not in near))) == sorted(map(repr, want))


def test_stages_of_odd_rows_and_clashing_columns(spark, tmp_path):
    """Every stage on columns named as its helpers are, null and repeated ids, null texts, and an empty table."""
    extra = ["i", "a", "at", "times", "score", "row", "sig", "hash", "id", "doc", "size", "taken", "base", "more", "n", "toxicity", "last", "least"]
    text = lambda k: " ".join(f"word{k}n{j}" for j in range(40)) + (f" password=hunter{k}22" if k % 3 == 0 else "")
    rows = [(k, text(k), "s" if k % 2 else None, 1) for k in range(12)] + [(None, text(50), "s", 2), (None, None, None, None), (5, "", "s", 0), (6, None, "t", None), (7, text(60), "t", 3), (7, text(61), "t", 3), (8, text(62), "t", 3), (8, text(62), "t", 3)]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in extra)
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], schema)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for table in (docs, docs.limit(0), docs.drop("n_chars")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == table.columns, name
                assert all(tuple(r[-len(extra):]) == tuple(range(len(extra))) for r in out.collect()), name
            table = spark.createDataFrame(out.collect(), out.schema)
        left.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["decoded"]) for r in table.collect()))
    assert left[0] == left[2] and not left[1]
    ids = [r[1] for r in left[0] if not r[0]]
    assert set(ids) <= set(range(12)) and ids.count(8) <= 4 and len(ids) >= 12 and "hunter" not in " ".join(r[2] for r in left[0])
