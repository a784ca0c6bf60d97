"""Nearest neighbours by randomly rotated one-bit codes.

The index keeps, for every distinct vector, the signs of its rotated offset from a centre (packed bits), the offset's
length and its inner product with its own code. From a query's rotated offset and the packed bits the inner product is
estimated, with an error bound that shrinks with the dimension; every vector whose lower bound on the distance does not
exceed the k-th smallest upper bound is reranked on original vectors. Queries are searched against all rows in blocks:
a tile of the index meets a block of queries, both of bounded bytes, and gives k rows a query. A tile carries its vectors:
of a few dozen dimensions the bounds leave a third of the given rows to rerank, so pairs to fetch vectors for would be far
more than the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows that the centre is taken over at most; bytes of vectors in a tile and in a block of queries; rows that are worth a
#: tile of their own while tasks are few; the bound's width in standard deviations.
SAMPLE, TILE_BYTES, BLOCK_BYTES, LEAST, WIDTH, SEED = 10_000, 16_000_000, 16_000_000, 4096, 2.5, 11


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, offset lengths, and the inner product of each unit offset with its unit code."""
    dim = vectors.shape[1]
    offset = vectors - centre
    length = np.sqrt((offset**2).sum(1))
    turned = offset @ rotation(dim)
    own = np.abs(turned).sum(1) / np.sqrt(dim) / np.where(length > 0, length, 1)
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, own, 1.0)


def bounds(query: np.ndarray, centre: np.ndarray, bits: np.ndarray, length: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances from one query to all coded vectors."""
    dim = len(query)
    q = query - centre
    reach = np.sqrt((q**2).sum())
    turned = q @ rotation_cached(dim)
    # Inner product with a code from its packed bits: by table, a byte at a time.
    padded = np.zeros(8 * bits.shape[1])
    padded[:dim] = turned
    tables = padded.reshape(-1, 8) @ SIGNS.T  # the signed sums of 8 coordinates for every byte
    with_code = tables[np.arange(bits.shape[1]), bits].sum(1) - padded[dim:].sum()
    with_unit = with_code / np.sqrt(dim) / own
    slack = WIDTH * reach * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(dim - 1, 1)) + 1e-9
    base = length**2 + reach**2
    return base - 2 * length * (with_unit + slack), base - 2 * length * (with_unit - slack)


SIGNS = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), 1.0, -1.0)
_rotations: dict[int, np.ndarray] = {}


def rotation_cached(dim: int) -> np.ndarray:
    if dim not in _rotations:
        _rotations[dim] = rotation(dim)
    return _rotations[dim]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: one row an id, the least vector if it has several. Null, zero and non-finite vectors and null ids take
    no part."""
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added in the order of the components as a loop adds them."""
    total = np.zeros(len(x))
    for column, y in zip(np.ascontiguousarray(x.T), v):
        total += (column - y) ** 2
    return np.sqrt(total)


def _searched(index: DataFrame, queries: DataFrame, dim: int, centre: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: of each tile the nearest k rows of every query of the block that it meets."""

    def meet(codes: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if codes.num_rows and asked.num_rows:
            x = _matrix(codes.column("v"), dim)
            bits = np.frombuffer(b"".join(codes.column("bits").to_pylist()), np.uint8).reshape(len(x), -1)
            length, own, ids = codes.column("length").to_numpy(), codes.column("own").to_numpy(), codes.column("ids")
            for q, v in zip(asked.column("vec_id").to_pylist(), _matrix(asked.column("v"), dim)):
                low, high = bounds(v, centre, bits, length, own)
                # One class may hold the query alone, so one more upper bound than k counts.
                edge = np.partition(high, k)[k] if len(high) > k else np.inf
                near = np.flatnonzero(low <= edge)
                exact = distances(x[near], v)
                if len(exact) > k + 1:
                    cut = np.partition(exact, k)[k]
                    near, exact = near[exact <= cut], exact[exact <= cut]
                found = sorted((d, i) for d, c in zip(exact.tolist(), near.tolist()) for i in ids[c].as_py() if i != q)[:k]
                out[0].extend([q] * len(found))
                out[1].extend(i for _, i in found)
                out[2].extend(d for d, _ in found)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return index.groupBy("tile", "block").cogroup(queries.groupBy("tile", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: of every row whose id is divisible by ``every`` the k nearest other rows.

    Score is the Euclidean distance in double precision, ties go to the smaller id. Rows of one vector share one code;
    of their ids the k + 1 least are kept, more can't be among anyone's k nearest. Rows of an id count once; vectors are
    compared with those of their own dimension; a query without other rows gives none; an empty table gives an empty
    table; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    asked = F.count_if(F.col("vec_id") % every == 0)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), asked.alias("asked")).filter("asked > 0").orderBy("dim").collect()  # a row a dimension
    out = None
    for dim, n, number in sizes:
        mine = rows.filter(F.size("v") == dim)
        sample = mine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
        centre = np.mean(np.stack(sample.to_numpy()).astype(np.float64), axis=0)
        least = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        classes = mine.withColumn("r", least).filter(F.col("r") <= k + 1).groupBy("v").agg(F.collect_list("vec_id").alias("ids"))
        kind = dict(rows.dtypes)["v"]

        def code(frames: Iterator[pa.RecordBatch], dim: int = dim, centre: np.ndarray = centre) -> Iterator[pa.RecordBatch]:
            for f in frames:
                bits, length, own = encode(_matrix(f.column(0), dim), centre)
                yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(own)], ["v", "ids", "bits", "length", "own"])

        index = written(classes.mapInArrow(code, f"v {kind}, ids array<long>, bits binary, length double, own double"), "index")
        tiles = max(1 + n * dim * 8 // TILE_BYTES, min(spark.sparkContext.defaultParallelism, 1 + n // LEAST))
        blocks = 1 + number * dim * 8 // BLOCK_BYTES
        left = index.withColumn("tile", F.pmod(F.xxhash64("v"), F.lit(tiles)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        queries = mine.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
        right = queries.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        near = _searched(left, right, dim, centre, k)
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


#: The same rows from the distances of every query to all rows.
SQL = """
WITH x AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda e: e <> 0)) > 0
  GROUP BY 1),
d AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_distance(q.v, x.v) AS score
  FROM x q JOIN x ON x.vec_id <> q.vec_id AND len(x.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM d QUALIFY rank <= 10
"""
