"""Exact top-k search by inner product: columnar branch and bound over blocks.

Candidates are packed into blocks in vertical layout (dimension by row), queries into blocks of a fixed
number; each query block meets each candidate block by an equi-join on the block number (the query
blocks, 2 % of the rows, are the side that is repeated). Within a block pair, scores are accumulated a
few dimensions at a time; after each step a candidate survives only if its score so far plus the
largest the remaining dimensions can add (product of the remaining norms) reaches the k-th best lower
bound, and the arrays are compacted to the survivors. Ties survive, since the comparison isn't strict.

Query blocks meet candidate blocks in rounds: one, then up to eight, sixty-four, ... of all. After each round the best k of all so far are
kept, and the k-th is the query's bound in the next, where most candidates go after a few dimensions and a block returns only
what reaches the bound: some k rows in a round for each of the blocks before, however many blocks there are.

Vectors that are null, empty or hold null, NaN or infinite components take no part, nor do rows without
id. Only vectors of the query's length are candidates. Rows with a query's own id never answer it;
if an id is repeated among the queries, the smallest vector counts. Scores must fit in a long; blocks whose scores may reach 2^52 are compared in
integers and without bounds. Blocks are dealt by id and vector, so rows of one id are in many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltlake.llm.common import discard, staged, table

BLOCK_ROWS, QUERY_ROWS, STEP, ROUND = 8192, 512, 8, 8
PACKED = "dim int, block long, qblock long, ids binary, floors binary, mat binary"
NO_FLOOR = -(1 << 63)


def scaled(vector: Column) -> Column:
    """floor(256 x) of each component; null if the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~odd & (F.size(x) > 0), F.transform(x, lambda v: F.floor(256 * v)))


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    dim = key[0].as_py()
    mat = rows["v"].combine_chunks()
    mat = (mat.chunk(0) if isinstance(mat, pa.ChunkedArray) else mat).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    ids, floors = rows["vec_id"].to_numpy(), rows["floor"].to_numpy()
    n = {f: key[k].as_py() for k, f in ((1, "block"), (1, "qblock"))}
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "block": pa.array([n["block"]], pa.int64()), "qblock": pa.array([n["qblock"]], pa.int64()),
        "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "floors": pa.array([floors.astype("<i8").tobytes()], pa.binary()), "mat": pa.array([np.ascontiguousarray(mat.T).astype("<i8").tobytes()], pa.binary()),
    })


def best(ids: np.ndarray, cols: np.ndarray, own: int, query: np.ndarray, k: int, tails: np.ndarray, floor: int = NO_FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k best rows of a block for one query that reach the floor; cols: dimension by row; tails: norms of what follows each step."""
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), cols.dtype)
    rounded = cols.dtype.kind == "f"  # scores that doubles hold exactly; bounds of larger ones would be rounded, so those aren't pruned
    for step, at in enumerate(range(0, len(query), STEP)):
        part = cols[at : at + STEP]
        score = score + query[at : at + STEP] @ (part if len(alive) == part.shape[1] else part[:, alive])
        if not rounded or at + STEP >= len(query) or len(alive) == 0 or len(alive) <= k and floor == NO_FLOOR:
            continue
        rest = np.sqrt(float((query[at + STEP :].astype(float) ** 2).sum())) * tails[step][alive] * (1 + 1e-9) + 1e-6
        least = np.partition(score - rest, len(alive) - k)[len(alive) - k] if len(alive) > k else -np.inf
        keep = score + rest >= max(least, floor)
        if keep.sum() < 0.8 * len(alive):
            alive, score = alive[keep], score[keep]
    keep = score >= floor
    alive, score = alive[keep], score[keep]
    order = np.lexsort((ids[alive], -score if rounded else ~score))[:k]
    return ids[alive][order], score[order]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids, qids, floors = (np.frombuffer(row[c], "<i8") for c in ("ids", "qids", "floors"))
                cols = np.frombuffer(row["mat"], "<i8").reshape(dim, -1)
                queries = np.frombuffer(row["qmat"], "<i8").reshape(dim, -1)
                top = float(np.abs(cols).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dim
                kind = np.float64 if top < 2**52 else np.int64  # both exact there; the first is faster
                cols, queries = cols.astype(kind), np.ascontiguousarray(queries.T).astype(kind)
                squares = (cols.astype(float) ** 2)[::-1].cumsum(0)[::-1]
                tails = [np.sqrt(squares[at]) for at in range(STEP, dim, STEP)]
                found = [(q, *best(ids, cols, q, v, k, tails, f)) for q, v, f in zip(qids.tolist(), queries, floors.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype("i8")),
                    "vec_id": pa.array(np.concatenate([f[1] for f in found]).astype("i8")),
                    "score": pa.array(np.concatenate([f[2] for f in found]).astype("i8")),
                })

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row for which ``is_query`` (of vec_id) holds."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), scaled(F.col(vector)).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).withColumn("dim", F.size("v"))
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n = rows.count()
    blocks, qblocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n // (50 * QUERY_ROWS)))
    where = lambda count, *more: F.pmod(F.xxhash64("vec_id", *more), F.lit(count))
    no_floor = F.lit(NO_FLOOR).cast("long").alias("floor")
    packed = rows.select("dim", "vec_id", "v", no_floor, where(blocks, "v").alias("block")).groupBy("dim", "block").applyInArrow(_pack, PACKED)
    packed = staged(packed.select("dim", "block", "ids", "mat"), "blocks")
    asked = asked.withColumn("qblock", where(qblocks))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def met(wanted: DataFrame, first: int, last: int) -> DataFrame:
        """Answers of query blocks in the candidate blocks ``first`` to ``last`` behind their own, a task for each candidate block."""
        to = F.transform(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")), lambda o: F.pmod(F.col("qblock") + o, F.lit(blocks).cast("long")))
        wanted = wanted.groupBy("dim", "qblock").applyInArrow(_pack, PACKED)
        wanted = wanted.select("dim", F.explode(to).alias("block"), F.col("ids").alias("qids"), "floors", F.col("mat").alias("qmat"))
        sides = [df.repartition(max(2, blocks), "dim", "block") for df in (packed, wanted)]
        return sides[0].join(sides[1].hint("shuffle_merge"), ["dim", "block"]).mapInArrow(_search(k), "query_id long, vec_id long, score long")

    best_so_far, at = None, 0
    while at < blocks:
        end = min(blocks, max(1, ROUND * at))
        bounded = asked.withColumn("floor", no_floor)
        if best_so_far is not None:
            floors = best_so_far.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
            bounded = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", no_floor))
        found = met(bounded, at, end - 1)
        if best_so_far is not None:
            found = found.unionByName(best_so_far.drop("rank"))
        found = staged(found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k), "best")
        if best_so_far is not None:
            discard(best_so_far)
        best_so_far, at = found, end
    discard(packed)
    return best_so_far.select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


QUERIES = {"op10_topk_search": op10_topk_search}
ORACLE = {
    "op10_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
