"""Exact top-k inner products: tiled matrix products, selection per tile, tree merging of the lists.

Vectors are packed into tiles of rows (ids and one matrix each). Every tile of queries meets
every shard of candidates where the shard lies: a bounded number of query tiles is broadcast at
once, in as many rounds as they need, and no candidate is shuffled again. A task multiplies the
two matrices and keeps each query's k best. These lists are merged ``FAN_IN`` at a time until
one is left. No task holds more than two tiles beside the broadcast ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from .common import materialize

K, SCALE = 20, 64.0
QUERY_TILE, SHARD = 2048, 4096
FAN_IN = 8
#: bytes of query tiles that are broadcast at once
ROUND_BYTES = 64 << 20
NO_ID = 2**63 - 1


def _packed(batches):
    """Pack the rows of a task's tile numbers into (tile, dim, kind, rows, ids, matrix) rows; ``kind`` is the narrowest type that holds the matrix."""
    for batch in batches:
        tiles = np.asarray(batch.column(0))
        dims = np.asarray(batch.column(1))
        cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(dims) != 0)) + 1
        flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(dims)])
        numbers, ids = np.asarray(batch.column(2)), np.asarray(batch.column(3))
        out = []
        for lo, hi in zip([0, *cuts], [*cuts, len(tiles)], strict=True):
            if hi > lo:
                matrix = flat[at[lo] : at[hi]]
                most = np.abs(matrix).max(initial=0)
                kind = "int16" if most < 2**15 else "int32" if most < 2**31 else "float64"
                out.append({"tile": int(tiles[lo]), "dim": int(dims[lo]), "kind": kind, "rows": numbers[lo:hi].tobytes(), "ids": ids[lo:hi].tobytes(), "matrix": matrix.astype(kind).tobytes()})
        yield pa.RecordBatch.from_pylist(out, _TILE)


_TILE = pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("kind", pa.string()), ("rows", pa.binary()), ("ids", pa.binary()), ("matrix", pa.binary())])


def tiles(vectors: DataFrame, rows: int, n: int) -> DataFrame:
    """Deal (row, vec_id, v) to about n / rows tiles by hash and pack each; a tile may come in several rows."""
    count = max(1, -(-n // rows))
    dealt = vectors.select(F.pmod(F.xxhash64("row"), F.lit(count)).alias("tile"), F.size("v").alias("dim"), "row", "vec_id", "v")
    dealt = dealt.repartition(count, "tile").sortWithinPartitions("tile", "dim", "vec_id")
    return dealt.mapInArrow(_packed, "tile long, dim int, kind string, rows binary, ids binary, matrix binary")


def _best(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_rows, q, rows, c = (np.frombuffer(r[x], np.int64) for x in ("q_rows", "q_ids", "rows", "ids"))
                a = np.frombuffer(r["q_matrix"], r["q_kind"]).reshape(len(q), r["dim"]).astype(np.float64)
                b = np.frombuffer(r["matrix"], r["kind"]).reshape(len(c), r["dim"]).astype(np.float64)
                order = np.argsort(c, kind="stable")
                rows, c, b = rows[order], c[order], b[order]
                bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, r["dim"])
                if bound < 2**24:
                    s = (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
                elif bound < 2**53:
                    s = (a @ b.T).astype(np.int64)
                else:
                    s = a.astype(np.int64) @ b.astype(np.int64).T
                ids, found = [], []
                for i in range(len(q)):
                    row = s[i]
                    able = np.flatnonzero(rows != q_rows[i])
                    row = row[able]
                    if len(row) > k:
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        pick = np.flatnonzero(row >= least)
                    else:
                        pick = np.arange(len(row))
                    # candidates ascend by id, so a stable sort settles ties
                    pick = pick[np.argsort(-row[pick], kind="stable")][:k]
                    ids.append(int(q[i]))
                    found.append([{"worse": -int(x), "vec_id": int(y)} for x, y in zip(row[pick], c[able[pick]], strict=True)])
                yield pa.record_batch([pa.array(q_rows), pa.array(ids, pa.int64()), pa.array([r["part"]] * len(ids), pa.int64()), pa.array(found, pa.list_(pa.struct([("worse", pa.int64()), ("vec_id", pa.int64())])))], names=["query", "query_id", "part", "best"])

    return run


def _rounds(tiles: DataFrame):
    """(first, last) block of each round: in order of their numbers, ``ROUND_BYTES`` at most or one tile."""
    first = last = None
    room = 0
    for r in tiles.select("block", F.expr("octet_length(q_matrix) + octet_length(q_ids) + octet_length(q_rows)").alias("n")).orderBy("block").toLocalIterator():
        if first is not None and room + r.n > ROUND_BYTES:
            yield first, last
            first, room = None, 0
        first, last, room = r.block if first is None else first, r.block, room + r.n
    # without a query there is an empty round
    yield (first, last) if first is not None else (0, -1)


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: float = SCALE, query_tile: int = QUERY_TILE, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best inner products of floor(scale * x), ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``. Null vectors and those with a null or non-finite
    component take no part; a query meets vectors of its own dimension only, and every row but
    its own, rows of the same id among them. Query rows of one id and vector are answered once;
    repeated candidate rows count each. Null ids are candidates, last in ties (2**63 - 1 stands
    for them, which no id may be). Scores are exact while they stay below 2**63. Extra columns
    are ignored; an empty table gives an empty result.
    """
    v = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.filter("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    v = materialize(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.expr(f"transform(v, x -> cast(floor(x * {scale}D) as double))").alias("v")), "vectors")
    queries = v.filter(F.col("vec_id") != NO_ID).filter(is_query).groupBy("vec_id", "v").agg(F.min("row").alias("row"))
    n, nq = v.count(), queries.count()
    c_tiles = materialize(tiles(v, shard, n).withColumn("part", F.monotonically_increasing_id()), "shards")
    q_tiles = materialize(tiles(queries, query_tile, nq), "tiles").select(F.monotonically_increasing_id().alias("block"), "dim", *[F.col(c).alias(f"q_{c}") for c in ("kind", "rows", "ids", "matrix")])
    q_tiles = materialize(q_tiles, "blocks")
    # the stated queries against all rows, in blocks: one row for each tile and shard
    lists = None
    for first, last in _rounds(q_tiles):
        some = broadcast(q_tiles.filter(F.col("block").between(first, last)))
        met = c_tiles.join(some, "dim").select("dim", "part", *[x + c for x in ("", "q_") for c in ("kind", "rows", "ids", "matrix")])
        found = materialize(met.mapInArrow(_best(k), "query long, query_id long, part long, best array<struct<worse:bigint,vec_id:bigint>>"), "lists")
        lists = found if lists is None else lists.unionAll(found)
    lists = lists.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(1 << 30)))
    parts = max(1, c_tiles.count())
    while parts > 1:
        parts = -(-parts // FAN_IN)
        lists = lists.groupBy("query", "query_id", (F.col("part") % parts).alias("part")).agg(F.expr(f"slice(array_sort(flatten(collect_list(best))), 1, {k})").alias("best"))
    return lists.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.expr(f"nullif(b.vec_id, {NO_ID}L)").alias("vec_id"), (-F.col("b.worse")).alias("score"))
