"""Exact top-k search by inner product over vectors sorted by length.

Candidates are range-partitioned by length, longest first, and packed into blocks. Rounds take blocks by rank, each round a
multiple of all before, so that what a query has found so far bounds what it still needs: of a block it can get no more
than its own length times that of the block's longest. Inside a block, queries and candidates are rotated to the axes of
the corpus's second moments (its SVD), largest first; sums over the leading axes plus the product of what is left of both
lengths bound each score. What passes is scored in whole numbers. Only candidates that reach a query's bound leave a task,
at most k of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
#: Candidates of one block, blocks of one task at most, queries of one task at most.
BLOCK, TASK_BLOCKS, QUERIES = 2048, 16, 8192
#: The longest candidates that start the bounds, and how much more each round takes than all before.
HEAD, GROWTH = 2048, 8
#: Share of the axes that is summed at first.
LEADING = 0.5


def usable(vector: Column) -> Column:
    """Whether a vector has components, and none that is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary rows of 32-bit integers as a matrix, short ones filled with zeros."""
    out = np.zeros((len(column), width), np.int64)
    for k, x in enumerate(column):
        row = np.frombuffer(x.as_buffer(), "<i4")
        out[k, : len(row)] = row
    return out


def packed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, ints (32-bit integers, floor of SCALE times each component), n (their number), norm (their length)."""
    kind = df.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            at = np.asarray(lists.offsets, dtype=np.int64)
            ints = np.floor(SCALE * np.asarray(lists.values, dtype=np.float64)[at[0] : at[-1]])
            if np.abs(ints).max(initial=0) >= 1 << 31:
                raise ValueError("components have to stay below 2^23")
            squares = np.concatenate([[0], np.cumsum(ints.astype(np.int64).astype(object) ** 2)]) if np.abs(ints).max(initial=0) >= 1 << 24 else np.concatenate([[0], np.cumsum(ints.astype(np.int64) ** 2)])
            norm = np.sqrt((squares[at[1:] - at[0]] - squares[at[:-1] - at[0]]).astype(np.float64))
            raw = pa.py_buffer(ints.astype("<i4"))
            rows = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer((4 * (at - at[0])).astype(np.int64)), raw]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), rows, pa.array(np.diff(at).astype(np.int32)), pa.array(norm)], names=["id", "ints", "n", "norm"])

    good = df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return good.mapInArrow(pack, f"id {kind}, ints binary, n int, norm double")


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, as columns, largest first: from their second moments, added up in tasks."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = _matrix(b.column(0), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"row": pa.array(range(width), pa.int32()), "sums": pa.array([x.tobytes() for x in total], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0)
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "sums": [total.tobytes()]})

    parts = vectors.select("ints").mapInArrow(moments, "row int, sums binary")
    rows = parts.groupBy("row").applyInPandas(add, "row int, sums binary").orderBy("row").collect()  # width rows of width numbers
    gram = np.stack([np.frombuffer(r["sums"]) for r in rows]) if rows else np.zeros((width, width))
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def best_of(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, ties to smaller ids, in the order of queries and ranks."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.searchsorted(q, q, "left")
    return order[np.arange(len(q)) - first < k]


class Searcher:
    """Queries of one task, and the best that it has found for each."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, norms: np.ndarray, bounds: np.ndarray, rotation: np.ndarray, k: int):
        self.own, self.ints, self.norms, self.floor, self.k = ids, ints, norms, bounds, k
        self.rotation, self.lead = rotation, max(1, math.ceil(LEADING * rotation.shape[1]))
        turned = ints @ rotation
        self.leading = turned[:, : self.lead]
        self.rest = np.sqrt(np.maximum((turned[:, self.lead :] ** 2).sum(axis=1), 0))
        self.query, self.score, self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), ids[:0]

    def block(self, ids: np.ndarray, ints: np.ndarray) -> None:
        """Score the candidates of a block, the longest first, that may reach the bounds."""
        turned = ints @ self.rotation
        norms = np.sqrt((turned**2).sum(axis=1))
        # bounds in floating point are a little too large, never too small
        slack = 1e-9
        ask = np.flatnonzero(self.norms * norms.max(initial=0) * (1 + slack) + slack >= self.floor)
        if not len(ask):
            return
        rest = np.sqrt((turned[:, self.lead :] ** 2).sum(axis=1))
        most = self.leading[ask] @ turned[:, : self.lead].T + np.outer(self.rest[ask], rest)
        most += slack * (1 + np.outer(self.norms[ask], norms))
        q, c = np.nonzero(most >= self.floor[ask][:, None])
        q = ask[q]
        q, c = (x[self.own[q] != ids[c]] for x in (q, c))
        if not len(q):
            return
        if float(self.norms[ask].max()) * float(norms.max()) < 2.0**52:  # every partial sum is a whole number below 2^53
            score = (self.ints[ask].astype(np.float64) @ ints.T.astype(np.float64))[np.searchsorted(ask, q), c].astype(np.int64)
        else:
            score = np.array([int(np.dot(self.ints[x].astype(object), ints[y].astype(object))) for x, y in zip(q, c, strict=True)], np.int64)
        reach = score >= self.floor[q]
        q, score, found = (np.concatenate([a, b[reach]]) for a, b in ((self.query, q), (self.score, score), (self.found, ids[c])))
        keep = best_of(q, score, found, self.k)
        self.query, self.score, self.found = q[keep], score[keep], found[keep]
        last = np.searchsorted(self.query, np.arange(len(self.own)), "right")
        full = np.flatnonzero(last - np.searchsorted(self.query, np.arange(len(self.own))) == self.k)
        self.floor[full] = np.maximum(self.floor[full], self.score[last[full] - 1])


def _blocks(candidates: DataFrame, kind: str, size: int) -> DataFrame:
    """Candidates, longest first, in blocks: part, no, rows, ids, ints, n."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, no, part = [], 0, 0
        names = ["part", "no", "rows", "ids", "ints"]

        def out(table: pa.Table) -> pa.RecordBatch:
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([table.num_rows], pa.int32()), *[one(table.column(x).combine_chunks()) for x in ("id", "ints")]], names=names)

        for b in batches:
            held.append(b)
            if len(b):
                part = b.column(0)[0].as_py()
            table = pa.Table.from_batches(held)
            while table.num_rows >= size:
                yield out(table.slice(0, size))
                table, no = table.slice(size), no + 1
            held = table.to_batches()
        if held and sum(map(len, held)):
            yield out(pa.Table.from_batches(held))

    spark = candidates.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = candidates.repartitionByRange(parts, F.col("norm").desc(), F.col("id")).sortWithinPartitions(F.col("norm").desc(), F.col("id"))
    return ranged.select(F.spark_partition_id().alias("part"), "id", "ints").mapInArrow(pack, f"part int, no int, rows int, ids array<{kind}>, ints array<binary>")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, head: int = HEAD, growth: int = GROWTH) -> DataFrame:
    """query_id, rank (from 1), id, score: the k rows of vectors with the largest inner product for each row of queries.

    Components x count as floor(256 x), scores are whole numbers; ties go to the smaller id, and rows with a query's own id
    are not among its results. Queries with fewer than k candidates get all; each row of queries that repeats an id gets
    results of its own. Vectors that are null or hold a null, NaN or infinite component, and rows without id, take no part;
    an empty vector counts as zeros, as does what a shorter vector lacks. Components of 2^23 and more are an error. Empty
    tables give no rows; other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    all_rows = stored(packed(vectors, id_col, vector_col), "packed-vectors")
    asked = stored(packed(queries, id_col, vector_col).withColumn("q", F.monotonically_increasing_id()), "packed-queries")
    sizes = [x.agg(F.max("n").alias("n"), F.count("*").alias("rows")).first() for x in (all_rows, asked)]
    out = f"q long, id {kind}, score long"
    if not sizes[0]["rows"] or not sizes[1]["rows"]:
        none = asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0).cast("long").alias("score"))
        return none.limit(0)
    width = max(1, *(s["n"] for s in sizes))
    rotation = axes(all_rows, width)
    blocks = stored(_blocks(all_rows, kind, block), "vector-blocks")
    # ranks of the blocks, from one row for each range partition
    counts = blocks.groupBy("part").agg(F.sum("rows").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("no").cast("long") * block
    ranked = blocks.join(F.broadcast(offsets), "part").select(rank.alias("place"), "ids", "ints")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        right = right.combine_chunks()
        flat = lambda name: right.column(name).combine_chunks()
        own, ints = np.asarray(flat("id")), _matrix(flat("ints"), width)
        floor = np.asarray(flat("bound").cast(pa.float64()).fill_null(-np.inf)).copy()
        s = Searcher(own, ints, np.asarray(flat("norm")), floor, rotation, k)
        for k_ in range(left.num_rows):
            s.block(np.asarray(left.column("ids")[k_].values), _matrix(left.column("ints")[k_].values, width))
        q = np.asarray(flat("q"))[s.query]
        return pa.table({"q": pa.array(q, pa.int64()), "id": pa.array(s.found, left.schema.field("ids").type.value_type), "score": pa.array(s.score, pa.int64())})

    groups = -(-sizes[1]["rows"] // QUERIES)
    group = F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("group")
    by_rank = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    found, begin, end = None, 0, head
    while begin < sizes[0]["rows"]:
        mine = asked.select("q", "id", "ints", "norm", group)
        if found is not None:
            least = found.groupBy("q").agg(F.count("*").alias("c"), F.min("score").alias("least")).filter(F.col("c") == k)
            mine = mine.join(least.select("q", F.col("least").cast("double").alias("bound")), "q", "left")
        else:
            mine = mine.withColumn("bound", F.lit(None).cast("double"))
        now = ranked.filter((F.col("place") >= begin) & (F.col("place") < end))
        tasks = max(1, -(-(min(end, sizes[0]["rows"]) - begin) // (block * TASK_BLOCKS)), min(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(end - begin) // block)))
        lane = F.pmod(F.floor(F.col("place") / block), F.lit(tasks)).cast("int")
        # bounded pieces of both sides meet: TASK_BLOCKS blocks, about QUERIES queries
        left = now.select(lane.alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "place", "ids", "ints")
        right = mine.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("lane"), "group", "q", "id", "ints", "norm", "bound")
        new = left.groupBy("lane", "group").cogroup(right.groupBy("lane", "group")).applyInArrow(search, out)
        new = new if found is None else new.unionByName(found.select("q", "id", "score"))
        found = stored(new.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k), "best-so-far")
        begin, end = end, end * growth
    return found.join(asked.select("q", F.col("id").alias("query_id")), "q").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
