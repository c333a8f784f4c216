"""Similarity of wordings to wares, suggestions and how good they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Products of single-precision numbers, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def confidence(cosine: Column, a: float, b: float) -> Column:
    """Logistic calibration as a whole number from 1 to 99."""
    return F.greatest(F.lit(1), F.least(F.lit(99), F.bround(100 / (1 + F.exp(-(cosine * a + b))), 0).cast("int")))


def _blocks(df: DataFrame, fields: list[str], rows: int, what: str) -> DataFrame:
    """df as one row per block of about `rows` rows: arrays of its fields. The number of blocks follows the table."""
    n = max(1, -(-df.count() // rows))
    return df.withColumn("_b", F.pmod(F.xxhash64(*fields[:1], F.monotonically_increasing_id()), F.lit(n))).groupBy("_b").agg(F.collect_list(F.struct(*fields)).alias(what)).drop("_b")


#: Takes queries, wordings and how many are wanted; gives (query_id, ware_id, score), the best of each query among them.
Ranker = Callable[[DataFrame, DataFrame, int], DataFrame]


def rank_wares(queries: DataFrame, wordings: DataFrame, n: int = 5, penalty: float = 0.1, block: int = 2048, ranker: Ranker | None = None) -> DataFrame:
    """(query_id, ware_id, score, rank): the n best wares of each query by their best wording, ties by ware.

    queries: (query_id, query_vec, date, held). wordings: (ware_id, vec, valid_from, valid_to, packages), the catalogue.
    Scores come from the ranker, by_vectors(penalty, block) where none is given; one whose result has other columns or
    types is an error.
    """
    near = (ranker or by_vectors(penalty, block))(queries, wordings, n)
    want = {"query_id": queries.schema["query_id"].dataType, "ware_id": wordings.schema["ware_id"].dataType, "score": T.DoubleType()}
    if {f.name: f.dataType for f in near.schema} != want:
        raise ValueError(f"a ranker gives {', '.join(want)} of the types of the queries, the wordings and double, not {near.schema.simpleString()}")
    best = near.groupBy("query_id", "ware_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ware_id")
    return best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= n)


def by_vectors(penalty: float = 0.1, block: int = 2048) -> Ranker:
    """Ranker by the inner products of vectors.

    A wording counts only on dates it is valid on; packages that contradict what the line holds cost `penalty`. Blocks
    of queries meet blocks of the catalogue, each pair of them one product of matrices that keeps its n best per query.
    """
    return lambda queries, wordings, n: _by_blocks(queries, wordings, n, penalty, block)


def _by_blocks(queries: DataFrame, wordings: DataFrame, n: int, penalty: float, block: int) -> DataFrame:
    kind = {k: df.schema[k].dataType.simpleString() for df, k in ((queries, "query_id"), (wordings, "ware_id"))}
    q = _blocks(queries, ["query_id", "query_vec", "date", "held"], block, "queries")
    w = _blocks(wordings, ["ware_id", "vec", "valid_from", "valid_to", "packages"], block, "wordings")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                yield _best_of_blocks(x.values, y.values, n, penalty)

    # blocks of the stated query set against blocks of the catalogue
    pairs = q.crossJoin(w).repartition(F.xxhash64("queries", "wordings"))
    return pairs.mapInArrow(rank, f"query_id {kind['query_id']}, ware_id {kind['ware_id']}, score double")


def _best_of_blocks(queries: pa.StructArray, wordings: pa.StructArray, n: int, penalty: float) -> pa.RecordBatch:
    """The n best wares of each query of a block among the wordings of a block."""
    stack = lambda a: np.array(a.to_pylist(), np.float32)
    a, b = stack(queries.field("query_vec")), stack(wordings.field("vec"))
    score = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):  # products in single precision, summed in double, in the order of the dimensions
        score += (a[:, k : k + 1] * b[:, k]).astype(np.float64)
    held = [frozenset(x or ()) for x in queries.field("held").to_pylist()]
    packages = [frozenset(x or ()) for x in wordings.field("packages").to_pylist()]
    kinds_a, kinds_b = sorted(set(held), key=sorted), sorted(set(packages), key=sorted)
    against = np.array([[bool(x) and bool(y) and not x & y for y in kinds_b] for x in kinds_a])
    index_a, index_b = {x: i for i, x in enumerate(kinds_a)}, {x: i for i, x in enumerate(kinds_b)}
    score -= penalty * against[np.ix_([index_a[x] for x in held], [index_b[x] for x in packages])]
    days = lambda s, empty: np.array(s.cast(pa.int32()).fill_null(empty).to_numpy(zero_copy_only=False))
    low, high = days(wordings.field("valid_from"), -(2**31)), days(wordings.field("valid_to"), 2**31 - 1)
    date = queries.field("date")
    day, dated = days(date, 0), ~np.array(date.is_null())
    score[dated[:, None] & ((day[:, None] < low) | (day[:, None] >= high))] = -np.inf
    wares, of = np.unique(np.array(wordings.field("ware_id").to_pylist()), return_inverse=True)
    order = np.argsort(of, kind="stable")
    best = np.maximum.reduceat(score[:, order], np.flatnonzero(np.diff(of[order], prepend=-1)), axis=1)
    top = np.argsort(-best, axis=1, kind="stable")[:, :n]  # equal scores keep the order of the wares
    value = np.take_along_axis(best, top, axis=1)
    row, place = np.nonzero(value > -np.inf)
    ids = queries.field("query_id").take(pa.array(row))
    names = pa.array(wares[top[row, place]].tolist(), wordings.field("ware_id").type)
    return pa.RecordBatch.from_arrays([ids, names, pa.array(value[row, place])], names=["query_id", "ware_id", "score"])


def top_suggestions(ranked: DataFrame, exact: DataFrame, a: float, b: float, n: int = 5, floor: int = 20) -> DataFrame:
    """(query_id, ware_id, confidence, source): the exact hit first at 100, then at most n others of enough confidence.

    The floor applies after the cut to n, and the exact ware is not repeated.
    """
    c = F.col
    others = ranked.join(exact.select("query_id", "ware_id"), ["query_id", "ware_id"], "left_anti")
    others = others.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(c("_n") <= n)
    others = others.withColumn("confidence", confidence(c("score"), a, b)).filter(c("confidence") >= floor)
    return exact.select("query_id", "ware_id", F.lit(100).alias("confidence"), F.lit("exact").alias("source")).unionByName(others.select("query_id", "ware_id", "confidence", F.lit("encoder").alias("source")))


def match_report(rows: DataFrame) -> DataFrame:
    """(grp, n, with_expectation, top1, top5) per group and over all (grp null). rows: (grp, expected, hit1, hit5)."""
    share = lambda x: F.sum(F.when(F.col("expected") & F.col(x), 1).otherwise(0)).cast("bigint")
    return rows.groupBy(F.col("grp")).agg(F.count("*").alias("n"), F.count_if("expected").alias("with_expectation"), share("hit1").alias("top1"), share("hit5").alias("top5")).unionByName(
        rows.agg(F.lit(None).cast("string").alias("grp"), F.count("*").alias("n"), F.count_if("expected").alias("with_expectation"), share("hit1").alias("top1"), share("hit5").alias("top5"))
    )


def coverage_curve(scored: DataFrame) -> DataFrame:
    """(share, n, precision): precision of the most confident 25, 50, 75 and 100 percent. scored: (name, confidence, hit)."""
    total = scored.agg(F.count("*").alias("total"))
    # places inside one confidence, after all of the higher ones; confidences are whole numbers from 1 to 99
    above = scored.groupBy("confidence").agg(F.count("*").alias("_n"))
    above = above.select("confidence", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    within = F.row_number().over(Window.partitionBy("confidence").orderBy("name"))
    ranked = scored.join(above, "confidence").withColumn("place", F.col("_above") + within).crossJoin(total)
    cuts = F.explode(F.array(*[F.lit(s) for s in (25, 50, 75, 100)])).alias("share")
    met = ranked.select("*", cuts).filter(F.col("place") <= F.floor(F.col("total") * F.col("share") / 100))
    return met.groupBy("share").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("precision"))


def automatic_share(scored: DataFrame, least: int = 80) -> DataFrame:
    """(n, automatic, share, precision): what is taken without asking, from a confidence on, and how much of it is right.

    scored: (confidence, hit). Share and precision are null where nothing is scored or taken.
    """
    taken = F.count_if(F.col("confidence") >= least)
    right = F.count_if((F.col("confidence") >= least) & F.col("hit"))
    rate = lambda a, b: F.when(b > 0, a / b)
    return scored.agg(F.count("*").alias("n"), taken.alias("automatic"), rate(taken, F.count("*")).alias("share"), rate(right, taken).alias("precision"))


def macro_f1(per_class: DataFrame) -> DataFrame:
    """(classes, macro_f1): the plain mean of F1 over the classes of class_f1."""
    return per_class.agg(F.count("*").alias("classes"), F.avg("f1").alias("macro_f1"))


def class_f1(rows: DataFrame) -> DataFrame:
    """(class, hit, predicted, support, precision, recall, f1) per class. rows: (pred, truth)."""
    parts = rows.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(0).alias("p"), F.lit(1).alias("t"), (F.col("truth") == F.col("pred")).cast("int").alias("h")), F.struct(F.col("pred").alias("class"), F.lit(1).alias("p"), F.lit(0).alias("t"), F.lit(0).alias("h")))).alias("x"))
    s = parts.groupBy("x.class").agg(F.sum("x.h").alias("hit"), F.sum("x.p").alias("predicted"), F.sum("x.t").alias("support"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    s = s.withColumn("precision", ratio(F.col("hit"), F.col("predicted"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_weights(counts: DataFrame, cap: float = 20.0) -> DataFrame:
    """(class, weight): 1 / sqrt(count), scaled so that the least is 1 and cut off at cap."""
    w = counts.withColumn("_w", 1 / F.sqrt("n"))
    least = w.agg(F.min("_w").alias("_least"))
    return w.crossJoin(least).select("class", F.least(F.col("_w") / F.col("_least"), F.lit(cap)).alias("weight"))


def confusions(rows: DataFrame, n: int = 40) -> DataFrame:
    """(pred, truth, n): the most frequent wrong pairs; a report of the n first."""
    return rows.filter("pred <> truth").groupBy("pred", "truth").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pred", "truth").limit(n)
