"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target number of words; a document of a source is to be taken target / source size times. The whole
part of that ratio is taken outright, the rest is the document's inclusion probability. A flight moves the probabilities
of three documents at a time along the null space of the constraints (words and documents of the source) until one of
the three becomes 0 or 1, so that the totals stay as they are. Flights run in blocks of bounded size in parallel; the two
documents at most that a block leaves undecided meet again in the blocks of the next round, until each source is one
block. Its last undecided documents land on the choice that misses the totals least, and decisions of that block are
swapped while that brings the words nearer to the target.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running_totals, stored, unused, word_count

WEIGHTS = (5, 2, 1)
BLOCK = 2000
EPS = 1e-9


def source_targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """sizes(source, source_size) with weight and target.

    Sources in code-point order, null last, get the weights in turn. Together they share `share` of all sizes by weight;
    a target stops at `limit` times its source's size and the excess is shared again until no target is above.
    """
    key = F.struct(F.col("source").isNull().alias("last"), F.col("source"))
    ranked = running_totals(sizes.withColumn("_one", F.lit(1)).withColumn("_key", key), ["_key"], {"_one": "_rank"}, "mix-sources")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    base = ranked.withColumn("weight", F.get(turn, F.pmod("_rank", F.lit(len(weights))).cast("int"))).drop("_rank", "_one", "_key")
    base = base.withColumn("_cap", F.lit(float(limit)) * F.col("source_size")).withColumn("_full_at", F.col("_cap") / F.col("weight"))
    # a source's target is its weight times a level, or its cap; sources are full in the order of cap / weight
    steps = stored(running_totals(base, ["_full_at"], {"_cap": "_caps", "weight": "_weights"}, "mix-weights"), "mix-levels")
    every = steps.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(share * (every["size"] or 0)) - F.col("_caps")) / (F.lit(every["weight"] or 1.0) - F.col("_weights"))
    open_ = steps.withColumn("_level", level).filter("_level <= _full_at").agg(F.min(F.struct("_full_at", "_level"))["_level"].alias("level")).first()
    target = F.col("_cap") if open_["level"] is None else F.least(F.col("_cap"), F.lit(open_["level"]) * F.col("weight"))
    return steps.withColumn("target", target).drop("_cap", "_full_at", "_caps", "_weights")


def flight(p: np.ndarray, x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Move p until at most two of its entries are neither 0 nor 1; sums of p and of p * x stay.

    Each step goes one way or the other with the odds that leave every probability as it is on average.
    """
    draw = np.random.default_rng(seed).random(len(p)).tolist()
    p = p.tolist()
    x = x.tolist()
    for k, v in enumerate(p):
        p[k] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
    live: list[int] = []
    for k in range(len(p)):
        if 0 < p[k] < 1:
            live.append(k)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])  # orthogonal to (1, 1, 1) and to (x[a], x[b], x[c])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(live, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(live, u, strict=True) if d)
        move = up if draw[k] * (up + down) < down else -down
        for i, d in zip(live, u, strict=True):
            v = p[i] + move * d
            p[i] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
        live = [i for i in live if 0 < p[i] < 1]
    return np.array(p)


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Round the few undecided entries to the choice that misses words, then documents, least."""
    free = np.flatnonzero((p > 0) & (p < 1))
    if not len(free):
        return p
    want_x, want_n = float((p[free] * x[free]).sum()), float(p[free].sum())
    best = min(itertools.product((0.0, 1.0), repeat=len(free)), key=lambda c: (abs(float(np.dot(c, x[free])) - want_x), abs(sum(c) - want_n), c))
    p = p.copy()
    p[free] = best
    return p


def settled(p: np.ndarray, x: np.ndarray, want: float, most: int = 64) -> np.ndarray:
    """Swap a document that is taken with one that is not, or turn one around, while the sum of p * x comes nearer to want.

    Each step is the best there is, a swap where both are as good, as it leaves the number of documents.
    """
    p = p.copy()
    for _ in range(most):
        miss = want - float(p @ x)
        on, off = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        best, move = abs(miss) * (1 - 1e-12), None
        if len(on) and len(off):
            on = on[np.argsort(x[on], kind="stable")]
            at = np.searchsorted(x[on], x[off] - miss)
            for shift in (-1, 0):
                near = on[np.clip(at + shift, 0, len(on) - 1)]
                left = np.abs(miss - (x[off] - x[near]))
                k = int(np.argmin(left))
                if left[k] < best:
                    best, move = float(left[k]), (off[k], near[k])
        for some, sign in ((off, 1), (on, -1)):
            left = np.abs(miss - sign * x[some])
            if len(some) and left.min() < best:
                best, move = float(left.min()), (some[int(np.argmin(left))],)
        if move is None:
            break
        p[list(move)] = 1 - p[list(move)]
    return p


def _walk(last: bool):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        # in the last block small documents come last, so that the landing problem is small
        order = pdf.assign(_by=-pdf["size"] if last else 0).sort_values(["_by", "mark", "id"], kind="stable")
        pdf = order.drop(columns=["_block", "_by"]).reset_index(drop=True)
        p, x = pdf["p"].to_numpy(float), pdf["size"].to_numpy(float)
        end = flight(p, x, int(pdf["mark"].iloc[0]) & 0x7FFFFFFF)
        if last:
            end = landing(end, x)
            loose = (p > EPS) & (p < 1 - EPS)  # those that could go either way
            end[loose] = settled(end[loose], x[loose], float((p * x).sum() - (end * x)[~loose].sum()))
        pdf["p"] = end
        return pdf

    return block


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, limit: float = 2.0, weights=WEIGHTS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies (0, 1, ... limit).

    size counts words; a null text has none and a null source is a source of its own. Each source's sum of size * copies
    comes as near to its target as swaps of single documents bring it. A table without rows gives none. Documents without words get the copies of any other. Repeated rows are
    documents of their own. The result depends on ids, sizes and the seed only. Other columns of docs are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = stored(source_targets(sizes, share, limit, weights), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = targets.withColumn("ratio", ratio).select("source", "source_size", "rows", "target", F.floor("ratio").cast("int").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("p"))
    # one row per source; the join on a hot source is dealt out anew by the blocks that follow
    rows = slim.join(known.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("mark", F.xxhash64("id", "size", F.lit(seed)))
    schema = f"id {kind}, source string, size long, source_size long, rows long, target double, whole int, p double, mark long"
    open_rows = rows.select(*[f.split()[0] for f in schema.split(", ")])
    decided = []
    most = targets.agg(F.max("rows")).first()[0] or 0
    scale = 1.0  # rows left of a source, as a share of its rows, at most
    while True:
        blocks = F.ceil(F.col("rows") * F.lit(scale) / F.lit(block))
        last = most * scale <= block
        key = F.pmod(F.col("mark"), F.greatest(F.lit(1), blocks)) if not last else F.lit(0).cast("long")
        walked = open_rows.withColumn("_block", key).groupBy("source", "_block").applyInPandas(_walk(last), schema)
        if last:
            decided.append(walked)
            break
        walked = stored(walked, "mix-flight")
        done = (F.col("p") == 0) | (F.col("p") == 1)
        decided.append(walked.filter(done))
        open_rows = walked.filter(~done)
        scale = scale * 2 / block + 2 / max(most, 1)
        open_rows = open_rows.withColumn("mark", F.xxhash64("mark", F.lit(seed)))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs, which may have any names.

    Rows that repeat an id, source and size share their copies. An empty table stays empty.
    """
    names = {k: unused(docs, f"_mix_{k}") for k in ("id", "source", "size", "all", "n", "words", "copy")}
    keys = {id_col: names["id"], source_col: names["source"], names["words"]: names["size"]}
    plan = mix(docs, id_col, text_col, source_col).filter("copies > 0")
    plan = plan.groupBy(F.col(id_col).alias(names["id"]), F.col("source").alias(names["source"]), F.col("size").alias(names["size"]))
    plan = plan.agg(F.sum("copies").alias(names["all"]), F.count("*").alias(names["n"]))
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in keys.items()])
    joined = docs.withColumn(names["words"], word_count(F.col(text_col))).join(plan, same)
    times = F.greatest(F.lit(1), F.floor(F.col(names["all"]) / F.col(names["n"]))).cast("int")
    return joined.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
