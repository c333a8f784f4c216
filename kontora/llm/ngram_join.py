"""Near duplicates by an exact n-gram Jaccard join with rare-first prefix filtering.

Each document is its set of shingles, as 64-bit fingerprints, in one global order: shingles that a fixed-size count sketch
of the whole corpus shows as frequent come last, the rest by value. Two sets of at least the wanted similarity share a
shingle of their prefixes, the first quarter and one. Documents with equal sets are put together first.

The first shingle that two sets share, in that order, has nothing in common before it. So the positional filter may ask
that what is left of either set after that shingle still reaches the overlap that is needed; a pair of similar sets passes
it at its first common shingle, whatever the others do. As suffix filter comes a bound on the difference of the sets from
their counts in ranges of fingerprints; what is left is verified once, on the whole sets. Where many pairs are made, a
bound of fixed size comes first: a bit for each of 512 hash values that is set where a set holds an odd number of shingles
with it. Every shingle that only one of two sets holds turns one bit, so that they differ in no more bits than shingles.

A group of many near copies would make pairs with the square of its size. So each prefix shingle first pairs its documents
with one head only, the one with the fewest shingles before it: in a group of copies that is the text which the others
were made from, and the one that passes the positional filter with all that pass it with anyone. Links found that way
join components; after that, all pairs that are left between components are made and verified, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settings, stored
from .words import Runs, U, Words, mix, slices, words

SKETCH_BITS = 22
PARTS = 16
#: Arrays that are added up in one task.
FAN = 64
LOAD = 4
FILTER_BITS = 23
TEXT = 1
#: Bytes of text that are worked on at once, and rows of a batch: they bound the memory of a Python worker.
SLICE, BATCH = 1_000_000, {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: Words of 64 bits that hold the odd hash values of a set.
ODD = 8
#: Bits of a key that hold the size of the set; the place in the prefix stands above them.
SIZE_BITS = 32


def shingle_sets(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle fingerprint) pairs, by document. Texts of fewer than n words are one shingle."""
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = Runs(w.fingerprints(3, lower=True))
    counts = np.diff(w.first)
    at = np.arange(len(w.start))
    full = at + n <= w.first[w.doc + 1]
    short = np.flatnonzero((counts > 0) & (counts < n))
    doc = np.concatenate([w.doc[full], short])
    value = np.concatenate([h.of(at[full], at[full] + n), h.of(w.first[short], w.first[short + 1])])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[head], value[head]


def cells(value: np.ndarray) -> np.ndarray:
    """The cell of the sketch that each shingle counts in."""
    return (mix(value, 31) >> U(64 - SKETCH_BITS)).astype(np.int64)


def sketch(rows: DataFrame, n: int) -> np.ndarray:
    """Rarity class of each cell of a count sketch over the shingles of all documents, one byte each; of fixed size.

    Class 0 goes up to what chance fills a cell with, then comes one more for every doubling. The arrays of the tasks are
    added up FAN at a time, level by level; what comes to the driver are the classes.
    """
    width = 1 << SKETCH_BITS
    size = width // PARTS
    sums = "part int, at int, counts binary, total long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int32)  # of one task
        for whole in batches:
            for b in slices(whole, TEXT, SLICE):
                np.add.at(total, *np.unique(cells(shingle_sets(words(b.column(TEXT)), n)[1]), return_counts=True))
        at = TaskContext.get().partitionId()
        for k, part in enumerate(np.split(total, PARTS)):
            if part.any():
                bytes_each = next(x for x in (1, 2, 4, 8) if part.max() < 1 << (8 * x))
                packed = part.astype(f"<u{bytes_each}").tobytes()
                schema = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("counts", pa.binary()), ("total", pa.int64())])
                yield pa.RecordBatch.from_pydict({"part": [k], "at": [at], "counts": [packed], "total": [int(part.sum())]}, schema=schema)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, f"<u{len(c) // size}").astype(np.int64) for c in pdf["counts"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "at": pdf["at"].iloc[:1], "counts": [total.astype("<i8").tobytes()], "total": [int(total.sum())]})

    level = rows.mapInArrow(count, sums)
    while True:
        level = level.withColumn("at", F.floor(F.col("at") / F.lit(FAN)).cast("int")).groupBy("part", "at").applyInPandas(add, sums)
        level = stored(level, "shingle-counts")
        seen = level.agg(F.max("at").alias("last"), F.sum("total").alias("total")).first()
        if not seen["last"]:
            break
    mean = (seen["total"] or 0) / width
    usual = mean + 6 * np.sqrt(mean) + 8

    def classes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            counts = [np.frombuffer(c, "<i8") for c in pdf["counts"]]
            kinds = [np.clip(np.floor(np.log2(np.maximum(c, 1) / usual)) + 1, 0, 63).astype(np.uint8).tobytes() for c in counts]
            yield pd.DataFrame({"part": pdf["part"], "kinds": kinds})

    out = np.zeros(width, np.uint8)
    for r in level.select("part", "counts").mapInPandas(classes, "part int, kinds binary").collect():  # PARTS rows
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["kinds"], np.uint8)
    return out


def odd_bits(doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """ODD words of bits for each document: which hash values an odd number of its shingles have."""
    width = 64 * ODD
    cell = doc * width + (mix(value, 53) & U(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=docs * width) & 1).astype(np.uint8)).view(np.int64).reshape(docs, ODD)


def features(rows: DataFrame, classes: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """id, n, two fingerprints of the set, its odd bits, its prefix in global order and its counts by range of fingerprints."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)  # one byte per cell of the fixed-size sketch
    kind = rows.schema["id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = shared.value
        for whole in batches:
            for b in slices(whole, TEXT, SLICE):
                doc, value = shingle_sets(words(b.column(TEXT)), n)
                size = np.bincount(doc, minlength=len(b))
                first = np.concatenate([[0], np.cumsum(size)])
                order = np.lexsort((value, cls[cells(value)], doc))
                ranked = value[order]
                length = np.where(size > 0, size - (num * size + den - 1) // den + 1, 0)
                take = np.arange(len(ranked)) - first[doc] < length[doc] if len(doc) else np.zeros(0, bool)
                ends = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
                prefix = pa.ListArray.from_arrays(ends, pa.array(ranked[take].view(np.int64)))
                total = lambda v: pa.array(np.diff(np.concatenate([np.zeros(1, U), np.cumsum(v)])[first]).view(np.int64))  # noqa: B023, E731
                # four to eight shingles to a range, so that the counts of unrelated sets of any size differ
                fine = np.floor(np.log2(np.maximum(size, 8) / LOAD)).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(1 << fine)])
                cell = (value >> (U(64) - fine[doc].astype(U))).astype(np.int64) + at[doc]
                flat = pa.array(np.minimum(np.bincount(cell, minlength=at[-1]), 32767).astype(np.int16))
                hist = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat)
                columns = [b.column(0), pa.array(size.astype(np.int64)), total(mix(value, 41)), total(mix(value, 43)), prefix, hist]
                bits = [pa.array(x) for x in odd_bits(doc, value, len(b)).T]
                yield pa.RecordBatch.from_arrays([*columns, *bits], names=["id", "n", "one", "two", "prefix", "hist", *odd])

    odd = [f"odd{k}" for k in range(ODD)]
    kinds = ", ".join(f"{x} long" for x in odd)
    return rows.mapInArrow(make, f"id {kind}, n long, one long, two long, prefix array<long>, hist array<short>, {kinds}")


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that holds the hashes of all ids, and some others."""
    size = 1 << FILTER_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for b in batches:
            at = np.unique(np.asarray(b.column(0), dtype=np.int64))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    places = ids.select(F.pmod(F.xxhash64("id"), F.lit(size)).alias("cell")).coalesce(16)
    for r in places.mapInArrow(mark, "bits binary").collect():  # 16 bitmaps at most
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def sets_of(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Whole shingle sets (sorted) of the rows with one of these ids, and of some others."""
    bits = rows.sparkSession.sparkContext.broadcast(id_filter(ids))  # 1 MB
    kind = rows.schema["id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for whole in batches:
            at = np.asarray(whole.column(2), dtype=np.int64)
            whole = whole.filter(pa.array(known[at >> 3] >> (at & 7) & 1 > 0))
            for b in slices(whole, TEXT, SLICE):
                doc, value = shingle_sets(words(b.column(TEXT)), n)
                size = np.bincount(doc, minlength=len(b))
                offsets = pa.array(np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int64))
                buffers = [None, offsets.buffers()[1], pa.py_buffer(value.astype("<u8").tobytes())]
                sets = pa.Array.from_buffers(pa.large_binary(), len(b), buffers).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["id", "set"])

    marked = rows.select("id", "t", F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).alias("cell"))
    return marked.mapInArrow(make, f"id {kind}, set binary")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])

    # ids are unique in sets; a document with many pairs is a skewed key on the side of the pairs, which Spark can split
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(test, f"a {kind}, b {kind}")


def components(links: DataFrame, what: str = "components") -> DataFrame:
    """id, root (least id reachable) for every id that has a link.

    Alternating star steps: every id points its larger neighbours, then itself and its smaller ones, to the least
    neighbour, until nothing changes. Rows are aggregated before they are shuffled; only a count comes to the driver.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct(), what)
    before = None
    edge = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.least("m", "v").alias("u"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(edge("v", "m"), edge("u", "m"))).alias("e")).select("e.v", "e.u")
        edges = stored(small.filter("u <> v").distinct(), what)
        mark = F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0)).alias("mark")
        now = edges.agg(F.count("*").alias("n"), mark).first()
        if now == before:
            tops = edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct()
            return edges.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(tops)
        before = now


def size_of(key: Column) -> Column:
    return key.bitwiseAND((1 << SIZE_BITS) - 1)


def reaches(x: Column, y: Column, num: int, den: int) -> Column:
    """Positional filter on two keys of one shingle: if no earlier shingle is shared, can the overlap be enough?

    min(n - pos of either) * (num + den) >= num * (n of both), which bounds the sizes as well.
    """
    spare = lambda k: F.lit(den) * size_of(k) - F.lit(num + den) * F.shiftright(k, SIZE_BITS)
    return (spare(x) >= F.lit(num) * size_of(y)) & (spare(y) >= F.lit(num) * size_of(x))


def _may_differ(num: int, den: int) -> Column:
    """Whether the odd bits of a and b differ in no more places than sets of their sizes may."""
    bits = [F.bit_count(F.col(f"a.odd{k}").bitwiseXOR(F.col(f"b.odd{k}"))).cast("bigint") for k in range(ODD)]
    apart = reduce(lambda x, y: x + y, bits)
    return apart * F.lit(num + den) <= (size_of(F.col("a.key")) + size_of(F.col("b.key"))) * F.lit(den - num)


def _close(na: Column, nb: Column, ha: Column, hb: Column, num: int, den: int) -> Column:
    """Length and suffix filter: sets differ at least by the differences of their counts in each range.

    A set has twice the ranges of one of half its size; two neighbouring ranges then count as one. Sets whose ranges
    compare in neither way pass.
    """
    need = F.ceil((na + nb) * F.lit(num) / F.lit(num + den))
    more = F.size(ha) >= F.size(hb)
    fine, coarse = F.when(more, ha).otherwise(hb), F.when(more, hb).otherwise(ha)
    both = lambda x, y: F.transform(y, lambda _, i: F.get(x, 2 * i).cast("int") + F.get(x, 2 * i + 1))
    halved = F.when(F.size(fine) == 2 * F.size(coarse), both(fine, coarse))
    level = F.when(F.size(fine) == F.size(coarse), fine.cast("array<int>")).otherwise(halved)
    apart = F.aggregate(F.zip_with(level, coarse, lambda x, y: F.abs(x - y.cast("int"))), F.lit(0), lambda a, x: a + x)
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (F.coalesce(apart, F.lit(0)) <= na + nb - 2 * need)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (least id reachable by links, itself included).

    Documents link when den * intersection >= num * union of their shingle sets. Texts without words (null, empty, blank)
    have no shingles and link with nothing. Rows that repeat an id are one document in the result of the search; each
    gets its row. A table without rows gives none. Other columns of docs are ignored.
    """
    with settings(docs.sparkSession, BATCH):  # all that runs in Python is done when this returns
        return _near_duplicates(docs, id_col, text_col, n, num, den)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    feats = stored(features(rows, sketch(rows, n), n, num, den), "shingle-features")
    # equal sets first: the least id stands for all of them wherever pairs are looked at
    groups = stored(feats.filter("n > 0").groupBy("one", "two", "n").agg(F.min("id").alias("rep")), "equal-sets")
    lean = feats.filter("n > 0").select("id", "n", "prefix").join(groups.select(F.col("rep").alias("id")), "id", "left_semi")
    key = F.shiftleft(F.col("pos").cast("long"), SIZE_BITS).bitwiseOR(F.col("n"))
    tokens = lean.select("id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "id", key.alias("key"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("key").alias("least")).filter("c > 1")
    met = stored(tokens.join(shared, "token"), "shared-prefixes")
    hists = lambda k: feats.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("hist").alias(f"h{k}"))
    ordered = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def verified(pairs: DataFrame, what: str) -> DataFrame | None:
        """Links among the pairs that pass the suffix filter; None if no pair does."""
        near = pairs.join(hists("a"), "a").join(hists("b"), "b").filter(_close(F.col("na"), F.col("nb"), F.col("ha"), F.col("hb"), num, den))
        near = stored(near.select("a", "b").distinct(), what + "-pairs")
        if near.isEmpty():
            return None
        ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return stored(verify(near, sets_of(rows, ids, n), num, den).distinct(), what + "-links")

    heads = met.filter("key = least").groupBy("token").agg(F.min("id").alias("head"))
    to_head = met.join(heads, "token").filter((F.col("id") != F.col("head")) & reaches(F.col("key"), F.col("least"), num, den))
    first = stored(to_head.select(*ordered("id", "head")).distinct(), "head-pairs")
    links = verified(first, "head")
    roots = components(links) if links else None

    # every other pair between components, of shingles whose documents are not all in one
    placed = met.filter("c > 2").select("token", "id", "key")
    placed = placed.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")) if roots else placed.withColumn("root", F.col("id"))
    several = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("token")
    odd = feats.select("id", *[f"odd{k}" for k in range(ODD)])
    order = Window.partitionBy("id").orderBy("key")
    earlier = [F.lag("token", k).over(order).alias(f"before{k}") for k in (1, 2)]
    left = placed.join(several, "token", "left_semi").join(odd, "id").select("*", *earlier)
    left = stored(left, "mixed-prefixes")
    a, b = left.alias("a"), left.alias("b")
    # two documents that share one of the shingles right before this one met there, or earlier still
    met_before = [F.coalesce(F.col(f"a.before{i}") == F.col(f"b.before{j}"), F.lit(False)) for i in (1, 2) for j in (1, 2)]
    meet = (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.root") != F.col("b.root"))
    near = reaches(F.col("a.key"), F.col("b.key"), num, den) & _may_differ(num, den) & ~reduce(lambda x, y: x | y, met_before)
    pairs = a.join(b, meet & near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    more = verified(stored(pairs.distinct().join(first, ["a", "b"], "left_anti"), "other-pairs"), "other")
    if more is not None:
        roots = components(links.unionByName(more) if links else more)

    out = feats.select("id", "n", "one", "two").join(groups, ["one", "two", "n"], "left")
    root = F.col("rep")
    if roots is not None:
        out, root = out.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left"), F.coalesce("root", "rep")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(root, "id").alias("component_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of their component, with all columns.

    Rows without words stay, as they link with nothing. Rows that repeat an id all stay or all go. An empty table stays
    empty; columns of docs may have any names.
    """
    found = near_duplicates(docs, id_col, text_col)
    keep = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_kept_id"]), "left_semi")
