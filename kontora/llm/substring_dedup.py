"""Removal of repeated passages by recompression.

The words of a text are symbols. A round names every run of one symbol, then every pair of neighbours whose first symbol
falls into the left and whose second into the right half of the alphabet; both halves are drawn by a hash of the symbol.
Names are fingerprints of what they stand for, so all tasks give the same names without exchanging any. What a symbol
of the last round looks like is decided by the words of a short stretch around it, which each symbol carries along.
Every window of twenty words picks, of the symbols decided inside it, the one with the least name: equal windows pick
equal symbols. Windows whose symbol occurs once in the corpus are unique. For the rest, Spark finds the first document
of each window by its full fingerprint (the symbol's name and an independent hash of all twenty words).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WORD_BASE, Runs, U, Words, mix, slices, words

ROUNDS = 2
#: Column of the texts in all batches.
TEXT = 1


def recompress(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after some rounds, as the stretches of words [low, high) that decide them.

    A stretch reaches past the text where its end had a say, so that no window of the text holds it.
    """
    sym, start = h, np.arange(len(h))
    end, low, high = start + 1, start.copy(), start + 1
    for r in range(rounds):
        n = len(sym)
        cut = np.ones(n, bool)
        cut[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(cut)
        last = np.append(head[1:], n) - 1
        count = last - head + 1
        at_left = cut[head] & ((head == 0) | (doc[np.maximum(head - 1, 0)] != doc[head]))
        at_right = (last == n - 1) | (doc[np.minimum(last + 1, n - 1)] != doc[head])
        low, high = np.where(at_left, start[head] - 1, low[np.maximum(head - 1, 0)]), np.where(at_right, end[last] + 1, high[np.minimum(last + 1, n - 1)])
        sym = np.where(count > 1, mix(sym[head] + count.astype(U), 11 + r), sym[head])
        start, end, doc = start[head], end[last], doc[head]

        n = len(sym)
        right = (mix(sym, 101 + r) & U(1)).astype(bool)
        same = np.zeros(n, bool)
        same[:-1] = doc[1:] == doc[:-1]
        nxt, prv = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        pair = same & ~right & right[nxt]
        second = np.zeros(n, bool)
        second[1:] = pair[:-1]
        same_before = np.zeros(n, bool)
        same_before[1:] = same[:-1]
        new_low = np.where(right & ~second, np.where(same_before, low[prv], start - 1), low)
        new_high = np.where(pair, high[nxt], np.where(~right, np.where(same, high[nxt], end + 1), high))
        sym = np.where(pair, mix(sym * U(WORD_BASE) + mix(sym[nxt], 7), 23 + r), sym)
        end = np.where(pair, end[nxt], end)
        keep = ~second
        sym, start, end, low, high, doc = sym[keep], start[keep], end[keep], new_low[keep], new_high[keep], doc[keep]
    return low, high


class Windows:
    """All windows of a slice of texts: place (first word), text, name of the symbol picked, second fingerprint."""

    def __init__(self, w: Words, size: int):
        self.words, self.size = w, size
        n = len(w.start)
        place = np.arange(max(0, n - size + 1))
        self.place = place[w.doc[place] == w.doc[place + size - 1]] if len(place) else place
        self.doc = w.doc[self.place]
        if not len(self.place):
            self.key = np.zeros(0, U)
            self.new = np.zeros(0, bool)
            return
        h = w.fingerprints(1)
        low, high = recompress(h, w.doc)
        ranges = Runs(h)
        name = ranges.of(np.clip(low, 0, n), np.clip(high, 0, n))
        begin = np.searchsorted(low, self.place, "left")
        stop = np.searchsorted(high, self.place + size, "right")
        width = stop - begin
        best = [np.arange(len(name))]
        for k in range(max(1, int(width.max())).bit_length()):
            b, step = best[-1], 1 << k
            other = b[np.minimum(np.arange(len(b)) + step, len(b) - 1)]
            best.append(np.where(name[b] <= name[other], b, other))
        level = np.maximum(np.frexp(np.maximum(width, 1).astype(float))[1] - 1, 0)
        table = np.stack(best)
        b = np.minimum(begin, len(name) - 1)
        one, two = table[level, b], table[level, np.maximum(np.minimum(stop - (1 << level), len(name) - 1), 0)]
        pick = np.where(name[one] <= name[two], one, two)
        some = width > 0
        self.key = np.where(some, name[pick], mix(ranges.of(self.place, self.place + size), 5))
        pick = np.where(some, pick, -1 - self.place)
        self.new = np.ones(len(pick), bool)  # the first of the windows in a row that pick one symbol
        self.new[1:] = (pick[1:] != pick[:-1]) | (self.doc[1:] != self.doc[:-1])

    def second(self, which: np.ndarray) -> np.ndarray:
        return Runs(self.words.fingerprints(2)).of(self.place[which], self.place[which] + self.size)


def _unique(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, value) pairs and how often each occurs."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(head)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def _shared(window: Windows, column: pa.Array) -> np.ndarray:
    """Which windows picked a symbol that occurs elsewhere."""
    known = np.asarray(column.flatten(), dtype=np.int64).view(U)
    return np.isin(window.key, known) if len(known) else np.zeros(len(window.key), bool)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept (the words left, joined by blanks).

    A word goes if a window of `size` words that covers it also starts earlier: in a row of smaller id, or earlier in the
    same row. Windows are those of the input. Null, empty and short texts lose nothing. Rows that repeat an id do not
    come before each other. Other columns of docs are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, TEXT):
                w = words(b.column(1))
                window = Windows(w, size)
                doc, key, n = _unique(window.doc[window.new], window.key[window.new])
                # the symbol of a whole text, with a second fingerprint
                counts = np.diff(w.first)
                long = np.flatnonzero(counts >= size)
                tops = [Runs(w.fingerprints(s)).of(w.first[long], w.first[long + 1]) for s in (1, 2)]
                ids = b.column(0).take(pa.array(np.concatenate([doc, long])))
                second = pa.array(np.concatenate([np.zeros(len(doc), U), tops[1] | U(1)]).view(np.int64))  # 0: not of a whole text
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([key, tops[0]]).view(np.int64)), second, pa.array(np.concatenate([n, np.ones(len(long), np.int64)]))], names=["id", "key", "top", "n"])

    found = rows.mapInArrow(symbols, f"id {kind}, key long, top long, n long")
    shared = found.groupBy("key", "top").agg(F.sum("n").alias("all"), F.min("id").alias("least")).filter("all > 1")
    hit = found.select("id", "key", "top").join(shared.select("key", "top", "least"), ["key", "top"])
    known = hit.groupBy("id").agg(
        F.collect_list(F.when(F.col("top") == 0, F.col("key"))).alias("keys"),
        F.coalesce(F.bool_or(F.when(F.col("top") != 0, F.col("least") < F.col("id"))), F.lit(False)).alias("copy"),
    )
    base = rows.join(known, "id", "left").select("id", "t", "keys", F.coalesce("copy", F.lit(False)).alias("copy"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, TEXT):
                copies = np.asarray(b.column(3))
                b = b.filter(pa.array(~copies))
                window = Windows(words(b.column(1)), size)
                some = np.flatnonzero(_shared(window, b.column(2)))
                value = window.second(some) if len(some) else np.zeros(0, U)
                order = np.lexsort((value, window.key[some], window.doc[some]))
                doc, key, value = window.doc[some][order], window.key[some][order], value[order]
                head = np.ones(len(doc), bool)
                head[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]) | (key[1:] != key[:-1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[head])), pa.array(key[head].view(np.int64)), pa.array(value[head].view(np.int64))], names=["id", "key", "value"])

    # the first document of each window; documents that copy an earlier one whole have no firsts
    first = base.mapInArrow(candidates, f"id {kind}, key long, value long").groupBy("key", "value").agg(F.min("id").alias("id"))
    firsts = first.groupBy("id").agg(F.collect_list("value").alias("firsts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, TEXT):
                w = words(b.column(1))
                copies = np.asarray(b.column(3))
                window = Windows(w, size)
                some = np.flatnonzero(_shared(window, b.column(2)) & ~copies[window.doc])
                keep = np.ones(len(w.start), bool)
                if len(some):
                    value, doc = window.second(some), window.doc[some]
                    gone = np.zeros(len(w.start) + 1, np.int64)
                    bounds = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    for x, y in zip(bounds, np.append(bounds[1:], len(doc)), strict=True):
                        v = value[x:y]
                        mine = b.column(4)[int(doc[x])].values
                        again = np.ones(y - x, bool)
                        again[np.unique(v, return_index=True)[1]] = False
                        if mine is None or not len(mine):
                            again[:] = True
                        else:
                            again |= ~np.isin(v, np.asarray(mine, dtype=np.int64).view(U))
                        at = window.place[some[x:y][again]]
                        gone[at] += 1
                        gone[at + size] -= 1
                    keep = np.cumsum(gone[:-1]) == 0
                counts = np.diff(w.first)
                keep &= ~(copies & (counts >= size))[w.doc] if len(w.doc) else keep
                texts, removed = [], []
                for k in range(len(b)):
                    own = keep[w.first[k] : w.first[k + 1]]
                    parts = w.raw(k).split()
                    removed.append(len(own) - int(own.sum()))
                    texts.append(b" ".join(parts if not removed[-1] else itertools.compress(parts, own.tolist())))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return base.join(firsts, "id", "left").mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
