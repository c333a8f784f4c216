"""Alignment of two tokenizers over the same texts by lockstep merging.

A text's tokens by A and by B are two walks over the same bytes. All texts of a slice are walked at once: one state vector
holds a pointer into A's and one into B's tokens for each of them. A step moves the pointer whose token ends first, or
both where they end together; there it emits a cut, and with it the group of tokens since the last one, which are linked
with each other. Texts that are through leave the vector. A long text is walked as several, from places where both have a
token end.

How many documents hold a pair of ids linked is counted over the whole corpus. Slices are written with their distinct pairs,
counts are joined to these, and each slice adds up its documents: pairs are shuffled once a slice, not once a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, _places, default_vocabulary
from .common import settings, stored
from .words import slices

#: A text is walked from a new place after so many tokens of A, if B has a token end at one of the next few.
LANE, TRIES = 1024, 32
#: Parts of texts that each encoder keeps, bytes of text and rows that are worked on at once: they bound a worker's memory.
KNOWN, SLICE, BATCH = 300_000, 1_000_000, {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: Groups with more links than this are counted by their distinct ids, not link by link.
WIDE = 4096


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces(Codec):
    """Encoder of a vocabulary of pieces whose blanks only stand in front, over texts that begin with the blank it adds."""

    def __init__(self, path: str, cache_size: int = 500_000, cached_bytes: int = 64):
        import sentencepiece

        from .bpe import Parts

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known, self.cached_bytes = Parts(cache_size), cached_bytes
        size = self.lib.get_piece_size()
        names = [self.lib.id_to_piece(i) for i in range(size)]
        own = [b"" if self.lib.is_control(i) else bytes([int(n[3:5], 16)]) if self.lib.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self._tokens(own)
        self.cuts = not any(" " in b.decode("utf-8", "replace").lstrip(" ") for b in own)  # no piece goes over a blank after something else

    def _new(self, raw: list[bytes]) -> list[bytes]:
        # a blank alone stands at the end of a text; an empty text would get none
        made = self.lib.encode([r[1:].decode() for r in raw], num_threads=1)
        return [np.array(x if len(r) > 1 else [self.lib.piece_to_id("▁")], "<u4").tobytes() for r, x in zip(raw, made, strict=True)]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        return self._cut_at(data, offsets - offsets[0], (data == 32) & self.cuts)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, i: np.ndarray, j: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Groups of all walks as rows [first of A, end in A, first of B, end in B], in the order of A.

    i and j are the walks' first tokens, last the end of their tokens of A. Both walks of a text end at the same byte.
    """
    out, low_i, low_j = [np.zeros((4, 0), np.int64)], i, j
    while len(i):
        a, b = end_a[i], end_b[j]
        i, j = i + (a <= b), j + (b <= a)
        cut = np.flatnonzero(a == b)
        if len(cut):
            out.append(np.stack([low_i[cut], i[cut], low_j[cut], j[cut]]))
            low_i, low_j = low_i.copy(), low_j.copy()
            low_i[cut], low_j[cut] = i[cut], j[cut]
            alive = i < last
            if not alive.all():
                i, j, low_i, low_j, last = i[alive], j[alive], low_i[alive], low_j[alive], last[alive]
    groups = np.concatenate(out, axis=1)
    return groups[:, np.argsort(groups[0], kind="stable")]


def walks(end_a: np.ndarray, end_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where walks begin in A and in B, and end in A. Ends grow over all texts, so that they name places of a slice."""
    some = np.flatnonzero(np.diff(at_a))
    i, j, last = [at_a[some]], [at_b[some]], [at_a[some + 1]]
    for k in some[np.diff(at_a)[some] > 2 * LANE].tolist():
        place = np.arange(at_a[k] + LANE, at_a[k + 1] - LANE, LANE)[:, None] + np.arange(TRIES)
        there = np.searchsorted(end_b, end_a[place])
        both = end_b[there] == end_a[place]
        row = np.flatnonzero(both.any(axis=1))
        pick = both[row].argmax(axis=1)
        i.append(place[row, pick] + 1)
        j.append(there[row, pick] + 1)
        last.append(np.full(len(row), at_a[k + 1]))
    i, j, last = map(np.concatenate, (i, j, last))
    order = np.argsort(i, kind="stable")
    i, j, last = i[order], j[order], last[order]
    last[:-1] = np.minimum(last[:-1], i[1:])
    return i, j, last


def _same_bytes(codec: Codec, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the tokens of each text give its bytes."""
    sizes = codec.lengths[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])[at]
    own = codec.flat[_places(codec.starts[ids], sizes)]
    if np.array_equal(ends, offsets) and np.array_equal(own, data):
        return np.ones(len(at) - 1, bool)
    return np.array([np.array_equal(own[ends[k] : ends[k + 1]], data[offsets[k] : offsets[k + 1]]) for k in range(len(at) - 1)])


class _Names:
    """The decimal ids with each of the marks that may follow, as one array of bytes."""

    def __init__(self, size: int):
        names = [f"{i}{mark}".encode() for mark in ",|;" for i in range(size)]
        self.size, self.lengths = size, np.array([len(x) for x in names], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(names), np.uint8)


_names: dict[int, _Names] = {}


def written(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Groups of each text as a1,a2|b1;a3|b2,b3. first: the first group of each text, and their number."""
    size = 1 << int(max(ids_a.max(initial=0), ids_b.max(initial=0)) + 1).bit_length()
    names = _names.setdefault(size, _Names(size))
    na, nb = groups[1] - groups[0], groups[3] - groups[2]
    begin = np.concatenate([[0], np.cumsum(na + nb)])
    code = np.empty(begin[-1], np.int64)
    put_a, put_b = _places(begin[:-1], na), _places(begin[:-1] + na, nb)
    code[put_a], code[put_b] = ids_a[_places(groups[0], na)], ids_b[_places(groups[2], nb)]
    code[begin[:-1] + na - 1] += size
    code[begin[1:] - 1] += 2 * size
    sizes = names.lengths[code]
    ends = np.concatenate([[0], np.cumsum(sizes)])[begin][first]
    text = names.flat[_places(names.starts[code], sizes)].tobytes()
    return [text[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def linked(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair of ids, links) for all links, some of them several times; a pair is A's id times 2^32 and B's."""
    na, nb = groups[1] - groups[0], groups[3] - groups[2]
    small = np.flatnonzero(na * nb <= WIDE)
    count = (na * nb)[small]
    group = np.repeat(small, count)
    nth = _places(np.zeros(len(small), np.int64), count)
    a, b = ids_a[groups[0][group] + nth // nb[group]], ids_b[groups[2][group] + nth % nb[group]]
    docs, pairs, links = [doc[group]], [(a.astype(np.int64) << 32) | b], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(na * nb > WIDE).tolist():
        (x, nx), (y, ny) = (np.unique(ids[lo:hi], return_counts=True) for ids, lo, hi in ((ids_a, groups[0][g], groups[1][g]), (ids_b, groups[2][g], groups[3][g])))
        pairs.append(((x.astype(np.int64)[:, None] << 32) | y).ravel())
        links.append((nx[:, None] * ny).ravel())
        docs.append(np.full(len(x) * len(y), doc[g]))
    return np.concatenate(docs), np.concatenate(pairs), np.concatenate(links)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pieces: str | None = None, groups: bool = False) -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, if wanted).

    A is a byte-level vocabulary over a blank and the text, B one of pieces, which adds the blank. Strings of special tokens
    are plain text. A text that is null or empty, or that tokens of A or of B don't give back byte for byte, has no tokens:
    zeros and empty strings. Rows that repeat an id, also a null one, are documents of their own. Texts of any length are
    taken whole; groups of any size are linked whole. An empty table gives none. Other columns of docs are ignored.
    """
    path_a, path_b = vocabulary or default_vocabulary(), pieces or default_pieces()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    schema = f"slice long, ids array<{kind}>, {', '.join(f'{n} array<long>' for n in numbers)}, sha array<string>, {'text array<string>, ' * groups}link_at binary, link_pair binary, link_n binary, a array<int>, b array<int>, docs array<int>"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Codec.of(path_a, True, KNOWN), Pieces.of(path_b, KNOWN)
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                texts = pc.binary_join_element_wise(pa.scalar(" "), batch.column(1), "").cast(pa.large_string())
                raw = texts.cast(pa.large_binary())
                offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
                data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                (ids_a, at_a), (ids_b, at_b) = one.encode_array(texts), two.encode_array(texts)
                good = (np.diff(offsets) > 1) & _same_bytes(one, ids_a, at_a, data, offsets) & _same_bytes(two, ids_b, at_b, data, offsets)
                if not good.all():
                    ids_a, ids_b = ids_a[np.repeat(good, np.diff(at_a))], ids_b[np.repeat(good, np.diff(at_b))]
                    at_a, at_b = (np.concatenate([[0], np.cumsum(np.diff(at) * good)]) for at in (at_a, at_b))
                end_a, end_b = np.cumsum(one.lengths[ids_a]), np.cumsum(two.lengths[ids_b])
                found = lockstep(end_a, end_b, *walks(end_a, end_b, at_a, at_b))
                first = np.searchsorted(found[0], at_a)
                doc = np.repeat(np.arange(len(batch)), np.diff(first))
                text = written(ids_a, ids_b, found, first)
                n_links = np.diff(np.concatenate([[0], np.cumsum((found[1] - found[0]) * (found[3] - found[2]))])[first])
                of, pair, links = linked(ids_a, ids_b, found, doc)
                pairs, local = np.unique(pair, return_inverse=True)
                each, back = np.unique(of * len(pairs) + local, return_inverse=True)
                times = np.bincount(back, weights=links, minlength=len(each)).astype(np.int64)  # exact below 2^53
                of, local = each // max(1, len(pairs)), each % max(1, len(pairs))
                row = {
                    "slice": [number], "ids": [batch.column(0)],
                    "n_a": [np.diff(at_a)], "n_b": [np.diff(at_b)], "n_groups": [np.diff(first)], "n_links": [n_links],
                    "sha": [[hashlib.sha256(x).hexdigest() if x else "" for x in text]],
                    **({"text": [[x.decode() for x in text]]} if groups else {}),
                    "link_at": [np.searchsorted(of, np.arange(len(batch) + 1)).astype("<i8").tobytes()],
                    "link_pair": [local.astype("<i4").tobytes()], "link_n": [times.astype("<i8" if times.max(initial=0) >> 31 else "<i4").tobytes()],
                    "a": [(pairs >> 32).astype(np.int32)], "b": [(pairs & 0xFFFFFFFF).astype(np.int32)], "docs": [np.bincount(local, minlength=len(pairs)).astype(np.int32)],
                }
                out = {k: pa.ListArray.from_arrays(pa.array([0, len(v[0])], pa.int32()), v[0]) if isinstance(v[0], pa.Array) else pa.array(v) for k, v in row.items()}
                yield pa.RecordBatch.from_pydict(out)
                number += 1

    with settings(docs.sparkSession, BATCH):
        made = stored(rows.mapInArrow(walk, schema), "token-slices")
    pairs = made.select("slice", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("at", "p")).select("slice", "at", "p.a", "p.b", "p.docs")
    totals = stored(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "token-pairs")
    top = totals.groupBy("a").agg(F.max("count").alias("top"))
    known = totals.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    looked = pairs.select("slice", "at", "a", "b").join(known, ["a", "b"]).select(F.col("slice").alias("of"), "at", "count", "best")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).combine_chunks()
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = np.asarray(right.column("at"), dtype=np.int64)
        count[at], best[at] = np.asarray(right.column("count"), dtype=np.int64), np.asarray(right.column("best").cast(pa.int64()))
        get = lambda n, k: np.frombuffer(row.column(n)[0].as_py(), k)
        link_at, pair = get("link_at", "<i8"), get("link_pair", "<i4")
        raw = row.column("link_n")[0].as_py()
        n = np.frombuffer(raw, "<i4" if len(raw) == 4 * len(pair) else "<i8").astype(np.int64)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[link_at])
        flat = lambda name: row.column(name).combine_chunks().values if isinstance(row.column(name), pa.ChunkedArray) else row.column(name).values
        columns = [flat("ids"), *[flat(x) for x in numbers], pa.array(total(n * best[pair])), pa.array(total(n * count[pair])), flat("sha")]
        return pa.table([*columns, *([flat("text")] if groups else [])], names=names)

    names = [id_col, *numbers, "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else [])]
    out = ", ".join(f"`{n}` {k}" for n, k in zip(names, [kind, *["long"] * 6, *["string"] * 2], strict=False))
    slim = made.drop("a", "b", "docs")
    return slim.groupBy("slice").cogroup(looked.groupBy("of")).applyInArrow(add, out)
