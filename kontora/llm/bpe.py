"""BPE encoding and decoding with a public vocabulary, long texts by tree concatenation.

A text up to `piece` characters is encoded where it lies. A longer one is halved until every piece is short enough, the
pieces are encoded in parallel as rows of their own, and neighbours are joined pairwise, level by level. At a join only a
window around the seam is encoded again; it grows until its tokens run in step with the tokens on both sides, and the
rest of both sides stays as it is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BYTE_BASE, Ranges, byte_table, slices

PIECE = 32768
BLOCK_BYTES = 1_000_000
AGREE = 4
#: A text is cut before a blank or line feed that follows anything but white space: there, and whatever stands around
#: it, the vocabulary's splitting rule always ends a word. Texts with other white space are encoded in one go.
_ODD = re.compile("[^\\S \n]|᠎")
#: ASCII letters and digits, and signs. The rule also ends a word between these two.
_WORD = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_SIGNS = np.array([32 < b < 127 for b in range(256)]) & ~_WORD
#: Bytes of other white space, and first two bytes of the longer ones (and of some other characters).
_ODD_BYTES = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
_ODD_PAIRS = ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _char_bytes() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest for 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _places(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... for counts[k] places, one k after the other."""
    ends = np.cumsum(counts)
    return np.repeat(begin - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    if size <= len(a):
        return a
    out = np.empty(max(size, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class Parts:
    """Parts of texts that were met before: their bytes and their ids, in arrays, found by fingerprint.

    Beyond `most` parts, those that were not met again since the last time are forgotten, and of the others the older ones
    beyond half of `most`.
    """

    def __init__(self, most: int):
        self.most, self.count = most, 0
        self.sorted, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)  # fingerprints in order, and whose they are
        self.keys, self.met = np.empty(1024, np.uint64), np.empty(1024, bool)
        self.data_at, self.ids_at = np.zeros(1025, np.int64), np.zeros(1025, np.int64)
        self.data, self.ids = np.empty(1 << 14, np.uint8), np.empty(1 << 14, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of fingerprints, -1 for new ones."""
        if not len(self.sorted):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.slots[at], -1)

    def add(self, keys: np.ndarray, raw: list[bytes], ids: list[bytes]) -> None:
        n, new = self.count, len(keys)
        self.keys, self.met = _grown(self.keys, n + new), _grown(self.met, n + new)
        self.data_at, self.ids_at = _grown(self.data_at, n + new + 1), _grown(self.ids_at, n + new + 1)
        self.keys[n : n + new], self.met[n : n + new] = keys, False
        for at, name, items, kind in ((self.data_at, "data", raw, np.uint8), (self.ids_at, "ids", ids, np.dtype("<u4"))):
            flat = np.frombuffer(b"".join(items), kind)
            at[n + 1 : n + new + 1] = at[n] + np.cumsum([len(x) // flat.itemsize for x in items])
            held = _grown(getattr(self, name), int(at[n + new]))
            held[at[n] : at[n + new]] = flat
            setattr(self, name, held)
        order = np.argsort(keys)
        at = np.searchsorted(self.sorted, keys[order])
        self.sorted, self.slots = np.insert(self.sorted, at, keys[order]), np.insert(self.slots, at, n + order)
        self.count = n + new

    def cut(self, count: int) -> None:
        """Forget all parts but the first `count`."""
        if count < self.count:
            stay = self.slots < count
            self.sorted, self.slots, self.count = self.sorted[stay], self.slots[stay], count

    def shrink(self, most: int | None = None) -> None:
        """Forget the parts that were not met again since the last time, and the older ones of too many."""
        keep = np.flatnonzero(self.met[: self.count])
        keep = keep[max(0, len(keep) - (self.most // 2 if most is None else most)) :]
        for name, at_name in (("data", "data_at"), ("ids", "ids_at")):
            at, flat = getattr(self, at_name), getattr(self, name)
            sizes = at[keep + 1] - at[keep]
            setattr(self, name, _grown(flat[_places(at[keep], sizes)], 1 << 14))
            setattr(self, at_name, _grown(np.concatenate([[0], np.cumsum(sizes)]), 1025))
        self.keys, self.count = _grown(self.keys[keep], 1024), len(keep)
        self.met = _grown(np.zeros(len(keep), bool), 1024)
        self.slots = np.argsort(self.keys[: len(keep)])
        self.sorted = self.keys[self.slots]


class Codec:
    """Encoder and decoder of one worker process. Ids are numpy arrays of little-endian unsigned 32-bit integers."""

    _made: dict[tuple, Codec] = {}

    def __init__(self, path: str, plain: bool = False, cache_size: int = 500_000, cached_bytes: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.lib.encode_special_tokens = plain  # their strings are then ordinary text
        self.known, self.cached_bytes = Parts(cache_size), cached_bytes
        bytes_of, added = _char_bytes(), self.lib.get_added_tokens_decoder()
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self._tokens([added[i].content.encode() if i in added else bytes(bytes_of[c] for c in self.lib.id_to_token(i)) for i in range(size)])
        self.signs = _SIGNS.copy()
        self.signs[list(b"".join(t.content.encode() for t in added.values()))] = False  # so that no added token is cut

    def _tokens(self, table: list[bytes]) -> None:
        """The bytes of each token, and arrays made of them."""
        self.table = table
        self.lengths = np.array([len(b) for b in self.table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(self.table), np.uint8)
        self.leads = np.array([not b or b[0] & 0xC0 != 0x80 for b in self.table])

    @classmethod
    def of(cls, path: str, *how) -> Codec:
        key = (cls, path, *how)
        if key not in cls._made:
            cls._made[key] = cls(path, *how)
        return cls._made[key]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, raw: list[bytes]) -> list[bytes]:
        """The ids of each part. Parts that start with white space follow each other in one text, which is cut again
        at the bytes where they start: words always end there."""
        alone = [k for k, p in enumerate(raw) if p[0] not in b" \n" or p[-1] in b" \n"]  # white space at an end could run on
        out: list[bytes] = [b""] * len(raw)
        for k, ids in zip(alone, self._whole([raw[k].decode() for k in alone]), strict=True):
            out[k] = ids
        rest = [k for k, p in enumerate(raw) if p[0] in b" \n" and p[-1] not in b" \n"]
        for x in range(0, len(rest), 4096):
            some = rest[x : x + 4096]
            joined = b"".join(raw[k] for k in some).decode()
            ids = np.array(self.lib.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(raw[k]) for k in some])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="left") + 1
            flat, begin = ids.tobytes(), 0
            for k, cut in zip(some, cuts.tolist(), strict=True):
                out[k] = flat[4 * begin : 4 * cut]
                begin = cut
        return out

    def _block(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts of a block, and how many each has. starts are places in data, each part ends where the next starts."""
        known = self.known
        keys, first, number = np.unique(Ranges(byte_table(5)[data], BYTE_BASE).of(starts, ends), return_index=True, return_inverse=True)
        slots = known.find(keys)
        new = np.flatnonzero(slots < 0)
        known.met[slots[slots >= 0]] = True
        if known.count + len(new) > known.most:
            known.shrink()
            slots = known.find(keys)
            new = np.flatnonzero(slots < 0)
            known.met[slots[slots >= 0]] = True
        sizes = ends - starts
        size = sizes[first[new]]
        new = new[np.argsort(size > self.cached_bytes, kind="stable")]  # long ones last, to be forgotten again
        stay = known.count + int((size <= self.cached_bytes).sum())
        if len(new):
            raw = [data[a:b].tobytes() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            slots[new] = np.arange(known.count, known.count + len(new))
            known.add(keys[new], raw, self._new(raw))
        slot = slots[number]
        # the bytes themselves are compared, so that no two parts are taken for each other
        same = known.data_at[slot + 1] - known.data_at[slot] == sizes
        there = np.repeat(known.data_at[slot] - starts, sizes) + np.arange(len(data))
        if not same.all() or (known.data[np.minimum(there, len(known.data) - 1)] != data).any():
            known.cut(stay)
            ids = self._new([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids])
        counts = known.ids_at[slot + 1] - known.ids_at[slot]
        out = known.ids[_places(known.ids_at[slot], counts)]
        known.cut(stay)
        return out, counts

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with white space other than blanks and line feeds."""
        after = np.append(data[1:], np.uint8(0))
        seen = _ODD_BYTES[data]
        for lead, follow in _ODD_PAIRS:
            at = np.flatnonzero(data == lead)
            seen[at[np.isin(after[at], follow)]] = True
        texts = np.unique(np.searchsorted(offsets, np.flatnonzero(seen), "right") - 1)
        return np.array([k for k in texts.tolist() if _ODD.search(data[offsets[k] : offsets[k + 1]].tobytes().decode())], np.int64)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the places where each text's begin (and the last ends)."""
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        odd = self._odd(data, offsets)
        if len(odd):
            plain = np.ones(len(texts), bool)
            plain[odd] = False
            own = dict(zip(odd.tolist(), self._whole([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in odd]), strict=True))
            ids, at = self.encode_array(texts.filter(pa.array(plain)).cast(pa.large_string()))
            place = np.cumsum(plain) - 1
            each = [np.frombuffer(own[k], "<u4") if k in own else ids[at[place[k]] : at[place[k] + 1]] for k in range(len(texts))]
            return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        white = (data == 32) | (data == 10)
        return self._cut_at(data, offsets, white, self._tails(data, white))

    def rest(self) -> None:
        """Between two tasks a worker keeps only parts that come again, as it may wait while others work."""
        if self.known.count > self.known.most // 4:
            self.known.shrink(self.known.most // 8)

    def _tails(self, data: np.ndarray, white: np.ndarray) -> np.ndarray:
        """Places where nothing but signs follows a letter or digit up to the next white byte: words that differ in such
        signs only share a part."""
        sign = self.signs[data]
        at = np.flatnonzero(sign[1:] & _WORD[data[:-1]]) + 1
        others = np.append(np.flatnonzero(~sign), len(data))
        return at[np.append(white, True)[others[np.searchsorted(others, at)]]]

    def _cut_at(self, data: np.ndarray, offsets: np.ndarray, white: np.ndarray, tails: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, encoded in parts that begin at white bytes after others, and at tails."""
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = white[1:] & ~white[:-1]
        if tails is not None:
            begins[tails] = True
        begins[offsets] = True
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(data))
        flats, counts, low = [], [], 0
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + BLOCK_BYTES)))
            a, b = starts[low], ends[high - 1]
            flat, count = self._block(data[a:b], starts[low:high] - a, ends[low:high] - a)
            flats.append(flat)
            counts.append(count)
            low = high
        if not flats:
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(flats), total[np.searchsorted(starts, offsets)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        ids, at = self.encode_array(pa.array(texts, pa.large_string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode_array(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """As the library decodes with special tokens kept: bytes of all tokens, bad UTF-8 replaced."""
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])[at]
        raw = pa.py_buffer(self.flat[_places(self.starts[ids], sizes)])
        out = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64)), raw])
        try:
            return out.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8, or of 2 GB and more
            return pa.array([x.as_py().decode("utf-8", "replace") for x in out], pa.string())

    def _step(self, ids: np.ndarray, at: np.ndarray, mid: np.ndarray, mid_at: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
        """First place where both sequences start the same AGREE tokens, all of them between low and high."""
        where = {int(p): k for k, p in enumerate(mid_at[:-1])}
        for k, p in enumerate(at[:-1]):
            m = where.get(int(p))
            if m is None or p < low or k + AGREE > len(ids) or m + AGREE > len(mid) or at[k + AGREE] > high:
                continue
            if (ids[k : k + AGREE] == mid[m : m + AGREE]).all():
                return k, m
        return None

    def join(self, left: np.ndarray, right: np.ndarray, window: int = 64) -> np.ndarray:
        """The ids of the text of left followed by the text of right.

        A window holds when its tokens run in step with both sides, and is taken when one of twice its size gives the
        same ids, or when it is the whole text. Inside one word of the splitting rule this is exact: tokens are a text's
        encoding if every two neighbours are that of theirs, and each two neighbours of the result stand next to each
        other in an encoding of the left, the right or the window.
        """
        before = None
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        ends = np.cumsum(self.lengths[left])
        starts = np.cumsum(self.lengths[right])
        while True:
            i = int(np.searchsorted(ends, ends[-1] - window, side="right"))
            while i > 0 and not self.leads[left[i]]:
                i -= 1
            j = min(len(right), int(np.searchsorted(starts, window)) + 1)
            while j < len(right) and not self.leads[right[j]]:
                j += 1
            a, b = left[i:], right[:j]
            raw = b"".join(map(self.table.__getitem__, [*a.tolist(), *b.tolist()]))
            mid = np.frombuffer(self.encode([raw.decode("utf-8")])[0], "<u4")
            at = lambda x: np.concatenate([[0], np.cumsum(self.lengths[x])])
            seam = int(self.lengths[a].sum())
            begin = (0, 0) if i == 0 else self._step(a, at(a), mid, at(mid), 0, seam)
            end = (len(b), len(mid)) if j == len(right) else self._step(b, at(b) + seam, mid, at(mid), seam, len(raw))
            if begin and end:
                now = np.concatenate([left[: i + begin[0]], mid[begin[1] : end[1]], right[end[0] :]])
                if i == 0 and j == len(right) or before is not None and np.array_equal(before, now):
                    return now
                before = now
            window *= 2

    def joined(self, pieces: list[bytes]) -> bytes:
        """Neighbours joined pairwise until one sequence is left."""
        level = [np.frombuffer(p, "<u4") for p in pieces]
        while len(level) > 1:
            level = [self.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0].tobytes()


def _coded(texts: pa.Array, codec: Codec) -> list[pa.Array]:
    """n_tokens, ids and decoded text of each text."""
    return _columns(*codec.encode_array(texts), codec)


def _columns(ids: np.ndarray, at: np.ndarray, codec: Codec) -> list[pa.Array]:
    buffers = [None, pa.py_buffer((4 * at).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]
    raw = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, buffers).cast(pa.binary())
    return [pa.array(np.diff(at).astype(np.int64)), raw, codec.decode_array(ids, at)]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, piece: int = PIECE) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded.

    A null or empty text has no tokens and decodes to the empty text. Repeated rows come out as often as they go in;
    other columns of docs are ignored. The ids are those of the whole text at any length.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = f"id {kind}, n_tokens long, ids binary, decoded string"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for b in slices(batch, 1, BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([b.column(0), *_coded(b.column(1), codec)], names=["id", "n_tokens", "ids", "decoded"])
        codec.rest()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for b in slices(batch, 3, BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _coded(b.column(3), codec)[1]], names=["row", "id", "no", "ids"])
        codec.rest()

    def whole(table: pa.Table) -> pa.Table:
        codec = Codec.of(path)
        table = table.sort_by("no")
        ids = np.frombuffer(codec.joined(table.column("ids").to_pylist()), "<u4")
        columns = _columns(ids, np.array([0, len(ids)]), codec)
        return pa.table([table.column("id").slice(0, 1).combine_chunks(), *columns], names=["id", "n_tokens", "ids", "decoded"])

    size = F.length("t")
    halvings = F.ceil(F.log2(size / F.lit(piece))).cast("int")
    # every round halves all pieces, so that a text is walked once a round
    half = lambda t: F.floor(F.length(t) / 2).cast("int")
    halves = lambda t: F.array(F.substring(t, F.lit(1), half(t)), F.substring(t, half(t) + 1, F.length(t)))
    cut = F.aggregate(F.sequence(F.lit(1), halvings), F.array("t"), lambda pieces, _: F.flatten(F.transform(pieces, halves)))
    long = rows.filter(size > piece).withColumn("row", F.monotonically_increasing_id()).select("row", "id", F.posexplode(cut).alias("no", "t"))
    spread = long.repartition("row", "no").mapInArrow(pieces, f"row long, id {kind}, no int, ids binary")
    return rows.filter(size <= piece).mapInArrow(short, schema).unionByName(spread.groupBy("row").applyInArrow(whole, schema))
