"""Spelling variants of a corpus's words by search schemes over bidirectional FM-indexes.

Two words are near if one edit leads from one to the other. That edit lies in the first or in the second half of the word
that asks, so that one of its halves stands in the other word unchanged. A search therefore matches one half exactly, with
the delimiter at its end, and extends across the other half with one error, up to the delimiter there. It holds the ranks of
the suffixes that go on with what is matched, in the index of the delimited words and in that of their reversal, and moves
both at once when it extends to either side. An interval that is left at the end is one word.

The vocabulary is dealt to indexes of bounded size by the halves: a word is held where words that may ask for it with that
half are, and asks where its own half is. A half that too many words share is spread over several indexes, and asks in all
of them. Nothing is searched in a whole vocabulary at once, and no words are paired but those the index finds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

#: The characters of words. Only A-Z are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one index, about. One half's words stay together up to so many as well.
BLOCK = 8192
END, GAP = 0, 1


class Ranks:
    """Symbols of an array in a wavelet matrix: how many of each lie before a place, and how many smaller ones in a range."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, (size - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in reversed(range(self.bits)):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.begin = np.searchsorted(self._key(symbols), self._key(np.arange(1 << self.bits)))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.bits))])  # symbols below each

    def _key(self, symbols: np.ndarray) -> np.ndarray:
        """The order that the last level is in: by the bits reversed."""
        out = np.zeros_like(symbols)
        for b in range(self.bits):
            out |= ((symbols >> b) & 1) << (self.bits - 1 - b)
        return out

    def one(self, low: np.ndarray, width: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each range: the rank of its first c among all symbols, how many c it has, how many smaller ones."""
        high, smaller = low + width, np.zeros(len(low), np.int64)
        for k in range(self.bits):
            bit = (c >> (self.bits - 1 - k)) & 1 == 1
            x, y = self.ones[k][low], self.ones[k][high]
            smaller += np.where(bit, (high - low) - (y - x), 0)
            low, high = np.where(bit, self.zeros[k] + x, low - x), np.where(bit, self.zeros[k] + y, high - y)
        return self.less[c] + low - self._first(c), high - low, smaller

    def _first(self, c: np.ndarray) -> np.ndarray:
        return self.begin[c]

    def all(self, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for every symbol that a range has: the range's number, the symbol, and the three."""
        which, c, high, smaller = np.arange(len(low)), np.zeros(len(low), np.int64), low + width, np.zeros(len(low), np.int64)
        for k in range(self.bits):
            x, y = self.ones[k][low], self.ones[k][high]
            zeros = (high - low) - (y - x)
            left, right = np.flatnonzero(zeros > 0), np.flatnonzero(y > x)
            low, high = np.concatenate([(low - x)[left], self.zeros[k] + x[right]]), np.concatenate([(high - y)[left], self.zeros[k] + y[right]])
            smaller = np.concatenate([smaller[left], (smaller + zeros)[right]])
            which, c = np.concatenate([which[left], which[right]]), np.concatenate([2 * c[left], 2 * c[right] + 1])
        return which, c, self.less[c] + low - self._first(c), high - low, smaller


def suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text, by doubling what suffixes are sorted by."""
    rank, step = text.astype(np.int64), 1
    while True:
        later = np.zeros(len(rank), np.int64)
        later[: len(rank) - step] = rank[step:] + 1
        key = rank * (len(rank) + int(rank.max()) + 2) + later
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(len(rank), np.int64)
        rank[order] = new
        if new[-1] == len(rank) - 1:
            return order
        step *= 2


@dataclass
class States:
    """Searches under way: who asks, how far it is in its pattern, its errors, and its intervals in both indexes."""

    ask: np.ndarray
    at: np.ndarray
    errors: np.ndarray
    near: np.ndarray  # first rank in the index that is extended
    other: np.ndarray  # first rank in the other one
    width: np.ndarray

    def take(self, which: np.ndarray) -> States:
        return States(*(x[which] for x in (self.ask, self.at, self.errors, self.near, self.other, self.width)))

    @staticmethod
    def together(parts: list[States]) -> States:
        return States(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("ask", "at", "errors", "near", "other", "width")))


class Index:
    """A bidirectional FM-index of delimited words, given as rows of codes from 2 on (0 beyond their lengths)."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, size: int):
        self.words = len(codes)
        text = np.full(int(lengths.sum()) + len(codes) + 2, GAP, np.int64)
        text[-1] = END
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = np.arange(codes.shape[1]) < lengths[:, None]
        text[(begin[:-1, None] + 1 + np.arange(codes.shape[1]))[inside]] = codes[inside]
        back = np.append(text[-2::-1], END)
        self.order = suffixes(text)
        self.left = Ranks(text[self.order - 1], size)  # what stands before, by the text's suffixes
        self.right = Ranks(back[suffixes(back) - 1], size)  # what follows, by the suffixes of the reversal
        self.word_at = np.full(len(text), -1)
        self.word_at[begin[:-1]] = np.arange(len(codes))

    def search(self, codes: np.ndarray, lengths: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(who asks, word) for all words one edit away whose edit lies behind the first half, or before the second."""
        half = lengths // 2
        n = len(codes)
        pad = np.full((n, 1), GAP, np.int64)
        whole = np.concatenate([pad, codes, pad], axis=1)
        whole[np.arange(n), lengths + 1] = GAP
        # the half that stays from its inner end outwards, then the other one outwards, each with its delimiter
        stay_n, other_n = (half, lengths - half) if first else (lengths - half, half)
        inner, step = (half, -1) if first else (half + 1, 1)
        stay, other = (self.left, self.right) if first else (self.right, self.left)
        s = States(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.order)))
        for t in range(int(stay_n.max(initial=0)) + 1):
            going = np.flatnonzero(t <= stay_n[s.ask])
            done = np.flatnonzero(t > stay_n[s.ask])
            g = s.take(going)
            near, width, smaller = stay.one(g.near, g.width, whole[g.ask, inner[g.ask] + step * t])
            g = States(g.ask, g.at, g.errors, near, g.other + smaller, width)
            s = States.together([g.take(np.flatnonzero(width > 0)), s.take(done)])
        s = States(s.ask, s.at, s.errors, s.other, s.near, s.width)
        found: list[States] = []
        while len(s.ask):
            over = s.at > other_n[s.ask]
            found.append(s.take(np.flatnonzero(over & (s.errors == 1))))
            s = s.take(np.flatnonzero(~over))
            want = whole[s.ask, (inner - step)[s.ask] - step * s.at]
            near, width, smaller = other.one(s.near, s.width, want)
            parts = [States(s.ask, s.at + 1, s.errors, near, s.other + smaller, width).take(np.flatnonzero(width > 0))]
            clean = s.take(np.flatnonzero(s.errors == 0))
            want, inside = want[s.errors == 0], clean.at < other_n[clean.ask]
            skip = clean.take(np.flatnonzero(inside))  # a character that the other word lacks
            parts.append(States(skip.ask, skip.at + 1, skip.errors + 1, skip.near, skip.other, skip.width))
            which, c, near, width, smaller = other.all(clean.near, clean.width)
            letter = c > GAP
            for use, on in ((letter, 0), (letter & (c != want[which]) & inside[which], 1)):  # one more, and another one
                k = np.flatnonzero(use)
                g = clean.take(which[k])
                parts.append(States(g.ask, g.at + on, g.errors + 1, near[k], g.other + smaller[k], width[k]))
            s = States.together(parts)
        f = States.together(found) if found else s
        # one of the two intervals is that of the text's suffixes
        ranks = f.other if first else f.near
        pairs = np.unique(np.stack([f.ask, self.word_at[self.order[ranks]]]), axis=1) if len(ranks) else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Words as rows of symbols from 2 on, their lengths, and the number of symbols."""
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    known, symbol = np.unique(points, return_inverse=True)
    out = np.zeros((len(words), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = symbol + 2
    return out, lengths, len(known) + 2


def search_block(table: pa.Table) -> pa.Table:
    """All near words among those that one block holds, for those that ask in it."""
    table = table.combine_chunks()
    words = table.column("word").to_pylist()
    codes, lengths, size = _codes(words)
    n = np.asarray(table.column("n"), dtype=np.int64)
    asks, held = (np.flatnonzero(np.asarray(table.column(c))) for c in ("asks", "held"))
    if not len(asks) or not len(held):
        return pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
    index = Index(codes[held], lengths[held], size)
    who, word = index.search(codes[asks], lengths[asks], bool(table.column("first")[0].as_py()))
    near = held[word]
    take = lambda k: table.column("word").take(pa.array(k))
    return pa.table({"word": take(asks[who]), "near": take(near), "near_n": pa.array(n[near])})


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, near_n for all pairs of words (word, n) of a vocabulary that are one edit apart, both ways."""
    size = F.length("word")

    def keys(first: bool) -> Column:
        """The halves a word is held under: those of words that are shorter by one, as long, or longer by one."""
        cut = lambda n: F.substring("word", F.lit(1), F.floor(n / 2).cast("int")) if first else F.substring("word", -(n - F.floor(n / 2)).cast("int"), n.cast("int"))
        each = [F.struct(F.lit(first).alias("first"), cut(size + d).alias("key"), F.lit(d == 0).alias("asks"), F.lit(True).alias("held")) for d in (-1, 0, 1)]
        return F.array(*each)

    dealt = vocabulary.select("word", "n", F.explode(F.concat(keys(True), keys(False))).alias("k"))
    dealt = dealt.groupBy("word", "n", "k.first", "k.key").agg(F.max("k.asks").alias("asks"))
    dealt = stored(dealt, "halves-of-words")
    blocks = max(1, dealt.count() // block)
    often = dealt.groupBy("first", "key").count().filter(F.col("count") > block)
    often = often.select("first", "key", F.ceil(F.col("count") / block).cast("int").alias("spread"))
    at = dealt.join(often, ["first", "key"], "left").withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("spread", F.lit(1))).cast("int"))
    # a half of its own block: asked in each part, held in one
    parts = F.when(F.col("asks") & F.col("spread").isNotNull(), F.sequence(F.lit(0), F.col("spread") - 1)).otherwise(F.array("part"))
    number = F.when(F.col("spread").isNull(), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("string")).otherwise(F.concat(F.lit("-"), "key"))
    rows = at.select("word", "n", "first", "asks", number.alias("block"), "part", F.explode(parts).alias("in"))
    rows = rows.select("word", "n", "first", "asks", (F.col("in") == F.col("part")).alias("held"), "block", "in")
    # a word whose halves of several lengths share a block is held there once
    rows = rows.groupBy("first", "block", "in", "word", "n").agg(F.max("asks").alias("asks"), F.max("held").alias("held"))
    found = rows.groupBy("first", "block", "in").applyInArrow(search_block, "word string, near string, near_n long")
    return found.distinct()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 199, least: int = 6) -> DataFrame:
    """word, n: the words of at least `least` characters, and how often they occur.

    Where `noise` divides the checksum h of '<id>:<run>', the run's character h modulo its length is left out.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least).select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    k = F.pmod("h", F.length("run")).cast("int")
    cut = let(k, lambda x: F.concat(F.substring(F.col("run"), F.lit(1), x), F.substring(F.col("run"), x + 2, F.length("run"))))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", often: int = 5, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """One row per word with at least `often` occurrences: word, root, n, n_near, form, form_n.

    A word's form is the near word with most occurrences (ties: the least by code points), if it has `ratio` times as many;
    root is where its forms lead to, the word itself where it has none. Null and empty texts have no words, nor has an empty
    table; a null id counts as an empty one. Rows that repeat count as often as they come. Texts of any length are read
    whole; other columns of docs are ignored.
    """
    words = stored(word_counts(docs, id_col, text_col).filter(F.col("n") >= often), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best")
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), best)
    form = F.when(-F.col("best.minus") >= F.col("n") * ratio, F.col("best.form"))
    words = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.minus")).alias("form_n"))
    words = stored(words, "word-forms")
    # each round doubles how many forms are followed; occurrences grow with each of them, so that they come to an end
    up = words.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = stored(up.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "word-roots")
        if up.filter("moved").isEmpty():
            break
        up = up.drop("moved")
    return words.join(up.select("word", "root"), "word", "left").select("word", F.coalesce("root", "word").alias("root"), "n", "n_near", "form", "form_n")
