"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_RUN, let, unused

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is was for it with as on be at by this are from or "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "de la que el en y a los del se las por un para con no una su al lo "
    "le les des et est une du dans qui par pour au plus pas sur ne avec ce"
).split()
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Threshold table. A row: rule, metric, lowest and highest value that passes (None: open), words from which it applies.
RULES = (
    ("length", "n_words", 10, None, 0),
    ("repeated_words", "repeat_percent", None, 20, 0),
    ("word_length", "mean_word_chars", 2.0, 15.0, 10),
    ("symbols", "symbols_per_word", None, 0.1, 10),
    ("stop_words", "stop_word_ratio", 0.02, None, 50),
    ("duplicate_lines", "dup_line_ratio", None, 0.5, 10),
)
#: The rules whose failure counts as base_failed.
BASE = ("length", "repeated_words")


def _repeat_words(words: Column) -> Column:
    """Words inside a window of five words that the text holds twice or more.

    64-bit hashes of all windows come first: if they differ, so do the windows, and the answer is 0. Otherwise the
    windows themselves, as text, are sorted with their places and equal neighbours mark the places that repeat.
    """

    def gram(w: Column, i: Column, f) -> Column:
        return f(*[F.get(w, i + k) for k in range(WINDOW)])

    def places(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - WINDOW)

    def covered(starts: Column) -> Column:
        # a start covers five words, or as many as lie before the next start
        return F.aggregate(F.transform(starts, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - s, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x).cast("long")

    def exact(w: Column) -> Column:
        ordered = F.sort_array(F.transform(places(w), lambda i: F.struct(gram(w, i, lambda *c: F.concat_ws(" ", *c)).alias("g"), i.alias("i"))))
        twins = lambda s: F.filter(F.transform(s, lambda e, j: F.when((e.g == F.get(s, j - 1).g) | (e.g == F.get(s, j + 1).g), e.i)), lambda i: i.isNotNull())
        return let(ordered, lambda s: let(F.sort_array(twins(s)), covered))

    hashes = lambda w: F.transform(places(w), lambda i: gram(w, i, F.xxhash64))
    many = F.size(words) >= WINDOW
    return F.when(many, let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact(words)))).otherwise(F.lit(0).cast("long"))


def _measured(text: Column) -> Column:
    """All counts of a text as one struct; a null text has none of anything."""

    def of(t: Column) -> Column:
        bare = F.btrim(t, F.lit(WHITE))
        words = let(bare, lambda b: F.when(F.length(b) == 0, F.array().cast("array<string>")).otherwise(F.split(b, WHITE_RUN)))
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
        lines_of = lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))
        words_of = lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )
        return F.struct(let(words, words_of).alias("w"), let(lines, lines_of).alias("l"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))

    return let(F.coalesce(text, F.lit("")), of)


def measures(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with a struct of all counts under a name; the work of a text happens once, in this projection."""
    return docs.withColumn(name, _measured(F.col(text_col)))


def verdict(m: Column, rules=RULES) -> dict[str, Column]:
    """For each rule of the table, the condition under which a text passes."""
    words = F.greatest(m.w.n_words, F.lit(1))
    metric = {
        "n_words": m.w.n_words,
        "repeat_percent": F.lit(100) * m.w.n_repeat_words / words,
        "mean_word_chars": m.w.word_chars / words,
        "symbols_per_word": m.n_symbols / words,
        "stop_word_ratio": m.w.n_stop_words / words,
        "dup_line_ratio": m.l.n_dup_lines / F.greatest(m.l.n_lines, F.lit(1)),
    }
    # the share of repeated words is compared as whole numbers, so that 20 % exactly passes
    exact = {"repeat_percent": lambda high: F.lit(100) * m.w.n_repeat_words <= F.lit(high) * m.w.n_words}
    out = {}
    for name, what, low, high, least in rules:
        tests = [] if low is None else [metric[what] >= F.lit(low)]
        if high is not None:
            tests.append(exact[what](high) if what in exact else metric[what] <= F.lit(high))
        out[name] = reduce(lambda a, b: a & b, tests) | (m.w.n_words < F.lit(least))
    return out


def quality(docs: DataFrame, text_col: str = "text", rules=RULES, base=BASE) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed and kept.

    A null, empty or blank text has no words and fails the length rule. Columns of these names in docs are replaced;
    all others pass through. Rows are judged one by one: ties and repeated rows get the same verdict each.
    """
    name = unused(docs, "_measures")
    m = F.col(name)
    tests = verdict(m, rules)
    failed = ~reduce(lambda a, b: a & b, [tests[k] for k in base])
    return (
        measures(docs, name, text_col)
        .withColumns({"n_words": m.w.n_words, "word_chars": m.w.word_chars, "n_symbols": m.n_symbols, "n_dup_lines": m.l.n_dup_lines, "n_repeat_words": m.w.n_repeat_words, "n_stop_words": m.w.n_stop_words, "base_failed": failed, "kept": reduce(lambda a, b: a & b, tests.values())})
        .drop(name)
    )


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text passes every rule, with the columns of docs, which may have any names.

    Null, empty and blank texts go; rows that repeat stay or go together; an empty table stays empty.
    """
    name = unused(docs, "_measures")
    passes = reduce(lambda a, b: a & b, verdict(F.col(name)).values())
    return measures(docs, name, text_col).filter(passes).drop(name)
