"""Secret scans: fixed patterns, and a battery of randomness tests over long unbroken strings.

Every string of sixteen or more characters out of A-Z a-z 0-9 + / _ - is put down to the smallest alphabet that holds
it (digits, hexadecimal, letters, base 32, base 36, base 62, base 64); a string that fits none, as of a path or URL, is
split at '/' and, where a part still fits none, at '+'. Three tests of the hypothesis that its characters are drawn
evenly and independently give p-values: chi-squared against an even spread over the alphabet, the number of runs above
and below the alphabet's middle, and the lag-one serial correlation. The chance that the smallest of three such
values is as small as theirs is the string's p-value. Small ones are structured text; the rest looks random and is reported,
if its length times bits per character gives the tests power.

Where the line lies is decided inside classes of length, from counts of p-values over the whole corpus, by two rules. The
discoveries are the strings reported: p-values of random strings are spread evenly, so that the ones above FLAT tell how
many random strings there are and how many of them lie above any line; what else lies there is structured. The line is
drawn where that is LEVEL of the strings reported at most, but for a square root of their number, which is what chance
moves the estimate by. And the Benjamini-Hochberg rule puts down as structured what is so at the same level, which costs
about one in twenty random strings at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored
from .spans import count_of, find_spans, named

KINDS = ["assign", "access", "hex", "random"]
#: The three base patterns. The last two hold their least length; that gives the same matches, as both
#: take whole runs of their characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LONG_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
#: Parts of a run that fits no alphabet: whole parts between '/' without '-' and '_', else what '/' and '+' leave.
PART = r"(?<![^/])[A-Za-z0-9+]{16,}+(?![^/])|[A-Za-z0-9_-]{16,}"

#: Name, characters, bits per character of each alphabet, smallest first.
ALPHABETS = (
    ("digits", "0123456789", 3.32),
    ("hex", "0123456789abcdef", 4.0),
    ("HEX", "0123456789ABCDEF", 4.0),
    ("lower", "abcdefghijklmnopqrstuvwxyz", 4.7),
    ("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4.7),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 5.0),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", 5.17),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 5.17),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 5.7),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 5.95),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 6.0),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", 6.0),
)
MIN_BITS = 96.0
#: Keys of sixteen characters are usual in these; words cannot be spelled in the first two.
SHORT_BITS = {"hex": 64.0, "HEX": 64.0, "base62": 95.0}
LEVEL = 0.05
#: p-values above this are those of random strings.
FLAT = 0.25
BINS = 400
CLASSES = (24, 32, 48, 64, 128)


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution (a rational approximation, error below 1e-7)."""
    a = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * a)
    poly = ((((F.lit(1.061405429) * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    half = F.lit(0.5) * poly * F.exp(-a * a)
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def alphabet_of(m: Column) -> Column:
    """Index of the smallest alphabet that holds all characters of m; else null.

    Alphabets of letters and digits need both in m; those with signs need letters.
    """
    lettered = m.rlike("[A-Za-z]")
    mixed = m.rlike("[0-9]") & lettered
    out = F.lit(None).cast("int")
    for i, (name, chars, _) in reversed(list(enumerate(ALPHABETS))):
        safe = "".join("\\" + c if c in "+/-" else c for c in chars)
        fits = m.rlike(f"^[{safe}]+$")
        needs = fits if name in ("digits", "lower", "UPPER", "letters") else fits & (lettered if name.startswith("base64") else mixed)
        out = F.when(needs, F.lit(i)).otherwise(out)
    return out


def battery(m: Column) -> Column:
    """Struct (alphabet, p) of a string: its inferred alphabet and the p-value of the three tests together."""
    chars_of = F.array(*[F.lit(c) for _, c, _ in ALPHABETS])

    def tests(a: Column) -> Column:
        abc = F.get(chars_of, a)
        k, n = F.length(abc).cast("double"), F.length(m).cast("double")
        codes = F.transform(F.filter(F.split(m, ""), lambda c: c != ""), lambda c: F.position(c, abc) - 1)

        def of(v: Column) -> Column:
            add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda x, y: x + y)
            squares = add(F.transform(F.array_distinct(v), lambda c: F.pow(F.size(F.filter(v, lambda x: x == c)).cast("double"), F.lit(2.0))))
            chi, df = k / n * squares - n, k - 1
            z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df))
            p_chi = _tail(z_chi)
            high = F.size(F.filter(v, lambda x: x.cast("double") >= k / 2)).cast("double")
            low = n - high
            runs = F.lit(1.0) + add(F.transform(v, lambda x, i: F.when((i > 0) & ((x.cast("double") >= k / 2) != (F.get(v, i - 1).cast("double") >= k / 2)), F.lit(1.0)).otherwise(F.lit(0.0))))
            mean = 2 * high * low / n + 1
            var = (mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0))
            p_runs = F.when(var > 0, 2 * _tail(F.abs((runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))).otherwise(F.lit(0.0))
            mu = add(F.transform(v, lambda x: x.cast("double"))) / n

            def serial(u: Column) -> Column:
                spread = add(F.transform(v, lambda x: F.pow(x.cast("double") - u, F.lit(2.0))))
                lag = add(F.transform(v, lambda x, i: F.when(i > 0, (x.cast("double") - u) * (F.get(v, i - 1).cast("double") - u)).otherwise(F.lit(0.0))))
                return F.when(spread > 0, 2 * _tail(F.abs(lag / spread * F.sqrt(n)))).otherwise(F.lit(0.0))

            p_serial = let(mu, serial)
            return 1 - F.pow(1 - F.least(F.lit(1.0), p_chi, p_runs, p_serial), F.lit(3.0))

        return F.struct(a.alias("a"), let(codes, of).alias("p"))

    return let(alphabet_of(m), lambda a: F.when(a.isNotNull(), tests(a)))


def strings(text: Column) -> Column:
    """Long strings as spans: whole runs that fit an alphabet, and the parts of those that fit none."""

    def of(x: Column) -> Column:
        parts = F.transform(find_spans(x.m, PART, 3), lambda y: F.struct((x.s + y.s).alias("s"), y.k.alias("k"), (x.s + y.e).alias("e"), y.m.alias("m")))
        return F.when(alphabet_of(x.m).isNotNull(), F.array(x)).otherwise(parts)

    return F.flatten(F.transform(find_spans(text, LONG_RUN, 3), of))


def length_class(n: Column) -> Column:
    out = F.lit(len(CLASSES))
    for i, top in reversed(list(enumerate(CLASSES))):
        out = F.when(n < top, F.lit(i)).otherwise(out)
    return out


def p_bin(p: Column) -> Column:
    """Bins of p on a log scale, bin 0 the smallest p."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(BINS - 1 + F.lit(BINS / 40.0) * F.log(F.greatest(p, F.lit(1e-300)))))).cast("int")


def rejection_limits(scored: DataFrame, level: float = LEVEL) -> DataFrame:
    """(cls, last): the last bin of each length class that is not reported, from binned p-values over all strings.

    A bin counts with its upper end, so that the Benjamini-Hochberg rule is never looser than with exact p-values.
    """
    c = F.col
    bins = scored.select(F.explode("cands").alias("c")).select(length_class(F.length("c.m")).alias("cls"), p_bin(c("c.p")).alias("bin")).groupBy("cls", "bin").count()
    within = Window.partitionBy("cls")  # BINS rows at most
    upto = within.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    upper = F.least(F.lit(1.0), F.exp((c("bin") + 2 - BINS) / F.lit(BINS / 40.0)))
    ranked = bins.withColumns({"rank": F.sum("count").over(upto), "all": F.sum("count").over(within), "upper": upper})
    random = F.sum(F.when(c("upper") > FLAT, c("count")).otherwise(0)).over(within) / (1 - FLAT)
    structured = lambda n, share: n - F.least(n, c("random") * share)
    few = lambda n, share: structured(n, share) <= F.lit(level) * n + F.sqrt(n)
    tested = ranked.withColumn("random", random).withColumn("above", c("all") - c("rank"))
    tested = tested.withColumns({"none": few(c("all"), F.lit(1.0)), "here": few(c("above"), 1 - c("upper")), "put_down": c("upper") * c("all") <= F.lit(level) * c("rank")})
    lines = tested.groupBy("cls").agg(F.bool_and("none").alias("none"), F.min(F.when(c("here"), c("bin"))).alias("cut"), F.max(F.when(c("put_down"), c("bin"))).alias("down"))
    cut = F.when(c("none"), -1).otherwise(F.coalesce("cut", F.lit(BINS)))
    return lines.select("cls", F.greatest(cut, F.coalesce("down", F.lit(-1))).alias("last"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, base (spans of the fixed patterns) and extra (spans that look random).

    Spans are arrays of structs s (start), k (kind), e (end), m (text), sorted by start, then kind. A null text counts
    as empty and has no spans. Extra spans that overlap a base one are left out. Rows are scanned one by one, so that
    repeated rows give the same spans each; other columns of docs are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    group2 = lambda m: F.length(F.regexp_extract(m, "^" + ASSIGN + "$", 1)) >= 6
    base = F.sort_array(F.concat(
        find_spans(text, ASSIGN, 0, group2, needs=text.rlike("[:=]")),
        find_spans(text, ACCESS, 1, needs=F.contains(text, F.lit("AKIA"))),
        find_spans(text, HEX, 2),
    ))
    cands = F.filter(F.transform(strings(text), lambda x: let(battery(x.m), lambda b: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), x.m.alias("m"), b.a.alias("a"), b.p.alias("p")))), lambda x: x.a.isNotNull())
    scored = stored(docs.select(F.col(id_col).alias("id"), base.alias("base"), cands.alias("cands")), "secret-candidates")
    # at most one number per length class
    limits = rejection_limits(scored).agg(F.map_from_entries(F.collect_list(F.struct("cls", "last"))).alias("limits"))
    bits = F.array(*[F.lit(b) for _, _, b in ALPHABETS])
    least = F.array(*[F.lit(SHORT_BITS.get(name, MIN_BITS)) for name, _, _ in ALPHABETS])
    odd = lambda x: (p_bin(x.p) > F.coalesce(F.try_element_at(F.col("limits"), length_class(F.length(x.m))), F.lit(-1))) & (F.length(x.m) * F.get(bits, x.a) >= F.get(least, x.a))
    extra = F.transform(F.filter("cands", lambda x: odd(x) & ~F.exists("base", lambda b: (b.s < x.e) & (x.s < b.e))), lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), x.m.alias("m")))
    return scored.join(F.broadcast(limits), how="left").select(F.col("id").alias(id_col), "base", extra.alias("extra"))


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col,
        *[count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(named(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        named(F.sort_array(F.concat("base", "extra")), KINDS).alias("spans"),
    )
