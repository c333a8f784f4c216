"""Personal data: fixed patterns, and boosted trees over the spans that loose generators propose.

The generators propose far more than they should, overlapping each other. Gradient-boosted trees (Spark ML, trained here
on a bounded sample) score each proposal from its format and its surroundings. What they look for is what the fixed
patterns miss, so only proposals that overlap no base span teach them. Positive are base spans rewritten in place into
forms the patterns do not match (obfuscated, without '+', spaced anew), between the text that stood around them, and
proposals of the corpus that are e-mail addresses once (at) and (dot) are undone. Negative are the other proposals, and
addresses cut before their first dot. Numbers grouped or introduced like telephone numbers have no label: some are what is
looked for. All rows that did not train set one threshold per generator, from counts of binned scores: the lowest at
which precision against these labels reaches the target. The trees are turned into one column expression, so that every
proposal of the corpus is scored inside the scan, without a shuffle or a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .spans import count_of, find_spans, named

#: Kinds of the base patterns and of the proposals.
KINDS = ["email", "ip", "card", "phone", "handle", "number"]
#: The base patterns; starts are held to the start of a run (or the end of the match before), where alone they can match,
#: and loops do not give back. Both leave the matches as they are and keep the work linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
HANDLE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)*+"
NUMBER = r"(?<![0-9])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Words that stand near personal data.
HINTS = r"(?i)(?:tel|phone|call|fax|mobil|mail|contact|card|visa|iban|konto|account|ssn|passport|address|\bip\b)"
AROUND = 24
#: How signs are spelled out; a whole e-mail address; a date that begins a number; words right before a telephone number.
AT, DOT = r"\x20?(?:@|\(at\)|\[at\])\x20?", r"\x20?(?:\(dot\)|\[dot\])\x20?"
MAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"
DATE = r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})(?![0-9])"
CUE = r"(?i)(?:tel|phone|fax|mobile?|call|telefon|handy)[.:]{0,2}\x20?$"
#: Text kept on both sides of a rewritten span; more than AROUND, so that its proposals see their surroundings whole.
CONTEXT = 64
FEATURES = ["length", "digits", "letters", "separators", "at_signs", "dots", "plus", "parens", "luhn", "octets", "hinted", "glued", "groups", "mail", "date"]


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def undone(m: Column) -> Column:
    """A proposal with its spelled-out signs put back."""
    return F.regexp_replace(F.regexp_replace(m, AT, "@"), DOT, ".")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string holds."""

    def of(d: Column) -> Column:
        at = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        part = lambda i: F.when(i % 2 == 0, at(i)).otherwise((at(i) * 2) % 10 + F.floor(at(i) / F.lit(5)).cast("int"))
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), part), F.lit(0), lambda a, x: a + x) % 10 == 0

    return F.when(F.length(digits) > 0, let(digits, of)).otherwise(False)


def base_spans(text: Column) -> Column:
    """Accepted spans of the four base patterns, by kind, then start."""
    digit = text.rlike("[0-9]")
    length = lambda m, low, high: F.length(digits_of(m)).between(low, high)
    email = find_spans(text, EMAIL, 0, needs=F.contains(text, F.lit("@")))
    ip = find_spans(text, IP, 1, lambda m: m.rlike(OCTETS), needs=digit)
    card = find_spans(text, CARD, 2, lambda m: let(digits_of(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)), needs=digit)
    phone = find_spans(text, PHONE, 3, lambda m: length(m, 9, 15), needs=F.contains(text, F.lit("+")))
    return F.concat(email, ip, card, phone)


def proposals(text: Column) -> Column:
    """Spans of the loose generators with their features."""
    loose = F.concat(find_spans(text, HANDLE, 4, needs=text.rlike(r"@|\(at\)|\[at\]")), find_spans(text, NUMBER, 5, needs=text.rlike("[0-9]")))

    def measured(x: Column) -> Column:
        count = lambda p: F.regexp_count(x.m, F.lit(p)).cast("double")
        before = F.substring(text, F.greatest(F.lit(1), x.s - AROUND + 1), F.least(x.s, F.lit(AROUND)))
        after = F.substring(text, x.e + 1, F.lit(AROUND))
        flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
        d = digits_of(x.m)
        values = [
            F.length(x.m).cast("double"), F.length(d).cast("double"), count("[A-Za-z]"), count(r"[\x20()./-]"), count("@"), count(r"\."), count(r"\+"), count(r"\("),
            flag(luhn(d)), flag(x.m.rlike(OCTETS)), flag(before.rlike(HINTS) | after.rlike(HINTS)), flag(before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")), count("[0-9]+"),
            flag(undone(x.m).rlike(MAIL)), flag(x.m.rlike(DATE)),
        ]
        return F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), x.m.alias("m"), F.array(*values).alias("f"))

    return F.transform(loose, measured)


def free(x: Column, base: Column) -> Column:
    return ~F.exists(base, lambda b: (b.s < x.e) & (x.s < b.e))


def rewritten(b: Column, pick: Column) -> Column:
    """Forms of a base span that the base patterns do not match, as structs (m, label); `pick` chooses among them.

    An address gives a decoy as well: without a dotted host it is none.
    """
    user, host = F.substring_index(b.m, "@", 1), F.substring_index(b.m, "@", -1)
    digits, rest = digits_of(b.m), F.regexp_replace(b.m, r"^\+", "")
    spelled = [(" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", "."), (" @ ", ".")]
    mails = [F.concat(user, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in spelled]
    decoys = [F.concat(user, F.lit(at), F.substring_index(host, ".", 1)) for at, _ in spelled]
    ips = [F.replace(b.m, F.lit("."), F.lit(". ")), F.replace(b.m, F.lit("."), F.lit(" ."))]
    fours = lambda sign: F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1" + sign)
    cards = [fours("."), fours("/"), fours("  ")]
    phones = [rest, F.concat(F.lit("00"), rest), F.regexp_replace(rest, r"^[0-9]{1,2}[\x20.-]?", "0"), F.regexp_replace(rest, r"[\x20.-]", "/"), F.regexp_replace(rest, r"[\x20()-]+", ".")]
    one = lambda forms: F.get(F.array(*forms), F.pmod(pick, F.lit(len(forms))).cast("int"))
    as_form = lambda m, label: F.struct(m.alias("m"), F.lit(label).alias("label"))
    return F.when(b.k == 0, F.array(as_form(one(mails), 1.0), as_form(one(decoys), 0.0))).otherwise(F.array(as_form(F.when(b.k == 1, one(ips)).when(b.k == 2, one(cards)).otherwise(one(phones)), 1.0)))


def examples(text: Column, mark: Column) -> Column:
    """Labelled proposals of a text and of its rewritten base spans, as structs (k, f, label); mark varies the forms."""
    as_example = lambda x, label: F.struct(x.k.alias("k"), x.f.alias("f"), label.alias("label"))

    def of_form(b: Column, form: Column) -> Column:
        before, after = F.substring(text, F.greatest(F.lit(1), b.s - CONTEXT + 1), F.least(b.s, F.lit(CONTEXT))), F.substring(text, b.e + 1, F.lit(CONTEXT))
        low = F.length(before)
        high = low + F.length(form.m)

        def of(t: Column) -> Column:
            found = let(base_spans(t), lambda base: F.filter(proposals(t), lambda x: (x.s <= low) & (high <= x.e) & free(x, base)))
            return F.transform(found, lambda x: as_example(x, form.label))

        return let(F.concat(before, form.m, after), of)

    def own(base: Column) -> Column:
        n = lambda x: F.get(x.f, 1)
        marked = lambda x: (F.get(x.f, 13) == 1) & x.m.rlike(r"\(at\)|\[at\]")
        bare = lambda x: (F.get(x.f, 13) == 1) & ~x.m.rlike(r"\(at\)|\[at\]")
        cued = lambda x: F.substring(text, F.greatest(F.lit(1), x.s - AROUND + 1), F.least(x.s, F.lit(AROUND))).rlike(CUE)
        phone = lambda x: (x.k == 5) & n(x).between(9, 15) & (F.get(x.f, 14) == 0) & ((F.get(x.f, 12) > 1) | cued(x))
        card = lambda x: (x.k == 5) & n(x).between(13, 19) & (F.get(x.f, 8) == 1) & (F.get(x.f, 12) > 1)
        known = F.filter(proposals(text), lambda x: free(x, base) & ~bare(x) & ~phone(x) & ~card(x))
        return F.transform(known, lambda x: as_example(x, F.when(marked(x), F.lit(1.0)).otherwise(F.lit(0.0))))

    def planted(base: Column) -> Column:
        of_span = lambda b: F.flatten(F.transform(rewritten(b, F.xxhash64(mark, b.s)), lambda form: of_form(b, form)))
        return F.flatten(F.transform(base, of_span))

    return let(base_spans(text), lambda base: F.concat(own(base), planted(base)))


def _tree(node, features: Column) -> Column:
    """One regression tree of a fitted model as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    test = F.get(features, F.lit(int(split.featureIndex()))) <= F.lit(float(split.threshold()))
    return F.when(test, _tree(node.leftChild(), features)).otherwise(_tree(node.rightChild(), features))


class Trees:
    """Fitted trees and thresholds; score() is a column expression."""

    def __init__(self, model, thresholds: dict[int, float]):
        self.model, self.thresholds = model, thresholds

    def score(self, features: Column) -> Column:
        parts = [F.lit(float(w)) * _tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t, features) for w, t in zip(self.model.treeWeights, self.model.trees, strict=True)]
        margin = reduce(lambda a, b: a + b, parts)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    def selects(self, x: Column) -> Column:
        limit = F.lit(2.0)
        for k, t in self.thresholds.items():
            limit = F.when(x.k == k, F.lit(float(t))).otherwise(limit)
        return self.score(x.f) >= limit


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000, precision: float = 0.98, rounds: int = 8, depth: int = 3) -> Trees | None:
    """Fit on half of the `sample` rows of least id hash (the bound of the sample); None if they hold but one class.

    Thresholds come from all rows but those that trained; what is collected are counts of bins.
    """
    mark = F.xxhash64(F.col(id_col))
    chosen = docs.select(mark.alias("h")).orderBy("h").limit(sample).agg(F.max("h").alias("top")).first()["top"]
    if chosen is None:
        return None
    rows = docs.select(mark.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    trains = (F.col("h") <= chosen) & (F.pmod("h", F.lit(2)) == 0)
    of_rows = lambda some: some.select(F.explode(examples(F.col("t"), F.col("h"))).alias("x")).select("x.k", "x.f", "x.label")
    x = of_rows(rows.filter(trains)).select("label", *[F.get("f", i).alias(n) for i, n in enumerate(FEATURES)]).persist()
    try:
        if x.agg(F.count_distinct("label")).first()[0] < 2:
            return None
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, seed=1).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x))
    finally:
        x.unpersist()
    trees = Trees(model, {})
    held = of_rows(rows.filter(~trains)).select("k", "label", F.floor(trees.score(F.col("f")) * 50).alias("bin")).groupBy("k", "bin").agg(F.sum("label").alias("hit"), F.count("*").alias("n"))
    bins: dict[int, list] = {}
    for r in held.collect():  # at most 51 bins for each of two generators
        bins.setdefault(r["k"], []).append((r["bin"], r["hit"], r["n"]))
    for k, rows_of in bins.items():
        hit = n = 0
        for b, h, c in sorted(rows_of, reverse=True):
            hit, n = hit + h, n + c
            if hit / n >= precision:
                trees.thresholds[k] = b / 50
    return trees


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """One row per row of docs: id, base (spans of the fixed patterns) and extra (proposals the trees select).

    Spans are arrays of structs s, k, e, m, by kind, then start. A null text counts as empty and has no spans. Proposals
    that overlap a base span are left out, as that span stays. Rows are scanned one by one; repeated rows give the same
    spans each and other columns are ignored.
    """
    trees = trees or fit(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")

    def of(base: Column) -> Column:
        if trees is None:
            return F.struct(base.alias("base"), empty.alias("extra"))
        extra = F.filter(proposals(text), lambda x: free(x, base) & trees.selects(x))
        return F.struct(base.alias("base"), F.transform(extra, lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), x.m.alias("m"))).alias("extra"))

    return docs.select(F.col(id_col), let(base_spans(text), of).alias("_p")).select(id_col, "_p.base", "_p.extra")


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = named(F.col("base"), KINDS)
    return found.select(
        id_col,
        *[count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        named(F.concat("base", "extra"), KINDS).alias("spans"),
    )
