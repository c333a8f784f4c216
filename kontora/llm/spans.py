"""Spans of pattern matches as arrays of structs, with positions in code points, from built-in functions only.

Spark's functions give the matches of a pattern but not their places. The pieces between the matches (split by the
same pattern) and the matches alternate, so running sums of their lengths are the places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

BLOCK = 256
SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def running_sums(lengths: Column) -> Column:
    """Sum of all elements up to each one; work stays near linear, as whole blocks are summed once."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(BLOCK)).cast("int"))
        heads = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))))
        within = lambda i: total(F.slice(v, i - i % BLOCK + 1, i % BLOCK + 1))
        return let(heads, lambda h: F.transform(v, lambda x, i: F.get(h, F.floor(i / F.lit(BLOCK)).cast("int")) + within(i)))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(lengths, of))


def find_spans(text: Column, pattern: str, rank: int, keep=None, needs: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as structs (start, rank, end, match), those that fail keep dropped.

    needs: a cheap condition without which no match can exist.
    """

    def of(both: Column) -> Column:
        lengths = F.transform(both.m, lambda m, i: F.length(F.get(both.g, i)) + F.coalesce(F.length(F.get(both.m, i - 1)), F.lit(0)))
        starts = let(running_sums(lengths), lambda s: F.transform(both.m, lambda m, i: F.struct(F.get(s, i).alias("s"), F.lit(rank).alias("k"), (F.get(s, i) + F.length(m)).alias("e"), m.alias("m"))))
        return F.filter(starts, lambda x: keep(x.m)) if keep else starts

    none = F.array().cast(SPAN)
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("g")), of)))
    return found if needs is None else F.when(needs, found).otherwise(none)


def named(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))), ",")


def count_of(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda x: x.k == rank)).cast("long")
