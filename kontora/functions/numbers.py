"""Integer arithmetic in fixed scales, as column expressions.

Money is in cents, quantities in milli, unit prices in micro, rates in basis points. Products go through decimal(38,0), so
that nothing overflows on the way; results are bigint. A null operand gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = 10_000
WIDE = "decimal(38,0)"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def wide(x) -> Column:
    return _col(x).cast(WIDE)


def trunc_div(a, b) -> Column:
    """a / b toward zero; null where b is 0."""
    a, b = wide(a), wide(b)
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast(WIDE)))


def round_div(a, b) -> Column:
    """a / b, halves away from zero, for any signs; null where b is 0."""
    a, b = wide(a), wide(b)
    flip = F.when(b < 0, F.lit(-1)).otherwise(F.lit(1)).cast(WIDE)
    n, d = a * flip, b * flip
    up = trunc_div(F.abs(n) + trunc_div(d, 2), d)
    return F.when(n < 0, -up).otherwise(up).cast("bigint")


def line_net(quantity, unit_price, price_base) -> Column:
    """Net of a line in cents; a price base of 0 or less counts as one unit."""
    base = F.when(_col(price_base) > 0, _col(price_base)).otherwise(F.lit(1000))
    return round_div(wide(quantity) * wide(unit_price), wide(base) * F.lit(FULL).cast(WIDE))


def markup(revenue, cost) -> Column:
    """What revenue brings over cost, in basis points; 0 without cost."""
    return F.when(_col(cost) > 0, trunc_div((wide(revenue) - wide(cost)) * F.lit(FULL).cast(WIDE), cost)).otherwise(F.lit(0)).cast("bigint")


def unit_net(gross, vat) -> Column:
    """Net price of a portion from its gross price; 0 without a price."""
    return F.when(_col(gross) > 0, round_div(wide(gross) * F.lit(FULL).cast(WIDE), wide(vat) + F.lit(FULL).cast(WIDE))).otherwise(F.lit(0)).cast("bigint")


def parse_scaled(text, digits: int, rounding: bool = False, strict: bool = False) -> Column:
    """Decimal text times 10^digits as bigint.

    Surplus digits that are not zero are refused unless rounding (half away from zero). Refused text is null, or an
    error where strict. Null and blank text is null.
    """
    t = F.trim(_col(text))
    ok = t.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$|^[+-]?\.[0-9]+$")
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    bare = F.regexp_replace(t, "^[+-]", "")
    whole = F.split_part(bare, F.lit("."), F.lit(1))
    part = F.split_part(bare, F.lit("."), F.lit(2))
    kept = F.rpad(F.substring(part, 1, digits), digits, "0") if digits else F.lit("")
    rest = F.substring(part, digits + 1, 100)
    value = F.concat(F.lit("0"), whole, kept).cast(WIDE)
    if rounding:
        value = value + F.when(F.substring(rest, 1, 1) >= "5", F.lit(1)).otherwise(F.lit(0))
    else:
        ok = ok & rest.rlike("^0*$")
    bad = F.raise_error(F.concat(F.lit("not a number in this scale: "), t)).cast("bigint") if strict else F.lit(None).cast("bigint")
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("bigint")).when(ok, (sign * value).cast("bigint")).otherwise(bad)


def gcd(a, b) -> Column:
    """Greatest common divisor of two non-negative bigint values (Euclid, as many steps as 64-bit values can need)."""
    start = F.struct(_col(a).cast("bigint").alias("a"), _col(b).cast("bigint").alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), F.when(s.b == 0, F.lit(0)).otherwise(s.a % s.b).cast("bigint").alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s.a)


def gcd_wide(a: Column, b: Column) -> Column:
    """Greatest common divisor of two decimals without fractions; 128-bit Euclid by remainders."""
    start = F.struct(F.abs(a).cast(WIDE).alias("a"), F.abs(b).cast(WIDE).alias("b"))
    zero = F.lit(0).cast(WIDE)
    rest = lambda s: (s.a - trunc_div(s.a, s.b).cast(WIDE) * s.b).cast(WIDE)
    step = lambda s, _: F.when(s.b == zero, s).otherwise(F.struct(s.b.alias("a"), rest(s).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s.a)


def reduced(num: Column, den: Column) -> tuple[Column, Column]:
    """A fraction in lowest terms, on decimals."""
    g = F.greatest(gcd_wide(num, den), F.lit(1).cast(WIDE))
    return trunc_div(num, g).cast(WIDE), trunc_div(den, g).cast(WIDE)


def fraction_sum(parts: Column) -> Column:
    """Struct (num, den) of the sum of an array of such structs, over their least common denominator."""
    one = F.lit(1).cast(WIDE)
    dens = F.array_distinct(F.transform(parts, lambda x: x.den))
    lcm = F.aggregate(dens, one, lambda a, d: (trunc_div(a, gcd_wide(a, d)).cast(WIDE) * d).cast(WIDE))
    total = lambda den: F.aggregate(parts, F.lit(0).cast(WIDE), lambda a, x: (a + x.num * trunc_div(den, x.den).cast(WIDE)).cast(WIDE))
    return F.element_at(F.transform(F.array(lcm), lambda den: F.struct(total(den).alias("num"), den.alias("den"))), 1)


def rounded_fraction(num: Column, den: Column) -> Column:
    """A fraction as bigint, halves up; what is above nothing is 1 at least."""
    near = trunc_div(wide(num) + trunc_div(den, 2).cast(WIDE), den)
    return F.when(num > 0, F.greatest(near, F.lit(1).cast(WIDE))).otherwise(F.lit(0)).cast("bigint")
