"""Numbers, dates and units as a scan prints them, as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import UNITS, pack_size, unit

#: Shapes of a number printed as it should be, of any printed number, of a cell that holds one, of decimals set apart, and currency signs.
PLAIN = r"^(?:[0-9]{1,12}(?:,[0-9]{1,6})?|[0-9]{1,3}(?:\.[0-9]{3}){1,3},[0-9]{1,6})\z"
NUMBER = r"-?\d{1,3}(?:[.\s;:]\d{3})+(?!\d)(?:[.,;:]\d+)?|-?\d+(?:[.,;:]\d+)?"
CELL = r"^[-+]?(?:[€$]|EUR|Eur)?\s*\d[\d.,\s]*\s*(?:[%€]|EUR|Eur)?-?$"
APART = r"(?<=\d[,;:])\s+(?=\d{2,3}(?!\d))"
CURRENCY = r"[€$%]|EUR|Eur"
SPECKS = ".·•,;: "
#: Letters that stand for digits, in cells, in dates and in units.
CELL_LETTERS = ("øØOoDlIi|!SsBZzGbgqA", "00000111115582266994")
DATE_LETTERS = ("OoIl|", "00111")
UNIT_LETTERS = ("1i|)05826e", "llllosbzgf")
#: The months, and the shapes of dates.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember".split()
DATES = ((r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)", (1, 2, 3)), (r"(?<!\d)(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})(?!\d)", (3, 2, 1)), (r"(?<!\d)(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{2})(?!\d)", (3, 2, 1)))
NAMED_DATE = r"(\d{1,2})\.?\s+(\p{L}+)\s+(\d{4})"
DATE_SHAPE = r"^[\dOoIl|]{1,2}[.\-/][\dOoIl|]{1,2}[.\-/][\dOoIl|]{2,4}$"
BROKEN_DATE = r"(?<=\d[.\-/])\s+(?=\d{1,4}(?:[.\-/]|(?!\w)))"
MAX_UNIT = 8


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_number(text: Column, scale: int) -> Column:
    """A printed German number times 10^scale; 0 where none is read.

    A comma, semicolon or colon is decimal, as is a last group of two digits; a minus may stand on either side. Numbers that
    are printed as they should be are read without looking for marks.
    """
    scaled = lambda number: F.round(number.try_cast("decimal(30,12)") * F.lit(10**scale), 0)
    bare = F.trim(F.regexp_replace(F.translate(F.trim(F.coalesce(text, F.lit(""))), " ", " "), CURRENCY, ""))
    bare = F.regexp_replace(F.ltrim(bare, F.lit(SPECKS)), APART, "")

    def of(t: Column) -> Column:
        negative = F.startswith(t, F.lit("-")) | F.endswith(t, F.lit("-"))
        hit = F.regexp_replace(F.regexp_extract(F.trim(F.btrim(t, F.lit("-"))), f"({NUMBER})", 1), "^-", "")

        def read(h: Column) -> Column:
            groups, marks = F.split(h, r"[.,;:\s]"), F.regexp_extract_all(h, F.lit(r"[.,;:\s]"), F.lit(0))
            last = F.element_at(groups, -1)
            decimal = (F.size(groups) > 1) & (F.element_at(marks, -1).isin(",", ";", ":") | (F.length(last) == 2) | ((F.size(groups) == 2) & (F.length(last) != 3)))
            whole = F.array_join(F.slice(groups, 1, F.size(groups) - 1), "")
            number = F.when(decimal, F.concat(whole, F.lit("."), last)).otherwise(F.array_join(groups, ""))
            value = scaled(number)
            return F.when(h == "", F.lit(0)).otherwise(F.coalesce(F.when(negative, -value).otherwise(value).try_cast("bigint"), F.lit(0))).cast("bigint")

        return _let(hit, read)

    plain = scaled(F.translate(text, ",.", ".")).try_cast("bigint")
    return F.when(text.rlike(PLAIN), F.coalesce(plain, F.lit(0).cast("bigint"))).otherwise(_let(bare, of))


def repair_digits(text: Column) -> Column:
    """Letters put back to digits, where the whole then reads as a number and did not before."""
    fixed = F.translate(text, *CELL_LETTERS)
    return F.when((text == "") | F.trim(text).rlike(CELL), text).when(F.trim(fixed).rlike(CELL), fixed).otherwise(text)


def _date(year: Column, month: Column, day: Column) -> Column:
    y = F.when(year < 100, year + 2000).otherwise(year)
    sound = month.between(1, 12) & (day >= 1) & y.between(1, 9999)
    first = F.make_date(F.when(sound, y), F.when(sound, month), F.lit(1))
    return F.when(sound & (day <= F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def _read_date(t: Column) -> Column:
    word = F.lower(F.regexp_extract(t, NAMED_DATE, 2))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), word).cast("int")
    number = lambda p, k: F.regexp_extract(t, p, k).try_cast("int")
    out = F.when(t.rlike(NAMED_DATE) & (month > 0), _date(number(NAMED_DATE, 3), month, number(NAMED_DATE, 1)))
    for pattern, (y, m, d) in reversed(DATES):
        out = F.when(t.rlike(pattern), _date(number(pattern, y), number(pattern, m), number(pattern, d))).otherwise(out)
    return out


def parse_date(text: Column) -> Column:
    """The date in a cell: ISO, day first, two-digit years, month names; else with confused characters put back.

    A month is put back where exactly one is one letter away.
    """
    t = F.regexp_replace(F.trim(text), BROKEN_DATE, "")
    months = F.array(*[F.lit(m) for m in MONTHS])

    def mended(token: Column) -> Column:
        bare = F.lower(F.btrim(token, F.lit(".,;:")))
        differ = lambda m: F.size(F.filter(F.sequence(F.lit(1), F.length(m)), lambda i: F.substring(m, i, F.lit(1)) != F.substring(bare, i, F.lit(1))))
        near = F.filter(months, lambda m: (F.length(m) == F.length(bare)) & (F.length(bare) > 2) & (differ(m) == 1))
        word = _let(near, lambda n: F.when(F.size(n) == 1, F.get(n, F.lit(0))).otherwise(token))
        return F.when(token.rlike(DATE_SHAPE), F.translate(token, *DATE_LETTERS)).otherwise(word)

    again = F.array_join(F.transform(F.filter(F.split(t, r"\s+"), lambda x: x != ""), mended), " ")
    return F.coalesce(_read_date(t), _read_date(again))


def _folded(s: Column) -> Column:
    return F.translate(F.lower(s), *UNIT_LETTERS)


def _folded_aliases() -> dict[str, str]:
    """Folded printed forms that stand for one unit only."""
    table = str.maketrans(*UNIT_LETTERS)
    found: dict[str, set[str]] = {}
    for u in UNITS:
        for a in u[5]:
            found.setdefault(a.lower().translate(table), set()).add(u[0])
    return {k: min(v) for k, v in found.items() if len(v) == 1}


def unit_code(text: Column) -> Column:
    """Code of a printed unit; else of what it may have been read from; else the text itself if it is short and one word."""
    t = F.trim(text)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    once = F.when((F.size(words) > 1) & (F.size(F.array_distinct(words)) == 1), F.get(words, F.lit(0))).otherwise(t)
    bare = F.btrim(once, F.lit("."))
    tail = F.ltrim(bare, F.lit("0123456789.,;:-/ "))
    folded = F.try_element_at(F.from_json(F.lit(json.dumps(_folded_aliases())), "map<string,string>"), _folded(tail))
    known = F.coalesce(unit(bare)["code"], F.when(F.length(tail) >= 2, folded))
    return F.when(known.isNotNull(), known).when(once.rlike(r"[ \t]") | (F.length(once) > MAX_UNIT), "").otherwise(once)


def pack_unit(name: Column) -> Column:
    """'10 1' as '10 l' and '120 8' as '120 g': a lone sign right after a number is a unit."""
    words = F.split(name, " ")
    letter = lambda w: F.when(w.isin("1", "I", "|"), "l").when(w == "8", "g")
    after = lambda i: (i > 0) & F.get(words, i - 1).rlike("[0-9]$")
    return F.array_join(F.transform(words, lambda w, i: F.when(after(i), F.coalesce(letter(w), w)).otherwise(w)), " ")


def recover_pack(text: Column, code: Column) -> Column:
    """'0,71' as '0,7 l', where the line bills a container, no size is read, and one is then."""
    glued = r"(\d{1,5}[.,]\d{1,3})[1Il](?![\p{L}\p{N}])"
    fixed = F.regexp_replace(text, glued, "$1 l")
    can = F.coalesce(unit(code).container, F.lit(False)) & pack_size(text).isNull() & pack_size(fixed).isNotNull()
    return F.when(can, fixed).otherwise(text)


def containers(name: Column, code: Column) -> Column:
    """Codes of the packages that a line names or is billed in."""
    words = F.concat(F.filter(F.split(name, r"[ ,;/()]"), lambda w: w != ""), F.array(F.coalesce(code, F.lit(""))))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(words, lambda w: _let(unit(w), lambda u: F.when(u.container, u.code))))))


def wording(observed: Column, name: Column) -> Column:
    """What a mapping is called: as it was seen, else its name."""
    return F.coalesce(F.when(F.trim(observed) != "", observed), name)


def parse_hundredths(text: Column) -> Column:
    """'1.234,5' or '4,60 €' in hundredths; null for a blank cell; an error for anything else but digits and marks."""
    bare = F.regexp_replace(text, r"[€%\s]", "")
    decimals = F.regexp_extract(bare, r"[.,](\d{1,2})$", 1)
    whole = F.regexp_replace(F.regexp_replace(bare, r"[.,]\d{1,2}$", ""), "[.,]", "")
    value = F.concat(whole, F.rpad(decimals, 2, "0")).try_cast("bigint")
    wrong = F.raise_error(F.concat(F.lit("not a number: "), text)).cast("bigint")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(None).cast("bigint")).when(bare.rlike(r"^[\d.,]+$") & value.isNotNull(), value).otherwise(wrong)


def optional_date(text: Column, *formats: str) -> Column:
    """The first format that reads the whole trimmed text as a date."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats])


def line_no(text: Column, index: Column) -> Column:
    """A positive printed number, else the place of the line."""
    n = F.trim(text).try_cast("bigint")
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$") & (n > 0), n).otherwise(index + 1)


def join_number_parts(had: Column, text: Column) -> Column:
    """Two parts of one printed number: '4.' and ',670' are '4,670'; parts without a mark stay words."""
    left = F.rtrim(had, F.lit(".,;: "))
    return F.when(text.rlike(r"^[.,;:]\d") & left.rlike(r"[0-9]$"), F.concat(left, text)).otherwise(F.concat_ws(" ", had, text))


def price_per_base(unit_price: Column, price_base: Column, factor: Column) -> Column:
    """Cents for 1000 base units, from a price in millionths and what one billed unit holds; null without either."""
    each = F.when(price_base > 0, F.floor(unit_price * 1000 / price_base)).otherwise(unit_price)
    return F.when((unit_price > 0) & (factor > 0), F.floor((F.floor(each * 1000 / factor) + 5000) / 10000)).cast("bigint")


def undouble_name(parts: Column) -> Column:
    """Printings of a name without those that another one contains, ignoring case, in order."""
    low = lambda x: F.lower(F.trim(x))
    longer = lambda x, i: F.exists(F.transform(parts, lambda y, j: (j != i) & F.contains(low(y), low(x)) & ((F.length(low(y)) > F.length(low(x))) | (j < i))), lambda b: b)
    kept = F.filter(parts, lambda x, i: ~longer(x, i))
    return F.array_join(kept, " ")


def label_conf(logits: Column) -> Column:
    """Struct (label, conf): the place of the largest score and its softmax share, to three decimals."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.struct((F.array_position(logits, top) - 1).cast("int").alias("label"), F.round(F.lit(1.0) / total, 3).alias("conf"))


def quantise(pixels: Column, extent: Column, bins: int = 1024) -> Column:
    """A coordinate as one of `bins` steps of the page, clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(pixels * bins / extent))).cast("int")
