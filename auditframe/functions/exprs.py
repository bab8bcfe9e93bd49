r"""Cell functions as Spark columns.

Cells are strings. White space, digits and letters mean what they mean in Unicode, so patterns carry ``(?U)``;
numbers follow one grammar (sign, digits with single underscores between, point, exponent) and must be finite.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ``[\s\x1c-\x1f]`` is in Unicode.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
ISO = r"^\d{4}-\d{2}-\d{2}$"
SLASHED = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
DATETIME = r"(?i)^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
SCIENTIFIC = r"^-?\d(\.\d+)?[eE]\+?\d+$"
PADDED = r"(?U)^\s|\s$|\s{2,}|\t"
INVISIBLE = "[​‌‍‎‏ ﻿⁠\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
DECORATED = r"^[$€£]?\s*-?[\d,]*\.?\d+\s*[kKmMbB%]?$"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}\b"
PHONE = r"\b\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"
ADDRESS = r"\b\d{1,6}\s+(?:[A-Z][a-z]+\s+){1,3}(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Ct|Court|Way|Pl|Place)\b\.?"
TITLED = r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"
#: The characters of windows-1252 at bytes 80 to 9F that have one, and those bytes as Latin-1 characters.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def strip(c: Column) -> Column:
    """Without white space at the ends; ``trim`` takes blanks alone."""
    return F.btrim(c, F.lit(SPACE))


def number(c: Column) -> Column:
    """The finite number a cell says, or null."""
    v = strip(c)
    parsed = F.when(v.rlike(NUMBER), F.replace(v, F.lit("_"), F.lit(""))).try_cast("double")
    return F.when(F.abs(parsed) < float("inf"), parsed)


def fold(c: Column) -> Column:
    """For comparison without case."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def is_iso(v: Column) -> Column:
    return v.rlike(ISO)


def is_date_like(v: Column) -> Column:
    return v.rlike(ISO) | v.rlike(SLASHED)


def is_ambiguous_date(v: Column) -> Column:
    """Slash or dash date whose first two numbers could both be months."""
    part = lambda i: F.regexp_extract(v, SLASHED, i).try_cast("int")
    return v.rlike(SLASHED) & (part(1) <= 12) & (part(2) <= 12)


def real_date(v: Column) -> Column:
    """A date of the calendar from ISO text, or null."""
    return F.when(is_iso(v), F.try_to_date(v, "yyyy-MM-dd"))


def mojibake_repair(v: Column) -> Column:
    """What a text said before UTF-8 bytes were read as windows-1252, or null if they weren't."""
    able = v.rlike("[^\\x00-\\x7f]") & ~v.rlike(f"[^\\x00-\\x7f\\u00a0-\\u00ff{CP1252}]")
    raw = F.encode(F.translate(v, CP1252, CP1252_BYTES), "ISO-8859-1")
    whole = F.is_valid_utf8(raw.cast("string"))
    fixed = F.when(able & whole, F.decode(raw, "UTF-8"))
    return F.when(fixed != v, fixed)


def value_shape(v: Column) -> Column:
    """Runs of digits, letters and white space as D, L and S, other characters once a run; ``#NUM#`` for plain numbers."""
    # control characters hold the classes apart from letters of the text while it is rewritten
    s = F.regexp_replace(v, r"(?U)\p{Nd}+", "\x01")
    s = F.regexp_replace(s, r"\p{L}+", "\x02")
    s = F.regexp_replace(s, r"(?U)\s+", "\x03")
    s = F.regexp_replace(s, r"([^\x01-\x03])\1+", "$1")
    return F.when(v.rlike(r"(?U)^-?\d+(\.\d+)?$"), "#NUM#").otherwise(F.translate(s, "\x01\x02\x03", "DLS"))


def excel_serial(v: Column) -> Column:
    """ISO date of a whole number from 20000 to 60000, counted from 1899-12-30, or null."""
    n = number(v)
    ok = (n == F.floor(n)) & n.between(20_000, 60_000)
    return F.when(ok, F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.when(ok, n).cast("int")), "yyyy-MM-dd"))


def completed_years(born: Column, on: Column) -> Column:
    before = (F.month(on) < F.month(born)) | ((F.month(on) == F.month(born)) & (F.dayofmonth(on) < F.dayofmonth(born)))
    return F.year(on) - F.year(born) - before.cast("int")


def is_year(v: Column, this_year: int) -> Column:
    return v.rlike(r"^\d{4}$") & v.try_cast("int").between(1900, this_year)


# Repairs. Each leaves a cell that it isn't about as it is.


def fix_whitespace(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s{2,}|\t", " ")


def fix_invisible(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, " ", " "), INVISIBLE, "")


def fix_mojibake(c: Column) -> Column:
    return F.coalesce(mojibake_repair(c), c)


def fix_numeric_format(c: Column) -> Column:
    """``$1,200`` and ``50k`` as plain decimals; percentages and what is a number already stay."""
    v = strip(c)
    scale = F.lower(F.regexp_extract(v, r"([kKmMbB])$", 1))
    digits = F.regexp_replace(F.regexp_replace(v, r"[$€£,\s]", ""), r"[kKmMbB]$", "")
    times = F.when(scale == "k", 1_000).when(scale == "m", 1_000_000).when(scale == "b", 1_000_000_000).otherwise(1).cast("decimal(10,0)")
    said = (digits.try_cast("decimal(27,9)") * times).cast("string")
    plain = F.regexp_replace(F.when(F.contains(said, F.lit(".")), F.regexp_replace(said, r"\.?0+$", "")).otherwise(said), r"^-0$", "0")
    use = number(v).isNull() & v.rlike(DECORATED) & ~v.endswith("%")
    return F.when(use, F.coalesce(plain, c)).otherwise(c)


def fix_leading_zeros(c: Column, width: int) -> Column:
    v = strip(c)
    return F.when(v.rlike(r"^\d+$") & (F.length(v) < width), F.lpad(v, width, "0")).otherwise(c)


def fix_excel_date(c: Column) -> Column:
    return F.coalesce(excel_serial(c), c)


#: Parts of strptime formats and what they are in Spark's.
STRPTIME = {"%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%b": "MMM", "%B": "MMMM", "%H": "H", "%M": "m", "%S": "s"}


def spark_format(strptime: str) -> str:
    return reduce(lambda s, kv: s.replace(*kv), STRPTIME.items(), strptime)


def fix_date_iso(c: Column, source_format: str) -> Column:
    """A date in the declared format, or the same with slashes for dashes, as ISO."""
    v = strip(c)
    forms = dict.fromkeys([spark_format(source_format), spark_format(source_format.replace("/", "-"))])
    return F.coalesce(*(F.date_format(F.try_to_date(v, f), "yyyy-MM-dd") for f in forms), c)


def plain_text(x: Column) -> Column:
    """A number as it would be written: whole ones without a point."""
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(x.cast("decimal(38,6)").cast("string"), r"\.?0+$", ""))


def fix_units(c: Column, boundary: float, minority_side: str, factor: float, least: float | None = None, most: float | None = None) -> Column:
    """Values of the minority cluster in the majority's unit, to two places."""
    x = number(c)
    mine = x < boundary if minority_side == "low" else x >= boundary
    if least is not None:
        mine = mine & (x >= least)
    if most is not None:
        mine = mine & (x <= most)
    to = F.bround(x * factor if minority_side == "low" else x / factor, 2)
    return F.when(mine, plain_text(to)).otherwise(c)


def fix_outliers(c: Column, action: str, lower: float, upper: float, keep: list[str] = ()) -> Column:
    """Cells outside the limits capped or blanked; ``keep`` are codes that stay."""
    x, v = number(c), strip(c)
    out = F.when(x < lower, F.lit(lower)).when(x > upper, F.lit(upper))
    new = plain_text(out) if action == "cap" else F.lit("")
    return F.when(out.isNotNull() & ~v.isin(list(keep)), new).otherwise(c)


def fix_pii_mask(c: Column) -> Column:
    c = F.regexp_replace(c, SSN, "[SSN]")
    return F.regexp_replace(F.regexp_replace(c, EMAIL, "[email]"), PHONE, "[phone]")
