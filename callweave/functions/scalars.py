"""Column functions: addresses, blocks, scales and classes of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = "^(0x)?[0-9a-fA-F]{40}$"
#: Upper bounds of the activity classes.
ACTIVITY = ((0, "none"), (1, "single"), (9, "minimal"), (99, "moderate"), (999, "high"))


def normalize_address(c: Column, strict: bool = False) -> Column:
    """Lower case with ``0x``; what isn't a 20-byte hex address is null, or an error if ``strict``."""
    low = F.lower(F.trim(c))
    good = F.when(low.startswith("0x"), low).otherwise(F.concat(F.lit("0x"), low))
    bad = F.raise_error(F.concat(F.lit("not an address: "), F.coalesce(c, F.lit("null")))) if strict else F.lit(None)
    return F.when(F.trim(c).rlike(ADDRESS), good).otherwise(bad.cast("string"))


def parse_block(c: Column, strict: bool = False) -> Column:
    """A block number from decimal digits or ``0x`` hex digits; else null, or an error if ``strict``."""
    t = F.lower(F.trim(c))
    bad = F.raise_error(F.concat(F.lit("not a block: "), F.coalesce(c, F.lit("null")))) if strict else F.lit(None)
    return F.when(t.rlike("^0x[0-9a-f]+$"), F.conv(F.substr(t, F.lit(3)), 16, 10).cast("long")).when(t.rlike("^[0-9]+$"), t.cast("long")).otherwise(bad.cast("long"))


def short_address(c: Column) -> Column:
    """``0x12...cdef`` for strings that start with ``0x``."""
    return F.when(c.startswith("0x"), F.concat(F.substring(c, 1, 4), F.lit("..."), F.right(c, F.lit(4)))).otherwise(c)


def log_weight(c: Column) -> Column:
    return F.log1p(c)


def hybrid_scale(y: Column) -> Column:
    """Linear up to 5, then 5 plus the decimal logarithm of what is over, plus 1."""
    return F.when(y <= 5, y.cast("double")).otherwise(5 + F.log10(y - 4))


def hybrid_scale_inverse(t: Column) -> Column:
    return F.when(t <= 5, t.cast("double")).otherwise(F.pow(F.lit(10.0), t - 5) + 4)


def abbreviate_number(n: Column) -> Column:
    out = n.cast("string")
    for size, letter in ((1e3, "k"), (1e6, "m"), (1e9, "b")):
        out = F.when(n >= size, F.concat(F.format_string("%.2f", n / size), F.lit(letter))).otherwise(out)
    return out


def activity_level(n: Column) -> Column:
    out = F.lit("significant")
    for most, name in reversed(ACTIVITY):
        out = F.when(n <= most, name).otherwise(out)
    return out


def year_of(ts: Column) -> Column:
    return F.year(ts)


def share(part: Column, whole: Column) -> Column:
    """Part of whole in per cent to six places; null for nothing."""
    return F.round(F.when(whole != 0, 100.0 * part / whole), 6)
