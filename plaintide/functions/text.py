"""Text expressions: cleaning, clipping, parsing, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The white-space characters, as bodies of Java character classes
# (Java's own classes miss some of them).  Single characters below 256 are looked up
# in a bit set and the rare others sit behind one range test, so that scanning plain
# text stays cheap.
_NARROW = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
_WIDE = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
WS = _NARROW + " " + _WIDE
# Patterns of tags, links and word tokens.  (?d) makes "\n" the only
# line end, so a tag may span "\r" but not "\n".
TAG = r"(?d)<.*?>"
LINK = rf"http[^{WS}]+|www[^{WS}]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD = r"[\p{L}\p{N}_]+"
# The same white-space characters, one by one.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Runs of white space that are not already one blank.
LOOSE = rf"[{_NARROW}{_WIDE}][{WS}]*| [{WS}]+"


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides (``F.trim`` knows only blanks)."""
    return F.btrim(c, F.lit(BLANKS))


def single_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, LOOSE, " "))


def clean_text(c: Column) -> Column:
    """Null to '', drop tags and links, collapse white space, trim."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), TAG, " ")
    return single_spaced(F.regexp_replace(bare, LINK, " "))


def clip(c: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters, with '...' when it was longer."""
    line = strip(F.translate(F.coalesce(c, F.lit("")), "\n\r", "  "))
    short = F.rtrim(F.substring(line, 1, limit), F.lit(BLANKS))
    return F.when(F.length(line) > limit, F.concat(short, F.lit("..."))).otherwise(line)


def normalized_label(c: Column) -> Column:
    """Null to '', stripped, lower case."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def parse_boolean(c: Column) -> Column:
    """``true``, ``1`` and ``yes`` in any case are true, all else is false."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False))


def parse_double(c: Column) -> Column:
    """Text to double, null when it is no number.

    A trailing type letter, as in '1d', is a number to the JVM only; refuse it.
    """
    text = c.cast("string")
    return F.when(~text.rlike(rf"[0-9.][dDfF][{WS}]*$"), text.try_cast("double"))


def to_numeric(c: Column, fill: float) -> Column:
    """Number or ``fill``; NaN counts as missing."""
    return F.coalesce(F.nanvl(parse_double(c), F.lit(None).cast("double")), F.lit(float(fill)))


def tokens(c: Column) -> Column:
    """Lower-case word tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """Lower-case words of any length."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def without_stop_words(words: Column, stop: Sequence[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(list(stop)))


def bigrams(words: Column) -> Column:
    """Neighbouring pairs, joined with a blank."""
    n = F.size(words)
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded half to even on the exact
    binary value (Java's own formatting rounds the shortest decimal half up)."""
    unit = 1 << 62
    scale = 10**digits
    size = F.abs(c.cast("double"))
    whole = F.floor(size)
    # 62 fraction bits hold the fraction of any double >= 2**-10 exactly.
    bits = ((size - whole) * F.lit(float(unit))).cast("bigint").cast("decimal(20,0)")
    product = (bits * F.lit(scale).cast("decimal(8,0)")).cast("decimal(28,0)")
    q = F.floor(product / F.lit(unit).cast("decimal(20,0)")).cast("bigint")
    rest = product - (q.cast("decimal(20,0)") * F.lit(unit).cast("decimal(20,0)")).cast("decimal(28,0)")
    half = F.lit(unit // 2).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (q % 2 == 1))
    total = whole * scale + q + up.cast("bigint")
    sign = F.when((c < 0) & (total > 0), "-").otherwise("")
    if digits == 0:
        return F.concat(sign, total.cast("string"))
    return F.concat(
        sign,
        F.floor(total / scale).cast("string"),
        F.lit("."),
        F.lpad((total % scale).cast("string"), digits, "0"),
    )
