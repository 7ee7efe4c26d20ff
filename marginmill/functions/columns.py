"""Scalar column functions; all stay inside generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(col, digits=2):
    """Round a double half-to-even the way numpy does: scale, round, unscale."""
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def bround2(col):
    return round_even(col, 2)


def round_int(col):
    """Half-to-even to a whole number."""
    return F.rint(col).cast("bigint")


def at_least(col, low):
    return F.greatest(col, F.lit(low))


def safe_ratio(num, den):
    """num / den, and 0 where den is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def ratio_pct(num, den):
    """num / den in percent, NULL where den is 0."""
    return F.try_divide(num, den) * F.lit(100.0)


def pct_change(before, after):
    return F.try_divide(after - before, before) * F.lit(100.0)


def log1p(col):
    return F.log1p(col)


def to_ts(col):
    return F.to_timestamp_ntz(col)


def month_start(col):
    """First day of the month: 4 bytes to group and shuffle on instead of a text."""
    return F.trunc(col, "month")


def month_key(col):
    return F.date_format(col, "yyyy-MM")


def contains_any(col, words):
    text = F.lower(col)
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def contains_all(col, words):
    text = F.lower(col)
    hit = F.lit(True)
    for word in words:
        hit = hit & F.contains(text, F.lit(word))
    return hit


def replace_all(col, pairs):
    """Literal, case-sensitive replacements, one after the other."""
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def recode(col, mapping) -> Column:
    """Value for each key, NULL for keys the mapping does not have."""
    branches = None
    for key, value in mapping.items():
        hit = col == F.lit(key)
        branches = F.when(hit, F.lit(value)) if branches is None else branches.when(hit, F.lit(value))
    return F.lit(None).cast("string") if branches is None else branches


def lookup(mapping, key, default):
    return F.coalesce(recode(key, mapping), F.lit(default))


def keyed_draw(key):
    """Uniform whole number below 2**32 that depends on the key alone, so partitioning cannot change it."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


def draw_fraction(key, low, width):
    return F.lit(low) + F.lit(width) * keyed_draw(key) / F.lit(4294967296.0)


def draw_choice(key, values):
    """One of the values, a list or an array column."""
    choices = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, F.pmod(keyed_draw(key), F.size(choices)).cast("int") + 1)


def percent_label(col):
    return F.concat(col.cast("string"), F.lit("%"))


def title(col):
    """Capital at the start of every run of letters, small letters after it; a leading sharp s, which has no capital, becomes
    Ss."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    first = lambda run: F.when(F.substring(run, 1, 1) == "ß", "Ss").otherwise(F.upper(F.substring(run, 1, 1)))
    return F.array_join(F.transform(runs, lambda run: F.concat(first(run), F.lower(F.substring(run, 2, 1 << 30)))), "")


def whole_units(col, digits):
    """A number as a whole count of 10 ** -digits: sums of these are exact, order-free and as cheap as double sums. A
    value that has more digits than that, or is no number, is an error and not rounded."""
    scaled = col.cast("double") * F.lit(float(10**digits))
    whole = F.rint(scaled)
    # What is left of a double after scaling is far below this. NaN is above every number.
    finer = F.abs(scaled - whole) > F.abs(scaled) * 1e-12 + 0.001
    text = F.concat(F.lit(f"more than {digits} decimals: "), col.cast("string"))
    return F.when(finer, F.raise_error(text).cast("bigint")).otherwise(whole.cast("bigint"))


#: Fixed-point numbers are summed in three parts of so many bits: whole numbers of 10 ** -FIXED_DIGITS, exact for any
#: number of rows up to 2 ** 42.
FIXED_DIGITS, PART_BITS = 15, 20


def fixed_parts(col):
    """A number below 4000 in size as a fixed-point one, in three whole parts: sums of these are plain integer sums."""
    fixed = F.rint(col * F.lit(10.0**FIXED_DIGITS)).cast("bigint")
    low = F.lit((1 << PART_BITS) - 1)
    return [F.shiftright(fixed, 2 * PART_BITS), F.shiftright(fixed, PART_BITS).bitwiseAND(low), fixed.bitwiseAND(low)]


def from_fixed_parts(high, middle, low):
    """Sums of the parts back to the number."""
    exact = [c.cast("decimal(38,0)") for c in (high, middle, low)]
    step = F.lit(1 << PART_BITS)
    return ((exact[0] * step + exact[1]).cast("decimal(38,0)") * step + exact[2]).cast("double") / F.lit(10.0**FIXED_DIGITS)


def from_units(col, digits):
    """Whole counts of 10 ** -digits back to the number, rounded once."""
    return (col * F.expr(f"{10.0**-digits:.{digits}f}BD")).cast("double")


def cents(col):
    """Money as whole cents."""
    return whole_units(col, 2)


def money(col):
    """Whole cents back to currency units, rounded once."""
    return (col * F.expr("0.01BD")).cast("double")
