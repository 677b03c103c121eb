"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_53 = 9007199254740992  # 2**53


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """Division that yields NULL on a zero or NULL divisor (ANSI-safe)."""
    return F.try_divide(col(a), col(b))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def weekday_name(c) -> Column:
    """Full English day name, e.g. 'Saturday'."""
    return F.date_format(col(c), "EEEE")


def is_weekend(c) -> Column:
    return F.weekday(col(c)) >= 5


def hash_uniform(seed: int, *cols) -> Column:
    """Repeatable uniform in (0, 1) from a 64-bit hash of the given columns.

    Independent of partitioning and task order, so re-runs and retried tasks
    draw the same numbers.
    """
    h = F.xxhash64(F.lit(int(seed)), *[col(c) for c in cols])
    return (F.pmod(h, F.lit(TWO_53)).cast("double") + F.lit(0.5)) / F.lit(float(TWO_53))


def word_count(c) -> Column:
    """Number of whitespace-separated tokens (Python `len(str.split())`)."""
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"),
                           lambda x: x != F.lit("")))


def fixed4_text(v) -> Column:
    """`f"{v:.4f}"` of a double exactly as Python prints it.

    Python rounds the exact binary value half-to-even; Java's %.4f rounds
    its shortest decimal form half-up.  v * 10^4 is taken exactly as p + e
    (Dekker's error-free product, Veltkamp split), the integer is rint(p)
    corrected when p sits on a .5 tie and e breaks it, and the text is built
    from that integer.  Beyond 2^53 / 10^4 the plain format is used."""
    v = col(v)
    split = F.lit(134217729.0) * v                # 2^27 + 1
    hi = split - (split - v)
    lo = v - hi
    ten4 = F.lit(10000.0)
    p = v * ten4
    e = (hi * ten4 - p) + lo * ten4               # 10^4 splits exactly (low part 0)
    n = F.rint(p)                                 # nearest, ties to even
    d = p - n                                     # exact, |d| <= 0.5
    # only a .5 gap between p and n can be tipped by the error term; an exact
    # tie (e == 0) keeps rint's even choice
    r = F.when((d == 0.5) & (e > 0), n + 1).when((d == -0.5) & (e < 0), n - 1).otherwise(n)
    a = F.abs(r).cast("bigint")
    body = F.concat((a / 10000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad(F.pmod(a, F.lit(10000)).cast("string"), 4, "0"))
    neg = (v < 0) | ((v == 0) & v.cast("string").startswith("-"))   # -0.0 prints '-0.0000'
    exact = F.when(neg, F.concat(F.lit("-"), body)).otherwise(body)
    return (F.when(v.isNull() | F.isnan(v), F.lit("nan"))
             .when(F.abs(v) >= F.lit(9.0e11), F.format_string("%.4f", v))
             .otherwise(exact))


def float_list_text(c) -> Column:
    """`'%.4f'` of every element joined by ', '; a missing element is `nan`."""
    return F.array_join(F.transform(col(c), fixed4_text), ", ")


def strip_ws(c) -> Column:
    """Python `str.strip()`: leading and trailing whitespace (not just spaces)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def py_str_repr(c) -> Column:
    """Python `repr()` of a string: single quotes unless the text holds a
    single quote and no double quote; backslash, quote, \n, \r, \t escaped."""
    t = col(c)
    esc = F.replace(t, F.lit("\\"), F.lit("\\\\"))
    for ch, rep in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(ch), F.lit(rep))
    dq = t.contains("'") & ~t.contains('"')
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def duration_text(seconds) -> Column:
    """`1d 2h 3m 4s` from a number of seconds; zero parts dropped except seconds."""
    s = F.bround(col(seconds)).cast("bigint")   # Python round(): half to even
    d, rem = F.floor(s / 86400), F.pmod(s, F.lit(86400))
    h, rem2 = F.floor(rem / 3600), F.pmod(rem, F.lit(3600))
    m, sec = F.floor(rem2 / 60), F.pmod(rem2, F.lit(60))

    def part(v, unit):
        return F.when(v > 0, F.concat(v.cast("string"), F.lit(unit + " "))).otherwise(F.lit(""))

    return F.concat(part(d, "d"), part(h, "h"), part(m, "m"), sec.cast("string"), F.lit("s"))


# Monday 1970-01-05: origin for counting business days arithmetically.
_EPOCH_MONDAY = dt.date(1970, 1, 5)


def business_days_before(c) -> Column:
    """Number of Monday..Friday days in [1970-01-05, c)."""
    k = F.datediff(col(c), F.lit(_EPOCH_MONDAY))
    return F.lit(5) * F.floor(k / 7) + F.least(F.pmod(k, F.lit(7)), F.lit(5))


def iso_date_check(c) -> Column:
    """True when the string looks like YYYY-MM-DD (format only, as the reference)."""
    return F.coalesce(col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def cosine(a, b) -> Column:
    """Cosine similarity of two equal-length numeric arrays."""
    a, b = col(a), col(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v * v))
    return safe_div(dot, na * nb)
