"""Numbers as texts: strict integers, scores, score bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_long(text: Column) -> Column:
    """A 64-bit integer from a text of digits with an optional sign; null for anything else, spaces included."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))


def format_score(score: Column) -> Column:
    """A score as text: whole ones below 1e15 without a point, others in shortest form and never with an exponent."""
    text = F.upper(score.cast("string"))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_extract(text, r"([0-9]+)(?:\.([0-9]+))?(?:E(-?[0-9]+))?", 1)
    fraction = F.regexp_replace(F.regexp_extract(text, r"([0-9]+)(?:\.([0-9]+))?(?:E(-?[0-9]+))?", 2), r"0+$", "")
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?[0-9]+)$", 1), F.lit("")), F.lit("0")).cast("int")  # try_cast() of an empty text raises and catches an error in each row
    digits = F.concat(mantissa, fraction)
    point = F.length(mantissa) + power  # digits before the point
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.rpad(digits, point, "0")
    within = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))
    plain = F.concat(sign, F.when(point <= 0, small).when(point >= F.length(digits), large).otherwise(within))
    done = ~text.contains("E") & ~text.endswith("0")  # plain and shortest as it is, as most are: spared the patterns
    whole = (score == F.floor(score).cast("double")) & (F.abs(score) < 1e15)
    return F.when(F.isnan(score), "NaN").when(score == math.inf, "inf").when(score == -math.inf, "-inf").when(whole, score.cast("long").cast("string")).when(done, text).otherwise(plain)


def score_between(score: Column, low: str, high: str) -> Column:
    """Whether a score lies between two bounds such as 1, (2.5, -inf, +inf; an opening bracket excludes the bound."""

    def parse(bound: str) -> tuple[float, bool]:
        if bound in ("inf", "+inf"):
            return math.inf, False
        return (float(bound[1:]), True) if bound.startswith("(") else (float(bound), False)

    (a, a_open), (b, b_open) = parse(low), parse(high)
    above = F.lit(True) if low == "-inf" else F.lit(False) if a == math.inf and not a_open else score > a if a_open else score >= a
    below = F.lit(True) if b == math.inf and not b_open else F.lit(False) if high == "-inf" else score < b if b_open else score <= b
    return above & below
