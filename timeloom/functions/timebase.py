"""Exact rational time and bounded integer arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I64_MAX = 2**63 - 1
US_PER_SECOND = 1_000_000


def _dec(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def ticks_to_us(ticks: Column, num: Column, den: Column) -> Column:
    """ticks * num * 1e6 / den in 128 bits, truncated toward zero; null when the
    result leaves 64 bits.  The check comes before the division, which would wrap."""
    scaled = F.try_multiply(F.try_multiply(_dec(ticks), _dec(num)), F.lit(US_PER_SECOND).cast("decimal(7,0)")).cast("decimal(38,0)")
    top, low = _dec(den) * F.lit(I64_MAX).cast("decimal(19,0)"), _dec(den) * F.lit(-I64_MAX - 1).cast("decimal(19,0)")
    fits = (scaled < top + _dec(den)) & (scaled > low - _dec(den))
    safe = F.when(fits, scaled)
    return F.call_function("try_divide", safe - safe % _dec(den), _dec(den)).cast("decimal(38,0)").cast("long")


def us_of(ticks: Column, num: int, den: int) -> Column:
    """The same for one time base known beforehand: plain 64-bit arithmetic where
    the product can't overflow, the decimal way elsewhere."""
    factor = num * US_PER_SECOND
    bound = I64_MAX // factor
    t = F.when(F.abs(ticks) <= bound, ticks) * F.lit(factor)
    return F.when(F.abs(ticks) <= bound, ((t - t % F.lit(den)) / F.lit(den)).cast("long")).otherwise(ticks_to_us(ticks, F.lit(num), F.lit(den)))


def rational(num: Column, den: Column) -> Column:
    return num.cast("double") / F.nullif(den, F.lit(0)).cast("double")


def saturating_add(a: Column, b: Column) -> Column:
    """a + b, held at the ends of 64 bits."""
    return F.coalesce(F.try_add(a, b), F.when(b > 0, F.lit(I64_MAX)).when(b < 0, F.lit(-I64_MAX - 1)))


def saturating_multiply(a: Column, b: Column) -> Column:
    """a * b of numbers that aren't negative, held at the largest of 64 bits."""
    return F.coalesce(F.try_multiply(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(I64_MAX)))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def step_target(frame: Column, delta: Column, last: Column) -> Column:
    """frame + delta within 0..last, without overflow."""
    return clamp(saturating_add(frame, delta), F.lit(0).cast("long"), last)


def frame_of_fraction(fraction: Column, count: Column) -> Column:
    """The frame at a fraction of the timeline, halves rounded up."""
    last = F.greatest(count - 1, F.lit(0))
    return F.floor(clamp(fraction, F.lit(0.0), F.lit(1.0)) * last + F.lit(0.5)).cast("long")


def fraction_of_frame(frame: Column, count: Column) -> Column:
    return F.when(count <= 1, F.lit(0.0)).otherwise(clamp(frame, F.lit(0), count - 1) / (count - 1))


def rotation(degrees: Column) -> Column:
    """Degrees within 0..359, also of negative ones."""
    return F.pmod(degrees, F.lit(360))


def half_up(n: Column, d: Column, scale: int = 10000) -> Column:
    """n / d in basis points, halves up, null where d is zero."""
    d = F.nullif(d, F.lit(0))
    x = n * scale + (d - d % 2) / 2
    return ((x - x % d) / d).cast("long")


def share(total: Column, n: Column, nth: Column) -> Column:
    """A total dealt to n parts, the first ``total % n`` of which get one more."""
    return ((total - total % n) / n).cast("long") + F.when(nth - 1 < total % n, 1).otherwise(0)


def watts(nano_watt_hours: Column, ms: Column) -> Column:
    """Mean power of an energy over a time."""
    return nano_watt_hours * F.lit(3.6) / F.nullif(ms, F.lit(0)) / F.lit(1000.0)


def format_timestamp(us: Column) -> Column:
    """[-]h:mm:ss.uuuuuu"""
    a = F.abs(us)
    h = F.floor(a / 3_600_000_000)
    m = F.floor(a / 60_000_000) % 60
    s = F.floor(a / 1_000_000) % 60
    u = a % 1_000_000
    return F.concat(F.when(us < 0, "-").otherwise(""), F.format_string("%d:%02d:%02d.%06d", h, m, s, u))


def seconds_to_us(text: Column) -> Column:
    """Exact decimal seconds to microseconds; null where the text is no such
    number or has a fraction of a microsecond."""
    ok = text.rlike(r"^[0-9]{1,12}(\.[0-9]{1,18})?$")
    d = F.when(ok, text).cast("decimal(38,18)") * F.lit(US_PER_SECOND).cast("decimal(7,0)")
    return F.when(d == F.floor(d), d.cast("decimal(38,0)").cast("long"))
