"""Waveform arrays (P2-P5, X2-X5, X10) as higher-order-function expressions.

Every operator maps ``ARRAY<FLOAT>`` sample columns row by row inside the JVM;
Arrow jobs (:mod:`vocalframe.operators.audio`) take the codec and DSP work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET_RATE = 16000


def mono(channels: Column) -> Column:
    """Channels x samples -> per-sample mean over channels."""
    n = F.size(F.element_at(channels, 1))
    k = F.size(channels)
    mean = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
                       lambda i: F.aggregate(channels, F.lit(0.0).cast("double"),
                                             lambda acc, ch: acc + F.get(ch, i)) / k)
    return F.when(n > 0, mean).otherwise(F.array().cast("array<double>"))


def resampled_length(n: Column, rate: Column, target: int = TARGET_RATE) -> Column:
    """round-half-even(n * target / rate), as Python's round."""
    return F.rint(n * F.lit(float(target)) / rate).cast("int")


def resample(samples: Column, rate: Column, target: int = TARGET_RATE) -> Column:
    """Linear interpolation onto ``round(n*target/rate)`` evenly spaced
    positions from 0 to n-1 (numpy ``interp`` over ``linspace``); unchanged when
    the rates are equal."""
    n = F.size(samples)
    m = resampled_length(n, rate, target)

    def at(p):
        lo = F.floor(p).cast("int")
        frac = p - lo
        x0 = F.element_at(samples, lo + 1).cast("double")
        x1 = F.element_at(samples, F.least(lo + 2, n)).cast("double")
        return x0 + frac * (x1 - x0)

    step = F.when(m > 1, (n - 1).cast("double") / (m - 1)).otherwise(F.lit(0.0))
    out = F.transform(F.sequence(F.lit(0), m - 1), lambda i: at(i * step).cast("float"))
    return F.when(rate == target, samples).when(m == 0, F.array().cast("array<float>")).otherwise(out)


def duration_seconds(samples: Column, rate: Column) -> Column:
    """P3."""
    return F.size(samples) / rate


def short_enough(samples: Column, rate: Column, max_seconds: float, target: int = TARGET_RATE) -> Column:
    """P5 without resampling: the resampled length is known from the count."""
    if max_seconds <= 0:
        return F.lit(True)
    return resampled_length(F.size(samples), rate, target) <= int(max_seconds * target)


def clip(samples: Column) -> Column:
    """Clamp to [-1, 1]."""
    return F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)).cast("float"))


def pad_or_trim(samples: Column, length: int) -> Column:
    """Zero-pad or cut to ``length`` samples."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), length)), 1, length)


def time_mask(samples: Column, start: Column, width: Column) -> Column:
    """Zero a contiguous span [start, start + width)."""
    return F.transform(samples, lambda x, i: F.when((i >= start) & (i < start + width),
                                                     F.lit(0.0).cast("float")).otherwise(x))
