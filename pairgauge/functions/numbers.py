"""Arithmetic columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


_SPLIT = 134217729.0  # 2**27 + 1: cuts a double into halves whose products are exact


def let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` worked out once a row, however often the body has it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def py_round(x: Column, digits: int) -> Column:
    """Round the exact binary value half to even, as Python's round does.

    The product with the power of ten is taken with its rounding error, so a tie is a tie of the
    exact value and not of a decimal print of it."""
    scale = 10.0**digits
    big = scale * _SPLIT
    high = big - (big - scale)
    low = scale - high

    def rounded(v: Column) -> Column:
        p, wide = v * scale, v * _SPLIT
        xh = wide - (wide - v)
        xl = v - xh
        error = ((xh * high - p) + xh * low + xl * high) + xl * low
        base = F.floor(p).cast("double")
        over = (p - (base + 0.5)) + error
        up = (over > 0) | ((over == 0) & (base % 2 != 0))
        return F.when(v.isNull() | F.isnan(v), v).otherwise(F.when(up, base + 1).otherwise(base) / scale)

    return let(x.cast("double"), rounded)


def lora_parameters(rank: Column, width_in: Column, width_out: Column, layers: Column) -> Column:
    """Parameters that low-rank adapters add to ``layers`` equal linear maps."""
    return rank * (width_in + width_out) * layers


def optimizer_steps(rows: Column, batch: Column, accumulate: Column, epochs: Column) -> Column:
    """Steps of whole epochs, the last step of each epoch may be short."""
    return (F.ceil(F.ceil(rows / batch) / accumulate) * epochs).cast("long")


def warmup_steps(steps: Column, ratio: float) -> Column:
    return F.floor(steps * ratio).cast("long")


def spend(rate_per_hour: Column, seconds: Column) -> Column:
    return rate_per_hour * seconds / 3600


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds)


def roof_fraction(achieved: Column, peak: Column) -> Column:
    return F.when(peak > 0, achieved / peak)


def token_cap(text: Column, per_token: float = 2.8, extra: int = 48) -> Column:
    """Tokens to allow for an answer of a text's length in characters."""
    return F.floor(F.length(text) / per_token + extra).cast("int")


def bounded_cap(text: Column, per_token: int = 3, extra: int = 48, low: int = 160, high: int = 640) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.length(text) / per_token + extra).cast("int")))


def deferred(text: Column, cap: Column | int) -> Column:
    """Whether a text needs more tokens than a run allows, so that it has to wait."""
    return token_cap(text) > cap


def training_bytes(weights: Column, trainable: Column, allowance: Column | int) -> Column:
    """Weights, eight bytes of optimizer state and two of gradient a trainable parameter, and an allowance for activations."""
    return (weights + trainable * 10 + allowance).cast("long")
