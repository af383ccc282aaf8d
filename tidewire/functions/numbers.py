"""Lift, chart scales, vectors and stored forms."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def lift(observed: Column, observed_days: int, baseline: Column, baseline_days: int) -> Column:
    """Daily rate against the baseline's, at most ``LIFT_CAP``; the cap for a rise over nothing."""
    ratio = (observed / F.lit(float(observed_days))) / (F.when(baseline > 0, baseline) / F.lit(float(baseline_days)))
    return F.when(baseline > 0, F.least(F.lit(C.LIFT_CAP), ratio)).when(observed > 0, C.LIFT_CAP).otherwise(0.0)


def nice_step(raw: Column) -> Column:
    """The least of 1, 2, 5, 10 times a power of ten that is not below ``raw``."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.when(raw > 0, raw))))
    part = raw / size
    return F.when(raw > 0, size * F.when(part <= 1, 1.0).when(part <= 2, 2.0).when(part <= 5, 5.0).otherwise(10.0)).otherwise(1.0)


def axis_ticks(peak: Column, most: int = 12) -> Column:
    step = nice_step(peak / 4)
    all_ = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: i * step)
    return F.transform(F.filter(all_, lambda v: v <= peak + step / 2), lambda v: F.floor(v + 0.5).cast("long"))


def place(values: Column, left: int, top: int, width: int, height: int) -> Column:
    """Points of a polyline in a box; a single value stands in the middle."""
    n = F.size(values)
    most = F.greatest(F.lit(1.0), F.array_max(values).cast("double"))
    x = lambda i: F.when(n <= 1, width / 2).otherwise(i / F.greatest(n - 1, F.lit(1)) * width) + left
    return F.transform(values, lambda v, i: F.struct(x(i).alias("x"), (top + height - v / most * height).alias("y")))


def _encoded(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else "f32le:1:" + base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


def encode_vector(c: Column) -> Column:
    """float32 little-endian in base64 behind ``f32le:1:``."""
    return F.pandas_udf(_encoded, "string")(c)


def _decoded(text: str | None):
    if text is None or not text.startswith("f32le:1:"):
        return None
    try:
        raw = base64.b64decode(text[8:], validate=True)
    except ValueError:
        return None
    if not raw or len(raw) % 4:
        return None
    v = np.frombuffer(raw, "<f4")
    return v if np.isfinite(v).all() else None


def _all_decoded(text: pd.Series) -> pd.Series:
    return text.map(_decoded)


def decode_vector(c: Column) -> Column:
    """NULL for anything that is not a stored vector of finite numbers."""
    return F.pandas_udf(_all_decoded, "array<float>")(c)


def signature_from_json(text: Column) -> Column:
    """Stored signatures; unreadable ones are empty."""
    from .text import normalize_terms

    read = F.from_json(text, "words array<string>, phrases array<string>", {"mode": "PERMISSIVE"})
    none = F.array().cast("array<string>")
    return F.struct(normalize_terms(F.coalesce(read["words"], none)).alias("words"), normalize_terms(F.coalesce(read["phrases"], none)).alias("phrases"))


def ids_from_json(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
