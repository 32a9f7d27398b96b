"""Score expressions shared by the rankers and the tuner."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K
from .text import as_col


def blend(heuristic, embedding, weight) -> Column:
    """Lexical score alone when ``embedding`` is null, else similarity plus a squashed lexical tie-break."""
    h, e = as_col(heuristic), as_col(embedding)
    squashed = F.tanh(F.greatest(F.lit(0.0), h) / F.lit(12.0))
    return F.when(e.isNull(), h).otherwise(F.greatest(F.lit(0.0), e) + as_col(weight) * squashed)


def age_days(ts, now) -> Column:
    """Days from ``ts`` to ``now``, never negative; 0 when the time is missing."""
    seconds = (F.unix_micros(as_col(now)) - F.unix_micros(as_col(ts))) / F.lit(1e6)
    return F.coalesce(F.greatest(F.lit(0.0), seconds / F.lit(86400.0)), F.lit(0.0))


def label_weight(label, source, detail, age, half_life: float = K.HALF_LIFE_DAYS) -> Column:
    label, source, detail = as_col(label), as_col(source), as_col(detail)
    weight = F.lit(K.PROVENANCE_DEFAULT)
    for (src, what), value in K.PROVENANCE_WEIGHTS.items():
        weight = F.when((source == src) & (detail == what), F.lit(value)).otherwise(weight)
    decay = F.exp(-F.log(F.lit(2.0)) * as_col(age) / F.lit(half_life)) if half_life > 0 else F.lit(1.0)
    return F.when(label == "unlabeled", F.lit(0.0)).otherwise(weight * decay)


def dot(a, b) -> Column:
    """Dot product in double precision."""
    pairs = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
