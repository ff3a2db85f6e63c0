"""Scalar column functions, all JVM-side unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from ..model import BVC_ITEMS, BVC_MODIFIERS, BVC_TRUE, REGIONS, UNIT_TO_UV


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def to_microvolts(value: Column, unit: Column) -> Column:
    """Scale once by the declared unit; an undeclared unit is an error."""
    scale = F.try_element_at(literal_map(UNIT_TO_UV), unit)
    return value * F.coalesce(scale, F.raise_error(F.lit("eeg_unit must be uV, mV or V")).cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    """Clamp that keeps NULL (least/greatest would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def site_of(name: Column) -> Column:
    """'EEG Fp1-REF', 'Fp1-LE', 'FP1' -> 'fp1'."""
    bare = F.regexp_replace(F.trim(name), r"(?i)^EEG[ _-]*", "")
    return F.lower(F.split(bare, r"[-_ /.]")[0])


def depth_proxy(sef95: Column, entropy: Column, delta_rel: Column) -> Column:
    """Uncalibrated 0-100 descriptor of spectral slowing; NULL when any part is missing."""
    return (clip(sef95 / 30.0, 0, 1) + clip(entropy, 0, 1) + clip(1.0 - delta_rel, 0, 1)) / 3.0 * 100.0


def bvc_flag(text: Column) -> Column:
    return F.coalesce(F.trim(text.cast("string")).isin(*BVC_TRUE), F.lit(False))


def bvc_score(flags: dict[str, Column] | None = None) -> Column:
    flags = flags or {c: F.col(c) for c in BVC_ITEMS}
    total = F.lit(0)
    for c in BVC_ITEMS:
        if c in flags:
            total = total + F.when(flags[c], 1).otherwise(0)
    return total


def bvc_band(score: Column) -> Column:
    return F.when(score <= 0, "low").when(score <= 2, "moderate").when(score > 2, "very_high")


def bvc_modifier(band: Column, which: int) -> Column:
    """0: accumulation threshold multiplier, 1: level offset; neutral without an observation."""
    table = literal_map({b: m[which] for b, m in BVC_MODIFIERS.items()})
    return F.coalesce(F.try_element_at(table, band), F.lit((1.0, 0.0)[which]))


def region_of(channel: Column) -> Column:
    """struct(region, hemisphere); unknown labels name themselves with hemisphere '?'."""
    region = F.try_element_at(literal_map({k: v[0] for k, v in REGIONS.items()}), channel)
    side = F.try_element_at(literal_map({k: v[1] for k, v in REGIONS.items()}), channel)
    return F.struct(F.coalesce(region, channel).alias("region"), F.coalesce(side, F.lit("?")).alias("hemisphere"))


def log_feature(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log(F.greatest(c, F.lit(1e-9))))


def epochs_column(channel: str, feature: str) -> str:
    return f"{channel}__{feature}"


def _alert_line(t, level, index, slope, eta, message) -> str:
    head = {"EARLY_WARNING": "EARLY WARNING", "CLINICAL_RISK": "CLINICAL NOTICE"}.get(level, level)
    clock = f"{int(t) // 60:02d}:{int(t) % 60:02d}"
    tail = ""
    if level == "EARLY_WARNING" and eta is not None and eta == eta:
        tail = " | ETA <1 min" if eta < 1 else f" | ETA ~{eta:.0f} min"
    return f"[{clock}] {head} | index {index:+.2f} z | trend {slope:+.2f} z/min{tail}\n  {message}"


@F.pandas_udf(StringType())
def alert_text(t: pd.Series, level: pd.Series, index: pd.Series, slope: pd.Series, eta: pd.Series,
               message: pd.Series) -> pd.Series:
    """One line per alert. Python formatting, because its half-even decimals differ from the JVM's;
    alerts are a vanishing share of the rows."""
    return pd.Series([_alert_line(*row) for row in zip(t, level, index, slope, eta, message)], dtype="object")
