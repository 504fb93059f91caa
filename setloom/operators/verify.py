"""Support decisions of cell-type claims against an effect table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sentences as say
from ..functions.text import normal_label
from ..params import SupportThresholds


def lookup_by_label(claims: DataFrame, effects: DataFrame, claim_label: str, effect_label: str) -> DataFrame:
    """Claims joined to the effect row with the same normalised label; later rows win."""
    body = F.struct(*[c for c in effects.columns if c not in ("study_id", effect_label, "ord")])
    index = effects.groupBy("study_id", normal_label(F.col(effect_label)).alias("_key")).agg(
        F.max_by(body, "ord").alias("_m"))
    return claims.withColumn("_key", normal_label(F.col(claim_label))).join(
        index, ["study_id", "_key"], "left").select("*", "_m.*").drop("_m", "_key")


def direction_fit(effect: Column, direction: Column) -> Column:
    d = F.upper(direction)
    return (
        F.when((d == "UP") & (effect > 0), "positive").when((d == "DOWN") & (effect < 0), "negative")
        .when(d.isin("UP", "DOWN"), "opposite").otherwise("unknown"))


def support_decision(
    effect: Column, q: Column, direction: Column, limits: SupportThresholds = SupportThresholds()
) -> Column:
    fit = direction_fit(effect, direction)
    fits = fit.isin("positive", "negative")
    strong = (q <= limits.support_q) & (F.abs(effect) >= limits.support_effect)
    some = (q <= limits.partial_q) | (F.abs(effect) >= limits.partial_effect)
    return (
        F.when(effect.isNull(), "Refuted").when(fits & strong, "Supported").when(fits & some, "Partial")
        .otherwise("Refuted"))


def signed_text(effect: Column) -> Column:
    """Sign and two decimals of the exact binary value, halves to the even digit; Java's own format takes 0.285 as it is written.

    From 1e15 on, where no decimals matter, Java's format stays.
    """
    java = F.format_string("%+.2f", effect)
    plain = F.abs(effect.cast("double")) < 1e15
    size = F.when(plain, F.abs(effect.cast("double"))).otherwise(0.0)
    whole = F.floor(size)
    # The binary places of the part behind the point as a whole number, exact wherever a cent is near; 100 / 2^60 = 25 / 2^58.
    cents = ((size - whole) * float(2**60)).cast("long").cast("decimal(19,0)") * F.lit(25).cast("decimal(2,0)")
    unit = F.lit(2**58).cast("decimal(19,0)")
    rest = cents % unit
    down = ((cents - rest) / unit).cast("long")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (down % 2 == 1))
    shown = down + up.cast("long")
    units = whole + (shown == 100).cast("long")
    exact = F.concat(F.substring(java, 1, 1), units.cast("string"), F.lit("."), F.lpad((shown % 100).cast("string"), 2, "0"))
    return F.when(effect.isNull(), "NA").when(plain, exact).otherwise(java)


def short_number(q: Column) -> Column:
    """Three significant digits, exponent form below 1e-4, no trailing zeros."""
    exponent = F.floor(F.log10(F.abs(q))).cast("int")
    # Rounding may carry into the next power of ten.
    shown = F.round(q * F.pow(F.lit(10.0), 2 - exponent)) / F.pow(F.lit(10.0), 2 - exponent)
    exponent = F.floor(F.log10(F.abs(shown)) + 1e-12).cast("int")
    tidy = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    mantissa = tidy(F.format_string("%.2f", shown / F.pow(F.lit(10.0), exponent)))
    sci = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = F.lit(None).cast("string")
    for e in range(-4, 3):
        plain = F.when(exponent == e, tidy(F.format_string(f"%.{2 - e}f", shown))).otherwise(plain)
    return F.when(q == 0, "0").when((exponent < -4) | (exponent > 2), sci).otherwise(plain)


def support_reason(
    effect: Column, q: Column, direction: Column, decision: Column, limits: SupportThresholds = SupportThresholds()
) -> Column:
    fit = direction_fit(effect, direction)
    both = F.concat(F.lit("Effect "), signed_text(effect), F.lit(", q="), short_number(q))
    opposed = F.concat(F.lit("Effect sign ("), signed_text(effect), F.lit(") opposes "), direction,
                       F.lit(" with q="), short_number(q), F.lit("."))
    return (
        F.when(effect.isNull(), say.NOT_IN_TABLE)
        .when((fit == "opposite") & (q <= limits.support_q), opposed)
        .when(fit.isin("opposite", "unknown"), F.concat(F.lit(say.NO_DIRECTION), direction, F.lit(".")))
        .when(decision == "Supported", F.concat(both, F.lit(say.MEETS)))
        .when(decision == "Partial", F.concat(both, F.lit(say.BORDERLINE)))
        .otherwise(F.concat(both, F.lit(" is weak for "), direction, F.lit("."))))


def downgraded(decision: Column, background_flag: Column) -> Column:
    """One level lower where the background flag starts with yes."""
    yes = F.startswith(F.lower(F.coalesce(background_flag, F.lit(""))), F.lit("yes"))
    lower = F.when(decision == "Supported", "Partial").when(decision == "Partial", "Refuted").otherwise(decision)
    return F.when(yes, lower).otherwise(decision)


def background_note(reason: Column, background_flag: Column) -> Column:
    yes = F.startswith(F.lower(F.coalesce(background_flag, F.lit(""))), F.lit("yes"))
    why = F.when(F.contains(background_flag, F.lit("—")), F.trim(F.regexp_extract(background_flag, "(?s)^[^—]*—(.*)$", 1))).otherwise(background_flag)
    return F.when(yes, F.concat(reason, F.lit(" Background note: "), why, F.lit("."))).otherwise(reason)


def decide(claims: DataFrame, effects: DataFrame, limits: SupportThresholds = SupportThresholds()) -> DataFrame:
    """Verification rows of claims (study_id, theme, direction, cell_type[, background_flag]).

    ``effects``: study_id, ord, cell_type, effect_size, q_value.
    """
    j = lookup_by_label(claims, effects, "cell_type", "cell_type")
    flag = F.col("background_flag") if "background_flag" in claims.columns else F.lit(None).cast("string")
    e, q, d = F.col("effect_size"), F.col("q_value"), F.col("direction")
    first = support_decision(e, q, d, limits)
    return j.withColumn("_d", first).select(
        "study_id", "theme", "direction", "cell_type", downgraded(F.col("_d"), flag).alias("decision"),
        signed_text(e).alias("effect_size"), F.when(e.isNull(), "NA").otherwise(short_number(q)).alias("q_value"),
        background_note(support_reason(e, q, d, F.col("_d"), limits), flag).alias("reason"))
