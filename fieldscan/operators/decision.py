"""Evidence states, the ordered rule table and the reasoning trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan import constants as C

RULE_SCHEMA = ("ord int, rule_id string, any_insufficient boolean, spectral array<string>, temporal array<string>, "
               "ground array<string>, decision string, reason string, next_step string")


def rule_table(spark: SparkSession) -> DataFrame:
    """The eight ordered rules; automation is blocked in every one of them."""
    return spark.createDataFrame(C.RULES, RULE_SCHEMA).withColumn("automation_allowed", F.lit(False))


def spectral_state(acquired_at: Column, cutoff: Column, contrast: Column, hotspots: Column) -> Column:
    return (F.when(acquired_at > cutoff, "INSUFFICIENT")
            .when(contrast <= C.MIN_CONTRAST, "NO_MEASURABLE_CONTRAST")
            .when(hotspots, "RELATIVE_HOTSPOTS_PRESENT").otherwise("NO_HIGH_RANKED_HOTSPOTS"))


def spectral_evidence(evidence: DataFrame, scenes: DataFrame, keys: list[str], cutoff: Column) -> DataFrame:
    """Per scene: NDMI range, presence of class >= 3, and the resulting state."""
    folded = evidence.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classified_pixels"), (F.max("ndmi") - F.min("ndmi")).alias("ndmi_range"),
        F.bool_or(F.col("risk_class") >= 3).alias("hotspots_present"), F.max("risk_score").alias("max_score"))
    return folded.join(scenes, keys).withColumn("spectral_state", spectral_state(
        F.col("acquired_at"), cutoff, F.col("ndmi_range"), F.col("hotspots_present")))


def _unknown(trend: Column) -> Column:
    return ~F.coalesce(trend.isin(*C.DIRECTIONS), F.lit(False))


def baseline_position(percentile: Column, trend: Column, available: Column) -> Column:
    """25 and 75 themselves are central; without a baseline and a trend there is no position."""
    low, high = C.CONDITION_EDGES
    missing = F.coalesce(~available, F.lit(True)) | percentile.isNull() | (trend == C.DIRECTIONS_MISSING)
    return (F.when(_unknown(trend), F.raise_error(F.lit("unknown temporal direction")).cast("string"))
            .when(missing, "UNAVAILABLE").when(percentile < low, "RELATIVELY_LOW")
            .when(percentile > high, "RELATIVELY_HIGH").otherwise("BROAD_HISTORICAL_RANGE"))


def temporal_state(percentile: Column, trend: Column, available: Column) -> Column:
    """Direction and position must agree; anything else sufficient is neutral.

    An unknown direction fails the job, with or without a baseline.
    """
    low, high = C.CONDITION_EDGES
    bounded = F.when(percentile.between(0, 100), percentile) \
        .otherwise(F.raise_error(F.lit("percentile outside 0..100")).cast("double"))
    missing = F.coalesce(~available, F.lit(True)) | percentile.isNull() | (trend == C.DIRECTIONS_MISSING)
    return (F.when(_unknown(trend), F.raise_error(F.lit("unknown temporal direction")).cast("string"))
            .when(missing, "INSUFFICIENT")
            .when((bounded < low) & (trend == "decreasing"), "DECLINE_SUPPORT")
            .when((bounded > high) & (trend == "increasing"), "RECOVERY_OR_WETTER")
            .otherwise("NEUTRAL_OR_MIXED"))


def decide(states: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule per row of spectral_state, temporal_state, ground_state.

    The rule table is eight rows by construction, so it travels with every row
    as one array literal: no join, no shuffle. An unknown state is an error.
    """
    known = (F.col("spectral_state").isin(*C.SPECTRAL_STATES) & F.col("temporal_state").isin(*C.TEMPORAL_STATES)
             & F.col("ground_state").isin(*C.GROUND_STATES))
    table = rules.orderBy("ord").collect()
    chosen = F.raise_error(F.lit("decision matrix is incomplete")).cast("int")
    for rule in reversed(table):
        matched = _matches(rule)
        chosen = F.when(matched, F.lit(rule["ord"])).otherwise(chosen)
    checked = F.when(F.coalesce(known, F.lit(False)), chosen) \
        .otherwise(F.raise_error(F.lit("unknown evidence state")).cast("int"))
    return states.withColumn("ord", checked).join(
        F.broadcast(rules.select("ord", "rule_id", "decision", "reason", "next_step", "automation_allowed")), "ord").drop("ord")


def _matches(rule) -> Column:
    matched = F.lit(True)
    if rule["any_insufficient"]:
        matched = (F.col("spectral_state") == "INSUFFICIENT") | (F.col("temporal_state") == "INSUFFICIENT")
    for name in ("spectral", "temporal", "ground"):
        if rule[name] is not None:
            matched = matched & F.col(f"{name}_state").isin(*rule[name])
    return matched


def reasoning_trace(decisions: DataFrame) -> Column:
    """Seven ordered entries: spectral, baseline, trend, temporal, ground, rule, automation."""
    def entry(rule_id: Column, explanation: Column) -> Column:
        return F.struct(rule_id.alias("rule_id"), explanation.alias("explanation"))

    position = baseline_position(F.col("percentile"), F.col("direction"), F.col("baseline_available"))
    spectral = F.when(F.col("spectral_state") == "RELATIVE_HOTSPOTS_PRESENT", F.format_string(C.TRACE_HOTSPOTS.format("%,d"), "classified_pixels")).otherwise(F.col("spectral_state"))
    base = F.when(F.col("baseline_available"), F.format_string(
        C.TRACE_BASELINE.format("%.4f", "%.2f", "%d", "%s"), "target_value", "percentile", "baseline_dates", position)) \
        .otherwise(C.TRACE_NO_BASELINE)
    trend = F.concat(F.when(F.col("slope_per_day").isNotNull(), F.format_string(
        C.TRACE_TREND.format("%d", "%+.6f", "%s"), "observations", "slope_per_day", "direction"))
        .otherwise(C.TRACE_NO_TREND), F.lit(C.TRACE_CUTOFF))
    agreement = F.coalesce(*[F.when(F.col("temporal_state") == state, text) for state, text in C.TRACE_TEMPORAL.items()])
    ground = F.when(F.col("ground_state") == "UNAVAILABLE", C.TRACE_NO_GROUND) \
        .otherwise(F.col("ground_state"))
    return F.array(
        entry(F.concat(F.lit("SPECTRAL_"), "spectral_state"), spectral),
        entry(F.concat(F.lit("TEMPORAL_BASELINE_"), position), base),
        entry(F.lit("TEMPORAL_TREND"), trend),
        entry(F.concat(F.lit("TEMPORAL_"), "temporal_state"), agreement),
        entry(F.concat(F.lit("GROUND_"), "ground_state"), ground),
        entry(F.col("rule_id"), F.concat("reason", F.lit(" Result: "), "decision", F.lit("."))),
        entry(F.lit("AUTOMATION_DISABLED"), F.lit(C.TRACE_AUTOMATION)))


def decision_matrix(spark: SparkSession) -> DataFrame:
    """The rule table as exported, together with the state vocabularies."""
    return rule_table(spark).orderBy("ord").withColumns({
        "spectral_states": F.array(*[F.lit(s) for s in C.SPECTRAL_STATES]),
        "temporal_states": F.array(*[F.lit(s) for s in C.TEMPORAL_STATES]),
        "ground_states": F.array(*[F.lit(s) for s in C.GROUND_STATES])})
