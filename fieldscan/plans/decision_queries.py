"""Decision queries: states, rules, fusion and trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.operators import decision
from fieldscan.operators.temporal import theil_sen
from fieldscan.plans import analyses
from fieldscan.plans.registry import query
from fieldscan.plans.series_queries import BASELINE_SQL, CUTOFF, SITE, baselines, days, trend_sql
from fieldscan.plans.views import ACQUISITIONS, acquisitions, r, table
from fieldscan.session import checkpointed


def _pick(values, expression: str) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# every event carries one of the 48 state triples, read off its id
STATES_SQL = f"""states AS (SELECT event_id, {_pick(C.SPECTRAL_STATES, 'event_id % 4')} AS spectral_state,
  {_pick(C.TEMPORAL_STATES, '(event_id // 4) % 4')} AS temporal_state, {_pick(C.GROUND_STATES, '(event_id // 16) % 3')} AS ground_state FROM events)"""

RULE_SQL = """CASE WHEN spectral_state = 'INSUFFICIENT' OR temporal_state = 'INSUFFICIENT' THEN 'D01'
  WHEN spectral_state = 'RELATIVE_HOTSPOTS_PRESENT' AND temporal_state = 'DECLINE_SUPPORT' AND ground_state = 'VERIFIED_LOW' THEN 'D02'
  WHEN ground_state = 'VERIFIED_LOW' THEN 'D03' WHEN ground_state = 'VERIFIED_NORMAL' AND temporal_state = 'DECLINE_SUPPORT' THEN 'D04'
  WHEN ground_state = 'VERIFIED_NORMAL' THEN 'D05' WHEN spectral_state = 'RELATIVE_HOTSPOTS_PRESENT' AND ground_state = 'UNAVAILABLE' THEN 'D06'
  WHEN temporal_state = 'DECLINE_SUPPORT' AND ground_state = 'UNAVAILABLE' THEN 'D07' ELSE 'D08' END"""
DECISION_SQL = f"""CASE {RULE_SQL} WHEN 'D01' THEN 'INSUFFICIENT_EVIDENCE' WHEN 'D02' THEN 'ACTION_REVIEW_REQUIRED' WHEN 'D03' THEN 'ELEVATED_CONCERN'
  WHEN 'D04' THEN 'GROUND_VERIFICATION_REQUIRED' WHEN 'D06' THEN 'GROUND_VERIFICATION_REQUIRED' WHEN 'D07' THEN 'GROUND_VERIFICATION_REQUIRED' ELSE 'MONITOR' END"""


def states(spark: SparkSession, folder: str) -> DataFrame:
    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    e = F.col("event_id")
    return table(spark, folder, "events").select(
        "event_id", pick(C.SPECTRAL_STATES, F.pmod(e, F.lit(4))).alias("spectral_state"),
        pick(C.TEMPORAL_STATES, F.pmod(F.floor(e / 4), F.lit(4))).alias("temporal_state"),
        pick(C.GROUND_STATES, F.pmod(F.floor(e / 16), F.lit(3))).alias("ground_state"))


@query("rule_decisions", f"""WITH {STATES_SQL}
SELECT event_id, {RULE_SQL} AS rule_id, {DECISION_SQL} AS decision, false AS automation_allowed FROM states""")
def rule_decisions(spark: SparkSession, folder: str) -> DataFrame:
    decided = decision.decide(states(spark, folder), decision.rule_table(spark))
    return decided.select("event_id", "rule_id", "decision", "automation_allowed")


@query("rule_usage", f"""WITH {STATES_SQL}, used AS (SELECT {RULE_SQL} AS rule_id FROM states)
SELECT rule_id, count(*) AS uses FROM used GROUP BY ALL""")
def rule_usage(spark: SparkSession, folder: str) -> DataFrame:
    matrix = decision.decision_matrix(spark).select("rule_id")
    used = decision.decide(states(spark, folder), decision.rule_table(spark)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("uses"))
    return matrix.join(used, "rule_id", "left").fillna(0, subset=["uses"])


STATE_SQL = """CASE WHEN NOT available OR pct IS NULL OR direction = 'insufficient observations' THEN 'INSUFFICIENT'
  WHEN pct < 25 AND direction = 'decreasing' THEN 'DECLINE_SUPPORT' WHEN pct > 75 AND direction = 'increasing' THEN 'RECOVERY_OR_WETTER'
  ELSE 'NEUTRAL_OR_MIXED' END"""


POSITION_SQL = """CASE WHEN NOT available OR pct IS NULL OR direction = 'insufficient observations' THEN 'UNAVAILABLE'
  WHEN pct < 25 THEN 'RELATIVELY_LOW' WHEN pct > 75 THEN 'RELATIVELY_HIGH' ELSE 'BROAD_HISTORICAL_RANGE' END"""


@query("temporal_states", f"""WITH {BASELINE_SQL}, {trend_sql()},
j AS (SELECT f.*, CASE WHEN target_id LIKE '%7' THEN 'insufficient observations' ELSE direction END AS direction FROM folded f JOIN directed t ON f.site = t.site)
SELECT site, target_id, round(CASE WHEN available THEN pct END, 8) AS percentile, direction, {POSITION_SQL} AS position,
  {STATE_SQL} AS temporal_state FROM j""")
def temporal_states(spark: SparkSession, folder: str) -> DataFrame:
    """State and position of every target; targets of days that end in 7 have too few observations for a trend."""
    daily = checkpointed(days(spark, folder))
    trend = theil_sen(daily, SITE, "day", "median").select("site", "direction")
    joined = baselines(spark, folder, daily).join(trend, "site").withColumn("direction", F.when(
        F.col("target_id").endswith("7"), C.DIRECTIONS_MISSING).otherwise(F.col("direction")))
    state = [F.col(c) for c in ("percentile", "direction", "available")]
    return joined.select("site", "target_id", r(F.col("percentile"), 8).alias("percentile"), "direction",
                         decision.baseline_position(*state).alias("position"), decision.temporal_state(*state).alias("temporal_state"))


FUSED_SQL = ACQUISITIONS + f""",
eligible AS (SELECT * FROM days WHERE last_at <= TIMESTAMP '{CUTOFF}'),
known AS (SELECT a.* FROM acquisitions a JOIN eligible e ON a.site = e.site AND a.day = e.day), {trend_sql('eligible')},
targets AS (SELECT DISTINCT site, TIMESTAMP '2024-01-19 12:00:00' AS target_at FROM acquisitions),
near AS (SELECT t.site, target_at, acquired_at, abs(epoch_us(acquired_at) - epoch_us(target_at)) / 864e8 AS gap,
  row_number() OVER (PARTITION BY t.site ORDER BY abs(epoch_us(acquired_at) - epoch_us(target_at)), acquired_at, scene_id) AS place FROM targets t JOIN known k ON t.site = k.site AND k.scene_id % 4 > 0),
compared AS (SELECT n.*, e.day AS compared_day, e.median AS target_value FROM near n JOIN eligible e ON e.site = n.site AND e.day = n.acquired_at::DATE WHERE place = 1),
base AS (SELECT c.*, e.median AS v FROM compared c LEFT JOIN eligible e ON e.site = c.site AND e.first_at >= c.target_at - INTERVAL 60 DAYS AND e.last_at < c.target_at AND e.day <> c.compared_day),
folded AS (SELECT site, target_value, count(v) AS baseline_dates, count(v) >= 5 AND gap <= 7 AS available,
  1e2 * (count(*) FILTER (v < target_value) + 5e-1 * count(*) FILTER (v = target_value)) / count(v) AS pct FROM base GROUP BY site, target_value, gap),
contrast AS (SELECT site, count(*) AS pixels, max(value) - min(value) AS rng, max(value) >= 3e0 AS hot FROM known GROUP BY ALL),
fused AS (SELECT f.*, c.pixels, t.slope_per_day, t.observations, t.direction, {STATE_SQL} AS temporal_state, 'UNAVAILABLE' AS ground_state,
  CASE WHEN rng <= 1e-12 THEN 'NO_MEASURABLE_CONTRAST' WHEN hot THEN 'RELATIVE_HOTSPOTS_PRESENT' ELSE 'NO_HIGH_RANKED_HOTSPOTS' END AS spectral_state
  FROM folded f JOIN contrast c ON f.site = c.site JOIN directed t ON t.site = f.site)"""


def fused(spark: SparkSession, folder: str) -> DataFrame:
    """Every site decided as of the cutoff; nothing after it can reach the result."""
    cutoff = F.lit(CUTOFF).cast("timestamp")
    daily, a = checkpointed(days(spark, folder)), acquisitions(spark, folder)
    targets = daily.select("site").distinct().select("site", F.lit("now").alias("target_id"), F.lit("2024-01-19 12:00:00").cast("timestamp").alias("target_at"))
    temporal_rows = analyses.temporal_evidence(daily, a.select(
        "site", "day", "scene_id", "acquired_at", (F.col("scene_id") % 4).alias("contributing")), targets, SITE, "median", cutoff)
    eligible = daily.where(F.col("last_at") <= cutoff).select("site", "day")
    spectral = a.join(eligible, ["site", "day"], "left_semi").groupBy("site").agg(
        F.count(F.lit(1)).alias("classified_pixels"), (F.max("value") - F.min("value")).alias("range"), (F.max("value") >= 3.0).alias("hot")) \
        .select("site", "classified_pixels", decision.spectral_state(
            F.lit("2024-01-19 12:00:00").cast("timestamp"), cutoff, F.col("range"), F.col("hot")).alias("spectral_state"))
    return analyses.fuse(spectral, temporal_rows, decision.rule_table(spark), SITE)


@query("fused_decisions", f"""WITH {FUSED_SQL}
SELECT site, spectral_state, temporal_state, ground_state, {RULE_SQL} AS rule_id, {DECISION_SQL} AS decision, observations, baseline_dates,
  round(pct, 8) AS percentile, round(slope_per_day, 12) + 0e0 AS slope_per_day FROM fused""")
def fused_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return fused(spark, folder).select("site", "spectral_state", "temporal_state", "ground_state", "rule_id", "decision", "observations",
                                       "baseline_dates", r(F.col("percentile"), 8).alias("percentile"), r(F.col("slope_per_day"), 12).alias("slope_per_day"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _half_up(value: str, digits: int) -> str:
    return f"round({value}::DECIMAL(18, 8), {digits})::DECIMAL(18, {digits})::VARCHAR"


TRACE_SQL = f"""CASE WHEN spectral_state = 'RELATIVE_HOTSPOTS_PRESENT' THEN format({_quoted(C.TRACE_HOTSPOTS.format('{:,}'))}, pixels) ELSE spectral_state END,
  CASE WHEN available THEN format({_quoted(C.TRACE_BASELINE)}, {_half_up('target_value', 4)}, {_half_up('pct', 2)}, baseline_dates, {POSITION_SQL})
    ELSE {_quoted(C.TRACE_NO_BASELINE)} END,
  CASE WHEN slope_per_day IS NOT NULL THEN format({_quoted(C.TRACE_TREND.format('{}', '{:+.6f}', '{}'))}, observations, slope_per_day, direction)
    ELSE {_quoted(C.TRACE_NO_TREND)} END || {_quoted(C.TRACE_CUTOFF)},
  CASE temporal_state {' '.join(f'WHEN {_quoted(s)} THEN {_quoted(t)}' for s, t in C.TRACE_TEMPORAL.items())} END,
  {_quoted(C.TRACE_NO_GROUND)},
  CASE {RULE_SQL} {' '.join(f'WHEN {_quoted(rule[1])} THEN {_quoted(rule[7] + " Result: " + rule[6] + ".")}' for rule in C.RULES)} END,
  {_quoted(C.TRACE_AUTOMATION)}"""


@query("reasoning_trace", f"""WITH {FUSED_SQL},
t AS (SELECT site, unnest(['SPECTRAL_' || spectral_state, 'TEMPORAL_BASELINE_' || {POSITION_SQL},
  'TEMPORAL_TREND', 'TEMPORAL_' || temporal_state, 'GROUND_UNAVAILABLE', {RULE_SQL}, 'AUTOMATION_DISABLED']) AS rule_id, unnest([1, 2, 3, 4, 5, 6, 7]) AS position,
  unnest([{TRACE_SQL}]) AS explanation FROM fused)
SELECT site, position::BIGINT AS position, rule_id, explanation FROM t""")
def reasoning_trace(spark: SparkSession, folder: str) -> DataFrame:
    entries = fused(spark, folder).select("site", F.posexplode("trace").alias("position", "entry"))
    return entries.select("site", (F.col("position") + 1).cast("bigint").alias("position"), "entry.rule_id", "entry.explanation")
