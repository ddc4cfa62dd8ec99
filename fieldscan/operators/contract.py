"""Validation of field records, sensors, evidence and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.functions import text as T
from fieldscan.functions.checks import blank_optional, errors, message, not_in, out_of_range
from fieldscan.functions.geometry import bbox_ok, parse_bbox, point_ok, ring_problems
from fieldscan.functions.timestamps import gap_micros, valid_range, zoned_timestamp


def ground_errors(not_after: Column | None = None) -> Column:
    """Messages for one human observation (columns as in the ground schema)."""
    at = zoned_timestamp(F.col("timestamp"))
    irrigated = zoned_timestamp(F.col("recent_irrigation_timestamp"))
    has_irrigation = F.col("recent_irrigation_timestamp").isNotNull()
    future = F.lit(None) if not_after is None else F.when(at > not_after, F.lit("observation lies in the future"))
    return errors(
        message(T.is_blank(F.col("observation_id")), "observation_id must be nonempty text"),
        message(T.is_blank(F.col("crop_type")), "crop_type must be nonempty text"),
        message(~point_ok(F.col("lon"), F.col("lat")), "location outside longitude/latitude range"),
        message(at.isNull(), "timestamp needs a date, time and zone"),
        future,
        *[message(not_in(F.col(column), allowed), f"unknown {column}") for column, allowed in (
            ("observer_type", C.OBSERVER_TYPES), ("plant_condition", C.PLANT_CONDITIONS),
            ("soil_condition", C.SOIL_CONDITIONS), ("recent_irrigation", C.RECENT_IRRIGATION),
            ("verification_state", C.VERIFICATION_STATES))],
        *[message(blank_optional(F.col(column)), f"{column} must be nonempty text when given")
          for column in ("symptoms", "notes", "photo_reference")],
        message(T.is_blank(F.col("verification_reference"))
                & ((F.col("verification_state") != "SELF_REPORTED") | F.col("verification_reference").isNotNull()),
                "verification_reference must be nonempty text"),
        message(has_irrigation & (irrigated.isNull() | (F.col("recent_irrigation") != "YES")),
                "irrigation time needs a zone and recent_irrigation YES"),
        message(has_irrigation & irrigated.isNotNull() & at.isNotNull() & (irrigated > at),
                "irrigation cannot follow its observation"))


def sensor_errors() -> Column:
    """Messages for one sensor reading and its calibration record."""
    calibrated_at = zoned_timestamp(F.col("calibrated_at"))
    valid_until = zoned_timestamp(F.col("valid_until"))
    calibrated = F.col("cal_state") == "CALIBRATED"
    return errors(
        message(T.is_blank(F.col("sensor_id")), "sensor_id must be nonempty text"),
        message(~point_ok(F.col("lon"), F.col("lat")), "location outside longitude/latitude range"),
        message(zoned_timestamp(F.col("timestamp")).isNull(), "timestamp needs a date, time and zone"),
        message(not_in(F.col("state"), C.SENSOR_STATES), "unknown state"),
        message(not_in(F.col("cal_state"), C.CALIBRATION_STATES), "unknown cal_state"),
        message(F.col("quality_valid").isNull(), "quality_valid must be boolean"),
        *[message(out_of_range(F.col(column), low, high, required), f"{column} out of range")
          for column, (low, high, required) in C.SENSOR_RANGES.items()],
        message(calibrated & (T.is_blank(F.col("cal_reference")) | T.is_blank(F.col("cal_site_reference"))),
                "calibrated metadata needs both references"),
        message(calibrated & (calibrated_at.isNull() | valid_until.isNull()), "calibrated metadata needs an interval"),
        message(calibrated_at.isNotNull() & valid_until.isNotNull() & (calibrated_at > valid_until),
                "reversed calibration interval"),
        message((F.col("state") == "CALIBRATED") & ~calibrated, "CALIBRATED sensor without calibrated metadata"),
        message((F.col("state") == "UNCALIBRATED") & calibrated, "UNCALIBRATED sensor with calibrated metadata"))


def area_errors() -> Column:
    """Messages for one area of interest: id, geometry, inclusive time range, optional names."""
    kind = F.col("geometry.kind")
    g = F.col("geometry")
    start, end = zoned_timestamp(F.col("start")), zoned_timestamp(F.col("end"))
    return errors(
        message(T.is_blank(F.col("aoi_id")), "aoi_id must be nonempty text"),
        message(not_in(kind, ("Point", "BoundingBox", "Polygon")), "unsupported geometry"),
        message(F.coalesce(kind == "Point", F.lit(False)) & ~point_ok(g["lon"], g["lat"]), "point outside range"),
        message(F.coalesce(kind == "BoundingBox", F.lit(False)) & ~bbox_ok(g["west"], g["south"], g["east"], g["north"]), "invalid bounding box"),
        message(F.coalesce(kind == "Polygon", F.lit(False)) & (F.size(ring_problems(g["ring"])) > 0), "invalid polygon"),
        message(~valid_range(start, end), "time range needs two zoned instants in order"),
        *[message(blank_optional(F.col(c)), f"{c} must be nonempty text when given") for c in ("place_name", "country")])


def selected_area(requests: DataFrame, countries: DataFrame) -> DataFrame:
    """Country record and parsed box of each request; both or neither.

    requests: country_id, bbox text. The country table is a few hundred rows.
    """
    known = countries.select(F.col("id").alias("_id"), F.struct("*").alias("_country"))
    found = requests.withColumn("_box", parse_bbox(F.col("bbox"))).join(known, F.col("country_id") == F.col("_id"), "left")
    both = F.col("_box").isNotNull() & F.col("_country").isNotNull()
    return found.select(*requests.columns, F.when(both, F.col("_country")).alias("country"), F.when(both, F.col("_box")).alias("box"))


def evidence_errors() -> Column:
    """Messages for one evidence record: source, summary, provenance list.

    Model evidence carries fixed disclaimers: it is never a diagnosis, a
    probability, ground truth, or an input to the decision.
    """
    is_model = F.col("source") == "ml"
    return errors(
        message(not_in(F.col("source"), C.EVIDENCE_SOURCES), "unknown source"),
        message(~is_model & T.is_blank(F.col("summary")), "summary must be nonempty text"),
        message(is_model & T.is_blank(F.col("scene_id")), "model evidence needs its scene_id"),
        message(F.coalesce(F.size("provenance") <= 0, F.lit(True))
                | F.exists("provenance", lambda p: T.is_blank(p)), "provenance must list nonempty text"),
        message(is_model & (F.coalesce("used_for_decision", F.lit(False)) | F.coalesce("score_is_probability", F.lit(False))),
                "model evidence cannot decide or be a probability"))


def split_by_errors(records: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined); the quarantined rows keep their messages."""
    checked = records.withColumn("errors", problems)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def usable_at(as_of: Column, max_age_seconds: float = C.SENSOR_MAX_AGE_SECONDS,
              measured_at: Column | None = None) -> Column:
    """Sensor usability at an explicit instant; stateless, so it also serves a stream."""
    measured = zoned_timestamp(F.col("timestamp")) if measured_at is None else measured_at
    age = gap_micros(as_of, measured)
    return F.coalesce(
        (F.col("state") == "CALIBRATED") & F.col("quality_valid") & (F.col("cal_state") == "CALIBRATED")
        & (age >= 0) & (age <= F.lit(int(max_age_seconds * 1_000_000)))
        & (zoned_timestamp(F.col("calibrated_at")) <= measured)
        & (as_of <= zoned_timestamp(F.col("valid_until"))), F.lit(False))


def relevant(inside: Column, at: Column, start: Column, end: Column, as_of: Column) -> Column:
    """Inside the area, within the requested range, and not after the cutoff."""
    return F.coalesce(inside & (at >= start) & (at <= F.least(end, as_of)), F.lit(False))


def analysis_level(state: dict[str, Column]) -> Column:
    """Richness of the evidence; NULL without usable satellite screening."""
    have = {source: column == "AVAILABLE" for source, column in state.items()}
    richer = reduce(lambda a, b: a | b, [have[s] for s in ("temporal", "hyperspectral", "weather", "ml")])
    return (F.when(~F.coalesce(have["sentinel"], F.lit(False)), F.lit(None).cast("string"))
            .when(have["iot"], "SITE_MONITORED").when(have["ground"], "GROUND_INFORMED")
            .when(richer, "EO_ENHANCED").otherwise("PRELIMINARY_EO"))


def availability_conflicts(availability: DataFrame, evidence: DataFrame) -> DataFrame:
    """(result_id, source, state, records, conflict): AVAILABLE needs a record, and
    a record needs a state that admits one. Records are counted before the join."""
    counted = evidence.groupBy("result_id", "source").agg(F.count(F.lit(1)).alias("records"))
    joined = availability.join(counted, ["result_id", "source"], "full_outer").fillna(0, subset=["records"])
    return joined.withColumn("conflict", F.when(
        F.coalesce(F.col("state") == "AVAILABLE", F.lit(False)) & (F.col("records") == 0), "missing evidence").when(
        (F.col("records") > 0) & ~F.coalesce(F.col("state").isin(*C.STATES_WITH_EVIDENCE), F.lit(False)),
        "unexpected evidence"))


def result_errors() -> Column:
    """Messages for one wide result row: availability columns, record counts, decision."""
    state = {source: F.col(source) for source in C.EVIDENCE_SOURCES}
    level = analysis_level(state)
    return errors(
        *[message(not_in(F.col(s), C.AVAILABILITY_STATES), f"unknown {s} availability") for s in C.EVIDENCE_SOURCES],
        message(not_in(F.col("use_case"), C.USE_CASE_PURPOSE), "unknown use_case"),
        message(not_in(F.col("presentation_mode"), C.PRESENTATION_MODES), "unknown presentation_mode"),
        message(not_in(F.col("decision_state"), C.DECISION_STATES), "unknown decision_state"),
        message(T.is_blank(F.col("next_action")), "next_action must be nonempty text"),
        message(level.isNull() & (F.col("decision_state") != "INSUFFICIENT_DATA"),
                "without satellite evidence the decision must be INSUFFICIENT_DATA"),
        message((F.col("ground") == "AVAILABLE") & (F.col("ground_records") == 0), "AVAILABLE ground needs a record"),
        message((F.col("iot") == "AVAILABLE") & (F.col("usable_sensor_records") == 0), "AVAILABLE iot needs a usable record"),
        message((F.col("ground_records") > 0) & ~F.col("ground").isin(*C.STATES_WITH_GROUND_RECORDS),
                "ground records conflict with availability"),
        message((F.col("sensor_records") > 0) & ~F.col("iot").isin(*C.STATES_WITH_SENSOR_RECORDS),
                "sensor records conflict with availability"))


def required_limitations(own: Column, has_ground: Column, has_sensor: Column, has_model: Column) -> Column:
    """Mandatory texts first, then the result's own, each once."""
    def only_if(condition: Column, text: str) -> Column:
        return F.when(condition, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))

    return T.ordered_union(F.array(*[F.lit(t) for t in C.PRODUCT_LIMITATIONS]),
                           only_if(has_ground, C.GROUND_LIMITATION), only_if(has_sensor, C.SENSOR_LIMITATION),
                           only_if(has_model, C.ML_LIMITATION), own)


def simple_content(state: dict[str, Column]) -> dict[str, Column]:
    """The five fields of the simple presentation, with conditional caveats."""
    level = analysis_level(state)
    return {
        "status": F.col("decision_state"), "evidence_level": level,
        "inspection_recommended": F.col("decision_state").isin(*C.INSPECTION_STATES),
        "next_action": F.col("next_action"),
        "key_limitations": errors(
            F.lit(C.SIMPLE_LIMITATION), F.when(level.isNull(), C.SIMPLE_NO_SATELLITE),
            F.when(F.coalesce(state["ground"] != "AVAILABLE", F.lit(True)), C.SIMPLE_NO_GROUND),
            F.when(F.coalesce(state["iot"] != "AVAILABLE", F.lit(True)), C.SIMPLE_NO_SENSOR),
            F.when(state["ml"] == "AVAILABLE", C.SIMPLE_ML))}


def forbidden_content(requested: DataFrame) -> DataFrame:
    """Rows (presentation_mode, category) that a mode may not show."""
    simple = F.col("category").isin(*C.SIMPLE_CATEGORIES)
    known = F.col("category").isin(*C.CONTENT_CATEGORIES)
    allowed = known & ((F.col("presentation_mode") == "EXPERT") | ((F.col("presentation_mode") == "SIMPLE") & simple))
    return requested.where(~F.coalesce(allowed, F.lit(False)))
