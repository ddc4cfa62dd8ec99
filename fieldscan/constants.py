"""Fixed values. Results depend on them, so they are stated here, together."""

# --- fixed values: wavelengths, in nanometres ------------------------------
ANALYSIS_WINDOW_NM = (400.0, 1700.0)
TARGET_BANDS_NM = {"red": 665.0, "red_edge": 705.0, "nir": 860.0, "swir": 1650.0}
ATMOSPHERIC_CAUTION_NM = (1350.0, 1450.0)
WATER_VAPOUR_NM = ((1350.0, 1450.0), (1800.0, 1950.0))
SWIR_EDGE_NM = 2450.0
CONTRAST_WIDTH_NM = 25.0
CONTRAST_MIN_BANDS = 3
CONTRAST_INDEX_RADIUS_NM = 15.0
CONTRAST_SEPARATION_NM = 100.0
CONTRAST_REGIONS = 3

# --- fixed values: screening ------------------------------------------------
INDEX_NAMES = ("ndvi", "ndre", "ndmi")
INDEX_BOUND = 1 + 1e-12
NOTEBOOK_EPSILON = 1e-6
VEGETATION_NDVI = 0.30
MIN_CONTRAST = 1e-12
CONDITION_EDGES = (25.0, 75.0)
CONDITION_LABELS = {0: "excluded", 1: "lower quarter", 2: "middle half", 3: "upper quarter"}
CLASS_EDGES = (25.0, 50.0, 75.0)
CLASS_NAMES = ("Low", "Moderate", "High", "Very High")
STATISTIC_LEVELS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)

# --- fixed values: multispectral scenes -------------------------------------
SCENE_BANDS = {"red": "B04", "red_edge": "B05", "nir": "B8A", "swir": "B11"}
CLEAR_LAND_CLASSES = (4, 5)
GRID_METRES = 20
MIN_VALID_FRACTION = 0.20
MIN_VEGETATION_PIXELS = 100
COVERAGE_REASON = "insufficient clear valid footprint coverage"
VEGETATION_REASON = "too few vegetation pixels"

# --- fixed values: time series ----------------------------------------------
STABLE_TOLERANCE = 0.02
BASELINE_LOOKBACK_DAYS = 60
BASELINE_MIN_DATES = 5
BASELINE_MAX_GAP_DAYS = 7.0
DIRECTIONS = ("increasing", "decreasing", "broadly stable", "insufficient observations")
DIRECTIONS_MISSING = "insufficient observations"
BASELINE_REASON = "Too few prior dates or nearest usable acquisition is more than the allowed gap away."

# --- fixed values: anomaly model --------------------------------------------
MODEL_SEED = 813
EXPORT_SAMPLE_SIZE = 2_048
PCA_VARIANCE = 0.99
FOREST_TREES = 200
FOREST_SAMPLES = 256

# --- fixed values: tolerances ------------------------------------------------
ABS_TOLERANCE = 1e-9
REL_TOLERANCE = 1e-10

# --- fixed values: sphere and map ---------------------------------------------
EARTH_RADIUS_KM = 6371.0088
MAX_MAP_LATITUDE = 85.0511287798066

# --- fixed values: evidence states and the ordered rule table -----------------
SPECTRAL_STATES = ("RELATIVE_HOTSPOTS_PRESENT", "NO_HIGH_RANKED_HOTSPOTS",
                   "NO_MEASURABLE_CONTRAST", "INSUFFICIENT")
TEMPORAL_STATES = ("DECLINE_SUPPORT", "NEUTRAL_OR_MIXED", "RECOVERY_OR_WETTER", "INSUFFICIENT")
GROUND_STATES = ("UNAVAILABLE", "VERIFIED_LOW", "VERIFIED_NORMAL")

# (ord, id, any_insufficient, spectral, temporal, ground, decision, reason, next_step);
# None means "any state".
RULES = [
    (1, "D01", True, None, None, None, "INSUFFICIENT_EVIDENCE",
     "At least one required satellite evidence component is insufficient.",
     "Resolve missing or temporally ineligible satellite evidence, then rerun the review; do not infer stress from missing data."),
    (2, "D02", False, ["RELATIVE_HOTSPOTS_PRESENT"], ["DECLINE_SUPPORT"], ["VERIFIED_LOW"], "ACTION_REVIEW_REQUIRED",
     "Relative hotspots, temporal decline support and site-verified low ground moisture agree.",
     "Request human agronomic review of the corroborated evidence, crop/soil context and sensor representativeness before considering any action."),
    (3, "D03", False, None, None, ["VERIFIED_LOW"], "ELEVATED_CONCERN",
     "Site-verified low ground moisture warrants local review, while satellite evidence does not fully agree.",
     "Review local ground conditions and calibration with an agronomist; investigate the spatial or temporal disagreement."),
    (4, "D04", False, None, ["DECLINE_SUPPORT"], ["VERIFIED_NORMAL"], "GROUND_VERIFICATION_REQUIRED",
     "Temporal decline evidence conflicts with the site-normal ground interpretation.",
     "Check sensor calibration, timing and field representativeness; repeat representative measurements to resolve the disagreement."),
    (5, "D05", False, None, None, ["VERIFIED_NORMAL"], "MONITOR",
     "Site-normal ground evidence and absence of temporal decline support do not justify escalation.",
     "Continue observation and review local conditions if evidence changes; no irrigation escalation is authorized."),
    (6, "D06", False, ["RELATIVE_HOTSPOTS_PRESENT"], None, ["UNAVAILABLE"], "GROUND_VERIFICATION_REQUIRED",
     "Relative hyperspectral hotspots offer sampling priorities, but ground verification is unavailable.",
     "Review the hotspot map against field boundaries; obtain quality-checked, site-calibrated soil-moisture observations in representative hotspot and comparison areas before considering an intervention."),
    (7, "D07", False, None, ["DECLINE_SUPPORT"], ["UNAVAILABLE"], "GROUND_VERIFICATION_REQUIRED",
     "Temporal moisture-related decline evidence requires local verification of its cause.",
     "Arrange representative ground verification and inspect crop/soil context; do not treat the spectral decline as confirmed water stress."),
    (8, "D08", False, None, None, None, "MONITOR",
     "Available evidence supplies neither relative high-ranked hotspots nor temporal decline support.",
     "Continue monitoring and seek ground context when available; absence of these signals does not establish absence of stress."),
]

# --- fixed values: sentences of the reasoning trace ------------------------------
TRACE_HOTSPOTS = "Relative hyperspectral hotspots are available within {} classified vegetation pixels. Their extent is not drought prevalence."
TRACE_BASELINE = "Closest eligible Sentinel NDMI is {}, at percentile {} of {} prior daily medians: {}. This rank is not a probability."
TRACE_NO_BASELINE = "A usable decision-time NDMI baseline comparison is unavailable."
TRACE_TREND = "Using {} eligible daily observations, the historical NDMI slope is {} index units/day ({})."
TRACE_NO_TREND = "Fewer than three eligible daily observations: no decision-time NDMI trend can be estimated."
TRACE_CUTOFF = " Observations after the cutoff are not used."
TRACE_TEMPORAL = {
    "INSUFFICIENT": "A usable baseline and at least three historical dates are required.",
    "DECLINE_SUPPORT": "Low NDMI baseline rank and decreasing historical NDMI agree; moisture-related decline evidence only.",
    "RECOVERY_OR_WETTER": "High NDMI baseline rank and increasing historical NDMI agree; a relative spectral state, not measured recovery.",
    "NEUTRAL_OR_MIXED": "NDMI baseline position and trend do not jointly support a directional state; central, stable or conflicting evidence remains neutral/mixed.",
}
TRACE_NO_GROUND = "No real ground measurements are available; none have been simulated or inferred from satellite indices."
TRACE_AUTOMATION = "Stage 4 permits decision support and human review only. Automatic irrigation and pump activation are blocked in every rule."

# --- fixed values: contract vocabulary ----------------------------------------
USE_CASE_PURPOSE = {
    "EXPLORE_EARTH": "Preliminary Earth-observation screening of a selected agricultural region using data available for that location.",
    "VERIFY_MY_FIELD": "Combine satellite screening with a human observation from someone who can physically access the field.",
    "SMART_FARM": "Combine EO evidence with site-specific IoT measurements and future continuous monitoring.",
}
PRESENTATION_MODES = ("SIMPLE", "EXPERT")
ANALYSIS_LEVELS = ("PRELIMINARY_EO", "EO_ENHANCED", "GROUND_INFORMED", "SITE_MONITORED")
AVAILABILITY_STATES = ("AVAILABLE", "UNAVAILABLE", "NOT_CHECKED", "NOT_CONNECTED",
                       "AVAILABLE_BUT_UNCALIBRATED", "INSUFFICIENT_QUALITY")
EVIDENCE_SOURCES = ("sentinel", "temporal", "hyperspectral", "weather", "ground", "iot", "ml")
STATES_WITH_EVIDENCE = ("AVAILABLE", "AVAILABLE_BUT_UNCALIBRATED", "INSUFFICIENT_QUALITY")
STATES_WITH_GROUND_RECORDS = ("AVAILABLE", "INSUFFICIENT_QUALITY")
STATES_WITH_SENSOR_RECORDS = ("AVAILABLE", "AVAILABLE_BUT_UNCALIBRATED", "INSUFFICIENT_QUALITY")
OBSERVER_TYPES = ("FARMER", "RESEARCHER", "AGRONOMIST")
PLANT_CONDITIONS = ("NORMAL", "MILD_WILTING", "SEVERE_WILTING", "YELLOWING", "VISIBLE_DAMAGE", "UNKNOWN", "OTHER")
SOIL_CONDITIONS = ("WET", "MOIST", "DRY", "VERY_DRY", "UNKNOWN")
RECENT_IRRIGATION = ("YES", "NO", "UNKNOWN")
VERIFICATION_STATES = ("SELF_REPORTED", "EXPERT_VERIFIED", "SENSOR_SUPPORTED")
SENSOR_STATES = ("CONNECTED", "CALIBRATED", "UNCALIBRATED", "STALE", "INVALID")
CALIBRATION_STATES = ("CALIBRATED", "UNCALIBRATED")
DECISION_STATES = ("NO_CLEAR_CONCERN", "MONITOR", "REVIEW_RECOMMENDED",
                   "GROUND_VERIFICATION_REQUIRED", "INSUFFICIENT_DATA")
INSPECTION_STATES = ("REVIEW_RECOMMENDED", "GROUND_VERIFICATION_REQUIRED")
CONTENT_CATEGORIES = ("status", "evidence_level", "inspection_recommended", "next_action", "key_limitations",
                      "NDVI", "NDRE", "NDMI", "spectral_evidence", "temporal_metrics", "hyperspectral_details",
                      "PCA", "ml_anomaly", "provenance", "quality_masks", "evidence_fusion", "reasoning_trace",
                      "limitations")
SIMPLE_CATEGORIES = ("status", "evidence_level", "inspection_recommended", "next_action", "key_limitations")
SENSOR_MAX_AGE_SECONDS = 86_400.0
SENSOR_RANGES = {  # (column, low, high, required)
    "soil_moisture": (0.0, 1.0, True), "air_temperature": (-273.15, None, True),
    "relative_humidity": (0.0, 100.0, True), "soil_temperature": (-273.15, None, False),
    "ec": (0.0, None, False), "ph": (0.0, 14.0, False), "leaf_wetness": (0.0, 100.0, False),
}
PLATFORMS = ("Sentinel-2A", "Sentinel-2B", "Sentinel-2C")

# --- fixed values: limitation texts a contract must carry -----------------------
ML_LIMITATION = "Experimental spectral anomaly evidence is complementary only; not drought or disease detection, probability, calibrated agronomic prediction or ground truth."
PRODUCT_LIMITATIONS = (
    "Evidence levels describe available capability, not accuracy, confidence, probability or guarantees; more sources do not automatically improve accuracy.",
    "Analyse agricultural areas using Earth-observation data available for that location; coverage and usable quality differ by place and time.",
    "Decision support only. No autonomous intervention is allowed in this PoC; no decision state establishes a diagnosis.",
)
GROUND_LIMITATION = "Human observations are ground evidence, not automatically independent scientific ground truth, including reviewed observations."
SENSOR_LIMITATION = "Site-specific sensors are fallible; calibration, quality, freshness and spatial relevance do not guarantee correctness or representativeness."
SIMPLE_LIMITATION = "Screening is not a diagnosis; evidence richness does not measure accuracy."
SIMPLE_NO_SATELLITE = "Usable satellite screening is unavailable."
SIMPLE_NO_GROUND = "Human field observations are unavailable or not usable."
SIMPLE_NO_SENSOR = "Usable calibrated site monitoring is unavailable."
SIMPLE_ML = "Experimental evidence cannot establish a cause or diagnosis."
