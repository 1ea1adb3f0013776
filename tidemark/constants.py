"""Fixed values that decide results; changing one changes what is detected."""

TOP_K = 50
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
QUANTILE_NAMES = ("p05", "p25", "p50", "p75", "p95")

SIGNIFICANCE_Z = 3.0
MIN_COVERAGE = 0.9

VALUE_SUBSTITUTION = "value_substitution"
CASE_FORMAT = "case_format_normalization"
SPLIT_MERGE = "category_split_merge"
UNIT_SCALE = "unit_scale_shift"
DISTRIBUTION_SHIFT = "numeric_distribution_shift"
#: Order in which detectors report.
DETECTORS = (VALUE_SUBSTITUTION, CASE_FORMAT, SPLIT_MERGE, UNIT_SCALE, DISTRIBUTION_SHIFT)
#: A signature that silences another on the same column.
SUPPRESSES = {UNIT_SCALE: DISTRIBUTION_SHIFT, CASE_FORMAT: VALUE_SUBSTITUTION}

MIN_SHARE = 0.03
MIN_SHIFT = 0.02
MASS_MATCH_TOLERANCE = 0.35
RESPELL_MASS_TOLERANCE = 0.05
CONSERVE_TOLERANCE = 0.15
DISTRIBUTION_THRESHOLD = 0.1
QUANTILE_NOISE_SD = 0.38
RELATIVE_SPREAD_EPS = 1e-4
FIT_TOLERANCE = 0.05
MULTIPLY_TOLERANCE = 0.2
ADD_TOLERANCE = 0.2
NARROW_SPREAD_FLOOR = 1e-3

MAX_LEAD_SECONDS = 24 * 3600
COVERAGE_WEIGHT = 0.6
PROXIMITY_WEIGHT = 0.4

MATERIAL_MAGNITUDE = 0.1
SEVERITIES = ("low", "medium", "high", "critical")

MARGIN_CAP = 20.0
FIT_L2, FIT_RATE, FIT_STEPS, FOLDS, BINS = 0.01, 0.3, 3000, 5, 10

#: Frozen confidence model over magnitude, significance margin and log10 of the smaller sample.
FEATURE_NAMES = ("magnitude", "significance_margin", "log10_n")
MODEL_WEIGHTS = (0.36777455031687195, 1.2356980472920416, 3.0767743360405664)
MODEL_INTERCEPT = 1.227389068643264
MODEL_MEANS = (0.2214388793162773, 3.633715648056193, 2.666565041182176)
MODEL_STDS = (0.21265918746779622, 3.9304261870483117, 0.6100790618045059)
