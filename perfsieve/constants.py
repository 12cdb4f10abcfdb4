"""Column names and fixed values the results depend on."""

# --- fixed values: key and anchor columns -------------------------------------------------
SUMMARY_ID = "alert_summary_id"
BUG_NUMBER = "alert_summary_bug_number"
SIGNATURE_ID = "signature_id"
ANCHOR_PUSH = "alert_summary_push_id"
ANCHOR_REVISION = "alert_summary_revision"
REPOSITORY = "alert_summary_repository"
FRAMEWORK = "alert_summary_framework"
NOTES = "alert_summary_notes"
PUSH_TIME = "push_timestamp"
CREATION_TIME = "alert_summary_creation_timestamp"
LABEL = "bug_created"
BUG_ID = "bug_id"
WEIGHT = "sample_weight"
ROW_ORDER = "seq"

# --- fixed values: columns carried to the summary by first non-null value -----------------
SUMMARY_COLUMNS = [
    "push_timestamp",
    "alert_summary_creation_timestamp",
    "alert_summary_repository",
    "alert_summary_revision",
    "alert_summary_push_id",
    "alert_summary_prev_push_id",
    "alert_summary_prev_push_revision",
    "alert_summary_framework",
    "alert_summary_related_alerts",
    "alert_summary_triage_due_date",
    "alert_summary_notes",
    "alert_summary_performance_tags",
]

# --- fixed values: columns reduced to mean, max, min, std, p90 -----------------------------
NUMERIC_COLUMNS = [
    "single_alert_amount_abs",
    "single_alert_amount_pct",
    "single_alert_prev_value",
    "single_alert_new_value",
]

# --- fixed values: columns reduced to mode and distinct count ------------------------------
CATEGORY_COLUMNS = [
    "single_alert_is_regression",
    "single_alert_manually_created",
    "single_alert_noise_profile",
    "single_alert_backfill_record_status",
    "single_alert_backfill_record_context",
    "single_alert_series_signature_suite",
    "single_alert_series_signature_test",
    "single_alert_series_signature_machine_platform",
    "single_alert_series_signature_measurement_unit",
    "single_alert_series_signature_lower_is_better",
    "single_alert_series_signature_extra_options",
    "single_alert_classifier",
    "single_alert_series_signature_has_subtests",
]

# --- fixed values: extra columns of the older notebook flow --------------------------------
NOTEBOOK_EXTRA_SUMMARY = ["alert_summary_issue_tracker"]
NOTEBOOK_EXTRA_NUMERIC = ["single_alert_t_value"]

# --- fixed values: text-like number columns that need cleaning -----------------------------
DIRTY_NUMBER_COLUMNS = [
    "single_alert_backfill_record_total_backfills_failed",
    "single_alert_backfill_record_total_backfills_successful",
]

# --- fixed values: sample weight by bug priority -------------------------------------------
PRIORITY_WEIGHTS = {
    "P1": 10.0,
    "P2": 5.0,
    "P3": 2.0,
    "--": 1.0,
    "CRITICAL": 10.0,
    "MAJOR": 5.0,
}
DEFAULT_WEIGHT = 1.0
DEFAULT_PRIORITY = "--"
FIRST_GAP_SECONDS = 3600.0

# --- fixed values: columns a model must not see --------------------------------------------
NOT_FEATURES = [
    "bug_id",
    "alert_summary_id",
    "bug_created",
    "alert_summary_notes",
    "push_timestamp",
    "alert_summary_creation_timestamp",
    "sample_weight",
    "seconds_since_last_push",
]
BANNED_FEATURES = [
    "alert_summary_triage_due_date",
    "alert_summary_bug_due_date",
    "alert_summary_bug_updated",
    "alert_summary_creation_timestamp",
    "push_timestamp",
    "alert_summary_push_id",
    "alert_summary_prev_push_id",
    "alert_summary_revision",
    "alert_summary_prev_push_revision",
    "single_alert_series_signature_signature_hash__mode",
    "single_alert_series_signature_option_collection_hash__mode",
    "single_alert_id__min",
    "single_alert_id__max",
    "single_alert_summary_id__mode",
    "alert_summary_issue_tracker",
    "alert_summary_notes",
    "notes_len_chars",
    "notes_len_words",
    "single_alert_classifier__mode",
    "single_alert_classifier__nunique",
]
# Blind mode also hides every statistic of the four magnitude columns and these six.
BLIND_STATISTICS = ["mean", "min", "max", "std", "p90"]
BLIND_EXTRA = [
    "rcd_ctxt_zscore",
    "rcd_ctxt_mean",
    "rcd_ctxt_std",
    "rcd_ctxt_slope",
    "rcd_ctxt_count",
    "n_related_alerts",
]
MISSING_CATEGORY = "MISSING"

# --- fixed values: series windows as (points before, points after, name) -------------------
WINDOW_SCALES = [(5, 5, "short"), (20, 10, "med"), (50, 20, "long")]
WINDOW_METRICS = ["delta", "z", "slope", "std_ratio", "median_shift", "p90_delta"]
SINGLE_SCALE = (20, 10)
SINGLE_SCALE_ROLLUP = [
    "ts_delta_mean_rel",
    "ts_delta_mean",
    "ts_z_pre_post",
    "ts_delta_std",
    "ts_slope_change",
    "ts_n_pre",
    "ts_n_post",
]
SERIES_FILE_SUFFIX = "_timeseries_data.csv"

# --- fixed values: time splits -------------------------------------------------------------
TEST_FRACTION = 0.20
VALIDATION_FRACTION = 0.10
TRAIN_TAIL_START = 0.90

# --- fixed values: text serialisation ------------------------------------------------------
NO_NOTES = "NO_NOTES"
BUG_URL_TOKEN = " BUGZILLA_URL "
BUG_ID_TOKEN = " BUG_ID "
LONG_NUMBER_TOKEN = " LONG_NUM "
FUSED_TEXT_FIELDS = [
    "alert_summary_repository",
    "alert_summary_framework",
    "single_alert_series_signature_suite__mode",
    "single_alert_series_signature_test__mode",
    "single_alert_series_signature_machine_platform__mode",
    "single_alert_noise_profile__mode",
    "n_single_alerts",
    "single_alert_amount_pct__mean",
    "single_alert_amount_pct__max",
    "single_alert_t_value__max",
    "ts_sig_used",
    "ts_sig_missing",
    "ts_delta_mean_rel__mean_over_sigs",
    "ts_delta_mean_rel__max_over_sigs",
    "ts_z_pre_post__max_over_sigs",
    "ts_slope_change__max_over_sigs",
]
TEXT_EXCLUDED_NAMES = [
    "bug_created",
    "bug_id",
    "alert_summary_id",
    "alert_summary_notes",
    "notes_raw",
    "notes_sanitized",
    "fused_text_raw",
    "fused_text_sanitized",
    "fused_text_all",
    "all_text",
]
TEXT_EXCLUDED_PARTS = ["revision", "push_id", "prev_push", "timestamp", "triage_due_date"]
TEXT_EXCLUDED_ENDINGS = ["_id", "bug_number"]
MAX_TEXT_CATEGORIES = 500
N_BINS = 10
CATEGORY_TOKEN_LENGTH = 40
LENGTH_PERCENTS = [50, 75, 80, 90, 95, 97, 99]
LENGTH_LIMITS = [64, 128, 256, 384, 512, 1024]

# --- fixed values: evaluation --------------------------------------------------------------
TOP_KS = [50, 100, 200]
SCORE_THRESHOLD = 0.5
Z_RANGE = (-5.0, 5.0)
SERIES_IMPORTANCE_ROW = "Time Series Aggregated"
HYBRID_SERIES_ROW = "Time Series (Signals)"
HYBRID_NOTES_ROW = "NLP: Human Notes"
N_FOLDS = 5
FOLD_SEED = 42

# --- fixed values: tuned settings of the three model variants ------------------------------
STATIC_MODEL = {
    "iterations": 2000,
    "learning_rate": 0.1112385704826062,
    "depth": 4,
    "min_rows_in_leaf": 64,
    "positive_weight": 1.7323564185678146,
    "max_bins": 128,
    "subsample": 0.9916869406073091,
}
SERIES_MODEL = {
    "iterations": 2000,
    "learning_rate": 0.04885409006852588,
    "depth": 6,
    "min_rows_in_leaf": 62,
    "positive_weight": 1.1894491861597762,
    "max_bins": 128,
    "subsample": 0.8197289074825262,
}
HYBRID_MODEL = {
    "iterations": 2000,
    "learning_rate": 0.04105602915025481,
    "depth": 7,
    "min_rows_in_leaf": 34,
    "positive_weight": 1.0003751949471695,
    "max_bins": 32,
    "subsample": 0.9718798313316739,
}
HYBRID_COMPONENTS = 32
