"""Fixed values of the scoring model.

Every number, band, word list and policy below has to equal the published
model for the results to agree, so they are stated once, as plain values, and
passed around as ordinary arguments that callers may replace.
"""

# --- Fixed values: re-identification risk -----------------------------------
RISK_WEIGHTS = {
    "linkage_confidence": 0.40,
    "uniqueness": 0.30,
    "equivalence_class_risk": 0.20,
    "sensitive_attribute_exposure": 0.10,
}
# Lower bound of each band; the highest bound not above the score wins.
RISK_BANDS = [(0, "LOW"), (25, "MODERATE"), (50, "HIGH"), (75, "CRITICAL")]
K_VALUES = [2, 3, 5, 10]
REPRESENTATIVE_K = 5

# --- Fixed values: record linkage -------------------------------------------
LINKAGE_WEIGHTS = {
    "categorical": 0.30,
    "numeric": 0.30,
    "text": 0.20,
    "date": 0.20,
}
WEIGHT_KEYS = {
    "categorical": "categorical_exact",
    "numeric": "numeric_closeness",
    "text": "string_similarity",
    "date": "date_closeness",
}
LINKAGE_THRESHOLD = 0.55
LINKAGE_TOP = 3
LINKAGE_LEVELS = [(0.55, "MODERATE"), (0.70, "HIGH"), (0.85, "CRITICAL")]
DATE_HORIZON_DAYS = 730
MATCH_LIST_LIMIT = 500
HEATMAP_MATCHES = 10

# --- Fixed values: dates ----------------------------------------------------
# Text that reads like a date somewhere.
DATE_LIKE = r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"

# --- Fixed values: data quality and ML readiness ----------------------------
SEVERITY_POINTS = {"LOW": 5, "MEDIUM": 15, "HIGH": 30, "CRITICAL": 50}
QUALITY_WEIGHTS = {
    "missing_values": 0.30,
    "duplicate_rows": 0.25,
    "structural_issues": 0.25,
    "outliers": 0.20,
}
QUALITY_BUCKETS = {
    "missing_values": ["missing_values"],
    "duplicate_rows": ["duplicate_rows"],
    "structural_issues": [
        "whitespace", "case_inconsistency", "malformed_dates", "inconsistent_date_format",
        "constant_column", "near_constant_column", "high_cardinality_column",
    ],
    "outliers": ["outliers", "possible_unit_inconsistency"],
}
ML_WEIGHTS = {
    "constant_features": 0.20,
    "duplicate_observations": 0.20,
    "high_cardinality_features": 0.20,
    "sparsity": 0.20,
    "suspicious_correlation": 0.20,
}
ML_BUCKETS = {
    "constant_features": ["constant_feature"],
    "duplicate_observations": ["duplicate_observations"],
    "high_cardinality_features": ["high_cardinality_categorical"],
    "sparsity": ["high_sparsity"],
    "suspicious_correlation": [
        "suspicious_correlation", "possible_target_leakage", "class_imbalance",
        "missing_target_rows", "target_not_found",
    ],
}
CORRELATION_LIMIT = 0.95
IQR_MULTIPLE = 3.0

# --- Fixed values: fix policy -----------------------------------------------
POLICY = {
    "trim_whitespace": "AUTO",
    "standardize_case": "AUTO",
    "standardize_date_format": "AUTO",
    "drop_exact_duplicates": "AUTO",
    "impute_missing_median": "REVIEW",
    "impute_missing_mode": "REVIEW",
    "remove_outliers": "REVIEW",
    "generalization_bucketing": "REVIEW",
    "truncation_generalization": "REVIEW",
    "date_generalization": "REVIEW",
    "generalization": "REVIEW",
    "suppression": "REVIEW",
}
POLICY_DEFAULT = "REVIEW"
# Parameters of the milder variant offered after a rejection.
MILDER = {"truncation_generalization": {"keep_digits": 4}}

# --- Fixed values: column-name terms ----------------------------------------
# A space stands for an optional separator; terms match whole words of the
# normalised column name, ignoring case, and the first match wins.
DIRECT_TERMS = [
    "name", "full name", "email", "phone", "mobile", "ssn", "social security",
    "aadhaar", "aadhar", "patient id", "account id", "national id", "passport",
    "customer id", "user id", "mrn", "credit card", "address",
]
QUASI_TERMS = [
    "age", "gender", "sex", "pin code", "zip", "postal", "occupation", "job",
    "profession", "location", "city", "region", "state", "date", "education",
    "institution", "school", "university", "course", "employer", "marital",
    "ethnicity", "nationality", "dob", "birth",
]
SENSITIVE_TERMS = [
    "disease", "diagnosis", "salary", "income", "financial", "credit score",
    "political", "religion", "religious", "hiv", "mental health", "condition",
    "treatment", "medication", "sexual", "criminal", "arrest", "conviction",
]
# Numeric-looking codes that are never quantities.
CODE_TERMS = ["pin code", "zip", "postal", "phone", "mobile"]
POSTAL_TERMS = ["pincode", "zip", "postal"]
LOW_CARDINALITY = 5
