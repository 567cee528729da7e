"""Plain SQL that computes each query's table from the same inputs, written independently of the Spark code.

Statements are generated where the same rule applies to every column of a table.
"""

from __future__ import annotations

from workbook.views import with_views

SUBJECT_COLUMNS = [("customer_id", "numeric"), ("full_name", "text"), ("age", "numeric"), ("region", "text"),
                   ("state", "text"), ("occupation", "text"), ("postal_code", "text"), ("order_date", "temporal"),
                   ("income", "numeric")]
DIRTY_COLUMNS = [("customer_id", "numeric"), ("full_name", "text"), ("age", "numeric"), ("region", "text"),
                 ("state", "text"), ("occupation", "text"), ("order_date", "text"), ("income", "numeric"),
                 ("flag", "text"), ("data_source", "text")]
RESCUED_COLUMNS = [(c, "text" if c == "age" else k) for c, k in DIRTY_COLUMNS]
SUBJECT_QI = "age, region, state, occupation, postal_code"
FULL_QI = "age, region, state, occupation, postal_code, order_date"
DIRTY_QI = "age, region, state, occupation, order_date, flag"
LINES = ("lines AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, "
         "strftime(l_shipdate, '%Y-%m') AS ship_month FROM lineitem)")
LINE_QI = "l_returnflag, l_linestatus, l_quantity, ship_month"


def parsed(c: str) -> str:
    formats = ["%Y-%m-%d", "%Y%m%d", "%m/%d/%y", "%d/%m/%y", "%m/%d/%Y %I:%M %p", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y", "%B %Y"]
    return "coalesce(" + ", ".join(f"try_strptime({c}, '{f}')" for f in formats) + ")"


def stripped(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def as_text(c: str, kind: str) -> str:
    if kind == "numeric":
        return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    return f"CAST({c} AS VARCHAR)"


def stats(view: str, columns: list[tuple[str, str]], name: str = "stats") -> str:
    """CTE with one row per column: every count the detectors use."""
    rows = []
    for i, (c, kind) in enumerate(columns):
        text = kind == "text"
        rows.append(f"""
SELECT {i} AS ordinal, '{c}' AS name, {str(kind == 'numeric').lower()} AS is_numeric, {str(text).lower()} AS is_text,
  {str(kind == 'temporal').lower()} AS is_temporal,
  count(*) AS rows_n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS uniq,
  {f"count(DISTINCT {stripped(c)})" if text else f"count(DISTINCT {c})"} AS uniq_stripped,
  {f"count(DISTINCT lower({stripped(c)}))" if text else f"count(DISTINCT {c})"} AS uniq_folded,
  coalesce(avg(length({as_text(c, kind)})), 0) AS chars,
  {f"count(*) FILTER (WHERE {c} <> {stripped(c)})" if text else "0"} AS padded,
  {rf"count(*) FILTER (WHERE regexp_matches({c}, '\d{{1,4}}[-/]\d{{1,2}}[-/]\d{{1,4}}'))" if text else "0"} AS datelike,
  {f"count({parsed(c)})" if text else "0"} AS parsed,
  {rf"count(DISTINCT CASE WHEN {parsed(c)} IS NOT NULL THEN regexp_replace({c}, '\d', '#', 'g') END)" if text else "0"} AS patterns
FROM {view}""")
    return f"{name} AS (" + "\nUNION ALL".join(rows) + ")"


def profile(source: str = "stats", name: str = "prof") -> str:
    return f"""{name} AS (
SELECT ordinal, name, rows_n AS row_count, missing AS missing_count, round(missing * 100.0e0 / rows_n, 2) AS missing_pct,
  uniq AS unique_count, round(CAST(uniq AS DOUBLE) / rows_n, 4) AS cardinality_ratio, uniq <= 1 AS is_constant,
  round(CAST(uniq AS DOUBLE) / rows_n, 4) > 0.9 AS is_high_cardinality,
  CASE WHEN regexp_matches(replace(name, '_', ' '), '(?i)\\b(pin ?code|zip|postal|phone|mobile)\\b') THEN 'categorical'
       WHEN is_numeric THEN 'numeric' WHEN is_temporal THEN 'datetime' WHEN rows_n = missing THEN 'text'
       WHEN parsed > 0.8e0 * (rows_n - missing) THEN 'datetime'
       WHEN uniq <= greatest(20e0, 0.2e0 * rows_n) AND chars < 25 THEN 'categorical' ELSE 'text' END AS inferred_type
FROM {source})"""


def classified(source: str = "prof", name: str = "cls") -> str:
    direct = "name|full ?name|customer ?id|account ?id|patient ?id|user ?id|email|phone|mobile|address"
    quasi = "age|gender|zip|postal|pin ?code|occupation|location|city|region|state|date"
    sensitive = "income|salary|diagnosis|disease|condition"
    match = lambda terms: rf"regexp_matches(replace(name, '_', ' '), '(?i)\b({terms})\b')"
    return f"""{name} AS (
SELECT *, CASE WHEN {match(direct)} THEN 'direct_identifier' WHEN {match(sensitive)} THEN 'sensitive_attribute'
    WHEN {match(quasi)} THEN 'quasi_identifier'
    WHEN cardinality_ratio > 0.9 AND inferred_type IN ('text', 'numeric') THEN 'possible_direct_identifier'
    WHEN inferred_type = 'categorical' AND cardinality_ratio > 0.001 AND cardinality_ratio < 0.5
      THEN 'possible_quasi_identifier' ELSE 'unclassified' END AS category
FROM {source})"""


CONFIDENCE = """CASE category WHEN 'direct_identifier' THEN CASE WHEN cardinality_ratio > 0.85 THEN 0.95e0 ELSE 0.9e0 END
  WHEN 'sensitive_attribute' THEN 0.85e0 WHEN 'quasi_identifier' THEN 0.8e0
  WHEN 'possible_direct_identifier' THEN 0.55e0 WHEN 'possible_quasi_identifier' THEN 0.45e0 ELSE 0.35e0 END"""


def recommended(source: str = "cls", name: str = "rec") -> str:
    return f"""{name} AS (SELECT * FROM (
SELECT ordinal, name AS "column", CASE
    WHEN inferred_type = 'numeric' AND (name LIKE '%age%' OR cardinality_ratio > 0.05) THEN 'generalization_bucketing'
    WHEN name LIKE '%postal%' OR name LIKE '%zip%' OR name LIKE '%pincode%' THEN 'truncation_generalization'
    WHEN inferred_type = 'datetime' OR name LIKE '%date%' THEN 'date_generalization'
    WHEN inferred_type = 'categorical' AND unique_count <= 5 THEN NULL
    WHEN inferred_type = 'categorical' AND cardinality_ratio > 0.5 THEN 'suppression'
    ELSE 'generalization' END AS action
FROM {source} WHERE category IN ('quasi_identifier', 'possible_quasi_identifier')) WHERE action IS NOT NULL)"""


def duplicates(view: str, columns: list[tuple[str, str]], name: str = "dup") -> str:
    keys = ", ".join(c for c, _ in columns)
    return f"""{name} AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count,
  CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, round(sum(n - 1) * 100.0e0 / sum(n), 2) AS duplicate_pct
FROM (SELECT count(*) AS n FROM {view} GROUP BY {keys}))"""


def numbers(view: str, columns: list[tuple[str, str]], name: str = "num") -> str:
    rows = []
    for i, (c, kind) in enumerate(columns):
        if kind == "numeric":
            rows.append(f"""
SELECT {i} AS ordinal, '{c}' AS name, count(v) AS present, q1, q3, q1 - 3e0 * (q3 - q1) AS low, q3 + 3e0 * (q3 - q1) AS high,
  count(*) FILTER (WHERE v < q1 - 3e0 * (q3 - q1) OR v > q3 + 3e0 * (q3 - q1)) AS outliers,
  count(*) FILTER (WHERE v > 0) AS positives, min(v) FILTER (WHERE v > 0) AS smallest, max(v) FILTER (WHERE v > 0) AS largest
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {view}),
     (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {view})
GROUP BY q1, q3""")
    return f"{name} AS (" + "\nUNION ALL".join(rows) + ")"


def _ladder(value: str, steps: list[tuple[int, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} > {b} THEN '{s}'" for b, s in reversed(steps)) + f" ELSE '{otherwise}' END"


LEVEL = "CASE WHEN score >= 0.85e0 THEN 'CRITICAL' WHEN score >= 0.7e0 THEN 'HIGH' WHEN score >= 0.55e0 THEN 'MODERATE' ELSE 'LOW' END"


def top_matches(views: list[str], scored: str, extra: str = "") -> str:
    """The three best partners of every target from a table of all scores (key_a, key_b, score)."""
    return with_views(views, f"""{extra}, scored AS ({scored}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key_a ORDER BY score DESC, key_b) AS place FROM scored WHERE score >= 0.55e0)
SELECT key_a, key_b, CAST(place AS INTEGER) AS match_rank, round(score, 3) AS match_probability, {LEVEL} AS risk_level
FROM ranked WHERE place <= 3""")


def thousandths(value: str) -> str:
    """Similarity rounded to three digits; missing is 0."""
    return f"coalesce(round(greatest(0e0, {value}), 3), 0e0)"


# Matching blocks ratio of two texts: the longest common run (the earliest in a, then in b), then left and right of it.
RATIOS = """, folded AS (
  SELECT s.customer_id AS key_a, x.aux_id AS key_b, lower(trim(s.full_name)) AS a, lower(trim(x.full_name)) AS b,
         (s.region = x.region)::INT + (s.occupation = x.occupation)::INT AS agreed
  FROM subjects s, names_aux x),
-- Three partners that agree on both categories score at least 0.6 of 0.8, more than one category and a perfect name.
wanted AS (
  SELECT * FROM (SELECT *, count(*) FILTER (agreed = 2) OVER (PARTITION BY key_a) AS full_pairs FROM folded)
  WHERE agreed = 2 OR full_pairs < 3),
texts AS (SELECT a, b, row_number() OVER () AS id FROM (SELECT DISTINCT a, b FROM wanted)),
blocks AS (
  WITH RECURSIVE parts AS (
    SELECT id, a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS n, 0 AS level FROM texts
    UNION ALL
    SELECT id, a, b, CASE WHEN side = 0 THEN alo WHEN side = 1 THEN i + k ELSE 0 END, CASE side WHEN 0 THEN i WHEN 1 THEN ahi ELSE 0 END,
           CASE side WHEN 0 THEN blo WHEN 1 THEN j + k ELSE 0 END, CASE side WHEN 0 THEN j WHEN 1 THEN bhi ELSE 0 END,
           CASE side WHEN 2 THEN k ELSE 0 END, level + 1
    FROM (
      SELECT *, row_number() OVER (PARTITION BY id, alo, blo, ahi, bhi ORDER BY k DESC, i, j) AS r FROM (
        SELECT id, a, b, alo, ahi, blo, bhi, level, d, min(i) AS i, min(j) AS j, count(*) AS k FROM (
          SELECT *, i - j AS d, i - row_number() OVER (PARTITION BY id, alo, blo, ahi, bhi, i - j ORDER BY i) AS run FROM (
            SELECT id, a, b, alo, ahi, blo, bhi, level, i, unnest(range(blo, bhi)) AS j FROM (
              SELECT *, unnest(range(alo, ahi)) AS i FROM parts WHERE ahi > alo AND bhi > blo))
          WHERE a[i] = b[j])
        GROUP BY id, a, b, alo, ahi, blo, bhi, level, d, run)) found,
      (VALUES (0), (1), (2)) sides(side) WHERE r = 1)
  SELECT id, sum(n) AS matched FROM parts GROUP BY id),
ratios AS (
  SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1e0 ELSE 2e0 * matched / (length(a) + length(b)) END AS ratio
  FROM texts JOIN blocks USING (id))"""


DETECTORS = {
    "missing": (1, f"""SELECT 1 AS detector, ordinal, 'missing_values' AS issue_type,
  {_ladder('round(missing * 100.0e0 / rows_n, 2)', [(5, 'MEDIUM'), (20, 'HIGH'), (50, 'CRITICAL')], 'LOW')} AS severity,
  name AS column_names, missing AS affected_rows, 1.0e0 AS confidence, false AS auto_fix_eligible,
  CASE WHEN is_numeric THEN 'impute_missing_median' ELSE 'impute_missing_mode' END AS action FROM stats WHERE missing > 0"""),
    "duplicates": (2, f"""SELECT 2, -1, 'duplicate_rows', {_ladder('duplicate_pct', [(2, 'MEDIUM'), (10, 'HIGH')], 'LOW')},
  '', duplicate_rows, 1.0e0, true, 'drop_exact_duplicates' FROM dup WHERE duplicate_rows > 0"""),
    "whitespace": (3, """SELECT 3 AS detector, ordinal, 'whitespace' AS issue_type, 'LOW' AS severity, name AS column_names,
  padded AS affected_rows, 1.0e0 AS confidence, true AS auto_fix_eligible, 'trim_whitespace' AS action FROM stats WHERE padded > 0"""),
    "case": (4, """SELECT 4 AS detector, ordinal, 'case_inconsistency' AS issue_type, 'LOW' AS severity, name AS column_names,
  rows_n - missing AS affected_rows, 0.85e0 AS confidence, true AS auto_fix_eligible, 'standardize_case' AS action
  FROM stats WHERE is_text AND uniq_folded < uniq_stripped AND uniq_stripped <= greatest(30e0, 0.3e0 * (rows_n - missing))"""),
    "dates": (5, """SELECT 5 AS detector, ordinal,
  CASE WHEN rows_n - missing > parsed THEN 'malformed_dates' ELSE 'inconsistent_date_format' END AS issue_type,
  CASE WHEN round((rows_n - missing - parsed) * 100.0e0 / (rows_n - missing), 2) > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  name AS column_names, CASE WHEN rows_n - missing > parsed THEN rows_n - missing - parsed ELSE rows_n - missing END AS affected_rows,
  CASE WHEN rows_n - missing > parsed THEN 0.8e0 ELSE 0.7e0 END AS confidence,
  rows_n - missing = parsed AS auto_fix_eligible, 'standardize_date_format' AS action
  FROM stats WHERE is_text AND rows_n - missing >= 5 AND datelike >= 0.5e0 * (rows_n - missing)
  AND (rows_n - missing > parsed OR patterns > 1)"""),
    "cardinality": (6, """SELECT * FROM (SELECT 6 AS detector, ordinal, CASE WHEN uniq <= 1 THEN 'constant_column'
    WHEN CAST(uniq AS DOUBLE) / rows_n < 0.02 AND uniq <= 3 THEN 'near_constant_column'
    WHEN CAST(uniq AS DOUBLE) / rows_n > 0.95 AND NOT is_numeric THEN 'high_cardinality_column' END AS issue_type,
  'LOW' AS severity, name AS column_names, rows_n AS affected_rows,
  CASE WHEN uniq <= 1 THEN 1.0e0 WHEN CAST(uniq AS DOUBLE) / rows_n < 0.02 AND uniq <= 3 THEN 0.6e0 ELSE 0.7e0 END AS confidence,
  false AS auto_fix_eligible, CASE WHEN uniq <= 1 THEN 'suppression' ELSE '' END AS action FROM stats) WHERE issue_type IS NOT NULL"""),
    "outliers": (7, """SELECT 7 AS detector, ordinal, 'outliers' AS issue_type,
  CASE WHEN round(outliers * 100.0e0 / present, 2) > 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, name AS column_names,
  outliers AS affected_rows, 0.75e0 AS confidence, false AS auto_fix_eligible, 'remove_outliers' AS action
  FROM num WHERE present >= 10 AND q3 <> q1 AND outliers > 0"""),
    "units": (8, """SELECT 8 AS detector, ordinal, 'possible_unit_inconsistency' AS issue_type, 'LOW' AS severity,
  name AS column_names, positives AS affected_rows, 0.35e0 AS confidence, false AS auto_fix_eligible, '' AS action
  FROM num WHERE positives >= 10 AND largest / smallest > 1000"""),
}
ISSUE_COLUMNS = "issue_type, severity, column_names, CAST(affected_rows AS BIGINT) AS affected_rows, confidence, auto_fix_eligible, action"


def issues(name: str = "iss", sources: dict[str, str] | None = None) -> str:
    text = "\nUNION ALL ".join(sql for _, sql in DETECTORS.values())
    for old, new in (sources or {}).items():
        text = text.replace(f"FROM {old}", f"FROM {new}")
    return f"{name}(detector, ordinal, issue_type, severity, column_names, affected_rows, confidence, auto_fix_eligible, action) AS ({text})"


POINTS = "CASE severity WHEN 'LOW' THEN 5e0 WHEN 'MEDIUM' THEN 15e0 WHEN 'HIGH' THEN 30e0 WHEN 'CRITICAL' THEN 50e0 ELSE 10e0 END * confidence"


def penalties(source: str, label: str, buckets: dict[str, tuple[float, list[str]]], count: str, name: str) -> str:
    sums = ", ".join(
        f"round(least(100e0, coalesce(sum({POINTS}) FILTER (WHERE {label} IN ({', '.join(repr(m) for m in members)})), 0e0)), 2) "
        f"AS {b}_penalty" for b, (_, members) in buckets.items())
    total = " + ".join(f"{w}e0 * {b}_penalty" for b, (w, _) in buckets.items())
    return f"""{name} AS (SELECT *, round(greatest(0e0, least(100e0, 100e0 - ({total}))), 2) AS score
FROM (SELECT {sums}, count(*) AS {count} FROM {source}))"""


QUALITY = {
    "missing_values": (0.30, ["missing_values"]),
    "duplicate_rows": (0.25, ["duplicate_rows"]),
    "structural_issues": (0.25, ["whitespace", "case_inconsistency", "malformed_dates", "inconsistent_date_format",
                                 "constant_column", "near_constant_column", "high_cardinality_column"]),
    "outliers": (0.20, ["outliers", "possible_unit_inconsistency"]),
}
ML = {
    "constant_features": (0.20, ["constant_feature"]),
    "duplicate_observations": (0.20, ["duplicate_observations"]),
    "high_cardinality_features": (0.20, ["high_cardinality_categorical"]),
    "sparsity": (0.20, ["high_sparsity"]),
    "suspicious_correlation": (0.20, ["suspicious_correlation", "possible_target_leakage", "class_imbalance",
                                      "missing_target_rows", "target_not_found"]),
}


def findings(view: str, columns: list[tuple[str, str]], target: str, name: str = "fin", stats_name: str = "stats",
             dup_name: str = "dup") -> str:
    numeric = [c for c, k in columns if k == "numeric"]
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1:]]
    corr = "".join(f"\nUNION ALL SELECT 'suspicious_correlation', 'MEDIUM', '{a},{b}', 0.7e0 "
                   f"FROM (SELECT corr({a}, {b}) AS r FROM {view}) WHERE abs(r) >= 0.95" for a, b in pairs)
    return f"""{name}("check", severity, column_names, confidence) AS (
SELECT 'constant_feature', 'MEDIUM', name, 1.0e0 FROM {stats_name} WHERE uniq <= 1
UNION ALL SELECT 'duplicate_observations', CASE WHEN duplicate_pct > 5 THEN 'MEDIUM' ELSE 'LOW' END, '', 1.0e0
  FROM {dup_name} WHERE duplicate_rows > 0
UNION ALL SELECT 'high_cardinality_categorical', 'LOW', name, 0.8e0 FROM {stats_name} WHERE is_text AND CAST(uniq AS DOUBLE) / rows_n > 0.5
UNION ALL SELECT 'high_sparsity', CASE WHEN p > 40 THEN 'HIGH' ELSE 'MEDIUM' END, '', 1.0e0
  FROM (SELECT round(sum(missing) * 100.0e0 / sum(rows_n), 2) AS p FROM {stats_name}) WHERE p > 20{corr}
UNION ALL SELECT 'missing_target_rows', 'HIGH', '{target}', 1.0e0 FROM (SELECT count(*) - count({target}) AS m FROM {view}) WHERE m > 0
UNION ALL SELECT 'class_imbalance', 'MEDIUM', '{target}', 0.9e0 FROM (
  SELECT count(*) AS classes, max(n) * 1.0e0 / sum(n) AS share FROM (
    SELECT {target}, count(*) AS n FROM {view} WHERE {target} IS NOT NULL GROUP BY {target}))
  WHERE classes <= 20 AND share > 0.9)"""


def band(score: str) -> str:
    return f"CASE WHEN {score} >= 75 THEN 'CRITICAL' WHEN {score} >= 50 THEN 'HIGH' WHEN {score} >= 25 THEN 'MODERATE' ELSE 'LOW' END"


def risk(view: str, qi: str, sensitive: int, columns: int, confidence: str, name: str = "risk") -> str:
    """CTE with the risk row of a table; ``confidence`` is a scalar subquery."""
    return f"""{name} AS (SELECT *, {band('overall_score')} AS risk_level FROM (
SELECT *, round(greatest(0e0, least(100e0, 0.4e0 * linkage_component + 0.3e0 * uniqueness_component
    + 0.2e0 * equivalence_component + 0.1e0 * sensitive_component)), 2) AS overall_score FROM (
SELECT round({confidence} * 100.0e0, 2) AS linkage_component,
  round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) * 100.0e0 / sum(n), 2) AS uniqueness_component,
  round(sum(CASE WHEN n < 5 THEN n ELSE 0 END) * 100.0e0 / sum(n), 2) AS equivalence_component,
  round({sensitive} * 100.0e0 / {columns}, 2) AS sensitive_component,
  CAST(sum(CASE WHEN n < 5 THEN n ELSE 0 END) AS BIGINT) AS at_risk_records, min(n) AS min_class_size
FROM (SELECT count(*) AS n FROM {view} GROUP BY {qi}))))"""


MATCHES = """, spread AS (SELECT CAST(max(age) - min(age) AS DOUBLE) AS span FROM subjects),
pairs AS (SELECT a.customer_id AS key_a, b.aux_id AS key_b,
  round(greatest(0e0, 1e0 - abs(a.age - b.age) / span), 3) AS age, CAST(a.region = b.region AS INT) * 1e0 AS region,
  CAST(a.state = b.state AS INT) * 1e0 AS state, CAST(a.occupation = b.occupation AS INT) * 1e0 AS occupation,
  CAST(a.postal_code = b.postal_code AS INT) * 1e0 AS postal_code
  FROM subjects a CROSS JOIN subjects_aux b CROSS JOIN spread),
scored AS (SELECT *, round((0.3e0 * age + 0.3e0 * region + 0.3e0 * state + 0.3e0 * occupation + 0.3e0 * postal_code) / 1.5e0, 9) AS combined
  FROM pairs),
matches AS (SELECT key_a, key_b, CAST(row_number() OVER (PARTITION BY key_a ORDER BY combined DESC, key_b) AS INT) AS match_rank,
  round(combined, 3) AS match_probability,
  CASE WHEN combined >= 0.85 THEN 'CRITICAL' WHEN combined >= 0.70 THEN 'HIGH' WHEN combined >= 0.55 THEN 'MODERATE' ELSE 'LOW' END AS risk_level,
  age, region, state, occupation, postal_code
  FROM scored WHERE combined >= 0.55 QUALIFY match_rank <= 3)
"""
ATTRIBUTES = [("age", "numeric"), ("region", "categorical"), ("state", "categorical"),
              ("occupation", "categorical"), ("postal_code", "categorical")]
MITIGATED = """, top_state AS (SELECT state AS kept FROM subjects GROUP BY state ORDER BY count(*) DESC, state LIMIT 5),
mitigated AS (SELECT customer_id, full_name,
  concat(CAST(floor(age / 5.0) * 5 AS INT), '-', CAST(floor(age / 5.0) * 5 + 4 AS INT)) AS age, region,
  CASE WHEN state IN (SELECT kept FROM top_state) THEN state ELSE 'Other' END AS state, occupation,
  concat(substr(postal_code, 1, 3), repeat('*', greatest(0, length(postal_code) - 3))) AS postal_code,
  strftime(order_date, '%B %Y') AS order_date, income FROM subjects)
"""
CLEANED = r""", cleaned AS (SELECT DISTINCT customer_id, full_name, age, region, trim(state) AS state,
  concat(upper(substr(trim(occupation), 1, 1)), lower(substr(trim(occupation), 2))) AS occupation,
  order_date, income, flag, data_source FROM dirty)
"""
RESCUED = f""", top_state AS (SELECT state AS kept FROM cleaned GROUP BY state ORDER BY count(*) DESC, state LIMIT 5),
top_occupation AS (SELECT occupation AS kept FROM cleaned GROUP BY occupation ORDER BY count(*) DESC, occupation LIMIT 5),
rescued AS (SELECT customer_id, full_name,
  concat(CAST(floor(age / 5.0) * 5 AS INT), '-', CAST(floor(age / 5.0) * 5 + 4 AS INT)) AS age_band, age AS raw_age, region,
  CASE WHEN state IN (SELECT kept FROM top_state) THEN state ELSE 'Other' END AS state,
  CASE WHEN occupation IN (SELECT kept FROM top_occupation) THEN occupation ELSE 'Other' END AS occupation,
  strftime({parsed('order_date')}, '%B %Y') AS order_date, income, flag, data_source FROM cleaned),
final AS (SELECT customer_id, full_name, CASE WHEN raw_age IS NULL THEN NULL ELSE age_band END AS age, region, state,
  occupation, order_date, income, flag, data_source FROM rescued)
"""


def chance(label: str, buckets: int | str = 10000) -> str:
    return f"(CAST(concat('0x', substr(md5(concat('{label}:', CAST(customer_id AS VARCHAR))), 1, 8)) AS BIGINT) % {buckets})"


def _auxiliary(columns: list[str]) -> str:
    """Known rows, and strangers that take each value from an evenly drawn row."""
    wide = lambda label: f"CAST(concat('0x', substr(md5(concat('{label}:', CAST(customer_id AS VARCHAR))), 1, 15)) AS BIGINT)"
    numbered = ",\n".join(f"""rows_{c} AS (SELECT {c}, row_number() OVER (ORDER BY {chance('order', 4096)}, customer_id) - 1 AS r
  FROM subjects WHERE {c} IS NOT NULL)""" for c in columns)
    drawn = " ".join(f"JOIN rows_{c} ON rows_{c}.r = {wide(c)} % (SELECT count(*) FROM rows_{c})" for c in columns)
    return with_views(["subjects"], f""", {numbered},
ages AS (SELECT min(age) AS low, max(age) - min(age) + 1 AS width FROM subjects)
SELECT customer_id, CAST(age + CASE {chance('jitter', 4)} WHEN 0 THEN -1 WHEN 3 THEN 1 ELSE 0 END AS INT) AS age,
  {', '.join(columns)} FROM subjects WHERE {chance('coverage')} < 7000
UNION ALL
SELECT customer_id + 1000000000000, CAST(low + {chance('noise_value', 'width')} AS INT), {', '.join(f'rows_{c}.{c}' for c in columns)}
FROM subjects CROSS JOIN ages {drawn} WHERE {chance('noise')} < 2000""")


def similarity_to_rows() -> str:
    return "\nUNION ALL ".join(
        f"SELECT key_a, key_b, '{a}' AS attribute, '{k}' AS kind, {a} AS score, CASE WHEN {a} >= 0.85 THEN 'strong' "
        f"WHEN {a} >= 0.5 THEN 'partial' ELSE 'weak' END AS strength FROM matches" for a, k in ATTRIBUTES)


def _measured(view: str, columns: list[tuple[str, str]], tag: str) -> str:
    """CTEs that assess one version of the dirty table; names end in ``tag``."""
    s, d, n, i, f = f"stats{tag}", f"dup{tag}", f"num{tag}", f"iss{tag}", f"fin{tag}"
    return ", ".join([
        stats(view, columns, s), duplicates(view, columns, d), numbers(view, columns, n),
        issues(i, {"stats": s, "dup": d, "num": n}), penalties(i, "issue_type", QUALITY, "issue_count", f"q{tag}"),
        findings(view, columns, "flag", f, s, d), penalties(f, '"check"', ML, "finding_count", f"m{tag}"),
        profile(s, f"prof{tag}"), classified(f"prof{tag}", f"cls{tag}"),
        risk(view, DIRTY_QI, 1, 10, "0e0", f"risk{tag}"),
        f"""health{tag} AS (SELECT q.score AS quality_score, m.score AS ml_readiness_score,
  r.overall_score AS privacy_risk_score, r.risk_level AS privacy_risk_level, round(100e0 - r.overall_score, 2) AS privacy_score,
  round((q.score + round(100e0 - r.overall_score, 2) + m.score) / 3e0, 2) AS data_health
  FROM q{tag} q, m{tag} m, risk{tag} r)"""])


def _utility(before: str, after: str) -> str:
    return f"""SELECT round(max(a.rows_n) * 100.0e0 / max(b.rows_n), 2) AS row_retention_pct,
  round(count(a.uniq) * 100.0e0 / count(*), 2) AS column_retention_pct,
  round(avg(CASE WHEN b.uniq > 0 THEN least(1e0, a.uniq * 1e0 / b.uniq) END) * 100e0, 2) AS avg_cardinality_retention_pct
FROM {before} b LEFT JOIN {after} a ON a.name = b.name"""


def _text(v: str) -> str:
    return f"CAST({v} AS VARCHAR)"


def _report(parts: list[tuple[str, str, str, str]]) -> str:
    """``(section, metric, value, source)`` rows as one long table."""
    return "\nUNION ALL ".join(f"SELECT '{s}' AS section, '{m}' AS metric, {_text(v)} AS value FROM {t}"
                               for s, m, v, t in parts)


def _privacy_report(with_recommendations: bool) -> str:
    conf = "(SELECT coalesce(max(match_probability), 0e0) FROM matches)"
    parts = [
        ("summary", "dataset", "'subjects'", "one"), ("summary", "rows", "(SELECT count(*) FROM subjects)", "one"),
        ("summary", "columns", "(SELECT count(*) FROM stats)", "one"),
        ("summary", "overall_risk_score", "overall_score", "risk"),
        ("summary", "overall_risk_level", "risk_level", "risk"),
        *[("findings", label, f"(SELECT string_agg(name, ',' ORDER BY ordinal) FROM cls WHERE category LIKE '%{cat}')", "one")
          for label, cat in (("direct_identifiers", "direct_identifier"), ("quasi_identifiers", "quasi_identifier"),
                             ("sensitive_attributes", "sensitive_attribute"))],
        ("findings", "min_class_size", "min_class_size", "risk"),
        ("findings", "unique_records_pct", "uniqueness_component", "risk"),
        ("risk_breakdown", "linkage_confidence", "linkage_component", "risk"),
        ("risk_breakdown", "uniqueness", "uniqueness_component", "risk"),
        ("risk_breakdown", "equivalence_class_risk", "equivalence_component", "risk"),
        ("risk_breakdown", "sensitive_attribute_exposure", "sensitive_component", "risk"),
        ("attack", "shared_columns", "'age,region,state,occupation,postal_code'", "one"),
        ("attack", "candidates_tested", "(SELECT count(*) FROM subjects) * (SELECT count(*) FROM subjects_aux)", "one"),
        ("attack", "matches_found", "(SELECT count(*) FROM matches)", "one"),
        ("attack", "highest_confidence", conf, "one"),
    ]
    body = _report(parts)
    if with_recommendations:
        body += """\nUNION ALL SELECT 'recommendations', "column", action FROM rec"""
    else:
        body += f"""\nUNION ALL SELECT 'k_anonymity', concat('at_risk_records k=', k),
  CAST(CAST(sum(CASE WHEN n < k THEN n ELSE 0 END) AS BIGINT) AS VARCHAR)
  FROM (SELECT count(*) AS n FROM subjects GROUP BY {FULL_QI}), (VALUES (2), (3), (5), (10)) AS v(k) GROUP BY k
UNION ALL SELECT 'columns', name, category FROM cls"""
        for metric, value in (("min_l", "min(l)"), ("classes_with_l1", "sum(CASE WHEN l = 1 THEN 1 ELSE 0 END)"),
                              ("records_at_risk", "sum(CASE WHEN l = 1 THEN n ELSE 0 END)")):
            body += f"""\nUNION ALL SELECT 'l_diversity', 'income {metric}', CAST(CAST({value} AS BIGINT) AS VARCHAR)
  FROM (SELECT count(DISTINCT coalesce(CAST(income AS VARCHAR), '__MISSING__')) AS l, count(*) AS n FROM subjects GROUP BY {FULL_QI})"""
    ctes = ", ".join([stats("subjects", SUBJECT_COLUMNS), profile(), classified(), recommended(),
                      risk("subjects", FULL_QI, 1, 9, conf), "one AS (SELECT 1 AS x)"])
    return with_views(["subjects_aux"], MATCHES + ", " + ctes + "\n" + body)


def _rescue(body: str) -> str:
    return with_views(["dirty"], CLEANED + RESCUED + ", " + _measured("dirty", DIRTY_COLUMNS, "_b") + ", "
                      + _measured("final", RESCUED_COLUMNS, "_a") + ", one AS (SELECT 1 AS x)\n" + body)


VERIFIED = """SELECT a.data_health >= b.data_health AS passed, b.data_health AS health_before,
  CASE WHEN a.data_health >= b.data_health THEN a.data_health ELSE b.data_health END AS health_after,
  round(greatest(0e0, least(100e0, (CASE WHEN a.data_health >= b.data_health THEN a.data_health ELSE b.data_health END
    - b.data_health) * 100e0 / (100e0 - b.data_health))), 2) AS rescue_score FROM health_a a, health_b b"""

PLAN = """plan AS (SELECT CAST(row_number() OVER (ORDER BY part, detector, ordinal) AS INT) AS seq, * FROM (
  SELECT 0 AS part, detector, ordinal, 'quality' AS source, action AS action_type, column_names AS "column", 'AUTO' AS policy
  FROM iss_b WHERE auto_fix_eligible AND action <> ''
  UNION ALL SELECT 1, 0, ordinal, 'privacy', action, "column", 'REVIEW' FROM rec, risk_b WHERE risk_level <> 'LOW'))"""


def _decided() -> str:
    """Actions of the subjects' plan under attack with their status after the decisions, milder forms included."""
    names = {"stats": "stats_b", "dup": "dup_b", "num": "num_b"}
    conf = "(SELECT max(match_probability) FROM matches)"
    ctes = [stats("subjects", SUBJECT_COLUMNS, "stats_b"), duplicates("subjects", SUBJECT_COLUMNS, "dup_b"),
            numbers("subjects", SUBJECT_COLUMNS, "num_b"), issues("iss_b", names), profile("stats_b", "prof_b"), classified("prof_b", "cls_b"),
            recommended("cls_b"), risk("subjects", FULL_QI, 1, 9, conf, "risk_b"), PLAN]
    return with_views(["subjects_aux"], MATCHES + ", " + ", ".join(ctes) + """,
said AS (
  SELECT seq * 2 AS place, concat('plan-a', seq) AS action_id, source, action_type, "column", policy,
         CASE WHEN policy = 'AUTO' OR action_type = 'date_generalization' THEN 'applied'
              WHEN action_type = 'truncation_generalization' THEN 'rejected' ELSE 'timeout' END AS status, '' AS keep_digits FROM plan
  UNION ALL SELECT seq * 2 + 1, concat('plan-a', seq, '-alt'), source, action_type, "column", 'REVIEW', 'applied', '4'
  FROM plan WHERE action_type = 'truncation_generalization')
SELECT CAST(row_number() OVER (ORDER BY place) AS INT) AS seq, action_id, source, action_type, "column", policy, status, keep_digits FROM said""")


def _planned(body: str) -> str:
    return with_views(["dirty"], ", " + _measured("dirty", DIRTY_COLUMNS, "_b") + ", " + recommended("cls_b")
                      + ", " + PLAN + "\n" + body)


def _detector(key: str, view: str = "dirty", columns: list[tuple[str, str]] | None = None) -> str:
    cols = columns or DIRTY_COLUMNS
    return with_views([view], f", {stats(view, cols)}, {numbers(view, cols)}\nSELECT {ISSUE_COLUMNS} FROM ({DETECTORS[key][1]})")


def _rescue_report() -> str:
    metrics = ["quality_score", "ml_readiness_score", "privacy_risk_score", "privacy_risk_level", "data_health"]
    final = "(SELECT * FROM health_a WHERE (SELECT passed FROM verified) UNION ALL SELECT * FROM health_b WHERE NOT (SELECT passed FROM verified))"
    parts = [
        ("summary", "plan", "'plan'", "one"), ("summary", "data_health_before", "health_before", "verified"),
        ("summary", "data_health_after", "health_after", "verified"),
        ("summary", "rescue_score", "rescue_score", "verified"),
        ("summary", "verification_passed", "passed", "verified"),
        ("decisions", "total_proposed", "(SELECT count(*) FROM plan)", "one"),
        ("decisions", "applied", "(SELECT count(*) FROM plan)", "one"),
        *[("before", m, m, "health_b") for m in metrics], *[("after", m, m, final) for m in metrics],
        *[("privacy_assessment", f"risk_{m}_{when}", f"privacy_risk_{m}", frame)
          for m in ("score", "level") for when, frame in (("before", "health_b"), ("after", final))],
        *[("utility", m, m, "used") for m in ("row_retention_pct", "column_retention_pct", "avg_cardinality_retention_pct")],
    ]
    body = _report(parts) + """\nUNION ALL SELECT 'applied_actions', action_type,
  CASE WHEN "column" = '' THEN 'the dataset' ELSE "column" END FROM plan
UNION ALL SELECT 'problems', issue_type, concat(severity, ': ', CASE WHEN column_names = '' THEN 'the dataset' ELSE column_names END) FROM iss_b"""
    ctes = [CLEANED + RESCUED, ", " + _measured("dirty", DIRTY_COLUMNS, "_b"),
            ", " + _measured("final", RESCUED_COLUMNS, "_a"), ", one AS (SELECT 1 AS x)",
            ", " + recommended("cls_b"), ", " + PLAN, f", verified AS ({VERIFIED})",
            f", used AS ({_utility('stats_b', 'stats_a')})"]
    return with_views(["dirty"], "".join(ctes) + "\n" + body)


def _optimize() -> str:
    base = """t AS (SELECT o_orderstatus AS s, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%d') AS d,
  CAST(CAST(floor(o_totalprice / 10000) AS INT) AS VARCHAR) AS l FROM orders),
top2 AS (SELECT p AS kept FROM t GROUP BY p ORDER BY count(*) DESC, p LIMIT 2)"""
    month, year = "strftime(CAST(d AS DATE), '%B %Y')", "strftime(CAST(d AS DATE), '%Y')"
    level = "concat(CAST(floor(CAST(l AS INT) / 5.0) * 5 AS INT), '-', CAST(floor(CAST(l AS INT) / 5.0) * 5 + 4 AS INT))"
    variants = [
        (0, "", "", "s, p, d, l", "d", "d"),
        (1, "order_date", "date_generalization", f"s, p, {month}, l", "d", month),
        (2, "order_date", "date_generalization", f"s, p, {year}, l", "d", year),
        (3, "price_level", "generalization_bucketing", f"s, p, d, {level}", "l", level),
        (4, "order_date", "suppression", "s, p, l", "d", "CAST(NULL AS VARCHAR)"),
        (5, "o_orderpriority", "generalization", "s, CASE WHEN p IN (SELECT kept FROM top2) THEN p ELSE 'Other' END, d, l", "p",
         "CASE WHEN p IN (SELECT kept FROM top2) THEN p ELSE 'Other' END"),
    ]
    rows = "\nUNION ALL ".join(f"""SELECT {i} AS candidate, '{c}' AS "column", '{a}' AS action,
  (SELECT round(sum(CASE WHEN n < 5 THEN n ELSE 0 END) * 100.0e0 / sum(n), 2) FROM (SELECT {keys}, count(*) AS n FROM t GROUP BY ALL)) AS at_risk,
  (SELECT count(DISTINCT {own}) FROM t) AS before_n, (SELECT count(DISTINCT {after}) FROM t) AS after_n"""
                               for i, c, a, keys, own, after in variants)
    return f"""WITH {base}, v AS ({rows}),
e AS (SELECT v.candidate, v."column", v.action, round(greatest(0e0, b.at_risk - v.at_risk), 2) AS risk_reduction_pct,
  greatest(0e0, round((1e0 - v.after_n * 1e0 / v.before_n) * 100e0, 2)) AS utility_loss_pct
  FROM v, (SELECT at_risk FROM v WHERE candidate = 0) b WHERE v.candidate > 0)
SELECT *, round(risk_reduction_pct - utility_loss_pct, 2) AS score,
  round(0.6e0 * risk_reduction_pct - 0.4e0 * utility_loss_pct, 2) AS weighted_score FROM e"""


def _faults() -> str:
    label = {c: chance(c) for c in ("missing_number", "missing_text", "case", "padding", "date", "date_broken", "duplicate")}
    styles = ["%d/%m/%Y", "%m-%d-%Y", "%Y.%m.%d", "%d %b %Y"]
    restyled = "CASE " + chance("date_style", 4) + " " + " ".join(
        f"WHEN {i} THEN strftime(order_date, '{s}')" for i, s in enumerate(styles)) + " END"
    title = "concat(upper(substr(occupation, 1, 1)), lower(substr(occupation, 2)))"
    return with_views(["subjects"], f""", f AS (SELECT customer_id,
  CASE WHEN NOT {label['missing_number']} < 1200 THEN age END AS age,
  CASE WHEN NOT {label['missing_text']} < 800 THEN region END AS region,
  CASE WHEN {label['case']} < 3000 THEN CASE {chance('case_style', 3)} WHEN 0 THEN upper(occupation) WHEN 1 THEN lower(occupation)
    ELSE {title} END ELSE occupation END AS occupation,
  CASE WHEN {label['padding']} < 1500 THEN concat('  ', state, '  ') ELSE state END AS state,
  CASE WHEN {label['date_broken']} < 200 THEN 'not-a-date'
    WHEN {label['date']} < 2000 THEN coalesce({restyled}, CAST(order_date AS VARCHAR))
    ELSE CAST(order_date AS VARCHAR) END AS order_date,
  'generated' AS data_source FROM subjects)
SELECT * FROM f UNION ALL SELECT * FROM f WHERE {label['duplicate']} < 667""")


def _subject(expression: str, column: str, extra: str = "") -> str:
    return with_views(["subjects"], f"{extra}\nSELECT customer_id, {expression} AS {column} FROM subjects")


def statements() -> dict[str, str]:
    line = f"WITH {LINES}, c AS (SELECT {LINE_QI}, count(*) AS class_size FROM lines GROUP BY ALL)\n"
    attack = lambda body: with_views(["subjects_aux"], MATCHES + body)
    match = "key_a, key_b, match_rank, match_probability, risk_level"
    conf = "(SELECT coalesce(max(match_probability), 0e0) FROM matches)"
    risk_columns = ("linkage_component, uniqueness_component, equivalence_component, sensitive_component, overall_score, "
                    "risk_level, at_risk_records, min_class_size")
    dirty_facts = ", ".join([stats("dirty", DIRTY_COLUMNS), duplicates("dirty", DIRTY_COLUMNS), numbers("dirty", DIRTY_COLUMNS)])
    after_conf = """(SELECT coalesce(max(CASE WHEN c >= 0.55 THEN round(c, 3) END), 0e0) FROM (
  SELECT round((0.3e0 * CAST(a.age = CAST(b.age AS VARCHAR) AS INT) + 0.3e0 * CAST(a.region = b.region AS INT)
    + 0.3e0 * CAST(a.state = b.state AS INT) + 0.3e0 * CAST(a.occupation = b.occupation AS INT)
    + 0.3e0 * CAST(a.postal_code = b.postal_code AS INT)) / 1.5e0, 9) AS c FROM mitigated a CROSS JOIN subjects_aux b))"""
    numeric_lines = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = [(a, b) for i, a in enumerate(numeric_lines) for b in numeric_lines[i + 1:]]
    fence = lambda c, t: (
        f"SELECT '{c}' AS \"column\", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 3e0 * (q3 - q1), 6) AS lower, "
        f"round(q3 + 3e0 * (q3 - q1), 6) AS upper FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})")

    sql = {
        "scan_parquet": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem",
        "latest_per_key": """SELECT event_id, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
        "audit_tail": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
        "jobs_latest": """SELECT user_id, event_id, event_type FROM (SELECT * FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) ORDER BY ts DESC, event_id DESC LIMIT 50""",
        "equivalence_classes": line + "SELECT * FROM c",
        "class_size_per_row": f"WITH {LINES}\nSELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY {LINE_QI}) AS class_size FROM lines",
        "uniqueness": line + """SELECT count(*) AS equivalence_classes, CAST(sum(CASE WHEN class_size = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unique_records,
  CAST(sum(class_size) AS BIGINT) AS total_records,
  round(sum(CASE WHEN class_size = 1 THEN 1 ELSE 0 END) * 100.0e0 / sum(class_size), 2) AS unique_pct FROM c""",
        "class_size_distribution": line + """SELECT b AS size_bucket, CAST(coalesce(sum(class_size), 0) AS BIGINT) AS records
FROM (VALUES ('1', 1, 1), ('2-4', 2, 4), ('5-9', 5, 9), ('10-49', 10, 49), ('50+', 50, 1000000000)) AS v(b, lo, hi)
LEFT JOIN c ON class_size BETWEEN lo AND hi GROUP BY b""",
        "k_anonymity": line + """SELECT k, CAST(sum(class_size) AS BIGINT) AS total_records, min(class_size) AS min_class_size,
  CAST(sum(CASE WHEN class_size < k THEN class_size ELSE 0 END) AS BIGINT) AS at_risk_records,
  round(sum(CASE WHEN class_size < k THEN class_size ELSE 0 END) * 100.0e0 / sum(class_size), 2) AS at_risk_pct,
  sum(CASE WHEN class_size < k THEN 1 ELSE 0 END) = 0 AS satisfies_k_anonymity
FROM c, (VALUES (2), (3), (5), (10)) AS v(k) GROUP BY k""",
        "l_diversity": with_views(["subjects"], "\nUNION ALL ".join(
            f"""SELECT '{s}' AS sensitive_column, min(l) AS min_l, CAST(sum(CASE WHEN l = 1 THEN 1 ELSE 0 END) AS BIGINT) AS classes_with_l1,
  CAST(sum(CASE WHEN l = 1 THEN n ELSE 0 END) AS BIGINT) AS records_at_risk, count(*) AS total_classes
FROM (SELECT region, state, occupation, count(DISTINCT coalesce(CAST({s} AS VARCHAR), '__MISSING__')) AS l, count(*) AS n
      FROM subjects GROUP BY ALL)""" for s in ("income", "postal_code"))),
        "vulnerable_clusters": with_views(["subjects"], f""", c AS (SELECT {SUBJECT_QI}, count(*) AS class_size FROM subjects GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY class_size, {SUBJECT_QI}) AS INT) AS cluster_id, class_size, {SUBJECT_QI},
  (SELECT count(*) FROM c WHERE class_size < 5) AS total_vulnerable_clusters,
  CASE WHEN class_size = 1 THEN 'CRITICAL' WHEN class_size < 2.5 THEN 'HIGH' ELSE 'MODERATE' END AS risk_level
FROM c WHERE class_size < 5 ORDER BY class_size, {SUBJECT_QI} LIMIT 100"""),
        "profile_table": with_views(["dirty"], f", {stats('dirty', DIRTY_COLUMNS)}, {duplicates('dirty', DIRTY_COLUMNS)}\n"
                                    "SELECT row_count, CAST((SELECT count(*) FROM stats) AS INT) AS column_count, duplicate_rows, duplicate_pct, "
                                    "CAST((SELECT sum(missing) FROM stats) AS BIGINT) AS total_missing_cells FROM dup"),
        "profile_columns": with_views(["dirty"], f", {stats('dirty', DIRTY_COLUMNS)}, {profile()}\nSELECT * FROM prof"),
        "profile_merged": "\nUNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS missing_count, true AS same_state, true AS within_bound
FROM lineitem""" for c in ("l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")),
        "profile_samples": with_views(["subjects"], "\nUNION ALL ".join(
            f"""SELECT '{c}' AS name, CAST(r AS INT) AS sample_rank, v AS value FROM (SELECT v, row_number() OVER (ORDER BY v) AS r FROM (
  SELECT DISTINCT {as_text(c, k)} AS v FROM subjects WHERE {c} IS NOT NULL)) WHERE r <= 5""" for c, k in SUBJECT_COLUMNS)),
        "classify_columns": with_views(["dirty"], f", {stats('dirty', DIRTY_COLUMNS)}, {profile()}, {classified()}\n"
                                       f'SELECT ordinal, name AS "column", category, {CONFIDENCE} AS confidence FROM cls'),
        "duplicate_rows": with_views(["dirty"], f", {duplicates('dirty', DIRTY_COLUMNS)}\nSELECT * FROM dup"),
        "duplicate_flags": "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents",
        "topn_values": "SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 5",
        "class_balance": """SELECT quality AS label, count(*) AS records,
  round(count(*) * 1.0e0 / (SELECT count(quality) FROM labels), 6) AS share FROM labels WHERE quality IS NOT NULL GROUP BY quality""",
        "iqr_fences": "\nUNION ALL ".join([*[fence(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
                                            fence("value", "events")]),
        "correlation_pairs": "\nUNION ALL ".join(
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in pairs),
        "numeric_similarity": """SELECT l_orderkey, l_linenumber,
  greatest(0e0, 1e0 - abs(l_extendedprice / l_quantity - p_retailprice) / 2000e0) AS score
FROM lineitem JOIN part ON l_partkey = p_partkey""",
        "date_similarity": """SELECT l_orderkey, l_linenumber,
  round(greatest(0e0, 1e0 - abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) / 730e0), 6) AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "string_similarity": """SELECT p_partkey, round(1e0 - levenshtein(lower(trim(p_name)), lower(trim(p_type))) * 1e0
  / greatest(length(trim(p_name)), length(trim(p_type))), 6) AS score FROM part""",
        "linkage_matches": attack(f"SELECT {match} FROM matches"),
        "linkage_top": attack(f"SELECT {match} FROM matches ORDER BY match_probability DESC, key_a, key_b LIMIT 500"),
        "linkage_summary": attack("""SELECT 'age,region,state,occupation,postal_code' AS shared_columns,
  (SELECT count(*) FROM subjects) * (SELECT count(*) FROM subjects_aux) AS candidates_tested, count(*) AS matches_found,
  coalesce(max(match_probability), 0e0) AS highest_confidence, (SELECT count(*) FROM subjects) AS target_rows_total,
  (SELECT count(*) FROM subjects) AS target_rows_tested, (SELECT count(*) FROM subjects_aux) AS auxiliary_rows_total,
  (SELECT count(*) FROM subjects_aux) AS auxiliary_rows_tested, false AS was_truncated FROM matches"""),
        "linkage_coverage": with_views(["subjects_aux"], """SELECT a AS target_rows_total, a AS target_rows_tested, b AS auxiliary_rows_total,
  b AS auxiliary_rows_tested, false AS was_truncated FROM (SELECT count(*) AS a FROM subjects), (SELECT count(*) AS b FROM subjects_aux)"""),
        "explain_matches": attack(similarity_to_rows()),
        "match_attribute_matrix": attack("""SELECT key_a, key_b, match_probability, age, region, state, occupation, postal_code
FROM matches ORDER BY match_probability DESC, key_a, key_b LIMIT 10"""),
        "linkage_text": top_matches(["subjects", "names_aux"], f"""SELECT key_a, key_b,
  round((0.3e0 * agreed + 0.2e0 * {thousandths('ratio')}) / 0.8e0, 9) AS score FROM wanted LEFT JOIN ratios USING (a, b)""", RATIOS),
        "linkage_dates_numbers": top_matches(["subjects", "visits_aux"], f"""SELECT s.customer_id AS key_a, x.aux_id AS key_b,
  round((0.3e0 * coalesce((s.postal_code = x.postal_code)::INT, 0)
    + 0.3e0 * {thousandths("1e0 - abs(s.income - x.income) / (SELECT max(income) - min(income) FROM subjects)")}
    + 0.2e0 * {thousandths("1e0 - abs(date_diff('day', CAST(s.order_date AS DATE), CAST(x.order_date AS DATE))) / 730e0")}) / 0.8e0, 9) AS score
  FROM subjects s, visits_aux x"""),
        "linkage_crowded": top_matches(["incomes", "incomes_aux"], f"""SELECT s.customer_id AS key_a, x.aux_id AS key_b,
  round((0.3e0 * (s.region = x.region)::INT
    + 0.3e0 * {thousandths("1e0 - abs(s.income - x.income) / (SELECT max(income) - min(income) FROM incomes)")}) / 0.6e0, 9) AS score
  FROM incomes s, incomes_aux x"""),
        "linkage_wide": top_matches(["traits", "traits_aux"], f"""SELECT s.customer_id AS key_a, x.aux_id AS key_b,
  round(({' + '.join(f'(s.{c} = x.{c})::INT' for c in ['occupation', 'state', 'region', *[f't{k}' for k in range(1, 18)]])}) / 20e0, 9) AS score
  FROM traits s, traits_aux x"""),
        "linkage_precision_recall": attack(""", s AS (SELECT (SELECT count(*) FROM matches) AS predicted, (SELECT count(*) FROM subjects) AS actual,
  (SELECT count(*) FROM matches WHERE key_a = key_b) AS true_positives),
r AS (SELECT *, true_positives * 1e0 / predicted AS p, true_positives * 1e0 / actual AS q FROM s)
SELECT predicted, actual, true_positives, round(p, 3) AS precision, round(q, 3) AS recall, round(2e0 * p * q / (p + q), 3) AS f1 FROM r"""),
        "linkable_overlap": with_views(["subjects_aux"], """SELECT count(*) AS linkable_records FROM subjects a WHERE EXISTS (
  SELECT 1 FROM subjects_aux b WHERE b.age BETWEEN a.age - 1 AND a.age + 1 AND a.region = b.region AND a.state = b.state
  AND a.occupation = b.occupation AND a.postal_code = b.postal_code)"""),
        "mitigate_suppress": with_views(["subjects"], """SELECT customer_id, age, region, state, occupation, postal_code,
  CAST(order_date AS VARCHAR) AS order_date, income FROM subjects"""),
        "mitigate_age_band": _subject("concat(CAST(floor(age / 5.0) * 5 AS INT), '-', CAST(floor(age / 5.0) * 5 + 4 AS INT))", "age"),
        "mitigate_bucket": _subject("concat(CAST(floor(income / 10000) * 10000 AS BIGINT), '-', CAST(floor(income / 10000) * 10000 + 10000 AS BIGINT))", "income"),
        "mitigate_truncate": _subject("concat(substr(postal_code, 1, 3), repeat('*', length(postal_code) - 3))", "postal_code"),
        "mitigate_date_month": _subject("strftime(order_date, '%B %Y')", "order_date"),
        "mitigate_date_quarter": _subject("CAST(year(order_date) AS VARCHAR) || 'Q' || CAST(quarter(order_date) AS VARCHAR)", "order_date"),
        "mitigate_date_year": _subject("strftime(order_date, '%Y')", "order_date"),
        "mitigate_topn_other": _subject("CASE WHEN state IN (SELECT kept FROM top_state) THEN state ELSE 'Other' END", "state",
                                        ", top_state AS (SELECT state AS kept FROM subjects GROUP BY state ORDER BY count(*) DESC, state LIMIT 5)"),
        "recommend_mitigations": with_views(["subjects"], f", {stats('subjects', SUBJECT_COLUMNS)}, {profile()}, {classified()}, {recommended()}\nSELECT * FROM rec"),
        "apply_mitigations": with_views(["subjects"], MITIGATED + "SELECT * FROM mitigated"),
        "optimize_mitigations": _optimize(),
        "derive_auxiliary": _auxiliary(["region", "state", "occupation", "postal_code"]),
        "inject_quality_faults": _faults(),
        "quality_missing": _detector("missing"),
        "quality_whitespace": _detector("whitespace"),
        "case_inconsistency": _detector("case"),
        "malformed_dates": _detector("dates"),
        "date_patterns": _detector("dates", "mixed_dates", [("customer_id", "numeric"), ("order_date", "text")]),
        "quality_cardinality": _detector("cardinality"),
        "quality_outliers": _detector("outliers"),
        "quality_unit_ratio": _detector("units"),
        "quality_issues": with_views(["dirty"], f", {dirty_facts}, {issues()}\nSELECT {ISSUE_COLUMNS} FROM iss"),
        "quality_score": with_views(["dirty"], f", {dirty_facts}, {issues()}, {penalties('iss', 'issue_type', QUALITY, 'issue_count', 'q')}\nSELECT * FROM q"),
        "fix_trim": with_views(["dirty"], f"SELECT customer_id, {stripped('state')} AS state FROM dirty"),
        "fix_case": with_views(["dirty"], "SELECT customer_id, concat(upper(substr(trim(occupation), 1, 1)), lower(substr(trim(occupation), 2))) AS occupation FROM dirty"),
        "fix_date_format": with_views(["dirty"], f"SELECT customer_id, strftime({parsed('order_date')}, '%Y-%m-%d') AS order_date FROM dirty"),
        "fix_drop_duplicates": with_views(["dirty"], "SELECT DISTINCT * FROM dirty"),
        "fix_impute_median": with_views(["dirty"], "SELECT customer_id, coalesce(CAST(age AS DOUBLE), (SELECT median(age) FROM dirty)) AS age FROM dirty"),
        "fix_impute_mode": with_views(["dirty"], """SELECT customer_id, coalesce(region, (SELECT region FROM dirty WHERE region IS NOT NULL
  GROUP BY region ORDER BY count(*) DESC, region LIMIT 1)) AS region FROM dirty"""),
        "fix_remove_outliers": with_views(["dirty"], f", {numbers('dirty', [('income', 'numeric')])}\n"
                                          "SELECT customer_id, income FROM dirty, num WHERE income IS NULL OR income BETWEEN low AND high"),
        "utility_retained": with_views(["dirty"], CLEANED + f", {stats('dirty', DIRTY_COLUMNS, 'b')}, {stats('cleaned', DIRTY_COLUMNS, 'a')}\n" + _utility("b", "a")),
        "ml_findings": with_views(["dirty"], f", {dirty_facts}, {findings('dirty', DIRTY_COLUMNS, 'flag')}\nSELECT * FROM fin"),
        "ml_score": with_views(["dirty"], f""", {dirty_facts}, {findings('dirty', DIRTY_COLUMNS, 'flag')}, {penalties('fin', '"check"', ML, 'finding_count', 'm')}\nSELECT * FROM m"""),
        "ml_target_checks": """WITH t AS (SELECT *, quality * 2 + 1 AS agreement FROM labels)
SELECT 'possible_target_leakage' AS "check", 'HIGH' AS severity, c || ',quality' AS column_names, 0.6e0 AS confidence FROM (
  SELECT 'doc_id' AS c, corr(doc_id, quality) AS r FROM t UNION ALL SELECT 'toxic', corr(toxic, quality) FROM t
  UNION ALL SELECT 'agreement', corr(agreement, quality) FROM t) WHERE abs(r) >= 0.95
UNION ALL SELECT 'missing_target_rows', 'HIGH', 'quality', 1.0e0 FROM (SELECT count(*) - count(quality) AS m FROM t) WHERE m > 0
UNION ALL SELECT 'class_imbalance', 'MEDIUM', 'quality', 0.9e0 FROM (SELECT count(*) AS classes, max(n) * 1.0e0 / sum(n) AS share FROM (
  SELECT quality, count(*) AS n FROM t WHERE quality IS NOT NULL GROUP BY quality)) WHERE classes <= 20 AND share > 0.9""",
        "risk_score": attack(", " + risk("subjects", FULL_QI, 1, 9, conf) + f"\nSELECT {risk_columns} FROM risk"),
        "full_analysis": _privacy_report(False),
        "privacy_report": _privacy_report(True),
        "before_after": with_views(["subjects_aux"], MATCHES + MITIGATED + ", " + risk("subjects", FULL_QI, 1, 9, conf, "b") + ", "
                                   + risk("mitigated", FULL_QI, 1, 9, after_conf, "a") + """
SELECT b.overall_score AS risk_score_before, b.risk_level AS risk_level_before, b.at_risk_records AS at_risk_records_before,
  b.min_class_size AS min_class_size_before, a.overall_score AS risk_score_after, a.risk_level AS risk_level_after,
  a.at_risk_records AS at_risk_records_after, a.min_class_size AS min_class_size_after,
  round(b.overall_score - a.overall_score, 2) AS risk_score_delta FROM a, b"""),
        "plan_policy": with_views(["subjects"], f", {stats('subjects', SUBJECT_COLUMNS)}, {profile()}, {classified()}, {recommended()}\n"
                                  'SELECT "column", action AS action_type, \'REVIEW\' AS policy FROM rec'),
        "rescue_plan": _planned("SELECT seq, concat('plan-a', seq) AS action_id, source, action_type, \"column\", policy, 'pending' AS status FROM plan"),
        "data_health": with_views(["dirty"], ", " + _measured("dirty", DIRTY_COLUMNS, "_b") + "\nSELECT * FROM health_b"),
        "rescue_decided": _decided(),
        "rescue_apply": _rescue("SELECT * FROM final"),
        "rescue_score": _rescue(VERIFIED),
        "rescue_report": _rescue_report(),
    }
    # The views' text starts the WITH list; pieces written as ", x AS (...)" continue it.
    return sql
