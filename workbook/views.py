"""Analysis tables derived from the raw test tables, as one SQL text per view.

The same text runs in Spark and, inlined as WITH clauses, in the checking
database. Every view covers its whole base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    # One person per customer, with direct, quasi and sensitive columns.
    "subjects": """
SELECT c.c_custkey AS customer_id, c.c_name AS full_name,
       CAST(18 + (c.c_custkey * 7) % 60 AS INT) AS age,
       r.r_name AS region, n.n_name AS state, c.c_mktsegment AS occupation,
       CAST(100000 + c.c_nationkey * 1000 + c.c_custkey % 50 AS STRING) AS postal_code,
       CAST(o.d AS DATE) AS order_date, c.c_acctbal AS income
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS d FROM orders GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey""",
    # What an attacker may hold: a noisy copy of every subject, plus strangers.
    "subjects_aux": """
SELECT customer_id AS aux_id, CAST(age + customer_id % 3 - 1 AS INT) AS age,
       region, state, occupation, postal_code
FROM subjects
UNION ALL
SELECT 1000000000000 + s.s_suppkey, CAST(18 + (s.s_suppkey * 11) % 60 AS INT), r.r_name, n.n_name,
       CASE s.s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE'
            WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END,
       CAST(100000 + s.s_nationkey * 1000 + s.s_suppkey % 50 AS STRING)
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""",
    # Subjects with every kind of dirt the detectors look for.
    "dirty": """
SELECT * FROM dirty_base UNION ALL SELECT * FROM dirty_base WHERE customer_id % 30 = 0""",
    "dirty_base": """
SELECT customer_id, full_name,
       CASE WHEN customer_id % 9 = 0 THEN NULL ELSE age END AS age,
       CASE WHEN customer_id % 12 = 0 THEN NULL ELSE region END AS region,
       CASE WHEN customer_id % 6 = 0 THEN concat('  ', state, '  ') ELSE state END AS state,
       CASE customer_id % 7 WHEN 1 THEN lower(occupation) WHEN 2 THEN concat(' ', occupation)
            WHEN 3 THEN concat(repeat(' ', 150), lower(occupation)) ELSE occupation END AS occupation,
       CASE WHEN order_date IS NULL THEN NULL
            WHEN customer_id % 97 = 0 THEN 'not-a-date'
            WHEN customer_id % 5 = 1 THEN concat(d, '/', m, '/', y)
            WHEN customer_id % 5 = 2 THEN concat(m, '-', d, '-', y)
            WHEN customer_id % 5 = 3 THEN concat(m, '/', d, '/', substr(y, 3, 2))
            WHEN customer_id % 15 = 4 THEN concat(m, '/', d, '/', y, ' 10:30 AM')
            WHEN customer_id % 15 = 9 THEN concat(y, m, d)
            ELSE concat(y, '-', m, '-', d) END AS order_date,
       CASE WHEN customer_id % 211 = 0 THEN income * 1000 ELSE income END AS income,
       CASE WHEN customer_id % 100 = 0 THEN 'Y' ELSE 'N' END AS flag,
       'generated' AS data_source
FROM (SELECT s.*, CAST(year(order_date) AS STRING) AS y,
             lpad(CAST(month(order_date) AS STRING), 2, '0') AS m,
             lpad(CAST(day(order_date) AS STRING), 2, '0') AS d
      FROM subjects s) p""",
    # Misspelt names beside two categories.
    "names_aux": """
SELECT customer_id AS aux_id,
       CASE customer_id % 4 WHEN 1 THEN concat(substr(full_name, 1, 17), CAST(customer_id % 7 AS STRING))
            WHEN 2 THEN replace(full_name, '#', '') WHEN 3 THEN concat(' ', upper(full_name), 'x') ELSE full_name END AS full_name,
       region, occupation
FROM subjects""",
    # Dates and numbers that are off by some days and some tenths, beside a code.
    "visits_aux": """
SELECT customer_id AS aux_id, income + customer_id % 9 * 11.5 AS income,
       date_add(order_date, CAST(customer_id % 13 AS INT)) AS order_date, postal_code
FROM subjects""",
    # Incomes of which one is so large that all others lie within a thousandth of the range.
    "incomes": """
SELECT customer_id, region, CASE WHEN customer_id = 1 THEN 1e12 ELSE income END AS income FROM subjects""",
    "incomes_aux": """
SELECT customer_id AS aux_id, region, income + customer_id % 10 * 0.25 AS income FROM subjects""",
    # Twenty categories, and a copy in which every sixth value is lost.
    "traits": """
SELECT c_custkey AS customer_id, c_mktsegment AS occupation, n_name AS state, r_name AS region,
       CAST((c_custkey * 8023 + 1 * 104729) % 1000003 % 4 AS STRING) AS t1,
       CAST((c_custkey * 8127 + 2 * 104729) % 1000003 % 4 AS STRING) AS t2,
       CAST((c_custkey * 8231 + 3 * 104729) % 1000003 % 4 AS STRING) AS t3,
       CAST((c_custkey * 8335 + 4 * 104729) % 1000003 % 4 AS STRING) AS t4,
       CAST((c_custkey * 8439 + 5 * 104729) % 1000003 % 4 AS STRING) AS t5,
       CAST((c_custkey * 8543 + 6 * 104729) % 1000003 % 4 AS STRING) AS t6,
       CAST((c_custkey * 8647 + 7 * 104729) % 1000003 % 4 AS STRING) AS t7,
       CAST((c_custkey * 8751 + 8 * 104729) % 1000003 % 4 AS STRING) AS t8,
       CAST((c_custkey * 8855 + 9 * 104729) % 1000003 % 4 AS STRING) AS t9,
       CAST((c_custkey * 8959 + 10 * 104729) % 1000003 % 4 AS STRING) AS t10,
       CAST((c_custkey * 9063 + 11 * 104729) % 1000003 % 4 AS STRING) AS t11,
       CAST((c_custkey * 9167 + 12 * 104729) % 1000003 % 4 AS STRING) AS t12,
       CAST((c_custkey * 9271 + 13 * 104729) % 1000003 % 4 AS STRING) AS t13,
       CAST((c_custkey * 9375 + 14 * 104729) % 1000003 % 4 AS STRING) AS t14,
       CAST((c_custkey * 9479 + 15 * 104729) % 1000003 % 4 AS STRING) AS t15,
       CAST((c_custkey * 9583 + 16 * 104729) % 1000003 % 4 AS STRING) AS t16,
       CAST((c_custkey * 9687 + 17 * 104729) % 1000003 % 4 AS STRING) AS t17
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "traits_aux": """
SELECT customer_id AS aux_id, occupation, state, region,
       CASE WHEN (customer_id + 1) % 6 = 0 THEN 'none' ELSE t1 END AS t1,
       CASE WHEN (customer_id + 2) % 6 = 0 THEN 'none' ELSE t2 END AS t2,
       CASE WHEN (customer_id + 3) % 6 = 0 THEN 'none' ELSE t3 END AS t3,
       CASE WHEN (customer_id + 4) % 6 = 0 THEN 'none' ELSE t4 END AS t4,
       CASE WHEN (customer_id + 5) % 6 = 0 THEN 'none' ELSE t5 END AS t5,
       CASE WHEN (customer_id + 6) % 6 = 0 THEN 'none' ELSE t6 END AS t6,
       CASE WHEN (customer_id + 7) % 6 = 0 THEN 'none' ELSE t7 END AS t7,
       CASE WHEN (customer_id + 8) % 6 = 0 THEN 'none' ELSE t8 END AS t8,
       CASE WHEN (customer_id + 9) % 6 = 0 THEN 'none' ELSE t9 END AS t9,
       CASE WHEN (customer_id + 10) % 6 = 0 THEN 'none' ELSE t10 END AS t10,
       CASE WHEN (customer_id + 11) % 6 = 0 THEN 'none' ELSE t11 END AS t11,
       CASE WHEN (customer_id + 12) % 6 = 0 THEN 'none' ELSE t12 END AS t12,
       CASE WHEN (customer_id + 13) % 6 = 0 THEN 'none' ELSE t13 END AS t13,
       CASE WHEN (customer_id + 14) % 6 = 0 THEN 'none' ELSE t14 END AS t14,
       CASE WHEN (customer_id + 15) % 6 = 0 THEN 'none' ELSE t15 END AS t15,
       CASE WHEN (customer_id + 16) % 6 = 0 THEN 'none' ELSE t16 END AS t16,
       CASE WHEN (customer_id + 17) % 6 = 0 THEN 'none' ELSE t17 END AS t17
FROM traits""",
    # Several formats, values that are no date, and nulls.
    "mixed_dates": """
SELECT customer_id, order_date FROM dirty""",
}

NEEDS = {
    "subjects": [],
    "subjects_aux": ["subjects"],
    "names_aux": ["subjects"],
    "visits_aux": ["subjects"],
    "incomes": ["subjects"],
    "incomes_aux": ["subjects"],
    "traits": [],
    "traits_aux": ["traits"],
    "dirty_base": ["subjects"],
    "dirty": ["subjects", "dirty_base"],
    "mixed_dates": ["subjects", "dirty_base", "dirty"],
}


_OPEN: dict[tuple, DataFrame] = {}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _OPEN:
        _OPEN[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _OPEN[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    for table in ("customer", "nation", "region", "orders", "supplier"):
        raw(spark, sf_dir, table).createOrReplaceTempView(table)
    for needed in [*NEEDS[name], name]:
        spark.sql(VIEWS[needed]).createOrReplaceTempView(needed)
    return spark.table(name)


def with_views(names: list[str], body: str) -> str:
    """SQL text with the needed views inlined in order."""
    ordered: list[str] = []
    for name in names:
        for needed in [*NEEDS[name], name]:
            if needed not in ordered:
                ordered.append(needed)
    clauses = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    return f"WITH {clauses}\n{body}" if clauses else body
