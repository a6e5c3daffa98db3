"""The same queries as plain SQL, for checking. They follow the definitions step by step, repeated rows included."""

from __future__ import annotations

from recurra.orders.episodes import DURATION_YEAR, SEGMENTS, YEAR

HORIZONS = (1, 2, 3)

_EPISODES = """
episodes AS (
  SELECT o.o_custkey AS custkey,
         CAST(o.o_orderdate AS DATE) AS order_date,
         CAST(l.l_shipdate AS DATE) AS ship_date,
         nullif(o.o_orderpriority, '4-NOT SPECIFIED') AS priority,
         c.c_mktsegment AS segment
  FROM orders o
  JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
)"""

_VALID = _EPISODES + """,
valid AS (SELECT * FROM episodes WHERE ship_date > order_date)"""

_RECORDS = """
records AS (
  SELECT o_custkey AS custkey,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN 'WATCH'
              WHEN c_acctbal >= 5000 THEN 'HIGH' WHEN c_acctbal >= 0 THEN 'LOW' END AS status
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
)"""

# Episodes that end with the month of their ship date.
_MONTHLY = _EPISODES + """,
valid AS (SELECT custkey, order_date, last_day(ship_date) AS ship_date, priority, segment FROM episodes
          WHERE last_day(ship_date) > order_date)"""

_STATUS = _RECORDS + """,
clean_status AS (
  SELECT custkey, min(status) AS status FROM records
  GROUP BY custkey HAVING count(DISTINCT status) + max(CASE WHEN status IS NULL THEN 1 ELSE 0 END) = 1
)"""


def _plus(day: str, n: int) -> str:
    later = f"({day} + INTERVAL {n} YEAR)"
    return f"CASE WHEN day({later}) = day({day}) THEN CAST({later} AS DATE) END"


def _cohort(year: int, valid: str = _VALID, years: int = 1) -> str:
    plus = ",\n         ".join(f"{_plus('f.od', n)} AS original_ship_date_plus_{n}" for n in HORIZONS)
    return f"""{valid},
firsts AS (SELECT custkey, min(ship_date) AS od FROM valid GROUP BY custkey),
cohort AS (
  SELECT v.custkey, v.order_date AS original_order_date, f.od AS original_ship_date,
         {plus}
  FROM valid v JOIN firsts f ON f.custkey = v.custkey AND f.od = v.ship_date
  WHERE year(f.od) BETWEEN {year} AND {year + years - 1}
)"""


_COHORT_COLUMNS = ", ".join(
    ["original_order_date", "original_ship_date"] + [f"original_ship_date_plus_{n}" for n in HORIZONS]
)


_CLASS = """
         CASE WHEN v.order_date <= original_ship_date THEN NULL
              WHEN v.order_date <= original_ship_date_plus_1 THEN 1
              WHEN v.order_date > original_ship_date_plus_1 AND v.order_date <= original_ship_date_plus_2 THEN 2
              WHEN v.order_date > original_ship_date_plus_2 AND v.order_date <= original_ship_date_plus_3 THEN 3
              ELSE 4 END AS years_since_original_release"""


def _classified(year: int = YEAR, years: int = 1) -> str:
    return f"""{_cohort(year, years=years)},
{_STATUS.strip()},
classified AS (
  SELECT v.*, {_COHORT_COLUMNS}, s.status, {_CLASS}
  FROM valid v JOIN cohort k ON k.custkey = v.custkey
  LEFT JOIN clean_status s ON s.custkey = v.custkey
)"""


_FLAGS = ", ".join(
    f"max(CASE WHEN years_since_original_release <= {n} THEN 1 ELSE 0 END) AS recidivism_year_{n}" for n in HORIZONS
)
_RATES = ", ".join(f"avg(recidivism_year_{n}) AS prop_recidivism_year_{n}" for n in HORIZONS)


def _rates(by: str | None = None) -> str:
    keys = "custkey" + (f", {by}" if by else "")
    flags = f"SELECT {keys}, {_FLAGS} FROM classified GROUP BY {keys}"
    return f"SELECT {by}, {_RATES} FROM ({flags}) GROUP BY {by}" if by else f"SELECT {_RATES} FROM ({flags})"


def _long(rates: str, by: str | None, extra: str = "") -> str:
    parts = [
        f"SELECT {by + ', ' if by else ''}'{n}' AS years_since_original_release, "
        f"prop_recidivism_year_{n} AS prop_recidivism FROM rates"
        for n in HORIZONS
    ]
    return f"SELECT *{extra} FROM ({' UNION ALL '.join(parts)})"


_LABEL = ", printf('%.1f%%', round_even(prop_recidivism * 100, 1)) AS label"


def _with_rates(by: str | None) -> str:
    return f"WITH {_classified()}, rates AS ({_rates(by)})"


_LEVELS = ", ".join(f"'{s}'" for s in SEGMENTS)
_LEVEL = f"CASE WHEN {{0}} IN ({_LEVELS}) THEN {{0}} END"
_LEVEL_ORDER = "CAST(CASE {0} " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEGMENTS, 1)) + " END AS INTEGER)"

# Mean length of a month in days, labels and upper ends of the bands.
_MONTHS = "date_diff('day', {0}, {1}) / CAST(30.4375 AS DOUBLE)"
_BAND = "CASE WHEN {0} < 0 THEN NULL WHEN {0} <= 12 THEN 'Less than a year' WHEN {0} <= 24 THEN '1-2 years' WHEN {0} <= 36 THEN '2-3 years' END"
_BAND_ORDER = "CASE WHEN {0} < 0 THEN NULL WHEN {0} <= 12 THEN 1 WHEN {0} <= 24 THEN 2 WHEN {0} <= 36 THEN 3 END"

_CASE_IDS = """
SELECT custkey, order_date, ship_date, {0},
       dense_rank() OVER (ORDER BY custkey NULLS LAST, order_date NULLS LAST, ship_date NULLS LAST) AS case_id
FROM episodes"""

_WEIGHTED = f"SELECT custkey, {_COHORT_COLUMNS}, CAST(count(*) AS BIGINT) AS index_rows FROM cohort GROUP BY ALL"

_MIX = """
SELECT status, priority, CAST(n AS BIGINT) AS n, n / sum(n) OVER (PARTITION BY status) AS prop
FROM (SELECT status, priority, count(*) AS n FROM classified
      WHERE status IS NOT NULL AND ship_date = original_ship_date GROUP BY status, priority)"""

_INDEX_LEVELS = f"""
SELECT priority, {_RATES}
FROM (SELECT DISTINCT custkey, priority FROM classified WHERE ship_date = original_ship_date)
JOIN (SELECT custkey, {_FLAGS} FROM classified GROUP BY custkey) USING (custkey)
GROUP BY priority"""

_DURATION = f"""
SELECT bin_time_incarcerated, bin_time_incarcerated_order, {_RATES}
FROM (SELECT {_BAND.format('m')} AS bin_time_incarcerated, {_BAND_ORDER.format('m')} AS bin_time_incarcerated_order, *
      FROM (SELECT custkey, original_order_date, original_ship_date,
                   {_MONTHS.format('original_order_date', 'original_ship_date')} AS m, {_FLAGS}
            FROM classified GROUP BY custkey, original_order_date, original_ship_date))
GROUP BY bin_time_incarcerated, bin_time_incarcerated_order"""


def _each(*dims: str) -> str:
    parts = [f"SELECT 'all' AS dim, CAST(NULL AS VARCHAR) AS level, * FROM ({_rates()})"]
    parts += [f"SELECT '{d}' AS dim, * RENAME ({d} AS level) FROM ({_rates(d)})" for d in dims]
    return " UNION ALL ".join(parts)


# Orders as records, of which the latest comes first, and the first of every customer.
_FIRST_RECORDS = """
first_records AS (
  SELECT o_custkey AS custkey, o_orderkey AS orderkey, CAST(o_orderdate AS DATE) AS order_date,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN 'WATCH'
              WHEN c_acctbal >= 5000 THEN 'HIGH' WHEN c_acctbal >= 0 THEN 'LOW' END AS status
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) = 1
)"""

_CORRECTED = _EPISODES + f""",
valid AS (SELECT * FROM episodes WHERE ship_date > order_date AND (year(ship_date) <> {YEAR} OR priority IS NOT NULL))"""

_ALL = f"""
SELECT 'rates' AS report, dim, level, NULL::VARCHAR AS other_level, NULL::BIGINT AS n, NULL::DOUBLE AS prop,
       * EXCLUDE (dim, level) FROM ({_each('segment', 'priority', 'status')})
UNION ALL BY NAME
SELECT 'duration' AS report, 'bin_time_incarcerated' AS dim, bin_time_incarcerated AS level,
       * EXCLUDE (bin_time_incarcerated, bin_time_incarcerated_order) FROM ({_DURATION})
UNION ALL BY NAME
SELECT 'mix' AS report, 'status' AS dim, status AS level, priority AS other_level, n, prop FROM ({_MIX})"""

_GAP = "(SELECT 100 * min(gap) FROM (SELECT prop - lag(prop) OVER (ORDER BY prop) AS gap FROM (SELECT DISTINCT prop FROM mix)))"
_AUTOMATIC = "CASE " + " ".join(
    f"WHEN {_GAP} IS NULL OR {_GAP} >= {10.0**-d} * (1 - 1e-9) THEN printf('%.{d}f%%', round_even(prop * 100, {d}))"
    for d in range(4)
) + " ELSE printf('%.4f%%', round_even(prop * 100, 4)) END AS label"


ORACLE = {
    "csv_episode_files": f"WITH {_EPISODES} SELECT * FROM episodes",
    "csv_attribute_file": f"WITH {_RECORDS} SELECT * FROM records",
    "csv_table": f"WITH {_EPISODES} SELECT * FROM episodes",
    "csv_quoted_text": """
SELECT doc_id, '  "' || text || '",' || chr(10) || chr(9) AS text, source FROM documents""",
    "csv_text_table": f"""WITH {_RECORDS}
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (status IS NULL) AS BIGINT) AS missing FROM records""",
    "counted_rejects": """
SELECT CASE o_orderkey % 50 WHEN 3 THEN 'custkey is no bigint' ELSE 'wrong number of fields' END AS reason,
       CAST(count(*) AS BIGINT) AS n
FROM orders WHERE o_orderkey % 50 IN (1, 2, 3) GROUP BY reason""",
    "counted_invalid": f"""WITH {_EPISODES}
SELECT CASE WHEN ship_date < order_date THEN 'end before start' WHEN ship_date = order_date THEN 'zero length'
            ELSE 'missing date' END AS reason, CAST(count(*) AS BIGINT) AS n
FROM episodes WHERE NOT coalesce(ship_date > order_date, FALSE) GROUP BY reason""",
    "csv_rejects": """
SELECT CASE o_orderkey % 50 WHEN 1 THEN o_custkey || ',P,extra' WHEN 2 THEN CAST(o_custkey AS VARCHAR)
            ELSE 'c' || o_custkey || ',P' END AS record,
       CASE o_orderkey % 50 WHEN 3 THEN 'custkey is no bigint' ELSE 'wrong number of fields' END AS reason
FROM orders WHERE o_orderkey % 50 IN (1, 2, 3)""",
    "sorted_rows": f"WITH {_EPISODES} SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS descents FROM episodes",
    "parquet_table": f"WITH {_VALID} SELECT custkey, order_date, ship_date, priority FROM valid",
    "parsed_text_dates": """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber <> 3 THEN CAST(o_orderdate AS DATE) END AS order_date,
       CAST(l_shipdate AS DATE) AS ship_date
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "valid_episodes": f"WITH {_VALID} SELECT * FROM valid",
    "rejected_episodes": f"""WITH {_EPISODES}
SELECT custkey, order_date, ship_date, priority,
       CASE WHEN ship_date < order_date THEN 'end before start' WHEN ship_date = order_date THEN 'zero length'
            ELSE 'missing date' END AS reason
FROM episodes WHERE NOT coalesce(ship_date > order_date, FALSE)""",
    "case_ids": f"WITH {_EPISODES} {_CASE_IDS.format('priority')}",
    "numbered_clean_episodes": f"""WITH {_EPISODES}
SELECT * FROM ({_CASE_IDS.format('priority, segment')}) WHERE ship_date > order_date""",
    "calendar_years": f"""
SELECT orderkey, order_date, CAST(year(order_date) AS INTEGER) AS year,
       {', '.join(f"{_plus('order_date', n)} AS plus_{n}" for n in HORIZONS)}
FROM (SELECT o_orderkey AS orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders)""",
    "duration_bands": f"""WITH {_VALID}
SELECT *, {_BAND.format('months')} AS band, {_BAND_ORDER.format('months')} AS band_order
FROM (SELECT custkey, order_date, ship_date, priority, {_MONTHS.format('order_date', 'ship_date')} AS months FROM valid)""",
    "ordered_segments": f"""
SELECT c_custkey, {_LEVEL.format('c_mktsegment')} AS segment, {_LEVEL_ORDER.format('c_mktsegment')} AS segment_order
FROM customer""",
    "consistent_status": f"WITH {_STATUS} SELECT * FROM clean_status",
    "consistent_return_flag": """
SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem
GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) + max(CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END) = 1""",
    "distinct_priorities": f"""WITH {_EPISODES}
SELECT custkey,
       CAST(count(DISTINCT priority) + max(CASE WHEN priority IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS distinct_values
FROM episodes GROUP BY custkey""",
    "records_with_distinct_status": f"""WITH {_RECORDS}
SELECT records.*, distinct_values
FROM records JOIN (
  SELECT custkey, CAST(count(DISTINCT status) + max(CASE WHEN status IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS distinct_values
  FROM records GROUP BY custkey) USING (custkey)""",
    "first_order_records": f"WITH {_FIRST_RECORDS} SELECT * FROM first_records",
    "first_consistent_records": f"""WITH {_FIRST_RECORDS}, {_STATUS.strip()}
SELECT * FROM first_records WHERE custkey IN (SELECT custkey FROM clean_status)""",
    "cohort_all_ties": f"WITH {_cohort(YEAR)} SELECT * FROM cohort",
    "cohort_weighted": f"WITH {_cohort(YEAR)} {_WEIGHTED}",
    "cohort_one_start": f"""WITH {_cohort(YEAR)}
SELECT * FROM cohort QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY original_order_date) = 1""",
    "cohort_episodes": f"""WITH {_cohort(YEAR)}
SELECT v.*, w.* EXCLUDE (custkey) FROM valid v JOIN ({_WEIGHTED}) w ON w.custkey = v.custkey""",
    "monthly_cohort": f"WITH {_cohort(YEAR, _MONTHLY)} {_WEIGHTED}",
    "monthly_cohort_episodes": f"""WITH {_cohort(YEAR, _MONTHLY)}
SELECT v.*, w.* EXCLUDE (custkey) FROM valid v JOIN ({_WEIGHTED}) w ON w.custkey = v.custkey""",
    "prepared_cohort": f"""WITH {_cohort(YEAR)}, numbered AS ({_CASE_IDS.format('priority, segment')})
SELECT v.*, w.* EXCLUDE (custkey) FROM numbered v JOIN ({_WEIGHTED}) w ON w.custkey = v.custkey
WHERE v.ship_date > v.order_date""",
    "replaced_year_cohort": f"WITH {_cohort(YEAR, _CORRECTED)} {_WEIGHTED}",
    "merged_state_flags": f"WITH {_classified()} SELECT custkey, {_FLAGS} FROM classified GROUP BY custkey",
    "merged_state_cohort": f"WITH {_cohort(YEAR)} {_WEIGHTED}",
    "classified_episodes": f"""WITH {_cohort(YEAR)}, {_STATUS}, weighted AS ({_WEIGHTED})
SELECT v.custkey, order_date, ship_date, priority, {_COHORT_COLUMNS}, index_rows, status, {_CLASS}
FROM valid v JOIN weighted k ON k.custkey = v.custkey
LEFT JOIN clean_status s ON s.custkey = v.custkey""",
    "return_flags": f"WITH {_classified()} SELECT custkey, status, {_FLAGS} FROM classified GROUP BY custkey, status",
    "rates_overall": f"WITH {_classified()} {_rates()}",
    "rates_by_segment": f"WITH {_classified()} {_rates('segment')}",
    "rates_by_priority": f"WITH {_classified()} {_rates('priority')}",
    "rates_by_index_priority": f"WITH {_classified()} {_INDEX_LEVELS}",
    "rates_by_status": f"WITH {_classified()} {_rates('status')}",
    "rates_by_duration": f"WITH {_classified(DURATION_YEAR)} {_DURATION}",
    "rates_by_each": f"WITH {_classified()} {_each('segment', 'priority', 'status')}",
    "rates_by_cohort": f"""WITH {_classified(YEAR - 1, 4)}
SELECT CAST(year(original_ship_date) AS INTEGER) AS cohort, segment, {_RATES}
FROM (SELECT custkey, original_ship_date, segment, {_FLAGS} FROM classified GROUP BY ALL) GROUP BY cohort, segment""",
    "all_reports": f"WITH {_classified(DURATION_YEAR)} {_ALL}",
    "rates_by_priority_long": f"{_with_rates('priority')} {_long('rates', 'priority')}",
    "chart_overall": f"{_with_rates(None)} {_long('rates', None, _LABEL)}",
    "chart_by_segment": f"""{_with_rates('segment')}
SELECT * REPLACE ({_LEVEL.format('segment')} AS segment), {_LEVEL_ORDER.format('segment')} AS segment_order
FROM ({_long('rates', 'segment', _LABEL)})""",
    "chart_by_status": f"""{_with_rates('status')}
SELECT * FROM ({_long('rates', 'status', _LABEL)}) WHERE status IS NOT NULL""",
    "status_priority_mix": f"WITH {_classified()}, mix AS ({_MIX}) SELECT *, {_AUTOMATIC} FROM mix",
    "saved_cohort_rates": f"WITH {_classified()} {_rates('status')}",
    "saved_cohort_mix": f"WITH {_classified()} {_MIX}",
}
