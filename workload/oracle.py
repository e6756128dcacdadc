"""The registry's queries in plain SQL, for DuckDB over the same Parquet tables.

Written from the operators' definitions and not from their code: classes are a UNION ALL, samples are a row number over
the whole class, copies a row number over the key, audits a join.
"""

from __future__ import annotations

from collections.abc import Callable

from sievecraft.spec import CollectionSpec
from workload.registry import ALL_MARKETS, CUT, LATER, SHORT, SMALLER, SPEC, THRESHOLD_0

RAW = """
raw AS (
  SELECT sha256(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)) AS sha256,
         CASE WHEN l_linenumber = 7 THEN NULL
              WHEN l_linenumber = 6 AND l_quantity = 50 THEN 'x'
              ELSE CAST(CAST(l_quantity AS BIGINT) - 1 AS VARCHAR) END AS vt_detection,
         CASE WHEN l_linenumber = 5 AND l_quantity = 50 THEN 'bad'
              ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS vt_scan_date,
         CASE l_returnflag WHEN 'A' THEN ' play.google.com ' WHEN 'N' THEN 'anzhi' END AS markets,
         l_partkey * 1000 + l_suppkey AS apk_size
  FROM lineitem)"""

RAW_COPIES = """
raw AS (
  SELECT sha256(CAST(l_suppkey AS VARCHAR)) AS sha256,
         CAST(CAST(l_quantity AS BIGINT) - 1 AS VARCHAR) AS vt_detection,
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS vt_scan_date,
         CASE l_returnflag WHEN 'A' THEN ' play.google.com ' WHEN 'N' THEN 'anzhi' END AS markets,
         CAST(l_linenumber AS BIGINT) AS apk_size
  FROM lineitem)"""

TYPED = """
typed AS (
  SELECT *, try_cast(vt_detection AS BIGINT) AS det,
         try_strptime(vt_scan_date, '%Y-%m-%d %H:%M:%S') AS scan_ts
  FROM raw)"""

PLAIN = (
    "sha256, vt_detection, vt_scan_date, markets, apk_size, det, strftime(scan_ts, '%Y-%m-%d %H:%M:%S') AS scan_ts"
)


def _play(spec: CollectionSpec) -> str:
    return "trim(markets) = 'play.google.com'" if spec.google_play_only else "markets IS NOT NULL"


def _mal(spec: CollectionSpec) -> str:
    return f"det >= {spec.malware_threshold}"


def _clean(spec: CollectionSpec) -> str:
    return f"(det = 0 AND {_play(spec)})"


def _base(spec: CollectionSpec, mode: str, raw: str = RAW) -> str:
    more = "AND det IS NOT NULL AND markets IS NOT NULL" if mode == "collect" else ""
    return f"""WITH {raw}, {TYPED},
base AS (
  SELECT * FROM typed
  WHERE scan_ts BETWEEN TIMESTAMP '{spec.date_start}' AND TIMESTAMP '{spec.date_end}' {more})"""


def _candidates(spec: CollectionSpec, mode: str, raw: str = RAW) -> str:
    return f"""{_base(spec, mode, raw)},
cand AS (
  SELECT 'malware' AS class, * FROM base WHERE {_mal(spec)}
  UNION ALL
  SELECT 'cleanware' AS class, * FROM base WHERE {_clean(spec)})"""


def _ranked(spec: CollectionSpec, mode: str, raw: str = RAW) -> str:
    content = ", ".join(
        f"coalesce(CAST({c} AS VARCHAR), '~')"
        for c in ("sha256", "apk_size", "vt_detection", "vt_scan_date", "markets")
    )
    return f"""{_candidates(spec, mode, raw)},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY class, sha256 ORDER BY sha256(concat_ws('|', {content}))) - 1 AS copy
  FROM cand),
scored AS (
  SELECT *, sha256(concat('{spec.random_seed}:', sha256,
                          CASE WHEN copy > 0 THEN concat(':', copy) ELSE '' END)) AS score
  FROM numbered),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY score) AS sample_rank FROM scored),
sample AS (
  SELECT * FROM ranked
  WHERE sample_rank <= CASE class WHEN 'malware' THEN {spec.n_malware} ELSE {spec.n_cleanware} END)"""


def _sample(
    spec: CollectionSpec, mode: str = "collect", raw: str = RAW, where: str = "TRUE", columns: str = PLAIN
) -> str:
    return f"{_ranked(spec, mode, raw)} SELECT class, sample_rank, {columns} FROM sample WHERE {where}"


def _distribution(granularity: str, spec: CollectionSpec = SPEC, raw: str = RAW) -> str:
    period = {
        "year": "CAST(year(scan_ts) AS BIGINT)",
        "quarter": "concat(year(scan_ts), '-Q', quarter(scan_ts))",
        "month": "strftime(scan_ts, '%Y-%m')",
    }[granularity]
    return f"""{_base(spec, 'survey', raw)}
SELECT {period} AS period,
       CAST(count(sha256) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE {_mal(spec)}) AS BIGINT) AS malware,
       CAST(count(*) FILTER (WHERE {_clean(spec)}) AS BIGINT) AS cleanware
FROM base GROUP BY 1 ORDER BY 1"""


def _totals(spec: CollectionSpec, mode: str, raw: str = RAW) -> str:
    parts = [
        f"""SELECT '{cls}' AS class, CAST(count(*) AS BIGINT) AS available,
                   coalesce(avg(apk_size), 0.0) AS avg_bytes, CAST({n} AS BIGINT) AS wanted
            FROM base WHERE {condition}"""
        for cls, n, condition in (
            ("malware", spec.n_malware, _mal(spec)),
            ("cleanware", spec.n_cleanware, _clean(spec)),
        )
    ]
    return f"{_base(spec, mode, raw)}, totals AS ({' UNION ALL '.join(parts)})"


_SUMMARY = """class, available, least(wanted, available) AS requested,
       CASE WHEN available > 0 THEN least(100.0, CAST(wanted AS DOUBLE) / available * 100.0) ELSE 0.0 END AS percentage,
       available < wanted AS short"""
_EST = "avg_bytes * least(wanted, available) / 1048576.0"


def _summary(spec: CollectionSpec, mode: str) -> str:
    return f"{_totals(spec, mode)} SELECT {_SUMMARY} FROM totals"


def _pretty(c: str) -> str:
    return f"""CASE WHEN {c} >= 1073741824 THEN format('{{:.2f}} GB', {c} / 1073741824.0)
       WHEN {c} >= 1048576 THEN format('{{:.2f}} MB', {c} / 1048576.0)
       WHEN {c} >= 1024 THEN format('{{:.2f}} KB', {c} / 1024.0)
       ELSE concat({c}, ' bytes') END"""


WANTED = """
wanted AS (
  SELECT CASE WHEN lang = 'en' THEN 'cleanware' ELSE 'malware' END AS class, doc_id AS sample_rank,
         upper(sha256(text)) AS sha256, n_chars AS apk_size
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""

FILES = """
files AS (
  SELECT CASE WHEN lang = 'en' THEN 'cleanware' ELSE 'malware' END AS class, sha256(text) AS sha256,
         sha256(CASE WHEN quality = 0 THEN concat(text, '!') ELSE text END) AS content_sha256
  FROM documents JOIN labels USING (doc_id))"""


def _plan(verify: bool) -> str:
    content = "AND f.content_sha256 = f.sha256" if verify else ""
    return f"""WITH {WANTED}, {FILES},
plan AS (
  SELECT class, sample_rank, sha256, apk_size, concat(class, '/', lower(sha256), '.apk') AS path
  FROM wanted w
  WHERE NOT EXISTS (SELECT 1 FROM files f
                    WHERE f.class = w.class AND f.sha256 = lower(w.sha256) {content}))"""


AUDIT = f"""WITH {WANTED}, {FILES},
w AS (SELECT class, lower(sha256) AS sha256, count(*) AS n FROM wanted GROUP BY ALL),
f AS (SELECT class, sha256, count(*) AS n, bool_and(content_sha256 = sha256) AS good FROM files GROUP BY ALL),
audit AS (
  SELECT coalesce(w.class, f.class) AS class, coalesce(w.sha256, f.sha256) AS sha256,
         CAST(coalesce(w.n, 0) AS BIGINT) AS wanted_rows, CAST(coalesce(f.n, 0) AS BIGINT) AS files,
         CASE WHEN w.n IS NULL THEN 'UNEXPECTED' WHEN f.n IS NULL THEN 'MISSING'
              WHEN f.good THEN 'VERIFIED' ELSE 'HASH_MISMATCH' END AS status
  FROM w FULL OUTER JOIN f ON w.class = f.class AND w.sha256 = f.sha256)"""

ATTEMPTS = """
log AS (
  SELECT sha256(CAST(event_id AS VARCHAR)) AS sha256,
         CASE WHEN user_id % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class,
         1000 + event_id % 7 AS apk_size,
         CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1000 + event_id % 7 END AS n,
         CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 2000 ELSE 1000 + event_id % 7 END AS length,
         event_type <> 'error' AS good
  FROM events),
attempts AS (
  SELECT *, CASE WHEN n = 0 THEN 'NO_BYTES'
                 WHEN length IS NOT NULL AND length <> n THEN 'INCOMPLETE'
                 WHEN good THEN 'VERIFIED' ELSE 'HASH_MISMATCH' END AS outcome
  FROM log)"""

CLASS_ROLLUP = f"""WITH {ATTEMPTS}
SELECT class, CAST(sum(CASE WHEN outcome = 'VERIFIED' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded,
       CAST(sum(CASE WHEN outcome = 'VERIFIED' THEN 0 ELSE 1 END) AS BIGINT) AS failed,
       CAST(sum(CASE WHEN outcome = 'VERIFIED' THEN apk_size ELSE 0 END) AS BIGINT) AS bytes
FROM attempts GROUP BY class"""

RETRIES = """WITH log AS (
  SELECT sha256(CAST(user_id AS VARCHAR)) AS sha256,
         CASE WHEN user_id % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class,
         CASE WHEN event_type = 'signup' THEN 'CANCELLED' WHEN event_type = 'error' THEN 'TIMEOUT'
              WHEN CAST(trunc(value * 100) AS BIGINT) <= 0 THEN 'NO_BYTES'
              WHEN value > 60 THEN 'VERIFIED' ELSE 'HASH_MISMATCH' END AS outcome
  FROM events),
plan AS (
  SELECT sha256(CAST(c_custkey AS VARCHAR)) AS sha256,
         CASE WHEN c_custkey % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class, 1000 + c_custkey AS apk_size
  FROM customer),
counted AS (SELECT class, sha256, outcome, count(*) AS attempts FROM log GROUP BY ALL),
pairs AS (
  SELECT class, sha256, outcome, CAST(coalesce(attempts, 0) AS BIGINT) AS attempts, apk_size,
         apk_size IS NOT NULL AS planned
  FROM counted FULL OUTER JOIN plan USING (class, sha256)),
done AS (
  SELECT class, sha256, coalesce(bool_or(outcome = 'VERIFIED'), FALSE) AS ok, max(apk_size) AS apk_size
  FROM pairs WHERE planned GROUP BY ALL),
rolled AS (
  SELECT coalesce(class, 'total') AS class, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS succeeded,
         CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed,
         CAST(coalesce(sum(apk_size) FILTER (WHERE ok), 0) AS BIGINT) AS bytes
  FROM done GROUP BY ROLLUP (class))"""


REPEATING = RETRIES.replace("sha256(CAST(c_custkey AS VARCHAR)) AS sha256", "CASE WHEN c_custkey % 5 > 0 THEN sha256(CAST(c_custkey % 200 AS VARCHAR)) END AS sha256").split("\ncounted AS")[0] + """
good AS (SELECT DISTINCT class, sha256, TRUE AS ok FROM log WHERE outcome = 'VERIFIED'),
done AS (SELECT plan.class, apk_size, coalesce(ok, FALSE) AS ok FROM plan LEFT JOIN good USING (class, sha256))
SELECT coalesce(class, 'total') AS class, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS succeeded,
       CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed,
       CAST(coalesce(sum(apk_size) FILTER (WHERE ok), 0) AS BIGINT) AS bytes
FROM done GROUP BY ROLLUP (class)"""

OUTCOME_LABELS = """WITH attempts AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class, 1000 + event_id % 7 AS apk_size,
         CASE event_id % 14
           WHEN 0 THEN 'NO_SHA256' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'INTERRUPTED' WHEN 3 THEN 'TIMEOUT'
           WHEN 4 THEN 'REQUEST_ERROR' WHEN 5 THEN 'EXISTS' WHEN 6 THEN 'FILE_ERROR' WHEN 7 THEN 'UNEXPECTED_ERROR'
           WHEN 8 THEN 'NO_BYTES' WHEN 9 THEN 'INCOMPLETE' WHEN 10 THEN 'HASH_MISMATCH' WHEN 11 THEN 'HASH_MISMATCH'
           WHEN 12 THEN 'EXISTS_VERIFIED' ELSE 'VERIFIED' END AS outcome
  FROM events)
SELECT class, outcome, CAST(count(*) AS BIGINT) AS attempts,
       CAST(sum(CASE WHEN outcome IN ('VERIFIED', 'EXISTS', 'EXISTS_VERIFIED') THEN apk_size ELSE 0 END) AS BIGINT) AS bytes
FROM attempts GROUP BY class, outcome"""


RAW_KINDS = """
SELECT sha256(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)) AS sha256,
       concat('org.', CASE WHEN l_linenumber % 5 = 4 THEN '"a",' || chr(10) || ' b' ELSE 'a' END, l_partkey) AS pkg_name,
       CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS BIGINT) - 1 END AS det,
       CASE WHEN l_linenumber % 5 <> 3 THEN l_partkey * 1000 + l_suppkey END AS apk_size,
       CASE l_returnflag WHEN 'A' THEN 'play.google.com' WHEN 'N' THEN 'anzhi' END AS markets
FROM lineitem"""

UNIQUE = f"""{_base(SHORT, 'collect', RAW_COPIES)},
one AS (
  SELECT * FROM base
  QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY sha256(concat_ws('|', sha256, apk_size, vt_detection, vt_scan_date, markets))) = 1),
cand AS (
  SELECT 'malware' AS class, * FROM one WHERE {_mal(SHORT)}
  UNION ALL SELECT 'cleanware' AS class, * FROM one WHERE {_clean(SHORT)}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY sha256(concat('{SHORT.random_seed}:', sha256))) AS sample_rank FROM cand)
SELECT class, sample_rank, {PLAIN} FROM ranked
WHERE sample_rank <= CASE class WHEN 'malware' THEN {SHORT.n_malware} ELSE {SHORT.n_cleanware} END"""

BY_PLACE = """WITH log AS (
  SELECT CAST(('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 3)) AS BIGINT) AS sample_rank,
         CASE WHEN user_id % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class,
         CASE WHEN event_type = 'signup' THEN 'CANCELLED' WHEN event_type = 'error' THEN 'TIMEOUT'
              WHEN CAST(trunc(value * 100) AS BIGINT) <= 0 THEN 'NO_BYTES'
              WHEN value > 60 THEN 'VERIFIED' ELSE 'HASH_MISMATCH' END AS outcome
  FROM events),
plan AS (
  SELECT CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 3000 END AS sample_rank,
         CASE WHEN c_custkey % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class, 1000 + c_custkey AS apk_size
  FROM customer),
a AS (SELECT class, sample_rank, outcome, count(*) AS attempts FROM log GROUP BY ALL),
p AS (
  SELECT class, sample_rank, max(apk_size) AS apk_size, count(*) AS plan_rows, CAST(sum(apk_size) AS BIGINT) AS plan_bytes
  FROM plan GROUP BY ALL)
SELECT class, sample_rank, outcome, CAST(coalesce(attempts, 0) AS BIGINT) AS attempts, apk_size, plan_rows, plan_bytes,
       plan_rows IS NOT NULL AS planned
FROM a FULL OUTER JOIN p USING (class, sample_rank)"""

TREE = """WITH w AS (
  SELECT CASE WHEN lang = 'en' THEN 'cleanware' ELSE 'malware' END AS class, sha256(text || chr(10)) AS sha256,
         count(*) AS n
  FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id) GROUP BY ALL),
f AS (
  SELECT CASE WHEN lang = 'en' THEN 'cleanware' ELSE 'malware' END AS class, sha256(text || chr(10)) AS sha256,
         min(CASE WHEN quality = 0 THEN text || '!' ELSE text END) = min(text) AS good, bool_or(lang = 'de') AS lost
  FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT coalesce(w.class, f.class) AS class, coalesce(w.sha256, f.sha256) AS sha256,
       CAST(coalesce(w.n, 0) AS BIGINT) AS wanted_rows,
       CAST(CASE WHEN f.class IS NULL THEN 0 WHEN f.lost THEN 2 ELSE 1 END AS BIGINT) AS files,
       CASE WHEN w.n IS NULL THEN 'UNEXPECTED' WHEN f.class IS NULL THEN 'MISSING' WHEN NOT f.good THEN 'HASH_MISMATCH'
            WHEN f.lost THEN 'UNREADABLE' ELSE 'VERIFIED' END AS status
FROM w FULL OUTER JOIN f ON w.class = f.class AND w.sha256 = f.sha256"""


def _steps(query: Callable[[str], str]) -> str:
    """A query over the whole catalogue and over what is left of it once a source is replaced."""
    left = RAW.rstrip()[:-1] + " WHERE (l_partkey * 1000 + l_suppkey) % 2 = 0 OR (l_partkey * 1000 + l_suppkey) % 4 = 1)"
    return " UNION ALL ".join(f"SELECT *, '{step}' AS step FROM ({query(raw)})" for step, raw in (("a", RAW), ("b", left)))


def oracle_sql() -> dict[str, str]:
    size_rows = """SELECT class, CAST(sum(apk_size) AS BIGINT) AS bytes FROM sample GROUP BY class
                   UNION ALL SELECT 'total', CAST(sum(apk_size) AS BIGINT) FROM sample"""
    return {
        "dist_year": _distribution("year"),
        "dist_quarter": _distribution("quarter"),
        "dist_month": _distribution("month"),
        "dist_all_markets": _distribution("year", ALL_MARKETS),
        "dist_threshold0": _distribution("year", THRESHOLD_0),
        "summary_survey": _summary(SPEC, "survey"),
        "summary_collect": _summary(SPEC, "collect"),
        "summary_threshold0": _summary(THRESHOLD_0, "survey"),
        "summary_all_markets": _summary(ALL_MARKETS, "survey"),
        "summary_nothing": _summary(LATER, "collect"),
        "shortage": _summary(SHORT, "collect"),
        "size_estimate": f"""{_totals(SPEC, 'survey')}
SELECT class, round(avg_bytes, 4) AS avg_bytes, round({_EST}, 4) AS est_total_mb FROM totals
UNION ALL SELECT 'total', NULL, round(sum({_EST}), 4) FROM totals""",
        "survey_overview": f"""{_totals(SHORT, 'survey')}
SELECT {_SUMMARY}, round(avg_bytes, 4) AS avg_bytes, round({_EST}, 4) AS est_total_mb FROM totals""",
        "base_survey": f"{_base(SPEC, 'survey')} SELECT {PLAIN} FROM base",
        "base_collect": f"{_base(SPEC, 'collect')} SELECT {PLAIN} FROM base",
        "class_flags": f"""{_base(THRESHOLD_0, 'survey')}
SELECT sha256, det, coalesce({_mal(THRESHOLD_0)}, FALSE) AS is_malware,
       coalesce({_clean(THRESHOLD_0)}, FALSE) AS is_cleanware FROM base""",
        "malware_candidates": f"{_base(SPEC, 'collect')} SELECT {PLAIN} FROM base WHERE {_mal(SPEC)}",
        "cleanware_candidates": f"{_base(SPEC, 'collect')} SELECT {PLAIN} FROM base WHERE {_clean(SPEC)}",
        "both_classes": f"""{_candidates(THRESHOLD_0, 'collect')}
SELECT class, CAST(count(*) AS BIGINT) AS n, CAST(sum(apk_size) AS BIGINT) AS bytes FROM cand GROUP BY class""",
        "scalar_columns": f"""WITH {RAW}, {TYPED}
SELECT sha256, det, strftime(scan_ts, '%Y-%m-%d %H:%M:%S') AS scan_text, trim(markets) AS market,
       CAST(year(scan_ts) AS BIGINT) AS period_year,
       CASE WHEN scan_ts IS NOT NULL THEN concat(year(scan_ts), '-Q', quarter(scan_ts)) END AS period_quarter,
       strftime(scan_ts, '%Y-%m') AS period_month,
       {_pretty('apk_size')} AS pretty,
       concat('malware/', sha256, '.apk') AS path,
       trim(markets) = 'play.google.com' AS is_play
FROM typed""",
        "lenient_predicates": f"""WITH {RAW}, {TYPED}
SELECT CAST(count(*) FILTER (WHERE coalesce(vt_detection, '') <> '') AS BIGINT) AS has_detection,
       CAST(count(*) FILTER (WHERE {_mal(SPEC)}) AS BIGINT) AS is_malware,
       CAST(count(*) FILTER (WHERE scan_ts BETWEEN TIMESTAMP '{SPEC.date_start}' AND TIMESTAMP '{SPEC.date_end}')
            AS BIGINT) AS in_range
FROM typed""",
        "parse_edge": f"""WITH {RAW}, {TYPED}
SELECT CAST(count(*) FILTER (WHERE vt_detection IS NOT NULL AND det IS NULL) AS BIGINT) AS bad_detections,
       CAST(count(*) FILTER (WHERE vt_scan_date IS NOT NULL AND scan_ts IS NULL) AS BIGINT) AS bad_dates,
       CAST(count(*) FILTER (WHERE vt_detection IS NULL) AS BIGINT) AS no_detection,
       CAST(count(*) FILTER (WHERE markets IS NULL) AS BIGINT) AS no_market
FROM typed""",
        "sample_malware": _sample(SPEC, where="class = 'malware'"),
        "sample_cleanware": _sample(SPEC, where="class = 'cleanware'"),
        "sample_union": _sample(SPEC),
        "sample_survey": _sample(SPEC, "survey"),
        "sample_take_all": _sample(SHORT),
        "sample_overlap": _sample(THRESHOLD_0),
        "sample_trim": _sample(SMALLER),
        "sample_of_copies": _sample(SHORT, raw=RAW_COPIES),
        "sample_size_pretty": f"""{_ranked(SPEC, 'collect')}
SELECT class, bytes, {_pretty('bytes')} AS pretty FROM ({size_rows})""",
        "work_list": _sample(SPEC, columns="sha256"),
        "fetch_plan": f"{_plan(True)} SELECT class, sample_rank, sha256, apk_size, path FROM plan",
        "fetch_plan_unverified": f"{_plan(False)} SELECT class, sample_rank, sha256, apk_size, path FROM plan",
        "planned_bytes": f"""{_plan(True)}
SELECT class, CAST(count(*) AS BIGINT) AS files, CAST(sum(apk_size) AS BIGINT) AS bytes FROM plan GROUP BY class
UNION ALL SELECT 'total', CAST(count(*) AS BIGINT), CAST(sum(apk_size) AS BIGINT) FROM plan""",
        "file_audit": f"{AUDIT} SELECT class, sha256, wanted_rows, files, status FROM audit",
        "audit_summary": f"""{AUDIT}
SELECT class, status, CAST(count(*) AS BIGINT) AS targets FROM audit GROUP BY ALL""",
        "attempt_outcomes": f"WITH {ATTEMPTS} SELECT class, sha256, outcome FROM attempts",
        "outcome_counts": f"""WITH {ATTEMPTS}
SELECT class, outcome, CAST(count(*) AS BIGINT) AS attempts,
       CAST(sum(CASE WHEN outcome = 'VERIFIED' THEN apk_size ELSE 0 END) AS BIGINT) AS bytes
FROM attempts GROUP BY class, outcome""",
        "class_rollup": CLASS_ROLLUP,
        "paired_outcomes": f"{RETRIES} SELECT class, sha256, outcome, attempts, apk_size, planned FROM pairs",
        "attempt_rollup": f"{RETRIES} SELECT class, succeeded, failed, bytes FROM rolled",
        "run_verdict": f"""{RETRIES}
SELECT succeeded, failed,
       CASE WHEN (SELECT count(*) FROM log WHERE outcome IN ('CANCELLED', 'INTERRUPTED')) > 0 THEN 'STOPPED'
            WHEN succeeded + failed <> (SELECT count(*) FROM plan) THEN 'ERROR' ELSE 'SUCCESS' END AS verdict,
       failed = 0 AS complete
FROM rolled WHERE class = 'total'""",
        "typed_table": _distribution("month"),
        "refresh_twice": """
SELECT 'first' AS step, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem
UNION ALL SELECT 'second', CAST(0 AS BIGINT)
UNION ALL SELECT 'table', CAST(count(*) AS BIGINT) FROM lineitem""",
        "streamed_table": _distribution("year"),
        "stored_sample": _sample(SMALLER),
        "hash_export": f"{_ranked(SPEC, 'collect')} SELECT class, sha256 FROM sample",
        "live_totals": CLASS_ROLLUP,
        "rollup_repeated_keys": REPEATING,
        "live_totals_retries": REPEATING,
        "outcome_labels": OUTCOME_LABELS,
        "survey_bad_date": f"""WITH {RAW}, {TYPED}
SELECT 'as_is' AS step, 'failed' AS result, CAST(0 AS BIGINT) AS n_rows
UNION ALL SELECT 'good_dates', 'rows', CAST(count(*) AS BIGINT) FROM typed
WHERE scan_ts BETWEEN TIMESTAMP '{SPEC.date_start}' AND TIMESTAMP '{SPEC.date_end}'""",
        "stored_sample_by_key": f"""{_candidates(SPEC, 'collect', RAW)},
asked(step, class, w) AS (VALUES
  ('first', 'malware', {SPEC.n_malware}), ('smaller', 'malware', {SMALLER.n_malware}),
  ('unique', 'malware', {SPEC.n_malware}), ('unseeded', 'malware', {SPEC.n_malware}),
  ('first', 'cleanware', {SPEC.n_cleanware}), ('smaller', 'cleanware', {SMALLER.n_cleanware}),
  ('unique', 'cleanware', {SPEC.n_cleanware}), ('unseeded', 'cleanware', {SPEC.n_cleanware})),
there AS (SELECT class, count(*) AS n FROM cand GROUP BY class)
SELECT step, class, CAST(least(w, n) AS BIGINT) AS n FROM asked JOIN there USING (class)
UNION ALL SELECT 'store', 'draws', CAST(3 AS BIGINT)""",
        "store_damaged": _sample(SMALLER),
        "refresh_replaced": f"""WITH {RAW}
SELECT 'a' AS step, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(apk_size) AS BIGINT) AS bytes FROM raw
UNION ALL SELECT step, CAST(count(*) AS BIGINT), CAST(sum(apk_size) AS BIGINT)
FROM raw, (VALUES ('b'), ('compacted')) AS steps(step) WHERE apk_size % 2 = 0 OR apk_size % 4 = 1 GROUP BY step""",
        "refresh_failed": f"""WITH {RAW}
SELECT 'refused' AS step, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(apk_size) AS BIGINT) AS bytes FROM raw""",
        "stream_new_checkpoint": f"""WITH {RAW}
SELECT 'both' AS step, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(apk_size) AS BIGINT) AS bytes FROM raw""",
        "open_by_suffix": f"""WITH {RAW}, {TYPED}
SELECT suffix, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(det) AS BIGINT) AS detections,
       CAST(count(scan_ts) AS BIGINT) AS dates
FROM typed, (VALUES ('csv'), ('parquet')) AS s(suffix) GROUP BY suffix""",
        "columns_by_header": RAW_KINDS,
        "refresh_in_compaction": f"""WITH {RAW}
SELECT 'compacted' AS step, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(apk_size) AS BIGINT) AS bytes
FROM raw WHERE apk_size % 2 = 0
UNION ALL SELECT 'refreshed', CAST(count(*) AS BIGINT), CAST(sum(apk_size) AS BIGINT) FROM raw WHERE apk_size % 4 = 1""",
        "streamed_changes": f"""WITH {RAW}
SELECT 'a' AS step, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(apk_size) AS BIGINT) AS bytes FROM raw
UNION ALL SELECT 'b', CAST(count(*) AS BIGINT), CAST(sum(apk_size) AS BIGINT)
FROM raw WHERE apk_size % 2 = 0 OR apk_size % 4 = 1""",
        "file_tree_unreadable": TREE,
        "paired_by_place": BY_PLACE,
        "sample_one_per_key": UNIQUE,
        "survey_incremental": _steps(lambda raw: f"""{_totals(CUT, 'survey', raw)}
SELECT {_SUMMARY}, round(avg_bytes, 4) AS avg_bytes, round({_EST}, 4) AS est_total_mb FROM totals"""),
        "dist_incremental": _steps(lambda raw: _distribution("month", SPEC, raw)),
        "sample_from_summaries": _steps(lambda raw: _sample(SPEC, raw=raw, columns="sha256, apk_size")),
        "live_verdict_changes": f"""{REPEATING}
UNION ALL SELECT 'changes', CAST(count(*) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
FROM (SELECT DISTINCT class, sha256 FROM plan JOIN good USING (class, sha256))""",
        "file_tree_audit": """WITH w AS (
  SELECT CASE WHEN lang = 'en' THEN 'cleanware' ELSE 'malware' END AS class, sha256(text || chr(10)) AS sha256,
         count(*) AS n
  FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id) GROUP BY ALL),
f AS (
  SELECT CASE WHEN lang = 'en' THEN 'cleanware' ELSE 'malware' END AS class, sha256(text || chr(10)) AS sha256,
         min(CASE WHEN quality = 0 THEN text || '!' ELSE text END) = min(text) AS good
  FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT coalesce(w.class, f.class) AS class, coalesce(w.sha256, f.sha256) AS sha256,
       CAST(coalesce(w.n, 0) AS BIGINT) AS wanted_rows, CAST(f.class IS NOT NULL AS BIGINT) AS files,
       CASE WHEN w.n IS NULL THEN 'UNEXPECTED' WHEN f.class IS NULL THEN 'MISSING'
            WHEN f.good THEN 'VERIFIED' ELSE 'HASH_MISMATCH' END AS status
FROM w FULL OUTER JOIN f ON w.class = f.class AND w.sha256 = f.sha256""",
    }
