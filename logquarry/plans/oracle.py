"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from logquarry.operators.detectors import forest
from logquarry.plans import views
from logquarry.plans.queries import (
    AS_OF,
    BURST_AS_OF,
    BURST_THRESHOLD,
    PHRASE,
    RETAINED,
    SINCE,
    SPIKE_AS_OF,
    SPIKE_THRESHOLD,
)


def _text(template: str) -> str:
    return views.in_dialect(template, "duckdb")


_PAD = "lpad({0}::varchar, greatest(12, length({0}::varchar))::int, '0')"
_SEVERITY = "CASE WHEN value < 25 THEN 'low' WHEN value < 75 THEN 'medium' WHEN value < 150 THEN 'high' ELSE 'critical' END"

VIEWS = {
    "logs": f"""
        SELECT 'ev-' || {_PAD.format('event_id')} AS id, ts AS timestamp,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
                    WHEN 'signup' THEN 'info' WHEN 'click' THEN 'info' ELSE 'debug' END AS level,
               {_text(views.SOURCE)} AS source, {_text(views.MESSAGE)} AS message, props AS raw
        FROM events""",
    "doc_logs": f"""
        SELECT 'doc-' || {_PAD.format('doc_id')} AS id,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS timestamp,
               'info' AS level, source, text AS message, NULL::varchar AS raw
        FROM documents""",
    "all_logs": "SELECT * FROM logs UNION ALL SELECT * FROM doc_logs",
    "messages": f"SELECT event_id AS id, {_text(views.RAW_LINE)} AS content FROM events",
    "bodies": f"SELECT event_id, {_text(views.BODY)} AS body FROM events",
    "shaped": f"SELECT event_id, {_text(views.SHAPED)} AS body FROM events",
    "inbox": """
        SELECT id // 100 AS id, to_json(list(content ORDER BY m.id))::varchar AS data, max(ts) AS created_at
        FROM messages m JOIN events ON event_id = m.id GROUP BY 1""",
    "processed": """
        SELECT event_id // 100 AS id, max(ts) AS processed_at FROM events
        GROUP BY 1 HAVING (event_id // 100) % 2 = 0""",
    "alerts": f"""
        SELECT 'al-' || event_id::varchar AS id, 'ev-' || {_PAD.format('event_id')} AS log_id,
               {_SEVERITY} AS severity, 'High error rate detected: ' || {_text(views.SOURCE)} AS message,
               props AS details, ts AS created_at, event_id % 3 = 0 AS acknowledged
        FROM events WHERE event_type = 'error'""",
    "anomalies": f"""
        SELECT 'ev-' || {_PAD.format('event_id')} AS log_id, 'event' AS anomaly_type,
               CASE WHEN value >= 250 THEN 'urgent' ELSE {_SEVERITY} END AS severity,
               CASE event_type WHEN 'error' THEN 'HIGH error rate detected: ' || {_text(views.SOURCE)}
                    WHEN 'purchase' THEN 'Unusual purchase pattern seen for the account of user ' || user_id
                    ELSE event_type || ' by user ' || user_id || '.' END AS message,
               CASE WHEN event_id % 2 = 0 THEN props ELSE '{{}}' END AS details, 0 AS detector_seq
        FROM events""",
    "gateway": """
        SELECT * REPLACE (CASE WHEN message LIKE '%7' THEN source ELSE 'gateway' END AS source) FROM logs""",
}
_NEEDS = {
    "all_logs": ("logs", "doc_logs"),
    "inbox": ("messages",),
    "gateway": ("logs",),
}

_TOKENS = r"' ' || array_to_string(regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}\p{{Co}}]+'), ' ') || ' '"
_WORDS = (
    r"regexp_extract_all(lower(message), '[^\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')"
)

# Mean path of an unsuccessful search among {0} rows, in whole units.
_LENGTH = (
    f"CASE WHEN {{0}} <= 1 THEN 0 WHEN {{0}} = 2 THEN {forest.UNIT} ELSE "
    f"round({forest.UNIT} * (2.0 * (ln({{0}} - 1.0) + {forest.EULER_GAMMA}::double) - 2.0 * ({{0}} - 1.0) / {{0}}))::bigint END"
)

_SQL: dict[str, str] = {}


def _with(names: tuple[str, ...], sql: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    sql = sql.lstrip()
    return f"WITH {ctes},\n{sql[1:]}" if sql.startswith("+") else f"WITH {ctes}\n{sql}"


def _sql(key: str, names: str, sql: str) -> None:
    """Register SQL; a leading ``+`` continues the list of common table expressions."""
    _SQL[key] = _with(tuple(names.split()), sql)


def all_sql() -> dict[str, str]:
    return dict(_SQL)


def _has(column: str, phrase: str) -> str:
    return f"{_TOKENS.format(column)} LIKE '% {phrase} %'"


# --- search -------------------------------------------------------------------------------------

_sql("log_search", "logs", "SELECT * FROM logs WHERE level = 'error' ORDER BY timestamp DESC, id LIMIT 50 OFFSET 10")
_sql(
    "log_search_range",
    "logs",
    f"""SELECT * FROM logs WHERE source = 'svc-3' AND timestamp BETWEEN '{SINCE}' AND '2024-01-20 12:00:00'
        ORDER BY timestamp DESC, id LIMIT 1000""",
)
_sql("log_search_deep", "all_logs", "SELECT * FROM all_logs ORDER BY timestamp DESC, id LIMIT 100 OFFSET 10500")
_sql(
    "log_search_one_instant",
    "all_logs",
    """+ copies AS (SELECT id || '-' || c AS id, TIMESTAMP '2024-01-15 12:00:00.123456' AS timestamp, level, source
                   FROM all_logs, range(10) r(c)),
        ranked AS (SELECT *, row_number() OVER (ORDER BY id) AS place FROM copies)
        SELECT id, timestamp, level, source FROM ranked WHERE place BETWEEN 1201 AND 1250 OR place BETWEEN 9401 AND 9450""",
)
_sql("log_recent", "logs", "SELECT * FROM logs ORDER BY timestamp DESC, id LIMIT 20")
_sql("log_get", "logs", "SELECT * FROM logs WHERE id = 'ev-000000000042'")
_sql("log_fetch_since", "logs", "SELECT * FROM logs WHERE id > 'ev-000000000500' ORDER BY id LIMIT 1000")
_sql(
    "log_fetch_range",
    "logs",
    f"""SELECT * FROM logs WHERE timestamp >= '2024-01-10 00:00:00' AND timestamp <= '{SINCE}'
        ORDER BY timestamp, id""",
)
_sql(
    "log_fetch_recent",
    "logs",
    f"""SELECT * FROM logs WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND timestamp <= '{AS_OF}'
        ORDER BY timestamp, id""",
)
_sql(
    "phrase_search",
    "doc_logs",
    f"SELECT id, timestamp, source FROM doc_logs WHERE {_has('message', PHRASE)} OR {_has('source', PHRASE)}",
)
_sql(
    "phrase_search_source",
    "all_logs",
    f"SELECT id, timestamp, source FROM all_logs WHERE {_has('message', 'svc 3')} OR {_has('source', 'svc 3')}",
)
_sql(
    "phrase_search_stored_tokens",
    "doc_logs",
    f"SELECT id, timestamp, source FROM doc_logs WHERE {_has('message', 'of the')} OR {_has('source', 'of the')}",
)
_FILTERED = f"""all_logs WHERE ({_has('message', 'le')} OR {_has('source', 'le')}) AND level = 'info'
        AND source = 'src3' AND timestamp >= '2024-01-01 01:00:00' AND timestamp <= '2024-01-05 00:00:00'"""
_sql(
    "search_filtered",
    "all_logs",
    f"SELECT * FROM {_FILTERED} ORDER BY timestamp DESC, id LIMIT 20 OFFSET 5",
)
_sql("search_total", "all_logs", f"SELECT count(*) AS total FROM {_FILTERED}")
_sql(
    "term_index",
    "all_logs",
    r"""+ fields AS (SELECT id, 'message' AS field, message AS body FROM all_logs
                   UNION ALL SELECT id, 'source', source FROM all_logs),
        lists AS (SELECT id, field, regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}\p{Co}]+') AS terms FROM fields),
        postings AS (SELECT id, field, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM lists)
        SELECT field, term, count(*) AS postings, sum(pos)::bigint AS pos_sum, min(id) AS first_log, max(id) AS last_log
        FROM postings GROUP BY field, term""",
)
_SQL["indexed_phrase_search"] = _SQL["phrase_search"]

# --- statistics ---------------------------------------------------------------------------------

_sql("count_by_level", "logs", f"SELECT level, count(*) AS count FROM logs WHERE timestamp >= '{SINCE}' GROUP BY level")
_sql("count_by_source", "logs", f"SELECT source, count(*) AS count FROM logs WHERE timestamp >= '{SINCE}' GROUP BY source")
_sql(
    "top_sources",
    "all_logs",
    "SELECT source, count(*) AS count FROM all_logs GROUP BY source ORDER BY count DESC, source LIMIT 5",
)
_sql("total_count", "all_logs", "SELECT count(*) AS count FROM all_logs")
_sql("error_count", "logs", f"SELECT count(*) AS count FROM logs WHERE level = 'error' AND timestamp >= '{SINCE}'")
_sql(
    "errors_per_minute",
    "logs",
    f"""SELECT count(*) AS error_count, round(count(*) / 60.0::double, 6) AS errors_per_minute FROM logs
        WHERE level = 'error'
          AND timestamp BETWEEN TIMESTAMP '{BURST_AS_OF}' - INTERVAL 60 MINUTE AND TIMESTAMP '{BURST_AS_OF}'""",
)
_sql(
    "log_stats",
    "all_logs",
    f"""+ recent AS (SELECT * FROM all_logs WHERE timestamp BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR AND TIMESTAMP '{AS_OF}')
        SELECT 'total' AS section, 'all' AS name, count(*) AS count FROM recent
        UNION ALL SELECT 'level', level, count(*) FROM recent GROUP BY level
        UNION ALL (SELECT 'source', source, count(*) AS n FROM recent GROUP BY source ORDER BY n DESC, source LIMIT 100)""",
)
_sql(
    "log_stats_record",
    "logs",
    f"""SELECT count(*) AS total, count(*) FILTER (level = 'error') AS errors, count(DISTINCT level) AS levels,
               count(DISTINCT source) AS sources, count(*) AS source_sum
        FROM logs WHERE timestamp BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR AND TIMESTAMP '{AS_OF}'""",
)
_sql(
    "volume_stats",
    "logs",
    f"""+ hours AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS n FROM logs
                    WHERE timestamp BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR AND TIMESTAMP '{AS_OF}' GROUP BY 1)
        SELECT round(coalesce(avg(n), 0), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS std,
               coalesce(max(n), 0) AS max, coalesce(min(n), 0) AS min FROM hours""",
)
_sql("hourly_counts", "all_logs", "SELECT date_trunc('hour', timestamp) AS hour, count(*) AS count FROM all_logs GROUP BY 1")
_LEVELS = "(VALUES (0, 'debug'), (1, 'info'), (2, 'warn'), (3, 'error')) AS v(position, level)"
_sql(
    "level_cards",
    "all_logs",
    f"""SELECT position, v.level AS level, count(id) AS count FROM {_LEVELS}
        LEFT JOIN all_logs ON all_logs.level = v.level GROUP BY 1, 2""",
)
_sql(
    "error_rate_pct",
    "all_logs",
    """SELECT count(*) AS total, count(*) FILTER (level = 'error') AS errors,
              CASE WHEN count(*) > 0 THEN floor(100.0 * count(*) FILTER (level = 'error') / count(*) + 0.5) ELSE 0 END::bigint AS error_rate_pct
       FROM all_logs""",
)
_SCALED = "round(count / greatest(max(count) OVER (), 1), 6) AS scaled, round(greatest(100.0::double * count / greatest(max(count) OVER (), 1), 12), 6) AS bar_height"
_sql(
    "series_scaled",
    "all_logs",
    f"""+ top AS (SELECT source, count(*) AS count FROM all_logs GROUP BY source ORDER BY count DESC, source LIMIT 5)
        SELECT *, {_SCALED} FROM top""",
)
_sql(
    "level_series_scaled",
    "logs",
    f"""+ cards AS (SELECT position, v.level AS level, count(id) AS count FROM {_LEVELS}
                    LEFT JOIN logs ON logs.level = v.level AND timestamp >= '{SINCE}' GROUP BY 1, 2)
        SELECT *, {_SCALED} FROM cards""",
)

# --- ingestion ----------------------------------------------------------------------------------


def _one_of(*values: str) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _line_level(text: str) -> str:
    return f"""CASE WHEN lower({text}) IN ({_one_of('error', 'err', 'fatal', 'critical', 'severe')}) THEN 'error'
        WHEN lower({text}) IN ({_one_of('warn', 'warning')}) THEN 'warn'
        WHEN lower({text}) IN ({_one_of('debug', 'trace', 'verbose')}) THEN 'debug' ELSE 'info' END"""


def _message_level(text: str) -> str:
    return f"""CASE WHEN lower({text}) IN ({_one_of('error', 'err', 'fatal', 'critical', 'severe')}) THEN 'error'
        WHEN lower({text}) IN ({_one_of('warn', 'warning')}) THEN 'warn'
        WHEN lower({text}) IN ({_one_of('debug', 'dbg')}) THEN 'debug' ELSE 'info' END"""


_DIGITS = r"'^[0-9]+$'"
_ZULU = r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}'"


def _line_time(text: str) -> str:
    return f"""CASE WHEN regexp_matches({text}, {_DIGITS}) AND length({text}) <= 10 THEN make_timestamp({text}::bigint * 1000000)
             WHEN regexp_matches({text}, {_DIGITS}) THEN make_timestamp({text}::bigint * 1000)
             WHEN regexp_matches({text}, {_ZULU}) THEN try_cast(replace({text}, 'Z', '') AS timestamp) END"""



# A line of the given data is valid JSON exactly when json_valid says so; fields are read by type.
_PARSED = """+ j AS (SELECT id, content AS line, trim(content) = '' AS blank,
              CASE WHEN json_valid(content) THEN content::json END AS doc FROM messages),
        f AS (SELECT *, json_type(doc, '$.level') AS level_type, doc->>'$.level' AS level_text,
              coalesce(doc->>'$.severity', doc->>'$.log_level') AS other_level,
              CASE WHEN coalesce(json_type(doc, '$.message'), 'NULL') <> 'NULL' THEN json_type(doc, '$.message')
                   WHEN coalesce(json_type(doc, '$.msg'), 'NULL') <> 'NULL' THEN json_type(doc, '$.msg')
                   ELSE json_type(doc, '$.text') END AS body_type,
              coalesce(doc->>'$.message', doc->>'$.msg', doc->>'$.text') AS body,
              coalesce(doc->>'$.source', doc->>'$.service', doc->>'$.app', 'unknown') AS origin,
              json_type(doc, '$.timestamp') AS stamp_type, doc->>'$.timestamp' AS stamp,
              coalesce(doc->>'$.time', doc->>'$.ts') AS other_time FROM j),
        s AS (SELECT *, coalesce(body_type = 'VARCHAR', false)
                        AND (coalesce(level_type, 'NULL') <> 'NULL' OR other_level IS NOT NULL) AS structured FROM f),
        lines AS (
        SELECT id,
               coalesce(CASE WHEN structured AND stamp_type IN ('UBIGINT', 'BIGINT') THEN
                             CASE WHEN stamp::bigint > 1000000000000 THEN make_timestamp(stamp::bigint * 1000)
                                  ELSE make_timestamp(stamp::bigint * 1000000) END
                             WHEN structured AND stamp_type = 'VARCHAR' THEN {stamp_time}
                             WHEN structured THEN {other_time} END, TIMESTAMP '{as_of}') AS timestamp,
               CASE WHEN blank THEN 'unknown'
                    WHEN structured AND level_type = 'VARCHAR' THEN {level_text}
                    WHEN structured AND level_type IN ('UBIGINT', 'BIGINT') THEN
                         CASE level_text WHEN '0' THEN 'debug' WHEN '2' THEN 'warn' WHEN '3' THEN 'error' ELSE 'info' END
                    WHEN structured THEN {other_level}
                    WHEN regexp_matches(lower(line), 'fatal|critical|severe|error') THEN 'error'
                    WHEN contains(lower(line), 'warn') THEN 'warn'
                    WHEN regexp_matches(lower(line), 'debug|trace') THEN 'debug' ELSE 'info' END AS level,
               CASE WHEN blank THEN 'events.log' WHEN structured THEN origin ELSE 'plain_text' END AS source,
               CASE WHEN structured THEN body ELSE line END AS message,
               CASE WHEN NOT blank THEN line END AS raw FROM s)""".format(
    stamp_time=_line_time("stamp"),
    other_time=_line_time("other_time"),
    as_of=AS_OF,
    level_text=_line_level("level_text"),
    other_level=_line_level("other_level"),
)
_sql("parse_lines", "messages", f"{_PARSED} SELECT * FROM lines")
_sql(
    "encode_records",
    "messages",
    f"""{_PARSED} SELECT id, timestamp, level_now AS level, CASE WHEN source = '' THEN 'unknown' ELSE source END AS source, message
        FROM (SELECT *, CASE WHEN level = 'unknown' THEN 'info' ELSE level END AS level_now FROM lines)""",
)

_CLASSIFIED = f"""+ j AS (SELECT id, content, CASE WHEN json_valid(content) THEN content::json END AS doc FROM messages),
        f AS (SELECT *, json_type(doc, '$.level') AS level_type, doc->>'$.level' AS level_text,
              json_type(doc, '$.timestamp') AS stamp_type, doc->>'$.timestamp' AS stamp,
              json_type(doc, '$.message') AS body_type, doc->>'$.message' AS body, doc->>'$.source' AS origin FROM j),
        classified AS (
        SELECT id, content,
               CASE WHEN doc IS NULL THEN 'invalid_json'
                    WHEN level_type IN ('UBIGINT', 'BIGINT') AND level_text <> '0' THEN 'level_not_text' END AS reason,
               coalesce(CASE WHEN stamp_type IN ('UBIGINT', 'BIGINT') AND stamp <> '0' THEN
                             make_timestamp(CASE WHEN stamp::bigint < 1000000000000 THEN stamp::bigint * 1000000 ELSE stamp::bigint * 1000 END)
                             WHEN stamp_type = 'VARCHAR' AND regexp_matches(stamp, {_ZULU}) THEN try_cast(replace(stamp, 'Z', '') AS timestamp)
                        END, TIMESTAMP '{AS_OF}') AS timestamp,
               CASE WHEN level_type = 'VARCHAR' THEN {_message_level('level_text')} ELSE 'info' END AS level,
               coalesce(nullif(origin, ''), 'unknown') AS source,
               CASE WHEN body_type = 'VARCHAR' AND body <> '' THEN body
                    WHEN body_type IN ('UBIGINT', 'BIGINT') AND body <> '0' THEN body || '.0' ELSE content END AS message,
               content AS raw FROM f)"""
_sql(
    "normalize_messages",
    "messages",
    f"{_CLASSIFIED} SELECT timestamp, level, source, message, raw FROM classified WHERE reason IS NULL",
)
_sql(
    "dead_letter",
    "messages",
    f"{_CLASSIFIED} SELECT id, content, reason, TIMESTAMP '{AS_OF}' AS failed_at FROM classified WHERE reason IS NOT NULL",
)
_sql("messages_not_failed", "messages", f"{_CLASSIFIED} SELECT id, content FROM classified WHERE reason IS NULL")
_sql(
    "stream_ingested_logs",
    "messages",
    f"{_CLASSIFIED} SELECT level, source, message, raw FROM classified WHERE reason IS NULL",
)
_sql(
    "stream_dead_letters",
    "messages",
    f"{_CLASSIFIED} SELECT id, content, reason FROM classified WHERE reason IS NOT NULL",
)
_CHECKED = f"""+ j AS (SELECT event_id, body, body::json AS doc FROM bodies),
        f AS (SELECT *, json_type(doc, '$.message') AS message_type, doc->>'$.message' AS message,
              json_type(doc, '$.level') AS level_type, doc->>'$.level' AS level_text,
              json_type(doc, '$.timestamp') AS stamp_type, doc->>'$.timestamp' AS stamp,
              json_type(doc, '$.source') AS source_type, doc->>'$.source' AS source_text,
              json_type(doc, '$.raw') AS raw_type, doc->>'$.raw' AS raw_text FROM j),
        checked AS (
        SELECT event_id,
               CASE WHEN coalesce(message_type, 'NULL') <> 'VARCHAR' OR message = '' THEN 'message_required'
                    WHEN length(message) > 10000 THEN 'message_too_long'
                    WHEN level_type IN ('UBIGINT', 'BIGINT') AND level_text <> '0' THEN 'level_not_text' END AS reject_reason,
               coalesce(CASE WHEN stamp_type IN ('UBIGINT', 'BIGINT') THEN make_timestamp(stamp::bigint * 1000)
                             WHEN stamp_type = 'VARCHAR' AND regexp_matches(stamp, {_ZULU}) THEN try_cast(replace(stamp, 'Z', '') AS timestamp)
                        END, TIMESTAMP '{AS_OF}') AS timestamp,
               CASE WHEN level_type = 'VARCHAR' THEN {_message_level('level_text')} ELSE 'info' END AS level,
               CASE WHEN source_type = 'VARCHAR' AND source_text <> '' THEN left(source_text, 500) ELSE 'api' END AS source,
               message, CASE WHEN raw_type = 'VARCHAR' THEN raw_text END AS raw,
               coalesce(source_type = 'VARCHAR' AND length(source_text) > 500, false) AS source_cut FROM f)"""
_sql(
    "validate_ingest",
    "bodies",
    f"{_CHECKED} SELECT event_id, timestamp, level, source, message, raw, source_cut FROM checked WHERE reject_reason IS NULL",
)
_sql(
    "validate_rejects",
    "bodies",
    f"{_CHECKED} SELECT event_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL",
)


def _typed(**types: str) -> str:
    return " AND ".join(f"json_type(body::json, '$.{name}') = '{kind}'" for name, kind in types.items())


_sql(
    "record_shape_filter",
    "shaped",
    "SELECT * FROM shaped WHERE "
    + _typed(id="VARCHAR", message="VARCHAR", level="VARCHAR", source="VARCHAR", timestamp="VARCHAR"),
)
_sql(
    "alert_shape_filter",
    "shaped",
    "SELECT * FROM shaped WHERE "
    + _typed(id="VARCHAR", message="VARCHAR", severity="VARCHAR", created_at="VARCHAR", acknowledged="BOOLEAN"),
)
_sql(
    "analyze_input",
    "all_logs",
    """SELECT CASE WHEN level <> 'debug' THEN id ELSE '' END AS id,
              CASE WHEN level <> 'warn' THEN timestamp END AS timestamp, 'info' AS level,
              CASE WHEN level <> 'error' THEN source ELSE 'unknown' END AS source,
              md5(message) AS message, NULL::varchar AS raw
       FROM all_logs WHERE length(message) <= 10000""",
)
_sql(
    "analyze_input_rejects",
    "all_logs",
    """SELECT CASE WHEN level <> 'debug' THEN id ELSE '' END AS id, md5(message) AS message,
              'message_too_long' AS reject_reason FROM all_logs WHERE length(message) > 10000""",
)
_sql(
    "append_batch",
    "all_logs",
    """SELECT timestamp::date AS log_date, level, count(*) AS n, min(id) AS first_id, max(id) AS last_id,
              sum(length(message))::bigint AS chars FROM all_logs GROUP BY 1, 2""",
)
_sql(
    "append_replayed",
    "logs",
    f"""+ days AS (SELECT *, timestamp < '{SINCE}' AS early, timestamp < TIMESTAMP '{SINCE}' - INTERVAL 20 DAY AS gone FROM logs),
        x AS (SELECT *, CASE WHEN early AND NOT gone THEN timestamp ELSE timestamp + INTERVAL 1 DAY END AS kept FROM days),
        steps AS (
            SELECT 0 AS step, count(*) FILTER (early) AS n FROM x UNION ALL SELECT 1, count(*) FILTER (NOT early) FROM x
            UNION ALL SELECT 2, 0 UNION ALL SELECT 3, count(*) FILTER (gone) FROM x UNION ALL SELECT 4, count(*) FILTER (gone) FROM x)
        SELECT step, n, logs, logs AS ids, logs AS known, latest, latest AS latest_known
        FROM steps, (SELECT count(*) AS logs, max(kept) AS latest FROM x)""",
)
_sql("append_new", "logs", "SELECT level, count(*) AS n, count(DISTINCT id) AS ids FROM logs GROUP BY level")
_sql(
    "append_conflicts",
    "doc_logs logs",
    """SELECT id, 'repeated_in_batch' AS reason FROM doc_logs
       UNION ALL SELECT id, 'already_stored' FROM logs""",
)
_sql(
    "stored_search",
    "all_logs",
    f"""SELECT * FROM all_logs WHERE ({_has('message', PHRASE)} OR {_has('source', PHRASE)})
        AND timestamp >= '2024-01-01 02:00:00' ORDER BY timestamp DESC, id LIMIT 1000""",
)

_sql("stored_get", "all_logs", "SELECT * FROM all_logs WHERE id = 'ev-000000000042'")
_sql(
    "stored_range",
    "all_logs",
    f"""SELECT * FROM all_logs WHERE timestamp >= '2024-01-10 00:00:00' AND timestamp <= '{SINCE}'
        ORDER BY timestamp, id""",
)
_sql("read_lines", "messages", "SELECT content AS value FROM messages")
_sql(
    "message_ids",
    "messages",
    f"{_CLASSIFIED} SELECT sha256(id::varchar || chr(1) || content) AS id FROM classified WHERE reason IS NULL",
)

# --- inbox --------------------------------------------------------------------------------------

_sql(
    "inbox_enqueue",
    "messages",
    f"""SELECT id // 1000 AS id, to_json(list(content ORDER BY m.id))::varchar AS data, TIMESTAMP '{AS_OF}' AS created_at
        FROM messages m GROUP BY 1""",
)
_sql(
    "inbox_accept",
    "inbox",
    """SELECT id, CASE id % 5 WHEN 2 THEN 'not_an_array' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'nothing_to_store' ELSE 'accepted' END AS status,
              CASE WHEN id % 5 IN (0, 1) THEN data END AS data FROM inbox""",
)
_sql("inbox_explode", "messages", "SELECT id // 100 AS inbox_id, (id % 100)::int AS pos, content FROM messages")
_sql(
    "inbox_next",
    "inbox processed",
    """SELECT id, data, created_at FROM inbox WHERE id NOT IN (SELECT id FROM processed)
       ORDER BY created_at, id LIMIT 20""",
)
_sql(
    "inbox_stats",
    "inbox processed",
    "SELECT count(*) FILTER (id NOT IN (SELECT id FROM processed)) AS pending, count(*) AS total FROM inbox",
)
_sql(
    "inbox_after_cleanup",
    "inbox processed",
    f"""SELECT id, created_at FROM inbox WHERE id NOT IN
        (SELECT id FROM processed WHERE processed_at < TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR)""",
)
_sql(
    "inbox_taken",
    "messages",
    """+ batches AS (SELECT DISTINCT id // 100 AS id FROM messages)
       SELECT id, (SELECT count(*) FROM batches) - 5 AS pending FROM batches ORDER BY id LIMIT 5""",
)

# --- features and detectors ---------------------------------------------------------------------

_FEATURES = f"""SELECT id AS log_id, timestamp,
        CASE lower(level) WHEN 'debug' THEN 0 WHEN 'info' THEN 1 WHEN 'warn' THEN 2 WHEN 'error' THEN 3 ELSE 1 END AS level_encoded,
        length(message)::int AS message_length, hour(timestamp)::int AS hour_of_day,
        hour(timestamp) BETWEEN 9 AND 17 AS is_business_hours,
        len({_WORDS})::int AS word_count, len(list_distinct({_WORDS}))::int AS unique_words,
        regexp_matches(lower(message), 'error|exception|failed|timeout|crash') AS has_error_keywords,
        regexp_matches(lower(message), 'warn|deprecated|slow') AS has_warning_keywords FROM all_logs"""
_sql("features", "all_logs", _FEATURES)
_sql(
    "feature_vector",
    "all_logs",
    f"""+ x AS ({_FEATURES})
        SELECT log_id, concat_ws(',', level_encoded, message_length, hour_of_day, is_business_hours::int, word_count,
               unique_words, has_error_keywords::int, has_warning_keywords::int) AS vector FROM x""",
)


def _forest(name: str, logs: str) -> str:
    """Common table expressions of a forest trained on ``logs``: nodes, paths per vector and threshold.

    The draws, splits and path lengths are worked out from MD5, level by level, as the operator states them.
    """
    features = range(1, forest.WIDTH + 1)
    last = forest.depth_limit(forest.SUBSAMPLE)
    number = "('0x' || substr(md5({0}), {1}, {2}))::bigint"
    key = f"'{forest.SEED}:' || tree || ':' || node"
    parts = [f"""
        {name}_f AS MATERIALIZED ({_FEATURES.replace("FROM all_logs", f"FROM {logs}")}),
        {name}_v AS MATERIALIZED (
            SELECT log_id, [level_encoded::double, message_length::double, hour_of_day::double, is_business_hours::int::double,
                   word_count::double, unique_words::double, has_error_keywords::int::double, has_warning_keywords::int::double] AS v,
                   {number.format("log_id", 1, 15)} AS k FROM {name}_f),
        {name}_n AS MATERIALIZED (SELECT count(*) AS n, least({forest.SUBSAMPLE}, count(*)) AS sub FROM {name}_v),
        {name}_pool AS (
            SELECT log_id, v, k % {forest.PRIME} AS place FROM {name}_v, {name}_n
            WHERE k // {forest.PRIME} <= least(1.0, {float(forest.POOL)} / n) * 2.0 ** 29),
        {name}_trees AS (
            SELECT t AS tree, 1 + {number.format(f"'{forest.SEED}:' || t || ':a'", 1, 15)} % ({forest.PRIME} - 1) AS a,
                   {number.format(f"'{forest.SEED}:' || t || ':b'", 1, 15)} % {forest.PRIME} AS b FROM range({forest.TREES}) r(t)),
        {name}_drawn AS MATERIALIZED (
            SELECT tree, v FROM (
                SELECT tree, v, row_number() OVER (PARTITION BY tree ORDER BY (place * a + b) % {forest.PRIME}, log_id) AS place_
                FROM {name}_pool, {name}_trees), {name}_n WHERE place_ <= sub),
        {name}_rows_0 AS MATERIALIZED (SELECT tree, 0 AS node, v FROM {name}_drawn)"""]
    for depth in range(last + 1):
        low, high = (", ".join(f"{f}(v[{i}])" for i in features) for f in ("min", "max"))
        limit = f"{depth} = ceil(log2(greatest((SELECT sub FROM {name}_n), 2)))"
        parts.append(f"""
        {name}_nodes_{depth} AS MATERIALIZED (
            SELECT tree, node, size, leaf, CASE WHEN leaf THEN 0 ELSE f - 1 END AS feature,
                   CASE WHEN leaf THEN 0.0::double
                        ELSE low[f] + ({number.format(key, 1, 13)} / 2.0::double ** 52) * (high[f] - low[f]) END AS split, {depth} AS depth
            FROM (SELECT *, len(varying) = 0 OR {limit} AS leaf,
                         varying[1 + {number.format(key, 14, 7)} % greatest(len(varying), 1)] AS f
                  FROM (SELECT *, list_filter(range(1, {forest.WIDTH + 1}), lambda i: high[i] > low[i]) AS varying
                        FROM (SELECT tree, node, count(*) AS size, [{low}] AS low, [{high}] AS high
                              FROM {name}_rows_{depth} GROUP BY tree, node)))),
        {name}_rows_{depth + 1} AS MATERIALIZED (
            SELECT r.tree, 2 * r.node + CASE WHEN r.v[n.feature + 1] <= n.split THEN 1 ELSE 2 END AS node, r.v
            FROM {name}_rows_{depth} r JOIN {name}_nodes_{depth} n USING (tree, node) WHERE NOT n.leaf)""")
    union = " UNION ALL ".join(f"SELECT * FROM {name}_nodes_{depth}" for depth in range(last + 1))
    parts.append(f"""
        {name}_nodes AS MATERIALIZED ({union}),
        {name}_threshold AS MATERIALIZED (
            SELECT quantile_cont(score, {forest.CONTAMINATION}) AS threshold FROM {name}_v JOIN ({_paths(name, f"SELECT DISTINCT v FROM {name}_v")}) USING (v))""")
    return ",".join(parts)


def _paths(name: str, vectors: str) -> str:
    """(v, score) of distinct vectors: all trees are walked down at once."""
    walk = f"""SELECT v, tree, 0 AS node, false AS done, 0::bigint AS units FROM ({vectors}) CROSS JOIN {name}_trees"""
    for depth in range(forest.depth_limit(forest.SUBSAMPLE) + 1):
        walk = f"""
            SELECT w.v, w.tree, w.done OR n.leaf AS done,
                   CASE WHEN w.done THEN w.units WHEN n.leaf THEN n.depth::bigint * {forest.UNIT} + {_LENGTH.format("n.size")} ELSE 0 END AS units,
                   CASE WHEN w.done OR n.leaf THEN w.node WHEN w.v[n.feature + 1] <= n.split THEN 2 * w.node + 1 ELSE 2 * w.node + 2 END AS node
            FROM ({walk}) w LEFT JOIN {name}_nodes n ON n.tree = w.tree AND n.node = w.node AND n.depth = {depth} AND NOT w.done"""
    scale = _LENGTH.format(f"(SELECT sub FROM {name}_n)")
    return f"""SELECT v, -pow(2.0::double, -(sum(units)::double / ({forest.TREES} * ({scale})))) AS score FROM ({walk}) GROUP BY v"""


_sql(
    "iforest_model",
    "logs",
    f"""+ {_forest("m", "logs").lstrip()}
        SELECT tree::integer AS tree, node::integer AS node, feature::integer AS feature, round(split, 6) AS split,
               (CASE WHEN leaf THEN node ELSE 2 * node + 1 END)::integer AS left,
               (CASE WHEN leaf THEN node ELSE 2 * node + 2 END)::integer AS right, size, depth::integer AS depth,
               n AS samples_trained, {forest.CONTAMINATION}::double AS contamination, sub::integer AS subsample,
               round(threshold, 6) AS threshold FROM m_nodes, m_n, m_threshold""",
)
_sql(
    "iforest_scores",
    "logs",
    f"""+ {_forest("m", "logs").lstrip()}
        SELECT log_id, round(score, 6) AS score FROM m_v JOIN ({_paths("m", "SELECT DISTINCT v FROM m_v")}) USING (v)""",
)
_sql(
    "iforest_anomalies",
    "all_logs",
    f"""+ {_forest("m", "logs").lstrip()},
        a_f AS MATERIALIZED ({_FEATURES}),
        a_v AS MATERIALIZED (
            SELECT log_id, [level_encoded::double, message_length::double, hour_of_day::double, is_business_hours::int::double,
                   word_count::double, unique_words::double, has_error_keywords::int::double, has_warning_keywords::int::double] AS v
            FROM a_f)
        SELECT log_id, 'unusual_pattern' AS anomaly_type, 'medium' AS severity,
               'ML detected unusual log pattern: ' || left(message, {forest.PREVIEW_CHARS}) || '...' AS message,
               round(score, 6) AS anomaly_score, level AS log_level, source AS log_source
        FROM a_v JOIN ({_paths("m", "SELECT DISTINCT v FROM a_v")}) USING (v) JOIN all_logs ON id = log_id, m_threshold
        WHERE score < threshold""",
)
_RECENT = "SELECT count(*) FROM logs WHERE timestamp BETWEEN TIMESTAMP '{0}' - INTERVAL 24 HOUR AND TIMESTAMP '{0}'"
_sql(
    "iforest_train_on_recent",
    "logs",
    f"""+ r AS (SELECT * FROM logs WHERE timestamp BETWEEN TIMESTAMP '{SPIKE_AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{SPIKE_AS_OF}'),
        {_forest("m", "r").lstrip()}, said AS (
            SELECT 0 AS request, false AS success, 0::bigint AS samples_used
            UNION ALL SELECT 1, true, ({_RECENT.format(AS_OF)})
            UNION ALL SELECT 2, false, 0
            UNION ALL SELECT 3, true, n FROM m_n)
        SELECT request, success, samples_used, n AS last_trained, round(threshold, 6) AS threshold FROM said, m_n, m_threshold""",
)
_BURST = f"""SELECT count(*) FILTER (level = 'error') AS errors, count(*) AS total FROM logs
        WHERE timestamp BETWEEN TIMESTAMP '{BURST_AS_OF}' - INTERVAL 5 MINUTE AND TIMESTAMP '{BURST_AS_OF}'"""
_sql(
    "error_burst",
    "logs",
    f"""+ r AS ({_BURST})
        SELECT 'system' AS log_id, 'error_burst' AS anomaly_type, 'high' AS severity, errors AS error_count,
               total AS total_count, round(errors / 5.0::double, 6) AS errors_per_minute,
               {BURST_THRESHOLD}::double AS threshold, 5::bigint AS window_minutes
        FROM r WHERE errors / 5.0 > {BURST_THRESHOLD}""",
)
_sql(
    "volume_spike",
    "logs",
    f"""+ h AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS n FROM logs
                WHERE timestamp >= TIMESTAMP '{SPIKE_AS_OF}' - INTERVAL 24 HOUR AND timestamp <= '{SPIKE_AS_OF}' GROUP BY 1),
        a AS (SELECT sum(n) AS logs, count(*) AS hours, avg(n) AS mean, stddev_samp(n) AS std,
                     coalesce(max(n) FILTER (hour = date_trunc('hour', TIMESTAMP '{SPIKE_AS_OF}')), 0) AS now FROM h)
        SELECT 'system' AS log_id, 'volume_spike' AS anomaly_type, 'medium' AS severity, now AS current_count,
               round(mean, 6) AS mean_count, round(std, 6) AS std_count, round((now - mean) / std, 6) AS z_score,
               {SPIKE_THRESHOLD}::double AS threshold
        FROM a WHERE logs >= 10 AND hours >= 2 AND std > 0 AND (now - mean) / std > {SPIKE_THRESHOLD}""",
)
_sql(
    "source_anomaly",
    "gateway",
    """+ c AS (SELECT source, count(*) AS n FROM gateway GROUP BY source),
       t AS (SELECT sum(n)::bigint AS total FROM c)
       SELECT 'system' AS log_id, 'source_anomaly' AS anomaly_type, 'low' AS severity, source, n AS count,
              round(n / total, 6) AS ratio, total AS total_logs
       FROM c, t WHERE total >= 10 AND n >= 10 AND n / total > 0.8""",
)
_sql(
    "error_rate_rule",
    "logs",
    f"""+ r AS ({_BURST})
        SELECT 'system' AS log_id, 'error_rate' AS anomaly_type, 'high' AS severity, errors AS "errorCount",
               round(errors / 5.0::double, 6) AS "errorsPerMinute", 5::bigint AS "windowMinutes",
               {BURST_THRESHOLD}::double AS threshold, 'error_rate' AS type
        FROM r WHERE errors / 5.0 > {BURST_THRESHOLD}""",
)
_sql(
    "error_rate_alerts",
    "logs",
    f"""+ r AS ({_BURST})
        SELECT 'system' AS log_id, 'high' AS severity, TIMESTAMP '{BURST_AS_OF}' AS created_at, false AS acknowledged
        FROM r WHERE errors / 5.0 > {BURST_THRESHOLD}""",
)


def _found(logs: str, suffix: str = "", as_of: str = BURST_AS_OF) -> str:
    """The three rules with the registered settings over a view, as (detector_seq, anomaly_type, severity)."""
    return f"""b{suffix} AS (SELECT count(*) FILTER (level = 'error') AS errors FROM {logs}
                   WHERE timestamp BETWEEN TIMESTAMP '{as_of}' - INTERVAL 5 MINUTE AND TIMESTAMP '{as_of}'),
        h{suffix} AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS n FROM {logs}
                      WHERE timestamp <= TIMESTAMP '{as_of}' GROUP BY 1),
        v{suffix} AS (SELECT avg(n) AS mean, stddev_samp(n) AS std, sum(n) AS total, count(*) AS hours,
              coalesce(max(n) FILTER (hour = date_trunc('hour', TIMESTAMP '{as_of}')), 0) AS now FROM h{suffix}),
        c{suffix} AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total FROM {logs} GROUP BY source),
        found{suffix} AS (
        SELECT 0 AS detector_seq, 'system' AS log_id, 'error_burst' AS anomaly_type, 'high' AS severity FROM b{suffix} WHERE errors / 5.0 > {BURST_THRESHOLD}
        UNION ALL SELECT 1, 'system', 'volume_spike', 'medium' FROM v{suffix}
          WHERE total >= 10 AND hours >= 2 AND std > 0 AND (now - mean) / std > {SPIKE_THRESHOLD}
        UNION ALL SELECT 2, 'system', 'source_anomaly', 'low' FROM c{suffix} WHERE n >= 10 AND n / total > 0.8)"""


_sql("run_detectors", "gateway", f"+ {_found('gateway')} SELECT * FROM found")
_sql("run_detectors_spike", "logs", f"+ {_found('logs', as_of=SPIKE_AS_OF)} SELECT * FROM found")
_sql(
    "error_burst_quiet",
    "logs",
    f"+ r AS ({_BURST}) SELECT 'error_burst' AS anomaly_type, errors AS error_count FROM r WHERE errors / 5.0 > 10",
)
_sql(
    "analyze",
    "gateway",
    f"+ {_found('gateway')} SELECT anomaly_type, (SELECT count(*) FROM gateway) AS processed_count FROM found",
)
_sql(
    "error_burst_text",
    "logs",
    f"""+ r AS ({_BURST}) SELECT printf('High error rate detected: %.2f errors/minute (%d errors in 5 minutes)',
        errors / 5.0::double, errors) AS message FROM r WHERE errors / 5.0 > {BURST_THRESHOLD}""",
)
_sql(
    "detector_stats_all",
    "logs",
    f"""+ {_found('logs')}
        SELECT name, enabled, runs_count, count(anomaly_type) AS alerts_created, loaded
        FROM (VALUES ('error_burst', true, 1::bigint, NULL), ('volume_spike', true, 1, NULL), ('source_anomaly', true, 1, NULL),
              ('switched_off', false, 0, NULL), ('isolation_forest', true, 0, 'false')) AS d(name, enabled, runs_count, loaded)
        LEFT JOIN found ON anomaly_type = name GROUP BY ALL""",
)
_NAMES = "(VALUES ('error_burst'), ('volume_spike'), ('source_anomaly')) AS d(name)"
_sql(
    "detector_stats",
    "gateway logs",
    f"""+ {_found('gateway')}, {_found('logs', '2')},
        both_runs AS (SELECT anomaly_type FROM found UNION ALL SELECT anomaly_type FROM found2)
        SELECT name, true AS enabled, 2::bigint AS runs_count, count(anomaly_type) AS alerts_created
        FROM {_NAMES} LEFT JOIN both_runs ON anomaly_type = name GROUP BY name""",
)

# --- alerts -------------------------------------------------------------------------------------

_sql(
    "alerts_list",
    "alerts",
    """SELECT * FROM alerts WHERE severity = 'medium' AND NOT acknowledged
       ORDER BY created_at DESC, id LIMIT 30 OFFSET 3""",
)
_sql("alerts_list_total", "alerts", "SELECT count(*) AS total FROM alerts WHERE severity = 'medium' AND NOT acknowledged")
_sql("alert_get", "alerts", "SELECT * FROM alerts WHERE id = 'al-4'")
_sql(
    "alert_details",
    "alerts",
    "SELECT id, CASE WHEN severity <> 'low' THEN (details::json->>'$.k')::bigint END AS k FROM alerts",
)
_sql(
    "open_alert_counts",
    "alerts",
    """SELECT count(*) AS alerts, count(*) FILTER (severity = 'critical') AS critical
       FROM (SELECT * FROM alerts ORDER BY created_at DESC, id LIMIT 5)""",
)
_sql(
    "alert_create",
    "anomalies",
    f"""SELECT log_id, severity, message, CASE WHEN details <> '{{}}' THEN details END AS details,
               TIMESTAMP '{AS_OF}' AS created_at, false AS acknowledged FROM anomalies WHERE severity <> 'urgent'""",
)
_sql("alert_create_rejects", "anomalies", "SELECT log_id, severity FROM anomalies WHERE severity = 'urgent'")
_sql(
    "alerts_recent",
    "alerts",
    f"""SELECT * FROM alerts WHERE created_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}'
        ORDER BY created_at DESC, id LIMIT 100""",
)
_sql(
    "alert_stats",
    "alerts",
    """SELECT 'severity' AS section, severity AS name, count(*) AS count FROM alerts GROUP BY severity
       UNION ALL SELECT 'total', 'all', count(*) FROM alerts
       UNION ALL SELECT 'unacknowledged', 'all', count(*) FILTER (NOT acknowledged) FROM alerts""",
)
_sql("alerts_unacknowledged", "alerts", "SELECT count(*) AS count FROM alerts WHERE NOT acknowledged AND severity = 'high'")
_sql(
    "alert_similar",
    "alerts",
    f"""SELECT * FROM alerts WHERE severity = 'low' AND NOT acknowledged AND message ILIKE '%rate detected: svc-2%'
        AND created_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR AND TIMESTAMP '{AS_OF}' ORDER BY created_at, id LIMIT 1""",
)
_sql(
    "alert_dedup",
    "alerts anomalies",
    f"""+ still_open AS (SELECT DISTINCT severity, lower(message) AS message FROM alerts
                         WHERE NOT acknowledged AND created_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR AND TIMESTAMP '{AS_OF}'),
        ranked AS (SELECT *, lower(left(message, 50)) AS pattern,
                   row_number() OVER (PARTITION BY severity, lower(left(message, 50)) ORDER BY detector_seq, log_id) AS nth FROM anomalies)
        SELECT log_id, anomaly_type, severity, message, details, detector_seq FROM ranked r WHERE nth = 1
        AND NOT EXISTS (SELECT 1 FROM still_open o WHERE o.severity = r.severity AND contains(o.message, r.pattern))""",
)
_OPEN = f"""SELECT DISTINCT severity, lower(message) AS message FROM alerts
             WHERE NOT acknowledged AND created_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR AND TIMESTAMP '{AS_OF}'"""


def _rounds(n: int) -> str:
    """Which of ``fresh`` are kept (1) or dropped (0): decided in rounds, from those that nothing blocks."""
    steps = ["d0 AS MATERIALIZED (SELECT severity, pattern, 1 AS kept FROM fresh WHERE (severity, pattern) NOT IN (SELECT (severity, pattern) FROM blocks))"]
    for k in range(n):
        steps.append(f"""d{k + 1} AS MATERIALIZED (
            SELECT * FROM d{k} UNION ALL
            SELECT b.severity, b.pattern, 1 - coalesce(max(kept), 0) AS kept FROM blocks b
            LEFT JOIN d{k} d ON d.severity = b.severity AND d.pattern = b.by_pattern
            WHERE (b.severity, b.pattern) NOT IN (SELECT (severity, pattern) FROM d{k})
            GROUP BY ALL HAVING max(kept) = 1 OR count(*) = count(kept))""")
    return ", ".join(steps)


_sql(
    "alert_dedup_outcomes",
    "alerts anomalies",
    f"""+ still_open AS ({_OPEN}),
        short AS (SELECT * REPLACE (CASE WHEN right(log_id, 12)::bigint % 3 = 0 THEN left(message, length(message) - 1) ELSE message END AS message)
                  FROM anomalies),
        ranked AS MATERIALIZED (
            SELECT *, lower(left(message, 50)) AS pattern,
                   row_number() OVER (PARTITION BY severity, lower(left(message, 50)) ORDER BY detector_seq, log_id) AS nth FROM short),
        firsts AS MATERIALIZED (SELECT * FROM ranked WHERE nth = 1),
        fresh AS MATERIALIZED (
            SELECT * FROM firsts r
            WHERE NOT EXISTS (SELECT 1 FROM still_open o WHERE o.severity = r.severity AND contains(o.message, r.pattern))),
        blocks AS MATERIALIZED (
            SELECT p.severity, p.pattern, m.pattern AS by_pattern FROM fresh p JOIN fresh m
            ON m.severity = p.severity AND (m.detector_seq, m.log_id) < (p.detector_seq, p.log_id) AND contains(lower(m.message), p.pattern)),
        {_rounds(8)}
        SELECT log_id, severity, message,
               CASE WHEN (severity, pattern) NOT IN (SELECT (severity, pattern) FROM fresh) THEN 'open_alert'
                    WHEN kept = 0 THEN 'earlier_anomaly' WHEN nth > 1 THEN 'same_pattern' WHEN kept = 1 THEN 'alert' END AS outcome
        FROM ranked LEFT JOIN d8 USING (severity, pattern)""",
)
_sql(
    "alert_dedup_after_preamble",
    "alerts anomalies",
    f"""+ still_open AS ({_OPEN}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY severity, lower(left(message, 50)) ORDER BY detector_seq, log_id) AS nth FROM anomalies)
        SELECT log_id, severity, '{forest.PREAMBLE}' || message AS message FROM ranked r WHERE nth = 1
        AND NOT EXISTS (SELECT 1 FROM still_open o WHERE o.severity = r.severity AND contains(o.message, lower(left(r.message, 50))))""",
)
_sql(
    "alert_ack_state",
    "alerts",
    "SELECT id, severity, acknowledged OR severity = 'low' AS acknowledged FROM alerts",
)
_sql(
    "alert_acknowledge",
    "",
    """SELECT 'al-' || event_id AS id, event_type = 'error' AS found FROM events
       WHERE event_type IN ('error', 'purchase')""",
)
_sql(
    "alert_table_state",
    "alerts",
    f"""+ state AS (SELECT id, created_at, acknowledged OR severity = 'low' AS acknowledged FROM alerts)
        SELECT * FROM state WHERE NOT (acknowledged AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY)""",
)
_sql(
    "alert_table_folded",
    "alerts",
    f"""+ SELECT id, severity, created_at FROM alerts WHERE NOT acknowledged
          AND created_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY AND TIMESTAMP '{AS_OF}'""",
)
_sql(
    "alert_orphans",
    "alerts logs",
    f"""SELECT id, log_id FROM alerts WHERE log_id NOT IN
        (SELECT id FROM logs WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY)""",
)
_sql(
    "alerts_after_delete_old",
    "alerts",
    f"SELECT * FROM alerts WHERE NOT (acknowledged AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY)",
)
_sql("alerts_after_delete_acked", "alerts", "SELECT * FROM alerts WHERE NOT acknowledged")

# --- retention ----------------------------------------------------------------------------------

_KEPT = f"timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 252 HOUR"
_sql("logs_after_retention", "logs", f"SELECT *, timestamp::date AS log_date FROM logs WHERE {_KEPT}")
_sql(
    "log_table_retention",
    "logs",
    f"""SELECT timestamp::date AS log_date, count(*) AS n, min(timestamp) AS first_at,
               (SELECT count(*) FROM logs WHERE NOT ({_KEPT})) AS deleted FROM logs WHERE {_KEPT} GROUP BY 1""",
)

# --- streams ------------------------------------------------------------------------------------

_sql(
    "stream_error_rate",
    "logs",
    """+ w AS (SELECT date_trunc('minute', timestamp) - to_minutes(k) AS window_start, level
               FROM logs, range(5) AS r(k))
       SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS total_count,
              count(*) FILTER (level = 'error') AS error_count,
              round(count(*) FILTER (level = 'error') / 5.0::double, 6) AS errors_per_minute
       FROM w GROUP BY window_start""",
)
_sql(
    "stream_volume",
    "logs",
    f"""+ h AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS n FROM logs GROUP BY 1),
        b AS (SELECT avg(n) AS mean, stddev_samp(n) AS std FROM h WHERE hour >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR)
        SELECT hour, n AS count, round(mean, 6) AS mean_count, round(std, 6) AS std_count,
               round((n - mean) / std, 6) AS z_score FROM h, b""",
)
_sql(
    "stream_error_rate_backlog",
    "logs",
    """+ w AS (SELECT date_trunc('minute', timestamp) - to_minutes(k) AS window_start, level
               FROM logs, range(5) AS r(k))
       SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS total_count,
              count(*) FILTER (level = 'error') AS error_count,
              round(count(*) FILTER (level = 'error') / 5.0::double, 6) AS errors_per_minute
       FROM w GROUP BY window_start""",
)
_sql(
    "stream_volume_backlog",
    "logs",
    "+ SELECT date_trunc('hour', timestamp) AS hour, count(*) AS count FROM logs GROUP BY 1",
)
_SQL["stream_error_rate_rollup"] = _SQL["stream_error_rate_backlog"]
_SQL["stream_volume_rollup"] = _SQL["stream_volume_backlog"]
_RETAINED = f"""SELECT * FROM logs WHERE timestamp >= '{RETAINED}' AND timestamp <= '{BURST_AS_OF}'"""
_sql(
    "volume_stats_rolled",
    "logs",
    f"""+ hours AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS n FROM ({_RETAINED})
                    WHERE timestamp >= TIMESTAMP '{BURST_AS_OF}' - INTERVAL 288 HOUR GROUP BY 1)
        SELECT round(coalesce(avg(n), 0), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS std,
               coalesce(max(n), 0) AS max, coalesce(min(n), 0) AS min FROM hours""",
)
_sql("count_by_source_rolled", "logs", f"SELECT source, count(*) AS count FROM ({_RETAINED}) GROUP BY 1")
_sql(
    "stream_alerts_created",
    "logs",
    f"""+ {_found('logs')}
        SELECT log_id, severity, TIMESTAMP '{BURST_AS_OF}' AS created_at, false AS acknowledged FROM found""",
)
_SQL["stream_alerts_of_parts"] = _SQL["stream_alerts_created"]
_sql(
    "stream_runs",
    "logs",
    f"""+ {_found('logs')}
        SELECT 1::bigint AS polls_count, (SELECT count(*) FROM logs) AS logs_processed, count(*) AS alerts_created FROM found""",
)
_sql(
    "stream_detector_stats",
    "logs",
    f"""+ {_found('logs')}
        SELECT name, true AS enabled, 1::bigint AS runs_count, count(anomaly_type) AS alerts_created
        FROM {_NAMES} LEFT JOIN found ON anomaly_type = name GROUP BY name""",
)
