import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logquarry.operators.messages import (
    alert_shaped,
    analysis_input,
    classify_messages,
    dead_letters,
    ingest_rejects,
    log_shaped,
    normalize_messages,
    skip_failed,
    validate_ingest,
)
from logquarry.operators.parsing import parse_lines

AS_OF = "2026-03-01 00:00:00"
NOW = datetime(2026, 3, 1)


def at(*parts):
    return datetime(*parts)


LINES = [
    # line, timestamp, level, source, message
    ('{"level":"WARNING","message":"m","source":"s","timestamp":1709290800}', at(2024, 3, 1, 11), "warn", "s", "m"),
    ('{"severity":"fatal","msg":"m","service":"s","timestamp":1709290800123}', at(2024, 3, 1, 11, 0, 0, 123000), "error", "s", "m"),
    ('{"log_level":"verbose","text":"m","app":"s","time":"2024-03-01T10:30:00Z"}', at(2024, 3, 1, 10, 30), "debug", "s", "m"),
    ('{"level":2,"message":"m","ts":"2024-03-01 10:30:00.5"}', at(2024, 3, 1, 10, 30, 0, 500000), "warn", "unknown", "m"),
    ('{"level":7,"message":"m"}', NOW, "info", "unknown", "m"),
    ('{"level":3.0,"message":"m"}', NOW, "info", "unknown", "m"),
    ('{"level":true,"message":"m"}', NOW, "info", "unknown", "m"),
    ('{"level":null,"severity":"err","message":"m"}', NOW, "error", "unknown", "m"),
    ('{"level":"odd","message":null,"msg":"m"}', NOW, "info", "unknown", "m"),
    ('{"level":"info","message":"m","timestamp":"1709290800"}', at(2024, 3, 1, 11), "info", "unknown", "m"),
    ('{"level":"info","message":"m","timestamp":"17092908001"}', at(1970, 7, 17, 20, 1, 48, 1000), "info", "unknown", "m"),
    ('{"level":"info","message":"m","timestamp":"not a date"}', NOW, "info", "unknown", "m"),
    ('{"level":"info","message":"m","timestamp":"2024-03-01T10:30:00+02:00 x"}', at(2024, 3, 1, 8, 30), "info", "unknown", "m"),
    ('{"level":"info","message":"m","timestamp":[1]}', NOW, "info", "unknown", "m"),
    ('{"level":"info","message":"m","timestamp":999999999999999999}', NOW, "info", "unknown", "m"),
    ('{"level":"a","level":"error","message":"m"}', NOW, "error", "unknown", "m"),
    (' {"level":"info","message":""} ', NOW, "info", "unknown", ""),
]
PLAIN = [
    # lines that stay plain text, with their level
    ('{"level":"info"}', "info"),
    ('{"message":"an error"}', "error"),
    ('{"severity":5,"message":"m"}', "info"),
    ('{"level":"info","message":5}', "info"),
    ('{"level":"info","message":"m","source":5}', "info"),
    ('{"level":"info","message":"m","time":5}', "info"),
    ('{"level":"error","message":"m"} trailing', "error"),
    ('{"level":"error","message":"m"}]', "error"),
    ('[{"level":"error","message":"m"}]', "error"),
    ("5", "info"),
    ("SEVERE: Warn", "error"),
    ("warned to debug", "warn"),
    ("Tracer", "debug"),
    ("all good", "info"),
]


def parsed(spark, lines):
    df = spark.createDataFrame([(i, line, "app.log") for i, line in enumerate(lines)], "n long, value string, path string")
    return parse_lines(df, AS_OF, keep=("n",)).orderBy("n").collect()


def test_structured_lines(spark):
    rows = parsed(spark, [line for line, *_ in LINES])
    for row, (line, *expected) in zip(rows, LINES, strict=True):
        assert [row.timestamp, row.level, row.source, row.message, row.raw] == [*expected, line], line


def test_plain_lines(spark):
    rows = parsed(spark, [line for line, _ in PLAIN])
    for row, (line, level) in zip(rows, PLAIN, strict=True):
        assert (row.level, row.source, row.message, row.raw) == (level, "plain_text", line, line)
        assert row.timestamp == NOW


def test_blank_lines(spark):
    for row in parsed(spark, ["", "  ", "\t"]):
        assert (row.level, row.source, row.raw) == ("unknown", "app.log", None)


json_value = st.one_of(
    st.none(), st.booleans(), st.integers(-3, 5), st.floats(-2, 2), st.sampled_from(["error", "WARN", "x", ""]), st.just([1]), st.just({"a": 1})
)
records = st.dictionaries(
    st.sampled_from(["level", "severity", "log_level", "message", "msg", "text", "source", "service"]), json_value
)


def line_oracle(line):
    """Level, source and message of a line, straight from the rules."""
    plain = ("plain_text", line)
    doc = json.loads(line)

    def first(*names):
        return next((doc[n] for n in names if doc.get(n) is not None), None)

    level, message, source = doc.get("level"), first("message", "msg", "text"), first("source", "service", "app")
    if level is None:
        level = first("severity", "log_level")
        if not isinstance(level, str):
            return plain
    if not isinstance(message, str) or not (source is None or isinstance(source, str)):
        return plain
    return (source if source is not None else "unknown", message)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(records, min_size=40, max_size=40))
def test_any_object_matches_the_rules(spark, docs):
    lines = [json.dumps(doc) for doc in docs]
    for row, line in zip(parsed(spark, lines), lines, strict=True):
        assert (row.source, row.message) == line_oracle(line), line


def messages_of(spark, contents):
    return spark.createDataFrame(list(enumerate(contents)), "id long, content string")


SPELLINGS = {
    "debug": ["debug", "DEBUG", "dbg", "Dbg"],
    "info": ["info", "INFO", "information", "log", "LOG", "trace", "verbose", "notice", "unknown", ""],
    "warn": ["warn", "WARN", "warning", "Warning"],
    "error": ["error", "Err", "fatal", "FATAL", "critical", "severe"],
}


def test_message_levels(spark):
    cases = [(text, level) for level, texts in SPELLINGS.items() for text in texts]
    df = messages_of(spark, [json.dumps({"message": "m", "level": text}) for text, _ in cases])
    levels = [row.level for row in classify_messages(df, AS_OF).orderBy("id").collect()]
    assert levels == [level for _, level in cases]


def test_messages_become_logs(spark):
    cases = [
        ('{"message":"test"}', NOW, "unknown", "test"),
        ('{"level":"info","source":"t"}', NOW, "t", '{"level":"info","source":"t"}'),
        ('{"message":"","source":""}', NOW, "unknown", '{"message":"","source":""}'),
        ('{"message":"m","timestamp":1709290800}', at(2024, 3, 1, 11), "unknown", "m"),
        ('{"message":"m","timestamp":1709290800000}', at(2024, 3, 1, 11), "unknown", "m"),
        ('{"message":"m","timestamp":1000000000000}', at(2001, 9, 9, 1, 46, 40), "unknown", "m"),
        ('{"message":"m","timestamp":0}', NOW, "unknown", "m"),
        ('{"message":"m","timestamp":"not-a-date"}', NOW, "unknown", "m"),
        ('{"message":"m","timestamp":"2024-03-01"}', at(2024, 3, 1), "unknown", "m"),
        ('{"message":"m","timestamp":"Fri, 01 Mar 2024 10:00:00 GMT"}', at(2024, 3, 1, 10), "unknown", "m"),
        ('{"message":"m","timestamp":"2024/3/1"}', at(2024, 3, 1), "unknown", "m"),
        ('{"message":"m","level":0}', NOW, "unknown", "m"),
        ('{"message":5,"source":1.5}', NOW, "1.5", "5.0"),
        ("[1,2]", NOW, "unknown", "[1,2]"),
        ('"text"', NOW, "unknown", '"text"'),
    ]
    rows = classify_messages(messages_of(spark, [c[0] for c in cases]), AS_OF).orderBy("id").collect()
    for row, (content, timestamp, source, message) in zip(rows, cases, strict=True):
        assert row.reject_reason is None, content
        assert (row.timestamp, row.source, row.message, row.raw) == (timestamp, source, message, content)


def test_dead_letters(spark):
    bad = {
        "not json": "invalid_json",
        '{"message":"m"} x': "invalid_json",
        "": "invalid_json",
        "null": "null_message",
        '{"message":"m","level":5}': "level_not_text",
        '{"message":"m","timestamp":1e300}': "timestamp_out_of_range",
        '{"message":"m","source":{}}': "source_not_text",
        '{"message":["m"]}': "message_not_text",
    }
    df = messages_of(spark, [*bad, '{"message":"good"}'])
    failed = dead_letters(df, AS_OF)
    assert {row.content: row.reason for row in failed.collect()} == bad
    assert [row.content for row in skip_failed(df, failed).collect()] == ['{"message":"good"}']


def test_replayed_messages_get_the_same_ids(spark):
    df = messages_of(spark, ['{"message":"a"}', '{"message":"a"}'])
    first = [row.id for row in normalize_messages(df, AS_OF).collect()]
    again = [row.id for row in normalize_messages(df.repartition(3), "2026-04-01").collect()]
    assert sorted(first) == sorted(again)
    assert len(set(first)) == 2


def test_direct_ingestion(spark):
    emoji = "\U0001f600"
    cases = [
        ('{"message":"m","level":"ERR","source":"s","raw":"r","timestamp":"2024-03-01T00:00:00Z"}', None),
        ('{"message":"m","source":5,"raw":5,"timestamp":"bad"}', None),
        (json.dumps({"message": "x" * 10000, "source": "s" * 600}), None),
        (json.dumps({"message": "x" * 10001}), "message_too_long"),
        (json.dumps({"message": emoji * 5000}), None),
        (json.dumps({"message": emoji * 5001}), "message_too_long"),
        ('{"message":""}', "message_required"),
        ('{"message":5}', "message_required"),
        ("[]", "message_required"),
        ('{"message":"m","level":1}', "level_not_text"),
        ("{", "invalid_json"),
    ]
    df = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(cases)], "n long, body string")
    rejects = {row.n: row.reject_reason for row in ingest_rejects(df, AS_OF, keep=("n",)).collect()}
    assert rejects == {i: reason for i, (_, reason) in enumerate(cases) if reason}
    rows = {row.n: row for row in validate_ingest(df, AS_OF, keep=("n",)).collect()}
    assert (rows[0].level, rows[0].source, rows[0].raw, rows[0].timestamp) == ("error", "s", "r", at(2024, 3, 1))
    assert (rows[1].level, rows[1].source, rows[1].raw, rows[1].timestamp) == ("info", "api", None, NOW)
    assert len(rows[2].source) == 500 and rows[2].source_cut and not rows[0].source_cut


def test_shapes(spark):
    log = {"id": "1", "message": "m", "level": "info", "source": "s", "timestamp": "t"}
    alert = {"id": "1", "message": "m", "severity": "low", "created_at": "t", "acknowledged": False}
    docs = [log, {**log, "id": 1}, {**log, "level": None}, alert, {**alert, "acknowledged": "no"}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "body string")
    assert [json.loads(r.body) for r in log_shaped(df).collect()] == [log]
    assert [json.loads(r.body) for r in alert_shaped(df).collect()] == [alert]


def test_analysis_input(spark):
    df = spark.createDataFrame([("a", "2024-03-01T00:00:00Z", "x" * 10001), ("b", "never", "m"), (None, None, None)], "id string, timestamp string, message string")
    rows = analysis_input(df).orderBy("id").collect()
    assert [(r.id, r.timestamp, r.level, r.source, r.message) for r in rows] == [
        ("", None, "info", "unknown", ""),
        ("b", None, "info", "unknown", "m"),
    ]
