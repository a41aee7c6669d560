"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators import (
    alerts as alert_ops,
    conflicts,
    features as feature_ops,
    inbox as inbox_ops,
    messages as message_ops,
    parsing,
    retention,
    search,
    stats,
    terms,
)
from logquarry.operators.dedup import after, deduplicate, outcomes
from logquarry.operators.detectors import forest, registry, rules
from logquarry.functions import text as text_fns
from logquarry.plans import views
from logquarry.session import configure, scratch_path
from logquarry.sources import lines
from logquarry.sources.alerts import AlertTable
from logquarry.sources.inbox import Inbox
from logquarry.sources.logs import LogTable
from logquarry.sources.rollup import Rollup
from logquarry.streaming import alerts as stream_alerts
from logquarry.streaming import ingest as stream_ingest
from logquarry.streaming import rates

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = views.AS_OF
SINCE = "2024-01-15 00:00:00"
SPIKE_AS_OF = "2024-01-12 16:59:59"
SPIKE_THRESHOLD = 2.0
BURST_AS_OF = "2024-01-19 03:25:34.451436"
BURST_THRESHOLD = 0.5
RETAINED = "2024-01-08 10:20:30"
PHRASE = "la elle"

_QUERIES: dict[str, Query] = {}


def _presentable(df: DataFrame) -> DataFrame:
    """Timestamps without zone (UTC wall time) and doubles rounded to 6 places."""
    columns = []
    for name, kind in df.dtypes:
        if kind == "timestamp":
            columns.append(F.col(name).cast("timestamp_ntz").alias(name))
        elif kind == "double":
            columns.append(F.round(name, 6).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def query(function: Query) -> Query:
    """Register a query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return _presentable(function(spark, sf_dir))

    _QUERIES[function.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- search -------------------------------------------------------------------------------------


@query
def log_search(spark, sf_dir):
    return search.search(views.dated_logs(spark, sf_dir), level="error", limit=50, offset=10).rows


@query
def log_search_range(spark, sf_dir):
    logs = views.dated_logs(spark, sf_dir)
    return search.search(logs, source="svc-3", start=SINCE, end="2024-01-20 12:00:00", limit=1000).rows


@query
def log_search_deep(spark, sf_dir):
    return search.deep_search(views.all_logs(spark, sf_dir), limit=100, offset=10_500).rows


@query
def log_search_one_instant(spark, sf_dir):
    """All logs of one instant, ten copies each: pages go by id alone. Two pages far down."""
    at = F.lit("2024-01-15 12:00:00.123456").cast("timestamp")
    copies = views.all_logs(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    logs = copies.withColumns({"timestamp": at, "id": F.concat("id", F.lit("-"), "copy")}).drop("copy")
    pages = [search.deep_search(logs, limit=50, offset=offset).rows for offset in (1_200, 9_400)]
    return pages[0].unionByName(pages[1]).select("id", "timestamp", "level", "source")


@query
def log_recent(spark, sf_dir):
    return search.recent(views.logs(spark, sf_dir), 20)


@query
def log_get(spark, sf_dir):
    return search.by_id(views.logs(spark, sf_dir), "ev-000000000042")


@query
def log_fetch_since(spark, sf_dir):
    return search.fetch_since(views.logs(spark, sf_dir), "ev-000000000500")


@query
def log_fetch_range(spark, sf_dir):
    return search.fetch_range(views.dated_logs(spark, sf_dir), "2024-01-10 00:00:00", SINCE)


@query
def log_fetch_recent(spark, sf_dir):
    return search.fetch_recent(views.dated_logs(spark, sf_dir), hours=48, as_of=AS_OF)


@query
def phrase_search(spark, sf_dir):
    hits = search.phrase_filter(views.doc_logs(spark, sf_dir), PHRASE)
    return hits.select("id", "timestamp", "source")


@query
def phrase_search_source(spark, sf_dir):
    return search.phrase_filter(views.all_logs(spark, sf_dir), "SVC 3").select("id", "timestamp", "source")


@query
def phrase_search_stored_tokens(spark, sf_dir):
    docs = views.doc_logs(spark, sf_dir)
    for column, stored in search.TOKEN_LINES.items():
        docs = docs.withColumn(stored, text_fns.token_line(F.col(column)))
    return search.phrase_filter(docs, "of the").select("id", "timestamp", "source")


def _filtered_search(spark, sf_dir) -> search.Page:
    return search.search(
        views.all_logs(spark, sf_dir),
        q="le",
        level="info",
        source="src3",
        start="2024-01-01 01:00:00",
        end="2024-01-05 00:00:00",
        limit=20,
        offset=5,
    )


@query
def search_filtered(spark, sf_dir):
    return _filtered_search(spark, sf_dir).rows


@query
def search_total(spark, sf_dir):
    return _filtered_search(spark, sf_dir).total()


@query
def term_index(spark, sf_dir):
    """Postings per term and field of the whole index."""
    index = terms.term_index(views.all_logs(spark, sf_dir))
    # Least and greatest texts are aggregated by sorting, which is quicker when the many different terms come first.
    found = index.groupBy("term", "field").agg(
        F.count(F.lit(1)).alias("postings"),
        F.sum("pos").alias("pos_sum"),
        F.min("log_id").alias("first_log"),
        F.max("log_id").alias("last_log"),
    )
    return found.select("field", "term", "postings", "pos_sum", "first_log", "last_log")


@query
def indexed_phrase_search(spark, sf_dir):
    docs = views.doc_logs(spark, sf_dir)
    hits = terms.indexed_phrase_search(docs, terms.term_index(docs), PHRASE)
    return hits.select("id", "timestamp", "source")


# --- statistics ---------------------------------------------------------------------------------


@query
def count_by_level(spark, sf_dir):
    return stats.count_by_level(views.dated_logs(spark, sf_dir), SINCE)


@query
def count_by_source(spark, sf_dir):
    return stats.count_by_source(views.dated_logs(spark, sf_dir), SINCE)


@query
def top_sources(spark, sf_dir):
    return stats.top_sources(views.all_logs(spark, sf_dir), 5)


@query
def total_count(spark, sf_dir):
    return stats.total_count(views.all_logs(spark, sf_dir))


@query
def error_count(spark, sf_dir):
    return stats.error_count(views.dated_logs(spark, sf_dir), SINCE)


@query
def errors_per_minute(spark, sf_dir):
    return stats.errors_per_minute(views.logs(spark, sf_dir), 60, BURST_AS_OF)


@query
def log_stats(spark, sf_dir):
    return stats.log_stats(views.all_logs(spark, sf_dir), hours=24 * 30, as_of=AS_OF)


@query
def log_stats_record(spark, sf_dir):
    """The statistics as one record with maps, here laid out as sizes and sums."""
    record = stats.stats_record(stats.log_stats(views.logs(spark, sf_dir), hours=240, as_of=AS_OF))
    return record.select(
        "total",
        F.col("byLevel")["error"].alias("errors"),
        F.size("byLevel").cast("long").alias("levels"),
        F.size("bySource").cast("long").alias("sources"),
        F.aggregate(F.map_values("bySource"), F.lit(0).cast("long"), lambda a, b: a + b).alias("source_sum"),
    )


@query
def volume_stats(spark, sf_dir):
    return stats.volume_stats(views.dated_logs(spark, sf_dir), hours=240, as_of=AS_OF)


@query
def hourly_counts(spark, sf_dir):
    return stats.hourly_counts(views.all_logs(spark, sf_dir))


@query
def level_cards(spark, sf_dir):
    return stats.level_cards(views.all_logs(spark, sf_dir))


@query
def error_rate_pct(spark, sf_dir):
    return stats.error_rate_pct(views.all_logs(spark, sf_dir))


@query
def series_scaled(spark, sf_dir):
    return stats.scaled_series(stats.top_sources(views.all_logs(spark, sf_dir), stats.BUSIEST_SOURCES))


@query
def level_series_scaled(spark, sf_dir):
    return stats.scaled_series(stats.level_cards(views.logs(spark, sf_dir), SINCE))


# --- ingestion ----------------------------------------------------------------------------------


@query
def parse_lines(spark, sf_dir):
    return parsing.parse_lines(views.raw_lines(spark, sf_dir), AS_OF, keep=("id",))


@query
def encode_records(spark, sf_dir):
    """Parsed lines as queued messages, normalised again: the whole path of a line."""
    parsed = parsing.parse_lines(views.raw_lines(spark, sf_dir), AS_OF, keep=("id",))
    queued = parsing.encode_records(parsed, keep=("id",))
    return message_ops.classify_messages(queued, AS_OF).select("id", "timestamp", "level", "source", "message")


@query
def normalize_messages(spark, sf_dir):
    normal = message_ops.normalize_messages(views.messages(spark, sf_dir), AS_OF)
    return normal.drop("id")


@query
def dead_letter(spark, sf_dir):
    return message_ops.dead_letters(views.messages(spark, sf_dir), AS_OF)


@query
def messages_not_failed(spark, sf_dir):
    messages = views.messages(spark, sf_dir)
    return message_ops.skip_failed(messages, message_ops.dead_letters(messages, AS_OF))


@query
def validate_ingest(spark, sf_dir):
    return message_ops.validate_ingest(views.bodies(spark, sf_dir), AS_OF, keep=("event_id",)).drop("id")


@query
def validate_rejects(spark, sf_dir):
    rejects = message_ops.ingest_rejects(views.bodies(spark, sf_dir), AS_OF, keep=("event_id",))
    return rejects.select("event_id", "reject_reason")


@query
def record_shape_filter(spark, sf_dir):
    return message_ops.log_shaped(views.shaped(spark, sf_dir))


@query
def alert_shape_filter(spark, sf_dir):
    return message_ops.alert_shaped(views.shaped(spark, sf_dir))


def _handed_in(spark, sf_dir):
    return views.all_logs(spark, sf_dir).select(
        F.when(F.col("level") != "debug", F.col("id")).alias("id"),
        F.when(F.col("level") != "warn", F.col("timestamp").cast("string")).alias("timestamp"),
        "message",
        F.when(F.col("level") != "error", F.col("source")).alias("source"),
    )


@query
def analyze_input(spark, sf_dir):
    return message_ops.analysis_input(_handed_in(spark, sf_dir)).withColumn("message", F.md5("message"))


@query
def analyze_input_rejects(spark, sf_dir):
    refused = message_ops.input_rejects(_handed_in(spark, sf_dir))
    return refused.select("id", F.md5("message").alias("message"), "reject_reason")


@query
def append_batch(spark, sf_dir):
    """Write the events, append the documents, and read the table back."""
    table = LogTable(spark, scratch_path(spark, "logs"))
    table.append_batch(views.logs(spark, sf_dir))
    table.append_batch(views.doc_logs(spark, sf_dir))
    return table.scan().groupBy("log_date", "level").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.sum(F.length("message")).alias("chars"),
    )


@query
def append_new(spark, sf_dir):
    """Append everything to a table that holds the errors already: only the rest is added."""
    table = LogTable(spark, scratch_path(spark, "logs"))
    table.append_batch(views.logs(spark, sf_dir))
    table.append_new(views.logs(spark, sf_dir))
    return table.scan().groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")
    )


@query
def append_replayed(spark, sf_dir):
    """The same logs a day later, by another writer: their ids are in the ledger, so only new ones are added.

    Then logs before a time are deleted with their ids, and everything is offered again.
    """
    path = scratch_path(spark, "logs")
    logs = views.logs(spark, sf_dir)
    old = logs.filter(F.col("timestamp") < F.lit(SINCE).cast("timestamp"))
    later = logs.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY"))
    added = [LogTable(spark, path).append_batch(old), LogTable(spark, path).append_new(later), LogTable(spark, path).append_new(later)]
    gone = LogTable(spark, path).delete_old(days=20, as_of=SINCE)
    added.append(LogTable(spark, path).append_new(later))
    rows = [(i, n) for i, n in enumerate([*added, gone])]
    steps = spark.createDataFrame(rows, "step int, n long")
    table = LogTable(spark, path)
    held = {
        "logs": table.scan().agg(F.count(F.lit(1))),
        "ids": table.scan().agg(F.countDistinct("id")),
        "latest": table.scan().agg(F.max("timestamp")),
        "known": table.ledger.ids().agg(F.count(F.lit(1))),
        "latest_known": table.ledger.ids().agg(F.max("timestamp")),
    }
    return steps.withColumns({name: value.scalar() for name, value in held.items()})


@query
def append_conflicts(spark, sf_dir):
    docs = views.doc_logs(spark, sf_dir)
    batch = views.logs(spark, sf_dir).unionByName(docs).unionByName(docs)
    return conflicts.append_conflicts(batch, views.logs(spark, sf_dir))


@query
def stored_search(spark, sf_dir):
    """Phrase search in a stored table with token lines."""
    table = LogTable(spark, scratch_path(spark, "logs"), token_lines=True)
    table.append_batch(views.all_logs(spark, sf_dir))
    return search.search(table.scan(), q=PHRASE, start="2024-01-01 02:00:00", limit=1000).rows


def _stored(spark, sf_dir) -> LogTable:
    table = LogTable(spark, scratch_path(spark, "logs"))
    table.append_batch(views.all_logs(spark, sf_dir))
    return table


@query
def stored_get(spark, sf_dir):
    return search.by_id(_stored(spark, sf_dir).scan(), "ev-000000000042")


@query
def stored_range(spark, sf_dir):
    return search.fetch_range(_stored(spark, sf_dir).scan(), "2024-01-10 00:00:00", SINCE)


@query
def read_lines(spark, sf_dir):
    """The messages as text files, read back as lines."""
    path = scratch_path(spark, "lines")
    views.messages(spark, sf_dir).select("content").write.text(path)
    return lines.read_lines(spark, path).select("value")


@query
def message_ids(spark, sf_dir):
    return message_ops.normalize_messages(views.messages(spark, sf_dir), AS_OF).select("id")


# --- inbox --------------------------------------------------------------------------------------


@query
def inbox_enqueue(spark, sf_dir):
    lines = views.messages(spark, sf_dir).withColumnRenamed("id", "seq")
    return inbox_ops.enqueue_lines(lines, AS_OF)


@query
def inbox_accept(spark, sf_dir):
    body = (
        F.when(F.col("id") % 5 == 1, F.concat(F.lit("[1,null,true,"), F.substr("data", F.lit(2))))
        .when(F.col("id") % 5 == 2, F.concat(F.lit('{"batch":'), F.col("data"), F.lit("}")))
        .when(F.col("id") % 5 == 3, F.concat(F.col("data"), F.lit("]")))
        .when(F.col("id") % 5 == 4, F.lit("[1,2,{}]"))
        .otherwise(F.col("data"))
    )
    given = views.inbox(spark, sf_dir).select("id", body.alias("body"))
    return inbox_ops.accept_bodies(given, keep=("id",))


@query
def inbox_explode(spark, sf_dir):
    return inbox_ops.explode_batches(views.inbox(spark, sf_dir))


@query
def inbox_next(spark, sf_dir):
    return inbox_ops.next_batches(views.inbox(spark, sf_dir), views.processed(spark, sf_dir), 20)


@query
def inbox_stats(spark, sf_dir):
    return inbox_ops.inbox_stats(views.inbox(spark, sf_dir), views.processed(spark, sf_dir))


@query
def inbox_after_cleanup(spark, sf_dir):
    rest = inbox_ops.after_cleanup(
        views.inbox(spark, sf_dir), views.processed(spark, sf_dir), 240, AS_OF
    )
    return rest.select("id", "created_at")


@query
def inbox_taken(spark, sf_dir):
    """Queue all messages, take twice, and count what is left."""
    box = Inbox(spark, scratch_path(spark, "inbox"))
    lines = views.messages(spark, sf_dir).withColumnRenamed("id", "seq")
    box.enqueue(lines, AS_OF, size=100)
    first = box.take(3, AS_OF)
    second = box.take(2, AS_OF)
    taken = first.unionByName(second)
    counts = box.stats()
    return taken.select("id", counts.select("pending").scalar().alias("pending"))


# --- features and detectors ---------------------------------------------------------------------


@query
def features(spark, sf_dir):
    return feature_ops.features(views.all_logs(spark, sf_dir))


@query
def feature_vector(spark, sf_dir):
    vectors = feature_ops.feature_vectors(views.all_logs(spark, sf_dir))
    return vectors.select(
        "log_id", F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ",").alias("vector")
    )


def _details(anomalies: DataFrame, schema: str) -> DataFrame:
    parsed = anomalies.withColumn("d", F.from_json("details", schema))
    return parsed.select("log_id", "anomaly_type", "severity", "d.*")


@query
def error_burst(spark, sf_dir):
    found = rules.error_burst(views.dated_logs(spark, sf_dir), BURST_THRESHOLD, 5, BURST_AS_OF)
    return _details(
        found,
        "error_count long, total_count long, errors_per_minute double, threshold double, window_minutes long",
    )


@query
def volume_spike(spark, sf_dir):
    found = rules.volume_spike(views.dated_logs(spark, sf_dir), SPIKE_THRESHOLD, 24, SPIKE_AS_OF)
    return _details(
        found,
        "current_count long, mean_count double, std_count double, z_score double, threshold double",
    )


def _mostly_gateway(spark, sf_dir):
    source = F.when(F.col("message").endswith("7"), F.col("source")).otherwise("gateway")
    return views.logs(spark, sf_dir).withColumn("source", source)


@query
def source_anomaly(spark, sf_dir):
    found = rules.source_anomaly(_mostly_gateway(spark, sf_dir))
    return _details(found, "source string, count long, ratio double, total_logs long")


@query
def error_rate_rule(spark, sf_dir):
    found = rules.error_rate_rule(views.dated_logs(spark, sf_dir), BURST_THRESHOLD, 5, BURST_AS_OF)
    return _details(
        found,
        "errorCount long, errorsPerMinute double, windowMinutes long, threshold double, type string",
    )


@query
def error_rate_alerts(spark, sf_dir):
    made = rules.error_rate_alerts(
        views.dated_logs(spark, sf_dir), views.alerts(spark, sf_dir), BURST_THRESHOLD, 5, as_of=BURST_AS_OF
    )
    return made.select("log_id", "severity", "created_at", "acknowledged")


def _rule_detectors():
    return [
        rules.ErrorBurst(BURST_THRESHOLD),
        rules.VolumeSpike(SPIKE_THRESHOLD),
        rules.SourceAnomaly(),
    ]


@query
def run_detectors(spark, sf_dir):
    found = registry.run_detectors(_mostly_gateway(spark, sf_dir), _rule_detectors(), BURST_AS_OF)
    return found.anomalies.select("detector_seq", "log_id", "anomaly_type", "severity")


@query
def run_detectors_spike(spark, sf_dir):
    """The same rules at the end of an hour with a volume spike and no burst."""
    found = registry.run_detectors(views.logs(spark, sf_dir), _rule_detectors(), SPIKE_AS_OF)
    return found.anomalies.select("detector_seq", "log_id", "anomaly_type", "severity")


@query
def error_burst_quiet(spark, sf_dir):
    """The default threshold, which the busiest five minutes do not reach."""
    found = rules.error_burst(views.dated_logs(spark, sf_dir), as_of=BURST_AS_OF)
    return found.select("anomaly_type", F.get_json_object("details", "$.error_count").cast("long").alias("error_count"))


@query
def analyze(spark, sf_dir):
    logs = _mostly_gateway(spark, sf_dir)
    found, processed = registry.analyze(logs, _rule_detectors(), as_of=BURST_AS_OF)
    return found.anomalies.select("anomaly_type", F.lit(processed).cast("long").alias("processed_count"))


@query
def detector_stats(spark, sf_dir):
    """Two runs, over different logs."""
    first = registry.run_detectors(_mostly_gateway(spark, sf_dir), _rule_detectors(), BURST_AS_OF)
    second = registry.run_detectors(views.logs(spark, sf_dir), _rule_detectors(), BURST_AS_OF)
    runs = first.runs_frame(spark).unionByName(second.runs_frame(spark))
    return registry.detector_stats(runs).drop("last_run")


@query
def detector_stats_all(spark, sf_dir):
    """One run; a disabled and an untrained detector stand beside the rules."""
    off = rules.ErrorBurst()
    off.name, off.enabled = "switched_off", False
    found = registry.run_detectors(views.logs(spark, sf_dir), [*_rule_detectors(), off], BURST_AS_OF)
    listed = [*_rule_detectors(), off, forest.IsolationForest(spark, scratch_path(spark, "model"))]
    stats_ = registry.detector_stats(found.runs_frame(spark), listed).drop("last_run")
    return stats_.withColumn("loaded", F.get_json_object("settings", "$.model_loaded")).drop("settings")


@query
def error_burst_text(spark, sf_dir):
    return rules.error_burst(views.dated_logs(spark, sf_dir), BURST_THRESHOLD, 5, BURST_AS_OF).select("message")


def _trained(spark, sf_dir) -> forest.Forest:
    model = forest.train(views.logs(spark, sf_dir))
    path = scratch_path(spark, "model")
    forest.save_model(model, path)
    return forest.load_model(spark, path)


@query
def iforest_model(spark, sf_dir):
    """The nodes of a forest that was trained, saved and loaded again, with its settings."""
    model = _trained(spark, sf_dir)
    return model.nodes.select(
        "*",
        F.lit(model.samples_trained).cast("long").alias("samples_trained"),
        F.lit(model.contamination).alias("contamination"),
        F.lit(model.subsample).alias("subsample"),
        F.lit(model.threshold).alias("threshold"),
    )


@query
def iforest_train_on_recent(spark, sf_dir):
    """What the detector says to four requests: too few logs, enough, a model exists, replaced by force."""
    logs = views.logs(spark, sf_dir)
    detector = forest.IsolationForest(spark, scratch_path(spark, "model"), min_samples=20)
    asked = [("2020-01-01 00:00:00", False), (AS_OF, False), (AS_OF, False), (SPIKE_AS_OF, True)]
    said = [detector.train_on_recent(logs, force=force, as_of=at) for at, force in asked]
    rows = [(i, *answer[:2], detector.model.samples_trained) for i, answer in enumerate(said)]
    found = spark.createDataFrame(rows, "request int, success boolean, samples_used long, last_trained long")
    return found.withColumn("threshold", F.lit(detector.model.threshold))


@query
def iforest_scores(spark, sf_dir):
    return forest.scores(views.logs(spark, sf_dir), _trained(spark, sf_dir))


@query
def iforest_anomalies(spark, sf_dir):
    found = forest.detect(views.all_logs(spark, sf_dir), _trained(spark, sf_dir))
    values = F.from_json("details", "anomaly_score double, log_level string, log_source string").alias("d")
    return found.select("log_id", "anomaly_type", "severity", "message", values).select("*", "d.*").drop("d")


# --- alerts -------------------------------------------------------------------------------------


@query
def alerts_list(spark, sf_dir):
    return alert_ops.list_alerts(views.alerts(spark, sf_dir), "medium", False, limit=30, offset=3).rows


@query
def alerts_list_total(spark, sf_dir):
    return alert_ops.list_alerts(views.alerts(spark, sf_dir), "medium", False).total()


@query
def alert_get(spark, sf_dir):
    return alert_ops.by_id(views.alerts(spark, sf_dir), "al-4")


@query
def alert_details(spark, sf_dir):
    parsed = alert_ops.with_details(
        views.alerts(spark, sf_dir).withColumn(
            "details", F.when(F.col("severity") == "low", "{broken").otherwise(F.col("details"))
        )
    )
    return parsed.select("id", F.try_variant_get("details", "$.k", "long").alias("k"))


@query
def open_alert_counts(spark, sf_dir):
    return alert_ops.latest_counts(views.alerts(spark, sf_dir))


@query
def alert_create(spark, sf_dir):
    return alert_ops.new_alerts(views.anomalies(spark, sf_dir), AS_OF).drop("id")


@query
def alert_create_rejects(spark, sf_dir):
    return alert_ops.invalid_severity(views.anomalies(spark, sf_dir)).select("log_id", "severity")


@query
def alerts_recent(spark, sf_dir):
    return alert_ops.recent_alerts(views.alerts(spark, sf_dir), 24, 100, AS_OF)


@query
def alert_stats(spark, sf_dir):
    return alert_ops.alert_stats(views.alerts(spark, sf_dir))


@query
def alerts_unacknowledged(spark, sf_dir):
    return alert_ops.count_unacknowledged(views.alerts(spark, sf_dir), "high")


@query
def alert_similar(spark, sf_dir):
    return alert_ops.similar_alert(views.alerts(spark, sf_dir), "RATE detected: svc-2", "low", 240, AS_OF)


@query
def alert_dedup(spark, sf_dir):
    open_alerts = alert_ops.open_since(views.alerts(spark, sf_dir), 6, AS_OF)
    return deduplicate(views.anomalies(spark, sf_dir), open_alerts)


def _shortened(spark, sf_dir) -> DataFrame:
    """Anomalies of which a third lacks its last character, so that other messages contain it."""
    short = F.col("message").substr(F.lit(1), F.length("message") - 1)
    third = F.substring("log_id", -12, 12).cast("long") % 3 == 0
    return views.anomalies(spark, sf_dir).withColumn("message", F.when(third, short).otherwise(F.col("message")))


@query
def alert_dedup_outcomes(spark, sf_dir):
    """What became of every anomaly, with messages that contain each other."""
    open_alerts = alert_ops.open_since(views.alerts(spark, sf_dir), 6, AS_OF)
    return outcomes(_shortened(spark, sf_dir), open_alerts).select("log_id", "severity", "message", "outcome")


@query
def alert_dedup_after_preamble(spark, sf_dir):
    """With a key behind the beginning that all anomalies share, and open alerts that hold some of it."""
    preamble = forest.PREAMBLE
    found = views.anomalies(spark, sf_dir).withColumn("message", F.concat(F.lit(preamble), "message"))
    open_alerts = alert_ops.open_since(views.alerts(spark, sf_dir), 6, AS_OF)
    return deduplicate(found, open_alerts, dedup_key=after(preamble)).select("log_id", "severity", "message")


def _acked_ids(spark, sf_dir):
    """Ids of all warnings and errors; only the errors have an alert."""
    return (
        views.logs(spark, sf_dir)
        .filter(F.col("level").isin("error", "warn"))
        .select(F.concat(F.lit("al-"), F.substr("id", F.lit(4)).cast("long").cast("string")).alias("id"))
    )


@query
def alert_ack_state(spark, sf_dir):
    low = views.alerts(spark, sf_dir).filter(F.col("severity") == "low").select("id")
    state = alert_ops.with_acks(views.alerts(spark, sf_dir), low)
    return state.select("id", "severity", "acknowledged")


@query
def alert_acknowledge(spark, sf_dir):
    return alert_ops.acknowledgeable(views.alerts(spark, sf_dir), _acked_ids(spark, sf_dir))


@query
def alert_table_state(spark, sf_dir):
    """Store alerts, acknowledge the low ones, delete old acknowledged ones, and read back."""
    table = AlertTable(spark, scratch_path(spark, "alerts"))
    alerts = views.alerts(spark, sf_dir)
    table.append(alerts)
    table.acknowledge(alerts.filter(F.col("severity") == "low"))
    table.delete_old(10, AS_OF)
    return table.read().select("id", "created_at", "acknowledged")


@query
def alert_orphans(spark, sf_dir):
    kept = retention.kept_logs(views.dated_logs(spark, sf_dir), 15, AS_OF)
    return alert_ops.orphans(views.alerts(spark, sf_dir), kept).select("id", "log_id")


@query
def alerts_after_delete_old(spark, sf_dir):
    return alert_ops.surviving(views.alerts(spark, sf_dir), 10, AS_OF)


@query
def alerts_after_delete_acked(spark, sf_dir):
    return alert_ops.surviving(views.alerts(spark, sf_dir))


@query
def alert_table_folded(spark, sf_dir):
    """Acknowledge twice, fold, delete the acknowledged ones, store the same alerts again, and read some days."""
    table = AlertTable(spark, scratch_path(spark, "alerts"))
    alerts = views.alerts(spark, sf_dir)
    table.append(alerts)
    table.acknowledge(alerts.filter(F.col("severity") == "low"))
    table.fold_acks()
    table.acknowledge(alerts.filter(F.col("severity") == "medium"))
    table.delete_acknowledged()
    table.append(alerts)
    open_ = table.open_since(24 * 10, AS_OF)
    return open_.select("id", "severity", "created_at")


# --- retention ----------------------------------------------------------------------------------


@query
def logs_after_retention(spark, sf_dir):
    return retention.kept_logs(views.dated_logs(spark, sf_dir), 10.5, AS_OF)


@query
def log_table_retention(spark, sf_dir):
    """Store the logs, delete the old ones from the table, and read back."""
    table = LogTable(spark, scratch_path(spark, "logs"))
    table.append_batch(views.logs(spark, sf_dir))
    deleted = table.delete_old(10.5, AS_OF)
    return table.scan().groupBy("log_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("first_at"),
        F.lit(deleted).cast("long").alias("deleted"),
    )


# --- streams ------------------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    return stream_ingest.read_stream(spark, sf_dir, views.EVENTS, glob="events.parquet")


def _ingested(spark, sf_dir) -> tuple[LogTable, str]:
    base = scratch_path(spark, "ingest")
    table = LogTable(spark, f"{base}/logs")
    run = stream_ingest.start_ingest(
        views.event_messages(_event_stream(spark, sf_dir)), table, f"{base}/dead", f"{base}/checkpoint", interval=None
    )
    run.awaitTermination()
    return table, f"{base}/dead"


@query
def stream_ingested_logs(spark, sf_dir):
    return _ingested(spark, sf_dir)[0].scan().select("level", "source", "message", "raw")


@query
def stream_dead_letters(spark, sf_dir):
    dead = stream_ingest.dead_letter_table(spark, _ingested(spark, sf_dir)[1])
    return dead.select("id", "content", "reason")


@query
def stream_error_rate(spark, sf_dir):
    base = scratch_path(spark, "rate")
    windows = rates.error_rate_windows(views.event_logs(_event_stream(spark, sf_dir)))
    rates.start_updates(windows, f"{base}/out", f"{base}/checkpoint", "error_rate", None).awaitTermination()
    return rates.latest(spark, f"{base}/out", "window_start")


@query
def stream_volume(spark, sf_dir):
    base = scratch_path(spark, "volume")
    hours = rates.hourly_volume(views.event_logs(_event_stream(spark, sf_dir)))
    rates.start_updates(hours, f"{base}/out", f"{base}/checkpoint", "volume", None).awaitTermination()
    baseline = stats.volume_stats(views.logs(spark, sf_dir), 24 * 30, AS_OF)
    return rates.volume_against_baseline(rates.latest(spark, f"{base}/out", "hour"), baseline)


def _backlog(spark, sf_dir):
    """The events dealt by hash over eight files, one file per micro-batch: times arrive out of order."""
    folder = scratch_path(spark, "backlog")
    events = spark.read.schema(views.EVENTS).parquet(f"{sf_dir}/events.parquet")
    events.repartition(8, F.xxhash64(*events.columns)).write.parquet(folder)
    return stream_ingest.read_stream(spark, folder, views.EVENTS, max_files=1)


@query
def stream_error_rate_backlog(spark, sf_dir):
    base = scratch_path(spark, "rate_backlog")
    windows = rates.error_rate_windows(views.event_logs(_backlog(spark, sf_dir)))
    rates.start_updates(windows, f"{base}/out", f"{base}/checkpoint", "error_rate_backlog", None).awaitTermination()
    return rates.latest(spark, f"{base}/out", "window_start")


@query
def stream_volume_backlog(spark, sf_dir):
    base = scratch_path(spark, "volume_backlog")
    hours = rates.hourly_volume(views.event_logs(_backlog(spark, sf_dir)))
    rates.start_updates(hours, f"{base}/out", f"{base}/checkpoint", "volume_backlog", None).awaitTermination()
    return rates.latest(spark, f"{base}/out", "hour")


def _rolled(spark, sf_dir, unit: str, keys: tuple[str, ...]) -> Rollup:
    """A rollup of the backlog, folded halfway: the stream stops after four files and goes on later."""
    base = scratch_path(spark, "rollup")
    rollup = Rollup(spark, f"{base}/rollup", unit, keys)
    folder, more = f"{base}/in", f"{base}/more"
    events = spark.read.schema(views.EVENTS).parquet(f"{sf_dir}/events.parquet")
    dealt = events.withColumn("part", F.pmod(F.xxhash64(*events.columns), F.lit(2)))
    for part in (0, 1):
        dealt.filter(F.col("part") == part).drop("part").repartition(4, "event_id").write.mode("append").parquet(folder)
        logs = views.event_logs(stream_ingest.read_stream(spark, folder, views.EVENTS, max_files=1))
        rates.start_rollup(logs, rollup, f"{base}/checkpoint", interval=None).awaitTermination()
        if not part:
            rollup.fold()
    return rollup


@query
def stream_error_rate_rollup(spark, sf_dir):
    return rates.windows_of_minutes(_rolled(spark, sf_dir, "minute", ("level",)).read())


@query
def stream_volume_rollup(spark, sf_dir):
    cells = _rolled(spark, sf_dir, "hour", ("level", "source")).read()
    return cells.groupBy(F.col("start").alias("hour")).agg(F.sum("count").alias("count"))


def _retained(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(cells, logs) after logs before RETAINED were deleted from both."""
    rollup = _rolled(spark, sf_dir, "hour", ("level", "source"))
    logs = views.dated_logs(spark, sf_dir).filter(F.col("timestamp") >= F.lit(RETAINED).cast("timestamp"))
    rollup.drop_before(RETAINED, logs)
    return rollup.read(), logs


@query
def volume_stats_rolled(spark, sf_dir):
    return stats.volume_stats_rolled(*_retained(spark, sf_dir), 24 * 12, BURST_AS_OF)


@query
def count_by_source_rolled(spark, sf_dir):
    return stats.count_by_rolled(*_retained(spark, sf_dir), "source", RETAINED, BURST_AS_OF)


def _detected(spark, sf_dir) -> tuple[AlertTable, str]:
    base = scratch_path(spark, "detect")
    table = AlertTable(spark, f"{base}/alerts")
    stream_alerts.start_detection(
        views.event_logs(_event_stream(spark, sf_dir)),
        _rule_detectors(),
        table,
        f"{base}/runs",
        f"{base}/checkpoint",
        interval=None,
        as_of=BURST_AS_OF,
    ).awaitTermination()
    return table, f"{base}/runs"


@query
def stream_alerts_created(spark, sf_dir):
    table, _ = _detected(spark, sf_dir)
    return table.read().select("log_id", "severity", "created_at", "acknowledged")


@query
def stream_alerts_of_parts(spark, sf_dir):
    """Four micro-batches over two runs of the stream: every finding is stored once.

    The detectors look at all stored logs each time, so every micro-batch finds the same.
    """
    base = scratch_path(spark, "detect_parts")
    table = AlertTable(spark, f"{base}/alerts")
    folder = f"{base}/in"

    def stored() -> DataFrame:
        return views.logs(spark, sf_dir)

    detectors = [
        rules.ErrorBurst(BURST_THRESHOLD, history=stored),
        rules.VolumeSpike(SPIKE_THRESHOLD, 24 * 365, history=stored),
        rules.SourceAnomaly(history=stored),
    ]
    events = spark.read.schema(views.EVENTS).parquet(f"{sf_dir}/events.parquet")
    dealt = events.withColumn("part", F.pmod(F.xxhash64(*events.columns), F.lit(2)))
    for part in (0, 1):
        dealt.filter(F.col("part") == part).drop("part").repartition(2).write.mode("append").parquet(folder)
        logs = views.event_logs(stream_ingest.read_stream(spark, folder, views.EVENTS, max_files=1))
        stream_alerts.start_detection(
            logs, detectors, table, f"{base}/runs", f"{base}/checkpoint", interval=None, as_of=BURST_AS_OF
        ).awaitTermination()
    return table.read().select("log_id", "severity", "created_at", "acknowledged")


@query
def stream_runs(spark, sf_dir):
    _, runs = _detected(spark, sf_dir)
    return registry.poll_stats(stream_alerts.poll_runs(spark, runs)).drop("last_poll")


@query
def stream_detector_stats(spark, sf_dir):
    _, runs = _detected(spark, sf_dir)
    return registry.detector_stats(stream_alerts.detector_runs(spark, runs)).drop("last_run")
