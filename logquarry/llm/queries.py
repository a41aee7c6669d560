"""Registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm import blocks
from logquarry.llm import bpe, decontaminate, hardneg, langid, licenses, linededup, lm, neardup, periodic, simhash, suffixdedup, topk, warc
from logquarry.llm.license_texts import TEMPLATES
from logquarry.session import scratch_path

# White space at the ends of a line, and A-Z to lower case, in DuckDB.
STRIPPED = r"regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

# Lower-cased words of a text, in DuckDB.
WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



# Words of a text: stretches without white space.
_BLACK = r"[^\x20\x09-\x0D]+"

# CRC-32 of the decimal doc_id, bit by bit, in DuckDB. The constants are those of the checksum.
_CRC = (
    "xor(4294967295::ubigint, list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as ubigint)), "
    "lambda crc, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::ubigint[], lambda x, bit: "
    "case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end, xor(crc, b)), 4294967295::ubigint))::bigint"
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(
    f"({_quoted(name)}, {number}, {_quoted(text)})"
    for name, texts in sorted(TEMPLATES.items())
    for number, text in enumerate(texts)
)
# Word bigrams of a text as a list, in DuckDB.
_GRAMS = (
    r"(select list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) from "
    r"(select list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w))"
)

SQL = {
    "op3_license_scan": f"""
with t as (select name, {_GRAMS.format("body")} as g from (values {_TEMPLATES}) v(name, number, body)),
docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
parts as (
  select distinct row, part from (
    select row, text as part from docs
    union all select row, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) from docs
    union all select row, unnest(string_split(text, chr(10))) from docs)),
sets as (select row, part, {_GRAMS.format("part")} as g from parts),
compared as (
  select s.row, s.part, t.name, 2.0 * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) as dice
  from sets s join t on len(s.g) between len(t.g) * 0.9 / 1.1 and len(t.g) * 1.1 / 0.9),
good as (select * from compared where dice >= 0.9),
best as (
  select row, count(distinct part) as n_matches, string_agg(distinct name, ',' order by name) as licenses,
    max(struct_pack(dice := dice, name := name)) as top from good group by row)
select doc_id, coalesce(n_matches, 0) as n_matches, coalesce(licenses, '') as licenses, top.name as license,
  round(cast(top.dice as double), 9) as dice
from docs left join best using (row)""",
    "op1_decontaminate": f"""
with bench as (select cast(item_id as varchar) as item, {WORDS.format("text")} as w from benchmark),
pieces as (
  select item, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from bench where len(w) > 0),
wins as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as win from pieces),
sizes as (select distinct n from wins),
docs as (select row_number() over () as row, doc_id, {WORDS.format("text")} as w from documents),
places as (select row, n, w, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n),
hits as (
  select p.row, p.n, p.i, b.item from (select row, n, i, array_to_string(w[i : i + n - 1], ' ') as win from places) p
  join wins b on b.n = p.n and b.win = p.win),
words_hit as (
  select row, count(*) as n_hit from (select distinct row, unnest(range(i, i + n)) as word from hits) group by row),
items as (
  select row, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct row, item from hits) group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join words_hit using (row) left join items using (row)""",
    "op2_warc": """
with p as (select page_id, encode(coalesce(html, '')) as raw from pages),
d as (select page_id, octet_length(raw) as payload_bytes, sha1(raw) as payload_digest, sha256(raw) as same from p),
big as (select same, max(page_id) as last from d where payload_bytes >= 1000 group by same)
select page_id, payload_bytes, payload_digest,
  case when page_id <> last then 'revisit' else 'response' end as record_type,
  case when page_id <> last then last end as refers_to
from d left join big on big.same = d.same and payload_bytes >= 1000""",
    "op7_exact_top_k": """
with ok as (
  select row_number() over () as row, vec_id,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as t from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.row, q.vec_id as query_id, c.vec_id,
    cast(coalesce(list_sum(list_transform(list_zip(q.t, c.t), lambda p: coalesce(p[1] * p[2], 0))), 0) as bigint) as score
  from ok q join ok c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
ranked as (
  select *, cast(row_number() over (partition by row order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op8_line_dedup": f"""
with lines as (
  select row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
  from (select row_number() over () as row, doc_id, text from documents)),
keyed as (select *, {STRIPPED.format("line")} as key from lines),
common as (
  select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct row) >= 3)
select k.doc_id, count(*) as n_lines, count(c.last) filter (k.doc_id <> c.last) as n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) order by k.place) filter (c.key is null or k.doc_id = c.last), '')) as kept_sha256
from keyed k left join common c using (key) group by k.row, k.doc_id""",
    "op12_hard_negatives": """
with ok as (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as t from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.row, a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike,
    cast(coalesce(list_sum(list_transform(list_zip(a.t, c.t), lambda p: coalesce(p[1] * p[2], 0))), 0) as bigint) as score
  from ok a join ok c on c.vec_id <> a.vec_id where a.vec_id % 100 = 0),
positives as (
  select * from (
    select *, row_number() over (partition by row order by score desc, vec_id) as place from scored where alike) where place <= 5),
ranked as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    cast(row_number() over (partition by p.row, p.place order by n.score desc, n.vec_id) as integer) as rank
  from positives p join scored n on n.row = p.row and not n.alike
    and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10""",
    "op11_periodic_runs": f"""
with docs as (
  select row_number() over () as row, doc_id, {_CRC} as h, regexp_extract_all(coalesce(text, ''), '{_BLACK}') as v from documents),
sized as (select row, doc_id, v, h, len(v) as n, h // 10 as g from docs),
cut as (select *, g % greatest(n, 1) as a from sized),
planted as (select *, 1 + (n - a) // (3 + g % 8) as p from cut),
texts as (
  select row, doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(n), lambda i: v[cast(case when i < a then i else a + (i - a) % p end as bigint) + 1]) else v end as w
  from planted),
places as (select row, n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from texts),
grams as (
  select *, lead(i, 4) over each as end_i,
    hash(word, lead(word, 1) over each, lead(word, 2) over each, lead(word, 3) over each, lead(word, 4) over each) as gram
  from places window each as (partition by row order by i)),
fives as (select row, n, i, gram from grams where end_i is not null),
equal as (
  select distinct x.row, y.i - x.i as q, x.i from fives x join fives y
    on x.row = y.row and x.gram = y.gram and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (select *, i - row_number() over (partition by row, q order by i) as island from equal),
stretches as (
  select row, q, min(i) as start, count(*) + 4 + q as length from islands group by row, q, island),
runs as (
  select row, start, length, min(q) as period from stretches where length >= greatest(6, 4 * q) group by row, start, length),
listed as (
  select row, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as said
  from runs group by row),
best as (
  select * from (select *, row_number() over (
    partition by row order by cast(length as double) / period desc, start, period) as place from runs) where place = 1),
gone as (select distinct row, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select p.row, string_agg(p.word, ' ' order by p.i) as collapsed
  from places p left join gone using (row, i) where gone.row is null group by p.row)
select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
  sha256(coalesce(said, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from texts left join listed using (row) left join best using (row) left join kept using (row)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return blocks.prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), runs=True)
    return found.withColumn("licenses", F.concat_ws(",", "licenses")).withColumn("dice", F.round("dice", 9))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scores = lm.score(table(spark, sf_dir, "documents").withColumn("train", ~held_out))
    return scores.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    )
    model = langid.train(docs.filter("not held_out"))
    return langid.predict(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_common_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_repeated", F.size("spans").cast("long").alias("n_spans"), "spans")


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of a tenth of the ids repeat themselves from some word on.

    With h the CRC-32 of the decimal id and g = h div 10, the words from a = g mod n on are the stretch
    of 1 + (n - a) div (3 + g mod 8) words that starts there, over and over. Rows without an id stay.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", words.alias("words"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    n = F.size("words")
    a = F.expr("cast(h div 10 % greatest(size(words), 1) as int)")
    rest = n - a
    period = (1 + F.floor(rest / (3 + F.expr("h div 10 % 8")))).cast("int")
    copies = F.array_repeat(F.slice("words", a + 1, period), F.ceil(rest / period).cast("int"))
    planted = F.concat_ws(" ", F.slice("words", 1, a), F.slice(F.flatten(copies), 1, rest))
    chosen = F.coalesce((F.col("h") % 10 == 0) & (n > 0), F.lit(False))
    return cut.select("doc_id", F.when(chosen, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted_runs(table(spark, sf_dir, "documents")))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2(F.concat_ws("", said), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are one off, which makes near vectors of another label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hardneg.mine(vectors, vectors.filter("vec_id % 100 = 0"))


def op13_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def all_sql() -> dict[str, str]:
    return dict(SQL)
