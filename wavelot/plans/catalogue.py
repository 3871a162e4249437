"""The queries that the library offers by name over the driver's tables, with the same queries in DuckDB SQL.

Documents stand in for utterances: n_chars / 100 are their seconds (kept as whole hundredths), lang is the dataset, doc_id the key.
Embeddings stand in for waveforms. All run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelot.functions import arrays, text
from wavelot.functions.random import order_key
from wavelot.operators import batching, mux, samples, sharding, stats
from wavelot.operators.collate import collate
from wavelot.operators.ranking import shuffled_rank
from wavelot.sources import lists, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOW, HIGH, BUCKETS, BUDGET, CAP = 10, 6000, 30, 60_000, 600  # lengths in hundredths of a second
SHARDS = 16


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset"), "source", F.col("n_chars").alias("length"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.length_filter(utterances(spark, sf_dir), LOW, HIGH, "length")


_KEPT = f"u AS (SELECT doc_id, lang AS dataset, source, n_chars AS length FROM documents WHERE n_chars BETWEEN {LOW} AND {HIGH})"
# whole-number division, as the scaled length is never negative
_BUCKET = f"((length - {LOW}) * {BUCKETS - 1} // {HIGH - LOW})::INTEGER"


def bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket_id", batching.bucket_id(F.col("length"), LOW, HIGH, BUCKETS))


@query(f"SELECT doc_id, n_chars AS length FROM documents WHERE n_chars BETWEEN {LOW} AND {HIGH}")
def length_filter(spark, sf_dir):
    return kept(spark, sf_dir).select("doc_id", "length")


@query(f"WITH {_KEPT} SELECT {_BUCKET} AS bucket_id, count(*) AS n, sum(length)::BIGINT AS total, min(length) AS shortest, max(length) AS longest FROM u GROUP BY 1")
def bucket_histogram(spark, sf_dir):
    return bucketed(kept(spark, sf_dir)).groupBy("bucket_id").agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


def _greedy_sql(source: str, group: str, budget: int, cap: int | None, select: str) -> str:
    """source: a query with group, seq and length."""
    room = f"greatest(m, r.length) * (f.n + 1) <= {budget}" + (f" AND f.n < {cap}" if cap else "")
    return f"""
WITH RECURSIVE s AS ({source}), r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY seq, doc_id, length) AS rn FROM s),
f AS (
  SELECT {group}, rn, doc_id, length, 1::BIGINT AS n, length AS m, 0::BIGINT AS batch_id FROM r WHERE rn = 1
  UNION ALL
  SELECT {", ".join(f"r.{g.strip()}" for g in group.split(","))}, r.rn, r.doc_id, r.length, CASE WHEN {room} THEN f.n + 1 ELSE 1 END,
         CASE WHEN {room} THEN greatest(f.m, r.length) ELSE r.length END, CASE WHEN {room} THEN f.batch_id ELSE f.batch_id + 1 END
  FROM f JOIN r ON r.rn = f.rn + 1 AND {" AND ".join(f"r.{g.strip()} = f.{g.strip()}" for g in group.split(","))}
) {select}"""


_WORKER = f"SELECT doc_id, (doc_id % 8)::INTEGER AS worker, {_BUCKET} AS bucket_id, md5('7|' || doc_id) AS seq, length FROM u"
_SUMMARY = "SELECT worker, bucket_id, batch_id, count(*) AS n, max(length) AS longest, sum(length)::BIGINT AS total, (max(length) * count(*) - sum(length))::BIGINT AS padding FROM f GROUP BY ALL"


def _packed(spark, sf_dir, low=LOW, high=HIGH, budget=BUDGET, cap=CAP):
    rows = samples.length_filter(utterances(spark, sf_dir), low, high, "length")
    rows = bucketed(rows).withColumns({"worker": F.pmod("doc_id", F.lit(8)).cast("int"), "seq": order_key(7, "doc_id")})
    return batching.greedy_batches(rows.select("worker", "bucket_id", "seq", "doc_id", "length"), ["seq", "doc_id"], "length", budget, cap, ["worker", "bucket_id"])


@query(_greedy_sql(f"WITH {_KEPT} {_WORKER}", "worker, bucket_id", BUDGET, CAP, _SUMMARY))
def greedy_batches(spark, sf_dir):
    return batching.batch_summary(_packed(spark, sf_dir), "length", ["worker", "bucket_id"])


@query(_greedy_sql(f"WITH {_KEPT} {_WORKER}", "worker, bucket_id", 20_000, 200, "SELECT doc_id, worker, bucket_id, batch_id FROM f"))
def greedy_assignment(spark, sf_dir):
    return _packed(spark, sf_dir, budget=20_000, cap=200).select("doc_id", "worker", "bucket_id", "batch_id")


_ALL_BUCKET = f"((greatest({LOW}, least(length, {HIGH})) - {LOW}) * {BUCKETS - 1} // {HIGH - LOW})::INTEGER"
_OVER = f"SELECT doc_id, (doc_id % 8)::INTEGER AS worker, {_ALL_BUCKET} AS bucket_id, md5('7|' || doc_id) AS seq, length FROM (SELECT doc_id, n_chars AS length FROM documents)"


@query(_greedy_sql(_OVER, "worker, bucket_id", 4000, CAP, "SELECT worker, bucket_id, batch_id, count(*) AS n, max(length) AS longest FROM f GROUP BY ALL HAVING max(length) > 4000"))
def oversize_batches(spark, sf_dir):
    done = batching.batch_summary(_packed(spark, sf_dir, -1, 1 << 40, 4000), "length", ["worker", "bucket_id"])
    return done.where("longest > 4000").select("worker", "bucket_id", "batch_id", "n", "longest")


@query(f"""
WITH {_KEPT}, s AS (SELECT doc_id % 64 AS worker, length, row_number() OVER (PARTITION BY doc_id % 64 ORDER BY md5('7|' || doc_id), doc_id) AS rn FROM u)
SELECT worker, ((rn - 1) // 16)::BIGINT AS batch_id, count(*) AS n, sum(length)::BIGINT AS total FROM s GROUP BY ALL""")
def fixed_size_batches(spark, sf_dir):
    rows = kept(spark, sf_dir).withColumns({"worker": F.pmod("doc_id", F.lit(64)), "seq": order_key(7, "doc_id")})
    return batching.fixed_batches(rows, ["seq", "doc_id"], 16, ["worker"]).groupBy("worker", "batch_id").agg(F.count("*").alias("n"), F.sum("length").alias("total"))


@query(_greedy_sql(f"WITH {_KEPT} {_WORKER}", "worker, bucket_id", BUDGET, CAP, ", b AS (SELECT bucket_id, batch_id, worker, max(length) * count(*) - sum(length) AS padding, sum(length) AS total FROM f GROUP BY ALL) SELECT bucket_id, count(*) AS batches, sum(padding)::BIGINT AS padding, sum(total)::BIGINT AS total FROM b GROUP BY 1"))
def padding_waste(spark, sf_dir):
    done = batching.batch_summary(_packed(spark, sf_dir), "length", ["worker", "bucket_id"])
    return done.groupBy("bucket_id").agg(F.count("*").alias("batches"), F.sum("padding").alias("padding"), F.sum("total").alias("total"))


@query(_greedy_sql(f"WITH {_KEPT} {_WORKER}", "worker, bucket_id", BUDGET, CAP, f", b AS (SELECT sum(length) AS total FROM f GROUP BY worker, bucket_id, batch_id) SELECT count(*) AS batches, sum(total)::BIGINT AS total, round({BUDGET}.0 * count(*) / sum(total), 6) AS fill_factor FROM b"))
def fill_factor(spark, sf_dir):
    done = batching.batch_summary(_packed(spark, sf_dir), "length", ["worker", "bucket_id"])
    return done.agg(F.count("*").alias("batches"), F.sum("total").alias("total")).withColumn("fill_factor", F.round(F.lit(float(BUDGET)) * F.col("batches") / F.col("total"), 6))


@query(_greedy_sql(f"WITH {_KEPT} {_WORKER}", "worker, bucket_id", BUDGET, CAP, ", l AS (SELECT worker, bucket_id, max(batch_id) AS last FROM f GROUP BY ALL) SELECT f.worker, f.bucket_id, f.batch_id, count(*) AS n FROM f JOIN l USING (worker, bucket_id) WHERE f.batch_id < l.last GROUP BY ALL"))
def full_batches_only(spark, sf_dir):
    rows = batching.drop_tails(_packed(spark, sf_dir), ["worker", "bucket_id"])
    return rows.groupBy("worker", "bucket_id", "batch_id").agg(F.count("*").alias("n"))


@query(_greedy_sql(f"WITH {_KEPT} {_WORKER}", "worker, bucket_id", BUDGET, CAP, ", b AS (SELECT DISTINCT worker, bucket_id, batch_id FROM f), e AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY md5('emit|' || worker || '|' || bucket_id || '|' || batch_id)) AS r FROM b) SELECT worker, bucket_id, batch_id FROM e WHERE r <= 5"))
def epoch_limit(spark, sf_dir):
    batches = _packed(spark, sf_dir).select("worker", "bucket_id", "batch_id").distinct()
    keyed = batches.withColumn("k", order_key("emit", "worker", "bucket_id", "batch_id"))
    return batching.epoch_limit(keyed, 5, ["k"]).drop("k")


def _flush_sql(budget: int, cap: int | None, group: str = "worker") -> str:
    """CTEs t (the tails in f), q and g: a flush step by step, each step looking at one sample; rows of g with a doc_id are samples taken."""
    full = f"(n > 0 AND (m * n >= {budget}" + (f" OR n >= {cap}" if cap else "") + "))"
    over, head = f"(len(todo) = 0 OR {full})", "todo[1]"
    take = f"(n = 0 OR ({head}.b <> blocked AND greatest(m, {head}.x) * (n + 1) <= {budget}))"
    case = lambda over_value, taken, kept: f"CASE WHEN {over} THEN {over_value} WHEN {take} THEN {taken} ELSE {kept} END"
    return f""", last AS (SELECT {group}, bucket_id, max(batch_id) AS last FROM f GROUP BY ALL),
t AS (SELECT f.*, row_number() OVER (PARTITION BY {group} ORDER BY bucket_id DESC, rn) AS pos FROM f JOIN last USING ({group}, bucket_id) WHERE batch_id = last),
q AS (SELECT {group}, list(struct_pack(d := doc_id, b := bucket_id, x := length, k := batch_id) ORDER BY pos) AS todo FROM t GROUP BY {group}),
g AS (
  SELECT {group}, todo, todo[1:0] AS kept, 0::BIGINT AS n, 0::DOUBLE AS m, -1 AS blocked, 0::BIGINT AS flushed, -1 AS first, -1::BIGINT AS number, todo[1].d AS doc_id, todo[1].b AS own, false AS taken FROM q
  UNION ALL
  SELECT {group}, {case("list_concat(kept, todo)", "todo[2:]", "todo[2:]")}, {case("todo[1:0]", "kept", f"list_append(kept, {head})")}, {case("0", "n + 1", "n")}, {case("0", f"greatest(m, {head}.x)", "m")},
    {case("-1", "blocked", f"{head}.b")}, {case("flushed + 1", "flushed", "flushed")}, CASE WHEN {over} THEN -1 WHEN n = 0 THEN {head}.b ELSE first END, CASE WHEN {over} THEN -1 WHEN n = 0 THEN {head}.k ELSE number END,
    {head}.d, {head}.b, {case("false", "true", "false")}
  FROM g WHERE len(todo) > 0 OR len(kept) > 0
)"""


_FLUSHED = "SELECT f.doc_id, f.{0}, f.bucket_id, f.bucket_id AS from_bucket, f.batch_id, NULL::BIGINT AS flushed FROM f JOIN last USING ({0}, bucket_id) WHERE f.batch_id < last.last UNION ALL SELECT doc_id, {0}, first, own, number, flushed FROM g WHERE taken"


@query(_greedy_sql(f"WITH {_KEPT} {_WORKER}", "worker, bucket_id", 20_000, 40, _flush_sql(20_000, 40) + _FLUSHED.format("worker")))
def flush_spill(spark, sf_dir):
    """A test pass: full batches, then what is left, longest bucket first and spilling into shorter ones."""
    packed = _packed(spark, sf_dir, budget=20_000, cap=40)
    done = batching.flushed_batches(packed, ["seq", "doc_id"], "length", 20_000, 40, ["worker", "bucket_id"])
    return done.select("doc_id", "worker", "bucket_id", "from_bucket", "batch_id", "flushed")


@query(_greedy_sql(f"WITH {_KEPT} {_WORKER}", "worker, bucket_id", 20_000, 200, f""", d AS (
  SELECT worker, bucket_id, batch_id, min(rn) - 1 + any_value(floor(1.5 * 20000 / ({LOW} + (bucket_id + 0.5) * ({HIGH - LOW}::DOUBLE / {BUCKETS})))::BIGINT + 1) AS due FROM f GROUP BY ALL),
e AS (SELECT *, max(due) OVER (PARTITION BY worker, bucket_id ORDER BY batch_id) AS at FROM d)
SELECT e.worker, e.bucket_id, e.batch_id, r.seq AS arrival FROM e LEFT JOIN r ON r.worker = e.worker AND r.bucket_id = e.bucket_id AND r.rn = e.at"""))
def emission_order(spark, sf_dir):
    """Which arriving sample makes each batch go out: a bucket is full at one and a half budgets."""
    packed = _packed(spark, sf_dir, budget=20_000, cap=200)
    nominal = batching.bucket_midpoint(F.col("bucket_id"), float(LOW), float(HIGH), BUCKETS)
    events = batching.emission_events(packed, ["seq", "doc_id"], 20_000, nominal, ["worker", "bucket_id"])
    return events.select("worker", "bucket_id", "batch_id", F.col("event.seq").alias("arrival"))


@query(_greedy_sql(f"WITH {_KEPT} SELECT doc_id, dataset, (doc_id % 8)::INTEGER AS worker, ((length - {LOW}) * {BUCKETS - 1} // {HIGH - LOW})::INTEGER AS bucket_id, md5('7|' || doc_id) AS seq, length FROM u", "dataset, worker, bucket_id", BUDGET, CAP, "SELECT dataset, worker, bucket_id, batch_id, count(*) AS n, max(length) AS longest, sum(length)::BIGINT AS total FROM f GROUP BY ALL"))
def per_dataset_batches(spark, sf_dir):
    rows = bucketed(kept(spark, sf_dir)).withColumns({"worker": F.pmod("doc_id", F.lit(8)).cast("int"), "seq": order_key(7, "doc_id")})
    group = ["dataset", "worker", "bucket_id"]
    packed = batching.greedy_batches(rows.select(*group, "seq", "doc_id", "length"), ["seq", "doc_id"], "length", BUDGET, CAP, group)
    return batching.batch_summary(packed, "length", group).drop("padding")


@query(_greedy_sql("SELECT l_orderkey * 10 + l_linenumber AS doc_id, (l_orderkey % 64)::INTEGER AS worker, (l_quantity::BIGINT * 9 // 50)::INTEGER AS bucket_id, md5('3|' || l_orderkey || '|' || l_linenumber) AS seq, l_quantity::BIGINT AS length FROM lineitem", "worker, bucket_id", 1000, 100, "SELECT worker, bucket_id, batch_id, count(*) AS n, max(length) AS longest, sum(length)::BIGINT AS total FROM f GROUP BY ALL"))
def lineitem_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.pmod("l_orderkey", F.lit(64)).cast("int").alias("worker"), F.floor(F.col("l_quantity").cast("long") * 9 / 50).cast("int").alias("bucket_id"),
        order_key(3, "l_orderkey", "l_linenumber").alias("seq"), F.col("l_quantity").cast("long").alias("length"),
    )
    packed = batching.greedy_batches(rows, ["seq", "doc_id", "length"], "length", 1000, 100, ["worker", "bucket_id"])
    return batching.batch_summary(packed, "length", ["worker", "bucket_id"]).drop("padding")


# -- labels and manifests


@query("SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN '<|EMPTY|>' ELSE 'quality ' || l.quality END AS text FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_join_default(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text"))
    return samples.join_labels(table(spark, sf_dir, "documents").select("doc_id"), labels, ["doc_id"])


@query("SELECT d.lang AS dataset, count(*) AS n, count(l.doc_id) AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def label_coverage(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    return utterances(spark, sf_dir).join(known, "doc_id", "left").groupBy("dataset").agg(F.count("*").alias("n"), F.count("has").alias("labelled"))


@query("SELECT conv_id AS key, arg_max(text, turn) AS text FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL GROUP BY 1")
def last_wins_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), "text", F.col("turn").alias("line"))
    return lists.last_labels(rows, ["key"])


@query("SELECT event_type, count(*) AS num_samples, sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)) AS seconds FROM events WHERE json_valid(props) GROUP BY 1")
def jsonl_stats(spark, sf_dir):
    """Tolerant parsing: lines that aren't JSON don't count, missing or bad numbers are 0."""
    body = F.from_json("props", "k string", {"mode": "PERMISSIVE"})
    rows = table(spark, sf_dir, "events").where(F.try_parse_json("props").isNotNull()).select(F.col("event_type").alias("manifest"), body["k"].try_cast("double").alias("duration"))
    return stats.manifest_stats(rows).select(F.col("manifest").alias("event_type"), "num_samples", "seconds")


@query("SELECT doc_id % 32 AS m, count(*) AS num_samples, sum(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END)::DOUBLE AS seconds, count(CASE WHEN doc_id % 11 = 0 THEN 1 END) AS bad FROM documents WHERE TRUE GROUP BY 1")
def manifest_lines(spark, sf_dir):
    """Manifest lines made from documents (some without a duration, some broken), parsed again and counted."""
    d = table(spark, sf_dir, "documents")
    with_duration = F.to_json(F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio_filepath"), F.col("text"), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("duration")))
    good = d.select((F.col("doc_id") % 32).alias("m"), with_duration.alias("value"))
    broken = d.where("doc_id % 11 = 0").select((F.col("doc_id") % 32).alias("m"), F.lit('{"audio_filepath": "x').alias("value"))
    whole = stats.manifest_stats(lists.parse_manifest(good.unionByName(broken)), "m")
    bad = broken.groupBy("m").agg(F.count("*").alias("bad"))
    return whole.join(bad, "m", "left").select("m", "num_samples", "seconds", F.coalesce("bad", F.lit(0).cast("long")).alias("bad"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN NULL WHEN doc_id % 4 = 2 THEN 'expected 3 or 5 fields, found 4' ELSE 'empty id' END AS error, doc_id % 4 = 1 AS slice_audio, CASE WHEN doc_id % 4 = 1 THEN n_chars / 100.0 END AS duration FROM documents")
def tsv_validate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    key, path = F.col("doc_id").cast("string"), F.concat(F.lit("/audio/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    seconds = (F.col("n_chars") / 100.0).cast("string")
    line = F.when(F.col("doc_id") % 4 == 0, F.concat_ws("\t", key, path, "source")).when(F.col("doc_id") % 4 == 1, F.concat_ws("\t", key, path, "source", F.lit("0.5"), seconds)).when(F.col("doc_id") % 4 == 2, F.concat_ws("\t", key, path, "source", F.lit("1"))).otherwise(F.concat_ws("\t", F.lit(" "), path, "source"))
    return lists.parse_sources(rows.select("doc_id", line.alias("value"))).select("doc_id", "error", "slice_audio", "duration")


@query("SELECT (doc_id % 4)::INTEGER AS k, doc_id, lang, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id, lang) AS line_no FROM documents")
def line_numbers(spark, sf_dir):
    """Documents' ids as lines of text files, one file for each remainder by 4, read again with their numbers."""
    from wavelot.sources.scratch import shared_folder

    folder = shared_folder(spark, "lines")
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).cast("int").alias("k"), "doc_id", "lang")
    dealt = rows.repartition("k").sortWithinPartitions("k", "doc_id", "lang")
    dealt.select("k", F.concat_ws("\t", "doc_id", "lang").alias("value")).write.partitionBy("k").text(folder)
    read = lists.read_lines(spark, f"{folder}/*/*.txt")
    parts = F.split("value", "\t")
    return read.select(F.regexp_extract("file", r"k=(\d+)/", 1).cast("int").alias("k"), parts[0].cast("long").alias("doc_id"), parts[1].alias("lang"), "line_no")


@query("SELECT lang AS dataset, sum(n_chars)::BIGINT AS hours, count(*) AS num_samples FROM documents GROUP BY 1")
def dataset_totals(spark, sf_dir):
    rows = utterances(spark, sf_dir).select("dataset", F.col("length").alias("hours"), F.lit(1).cast("long").alias("num_samples"))
    return stats.dataset_totals(rows)


@query("SELECT sum(n_chars)::BIGINT AS hours, count(*) AS num_samples, min(n_chars) AS min_length, max(n_chars) AS max_length, count(DISTINCT lang) AS datasets FROM documents")
def cross_dataset_summary(spark, sf_dir):
    per = utterances(spark, sf_dir).groupBy("dataset").agg(F.sum("length").alias("hours"), F.count("*").alias("num_samples"), F.min("length").alias("min_length"), F.max("length").alias("max_length"))
    return stats.overall(per).withColumn("datasets", F.size("datasets").cast("long"))


@query("SELECT lang AS dataset, round(sum(n_chars) * 1.0 / sum(sum(n_chars)) OVER (), 9) AS weight FROM documents GROUP BY 1")
def mux_weights(spark, sf_dir):
    return mux.dataset_weights(dataset_totals(spark, sf_dir)).select("dataset", F.round("weight", 9).alias("weight"))


@query(f"SELECT ceil(sum(n_chars) * 1.15 / 4 / {BUDGET})::BIGINT AS by_duration, ceil(count(*) / 32.0 / 4)::BIGINT AS by_size FROM documents")
def epoch_length(spark, sf_dir):
    row = utterances(spark, sf_dir).agg(F.sum("length"), F.count("*")).first()
    total, n = row[0] or 0, row[1]
    return spark.createDataFrame([(mux.epoch_batches(total, n, BUDGET, None, 4), mux.epoch_batches(total, n, None, 32, 4))], "by_duration long, by_size long")


_RANKED = "r AS (SELECT doc_id, lang AS dataset, row_number() OVER (PARTITION BY lang ORDER BY md5('5|' || doc_id), doc_id) - 1 AS rank FROM documents), w AS (SELECT lang AS dataset, sum(n_chars) AS w FROM documents GROUP BY 1)"


@query(f"WITH {_RANKED} SELECT doc_id, dataset, rank, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / w, dataset) - 1 AS position FROM r JOIN w USING (dataset)")
def weighted_mux_order(spark, sf_dir):
    named = utterances(spark, sf_dir).where("dataset is not null")
    ranked = shuffled_rank(named.select("doc_id", "dataset", order_key(5, "doc_id").alias("k")), "k", ["doc_id"], ["dataset"]).drop("k")
    weights = named.groupBy("dataset").agg(F.sum("length").alias("w"), F.count("*").alias("n"))
    return mux.even_mix(ranked, weights).select("doc_id", "dataset", "rank", "position")


@query("SELECT c.copy, d.doc_id, n_chars AS length FROM documents d, (SELECT unnest([0, 1, 2])::INTEGER AS copy) c")
def num_copies_order(spark, sf_dir):
    return mux.num_copies(utterances(spark, sf_dir).select("doc_id", "length"), 3).select("copy", "doc_id", "length")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS rank FROM documents")
def shuffle_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", order_key(42, "doc_id").alias("k"))
    return shuffled_rank(rows, "k", ["doc_id"]).drop("k")


# -- shards


@query(f"WITH r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders) SELECT id, rank AS index, least(rank // ceil(n / {SHARDS}.0)::BIGINT, {SHARDS - 1})::INTEGER AS shard FROM r")
def sample_shards(spark, sf_dir):
    return sharding.shards_by_samples(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), SHARDS, 42)


_SERPENTINE = f"WITH r AS (SELECT doc_id AS id, n_chars AS duration, row_number() OVER (ORDER BY n_chars DESC, md5('42|' || doc_id), doc_id) - 1 AS index FROM documents), s AS (SELECT id, duration, index, CASE WHEN (index // {SHARDS}) % 2 = 0 THEN index % {SHARDS} ELSE {SHARDS - 1} - index % {SHARDS} END AS shard FROM r)"


def _serpentine(spark, sf_dir):
    return sharding.shards_by_duration(utterances(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("length").alias("duration")), SHARDS, 42)


@query(f"{_SERPENTINE} SELECT id, duration, index, shard::INTEGER AS shard FROM s")
def serpentine_duration_shards(spark, sf_dir):
    return _serpentine(spark, sf_dir)


@query(f"{_SERPENTINE} SELECT shard::INTEGER AS shard, count(*) AS n, sum(duration)::BIGINT AS total FROM s GROUP BY 1")
def shard_balance(spark, sf_dir):
    return sharding.balance(_serpentine(spark, sf_dir))


@query(f"{_SERPENTINE} SELECT id, shard::INTEGER AS shard FROM s WHERE shard >= 3 AND shard < 7")
def shard_range(spark, sf_dir):
    return sharding.shard_range(_serpentine(spark, sf_dir), 3, 7).select("id", "shard")


@query("WITH t AS (SELECT o_orderstatus AS dataset, count(*) AS n FROM orders GROUP BY 1) SELECT dataset, n, CASE WHEN ceil(n / 100.0) <= 1 THEN 1 ELSE (2 ** ceil(log2(ceil(n / 100.0))))::BIGINT END AS shards FROM t")
def pow2_plan(spark, sf_dir):
    known = table(spark, sf_dir, "orders").groupBy("o_orderstatus").count().collect()  # one row per dataset
    return spark.createDataFrame([(r[0], r[1], sharding.shard_count(r[1], 0, samples_per_tar=100)) for r in known], "dataset string, n long, shards long")


@query("SELECT (n_chars // 100)::BIGINT AS second, count(*) AS n, sum(n_chars)::BIGINT AS hundredths FROM documents GROUP BY 1")
def duration_histogram(spark, sf_dir):
    rows = utterances(spark, sf_dir).select((F.col("length") / 100).alias("duration"))
    return stats.duration_histogram(rows).select("second", "n", F.round(F.col("seconds") * 100).cast("long").alias("hundredths"))


@query(f"{_SERPENTINE} SELECT printf('/tars/audio/set.%08d.tar /tars/txt/set.%08d.jsonl %.3f %d', shard, shard, sum(duration) / 360000.0, count(*)) AS value FROM s GROUP BY shard")
def lst_lines(spark, sf_dir):
    b = sharding.balance(_serpentine(spark, sf_dir))
    name = text.shard_name("set", F.col("shard"))
    rows = b.select(F.concat(F.lit("/tars/audio/"), name, F.lit(".tar")).alias("audio_tar"), F.concat(F.lit("/tars/txt/"), name, F.lit(".jsonl")).alias("manifest"), (F.col("total") / 360000.0).alias("hours"), F.col("n").alias("num_samples"))
    return sinks.list_lines(rows).select("value")


@query("SELECT page_id, concat('/d/', md5(url), CASE WHEN page_id % 3 = 0 THEN '.tar' WHEN page_id % 3 = 1 THEN '.tar.gz' ELSE '.v1.bin' END) AS audio_tar, CASE WHEN page_id % 3 = 2 THEN md5(url) || '.v1' ELSE md5(url) END AS key FROM pages")
def shard_key_parse(spark, sf_dir):
    end = F.when(F.col("page_id") % 3 == 0, ".tar").when(F.col("page_id") % 3 == 1, ".tar.gz").otherwise(".v1.bin")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/d/"), F.md5(F.col("url").cast("binary")), end).alias("audio_tar"))
    return rows.withColumn("key", text.shard_key(F.col("audio_tar")))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'txt/' || substr(url, 9) END AS key FROM pages")
def prefix_map(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.map_prefix(F.col("url"), "https://", "txt/").alias("key"))


@query("SELECT page_id, md5(url) AS key, CASE WHEN page_id % 4 < 3 THEN '/m/' || md5(url) || CASE WHEN page_id % 4 = 0 THEN '.jsonl' ELSE '.json' END END AS manifest FROM pages")
def manifest_pairs(spark, sf_dir):
    from wavelot.plans.build import pair_manifests

    pages = table(spark, sf_dir, "pages").select("page_id", F.md5(F.col("url").cast("binary")).alias("k"))
    path = lambda folder, e: F.concat(F.lit(folder), "k", F.lit(e)).alias("path")
    tars = pages.select("page_id", path("/a/", ".tar"))
    lines, plain = pages.where("page_id % 4 in (0, 2)"), pages.where("page_id % 4 < 3 and page_id % 4 != 0")
    manifests = lines.select("page_id", path("/m/", ".jsonl")).unionByName(plain.select("page_id", path("/m/", ".json")))
    # pages may share a url, and so a key; each is a folder of its own
    return pair_manifests(tars, manifests, within=["page_id"]).select("page_id", "key", "manifest")


@query("SELECT doc_id, source || '.' || doc_id || '.WAV' AS name, source || '.' || doc_id AS key, 'wav' AS ext FROM documents")
def sample_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("."), F.col("doc_id").cast("string"), F.lit(".WAV")).alias("name"))
    return rows.withColumns({"key": text.sample_key(F.col("name")), "ext": text.sample_ext(F.col("name"))})


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '你好世界 ' || lang WHEN 1 THEN lang || ' 你 ' || lang WHEN 2 THEN lang || ' ' || source ELSE '한국 ' || lang || ' x 日本' END AS text FROM documents")
def text_norm(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" 你 好　世\t界"), "lang")).when(F.col("doc_id") % 4 == 1, F.concat("lang", F.lit("你"), "lang")).when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" "), "lang", F.lit(" "), "source", F.lit("  "))).otherwise(F.concat(F.lit("한 국"), "lang", F.lit(" x "), F.lit("日 本")))
    return table(spark, sf_dir, "documents").select("doc_id", text.normal_text(raw).alias("text"))


# -- arrays


def waves(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("audio"))


@query("SELECT vec_id, 70::BIGINT AS size, round(sum(x::DOUBLE), 6) AS total FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
def pad_arrays(spark, sf_dir):
    padded = waves(spark, sf_dir).select("vec_id", arrays.pad_right(F.col("audio"), F.lit(70)).alias("a"))
    return padded.select("vec_id", F.size("a").cast("long").alias("size"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 9) AS rms FROM embeddings")
def rms(spark, sf_dir):
    return waves(spark, sf_dir).select("vec_id", F.round(arrays.rms(F.col("audio")), 9).alias("rms"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 10.0 ** (((vec_id % 17) - 10) / 20.0))::FLOAT::DOUBLE)), 4) AS total FROM embeddings")
def gain(spark, sf_dir):
    none = F.lit(None).cast("double")
    louder = samples.change_audio("audio", none, ((F.col("vec_id") % 17) - 10).cast("double"), F.lit(None).cast("array<float>"), none, none)
    return waves(spark, sf_dir).select("vec_id", F.round(F.aggregate(louder, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("""
WITH e AS (SELECT vec_id, embedding AS a, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS p FROM embeddings)
SELECT s.vec_id, round(10 * log10(s.p / list_sum(list_transform(n.a, lambda x: (x * sqrt(s.p / 64) / (10.0 ** (15 / 20.0) * sqrt(n.p / 64) + 1e-8)) ** 2))), 3) AS snr_db
FROM e s JOIN e n ON n.vec_id = (s.vec_id + 1) % (SELECT count(*) FROM embeddings)""")
def snr_mix(spark, sf_dir):
    """The ratio that mixing at 15 dB really gives."""
    w = waves(spark, sf_dir)
    n = w.count()
    paired = w.join(w.select(F.col("vec_id").alias("n_id"), F.col("audio").alias("noise")), F.col("n_id") == F.pmod(F.col("vec_id") + 1, F.lit(n)))
    none = F.lit(None).cast("double")
    mixed = samples.change_audio("audio", none, none, "noise", F.lit(15.0), F.lit(0.0))
    left = F.zip_with(mixed, "audio", lambda m, a: m.cast("double") - a.cast("double"))
    return paired.select("vec_id", F.round(10 * F.log10(arrays.energy(F.col("audio")) / arrays.energy(left)), 3).alias("snr_db"))


@query("SELECT vec_id, (vec_id % 150 + 1)::BIGINT AS size, round(CASE WHEN vec_id % 150 + 1 > 64 THEN embedding[((vec_id % 150) % 64 + 1)::INTEGER] ELSE embedding[(vec_id % 150 + 1 + least(3, 64 - (vec_id % 150 + 1)))::INTEGER] END::DOUBLE, 6) AS last FROM embeddings")
def noise_tile(spark, sf_dir):
    want = F.col("vec_id") % 150 + 1
    fitted = arrays.fit_noise(F.col("audio"), want, F.least(F.lit(3), F.greatest(F.lit(0), 64 - want)))
    return waves(spark, sf_dir).select("vec_id", F.size(fitted).cast("long").alias("size"), F.round(F.element_at(fitted, -1).cast("double"), 6).alias("last"))


@query("""
WITH n AS (SELECT count(*) AS n FROM benchmark), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('noise9|' || doc_id), doc_id) - 1 AS i FROM documents),
t AS (SELECT *, i // n AS turn FROM r, n),
h AS (SELECT *, ('0x' || substr(md5('step9|' || turn), 1, 15))::BIGINT % 8 AS s, ('0x' || substr(md5('shift9|' || turn), 1, 15))::BIGINT % n AS shift FROM t)
SELECT doc_id, (([2147483659, 2147483693, 2147483713, 2147483743, 2147483777, 2147483783, 2147483813, 2147483857][s + 1] % n) * (i % n) + shift) % n AS idx FROM h""")
def noise_pairing(spark, sf_dir):
    pool = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), order_key(1, "item_id").alias("k"))
    noise = shuffled_rank(pool, "k", ["id"], name="idx").select(F.lit("all").alias("dataset"), "idx", F.lit(pool.count()).alias("n"), F.col("idx").alias("entry"))
    paired = samples.pair_noise(table(spark, sf_dir, "documents").select("doc_id", F.lit("all").alias("noise_of")), noise, 9, ["doc_id"])
    return paired.select("doc_id", F.col("noise_entry").alias("idx"))


@query("SELECT label, vec_id // 8 AS batch_id, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids, count(*) AS n, max(len(list_filter(embedding, lambda x: x > 0)))::BIGINT AS longest, (max(len(list_filter(embedding, lambda x: x > 0))) * count(*))::BIGINT AS cells FROM embeddings GROUP BY 1, 2")
def collate_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 8).alias("batch_id"), "vec_id", F.filter("embedding", lambda x: x > 0).alias("audio"))
    done = collate(rows, ["label", "batch_id"], ["vec_id"], {"ids": "vec_id"}, ["audio"])
    cells = F.aggregate(F.transform("audio", lambda a: F.size(a)), F.lit(0), lambda s, x: s + x).cast("long")
    return done.select("label", "batch_id", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), F.size("ids").cast("long").alias("n"), F.array_max("audio_lens").cast("long").alias("longest"), cells.alias("cells"))


@query("SELECT doc_id, length(text) >= 500 AS long, upper(lang) AS lang FROM documents WHERE n_chars BETWEEN 10 AND 6000 AND lang <> 'de'")
def map_then_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.col("n_chars").between(LOW, HIGH))
    mapped = samples.apply_map(rows, lambda d: d.select("doc_id", (F.length("text") >= 500).alias("long"), F.upper("lang").alias("lang")))
    return samples.apply_filter(mapped, F.col("lang") != "DE")


@query("WITH s AS (SELECT (row_number() OVER (ORDER BY page_id) - 1)::BIGINT AS i, md5(url) AS tar FROM pages) SELECT count(*) AS shards, (ceil(count(*) / 48.0) * 48)::BIGINT AS padded FROM s")
def padded_shards(spark, sf_dir):
    from wavelot.sources.audiotar import pad_shards

    shards = table(spark, sf_dir, "pages").select("page_id", F.md5(F.col("url").cast("binary")).alias("audio_tar"))
    return shards.agg(F.count("*").alias("shards")).join(pad_shards(shards, 48, "page_id").agg(F.count("*").alias("padded")))


# -- audio


def repeated_waves(spark, sf_dir):
    """Embeddings twenty times over, so that they make frames."""
    return waves(spark, sf_dir).select("vec_id", F.flatten(F.array_repeat("audio", 20)).alias("audio"))


def _feature_summary(rows, name):
    from wavelot.functions.features import extractor, features

    rows = rows.select("vec_id", features(F.col("audio"), extractor(name)).alias("f"))
    middle = F.element_at("f", (F.size("f") / 2 + 1).cast("int"))
    return rows.select("vec_id", F.size("f").alias("frames"), F.size(F.element_at("f", 1)).alias("bins"), (F.array_position(middle, F.array_max(middle)) - 1).alias("loudest_bin"), F.round(F.array_max(middle).cast("double"), 2).alias("loudest"))


def _frame_sql(begin: int, frames: int, weighted: str, n_fft: int, spectrum: str, corners: str, place: str, floor: float) -> str:
    """The loudest filter of the frame of 400 samples that begins at `begin`, by sums over the definition. weighted: samples (i, x) of a vector after windowing, from r;
    spectrum: of re and im; corners: the j-th corner of 82 filters' edges; place: where the k-th frequency f lies on the same scale."""
    return f"""
WITH i AS (SELECT range AS i FROM range(400)), k AS (SELECT range AS k FROM range({n_fft // 2})),
r AS (SELECT vec_id, i, embedding[(({begin} + i) % 64 + 1)::INTEGER]::DOUBLE AS x FROM embeddings, i), w AS ({weighted}),
t AS (SELECT k, i, cos(2 * pi() * k * i / {n_fft}) AS c, sin(2 * pi() * k * i / {n_fft}) AS s FROM k, i),
d AS (SELECT vec_id, k, sum(x * c) AS re, sum(x * s) AS im FROM w JOIN t USING (i) GROUP BY 1, 2), p AS (SELECT vec_id, k, {spectrum} AS a FROM d),
e AS (SELECT range AS j, {corners} AS at FROM range(82)),
m AS (SELECT l.j AS bin, k, greatest(0, least((f - l.at) / (c.at - l.at), (h.at - f) / (h.at - c.at))) AS g FROM (SELECT k, {place} AS f FROM k), e l JOIN e c ON c.j = l.j + 1 JOIN e h ON h.j = l.j + 2),
o AS (SELECT vec_id, bin, ln(greatest(sum(a * g), {floor})) AS y FROM p JOIN (SELECT * FROM m WHERE g > 0) USING (k) GROUP BY 1, 2)
SELECT vec_id, {frames}::INTEGER AS frames, 80::INTEGER AS bins, arg_max(bin, y)::BIGINT AS loudest_bin, round(max(y), 2) AS loudest FROM o GROUP BY 1"""


@query(_frame_sql(440, 9, "SELECT vec_id, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 400)) AS x FROM r", 400, "sqrt(re * re + im * im)", "700 * (10 ** (range * (2595 * log10(1 + 8000 / 700.0)) / 81 / 2595) - 1)", "k * 40.0", 1e-7))
def fbank_features(spark, sf_dir):
    return _feature_summary(repeated_waves(spark, sf_dir), "Fbank")


@query(_frame_sql(520, 8, """SELECT vec_id, i, (x - 0.97 * coalesce(lag(x) OVER (PARTITION BY vec_id ORDER BY i), x)) * (0.5 - 0.5 * cos(2 * pi() * i / 399)) ** 0.85 AS x
  FROM (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM r)""", 512, "re * re + im * im", "1127 * ln(1 + 20 / 700.0) + range * (1127 * ln(1 + 7600 / 700.0) - 1127 * ln(1 + 20 / 700.0)) / 81", "1127 * ln(1 + k * 31.25 / 700)", 1.1920928955078125e-07))
def kaldi_features(spark, sf_dir):
    return _feature_summary(repeated_waves(spark, sf_dir), "KaldiFbank")


@query()
def whisper_features(spark, sf_dir):
    return _feature_summary(repeated_waves(spark, sf_dir), "WhisperFbank")


@query()
def spec_augment(spark, sf_dir):
    from wavelot.functions.features import SpecAugment, extractor, features
    from wavelot.functions.features import spec_augment as change

    rows = repeated_waves(spark, sf_dir).select("vec_id", features(F.col("audio"), extractor("Fbank")).alias("f"))
    out = rows.select("vec_id", "f", change(F.col("f"), F.xxhash64("vec_id"), SpecAugment(time_warp_factor=4)).alias("g"))
    return out.select("vec_id", F.size("g").alias("frames"), (F.col("f") == F.col("g")).alias("same"))


@query("""
WITH u AS (SELECT vec_id, len(embedding) AS n, [0.9, 1.0, 1.1][(floor((('0x' || substr(md5('speed3|' || vec_id), 1, 12))::BIGINT + 0.5) / 281474976710656 * 3) + 1)::INTEGER] AS speed FROM embeddings)
SELECT vec_id, speed::DOUBLE AS speed, ((n * floor(speed * 16000)::BIGINT + 15999) // 16000)::INTEGER AS samples, ((n * floor(speed * 16000)::BIGINT + 15999) // 16000)::BIGINT AS planned FROM u""")
def speed_perturb(spark, sf_dir):
    """The speed that each vector draws, how long it is afterwards, and the length that batches are planned with."""
    from wavelot.options import Augment

    options = Augment(speed=True)
    rows = waves(spark, sf_dir).withColumn("speed", samples.speed_of(options, 3, ["vec_id"], 16000)).withColumn("planned", samples.length_at_speed(F.size("audio").cast("long"), F.col("speed"), 16000))
    return samples.augment(rows, options, 3, ["vec_id"]).select("vec_id", "speed", F.size("audio").alias("samples"), "planned")


def embedding_tars(spark, sf_dir, rate: int = 8000, shards: int = 16) -> list[str]:
    """Embeddings as tar shards in the shared folder: the first 8 + vec_id % 57 numbers as 16-bit samples in <vec_id>.wav with the label as text, and for every
    third vector an MP3 entry before it that holds no audio. Returns the shards' tars; manifests and done files lie beside them."""
    from wavelot.functions.audio import encode_wav
    from wavelot.sources.scratch import shared_folder
    from wavelot.sources.tarsink import PACKED, shard_files

    def wav(batches):
        for pdf in batches:
            pdf["bytes"] = [encode_wav(a, rate) for a in pdf["audio"]]
            yield pdf.drop(columns="audio")

    folder = shared_folder(spark, "tars")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"), F.slice("embedding", 1, (8 + F.col("vec_id") % 57).cast("int")).alias("audio"))
    shard, key, none = (F.col("vec_id") % shards).cast("int").alias("shard"), F.col("vec_id").cast("string"), F.lit(None).cast("string").alias("error")
    good = rows.select(shard, F.concat(key, F.lit(".wav")).alias("name"), "text", (F.size("audio") / rate).alias("seconds"), none, "audio")
    good = good.mapInPandas(wav, "shard int, name string, text string, seconds double, error string, bytes binary")
    other = rows.where("vec_id % 3 = 0").select(shard, F.concat(key, F.lit(".mp3")).alias("name"), "text", F.lit(0.0).alias("seconds"), none, F.encode(F.lit("no audio"), "utf-8").alias("bytes"))
    columns = [x.split()[0] for x in PACKED.split(", ")]
    sinks.write_tars(good.select(*columns).unionByName(other.select(*columns)).repartition(shards, "shard").sortWithinPartitions("shard", "name"), folder, "set")
    used = [r["shard"] for r in rows.select(shard).distinct().orderBy("shard").collect()]  # one row per shard
    return [shard_files(folder, "set", x, 8)[0] for x in used]


def _shard_of():
    return F.regexp_extract("url", r"(\d+)\.tar$", 1).cast("int").alias("shard")


_SAMPLES = "list_transform(embedding[1:(8 + vec_id % 57)::INTEGER], lambda x: greatest(-32768, least(32767, round_even(x::DOUBLE * 32768, 0))) / 32768)"


@query("""
WITH e AS (SELECT vec_id, 'wav' AS ext, 44 + 2 * (8 + vec_id % 57) AS size, 8 + vec_id % 57 AS frames FROM embeddings UNION ALL SELECT vec_id, 'mp3', 8, NULL FROM embeddings WHERE vec_id % 3 = 0)
SELECT (vec_id % 16)::INTEGER AS shard, ext, count(*) AS n, sum(size)::BIGINT AS size, sum(frames)::BIGINT AS frames, count(*) - count(frames) AS unreadable FROM e GROUP BY ALL""")
def tar_index(spark, sf_dir):
    """The member index of tar shards: entries, their bytes and what their headers tell."""
    from wavelot.sources.tarindex import index_tars

    index = index_tars(embedding_tars(spark, sf_dir), spark)
    return index.groupBy(_shard_of(), "ext").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("frames").alias("frames"), F.count("error").alias("unreadable"))


@query(f"""
SELECT (vec_id % 16)::INTEGER AS shard, vec_id::VARCHAR AS key, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS formats, (8 + vec_id % 57)::BIGINT AS frames, (8 + vec_id % 57) / 8000.0 AS length_s,
  round(sqrt(list_sum(list_transform({_SAMPLES}, lambda x: x * x)) / (8 + vec_id % 57)), 6) AS rms FROM embeddings""")
def tar_round_trip(spark, sf_dir):
    """Vectors written into tars by tasks, found through the index, formats chosen on it, read by byte ranges and decoded."""
    from wavelot.sources.tarindex import choose_formats, index_tars, read_ranges

    index = index_tars(embedding_tars(spark, sf_dir), spark, ("wav", "mp3"))
    formats = index.groupBy("url", "key").agg(F.count("*").alias("formats"))
    chosen = choose_formats(index, ("wav", "mp3")).join(formats, ["url", "key"])
    rows = samples.decode(read_ranges(chosen, split_bytes=1 << 16).drop("error"), 8000)
    return rows.select(_shard_of(), "key", "formats", F.size("audio").cast("long").alias("frames"), "length_s", F.round(arrays.rms(F.col("audio")), 6).alias("rms"))


_LOADED = f"""SELECT vec_id AS doc_id, 0 AS worker, floor(((8 + vec_id % 57) / 100.0::DOUBLE - 0.1::DOUBLE) * 5 / 0.5::DOUBLE)::INTEGER AS bucket_id, printf('%08d', vec_id % 16) || '.tar/' || vec_id AS seq, (8 + vec_id % 57) / 100.0::DOUBLE AS length
  FROM embeddings WHERE 8 + vec_id % 57 BETWEEN 10 AND 60"""


@query(_greedy_sql(_LOADED, "worker, bucket_id", 5.0, 16, _flush_sql(5.0, 16) + f""", b AS ({_FLUSHED.format("worker")}),
e AS (SELECT vec_id AS doc_id, label, list_sum(list_transform({_SAMPLES}, lambda x: x * x)) AS energy FROM embeddings)
SELECT b.bucket_id, b.batch_id, b.flushed, string_agg(b.doc_id::VARCHAR, ',' ORDER BY s.seq) AS ids, max(round(s.length * 100))::BIGINT AS longest, arg_min('label ' || e.label, s.seq) AS first_text, round(sum(e.energy), 4) AS energy
FROM b JOIN s USING (doc_id) JOIN e USING (doc_id) GROUP BY 1, 2, 3"""))
def loader_test_pass(spark, sf_dir):
    """The loader over tars made from vectors: every sample once in padded batches, with the flush at the end."""
    from wavelot.options import Batching, LoaderOptions
    from wavelot.plans.loader import Loader
    from wavelot.sources.files import put_lines

    tars = embedding_tars(spark, sf_dir, 100)
    lst = tars[0].rsplit("/audio/", 1)[0] + "/set.lst"
    put_lines(lst, [f"{t} {t.replace('/audio/', '/txt/').removesuffix('.tar')}.jsonl" for t in tars])
    options = LoaderOptions(batching=Batching(max_duration=5.0, max_samples=16, min_length=0.1, max_length=0.6, num_buckets=6), sample_rate=100, feature_type=None, workers=1, is_test=True)
    done = Loader(spark, [lst], options).batches()
    energy = F.aggregate(F.transform("audio", lambda a: arrays.energy(a)), F.lit(0.0), lambda s, x: s + x)
    return done.select("bucket_id", "batch_id", "flushed", F.array_join("ids", ",").alias("ids"), F.array_max("audio_lens").cast("long").alias("longest"), F.get("text", F.lit(0)).alias("first_text"), F.round(energy, 4).alias("energy"))


_EVENTS = "SELECT event_id AS doc_id, (user_id % 4)::INTEGER AS worker, floor(least(value, 99) / 20)::INTEGER AS bucket_id, (event_id % 3)::BIGINT * 1000000000000 + event_id AS seq, value AS length FROM events"


@query(_greedy_sql(_EVENTS, "worker, bucket_id", 2000, 50, """, last AS (SELECT worker, bucket_id, max(batch_id) AS last FROM f GROUP BY ALL)
SELECT f.worker, f.bucket_id, f.batch_id, string_agg(f.doc_id::VARCHAR, ',' ORDER BY f.rn) AS ids, count(*) AS n, max(f.length) AS longest, round(sum(f.length), 6) AS total, f.batch_id = last.last AS flushed FROM f JOIN last USING (worker, bucket_id) GROUP BY 1, 2, 3, 8"""))
def stream_batches(spark, sf_dir):
    """Events as a live stream of three micro-batches into state-backed batches, and a fourth that gives up the open ones."""
    from wavelot.sources.scratch import run_stream
    from wavelot.streaming.batcher import stream_batches as batch

    events = table(spark, sf_dir, "events")
    rows = events.select(F.pmod("user_id", F.lit(4)).cast("int").alias("worker"), F.floor(F.least("value", F.lit(99.0)) / 20).cast("int").alias("bucket_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.col("value").alias("length"))
    ends = rows.select("worker", "bucket_id").distinct().select("worker", "bucket_id", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("length"))
    done = run_stream(lambda live: batch(live, 2000.0, 50), [*(rows.where(F.col("seq") % 3 == k) for k in range(3)), ends])
    return done.withColumns({"ids": F.array_join("ids", ","), "total": F.round("total", 6)})
