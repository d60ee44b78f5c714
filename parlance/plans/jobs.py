"""Queries of job records, accounts, settings, messages, index facts, trees and event protocols, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import intent, status, text, validate, vector
from parlance.operators import index, names, retrieve, stitch, store, summarize, tree
from parlance.plans.queries import COS, HMS, NODES, VEC, asked
from parlance.plans.registry import SEG, query, segments, t
from parlance.sources import transcripts
from parlance.streaming import events as ev

STATES = tuple(status.NEXT)
STATE_SQL = "[" + ", ".join(f"'{s}'" for s in STATES) + "][{0} % 9 + 1]"


def state(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), (n % 9 + 1).cast("int"))


def listed(x: Column) -> Column:
    return F.array_join(x.cast("array<string>"), ",")


# --- checks of rows ---


@query("""WITH u AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'a.b.WAV' WHEN 1 THEN 'talk.mp3' WHEN 2 THEN 'notes.txt' WHEN 3 THEN '' ELSE NULL END AS f, c_custkey * 4000000 AS size,
  CASE c_custkey % 3 WHEN 0 THEN 'audio/wav' WHEN 1 THEN 'video/mp4' ELSE 'text/plain' END AS mime, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 23 END AS speakers FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN coalesce(f, '') = '' THEN 'filename' END, CASE WHEN NOT coalesce(regexp_matches(lower(f), '\\.(wav|mp3|m4a|flac|ogg|mp4|webm)$'), false) THEN 'extension' END,
  CASE WHEN size > 524288000 THEN 'size' END, CASE WHEN mime = 'text/plain' THEN 'mime' END, CASE WHEN speakers NOT BETWEEN 1 AND 20 THEN 'speakers' END) AS errors FROM u""")
def upload_checks(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "a.b.WAV").when(k % 5 == 1, "talk.mp3").when(k % 5 == 2, "notes.txt").when(k % 5 == 3, "")
    mime = F.when(k % 3 == 0, "audio/wav").when(k % 3 == 1, "video/mp4").otherwise("text/plain")
    errors = validate.upload_errors(name, k * 4000000, mime, F.when(k % 7 != 0, k % 23))
    return t(spark, d, "customer").select("c_custkey", listed(errors).alias("errors"))


@query("""WITH w AS (SELECT c_custkey, 'n' || c_custkey % 40 AS username, CASE WHEN c_custkey % 3 = 0 THEN 'a b@x.org' WHEN c_custkey % 3 = 1 THEN 'm' || c_custkey % 50 || '@x.org' ELSE 'm@x' END AS email, repeat('p', c_custkey % 12) AS password FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN length(password) < 8 THEN 'password' END, CASE WHEN NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'email' END,
  CASE WHEN username IN (SELECT 'n' || s_suppkey FROM supplier WHERE s_suppkey < 20) THEN 'username_taken' END, CASE WHEN email IN (SELECT 'm' || s_suppkey || '@x.org' FROM supplier WHERE s_suppkey < 20) THEN 'email_taken' END) AS errors FROM w""")
def account_checks(spark, d):
    k = F.col("c_custkey")
    mail = F.when(k % 3 == 0, "a b@x.org").when(k % 3 == 1, F.concat(F.lit("m"), (k % 50).cast("string"), F.lit("@x.org"))).otherwise("m@x")
    wanted = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), (k % 40).cast("string")).alias("username"), mail.alias("email"), F.repeat(F.lit("p"), (k % 12).cast("int")).alias("password"))
    s = F.col("s_suppkey").cast("string")
    have = t(spark, d, "supplier").where("s_suppkey < 20").select(F.concat(F.lit("n"), s).alias("username"), F.concat(F.lit("m"), s, F.lit("@x.org")).alias("email"))
    return validate.new_accounts(wanted, have).select("c_custkey", listed(F.col("errors")).alias("errors"))


@query("""WITH p AS (SELECT event_id, event_type, ts, CASE event_id % 4 WHEN 0 THEN '/up/' || event_type || '.tar.GZ' WHEN 1 THEN event_type WHEN 2 THEN '.hidden' ELSE 'a/b.c/' || event_id || '.Wav' END AS path, event_id % 900 / 7.0::DOUBLE AS s FROM events)
SELECT event_id, substr('job' || event_id || '-0123456789', 1, 8) AS collection, CASE event_id % 4 WHEN 0 THEN event_type || '.tar' WHEN 1 THEN event_type WHEN 2 THEN '.hidden' ELSE event_id::VARCHAR END AS stem,
CASE event_id % 4 WHEN 0 THEN '.gz' WHEN 3 THEN '.wav' ELSE '' END AS suffix, CASE WHEN s = 0 THEN '—' ELSE printf('%d:%02d.%d', round_even(s * 10, 0)::BIGINT // 600, round_even(s * 10, 0)::BIGINT % 600 // 10, round_even(s * 10, 0)::BIGINT % 10) END AS tenths,
strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS iso, strftime(ts, '%Y-%m-%d %H:%M') AS minute, sha256('m|' || path || '{"a": ' || event_id || ', "lang": "' || event_type || '"}') AS cache_key FROM p""")
def text_helpers(spark, d):
    e, kind = F.col("event_id"), F.col("event_type")
    path = F.when(e % 4 == 0, F.concat(F.lit("/up/"), kind, F.lit(".tar.GZ"))).when(e % 4 == 1, kind).when(e % 4 == 2, ".hidden").otherwise(F.concat(F.lit("a/b.c/"), e.cast("string"), F.lit(".Wav")))
    name = F.concat(F.lit("job"), e.cast("string"), F.lit("-0123456789"))
    ts = F.col("ts").cast("timestamp")
    return t(spark, d, "events").select(
        "event_id", text.collection_name(name).alias("collection"), text.stem(path).alias("stem"), text.suffix(path).alias("suffix"), text.minutes_tenths(e % 900 / 7.0).alias("tenths"),
        text.iso_utc(ts).alias("iso"), text.minute_stamp(ts).alias("minute"), text.cache_key(F.lit("m"), path, {"lang": kind, "a": e}).alias("cache_key"),
    )


@query("""WITH s AS (SELECT event_id, ['transcribing', 'diarizing', 'indexing', 'pageindex', 'reindexing', 'other'][event_id % 6 + 1] AS stage, (event_id % 101)::DOUBLE AS pct FROM events)
SELECT event_id, CASE stage WHEN 'transcribing' THEN pct * 0.4::DOUBLE WHEN 'diarizing' THEN 40 + pct * 0.25::DOUBLE WHEN 'indexing' THEN 78 + pct * 0.17::DOUBLE WHEN 'pageindex' THEN 95 + pct * 0.04::DOUBLE WHEN 'reindexing' THEN 20 + pct * 0.75::DOUBLE ELSE pct END AS overall,
CASE WHEN event_id % 3 > 0 THEN 40 + (event_id % 101) / (event_id % 3 * 200)::DOUBLE * 45 ELSE least(84, 40 + 2 * (event_id % 101))::DOUBLE END AS embedded, CASE WHEN event_id % 4 = 0 THEN pct ELSE event_id % 4 END::DOUBLE AS shown,
CASE WHEN event_id % 5 = 0 THEN 600.0 ELSE greatest(1.0, least(600.0, greatest(1.0, floor(1000000 / (event_id % 5 * 1000 * 0.8::DOUBLE))))) END::DOUBLE AS seconds FROM s""")
def progress_of_stages(spark, d):
    e = F.col("event_id")
    stage = F.element_at(F.array(*[F.lit(x) for x in ("transcribing", "diarizing", "indexing", "pageindex", "reindexing", "other")]), (e % 6 + 1).cast("int"))
    pct, rate = (e % 101).cast("double"), (e % 5 * 1000).cast("double")
    return t(spark, d, "events").select(
        "event_id", status.scaled_progress(stage, pct).alias("overall"), status.embed_progress(e % 101, e % 3 * 200).alias("embedded"),
        status.shown_progress((e % 4).cast("double"), pct).alias("shown"), stitch.safe_chunk_seconds(F.lit(600.0), rate, 1_000_000).alias("seconds"),
    )


SETTING = "CASE event_id % 12 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'off' WHEN 2 THEN 'yes' WHEN 3 THEN '42' WHEN 4 THEN 'x1' WHEN 5 THEN '2.5' WHEN 6 THEN '' WHEN 7 THEN 'None' WHEN 8 THEN 'null' WHEN 9 THEN 'on' WHEN 10 THEN '-7' ELSE event_type END"


@query(f"""SELECT event_id, CASE kind WHEN 'bool' THEN (lower(trim(v)) IN ('true', '1', 'yes', 'on'))::VARCHAR WHEN 'int' THEN CASE WHEN regexp_matches(v, '^-?[0-9]+$') THEN v END
WHEN 'float' THEN TRY_CAST(v AS DOUBLE)::VARCHAR ELSE CASE WHEN lower(trim(v)) IN ('none', 'null', '') THEN NULL ELSE v END END AS setting
FROM (SELECT event_id, ['bool', 'int', 'float', 'str'][event_id % 4 + 1] AS kind, {SETTING.replace("event_id % 12", "event_id // 4 % 12")} AS v FROM events)""")
def setting_values(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("bool", "int", "float", "str")]), (F.col("event_id") % 4 + 1).cast("int"))
    return t(spark, d, "events").select("event_id", text.setting(kind, F.expr(SETTING.replace("event_id % 12", "event_id div 4 % 12"))).alias("setting"))


@query("""SELECT n_name AS key, CASE WHEN n_name = 'CHINA' THEN '' WHEN n_name = 'JAPAN' THEN '••••••••' WHEN n_nationkey % 2 = 0 THEN 'own' || n_nationkey ELSE 'd' || n_regionkey END AS value FROM nation""")
def settings_listing(spark, d):
    n = t(spark, d, "nation")
    own = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("key"), F.concat(F.lit("own"), F.col("n_nationkey").cast("string")).alias("value"))
    return transcripts.settings_overlay(n.select(F.col("n_name").alias("key"), F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("value")), own, ("CHINA",), ("JAPAN",))


@query("""SELECT r_name AS "group", string_agg(n_name || '=' || n_nationkey, ',' ORDER BY n_name) AS listed FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def settings_by_group(spark, d):
    rows = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return store.settings_by_group(rows.select(F.col("r_name").alias("group"), F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))).select("group", "listed")


@query(f"""SELECT o_orderkey, s IN ('pending', 'transcribing', 'diarizing', 'aligning', 'indexing', 'reindexing') AS cancellable, s IN ('failed', 'cancelled') AS restartable, s IN ('completed', 'reindexing', 'failed') AS downloadable,
s IN ('completed', 'failed') AS reindexable, s = 'completed' AND o_orderkey % 2 = 0 AS searchable FROM (SELECT o_orderkey, {STATE_SQL.format("o_orderkey")} AS s FROM orders)""")
def status_sets(spark, d):
    s = state(F.col("o_orderkey"))
    has = F.when(F.col("o_orderkey") % 2 == 0, "dir").when(F.col("o_orderkey") % 3 == 0, "")
    return t(spark, d, "orders").select("o_orderkey", status.cancellable(s).alias("cancellable"), status.restartable(s).alias("restartable"), status.downloadable(s).alias("downloadable"), status.reindexable(s).alias("reindexable"), status.searchable(s, has).alias("searchable"))


ALLOWED = " OR ".join(f"(before = '{a}' AND status IN ({', '.join(repr(b) for b in bs)}))" for a, bs in status.NEXT.items())


@query(f"""WITH l AS (SELECT user_id AS job_id, event_id AS seq, {STATE_SQL.format("(event_id * 7)")} AS status FROM events), p AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM l)
SELECT job_id, seq, before, status FROM p WHERE before IS NOT NULL AND before <> status AND NOT ({ALLOWED})""")
def illegal_transitions_all(spark, d):
    log = t(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), state(F.col("event_id") * 7).alias("status"))
    return status.illegal_transitions(log).select("job_id", "seq", "before", "status")


@query(f"""WITH l AS (SELECT user_id AS job_id, event_id AS seq, {STATE_SQL.format("(event_id * 7)")} AS status, floor(epoch(ts))::BIGINT AS ts FROM events)
SELECT job_id, arg_max(status, seq) AS status, coalesce(arg_min(ts, seq) FILTER (status = 'transcribing'), -1) AS started_at, CASE WHEN arg_max(status, seq) IN ('completed', 'failed') THEN arg_max(ts, seq) ELSE -1 END AS completed_at FROM l GROUP BY job_id""")
def job_life_cycle(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    out = status.life_cycle(t(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), state(F.col("event_id") * 7).alias("status"), at.alias("ts")))
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("started_at", "completed_at")})


# --- the store ---


@query("""SELECT conv_id AS job_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, CASE WHEN turn % 3 = 0 THEN 0.0 ELSE turn END::DOUBLE AS "start", turn::DOUBLE + 1 AS "end", CASE WHEN turn % 4 = 1 THEN 'UNKNOWN' ELSE role END AS speaker,
CASE WHEN turn % 5 = 2 THEN '' ELSE text END AS text FROM conversations WHERE turn <> 1 OR conv_id % 2 = 0""")
def segment_rows(spark, d):
    k = F.col("turn")
    rows = t(spark, d, "conversations").where("turn <> 1 OR conv_id % 2 = 0")
    return store.segment_rows(rows.select(F.col("conv_id").alias("job_id"), k.alias("ord"), F.when(k % 3 != 0, k.cast("double")).alias("start"), (k + 1.0).alias("end"), F.when(k % 4 != 1, F.col("role")).alias("speaker"), F.when(k % 5 != 2, F.col("text")).alias("text")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 'told' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def point_updates(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    edits = rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("done").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 6 == 0, "told").alias("o_orderpriority"))
    return store.update_rows(rows, edits.unionByName(edits.limit(1).withColumn("o_orderkey", F.lit(-1).cast("bigint"))), ["o_orderkey"])


@query("SELECT count(*) AS renamed FROM conversations WHERE conv_id = 7 AND role = 'user'")
def rename_count(spark, d):
    return store.rename_count(segments(spark, d), 7, "user")


@query("SELECT conv_id AS session_id, count(*) AS deleted, (SELECT count(*) FROM conversations WHERE conv_id % 3 <> 0) AS kept FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1")
def delete_history(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    left, gone = store.delete_history(rows, rows.where("session_id % 3 = 0"))
    return gone.join(F.broadcast(left.agg(F.count(F.lit(1)).alias("kept"))))


@query("""SELECT conv_id AS session_id, turn AS id, CASE WHEN turn % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN turn % 3 = 0 THEN '[1]' END AS sources FROM conversations""")
def new_messages(spark, d):
    k = F.col("turn")
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), k.alias("id"), F.when(k % 2 == 1, "failed").alias("status"), F.when(k % 3 == 0, "[1]").when(k % 3 == 1, "[]").otherwise("").alias("sources"))
    return store.new_messages(rows)


@query("SELECT c_custkey AS job_id, 'pending' AS status, 0.0::DOUBLE AS progress, NULL::VARCHAR AS error, '[]' AS logs, 1::INTEGER AS transcript_version FROM customer")
def new_jobs(spark, d):
    return store.new_jobs(t(spark, d, "customer").select(F.col("c_custkey").alias("job_id")))


RESTART = f"SELECT o_orderkey AS job_id, {STATE_SQL.format('o_orderkey')} AS status FROM orders"


@query(f"""WITH j AS ({RESTART}), a AS (SELECT job_id FROM j WHERE status IN ('failed', 'cancelled') AND job_id % 2 = 0)
SELECT job_id, CASE WHEN job_id IN (FROM a) THEN 'pending' ELSE status END AS status, CASE WHEN job_id IN (FROM a) THEN 0.0 ELSE 50.0 END::DOUBLE AS progress, CASE WHEN job_id IN (FROM a) THEN NULL ELSE 'e' END AS error, CASE WHEN job_id IN (FROM a) THEN '[]' ELSE '[1]' END AS logs,
CASE WHEN job_id IN (FROM a) THEN 0 ELSE n END AS segments FROM j JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = job_id""")
def restart_jobs(spark, d):
    k = F.col("o_orderkey")
    jobs = t(spark, d, "orders").select(k.alias("job_id"), state(k).alias("status"), F.lit(50.0).alias("progress"), F.lit("e").alias("error"), F.lit("[1]").alias("logs"))
    parts = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber")
    out = store.restart_jobs({"jobs": jobs, "segments": parts}, jobs.where("job_id % 2 = 0"))
    n = out["segments"].groupBy("job_id").agg(F.count(F.lit(1)).alias("segments"))
    return out["jobs"].join(parts.select("job_id").distinct(), "job_id", "left_semi").join(n, "job_id", "left").withColumn("segments", F.coalesce("segments", F.lit(0)).cast("bigint"))


@query("SELECT l_orderkey AS job_id, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7")
def owned_rows(spark, d):
    jobs = t(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"))
    return store.owned(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber"), jobs, 7)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 11")
def lookup_by_key(spark, d):
    return store.by_key(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 11)


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'a,b' ELSE '' END AS sources, CASE WHEN turn % 2 = 0 THEN 'completed' ELSE 'failed' END AS status FROM conversations""")
def message_rows(spark, d):
    k = F.col("turn")
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.when(k % 3 == 0, '[{"text":"a"},{"text":"b"}]').when(k % 3 == 1, '[{"text":').alias("sources"), F.when(k % 2 == 1, "failed").when(k % 4 == 2, "").alias("status"))
    return store.message_rows(rows, "array<struct<text:string>>").withColumn("sources", listed(F.col("sources.text")))


@query(f"""SELECT count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'pending') AS queued, count(*) FILTER (s IN ('transcribing', 'diarizing', 'aligning', 'indexing', 'reindexing')) AS running,
min(o_orderkey) FILTER (s IN ('transcribing', 'diarizing', 'aligning', 'indexing', 'reindexing')) AS running_since FROM (SELECT o_orderkey, {STATE_SQL.format("o_orderkey")} AS s FROM orders)""")
def job_counters(spark, d):
    return store.job_counters(t(spark, d, "orders").select(state(F.col("o_orderkey")).alias("status"), F.col("o_orderkey").alias("started_at")))


@query("""WITH l AS (SELECT user_id AS job_id, event_id AS ord, CASE event_id % 3 WHEN 0 THEN [event_type, 'en'] WHEN 1 THEN ['de', event_type] ELSE ['l' || event_id % 5] END AS names FROM events),
n AS (SELECT job_id, ord, unnest(names) AS name, generate_subscripts(names, 1) AS place FROM l), f AS (SELECT job_id, name, min((ord, place)) AS seen FROM n GROUP BY ALL)
SELECT job_id, string_agg(name, ',' ORDER BY seen) AS languages FROM f GROUP BY job_id""")
def language_union(spark, d):
    e, kind = F.col("event_id"), F.col("event_type")
    none = F.array().cast("array<string>")
    rows = t(spark, d, "events").select(F.col("user_id").alias("job_id"), e.alias("ord"), F.when(e % 3 == 0, F.array(kind, F.lit("en"))).alias("inferred_languages"), F.when(e % 3 == 1, F.array(F.lit("de"), kind)).otherwise(none).alias("languages"), F.concat(F.lit("l"), (e % 5).cast("string")).alias("language"))
    return store.languages(rows).select("job_id", listed(F.col("languages")).alias("languages"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def pending_oldest(spark, d):
    return store.page(t(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 200)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name FROM customer UNION ALL SELECT -1, 'new'")
def upsert_rows(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = rows.where("id % 2 = 0").select("id", F.lit("new").alias("name"))
    return store.upsert(rows, new.unionByName(spark.range(1).select((F.col("id") - 1).alias("id"), F.lit("new").alias("name"))), ["id"])


@query("""WITH w AS (SELECT c_custkey AS id, 'n' || c_nationkey AS base, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
taken AS (SELECT 'n' || n_nationkey AS base, n_nationkey % 3 AS n FROM nation UNION SELECT 'n' || n_nationkey, 5 FROM nation),
most AS (SELECT base, max(k) + 2 AS last FROM w GROUP BY base), places AS (SELECT base, unnest(range(0, last + 1)) AS n FROM most),
free AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) AS k FROM places ANTI JOIN taken USING (base, n))
SELECT id, base || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS name FROM w JOIN free USING (base, k)""")
def unique_names_taken(spark, d):
    n = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    suffix = lambda k: F.when(k == 0, "").otherwise(F.concat(F.lit("_"), k.cast("string")))
    nation = t(spark, d, "nation")
    taken = nation.select(F.concat(n, suffix(F.col("n_nationkey") % 3)).alias("name")).unionByName(nation.select(F.concat(n, F.lit("_5")).alias("name")))
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"))
    return names.unique_names(rows, taken)


@query("""SELECT c_custkey, c_name AS username, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_name ELSE 'shown ' || c_custkey END AS display_name, coalesce(CASE WHEN c_custkey % 5 = 0 THEN true END, false) AS is_admin, 0 AS failed_login_attempts FROM customer""")
def user_rows(spark, d):
    k = F.col("c_custkey")
    shown = F.when(k % 3 == 0, "").when(k % 3 == 2, F.concat(F.lit("shown "), k.cast("string")))
    rows = t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("username"), F.lit("hash").alias("password_hash"), shown.alias("display_name"), F.when(k % 5 == 0, True).alias("is_admin"))
    return store.new_users(rows).drop("password_hash")


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 > 0 THEN 'uid-' || c_custkey // 2 END AS uid, CASE c_custkey % 3 WHEN 0 THEN 'N' || c_nationkey WHEN 1 THEN '' END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'm' || c_nationkey || '@x.org' ELSE '' END AS email, CASE WHEN c_custkey % 4 = 0 THEN true END AS verified FROM customer),
f AS (SELECT * FROM c WHERE uid IS NOT NULL AND uid NOT IN (SELECT 'uid-' || s_suppkey * 3 FROM supplier) QUALIFY row_number() OVER (PARTITION BY uid ORDER BY id) = 1),
n AS (SELECT *, coalesce(nullif(name, ''), CASE WHEN email <> '' THEN split_part(email, '@', 1) END, 'fb_' || substr(uid, 1, 8)) AS base FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) - 1 + CASE WHEN base IN (SELECT 'N' || s_nationkey FROM supplier) THEN 1 ELSE 0 END AS k FROM n),
u AS (SELECT *, CASE WHEN k = 0 THEN base ELSE base || '_' || k END AS username FROM k)
SELECT id, username, uid, email, coalesce(verified, false) AS email_verified, coalesce(nullif(name, ''), username) AS display_name, false AS is_admin, 0 AS failed_login_attempts FROM u""")
def social_user_rows(spark, d):
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    claims = t(spark, d, "customer").select(
        k.alias("id"), F.when(k % 11 > 0, F.concat(F.lit("uid-"), F.floor(k / 2).cast("string"))).alias("uid"), F.when(k % 3 == 0, F.concat(F.lit("N"), nation)).when(k % 3 == 1, "").alias("name"),
        F.when(k % 2 == 0, F.concat(F.lit("m"), nation, F.lit("@x.org"))).otherwise("").alias("email"), F.when(k % 4 == 0, True).alias("email_verified"),
    )
    users = t(spark, d, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("username"), F.concat(F.lit("uid-"), (F.col("s_suppkey") * 3).cast("string")).alias("uid"))
    return store.social_users(claims, users)


@query(f"""WITH {VEC}, e AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM v)
SELECT e.vec_id, round(list_sum(list_transform(e.v, lambda x: x / CASE WHEN e.n > 1e-9 THEN e.n ELSE 1 END)), 6) + 0.0::DOUBLE AS unit_sum, round(list_sum(list_transform(list_zip(e.v, o.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS l2sq, round(1 - list_inner_product(e.v, o.v), 6) + 0.0::DOUBLE AS ip,
list_transform(list_filter(list_transform(string_split('.Wav, mp3,' || e.label || ', ', ','), lambda x: lower(trim(x))), lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, '.') THEN x ELSE '.' || x END)::VARCHAR AS extensions
FROM e JOIN e o ON o.vec_id = 0""")
def vector_distances(spark, d):
    rows = t(spark, d, "embeddings")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("o"))
    e, o = F.col("embedding"), F.col("o")
    total = F.aggregate(vector.unit(e), F.lit(0.0), lambda s, x: s + x)
    ext = text.extensions(F.concat(F.lit(".Wav, mp3,"), F.col("label").cast("string"), F.lit(", ")))
    rows = rows.join(F.broadcast(one)).select("vec_id", (F.round(total, 6) + 0.0).alias("unit_sum"), F.round(vector.distance(e, o, "l2sq"), 6).alias("l2sq"), (F.round(vector.distance(e, o, "ip"), 6) + 0.0).alias("ip"), ext.alias("x"))
    return rows.select("vec_id", "unit_sum", "l2sq", "ip", F.concat(F.lit("["), F.array_join("x", ", "), F.lit("]")).alias("extensions"))


# --- the index ---

LEVELS = f"""WITH {SEG}, docs AS (SELECT job_id, 'document' AS level, 0 AS pos, trim(string_agg(trim(text), ' ' ORDER BY idx)) AS text, job_id || '_doc' AS id FROM seg GROUP BY job_id
UNION ALL SELECT job_id, 'segment', idx, trim(text), job_id || '_seg_' || idx FROM seg WHERE trim(text) <> '' UNION ALL SELECT job_id, 'chunk', idx // 2, string_agg(text, ' ' ORDER BY idx), job_id || '_' || idx // 2 FROM seg GROUP BY job_id, idx // 2)"""


def levels(spark, d) -> DataFrame:
    """Index rows of three levels with their place (pos); chunks are pairs of segments."""
    rows = segments(spark, d)
    chunks = rows.groupBy("job_id", F.floor(F.col("idx") / 2).alias("chunk_id")).agg(index.ordered_join(F.col("text"), F.col("idx"), " ").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"), F.lit("multiple").alias("speaker"))
    docs = index.index_docs(rows, chunks.withColumn("job_id", F.col("job_id").cast("string")))
    return docs.withColumn("pos", F.coalesce(F.nullif(F.regexp_extract("id", r"_(\d+)$", 1), F.lit("")).cast("bigint"), F.lit(0)))


@query(LEVELS + " SELECT job_id::VARCHAR AS job_id, level, id, text FROM docs")
def index_levels(spark, d):
    return levels(spark, d).select("job_id", "level", "id", "text")


@query(LEVELS + " SELECT job_id::VARCHAR AS job_id, sha256(string_agg(text, '' ORDER BY CASE level WHEN 'document' THEN 1 WHEN 'segment' THEN 2 ELSE 3 END, pos) || 'model-a') AS hash FROM docs GROUP BY 1")
def index_hash(spark, d):
    return index.index_hash(levels(spark, d), "model-a")


@query("SELECT conv_id AS job_id, CASE WHEN conv_id % 3 = 0 THEN count(*) ELSE count(*) FILTER (turn % 2 = 0) END AS chunks FROM conversations GROUP BY 1")
def chunk_counts(spark, d):
    level = F.when((F.col("turn") % 2 == 0) & (F.col("conv_id") % 3 != 0), "chunk").otherwise("segment")
    return index.level_counts(t(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), level.alias("level")))


# --- retrieval ---


@query("""SELECT o_orderkey, CASE lv WHEN 0 THEN 1 WHEN 1 THEN greatest(coalesce(nullif(sc, 0), k, 4), 50) ELSE greatest(coalesce(k, 4), 50) END::BIGINT AS recall_n, CASE lv WHEN 0 THEN 1 WHEN 1 THEN coalesce(nullif(sc, 0), k, 4) ELSE least(coalesce(k, 4), 6) END::BIGINT AS context_n
FROM (SELECT o_orderkey, o_orderkey % 3 AS lv, o_orderkey % 80 AS sc, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 90 END AS k FROM orders)""")
def level_limits_by_k(spark, d):
    level = F.element_at(F.array(*[F.lit(x) for x in intent.LEVELS]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = t(spark, d, "orders").select("o_orderkey", level.alias("level"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 90).alias("k"), (F.col("o_orderkey") % 80).alias("segment_count"))
    return retrieve.level_limits(rows).select("o_orderkey", "recall_n", "context_n")


@query(f"""WITH {VEC}, p AS (SELECT q.vec_id AS query_id, c.vec_id AS pos, round(1 - ({COS}), 9) AS sim FROM v q JOIN v c ON q.label = c.label WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pos) AS rank, pos FROM p QUALIFY rank <= 8""")
def rerank_cosine(spark, d):
    rows = t(spark, d, "embeddings").select("label", F.col("vec_id").alias("pos"), "embedding")
    return retrieve.rerank(asked(spark, d).join(t(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(rows, "label"), 8, use_mmr=False)


@query(f"""WITH {VEC}, p AS (SELECT q.vec_id AS query_id, c.vec_id AS pos, round(1 - ({COS}), 9) AS sim FROM v q JOIN v c ON q.label = c.label WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pos) AS rank, max(sim) OVER (PARTITION BY query_id) >= 0.99999 AS hit FROM p WHERE query_id <> pos)
SELECT query_id, rank, pos, greatest(0, round_even(sim * 100, 0))::BIGINT AS answer_relevance_pct FROM r WHERE query_id % 300 <> 0 AND CASE WHEN hit THEN sim >= 0.99999 AND rank <= 5 ELSE rank <= 1 END
UNION ALL SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos), pos, -1 FROM p WHERE query_id % 300 = 0 AND query_id <> pos""")
def legacy_and_blank_answers(spark, d):
    rows = t(spark, d, "embeddings")
    words = F.when(F.col("vec_id") % 300 == 0, " \n").otherwise("said")
    q = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("answer"), "label", words.alias("answer_text"))
    return retrieve.select_sources(q.join(rows, "label").withColumnRenamed("vec_id", "pos").where("query_id <> pos"), 0.99999, 5, 1).withColumn("answer_relevance_pct", F.coalesce("answer_relevance_pct", F.lit(-1)))


@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN E'[STARRED ANSWERS]\\na\\n\\n' ELSE E'[STARRED ANSWERS]\\na\\n---\\nb\\n\\n' END || CASE WHEN item_id % 2 = 0 THEN E'[REFERENCE CONTEXT]\\nref\\n\\n' ELSE '' END || text || E'\\n\\n[QUESTION]\\nwhy?' AS prompt,
trim(CASE WHEN item_id % 2 = 0 THEN substr('  ' || text || repeat('y', 1200), 1, 1000) ELSE '  ' || text || repeat('y', 1200) END) AS matched, text, substr(text, 1, 200) AS preview, CASE WHEN item_id % 4 = 0 THEN 'pageindex' ELSE 'vector' END AS method FROM benchmark""")
def prompts_and_answers(spark, d):
    k = F.col("item_id")
    stars = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    said = F.concat(F.lit("  "), "text", F.repeat(F.lit("y"), 1200))
    route = intent.route(F.when(k % 2 == 0, "pageindex").otherwise("other"), F.when(k % 4 == 0, k))
    return t(spark, d, "benchmark").select("item_id", retrieve.prompt(F.lit("why?"), F.col("text"), stars, F.when(k % 2 == 0, "ref")).alias("prompt"), retrieve.answer_to_match(said, k % 2 == 0).alias("matched"), *retrieve.source_columns(F.col("text")), route.alias("method"))


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'segment' WHEN 1 THEN 'document' ELSE 'chunk' END AS level FROM benchmark""")
def parsed_levels(spark, d):
    k = F.col("item_id")
    said = F.when(k % 4 == 0, F.concat("text", F.lit(" SEGMENT \n"))).when(k % 4 == 1, "document").when(k % 4 == 2, F.concat("text", F.lit(" nothing"))).otherwise("")
    return t(spark, d, "benchmark").select("item_id", intent.parse_level(said).alias("level"))


# --- trees ---

SUMMED = f"""{NODES}, lines AS (SELECT job_id, idx, speaker || ': ' || text AS line FROM seg), n1 AS (SELECT job_id, count(*) AS topics FROM tp GROUP BY job_id),
own AS (SELECT n.job_id, node_id, substr(string_agg(line, E'\\n' ORDER BY idx), 1, 200) || '...' AS summary FROM nodes n JOIN lines s ON n.job_id = s.job_id AND idx BETWEEN a AND b WHERE level > 0 GROUP BY n.job_id, node_id),
summed AS (SELECT n.*, CASE WHEN n.level = 0 THEN 'Meeting with ' || topics || ' topics discussed.' ELSE summary END AS summary FROM nodes n JOIN n1 USING (job_id) LEFT JOIN own USING (job_id, node_id))"""


@query(f"WITH {SUMMED} SELECT job_id, string_agg(repeat('  ', level) || '[' || node_id || '] ' || title || ' -- ' || CASE WHEN node_id = 'T0' THEN 'told' ELSE summary END, E'\\n' ORDER BY topic, sub) AS outline FROM summed GROUP BY job_id")
def tree_outline_summaries(spark, d):
    rows = segments(spark, d)
    told = lambda contents: contents.where("node_id = 'T0'").select("job_id", "node_id", F.lit("told").alias("summary"))
    return tree.outline(tree.with_summaries(tree.build(rows, 3), rows, told))


@query(f"""WITH {SEG}, n AS (SELECT job_id, max(idx) AS last FROM seg GROUP BY job_id)
SELECT job_id, k AS topic, CASE k WHEN 0 THEN 'Start' ELSE 'Untitled' END AS title, CASE k WHEN 0 THEN 0 ELSE least(2, last) END AS start_segment, CASE k WHEN 0 THEN least(1, last) ELSE last END AS end_segment FROM n, range(0, 2) r(k) WHERE job_id % 3 < 2
UNION ALL SELECT job_id, idx // 4, 'Topic ' || (idx // 4 + 1), min(idx), max(idx) FROM seg WHERE job_id % 3 = 2 GROUP BY job_id, idx // 4""")
def tree_topics(spark, d):
    rounds = iter(range(9))

    def propose(prompts: DataFrame) -> DataFrame:
        """Answers for a third of the jobs at first and another third when asked again; the rest never gives JSON."""
        last = next(rounds)
        good = F.lit('Here: ```json\n[{"topic_title": "Start", "start_segment": 0, "end_segment": 1}, {"start_segment": 2, "end_segment": 999}]\n```')
        return prompts.select("job_id", F.when(F.col("job_id") % 3 <= last, good).otherwise("no idea").alias("answer")).where(F.col("job_id") % 3 < 2)

    return tree.topics(segments(spark, d), propose, 4)


@query(f"""WITH {NODES}, c AS (SELECT n.job_id, node_id, string_agg(speaker || ' [' || {HMS.format("floor(s)")} || '-' || {HMS.format("floor(e)")} || ']: ' || text, E'\\n' ORDER BY idx) AS content FROM nodes n JOIN seg s ON n.job_id = s.job_id AND idx BETWEEN a AND CASE WHEN node_id = 'ROOT' THEN a ELSE b END GROUP BY n.job_id, node_id)
SELECT job_id, node_id, sha256(content) AS digest FROM c""")
def content_map_root_first(spark, d):
    rows = segments(spark, d)
    return tree.content_map(tree.build(rows, 3), rows, root_first_only=True).select("job_id", "node_id", F.sha2("content", 256).alias("digest"))


@query("""SELECT c_custkey AS job_id, '0' AS place, 'R' AS node_id, NULL AS parent_id, 0::BIGINT AS level, c_name AS title FROM customer UNION ALL SELECT c_custkey, '0,' || k, 'T' || k, 'R', 1, 'Topic' FROM customer, range(0, 2) r(k)
UNION ALL SELECT c_custkey, '0,1,0', 'T1-S0', 'T1', 2, NULL FROM customer""")
def nested_trees(spark, d):
    name = F.col("c_name")
    made = F.concat(F.lit('{"node_id": "R", "title": "'), name, F.lit('", "children": [{"node_id": "T0", "title": "Topic"}, {"node_id": "T1", "title": "Topic", "children": [{"node_id": "T1-S0"}]}]}'))
    out = tree.flatten(t(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), made.alias("tree")))
    return out.select("job_id", F.concat_ws(",", F.lit("0"), F.nullif(listed(F.col("place")), F.lit(""))).alias("place"), "node_id", "parent_id", "level", "title")


@query(f"""WITH {NODES} SELECT job_id AS query_id, 1::BIGINT AS rank, 'T0' AS node_id, title AS node_title, '' AS speaker, a AS start, b AS "end", 100::BIGINT AS relevance FROM nodes WHERE node_id = 'T0'
UNION ALL SELECT n.job_id, 2, 'T0-S0', title, speaker, a, b, 100 FROM nodes n JOIN seg s ON n.job_id = s.job_id AND s.idx = 0 WHERE node_id = 'T0-S0' UNION ALL SELECT DISTINCT job_id, 3, 'lost', 'lost', '', -1, -1, 100 FROM nodes""")
def tree_sources(spark, d):
    nodes = tree.build(segments(spark, d), 3)
    place = F.posexplode(F.array(F.lit("T0"), F.lit("T0-S0"), F.lit("lost")))
    found = nodes.where("level = 0").select(F.col("job_id").alias("query_id"), "job_id", place.alias("at", "node_id")).withColumn("rank", (F.col("at") + 1).cast("bigint")).withColumn("text", F.lit("x"))
    return tree.source_rows(found, nodes).select("query_id", "rank", "node_id", "node_title", "speaker", F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("end", F.lit(-1)).alias("end"), "relevance")


# --- events ---


@query("""WITH k AS (SELECT user_id AS message_id, event_id AS seq, ['sources', 'token', 'token', 'done', 'error', 'retrieval_level_note'][event_id % 6 + 1] AS kind FROM events), p AS (SELECT *, lag(kind) OVER (PARTITION BY message_id ORDER BY seq) AS before FROM k)
SELECT message_id, seq, kind, before FROM p WHERE NOT CASE WHEN before IS NULL THEN kind IN ('sources', 'error') WHEN before IN ('sources', 'token') THEN kind IN ('token', 'retrieval_level_note', 'done', 'error') AND (before = 'sources' OR before = 'token') WHEN before = 'retrieval_level_note' THEN kind IN ('done', 'error') ELSE false END""")
def protocol_errors(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("sources", "token", "token", "done", "error", "retrieval_level_note")])
    rows = t(spark, d, "events").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("seq"), F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("kind"))
    return ev.protocol_errors(rows)


@query("SELECT user_id AS job_id, event_id AS seq, event_type AS line FROM events WHERE user_id % 3 = 0 OR event_id > user_id * 20")
def new_log_lines(spark, d):
    lines = t(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("line"))
    return ev.new_lines(lines, lines.where("job_id % 3 <> 0").select("job_id", (F.col("job_id") * 20).alias("seq")).distinct())


@query("SELECT event_id, event_type = 'click' AND event_id % 5 > 0 AND event_id % 40 > 15 AS valid FROM events")
def code_validity(spark, d):
    e = F.col("event_id")
    return t(spark, d, "events").select("event_id", ev.code_valid(F.when(e % 5 > 0, e % 40), F.lit(15), F.col("event_type"), "click").alias("valid"))


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN CASE WHEN turn % 2 = 1 THEN 'Bob' END ELSE role END AS speaker, CASE WHEN turn % 3 = 1 THEN 'new "' || turn || '"' ELSE text END AS text FROM conversations)
SELECT conv_id AS job_id, turn AS idx, speaker, text, (turn * 1.5::DOUBLE) AS "start", turn + 0.25::DOUBLE AS confidence, 'w' || turn AS word, conv_id % 2 = 0 AS is_list, CASE WHEN conv_id % 2 = 1 THEN 'file ' || conv_id END AS input_file, CASE WHEN conv_id % 2 = 1 THEN turn_count ELSE -1 END AS n FROM s JOIN (SELECT conv_id, count(*) AS turn_count FROM conversations GROUP BY 1) USING (conv_id)""")
def patched_json(spark, d):
    """Stored results of both shapes, with fields of their own, after edits of every third segment; read back from the JSON."""
    c = t(spark, d, "conversations")
    words = F.array(F.struct(F.concat(F.lit("w"), F.col("turn").cast("string")).alias("w"), (F.col("turn") + 0.25).cast("double").alias("p")))
    segment = F.struct("turn", F.struct((F.col("turn") * 1.5).cast("double").alias("start"), "text", F.col("role").alias("speaker"), words.alias("words")).alias("s"))
    jobs = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.to_json(segment["s"]).alias("j")))), lambda x: x.j).alias("list"))
    listed = F.concat(F.lit("["), F.array_join("list", ","), F.lit("]"))
    held = F.concat(F.lit('{"input_file": "file '), F.col("conv_id").cast("string"), F.lit('", "meta": {"n": '), F.size("list").cast("string"), F.lit(', "x": [null, {}]}, "segments": '), listed, F.lit("}"))
    stored_ = jobs.select(F.col("conv_id").alias("job_id"), F.when(F.col("conv_id") % 2 == 0, listed).otherwise(held).alias("json"))
    edits = c.where("turn % 3 = 1").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("idx"), F.when(F.col("turn") % 2 == 1, "Bob").alias("speaker"), F.concat(F.lit('new "'), F.col("turn").cast("string"), F.lit('"')).alias("text"))
    done = transcripts.patch_json(stored_, edits).withColumn("v", F.parse_json("json")).withColumn("is_list", F.startswith("json", F.lit("[")))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    rows = done.select("job_id", "is_list", get("$.input_file", "string").alias("input_file"), F.coalesce(get("$.meta.n", "bigint"), F.lit(-1)).alias("n"), F.posexplode(F.when(F.col("is_list"), get("$", "array<variant>")).otherwise(get("$.segments", "array<variant>"))).alias("idx", "s"))
    part = lambda path, kind: F.try_variant_get("s", path, kind)
    return rows.select("job_id", F.col("idx").cast("bigint").alias("idx"), part("$.speaker", "string").alias("speaker"), part("$.text", "string").alias("text"), part("$.start", "double").alias("start"), part("$.words[0].p", "double").alias("confidence"), part("$.words[0].w", "string").alias("word"), "is_list", "input_file", "n")


@query(f"""WITH RECURSIVE {SEG}, n AS (SELECT job_id, idx, '[' || speaker || ' ' || s || '-' || e || '] ' || text AS line, length(text) AS len, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS pos FROM seg),
r AS (SELECT job_id, idx, pos, len AS used, 0::BIGINT AS g, line FROM n WHERE pos = 1
UNION ALL SELECT n.job_id, n.idx, n.pos, CASE WHEN r.used > 0 AND r.used + n.len > 1500 THEN n.len ELSE r.used + n.len END, CASE WHEN r.used > 0 AND r.used + n.len > 1500 THEN r.g + 1 ELSE r.g END, n.line FROM r JOIN n ON n.job_id = r.job_id AND n.pos = r.pos + 1),
p AS (SELECT job_id, g, 'Summarize the following section (' || g + 1 || '/' || max(g) OVER (PARTITION BY job_id) + 1 || ') of a meeting transcript. Focus on key points, decisions, and action items.' || chr(10) || chr(10) || 'User request: Summarize this meeting.' || chr(10) || chr(10) ||
  'Transcript section:' || chr(10) || lines || chr(10) || chr(10) || 'Summary:' AS prompt FROM (SELECT job_id, g, string_agg(line, chr(10) ORDER BY idx) AS lines FROM r GROUP BY job_id, g)),
w AS (SELECT job_id, 'The following are summaries of different sections of a meeting transcript. Combine them into a single, coherent summary that addresses the user''s request.' || chr(10) || chr(10) || 'User request: Summarize this meeting.' || chr(10) || chr(10) || 'Section summaries:' || chr(10) ||
  string_agg('Section ' || g + 1 || ' Summary:' || chr(10) || right(prompt, 90), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY g) || chr(10) || chr(10) || 'Combined summary:' AS prompt FROM p GROUP BY job_id)
SELECT job_id, 0 AS level, g AS n, prompt FROM p UNION ALL SELECT job_id, 1, 0, prompt FROM w""")
def summary_prompts(spark, d):
    """The prompts of both rounds, with the end of a prompt as its summary."""
    rows = segments(spark, d).withColumns({c: F.col(c).cast("string") for c in ("start", "end")})
    return summarize.summarize(rows, lambda p: p.withColumn("summary", F.right("prompt", F.lit(90))), 1500)[1]


# --- recordings ---


@query("""WITH w AS (SELECT c_custkey AS job_id, c_custkey % 5 AS shape, (c_custkey % 4 * 30)::DOUBLE AS base FROM customer), s AS (SELECT job_id, base, unnest(CASE shape WHEN 3 THEN [0] ELSE [0, 1] END) AS ord, shape FROM w),
v AS (SELECT *, CASE WHEN shape = 3 THEN 0.0 ELSE ord * 2.5 END::DOUBLE AS a, CASE WHEN shape = 3 THEN NULL ELSE ord * 2.5 + 2 END::DOUBLE AS b FROM s)
SELECT job_id, ord::BIGINT AS ord, CASE WHEN base <> 0 AND a < base THEN a + base ELSE a END AS "start", CASE WHEN base <> 0 AND b < base THEN b + base ELSE b END AS "end", CASE WHEN shape = 3 THEN 'all' ELSE 'p' || ord END AS text FROM v""")
def window_segments(spark, d):
    k = F.col("c_custkey")
    parts = '[{"start": 0.0, "end": 2.0, "text": "p0"}, {"start": 2.5, "end": 4.5, "text": "", "transcript": "p1"}]'
    pairs = '[{"timestamp": [0.0, 2.0], "text": "p0"}, {"time": [2.5, 4.5], "text": "p1"}]'
    raw = F.when(k % 5 == 1, f'{{"segments": {parts}, "text": "x"}}').when(k % 5 == 2, f'{{"chunks": {pairs}}}').when(k % 5 == 3, '{"text": "all"}').when(k % 5 == 4, parts).otherwise("{}")
    rows = t(spark, d, "customer").select(k.alias("job_id"), F.lit(0).alias("n"), (k % 4 * 30).cast("double").alias("start"), F.when(k % 5 == 0, parts).otherwise("[]").alias("segments"), raw.alias("raw"))
    return stitch.window_segments(rows).drop("n")


@query("""SELECT c_custkey AS job_id, k AS ord, k::DOUBLE AS "start", k + 1.0::DOUBLE AS "end", 't' || k AS text FROM customer, range(0, 3) r(k) WHERE k <> 1""")
def asr_results(spark, d):
    pair = "array<struct<timestamp:array<double>,text:string>>"
    part = "array<struct<start:string,end:string,text:string>>"
    even = F.col("c_custkey") % 2 == 0
    chunks = F.when(even, F.from_json(F.lit('[{"timestamp": [0, 1], "text": "t0"}, {"timestamp": [1, null], "text": "t1"}, {"timestamp": [2, 3], "text": "t2"}]'), pair))
    parts = F.from_json(F.lit('[{"start": "0", "end": "1", "text": "t0"}, {"end": "2", "text": "t1"}, {"start": "2", "end": "3", "text": "t2"}]'), part)
    return transcripts.asr_segments(t(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), chunks.alias("chunks"), parts.alias("segments")))


@query("""WITH l AS (SELECT user_id AS job_id, event_id AS ord, CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'end' END AS kind, (event_id * 2)::DOUBLE AS tm FROM events),
p AS (SELECT *, lag(kind) OVER w AS k, lag(tm) OVER w AS a FROM l WINDOW w AS (PARTITION BY job_id ORDER BY ord)) SELECT job_id, CASE WHEN k = 'start' THEN a ELSE greatest(0.0, tm - 0.5) END::DOUBLE AS "start", tm AS "end" FROM p WHERE kind = 'end'""")
def silence_spans(spark, d):
    e = F.col("event_id")
    return stitch.silence_pairs(t(spark, d, "events").select(F.col("user_id").alias("job_id"), e.alias("ord"), F.when(e % 3 == 0, "start").otherwise("end").alias("kind"), (e * 2).cast("double").alias("at")), 0.5)


@query(f"""WITH {SEG} SELECT job_id, '{{"input_file":"f' || job_id || '.wav","n_segments":' || count(*) || '}}' AS json, max_by(e, idx) AS duration, string_agg(speaker, ',' ORDER BY idx) AS speakers FROM seg GROUP BY job_id""")
def aligned_result(spark, d):
    rows = segments(spark, d)
    jobs = rows.select("job_id", F.concat(F.lit("/up/f"), F.col("job_id").cast("string"), F.lit(".wav")).alias("filename")).distinct()
    held = F.from_json("json", "struct<input_file:string,duration_seconds:double,segments:array<struct<speaker:string>>,n_segments:bigint>")
    out = transcripts.nested(rows, jobs).withColumn("h", held)
    return out.select("job_id", F.to_json(F.struct("h.input_file", "h.n_segments")).alias("json"), F.col("h.duration_seconds").alias("duration"), listed(F.col("h.segments.speaker")).alias("speakers"))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN '{\"a\":1}' END AS value FROM customer")
def cached_artifacts(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    cache = rows.where("key % 3 < 2").select("key", F.when(F.col("key") % 3 == 0, '{"a":1}').otherwise('{"a":').alias("value"))
    return transcripts.cached(rows, cache)


@query(f"""WITH j AS (SELECT o_orderkey AS job_id, {STATE_SQL.format("o_orderkey")} AS s FROM orders)
SELECT job_id, n AS name, CASE n WHEN 'aligned' THEN '[2]' ELSE '[1]' END AS json FROM j, (VALUES ('transcription'), ('aligned')) v(n) WHERE s IN ('completed', 'reindexing', 'failed')""")
def stage_outputs(spark, d):
    k = F.col("o_orderkey")
    return transcripts.stage_outputs(t(spark, d, "orders").select(k.alias("job_id"), state(k).alias("status"), F.lit("[1]").alias("transcription"), F.lit(None).cast("string").alias("diarization"), F.lit("[2]").alias("aligned")))
