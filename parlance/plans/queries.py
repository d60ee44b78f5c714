"""Queries over the test tables, one for each operator, with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import intent, status, text, vector
from parlance.operators import align, chunk, evaluate, index, names, retrieve, stitch, store, tree, vector_index
from parlance.operators.lineage import shared_dir
from parlance.plans.registry import IVL, QUERIES, SEG, SQL, intervals, query, segments, t
from parlance.sources import transcripts
from parlance.streaming import events as ev

# --- functions ---


@query("SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, sha256(text || role) AS content_hash FROM conversations")
def segment_hash(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", text.segment_hash(F.col("text"), F.col("role")).alias("content_hash"))


@query("""SELECT event_id, printf('%02d:%02d:%02d', (event_id * 37 // 3600)::BIGINT, (event_id * 37 % 3600 // 60)::BIGINT, (event_id * 37 % 60)::BIGINT) AS hms,
CASE WHEN event_id = 0 THEN '—' ELSE printf('%d:%02d', event_id // 60, event_id % 60) END AS ms,
CASE WHEN event_id < 1024 THEN printf('%d B', event_id) WHEN event_id < 1048576 THEN printf('%.1f KB', event_id / 1024.0::DOUBLE) ELSE printf('%.1f MB', event_id / 1048576.0::DOUBLE) END AS size FROM events""")
def display_formats(spark, d):
    e = F.col("event_id")
    return t(spark, d, "events").select("event_id", text.hms(e * 37).alias("hms"), text.minutes_seconds(e).alias("ms"), text.file_size(e).alias("size"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 100) || ' […] ' || right(text, 100) END AS cut, substr(text, 1, 200) AS preview FROM documents")
def head_tail_truncation(spark, d):
    return t(spark, d, "documents").select("doc_id", text.head_tail(F.col("text"), 100, " […] ").alias("cut"), F.substring("text", 1, 200).alias("preview"))


RE = {k: "|".join(f"(?:{p})" for p in v) for k, v in (("d", intent.DOCUMENT), ("s", intent.SEGMENT))}
QUESTION = "CASE item_id % 6 WHEN 0 THEN 'Give me a short summary of ' WHEN 1 THEN 'Who said ' WHEN 2 THEN 'main points: ' WHEN 3 THEN 'When did it ' WHEN 4 THEN '要約 ' ELSE 'why ' END || text"


@query(f"""SELECT item_id, CASE WHEN regexp_matches(q, '(?i){RE["d"]}') THEN 'document' WHEN regexp_matches(q, '(?i){RE["s"]}') THEN 'segment' ELSE 'chunk' END AS level,
{" OR ".join(f"contains(lower(q), '{w}')" for w in intent.SUMMARY)} AS is_summary FROM (SELECT item_id, trim({QUESTION}) AS q FROM benchmark)""")
def intent_levels(spark, d):
    q = F.expr(QUESTION)
    return t(spark, d, "benchmark").select("item_id", intent.detect_intent(q).alias("level"), intent.is_summary(q).alias("is_summary"))


WHOLE_QUESTION = QUESTION


@query(f"""SELECT item_id, CASE WHEN regexp_matches(q, '(?i){RE["d"]}') THEN 'document' WHEN regexp_matches(q, '(?i){RE["s"]}') THEN 'segment' ELSE 'chunk' END AS level,
{" OR ".join(f"contains(lower(q), '{w}')" for w in intent.SUMMARY)} AS is_summary FROM (SELECT item_id, trim({WHOLE_QUESTION}) AS q FROM benchmark)""")
def intent_levels_whole(spark, d):
    q = F.expr(WHOLE_QUESTION)
    return t(spark, d, "benchmark").select("item_id", intent.detect_intent(q).alias("level"), intent.is_summary(q).alias("is_summary"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN value * 0.4 WHEN 'view' THEN 40 + value * 0.25 ELSE value END AS progress,
CASE WHEN lower(props) IN ('true', '1', 'yes', 'on') THEN 'true' ELSE 'false' END AS flag, TRY_CAST(event_type AS BIGINT)::VARCHAR AS number FROM events""")
def progress_and_settings(spark, d):
    rows = t(spark, d, "events")
    stage = F.when(F.col("event_type") == "click", "transcribing").when(F.col("event_type") == "view", "diarizing").otherwise("other")
    return rows.select("event_id", status.scaled_progress(stage, F.col("value")).alias("progress"), text.setting(F.lit("bool"), F.col("props")).alias("flag"), text.setting(F.lit("int"), F.col("event_type")).alias("number"))


@query("""WITH j AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'transcribing' WHEN 1 THEN 'diarizing' WHEN 2 THEN 'aligning' ELSE 'indexing' END AS stage, o_orderkey % 4 + 1 AS pos,
  CASE o_orderkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS st FROM orders),
s AS (SELECT * FROM (VALUES ('transcribing', 1), ('diarizing', 2), ('aligning', 3), ('indexing', 4)) v(name, k))
SELECT o_orderkey, name AS stage_name, CASE WHEN st = 'completed' THEN 'completed' WHEN k < pos THEN 'completed' WHEN k = pos THEN CASE WHEN st = 'failed' THEN 'failed' ELSE 'active' END ELSE 'pending' END AS state FROM j, s""")
def stage_states(spark, d):
    rows = t(spark, d, "orders").withColumn("stage", F.element_at(F.array(*[F.lit(s) for s in status.STAGES]), (F.col("o_orderkey") % 4 + 1).cast("int")))
    st = F.when(F.col("o_orderkey") % 5 == 0, "completed").when(F.col("o_orderkey") % 5 == 1, "failed").otherwise("running")
    return rows.select("o_orderkey", F.explode(status.stage_states(F.col("stage"), st)).alias("stage_name", "state"))


# --- alignment and stitching ---

JOINED = f"""WITH {SEG}, {IVL},
o AS (SELECT a.job_id, a.idx, d.ord, d.speaker, least(a.e, d.e) - greatest(a.s, d.s) AS ov, abs((d.s + d.e) / 2 - (a.s + a.e) / 2) AS dist FROM seg a LEFT JOIN ivl d USING (job_id)),
r AS (SELECT job_id, idx, arg_max(speaker, (ov, -ord)) FILTER (ov > 0) AS a, arg_min(speaker, (dist, ord)) AS b FROM o GROUP BY ALL)"""


@query(JOINED + " SELECT job_id, idx, coalesce(a, b, 'Unknown') AS speaker FROM r")
def interval_overlap_argmax(spark, d):
    asr = segments(spark, d).select("job_id", F.col("idx").alias("ord"), "start", "end", "text")
    return align.assign_speakers(asr, intervals(spark, d)).select("job_id", F.col("ord").alias("idx"), "speaker")


def coarse(spark, d, body=None):
    """Segments whose speaker changes seldom, with gaps; the text is `body`, or the segment's own."""
    body = F.col("text") if body is None else body
    return segments(spark, d).select("job_id", F.col("idx").alias("ord"), F.when(F.col("idx") % 3 == 0, "A").otherwise("B").alias("speaker"), (F.col("start") + F.when(F.col("idx") % 5 == 4, 1.0).otherwise(0.0)).alias("start"), F.col("end"), body.alias("text"))


@query(f"""WITH {SEG}, c AS (SELECT job_id, idx AS ord, CASE WHEN idx % 3 = 0 THEN 'A' ELSE 'B' END AS speaker, s + CASE WHEN idx % 5 = 4 THEN 1.0 ELSE 0.0 END AS s, e, text FROM seg),
n AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND s - lag(e) OVER w <= 0.5 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY job_id ORDER BY ord)),
r AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ord) - 1 AS run FROM n)
SELECT job_id, run::BIGINT AS run, min_by(s, ord) AS "start", max_by(e, ord) AS "end", any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY ord) AS text FROM r GROUP BY job_id, run""")
def speaker_run_merge(spark, d):
    return align.merge_runs(coarse(spark, d))


@query(SQL["speaker_run_merge"])
def speaker_run_merge_whole(spark, d):
    return align.merge_runs(coarse(spark, d, F.col("text")))


@query(f"WITH {SEG} SELECT job_id, max_by(e, idx) AS last_end, max(e) AS max_end FROM seg GROUP BY job_id")
def aligned_duration(spark, d):
    return align.durations(segments(spark, d).withColumnRenamed("idx", "ord"))


@query(f"""WITH {SEG}, r AS (SELECT job_id, max(e) AS duration FROM seg GROUP BY 1),
w AS (SELECT job_id, duration, unnest(range(0, ceil(duration / 25.0::DOUBLE - 1e-9)::BIGINT)) AS n FROM r)
SELECT job_id, n::INTEGER AS n, round(n * 25.0::DOUBLE, 6) AS "start", round(least(round(n * 25.0::DOUBLE, 6) + 30, duration), 6) AS "end" FROM w""")
def audio_windows(spark, d):
    return stitch.windows(segments(spark, d).groupBy("job_id").agg(F.max("end").alias("duration")), 30.0, 5.0)


STITCHED = """,
n AS (SELECT job_id, ord, a, b, text, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(a, 1e12), ord) AS pos FROM w),
r AS (SELECT job_id, ord, a, b, text, pos, 0 AS g, b AS prev, true AS stays FROM n WHERE pos = 1
UNION ALL SELECT job_id, ord, a2, b, text, pos, CASE WHEN stays THEN g + 1 ELSE g END, CASE WHEN stays THEN b ELSE prev END, stays
  FROM (SELECT *, prev IS NULL OR a IS NULL OR b IS NULL OR a2 < b AS stays FROM (SELECT n.*, r.g, r.prev, CASE WHEN n.a < r.prev - 0.25 THEN r.prev ELSE n.a END AS a2 FROM r JOIN n ON n.job_id = r.job_id AND n.pos = r.pos + 1)))
SELECT job_id, any_value(ord) FILTER (stays) AS ord, any_value(a) FILTER (stays) AS "start", any_value(b) FILTER (stays) AS "end", coalesce(string_agg(trim(text), ' ' ORDER BY pos) FILTER (trim(text) <> ''), '') AS text FROM r GROUP BY job_id, g"""


@query(f"WITH RECURSIVE {SEG}, w AS (SELECT job_id, idx AS ord, s - CASE WHEN idx % 2 = 1 THEN 2.0 ELSE 0.0 END AS a, e AS b, text FROM seg){STITCHED}")
def stitch_overlaps(spark, d):
    rows = segments(spark, d).select("job_id", F.col("idx").alias("ord"), (F.col("start") - F.when(F.col("idx") % 2 == 1, F.lit(2.0)).otherwise(0.0)).alias("start"), "end", "text")
    return stitch.stitch(rows)


@query(f"""WITH RECURSIVE w AS (SELECT user_id AS job_id, event_id AS ord, CASE WHEN event_id % 11 <> 3 THEN (epoch_us(ts) // 1000000 % 3600)::DOUBLE END AS a,
CASE WHEN event_id % 7 <> 2 THEN (epoch_us(ts) // 1000000 % 3600)::DOUBLE + CASE event_id % 5 WHEN 0 THEN 0.125 WHEN 1 THEN 90 WHEN 2 THEN -1 ELSE 20 END END::DOUBLE AS b, event_type AS text FROM events){STITCHED}""")
def stitch_missing_times(spark, d):
    """Segments that overlap by much, are very short, end before they begin, or lack a start or an end."""
    at, e = (F.unix_seconds(F.col("ts").cast("timestamp")) % 3600).cast("double"), F.col("event_id")
    length = F.when(e % 5 == 0, 0.125).when(e % 5 == 1, 90.0).when(e % 5 == 2, -1.0).otherwise(20.0)
    return stitch.stitch(t(spark, d, "events").select(F.col("user_id").alias("job_id"), e.alias("ord"), F.when(e % 11 != 3, at).alias("start"), F.when(e % 7 != 2, at + length).alias("end"), F.col("event_type").alias("text")))


@query("""WITH r AS (SELECT event_id, (event_id % 100)::DOUBLE AS s, (event_id % 100)::DOUBLE + 30 AS e, [(event_id % 100)::DOUBLE - 1.5, (event_id % 100)::DOUBLE + 1, (event_id % 100)::DOUBLE + 31, (event_id % 100)::DOUBLE + 28.5] AS p FROM events)
SELECT event_id, coalesce(list_min(list_filter(p, lambda x: abs(x - s) <= 2 AND x <= e)), s) AS "start", coalesce(list_max(list_filter(p, lambda x: abs(x - e) <= 2 AND x >= s)), e) AS "end" FROM r""")
def silence_snap(spark, d):
    s = (F.col("event_id") % 100).cast("double")
    rows = t(spark, d, "events").select("event_id", s.alias("start"), (s + 30).alias("end"), F.array_sort(F.array(s - 1.5, s + 1, s + 31, s + 28.5)).alias("points"))
    return stitch.snap(rows, 2.0).select("event_id", "start", "end")


# --- segments, chunks and index rows ---


@query(f"""WITH RECURSIVE {SEG}, n0 AS (SELECT job_id, idx, trim(text) AS text, speaker, s, e, row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1 AS pos, greatest(1, length(trim(text)) // 4) AS size FROM seg WHERE trim(text) <> ''),
n AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY job_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n0),
b AS (SELECT x.job_id, x.pos, x.speaker, x.size, x.before, coalesce(min(y.pos) FILTER (x.before - y.before <= 50), x.pos - 1) AS back, coalesce(min(y.before) FILTER (x.before - y.before <= 50), max(y.before)) AS back_before
  FROM n x LEFT JOIN n y ON x.job_id = y.job_id AND y.pos < x.pos GROUP BY x.job_id, x.pos, x.speaker, x.size, x.before),
r AS (SELECT job_id, pos, 0 AS first, 0::HUGEINT AS first_before, 0 AS fresh, 0 AS chunk, speaker AS who FROM b WHERE pos = 0
UNION ALL SELECT job_id, pos, CASE WHEN cut THEN start ELSE first END, CASE WHEN cut THEN greatest(first_before, back_before) ELSE first_before END, CASE WHEN cut THEN pos ELSE fresh END, CASE WHEN cut THEN chunk + 1 ELSE chunk END, CASE WHEN cut THEN speaker ELSE who END
  FROM (SELECT b.*, r.first, r.first_before, r.fresh, r.chunk, r.who, greatest(r.first, b.back) AS start, b.before - r.first_before + b.size > 300 OR (b.speaker <> r.who AND b.before - r.first_before >= 150) AS cut FROM r JOIN b ON b.job_id = r.job_id AND b.pos = r.pos + 1) z),
c AS (SELECT job_id, chunk, any_value(first) AS first, any_value(fresh) AS fresh, any_value(who) AS who, max(pos) AS last FROM r GROUP BY job_id, chunk)
SELECT c.job_id::VARCHAR AS job_id, chunk::INTEGER AS chunk_id, string_agg(CASE WHEN n.pos >= fresh THEN speaker || ': ' || text ELSE text END, ' ' ORDER BY n.pos) AS text, CASE WHEN count(DISTINCT speaker) = 1 THEN any_value(who) ELSE 'multiple' END AS speaker,
arg_min(s, n.pos) AS "start", arg_max(e, n.pos) AS "end", string_agg(n.pos::VARCHAR, ',' ORDER BY n.pos) AS positions, string_agg(n.idx::VARCHAR, ',' ORDER BY n.pos) AS segment_ids FROM c JOIN n ON n.job_id = c.job_id AND n.pos BETWEEN first AND last GROUP BY c.job_id, chunk""")
def chunker(spark, d):
    rows = segments(spark, d).select("job_id", "idx", "text", "speaker", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))
    out = chunk.chunk(chunk.normalise(rows))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("positions", "segment_ids")})


@query(f"""WITH {SEG}, n AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS new FROM (SELECT job_id, idx, CASE WHEN idx % 3 = 0 THEN 'A' ELSE 'B' END AS speaker FROM seg) WINDOW w AS (PARTITION BY job_id ORDER BY idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY idx) - 1 AS turn FROM n)
SELECT job_id, turn::BIGINT AS turn, any_value(speaker) AS speaker, min(idx) AS first_idx, max(idx) AS last_idx, any_value(speaker) || ': discussion' AS title FROM r GROUP BY job_id, turn""")
def speaker_turns(spark, d):
    return chunk.turns(segments(spark, d).withColumn("speaker", F.when(F.col("idx") % 3 == 0, "A").otherwise("B")))


@query("""SELECT l_orderkey % 50 AS job_id, (l_orderkey // 50 * 8 + l_linenumber) // 15 AS topic, min(l_orderkey // 50 * 8 + l_linenumber) AS start_segment, max(l_orderkey // 50 * 8 + l_linenumber) AS end_segment,
'Topic ' || ((l_orderkey // 50 * 8 + l_linenumber) // 15 + 1) AS title FROM lineitem GROUP BY ALL""")
def topic_blocks(spark, d):
    rows = t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("job_id"), (F.floor(F.col("l_orderkey") / 50) * 8 + F.col("l_linenumber")).alias("idx"))
    return chunk.blocks(rows)


@query(f"""WITH RECURSIVE {SEG}, n AS (SELECT job_id, idx, length(text) AS len, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS pos FROM seg),
r AS (SELECT job_id, idx, pos, len AS used, 0::BIGINT AS g FROM n WHERE pos = 1
UNION ALL SELECT n.job_id, n.idx, n.pos, CASE WHEN r.used > 0 AND r.used + n.len > 1500 THEN n.len ELSE r.used + n.len END, CASE WHEN r.used > 0 AND r.used + n.len > 1500 THEN r.g + 1 ELSE r.g END FROM r JOIN n ON n.job_id = r.job_id AND n.pos = r.pos + 1)
SELECT job_id, idx, g AS "group" FROM r""")
def size_bounded_groups(spark, d):
    return chunk.group_by_size(segments(spark, d), 1500)


@query(f"""WITH {SEG} SELECT job_id, trim(string_agg(trim(text), ' ' ORDER BY idx)) AS text, min_by(s, idx) AS "start", max_by(e, idx) AS "end", 'document' AS level, 'multiple' AS speaker, job_id || '_doc' AS id FROM seg GROUP BY job_id""")
def document_level_docs(spark, d):
    return index.document_docs(segments(spark, d))


@query(f"""WITH {SEG} SELECT job_id, trim(text) AS text, s AS "start", e AS "end", 'segment' AS level, speaker, job_id || '_seg_' || idx AS id FROM seg WHERE trim(text) <> ''""")
def segment_level_docs(spark, d):
    return index.segment_docs(segments(spark, d))


@query(f"WITH {SEG} SELECT job_id, sha256(string_agg(text || speaker, '' ORDER BY idx)) AS hash FROM seg GROUP BY job_id")
def transcript_hash(spark, d):
    return index.content_hash(segments(spark, d))


@query(f"WITH {SEG} SELECT job_id, sha256(string_agg(text || speaker, '' ORDER BY idx)) AS hash FROM seg GROUP BY job_id HAVING job_id % 3 = 0")
def reindex_needed(spark, d):
    rows = segments(spark, d)
    known = index.content_hash(rows).withColumn("hash", F.when(F.col("job_id") % 3 == 0, "stale").otherwise(F.col("hash")))
    return index.stale_jobs(rows, known)


@query("SELECT conv_id || '_seg_' || turn AS doc_id, sha256(text || role) AS content_hash, CASE WHEN turn % 2 = 0 THEN turn ELSE -1 END AS vec FROM conversations")
def embedding_carry_over(spark, d):
    docs = t(spark, d, "conversations").select(F.concat_ws("_seg_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), "text", F.col("role").alias("speaker"), "turn")
    live = docs.select("doc_id", F.when(F.col("turn") % 2 == 0, text.segment_hash(F.col("text"), F.col("speaker"))).otherwise("old").alias("content_hash"), F.col("turn").alias("embedding"))
    return index.carry_over(docs.drop("turn"), live).select("doc_id", "content_hash", F.coalesce("embedding", F.lit(-1)).alias("vec"))


# --- retrieval ---

COS = "1 - list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v)))"
VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def asked(spark, d, every=100):
    return t(spark, d, "embeddings").where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def knn_sql(where: str, k: int) -> str:
    return f"""WITH {VEC}, p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round({COS}, 9) AS distance FROM v q, v c WHERE q.vec_id % 100 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p)
SELECT query_id, rank, id, round(distance, 6) + 0.0::DOUBLE AS distance, CASE WHEN distance >= 0 THEN greatest(0, round_even((1 - distance) * 100, 0))::BIGINT END AS relevance FROM r WHERE rank <= {k}"""


@query(knn_sql("true", 10))
def knn_cosine_topk(spark, d):
    return retrieve.knn(t(spark, d, "embeddings"), asked(spark, d), 10)


@query(knn_sql("true", 10))
def knn_stored_index(spark, d):
    """As knn_cosine_topk, from an index written first; a question reads its nearest cells and those whose bound can still matter."""
    folder = f"{shared_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    vector_index.build(t(spark, d, "embeddings"), folder)
    return vector_index.search(spark, folder, asked(spark, d), 10)[0]


@query(knn_sql("c.label % 3 = 1", 5))
def knn_stored_level(spark, d):
    rows = t(spark, d, "embeddings").withColumn("level", F.element_at(F.array(F.lit("document"), F.lit("segment"), F.lit("chunk")), F.col("label") % 3 + 1))
    folder = f"{shared_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    vector_index.build(rows, folder, level_col="level")
    return vector_index.search(spark, folder, asked(spark, d), 5, "segment")[0]


@query(knn_sql("c.label % 3 = 1", 5))
def knn_level_filter(spark, d):
    rows = t(spark, d, "embeddings").withColumn("level", F.element_at(F.array(F.lit("document"), F.lit("segment"), F.lit("chunk")), F.col("label") % 3 + 1))
    return retrieve.knn(retrieve.with_level_fallback(rows, "segment"), asked(spark, d), 5)


@query(knn_sql("true", 5))
def level_filter_fallback(spark, d):
    rows = t(spark, d, "embeddings").withColumn("level", F.lit("chunk"))
    return retrieve.knn(retrieve.with_level_fallback(rows, "segment"), asked(spark, d), 5)


@query("""SELECT o_orderkey, CASE lv WHEN 0 THEN 1 WHEN 1 THEN greatest(coalesce(nullif(sc, 0), 4), 50) ELSE 50 END::BIGINT AS recall_n, CASE lv WHEN 0 THEN 1 WHEN 1 THEN coalesce(nullif(sc, 0), 4) ELSE 4 END::BIGINT AS context_n
FROM (SELECT o_orderkey, o_orderkey % 3 AS lv, o_orderkey % 80 AS sc FROM orders)""")
def level_adaptive_limits(spark, d):
    level = F.element_at(F.array(F.lit("document"), F.lit("segment"), F.lit("chunk")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = t(spark, d, "orders").select("o_orderkey", level.alias("level"), F.lit(None).cast("int").alias("k"), (F.col("o_orderkey") % 80).alias("segment_count"))
    return retrieve.level_limits(rows).select("o_orderkey", "recall_n", "context_n")


MMR_STEP = """,
c{n} AS (SELECT c.query_id, c.pos, c.u, c.near, greatest(c.closest, list_inner_product(c.u, p.u)) AS closest FROM c{m} c JOIN p{m} p USING (query_id) WHERE c.pos <> p.pos),
p{n} AS (SELECT query_id, pos, u, {n} AS rank FROM c{n} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * near - (1 - 0.7::DOUBLE) * closest, 9) DESC, pos) = 1)"""
MMR = (
    f"""WITH {VEC}, w AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-9::DOUBLE)) AS u FROM v),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.u, list_inner_product(q.u, c.u) AS near, round({COS}, 9) AS distance FROM w q, w c WHERE q.vec_id % 100 = 0),
c1 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS pos, u, near, '-infinity'::DOUBLE AS closest FROM d QUALIFY pos < 50),
p1 AS (SELECT query_id, pos, u, 1 AS rank FROM c1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * near, 9) DESC, pos) = 1)"""
    + "".join(MMR_STEP.format(n=n, m=n - 1) for n in range(2, 7))
    + " UNION ALL ".join((" " if n == 1 else "") + f"SELECT query_id, rank::BIGINT AS rank, pos FROM p{n}" for n in range(1, 7))
)


@query(MMR)
def mmr_select(spark, d):
    rows = t(spark, d, "embeddings")
    recalled = retrieve.knn(rows, asked(spark, d), 50)
    return retrieve.mmr(recalled.join(rows.select(F.col("vec_id").alias("id"), "embedding"), "id").join(asked(spark, d), "query_id").withColumn("pos", F.col("rank") - 1), 6)


@query(f"""WITH {VEC}, p AS (SELECT q.vec_id AS query_id, c.vec_id AS pos, round(1 - ({COS}), 9) AS sim FROM v q JOIN v c ON q.label = c.label WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pos) AS rank, max(sim) OVER (PARTITION BY query_id) >= 0.3 AS hit FROM p)
SELECT query_id, rank, pos, greatest(0, round_even(sim * 100, 0))::BIGINT AS answer_relevance_pct FROM r WHERE CASE WHEN hit THEN sim >= 0.3 AND rank <= 5 ELSE rank <= 2 END""")
def answer_source_selection(spark, d):
    rows = t(spark, d, "embeddings")
    q = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("answer"), "label")
    return retrieve.select_sources(q.join(rows, "label").withColumnRenamed("vec_id", "pos"))


@query(f"""WITH {SEG} SELECT job_id AS query_id, string_agg('[job' || job_id || ' ' || speaker || ' ' || idx || '-' || (idx + 1) || '] ' || text, E'\\n\\n---\\n\\n' ORDER BY idx) AS context FROM seg GROUP BY job_id""")
def context_format(spark, d):
    rows = segments(spark, d).select(F.col("job_id").alias("query_id"), F.col("idx").alias("rank"), F.concat(F.lit("job"), F.col("job_id").cast("string")).alias("audio_file"), "speaker", F.col("idx").alias("start"), (F.col("idx") + 1).alias("end"), "text")
    return retrieve.context(rows)


# --- trees ---

HMS = "printf('%02d:%02d:%02d', ({0})::BIGINT // 3600, ({0})::BIGINT % 3600 // 60, ({0})::BIGINT % 60)"
NODES = f"""{SEG}, tp AS (SELECT job_id, idx // 3 AS topic, min(idx) AS a, max(idx) AS b FROM seg GROUP BY ALL),
nodes AS (SELECT job_id, 'ROOT' AS node_id, 0 AS level, -1 AS topic, -1 AS sub, job_id::VARCHAR AS title, min(idx) AS a, max(idx) AS b FROM seg GROUP BY job_id
UNION ALL SELECT job_id, 'T' || topic, 1, topic, -1, 'Topic ' || (topic + 1), a, b FROM tp
UNION ALL SELECT job_id, 'T' || (idx // 3) || '-S' || (idx % 3), 2, idx // 3, idx % 3, speaker || ': discussion', idx, idx FROM seg)"""


@query(f"WITH {NODES} SELECT job_id, node_id, level::BIGINT AS level, title, a AS start_segment, b AS end_segment FROM nodes")
def tree_flatten(spark, d):
    return tree.build(segments(spark, d), 3).select("job_id", "node_id", "level", "title", "start_segment", "end_segment")


@query(f"""WITH {NODES} SELECT n.job_id, node_id, string_agg(speaker || ' [' || {HMS.format("floor(s)")} || '-' || {HMS.format("floor(e)")} || ']: ' || text, E'\\n' ORDER BY idx) AS content
FROM nodes n JOIN seg s ON n.job_id = s.job_id AND idx BETWEEN a AND b GROUP BY n.job_id, node_id""")
def content_map(spark, d):
    rows = segments(spark, d)
    return tree.content_map(tree.build(rows, 3), rows)


@query(f"WITH {NODES} SELECT job_id, string_agg(repeat('  ', level) || '[' || node_id || '] ' || title, E'\\n' ORDER BY topic, sub) AS outline FROM nodes GROUP BY job_id")
def tree_outline(spark, d):
    return tree.outline(tree.build(segments(spark, d), 3))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query(f"""WITH {NODES}, c AS (SELECT n.job_id, node_id, topic, sub, string_agg(speaker || ' [' || {HMS.format("floor(s)")} || '-' || {HMS.format("floor(e)")} || ']: ' || text, E'\\n' ORDER BY idx) AS content
  FROM nodes n JOIN seg s ON n.job_id = s.job_id AND idx BETWEEN a AND b GROUP BY ALL),
sc AS (SELECT c.job_id, node_id, topic, sub, content, len(list_intersect({WORDS.format("q.text")}, {WORDS.format("content")})) AS score FROM c JOIN seg q ON c.job_id = q.job_id AND q.idx = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, topic, sub) AS ord FROM sc WHERE score > 0),
one AS (SELECT job_id, node_id, ord AS place FROM o WHERE ord <= 2),
extra AS (SELECT job_id, node_id, 3 AS place FROM c WHERE node_id = 'T0' AND job_id IN (SELECT job_id FROM one) AND (job_id, node_id) NOT IN (SELECT job_id, node_id FROM one)),
two AS (SELECT job_id, node_id, 3 + row_number() OVER (PARTITION BY job_id ORDER BY ord) AS place FROM o WHERE (job_id, node_id) NOT IN (SELECT job_id, node_id FROM one UNION ALL SELECT job_id, node_id FROM extra) QUALIFY place <= 5)
SELECT job_id AS query_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY place) AS rank, node_id, sha256(content) AS digest FROM (FROM one UNION ALL FROM extra UNION ALL FROM two) JOIN c USING (job_id, node_id)""")
def tree_search(spark, d):
    """Two rounds: two nodes, which don't suffice and bring T0 with them, then two more."""
    rows = segments(spark, d)
    nodes = tree.build(rows, 3).join(tree.content_map(tree.build(rows, 3), rows), ["job_id", "node_id"])
    asked_ = rows.where("idx = 0").select(F.col("job_id").alias("query_id"), "job_id", F.col("text").alias("question"))
    check = lambda q: q.select("query_id", (F.size("chosen") >= 3).alias("sufficient"), F.array(F.lit("T0"), F.lit("nowhere")).alias("node_ids"))
    found = tree.iterative_search(asked_, nodes, tree.overlap_select(nodes, 2), check)
    return found.select("query_id", "job_id", "rank", "node_id", F.sha2("text", 256).alias("digest"))


# --- the store ---


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def jobs_newest_page(spark, d):
    return store.page(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 50, 50)


@query("SELECT conv_id AS job_id, turn, CASE WHEN conv_id = 7 AND role = 'user' THEN 'Ann' ELSE role END AS speaker FROM conversations")
def rename_speaker(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), "turn", F.col("role").alias("speaker"))
    return store.rename_speaker(rows, 7, "user", "Ann")


@query("""WITH m AS (SELECT *, lead(turn) OVER w AS n, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id, turn FROM m WHERE role = 'user' AND conv_id % 2 = 0 AND turn < 2 UNION ALL SELECT conv_id, n FROM m WHERE role = 'user' AND conv_id % 2 = 0 AND turn < 2 AND nr = 'assistant')
SELECT conv_id AS session_id, turn AS id, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.conv_id = c.conv_id AND g.turn = c.turn)""")
def qa_pair_delete(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("turn").alias("created_at"))
    return store.delete_pair(rows, rows.where("session_id % 2 = 0 AND id < 2")).select("session_id", "id", "role")


@query("SELECT o_custkey AS job_id, o_orderkey AS session_id, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 4 <> 0")
def cascade_delete(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("session_id"))
    m = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), "l_linenumber")
    jobs = o.select("job_id").distinct()
    left = store.delete_jobs({"jobs": jobs, "segments": jobs, "sessions": o, "messages": m}, jobs.where("job_id % 4 = 0"))
    return left["messages"].join(left["sessions"], "session_id").select("job_id", "session_id", "l_linenumber")


@query("SELECT user_id, list(event_id ORDER BY event_id)[-50:]::VARCHAR AS logs FROM events GROUP BY user_id")
def log_tail(spark, d):
    by = Window.partitionBy("user_id").orderBy(F.col("event_id").desc())
    last = t(spark, d, "events").withColumn("age", F.row_number().over(by)).where("age <= 50")
    logs = F.array_sort(F.collect_list("event_id"))
    return last.groupBy("user_id").agg(logs.alias("l")).select("user_id", F.concat(F.lit("["), F.array_join(store.tail(F.col("l"), 50).cast("array<string>"), ", "), F.lit("]")).alias("logs"))


@query("""SELECT event_type AS stage, count(*) AS n, round_even(avg(floor(value)), 1) AS avg_ms, min(floor(value)) AS min_ms, max(floor(value)) AS max_ms
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100) GROUP BY 1""")
def stage_timing_last100(spark, d):
    return store.stage_timing(t(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), F.floor("value").cast("double").alias("duration_ms")))


@query("SELECT job_id, list(speaker ORDER BY seen)::VARCHAR AS speakers FROM (SELECT conv_id AS job_id, role AS speaker, min(turn) AS seen FROM conversations GROUP BY 1, 2) GROUP BY 1")
def speakers_first_seen(spark, d):
    out = store.speakers_first_seen(segments(spark, d))
    return out.select("job_id", F.concat(F.lit("["), F.array_join("speakers", ", "), F.lit("]")).alias("speakers"))


@query("SELECT conv_id AS job_id, list(DISTINCT role ORDER BY role)::VARCHAR AS participants FROM conversations GROUP BY 1")
def participants(spark, d):
    return store.participants(segments(spark, d)).select("job_id", F.concat(F.lit("["), F.array_join("participants", ", "), F.lit("]")).alias("participants"))


@query("SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(nullif(n, 0), 1) + 1 AS version FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def version_bump(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("orders"), store.bump_version(F.col("n")).alias("version"))


@query("SELECT c_custkey AS id, base || CASE WHEN k = 1 THEN '' ELSE '_' || (k - 1) END AS name FROM (SELECT c_custkey, 'n' || c_nationkey AS base, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)")
def unique_names(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"))
    return names.unique_names(rows, spark.createDataFrame([], "name string"))


@query("""WITH RECURSIVE q AS (SELECT c_custkey AS id, 'n' || c_nationkey || CASE c_custkey % 5 WHEN 3 THEN '_' || (c_custkey % 4 + 1) WHEN 4 THEN '_1_1' ELSE '' END AS base, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer),
r AS (SELECT 0::BIGINT AS pos, NULL::BIGINT AS id, NULL::VARCHAR AS name, (SELECT list('n' || n_nationkey || '_2') FROM nation) AS used
UNION ALL SELECT pos, id, name, list_append(used, name) FROM (SELECT q.pos, q.id, r.used,
  list_filter(list_transform(range(0, 1 + len(list_filter(r.used, lambda u: starts_with(u, q.base)))), lambda k: CASE WHEN k = 0 THEN q.base ELSE q.base || '_' || k END), lambda x: NOT list_contains(r.used, x))[1] AS name
  FROM r JOIN q ON q.pos = r.pos + 1))
SELECT id, name FROM r WHERE pos > 0""")
def unique_names_colliding(spark, d):
    """Wanted names that are numbered forms of other wanted names, or taken."""
    k, nation = F.col("c_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    suffix = F.when(k % 5 == 3, F.concat(F.lit("_"), (k % 4 + 1).cast("string"))).when(k % 5 == 4, "_1_1").otherwise("")
    taken = t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("_2")).alias("name"))
    return names.unique_names(t(spark, d, "customer").select(k.alias("id"), F.concat(nation, suffix).alias("name")), taken)


@query("SELECT conv_id AS job_id, turn AS idx, CASE WHEN turn = 1 THEN 'edited' ELSE text END AS text, CASE WHEN turn = 1 THEN 'Bob' ELSE role END AS speaker FROM conversations")
def patch_segments(spark, d):
    rows = segments(spark, d).select("job_id", "idx", "text", "speaker")
    edits = rows.where("idx = 1").select("job_id", "idx", F.lit("edited").alias("text"), F.lit("Bob").alias("speaker"))
    return store.patch_segments(rows, edits).select("job_id", "idx", "text", "speaker")


@query("SELECT conv_id AS job_id, turn AS idx, CASE WHEN conv_id % 2 = 0 THEN 'new' ELSE text END AS text FROM conversations WHERE conv_id % 2 = 1 OR turn < 2")
def replace_jobs(spark, d):
    rows = segments(spark, d).select("job_id", "idx", "text")
    return store.replace_jobs(rows, rows.where("job_id % 2 = 0 AND idx < 2").withColumn("text", F.lit("new")))


@query("SELECT c_custkey AS job_id, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'made' END AS origin FROM customer")
def get_or_create(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("job_id"))
    return store.get_or_create(rows.where("job_id % 2 = 0").withColumn("origin", F.lit("old")), rows.withColumn("origin", F.lit("made")), ["job_id"])


@query("""SELECT c_custkey, (regexp_matches(c_name || '@x.org', '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS mail_ok, length(c_name) >= 8 AS secret_ok, 'customer' AS stem, '.wav' AS suffix FROM customer""")
def upload_validation(spark, d):
    rows = t(spark, d, "customer")
    path = F.lit("/up/load/customer.WAV")
    return rows.select("c_custkey", F.concat("c_name", F.lit("@x.org")).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$").alias("mail_ok"), (F.length("c_name") >= 8).alias("secret_ok"), text.stem(path).alias("stem"), text.suffix(path).alias("suffix"))


# --- quality ---

QUALITY = """
WITH RECURSIVE t AS (SELECT a.conv_id AS id, regexp_replace(a.text, '[。、！？,.!?]', '', 'g') AS r, regexp_replace(b.text, '[。、！？,.!?]', '', 'g') AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
p AS (SELECT id, string_split(regexp_replace(r, '\\s+', '', 'g'), '') AS a, string_split(regexp_replace(h, '\\s+', '', 'g'), '') AS b,
  list_filter(regexp_split_to_array(r, '\\s+'), lambda x: x <> '') AS v, list_filter(regexp_split_to_array(h, '\\s+'), lambda x: x <> '') AS w FROM t),
k AS (SELECT id, 'c' AS kind, a AS x, b AS y FROM p UNION ALL SELECT id, 'w', v, w FROM p),
x AS (SELECT id, kind, unnest(range(0, len(x))) AS i, unnest(x) AS sx FROM k),
d AS (SELECT id, kind, 0::BIGINT AS i, unnest(range(0, len(y) + 1)) AS j, unnest(list_prepend(NULL, y)) AS sy, unnest(range(0, len(y) + 1)) AS far, 0::BIGINT AS same FROM k
UNION ALL SELECT id, kind, i, j, sy, min(f - j) OVER u + j, max(s) OVER u FROM (
  SELECT d.id, d.kind, d.i + 1 AS i, d.j, sy, CASE WHEN d.j = 0 THEN d.i + 1 ELSE least(d.far + 1, lag(d.far) OVER q + (sx <> sy)::INT) END AS f, greatest(d.same, coalesce(lag(d.same) OVER q + (sx = sy)::INT, 0)) AS s
  FROM d JOIN x ON d.id = x.id AND d.kind = x.kind AND d.i = x.i WINDOW q AS (PARTITION BY d.id, d.kind ORDER BY d.j)) WINDOW u AS (PARTITION BY id, kind ORDER BY j)),
e AS (SELECT d.id, d.kind, far, same FROM d JOIN k ON d.id = k.id AND d.kind = k.kind WHERE d.i = len(k.x) AND d.j = len(k.y)),
n AS (SELECT p.*, c.far AS distance, c.same, o.far AS word_distance, len(list_intersect(list_distinct(v), list_distinct(w))) AS n, len(list_distinct(v)) AS nv, len(list_distinct(w)) AS nw FROM p JOIN e c ON c.id = p.id AND c.kind = 'c' JOIN e o ON o.id = p.id AND o.kind = 'w')
SELECT id, len(a)::BIGINT AS reference_length, len(b)::BIGINT AS hypothesis_length, distance::BIGINT AS distance, round(distance / greatest(len(a), 1), 6) AS cer, round(2 * same / (len(a) + len(b)), 6) AS ratio, round(word_distance / greatest(len(v), 1), 6) AS wer,
round(coalesce(n / nullif(nw, 0), 0), 6) AS precision, round(coalesce(n / nullif(nv, 0), 0), 6) AS recall, round(CASE WHEN n = 0 THEN 0 ELSE 2 * (n / nw) * (n / nv) / (n / nw + n / nv) END, 6) AS f1 FROM n"""


@query(QUALITY)
def transcript_quality(spark, d):
    """All measures of a conversation's second text against its first. The SQL leaves NFKC out, which DuckDB lacks and which changes none of these texts."""
    c = t(spark, d, "conversations")
    one = c.where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("reference"))
    two = c.where("turn = 1").select(F.col("conv_id").alias("id"), F.col("text").alias("hypothesis"))
    return evaluate.quality(one.join(two, "id"))


@query()
def transcript_quality_whole(spark, d):
    """As transcript_quality, for texts that SQL can't normalise; tested against the plain recurrence."""
    return transcript_quality(spark, d)


# --- events ---


@query("SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit_hourly(spark, d):
    return ev.rate_limit(t(spark, d, "events"), "user_id", 1)


@query("""SELECT user_id AS job_id, max(event_id) AS seq, max_by(event_type, event_id) AS stage, max_by(value, event_id) AS progress, list('e' || event_id ORDER BY event_id)[-50:]::VARCHAR AS logs FROM events GROUP BY 1""")
def latest_progress(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("value").alias("progress"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("message"))
    return ev.latest_progress(rows).withColumn("logs", F.concat(F.lit("["), F.array_join("logs", ", "), F.lit("]")))


@query("""WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
r AS (SELECT user_id, event_id, pos, 0::BIGINT AS out, 0::BIGINT AS flush, 1 AS held, us AS since FROM n WHERE pos = 1
UNION ALL SELECT n.user_id, n.event_id, n.pos, r.flush, CASE WHEN r.held + 1 >= 128 OR n.us - r.since >= 1000000 THEN r.flush + 1 ELSE r.flush END, CASE WHEN r.held + 1 >= 128 OR n.us - r.since >= 1000000 THEN 0 ELSE r.held + 1 END,
  CASE WHEN r.held + 1 >= 128 OR n.us - r.since >= 1000000 THEN n.us ELSE r.since END FROM r JOIN n ON n.user_id = r.user_id AND n.pos = r.pos + 1)
SELECT user_id AS message_id, event_id AS seq, out AS flush FROM r""")
def token_flush(spark, d):
    return ev.token_flushes(t(spark, d, "events").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("seq"), "ts"))


@query("""WITH RECURSIVE n AS (SELECT user_id, floor(epoch(ts))::DOUBLE AS tm, event_id % 7 = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS pos FROM events),
z AS (SELECT user_id, 0::DOUBLE AS tm, 0::BIGINT AS pos, 0::BIGINT AS count, 0::DOUBLE AS until, '' AS outcome FROM (SELECT DISTINCT user_id FROM events)),
r AS (SELECT * FROM z UNION ALL SELECT n.user_id, n.tm, n.pos, CASE WHEN n.tm < r.until THEN r.count WHEN n.ok THEN 0 ELSE r.count + 1 END,
  CASE WHEN n.tm < r.until THEN r.until WHEN n.ok THEN 0 WHEN r.count + 1 >= 10 THEN n.tm + 3600 WHEN r.count + 1 >= 5 THEN n.tm + 900 ELSE r.until END,
  CASE WHEN n.tm < r.until THEN 'rejected' WHEN n.ok THEN 'ok' WHEN r.count + 1 >= 5 THEN 'locked' ELSE 'failed' END FROM r JOIN n ON n.user_id = r.user_id AND n.pos = r.pos + 1)
SELECT user_id, tm AS ts, outcome, count AS failures FROM r WHERE pos > 0""")
def login_lockout(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return ev.login_outcomes(t(spark, d, "events").select("user_id", at.alias("ts"), F.col("event_id").alias("seq"), (F.col("event_id") % 7 == 0).alias("success")))


@query("""WITH RECURSIVE q AS (SELECT user_id, epoch(ts)::BIGINT::DOUBLE AS ts, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT) AS pos FROM (SELECT DISTINCT user_id, date_trunc('second', ts) AS ts FROM events)),
r AS (SELECT user_id, ts, pos, ts + 15 * 60 AS expires, true AS allowed FROM q WHERE pos = 1
UNION ALL SELECT q.user_id, q.ts, q.pos, CASE WHEN r.expires > q.ts + 14 * 60 THEN r.expires ELSE q.ts + 15 * 60 END, NOT r.expires > q.ts + 14 * 60 FROM r JOIN q ON q.user_id = r.user_id AND q.pos = r.pos + 1)
SELECT user_id, ts, allowed FROM r""")
def resend_cooldown(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return ev.resend_allowed(t(spark, d, "events").select("user_id", at.alias("ts")).distinct())


@query("""SELECT conv_id AS message_id, coalesce(max_by(text, turn) FILTER (turn = 5), string_agg(text, '' ORDER BY turn) FILTER (turn <> 5)) AS content, CASE WHEN count(*) FILTER (turn = 5) > 0 THEN 'completed' ELSE 'stopped' END AS status FROM conversations GROUP BY 1""")
def final_messages(spark, d):
    kind = F.when(F.col("turn") == 5, "done").otherwise("token")
    return ev.final_messages(t(spark, d, "conversations").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("seq"), kind.alias("kind"), F.col("text").alias("data")))


@query("""WITH l AS (SELECT user_id AS job_id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'transcribing' ELSE 'diarizing' END AS status FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM l)
SELECT job_id, seq, before, status FROM p WHERE before IS NOT NULL AND before <> status AND NOT (before = 'pending' AND status = 'transcribing') AND NOT (before = 'transcribing' AND status = 'diarizing')""")
def illegal_transitions(spark, d):
    s = F.element_at(F.array(F.lit("pending"), F.lit("transcribing"), F.lit("diarizing")), (F.col("event_id") % 3 + 1).cast("int"))
    return status.illegal_transitions(t(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), s.alias("status"))).select("job_id", "seq", "before", "status")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Speaker ' || turn ELSE role END AS speaker, text FROM (SELECT conv_id, turn, role, replace(text, E'\\n', ' ') AS text FROM conversations)")
def speaker_prefix(spark, d):
    body = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    rows = t(spark, d, "conversations").withColumn("body", body)
    even = F.col("turn") % 2 == 0
    rows = rows.select("conv_id", "turn", F.when(even, F.lit(None).cast("string")).otherwise(F.col("role")).alias("speaker"), F.when(even, F.concat(F.lit("Speaker "), F.col("turn").cast("string"), F.lit(": "), "body")).otherwise(F.col("body")).alias("text"))
    return transcripts.speaker_prefix(rows)


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN NULL ELSE role END AS speaker, CASE WHEN turn % 2 = 0 THEN 'Speaker ' || turn || ': ' || text ELSE text END AS text FROM conversations),
h AS (SELECT *, speaker IS NULL AND regexp_matches(text, '^\\s*([A-Za-z0-9_\\-\\s]{1,40}):\\s*([^\\n]*)\\n?$') AS hit FROM c)
SELECT conv_id, turn, CASE WHEN hit THEN 'Speaker ' || turn ELSE speaker END AS speaker,
CASE WHEN hit THEN regexp_extract(text, '^\\s*([A-Za-z0-9_\\-\\s]{1,40}):\\s*([^\\n]*)\\n?$', 2) ELSE text END AS text FROM h""")
def speaker_prefix_whole(spark, d):
    """Whole texts with their line ends; as in the reference, a name is only taken from a text of one line."""
    even = F.col("turn") % 2 == 0
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.when(even, F.lit(None).cast("string")).otherwise(F.col("role")).alias("speaker"), F.when(even, F.concat(F.lit("Speaker "), F.col("turn").cast("string"), F.lit(": "), "text")).otherwise(F.col("text")).alias("text"))
    return transcripts.speaker_prefix(rows)


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN NULL ELSE role END AS speaker,
  CASE turn % 4 WHEN 0 THEN chr(9) || 'Ann-' || turn || chr(9) || ': ' || replace(text, chr(10), chr(13)) || ' ' || chr(10) WHEN 2 THEN 'Bob B_' || turn || ':' || chr(10) || replace(text, chr(10), chr(8232)) ELSE '  ' || text || chr(9) END AS text FROM conversations),
s AS (SELECT conv_id, turn, speaker, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM c),
h AS (SELECT *, speaker IS NULL AND regexp_matches(text, '^([A-Za-z0-9_\\-\\s]{1,40}):\\s*([^\\n]*)$') AS hit FROM s)
SELECT conv_id, turn, CASE WHEN hit THEN trim(regexp_extract(text, '^([A-Za-z0-9_\\-\\s]{1,40}):', 1), ' ' || chr(9)) ELSE speaker END AS speaker,
CASE WHEN hit THEN regexp_extract(text, '^[A-Za-z0-9_\\-\\s]{1,40}:\\s*([^\\n]*)$', 1) ELSE text END AS text FROM h""")
def speaker_prefix_marks(spark, d):
    """Names between tabs, line ends that aren't \\n, and texts with white space around them."""
    turn, line = F.col("turn").cast("string"), lambda mark: F.replace(F.col("text"), F.lit("\n"), F.lit(mark))
    ann = F.concat(F.lit("\tAnn-"), turn, F.lit("\t: "), line("\r"), F.lit(" \n"))
    bob = F.concat(F.lit("Bob B_"), turn, F.lit(":\n"), line("\u2028"))
    body = F.when(F.col("turn") % 4 == 0, ann).when(F.col("turn") % 4 == 2, bob).otherwise(F.concat(F.lit("  "), "text", F.lit("\t")))
    return transcripts.speaker_prefix(t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.col("role")).alias("speaker"), body.alias("text")))


@query("SELECT event_id, CASE WHEN b <> 0 AND (v < b - 0.1 OR v < b) THEN v + b ELSE v END AS at FROM (SELECT event_id, (event_id % 50)::DOUBLE AS v, (event_id % 4 * 20)::DOUBLE AS b FROM events)")
def chunk_time_base(spark, d):
    return t(spark, d, "events").select("event_id", stitch.absolute_time((F.col("event_id") % 50).cast("double"), (F.col("event_id") % 4 * 20).cast("double")).alias("at"))
