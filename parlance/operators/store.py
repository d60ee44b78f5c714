"""The record store: edits as new tables, ordered reads, and what follows foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail(a: Column, n: int) -> Column:
    """The last n elements; all of a shorter array."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def rename_speaker(segments: DataFrame, job_id: object, old: str, new: str) -> DataFrame:
    hit = (F.col("job_id") == F.lit(job_id)) & (F.col("speaker") == old)
    return segments.withColumn("speaker", F.when(hit, F.lit(new)).otherwise(F.col("speaker")))


def rename_count(segments: DataFrame, job_id: object, old: str) -> DataFrame:
    """One row: how many segments `rename_speaker` changes."""
    return segments.agg(F.count_if((F.col("job_id") == F.lit(job_id)) & (F.col("speaker") == old)).alias("renamed"))


def segment_rows(segments: DataFrame) -> DataFrame:
    """Segments (job_id, ord, start, end, speaker, text) as stored: numbered from 0, times 0, speaker UNKNOWN and text empty where they are missing."""
    by = Window.partitionBy("job_id").orderBy("ord")
    return segments.select(
        "job_id", (F.row_number().over(by) - 1).alias("idx"), F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", F.lit(0.0)).alias("end"),
        F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"),
    )


def update_rows(stored: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Point updates: what `edits` has for a key, where it isn't null; a key has one edit at most, keys that aren't stored are ignored."""
    changed = [c for c in edits.columns if c not in keys]
    out = stored.join(edits.select(*keys, *[F.col(c).alias(f"__{c}") for c in changed]), keys, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in stored.columns])


def by_key(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The row of a primary or unique key; on a table partitioned by the key only its partition is read."""
    return rows.where(F.col(column) == F.lit(value)).limit(1)


def owned(rows: DataFrame, jobs: DataFrame, user_id: object) -> DataFrame:
    """Rows of jobs (job_id, user_id) that belong to a user; others aren't found."""
    return rows.join(jobs.where(F.col("user_id") == F.lit(user_id)).select("job_id"), "job_id", "left_semi")


def delete_history(messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages without those of `sessions` (session_id), and how many went (session_id, deleted); the sessions stay."""
    gone = messages.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    return messages.join(sessions.select("session_id").distinct(), "session_id", "left_anti"), gone.groupBy("session_id").agg(F.count(F.lit(1)).alias("deleted"))


def new_messages(messages: DataFrame) -> DataFrame:
    """Chat messages (session_id, id, role, content, sources, status) as stored: completed unless they say so, empty sources null."""
    sources = F.when(F.coalesce("sources", F.lit("")).isin("", "[]"), None).otherwise(F.col("sources"))
    return messages.withColumn("status", F.coalesce("status", F.lit("completed"))).withColumn("sources", sources)


def new_users(users: DataFrame) -> DataFrame:
    """Users (username, password_hash, display_name, is_admin) as stored: shown by their username unless they say otherwise, no admins unless they are."""
    shown = F.coalesce(F.nullif("display_name", F.lit("")), F.col("username"))
    return users.withColumns({"display_name": shown, "is_admin": F.coalesce("is_admin", F.lit(False)), "failed_login_attempts": F.lit(0)})


def social_users(claims: DataFrame, users: DataFrame) -> DataFrame:
    """New users for sign-ins (id, uid, name, email, email_verified) whose uid no user (username, uid) has, in the order of ids.

    Of sign-ins with one uid the first counts; without a uid there is none. The username is the name, the e-mail's first part, or
    fb_ and the uid's first eight characters, made unique among all users."""
    from parlance.operators.names import unique_names

    first = claims.where("coalesce(uid, '') <> ''").join(users.select("uid"), "uid", "left_anti").groupBy("uid").agg(F.min_by(F.struct("id", "name", "email", "email_verified"), "id").alias("c")).select("uid", "c.*")
    mail = F.coalesce("email", F.lit(""))
    name = F.coalesce(F.nullif("name", F.lit("")), F.when(mail != "", F.substring_index(mail, "@", 1)), F.concat(F.lit("fb_"), F.substring("uid", 1, 8)))
    named = unique_names(first.select("id", name.alias("name")), users.select(F.col("username").alias("name"))).withColumnRenamed("name", "username")
    out = first.join(named, "id").select("id", "username", "uid", "email", F.coalesce("email_verified", F.lit(False)).alias("email_verified"), F.coalesce(F.nullif("name", F.lit("")), F.col("username")).alias("display_name"))
    return out.withColumns({"is_admin": F.lit(False), "failed_login_attempts": F.lit(0)})


def new_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs (job_id, user_id, filename) as stored: pending, without progress, in their first version."""
    return jobs.withColumns({"status": F.lit("pending"), "progress": F.lit(0.0), "error": F.lit(None).cast("string"), "logs": F.lit("[]"), "transcript_version": F.lit(1)})


def restart_jobs(tables: dict[str, DataFrame], chosen: DataFrame) -> dict[str, DataFrame]:
    """jobs and segments after a restart of `chosen` (job_id): failed and cancelled ones are pending again and lose their segments."""
    from parlance.functions.status import restartable

    again = tables["jobs"].join(chosen.select("job_id").distinct(), "job_id", "left_semi").where(restartable(F.col("status"))).select("job_id", F.lit(True).alias("__again"))
    jobs = tables["jobs"].join(again, "job_id", "left")
    reset = {"status": F.lit("pending"), "progress": F.lit(0.0), "error": F.lit(None).cast("string"), "logs": F.lit("[]")}
    jobs = jobs.withColumns({c: F.when(F.col("__again"), v).otherwise(F.col(c)) for c, v in reset.items()}).drop("__again")
    return {"jobs": jobs, "segments": tables["segments"].join(again.select("job_id"), "job_id", "left_anti")}


def message_rows(messages: DataFrame, source: str) -> DataFrame:
    """Messages as they are shown: sources decoded (broken ones empty), status completed unless they say so."""
    from parlance.functions.text import json_or_empty

    return messages.withColumn("sources", json_or_empty(F.col("sources"), source)).withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("completed")))


def settings_by_group(settings: DataFrame) -> DataFrame:
    """(group, settings) of rows (group, key, value), keys in order."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return settings.groupBy("group").agg(F.map_from_entries(pairs).alias("settings"), F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("listed"))


def job_counters(jobs: DataFrame) -> DataFrame:
    """One row: jobs that failed, that completed, that wait, and that run, and the oldest start of a running one."""
    s = F.col("status")
    running = s.isin("transcribing", "diarizing", "aligning", "indexing", "reindexing")
    counts = {"failed": s == "failed", "completed": s == "completed", "queued": s == "pending", "running": running}
    return jobs.agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.min(F.when(running, F.col("started_at"))).alias("running_since"))


def languages(results: DataFrame) -> DataFrame:
    """(job_id, languages): distinct, in the order in which the results (job_id, ord, inferred_languages, languages, language) name them.

    A result's first filled field counts: the two lists, then the single language."""
    listed = F.when(F.size(F.coalesce("inferred_languages", F.array())) > 0, F.col("inferred_languages")).when(F.size(F.coalesce("languages", F.array())) > 0, F.col("languages")).otherwise(F.array("language"))
    rows = results.select("job_id", "ord", F.posexplode(listed).alias("at", "name")).where("name <> ''")
    first = rows.groupBy("job_id", "name").agg(F.min(F.struct("ord", "at")).alias("seen"))
    return first.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "name"))), lambda x: x["name"]).alias("languages"))


def replace_jobs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent replacement of whole jobs."""
    return stored.join(new.select("job_id").distinct(), "job_id", "left_anti").unionByName(new)


def overwrite_partitions(rows: DataFrame, path: str) -> None:
    """The same on disk: only the partitions of the jobs in `rows` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def patch_segments(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Text and speaker of edited positions (job_id, idx, text, speaker); all else stays."""
    e = edits.select("job_id", "idx", F.col("text").alias("e_text"), F.col("speaker").alias("e_speaker"))
    out = base.join(e, ["job_id", "idx"], "left")
    return out.withColumn("text", F.coalesce("e_text", "text")).withColumn("speaker", F.coalesce("e_speaker", "speaker")).drop("e_text", "e_speaker")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def get_or_create(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(wanted.join(stored.select(*keys).distinct(), keys, "left_anti"))


def delete_jobs(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """jobs, segments, sessions and messages without the jobs of `gone` (job_id) and all that hangs on them."""
    sessions = tables["sessions"].join(gone, "job_id", "left_semi").select("session_id")
    keep = {k: tables[k].join(gone, "job_id", "left_anti") for k in ("jobs", "segments", "sessions")}
    return keep | {"messages": tables["messages"].join(sessions, "session_id", "left_anti")}


def delete_pair(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Messages without the chosen user messages (session_id, id) and the assistant message right behind each."""
    by = Window.partitionBy("session_id").orderBy("created_at", "id")
    rows = messages.withColumn("next_id", F.lead("id").over(by)).withColumn("next_role", F.lead("role").over(by))
    asked = rows.join(chosen.select("session_id", "id"), ["session_id", "id"], "left_semi").where("role = 'user'")
    gone = asked.select("session_id", "id").unionByName(asked.where("next_role = 'assistant'").select("session_id", F.col("next_id").alias("id")))
    return messages.join(gone, ["session_id", "id"], "left_anti")


def bump_version(version: Column) -> Column:
    return F.coalesce(F.nullif(version, F.lit(0)), F.lit(1)) + 1


def speakers_first_seen(segments: DataFrame) -> DataFrame:
    seen = segments.groupBy("job_id", "speaker").agg(F.min("idx").alias("at"))
    return seen.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "speaker"))), lambda x: x["speaker"]).alias("speakers"))


def participants(segments: DataFrame) -> DataFrame:
    return segments.groupBy("job_id").agg(F.array_sort(F.collect_set(F.coalesce("speaker", F.lit("UNKNOWN")))).alias("participants"))


def stage_timing(samples: DataFrame, last: int = 100) -> DataFrame:
    """(stage, n, avg_ms, min_ms, max_ms) over each stage's latest samples."""
    by = Window.partitionBy("stage").orderBy(F.col("seq").desc())
    rows = samples.withColumn("age", F.row_number().over(by)).where(F.col("age") <= last)
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("duration_ms"), 1).alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"))
