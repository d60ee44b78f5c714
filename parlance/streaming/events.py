"""Stateful event handling. Each function works on a batch and, where it says so, on a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators.lineage import stored
from parlance.operators.scan import lookahead, orbit, running, same_named
from parlance.operators.store import tail

#: Failures, and for how many minutes they lock an account.
LOCKS = ((10, 60), (5, 15))


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def rate_limit(events: DataFrame, key: str, most: int, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, window start, n) with more than `most` events; works on streams, whose windows close at the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", every).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most).select(key, F.col("w.start").alias("window_start"), "n")


def latest_progress(events: DataFrame, logs: int = 50) -> DataFrame:
    """(job_id, seq, stage, progress, logs): each job's last event and its last messages that say something."""
    says = F.coalesce("message", F.lit("")) != ""
    by = Window.partitionBy("job_id", "says").orderBy(F.col("seq").desc())
    rows = events.withColumn("says", says).withColumn("age", F.row_number().over(by)).where(F.col("age") <= logs)
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("says"), F.struct("seq", "message")))), lambda x: x["message"])
    last = F.max_by(F.struct("seq", "stage", "progress"), "seq")
    return rows.groupBy("job_id").agg(last.alias("l"), lines.alias("logs")).select("job_id", "l.seq", "l.stage", "l.progress", tail(F.col("logs"), logs).alias("logs"))


def token_flushes(tokens: DataFrame, most: int = 128, after_s: float = 1.0) -> DataFrame:
    """(message_id, seq, flush): tokens numbered by the flush that writes them. A flush comes with its `most`-th token, or with
    one that arrives `after_s` or more seconds after the flush before; the state resets there, so a message is a fold."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        flush, held, since, out = 0, 0, None, []
        for ts in pdf["ts"]:
            since = ts if since is None else since
            held += 1
            out.append(flush)
            if held >= most or (ts - since).total_seconds() >= after_s:
                flush, held, since = flush + 1, 0, ts
        return pd.DataFrame({"message_id": pdf["message_id"], "seq": pdf["seq"], "flush": out})

    rows = tokens.select("message_id", "seq", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("message_id").applyInPandas(fold, f"message_id {kind(rows, 'message_id')}, seq {kind(rows, 'seq')}, flush bigint")


def lock_state(attempts: list[tuple], count: int, locked_until: float) -> tuple[int, float, list[tuple]]:
    """Fold over (ts, success) of one user: failures since the last success, end of the lock, and (ts, outcome, count) per attempt."""
    out = []
    for ts, success in attempts:
        if ts < locked_until:
            out.append((ts, "rejected", count))
            continue
        if success:
            count, locked_until = 0, 0.0
            out.append((ts, "ok", 0))
            continue
        count += 1
        minutes = next((m for n, m in LOCKS if count >= n), None)
        locked_until = ts + 60 * minutes if minutes else locked_until
        out.append((ts, "locked" if minutes else "failed", count))
    return count, locked_until, out


LOCK_ROWS = "user_id {}, ts double, outcome string, failures bigint"


def login_outcomes(attempts: DataFrame) -> DataFrame:
    """(user_id, ts, outcome, failures) of attempts (user_id, ts in seconds, success); a batch. A column seq orders attempts of one second."""
    order = [c for c in ("ts", "seq") if c in attempts.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        _, _, rows = lock_state(list(zip(pdf["ts"], pdf["success"])), 0, 0.0)
        return pd.DataFrame([(pdf["user_id"].iloc[0], *r) for r in rows], columns=["user_id", "ts", "outcome", "failures"])

    return attempts.select("user_id", "success", *order).groupBy("user_id").applyInPandas(run, LOCK_ROWS.format(kind(attempts, "user_id")))


def login_outcomes_stream(attempts: DataFrame) -> DataFrame:
    """The same over a stream: the state is the count of failures and the end of the lock."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, until = state.get if state.exists else (0, 0.0)
        pdf = pd.concat(list(batches)).sort_values("ts")
        count, until, rows = lock_state(list(zip(pdf["ts"], pdf["success"])), count, until)
        state.update((count, until))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["user_id", "ts", "outcome", "failures"])

    return attempts.groupBy("user_id").applyInPandasWithState(run, LOCK_ROWS.format(kind(attempts, "user_id")), "count bigint, until double", "append", GroupStateTimeout.NoTimeout)


def resend_allowed(requests: DataFrame, cooldown_s: float = 60.0) -> DataFrame:
    """`requests` (user_id, ts in seconds) with allowed: a code is issued unless one was issued less than the cooldown before.

    A refused request doesn't count, so what is issued is the path from a user's first request to the first one behind the cooldown,
    and so on (`orbit`). Of requests at one time the first (by seq, if there is one) counts."""
    us, order = F.round(F.col("ts") * 1_000_000).cast("bigint"), ["seq"] if "seq" in requests.columns else [F.lit(0)]
    reach = round(cooldown_s * 1_000_000)
    rows = stored(requests.withColumn("__us", us).withColumn("__nth", F.row_number().over(Window.partitionBy("user_id", "__us").orderBy(*order))))
    times = running(rows.where("__nth = 1").select("user_id", F.col("__us").alias("at")), ["user_id"], F.floor(F.col("at") / (64 * reach)), ["at"], {"pos": F.lit(1)})
    times = stored(times)
    by = Window.partitionBy("user_id", "block").orderBy("at").rangeBetween(0, reach - 1)
    steps = lookahead(times, reach, 64 * reach).withColumn("next", F.max("pos").over(by) + 1).where("core")
    issued = orbit(steps.select("user_id", "pos", "next"), ["user_id"])
    a, b = times.alias("a"), issued.alias("b")
    issued = a.join(b, same_named("a", "b", ["user_id"]) & (F.col("a.pos") == F.col("b.pos"))).select("a.user_id", "a.at", F.lit(1).alias("nth"))
    a, b = rows.alias("a"), issued.alias("b")
    met = a.join(b, same_named("a", "b", ["user_id"]) & F.col("a.__us").eqNullSafe(F.col("b.at")) & (F.col("a.__nth") == F.col("b.nth")), "left")
    return met.select(*[f"a.{c}" for c in requests.columns if c != "allowed"], F.col("b.nth").isNotNull().alias("allowed"))


def resend_allowed_stream(requests: DataFrame, cooldown_s: float = 60.0) -> DataFrame:
    """(user_id, ts, allowed) of a stream of requests, each batch in the order of time: the state is when a user's last code was issued."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, rows = state.get[0] if state.exists else None, []
        for ts in sorted(t for pdf in batches for t in pdf["ts"]):
            us = round(ts * 1_000_000)
            allowed = last is None or us - last >= round(cooldown_s * 1_000_000)
            last = us if allowed else last
            rows.append((key[0], ts, allowed))
        state.update((last,))
        yield pd.DataFrame(rows, columns=["user_id", "ts", "allowed"])

    rows = requests.select("user_id", F.col("ts").cast("double").alias("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(run, f"user_id {kind(rows, 'user_id')}, ts double, allowed boolean", "last bigint", "append", GroupStateTimeout.NoTimeout)


def final_messages(tokens: DataFrame) -> DataFrame:
    """(message_id, content, status) of an event log (message_id, seq, kind, data): what `done` says, or the tokens that came."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "token", F.struct("seq", "data")))), lambda x: x["data"]), "")
    end = F.max_by(F.when(F.col("kind").isin("done", "error"), F.struct("kind", "data")), F.when(F.col("kind").isin("done", "error"), F.col("seq")))
    rows = tokens.groupBy("message_id").agg(text.alias("text"), end.alias("end"))
    status = F.when(F.col("end.kind") == "done", "completed").when(F.col("end.kind") == "error", "failed").otherwise("stopped")
    return rows.select("message_id", F.coalesce(F.when(F.col("end.kind") == "done", F.col("end.data")), F.col("text")).alias("content"), status.alias("status"))


def token_flushes_stream(tokens: DataFrame, most: int = 128, after_s: float = 1.0) -> DataFrame:
    """(message_id, flush, seq, text) of a stream (message_id, seq, ts, token): what each flush writes and its last token's number.

    The state of a message is its open buffer, which holds fewer than `most` tokens."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flush, held, since = state.get if state.exists else (0, "", None)
        buffer, rows = (json.loads(held) if held else []), []
        for seq, ts, token in pd.concat(list(batches)).sort_values("seq")[["seq", "ts", "token"]].itertuples(index=False):
            us = round(ts.timestamp() * 1_000_000)
            since = us if since is None else since
            buffer.append(token)
            if len(buffer) >= most or us - since >= after_s * 1_000_000:
                rows.append((key[0], flush, seq, "".join(buffer)))
                flush, buffer, since = flush + 1, [], us
        state.update((flush, json.dumps(buffer), since))
        yield pd.DataFrame(rows, columns=["message_id", "flush", "seq", "text"])

    rows = tokens.select("message_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "token")
    schema = f"message_id {kind(rows, 'message_id')}, flush bigint, seq {kind(rows, 'seq')}, text string"
    return rows.groupBy("message_id").applyInPandasWithState(run, schema, "flush bigint, held string, since bigint", "append", GroupStateTimeout.NoTimeout)


def new_lines(lines: DataFrame, shown: DataFrame) -> DataFrame:
    """Log lines (job_id, seq, line) behind the last one shown (job_id, seq) of each job: a tail by number, which a capped log can't stall."""
    seen = shown.select("job_id", F.col("seq").alias("__seen"))
    return lines.join(seen, "job_id", "left").where(F.col("__seen").isNull() | (F.col("seq") > F.col("__seen"))).drop("__seen")


def code_valid(expires: Column, now: Column, purpose: Column, wanted: str) -> Column:
    """Whether a one-time code may be used: right purpose, not expired, not missing."""
    return F.coalesce((purpose == wanted) & (expires > now), F.lit(False))


#: The events of an answer, and which may follow which.
FOLLOWS = {
    None: ("sources", "error"), "sources": ("token", "retrieval_level_note", "done", "error"), "token": ("token", "retrieval_level_note", "done", "error"),
    "retrieval_level_note": ("done", "error"), "done": (), "error": (),
}


def protocol_errors(events: DataFrame) -> DataFrame:
    """Rows of (message_id, seq, kind) that may not follow the one before."""
    by = Window.partitionBy("message_id").orderBy("seq")
    rows = events.withColumn("before", F.lag("kind").over(by))
    fine = F.lit(False)
    for before, after in FOLLOWS.items():
        fine = F.when(F.col("before").isNull() if before is None else F.col("before") == before, F.col("kind").isin(*after)).otherwise(fine)
    return rows.where(~fine)
