"""Streams with typed state and timers: progress with its last log lines, and answers that flush, are checked and always end.

The state needs the RocksDB provider (`spark.sql.streaming.stateStore.providerClass`); `with_state_store` sets it. A row's place in its
job or answer is `seq`; rows of one key are taken in the order of seq within a batch, and batches one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.streaming.events import FOLLOWS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def sorted_rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(batches))
    return rows.sort_values("seq", kind="stable").astype(object).where(rows.notna(), None)


class Progress(StatefulProcessor):
    """A job's last event and its last messages, which are few, by seq."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, stage string, progress double")
        self.logs = handle.getListState("logs", "seq bigint, message string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = sorted_rows(rows)
        logs = [(r.seq, r.message) for r in rows.itertuples() if r.message]
        if logs:
            logs = sorted([*(self.logs.get() if self.logs.exists() else []), *logs], key=lambda x: x[0])[-self.most :]
            self.logs.put([tuple(x) for x in logs])
        else:
            logs = list(self.logs.get()) if self.logs.exists() else []
        newest = rows.iloc[-1]
        if not self.last.exists() or newest.seq >= self.last.get()[0]:
            self.last.update((int(newest.seq), newest.stage, newest.progress))
        seq, stage, progress = self.last.get()
        yield pd.DataFrame({"job_id": [key[0]], "seq": [seq], "stage": [stage], "progress": [progress], "logs": [[m for _, m in logs]]})

    def close(self) -> None:
        pass


def latest_progress_stream(events: DataFrame, logs: int = 50) -> DataFrame:
    """(job_id, seq, stage, progress, logs) of a stream of (job_id, seq, stage, progress, message), after each batch for the jobs in it; output mode update."""
    rows = events.select("job_id", F.col("seq").cast("bigint").alias("seq"), "stage", F.col("progress").cast("double").alias("progress"), "message")
    kind = rows.schema["job_id"].dataType.simpleString()
    return rows.groupBy("job_id").transformWithStateInPandas(Progress(logs), f"job_id {kind}, seq bigint, stage string, progress double, logs array<string>", "update", "none")


class Answer(StatefulProcessor):
    """An answer's open tokens, what is written already, the kind of the event before, and a timer that ends it if it falls silent."""

    def __init__(self, most: int, after_s: float, silent_s: float) -> None:
        self.most, self.after, self.silent = most, after_s, silent_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "token string")
        self.written = handle.getListState("written", "text string")
        self.at = handle.getValueState("at", "flush bigint, since bigint, before string, ended boolean, timer bigint")

    def wait(self, timer: int, now_s: float) -> int:
        """Move the timer to when an answer silent since `now_s` ends."""
        if timer:
            self.handle.deleteTimer(timer)
        timer = int((now_s + self.silent) * 1000)
        self.handle.registerTimer(timer)
        return timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flush, since, before, ended, timer = self.at.get() if self.at.exists() else (0, None, None, False, 0)
        held = [x[0] for x in self.open.get()] if self.open.exists() else []
        fresh, out, now = [], [], 0.0
        for r in sorted_rows(rows).itertuples():
            now = max(now, r.ts.timestamp())
            if r.kind not in FOLLOWS.get(before, ()):
                out.append((key[0], r.seq, "misplaced", None, r.kind, before))
            before = r.kind
            if ended:
                continue
            if r.kind == "token":
                us = round(r.ts.timestamp() * 1_000_000)
                since = us if since is None else since
                held.append(r.data or "")
                if len(held) >= self.most or us - since >= self.after * 1_000_000:
                    out.append((key[0], r.seq, "flush", flush, "".join(held), None))
                    fresh.append("".join(held))
                    flush, held, since = flush + 1, [], us
            elif r.kind in ("done", "error"):
                whole = "".join([x[0] for x in self.written.get()] if self.written.exists() else []) + "".join(fresh + held)
                out.append((key[0], r.seq, "final", None, r.data if r.kind == "done" and r.data is not None else whole, "completed" if r.kind == "done" else "failed"))
                ended, held, fresh = True, [], []
        if ended:
            self.written.clear()
            self.open.clear()
        else:
            if fresh:
                self.written.appendList([(x,) for x in fresh])
            self.open.put([(x,) for x in held]) if held else self.open.clear()
        self.at.update((flush, since, before, ended, self.wait(timer, now)))
        yield self.rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The answer fell silent: if it has no end it gets one, made from its tokens; then it is forgotten."""
        out = []
        if self.at.exists() and not self.at.get()[3]:
            parts = [x[0] for state in (self.written, self.open) if state.exists() for x in state.get()]
            out.append((key[0], None, "final", None, "".join(parts), "stopped"))
        for state in (self.at, self.open, self.written):
            state.clear()
        yield self.rows(out)

    @staticmethod
    def rows(out: list[tuple]) -> pd.DataFrame:
        names = ["message_id", "seq", "event", "flush", "text", "status"]
        return pd.DataFrame(out, columns=names).astype({"seq": "Int64", "flush": "Int64"})

    def close(self) -> None:
        pass


def answer_stream(events: DataFrame, most: int = 128, after_s: float = 1.0, silent_s: float = 300.0, late: str = "1 minute") -> DataFrame:
    """(message_id, seq, event, flush, text, status) of a stream of answers' events (message_id, seq, ts, kind, data). An event is

    - flush: the tokens that are written together, as in `token_flushes`; - misplaced: a kind that may not follow the one before (in status);
    - final: the answer (what `done` says, or else the tokens) and completed or failed; stopped where nothing came for `silent_s` (by the watermark)."""
    rows = events.select("message_id", F.col("seq").cast("bigint").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "kind", "data").withWatermark("ts", late)
    kind = rows.schema["message_id"].dataType.simpleString()
    schema = f"message_id {kind}, seq bigint, event string, flush bigint, text string, status string"
    return rows.groupBy("message_id").transformWithStateInPandas(Answer(most, after_s, silent_s), schema, "append", "eventTime")
