"""Versions, two writers, failures at each step, readers during a swap; embedding that is taken up again."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from parlance.operators import commits, embedding


def test_versions_restore_and_clean(spark, tmp_path):
    root = f"{tmp_path}/t"
    for n in (3, 4, 5):
        assert commits.commit(spark.range(n), root, model="m").version == n - 2
    old = commits.read(spark, root, 1)
    assert [commits.read(spark, root, v).count() for v in (1, 2, 3, None)] == [3, 4, 5, 5]
    assert commits.restore(spark, root, 1).facts == {"rows": 3, "model": "m", "restored": 1} and commits.read(spark, root).count() == 3
    assert commits.clean(spark, root, 3600) == []
    orphan = f"{root}/data/broken"
    spark.range(1).write.parquet(orphan)
    gone = commits.clean(spark, root, 0, now=commits.last(spark, root).at + 100)
    assert len(gone) == 3 and not os.path.exists(orphan)  # versions 2 and 3 and what no commit names
    assert old.count() == 3 and commits.read(spark, root).count() == 3
    with pytest.raises(ValueError):
        commits.restore(spark, root, 2)
    with pytest.raises(ValueError):
        commits.read(spark, f"{tmp_path}/none")


def test_two_writers_from_one_version(spark, tmp_path):
    root = f"{tmp_path}/t"
    base = commits.commit(spark.range(1), root).version
    won, lost = [], []

    def write(n):
        try:
            won.append(commits.commit(spark.range(n), root, base=base))
        except commits.Conflict:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in (10, 20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 1
    assert commits.read(spark, root).count() == won[0].facts["rows"] and len(os.listdir(f"{root}/data")) == 2
    commits.commit(spark.range(7), root)  # without a base the last writer wins
    assert [c.version for c in commits.log(spark, root)] == [1, 2, 3]


def test_a_failure_at_each_step_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    commits.commit(spark.range(3), root)
    with pytest.raises(Exception):  # noqa: B017  while rows are written
        commits.commit(spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("x"))).otherwise(F.col("id")).alias("id")), root)
    with pytest.raises(ValueError):
        commits.commit(spark.range(0), root)
    for step in ("create", "rename"):
        def broken(self, name, text, step=step):
            if step == "rename":
                self.fs.create(self.path("log/.draft"), True).close()
            raise OSError(step)

        monkeypatch.setattr(commits.Files, "put_new", broken)
        with pytest.raises(OSError):
            commits.commit(spark.range(5), root)
        monkeypatch.undo()
        assert commits.read(spark, root).count() == 3 and len(os.listdir(f"{root}/data")) == 1
    commits.clean(spark, root, 0, now=commits.last(spark, root).at + 1e6)
    assert not os.path.exists(f"{root}/log/.draft")
    assert commits.commit(spark.range(6), root).version == 2


def test_embedding_is_taken_up_again(spark, tmp_path):
    root, seen = f"{tmp_path}/e", f"{tmp_path}/seen"
    os.makedirs(seen)
    docs = spark.createDataFrame([(i, f"text {i}" if i % 7 else None) for i in range(300)], "id bigint, text string")

    def embed(texts):
        with open(f"{seen}/{os.getpid()}", "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        if os.path.exists(f"{seen}/stop") and any(t == "text 5" for t in texts):
            raise RuntimeError("broken off")
        return [[float(len(t))] for t in texts]

    def count():
        return sum(len(open(f"{seen}/{n}").readlines()) for n in os.listdir(seen) if n != "stop")

    open(f"{seen}/stop", "w").close()
    told = []
    with pytest.raises(Exception):  # noqa: B017
        embedding.embed_documents(docs, embed, root, batch_size=10, batches_a_wave=4, report=lambda pct, n: told.append((round(pct, 3), n)))
    os.remove(f"{seen}/stop")
    done = embedding.finished(spark, root)
    before = count()
    got = embedding.embed_documents(docs, embed, root, batch_size=10, batches_a_wave=4, report=lambda pct, n: told.append((round(pct, 3), n)))
    assert sorted((r.id, r.text, r.embedding) for r in got.collect()) == [(i, t, [float(len(t))]) for i in range(300) for t in [f"text {i}" if i % 7 else ""]]
    kept = spark.read.parquet(f"{root}/docs").where(F.col("batch").isin(sorted(done)) if done else F.lit(False)).count()
    assert count() - before == 300 - kept
    assert told[0] == (40.0, 0) and told[-1] == (85.0, len({r.batch for r in spark.read.parquet(f"{root}/docs").select("batch").distinct().collect()}))
    before = count()
    assert embedding.embed_documents(docs, embed, root).count() == 300 and count() == before
    with pytest.raises(embedding.Cancelled):
        embedding.embed_documents(docs, embed, f"{tmp_path}/c", batch_size=10, batches_a_wave=4, cancelled=lambda: len(embedding.finished(spark, f"{tmp_path}/c")) > 5)
    assert 5 < len(embedding.finished(spark, f"{tmp_path}/c")) < 30
    assert embedding.embed_documents(docs.limit(0), embed, f"{tmp_path}/n").count() == 0


def test_batches_are_halved_once_when_memory_runs_out():
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if len(texts) > 4:
            raise MemoryError
        return [[1.0]] * len(texts)

    assert len(embedding.vectors(embed, ["x"] * 7)) == 7 and calls == [7, 3, 4]
    with pytest.raises(MemoryError):
        embedding.vectors(embed, ["x"] * 20)
    assert embedding.progress(5, 10, 1) == 62.5 and embedding.progress(5, 0, 30) == 84
