"""Readers: good and broken files in batch and stream, caches, prepared documents, and trees of any depth."""

import json

import pytest

from parlance.operators import tree
from parlance.sources import documents, transcripts

FILES = {
    "list.json": '[{"a": 1}, {"b": [null, "x\\n"]}]',
    "held.json": ' \n{"segments": [{"t": 1}, {"t": 2}], "n": 1}',
    "one.json": '{"text": "é", "segment": 1}',
    "wrong.json": '{"segments": 3}',
    "cut.json": '[{"a": 1}, {"b"',
    "empty.json": "",
    "blank.json": " \n\t\n",
    "lines.txt": 'x\n{"a": 1}\n\n  {"b": 2} \n{"c"\n[1]\n7\n',
    "none.json": "[]",
}
WANT = {
    ("list.json", None, '{"a":1}', None), ("list.json", None, '{"b":[null,"x\\n"]}', None), ("held.json", None, '{"t":1}', None), ("held.json", None, '{"t":2}', None),
    ("one.json", None, '{"segment":1,"text":"é"}', None), ("wrong.json", None, None, "segments is not a list"), ("cut.json", None, None, "not JSON"),
    ("lines.txt", 1, None, "not JSON"), ("lines.txt", 2, '{"a":1}', None), ("lines.txt", 4, '{"b":2}', None), ("lines.txt", 5, None, "not JSON"), ("lines.txt", 6, None, "not an object"), ("lines.txt", 7, None, "not an object"),
}


def found(df):
    return {(r.file.rsplit("/", 1)[1], r.line, r.doc, r.reason) for r in df.collect()}


def test_good_and_broken_files(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    rows = documents.read_documents(spark, str(tmp_path))
    assert found(rows) == WANT
    good, broken = documents.parted(rows)
    assert good.count() == 7 and broken.count() == 6 and broken.columns == ["file", "line", "reason"]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\nx')
    assert found(documents.read_documents(spark, f"{tmp_path}/l", lines=True)) == {("a.jsonl", 1, '{"a":1}', None), ("a.jsonl", 2, '{"a":2}', None), ("a.jsonl", 3, None, "not JSON")}


def test_the_stream_equals_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = set()
    names = list(FILES)
    for part in (names[:4], names[4:]):
        for name in part:
            (tmp_path / "in" / name).write_text(FILES[name])
        q = documents.stream_documents(spark, f"{tmp_path}/in").writeStream.foreachBatch(lambda b, n: got.update(found(b))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    assert got == WANT


def test_caches_prepared_documents_and_any_files(spark, tmp_path):
    transcripts.write_cache(spark.createDataFrame([("k1", '{"a": 1}'), ("k2", "plain \"text\"")], "key string, value string"), f"{tmp_path}/cache")
    cache = spark.read.parquet(f"{tmp_path}/cache")
    assert {r.key: json.loads(r.value) for r in cache.collect()} == {"k1": {"a": 1}, "k2": {"raw_text": 'plain "text"'}}
    assert {r.key for r in transcripts.cached(spark.createDataFrame([("k1",), ("k3",)], "key string"), cache).where("value IS NOT NULL").collect()} == {"k1"}
    transcripts.write_prepared(spark.createDataFrame([("S", "x\ny"), (None, "z")], "speaker string, text string"), f"{tmp_path}/prepared")
    assert sorted(r.text for r in spark.read.json(f"{tmp_path}/prepared").collect()) == ["S: x\ny", "z"]
    (tmp_path / "any").mkdir()
    (tmp_path / "any" / "a.json").write_text('[{"a": 1}, 2]')
    (tmp_path / "any" / "b.json").write_text("")
    assert sorted(r.doc for r in transcripts.read_any(spark, f"{tmp_path}/any").collect()) == ["2", '{"a":1}']
    (tmp_path / "any" / "c.json").write_text("{")
    with pytest.raises(Exception, match="not JSON"):
        transcripts.read_any(spark, f"{tmp_path}/any").collect()
    for folder, name, text in (("trees", "j1.json", "{}"), ("trees", "j2.json", "[1]"), ("maps", "j1_content_map.json", '{"R": "x"}')):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    assert {(r.job_id, r.tree, r.contents) for r in transcripts.read_trees(spark, f"{tmp_path}/trees", f"{tmp_path}/maps").collect()} == {("j1", "{}", '{"R": "x"}'), ("j2", "[1]", "{}")}


def test_trees_of_any_depth(spark):
    def node(k, deep):
        return {"node_id": f"n{k}", "title": f"t{k}", "start_segment": k, "end_segment": k + 1, "children": [node(k + 1, deep - 1), {"node_id": f"leaf{k}"}] if deep else []}

    trees = spark.createDataFrame([(1, json.dumps(node(0, 9))), (2, json.dumps({"node_id": "r"})), (3, "x"), (4, None)], "job_id int, tree string")
    got = {(r.job_id, r.node_id): (r.parent_id, r.level, r.title) for r in tree.flatten(trees).collect()}
    assert len(got) == 20 and got[1, "n9"] == ("n8", 9, "t9") and got[1, "leaf8"] == ("n8", 9, None) and got[2, "r"] == (None, 0, None)
    order = [r.node_id for r in tree.flatten(trees).where("job_id = 1").orderBy("place").collect()]
    assert order == [f"n{k}" for k in range(10)] + [f"leaf{k}" for k in range(8, -1, -1)]
    assert tree.flatten(trees.limit(0)).count() == 0
