"""Topic trees as node tables, and search in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import head_tail, hms, json_candidate
from parlance.operators.chunk import blocks
from parlance.operators.lineage import stored

#: A model behind a function of DataFrames.
Hook = Callable[[DataFrame], DataFrame]


def build(segments: DataFrame, size: int = 15) -> DataFrame:
    """Nodes (job_id, node_id, parent_id, level, topic, sub, title, start_segment, end_segment, speakers): root, blocks, speaker turns."""
    topics = blocks(segments, size)
    rows = segments.select("job_id", "idx", "speaker", F.floor(F.col("idx") / size).cast("bigint").alias("topic"))
    by = Window.partitionBy("job_id", "topic").orderBy("idx")
    rows = rows.withColumn("new", F.when(F.lag("speaker").over(by) == F.col("speaker"), 0).otherwise(1)).withColumn("sub", F.sum("new").over(by) - 1)
    subs = rows.groupBy("job_id", "topic", "sub").agg(F.first("speaker").alias("speaker"), F.min("idx").alias("start_segment"), F.max("idx").alias("end_segment"))
    node = lambda df, node_id, parent, level, topic, sub, title, speakers: df.select(
        "job_id", node_id.alias("node_id"), parent.alias("parent_id"), F.lit(level).cast("bigint").alias("level"), topic.cast("bigint").alias("topic"), sub.cast("bigint").alias("sub"), title.alias("title"), "start_segment", "end_segment", speakers.alias("speakers")
    )
    none, t = F.lit(None), F.concat(F.lit("T"), F.col("topic").cast("string"))
    who = segments.groupBy("job_id").agg(F.min("idx").alias("start_segment"), F.max("idx").alias("end_segment"), F.array_sort(F.collect_set(F.coalesce("speaker", F.lit("UNKNOWN")))).alias("who"))
    root = node(who, F.lit("ROOT"), none.cast("string"), 0, F.lit(-1), F.lit(-1), F.col("job_id").cast("string"), F.col("who"))
    level1 = node(topics, t, F.lit("ROOT"), 1, F.col("topic"), F.lit(-1), F.col("title"), F.array().cast("array<string>"))
    level2 = node(subs, F.concat(t, F.lit("-S"), F.col("sub").cast("string")), t, 2, F.col("topic"), F.col("sub"), F.concat(F.coalesce("speaker", F.lit("UNKNOWN")), F.lit(": discussion")), F.array(F.coalesce("speaker", F.lit("UNKNOWN"))))
    return root.unionByName(level1).unionByName(level2)


def covered(nodes: DataFrame) -> DataFrame:
    """(job_id, node_id, idx): the segments of each node, so that nodes and segments meet by job and index."""
    return nodes.select("job_id", "node_id", F.explode(F.sequence("start_segment", "end_segment")).alias("idx"))


def content_map(nodes: DataFrame, segments: DataFrame, root_first_only: bool = False) -> DataFrame:
    """(job_id, node_id, content): each node's lines. `root_first_only` gives the root its first segment alone, as it was once stored."""
    line = F.concat(F.coalesce("speaker", F.lit("UNKNOWN")), F.lit(" ["), hms(F.coalesce("start", F.lit(0))), F.lit("-"), hms(F.coalesce("end", F.lit(0))), F.lit("]: "), F.coalesce("text", F.lit("")))
    if root_first_only:
        nodes = nodes.withColumn("end_segment", F.when(F.col("node_id") == "ROOT", F.col("start_segment")).otherwise(F.col("end_segment")))
    rows = covered(nodes).join(segments.select("job_id", "idx", line.alias("line")), ["job_id", "idx"])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"])
    return rows.groupBy("job_id", "node_id").agg(F.array_join(lines, "\n").alias("content"))


def node_summaries(nodes: DataFrame, segments: DataFrame, most: int = 200) -> DataFrame:
    """(job_id, node_id, summary): what a node says without a model: the first characters of its lines, and dots.

    Only the segments whose own characters, or the line break before them, are among these are gathered."""
    line = F.concat(F.coalesce("speaker", F.lit("UNKNOWN")), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = covered(nodes.where("level > 0")).join(segments.select("job_id", "idx", line.alias("line")), ["job_id", "idx"])
    before = Window.partitionBy("job_id", "node_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))).where(F.col("before") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"])
    return rows.groupBy("job_id", "node_id").agg(F.concat(F.substring(F.array_join(lines, "\n"), 1, most), F.lit("...")).alias("summary"))


def with_summaries(nodes: DataFrame, segments: DataFrame, summarise: Hook | None = None) -> DataFrame:
    """`nodes` with summary: what `summarise` (rows job_id, node_id, content to job_id, node_id, summary) answers, else the fallback; the root's counts the topics."""
    out = nodes.join(node_summaries(nodes, segments).withColumnRenamed("summary", "own"), ["job_id", "node_id"], "left")
    if summarise:
        out = out.join(summarise(content_map(nodes, segments)).select("job_id", "node_id", F.nullif("summary", F.lit("")).alias("told")), ["job_id", "node_id"], "left")
    n = nodes.where("level = 1").groupBy("job_id").agg(F.count(F.lit(1)).alias("topics"))
    root = F.when(F.col("node_id") == "ROOT", F.format_string("Meeting with %d topics discussed.", F.coalesce("topics", F.lit(0))))
    said = F.coalesce(*([F.col("told")] if summarise else []), root, F.col("own"), F.lit(""))
    return out.join(n, "job_id", "left").withColumn("summary", said).select(*nodes.columns, "summary")


def topics(segments: DataFrame, propose: Hook, size: int = 15, attempts: int = 2, most: int = 50_000) -> DataFrame:
    """(job_id, topic, title, start_segment, end_segment) from a model's JSON, or blocks of `size` where it gives none in `attempts`.

    `propose` turns (job_id, prompt) into (job_id, answer). Long transcripts are cut to their ends; ranges are held inside the transcript."""
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.coalesce("speaker", F.lit("UNKNOWN")), F.lit(": "), F.coalesce("text", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"])
    prompts = segments.groupBy("job_id").agg(head_tail(F.array_join(lines, "\n"), most, "\n...\n").alias("prompt"))
    sizes, found = segments.groupBy("job_id").agg(F.max("idx").alias("last")), None
    for _ in range(attempts):
        left = prompts if found is None else prompts.join(found.select("job_id").distinct(), "job_id", "left_anti")
        said = F.from_json(json_candidate(F.col("answer")), "array<struct<topic_title:string,start_segment:bigint,end_segment:bigint>>")
        rows = propose(left).select("job_id", F.posexplode(said).alias("topic", "t")).where("t.start_segment IS NOT NULL AND t.end_segment IS NOT NULL").join(sizes, "job_id")
        start = F.least(F.greatest(F.col("t.start_segment"), F.lit(0)), F.col("last"))
        rows = rows.select("job_id", F.col("topic").cast("bigint").alias("topic"), F.coalesce("t.topic_title", F.lit("Untitled")).alias("title"), start.alias("start_segment"), F.least(F.greatest(F.col("t.end_segment"), start), F.col("last")).alias("end_segment"))
        found = rows if found is None else found.unionByName(rows)
    rest = blocks(segments, size).join(found.select("job_id").distinct(), "job_id", "left_anti")
    return found.unionByName(rest.select("job_id", "topic", "title", "start_segment", "end_segment"))


def fallback_summary(content: Column) -> Column:
    return F.concat(F.substring(content, 1, 200), F.lit("..."))


def outline(nodes: DataFrame) -> DataFrame:
    """(job_id, outline): nodes in depth-first order, two spaces a level, each with its summary if it has one."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level").cast("int")), F.lit("["), "node_id", F.lit("] "), "title")
    if "summary" in nodes.columns:
        line = F.concat(line, F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" -- "), "summary")).otherwise(F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("topic", "sub", line.alias("line")))), lambda x: x["line"])
    return nodes.groupBy("job_id").agg(F.array_join(lines, "\n").alias("outline"))


def flatten(trees: DataFrame) -> DataFrame:
    """(job_id, place, node_id, parent_id, level, title, start_segment, end_segment) of nested trees (job_id, tree as JSON) of any depth; places are in depth-first order.

    One round a level, until no node has children. A text that isn't a JSON object has no nodes."""
    get = lambda name, kind: F.try_variant_get("n", f"$.{name}", kind)
    level = trees.select("job_id", F.try_parse_json("tree").alias("n"), F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<int>").alias("place"))
    out, k = None, 0
    while True:
        level = stored(level.where(F.startswith(F.schema_of_variant("n"), F.lit("OBJECT"))))
        rows = level.select("job_id", "place", get("node_id", "string").alias("node_id"), "parent_id", F.lit(k).cast("bigint").alias("level"), get("title", "string").alias("title"), get("start_segment", "bigint").alias("start_segment"), get("end_segment", "bigint").alias("end_segment"))
        out = rows if out is None else out.unionByName(rows)
        below = level.select("job_id", get("node_id", "string").alias("parent_id"), "place", F.posexplode(get("children", "array<variant>")).alias("at", "n"))
        if below.isEmpty():
            return out
        level, k = below.withColumn("place", F.concat("place", F.array("at"))), k + 1


# --- search: choose nodes, read them, ask whether they suffice, and go on ---


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def overlap_select(nodes: DataFrame, most: int = 3) -> Hook:
    """A stand-in for a model that chooses nodes: those not chosen yet that share most words with the question."""

    def choose(queries: DataFrame) -> DataFrame:
        asked = queries.select("query_id", "job_id", "chosen", F.explode(words(F.col("question"))).alias("w"))
        named = nodes.select("job_id", "node_id", "topic", "sub", F.explode(words(F.col("content"))).alias("w"))
        score = asked.join(named, ["job_id", "w"]).where(~F.array_contains("chosen", F.col("node_id"))).groupBy("query_id", "node_id", "topic", "sub").agg(F.count(F.lit(1)).alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "topic", "sub")
        return score.withColumn("ord", F.row_number().over(by)).where(F.col("ord") <= most).select("query_id", "ord", "node_id")

    return choose


def iterative_search(queries: DataFrame, contents: DataFrame, select: Hook, check: Hook, rounds: int = 4) -> DataFrame:
    """(query_id, job_id, rank, node_id, text): nodes in the order in which they were chosen; those without content have an empty text.

    In each round `select` turns the open queries (query_id, job_id, question, chosen: array of node ids) into (query_id, ord, node_id);
    ids that repeat or were chosen before are dropped, and a query without a new one is done. `check` gets the same rows with
    the new nodes in `chosen` and text (what was read so far) and answers (query_id, sufficient, node_ids): a sufficient query is done, and of the others'
    further ids those with content (job_id, node_id, content) are added. Each round ends in a stored table; no rows are collected."""
    have = stored(contents.select("job_id", "node_id", "content"))
    open_ = queries.select("query_id", "job_id", "question", F.array().cast("array<string>").alias("chosen"))
    done = None
    for _ in range(rounds):
        picks = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"]))
        new = open_.join(select(open_).groupBy("query_id").agg(picks.alias("picks")), "query_id", "left")
        new = new.withColumn("picks", F.array_except(F.coalesce("picks", F.array().cast("array<string>")), "chosen"))
        new = stored(new)
        none = new.where(F.size("picks") == 0).select("query_id", "job_id", "chosen")
        new = new.where(F.size("picks") > 0).withColumn("chosen", F.concat("chosen", "picks")).drop("picks")
        read = new.select("query_id", "job_id", F.posexplode("chosen").alias("at", "node_id")).join(have, ["job_id", "node_id"])
        part = F.concat(F.lit("--- ["), "node_id", F.lit("] ---\n"), "content")
        texts = F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("part")))), lambda x: x["part"])
        texts = read.groupBy("query_id").agg(F.array_join(texts, "\n\n").alias("text"))
        told = check(new.join(texts, "query_id", "left")).select("query_id", "sufficient", "node_ids")
        asked = stored(new.join(told, "query_id", "left"))
        more = asked.where(~F.coalesce("sufficient", F.lit(True))).select("query_id", "job_id", F.posexplode("node_ids").alias("at", "node_id")).join(have.select("job_id", "node_id"), ["job_id", "node_id"], "left_semi")
        extra = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "node_id"))), lambda x: x["node_id"]))
        asked = asked.join(more.groupBy("query_id").agg(extra.alias("extra")), "query_id", "left")
        asked = stored(asked.withColumn("chosen", F.concat("chosen", F.array_except(F.coalesce("extra", F.array().cast("array<string>")), "chosen"))))
        ended = none.unionByName(asked.where(F.coalesce("sufficient", F.lit(True))).select("query_id", "job_id", "chosen"))
        done = ended if done is None else done.unionByName(ended)
        open_ = asked.where(~F.coalesce("sufficient", F.lit(True))).select("query_id", "job_id", "question", "chosen")
        if not open_.limit(1).count():
            break
    done = done.unionByName(open_.select("query_id", "job_id", "chosen"))
    rows = done.select("query_id", "job_id", F.posexplode("chosen").alias("at", "node_id"))
    return rows.join(have, ["job_id", "node_id"], "left").select("query_id", "job_id", (F.col("at") + 1).cast("bigint").alias("rank"), "node_id", F.coalesce("content", F.lit("")).alias("text"))


def source_rows(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes found (query_id, job_id, rank, node_id, text) as sources of an answer; unknown nodes are called by their id."""
    known = nodes.select("job_id", "node_id", "title", "speakers", "start_segment", "end_segment")
    rows = found.join(known, ["job_id", "node_id"], "left")
    return rows.select(
        "query_id", "rank", "text", "node_id", F.coalesce("title", "node_id").alias("node_title"), F.coalesce(F.get("speakers", F.lit(0)), F.lit("")).alias("speaker"),
        F.col("start_segment").alias("start"), F.col("end_segment").alias("end"), F.lit(0.0).alias("distance"), F.lit(100).cast("bigint").alias("relevance"),
    )
