"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The listed rules of the URL query (entry, verdict), and hosts whose pages are listed as blocked.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BLOCKED_HOSTS = tuple(f"{name}.example.{top}/" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parlance.llm.bpe import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, round_trip=True, carry=["doc_id"])
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parlance.llm.records import library_encoder, read_records, write_records

    manifest = write_records(table(spark, sf_dir, "documents"), library_encoder(public_tokenizers.path("byte_bpe_50k.json")), width=2, end_id=2)
    return read_records(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.sharding import balanced_shards

    return balanced_shards(table(spark, sf_dir, "documents")).drop("linked")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.url_filter import judge

    listed = [(e, v, True) for e, v in RULES] + [(e, "block", False) for e in BLOCKED_HOSTS]
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(listed, "entry string, verdict string, rule boolean"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every tenth document (by the checksum of its id) has its words from a place on repeat with a period that fits three times or more.
PERIODIC = """
CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 10) = 0 AND size(words) > 0
  THEN array_join(transform(words, (w, i) -> CASE WHEN i < a THEN w ELSE words[cast(a + (i - a) % (1 + (size(words) - a) div (3 + g % 8)) AS int)] END), ' ') ELSE text END"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.runs import find_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10").alias("g"))
    docs = docs.withColumn("words", F.expr(r"CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 10) = 0 THEN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) END"))
    docs = docs.withColumn("a", F.expr("CASE WHEN size(words) > 0 THEN g % size(words) END"))
    found = find_runs(docs.select("doc_id", F.expr(PERIODIC).alias("text")), carry=["doc_id"])
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli")
    digests = [F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *best, milli, *digests)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.whitening import fit, identity_error, whiten

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    basis = fit(vectors)
    error = identity_error(vectors, basis)
    explained = F.array(*[F.lit(float(e)) for e in basis.explained]).cast("array<double>")
    rows = whiten(vectors, basis, carry=["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    last = [F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error")]
    return rows.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(basis.n).cast("bigint").alias("n"), "deviation", "whitened", *last)


#: What a log would have of a row: answers are drafted, followed up and regenerated in two deltas, questions are drafted and edited, other texts come in two deltas.
LOGGED = """
CASE role WHEN 'assistant' THEN array(
    named_struct('part', 0, 'step', 0, 'kind', 'open', 'role', role, 'text', ''), named_struct('part', 0, 'step', 1, 'kind', 'delta', 'role', '', 'text', left(text, 9)),
    named_struct('part', 1, 'step', 2, 'kind', 'open', 'role', 'user', 'text', 'Again'), named_struct('part', 0, 'step', 3, 'kind', 'regenerate', 'role', '', 'text', ''),
    named_struct('part', 0, 'step', 4, 'kind', 'delta', 'role', '', 'text', substring(text, 1, half)), named_struct('part', 0, 'step', 5, 'kind', 'delta', 'role', '', 'text', substring(text, half + 1)))
  WHEN 'user' THEN array(
    named_struct('part', 0, 'step', 0, 'kind', 'open', 'role', role, 'text', left(text, 9)), named_struct('part', 0, 'step', 1, 'kind', 'edit', 'role', '', 'text', text))
  ELSE array(
    named_struct('part', 0, 'step', 0, 'kind', 'open', 'role', role, 'text', substring(text, 1, half)), named_struct('part', 0, 'step', 1, 'kind', 'delta', 'role', '', 'text', substring(text, half + 1))) END"""


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.chat import loss_texts, reconstruct, render, turns

    said = "</s>[INST] ok [/INST]"
    fixed = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))).withColumn("half", F.expr("length(text) div 2").cast("int"))
    events = rows.select("conv_id", "turn", "copy", F.explode(F.expr(LOGGED)).alias("e")).select("conv_id", "turn", "copy", "e.*")
    message = ["turn", "copy", "part"]
    chats = render(reconstruct(events, message=message, sequence=["turn", "copy", "step"]), message=message)
    read = chats.select("conv_id", "formatted", turns(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted").cast("binary"), F.col("loss_spans")).alias("loss"))
    lines, loss = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), F.array_join("loss", "")
    sizes = {"n_turns": F.size("turns"), "loss_chars": F.length(loss), "formatted_chars": F.length("formatted")}
    return read.select("conv_id", *[c.cast("bigint").alias(name) for name, c in sizes.items()], F.sha2(lines, 256).alias("turns_sha256"), F.sha2(loss, 256).alias("loss_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_html_extraction, op2_exact_dedup, op3_source_mixing, op4_byte_bpe, op5_exact_top_k, op6_token_records, op7_sharding, op8_toxicity, op9_url_filter, op10_simhash, op11_periodic_runs, op12_whitening, op13_chat_format, pipeline)
    return {f.__name__: f for f in ops}


NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {NORM} AS norm FROM documents) WINDOW w AS (PARTITION BY norm)
"""


OP3_BEGIN = """
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS words FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight FROM a),
r AS (SELECT *, (3 * words)::DOUBLE / weight AS ratio FROM w),
o AS (SELECT *, sum(words) OVER () - coalesce(sum(3 * words) OVER b, 0) AS free_words, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS free_weight
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT free_words::DOUBLE / free_weight AS level FROM o WHERE free_words::DOUBLE / free_weight <= ratio ORDER BY ratio LIMIT 1),
t AS (SELECT source, words, least((3 * words)::DOUBLE, coalesce((SELECT level FROM l) * weight, (3 * words)::DOUBLE)) AS target FROM r),
z AS (SELECT *, 8 + length(bin(size)) - 1 AS heft FROM s),
c AS (SELECT z.source, heft, target, sum(size)::BIGINT AS words FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY z.source, heft, target),
k AS (SELECT source, heft, (target - (3 * coalesce(sum(words) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE) / (sum(heft * words) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS scale
  FROM c WINDOW v AS (PARTITION BY source ORDER BY heft DESC)),
x AS (SELECT source, max_by(scale, heft) AS scale FROM k WHERE scale * heft <= 3 GROUP BY source),
d AS (SELECT z.*, words, target, CASE WHEN size > 0 THEN coalesce(least(3.0::DOUBLE, scale * heft), 3.0::DOUBLE) ELSE 0 END AS rate,
    (('0x' || substr(md5('mix' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON z.source IS NOT DISTINCT FROM x.source),
e AS (SELECT *, least(floor(rate + 1e-9), 3)::BIGINT AS whole, greatest(rate - least(floor(rate + 1e-9), 3), 0.0::DOUBLE) AS p FROM d),
f AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank_key, target - sum(whole * size) OVER (PARTITION BY source) AS left_words FROM e),
p0 AS (SELECT *, CASE WHEN sum(size) OVER (PARTITION BY source ORDER BY rank_key, doc_id ROWS UNBOUNDED PRECEDING) <= left_words THEN 1 ELSE 0 END AS more
  FROM f WHERE rank_key IS NOT NULL AND left_words > 0)"""

OP3_ROUND = """,
g{k} AS (SELECT source, any_value(left_words) - sum(more * size) AS gap FROM p{k} GROUP BY source),
b{k} AS (SELECT doc_id AS b_id FROM p{k} p JOIN g{k} g ON p.source IS NOT DISTINCT FROM g.source
  WHERE more = 0 AND abs(gap - size) < abs(gap) AND ({last} OR size <= gap)
  QUALIFY row_number() OVER (PARTITION BY p.source ORDER BY abs(gap - size), u, doc_id) = 1),
p{n} AS (SELECT * REPLACE (CASE WHEN doc_id IN (SELECT b_id FROM b{k}) THEN 1 ELSE more END AS more) FROM p{k})"""

OP3_END = """
SELECT f.doc_id, f.size, f.words AS source_size, f.target, (CASE WHEN f.size > 0 THEN f.whole + coalesce(p4.more, 0) ELSE 0 END * f.size)::BIGINT AS taken
FROM f LEFT JOIN p4 ON f.doc_id = p4.doc_id
"""

OP3 = OP3_BEGIN + "".join(OP3_ROUND.format(k=k, n=k + 1, last="true" if k == 3 else "false") for k in range(4)) + OP3_END


OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


OP11 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'), []) AS w, doc_id::VARCHAR AS t FROM documents),
h AS (SELECT *, len(w) AS n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(t) + 1), lambda i: ascii(t[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) AS h FROM d),
a AS (SELECT *, (h // 10) % n AS a, (h // 10) % 8 AS g8, h % 10 = 0 AND n > 0 AS made FROM h),
o AS (SELECT rid, doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g8)) + 1] END) ELSE w END AS w FROM a),
x AS (SELECT rid, n, unnest(range(n)) AS i, unnest(w) AS word FROM o),
p AS (SELECT l.rid, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.rid = r.rid AND l.word = r.word AND r.i > l.i AND (r.i - l.i) * 3 <= l.n),
s AS (SELECT rid, q, min(i) AS s, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM p) GROUP BY rid, q, island),
r AS (SELECT rid, s, length, min(q) AS q FROM s WHERE length >= greatest(24, 3 * q) GROUP BY rid, s, length),
b AS (SELECT rid, s, length, q FROM r a QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / q DESC, s, q) = 1),
l AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY rid),
g AS (SELECT DISTINCT rid, unnest(range(s + q, s + length)) AS i FROM r),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN g USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM o LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN k USING (rid)
"""


OP13 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(regexp_replace(text, '(<s>|</s>|\\[/?INST\\]|\\[SYS\\]|\\[/?ROLE\\])', '\\\\\\1', 'g')) + 9 + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 WHEN 'system' THEN 5
  ELSE 15 + length(regexp_replace(role, '(<s>|</s>|\\[/?INST\\]|\\[SYS\\]|\\[/?ROLE\\])', '\\\\\\1', 'g')) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM f GROUP BY conv_id
"""


def op9_sql() -> str:
    fits = lambda e: f"(host = '{(h := e.split('/')[0])}' OR ends_with(host, '.{h}')) AND starts_with(path, '{e[e.index('/'):]}')"
    rules = sorted(RULES, key=lambda r: -len(r[0]))
    which = " ".join(f"WHEN {fits(e)} THEN '{e}'" for e, _ in rules)
    verdict = " ".join(f"WHEN {fits(e)} THEN '{v}'" for e, v in rules) + " " + " ".join(f"WHEN {fits(e)} THEN 'block'" for e in BLOCKED_HOSTS)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM r)
SELECT page_id, host, path, CASE {which} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op3_source_mixing": OP3, "op5_exact_top_k": OP5, "op9_url_filter": op9_sql(), "op11_periodic_runs": OP11, "op13_chat_format": OP13}
