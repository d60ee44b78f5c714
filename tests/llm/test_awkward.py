"""Nulls, repeats, ties, empty tables, clashing names and long texts: every operator and stage against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from parlance.llm import bpe, html_extract, records
from parlance.llm.components import components
from parlance.llm.exact_dedup import directory, drop_copies, exact_dedup, with_bucket
from parlance.llm.html_extract import Weights, blocks, labels, main_text
from parlance.llm.mixing import mix_copies, mix_sources
from parlance.llm.sharding import balanced_shards, cut_links
from parlance.llm.simhash import near_duplicates
from parlance.llm.topk import top_k
from parlance.llm.toxicity import drop_toxic, toxicity
from parlance.llm.url_filter import bloom, judge, place

LOW = lambda t: (t or "").encode().lower()
CLASHES = ("id", "key", "norm", "bucket", "size", "shard", "h", "fp", "ids", "n_tokens", "score", "n", "sha", "keep_id", "words", "copies", "row", "rate", "block", "decoded")
LONG = "Word " * 60_000 + "x" * 50_000


def awkward(spark, n=300, seed=1):
    """Documents with null and repeated ids, null, empty, long and repeated texts, and columns that operators might use."""
    random.seed(seed)
    texts = [None, "", " ", "Same", "same", "SAME", "é É", "É é", LONG, "one two", "one two three four five six"] + [" ".join(random.choice("ab") for _ in range(random.randint(1, 9))) for _ in range(40)]
    rows = [(random.choice([None, *range(60)]), random.choice(texts), random.choice([None, "s1", "s2", "s3", ""])) for _ in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.select("*", F.lit("en").alias("lang"), *[F.lit("clash").alias(c) for c in CLASHES]), rows


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(5)), lambda c: F.lit(1).cast("bigint")])
def test_exact_dedup(spark, key):
    df, rows = awkward(spark)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[LOW(t)].append(i)
    keep = {t: max([i for i in g if i is not None], default=None) for t, g in groups.items()}
    got = exact_dedup(df, bucket_capacity=2, key_of=key).collect()
    want = Counter((i, keep[LOW(t)], len(groups[LOW(t)]), i == keep[LOW(t)], hashlib.sha256(LOW(t)).hexdigest()) for i, t, _ in rows)
    assert Counter(map(tuple, got)) == want
    kept = drop_copies(df, bucket_capacity=2, key_of=key)
    assert kept.columns == df.columns
    kept = kept.collect()
    assert Counter(LOW(r.text) for r in kept) == Counter(groups.keys()) and all(r.doc_id == keep[LOW(r.text)] for r in kept)


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key")).unionByName(spark.range(900).select(F.col("id").alias("key")))  # 900 keys share 54 bits
    buckets, depths = directory(keys, 300)
    sizes = {r.bucket: (r.local_depth, r["count"]) for r in with_bucket(keys, buckets, depths).groupBy("bucket", "local_depth").count().collect()}
    assert sum(n for _, n in sizes.values()) == 5900 and max(n for _, n in sizes.values()) <= 300 and max(depths) == 56
    assert all(len(b) == d + 1 for b, (d, _) in sizes.items())


def test_mixing_is_exact_with_repeats(spark):
    df, rows = awkward(spark, 400)
    words = Counter()
    for _, t, s in rows:
        words[s] += len((t or "").split())
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert sorted(target) == sorted(words.values()) and all(t <= 3 * n + 1e-6 for n, t in target.items()) and abs(sum(target.values()) - sum(words.values())) < 1e-6
    assert all(abs(taken[n] - target[n]) < 60_001 for n in target)  # within the longest document
    # Repeated rows share id, text and source with others; the copies are told apart all the same.
    many = spark.createDataFrame([(k % 7, f"w{k % 5} " * (k % 9 + 1), f"s{k % 2}") for k in range(2000)], "doc_id bigint, text string, source string")
    found = mix_sources(many).groupBy("target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.target) <= r.m for r in found)
    copies = mix_copies(many)
    assert copies.columns == many.columns and copies.count() == mix_sources(many).agg(F.sum("copies")).first()[0]
    assert sum(len(r.text.split()) for r in copies.collect()) == sum(r.t for r in found)


def test_inclusion_follows_the_rates(spark):
    docs = spark.createDataFrame([(k, "w " * (1 << k % 6), f"s{k % 3}") for k in range(9000)], "doc_id bigint, text string, source string")
    rows = mix_sources(docs).groupBy("source_size", "size").agg(F.avg("copies").alias("got"), F.avg("rate").alias("want"), F.count(F.lit(1)).alias("n")).collect()
    assert len({round(r.want, 6) for r in rows}) > 5 and all(abs(r.got - r.want) < 4 * (0.25 / r.n) ** 0.5 + 0.02 for r in rows)
    total = mix_sources(docs).groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= 32 for r in total)


def test_sharding_facts(spark):
    df, rows = awkward(spark)
    docs = df.unionByName(df.where("text = 'Same'").select(*df.columns))
    texts = [t for _, t, _ in rows] + [t for _, t, _ in rows if t == "Same"]
    got = balanced_shards(docs).collect()
    assert Counter((r["size"], r.text_crc32) for r in got) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in range(16))


def test_sharding_cuts_fewer_links_than_hashing(spark):
    docs = spark.createDataFrame([(k, f"text {k // 3}" if k % 2 else f"alone {k}") for k in range(3000)], "doc_id bigint, text string")
    hashed = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("shard"))
    moved, plain = cut_links(balanced_shards(docs), docs).first().cut, cut_links(hashed, docs).first().cut
    assert moved < plain / 4


def test_simhash_fingerprints_by_hand(spark):
    import xxhash

    df, rows = awkward(spark, 60)

    def print_of(t):
        w = LOW(t).split()
        if not w:
            return 0
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [print_of(t) for _, t, _ in rows]
    root = {f: f for f in fps}
    find = lambda f: f if root[f] == f else find(root[f])
    for a in set(fps):
        for b in set(fps):
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for (i, _, _), f in zip(rows, fps):
        if i is not None and (least[find(f)] is None or i < least[find(f)]):
            least[find(f)] = i
    got = Counter(map(tuple, near_duplicates(df).collect()))
    assert got == Counter((i, f"{f:016x}", least[find(f)]) for (i, _, _), f in zip(rows, fps))


def test_components_of_a_path(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(200)}


def test_bpe_by_row(spark):
    df, rows = awkward(spark, 60)
    path = P.path("byte_bpe_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.encode(df, path, P.PATTERN, round_trip=True)
    assert {"doc_id", "id", "key", "source"} < set(out.columns) and len(set(out.columns)) == len(out.columns)
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out.collect())
    ids = lambda t: want.encode_ordinary(t or "")
    assert got == Counter((i, len(ids(t)), np.array(ids(t), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    with pytest.raises(ValueError):
        bpe.decoded([np.array([10**6], "<u4").tobytes()], path)


def test_records_with_repeats(spark):
    from tokenizers import Tokenizer

    df, rows = awkward(spark, 80)
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    manifest = records.write_records(df, records.library_encoder(P.path("byte_bpe_50k.json")), 2, 2)
    got = records.read_records(manifest).collect()
    want = sorted(((i is not None, i or 0, (t or "").encode()) for i, t, _ in rows))
    got = sorted(got, key=lambda r: r.start)
    start = 0
    for r, (known, i, raw) in zip(got, want, strict=True):
        ids = [*plain.encode(raw.decode(), add_special_tokens=False).ids, 2]
        assert (r.id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (i if known else None, start, ids)
        start += len(ids)


S = "vec_id bigint, embedding array<double>"


@pytest.mark.parametrize("case", ["lengths", "repeats", "few", "clusters", "big", "none"])
def test_top_k(spark, case):
    rng = np.random.default_rng(5)
    base = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))]
    rows = {
        "lengths": base[:110] + [(50, [1.0, 2.0, 3.0]), (50, []), (77, [9.0] * 12), (51, [])],
        "repeats": base + base[:60] + [(0, [1.0] * 8), (100, [1.0] * 8)],
        "few": base[:3],
        "clusters": [(i, ((i % 7) * 50 + rng.normal(size=8)).tolist()) for i in range(400)],
        "big": [(i, (v * 1e6).tolist()) for i, v in enumerate(rng.normal(size=(150, 6)))],
        "none": [],
    }[case]
    width = max((len(v) for _, v in rows), default=0)
    whole = [(i, [int(np.floor(x * 256)) for x in v] + [0] * (width - len(v))) for i, v in rows]
    want, seen = [], set()
    for q, v in whole:
        if q % 50 or (q, tuple(v)) in seen:
            continue
        seen.add((q, tuple(v)))
        best = {}
        for i, w in whole:
            if i != q:
                x = sum(a * b for a, b in zip(v, w))
                best[i] = max(best.get(i, x), x)
        want += [(q, n + 1, i, x) for n, (i, x) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5])]
    df = spark.createDataFrame([*rows, (1000, None), (1002, [None] * 8), (None, [1.0] * 8), (1003, [float("inf")])], S)
    got = top_k(df.withColumn("id", F.lit("x")).withColumn("block", F.lit(2)), F.col("vec_id") % 50 == 0, rows_per_block=40).collect()
    assert sorted(map(tuple, got)) == sorted(want)


LINE = "This is the first paragraph of a report that runs over many words and ends, as one would expect, in a full stop."


def test_html_cut_overrules_the_classifier():
    links = "<ul><li><a href=a>One link</a></li><li><a href=b>Two links</a></li></ul>"
    advert = "Buy our new shiny product now because it is the best product of this year and of all years."
    pages = {
        f"<body><div><p>{LINE}</p><p>Yes.</p><p>{LINE}</p></div>": f"{LINE}\nYes.\n{LINE}",
        f"<body><div><p>{LINE}</p><p>{LINE}</p></div><div>{links}<div>{advert}</div>{links}</div>": f"{LINE}\n{LINE}",
        f"<body><div><h2>Part 2</h2><p>{LINE}</p><p>No</p><p>{LINE}</p></div><nav>{links}</nav>": f"Part 2\n{LINE}\nNo\n{LINE}",
    }
    changed = 0
    for page, want in pages.items():
        found = blocks(page, Weights())
        changed += sum((score > 0) != kept for (_, score, _, _), kept in zip(found, labels(found)))
        assert main_text(page) == want
        assert "\n".join(t for t, score, _, _ in found if score > 0) != want
    assert changed >= 3
    assert main_text(f"<body><nav>{links}</nav><p>{LINE}</p><footer>us</footer>") == LINE


def test_html_labels_are_a_minimum_cut_of_pages():
    random.seed(8)
    parts = [f"<p>{LINE}</p>", "<p>Yes.</p>", "<ul><li><a href=x>Link</a></ul>", "<div><p>Some words of text here, and more</p></div>", "<div class=ad>Buy now.</div>", "<h2>Title</h2>"]
    for _ in range(40):
        found = blocks("<body>" + "".join(random.choice(parts) for _ in range(random.randint(1, 9))), Weights())
        w, last, edges = Weights(), {}, []
        for k, (_, _, parent, steps) in enumerate(found):
            if k:
                edges.append((k - 1, k, int(w.scale * w.near / (1 + steps))))
            if last.get(parent, k - 1) < k - 1:
                edges.append((last[parent], k, int(w.scale * w.siblings)))
            last[parent] = k
        score = [int(w.scale * s) for _, s, _, _ in found]
        cost = lambda s: sum(max(0, c) if not k else max(0, -c) for c, k in zip(score, s)) + sum(c for a, b, c in edges if s[a] != s[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(len(found))]) for m in range(1 << len(found)))
        kept = labels(found)
        assert cost(kept) == best or kept == [s > 0 for s in score]


def test_html_rows(spark):
    page = f"<body><article><p>{LINE}</p></article>"
    long = "<body><article>" + f"<p>{LINE}</p>" * 3000 + "</article>"
    rows = [(1, "u", page), (1, None, page), (None, None, None), (3, "v", ""), (4, "w", long), (5, "x", "<" * 20_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = Counter(map(tuple, html_extract.extract(df).collect()))
    text = lambda h: main_text(h)
    assert got == Counter((i, u, text(h), len(text(h))) for i, u, h in rows)
    assert len(text(long).split("\n")) == 3000 and html_extract.extract(df.limit(0)).count() == 0


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, tail = rest.partition("/")
    path, host = slash + tail, "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(r, len(e), e, v) for e, v, r in rules if (host == e.split("/")[0] or host.endswith("." + e.split("/")[0])) and path.startswith(e[e.index("/") :])]
    best = max(fits, default=(False, 0, None, "allow"))
    return host, path, best[2] if best[0] else None, best[3]


def test_urls_by_brute_force(spark):
    random.seed(3)
    hosts = ["a.org", "A.Example.org", "b.com", "x.b.com", "xcom", "org", "", "é.org", "b.com:80"]
    paths = ["", "/", "/de/", "/de/\u2028z", "/x\ny", "/es/1\r\n", "/en/1", "/en/12", "/DE/", "//de/"]
    ends = ["", "?q=/de/", "#f", "?a#b"]
    urls = [None, "", "no scheme", "://", *(f"{random.choice(['http', 'https', 'x'])}://{random.choice(hosts)}{random.choice(paths)}{random.choice(ends)}" for _ in range(400))]
    rules = [("org/", "allow", True), ("example.org/es/", "block", True), ("com/de/", "block", True), ("example.org/en/1", "block", True), ("com/fr/", "allow", True), ("xcom/", "block", False), ("b.com/", "block", False)]
    pages = spark.createDataFrame([(k % 300, u) for k, u in enumerate(urls)], "page_id bigint, url string").withColumn("host", F.lit("x")).withColumn("entry", F.lit("x"))
    got = judge(pages, spark.createDataFrame(rules, "entry string, verdict string, rule boolean"))
    assert Counter(map(tuple, got.collect())) == Counter((k % 300, *judged(u, rules)) for k, u in enumerate(urls))
    assert judge(pages.limit(0), spark.createDataFrame(rules, "entry string, verdict string, rule boolean")).count() == 0


def test_urls_false_positives_are_removed(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".net/")).alias("entry"), F.lit("block").alias("verdict"), F.lit(False).alias("rule"))
    asked = spark.range(20_000, 220_000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".net/")).alias("entry"))
    table = bloom(listed)
    block, bits = place(asked.select(F.xxhash64("entry").alias("h")).toPandas()["h"].to_numpy(np.int64), len(table))
    assert 0 < int(((table[block] & bits) == bits).all(axis=1).sum()) < 2000
    pages = spark.range(19_000, 220_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".net/x")).alias("url"))
    assert judge(pages, listed).where("verdict = 'block'").count() == 1000


def test_toxicity_rows(spark):
    df, rows = awkward(spark, 80)
    labels_ = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1)], "doc_id bigint, toxic int").withColumn("score", F.lit("clash"))
    got = toxicity(df, labels_).collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    left = drop_toxic(df, labels_)
    assert left.columns == df.columns and left.count() == sum(not r.predicted for r in got)
    assert drop_toxic(df, labels_.limit(0)).count() == len(rows)


EMPTY = "doc_id bigint, text string, source string, lang string, n_chars bigint"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], EMPTY)
    labels_ = spark.createDataFrame([], "doc_id bigint, toxic int")
    path = P.path("byte_bpe_50k.json")
    assert toxicity(docs, labels_).count() == drop_toxic(docs, labels_).count() == mix_copies(docs).count() == drop_copies(docs).count() == 0
    assert exact_dedup(docs).count() == mix_sources(docs).count() == balanced_shards(docs).count() == near_duplicates(docs).count() == 0
    assert records.read_records(records.write_records(docs, records.library_encoder(path), 2, 2)).count() == 0
    assert bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, round_trip=True).count() == 0


def test_pipeline_is_its_stages(spark, tmp_path):
    df, _ = awkward(spark, 200)
    docs = df.select("doc_id", "text", "source", "lang").withColumn("n_chars", F.length("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(60)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert name == "byte_bpe" or out.columns == docs.columns
        before, rows = now, out.collect()
        assert len(rows) and (name == "source_mix" or len(rows) <= before.count())
        now = spark.createDataFrame(rows, out.schema)
    assert Counter(map(str, got)) == Counter(map(str, now.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "byte_bpe"]
    empty = spark.createDataFrame([], docs.schema)
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)
