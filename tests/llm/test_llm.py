"""The training-data operators against brute force, on small awkward tables."""

import hashlib
import html
import random
import struct

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from parlance.llm import bpe, records
from parlance.llm.exact_dedup import drop_copies, exact_dedup
from parlance.llm.html_extract import extract, main_text, source_side
from parlance.llm.mixing import mix_sources
from parlance.llm.sharding import balanced_shards
from parlance.llm.simhash import fingerprint, near_duplicates, near_links
from parlance.llm.topk import top_k
from parlance.llm.toxicity import toxicity
from parlance.llm.url_filter import judge

TEXTS = [None, "", "A b c", "a B c", "é É", "é é", "x " * 5000, "one", "one two", "Same TEXT here", "same text here", "same text here"]
DOCS = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "en", "s0", "clash")]
SCHEMA = "doc_id bigint, text string, lang string, source string, keep_id string"
low = lambda t: (t or "").encode().lower()


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_dedup(spark):
    got = {r.doc_id: r for r in exact_dedup(docs(spark), bucket_capacity=2).collect()}
    for i, t, *_ in DOCS:
        same = [j for j, u, *_ in DOCS if low(u) == low(t) and j is not None]
        r = got[i]
        assert r.text_sha256 == hashlib.sha256(low(t)).hexdigest()
        if i is not None:
            assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), i == max(same))
    assert drop_copies(docs(spark)).count() == len({low(t) for _, t, *_ in DOCS})
    assert exact_dedup(docs(spark, [])).count() == 0


def test_mix(spark):
    got = mix_sources(docs(spark)).collect()
    again = mix_sources(docs(spark)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(DOCS)
    assert all(r.size == len(low(TEXTS[r.doc_id]).split()) for r in got if r.doc_id is not None)
    assert all(r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0) for r in got)
    assert mix_sources(docs(spark, [])).count() == 0


def test_sharding(spark):
    many = DOCS + [(100 + i, "hot" if i % 3 else f"t{i}", "en", "s", "c") for i in range(300)]
    got = balanced_shards(docs(spark, many)).collect()
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(16)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert len(got) == len(many) and balanced_shards(docs(spark, [])).count() == 0


def components(ids, fps):
    root = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    return {i: ids[r] for i, r in zip(ids, root)}


def test_simhash(spark):
    random.seed(1)
    words = [f"w{i}" for i in range(40)]
    base = [random.choice(words) for _ in range(300)]
    rows = [(i, t, "en", "s", "c") for i, (_, t, *_) in enumerate(DOCS[:-1])]
    for i in range(30):
        some = list(base)
        some[random.randrange(300)] = "new"
        rows.append((100 + i, " ".join(some), "en", "s", "c"))
    want = components([r[0] for r in rows], [fingerprint(r[1], 3, 42) for r in rows])
    for limit in (128, 2):  # both ways of finding links
        got = near_duplicates(docs(spark, rows), group_limit=limit).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(int(r.fingerprint, 16) == fingerprint(dict((x[0], x[1]) for x in rows)[r.doc_id], 3, 42) for r in got)
    assert near_duplicates(docs(spark, [])).count() == 0


def test_near_links_by_lookup_and_by_comparison():
    values = np.unique(np.random.default_rng(3).integers(0, 1 << 12, 900).astype(np.uint64))
    mask = ((1 << 64) - 1) ^ ((1 << 12) - 1)
    a, b = near_links(values, mask, 3)
    assert (a > b).all() and len(np.setdiff1d(values, np.append(a, values[0]))) == 0  # one component


def test_bpe():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "\x1c", "é", "中", "12", "!!", "\t", "😀", " \n", "<|endoftext|>", "word,", " The"]
    texts = [None, "", "ab" * 20000, *("".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(3000))]
    got = bpe.Encoder(ranks, P.PATTERN).encode(texts)
    assert all(np.frombuffer(g, "<u4").tolist() == want.encode_ordinary(t or "") for t, g in zip(texts, got))
    shuffled = {k: (v * 7919) % 256 if len(k) == 1 else 256 + (v * 7919) % 5003 for k, v in list(ranks.items())[:600]}
    odd = bpe.Encoder({k: n for n, k in enumerate(sorted(shuffled, key=lambda k: (len(k) > 1, shuffled[k])))}, P.PATTERN)
    words = [w.encode() for w in ("therein", "another", "thethethe", "in on at")]
    assert odd.merge(words) == [odd.merge_one(w) for w in words]


def test_bpe_round_trip(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(docs(spark), path, P.PATTERN), path).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, *_ in DOCS)
    assert bpe.encode(docs(spark, []), path, P.PATTERN).count() == 0


def test_records(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    manifest = records.write_records(docs(spark), records.library_encoder(P.path("byte_bpe_50k.json")), 2, 2)
    got = sorted(records.read_records(manifest).collect(), key=lambda r: (r.id is not None, r.id))
    start = 0
    for r in got:
        text = "no id" if r.id is None else TEXTS[r.id] or ""
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
    f = manifest.first()
    assert records.read_at(f.path, f.folder, 0)[1]
    broken = bytearray(records.frame(b"payload"))
    broken[14] ^= 1
    try:
        records.unframe(bytes(broken))
        raise AssertionError("a broken record was read")
    except ValueError:
        pass
    assert struct.unpack("<Q", records.frame(b"payload")[:8])[0] == 7


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))] + [(300 + i, [0.5] * 8) for i in range(200)]
    bad = [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors + bad, "vec_id bigint, embedding array<double>")
    got = top_k(df, F.col("vec_id") % 50 == 0, rows_per_block=40).collect()
    whole = np.floor(np.array([v for _, v in vectors]) * 256)
    want = set()
    for q in range(0, 500, 50):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(500), -scores)) if i != q][:5]
        want |= {(q, n + 1, int(i), int(scores[i])) for n, i in enumerate(order)}
    assert {tuple(r) for r in got} == want


def test_html(spark):
    page = (
        "<html><body><header><a href=/>Home</a></header><div class=sidebar><p>Popular posts that are long enough to be a sentence.</p></div>"
        "<div id='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1><p>First  part,<br>second part.<p><b>Next.</article>"
        "<div id=comments><p>I like this article very much, thanks a lot!</p></div><script>var x = '</p>';</script><footer>&copy; me</footer>"
    )
    assert main_text(page) == "A & B\nFirst part, second part.\nNext."
    pages = spark.createDataFrame([(1, "u", page), (None, None, None), (3, "v", " ")], "page_id bigint, url string, html string")
    assert sorted((r.n_chars, r.text) for r in extract(pages).collect())[:2] == [(0, ""), (0, "")]
    assert html.unescape("&amp") == "&"


def test_cut_is_minimal():
    random.seed(4)
    for _ in range(60):
        n = random.randint(1, 7)
        cap = [random.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, random.randint(0, 6)) for a in range(n) for b in range(a + 1, n) if random.random() < 0.6]
        cost = lambda s: sum(max(0, c) if not k else max(0, -c) for c, k in zip(cap, s)) + sum(w for a, b, w in edges if s[a] != s[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(source_side(cap, edges)) == best


def test_toxicity(spark):
    random.seed(6)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        rows.append((i, " ".join(random.choice(words) for _ in range(30)) + (" idiot scum" if toxic else ""), "en", "s", "c"))
        labels.append((i, int(toxic)))
    got = toxicity(docs(spark, rows + [(700, None, "en", "s", "c")]), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(got) == 601 and sum(r.predicted == (r.doc_id % 3 == 0) for r in held) > 0.95 * len(held)


def test_urls(spark):
    pages = [(1, "http://A.Example.org/es/1"), (2, "https://x.org"), (3, "http://b.com/de/x?y#z"), (4, None), (5, "no scheme"), (6, "http://xcom/fr/"), (7, "http://example.org/en/12")]
    listed = [("org/", "allow", True), ("example.org/es/", "block", True), ("com/de/", "block", True), ("example.org/en/1", "block", True), ("xcom/", "block", False)]
    got = judge(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(listed, "entry string, verdict string, rule boolean"))
    want = {1: ("example.org/es/", "block"), 2: (None, "allow"), 3: ("com/de/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "block"), 7: ("example.org/en/1", "block")}
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want


def test_pieces_of_texts():
    random.seed(9)
    parts = ["a", "bc", "The", "é", "中", "12", "!!", " ", " ", " ", "\n", "\t", "  ", ",", "."]
    texts = [None, "", " ", "\n", "a", *("".join(random.choice(parts) for _ in range(random.randint(1, 60))) for _ in range(2000))]
    spell = lambda pieces: {p: b"".join(struct.pack("<I", ord(c)) for c in p) for p in pieces}
    for size in (1, 700, 10**6):
        assert bpe.encode_pieces(texts, bpe.Kept(50), spell, True, size) == [(t or "").encode("utf-32-le") for t in texts]
        assert bpe.encode_pieces(texts, bpe.Kept(50), spell, False, size) == [(t or "").encode("utf-32-le") for t in texts]


def test_records_encoder_equals_the_library_on_awkward_texts():
    from tokenizers import Tokenizer

    random.seed(12)
    path = P.path("byte_bpe_50k.json")
    parts = ["a", "b", " ", " ", "  ", "\n", "\n\n", "'s", "'", "\x1c", "é", "中", "12", "!!", "\t", "😀", " \n", "<|endoftext|>", "word,", " The", "\u00a0", "\u2028", "\u0120", "\r\n", "\x85"]
    texts = [None, "", " ", "\n", "ab" * 20000, "word " * 30000, *("".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(6000))]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (50, 10**7):
        got = records.library_encoder(path, size)(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
