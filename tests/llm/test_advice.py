"""Texts, pages and URLs that lost a part before."""

import random

import numpy as np
import public_tokenizers as P

from parlance.llm import records
from parlance.llm.html_extract import main_text
from parlance.llm.url_filter import judge


def test_records_keep_added_tokens():
    from tokenizers import Tokenizer

    random.seed(5)
    path = P.path("byte_bpe_50k.json")
    parts = ["a", " ", "  ", "\n", "<|endoftext|>", "word,", " The", "é", "\t", "<|endof"]
    texts = ["a <|endoftext|> b", "a  <|endoftext|>", None, "", *("".join(random.choice(parts) for _ in range(random.randint(1, 12))) for _ in range(2000))]
    plain = Tokenizer.from_file(path)
    got = [np.frombuffer(x, "<u4").tolist() for x in records.library_encoder(path)(texts)]
    assert 50256 in got[0] and got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_html_open_media_end_with_their_parent():
    article = "<article><p>This is the first sentence of the article, which is long enough.</p><p>And this is its second sentence, long enough too.</p></article>"
    want = "This is the first sentence of the article, which is long enough.\nAnd this is its second sentence, long enough too."
    for tag in ("svg", "object", "video", "audio", "canvas", "template"):
        assert main_text(f"<body><div><{tag} id=x>lost words</div>{article}</body>") == want, tag
        assert main_text(f"<body><div><{tag} id=x><p>lost words</{tag}></div>{article}</body>") == want, tag
        assert main_text(article.replace("first sentence", f"first <{tag}>lost</{tag}> sentence")) == want, tag
    assert "<" not in main_text(f"<body><svg><path d=x>{article}</body>")
    assert main_text(article.replace("first sentence", "first <math><mi>x</mi></math> sentence")) == want.replace("first sentence", "first x sentence")


def test_url_path_with_line_breaks(spark):
    pages = [(1, "http://example.org/es/a\nb?c"), (2, "http://example.org/es/a\n"), (3, "http://example.org/es/\r\nx#y")]
    got = judge(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame([("example.org/es/", "block", True)], "entry string, verdict string, rule boolean")).collect()
    assert {r.page_id: (r.path, r.verdict) for r in got} == {1: ("/es/a\nb", "block"), 2: ("/es/a\n", "block"), 3: ("/es/\r\nx", "block")}


def test_html_takes_linear_time_on_any_page():
    import time

    pages = ("<b>" * 350_000, "<head>" * 170_000, "<hr>" * 250_000 + "x", "<b>" * 160_000 + "x<hr>" * 100_000, "<a><div>" + "<b>" * 100_000 + "</a>" * 100_000, "<p><table><td>" + "<b>" * 100_000 + "<div>" * 50_000)
    began = time.time()
    for page in pages:
        main_text(page)
    assert time.time() - began < 60


def test_html_class_words_do_not_take_an_article():
    first = "This is the first sentence of the article, which is long enough, and another part of it follows here so that it is a real paragraph."
    second = "And this is its second sentence, long enough too, with as many words as a paragraph of some article or other may well have."
    inside = f"<p>{first}</p><p class=byline>By Ann Example, who wrote it.</p><p>{second}</p>"
    want = f"{first}\nBy Ann Example, who wrote it.\n{second}"
    around = "<nav><a href=x>Home</a><a href=y>News</a></nav>%s<footer>All the rest</footer>"
    for part in (f'<article class="post-1 post category-social tag-legal">{inside}</article>', f'<main id="sidebar-less ads">{inside}</main>', f'<div class="post tag-legal">{inside}</div>'):
        assert main_text(f"<body class='ads sidebar'>{around % part}</body>") == want, part
    assert main_text(around % f"<article>{inside}<div class=comments><p>A reader says a word or two, and more words here.</p></div></article>") == want


def test_top_k_copies_blocks_only_for_slices_routed_to_them(spark, monkeypatch):
    from parlance.llm import topk

    points = spark.createDataFrame([(k % 5, k) for k in range(100)], "block int, id bigint")
    sent = spark.createDataFrame([(0, 0), (0, 0), (0, 3), (2, 1)], "block int, slice int")
    for most in (1 << 17, 0):
        monkeypatch.setattr(topk, "MAX_PAIRS", most)
        got = {(r.block, r.slice): r["count"] for r in topk.copied(points, sent).groupBy("block", "slice").count().collect()}
        assert got == {(0, 0): 20, (0, 3): 20, (2, 1): 20}


def test_simhash_of_a_fingerprint_that_a_third_of_all_rows_share(spark):
    from collections import Counter

    from parlance.llm.simhash import fingerprint, near_duplicates

    rng = random.Random(8)
    texts = [f"text of {rng.random()} and {rng.random()} more" for _ in range(3000)] + ["one and the same text here"] * 3500 + [None] * 3000
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(8)
    got = near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(range(len(texts)))
    prints = {r.doc_id: r.fingerprint for r in got}
    assert all(prints[k] == f"{fingerprint(texts[k], 3, 42):016x}" for k in range(0, len(texts), 97))
    assert {r.component_id for r in got if 3000 <= r.doc_id < 6500} == {3000} and {r.component_id for r in got if r.doc_id >= 6500} == {6500}
