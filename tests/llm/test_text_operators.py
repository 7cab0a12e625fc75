"""Chat formatting, quality rules, byte-level BPE, HTML text and URL filter against plain versions and edge cases."""

import base64
import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
import zstandard
from hypothesis import given
from hypothesis import strategies as st

from lumenbank.llm import byte_bpe, chat, html_text, quality_rules, queries, url_filter

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def same_as_oracle(spark, name, sf=SF):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    found = queries.QUERIES[name](spark, sf).toPandas()
    held = con.execute(queries.ORACLES[name]).fetchdf()[list(found.columns)]
    key = list(found.columns)
    a = found.astype(str).sort_values(key).reset_index(drop=True)
    b = held.astype(str).sort_values(key).reset_index(drop=True)
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    same_as_oracle(spark, name)


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]", 9),
        (1, 1, "assistant", "[\\INST] <\\\\s> [", 9),
        (1, 2, None, None, 9),
        (2, 0, "assistant", "first", 9),
        (2, None, "[INST]", "odd [/ROLE] role", 9),
        (None, 1, "system", "", 9),
        (1, 1, "assistant", "[\\INST] <\\\\s> [", 9),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    formatted = chat.format_turns(turns)
    template = chat.Template()
    for r in formatted.collect():
        assert not re.search(r"</?s>|\[/?(INST|SYS|ROLE)\]", r.segments[1].text)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 4, 2: 2, None: 1}
    for conv in got:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].invalid_turns == 2
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0
    assert template.unescape("a[\\INST]") == "a[INST]"


def slow_measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]", text or "") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@given(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b b", "\n", "c#", "é\n", " ", "\t|", "a b c d e f g h"]), max_size=60).map(" ".join)))
def test_quality_measures(text):
    got = quality_rules.measure(text, zstandard.ZstdCompressor(level=3))
    assert got[:5] == slow_measures(text)
    assert got[5] == (got[0] < 20 or 100 * got[4] > 30 * got[0])


def test_quality_rules_reject_and_keep(spark):
    import random

    r = random.Random(1)
    plain = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000))
    noise = " ".join("".join(chr(r.randint(33, 0x2FFF)) for _ in range(6)) for _ in range(3000))
    dull = " ".join(f"w{i % 7} item{i}" for i in range(4000))
    docs = spark.createDataFrame([(1, plain, 0), (2, noise, 0), (3, "", 0), (4, None, 0), (5, "x " * 5000, 0), (6, dull, 0)], "doc_id long, text string, kept int")
    got = {x.doc_id: x.kept for x in quality_rules.measure_documents(docs).collect()}
    assert got[1] and not any(got[i] for i in (3, 4, 5))
    assert {x.doc_id for x in quality_rules.keep_documents(docs).collect()} == {i for i, k in got.items() if k}
    assert quality_rules.keep_documents(docs).columns == docs.columns
    assert quality_rules.measure_documents(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(spark, library):
    texts = ["", None, "a", "ab" * 900, "x y" * 400, "   \n\n  " * 200, "it's we'll 12 345 <|endoftext|> é 日本語 😀" * 40, "word " * 700, "a" * 50 + " " * 300 + "b" * 300, "tail   " * 99 + "    "]
    docs = spark.createDataFrame([(i % 7, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, part int")
    for chunk, overlap in ((64, 16), (50, 49), (16_384, 1_024)):
        got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.token_digests(docs, PATH, PATTERN, chunk, overlap).collect())
        held = []
        for i, t in enumerate(texts):
            ids = library.encode_ordinary(t or "")
            held.append((i % 7, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(held)
    whole = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN, 64, 16), PATH).orderBy("row", "part").collect()
    back = {}
    for r in whole:
        back[r.row] = back.get(r.row, b"") + bytes(r.raw)
    assert sorted(back.values()) == sorted((t or "").encode() for t in texts)
    assert byte_bpe.token_digests(docs.limit(0), PATH, PATTERN).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top">Site name</header><nav><ul><li><a href="/a">Menu</a><li><a href="/b">Other</a></ul></nav>
<div class="ad">Buy this now</div><div id="cookie-notice">We use cookies on this site, please accept all of them</div>
<article><h1>A  title</h1><p><b>One &eacute;&#33; two<br>three<p>Short.</p><p class="x">With a <a href="/l">link</a> in it.</p>
<div class="comments"><p>I am a reader comment of some length that says quite a lot about it.</p></div>
<form><label>Mail</label><input name="q"><button>Go</button></form></article>
<aside>Related reading</aside><footer>&copy; us</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain < text"), (5, "u", "<article><p>Cut &am"), (1, "u", PAGE), (6, "u", "<article><p>a<script>x</article>" + "<p>y" * 5)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, blocks string")
    got = sorted(((r.page_id, r.text) for r in html_text.extract(pages).collect()))
    want = "A title\nOne é! two three\nShort.\nWith a link in it."
    assert got[:2] == [(1, want)] * 2
    assert dict(got)[2] == dict(got)[3] == ""
    assert dict(got)[5] == "Cut &am"
    assert dict(got)[6] == "a"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_articles_of_the_table(spark):
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        pieces = [" ".join(unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inner)]
        assert got[r.page_id] == "\n".join(x for x in pieces if x)


def test_url_rules(spark):
    urls = [
        ("http://a.COM/x", "a.com", "/x", "com/", "allow"),
        ("http://a.com", "a.com", "", None, None),
        ("https://Example.com/en/1?q=/fr/", "example.com", "/en/1", "example.com/en/", "block"),
        ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://b.net/es/x#t", "b.net", "/es/x", "net/es/", "block"),
        ("http://b.net/de/", "b.net", "/de/", None, None),
        ("nothing", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("a://b://c.com/", "b:", "//c.com/", None, None),
        ("http://a.com?x=/", "a.com", "", None, None),
    ]
    pages = spark.createDataFrame([(i, u[0], "w") for i, u in enumerate(urls)], "page_id long, url string, words string")
    model = url_filter.UrlModel.fit(url_filter.labelled_urls(spark), trees=5)
    got = {r.page_id: r for r in url_filter.judge(pages, model).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or verdict is None and got[i].verdict in ("allow", "block")
    host, path = url_filter.split_url(url_filter.F.col("url"))
    asked = pages.select(pages.page_id.alias("row_key"), host.alias("host"), path.alias("path"))
    joined = {r.row_key: r.rule for r in url_filter.match_rules(asked, url_filter.rule_frame(spark)).collect()}
    assert joined == {i: u[3] for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), model).count() == 0


def test_url_trees_tell_spam(spark):
    model = url_filter.UrlModel.fit(url_filter.labelled_urls(spark), trees=10)
    urls = spark.createDataFrame([(0, "http://www.cheap-pills.example.org/de/3"), (1, "http://m.free-bets.example.org/en/27#top"), (2, "http://thther.example.org/en/217?page=2&ref=x"), (3, "http://blog.tiontion.example.org/de/180/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(urls, model).orderBy("page_id").collect()] == ["block", "block", "allow", "allow"]


def test_quality_verdicts_match_brute_force(spark):
    """Bands over whole texts and every chunk, the last one too, by a plain loop over the table."""
    compressor = zstandard.ZstdCompressor(level=3)
    limits = [(16_384, 0.18, 0.8), (4_096, 0.2, 0.85), (1_024, 0.22, 0.9), (256, 0.25, 1.0), (0, 0.0, 9.0)]
    noise = "".join(chr(33 + (i * i * 7919 + i // 3) % 90) for i in range(4_096))
    plain = " ".join(f"word{i * 37 % 1009} and{i}" for i in range(600))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, plain[:4_096] + "x" * 3_000), (-2, plain[:8_000]), (-3, noise + plain[:300]), (-4, None)], "doc_id long, text string"))
    got = {r.doc_id: r for r in quality_rules.measure_documents(docs).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        inside = lambda part, whole: next(low <= len(compressor.compress(part)) / max(len(part), 1) <= high for least, low, high in ([(0, 0.2, 0.85)] if whole else limits) if len(part) >= least)
        parts = [raw[k : k + 4_096] for k in range(0, len(raw), 4_096)]
        bad = sum(not inside(p, len(p) == 4_096) for p in parts)
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and inside(raw, False) and 2 * bad <= len(parts))


def test_one_pre_token_over_many_chunks(spark):
    text = "start " + "a" * 40_000 + " end " + " " * 9_000 + "x"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = byte_bpe.token_digests(docs, PATH, PATTERN, 500, 50).first()
    assert got.n_tokens == len(byte_bpe.load_encoding(PATH, PATTERN).encode_ordinary(text))


def held_by(library, text):
    ids = library.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def fuzzed(n, seed):
    """Texts of white space of every kind, contractions, digits, letters and signs, mixed at random."""
    import random

    draw = random.Random(seed)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "​", "a", "don't", "'re", "'", "r", "e", "'ll", "7", "42", "é", "日本", "́", "??", "...", "\U0001f600", "word", "Zz"]
    return ["".join(draw.choices(parts, k=draw.randint(1, 160))) for _ in range(n)] + [" " * draw.randint(1, 300) + "x" for _ in range(5)] + ["\n" * 200, "a" * 300 + "\n\n" + "b" * 200]


@pytest.mark.parametrize("chunk, overlap", [(20, 8), (33, 5), (50, 10), (128, 32)])
def test_bpe_chunks_meet_anywhere(spark, library, chunk, overlap):
    """Wherever a chunk ends, also after mixed white space or inside a contraction, the ids are the library's."""
    texts = fuzzed(700, chunk)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.token_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, PATTERN, chunk, overlap).collect()}
    wrong = [t for i, t in enumerate(texts) if got[i] != held_by(library, t)]
    assert not wrong, (len(wrong), wrong[:3])


def test_bpe_blank_line_at_a_border(spark, library):
    texts = ["x " * 16_383 + "\n\n5" + " tail" * 9_000, "y" * 32_766 + "\n\n5 " + "z\n\n" * 20_000, "w " * 16_384 + "don't" * 9_000]
    got = byte_bpe.token_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, PATTERN).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got] == [held_by(library, t) for t in texts]
