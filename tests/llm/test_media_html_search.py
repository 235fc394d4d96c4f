"""TIFF round trips, main text of pages, and exact search, against plain versions."""

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.llm import html, media, search


@pytest.mark.parametrize("scheme", [media.NONE, media.LZW, media.PACKBITS, media.DEFLATE])
@pytest.mark.parametrize("options", [{}, {"predictor": 2}, {"tile": 16}, {"tile": 32, "predictor": 2}, {"strip_rows": 1}])
def test_tiff_round_trip(scheme, options):
    options = dict(options)
    rng = np.random.default_rng(scheme)
    pages = [rng.integers(0, k, (h, w), dtype=np.uint8) for k, h, w in ((256, 1, 1), (2, 40, 70), (256, 33, 65), (1, 100, 100))]
    rows = {k: options.pop(k) for k in list(options) if k == "strip_rows"}
    got = list(media.read_tiff(media.write_tiff(pages, [media.Form(scheme, **options)], **rows)))
    assert [p.page for p in got] == [0, 1, 2, 3]
    for p, image in zip(got, pages, strict=True):
        assert p.compression == scheme and (p.samples[:, :, 0] == image).all()


@pytest.mark.parametrize("n", [0, 1, 2, 255, 4000, 70000])
@pytest.mark.parametrize("letters", [1, 2, 256])
def test_codecs_are_lossless(n, letters):
    data = bytes(random.Random(n).randrange(letters) for _ in range(n))
    assert media.lzw_decode(media.lzw_encode(data), n) == data
    assert media.packbits_decode(media.packbits_encode(data), n) == data


def test_lzw_example_of_the_format():
    """Codes of the two ends of the widest table, and of a table that is never cleared."""
    data = random.Random(1).randbytes(20_000)
    stored = media.lzw_encode(data)
    assert stored[:2] == bytes((0x80, data[0] >> 2)) and media.lzw_decode(stored, len(data)) == data
    assert media.lzw_decode(stored, 100) == data[:100]
    # 9 bits each: clear, 7, 258 (not known yet: 7 7), 259 (7 7 7), end
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 259, 257)) + "000"
    assert media.lzw_decode(bytes(int(bits[k : k + 8], 2) for k in range(0, 48, 8)), 99) == b"\7" * 6
    with pytest.raises(media.BadTiff):
        media.lzw_decode(bytes(int(f"{256:09b}{300:09b}{0:06b}"[k : k + 8], 2) for k in range(0, 24, 8)), 99)


def test_pages_of_any_size_take_all_forms():
    kinds = set()
    for n in (0, 1, 5, 40):
        for k in range(12):
            kinds.add((n, next(media.read_tiff(media.store_payload(f"{k} " + "word " * 115 * n))).compression))
    assert kinds == {(n, f.scheme) for n in (0, 1, 5, 40) for f in media.FORMS}
    assert [p.compression for p in media.read_tiff(media.store_payload("long " * 400_000, media.FORMS))] in ([8, 32773, 5, 8], [32773, 5, 8, 32773], [5, 8, 32773, 5])


def test_packbits_example_of_the_format():
    stored = bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa".replace(" ", ""))
    plain = bytes.fromhex("aa aa aa 80 00 2a aa aa aa aa 80 00 2a 22 aa aa aa aa aa aa aa aa aa aa".replace(" ", ""))
    assert media.packbits_decode(stored, len(plain)) == plain


def test_big_endian_sixteen_bits():
    samples = np.array([[1, 500, 70, 65535]], dtype=">u2")
    head = b"MM\0*" + struct.pack(">I", 8 + samples.nbytes)
    tags = [(256, 4), (257, 1), (258, 16), (259, 1), (262, 1), (273, 8), (277, 1), (278, 1), (279, samples.nbytes)]
    data = head + samples.tobytes() + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in tags) + b"\0\0\0\0"
    (page,) = media.read_tiff(data)
    assert page.samples[:, :, 0].tolist() == samples.tolist()


def test_media_column(spark):
    texts = [None, "", "a", "x" * 576, "y" * 577, "é" * 5000, "word " * 200000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit("clash")).withColumn("page", F.lit(1))
    stored = media.store_media(docs, ["doc_id"])
    pages = media.tiff_pages(stored, ["doc_id", "n_bytes"]).collect()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        got = b"".join(p.pixels for p in sorted((p for p in pages if p.doc_id == i), key=lambda p: p.page))
        assert got[: len(raw)] == raw and len(got) % 576 == 0 and len(got) > 0 and set(got[len(raw) :]) <= {255}
        assert {p.n_bytes for p in pages if p.doc_id == i} == {len(raw)}
    assert max(p.page for p in pages) > 0


def test_broken_media_give_a_row_with_the_error(spark):
    good = media.store_payload("text " * 3000)
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"II*\0\xff\xff\xff\x7f")), (4, bytearray(good[: len(good) // 2])), (5, bytearray(good))], "id long, media binary")
    got = {r.id: r for r in media.tiff_pages(bad, ["id"]).collect()}
    assert all(got[k].error and got[k].pixels is None for k in (1, 2, 3, 4)) and got[5].error is None
    assert media.tiff_pages(bad.limit(0), ["id"]).count() == 0


def made_tiff(tags, body: bytes = b"") -> bytes:
    """A TIFF of one directory from (tag, kind, values)."""
    out, extra, entries = bytearray(b"II" + struct.pack("<HI", 42, 8)), b"", []
    for tag, kind, values in tags:
        raw = struct.pack(f"<{len(values)}{media.KINDS[kind]}", *values)
        inline = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", 8 + 2 + 12 * len(tags) + 4 + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries.append(struct.pack("<HHI", tag, kind, len(values)) + inline)
    return bytes(out + struct.pack("<H", len(tags)) + b"".join(entries) + b"\0\0\0\0" + extra + body)


HEADER = {256: (4, [4]), 257: (4, [4]), 258: (3, [8]), 259: (3, [1]), 273: (4, [0]), 278: (4, [4]), 279: (4, [16])}
TILED = {k: v for k, v in HEADER.items() if k not in (273, 278, 279)} | {322: (4, [0]), 323: (4, [16]), 324: (4, [0]), 325: (4, [16])}


@pytest.mark.parametrize(
    "tags",
    [HEADER | {256: (4, [0])}, HEADER | {257: (9, [-5])}, HEADER | {256: (4, [2**31]), 257: (4, [2**31])}, HEADER | {256: (4, [2**31]), 257: (4, [2**31]), 278: (4, [2**31])}, HEADER | {273: (4, [0, 8])}, HEADER | {273: (4, [])}, HEADER | {256: (2, [b"a"])}, HEADER | {273: (2, [b"a"])}, HEADER | {278: (4, [0])}, HEADER | {277: (4, [10**9])}, HEADER | {259: (3, [8]), 256: (4, [30_000]), 257: (4, [30_000]), 278: (4, [30_000])}, TILED, TILED | {322: (4, [2**30]), 323: (4, [2**30])}],
)
def test_headers_that_cannot_be_are_an_error_row(tags):
    assert [r[8] for r in media.page_rows(made_tiff([(t, *v) for t, v in HEADER.items()]))] == [None]
    (row,) = media.page_rows(made_tiff([(t, *v) for t, v in sorted(tags.items())]))
    assert row[0] == 0 and row[7] is None and row[8]


def test_changed_headers_never_crash():
    import tracemalloc

    rng = random.Random(1)
    bases = [media.store_payload("word " * k) for k in (0, 5, 400)] + [made_tiff([(t, *v) for t, v in d.items()]) for d in (HEADER, TILED)]
    errors = 0
    tracemalloc.start()
    for _ in range(10_000):
        data = bytearray(rng.choice(bases))
        for _ in range(rng.randint(1, 6)):
            data[rng.choice([rng.randrange(len(data)), max(0, len(data) - rng.randint(1, 160)), rng.randrange(min(16, len(data)))])] = rng.choice([0, 255, 128, 1, rng.randrange(256)])
        errors += any(r[8] for r in media.page_rows(bytes(data[: rng.randrange(len(data))] if rng.random() < 0.1 else data)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert errors > 5000 and most < 50_000_000


def test_digest_reads_back_what_was_stored(spark, tmp_path):
    spark.createDataFrame([(1, "abc"), (2, None), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op7_media(spark, str(tmp_path)).orderBy("doc_id").collect()
    payload = b"abc" + b"\xff" * 573
    assert (got[0].n_bytes, got[0].payload_bytes, got[0].payload_sha256, got[0].tail_crc32) == (3, 576, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[1] == got[2] and got[1].payload_bytes == 576


# -- pages -------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">buy</div><div id="c{n}" class="post{n} wide"><h1>Title &amp; {n}</h1>
<p>First <b>bold<br>line &eacute;&#33; <p>Second   para<!-- no --> with <a href=x>link</a>.</p><form><input>send</form><aside>more</aside>
<ul><li>one<li>two</ul><div class="comments"><p>me too</p></div></div><footer>&copy; all</footer></body></html>"""


def test_main_text_by_the_hosts_path(spark):
    short = '<body><div class="post7 wide"><p>Tiny.</p></div><div class="extra"><p>Much longer text than the article has on this page, which is no article.</p></div></body>'
    rows = [(k, "http://a.example/x", PAGE.format(n=k)) for k in range(5)] + [(7, "https://A.example:80/y?z", short), (8, None, None), (9, "no address", ""), (10, "http://b.example", "plain &lt;text&gt;"), (0, "http://a.example/x", PAGE.format(n=0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("path", F.lit("clash"))
    got = {r.page_id: r.text for r in html.extract_pages(pages, ["page_id", "url"]).collect()}
    assert got[3] == "Title & 3\n\nFirst bold line é!\n\nSecond para with link.\n\none\n\ntwo"
    assert got[7] == "Tiny." and got[8] == got[9] == "" and got[10] == "plain <text>"
    assert html.extract_pages(pages.limit(0), ["page_id"]).count() == 0
    assert html.extract_pages(pages, ["page_id"]).count() == len(rows)


def test_parser_on_odd_markup():
    for odd in ("<", "<p", "</p></div>text", "<div><div><p>a</body>", "<script>never closed <p>x", "<!-- never closed", "<p a='>'>q</p>", "&#xD800; &notanentity; &amp"):
        html.extract(odd, None)
    assert html.extract("<p a='>'>q</p>", None) == "q"


def test_skipped_elements_end_where_they_close():
    for icon in ('<svg class="i"/>', "<svg><g><svg></svg>x</g></svg>", "<math><svg/>x</math>", "<canvas>", "<svg>", "<template><p>x<template>y</template></template>"):
        assert html.extract(f"<div><p>one {icon}two</p><p>three</p><svg><text>no</text></svg><p>four</p></div>", None) == "one two\n\nthree\n\nfour"
    assert html.extract("<p>one</p><script>never closed <p>x", None) == "one"


def test_layout_words_do_not_take_the_article():
    text = "A long sentence of the article that goes on and on, as articles do."
    for page in (
        f'<div class="content has-sidebar"><h1 class="page-header">Title</h1><p>{text}</p><div class="sidebar">more</div></div>',
        f'<div id="page-with-comments"><article><h1>Title</h1><p>{text}</p></article><div class="comments">me too</div></div>',
        f'<form action="x"><input><div><div class="article-header"><h1>Title</h1></div><p>{text}</p></div></form>',
        f'<div class="share"><main><h2 class="section-header">Title</h2><p>{text}</p></main></div><div class="related"><article>other</article></div>',
    ):
        assert html.extract(f"<body>{page}<footer>all</footer></body>", None) == f"Title\n\n{text}"
    assert html.extract('<body><div class="notice"><p>one</p></div></body>', None) == "one"
    assert html.extract(f'<div><p>{text}</p><form><p>Send your name</p></form><span class="share">now</span></div>', None) == text


def _paragraphs(n: int) -> str:
    return "".join(f"<p>Paragraph {i} of the article with quite some words, so that it is text of some length.</p>" for i in range(n))


def _comments(n: int) -> str:
    return "".join(f"<li>Comment {i} by a reader who has an opinion on everything that is written here.</li>" for i in range(n))


@pytest.mark.parametrize("times", [1, 5, 50])
@pytest.mark.parametrize(
    "layout",
    [
        "<body><article><h1>T</h1>{a}</article><section class='comments'><ul>{c}</ul></section></body>",
        "<body><div class='post'><h1>T</h1>{a}</div><div class='comments'><ol>{c}</ol></div></body>",
        "<body><div class='post'>{a}</div><div id='comments'><ol>{c}</ol></div></body>",
        "<body><main><article><h1>T</h1>{a}<div id='disqus_thread'>{c}</div></article></main></body>",
        "<body><div class='entry'><h1>T</h1>{a}</div><article class='comment'>{c}</article></body>",
    ],
)
def test_comments_never_take_the_articles_place(layout, times):
    page = layout.format(a=_paragraphs(3), c=_comments(3 * times))
    text = html.extract(page, html.vote(page)[0])
    assert "Paragraph 2" in text and "opinion" not in text and text.startswith("T\n\n" if "<h1>" in page else "Paragraph 0")


@pytest.mark.parametrize(
    "layout",
    [
        "<article><h1>H</h1><p class='lead'>Lead</p><div class='body'>{a}</div></article>",
        "<body><div class='page'><div class='story'><h1>H</h1><p>Lead</p><div class='body'><div class='inner'>{a}</div></div></div></div></body>",
        "<body><h1>H</h1><p>Lead</p><div class='body'>{a}</div></body>",
        "<main><h1>H</h1><div><p>Lead</p><section>{a}</section></div></main>",
        "<body><article><header><h1>H</h1><p>Lead</p></header><section class='text'>{a}</section></article></body>",
    ],
)
def test_titles_and_leads_stay(layout):
    page = layout.format(a=_paragraphs(10))
    text = html.extract(page, html.vote(page)[0])
    assert text.startswith("H\n\nLead\n\nParagraph 0") and "Paragraph 9" in text


def test_words_in_class_names_are_not_boxes():
    text = "A long sentence of the article that goes on and on, as articles do."
    assert html.extract(f'<body><div class="container has-sidebar"><p>{text}</p></div></body>', None) == text
    assert html.extract(f'<body><div class="no-header-widget"><p>{text}</p></div></body>', None) == text
    assert html.extract(f'<article><div class="post-header"><h1>Title</h1></div><p>{text}</p></article>', None) == f"Title\n\n{text}"
    assert html.extract(f'<article><p>{text}</p><section class="related-work"><p>Others did so too.</p></section><div class="related-posts"><p>Read on</p></div></article>', None) == f"{text}\n\nOthers did so too."


@pytest.mark.parametrize("page", ["<a href='" * 120_000, '<p class="x>' * 90_000, "<a ='>' " * 120_000, "<div>" * 100_000 + "deep", "<b>" * 100_000 + "<div>x" * 20_000, "<svg " * 150_000, "<svg>" * 100_000, "<" * 1_000_000, "<!--" * 250_000, "&amp" * 200_000, "</p>" * 200_000, "<p>" * 200_000, "<li><a>" * 100_000, "<script " * 100_000, "</div x='" * 100_000])
def test_hostile_pages_take_no_time(page):
    at = time.time()
    html.extract(page, None)
    assert time.time() - at < 8  # about 1 s when the machine is idle; the square of the length would be hours


def test_generated_pages_give_back_their_articles(spark):
    """Pages of hosts with layouts of their own, articles with inline markup, lists and odd classes, menus, boxes, and comments."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "ku") for b in ("ban", "ser", "dil", "fon", "")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows, want = [], {}
    for host in range(6):
        box, shell = rng.choice(["div", "section", "article"]), rng.choice(["main-col", "content has-sidebar", "post wide"])
        for k in range(8):
            paragraphs = [say(rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
            items = [say(3) for _ in range(rng.randint(0, 4))]
            body = "".join(f"<p>{p.replace(' ', ' <b>', 1).replace('.', '</b>.', 1)}" + rng.choice(["</p>", ""]) for p in paragraphs) + ("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>" if items else "")
            head, ids = say(4), len(rows)
            links = "".join(f'<li><a href="/{j}">{say(2)}</a></li>' for j in range(rng.randint(3, 9)))
            page = f'<html><head><title>{head}</title><style>.x{{}}</style></head><body><header class="site-header"><nav><ul>{links}</ul></nav></header><div id="page"><{box} class="{shell} id{k}"><h1>{head}</h1>{body}<div class="share-buttons"><a href="#">{say(2)}</a></div></{box}><aside class="sidebar"><p>{say(9)}</p></aside><div class="comments"><p>{say(15)}</p><form><textarea>{say(4)}</textarea></form></div></div><div class="cookie-banner"><p>{say(10)}</p></div><footer>{say(8)}</footer><script>var a = "<p>{say(3)}</p>";</script></body></html>'
            rows.append((ids, f"http://h{host}.example/{k}", page))
            want[ids] = "\n\n".join([head, *paragraphs, *items])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_pages(pages, ["page_id"]).collect()}
    assert got == want


# -- search ------------------------------------------------------------------------------------------------------


def brute_top(rows, k):
    valid = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = tuple(float(np.floor(256 * float(np.float32(x)))) for x in v)
            valid[i] = min(valid.get(i, q), q)
    out = []
    for i in sorted(valid):
        if i % 5 == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(valid[i], v, strict=True))), j) for j, v in valid.items() if j != i and len(v) == len(valid[i]))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("block_rows,pivots", [(1024, 64), (7, 3)])
def test_search_is_exact(spark, block_rows, pivots):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(4, 8))
    rows = [(i, [float(x) for x in centers[i % 4] + 0.1 * rng.normal(size=8)]) for i in range(90)]
    rows += [(i, list(rows[0][1])) for i in (200, 201, 205)] + [rows[5], (300, None), (305, [1.0, None] + [0.0] * 6), (310, [float("nan")] * 8), (315, [float("inf")] * 8), (320, [1.0, 2.0]), (325, [0.0] * 8), (None, [1.0] * 8), (330, []), (335, []), (336, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit("clash"))
    got = search.top_k(df, F.col("id") % 5 == 0, 5, n_pivots=pivots, block_rows=block_rows)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == sorted(brute_top(rows, 5))
    assert search.top_k(df.limit(0), F.col("id") % 5 == 0).count() == 0
