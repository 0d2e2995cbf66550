"""TIFF round trips and HTML extraction."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from veilframe.llm import html, tiff


@pytest.mark.parametrize(("compression", "predictor", "tiled", "order"), list(itertools.product(tiff.PACK, (1, 2), (False, True), "<>")))
def test_pages_come_back(compression, predictor, tiled, order):
    r = np.random.default_rng(4)
    pages = [r.integers(0, 256, (37, 21, 3), dtype=np.uint8), np.full((5, 64, 1), 7, np.uint8), r.integers(0, 3, (70, 50, 1), dtype=np.uint8)]
    back = list(tiff.read_pages(tiff.write_tiff(pages, compression, predictor, 16, tiled, order)))
    assert [how["compression"] for _, how in back] == [compression] * 3
    assert all(np.array_equal(a, b) for a, (b, _) in zip(pages, back, strict=True))


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 1000, bytes(range(256)) * 40, bytes(np.random.default_rng(1).integers(0, 256, 20_000, dtype=np.uint8))])
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_texts_as_media(spark):
    rows = [(1, None), (2, ""), (3, "x" * 192), (4, "é" * 100_000), (5, "x" * 192), (None, "a"), (6, "y" * 193)]
    docs = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, feature string")
    got = {r["doc_id"]: r for r in tiff.as_media(docs).collect()}
    for k, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[3]["media_sha256"] == got[5]["media_sha256"] and got[3]["feature"] == got[5]["feature"]


def test_damaged_media_are_told(spark):
    good = tiff.write_tiff([np.zeros((2, 2, 1), np.uint8)] * 2)
    media = spark.createDataFrame([(1, good), (2, None), (3, b"II*\0"), (4, good[:-9])], "id long, data binary")
    rows = tiff.explode_pages(media).collect()
    assert sorted(r["page"] for r in rows if r["id"] == 1) == [0, 1]
    assert {r["id"] for r in rows if r["error"]} == {2, 3, 4}


LONG = "One sentence of the article that goes on for a while, so that it weighs more than a menu does. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x = "</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav><!-- c --><div class="ad">Buy this now.</div>
<article><h1>Heading &amp; more</h1><p>First  block:\n {LONG}</p><p>Second &eacute;&#233; block. {LONG}<br></p></article>
<aside>Related things</aside><form><input value="q">Search</form><div class="comments"><p>Nice! {LONG}</p></div><footer>&copy; someone</footer></body></html>"""


def test_article_without_what_surrounds_it():
    one = " ".join(f"First block: {LONG}".split())
    two = " ".join(f"Second éé block. {LONG}".split())
    assert html.main_text(PAGE) == f"Heading & more\n{one}\n{two}"


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>", "x"), (4, "u", "plain text only, no tag at all", "x"), (5, "u", "<p>" * 20_000, "x"), (6, "u", "<<<>>>&#xFFFFFFF; &bogus;", "x")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert all(got[k]["text"] == "" and got[k]["n_chars"] == 0 for k in (1, 2, 3, 5))
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_articles_are_whole():
    long = [f"Paragraph {k}. {LONG}".strip() for k in range(3)]
    page = "<body><nav>Menu</nav><article><h1>A title of thirty characters</h1><section>{}</section><section><h2>Second section</h2><p>Short text here.</p></section><ul><li><a href='/x'>A reference of the list</a></li></ul><div class='ad'>Buy</div></article></body>"
    got = html.main_text(page.format("".join(f"<p>{p}</p>" for p in long)))
    assert got.split("\n") == ["A title of thirty characters", *long, "Second section", "Short text here.", "A reference of the list"]


def test_siblings_of_a_region_come_back():
    page = f"<body><div class='x'><a href='/'>Home</a></div><div class='post'><h1>The title</h1><div><p>{LONG}</p><p>{LONG}</p></div><div><h2>More</h2><p>Short.</p></div></div></body>"
    assert html.main_text(page).split("\n") == ["The title", LONG.strip(), LONG.strip(), "More", "Short."]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><p class="ad">Buy<p>{LONG}<p>{LONG}', f"{LONG.strip()}\n{LONG.strip()}"),
        (f'<article><ul><li class="share">x<li>{LONG}<li>{LONG}</ul></article>', f"{LONG.strip()}\n{LONG.strip()}"),
        (f'<article><p>{LONG}</p><section id="related-work"><h2>Related work</h2><p>{LONG}</p></section></article>', f"{LONG.strip()}\nRelated work\n{LONG.strip()}"),
        (f'<article><p>{LONG}</p><div class="related-posts"><a href="/a">{LONG}</a></div><div class="cookie-notice">{LONG}</div><div class="notice">{LONG}</div></article>', LONG.strip()),
        (f'<main><table><tr><td class="promo">x<td>{LONG}<tr><td>{LONG}</table></main>', f"{LONG.strip()}\n{LONG.strip()}"),
        (f'<article><dl><dt class="ad">x<dd>{LONG}</dl><p>{LONG}</article>', f"{LONG.strip()}\n{LONG.strip()}"),
    ],
)
def test_left_out_end_tags_and_doubtful_names(page, want):
    assert html.main_text(page) == want


def test_empty_tables(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert tiff.as_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def hand_made(compression, strips, width, height, sizes=None, extra=None):
    """A one-page file put together by hand, short of all that the writer does."""
    tags = {256: width, 257: height, 258: 8, 259: compression, 262: 1, 277: 1, 278: height, **(extra or {})}
    data = bytearray(b"II*\0" + (8).to_bytes(4, "little"))
    n = len(tags) + 2
    at = 8 + 2 + 12 * n + 4
    tags |= {273: at, 279: len(strips) if sizes is None else sizes} if not extra else {324: at, 325: len(strips)}
    data += n.to_bytes(2, "little")
    for tag in sorted(tags):
        data += tag.to_bytes(2, "little") + (4).to_bytes(2, "little") + (1).to_bytes(4, "little") + tags[tag].to_bytes(4, "little")
    return bytes(data + bytes(4) + strips)


def test_hand_made_files():
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0x80, 0xFD, 0xAA])  # 3 x AA, literal 80 00 2A, no-op, 4 x AA
    page, how = next(tiff.read_pages(hand_made(32773, packed, 5, 2)))
    assert page.tobytes() == bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4) and how["compression"] == 32773
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # the example of the format's specification: 7 7 7 8 8 7 7 6 6
    bits = "".join(f"{c:09b}" for c in codes)
    lzw = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    page, _ = next(tiff.read_pages(hand_made(5, lzw, 9, 1)))
    assert page.tobytes() == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    page, how = next(tiff.read_pages(hand_made(1, bytes(range(16)), 3, 2, extra={322: 4, 323: 4})))
    assert page.tobytes() == bytes([0, 1, 2, 4, 5, 6]) and how["tiled"]


def test_impossible_files_are_told(spark):
    bad = [hand_made(1, b"abc", 5, 2), hand_made(1, b"abcd", 2, 2, extra={322: 0, 323: 2}), hand_made(1, b"", 1 << 31, 1 << 31), hand_made(8, b"xx", 2, 2)]
    rows = tiff.explode_pages(spark.createDataFrame(list(enumerate(bad)), "id long, data binary")).collect()
    assert len(rows) == len(bad) and all(r["error"] and r["page"] is None for r in rows)


def test_large_ids_beside_null_ones(spark):
    big = 9007199254740993
    docs = spark.createDataFrame([(big, "a"), (None, "b")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in tiff.as_media(docs).collect()} == {big, None}
    pages = spark.createDataFrame([(big, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in html.extract(pages).collect()} == {big, None}


def test_every_layout_is_in_use(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 90)) for k in range(80)], "doc_id long, text string")
    got = {r["doc_id"]: r["payload_sha256"] for r in tiff.as_media(docs).collect()}
    for k in range(80):
        raw = (f"text {k} " * (k % 90)).encode()
        assert got[k] == hashlib.sha256(raw.ljust(max(192, -(-len(raw) // 192) * 192))).hexdigest()
    assert len({zlib.crc32((f"text {k} " * (k % 90)).encode().ljust(max(192, -(-len(f"text {k} " * (k % 90)) // 192) * 192))) % len(tiff.LAYOUTS) for k in range(80)}) == len(tiff.LAYOUTS)
