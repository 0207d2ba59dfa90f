"""Operators that map texts: token counts, secrets, main text of pages."""

import base64
import bz2
import gzip
import json
import lzma
import random
import re
import time
import zlib
from hashlib import sha256
from urllib.parse import quote

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import html_text, packing, secret_scan, token_fst
from millrace.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_fst.TokenCounter(PATH)


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


PIECES = ["a", "b", "'", "'s", "'re", "'r", "'ll", "'ve", "'v", "'t", "'d", " ", "  ", "\n", "\t", "\r\n", "1", "23", "é", "ß", "中", "!", "..", "<|endoftext|>", "\x00", "\x85", " ", " ", "ſ", "😀", "the", " er", "th", "​", "İ", "re", "l"]


def test_counts_equal_the_library(counter, library):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(4000)] + [None, "", "a" * 5000, " " * 3000, "'" * 700]
    assert counter.counts(texts).tolist() == wanted(library, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_counts_of_any_text(counter, library, texts):
    assert counter.counts(texts).tolist() == wanted(library, texts)


def test_prefix_scan_composes_as_a_fold():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 12, (37, 12)).astype(np.uint8)
    state, exits = np.arange(12), []
    for m in maps:
        state = m[state]
        exits.append(state.copy())
    assert (token_fst.scanned(maps) == np.array(exits)).all()


def test_states_are_dropped_and_made_again(library, monkeypatch):
    monkeypatch.setattr(token_fst, "MAX_STATES", 50)
    monkeypatch.setattr(token_fst, "GROUP", 64)
    monkeypatch.setattr(token_fst, "WIDE", 9)
    monkeypatch.setattr(token_fst, "SLOTS", 12)
    counter = token_fst.TokenCounter(PATH)
    texts = [" ".join(f"word{i} reading{i}ish" for i in range(200)), "é" * 40 + "a" * 300, "x"]
    assert counter.counts(texts).tolist() == wanted(library, texts)


def test_token_counts_of_a_table(messy, clashing, empty, library):
    rows = token_fst.count_tokens(messy, PATH).collect()
    assert [r["n_tokens"] for r in rows] == wanted(library, [r["text"] for r in rows])
    assert token_fst.count_tokens(clashing, PATH).count() == messy.count()
    assert token_fst.count_tokens(empty, PATH).collect() == []


def test_ids_equal_the_library(library, monkeypatch):
    ids = packing.Ids(PATH)
    rng = random.Random(4)
    for _ in range(1500):
        t = "".join(rng.choices(PIECES, k=rng.randint(0, 40)))
        assert next(ids.of([t])).tolist() == library.encode(t, add_special_tokens=False).ids
    for c in range(0x3000):
        t = f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? {chr(c)} {chr(c)}{chr(c)}"
        assert next(ids.of([t])).tolist() == library.encode(t, add_special_tokens=False).ids, c
    for stream in (1, 300, 10**6):
        monkeypatch.setattr(packing, "STREAM", stream)
        monkeypatch.setattr(packing, "MOST_PIECES", 40)
        texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(400)]
        assert [x.tolist() for x in packing.Ids(PATH).of(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(ids.of([])) == []


# -- secrets


def brute(text):
    out = []
    for kind, pattern, flags, ok in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, flags) if ok(m)]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


BITS = ["password", "PassWd", "api_key", "APIKEY", "tokEN", "ſecret", "secret", '"', "'", " ", " : ", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "beef", "xyz", "-", "\n", "é", "😀", "K", "%41", "\\u0041", "&#65;"]


def test_base_spans_equal_brute_force():
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choices(BITS, k=rng.randint(0, 14)))
        base, spans = secret_scan.scan_text(t)
        assert base == brute(t)
        assert set(base) <= set(spans)


SECRET = "password = hunter22x"
LAYERS = {
    "url": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "quote": lambda s: quote(s, safe=""),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "long": lambda s: "".join(f"\\U{ord(c):08x}" for c in s),
    "reference": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "urlsafe": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    "bz2": lambda s: base64.b64encode(bz2.compress(s.encode())).decode(),
    "xz": lambda s: base64.b64encode(lzma.compress(s.encode())).decode(),
    "url of gzip": lambda s: "".join(f"%{b:02x}" for b in gzip.compress(s.encode())),
    "escaped gzip": lambda s: "".join(f"\\x{b:02x}" for b in gzip.compress(s.encode())),
}


@pytest.mark.parametrize("outer", LAYERS)
@pytest.mark.parametrize("inner", LAYERS)
def test_nested_layers(inner, outer):
    body = LAYERS[outer](LAYERS[inner](SECRET))
    text = f"some words {body} and more"
    base, spans = secret_scan.scan_text(text)
    found = [s for s in spans if s[0] == "assign"]
    assert found, (inner, outer)
    assert all(11 <= i < j <= 11 + len(body) for _, i, j in found)
    assert not secret_scan.scan_text(secret_scan.redact(text, spans))[1]


def test_spans_map_to_the_letters_that_made_them():
    text = "x %70assword%3Dabcdef1 y"
    assert secret_scan.scan_text(text)[1] == [("assign", 2, 22)]


def test_fixpoint_ends_on_layers_that_repeat_and_on_bombs():
    assert secret_scan.scan_text("%25" * 500 + "41")[1] == []
    bomb = base64.b64encode(zlib.compress(b"a" * 5_000_000)).decode()
    assert secret_scan.scan_text(f"q {bomb}", block=1_000_000)[1] == [("hex", 2, 2 + len(bomb.rstrip("=")))]


def test_a_long_stream_hides_no_other_region_and_is_scanned_whole():
    inside = b"-" * 3_000_000 + b" password = hunter22x " + b"+" * 1_900_000
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        bomb = base64.b64encode(pack(inside)).decode()
        after = base64.b64encode(SECRET.encode()).decode()
        text = f"q {bomb} and {after} end"
        spans = secret_scan.scan_text(text, block=1_000_000)[1]
        at, k = 2 + len(bomb.rstrip("=")), text.index(after)
        assert ("assign", 2, at) in spans and {kind for kind, *_ in spans} <= set(secret_scan.KINDS)
        assert any(kind == "assign" and k <= i < j <= k + len(after) for kind, i, j in spans)
        assert all(j <= at or i >= k for _, i, j in spans)


def test_a_secret_longer_than_a_block_counts():
    value = bytes(97 + i * i % 23 for i in range(3_000_000))
    for body in (b"token=" + value, value[:-40].upper() + b"token=" + value):
        text = base64.b64encode(gzip.compress(body)).decode()
        assert ("assign", 0, len(text.rstrip("="))) in secret_scan.scan_text(text, block=1_000_000)[1]


@pytest.mark.parametrize(
    "text",
    [
        "a" * 1_000_000 + " 100%",
        "a" * 1_000_000 + "\\",
        "\\u0061" + "a" * 1_000_000 + "&",
        "data:image/png;base64," + base64.b64encode(random.Random(1).randbytes(750_000)).decode() + " 100%",
        "%4 " * 300_000,
        "%41 " * 250_000,
        "\\n" * 500_000,
        "a\n" * 500_000,
        "&#" * 500_000,
        "ab%" * 300_000,
        "%" + "25" * 400_000 + "41",
        "\\" * 400_000 + "u0041",
    ],
    ids=range(12),
)
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    secret_scan.scan_text(text)
    assert time.process_time() - began < 12


def wrapped(data, n, end="\n"):
    b = base64.b64encode(data).decode()
    return end.join(b[i : i + n] for i in range(0, len(b), n))


@pytest.mark.parametrize(
    "text",
    [
        *(wrapped(SECRET.encode(), n, end) for n in (3, 10, 24, 32) for end in ("\n", "\r\n", "\n    ")),
        *(wrapped(gzip.compress(b"x" * 40 + SECRET.encode()), n) for n in (10, 24, 32)),
        "https://x.y/" + base64.b64encode(SECRET.encode()).decode(),
        "?a=%FF&p=" + quote(SECRET),
        base64.b64encode(bz2.compress(b"first") + bz2.compress(SECRET.encode())).decode(),
        base64.b64encode(gzip.compress(b"first") + gzip.compress(SECRET.encode())).decode(),
        "x\\u{70}assword = hunter22x",
        "x%u0070assword = hunter22x",
        "password&equals;hunter22x",
        "&quot;password&quot;&colon;&quot;hunter22x",
        "password+%3D+hunter22x",
        json.dumps(json.dumps(json.dumps({"password": "hunter22x"}))),
        json.dumps(json.dumps({"password": "hunter22x"})).replace("p", "\\u0070"),
        "p\\141ssword\\075hunter22x",
        "C%3A%5Ctoken%3Dabcdef",
        "".join(f"\\x{b:02x}" for b in SECRET.encode("utf-16-le")),
        base64.b64encode(zlib.compress(SECRET.encode() * 2)[2:-4]).decode(),
        base64.b64encode(lzma.compress(SECRET.encode(), lzma.FORMAT_ALONE)).decode(),
        base64.b64encode(zstandard.compress(SECRET.encode())).decode(),
        quote(gzip.compress(SECRET.encode())),
    ],
)
def test_every_layer_is_unwrapped(text):
    for glue in ("", "words before ", "α "):
        base, spans = secret_scan.scan_text(glue + text + " and after")
        assert not base
        found = [(i, j) for kind, i, j in spans if kind == "assign"]
        assert found and all(len(glue) <= i < j <= len(glue) + len(text) for i, j in found), spans
        assert not secret_scan.scan_text(secret_scan.redact(glue + text, spans))[1]


def test_deep_layers_of_mixed_escapes():
    rng = random.Random(8)
    for depth in (1, 3, 7, 8, 9, 15, 40):
        text = SECRET
        for _ in range(depth):
            kind = rng.choice((lambda c: f"%{ord(c):02x}", lambda c: f"\\u{ord(c):04x}", lambda c: f"&#{ord(c)};", lambda c: f"&#x{ord(c):x};"))
            at = rng.choice([k for k in range(5) if depth < 6 or text[k] != "\\"])
            text = text[:at] + kind(text[at]) + text[at + 1 :]
        spans = secret_scan.scan_text(text)[1]
        assert ("assign", 0, len(text)) in spans, (depth, text)


@pytest.mark.parametrize(
    ("text", "hidden"),
    [
        ('{"password": "p\\u0061ssw0rd123"}', "p\\u0061ssw0rd123"),
        ("password = %68unter2secret", "%68unter2secret"),
        ("token : &#97;bcdefgh", "&#97;bcdefgh"),
        ("é %C3%A9 password = %68unter2secret", "%68unter2secret"),
    ],
)
def test_a_key_before_an_escaped_value_counts(text, hidden):
    spans = secret_scan.scan_text(text)[1]
    assert any(kind == "assign" and i < text.index(hidden) and j == text.index(hidden) + len(hidden) for kind, i, j in spans)
    assert hidden not in secret_scan.redact(text, spans)


@pytest.mark.parametrize(
    "text",
    [
        "q=caf%E9&password%3Dhunter2secret",
        "a=%00&password%3Dhunter2secret",
        "x " + base64.b64encode(SECRET.encode() + b"\0 \x1b[0m").decode(),
        "x " + base64.b64encode("déjà ".encode("latin-1") + SECRET.encode()).decode(),
        "x " + base64.b64encode(SECRET.encode("utf-16")).decode(),
        "x " + base64.b64encode(SECRET.encode("utf-16-be")).decode(),
        "x " + base64.b64encode(gzip.compress(b"\xff\0 " + SECRET.encode())).decode(),
        *(glue + base64.b64encode(SECRET.encode()).decode() for glue in ("a", "/x", "a-b", "_abc", "/abc_")),
        *("abcde"[:k] + base64.b64encode(gzip.compress(SECRET.encode())).decode() for k in range(1, 6)),
    ],
)
def test_bytes_that_are_no_text_hide_nothing(text):
    spans = secret_scan.scan_text(text)[1]
    assert any(kind == "assign" for kind, _, _ in spans)
    assert not secret_scan.scan_text(secret_scan.redact(text, spans))[1]


def test_prose_has_no_secrets(messy):
    rows = secret_scan.scan_secrets(messy).collect()
    hits = [r for r in rows if r["secrets"]["spans"]]
    assert [r["doc_id"] for r in hits] == [9]
    assert all(r["secrets"]["base_sha256"] == sha256(b"").hexdigest() for r in rows if r not in hits)


def test_redaction_keeps_rows_and_columns(messy, clashing, empty):
    out = secret_scan.redact_secrets(clashing)
    assert out.columns == clashing.columns and out.count() == messy.count()
    texts = {r["text"] for r in out.where("doc_id = 9").collect()}
    assert any("[secret]" in t and "hunter22x" not in t for t in texts)
    assert secret_scan.redact_secrets(empty).count() == 0
    assert secret_scan.scan_secrets(clashing).count() == messy.count()


def test_redact_joins_overlapping_spans():
    assert secret_scan.redact("abcdefghij", [("hex", 1, 4), ("assign", 2, 6), ("hex", 8, 10)], "#") == "a#gh#"


# -- pages

P = "Some paragraph of text that goes on for a while, with many words in it. " * 3


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("just text &lt;b&gt;", "just text <b>"),
        (f"<nav>menu</nav><article><h1>T</h1><p>{P}</p><p>Short.</p></article><footer>f</footer>", f"T {P}Short."),
        (f"<body><div id='cookie-notice'>{P}</div><div class=content><h1>T</h1><p>{P}<p>A&amp;B<ul><li>1<li>2</ul></div><div class=sidebar>{P}</div><div id=comments><p>{P}</p></div>", f"T {P}A&B 1 2"),
        (f"<main><p>{P}<form><input></form><aside>{P}</aside><section class=comments><article>{P}</article></section></main>", P.strip()),
        (f"<div class='with-sidebar'><article><p>{P}</p></article><div class=sidebar>z</div></div>", P.strip()),
        (f"<article><header><h1>T</h1><p>by me</p></header><p>{P}<div class='ad-box'>{P}</div><script>var t='</p>';</script><style>p{{}}</style></article>", f"T {P.strip()}"),
        ("<article><p>a\n\t b<br>c&nbsp;d <b>e</b>f</p></article>", "a b c d ef"),
        ("<![if x]><p>a<![endif]>", "a"),
    ],
)
def test_main_text(html, text):
    assert html_text.extract_text(html) == text.strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><div class=intro><p>{P}</p></div><div class=text>{f'<p>{P}</p>' * 12}</div></body>", P * 13),
        (f"<body><div><p>{P}</p></div><div><p>{P}</p></div><div class=sidebar>{P}</div><div>{f'<p>{P}</p>' * 30}</div></body>", P * 32),
        (f"<article>{f'<p>{P}</p>' * 9}</article>{('<div>' + '<i></i>' * 20 + 'x</div>') * 8}<article>{'<br>' * 90}<p>Short one.</p></article>", P * 9 + "Short one."),
        (f"<main><div><p>{P}</p></div><article>{f'<p>{P}</p>' * 3}</article></main>", P * 4),
    ],
)
def test_content_in_several_containers_stays(html, text):
    assert html_text.extract_text(html) == text.strip()


def test_any_markup_is_read():
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<div>", "</div>", "<b", ">", "<", "&", "&#x", "<!--", "-->", "<![", "<?", "<!D", '"', "x", " ", "<script>", "</script>", "<br/>", "</", "<article>", "</article>", "<td>", "<table>"]
    for _ in range(3000):
        html_text.extract_text("".join(rng.choices(bits, k=rng.randint(1, 25))))
    assert html_text.extract_text("<div>" * 20_000 + "x" + "</i>" * 20_000) == "x"


def test_smoothing_keeps_constants_and_threshold_finds_the_dense_lines():
    assert html_text.smoothed([3.0] * 9) == pytest.approx([3.0] * 9)
    lines = [("a", 5, 0)] * 6 + [("x" * 400, 1, 1)] * 4 + [("b", 5, 0)] * 6
    inside, core = html_text.clustered(lines)
    assert set(range(6, 10)) == set(core) <= set(inside) <= set(range(4, 12))


def test_ratios_kernel_and_threshold_equal_brute_force():
    rng = random.Random(12)
    for _ in range(60):
        lines = [("x" * rng.choice((1, 9, 80, 300)), rng.randint(0, 6), 0) for _ in range(rng.randint(1, 40))]
        sigma, share = rng.choice((0.5, 1.0, 2.5)), rng.choice((0.2, 0.5, 1.0))
        ratios = np.array([len(t) / max(1, n) for t, n, _ in lines])
        away = np.subtract.outer(np.arange(len(lines)), np.arange(len(lines)))
        kernel = np.where(abs(away) <= np.ceil(3 * sigma), np.exp(-(away**2) / (2 * sigma**2)), 0)
        smooth = kernel @ ratios / kernel.sum(axis=1)
        assert html_text.smoothed(ratios.tolist(), sigma) == pytest.approx(smooth.tolist())
        limit = share * smooth.std()
        clear = np.flatnonzero((abs(smooth - limit) > 1e-9) & (abs(ratios - limit) > 1e-9))
        inside, core = html_text.clustered(lines, sigma, share)
        assert set(clear) & set(inside) == set(clear) & set(np.flatnonzero(smooth >= limit))
        assert set(clear) & set(core) == set(clear) & set(np.flatnonzero((smooth >= limit) & (ratios >= limit)))


LINKS = "<div>" + "".join(f"<a href=/{k}><b>Go</b></a> <i>x</i> " for k in range(9)) + "</div>"
BODY = f"<p>{P}</p>" * 20
CLUSTERED = [
    (f"<body><article>Teaser on three words</article><div class=content>{BODY}</div></body>", P * 20),
    (f"<body>{LINKS}<div><h2>T</h2>{BODY}<p>Short.</p></div>{LINKS}</body>", "T " + P * 20 + "Short."),
    (f"<body><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul><h1>T</h1>{BODY}<ul><li>one<li>two</ul><ul><li><a href=/>Next</a></ul></body>", "T " + P * 20 + "one two"),
    (f"<body><div>{LINKS}<div><div><p>{P}</p></div><div>Between.</div><div>{BODY}</div></div></div>{LINKS}</body>", P + "Between. " + P * 20),
    (f"<main>Menu</main><table><tr><td>{LINKS}<td>{BODY}<tr><td>{LINKS}</table>", P * 20),
]


@pytest.mark.parametrize(("html", "text"), CLUSTERED)
def test_clusters_choose_the_region(html, text, monkeypatch):
    assert html_text.extract_text(html) == text.strip()
    every = lambda lines, *_: (list(range(len(lines))),) * 2
    monkeypatch.setattr(html_text, "clustered", every)
    assert html_text.extract_text(html) != text.strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><p>{P}</p><section class='share-price'>Up by 3</section><div class='comparison-form-factor'>Small</div><p>Use <span class='promo-code'>X1</span></p><section id='results-discussion'>It works</section></article>", f"{P}Up by 3 Small Use X1 It works"),
        (f"<article><div class='article-header'><h1>T</h1></div><p>{P}</p><div class='share-buttons'>Share</div><div class='cookie-notice top'>{P}</div><div id='postComments'>{P}</div><p class='no-comments'>End</p></article>", f"T {P}End"),
        (f"<form id=aspnet><nav>m</nav><div>{BODY}</div></form>", P * 20),
        (f"<p>{P}<!-- never closed > end", f"{P}end"),
        (f"<p>{P}<!--> a <!-- b > --> c <a href='", f"{P}a c"),
    ],
)
def test_marks_by_whole_names(html, text):
    assert html_text.extract_text(html) == text.strip()


@pytest.mark.parametrize("part", ["<!--", "<!-- x>", "<!-- --!", "<?", "<a ", "<a href=\"", "<a b='c", "<a/", "<a ==", "<script>", "</", "<div>", "<p>", "<form>", "<article>"])
def test_broken_markup_takes_linear_time(part):
    began = time.process_time()
    html_text.extract_text(part * 50_000)
    assert time.process_time() - began < 10


def test_pages_query_equals_the_articles(spark, sf):
    import html as H

    rows = QUERIES["op10_html_text"](spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        assert r["text"] == re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", " ", body))).strip()
        assert r["n_chars"] == len(r["text"])


def test_pages_table_of_any_kind(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "<p>a</p>", None), (1, None, "x")], "page_id long, html string, text string")
    assert sorted(r["text"] for r in html_text.extract_pages(df).collect()) == ["", "", "a"]
    assert html_text.extract_pages(df.limit(0)).count() == 0
