"""Packing, archives and text extraction."""

import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fieldstate.llm import html, packing, warc

from .data import documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_chunks_give_the_ids_of_the_whole_text():
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(11)
    texts = ["", " a", "a ", "a  b", "a \n b\n\n c  ", "it's  'tis x<|endoftext|> z", "\t a \t", "a\n b", "a \nb", "a\x1c \x1cb", "a\u00a0 b \u2003c"]
    texts += ["".join(rng.choice(" ab'\n\t.1é s") for _ in range(rng.randrange(30))) for _ in range(300)]
    for t, ids in zip(texts, packing.encoded(texts, PATH)):
        assert ids == np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def test_words_and_marks_are_those_of_the_tokenizer(monkeypatch):
    """Chunks of letters and marks go to the model directly; also when memory turns over at every call."""
    tok, rng = packing.tokenizer(PATH), random.Random(12)
    assert packing.takes_words(tok)
    pieces = ["a", "Zq", "é", "ñö", "ſ", "ß", "x\u00ad", "'s", "'", "...", "_", "!?", "<|", "|>", "endoftext", "\n", "\n\n", "\t", "7", "\u00d7", "Ж", "\u180e", "\x1c", " "]
    texts = [" ".join("".join(rng.choices(pieces, k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    texts += ["foo.\nBar, baz\nqux qu\u00e9.\nBar foo", "a <|endoftext|> b", "a " + "b" * 100 + ". c"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert packing.encoded(texts, PATH) == want
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    assert [packing.encoded([t], PATH)[0] for t in texts] == want
    calls = []
    monkeypatch.setattr(packing, "single_ids", lambda some, t: iter([calls.append(x) or b"" for x in some]))
    packing.encoded(["one two three, four.\nFive six"], PATH)
    assert " two" not in calls and " four.\nFive" not in calls



def check_packed(rows, texts, window):
    tok = Tokenizer.from_file(PATH)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in places.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding, len(places)


def test_packing(spark):
    docs = documents(12) + [(5000, "long text of many words " * 3000), (None, "null id")]
    padding, sequences = check_packed(packing.packed(frame(spark, docs), PATH).collect(), dict(docs), 2048)
    assert padding < 2048 and sequences > 10
    assert packing.packed(frame(spark, []), PATH).count() == 0
    assert packing.packed(frame(spark, [(1, "twice"), (1, "twice")]), PATH).count() == 2


def test_least_squares_and_plan():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((6, 9)), rng.random(6) * 10
        x = packing.nonnegative_least_squares(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-6).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-6
    histogram = {2048: 5, 1024: 700, **{32 * k: int(v) for k, v in enumerate(rng.integers(0, 900, 32)) if k}, **{k: 40 for k in range(1, 32)}}
    places = packing.plan(histogram, 2048)
    used, fill = Counter(), Counter()
    for (length, first, base, n, offset), after in zip(places, [*places[1:], None]):
        end = after[1] if after and after[0] == length else histogram[length]
        used[length] += end - first
        for r in range(end - first):
            fill[base + r // n] += length
    assert used == Counter({k: v for k, v in histogram.items() if v})
    assert max(fill.values()) <= 2048 and sum(2048 - v for v in fill.values()) < 0.005 * sum(fill.values())
    assert set(map(sum, packing.combinations())) == {64} and len(set(packing.combinations())) == len(packing.combinations())


def test_loser_tree():
    rng = random.Random(13)
    for _ in range(200):
        lists = [sorted(rng.randrange(30) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(9))]
        assert list(warc.LoserTree(lists)) == sorted(x for part in lists for x in part)


def test_archive_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>" * 10
    pages = [
        (1, "http://b.org/1", big), (2, "http://a.org/x?y", big), (3, None, big), (4, "http://a.org/x?y", "small"), (5, "u\r\nX: y", "small"), (6, "http://a.org", None),
        (7, "http://a.org", ""), (8, "http://a.org", "z" * 200), (None, "http://a.org", big), (8, "http://a.org", "z" * 200),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archived(df).collect()
    key = lambda r: (repr(r[0]), repr(r[1:]))
    least = {big: 1, "z" * 200: 8}
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        again = h in least and i is not None and i != least[h]
        want.append((i, len(data), sha256(data).hexdigest(), "revisit" if again else "response", least[h] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    by_position = sorted(got, key=lambda r: r.position)
    assert [r.position for r in by_position] == list(range(len(pages)))
    order = [(r.url_key, r.captured, r.page_id if r.page_id is not None else -1) for r in by_position]
    assert order == sorted(order) and order[-1][0].startswith("org,b)")
    assert warc.archived(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><aside>Side <p>bar</p></aside>
<article class="post"><h1>Title &amp; more</h1><p>One&nbsp;<b>bold</b>word<br>next
 line<p>Two &lt;x&gt; <!-- <p>hidden</p> --> end<div class="ad">Buy!</div><form><p>Mail</p></form><ul><li>a<li>b</ul>
<section id="comments"><p>First!</p></section><p>Last</article><footer>&copy; x</footer></body></html>"""


def test_blocks():
    assert [t for t, k in html.blocks(PAGE) if k == 1] == ["Title & more", "One boldword next line", "Two <x> end", "a", "b", "Last"]
    assert html.blocks("") == [] and html.blocks("a < b <") == [("a < b <", 2)]
    assert html.blocks("<p>x<script>never ends") == [("x", 2)]
    assert html.blocks("<" * 2000 + "p") == [("<" * 2000 + "p", 2)]


def test_repeats_of_a_host(spark):
    menu = "Home About us Contact Imprint Terms of use and privacy policy of this site"
    pages = [(k, f"http://h.org/{k}", f"<div>{menu}</div><p>Page{k} has words {k * 5} of its own {k * 7} only</p>") for k in range(6)]
    pages += [(10, "http://other.org/", f"<div>{menu}</div>"), (11, "http://h.org/a", PAGE), (12, None, None), (13, "http://h.org/b", ""), (None, "http://x.org", "<p>hi</p>")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, id long").repartition(3)
    got = {r.page_id: r for r in html.main_text(df).collect()}
    assert len(got) == len(pages)
    for k in range(6):
        assert menu not in got[k].text and got[k].text == f"Page{k} has words {k * 5} of its own {k * 7} only" and got[k].n_repeated >= len(menu.split())
    assert got[10].text == menu and got[12].text == got[13].text == "" and got[13].n_chars == 0
    assert got[11].text.split("\n") == ["Title & more", "One boldword next line", "Two <x> end", "a", "b", "Last"] and got[None].text == "hi"
    assert html.main_text(df.limit(0)).count() == 0


def test_hot_anchors_give_the_same(spark, monkeypatch):
    pages = [(k, "http://h.org/", f"<div>one two three four five six seven eight nine ten {k}</div><p>tail {k} " + "x y z " * k + "</p>") for k in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = sorted(map(tuple, html.main_text(df).collect()))
    from fieldstate.llm import anchors

    plain = anchors.Windows
    monkeypatch.setattr(html.A, "Windows", lambda *a, **k: plain(*a, hot=2, **k))
    assert sorted(map(tuple, html.main_text(df).collect())) == want


def test_copies_and_shared_passages_keep_their_text(spark):
    menu = "Home About us Contact Imprint Terms of use and privacy policy of this site"
    own = {k: " ".join(f"p{k}w{i}" for i in range(30)) for k in range(12)}
    passage = "a passage of ten words that two bodies have alike"
    body = {k: f"{own[k]} {passage}" if k in (4, 5) else own[k] for k in own}
    page = lambda k: f"<div>{menu}</div><p>{body[k]}</p>"
    pages = [(k, f"http://h.org/en/{k}", page(k)) for k in own]
    pages += [(100 + k, f"http://h.org/en/7?page={k}", page(7)) for k in range(9)]  # copies of one body
    pages += [(200 + k, f"http://one.org/{k}", page(3)) for k in range(4)]  # a host of one page
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    want = {k: body[k] for k in own} | {100 + k: body[7] for k in range(9)} | {200 + k: f"{menu}\n{body[3]}" for k in range(4)}
    assert got == want
