"""Main text, WARC archives, chat windows and personal data."""

import hashlib
import re
from collections import Counter, defaultdict
from html import unescape

import pytest
from pyspark.sql import functions as F

from twinsift.llm import chat, main_text, personal_data, queries, warc

SF = "/root/testdata/sf0.001"


# ---- main text ----------------------------------------------------------------------------


def article_of(html):
    """The article of the given pages, by cutting markup with expressions."""
    inside = html.split("<article>", 1)[1]
    inside = re.split(r"</article>|<footer", inside)[0]
    blocks = re.split(r"</?(?:p|h1|div|ul|li)>", inside)
    texts = (" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks)
    return " ".join(t for t in texts if t)


def test_main_text_of_given_pages(spark):
    want = {r.page_id: article_of(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op1_main_text(spark, SF).collect()}
    assert got == {page: (text, len(text)) for page, text in want.items()}


P1 = "The council met on Monday, and after a long debate, members agreed on the plan for the river bank."
P2 = "Work will begin in spring, said the mayor, who had asked for it twice, and the costs are shared by all."
P3 = "Short end."

LAYOUTS = {
    "divisions": (f"""<html><body><div id=header>Site name <a href=/>home</a></div><div class="menu">One Two</div>
<div class='cookie-notice'>We use cookies, many of them, really a lot of them, please accept them all now.</div>
<div id="content"><h2>Title</h2><p>{P1}</p><p>{P2}</p><p>{P3}</p></div>
<div class=sidebar><p>Other news, more news, and news again, from all over the wide and distant world.</p></div>
<div id="comments"><p>I think, as a reader, that this is wrong, wrong, wrong, and badly written, too.</p></div>
<form><p>Write to us, if you like, about whatever you like, whenever you like it, please.</p></form>
<div id=footer>Copyright</div></body></html>""", f"Title {P1} {P2} {P3}"),
    "nested sections": (f"""<body><main><section><h2>A</h2><p>{P1}</p></section><section><h2>B</h2><p>{P2}</p></section>
<section class="related"><p>{P1}</p></section><aside><p>{P2}</p></aside></main><footer>{P1}</footer>""", f"A {P1} B {P2}"),
    "article with lists": (f"""<article><header><h1>T</h1></header><p>{P1}<ul><li>one<li>two</ul><blockquote>{P3}</blockquote>
<table><tr><td>a<td>b</table><pre>x
  y</pre><section id=comments><p>{P2}</p></section></article>""", f"T {P1} one two {P3} a b x y"),
    "unclosed": (f"<body><nav><a href=x>m</a></nav><div class=post><p><b>{P1}<br><p>{P2}<p>{P3}", f"{P1} {P2} {P3}"),
    "references": (f"<article><p>a &lt;b&gt; &amp;amp; &#233; &#x41; caf&eacute;\n\t x&nbsp;y</p><p>{P1}</p></article>",
                   f"a <b> &amp; é A café x y {P1}"),
    "code in scripts": (f"<article><script>if (a<b) document.write('</p><p>no</p>')</script><style>p{{}}</style><p>{P1}</p>"
                        f"<!-- <p>no</p> --><p>1 < 2</p></article>", f"{P1} 1 < 2"),
    "adverts inside": (f"<article><p>{P1}</p><div class='ad-slot'><div>Buy</div></div><p>{P2}</p></article>", f"{P1} {P2}"),
    "inline markup": ("<article><p>un<b>bro</b>ken <a href='a>b'>link</a></p><p>x</p></article>", "unbroken link x"),
    "hidden": (f"<div><p>{P1}</p><p hidden>{P2}</p><p style='display: none'>{P2}</p></div>", P1),
    "blog theme": (f"""<body class="single post-template"><header class=site-header><h1>Blog</h1></header><div id=page class=site>
<main id=main><article id=post-1 class="post type-post comments-open"><header class=entry-header><h1>T</h1></header>
<div class=entry-content><p>{P1}</p><p>{P2}</p></div><footer class=entry-footer>Posted</footer></article>
<div id=comments><ol class=comment-list><li><article class=comment-body><p>{P1} {P2}, {P1}</p></article></ol></div></main>
<aside class=widget-area><p>{P2}</p></aside></div>""", f"T {P1} {P2}"),
    "table page": (f"<body><table><tr><td><a href=1>menu</a><td>{P1}<br><br>{P2}<br>Bye.</table>", f"{P1} {P2} Bye."),
    "more comments than text": (f"<body><div class=article><p>{P1}</p></div><div id=disqus_thread>"
                                + f"<div class=comment><p>{P2}</p></div>" * 10 + "</div>", P1),
    "nothing": ("", ""),
    "words only": ("just words", "just words"),
    "menu only": ("<body><nav>a b</nav></body>", ""),
}


FIVE = "".join(f"<p>{p}</p>" for p in (P1, P2, P1, P2, P1))
FIVE_TEXT = f"{P1} {P2} {P1} {P2} {P1}"

LAYOUTS |= {
    "short last section": (f"<div id=content><div class=part>{FIVE}</div><div class=part><p>{P3}</p></div></div>", f"{FIVE_TEXT} {P3}"),
    "short last section in rows": (f"""<main><div class=row><div class=col>{FIVE}</div></div>
<div class=row><div class=col><p>{P3}</p></div></div></main>""", f"{FIVE_TEXT} {P3}"),
    "short closing paragraph": (f"<body><div class=a><div class=b>{FIVE}</div><p>{P3}</p></div>", f"{FIVE_TEXT} {P3}"),
    "short section without names": (f"<body><div><div>{FIVE}</div><div><p>{P3}</p></div></div>", f"{FIVE_TEXT} {P3}"),
    "text beside the best part": (f"<div id=content>Before <i>it</i> all.<div class=part>{FIVE}</div>After <b>it</b> all.<br>End</div>",
                                  f"Before it all. {FIVE_TEXT} After it all. End"),
    "a closing line with a link": (f"<div id=content><div class=part>{FIVE}</div><p>See <a href=x>the full report</a></p></div>",
                                   f"{FIVE_TEXT} See the full report"),
    "links beside the best part": (f"""<div id=content><div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class=part>{FIVE}</div>
<div><a href=3>Next page</a></div></div>""", FIVE_TEXT),
    "inline wrapper of blocks": (f"<body><div><div>{FIVE}</div><font><div>{FIVE}</div></font></div>", f"{FIVE_TEXT} {FIVE_TEXT}"),
    "links without names": (f"<div><ul><li><a href=1>One</a></ul><div>{FIVE}</div><a href=3>Next page</a><p>{P3}</p></div>",
                            f"{FIVE_TEXT} {P3}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_of_layouts(name):
    html, want = LAYOUTS[name]
    assert main_text.main_text(html) == want


LONG = "A long paragraph, with commas, that says something of interest to the reader. " * 4
P = f"<p>{LONG}</p>"


@pytest.mark.parametrize("html,paragraphs", [
    (f"<article>{P}<section class='search'>{P}</section><div id='related-work'>{P}</div></article>", 3),
    (f"<body><div class='form-guide'>{P}</div></body>", 1),
    (f"<main><article>{P}</article><article>{P}{P}</article><article class='teaser'><a href=x>{LONG}</a></article></main>", 3),
    (f"<article>{P}<div class='related'><a href=x>one link here</a> <a href=y>another link</a></div></article>", 1),
    (f"<article>{P}<div class='related'>Short.</div><div class='site-footer'>{P}</div><div class='comments'>{P}</div></article>", 1),
    (f"<article>{P}<div class='notice'>{P}</div><div class='cookie-notice'>{P}</div></article>", 1),
])
def test_ambiguous_names_only_weigh(html, paragraphs):
    assert main_text.main_text(html) == " ".join([LONG.strip()] * paragraphs)


def test_ambiguous_headings_and_paragraphs_stay():
    html = f"<article><h2 class='toc-title'>Head</h2>{P}<p class='copyright-law'>Short law.</p></article>"
    assert main_text.main_text(html) == f"Head {LONG.strip()} Short law."


def test_deep_nesting_is_linear():
    import time

    start = time.time()
    assert main_text.main_text("<div>" * 50_000 + LONG + "</div>" * 50_000) == LONG.strip()
    assert time.time() - start < 20


def test_main_text_edge_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<p>" + "long, " * 50_000), (3, "v", "<" * 20_000),
            (4, "v", "<p a='" * 2_000), (5, "v", "<div>" * 3_000 + P1), (6, "v", "<script>" + "x" * 1000)]
    frame = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    got = main_text.extract(frame).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((p, u) for p, u, _ in rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[2] == texts[6] == "" and texts[5] == P1 and len(texts[None]) == 50_000 * 6 - 1
    assert main_text.extract(frame.limit(0)).count() == 0


# ---- WARC ---------------------------------------------------------------------------------


def expected_records(rows):
    """{page_id: (bytes, digest, type, refers_to)} with unique ids."""
    groups = defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    found = {}
    for payload, ids in groups.items():
        for page in ids:
            revisit = len(payload) >= 1000 and page != max(ids)
            found[page] = (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response",
                           max(ids) if revisit else None)
    return found


def archived(frame, path, **options):
    warc.write_archive(frame, path, **options)
    return warc.read_pages(frame.sparkSession, path)


def test_warc_of_given_pages(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = queries.op10_warc(spark, SF).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == expected_records(rows) and len(got) == len(rows)


def test_warc_round_trip_of_awkward_payloads(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "x" * 999), (4, "x" * 999), (5, "y" * 1000), (6, "y" * 1000), (7, "y" * 1000),
            (8, "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 900), (9, "é\r\n\r\nWARC/1.1\r\n\0" * 10), (10, "ü" * 40_000),
            (11, "WARC/1.0\r\n" + "0\r\n\r\n" * 300)]
    frame = spark.createDataFrame([(p, f"http://a/{p}", h, 0) for p, h in rows], "page_id long, url string, html string, refers_to int")
    got = archived(frame, f"{tmp_path}/a", segment=500, records_per_file=3).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected_records(rows)
    for r in got:
        if r.record_type == "response":
            assert bytes(r.payload).decode() == (dict(rows)[r.page_id] or "") and r.url == f"http://a/{r.page_id}"
    assert archived(frame.limit(0), f"{tmp_path}/none").count() == 0


def test_warc_of_repeated_rows_and_nulls(spark, tmp_path):
    page = "z" * 2000
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "a\r\nb", page), (None, None, None)]
    got = archived(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/a").collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([
        (1, "revisit", 2), (1, "revisit", 2), (None, "revisit", 2), (2, "response", None), (None, "response", None)])
    assert {r.url for r in got} == {"u", None, "a%0D%0Ab"}


def record(fields, block):
    lines = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": len(block)}.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Segments in any order, gaps, wrong totals, chunk extensions, and a version line inside a payload."""
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n"
    block = http + b"4;x=1\r\nWiki\r\n5\r\npedia\r\n0\r\nTrailer: 1\r\n\r\n"
    part = [block[:20], block[20:50], block[50:]]

    def segment(origin, number, body, total=None):
        fields = {"WARC-Type": "continuation" if number > 1 else "response", "WARC-Segment-Number": number,
                  "WARC-Record-ID": origin if number == 1 else f"{origin}-{number}"}
        if number > 1:
            fields["WARC-Segment-Origin-ID"] = origin
        return record(fields | ({"WARC-Segment-Total-Length": total} if total else {}), body)

    plain = b"HTTP/1.0 200 OK\r\n\r\nbefore WARC/1.1\r\nafter"
    one = b"".join([
        record({"WARC-Type": "warcinfo", "WARC-Record-ID": "i"}, b"software: x\r\n"),
        segment("a", 3, part[2], len(block)), segment("a", 1, part[0]), segment("b", 1, part[0]),
        record({"WARC-Type": "response", "WARC-Record-ID": "p"}, plain)])
    two = b"".join([segment("a", 2, part[1]), segment("a", 2, part[1]), segment("b", 3, part[2], len(block)),
                    segment("c", 1, part[0]), segment("c", 2, block[20:], 7)])
    (tmp_path / "one.warc").write_bytes(one)
    (tmp_path / "two.warc").write_bytes(two)
    got = {r.id: r for r in warc.reassemble(warc.read_records(spark, str(tmp_path))).select(
        F.col("fields")["warc-record-id"].alias("id"), "payload", "complete").collect()}
    assert set(got) == {"i", "a", "b", "c", "p"}
    assert got["a"].complete and bytes(got["a"].payload) == b"Wikipedia"
    assert not got["b"].complete and got["b"].payload is None and not got["c"].complete
    assert bytes(got["p"].payload) == b"before WARC/1.1\r\nafter"


def cut_record(name, block, missing):
    return record({"WARC-Type": "response", "WARC-Record-ID": name}, block + b"x" * missing)[:-missing - 4]


def read_all(spark, folder):
    return Counter((r.id, r.complete, None if r.payload is None else bytes(r.payload)) for r in warc.reassemble(
        warc.read_records(spark, str(folder))).select(F.col("fields")["warc-record-id"].alias("id"), "complete", "payload").collect())


def test_truncated_records_do_not_swallow_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"

    def whole(name, body):
        return record({"WARC-Type": "response", "WARC-Record-ID": name}, http + body)

    parts = [whole("a", b"A"), cut_record("b", http + b"B", 90), whole("c", b"C"), whole("d", b"D" * 500)]
    (tmp_path / "one.warc").write_bytes(b"".join(parts))
    (tmp_path / "two.warc").write_bytes(whole("e", b"E") + cut_record("f", http, 5000) + cut_record("g", http, 9000))
    (tmp_path / "three.warc").write_bytes(
        whole("h", b"H") + b"WARC/1.1\r\nWARC-Record-ID: i\r\nContent-Length: 99999999999999999999\r\n\r\nI" + whole("j", b"J")
        + whole("k", whole("inside", b"K")))
    assert read_all(spark, tmp_path) == Counter([
        ("a", True, b"A"), ("b", False, None), ("c", True, b"C"), ("d", True, b"D" * 500), ("e", True, b"E"),
        ("f", False, None), ("g", False, None), ("h", True, b"H"), ("i", False, None), ("j", True, b"J"),
        ("k", True, whole("inside", b"K"))])


def test_many_truncated_records(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(cut_record(str(i), b"x", 700) for i in range(3000)))
    assert read_all(spark, tmp_path) == Counter({(str(i), False, None): 1 for i in range(3000)})


def test_continuations_without_a_first_segment(spark, tmp_path):
    fields = {"WARC-Type": "continuation", "WARC-Segment-Origin-ID": "gone"}
    (tmp_path / "a.warc").write_bytes(b"".join(
        record(fields | {"WARC-Record-ID": f"s{n}", "WARC-Segment-Number": n}, b"x") for n in (3, 2, "?")))
    assert read_all(spark, tmp_path) == Counter([("s?", False, None)])


def test_revisits_take_what_their_response_has(spark):
    pages = spark.createDataFrame(
        [(1, 5, "d", "response", None), (2, 99, "d", "revisit", 1), (3, 7, "e", "response", None)],
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    assert {r.page_id: r.payload_bytes for r in warc.resolve_revisits(pages).collect()} == {1: 5, 2: 5, 3: 7}
    with pytest.raises(Exception, match="no response for the revisit of page 1"):
        warc.resolve_revisits(pages.where("page_id <> 1")).collect()


def test_damaged_archive_is_an_error(spark, tmp_path):
    fields = {"WARC-Type": "response", "WARC-Record-ID": "x", "WARC-Payload-Digest": "sha1:00"}
    (tmp_path / "a.warc").write_bytes(record(fields, b"HTTP/1.1 200 OK\r\n\r\nbody"))
    with pytest.raises(Exception, match="damaged record x"):
        warc.read_pages(spark, str(tmp_path)).collect()


# ---- chat ---------------------------------------------------------------------------------


def expected_digests(rows):
    """{conv_id: (n_turns, turns hash, loss chars, loss hash)} of (conv_id, turn, role, text)."""
    found = {}
    by_id = defaultdict(list)
    for conv, turn, role, text in rows:
        by_id[conv].append((turn is None, turn or 0, role or "", text or ""))
    for conv, turns in by_id.items():
        turns.sort()
        everything = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        found[conv] = (len(turns), hashlib.sha256(everything.encode()).hexdigest(), len(loss),
                       hashlib.sha256(loss.encode()).hexdigest())
    return found


def read_back(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}


def test_chat_of_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    intruder = [(-7, i, role, r"\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]
    assert read_back(queries.op3_chat(spark, SF)) == expected_digests(rows + intruder)


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(1, 0, "system", "Be kind."), *[(1, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 40)) for i in range(1, 300)]]
    rows += [(2, 0, "user", None), (2, 1, None, ""), (2, None, "assistant", "late"), (3, 0, "assistant", "x " * 9000),
             (3, 1, "assistant", "tail"), (None, 0, "a: b#", "\\ ### </turn>\n### x: "), (4, 1, "user", "same"), (4, 1, "user", "same"),
             (5, 0, "system", "only")]
    return rows, spark.createDataFrame([(*r, "w") for r in rows], "conv_id long, turn long, role string, text string, window string")


def test_chat_windows_hold_every_turn_once(talks):
    rows, frame = talks
    assert read_back(chat.digests(chat.windows(frame))) == expected_digests(rows)
    assert chat.digests(chat.windows(frame.limit(0))).count() == 0


def test_chat_windows_keep_to_the_budget(talks):
    rows, frame = talks
    made = sorted(chat.windows(frame, window=600, history=150).where("conv_id = 1").collect(), key=lambda r: r.window)
    assert len(made) > 10 and all(r.tokens <= 600 for r in made)
    order = [chat.read_turns(r.text) for r in made]
    assert all(turns[0] == ("system", "Be kind.") for turns in order)
    repeats = 0
    for before, after, row in zip(order, order[1:], made[1:]):
        again = chat.read_turns(row.text[:row.repeat_chars])[1:]
        repeats += len(again)
        assert again == before[len(before) - len(again):] or not again
        assert all(span.start >= row.repeat_chars for span in row.loss)
    assert repeats > 5


def test_chat_escapes_are_reversible():
    for text in ("", "\\", "#<\\", "### a: b </turn>\n", "\\### Assistant: </turn> ok", "\\\\<#"):
        assert chat.unescape(chat.escape(text)) == text
        for role in ("user", "a: b", "\\", "#", ""):
            assert chat.read_turns(chat.written(role, text) * 2) == [(role, text)] * 2


# ---- personal data ------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [d if i % 2 == 0 else 2 * d for i, d in enumerate(map(int, reversed(digits)))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[1], personal_data.KINDS.index(s[0])))


def test_personal_data_of_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    total = 0
    for r in queries.op4_personal_data(spark, folder).collect():
        want = base_spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in personal_data.KINDS]
        assert r.spans == listed  # no disguises in these texts
        total += len(want)
    assert total > 50


PARTS = ["a", "Z", "9", "0", "255", "256", "1.2.3.4", ".", "..", "@", "+", "-", " ", "(", ")", "x.y", "4111 1111 1111 1111",
         "+1 (555) 010-9999", "a@b.c", "%", "\n", "é", "1.1.1.1.1.1.1.1.1"]


def test_base_spans_of_random_texts():
    import random

    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14)))
        found = sorted(personal_data.plain(text), key=lambda s: (s[1], personal_data.KINDS.index(s[0])))
        assert found == base_spans(text), text


DISGUISES = [
    ("mail foo.bar (at) mail2 [dot] example dot com now", "email", "foo.bar (at) mail2 [dot] example dot com"),
    ("x thw.68 at mail2.example.com y", "email", "thw.68 at mail2.example.com"),
    ("foo at bar dot com", "email", "foo at bar dot com"),
    ("user[@]ex[.]com!", "email", "user[@]ex[.]com"),
    ("schreib an eva @ haus punkt de bitte".replace(" @ ", " [at] "), "email", "eva [at] haus punkt de"),
    ("to аdmin@exаmple.com.", "email", "аdmin@exаmple.com"),
    ("j​oe@example.com", "email", "j​oe@example.com"),
    ("ring +１ (５６４) 555-4526 ok", "phone", "+１ (５６４) 555-4526"),
    ("call plus one five five five oh one two three four five now", "phone", "plus one five five five oh one two three four five"),
    ("card four-one-one-one 1111 1111 1111", "card", "four-one-one-one 1111 1111 1111"),
    ("at one nine two dot one six eight dot zero dot one.", "ip", "one nine two dot one six eight dot zero dot one"),
    ("IP ١٩٢.168.0.1", "ip", "١٩٢.168.0.1"),
]


@pytest.mark.parametrize("text,kind,want", DISGUISES)
def test_disguises_are_found_where_they_stand(text, kind, want):
    found = [(k, text[a:b]) for k, a, b, added in personal_data.personal_data(text) if added]
    assert found == [(kind, want)]


@pytest.mark.parametrize("text", [
    "Look at example.com for one or two of the three dots.", "He arrived at noon. Dot by dot, it went on.",
    "un deux trois", "meet me at home dot", "(at) the end", "кот и дом", "one, two, three, four", "a < b at c > d", "", "@", "+"])
def test_clean_texts_stay_clean(text):
    assert personal_data.personal_data(text) == []


@pytest.mark.parametrize("word", ["jane.doe", "j_smith", "john2b", "jean-luc", "a+news", "u.s.r", "und.34", "x%y"])
@pytest.mark.parametrize("sign", ["at", "AT", "arroba", "chez"])
def test_a_sign_anywhere_in_the_word_makes_a_bare_at(word, sign):
    text = f"Write to {word} {sign} mail.example.com today"
    assert personal_data.personal_data(text) == [("email", 9, 9 + len(f"{word} {sign} mail.example.com"), True)]


@pytest.mark.parametrize("text", [
    "It is sold at example.com only.", "the 3rd. at example.com", "Mr. at example.com", "x.y, at example.com", "a.b or c at example.com",
    "j.d    at example.com", "... at example.com", "at example.com"])
def test_a_word_without_a_sign_leaves_a_bare_at(text):
    assert personal_data.personal_data(text) == []


def test_signed_words_are_read_once():
    import time

    start = time.time()
    for text in ("a.b at c.d " * 50_000, "a at c.d " * 50_000, "a" * 500_000 + " at c.d" * 50_000, "." * 500_000 + "a at c.d"):
        personal_data.personal_data(text)
    assert time.time() - start < 20


def test_searches_are_linear():
    import time

    start = time.time()
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 200_000, "a@" * 100_000, "+1 " * 70_000, " at " * 50_000,
                 "one " * 50_000, "(" * 200_000, "а" * 200_000):
        personal_data.personal_data(text)
    assert time.time() - start < 20


def test_long_numbers_and_many_spans():
    import time

    text = "x " + "0" * 5000 + ".1.1.1 y " + "9" * 5000 + ".1.1.1 z"
    assert personal_data.personal_data(text) == [("ip", 2, 5008, False)]
    start = time.time()
    for part in ("u%d@mail.example ", "u%d at mail dot example ", "10.0.%d.7 ", "u%d@mail.example u%d at mail dot example "):
        personal_data.personal_data("".join(part.replace("%d", str(i % 250)) for i in range(20_000)))
    assert time.time() - start < 20


def test_personal_data_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (None, "1.2.3.4")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    got = Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in personal_data.find_personal_data(frame).collect())
    assert got == Counter([(1, ()), (2, ()), (3, (("email", 0, 6, False),)), (3, (("email", 0, 6, False),)),
                           (None, (("ip", 0, 7, False),))])
    assert personal_data.find_personal_data(frame.limit(0)).count() == 0
