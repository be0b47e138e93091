"""HTML extraction and WARC archives."""

import gzip
import random

import pyarrow.fs as pafs
import pytest

from millrace.llm import html_text, warc
from millrace.session import scratch_path

PAGES = "page_id long, url string, html string, text string"


def texts(spark, rows):
    return {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame([(*r, "clash") for r in rows], PAGES)).collect()}


def test_article_is_found_and_the_rest_left_out(spark):
    html = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li>Menu</ul></nav><!-- <p>no</p> -->"
        '<div class="ad">Buy</div><article><header><h1>Big &amp; <i>bold</i></h1></header><p>One\n  two&nbsp;three<br>four<p>Five &lt;six&gt; &#233;<div class="related">More</div>'
        '<form><p>no</form></article><section id="comments"><p>Me too</section><footer>&copy; x</footer></body></html>'
    )
    rows = [(1, "http://h.example/a", html), (2, None, None), (3, "http://h.example/b", ""), (4, "x", "plain &amp; text"), (5, "x", "<p>open <b>bold<p>next"), (6, "x", "<<>< a &#x110000; <div")]
    got = texts(spark, rows)
    assert got[1] == "Big & bold\n\nOne two three four\n\nFive <six> é"
    assert got[2] == got[3] == "" and got[4] == "plain & text" and got[5] == "open bold\n\nnext" and len(got) == 6


def test_templates_find_the_slot_without_article_elements(spark):
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=40))
    rows, expected = [], {}
    for i in range(12):
        a, b = prose(), prose()
        rows.append((i, f"https://site.example/{i}", f"<body><div class=top><p>Site name<p>Welcome to the site</div><div class=x1><p>{a}</p><p>{b}</p></div><div class=low><p>All our pages</p></div></body>"))
        expected[i] = f"{a}\n\n{b}"
    assert texts(spark, rows) == expected


def test_repeated_articles_stay_whole(spark):
    html = "<body><article><p>Same words on every page</p></article></body>"
    assert set(texts(spark, [(i, "http://h.example/", html) for i in range(9)]).values()) == {"Same words on every page"}


def test_template_decides_pages_with_an_article(spark):
    """Text that a host repeats inside article or main goes; copied articles and articles beside a teaser card do not."""
    own = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(8)]
    share, card = "<p>Send this page to a friend</p>", "<article><p>Read more</p></article>"
    rows = [(i, f"http://a.example/{i}", f"<body><article><h1>Title {i}</h1><p>{t}</p>{share}</article></body>") for i, t in enumerate(own)]
    rows += [(10 + i, f"http://b.example/{i}", f"<body><main><p>{t}</p>{share}</main></body>") for i, t in enumerate([own[0]] * 5 + own[1:4])]
    rows += [(20 + i, f"http://c.example/{i}", f"<body><div class=x1><p>{t}</p></div>{card.replace('more', f'more {i}')}</body>") for i, t in enumerate(own)]
    got = texts(spark, rows)
    assert [got[i] for i in range(8)] == [f"Title {i}\n\n{t}" for i, t in enumerate(own)]
    assert [got[10 + i] for i in range(8)] == [f"{own[0]}\n\nSend this page to a friend"] * 5 + own[1:4]
    assert all(own[i] in got[20 + i] for i in range(8))


def brute_texts(pages):
    """The template of one host by definition, all pages in memory: vectors as tuples, spans compared pair by pair."""
    from itertools import combinations

    read = [html_text.read_page(h) for h in pages]
    seqs = [t for t, _ in read]
    vectors = {}
    for t in {t for s in seqs for t in s}:
        v = tuple(s.count(t) for s in seqs)
        if sum(n > 0 for n in v) >= max(4, len(pages) / 2):
            mean = sum(s.index(t) for s in seqs if t in s) / sum(n > 0 for n in v)
            vectors.setdefault(v, []).append((mean, html_text._id(t), t))
    classes = [[t for *_, t in sorted(ts)] for ts in vectors.values()]
    support = lambda c: sum(c[0] in s for s in seqs)
    classes.sort(key=lambda c: (-support(c), -len(c), [html_text._id(t) for t in c]))
    bad, gone, where = set(), set(), {}
    for s in seqs:
        valid = []
        for k, c in enumerate(classes):
            if c[0] not in s:
                continue
            rounds = list(zip(*([i for i, x in enumerate(s) if x == t] for t in c), strict=True))
            out = set()
            for r in rounds:  # the largest set of tokens in order, the first one by rank
                best = next(x for m in range(len(c), 0, -1) for x in combinations(range(len(c)), m) if all(r[a] < r[b] for a, b in zip(x, x[1:])))
                out |= set(range(len(c))) - set(best)
            gone |= {(k, c[r]) for r in out}
            spans = [[r[x] for x in range(len(c)) if x not in out] for r in rounds]
            crossing = any(a[-1] > b[0] for a, b in zip(spans, spans[1:]))
            inside = [("root",)] * len(spans)
            for f, others in valid:
                for a, span in enumerate(spans):
                    for o in others:
                        gaps = {sum(i > x for x in o) for i in span}
                        held = any(0 < g < len(o) for g in gaps)
                        crossing |= held and len(gaps) > 1
                        if held and len(gaps) == 1 and (inside[a] == ("root",) or o[0] > inside[a][0]):
                            inside[a] = (o[0], f, gaps.pop())
            if crossing:
                bad.add(k)
                continue
            where.setdefault(k, set()).update(x[1:] for x in inside)
            if len(spans[0]) > 1:
                valid.append((k, spans))
    template = {t for k, c in enumerate(classes) if k not in bad and len(where[k]) == 1 for t in c if (k, t) not in gone}
    chosen = [[b for b in blocks if not b.left_out] for _, blocks in read]
    all_tokens = {t for c in classes for t in c}
    if not any(f"={b.path}={b.text}" not in all_tokens for blocks in chosen for b in blocks):
        template = set()
    out = []
    for blocks in chosen:
        kept = [b for b in blocks if f"={b.path}={b.text}" not in template]
        article = sum(len(b.text) for b in blocks if b.article)
        copied = 2 * sum(len(b.text) for b in kept if b.article) < article
        out.append("\n\n".join(b.text for b in blocks if b in kept or (copied and b.article)))
    return out


def host_pages(rng, i):
    """A host with its own chrome, with or without an article, lines that repeat in place or out of place."""
    words = [f"h{i}w{k}" for k in range(60)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    top, low, refrain, note = prose(3), prose(4), prose(5), prose(6)
    tag = ["article", "div class=b1", "main"][i % 3]
    pages = []
    for _ in range(rng.randint(4, 9)):
        parts = [f"<p>{prose(rng.randint(5, 30))}</p>" for _ in range(rng.randint(1, 5))]
        if i % 2:
            parts.insert(rng.randint(0, len(parts)), f"<p>{refrain}</p>")
        if rng.random() < 0.7:
            parts.append(f"<ul><li>{prose(4)}<li>{prose(3)}</ul>")
        body = "".join(parts)
        if i % 4 == 2:  # two lines of the template that change places, and a second content container
            a, b = rng.sample([f"<h5>{note}</h5>", f"<h6>{low}</h6>"], 2)
            body = f"{a}{body}{b}</{tag.split()[0]}><section><p>{prose(9)}</p></section><{tag}>"
        rows = "".join(f"<tr><td>Name<td>{prose(2)}" for _ in range(rng.randint(1, 3))) if i % 5 == 3 else ""
        table = f"<table>{rows}</table>" if rows else ""
        pages.append(f"<body><div class=t{i}><p>{top}</p><p>Welcome</p></div><{tag}>{body}</{tag.split()[0]}>{table}<div class=l{i}>{low}</div></body>")
    return pages


def test_templates_equal_brute_force(spark):
    rng = random.Random(21)
    hosts = [host_pages(rng, i) for i in range(20)]
    rows = [(100 * i + k, f"http://n{i}.example/{k}", html) for i, pages in enumerate(hosts) for k, html in enumerate(pages)]
    got = texts(spark, rows)
    plain = 0
    for i, pages in enumerate(hosts):
        expected = brute_texts(pages)
        assert [got[100 * i + k] for k in range(len(pages))] == expected, i
        # without its classes the template would leave other text
        plain += expected != ["\n\n".join(b.text for b in html_text.read_page(h)[1] if not b.left_out) for h in pages]
    assert plain == 20


def test_order_and_nesting_decide():
    classes = [["a", "b", "c", "d"], ["x", "y"]]
    number = {t: i for i, t in enumerate("abcdxyz")}
    ids = [[number[t] for t in c] for c in classes]
    check = lambda text: html_text.check_page([number[t] for t in text], ids)
    assert check("azbxycxyd") == (set(), set(), {0: {html_text.ROOT}, 1: {2, 3}})  # two gaps: no valid class
    assert check("abxyzxycd")[2][1] == {2} and check("xyabcd")[2][1] == {html_text.ROOT}
    assert check("abxcyd")[1] == {1}  # spans cross: the weaker class
    assert check("abxxyycd")[1] == {1} and check("axbycd")[1] == {1}
    assert check("bcad")[0] == {(0, 0)} and check("dabc")[0] == {(0, 3)} and check("badc")[0] == {(0, 1), (0, 3)}
    assert html_text.longest_in_order([3, 1, 2, 0]) == {1, 2} and html_text.longest_in_order([1, 0, 3, 2]) == {0, 2}


def test_article_text_stays(spark):
    html = "<article><p>before <math><mi>x</mi><mo>=</mo><mn>2</mn></math> after <script>no()</script>all</p><fieldset><legend>Quiz</legend><p>one</p><label>two</label></fieldset><figure><figcaption>Shown</figcaption></figure></article><p>outside"
    assert texts(spark, [(1, "http://m.example/", html)])[1] == "before x=2 after all\n\nQuiz\n\none\n\ntwo\n\nShown"
    card = "<article><p>teaser</p></article><div class=x1><p>The body of the page stands outside of it</p></div>"
    assert texts(spark, [(1, "http://m.example/", card)])[1] == "teaser\n\nThe body of the page stands outside of it"


def test_menus_are_elements_of_links(spark):
    rows = [(i, f"http://l.example/{i}", f"<body><ul class=k>{''.join(f'<li><a href=/>to {i} {k}</a>' for k in range(4))}</ul><div class=x><p>own {i} <a href=/>one link {i}</a></p></div></body>") for i in range(6)]
    assert texts(spark, rows) == {i: f"own {i} one link {i}" for i in range(6)}


def test_all_slots_are_kept(spark):
    """Headings, lists, quotes, cells and a second container stay, and as much of a page for a large host as for a small."""
    prose = lambda i, k, n: " ".join(f"w{i}x{k}x{j}" for j in range(n))
    parts = [[f"Head {i}", prose(i, 0, 60), prose(i, 1, 15), prose(i, 2, 18), prose(i, 3, 9), prose(i, 4, 5), prose(i, 5, 40)] for i in range(8)]
    page = "<body><div class=top><p>Site name</div><div class=post><h1>{}</h1><p>{}</p><ul><li>{}<li>{}</ul><blockquote>{}</blockquote><table><tr><td>{}</td></tr></table></div><div class=more><p>{}</p></div></body>"
    rows = [(i, f"http://large.example/{i}", page.format(*x)) for i, x in enumerate(parts)]
    rows += [(10 + i, f"http://small.example/{i}", page.format(*x).replace("<p>Site name", "")) for i, x in enumerate(parts[:2])]
    got = texts(spark, rows)
    assert [got[i] for i in range(8)] == ["\n\n".join(x) for x in parts]
    assert [got[10], got[11]] == [got[0], got[1]]


def test_long_page_repeated_rows_and_empty_table(spark):
    html = "<article>" + "<p>word " * 30_000 + "</article>"
    df = spark.createDataFrame([(1, "u", html, ""), (1, "u", html, "")], PAGES)
    got = html_text.extract_text(df).collect()
    assert [r.text.count("word") for r in got] == [30_000] * 2
    assert html_text.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("split", [37, 1000, 1 << 22])
def test_archives_are_read_back_whole(spark, split):
    rng = random.Random(2)
    shared = ["", "same text", "x" * 3000]
    rows = [(i, f"http://h/{i}\r\nEvil: 1", rng.choice([*shared, f"own {i} " * rng.randint(1, 400), None]), "") for i in range(120)]
    rows += [rows[-1], (500, None, gzip.compress(b"WARC/1.1\r\n").decode("latin-1"), "")]
    archives = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), scratch_path(spark, "warc"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, archives, split).collect()), key=str)
    best = {}
    for i, _, html, _ in rows:
        best[html or ""] = max(best.get(html or "", -1), i)
    expected, seen = [], set()
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        first = best[html or ""] == i and i not in seen
        seen.add(i)
        expected.append((i, len(payload), warc.digest(payload), "response" if first else "revisit", None if first else best[html or ""]))
    assert got == sorted(expected, key=str)


def test_nested_members_are_not_records(spark, tmp_path):
    inner = warc.encode_record(7, "u", b"inner", True, None)
    stored = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: u\r\nContent-Length: "
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner
    raw = stored + b"%d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    member = gzip.compress(raw, compresslevel=0)  # the inner member's bytes stand in it as they are
    path = tmp_path / "a.warc.gz"
    path.write_bytes(member + warc.encode_record(2, "u", b"two", True, None))
    got = warc.read_warc(spark, [(str(path), path.stat().st_size)], 64).collect()
    assert sorted(r.page_id for r in got) == [1, 2]


@pytest.mark.parametrize("inner", [2, 3])
def test_chains_of_nested_members_are_not_records(spark, tmp_path, inner):
    """Members one after another in a stored block, at splits that begin before, in and behind each of them."""
    nested = b"".join(warc.encode_record(70 + i, "u", b"inner %d" % i, True, None) for i in range(inner))
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: u\r\nContent-Length: "
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(nested) + nested
    outer = gzip.compress(head + b"%d\r\n\r\n" % len(block) + block + b"\r\n\r\n", compresslevel=0)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.encode_record(5, "u", b"five", True, None) + outer + warc.encode_record(2, "u", b"two", True, None) + outer + warc.encode_record(3, "u", b"three", True, None))
    for split in range(40, path.stat().st_size + 50, 97):
        got = warc.read_warc(spark, [(str(path), path.stat().st_size)], split).collect()
        assert sorted(r.page_id for r in got) == [1, 1, 2, 3, 5], split


def test_empty_table_writes_nothing(spark):
    folder = scratch_path(spark, "warc")
    assert warc.write_warc(spark.createDataFrame([], PAGES), folder) == []
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    assert fs.get_file_info(path).type == pafs.FileType.NotFound
    assert warc.read_warc(spark, []).count() == 0
