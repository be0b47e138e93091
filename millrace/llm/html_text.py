"""HTML extraction by equivalence-class template deduction.

Pages of one host share a template. Every page is read once, as a sequence of tokens: start tags with their path, and
runs of text with the path of their element. The template of a host is then deduced from all of its pages:

1. Tokens that occur equally often on every page (the same occurrence vector) form an equivalence class. Classes on
   enough of the host's pages are candidates, their tokens ordered by mean place.
2. A class is valid only if its tokens keep that order on every page: its n-th occurrences are one round of the class,
   rounds do not interleave, and a token that leaves the longest run in order on any page is no part of the class.
3. Classes nest by their spans: a class lies in one gap of the class around it, the same on every page and in every
   round. Of two classes whose spans cross on a page, that on fewer pages (then the smaller) is invalid, as is a class
   that changes its gap.
4. What valid classes leave are the slots. A page's text is what all of its slots hold, in page order, whatever their
   elements: headings, lists, quotes, cells and every part of an article that is split over several containers. Text
   tokens of valid classes are the template's; elements whose text is links over all pages of the host are menus.

Occurrence vectors are never gathered: a token's vector is a sum of page marks weighted by its counts, added up by a
plain aggregation with map-side combine; validity is a minimum and a maximum of gaps. A host with a third of all pages
is spread like any other. What is joined back to the pages is one small row a host, repeated over salts.

Meaning breaks what structure cannot see: elements that are no article (navigation, header, footer, aside, forms,
scripts, styles, notices, adverts, comments) are left out by tag and by class or id. An ``article`` or ``main`` of
which template text is more than half is one that a site repeats, and stays whole; a host none of whose pages has text
in a slot has copies of one page, and no template. On hosts with fewer than :data:`LEAST_PAGES` pages an ``article``
or ``main`` that holds at least half of a page's text is its text.

Defined cases: a null or empty page has an empty text; broken markup is read as far as it goes and unclosed elements
end with their parents; pages are read whole; repeated rows give repeated results; an empty table an empty one; a null
url belongs to a host without a name; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import chunks
from millrace.session import bounded_batches, discard, materialize

#: A template needs at least this many pages of its host, and tokens on at least this share of them.
LEAST_PAGES = 4
LEAST_SHARE = 0.5
#: An element with at least this share of linked characters, over all pages of its host, is a menu.
MENU_SHARE = 0.8

# What HTML elements mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object canvas select annotation annotation-xml".split())
LEFT_OUT = frozenset("nav header footer aside form head button dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a start tag of the key ends, if open.
ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    **{x: {"p"} for x in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
#: Words of class and id names that mark what is not the article.
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|nav(?:bar|igation)?|menu|sidebar|side|footer|header|masthead|breadcrumbs?|cookies?|consent|notice|popup|modal|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommend(?:ed)?|comments?|respond|disqus|pagination|pager|toolbar|widget|tags)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
GAP = re.compile(r"\s+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Block:
    """A run of text between block boundaries: its text, the path of its element, its place among the page's tokens,
    whether it may be the article or is left out by its meaning, and how many of its characters are links."""

    __slots__ = ("text", "path", "at", "left_out", "article", "linked")

    def __init__(self, text: str, path: str, at: int, left_out: bool, article: bool, linked: int) -> None:
        self.text, self.path, self.at, self.left_out, self.article, self.linked = text, path, at, left_out, article, linked


def read_page(html: str) -> tuple[list[str], list[Block]]:
    """The page's tokens in order, start tags by their path and texts by path and words, and its blocks of text."""
    tokens: list[str] = []
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, left out, article
    parts: list[str] = []
    linked = anchors = formulas = 0
    at, n = 0, len(html)

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if anchors:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = GAP.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] in INLINE:
                    depth -= 1
                _, path, out, article = stack[depth] if depth >= 0 else ("", "", False, False)
                blocks.append(Block(text, path, len(tokens), out or any(x[2] for x in stack[depth + 1 :]), article, min(linked, len(text))))
                tokens.append(f"={path}={text}")
        linked = 0

    def close(upto: int) -> None:
        nonlocal anchors, formulas
        while len(stack) > upto:
            tag = stack[-1][0]
            if tag not in INLINE and not formulas:
                flush()
            anchors -= tag == "a"
            formulas -= tag == "math"
            stack.pop()

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                say(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group(1):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE and not formulas:
                    break
            if tag == "p" or tag == "br":
                parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            parts.append(" " if tag in ("br", "img") else "")
            continue
        if tag in RAW:  # what stands around it goes on
            if not m.group(3).rstrip().endswith("/") or tag != "svg":
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if (ends := ENDS.get(tag)) and not formulas:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    close(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        block = tag not in INLINE and not formulas
        marks = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m.group(3))} if m.group(3) else {}
        if block:
            flush()
        parent = stack[-1] if stack else ("", "", False, False)
        names = f"{marks.get('class', '')} {marks.get('id', '')} {marks.get('role', '')}"
        article = parent[3] or tag in ("article", "main")
        # a header of the article itself holds its title
        out = parent[2] or (tag in LEFT_OUT and not (tag == "header" and article)) or (names != "  " and tag not in ("html", "body", "article", "main") and NOT_ARTICLE.search(names) is not None)
        if out and tag in ("body", "html"):
            out = False
        path = f"{parent[1]}/{tag}" + (f".{marks['class']}" if marks.get("class") else "") if block else parent[1]
        if not m.group(3).rstrip().endswith("/") or tag != "math":
            stack.append((tag, path, out, article))
            anchors += tag == "a"
            formulas += tag == "math"
            if block:
                tokens.append(path)
    flush()
    close(0)
    return tokens, blocks


def _id(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


PARSED = "page_id long, url string, host string, mark long, tokens array<long>, texts array<string>, at array<int>, path array<long>, flags array<int>, linked array<int>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as token ids and blocks; the only step that reads markup. Flags: 1 left out, 2 inside an article."""
    known: dict[str, int] = {}
    for batch in chunks(batches, 2):
        rows: list[list] = [[] for _ in range(6)]
        marks = []
        for page, html in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            tokens, blocks = read_page(html or "")
            if len(known) > 1 << 16:
                known.clear()
            ids = [known.get(t) or known.setdefault(t, _id(t)) if t[:1] == "/" else _id(t) for t in tokens]
            marks.append(_id(f"{page}:{len(tokens)}") & ((1 << 40) - 1))
            for held, x in zip(
                rows,
                (ids, [b.text for b in blocks], [b.at for b in blocks], [_id(b.path) for b in blocks], [b.left_out + 2 * b.article for b in blocks], [b.linked for b in blocks]),
                strict=True,
            ):
                held.append(x)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        arrays = [pa.array(held, pa.list_(kind)) for held, kind in zip(rows, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(marks, pa.int64()), *arrays], names=[x.split()[0] for x in PARSED.split(", ")])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token, combined over a batch: pages, vector sum, sum of first places, occurrences, characters and
    linked characters directly inside (of tags)."""
    for batch in batches:
        held: dict[tuple[str, int], list[int]] = {}
        for host, mark, tokens, texts, paths, linked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts: dict[int, list[int]] = {}
            for i, t in enumerate(tokens):
                x = counts.get(t)
                if x is None:
                    counts[t] = [1, i]
                else:
                    x[0] += 1
            for t, (n, at) in counts.items():
                x = held.setdefault((host, t), [0, 0, 0, 0, 0, 0])
                x[0] += 1
                x[1] += n * mark
                x[2] += at
                x[3] += n
            for t, n, k in zip(paths, texts, linked, strict=True):
                x = held.setdefault((host, t), [0, 0, 0, 0, 0, 0])
                x[4] += n
                x[5] += k
        if held:
            kinds = (pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([x[k] for x in held.values()], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in held], pa.string()), pa.array([t for _, t in held], pa.int64()), *columns],
                names=["host", "token", "pages", "vector", "place", "count", "chars", "linked"],
            )


def longest_in_order(ranks: list[int]) -> set[int]:
    """The longest increasing run of ``ranks``, all different; of several the one with the smallest ranks, first to last."""
    n = len(ranks)
    tails: list[int] = []  # negated ranks: increasing from the end
    length = [0] * n
    for i in range(n - 1, -1, -1):
        k = bisect_left(tails, -ranks[i])
        length[i] = k + 1
        tails[k : k + 1] = [-ranks[i]]
    out: set[int] = set()
    start, last = 0, -1
    for need in range(len(tails), 0, -1):
        best = min((i for i in range(start, n) if length[i] == need and ranks[i] > last), key=lambda i: ranks[i])
        out.add(ranks[best])
        start, last = best + 1, ranks[best]
    return out


ROOT = -1


def check_page(tokens: list[int], classes: list[list[int]]) -> tuple[set[tuple[int, int]], set[int], dict[int, set[int]]]:
    """What one page says of its host's candidate classes, best supported first.

    Displaced ``(class, token)``, broken classes, and the gaps that each class lies in: ``class * 2^20 + gap`` of the
    class around it, or :data:`ROOT`.
    """
    owner = {t: (c, r) for c, ts in enumerate(classes) for r, t in enumerate(ts)}
    places: dict[int, dict[int, list[int]]] = {}
    for i, t in enumerate(tokens):
        if t in owner:
            c, r = owner[t]
            places.setdefault(c, {}).setdefault(r, []).append(i)
    displaced: set[tuple[int, int]] = set()
    broken: set[int] = set()
    gaps: dict[int, set[int]] = {}
    around: list[tuple[int, int, list[int]]] = []  # valid classes of several tokens: class, tokens a round, all places
    for c in sorted(places):  # the best supported first, so that of two that cross the other one is broken
        by_rank = places[c]
        rounds = len(next(iter(by_rank.values())))
        if len(by_rank) != len(classes[c]) or any(len(x) != rounds for x in by_rank.values()):
            broken.add(c)  # a sum of marks that only looked like a vector
            continue
        gone: set[int] = set()
        for k in range(rounds):
            ranks = [r for _, r in sorted((x[k], r) for r, x in by_rank.items())]
            if any(a > b for a, b in zip(ranks, ranks[1:], strict=False)):
                gone |= set(ranks) - longest_in_order(ranks)
        displaced |= {(c, classes[c][r]) for r in gone}
        left = [by_rank[r] for r in range(len(by_rank)) if r not in gone]
        spans = [[x[k] for x in left] for k in range(rounds)]
        flat = [i for span in spans for i in span]
        ok = all(a < b for a, b in zip(flat, flat[1:], strict=False))  # rounds do not interleave
        inner: list[tuple[int, int]] = [(-1, ROOT)] * rounds  # where the span around each round begins, and its gap
        for f, size, at in around:
            for k, span in enumerate(spans):
                before = [bisect_left(at, i) for i in span]
                # all in one gap, or nowhere inside a round of the other
                ok &= before[0] == before[-1] or not any(b % size for b in before)
                if gap := before[0] % size:
                    inner[k] = max(inner[k], (at[before[0] - gap], f << 20 | gap))
        if not ok:
            broken.add(c)
            continue
        gaps[c] = {gap for _, gap in inner}
        if len(left) > 1:
            around.append((c, len(left), flat))
    return displaced, broken, gaps


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a batch's pages say of their hosts' classes: smallest and largest gap, faults, and text left in slots."""
    for batch in batches:
        held: dict[tuple[str, int, int], list[int]] = {}
        for host, tokens, texts, at, flags, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            displaced, broken, gaps = check_page(tokens, classes)
            for c, t in displaced:
                held[host, c, t] = [0, 0, 1, 0]
            for c in broken:
                held.setdefault((host, c, 0), [1 << 62, -1 << 62, 0, 0])[2] = 1
            for c, found in gaps.items():
                x = held.setdefault((host, c, 0), [1 << 62, -1 << 62, 0, 0])
                x[0], x[1] = min(x[0], *found), max(x[1], *found)
            template = {t for ts in classes for t in ts}
            left = sum(n for n, i, f in zip(texts, at, flags, strict=True) if not f & 1 and tokens[i] not in template)
            held.setdefault((host, -1, 0), [0, 0, 0, 0])[3] += left
        if held:
            keys = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array([k[2] for k in held], pa.int64())]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array([x[k] for x in held.values()], pa.int64()) for k in range(4))], names=["host", "class", "token", "lo", "hi", "fault", "left"])


def _salted(rows: DataFrame, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def deduce_templates(parsed: DataFrame, salts: int = 64) -> DataFrame:
    """``(host, tokens, menus)`` of hosts with a template: tokens of valid classes, and tags whose text is links."""
    chars = F.transform("texts", lambda x: F.length(x))
    seen = parsed.select("host", "mark", "tokens", chars.alias("chars"), "path", "linked")
    seen = seen.mapInArrow(_occurrences, "host string, token long, pages long, vector decimal(38,0), place long, count long, chars long, linked long")
    summed = seen.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "vector", "place", "count", "chars", "linked")))
    hosts = parsed.groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= LEAST_PAGES)
    common = materialize(summed.join(hosts, "host").where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= F.col("host_pages") * LEAST_SHARE)), "tokens")
    members = F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token")))
    classes = common.groupBy("host", "vector", "pages", "count").agg(members["token"].alias("tokens"))
    # tokens on half of a host's pages are about twice those of one page at most
    rank = F.struct((-F.col("pages")).alias("p"), (-F.size("tokens")).alias("n"), F.col("tokens"))
    candidates = materialize(classes.groupBy("host").agg(F.sort_array(F.collect_list(rank))["tokens"].alias("classes")), "classes")

    pages = parsed.withColumn("salt", F.pmod(F.col("mark"), F.lit(salts)).cast("int"))
    pages = pages.join(_salted(candidates, salts), ["host", "salt"]).select("host", "tokens", chars.alias("chars"), "at", "flags", "classes")
    said = pages.mapInArrow(_check, "host string, class int, token long, lo long, hi long, fault long, left long")
    said = materialize(said.groupBy("host", "class", "token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("fault").alias("fault"), F.sum("left").alias("left")), "checks")
    bad_class = said.where("class >= 0 and token = 0 and (fault > 0 or lo <> hi)").select("host", "class")
    bad_token = said.where("class >= 0 and token <> 0").select("host", "token")
    filled = said.where("class = -1 and left > 0").select("host")  # a host with text in slots
    tokens = candidates.select("host", F.posexplode("classes").alias("class", "tokens")).join(bad_class, ["host", "class"], "left_anti")
    tokens = tokens.select("host", F.explode("tokens").alias("token")).join(bad_token, ["host", "token"], "left_anti")
    menus = common.where((F.col("chars") > 0) & (F.col("linked") >= F.col("chars") * MENU_SHARE)).select("host", F.lit(None).cast("long").alias("token"), F.col("token").alias("menu"))
    both = tokens.withColumn("menu", F.lit(None).cast("long")).unionByName(menus).join(filled, "host", "left_semi")
    out = materialize(both.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("template"), F.sort_array(F.collect_list("menu")).alias("menus")), "templates")
    discard(common, candidates, said)
    return out


def _size(texts: list[str]) -> int:
    return sum(map(len, texts))


def slots_text(texts: list[str], token: list[int], path: list[int], flags: list[int], template: set[int] | None, menus: set[int]) -> str:
    """What a page's slots hold: its blocks without those of the template, of menus and of elements that are no article."""
    own = [i for i, f in enumerate(flags) if not f & 1]
    marked = [i for i in own if flags[i] & 2]
    if template is None:
        own = marked if 2 * _size([texts[i] for i in marked]) >= _size([texts[i] for i in own]) else own
        return "\n\n".join(texts[i] for i in own)
    slots = [i for i in own if token[i] not in template]
    # an article or main that is mostly template text is a copy of another page's, and no template
    copied = 2 * _size([texts[i] for i in slots if flags[i] & 2]) < _size([texts[i] for i in marked])
    kept = set(slots) | set(marked) if copied else set(slots)
    return "\n\n".join(texts[i] for i in own if i in kept and (path[i] not in menus or flags[i] & 2))


def extract_text(pages: DataFrame, salts: int = 64) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``."""
    bounded_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    parsed = materialize(pages.select("page_id", "url", "html", host.alias("host")).mapInArrow(_parse, PARSED), "parsed")
    templates = _salted(deduce_templates(parsed, salts), salts)
    rows = parsed.withColumn("salt", F.pmod(F.col("mark"), F.lit(salts)).cast("int")).join(templates, ["host", "salt"], "left")
    token = F.transform("at", lambda i: F.element_at("tokens", i + 1))
    rows = rows.select("page_id", "url", "texts", token.alias("token"), "path", "flags", "template", "menus")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [slots_text(*x[:4], None if x[4] is None else set(x[4]), set(x[5] or ())) for x in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: the article of every row of ``pages``."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
