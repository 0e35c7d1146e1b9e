"""Main text of web pages by templates deduced from equivalence classes.

A page is a sequence of tokens: tags with their path, and blocks of text with theirs.
Over the distinct pages of a host (those that differ in their tokens, so copies count as
one page) each token has an occurrence vector (how often it stands on each page); tokens
with equal vectors form an equivalence class.  A class is valid if it holds several tokens
and stands on at least half of the host's distinct pages, of which there must be some; classes nest by the paths of their tokens, and the valid ones are the host's
template.  What stands between template tokens are the slots.  A slot is extracted unless
it lies in furniture: an element that menus, footers, adverts and the like use, by name or
by its class, id or role, unless it wraps most of the page's text and all its articles.  Where a host has too few pages for a template, text
inside elements that mark an article is chosen if it is at least half of what is left.

Vectors are compared by a sum of hashes of (page, count), so no host's pages meet in one
task.  A host with more than a thousandth of all pages (there are fewer than a thousand of
them, so they can be broadcast) is dealt in as many parts as it has thousandths, for its
pages and its tokens alike.

A null or empty page has empty text.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import materialize

PARTS, LEAST_PAGES, LEAST_TOKENS = 1000, 3, 2
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>",
    re.S | re.I,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that hold no article text, elements that hold the article, and inline elements.
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "object", "canvas", "audio", "video"}
ARTICLE = {"article", "main"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = set("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role names that mark furniture.
MARKS = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer footer header masthead menu nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe tags toolbar widget contentinfo complementary search".split()
)
#: Words that say where such a part stands or what shape it has; for headers and footers (an article and
#: its sections have their own) only those of the first line; for comments also who writes them, or on what.
FRAME = set("site main global top bottom sticky fixed mobile desktop bar wrapper container inner".split())
SHAPES = set("left right box list section area block wrap outer item items primary secondary floating panel zone slot unit row group links link inline".split())
WRITERS = set("user users reader readers post posts article story entry".split())


def walk(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(path, block of text, in furniture, in an article) of each block, and ("path", "", ...) of each container's tag."""
    found, wide = blocks_of(page)
    for path, text, marks, inside in found:
        yield (path, text, not wide.issuperset(marks), any(wide.issuperset(m) for m in inside))


def blocks_of(page: str) -> tuple[list[tuple[str, str, tuple[int, ...], tuple[tuple[int, ...], ...]]], set[int]]:
    """Blocks and containers as (path, text, numbers of the furniture around it, those around each article around it),
    and the numbers of the marked wrappers that hold most of the page's text and all its articles, so are no furniture."""
    stack: list[tuple[str, tuple[int, ...], tuple[tuple[int, ...], ...]]] = [("", (), ())]
    found: list[tuple[str, str, tuple[int, ...], tuple[tuple[int, ...], ...]]] = []
    words: list[str] = []
    span: list[int] | None = None  # of a marked span: words before it, spans open, height of the stack, paragraphs open
    wrappers: set[int] = set()
    articles: list[tuple[int, ...]] = []
    at = number = 0

    def block() -> None:
        cut = len(words) if span is None else span[0]
        path, marks, inside = stack[-1]
        for part, off in ((words[:cut], marks), (words[cut:], (*marks, -1))):
            text = " ".join(html.unescape("".join(part)).split())
            if text:
                found.append((path, text, off, inside))
        words.clear()
        if span is not None:
            span[0] = 0

    for m in TOKEN.finditer(page):
        words.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                words.append(" ")
            elif name == "span" and span is not None:
                span[1] += -1 if m[2] else 1
                if not span[1]:
                    del words[span[0] :]
                    span = None
            elif name == "span" and not m[2] and "class" in m[4] and marked(m[4]):
                span = [len(words), 1, len(stack), 0]
            continue
        block()
        if name in VOID:
            continue
        if name in SELF_CLOSING:
            if span is not None:
                span[3] += -1 if m[2] else 1
                span = None if span[3] < 0 else span
            continue
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0].rsplit("/", 1)[1].split(".")[0] == name:
                    del stack[k:]
                    break
            if span is not None and len(stack) < span[2]:
                span = None
            continue
        path, marks, inside = stack[-1]
        if name in FURNITURE or name == "header" and not inside or bool(m[4]) and name not in ("body", "html", *ARTICLE) and marked(m[4]):
            number += 1
            marks = (*marks, number)
            if name == "form" or name not in FURNITURE and name != "header":
                wrappers.add(number)
        if name in ARTICLE or 'role="main"' in m[4]:
            inside = (*inside, marks)
            articles.append(marks)
        stack.append((f"{path}/{name}", marks if span is None else (*marks, -1), inside))
        found.append((stack[-1][0], "", stack[-1][1], inside))
    words.append(page[at:])
    block()
    held: Counter[int] = Counter()
    total = 0
    for _, text, marks, _ in found:
        if text and wrappers.issuperset(marks):
            total += len(text)
            held.update({k: len(text) for k in set(marks)})
    sure = [marks for marks in articles if wrappers.issuperset(marks)]
    return found, {k for k, n in held.items() if 2 * n > total and all(k in marks for marks in sure)}


def marked(attributes: str) -> bool:
    """Whether a class, id or role has a word that marks furniture, and else only words of place and shape
    (so ``comments-list`` and ``top-banner`` are marked, ``with-sidebar`` and ``post-header`` are not)."""
    names = (token for a, b, c in NAMES.findall(attributes) for token in (a or b or c).lower().split())
    return any(marks_furniture(re.findall(r"[a-z]+", name)) for name in names)


def marks_furniture(words: list[str]) -> bool:
    own = MARKS.intersection(words)
    beside = FRAME if own & {"header", "footer"} else FRAME | SHAPES | (WRITERS if own & {"comment", "comments"} else set())
    return bool(own) and all(w in MARKS or w in beside for w in words)


def token_of(path: str, text: str) -> int:
    return zlib.crc32(f"{path}|{text}".encode("utf-8", "replace")) | zlib.crc32(f"{text}|{path}".encode("utf-8", "replace")) << 31


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The host of each page and its tokens in order of value, 8 bytes for each time one stands there."""
    for b in batches:
        packed = [np.sort(np.array([token_of(path, block) for path, block, _, _ in walk(text or "")], "<i8")).tobytes() for text in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(packed, pa.binary())], ["host", "tokens"])


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for host, packed in zip(b.column("host").to_pylist(), b.column("tokens").to_pylist(), strict=True):
            page = int.from_bytes(hashlib.sha256(packed).digest()[:8], "little", signed=True)
            rows += [(page, host, token, n) for token, n in zip(*(x.tolist() for x in np.unique(np.frombuffer(packed, "<i8"), return_counts=True)), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["page", "host", "token", "n"])


def heavy_hosts(pages: DataFrame) -> DataFrame:
    """(host, parts) of the hosts with more than one of ``PARTS`` parts of all pages, so fewer than ``PARTS`` rows."""
    total = pages.count()
    counts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") * PARTS > total)
    return counts.select("host", F.ceil(F.col("pages") * PARTS / F.lit(max(total, 1))).alias("parts"))


def dealt(rows: DataFrame, heavy: DataFrame, by: str) -> DataFrame:
    """Adds the part of its host that each row belongs to."""
    return rows.join(F.broadcast(heavy), "host", "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1)))).drop("parts")


def copied(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Each host's row once for every part of the host."""
    last = F.coalesce("parts", F.lit(1)) - 1
    return rows.join(F.broadcast(heavy), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).drop("parts")


def templates(pages: DataFrame, heavy: DataFrame) -> DataFrame:
    """(host, template): the tokens of each host's valid equivalence classes, at most two for each token of a mean page."""
    packed = pages.select("host", "html").mapInArrow(contents, "host string, tokens binary")
    seen = packed.distinct().mapInArrow(occurrences, "page long, host string, token long, n long")
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).cast("string")
    by_token = seen.groupBy("host", "token").agg(vector.alias("vector"), F.count(F.lit(1)).alias("on"))
    by_token = by_token.where(F.col("on") * 2 >= LEAST_PAGES)  # others are on less than half of any host's pages: most of a page's own text
    sizes = packed.select("host", F.xxhash64("tokens").alias("page")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    often = dealt(by_token, heavy, "token").join(copied(sizes, heavy), ["host", "part"]).where("2 * on >= pages")
    valid = often.groupBy("host", "vector").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= LEAST_TOKENS)
    return valid.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))


def slots(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for page, template in zip(b.column("html").to_pylist(), b.column("template").to_pylist(), strict=True):
            held = set(template or ())
            blocks = [x for x in walk(page or "") if x[1] and not x[2] and token_of(x[0], x[1]) not in held]
            marked_text = [x for x in blocks if x[3]]
            if not held and 2 * sum(len(x[1]) for x in marked_text) >= sum(len(x[1]) for x in blocks):
                blocks = marked_text
            out.append("\n\n".join(text for _, text, _, _ in blocks))
        lengths = pa.array([len(t) for t in out], pa.int64())
        yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array([t.encode("utf-8", "replace").decode() for t in out], pa.string()), lengths], [*kept, "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages(page_id, url, html)``."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    heavy = materialize(heavy_hosts(rows), "hosts")
    known = copied(templates(rows, heavy), heavy)
    joined = dealt(rows, heavy, "page_id").join(known, ["host", "part"], "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(lambda it: slots(it, ["page_id", "url"]), "page_id long, url string, text string, n_chars long")
