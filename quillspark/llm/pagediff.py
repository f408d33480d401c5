"""Main text of web pages by differencing each page with the page of the nearest url on its host.

Pages are ordered by host and path, one for each url; each is paired with the neighbour
whose path shares the longest prefix.  A page becomes text lines, one per block.  The lines
of a pair are aligned by longest common subsequence, and shared ones are a template's, so
they are deleted: at once where they stand in a bare container, as page furniture does.
Near pages do carry equal paragraphs and headings, so one of those goes only where the
pages of all six nearest urls have it at the same place, most of the page is its own, and
the line is much shorter than the page's own ones.  What markup itself declares to be
furniture (menus, footers, forms, adverts and the like) can't be main text and goes before;
a page with an article keeps what is left of the article, another one what is left of all.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark.llm.common import settle, slices, with_membership
from quillspark.llm.urlrules import url_parts

# Fixed values of the HTML standard, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME_TAGS = frozenset("nav footer aside form menu dialog button select label fieldset head header".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related reader-comments respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(?=/?[a-zA-Z])[^<]*\Z|[^<]+|<""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z-]+)""")
_SEPARATORS = re.compile(r"[^a-z0-9]+")
CHROME, PLAIN, ARTICLE = 0, 1, 2
#: Blocks of running text; lines in other ones are in bare containers.
PROSE = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th caption figcaption summary".split())
#: A template's paragraph is shorter than the median line of a page's own by this factor.
TEMPLATE_SHARE = 2
#: Urls looked at on either side in the order of hosts and paths.
AROUND = 3


def _is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in CHROME_TAGS:
        return not (tag == "header" and in_article)
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, a, b, c, alone in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if (name or alone).lower() == "hidden":
            return True
        name = name.lower()
        if name == "role" and value in CHROME_ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id") and any(w in CHROME_WORDS for w in _SEPARATORS.split(value)):
            return True
    return False


class Line(NamedTuple):
    """A block's text, its zone, and whether the block is one of running text."""

    text: str
    zone: int
    prose: bool


def text_lines(page: str | None) -> list[Line]:
    """The blocks of a page, in order, white space as one blank; blocks without text don't count.

    Markup may be broken: an end tag closes up to its start tag or nothing, a new paragraph
    closes an open one, an article or main closes page furniture left open around it, and
    what ends within a tag loses the tag.
    """
    lines: list[Line] = []
    parts: list[str] = []
    open_tags: list[tuple[str, int]] = []
    zone, raw = PLAIN, ""

    def flush() -> None:
        if text := " ".join(html.unescape("".join(parts)).split()):
            lines.append(Line(text, zone, next((t for t, _ in reversed(open_tags) if t in BLOCKS), "") in PROSE))
        parts.clear()

    for found in _TOKEN.finditer(page or ""):
        token, tag = found[0], (found[2] or "").lower()
        if raw:
            if found[1] and tag == raw:
                raw = ""
            continue
        if not tag:
            if token[0] != "<" or token == "<":
                parts.append(token)
            elif token.startswith("<![CDATA["):
                parts.append(html.escape(token[9:-3]))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if found[1]:
            for at in range(len(open_tags) - 1, -1, -1):
                if open_tags[at][0] == tag:
                    zone = open_tags[at][1]
                    del open_tags[at:]
                    break
            continue
        if tag in VOID or found[3].endswith("/"):
            continue
        if tag in RAW:
            raw = tag
            continue
        if tag == "p" and open_tags and open_tags[-1][0] == "p":
            zone = open_tags.pop()[1]
        open_tags.append((tag, zone))
        if tag in ("article", "main"):
            zone = ARTICLE if zone != CHROME or not any(t in ("aside", "footer", "form") for t, _ in open_tags) else CHROME
        elif zone != CHROME and _is_chrome(tag, found[3], zone == ARTICLE):
            zone = CHROME
    flush()
    return lines


def marks(lines: list[Line]) -> list[int]:
    """Signed 64-bit digests of the lines that markup leaves, which stand for them in alignments."""
    return [(h := xxh64_intdigest(x.text.encode("utf-8", "surrogatepass"))) - ((h >> 63) << 64) for x in lines if x.zone != CHROME]


def aligned(mine: list, theirs: list) -> list[tuple[int, int]]:
    """Places of equal lines in a longest common subsequence of two pages, by bit-parallel rows.

    Equal starts and ends are taken first, and lines that only one page has play no part, so
    the rows held are as many and as long as what is left to decide.
    """
    start, most = 0, min(len(mine), len(theirs))
    while start < most and mine[start] == theirs[start]:
        start += 1
    end = 0
    while end < most - start and mine[-1 - end] == theirs[-1 - end]:
        end += 1
    both = set(mine[start : len(mine) - end]) & set(theirs[start : len(theirs) - end])
    at = [i for i in range(start, len(mine) - end) if mine[i] in both]
    to = [j for j in range(start, len(theirs) - end) if theirs[j] in both]
    places: dict = {}
    for i, place in enumerate(at):
        places[mine[place]] = places.get(mine[place], 0) | 1 << i
    full = (1 << len(at)) - 1
    row, rows = full, [full]
    for place in to:
        hit = row & places[theirs[place]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found, i, j = [], len(at), len(to)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((at[i], to[j]))
    ends = [(len(mine) - k, len(theirs) - k) for k in range(end, 0, -1)]
    return [(k, k) for k in range(start)] + found[::-1] + ends


def main_lines(lines: list[Line], near: list[list[int]] | None) -> list[str]:
    """What is left of a page's article, or else of its plain lines.

    `near` holds the `marks` of the partner and, where the host has so many, of the nearest
    AROUND urls on either side.
    """
    left = [x for x in lines if x.zone != CHROME]
    mine = marks(left)
    shared = {i for i, _ in aligned(mine, near[0])} if near else set()
    gone = {i for i in shared if not left[i].prose}
    if shared - gone and near and len(near) > 2 * AROUND:
        everywhere = shared.intersection(*({i for i, j in aligned(mine, theirs) if i == j or len(mine) - i == len(theirs) - j} for theirs in near[1:]))
        own = sorted(len(left[i].text) for i in range(len(left)) if i not in everywhere)
        if 2 * sum(own) > sum(len(x.text) for x in left):
            gone |= {i for i in everywhere if TEMPLATE_SHARE * len(left[i].text) < own[len(own) // 2]}
    zone = ARTICLE if any(x.zone == ARTICLE for x in left) else PLAIN
    return [x.text for i, x in enumerate(left) if x.zone == zone and i not in gone]


def outlines(pages: DataFrame) -> DataFrame:
    """(id, url, marks) of pages (id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [marks(text_lines(page)) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], names=["id", "url", "marks"])

    return pages.select("id", "url", "html").mapInArrow(run, "id long, url string, marks array<long>")


def neighbours(rows: DataFrame) -> DataFrame:
    """The rows (url, id, marks, ...), one for each url, with partner and around added.

    `around` holds up to AROUND rows before and as many after in the order of host, path, id
    and url that have the same host; `partner` is the one next to it whose path shares the
    longer prefix (the one before of equals), null if a url is alone on its host.  Rows are
    sorted by range, so a host may hold any share of them; the rows that a sorted part can't
    see are handed on by the parts beside it.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "id", "url"]
    host, path = url_parts(F.col("url"))
    parts = settle(rows.withColumns({"host": host, "path": path}).repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()))
    one = F.struct(*order, "marks")
    own, back = (Window.partitionBy("part").orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c in order]) for up in (True, False))
    numbered = parts.withColumns({"_up": F.row_number().over(own), "_down": F.row_number().over(back)})
    edges = numbered.where(f"_up <= {AROUND} OR _down <= {AROUND}").groupBy("part").agg(*[F.array_sort(F.collect_list(F.when(F.col(c) <= AROUND, one))).alias(name) for c, name in (("_up", "first"), ("_down", "last"))])
    across = Window.orderBy("part")
    handed = edges.select("part", F.flatten(F.collect_list("last").over(across.rowsBetween(-AROUND, -1))).alias("above"), F.flatten(F.collect_list("first").over(across.rowsBetween(1, AROUND))).alias("below"))
    seen = parts.withColumns({"before": F.collect_list(one).over(own.rowsBetween(-AROUND, -1)), "after": F.collect_list(one).over(own.rowsBetween(1, AROUND))}).join(handed, "part")
    before, after = F.concat("above", "before"), F.concat("after", "below")
    before = F.slice(before, F.greatest(F.size(before) - AROUND + 1, F.lit(1)), F.lit(AROUND))
    here = lambda x: x["host"] == F.col("host")
    seen = seen.select(*rows.columns, "path", F.filter(before, here).alias("before"), F.filter(F.slice(after, 1, AROUND), here).alias("after"))
    b, a = F.try_element_at("before", F.lit(-1)), F.try_element_at("after", F.lit(1))

    def prefix(other: Column) -> Column:
        steps = F.sequence(F.lit(0), F.least(F.length("path"), F.length(other["path"])))
        return F.coalesce(F.size(F.filter(steps, lambda n: F.substring(F.col("path"), F.lit(1), n) == F.substring(other["path"], F.lit(1), n))), F.lit(-1))

    return seen.select(*rows.columns, F.when(prefix(b) >= prefix(a), b).otherwise(a).alias("partner"), F.concat("before", "after").alias("around"))


def differing(pages: DataFrame) -> DataFrame:
    """(url, near) of the urls of pages (id, url, html) that may share a line with their partner's; `near` as `main_lines` takes it."""
    rows = outlines(pages.where("url IS NOT NULL"))
    firsts = rows.groupBy("url").agg(F.min(F.struct("id", "marks")).alias("f"), (F.min("marks") != F.max("marks")).alias("several")).select("url", "f.*", "several")
    near = neighbours(firsts).where(F.col("several") | F.arrays_overlap("marks", "partner.marks"))
    both = F.array(F.col("partner.marks"))
    return near.where("partner IS NOT NULL").select("url", F.when(F.size("around") == 2 * AROUND, F.concat(both, F.transform("around", lambda x: x["marks"]))).otherwise(both).alias("near"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    text joins the main lines by two line ends, empty if there are none; null html has none.
    A url is compared with others by its page of smallest id; rows may repeat ids and urls,
    and pages of null urls are compared with none.  Digests of lines are all that is sorted
    and written; of the pages themselves only those that share lines are dealt by url.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = settle(differing(plain))
    told = with_membership(plain, "url", found, "_differs")
    wanted = told.where("_differs").join(found, "url", "left").select("id", "url", "html", "near")
    wanted = wanted.unionByName(told.where("NOT _differs").select("id", "url", "html", F.lit(None).cast("array<array<bigint>>").alias("near")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = ["\n\n".join(main_lines(text_lines(page), near)) for page, near in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return wanted.mapInArrow(finish, "page_id long, url string, text string, n_chars long")
