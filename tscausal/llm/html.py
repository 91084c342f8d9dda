"""Main text of web pages, with site templates found by counting element subtrees per host.

A tolerant scanner keeps a stack of open elements and hashes every subtree bottom-up: from its tag, its text and the
hashes of its children, without attributes, so that changing links or numbers of a menu entry don't matter. Spark counts
in how many different surroundings on its host each container subtree stands; those that recur are template and are
deleted, in the main part and outside of it. The surroundings of a subtree are the main text without the subtree: copies
of an article don't make it a template, nor does a box that is all of the article. Paragraphs of the main part are never
deleted for recurring: articles share passages, and these are text. Tags, roles and class names decide about what recurs
too seldom.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROP = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "fieldset", "label"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = {"div", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "dl", "p", "figure", "menu", "details"}
#: Containers that may be template in the main part, too.
BOXES = {"div", "section", "nav", "header", "footer", "aside", "form", "figure", "menu", "details"}
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: What an opening tag closes when it is still open: items and cells end at the next one, paragraphs at any block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "nav", "aside", "footer", "header", "blockquote", "form"}
#: Words of class, id and role that mark furniture, and those that mark the main part.
FURNITURE = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|pagination|pager|toc|sidebar|side|rail|widget|widgets|footer|foot|masthead|topbar|toolbar|header|site-header|contentinfo|complementary|search|"
    r"comment|comments|commentlist|respond|reply|replies|disqus|discussion|related|recommended|recommendations|more-stories|share|sharing|social|subscribe|subscription|newsletter|signup|login|paywall|print-only|skip|skip-link|hidden|visually-hidden|sr-only)s?(?:$|[-_\s])",
    re.I,
)
MAIN = re.compile(r"(?:^|[-_\s])(?:content|main|main-content|maincontent|article|article-body|articlebody|post|post-content|post-body|entry|entry-content|story|story-body)(?:$|[-_\s])", re.I)


class Page:
    """One scan of a page: ``blocks`` are (text, rank, dropped, where it starts), ``subtrees`` are (hash, hash of the surroundings) of containers.

    Without ``names``, nothing is dropped or preferred for its tag, role or class: what ``templates`` leaves stays.
    """

    def __init__(self, source: str, templates: frozenset = frozenset(), names: bool = True):
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.names = names
        # Begin, end, hash, sum of the hashes of its text, whether it lies in the main part.
        self.spans: list[tuple[int, int, int, int, bool]] = []
        self.all = self.main = 0
        self._scan(source)
        total = (self.main or self.all) & _MASK
        self.subtrees = {(h, (total - own) & _MASK if inside or not self.main else total) for _, _, h, own, inside in self.spans}
        if templates:
            starts, ends = [], []
            for a, b in sorted((a, b) for a, b, h, _, _ in self.spans if h in templates):
                if not ends or b > ends[-1]:
                    starts.append(a)
                    ends.append(b)
            self.blocks = [x for x in self.blocks if not (at := bisect_right(starts, x[3])) or x[3] >= ends[at - 1]]

    def _scan(self, s: str) -> None:
        # An open element: tag, where it starts, whether it is dropped, its rank as main part (2 article, 1 main), whether it is a header of an article.
        stack: list[tuple[str, int, bool, int, bool]] = []
        # Of each open element, and of the page: hash of what it holds so far, sum of the hashes of its text.
        held: list[list[int]] = [[0, 0]]
        parts: list[str] = []
        mains: list[int] = []
        start = 0

        def add(piece: str) -> None:
            # Each piece by itself, so that markup between two of them can't make up a reference.
            piece = html.unescape(piece)
            parts.append(piece)
            if words := " ".join(piece.split()):
                h = xxhash.xxh64_intdigest(words)
                held[-1][0] = (held[-1][0] * _ODD + h) & _MASK
                held[-1][1] += h
                self.all += h
                if any(x[3] for x in stack):
                    self.main += h

        def flush() -> None:
            nonlocal start
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    dropped = any(x[2] for x in stack) or any(x[4] for x in stack) and not any(x[0][0] == "h" and x[0][1:].isdigit() for x in stack)
                    self.blocks.append((text, max((x[3] for x in stack), default=0), dropped and self.names, start))

        def pop(to: int, end: int) -> None:
            while len(stack) > to:
                tag, begin, _, rank, _ = stack.pop()
                inner, own = held.pop()
                h = xxhash.xxh64_intdigest(f"{tag} {inner}")
                held[-1][0] = (held[-1][0] * _ODD + h) & _MASK
                held[-1][1] += own
                inside = any(x[3] for x in stack)
                # A template does not hold the main part.
                if tag in (BOXES if inside else CONTAINERS) and own and not rank and not (mains and mains[-1] > begin):
                    self.spans.append((begin, end, h - (1 << 63), own, inside))

        pos, skip_to = 0, 0
        for m in TOKEN.finditer(s):
            if m.start() < skip_to:
                continue
            if m.start() > pos:
                if not parts:
                    start = pos
                add(s[pos : m.start()])
            pos = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["close"]:
                if tag in BLOCKS:
                    flush()
                if tag in VOID or tag in ("html", "body"):
                    continue
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop(i, m.end())
                        break
                    if tag not in BLOCKS and stack[i][0] in BLOCKS or tag in ("p", "li") and stack[i][0] in WALLS:
                        break
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>|\Z", re.I).search(s, m.end())
                if not m["attrs"].rstrip().endswith("/"):
                    pos = skip_to = close.end()
                continue
            if tag == "br" or tag == "wbr":
                if tag == "br":
                    parts.append(" ")
                continue
            if tag in BLOCKS:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] in ENDS.get(tag, ()):
                        pop(i, m.start())
                    elif stack[i][0] in WALLS:
                        break
            if tag in VOID:
                continue
            names = " ".join(a or b or c for a, b, c in NAMED.findall(m["attrs"])) if m["attrs"] else ""
            inside = any(x[3] == 2 for x in stack)
            furniture = bool(names and FURNITURE.search(names)) and tag not in ("html", "body", "article", "main")
            if furniture and not inside and MAIN.search(names) and tag in ("div", "section") and not re.search(r"comment|sidebar|footer|related", names, re.I):
                furniture = False
            drop = tag in DROP or furniture or bool(m["attrs"] and HIDDEN.search(m["attrs"]))
            head = tag == "header" and inside
            if head:
                drop = False
            rank = 0
            if tag == "article" and re.search(r"comment|related|teaser|promo|card", names, re.I):
                drop = True
            elif tag == "article":
                if any(x[0] == "nav" for x in stack):  # a menu that was never closed
                    pop(next(i for i, x in enumerate(stack) if x[0] == "nav"), m.start())
                rank = 2
            elif tag == "main" or "main" in names.lower().split() or tag in ("div", "section") and names and MAIN.search(names) and not furniture:
                rank = 1
            if rank:
                mains.append(m.start())
            stack.append((tag, m.start(), drop, rank, head))
            held.append([0, 0])
        if pos < len(s):
            if not parts:
                start = pos
            add(s[pos:])
        flush()
        pop(0, len(s))

    def text(self) -> str:
        """The blocks of the best-ranked part: the article, else what is marked as main, else all that isn't furniture."""
        kept = [x for x in self.blocks if not x[2]]
        best = max((x[1] for x in kept), default=0)
        if not self.names:
            return "\n".join(x[0] for x in kept)
        return "\n".join(x[0] for x in kept if x[1] == best)


def host_of(column: str = "url"):
    """Lower-case host of a URL without port; null or odd URLs share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(column), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_key():
    return F.xxhash64(F.coalesce("html", F.lit("")))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, subtree, around): the different container subtrees of each page, each with the hash of its surroundings; ``page`` is a hash of its html."""

    def run(batches):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            hosts, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            flat = [(host, key, h, around - (1 << 63)) for host, key, x in zip(hosts, keys, batch.column(2).to_pylist()) for h, around in Page(x or "").subtrees]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat) if flat else ((),) * 4, kinds)], ["host", "page", "subtree", "around"])

    return pages.select(host_of().alias("host"), page_key().alias("page"), "html").mapInArrow(run, "host string, page long, subtree long, around long").distinct()


def templates(found: DataFrame, min_pages: int = 5) -> DataFrame:
    """(host, subtree) of ``found`` (host, page, subtree, around): those in ``min_pages`` different surroundings, whatever the size of the host.

    Pages with the same main text count once, so a page and its copies do not make each other a template.
    """
    return found.select("host", "subtree", "around").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "subtree")


def extract(pages: DataFrame, min_pages: int = 5, names: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html); null html is empty, text then ''.

    Templates meet the pages as rows (host, subtree); gathered are only those that stand on one page. Tables are written
    before they are joined, so that a hot host or a page with very many copies can be split. Without ``names`` the
    templates decide alone.
    """
    found = durable(subtrees(pages))
    recurring = durable(templates(found, min_pages))
    cuts = durable(found.join(recurring, ["host", "subtree"]).groupBy("host", "page").agg(F.collect_set("subtree").alias("cut")))
    release(found, recurring)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"), page_key().alias("page")).join(cuts, ["host", "page"], "left")

    def run(batches):
        for batch in batches:
            cuts = batch.column(3).to_pylist()
            texts = [Page(h or "", frozenset(c or ()), names).text() for h, c in zip(batch.column(2).to_pylist(), cuts)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "cut").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(pages: DataFrame) -> DataFrame:
    """``extract`` with production parameters; null and empty html give an empty text, repeated rows are pages of their own."""
    return extract(pages)
