"""Operator 5: main text of web pages, with site templates removed.

A tolerant one-pass parser makes a tree of every element of a page, before any rule
looks at tags or classes.  Then, in this order:

1. Site templates.  The subtree of every block element, whatever its tag, is hashed
   together with the page's host.  Hashes are counted over all pages in Spark (once
   a distinct page body, so that copies of an article make no template; map-side
   combined, so a host with a third of all pages is no hot key).  Subtrees found in
   at least ``MIN_PAGES`` bodies and ``MIN_PERCENT`` percent of their host's bodies
   are deleted.
2. What is left is judged by tag, role and class: elements that never hold main text
   (navigation, footers, sidebars, forms, adverts, notices, reader comments) go.
3. If the page marks its article (``main`` or ``article``, else a content container),
   only that is taken, else all that is left.

A body is the main text without step 1.  Where templates hold more than
``MOST_PERCENT`` percent of it, as in copies that differ in a few words, the main text
keeps them; so a page of almost only unmarked boilerplate keeps it.  Inside a marked
article only containers can be templates; a paragraph that many articles quote stays.
``n_template`` and ``n_ruled`` tell how many code points of a page went by step 1, and
by steps 2 and 3.  Template hashes are stored as sorted arrays in the shared folder
and memory-mapped by the second pass, so pages are never shuffled.

Blocks are decoded, their white space turned into single spaces, trimmed, and
joined by an empty line.

Defined cases: a null or empty html, or one without text, gives the empty text;
a null url is the host "" ; rows equal in page_id are pages each; unclosed,
misnested and unknown tags are tolerated, an unclosed script, style or comment
reaches to the end, and elements nested deeper than ``MAX_DEPTH`` count as siblings,
so that any html takes linear time; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lazily, cut, map_shared, open_shared, remove_shared, shared_dir, small_batches

MIN_PAGES, MIN_PERCENT, MOST_PERCENT = 5, 5, 75
MAX_DEPTH = 512
#: Tags whose attributes have an unclosed quote are read again without quotes; after so many, all are.
MAX_UNCLOSED = 100

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]++)*+)>""", re.S)
_UNQUOTED = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
_DROP = frozenset("head nav footer aside form button select dialog menu object svg canvas audio video map label input datalist".split())
#: Start tags that end an open element of the given kinds.
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption", "summary", "legend"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"}}
#: An implied end never reaches beyond these.
_FENCE = frozenset("article body div main section table ul ol dl blockquote header footer nav aside form html".split())
#: What can be a template even inside a marked article.
_CONTAINERS = frozenset("div section ul ol dl table figure details center fieldset address header footer nav aside form menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())


def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])")


#: Class or id words of what is never part of an article.
_NEVER = _named(r"ads?|adverts?|advertising|advertisements?|adslot|adsense|sponsor(?:ed|s)?|promos?|cookies?|consent|gdpr|notices?|popups?|modals?|newsletters?|subscribe|signup|login|comments?|commentlist|disqus|shar(?:e|ing)|social|breadcrumbs?|pagination|pager")
#: Those that mean so only outside a marked article.
_OUTSIDE = _named(r"banners?|promotions?|alerts?|overlays?|subscription|commentary|respond|repl(?:y|ies)|related|recommend(?:ed|ations?)?|trending|copyright")
#: Those of layout, which may still enclose an article.
_LAYOUT = _named(r"menus?|nav|navbar|navigation|sidebars?|side|masthead|header|footer|topbar|toolbar|widgets?|skip|search|site-info")
_CONTENT = _named(r"content|article|post|entry|story|body-text|main-text|article-body|post-body|entry-content")
_MARKED = 2


def _judge(tag: str, attributes: str, dropped: int, region: int) -> tuple[int, int]:
    """Whether an element is dropped (0 no, 1 by layout, 2 for good), and how surely its text is the article (2 marked, 1 content)."""
    if tag in _DROP:
        return 2, region
    names = role = ""
    if attributes.strip():
        a = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
        names, role = f"{a.get('class', '')} {a.get('id', '')}".strip(), a.get("role", "")
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
            return 2, region
    if tag in ("html", "body"):
        return dropped, region
    if role in _ROLES or (names and _NEVER.search(names)):
        return 2, region
    if tag in ("article", "main") or role == "main":
        return 0, _MARKED
    if region < _MARKED:
        if names and _OUTSIDE.search(names):
            return 2, region
        if tag == "header" or (names and _LAYOUT.search(names)):
            return 1, region
        if names and _CONTENT.search(names) and not dropped:
            return 0, 1
    return dropped, region


class Page:
    """The tree of a page: elements, parents first, and pieces of text that know their element and block."""

    def __init__(self, html: str, host: str = ""):
        self._seed = hashlib.blake2b(host.encode("utf-8", "replace"), digest_size=16).digest()
        self.parents: list[int] = []
        self.hashes: list[int] = []  # of the subtree and host; 0 without text, and where no template can be
        self.judged: list[tuple[int, int]] = []
        self.pieces: list[tuple[int, str, int]] = []  # block, text, element
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int, list[bytes]]] = [("", -1, [])]  # tag, element, parts of its hash
        flat: Counter[str] = Counter()  # open elements below MAX_DEPTH, which are not on the stack
        block, at, last, token, unclosed = 0, 0, html.rfind(">"), _TOKEN, 0

        def say(piece: str) -> None:
            if "&" in piece:
                piece = unescape(piece)
            self.pieces.append((block, piece, stack[-1][1]))
            if words := piece.split():
                stack[-1][2].append(" ".join(words).encode("utf-8", "replace"))

        def close(down_to: int) -> None:
            nonlocal block
            while len(stack) > down_to:
                tag, element, parts = stack.pop()
                block += tag in _BLOCK
                if parts:
                    digest = hashlib.blake2b(b"\0".join((tag.encode("utf-8", "replace"), *parts)), digest_size=8, key=self._seed).digest()
                    stack[-1][2].append(digest)
                    dropped, region = self.judged[element]
                    if tag in _BLOCK and tag not in ("html", "body") and (tag in _CONTAINERS or region < _MARKED):
                        self.hashes[element] = int.from_bytes(digest, "little", signed=True)

        while (lt := html.find("<", at)) >= 0:
            mark = html[lt + 1 : lt + 2]
            if lt > last and mark not in ("!", "?"):
                break  # no tag ends after this
            m = token.match(html, lt)
            if m is None and (mark.isalpha() or mark == "/"):
                m = _UNQUOTED.match(html, lt)
                unclosed += m is not None
                if unclosed == MAX_UNCLOSED:
                    token = _UNQUOTED
            if m is None:
                say(html[at : lt + 1])
                at = lt + 1
                continue
            if lt > at:
                say(html[at:lt])
            at, tag = m.end(), m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:  # end tag
                if tag == "br":
                    say(" ")
                elif flat[tag]:
                    flat[tag] -= 1
                    block += tag in _BLOCK
                else:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            close(i)
                            break
                        if stack[i][0] in _FENCE and tag not in _FENCE:
                            break
                continue
            if tag in _RAW:
                if not m[3].endswith("/") or tag in ("script", "style"):
                    end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                    at = end.end() if end else len(html)
                if tag in ("textarea", "iframe"):
                    say(" ")
                continue
            if tag in _VOID:
                if tag == "hr":
                    block += 1
                elif tag == "br":
                    say(" ")
                continue
            if tag in _BLOCK:
                block += 1
                ended = _ENDS.get(tag)
                for i in range(len(stack) - 1, 0, -1):
                    above = stack[i][0]
                    if (tag in _ENDS_P and above == "p") or (ended and above in ended):
                        close(i)
                        if above == "p":
                            continue
                        if not (ended and len(ended) > 2):
                            break
                    elif above in _FENCE:
                        break
            elif m[3].endswith("/"):
                continue
            elif tag in _DROP:
                say(" ")
            if len(stack) > MAX_DEPTH:
                flat[tag] += 1
                continue
            parent = stack[-1][1]
            dropped, region = self.judged[parent] if parent >= 0 else (0, 0)
            self.judged.append((dropped, region) if dropped == 2 else _judge(tag, m[3], dropped, region))
            self.parents.append(parent)
            self.hashes.append(0)
            stack.append((tag, len(self.parents) - 1, []))
        if at < len(html):
            say(html[at:])
        close(1)

    def _main(self, gone: list[bool]) -> tuple[str, int, int]:
        """Main text without the elements that are gone; code points of blocks that went with them, and by rule."""
        region = [self.judged[e] if e >= 0 else (0, 0) for _, _, e in self.pieces]
        best = max((r for (dropped, r), (_, piece, e) in zip(region, self.pieces) if not dropped and not (e >= 0 and gone[e]) and not piece.isspace()), default=0)
        blocks, texts, lost = [], [], [0, 0]
        at, of = [], -1
        for (dropped, r), (block, piece, e) in zip(region, self.pieces):
            if e >= 0 and gone[e]:
                lost[0] += len(" ".join(piece.split()))
            elif dropped or r != best:
                lost[1] += len(" ".join(piece.split()))
            else:
                if block != of:
                    at, of = [], block
                    blocks.append(at)
                at.append(piece)
        for at in blocks:
            if words := "".join(at).split():
                texts.append(" ".join(words))
        return "\n\n".join(texts), *lost

    def subtrees(self) -> set[int]:
        """Hashes, with the host, of the subtrees that may be templates."""
        return set(self.hashes) - {0}

    def body(self) -> int:
        """Hash of the main text with templates."""
        return int.from_bytes(hashlib.blake2b(self.text().encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        return self.judge(templates)[0]

    def judge(self, templates: frozenset[int] | set[int] = frozenset()) -> tuple[str, int, int]:
        """Main text, code points of templates, and code points dropped by rule."""
        gone: list[bool] = []
        for parent, k in zip(self.parents, self.hashes):
            gone.append((parent >= 0 and gone[parent]) or (k != 0 and k in templates))
        whole = self._main([False] * len(gone))
        if not any(gone):
            return whole
        rest = self._main(gone)
        if 100 * len(rest[0]) >= (100 - MOST_PERCENT) * len(whole[0]):
            return rest
        # the main text keeps its templates; those elsewhere go
        return whole


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _host_key(host: str) -> int:
    return int.from_bytes(hashlib.blake2b(host.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, bodies, keys = [], [], []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host = host_of(url)
            page, of = Page(html or "", host), _host_key(host)
            own = [of, *page.subtrees()]
            keys += own
            hosts += [of] * len(own)
            bodies += [page.body()] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(bodies, pa.int64()), pa.array(keys, pa.int64())], names=["host", "body", "k"])


def _store(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        path = f"{folder}/templates-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        with open_shared(path, "wb") as f:
            f.write(np.sort(table["k"].to_numpy()).astype("<i8").tobytes())
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path]})

    return run


def find_templates(pages: DataFrame, folder: str, min_pages: int = MIN_PAGES, min_percent: int = MIN_PERCENT) -> tuple[int, dict[int, str]]:
    """Stores the hashes of recurring subtrees; number of shards, and their files."""
    spark = pages.sparkSession
    small_batches(spark, rows=500)
    shards = max(8, pages.rdd.getNumPartitions())
    found = pages.select("url", "html").mapInArrow(_count, "host long, body long, k long").distinct()
    counts = found.groupBy("host", "k").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {int(min_pages)} or host = k")
    counts = cut(counts)
    totals = counts.where("host = k").select("host", F.col("n").alias("of"))
    often = counts.where("host <> k").join(totals, "host").where((F.col("n") >= min_pages) & (100 * F.col("n") >= min_percent * F.col("of")))
    dealt = often.select("k", F.pmod("k", F.lit(shards)).cast("int").alias("shard"))
    rows = cut(dealt.groupBy("shard").applyInArrow(_store(folder), "shard int, path string")).collect()
    return shards, {r["shard"]: r["path"] for r in rows}


_RESULT = "page_id long, url string, text string, n_chars long, n_template long, n_ruled long"


def _extract(shards: int, paths: dict[int, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = Lazily(lambda path: map_shared(path, "<i8"), paths)

        def templates(keys: np.ndarray) -> set[int]:
            found: set[int] = set()
            shard = keys % shards
            for s in np.unique(shard).tolist():
                if s in maps and len(maps[s]):
                    table, own = maps[s], np.sort(keys[shard == s])
                    place = np.minimum(np.searchsorted(table, own), len(table) - 1)
                    found.update(own[table[place] == own].tolist())
            return found

        for batch in batches:
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns[:3])):
                tree = Page(html or "", host_of(url))
                rows.append((page, url, *tree.judge(templates(np.array(list(tree.subtrees()), np.int64)))))
            page, url, texts, template, ruled = zip(*rows) if rows else ([],) * 5
            longs = [pa.array(x, pa.int64()) for x in (page, [len(t) for t in texts], template, ruled)]
            yield pa.RecordBatch.from_arrays([longs[0], pa.array(url, pa.string()), pa.array(texts, pa.string()), *longs[1:]], names=["page_id", "url", "text", "n_chars", "n_template", "n_ruled"])

    return run


def main_text(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, url, text, n_chars, n_template, n_ruled."""
    shards, paths = find_templates(pages, folder)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return src.mapInArrow(_extract(shards, paths), _RESULT)


def extract(pages: DataFrame) -> DataFrame:
    """``main_text`` with the templates kept only for the run."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/templates-{uuid.uuid4().hex}"
    out = cut(main_text(pages, folder))
    remove_shared(spark, folder)
    return out
