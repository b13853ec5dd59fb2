"""Main text of web pages.

Method: host suffix array. The pages of a host are read in windows. The token streams of a window are concatenated, with an end mark
after every block, and its suffixes are sorted by their first tokens (prefix doubling); the runs of tokens found are joined over all windows of
the host. On a page without an article, runs that occur on distinct pages are boilerplate, and a block that they cover is removed. Inside an
article, documents share lines and passages, so only runs on clearly most of the host's distinct articles are: these are its notices. Markup
decides what is never text: menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts and styles.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm import text_kernel as tk
from eventide.llm.tables import written
from eventide.llm.url_filter import host_of

ARTICLE, PLAIN = 2, 1
#: Of the hashes of runs of tokens.
BASE = np.uint64(0xD6E8FEB86659FD93)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: Elements whose content is never text of the page.
SKIPPED = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "canvas", "iframe", "object", "select", "button", "textarea", "datalist", "audio", "video", "map"}
#: Elements that stand beside the article.
BESIDE = {"nav", "footer", "aside", "header", "menu", "dialog", "search"}
BESIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}
#: Class and id names that mark what stands beside the article. A whole name counts, alone or between words that say where or what
#: kind of box it is; a part of another name (has-sidebar, article-header) does not.
_WHERE = r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|sticky|mobile|js|block|section|widget|post|user|reader)[-_])*"
_BOX = (
    r"(?:[-_](?:\d+|\w|box|bar|slot|banner|unit|area|block|section|container|wrapper|wrap|outer|inner|list|items?|links?|buttons?|icons?|menu|nav|notice|text|popup|"
    r"modal|overlay|message|form|thread|panel|widget|content|top|bottom|left|right))*"
)
_BESIDE_NAMES = (
    r"ads?|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side[-_]bar|aside|widgets?|footer|foot|masthead|topbar|header|"
    r"comments?|commentlist|disqus|discussion|replies|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|skip[-_]?link"
)
_BESIDE_NAME = re.compile(rf"{_WHERE}(?:{_BESIDE_NAMES}){_BOX}", re.I)
_HEADER_NAME = re.compile(rf"(?:(?:article|post|entry|story|content)[-_])?header{_BOX}", re.I)
#: How an element stands beside the article: not at all, by a name or as a form (an article inside it is kept if there is no other), by its kind.
_IN, _NAMED, _OUT = 0, 1, 2
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A start tag of the first kind ends an open element of the second kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_INLINE_SPACE = {"br", "img", "input", "wbr"}
_SKIP_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED}


def _beside(name: str, attributes: str, in_article: bool) -> int:
    """_IN, _NAMED or _OUT. Inside an article a header is part of it."""
    if name == "form":
        return _NAMED
    if name in BESIDE and not (name == "header" and in_article):
        return _OUT
    if not attributes or name in ("html", "body", "article", "main"):
        return _IN
    out = _IN
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and any(_BESIDE_NAME.fullmatch(n) and not (in_article and _HEADER_NAME.fullmatch(n)) for n in value.split()):
            out = _NAMED
        if key == "role" and value.lower() in BESIDE_ROLES:
            return _OUT
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return _OUT
    return out


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, place) of the blocks of a page in order, without what stands beside the article; place: ARTICLE inside an
    article or main element, else PLAIN. White space is one space, character references are decoded.

    An element that a class or id name puts beside the article, or a form, may enclose the only article of a page: if no other
    article has text, the articles inside such elements are taken, and then articles with all that names alone took from them.
    """
    for names, enclosed in ((True, False), (True, True), (False, True)):
        out = _blocks(page, names, enclosed)
        if any(place == ARTICLE for _, place in out) or not _ARTICLE_TAG.search(page):
            return out
    return _blocks(page, True, False)


_ARTICLE_TAG = re.compile(r"<(?:article|main)\b|role\s*=\s*[\"']?main\b", re.I)


def _blocks(page: str, names: bool, enclosed: bool) -> list[tuple[str, int]]:
    """One reading of a page. `names`: class and id names count inside an article; `enclosed`: an article ends what names and forms
    around it put beside."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, beside the article, article
    beside = article = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, ARTICLE if article else PLAIN))
            parts.clear()

    def leave(depth: int) -> None:
        nonlocal beside, article
        while len(stack) > depth:
            _, b, a = stack.pop()
            beside -= b != _IN
            article -= a

    at = 0
    while m := _TAG.search(page, at):
        if not beside and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCKS:
            flush()
        elif name in _INLINE_SPACE:
            parts.append(" ")
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                leave(depth)
            continue
        if name in SKIPPED:
            end = _SKIP_END[name].search(page, at)
            if end or name not in ("head", "title"):
                at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in CLOSES and stack and stack[-1][0] in CLOSES[name]:
            leave(len(stack) - 1)
        elif name in BLOCKS and stack and stack[-1][0] == "p":
            leave(len(stack) - 1)
        a = name in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b", m[3]))
        if a and enclosed:
            stack[:] = [(n, _IN if b == _NAMED else b, was) for n, b, was in stack]
            beside = sum(b != _IN for _, b, _ in stack)
        b = _beside(name, m[3], bool(article))
        if b == _NAMED and article and not names:
            b = _IN
        a = a and not beside
        stack.append((name, b, a))
        beside += b != _IN
        article += a
    if not beside:
        parts.append(page[at:])
    flush()
    return out


def _sorted_runs(tokens: np.ndarray, page: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of every run of `length` tokens within a page, first index, size of each group of equal runs), in suffix order.

    The suffixes are sorted by their first `length` tokens: ranks are doubled from one token on, and the last step
    overlaps so that exactly `length` tokens count. Suffixes of equal rank share that prefix; they are ordered by page.
    """
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < length:
        step = min(have, length - have)
        after = np.full(n, -1, np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    start = np.flatnonzero(page[: n - length + 1] == page[length - 1 :])
    start = start[np.lexsort((page[start], rank[start]))]
    r = rank[start]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else none
    return start, first, np.diff(np.append(first, len(r)))


def _covered(start: np.ndarray, n: int, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray, length: int) -> np.ndarray:
    """Which tokens lie in a substring of `length` tokens or more that occurs on two pages. A substring lies within a page."""
    start, first, size = _sorted_runs(tokens, page, length)
    several = np.repeat(page[start[first]] != page[start[first + size - 1]], size)
    return _covered(start[several], len(tokens), length)


def _run_hashes(tokens: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes, as signed numbers, of the runs of `length` tokens at start."""
    out = np.zeros(len(start), np.uint64)
    for j in range(length):
        out = out * BASE + tokens[start + j]
    return tk.mix(out).view(np.int64)


def _stream(found: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, their pages, their blocks) of the texts of blocks of pages, an end mark after every block."""
    owner = np.repeat(np.arange(len(found)), [len(page) for page in found])
    tokens, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, end, data, offsets in tk.chunks(pa.array([text for page in found for text in page], pa.large_string())):
        starts, ends, block = tk.words(data, offsets, tk.NOT_WHITE)
        marks = np.arange(end - first)
        hashes = np.concatenate([tk.span_hashes(tk.prefix_hashes(data), starts, ends), np.ones(len(marks), np.uint64)])
        where = np.concatenate([block, marks])
        by = np.argsort(where, kind="stable")
        tokens.append(hashes[by])
        of.append(where[by] + first)
    of = np.concatenate(of)
    return np.concatenate(tokens), owner[of], of


def _pages_of_runs(tokens: np.ndarray, page: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of one run of each distinct kind, number of pages on which it occurs)."""
    start, first, _ = _sorted_runs(tokens, page, length)
    if not len(start):
        return start, first
    new = np.ones(len(start), np.int64)
    new[1:] = page[start[1:]] != page[start[:-1]]
    new[first] = 1
    return start[first], np.add.reduceat(new, first)


def _most(n, articles):
    """Whether n of a host's articles are more than half of them by two standard errors: 5 of 5, 9 of 10, 61 of 100."""
    return n > articles / 2 + articles**0.5


def _without_notices(article: list[str], notices: np.ndarray, length: int, share: float) -> list[str]:
    """The blocks of an article of which less than `share` of the tokens are covered by the host's notices. All of them when the
    others hold most of its tokens: it is a copy or an edition of other articles, and no notice."""
    tokens, _, of = _stream([article])
    start = np.arange(max(0, len(tokens) - length + 1))
    covered = _covered(start[np.isin(_run_hashes(tokens, start, length), notices)], len(tokens), length)
    kept = _left([article], covered, of, share)[0]
    return kept if 2 * sum(len(t.split()) for t in kept) >= sum(len(t.split()) for t in article) else article


def _left(found: list[list[str]], covered: np.ndarray, of: np.ndarray, share: float) -> list[list[str]]:
    """The blocks of each page of which less than `share` of the tokens are covered, or all of them when nothing would be left."""
    n = sum(len(page) for page in found)
    part = np.bincount(of, covered, n) / np.maximum(np.bincount(of, minlength=n), 1)
    out, at = [], 0
    for page in found:
        out.append([text for j, text in enumerate(page) if part[at + j] < share] or page)
        at += len(page)
    return out


def main_texts(pages: list[str], length: int = 8, share: float = 0.9) -> list[tuple[str, int]]:
    """(text, blocks removed) of each page, where these are all pages of one host.

    A page with an article keeps the blocks in it, without the notices that stand on most distinct articles. Any other page keeps the
    blocks of which less than `share` of the tokens are covered by substrings that other pages repeat, or all of its blocks when nothing
    would be left.
    """
    found = [blocks(p) for p in pages]
    texts = [[text for text, _ in page] for page in found]
    tokens, page, of = _stream(texts)
    left = _left(texts, repeated(tokens, page, length), of, share)
    articles = [[text for text, place in page if place == ARTICLE] for page in found]
    distinct = [list(a) for a in dict.fromkeys(map(tuple, articles)) if a]
    tokens, page, _ = _stream(distinct)
    start, n = _pages_of_runs(tokens, page, length)
    notices = _run_hashes(tokens, start[_most(n, len(distinct))], length)
    kept = [_without_notices(a, notices, length, share) if a else rest for a, rest in zip(articles, left, strict=True)]
    return [("\n".join(k), len(page) - len(k)) for k, page in zip(kept, found, strict=True)]


OUT = "page_id long, url string, text string, n_chars long, blocks_removed long"


def _named(pages: DataFrame) -> DataFrame:
    """page_id, url, page_host, page_key, html. A page is named by its host and a hash of its id, url and html."""
    key = F.xxhash64("page_id", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    return pages.select("page_id", "url", host_of(F.coalesce("url", F.lit(""))).alias("page_host"), key.alias("page_key"), "html")


def _parsed(rows: DataFrame) -> DataFrame:
    """The blocks of every named page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [blocks(h.as_py() or "") for h in part.column(4)]
                columns = [
                    *(part.column(i) for i in range(4)), pa.array([any(p == ARTICLE for _, p in page) for page in found], pa.bool_()),
                    pa.array([[p == ARTICLE for _, p in page] for page in found], pa.list_(pa.bool_())), pa.array([[t for t, _ in page] for page in found], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "page_host", "page_key", "has_article", "in_article", "texts"])

    return rows.mapInArrow(read, "page_id long, url string, page_host string, page_key long, has_article boolean, in_article array<boolean>, texts array<string>")


def _articles(rows: DataFrame, length: int, share: float) -> DataFrame:
    """Rows with `html` and `notices` (runs of the host or null) in place of them with `article`, the blocks of the article without
    notices, and n_blocks; only those with an article."""
    keys = [c for c in rows.columns if c not in ("html", "notices")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [blocks(h.as_py() or "") for h in part.column("html")]
                articles = [[text for text, place in page if place == ARTICLE] for page in found]
                notices = part.column("notices").to_pylist()
                kept = [_without_notices(a, np.array(n), length, share) if a and n else a for a, n in zip(articles, notices, strict=True)]
                columns = [*(part.column(c) for c in keys), pa.array(kept, pa.list_(pa.string())), pa.array([len(page) for page in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "article", "n_blocks"]).filter(pa.array([bool(a) for a in articles]))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keys)
    return rows.mapInArrow(read, f"{schema}, article array<string>, n_blocks long")


def _article_runs(articles: DataFrame, length: int, window_chars: int) -> DataFrame:
    """page_host, run, n of every window of a host's distinct articles: their number (run null), and the runs on more than half of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, last = [], 0, None
        for batch in batches:
            for host, part, key, article in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, part, key) == last:
                    continue
                if held and ((host, part) != last[:2] or chars >= window_chars):
                    yield done(last[0], held)
                    held, chars = [], 0
                last = host, part, key
                held.append(article)
                chars += sum(map(len, article))
        if held:
            yield done(last[0], held)

    def done(host: str, held: list[list[str]]) -> pa.RecordBatch:
        tokens, page, _ = _stream(held)
        start, n = _pages_of_runs(tokens, page, length)
        often = 2 * n > len(held)
        columns = [
            pa.array([host] * (1 + int(often.sum())), pa.string()), pa.array([None, *_run_hashes(tokens, start[often], length).tolist()], pa.int64()),
            pa.array([len(held), *n[often].tolist()], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["page_host", "run", "n"])

    return articles.select("page_host", "part", "article_key", "article").mapInArrow(read, "page_host string, run long, n long")


def _held(articles: DataFrame, length: int) -> DataFrame:
    """page_host, article_key, run: which of `runs` each article holds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = []
                for article, runs in zip(part.column("article").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    tokens = _stream([article])[0]
                    start = np.arange(max(0, len(tokens) - length + 1))
                    held.append(np.intersect1d(_run_hashes(tokens, start, length), runs).tolist())
                yield pa.RecordBatch.from_arrays([part.column("page_host"), part.column("article_key"), pa.array(held, pa.list_(pa.int64()))], ["page_host", "article_key", "held"])

    held = articles.mapInArrow(read, "page_host string, article_key long, held array<long>")
    return held.select("page_host", "article_key", F.explode("held").alias("run"))


def _notices(rows: DataFrame, window: int, window_chars: int, length: int, share: float) -> DataFrame:
    """page_host, notices: the runs that stand on most distinct articles of a host.

    Each distinct article belongs to one window of its host. What stands on more than half of all articles stands on more than half of
    some window's, so the windows name few candidates, whose articles are counted over the whole host.
    """
    none = F.lit(None).cast("array<long>").alias("notices")
    large = written(rows.groupBy("page_host").agg(F.ceil(F.count("*") / window).alias("parts")).filter("parts > 1"), "large_hosts")
    articles = _articles(rows.join(large, "page_host", "left").select("page_host", "parts", "html", none), length, share)
    key = F.xxhash64("article")
    dealt = articles.select("page_host", F.pmod(key, F.coalesce("parts", F.lit(1))).alias("part"), key.alias("article_key"), "article")
    dealt = dealt.repartition("page_host", "part").sortWithinPartitions("page_host", "part", "article_key")
    found = written(_article_runs(dealt, length, window_chars), "article_runs")
    totals = found.filter("run is null").groupBy("page_host").agg(F.sum("n").alias("articles")).filter(_most(F.col("articles"), F.col("articles")))
    often = written(found.filter("run is not null").join(totals, "page_host").groupBy("page_host", "articles").agg(F.collect_set("run").alias("runs")), "frequent_runs")
    holders = _articles(rows.join(often, "page_host").select("page_host", "articles", "runs", "html", none), length, share)
    counts = _held(holders.select("page_host", key.alias("article_key"), "runs", "article"), length).groupBy("page_host", "run").agg(F.count_distinct("article_key").alias("n"))
    notices = counts.join(often.select("page_host", "articles"), "page_host").filter(_most(F.col("n"), F.col("articles")))
    return written(notices.groupBy("page_host").agg(F.collect_list("run").alias("notices")), "notices")


def _window_runs(evidence: DataFrame, length: int, window: int, window_chars: int) -> DataFrame:
    """page_host, run, low, high: each distinct run of a window of a host's pages, with the lowest and highest page it stands on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, host, chars = [], None, 0
        for batch in batches:
            for page_host, key, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (page_host != host or len(held) >= window or chars >= window_chars):
                    yield done(host, held)
                    held, chars = [], 0
                host = page_host
                held.append((key, texts))
                chars += sum(map(len, texts))
        if held:
            yield done(host, held)

    def done(host: str, held: list[tuple]) -> pa.RecordBatch:
        keys = np.array([k for k, _ in held], np.int64)  # ascending, as sorted
        tokens, page, _ = _stream([t for _, t in held])
        start, first, size = _sorted_runs(tokens, page, length)
        low, high = start[first], start[first + size - 1]
        columns = [pa.array([host] * len(first), pa.string()), pa.array(_run_hashes(tokens, low, length)), pa.array(keys[page[low]]), pa.array(keys[page[high]])]
        return pa.RecordBatch.from_arrays(columns, ["page_host", "run", "low", "high"])

    rows = evidence.select("page_host", "page_key", "texts")
    return rows.repartitionByRange("page_host", "page_key").sortWithinPartitions("page_host", "page_key").mapInArrow(read, "page_host string, run long, low long, high long")


def _page_runs(plain: DataFrame, length: int) -> DataFrame:
    """page_host, page_key, run, start: every run of every page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, key, texts in zip(*batch.columns, strict=True):
                tokens = _stream([texts.as_py()])[0]
                start = np.arange(max(0, len(tokens) - length + 1))
                columns = [pa.array([host.as_py()] * len(start), pa.string()), pa.array([key.as_py()] * len(start), pa.int64()), pa.array(_run_hashes(tokens, start, length)), pa.array(start)]
                yield pa.RecordBatch.from_arrays(columns, ["page_host", "page_key", "run", "start"])

    return plain.select("page_host", "page_key", "texts").mapInArrow(read, "page_host string, page_key long, run long, start long")


def _texts(rows: DataFrame, length: int, share: float) -> DataFrame:
    """The result of rows with page_id, url, texts and starts of repeated runs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, removed = [], []
            for texts, starts in zip(batch.column(2), batch.column(3), strict=True):
                texts = texts.as_py()
                tokens, _, of = _stream([texts])
                kept = _left([texts], _covered(np.array(starts.as_py() or [], np.int64), len(tokens), length), of, share)[0]
                text.append("\n".join(kept))
                removed.append(len(texts) - len(kept))
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "blocks_removed"])

    return rows.mapInArrow(read, OUT)


def extract(pages: DataFrame, window: int = 256, window_chars: int = 8_000_000, length: int = 8, share: float = 0.9) -> DataFrame:
    """page_id, url, text, n_chars, blocks_removed of every page.

    Every page is evidence. Articles are dealt out by (host, window) in windows of about `window` pages (and window_chars characters), and
    what stands on most distinct articles of a host goes from them. For hosts with other pages, rows are dealt out by ranges of (host, page),
    and each window of a host gives its distinct runs, so that what is added up by (host, run) is one row per window and run. Runs on two or
    more distinct pages of the host, whatever their windows, come back to the pages by an equi-join; neither windows nor partitions change the result. Null html is
    empty html, with an empty text; a null url counts to the empty host. Rows that agree in id, url and html are one page as evidence and all kept;
    other columns are left behind; an empty table gives an empty one. Pages are parsed again where they are read again: written, their blocks
    and the shuffled articles would be twice the input.
    """
    rows = _named(pages)
    notices = _notices(rows, window, window_chars, length, share)
    articles = _articles(rows.join(notices, "page_host", "left").select("page_id", "url", "notices", "html"), length, share)
    text = F.array_join("article", "\n")
    marked = articles.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), (F.col("n_blocks") - F.size("article")).alias("blocks_removed"))
    hosts = written(_parsed(rows).filter("not has_article").select("page_host").distinct(), "plain_hosts")
    parsed = written(_parsed(rows.join(hosts, "page_host", "left_semi").select(*rows.columns)), "blocks")
    plain = parsed.filter("not has_article")
    evidence = parsed.dropDuplicates(["page_host", "page_key"])
    runs = _window_runs(evidence, length, window, window_chars).groupBy("page_host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = written(runs.filter("low <> high").select("page_host", "run"), "shared_runs")
    starts = _page_runs(plain.dropDuplicates(["page_host", "page_key"]), length).join(shared, ["page_host", "run"])
    starts = starts.groupBy("page_host", "page_key").agg(F.collect_list("start").alias("starts"))
    judged = plain.join(starts, ["page_host", "page_key"], "left").select("page_id", "url", "texts", "starts")
    return marked.union(_texts(judged, length, share))
