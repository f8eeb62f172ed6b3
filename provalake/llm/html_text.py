"""Main text of web pages: structure first, then a suffix array over each host's pages.

A page is cut into blocks. Text of elements that are never part of an article (menus, forms, adverts, scripts, comments ...)
goes. If the page marks its article, its blocks are candidates; if it doesn't, all that is left is. Then the pages of a host decide,
those with and those without a mark each among themselves: their token streams are put one after the other and their suffixes
sorted, and a run of MIN_TOKENS tokens or more that comes back on a good part of the distinct texts (SHARE of them, and
LEAST_PAGES at least) is the host's. In open text it goes wherever it stands, but never all of a page. In a marked article a heading or
passage that comes back is content, so only blocks go that are wholly the host's and whose element bears a name that makes it doubtful
("notice", "related-links" ...). All else stays: what a few pages share is a quotation or a copied article; copies of a page are one text.

A host may hold a third of all pages. Its texts are dealt by their hash into parts of about PART, each with a suffix array of its own; a
run that two texts of a part have is counted over the host. What SHARE of the host has, but only one text of a part of PART, is missed
in that one text; for texts dealt by hash the chance is below one in 10^9. So no task or group holds a whole host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.llm.common import mix64, stored

MIN_TOKENS = 8
#: A run is boilerplate when this share of the host's distinct texts has it, and so many of them at least.
SHARE, LEAST_PAGES = 0.25, 3
#: A host of so many distinct texts has one suffix array; one of at least twice as many has several.
PART = 128

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[a-z]+")

# Elements by what they mean for the text.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
BLOCKS = {"address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2",
          "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
CELLS = {"td", "th"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NAMED = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb",
         "breadcrumbs", "sidebar", "footer", "contentinfo", "complementary", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe",
         "signup", "popup", "modal", "overlay", "comment", "comments", "disqus", "replies", "share", "sharing", "social", "related", "recommended", "teaser", "widget",
         "search", "login", "pagination", "masthead"}
# Names that mean no part of the text even within an article, and two-word names of which only the pair does.
UNMISTAKABLE = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "navbar", "breadcrumb", "breadcrumbs", "sidebar", "cookies", "newsletter",
                "comments", "disqus", "share", "sharing", "pagination", "navigation", "contentinfo", "complementary", "search", "banner"}
COMPOUNDS = {"ad": {"slot", "box", "banner", "unit", "container", "wrapper", "block"}, "ads": {"box", "container", "wrapper"}, "share": {"bar", "buttons", "links", "icons"},
             "social": {"bar", "buttons", "links", "icons", "share", "media"}, "related": {"posts", "articles", "links", "stories", "news", "content"},
             "recommended": {"posts", "articles", "links", "stories"}, "comment": {"list", "section", "area", "thread", "form"}, "comments": {"list", "section", "area", "form"},
             "cookie": {"notice", "banner", "consent", "bar"}, "newsletter": {"signup", "form", "box"}, "search": {"box", "form", "bar"}, "nav": {"bar", "menu", "links"}}
# Which open elements a start tag ends, looked for no farther than an element of the second set.
_P_ENDERS = ("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
             "pre section summary table ul").split()
_P_BOUNDS = {"button", "caption", "table", "td", "th", "object", "template", "article", "section", "div", "li", "dd", "blockquote", "main", "aside", "nav", "form", "body"}
ENDS = {name: (({"p"}, _P_BOUNDS),) for name in _P_ENDERS} | {
    "li": (({"li"}, {"ul", "ol", "menu"}),), "dd": (({"dd", "dt"}, {"dl"}),), "dt": (({"dd", "dt"}, {"dl"}),), "option": (({"option"}, {"select", "datalist"}),),
    "td": (({"td", "th"}, {"tr", "table"}),), "th": (({"td", "th"}, {"tr", "table"}),), "tr": (({"tr"}, {"table", "tbody", "thead", "tfoot"}),)}
#: Elements that hold no article, so one that starts within them shows that their end tag is missing; others whose place is kept.
UNCLOSED = {"nav", "header", "menu", "button", "select", "head"}
TRACKED = {"option", "dir", "span"}


def _names(attributes: str) -> list[str]:
    return [name for m in _NAMES.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").lower().replace("_", "-").split()]


def _is_doubtful(attributes: str) -> bool:
    """Does any word of an element's class, id or role say that it may be no part of an article?"""
    return any(word in NAMED for name in _names(attributes) for word in _WORDS.findall(name))


def _is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    """Is the element no part of an article? Outside of one, any word of its class, id or role may say so; inside, only a whole name
    or a compound that can't mean anything else."""
    if tag in BOILERPLATE or tag == "header" and not in_article:
        return True
    if "=" not in attributes or tag in ("body", "html", "article", "main"):
        return False
    if in_article:
        return any(name in UNMISTAKABLE or len(w := name.split("-")) == 2 and w[1] in COMPOUNDS.get(w[0], ()) for name in _names(attributes))
    return _is_doubtful(attributes)


def _ended_by(start: str, open_: list[str]) -> int | None:
    """Place of the open element that ends because an element starts, although its end tag was left out."""
    for names, bounds in ENDS.get(start, ()):
        for k in range(len(open_) - 1, -1, -1):
            if open_[k] in names:
                return k
            if open_[k] in bounds:
                break
    return None


def blocks_of(page: str) -> tuple[list[str], bool]:
    """The blocks of a page that may be main text, and whether the page itself marks them as its article."""
    blocks, marked = _blocks(page)
    return [text for text, _ in blocks], marked


def _blocks(page: str) -> tuple[list[tuple[str, bool]], bool]:
    """`blocks_of`, and with each block whether all of it lies in doubtful elements of an article.

    Open elements are kept as in the HTML standard: end tags that may be left out are implied by what starts, an element ends with
    its parent, and an end tag without a start means nothing. What is skipped ends with its element. A menu or page header that is
    never closed ends where the article starts.
    """
    found: dict[str, list[tuple[str, bool]]] = {"article": [], "main": [], "": []}
    seen = {"article": False, "main": False}
    open_: list[str] = []
    parts: list[str] = []
    skipping: int | None = None  # place of the skipped element among the open ones
    doubtful: int | None = None  # place of the outermost doubtful one
    sure = False  # some part of the block lies in no doubtful element
    at = 0

    def flush() -> None:
        nonlocal sure
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found["article" if "article" in open_ else "main" if "main" in open_ else ""].append((text, not sure))
            parts.clear()
        sure = False

    def close(place: int) -> None:
        nonlocal skipping, doubtful
        del open_[place:]
        if skipping is not None and skipping >= place:
            skipping = None
        if doubtful is not None and doubtful >= place:
            doubtful = None

    while at < len(page):
        tag = _TAG.search(page, at)
        start = tag.start() if tag else len(page)
        if start > at and skipping is None:
            parts.append(page[at:start])
            sure = sure or doubtful is None and not page[at:start].isspace()
        if tag is None:
            break
        at = tag.end()
        name = tag[2] and tag[2].lower()
        if not name:
            continue
        closing = bool(tag[1])
        if name in RAW and not closing and not tag[3].endswith("/"):
            end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in BLOCKS or name in BOILERPLATE:
            flush()
        elif name in CELLS and skipping is None:
            parts.append(" ")
        if name in VOID or not (name in BLOCKS or name in BOILERPLATE or name in CELLS or name in TRACKED or "=" in tag[3] or name in open_):
            continue
        if closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k] == name:
                    close(k)
                    break
            continue
        place = _ended_by(name, open_)
        if place is not None:
            close(place)
        if name in seen and skipping is not None and open_[skipping] in UNCLOSED and not seen[name]:
            close(skipping)
        open_.append(name)
        if skipping is None:
            if _is_boilerplate(name, tag[3], "article" in open_):
                skipping = len(open_) - 1
            elif name in seen:
                seen[name] = True
            elif doubtful is None and "=" in tag[3] and "article" in open_ and _is_doubtful(tag[3]):
                doubtful = len(open_) - 1
    flush()
    for region in ("article", "main"):
        if seen[region]:
            return found[region] + (found["main"] if region == "article" and not found["article"] else []), True
    return found[""], False


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parsed = [_blocks(page) for page in batch["html"]]
        texts = ["\n".join(text for text, _ in blocks) for blocks, _ in parsed]
        ids = [xxhash.xxh3_64_intdigest(t) - 2**63 for t in texts]
        doubtful = [[k for k, (_, d) in enumerate(blocks) if d] for blocks, _ in parsed]
        yield batch.drop(columns="html").assign(text_id=ids, text=texts, marked=[m for _, m in parsed], doubtful=doubtful)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, text (blocks joined by a line feed), text_id (its hash), whether the page marks its article, and the
    numbers of its doubtful blocks."""
    host = F.lower(F.coalesce(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"),
                        F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(_parse, "page_id long, url string, host string, text_id long, text string, marked boolean, doubtful array<int>")


def suffix_heads(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a token stream in the order of their first `length` tokens, and each one's rank: suffixes with equal
    beginnings have equal ranks. Ranks of 1, 2, 4 ... tokens come from sorting pairs of ranks; -1 ends a stream early."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < length:
        step = min(done, length - done)
        later = np.full(len(rank), -1, np.int64)
        later[:-step] = rank[step:] if step < len(rank) else later[:-step]
        rank = np.unique(rank * (len(rank) + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
        done += step
    return np.argsort(rank, kind="stable"), rank


def _token_hashes(text: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64)


def _head_hashes(tokens: np.ndarray) -> np.ndarray:
    """A hash of the MIN_TOKENS tokens from each place on; only places that have so many."""
    n = len(tokens) - MIN_TOKENS + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(MIN_TOKENS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix64(tokens[j:n + j])
    return mix64(out).view(np.int64)


def shared_places(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From one suffix array over all texts: text, place and hash of every run of MIN_TOKENS tokens that `least` texts have, equal
    runs together and each in the order of texts."""
    streams = [_token_hashes(t) for t in texts]
    heads = [_head_hashes(t) for t in streams]
    # one stream: after each text as many distinct end marks as keep beginnings inside a text
    ends = np.arange(len(streams) * MIN_TOKENS, dtype=np.uint64).reshape(len(streams), MIN_TOKENS)
    tokens = np.concatenate([x for t, e in zip(streams, ends, strict=True) for x in (t, e)])
    inside = np.concatenate([np.arange(len(t) + MIN_TOKENS) < len(h) for t, h in zip(streams, heads, strict=True)])
    order, rank = suffix_heads(tokens, MIN_TOKENS)
    order = order[inside[order]]
    at = (np.cumsum(inside) - 1)[order]
    text = np.repeat(np.arange(len(heads)), [len(h) for h in heads])[at]
    place = np.concatenate([np.arange(len(h)) for h in heads])[at]
    starts = np.diff(rank[order], prepend=-1) != 0
    other = starts | (np.diff(text, prepend=-1) != 0)
    first = np.flatnonzero(starts)
    often = (np.add.reduceat(other.astype(np.int64), first) >= least)[np.cumsum(starts) - 1] if len(first) else starts
    return text[often], place[often], np.concatenate(heads)[at][often]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, int, dict[int, str]]]:
    """(host, marked, part), number of parts and texts by their hash; rows come in the order of these keys."""
    key, parts, texts = None, 1, {}
    for batch in batches:
        for host, marked, part, n, text_id, text in zip(*(batch[c] for c in ("host", "marked", "part", "parts", "text_id", "text")), strict=True):
            if key != (host, marked, part):
                if texts:
                    yield key, parts, texts
                key, parts, texts = (host, marked, part), n, {}
            texts[text_id] = text
    if texts:
        yield key, parts, texts


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of the host's runs by text, without a head, where a part is a whole host; else of the part's runs by text and head."""
    for (host, marked, _), parts, texts in _parts(batches):
        if parts == 1 and len(texts) < LEAST_PAGES:
            continue
        text, place, head = shared_places(list(texts.values()), 2 if parts > 1 else int(max(LEAST_PAGES, np.ceil(SHARE * len(texts)))))
        found = pd.DataFrame({"text_id": np.array(list(texts), np.int64)[text], "head": head, "place": place})
        if parts == 1:
            rows = found.groupby("text_id", sort=False)["place"].agg(list).reset_index(name="places").assign(head=None)
        else:
            rows = found.groupby(["text_id", "head"], sort=False)["place"].agg(list).reset_index(name="places")
        if len(rows):
            yield rows.assign(host=host, marked=marked, head=rows["head"].astype("Int64"))[["host", "marked", "text_id", "head", "places"]]


def _once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose text the task has not had: copies go before they are moved."""
    seen = set()
    for b in batches:
        keys = list(zip(b["host"], b["marked"], b["text_id"], strict=True))
        new = [k not in seen and not seen.add(k) for k in keys]
        yield b[new]


def host_runs(rows: DataFrame) -> DataFrame:
    """host, marked, text_id and the places in the text where a run of the host begins."""
    kind = ["host", "marked"]
    rows = rows.where("text <> ''")
    sizes = rows.select(*kind, "text_id").distinct().groupBy(*kind).agg(F.count("*").alias("size"))
    # at most one row for so many pages as two parts have texts
    large = stored(sizes.where(F.col("size") >= 2 * PART).withColumn("parts", F.floor(F.col("size") / PART).cast("int")), "sizes")
    distinct = rows.select(*kind, "text_id", "text").mapInPandas(_once, "host string, marked boolean, text_id long, text string")
    dealt = distinct.join(F.broadcast(large.select(*kind, "parts")), kind, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod("text_id", "parts").cast("int")).repartition(*kind, "part").sortWithinPartitions(*kind, "part")
    found = stored(dealt.mapInPandas(_runs, "host string, marked boolean, text_id long, head long, places array<int>"), "runs")
    of_parts = found.where("head IS NOT NULL")
    counted = of_parts.groupBy(*kind, "head").agg(F.count("*").alias("n")).join(F.broadcast(large), kind)
    heads = counted.where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= SHARE * F.col("size"))).select(*kind, "head")
    by_text = of_parts.join(heads, [*kind, "head"]).groupBy(*kind, "text_id").agg(F.flatten(F.collect_list("places")).alias("places"))
    return stored(found.where("head IS NULL").drop("head").unionByName(by_text), "places")


def without_runs(text: str, marked: bool, doubtful: Iterable[int], places: Iterable[int]) -> str:
    """A text without the host's runs that begin at these places, as the head of this file says."""
    words = [block.split(" ") for block in text.split("\n")]
    edges = np.cumsum([0, *map(len, words)])
    covered = np.zeros(edges[-1], bool)
    for p in places:
        covered[p:p + MIN_TOKENS] = True
    if marked:
        whole = {k for k in doubtful if covered[edges[k]:edges[k + 1]].all()}
        return "\n".join(" ".join(ws) for k, ws in enumerate(words) if k not in whole)
    if covered.all():
        return text
    left = [[w for w, c in zip(ws, covered[e:], strict=False) if not c] for ws, e in zip(words, edges, strict=False)]
    return "\n".join(" ".join(ws) for ws in left if ws)


def _cleared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        columns = (b[c] for c in ("text", "marked", "doubtful", "places"))
        yield b[["page_id", "url"]].assign(text=[t if p is None else without_runs(t, m, d, p) for t, m, d, p in zip(*columns, strict=True)])


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (blocks joined by a line feed, empty if none) and n_chars, its code points.

    Null or empty html gives an empty text; a null url is a host of its own name, the empty one; copies of a
    page are one text, so they don't make it boilerplate; other columns are left out; an empty table gives none.
    Every text goes through its host's suffix array. Pages are parsed again in each pass: that costs less than storing their texts.
    """
    rows = parsed(pages)
    found = rows.join(host_runs(rows), ["host", "marked", "text_id"], "left").select("page_id", "url", "text", "marked", "doubtful", "places")
    return found.mapInPandas(_cleared, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
