"""Main text of web pages by a suffix array over each host's pages.

A page is cut into blocks of text, each with the words of its surroundings: in
an article, in page furniture (menus, headers, footers, sidebars, notices,
adverts, forms, comments), or in neither. The blocks outside articles of all
pages of a host form one stream of tokens, block ends included; its suffixes
are ordered by their first ``DEPTH`` tokens, which is as deep as the order
matters: two suffixes that stand together there share a substring of at least
that length. A substring that distinct pages share is boilerplate; the tokens
it covers are removed and the unique runs of a block stay.

Furniture is evidence and goes in any case, for it may well differ from page to
page. What is marked as an article stays in any case, for copies of an article
on one host repeat without being boilerplate.

The suffix array is held as a table, in which equal first tokens are one row
for each task before anything is shuffled, so a large host is no large group.

Defined results: a null or empty page has an empty text; pages with equal
streams count as one page; a null or odd address is a host of its own name;
repeated rows get equal texts, and rows of one id are one page; other columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Hasher, chunks, mix

DEPTH = 6
ARTICLE, OPEN, FURNITURE = 0, 1, 2

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?",
    re.S,
)
MARKS = re.compile(
    r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I
)
HIDDEN = re.compile(
    r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I
)
# Elements of the HTML standard by what they hold.
UNSEEN = set("script style template noscript svg math iframe object canvas".split())
UNSEEN |= set("head title select button textarea datalist audio video".split())
RAW = set("script style textarea title".split())
ENDS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
FRAMES = set("nav header footer aside form menu dialog".split())
HOLDERS = set("div section article main body html td table ul ol dl p span".split())
BLOCKS = HOLDERS - {"span"} | FRAMES
BLOCKS |= set("h1 h2 h3 h4 h5 h6 li tr th caption thead tbody tfoot".split())
BLOCKS |= set("dt dd blockquote pre figure figcaption address hr fieldset".split())
BLOCKS |= set("details summary center hgroup search".split())

# Words in class, id and role that name page furniture, or an article.
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo "
    "nav navbar navigation menu sidebar footer header masthead cookie cookies "
    "consent notice gdpr newsletter subscribe subscription comment comments reply "
    "replies respond disqus share sharing social related recommended breadcrumb "
    "breadcrumbs popup modal overlay widget login signup search toolbar pagination "
    "complementary contentinfo".split()
)
ARTICLE_WORDS = set(
    "article articlebody main post entry story content maincontent".split()
)


def kind_of(tag: str, attributes: str) -> int | None:
    """What an element's own marks say of its text."""
    if tag in FRAMES:
        return FURNITURE
    if attributes:
        if HIDDEN.search(attributes):
            return FURNITURE
        words = set()
        for match in MARKS.finditer(attributes):
            value = match[2] or match[3] or match[4] or ""
            words.update(re.split(r"[^a-z]+", value.lower()))
        if words & FURNITURE_WORDS:
            return FURNITURE
        if words & ARTICLE_WORDS and tag in HOLDERS:
            return ARTICLE
    return ARTICLE if tag in ("article", "main") else None


class Parser:
    """Cuts pages into blocks; remembers what marks mean between pages."""

    REMEMBERED = 10_000

    def __init__(self):
        self._kinds: dict[tuple[str, str], int | None] = {}

    def _kind(self, tag: str, attributes: str) -> int | None:
        key = (tag, attributes)
        if key not in self._kinds:
            if len(self._kinds) > self.REMEMBERED:
                self._kinds.clear()
            self._kinds[key] = kind_of(tag, attributes)
        return self._kinds[key]

    def blocks(self, page: str) -> list[tuple[int, str]]:
        """``(kind, text)`` of each block that has a text, in page order."""
        found: list[tuple[int, str]] = []
        held: list[str] = []
        # Open elements with the kind of what they hold; furniture within an
        # article counts, an article within furniture does not.
        stack: list[tuple[str, int]] = []
        kind, unseen, at, n = OPEN, 0, 0, len(page)
        search = PIECE.search

        def close() -> None:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                found.append((kind, text))

        while at < n:
            match = search(page, at)
            if match is None:
                if not unseen:
                    held.append(page[at:])
                break
            start = match.start()
            if start > at and not unseen:
                held.append(page[at:start])
            at = match.end()
            ending, tag, attributes = match.groups()
            if not tag:
                continue
            tag = tag.lower()
            if ending:
                if tag in UNSEEN:
                    unseen = max(0, unseen - 1)
                if tag in BLOCKS and held:
                    close()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        kind = stack[-1][1] if stack else OPEN
                        break
                continue
            if tag in RAW:
                end = ENDS[tag].search(page, at)
                at = end.end() if end else n
                continue
            if tag == "br":
                held.append(" ")
                continue
            if tag in BLOCKS and held:
                close()
            if tag == "body":
                unseen = 0
            alone = attributes.endswith("/")
            if tag in UNSEEN:
                unseen += not alone
            elif not alone and (tag in HOLDERS or tag in FRAMES):
                own = self._kind(tag, attributes)
                if tag == "header" and kind == ARTICLE:
                    own = None  # the article's own head, its title
                if tag == "p" and stack and stack[-1][0] == "p":
                    stack.pop()  # a paragraph ends where the next one begins
                    kind = stack[-1][1] if stack else OPEN
                if kind != FURNITURE and own is not None:
                    kind = own
                if own is not None or tag not in ("p", "span"):
                    stack.append((tag, kind))
        close()
        return found


def host_of(url: str | None) -> str:
    match = re.match(r"[a-z]+://(?:[^/@]*@)?([^/:?#]*)", url or "", re.I)
    found = match[1].lower() if match else (url or "")
    return "".join(found.split())


END = np.uint64(0xE4D)


def stream(hasher: Hasher, pages: list[list[tuple[int, str]]]):
    """``(page, token, open)`` over the blocks outside articles, with their ends."""
    owner = [p for p, kept in enumerate(pages) for k, _ in kept if k != ARTICLE]
    outside = [(k, t) for kept in pages for k, t in kept if k != ARTICLE]
    doc, word, *_ = hasher.words([t for _, t in outside], lower=False)
    size = np.bincount(doc, minlength=len(outside)) + 1
    token = np.full(size.sum(), END)
    token[np.arange(len(word)) + doc] = word
    kinds = np.array([k for k, _ in outside], np.int64)
    return np.repeat(np.array(owner, np.int64), size), token, np.repeat(kinds == OPEN, size)


def entries(hasher: Hasher, hosts: np.ndarray, pages: list[list[tuple[int, str]]]):
    """``(page, place, key, open, content)`` of every suffix of ``DEPTH`` tokens.

    ``open`` tells whether those tokens touch an open block; ``content`` is a
    hash of the whole stream of each page.
    """
    page, token, is_open = stream(hasher, pages)
    size = np.bincount(page, minlength=len(pages))
    first = np.cumsum(size) - size
    place = np.arange(len(token)) - first[page]
    total = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(mix(token + place.astype(np.uint64)), out=total[1:])
    content = (total[first + size] - total[first]).view(np.int64)
    n = max(0, len(token) - DEPTH + 1)
    key = hosts[page[:n]]
    for k in range(DEPTH):
        key = mix(key * np.uint64(31) + token[k : k + n])
    touched = np.append(0, np.cumsum(is_open))
    touched = touched[DEPTH : DEPTH + n] > touched[:n]
    whole = page[:n] == page[len(page) - n :]
    return (
        page[:n][whole],
        place[:n][whole],
        key.view(np.int64)[whole],
        touched[whole],
        content,
    )


def suffixes(only_open: bool):
    """``key, page, page_id, place`` of the suffixes; with ``only_open`` those
    that cover text which is neither article nor furniture."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, parse = Hasher(), Parser().blocks
        for batch in batches:
            texts = [p or "" for p in batch["html"]]
            for first, last in chunks(texts, 1 << 22):
                rows = batch.iloc[first:last]
                kept = [parse(t) for t in texts[first:last]]
                hosts = hasher.words([f"{host_of(u)}." for u in rows["url"]])[1]
                page, place, key, is_open, content = entries(hasher, hosts, kept)
                use = is_open if only_open else slice(None)
                yield pd.DataFrame(
                    {
                        "key": key[use],
                        "page": content[page[use]],
                        "page_id": rows["page_id"].to_numpy()[page[use]],
                        "place": place[use],
                    }
                )

    return find


def has_open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parse = Parser().blocks
    for batch in batches:
        rows = [any(k == OPEN for k, _ in parse(p or "")) for p in batch["html"]]
        yield batch[np.array(rows, bool)]


def text_of(kept: list[tuple[int, str]], covered: set[int]) -> str:
    """The article and the uncovered runs of what is no furniture."""
    lines, at = [], 0
    for kind, text in kept:
        if kind == ARTICLE:
            lines.append(text)
            continue
        words = [w for w in re.split(r"[ \t-\r]+", text) if w]
        if kind == OPEN:
            left = [w for k, w in enumerate(words) if at + k not in covered]
            if left:
                lines.append(" ".join(left))
        at += len(words) + 1
    return "\n".join(lines)


def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of the pages on which nothing is open."""
    parse = Parser().blocks
    for batch in batches:
        rows = []
        for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"]):
            kept = parse(page or "")
            if not any(k == OPEN for k, _ in kept):
                rows.append((page_id, url, text_of(kept, set())))
        yield pd.DataFrame(rows, columns=["page_id", "url", "text"])


def cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of the other pages, without what their suffixes cover."""
    parse = Parser().blocks
    for batch in batches:
        rows = []
        for page_id, url, page, places in zip(
            batch["page_id"], batch["url"], batch["html"], batch["places"]
        ):
            covered = {
                p + k for p in (() if places is None else places) for k in range(DEPTH)
            }
            rows.append((page_id, url, text_of(parse(page or ""), covered)))
        yield pd.DataFrame(rows, columns=["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    pages = pages.select("page_id", "url", "html")
    entry = "key long, page long, page_id long, place int"
    array = pages.mapInPandas(suffixes(False), entry).groupBy("key").agg(
        F.min("page").alias("low"), F.max("page").alias("high")
    )
    shared = array.where("low <> high").select("key")
    inside = pages.mapInPandas(suffixes(True), entry).join(shared, "key", "left_semi")
    places = inside.groupBy("page_id").agg(F.collect_set("place").alias("places"))
    marked = pages.mapInPandas(has_open, pages.schema).join(places, "page_id", "left")
    out = "page_id long, url string, text string"
    done = pages.mapInPandas(decided, out).unionByName(marked.mapInPandas(cleaned, out))
    return done.withColumn("n_chars", F.length("text").cast("long"))
