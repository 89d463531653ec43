"""Main text of web pages with a site style tree (op 10).

Each page is parsed into blocks of text with the path of elements (tag and classes) they stand in.

*Markup.* Elements that say what they are (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments, by tag, role, class or id) are dropped with all they hold. If the page
has an article or main element, its blocks are the main text, else those of the body.

*Site style tree.* The DOMs of one host are merged: an element node is a (host, path). Over the m pages
that have the node, its presentation importance is the entropy (to the base m) of the child sequences
it shows, 0 if every page shows the same; the importance of a content is 1 less the entropy of its
spread over the pages, 1 for a text on one page and 0 for a text on all. A node's importance mixes its
presentation's with the mean of its contents'. A block is removed if its content and its node are both
unimportant on a host where the node is on ``LEAST_PAGES`` pages or more. Markup is a prior: what it drops has
no importance, and a plain paragraph, heading, list or table right in an article is no style of its own (its node
holds the article and notices alike), so its content alone decides, and must be nearly without importance (below
``PLAIN_IMPORTANCE``: on more than half of a million pages, on all of five). Of the pages that hold the same such
blocks, near copies of an article are no template: where these blocks are most of an article's plain text, all stay.
Statistics are counts by (host, path, value) over pages of different contents: rows are dealt by all of these,
then added up before the second shuffle, so a host with a third of all pages is no hot group; what is removed is a
table of (host, path, content), broadcast only when its measured size is small, else joined by host. A content of
importance below 0.4 stands on more than m**0.6 of m pages, so a host's row holds at most m**0.4 times the blocks of
a mean page.

Defined results: a null html is the empty text (text empty); a null URL has the empty host; a null page_id
stays null; repeated rows give a row each; an empty table gives an empty result;
other columns are ignored. An element that drops its content and is never closed ends where an article or
main begins; an article in a closed one goes with it. A head ends at the first element or text it cannot hold;
a form stays if it holds more text than the rest of the page. Pages of equal blocks on a host count as one in
the style tree. If all blocks are removed the text is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.llm.common import batch, in_batches, materialize

#: A node is judged on a host that has it on this many pages; importance below which a branch goes;
#: share of a node's importance that its contents give.
LEAST_PAGES, LEAST_IMPORTANCE, CONTENT_SHARE = 5, 0.4, 0.9
#: Importance below which a plain block of an article goes; share of an article's plain text beyond which none goes.
PLAIN_IMPORTANCE, MOST_PLAIN = 0.05, 0.5
#: Rows of the table of removed branches up to which it is broadcast.
BROADCAST_ROWS = 50_000

# HTML's elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
                  "nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html option optgroup td th tr tbody thead tfoot caption legend li dd dt".split())
NOISE_TAGS = frozenset("aside button canvas datalist dialog footer form frame head iframe input label map menu nav "
                       "noframes noscript object option script select style svg template textarea video audio".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
                        "search toolbar".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment "
                        "comments commentlist consent cookie cookies copyright disclaimer disqus footer header masthead menu "
                        "modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup "
                        "promo promoted related respond share sharing sidebar social sponsor sponsored subscribe "
                        "subscription toolbar widget widgets".split())
MAIN_TAGS = frozenset(("article", "main"))
#: With these, a class names what the element stands beside.
BESIDE = frozenset(("has", "with", "no", "without"))
#: What may itself be the page's content though a class word says otherwise.
NEVER_NOISE = frozenset(("html", "body", "main"))
#: An article of such a class is not the page's.
NOISE_ARTICLES = frozenset("ad ads advert advertisement comment comments disqus promo related respond widget".split())
#: What a head holds; anything else ends one whose end tag is omitted.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
_WORD = re.compile(r"[a-z]+")


OUTSIDE, INSIDE, PLAIN = range(3)
#: Elements that hold an article's text itself.
PLAIN_PATH = re.compile(r"/(article|main)(\.[^/]*)?(/(p|h[1-6]|blockquote|pre|ul|ol|dl|li|dt|dd|table|tbody|tr|td|th))*$")


class PageParser(HTMLParser):
    """``blocks``: (path, content, standing) of each block of text that markup keeps, where standing is
    OUTSIDE the article, INSIDE it, or PLAIN inside it; ``nodes``: path -> tags of its children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def parse(self, html: str) -> "PageParser":
        """A second pass follows if the first one met an article in a dropped branch that is never closed,
        or dropped a form that holds most of the page's text."""
        self._pass(html, frozenset(), frozenset())
        kept = sum(len(content) for _, content, _ in self.blocks)
        forms = frozenset(k for k, n in self.form_text.items() if n > kept)
        unclosed = self.around_article - self.closed
        # in a second pass what the first one dropped unseen counts too
        return self._pass(html, self.starts - self.closed, forms) if unclosed or forms else self

    def _pass(self, html: str, unclosed: set[int] | frozenset[int], forms: frozenset[int]) -> "PageParser":
        self.reset()
        self.unclosed, self.forms = unclosed, forms
        self.number, self.dropper = 0, -1  # of start tags; of the one whose content is dropped
        self.starts: set[int] = set()
        self.closed: set[int] = set()  # those that their own end tag closed
        self.around_article: set[int] = set()
        self.form_text: dict[int, int] = {}
        self.stack: list[tuple[str, str, bool, int]] = []  # tag, path, drops its content, number
        self.dropping = self.mains = 0
        self.parts: list[str] = []
        self.blocks: list[tuple[str, str, int]] = []
        self.nodes: dict[str, list[str]] = {}
        self.feed(html)
        self.close()
        self._flush()
        return self

    def _path(self) -> str:
        return self.stack[-1][1] if self.stack else ""

    def _flush(self) -> None:
        if self.parts:
            content = " ".join("".join(self.parts).split())
            if content:
                path = self._path()
                standing = OUTSIDE if not self.mains else PLAIN if PLAIN_PATH.search(path) else INSIDE
                self.blocks.append((path, content, standing))
            self.parts.clear()

    def _pop(self) -> None:
        tag, _, drops, _ = self.stack.pop()
        self.dropping -= drops
        self.mains -= tag in MAIN_TAGS

    def _drops(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER_NOISE:
            return False
        if tag == "article":
            return any(not NOISE_ARTICLES.isdisjoint(words) and BESIDE.isdisjoint(words)
                       for name, value in attrs if name in ("class", "id") and value
                       for words in map(_WORD.findall, value.lower().split()))
        if tag in NOISE_TAGS and self.number not in self.forms or tag == "header" and not self.mains:
            return True
        for name, value in attrs:
            if name in ("class", "id") and value:
                for name_part in value.lower().split():
                    words = _WORD.findall(name_part)
                    if not NOISE_WORDS.isdisjoint(words) and BESIDE.isdisjoint(words):
                        return True
            elif name == "role" and value and value.lower() in NOISE_ROLES:
                return True
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            if not self.dropping:
                self.parts.append(" ")
            return
        self.number += 1
        self.starts.add(self.number)
        if self.stack and (tag == "body" and self._in_head() or self.stack[-1][0] == "head" and tag not in HEAD_TAGS):
            self._end("head")
        if tag in MAIN_TAGS and self.dropping:
            self.around_article.add(self.dropper)
            if self.dropper in self.unclosed:
                while self.dropping:
                    self._pop()
        if tag in BLOCK:
            self._flush()
            if tag in ENDS_P and self._open("p"):
                self._end("p")
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.stack and self.stack[-1][0] == tag:
                self._pop()
        if tag in VOID:
            return
        if self.dropping:
            self.stack.append((tag, "", False, self.number))
            self.mains += tag in MAIN_TAGS
            return
        drops = self._drops(tag, attrs)
        if tag in BLOCK:
            above = self._path()
            classes = next((v for n, v in attrs if n == "class" and v), "") if attrs else ""
            path = f"{above}/{tag}.{'.'.join(sorted(classes.split()))}" if classes else f"{above}/{tag}"
            self.nodes.setdefault(above, []).append(tag)
        else:
            path = self._path()
        self.stack.append((tag, path, drops, self.number))
        self.dropping += drops
        if drops:
            self.dropper, self.dropper_tag = self.number, tag
        self.mains += tag in MAIN_TAGS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def _in_head(self) -> bool:
        return any(entry[0] == "head" for entry in self.stack[:2])

    def _open(self, tag: str) -> bool:
        """Whether the tag is open, up to the nearest element that bounds it."""
        for t, *_ in reversed(self.stack):
            if t == tag:
                return True
            if t in ("table", "td", "th", "li", "div", "section", "article", "main", "body"):
                return False
        return False

    def _end(self, tag: str) -> None:
        while self.stack:
            last = self.stack[-1][0]
            self._pop()
            if last == tag:
                break

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK and not self.dropping:
            self._flush()
        own = next((number for t, _, _, number in reversed(self.stack) if t == tag), None)
        if own is not None:
            self.closed.add(own)
            self._end(tag)

    def handle_data(self, data: str) -> None:
        if self.dropping and self.stack[-1][0] == "head" and data.strip():
            self._end("head")
        if not self.dropping:
            self.parts.append(data)
        elif self.dropper_tag == "form" and (self.stack[-1][0] == "form" or self.stack[-1][0] not in NOISE_TAGS):
            self.form_text[self.dropper] = self.form_text.get(self.dropper, 0) + len(" ".join(data.split()))


def digest(content: str) -> int:
    return xxhash.xxh64_intdigest(content.encode("utf-8", "replace")) - (1 << 63)


def main_text(parser: PageParser, removed: set[tuple[str, int]]) -> str:
    """The article's blocks if there is one, else all blocks, without removed branches."""
    blocks = [b for b in parser.blocks if b[2] != OUTSIDE] or parser.blocks
    if removed:
        goes = [(path, digest(content)) in removed for path, content, _ in blocks]
        plain = sum(len(content) for _, content, standing in blocks if standing == PLAIN)
        template = sum(len(b[1]) for b, gone in zip(blocks, goes) if gone and b[2] == PLAIN)
        keep_plain = template > MOST_PLAIN * plain
        blocks = [b for b, gone in zip(blocks, goes) if not gone or b[2] == PLAIN and keep_plain]
    return "\n".join(content for _, content, _ in blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


STAT = pa.schema([("host", pa.string()), ("path", pa.string()), ("kind", pa.int8()), ("value", pa.int64()),
                  ("page", pa.int64())])
PAGE, STYLE, CONTENT, PLAIN_CONTENT = range(4)


def node_counts(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value, n): on how many pages of different contents a node stands, shows a child sequence, and holds
    a content (plain or not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = PageParser()
        for rows in batches:
            out: list[tuple] = []
            for host, html in zip(rows.column("host").to_pylist(), rows.column("html").to_pylist()):
                p = parser.parse(html)
                own = {(host, path, PLAIN_CONTENT if standing == PLAIN else CONTENT, digest(content))
                       for path, content, standing in p.blocks}
                own |= {(host, path, STYLE, digest(">".join(tags))) for path, tags in p.nodes.items()}
                page = digest("\n".join(f"{path}\t{content}" for path, content, _ in p.blocks))
                out.extend((*x, page) for x in own)
                out.extend((host, path, PAGE, 0, page) for path in {x[1] for x in own})
            columns = list(zip(*out)) if out else [[]] * 5
            yield batch(STAT, {f.name: list(c) for f, c in zip(STAT, columns)})

    return (in_batches(pages, run, "host string, path string, kind byte, value long, page long").distinct()
            .groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n")))


def unimportant(counts: DataFrame) -> DataFrame:
    """(host, path, value) of the contents to remove. A node's entropies follow from sums of n and n log n, which each task
    adds up before the shuffle; only contents that can be unimportant are joined with their nodes."""
    kind, n = F.col("kind"), F.col("n").cast("double")

    def sums(k: int, name: str) -> list[Column]:
        return [F.sum(F.when(kind == k, n)).alias(name), F.sum(F.when(kind == k, n * F.log(n))).alias(f"{name}_log")]

    m = F.col("m")
    style = F.coalesce((F.col("style") * F.log(m) - F.col("style_log")) / m / F.log(m), F.lit(0.0))
    content = 1 - F.col("content_log") / F.col("content") / F.log(m)  # mean over the contents' occurrences
    importance = F.lit(1 - CONTENT_SHARE) * style + F.lit(CONTENT_SHARE) * content
    nodes = (counts.where(kind != PLAIN_CONTENT).groupBy("host", "path")
             .agg(F.max(F.when(kind == PAGE, n)).alias("m"), *sums(STYLE, "style"), *sums(CONTENT, "content"))
             .where(m >= LEAST_PAGES)
             .select("host", "path", "m", F.coalesce(importance < LEAST_IMPORTANCE, F.lit(False)).alias("low")))
    # importance below x asks for more than m ** (1 - x) pages, and m is LEAST_PAGES at least
    often = counts.where((kind == CONTENT) & (n > LEAST_PAGES ** (1 - LEAST_IMPORTANCE))
                         | (kind == PLAIN_CONTENT) & (n > LEAST_PAGES ** (1 - PLAIN_IMPORTANCE)))
    own = 1 - F.log(n) / F.log(m)
    return (often.join(nodes, ["host", "path"])
            .where((kind == CONTENT) & F.col("low") & (own < LEAST_IMPORTANCE) | (kind == PLAIN_CONTENT) & (own < PLAIN_IMPORTANCE))
            .select("host", "path", "value").distinct())


TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    inputs = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"),
                          F.coalesce("html", F.lit("")).alias("html"))
    # the counts are a table: four results below are taken from them
    removed = materialize(unimportant(materialize(node_counts(inputs.select("host", "html")))))
    by_host = removed.groupBy("host").agg(F.collect_list(F.struct("path", "value")).alias("removed"))
    n = removed.count()
    if n == 0:
        joined = inputs.withColumn("removed", F.lit(None).cast("array<struct<path:string,value:bigint>>"))
    else:
        joined = inputs.join(F.broadcast(by_host) if n <= BROADCAST_ROWS else by_host, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, sets = PageParser(), {}
        for rows in batches:
            texts = []
            for host, html, own in zip(*(rows.column(c).to_pylist() for c in ("host", "html", "removed"))):
                if own and host not in sets:
                    sets = {host: {(x["path"], x["value"]) for x in own}}
                texts.append(main_text(parser.parse(html), sets[host] if own else set()))
            yield batch(TEXT, {"page_id": rows.column("page_id"), "url": rows.column("url"), "text": texts,
                               "n_chars": [len(t) for t in texts]})

    return in_batches(joined.select("page_id", "url", "host", "html", "removed"), run,
                      "page_id long, url string, text string, n_chars long")
