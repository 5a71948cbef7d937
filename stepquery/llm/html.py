"""Main text of web pages by the consensus of their host.

Every page's containers are scored (text outside links and boilerplate, weighted by what the element is), and the best
one's generalised path of tags and classes (digits become #) gets a vote of that page's weight. Votes are summed per host and
path in Spark, and every page is extracted again from the elements on its host's winning path; a page without such an
element falls back to its own best container.

Text is what the containers hold without navigation, headers, footers, sidebars, notices, adverts, forms, comments of
readers, scripts, styles and hidden elements. Character references are decoded, white space in a block becomes one space,
and blocks are joined in page order by one space.

Defined results: a null or empty html, and a page without text, give the empty text; a null url is a host of its own
kind (no consensus beyond pages without url); ties between paths fall to the path that sorts last; broken markup is
closed where a browser would close it, roughly; repeated rows give repeated results; an empty table gives no rows. A page
is read once from front to back whatever its markup: neither deep nesting nor tags that never end cost more than in
proportion to its length. The heading of an article (a `header` inside it, or a heading element) is a part of its text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_strings, materialize, small_batches

#: Winning paths of up to so many bytes are broadcast; more are joined by a shuffle.
BROADCAST = 16 << 20
#: Elements whose content is no markup. Without an end tag the first four run to the end of the page, the others are empty.
RAW = "script style textarea title iframe noscript xmp noembed noframes".split()
TO_THE_END = set(RAW[:4])
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: Where markup starts; a tag with its quoted attributes; a tag that ends at the next > whatever is quoted.
MARKUP = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>")
#: Tags of a page whose quotes never end that are looked at; each may cost a look at the whole rest of the page.
UNENDED = 16
ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/]+)", re.S)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("svg math canvas audio video object select template a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = set("article main section div td body center blockquote".split())
CLOSES_P = set("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What an open element of this name is closed by when one of these starts inside it.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSES = {t: tuple(k for k, v in CLOSED_BY.items() if t in v) for v in CLOSED_BY.values() for t in v}
SCOPE = set("article aside body details div dl fieldset footer form header html main nav object ol section select table td template th ul".split())
#: Drawings and formulas end where one of these starts, unless it stands in a part of them that holds markup.
FOREIGN, HOLDS_MARKUP = {"svg", "math"}, set("foreignobject desc annotation-xml mi mo mn ms mtext".split())
LEAVES_FOREIGN = CLOSES_P | set("b big body br code dd dt em embed head i img li meta ruby s small span strike strong sub sup tt u var".split())
DROPPED = set("nav header footer aside form button dialog menu head input fieldset template svg math canvas audio video object select".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|popup|modal|overlay|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|commentlist|respond|disqus|related|recommended|share|sharing|social|widget|pagination|pager|toolbar|login|signup|search)(?:$|[-_\s\d])",
    re.I,
)
GOOD = re.compile(r"(?:^|[-_\s])(?:article|content|entry|main|post|story|text|body)(?:$|[-_\s\d])", re.I)
NEVER = {"html", "body", "article", "main"}
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What names the head of a page, and inside an article the article's own.
HEAD = re.compile(r"(?:^|[-_\s])(?:header|masthead|banner)(?=$|[-_\s\d])", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    place: int  # of its generalised path
    dropped: bool
    weight: float
    depth: int
    link: bool
    article: bool = False  # inside one
    foreign: int = 0  # stack depth of the drawing or formula around it, 0: none
    open: dict[str, int] = field(default_factory=dict)  # stack depths of what a tag may close, in its scope
    end: int = 0
    text: int = 0
    linked: int = 0


@dataclass
class Page:
    nodes: list[Node]
    pieces: list[tuple[int, str]] = field(default_factory=list)  # node and text; node -1: a block ends
    places: dict[tuple[int, str], int] = field(default_factory=dict)  # place above and segment: place

    def path(self, node: int) -> str:
        """The generalised path of a node, written out."""
        of, out, place = {v: k for k, v in self.places.items()}, [], self.nodes[node].place
        while place:
            place, segment = of[place]
            out.append(segment)
        return "/".join(["", "html", *reversed(out)])

    def place_of(self, path: str) -> int | None:
        """The place of a path, None where the page has none such."""
        place = 0
        for segment in path.split("/")[2:]:
            if (place := self.places.get((place, segment))) is None:
                return None
        return place


def attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(text)} if text.strip(" /") else {}


def boilerplate(tag: str, attrs: dict[str, str], names: str, article: bool) -> bool:
    """Whether an element holds none of the main text, by what it is and says of itself."""
    own_head = article or tag in HEADINGS
    role = attrs.get("role", "").lower()
    return (
        (tag in DROPPED and not (tag == "header" and article))
        or (role in ROLES and not (role == "banner" and own_head))
        or "hidden" in attrs
        or attrs.get("aria-hidden", "").lower() == "true"
        or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        or (tag not in NEVER and bool(names) and bool(NAMES.search(HEAD.sub(" ", names) if own_head else names)))
    )


def node(page: Page, tag: str, attrs: dict[str, str], parent: int, depth: int) -> Node:
    """An element below node `parent`, at this depth of the stack."""
    above = page.nodes[parent]
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
    dropped = above.dropped or boilerplate(tag, attrs, names, above.article)
    # the classes of a whole page tell pages apart, not places in them
    classes = "" if tag == "body" else ".".join(sorted(re.sub(r"\d+", "#", c).replace("/", "|") for c in attrs.get("class", "").split()))
    good = tag in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "").lower() == "articlebody"
    weight = 3.0 if good else 0.3 if tag == "body" else 1.5 if GOOD.search(names) else 1.0
    segment = f"{tag}.{classes}" if classes else tag
    place = page.places.setdefault((above.place, segment), len(page.places) + 1)
    foreign = depth if tag in FOREIGN else 0 if tag in HOLDS_MARKUP else above.foreign
    opened = {} if tag in SCOPE else above.open
    if tag == "p" or tag in CLOSED_BY:
        opened = opened | {tag: depth}
    return Node(tag, parent, place, dropped, weight, above.depth + 1, tag == "a" or above.link, tag == "article" or above.article, foreign, opened)


def parse(html: str) -> Page:
    page = Page([Node("html", -1, 0, False, 0.2, 0, False)])
    nodes, pieces, stack, opened = page.nodes, page.pieces, [0], Counter()

    def close(depth: int) -> None:
        while len(stack) > depth:
            n = nodes[stack.pop()]
            n.end = len(nodes)
            opened[n.tag] -= 1
            if n.tag not in INLINE and not nodes[n.parent].dropped:
                pieces.append((-1, ""))

    def say(text: str) -> None:
        if text:
            pieces.append((stack[-1], unescape(text) if "&" in text else text))

    def start(tag: str, attrs: str) -> None:
        if (d := nodes[stack[-1]].open.get("p", 0)) and tag in CLOSES_P:
            close(d)
        if tag in CLOSES and (d := max(nodes[stack[-1]].open.get(t, 0) for t in CLOSES[tag])):
            close(d)
        if tag == "body":
            close(1)
        gone = nodes[stack[-1]].dropped
        if tag not in INLINE and not gone:
            pieces.append((-1, ""))
        nodes.append(node(page, tag, {} if gone else attributes(attrs), stack[-1], len(stack)))
        if attrs.endswith("/"):
            nodes[-1].end = len(nodes)
        else:
            stack.append(len(nodes) - 1)
            opened[tag] += 1

    unclosed: set[str] = set()
    at, unended = 0, 0
    while m := MARKUP.search(html, at):
        i = m.start()
        if html[i + 1] in "!?":
            comment = html.startswith("<!--", i)
            end = html.find("-->", i + 4) + 2 if comment else html.find(">", i)
            say(html[at:i])
            at = end + 1 if end > 1 else len(html)
            continue
        m = TAG.match(html, i) if unended < UNENDED else None
        if not m:
            unended += 1
            m = PLAIN_TAG.match(html, i)
            if not m:  # no tag ends from here on
                break
        say(html[at:i])
        at, tag = m.end(), m["tag"].lower()
        if m["end"]:
            if opened[tag]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if nodes[stack[d]].tag == tag))
            continue
        if tag == "html":
            continue
        foreign = nodes[stack[-1]].foreign
        if foreign and tag in LEAVES_FOREIGN:
            close(foreign)
            foreign = 0
        if tag in RAW_END and not foreign:
            end = None if tag in unclosed else RAW_END[tag].search(html, at)
            end = html.find(">", end.end()) if end else -1
            if end >= 0:
                at = end + 1
            else:
                unclosed.add(tag)
                at = len(html) if tag in TO_THE_END else at
        elif tag in VOID:
            if tag not in INLINE and not nodes[stack[-1]].dropped:
                pieces.append((-1, ""))
        else:
            start(tag, m["attrs"])
    say(html[at:])
    close(0)
    return page


def best(page: Page) -> tuple[int, float]:
    """The node with the best score, and the page's weight as a voter; (-1, 0) where there is no text."""
    for k, text in page.pieces:
        if k >= 0 and not page.nodes[k].dropped:
            n = len(text) - text.count(" ") - text.count("\n")
            page.nodes[k].text += n
            page.nodes[k].linked += n * page.nodes[k].link
    for n in reversed(page.nodes[1:]):
        up = page.nodes[n.parent]
        up.text += n.text
        up.linked += n.linked
    choice, top = -1, 0.0
    for k, n in enumerate(page.nodes):
        if (n.tag in CONTAINERS or k == 0) and not n.dropped and n.text > n.linked:
            own = n.text - n.linked
            score = own * n.weight * (own / n.text) * (1 + 0.01 * n.depth)
            if score > top:
                choice, top = k, score
    return choice, math.log1p(page.nodes[choice].text) if choice >= 0 else 0.0


def text_of(page: Page, roots: list[int]) -> str:
    """Blocks of the subtrees, which do not overlap, in page order."""
    inside = bytearray(len(page.nodes))
    for r in roots:
        inside[r : page.nodes[r].end] = b"\1" * (page.nodes[r].end - r)
    blocks, run = [], []
    for k, text in page.pieces:
        if k < 0:
            if run:
                blocks.append("".join(run))
                run = []
        elif inside[k] and not page.nodes[k].dropped:
            run.append(text)
    blocks.append("".join(run))
    return " ".join(w for b in blocks for w in b.split())


def extract(html: str, path: str | None) -> str:
    page = parse(html)
    roots, end = [], 0
    place = page.place_of(path) if path else None
    if place is not None:
        for k, n in enumerate(page.nodes):
            if n.place == place and k >= end and not n.dropped:
                roots.append(k)
                end = n.end
    if not roots:
        choice, _ = best(page)
        roots = [choice] if choice >= 0 else []
    return text_of(page, roots) if roots else ""


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def consensus(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path): every host's winning path. Votes are summed in each task, then by host and path."""
    plain = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))

    def run(batches):
        votes: dict[tuple[str, str], float] = defaultdict(float)
        for batch in small_batches(batches, 128):
            for host, x in zip(batch.column(0).to_pylist(), as_strings(batch.column(1)), strict=True):
                if x:
                    page = parse(x)
                    choice, weight = best(page)
                    if choice >= 0:
                        votes[host, page.path(choice)] += weight
            if len(votes) > 50_000:
                yield pack(votes)
                votes.clear()
        yield pack(votes)

    def pack(votes):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.float64())], names=["host", "path", "votes"])

    summed = plain.mapInArrow(run, "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", broadcast: int = BROADCAST) -> DataFrame:
    """(key, url, text) of every page."""
    won = materialize(consensus(pages, html, url), "host-paths")
    size = won.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    plain = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    joined = plain.join(F.broadcast(won) if size <= broadcast else won, "host", "left").select("key", "url", "html", "path")

    def run(batches):
        for batch in small_batches(batches, 128):
            text = [extract(x, p) if x else "" for x, p in zip(as_strings(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["key", "url", "text"])

    return joined.mapInArrow(run, f"key {plain.schema['key'].dataType.simpleString()}, url string, text string").withColumnRenamed("key", key)
