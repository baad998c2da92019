"""Main text of pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A classifier looks at each on its own: where it
stands, how long it is, how much of it is links. Its two costs become the capacities of
the block's arcs from the source (content) and to the sink (boilerplate). Smoothness
arcs join blocks that follow one another and blocks whose containers are near in the
document tree, so a block that is hard to tell goes with those around it. The maximum
flow gives the cheapest labelling, and the text is that of the blocks on the source's
side. Pages do not depend on one another: one pass, no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that end a block of text, those that have no end tag, those
# whose content is not text of the page, and those that hold no article.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav noscript ol option p pre search section select summary table"
    " tbody td template tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TAGS = frozenset(
    "script style textarea title iframe noembed noframes xmp annotation".split()
)
DROPPED_TAGS = frozenset(
    "head template svg object audio video canvas button select datalist".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog noscript fieldset search".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSED_BY_SAME = frozenset(("li", "dd", "dt", "option", "tr", "td", "th"))

# Words in class, id and role that tell what a container is.
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|side|widget|footer|foot|masthead|banner"
    r"|ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|cookie"
    r"|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter"
    r"|subscribe|subscription|signup|login|social|share|sharing|related|recommended|breadcrumb"
    r"|breadcrumbs|pagination|pager|comment|comments|commentlist|respond|reply|replies|disqus"
    r"|copyright|legal|disclaimer|toolbar|search|tags|contentinfo|complementary|form|skip)"
    r"(?:$|[\s_\d-])"
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|top|topbar|head)(?:$|[\s_\d-])")
CONTENT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:article|articlebody|content|post|entry|story|main|text|body)(?:$|[\s_\d-])"
)
#: Names that tell how a page is laid out, not what a container holds.
LAYOUT_NAMES = re.compile(r"(?:has|no|with|without)-.+|.+-(?:open|opened|closed)")
WRAPPER_NAMES = re.compile(r".+[_-](?:wrap|wrapper)")
COMMENT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:comment|comments|commentlist|respond|reply|replies|disqus)(?:$|[\s_\d-])"
)
_PART = re.compile(r"[\s_\d-]+")
_ATTRIBUTE = re.compile(
    r"""([^\s"'>/=]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+"""
)
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")

#: Smoothness: between blocks in a row, and from a block to the last one that shares its
#: container or the container's parent.
ADJACENT, SAME_CONTAINER, SAME_PARENT = 0.4, 0.6, 0.3

UNKNOWN, CONTENT, BOILERPLATE, DROPPED = 0, 1, -1, -2
#: In an article; boilerplate that no article in it undoes.
ARTICLE, FIXED = 2, -3
#: In a form around more; under a name that is boilerplate in part only ("legal-news"),
#: outside of an article or in one. How much of the page they hold decides.
FORM, DOUBTFUL, DOUBTFUL_WITHIN = -4, -5, -6
SOFT = frozenset((FORM, DOUBTFUL, DOUBTFUL_WITHIN))


@dataclass
class Block:
    text: str
    place: int  # what its containers say of it
    tag: str
    container: int
    parent: int
    linked: int  # characters in links
    mark: int = 0  # the container that a soft place comes from


@dataclass
class _Open:
    tag: str
    place: int
    number: int
    mark: int = 0


def _attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lowered name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), "".join(values))
    return out


def _names(attributes: dict[str, str]) -> list[str]:
    """The lowered names of a container, without those of layout."""
    named = " ".join(attributes.get(key, "") for key in ("class", "id", "role", "itemprop"))
    kept = []
    for name in named.lower().split():
        if LAYOUT_NAMES.fullmatch(name) or (
            WRAPPER_NAMES.fullmatch(name) and CONTENT_NAMES.search(name)
            and BOILERPLATE_NAMES.search(name) and not COMMENT_NAMES.search(name)
        ):
            continue
        kept.append(name)
    return kept


def _certain(name: str) -> bool:
    """Whether every part of a name tells boilerplate or where on the page it stands."""
    return all(
        BOILERPLATE_NAMES.search(part) or HEADER_NAMES.search(part) for part in _PART.split(name)
        if part
    )


def _place(tag: str, written: str, outer: int) -> tuple[int, bool]:
    """What a container says of the text in it, and whether it says so itself.

    The innermost word counts. A main, or an article that is not in comments, an aside or
    another article, undoes the mark of a wrapper, and a content name that of a form.
    """
    attributes = _attributes(written) if written else {}
    if (outer == DROPPED or tag in DROPPED_TAGS or "hidden" in attributes
            or _UNSEEN.search(attributes.get("style", ""))):
        return DROPPED, False
    if tag in ("html", "body"):
        return outer, False
    if tag == "main":
        return CONTENT, False
    if outer == FIXED:
        return FIXED, False
    each = _names(attributes)
    names = " ".join(each)
    marks = [name for name in each if BOILERPLATE_NAMES.search(name)]
    if tag == "form" and not marks and outer not in (CONTENT, ARTICLE):
        return (FORM, outer != FORM) if outer in (UNKNOWN, FORM) else (outer, False)
    if tag in BOILERPLATE_TAGS or COMMENT_NAMES.search(names):
        # Reader comments are often articles of their own.
        return FIXED, False
    content = CONTENT_NAMES.search(names)
    if marks and not any(map(_certain, marks)) and not (tag == "article" and content):
        return (DOUBTFUL_WITHIN if outer in (ARTICLE, DOUBTFUL_WITHIN) else DOUBTFUL), True
    if tag == "article" and outer != DOUBTFUL_WITHIN:
        return (BOILERPLATE if marks and not content else ARTICLE), False
    if marks:
        return (FIXED if outer == ARTICLE else BOILERPLATE), False
    if outer in (BOILERPLATE, ARTICLE, DOUBTFUL, DOUBTFUL_WITHIN):
        return outer, False
    if content:
        return CONTENT, False
    if outer != CONTENT and (HEADER_NAMES.search(names) or tag == "header"):
        return BOILERPLATE, False
    return outer, False


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page, in order, without what is never shown."""
    out: list[Block] = []
    stack = [_Open("", UNKNOWN, 0)]
    pieces: list[str] = []
    number, linked, in_link, at, size = 0, 0, False, 0, len(page)

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            top = stack[-1]
            if text and top.place != DROPPED:
                parent = stack[-2].number if len(stack) > 1 else 0
                # A paragraph is no container of others: blocks of a row share its parent.
                own = (parent, stack[-3].number if len(stack) > 2 else 0)
                if top.tag not in ("p", "li", *HEADINGS):
                    own = (top.number, parent)
                out.append(Block(text, top.place, top.tag, *own, linked, top.mark))
            pieces.clear()
        linked = 0

    def read(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    while at < size:
        start = page.find("<", at)
        if start < 0:
            read(page[at:])
            break
        read(page[at:start])
        following = page[start + 1 : start + 2]
        if following in ("!", "?"):
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            continue
        if not (following.isascii() and following.isalpha()) and following != "/":
            read("<")
            at = start + 1
            continue
        found = _TAG.match(page, start) or _LOOSE_TAG.match(page, start)
        if not found:
            # </ and no name is a comment to its end; a tag that never ends is none.
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        at = found.end()
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        if closing:
            if tag == "a":
                in_link = False
            elif tag == "br":
                pieces.append(" ")
            elif tag in BLOCK_TAGS or tag in DROPPED_TAGS:
                close()
                in_link = False
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        break
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = size if end is None else end.start()
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = True
        elif tag in BLOCK_TAGS or tag in DROPPED_TAGS:
            close()
            if tag in BLOCK_TAGS and stack[-1].tag == "p":
                stack.pop()
            if tag in CLOSED_BY_SAME and stack[-1].tag == tag:
                stack.pop()
            if tag not in VOID_TAGS and not attributes.endswith("/"):
                number += 1
                place, own = _place(tag, attributes, stack[-1].place)
                mark = number if own else stack[-1].mark if place in SOFT else 0
                stack.append(_Open(tag, place, number, mark))
    close()
    return out


def _words(block: Block) -> int:
    return block.text.count(" ") + 1


def bodies(blocks: list[Block]) -> set[int]:
    """The marked containers that are the page's body all the same.

    One that holds at least half of the words outside of certain boilerplate, where no
    other text stands in a container for content.
    """
    words: dict[int, int] = {}
    for block in blocks:
        if block.place >= 0 or block.place in SOFT:
            mark = block.mark if block.place in SOFT else -1 if block.place > 0 else 0
            words[mark] = words.get(mark, 0) + _words(block)
    whole = sum(words.values())
    inside = {
        block.mark for block in blocks if block.place == DOUBTFUL_WITHIN
    }
    return {
        mark for mark, n in words.items()
        if mark > 0 and 2 * n >= whole and (-1 not in words or mark in inside)
    }


def evidence(block: Block, body: bool = False) -> float:
    """The classifier: log odds that a block is content."""
    words = _words(block)
    links = block.linked / max(1, len(block.text))
    if block.place > 0:
        odds = 4.0
    elif block.place == UNKNOWN or body:
        odds = -1.0
    else:
        odds = -5.0 if block.place in SOFT else -8.0
    odds += 2.5 if words >= 25 else 1.5 if words >= 10 else 0.0 if words >= 4 else -0.5
    odds += 1.0 if block.text[-1] in ".!?…。！？:;\"'”’)" else 0.0
    odds += 1.5 if block.tag in HEADINGS else 0.0
    odds -= 4.0 * links
    odds -= 3.0 if "©" in block.text or "all rights reserved" in block.text.lower() else 0.0
    return odds


def minimum_cut(
    source: list[float], sink: list[float], arcs: list[tuple[int, int, float]]
) -> list[bool]:
    """Which nodes stay with the source. ``arcs`` (i, j, c) go both ways.

    Blocking flows over shortest paths. What a node can pass straight from source to
    sink is taken off first, so each keeps one of the two.
    """
    n = len(source)
    keeps = [a - b for a, b in zip(source, sink, strict=True)]
    heads: list[int] = []
    room: list[float] = []
    near: list[list[int]] = [[] for _ in range(n)]
    for i, j, capacity in arcs:
        near[i].append(len(heads))
        near[j].append(len(heads) + 1)
        heads += [j, i]
        room += [capacity, capacity]
    spare = [max(0.0, k) for k in keeps]
    wants = [max(0.0, -k) for k in keeps]
    least = 1e-12
    while True:
        level = [0 if s > least else -1 for s in spare]
        queue = deque(i for i in range(n) if level[i] == 0)
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or wants[i] > least
            for arc in near[i]:
                j = heads[arc]
                if level[j] < 0 and room[arc] > least:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [depth >= 0 for depth in level]
        tried = [0] * n
        for start in range(n):
            while level[start] == 0 and spare[start] > least:
                path: list[int] = []
                i = start
                while wants[i] <= least:
                    while tried[i] < len(near[i]):
                        arc = near[i][tried[i]]
                        if room[arc] > least and level[heads[arc]] == level[i] + 1:
                            break
                        tried[i] += 1
                    if tried[i] < len(near[i]):
                        path.append(near[i][tried[i]])
                        i = heads[path[-1]]
                    elif path:
                        arc = path.pop()
                        i = heads[arc ^ 1]
                        tried[i] += 1
                    else:
                        i = -1
                        break
                if i < 0:
                    break
                flow = min([spare[start], wants[i], *(room[arc] for arc in path)])
                spare[start] -= flow
                wants[i] -= flow
                for arc in path:
                    room[arc] -= flow
                    room[arc ^ 1] += flow


def judged(blocks: list[Block]) -> list[float]:
    """The classifier's log odds of each block."""
    own = bodies(blocks)
    return [evidence(block, block.place in SOFT and block.mark in own) for block in blocks]


def labelled(blocks: list[Block]) -> list[bool]:
    """Whether each block is content."""
    odds = judged(blocks)
    source = [math.log1p(math.exp(z)) for z in odds]
    sink = [math.log1p(math.exp(-z)) for z in odds]
    arcs: list[tuple[int, int, float]] = []
    last: dict[tuple[str, int], int] = {}
    for k, block in enumerate(blocks):
        if k:
            arcs.append((k - 1, k, ADJACENT))
        for kind, number, weight in (
            ("container", block.container, SAME_CONTAINER), ("parent", block.parent, SAME_PARENT)
        ):
            if (before := last.get((kind, number))) is not None:
                arcs.append((before, k, weight))
            last[kind, number] = k
    return minimum_cut(source, sink, arcs)


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(
        block.text for block, content in zip(blocks, labelled(blocks), strict=True) if content
    )


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """The main text of each row: page_id, url, text, n_chars (code points).

    Blocks are joined in page order by a blank line, white space in one is one space,
    character references are decoded. A null or empty page, or one without content, has
    an empty text. Broken markup is read as far as it goes: what is never closed is
    closed by the end. Repeated rows are read each; other columns are not.
    """
    chosen = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.col(page).alias("html"),
    )
    return chosen.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
