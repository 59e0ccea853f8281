"""Main text of web pages: blocks are labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_text_batches, table, text_of, unit_hash

TAG = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
ATTRIBUTES = re.compile(r"[^>\"']*")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose content is no text of the page.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "select", "textarea", "button"}
RAW = {"script", "style", "textarea", "title"}
RAW_END = {t: re.compile(rf"</{t}(?![A-Za-z0-9:-])", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that can stand in a head; any other ends it.
HEAD_TAGS = {"head", "html", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "noframes", "template"}
#: Elements that stand within a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img input".split())
#: Elements that, like article and main, say what a part of a page is: they are seeds of the cut and give the classifier its training labels.
BOILERPLATE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
#: Words of class, id and role names from which a feature's weight starts before pages are seen.
CONTENT_WORDS = set("article content main post entry story body text".split())
SURE_WORDS = set("ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr comment comments replies disqus respond".split())
BOILERPLATE_WORDS = SURE_WORDS | set(
    "banner sponsor promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead footer sidebar side aside widget related recommended recommendations notice alert popup modal overlay newsletter "
    "subscribe subscription signup login register search share sharing social follow reply discussion pagination pager "
    "tags copyright legal disclaimer toolbar skip".split()
)
#: Hashed features of a model: a bound on its size.
FEATURES = 4096
#: What features weigh before any page is seen, and the number of blocks that this counts as much as.
CONTENT_NAME, BOILERPLATE_NAME, SURE_NAME, PRIOR_BLOCKS = 1.0, -2.5, -6.0, 20
TEXT_PRIOR = {"words 0": -1.0, "words 1": -1.0, "words 4": 1.5, "words 5": 2.0, "words 6": 2.5, "words 7": 2.5, "links 0": 0.5, "links 2": -1.0, "links 3": -1.5, "links 4": -1.5, "stop True": 0.7, "stop False": -0.5}
#: Bounds of one feature's learned weight, of the sum of a text's and of the sum of its names'.
MOST_WEIGHT, MOST_TEXT, MOST_NAMES = 2.5, 4.0, 6.0
#: Pages that the classifier is fitted on, in the mean: a seeded hash draws them.
FIT_PAGES = 20_000
#: Elements that only arrange what a container holds: their blocks count as the container's own.
ARRANGING = set("ul ol dl table thead tbody tfoot tr blockquote figure section".split())
#: Blocks of these kinds are short by nature; one that isn't mostly links is tied to its container by LISTED_WEIGHT.
LISTED = set("li td th dt dd caption figcaption blockquote pre h2 h3 h4 h5 h6".split())
#: What shows that a form is a frame around the page, and no form to fill in.
FRAME = re.compile(r"<(?:article|main|h1)[\s>]", re.I)
FORM_END = re.compile(r"</form[\s>]", re.I)
#: Boilerplate elements that no article inside them overrides; a form may hold a whole page.
HELD_TAGS = BOILERPLATE_TAGS - {"form"}
#: Cost of calling a block what its element is not, and of calling content what stands outside the articles of a page that has some; the edges' weights.
SEED_COST, OUTSIDE_COST, NEXT_WEIGHT, NEAR_WEIGHT, LISTED_WEIGHT = 3.0, 2.0, 0.6, 0.6, 1.5
#: What a block's text may weigh against an article around it that no name speaks against: less than the article.
LEAST_SURE = 1.0


def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


@dataclass
class Block:
    text: str
    tag: str
    names: frozenset[int]  # features of the class, id and role words of the open elements, from the innermost labelled article or main on
    linked: int  # characters in links
    seed: int  # 1 content, -1 boilerplate, 0 unknown
    inside: bool  # in an article or main element
    depth: int
    parent: int  # number of the container: the element around the block's own, past those that only arrange
    steps: int  # elements between this block and the one before

    @property
    def listed(self) -> bool:
        return self.tag in LISTED and 2 * self.linked <= len(self.text)


@dataclass
class Element:
    tag: str
    number: int
    parent: int
    names: frozenset[int]
    seed: int
    held: bool
    inside: bool


def tag_end(page: str, at: int) -> int:
    """Where the tag whose attributes start at `at` ends: at the first > outside quoted values, else at the page's end. A quote that isn't closed, or doesn't follow a =, is none."""
    low = at
    while True:
        at = ATTRIBUTES.match(page, at).end()
        if at >= len(page) or page[at] == ">":
            return at
        close = page.find(page[at], at + 1) if page[low:at].rstrip().endswith("=") else -1
        at = low = (close if close >= 0 else at) + 1


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in page order; markup may be broken, cut off or nested wrongly. Time is linear in the page's length.

    An open element ends with its end tag or that of an element around it, a head also with the body or whatever can't stand in one; a link with its end tag or the
    element it stands in. White space inside a block becomes one space. Elements label the part they enclose: an article or main what isn't in another element inside that says
    otherwise; a boilerplate name inside an article, or as an article's only kind of name, leaves it open. Names of html and body count for nothing, and those around an article or main don't either.
    """
    out: list[Block] = []
    stack = [Element("", 0, 0, frozenset(), 0, False, False)]
    counts: Counter[str] = Counter()
    text: list[str] = []
    linked = skipped = number = at = before = 0
    link_depth = 0  # of the element in which the open link stands
    form_end = -1  # of the form that was opened last, and of those in it
    lowest = 1  # elements that were open all the time since the last block

    def flush() -> None:
        nonlocal linked, before, lowest
        if text:
            if whole := " ".join(html.unescape("".join(text)).split()):
                e, depth = stack[-1], len(stack)
                low = min(lowest, depth)
                out.append(Block(whole, e.tag, e.names, linked, e.seed, e.inside, depth, e.parent, before + depth - 2 * low))
                before = lowest = depth
            text.clear()
        linked = 0

    def close() -> str:
        nonlocal skipped, lowest, link_depth
        if not skipped and stack[-1].tag not in SKIPPED:
            flush()
        tag = stack.pop().tag
        counts[tag] -= 1
        skipped -= tag in SKIPPED
        lowest = min(lowest, len(stack))
        if len(stack) < link_depth:
            link_depth = 0
        return tag

    def end_head() -> None:
        while close() != "head":
            pass

    def said(piece: str) -> None:
        nonlocal linked
        if not piece:
            return
        if stack[-1].tag == "head" and piece.strip():
            end_head()
        if not skipped:
            text.append(piece)
            if link_depth:
                linked += len(piece)

    last = page.rfind(">")
    start = 0  # of text that has not been said
    while (at := page.find("<", at)) >= 0:
        m = TAG.match(page, at + 1)
        if not m:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), at) and at < last:
                end = page.find(">", at) + 1
            else:
                at += 1
                continue
            said(page[start:at])
            start = at = end
            continue
        said(page[start:at])
        end = tag_end(page, m.end())
        attributes = page[m.end() : end]
        start = at = min(end + 1, len(page))
        tag = m[2].lower()
        if tag in INLINE:
            if tag in VOID:
                said(" ")
            elif tag == "a":
                link_depth = 0 if m[1] else len(stack)
            continue
        if m[1] and not counts[tag] and tag != "p":
            continue  # the end of nothing
        if not skipped and (tag == "p" if m[1] else tag not in SKIPPED or tag in ("head", "title")):
            flush()
        if m[1]:
            if counts[tag] > 0:
                while close() != tag:
                    pass
            continue
        if stack[-1].tag == "head" and tag not in HEAD_TAGS or tag == "body" and counts["head"] > 0:
            end_head()
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            found = RAW_END[tag].search(page, at)
            start = at = min(tag_end(page, found.end()) + 1, len(page)) if found else len(page)
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack[-1].tag == tag:
            close()  # ends one of its kind that is still open
        said_names: set[str] = set()
        if tag not in ("html", "body") and "=" in attributes:
            for name in NAMED.finditer(attributes):
                said_names.update(w for w in re.split(r"[^a-z]+", (name[2] or name[3] or name[4] or "").lower()) if w)
        outer = stack[-1]
        own = frozenset(feature(f"in {x}") for x in said_names)
        bad, good = bool(said_names & BOILERPLATE_WORDS), bool(said_names & CONTENT_WORDS)
        names = outer.names if own <= outer.names else outer.names | own
        seed, held, inside = outer.seed, outer.held or tag in HELD_TAGS, outer.inside
        if tag == "form" and at > form_end:
            found = FORM_END.search(page, at)
            form_end = found.start() if found else len(page)
        if tag in BOILERPLATE_TAGS and not (tag == "form" and FRAME.search(page, at, form_end)):
            seed = -1
        elif tag == "main" or tag == "article" and not held:
            inside = True
            if bad and not good:
                seed = min(seed, 0)
            else:
                seed, held, names = 1, False, own
        elif bad:
            seed = min(seed, 0)
        number += 1
        stack.append(Element(tag, number, outer.parent if outer.tag in ARRANGING else outer.number, names, seed, held, inside))
        counts[tag] += 1
        skipped += tag in SKIPPED
    said(page[start:])
    flush()
    return out


def features(b: Block) -> list[int]:
    """Numbers of the block's features besides its names: its element, its length, share of links, ends and digits."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    said = (
        f"tag {b.tag}", f"words {min(7, int(math.log2(words)))}", f"links {round(4 * min(1.0, b.linked / n))}",
        f"stop {b.text[-1] in '.!?:;'}", f"commas {min(3, b.text.count(',') * 10 // words)}", f"depth {min(8, b.depth)}",
        f"sign {'©' in b.text or '|' in b.text or '»' in b.text}", f"digits {min(3, sum(map(b.text.count, '0123456789')) * 8 // n)}",
    )
    return sorted(map(known_feature, said))


@lru_cache(maxsize=4096)
def known_feature(name: str) -> int:
    return feature(name)


def content_side(cost: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes the minimum cut leaves on the content side.

    cost > 0: the capacity from the source, paid for calling the node boilerplate; < 0: the capacity to the sink. edges
    have the same capacity both ways. A node whose own cost exceeds all its edges lies on its side in every minimum cut, so it is
    taken out and its edges become its neighbours' costs; the others get a maximum flow by blocking flows over shortest paths.
    """
    net = cost.astype(float).tolist()
    n, tiny = len(net), 1e-12
    near: list[dict[int, float]] = [{} for _ in net]
    for i, j, w in edges:
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    sure = [i for i in range(n) if abs(net[i]) > sum(near[i].values()) + 1e-9]
    while sure:
        i = sure.pop()
        if side[i] is not None:
            continue
        side[i] = net[i] > 0
        for j, w in near[i].items():
            net[j] += w if side[i] else -w
            del near[j][i]
            if side[j] is None and abs(net[j]) > sum(near[j].values()) + 1e-9:
                sure.append(j)
        near[i] = {}
    free = [i for i in range(n) if side[i] is None]
    if not free:
        return np.array(side, bool)
    # Residual capacities: from the source, to the sink, and of arcs (2k and 2k + 1 are each other's reverse).
    source, sink = {i: max(0.0, net[i]) for i in free}, {i: max(0.0, -net[i]) for i in free}
    to: list[int] = []
    room: list[float] = []
    arcs: dict[int, list[int]] = {i: [] for i in free}
    for i in free:
        for j, w in near[i].items():
            if i < j:
                arcs[i].append(len(to))
                arcs[j].append(len(to) + 1)
                to += [j, i]
                room += [w, w]
    while True:
        level = {i: 0 for i in free if source[i] > tiny}
        queue, reached = deque(level), False
        while queue:
            i = queue.popleft()
            reached = reached or sink[i] > tiny
            for k in arcs[i]:
                if room[k] > tiny and to[k] not in level:
                    level[to[k]] = level[i] + 1
                    queue.append(to[k])
        if not reached:
            for i in free:
                side[i] = i in level
            return np.array(side, bool)
        at = dict.fromkeys(level, 0)
        for start in [i for i in level if level[i] == 0]:
            path: list[int] = []
            here = start
            while source[start] > tiny:
                if sink[here] > tiny:
                    pushed = min(source[start], sink[here], *(room[k] for k in path))
                    source[start] -= pushed
                    sink[here] -= pushed
                    for k in path:
                        room[k] -= pushed
                        room[k ^ 1] += pushed
                    full = next((x for x, k in enumerate(path) if room[k] <= tiny), len(path))
                    if full < len(path):
                        here = to[path[full] ^ 1]
                        del path[full:]
                    continue
                while at[here] < len(arcs[here]):
                    k = arcs[here][at[here]]
                    if room[k] > tiny and level.get(to[k], -1) == level[here] + 1:
                        break
                    at[here] += 1
                if at[here] < len(arcs[here]):
                    path.append(arcs[here][at[here]])
                    here = to[path[-1]]
                elif path:
                    here = to[path.pop() ^ 1]
                    at[here] += 1
                else:
                    break


def edges_of(found: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in page order, the closer their elements in the tree the stronger; and the next block of the same element."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, NEXT_WEIGHT / (1 + b.steps)))
        if b.parent in last:
            short = found[last[b.parent]].listed or b.listed
            out.append((last[b.parent], i, LISTED_WEIGHT if short else NEAR_WEIGHT))
        last[b.parent] = i
    return out


def main_text(page: str, weights: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    held = any(b.seed > 0 for b in found)
    cost = np.empty(len(found))
    for i, b in enumerate(found):
        said = max(-MOST_TEXT, min(MOST_TEXT, weights[features(b)].sum() + weights[FEATURES]))
        named = max(-MOST_NAMES, min(MOST_NAMES, weights[list(b.names)].sum())) if b.names else 0.0
        if b.seed > 0 and named >= 0:
            said = max(said, LEAST_SURE - SEED_COST)
        elif not b.seed and named > 0 and b.listed:
            said = max(said, -named / 2)
        cost[i] = said + named + SEED_COST * b.seed - (OUTSIDE_COST if held and not b.inside and not b.seed else 0.0)
    side = content_side(cost, edges_of(found))
    return "\n\n".join(b.text for b, s in zip(found, side, strict=True) if s)


def prior_weights() -> np.ndarray:
    """The weights before any page is seen."""
    out = np.zeros(FEATURES + 1)
    for words, weight in ((CONTENT_WORDS, CONTENT_NAME), (BOILERPLATE_WORDS, BOILERPLATE_NAME), (SURE_WORDS, SURE_NAME)):
        for x in words:
            out[feature(f"in {x}")] = weight
    for name, weight in TEXT_PRIOR.items():
        out[feature(name)] = weight
    return out


def block_weights(pages: DataFrame, html_column: str = "html", fit_pages: int = FIT_PAGES) -> np.ndarray:
    """Naive Bayes weights of the features, and of the kinds' shares in the last place, from the labelled blocks of about fit_pages pages.

    The pages are drawn by a hash of their markup, all of them where there are no more. Each task sums a vector of FEATURES + 1 counts for both labels; Spark adds them up by feature, so at most
    2 * (FEATURES + 1) rows come back. A feature's weight lies between its prior and what its blocks say, the nearer to that the more they are.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, FEATURES + 1), np.int64)
        for batch in batches:
            for page in batch["_html"]:
                for b in blocks(page):
                    if b.seed:
                        total[int(b.seed > 0), list({*features(b), *b.names, FEATURES})] += 1
        kind, column = np.nonzero(total)
        yield pd.DataFrame({"kind": kind, "feature": column, "n": total[kind, column]})

    texts = in_text_batches(pages).select(text_of(html_column).alias("_html"))
    share = fit_pages / max(1, texts.count())
    drawn = texts.where(unit_hash("_html", seed=8) < share) if share < 1 else texts
    rows = drawn.mapInPandas(count, "kind long, feature long, n long").groupBy("kind", "feature").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, FEATURES + 1))
    for r in rows:
        counts[r.kind, r.feature] = r.n
    every, weights = counts[:, FEATURES], prior_weights()
    if not every.all():
        return weights
    share_of = (counts + 0.5) / (every[:, None] + 1)
    seen = counts.sum(0)
    learned = np.clip(np.log(share_of[1]) - np.log(share_of[0]), -MOST_WEIGHT, MOST_WEIGHT)
    weights = (seen * learned + PRIOR_BLOCKS * weights) / (seen + PRIOR_BLOCKS)
    weights[FEATURES] = max(-MOST_WEIGHT, min(MOST_WEIGHT, math.log(every[1] / every[0])))
    return weights


def extract_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages without html, with text and n_chars.

    A block is a run of text between block elements. A classifier, trained on blocks whose elements say what
    they are, gives each block a cost for either label from its names, text and links; with the cost of those elements these are the terminal
    capacities. Neighbours in the page and in the tree are tied by edges, and the minimum cut labels all blocks. Content blocks are
    joined by a blank line. Inside an article or main that no name speaks against, a text weighs less than the element, so a short list, table or heading stays; where names speak for a part of a page, the same holds for its lists, tables, headings and quotes that aren't mostly links. A null or empty page, or one without content, has an empty text. Pages of any length are read whole;
    repeated rows are returned each, and no rows give none; columns named text or n_chars are replaced. Where both labels cost the same a block is boilerplate.
    """
    weights = block_weights(pages, html_column)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page, weights) for page in batch], dtype=object)

    rest = [c for c in pages.columns if c not in {html_column, "text", "n_chars"}]
    return pages.select(*rest, extract(text_of(html_column)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
