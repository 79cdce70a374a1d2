"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .base import map_batches, texts_of

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul head".split()
)
RAW = re.compile(r"</(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>])", re.I)
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Tags that an opening tag of the first kind ends, if they are open in the same block.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements that never hold main text, and words of a class, id or role that say so.
APART = frozenset("head script style noscript template nav header footer aside button select textarea dialog menu iframe svg canvas object noembed noframes xmp datalist".split())
APART_WORDS = re.compile(
    r"^(ads?|adverts?|advertisement|advertising|adbox|adslot|banner|sponsor(ed)?|promo(tion)?s?|nav|navbar|navigation|menus?|menubar|sidebar|side|rail|aside|footer|header|masthead|"
    r"topbar|toolbar|breadcrumbs?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|toast|comments?|commentlist|replies|reply|disqus|discussion|responses|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|subscription|signup|login|search|form|widgets?|pagination|pager|tags|copyright|legal|disclaimer|complementary|contentinfo|dialog)$"
)
MAIN_WORDS = frozenset("main article".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
#: Power that length and punctuation of a path keep in the element that is most likely the article.
LEAST_POWER = 0.2
#: What text of an element with a telling class, id or role counts; what a mark (article, main) multiplies the evidence of an element with.
CLASS_WEIGHT, MARK_WEIGHT = 0.05, 25.0
#: Power of a side's share of the evidence. Least score of a path. Share of link text in the element up to which linked blocks are part of it. Characters to a punctuation mark in plain sentences.
SIDE_POWER, LEAST_SCORE, LINK_SHARE, SENTENCE = 4, 0.2, 0.1, 100
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that wrap whole pages: their class words say nothing about a part of the page.
WHOLE = frozenset("html body".split())


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """Whether the attributes say that an element is hidden, that it is apart from the main text, or that it is the main text."""
    hidden = apart = main = False
    for name, *value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(value).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif name in ("class", "id", "role"):
            words = [w for x in value.split() for w in (x, *re.split(r"[-_]+", x))]
            apart |= any(map(APART_WORDS.match, words))
            main |= name == "role" and value in MAIN_WORDS
    return hidden, apart, main


class Node:
    """A stretch of text between tags: number of its path of blocks from the root, block, whether that is apart by its tags, the marked element it is in (0: none), the form (0: none), and whether a class word speaks against it."""

    __slots__ = ("path", "block", "text", "apart", "main", "link", "form", "classed")

    def __init__(self, path: int, block: int, text: str, apart: bool, main: int, link: bool, form: int, classed: bool = False) -> None:
        self.path, self.block, self.text, self.apart, self.main, self.link, self.form, self.classed = path, block, text, apart, main, link, form, classed


def text_nodes(page: str) -> list[Node]:
    """Texts of the page in order. Unclosed and stray tags are taken as browsers do in the main cases.

    Paths are numbered, each by its parent's number and its last tag, so that deep nesting costs no more than its tags.
    """
    # tag, path, apart by what it is, apart by a class word, innermost marked element, link, form
    stack: list[tuple[str, int, bool, bool, int, bool, int]] = [("", 0, False, False, 0, False, 0)]
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    nodes: list[Node] = []
    block, at, n, marked, forms = 0, 0, len(page), 0, 0

    def close(i: int) -> None:
        opened.subtract(x[0] for x in stack[i:])
        del stack[i:]

    def add(text: str) -> None:
        if text:
            _, path, hard, soft, main, link, form = stack[-1]
            nodes.append(Node(path, block, text, hard, main, link, form, soft))

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            block += 1
        if m[1]:
            # a closing tag without an open partner is dropped; one of a block ends what is open in it
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        ends = {"p"} if tag in CLOSES_P else SAME_LEVEL.get(tag, ())
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        _, path, hard, soft, main, link, form = stack[-1]
        hidden, named, is_main = _named(m[3]) if m[3] else (False, False, False)
        # a heading in an article's own header belongs to it
        if tag in HEADINGS and stack[-1][0] == "header" and main:
            hard, soft = stack[-2][2:4]
        if is_main or tag in ("article", "main"):
            # the words and forms around the outermost marked element are those of wrappers
            if not main:
                soft, form = False, 0
            marked += 1
            main = marked
        if tag == "form":
            forms += 1
            form = form or forms
        hard |= tag in APART or hidden and tag not in WHOLE
        if tag in BLOCK or tag in APART:
            path = paths.setdefault((path, tag), len(paths) + 1)
        opened[tag] += 1
        stack.append((tag, path, hard, soft or named and tag not in WHOLE, main, link or tag == "a", form))
        if tag in RAW_TAGS:
            end = next((x for x in RAW.finditer(page, at) if x[1].lower() == tag), None)
            add(page[at : end.start() if end else n])
            at = end.start() if end else n
    return _within_forms(nodes)


def _within_forms(nodes: list[Node]) -> list[Node]:
    """A form is apart, unless it wraps the page: it holds more of the text that is not apart than all that is outside it."""
    size: dict[int, int] = {}
    for x in nodes:
        if not x.apart and not x.classed:
            size[x.form] = size.get(x.form, 0) + len(x.text.strip())
    total = sum(size.values())
    for x in nodes:
        x.apart |= x.form > 0 and 2 * size.get(x.form, 0) <= total
    return nodes


def content_paths(nodes: list[Node]) -> set[tuple[int, bool, int]]:
    """Tag paths (with the class words' verdict and the marked element) whose fused ratio passes the threshold.

    Paths end at the innermost block, so that inline tags and links of a
    sentence count with it. Text length and punctuation are summed per path and
    divided by the number of its blocks; both ratios are smoothed along the page
    over neighbouring paths of their kind, and fused by their product; the share of link text
    weighs against a path, less so where an element holds few links. The
    threshold is the deviation of the ratios, LEAST_SCORE at least.

    Marks and class words are weights of what the ratios say. Class words cut a
    path down to CLASS_WEIGHT of its ratio. The evidence of an element is its
    text, by how much it is made of sentences, less links. That of a marked
    element counts MARK_WEIGHT times, so a short article stands against a long
    unmarked block, and a mere teaser does not; marked elements on the one
    side and all unmarked text on the other are weighted by a power of their
    share of the greater evidence, and each side has ratios of its own. In a marked element that holds a share s of
    the evidence of the greatest marked one, length and punctuation count with
    the power (1 - s)^2, but LEAST_POWER at least: in the article itself a path
    needs little of them, in a card beside it much.
    """
    sums: dict[tuple[int, bool, int], list] = {}
    for x in nodes:
        text = x.text.strip()
        if text and not x.apart:
            s = sums.setdefault((x.path, x.classed, x.main), [0.0, 0.0, set(), 0.0])
            s[0] += len(text)
            s[1] += len(PUNCTUATION.findall(text))
            s[2].add(x.block)
            s[3] += len(text) * x.link
    if not sums:
        return set()
    keys = list(sums)
    length, marks, count, links = np.array([(a, b, len(c), d) for a, b, c, d in sums.values()]).T
    classed, main = np.array([k[1] for k in keys]), np.array([k[2] > 0 for k in keys])
    weight = np.where(classed, CLASS_WEIGHT, 1.0)
    kernel = np.array([0.25, 0.5, 0.25])

    def smooth(v: np.ndarray) -> np.ndarray:
        out = np.empty(len(v))
        for kind in (classed & main, classed & ~main, ~classed & main, ~classed & ~main):
            if kind.any():
                out[kind] = np.convolve(np.pad(v[kind], 1, "edge"), kernel, "valid")
        return out

    _, place = np.unique([k[2] for k in keys], return_inverse=True)
    total = lambda v: np.bincount(place, v)[place]
    plain = 1 - links / length * np.minimum(1, total(links) / total(length) / LINK_SHARE)
    fused = (0.5 * (length / count) * (1 + marks / count) + 0.5 * smooth(length / count) * smooth(1 + marks / count)) * weight
    if (fused * plain).max() <= 0:
        return set()
    evidence = total(length * (0.25 + 0.75 * np.minimum(1, marks * SENTENCE / length)) * plain * weight)
    marked, unmarked = evidence[main].max(initial=0) * MARK_WEIGHT, evidence[~main].max(initial=0)
    side = (np.where(main, marked, unmarked) / max(marked, unmarked)) ** SIDE_POWER
    share = evidence / (evidence[main].max(initial=0) or 1)
    ratio = np.zeros(len(keys))
    for kind in (main, ~main):
        if (top := (fused * plain)[kind].max(initial=0)) > 0:
            ratio[kind] = np.minimum(fused[kind] / top, 1) * plain[kind]
    power = np.where(main, np.maximum((1 - share.clip(0, 1)) ** 2, LEAST_POWER), 1.0)
    score = np.where(classed, ratio, ratio**power) * side
    kept = ratio[(ratio > 0) & (side == 1)]
    least = max(kept.std(), LEAST_SCORE)
    if not (score >= least).any():  # all text has a telling class, or hardly any is there
        return {k for k, x in zip(keys, score) if x == score.max() > 0}
    return {k for k, x in zip(keys, score) if x >= least}


def main_text(page: str) -> str:
    """Blocks of the nodes on content paths: character references decoded, white space as one space, joined by one space."""
    nodes = text_nodes(page)
    good = content_paths(nodes)
    blocks: list[list[str]] = []
    last = None
    for x in nodes:
        if not x.apart and (x.path, x.classed, x.main) in good:
            if x.block != last:
                blocks.append([])
                last = x.block
            blocks[-1].append(x.text)
    return " ".join(t for b in blocks if (t := " ".join(html.unescape("".join(b)).split())))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html); null html is an empty page, repeated rows stay."""

    def run(batch: dict) -> Iterator[dict]:
        page, url, source = batch["page_id"].to_pylist(), batch["url"].to_pylist(), texts_of(batch["html"])
        for a in range(0, len(source), 200):
            text = [main_text(x) for x in source[a : a + 200]]
            yield {"page_id": page[a : a + 200], "url": url[a : a + 200], "text": text, "n_chars": list(map(len, text))}

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
