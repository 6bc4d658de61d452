"""Main text of web pages: boosted trees judge the nodes, a tree-wide decoding decides.

A page is read into nodes with figures of their subtree, attributes, depth and
siblings.  Trees give each node the chance to be a container, main text or
boilerplate.  The decoding takes the likeliest choice for the whole tree among
those that agree: below boilerplate all is boilerplate, and below main text no
container begins again.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import Boosted, boost
from .common import batches, table, texts_of

#: Pages that the trees are fitted on at most; a longer page than FIT_CHARS teaches nothing.
FIT_PAGES = 250
FIT_CHARS = 60_000

#: Kinds of elements.
TAGS = {
    "page": "html body", "head": "head title meta link base", "nav": "nav menu dialog",
    "header": "header hgroup", "footer": "footer address", "aside": "aside",
    "form": "form input button select option label textarea fieldset legend optgroup datalist",
    "code": "script style noscript template iframe svg object embed canvas",
    "article": "article main", "section": "section", "div": "div center", "p": "p",
    "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd", "link": "a",
    "inline": "b i em strong span small sub sup u s abbr cite q mark time font kbd var samp del ins "
              "big tt bdi bdo wbr code dfn strike nobr",
    "table": "table thead tbody tfoot tr td th caption colgroup col",
    "figure": "figure figcaption img picture video audio source", "break": "br hr",
    "quote": "blockquote pre details summary",
}
#: Words in class, id and role attributes.
WORDS = {
    "main": "article content post entry story main body text",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar branding logo", "footer": "footer copyright colophon",
    "side": "sidebar aside rail related widget recommended trending popular",
    "ad": "ad ads advert adverts advertisement banner promo promotion sponsor sponsored",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe "
              "subscription paywall disclaimer",
    "comment": "comment comments reply replies discuss discussion disqus respond",
    "form": "form login search signup share sharing social",
}
_KINDS, _TOPICS = list(TAGS), list(WORDS)
_KIND_OF = {t: i for i, kind in enumerate(_KINDS) for t in TAGS[kind].split()}
_TOPIC_OF = {w: i for i, topic in enumerate(_TOPICS) for w in WORDS[topic].split()}
_OTHER = len(_KINDS)
_BITS = len(_KINDS) + 1 + len(_TOPICS)
_INLINE = frozenset((TAGS["inline"] + " a img label").split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(r"</%s\b[^>]*>?" % t, re.I) for t in
        ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
#: Elements whose end may be left out: they end when one of these begins inside the same parent.
_P_ENDS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption "
                    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre "
                    "section table ul".split())
_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
         "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
         "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist"))}

_APART = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
#: A tag ends behind its quoted values; where a quote is never closed, at the next end of a tag.
_TOKEN = re.compile(
    _APART + r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: Behind the last end of a tag there are no tags any more.
_TAIL = re.compile(_APART, re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TRUTH = re.compile(r"data-truth=\"(\d)\"")


class Page:
    """Nodes of a page in document order, and its texts with their node and block."""

    def __init__(self, html: str):
        self.tags: list[str] = ["#page"]
        self.parents, self.ends, self.depths = [-1], [0], [0]
        self.own, self.above = [1 << _OTHER], [0]
        self.truths: list[int] = [0]
        #: (node, block, text), character references decoded.
        self.texts: list[tuple[int, int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        self.stack: list[int] = []
        #: Where in the stack elements of a name are, and those that are neither inline nor a paragraph.
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []
        self._push(0)
        block, at = 0, 0
        end, last = len(html), html.rfind(">")
        while at < end:
            m = (_TOKEN if at <= last else _TAIL).search(html, at)
            stop = m.start() if m else end
            if stop > at:
                self.texts.append((self.stack[-1], block, unescape(html[at:stop])))
            if m is None:
                break
            at = m.end()
            closing, name, attributes = m.groups()[:3] if m.re is _TOKEN else (None, None, None)
            if name is None and m.re is _TOKEN:
                closing, name, attributes = m.groups()[3:]
            if name is None:
                if m.group().startswith("<![CDATA["):
                    self.texts.append((self.stack[-1], block, m.group()[9:].removesuffix("]]>")))
                continue
            name = name.lower()
            if name not in _INLINE:
                block += 1
            if closing:
                if self.places.get(name):
                    self._pop(self.places[name][-1])
                continue
            self._imply(name)
            node = self._open(self.stack[-1], name, attributes)
            if name in _VOID or attributes.endswith("/"):
                self.ends[node] = len(self.tags)
            elif name in _RAW:
                close = _RAW[name].search(html, at)
                inner = html[at:close.start() if close else end]
                if inner:
                    self.texts.append((node, block, inner))
                at = close.end() if close else end
                self.ends[node] = len(self.tags)
                block += 1
            else:
                self._push(node)
        self._pop(0)

    def _push(self, node: int) -> None:
        place, name = len(self.stack), self.tags[node]
        self.stack.append(node)
        self.places.setdefault(name, []).append(place)
        if name not in _INLINE and name != "p":
            self.solid.append(place)

    def _pop(self, to: int) -> None:
        """Ends all elements from a place of the stack on; each is ended once."""
        while len(self.stack) > to:
            node = self.stack.pop()
            self.ends[node] = len(self.tags)
            self.places[self.tags[node]].pop()
            if self.solid and self.solid[-1] == len(self.stack):
                self.solid.pop()

    def _last(self, names: tuple[str, ...] | list[str]) -> int:
        """The innermost open element of these names, -1 without one."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def _open(self, parent: int, name: str, attributes: str) -> int:
        node = len(self.tags)
        bits = 1 << _KIND_OF.get(name, _OTHER)
        truth = self.truths[parent]
        if attributes and "=" in attributes:
            for found in _ATTRIBUTE.finditer(attributes):
                for w in _WORD.findall(found.group(1) or found.group(2) or found.group(3) or ""):
                    if (topic := _TOPIC_OF.get(w.lower())) is not None:
                        bits |= 1 << (_OTHER + 1 + topic)
            if told := _TRUTH.search(attributes):
                truth = int(told.group(1))
        self.tags.append(name)
        self.parents.append(parent)
        self.ends.append(0)
        self.depths.append(self.depths[parent] + 1)
        self.own.append(bits)
        self.above.append(self.above[parent] | self.own[parent])
        self.truths.append(truth)
        return node

    def _imply(self, name: str) -> None:
        """Ends the elements whose end may be left out before this one begins."""
        if name in _P_ENDS:
            # A paragraph with nothing but inline elements open inside it.
            inner = self._last(["p"])
            if inner > (self.solid[-1] if self.solid else -1):
                self._pop(inner)
        elif name in _SAME:
            ended, borders = _SAME[name]
            ended = ended.split()
            while (inner := self._last(ended)) > self._last(borders):
                self._pop(inner)
                if name != "tr":
                    break


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of all pages, subtree figures by differences of running sums."""
    sizes = [len(p.tags) for p in pages]
    first = np.concatenate([[0], np.cumsum(sizes)])
    shift = np.repeat(first[:-1], sizes)
    cat = lambda name: np.concatenate([np.array(getattr(p, name), np.int64) for p in pages])
    parent, end, depth, own, above = map(cat, ("parents", "ends", "depths", "own", "above"))
    top = parent < 0
    parent = np.where(top, np.arange(len(parent)), parent + shift)
    end = end + shift
    n = len(parent)
    text, dots = np.zeros(n), np.zeros(n)
    for p, f in zip(pages, first, strict=False):
        for node, _, t in p.texts:
            text[f + node] += len(t) - t.count(" ")
            dots[f + node] += t.count(".") + t.count(",")
    link = (own >> _KIND_OF["a"] | above >> _KIND_OF["a"]) & 1
    code = (own >> _KIND_OF["script"] | above >> _KIND_OF["script"]) & 1
    text = text * (1 - code)
    is_p = own >> _KIND_OF["p"] & 1

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[end] - sums[:n]

    whole = below(text)
    page_text = np.maximum(1, whole[np.repeat(first[:-1], sizes)])
    before = np.concatenate([[0], np.cumsum(text)])[:n] - np.concatenate(
        [[0], np.cumsum(text)])[np.repeat(first[:-1], sizes)]
    nodes = end - np.arange(n)
    children = np.bincount(parent[~top], minlength=n)
    order = np.argsort(parent, kind="stable")
    place = np.empty(n, np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=n))])[parent[order]]
    place[order] = np.arange(n) - starts
    numbers = [depth, place, children[parent], children, np.log1p(whole), np.log1p(text),
               below(text * link) / np.maximum(1, whole), nodes / (1 + whole), whole / page_text,
               before / page_text, np.log1p(below(is_p)), below(dots) / np.maximum(1, whole),
               np.log1p(nodes), np.log1p(whole[parent])]
    bits = [(b >> i) & 1 for b in (own, above, own[parent]) for i in range(_BITS)]
    return np.stack(numbers + bits, axis=1).astype(np.float32)


#: What a node can be.
CONTAINER, MAIN, BOILERPLATE = 0, 1, 2


def decode(parents: list[int], chances: np.ndarray) -> list[int]:
    """The likeliest states of a whole tree, nodes in document order.

    Below a container anything may begin; below main text, main text or
    boilerplate; below boilerplate, boilerplate only.  Ties go to boilerplate.
    """
    best = chances.tolist()
    for node in range(len(parents) - 1, 0, -1):
        c, m, b = best[node]
        up = best[parents[node]]
        inner = b if b >= m else m
        up[0] += inner if inner >= c else c
        up[1] += inner
        up[2] += b
    states = [0] * len(parents)
    c, m, b = best[0]
    states[0] = BOILERPLATE if b >= m and b >= c else MAIN if m >= c else CONTAINER
    for node in range(1, len(parents)):
        c, m, b = best[node]
        above = states[parents[node]]
        if above == BOILERPLATE or b >= m and (above == MAIN or b >= c):
            states[node] = BOILERPLATE
        elif above == MAIN or m >= c:
            states[node] = MAIN
    return states


def main_texts(htmls: list[str], model: Boosted) -> list[str]:
    """The main text of each page: blocks of main nodes, white space to one space, joined."""
    pages = [Page(h) for h in htmls]
    if not pages:
        return []
    chances = model.log_chances(features(pages))
    out, first = [], 0
    for page in pages:
        states = decode(page.parents, chances[first:first + len(page.tags)])
        first += len(page.tags)
        blocks: list[list[str]] = []
        last = None
        for node, block, text in page.texts:
            if states[node] == MAIN and page.tags[node] not in _RAW:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        joined = (" ".join("".join(b).split()) for b in blocks)
        out.append(" ".join(b for b in joined if b))
    return out


def lessons(html: str, number: int) -> list[str]:
    """The page with the truth marked in it, as it is and rebuilt in other forms.

    Its paragraphs and headings are the main text of the rebuilt pages; menus,
    notices, adverts, forms, comments and the like are made of its words and
    put around and into it.  `data-truth` holds a node's state and is no feature.
    """
    rng = np.random.default_rng(number)
    pick = lambda *options: options[int(rng.integers(len(options)))]
    found = re.search(r"(?is)<(article)\b[^>]*>(.*?)(?:</article>|\Z)", html)
    source = found.group(2) if found else html
    paragraphs = [re.sub(r"<[^>]*>", "", p) for p in re.split(r"(?i)</?(?:p|br|h\d|div|li)\b[^>]*>", source)]
    paragraphs = [p for p in paragraphs if p.strip()][:30]
    words = " ".join(paragraphs).split() or ["x"]
    some = lambda a, b: " ".join(words[int(i)] for i in rng.integers(len(words), size=rng.integers(a, b)))
    out = []
    if found:
        marked = re.sub(r"(?i)<article\b", '<article data-truth="1"', html)
        marked = re.sub(r"(?i)<(nav|header|footer|aside|form|head|script|style)\b",
                        r'<\1 data-truth="2"', marked)
        marked = re.sub(r"(?i)<div\b([^>]*class=[\"'](?:ad|%s)[\"'])" % "|".join(
            w for t in ("nav", "header", "footer", "side", "ad", "notice", "comment")
            for w in WORDS[t].split()), r'<div data-truth="2"\1', marked)
        out.append(marked)
    topic = lambda t: pick(*WORDS[t].split())
    naming = lambda t: pick('class="%s"', 'id="%s"', 'class="x %s"', 'class="%s-box"', 'class="site-%s"'
                            ) % topic(t)

    def links() -> str:
        return "<ul>%s</ul>" % "".join('<li><a href="/%d">%s</a></li>' % (i, some(1, 4))
                                       for i in range(rng.integers(2, 9)))

    def aside(kind: str) -> str:
        tag = {"nav": pick("nav", "div"), "header": pick("header", "div"), "footer": pick(
            "footer", "div"), "side": pick("aside", "div", "section")}.get(kind, pick("div", "section"))
        plain = tag in ("nav", "header", "footer", "aside") and rng.random() < 0.5
        inner = {
            "nav": links, "header": lambda: pick("<h1>%s</h1>", "<p>%s</p>", "<a href='/'>%s</a>") % some(1, 6),
            "footer": lambda: pick("<p>%s</p>", "%s", "&copy; %s") % some(3, 25) + pick("", links()),
            "side": lambda: "<h3>%s</h3>" % some(1, 4) + pick(links(), "<p>%s</p>" % some(5, 60)),
            "ad": lambda: pick("%s", "<p>%s</p>", "<a href='/x'>%s</a>") % some(3, 30),
            "notice": lambda: pick("%s", "<p>%s</p>", "<p>%s <button>OK</button></p>") % some(5, 40),
            "comment": lambda: "<h3>%s</h3>" % some(1, 3) + "".join(
                '<div%s><p>%s</p></div>' % (pick("", ' class="comment"'), some(5, 60))
                for _ in range(rng.integers(1, 5))),
            "form": lambda: "<label>%s</label><input><button>%s</button>" % (some(1, 4), some(1, 3)),
        }[kind]()
        if kind == "form" and rng.random() < 0.7:
            return '<form data-truth="2">%s</form>' % inner
        return '<%s data-truth="2"%s>%s</%s>' % (tag, "" if plain else " " + naming(kind), inner, tag)

    for _ in range(3):
        tag = pick("article", "article", "main", "div", "section")
        named = "" if tag in ("article", "main") and rng.random() < 0.6 else " " + naming("main")
        body = [pick("<h1>%s</h1>", "<h2>%s</h2>") % some(2, 9)]
        for p in paragraphs or [some(5, 40)]:
            body.append(pick("<p>%s</p>", "<p>%s</p>", "<p><b>%s", "<p>%s</p>", "<blockquote><p>%s</p></blockquote>",
                             "<ul><li>%s</li></ul>", "<div>%s</div>", "<p>%s<br>") % p)
        for kind in rng.choice(["ad", "notice", "side", "form", "comment", "nav"], 2, replace=False):
            if rng.random() < 0.4:
                body.insert(int(rng.integers(1, len(body) + 1)), aside(str(kind)))
        main = '<%s data-truth="1"%s>%s</%s>' % (tag, named, "".join(body), tag)
        if rng.random() < 0.4:
            main = "<div%s>%s%s</div>" % (pick("", ' class="wrapper"', ' id="page"'), main,
                                          pick("", aside("side")))
        head = [aside(k) for k in ("notice", "header", "nav", "ad") if rng.random() < 0.6]
        tail = [aside(k) for k in ("comment", "side", "form", "ad", "nav", "footer") if rng.random() < 0.5]
        out.append('<!DOCTYPE html><html><head data-truth="2"><title>%s</title><style>p{}</style></head>'
                   "<body>%s%s%s%s" % (some(1, 8), "".join(head), main, "".join(tail),
                                       pick("</body></html>", "")))
    return out


def learn(pages: DataFrame, html: str = "html") -> Boosted | None:
    """Trees from at most FIT_PAGES pages of at most FIT_CHARS, those of least hash.

    Hashes are ordered first, so only pages that are picked move, and only
    they reach the driver.  Without any page there is no model.
    """
    short = pages.where(F.char_length(html).between(1, FIT_CHARS)).select(
        html, F.xxhash64(html).alias("_hash"))
    picked = [r["_hash"] for r in short.select("_hash").distinct().orderBy("_hash").limit(
        FIT_PAGES).collect()]
    rows = sorted(short.where(F.col("_hash").isin(picked)).groupBy("_hash").agg(
        F.min(html).alias(html)).select(html, "_hash").collect(), key=lambda r: r["_hash"])
    read = [Page(v) for i, r in enumerate(rows) for v in lessons(r[0], i)]
    if not read:
        return None
    return boost(features(read), np.concatenate([np.array(p.truths) for p in read]), 3)


def extract(pages: DataFrame, model: Boosted | None, page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every whole page.

    Null and empty pages, and pages without main text, have the empty text.
    Broken markup is read as browsers read it, as far as nodes go.  Repeated
    rows are extracted alike; no rows give no rows.
    """
    ddl = "page_id %s, url %s, text string, n_chars bigint" % tuple(
        pages.schema[c].dataType.simpleString() for c in (page_id, url))

    def work(columns: dict) -> dict:
        htmls = texts_of(columns[html])
        texts = main_texts(htmls, model) if model else [""] * len(htmls)
        return {"page_id": columns[page_id], "url": columns[url],
                "text": pa.array(texts, pa.string()), "n_chars": [len(t) for t in texts]}

    return batches(pages.select(page_id, url, html), work, ddl, text=html)


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
