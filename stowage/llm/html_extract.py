"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the whole tree.

A page is parsed into its block-level elements.  Each gets features of its subtree (text, links, tags, text density),
its attribute tokens, its depth, its siblings and what stands above it; boosted trees give the log-odds that the element
is, or holds, main text.  Decoding picks the set of elements with the highest summed log-odds in which no element is
kept under a dropped one (best(node) = max(0, own + children's best), then top-down), so an ancestor and a descendant
never contradict each other.  The trees are fitted here, on pages that make_pages() writes from templates.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import python_side

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Elements by how they are read (fixed by HTML).
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that are left out where they are closed: before the next block begins, the last two wherever that is.
LEFT_OUT = frozenset("select button svg noscript template".split())
CLOSES_P = BLOCKS - {"html", "body", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
#: An open element of the first kind ends where one of the second begins, unless a boundary stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "thead"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
EDGE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
#: Attribute tokens that speak for and against main text.
FOR = frozenset("article content main post entry story body text page blog news prose".split())
AGAINST = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toc tabs", "head": "header head masthead topbar logo branding toolbar",
    "foot": "footer foot copyright legal colophon", "side": "sidebar side aside widget widgets rail related recommended trending popular",
    "ad": "ad ads advert adverts advertisement adbox banner promo promoted sponsor sponsored commercial dfp",
    "note": "notice cookie cookies consent gdpr alert popup modal overlay dialog toast warning paywall", "form": "form login signup subscribe newsletter search register contact",
    "talk": "comment comments commentlist reply replies respond disqus discussion reader feedback", "share": "share sharing social tags meta byline author tools"}
AGAINST = {t: g for g, ts in AGAINST.items() for t in ts.split()}
GROUPS = ("nav", "head", "foot", "side", "ad", "note", "form", "talk", "share")
TAGS = ("article", "main", "section", "div", "p", "h", "li", "list", "table", "nav", "header", "footer", "aside", "form", "quote", "root", "other")
_TAG_OF = {**{f"h{i}": "h" for i in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "dir": "list", "dt": "li", "dd": "li",
           "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "p", "html": "root", "body": "root", "fieldset": "form", "legend": "form",
           **{t: "table" for t in "tbody thead tfoot tr td th".split()}, "dialog": "other", "address": "other"}
_TAG_NO = {t: TAGS.index(_TAG_OF.get(t, t if t in TAGS else "other")) for t in BLOCKS}

_MARK = re.compile(r"<!--(?:(?!-->).)*+(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKENS = re.compile(r"[a-z]+")
_WHITE = re.compile(r"[\x20\x09-\x0D]+")


class Page:
    """Block-level nodes as parallel lists (a parent stands before its children), and text blocks with their owners."""

    __slots__ = ("tag", "attrs", "parent", "depth", "links", "inline", "blocks", "owner")

    def __init__(self, source: str):
        self.tag, self.attrs, self.parent, self.depth = ["html"], [""], [-1], [0]
        self.links, self.inline = [0], [0]  # characters in <a>; inline elements
        self.blocks, self.owner = [], []
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the node that their text belongs to
        piece: list[str] = []
        anchors, at = 0, 0
        in_head = False

        def flush():
            if piece:
                text = _WHITE.sub(" ", html.unescape("".join(piece))).strip(" ")
                piece.clear()
                if text:
                    self.blocks.append(text)
                    self.owner.append(stack[-1][1])

        while at < len(source):
            low = source.find("<", at)
            if low < 0:
                low = len(source)
            if low > at and not in_head:
                piece.append(source[at:low])
                if anchors:
                    self.links[stack[-1][1]] += low - at
            if low == len(source):
                break
            m = _MARK.match(source, low)
            if not m:  # a bare <
                if not in_head:
                    piece.append("<")
                at = low + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if name == "head":
                    in_head = False
                elif name == "br" or (name == "p" and not any(t == "p" for t, _ in stack)):
                    flush()
                else:
                    k = len(stack) - 1
                    while k > 0 and stack[k][0] != name and not (stack[k][0] in BLOCKS and name not in BLOCKS):
                        k -= 1
                    if k > 0 and stack[k][0] == name:
                        if any(t in BLOCKS for t, _ in stack[k:]):
                            flush()
                        del stack[k:]
                        anchors = sum(t == "a" for t, _ in stack)
                continue
            if name == "head":
                in_head = True
                continue
            if name == "body":
                in_head = False
            if name in RAW:  # a slash before the > does not close these
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = source.find(">", end.end()) + 1 if end else len(source)
                at = at or len(source)
                continue
            if name in LEFT_OUT:
                if not m[3].rstrip().endswith("/"):
                    at = self._closed(source, name, at)
                continue
            if in_head and name not in BLOCKS:
                continue
            in_head = False
            if name == "br" or name == "hr":
                flush()
                continue
            if name in VOID or name == "html":
                continue
            if name in BLOCKS:
                flush()
                if name in CLOSES_P:
                    self._end(stack, ("p",), ("td", "th", "li", "div", "article", "section", "body"))
                if name in ENDS:
                    self._end(stack, ENDS[name], EDGE[name])
                anchors = sum(t == "a" for t, _ in stack)
                if m[3].rstrip().endswith("/") and name != "p":
                    continue
                if name == "body" and any(t == "body" for t, _ in stack):
                    continue
                over = stack[-1][1]
                self.tag.append(name)
                self.attrs.append(" ".join(x for a in _ATTR.findall(m[3]) for x in a if x).lower() if m[3] else "")
                self.parent.append(over)
                self.depth.append(self.depth[over] + 1)
                self.links.append(0)
                self.inline.append(0)
                stack.append((name, len(self.tag) - 1))
            else:
                self.inline[stack[-1][1]] += 1
                if not m[3].rstrip().endswith("/"):
                    stack.append((name, stack[-1][1]))
                    anchors += name == "a"
        flush()

    @staticmethod
    def _closed(source: str, name: str, at: int) -> int:
        """Where to read on after the start tag of an element that is left out: behind its end tag, or right here if it is
        never closed, so that a missing end tag costs no text."""
        stops = "" if name in ("noscript", "template") else "|" + "|".join(sorted(BLOCKS))
        end = re.compile(rf"<(?:(/{name}){stops})(?=[\s/>])", re.I).search(source, at)
        return (source.find(">", end.end()) + 1 or len(source)) if end and end[1] else at

    @staticmethod
    def _end(stack, kinds, edge):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in kinds:
                # the outermost of the kinds that this tag ends
                while k > 1 and stack[k - 1][0] in kinds:
                    k -= 1
                del stack[k:]
                return
            if stack[k][0] in edge:
                return


@functools.lru_cache(maxsize=20_000)
def _marks(attrs: str) -> tuple[int, int]:
    """Bit sets of an attribute text: 1 if a token speaks for main text; the groups of those that speak against."""
    tokens = _TOKENS.findall(attrs)
    against = 0
    for t in tokens:
        if t in AGAINST:
            against |= 1 << GROUPS.index(AGAINST[t])
    return int(any(t in FOR for t in tokens)), against


def features(pages: list[Page]) -> np.ndarray:
    """The features of all nodes of some pages, one page after the other."""
    sizes = np.array([len(p.tag) for p in pages])
    n, first = int(sizes.sum()), np.cumsum(sizes) - sizes
    roots = np.repeat(first, sizes)
    parent = np.array([x for p in pages for x in p.parent])
    above = np.where(parent < 0, 0, parent) + roots  # a root is its own
    is_root = parent < 0
    tags = np.array([_TAG_NO[t] for p in pages for t in p.tag])
    marks = np.array([_marks(a) for p in pages for a in p.attrs], dtype=np.int64).reshape(n, 2)
    owner = np.array([o + f for p, f in zip(pages, first.tolist(), strict=True) for o in p.owner], dtype=np.int64)
    texts = [t for p in pages for t in p.blocks]
    long_ = np.array([len(t) for t in texts], dtype=float)
    total = np.stack((
        np.bincount(owner, long_, n), np.bincount(owner, [t.count(".") + t.count(",") for t in texts], n),
        np.array([x for p in pages for x in p.links], dtype=float), np.array([x for p in pages for x in p.inline], dtype=float),
        np.ones(n), (tags == TAGS.index("p")).astype(float), np.bincount(owner, minlength=n)), axis=1)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, long_)
    depth = np.array([x for p in pages for x in p.depth])
    sem = (1 << TAGS.index("article")) | (1 << TAGS.index("main"))
    no = np.zeros(len(TAGS), dtype=np.int64)
    for t, g in (("nav", 0), ("header", 1), ("footer", 2), ("aside", 3), ("form", 6)):
        no[TAGS.index(t)] = 1 << g
    own_for, own_against = marks[:, 0] | (sem >> tags & 1), marks[:, 1] | no[tags]
    up_for, up_against = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2)) if n else []
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]  # of depth 1, 2, ...
    for at in reversed(levels):
        np.add.at(total, above[at], total[at])
        np.maximum.at(longest, above[at], longest[at])
    for at in levels:
        up_for[at] = up_for[above[at]] | own_for[above[at]]
        up_against[at] = up_against[above[at]] | own_against[above[at]]
    up_tag = np.where(is_root, 0, tags[above])
    child = np.flatnonzero(~is_root)
    siblings = np.ones(n)
    siblings[child] = np.bincount(above[child], minlength=n)[above[child]]
    place = np.zeros(n)
    by = child[np.argsort(above[child], kind="stable")]
    place[by] = np.arange(len(by)) - np.searchsorted(above[by], above[by], side="left")
    c, whole = total[:, 0], np.maximum(1.0, total[roots, 0])
    cols = [
        tags, up_tag, np.minimum(depth, 20), np.log1p(c), total[:, 2] / np.maximum(1, c), np.log1p(total[:, 1]), c / total[:, 4], longest, own_for, up_for,
        *((own_against >> g & 1) for g in range(len(GROUPS))), *((up_against >> g & 1) for g in range(len(GROUPS))),
        c / whole, c / np.maximum(1, total[above, 0]), np.minimum(siblings, 50), place / siblings, total[:, 5] / total[:, 4], total[:, 5],
        total[:, 3] / total[:, 4], total[:, 1] / np.maximum(1, c), (own_against > 0).astype(int), (up_against > 0).astype(int)]
    return np.stack([np.asarray(x, dtype=np.float32) for x in cols], axis=1)


class Boosted:
    """Boosted regression trees for logistic loss: binned features, complete trees of one depth, Newton leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 5.0):
        self.depth, self.rate = depth, rate
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        self.prior = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(len(y), self.prior)
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf, dtype=np.float32)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                at = np.zeros((width, 2), dtype=np.int64) - 1
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = node * bins + binned[:, j]
                    gs = np.cumsum(np.bincount(k, g, width * bins).reshape(width, bins), axis=1)
                    hs = np.cumsum(np.bincount(k, h, width * bins).reshape(width, bins), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < least) | (ht - hs < least)] = 0
                    top = gain[:, : len(e)].argmax(axis=1)
                    value = gain[np.arange(width), top]
                    better = value > best
                    best[better], at[better, 0], at[better, 1] = value[better], j, top[better]
                right = np.zeros(len(y), dtype=np.int64)
                for w in range(width):
                    if at[w, 0] >= 0:
                        feature[first + w], cut[first + w] = at[w, 0], edges[at[w, 0]][at[w, 1]]
                        mine = node == w
                        right[mine] = binned[mine, at[w, 0]] > at[w, 1]
                node = node * 2 + right
            gl, hl = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            leaf = rate * gl / (hl + 1)
            score += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                k = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[k]] > cut[k])
            out += leaf[node]
        return out


def decode(parent: list[int], weight: np.ndarray) -> list[bool]:
    """The set of nodes with the greatest weight in which each node's parent is kept too."""
    best = weight.tolist()
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    keep = [best[0] > 0] + [False] * (len(best) - 1)
    for i in range(1, len(best)):
        keep[i] = keep[parent[i]] and best[i] > 0
    return keep


# --- the labelled pages that the trees are fitted on


def make_pages(n: int = 500, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, main blocks) from templates: semantic or bare-div layouts, boilerplate before, inside and after the text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiounrstlmdchéü") for _ in range(r.randint(2, 9)))
    line = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", "", "!"])

    def menu(tag: str, name: str) -> str:
        links = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(r.randint(2, 9)))
        return f"<{tag}{name}><ul>{links}</ul></{tag}>" if r.random() < 0.7 else f"<{tag}{name}>" + " | ".join(f"<a href=#>{word()}</a>" for _ in range(6)) + f"</{tag}>"

    def box(kind: str) -> str:
        named = lambda *x: f' {r.choice(["class", "id"])}="{r.choice(x)}"'
        text = "".join(f"<p>{line(3, 25)}</p>" for _ in range(r.randint(1, 3))) if r.random() < 0.5 else line(3, 25)
        if kind == "nav":
            return menu("nav", r.choice(["", named("nav", "menu")])) if r.random() < 0.5 else menu(r.choice(["div", "ul"]), named("nav", "main-nav", "menu", "navbar", "breadcrumb"))
        if kind == "header":
            inner = f"<h1>{line(2, 5)}</h1>" * (r.random() < 0.5) + f"<p>{line(2, 8)}</p>" * (r.random() < 0.5) + word()
            return f"<header>{inner}</header>" if r.random() < 0.5 else f"<div{named('header', 'site-header', 'masthead', 'top-bar topbar')}>{inner}</div>"
        if kind == "footer":
            return f"<footer>&copy; {text}</footer>" if r.random() < 0.6 else f"<div{named('footer', 'page-footer', 'copyright')}>{text}</div>"
        if kind == "side":
            inner = f"<h3>{line(1, 4)}</h3>" + (text if r.random() < 0.5 else menu("div", ""))
            return f"<aside>{inner}</aside>" if r.random() < 0.5 else f"<div{named('sidebar', 'widget', 'related posts', 'rail')}>{inner}</div>"
        if kind == "ad":
            return f"<{(t := r.choice(['div', 'section', 'div', 'p']))}{named('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo box')}>{text if t != 'p' else line(3, 25)}</{t}>"
        if kind == "note":
            return f"<div{named('cookie-notice', 'notice', 'gdpr consent', 'alert', 'popup modal')}>{text}<button>OK</button></div>"
        if kind == "form":
            return f"<form{r.choice(['', named('search', 'newsletter', 'login')])}><label>{word()}</label><input name=q>{text}<button>{word()}</button></form>"
        talk = "".join(f"<{t}{r.choice(['', named('comment', 'reply')])}><p>{line(3, 40)}</p></{t}>" for t in ["div", "li", "article"] for _ in range(r.randint(0, 3)))
        return f"<{(t := r.choice(['section', 'div', 'ol']))}{named('comments', 'comment-list', 'discussion', 'disqus_thread')}><h3>{line(1, 3)}</h3>{talk}<p>{line(3, 9)}</p></{t}>"

    out = []
    for _ in range(n):
        main, body = [], []
        inside = r.random() < 0.35
        say = lambda a, b: main.append(line(a, b)) or main[-1]
        if r.random() < 0.85:
            body.append(f"<h1>{say(2, 9)}</h1>")
        for _ in range(r.choice([0, 1, 2, 4, 8, 20])):
            kind, long_ = r.random(), (1, 4) if r.random() < 0.35 else (6, 60)
            if kind < 0.55:
                body.append(f"<p>{say(*long_)}</p>")
            elif kind < 0.7:
                body.append(f"<p><b>{say(*long_)}<br>" if r.random() < 0.5 else f"<p>{say(*long_)}<br>{say(*long_)}</p>")
            elif kind < 0.78:
                body.append(f"<h2>{say(1, 6)}</h2>")
            elif kind < 0.84:
                body.append("<ul>" + "".join(f"<li>{say(1, 20)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote><p>{say(3, 30)}</p></blockquote>")
            elif kind < 0.95:
                body.append(f"<div>{say(*long_)}</div>")
            else:
                body.append("<table>" + "".join(f"<tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            if inside and r.random() < 0.2:
                body.append(box(r.choice(["ad", "ad", "form", "note", "side", "nav", "talk"])))
        if not body:
            body.append(f"<p>{say(6, 60)}</p>")
        text = "".join(body)
        layout = r.random()
        if layout < 0.5:
            text = f"<article>{text}</article>"
        elif layout < 0.65:
            text = f"<main>{text}</main>"
        elif layout < 0.8:
            name = r.choice(["content", "post-body", "article", "entry-content", "main", "story"])
            text = f'<div {r.choice(["id", "class"])}="{name}">{text}</div>'
        elif layout < 0.9:
            text = f'<main><div class="wrap"><article class="post">{text}</article></div></main>'
        else:
            text = f"<div>{text}</div>"
        kinds = lambda *x: "".join(box(k) for k in x if r.random() < 0.6)
        page = kinds("note", "header", "nav", "ad") + kinds("side", "form") * (r.random() < 0.4) + text + kinds("talk", "side", "ad", "form", "footer", "note")
        if r.random() < 0.4:
            page = f'<div class="{r.choice(["wrapper", "container", "page", "site"])}">{page}</div>'
        out.append((f"<!DOCTYPE html><html><head><title>{line(2, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>", main))
    return out


@functools.lru_cache(maxsize=1)
def trained() -> Boosted:
    """Trees fitted on make_pages(): a node is positive if it holds a main block."""
    x, y = [], []
    for source, main in make_pages():
        page = Page(source)
        wanted = set(main)
        label = np.zeros(len(page.tag))
        for text, o in zip(page.blocks, page.owner, strict=True):
            if text in wanted:
                while o >= 0 and not label[o]:
                    label[o] = 1
                    o = page.parent[o]
        held = np.zeros(len(page.tag), dtype=bool)  # elements without text say nothing
        for o in page.owner:
            while o >= 0 and not held[o]:
                held[o] = True
                o = page.parent[o]
        x.append(features([page])[held])
        y.append(label[held])
    return Boosted(np.concatenate(x), np.concatenate(y))


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page: its kept blocks, in page order, joined by line feeds."""
    parsed = [Page(p or "") for p in pages]
    sizes = [len(p.tag) for p in parsed]
    weight = model.log_odds(features(parsed)) if parsed else np.zeros(0)
    out, at = [], 0
    for page, n in zip(parsed, sizes, strict=True):
        keep = decode(page.parent, weight[at:at + n])
        at += n
        out.append("\n".join(t for t, o in zip(page.blocks, page.owner, strict=True) if keep[o]))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text (empty if there is none), n_chars (code points).  Null html is empty;
    whole pages are read; broken markup is read as far as it goes; repeated rows repeat; other columns are not looked
    at; no rows give no rows."""
    spark = pages.sparkSession
    python_side(spark)
    model = spark.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            texts = extract(batch.column(2).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    three = pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"`{url_col}` as url", f"`{html_col}` as html")
    return three.mapInArrow(run, SCHEMA).withColumnsRenamed({"page_id": id_col, "url": url_col})


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


#: A plain rule for the given tables, whose pages hold their main text in one article of p, h1, b and br elements; the
#: operator knows nothing of it.
OP3_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1), '</?(p|h1|br)(\s[^>]*)?>') AS pieces FROM pages),
b AS (
  SELECT page_id, url, list_transform(pieces, lambda x: trim(regexp_replace(replace(replace(replace(
    regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""
