"""Main text of web pages by a tree-structured graphical model.

Block elements and text blocks of a page are binary variables (main text or not). Each has a weight vector over
features of its tag, the words of its class, id and role, its length and its links; a parent and a child share a
potential, of one kind for elements and of another for text blocks. Sum-product messages pass from the leaves to the
root and back, which on a tree gives exact marginals; text blocks of a marginal of a half or more are the text. The
weights maximise the likelihood of labelled pages (``PAGES`` of them, generated here from templates that mark what
is main text), by gradient ascent on the same marginals.

Null or empty html has the empty text, as does a page without main text. Markup that isn't closed, crossed or cut
off ends where a browser would end it; a page of any size is parsed whole, in time in proportion. Rows keep their
number; an empty table gives an empty table; extra columns aren't read.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, spread

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^>"'<]++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
MARK = re.compile(r'data-main="([01])"')

#: Elements whose content is never text of the page. Formulas, drawings and buttons keep their text, like any inline element.
RAW = {"script", "style", "template", "textarea", "title", "iframe", "select"}
#: Elements whose content stands in for them where they can't be shown. If one isn't closed, the text after it is the page's.
INSTEAD = {"noscript", "object", "canvas", "audio", "video"}
_INSTEAD = re.compile(r"<(?:" + "|".join(sorted(INSTEAD)) + r")\b", re.I)
#: Elements that begin and end a block, by the group their weight is for.
GROUPS = {
    "html": "html", "head": "head", "body": "body", "article": "article", "main": "main", "section": "section", "div": "div", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer",
    "aside": "aside", "form": "form", "fieldset": "form", "dialog": "dialog", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "thead": "table",
    "tbody": "table", "tfoot": "table", "tr": "table", "td": "table", "th": "table", "caption": "table", "p": "p", "h1": "h1", "h2": "h2", "h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2",
    "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "address": "address", "details": "div", "summary": "div", "hgroup": "div", "search": "form", "center": "div",
}
#: Words in class, id or role, each group with its weight.
WORDS = {
    "nav": ["nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs"],
    "ad": ["ad", "ads", "advert", "adverts", "advertisement", "banner", "promo", "promotion", "sponsor", "sponsored", "adsense"],
    "notice": ["cookie", "cookies", "consent", "notice", "popup", "modal", "alert", "gdpr", "overlay", "warning", "toast"],
    "comment": ["comment", "comments", "reply", "replies", "disqus", "discussion", "respond", "reviews"],
    "side": ["sidebar", "side", "aside", "widget", "related", "recommended", "recommendations", "popular", "trending", "complementary", "more"],
    "foot": ["footer", "foot", "copyright", "contentinfo", "legal", "colophon"],
    "head": ["header", "masthead", "topbar", "logo", "site-header", "toolbar"],
    "share": ["share", "sharing", "social", "subscribe", "newsletter", "signup", "login", "register", "search", "form", "follow"],
    "main": ["article", "content", "post", "entry", "story", "main", "body", "text", "prose", "articlebody"],
}
_WORD = {w: k for k, ws in WORDS.items() for w in ws}
FEATURES = ["bias", "bias_text", *sorted({f"tag_{g}" for g in GROUPS.values()}), *(f"word_{k}" for k in WORDS), *(f"size_{k}" for k in range(5)), "links_some", "links_most", "stop", "under_root"]
_F = {f: i for i, f in enumerate(FEATURES)}
_CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"})}


def stand_ins(source: str) -> dict[int, int]:
    """Where the content of each closed ``INSTEAD`` element begins and ends (after its end tag), in one pass.

    An end tag closes the last such element that is open; the end of a block that was opened before it ends it unclosed.
    """
    out: dict[int, int] = {}
    if not _INSTEAD.search(source):
        return out
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    raw_end = 0
    for m in TOKEN.finditer(source):
        found = NAME.match(m[0]) if m.start() >= raw_end else None
        name = found[1].lower() if found else ""
        if name in RAW:
            if m[0][1] != "/" and not m[0].endswith("/>"):
                end = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(source, m.end())
                raw_end = end.end() if end else len(source)
            continue
        if name not in INSTEAD and name not in GROUPS:
            continue
        if m[0][1] != "/":
            if not (name in INSTEAD and m[0].endswith("/>")):
                stack.append((name, m.end()))
                count[name] = count.get(name, 0) + 1
        elif count.get(name, 0):
            while stack:
                top, begin = stack.pop()
                count[top] -= 1
                if top == name:
                    if name in INSTEAD:
                        out[begin] = m.end()
                    break
    return out


class Tree:
    """Nodes of one or many pages: parents, depths, features, marks; and text blocks."""

    def __init__(self):
        self.parent, self.depth, self.feats, self.mark, self.is_text = [], [], [], [], []
        self.blocks: list[tuple[int, int, str]] = []  # page, node, text

    def _node(self, parent: int, feats: list[int], mark: int, text: bool) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.feats.append(feats)
        self.mark.append(mark)
        self.is_text.append(text)
        return len(self.parent) - 1

    def add(self, page: int, source: str) -> None:
        root = self._node(-1, [_F["bias"], _F["tag_html"]], 0, False)
        stack: list[tuple[str, int]] = [("", root)]
        parts: list[str] = []
        size = linked = 0
        in_link, at = False, 0

        def flush():
            nonlocal size, linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    n, owner = len(text), stack[-1][1]
                    f = [_F["bias_text"], _F[f"size_{(n > 25) + (n > 80) + (n > 200) + (n > 600)}"]]
                    share = linked / max(size, 1)
                    if share > 0.6:
                        f.append(_F["links_most"])
                    elif share > 0.2:
                        f.append(_F["links_some"])
                    if text[-1] in ".!?…\"'»”)":
                        f.append(_F["stop"])
                    if owner == root:
                        f.append(_F["under_root"])
                    self.blocks.append((page, self._node(owner, f, self.mark[owner], True), text))
            size = linked = 0

        def text_to(end):
            nonlocal size, linked
            if end > at:
                parts.append(source[at:end])
                size += end - at
                if in_link:
                    linked += end - at

        skip_to, instead = 0, stand_ins(source)
        for m in TOKEN.finditer(source):
            start = m.start()
            if start < skip_to:
                continue
            text_to(start)
            at = m.end()
            token = m[0]
            found = NAME.match(token)
            if not found:
                continue
            name = found[1].lower()
            opening = token[1] != "/"
            if name in RAW:
                if opening and not token.endswith("/>"):
                    end = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(source, at)
                    at = skip_to = end.end() if end else len(source)
                    parts.append(" ")
            elif name in INSTEAD:
                if opening and at in instead:
                    at = skip_to = instead[at]
                    if name != "canvas":
                        parts.append(" ")
            elif name == "a":
                in_link = opening
            elif name in ("br", "img", "input", "wbr"):
                parts.append(" " if name != "wbr" else "")
            elif name == "hr":
                flush()
            elif group := GROUPS.get(name):
                flush()
                if opening:
                    if stack[-1][0] == "p":
                        stack.pop()
                    if name in _CLOSES:
                        names, stop = _CLOSES[name]
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k][0] in stop:
                                break
                            if stack[k][0] in names.split():
                                del stack[k:]
                                break
                    if name == "body" and stack[-1][0] == "head":
                        stack.pop()
                    feats = [_F["bias"], _F[f"tag_{group}"]]
                    if len(token) > len(name) + 2:
                        words = {x for h in HINTS.findall(token) for x in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])", "".join(h).lower())}
                        feats += sorted({_F[f"word_{_WORD[w]}"] for w in words if w in _WORD})
                    mark = MARK.search(token) if "data-main" in token else None
                    node = self._node(stack[-1][1], feats, int(mark[1]) if mark else self.mark[stack[-1][1]], False)
                    in_link = False
                    stack.append((name, node))
                else:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            del stack[k:]
                            break
        text_to(len(source))
        flush()

    def arrays(self):
        counts = np.array([len(f) for f in self.feats])
        flat = np.fromiter((x for f in self.feats for x in f), dtype=np.int64, count=counts.sum())
        return np.array(self.parent), np.array(self.depth), np.repeat(np.arange(len(counts)), counts), flat, np.array(self.is_text, dtype=np.int64)


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def _lse(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return top[..., 0] + np.log(np.exp(x - top).sum(axis=-1))


def marginals(tree_arrays, weights: np.ndarray, pair: np.ndarray):
    """Of each node, P(main); of each edge from its parent, the 2 x 2 joint; by messages up and down."""
    parent, depth, rows, feats, kind = tree_arrays
    n = len(parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = np.bincount(rows, weights=weights[feats], minlength=n)
    up = np.zeros((n, 2))
    levels = _levels(depth)
    for level in reversed(levels[1:]):
        up[level] = _lse(pair[kind[level]] + belief[level][:, None, :])
        for x in range(2):
            belief[:, x] += np.bincount(parent[level], weights=up[level, x], minlength=n)
    joint = np.zeros((n, 2, 2))
    for level in levels[1:]:
        p = parent[level]
        rest = belief[p] - up[level]
        own = belief[level].copy()
        both = rest[:, :, None] + pair[kind[level]] + own[:, None, :]
        both -= _lse(both.reshape(len(level), 4))[:, None, None]
        joint[level] = np.exp(both)
        down = _lse(np.swapaxes(rest[:, :, None] + pair[kind[level]], 1, 2))
        belief[level] = own + down
    return np.exp(belief[:, 1] - _lse(belief)), joint


#: The bound of the labelled sample, and its seed.
PAGES, SEED = 400, 5


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[str]:
    """Generated pages whose elements carry data-main where main text begins and ends."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "in", "ou", "st", "la", "de"]) for _ in range(rnd.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    prose = lambda: rnd.choice([words(1, 4), words(8, 25), words(30, 90)]).capitalize() + rnd.choice([".", ".", ".", "", "!"])
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 8))) + "</ul>"
    cls = lambda group: f'{rnd.choice(["class", "id"])}="{rnd.choice(WORDS[group])}{rnd.choice(["", "-" + word(), " " + word()])}"'
    paragraphs = lambda a, b: "".join(f"<p>{prose()}</p>" for _ in range(rnd.randint(a, b)))

    def junk(inside=False):
        m = ' data-main="0"' * inside
        return rnd.choice([
            f"<nav{m}>{links()}</nav>", f"<div {cls('nav')}{m}>{links()}</div>", f"<div {cls('ad')}{m}>{prose()}</div>", f"<div {cls('ad')}{m}><p>{prose()}</p>{link()}</div>",
            f"<div {cls('notice')}{m}><p>{prose()}</p><button>OK</button></div>", f"<aside{m}>{links()}{paragraphs(0, 2)}</aside>", f"<aside {cls('side')}{m}><h3>{words(1, 3)}</h3>{paragraphs(1, 3)}</aside>",
            f"<div {cls('side')}{m}><h3>{words(1, 3)}</h3>{links()}</div>", f"<div {cls('side')}{m}>{paragraphs(1, 2)}</div>", f"<div {cls('share')}{m}>{link()} {link()}</div>", f'<form {m}><label>{words(1, 3)}</label><input name="q"><p>{prose()}</p></form>',
            f"<section {cls('comment')}{m}><h2>{words(1, 2)}</h2>" + "".join(f"<div {cls('comment')}><p>{prose()}</p></div>" for _ in range(rnd.randint(1, 4))) + "</section>",
            f"<div {cls('comment')}{m}>" + "".join(f"<article {cls('comment')}>{paragraphs(1, 2)}</article>" for _ in range(rnd.randint(1, 3))) + "</div>",
            f"<section {cls('notice')}{m}>{paragraphs(1, 2)}</section>", f"<dialog{m}><p>{prose()}</p></dialog>",
        ])

    def story():
        out = [f"<h1>{words(3, 12)}</h1>"] if rnd.random() < 0.8 else [f"<header><h1>{words(3, 12)}</h1></header>"] if rnd.random() < 0.3 else []
        for _ in range(rnd.randint(1, 9)):
            u = rnd.random()
            out.append(
                f"<p>{prose()}</p>" if u < 0.55 else f"<p><b>{prose()}<br>" if u < 0.65 else f"<p>{prose()}" if u < 0.7 else f"<h2>{words(1, 6)}</h2>" if u < 0.76
                else "<ul>" + "".join(f"<li>{link() if linked else prose()}</li>" for linked in [rnd.random() < 0.5] for _ in range(rnd.randint(2, 4))) + "</ul>" if u < 0.8 else f"<blockquote>{paragraphs(1, 2)}</blockquote>" if u < 0.84
                else f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>" if u < 0.87 else f"<div>{prose()}</div>" if u < 0.9 else f"<pre>{prose()}</pre>" if u < 0.92
                else f"<figure><img src='x'><figcaption>{prose()}</figcaption></figure>" if u < 0.94 else f"<p>{prose()} {link()} {prose()}</p>" if u < 0.96 else junk(True))
        return "".join(out)

    def main():
        u, body = rnd.random(), story()
        if u < 0.46:
            return f'<article data-main="1">{body}</article>'
        if u < 0.52:
            return f'<main><article {cls("main")} data-main="1">{body}</article>{junk() if rnd.random() < 0.5 else ""}</main>'
        if u < 0.58:
            return f'<main data-main="1">{body}</main>'
        if u < 0.7:
            return f'<div {cls("main")} data-main="1">{body}</div>'
        if u < 0.75:
            return f'<section data-main="1">{body}</section>'
        if u < 0.93:  # nothing but the text tells that it is one
            own = rnd.choice(["", f' id="{word()}{rnd.randint(1, 9)}"', f' class="{word()} {word()}"'])
            body = rnd.choice([body, body, "<br><br>".join(words(15, 90).capitalize() + "." for _ in range(rnd.randint(1, 5)))])
            return rnd.choice(['<div{}{}>{}</div>', '<div><div{}{}>{}</div></div>', '<table><tr><td{}{}>{}</td></tr></table>']).format(own, ' data-main="1"', body)
        return "".join(f'<p data-main="1">{prose()}</p>' for _ in range(rnd.randint(1, 6)))

    out = []
    for _ in range(count):
        before, after = [junk() for _ in range(rnd.randint(0, 3))], [junk() for _ in range(rnd.randint(0, 3))]
        head = f"<header>{rnd.choice(['', f'<h1>{words(1, 3)}</h1>', f'<p>{prose()}</p>'])}{link()}</header>" if rnd.random() < 0.4 else f"<div {cls('head')}>{words(1, 4)} {link()}</div>" if rnd.random() < 0.3 else ""
        foot = f"<footer>&copy; {prose()}</footer>" if rnd.random() < 0.6 else f"<div {cls('foot')}>{prose()} {link()}</div>" if rnd.random() < 0.5 else ""
        text = "" if rnd.random() < 0.05 else main()
        inner = "".join([head, *before, text, *after, foot])
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{inner}</body></html>" if rnd.random() < 0.9 else inner)
    return out


def fit(pages: list[str], steps: int = 200, ridge: float = 0.2):
    """Weights and pair potentials of the greatest likelihood, with a ridge."""
    tree = Tree()
    for i, p in enumerate(pages):
        tree.add(i, p)
    arrays, y = tree.arrays(), np.array(tree.mark)
    parent, _, rows, feats, kind = arrays
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind[child], y[parent[child]], y[child]), 1)
    have = np.bincount(feats, weights=y[rows], minlength=len(FEATURES))
    theta = np.zeros(len(FEATURES) + 8)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, joint = marginals(arrays, theta[:-8], theta[-8:].reshape(2, 2, 2))
        want = np.zeros((2, 2, 2))
        for k in range(2):
            want[k] = joint[child[kind[child] == k]].sum(axis=0)
        grad = np.concatenate([have - np.bincount(feats, weights=p[rows], minlength=len(FEATURES)), (seen - want).ravel()]) - ridge * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:-8], theta[-8:].reshape(2, 2, 2)


_MODEL: dict = {}


def model():
    """The model fitted on the generated pages, once a process."""
    if "model" not in _MODEL:
        _MODEL["model"] = fit(labelled_pages())
    return _MODEL["model"]


def extract(pages: list[str], weights: np.ndarray, pair: np.ndarray) -> list[str]:
    """The main text of each page."""
    tree, out = Tree(), [[] for _ in pages]
    for i, p in enumerate(pages):
        tree.add(i, p)
    if tree.blocks:
        p, _ = marginals(tree.arrays(), weights, pair)
        for page, node, text in tree.blocks:
            if p[node] >= 0.5:
                out[page].append(text)
    return ["\n\n".join(x) for x in out]


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, url, text and n_chars."""
    weights, pair = model()

    def run(batches):
        for batch in chunks(batches, source, 2 << 20):
            found = extract([x or "" for x in batch.column(source).to_pylist()], weights, pair)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [key, url, "text", "n_chars"])

    return spread(df.select(key, url, source), key).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{url}` string, text string, n_chars long")
