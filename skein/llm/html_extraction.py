"""Main text of web pages by a tree-structured graphical model over the DOM.

A page is read into a tree: block elements are nodes, and each run of text between block boundaries is a leaf.  Every node is content or boilerplate.  A node's own
evidence (its tag, the words of its class, id and role, lengths and link shares of its text) and potentials between parent and child, one table for each kind of
child, make up a model whose exact marginals come from sum-product messages, up from the leaves and down from the root.  The leaves whose
marginal is at least a half are the text.

Training: weights maximise the likelihood of labelled pages.  Labels are distant: of pages that mark one article (or main), what stands in it is content, save what names
itself otherwise.  The texts of these pages are also set in other templates (see `compose`), whose labels are known, so that the model learns menus, notices, adverts, forms
and comments by many names.  The sample is bounded: SAMPLE pages of at most SAMPLE_BYTES; the driver fits the model, tasks apply it.

White space is what Unicode calls so, character references are decoded by the HTML rules, <br> is white space.  Elements deeper than DEEPEST are taken as siblings there.

Defined cases: null and empty html, and pages without text, give the empty text; an unclosed comment, tag or script runs to the end of the page; a page of plain text is
judged as its body's text; repeated rows are extracted each on their own; an empty table gives no rows.  Only the id, url and html columns are read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_BYTES, COMPOSED, DEEPEST, PAGES_AT_ONCE = 200, 64 << 10, 4, 256, 256

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(class|id|role|itemprop|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW = ("script", "style", "xmp", "iframe", "noembed", "noframes", "title", "textarea", "template", "noscript", "svg")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks of a form that may stand in a paragraph.
INSIDE_P = frozenset("button label legend optgroup option select".split())
#: What a start tag closes where it stands open, and the elements beyond which it does not look.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr",), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)),
}

#: Names that pages give to their parts, by which training pages are labelled and composed.
CONTENT = "article content entry main post story text body news page single prose".split()
OTHER = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav links tabs pagination".split(),
    "header": "header masthead banner top branding logo site".split(),
    "footer": "footer bottom copyright colophon legal foot imprint".split(),
    "aside": "sidebar aside related widget rail recommended popular trending more tags".split(),
    "notice": "notice cookie consent gdpr alert privacy overlay popup modal message warning".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promoted promotion dfp".split(),
    "form": "form newsletter subscribe search login signup contact register feedback".split(),
    "comments": "comments comment reply replies respond disqus discussion responses thread reader".split(),
    "share": "share social sharing follow buttons toolbar byline meta author".split(),
}
BOILERPLATE = frozenset(x for k, names in OTHER.items() if k not in ("header", "share") for x in names) - {"more", "top", "body", "page", "message", "site", "links", "reader", "contact", "tags"}


@dataclass
class Page:
    """The nodes of a page, each after its parent.  text is None for elements."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    label: list[str | None] = field(default_factory=list)

    def add(self, tag: str, parent: int, names: tuple[str, ...] = (), text: str | None = None, linked: int = 0, label: str | None = None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.label.append(label)
        return len(self.tag) - 1


def attributes(source: str) -> tuple[tuple[str, ...], str | None]:
    """The words of class, id, role and itemprop, and the label of a composed page."""
    words: dict[str, None] = {}
    label = None
    if "=" in source:
        for kind, *values in NAMED.findall(source):
            value = next((v for v in values if v), "")
            if kind.lower() == "data-label":
                label = value
            else:
                words.update(dict.fromkeys(w.lower() for w in NAME.findall(value)))
    return tuple(words), label


def parse(source: str) -> Page:
    """The tree of a page below its body, tolerant of tags left open or closed twice."""
    page = Page()
    root = page.add("body", -1)
    stack, opened = [root], Counter()
    words: list[str] = []
    links = linked = 0
    at, end = 0, len(source)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split()) if words else ""
        if text:
            page.add("#text", stack[-1], text=text, linked=min(linked, len(text)))
        words.clear()
        linked = 0

    def close(depth: int) -> None:
        flush()
        for node in stack[depth:]:
            opened[page.tag[node]] -= 1
        del stack[depth:]

    while at < end:
        found = MARKUP.search(source, at)
        stop = found.start() if found else end
        if stop > at:
            text = entities.unescape(source[at:stop]) if source.find("&", at, stop) >= 0 else source[at:stop]
            words.append(text)
            if links:
                linked += len(text.strip())
        if not found:
            break
        at = found.end()
        closing, tag, rest = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW_END and not closing:
            if not (rest and rest.endswith("/") and tag == "svg"):
                last = RAW_END[tag].search(source, at)
                at = last.end() if last else end
        elif tag == "br" or tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "wbr"):
                words.append(" " if tag == "br" else "")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in ("html", "head", "body"):
            flush()
        elif tag in BLOCKS or "-" in tag:
            if closing:
                if opened[tag]:
                    depth = len(stack) - 1
                    while page.tag[stack[depth]] != tag:
                        depth -= 1
                    close(depth)
                else:
                    flush()
                continue
            flush()
            if page.tag[stack[-1]] == "p" and tag not in INSIDE_P:
                close(len(stack) - 1)
            if tag in CLOSES:
                own, scope = CLOSES[tag]
                if any(opened[x] for x in own):
                    depth = len(stack) - 1
                    while depth and page.tag[stack[depth]] not in own and page.tag[stack[depth]] not in scope:
                        depth -= 1
                    if page.tag[stack[depth]] in own:
                        close(depth)
            names, label = attributes(rest)
            if len(stack) <= DEEPEST:
                stack.append(page.add(tag, stack[-1], names, label=label))
                opened[tag] += 1
    flush()
    return page


# --- evidence -----------------------------------------------------------------------------------------------------------

KINDS = {"#text": 0, **dict.fromkeys("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt td th figcaption caption".split(), 1)}
#: Boxes in what only holds things together, and boxes in others.
HOLDERS, N_KINDS = frozenset("body div table tbody tr center".split()), 4
#: Elements that say what they are: lengths say nothing about them, or about the text right in them.
PARTS = ("article", "main")
#: The potential of agreement and of its opposite that learning starts from.
AGREE = 2.0
SENTENCE = re.compile(r"[.!?…。！？؟][\"'”’)»]*(?:\s|$)")


def _steps(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def evidence(page: Page) -> list[list[str]]:
    """The features of each node.  Lengths and link shares speak where the box around does not say what it is."""
    n = len(page.tag)
    size, linked, leaves = [0] * n, [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        if (text := page.text[k]) is not None:
            size[k], linked[k], leaves[k] = len(text), page.linked[k], 1
        if (up := page.parent[k]) >= 0:
            size[up] += size[k]
            linked[up] += linked[k]
            leaves[up] += leaves[k]
    total = max(1, size[0])
    out: list[list[str]] = []
    box, within = [""] * n, [False] * n
    for k in range(n):
        tag, up, own = page.tag[k], page.parent[k], ["any"]
        box[k] = tag if tag not in KINDS or up < 0 else box[up]
        within[k] = up >= 0 and (within[up] or page.tag[up] in PARTS)
        share = _steps(linked[k] / max(1, size[k]), 0.01, 0.34, 0.67)
        if (text := page.text[k]) is not None:
            own += ["text", f"text in {page.tag[up]}", f"text linked {share}"]
            if box[k] not in PARTS:
                own += [f"text of {_steps(size[k], 15, 40, 90, 200, 500)}", f"text ends {len(SENTENCE.findall(text[:2000])) and 1 + (size[k] > 120)}"]
            if "©" in text:
                own.append("text ©")
        else:
            own += [f"tag {tag}", f"tag {tag} in {page.tag[up] if k else ''}", *(f"name {w}" for w in page.names[k])]
            if tag in PARTS:
                own.append(f"part {within[k]}")
            elif tag in KINDS:
                own.append(f"line linked {share}")
            else:
                own += [f"box linked {share}", f"share {_steps(size[k] / total, 0.02, 0.1, 0.3, 0.6)}", f"mean {_steps(size[k] / max(1, leaves[k]), 15, 40, 90, 200)}"]
        out.append(own)
    return out


def kinds(page: Page) -> list[int]:
    """The kind of the edge from each node to its parent."""
    return [KINDS.get(tag, 2 if up < 0 or page.tag[up] in HOLDERS else 3) for tag, up in zip(page.tag, page.parent, strict=True)]


# --- the model ----------------------------------------------------------------------------------------------------------

class Forest:
    """The trees of some pages as arrays: parents, kinds of edges, levels."""

    def __init__(self, pages: list[Page]):
        base = np.cumsum([0, *(len(p.tag) for p in pages)])
        self.first, self.n = base[:-1], int(base[-1])
        self.parent = np.concatenate([np.array(p.parent, np.int64) + b * (np.array(p.parent) >= 0) for p, b in zip(pages, base, strict=False)])
        self.kind = np.array([k for p in pages for k in kinds(p)], np.int64)
        depth = np.array([d for p in pages for d in p.depth], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def marginals(self, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum-product with evidence own (node, state) and potentials edge (kind, state of parent, state of child), all logarithms: the probability that a node is content,
        those of (parent, child) states for each node with a parent, and the log partition sum of each page."""
        belief, told = own.copy(), np.zeros((self.n, 2))
        for level in reversed(self.levels[1:]):
            e = edge[self.kind[level]]
            told[level] = np.logaddexp(e[:, :, 0] + belief[level, None, 0], e[:, :, 1] + belief[level, None, 1])
            for s in (0, 1):
                np.add.at(belief[:, s], self.parent[level], told[level, s])
        roots = self.levels[0]
        sums = np.logaddexp(belief[roots, 0], belief[roots, 1])
        pairs = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            e, up = edge[self.kind[level]], belief[self.parent[level]] - told[level]
            joint = up[:, :, None] + e + belief[level][:, None, :]
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            pairs[level] = joint / joint.sum((1, 2), keepdims=True)
            belief[level] += np.logaddexp(up[:, None, 0] + e[:, 0, :], up[:, None, 1] + e[:, 1, :])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pairs, sums


@dataclass
class Model:
    weight: dict[str, float]
    edge: np.ndarray

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """The marginal of content of every node of each page."""
        if not pages:
            return []
        forest, get = Forest(pages), self.weight.get
        own = np.zeros((forest.n, 2))
        own[:, 1] = [sum(get(f, 0.0) for f in fs) for p in pages for fs in evidence(p)]
        return np.split(forest.marginals(own, self.edge)[0], forest.first[1:])


def fit(pages: list[Page], labels: list[np.ndarray], least: int = 2, rounds: int = 120, penalty: float = 0.02, rate: float = 0.2) -> Model:
    """Weights of the features that at least `least` pages have, and the edge potentials, by penalised maximum likelihood with exact marginals as the gradient.
    Before anything is learned, children are taken to be as their parents."""
    features = [evidence(p) for p in pages]
    seen = Counter(f for p in features for f in {f for fs in p for f in fs})
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    forest, y = Forest(pages), np.concatenate(labels).astype(np.int64)
    at = [(k, index[f]) for k, fs in enumerate(fs for p in features for fs in p) for f in fs if f in index]
    node, feature = (np.array(c, np.int64) for c in zip(*at, strict=True))
    inner = np.flatnonzero(forest.parent >= 0)
    observed = np.zeros((N_KINDS, 2, 2))
    np.add.at(observed, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1)
    size = len(index)
    prior = np.concatenate((np.zeros(size), np.tile([AGREE, -AGREE, -AGREE, AGREE], N_KINDS)))
    theta, m, v = prior.copy(), np.zeros(size + 4 * N_KINDS), np.zeros(size + 4 * N_KINDS)
    for step in range(1, rounds + 1):
        own = np.zeros((forest.n, 2))
        own[:, 1] = np.bincount(node, weights=theta[feature], minlength=forest.n)
        p, pairs, _ = forest.marginals(own, theta[size:].reshape(N_KINDS, 2, 2))
        expected = np.zeros((N_KINDS, 2, 2))
        np.add.at(expected, forest.kind[inner], pairs[inner])
        gradient = np.concatenate((np.bincount(feature, weights=(y - p)[node], minlength=size), (observed - expected).ravel())) - penalty * (theta - prior)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(theta[k]) for f, k in index.items()}, theta[size:].reshape(N_KINDS, 2, 2))


# --- labelled pages -----------------------------------------------------------------------------------------------------

def distant(page: Page) -> np.ndarray | None:
    """Labels of a page that marks one article, or else one main part: what stands in it is content, save what names itself otherwise.  None of other pages."""
    top = next((own for tag in ("article", "main") if len(own := [k for k, t in enumerate(page.tag) if t == tag]) == 1), None)
    if top is None:
        return None
    y = np.zeros(len(page.tag), bool)
    for k in range(len(page.tag)):
        inside = k == top[0] or (page.parent[k] >= 0 and y[page.parent[k]])
        y[k] = inside and page.tag[k] not in ("nav", "aside", "footer", "form", "button") and (k == top[0] or not BOILERPLATE.intersection(page.names[k]))
    return y


def composed_labels(page: Page) -> np.ndarray:
    y = np.zeros(len(page.tag), bool)
    if set(page.tag) <= {"body", "#text"}:  # all of a page without markup is its text
        return ~y
    for k in range(len(page.tag)):
        y[k] = page.label[k] == "1" or (page.label[k] != "0" and page.parent[k] >= 0 and y[page.parent[k]])
    return y


def compose(blocks: list[tuple[str, str]], lines: list[str], rng: random.Random) -> str:
    """A page with the blocks (tag, text) as its content, set among parts with the lines as their texts; data-label says which is which."""
    say = lambda a, b: " ".join(rng.choice(lines).split()[: rng.randint(a, b)])
    link = lambda: f'<a href="/{rng.randint(1, 999)}">{entities.escape(say(1, 4))}</a>'
    plain = lambda a, b: entities.escape(say(a, b))

    def part(role: str, tags: tuple[str, ...], inner: str) -> str:
        tag = rng.choice(tags)
        named = rng.sample(OTHER[role], rng.randint(1, 2)) if tag in ("div", "section", "ul", "p") or rng.random() < 0.5 else []
        mark = rng.choice(("class", "class", "id"))
        extra = f' {mark}="{rng.choice("-_ ").join(named)}"' if named else ""
        return f'<{tag}{extra} data-label="0">{inner}</{tag}>'

    menu = lambda: "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 7)))
    remark = lambda: rng.choice(("<p>{}</p>", "<div>{}</div>", "<li><p>{}</p></li>", '<div class="comment"><p>{}</p></div>', '<article class="comment"><h4>reader</h4><p>{}</p></article>', "<article><p>{}</p></article>")).format(plain(4, 60))
    parts = {
        "nav": lambda: part("nav", ("nav", "div", "ul"), f"<ul>{menu()}</ul>" if rng.random() < 0.7 else " | ".join(link() for _ in range(4))),
        "header": lambda: part("header", ("header", "div"), f"<h1>{plain(1, 4)}</h1>" + (f"<p>{plain(3, 9)}</p>" if rng.random() < 0.6 else "")),
        "footer": lambda: part("footer", ("footer", "div"), rng.choice(("&copy; 2020 ", "", "<p>")) + plain(4, 40) + (menu() if rng.random() < 0.3 else "")),
        "aside": lambda: part("aside", ("aside", "div", "section"), f"<h3>{plain(1, 3)}</h3><ul>{menu()}</ul>" if rng.random() < 0.6 else f"<h3>{plain(1, 3)}</h3><p>{plain(5, 50)}</p>"),
        "notice": lambda: part("notice", ("div", "section", "aside", "p"), f"{plain(6, 30)} <button>{plain(1, 2)}</button>" if rng.random() < 0.5 else plain(6, 30)),
        "ad": lambda: part("ad", ("div", "aside", "section"), rng.choice((plain(4, 40), f"<p>{plain(4, 40)}</p>", link() + " " + plain(3, 12)))),
        "form": lambda: part("form", ("form", "div"), f"<label>{plain(1, 3)}</label><input name=q><button>{plain(1, 2)}</button>" + (f"<p>{plain(5, 25)}</p>" if rng.random() < 0.4 else "")),
        "comments": lambda: part("comments", ("section", "div", "ul"), f"<h3>{plain(1, 3)}</h3>" + "".join(remark() for _ in range(rng.randint(1, 5)))),
        "share": lambda: part("share", ("div", "ul"), "".join(f"<li>{link()}</li>" for _ in range(3))),
    }
    wrap = rng.choice(("article", "article", "main", "div", "div", "section", "td", ""))
    named = f' class="{rng.choice("-_ ").join(rng.sample(CONTENT, rng.randint(1, 2)))}"' if wrap in ("div", "section", "td") and rng.random() < 0.85 or rng.random() < 0.4 else ""
    if rng.random() < 0.06:
        return "\n".join(entities.escape(text) for _, text in blocks)
    if rng.random() < 0.2:  # many short paragraphs, some of them over and over
        blocks = [(tag, x) for tag, text in blocks for x in text.split(". ")]
        blocks += [blocks[-1]] * rng.choice((0, 0, 20, 100))
    inner = []
    for k, (tag, text) in enumerate(blocks):
        text, shape = entities.escape(text), rng.random()
        short = " ".join(text.split()[:8])
        if k and shape < 0.3:
            items = text.split(". ")[:6]
            inner.append(rng.choice((
                f"<h{rng.randint(2, 4)}>{short}</h{rng.randint(2, 4)}>", f"<blockquote>{text}</blockquote>", f"<blockquote><p>{text}</p></blockquote>", f"<div>{text}</div>", f"<pre>{text}</pre>", f"<figure><img><figcaption>{short}</figcaption></figure>",
                f"<{(ul := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{ul}>", "<table>" + "".join(f"<tr><th>{x[:12]}</th><td>{x}</td></tr>" for x in items) + "</table>",
                f"<section><h2>{short}</h2><p>{text}</p></section>", f'<div class="{rng.choice(CONTENT)}"><p>{text}</p></div>', f"<p>{short} <a href=/x>{short}</a></p>", f"<header><p>{short}</p></header>",
            )))
        else:
            inner.append(f"<{tag}>{text}</{tag}>")
    for role in ("ad", "share", "aside", "notice", "form", "nav"):
        if inner and rng.random() < 0.2:
            inner.insert(rng.randint(1, len(inner)), parts[role]())
    inner += [parts[role]() for role in ("footer", "comments", "footer", "share") if wrap and rng.random() < 0.25]
    if wrap == "td":
        body = f'<table><tr><td data-label="0"><ul>{menu()}</ul></td><td{named} data-label="1">{"".join(inner)}</td></tr></table>'
    elif wrap:
        body = f'<{wrap}{named} data-label="1">{"".join(inner)}</{wrap}>'
    else:
        body = "".join(x if 'data-label="0"' in x else re.sub(r"^<(\w+)", r'<\1 data-label="1"', x) for x in inner)
    if wrap and rng.random() < 0.4:
        body = f'<div class="{rng.choice(("wrapper", "container", "row", "layout"))}">{body}</div>'
    pick = lambda roles, p: "".join(parts[r]() for r in roles if rng.random() < p)
    return f"<html><body>{pick(('notice', 'header', 'nav', 'ad'), 0.55)}{body}{pick(('aside', 'ad', 'comments', 'form', 'share', 'footer', 'notice'), 0.5)}</body></html>"


def lengthened(source: str, rng: random.Random) -> str:
    """The page with many copies of one more, short, paragraph in its article: length alone must not speak against a part that says what it is."""
    end = max(source.lower().rfind("</article"), source.lower().rfind("</main"))
    return source[:end] + f"<p>{'a word or so'[: rng.randint(1, 12)]}.</p>" * rng.choice((50, 200, 400)) + source[end:] if end >= 0 else source


def train(sources: list[str], composed: int = COMPOSED, seed: int = 7) -> Model:
    """A model from pages with an article of their own, and `composed` pages made of the texts of each.  Without such pages, texts are made of placeholder words."""
    rng, pages, labels = random.Random(seed), [], []
    articles: list[list[tuple[str, str]]] = []
    for source in [*sources, *(lengthened(x, rng) for x in sources[::8])]:
        page = parse(source)
        y = distant(page)
        if y is not None:
            own = [(page.tag[page.parent[k]], t) for k, t in enumerate(page.text) if t is not None and y[k]]
            if own and len(articles) < len(sources):
                articles.append([(tag if tag in ("p", "h1", "h2", "h3", "li", "blockquote") else "p", t) for tag, t in own][:100])
            pages.append(page)
            labels.append(y)
    filler = [("h1", "words of a title")] + [("p", " ".join(f"word{(k * j) % 97}" for j in range(1, 4 + (k * 37) % 90)) + ".") for k in range(1, 9)]
    articles = articles if len(articles) >= 20 else articles + [filler] * 60
    lines = [t for own in articles for _, t in own]
    for own in articles:
        for _ in range(composed):
            page = parse(compose(own, lines, rng))
            pages.append(page)
            labels.append(composed_labels(page))
    return fit(pages, labels)


def sample(pages: DataFrame, html_col: str = "html", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[str]:
    """At most `most` pages of at most most_bytes that mark an article or a main part, by a hash of their html."""
    html = F.col(html_col).cast("string")
    marked = pages.select(html.alias("html")).filter((F.octet_length("html") <= most_bytes) & F.col("html").rlike("(?i)<(article|main)[\\s>]")).withColumn("hash", F.xxhash64("html"))
    first = [r["hash"] for r in marked.select("hash").distinct().orderBy("hash").limit(most).collect()]  # hashes alone, so that no task sends pages that are not taken
    found = marked.filter(F.col("hash").isin(first)).groupBy("hash").agg(F.min("html").alias("html")) if first else marked.limit(0)
    return [r.html for r in found.orderBy("hash").collect()]


# --- extraction ---------------------------------------------------------------------------------------------------------

def texts_of(model: Model, sources: list[str | None]) -> list[list[tuple[str, float]]]:
    """The text blocks of each page, in page order, with their marginals."""
    pages = [parse(s or "") for s in sources]
    return [[(t, float(p)) for t, p in zip(page.text, marginal, strict=True) if t is not None] for page, marginal in zip(pages, model.content(pages), strict=True)]


def blocks(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (the content blocks joined by blank lines) and blocks (text, content: its marginal) of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES_AT_ONCE):
                batch = whole.slice(at, PAGES_AT_ONCE)
                found = texts_of(shared.value, batch.column("html").to_pylist())
                text = ["\n\n".join(t for t, p in own if p >= 0.5) for own in found]
                rows = [[{"text": t, "content": p} for t, p in own] for own in found]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("content", pa.float64())])))], ["page_id", "url", "text", "blocks"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, blocks array<struct<text: string, content: double>>")


def op11_html_extraction(pages: DataFrame) -> DataFrame:
    out = blocks(pages, train(sample(pages)))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
