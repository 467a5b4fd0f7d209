"""Main text of HTML pages by a tree-structured graphical model.

Each element is a binary variable, content or not. Its features (tag, class and id words, amounts of text, links and signs, its
share of the page's unlinked text) give potentials of its own; parent and child are tied by potentials that depend on the
child's tag and hint words. Sum-product messages go up from the leaves and down from the root; their products are the exact
marginals. Weights are fitted by gradient ascent on the likelihood of labelled pages, which a small generator of page layouts
makes. Messages of all pages of a step are passed together, level by level.

Text below an element of content marginal >= 0.5 is kept. Character references are decoded, white space inside a block
becomes one space, blocks are joined by a line end; <br> counts as white space.

Defined results: null or empty html gives an empty text; a null page_id or url and repeated rows are carried; long, deep and
broken pages are read whole, in time linear in their length; a marginal of exactly one half is content; an empty table gives
an empty result; only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import chunks
from florilege.llm.html_tree import RAW, Tree, parse

TRAIN_PAGES = 700
ROUNDS = 120
RATE = 0.5
DECAY = 0.002
#: Forests of more levels than this, and few elements in each, go element by element.
NARROW = 500


def _bucket(n: int) -> int:
    return min(8, n.bit_length())


def described(tree: Tree) -> tuple[list[tuple], list[tuple]]:
    """For each element: what its own features follow from, and what those of its tie to its parent do."""
    n = len(tree.tags)
    chars, linked, commas, long, direct = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    in_link, in_raw = [False] * n, [False] * n
    for i in range(1, n):
        tag, parent = tree.tags[i], tree.parents[i]
        in_link[i] = tag == "a" or in_link[parent]
        in_raw[i] = tag in RAW or tag == "head" or in_raw[parent]
    for i, text in tree.pieces:
        if text and not in_raw[i]:
            size = len(text.strip())
            chars[i] += size
            direct[i] += size
            linked[i] += size * in_link[i]
            commas[i] += text.count(",") + text.count(".")
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        commas[p] += commas[i]
        if tree.tags[i] == "p":
            long[i] += chars[i] - linked[i] >= 80
        long[p] += long[i]
    page = max(1, chars[0] - linked[0])
    own, tie = [], []
    kinds = ["h" if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else tag for tag in tree.tags]
    for i, tag in enumerate(kinds):
        density = 4 * linked[i] // chars[i] if chars[i] else 5
        share = 4 * (chars[i] - linked[i]) // page
        own.append((tag, _bucket(chars[i] // 8), density, _bucket(commas[i]), share, _bucket(long[i]), _bucket(direct[i] // 40), tree.hints[i]))
        tie.append((tag, kinds[tree.parents[i]], tree.hints[i]))
    return own, tie


def own_features(x: tuple) -> list[str]:
    tag, size, density, commas, share, long, direct, hints = x
    words = [f"w:{w}" for w in sorted(hints)]
    return ["bias", f"t:{tag}", f"n:{size}", f"d:{density}", f"td:{tag}{density // 3}", f"c:{commas}", f"s:{share}", f"l:{long}", f"x:{tag}{direct}", *(["named"] if words else []), *words]


def tie_features(x: tuple) -> list[str]:
    tag, parent, hints = x
    return ["bias", f"t:{tag}", f"e:{parent}>{tag}", *[f"w:{w}" for w in sorted(hints)]]


def features(tree: Tree) -> tuple[list[list[str]], list[list[str]]]:
    """For each element: its own features, and those of its tie to its parent."""
    own, tie = described(tree)
    return [own_features(x) for x in own], [tie_features(x) for x in tie]


class Layers:
    """Elements of several trees as one forest, by their distance from the root."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.tags) for t in trees]
        self.first = np.cumsum([0, *sizes])
        self.parents = np.concatenate([np.array(t.parents) + at for t, at in zip(trees, self.first, strict=False)])
        self.roots = self.first[:-1]
        self.parents[self.roots] = self.roots
        depth = np.zeros(len(self.parents), np.int64)
        for tree, at in zip(trees, self.first, strict=False):
            own = [0] * len(tree.tags)
            for i in range(1, len(own)):
                own[i] = own[tree.parents[i]] + 1
            depth[at : at + len(own)] = own
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]  # without the roots

    def marginals(self, own: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each element, and P(labels of parent and child) of each tie, by sum-product in log odds.

        own: log potential of content; tie: those of (stay out, enter, leave, stay in). Roots aren't content.
        """
        n = len(self.parents)
        if len(self.levels) > NARROW and len(self.levels) * 8 > n:
            return self._one_by_one(own.tolist(), tie.tolist())
        up = own.copy()
        up[self.roots] = -np.inf
        message = np.zeros(n)
        for at in reversed(self.levels):
            out, enter, leave, stay = tie[at].T
            message[at] = np.logaddexp(leave, stay + up[at]) - np.logaddexp(out, enter + up[at])
            np.add.at(up, self.parents[at], message[at])
        down, ties = np.zeros(n), np.zeros((n, 4))
        ties[:, 0] = 1
        for at in self.levels:
            p = self.parents[at]
            rest = up[p] + down[p] - message[at]
            out, enter, leave, stay = tie[at].T
            down[at] = np.logaddexp(enter, rest + stay) - np.logaddexp(out, rest + leave)
            j = np.stack([out, enter + up[at], rest + leave, rest + stay + up[at]], 1)
            j = np.exp(j - j.max(1, keepdims=True))
            ties[at] = j / j.sum(1, keepdims=True)
        return ties[:, 1] + ties[:, 3], ties


    def _one_by_one(self, own: list[float], tie: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """The same for deep and narrow trees, element by element: a parent comes before its children."""
        n, parents = len(own), self.parents.tolist()
        exp, log1p = math.exp, math.log1p
        add = lambda a, b: a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b)) if b > -math.inf else b
        up, message, down = own, [0.0] * n, [0.0] * n
        for i in self.roots.tolist():
            up[i] = -math.inf
        for i in range(n - 1, -1, -1):
            if (p := parents[i]) != i:
                out, enter, leave, stay = tie[i]
                message[i] = add(leave, stay + up[i]) - add(out, enter + up[i])
                up[p] += message[i]
        ties = [(1.0, 0.0, 0.0, 0.0)] * n
        for i, p in enumerate(parents):
            if p != i:
                rest = up[p] + down[p] - message[i]
                out, enter, leave, stay = tie[i]
                down[i] = add(enter, rest + stay) - add(out, rest + leave)
                j = out, enter + up[i], rest + leave, rest + stay + up[i]
                most = max(j)
                j = [exp(x - most) for x in j]
                s = sum(j)
                ties[i] = (j[0] / s, j[1] / s, j[2] / s, j[3] / s)
        ties = np.array(ties)
        return ties[:, 1] + ties[:, 3], ties


class Model:
    """Weights: own[f] for content, tie[f] = (stay out, enter, leave, stay in) by the labels of parent and child."""

    def __init__(self) -> None:
        self.own: dict[str, float] = defaultdict(float)
        self.tie: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)

    def potentials(self, own: list[list[str]], tie: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self._own(x) for x in own]), np.array([self._tie(x) for x in tie])

    def _own(self, names: list[str]) -> float:
        return sum([self.own.get(f, 0.0) for f in names])

    def _tie(self, names: list[str]) -> tuple[float, ...]:
        weights = [self.tie[f] for f in names if f in self.tie]
        return tuple(sum([w[k] for w in weights]) for k in range(4))

    def looked_up(self, own: list[tuple], tie: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Potentials of described elements; few descriptions differ in a step, so each is summed once."""
        owns = {x: self._own(own_features(x)) for x in set(own)}
        ties = {x: self._tie(tie_features(x)) for x in set(tie)}
        return np.array([owns[x] for x in own]), np.array([ties[x] for x in tie])

    def marginals(self, tree: Tree, own: list[list[str]], tie: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each element, and P(labels of parent and child) of each tie."""
        return Layers([tree]).marginals(*self.potentials(own, tie))


class _Table:
    """Features of all elements as numbers: sums of weights by element, and of gradients by feature."""

    def __init__(self, rows: list[list[str]]):
        self.names = sorted({f for x in rows for f in x})
        number = {f: k for k, f in enumerate(self.names)}
        self.row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        self.feature = np.array([number[f] for x in rows for f in x])
        self.n = len(rows)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.feature], self.n)

    def gradient(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature, values[self.row], len(self.names))


def labelled(page: str, marker: str) -> tuple[Tree, list[int]]:
    """The tree of a page without its marker words, and its elements' labels."""
    tree = parse(page)
    truth = [0] * len(tree.tags)
    for i in range(1, len(truth)):
        said = tree.hints[i] & {marker, f"{marker}out"}
        truth[i] = int(marker in said) if said else truth[tree.parents[i]]
    tree.hints = [h - {marker, f"{marker}out"} for h in tree.hints]
    return tree, truth


def train(pages: list[tuple[str, str]], rounds: int = ROUNDS) -> Model:
    """Fit weights to (html, marker) pages whose content elements carry the marker word as a class, which is then removed."""
    trees, truths = zip(*(labelled(page, marker) for page, marker in pages), strict=True)
    layers, truth = Layers(list(trees)), np.concatenate([np.array(t) for t in truths])
    both = [features(tree) for tree in trees]
    own, tie = _Table([x for a, _ in both for x in a]), _Table([x for _, b in both for x in b])
    inner = np.ones(len(truth), bool)
    inner[layers.roots] = False
    state = np.eye(4)[2 * truth[layers.parents] + truth]
    w_own, w_tie = np.zeros(len(own.names)), np.zeros((len(tie.names), 4))
    w_tie[tie.names.index("bias")] = 2.0, 0.0, 0.0, 2.0  # neighbours agree, to begin with
    size_own, size_tie = np.zeros_like(w_own), np.zeros_like(w_tie)
    for _ in range(rounds):
        content, ties = layers.marginals(own.sums(w_own), np.stack([tie.sums(w_tie[:, k]) for k in range(4)], 1))
        g_own = own.gradient(np.where(inner, truth - content, 0.0))
        g_tie = np.stack([tie.gradient(np.where(inner, state[:, k] - ties[:, k], 0.0)) for k in range(4)], 1)
        size_own += g_own * g_own  # adaptive steps, as counts of features differ by orders
        size_tie += (g_tie * g_tie).sum(1, keepdims=True)
        w_own += RATE * g_own / (1e-6 + np.sqrt(size_own)) - DECAY * w_own
        w_tie += RATE * g_tie / (1e-6 + np.sqrt(size_tie)) - DECAY * w_tie
    model = Model()
    model.own.update(zip(own.names, w_own.tolist(), strict=True))
    model.tie.update(zip(tie.names, w_tie.tolist(), strict=True))
    return model


_MARK = "goldtext"


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 11) -> list[tuple[str, str]]:
    """Pages of varied layouts; classes goldtext and goldtextout begin content and what isn't content inside it."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(4, 18).capitalize() + (", " + words(2, 8) if r.random() < 0.5 else "") + "."
    prose = lambda: " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5))))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
    hint = lambda *names: f' {r.choice(("class", "id"))}="{r.choice(names)}"'
    quiet = lambda x: re.sub(r"^<(\w+)([^>]*)>", rf'<\1\2 role="{_MARK}out">', x, count=1)

    def around() -> list[str]:
        return [
            f"<nav{r.choice(('', hint('menu', 'main-nav', 'navbar')))}>{menu()}</nav>",
            f"<div{hint('menu', 'nav', 'navigation', 'breadcrumb', 'breadcrumbs', 'topbar')}>{r.choice((menu(), ' &raquo; '.join(link() for _ in range(3))))}</div>",
            f"<header>{r.choice((words(1, 4), link() + menu(), '<h1>' + words(1, 3) + '</h1>', '<h2>' + words(1, 3) + '</h2><p>' + sentence() + '</p>'))}</header>",
            f"<div{hint('header', 'masthead', 'site-header', 'logo')}>{r.choice((words(1, 4), link()))}</div>",
            f"<div{hint('ad', 'ads', 'advert', 'advertisement', 'banner', 'promo', 'sponsored', 'sponsor')}>{r.choice((sentence(), prose(), link(), '<p>' + prose() + '</p>'))}</div>",
            f"<aside{r.choice(('', hint('sidebar', 'related', 'widget')))}>{r.choice((menu(), '<h3>' + words(1, 3) + '</h3><p>' + prose() + '</p>', '<p>' + prose() + '</p>'))}</aside>",
            f"<div{hint('sidebar', 'widget', 'related', 'recommended', 'side', 'social', 'share', 'tags', 'pagination')}>{r.choice((menu(), '<p>' + prose() + '</p>', '<h4>' + words(1, 3) + '</h4>' + menu()))}</div>",
            f"<div{hint('cookie', 'cookie-notice', 'cookie-banner', 'notice', 'consent', 'popup', 'modal', 'newsletter', 'subscribe', 'alert', 'gdpr')}>{r.choice((sentence(), '<p>' + prose() + '</p>'))}</div>",
            f"<form{r.choice(('', hint('search', 'login', 'signup')))}><label>{words(1, 3)}</label><input name=q><button>{word()}</button><p>{sentence()}</p></form>",
            f"<section{hint('comments', 'comment-list', 'discussion', 'responses')}><h3>{words(1, 2)}</h3>" + "".join(f'<{t}{hint("comment", "reply", "comment-body")}><p>{prose()}</p></{t}>' for t in [r.choice(("div", "article", "li"))] * r.randint(1, 4)) + "</section>",
            f"<div{hint('comments', 'disqus', 'comment', 'reviews')}>{r.choice((f'<h3>{words(1, 3)}</h3>', ''))}{r.choice((f'<p>{prose()}</p><p>{prose()}</p>', f'<ul><li><p>{prose()}</p></li><li>{prose()}</li></ul>', f'<ol><li>{prose()}</li></ol>'))}</div>",
            f"<footer{r.choice(('', hint('footer', 'site-footer')))}>{r.choice(('&copy; ' + words(1, 3) + ' &middot; ' + sentence(), menu(), '<p>' + prose() + '</p>'))}</footer>",
            f"<div{hint('footer', 'copyright', 'legal', 'disclaimer')}>{r.choice(('&copy; ' + words(2, 5), '<p>' + sentence() + '</p>', menu()))}</div>",
            f"<aside{r.choice(('', hint('widget-area', 'sidebar', 'secondary')))}>" + "".join(f"<{t}{r.choice(('', hint('widget', 'block', 'box')))}><h2>{words(1, 3)}</h2>{r.choice((menu(), '<p>' + sentence() + '</p>'))}</{t}>" for t in r.choice((["section"], ["section"] * 2, ["div"] * 2))) + "</aside>",
            f"<footer{hint('entry-footer', 'post-footer', 'article-footer', 'post-meta')}><span{r.choice(('', hint('tags-links', 'cat-links')))}>{link()}</span></footer>",
            f"<div{r.choice(('', '', hint('more', 'next', 'prev', word())))}><p>{link()}</p></div>",
            f'<div role="{r.choice(("navigation", "banner", "complementary", "contentinfo", "search"))}">{r.choice((menu(), sentence()))}</div>',
        ]

    def body_block() -> str:
        return r.choice(
            [f"<p>{prose()}</p>"] * 9
            + [f"<p><b>{sentence()}<br><p>{prose()}</p>", f"<h{r.randint(2, 4)}>{words(1, 6)}</h{r.randint(2, 4)}>", f"<p>{sentence()} {link()} <em>{words(1, 3)}</em> {sentence()}</p>", f"<p>{word()}.</p>", f"<p>{link()}</p>"]
            + ["<ul>" + "".join(f"<li>{r.choice((words(1, 6), sentence(), link()))}</li>" for _ in range(r.randint(2, 5))) + "</ul>", "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(1, 3))) + "</ul>", "<ol>" + "".join(f"<li>{sentence()}" for _ in range(3)) + "</ol>"]
            + [f"<blockquote>{r.choice((prose(), '<p>' + prose() + '</p>'))}</blockquote>", f"<pre><code>{words(3, 12)}</code></pre>", f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>", f"<div>{prose()}</div>", f"<div><span>{prose()}</span><br><span>{prose()}</span></div>", f"<section><h2>{words(1, 4)}</h2><p>{prose()}</p></section>"]
            + ["<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>", f"<dl><dt>{word()}<dd>{sentence()}</dl>", f"<div><p>{prose()}</p><p>{prose()}</p></div>"]
        )

    pages = []
    for _ in range(n):
        shell = r.choice(("<article{}>",) * 4 + ("<div{}>",) * 3 + ("<section{}>", "<main{}>", "<table><tr><td{}>", "<table><tr><td{}>", "<center{}>", '<div{} id="' + word() + '">') + ("<main{}>", "<div{} id=content>", '<div{} id="main-content">', '<div{} id="post">', '<section{} id="article">', '<div{} id="entry-content">', "<main><article{}>", "<div><article{}>", '<div id="wrapper"><div{} id="article-body">', '<div role="main"{}>'))
        inner = ([r.choice((f"<h1>{words(2, 8)}</h1>", f"<header><h1>{words(2, 8)}</h1></header>", f"<h1>{words(2, 8)}</h1>"))] if r.random() < 0.9 else []) + [body_block() for _ in range(r.choice((0, 1, 2, 4, 8, 14)))]
        if r.random() < 0.1:  # text without blocks
            inner = [r.choice(("<br><br>", "<br>")).join(r.choice((prose(), f"<span>{prose()}</span>")) for _ in range(r.randint(1, 5)))]
        if r.random() < 0.65:
            for _ in range(r.randint(1, 3)):
                inside = [x for x in around() if not x.startswith("<header")]
                x = r.choice(inside + [x for x in inside if "comment" in x[:40] or x.startswith("<aside")])
                inner.insert(r.randint(0, len(inner)), quiet(x))
        if shell.startswith('<div role="main"'):
            start = f'<div id="main" role="{_MARK}">'
            ends = "</div>"
        else:
            start = shell.format(f' class="{_MARK}"')
            ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", shell)))
            if shell.startswith("<table") and r.random() < 0.7:  # a cell of links beside it
                start = start.replace("<tr>", f"<tr><td>{r.choice((menu(), '<br>'.join(link() for _ in range(r.randint(2, 6)))))}</td>")
        before, after = r.sample(around(), r.randint(0, 4)), r.sample(around(), r.randint(0, 4))
        head, tail = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>", "</body></html>"
        middle = start + "".join(inner) + ends
        kind = r.random()
        if kind < 0.04:  # a page without an article
            middle = ""
        elif kind < 0.2:  # blocks right in the body
            said = lambda x: re.sub(r"^<(\w+)([^>]*)>", rf'<\1\2 role="{_MARK}">', x, count=1)
            middle = "".join(said(body_block()) for _ in range(r.randint(1, 6)))
            if r.random() < 0.6:
                middle = f'<h1 role="{_MARK}">{words(2, 8)}</h1>' + middle
        elif kind < 0.29:  # text right in the body
            head = head[: -len("<body>")] + f'<body role="{_MARK}">'
            before, after = [quiet(x) for x in before], [quiet(x) for x in after]
            if r.random() < 0.6:
                head, before, after, tail = f'<body role="{_MARK}">', [], [], ""
            middle = "<br><br>".join(prose() for _ in range(r.randint(1, 5)))
        elif kind < 0.5:
            middle = f"<div{r.choice(('', '', hint('page', 'wrapper', 'container', 'row', 'layout', 'inner', 'outer', word(), word())))}>{middle}{''.join(r.sample(around(), r.randint(0, 2)))}</div>"
        if r.random() < 0.08:  # a fragment
            head = head[head.index("<body") :].replace("<body>", "") if "role" not in head else head
            tail = ""
            before, after = before[:1], after[:1]
        pages.append((head + "".join(before) + middle + "".join(after) + tail, _MARK))
    return pages


@functools.cache
def default_model() -> Model:
    return train(labelled_pages())


def extract_all(pages: list[str], model: Model) -> list[str]:
    """The main texts of pages."""
    if not pages:
        return []
    trees = [parse(page) for page in pages]
    layers = Layers(trees)
    both = [described(tree) for tree in trees]
    content, _ = layers.marginals(*model.looked_up([x for a, _ in both for x in a], [x for _, b in both for x in b]))
    return [_text(tree, (content[at : at + len(tree.tags)] >= 0.5).tolist()) for tree, at in zip(trees, layers.roots.tolist(), strict=True)]


def _text(tree: Tree, content: list[bool]) -> str:
    hidden = [tag in RAW or tag == "head" for tag in tree.tags]
    for i in range(1, len(hidden)):
        hidden[i] |= hidden[tree.parents[i]]
    blocks, current = [], []
    for i, text in [*tree.pieces, (0, None)]:
        if text is None:
            if block := " ".join("".join(current).split()):
                blocks.append(block)
            current = []
        elif not hidden[i] and content[i]:
            current.append(html.unescape(text))  # a reference doesn't reach over tags
    return "\n".join(blocks)


def extract(page: str, own_weights: dict, tie_weights: dict) -> str:
    """The main text of a page."""
    return extract_all([page], _model(own_weights, tie_weights))[0]


def _model(own_weights: dict, tie_weights: dict) -> Model:
    model = Model()
    model.own, model.tie = own_weights, tie_weights
    return model


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    model = model or default_model()
    own, tie = dict(model.own), dict(model.tie)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "html")):
            texts = extract_all([x or "" for x in batch.column(2).to_pylist()], _model(own, tie))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(read, "page_id long, url string, text string, n_chars long")
