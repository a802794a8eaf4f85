"""Main text of web pages by a tree-structured graphical model over their blocks."""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ewpanel.llm.common import text_slices
from ewpanel.llm.dom import KIND_NAMES, ROLE, ROLE_NAMES, TEXT, Forest, Page, joined

MARK = ""  # stands in content runs of pages laid out for training; taken out of pages that hold it
CHARS, LINKED, STOPS, SHARE = (1, 25, 80, 200, 600), (0.01, 0.25, 0.6, 0.95), (0.2, 1.0, 2.5), (0.02, 0.1, 0.3, 0.6)
# An edge's table goes by its child: a run of text, a block of text, a box, or a landmark.
_EDGE = np.array([{"text": 0, "inline": 0, "p": 1, "heading": 1, "item": 1, "cell": 1, "quote": 1}.get(k, 3 if k in ("article", "main", "nav", "header", "footer", "aside", "form") else 2) for k in KIND_NAMES])
EDGES = 4
_LANDMARK_ROLE = np.array([{"article": ROLE["content"], "main": ROLE["content"], "nav": ROLE["menu"], "header": ROLE["header"], "footer": ROLE["footer"], "aside": ROLE["sidebar"], "form": ROLE["form"]}.get(k, 0) for k in KIND_NAMES])


def _bins(values: np.ndarray, edges: tuple) -> np.ndarray:
    return np.eye(len(edges) + 1)[np.searchsorted(edges, values, "right")]


def features(forest: Forest) -> np.ndarray:
    """Nodes by zero-one features: kind, announced roles, and the length, links, stops, share and place of the text below."""
    texts = forest.texts
    chars = forest.above(np.array([len(t) - t.count(" ") for t in texts], np.float64))
    linked = forest.above(forest.linked)
    stops = forest.above(np.array([t.count(". ") + t.count("! ") + t.count("? ") + t.rstrip().endswith((".", "!", "?", "。", "…")) for t in texts], np.float64))
    signs = forest.above(np.array([t.count("©") for t in texts], np.float64))
    whole = np.zeros(forest.pages)
    leaf_page = forest.page[forest.leaf]
    np.add.at(whole, leaf_page, chars[forest.leaf])
    prose = np.where(np.isin(forest.kind[forest.parent[forest.leaf]], [KIND_NAMES.index(k) for k in ("p", "quote", "heading")]), chars[forest.leaf], 0.0)
    prose = forest.above(prose)
    upto = np.cumsum(chars[forest.leaf])
    first = np.concatenate([[0.0], np.cumsum(whole)])[:-1]
    middle = np.full(len(chars), 0.5)
    middle[forest.leaf] = (upto - chars[forest.leaf] / 2 - first[leaf_page]) / np.maximum(whole[leaf_page], 1)
    total = np.maximum(chars, 1)
    mass = forest.above(middle[forest.leaf] * chars[forest.leaf]) / total
    title = np.zeros(len(chars))
    title[forest.level == 1] = 1
    forest.to_parents(title, np.maximum)
    is_leaf = forest.kind == TEXT
    within = forest.roles | _LANDMARK_ROLE[forest.kind]
    for nodes in forest.levels[1:]:  # what the nearest announcing box around or at the node announces
        within[nodes] = np.where(within[nodes] > 0, within[nodes], within[forest.parent[nodes]])
    within = (within[:, None] >> np.arange(len(ROLE_NAMES))) & 1
    roles = (forest.roles[:, None] >> np.arange(len(ROLE_NAMES))) & 1
    size = _bins(chars, CHARS)
    parts = [
        np.ones((len(chars), 1)), np.eye(len(KIND_NAMES))[forest.kind], roles, within, size * is_leaf[:, None], size * ~is_leaf[:, None], _bins(linked / total, LINKED),
        _bins(100 * stops / total, STOPS), _bins(chars / np.maximum(whole[forest.page], 1), SHARE) * ~is_leaf[:, None], _bins(mass, (0.05, 0.2, 0.8, 0.95)), _bins(prose / total, (0.2, 0.8)),
        (signs > 0)[:, None], title[:, None], (title[:, None] * (roles[:, 2:3] | (forest.kind == KIND_NAMES.index("header"))[:, None])),
    ]
    return np.hstack([p.astype(np.float32) for p in parts])


def sum_product(forest: Forest, lean: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of a pairwise model on trees: P(node is content), P(parent state, state) by node, and the sum of log Z.

    ``lean`` is a node's potential for content (0 against it), ``tables[e]`` the potentials of (parent, child) on edges
    of kind e. One pass upward level by level, one downward, for all pages of the forest at once.
    """
    n = len(lean)
    belief = np.stack([np.zeros(n), lean], 1)
    edge = tables[_EDGE[forest.kind]]
    up = np.zeros((n, 2))
    for nodes, (parents, first) in zip(forest.levels[:0:-1], forest.parents[::-1]):
        up[nodes] = np.logaddexp(edge[nodes, :, 0] + belief[nodes, None, 0], edge[nodes, :, 1] + belief[nodes, None, 1])
        belief[parents] += np.add.reduceat(up[nodes], first)
    roots = forest.levels[0] if forest.levels else np.zeros(0, np.int64)
    log_z = float(np.logaddexp(belief[roots, 0], belief[roots, 1]).sum())
    pair = np.zeros((n, 2, 2))
    for nodes in forest.levels[1:]:
        rest = belief[forest.parent[nodes]] - up[nodes]
        joint = rest[:, :, None] + edge[nodes] + belief[nodes][:, None, :]
        belief[nodes] += np.logaddexp(rest[:, 0:1] + edge[nodes, 0], rest[:, 1:2] + edge[nodes, 1])
        joint -= joint.max((1, 2), keepdims=True)
        pair[nodes] = np.exp(joint) / np.exp(joint).sum((1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pair, log_z


def states_of(forest: Forest, leaves: np.ndarray) -> np.ndarray:
    """States of all nodes from those of the leaves: content where at least half of the text below is."""
    chars = np.array([len(t.strip()) for t in forest.texts], np.float64)
    return forest.above(chars * leaves) * 2 >= forest.above(chars)


def fit(forest: Forest, leaves: np.ndarray, steps: int = 200, rate: float = 0.15, penalty: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and tables of the edges at the greatest penalised likelihood of the labelled pages.

    The gradient is observed less expected features, the expectation by sum-product; steps are Adam's.
    """
    x, y = features(forest).astype(np.float64), states_of(forest, leaves).astype(np.int64)
    child = np.concatenate(forest.levels[1:]) if len(forest.levels) > 1 else np.zeros(0, np.int64)
    kind = _EDGE[forest.kind[child]]
    seen = np.zeros((EDGES, 2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[:, a, b] = np.bincount(kind, (y[forest.parent[child]] == a) & (y[child] == b), EDGES)
    theta = np.zeros(x.shape[1] + EDGES * 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        content, pair, _ = sum_product(forest, x @ theta[: x.shape[1]], theta[x.shape[1] :].reshape(EDGES, 2, 2))
        pair = pair[child].reshape(-1, 4)
        expected = np.stack([np.bincount(kind, pair[:, c], EDGES) for c in range(4)], 1)
        slope = np.concatenate([x.T @ (y - content), seen.ravel() - expected.ravel()]) / max(1, forest.pages) - penalty * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        theta += rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8) * min(1.0, 2 - 2 * step / steps)
    return theta[: x.shape[1]], theta[x.shape[1] :].reshape(EDGES, 2, 2)


def landmark_labels(page: Page) -> list[bool] | None:
    """Leaves' labels where the page says where its one article is (article, else main), without asides, menus and the like in it; else null."""
    kinds = [KIND_NAMES[k] for k in page.kind]
    for mark in ("article", "main"):
        found = [i for i, k in enumerate(kinds) if k == mark]
        if len(found) == 1:
            break
    else:
        return None
    state = [False] * len(kinds)
    outside = sum(ROLE[w] for w in ("nav", "footer", "sidebar", "cookie", "ad", "login", "comment", "share"))
    for i in range(1, len(kinds)):
        state[i] = i == found[0] or (state[page.parent[i]] and kinds[i] not in ("nav", "footer", "aside", "form") and not page.roles[i] & outside)
    labels = [state[i] for i in page.leaf]
    return labels if any(labels) else None


# Names and phrases of the pages laid out for training.
_NAMES = {
    "content": ["content", "article-body", "post", "entry-content", "story", "main-content", "post-content", "article_text", "articleBody", "text"],
    "menu": ["nav", "navbar", "main-menu", "breadcrumb", "topnav", "menu-list", "pagination", "nav-links"], "header": ["header", "site-header", "masthead", "topbar", "branding"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "footer-links"], "sidebar": ["sidebar", "side-bar", "widget-area", "aside", "right-rail", "secondary"],
    "notice": ["cookie-banner", "notice", "consent", "gdpr-notice", "newsletter", "alert-box", "popup", "subscribe-box", "paywall"], "ad": ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement", "banner-ad"],
    "form": ["search-form", "login", "contact-form", "signup-form"], "comments": ["comments", "comment-list", "comments-area", "disqus_thread", "reader-comments", "discussion"],
    "related": ["share", "social-links", "related-posts", "recommended", "tags", "sharing-buttons"],
}
_LANDMARK = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "related": "aside", "notice": "aside", "ad": "aside"}
_PHRASES = ["Home", "About", "Contact", "Sign in", "Read more", "Share", "Next", "Privacy", "Terms", "Subscribe", "Latest", "Search"]
_SENTENCES = ["We use cookies to improve this site.", "Enter your address to get our news every week.", "All rights reserved.", "This was a good read, thank you.", "I do not agree with the last part, sorry.", "Please accept our terms to go on."]


def lay_out(rng: np.random.Generator, texts: list[str], shorts: list[str]) -> str:
    """A page around an article of some of ``texts``, its content runs marked; boxes, names and order drawn at random."""
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    chance = lambda p: rng.random() < p
    esc = html.escape
    word = lambda: esc(pick(shorts) if shorts and chance(0.7) else pick(_PHRASES))

    def sentences() -> str:
        if chance(0.3):
            return esc(pick(_SENTENCES))
        cut = pick(texts).split(". ")
        a = int(rng.integers(len(cut)))
        return esc(". ".join(cut[a : a + int(rng.integers(1, 4))]))

    def named(role: str) -> str:
        return f' {pick(["class", "class", "id"])}="{pick(_NAMES[role])}{pick(["", "", " wide", " box-2"])}"'

    def box(role: str, inner: str) -> str:
        way = rng.random()
        tag = _LANDMARK.get(role, "div") if way < 0.45 else pick(["div", "div", "section", "ul" if inner.startswith("<li") else "div"])
        name = named(role) if way > 0.35 and (way < 0.9 or role in ("comments", "notice", "ad", "sidebar")) else ""
        if role in ("comments", "notice", "ad") and tag in ("div", "section"):
            name = name or named(role)
        return f"<{tag}{name}>{inner}</{tag}>"

    def links(n: int) -> str:
        items = [f'<a href="/{i}">{word()}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if chance(0.7) else pick([" | ", " ", "\n"]).join(items)

    def comments() -> str:
        one = lambda: f'<{t}{c}><p><b>{word()}</b></p><p>{sentences()}</p></{t}>'
        t, c = pick([("li", ""), ("div", ' class="comment"'), ("article", ' class="comment"'), ("div", "")])
        return box("comments", f"<h3>{int(rng.integers(1, 40))} comments</h3>" + "".join(one() for _ in range(int(rng.integers(1, 6)))))

    m = lambda text: MARK + text

    def content() -> str:
        out = []
        if chance(0.85):
            head = f"<h1>{m(esc(' '.join(pick(texts).split()[:9])))}</h1>"
            out.append(f"<header>{head}</header>" if chance(0.2) else head)
        for _ in range(int(rng.integers(1, 9))):
            kind, text = rng.random(), esc(pick(texts))
            if kind < 0.62:
                cut = text.find(" ", len(text) // 2)
                text = f'{text[:cut]} <a href="#">{text[cut + 1 :][:20]}</a>{text[cut + 1 :][20:]}' if cut > 0 and "&" not in text and chance(0.2) else text
                out.append(pick([f"<p>{m(text)}</p>", f"<p>{m(text)}</p>", f"<p>{m(text)}", f"<p><b>{m(text)}<br>", f"<div>{m(text)}</div>"]))
            elif kind < 0.72:
                out.append(f"<p>{m(sentences())}</p>")
            elif kind < 0.8:
                out.append(f"<h2>{m(word())}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{m(sentences())}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{m(sentences())}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{m(word())}</td><td>{m(word())}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.96:
                out.append(f"<figure><figcaption>{m(sentences())}</figcaption></figure>")
            else:
                out.append(f"<pre>{m(sentences())}</pre>")
        for role, p, inner in (("ad", 0.2, lambda: pick([sentences(), f"<p>{sentences()}</p>", links(1)])), ("related", 0.2, lambda: links(int(rng.integers(2, 6)))), ("notice", 0.1, lambda: f"<p>{sentences()}</p>")):
            if chance(p):
                out.insert(int(rng.integers(1, len(out) + 1)), box(role, inner()))
        return "\n".join(out) if chance(0.4) else "".join(out)

    inner = content()
    way = int(rng.integers(7))
    if way < 4:
        inner = [f"<article>{inner}</article>", f"<main>{inner}</main>", f"<div{named('content')}>{inner}</div>", f'<article{named("content")}>{inner}</article>'][way]
    elif way == 4:
        inner = f"<main><div>{inner}</div></main>"
    elif way == 5:
        inner = f"<section{named('content')}>{inner}</section>"
    else:
        inner = f"<div><div>{inner}</div></div>"
    before = [
        ("header", 0.5, lambda: f'<a href="/">{word()}</a>' + (f"<p>{word()}</p>" if chance(0.5) else "") + (links(4) if chance(0.3) else "")), ("menu", 0.8, lambda: links(int(rng.integers(3, 9)))),
        ("notice", 0.3, lambda: f"<p>{sentences()}</p>" + ("<button>OK</button>" if chance(0.5) else "")), ("ad", 0.3, lambda: pick([sentences(), f"<p>{sentences()}</p>"])), ("form", 0.2, lambda: f"<label>{word()}</label><input><button>{word()}</button>"),
        ("sidebar", 0.15, lambda: f"<h3>{word()}</h3>" + links(4)),
    ]
    after = [
        ("related", 0.3, lambda: f"<h3>{word()}</h3>" + links(4)), ("sidebar", 0.35, lambda: f"<h3>{word()}</h3>" + (links(5) if chance(0.6) else f"<p>{sentences()}</p>")), ("ad", 0.25, lambda: f"<p>{sentences()}</p>"),
        ("notice", 0.2, lambda: f"<p>{sentences()}</p>"), ("form", 0.15, lambda: f"<p>{sentences()}</p><input><button>{word()}</button>"),
    ]
    parts = [box(r, f()) for r, p, f in before if chance(p)] + [inner] + ([comments()] if chance(0.4) else []) + [box(r, f()) for r, p, f in after if chance(p)]
    if chance(0.8):
        parts.append(box("footer", pick([f"&copy; {word()} {sentences()}", f"<p>&copy; 2020 {word()}</p>" + links(3), links(5)])))
    body = "".join(parts)
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body if chance(0.6) else f'<div id=page>{body}</div>'}</body></html>"


def training_forest(sources: list[str], laid_out: int, seed: int = 11) -> tuple[Forest, np.ndarray]:
    """Labelled pages: those of ``sources`` with landmarks, and ``laid_out`` ones made of the sources' own texts."""
    pages, labels, texts, shorts = [], [], [], []
    for source in sources:
        page = Page(source.replace(MARK, ""))
        own = landmark_labels(page)
        if own is not None:
            pages.append(page)
            labels.extend(own)
        for text, linked, content in zip(page.text, page.linked, own or [True] * len(page.text)):
            text = " ".join(text.split())
            (texts if content and len(text) >= 60 else shorts).append(text[:2000] if content else text[:60])
    texts = texts or list(_SENTENCES)
    rng = np.random.default_rng(seed)
    for _ in range(laid_out):
        page = Page(lay_out(rng, texts, shorts))
        labels.extend(MARK in t for t in page.text)
        page.text = [t.replace(MARK, "") for t in page.text]
        pages.append(page)
    return Forest(pages), np.array(labels, bool)


def learn(pages: DataFrame, text_col: str = "html", sample_pages: int = 256, sample_chars: int = 65_536, laid_out: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The model, fitted on a bounded sample: at most ``sample_pages`` pages of at most ``sample_chars`` characters,
    the first by hash, those with an article or main element before others.

    Fitted in one task; the driver gets the weights alone.
    """
    marked = F.lower(text_col).rlike(r"<(article|main)[\s>]")
    sample = (pages.select(F.col(text_col).cast("string").alias("html")).where(F.length("html").between(1, sample_chars))
              .orderBy(marked.desc(), F.xxhash64("html"), "html").limit(sample_pages).select("html"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = [s for b in batches for s in b.column("html").to_pylist()]
        weights, tables = fit(*training_forest(sources, laid_out))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()]), pa.array([tables.ravel().tolist()])], ["weights", "tables"])

    rows = sample.repartition(1).mapInArrow(task, "weights array<double>, tables array<double>").collect()
    if not rows:  # an empty sample is an empty partition, which runs no task
        return fit(*training_forest([], laid_out))
    return np.array(rows[0]["weights"]), np.array(rows[0]["tables"]).reshape(EDGES, 2, 2)


def content_marginals(forest: Forest, weights: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """P(content) of each leaf."""
    return sum_product(forest, features(forest) @ weights, tables)[0][forest.leaf]


def main_texts(sources: list[str], weights: np.ndarray, tables: np.ndarray, most_nodes: int = 20_000) -> tuple[list[str], list[float]]:
    """Each page's main text and the least certain of its leaves' decisions; pages are taken together up to ``most_nodes``."""
    texts, sure, group, nodes = [], [], [], 0

    def flush() -> None:
        nonlocal nodes
        at, chosen = 0, content_marginals(Forest(group), weights, tables) if any(p.leaf for p in group) else np.zeros(0)
        for page in group:
            own = chosen[at : at + len(page.leaf)]
            at += len(page.leaf)
            texts.append(joined(page.text, page.breaks, (own >= 0.5).tolist()))
            sure.append(float(np.abs(2 * own - 1).min()) if len(own) else 1.0)
        group.clear()
        nodes = 0

    for source in sources:
        group.append(Page(source))
        nodes += len(group[-1].parent)
        if nodes >= most_nodes:
            flush()
    if group:
        flush()
    return texts, sure


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, text_col: str = "html", out_col: str = "text") -> DataFrame:
    """The pages' columns but ``text_col``, with their main text, its length in code points and the least certainty.

    Adds ``out_col`` (empty if a page has no main text; null or empty pages have none), ``n_chars`` and ``certainty``
    (0 to 1, |2P - 1| of the least certain run of text). Columns of the input by these names are left out. Rows are neither
    dropped nor joined: repeated rows and null keys stay. Whole pages are read, however long; an
    unended comment or script reaches to the page's end, as in browsers. An empty table gives an empty result.

    A page becomes a tree of its blocks and runs of text. Each node has a potential from what it is called, its
    kind, and the length, links and place of its text; each parent-child edge has a table by the child's kind. Sum-product
    messages upward and downward give each run's marginal probability of being content; runs of a half or more stay.
    ``model`` is what ``learn`` returns, fitted on the same pages by default.
    """
    weights, tables = model or learn(pages, text_col)
    others = [c for c in pages.columns if c.lower() not in {text_col.lower(), out_col.lower(), "n_chars", "certainty"}]
    inner = pages.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row") if others else F.struct(F.lit(0).alias("_")).alias("row"), F.col(text_col).cast("string").alias("html"))
    kept = inner.schema["row"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(iter([batch]), "html"):
                texts, sure = main_texts(pc.fill_null(piece.column("html"), "").to_pylist(), weights, tables)
                texts = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([piece.column("row"), texts, pc.utf8_length(texts).cast(pa.int64()), pa.array(sure, pa.float64())], ["row", "text", "n_chars", "certainty"])

    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    schema = StructType().add("row", kept).add("text", StringType()).add("n_chars", LongType()).add("certainty", DoubleType())
    out = inner.mapInArrow(task, schema)
    keep: list[Column] = [F.col(f"row.`{c}`").alias(c) for c in others]
    return out.select(*keep, F.col("text").alias(out_col), "n_chars", "certainty")
