"""Main text of web pages by a recurrent block labeller (operator 4).

A page is a sequence of leaf blocks: runs of text between block-level tags, each with the path of open elements
(names, classes, ids) above it. A bidirectional LSTM in numpy reads, for each block, a hashed multi-hot vector of its path,
a hashed bag of its words and a few measures, so each decision sees the whole page. It is trained on generated pages of
many layouts, and on at most ``train_pages`` of the given pages whose containers say what they are (article, nav, ...); the
names in paths are dropped at random there, so that words, order and neighbours must tell too.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

TRAIN_PAGES = 200
GENERATED_PAGES = 500
#: Pages of more characters or blocks than these don't train; all are extracted.
TRAIN_CHARS = 200_000
TRAIN_BLOCKS = 400
EPOCHS = 6
HIDDEN = 12
#: Blocks of the pages that are read together, padding included; a longer page is read by itself.
PADDED_BLOCKS = 20_000
PATH_DIM = 192
WORD_DIM = 48
DENSE_DIM = 12
INPUT_DIM = PATH_DIM + WORD_DIM + DENSE_DIM

# HTML's own sets (fixed values of the standard)
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text no reader sees or that are parts of forms.
SILENT_TAGS = {"select", "button", "template", "datalist"}
#: What opening one of these closes, if still open.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"},
}
CLOSES |= {t: {"p"} for t in BLOCK_TAGS - {"body", "head", "html", "li", "dt", "dd", "tr", "td", "th", "option", "tbody", "caption", "title"}}

# script, style, textarea, title and iframe hold raw text up to their end tags; all other elements are ordinary
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


#: Ends each leaf of main text in generated pages.
MARK = "\ue000"


class Node:
    """An open element: its names, the element above it, and the hashed names of all elements down to it."""

    __slots__ = ("tag", "names", "above", "bits")

    def __init__(self, tag: str, names: tuple[str, ...], above: Node | None) -> None:
        self.tag, self.names, self.above = tag, names, above
        self.bits = above.bits if above else 0
        for n in names:
            self.bits |= 1 << _hash(n, PATH_DIM)


class Block:
    """A leaf: its text, the element it stands in, and what share of it is in links."""

    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node | None, linked: float) -> None:
        self.text, self.node, self.linked = text, node, linked

    @property
    def tag(self) -> str:
        return self.node.tag if self.node else ""

    @property
    def tags(self) -> tuple[str, ...]:
        """The tags of the elements around it, from the outermost."""
        return tuple(n.tag for n in self.upwards())[::-1]

    def upwards(self) -> Iterator[Node]:
        """The elements around it, from the innermost."""
        node = self.node
        while node:
            yield node
            node = node.above


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order. White space is one space, character references are decoded, empty blocks left out.

    Time and memory are linear in the page, however deep it nests.
    """
    out: list[Block] = []
    stack: list[Node] = []
    open_: dict[str, int] = {}
    parts: list[str] = []
    links = all_ = silent = 0

    def pop() -> str:
        nonlocal silent
        tag = stack.pop().tag
        open_[tag] -= 1
        silent -= tag in SILENT_TAGS
        return tag

    def flush() -> None:
        nonlocal links, all_
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, stack[-1] if stack else None, links / max(1, all_)))
        parts.clear()
        links = all_ = 0

    def take(text: str) -> None:
        nonlocal links, all_
        if text and not silent:
            parts.append(text)
            size = len(text.strip())
            all_ += size
            if open_.get("a"):
                links += size

    page = page or ""
    at = 0
    for m in _TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if open_.get(tag):
                if tag in BLOCK_TAGS:
                    flush()
                while pop() != tag:
                    pass
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK_TAGS:
            flush()
            shut = CLOSES.get(tag, ())
            if any(open_.get(t) for t in shut):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in shut:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag in BLOCK_TAGS and stack[i].tag != "p":
                        break
        closed = m[4] and m[4].endswith("/") and tag not in BLOCK_TAGS  # as in <svg/> or <math/>
        if tag not in VOID_TAGS and not closed:
            names = [tag]
            if m[4]:
                for x in _NAMES.findall(m[4].lower()):
                    names += [f".{w}" for w in _PARTS.findall("".join(x))]
            stack.append(Node(tag, tuple(names), stack[-1] if stack else None))
            open_[tag] = open_.get(tag, 0) + 1
            silent += tag in SILENT_TAGS
    rest = page[at:]
    cut = rest.rfind("<")
    take(rest[:cut] if cut >= 0 and ">" not in rest[cut:] and re.match(r"<[/a-zA-Z!]", rest[cut:]) else rest)  # a tag cut off at the end
    flush()
    return out


# ---------------------------------------------------------------- features
def _hash(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


class Features:
    def __init__(self) -> None:
        self._path: dict[int, np.ndarray] = {}
        self._word: dict[str, int] = {}

    def _ones(self, bits: int) -> np.ndarray:
        found = self._path.get(bits)
        if found is None:
            found = self._path[bits] = np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(PATH_DIM // 8, "little"), np.uint8), bitorder="little"))
        return found

    def __call__(self, blocks: list[Block], drop: np.random.Generator | None = None) -> np.ndarray:
        x = np.zeros((len(blocks), INPUT_DIM), np.float32)
        total = max(1, len(blocks))
        if len(self._path) > 20_000 or len(self._word) > 200_000:
            self._path.clear()
            self._word.clear()
        for i, b in enumerate(blocks):
            bits = b.node.bits if b.node else 0
            if drop is not None and drop.random() < 0.15:
                bits = 0
                for node in b.upwards():
                    for n in node.names:
                        bits |= (drop.random() > 0.4) << _hash(n, PATH_DIM)
            x[i, self._ones(bits)] = 1
            words = b.text.split()
            known = self._word
            ids = []
            for w in words:
                h = known.get(w)
                if h is None:
                    h = _hash(w.lower(), WORD_DIM)
                    if len(w) <= 64:  # so that what is remembered is bounded in bytes
                        known[w] = h
                ids.append(h)
            n = len(words)
            x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(ids, minlength=WORD_DIM) / n
            t = b.text
            x[i, PATH_DIM + WORD_DIM :] = (
                np.log1p(n) / 5, b.linked, i / total, t.count(".") / n, t.count(",") / n, t[-1] in ".!?…", t[0].isupper(),
                b.tag == "li", b.tag == "p", re.fullmatch("h[1-6]", b.tag) is not None,
                n < 5, "©" in t,
            )
        return x


# ---------------------------------------------------------------- network
def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init_params(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.15, (INPUT_DIM, 4 * HIDDEN)).astype(np.float32)
        p[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
        p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
    p["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
    p["ob"] = np.zeros(1, np.float32)
    return p


def _run(p: dict, d: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """LSTM over axis 1 of x (batch, time, input); masked steps pass the state on. Returns outputs and a tape."""
    n, steps, _ = x.shape
    pre = x @ p[f"x{d}"] + p[f"c{d}"]
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out, tape = np.zeros((n, steps, HIDDEN), np.float32), []
    for t in range(steps):
        z = pre[:, t] + h @ p[f"h{d}"]
        g = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        u = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * u
        th = np.tanh(c2)
        m = mask[:, t, None]
        if keep:
            tape.append((h, c, i, f, o, u, th, m))
        h, c = m * (o * th) + (1 - m) * h, m * c2 + (1 - m) * c
        out[:, t] = h
    return out, tape


def _back(p: dict, d: str, x: np.ndarray, tape: list, dout: np.ndarray, grad: dict) -> None:
    n = len(x)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dz_all = np.zeros((n, x.shape[1], 4 * HIDDEN), np.float32)
    for t in range(x.shape[1] - 1, -1, -1):
        h, c, i, f, o, u, th, m = tape[t]
        dh = dh + dout[:, t]
        dn, dcn = m * dh, m * dc
        dct = dcn + dn * o * (1 - th * th)
        dz = np.concatenate([dct * u * i * (1 - i), dct * c * f * (1 - f), dn * th * o * (1 - o), dct * i * (1 - u * u)], axis=1)
        dz_all[:, t] = dz
        grad[f"h{d}"] += h.T @ dz
        dh = (1 - m) * dh + dz @ p[f"h{d}"].T
        dc = (1 - m) * dc + dct * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    grad[f"x{d}"] += x.reshape(-1, x.shape[2]).T @ flat
    grad[f"c{d}"] += flat.sum(axis=0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, INPUT_DIM), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, f in enumerate(pages):
        x[i, : len(f)], mask[i, : len(f)] = f, 1
    return x, mask


def logits(p: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    forth, _ = _run(p, "f", x, mask)
    back, _ = _run(p, "b", x[:, ::-1], mask[:, ::-1])
    return np.concatenate([forth, back[:, ::-1]], axis=2) @ p["o"] + p["ob"]


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.02, seed: int = 4) -> dict:
    """Adam on cross-entropy per block. ``pages``: (features, 0/1 per block)."""
    p, rng = init_params(), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            own = [pages[i] for i in groups[g]]
            x, mask = _padded([f for f, _ in own])
            y = np.zeros_like(mask)
            for i, (_, lab) in enumerate(own):
                y[i, : len(lab)] = lab
            forth, tf = _run(p, "f", x, mask, True)
            xb, mb = x[:, ::-1], mask[:, ::-1]
            back, tb = _run(p, "b", xb, mb, True)
            both = np.concatenate([forth, back[:, ::-1]], axis=2)
            e = (_sigmoid(both @ p["o"] + p["ob"]) - y) * mask / mask.sum()
            grad = {k: np.zeros_like(a) for k, a in p.items()}
            grad["o"], grad["ob"] = np.einsum("nt,nth->h", e, both), np.array([e.sum()], np.float32)
            d = e[:, :, None] * p["o"]
            _back(p, "f", x, tf, d[:, :, :HIDDEN], grad)
            _back(p, "b", xb, tb, d[:, ::-1, HIDDEN:], grad)
            step += 1
            size = np.sqrt(sum(float((a * a).sum()) for a in grad.values()))
            clip = min(1.0, 1.0 / max(size, 1e-9))
            lr = rate * (1 - 0.8 * epoch / epochs)
            for k, a in grad.items():
                a = a * clip
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


# ---------------------------------------------------------------- training pages
_MAIN = {"article", "main"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_ASIDE_NAMES = set(
    "nav menu header footer sidebar aside ad ads advert advertisement sponsor promo banner cookie consent notice popup modal comment comments "
    "disqus reply related share social breadcrumb breadcrumbs newsletter subscribe login search widget pagination tags copyright".split()
)
_MAIN_NAMES = set("article content post entry story main body text".split())


def weak_label(b: Block) -> int | None:
    """1 or 0 where the containers tell: the innermost telling one decides; None otherwise."""
    told = None
    for node in b.upwards():
        if node.tag == "head":
            return 0
        for n in reversed(node.names) if told is None else ():
            name = n.lstrip(".")
            if n in _ASIDE or (n[0] == "." and name in _ASIDE_NAMES):
                told = 0
            elif n in _MAIN or (n[0] == "." and name in _MAIN_NAMES):
                told = 1
            if told is not None:
                break
    return told


def generated_page(rng: np.random.Generator) -> str:
    """A page of an invented layout in invented words. Every leaf of main text ends in the mark U+E000."""
    rnd = random.Random(int(rng.integers(1 << 40)))
    syllables = ["an", "ti", "or", "le", "mu", "sa", "ke", "rin", "do", "ve", "pla", "qui", "ost", "ar", "ne", "lu", "sch", "on"]

    def words(n: int) -> str:
        return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(n))

    def sentence(n: int) -> str:
        return words(max(1, n)).capitalize() + rnd.choice("................!? ").strip()

    def pick(*names: str) -> str:
        return rnd.choice(names)

    def box(tag: str, names: str, inner: str) -> str:
        attr = f' {pick("class", "id")}="{names}"' if names and rng.random() < 0.85 else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1)}">{words(rng.integers(1, 4)).capitalize()}</a></li>' for _ in range(n)) + "</ul>"

    def comment() -> str:
        return box("div", "comment", f"<p><b>{words(2)}</b> {sentence(rng.integers(3, 30))}</p>" + ("<a href='#'>Reply</a>" if rng.random() < 0.5 else ""))

    mark = MARK
    main = [box(pick("h1", "h1", "h2"), pick("", "title", "headline"), sentence(rng.integers(2, 12)) + mark)]
    for _ in range(rng.integers(1, 14)):
        kind = rng.random()
        text = sentence(rng.integers(1, 90)) + mark
        if kind < 0.7:
            main.append(pick(f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"))
        elif kind < 0.78:
            main.append(box(pick("h2", "h3"), "", sentence(rng.integers(1, 7)) + mark))
        elif kind < 0.86:
            main.append("<ul>" + "".join(f"<li>{sentence(rng.integers(2, 20))}{mark}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
        elif kind < 0.92:
            main.append(f"<blockquote>{text}</blockquote>")
        elif kind < 0.96:
            main.append("<table>" + "".join(f"<tr><td>{words(2)}{mark}</td><td>{words(3)}{mark}</td></tr>" for _ in range(2)) + "</table>")
        else:
            main.append(box("div", pick("ad", "advert", "promo", "related", "share"), sentence(rng.integers(2, 15))))
    body = box(pick("article", "article", "main", "div", "section"), pick("", "content", "post", "article", "entry-content", "story main"), "".join(main))
    top, bottom = [], []
    if rng.random() < 0.85:
        top.append(box(pick("nav", "nav", "div"), pick("nav", "menu", "navbar"), links(rng.integers(3, 9))))
    for p, where, made in (
        (0.3, top, box(pick("header", "div"), pick("header", "site-header", "masthead"), f"<a href='/'>{words(2)}</a><p>{sentence(rng.integers(2, 9))}</p>")),
        (0.6, top, box("div", pick("ad", "ads", "advertisement", "banner", "sponsor"), sentence(rng.integers(3, 15)))),
        (0.3, top, box("div", pick("cookie-notice", "consent", "notice", "popup"), f"<p>{sentence(rng.integers(5, 30))}</p><button>OK</button>")),
        (0.1, top, f"<noscript>{sentence(rng.integers(3, 15))}</noscript>"),
        (0.3, top, box("div", pick("breadcrumb", "breadcrumbs"), f"<a href='/'>{words(1)}</a> &gt; <a href='/x'>{words(1)}</a>")),
        (0.3, bottom, box(pick("aside", "div"), pick("sidebar", "related", "widget"), f"<h3>{words(2)}</h3>" + links(rng.integers(2, 7)) + f"<p>{sentence(rng.integers(2, 25))}</p>")),
        (0.25, top, box(pick("aside", "div"), pick("sidebar", "widget"), f"<h3>{words(2)}</h3><p>{sentence(rng.integers(2, 25))}</p>")),
        (0.3, bottom, box(pick("section", "div"), "comments", "<h3>" + words(1) + "</h3>" + "".join(comment() for _ in range(rng.integers(1, 6))))),
        (0.25, bottom, box("form", pick("newsletter", "subscribe", "search", "login"), f"<label>{words(2)}</label><input><p>{sentence(rng.integers(2, 12))}</p>")),
        (0.85, bottom, box(pick("footer", "footer", "div"), pick("footer", "site-footer", "copyright"), f"&copy; {words(1)}.com &middot; {sentence(rng.integers(2, 12))}")),
    ):
        if rng.random() < p:
            where.append(made)
    return "<!DOCTYPE html><html><head><title>" + words(4) + "</title></head><body>" + "".join(top) + body + "".join(bottom) + ("</body></html>" if rng.random() < 0.9 else "")


def training_set(pages: list[str], generated: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, features, out = np.random.default_rng(seed), Features(), []
    for _ in range(generated):
        blocks = blocks_of(generated_page(rng))
        y = np.array([b.text.endswith(MARK) for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.rstrip(MARK).rstrip() or "x"
        out.append((features(blocks, rng), y))
    for page in pages:
        blocks = blocks_of(page)
        if len(blocks) > TRAIN_BLOCKS:
            continue
        told = [weak_label(b) for b in blocks]
        if blocks and None not in told and 0 < sum(told):
            out.append((features(blocks, rng), np.array(told, np.float32)))
    return out


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, generated: int = GENERATED_PAGES) -> dict:
    """The network's parameters. Reads at most ``train_pages`` pages of ``TRAIN_CHARS`` or fewer (smallest hashes of their ids)."""
    some = pages.where(f"html is not null and length(html) <= {TRAIN_CHARS}").select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id", "html").limit(train_pages)
    return fit(training_set([r["html"] for r in some.collect()], generated))


def extract(pages: DataFrame, params: dict, threshold: float = 0.5, batch: int = 64) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``.

    The text is the blocks labelled main, in page order, joined by one newline; empty for null or empty pages and those
    without main text. Repeated rows are extracted each, null ids and urls stay null, other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(params)  # fixed size
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, features = sent.value, Features()
        for b in batches:
            texts: list[str] = []
            for low in range(0, b.num_rows, 512):
                pages_ = [blocks_of(h.as_py()) for h in b.column("html").slice(low, 512)]
                own: list[str] = [""] * len(pages_)
                order = sorted((i for i, x in enumerate(pages_) if x), key=lambda i: len(pages_[i]))
                at = 0
                while at < len(order):
                    # pages of like length together; long ones by themselves
                    longest, size = len(pages_[order[at]]) + 8, 0
                    while at + size < len(order) and size < batch and len(pages_[order[at + size]]) <= longest and (not size or (size + 1) * longest <= PADDED_BLOCKS):
                        size += 1
                    group = order[at : at + size]
                    at += size
                    x, mask = _padded([features(pages_[i]) for i in group])
                    z = logits(p, x, mask)
                    cut = np.log(threshold / (1 - threshold))
                    for i, row in zip(group, z, strict=True):
                        own[i] = "\n".join(k.text for k, s in zip(pages_[i], row, strict=False) if s > cut)
                texts += own
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
