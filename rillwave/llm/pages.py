"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, in page order. Each block becomes a vector: the
mean of learnt embeddings of its hashed tag path (tags with their class, id and role words), the mean of learnt
embeddings of its hashed words, and a few numbers. A bidirectional LSTM in NumPy reads all blocks of the page and labels
each as main text or not, so every decision sees the whole document.

The labeller is trained here: on at most `SAMPLE` pages (the least hashes of page_id), whose blocks are labelled by the
meaning of their containers, and on variants of these pages in which containers are renamed and further ones (menus,
sidebars, notices, forms, comments, ...) are put in. The sample's bound is the parameter `SAMPLE`; the texts of all
pages are read whole and decided by the network alone.

The labels come from container names (`teacher`), so what the network can learn is how such names, their words and their
neighbourhood go together; a page without any telling name is decided by words, links and neighbours alone.

Which rule holds for markup: `<br>` ends a line, so the parts are joined by one line end; an unclosed `<script>`, `<style>`,
`<title>`, `<template>`, `<textarea>`, `<iframe>`, `<noframes>` or `<noembed>` takes the rest of the page, as in browsers,
an unclosed `<object>`, `<svg>`, `<math>` or `<button>` does not; formulas and fallback texts are read.

Defined cases: null or empty html has an empty text; unclosed, misnested and cut-off markup is read as far as it goes;
pages that repeat are read alike; without any page to learn from the text is empty; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import table
from rillwave.llm.shingles import word_hashes

SAMPLE = 300
PATH_SLOTS, WORD_SLOTS, PATH_SIZE, WORD_SIZE, HIDDEN = 1024, 64, 16, 4, 12
NUMBERS = 4
EPOCHS, STEP = 5, 0.04
#: Blocks of one batch (with padding).
BATCH = 8192

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BREAKS = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold one line of running text; an unknown element inside is part of it, elsewhere it is a block.
LINES = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th".split())
#: Known elements that neither begin nor end a block.
KNOWN = INLINE | VOID | frozenset("acronym applet audio button canvas datalist iframe map math meter nobr noembed noframes noscript object optgroup option output picture progress rb rp rt rtc ruby script select slot style svg template textarea title video xmp".split())
#: Elements whose inside is no text of the page; an unclosed one takes the rest, as in browsers.
UNREAD = frozenset("script style template textarea title iframe noframes noembed".split())
#: Controls and drawings stand beside the text around them: blocks of their own that do not cut it.
BESIDE = frozenset("button select svg".split())
FOREIGN = frozenset("math svg".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: A tag. A quoted value may hold ">"; a quote that nothing closes, or that follows no "=", is an ordinary character.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in UNREAD}
NAMES = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[a-z]+")
#: Path tokens of one element, and outermost and innermost elements of a path, that the labeller sees. No text depends on them.
NAMED, DEPTH = 64, 48


class Path(list):
    """Open elements as (tag, path tokens, place of the paragraph that a block would close or -1, inside a line)."""

    def __init__(self):
        super().__init__()
        self.count: dict[str, int] = {}
        self.beside = self.foreign = 0              # open elements of BESIDE and FOREIGN

    def push(self, tag: str, names: list[str]):
        _, _, paragraph, line = self[-1] if self else ("", (), -1, False)
        paragraph = len(self) if tag == "p" else paragraph if tag in INLINE else -1
        self.append((tag, names, paragraph, tag in LINES or line and tag not in BREAKS))
        self._counted(tag, 1)

    def _counted(self, tag: str, by: int):
        self.count[tag] = self.count.get(tag, 0) + by
        self.beside += by * (tag in BESIDE)
        self.foreign += by * (tag in FOREIGN)

    def cut(self, at: int):
        """Close the element at this place and all inside."""
        for tag, *_ in self[at:]:
            self._counted(tag, -1)
        del self[at:]

    def close(self, tag: str):
        if self.count.get(tag):
            at = len(self) - 1
            while self[at][0] != tag:
                at -= 1
            self.cut(at)

    def tokens(self) -> tuple[str, ...]:
        seen = self if len(self) <= 2 * DEPTH else self[:DEPTH] + self[-DEPTH:]
        return tuple(t for _, names, *_ in seen for t in names)


class Block:
    """Text of a leaf as it is read."""

    def __init__(self):
        self.text: list[str] = []
        self.linked, self.path = 0, ()

    def add(self, piece: str, path: Path):
        if not self.text:
            if piece.isspace():
                return
            self.path = path.tokens()
        self.text.append(html.unescape(piece) if "&" in piece else piece)
        if path.count.get("a"):
            self.linked += len(self.text[-1])

    def leaf(self):
        joined = "".join(self.text)
        whole = " ".join(joined.split())
        return [(self.path, whole, min(1.0, self.linked / len(joined)))] if whole else []


def leaves(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path as name tokens, text, share of linked characters) of each leaf block, in time linear in the page.

    A block ends where a block-level element begins or ends, and at `<br>`; images, scripts, formulas, controls, drawings
    and unknown elements inside a line do not end it. Text of a control or drawing is a leaf of its own behind the block it
    stands in. A "<" that begins no whole tag is text.
    """
    out, path, block, beside = [], Path(), Block(), Block()
    at, n, last, tags = 0, len(page), page.rfind(">"), TAG

    def flush():
        nonlocal block, beside
        if block.text or beside.text:
            out.extend(block.leaf() + beside.leaf())
            block, beside = Block(), Block()

    def read(start: int, end: int):
        if end > start:
            (beside if path.beside else block).add(page[start:end], path)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            read(at, n)
            break
        if page.startswith("<!--", start):
            read(at, start)
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else n
            continue
        if start > last:                        # no tag ends any more, a comment may still begin
            cut = page.find("<!--", start)
            read(at, cut if cut >= 0 else n)
            break
        if page[start + 1] in "!?":
            read(at, start)
            at = page.find(">", start) + 1
            continue
        m = tags.match(page, start)
        if m is None and (page[start + 1].isalpha() or page[start + 1] == "/"):
            m = LOOSE.match(page, start)
            if m:                               # a quoted value goes on to the end: quotes do not count from here on
                tags = LOOSE
        if m is None:
            read(at, start + 1)
            at = start + 1
            continue
        read(at, start)
        at, tag = m.end(), m[2].lower()
        if tag in BREAKS or tag not in KNOWN and not path.foreign and not (path and path[-1][3]):
            flush()
        if m[1]:
            path.close(tag)
        elif tag in UNREAD:
            if not (m[3].endswith("/") and path.foreign):
                end = ENDS[tag].search(page, at)
                at = page.find(">", end.end()) + 1 if end else 0
                at = at or n
        elif tag not in VOID:
            if path.foreign:
                if m[3].endswith("/"):
                    continue
                if tag in BREAKS and not path.count.get("foreignobject"):     # no such element can stand in a drawing
                    while path.foreign:
                        path.cut(len(path) - 1)
            elif tag in FOREIGN and m[3].endswith("/"):
                continue
            if tag in CLOSES_P and path and path[-1][2] >= 0:
                path.cut(path[-1][2])
            names = [tag]
            for a in NAMES.finditer(m[3]) if m[3] else ():
                names += [f"{a[1].lower()}={w}" for w in PART.findall((a[2] or a[3] or a[4] or a[1]).lower())]
            path.push(tag, names[:NAMED])
    flush()
    return out


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % size


class Features:
    """Hashed tokens and numbers of a page's leaves; remembers the slots of tag paths."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def __call__(self, blocks) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Slots of each leaf's path; slots of all words and the number of words per leaf; numbers per leaf."""
        paths, numbers = [], np.zeros((len(blocks), NUMBERS), np.float32)
        for i, (path, text, linked) in enumerate(blocks):
            if path not in self.paths:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                self.paths[path] = np.array(sorted({_slot(t, PATH_SLOTS) for t in path}) or [0])
            paths.append(self.paths[path])
            n = text.count(" ") + 1
            numbers[i] = (len(text), linked, n, text.count("."))
        numbers[:, 3] /= np.maximum(numbers[:, 2], 1)
        numbers[:, [0, 2]] = np.log1p(numbers[:, [0, 2]]) / 8
        words = word_hashes("\n".join([text for _, text, _ in blocks]).encode("utf-8", "replace"))
        return paths, ((words % np.uint64(WORD_SLOTS)).astype(np.int64), np.array([t.count(" ") + 1 for _, t, _ in blocks], np.int64)), numbers


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, a bidirectional LSTM, and a logistic output; trained with Adam."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + NUMBERS
        init = lambda *s: rng.standard_normal(s).astype(np.float32) / np.sqrt(s[0])
        self.p = {"path": rng.standard_normal((PATH_SLOTS, PATH_SIZE)).astype(np.float32) * 0.1,
                  "word": rng.standard_normal((WORD_SLOTS, WORD_SIZE)).astype(np.float32) * 0.1,
                  "out": init(2 * HIDDEN + size, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(size, 4 * HIDDEN), f"h{d}": init(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN:2 * HIDDEN] = 1                  # forget gates start open

    @staticmethod
    def _joined(pages) -> tuple:
        """Blocks of several pages one after another, and their places in a page x time grid."""
        lens = np.array([len(n) for _, _, n in pages])
        grid = np.arange(lens.max())[None, :] < lens[:, None]
        paths = [x for p, _, _ in pages for x in p]
        seg = np.repeat(np.arange(len(paths)), [len(x) for x in paths])
        words = tuple(np.concatenate([w[j] for _, w, _ in pages]) for j in (0, 1))
        return lens, grid, np.concatenate(paths), seg, words, np.concatenate([n for _, _, n in pages])

    def _walk(self, x, grid, d):
        """One direction over time; padding leaves the state as it is."""
        p, (b, t, _) = self.p, x.shape
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        xs = x @ p[f"x{d}"] + p[f"c{d}"]
        steps, hs = [], np.zeros((b, t, HIDDEN), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = xs[:, k] + h @ p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, j * HIDDEN:(j + 1) * HIDDEN]) for j in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            new = f * c + i * g
            live = grid[:, k, None]
            steps.append((k, h, c, i, f, o, g, new, live))
            c = np.where(live, new, c)
            h = np.where(live, o * np.tanh(new), h)
            hs[:, k] = h
        return hs, steps

    def forward(self, pages):
        lens, grid, slots, seg, words, numbers = self._joined(pages)
        p, n = self.p, len(numbers)
        per = np.bincount(seg, minlength=n).astype(np.float32)[:, None]
        first = np.concatenate([[0], np.cumsum(per[:-1, 0]).astype(int)])
        spoken, count = words
        begin = np.cumsum(count) - count
        flat = np.concatenate([np.add.reduceat(p["path"][slots], first, axis=0) / np.sqrt(per),
                               np.add.reduceat(p["word"][spoken], begin, axis=0) / count[:, None], numbers], axis=1).astype(np.float32)
        x = np.zeros((*grid.shape, flat.shape[1]), np.float32)
        x[grid] = flat
        (hf, sf), (hb, sb) = self._walk(x, grid, "f"), self._walk(x, grid, "b")
        full = np.concatenate([hf, hb, x], axis=2)[grid]
        y = _sigmoid(full @ p["out"] + p["bias"])[:, 0]
        return y, (grid, slots, seg, per, words, x, sf, sb, full)

    def gradients(self, pages, labels):
        y, (grid, slots, seg, per, words, x, sf, sb, full) = self.forward(pages)
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        dy = ((y - labels) / len(y)).astype(np.float32)[:, None]
        g["out"], g["bias"] = full.T @ dy, dy.sum(0)
        dfull = np.zeros((*grid.shape, full.shape[1]), np.float32)
        dfull[grid] = dy @ p["out"].T
        dx = dfull[:, :, 2 * HIDDEN:].copy()
        for d, steps, part in (("f", sf, dfull[:, :, :HIDDEN]), ("b", sb, dfull[:, :, HIDDEN:2 * HIDDEN])):
            dh, dc = np.zeros(part[:, 0].shape, np.float32), np.zeros(part[:, 0].shape, np.float32)
            for k, h, c, i, f, o, a, new, live in reversed(steps):
                dh = dh + part[:, k]
                t = np.tanh(new)
                dn = np.where(live, dc + dh * o * (1 - t * t), 0)
                dz = np.concatenate([dn * a * i * (1 - i), dn * c * f * (1 - f), np.where(live, dh, 0) * t * o * (1 - o), dn * i * (1 - a * a)], axis=1)
                g[f"x{d}"] += x[:, k].T @ dz
                g[f"h{d}"] += h.T @ dz
                g[f"c{d}"] += dz.sum(0)
                dx[:, k] += dz @ p[f"x{d}"].T
                dh = np.where(live, dz @ p[f"h{d}"].T, dh)
                dc = np.where(live, dn * f, dc)
        flat = dx[grid]
        np.add.at(g["path"], slots, (flat[:, :PATH_SIZE] / np.sqrt(per))[seg])
        spoken, count = words
        np.add.at(g["word"], spoken, np.repeat(flat[:, PATH_SIZE:PATH_SIZE + WORD_SIZE] / count[:, None], count, axis=0))
        return y, g

    def train(self, pages, labels, epochs: int = EPOCHS, seed: int = 3):
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        t = 0
        order = np.array(sorted(range(len(pages)), key=lambda i: len(labels[i])))
        for epoch in range(epochs):
            rate = STEP * (1 - epoch / (epochs + 1))
            for some in rng.permutation(len(order) // 16 + 1):
                some = order[16 * some:16 * some + 16]
                if not len(some):
                    continue
                t += 1
                _, g = self.gradients([pages[i] for i in some], np.concatenate([labels[i] for i in some]))
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-7)
        return self

    def label(self, pages) -> list[np.ndarray]:
        """Probabilities of main text per page; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        todo = sorted((i for i in range(len(pages)) if len(pages[i][2])), key=lambda i: len(pages[i][2]))
        while todo:
            n = 1
            while n < len(todo) and (n + 1) * len(pages[todo[n]][2]) <= BATCH:
                n += 1
            some, todo = todo[:n], todo[n:]
            y, at = self.forward([pages[i] for i in some])[0], 0
            for i in some:
                out[i] = y[at:at + len(pages[i][2])]
                at += len(pages[i][2])
        return out


#: Words of container names, as web authors use them: what is not main text, and what is.
ASIDE = ("nav header footer aside form menu button select dialog role=navigation role=banner role=contentinfo role=search "
         "role=complementary role=dialog hidden=hidden").split()
ASIDE_NAMES = ("ad ads advert advertisement sponsored promo promotion banner menu navbar navigation breadcrumb breadcrumbs "
               "sidebar widget related recommended share sharing social comment comments reply replies discussion respond "
               "cookie cookies consent notice notices alert popup modal newsletter subscribe signup login search footer "
               "header masthead topbar toolbar copyright legal disclaimer tags pagination pager").split()
#: What such names are often joined with.
AROUND = ["", "", "left-", "right-", "site-", "page-", "top ", "js-", "block ", "x-"]
AFTER = ["", "", "-list", "-box", "-wrapper", "-area", " clearfix", "-inner", " wide", "-section"]
MAIN_NAMES = "article content post entry story body text main articlebody".split()


def teacher(path: tuple[str, ...]) -> float:
    """A training label from the containers' meaning."""
    aside = set(ASIDE) | {f"{a}={w}" for a in ("class", "id") for w in ASIDE_NAMES}
    main = {"article", "main", "role=main", "itemprop=articlebody"} | {f"{a}={w}" for a in ("class", "id") for w in MAIN_NAMES}
    return float(not aside & set(path) and bool(main & set(path)))


def variants(page: str, rng: np.random.Generator, n: int = 6) -> Iterator[str]:
    """The page, and copies with containers renamed and further ones put in before, in and after the main text."""
    yield page
    words = [w for _, text, _ in leaves(page) for w in text.split(" ")][:400] or ["text"]
    some = lambda k: html.escape(" ".join(rng.choice(words, k)))
    for _ in range(n):
        new = page
        if rng.random() < 0.6:
            name = rng.choice(MAIN_NAMES)
            tag = rng.choice(["div", "section", "main", "article"])
            attr = f' {rng.choice(["class", "id"])}="{rng.choice(AROUND)}{name}{rng.choice(AFTER)}"' if tag in ("div", "section") or rng.random() < 0.5 else ""
            new = re.sub(r"<article\b", f"<{tag}{attr}", new).replace("</article>", f"</{tag}>")
        if rng.random() < 0.3:
            new = re.sub(r"<nav>.*?</nav>", "", new, flags=re.S)
        for _ in range(rng.integers(1, 6)):
            tag = rng.choice(["div", "section", "aside", "ul", "form", "header", "footer", "nav", "div", "div"])
            name = f' {rng.choice(["class", "id"])}="{rng.choice(AROUND)}{rng.choice(ASIDE_NAMES)}{rng.choice(AFTER)}"' if tag in ("div", "section", "ul") or rng.random() < 0.5 else ""
            inner = "".join(f"<{t}>{some(int(rng.integers(1, 60)))}</{t}>" for t in rng.choice(["p", "li", "h3", "div", "span", "p", "label"], rng.integers(1, 5)))
            places = [m.end() for m in re.finditer(r"</p>|</h1>|</h2>|<body>|</nav>|</(?:article|main|div|section)>", new)] or [len(new)]
            at = int(rng.choice(places))
            new = f"{new[:at]}<{tag}{name}>{inner}</{tag}>{new[at:]}"
        for _ in range(rng.integers(0, 4)):
            at = int(rng.choice([m.start() for m in re.finditer("</p>", new)] or [-1]))
            kinds = rng.choice(["h2", "h3", "ul", "blockquote", "table", "pre", "figure", "p", "p"])
            body = {"ul": f"<li>{some(9)}</li><li>{some(4)}</li>", "table": f"<tr><td>{some(3)}</td><td>{some(5)}</td></tr>",
                    "figure": f"<figcaption>{some(8)}</figcaption>"}.get(str(kinds), some(int(rng.integers(1, 12))))
            new = new if at < 0 else f"{new[:at + 4]}<{kinds}>{body}</{kinds}>{new[at + 4:]}"
        yield new


def sampled(pages: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Texts of the `sample` pages whose page_id hashes least; of an id's rows the one whose html hashes least.

    Ids are chosen first, so no task sends a page that is not in the sample.
    """
    read = pages.where(F.col("html").isNotNull())
    ids = [r[0] for r in read.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    here = F.col("page_id").isin([i for i in ids if i is not None])
    rows = (read.where(here | F.col("page_id").isNull() if None in ids else here)
            .groupBy("page_id").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("html")).collect())
    by = {r.page_id: r.html for r in rows}
    return [by[i] for i in ids]


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller | None:
    """Train on the pages of `sampled`; the sample is all that reaches the driver."""
    held = sampled(pages, sample)
    rng, features, xs, ys = np.random.default_rng(17), Features(), [], []
    for page in held:
        for one in variants(page, rng):
            blocks = leaves(one)
            if blocks:
                xs.append(features(blocks))
                ys.append(np.array([teacher(p) for p, _, _ in blocks], np.float32))
    return Labeller().train(xs, ys) if xs else None


def extracted(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)       # the network's size is fixed

    def run(batches):
        features, net = Features(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                blocks = [leaves(x or "") for x in some["html"].to_pylist()]
                kept = net.label([features(b) for b in blocks]) if net else [np.zeros(len(b)) for b in blocks]
                text = ["\n".join(t for (_, t, _), y in zip(b, k) if y > 0.5) for b, k in zip(blocks, kept)]
                text = [t.encode("utf-8", "replace").decode() for t in text]
                yield pa.RecordBatch.from_arrays([some["page_id"].cast(pa.int64()), some["url"].cast(pa.string()), pa.array(text, pa.string()),
                                                  pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op3_main_text(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, fit(pages))
