"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is the chain of its leaf blocks; a block is main text or not. Features of
a block are its ancestors' tags and the parts of their class, id and role names,
and simple properties of its text; two labels follow each other at a learnt
weight. The field is fitted by stochastic gradient steps on exact marginals
(forward-backward) and decoded by Viterbi.

Labelled pages are those of the table that mark their article themselves
(article or main elements); at most TRAIN_PAGES of them, those with the smallest
id hashes. So that the field also reads pages marked up otherwise, every labelled
page is learnt a second time with its blocks set in other common frames: other
containers for the article, and menus, notices, adverts, forms, sidebars and
reader comments around and inside it, filled with texts of the same page.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import drop, store, utf8_list
from quiver.llm.dom import Block, blocks

TRAIN_PAGES = 500            # labelled pages that the fit sees, at most
VARIANTS = 4                 # frames that each of them is learnt in besides its own
BITS = 14
EPOCHS = 6
RATE = 0.3

MAIN_TAGS = frozenset({"article", "main"})
ASIDE_TAGS = frozenset({"nav", "aside", "footer", "header", "form", "dialog", "menu"})
# Names in common use; frames for learning are drawn from them.
MAIN_FRAMES = [("article", ()), ("main", ()), ("div", ("content",)), ("div", ("article", "body")), ("div", ("entry", "content")),
               ("div", ("post",)), ("section", ("story",)), ("div", ("main",)), ("div", ("text",)), ("section", ("article",)),
               ("div", ("post", "body")), ("td", ("content",)), ("div", ("main", "content")), ("div", ())]
OTHER_FRAMES = [("nav", ()), ("header", ()), ("footer", ()), ("aside", ()), ("form", ()), ("div", ("menu",)), ("div", ("nav",)),
                ("div", ("navbar",)), ("div", ("header",)), ("div", ("footer",)), ("div", ("sidebar",)), ("ul", ("menu",)),
                ("div", ("breadcrumb",)), ("div", ("cookie", "notice")), ("div", ("notice",)), ("div", ("banner",)),
                ("div", ("ad",)), ("div", ("ads",)), ("div", ("advert",)), ("div", ("sponsored",)), ("div", ("promo",)),
                ("section", ("related",)), ("div", ("share",)), ("div", ("social",)), ("div", ("newsletter",)),
                ("div", ("login",)), ("div", ("widget",)), ("div", ("copyright",)), ("div", ("popup",)), ("div", ("cookies",)),
                ("div", ("subscribe",)), ("div", ("search",)), ("aside", ("sidebar",)), ("div", ("consent",)),
                ("div", ("advertisement",)), ("ins", ("adsense",)), ("div", ("sponsor",)), ("div", ("toolbar",)), ("div", ("pagination",)),
                ("div", ("teaser",)), ("div", ("signup",)), ("div", ("login", "form")), ("ul", ("links",)), ("div", ("recommended",))]
COMMENT_FRAMES = [("section", ("comments",)), ("div", ("comments",)), ("div", ("comment", "list")), ("ol", ("comments",)),
                  ("div", ("responses",)), ("div", ("discussion",)), ("div", ("comment",)), ("div", ("replies",)),
                  ("div", ("reactions",)), ("div", ("feedback",)), ("section", ("reviews",)), ("div", ("disqus", "thread")), ("ul", ("commentary",))]
BARE = 0.15                  # of the drawn pages have no frame around their article, half of these nothing else either
LINKED, CAPTIONED = 0.04, 0.15   # of the drawn articles' blocks are one link, of the articles have a caption
RUNNING_WORDS = 8            # words of a block of running text, where no page of a table marks its article


# ---------------------------------------------------------------- features

@lru_cache(maxsize=20_000)
def _path_features(path: tuple) -> tuple:
    tags, names = [t for t, _ in path], {n for _, parts in path for n in parts}
    found = {f"t:{t}" for t in tags} | {f"c:{n}" for n in names} | {f"p:{t}" for t in tags[-1:]} | {f"d:{min(len(path), 8)}"}
    found |= {f"c:{n[:-1]}" for n in names if n.endswith("s") and len(n) > 3}
    found |= {f"c5:{n[:5]}" for n in names if len(n) > 5}              # advert, advertisement, adverts
    return tuple(sorted({_number(f) for f in found}))


@lru_cache(maxsize=100_000)
def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def _step(value: int, steps: tuple) -> int:
    return sum(value >= s for s in steps)


def chain_features(page: list[Block]) -> list[tuple]:
    """Feature numbers of every block of a page."""
    found, before = [], None
    for i, block in enumerate(page):
        text = block.text
        words, last = text.count(" ") + 1, text[-1]
        share = min(4, 5 * block.linked // max(1, len(text)))
        stop = last in ".!?…\"'»”"
        found.append(_path_features(block.path) + (
            _number("bias"), _number(f"w:{_step(words, (2, 4, 8, 16, 32, 64))}"), _number(f"l:{share}"), _number(f"s:{stop}"),
            _number(f"ws:{_step(words, (4, 16))}:{stop}"), _number(f"k:{min(3, text.count(','))}"),
            _number(f"m:{'©' in text or '|' in text or '·' in text}"), _number(f"n:{text[0].isdigit()}"),
            _number(f"e:{_step(i, (1, 3, 8))}"), _number(f"z:{_step(len(page) - i, (2, 3, 8))}"),
            _number(f"b:{block.path == before}")))
        before = block.path
    return found


# ---------------------------------------------------------------- the field

class Field:
    """Weights of the block features for the label 1 against 0, and of label pairs and first labels."""

    def __init__(self, weight: np.ndarray, pair: list[float]):
        self.weight, self.pair = weight, pair           # pair: 00, 01, 10, 11, first 0, first 1

    def scores(self, chain: list[tuple]) -> list[float]:
        weight = self.weight
        return [float(weight[list(ids)].sum()) for ids in chain]

    def decode(self, chain: list[tuple]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not chain:
            return []
        p00, p01, p10, p11, f0, f1 = self.pair
        scores = self.scores(chain)
        a, b, back = f0, f1 + scores[0], []
        for s in scores[1:]:
            from0, from1 = a + p00 < b + p10, a + p01 < b + p11
            back.append((from0, from1))
            a, b = max(a + p00, b + p10), max(a + p01, b + p11) + s
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def _add(x: float, y: float) -> float:
    m = max(x, y)
    return m + log(exp(x - m) + exp(y - m))


def _marginals(scores: list[float], pair: list[float]) -> tuple[list[float], list[float]]:
    """Of each block being 1, and the expected number of each label pair and first label."""
    p00, p01, p10, p11, f0, f1 = pair
    n = len(scores)
    forward, backward = [(f0, f1 + scores[0])], [(0.0, 0.0)] * n
    for s in scores[1:]:
        a, b = forward[-1]
        forward.append((_add(a + p00, b + p10), _add(a + p01, b + p11) + s))
    for i in range(n - 2, -1, -1):
        a, b = backward[i + 1]
        b += scores[i + 1]
        backward[i] = (_add(p00 + a, p01 + b), _add(p10 + a, p11 + b))
    total = _add(*forward[-1])
    ones = [exp(f[1] + b[1] - total) for f, b in zip(forward, backward)]
    expected = [0.0] * 4 + [1 - ones[0], ones[0]]
    for i in range(n - 1):
        (a, b), (x, y) = forward[i], backward[i + 1]
        y += scores[i + 1]
        for k, v in enumerate((a + p00 + x, a + p01 + y, b + p10 + x, b + p11 + y)):
            expected[k] += exp(v - total)
    return ones, expected


def fit(chains: list[tuple[list[tuple], list[int]]], epochs: int = EPOCHS) -> Field:
    """Adaptive gradient steps on the log-likelihood, one page at a time; no page gives a field of zeros."""
    weight, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    pair, pair_seen = [0.0] * 6, [1e-6] * 6
    order = random.Random(0)
    for _ in range(epochs):
        order.shuffle(chains)
        for chain, labels in chains:
            field = Field(weight, pair)
            ones, expected = _marginals(field.scores(chain), pair)
            for ids, p, y in zip(chain, ones, labels):
                step = p - y
                if abs(step) > 1e-4:
                    index = list(ids)
                    seen[index] += step * step
                    weight[index] -= RATE * step / np.sqrt(seen[index])
            told = [0.0] * 4 + [1.0 - labels[0], float(labels[0])]
            for x, y in zip(labels, labels[1:]):
                told[2 * x + y] += 1
            for k in range(6):
                step = (expected[k] - told[k]) / len(chain)
                pair_seen[k] += step * step
                pair[k] -= RATE * step / pair_seen[k] ** 0.5
        weight *= 0.999
    return Field(weight, pair)


# ---------------------------------------------------------------- labelled pages

def own_labels(page: list[Block]) -> list[int]:
    """1 for blocks that the page itself marks as article, and not as something beside it."""
    def label(block: Block) -> int:
        tags = [t for t, _ in block.path]
        inside = [i for i, t in enumerate(tags) if t in MAIN_TAGS]
        return int(bool(inside) and not any(t in ASIDE_TAGS for t in tags[inside[0]:]))
    return [label(b) for b in page]


def running_labels(page: list[Block]) -> list[int]:
    """1 for blocks of running text outside of navigation and the like; for tables in which no page marks its article."""
    def label(block: Block) -> int:
        return int(block.text.count(" ") + 1 >= RUNNING_WORDS and 2 * block.linked < len(block.text)
                   and not any(t in ASIDE_TAGS for t, _ in block.path))
    return [label(b) for b in page]


def reframed(page: list[Block], labels: list[int], draw: random.Random) -> tuple[list[Block], list[int]]:
    """The same texts in another frame, with other things around and inside the article."""
    main = [b for b, y in zip(page, labels) if y]
    other = [b for b, y in zip(page, labels) if not y] or [Block((), "…", 0)]
    bare = draw.random() < BARE
    alone = bare and draw.random() < 0.5
    outer = draw.choice([(("html", ()), ("body", ())), ()]) if bare else (("html", ()), ("body", ())) + draw.choice(
        [(), (("div", ("wrapper",)),), (("div", ("container",)), ("div", ())), (("div", ()),)])
    around = () if bare else (draw.choice(MAIN_FRAMES),) + draw.choice([(), (), (("div", ()),), (("section", ()),)])

    def junk(place: tuple, n: int) -> list[tuple[Block, int]]:
        box, found = draw.choice(OTHER_FRAMES), []
        leaf = draw.choice([(), (("p", ()),), (("ul", ()), ("li", ())), (("div", ()),), (("h3", ()),), (("span", box[1]),)])
        for _ in range(n):
            text = draw.choice(other).text if draw.random() < 0.5 else " ".join(draw.choice(main).text.split()[: draw.randint(1, 30)])
            found.append((Block(outer + place + (box,) + leaf, text, len(text) if draw.random() < 0.4 else 0), 0))
        return found

    result = []
    for _ in range(0 if alone else draw.randint(0, 3)):
        result += junk((), draw.randint(1, 5))
    captioned = draw.randint(0, len(main) - 1) if draw.random() < CAPTIONED else None
    for i, block in enumerate(main):
        tail = block.path[-1:] if block.path and block.path[-1][0] not in MAIN_TAGS else ()
        tail = tail if draw.random() < 0.8 else (draw.choice([("blockquote", ()), ("li", ()), ("h2", ()), ("pre", ()), ("td", ()), ("div", ())]),)
        result.append((Block(outer + around + tail, block.text, len(block.text) if draw.random() < LINKED else block.linked), 1))
        if i == captioned or captioned is not None and i + 1 == len(main) and draw.random() < 0.5:
            text = " ".join(draw.choice(main).text.split()[: draw.randint(2, 12)])
            result.append((Block(outer + around + draw.choice([(("figure", ()), ("figcaption", ())), (("figcaption", ()),), (("p", ("caption",)),)]), text, 0), 1))
        if not bare and draw.random() < 0.06:
            result += junk(around, draw.randint(1, 2))
    if not alone and draw.random() < 0.6:
        box, place = draw.choice(COMMENT_FRAMES), around if draw.random() < 0.3 else ()
        leaf = draw.choice([(("p", ()),), (("div", ("comment",)), ("p", ())), (("li", ()),), (("div", ()),)])
        for _ in range(draw.randint(1, 6)):
            result.append((Block(outer + place + (box,) + leaf, draw.choice(main).text, 0), 0))
    for _ in range(0 if alone else draw.randint(1, 3)):
        result += junk((), draw.randint(1, 4))
    return [b for b, _ in result], [y for _, y in result]


def _fit_in_task(label):
    def run(batches):
        chains = []
        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), utf8_list(batch.column("html"))):
                page = blocks(html.decode())
                labels = label(page)
                if any(labels):
                    draw = random.Random(page_id)
                    framed = [(page, labels)] + [reframed(page, labels, draw) for _ in range(VARIANTS)]
                    chains += [(chain_features(p), y) for p, y in framed]
        field = fit(chains)
        yield pa.record_batch({"weight": pa.array([field.weight.tobytes()]), "pair": pa.array([field.pair])})
    return run


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Field:
    """Fit on at most ``train_pages`` pages that mark their article (null ids left out).

    Where no page does, on pages with running text, which stands for the article.
    """
    known = pages.filter(F.col("page_id").isNotNull() & F.col("html").isNotNull())
    marked = known.filter(F.regexp_like("html", F.lit("(?i)<(?:article|main)[ >]")))
    label = own_labels
    if marked.isEmpty():
        marked, label = known, running_labels
    ids = marked.select(F.col("page_id").cast("long").alias("page_id")).distinct().orderBy(
        F.xxhash64("page_id"), "page_id").limit(train_pages)
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").join(
        F.broadcast(ids), "page_id").groupBy("page_id").agg(F.max("html").alias("html"))      # at most train_pages rows
    rows, path = store(chosen, "labelled-pages")
    found = rows.orderBy("page_id").coalesce(1).mapInArrow(_fit_in_task(label), "weight binary, pair array<double>").collect()
    drop(pages.sparkSession, path)
    if not found:
        return Field(np.zeros(1 << BITS), [0.0] * 6)
    return Field(np.frombuffer(found[0]["weight"], np.float64), list(found[0]["pair"]))


def main_text(html: str, field: Field) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, y in zip(page, field.decode(chain_features(page))) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages`` (page_id, url, html).

    Null html is an empty page with an empty text. Repeated rows and null ids
    give rows of their own; an empty table gives none; in a table without any page
    that marks its article, blocks of running text outside of navigation are what is
    learnt from; other columns are ignored.
    """
    field = field or train(pages)

    def run(batches):
        for batch in batches:
            texts = [main_text(h.decode(), field) for h in utf8_list(batch.column("html"))]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                                   "n_chars": pa.array([len(t) for t in texts], pa.int64())})
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
