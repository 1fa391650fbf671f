"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded over the tree.

Every element and text run of a page is a node with features of its subtree (text, tags, density
of text and links, punctuation), its attributes' words, its depth and its siblings.  Boosted
trees give the odds that a node holds article text.  Decoding picks the most likely labelling in
which a kept node's ancestors are all kept (a dropped menu drops what is in it), by one pass up
and one pass down the tree.  Kept text runs are the result.

The trees are fitted once per session on ``TRAINING_PAGES`` generated layouts (a fixed bound; see
``html_templates``); pages carry no labels.  Pages are scored in batches inside the tasks: one
pass, no shuffle.

Defined results: null or empty html gives the empty text; a page without any tag is one text
run; broken or cut-off html is read as far as it goes; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fairrank.llm.common import pick, small_batches
from fairrank.llm.dom import Page
from fairrank.llm.html_templates import MARK, training_pages
from fairrank.llm.trees import BoostedTrees

TRAINING_PAGES = 700
#: Training pages with embedded elements, next to those.
EMBEDDED_PAGES = 100
#: Pages that are scored together.
BATCH = 200


class Odds:
    """Log odds of article text per tag or attribute word, from training counts."""

    def __init__(self):
        self.counts: dict[str, list[float]] = {}

    def add(self, name: str, label: int) -> None:
        self.counts.setdefault(name, [0.0, 0.0])[label] += 1

    def done(self) -> dict[str, float]:
        return {k: float(np.log((p + 1.0) / (n + 1.0))) for k, (n, p) in self.counts.items() if n + p >= 3}


def node_features(pages: list[Page], tag_odds: dict, word_odds: dict) -> tuple[np.ndarray, np.ndarray]:
    """(features per node of all pages, first node of each page)."""
    first = np.cumsum([0] + [len(p.tag) for p in pages])
    n = int(first[-1])
    parent, end, own = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros((n, 6))
    depth, nth, kind, tag_w, word_w = (np.empty(n) for _ in range(5))
    for p, a in zip(pages, first):
        z = a + len(p.tag)
        parent[a:z], end[a:z] = np.array(p.parent) + a, np.array(p.end) + a
        depth[a:z], nth[a:z] = p.depth, p.nth
        kind[a:z] = [t == "" for t in p.tag]
        tag_w[a:z] = [tag_odds.get(t, 0.0) for t in p.tag]
        word_w[a:z] = [min((word_odds[w] for w in ws if w in word_odds), key=lambda v: -abs(v), default=0.0) if ws else 0.0
                       for ws in p.words]
        for i, (tag, text) in enumerate(zip(p.tag, p.text)):
            if tag == "":
                words = text.count(" ") + 1 if text != " " else 0
                own[a + i] = (len(text) if words else 0, words, text.count(".") + text.count(","), words > 0, 0, 0)
            else:
                own[a + i, 4:] = (1, tag in ("input", "button", "select", "textarea", "label"))
        parent[a] = a
    up = parent.copy()
    # link text: the text under the nearest a
    anchors = np.array([t == "a" for p in pages for t in p.tag], bool)
    inside = np.zeros(n + 1)
    np.add.at(inside, np.flatnonzero(anchors), 1)
    np.add.at(inside, end[anchors], -1)
    link = (inside.cumsum()[:n] > 0).astype(float)
    sums = np.concatenate((np.zeros((1, 8)), np.cumsum(np.column_stack(
        (own, own[:, 0] * link, [t == "p" for p in pages for t in p.tag])), axis=0)))
    sub = sums[end] - sums[np.arange(n)]
    text, words, marks, runs, tags, inputs, link_text, paras = sub.T
    page_of = np.repeat(np.arange(len(pages)), np.diff(first))
    whole = np.maximum(sub[first[:-1], 0][page_of], 1)
    start = sums[np.arange(n), 0] - sums[first[:-1], 0][page_of]
    # weights met on the way up: over 1, 2, 4, ... nodes at a time
    low_tag, low_word, high_word, high_tag = tag_w.copy(), word_w.copy(), word_w.copy(), tag_w.copy()
    above = up
    for _ in range(int(depth.max(initial=0)).bit_length()):
        for arr, f in ((low_tag, np.minimum), (low_word, np.minimum), (high_word, np.maximum), (high_tag, np.maximum)):
            arr[:] = f(arr, arr[above])
        above = above[above]
    siblings = np.bincount(parent, minlength=n)[parent].astype(float)
    order = np.lexsort((np.arange(n), parent))
    near = np.zeros((n, 2))
    same = parent[order[1:]] == parent[order[:-1]]
    near[order[1:][same], 0] = text[order[:-1][same]]
    near[order[:-1][same], 1] = text[order[1:][same]]
    some = np.maximum(text, 1)
    x = np.column_stack((
        kind, np.log1p(text), link_text / some, np.log1p(tags), np.log1p(text / (tags + 1)), depth, nth / np.maximum(siblings, 1),
        np.log1p(siblings), np.log1p(paras), marks / np.maximum(words, 1), np.log1p(words / np.maximum(runs, 1)), tag_w, word_w,
        tag_w[up], word_w[up], low_tag, low_word, high_tag, high_word, start / whole, (start + text) / whole, text / whole,
        text / np.maximum(text[up], 1), np.log1p(near), np.log1p(inputs), np.log1p(text[up]), link, link_text[up] / np.maximum(text[up], 1),
        np.log1p(paras[up])))
    return x, first


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The likeliest labels in which every kept node's ancestors are kept; the page is kept."""
    n = len(page.tag)
    keep = (-np.logaddexp(0, -odds)).tolist()
    drop = (-np.logaddexp(0, odds)).tolist()
    for i in range(n - 1, 0, -1):  # children come after their parents
        up = page.parent[i]
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and keep[i] > drop[i]
    return kept


def _labels(page: Page) -> list[int]:
    """1 for a marked text run and every ancestor; takes the marks away."""
    out = [0] * len(page.tag)
    for i in range(len(out) - 1, -1, -1):
        if MARK in page.text[i]:
            page.text[i] = page.text[i].replace(MARK, "")
            out[i] = 1
        if out[i] and i:
            out[page.parent[i]] = 1
    return out


class Extractor:
    def __init__(self, n_pages: int = TRAINING_PAGES, n_embedded: int = EMBEDDED_PAGES):
        pages = [Page(h) for h in training_pages(n_pages, n_embedded)]
        labels = [_labels(p) for p in pages]
        tags, words = Odds(), Odds()
        for p, y in zip(pages, labels):
            for tag, ws, label in zip(p.tag, p.words, y):
                if tag:
                    tags.add(tag, label)
                for w in set(ws):
                    words.add(w, label)
        self.tag_odds, self.word_odds = tags.done(), words.done()
        x, _ = node_features(pages, self.tag_odds, self.word_odds)
        # white space between elements has no label of its own
        real = np.array([t != " " for p in pages for t in p.text])
        self.trees = BoostedTrees().fit(x[real], np.array([v for y in labels for v in y], float)[real])

    def extract(self, htmls: list[str | None]) -> list[str]:
        pages = [Page(h) for h in htmls]
        x, first = node_features(pages, self.tag_odds, self.word_odds)
        odds = self.trees.log_odds(x)
        out = []
        for p, a in zip(pages, first):
            kept = decode(p, odds[a:a + len(p.tag)])
            # white space goes with the element that holds it
            out.append(p.render([k or (t == " " and kept[max(u, 0)]) for k, t, u in zip(kept, p.text, p.parent)]))
        return out


@lru_cache(maxsize=1)
def extractor() -> Extractor:
    return Extractor()


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    small_batches(pages.sparkSession, BATCH)
    rows = pick(pages, [id_col, url_col, html_col]).toDF("page_id", "url", "html")
    id_type = rows.schema["page_id"].dataType.simpleString()
    model = extractor()

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                texts = model.extract(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars bigint")
