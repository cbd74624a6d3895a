"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

Each leaf block of a page is of the article or not. The field scores blocks
by the elements around them and by their text, and neighbours by whether
their labels agree. It is trained on labelled pages by gradient ascent on
the likelihood, and decoded by Viterbi.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.html_pages import Block, labelled_pages, leaf_blocks

#: Labelled pages that the field is trained on, and those that its accuracy is measured on in tests.
TRAINING_PAGES, TRAINING_SEED, TEST_SEED = 1000, 11, 12
_CUES = re.compile(
    r"cookie|subscribe|newsletter|copyright|©|all rights|privacy|sign in|log in|advert|sponsored|share|comment|reply|related|search"
)
#: Longer blocks are prose; what they speak of is no cue.
CUE_WORDS = 20


def path_features(path: tuple) -> list[str]:
    """Elements around a block and the words of their names; the nearest element by itself too."""
    found = {f"in={tag}" for tag, _ in path} | {f"name={p}" for _, parts in path for p in parts}
    tags = [t for t, _ in path]
    found.add(f"at={tags[-1] if tags else ''}")
    found.add(f"under={tags[-2] if len(tags) > 1 else ''}")
    if not any(t in ("article", "main") for t in tags):
        found.add("no-article")
    return sorted(found)


def text_features(block: Block) -> list[str]:
    n = block.text.count(" ") + 1
    out = [f"words={min(int(math.log2(n)), 7)}"]
    share = block.link_chars / len(block.text)
    out.append("links=all" if share > 0.8 else "links=half" if share > 0.3 else "links=some" if share else "links=none")
    if block.text[-1] in ".!?":
        out.append("ends")
    if n <= CUE_WORDS:
        out += sorted({f"cue={m}" for m in _CUES.findall(block.text.lower())})
    return out


def _bias(features: list[str]) -> list[str]:
    return ["bias", *features]


@dataclass(frozen=True)
class Field:
    """Weights of features towards "article", and of pairs of labels."""

    weights: dict[str, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]

    def scorer(self):
        """A function from blocks to labels. Scores of paths are remembered: pages of a site share them."""
        get, known = self.weights.get, {}

        def scores(blocks: list[Block]) -> list[float]:
            out = []
            for b in blocks:
                s = known.get(b.path)
                if s is None:
                    if len(known) > 50_000:
                        known.clear()
                    s = known[b.path] = sum(get(f, 0.0) for f in _bias(path_features(b.path)))
                out.append(s + sum([get(f, 0.0) for f in text_features(b)]))
            return out

        return lambda blocks: viterbi(scores(blocks), self.pairs, self.start)


def viterbi(scores: list[float], pairs, start) -> list[int]:
    """The best labels: `scores` count for label 1, `pairs` for neighbours, `start` for the first."""
    if not scores:
        return []
    a, b = start[0], start[1] + scores[0]
    back = []
    for s in scores[1:]:
        a0, b0 = a + pairs[0][0], b + pairs[1][0]
        a1, b1 = a + pairs[0][1], b + pairs[1][1]
        back.append((b0 > a0, b1 > a1))
        a, b = max(a0, b0), max(a1, b1) + s
    label = int(b > a)
    out = [label]
    for choice in reversed(back):
        label = int(choice[label])
        out.append(label)
    return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum-likelihood weights by Adam; forward and backward passes run over all pages at once."""
    names = sorted({f for blocks, _ in pages for fs in blocks for f in fs})
    place = {f: i for i, f in enumerate(names)}
    n, width = len(pages), max(len(y) for _, y in pages)
    flat = [(p, t, place[f]) for p, (blocks, _) in enumerate(pages) for t, fs in enumerate(blocks) for f in fs]
    page, time, feature = (np.array(c) for c in zip(*flat))
    cell = page * width + time
    live = np.zeros((n, width))
    gold = np.zeros((n, width), int)
    for p, (_, y) in enumerate(pages):
        live[p, : len(y)], gold[p, : len(y)] = 1, y
    both = live[:, 1:]
    n_pairs = np.array([[(both * (gold[:, :-1] == a) * (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    n_start = np.array([(gold[:, 0] == 0).sum(), (gold[:, 0] == 1).sum()])
    n_feature = np.bincount(feature, gold.ravel()[cell], len(names))
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, pairs, start = theta[: len(names)], theta[len(names) : len(names) + 4].reshape(2, 2), theta[-2:]
        s = np.bincount(cell, w[feature], n * width).reshape(n, width)
        emit = np.stack([np.zeros_like(s), s], axis=2)
        forward = np.zeros((n, width, 2))
        forward[:, 0] = start + emit[:, 0]
        for t in range(1, width):
            new = np.logaddexp(forward[:, t - 1, :1] + pairs[0], forward[:, t - 1, 1:] + pairs[1]) + emit[:, t]
            forward[:, t] = np.where(live[:, t, None] > 0, new, forward[:, t - 1])
        backward = np.zeros((n, width, 2))
        for t in range(width - 2, -1, -1):
            after = backward[:, t + 1] + emit[:, t + 1]
            new = np.logaddexp(pairs[:, 0] + after[:, :1], pairs[:, 1] + after[:, 1:])
            backward[:, t] = np.where(live[:, t + 1, None] > 0, new, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        marginal = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * live
        joint = np.exp(
            forward[:, :-1, :, None] + pairs + (emit + backward)[:, 1:, None, :] - total[:, None, None, None]
        ) * both[:, :, None, None]
        first = np.exp(forward[:, 0] + backward[:, 0] - total[:, None]).sum(axis=0)
        d = np.concatenate([
            n_feature - np.bincount(feature, marginal.ravel()[cell], len(names)),
            (n_pairs - joint.sum(axis=(0, 1))).ravel(),
            n_start - first,
        ]) / n - decay * theta
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    k = len(names)
    return Field(
        {f: float(x) for f, x in zip(names, theta)},
        tuple(tuple(map(float, r)) for r in theta[k : k + 4].reshape(2, 2)),
        tuple(map(float, theta[-2:])),
    )


def features_of(blocks: list[Block]) -> list[list[str]]:
    return [_bias(path_features(b.path)) + text_features(b) for b in blocks]


@lru_cache(maxsize=2)
def trained_field(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> Field:
    """The field fitted to `pages` labelled pages; a bounded model that tasks receive whole."""
    sample = []
    for page, labels in labelled_pages(pages, seed):
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("labels do not fit the blocks of a labelled page")
        sample.append((features_of(blocks), labels))
    return fit(sample)


def main_text(page: str, label) -> str:
    """Blocks of the article, a line each. `label` comes from `Field.scorer`."""
    blocks = leaf_blocks(page)
    return "\n".join([b.text for b, is_article in zip(blocks, label(blocks)) if is_article])


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(`page_id`, `url`, `text`, `n_chars`) for every row of `pages` (`page_id`, `url`, `html`).

    `text` is the article's blocks in page order, joined by line ends; empty
    if there is none, or html is null. Other nulls stay as they are, rows
    that repeat give a row each, an empty table an empty result; other
    columns are ignored.
    """
    field = field or trained_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = field.scorer()
        for batch in batches:
            text = [main_text(h or "", label) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
