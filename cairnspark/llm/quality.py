"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shape figures of the line and of the lines beside it; neighbouring labels depend on
each other. Forward-backward gives each line's marginal; the mean of the marginals by line length, calibrated on the fitting
rows, is the document's quality.

Defined results: a null or empty text is one empty line and gets a score like any other; repeated rows get equal scores; other
columns are not looked at, and the score's name must not be one of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.arrowtext import padded, runs_of, steps, utf8, word_hashes

#: Labelled rows to fit on, at most.
FIT_ROWS = 6000
#: A prediction is 1 from this score on.
THRESHOLD = 0.3

_BYTE = np.arange(256)
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) | (_BYTE >= 128)
#: Byte classes whose share in a line is a feature.
_CLASSES = {
    "letter": _LETTER,
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "stop": np.isin(_BYTE, [ord(c) for c in ".,;:"]),
    "shout": np.isin(_BYTE, [ord(c) for c in "!?"]),
    "bar": _BYTE == ord("|"),
    "sign": np.isin(_BYTE, [ord(c) for c in "#$%&*@~^<>{}[]\\/=_+"]),
}
_CODE = np.zeros(256, np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _CODE |= (_members.astype(np.uint8) << _i).astype(np.uint8)
#: Bins of the figures of a line: a figure counts by the bin it falls in, so that a weight need not be linear in it.
_CUTS = [(0.02, 0.5, 0.65, 0.75, 0.82), (0.02, 0.06, 0.15, 0.4), (0.005, 0.05, 0.2), (0.005, 0.03, 0.08), (0.005, 0.05, 0.15), (0.005, 0.05, 0.15), (0.005, 0.05, 0.15), (3.0, 5.0, 7.0, 10.0), (2.0, 4.0, 6.0, 8.0), (0.02, 0.1, 0.4), (0.3, 0.6, 0.8, 0.95), (0.5,), (0.05, 0.3)]
WIDTH = sum(len(c) + 1 for c in _CUTS)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins per line and figure, weights of lines, number of the first line of each text and the end)."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, offsets) + np.arange(n + 1)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    size = ends - starts
    per = np.maximum(size, 1).astype(float)
    figures = []
    code = _CODE[data]
    for i in range(len(_CLASSES)):
        total = np.concatenate([[0], np.cumsum((code >> i) & 1, dtype=np.int64)])
        figures.append((total[ends] - total[starts]) / per)
    figures.append(np.log1p(size))
    spaces = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    ws, we = runs_of(~spaces, offsets)
    of = np.searchsorted(starts, ws, "right") - 1
    words = np.bincount(of, minlength=len(starts)).astype(float)
    some = np.maximum(words, 1)
    figures.append(np.bincount(of, we - ws, minlength=len(starts)) / some)
    if len(ws):
        h = word_hashes(padded(data), ws, we)
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (of[1:] == of[:-1])])
        key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(starts))
        line_hash = np.zeros(len(starts), np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        line_hash[of[edge]] = np.add.reduceat(h, edge)
    else:
        same, distinct, line_hash = np.zeros(0, bool), np.zeros(len(starts)), np.zeros(len(starts), np.uint64)
    figures.append(np.bincount(of[same], minlength=len(starts)) / some)
    figures.append(np.where(words > 0, distinct / some, 1.0))
    text = np.repeat(np.arange(n), np.diff(first))
    again = np.concatenate([[False], (line_hash[1:] == line_hash[:-1]) & (text[1:] == text[:-1]) & (words[1:] > 0)])
    figures.append(again.astype(float))
    # the share of the text's words that stand in its lines of few words: lists and fragments
    short = np.bincount(text, words * (words <= 3), minlength=n) / np.maximum(np.bincount(text, words, minlength=n), 1)
    figures.append(short[text])
    bins = np.stack([np.searchsorted(c, f, "right") for c, f in zip(_CUTS, figures, strict=True)], 1)
    return bins.astype(np.int16), size + 1.0, first


def _columns(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Column numbers of a line's features: its own bins, those of the line before and those of the line after."""
    base = np.cumsum([0] + [len(c) + 1 for c in _CUTS[:-1]])
    own = bins + base
    before, after = np.full_like(own, 3 * WIDTH), np.full_like(own, 3 * WIDTH)
    before[1:], after[:-1] = own[:-1] + WIDTH, own[1:] + 2 * WIDTH
    before[first[:-1][first[:-1] < len(own)]] = 3 * WIDTH
    after[first[1:] - 1] = 3 * WIDTH
    return np.concatenate([own, before, after], 1).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # score of good over bad, for each column; the last stands for no line
    links: np.ndarray  # 2 x 2: from label, to label
    slope: float = 1.0
    level: float = 0.0


def marginals(model: Model, columns: np.ndarray, first: np.ndarray, pairs: bool = False):
    """P(good) of every line by forward-backward, all texts side by side; with ``pairs`` also the summed pair marginals."""
    n, size = len(first) - 1, np.diff(first)
    score = np.stack([np.zeros(len(columns)), sum(model.weights[c] for c in columns.T)], 1)
    order = np.argsort(-size, kind="stable")
    begin, sizes = first[:-1][order], size[order]
    longest = int(sizes[0]) if n else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t lines
    forward, backward = np.empty_like(score), np.zeros_like(score)
    for t in range(longest):
        k = begin[: active[t]] + t
        if t == 0:
            forward[k] = score[k]
        else:
            p = forward[k - 1]
            forward[k] = score[k] + np.logaddexp(p[:, :1] + model.links[0], p[:, 1:] + model.links[1])
    for t in range(longest - 2, -1, -1):
        k = begin[: active[t + 1]] + t
        q = backward[k + 1] + score[k + 1]
        backward[k] = np.logaddexp(model.links[:, 0] + q[:, :1], model.links[:, 1] + q[:, 1:])
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    if not pairs:
        return good
    ends = first[1:] - 1
    total = np.repeat(np.logaddexp(forward[ends, 0], forward[ends, 1]), size)
    has_next = np.ones(len(columns), bool)
    has_next[ends] = False
    k = np.flatnonzero(has_next)
    joint = forward[k][:, :, None] + model.links[None] + (score[k + 1] + backward[k + 1])[:, None, :] - total[k][:, None, None]
    return good, np.exp(joint).sum(0)


def fit(texts: list[str], labels: list[int], rounds: int = 120, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Maximum likelihood by Adam; a line has its document's label. Without rows of both labels every score is the same."""
    model = Model(np.zeros(3 * WIDTH + 1), np.zeros((2, 2)))
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        model.slope, model.level = 0.0, float(np.log(share / (1 - share)))
        return model
    # features are made a few texts at a time: what is held is a few small numbers per line
    parts = [(*line_features(*utf8(pa.array(texts[a : a + 200], pa.string()))),) for a in range(0, len(texts), 200)]
    columns = np.concatenate([_columns(bins, own) for bins, _, own in parts])
    weight = np.concatenate([w for _, w, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(own) for _, _, own in parts]))])
    size, y = np.diff(first), np.asarray(labels)
    of = np.repeat(np.arange(len(y)), size)
    line_y = y[of]
    stay = np.array([[(size - 1)[y == 0].sum(), 0.0], [0.0, (size - 1)[y == 1].sum()]])
    # a text counts once, however many lines it has
    each = 1 / size[of]
    state = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        good, joint = marginals(model, columns, first, pairs=True)
        miss = (line_y - good) * each
        pull = sum(np.bincount(c, miss, minlength=len(model.weights)) for c in columns.T)
        grads = [pull / len(y) - ridge * model.weights, (stay - joint) / max(1, stay.sum()) - ridge * model.links]
        for i, (value, grad) in enumerate(zip((model.weights, model.links), grads, strict=True)):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * grad
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * grad**2
            value += rate * (state[2 * i] / (1 - 0.9**step)) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**step)) + 1e-9)
        np.clip(model.links, -1.5, 1.5, out=model.links)
    x = _logit(_mean(marginals(model, columns, first), weight, of, len(y)))
    for _ in range(60):  # Newton steps for slope and level
        p = 1 / (1 + np.exp(-(model.slope * x + model.level)))
        v = np.maximum(p * (1 - p), 1e-6)
        a = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(a, np.array([((y - p) * x).sum(), (y - p).sum()]))
        model.slope, model.level = float(model.slope + np.clip(d[0], -1, 1)), float(model.level + np.clip(d[1], -1, 1))
    return model


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _mean(good: np.ndarray, weight: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, good * weight, minlength=n) / np.bincount(of, weight, minlength=n)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    bins, weight, first = line_features(data, offsets)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    mean = _mean(marginals(model, _columns(bins, first), first), weight, of, len(offsets) - 1)
    return 1 / (1 + np.exp(-(model.slope * _logit(mean) + model.level)))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows of ``docs`` with their score: a map, without a shuffle."""
    if name in docs.columns:
        raise ValueError(f"a column is named {name} already; give the score another name")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(shared.value, data, offsets))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def predicted(score: str = "score") -> "F.Column":
    return (F.col(score) >= THRESHOLD).cast("int")
