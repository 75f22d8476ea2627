"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel of two strings sums over all common subsequences of ORDER letters, each weighted by DECAY to the power of the length it
spans in either string, so that letters in between cost a little and do not hide a word. Letters are those of any script: Latin
ones without case and accents, others by their UTF-8 continuation bytes; a word's beginning and end are letters as well.

Landmarks are words that tell toxic from other labelled rows beyond chance, each taken only as far as earlier ones leave rows
unexplained, so that every family of insults gets its own however rare it is beside others. A sentence's features are the largest
kernel values of its words with each landmark, mapped by the Nystroem root of the landmarks' own kernel matrix; a squared-hinge
machine is trained on labelled sentences, a toxic row giving those that look worst, and once more those of its copy whose telling
words are written with gaps and letters put in. A text's score comes from the margins of its
worst three sentences and of its worst six words, each as a sentence of its own, against the number of its words, calibrated on the
fitting rows.

A word's kernel values with all landmarks at once are sums over its subsequences of ORDER letters, looked up in one table; they
are exact. A run of more than LONG letters without a blank is read in overlapping pieces of LONG letters.

Defined results: a null or empty text has no words and gets the score of a clean one; repeated rows get equal scores; other
columns are not looked at, and the score's name must not be one of theirs.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.arrowtext import mixed, padded, runs_of, steps, utf8, word_hashes

#: Labelled rows to fit on, and landmarks, at most.
FIT_ROWS = 8000
LANDMARKS = 96
#: What a chosen landmark leaves of the weight of the toxic rows that hold it.
EXPLAINED = 0.7
ORDER = 3
DECAY = 0.7
#: The power of the normalized kernel, a kernel as well: words that only share common letters fall behind.
POWER = 2
#: Kernel values below this count as nothing. Unrelated words reach it; it only keeps tables small.
LEAST = 0.3
#: Letters that one piece of an unbroken run holds at most; pieces begin half as many apart.
LONG = 40
#: Margins of a text's sentences, and of its words, that its score is made of.
WORST = 3
WORST_WORDS = 6
THRESHOLD = 0.3
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_END = np.zeros(256, bool)
_END[[10, 13, ord("."), ord("!"), ord("?")]] = True
#: Letter codes: 1 to 26 are a to z, 27 to 62 other scripts, 63 a word's edge.
EDGE = 63
_WIDTH = 64


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Code of a byte after a byte below 0xC4, and of a Latin-1 letter's second byte; 0 is no letter."""
    plain, latin = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for c in range(128):
        plain[c] = ord(chr(c).lower()) - 96 if chr(c).isalpha() else 0
    for c in range(0x80, 0xC0):
        base = unicodedata.normalize("NFKD", chr(c + 0x40))[0].lower()
        letter = {"ß": "s", "æ": "a", "ø": "o", "ð": "d", "þ": "t"}.get(base, base)
        latin[c] = ord(letter) - 96 if "a" <= letter <= "z" else 0
    return plain, latin


_PLAIN, _LATIN = _codes()


def letter_codes(data: np.ndarray) -> np.ndarray:
    """The letter code of each byte; bytes that lead others, signs and digits have none (0)."""
    out = _PLAIN[data]
    high = np.flatnonzero((data >= 0x80) & (data < 0xC0))
    if len(high):
        before = data[np.maximum(high - 1, 0)]
        other = 27 + (data[high] & 0x3F) % 36
        lead = np.where((before >= 0x80) & (before < 0xC0), data[np.maximum(high - 2, 0)], before)
        code = np.where(before == 0xC3, _LATIN[data[high]], other)
        out[high] = np.where((lead == 0xC2) | (lead == 0xE2), 0, code)
    return out


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Kernel of each row of s with the same row of t: letter codes, padded by numbers that differ in s and t."""
    n, ls, lt = len(s), s.shape[1], t.shape[1]
    prime = np.ones((ls + 1, lt + 1, n))
    for _ in range(order - 1):
        new = np.zeros((ls + 1, lt + 1, n))
        for a in range(1, ls + 1):
            run = np.zeros(n)
            for b in range(1, lt + 1):
                run = decay * run + decay * decay * np.where(s[:, a - 1] == t[:, b - 1], prime[a - 1, b - 1], 0)
                new[a, b] = decay * new[a - 1, b] + run
        prime = new
    out = np.zeros(n)
    for a in range(1, ls + 1):
        for b in range(1, lt + 1):
            out += np.where(s[:, a - 1] == t[:, b - 1], prime[a - 1, b - 1], 0)
    return out * decay * decay


def letters(words: list[bytes], pad: int) -> np.ndarray:
    """Letter codes of words, one row each, padded."""
    out = np.full((len(words), max(map(len, words), default=1)), pad, np.int16)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w, np.uint8)
    return out


def norms(words: list[bytes]) -> np.ndarray:
    return np.sqrt(kernel(letters(words, -1), letters(words, -2)))


def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of ORDER letters in a word of so many, and their weights."""
    places = np.array(list(combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
    return places, DECAY ** (places[:, -1] - places[:, 0] + 1.0)


@dataclass
class Model:
    landmarks: list[bytes] = field(default_factory=list)
    root: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: np.ndarray = field(default_factory=lambda: np.zeros(WORST + WORST_WORDS + 1))
    level: float = 0.0

    def prepare(self) -> None:
        """The landmarks' features: which of them hold a subsequence, and how much of it, by a table over all subsequences."""
        held: dict[int, dict[int, float]] = {}
        for m, mark in enumerate(self.landmarks):
            code = np.frombuffer(mark, np.uint8).astype(np.int64)
            places, weight = _triples(len(code))
            size = norms([mark])[0]
            for key, w in zip(_key(code[None, :], places)[0].tolist(), (weight / size).tolist(), strict=True):
                own = held.setdefault(key, {})
                own[m] = own.get(m, 0.0) + w
        self.slot = np.full(_WIDTH**ORDER, -1, np.int32)
        self.slot[list(held)] = np.arange(len(held))
        self.first = np.concatenate([[0], np.cumsum([len(v) for v in held.values()])]).astype(np.int64)
        self.mark = np.array([m for v in held.values() for m in v], np.int64)
        self.part = np.array([w for v in held.values() for w in v.values()])
        self.most = np.array([max(v.values()) for v in held.values()])


def _key(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    key = codes[:, places[:, 0]]
    for i in range(1, ORDER):
        key = key * _WIDTH + codes[:, places[:, i]]
    return key


class Words:
    """The words of some texts as runs of letter codes, with their texts and sentences. Signs and digits in a word are passed over.
    Single letters in a row, apart by blanks, are one more word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        code = letter_codes(data)
        starts, ends = runs_of(~_SPACE[data], offsets)
        text = np.searchsorted(offsets, starts, "right") - 1
        stops = np.concatenate([[0], np.cumsum(_END[data])])
        sentence = stops[starts] + text if len(starts) else starts  # a text's start begins a sentence as well
        before = np.concatenate([[0], np.cumsum(code > 0)])
        self.stream = code[code > 0]
        begin, end = before[starts], before[ends]
        some = end > begin
        begin, end, text, sentence = begin[some], end[some], text[some], sentence[some]
        if len(begin):
            lone = end - begin == 1
            head = np.flatnonzero(np.concatenate([[True], ~(lone[1:] & lone[:-1]) | (text[1:] != text[:-1])]))
            tail = np.concatenate([head[1:], [len(begin)]]) - 1
            more = tail - head >= 2
            begin, end, text, sentence = (np.concatenate([a, b]) for a, b in ((begin, begin[head[more]]), (end, end[tail[more]]), (text, text[head[more]]), (sentence, sentence[head[more]])))
            long = np.flatnonzero(end - begin > LONG)
            if len(long):
                pieces = -(-(end[long] - begin[long] - LONG) // (LONG // 2)) + 1
                of = np.repeat(long, pieces)
                at = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * (LONG // 2)
                rest = np.setdiff1d(np.arange(len(begin)), long)
                begin, end, text, sentence = (np.concatenate([a, b]) for a, b in ((begin[rest], at), (end[rest], np.minimum(at + LONG, end[of])), (text[rest], text[of]), (sentence[rest], sentence[of])))
        self.starts, self.ends, self.text, self.sentence = begin, end, text, sentence

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(a word of each kind, the kind of each word)"""
        hashes = word_hashes(padded(self.stream), self.starts, self.ends)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        return first, inverse

    def codes(self, which: np.ndarray, length: int) -> np.ndarray:
        """Letter codes of words of one length, between two edges."""
        out = np.full((len(which), length + 2), EDGE, np.int32)
        out[:, 1:-1] = self.stream[self.starts[which][:, None] + np.arange(length)]
        return out


def values(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind of each word or -1, kinds by landmarks: normalized kernel values) for the kinds of words that reach LEAST anywhere."""
    if not len(words.starts) or not model.landmarks:
        return np.full(len(words.starts), -1), np.zeros((0, len(model.landmarks)), np.float32)
    first, inverse = words.distinct()
    size, m = words.ends[first] - words.starts[first], len(model.landmarks)
    kinds, found = [], []
    for length in np.unique(size):
        members = np.flatnonzero(size == length)
        places, weight = _triples(int(length) + 2)
        weight = weight.astype(np.float32)
        # letters all different give the least norm of a word of this length: equal subsequences only add to it
        floor = LEAST * float(np.sqrt((weight**2).sum()))
        chunk = max(1, 400_000 // max(1, len(places)))
        for a in range(0, len(members), chunk):
            part = members[a : a + chunk]
            codes = words.codes(first[part], int(length))
            slot = model.slot[_key(codes, places)]
            row, place = np.nonzero(slot >= 0)
            hit, w = slot[row, place], weight[place]
            near = np.bincount(row, w * model.most[hit], minlength=len(part)) >= floor - 1e-6
            if not near.any():
                continue
            keep = near[row]
            row, hit, w = (np.cumsum(near) - 1)[row[keep]], hit[keep], w[keep]
            part, codes = part[near], codes[near]
            times = model.first[hit + 1] - model.first[hit]
            entry = np.arange(times.sum()) + np.repeat(model.first[hit] - (np.cumsum(times) - times), times)
            cell = np.repeat(row * m, times) + model.mark[entry]
            value = np.bincount(cell, np.repeat(w, times) * model.part[entry], len(part) * m).reshape(-1, m).astype(np.float32)
            good = value.max(1) >= floor - 1e-6
            value, part, codes = value[good], part[good], codes[good]
            value /= np.sqrt(kernel(codes, codes))[:, None].astype(np.float32)
            good = value.max(1, initial=0) >= LEAST
            kinds.append(part[good])
            found.append(np.where(value[good] >= LEAST, value[good], 0) ** POWER)
    kind = np.full(len(first), -1)
    if kinds:
        kind[np.concatenate(kinds)] = np.arange(sum(map(len, kinds)))
    return kind[inverse], np.concatenate(found) if found else np.zeros((0, len(model.landmarks)), np.float32)


def sentences(model: Model, words: Words, kind: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, features before the root) of every sentence that holds a word near a landmark; kinds and table are those of values()."""
    at = np.flatnonzero(kind >= 0)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, len(model.landmarks)), np.float32)
    at = at[np.argsort(words.sentence[at], kind="stable")]
    edge = np.flatnonzero(np.concatenate([[True], words.sentence[at][1:] != words.sentence[at][:-1]]))
    return words.text[at[edge]], np.maximum.reduceat(table[kind[at]], edge, axis=0)


def _vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
    """(row, hash) of every distinct word of three to LONG letters of every row, rows in order; and which word a hash means."""
    rows, hashes, names = [], [], {}
    for a in range(0, len(texts), 200):
        words = Words(*utf8(pa.array(texts[a : a + 200], pa.string())))
        size = words.ends - words.starts
        fit = (size >= 3) & (size <= LONG)
        start, end, text = words.starts[fit], words.ends[fit], words.text[fit]
        code = word_hashes(padded(words.stream), start, end)
        order = np.lexsort((code, text))
        first = order[np.concatenate([[True], (text[order][1:] != text[order][:-1]) | (code[order][1:] != code[order][:-1])])] if len(order) else order
        rows.append(text[first] + a)
        hashes.append(code[first])
        stream = words.stream.tobytes()
        names |= {h: stream[s:e] for h, s, e in zip(code[first].tolist(), start[first].tolist(), end[first].tolist(), strict=True)}
    return np.concatenate(rows), np.concatenate(hashes), names


def _copies(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Whether an earlier row shares a band of three MinHash values: true of most pairs that have half of their words in common.
    Rows of a few words are no copies."""
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    least = [np.minimum.reduceat((code * (mixed(np.array([i + 1], np.uint64)) | np.uint64(1))) >> np.uint64(16), edge) for i in range(36)]
    out = np.zeros(len(edge), bool)
    for i in range(0, 36, 3):
        band = mixed(mixed(mixed(least[i]) + least[i + 1]) + least[i + 2])
        _, first = np.unique(band, return_index=True)
        again = np.ones(len(edge), bool)
        again[first] = False
        out |= again
    whole = np.zeros(n, bool)
    whole[row[edge]] = out & (np.diff(np.append(edge, len(row))) > 3)
    return whole


def choose_landmarks(texts: list[str], labels: list[int], most: int = LANDMARKS) -> list[bytes]:
    """Words that toxic rows hold more often than chance allows for the best of so many words. Each choice lowers the weight of
    the toxic rows that hold it, so the next one is that which tells most about rows that are explained least. Near copies of
    a row count once."""
    row, code, names = _vocabulary(texts)
    if not len(row):
        return []
    y = np.asarray(labels) > 0
    alone = ~_copies(row, code, len(texts))
    row, code = row[alone[row]], code[alone[row]]
    base = max(1, int((y & alone).sum())) / max(2, int(alone.sum()))
    kinds, inverse, held = np.unique(code, return_inverse=True, return_counts=True)
    toxic = np.bincount(inverse, y[row], len(kinds))
    certain = np.log(max(2, int((held >= 3).sum())))
    able = np.flatnonzero((toxic >= 3) & (toxic > max(0.5, base) * held))
    order = np.argsort(inverse, kind="stable")
    begin, end = np.searchsorted(inverse[order], able, "left"), np.searchsorted(inverse[order], able, "right")
    places = [row[order[a:b]][y[row[order[a:b]]]] for a, b in zip(begin, end, strict=True)]
    clean = (held - toxic)[able]
    weight = np.ones(len(texts))

    def telling(k: int) -> float:
        n = weight[places[k]].sum()
        p = n / (n + clean[k])
        if p <= base:
            return 0.0
        return n * np.log(p / base) + (clean[k] * np.log((1 - p) / (1 - base)) if clean[k] else 0)

    left = [(-telling(k), names[int(kinds[able[k]])], k) for k in range(len(able))]
    heapq.heapify(left)
    chosen: list[bytes] = []
    while left and len(chosen) < most:
        # evidence only falls: a word whose evidence is still what it was, or above the next one's, is the best
        old, name, k = heapq.heappop(left)
        now = -telling(k)
        if -now < certain:
            continue
        if left and now > left[0][0]:
            heapq.heappush(left, (now, name, k))
            continue
        chosen.append(name)
        weight[places[k]] *= EXPLAINED
    return [bytes([EDGE]) + w + bytes([EDGE]) for w in chosen]


def gapped(texts: list[str], landmarks: list[bytes]) -> list[str]:
    """The texts with every landmark word written with a letter put in, two put in, or one replaced by a sign, in turn and at one
    inner place after another."""
    known = {m[1:-1] for m in landmarks}
    seen: dict[str, bool] = {}
    out, turn = [], 0
    for text in texts:
        words = text.split(" ")
        for k, word in enumerate(words):
            if word not in seen:
                codes = letter_codes(np.frombuffer(word.encode(), np.uint8))
                seen[word] = codes[codes > 0].tobytes() in known
            if seen[word]:
                turn += 1
                at, other = 1 + turn % max(1, len(word) - 2), chr(97 + turn * 7 % 26)
                words[k] = (word[:at] + other + word[at:], word[:at] + "*" + word[at + 1 :], word[:at] + other + word[at:-1] + "-" + other + word[-1:])[turn % 3]
        out.append(" ".join(words))
    return out


def fit(texts: list[str], labels: list[int], rounds: int = 4) -> Model:
    """A model from labelled rows. Toxic rows are learnt a second time with their telling words written with gaps."""
    y = np.asarray(labels)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(level=float(np.log(share / (1 - share))))
    if len(set(labels)) == 2:
        model.landmarks = choose_landmarks(texts, labels)
    model.prepare()
    if not model.landmarks:
        return model
    again = gapped([t for t, own in zip(texts, labels, strict=True) if own], model.landmarks)
    each = np.concatenate([np.where(y == 1, 0.5, 1.0), np.full(len(again), 0.5)])
    texts, y = [*texts, *again], np.concatenate([y, np.ones(len(again), y.dtype)])
    m = len(model.landmarks)
    grid = np.array([[i, j] for i in range(m) for j in range(m)])
    own = kernel(letters([model.landmarks[i] for i in grid[:, 0]], -1), letters([model.landmarks[j] for j in grid[:, 1]], -2)).reshape(m, m)
    size, vectors = np.linalg.eigh((own / np.sqrt(np.outer(np.diag(own), np.diag(own)))) ** POWER)
    model.root = vectors / np.sqrt(np.maximum(size, 1e-3))
    of, rows = [], []
    for a in range(0, len(texts), 400):
        words = Words(*utf8(pa.array(texts[a : a + 400], pa.string())))
        t, r = sentences(model, words, *values(model, words))
        of.append(t + a)
        rows.append(r)
    of, raw = np.concatenate(of), np.concatenate(rows)
    x = (raw @ model.root).astype(np.float32)
    look = raw.max(1, initial=0)
    plain = np.bincount(of, minlength=len(y)) == 0
    for _ in range(rounds):
        # of toxic rows the worst sentence and all that look bad, of others every near sentence; and rows without any near one
        order = np.lexsort((-look, of))
        worst = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])] if len(order) else order
        bad = np.union1d(worst, np.flatnonzero(look > 0.5))
        rows_p, rows_n = bad[y[of[bad]] == 1], np.flatnonzero(y[of] == 0)
        points = np.concatenate([x[rows_p], x[rows_n], np.zeros((2, m), np.float32)])
        sign = np.concatenate([np.ones(len(rows_p)), -np.ones(len(rows_n)), [1, -1]])
        # either side counts the same in all, as sentences of toxic rows are few
        mass = np.concatenate([np.full(len(rows_p), 1.0), np.full(len(rows_n), 1.0), [(plain & (y == 1)).sum(), (plain & (y == 0)).sum()]])
        for side in (1, -1):
            mass[sign == side] /= max(1.0, mass[sign == side].sum())
        model.weights, model.bias = _machine(points, sign, mass)
        look = x @ model.weights + model.bias
    del of, raw, x
    parts = [utf8(pa.array(texts[a : a + 400], pa.string())) for a in range(0, len(texts), 400)]
    model.slope, model.level = _calibrated(np.concatenate([evidence(model, *part) for part in parts]), y, each, model.level)
    return model


def evidence(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What a text's score is made of: the margins of its worst sentences and of its worst words, each word as a sentence of its
    own, and, below zero, how many words it has, as long texts hold words near a landmark by chance."""
    words, n = Words(data, offsets), len(offsets) - 1
    kind, table = values(model, words)
    plane = model.root @ model.weights
    text, rows = sentences(model, words, kind, table)
    near = np.flatnonzero(kind >= 0)
    alone = (table @ plane + model.bias)[kind[near]]
    return np.concatenate([
        _worst(text, rows @ plane + model.bias, n, model.bias, WORST),
        _worst(words.text[near], alone, n, model.bias, WORST_WORDS),
        -np.log1p(np.bincount(words.text, minlength=n))[:, None],
    ], 1)


def _worst(of: np.ndarray, margin: np.ndarray, n: int, bias: float, most: int) -> np.ndarray:
    """The largest margins of each text, the largest first; a text with fewer has the bias for the rest."""
    out = np.full((n, most), bias)
    above = np.flatnonzero(margin > bias)  # lower ones count as the bias
    of, margin = of[above], margin[above]
    order = np.lexsort((-margin, of))
    rank = np.arange(len(order)) - np.searchsorted(of[order], of[order], "left")
    top = rank < most
    out[of[order][top], rank[top]] = margin[order][top]
    return out


def _calibrated(x: np.ndarray, y: np.ndarray, each: np.ndarray, level: float, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps over the weights that are free, as none but the level may fall below zero; a step that
    does not raise the likelihood is halved. ``each`` is how much a row counts."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.concatenate([np.zeros(x.shape[1]), [level]])

    def likelihood(w: np.ndarray) -> float:
        z = x1 @ w
        return float((each * (y * z - np.logaddexp(0, z))).sum() - ridge / 2 * w @ w)

    best = likelihood(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        up = x1.T @ (each * (y - p)) - ridge * w
        free = np.flatnonzero((w > 0) | (up > 0) | (np.arange(len(w)) == len(w) - 1))
        part = x1[:, free]
        step = np.zeros(len(w))
        step[free] = np.linalg.solve((part * (each * p * (1 - p))[:, None]).T @ part + ridge * np.eye(len(free)), up[free])
        for half in range(30):
            new = w + step / 2**half
            new[:-1] = np.maximum(new[:-1], 0)
            value = likelihood(new)
            if value > best:
                break
        else:
            break
        done, w, best = value - best < 1e-9 * abs(best), new, value
        if done:
            break
    return w[:-1], float(w[-1])


def _machine(x: np.ndarray, sign: np.ndarray, mass: np.ndarray, ridge: float = 1e-3, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps over the points inside the margin; ``mass`` counts equal points."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    total, w = mass.sum(), np.zeros(x1.shape[1])
    penalty = ridge * np.concatenate([np.ones(x.shape[1]), [0]])
    for _ in range(rounds):
        short = 1 - sign * (x1 @ w)
        inside = short > 0
        part, m = x1[inside], mass[inside].astype(x1.dtype)
        h = 2 * ((part * m[:, None]).T @ part).astype(float) / total + np.diag(penalty + 1e-9)
        new = np.linalg.solve(h, 2 * part.T @ (m * sign[inside]) / total)
        w, old = new, w
        if np.allclose(w, old, atol=1e-4):
            break
    return w[:-1], float(w[-1])


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = evidence(model, data, offsets) @ model.slope if model.landmarks else np.zeros(len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(found + model.level, -30, 30)))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows of ``docs`` with their score: a map, without a shuffle."""
    if name in docs.columns:
        raise ValueError(f"a column is named {name} already; give the score another name")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, text_col, 4 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(shared.value, data, offsets))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def predicted(score: str = "score") -> Column:
    return (F.col(score) >= THRESHOLD).cast("int")
