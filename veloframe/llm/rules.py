"""Quality rules: a linear-chain conditional random field labels lines content or boilerplate.

Each line gets binary features from its form (length, signs, digits, capitals, cells,
repetition inside the line and the text, legal phrases, closing mark).  The field has two
labels, weights per feature and label, and transition weights; it is fitted by gradient
ascent on the conditional likelihood (forward-backward) over at most ``TRAIN`` labelled
texts, the smallest by a hash of doc_id.  Lines of trusted texts are content unless a legal
phrase marks them; lines of rejected texts are boilerplate.  Viterbi decoding gives the
most likely labels of a text, and the characters of content lines over those of all lines
with a word decide: below ``SHARE`` the text goes.

Base counts follow fixed rules over whole texts and do not depend on the field; a text that
fails them goes in any case.  Each text is read once where it lies, without a shuffle.

Null texts have no words and no lines: all counts are 0 and the text fails.  Repeated rows
and ties are judged alike.  Without any labelled text the field says content to all.
Labels that are NULL, or contradict each other for one doc_id, train nothing.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes

WINDOW = 8
TRAIN = 1500
SHARE = 0.5
STEPS = 80
#: Signs that count as symbols.
SIGNS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
#: Phrases of legal and service lines.
LEGAL = re.compile(rb"licen[sc]ed under|all rights reserved|copyright|terms of (use|service)|cookie|privacy policy"
                   rb"|spdx-license|without warranty", re.I)
N_FEATURES = 18


def line_features(line: bytes, repeated: bool) -> int:
    """The binary features of one line as bits of a number."""
    words = line.split()
    n = len(words)
    if not n:
        return 1 | 2
    size = sum(map(len, words))
    signs = len(line) - len(line.translate(None, SIGNS))
    digits = len(line) - len(line.translate(None, b"0123456789"))
    capitals = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    kinds = len(set(words))
    on = (True, False, n <= 2, 3 <= n <= 7, 8 <= n <= 30, n > 30, signs * 20 > size, signs * 4 > size,
          digits * 5 > size, capitals * 2 > size, b" | " in line or b"\t" in line, repeated, n > 5 and kinds * 2 < n,
          n > 5 and kinds * 5 < n, LEGAL.search(line) is not None, line.rstrip()[-1:] in b".!?:;\"", size > 12 * n,
          b"!!" in line)
    return sum(1 << k for k, yes in enumerate(on) if yes)


def text_features(text: bytes) -> tuple[list[int], list[int], int]:
    """Features and characters of each line, and how many lines with a word repeat an earlier one."""
    seen: set[bytes] = set()
    masks, chars, dups = [], [], 0
    for line in text.split(b"\n"):
        word = bool(line.strip(SPACES))
        again = word and line in seen
        dups += again
        if word:
            seen.add(line)
        masks.append(line_features(line, again))
        chars.append(len(line) if word else 0)
    return masks, chars, dups


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    view = np.lib.stride_tricks.sliding_window_view(ids, window)
    a, b = order[:-1][same], order[1:][same]
    if (view[a] == view[b]).all():
        hit = np.zeros(n, bool)
        hit[a] = hit[b] = True
    else:  # two windows share a hash: count the windows themselves
        _, inverse, counts = np.unique(view, axis=0, return_inverse=True, return_counts=True)
        hit = counts[inverse.ravel()] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(hit)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _bits(masks) -> np.ndarray:
    return ((np.asarray(masks, np.int64)[..., None] >> np.arange(N_FEATURES)) & 1).astype(np.float64)


class Field:
    """Two labels: 0 boilerplate, 1 content."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @classmethod
    def fit(cls, sequences: list[tuple[list[int], list[int]]], steps: int = STEPS, rate: float = 0.1,
            ridge: float = 1e-3, width: int = 32) -> Field:
        """Adam on the penalised log likelihood; long sequences are split into stretches of ``width``."""
        parts = [(m[i:i + width], y[i:i + width]) for m, y in sequences for i in range(0, len(m), width)]
        weights, moves = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        if not parts:
            weights[0, 1] = 1.0
            return cls(weights, moves)
        length = max(len(m) for m, _ in parts)
        x = np.zeros((len(parts), length, N_FEATURES))
        y = np.zeros((len(parts), length), np.int64)
        live = np.zeros((len(parts), length), bool)
        for i, (m, own) in enumerate(parts):
            x[i, :len(m)], y[i, :len(m)], live[i, :len(m)] = _bits(m), own, True
        one = np.eye(2)[y] * live[..., None]
        pair = live[:, 1:]
        seen_moves = np.einsum("nti,ntj->ij", one[:, :-1] * pair[..., None], one[:, 1:])
        seen = np.einsum("ntf,nti->fi", x, one)
        moment, square = 0.0, 0.0
        total = live.sum()
        for step in range(1, steps + 1):
            score = x @ weights
            fore = np.empty_like(score)
            back = np.zeros_like(score)
            fore[:, 0] = score[:, 0]
            for t in range(1, length):
                reach = np.logaddexp.reduce(fore[:, t - 1, :, None] + moves, axis=1) + score[:, t]
                fore[:, t] = np.where(live[:, t, None], reach, fore[:, t - 1])
            for t in range(length - 2, -1, -1):
                reach = np.logaddexp.reduce(moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
                back[:, t] = np.where(live[:, t + 1, None], reach, back[:, t])
            norm = np.logaddexp.reduce(fore[:, -1], axis=1)
            p = np.exp(fore + back - norm[:, None, None]) * live[..., None]
            both = np.exp(fore[:, :-1, :, None] + moves + (score + back)[:, 1:, None, :] - norm[:, None, None, None])
            both = (both * pair[..., None, None]).sum(axis=(0, 1))
            slope = np.concatenate([(seen - np.einsum("ntf,nti->fi", x, p)) / total - ridge * weights,
                                    (seen_moves - both) / total - ridge * moves])
            moment = 0.9 * moment + 0.1 * slope
            square = 0.99 * square + 0.01 * slope ** 2
            move = rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
            weights, moves = weights + move[:N_FEATURES], moves + move[N_FEATURES:]
        return cls(weights, moves)

    def decode(self, masks: list[int]) -> list[int]:
        """The most likely labels (Viterbi); a tie goes to content."""
        if not masks:
            return []
        score = (_bits(masks) @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        low, high = score[0]
        back = []
        for s0, s1 in score[1:]:
            from0, from1 = high + m10 >= low + m00, high + m11 >= low + m01
            back.append((from0, from1))
            low, high = (high + m10 if from0 else low + m00) + s0, (high + m11 if from1 else low + m01) + s1
        label = int(high >= low)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit_field(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> Field:
    """The field of at most ``train`` labelled texts; only their features reach the driver."""
    sample = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
              .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train).select("doc_id", F.col("lo").alias("quality")))
    rows = docs.select("doc_id", text_bytes().alias("text")).where("text is not null").join(F.broadcast(sample), "doc_id")

    def make():
        def features(quality, text):
            masks = text_features(text)[0]
            return [(quality, masks, [int(quality == 1 and not m >> 14 & 1) for m in masks])]

        return features

    got = map_rows(rows.select("quality", "text"), make, "quality int, masks array<int>, y array<int>").collect()
    return Field.fit(sorted((r.masks, r.y) for r in got))


def judge(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """The base counts, base_failed, content_share and kept of every row of ``docs``."""
    def make():
        def measure(doc_id, text):
            text = text or b""
            words = text.split()
            n = len(words)
            spaces = len(text) - len(text.translate(None, SPACES))
            word_chars = len(text.decode()) - spaces
            signs = len(text) - len(text.translate(None, SIGNS))
            masks, chars, dups = text_features(text)
            repeats = repeated_words(words)
            failed = n < 20 or 100 * repeats > 30 * n
            total = sum(chars)
            own = sum(c for c, y in zip(chars, field.decode(masks)) if y)
            part = own / total if total else 0.0
            return [(doc_id, n, word_chars, signs, dups, repeats, failed, not failed and part >= share, part)]

        return measure

    return map_rows(docs.select("doc_id", text_bytes().alias("text")), make,
                    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                    "n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def apply_rules(docs: DataFrame, labels: DataFrame, train: int = TRAIN, share: float = SHARE) -> DataFrame:
    return judge(docs, fit_field(docs, labels, train), share)
