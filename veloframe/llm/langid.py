"""Language identification by unigrams of pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary file, whose place is a parameter.  A word is
a lower-cased run of letters with the word mark in front; its probability in a language is
the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities,
which a forward pass computes.  A text's score is the product over its words.  Piece
probabilities are fitted per language by expectation maximisation (forward-backward over
the words of the sample, weighted by their counts) and mixed with a share ``SHARED`` of
the mean of all languages, so no piece is impossible.

Fitting uses about ``TRAIN`` labelled texts per language, drawn by a hash of doc_id among
those not held out; each language is one group of that bounded size.  Prediction reads every
whole text where it lies.  A task keeps scores of words it has met in a table of bounded
size.  Runs of more than ``LONGEST`` letters are cut there.

A text that is NULL or has no letter is ``und`` with score 0.  The score is the posterior of
the predicted language under equal priors; ties go to the first language by name.  Rows
with NULL doc_id are neither held out nor learned from, as are rows with NULL lang or text.
Without any labelled text, every text is ``und``.  Repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

TRAIN = 400
ROUNDS = 5
SHARED = 0.02
UNKNOWN = 1e-7
LONGEST = 40
CACHE = 250_000
MARK = "▁"
WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def vocabulary(path: str) -> list[str]:
    """Pieces of letters, with or without the word mark, lower-cased, in the file's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return list(dict.fromkeys(p for p in every if p.replace(MARK, "", 1).isalpha() or p == MARK))


def beginnings(number: dict[str, int]) -> dict[str, int]:
    """Every beginning of a piece, with the piece's number or -1 where it is none itself."""
    out = {p[:k]: -1 for p in number for k in range(1, len(p))}
    return out | number


class Lattice:
    """All segmentations of a list of words, as edges sorted by their end and length."""

    def __init__(self, words: Sequence[str], starts: dict[str, int], unknown: int):
        """``starts``: see :func:`beginnings`; ``unknown``: the number of a letter that is no piece."""
        edges = []  # end, length, word and piece in one number
        add, get = edges.append, starts.get
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        for r, w in enumerate(words):
            marked = MARK + w
            n, row = len(marked) + 1, r << 16
            for i in range(n - 1):
                first = True
                for j in range(i + 1, n):
                    p = get(marked[i:j])
                    if p is None:
                        if first:
                            add((j * 64 + 1 << 40) + row + unknown)
                        break
                    if p >= 0:
                        add((j * 64 + j - i << 40) + row + p)
                    elif first:
                        add((j * 64 + 1 << 40) + row + unknown)
                    first = False
        packed = np.sort(np.array(edges, np.int64))
        keys, self.rows, self.pieces = packed >> 40, packed >> 16 & 0xFFFFFF, packed & 0xFFFF
        kinds, starts = np.unique(keys, return_index=True)
        self.steps = [(int(k) // 64, int(k) % 64, slice(a, b)) for k, a, b in
                      zip(kinds, starts.tolist(), [*starts[1:].tolist(), len(keys)])]

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, word, language) sums, and each word's probability.  ``p``: piece x language."""
        alpha = np.zeros((LONGEST + 2, len(self.sizes), p.shape[1]))
        alpha[0] = 1.0
        for end, length, own in self.steps:  # a word has one edge of a given end and length
            rows = self.rows[own]
            alpha[end, rows] += alpha[end - length, rows] * p[self.pieces[own]]
        return alpha, alpha[self.sizes, np.arange(len(self.sizes))]

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece under ``p``, each word counted ``weight`` times."""
        alpha, total = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[self.sizes, np.arange(len(self.sizes))] = (weight / total[:, 0])[:, None]
        out = np.zeros(len(p))
        for end, length, own in reversed(self.steps):
            rows, pieces = self.rows[own], self.pieces[own]
            flow = beta[end, rows] * p[pieces]
            beta[end - length, rows] += flow
            np.add.at(out, pieces, (alpha[end - length, rows] * flow)[:, 0])
        return out


def fit_pieces(counts: Counter, number: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language; the last entry is the unknown letter."""
    words, starts = sorted(counts), beginnings(number)
    if len(number) >= 1 << 16:
        raise ValueError("a vocabulary of at most 65,535 pieces is expected")
    p = np.full((len(number) + 1, 1), 1.0 / max(len(number), 1))
    p[-1] = UNKNOWN
    for _ in range(rounds):
        uses = np.zeros(len(p))
        for at in range(0, len(words), 20_000):
            part = words[at:at + 20_000]
            uses += Lattice(part, starts, len(number)).expected(p, np.array([counts[w] for w in part], np.float64))
        own = uses[:-1] + 1e-9
        p = np.concatenate([own / own.sum(), [UNKNOWN]])[:, None]
    return p[:, 0]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, path: str, train: int = TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities (piece x language)."""
    known = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = saved(known.groupBy("lang").count(), "languages")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(train * float(1 << 20)) / F.col("count")
    sample = known.join(sizes, "lang").where(share).select("lang", "text")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = vocabulary(path)
        number = {p: i for i, p in enumerate(pieces)}
        counts: Counter = Counter()
        for text in pdf["text"]:
            counts.update(WORD.findall(text.lower()))
        p = fit_pieces(counts, number)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "p": [p.tolist()], "n": [sum(counts.values())]})

    got = sorted((r.lang, r.p) for r in sample.groupBy("lang").applyInPandas(learn, "lang string, p array<double>, n long")
                 .where("n > 0").collect())
    if not got:
        return [], np.zeros((0, 0))
    own = np.array([p for _, p in got]).T
    return [lang for lang, _ in got], (1 - SHARED) * own + SHARED * own.mean(axis=1, keepdims=True) + 1e-12


def predict(docs: DataFrame, languages: list[str], p: np.ndarray, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        number = {x: i for i, x in enumerate(vocabulary(path))}
        starts, unknown = beginnings(number), len(number)
        known: dict[str, int] = {}
        scores = np.zeros((0, len(languages)))

        def learn(new: list[str]) -> np.ndarray:
            parts = []
            for at in range(0, len(new), 20_000):
                _, total = Lattice(new[at:at + 20_000], starts, unknown).forward(shared.value)
                parts.append(np.log(np.maximum(total, 1e-300)))
            return np.concatenate(parts)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [WORD.findall((t or "").lower()) for t in part.column(2).to_pylist()]
                if len(known) > CACHE:
                    known, scores = {}, scores[:0]
                if languages:
                    new = sorted(set().union(*words) - known.keys())
                    if new:
                        known.update(zip(new, range(len(known), len(known) + len(new))))
                        scores = np.concatenate([scores, learn(new)])
                langs, sure = [], []
                for own in words:
                    if not languages or not any(c.isalpha() for w in own for c in w):  # signs such as ½ are no letters
                        langs.append("und")
                        sure.append(0.0)
                        continue
                    total = scores[[known[w] for w in own]].sum(axis=0)
                    best = int(total.argmax())
                    langs.append(languages[best])
                    sure.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()),
                                                  pa.array(sure, pa.float64())],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, path: str, train: int = TRAIN) -> DataFrame:
    languages, p = fit(docs, path, train)
    return predict(docs, languages, p, path)
