"""Toxicity: a sparse linear classifier that is regularised by counterfactual identity swaps.

**Features** of a text are the distinct lower-cased words (runs of letters) and their beginnings and ends of a few
letters, hashed into ``SPACE`` numbers, and whether one, two or three (``TIMES``) distinct words share
them: toxic words of one stem count, whatever their endings and the length of the text.

**Fit.** At most ``TRAIN`` labelled texts, half of each class, those of smallest hash of doc_id; classes are weighted
back to their share among the labels.  Every one of them that names a group of people (``GROUPS``, fixed
values) gets ``SWAPS`` counterfactuals: each such term becomes another one of its list.  The objective is the logistic
loss, plus ``FAIR`` / 2 times the mean squared change of the score (log odds) between a text and its
counterfactuals, plus ``LASSO`` times the size of the weights.  A term that is frequent in toxic texts only because
they attack a group thus cannot carry weight that its counterparts do not carry, and neutral mentions stay low.
Features that tell the classes apart by less than ``SCREEN`` standard errors are left out beforehand.
The fit is accelerated proximal gradient on one matrix of bounded size.

**Score.** Each whole text is read once where it lies, without a shuffle; only weights that are not zero travel.

A text that is NULL or has no letter has no feature: its score is that of the intercept.  Labels that are NULL, that
belong to no or a NULL doc_id, or contradict each other for one doc_id, teach nothing; of rows with one doc_id the
smallest text is learned from.  Without labels of both classes every score is the share of label 1 (0.5 without any).
Repeated rows are scored alike.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN = 8000
SPACE = 1 << 20
EDGES = (3, 4, 5, 6, 7)
TIMES = 3
SCREEN = 3.0
LASSO = 5e-5
FAIR = 1.0
SWAPS = 2
STEPS = 400
THRESHOLD = 0.7
#: Words whose features a task keeps.
CACHE = 300_000
WORD = re.compile(r"[^\W\d_]+")

#: Names of groups of people; a term is swapped for others of its list.
GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("blacks", "whites", "asians", "latinos", "africans", "europeans", "arabs"),
    ("american", "mexican", "chinese", "german", "french", "russian", "turkish", "polish"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"), ("transgender", "cisgender"),
    ("blind", "deaf", "disabled"), ("immigrant", "native"), ("immigrants", "natives"), ("refugees", "citizens"),
    ("moslem", "christ", "jude", "hinduist", "katholik"), ("moslems", "christen", "juden", "hinduisten", "katholiken"),
    ("frau", "mann"), ("frauen", "männer"), ("ausländer", "inländer"), ("türken", "deutsche", "polen", "russen"),
    ("musulman", "chrétien", "juif", "catholique"), ("musulmans", "chrétiens", "juifs", "catholiques"),
    ("femme", "homme"), ("femmes", "hommes"), ("noirs", "blancs", "asiatiques", "arabes"),
    ("musulmán", "cristiano", "judío", "católico"), ("musulmanes", "cristianos", "judíos", "católicos"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("negros", "blancos", "asiáticos"),
)


def counterparts(groups: Sequence[Sequence[str]] = GROUPS, swaps: int = SWAPS) -> list[dict[str, str]]:
    """For each of ``swaps`` rounds, what a term becomes: others of its list, spread over it."""
    out = []
    for k in range(swaps):
        out.append({w: g[(i + 1 + k * max((len(g) - 1) // swaps, 1)) % len(g)] for g in groups for i, w in enumerate(g)})
    return out


def word_features(word: str) -> list[int]:
    parts = ["=" + word, *("<" + word[:n] for n in EDGES if len(word) > n), *(">" + word[-n:] for n in EDGES if len(word) > n)]
    return list({zlib.crc32(p.encode()) % SPACE for p in parts})


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features(words: Iterable[str]) -> np.ndarray:
    """The sorted distinct features of a set of words: what a word has, by how many of them have it."""
    base, n = np.unique(np.fromiter((f for w in words for f in word_features(w)), np.int64), return_counts=True)
    return np.sort(np.concatenate([base[n > k] * TIMES + k for k in range(TIMES)]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Rows:
    """Sparse rows of ones over numbered columns."""

    def __init__(self, rows: Sequence[np.ndarray], columns: np.ndarray):
        """``columns``: the sorted features that count."""
        at, keep = [], []
        for r in rows:
            place = np.searchsorted(columns, r)
            hit = place < len(columns)
            hit[hit] = columns[place[hit]] == r[hit]
            at.append(place[hit])
        keep = [len(a) for a in at]
        self.columns = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.rows = np.repeat(np.arange(len(at)), keep)
        self.shape = (len(at), len(columns))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], self.shape[0])

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, v[self.rows], self.shape[1])


def objective(w: np.ndarray, b: float, x: Rows, y: np.ndarray, weight: np.ndarray, pairs: tuple[Rows, Rows], fair: float):
    """Smooth part of the objective with its gradients for weights and intercept."""
    z = x.dot(w) + b
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    r = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
    grad = x.back(r)
    m = pairs[0].shape[0]
    if m and fair:
        change = pairs[1].dot(w) - pairs[0].dot(w)
        loss += fair / 2 * float((change ** 2).mean())
        grad = grad + fair / m * (pairs[1].back(change) - pairs[0].back(change))
    return loss, grad, float(r.sum())


class Classifier:
    def __init__(self, weights: dict[int, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    @classmethod
    def fit(cls, rows: Sequence[np.ndarray], labels: Sequence[int], share: float | None = None,
            pairs: Sequence[tuple[np.ndarray, np.ndarray]] = (), fair: float = FAIR, lasso: float = LASSO,
            screen: float = SCREEN, steps: int = STEPS) -> Classifier:
        """``share``: that of label 1 outside the sample; ``pairs``: features of texts and of their counterfactuals."""
        y = np.asarray(labels, np.float64)
        n1, n0 = y.sum(), len(y) - y.sum()
        share = share if share is not None else float(y.mean()) if len(y) else 0.5
        bounded = min(max(share, 1e-6), 1 - 1e-6)
        prior = float(np.log(bounded / (1 - bounded)))
        if not n1 or not n0:
            return cls({}, prior)
        every = np.concatenate(list(rows))
        in1 = np.bincount(np.concatenate([r for r, v in zip(rows, y) if v]), minlength=SPACE * TIMES) / n1
        in0 = np.bincount(np.concatenate([r for r, v in zip(rows, y) if not v]), minlength=SPACE * TIMES) / n0
        found = np.unique(every)
        p = (in1 * n1 + in0 * n0)[found] / len(y)
        z = (in1 - in0)[found] / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        columns = found[(np.abs(z) >= screen) & (p * len(y) >= 3)]
        x = Rows(rows, columns)
        both = Rows([a for a, _ in pairs], columns), Rows([b for _, b in pairs], columns)
        weight = np.where(y == 1, share / n1, (1 - share) / n0)
        # each feature is scaled by its frequency, so that rare and frequent ones move alike
        scale = 1 / np.sqrt(np.maximum(x.back(weight), 1e-4))
        v = np.random.default_rng(0).normal(size=len(columns) + 1)
        top = 1.0
        for _ in range(30):
            v /= max(np.linalg.norm(v), 1e-300)
            u = weight * (x.dot(v[:-1] * scale) + v[-1]) / 4
            out = x.back(u) * scale
            if both[0].shape[0]:
                d = fair / both[0].shape[0] * (both[1].dot(v[:-1] * scale) - both[0].dot(v[:-1] * scale))
                out = out + (both[1].back(d) - both[0].back(d)) * scale
            v = np.append(out, u.sum())
            top = max(np.linalg.norm(v), 1e-9)
        rate = 1 / (1.05 * top)
        w, b, w_old, b_old, t = np.zeros(len(columns)), prior, np.zeros(len(columns)), prior, 1.0
        for _ in range(steps):
            t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
            ahead, b_ahead = w + (t - 1) / t_next * (w - w_old), b + (t - 1) / t_next * (b - b_old)
            _, grad, grad_b = objective(ahead * scale, b_ahead, x, y, weight, both, fair)
            moved = ahead - rate * grad * scale
            w_old, b_old, t = w, b, t_next
            w, b = np.sign(moved) * np.maximum(np.abs(moved) - rate * lasso, 0), b_ahead - rate * grad_b
        final = w * scale
        return cls({int(c): float(v) for c, v in zip(columns, final) if v}, float(b))

    def score(self, own: Iterable[int]) -> float:
        """``own``: distinct features."""
        z = self.intercept + sum(map(lambda f: self.weights.get(f, 0.0), own))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def sample(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> tuple[DataFrame, float | None]:
    """Texts to learn from (doc_id, toxic, text), and the share of label 1 among all labels that count."""
    clear = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
             .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
             .where("toxic = _most").where(~held_out()).drop("_most"))
    n = {r.toxic: r["count"] for r in clear.groupBy("toxic").count().collect()}
    total = sum(n.values())
    chosen = None
    for label in (0, 1):
        some = clear.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train // 2)
        chosen = some if chosen is None else chosen.union(some)
    # at most ``train`` rows of two numbers
    texts = (docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
             .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    return texts, n.get(1, 0) / total if total else None


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN, fair: float = FAIR,
        groups: Sequence[Sequence[str]] = GROUPS) -> Classifier:
    texts, share = sample(docs, labels, train)
    swaps = counterparts(groups)

    def describe(batches):
        for batch in batches:
            labels, own, others = [], [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text_words(text)
                named = words & swaps[0].keys() if swaps else set()
                labels.append(label)
                own.append(features(words))
                others.append([features((words - named) | {s[w] for w in named}) for s in swaps] if named else [])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(own, pa.list_(pa.int64())),
                                              pa.array(others, pa.list_(pa.list_(pa.int64())))], names=["toxic", "own", "others"])

    table = (texts.orderBy("doc_id").select("toxic", "text")
             .mapInArrow(describe, "toxic int, own array<bigint>, others array<array<bigint>>").toArrow())
    rows = [np.asarray(x.values) for x in table.column("own")]
    pairs = [(r, np.asarray(o.values)) for r, other in zip(rows, table.column("others")) for o in other.values or ()]
    return Classifier.fit(rows, table.column("toxic").to_pylist(), share, pairs, fair)


def predict(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def run(batches):
        weights, intercept = shared.value
        sums: dict[int, list[float]] = {}  # what a word's feature adds when so many words have it
        for f in weights:
            sums[f // TIMES] = np.cumsum([weights.get(f // TIMES * TIMES + k, 0.0) for k in range(TIMES)]).tolist()
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(2).slice(at, 256).to_pylist():
                    on: Counter[int] = Counter()
                    for word in text_words(text):
                        own = known.get(word)
                        if own is None:
                            if len(known) >= CACHE:
                                known.clear()
                            own = known[word] = tuple(f for f in word_features(word) if f in sums)
                        if own:
                            on.update(own)
                    scores.append(intercept + sum(sums[f][min(n, TIMES) - 1] for f, n in sorted(on.items())))
            score = 1 / (1 + np.exp(-np.clip(np.array(scores, np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score),
                                              pa.array((score >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> DataFrame:
    return predict(docs, fit(docs, labels, train))
