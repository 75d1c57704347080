"""A quality classifier by Bradley-Terry ranking.

A text is a vector of measures that do not name its language or source.  Each labelled
text that is better is paired with each that is worse; the weights are those of least
logistic loss on differences of their vectors, which makes the score of one text its log-strength.
The threshold is the quantile of scores that the share of worse texts marks; it is put
at 0.7 of the scale from 0 to 1.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _linear as L
from .divergence import SYMBOLS, byte_kinds, duplicate_lines, repeated

OUT = "doc_id long, held_out boolean, score double, predicted int"
MAX_LABELLED = 20_000
THRESHOLD = 0.7


def measures(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    kinds = np.bincount(byte_kinds()[np.frombuffer(raw, np.uint8)], minlength=8) / size
    lower, lengths = [w.lower() for w in words], list(map(len, words))
    seen = Counter(lower)
    odd = sum(w[-1:] in (b"%", b"$", b"&", b"*", b"#", b"!", b"|") for w in words) / n
    shout = sum(w.isupper() and len(w) > 1 for w in words) / n
    lines = raw.split(b"\n")
    symbols = (len(raw) - len(raw.translate(None, SYMBOLS))) / size
    short = sum(x < 4 for x in lengths) / n
    again, twice = repeated(words) / n, duplicate_lines(raw) / len(lines)
    top = max(seen.values(), default=0) / n
    base = [*kinds.tolist(), odd, shout, symbols, short, again, twice, top, len(seen) / n]
    return [*base, *(np.sqrt(v) for v in (odd, shout, symbols, again, twice, kinds[5], kinds[6])), np.log1p(len(words)), np.log1p(len(words)) ** 2, sum(lengths) / n / 10, np.log1p(size / len(lines)), float(len(words) < 10), float(not words), float(again > 0.2), float(symbols > 0.05), float(shout > 0.3), float(short < 0.2)]


def _measured(texts: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([measures(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], ["x", "label"])

    return texts.mapInArrow(run, "x array<double>, label int")


class Model:
    """score() maps measures to 0..1; THRESHOLD is where the learnt quantile lies."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.sd, self.w, self.slope, self.cut = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), np.zeros(x.shape[1]), 1.0, 0.0) if len(x) else (0.0, 1.0, None, 1.0, 0.0)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.known = len(good) > 0 and len(bad) > 0
        if not self.known:
            return
        z = (x - self.mean) / self.sd
        self.w = L.pairwise(z[good], z[bad])
        u = z @ self.w
        self.cut = float(np.quantile(u, len(bad) / len(y)))
        self.slope = float(np.clip(L.logistic(np.column_stack([u - self.cut, np.ones(len(u))]), y)[0], 0.05, 5.0))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 0.5)
        u = (x - self.mean) / self.sd @ self.w
        return L.sigmoid(self.slope * (u - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, most: int = MAX_LABELLED) -> DataFrame:
    """Score of every whole text; ``predicted`` is 1 from 0.7 on.

    One row per input row: ``(doc_id, held_out, score, predicted)``.  Labels are learnt from at most ``most``
    labelled ids outside the held-out fold (crc32 of the id as text mod ``folds`` is ``held``); rows with a
    null id are never held out or learnt from; of a repeated id the least text is learnt from.  Null and empty texts are scored as texts without words.
    Without labels of both kinds every score is 0.5.  Of several labels of an id the greatest counts.
    Repeated rows are scored each; an empty table gives no rows; other columns are not read.
    """
    texts = L.texts_of(docs, L.learning_ids(labels, id_col, label_col, folds, held, most), id_col, text_col)
    rows = sorted((r["x"], r["label"]) for r in _measured(texts).collect())  # at most ``most``
    model = Model(np.array([x for x, _ in rows]), np.array([y for _, y in rows]))

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            score = model.score(np.array([measures(t) for t in b.column(1).to_pylist()])) if ids else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(L.held_out(ids, folds, held), pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)
