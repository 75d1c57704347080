"""Toxicity by weak supervision.

Many voters each look for one thing: a stem of a lexicon (fixed, and mined from labelled
texts in any language), or a pattern (shouting, a run of marks, an address to the reader,
a text with nothing of the kind).  A generative label model holds that each voter votes at
one rate on toxic texts and at another on others, and that voters which go together within
either label share one vote; the rates are estimated by expectation maximisation over
texts with and without a label.  The annotator who labelled texts is one more voter, of
known accuracy.  A linear classifier, which does not see that voter, is trained on the
posterior labels of all these texts; its scale is set on the labelled ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _linear as L

OUT = "doc_id long, held_out boolean, score double, predicted int"
MAX_LABELLED = MAX_UNLABELLED = 20_000
#: How often a given label is right.
ANNOTATOR = 0.999999
STEM = (4, 5, 6, 7, 8)
THRESHOLD = 0.7

# Insults that vote in English texts without being mined.
LEXICON = ("idiot", "moron", "stupid", "imbecile", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "filth", "vermin")
PATTERNS = (
    ("shouting", re.compile(r"(?:\b[A-Z]{3,}\b\W*){4}")),
    ("marks", re.compile(r"[!?]{3}")),
    ("address", re.compile(r"\b(?:you|your|du|dein|tu|ton|usted) (?:are|is|bist|es|all)\b", re.I)),
    ("threat", re.compile(r"\b(?:kill|hate|destroy|hurt)\b", re.I)),
)
WORD = re.compile(r"[^\W\d_]+")


def stems(text: str | None) -> set[str]:
    """Words of a text and their beginnings of some lengths; whole words end in a blank."""
    found = set(WORD.findall((text or "").lower()))
    return {w + " " for w in found} | {w[:k] for w in found for k in STEM if len(w) > k}


def mine(sample: DataFrame, least: float = 0.02, odds: float = 20.0) -> list[str]:
    """Stems that a share ``least`` of toxic texts have (so at most 1 / least times the stems of one text) and others hardly do, the shortest that serve."""

    def run(batches):
        count: dict[str, list[int]] = {}
        n = [0, 0]

        def rows():
            for i in range(0, len(items := list(count.items())), 100_000):
                part = items[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], ["stem", "other", "toxic"])
            count.clear()

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[label] += 1
                for s in stems(text):
                    count.setdefault(s, [0, 0])[label] += 1
                if len(count) > 500_000:
                    yield from rows()
        count[""] = n
        yield from rows()

    toxic = F.col("label") == 1
    rows = sample.select("text", "label").mapInArrow(run, "stem string, other long, toxic long").groupBy("stem").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    total = sample.agg(F.count(F.when(~toxic, 1)).alias("other"), F.count(F.when(toxic, 1)).alias("toxic")).first()
    if not total["toxic"] or not total["other"]:
        return []
    ratio = (F.col("toxic") + 0.5) / (F.col("other") + 0.5) * (total["other"] / total["toxic"])
    best = rows.where((F.col("stem") != "") & (F.col("toxic") >= max(3, least * total["toxic"])) & (ratio >= odds)).select("stem").collect()
    known = {r["stem"] for r in best}
    return sorted(s for s in known if not any(s[:k] in known for k in STEM if k < len(s)))


def voters(stem_list: list[str]):
    """A function from a text to (words, hits of each stem voter, whether each pattern fires)."""
    import ahocorasick

    known = list(dict.fromkeys([*(w + " " for w in LEXICON), *stem_list]))
    machine = ahocorasick.Automaton()
    at: dict[str, list[int]] = {}
    for i, s in enumerate(known):
        at.setdefault(s.strip(), []).append(i)
    for s, ids in at.items():
        machine.add_word(s, (len(s), ids))
    machine.make_automaton()

    def vote(text: str | None):
        text = text or ""
        low = text.lower()
        hits: dict[int, int] = {}
        for end, (size, ids) in machine.iter(low):
            if end >= size and _letter(low[end - size]):
                continue
            after = end + 1 < len(low) and _letter(low[end + 1])
            for i in ids:
                if not (known[i].endswith(" ") and after):
                    hits[i] = hits.get(i, 0) + 1
        return len(text.split()), hits, [bool(p.search(text)) for _, p in PATTERNS]

    return known, vote


def _letter(c: str) -> bool:
    return WORD.match(c) is not None


class LabelModel:
    """How often each voter votes on toxic texts and on others, and groups of voters that share one vote."""

    def __init__(self, fired: np.ndarray, hint: np.ndarray, rounds: int = 15, together: float = 0.3):
        """fired: (texts, voters) 0/1; hint: how likely each text is toxic as the estimation begins, 0 or 1 where the annotator labelled it.

        The annotator is one more voter, who is right with probability ANNOTATOR and abstains on other texts.
        """
        hint = np.asarray(hint, float)
        self.groups = self._groups(fired, hint, together)
        annotator = np.where(hint == 1, 1, np.where(hint == 0, -1, 0)) * np.log(ANNOTATOR / (1 - ANNOTATOR))
        q = np.clip(hint, 0.02, 0.98)
        for _ in range(rounds):
            self.prior = float(np.clip(q.mean(), 1e-3, 0.999))
            self.rates = [(fired.T @ w + 0.5) / (w.sum() + 1) for w in (q, 1 - q)]
            self.told = q = L.sigmoid(self.log_odds(fired) + annotator)

    @property
    def accuracy(self) -> np.ndarray:
        """How likely a text is toxic by each voter's vote alone."""
        toxic, other = self.rates
        return self.prior * toxic / (self.prior * toxic + (1 - self.prior) * other)

    @staticmethod
    def _groups(fired: np.ndarray, hint: np.ndarray, together: float) -> np.ndarray:
        """(voters, groups) 0/1: voters are in one group if they correlate within the texts of either label, or others link them."""
        n = fired.shape[1]
        linked = np.eye(n, dtype=bool)
        for within in (hint == 1, hint == 0):
            x = fired[within].astype(float)
            often = np.flatnonzero(x.sum(axis=0) >= 5)
            if len(often):
                x = x[:, often] - x[:, often].mean(axis=0)
                cov = x.T @ x
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                linked[np.ix_(often, often)] |= cov / np.outer(sd, sd) > together
        group = np.arange(n)
        while True:
            least = np.where(linked, group, n).min(axis=1)
            if (least == group).all():
                return (group[:, None] == np.unique(group)).astype(np.float32)
            group = least

    def log_odds(self, fired: np.ndarray) -> np.ndarray:
        """The prior's, and of each group the mean of the voters that voted, or of all of them if none did."""
        toxic, other = self.rates
        vote, silence = np.log(toxic / other), np.log((1 - toxic) / (1 - other))
        voted = fired @ self.groups
        said = (fired * vote) @ self.groups / np.maximum(voted, 1)
        unsaid = silence @ self.groups / self.groups.sum(axis=0)
        return np.log(self.prior / (1 - self.prior)) + said.sum(axis=1) + (voted == 0) @ unsaid

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        return L.sigmoid(self.log_odds(fired))


def learning_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int, most: int, unlabelled: int) -> DataFrame:
    """(text, label): distinct texts of at most ``most`` labelled ids and of at most ``unlabelled`` ids of any kind, label null where not given; all outside the held-out fold."""
    named = L.learning_ids(labels, id_col, label_col, folds, held, most)
    i = F.col(id_col)
    free = docs.select(i.alias("id")).where(i.isNotNull() & L.outside(i, folds, held)).distinct().orderBy(F.xxhash64("id"), "id").limit(unlabelled)
    ids = named.union(free.select("id", F.lit(None).cast("int").alias("label"))).groupBy("id").agg(F.max("label").alias("label"))
    return L.texts_of(docs, ids, id_col, text_col).groupBy("text").agg(F.max("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, most: int = MAX_LABELLED, unlabelled: int = MAX_UNLABELLED):
    """A function from a list of texts to their scores, learnt as classify() says; null and empty texts, repeats and ties included."""
    from ._exchange import written

    sample = written(learning_texts(docs, labels, id_col, text_col, label_col, folds, held, most, unlabelled))
    known, _ = voters(found := mine(sample.where("label is not null")))
    width = len(known) + len(PATTERNS) + 1

    def ballots(texts: list) -> tuple[np.ndarray, np.ndarray]:
        _, vote = voters(found)
        fired, counts = np.zeros((len(texts), width), np.float32), np.zeros((len(texts), 3))
        for row, text in enumerate(texts):
            n, hits, patterns = vote(text)
            fired[row, list(hits)] = 1
            fired[row, len(known) : -1] = patterns
            fired[row, -1] = not hits
            counts[row] = n, sum(hits.values()), len(hits)
        return fired, counts

    def features(model: LabelModel, fired: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n, hits, kinds = counts.T
        own = [model.log_odds(fired), np.log1p(hits), np.log1p(kinds), np.sqrt(hits / np.maximum(n, 1)), np.ones(len(n))]
        return np.column_stack([*own, fired])

    def cast(batches):
        for b in batches:
            fired, counts = ballots(b.column(0).to_pylist())
            on = [np.flatnonzero(f).astype(np.int32) for f in fired]
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.list_(pa.int32())), pa.array(counts.tolist(), pa.list_(pa.float64())), b.column(1)], ["fired", "counts", "label"])

    rows = sorted(((r["fired"], r["counts"], -1 if r["label"] is None else r["label"]) for r in sample.mapInArrow(cast, "fired array<int>, counts array<double>, label int").collect()))  # at most most + unlabelled
    fired, label = np.zeros((len(rows), width), np.float32), np.array([r[2] for r in rows])
    for i, r in enumerate(rows):
        fired[i, r[0]] = 1
    given = label >= 0
    if {0, 1} <= set(label.tolist()):
        model = LabelModel(fired, np.where(given, label, label[given].mean()))
        x = features(model, fired, np.array([r[1] for r in rows]))
        weights = L.logistic(x, model.told)
        scale, shift = L.logistic(np.column_stack([x[given] @ weights, np.ones(given.sum())]), label[given], ridge=0.1)
        weights = max(scale, 0.05) * weights
        weights[4] += shift  # of the column of ones
    else:
        model = LabelModel(np.eye(width, dtype=np.float32), np.zeros(width), rounds=1)
        model.prior, model.groups = 0.1, np.eye(width, dtype=np.float32)
        model.rates = [np.r_[np.full(len(known), p), np.full(len(PATTERNS), 0.01), r] for p, r in ((0.3, 0.1), (0.003, 0.9))]
        weights = np.eye(1, 5 + width)[0]

    def score(texts: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return L.sigmoid(features(model, *ballots(texts)) @ weights)

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, most: int = MAX_LABELLED, unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """Score of every whole text; ``predicted`` is 1 from 0.7 on.

    One row per input row: ``(doc_id, held_out, score, predicted)``.  Labels are used of at most ``most`` labelled
    ids outside the held-out fold (crc32 of the id as text mod ``folds`` is ``held``): to mine stems, as votes and to set the scale; the label model sees the texts of at most ``unlabelled`` ids beside.  Rows with a null id are never held out or learnt from.  Null and empty texts have no
    votes but that nothing was found.  Without labels of both kinds only the fixed lexicon and the patterns
    vote, at even odds against the prior of one in ten.  Of several labels of an id the greatest counts.
    Repeated rows are scored each; an empty table gives no rows; other columns are not read.
    """
    score = fit(docs, labels, id_col, text_col, label_col, folds, held, most, unlabelled)

    def run(batches):
        for b in batches:
            got = score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(L.held_out(b.column(0).to_pylist(), folds, held), pa.bool_()), pa.array(got, pa.float64()), pa.array((got >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, most: int = MAX_LABELLED, unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is under 0.7.

    Rows are judged each by their whole text, as classify() does: rows with a null id, null and
    empty texts too; equal texts share one fate.  An empty table gives no rows.
    """
    score, at = fit(docs, labels, id_col, text_col, label_col, folds, held, most, unlabelled), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(score(b.column(at).to_pylist()) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
