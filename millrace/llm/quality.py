"""Quality scores learnt from pairwise preferences (Bradley-Terry).

A document has a strength, linear in features of its text; the chance that one
is preferred to another is the logistic function of the difference of their
strengths. The weights minimise the logistic loss over preference pairs, each a
good and a poor labelled document, on the differences of their features. The
score is the quantile of a document's strength among the labelled ones, bent so
that the quantile at which documents are rejected is the score 0.7.

The pairs come from a bounded sample of labelled rows (TRAIN_ROWS); every
document is scored by its whole text. Null and empty texts have features of
their own and a score like all others; very long texts are read whole, one at a
time; repeated rows are scored each. Of rows that share a labelled id, the one
with the least hash of its text is learnt from. Equal texts have equal scores.
Without labels of both kinds all documents are good. An empty table gives no
rows. Kept columns may have any names; the three that are added are named by the
caller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices
from .fitting import labelled_sample, labelled_texts, logistic, one_an_id, scored

TRAIN_ROWS = 20_000
PAIRS = 60_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
KNOTS = 512

_kind = np.zeros(256, dtype=np.uint8)
UPPER, LOWER, DIGIT, BLANK, LINE, STOP, SHOUT, RULE, MARK, WIDE = range(10)
_kind[:] = WIDE
for _c in range(128):
    _ch = chr(_c)
    _kind[_c] = (
        UPPER if _ch.isupper() else LOWER if _ch.islower() else DIGIT if _ch.isdigit() else LINE if _ch == "\n" else BLANK if _ch.isspace() else STOP if _ch in ".,;:" else SHOUT if _ch in "!?" else RULE if _ch in "|<>{}[]=_*#~^\\/@" else MARK
    )
N_FEATURES = 22


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes, the shape of words and lines, and how much repeats."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(N_FEATURES)
    out[0] = len(raw) == 0
    if not raw:
        return out
    kinds = np.bincount(_kind[np.frombuffer(raw, dtype=np.uint8)], minlength=10)
    n = len(raw)
    out[1:11] = np.sqrt(kinds / n)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_words = max(1, len(words))
    out[11] = np.log1p(n_words)
    out[12] = np.log(n / n_words)
    out[13] = np.log1p(n_words / max(1, len(lines)))
    out[14] = 1 - len(set(lines)) / max(1, len(lines))
    out[15] = min(1.0, np.log1p(len(set(words))) / np.log1p(n_words))
    sentences = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    out[16] = np.log1p(n_words / (1 + sentences))
    out[17] = kinds[UPPER] / max(1, kinds[UPPER] + kinds[LOWER])
    short = [w for w in words if len(w) <= 3]
    out[18] = len(short) / n_words
    out[19] = len(set(short)) / max(1, len(short))
    pairs = set(zip(words, words[1:], words[2:]))
    out[20] = 1 - len(pairs) / max(1, len(words) - 2)
    out[21] = np.log(max(map(len, words), default=1))
    return out


def feature_rows(texts: DataFrame) -> DataFrame:
    """id, y, order and features of labelled texts."""

    def run(batches):
        for batch in in_slices(batches):
            rows = np.concatenate([features(t) for t in batch.column("text").to_pylist()])
            offsets = pa.array(np.arange(0, len(rows) + 1, N_FEATURES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "y", "order")), pa.ListArray.from_arrays(offsets, pa.array(rows))], names=["id", "y", "order", "features"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "y", "order", "text").mapInArrow(run, f"id {kind}, y int, order long, features array<double>")


class Model:
    """Standardisation, weights, and the strengths at evenly spaced quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
        self.spread = x.std(axis=0) + 1e-6 if len(x) else np.ones(N_FEATURES)
        self.weights = np.zeros(N_FEATURES)
        good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if len(good) and len(poor):
            z = (x - self.mean) / self.spread
            pick = np.random.default_rng(seed)
            a, b = z[pick.choice(good, PAIRS)], z[pick.choice(poor, PAIRS)]
            turned = np.arange(PAIRS) % 2 == 0  # half of the pairs name the poor document first
            self.weights = logistic(np.where(turned[:, None], b - a, a - b), (~turned).astype(float), ridge=1e-3)
        s = np.sort(self.strength(x)) if len(x) else np.zeros(1)
        self.knots = np.quantile(s, np.linspace(0, 1, KNOTS))
        self.cut = self._best_cut(self.quantile(self.strength(x)), y) if len(good) and len(poor) else 0.0

    @staticmethod
    def _best_cut(q: np.ndarray, y: np.ndarray) -> float:
        """The quantile whose threshold has the best balanced accuracy on the sample, half-way to the next document."""
        order = np.argsort(q, kind="stable")
        poor = np.cumsum(y[order] == 0) / max(1, (y == 0).sum())
        good = np.cumsum(y[order] == 1) / max(1, (y == 1).sum())
        last = np.append(np.flatnonzero(np.diff(q[order]) > 0), len(q) - 1)
        i = int(last[np.argmax((poor - good)[last])])
        return float((q[order][i] + q[order][min(i + 1, len(q) - 1)]) / 2)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (((x - self.mean) / self.spread) * self.weights).sum(axis=1)  # row by row: the same text gives the same bits in any batch

    def quantile(self, strength: np.ndarray) -> np.ndarray:
        """Share of labelled documents that are weaker; beyond both ends it goes on, ever more slowly."""
        inner = np.interp(strength, self.knots, np.linspace(0.05, 0.95, KNOTS))
        width = max(1e-9, self.knots[-1] - self.knots[0])
        below, above = np.maximum(0, self.knots[0] - strength) / width, np.maximum(0, strength - self.knots[-1]) / width
        return inner - 0.05 * below / (1 + below) + 0.05 * above / (1 + above)

    def score(self, x: np.ndarray) -> np.ndarray:
        q = self.quantile(self.strength(x))
        cut = min(max(self.cut, 1e-6), 1 - 1e-6)
        return np.where(q < cut, THRESHOLD * q / cut, THRESHOLD + (1 - THRESHOLD) * (q - cut) / (1 - cut))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    sample = labelled_sample(labels, "quality", FOLDS, HELD_OUT, rows, id_col)
    x, y = one_an_id(feature_rows(labelled_texts(documents, sample, id_col, text_col)))
    return Model(x.reshape(-1, N_FEATURES), y)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """``keep`` columns (else id_col) of every row, and, named by ``names``, held_out, score and predicted (1: score >= 0.7)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def of_texts(texts: list[str | None]) -> np.ndarray:
        return shared.value.score(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES))

    return scored(documents, lambda: of_texts, THRESHOLD, id_col, text_col, keep, (FOLDS, HELD_OUT), names)
