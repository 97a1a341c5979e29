"""Toxicity by compression distance to two zstandard dictionaries.

Both dictionaries end in the same content, trained on ordinary text; the toxic
one begins with content trained on toxic text, the ordinary one with as many
line feeds, so that what ordinary text explains costs the same in both. Every
window of a document is compressed with each; a window that the toxic one
shortens by a calibrated number of bytes counts as toxic. How the windows
compare over a whole document (the largest difference, and how many windows lie
above each of some thresholds) is turned into a probability by a logistic fit,
shifted so that the best threshold on the sample is 0.5.

Windows are single words in lower case: insults are words, and in longer
windows the chance of matching something ordinary drowns them. The toxic
training text is words too, and beginnings of words, those that a
likelihood-ratio test finds over-represented in toxic texts: trained on whole toxic texts, a dictionary
holds what is frequent in any text (the README has the figures). zstandard
stores inputs of a few bytes as they are and starts no match in the last bytes
of a block, so a window is compressed between two fixed marks that both
dictionaries hold. A process remembers the differences of words that it has met.

What is learnt comes from a bounded sample of labelled rows: up to TRAIN_ROWS
ids; the words of their texts are counted on the cluster, one text of each set
of near copies, and only up to TOXIC_WORDS and ORDINARY_WORDS words are
gathered. Every document is scored by its whole text.

A text without words (null, empty, only marks) has no window and gets the score
of a text in which no window differs; the same words have the same score. Very
long texts are scored one at a time. Repeated rows are scored each; of rows that
share a labelled id, the one with the least hash of its text is learnt from.
Without labels of both kinds every score is 0.5. An empty table gives no rows.
Kept columns may have any names; the three that are added are named by the caller.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_slices
from .fitting import labelled_sample, labelled_texts, logistic, one_an_id, scored
from .merging import Remembered

TRAIN_ROWS = 16_000
TOXIC_WORDS = 512
ORDINARY_WORDS = 30_000
FOLDS, HELD_OUT = 5, 0
#: A word is characteristic of toxic text from this likelihood-ratio statistic on (1 degree of freedom, one in a thousand).
LEAST_EVIDENCE = 10.83
LEAST_TEXTS = 3
#: Lengths of the beginnings of words that are tested beside whole words.
BEGINNINGS = (6, 7, 8)
#: Near copies share so many least hashes of their words, and so much of the words themselves.
SHARED_HASHES, NEAR_COPY = 3, 0.8
TOXIC_DICTIONARY, ORDINARY_DICTIONARY = 8 << 10, 96 << 10
BEFORE, AFTER = b"\n~~ window ~~\n", b"\n~~ end ~~\n"
MARKS = BEFORE + AFTER
THRESHOLDS = (1, 2, 3, 4, 5, 6)
N_FEATURES = 2 + 2 * len(THRESHOLDS)
WORD = re.compile(r"[^\W\d_]+")
SPLIT = r"[^\p{L}]+"


def apart(texts: DataFrame) -> DataFrame:
    """Rows (id, label y, sorted ``words``) without those whose words are nearly those of a kept row of the same label."""
    keys = [f"k{seed}" for seed in range(SHARED_HASHES)]
    sets = texts.groupBy("y", "words").agg(F.min("id").alias("id"))
    least = [F.array_min(F.transform("words", lambda w: F.xxhash64(w, F.lit(seed)))).alias(k) for seed, k in enumerate(keys)]
    sets = cut(sets.select("*", *least))
    firsts = sets.groupBy("y", *keys).agg(F.min(F.struct("id", "words")).alias("first"))
    paired = sets.join(firsts, ["y", *keys])
    alike = F.size(F.array_intersect("words", "first.words")) / F.size(F.array_union("words", "first.words"))
    return paired.filter((F.col("words") == F.col("first.words")) | (alike < NEAR_COPY)).select("id", "y", "words")


def _beginnings(words: str, n: int) -> Column:
    """The first ``n`` letters of longer words."""
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.substring(w, 1, n))


def characteristic_words(texts: DataFrame) -> tuple[list[str], list[str]]:
    """Words, or beginnings of words, over-represented in toxic texts, and the most common words of ordinary ones. ``texts`` has id, text and a label y."""
    texts = cut(apart(texts.select("id", "y", F.array_sort(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), SPLIT))).alias("words"))))
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return [], []
    begun = F.array_except(F.array_distinct(F.concat(*(_beginnings("words", n) for n in BEGINNINGS))), "words")
    marked = F.concat(F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(1).alias("whole"))), F.transform(begun, lambda w: F.struct(w.alias("word"), F.lit(0).alias("whole"))))
    counts = texts.select("y", F.explode(marked).alias("w")).select("y", "w.*").filter("word <> ''")
    counts = counts.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"), F.max("whole").alias("whole"))
    a, b = F.col("a"), F.col("b")

    def part(k, n, p):
        """n Bernoulli trials with k successes: log likelihood, 0 log 0 being 0."""
        return k * F.ln(F.greatest(p, F.lit(1e-12))) + (n - k) * F.ln(F.greatest(1 - p, F.lit(1e-12)))

    both = (a + b) / (n1 + n0)
    evidence = 2 * (part(a, n1, a / n1) + part(b, n0, b / n0) - part(a, n1, both) - part(b, n0, both))
    counts = cut(counts.withColumn("evidence", evidence))
    toxic = counts.filter((a >= LEAST_TEXTS) & (a * n0 > b * n1) & (F.col("evidence") >= LEAST_EVIDENCE)).orderBy(F.desc("evidence"), "word").limit(TOXIC_WORDS).collect()
    ordinary = counts.filter((b > 0) & (F.col("whole") > 0)).orderBy(F.desc("b"), "word").limit(ORDINARY_WORDS).collect()
    known = {r["word"] for r in toxic}
    return [r["word"] for r in toxic], [r["word"] for r in ordinary if r["word"] not in known]


def train_pair(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary."""
    own = train_dictionary(toxic, TOXIC_DICTIONARY, 20)
    own += b"".join([x for x in map(window_of, toxic) if x not in own])  # the trainer drops some short ones
    common = train_dictionary(ordinary, ORDINARY_DICTIONARY, 2) + MARKS
    return own + common, b"\n" * len(own) + common


def window_of(word: str) -> bytes:
    return b" " + word.encode("utf-8", "replace") + b" "


def train_dictionary(words: list[str], size: int, repeat: int) -> bytes:
    """Content of a zstandard dictionary trained on windows of ``words``, each given ``repeat`` times, in a fixed order."""
    import zstandard

    order = np.random.default_rng(11)
    samples = [window_of(words[i]) for _ in range(repeat) for i in order.permutation(len(words))]
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself
        return b"".join(map(window_of, words))


class Distance(Remembered):
    """Bytes that a window takes beyond the toxic dictionary's when the ordinary one compresses it."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        super().__init__()
        settings = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.toxic, self.ordinary = (
            zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings).compress for content in (toxic, ordinary)
        )

    def work(self, word: str) -> int:
        window = BEFORE + window_of(word) + AFTER
        return len(self.ordinary(window)) - len(self.toxic(window))

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(N_FEATURES)
        words = WORD.findall(text.lower()) if text else []
        if words:
            found = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
            over = [int((found >= t).sum()) for t in THRESHOLDS]
            out[0] = found.max()
            out[1] = np.partition(found, max(0, len(found) - 3))[-3:].mean()
            out[2 : 2 + len(over)] = np.log1p(over)
            out[2 + len(over) :] = np.sqrt(np.array(over) / len(words))
        return out


_distances: dict[tuple[bytes, bytes], Distance] = {}


def distance_of(toxic: bytes, ordinary: bytes) -> Distance:
    """The process's distance of a pair of dictionaries; what it remembers lasts over tasks."""
    if (toxic, ordinary) not in _distances:
        _distances.clear()
        _distances[toxic, ordinary] = Distance(toxic, ordinary)
    return _distances[toxic, ordinary]


class Model:
    """Two dictionaries and a logistic curve over the features of a document."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = toxic, ordinary
        self.mean, self.spread = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.weights = np.zeros(N_FEATURES + 1)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(set(y.tolist())) < 2:
            return
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._columns(x)
        self.weights = logistic(z, y.astype(float), ridge=1e-3)
        p = self.score(x)
        order = np.argsort(p)
        right = np.cumsum(y[order] == 0) + (y.sum() - np.cumsum(y[order] == 1))  # if all above this one are called toxic
        i = int(np.argmax(right))
        cut_at = (p[order][i] + p[order][min(i + 1, len(p) - 1)]) / 2
        self.weights[-1] -= np.log(cut_at / (1 - cut_at))  # the best threshold becomes 0.5

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self._columns(x) * self.weights).sum(axis=1), -30, 30)))


def _feature_rows(texts: DataFrame, model: Model) -> DataFrame:
    """id, y, order and features of labelled texts."""
    shared = texts.sparkSession.sparkContext.broadcast((model.toxic, model.ordinary))

    def run(batches):
        distance = distance_of(*shared.value)
        for batch in in_slices(batches):
            rows = np.concatenate([distance.features(t) for t in batch.column("text").to_pylist()])
            offsets = pa.array(np.arange(0, len(rows) + 1, N_FEATURES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "y", "order")), pa.ListArray.from_arrays(offsets, pa.array(rows))], names=["id", "y", "order", "features"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "y", "order", "text").mapInArrow(run, f"id {kind}, y int, order long, features array<double>")


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    texts = labelled_texts(documents, labelled_sample(labels, "toxic", FOLDS, HELD_OUT, rows, id_col), id_col, text_col)
    toxic, ordinary = characteristic_words(texts)
    model = Model(*train_pair(toxic, ordinary))
    if toxic:
        x, y = one_an_id(_feature_rows(texts, model))
        model.calibrate(x.reshape(-1, N_FEATURES), y)
    return model


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """``keep`` columns (else id_col) of every row, and, named by ``names``, held_out, score and predicted (1: score >= 0.5)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score():
        model = shared.value
        distance = distance_of(model.toxic, model.ordinary)
        return lambda texts: model.score(np.array([distance.features(t) for t in texts]).reshape(-1, N_FEATURES))

    return scored(documents, score, 0.5, id_col, text_col, keep, (FOLDS, HELD_OUT), names)
