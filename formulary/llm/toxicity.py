"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on what sets toxic texts apart and one on ordinary text. A
window of a text is one word, framed by a marker. Its gain is how many bytes shorter it becomes with the
toxic dictionary than with the ordinary one, and than with a short dictionary that holds hardly more than
the frame. A document is the joint histogram of its windows' gains; weights and threshold of that
histogram are calibrated on labelled documents.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FRAME = b"\x01\x02\x03\x04\x05"
TOP = 10  # gains are counted as 0 .. TOP - 1 bytes
CACHED_WORDS = 150_000
CACHED_BYTES = 40
LEVEL = 6
SHORT_BYTES = 256
# Sizes of the toxic and the ordinary dictionary to choose from, on TRIED labelled texts of each class.
SIZES = ((256, 2048), (384, 2048), (512, 2048), (768, 2048), (1024, 2048), (1024, 8192), (2048, 8192))
TRIED = 300


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), of letters outside and inside ASCII."""
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


def _wilson(k: int, n: int, sign: int, z: float = 3.0) -> float:
    """Lower (-1) or upper (+1) confidence bound of the rate k / n."""
    p = k / n
    return (p + z * z / (2 * n) + sign * z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _heads(word: bytes) -> set[bytes]:
    framed = b" " + word + b" "
    return {framed[:k] for k in range(4, min(len(framed), 10) + 1)}


def _samples(words: list[bytes], size: int = 8) -> list[bytes]:
    return [FRAME + FRAME.join(words[i : i + size]) + FRAME for i in range(0, len(words), size)]


def _dictionary(size: int, words: list[bytes]) -> bytes:
    """A trained dictionary that ends with the frame; its plain words where there is too little to train on."""
    try:
        trained = zstd.train_dictionary(size, _samples(words), k=16, d=8).as_bytes()
    except zstd.ZstdError:
        trained = FRAME + FRAME.join(dict.fromkeys(words))[: size - 2]
    return trained + FRAME + FRAME


class Gains(dict):
    """word -> its gains as one code, TOP * gain over ordinary + gain over short; bounded in size."""

    def __init__(self, toxic: bytes, ordinary: bytes, short: bytes):
        super().__init__()
        flags = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.by = [
            zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d), **flags) for d in (toxic, ordinary, short)
        ]

    def __missing__(self, word: bytes) -> int:
        window = FRAME + FRAME + word + FRAME
        toxic, ordinary, short = (len(c.compress(window)) for c in self.by)
        code = TOP * max(0, min(TOP - 1, ordinary - toxic)) + max(0, min(TOP - 1, short - toxic))
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = code
        return code


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    short: bytes
    weights: list[float] = field(default_factory=list)
    without_gain: float = 0.0  # log odds of texts in which no window gains

    def log_odds(self, words: list[bytes], gains: Gains) -> float:
        found = _features(words, gains)
        return float(found @ np.array(self.weights)) if found[GAINED] else self.without_gain

    def gains(self) -> Gains:
        return Gains(self.toxic, self.ordinary, self.short)


GAINED = TOP + 1  # place of the windows that gain at least a byte over both dictionaries


def _features(words: list[bytes], gains: Gains) -> np.ndarray:
    """log(1 + windows with at least i and j bytes of gain) for all i, j, the log of all windows, and 1."""
    codes = np.fromiter(map(gains.__getitem__, words), dtype=np.int64, count=len(words))
    counts = np.bincount(codes, minlength=TOP * TOP).reshape(TOP, TOP)
    least = counts[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
    return np.append(np.log1p(least.ravel()), 1.0)


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.5, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps, for the unscaled columns of `x`."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[-1], scale[-1] = 0.0, 1.0
    z = (x - mean) / scale
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (share * (p - y)) + ridge * w
        curve = (z * (share * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    out = w / scale
    out[-1] -= float(out[:-1] @ mean[:-1])
    return out


def _separation(model: Model, plain: list[list[bytes]], toxic: list[list[bytes]]) -> float:
    """How well the number of windows that gain over both dictionaries tells two lists of texts apart, 0 to 1."""
    gains = model.gains()
    least = np.minimum(np.arange(TOP * TOP) // TOP, np.arange(TOP * TOP) % TOP)
    found = [[least[[gains[w] for w in words] or [0]] for words in docs] for docs in (plain, toxic)]
    best = 0.0
    for level in (2, 3, 4):
        low, high = (np.array([(g >= level).sum() for g in docs]) for docs in found)
        low = np.sort(low)
        under, upto = (np.searchsorted(low, high, side) for side in ("left", "right"))
        best = max(best, float((under + upto).mean() / (2 * len(low))))
    return best


def fit(texts: list[str | None], labels: list[int], toxic_share: float, seed: int = 0) -> Model:
    """Train dictionaries and calibration on labelled texts; `toxic_share` is the rate among all labelled rows."""
    docs, y = [words_of(t) for t in texts], np.array(labels, float)
    n_toxic, n_plain = int(y.sum()), int(len(y) - y.sum())
    if not n_toxic or not n_plain:  # nothing to tell apart: every document scores as the labels do
        odds = 30.0 if n_toxic else -30.0
        return Model(FRAME + FRAME, FRAME + FRAME, FRAME + FRAME, [0.0] * (TOP * TOP) + [odds], odds)
    heads = Counter(), Counter()
    for words, label in zip(docs, labels):
        heads[label].update(set().union(*map(_heads, set(words))) if words else ())
    low = {h: _wilson(k, n_toxic, -1) for h, k in heads[1].items() if k > 2}
    high = {h: _wilson(heads[0][h], n_plain, 1) for h in low}
    telling = {h: math.log(low[h] / high[h]) for h in low if low[h] > 3 * high[h]}
    rng = random.Random(seed)
    stems: Counter = Counter()
    plain: list[bytes] = []
    for words, label in zip(docs, labels):
        for w in words:
            found = [h for h in _heads(w) if h in telling]
            if found and label:
                stems[max(found, key=lambda h: (telling[h], len(h), h)).strip()] += 1
            elif not found and not label:
                plain.append(w)
    strong = [s for s in sorted(stems) for _ in range(200)] or [b"\x06"]
    rng.shuffle(strong)
    rng.shuffle(plain)
    short = _dictionary(SHORT_BYTES, plain[:20_000])[: -10 - 60] + FRAME + FRAME
    tried = [[w for w, label in zip(docs, labels) if label == kind][:TRIED] for kind in (0, 1)]
    made = (Model(_dictionary(a, strong), _dictionary(b, plain[:20_000]), short) for a, b in SIZES)
    model = max(made, key=lambda m: _separation(m, *tried))
    gains = model.gains()
    x = np.array([_features(words, gains) for words in docs])
    share = np.where(y == 1, toxic_share * len(y) / n_toxic, (1 - toxic_share) * len(y) / n_plain)
    model.weights = _logistic(x, y, share).tolist()
    quiet = x[:, GAINED] == 0
    rate = (share[quiet] @ y[quiet] + toxic_share / 2) / (share[quiet].sum() + 1)
    model.without_gain = math.log(rate / (1 - rate))
    return model


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int) -> tuple[list, list, float]:
    """At most `per_class` labelled documents of each class, of at most `max_chars` characters each.

    Chosen by hash among the rows whose crc32(doc_id as text) mod 5 is not 0, so reruns agree. The rate of
    toxic rows is counted over all of them. Repeated or contradicting labels of a doc_id count as the largest.
    """
    known = (
        labels.select("doc_id", "toxic")
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(cast(cast(doc_id AS string) AS binary)) % 5 != 0")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    rates = known.groupBy("toxic").count().collect()  # two rows
    counts = {r["toxic"]: r["count"] for r in rates}
    picked = [
        r["doc_id"]
        for label in sorted(counts)
        for r in known.filter(F.col("toxic") == label)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(per_class)
        .select("doc_id")
        .collect()
    ]
    if not picked:
        return [], [], 0.0
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in picked], "doc_id bigint"))  # at most 2 * per_class ids
    labelled = wanted.join(known, "doc_id")
    rows = (
        docs.select("doc_id", "text")
        .filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(labelled), "doc_id")
        .dropDuplicates(["doc_id"])
        .select("doc_id", "text", "toxic")
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["toxic"] for r in rows], counts.get(1, 0) / sum(counts.values())


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_chars: int = 50_000) -> Model:
    """The model for `docs`, from a bounded sample of its labelled rows (see training_sample)."""
    texts, marks, share = training_sample(docs, labels, per_class, max_chars)
    return fit(texts, marks, share)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text; no shuffle.

    Null and empty texts have no window. A text in which no window gains, as they, gets the rate of toxic ones
    among such texts in training. Repeated rows stay
    repeated, null ids stay null, further columns are left out.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = model.gains()
        for batch in batches:
            z = np.array([model.log_odds(words_of(t.as_py()), gains) for t in batch.column("text")], float)
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(score, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_chars: int = 50_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, by a model of its own labels.

    Training runs when this is called: two small jobs over `labels` and one scan of `docs`.
    """
    scored = score_texts(docs, train(docs, labels, per_class, max_chars))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, unchanged, whose score is below `threshold`; no shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = model.gains()
        limit = math.log(threshold / (1 - threshold))
        for batch in batches:
            kept = [model.log_odds(words_of(t.as_py()), gains) < limit for t in batch.column("text")]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
