"""Quality classifier by co-training of two views.

One view sees the text: how often each class of byte follows each other one, how words repeat, how long
they are. The other sees metadata: source, language, stated length. Each is a logistic model. Over
``ROUNDS`` rounds, each view labels the documents of the whole corpus that it is sure of, and these join the training rows
of the other view. Both are calibrated on labelled rows held back from training, and a last small logistic
model combines the calibrated views. Every document is scored from its whole text.

The labelled rows are a sample of at most ``max_labelled`` documents, those with the least hash of their id. The pseudo-labels come
from all documents, without a bound: in each round one pass over the corpus' features, written once, sums the gradient of each view
over the documents that the other is sure of; the sums, a number for each weight, go to the driver, where a Newton step with the
curvature of the labelled rows follows. Pseudo-labels together weigh as much as the labelled rows at most.

Defined cases: a null text counts as empty; null metadata is a value of its own; a document labelled more than once
has the majority, a tie being good; without labels of both kinds every document gets the share of good labels as its score
(1 without labels).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import add_columns, remove, utf8, written
from tidemark.llm.words import words

MAX_LABELLED = 12_000
ROUNDS = 4
#: A view is sure of a document from this probability on, for either label.
SURE = 0.97
#: A document is rejected below this probability of being good: only where little doubt is left.
REJECT_BELOW = 0.05
#: Fewest held-back rows for calibration: one labelled row in so many.
HELD_BACK = 4
RIDGE = 1.0

#: Classes of bytes: any that isn't named is of class 0.
GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "#$%&*", "|", "()[]{}<>", "'\"-_/@")
CLASS = np.zeros(256, dtype=np.uint8)
for _k, _group in enumerate(GROUPS, 1):
    CLASS[list(_group.encode())] = _k
CLASS[128:] = len(GROUPS) + 1
KINDS = len(GROUPS) + 2
TEXT_SIZE = KINDS * KINDS + 6
SOURCES, LANGS = 64, 16
META_SIZE = SOURCES + LANGS + 3


def text_features(text: bytes, block: int = 1 << 20) -> np.ndarray:
    """The text view of one document, from all its bytes."""
    out = np.zeros(TEXT_SIZE)
    n = len(text)
    if not n:
        return out
    data = np.frombuffer(text, dtype=np.uint8)
    pairs = np.zeros(KINDS * KINDS)
    for low in range(0, n, block):  # in blocks, each with the first byte of the next
        kinds = CLASS[data[low : low + block + 1]].astype(np.int16)
        pairs += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
    # A short text says little, so its shares are drawn towards none.
    out[: KINDS * KINDS] = np.sqrt(pairs / (n + 64))
    found = words(text)
    count = len(found)
    if count:
        out[-6] = (count - len(set(found))) / (count + 12)
        out[-5] = sum(map(bytes.__eq__, found[1:], found)) / (count + 12)
        out[-4] = sum(map(len, found)) / (count + 12) / 10
    lines = text.split(b"\n")
    out[-3] = (len(lines) - len(set(lines))) / (len(lines) + 4)
    out[-2] = np.log1p(n) / 10
    out[-1] = np.log1p(count / len(lines)) / 5
    return out


def _bucket(value: str | None, size: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode()) % (size - 1)


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_SIZE)
    out[_bucket(source, SOURCES)] = 1
    out[SOURCES + _bucket(lang, LANGS)] = 1
    if n_chars is None:
        out[-1] = 1
    else:
        size = np.log1p(max(0, n_chars)) / 10
        out[-3:-1] = size, size * size
    return out


@dataclass
class Logistic:
    weights: np.ndarray  # the last is the intercept

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> Logistic:
    """Penalised maximum likelihood by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(w)


@dataclass
class Model:
    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic
    constant: float | None = None

    def __call__(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of both views, calibrated, and the combined one."""
        if self.constant is not None:
            flat = np.full(len(text), self.constant)
            return flat, flat, flat
        a = self.text_scale(self.text.logit(text)[:, None])
        b = self.meta_scale(self.meta.logit(meta)[:, None])
        return a, b, self.both(_logits(a, b))


def _logits(*scores: np.ndarray) -> np.ndarray:
    return np.stack([np.log(np.clip(s, 1e-6, 1 - 1e-6) / np.clip(1 - s, 1e-6, 1)) for s in scores], axis=1)


@dataclass
class View:
    """One view's labelled rows and its model so far."""

    x: np.ndarray
    label: np.ndarray
    back: np.ndarray
    back_label: np.ndarray
    model: Logistic
    scale: Logistic

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray, held: np.ndarray) -> View:
        model = fit_logistic(x[~held], label[~held])
        view = cls(np.hstack([x[~held], np.ones(((~held).sum(), 1))]), label[~held], x[held], label[held], model, model)
        view.calibrate()
        return view

    def calibrate(self) -> None:
        self.scale = fit_logistic(self.model.logit(self.back)[:, None], self.back_label, ridge=1e-3)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scale(self.model.logit(x)[:, None])

    def step(self, slope: np.ndarray, count: int, ridge: float = RIDGE) -> None:
        """One Newton step for the labelled rows and ``count`` pseudo-labelled ones, whose gradient is ``slope``."""
        w = self.model.weights
        p = 1 / (1 + np.exp(-np.clip(self.x @ w, -35, 35)))
        share = min(1.0, len(self.label) / max(1, count))
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        curve = (self.x * (p * (1 - p) + 1e-9)[:, None]).T @ self.x * (1 + share * count / len(self.label)) + np.diag(penalty)
        self.model = Logistic(w + np.linalg.solve(curve, self.x.T @ (self.label - p) + share * slope - penalty * w))
        self.calibrate()


def slopes(text: np.ndarray, meta: np.ndarray, views: dict[str, View], sure: float = SURE) -> dict[str, np.ndarray]:
    """For each view the gradient over the rows that the other is sure of, and last how many these are."""
    rows = {"text": text, "meta": meta}
    score = {name: view.score(rows[name]) for name, view in views.items()}
    out = {}
    for name, other in (("text", "meta"), ("meta", "text")):
        new = (score[other] >= sure) | (score[other] <= 1 - sure)
        x = rows[name][new]
        miss = np.rint(score[other][new]) - views[name].model(x)
        out[name] = np.concatenate((x.T @ miss, [miss.sum(), new.sum()]))
    return out


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, held: np.ndarray, pool, rounds: int = ROUNDS) -> Model:
    """Fit on labelled rows, of which those ``held`` back serve calibration only.

    ``pool`` takes the views and returns their ``slopes`` over all documents.
    """
    if min(len(set(label[~held])), len(set(label[held]))) < 2:
        none = Logistic(np.zeros(1))
        return Model(none, none, none, none, none, float(label.mean()) if len(label) else 1.0)
    views = {"text": View.fit(text, label, held), "meta": View.fit(meta, label, held)}
    for _ in range(rounds):
        found = pool(views)
        for name, view in views.items():
            view.step(found[name][:-1], int(found[name][-1]))
    both = fit_logistic(_logits(views["text"].score(text[held]), views["meta"].score(meta[held])), label[held], ridge=1e-2)
    return Model(views["text"].model, views["meta"].model, views["text"].scale, views["meta"].scale, both)


def _features(docs: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    return add_columns(docs, ["text", "source", "lang", "n_chars"], fields, make, drop=("text", "source", "lang", "n_chars"))


def _views(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_features(t) for t in utf8(texts)]).reshape(-1, TEXT_SIZE)
    meta = [meta_features(*m) for m in zip(sources.to_pylist(), langs.to_pylist(), sizes.to_pylist(), strict=True)]
    return text, np.array(meta).reshape(-1, META_SIZE)


PACKED = [T.StructField("of_text", T.BinaryType()), T.StructField("of_meta", T.BinaryType())]


def _packed():
    """Both views of a row as 16-bit floats, which is exact enough for shares."""

    def apply(*columns: pa.Array) -> list:
        return [pa.array([r.tobytes() for r in part.astype("<f2")], pa.binary()) for part in _views(*columns)]

    return apply


def _matrix(packed: list[bytes] | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed if isinstance(packed, list) else packed.to_pylist()), dtype="<f2").reshape(-1, width).astype(np.float64)


def _over(features: DataFrame, views: dict[str, View]) -> dict[str, np.ndarray]:
    """``slopes`` summed over all rows of the features: a row for each weight and task, then one for each weight."""
    sent = features.sparkSession.sparkContext.broadcast({name: replace(v, x=v.x[:0], back=v.back[:0]) for name, v in views.items()})

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                found = slopes(_matrix(part.column(0), TEXT_SIZE), _matrix(part.column(1), META_SIZE), sent.value)
                total = {name: total.get(name, 0.0) + found[name] for name in found}
        for name, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(sums)), pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["view", "place", "part"])

    found = features.mapInArrow(run, "view string, place int, part double").groupBy("view", "place").agg(F.sum("part").alias("whole"))
    out = {"text": np.zeros(TEXT_SIZE + 2), "meta": np.zeros(META_SIZE + 2)}
    for r in found.collect():  # a number for each weight
        out[r["view"]][r["place"]] = r["whole"]
    return out


def fit(docs: DataFrame, labels: DataFrame, folder: str, max_labelled: int = MAX_LABELLED) -> Model:
    """Co-train on a bounded sample of labelled documents and on all documents; features are written below ``folder``."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.when(F.avg("quality") >= 0.5, 1.0).otherwise(0.0).alias("label")
    )
    order = F.xxhash64("doc_id", F.lit(11))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    labelled = F.broadcast(known.join(ids, "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_labelled))  # at most max_labelled rows
    path = f"{folder}/features"
    features = written(_features(docs.select("doc_id", "text", "source", "lang", "n_chars"), PACKED, _packed), path)
    # Of rows that share an id one teaches, so that what reaches the driver is bounded whatever repeats.
    one = features.join(labelled, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("of_text", "of_meta")).alias("x"))
    rows = one.select(order.alias("place"), "label", "x.of_text", "x.of_meta").toArrow()
    rows = rows.sort_by([("place", "ascending"), ("of_text", "ascending")]).to_pydict()
    text, meta = _matrix(rows["of_text"], TEXT_SIZE), _matrix(rows["of_meta"], META_SIZE)
    held = np.array(rows["place"], dtype=np.int64) // 1000 % HELD_BACK == 0
    model = co_train(text, meta, np.array(rows["label"], dtype=np.float64), held, lambda views: _over(features.select("of_text", "of_meta"), views))
    remove(docs.sparkSession, path)
    return model


SCORES = [T.StructField(c, T.DoubleType()) for c in ("text_score", "meta_score", "score")]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``text_score``, ``meta_score`` and ``score``, the probability that a document is good, to every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def start():
        return lambda *columns: [pa.array(s) for s in sent.value(*_views(*columns))]

    return add_columns(docs, ["text", "source", "lang", "n_chars"], SCORES, start)
