"""Quality classifier by co-training on two views: a text's content, and its page's metadata.

The content view hashes words and counts bytes. The metadata view has language, source, both together and the recorded
length, and never reads the text. Each view has a logistic classifier fitted to labelled rows, and is calibrated on
labelled rows that none is fitted to. Over ``ROUNDS`` rounds, each view scores all documents outside the sample
and gives the other one those that it is surest of, as pseudo-labels in the proportion of the classes: ``ADDED`` a round
at most, and none below a calibrated probability of ``SURE``, at the prior of the corpus; so a weak view teaches little.
A pseudo-label weighs ``PSEUDO_WEIGHT`` of a label. The views are combined as independent evidence: their log-odds are
added and the prior's taken off once. A view takes the lesson of a round if that lowers the combined loss on the rows held
out; documents of a lesson that doesn't are not offered again.

The bounds of what is fitted: ``MAX_LABELLED`` labelled rows of documents that exist, half of either class if there are
as many, those with the least hashed ids; and the pseudo-labels. Search for these and scoring cover all documents, in
place: a task keeps its ``ADDED`` surest documents of each kind, and these few are merged. The models are a few thousand
numbers, whatever the corpus. Margins are compared in steps of 0.001, then by id, so that reruns agree.

Defined results: a null or empty text has a content view of zeros; null language, source and length have values of
their own; rows with a null or repeated id are scored row by row; of rows with one id the least by text, language,
source and length is fitted; labels other than 0 and 1, or null, are not used, nor are those of no document; a document
with contradictory labels counts once for each. Without ``MIN_CLASS`` rows of either class nothing can be learnt, and
every score is the share of label 1, or 0.5 without labels. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import pieces

MAX_LABELLED, ROUNDS, ADDED, MIN_CLASS = 4000, 5, 200, 10
#: The least calibrated probability of a pseudo-label, and its weight beside a label.
SURE, PSEUDO_WEIGHT = 0.95, 0.2
WORD_BINS, META_BINS, HELD_OUT = 512, 128, 5
#: Documents are kept from this score on. Below one half, as a good document lost costs more than a poor one kept.
KEEP_SCORE = 0.25
#: Lengths are told apart in powers of two.
LENGTHS = 24
_TEXT, _META = WORD_BINS + 256, META_BINS + LENGTHS + 2


def content_view(text: str | None) -> np.ndarray:
    """Hashed word counts and byte counts, as roots of shares."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(_TEXT, np.float32)
    words = data.lower().split()
    digests = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))
    bins = np.bincount(digests % WORD_BINS, minlength=WORD_BINS) / max(1, len(words))
    both = np.r_[bins, np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)]
    return np.sqrt(both).astype(np.float32)


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language, source and both, and the recorded length: its power of two and its logarithm."""
    out = np.zeros(_META, np.float32)
    for value in (f"lang={lang}", f"source={source}", f"both={lang}={source}"):
        out[xxhash.xxh32_intdigest(value.encode("utf-8", "surrogatepass")) % META_BINS] += 1
    if n_chars is not None:
        n = max(0, n_chars)
        out[META_BINS + min(n.bit_length(), LENGTHS - 1)] = 1
        out[-2] = np.log1p(n) / 10
    out[-1] = n_chars is None
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, worth: np.ndarray | None = None, l2: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights, the last one constant, by accelerated gradient descent on features scaled to unit variance; classes weigh alike, rows in a class by ``worth``."""
    worth = np.ones(len(y)) if worth is None else worth
    centre, scale = x.mean(axis=0), x.std(axis=0) + np.float32(1e-3)
    z = np.c_[(x - centre) / scale, np.ones(len(x))].astype(np.float32)
    weight = (worth * np.where(y == 1, 0.5 / max(1e-6, worth[y == 1].sum()), 0.5 / max(1e-6, worth[y == 0].sum()))).astype(np.float32)
    y, top = y.astype(np.float32), np.ones(z.shape[1], np.float32)
    for _ in range(20):  # power iteration: the steepest curvature bounds the step
        top /= np.linalg.norm(top)
        top = z.T @ (weight * (z @ top))
    w = v = np.zeros(z.shape[1], np.float32)
    rate = np.float32(3 / (np.linalg.norm(top) + 4 * l2))
    for k in range(steps):
        ahead = w + np.float32(k / (k + 3)) * (w - v)
        gradient = z.T @ (weight * (_sigmoid(z @ ahead) - y)) + np.float32(l2) * ahead
        v, w = w, ahead - rate * gradient
    flat = w[:-1] / scale
    return np.r_[flat, w[-1] - flat @ centre].astype(np.float32)


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into log-odds, with the targets smoothed as Platt does."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = margin.std() + 1e-6
    a, b, m = 1.0, 0.0, margin / spread
    for _ in range(50):
        p = _sigmoid(a * m + b)
        g = np.array([((p - goal) * m).sum(), (p - goal).sum()])
        r = p * (1 - p) + 1e-6
        h = np.array([[(r * m * m).sum(), (r * m).sum()], [(r * m).sum(), r.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return max(0.0, a) / spread, b


@dataclass
class CoModel:
    """Both views' weights and calibrations, and the prior log-odds."""

    text: np.ndarray | None
    meta: np.ndarray | None
    calibration: tuple[tuple[float, float], tuple[float, float]]
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of label 1 by content, by metadata, and by both."""
        if self.text is None:
            p = np.full(len(text), _sigmoid(np.float64(self.prior)))
            return p, p, p
        (a, b), (c, d) = self.calibration
        one, two = a * logits(text, self.text) + b, c * logits(meta, self.meta) + d
        return _sigmoid(one), _sigmoid(two), _sigmoid(one + two - self.prior)


Examples = tuple[list[np.ndarray], list[np.ndarray]]


def calibrated(rows: np.ndarray, weights: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], np.ndarray]:
    """A view's calibration on the rows held out, and its log-odds for them."""
    margin = logits(rows, weights)
    a, b = _platt(margin, y)
    return (float(a), float(b)), a * margin + b


def loss_of(odds: list[np.ndarray], y: np.ndarray) -> float:
    """The views' combined loss on the rows held out, which have a prior of their own."""
    both = sum(odds) - np.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
    return float(np.logaddexp(0, np.where(y == 1, -both, both)).mean())


def surest(margin: np.ndarray, ids: np.ndarray, most: int, sure: float = SURE) -> tuple[list[int], list[int]]:
    """Rows of the lowest and of the highest calibrated margins (log-odds), ``most`` at most and each at least as sure as ``sure``; ties by id."""
    step, floor = np.round(margin, 3), np.log(sure / (1 - sure))
    up, down = np.lexsort((ids, -step))[:most], np.lexsort((ids, step))[:most]
    return [int(k) for k in down if step[k] <= -floor], [int(k) for k in up if step[k] >= floor]


def fit_view(rows: list[np.ndarray], y: np.ndarray, pseudo: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """A view's weights from the labelled rows and the pseudo-labels (features, label)."""
    worth = np.r_[np.ones(len(y)), np.full(len(pseudo), PSEUDO_WEIGHT)]
    return fit_logistic(np.stack([*rows, *(x for x, _ in pseudo)]), np.r_[y, [label for _, label in pseudo]], worth)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = list(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True))
    text = np.stack([content_view(r[0]) for r in rows]) if rows else np.zeros((0, _TEXT), np.float32)
    return text, np.stack([metadata_view(*r[1:]) for r in rows]) if rows else np.zeros((0, _META), np.float32)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of bounded text and of 1,000 rows at most."""
    for batch in pieces(batches, 1):
        for at in range(0, batch.num_rows, 1000):
            yield batch.slice(at, 1000)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        packed = [pa.array([r.tobytes() for r in view], pa.binary()) for view in _views(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *packed], ["id", "text", "meta"])


def _candidates(weights: list[np.ndarray], calibration: list[tuple[float, float]], most: tuple[int, int]):
    """A task's surest documents: view, label, the margin's step and id, in the order of certainty within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[(np.zeros(0), np.zeros(0, np.int64)) for _ in (0, 1)] for _ in (0, 1)]
        for batch in _small(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for view, x in enumerate(_views(batch)):
                slope, shift = calibration[view]
                margin = slope * logits(x, weights[view]) + shift
                for label, rows in enumerate(surest(margin, ids, max(most))):
                    m, i = (np.r_[a, b] for a, b in zip(held[view][label], (margin[rows], ids[rows]), strict=True))
                    keep = surest(m, i, most[label])[label]
                    held[view][label] = m[keep], i[keep]
        rows = [(view, label, round(float(m), 3), int(i)) for view in (0, 1) for label in (0, 1) for m, i in zip(*held[view][label], strict=True)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], ["view", "label", "margin", "id"])

    return run


def _inputs(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("bigint").alias("n_chars"))


def _best(found: DataFrame, most: tuple[int, int]) -> list[tuple[int, int, int]]:
    """Of all tasks' candidates the surest: view, label and id. Each id is taken once a view and label."""
    margin = F.when(F.col("label") == 1, -F.col("margin")).otherwise(F.col("margin"))
    rank = F.row_number().over(Window.partitionBy("view", "label").orderBy("m", "id"))
    once = found.groupBy("view", "label", "id").agg(F.min(margin).alias("m"))
    # a row_number with a bound: Spark keeps the first rows of each task's share before it shuffles
    kept = once.withColumn("k", rank).where(f"k <= {max(most)}").where(f"k <= IF(label = 1, {most[1]}, {most[0]})")
    return sorted((r["view"], r["label"], r["id"]) for r in kept.collect())


def _features_of(inputs: DataFrame, ids: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Both views of a bounded list of ids; of a repeated id, of its least row."""
    if not ids:
        return {}
    wanted = inputs.sparkSession.createDataFrame([(i,) for i in ids], "id bigint")
    rows = inputs.join(F.broadcast(wanted), "id", "left_semi").groupBy("id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("id", "r.*")
    return {r["id"]: (np.frombuffer(r["text"], np.float32), np.frombuffer(r["meta"], np.float32)) for r in rows.mapInArrow(_feature_rows, "id bigint, text binary, meta binary").collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, added: int = ADDED) -> CoModel:
    """Co-trains on the sample and the pseudo-labels; only their ids and features reach the driver."""
    inputs = _inputs(docs, id, text).where("id IS NOT NULL")
    known = labels.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("double").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").distinct()
    known = known.join(inputs.select("id"), "id", "left_semi")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = counts.get(1.0, 0), counts.get(0.0, 0)
    share = pos / (pos + neg) if pos + neg else 0.5
    clipped = min(max(share, 1e-3), 1 - 1e-3)
    prior = float(np.log(clipped / (1 - clipped)))
    if min(pos, neg) < MIN_CLASS:
        return CoModel(None, None, ((1.0, 0.0), (1.0, 0.0)), prior)
    order = F.xxhash64("id", F.lit(7))
    few = min(pos, neg, max_labelled // 2)  # what one class lacks the other one has
    most = {1.0: few if pos <= neg else max_labelled - few, 0.0: few if neg < pos else max_labelled - few}
    chosen = [(r["id"], r["y"]) for y, n in most.items() for r in known.where(F.col("y") == y).orderBy(order, "id").limit(n).collect()]
    chosen.sort(key=lambda x: (xxhash.xxh64_intdigest(str(x[0])), x))
    rows = _features_of(inputs, sorted({i for i, _ in chosen}))
    y = np.array([v for _, v in chosen])
    most_drawn = {v: int((y == v).sum()) for v in (0.0, 1.0)}
    held = np.arange(len(y)) % HELD_OUT == 0
    views = [np.stack([rows[i][k] for i, _ in chosen]) for k in (0, 1)]
    train = [list(v[~held]) for v in views]
    used, taught = {i for i, _ in chosen}, [[], []]
    # the sample's own prior, which calibration on it takes in
    shift = prior - float(np.log(most_drawn[1.0] / most_drawn[0.0]))
    weights = [fit_view(rows, y[~held], []) for rows in train]
    fits = [calibrated(v[held], w, y[held]) for v, w in zip(views, weights, strict=True)]
    at_prior = lambda: [(a, b + shift) for (a, b), _ in fits]
    most = round(added * (1 - share)), round(added * share)
    for _ in range(rounds):
        left = inputs.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(used)], "id bigint")), "id", "left_anti")
        best = _best(left.mapInArrow(_candidates(weights, at_prior(), most), "view int, label int, margin double, id bigint"), most)
        rows = _features_of(inputs, sorted({i for _, _, i in best}))
        used |= set(rows)
        for view in (0, 1):
            lesson = [(rows[i][view], float(one)) for teacher, one, i in best if teacher != view]
            if not lesson:
                continue
            after = fit_view(train[view], y[~held], taught[view] + lesson)
            fitted = calibrated(views[view][held], after, y[held])
            if loss_of([fitted[1], fits[1 - view][1]], y[held]) < loss_of([odds for _, odds in fits], y[held]):
                weights[view], fits[view] = after, fitted
                taught[view] += lesson
    return CoModel(*weights, tuple(at_prior()), prior)


def score(docs: DataFrame, model: CoModel, id: str = "doc_id", text: str = "text", threshold: float = KEEP_SCORE) -> DataFrame:
    """``id``, ``p_text``, ``p_meta``, ``score`` and ``kept`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _small(batches):
            one, two, both = model.score(*_views(part))
            arrays = [part.column(0), *(pa.array(p, pa.float64()) for p in (one, two, both)), pa.array(both >= threshold)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "p_text", "p_meta", "score", "kept"])

    return _inputs(docs, id, text).mapInArrow(run, "id bigint, p_text double, p_meta double, score double, kept boolean")
