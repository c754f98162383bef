"""Quality classifier by co-training of two views.

The text view sees what is written: hashed words and shares of character classes. The metadata view sees how the document
is filed and laid out: source, language, size, lines, repeated lines. Each view has its own logistic regression. Over some
rounds each view scores all unlabelled documents and hands the ones that it is surest about (by its calibration), with
their guessed labels, to the other view's training set; the share handed over grows from round to round, and every round
chooses anew. Both are then calibrated on labelled documents that were kept apart, and a last regression on the two
calibrated logits combines them. All documents are scored in one scan with weights of fixed size.

The features of all unlabelled documents are written once to the shared folder. A round is a few scans of them: one counts
scores in bins of fixed number, which gives the threshold of the share, and one for each Newton step sums gradients and
curvatures of the documents beyond the thresholds. Only sums of fixed size reach the driver. Labelled rows are a sample
bounded by ``labelled``: the rows whose ids have the smallest hashes.

Defined results: NULL or empty text and NULL metadata have features of their own and are scored; rows without a doc_id are
unlabelled. Labels that are NULL are left out; contradicting labels of a document count as good from one half on. With
labels of one class only (or none) every document gets that share of good labels (or 0.5) as its score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import column_sums, is_present, presence_bits, stored, work_folder
from cohortry.llm.words import WordHasher, text_buffers

_WORDS = 512
_SHAPES = 10
_NAMES = 64
_LAYOUT = 6
TEXT_WIDTH, META_WIDTH = _WORDS + _SHAPES, 2 * _NAMES + _LAYOUT


@dataclass(frozen=True)
class CoTraining:
    """``labelled`` bounds the sample of labelled rows; ``handed`` is the share of the unlabelled documents by which a view
    hands over more for each class in a round, in at most ``steps`` Newton steps; ``calibration`` the share of labelled
    rows kept apart; ``keep`` the least score of a good document."""

    labelled: int = 10_000
    rounds: int = 5
    steps: int = 3
    handed: float = 0.03
    sure: float = 0.9
    calibration: float = 0.25
    penalty: float = 1.0
    keep: float = 0.5


@dataclass(frozen=True)
class Classifier:
    """Scale and weights of both views, the calibration of each, and the weights that combine them."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    calibration: np.ndarray
    combination: np.ndarray
    constant: float | None


def _class_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, the shares of upper case, lower case, digits, spaces, line ends, sentence marks, signs and other bytes."""
    kind = np.full(256, 7, np.int8)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\r\n", b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~")):
        kind[[*chars]] = k
    kinds = kind[data]
    sizes = np.maximum(np.diff(offsets), 1)
    out = np.zeros((len(sizes), 8))
    for k in range(8):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        out[:, k] = (total[offsets[1:]] - total[offsets[:-1]]) / sizes
    return out


def features(batch: pa.RecordBatch, hasher: WordHasher) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The text view and the metadata view of the rows of a batch (columns text, source, lang), slice by slice."""
    texts = batch.column("text")
    for row, data, offsets in text_buffers(texts):
        n = len(offsets) - 1
        hashes, first = hasher.words(data, offsets)
        counts = np.diff(first)
        owner = np.repeat(np.arange(n), counts)
        bag = np.bincount(owner * _WORDS + (hashes % np.uint64(_WORDS)).astype(np.int64), minlength=n * _WORDS).reshape(n, _WORDS)
        bag = np.log1p(bag / np.maximum(counts, 1)[:, None] * 100)
        shape = np.zeros((n, _SHAPES))
        shape[:, :8] = _class_shares(data, offsets)
        distinct = [len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:])]
        shape[:, 8] = np.array(distinct) / np.maximum(counts, 1)
        shape[:, 9] = np.log1p(np.diff(offsets) / np.maximum(counts, 1))
        meta = np.zeros((n, META_WIDTH))
        for at, name in ((0, "source"), (_NAMES, "lang")):
            for i, value in enumerate(batch.column(name).slice(row, n).to_pylist()):
                code = 0 if value is None else 1 + sum(b * (k + 7) for k, b in enumerate(value.encode())) % (_NAMES - 1)
                meta[i, at + code] = 1
        for i, text in enumerate(texts.slice(row, n).to_pylist()):
            lines = text.split("\n") if text else []
            meta[i, 2 * _NAMES:] = (text is None, np.log1p(len(text or "")), np.log1p(len(lines)), np.log1p(counts[i]),
                                    np.log1p(len(text or "") / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1))
        yield row, np.concatenate([bag, shape], axis=1), meta


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of a penalised logistic regression (the last is the constant), by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _view_rows(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Both views of every row (columns text, source, lang) as one float32 vector, beside the columns to keep."""
    hasher = WordHasher()
    for batch in batches:
        for row, text, meta in features(batch, hasher):
            rows = np.concatenate([text, meta], axis=1).astype(np.float32)
            columns = [batch.column(c).slice(row, len(rows)) for c in kept]
            yield pa.record_batch([*columns, pa.array([r.tobytes() for r in rows], pa.binary())], [*kept, "views"])


def _views(column: pa.Array, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both views from ``n`` vectors of a column."""
    held = np.frombuffer(b"".join(column.slice(start, n).to_pylist()), np.float32).reshape(-1, TEXT_WIDTH + META_WIDTH).astype(np.float64)
    return held[:, :TEXT_WIDTH], held[:, TEXT_WIDTH:]


def _sample_features(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, both views and the order of the sampled documents."""
    # the ids are a sample of bounded size
    rows = docs.join(F.broadcast(ids), "doc_id").select("place", "good", "text", "source", "lang")
    got = rows.mapInArrow(lambda batches: _view_rows(batches, ["place", "good"]), "place long, good double, views binary").toArrow().sort_by("place")
    text, meta = _views(got["views"].combine_chunks(), 0, len(got))
    return got["good"].to_numpy().astype(np.float64), text, meta, got["place"].to_numpy()


#: Sums over all unlabelled documents of what a function makes from both views of some of them; vectors of one size.
Sums = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray], int], np.ndarray]


def unlabelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows without a label. A bitmap of fixed size thins them out, so that most aren't shuffled for the exact join."""
    place = F.xxhash64(F.col("doc_id").cast("string"))
    maybe = is_present(docs, place, presence_bits(known.select(place.alias("h")))) & F.col("doc_id").isNotNull()
    columns = docs.columns
    return docs.where(~maybe).union(docs.where(maybe).join(known.select("doc_id"), "doc_id", "left_anti").select(*columns))


def _sums_over(pool: DataFrame) -> Sums:
    """Sums over the stored views of the unlabelled documents."""

    def sums(part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    yield part(*_views(batch.column("views"), start, 1024))

        return column_sums(pool, run, size)

    return sums


def fit(docs: DataFrame, labels: DataFrame, parameters: CoTraining | None = None) -> Classifier:
    """Co-train on documents (doc_id, text, source, lang) and labels (doc_id, quality)."""
    p = parameters or CoTraining()
    rows = docs.select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("good"))
    ids = rows.select("doc_id").where("doc_id IS NOT NULL").distinct()
    mine = ids.join(known, "doc_id").withColumn("place", F.xxhash64("doc_id")).orderBy("place").limit(p.labelled)
    good, text, meta, places = _sample_features(rows, mine)
    if len(np.unique(good)) < 2:
        return _constant(good)
    pool = unlabelled(rows, known).select("text", "source", "lang").mapInArrow(lambda batches: _view_rows(batches, []), "views binary")
    pool = stored(pool, f"{work_folder(docs.sparkSession)}/views", "zstd")
    return _co_train(good, text, meta, places, _sums_over(pool), p, _WORDS)


def _constant(good: np.ndarray) -> Classifier:
    none = np.zeros(0)
    return Classifier(none, none, none, none, none, none, float(good.mean()) if len(good) else 0.5)


def co_train(good: np.ndarray, text: np.ndarray, meta: np.ndarray, places: np.ndarray, p: CoTraining, words: int = 0) -> Classifier:
    """Co-training on arrays; NaN marks the unlabelled rows."""
    pool = np.isnan(good)
    if len(np.unique(good[~pool])) < 2:
        return _constant(good[~pool])
    return _co_train(good[~pool], text[~pool], meta[~pool], places[~pool], lambda part, size: part(text[pool], meta[pool]), p, words)


_BINS = 4096


def _bin(z: np.ndarray) -> np.ndarray:
    """The bin of each calibrated logit; equal bins from -30 to 30."""
    return ((np.clip(z, -30, 30) + 30) * ((_BINS - 1) / 60)).astype(np.int64)


def _thresholds(counts: np.ndarray, share: float, sure: float) -> tuple[int, int]:
    """The first bin handed over as good and the last one handed over as bad: about a share of all for each, if sure."""
    n = max(1.0, share * counts.sum())
    least = int(_bin(np.array([np.log(sure / (1 - sure))]))[0]) + 1
    above = np.cumsum(counts[::-1])[::-1]  # documents in a bin or higher
    good = int(np.flatnonzero(above >= n)[-1]) if above[0] >= n else 0
    bad = int(np.flatnonzero(np.cumsum(counts) >= n)[0]) if above[0] >= n else _BINS - 1
    return max(good, least), min(bad, _BINS - 1 - least)


def _slopes(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The gradient of a logistic regression and the upper half of its curvature."""
    x = np.column_stack([x, np.ones(len(x))])
    p = _chance(np.clip(x @ w, -30, 30))
    curve = (x * (weight * p * (1 - p))[:, None]).T @ x
    return np.concatenate([x.T @ (weight * (p - y)), curve[np.triu_indices(len(w))]])


def _newton_step(slopes: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    n = len(w)
    ridge = np.full(n, penalty)
    ridge[-1] = 1e-6
    curve = np.zeros((n, n))
    curve[np.triu_indices(n)] = slopes[n:]
    curve = curve + np.triu(curve, 1).T + np.diag(ridge)
    return np.linalg.solve(curve, slopes[:n] + ridge * w)


def _co_train(good: np.ndarray, text: np.ndarray, meta: np.ndarray, places: np.ndarray, sums: Sums, p: CoTraining, words: int) -> Classifier:
    """Exchange pseudo-labels between the views and calibrate them.

    The first ``words`` columns of the text view, many and sparse, together weigh as much as the shapes.
    """
    def moments(*both: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(both[0])], *(v for x in both for v in (x.sum(axis=0), (x ** 2).sum(axis=0)))])

    widths = text.shape[1], meta.shape[1]
    pool = sums(moments, 1 + 2 * sum(widths))
    unlabelled_rows = pool[0]
    total = pool + moments(text, meta)
    scales, at = [], 1
    for width in widths:
        mean = total[at:at + width] / total[0]
        deviation = np.sqrt(np.maximum(total[at + width:at + 2 * width] / total[0] - mean ** 2, 0))
        scales.append(np.stack([mean, np.where(deviation > 1e-6, deviation, 1)]))
        at += 2 * width
    if words:
        scales[0][1, :words] *= np.sqrt(words / _SHAPES)

    def scaled(*both: np.ndarray) -> list[np.ndarray]:
        return [(x - s[0]) / s[1] for x, s in zip(both, scales)]

    views = scaled(text, meta)
    apart = places % 1000 < 1000 * p.calibration
    if min((good[apart] == c).sum() for c in (0, 1)) < 5 or min((good[~apart] == c).sum() for c in (0, 1)) < 5:
        apart = train = np.ones(len(good), bool)
    else:
        train = ~apart
    own, answers = [x[train] for x in views], good[train]
    weights = [_logistic(x, answers, np.ones(len(x)), p.penalty) for x in own]
    sizes = [w + 1 + (w + 1) * (w + 2) // 2 for w in widths]
    for turn in range(p.rounds if unlabelled_rows else 0):
        # how sure a view is counts by the labelled documents that were kept apart
        sureness = [_logistic(_logit(x[apart], w)[:, None], good[apart], np.ones(apart.sum()), 1e-2) for x, w in zip(views, weights)]

        def bins(both: list[np.ndarray], teachers=tuple(weights), sureness=tuple(sureness)) -> list[np.ndarray]:
            return [_bin(_logit(x, w) * c[0] + c[1]) for x, w, c in zip(both, teachers, sureness)]

        counts = sums(lambda *both, bins=bins: np.concatenate([np.bincount(b, minlength=_BINS) for b in bins(scaled(*both))]).astype(np.float64), 2 * _BINS)
        limits = [_thresholds(c, p.handed * (turn + 1), p.sure) for c in (counts[:_BINS], counts[_BINS:])]
        for _ in range(p.steps):
            def slopes(*both: np.ndarray, bins=bins, limits=limits, pupils=tuple(weights)) -> np.ndarray:
                both = scaled(*both)
                out = []
                for x, b, (high, low), w in zip(both, bins(both)[::-1], limits[::-1], pupils):  # each is taught by the other view
                    given = (b >= high) | (b <= low)
                    out.append(_slopes(x[given], (b[given] >= high).astype(np.float64), np.full(given.sum(), 0.5), w))
                return np.concatenate(out)

            found = np.split(sums(slopes, sum(sizes)), [sizes[0]])
            steps = [_newton_step(g + _slopes(x, answers, np.ones(len(x)), w), w, p.penalty) for g, x, w in zip(found, own, weights)]
            weights = [w - s for w, s in zip(weights, steps)]
            if max(np.abs(s).max() for s in steps) < 1e-3:
                break
    y = good[apart]
    ones = np.ones(len(y))
    logits = [_logit(x[apart], w) for x, w in zip(views, weights)]
    calibration = np.array([_logistic(z[:, None], y, ones, 1e-2) for z in logits])
    calibrated = np.column_stack([z * c[0] + c[1] for z, c in zip(logits, calibration)])
    return Classifier(weights[0], weights[1], scales[0], scales[1], calibration, _logistic(calibrated, y, ones, 1e-2), None)


def scored(docs: DataFrame, model: Classifier, parameters: CoTraining | None = None) -> DataFrame:
    """``doc_id, text_score, meta_score, score, keep`` of every document; scores are chances of good quality."""
    p = parameters or CoTraining()
    parts = (model.text, model.meta, model.text_scale, model.meta_scale, model.calibration, model.combination, model.constant)
    held = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = WordHasher(), Classifier(*held.value)
        for batch in batches:
            for row, text, meta in features(batch, hasher):
                if m.constant is not None:
                    chances = np.full((len(text), 3), m.constant)
                else:
                    z = [_logit((x - s[0]) / s[1], w) for x, s, w in ((text, m.text_scale, m.text), (meta, m.meta_scale, m.meta))]
                    z = [v * c[0] + c[1] for v, c in zip(z, m.calibration)]
                    z.append(_logit(np.column_stack(z), m.combination))
                    chances = 1 / (1 + np.exp(-np.clip(np.column_stack(z), -30, 30)))
                columns = [batch.column("doc_id").slice(row, len(text)), *(pa.array(chances[:, k]) for k in range(3)), pa.array(chances[:, 2] >= p.keep)]
                yield pa.record_batch(columns, ["doc_id", "text_score", "meta_score", "score", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    return rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")
