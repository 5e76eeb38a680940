"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's potential adds weights of its own binned
features and of those of the lines before and after it; a 2 x 2 matrix scores
label changes.  Forward-backward gives each line's marginal of being good,
and the length-weighted mean of the marginals is the document's quality.

Fitting takes every line of a labelled document to carry the document's
label and maximises the conditional likelihood of these label sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm import labelled
from stepwise.llm import textops as tx

BINS = 12                   # quantile bins of a feature
MAX_TRAIN_DOCS = 8_000      # labelled documents used for fitting
STEPS = 150                 # gradient steps
RIDGE = 1e-3
SLICE_BYTES = 1 << 20

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = _ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = ~_ALPHA & ~_DIGIT & ~tx.SPACE
_STOP = np.zeros(256, bool)
_STOP[np.frombuffer(b".,;:?'\"()-", np.uint8)] = True

FEATURES = ["bytes", "words", "word_bytes", "upper", "digit", "mark", "odd_mark",
            "same_next", "same_any", "copy", "last_stop"]


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES), document and byte length of every line.

    Lines are the \\n-separated parts that hold a word; a document without any
    has one empty line.
    """
    n = len(off) - 1
    ws, we, wdoc = tx.words(buf, off)
    ls, le = tx.segments(buf != 10, off)
    a, b = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    ls, le, a, b = ls[b > a], le[b > a], a[b > a], b[b > a]
    ldoc = tx.owners(off, ls)
    whole = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    per_line = lambda flags: (lambda c: c[le] - c[ls])(whole(flags))
    size, words = le - ls, b - a
    chars = np.maximum(size, 1)
    h = tx.span_hash(buf, ws, we)
    line_of = np.repeat(np.arange(len(ls)), words)
    follow = np.zeros(len(ws), bool)
    follow[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    again = ~tx.first_of(line_of, h)
    per_words = lambda flags: np.bincount(line_of[flags], minlength=len(ls))
    lh = tx.span_hash(buf, ls, le)
    f = np.stack([
        np.log1p(size), np.log1p(words), per_line(~tx.SPACE[buf]) / np.maximum(words, 1),
        per_line(_UPPER[buf]) / chars, per_line(_DIGIT[buf]) / chars, per_line(_MARK[buf]) / chars,
        per_line(_MARK[buf] & ~_STOP[buf]) / chars, per_words(follow) / np.maximum(words, 1),
        per_words(again) / np.maximum(words, 1), tx.repeated(ldoc, lh).astype(float),
        _STOP[buf[le - 1]].astype(float) if len(le) else np.zeros(0)], axis=1).astype(np.float32)
    empty = np.flatnonzero(np.bincount(ldoc, minlength=n) == 0)
    if len(empty):
        doc = np.concatenate((ldoc, empty))
        order = np.argsort(doc, kind="stable")
        f = np.concatenate((f, np.zeros((len(empty), f.shape[1]), np.float32)))[order]
        return f, doc[order], np.concatenate((size, np.zeros(len(empty), np.int64)))[order]
    return f, ldoc, size


@dataclass
class Model:
    edges: np.ndarray           # FEATURES x (BINS - 1) bin borders
    weights: np.ndarray         # 3 x FEATURES x BINS: line before, own line, line after
    change: np.ndarray          # 2 x 2, from label to label
    bias: float
    scale: tuple[float, float]  # slope and shift of the document's logit

    @property
    def learned(self) -> bool:
        """False for the constant model of labels that are all alike."""
        return self.scale[0] > 0


def binned(f: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[j], f[:, j], "right") for j in range(f.shape[1])], 1)


def _neighbours(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines that have a line before / after in the same document."""
    same = doc[1:] == doc[:-1]
    return np.flatnonzero(same) + 1, np.flatnonzero(same)


def potentials(model: Model, bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Log odds of good against bad of every line, without label changes."""
    cols = np.arange(bins.shape[1])
    each = lambda k: model.weights[k][cols, bins].sum(1)
    s = model.bias + each(1)
    has_before, has_after = _neighbours(doc)
    s[has_before] += each(0)[has_before - 1]
    s[has_after] += each(2)[has_after + 1]
    return s


def marginals(s: np.ndarray, doc: np.ndarray, change: np.ndarray):
    """P(good) of every line, and the expected label changes of every document.

    Documents advance together, longest first, one line a step; values are
    kept as normalised probabilities, so long documents do not underflow.
    """
    n_lines = np.bincount(doc) if len(doc) else np.zeros(0, np.int64)
    docs = np.flatnonzero(n_lines)
    order = docs[np.argsort(-n_lines[docs], kind="stable")]
    first = (np.cumsum(n_lines) - n_lines)[order]
    length = n_lines[order]
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), "left")       # documents longer than t
    m = np.exp(change - change.max())
    e = np.exp(-np.logaddexp(0, np.stack((s, -s), 1)))                 # own term of bad, good
    fwd = np.empty((len(s), 2))
    bwd = np.ones((len(s), 2))
    a = None
    for t in range(steps):
        at = first[:alive[t]] + t
        a = e[at] if t == 0 else (a[:alive[t]] @ m) * e[at]
        a /= a.sum(1, keepdims=True)
        fwd[at] = a
    for t in range(steps - 2, -1, -1):
        at = first[:alive[t + 1]] + t
        b = (e[at + 1] * bwd[at + 1]) @ m.T
        bwd[at] = b / b.sum(1, keepdims=True)
    p = fwd * bwd
    p /= p.sum(1, keepdims=True)
    pairs = np.zeros((len(n_lines), 2, 2))
    nxt = _neighbours(doc)[0]
    if len(nxt):
        x = fwd[nxt - 1][:, :, None] * m[None] * (e[nxt] * bwd[nxt])[:, None, :]
        x /= x.sum((1, 2), keepdims=True)
        np.add.at(pairs, doc[nxt], x)
    return p[:, 1], pairs


def quality(p: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; an empty line weighs 1."""
    w = np.maximum(size, 1).astype(float)
    return np.bincount(doc, p * w, n) / np.maximum(np.bincount(doc, w, n), 1e-300)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-12, 1 - 1e-12)
    return np.log(q) - np.log1p(-q)


def scores(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Quality of every document of a batch, 0 to 1."""
    f, doc, size = line_features(buf, off)
    p, _ = marginals(potentials(model, binned(f, model.edges), doc), doc, model.change)
    slope, shift = model.scale
    return 1.0 / (1.0 + np.exp(-(slope * _logit(quality(p, doc, size, len(off) - 1)) + shift)))


def fit_arrays(f: np.ndarray, doc: np.ndarray, size: np.ndarray, label: np.ndarray) -> Model:
    """Gradient ascent (Adam) on the mean log-likelihood per document.

    A document's gradient is divided by its number of lines, so long ones do
    not outvote short ones.  Without both labels the model is constant.
    """
    k = len(FEATURES)
    edges = np.zeros((k, BINS - 1), np.float32)
    for j in range(k if len(f) else 0):
        edges[j] = np.quantile(f[:, j], np.arange(1, BINS) / BINS)
    model = Model(edges, np.zeros((3, k, BINS)), np.zeros((2, 2)), 0.0, (1.0, 0.0))
    n = len(label)
    if n == 0 or label.min() == label.max():
        share = (label.sum() + 0.5) / (n + 1.0)
        model.scale = (0.0, float(np.log(share / (1 - share))))
        return model
    bins = binned(f, edges)
    lines = np.bincount(doc, minlength=n)
    heavy = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) / n    # both labels weigh the same
    w_line = (heavy / lines)[doc]
    has_before, has_after = _neighbours(doc)
    flat = np.arange(k) * BINS + bins
    theta = np.zeros(3 * k * BINS + 5)
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        model.weights = theta[:-5].reshape(3, k, BINS)
        model.change, model.bias = theta[-5:-1].reshape(2, 2), theta[-1]
        p, pairs = marginals(potentials(model, bins, doc), doc, model.change)
        r = (label[doc] - p) * w_line
        g = np.zeros_like(theta)
        total = lambda lines_, r_: np.bincount(
            flat[lines_].ravel(), np.repeat(r_, k), k * BINS)
        g[:k * BINS] = total(has_before - 1, r[has_before])
        g[k * BINS:2 * k * BINS] = total(slice(None), r)
        g[2 * k * BINS:-5] = total(has_after + 1, r[has_after])
        seen = np.zeros((n, 2, 2))
        seen[np.arange(n), label.astype(int), label.astype(int)] = lines - 1
        g[-5:-1] = ((seen - pairs) * (heavy / lines)[:, None, None]).sum(0).ravel()
        g[-1] = r.sum()
        g -= RIDGE * theta
        mom += 0.1 * (g - mom)
        var += 0.01 * (g * g - var)
        theta = theta + 0.05 * (mom / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.99 ** step)) + 1e-8)
    model.weights = theta[:-5].reshape(3, k, BINS)
    model.change, model.bias = theta[-5:-1].reshape(2, 2), float(theta[-1])
    p, _ = marginals(potentials(model, bins, doc), doc, model.change)
    model.scale = labelled.logistic_fit(_logit(quality(p, doc, size, n)), label)
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "text", SLICE_BYTES):
            f, doc, size = line_features(*tx.flat(part.column("text")))
            at = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
            wide = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("label_id"), part.column("label"),
                 pa.ListArray.from_arrays(wide, pa.array(f.ravel())),
                 pa.ListArray.from_arrays(at, pa.array(size))],
                ["label_id", "label", "features", "sizes"])


def fit(docs: DataFrame, labels: DataFrame, keep: Column, *, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fit on at most ``max_docs`` labelled documents for which ``keep`` holds.

    Only their line features come to the driver, which fits the model.
    """
    sample = labelled.sample_texts(docs, labels, "quality", keep, max_docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(_feature_batches, f"label_id {kind}, label int, features array<float>, "
                            "sizes array<long>").toPandas()
    got = got.sort_values("label_id", kind="stable").reset_index(drop=True)
    if not len(got):
        return fit_arrays(np.zeros((0, len(FEATURES))), np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    lines = np.array([len(x) for x in got["sizes"]])
    return fit_arrays(np.concatenate(got["features"].tolist()).reshape(-1, len(FEATURES)),
                      np.repeat(np.arange(len(got)), lines), np.concatenate(got["sizes"].tolist()),
                      got["label"].to_numpy(np.float64))


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (score >= 0.5).

    A null or empty text, or one of blanks, is scored as one empty line;
    repeated rows stay; other columns are ignored; an empty table gives no
    rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", SLICE_BYTES):
                q = scores(shared.value, *tx.flat(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(q), pa.array((q >= 0.5).astype(np.int32))],
                    ["id", "score", "predicted"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, score double, predicted int")
            .withColumnRenamed("id", id_col))


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents predicted good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, text_col, SLICE_BYTES):
                q = scores(shared.value, *tx.flat(part.column(text_col)))
                yield part.filter(pa.array(q >= 0.5))

    return docs.mapInArrow(run, docs.schema)
