"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the different terms
of a text, with a slope for each part set on documents kept back.  The pair part lets two harmless-looking terms count together
(an insult and a group mention), which additive weights cannot express.
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
from stepwise.llm.storage import saved

BITS = 20                   # hashed term space
PREFIXES = (4, 5, 6)        # bytes of the word beginnings that are terms too
FACTORS = 8
MIN_DOCS = 5                # sample documents a term must occur in to get a weight
PAIR_SHARE = 0.01           # share of the sample a term must occur in to get pair factors
MAX_TRAIN_DOCS = 20_000     # labelled documents used for fitting
EPOCHS = 30
PAIR_EPOCHS = 20
BATCH = 256                 # documents of a step
SLICE_BYTES = 1 << 20

# Terms are runs of letters, digits and bytes of non-ASCII characters.
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


@dataclass
class Model:
    bias: float
    slot: np.ndarray            # 2**BITS: row of a learned term, else -1
    linear: np.ndarray          # one weight per learned term
    pairs: np.ndarray           # learned terms x FACTORS
    scale: tuple[float, float, float] = (1.0, 1.0, 0.0)     # slopes of both parts, shift before the sigmoid


def terms(buf: np.ndarray, off: np.ndarray, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed term) once per different term, sorted.

    The terms of a word are the word and, for longer words, its first bytes,
    so that forms of one stem share a term.  ``slot`` keeps learned terms only.
    """
    starts, ends = tx.segments(_TERM[buf], off)
    doc = tx.owners(off, starts) << BITS
    parts = []
    for n in (0, *PREFIXES):
        long = ends - starts > n if n else slice(None)
        h = tx.span_hash(buf, starts[long], starts[long] + n if n else ends, tx.LOWER_CODE)
        h = (tx.mix64(h + tx.U64(n)) >> tx.U64(64 - BITS)).astype(np.int64)
        parts.append((doc[long] | h) if slot is None else (doc[long] | h)[slot[h] >= 0])
    both = np.sort(np.concatenate(parts))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return both >> BITS, both & ((1 << BITS) - 1)


def parts(model: Model, doc: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Linear part (with the bias) and pair part of every document's different learned terms."""
    row = model.slot[term]
    pair = np.zeros(n)
    for f in range(model.pairs.shape[1]):
        v = model.pairs[row, f]
        pair += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
    return model.bias + np.bincount(doc, model.linear[row], n), pair


def margins(model: Model, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """Sum of both parts, before the slopes."""
    linear, pair = parts(model, doc, term, n)
    return linear + pair


def scores(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of toxicity of every document of a batch."""
    doc, term = terms(buf, off, model.slot)
    linear, pair = parts(model, doc, term, len(off) - 1)
    z = model.scale[0] * linear + model.scale[1] * pair + model.scale[2]
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_arrays(doc: np.ndarray, term: np.ndarray, label: np.ndarray, seed: int = 7,
               rate: float = 0.1, sparse: float = 1.5e-3, pair_rate: float = 0.05,
               pair_sparse: float = 5e-3, start: float = 0.05) -> Model:
    """Proximal Adagrad on logistic loss over mini-batches of documents.

    Terms are chosen by frequency alone: those of MIN_DOCS documents get a
    weight, those of PAIR_SHARE of them factors as well.  The weights are
    learned first, then the factors on what the weights leave open.  Weights
    are drawn to zero one by one, factors term by term, so a term that tells
    nothing ends without.  Every fifth document is kept to set the slopes of both
    parts and the shift of the sigmoid; a pair part that does not hold there
    gets a slope near zero.  Without both labels the model is the constant of
    the label share.
    """
    n = len(label)
    share = (label.sum() + 0.5) / (n + 1.0)
    model = Model(float(np.log(share / (1 - share))), np.full(1 << BITS, -1, np.int32), np.zeros(0),
                  np.zeros((0, FACTORS)))
    if n == 0 or label.min() == label.max():
        return model
    learn = np.arange(n) % 5 > 0
    found = np.bincount(term[learn[doc]], minlength=1 << BITS)
    ids = np.flatnonzero(found >= MIN_DOCS)
    if not len(ids):
        return model
    model.slot[ids] = np.arange(len(ids))
    keep = model.slot[term] >= 0
    doc, term = doc[keep], model.slot[term[keep]]
    rng = np.random.default_rng(seed)
    fitted = np.flatnonzero(learn)
    weight = np.where(label > 0, min(4.0, max(1.0, (n - label.sum()) / label.sum())), 1.0)   # toxic texts are rare

    def slopes(z: np.ndarray, pick: np.ndarray) -> np.ndarray:
        return (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - label[pick]) * weight[pick] / len(pick)

    b, gb, w, gw = model.bias, 1.0, np.zeros(len(ids)), np.full(len(ids), 1e-3)
    for pick, t, length in _steps(doc, term, fitted, n, EPOCHS, rng):
        d = np.repeat(np.arange(len(pick)), length)
        g = slopes(b + np.bincount(d, w[t], len(pick)), pick)
        dw = np.bincount(t, g[d], len(w))
        gw += dw ** 2
        step = rate / np.sqrt(gw)
        w -= step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
        gb += g.sum() ** 2
        b -= rate * g.sum() / np.sqrt(gb)
    linear = b + np.bincount(doc, w[term], n)

    may = np.flatnonzero(found[ids] >= PAIR_SHARE * len(fitted))
    to = np.full(len(ids), -1)
    to[may] = np.arange(len(may))
    held = to[term] >= 0
    v, gv = rng.normal(0, start, (len(may), FACTORS)), np.full((len(may), 1), 1e-2)
    for pick, t, length in _steps(doc[held], to[term[held]], fitted, n, PAIR_EPOCHS, rng):
        if not len(t):
            continue
        d, vt = np.repeat(np.arange(len(pick)), length), v[t]
        sums = np.stack([np.bincount(d, vt[:, f], len(pick)) for f in range(FACTORS)], 1)
        own = np.bincount(d, (vt * vt).sum(1), len(pick))
        g = slopes(linear[pick] + 0.5 * ((sums ** 2).sum(1) - own), pick)[d]
        dv = np.stack([np.bincount(t, g * (sums[d, f] - vt[:, f]), len(may)) for f in range(FACTORS)], 1)
        gv += (dv ** 2).mean(1, keepdims=True)      # one step size per term, as it is drawn to zero as a whole
        step = pair_rate / np.sqrt(gv)
        v -= step * dv
        size = np.sqrt((v * v).sum(1, keepdims=True))
        v *= np.maximum(1.0 - step * pair_sparse / np.maximum(size, 1e-12), 0)
    model.bias, model.linear, model.pairs = float(b), w, np.zeros((len(ids), FACTORS))
    model.pairs[may] = v

    rest = ~learn
    if label[rest].size and label[rest].min() < label[rest].max():
        at = rest[doc]
        _, pair = parts(model, (np.cumsum(rest) - 1)[doc[at]], ids[term[at]], int(rest.sum()))
        model.scale = _two_slopes(linear[rest], pair, label[rest])
    return model


def _steps(doc: np.ndarray, term: np.ndarray, fitted: np.ndarray, n: int, epochs: int, rng):
    """(documents, their terms one after the other, number of terms) of every mini-batch."""
    first = np.searchsorted(doc, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(fitted)
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            length = first[pick + 1] - first[pick]
            yield pick, term[tx.spread(first[pick], length)], length


def _two_slopes(linear: np.ndarray, pair: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Slopes of both parts (linear above zero, pair not below) and shift of a logistic fit."""
    x = np.stack([linear, pair, np.ones(len(label))], 1)
    at = np.array([1.0, 1.0, 0.0])
    for _ in range(200):
        q = 1.0 / (1.0 + np.exp(-np.clip(x @ at, -40, 40)))
        hess = (x * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ x / len(label) + 1e-3 * np.eye(3)
        at = at + 0.5 * np.linalg.solve(hess, x.T @ (label - q) / len(label) - 1e-3 * at * [1, 1, 0])
        at[:2] = np.maximum(at[:2], [1e-3, 0.0])
    return tuple(float(a) for a in at)


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "text", SLICE_BYTES):
            doc, term = terms(*tx.flat(part.column("text")))
            at = np.searchsorted(doc, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("label_id"), part.column("label"),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(term, pa.int32()))],
                ["label_id", "label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, keep: Column, *, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fit on at most ``max_docs`` labelled documents for which ``keep`` holds.

    Terms are counted over the sample on the cluster; those of MIN_DOCS
    documents and more come to the driver, which fits the model.
    """
    sample = labelled.sample_texts(docs, labels, "toxic", keep, max_docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"label_id {kind}, label int, terms array<int>"
    found = saved(sample.mapInArrow(_term_batches, shape), "terms")
    n = found.count()
    usual = (found.select(F.explode("terms").alias("term")).groupBy("term").count()
             .where(F.col("count") >= MIN_DOCS).toArrow())
    known = np.zeros(1 << BITS, bool)
    known[usual.column("term").to_numpy()] = True
    got = found.mapInArrow(_only(known), shape).orderBy("label_id").toArrow().combine_chunks()
    lists = got.column("terms").combine_chunks() if n else pa.array([], pa.list_(pa.int32()))
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    return fit_arrays(doc, lists.flatten().to_numpy(), got.column("label").to_numpy().astype(float))


def _only(known: np.ndarray):
    """Drops the terms that are not listed from the rows' term lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            term, off = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            keep = known[term]
            ends = np.concatenate(([0], np.cumsum(keep)))[off]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label_id"), batch.column("label"),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term[keep], pa.int32()))],
                ["label_id", "label", "terms"])
    return run


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (score >= 0.5).

    A null or empty text gets the model's constant; repeated rows stay; other
    columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", SLICE_BYTES):
                p = scores(shared.value, *tx.flat(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    ["id", "score", "predicted"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, score double, predicted int")
            .withColumnRenamed("id", id_col))
