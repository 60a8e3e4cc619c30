"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded as shape statistics and
hashed word counts, passed through a learned tanh layer, and weighted by learned gated
attention, softmax(w . (tanh(V e) * sigmoid(U e))); the weighted passage representation is
scored by a logistic unit. All weights are learned together from document labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, text_slices
from .shingles import words

SLICE_BYTES = 1 << 20
PASSAGE_WORDS = 64
HASHED = 32
#: at most so many labelled documents are fitted, with all their passages, and about so many bytes of text
FIT_DOCUMENTS = 2048
FIT_BYTES = 256 << 20
HIDDEN, ATTENTION = 16, 8

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 6
_CLASS[[ord(c) for c in "%*$#&@^~<>{}[]\\/=+_`"]] = 7
_CLASS[128:] = 8
N_CLASSES = 9
DIM = N_CLASSES + 5 + HASHED


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, bounds of each document's passages); a text without words is one empty passage."""
    n = len(offsets) - 1
    starts, sizes, h, doc = words(data, offsets)
    counts = np.bincount(doc, minlength=n)
    per = np.maximum(1, -(-counts // PASSAGE_WORDS))
    bounds = np.concatenate([[0], np.cumsum(per)])
    rows = int(bounds[-1])
    x = np.zeros((rows, DIM), np.float32)
    if not len(starts):
        return x, bounds
    within = np.arange(len(starts)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    passage = bounds[doc] + within // PASSAGE_WORDS
    total = np.maximum(1, np.bincount(passage, minlength=rows)).astype(np.float32)
    byte_passage = np.repeat(passage, sizes)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    kinds = np.bincount(byte_passage * N_CLASSES + _CLASS[data[at]], minlength=rows * N_CLASSES).reshape(rows, N_CLASSES)
    x[:, :N_CLASSES] = kinds / np.maximum(1, kinds.sum(1, keepdims=True))
    x[:, N_CLASSES] = np.bincount(passage, sizes, rows) / total / 8
    x[:, N_CLASSES + 1] = np.bincount(passage, sizes == 1, rows) / total
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    x[:, N_CLASSES + 2] = np.bincount(passage, again, rows) / total
    key = np.sort((h >> np.uint64(20)) | (passage.astype(np.uint64) << np.uint64(44)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    x[:, N_CLASSES + 3] = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=rows) / total
    x[:, N_CLASSES + 4] = np.log1p(total) / 4
    bucket = passage * HASHED + (h >> np.uint64(59)).astype(np.int64)
    x[:, N_CLASSES + 5 :] = np.bincount(bucket, minlength=rows * HASHED).reshape(rows, HASHED) / total[:, None]
    return x, bounds


def _forward(m: dict, x: np.ndarray, bounds: np.ndarray) -> dict:
    lows = bounds[:-1]
    e = np.tanh((x - m["mean"]) / m["scale"] @ m["W"] + m["b"])
    v, u = np.tanh(e @ m["V"]), 1 / (1 + np.exp(-(e @ m["U"])))
    a = (v * u) @ m["w"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, lows), np.diff(bounds)))
    a = a / np.repeat(np.add.reduceat(a, lows), np.diff(bounds))
    z = np.add.reduceat(a[:, None] * e, lows)
    return {"e": e, "v": v, "u": u, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30)))}


def fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> dict:
    """Full-batch Adam on the log loss; the same bags give the same model."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    small = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    m = {"mean": x.mean(0), "scale": x.std(0) + 1e-2, "W": small(DIM, HIDDEN), "b": np.zeros(HIDDEN), "V": small(HIDDEN, ATTENTION), "U": small(HIDDEN, ATTENTION), "w": small(ATTENTION), "c": small(HIDDEN), "d": np.zeros(1)}
    learned = ("W", "b", "V", "U", "w", "c", "d")
    first, second = ({k: np.zeros_like(m[k]) for k in learned} for _ in range(2))
    xs, sizes, lows, n = (x - m["mean"]) / m["scale"], np.diff(bounds), bounds[:-1], len(y)
    for t in range(1, steps + 1):
        s = _forward(m, x, bounds)
        g = (s["p"] - y) / n
        grad = {"c": s["z"].T @ g, "d": np.array([g.sum()])}
        gz = np.repeat(g[:, None] * m["c"], sizes, axis=0)
        dot = (gz * s["e"]).sum(1)
        ga = s["a"] * (dot - np.repeat(np.add.reduceat(s["a"] * dot, lows), sizes))
        grad["w"] = (s["v"] * s["u"]).T @ ga
        gv, gu = ga[:, None] * m["w"] * s["u"] * (1 - s["v"] ** 2), ga[:, None] * m["w"] * s["v"] * s["u"] * (1 - s["u"])
        grad["V"], grad["U"] = s["e"].T @ gv, s["e"].T @ gu
        ge = (s["a"][:, None] * gz + gv @ m["V"].T + gu @ m["U"].T) * (1 - s["e"] ** 2)
        grad["W"], grad["b"] = xs.T @ ge, ge.sum(0)
        for k in learned:
            d = grad[k] + decay * m[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d**2
            m[k] = m[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return {k: np.asarray(v, np.float32) for k, v in m.items()}


def _bags(batches):
    for batch in batches:
        blobs = []
        for _, _, data, offsets in text_slices(batch.column(2), SLICE_BYTES):
            x, bounds = encode(data, offsets)
            blobs += [x[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(bounds) - 1)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["doc_id", "y", "bag"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_documents: int = FIT_DOCUMENTS, fit_bytes: int = FIT_BYTES) -> dict:
    """Fit on at most ``fit_documents`` labelled documents, those with the least hash of their id.

    In that order documents are taken until their texts reach ``fit_bytes``; the one that does is
    the last. A document labelled more than once counts with its largest label, of rows of one id
    the least text counts; null ids and labels are left out. Without a labelled document, or with one label only, the model scores that
    label's share (0.5 without any).
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    # one row an id, so that neither repeated ids nor long texts swell what the driver gets
    texts = materialize(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "fit")
    before = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    sizes = texts.select("doc_id", F.coalesce(before, F.lit(0)).alias("before"))  # at most ``fit_documents`` rows
    texts = texts.join(F.broadcast(sizes.filter(F.col("before") < fit_bytes).select("doc_id")), "doc_id").select("doc_id", "y", "text")
    rows = sorted(texts.mapInArrow(_bags, "doc_id long, y double, bag binary").collect())
    x = [np.frombuffer(r.bag, np.float32).reshape(-1, DIM) for r in rows]
    y = np.array([r.y for r in rows])
    if not rows or y.min() == y.max():
        share = float(y.mean()) if rows else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        flat = {"mean": np.zeros(DIM), "scale": np.ones(DIM), "W": np.zeros((DIM, HIDDEN)), "b": np.zeros(HIDDEN), "V": np.zeros((HIDDEN, ATTENTION)), "U": np.zeros((HIDDEN, ATTENTION)), "w": np.zeros(ATTENTION), "c": np.zeros(HIDDEN), "d": np.array([np.log(share / (1 - share))])}
        return {k: np.asarray(v, np.float32) for k, v in flat.items()}
    return fit(np.concatenate(x), np.concatenate([[0], np.cumsum([len(b) for b in x])]), y)


def _scored(model, into):
    def run(batches):
        m = model.value
        for batch in batches:
            out = []
            for _, _, data, offsets in text_slices(batch.column(0), SLICE_BYTES):
                out.append(_forward(m, *encode(data, offsets))["p"].astype(np.float64))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.record_batch([*batch.columns[1:], pa.array(score)], names=[*batch.schema.names[1:], into])

    return run


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """The ``keep`` columns and ``into`` (0 to 1) of every row, from its text alone.

    A null text counts as empty, which is one empty passage; long texts are read whole. Repeated
    rows and equal texts score alike; an empty table stays empty. The text may be kept too. A
    kept column must not be named like ``into``; columns not kept may be named as they like.
    """
    df = docs.select(F.col(text_col).alias("_text"), *[F.col(f"`{c}`") for c in keep])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[1:]]
    return df.mapInArrow(_scored(shared, into), ", ".join([*types, f"`{into}` double"]))


def keep_good(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with the columns they have."""
    name = free_name(docs, "score")
    return score(docs, model, text_col, tuple(docs.columns), name).filter(F.col(f"`{name}`") >= least).drop(name)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
