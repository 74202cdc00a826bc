"""Quality by attention over passages: multiple-instance learning from labels of whole documents.

A text is a bag of passages of PASSAGE bytes. Each passage is described by how often its bytes, in
classes, follow each other; an encoder turns that into a short vector h. Gated attention gives it
the weight softmax(w (tanh(V h) * sigmoid(U h))) in its document, and a logistic unit scores the
weighted sum. All of it is learned at once, from labels of documents alone, on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import buffers, crc_fold, map_texts, passes

#: Bytes of a passage; size of the encoding and of the attention.
PASSAGE, HIDDEN, GATE = 400, 24, 12
#: Documents to learn from at most, and passages of all of them; passages of one, beyond which neighbouring ones are averaged.
FIT_DOCS, FIT_TOTAL, FIT_BAG = 6000, 150_000, 5000
#: Steps of learning, documents and, on the average, passages of a step at most, and rate.
STEPS, BATCH, STEP, RATE = 700, 256, 8192, 0.01

#: Classes of bytes: small and capital letters, digits, kinds of space, of punctuation and of signs, and all beyond ASCII.
_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".,;:", "!?", "#$%&*", "|", "'\"()[]{}<>", "-_=+/\\@~^`")
KINDS = len(_GROUPS) + 2
_KIND = np.full(256, KINDS - 2, np.uint8)
_KIND[128:] = KINDS - 1
for _i, _chars in enumerate(_GROUPS):
    _KIND[list(_chars.encode())] = _i
WIDTH = KINDS * KINDS + 2


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the rows' offsets among them; an empty text is one empty passage."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PASSAGE))
    at = np.concatenate([[0], np.cumsum(count)])
    n = int(at[-1])
    out = np.zeros((n, WIDTH), np.float32)
    first = np.repeat(offsets[:-1], count) + (np.arange(n) - np.repeat(at[:-1], count)) * PASSAGE
    length = np.minimum(PASSAGE, np.repeat(offsets[1:], count) - first)
    if len(data):
        of = np.repeat(np.arange(n, dtype=np.int64), length)
        kind = _KIND[data].astype(np.int64)
        pair = of * (KINDS * KINDS) + kind * KINDS
        pair[:-1] += kind[1:]
        # a pair that runs over the end of a passage counts as the byte after itself
        last = first[length > 0] + length[length > 0] - 1
        pair[last] = of[last] * (KINDS * KINDS) + kind[last] * (KINDS + 1)
        out[:, : KINDS * KINDS] = np.bincount(pair, minlength=n * KINDS * KINDS).reshape(n, -1)
        out[:, : KINDS * KINDS] /= np.maximum(length, 1)[:, None]
        np.sqrt(out, out=out)
    out[:, -2] = np.log1p(length) / 6
    out[:, -1] = np.log1p(np.repeat(size, count)) / 12
    return out, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict, x: np.ndarray, at: np.ndarray) -> tuple:
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (t * g) @ p["w"]
    size = np.diff(at)
    a = np.exp(s - np.repeat(np.maximum.reduceat(s, at[:-1]), size))
    a /= np.repeat(np.add.reduceat(a, at[:-1]), size)
    z = np.add.reduceat(h * a[:, None], at[:-1], axis=0)
    return h, t, g, a, z, _sigmoid(z @ p["c"] + p["b"])


def score(p: dict, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _forward(p, x, at)[-1]


def gradient(p: dict, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict:
    """Gradient of the mean log loss by each parameter."""
    size = np.diff(at)
    h, t, g, a, z, s = _forward(p, x, at)
    d = ((s - y) / len(y)).astype(x.dtype)
    dzr = np.repeat(d[:, None] * p["c"], size, axis=0)
    da = (dzr * h).sum(1)
    ds = a * (da - np.repeat(np.add.reduceat(a * da, at[:-1]), size))
    dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
    dh = (dzr * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"c": z.T @ d, "b": d.sum(keepdims=True), "w": (t * g).T @ ds, "V": h.T @ dt, "U": h.T @ dg, "E": x.T @ dh, "e": dh.sum(0)}


def start(seed: int = 1) -> dict:
    """Parameters that learning begins with."""
    r = np.random.RandomState(seed)
    return {"E": r.randn(WIDTH, HIDDEN) * 0.3, "e": np.zeros(HIDDEN), "V": r.randn(HIDDEN, GATE) * 0.3, "U": r.randn(HIDDEN, GATE) * 0.3, "w": r.randn(GATE) * 0.3, "c": r.randn(HIDDEN) * 0.1, "b": np.zeros(1)}


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, seed: int = 1) -> dict:
    """Parameters from passages ``x``, offsets ``at`` of documents and their labels ``y``; Adam on the log loss."""
    p = {k: q.astype(np.float32) for k, q in start(seed).items()}
    if not len(y):
        return p
    r = np.random.RandomState(seed)
    m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
    batch = max(2, min(BATCH, STEP * len(y) // int(at[-1])))  # the same number of documents each time, so none is favoured
    for step in range(1, STEPS + 1):
        docs = r.randint(0, len(y), batch)
        size = np.diff(at)[docs]
        own = np.concatenate([[0], np.cumsum(size)])
        rows = np.arange(own[-1]) + np.repeat(at[docs] - own[:-1], size)
        grad = gradient(p, x[rows].astype(np.float32), own, y[docs])
        for k in p:
            q = grad[k] + np.float32(1e-5) * p[k]
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.999 * v[k] + 0.001 * q * q
            p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def _bags(data: np.ndarray, offsets: np.ndarray) -> dict:
    """All passages of each text in half precision; of a text with more than FIT_BAG, means of as many neighbours as bring it there."""
    x, at = passages(data, offsets)
    rows = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own, n = x[a:b], -(-(b - a) // FIT_BAG)
        if n > 1:
            first = np.arange(0, b - a, n)
            own = np.add.reduceat(own, first) / np.diff(np.append(first, b - a))[:, None]
        rows.append(own.astype(np.float16).tobytes())
    return {"x": pa.array(rows, pa.binary())}


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """Parameters from labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Of these FIT_DOCS are taken by the hash of the id, or as many as have FIT_TOTAL passages together, each with
    all of its passages, so attention is learned over the same bags as it is used on. A row that is gathered has 1.7 MB at most, and 51 MB
    in all come to the driver. A text of more than FIT_BAG passages, 2 MB, gives means of neighbouring ones, so all of it is learned from.
    Null labels and ids are left out; of labels that contradict each other the larger one counts, of rows that share an id one by the hash of its text.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    own = own.where(crc_fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).join(F.broadcast(own), "doc_id")
    count = F.least(F.ceil(F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)) / PASSAGE), F.lit(FIT_BAG))
    sizes = texts.groupBy("doc_id").agg(F.min(F.struct("h", count.alias("n"))).alias("m")).select("doc_id", "m.h", "m.n").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    taken = sizes[(sizes.n.cumsum() <= FIT_TOTAL).to_numpy()] if len(sizes) else sizes
    if not len(taken):
        return fit(np.zeros((0, WIDTH)), np.zeros(1, np.int64), np.zeros(0))
    ids = docs.sparkSession.createDataFrame(list(zip(taken.doc_id.tolist(), taken.h.tolist(), strict=True)), "doc_id long, h long")
    few = map_texts(texts.join(F.broadcast(ids), ["doc_id", "h"]), "text", ["doc_id", "y"], "doc_id long, y double, x binary", _bags)
    few = few.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    data, edge = buffers(few.column("x"))
    x = np.frombuffer(data[edge[0] : edge[-1]], np.float16).reshape(-1, WIDTH)
    return fit(x, (edge - edge[0]) // (2 * WIDTH), few.column("y").to_numpy())


def scored(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` for each row, over all passages of its text; a null or empty text is one empty passage."""
    own = {k: v.astype(np.float32) for k, v in model.items()}

    def work(data: np.ndarray, offsets: np.ndarray) -> dict:
        return {"score": pa.array(score(own, *passages(data, offsets)).astype(np.float64))}

    types = dict(docs.dtypes)
    return map_texts(docs, text, list(keep), ", ".join(f"`{k}` {types[k]}" for k in keep) + ", score double", work)


def scorer(model: dict):
    """The score of a text column as an expression."""
    own = {k: v.astype(np.float32) for k, v in model.items()}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = buffers(texts)
            yield pa.array(np.concatenate([np.zeros(0), *(score(own, *passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])).astype(np.float64) for a, b in passes(offsets))]))

    return F.arrow_udf(run, "double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    A null or empty text is one empty passage and has a score; a long text is scored over all its passages. Equal texts
    have equal scores, and rows that repeat stay as many as they are. Without any label all scores are what
    the model starts from. No rows give no rows; other columns are not looked at.
    """
    model = learned(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(rows, model)
    return out.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
