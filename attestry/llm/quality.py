"""Quality of documents: random-indexing word vectors, pooled, then a two-layer network with calibrated probabilities.

Random indexing: every word (in lower case) and every run of punctuation falls into one of 8,192 slots by its hash, and each slot
owns a sparse random vector of +1 and -1. Over all documents, a slot's vector is the sum of the random vectors of the two words
before and after its occurrences; tasks add up their own share and one row per slot and task is shuffled. A document is the mean
of its words' vectors, once plain and once with frequent words held down, and six plain shares (distinct words, capitals, digits,
punctuation, length). The word vectors know no label; whole texts are read, never a prefix.

The network (tanh, then a logistic output) is fitted on about `most_labels` labelled documents at most (chosen by a hash of doc_id); a fifth
of them are left out of the fit and set the temperature that calibrates its probabilities.

Defined results: null and empty texts are pooled as zeros and scored like any other; without a label all scores are 0.5. A document
with several labels takes the lowest. Repeated rows get equal scores. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .sampling import share_of
from .words import PUNCTUATION, Words, mix, slices, words_of

SLOTS, WIDTH, NONZERO, REACH = 8192, 32, 4, 2
SHARES = 6
_SPACE_OR_WORD = ~PUNCTUATION | np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_CAPITAL, _DIGIT, _MARK = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(48, 58), np.flatnonzero(~_SPACE_OR_WORD)))


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the random vector of each slot."""
    draw = mix(np.arange(1, SLOTS * NONZERO + 1, dtype=np.uint64)).reshape(SLOTS, NONZERO)
    return (draw % np.uint64(WIDTH)).astype(np.int64), np.where(draw >> np.uint64(63), 1.0, -1.0)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Words, Words]:
    """(slot of each token in order, number of tokens before each text, its words, its punctuation runs)."""
    words, marks = words_of(column, lower=True, apart=PUNCTUATION), words_of(column, apart=_SPACE_OR_WORD)
    at = np.concatenate([words.start, marks.start])
    order = np.argsort(at, kind="stable")
    slot = (np.concatenate([words.name, marks.name])[order] % np.uint64(SLOTS)).astype(np.int64)
    return slot, words.first + marks.first, words, marks


def corpus_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(count, vector) of every slot, from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index_vectors()
        total, seen = np.zeros(SLOTS * WIDTH), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                slot, first, _, _ = _tokens(part.column("text"))
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                seen += np.bincount(slot, minlength=SLOTS)
                for gap in range(1, REACH + 1):
                    same = np.flatnonzero(text[gap:] == text[:-gap])
                    for a, b in ((same, same + gap), (same + gap, same)):
                        for k in range(NONZERO):
                            total += np.bincount(slot[a] * WIDTH + place[slot[b], k], sign[slot[b], k], SLOTS * WIDTH)
        used = np.flatnonzero(seen)
        table = total.reshape(SLOTS, WIDTH)[used]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used]), *[pa.array(table[:, i]) for i in range(WIDTH)]],
                                         ["slot", "n", *[f"v{i}" for i in range(WIDTH)]])

    schema = "slot bigint, n bigint, " + ", ".join(f"v{i} double" for i in range(WIDTH))
    sums = [F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDTH)]
    rows = docs.select("text").mapInArrow(run, schema).groupBy("slot").agg(F.sum("n").alias("n"), *sums).collect()  # a row per slot
    count, vector = np.zeros(SLOTS), np.zeros((SLOTS, WIDTH))
    for r in rows:
        count[r["slot"]], vector[r["slot"]] = r["n"], [r[f"v{i}"] for i in range(WIDTH)]
    return count, vector


def word_vectors(count: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Unit context vectors plus half of each slot's own random vector; a last column damps frequent slots."""
    place, sign = _index_vectors()
    own = np.zeros((SLOTS, WIDTH))
    np.add.at(own, (np.repeat(np.arange(SLOTS), NONZERO), place.ravel()), sign.ravel())
    context = vector / np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-9)
    damp = 1e-3 / (1e-3 + count / max(count.sum(), 1))
    return np.concatenate([context + own / (2 * NONZERO ** 0.5), damp[:, None]], axis=1).astype(np.float32)


def pool(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, pooled): the pooled vector of every text, 32-bit floats as binary."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            table = shared.value
            for part in slices(batch, "text"):
                slot, first, words, marks = _tokens(part.column("text"))
                n = np.diff(first)
                full = np.flatnonzero(n)
                out = np.zeros((part.num_rows, 2 * WIDTH + SHARES), np.float32)
                if len(full):
                    v, damp = table[slot, :WIDTH], table[slot, WIDTH:]
                    begin = first[:-1][full]
                    out[full, :WIDTH] = np.add.reduceat(v, begin, axis=0) / n[full, None]
                    out[full, WIDTH:2 * WIDTH] = np.add.reduceat(v * damp, begin, axis=0) / np.add.reduceat(damp, begin, axis=0)
                    out[:, 2 * WIDTH:] = _shares(part.column("text"), words, marks)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in out], pa.binary())], ["doc_id", "pooled"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, pooled binary")


def _shares(column: pa.Array, words: Words, marks: Words) -> np.ndarray:
    from .words import text_bytes
    data, at = text_bytes(column)
    size = np.maximum(np.diff(at), 1)
    count = np.diff(words.first)
    pair = np.unique(mix(words.name + words.text_of().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(words.text_of()[pair], minlength=len(count)) / np.maximum(count, 1)

    def share(kind):
        sums = np.concatenate([[0], np.cumsum(kind[data])])
        return (sums[at[1:]] - sums[at[:-1]]) / size

    return np.stack([distinct, share(_CAPITAL), share(_DIGIT), share(_MARK), np.log1p(count) / 10,
                     np.diff(marks.first) / np.maximum(count, 1)], axis=1)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, hidden: int = 24, epochs: int = 60, rate: float = 0.004, seed: int = 5) -> Network | None:
    """Adam on mini-batches; the temperature minimises the log loss of the fifth left out."""
    if not len(y):
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, kept = order[:len(y) // 5], order[len(y) // 5:]
    mean, scale = x[kept].mean(axis=0), x[kept].std(axis=0) + 1e-3
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), 0.0, 1.0)
    params = {"first": net.first, "first_bias": net.first_bias, "second": net.second, "second_bias": np.zeros(1)}
    m, v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
    z, step = (x - mean) / scale, 0
    for _ in range(epochs):
        rng.shuffle(kept)
        for at in range(0, len(kept), 256):
            b = kept[at:at + 256]
            h = np.tanh(z[b] @ params["first"] + params["first_bias"])
            p = 1 / (1 + np.exp(-np.clip(h @ params["second"] + params["second_bias"], -30, 30)))
            d = (p - y[b]) / len(b)
            back = np.outer(d, params["second"]) * (1 - h * h)
            slope = {"second": h.T @ d, "second_bias": d.sum(keepdims=True), "first": z[b].T @ back, "first_bias": back.sum(axis=0)}
            step += 1
            for k, g in slope.items():
                g = g + 1e-4 * params[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    net.second_bias = float(params["second_bias"][0])
    if len(held):
        logit, best = net.logits(x[held]), np.inf
        for t in np.geomspace(0.3, 5, 40):
            loss = np.logaddexp(0, np.where(y[held] == 1, -logit, logit) / t).mean()
            if loss < best:
                best, net.temperature = loss, float(t)
    return net


def score_documents(docs: DataFrame, labels: DataFrame, *, most_labels: int = 20_000) -> DataFrame:
    """(doc_id, score) for all of `docs`, learning from `labels` (doc_id, quality 0 or 1)."""
    count, vector = corpus_vectors(docs)
    pooled = settle(pool(docs, word_vectors(count, vector)), "pooled")
    known = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
             .agg(F.min("quality").alias("quality")))
    chosen = known.filter(share_of("doc_id", most_labels, known.count()))  # the bounded training sample
    rows = sorted(pooled.join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "pooled", "quality").collect(), key=lambda r: r["doc_id"])
    width = 2 * WIDTH + SHARES
    x = np.array([np.frombuffer(r["pooled"], np.float32) for r in rows], np.float64).reshape(len(rows), width)
    net = fit(x, np.array([float(r["quality"]) for r in rows]))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            own = shared.value
            x = np.frombuffer(b"".join(batch.column("pooled").to_pylist()), np.float32).reshape(batch.num_rows, width)
            score = np.full(batch.num_rows, 0.5) if own is None else own.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return pooled.mapInArrow(run, "doc_id bigint, score double")
