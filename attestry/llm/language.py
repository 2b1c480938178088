"""Language of documents by a linear-chain conditional random field over their words.

Each word of a text (a run of letters, in lower case) gets a score per language from its letter pairs and triples,
its first and last letters, and itself (the lexicon); a learned matrix scores the change of language from
one word to the next. Forward-backward gives every word its language probabilities inside the sentence around it, so
code-switched text is labelled word by word; a document's language is the one with the most expected words.

The model is fitted on about `per_language` labelled documents of each language (chosen by a hash of doc_id), from
`fragments` stretches of each, anywhere in its whole text. Training sequences splice pieces of different documents, so that
the transitions see language changes. Prediction reads whole texts and nothing but the text. Chains are cut into blocks of
32 words whose transfer matrices are multiplied first; that is exact and keeps numpy busy however long a text is.

Defined results: null texts and texts without a letter are `und` with score 0; so is everything if no labelled document
exists. Equal scores go to the language first in alphabetical order. Repeated rows get equal results. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import share_of
from .words import mix, slices

SLOTS = 1 << 15
BLOCK = 32
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@dataclass
class Features:
    """Feature slots of the words of some texts: per letter (pairs, triples) and per word."""

    pair: np.ndarray
    triple: np.ndarray
    begin: np.ndarray  # of each word in `pair` and `triple`
    word: np.ndarray  # (words, 3): lexicon, prefix, suffix
    first: np.ndarray  # per text, and one more: words before it


def _slot(*parts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(parts[0]), np.uint64)
    for i, p in enumerate(parts):
        total += p.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF)
    return (mix(total) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def features(texts: list[str]) -> Features:
    lowered = [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in lowered], np.int64)
    code = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le"), "<u4") if lowered else np.zeros(0, np.uint32)
    inside = _letters()[code]
    before, after = np.zeros(len(code), bool), np.zeros(len(code), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    at = np.flatnonzero(inside)
    previous = np.where(before[at], code[at - 1], 0)
    following = np.where(after[at], code[np.minimum(at + 1, len(code) - 1)], 0)
    begin = np.searchsorted(at, start)
    one = np.full(len(at), 1)
    pair, triple = _slot(code[at], following, one), _slot(previous, code[at], following, one * 2)
    place = at - np.repeat(start, np.diff(np.append(begin, len(at)))) if len(at) else at
    letter = mix(code[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)))
    whole = np.add.reduceat(letter, begin) if len(begin) else letter[:0]
    n = last - start + 1

    def letter_at(where, ok):
        return np.where(ok, code[np.clip(where, 0, len(code) - 1)], 0)

    ones = np.ones(len(start), np.int64)
    prefix = _slot(code[start], letter_at(start + 1, n > 1), letter_at(start + 2, n > 2), ones * 3)
    suffix = _slot(code[last], letter_at(last - 1, n > 1), letter_at(last - 2, n > 2), ones * 4)
    word = np.stack([_slot(whole, ones * 5), prefix, suffix], axis=1) if len(start) else np.zeros((0, 3), np.int64)
    ends = np.cumsum(size)
    return Features(pair, triple, begin, word, np.searchsorted(start, np.concatenate([[0], ends])))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (SLOTS, languages)
    change: np.ndarray  # (languages, languages), log

    def emissions(self, f: Features) -> np.ndarray:
        """Log score of every word for every language."""
        if not len(f.begin):
            return np.zeros((0, len(self.languages)))
        letters = self.weights[f.pair] + self.weights[f.triple]
        return (np.add.reduceat(letters, f.begin, axis=0) + self.weights[f.word].sum(axis=1)).astype(np.float64)


def expected_words(log_score: np.ndarray, first: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Per text the expected number of words of each label (texts, labels), by forward-backward.

    The word before the first has a uniform label. Block products make it exact for chains of any length."""
    n_texts, labels = len(first) - 1, log_score.shape[1]
    out = np.zeros((n_texts, labels))
    count = np.diff(first)
    blocks = -(-count // BLOCK)
    total = int(blocks.sum())
    if not total:
        return out
    step = np.exp(change)
    owner = np.repeat(np.arange(n_texts), blocks)
    rank = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[owner] + rank * BLOCK
    size = np.minimum(first[owner + 1] - begin, BLOCK)
    score = np.ones((BLOCK, total, labels))
    for t in range(BLOCK):
        live = np.flatnonzero(size > t)
        e = log_score[begin[live] + t]
        score[t, live] = np.exp(e - e.max(axis=1, keepdims=True))
    # transfer matrix of each block
    move = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(int(size.max())):
        live = size > t
        next_move = (move.reshape(-1, labels) @ step).reshape(total, labels, labels) * score[t][:, None, :]
        next_move /= next_move.max(axis=(1, 2), keepdims=True)
        move = next_move if live.all() else np.where(live[:, None, None], next_move, move)
    # messages into and behind each block, block by block along the texts
    into, behind = np.full((total, labels), 1.0 / labels), np.ones((total, labels))
    by_rank = np.argsort(rank, kind="stable")
    edges = np.searchsorted(rank[by_rank], np.arange(int(rank.max()) + 2))
    for j in range(1, len(edges) - 1):
        b = by_rank[edges[j]:edges[j + 1]]
        v = np.einsum("bi,bij->bj", into[b - 1], move[b - 1])
        into[b] = v / v.sum(axis=1, keepdims=True)
    for j in range(len(edges) - 2, 0, -1):
        b = by_rank[edges[j]:edges[j + 1]]
        v = np.einsum("bij,bj->bi", move[b], behind[b])
        behind[b - 1] = v / v.sum(axis=1, keepdims=True)
    # inside the blocks
    longest = int(size.max())
    ahead = np.empty((longest, total, labels))
    v = into
    for t in range(longest):
        v = (v @ step) * score[t]
        v = v / v.sum(axis=1, keepdims=True)
        v = np.where((size > t)[:, None], v, into if t == 0 else ahead[t - 1])
        ahead[t] = v
    back, sums = behind, np.zeros((total, labels))
    for t in range(longest - 1, -1, -1):
        live = (size > t)[:, None]
        g = ahead[t] * back
        sums += np.where(live, g / g.sum(axis=1, keepdims=True), 0.0)
        v = (score[t] * back) @ step.T
        back = np.where(live, v / v.sum(axis=1, keepdims=True), back)
    np.add.at(out, owner, sums)
    return out


def fit(texts: list[str], labels: list[str], *, sequences: int = 4000, rounds: int = 30, seed: int = 7) -> Model:
    """Maximum likelihood by adaptive gradient steps on spliced fragments of the labelled texts."""
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    source = features(texts)
    truth = np.array([number[x] for x in labels])
    usable = np.flatnonzero(np.diff(source.first) > 0)
    n_labels = len(languages)
    weights, change = np.zeros((SLOTS, n_labels), np.float64), np.zeros((n_labels, n_labels))
    if not len(usable):
        return Model(languages, weights.astype(np.float32), change)
    rng = np.random.default_rng(seed)
    length = 40
    words, gold = np.full((sequences, length), -1), np.zeros((sequences, length), np.int64)
    by_label = [usable[truth[usable] == k] for k in range(n_labels)]
    present = [k for k in range(n_labels) if len(by_label[k])]
    for s in range(sequences):
        at = 0
        while at < length:
            d = rng.choice(by_label[present[rng.integers(len(present))]])
            own = int(source.first[d + 1] - source.first[d])
            take = min(int(rng.integers(6, length + 1)), length - at, own)
            begin = source.first[d] + rng.integers(own - take + 1)
            words[s, at:at + take], gold[s, at:at + take] = np.arange(begin, begin + take), truth[d]
            at += take
    used, place = np.unique(words, return_inverse=True)
    place = place.reshape(words.shape)
    # the letters' features of the words in use, word by word
    ends = np.append(source.begin, len(source.pair))
    per_word = (ends[1:] - ends[:-1])[used]
    letter = np.arange(int(per_word.sum())) - np.repeat(np.cumsum(per_word) - per_word, per_word) + np.repeat(source.begin[used], per_word)
    slots = np.concatenate([source.pair[letter], source.triple[letter], *source.word[used].T])
    row = np.concatenate([np.repeat(np.arange(len(used)), per_word)] * 2 + [np.arange(len(used))] * 3)
    grad_w, grad_c = np.full(weights.shape, 1e-8), np.full(change.shape, 1e-8)
    onehot = np.eye(n_labels)[gold]
    observed_change = np.einsum("nta,ntb->ab", onehot[:, :-1], onehot[:, 1:])
    for _ in range(rounds):
        score = np.stack([np.bincount(row, weights[slots, k], len(used)) for k in range(n_labels)], axis=1)[place]
        p, step = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(change)
        ahead = np.empty_like(p)
        v = np.full((sequences, n_labels), 1.0 / n_labels)
        for t in range(length):
            v = (v @ step) * p[:, t]
            v /= v.sum(axis=1, keepdims=True)
            ahead[:, t] = v
        back = np.ones((sequences, n_labels))
        gamma, pairs = np.empty_like(p), np.zeros_like(change)
        for t in range(length - 1, -1, -1):
            g = ahead[:, t] * back
            gamma[:, t] = g / g.sum(axis=1, keepdims=True)
            if t:
                x = ahead[:, t - 1][:, :, None] * step * (p[:, t] * back)[:, None, :]
                pairs += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = (p[:, t] * back) @ step.T
            back /= back.sum(axis=1, keepdims=True)
        miss = np.zeros((len(used), n_labels))
        np.add.at(miss, place, onehot - gamma)
        slope = np.stack([np.bincount(slots, miss[row, k], SLOTS) for k in range(n_labels)], axis=1) - 0.05 * weights
        slope_c = observed_change - pairs - 0.05 * change
        grad_w += slope ** 2
        grad_c += slope_c ** 2
        weights += 0.3 * slope / np.sqrt(grad_w)
        change += 0.2 * slope_c / np.sqrt(grad_c)
    return Model(languages, weights.astype(np.float32), change)


def learn(labelled: DataFrame, *, per_language: int = 400, fragments: int = 8, length: int = 250) -> Model:
    """Fit on a bounded sample of `labelled` (doc_id, text, lang): about `per_language` documents of each language at most, and of each
    document `fragments` stretches of `length` characters from anywhere in its text, as the fit works on short sequences only."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    chosen = reduce(lambda x, y: x | y, [(F.col("lang") == r["lang"]) & share_of("doc_id", per_language, r["n"]) for r in counts], F.lit(False))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(fragments - 1)), lambda k: F.pmod(
        F.xxhash64("doc_id", k), F.greatest(F.char_length("text") - length, F.lit(0)) + 1).cast("int") + 1))
    rows = known.filter(chosen).select("doc_id", "lang", "text").distinct().select(
        "doc_id", "lang", F.explode(F.transform(places, lambda at: F.substring("text", at, F.lit(length)))).alias("text")).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score (0 to 1): the share of its words expected in that language."""
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: Model = shared.value
            for part in slices(batch, "text", 1 << 20):
                f = features([t.as_py() or "" for t in part.column("text")])
                count = np.diff(f.first)
                name, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if own.languages:
                    expected = expected_words(own.emissions(f), f.first, own.change)
                    share = expected / np.maximum(count, 1)[:, None]
                    best = np.where(count > 0, share.argmax(axis=1), -1)
                    name = [own.languages[b] if b >= 0 else UNKNOWN for b in best]
                    score = np.clip(np.where(count > 0, share.max(axis=1), 0.0), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(name, pa.string()), pa.array(score)],
                                                 [*others, "lang_pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in others], "lang_pred string, score double"])
    return docs.select(*others).mapInArrow(run, schema)


def held_out(doc_id: Column | str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is kept from learning, by the checksum of its id as text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == fold, F.lit(False))
