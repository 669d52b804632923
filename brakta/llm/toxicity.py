"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words, lower-cased and stripped of punctuation, and
their first letters, as 32-bit hashes.  Kept are those in at least ``min_docs``
training documents whose share of toxic ones stands further from the base rate
than chance explains, in standard errors; the further, the larger a term's value.
The machine learns a weight for each and, through short factor vectors, one for each
pair, so that two terms can mean together more than each means alone; a pair of
terms neither of which says anything alone is not learned.  A document's values
are divided by their length where that exceeds 1, so a long text doesn't score
high, or low, by its length.  The machine is
trained on the driver, on a bounded sample of labelled rows, and shipped to the
tasks: its size is bounded by the sample, not by the corpus.

Null and empty texts have no terms and get the machine's bias as their score.
Very long texts are read whole; terms count once.  With no labelled rows every
score is 0.5, and with one class only, that class' base rate.  Rows with a null
label are not learned from.  Repeated rows are learned from once and scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brakta.llm.common import Memo, kept, labelled_sample, map_arrow, term_hash, texts

#: Lengths of the word beginnings that are terms.
STEMS = (4, 5)


def bare(chunk: str) -> str:
    """A chunk without the punctuation around it."""
    low = chunk.lower()
    if low.isalnum():
        return low
    start, end = 0, len(low)
    while start < end and not low[start].isalnum():
        start += 1
    while end > start and not low[end - 1].isalnum():
        end -= 1
    return low[start:end]


def word_terms(chunk: str) -> tuple[str, ...]:
    """A word and its beginnings, which its inflected forms share."""
    word = bare(chunk)
    if not word:
        return ()
    return (word, *(f"{word[:n]}-" for n in STEMS if len(word) > n))


def terms(text: str, get) -> set:
    """The distinct terms of a text, through ``get`` (chunk -> hashes or ids)."""
    return set().union(*map(get, set(text.split())))


def chunk_hashes(chunk: str) -> tuple[int, ...]:
    return tuple(map(term_hash, word_terms(chunk)))


def hasher():
    """chunk -> the hashes of its terms; a Python worker keeps the chunks it has met, within the memo's bytes."""
    return kept("term hashes", lambda: Memo(chunk_hashes).__getitem__)


@dataclass
class Machine:
    """Bias, and for the kept hashes (sorted) their values, and weights and factors times those."""

    keys: np.ndarray
    bias: float
    values: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def known(self):
        """chunk -> the ids of its kept terms."""
        where = {int(k): i for i, k in enumerate(self.keys)}
        memo = Memo(lambda chunk: tuple(where[k] for k in chunk_hashes(chunk) if k in where))
        memo.owner = self  # whoever keeps the memo under the machine's identity keeps the machine
        return memo.__getitem__

    def score_texts(self, values: list[str], get) -> np.ndarray:
        """Probabilities of texts, through ``get`` (chunk -> ids)."""
        lists = [np.array(sorted(terms(x, get)), np.int64) for x in values]
        return self.score(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists), len(lists))

    def score(self, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n rows from their (row, term id) entries, rows rising."""
        scale = shrinking(rows, self.values[ids], n)
        linear = np.bincount(rows, self.weights[ids], n)
        both = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[ids, f]
            both += np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + scale * linear + scale**2 * both / 2, -40, 40)))


def shrinking(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """What brings each row's values to length 1 at most."""
    return 1 / np.sqrt(np.maximum(1, np.bincount(rows, values * values, n)))


def places(keys: np.ndarray, terms_: np.ndarray) -> np.ndarray:
    """Where a document's terms stand among the kept ones."""
    at = np.minimum(np.searchsorted(keys, terms_), len(keys) - 1)
    return at[keys[at] == terms_].astype(np.int32)


def telling(keys: np.ndarray, counts: np.ndarray, documents: list[np.ndarray], labels: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys whose documents' labels chance doesn't explain, and their values, 0 to 1.

    The largest of V terms without meaning lies near sqrt(2 ln V) standard errors; ``chance``
    times that is what a term has to exceed.
    """
    own = np.concatenate([d for d, y in zip(documents, labels, strict=True) if y])
    own.sort()
    toxic = np.searchsorted(own, keys, "right") - np.searchsorted(own, keys)
    n, base = len(documents), labels.mean()
    spread = np.sqrt(counts * base * (1 - base) * (n - counts) / (n - 1) + 0.25)
    errors = np.abs(toxic - counts * base) / spread
    least = chance * np.sqrt(2 * np.log(max(len(keys), 2)))
    told = errors > least
    return keys[told], np.sqrt(1 - (least / errors[told]) ** 2)


def train(documents: list[np.ndarray], labels: np.ndarray, factors: int = 8, min_docs: int = 5, chance: float = 0.75, epochs: int = 60, rate: float = 0.3, decay: float = 1e-3, seed: int = 11) -> Machine:
    """Logistic loss by AdaGrad over small batches; the same machine for the same sample."""
    none = np.zeros(0, np.uint32), np.zeros(0)
    if not len(documents):
        return Machine(none[0], 0.0, none[1], np.zeros(0), np.zeros((0, factors)))
    # Sorted in place: the terms of all documents are held twice at most.
    flat = np.concatenate(documents)
    flat.sort()
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, int)
    counts = np.diff(starts, append=len(flat))
    keys, counts = flat[starts[counts >= min_docs]], counts[counts >= min_docs]
    del flat, starts
    base = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(base / (1 - base)))
    keys, x = telling(keys, counts, documents, labels, chance) if 0 < labels.mean() < 1 else none
    w, v = np.zeros(len(keys)), np.zeros((len(keys), factors))
    if not len(keys):
        return Machine(keys, bias, x, w, v)
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.05, v.shape)
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    known = [places(keys, d) for d in documents]
    pull = decay * 128 / len(documents)
    for _ in range(epochs):
        order = rng.permutation(len(documents))
        for batch in np.array_split(order, max(1, len(order) // 128)):
            cols = np.concatenate([known[d] for d in batch])
            rows = np.repeat(np.arange(len(batch)), [len(known[d]) for d in batch])
            scale = shrinking(rows, x[cols], len(batch))
            xs = x[cols] * scale[rows]
            vs = v[cols] * xs[:, None]
            sums = np.stack([np.bincount(rows, vs[:, f], len(batch)) for f in range(factors)], 1)
            squares = np.bincount(rows, (vs * vs).sum(1), len(batch))
            out = bias + np.bincount(rows, w[cols] * xs, len(batch)) + ((sums**2).sum(1) - squares) / 2
            miss = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - labels[batch]) / len(batch)
            push = miss[rows] * xs
            dw = np.bincount(cols, push, len(w)) + pull * w
            dv = np.stack([np.bincount(cols, push * (sums[rows, f] - vs[:, f]), len(w)) for f in range(factors)], 1) + pull * v
            gw += dw**2
            gv += dv**2
            gb += miss.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= rate * 0.3 * dv / np.sqrt(gv)
            bias -= float(rate * 0.3 * miss.sum() / np.sqrt(gb))
    return Machine(keys, bias, x, w * x, v * x[:, None])


def hashed_terms(docs: DataFrame, columns: str) -> DataFrame:
    """Adds ``terms``, a binary of sorted unsigned 32-bit hashes, in place of the text."""
    kept = [c.split()[0] for c in columns.split(", ")]

    def make():
        get = hasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [np.array(sorted(terms(x, get)), np.uint32).tobytes() for x in texts(batch)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.binary())], [*kept, "terms"])

        return step

    return map_arrow(docs.select(*kept, "text"), make, f"{columns}, terms binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 12_000, sample_bytes: int = 48 << 20, key: str = "doc_id", text: str = "text") -> Machine:
    """Learns from ``sample_rows`` of the labelled rows given, and ``sample_bytes`` of their texts, at most."""
    got = hashed_terms(labelled_sample(docs, labels, label, sample_rows, sample_bytes, key, text), "doc_id long, y int").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["terms"])))
    return train([np.frombuffer(r["terms"], np.uint32) for r in got], np.array([r["y"] for r in got], float))


def score(docs: DataFrame, machine: Machine, held_out: Column, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        model = shipped.value
        get = kept(("known terms", id(model)), model.known)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.score_texts(texts(batch), get))], ["doc_id", "held_out", "score"])

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    scored = map_arrow(rows, make, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, machine: Machine, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        model = shipped.value
        get = kept(("known terms", id(model)), model.known)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(model.score_texts(texts(batch, text), get) < threshold))

        return step

    return map_arrow(docs, make, docs.schema)
