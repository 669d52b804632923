"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and tokens that tell its form (shares of capitals,
punctuation, digits and repeated words, the shape of lines), all hashed.  How much
a form token weighs beside a word is learned: of a few weights, none among them,
that one is taken whose votes, learned on one half of the labelled rows, fit the
other half best.  From a bounded sample of labelled rows, weighted counts are
factored by a truncated singular value decomposition; the projection and the
labelled vectors, whose size the sample bounds, are shipped to the tasks.  Every
document's cosine with every labelled vector is computed exactly, block by block,
in double precision, and its nearest neighbours vote with their similarity as
weight.  Similarities are rounded to nine digits, so that they do not depend on
the block; of equal ones the earlier labelled row counts (by id, label, terms).

Null and empty texts, and texts of unknown terms only, still have form tokens or
else get the labelled base rate.  With no labelled rows every score is 0.5.
Rows with a null label are not learned from.  Repeated rows are learned from once
and scored alike.  Very long texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brakta.llm.common import Memo, kept, labelled_sample, map_arrow, term_hash, texts
from brakta.llm.topk import best
from brakta.llm.toxicity import bare

#: Weights of a form token beside a word, among which the labelled rows decide.
FORM_WEIGHTS = (0.0, 1.0, 3.0, 6.0)


def step_of(share: float) -> int:
    """A share in 0..1 as one of 13 steps, finer near 0."""
    return round(12 * min(1.0, max(0.0, share)) ** 0.5)


def form(text: str, chunks: list[str], counts: Counter) -> list[str]:
    """Tokens for how a text is made, whatever its language."""
    n, size = max(1, len(chunks)), max(1, len(text))
    lines = text.split("\n")
    shares = {
        "distinct": len(counts) / n,
        "top": max(counts.values(), default=0) / n,
        "runs": sum(map(str.__eq__, chunks, chunks[1:])) / n,
        "capitals": sum(map(str.isupper, chunks)) / n,
        "words": sum(map(str.isalpha, chunks)) / n,
        "bare": sum(map(str.isalnum, chunks)) / n,
        "digits": sum(map(str.isdigit, chunks)) / n,
        "bangs": text.count("!") / size * 5,
        "bars": text.count("|") / size * 5,
        "stops": text.count(".") / n,
        "commas": text.count(",") / n,
        "braces": sum(map(text.count, "{}<>=;#@$%&*/\\")) / size * 5,
        "lines": len(lines) / n,
        "same lines": 1 - len(set(lines)) / len(lines),
        "long": sum(map(len, chunks)) / n / 20,
    }
    return [f"\0{k} {step_of(v)}" for k, v in shares.items()] + [f"\0size {min(12, n.bit_length())}"]


def weighted_terms(text: str, get, form_weight: float) -> dict[int, float]:
    """hash -> weight: damped counts of words, and form tokens."""
    chunks = text.split()
    counts = Counter(chunks)
    found: dict[int, float] = {}
    for chunk, n in counts.items():
        k = get(chunk)
        if k is not None:
            found[k] = found.get(k, 0) + n
    out = {k: 1 + float(np.log(n)) for k, n in found.items()} if len(found) < 64 else dict(zip(found, (1 + np.log(np.fromiter(found.values(), float))).tolist(), strict=True))
    if chunks and form_weight:
        for token in form(text, chunks, counts):
            out[term_hash(token)] = form_weight
    return out


def sparse(docs: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    keys = np.fromiter((k for d in docs for k in d), np.int64, len(rows))
    return rows, keys, np.fromiter((w for d in docs for w in d.values()), float, len(rows))


def product(rows, cols, vals, dense: np.ndarray, n: int) -> np.ndarray:
    """A sparse matrix by a dense one, entry lists in any order."""
    out = np.empty((n, dense.shape[1]))
    for f in range(dense.shape[1]):
        out[:, f] = np.bincount(rows, vals * dense[cols, f], n)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Voters:
    """Kept hashes (sorted), their projection, and the labelled vectors with their labels."""

    keys: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    form_weight: float = FORM_WEIGHTS[-1]
    neighbours: int = 25

    def embed(self, rows: np.ndarray, keys: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
        """Unit vectors of n rows from their entries, rows rising."""
        out = np.zeros((n, self.projection.shape[1]))
        if len(self.keys) and len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            rows, at, vals = rows[known], at[known], vals[known]
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            if len(rows):
                out[rows[starts]] = np.add.reduceat(self.projection[at] * vals[:, None], starts, axis=0)
        return unit(out)

    def vote(self, own: np.ndarray) -> np.ndarray:
        """The scores of unit vectors."""
        n = len(self.labels)
        if not n:
            return np.full(len(own), 0.5)
        base, k, out = self.labels.mean(), min(self.neighbours, n), np.empty(len(own))
        for at in range(0, len(own), 256):
            near = np.round(own[at : at + 256] @ self.vectors.T, 9)
            row, voter, similarity = best(near, np.arange(n), k)
            weight = np.maximum(similarity, 0) ** 8
            total = np.bincount(row, weight, len(near))
            voted = np.bincount(row, weight * self.labels[voter], len(near))
            out[at : at + 256] = np.where(total > 1e-12, voted / np.maximum(total, 1e-12), base)
        return np.clip(out, 0, 1)

    def score(self, docs: list[dict[int, float]]) -> np.ndarray:
        return self.vote(self.embed(*sparse(docs), len(docs)))


def train(rows: np.ndarray, keys: np.ndarray, vals: np.ndarray, labels: np.ndarray, form_weight: float = FORM_WEIGHTS[-1], rank: int = 48, min_docs: int = 4, max_terms: int = 40_000, seed: int = 5) -> Voters:
    """Inverse document frequencies and a truncated decomposition, by a randomized range finder with power steps.

    Entries of weight -1 are form tokens, which get ``form_weight``.
    """
    n = len(labels)
    if not n:
        return Voters(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0), form_weight)
    rows, keys, vals = reweighted(rows, keys, vals, form_weight)
    kept, seen = np.unique(keys, return_counts=True)
    frequent = np.sort(kept[np.argsort(-seen, kind="stable")[:max_terms]])
    kept = np.intersect1d(kept[seen >= min(min_docs, n)], frequent)
    if not len(kept):
        return Voters(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((n, 1)), labels, form_weight)
    at = np.minimum(np.searchsorted(kept, keys), len(kept) - 1)
    known = kept[at] == keys
    all_entries = (rows, keys, vals)
    rows, cols, vals = rows[known], at[known], vals[known]
    idf = np.log((1 + n) / (1 + np.bincount(cols, minlength=len(kept)))) + 0.2
    scaled = vals * idf[cols]
    norm = np.sqrt(np.bincount(rows, scaled**2, n))
    scaled /= np.maximum(norm[rows], 1e-12)
    width = min(rank + 8, len(kept), n)
    x = np.random.default_rng(seed).normal(size=(len(kept), width))
    for _ in range(4):
        q, _ = np.linalg.qr(product(rows, cols, scaled, x, n))
        x = product(cols, rows, scaled, q, len(kept))
    right = np.linalg.svd(x, full_matrices=False)[0][:, :rank]
    voters = Voters(kept, right * idf[:, None], np.zeros((0, 1)), labels, form_weight)
    voters.vectors = embed_all(voters, *all_entries, n)
    return voters


def reweighted(rows: np.ndarray, keys: np.ndarray, vals: np.ndarray, form_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries with form tokens (-1) at their weight; without them, where it is 0."""
    if form_weight:
        return rows, keys, np.where(vals < 0, form_weight, vals)
    words = vals >= 0
    return rows[words], keys[words], vals[words]


def embed_all(voters: Voters, rows: np.ndarray, keys: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors of n rows, 256 at a time."""
    edges = np.searchsorted(rows, np.arange(0, n + 256, 256))
    return np.concatenate([voters.embed(rows[s:e] - 256 * i, keys[s:e], vals[s:e], min(256, n - 256 * i)) for i, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if 256 * i < n])


def part(own: np.ndarray, rows: np.ndarray, keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the rows in the mask ``own``, rows counted anew."""
    entries = own[rows]
    return (np.cumsum(own) - 1)[rows[entries]], keys[entries], vals[entries]


def learned_form_weight(rows: np.ndarray, keys: np.ndarray, vals: np.ndarray, labels: np.ndarray, seed: int = 9) -> float:
    """The weight whose voters, trained on half of the labelled rows, have the least squared error on the others; of equal ones the least."""
    own = np.random.default_rng(seed).random(len(labels)) < 0.5
    if len(labels) < 40 or labels[own].min() == labels[own].max():
        return FORM_WEIGHTS[-1]
    asked = labels[~own]

    def miss(weight: float) -> float:
        voters = train(*part(own, rows, keys, vals), labels[own], weight)
        votes = voters.vote(embed_all(voters, *reweighted(*part(~own, rows, keys, vals), weight), len(asked)))
        return float(((votes - asked) ** 2).mean())

    return min(FORM_WEIGHTS, key=lambda w: (round(miss(w), 6), w))


def chunk_hash(chunk: str) -> int | None:
    word = bare(chunk)
    return term_hash(word) if word else None


def hasher():
    """chunk -> the hash of its word; a Python worker keeps the chunks it has met, within the memo's bytes."""
    return kept("word hashes of chunks", lambda: Memo(chunk_hash).__getitem__)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 6000, sample_bytes: int = 24 << 20, form_weight: float | None = None, key: str = "doc_id", text: str = "text") -> Voters:
    """Learns from ``sample_rows`` of the labelled rows given, and ``sample_bytes`` of their texts, at most; the form weight too, if none is given."""

    def make():
        get = hasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [weighted_terms(x, get, -1.0) for x in texts(batch)]
            keys = pa.array([np.fromiter(d, np.uint32, len(d)).tobytes() for d in made], pa.binary())
            vals = pa.array([np.fromiter(d.values(), np.float32, len(d)).tobytes() for d in made], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), keys, vals], ["doc_id", "y", "ks", "ws"])

        return step

    rows = labelled_sample(docs, labels, label, sample_rows, sample_bytes, key, text).select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
    got = map_arrow(rows, make, "doc_id long, y int, ks binary, ws binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["ks"])))
    entries = np.repeat(np.arange(len(got)), [len(r["ks"]) // 4 for r in got])
    keys = np.frombuffer(b"".join(bytes(r["ks"]) for r in got), np.uint32).astype(np.int64)
    vals = np.frombuffer(b"".join(bytes(r["ws"]) for r in got), np.float32).astype(float)
    truth = np.array([r["y"] for r in got], float)
    return train(entries, keys, vals, truth, learned_form_weight(entries, keys, vals, truth) if form_weight is None else form_weight)


def score(docs: DataFrame, voters: Voters, held_out: Column, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(voters)

    def make():
        model = shipped.value
        get = hasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, scores = texts(batch), []
            for at in range(0, len(values), 256):
                scores.append(model.score([weighted_terms(x, get, model.form_weight) for x in values[at : at + 256]]))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(scores))], ["doc_id", "held_out", "score"])

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    scored = map_arrow(rows, make, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
