"""Toxicity by weak supervision: many noisy voters, a generative label model, a linear classifier.

1. *Terms.* Words and word beginnings of labelled rows are counted by class; those that lean most towards toxic rows
   become the lexicon. No list of words is built in.
2. *Voters.* Every term of the lexicon votes toxic where it occurs. Pattern voters look at the share and the number of
   different terms and at shouting, and vote toxic, clean or not at all. The given label is a voter too.
3. *Label model.* Latent label y, P(vote | y) of each voter, by expectation maximisation. Voters that agree more than y
   explains (correlated given y) share their evidence: a voter's log-likelihood counts 1 / (1 + sum of its positive
   conditional correlations).
4. *Classifier.* Logistic regression on counts of terms and patterns, trained on the posterior labels; it alone scores.

At most ``FIT_ROWS`` labelled rows of each class (those with the smallest hash of their id) are fitted on, a documented
bound; they are staged once. Every row is scored, over its whole text. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom import staging
from metaloom.llm.text import byte_codes as codes
from metaloom.llm.text import buffers, lowered, mix, portions, powers, slices, tidy

#: labelled rows of each class to fit on
FIT_ROWS = 3000
#: terms in the lexicon
TERMS = 400
#: bytes of the word beginnings that are terms besides whole words
STEMS = (4, 5, 6, 7, 8)
FOLDS, HELD_OUT = 5, 0
PATTERNS = 6
#: P(label is toxic | text is toxic) and P(label is toxic | text is clean), fixed for the voter that the label is
LABEL_TRUE, LABEL_FALSE = 0.97, 0.003


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


_letter = np.zeros(256, bool)
_letter[ord("a") : ord("z") + 1] = True
_letter[0x80:] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, and of its beginnings of ``STEMS`` bytes, in texts that are lower case already."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    inside = _letter[part]
    kept = np.flatnonzero(inside)
    if len(kept) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    new = np.ones(len(kept), bool)
    new[1:] = np.diff(kept) > 1
    firsts = offsets[:-1] - base
    edge = np.zeros(len(part) + 1, bool)
    edge[firsts] = True
    new |= edge[kept]
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(kept)))
    within = np.arange(len(kept)) - np.repeat(first, lengths)
    value = codes[part[kept]] * powers(int(lengths.max()) + 1)[within]
    rows = np.searchsorted(offsets - base, kept[first], "right") - 1
    out_rows, out = [rows], [mix(np.add.reduceat(value, first))]
    for k in STEMS:
        long = lengths > k
        head = np.where(within < k, value, np.uint64(0))
        out_rows.append(rows[long])
        out.append(mix(np.add.reduceat(head, first)[long] + np.uint64(k)))
    return np.concatenate(out_rows), np.concatenate(out)


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # sorted hashes
    strong: np.ndarray  # index of the terms that vote
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float


def features(column: pa.Array, terms: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, counts, patterns) of rows i to j: counts of each term, and
    words, share of upper-case letters, of non-letters, a column of zeros, number of hits, of different terms."""
    raw, at = buffers(column)
    data, offsets = buffers(lowered(column))
    maybe = np.zeros(1 << 16, bool)
    maybe[(terms >> np.uint64(48)).astype(np.int64)] = True
    for i, j in slices(offsets):
        n = j - i
        rows, hashed = terms_of(data, offsets[i : j + 1])
        words = np.bincount(_words_only(data, offsets[i : j + 1]), minlength=n)[:n]
        counts = np.zeros((n, len(terms)), np.float32)
        if len(terms) and len(hashed):
            some = maybe[(hashed >> np.uint64(48)).astype(np.int64)]
            rows, hashed = rows[some], hashed[some]
            k = np.minimum(np.searchsorted(terms, hashed), len(terms) - 1)
            hit = terms[k] == hashed
            np.add.at(counts, (rows[hit], k[hit]), 1)
        size = np.maximum(np.diff(at[i : j + 1]), 1)
        part = raw[at[i] : at[j]]
        row = np.repeat(np.arange(n), np.diff(at[i : j + 1]))
        upper = np.bincount(row[(part >= 65) & (part <= 90)], minlength=n) / size
        marks = np.bincount(row[(part > 32) & (part < 65) & ~((part >= 48) & (part <= 57))], minlength=n) / size
        twice = np.zeros(n)
        patterns = np.stack([words, upper, marks, twice, counts.sum(1), (counts > 0).sum(1)], 1)
        yield i, j, counts, patterns


def _words_only(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    base = int(offsets[0])
    inside = _letter[data[base : int(offsets[-1])]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    return np.searchsorted(offsets - base, np.flatnonzero(begins), "right") - 1


def design(counts: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: occurrence of each term weighed down in long texts, and the patterns."""
    words, upper, marks, _, hits, different = patterns.T
    length = np.log1p(words)[:, None]
    share = np.log1p(1000 * hits / np.maximum(words, 1))
    return np.concatenate(
        [np.log1p(counts) / (1 + length / 4), share[:, None], np.minimum(different, 12)[:, None], np.log1p(hits)[:, None], (different == 0)[:, None], length, upper[:, None], marks[:, None]], 1
    ).astype(np.float64)


def votes(counts: np.ndarray, patterns: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 none; one column for each strong term, then the patterns."""
    words, upper, marks, _, hits, different = patterns.T
    rate = hits / np.maximum(words, 1)
    own = (counts[:, strong] > 0).astype(np.int8)
    rules = [
        np.where(different >= 3, 1, np.where(different == 0, -1, 0)), np.where(rate >= 0.01, 1, np.where(rate == 0, -1, 0)),
        np.where((hits >= 2) & (words < 60), 1, 0), np.where((different <= 1) & (words > 200), -1, 0), np.where((upper > 0.5) & (different >= 1), 1, 0), np.where((marks > 0.1) & (different == 0), -1, 0),
    ]
    return np.concatenate([own, np.stack(rules, 1).astype(np.int8)], 1)


def label_model(ballots: np.ndarray, given: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """P(y = 1) of each row. ``given``: the label, a voter like others; ``weight``: how many rows a row stands for."""
    all_votes = ballots
    # the label is the voter whose accuracy is known beforehand
    label = np.where(given == 1, np.log(LABEL_TRUE / LABEL_FALSE), np.log((1 - LABEL_TRUE) / (1 - LABEL_FALSE)))
    kinds = np.stack([all_votes == v for v in (-1, 0, 1)], 2).astype(np.float64)  # row, voter, vote
    y = np.where(given == 1, 0.9, 0.05)
    for _ in range(rounds):
        both = np.stack([1 - y, y], 1) * weight[:, None]
        prior = both.sum(0) / both.sum()
        p = np.einsum("rc,rvk->cvk", both, kinds) + 0.5
        p /= p.sum(2, keepdims=True)
        log_p = np.log(p)
        log_p[:, :, 1] = 0  # a voter that doesn't vote says nothing
        evidence = np.einsum("rvk,cvk->rvc", kinds, log_p)
        ratio = evidence[:, :, 1] - evidence[:, :, 0]
        # what voters have in common beyond y
        z = all_votes - np.einsum("rc,cv->rv", np.stack([1 - y, y], 1), p[:, :, 2] - p[:, :, 0])
        z = z * np.sqrt(weight)[:, None]
        z = z / np.maximum(np.sqrt((z**2).sum(0)), 1e-9)
        shared = np.clip(z.T @ z, 0, 1)
        np.fill_diagonal(shared, 0)
        shared[shared < 0.05] = 0
        logit = np.log(prior[1] / prior[0]) + label + ratio @ (1 / (1 + shared.sum(1)))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - y).max() < 1e-6:
            return new
        y = new
    return y


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 2.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, terms: int = TERMS) -> Model:
    """``labels``: doc_id, toxic; rows of the held-out fold are never looked at.

    Without labels of both classes the model has no terms and scores every text with the share of toxic labels.
    Repeated labels of one document count once (the larger).
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(size.values())

    def constant() -> Model:
        base = (size.get(1, 0) + 0.5) / (total + 1)
        width = design(np.zeros((1, 0)), np.zeros((1, PATTERNS))).shape[1]
        return Model(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(width), np.zeros(width), np.ones(width), float(np.log(base / (1 - base))))

    if len(size) < 2:
        return constant()
    order = F.xxhash64(F.lit("fit"), F.col("doc_id"))
    some = known.where("toxic = 1").orderBy(order, "doc_id").limit(rows).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(rows))
    # at most 2 * rows ids, whatever the size of the tables
    sample = staging.stage(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), staging.new_stage(spark, "toxic-fit"))
    sample = sample.repartition(16, F.xxhash64("doc_id"))

    def term_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            toxic = frame.column(1).to_numpy(zero_copy_only=False)
            data, offsets = buffers(lowered(frame.column(0)))
            for i, j in slices(offsets):
                r, h = terms_of(data, offsets[i : j + 1])
                pairs = np.unique(np.stack([r.astype(np.uint64), h], 1), axis=0) if len(r) else np.zeros((0, 2), np.uint64)
                hashed, place = np.unique(pairs[:, 1], return_inverse=True)
                y = toxic[i:j][pairs[:, 0].astype(np.int64)]
                bad = np.bincount(place, y, len(hashed)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(bad), pa.array(np.bincount(place, 1 - y, len(hashed)).astype(np.int64))], ["term", "bad", "good"])

    counted = sample.select("text", "toxic").mapInArrow(tidy(term_rows), "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n_bad, n_good = min(rows, size[1]), min(rows, size[0])
    a, b, c, d = F.col("bad") + 0.5, F.col("good") + 0.5, F.lit(n_bad + 1) - F.col("bad") - 0.5, F.lit(n_good + 1) - F.col("good") - 0.5
    odds = F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)  # log odds ratio over its standard error
    best = counted.where(F.col("bad") >= 3).withColumn("z", odds).where("z > 2.5").orderBy(F.desc("z"), "term").limit(terms).collect()
    ranked = np.array([r["term"] for r in best], np.int64).view(np.uint64)
    sort = np.argsort(ranked)
    lexicon = ranked[sort]
    z = np.array([r["z"] for r in best])[sort] if len(best) else np.zeros(0)
    strong = np.sort(np.argsort(-z, kind="stable")[:64])

    def feature_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i, j, n, p in features(frame.column(0), lexicon):
                flat = np.concatenate([n, p], 1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([frame.column(1).slice(i, j - i), frame.column(2).slice(i, j - i), pa.array([x.tobytes() for x in flat], pa.binary())], ["toxic", "doc_id", "x"])

    got = sample.select("text", "toxic", "doc_id").mapInArrow(tidy(feature_rows), f"toxic int, doc_id {dict(sample.dtypes)['doc_id']}, x binary").toPandas().sort_values("doc_id")
    if len(got) == 0:  # labels of documents that aren't there
        return constant()
    flat = np.stack([np.frombuffer(x, np.float32) for x in got["x"]])
    n, p, given = flat[:, : len(lexicon)], flat[:, len(lexicon) :], got["toxic"].to_numpy()
    weight = np.where(given == 1, size[1] / n_bad, size[0] / n_good)
    posterior = label_model(votes(n, p, strong), given, weight)
    x = design(n, p)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    w, bias = _regression((x - mean) / scale, posterior, weight / weight.mean())
    return Model(lexicon, strong, w, mean, scale, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; a null text counts as empty."""
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i, j, n, p in features(frame.column(1), model.terms):
                logit = (design(n, p) - model.mean) / model.scale @ model.weights + model.bias
                s = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(i, j - i), pa.array(s)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(batches), f"doc_id {kind}, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; a null id belongs to no fold and isn't held out."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under 0.5."""
    model = fit(docs, labels)
    names = docs.columns

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in portions(frames):
            keep = np.ones(frame.num_rows, bool)
            for i, j, n, p in features(frame.column("text"), model.terms):
                keep[i:j] = (design(n, p) - model.mean) / model.scale @ model.weights + model.bias < 0
            yield frame.filter(pa.array(keep))

    return docs.mapInArrow(tidy(batches), docs.schema).select(*names)
