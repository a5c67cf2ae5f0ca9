"""Benchmark decontamination: training passages as queries to a BM25 index of test items, with block-max WAND.

*Index.* Items are cut into segments of at most ``SEGMENT`` words. A posting (term, segment) has the BM25 impact of the
term divided by the segment's score against itself, so scores lie between 0 and 1 and one threshold serves all. Postings
lie in blocks of ``BLOCK`` neighbouring segments, and each (term, block) knows its largest impact. Per segment the terms
are split: the weaker ones that together stay below the threshold can't reach it alone (the pivot rule of WAND).

*Search.* Each document is cut into passages of ``PASSAGE`` words that overlap by half, so that a whole segment lies in
one of them. Every passage is a query. Segments that share none but weak terms with it are skipped; blocks whose largest
impacts don't add up to the threshold are skipped; all others are scored exactly. All segments at or above the
threshold are retrieved, there is no limit on their number.

*Check.* A retrieved item is a leak if enough three-word runs of its question (the first two thirds of its words) and of
its answer (the rest) occur around the passage: in the passage and, on both sides, half a passage for each segment of
the item, which is the item's own length at least. What the passages that retrieve segments of one item have around
them counts together; an item of one segment must be found around one passage.

An item of fewer than ``LEAST_WORDS`` words is a leak where all its words follow each other in a passage.

*Words* are runs of letters and digits; in scripts that put no spaces between words, every character is one.

Documents stay where they are: no shuffle. The index of one part of the items (``POSTINGS`` postings at most on average)
is sent to the tasks; more items make more parts, each searched in its own pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from metaloom.llm.text import buffers, lowered, portions, runs, shingles, slices, tidy

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SEGMENT, PASSAGE = 64, 128
BLOCK = 16
#: share of three-word runs of the question and of the answer that must occur
OVERLAP = 0.5
RUN = 3
#: an item with fewer words is looked for as a whole
LEAST_WORDS = 5
POSTINGS = 2_000_000

_inside = np.zeros(256, bool)
_inside[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
_inside[0x80:] = True
_marks = r"[\p{P}\p{S}\p{Z}\x{200B}]"
_unspaced = r"([\p{Han}\p{Hiragana}\p{Katakana}\x{30FC}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"


def _spaced(column: pa.Array) -> pa.Array:
    """Texts in lower case, with spaces for all marks and around each character of scripts that have none between words."""
    text = lowered(column)
    plain = pc.string_is_ascii(text)
    if pc.all(plain, min_count=0).as_py():
        return text
    other = pc.replace_substring_regex(pc.replace_substring_regex(text.filter(pc.invert(plain)), _marks, " "), _unspaced, r" \1 ")
    return pc.replace_with_mask(text, pc.invert(plain), other)


def _segments(items: DataFrame) -> DataFrame:
    """key, item_id, seg, words, terms, tf of every segment, the runs of question and answer, and all words in order of an item that has few.

    A key stands for an id with one of its texts: repeated rows have one, an id with two texts has two.
    """
    kind = dict(items.select("item_id").dtypes)["item_id"]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            data, offsets = buffers(_spaced(frame.column(1)))
            rows, _, hashed = runs(data, offsets, _inside)
            at = np.searchsorted(rows, np.arange(frame.num_rows + 1))
            out: dict[str, list] = {k: [] for k in ("key", "item_id", "seg", "words", "terms", "tf", "question", "answer", "exact")}
            for k, (item, key) in enumerate(zip(frame.column(0).to_pylist(), frame.column(2).to_pylist(), strict=True)):
                own = hashed[at[k] : at[k + 1]]
                if len(own) == 0 or item is None:
                    continue
                parts = -(-len(own) // SEGMENT)
                cut = -(-2 * len(own) // 3)
                one, none = np.zeros(len(own), np.int64), np.zeros(0, np.int64)
                ask, reply = (np.unique(shingles(one[: len(w)], w, RUN)[1]).view(np.int64) for w in (own[:cut], own[cut:]))
                exact = (own if len(own) < LEAST_WORDS else own[:0]).view(np.int64)
                for seg, part in enumerate(np.array_split(own, parts)):
                    terms, tf = np.unique(part, return_counts=True)
                    if seg:  # its first segment has them for the whole item
                        ask = reply = exact = none
                    for name, value in zip(out, (key, item, seg, len(part), terms.view(np.int64), tf.astype(np.int64), ask, reply, exact)):
                        out[name].append(value)
            types = {"key": pa.int64(), "item_id": frame.schema.field(0).type, "seg": pa.int32(), "words": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.list_(pa.int64()))) for n, v in out.items()], list(out))

    distinct = items.select("item_id", "text").distinct().withColumn("key", F.xxhash64("item_id", "text"))
    return distinct.mapInArrow(tidy(batches), f"key long, item_id {kind}, seg int, words long, terms array<long>, tf array<long>, question array<long>, answer array<long>, exact array<long>")


@dataclass(frozen=True)
class Index:
    item: list  # the id of each segment's item
    key: list  # and its key, see _segments
    terms: np.ndarray  # sorted hashes
    keys: np.ndarray  # term * segments + segment, sorted
    impacts: np.ndarray
    block_keys: np.ndarray  # term * blocks + block, sorted
    block_max: np.ndarray
    strong_first: np.ndarray  # per term: its run in strong_segment
    strong_segment: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    parts: np.ndarray  # of each segment: how many its item has
    exact: list[np.ndarray]  # of each segment: the words of its item, if they are few

    @property
    def blocks(self) -> int:
        return -(-len(self.item) // BLOCK)


def build(rows: list, threshold: float = THRESHOLD) -> Index:
    """From rows (key, item_id, seg, words, terms, impacts, question, answer, exact); impacts aren't normalised yet."""
    n = len(rows)
    term = np.concatenate([np.array(r["terms"], np.int64) for r in rows]).view(np.uint64) if n else np.zeros(0, np.uint64)
    segment = np.repeat(np.arange(n), [len(r["terms"]) for r in rows]) if n else np.zeros(0, np.int64)
    impact = np.concatenate([np.array(r["impacts"], float) / sum(r["impacts"]) for r in rows]) if n else np.zeros(0)
    terms, number = np.unique(term, return_inverse=True)
    blocks = -(-n // BLOCK)
    order = np.argsort(number * n + segment)
    keys, impacts = (number * n + segment)[order], impact[order]
    b_key = number * blocks + segment // BLOCK
    block_keys, place = np.unique(b_key, return_inverse=True)
    block_max = np.zeros(len(block_keys))
    np.maximum.at(block_max, place, impact)
    # per segment, from the weakest term upwards: strong once the sum could reach the threshold
    by = np.lexsort((impact, segment))
    cum = np.cumsum(impact[by])
    first = np.searchsorted(segment[by], segment[by])
    cum = cum - (cum[first] - impact[by][first])
    strong = by[cum >= threshold - 1e-9]
    strong = strong[np.argsort(number[strong], kind="stable")]
    parts: dict = {}
    whole = {r["key"]: [np.array(r[x], np.int64).view(np.uint64) for x in ("question", "answer", "exact")] for r in rows if r["seg"] == 0}
    for r in rows:
        parts[r["key"]] = max(parts.get(r["key"], 0), r["seg"] + 1)
    return Index(
        [r["item_id"] for r in rows], [r["key"] for r in rows], terms, keys, impacts, block_keys, block_max, np.searchsorted(number[strong], np.arange(len(terms) + 1)), segment[strong],
        [whole[r["key"]][0] for r in rows], [whole[r["key"]][1] for r in rows], np.array([parts[r["key"]] for r in rows], np.int64), [whole[r["key"]][2] for r in rows],
    )


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those of first[1], and so on."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[k] == wanted, values[k], 0.0)


def _summed(passages: np.ndarray, others: np.ndarray, first: np.ndarray, count: np.ndarray, number: np.ndarray, width: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every pair (passage, other) the sum of the values of (term, other) over the passage's terms; in runs of bounded size."""
    out = np.zeros(len(passages))
    step = 20_000
    for i in range(0, len(passages), step):
        p, o = passages[i : i + step], others[i : i + step]
        n = count[p]
        at = _ranges(first[p], n)
        got = _looked_up(keys, values, number[at] * width + np.repeat(o, n))
        out[i : i + step] = np.add.reduceat(got, np.concatenate([[0], np.cumsum(n)[:-1]])) if len(p) else 0
    return out


def search(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int, float, float, float]]:
    """(row, segment, passage, score, question overlap, answer overlap) of the best passage of each leak."""
    rows, _, hashed = runs(data, offsets, _inside)
    if len(hashed) == 0 or len(index.terms) == 0:
        return []
    first_word = np.searchsorted(rows, np.arange(len(offsets)))
    position = np.arange(len(rows)) - first_word[rows]
    maybe = np.zeros(1 << 20, bool)
    maybe[(index.terms >> np.uint64(44)).astype(np.int64)] = True
    some = np.flatnonzero(maybe[(hashed >> np.uint64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(index.terms, hashed[some]), len(index.terms) - 1)
    hit = index.terms[k] == hashed[some]
    some, number = some[hit], k[hit]
    # a word lies in the passage of its half and in the one before
    half = PASSAGE // 2
    halves = np.concatenate([[0], np.cumsum(np.diff(first_word) // half + 1)])
    at = halves[rows[some]] + position[some] // half
    before = position[some] >= half
    passage = np.concatenate([at, at[before] - 1])
    number = np.concatenate([number, number[before]])
    pairs = np.unique(passage * len(index.terms) + number)
    passage, number = pairs // len(index.terms), pairs % len(index.terms)
    whose, first, count = np.unique(passage, return_index=True, return_counts=True)
    # passages and the segments they share a strong term with
    local = np.repeat(np.arange(len(whose)), count)
    n_strong = index.strong_first[number + 1] - index.strong_first[number]
    segments = len(index.item)
    both = np.unique(np.repeat(local, n_strong) * segments + index.strong_segment[_ranges(index.strong_first[number], n_strong)])
    p, s = both // segments, both % segments
    # block bounds
    pb, place = np.unique(p * index.blocks + s // BLOCK, return_inverse=True)
    bound = _summed(pb // index.blocks, pb % index.blocks, first, count, number, index.blocks, index.block_keys, index.block_max)
    open_ = bound[place] >= threshold - 1e-9
    p, s = p[open_], s[open_]
    score = _summed(p, s, first, count, number, segments, index.keys, index.impacts)
    good = score >= threshold - 1e-9
    # retrieved passages that are judged together: those of one segment's item each for itself, those of a longer item all at once
    together: dict[tuple, list[tuple[float, int, int]]] = {}
    for pi, si, sc in zip(whose[p[good]].tolist(), s[good].tolist(), score[good].tolist()):
        row = int(np.searchsorted(halves, pi, "right") - 1)
        part = int(pi - halves[row])
        together.setdefault((row, index.key[si], part if index.parts[si] == 1 else None), []).append((sc, part, si))
    best: dict[tuple, tuple[int, int, int, float, float, float]] = {}
    for (row, _, _), got in together.items():
        sc, part, si = max(got, key=lambda x: x[0])
        item = index.item[si]
        margin = half * int(index.parts[si])
        near, stretch = [], []
        for low, high in _joined(sorted((k * half - margin, k * half + PASSAGE + margin) for k in {x[1] for x in got})):
            words = hashed[first_word[row] + max(0, low) : min(first_word[row + 1], first_word[row] + high)]
            stretch.append(np.full(len(words), len(near)))
            near.append(words)
        found = shingles(np.concatenate(stretch), np.concatenate(near), RUN)[1]
        if index.parts[si] == 1 and len(near[0]) >= 2:  # answers of one or two words are looked for as such
            found = np.concatenate([found, *(_short(near[0], c) for c in (1, 2))])
        q, a = (float(np.isin(x[si], found).mean()) if len(x[si]) else 1.0 for x in (index.question, index.answer))
        if len(index.exact[si]):
            q = a = float(_holds(hashed[first_word[row] + part * half : min(first_word[row + 1], first_word[row] + part * half + PASSAGE)], index.exact[si]))
        if q >= OVERLAP and a >= OVERLAP:
            new = (row, int(si), part, float(sc), q, a)
            if (row, item) not in best or best[row, item][3] < sc:
                best[row, item] = new
    return sorted(best.values())


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for low, high in spans:
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def _holds(words: np.ndarray, wanted: np.ndarray) -> bool:
    n = len(words) - len(wanted) + 1
    return n > 0 and bool(np.all([words[k : k + n] == w for k, w in enumerate(wanted)], 0).any())


def _short(near: np.ndarray, c: int) -> np.ndarray:
    """Hashes of all sequences of ``c`` words as ``shingles`` gives them to texts that are no longer."""
    n = len(near) - c + 1
    flat = near[np.arange(n)[:, None] + np.arange(c)].reshape(-1)
    return shingles(np.repeat(np.arange(n), c), flat, RUN)[1]


def indexes(items: DataFrame, threshold: float = THRESHOLD) -> Iterator[Index]:
    """One index, or several of ``POSTINGS`` postings at most on average; statistics cover all items."""
    rows = _segments(items)
    flat = rows.select("key", "seg", "words", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("key", "seg", "words", F.col("t.terms").alias("term"), F.col("t.tf").alias("tf"))
    n, mean, postings = rows.agg(F.count(F.lit(1)), F.avg("words"), F.sum(F.size("terms"))).first()
    if not n:
        return
    df = flat.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / mean))
    scored = flat.join(df, "term").groupBy("key", "seg").agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("impact")))).alias("p"))  # SEGMENT terms at most
    full = rows.select("key", "item_id", "seg", "words", "question", "answer", "exact").join(scored, ["key", "seg"])
    full = full.select("key", "item_id", "seg", "words", "question", "answer", "exact", F.col("p.term").alias("terms"), F.col("p.impact").alias("impacts"))
    parts = -(-postings // POSTINGS)
    for k in range(parts):  # all texts of one id lie in one part
        part = full.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else full
        found = sorted(part.collect(), key=lambda r: (r["key"], r["seg"]))
        yield build(found, threshold)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, passage, score, question_overlap, answer_overlap: a row for each document row and item that leaks into it.

    Rows without text or without leaks give none; so do items without words or id. Repeated rows are reported each; repeated
    items count once for each document, and an id with several texts leaks if one of them does.
    """
    spark = docs.sparkSession
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    kinds = dict(docs.select("doc_id").dtypes)["doc_id"], dict(items.select("item_id").dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, passage int, score double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(items, threshold):
        sent = spark.sparkContext.broadcast(index)

        def batches(frames: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for frame in frames:
                data, offsets = buffers(_spaced(frame.column(1)))
                for i, j in slices(offsets):
                    got = search(index, data, offsets[i : j + 1], threshold)
                    ids = frame.column(0).take(pa.array([i + g[0] for g in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([index.item[g[1]] for g in got], item_type), pa.array([g[2] for g in got], pa.int32()), *(pa.array([g[k] for g in got], pa.float64()) for k in (3, 4, 5))],
                        ["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"],
                    )

        part = docs.select("doc_id", "text").mapInArrow(tidy(batches), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(frames: Iterator[pa.RecordBatch], index: Index, threshold: float = THRESHOLD) -> Iterator[pa.RecordBatch]:
    """The rows, all columns, into which no item of the index leaks."""
    for frame in portions(frames):
        data, offsets = buffers(_spaced(frame.column("text")))
        keep = np.ones(frame.num_rows, bool)
        for i, j in slices(offsets):
            for got in search(index, data, offsets[i : j + 1], threshold):
                keep[i + got[0]] = False
        yield frame.filter(pa.array(keep))


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, into which no item leaks."""
    spark, out = docs.sparkSession, docs
    for index in indexes(items, threshold):
        sent = spark.sparkContext.broadcast(index)

        def batches(frames: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return without_leaks(frames, sent.value, threshold)

        out = out.mapInArrow(tidy(batches), docs.schema)
    return out
