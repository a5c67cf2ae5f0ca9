"""Token counts of whole texts, huge ones by overlapping chunks that are spliced.

A text over ``CHUNK`` characters is encoded in chunks that overlap. Two neighbours are spliced in their overlap at a
proven boundary (see ``pieces``): tokens on its left come from the first chunk, tokens on its right from the second,
and both encodings must indeed have a token boundary there. Where the overlap holds no such position, it is widened,
twice as far each time, up to the end of the text at worst. The result is the encoding of the whole text, token for
token, while no more than a chunk and its overlap is encoded at once (a run of characters without any proven boundary
is the exception: it can't be cut without a proof).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.pieces import Vocabulary, vocabulary
from metaloom.llm.text import tidy

CHUNK = 1 << 14
OVERLAP = 256
LIMIT = 4096
#: texts given to the encoder at once, in characters
GROUP = 1 << 20


def encode_spliced(vocab: Vocabulary, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Token ids of ``text``, equal to those of one call of the library."""
    if len(text) <= chunk + overlap:
        return np.array(vocab.model.encode(text), np.int32)
    codes = vocab.normalised(text)
    n, parts, spliced = len(codes), [], 0
    begin, end = 0, min(len(codes), chunk + overlap)
    ids, ends = _encode(vocab, text, begin, end)
    while end < n:
        wide = overlap
        while not len(found := vocab.cuts(codes[(low := max(spliced + 1, end - wide)) - 1 : end])) and end < n:
            if low > spliced + 1:
                wide *= 2  # further to the left in this chunk
            else:  # it holds none at all: the chunk itself grows, twice as far each time
                end = min(n, end + (end - begin))
                ids, ends = _encode(vocab, text, begin, end)
        if not len(found):
            break
        at = int(found[len(found) // 2]) + low - 1
        parts.append(ids[_after(ends, spliced) : _after(ends, at)])
        spliced, begin, end = at, at - 1, min(n, at + chunk + overlap)
        ids, ends = _encode(vocab, text, begin, end)
    parts.append(ids[_after(ends, spliced) :])
    return np.concatenate(parts)


def _after(ends: np.ndarray, at: int) -> int:
    """Number of tokens that end at or before ``at``; one must end there, or the chunks don't align."""
    k = int(np.searchsorted(ends, at, "right"))
    if at and (k == 0 or ends[k - 1] != at):
        raise ValueError(f"no token ends at the proven boundary {at}")
    return k


def _encode(vocab: Vocabulary, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of positions ``begin`` to ``end`` of the normalised text, and the position at which each token ends.

    In front of a part that isn't the first, the encoder adds a space of its own; splices lie behind what it touches.
    """
    ids = np.array(vocab.model.encode(text[max(begin - 1, 0) : end - 1]), np.int32)
    ends = np.cumsum(vocab.width[ids]).astype(np.float64) + (begin - 1 if begin else 0)
    inner = np.flatnonzero(vocab.width[ids] == 0)
    ends[inner - 1] -= 0.5  # a character given as bytes ends with its last byte
    return ids, ends


def counts(texts: list[str], vocab: Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    out, few, size = [0] * len(texts), [], 0

    def flush() -> None:
        for i, ids in zip(few, vocab.model.encode([texts[i] for i in few], num_threads=1)):
            out[i] = len(ids)

    for i, text in enumerate(texts):
        if len(text) > chunk + overlap:
            out[i] = len(encode_spliced(vocab, text, chunk, overlap))
        elif text:
            few.append(i)
            size += len(text)
            if size > GROUP:
                flush()
                few, size = [], 0
    flush()
    return out


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; a null or empty text has none of either.

    The model's file is read by each worker from ``model``, by default from the installed package.
    """
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model or public_tokenizers.path("piece_bpe_32k.model"))
        for frame in frames:
            n = counts([x or "" for x in frame.column(1).to_pylist()], vocab, chunk, overlap)
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(tidy(batches), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
