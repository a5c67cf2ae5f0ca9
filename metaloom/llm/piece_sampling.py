"""SentencePiece encoding by sampling: forward filtering, backward sampling over the piece lattice.

The lattice of a text has its character positions as nodes and every vocabulary piece that matches as an edge (a
character in no piece has one edge, its UTF-8 bytes). A segmentation S has the weight prod p(piece)^alpha. Forward
filtering gives every node the total weight of the paths that lead to it; backward sampling walks from the end and
draws each incoming edge in proportion to (weight of its start) * (its own weight), which yields whole segmentations
in exactly that distribution.

Proven boundaries (see ``pieces``) are on every path, so the lattice falls apart there into segments whose samples are
independent, and equal segments share one lattice. The filter runs once per distinct segment of a slice, the sampler
for every occurrence. The uniform number for a node is a hash of (seed, row key, position in the row): the result
depends neither on partitions nor on batches, and a lost task repeats it.

The model's scores are ranks of BPE merges, no probabilities: piece probabilities follow Zipf's law over these ranks,
p(rank) ~ 1 / (rank + ZIPF_SHIFT), and a byte piece has that of the last rank.

Decoding joins the pieces; the bytes of the text come back exactly, those of a literal U+2581 too.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.pieces import SPACE, Vocabulary, points, vocabulary
from metaloom.llm.text import list_array, mix, portions, tidy

ALPHA = 1.0
ZIPF_SHIFT = 2.7
#: characters handled at once; longer rows are split at proven boundaries
SLICE = 1 << 18
#: longer segments are filtered one by one, in logarithms
LONG = 96

_ratio = np.uint64(0x9E3779B97F4A7C15)
#: stands for a literal U+2581 of a text, so that it isn't taken for a space: no UTF-8 text holds a surrogate
MARK = "\ud800"


class Lattice:
    """Pieces by hash of their characters, and their weights."""

    def __init__(self, vocab: Vocabulary, alpha: float):
        self.vocab = vocab
        ranks = np.maximum(-vocab.scores, 0.0)
        last = max(r for r, (_, i) in ((ranks[i], w) for w in vocab.words for i in [w[1]]))
        log_p = -np.log(np.minimum(ranks, last) + ZIPF_SHIFT)
        log_p -= np.log(np.exp(log_p[[i for _, i in vocab.words]]).sum())
        self.log_w = alpha * log_p
        self.log_byte = alpha * float(log_p[[i for _, i in vocab.words]].min())
        # the same constant per character on every path keeps weights near 1
        self.per_char = -float(np.mean(self.log_w[[i for _, i in vocab.words]])) / 4
        rng = np.random.default_rng(7)
        self.code = rng.integers(0, 1 << 62, vocab.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sizes = np.array([len(text) for text, _ in vocab.words])
        table = np.zeros((len(sizes), vocab.longest), np.uint16)
        table[np.arange(vocab.longest) < sizes[:, None]] = vocab.classes[points("".join(text for text, _ in vocab.words))]
        hashed, h = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        self.longer = np.zeros(1 << 22, bool)  # what may be the beginning of a longer piece
        for k in range(vocab.longest):
            h = h * _ratio + self.code[table[:, k]]
            full = mix(h)
            hashed[sizes == k + 1] = full[sizes == k + 1]
            self.longer[(full[sizes > k + 1] >> np.uint64(42)).astype(np.int64)] = True
        order = np.argsort(hashed)
        self.hashes, self.ids, self.text = hashed[order], np.array([i for _, i in vocab.words], np.int64)[order], table[order]
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.segments = Segments(self)
        self.single = np.full(vocab.size, -1, np.int64)
        for text, i in vocab.words:
            if len(text) == 1:
                self.single[vocab.classes[ord(text)]] = i

    def edges(self, classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every piece in a flat run of segments; ``ends``: for each position the end of its segment."""
        at, h = np.arange(len(classes)), np.zeros(len(classes), np.uint64)
        found = []
        for length in range(1, self.vocab.longest + 1):
            keep = at + length <= ends[at]
            if length > 1:  # no piece goes on across a pair that is in no piece
                last = at[keep] + length - 1
                keep[keep] = self.vocab.beside[classes[last - 1], classes[last]]
            at, h = at[keep], h[keep]
            if len(at) == 0:
                break
            h = h * _ratio + self.code[classes[at + length - 1]]
            full = mix(h)
            some = np.flatnonzero(self.maybe[(full >> np.uint64(44)).astype(np.int64)])
            k = np.searchsorted(self.hashes, full[some])
            k[k == len(self.hashes)] = 0
            hit = self.hashes[k] == full[some]
            some, k = some[hit], k[hit]
            same = np.ones(len(k), bool)
            for j in range(length):
                same &= self.text[k, j] == classes[at[some] + j]
            found.append((at[some][same], np.full(int(same.sum()), length), self.ids[k[same]]))
            goes = self.longer[(full >> np.uint64(42)).astype(np.int64)]
            at, h = at[goes], h[goes]
        starts, lengths, ids = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        # a character without a piece of its own is given as bytes
        bare = np.flatnonzero(self.single[classes] < 0)
        return np.concatenate([starts, bare]), np.concatenate([lengths, np.ones(len(bare), np.int64)]), np.concatenate([ids, np.full(len(bare), -1)])


@functools.lru_cache(maxsize=2)
def lattice(path: str, alpha: float) -> Lattice:
    return Lattice(vocabulary(path), alpha)


def _n_bytes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


class Segments:
    """Filtered lattices of the distinct segments met so far, all in flat arrays of at most ``MOST_BYTES`` and a slice.

    When they grow larger, those used most often stay, up to half of the bytes. The incoming edges of a node lie together, the
    heaviest first; ``below`` is the cumulative share within the node.
    """

    MOST_BYTES = 32 << 20

    def __init__(self, lat: Lattice):
        self.lat = lat
        self.clear()

    def clear(self) -> None:
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.codes, self.base = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.first, self.below = np.zeros(0, np.int32), np.zeros(0)
        self.length, self.id = np.zeros(0, np.int16), np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int64)

    def _arrays(self) -> tuple[np.ndarray, ...]:
        return self.hashes, self.number, self.codes, self.base, self.first, self.below, self.length, self.id, self.used

    def shrink(self, most: int) -> None:
        """Keep the lattices used most often, in ``most`` bytes at most, and begin to count their use anew."""
        n = len(self.base)
        sizes = np.diff(np.append(self.base, len(self.codes)))
        roots = self.base + np.arange(n)
        # nodes of a segment lie together, and so do its edges: from the first edge of its first node on
        heads = self.first[roots + 1]
        edges = np.diff(np.append(heads, len(self.id)))
        cost = 48 + 12 * sizes + 14 * edges
        keep = np.zeros(n, bool)
        order = np.argsort(-self.used, kind="stable")
        keep[order[np.cumsum(cost[order]) <= most]] = True
        kept = np.flatnonzero(keep)
        by_number = np.empty(n, np.uint64)
        by_number[self.number] = self.hashes
        hashes = by_number[kept]
        nodes, own, lines = (np.repeat(keep, x) for x in (sizes + 1, sizes, edges))
        moved = np.cumsum(edges * keep) - edges * keep - heads  # what a kept segment's edges move by
        first = self.first[nodes]
        first = np.where(first >= 0, first + np.repeat(moved[kept], sizes[kept] + 1), -1).astype(np.int32)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        self.codes, self.base = self.codes[own], np.cumsum(sizes[kept]) - sizes[kept]
        self.first, self.below, self.length, self.id = first, self.below[lines], self.length[lines], self.id[lines]
        self.used = np.zeros(len(kept), np.int64)

    def numbers(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each segment's lattice; those not met before are filtered first."""
        if sum(x.nbytes for x in self._arrays()) > self.MOST_BYTES:
            self.shrink(self.MOST_BYTES // 2)
        classes = self.lat.vocab.classes[codes]
        keys = np.where(classes > 0, self.lat.code[classes], codes.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        within = np.arange(len(codes)) - np.repeat(starts, sizes)
        table = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), _ratio, np.uint64)]))
        hashed = mix(np.add.reduceat(keys * table[within], starts) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = np.searchsorted(self.hashes, hashed)
        known = np.zeros(len(hashed), bool)
        some = at < len(self.hashes)
        known[some] = self.hashes[at[some]] == hashed[some]
        if not known.all():
            new = np.flatnonzero(~known)
            fresh, where = np.unique(hashed[new], return_index=True)
            self._add(fresh, codes, starts[new[where]], sizes[new[where]])
            at = np.searchsorted(self.hashes, hashed)
        numbers = self.number[at]
        if not np.array_equal(self.codes[np.repeat(self.base[numbers], sizes) + within], codes):
            raise ValueError("two segments share a hash")
        self.used += np.bincount(numbers, minlength=len(self.used))
        return numbers

    def _add(self, hashed: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        place = np.arange(int(sizes.sum())) - np.repeat(base, sizes)
        own = codes[np.repeat(starts, sizes) + place]
        first, below, length, ids = self._filtered(own, base, sizes)
        n_codes, n_edges, n = len(self.codes), len(self.id), len(self.base)
        every = np.concatenate([self.hashes, hashed])
        order = np.argsort(every)
        self.hashes, self.number = every[order], np.concatenate([self.number, n + np.arange(len(hashed))])[order]
        self.codes, self.base = np.concatenate([self.codes, own]), np.concatenate([self.base, base + n_codes])
        self.first = np.concatenate([self.first, np.where(first >= 0, first + n_edges, -1).astype(np.int32)])
        self.below, self.length = np.concatenate([self.below, below]), np.concatenate([self.length, length.astype(np.int16)])
        self.id = np.concatenate([self.id, ids.astype(np.int32)])
        self.used = np.concatenate([self.used, np.zeros(len(hashed), np.int64)])

    def _filtered(self, codes: np.ndarray, base: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward filter; node of position p of segment s: base[s] + s + p."""
        lat = self.lat
        start, length, ids = lat.edges(lat.vocab.classes[codes], np.repeat(base + sizes, sizes))
        logs = np.where(ids >= 0, lat.log_w[ids], lat.log_byte * _n_bytes(codes[start])) + lat.per_char * length
        segment = np.repeat(np.arange(len(base)), sizes)[start]
        tail = start + segment
        head = tail + length
        nodes, roots = len(codes) + len(base), base + np.arange(len(base))
        alpha, weight, far, is_long = np.zeros(nodes), np.exp(logs), head - roots[segment], sizes[segment] > LONG
        alpha[roots] = 1.0
        steps = np.argsort(far * nodes + head, kind="stable")
        steps = steps[~is_long[steps]]
        bounds = np.searchsorted(far[steps], np.arange(1, LONG + 2))
        for step in range(LONG):
            e = steps[bounds[step] : bounds[step + 1]]
            if len(e):
                new = np.flatnonzero(np.concatenate([[True], head[e][1:] != head[e][:-1]]))
                alpha[head[e][new]] = np.add.reduceat(alpha[tail[e]] * weight[e], new)
        share = alpha[tail] * weight
        if is_long.any():
            many = np.flatnonzero(is_long)
            _filter_long(many[np.argsort(head[many], kind="stable")], tail, head, logs, roots, share)
        order = np.lexsort((-share, head))
        head, share = head[order], share[order]
        at = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        counts = np.diff(np.append(at, len(head)))
        share /= np.repeat(np.add.reduceat(share, at), counts)
        cum = np.cumsum(share)
        below = cum - np.repeat(cum[at] - share[at], counts)
        below[at + counts - 1] = 2.0  # the last edge takes what rounding leaves
        first = np.full(nodes, -1)
        first[head[at]] = at
        return first, below, length[order], ids[order]


def _sample_segments(segments: Segments, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled edges of all segments [starts, ends): (start of the edge, its id or -1), sorted by start."""
    position = ends - starts
    number = segments.numbers(codes, starts, position)
    root = segments.base[number] + number
    begin = starts
    out_at, out_id = [], []
    while len(begin):
        e = segments.first[root + position]
        u = noise[begin + position - 1]
        on = np.flatnonzero(u > segments.below[e])
        while len(on):
            e[on] += 1
            on = on[u[on] > segments.below[e[on]]]
        position = position - segments.length[e]
        out_at.append(begin + position)
        out_id.append(segments.id[e])
        go = position > 0
        root, position, begin = root[go], position[go], begin[go]
    where, ids = np.concatenate(out_at), np.concatenate(out_id)
    slot = np.full(len(codes), -2, np.int32)
    slot[where] = ids
    where = np.flatnonzero(slot > -2)
    return where, slot[where].astype(np.int64)


def _filter_long(edges: np.ndarray, tail: np.ndarray, head: np.ndarray, e_log: np.ndarray, roots: np.ndarray, share: np.ndarray) -> None:
    """Forward filter of long segments, edge by edge in order of their heads; shares are relative to the node's largest."""
    best: dict[int, float] = {}
    first = set(roots.tolist())
    i = 0
    while i < len(edges):
        j, node = i, int(head[edges[i]])
        while j < len(edges) and head[edges[j]] == node:
            j += 1
        logs = np.array([(best[int(tail[e])] if int(tail[e]) not in first else 0.0) + e_log[e] for e in edges[i:j]])
        top = logs.max()
        share[edges[i:j]] = np.exp(logs - top)
        best[node] = top + np.log(share[edges[i:j]].sum())
        i = j


def sample_rows(lat: Lattice, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows and the number of each row's tokens. ``seeds``: one 64-bit number per row."""
    ids: list[np.ndarray] = []
    counts, segments = np.zeros(len(texts), np.int64), lat.segments
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < SLICE):
            size += len(texts[j]) + 1
            j += 1
        whole = "".join(SPACE + t.replace(SPACE, MARK).replace(" ", SPACE) if t else "" for t in texts[i:j])
        if whole:
            codes = points(whole)
            lengths = np.array([len(t) + 1 if t else 0 for t in texts[i:j]])
            begins = np.concatenate([[0], np.cumsum(lengths)])
            row = np.repeat(np.arange(j - i), lengths)
            place = np.arange(len(codes), dtype=np.int64) - begins[row]
            cut = np.zeros(len(codes), bool)
            cut[lat.vocab.cuts(codes)] = True
            cut[begins[:-1][lengths > 0]] = True
            cuts = np.flatnonzero(cut)
            low = 0
            while low < len(cuts):  # a row over the slice is sampled in runs of whole segments
                high = max(low + 1, int(np.searchsorted(cuts, cuts[low] + SLICE)))
                a, b = int(cuts[low]), int(cuts[high]) if high < len(cuts) else len(codes)
                noise = (mix(seeds[i:j][row[a:b]] + place[a:b].astype(np.uint64) * _ratio) >> np.uint64(11)).astype(np.float64) / (1 << 53)
                where, got = _sample_segments(segments, codes[a:b], cuts[low:high] - a, np.append(cuts[low + 1 : high], b) - a, noise)
                got, n = _bytes(lat.vocab, codes[a:b][where], got)
                counts[i:j] += np.bincount(row[a:b][where], n, j - i).astype(np.int64)
                ids.append(got)
                low = high
        i = j
    return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), counts


def _bytes(vocab: Vocabulary, codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of id -1 become their byte pieces; the number of tokens that each edge gives."""
    n = np.where(ids < 0, _n_bytes(codes), 1)
    if not (ids < 0).any():
        return ids, n
    out = np.repeat(ids, n)
    at = np.concatenate([[0], np.cumsum(n)])
    for k in np.flatnonzero(ids < 0):
        letter = chr(codes[k])
        out[at[k] : at[k + 1]] = vocab.byte_ids[list((SPACE if letter == MARK else letter).encode("utf-8", "surrogatepass"))]
    return out, n


def decode_rows(vocab: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """UTF-8 bytes of the texts: pieces joined, U+2581 as a space, the leading space of the model removed."""
    parts = _piece_bytes(vocab)
    out, i = [], 0
    listed = ids.tolist()
    for n in counts.tolist():
        out.append(b"".join(map(parts.__getitem__, listed[i : i + n]))[1:])
        i += n
    return out


@functools.lru_cache(maxsize=2)
def _piece_bytes(vocab: Vocabulary) -> list[bytes]:
    out = [b""] * vocab.model.get_piece_size()
    for text, i in vocab.words:
        out[i] = text.replace(SPACE, " ").encode()
    for value, i in enumerate(vocab.byte_ids):
        if i >= 0:
            out[i] = bytes([value])
    return out


def _seeds(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.view(np.uint64) ^ mix(np.array([seed], np.uint64)))


def encode_documents(docs: DataFrame, model: str | None = None, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, ids, crc32 of the text, decoded_crc32 and ``lossless`` (the decoded bytes are those of the text).

    One row for each row; a null or empty text has no pieces. A literal U+2581 is given as its three bytes, as a space is
    a piece's U+2581. Rows with one key and text get one segmentation.
    """
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def encoded(lat: Lattice, frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in portions(frames):
            texts = [x or "" for x in frame.column(1).to_pylist()]
            seeds = _seeds(frame.column(2).to_numpy(zero_copy_only=False), seed)
            i = 0
            while i < len(texts):  # rows leave in slices
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < SLICE):
                    size += len(texts[j]) + 1
                    j += 1
                ids, n = sample_rows(lat, texts[i:j], seeds[i:j])
                back = decode_rows(lat.vocab, ids, n)
                wanted = [t.encode("utf-8", "surrogatepass") for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column(0).slice(i, j - i), pa.array(n, pa.int64()), list_array(ids.astype(np.int32), n),
                        pa.array([zlib.crc32(x) for x in wanted], pa.int64()), pa.array([zlib.crc32(x) for x in back], pa.int64()), pa.array([a == b for a, b in zip(back, wanted)]),
                    ],
                    ["doc_id", "n_pieces", "ids", "text_crc32", "decoded_crc32", "lossless"],
                )
                i = j

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model or public_tokenizers.path("piece_bpe_32k.model"), alpha)
        try:
            yield from encoded(lat, frames)
        finally:
            lat.segments.clear()  # a worker that waits holds no lattices; the next task soon has its own

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("_key"))
    return rows.mapInArrow(tidy(batches), f"doc_id {kind}, n_pieces long, ids array<int>, text_crc32 long, decoded_crc32 long, lossless boolean")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give a null text."""
    kind = dict(encoded.select("doc_id").dtypes)["doc_id"]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model or public_tokenizers.path("piece_bpe_32k.model"))
        for frame in frames:
            column = frame.column(1)
            n = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
            back = decode_rows(vocab, column.flatten().to_numpy(zero_copy_only=False), n)
            texts = [b.decode("utf-8", "surrogatepass") if ok else None for b, ok in zip(back, column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(batches), f"doc_id {kind}, text string")
