"""Periodic runs of words, found in a grammar of each text.

A run is a stretch of words with smallest period q and at least max(``LEAST``, 3 q) words that can't be extended.

Grammar: Re-Pair on the word ids of a text. A round replaces the pairs that occur twice or more and more often than the
pairs that overlap them, all texts of a slice at once, until no pair is repeated. A run lies within the expansion of some
nonterminal X -> YZ, or of the start rule, and there it crosses the boundary between two symbols. So each boundary is
looked at once, at the first place X derives: candidates for q are distances to equal g-grams that begin or end at the
boundary (for 2^j <= q < 2^(j+1) a run has equal 2^(j-1)-grams q apart beside any place that it crosses), each is extended
word by word to both sides as far as X reaches. What is long enough is translated to all places that X derives; intervals
of one period that overlap by a period or more are one run, and of one interval the smallest period counts.

g-grams are compared by exact ranks (prefix doubling), extensions by the words' 64-bit hashes. Only stretches in which every 4-gram
occurs again within the stretch go into the grammar: a run consists of such 4-grams, so none is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metaloom.llm.text import buffers, mix, slices, tidy, words

#: words of the shortest run, and periods it holds
LEAST, TIMES = 24, 3
#: bytes of text handled at once; a longer text is handled alone
SLICE = 1 << 21
#: cells of one step of the extension
CELLS = 1 << 21
_GRAM = 4
_odd = np.uint64(0x9E3779B97F4A7C15)
_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _stretches(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the maximal stretches of set flags with ``least`` or more of them."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= least
    return begins[long], ends[long]


def repeated_stretches(codes: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the texts [first, end) in which every 4-gram occurs twice, long enough for a run."""
    while True:
        keep = ends - firsts >= LEAST
        firsts, ends = firsts[keep], ends[keep]
        if not len(firsts):
            return firsts, ends
        lengths = ends - firsts
        owner = np.repeat(np.arange(len(firsts)), lengths)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + firsts[owner]
        inner = at + _GRAM <= ends[owner]
        at, owner = at[inner], owner[inner]
        gram = codes[at]
        for k in range(1, _GRAM):
            gram = mix(gram * _odd + codes[at + k])
        gram = mix(gram ^ (owner.astype(np.uint64) * _odd))
        order = np.argsort(gram)
        same = gram[order[1:]] == gram[order[:-1]]
        again = np.zeros(len(codes) + 1, bool)
        again[at[order[1:][same]]] = True
        again[at[order[:-1][same]]] = True
        begins, stops = _stretches(again[:-1], LEAST - _GRAM + 1)
        if len(begins) == len(firsts) and (begins == firsts).all() and (stops + _GRAM - 1 == ends).all():
            return firsts, ends
        firsts, ends = begins, stops + _GRAM - 1


class Grammar:
    """Re-Pair of several sequences at once. Symbols below ``terminals`` are words, later ones nonterminals in the order they were made.

    ``left``, ``right``, ``size``, ``first`` (a place it derives) describe nonterminal ``terminals + k``; ``rounds`` are the counts
    of nonterminals at the end of each round; ``symbols`` at places ``at`` are the start rules.
    """

    def __init__(self, word_ids: np.ndarray, owner: np.ndarray):
        self.terminals = int(word_ids.max()) + 1 if len(word_ids) else 0
        n = len(word_ids)
        symbols, at, of = word_ids.astype(np.int64), np.arange(n), owner
        done_symbols, done_at, left, right, size, first = [], [], [], [], [], []
        sizes = np.ones(self.terminals, np.int64)
        self.rounds = [0]
        made = 0
        while len(symbols):
            # a pair's key is (owner, left, right); pairs over the end of a sequence have none
            inside = of[1:] == of[:-1]
            key = mix(mix(symbols[:-1].astype(np.uint64) * _odd + of[:-1].astype(np.uint64)) ^ symbols[1:].astype(np.uint64))
            where = np.flatnonzero(inside)
            pair = np.full(len(symbols), -1, np.int64)
            if len(where):
                pair[where] = _ranks(key[where])
            # equal pairs in a row (a a a) overlap: every second one can be replaced
            new = np.ones(len(symbols), bool)
            new[1:] = pair[1:] != pair[:-1]
            starts = np.flatnonzero(new)
            within = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
            usable = (pair >= 0) & (within % 2 == 0)
            counts = np.bincount(pair[usable], minlength=int(pair.max()) + 1) if usable.any() else np.zeros(1, np.int64)
            rank = np.where(pair >= 0, counts[pair] * (len(counts) + 1) + pair, -1)  # of a row of equal pairs
            heads = rank[starts]
            before, after = np.concatenate([[-1], heads[:-1]]), np.concatenate([heads[1:], [-1]])
            wins = (heads > before) & (heads > after) & (heads >= 0)
            chosen = usable & np.repeat(wins, np.diff(np.append(starts, len(symbols)))) & (counts[pair] >= 2)
            won = np.bincount(pair[chosen], minlength=len(counts))
            chosen &= won[pair] >= 2
            places = np.flatnonzero(chosen)
            # sequences in which nothing is replaced are finished
            live = np.zeros(int(of[-1]) + 1, bool)
            live[of[places]] = True
            rest = ~live[of]
            done_symbols.append(symbols[rest])
            done_at.append(at[rest])
            if not len(places):
                break
            distinct, firsts, numbers = np.unique(pair[places], return_index=True, return_inverse=True)
            sample = places[firsts]
            left.append(symbols[sample])
            right.append(symbols[sample + 1])
            first.append(at[sample])
            fresh = sizes[symbols[sample]] + sizes[symbols[sample + 1]]
            size.append(fresh)
            symbols[places] = self.terminals + made + numbers
            sizes = np.concatenate([sizes, fresh])
            made += len(distinct)
            self.rounds.append(made)
            keep = ~rest
            keep[places + 1] = False
            symbols, at, of = symbols[keep], at[keep], of[keep]
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.left, self.right, self.size, self.first = join(left), join(right), join(size), join(first)
        symbols, at = join(done_symbols), join(done_at)
        order = np.argsort(at)
        self.symbols, self.at, self.sizes = symbols[order], at[order], sizes

    def places(self, number: np.ndarray, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals [begin, end) within the expansion of a nonterminal (by its number), at all places that it derives."""
        bears = np.zeros(len(self.left), bool)
        bears[number] = True
        for low, high in zip(self.rounds[:-1], self.rounds[1:], strict=True):
            for child in (self.left[low:high], self.right[low:high]):
                inner = child >= self.terminals
                bears[low:high][inner] |= bears[child[inner] - self.terminals]
        order = np.argsort(number, kind="stable")
        number, begin, end, period = number[order], begin[order], end[order], period[order]
        inner = self.symbols >= self.terminals
        waiting, at = self.symbols[inner] - self.terminals, self.at[inner]
        hit = bears[waiting]
        waiting, at = waiting[hit], at[hit]
        out = [(np.zeros(0, np.int64),) * 3]
        for low in self.rounds[-2::-1]:
            now = waiting >= low
            which, where = waiting[now], at[now]
            a, b = np.searchsorted(number, which), np.searchsorted(number, which, "right")
            each = np.repeat(np.arange(len(which)), b - a)
            take = np.arange(len(each)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[each]
            out.append((where[each] + begin[take], where[each] + end[take], period[take]))
            nodes, starts = [waiting[~now]], [at[~now]]
            for child, shift in ((self.left[which], 0), (self.right[which], self.sizes[self.left[which]])):
                goes = child >= self.terminals
                goes[goes] = bears[child[goes] - self.terminals]
                nodes.append(child[goes] - self.terminals)
                starts.append((where + shift)[goes])
            waiting, at = np.concatenate(nodes), np.concatenate(starts)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _reach(ids: np.ndarray, at: np.ndarray, period: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many positions at, at + step, ... (``limit`` at most) hold the word that stands a period later."""
    got, active, width = np.zeros(len(at), np.int64), np.arange(len(at)), 16
    while len(active):
        part, active_rest = active[: max(1, CELLS // width)], active[max(1, CELLS // width) :]
        offset = got[part][:, None] + np.arange(width)
        valid = offset < limit[part][:, None]
        where = at[part][:, None] + step * np.where(valid, offset, 0)
        equal = valid & (ids[np.where(valid, where, 0)] == ids[np.where(valid, where + period[part][:, None], 0)])
        ran = np.where(equal.all(1), width, np.argmin(equal, 1))
        got[part] += ran
        active = np.concatenate([part[ran == width], active_rest])
        if not len(active_rest):
            width = min(2 * width, 1 << 12)
    return got


def _candidates(ids: np.ndarray, ends: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boundary number, anchor, period): the words at the anchor and a period later begin or end equal grams beside the boundary."""
    n = len(ids)
    rank, gram = ids, 1
    usable = np.ones(n, bool)
    found = []
    least, longest = 1, int((high - low).max(initial=0)) // TIMES
    while least <= longest:
        most = 7 if least == 1 else 2 * least - 1
        while gram < max(_GRAM, least // 2):  # ranks of grams of twice the length, where both halves occur again
            can = np.flatnonzero(usable[: n - gram] & usable[gram:] & (np.arange(n - gram) + 2 * gram <= ends[: n - gram]))
            wider = np.full(n, -1, np.int64)
            if len(can):
                wider[can] = _ranks(rank[can] * np.int64(n + 1) + rank[can + gram])
                wider[can[np.bincount(wider[can])[wider[can]] < 2]] = -1
            rank, usable, gram = wider, wider >= 0, 2 * gram
        held = np.flatnonzero(usable)
        if not len(held):
            break
        line = np.sort(rank[held] * np.int64(n) + held)
        room = (high - low >= np.maximum(LEAST, TIMES * least))
        for side in (0, 1):
            anchor = b if side == 0 else b - gram
            ok = np.flatnonzero(room & (anchor >= low) & (anchor + gram <= high))
            ok = ok[usable[anchor[ok]]]
            x = anchor[ok]
            if side == 0:
                nearest, farthest = x + least, np.minimum(x + most, high[ok] - gram)
            else:
                nearest, farthest = np.maximum(x - most, low[ok]), x - least
            from_ = np.searchsorted(line, rank[x] * n + nearest)
            to = np.maximum(np.searchsorted(line, rank[x] * n + farthest, "right"), from_)
            each = np.repeat(np.arange(len(ok)), to - from_)
            other = line[np.arange(len(each)) - np.repeat(np.cumsum(to - from_) - (to - from_), to - from_) + from_[each]] % n
            near = np.minimum(x[each], other)
            q = np.abs(other - x[each])
            found.append((ok[each], near if side == 0 else b[ok[each]] - q, q))
        least = 8 if least == 1 else 2 * least
    if not found:
        return (np.zeros(0, np.int64),) * 3
    which, anchor, q = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = TIMES * q <= (high - low)[which]
    return which[keep], anchor[keep], q[keep]


def _crossing(ids: np.ndarray, ends: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(boundary number, begin, end, period) of the runs that cross a boundary b within [low, high)."""
    which, anchor, q = _candidates(ids, ends, b, low, high)
    lo, hi = low[which], high[which]
    begin = anchor - _reach(ids, anchor - 1, q, anchor - lo, -1)
    end = anchor + _reach(ids, anchor, q, hi - q - anchor, 1) + q
    good = (end - begin >= np.maximum(LEAST, TIMES * q)) & (begin < b[which]) & (end > b[which])
    return which[good], begin[good], end[good], q[good]


def merged(begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals: those of one period that overlap by a period or more are united, of equal intervals the smallest period stays."""
    if not len(begin):
        return begin, end, period
    order = np.lexsort((begin, period))
    begin, end, period = begin[order], end[order], period[order]
    group = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]]))
    far = int(end.max()) + 1
    so_far = np.maximum.accumulate(end + group * far) - group * far
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (begin[1:] > so_far[:-1] - period[1:])])
    heads = np.flatnonzero(fresh)
    begin, end, period = begin[heads], np.maximum.reduceat(end, heads), period[heads]
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    first = np.concatenate([[True], (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])])
    return begin[first], end[first], period[first]


def runs(codes: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of all runs of the texts codes[first:end], sorted by begin and period."""
    begins, stops = repeated_stretches(codes, firsts, ends)
    if not len(begins):
        return (np.zeros(0, np.int64),) * 3
    lengths = stops - begins
    base = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(begins)), lengths)
    at = np.arange(len(owner)) - base[owner] + begins[owner]
    ids = _ranks(codes[at])
    tail = (base + lengths)[owner]
    g = Grammar(ids, owner)
    # boundaries of the nonterminals at one place each, and those between the symbols of the start rules
    if len(g.left):
        number, begin, end, q = _crossing(ids, tail, g.first + g.sizes[g.left], g.first, g.first + g.size)
        inner = g.places(number, begin - g.first[number], end - g.first[number], q)
    else:
        inner = (np.zeros(0, np.int64),) * 3
    own = owner[g.at]
    b = g.at[1:][own[1:] == own[:-1]]
    _, *outer = _crossing(ids, tail, b, base[owner[b]], tail[b])
    begin, end, q = merged(*(np.concatenate(x) for x in zip(inner, outer, strict=True)))
    return at[begin], at[end - 1] + 1, q


def planted(n: int, doc_id) -> np.ndarray | None:
    """Word numbers of a text of ``n`` words with the repetition that its id asks for; null where it asks for none."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % p
    return i


_SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _rows(column: pa.Array, ids: list, plant: bool) -> Iterator[tuple]:
    data, offsets = buffers(column)
    for i, j in slices(offsets, SLICE):
        part = data[int(offsets[i]) : int(offsets[j])]
        row, starts, hashed = words(data, offsets[i : j + 1], lower=False)
        edges = np.searchsorted(row, np.arange(j - i + 1))
        held = np.flatnonzero(~_space[part])
        lengths = np.diff(np.append(np.searchsorted(held, starts), len(held)))
        source = np.arange(len(hashed))
        for k in range(j - i) if plant else ():
            to = planted(int(edges[k + 1] - edges[k]), ids[i + k])
            if to is not None:
                source[edges[k] : edges[k + 1]] = to + edges[k]
        begin, end, q = runs(hashed[source], edges[:-1], edges[1:])
        depth = np.zeros(len(source) + 1, np.int64)
        np.add.at(depth, begin + q, 1)
        np.add.at(depth, end, -1)
        kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
        # kept words, one space behind each
        words_of = source[kept]
        wide = lengths[words_of] + 1
        stops = np.cumsum(wide)
        text = np.full(int(stops[-1]) if len(stops) else 0, 0x20, np.uint8)
        letters = np.arange(int(lengths[words_of].sum()))
        shift = np.cumsum(lengths[words_of]) - lengths[words_of]
        text[letters + np.repeat(np.arange(len(words_of)), lengths[words_of])] = part[letters + np.repeat(starts[words_of] - shift, lengths[words_of])]
        cuts = np.concatenate([[0], stops])[np.searchsorted(kept, edges)]
        of = np.searchsorted(begin, edges)
        for k in range(j - i):
            found = [(int(begin[r] - edges[k]), int(end[r] - begin[r]), int(q[r])) for r in range(of[k], of[k + 1])]
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
            best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
            four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            collapsed = text[cuts[k] : max(cuts[k], cuts[k + 1] - 1)].tobytes()
            yield len(found), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), found


def _batches(plant: bool, full: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ids = frame.column(0).to_pylist()
            rows = list(_rows(frame.column(1), ids, plant))
            if full:
                flat = [(i, *x) for i, row in zip(ids, rows, strict=True) for x in row[-1]]
                kept = [frame.column(0).type, pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate(kept)], ["doc_id", "start", "length", "period"])
            else:
                names = [x.split()[0] for x in _SCHEMA.split(", ")]
                types = [pa.string() if x.endswith("string") else pa.int64() for x in _SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([frame.column(0), *(pa.array([x[k] for x in rows], t) for k, t in enumerate(types))], ["doc_id", *names])

    return tidy(run)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period of every run of every text; texts without a run (null, empty, short) have no row."""
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_batches(False, True), f"doc_id {kind}, start long, length long, period long")


def summarise_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """A row per document: doc_id, n_runs, the run of the greatest length / period, digests of all runs and of the text without repetitions.

    ``plant`` first repeats part of the texts whose id asks for it (a null id asks for nothing). A null or empty text has no run and the
    digests of the empty string; repeated rows have a row each; other columns are left out. Rows don't depend on each other: no shuffle.
    """
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_batches(plant, False), f"doc_id {kind}, {_SCHEMA}")
