"""Personal data in texts: fixed patterns, and a character-level BiLSTM with a CRF on top, both in numpy.

*Base.* E-mail addresses, IP addresses, card numbers (Luhn) and phone numbers by fixed patterns, each kind leftmost and
non-overlapping over the whole text.

*Tagger.* Characters are reduced to classes (digits, lower and upper case, other letters, each punctuation mark). A
bidirectional LSTM gives scores for the tags O, B-kind, I-kind, transitions between tags come from a linear-chain CRF, and
both are trained together by the exact likelihood gradient. The labelled spans are base spans of a bounded sample
(``FIT_ROWS`` rows), shown as they are and in loosened forms (spaces around ``@`` or dots, other separators, no plus sign),
with windows of other text as negatives. Texts are decoded in windows that overlap by half; a character takes its tag from
the window in which it is most central, and spans are read off the joined sequence. A span must pass the rules of its
kind once separators are removed, and never touches a base span.

Every kind has digits or ``@`` in it, so a window without either is O throughout by definition and needs no decoding;
leaving it out changes nothing (``decode`` has a switch to show it).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom import staging
from metaloom.llm.text import portions, tidy

KINDS = ("email", "ip", "card", "phone")
#: rows with base spans to train on, and rows without
FIT_ROWS = 400
#: characters of an excerpt
EXCERPT = 10_000
WINDOW = 96
HIDDEN = 16
TAGS = 1 + 2 * len(KINDS)

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), ordered. Linear in the text: a local part is looked for from its ``@`` backwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        found = _AT.match(text, at) if begin < at else None
        if found:
            done = found.end()
            out.append((0, begin, done))
        else:
            done = at + 1
        at = text.find("@", done)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-20:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_MARKS = " \n\t.,;:!?@+-_()[]{}<>/\\|#$%&*='\"~^`"
_classes = np.full(0x110000, 4, np.uint8)  # other characters
_classes[ord("0") : ord("9") + 1] = 1
_classes[ord("a") : ord("z") + 1] = 2
_classes[ord("A") : ord("Z") + 1] = 3
for _k, _c in enumerate(_MARKS):
    _classes[ord(_c)] = 5 + _k
CLASSES = 5 + len(_MARKS)  # class 0 pads
_trigger = np.zeros(CLASSES, bool)
_trigger[[1, 5 + _MARKS.index("@")]] = True

_allowed = np.zeros((TAGS, TAGS), bool)
_allowed[:, 0] = True
_allowed[:, 1::2] = True
for _k in range(len(KINDS)):
    _allowed[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
_start = np.array([t == 0 or t % 2 == 1 for t in range(TAGS)])
NEVER = np.float32(-1e4)


def classes_of(text: str) -> np.ndarray:
    return _classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """Parameters of both directions (input table, recurrence) and of the output layer and transitions."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 11) -> Tagger:
        rng = np.random.default_rng(seed)
        h, p = HIDDEN, {}
        for d in "fb":
            p[f"x{d}"] = (rng.normal(size=(CLASSES, 4 * h)) * 0.3).astype(np.float32)
            p[f"x{d}"][:, h : 2 * h] += 1  # remember at first
            p[f"h{d}"] = (rng.normal(size=(h, 4 * h)) / np.sqrt(h)).astype(np.float32)
        p["o"] = (rng.normal(size=(2 * h, TAGS)) * 0.3).astype(np.float32)
        p["ob"] = np.zeros(TAGS, np.float32)
        p["t"] = np.zeros((TAGS, TAGS), np.float32)
        return Tagger(p)

    def _run(self, x: np.ndarray, d: str, keep: bool = False):
        h, wx, wh = HIDDEN, self.p[f"x{d}"], self.p[f"h{d}"]
        steps, n = x.shape
        out, c, last = np.zeros((steps, n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        kept = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wx[x[t]] + last @ wh
            gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            before = c
            c = gates[:, h : 2 * h] * c + gates[:, :h] * g
            tc = np.tanh(c)
            if keep:
                kept.append((t, gates, g, before, tc, last))
            last = gates[:, 2 * h :] * tc
            out[t] = last
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, "f")[0], self._run(x, "b")[0]], 2)
        return both @ self.p["o"] + self.p["ob"]

    def transitions(self) -> np.ndarray:
        return np.where(_allowed, self.p["t"], NEVER)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags; ``x``: step, window."""
        e, trans = self.emissions(x), self.transitions()
        steps, n, _ = e.shape
        score = np.where(_start, e[0], NEVER)
        back = np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            every = score[:, :, None] + trans
            back[t] = every.argmax(1)
            score = every.max(1) + e[t]
        tags = np.zeros((steps, n), np.int8)
        tags[-1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(n), tags[t]]
        return tags

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags ``y`` and its gradient, by forward-backward and back-propagation through time."""
        (hf, kf), (hb, kb) = self._run(x, "f", True), self._run(x, "b", True)
        both = np.concatenate([hf, hb], 2)
        e, trans = (both @ self.p["o"] + self.p["ob"]).astype(np.float64), self.transitions().astype(np.float64)
        steps, n, _ = e.shape
        a, b = np.zeros_like(e), np.zeros_like(e)

        def lse(z: np.ndarray, axis: int) -> np.ndarray:
            top = z.max(axis, keepdims=True)
            return (top + np.log(np.exp(z - top).sum(axis, keepdims=True))).squeeze(axis)

        a[0] = np.where(_start, e[0], NEVER)
        for t in range(1, steps):
            a[t] = lse(a[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            b[t] = lse(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
        log_z = lse(a[-1], 1)
        node = np.exp(a + b - log_z[:, None])
        pair = np.exp(a[:-1, :, :, None] + trans + (e[1:] + b[1:])[:, :, None, :] - log_z[:, None, None])
        rows = np.arange(n)
        gold = sum(e[t, rows, y[t]] for t in range(steps)) + sum(trans[y[t - 1], y[t]] for t in range(1, steps))
        de = node.copy()
        for t in range(steps):
            de[t, rows, y[t]] -= 1
        dt = pair.sum((0, 1))
        np.add.at(dt, (y[:-1].ravel(), y[1:].ravel()), -1.0)
        de = (de / n).astype(np.float32)
        g = {"o": np.einsum("tnh,tnk->hk", both, de), "ob": de.sum((0, 1)), "t": (dt / n * _allowed).astype(np.float32)}
        dh_all = de @ self.p["o"].T
        for d, kept, dh in (("f", kf, dh_all[:, :, :HIDDEN]), ("b", kb, dh_all[:, :, HIDDEN:])):
            g[f"x{d}"], g[f"h{d}"] = self._back(x, d, kept, dh)
        return float((log_z - gold).mean()), g

    def _back(self, x: np.ndarray, d: str, kept: list, dh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, wh = HIDDEN, self.p[f"h{d}"]
        gx, gh = np.zeros((CLASSES, 4 * h), np.float32), np.zeros_like(wh)
        dlast, dc = np.zeros_like(dh[0]), np.zeros_like(dh[0])
        onehot = np.eye(CLASSES, dtype=np.float32)
        for t, gates, g, before, tc, last in reversed(kept):
            total = dh[t] + dlast
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            dc = dc + total * o * (1 - tc**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), total * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
            dc = dc * f
            gh += last.T @ dz
            gx += onehot[x[t]].T @ dz
            dlast = dz @ wh.T
        return gx, gh

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 3) -> list[float]:
        """Adam; ``x``, ``y``: window, step."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                loss, g = self.gradient(x[some].T, y[some].T)
                norm = np.sqrt(sum(float((w**2).sum()) for w in g.values()))
                step += 1
                total += loss * len(some)
                for k, w in g.items():
                    w = w * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * w
                    v[k] = 0.99 * v[k] + 0.01 * w**2
                    self.p[k] = (self.p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(total / max(len(x), 1))
        return losses


def loosened(kind: int, span: str, rng: np.random.Generator) -> str:
    """The span in a form that the patterns don't know."""
    way = rng.integers(3)
    if kind == 0:
        return span.replace("@", (" @ ", " @", "(@)")[way])
    if kind == 1:
        return span.replace(".", (" . ", ". ", " .")[way])
    if kind == 2:
        d = _digits(span)
        return (".", "/", "_")[way].join(d[k : k + 4] for k in range(0, len(d), 4))
    return (span.lstrip("+"), span.replace("+", "00"), span.replace("+", "+ "))[way]


def examples(texts: list[str], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows (classes, tags): around every base span, as it is and loosened, and of other text."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text: str, spans: list[tuple[int, int, int]], at: int) -> None:
        part = classes_of(text[at : at + WINDOW])
        tags = np.zeros(WINDOW, np.int64)
        for kind, a, b in spans:
            a, b, cut = max(a - at, 0), min(b - at, WINDOW), a < at
            if a < b:
                tags[a:b] = 2 + 2 * kind
                if not cut:
                    tags[a] = 1 + 2 * kind
                elif a == 0:
                    tags[0] = 1 + 2 * kind
        xs.append(np.pad(part, (0, WINDOW - len(part))))
        ys.append(tags)

    for text in texts:
        spans = base_spans(text)
        spans = [s for s in spans if not any(o is not s and o[1] < s[2] and s[1] < o[2] for o in spans)]
        for kind, a, b in spans:
            at = max(0, a - int(rng.integers(4, WINDOW // 2)))
            add(text, spans, at)
            new = loosened(kind, text[a:b], rng)
            changed = text[max(0, a - WINDOW) : a] + new + text[b : b + WINDOW]
            begin = min(a, WINDOW)
            add(changed, [(kind, begin, begin + len(new))], max(0, begin - int(rng.integers(4, WINDOW // 2))))
        for _ in range(2):
            at = int(rng.integers(0, max(1, len(text) - WINDOW)))
            add(text, spans, at)
        numbers = [m.start() for m in re.finditer(r"[0-9]+", text)][:4]
        for at in numbers:
            add(text, spans, max(0, at - int(rng.integers(0, WINDOW // 2))))
    return (np.stack(xs), np.stack(ys)) if xs else (np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), np.int64))


def _excerpts(docs: DataFrame) -> DataFrame:
    """doc_id, part, text: whole texts in parts of ``EXCERPT`` characters, those with digits or ``@``."""
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{EXCERPT}}}"), F.lit(0))
    rows = docs.where("doc_id IS NOT NULL AND text RLIKE '[0-9@]'")
    return rows.select("doc_id", F.posexplode(parts).alias("part", "text")).where("text RLIKE '[0-9@]'")


def fit(docs: DataFrame, rows: int = FIT_ROWS, epochs: int = 8) -> Tagger:
    """Trained on ``rows`` excerpts with digits or ``@``, those of the smallest hashes, of texts of any length; without any, it tags nothing."""
    spark = docs.sparkSession
    order = F.xxhash64(F.lit("pii"), F.col("doc_id"), F.col("part"))
    excerpts = _excerpts(docs.select("doc_id", "text"))
    some = excerpts.select("doc_id", "part").orderBy(order, "doc_id", "part").limit(4 * rows)
    sample = excerpts.join(F.broadcast(some), ["doc_id", "part"], "left_semi")
    # spans of interest first, so that all kinds are met
    ranked = sample.withColumn("_some", F.rlike("text", F.lit(r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){12}|\+[0-9]")).cast("int"))
    got = staging.stage(ranked.orderBy(F.desc("_some"), order, "doc_id", "part").limit(rows).select("doc_id", "text"), staging.new_stage(spark, "pii-fit"))
    texts = [r["text"] for r in got.orderBy("doc_id", "text").collect()]
    tagger = Tagger.fresh()
    x, y = examples(texts)
    if len(x):
        tagger.train(x, y, epochs)
    else:
        tagger.p["ob"][0] = 1e6
    return tagger


def _valid(kind: int, span: str) -> bool:
    if kind == 0:
        local, _, host = re.sub(r"[\s()\[\]]", "", span).rpartition("@")
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", f"{local}@{host}")) if local else False
    if kind == 1:
        parts = re.sub(r"\s", "", span).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    d = _digits(span)
    if re.search(r"[^0-9\s./_()+-]", span):
        return False
    return 13 <= len(d) <= 19 and luhn(d) if kind == 2 else 9 <= len(d) <= 15


def tagged_spans(tagger: Tagger, texts: list[str], prune: bool = True, most: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Spans read off the reconciled tags of each text, before any base spans are taken out."""
    half, quarter = WINDOW // 2, WINDOW // 4
    parts, firsts, owners, offsets, at = [], [], [], [], 0
    for k, text in enumerate(texts):
        offsets.append(at)
        c = classes_of(text)
        starts = np.arange(0, max(len(c) - half, 1), half) if len(c) else np.zeros(0, np.int64)
        firsts.append(starts + at)
        owners.append(np.full(len(starts), k))
        parts.append(np.concatenate([c, np.zeros(WINDOW, np.uint8)]))
        at += len(c) + WINDOW
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    first, owner = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (firsts, owners))
    hits = np.concatenate([[0], np.cumsum(_trigger[flat])])
    ends = np.minimum(first + WINDOW, len(flat))
    live = np.flatnonzero(hits[ends] > hits[first])
    run = live if prune else np.arange(len(first))
    tags = np.zeros(len(flat) + WINDOW, np.int8)
    is_first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    is_last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
    lived = np.zeros(len(first), bool)
    lived[live] = True
    for i in range(0, len(run), most):
        some = run[i : i + most]
        got = tagger.decode(flat[(first[some][None, :] + np.arange(WINDOW)[:, None])])
        got[:, ~lived[some]] = 0
        low = np.where(is_first[some], 0, quarter)
        high = np.where(is_last[some], WINDOW, quarter + half)
        step = np.arange(WINDOW)[:, None]
        own = (step >= low) & (step < high)
        tags[(first[some][None, :] + step)[own]] = got[own]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    marked = np.flatnonzero(tags[: len(flat)])
    if len(marked) == 0:
        return out
    kind = (tags[marked] - 1) // 2
    new = np.concatenate([[True], (np.diff(marked) > 1) | (np.diff(kind) != 0) | (tags[marked][1:] % 2 == 1)])
    begins = np.flatnonzero(new)
    stops = np.append(begins[1:], len(marked)) - 1
    whose = np.searchsorted(np.array(offsets), marked[begins], "right") - 1
    for b, s, k in zip(begins, stops, whose):
        out[k].append((int(kind[b]), int(marked[b] - offsets[k]), int(marked[s] + 1 - offsets[k])))
    return out


def find(tagger: Tagger, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base, all) spans of each text, ordered by kind and start."""
    out = []
    for text, tagged in zip(texts, tagged_spans(tagger, texts)):
        base = base_spans(text)
        added = []
        for kind, a, b in tagged:
            b = min(b, len(text))  # a window may go on behind the text
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1] in " \n\t.,;:":
                b -= 1
            if a < b and _valid(kind, text[a:b]) and not any(s < b and a < e for _, s, e in base + added):
                added.append((kind, a, b))
        out.append((base, sorted(base + added)))
    return out


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


GROUP = 1 << 19


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < GROUP):
            size += len(texts[j]) + WINDOW
            j += 1
        yield i, j
        i = j


def find_documents(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added; a null text counts as empty."""
    tagger = tagger or fit(docs)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(tagger.p)  # a fixed size, about 60 kB

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(sent.value)
        for frame in frames:
            texts = [x or "" for x in frame.column(1).to_pylist()]
            for i, j in _groups(texts):
                found = find(own, texts[i:j])
                n = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column(0).slice(i, j - i), *(pa.array(x, pa.int64()) for x in n),
                        pa.array([hashlib.sha256(_text(base).encode()).hexdigest() for base, _ in found]), pa.array([_text(every) for _, every in found]), pa.array([len(every) - len(base) for base, every in found], pa.int64()),
                    ],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(batches), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, as in ``<email>``; all other columns as they are."""
    tagger = tagger or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(tagger.p)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(sent.value)
        for frame in portions(frames):
            at = frame.schema.get_field_index("text")
            given = frame.column(at).to_pylist()
            texts = [x or "" for x in given]
            new: list[str | None] = []
            for i, j in _groups(texts):
                for k, (_, spans) in enumerate(find(own, texts[i:j]), i):
                    text, done, pieces = texts[k], 0, []
                    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if b > done:  # kinds may overlap each other
                            pieces += [text[done:a] if a >= done else "", f"<{KINDS[kind]}>" if a >= done else ""]
                            done = b
                    new.append(given[k] if not spans else "".join(pieces) + text[done:])
            yield pa.RecordBatch.from_arrays([pa.array(new, frame.schema.field(at).type) if c == at else frame.column(c) for c in range(frame.num_columns)], schema=frame.schema)

    return docs.mapInArrow(tidy(batches), docs.schema)
