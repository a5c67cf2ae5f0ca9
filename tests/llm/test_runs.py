"""Periodic runs against a brute-force version."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from metaloom.llm import periodic_runs as P


def brute(w):
    """All (start, length, period), by every period from the smallest."""
    n, found, seen = len(w), [], set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda x: (x[0], x[2]))


def text_of(r):
    words = [f"w{k}" for k in range(r.choice([1, 2, 3, 8, 40]))]
    out = []
    while len(out) < r.choice([10, 60, 200, 500]):
        kind = r.random()
        if kind < 0.3:
            out += r.choices(words, k=r.randint(1, 30))
        elif kind < 0.8:
            block = r.choices(words, k=r.randint(1, r.choice([3, 12, 40])))
            out += (block * r.randint(2, 9))[: r.randint(1, 200)]
        elif out:
            i = r.randrange(len(out))
            out += out[i : i + r.randint(1, 60)]
    return out


def found(texts):
    flat = [x for t in texts for x in t]
    codes = np.array([zlib.crc32(x.encode()) + 1 for x in flat], np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    firsts = ends - [len(t) for t in texts]
    b, e, q = P.runs(codes, firsts, ends)
    of = np.searchsorted(ends, b, "right")
    return [sorted(((int(s - firsts[k]), int(t - s), int(p)) for s, t, p, o in zip(b, e, q, of) if o == k), key=lambda x: (x[0], x[2])) for k in range(len(texts))]


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    texts = [text_of(r) for _ in range(60)]
    assert found(texts) == [brute(t) for t in texts]


def test_words_of_thue_and_fibonacci_and_nested_powers():
    thue, fib = "0", ["1", "0"]
    for _ in range(10):
        thue += thue.translate(str.maketrans("01", "10"))
    for _ in range(13):
        fib.append(fib[-1] + fib[-2])
    nested = ("a" * 30 + "b") * 7 + "a" * 40 + ("ab" * 15 + "c") * 6
    texts = [list(thue), list(fib[-1]), list(nested), list("a" * 1000), list("ab" * 12), list("ab" * 11 + "a"), list("abcdefgh" * 3), list("abcdefghi" * 2 + "abcdefgh"), []]
    assert found(texts) == [brute(t) for t in texts]


def test_grammar_derives_the_text_and_repeats_no_pair():
    r = random.Random(3)
    texts = [text_of(r) for _ in range(40)]
    flat = [x for t in texts for x in t]
    ids = np.unique(np.array(flat), return_inverse=True)[1]
    owner = np.repeat(np.arange(40), [len(t) for t in texts])
    g = P.Grammar(ids.copy(), owner)

    def derive(s):
        stack, out = [int(s)], []
        while stack:
            x = stack.pop()
            if x < g.terminals:
                out.append(x)
            else:
                stack += [int(g.right[x - g.terminals]), int(g.left[x - g.terminals])]
        return out

    assert [x for s in g.symbols for x in derive(s)] == ids.tolist()
    own = owner[g.at]
    pairs = [(o, a, b) for o, p, a, b in zip(own, own[1:], g.symbols, g.symbols[1:]) if o == p]
    loops = {k for k in pairs if k[1] == k[2]}  # a a a holds its pair twice, but not side by side
    assert len([k for k in pairs if k not in loops]) == len({k for k in pairs if k not in loops})


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *four, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def test_query_equals_brute_force(spark):
    r = random.Random(11)
    rows = [(k, r.choice([" ", "  ", "\n", "\x0b \t"]).join(text_of(r)) + r.choice(["", " "])) for k in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, "a " * 50), (1003, "é " * 40 + "日本 x"), (1003, "é " * 40 + "日本 x"), (1004, " ".join(f"u{i % 700}" for i in range(3000)))]
    docs = spark.createDataFrame([(k, 5, t, "x") for k, t in rows], "doc_id long, period int, text string, start string").repartition(3)
    got = sorted((tuple(x) for x in P.summarise_runs(docs, plant=True).collect()), key=str)
    assert got == sorted((expected(k, t) for k, t in rows), key=str)
    lists = {(x.doc_id, x.start, x.length, x.period) for x in P.find_runs(docs).collect()}
    assert lists == {(k, *x) for k, t in rows for x in brute(re.findall(r"[^\x20\x09-\x0d]+", t or ""))}
    none = P.summarise_runs(docs.limit(0))
    assert none.count() == 0 and P.find_runs(docs.limit(0)).count() == 0


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("7", "a b " * 20), (None, "x")], "doc_id string, text string")
    assert {x.doc_id: x.n_runs for x in P.summarise_runs(docs, plant=True).collect()}.keys() == {"7", None}


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001"])
def test_given_documents(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    short = [x for x in docs.collect() if len(x.text or "") < 4000]
    got = {x.doc_id: tuple(x) for x in P.summarise_runs(docs, plant=True).collect()}
    assert len(got) == docs.count()
    assert [got[x.doc_id] for x in short] == [expected(x.doc_id, x.text) for x in short]
