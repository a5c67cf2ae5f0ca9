"""Token counts and sampled segmentations (operators 4 and 1)."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from metaloom.llm import piece_sampling, token_counts
from metaloom.llm.pieces import vocabulary

DOCS = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def vocab():
    return vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def lat():
    return piece_sampling.lattice(public_tokenizers.path("piece_bpe_32k.model"), 1.0)


def odd_text(r: random.Random) -> str:
    base = "".join(r.choice("etaoin shrdlu") for _ in range(r.randint(0, 300)))
    strange = ["  ", "   ", "\n", "　", "😀", "日本語", "\x00", "▁", "éß", "a" * 27, " " * 40, "x" * 90]
    return "".join(c if r.random() > 0.05 else r.choice(strange) for c in base)


def test_spliced_chunks_give_the_encoding_of_the_whole_text(vocab):
    r = random.Random(1)
    texts = [odd_text(r) for _ in range(150)] + ["a" * 5000, " " * 3000, "", "ab" * 2000 + " " + "c" * 100, "日" * 300]
    for text in texts:
        for chunk, overlap in ((50, 8), (17, 3), (200, 40)):
            assert token_counts.encode_spliced(vocab, text, chunk, overlap).tolist() == vocab.model.encode(text)


def test_counts_of_rows(spark, vocab):
    texts = [None, "", "a", "a", "the end " * 6000, "<s> </s>", "日本"]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k].n_tokens == len(vocab.model.encode(t or "")) and got[k].n_bytes == len((t or "").encode())
        assert got[k].over_limit == (got[k].n_tokens > 4096)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_samples_decode_to_the_text_and_depend_on_the_key_alone(lat):
    r = random.Random(2)
    texts = [odd_text(r) for _ in range(60)] + ["", " ", "x" * 700, "the " * 100]
    seeds = piece_sampling._seeds(np.arange(len(texts), dtype=np.int64), 0)
    ids, n = piece_sampling.sample_rows(lat, texts, seeds)
    assert piece_sampling.decode_rows(lat.vocab, ids, n) == [(t or "").encode() for t in texts]
    alone = [piece_sampling.sample_rows(lat, [t], seeds[k : k + 1])[0].tolist() for k, t in enumerate(texts)]
    assert sum(alone, []) == ids.tolist()


def test_samples_follow_the_distribution_of_all_segmentations(lat):
    known = dict(lat.vocab.words)

    def every(s):
        return [(s[:k], *rest) for k in range(1, len(s) + 1) if s[:k] in known for rest in every(s[k:])] if s else [()]

    weight = {s: math.exp(sum(lat.log_w[known[p]] for p in s)) for s in every("▁there")}
    total, draws = sum(weight.values()), 20000
    ids, n = piece_sampling.sample_rows(lat, ["there"] * draws, piece_sampling._seeds(np.arange(draws, dtype=np.int64), 3))
    at, seen = 0, collections.Counter()
    for k in n:
        seen[tuple(lat.vocab.model.id_to_piece(int(i)) for i in ids[at : at + k])] += 1
        at += k
    for s, w in weight.items():
        assert abs(seen[s] / draws - w / total) < 5 * math.sqrt(w / total / draws) + 1e-3


def test_cache_keeps_what_is_used_most_and_changes_no_sample(vocab):
    r = random.Random(9)
    words = ["the", "of", "and"] + ["".join(r.choices("abcdeé日▁", k=r.randint(1, 20))) for _ in range(3000)]
    texts = [" ".join(r.choice(words[:3]) if r.random() < 0.5 else r.choice(words) for _ in range(40)) for _ in range(400)]
    seeds = piece_sampling._seeds(np.arange(400, dtype=np.int64), 2)
    free, tight = piece_sampling.Lattice(vocab, 1.0), piece_sampling.Lattice(vocab, 1.0)
    tight.segments.MOST_BYTES = 60_000
    want = piece_sampling.sample_rows(free, texts, seeds)
    for i in range(0, 400, 20):
        ids, n = piece_sampling.sample_rows(tight, texts[i : i + 20], seeds[i : i + 20])
        at = int(want[1][:i].sum())
        assert np.array_equal(n, want[1][i : i + 20]) and np.array_equal(ids, want[0][at : at + len(ids)])
        assert piece_sampling.decode_rows(vocab, ids, n) == [t.encode() for t in texts[i : i + 20]]
    tight.segments.shrink(30_000)
    assert 0 < len(tight.segments.base) < len(free.segments.base)


def test_long_segments_are_filtered_like_short_ones(lat):
    text = "internationalisation" * 8  # longer than LONG
    ids, n = piece_sampling.sample_rows(lat, [text] * 50, piece_sampling._seeds(np.arange(50, dtype=np.int64), 1))
    assert set(piece_sampling.decode_rows(lat.vocab, ids, n)) == {text.encode()}
    assert n.mean() < 80  # likely pieces, not single letters


def test_rows_encode_and_decode(spark):
    texts = [None, "", "some words", "some words", "Größe ▁ x\n", "word " * 3000]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], DOCS)
    out = piece_sampling.encode_documents(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.lossless and len(r.ids) == r.n_pieces for r in rows.values()) and rows[0].n_pieces == 0
    back = {r.doc_id: r.text for r in piece_sampling.decode_documents(out).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert {k: r.text_crc32 for k, r in rows.items()} == {k: zlib.crc32((t or "").encode()) for k, t in enumerate(texts)}
    again = {r.doc_id: r.ids for r in piece_sampling.encode_documents(docs.repartition(3)).collect()}
    assert again == {k: r.ids for k, r in rows.items()}
    other = {r.doc_id: r.ids for r in piece_sampling.encode_documents(docs, seed=1).collect()}
    assert other[5] != rows[5].ids
    assert piece_sampling.encode_documents(docs.limit(0)).count() == 0
