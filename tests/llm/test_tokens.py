import base64
import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import bpe, pieces, simple8b, wordbpe
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import buffers, passes

BYTE, WORD = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("word_bpe_49k.json")
bits = st.lists(st.sampled_from(["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "é", "ª", "1", "²", "!", "漢", "́", "😀", "　", "\r\n", "\x1c", "\x85", "'ll", "the", "I", "<|endoftext|>"]), max_size=16).map("".join)


def split(made):
    """Lists of ids from all of them and offsets."""
    ids, at = made
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


@pytest.fixture(scope="module")
def tiktoken_own():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def word_own():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(bits, st.text(max_size=20)), min_size=1, max_size=6))
def test_bpe_is_the_library_s(tiktoken_own, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = split(bpe.codec(BYTE).encode(*buffers(pa.array(texts))))
    assert got == [tiktoken_own.encode_ordinary(t) for t in texts]
    for t, ids in zip(texts, got, strict=True):
        back, at = bpe.codec(BYTE).decode(np.array(ids, np.int64))
        assert back.tobytes()[: at[-1]] == t.encode() and len(at) == len(ids) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(bits, st.text(max_size=20)), min_size=1, max_size=6))
def test_pieces_of_words_are_the_library_s(word_own, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = split(wordbpe.words(WORD, 1).encode(*buffers(pa.array(texts))))
    assert got == [[*e.ids, 1] for e in word_own.encode_batch(texts, add_special_tokens=False)]


def test_pieces_of_no_end_or_two_keep_their_ids_in_a_fresh_cache(word_own):
    own = wordbpe.words(WORD, 1)
    for gap in "\t", "\r", "\xa0", "\u3000":
        for text in f"a {gap} œuf, b", f"b œuf, {gap} a", f"{gap} “a b, c” œuf", f"œ word, {gap} Été x":
            own.known.clear()
            assert split(own.encode(*buffers(pa.array([text])))) == [[*word_own.encode(text, add_special_tokens=False).ids, 1]]
    for order in itertools.permutations(["a", "\t", "œuf,", "b", "word,", "\u3000"]):
        found = own.learn([p.encode() for p in order])
        assert all(np.frombuffer(x, "<u4").tolist() == word_own.encode(p, add_special_tokens=False).ids for p, x in zip(order, found, strict=True))


def test_pieces_end_at_apostrophes_digits_rows_and_foreign_words(word_own):
    texts = ["it's", "IT'S 'ROUND 'rest 'll''ll", "'", "s", "a'", "'re", "don''t 12'3", "×'s ÷", "Ünï'Ve", "a\tb\x0bc", "x\xa0y z", "<|endoftext|>'s", "a<|b", "<", "|", "e\u0301 é", "", "naïve “quote's” 漢字's"]
    assert split(wordbpe.words(WORD, 1).encode(*buffers(pa.array(texts)))) == [[*e.ids, 1] for e in word_own.encode_batch(texts, add_special_tokens=False)]


def test_a_worker_forgets_all_at_its_limits(monkeypatch, word_own, tiktoken_own):
    monkeypatch.setattr(pieces, "PIECES", 40)
    monkeypatch.setattr(pieces, "ROOM", 300)
    r = np.random.RandomState(0)
    for _ in range(12):
        texts = [" ".join("".join(r.choice(list("abcde'1"), r.randint(1, 9))) for _ in range(20)) for _ in range(3)]
        assert split(wordbpe.words(WORD, 1).encode(*buffers(pa.array(texts)))) == [[*e.ids, 1] for e in word_own.encode_batch(texts, add_special_tokens=False)]
        assert split(bpe.codec(BYTE).encode(*buffers(pa.array(texts)))) == [tiktoken_own.encode_ordinary(t) for t in texts]


def test_bytes_that_are_no_utf8_count_as_replacement_characters(spark, tiktoken_own):
    df = spark.sql("select 1L doc_id, cast(x'61ff6220c3' as string) text union all select 2L, 'fine'")
    got = {r.doc_id: r for r in bpe.round_trip(df, BYTE).collect()}
    assert got[1].n_tokens == len(tiktoken_own.encode_ordinary("a\ufffdb \ufffd")) and got[2].decoded_sha256 == hashlib.sha256(b"fine").hexdigest()
    assert simple8b.token_files(df, WORD).count() == 2


def test_round_trip_of_hard_rows(hard, empty, tiktoken_own):
    rows = hard.collect()
    got = bpe.round_trip(hard, BYTE).collect()
    assert len(got) == len(rows)
    want = sorted((str(r.doc_id), len(i := tiktoken_own.encode_ordinary(r.text or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.round_trip(empty, BYTE).collect() == []


def test_passes_cut_no_row():
    off = np.array([0, 0, 5, 5, 100, 101, 101])
    assert list(passes(off, 10)) == [(0, 3), (3, 4), (4, 6)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 12))
def test_simple8b_round_trip(values, times):
    v = np.array(values * times, np.uint64)
    words, starts = simple8b.encode(v)
    assert (simple8b.decode(words, starts, len(v)) == v).all()
    if len(v):  # a block alone
        b = len(starts) - 2
        own = simple8b.decode(words[starts[b] : starts[b + 1]], np.array([0, starts[b + 1] - starts[b]]), len(v) - b * simple8b.BLOCK)
        assert (own == v[b * simple8b.BLOCK :]).all()


def test_small_values_share_words():
    words, _ = simple8b.encode(np.ones(960, np.uint64))
    assert len(words) == 16


def test_files_hold_the_library_s_ids_in_order(spark, small, word_own):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    got = sorted(simple8b.token_files(docs, WORD).collect())
    at = 0
    for row, d in zip(got, sorted(docs.select("doc_id", "text").collect()), strict=True):
        ids = np.array([*word_own.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert tuple(row) == (d.doc_id, at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_files_of_hard_rows(hard, empty, word_own):
    got = simple8b.token_files(hard, WORD).collect()
    assert len(got) == hard.count()
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert sorted((r.start, r.doc_id) for r in got)[0] == (0, None)
    assert simple8b.token_files(empty, WORD).collect() == []
