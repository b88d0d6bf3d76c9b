"""Token ids, counts and files against the tokenizers library."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from snipdex.llm import bpe, token_counts, token_files
from snipdex.llm.range_coder import decode_blocks, encode_blocks
from tests.llm.cases import documents, odd_texts

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
WORD_LIBRARY, BYTE_LIBRARY = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
ALPHABET = list("aabetheions THE \n\n  \t'''srevldm!?.,<|>0123é ßΣσİ½́ \x1c\x85　日本​ñ") + ["<|endoftext|>", "<|startoftext|>", " 're", "'ll", "J̌"]


def random_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["ab" * 3000, "é" * 300, " " * 500, "\n" * 300 + "a"]


def library_ids(text):
    return WORD_LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_librarys_ids():
    encoder = bpe.WordEncoder(open(WORD, encoding="utf-8").read())
    for text in random_texts(4000):
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library_ids(text), repr(text)


def test_long_and_short_words_are_merged_alike():
    table = bpe.MergeTable(open(WORD, encoding="utf-8").read())
    for seed in range(200):
        rng = random.Random(seed)
        parts = [table.first[ord(rng.choice("aetinhe"))] for _ in range(40)]
        assert table._merge_short(list(parts)) == table._merge_long(list(parts))


def test_encoder_remembers_a_bounded_number_of_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "RECENT_PIECES", 300, raising=False)
    encoder = bpe.WordEncoder(open(WORD, encoding="utf-8").read())
    for i in range(2000):
        text = f"often n{i}x often" + " again" * (i % 250 == 0)
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library_ids(text)
        assert len(encoder.known) + len(getattr(encoder, "older", ())) <= 600
    assert "often" in encoder.known or "often" in encoder.older  # frequent pieces are not given up


def test_only_a_slice_of_a_batch_is_made_into_texts():
    texts = ["", None, "x" * 9_000_000, *(f"{i} " + "y" * 50_000 for i in range(600)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"]).slice(1)
    seen = 0
    tracemalloc.start()
    for keys, some in bpe.text_slices(batch):
        assert keys.to_pylist() == list(range(seen + 1, seen + 1 + len(some)))
        assert some == [t or "" for t in texts[seen + 1 : seen + 1 + len(some)]]
        seen += len(some)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(texts) - 1
    assert most < 20_000_000  # the longest text and a slice, of 39 MB


def test_joined_tokens_of_odd_lists():
    strings = bpe.token_strings(WORD)
    lists = [[5, 6], None, [], [320] * 40, [WORD_LIBRARY.get_vocab_size() - 1], library_ids("a plain text"), [7]]
    array = pa.array(lists, pa.list_(pa.int32()))
    want = [None if x is None else WORD_LIBRARY.decode(x, skip_special_tokens=False) for x in lists]
    assert bpe.joined(array, strings).to_pylist() == want
    assert bpe.joined(array.slice(1, 4), strings).to_pylist() == want[1:5]
    assert bpe.joined(array.slice(0, 0), strings).to_pylist() == []
    for bad in ([None], [len(strings)], [-1]):
        with pytest.raises((ValueError, IndexError)):
            bpe.joined(pa.array([[5], bad], pa.list_(pa.int32())), strings)


def test_slices_have_bounded_sizes():
    sizes = np.array([0, 3, 4, 0, 50, 0, 0, 10, 1, 9])
    found = list(bpe.slices(sizes, 10))
    assert [i for first, last in found for i in range(first, last)] == list(range(10))
    assert all(sizes[first:last].sum() <= 10 or last == first + 1 for first, last in found)
    assert list(bpe.slices(np.zeros(0, np.int64), 10)) == []


def test_prefix_counts_at_every_prefix():
    counter = token_counts.PrefixCounter(open(BYTE, encoding="utf-8").read())
    for text in random_texts(400)[:400]:
        want = [len(BYTE_LIBRARY.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefixes(text) == want, repr(text)
        assert counter.count(text) == want[-1]


def test_encode_decode_of_odd_rows(spark):
    rows = bpe.digests(bpe.decode(bpe.encode(documents(spark, odd_texts()), WORD), WORD)).collect()
    want = []
    for key, text in odd_texts():
        ids = library_ids(text)
        decoded = WORD_LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_counts_and_truncation_of_odd_rows(spark):
    docs = documents(spark, odd_texts())
    rows = token_counts.token_counts(docs, BYTE).collect()
    want = [(k, len((t or "").encode()), len(BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids)) for k, t in odd_texts()]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    for r in token_counts.truncate(docs.filter("doc_id in (1, 9, 12)"), BYTE, 5).collect():
        text = dict(odd_texts())[r.doc_id]
        counts = [len(BYTE_LIBRARY.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        end = max(i for i, c in enumerate(counts) if c <= 5)
        assert (r.kept, r.n_tokens) == (text[:end], counts[end])


def test_files_round_trip(spark, tmp_path):
    token_files.write_tokens(documents(spark, odd_texts()), str(tmp_path / "ids"), WORD)
    rows = token_files.read_tokens(spark, str(tmp_path / "ids")).collect()
    got = sorted((r.start, r.doc_id, zlib.crc32(bytes(r.ids)), len(r.ids) // 4) for r in rows)
    at = 0
    for start, key, crc, n in got:
        assert start == at
        at += n
    ids = [library_ids(t) + [1] for _, t in odd_texts()]
    assert sorted(((k, c) for _, k, c, _ in got), key=str) == sorted(((k, zlib.crc32(np.array(i, "<u4").tobytes())) for (k, _), i in zip(odd_texts(), ids)), key=str)
    keys = [k for _, k, _, _ in got if k is not None]
    assert keys == sorted(keys)


@pytest.mark.parametrize("seed", range(3))
def test_coder_round_trip(seed):
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(0, rng.integers(1, 3000), rng.integers(0, 2000)).astype(np.uint32) for _ in range(20)]
    blocks += [np.zeros(0, np.uint32), np.full(2400, 2999, np.uint32), np.tile(np.arange(7, dtype=np.uint32), 340)]
    coded = encode_blocks(blocks, 3000)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(decode_blocks(coded), blocks))
    assert len(coded[-1]) < 400  # a repeated pattern costs next to nothing
    assert [decode_blocks([c])[0].tolist() for c in coded[:3]] == [b.tolist() for b in blocks[:3]]


def test_damaged_blocks_are_found():
    block = encode_blocks([np.arange(1000, dtype=np.uint32) % 17], 3000)[0]
    for bad in (b"", block[:-2], b"XXXX" + block[4:], block[:40] + bytes([block[40] ^ 1]) + block[41:]):
        with pytest.raises(ValueError):
            decode_blocks([bad])


def test_empty_tables(spark, tmp_path):
    none = documents(spark, [])
    assert bpe.decode(bpe.encode(none, WORD), WORD).count() == 0
    assert token_counts.token_counts(none, BYTE).count() == 0
    token_files.write_tokens(none, str(tmp_path / "ids"), WORD)
    assert token_files.read_tokens(spark, str(tmp_path / "ids")).count() == 0
