"""The encoder of token files against the tokenizers library, and what coding and reading of files cost."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from snipdex.llm import range_coder, token_files
from tests.llm.cases import documents, odd_texts, words
from tests.llm.test_tokens import random_texts

FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)


@pytest.fixture
def encoder():
    return token_files.LibraryEncoder(open(FILE, encoding="utf-8").read())


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check(encoder, texts):
    ids, counts = encoder.encode_all(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [library_ids(t) for t in texts]
    assert counts.sum() == len(ids)


def test_encoder_gives_the_librarys_ids(encoder):
    for seed in range(3):
        texts = random_texts(2000) + [None, "", " ", "a　b", "x\x1cy z", "é Ét", "한", "\U0001d400b 1a", "İ ΣΑΣ", "don't <|endoftext|>a"]
        random.Random(seed).shuffle(texts)
        check(encoder, texts)
    check(encoder, [None])
    check(encoder, [])


def test_every_character_that_acts_alone(encoder):
    codes = np.flatnonzero(encoder.kinds > token_files.BLANK)
    check(encoder, [" ".join(f"a{chr(c)}B {chr(c)}{chr(c)}7{chr(c)}" for c in codes[i : i + 500]) for i in range(0, len(codes), 500)])


def test_other_tokenizers_get_pieces_as_they_are():
    lean = Tokenizer.from_file(FILE)
    lean.normalizer = None
    encoder = token_files.LibraryEncoder(lean.to_str())
    texts = ["The the, THE.", "Ünï 12ab", None]
    ids, counts = encoder.encode_all(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [lean.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_the_library_is_asked_once_for_each_word(encoder):
    asked = []

    class Counting:
        def tokenize(self, word, model=encoder.model):
            asked.append(word)
            return model.tokenize(word)

    encoder.model = Counting()
    for _ in range(2):
        check(encoder, ["The the THE, the. (the) the!", "Été été, ÉTÉ. the"])
    assert len(asked) == len(set(asked)) and sum(w == "the" for w in asked) == 1


def test_words_that_come_again_are_kept(encoder, monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 400)
    for seed in range(12):
        check(encoder, [words(1, 40), words(100 + seed, 150)])
        assert len(encoder.known) < 600
    assert all(f" {w}" in encoder.known for w in words(1, 40).split())


def test_a_long_text_is_encoded_in_parts(encoder, monkeypatch):
    monkeypatch.setattr(token_files, "SLICE_BYTES", 1000)
    for text in (words(5, 3000), "x" * 5000, "a\n" * 4000, "é don't " * 900):
        check(encoder, [text])


def test_tables_follow_the_ids_of_a_block():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 50, 2000).astype(np.uint32) * 80_000 for _ in range(40)]
    coded = range_coder.encode_blocks(blocks, 4_000_000)
    model = range_coder._Model(np.array([len(np.unique(b)) for b in blocks]))
    assert len(model.counts) <= 51 * len(blocks)  # not the 4,000,000 ids of the vocabulary
    assert all((a == b).all() for a, b in zip(range_coder.decode_blocks(coded), blocks))
    with pytest.raises(ValueError):
        range_coder.encode_blocks(blocks, 80_000)


def test_every_damaged_byte_of_a_block_is_found():
    block = range_coder.encode_blocks([np.arange(300, dtype=np.uint32) * 7 % 90 * 200], 30_000)[0]
    for at in range(len(block) - 8):  # the last units hold less than they could
        with pytest.raises(ValueError):
            range_coder.decode_blocks([block[:at] + bytes([block[at] ^ 0x41]) + block[at + 1 :]])


def test_carries_reach_what_is_written():
    rng = np.random.default_rng(2)
    blocks = [(rng.random(2500) ** 8 * 2000).astype(np.uint32) for _ in range(300)]
    assert all((a == b).all() for a, b in zip(range_coder.decode_blocks(range_coder.encode_blocks(blocks, 2000)), blocks))


def test_rows_have_whole_documents_and_reading_moves_nothing(spark, tmp_path, monkeypatch):
    for name, value in (("BLOCK", 64), ("ROW", 256), ("GROUP", 6), ("SLICE_BYTES", 3000)):
        monkeypatch.setattr(token_files, name, value)
    texts = odd_texts() + [(100 + i, words(i, i % 90)) for i in range(200)]
    path = str(tmp_path / "ids")
    token_files.write_tokens(documents(spark, texts), path, FILE)
    assert spark.read.parquet(path).count() > 50
    found = token_files.read_tokens(spark, path)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort" not in plan
    at = 0
    rows = sorted(found.collect(), key=lambda r: r.start)
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
    want = sorted((str(k), zlib.crc32(np.array(library_ids(t) + [1], "<u4").tobytes())) for k, t in texts)
    assert sorted((str(r.doc_id), zlib.crc32(bytes(r.ids))) for r in rows) == want
    keys = [r.doc_id for r in rows if r.doc_id is not None]
    assert keys == sorted(keys)
