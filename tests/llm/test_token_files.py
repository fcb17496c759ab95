"""Token-id files: what coding costs an id, damaged blocks, and texts encoded by words that Arrow finds."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marketlens.llm import chunks, range_coder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slowness():
    """Times the usual time that this machine takes for a plain loop."""

    def loop():
        began = time.process_time()
        sum(range(50_000))
        return (time.process_time() - began) * 1000 / 1.2

    return max(1, sorted(loop() for _ in range(31))[15])


def test_coding_takes_little_time_an_id():
    """Before, these ids took 3.2 microseconds each to code and 4.7 to decode, on a machine 1.3 times slower than usual."""
    r = np.random.default_rng(2)
    ids = np.minimum(r.zipf(1.3, 1 << 19), 50_000)
    before = slowness()
    began = time.process_time()
    blocks = range_coder.encode_blocks(ids, bound=range_coder.bound_of(ids))
    assert (range_coder.decode_blocks(blocks, range_coder.bound_of(ids)) == ids).all()
    spent = time.process_time() - began
    assert spent / len(ids) * 1e6 < 1.2 * max(before, slowness())


def test_blocks_of_any_ids_come_back():
    r = np.random.default_rng(3)
    for n in (1, 2, 1024, 1025, 7000):
        for ids in (np.zeros(n, int), np.full(n, 65_535), r.integers(0, 65_536, n), np.where(r.random(n) < 0.98, 7, r.integers(0, 4000, n)), np.arange(n) % 3):
            bound = range_coder.bound_of(ids)
            for block in (range_coder.BLOCK, 5000):
                blocks = range_coder.encode_blocks(ids, block, bound)
                assert sum(b[0] for b in blocks) == n
                assert (range_coder.decode_blocks(blocks, bound) == ids).all()


def test_each_block_stands_alone():
    ids = np.random.default_rng(4).integers(0, 9000, 20_000)
    blocks = range_coder.encode_blocks(ids, 4000, 12_288)
    assert len(blocks) == 5
    for k, part in enumerate(np.split(ids, 5)):
        assert (range_coder.decode_blocks([blocks[k]], 12_288) == part).all()


def test_damage_is_an_error():
    r = np.random.default_rng(5)
    ids = np.minimum(r.zipf(1.2, 9000), 40_000)
    data = range_coder.write_frame([1, 2], [4000, 5000], ids, 0)
    for at in [*range(44, 100, 3), *r.integers(100, len(data), 40).tolist()]:
        broken = data[:at] + bytes([data[at] ^ int(r.integers(1, 256))]) + data[at + 1 :]
        try:
            docs, lengths, got, _ = range_coder.read_frame(broken)
        except ValueError:
            continue
        assert at < 60 and (got == ids).all()  # a document's id, which no checksum covers


def test_ended_texts_are_the_librarys():
    rng = random.Random(6)
    pool = ["the", "Of", "stone", "cloud,", "(river)", "'s", "don't", "été", "Straße!", "日本語", "🎈", "123", "a1b", "12,", "...", "-", "été.", "x" * 1200, "įsakyti;", "<|endoftext|>", "İstanbul", "mail@example.com,", '"quoted"']
    spaces = [" "] * 30 + ["\n"] * 4 + ["  ", "\n\n", "\t", " \n", "\r\n", " ", " "]
    even = [" ".join(rng.choice(pool[:-1]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    mixed = ["".join(rng.choice(pool) + rng.choice(spaces) for _ in range(rng.randint(1, 12))).rstrip(" ") for _ in range(200)]
    texts = [None, "", " ", "\n", "one", "\rone", "a\nb", *even, *mixed, *(t.replace(" ", "\n", 1) for t in even)]
    whole = Tokenizer.from_file(PATH)
    expected = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for size in (1_000_000, 5):
        encoder = chunks.EndedTexts(PATH, 2, size)
        for _ in range(2):
            assert [x.tolist() for x in encoder.encode(pa.array(texts, pa.string()))] == expected
        halves = [encoder.encode(pa.array(texts, pa.string()).slice(a, 100)) for a in range(0, len(texts), 100)]
        assert [x.tolist() for half in halves for x in half] == expected
    assert encoder.encode(pa.array([], pa.string())) == []


def test_words_are_encoded_once_a_worker(monkeypatch):
    """Before, each task of a worker encoded all of its words anew."""
    encoder = range_coder._encoder(PATH, 2)
    texts = pa.array(["brulvik stomelan, grantiz\nbrulvik. stomelan", "grantiz brulvik"], pa.string())
    first = [x.tolist() for x in encoder.encode(texts)]
    assert encoder is range_coder._encoder(PATH, 2)
    monkeypatch.setattr(encoder.encoder, "words", lambda words: pytest.fail("encoded again"))
    monkeypatch.setattr(encoder, "_others", lambda words: pytest.fail("encoded again"))
    assert [x.tolist() for x in encoder.encode(texts)] == first
