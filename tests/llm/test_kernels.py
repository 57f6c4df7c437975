import random

import numpy as np
import pytest

from fusilade.llm import bpe, jaccard, suffix


def test_binary_ids_are_the_librarys(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_MASK", 7)
    monkeypatch.setattr(bpe, "WORD_CACHE", 40)
    e, rng = bpe.Encoder(bpe.default_path(), binary=True), random.Random(3)
    parts = ["a", "'s", " ", "  ", "\n", "é", "1", "...", "日本", "😀", "<|endoftext|>", "<|endof", "word", " The", "x" * 80]
    for k in range(600):
        raw = "".join(rng.choice(parts) for _ in range(rng.randrange(150) if k else 0)).encode()
        data = np.frombuffer(raw, np.uint8)
        pieces = [raw[p:q] for p, q in bpe.borders(data, np.array([0, len(data)]))[0]]
        e.prepare(pieces)
        assert np.frombuffer(e.encode(pieces), np.int32).tolist() == e.tok.encode(raw.decode(), add_special_tokens=False).ids


@pytest.mark.parametrize("width", [1, 15, 20, 50])
def test_hashes_of_ranges_share_their_sums(width):
    data = np.random.default_rng(1).integers(97, 100, 3000).astype(np.uint8)
    sums = jaccard.span_sums(data)
    h = jaccard.width_hashes(data, width, sums)
    at = np.arange(len(h))
    raw = data.tobytes()
    assert len(h) == len(data) - width + 1 and len(set(h.tolist())) == len({raw[i : i + width] for i in at})
    assert np.array_equal(jaccard.span_hashes(data, at, at + width, sums), jaccard.span_hashes(data, at, at + width))
    assert len(jaccard.width_hashes(data[: width - 1], width, jaccard.span_sums(data[: width - 1]))) == 0


def test_anchors_hash_a_text_in_one_pass(monkeypatch):
    calls, one = [], jaccard.span_sums
    monkeypatch.setattr(suffix, "span_sums", lambda data: calls.append(len(data)) or one(data))
    monkeypatch.setattr(jaccard, "span_sums", None)
    text = b"the same passage of more than fifty bytes stands in both of these two rows, here"
    data = np.frombuffer(b"row a " + text + b" other row " + text, np.uint8)
    k, block, row, at, n, sides = suffix.anchors(data, np.array([0, 6 + len(text), len(data)]))
    assert calls == [len(data)] and set(row.tolist()) == {0, 1} and len(k) == len(block) == len(at) == len(n) == len(sides)
    both = set(k[row == 0].tolist()) & set(k[row == 1].tolist())
    assert both and set(sides[(row == 0) & np.isin(k, list(both))].ravel().tolist()) & set(sides[(row == 1) & np.isin(k, list(both))].ravel().tolist()) - {0}
