"""What the token output does once is not done again."""

import numpy as np

from corpusloom.llm import token_output
from corpusloom.llm.queries import vocabulary


def test_pairs_that_became_rare_are_not_counted_again(monkeypatch):
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, 60_000), 5_000).astype(np.uint16)
    seen, frequent = [], token_output.frequent
    monkeypatch.setattr(token_output, "frequent", lambda pair, *more: seen.append(len(pair)) or frequent(pair, *more))
    seq, rules = token_output.compress(ids, 5_001)
    assert (token_output.expand(seq, token_output.table(rules, token_output.expansion_lengths(rules, 5_001), 5_001)) == ids).all()
    assert len(seen) > 3 and seen[-1] < len(seq) / 2


def test_no_pair_with_enough_places_is_left(monkeypatch):
    """Looking at fewer places finds all pairs: what is left has none that is replaceable."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 300, 4_000):
        ids = np.repeat(rng.integers(0, 9, n), rng.integers(1, 7, n)).astype(np.uint16)
        seq, _ = token_output.compress(ids, 9)
        closed = np.zeros(1 << 17, bool)
        closed[token_output.END] = True
        pair, places = seq[:-1] << np.uint32(16) | seq[1:], np.arange(len(seq) - 1)
        left, _ = token_output.frequent(pair, places, np.arange(1, len(seq) + 1), 16, closed, 100)
        ends = {token_output.END} | {x for x in seq.tolist() if x >= 9}  # symbols of rules may end a document
        assert all(x >> 16 in ends for x in left.tolist())


def test_a_worker_keeps_its_cache(monkeypatch):
    path, asked = vocabulary("byte_bpe_50k.json"), []
    token_output._caches.clear()
    cache = token_output._cache(path, 1_000)
    encode = cache.encode
    monkeypatch.setattr(cache, "encode", lambda words: asked.append(sorted(words)) or encode(words))
    for _ in range(2):
        list(token_output.encode_texts(["the quick, brown fox", "the quick fox"], path, 1_000))
    assert asked == [["brown", "fox", "quick"]] and token_output._cache(path, 2_000) is not cache
    token_output._caches.clear()
