"""Re-Pair goes on until no pair is left or the symbols are used up."""

from collections import Counter

import numpy as np

from corpusloom.llm import token_output


def open_pairs(seq, rules, vocab):
    """Pairs with LEAST_USES places or more that do not overlap and whose left symbol does not end a document."""
    ends, last, places = {token_output.END}, {}, Counter()
    for k, (_, right) in enumerate(rules.tolist()):
        if right in ends:
            ends.add(vocab + k)
    for i, p in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist())):
        if last.get(p) != i - 1 or p[0] != p[1]:
            places[p], last[p] = places[p] + 1, i
        else:
            last[p] = -2
    return [p for p, n in places.items() if n >= token_output.LEAST_USES and p[0] not in ends]


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(1)
    passage = rng.integers(3, 280, 300)
    for vocab in (300, 70_000):
        docs = [np.concatenate([rng.integers(3, 280, 40), passage, np.full(rng.integers(1, 70), 9), [2]]) for _ in range(40)]
        ids = np.concatenate(docs).astype(np.uint32)
        seq, rules = token_output.compress(ids, vocab)
        assert open_pairs(ids, rules[:0], vocab) and not open_pairs(seq, rules, vocab)
        symbols = token_output.table(rules, token_output.expansion_lengths(rules, vocab), vocab)
        assert (token_output.expand(seq, symbols) == ids).all()
        assert len(rules) >= 299  # the passage is one symbol


def test_symbols_are_used_up():
    ids = np.tile(np.random.default_rng(2).integers(3, 65_000, 3000), 4).astype(np.uint32)
    seq, rules = token_output.compress(ids, 65_500)
    assert len(rules) == 35 and len(seq) == len(ids) - 4 * 35
