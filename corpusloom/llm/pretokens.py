"""Pre-tokens of the word tokenizer, and caches of what pre-tokens encode to.

A pre-token is encoded the same alone as within its text. The pattern below
is the tokenizer's own, with its letter and number classes written out for
ASCII, Latin below U+0250, Greek (without capital sigma, whose small form
depends on its place), Cyrillic, kana, CJK and Hangul, and common punctuation
and symbols allowed (fixed values). A text with any other character, or with
the opening of a special token, goes to the library whole.
"""

from __future__ import annotations

import re

import numpy as np

_OTHER_LETTERS = "\u0391-\u03a1\u03a4-\u03a9\u03b1-\u03c9\u0400-\u0481\u048a-\u04ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_L = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ" + _OTHER_LETTERS
#: Dashes, quotes, ellipsis, per mille, currencies, arrows, CJK full stops and brackets, dingbats, emoji of the first blocks.
_MARKS = "\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u21ff\u3001-\u3003\u3008-\u3011\u2600-\u26ff\U0001f300-\U0001f5ff\U0001f600-\U0001f64f"
_N = "0-9²³¹¼-¾"
_S = " \t\n\r"
PLAIN = re.compile(f"[{_S}\\x21-\\x7e¡-įı-ɏ{_OTHER_LETTERS}{_MARKS}]*").fullmatch
WORD_BPE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+").findall
SPECIAL = "<|"


def plain(text: str) -> bool:
    return SPECIAL not in text and PLAIN(text) is not None


_tokenizers: dict = {}


def tokenizer(path: str):
    """The library's tokenizer, loaded once in a worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = _tokenizers[path] = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
    return _tokenizers[path]


def split_ids(t, tokens: list[str], ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """cuts, tokens (perhaps in another order): pre-token i has the ids from cuts[i] to cuts[i + 1].

    Pre-tokens of letters alone are encoded as one text and told apart by ids
    that can only end a pre-token.
    """
    words = [x for x in tokens if x.isalpha()]
    ids = np.array(t.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
    cuts = np.append(0, np.flatnonzero(ends[ids]) + 1)
    if len(cuts) != len(words) + 1:
        words, cuts = [], np.zeros(1, np.int64)
    told = set(words)
    rest = [x for x in tokens if x not in told]
    more = [len(t.encode(x, add_special_tokens=False)) for x in rest]
    return np.append(cuts, cuts[-1] + np.cumsum(more, dtype=np.int64)), words + rest


def marked(t, test) -> np.ndarray:
    """Which ids' strings pass the test."""
    out = np.zeros(t.get_vocab_size(), bool)
    for x, i in t.get_vocab().items():
        out[i] = test(x)
    return out


class Cache:
    """What pre-tokens encode to, kept in a worker: a frequent tier that stays, and two generations of others, of which the older goes when the younger is full."""

    def __init__(self, encode, kept=(), most: int = 400_000) -> None:
        self.encode, self.kept, self.most, self.old = encode, dict(kept), most, {}
        self.young = dict(self.kept)

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, dict(self.kept)

    def values(self, tokens: list[str]) -> list:
        """Values of the tokens, all different, in their order; what is not kept any more is encoded together."""
        self.turn()
        out = list(map(self.young.get, tokens))
        missing = [i for i, x in enumerate(out) if x is None]
        names = [tokens[i] for i in missing]
        back = list(map(self.old.get, names))
        found = self.encode(new) if (new := [x for x, value in zip(names, back) if value is None]) else {}
        self.young.update(found)
        for i, x, value in zip(missing, names, back):
            if value is None:
                out[i] = found[x]
            else:
                out[i] = self.young[x] = value
        return out

    def table(self, tokens: set[str]) -> dict:
        """Values of all the tokens, and of others; what is not kept any more is encoded together."""
        self.turn()
        missing = tokens.difference(self.young)
        back = missing.intersection(self.old)
        self.young.update(zip(back, map(self.old.__getitem__, back)))
        if new := list(missing.difference(back)):
            self.young.update(self.encode(new))
        return self.young


def blocks(texts: list[str], chars: int = 1 << 21):
    """Slices of the list of about so many characters."""
    lo = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
