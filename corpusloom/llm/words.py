"""Words and word n-gram hashes of whole Arrow text columns, vectorised with numpy.

A text column is cut into chunks of whole documents of about ``CHUNK_BYTES``
so that the working arrays stay small whatever the batch holds. A document
longer than two of them comes in pieces, each a chunk; a piece shows, after its
own words, as many of the next piece's as grams that begin in it may reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BLOCK = 2 * CHUNK_BYTES
U = np.uint64
_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}

#: Byte classes: 0 separates words, equal non-zero classes stay together.
SPACED = np.ones(256, np.uint8)
SPACED[[0x20, *range(0x09, 0x0E)]] = 0
ALNUM = np.zeros(256, np.uint8)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: Like ALNUM, and runs of other visible characters are words of their own.
MIXED = np.where(ALNUM == 1, 1, np.where(SPACED == 1, 2, 0)).astype(np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables up to a chunk's length are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), U(base))
        have[0] = U(1)
        have = np.cumprod(have)
        if len(have) <= _BLOCK + 1:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Chunk:
    """Words of documents ``lo:hi`` of a batch, or of a piece of document lo; word i is ``data[starts[i]:ends[i]]``."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word, and the number of words at its end
    base: int = 0  # words of the document before this piece
    mine: int = -1  # words from here on belong to the next piece
    final: bool = True  # whether no piece of the document follows

    def __post_init__(self) -> None:
        self.mine = len(self.starts) if self.mine < 0 else self.mine
        self.doc = np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))
        self.pos = np.arange(len(self.starts)) - self.first[self.doc] + self.base
        self.left = self.first[self.doc + 1] - np.arange(len(self.starts))  # words from here to the end of what is shown of the document

    @property
    def whole(self) -> bool:
        """Whether the chunk holds whole documents."""
        return self.final and not self.base

    def begins(self, n: int) -> np.ndarray:
        """The own words from which n words of one document go on."""
        return np.flatnonzero(self.left[: self.mine] >= n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        at = np.concatenate([self.starts, self.ends])
        found, carry, scale = np.zeros(len(at), U), 0, 1
        for lo in range(0, len(self.data), _BLOCK):
            part = self.data[lo : lo + _BLOCK]
            total = np.zeros(len(part) + 1, U)
            np.cumsum((part.astype(U) + U(1)) * powers(_BYTE_BASE, len(part)), out=total[1:])
            if len(part) == len(self.data):
                found = total[at]
                break
            here = np.flatnonzero((at >= lo) & (at <= lo + len(part)))
            found[here] = total[at[here] - lo] * np.full(1, scale, U) + np.full(1, carry, U)
            carry = (carry + scale * int(total[-1])) & _MASK
            scale = scale * pow(_BYTE_BASE, len(part), 1 << 64) & _MASK
        back = pow(_BYTE_BASE, -1, 1 << 64)
        n, far = len(self.starts), int(self.starts[-1]) // _BLOCK if len(self.starts) else 0
        out = (found[n:] - found[:n]) * powers(back, min(len(self.data), _BLOCK) + 1)[self.starts % _BLOCK]
        return mix(out * powers(pow(back, _BLOCK, 1 << 64), far + 1)[self.starts // _BLOCK] if far else out)

    def text(self, i: int, n: int) -> bytes:
        """Words i .. i+n-1 joined by a space."""
        raw = self.data.data
        return b" ".join(bytes(raw[a:b]) for a, b in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist()))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words from each position; the caller masks those that cross documents or the end (0)."""
    out = np.zeros(len(h), U)
    if len(h) >= n:
        total = np.zeros(len(h) + 1, U)
        np.cumsum(h * powers(_WORD_BASE, len(h)), out=total[1:])
        m = len(h) - n + 1
        out[:m] = mix((total[n:] - total[:m]) * powers(pow(_WORD_BASE, -1, 1 << 64), m) + U(n))
    return out


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as strings without nulls (null counts as empty)."""
    return batch.column(name).cast(pa.string()).fill_null("")


def _runs(raw: np.ndarray, classes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; edges always part them."""
    kind = classes[raw]
    new = np.ones(len(raw), bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[edges[edges < len(raw)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(raw))[: len(starts)]
    keep = kind[starts] != 0
    return starts[keep], ends[keep]


def _pieces(at: int, data: np.ndarray, classes: np.ndarray, fold: np.ndarray, overlap: int):
    """A long document's pieces. A word longer than a piece makes its piece longer."""
    begin, base, size = 0, 0, CHUNK_BYTES
    while begin < len(data):
        end = min(len(data), begin + size)
        raw = fold[data[begin:end]]
        starts, ends = _runs(raw, classes, np.zeros(1, np.int64))
        final = end == len(data)
        n = len(starts) if final else len(starts) - 1  # the last word may go on
        mine = n if final else n - overlap
        if not final and mine < 1:
            begin, size = (end, size) if not len(starts) else (begin, 2 * size)
            continue
        yield Chunk(at, at + 1, raw, starts[:n], ends[:n], np.array([0, n]), base, mine, final)
        if final:
            return
        begin, base, size = begin + int(starts[mine]), base + mine, CHUNK_BYTES
    none = np.zeros(0, np.int64)
    yield Chunk(at, at + 1, data[:0], none, none, np.zeros(2, np.int64), base, 0, True)


def chunks(column: pa.Array, classes: np.ndarray, fold: np.ndarray = SAME, overlap: int = 0, cut: bool = True):
    """Chunks of a string column without nulls. fold: byte map applied first (LOWER: A-Z to a-z). overlap: words that a piece shows of the next. cut: whether long documents come in pieces."""
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1))
        raw = data[offsets[lo] : offsets[hi]]
        if cut and len(raw) > _BLOCK:
            yield from _pieces(lo, raw, classes, fold, overlap)
        else:
            raw, edges = fold[raw], offsets[lo : hi + 1] - offsets[lo]
            starts, ends = _runs(raw, classes, edges[:-1])
            yield Chunk(lo, hi, raw, starts, ends, np.searchsorted(starts, edges))
        lo = hi
