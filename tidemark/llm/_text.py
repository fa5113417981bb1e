"""Words, their hashes and k-word windows of many texts at once, on the UTF-8 bytes of an Arrow batch.

Hashes are 64 bits. All functions are pure numpy on one bounded slice of a batch; Spark deals out the batches.
"""

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial hashes.
BASE, STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Longer words are hashed one at a time.
LONG = 64
#: Bytes of text that are handled at once.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Bytes that part words: white space, or all ASCII but letters and digits.
SPACE = _separators((0x09, 0x0D), (0x20, 0x20))
NOT_WORD = _separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_bytes = np.arange(256, dtype=U)
AS_IS = mix(_bytes + U(1))
LOWER = mix(np.where((_bytes >= 65) & (_bytes <= 90), _bytes + U(32), _bytes) + U(1))


def slices(batch: pa.RecordBatch, column: str | int = "text", limit: int = SLICE):
    """The batch in parts of about limit bytes of text, at least a row each."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (one more entry than texts). Null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """Words of the texts: first byte, byte after the last, number of the text, and for each text its first word (n + 1)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.off = data, off
        n = len(data)
        inside = ~separators[data]
        bounds = np.zeros(n + 1, bool)
        bounds[off] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | bounds[:n]))
        self.end = np.flatnonzero(inside & (~after | bounds[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, codes: np.ndarray = LOWER) -> np.ndarray:
        """A 64-bit hash of each word; codes says which bytes count as equal."""
        size = self.end - self.start
        order = np.argsort(np.minimum(size, LONG + 1).astype(np.uint8), kind="stable")[::-1]
        at, many = self.start[order], np.bincount(np.minimum(size, LONG + 1), minlength=LONG + 2)[::-1].cumsum()[::-1]
        h = np.zeros(len(size), U)
        for k in range(LONG):
            m = int(many[k + 1]) if k + 1 < len(many) else 0
            if not m:
                break
            h[:m] = h[:m] * BASE + codes[self.data[at[:m] + k]]
        out = np.empty_like(h)
        out[order] = h
        for i in np.flatnonzero(size > LONG):
            word = codes[self.data[self.start[i] : self.end[i]]].tobytes()
            out[i] = U(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        return mix(out + size.astype(U))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values: as many as begin k before the end. Windows may span texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, at, power, part, size = None, 0, k, STEP, h, 1
    while True:  # by binary doubling: part[i] stands for size values from i
        if at & 1:
            out = part[:n].copy() if out is None else out * power + part[done : done + n]
            done += size
        at >>= 1
        if not at:
            return mix(out)
        part = part[: len(part) - size] * power + part[size:]
        power, size = U(int(power) ** 2 & (1 << 64) - 1), size * 2


def joined(words: Words, keep: np.ndarray | None = None) -> list[bytes]:
    """For each text, its (kept) words joined by one space."""
    size = words.end - words.start
    pick = np.arange(len(size)) if keep is None else np.flatnonzero(keep)
    s, doc, out = size[pick] + 1, words.doc[pick], []
    ends = np.cumsum(s)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(words.start[pick] - (ends - s), s) + np.arange(total)
    flat = words.data[np.minimum(source, max(len(words.data) - 1, 0))].copy() if total else np.zeros(0, np.uint8)
    flat[ends - 1] = 0x20
    flat, upto = flat.tobytes(), np.concatenate([[0], ends])
    first = np.searchsorted(doc, np.arange(len(words.off)))
    for a, b in zip(first, first[1:], strict=False):
        out.append(flat[upto[a] : upto[b] - 1] if b > a else b"")
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
