"""Matches of public_tokenizers.PATTERN in many texts at once, in numpy over their UTF-8 bytes.

The pattern cuts a text into runs of letters, of numbers, of white space and of everything else, but for three rules: a
single space goes with the run that follows it, the last white space character before other text is a match of its
own, and an apostrophe that stands alone before letters takes s, t, m, d, re, ve or ll with it. Classes of characters
come from a regular expression library; where it knows newer characters than Python does, the tokenizers library says
what they are to it.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    for kind, beside in ((_LETTER, "a"), (_NUMBER, "1")):
        new = [c for c in np.flatnonzero(out == kind).tolist() if unicodedata.category(chr(c)) == "Cn"]
        out[np.array(new, dtype=np.int64)[~_joins(beside, new)]] = _OTHER
    return out


def _joins(beside: str, points: list[int]) -> np.ndarray:
    """Which code points (not ASCII) the tokenizers library takes into one match with the character beside them."""
    from tokenizers.pre_tokenizers import ByteLevel

    pieces = ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f"{beside}{chr(c)}\n" for c in points))
    return np.array([len(p) > 1 for p, _ in pieces if p[0] == beside], dtype=bool)


def _kinds(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = _classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead]
    for size, low, high, mask in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
        at = lead[(first >= low) & (first < high)]
        if not len(at):
            continue
        point = (data[at] & mask).astype(np.int32)
        for i in range(1, size):
            point = (point << 6) | (data[at + i] & 0x3F)
        kind = table[point]
        for i in range(size):
            out[at + i] = kind
    return out


def match_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the matches of the texts [offsets[i], offsets[i + 1]) begin, and the end of the last."""
    n = len(data)
    kinds = _kinds(data)
    opens = np.zeros(n + 1, dtype=bool)  # a text begins or ends here
    opens[offsets] = True
    edge = opens.copy()
    edge[1:n] |= kinds[1:] != kinds[:-1]
    edge[n] = True
    run = np.flatnonzero(edge)
    run, end = run[:-1], run[1:]
    kind = kinds[run]
    # white space before other text
    stop = end[(kind == _SPACE) & ~opens[end]]
    last = stop - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    edge[last] = True
    edge[stop[data[last] == 0x20]] = False
    # contractions
    lone = np.flatnonzero((data[run] == 0x27) & (end - run == 1) & edge[run] & ~opens[end])
    lone = lone[kind[lone + 1] == _LETTER]
    at, left = run[lone], end[lone + 1] - end[lone]
    one, two = data[at + 1], data[np.minimum(at + 2, n - 1)]
    size = np.isin(one, list(b"stmd")).astype(np.int64)
    size[(left > 1) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))] = 2
    at, size = at[size > 0], size[size > 0]
    edge[at + 1] = False
    edge[at + 1 + size] = True
    return np.flatnonzero(edge)


def encode_texts(data: np.ndarray, offsets: np.ndarray, width: int, ids_of) -> list[bytes]:
    """Token ids of each text [offsets[i], offsets[i + 1]) of UTF-8 data, little-endian, width bytes each; ids_of gives those of distinct matches."""
    if not len(data):
        return [b""] * (len(offsets) - 1)
    bounds = match_bounds(data, offsets)
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    values = ids_of(words.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(values), dtype=f"<u{width}")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
    which = words.indices.to_numpy()
    counts = sizes[which]
    ends = np.concatenate(([0], np.cumsum(counts)))
    raw = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
    at = (ends[np.searchsorted(bounds, offsets)] * width).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


class Recent(dict):
    """Known values by match, in two generations of about `most` bytes: when the younger is full the older goes, but for what is asked for."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size, self.old = most, 0, {}

    def unknown(self, keys: list[bytes]) -> list[bytes]:
        """Those of the distinct keys that must be worked out; the others can be looked up until the next call."""
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        new = [k for k in keys if k not in self]
        if not self.old:
            return new
        back = [k for k in new if k in self.old]
        self.learn(back, [self.old[k] for k in back])
        return [k for k in new if k not in self.old]

    def learn(self, keys: list[bytes], values: list[bytes]) -> None:
        self.update(zip(keys, values, strict=True))
        # a key is about as long as its value
        self.size += 180 * len(values) + 2 * sum(map(len, values))
