"""Texts cut into units that a tokenizer encodes on their own, so that each distinct one is encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import binary_array, flat, ranges

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
# Bytes that may end the UTF-8 form of a white space beyond ASCII, and those that may precede them.
MARK, LETTER = np.zeros(256, bool), np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
LAST, BEFORE = np.zeros(256, bool), np.zeros(256, bool)
LAST[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
BEFORE[[0xC2, 0x80, 0x9A, 0x81]] = True


def cut_units(column: pa.Array, literals: Sequence[str] = ()) -> tuple[pa.Array, np.ndarray]:
    """Units of all texts (binary), and at which unit each text begins and ends.

    A unit is a run of white space and what follows it up to the next: it begins at a white space
    byte behind a character that is surely none, or where a text begins. Where that is in doubt
    the unit just goes on. Punctuation behind an ASCII letter begins one too, as the tokenizer's
    pattern never joins the two. Each of ``literals`` in a text is a unit of its own: the
    leftmost first, of those that begin together the longest.
    """
    at, data = flat(column)
    if not len(data):
        return binary_array(data, np.zeros(1, np.int64)), np.zeros(len(at), np.int64)
    space = SPACE[data]
    edge = np.zeros(len(data), bool)
    maybe = space | LAST[data]
    maybe[1:] &= space[1:] | BEFORE[data[:-1]]
    edge[1:] = space[1:] & ~maybe[:-1] | MARK[data[1:]] & LETTER[data[:-1]]
    edge[at[:-1][at[:-1] < len(data)]] = True
    if literals:
        text = column.cast(pa.large_string())
        held = np.zeros(len(text), bool)
        for x in literals:
            held |= pc.fill_null(pc.match_substring(text, x), False).to_numpy(zero_copy_only=False)
        forms = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(literals, key=len, reverse=True)))
        for i in np.flatnonzero(held).tolist():
            for m in forms.finditer(data[at[i] : at[i + 1]].tobytes()):
                a, b = at[i] + m.start(), at[i] + m.end()
                edge[a:b] = False
                edge[a] = True
                edge[b : b + 1] = True
    starts = np.flatnonzero(edge)
    units = binary_array(data, np.append(starts, len(data)))
    return units, np.searchsorted(starts, at)


class UnitPool:
    """Ids of units already met in this worker, per unit and variant; emptied at ``most`` units.

    ``encode`` takes distinct units and the variant of each, and returns their ids in a row and
    how many each has.
    """

    def __init__(self, encode: Callable, kind, variants: int = 1, most: int = 800_000):
        self.encode, self.kind, self.variants, self.most = encode, kind, variants, most
        self._empty()

    def _empty(self) -> None:
        self.number: dict[bytes, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, self.kind)

    def ids(self, units: pa.Array, variant: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each unit has."""
        d = pc.dictionary_encode(units)
        words, which = d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.number) > self.most:
            self._empty()
        number, v = self.number, self.variants
        mine = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        more = len(number) * v - len(self.start)
        self.start = np.concatenate([self.start, np.full(more, -1, np.int64)])
        self.size = np.concatenate([self.size, np.zeros(more, np.int32)])
        key = mine[which] * v + (variant if variant is not None else 0)
        fresh = np.unique(key[self.start[key] < 0])
        if len(fresh):
            place = np.zeros(len(number), np.int64)
            place[mine] = np.arange(len(words))
            parts, filled = [self.pool], len(self.pool)
            for i in range(0, len(fresh), 20_000):
                part = fresh[i : i + 20_000]
                asked = [words[k] for k in place[part // v].tolist()]
                got, n = self.encode(asked, part % v)
                self.start[part], self.size[part] = filled + np.cumsum(n) - n, n
                parts.append(got.astype(self.kind))
                filled += len(got)
            self.pool = np.concatenate(parts)
        n = self.size[key].astype(np.int64)
        return self.pool[ranges(self.start[key], n)], n
