"""Distinct-unit tables for subword encoders: each distinct space-led unit of a group of texts is segmented once, ids are joined back by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose units share a table, and distinct units that are segmented in one call. Both bound a task's memory.
GROUP_BYTES = 10_000_000
CALL_UNITS = 4096
#: Units that a worker's table holds before it begins anew (a few dozen MB); no result depends on it.
KNOWN_UNITS = 800_000


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about GROUP_BYTES."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, base + GROUP_BYTES, "right")))
        yield first, end
        first = end


class UnitTable:
    """Segments texts whose ids are those of their space-led units one after the other.

    joined: ids of one text; leads: for each id whether its piece begins with the space, which no other piece of a unit does;
    single: id lists of texts on their own. heads: whether a text's first unit, having no space before it, is segmented on its own.
    """

    def __init__(self, joined: Callable[[str], list[int]], single: Callable[[list[str]], list[list[int]]], leads: np.ndarray, heads: bool, dtype: type):
        self.joined, self.single, self.leads, self.heads, self.dtype = joined, single, leads, heads, dtype
        self._clear()

    def _clear(self) -> None:
        self.known, self.flat, self.counts = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def _look_up(self, units: pa.Array) -> np.ndarray:
        """Places of distinct units in the table; those not in it are segmented and added."""
        if len(self.known) > KNOWN_UNITS:
            self._clear()
        at = pc.index_in(units, value_set=self.known)
        new = units.filter(pc.is_null(at))
        base = len(self.known)
        if len(new):
            flat, counts = self._segment(new)
            self.known = pa.concat_arrays([self.known, new])
            self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        place = np.asarray(pc.fill_null(at, -1), dtype=np.int64).copy()
        place[place < 0] = base + np.arange(len(new))
        return place

    def _segment(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, in order, and the number of ids of each."""
        odd = np.asarray(pc.match_substring_regex(units, r"^(\s|\x0b|[^\x21-\x7e\x{A1}-\x{167F}]|$)"))
        plain = units.filter(pa.array(~odd))
        ids, counts = [np.zeros(0, self.dtype)], np.zeros(len(units), np.int64)
        parts = [np.zeros(0, np.int64)]
        for i in range(0, len(plain), CALL_UNITS):
            some = plain[i : i + CALL_UNITS]
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()
            got = np.array(self.joined(" " + text if self.heads else text), dtype=self.dtype)
            begins = np.flatnonzero(self.leads[got])
            if len(begins) != len(some) or begins[0] != 0:
                raise ValueError("pieces cross a space: this model needs whole texts")
            ids.append(got)
            parts.append(np.diff(np.append(begins, len(got))))
        flat, lengths = np.concatenate(ids), np.concatenate(parts)
        if not odd.any():
            return flat, lengths
        own = self.single([(" " if self.heads else "") + x for x in units.filter(pa.array(odd)).to_pylist()])
        counts[~odd] = lengths
        counts[odd] = [len(x) for x in own]
        out = np.zeros(int(counts.sum()), self.dtype)
        at = np.repeat(odd, counts)
        out[~at] = flat
        out[at] = [t for x in own for t in x]
        return out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the offset of each text's first one (plus the total)."""
        lists = pc.split_pattern(texts, " ")
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        bounds = bounds - bounds[0]
        units = lists.flatten()
        if not len(units):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        coded = pc.dictionary_encode(units)
        at = self._look_up(coded.dictionary)[np.asarray(coded.indices)]
        flat, counts = self.flat, self.counts
        if self.heads:  # the first units of texts, which no space leads, come after the others
            first = bounds[:-1][np.diff(bounds) > 0]
            own = self.single(units.take(pa.array(first)).to_pylist())
            at[first] = len(counts) + np.arange(len(first))
            flat = np.concatenate([flat, np.fromiter((t for x in own for t in x), self.dtype)])
            counts = np.concatenate([counts, np.fromiter(map(len, own), np.int64, len(own))])
        starts = np.cumsum(counts) - counts
        lengths = counts[at]
        ends = np.cumsum(lengths)
        index = np.repeat(starts[at] - (ends - lengths), lengths)
        index += np.arange(len(index))
        return flat[index], np.concatenate([[0], ends])[bounds]
