"""Encoding texts word by word without running an encoder's pattern over all of them.

A text is cut at blanks and before line ends. If no part is empty or has white space at its
rim, no match of a byte-level BPE pattern crosses a cut: a blank goes with the part after
it, a single line end stands alone. So each distinct part is encoded once, with what stands
before it, and a text's ids are its parts' ids in a row. Other texts are cut by the pattern
itself. Cutting, counting distinct parts and joining ids run in Arrow and numpy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 8 << 20  # bytes of text that are encoded at once
#: White space, and nothing: what an empty part, or a lone line end, begins with.
NO_RIM = pa.array(["", *(c for c in map(chr, range(0x3001)) if c.isspace())])


class PartEncoder:
    """``split(text)`` gives the matches of the pattern in a text; ``encode(list)`` the ids of
    strings that are matches in a row, as little-endian 32-bit integers. What was encoded is
    kept until it has more than ``limit`` strings."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], limit: int):
        self.split, self.encode, self.limit = split, encode, limit
        self.known: dict[str, bytes] = {}

    def slices(self, texts: pa.Array):
        """Encodings (ids of all texts in a row, end of each text's) of slices of ``texts``."""
        if not pa.types.is_string(texts.type):
            texts = texts.cast(pa.string())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + SLICE, side="right")))
            yield self._encode(texts.slice(at, end - at))
            at = end

    def _ids(self, strings: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        new = [s for s in strings if s not in known]
        if new:
            known.update(zip(new, self.encode(new)))
        return [known[s] for s in strings]

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().copy()
        start = lists.offsets.to_numpy().astype(np.int64)
        start = start - start[0]
        counts, start = np.diff(start), start[:-1]
        parts = coded.dictionary
        simple = np.logical_and.reduceat(_simple(parts)[codes], start)

        # the first part of a text has no blank before it
        firsts, first = np.unique(codes[start], return_inverse=True)
        codes[start] = len(parts) + first
        spaced = pc.if_else(pc.starts_with(parts, "\n"), parts, pc.binary_join_element_wise(" ", parts, ""))
        forms = spaced.to_pylist() + parts.take(pa.array(firsts)).to_pylist()
        if not simple.all():
            codes, counts, forms = self._cut_by_pattern(texts, simple, codes, counts, start, forms)
        there = np.bincount(codes, minlength=len(forms)) > 0
        used = np.flatnonzero(there)
        codes = (np.cumsum(there) - 1)[codes]
        found = self._ids([forms[i] for i in used])
        own = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(lengths) - lengths
        each = lengths[codes]
        end = np.cumsum(each)
        ids = own[np.arange(end[-1] if len(end) else 0) + np.repeat(begins[codes] - end + each, each)]
        return ids, np.append(0, end)[np.cumsum(counts)]

    def _cut_by_pattern(self, texts, simple, codes, counts, start, forms):
        rows, at = [], {}
        for i, ok in enumerate(simple):
            if ok:
                rows.append(codes[start[i]:start[i] + counts[i]])
                continue
            words = self.split(texts[i].as_py())
            for w in words:
                if w not in at:
                    at[w] = len(forms)
                    forms.append(w)
            rows.append(np.array([at[w] for w in words], np.int64))
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64), forms


def _simple(parts: pa.Array) -> np.ndarray:
    """Parts that are not empty and have no white space at their rim, but for one line end
    before them."""
    first = pc.utf8_slice_codeunits(parts, 0, 1)
    first = pc.if_else(pc.equal(first, "\n"), pc.utf8_slice_codeunits(parts, 1, 2), first)
    last = pc.utf8_slice_codeunits(parts, -1)
    rim = pc.or_(pc.is_in(first, value_set=NO_RIM), pc.is_in(last, value_set=NO_RIM))
    return ~rim.to_numpy(zero_copy_only=False)
