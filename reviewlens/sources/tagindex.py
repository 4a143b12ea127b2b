"""The page readers' fields for a whole batch of reviews at once.

An index of the tags of all pieces of a batch is made by array operations on the Arrow buffer:
brackets and quotes give the tags, running depths the elements, and a sort by depth their ends. Each
different tag is read once. A piece whose markup is not plainly nested (tags that cross or never
end, stray brackets, comments) is read by :class:`reviewlens.sources.markup.Fields`, whose results
hold for all others, too.
"""

from __future__ import annotations

from html import unescape

import numpy as np
import pyarrow as pa

from reviewlens.sources.markup import PIECES, VOID_TAGS, Element, Fields, matches

# Elements nested deeper are left to the reader of single pieces.
DEEPEST = 64
_OPEN, _CLOSE, _VOID, _BROKEN = range(4)


class _Tags:
    """The tags of a batch, in order: piece, begin, end (exclusive), and which pieces are not plain."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.odd = np.zeros(len(offsets) - 1, bool)
        begin = np.flatnonzero(raw == ord("<"))
        begin = begin[(begin >= offsets[0]) & (begin < offsets[-1])]
        piece = np.searchsorted(offsets, begin, "right") - 1
        padded = np.append(raw, np.zeros(2, np.uint8))
        slash = padded[begin + 1] == ord("/")
        letter = padded[begin + 1 + slash] | 0x20
        named = (letter >= ord("a")) & (letter <= ord("z"))
        end = self._ends(raw, begin)
        ended = named & (end <= offsets[piece + 1])
        apart = np.ones(len(begin), bool)
        apart[1:] = begin[1:] >= end[:-1]
        self.odd[piece[~(ended & apart)]] = True
        plain = ~self.odd[piece]
        self.piece, self.begin, self.end = piece[plain], begin[plain], end[plain]

    @staticmethod
    def _ends(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Behind the first ``>`` outside quotes after each position, or far away."""
        at = np.flatnonzero((raw == ord(">")) | (raw == ord('"')) | (raw == ord("'")))
        kind = raw[at]
        again = np.full(len(at) + 1, len(at))
        for quote in (ord('"'), ord("'")):
            own = np.flatnonzero(kind == quote)
            again[own[:-1]] = own[1:]
        out = np.full(len(begin), np.iinfo(np.int64).max)
        open_ones, look = np.arange(len(begin)), np.searchsorted(at, begin)
        while len(open_ones):
            inside = look < len(at)
            open_ones, look = open_ones[inside], look[inside]
            closed = kind[look] == ord(">")
            out[open_ones[closed]] = at[look[closed]] + 1
            open_ones, look = open_ones[~closed], again[look[~closed]] + 1
        return out


class IndexedFields:
    """What :class:`Fields` finds with ``one_root``, for whole batches."""

    def __init__(self, fields: dict[str, tuple[str, list]]):
        self.fields = fields
        self.single = Fields(fields)
        self.steps = [step for _, steps in fields.values() for step in steps]
        tags = {step[0] for step in self.steps}
        self.slots = {
            tag: [k for k, (own, _) in enumerate(self.steps) if own in (None, tag)] for tag in tags
        }

    def values(self, pieces: pa.Array) -> dict[str, list[str | None]]:
        """Per name a value for every piece; null and empty pieces have none."""
        found = {name: [None] * len(pieces) for name in self.fields}
        pieces = pieces.cast(pa.string()).fill_null("")
        _, ends, data = pieces.buffers()
        if not len(pieces) or data is None or not data.size:
            return found
        offsets = np.frombuffer(ends, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        offsets = offsets.astype(np.int64)
        tags = _Tags(np.frombuffer(data, np.uint8), offsets)
        self._plain(tags, data, found)
        for k in np.flatnonzero(tags.odd).tolist():
            for name, value in self.single.first_values(pieces[k].as_py()).items():
                found[name][k] = value
        return found

    def _read(self, tags: _Tags, data: pa.Buffer):
        """Each tag's number among the different ones, and for these: kind, name, element, steps."""
        edges = np.stack([tags.begin, tags.end], axis=1).ravel().astype(np.int32)
        between = pa.BinaryArray.from_buffers(
            pa.binary(), max(0, len(edges) - 1), [None, pa.py_buffer(edges), data]
        )
        coded = between.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode()
        number = coded.indices.to_numpy()
        texts = coded.dictionary.to_pylist()
        kind, name = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        fits = np.zeros((len(texts), len(self.steps)), bool)
        elements, names = [], {}
        for k, text in enumerate(texts):
            text = text.decode()
            match = PIECES.match(text)
            closing, tag, tail, _ = match.groups()
            element = Element((tag or "").lower(), tail or "")
            elements.append(element)
            name[k] = names.setdefault(element.tag, len(names))
            if match.end() < len(text) or not tag:
                kind[k] = _BROKEN
            elif closing:
                kind[k] = _CLOSE
            else:
                kind[k] = _VOID if element.tag in VOID_TAGS or element.tail.endswith("/") else _OPEN
                for slot in self.slots.get(element.tag, self.slots.get(None, ())):
                    fits[k, slot] = matches(self.steps[slot], element)
        return number, kind[number], name[number], elements, fits

    def _plain(self, tags: _Tags, data: pa.Buffer, found: dict) -> None:
        if not len(tags.begin):
            tags.odd[:] = True
            return
        number, kind, name, elements, fits = self._read(tags, data)
        n_pieces = len(tags.odd)
        piece = tags.piece
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        change = np.choose(kind, [1, -1, 0, 0])
        total = np.cumsum(change)
        base = np.zeros(n_pieces, np.int64)
        base[piece[first]] = total[first] - change[first]
        depth = total - base[piece]
        # The first element ends where the depth is 0 for the first time; what follows does not count.
        zero = np.flatnonzero(depth == 0)
        stop = np.full(n_pieces, -1)
        stop[piece[zero][::-1]] = zero[::-1]
        fine = stop >= 0
        fine[piece[first]] &= kind[first] == _OPEN
        inside = np.arange(len(piece)) <= stop[piece]
        fine[piece[inside & ((kind == _BROKEN) | (depth > DEEPEST))]] = False
        level = depth + (kind != _OPEN)
        # Sorted by depth, openings and closings alternate.
        paired = np.flatnonzero(inside & fine[piece] & (kind != _VOID))
        paired = paired[np.lexsort((level[paired], piece[paired]))]
        opening, closing = paired[::2], paired[1::2]
        fine[piece[opening[name[opening] != name[closing]]]] = False
        last = np.arange(len(piece))
        last[opening] = closing
        tags.odd |= ~fine
        used = np.flatnonzero(inside & fine[piece] & (kind != _CLOSE))
        parent = self._parents(used, level, kind)
        fit = fits[number]
        body = data.to_pybytes()
        slot = 0
        for field, (what, steps) in self.fields.items():
            if steps:
                own = self._selected(used, parent, fit, range(slot, slot + len(steps)))
            else:
                own = used[level[used] == 1]
            slot += len(steps)
            where, at = np.unique(piece[own], return_index=True)
            own = own[at]
            column = found[field]
            if what in ("text", "words"):
                join = _words if what == "words" else _text
                starts, stops = tags.end, tags.begin
                for k, a, b in zip(where.tolist(), own.tolist(), last[own].tolist()):
                    if b == a + 1:
                        column[k] = join([body[starts[a] : stops[b]].decode()])
                    else:
                        parts = [body[starts[g] : stops[g + 1]].decode() for g in range(a, b)]
                        column[k] = join([part for part in parts if part])
            else:
                for k, d in zip(where.tolist(), number[own].tolist()):
                    column[k] = elements[d].attribute(what)

    @staticmethod
    def _parents(used: np.ndarray, level: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The element around each element; -1 around the first ones of the pieces."""
        parent = np.full(len(level), -1)
        deep = level[used]
        above = used[(deep == 1) & (kind[used] == _OPEN)]
        for depth in range(2, int(deep.max(initial=0)) + 1):
            own = used[deep == depth]
            parent[own] = above[np.searchsorted(above, own) - 1]
            above = own[kind[own] == _OPEN]
        return parent

    @staticmethod
    def _selected(used: np.ndarray, parent: np.ndarray, fit: np.ndarray, slots: range) -> np.ndarray:
        """The elements that fit the last step and have elements around them that fit the others."""
        own = used[fit[used, slots[-1]]]
        around, left = parent[own], np.full(len(own), len(slots) - 2)
        while ((left >= 0) & (around >= 0)).any():
            going = (left >= 0) & (around >= 0)
            left[going] -= fit[around[going], slots[0] + left[going]]
            around[going] = parent[around[going]]
        return own[left < 0]


def _words(parts: list[str]) -> str:
    return " ".join(" ".join([unescape(part) for part in parts]).split())


def _text(parts: list[str]) -> str:
    return "".join([unescape(part).strip() for part in parts])
