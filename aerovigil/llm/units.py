"""Units of text that two public tokenizers treat alone: a run of white space with the word behind it.

A cut between two units is taken only where neither library can join what stands on its sides:

* sentencepiece (``.model``): the white-space sign starts the unit, and no piece of the vocabulary has that sign behind another
  character, so no merge crosses the cut. This is read from the vocabulary, not assumed; signs that fail it do not cut.
* byte-level BPE (``.json``): its pattern always starts a new match where white space follows a character that is none.

So the tokens of a text are those of its units, one after the other, and each distinct unit is encoded once per worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from aerovigil.llm import textkit as K

KNOWN_UNITS, KNOWN_IDS = 300_000, 6_000_000   #: What a worker remembers; beyond either it forgets units met in one slice only.
JOINED = 4_000                                #: Units encoded as one text.
LONG_UNIT = 64                                #: Bytes above which a unit is cut further for sentencepiece alone.
SIGN = "▁"                               #: White space in sentencepiece's vocabulary.
_BLANKS = np.array([9, 10, 11, 12, 13, 32])


class Pieces:
    """A sentencepiece model: ids of units without the leading blank that the library adds, and the cuts its vocabulary allows."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        held = [s.replace(SIGN, " ") for i, s in enumerate(names)
                if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.bytes = [bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace(SIGN, " ").encode() for i, s in enumerate(names)]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        #: White space that no piece holds behind another character.
        self.starts = np.zeros(256, bool)
        self.starts[[c for c in _BLANKS.tolist() if not any(chr(c) in s.lstrip(chr(c)) for s in held)]] = True
        #: Pairs of ASCII characters that some piece joins.
        self.joined = np.zeros((256, 256), bool)
        for s in held:
            b = np.frombuffer(s.encode(), np.uint8)
            self.joined[b[:-1], b[1:]] = True
        used = set("".join(held))
        self.guard = next(c for c in map(chr, [10, *range(1, 9), *range(14, 32)]) if c not in used)
        self.lead = len(self.model.encode(self.guard))

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit by itself: a sign that merges with nothing stands before it and takes up the blank the library adds."""
        return [ids[self.lead:] for ids in self.model.encode([self.guard + u for u in units], num_threads=1)]

    def split_long(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray):
        """Units above ``LONG_UNIT`` bytes cut at each pair of ASCII characters that no piece joins."""
        wide = np.flatnonzero(end - start > LONG_UNIT)
        if not len(wide):
            return start, end, row
        free = np.flatnonzero((data[:-1] < 128) & (data[1:] < 128) & ~self.joined[data[:-1], data[1:]]) + 1
        unit = np.searchsorted(start, free, "right") - 1
        inside = (unit >= 0) & (free > start[unit]) & (free < end[unit]) & (end[unit] - start[unit] > LONG_UNIT)
        free, unit = free[inside], unit[inside]
        order = np.argsort(np.concatenate((start, free)), kind="stable")
        return (np.concatenate((start, free))[order], np.sort(np.concatenate((end, free))), np.concatenate((row, row[unit]))[order])


class ByteLevel:
    """A byte-level BPE file: ids of units, and the bytes of each id."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        plain = set(shown)
        code = {chr(b): b for b in shown}
        code |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = self.model.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for s, i in vocabulary.items():
            self.bytes[i] = bytes(code[c] for c in s) if all(c in code for c in s) else s.encode()
        self.length = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(units, add_special_tokens=False)]


def cut(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the units; together they cover every byte.

    A unit starts with each row, and where an allowed white-space byte follows a character that is certainly none: an ASCII sign
    or letter, or a longer character outside the Unicode blocks that hold white space.
    """
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    lead = np.full(len(data), 0, np.uint8)  # of the character that ends here, 0 for ASCII
    lead[1:] = np.where(data[:-1] >= 0xC0, data[:-1], lead[1:])
    lead[2:] = np.where(data[:-2] >= 0xE0, data[:-2], lead[2:])
    solid = (data > 32) & (data < 127) | (data >= 128) & ~np.isin(lead, (0xC2, 0xE1, 0xE2, 0xE3))
    begin = np.zeros(len(data) + 1, bool)
    begin[1:-1] = solid[:-1] & starts[data[1:]]
    begin[offsets] = True
    start = np.flatnonzero(begin[:-1])
    return start, np.append(start[1:], len(data)), np.searchsorted(offsets, start, "right") - 1


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Adjoining byte spans as an Arrow array over the same bytes."""
    bounds = np.append(start, end[-1:]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def with_blank(column: pa.Array) -> pa.Array:
    """A blank before each text that is not empty; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    kind = pa.large_string()
    led = pc.binary_join_element_wise(pa.scalar("", kind), column, pa.scalar(" ", kind))
    return pc.if_else(pc.equal(pc.binary_length(column), 0), column, led)


class Pool:
    """Ragged lists of ids appended one after the other."""

    def __init__(self):
        self.first, self.size, self.ids, self.n, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0, 0

    def add(self, lists: list[list[int]]) -> None:
        size = np.array([len(x) for x in lists], np.int64)
        self.keep(np.fromiter((i for x in lists for i in x), np.int32, int(size.sum())), size)

    def back_to(self, n: int) -> None:
        """Forget all but the first ``n`` lists."""
        if n < self.n:
            self.n, self.used = n, int(self.first[n])

    def keep(self, flat: np.ndarray, size: np.ndarray) -> None:
        while self.n + len(size) > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used:self.used + len(flat)] = flat
        self.first[self.n:self.n + len(size)] = self.used + np.cumsum(size) - size
        self.size[self.n:self.n + len(size)] = size
        self.n, self.used = self.n + len(size), self.used + len(flat)

    def take(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the given lists one after the other, and how many each has."""
        size = self.size[number]
        stop = np.cumsum(size)
        if not len(stop) or not stop[-1]:
            return np.empty(0, np.int32), size
        return self.ids[np.arange(stop[-1]) + np.repeat(self.first[number] - stop + size, size)], size


class Both:
    """Ids of many texts by both tokenizers, each distinct unit encoded once as long as it is remembered."""

    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids_a, self.ids_b = Pool(), Pool()
        self.whole, self.uses = np.zeros(1024, bool), np.zeros(1024, np.int32)

    def make_room(self) -> None:
        """Forget what only one slice held, or everything if that leaves too little room."""
        if len(self.known) <= KNOWN_UNITS and self.ids_a.used + self.ids_b.used <= KNOWN_IDS:
            return
        kept = np.flatnonzero(self.uses[:len(self.known)] > 1)
        names, whole, old = list(self.known), self.whole[kept], (self.ids_a, self.ids_b)
        self.forget()
        if len(kept) > KNOWN_UNITS // 2 or sum(int(p.size[kept].sum()) for p in old) > KNOWN_IDS // 2:
            return
        for new, pool in zip((self.ids_a, self.ids_b), old):
            new.keep(*pool.take(kept))
        self._name([names[i] for i in kept.tolist()], whole)

    def learn(self, new: list[bytes]) -> None:
        """Ids of units not met before. Units that start with a blank and end with an ASCII sign or letter are encoded many at a time,
        as one text, whose cuts stand where one unit meets the next; the others one by one."""
        plain = [32 < u[-1] < 127 and self.b.starts[u[0]] for u in new]
        for at in range(0, len(new), JOINED):
            some, flags = new[at:at + JOINED], plain[at:at + JOINED]
            self.add_joined([u for u, p in zip(some, flags) if p])
            self.add_each([u for u, p in zip(some, flags) if not p])

    def _name(self, units: list[bytes], whole) -> None:
        at = len(self.known)
        while at + len(units) > len(self.whole):
            self.whole, self.uses = np.resize(self.whole, 2 * len(self.whole)), np.resize(self.uses, 2 * len(self.uses))
        self.whole[at:at + len(units)], self.uses[at:at + len(units)] = whole, 0
        self.known.update(zip(units, range(at, at + len(units))))

    def add_joined(self, units: list[bytes]) -> None:
        if not units:
            return
        raw, stop = b"".join(units), np.cumsum([len(u) for u in units])
        text = raw.decode()
        for model, pool in ((self.a, self.ids_a), (self.b, self.ids_b)):
            ids = np.array(model.encode([text])[0], np.int32)
            end = np.cumsum(model.length[ids])
            last = np.searchsorted(end, stop)
            if not len(end) or end[-1] != len(raw) or (end[last] != stop).any() or b"".join(map(model.bytes.__getitem__, ids.tolist())) != raw:
                break
            pool.keep(ids, np.diff(np.append(-1, last)))
        else:
            self._name(units, True)
            return
        self.ids_a.back_to(len(self.known))
        self.add_each(units)

    def add_each(self, units: list[bytes]) -> None:
        texts = [u.decode() for u in units]
        a, b = self.a.encode(texts), self.b.encode(texts)
        self.ids_a.add(a)
        self.ids_b.add(b)
        self._name(units, [b"".join(map(self.a.bytes.__getitem__, x)) == u and b"".join(map(self.b.bytes.__getitem__, y)) == u
                           for u, x, y in zip(units, a, b)])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, row of each, ids of B, row of each) of the texts with a blank before them; none for a text that either
        tokenizer does not give back byte by byte."""
        data, offsets = K.utf8(with_blank(column))
        start, end, row = cut(data, offsets, self.b.starts)
        none = np.empty(0, np.int32), np.empty(0, np.int64)
        if not len(start):
            return *none, *none
        coded = pc.dictionary_encode(spans(data, start, end))
        distinct = coded.dictionary.to_pylist()
        self.make_room()
        new = [u for u in distinct if u not in self.known]
        if new:
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.uses[number] += 1
        number = number[coded.indices.to_numpy()]
        broken = np.zeros(len(offsets) - 1, bool)
        broken[row[~self.whole[number]]] = True
        number, row = number[~broken[row]], row[~broken[row]]
        a, times_a = self.ids_a.take(number)
        b, times_b = self.ids_b.take(number)
        return a, np.repeat(row, times_a), b, np.repeat(row, times_b)


_held: dict[tuple, object] = {}


def held(kind: type, *paths: str):
    """One per worker process, so that what it knows serves all its tasks."""
    if (kind, *paths) not in _held:
        _held[kind, *paths] = kind(*paths)
    return _held[kind, *paths]
