"""Token ids of many texts, by a public byte-level BPE vocabulary.

BPE works on the pieces that the vocabulary's pattern cuts. A place between a visible character and a
space is always such a cut, so a text's ids are those of its chunks, one after the other. Chunks repeat
a lot: each worker keeps the ids of those it has met, found by 128-bit hashes, and encodes only new
ones. New chunks in the middle of a text are encoded together, as their ids can be told apart by the
bytes they stand for; the first and last of a text are encoded one by one.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

from ledgerline.llm.words import _letters, mix, spans

#: Entries of a worker's memory of chunks before it starts afresh; results do not depend on it.
REMEMBER = 800_000
#: The pattern of byte-level BPE vocabularies that cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole batches of texts.

    ``ordinary`` says that strings of added tokens are text like any other, so that their ids never come up.
    Else they become those ids, as the library does by default: a text that holds one is encoded by it whole.
    """

    def __init__(self, vocabulary: str, ordinary: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        added = [t["content"].encode() for t in json.loads(vocabulary).get("added_tokens", [])]
        self.added = None if ordinary or not added else re.compile(b"|".join(map(re.escape, added)))
        self.plain = Tokenizer.from_str(vocabulary)
        self.one = Tokenizer.from_str(vocabulary)
        self.one.encode_special_tokens = True
        model, letters = json.loads(vocabulary)["model"], _byte_letters()
        special = {t["content"] for t in json.loads(vocabulary).get("added_tokens", [])}
        ranks = {
            bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special
        }
        self.many = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(model["vocab"].values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self._forget()

    def _forget(self):
        self.known = 0
        self.slots = np.full(1 << 21, -1, np.int32)
        self.key, self.check = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.at, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each chunk, or -1, by open addressing."""
        last = np.uint64(len(self.slots) - 1)
        out = np.full(len(key), -1, np.int64)
        open_, slot = np.arange(len(key)), key & last
        while len(open_):
            entry = self.slots[slot]
            used = entry >= 0
            open_, slot, entry = open_[used], slot[used], entry[used]
            same = (self.key[entry] == key[open_]) & (self.check[entry] == check[open_])
            out[open_[same]] = entry[same]
            open_, slot = open_[~same], (slot[~same] + np.uint64(1)) & last
        return out

    def _place(self, entries: np.ndarray) -> None:
        last = np.uint64(len(self.slots) - 1)
        slot = self.key[entries] & last
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + np.uint64(1)) & last

    @staticmethod
    def _room(values: np.ndarray, need: int) -> np.ndarray:
        return values if need <= len(values) else np.concatenate([values, np.zeros(max(need, len(values)), values.dtype)])

    def _learn(self, data: np.ndarray, start, end, key, check, alone) -> None:
        """Encode chunks that differ from each other and from those known."""
        buffer = data.tobytes()
        joined = np.flatnonzero(~alone)
        ids, sizes = [], np.zeros(len(start), np.int64)
        if len(joined):
            text = b"".join([buffer[a:b] for a, b in zip(start[joined].tolist(), end[joined].tolist())])
            got = np.array(self.many.encode_ordinary(text.decode()), np.uint32)
            reach = np.concatenate([[0], np.cumsum(self.width[got])])
            bounds = np.concatenate([[0], np.cumsum(end[joined] - start[joined])])
            cut = np.searchsorted(reach, bounds)
            if not np.array_equal(reach[cut], bounds):
                raise AssertionError("a token crosses a chunk")
            sizes[joined] = np.diff(cut)
            ids.append(got)
        single = np.flatnonzero(alone)
        if len(single):
            texts = [buffer[a:b].decode() for a, b in zip(start[single].tolist(), end[single].tolist())]
            each = [np.array(e.ids, np.uint32) for e in self.one.encode_batch(texts, add_special_tokens=False)]
            sizes[single] = [len(e) for e in each]
            ids += each
        order = np.concatenate([joined, single])
        at = np.zeros(len(start), np.int64)
        at[order] = np.concatenate([[0], np.cumsum(sizes[order])[:-1]]) + self.used
        got = np.concatenate(ids)
        self.ids = self._room(self.ids, self.used + len(got))
        self.ids[self.used : self.used + len(got)] = got
        self.used += len(got)
        to = self.known + len(start)
        for name, values in (("key", key), ("check", check), ("at", at), ("size", sizes)):
            setattr(self, name, self._room(getattr(self, name), to))
            getattr(self, name)[self.known : to] = values
        self._place(np.arange(self.known, to, dtype=np.int32))
        self.known = to

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start and end."""
        ids, at = self._encode(data, offsets)
        if self.added is None:
            return ids, at
        buffer = data.tobytes()
        hits = [m.start() for m in self.added.finditer(buffer)]
        special = np.unique(np.searchsorted(offsets, hits, "right") - 1).astype(np.int64)
        if not len(special):
            return ids, at
        each = np.split(ids, at[1:-1])
        for row in special.tolist():
            text = buffer[offsets[row] : offsets[row + 1]].decode()
            each[row] = np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        start, row = _chunks(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        end = np.append(start[1:], len(data))
        first = np.append(True, row[1:] != row[:-1])
        last = np.append(first[1:], True)
        # the space that parts chunks from the left belongs to the chunk; a text's first chunk may lack it
        visible = (data[end - 1] > 0x20) & (data[end - 1] < 0x7F)
        alone = (first & (data[start] != 0x20)) | (last & ~visible)
        values = _letters()[data]
        raw = spans(values, start, end)
        key = mix(raw)
        check = mix(spans(values ^ (values >> np.uint64(17)), start, end) + (end - start).astype(np.uint64))
        if self.known > REMEMBER:
            self._forget()
        entry = self._find(key, check)
        new = np.flatnonzero(entry < 0)
        if len(new):
            pick = new[_first_of(key[new], check[new])]
            self._learn(data, start[pick], end[pick], key[pick], check[pick], alone[pick])
            entry[new] = self._find(key[new], check[new])
        sizes, at = self.size[entry].astype(np.int64), self.at[entry].astype(np.int64)
        reach = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(reach[-1]) + np.repeat(at - reach[:-1], sizes)]
        per_row = np.zeros(rows + 1, np.int64)
        np.add.at(per_row, row + 1, sizes)
        return ids, np.cumsum(per_row)


def _first_of(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """One place for each different pair."""
    order = np.lexsort((check, key))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1]))
    return order[new]


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks start, and their rows: at each text, and at each space after a character that is surely
    no white space."""
    gap = data == 0x20
    cut = np.zeros(len(data), bool)
    if len(data) > 3:
        at = np.flatnonzero(gap[3:]) + 3
        before, two, three = data[at - 1], data[at - 2], data[at - 3]
        visible = (before > 0x20) & (before != 0x7F)
        # last bytes of white space beyond ASCII: C2 85, C2 A0, and three-byte ones after E1, E2, E3
        blank = (two == 0xC2) & ((before == 0x85) | (before == 0xA0))
        blank |= (three >= 0xE1) & (three <= 0xE3) & ((two == 0x9A) | (two == 0x80) | (two == 0x81))
        cut[at[visible & ~blank]] = True
    filled = offsets[1:] > offsets[:-1]
    cut[offsets[:-1][filled]] = True
    start = np.flatnonzero(cut)
    return start, np.searchsorted(offsets, start, "right") - 1


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, ordinary: bool = True) -> Encoder:
    """The worker's encoder for a vocabulary, given as the text of its file."""
    return Encoder(vocabulary, ordinary)
