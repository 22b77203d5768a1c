"""Byte-pair encoding by speculation and verification, and its decoding.

A word's ids are guessed first: from its start, always the longest entry of the vocabulary that fits. The
guess is right if and only if every two neighbours are compatible, that is, if no merge across their
border would have come before the merges that made them. All neighbours of all words of a batch are
tested together, and only words with a failing pair are merged exactly, in the order of the merge ranks.

Words are the pieces that the vocabulary's pattern cuts, found for a whole batch from the kinds of its
characters; equal words are looked at once. Strings of added tokens are cut out before, as they stand for
one id each and split the text.

Scale: one pass over the texts and one over the ids, no shuffle; a task holds a few megabytes of text and
the vocabulary's tables (about 50 MB for 50,000 entries).
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.ship import ship
from ledgerline.llm.tokens import _byte_letters
from ledgerline.llm.words import _letters, flat, mix, slices, spans

#: Words up to this many bytes are merged together, round by round; longer ones each with a queue.
TOGETHER = 256
_NEVER = np.iinfo(np.int64).max
#: Kinds of characters: letters 0, digits 1, other signs 2, white space 3.
BLANK = 3


class Codec:
    """Tables of one vocabulary, given as the text of its file, and the steps on whole batches.

    The vocabulary has to be byte-level BPE without normalisation, whose merges each make another token
    out of tokens made by earlier merges; anything else raises ``ValueError``.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        file = json.loads(vocabulary)
        model, letters = file["model"], _byte_letters()
        if file.get("normalizer") or (file.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level vocabulary")
        added = file.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must be plain strings")
        self.added = {t["content"].encode(): t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile(b"|".join(map(re.escape, longest_first))) if added else None
        self.cut = Tokenizer.from_str(vocabulary).pre_tokenizer.pre_tokenize_str
        spelled = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items() if token.encode() not in self.added}
        self._merges(model)
        self._trie(spelled)
        whole = spelled | {i: token for token, i in self.added.items()}
        size = max(whole) + 1
        self.width = np.array([len(whole.get(i, b"")) for i in range(size)], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.spelling = np.frombuffer(b"".join(whole.get(i, b"") for i in range(size)), np.uint8)
        self.kinds: dict[int, int] = {}
        self.ascii = np.array([self._kind(c) if c < 128 else 0 for c in range(256)], np.int8)

    def _merges(self, model: dict) -> None:
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        size = max(ids.values()) + 1
        self.rank = np.full(size, -1, np.int64)
        self.rank[made] = np.arange(len(pairs))
        if len(np.unique(made)) != len(made) or (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(pairs))).any():
            raise ValueError("merges must each make another token out of earlier ones")
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.left[made], self.right[made] = left, right
        key = left << 32 | right
        order = np.argsort(key)
        self.pair_key, self.pair_rank, self.pair_made = key[order], order.astype(np.int64), made[order]
        # a token that its own last merge can't reach is no good guess
        self.reached = self.rank < 0
        self.reached[made] = self._undisturbed(left, right, self.rank[made])

    def _trie(self, spelled: dict[int, bytes]) -> None:
        """The vocabulary as a table: next node by node and byte; nodes without successors have no row."""
        inner, nodes = {b"": 0}, {}
        for token in spelled.values():
            for n in range(1, len(token)):
                inner.setdefault(token[:n], len(inner))
        for prefix in [*inner, *spelled.values()]:
            if prefix:
                nodes.setdefault(prefix, inner.get(prefix) or len(inner) + len(nodes))
        self.step = np.full((len(inner), 256), -1, np.int32)
        for prefix, node in nodes.items():
            self.step[inner[prefix[:-1]], prefix[-1]] = node
        self.accepts = np.full(max(nodes.values()) + 1, -1, np.int32)
        self.inner = len(inner)
        self.byte = np.full(256, -1, np.int64)
        for i, token in spelled.items():
            if self.reached[i]:
                self.accepts[nodes[token]] = i
            if len(token) == 1:
                self.byte[token[0]] = i
        if (self.byte < 0).any():
            raise ValueError("some bytes are no tokens")

    def _found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the merge of two tokens, and whether there is one."""
        key = a << 32 | b
        place = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return place, self.pair_key[place] == key

    def _undisturbed(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int) -> np.ndarray:
        """Whether nothing merges across the border of two tokens before rank ``until``.

        At any time the border lies between a part on the right edge of the left token and one on the left
        edge of the right token. Walking back in time, the one made last is taken apart. Its merge ends the
        time of its part: a merge across the border has to come before. On equal ranks the left place wins.
        """
        a, b = a.copy(), b.copy()
        limit_a, limit_b = np.zeros(len(a), np.int64) + until, np.zeros(len(a), np.int64) + until
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        first = True
        while len(open_):
            x, y = a[open_], b[open_]
            place, there = self._found(x, y)
            crossing = np.where(there, self.pair_rank[place], _NEVER)
            bad = (crossing < limit_a[open_]) & (crossing < limit_b[open_] if first else crossing <= limit_b[open_])
            good[open_[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            open_left = rank_x > rank_y
            # equal ranks only where both are the same token or both are bytes
            same = (rank_x == rank_y) & (rank_x >= 0)
            take = open_left | same
            more = ~bad & (take | (rank_y >= 0))
            to = open_[more & take]
            limit_a[to], a[to] = rank_x[more & take], self.right[x[more & take]]
            to = open_[more & ~take]
            limit_b[to], b[to] = rank_y[more & ~take], self.left[y[more & ~take]]
            open_, first = open_[more], False
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two tokens stay apart when they meet."""
        pairs, back = np.unique(a << 32 | b, return_inverse=True)
        # until a rank that none has: tokens that make one another token don't stay apart
        return self._undisturbed(pairs >> 32, pairs & 0xFFFFFFFF, _NEVER)[back]

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest entries one after the other: ids in order, and where each word's ids start and end."""
        stop = np.repeat(end, end - start)
        place = np.arange(len(data))
        best, reach = self.byte[data], np.ones(len(data), np.int64)
        node, depth, live = np.zeros(len(data), np.int32), 0, place
        while len(live):
            node = self.step[node, data[live + depth]]
            depth += 1
            got = node >= 0
            live, node = live[got], node[got]
            ids = self.accepts[node]
            hit = ids >= 0
            best[live[hit]], reach[live[hit]] = ids[hit], depth
            on = (node < self.inner) & (live + depth < stop[live])
            live, node = live[on], node[on]
        used, now, until = np.zeros(len(data), bool), start, end
        while len(now):
            used[now] = True
            now = now + reach[now]
            on = now < until
            now, until = now[on], until[on]
        chosen = np.flatnonzero(used)
        return best[chosen], np.searchsorted(chosen, np.append(start, len(data)))

    def merged(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact ids of words, the least merge of each word at a time; as ``propose`` gives them."""
        size = end - start
        long = np.flatnonzero(size > TOGETHER)
        short = np.flatnonzero(size <= TOGETHER)
        word = np.repeat(short, size[short])
        ids = self.byte[data[_ranges(start[short], size[short])]]
        done = [(np.full(len(out), w), out) for w, out in ((w, self._queued(data[start[w] : end[w]])) for w in long.tolist())]
        place, rank = self._pairs(ids, word, np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            per = np.repeat(least, np.diff(np.append(first, len(word))))
            over = per == _NEVER
            done.append((word[over], ids[over]))
            hit = (rank == per) & ~over
            # of places that follow each other every second one merges, from the left
            begins = hit & ~np.append(False, hit[:-1])
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            hit &= since % 2 == 0
            ids = np.where(hit, self.pair_made[place], ids)
            keep = ~np.append(False, hit[:-1]) & ~over
            ids, word, place, rank, hit = ids[keep], word[keep], place[keep], rank[keep], hit[keep]
            # only pairs with a new token have another rank
            fresh = np.flatnonzero(hit | np.append(hit[1:], False))
            place[fresh], rank[fresh] = self._pairs(ids, word, fresh)
        word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([i for _, i in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(start) + 1))

    def _pairs(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and rank of the merges of the tokens at ``at`` with the next ones of their words."""
        after = np.minimum(at + 1, len(ids) - 1)
        place, there = self._found(ids[at], ids[after])
        return place, np.where(there & (word[at] == word[after]) & (after > at), self.pair_rank[place], _NEVER)

    def _queued(self, data: np.ndarray) -> np.ndarray:
        """Exact ids of one long word: merges by rank, then place, out of a queue."""
        if not hasattr(self, "by_pair"):
            self.by_pair = dict(zip(self.pair_key.tolist(), zip(self.pair_rank.tolist(), self.pair_made.tolist())))
        ids = self.byte[data].tolist()
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        queue = []

        def meet(i: int) -> None:
            j = after[i]
            if j >= 0 and (got := self.by_pair.get(ids[i] << 32 | ids[j])):
                heapq.heappush(queue, (got[0], i, ids[i], ids[j], got[1]))

        for i in range(len(ids)):
            meet(i)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            meet(i)
            if before[i] >= 0:
                meet(before[i])
        return np.array([i for i in ids if i >= 0], np.int64)

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that follow each other in ``data``: guessed, tested, and merged where the test fails."""
        ids, at = self.propose(data, start, end)
        word = np.repeat(np.arange(len(start)), np.diff(at))
        inside = np.flatnonzero(word[1:] == word[:-1])
        wrong = np.zeros(len(start), bool)
        wrong[word[inside[~self.compatible(ids[inside], ids[inside + 1])]]] = True
        failing = np.flatnonzero(wrong)
        if len(failing):
            exact, exact_at = self.merged(data, start[failing], end[failing])
            sizes = np.diff(at)
            sizes[failing] = np.diff(exact_at)
            at = np.concatenate([[0], np.cumsum(sizes)])
            whole = np.zeros(at[-1], np.int64)
            whole[np.repeat(~wrong, sizes)] = ids[~wrong[word]]
            whole[np.repeat(wrong, sizes)] = exact
            ids = whole
        return ids, at

    def _kind(self, code: int) -> int:
        """What the vocabulary's pattern takes a character for, asked from the library itself."""
        if code not in self.kinds:
            c = chr(code)
            whole = [len(self.cut(x + c)) == 1 for x in "a1!"]
            self.kinds[code] = whole.index(True) if any(whole) else BLANK
        return self.kinds[code]

    def _classes(self, data: np.ndarray) -> np.ndarray:
        """The kind of character that each byte belongs to."""
        out = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int64)
            more = 1 + (first >= 0xE0) + (first >= 0xF0)
            code = first & (0x3F >> more)
            for n in range(1, 4):
                on = more >= n
                code[on] = code[on] << 6 | data[lead[on] + n] & 0x3F
            codes, back = np.unique(code, return_inverse=True)
            kind = np.array([self._kind(c) for c in codes.tolist()], np.int8)[back]
            out[lead] = kind
            for n in range(1, 4):
                out[lead[more >= n] + n] = kind[more >= n]
        return out

    def pieces(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the pieces of the vocabulary's pattern start; ``bounds`` are the offsets of separate texts.

        Letters, digits and other signs run on; a space before a run belongs to it; of other white space
        the last character before a run stands alone; ``'s`` and its like part from what follows them.
        """
        n = len(data)
        kind = self._classes(data)
        char = (data & 0xC0) != 0x80
        fresh = np.zeros(n + 1, bool)
        fresh[bounds] = True
        blank = kind == BLANK
        # the byte before belongs to the character before, as all bytes of one have its kind
        before, space = np.append(np.int8(-1), kind[:-1]), np.append(False, data[:-1] == 0x20)
        cut = np.where(before == BLANK, ~space, before != kind) & ~blank
        # white space that a text ends with stays whole
        after = np.flatnonzero(char)
        runs_on = np.ones(n, bool)
        runs_on[after[:-1]] = blank[after[1:]] | fresh[after[1:]]
        cut |= blank & ((before != BLANK) | ~runs_on)
        cut = (cut & char) | fresh[:n]
        quote = np.flatnonzero((data == 0x27) & cut)
        if len(quote):
            text_end = bounds[np.searchsorted(bounds, quote, "right")]
            padded = np.append(data, [0, 0]).astype(np.uint8)
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, list(b"stmd")) & (quote + 1 < text_end)
            wide = np.zeros(len(quote), bool)
            for a, b in (b"re", b"ve", b"ll"):
                wide |= (one == a) & (two == b)
            wide &= quote + 2 < text_end
            cut[quote[short | wide] + 1] = False
            # the offsets of texts stand, whatever comes next
            ends = np.append(quote[short] + 2, quote[wide] + 3)
            cut[ends[ends < n]] = True
        return np.flatnonzero(cut)

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Offsets of rows and of added tokens in them; the tokens' ids by place."""
        if self.find_added is None:
            return offsets, {}
        buffer, found = data.tobytes(), {}
        at = 0
        while hit := self.find_added.search(buffer, at):
            row = int(np.searchsorted(offsets, hit.start(), "right")) - 1
            # whatever crosses the end of a row is not in it
            inner = self.find_added.search(buffer, hit.start(), int(offsets[row + 1]))
            if inner is None:
                at = int(offsets[row + 1])
                continue
            found[inner.start()] = self.added[inner.group()]
            at = inner.end()
        marks = [*found, *(a + int(self.width[i]) for a, i in found.items())]
        return np.unique(np.concatenate([offsets, np.array(marks, np.int64)])), found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start and end."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds, added = self._segments(data, offsets)
        start = self.pieces(data, bounds)
        at_added = np.array(sorted(added), np.int64)
        if len(added):  # an added token is one piece, whatever its characters
            to = at_added + self.width[[added[a] for a in at_added.tolist()]]
            inside = np.searchsorted(at_added, start, "right") - 1
            start = start[(inside < 0) | (start >= to[inside]) | (start == at_added[inside])]
        end = np.append(start[1:], len(data))
        values = _letters()[data]
        key = mix(spans(values, start, end))
        check = mix(spans(values ^ (values >> np.uint64(17)), start, end) + (end - start).astype(np.uint64))
        order = np.lexsort((check, key))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1]))
        word = np.empty(len(order), np.int64)
        word[order] = np.cumsum(new) - 1
        pick = order[new]
        size = end[pick] - start[pick]
        reach = np.cumsum(size)
        ids, at = self.words(data[_ranges(start[pick], size)], reach - size, reach)
        if len(added):  # their ids stand behind those of the words
            word[np.searchsorted(start, at_added)] = len(pick) + np.arange(len(added))
            ids = np.concatenate([ids, [added[a] for a in at_added.tolist()]])
            at = np.concatenate([at, at[-1] + 1 + np.arange(len(added))])
        width = np.diff(at)[word]
        out = ids[_ranges(at[word], width)].astype(np.uint32)
        reach = np.concatenate([[0], np.cumsum(width)])
        return out, reach[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of many rows of ids; bytes that are no UTF-8 become replacement characters. Ids that the
        vocabulary lacks stand for nothing."""
        there = ids < len(self.width)
        sizes = np.where(there, self.width[np.where(there, ids, 0)], 0)
        data = self.spelling[_ranges(self.at[np.where(there, ids, 0)], sizes)].tobytes()
        reach = np.concatenate([[0], np.cumsum(sizes)])[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(reach, reach[1:])]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, … of each range, one range after the other."""
    reach = np.cumsum(size)
    if not len(reach) or not reach[-1]:
        return np.zeros(0, np.int64)
    return np.arange(reach[-1]) + np.repeat(start - (reach - size), size)


@functools.lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    """The worker's tables of a vocabulary."""
    return Codec(vocabulary)


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of each whole text as little-endian unsigned 32-bit numbers.

    One row per row of ``docs``, also where ids or texts repeat. A null or empty text has no ids; a null
    ``doc_id`` is kept. Strings of added tokens become their ids. Other columns play no part.
    """
    vocabulary_ = ship(docs.sparkSession).sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(vocabulary_.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = tables.encode(*flat(part.column("text")))
                data, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
                rows = [data[a:b] for a, b in zip(at, at[1:])]
                yield pa.record_batch([part.column("doc_id"), _binary(rows)], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids binary"
    )


def decode(coded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, text``: the texts that ids as those of ``encode`` stand for, added tokens included.

    Null ids give an empty text. Ids that the vocabulary lacks stand for nothing; bytes that are no UTF-8
    become replacement characters.
    """
    vocabulary_ = ship(coded.sparkSession).sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(vocabulary_.value)
        for batch in batches:
            rows = [r or b"" for r in batch.column("ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)
            ids = np.frombuffer(b"".join(r[: len(r) // 4 * 4] for r in rows), "<u4")
            texts = tables.decode(ids, at)
            yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, "doc_id long, ids binary, text string"
    )
