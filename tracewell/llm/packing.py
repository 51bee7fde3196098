"""Harmonic packing of documents into token sequences.

A document of L <= C tokens is of class j = floor(C / L): its length lies in the
reciprocal range (C/(j+1), C/j], so j of its class always fit one bin. Each worker keeps a
queue per class and closes a bin as soon as it has j of them, without a look at any other worker's bins;
no row is shuffled. The gap that j documents leave (under C/(j+1)) is filled from the
smallest class, whose documents are taken whole while they fit, and then by cutting one document,
so a closed bin has no padding. Longer documents give off full sequences first; their rest is classed.
What a worker has left at its end is laid end to end, and the last sequence, if not
full, becomes sequences whose lengths are powers of two, which are never padded.
So no sequence has padding, and few documents are cut.

Memory: a worker holds the ids of `buffer_tokens` tokens (and one document), whatever the table's size.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import slices, tokenizer_path

CAPACITY = 4096
SMALLEST_CLASS = 16
#: Words whose ids a worker remembers; those beyond are encoded each time they come.
REMEMBERED = 700_000

#: A fixed value of the vocabulary: how word_bpe splits lower-cased text, over ASCII and Latin-1 letters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r a-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")
#: Texts with other characters, or a special token's first ones, go to the library whole.
_UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x7fª²³µ¹º¼-ÿ]|<\|")


class Encoder:
    """Token ids of texts, as the tokenizers library gives them with add_special_tokens=False.

    The vocabulary drops white space and never joins across it, so ids are remembered per
    white-space-delimited lower-case word. Words not seen yet are encoded by the library, many at
    a time; a token that ends a word ends with '</w>', which tells where the ids of each word end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _new(self, words: list[str]) -> dict[str, bytes]:
        got = {}
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            upto = np.cumsum([len(_PIECES.findall(w)) for w in some]) - 1
            stops = (np.flatnonzero(self.ends[ids]) + 1)[upto] * 4
            raw, start = ids.tobytes(), 0
            for w, stop in zip(some, stops.tolist(), strict=True):
                got[w] = raw[start:stop]
                start = stop
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        usual = [None if _UNUSUAL.search(t) else t.lower().split() for t in texts]
        known = self.known
        new = self._new([w for w in set(chain.from_iterable(w for w in usual if w is not None)) if w not in known])
        if len(known) + len(new) <= REMEMBERED:
            known.update(new)
            find = known.__getitem__
        else:
            find = {w: v for t in usual if t is not None for w in t if (v := known.get(w) or new.get(w))}.__getitem__
        odd = [t for t, w in zip(texts, usual, strict=True) if w is None]
        rest = iter([np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)] if odd else [])
        return [next(rest) if w is None else b"".join(map(find, w)) for w in usual]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and vocabulary, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Harmonic packing of (document, length) pairs; pieces() gives (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, smallest: int = SMALLEST_CLASS):
        self.capacity, self.smallest = capacity, min(smallest, capacity)
        self.queues = [deque() for _ in range(self.smallest + 1)]
        self.sequence, self.out, self.held = 0, [], 0

    def _class(self, length: int) -> int:
        return min(self.smallest, self.capacity // length)

    def _lay(self, parts: list[tuple]) -> None:
        offset = 0
        for doc, start, length in parts:
            self.out.append((doc, start, length, self.sequence, offset))
            offset += length
        self.held -= offset
        self.sequence += 1

    def add(self, doc, length: int) -> None:
        start = 0
        self.held += length
        while length - start >= self.capacity:
            self._lay([(doc, start, self.capacity)])
            start += self.capacity
        if length > start:
            self.queues[self._class(length - start)].append((doc, start, length - start))

    def _fill(self, parts: list[tuple], gap: int) -> None:
        """Small documents whole while they fit, then a part of one document."""
        small = self.queues[self.smallest]
        while gap and small and small[0][2] <= gap:
            parts.append(small.popleft())
            gap -= parts[-1][2]
        if gap:
            # the classes from small to large; one that has a document has it cut
            queue = next((q for q in reversed(self.queues) if q), None)
            if queue is None:
                return
            doc, start, length = queue.popleft()
            cut = min(gap, length)
            parts.append((doc, start, cut))
            if length > cut:
                self.queues[self._class(length - cut)].appendleft((doc, start + cut, length - cut))
            if gap > cut:
                self._fill(parts, gap - cut)

    def close(self) -> None:
        """Close every bin that has its class's fixed count and enough behind it to fill its gap."""
        for j in range(1, self.smallest + 1):
            queue = self.queues[j]
            while len(queue) >= j and self.held >= 2 * self.capacity:
                parts = [queue.popleft() for _ in range(j)]
                self._fill(parts, self.capacity - sum(p[2] for p in parts))
                self._lay(parts)

    def finish(self) -> None:
        """Lay what is left end to end; a last sequence that isn't full becomes powers of two."""
        self.close()
        parts, room = [], self.capacity if self.held >= self.capacity else 0
        for doc, start, length in [p for q in self.queues for p in q]:
            while length:
                if not room:
                    if parts:
                        self._lay(parts)
                    parts, room = [], self.capacity if self.held >= self.capacity else 1 << (self.held.bit_length() - 1)
                cut = min(room, length)
                parts.append((doc, start, cut))
                start, length, room = start + cut, length - cut, room - cut
        if parts:
            self._lay(parts)
        for q in self.queues:
            q.clear()

    def pieces(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 2, buffer_tokens: int = 1 << 21, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids themselves.

    A document's tokens are its ids and then end_id, so a null or empty text is one token
    (a null text counts as empty). Null and repeated ids pass through; each row is a document of its own. sequence_id is unique over all
    workers (the partition in its upper bits). Other columns are not read. An empty table has no pieces.
    """
    path = tokenizer or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, packer = encoder(path), Packer(capacity)
        base = TaskContext.get().partitionId() << 36

        def made():
            found = packer.pieces()
            cols = [pa.array([d[0] for d, *_ in found], id_type), pa.array([s for _, s, *_ in found], pa.int64()), pa.array([n for _, _, n, *_ in found], pa.int64())]
            cols.append(pa.array([zlib.crc32(memoryview(d[1])[4 * s : 4 * (s + n)]) for d, s, n, *_ in found], pa.int64()))
            cols += [pa.array([len(d[1]) // 4 for d, *_ in found], pa.int64()), pa.array([base + q for *_, q, _ in found], pa.int64()), pa.array([o for *_, o in found], pa.int64())]
            if with_ids:
                cols.append(pa.array([np.frombuffer(d[1], "<u4")[s : s + n].astype(np.int32) for d, s, n, *_ in found], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, names=names)

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            keys, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(list(map(len, texts)), 1 << 20):
                for key, ids in zip(keys[i:j], enc.encode(texts[i:j]), strict=True):
                    packer.add((key, ids + end), len(ids) // 4 + 1)
                    if packer.held >= buffer_tokens:
                        packer.close()
                    if len(packer.out) >= 10_000:
                        yield made()
        if id_type is not None:
            packer.finish()
            yield made()

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
