"""Packing token sequences into windows of equal size by Karmarkar-Karp differencing.

Every partition packs its own rows in one pass: no shuffle, and at most one
block of windows plus one document in memory. A null text is empty and still
has its end token; repeated rows are packed each; an empty table gives no
piece. Other columns are not read. The pieces of a lost task come out the same
when it runs again, as they depend on its rows only.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Tokens of a full sequence, the id that ends a document, and the windows that are balanced together.
CAPACITY, END, WINDOWS = 4096, 2, 64
#: Share of a window that the first number of windows fills on average, where cuts follow.
EVEN = 0.99
#: Word forms whose ids a worker keeps at once, and the longest it keeps (in bytes).
KEPT_FORMS, KEPT_BYTES = 1_200_000, 64
END_MARKS = ".,;:!?"
_TAIL = re.compile(rb"(?<=[A-Za-z0-9])[.,;:!?]+(?=[ \t-\r]|\Z)")
FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Piece(NamedTuple):
    """Tokens start to start + length of one document."""

    doc: int
    start: int
    length: int


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest for letters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids (little-endian unsigned 32-bit) of whole texts, equal to encoding each in one piece.

    This vocabulary drops white space and no token or normalisation reaches
    across it, so a text's ids are those of its parts between ASCII white
    space. Each form is encoded once and kept while there is room. A form of
    Latin letters, with or without marks at its end, goes to the tokenizer's
    model directly, as letters and end marks are always parted; other forms
    pass the whole tokenizer.
    """

    def __init__(self, path: str | None) -> None:
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.letters = _byte_letters()

    def ids(self, texts: Sequence[bytes]) -> Iterator[bytes]:
        if len(self.known) > KEPT_FORMS:
            self.known.clear()
        split = [self._parts(t) for t in texts]
        for x in set().union(*split):
            if x not in self.known and len(x) <= KEPT_BYTES:
                self.known[x] = self._form(x)
        find = self.known.__getitem__
        for parts in split:
            try:
                yield b"".join(map(find, parts))
            except KeyError:
                yield b"".join([self.known.get(x) or self._whole(x.decode("utf-8", "replace")) for x in parts])

    def _parts(self, text: bytes) -> list[bytes]:
        # The tokenizer lower-cases and parts letters and digits from marks anyway; doing it first leaves fewer forms.
        # Names of special tokens stay as they are.
        return _TAIL.sub(rb" \g<0>", text if b"<|" in text else text.lower()).split()

    def _form(self, form: bytes) -> bytes:
        text = form.decode("utf-8", "replace")
        word = text.rstrip(END_MARKS)
        if not (word.isalpha() and (word.isascii() or max(word) < "\u0250" and "\u0130" not in word)):
            return self._whole(text)
        raw = word.lower() if word.isascii() else word.lower().encode().decode("latin-1").translate(self.letters)
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(raw)])
        if len(word) == len(text):
            return ids
        marks = text[len(word):].encode()
        if marks not in self.known:
            self.known[marks] = self._whole(marks.decode())
        return ids + self.known[marks]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def _encoder(path: str | None) -> Encoder:
    return Encoder(path)


def differencing(sizes: Sequence[int], windows: int) -> list[list[int]]:
    """Deal items to ``windows`` parts with near-equal sums; gives the item numbers of each part.

    Multiway differencing: the two partial partitions with the largest spread
    are merged, the largest sums of one meeting the smallest of the other, until
    one partition is left. Ties go by age.
    """
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    age = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = windows - len(b)  # sums of a that meet an empty part of b
        parts = a[:free] + b[:windows - len(a)]
        parts += [(a[i][0] + b[windows - 1 - i][0], (a[i][1], b[windows - 1 - i][1])) for i in range(free, len(a))]
        parts.sort(key=lambda p: -p[0])
        spread = parts[0][0] - (parts[-1][0] if len(parts) == windows else 0)
        heapq.heappush(heap, (-spread, age, parts))
        age += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        items, open_ = [], [tree]
        while open_:
            x = open_.pop()
            if isinstance(x, tuple):
                open_ += x
            else:
                items.append(x)
        out.append(items)
    return out


def fill(pieces: Sequence[Piece], capacity: int, cut: bool) -> list[list[Piece]]:
    """Windows of at most ``capacity`` tokens that hold all pieces (each of at most ``capacity``).

    The number of windows rises while one exceeds the capacity; it begins with
    the least that leaves room for uneven windows. With ``cut`` the windows
    beyond the least that can hold all tokens, those that hold fewest, are
    then dissolved, and their pieces are cut to fill the others.
    """
    whole = [[p] for p in pieces if p.length == capacity]
    rest = [p for p in pieces if p.length < capacity]
    tokens = sum(p.length for p in rest)
    least = -(-tokens // capacity)
    count = max(least, -(-tokens // int(capacity * EVEN))) if cut else least
    while True:
        dealt = [[rest[i] for i in part] for part in differencing([p.length for p in rest], count)] if rest else []
        held = [sum(p.length for p in w) for w in dealt]
        over = sum(max(0, n - capacity) for n in held)
        if not over:
            break
        count += max(1, over // capacity)
    if not cut:
        return whole + [w for w in dealt if w]
    order = sorted(range(len(dealt)), key=lambda i: -held[i])
    excess = [p for i in order[least:] for p in dealt[i]]
    dealt, room = [dealt[i] for i in order[:least]], [[dealt[i], capacity - held[i]] for i in order[:least]]
    room += [[w, capacity] for w in ([] for _ in range(least - len(dealt)))]
    dealt += [w for w, _ in room[len(dealt):]]
    for window, free in room:
        while free and excess:
            p = excess.pop()
            taken = min(free, p.length)
            window.append(Piece(p.doc, p.start, taken))
            free -= taken
            if taken < p.length:
                excess.append(Piece(p.doc, p.start + taken, p.length - taken))
    return whole + [w for w in dealt if w]


def _split(doc: int, start: int, end: int, capacity: int) -> list[Piece]:
    return [Piece(doc, i, min(capacity, end - i)) for i in range(start, end, capacity)]


class Packer:
    """Collects documents and gives out blocks of full windows; the rest at the end."""

    def __init__(self, capacity: int, windows: int, cut: bool, first: int) -> None:
        self.capacity, self.block, self.cut, self.sequence = capacity, windows * capacity, cut, first
        self.docs: list[tuple[Any, bytes, int]] = []  # key, ids, tokens packed already
        self.held = 0

    def add(self, key: Any, ids: bytes) -> Iterator[list[tuple]]:
        self.docs.append((key, ids, 0))
        self.held += len(ids) // 4
        while self.held >= self.block:
            yield self._take(self.block)

    def end(self) -> Iterator[list[tuple]]:
        """What is left: full windows, then (where cuts are allowed) sequences of a power of two, without padding."""
        if not self.cut:
            if self.held:
                yield self._take(self.held)
            return
        if full := self.held // self.capacity * self.capacity:
            yield self._take(full)
        while self.held:
            yield self._take(1 << (self.held.bit_length() - 1))

    def _take(self, tokens: int) -> list[tuple]:
        """Rows of the next ``tokens`` tokens; without cuts, up to the end of the document."""
        used, pieces, left = 0, [], tokens
        for n, (_, ids, done) in enumerate(self.docs):
            size = len(ids) // 4 - done
            taken = min(size, left) if self.cut else size
            pieces += _split(n, done, done + taken, self.capacity)
            left -= taken
            used = n
            if left <= 0:
                break
        self.held -= sum(p.length for p in pieces)
        rows = []
        for window in fill(pieces, self.capacity, self.cut):
            at = 0
            for p in window:
                key, ids, _ = self.docs[p.doc]
                crc = zlib.crc32(memoryview(ids)[4 * p.start:4 * (p.start + p.length)])
                rows.append((key, p.start, p.length, crc, len(ids) // 4, self.sequence, at))
                at += p.length
            self.sequence += 1
        key, ids, done = self.docs[used]
        done = max([done, *(p.start + p.length for p in pieces if p.doc == used)])
        self.docs = ([(key, ids, done)] if done < len(ids) // 4 else []) + self.docs[used + 1:]
        return rows


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY,
         windows: int = WINDOWS, end: int = END, cut: bool = True) -> DataFrame:
    """One row per piece: the document's ``key``, the piece's tokens, its sequence and its offset there.

    ``tokenizer`` is a vocabulary file that every executor can read (default:
    the public word BPE). A document ends with the id ``end``; every id lies in
    exactly one piece. With ``cut``, documents are cut where that fills a
    window, and a partition's last tokens form sequences of powers of two, so
    nothing is padded. Without, only documents longer than ``capacity`` are cut.
    """
    source = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__llm_text"))
    schema = StructType([source.schema.fields[0], *(StructField(f, LongType()) for f in FIELDS)])
    stop = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        packer = Packer(capacity, windows, cut, TaskContext.get().partitionId() << 40)
        kind = pa.null()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encoder.ids(texts), strict=True):
                    for rows in packer.add(doc, ids + stop):
                        yield table(rows)
        for rows in packer.end():
            yield table(rows)

    return source.mapInArrow(run, schema)
