"""Byte-level BPE as a finite-state transducer that is made deterministic while it runs.

A sequence of tokens is the encoding of its bytes exactly if each two
neighbours are (``Merges.compatible``), so a transducer that reads bytes may
guess where tokens end and needs to remember its last token only. ``Encoder``
runs all guesses at once: a state is the tree of tokens that are still
undecided, with the place in the vocabulary's trie of each guess that is
open. A token is emitted as soon as all open guesses agree on it, after a
lookahead that the merges bound. States and moves are made when first met and
kept; when there are too many, all are forgotten but those in use.

Decoding is streamed: ``Decoder`` takes tokens in any pieces and hands on whole
characters, by a state machine over UTF-8 lead and continuation bytes whose
moves over a token are kept as well.

Null and empty texts have no tokens. Repeated rows are encoded each; long
texts and long words are read byte by byte in bounded memory. Other columns are
never read, so clashing names are harmless; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from .arrow import map_texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: States of the transducer, and encoded pieces of text, that a task keeps; pieces longer than LONG bytes are not kept.
STATES, PIECES, LONG = 350_000, 600_000, 64
#: Guesses are tested for a token to go on with where so many or fewer are left.
FEW = 8
_NONE = -1


class Merges:
    """A vocabulary of ranks: token of bytes, merges by lowest rank first, leftmost among equals."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no token")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._edges: dict[tuple[int, bool], list[tuple[bytes, int, float]] | None] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of a short piece, by the merges themselves."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min((r for r in found if r is not None), default=None)
            if best is None:
                break
            i = found.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int, float]] | None:
        """The parts that stand at one end of a token while it is merged: (bytes, made at rank, merged on at rank), the token first.

        None if the merges make some part later than what it is merged into.
        """
        key = token, right
        if key not in self._edges:
            found, data, until = [], self.bytes_of[token], float("inf")
            while found is not None:
                made = self.ranks[data] if len(data) > 1 else -1
                if made >= until:
                    found = None
                    break
                found.append((data, made, until))
                if len(data) == 1:
                    break
                parts = self.last_merge(data)
                if parts is None:
                    found = None
                else:
                    data, until = parts[right], made
            self._edges[key] = found
        return self._edges[key]

    def last_merge(self, data: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes a token; None if the merges make it otherwise."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            found = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min((r for r in found if r is not None), default=None)
            if best is None:
                return None
            i = found.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether both tokens stay as they are when they stand side by side.

        They do if no part at the end of one and no part at the start of the
        other, there at one time, would be merged before either goes on; of
        equal ranks the left one is first.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            ends, starts = self.edge(left, True), self.edge(right, False)
            if ends is None or starts is None:
                known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            else:
                known, rank = True, self.ranks.get
                # Parts of both that are there at one time, from the last ones backwards.
                i = j = 0
                while True:
                    (a, made, until), (b, made_b, until_b) = ends[i], starts[j]
                    across = rank(a + b)
                    if across is not None and across < until and across <= until_b:
                        known = False
                        break
                    if made < 0 and made_b < 0:
                        break
                    if made > made_b:
                        i += 1
                    else:
                        j += 1
            self._pairs[key] = known
        return known

    def forget(self) -> None:
        self._pairs.clear()


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base 64 and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """The transducer of a vocabulary.

    A state is a tuple of guesses, three numbers each: the token that ends
    where the guess began (``_NONE`` at the start of a piece), the guess in which
    that token began, and the place in the trie of the bytes since then;
    ``_NONE`` if no token goes on that way and others only begin in it. The
    first guess is the one all others come from; tokens up to it have been
    emitted.
    """

    def __init__(self, merges: Merges, states: int = STATES):
        self.merges, self.most = merges, states
        self.lookahead = 0
        # Only tokens that the merges can make; others stand for whole pieces alone.
        self.children: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        #: The few longer tokens below a node; nodes that are not named have many.
        self.longer: dict[int, list[int]] = {}
        below: dict[int, int] = {}
        for token, rank in merges.ranks.items():
            if len(token) > 1 and merges.merged(token) != [rank]:
                continue
            node = 0
            for b in token:
                below[node] = below.get(node, 0) + 1
                node = self.children.setdefault(node << 8 | b, nodes)
                if node == nodes:
                    nodes += 1
            self.token_at[node] = rank
        for rank in self.token_at.values():
            node = 0
            for b in merges.bytes_of[rank]:
                if below[node] <= FEW:
                    self.longer.setdefault(node, []).append(rank)
                node = self.children[node << 8 | b]
            self.longer.setdefault(node, []) if node not in below else None
        self._clear()

    def _clear(self) -> None:
        self.merges.forget()
        self.fits: dict[int, bool] = {}
        self.number: dict[tuple, int] = {}
        self.guesses: list[tuple] = []
        self.final: list[tuple[int, ...]] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._state((_NONE, 0, 0))

    def _state(self, key: tuple) -> int:
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.guesses)
            self.guesses.append(key)
            pending, at = [], len(key) - 3
            while at:
                pending.append(key[at])
                at = 3 * key[at + 1]
            self.lookahead = max(self.lookahead, len(pending))
            self.final.append(tuple(pending[::-1]))
        return number

    def _goes_on(self, token: int, node: int) -> bool:
        """Whether one of the few longer tokens with the node's bytes fits after ``token``."""
        known = self.fits[token << 24 | node] = any(self.merges.compatible(token, t) for t in self.longer[node])
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens that are decided by then."""
        child, key, longer, fits = self.children.get, self.guesses[state], self.longer.get, self.fits.get
        tokens, parents = list(key[::3]), list(key[1::3])
        nodes = [child(node << 8 | byte, _NONE) if node >= 0 else _NONE for node in key[2::3]]
        ends = None
        for at, node in enumerate(nodes):
            if node < 0:
                continue
            token = tokens[at]
            if ends is None:
                # Exactly one guess ends here in a token that fits the one before.
                found = self.token_at.get(node)
                if found is not None and (token < 0 or self.merges.compatible(token, found)):
                    ends, last = at, found
            few = longer(node)
            if few is not None and not (few if token < 0 else self._goes_on(token, node) if (known := fits(token << 24 | node)) is None else known):
                nodes[at] = _NONE
        tokens.append(last), parents.append(ends), nodes.append(0)
        # Guesses that are open, and those that open ones come from.
        followers, kept = [0] * len(nodes), []
        for at in range(len(nodes) - 1, 0, -1):
            if nodes[at] >= 0 or followers[at]:
                kept.append(at)
                followers[parents[at]] += 1
        kept.append(0)
        kept.reverse()
        # The first guess goes on to its only follower as long as it is closed itself.
        first = 0
        while nodes[kept[first]] < 0 and followers[kept[first]] == 1:
            first += 1
        # From here on ``followers`` holds the new places.
        at = kept[first]
        followers[at], after = 0, [tokens[at], 0, nodes[at]]
        for i, at in enumerate(kept[first + 1:], 1):
            followers[at] = i
            after += (tokens[at], followers[parents[at]], nodes[at])
        return self._state(tuple(after)), tuple([tokens[at] for at in kept[1:first + 1]]) if first else ()

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece of text."""
        if len(self.guesses) > self.most:
            self._clear()
        moves, state, out = self.moves, self.start, []
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = moves[state << 8 | byte] = self._move(state, byte)
            state, decided = move
            if decided:
                out += decided
        out += self.final[state]
        return out

    def tokens(self, piece: Iterable[int]) -> Iterator[int]:
        """The tokens of bytes, each as soon as it is decided, in bounded memory."""
        state = self.start
        for byte in piece:
            move = self.moves.get(state << 8 | byte)
            if move is None:
                if len(self.guesses) > self.most:
                    held = self.guesses[state]
                    self._clear()
                    state = self._state(held)
                move = self.moves[state << 8 | byte] = self._move(state, byte)
            state, decided = move
            if decided:
                yield from decided
        yield from self.final[state]


class Tokenizer:
    """Texts to tokens and back, as the ranks and the pattern that cuts texts into pieces say."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, states: int = STATES, pieces: int = PIECES):
        self.ranks, self.pieces = ranks, pieces
        self.encoder = Encoder(Merges(ranks), states)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """The tokens of a piece, 32 bits each."""
        data = piece.encode()
        # A piece that is a token is that token, whether or not the merges make it.
        whole = self.ranks.get(data)
        if whole is not None:
            tokens = [whole]
        else:
            tokens = self.encoder.encode(data) if len(data) <= LONG else self.encoder.tokens(data)
        found = array("I", tokens).tobytes()
        if len(data) <= LONG:
            if len(self.known) >= self.pieces:
                self.known.clear()
            self.known[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        known, piece = self.known, self._piece
        return np.frombuffer(b"".join([known.get(p) or piece(p) for p in self.find(text)]), np.uint32)


def _utf8_moves() -> list[list[int]]:
    """State of the decoder after each byte: 0 between characters, 8 in bytes that are none; others wait for continuation bytes.

    1 to 3 wait for so many of any kind, 4 to 7 for one in a narrower range
    first (after E0, ED, F0 and F4).
    """
    moves = [[8] * 256 for _ in range(9)]
    for first, last, state in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE1, 0xEF, 2), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xF1, 0xF3, 3), (0xF0, 0xF0, 6),
                               (0xF4, 0xF4, 7)):
        moves[0][first:last + 1] = [state] * (last + 1 - first)
    for state, first, last, then in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1),
                                     (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        moves[state][first:last + 1] = [then] * (last + 1 - first)
    return moves


_UTF8 = _utf8_moves()
_ILL = 8


class Decoder:
    """Tokens to bytes, cut between characters wherever the bytes are UTF-8.

    What is no UTF-8 passes byte by byte, and ``well_formed`` turns false.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.state, self.held, self.well_formed = 0, b"", True

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of whole characters that these tokens complete."""
        words, own = self.vocabulary.bytes_of, self.vocabulary.whole
        if not self.state and own[ids].all():
            return b"".join([words[i] for i in ids.tolist()])
        # Between characters, tokens of whole characters pass as they are.
        out, tokens, at, size = [], ids.tolist(), 0, len(ids)
        parts = [*np.flatnonzero(~own[ids]).tolist(), size]
        next_part = iter(parts)
        part = next(next_part)
        while at < size:
            if not self.state:
                while part < at:
                    part = next(next_part)
                out += [words[i] for i in tokens[at:part]]
                at = part
                if at == size:
                    break
            self.state, done, rest, ill = self.vocabulary.over(self.state, tokens[at])
            at += 1
            if done is None:
                self.held += rest
            else:
                out += [self.held, done]
                self.held = rest
            self.well_formed &= not ill
        return b"".join(out)

    def finish(self) -> bytes:
        """What is left of a character that did not end."""
        rest, self.held = self.held, b""
        self.well_formed &= not self.state
        self.state = 0
        return rest


class Vocabulary:
    """The tokens of a vocabulary with their moves over the decoder's states."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.whole = np.zeros(max(self.bytes_of) + 1, bool)
        self.moves: dict[tuple[int, int], tuple] = {}
        for rank in self.bytes_of:
            state, _, rest, ill = self.over(0, rank)
            self.whole[rank] = not state and not ill

    def over(self, state: int, token: int) -> tuple[int, bytes | None, bytes, bool]:
        """The state after a token; its bytes up to the last end of a character (None if none ends) and after; whether some are no UTF-8."""
        key = state, token
        if key not in self.moves:
            data, end, ill = self.bytes_of[token], None, False
            if not state:
                end = 0
            for i, byte in enumerate(data):
                after = _UTF8[state][byte]
                if after == _ILL:
                    # The character so far is none; this byte may begin another.
                    ill, after = True, _UTF8[0][byte]
                    end = i
                    if after == _ILL:
                        after = 0
                state = after
                if not state:
                    end = i + 1
            self.moves[key] = (state, None, data, ill) if end is None else (state, data[:end], data[end:], ill)
        return self.moves[key]


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> tuple[Tokenizer, Vocabulary]:
    ranks = read_ranks(path)
    return Tokenizer(ranks, pattern), Vocabulary(ranks)


@contextmanager
def _uncollected() -> Iterator[None]:
    """States are many small tuples without cycles: the collector would only walk over them, now and later."""
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        gc.enable()


#: Tokens that are decoded at once.
_AT_ONCE = 65_536


def decode(ids: Sequence[int] | np.ndarray, vocabulary: Vocabulary) -> Iterator[bytes]:
    """The bytes of the tokens in pieces of whole characters."""
    ids, decoder = np.asarray(ids, np.uint32), Decoder(vocabulary)
    for i in range(0, len(ids), _AT_ONCE):
        yield decoder.feed(ids[i:i + _AT_ONCE])
    yield decoder.finish()


def encode_texts(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The ``keep`` columns and the token ``ids`` of each whole text.

    ``path`` names the vocabulary file on every executor.
    """
    place = path or public_tokenizers.path(VOCABULARY)

    def make(texts: list[bytes | None]) -> list[pa.Array]:
        tokenizer = _loaded(place, pattern)[0]
        with _uncollected():
            found = [tokenizer.encode((t or b"").decode("utf-8", "replace")) for t in texts]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint32), *found]).astype(np.int32), pa.int32()))]

    return map_texts(df, text, keep, [StructField("ids", ArrayType(IntegerType()))], make)


def decode_ids(df: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """The ``keep`` columns, the decoded ``text`` (U+FFFD for what is no UTF-8), and whether it is ``well_formed``; null ids stay null."""
    place = path or public_tokenizers.path(VOCABULARY)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").cast("array<int>").alias("__llm_ids"))
    schema = source.drop("__llm_ids").schema.add("text", StringType()).add("well_formed", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(place, public_tokenizers.PATTERN)[1]
        for batch in batches:
            texts, fine = [], []
            for row in batch.column(batch.num_columns - 1):
                if not row.is_valid:
                    texts.append(None), fine.append(None)
                    continue
                data = b"".join(decode(row.values.to_numpy(zero_copy_only=False), vocabulary))
                texts.append(data.decode("utf-8", "replace"))
                fine.append(texts[-1].encode() == data)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(fine, pa.bool_())], names=schema.names)

    return source.mapInArrow(run, schema)


def round_trip(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The ``keep`` columns, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers), and decoded_sha256 of the decoded bytes."""
    place = path or public_tokenizers.path(VOCABULARY)

    def make(texts: list[bytes | None]) -> list[pa.Array]:
        tokenizer, vocabulary = _loaded(place, pattern)
        n, marks, decoded = [], [], []
        with _uncollected():
            for t in texts:
                ids = tokenizer.encode((t or b"").decode("utf-8", "replace"))
                n.append(len(ids))
                marks.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back = hashlib.sha256()
                for data in decode(ids, vocabulary):
                    back.update(data)
                decoded.append(back.hexdigest())
        return [pa.array(n, pa.int64()), pa.array(marks, pa.string()), pa.array(decoded, pa.string())]

    return map_texts(df, text, keep, [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                                      StructField("decoded_sha256", StringType())], make)
