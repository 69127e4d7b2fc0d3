"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming UTF-8 decoding.

Encoding. For a vocabulary in which every token encodes to itself, the encoding of a byte string is the chain of last
tokens of its prefixes: the last token of a prefix is the one token t that ends there, is compatible with the last
token of the prefix before t (merging the two gives back just those two), and only one such t exists. So a reader
needs the longest end of what it has read from which a vocabulary token could still grow, and the last tokens at the
boundaries inside that end. Those are the transducer's state. Its moves on bytes are determinised lazily: a step is
worked out when first needed and remembered, in a store that is emptied when it is full. A token is settled as soon as
all live boundaries agree on it; beyond HELD bytes, settled tokens are emitted and forgotten.

Tokens that don't encode to themselves can't occur in any encoding and are left out of the trie.

Pieces of up to SHORT_PIECE characters are remembered with their ids, in a bounded memo.

Defined cases: null text encodes as the empty text; an empty text has no tokens; a piece of any length is read byte by
byte, holding the bounded stores and the ids that it gives; null ids and ids outside the vocabulary raise ValueError
when they are decoded; a null list of ids decodes to null; bytes that aren't UTF-8 decode to U+FFFD; repeated rows give
a row each; an empty table gives an empty one; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, text_bytes, tune

#: Remembered steps and token pairs of the transducer, and remembered pieces, of one worker.
MOST_STEPS = 200_000
MOST_PAIRS = 200_000
MOST_PIECES = 180_000
#: Bytes that are read before settled tokens are looked for.
HELD = 512
#: Tokens that decoding takes at a time.
DECODED_AT_ONCE = 1 << 16
#: Pieces up to this many characters are remembered whole.
SHORT_PIECE = 64
END = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], never: bytes | None = None) -> list[bytes]:
    """Plain BPE of one short piece: merge the leftmost pair of lowest rank until none is left; `never` isn't made."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((END if (pair := parts[i] + parts[i + 1]) == never else ranks.get(pair, END), i) for i in range(len(parts) - 1))
        if rank == END:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """bytes -> token ids, left to right.

    The state is a node of the tokens' trie, for the longest end of the input that can still grow into a token, and the
    last tokens at the boundaries inside that end. A step on a byte goes down the trie, or first to the node of a shorter
    end; which one is worked out when the step is first needed, and remembered. At the new node the tokens that end here
    are known, longest first; the one that fits the last token before it is the last token here.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.pack = {i: i.to_bytes(4, "little") for i in ranks.values()}
        self.child: dict[int, int] = {}  # node << 8 | byte
        self.token, self.depth, self.parent, self.byte = [-1], [0], [0], [0]
        for t, i in ranks.items():
            node = 0
            for depth, b in enumerate(t, 1):
                up, node = node, self.child.setdefault(node << 8 | b, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.depth.append(depth)
                    self.parent.append(up)
                    self.byte.append(b)
            self.token[node] = i
        self.shorter: list[int | None] = [None] * len(self.token)  # the node of the longest proper end that is one
        self.ending: list[tuple | None] = [None] * len(self.token)  # (token, size) of all tokens that end here
        self.ending[0] = ()
        self.steps: dict[int, int] = {}
        self._spines: dict[int, tuple] = {}
        self._pairs: dict[int, bool] = {}

    def _spine(self, i: int) -> tuple[bool, list, list]:
        """Whether token i encodes to itself; the parts at its right and at its left edge while it is merged, from the
        single byte up, each with the rank of the merge that ends it."""
        if (known := self._spines.get(i)) is None:
            whole = self.bytes_of[i]
            if len(whole) == 1:
                known = True, [(whole, END)], [(whole, END)]
            else:
                parts = merge_by_rank(whole, self.ranks, whole)
                if len(parts) != 2:
                    known = False, [], []
                else:
                    right, left = self._spine(self.ranks[parts[1]])[1], self._spine(self.ranks[parts[0]])[2]
                    known = True, [*right[:-1], (right[-1][0], i), (whole, END)], [*left[:-1], (left[-1][0], i), (whole, END)]
            self._spines[i] = known
        return known

    def whole(self, i: int) -> bool:
        return self._spine(i)[0]

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b can stand side by side: no merge across their border comes before both are made.

        The parts at the border live side by side until the one whose own merge has the lower rank goes up; a merge of
        the two would have to come first. Of equal ranks the merge further left comes first.
        """
        known = self.whole(b)
        if a >= 0 and known:
            ranks, right, left = self.ranks, self._spine(a)[1], self._spine(b)[2]
            i = j = 0
            while True:
                (p, p_ends), (q, q_ends) = right[i], left[j]
                across = ranks.get(p + q, END)
                if across < p_ends and across <= q_ends and across != END:
                    known = False
                    break
                if p_ends == END and q_ends == END:
                    break
                if p_ends <= q_ends:
                    i += 1
                else:
                    j += 1
        if len(self._pairs) >= MOST_PAIRS:
            self._pairs.clear()
        self._pairs[a << 24 | b] = known
        return known

    def _down(self, node: int, byte: int) -> int:
        """The node of the longest end of (the node's bytes, byte) that is in the trie."""
        while (to := self.child.get(node << 8 | byte)) is None and node:
            node = self._shorter(node)
        return to or 0

    def _shorter(self, node: int) -> int:
        path = []
        while self.shorter[node] is None:
            if self.depth[node] < 2:
                self.shorter[node] = 0
            elif self.shorter[up := self.parent[node]] is None:
                path.append(node)
                node = up
                continue
            else:
                self.shorter[node] = self._down(self.shorter[up], self.byte[node])
            if path:
                node = path.pop()
        return self.shorter[node]

    def _learn(self, node: int, byte: int) -> int:
        if len(self.steps) >= MOST_STEPS:
            self.steps.clear()
        to = self.steps[node << 8 | byte] = self._down(node, byte)
        n, path = to, []
        while self.ending[n] is None:
            path.append(n)
            n = self._shorter(n)
        for n in reversed(path):
            t, rest = self.token[n], self.ending[self.shorter[n]]
            self.ending[n] = ((t, self.size[t]), *rest) if t >= 0 and self.whole(t) else rest
        return to

    def _advance(self, part: bytes, node: int, last: list[int]) -> int:
        """Reads a part from a node on; `last` holds the last token at each boundary and gets the new ones."""
        steps, pairs, ending = self.steps, self._pairs, self.ending
        n = len(last)
        for i, byte in enumerate(part, n):
            to = steps.get(node << 8 | byte)
            node = to if to is not None else self._learn(node, byte)
            for token, size in ending[node]:
                key = last[i - size] << 24 | token
                fit = pairs.get(key)
                if fit if fit is not None else self.fits(key >> 24, token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return node

    def _chain(self, last: list[int], at: int) -> list[int]:
        """The boundaries between the tokens of the first `at` bytes, latest first."""
        found = [at]
        while at:
            at -= self.size[last[at]]
            found.append(at)
        return found

    def _packed(self, last: list[int], at: int) -> bytes:
        out = []
        while at:
            token = last[at]
            out.append(self.pack[token])
            at -= self.size[token]
        return b"".join(out[::-1])

    def _settled(self, last: list[int], node: int) -> int:
        """The latest boundary that every encoding still possible has."""
        common = set(self._chain(last, len(last) - 1))
        for at in range(len(last) - 1 - self.depth[node], len(last) - 1):
            common &= set(self._chain(last, at))
        return max(common)

    def stream(self, parts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of one piece that comes in parts, as little-endian 32-bit integers, as soon as they are settled."""
        node, last = 0, [-1]
        for part in parts:
            for k in range(0, len(part), HELD):
                node = self._advance(part[k : k + HELD], node, last)
                if len(last) > HELD and (at := self._settled(last, node)):
                    yield self._packed(last, at)
                    del last[:at]
        yield self._packed(last, len(last) - 1)

    def packed(self, piece: bytes) -> bytes:
        """The ids of a whole piece."""
        if len(piece) > HELD:
            return b"".join(self.stream((piece,)))
        last = [-1]
        self._advance(piece, 0, last)
        return self._packed(last, len(piece))


class Pieces(dict):
    """piece -> packed ids, for short pieces. When it is full, what was used since the last time stays."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.older = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = self.transducer.packed(piece.encode())
        if len(piece) <= SHORT_PIECE:
            if len(self) >= MOST_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


    def forget(self) -> None:
        """Empties the memo: a worker that waits should hold little."""
        self.older = {}
        self.clear()


class Encoder:
    """Whole texts -> packed ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = Pieces(Transducer(ranks))
        # Python's \s also takes 0x1C-0x1F, which aren't white space to Unicode
        self.pattern = regex.compile(pattern.replace(r"[^\s\p", r"[^\p{White_Space}\p").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})"))
        # the same pattern for texts below U+0250 in the faster built-in engine, if it only uses the known classes
        self.fast = None
        if re.search(r"\\[a-zA-Z]", re.sub(r"\\p\{[LN]\}|\\[sS]", "", pattern)) is None:
            chars = [chr(c) for c in range(0x250)]

            def ranges(p: str) -> str:
                return "".join(re.escape(c) for c in chars if regex.fullmatch(p, c))

            letters, numbers, spaces = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\p{White_Space}")
            own = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
            if "\\p" not in own:
                self.fast, self.beyond = re.compile(own), re.compile("[^\0-\u024f]")

    def packed(self, text: str) -> bytes:
        pattern = self.fast if self.fast and not self.beyond.search(text) else self.pattern
        return b"".join(map(self.pieces.__getitem__, pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()


#: Bytes that a sequence still needs after its first byte, by that byte's class; others are invalid there.
def _need(byte: int) -> int:
    return 0 if byte < 0x80 else 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 <= byte <= 0xEF else 3 if 0xF0 <= byte <= 0xF4 else -1


class Utf8Stream:
    """Incremental UTF-8: `feed` gives the text that is complete so far and holds back an unfinished sequence.

    The state is that unfinished sequence, of three bytes at most. Invalid bytes become U+FFFD, as by the codec.
    """

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[cut - back]
            if byte & 0xC0 != 0x80:
                if _need(byte) >= back and self._may_follow(data[cut - back :]):
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _may_follow(part: bytes) -> bool:
        """Whether the second byte, if there, is one that the first allows (no overlong form, surrogate or overflow)."""
        if len(part) < 2:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(part[0], (0x80, 0xBF))
        return low <= part[1] <= high

    def end(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class Decoder:
    """Token ids -> text. The bytes of a run of ids are taken from the vocabulary in one go."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=-1) + 1
        by_id: list[bytes | None] = [None] * self.size
        for t, i in ranks.items():
            by_id[i] = t
        self.bytes_of = pa.array(by_id, pa.binary())

    def taken(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= self.size:
            raise ValueError(f"no token has the id {ids[(ids < 0) | (ids >= self.size)][0]}")
        found = self.bytes_of.take(pa.array(ids))
        if found.null_count:
            raise ValueError(f"no token has the id {ids[found.is_null().to_numpy(zero_copy_only=False)][0]}")
        ends = np.frombuffer(found.buffers()[1], np.int32)
        return found.buffers()[2][int(ends[found.offset]) : int(ends[found.offset + len(found)])].to_pybytes()

    def stream(self, ids: Iterable[int] | np.ndarray, chunk: int = DECODED_AT_ONCE) -> Iterator[str]:
        """The text, a chunk of tokens at a time."""
        held = Utf8Stream()
        if isinstance(ids, np.ndarray):
            parts = (ids[k : k + chunk] for k in range(0, len(ids), chunk))
        else:
            source = iter(ids)
            parts = (np.array(x, np.int64) for x in iter(lambda: list(islice(source, chunk)), []))
        for part in parts:
            yield held.feed(self.taken(part))
        yield held.end()

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.stream(ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_DECODERS: dict[str, Decoder] = {}


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", into: str = "token_ids", keep_text: bool = True) -> DataFrame:
    """Adds the token ids of each whole text. A column named `into` is replaced; without `keep_text` the text goes."""
    tune(docs.sparkSession)
    kept = [c for c in docs.columns if c != into and (keep_text or c != text_col)]
    data = fresh(docs.columns, "text_bytes")
    source = docs.select(*kept, text_bytes(text_col).alias(data))
    schema = source.drop(data).schema.add(into, T.ArrayType(T.IntegerType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ranks_path, pattern
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(load_ranks(ranks_path), pattern)
        encoder = _ENCODERS[key]
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                packed = [encoder.packed((x.as_py() or b"").decode("utf-8", "replace")) for x in batch.column(len(kept))]
                offsets = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], ids], names=[*kept, into])
        encoder.pieces.forget()

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Adds the text of a column of token ids. A column named `into` is replaced."""
    tune(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != into]
    if ids_col in kept:
        source, at = encoded.select(*kept), kept.index(ids_col)
    else:
        source, at = encoded.select(*kept, F.col(ids_col).alias(fresh(kept, "ids"))), len(kept)
    schema = encoded.select(*kept).schema.add(into, "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks_path not in _DECODERS:
            _DECODERS[ranks_path] = Decoder(load_ranks(ranks_path))
        decoder = _DECODERS[ranks_path]
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = []
                for x in batch.column(at):
                    if x.is_valid and x.values.null_count:
                        raise ValueError("no token has the id null")
                    texts.append(decoder.decode(x.values.to_numpy()) if x.is_valid else None)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, into])

    return source.mapInArrow(run, schema)
