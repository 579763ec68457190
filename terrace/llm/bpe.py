"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token that is a
token itself. Tier two: other pre-tokens start as single bytes in a linked list; a heap
gives the adjacent pair of lowest rank, ties from the left, until no pair is a token.

Text is cut at spaces and line breaks that stand alone between two other characters before the
pattern splits it: there, a space always belongs to the pre-token on its right, and a line break
is one itself, so that the cut changes nothing. Each different piece is split and encoded once
per worker for as long as it is remembered, a word with a mark behind it as the word and the
mark. A text with any other arrangement of spaces is split as a whole.

The vocabulary (some 50,000 tokens, a fixed file) is broadcast. Nothing is shuffled.
NULL and empty texts have no tokens; repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Batches, Memo, batch, documents, encode_texts, mapped, slices

PIECES_REMEMBERED = 1 << 18
BYTES_AT_ONCE = 8 << 20
KEYS_PER_BUCKET = 4
MARKS = (",", ".", ";", ":", "!", "?")
MASK = (1 << 64) - 1
SPREAD, SCATTER = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9  # odd multipliers


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one probe.

    Keys fall into buckets; for each bucket, largest first, a displacement is found that
    sends its keys to free slots. A bucket of one key names its slot directly.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // KEYS_PER_BUCKET)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            members.setdefault(h % self.buckets, []).append(i)
        taken = np.zeros(n, bool)
        slots = np.zeros(n, np.int64)
        shift = np.zeros(self.buckets, np.int64)
        single = []
        for b, own in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                single.append((b, own[0]))
                continue
            own_hashes = np.array([hashes[i] for i in own], np.uint64)
            first = 0
            while True:
                tried = np.arange(first, first + 512, dtype=np.uint64) * np.uint64(SPREAD)
                mixed = (own_hashes[:, None] ^ tried) * np.uint64(SCATTER)
                found = (mixed >> np.uint64(32)).astype(np.int64) % n
                at = np.sort(found, axis=0)
                good = ~taken[at].any(axis=0) & (np.diff(at, axis=0) > 0).all(axis=0)
                if good.any():
                    shift[b] = first + int(good.argmax())
                    break
                first += 512
            slots[own] = found[:, shift[b] - first]
            taken[slots[own]] = True
        for (b, i), slot in zip(single, np.flatnonzero(~taken)):
            shift[b], slots[i] = -1 - slot, slot
        self.shift = shift.tolist()
        self.keys = [b""] * n
        for i, slot in enumerate(slots.tolist()):
            self.keys[slot] = keys[i]
        self.number = np.empty(n, np.int64)
        self.number[slots] = np.arange(n)
        self.number = self.number.tolist()

    def find(self, key: bytes) -> int:
        """The key's place in the list given, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        shift = self.shift[h % self.buckets]
        if shift < 0:
            slot = -1 - shift
        else:
            slot = ((h ^ shift * SPREAD & MASK) * SCATTER >> 32 & 0xFFFFFFFF) % self.n
        return self.number[slot] if self.keys[slot] == key else -1


class Codec:
    """Ranks and pattern of one vocabulary; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        tokens = sorted(ranks, key=ranks.get)
        self.ids = [ranks[t] for t in tokens]
        self.table = PerfectHash(tokens)
        self.token = ranks and {i: t for t, i in ranks.items()}
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.width = max(self.ids, default=0) + 1
        self.packed = [i.to_bytes(4, "little") for i in range(self.width)]
        empty = [-1] * 256
        self.rows = [empty] * 256  # by two bytes: the rank of the token that they are
        self.pairs = {}
        for whole in tokens:
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.width + right] = ranks[whole]
            if len(whole) == 2 and self.single[whole[0]] >= 0 <= self.single[whole[1]]:
                if self.rows[whole[0]] is empty:
                    self.rows[whole[0]] = list(empty)
                self.rows[whole[0]][whole[1]] = ranks[whole]

    def __getstate__(self):
        own = ("split", "memo", "bytes_of", "_break", "_marks")  # made by each worker
        return {k: v for k, v in self.__dict__.items() if k not in own}

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            rows = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(t): int(r) for t, r in rows}, pattern)

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        found = self.table.find(word)
        return [self.ids[found]] if found >= 0 else self.merge(word)

    def merge(self, word: bytes) -> list[int]:
        """Join adjacent tokens, lowest rank first, until no pair is a token."""
        pairs, width, n = self.pairs, self.width, len(word)
        bits = n.bit_length()
        place = (1 << bits) - 1  # an entry of the heap is a rank and the place of the left token
        rows = self.rows
        ids = [*map(self.single.__getitem__, word)]
        rank_at = [rows[a][b] for a, b in zip(word, word[1:])]
        rank_at.append(-1)
        heap = [r << bits | i for i, r in enumerate(rank_at) if r >= 0]
        if not heap:
            return ids
        heapify(heap)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & place
            rank = entry >> bits
            if rank_at[i] != rank:
                continue  # one of the two tokens has been joined to another since
            j = following[i]
            after = following[i] = following[j]
            ids[i] = rank
            ids[j] = rank_at[i] = rank_at[j] = -1
            if after < n:
                previous[after] = i
                key = rank * width + ids[after]
                if key in pairs:
                    new = rank_at[i] = pairs[key]
                    heappush(heap, new << bits | i)
            before = previous[i]
            if before >= 0:
                key = ids[before] * width + rank
                if key in pairs:
                    new = rank_at[before] = pairs[key]
                    heappush(heap, new << bits | before)
                else:
                    rank_at[before] = -1
        return [t for t in ids if t >= 0]

    def _piece(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, split by the pattern."""
        return b"".join(map(self._word, self.split(text)))

    def _word(self, word: str) -> bytes:
        return b"".join([self.packed[i] for i in self.encode_word(word.encode())])

    def _spaced(self, piece: str) -> bytes | None:
        """Ids of a space and the piece, None if white space would stand next to the space or
        to a line break; also of a line break and what follows, known by a space before it."""
        if piece.isalpha():  # one pre-token
            return self._word(" " + piece)
        if not piece:
            return None
        if piece[0] == " ":
            return self._break + self._piece(piece[2:])
        if "\n" in piece:  # standing alone it is a pre-token
            at = piece.rindex("\n")
            before, rest = piece[:at], piece[at + 1 :]
            if not before or not rest or rest[0].isspace() or rest[-1].isspace():
                return None
            before = self.memo[before]
            return before and before + self.memo[" \n" + rest]
        if piece[-1] in MARKS and piece[:-1].isalpha():
            return self.memo[piece[:-1]] + self._marks[piece[-1]]
        if piece[0].isspace() or piece[-1].isspace():
            return None
        return self._piece(" " + piece)

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if "memo" not in self.__dict__:
            self.split = regex.compile(self.pattern).findall
            self.memo = Memo(self._spaced, PIECES_REMEMBERED)
            self._break, self._marks = self._word("\n"), {m: self._word(m) for m in MARKS}
        return encode_texts(texts, self.memo, self._piece, self._piece)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The bytes that each row of ids (binary) stands for: token bytes, laid end to end."""
        if "bytes_of" not in self.__dict__:
            self.bytes_of = pa.array(map(self.token.get, range(self.width)), pa.large_binary())
        rows = ids.fill_null(b"").cast(pa.large_binary())
        ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
        if not len(rows) or ends[-1] == ends[0]:
            return pa.array([b""] * len(rows), pa.large_binary())
        flat = np.frombuffer(rows.buffers()[2], "<u4", count=int(ends[-1]) // 4)
        tokens = self.bytes_of.take(pa.array(flat))
        places = np.frombuffer(tokens.buffers()[1], np.int64)[: len(flat) + 1]
        offsets = pa.py_buffer(places[ends // 4].tobytes())
        return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, offsets, tokens.buffers()[2]])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return self.decode_all(pa.array([ids], pa.binary()))[0].as_py()


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (binary: little-endian unsigned 32-bit) of every text; with
    ``decoded`` also the bytes that the ids stand for, by the same pass."""
    held = docs.sparkSession.sparkContext.broadcast(Codec.load(path, pattern))

    def run(batches: Batches) -> Batches:
        codec = held.value
        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                ids = codec.encode_all(b["text"])
                more = {"decoded": codec.decode_all(ids).cast(pa.binary())} if decoded else {}
                yield batch(doc_id=b["doc_id"], ids=ids.cast(pa.binary()), **more)

    out = mapped(documents(docs), run, "doc_id bigint, ids binary" + ", decoded binary" * decoded)
    n_tokens = (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return out.select("doc_id", n_tokens, *out.columns[1:])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) to rows with ``ids``; NULL ids stand for nothing."""
    held = encoded.sparkSession.sparkContext.broadcast(Codec.load(path, pattern))
    columns = encoded.select("doc_id", "n_tokens", "ids")

    def run(batches: Batches) -> Batches:
        codec = held.value
        for whole in batches:
            for b in slices(whole, "ids", BYTES_AT_ONCE):
                columns = [*b.columns, codec.decode_all(b["ids"]).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "decoded"])

    return mapped(columns, run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
