"""Packing by powers of two: no sequence crosses documents, and none is padded.

The ids of a document, its closing id included, are cut into as many pieces of the longest
length as fit, then one piece for each binary digit of the rest. Every piece is a sequence
of its own; sequences of equal length share a bucket, from which batches of one shape are
read. Lengths are powers of two, so nothing is padded.

Each row is cut where it is read: nothing is shuffled. NULL and empty texts are one piece,
the closing id. Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Batches, Memo, batch, documents, encode_texts, kept, mapped, slices

LONGEST = 1024
END = 0
PIECES_REMEMBERED = 1 << 18
BYTES_AT_ONCE = 8 << 20
MARKS = (",", ".", ";", ":", "!", "?")


def byte_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if it is
    printable and no space, else the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenized:
    """Ids of whole texts by a byte-level tokenizer of the ``tokenizers`` library.

    A space that stands alone between two other characters always begins the pre-token on
    its right, and a line break there is one itself (byte-level pre-tokenizers split so). The
    pieces between are encoded once and remembered: one of letters only is a single pre-token,
    which goes to the tokenizer's model at once; one with a mark behind is that and the mark;
    others are split by ``pattern``, the tokenizer's own. Texts with any other arrangement of
    spaces are encoded whole. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.split = regex.compile(pattern).findall
        self.shown = byte_characters()
        self.space = self.shown[32]
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pieces = Memo(self._piece, PIECES_REMEMBERED)
        self.line_break, self.marks = self._word("\n"), {m: self._word(m) for m in MARKS}

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        if word.isascii() and word[1:].isalpha() and word[0] == " ":
            shown = self.space + word[1:]
        else:
            shown = word.encode().decode("latin-1").translate(self.shown)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(shown)])

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a space and the piece, None if white space would stand next to the space or
        to a line break; also of a line break and what follows, known by a space before it."""
        if piece.isalpha():
            return self._word(" " + piece)
        if not piece:
            return None
        if piece[0] == " ":
            return self.line_break + self.split_first(piece[2:])
        if "\n" in piece:  # standing alone it is a pre-token
            at = piece.rindex("\n")
            before, rest = piece[:at], piece[at + 1 :]
            if not before or not rest or rest[0].isspace() or rest[-1].isspace():
                return None
            before = self.pieces[before]
            return before and before + self.pieces[" \n" + rest]
        if piece[-1] in MARKS and piece[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.marks[piece[-1]]
        if piece[0].isspace() or piece[-1].isspace():
            return None
        return self.split_first(" " + piece)

    def split_first(self, text: str) -> bytes:
        return b"".join(map(self._word, self.split(text)))

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(map(self.packed.__getitem__, ids))

    def encode_all(self, texts: pa.Array, last: bytes = b"") -> pa.Array:
        """Ids of texts as little-endian unsigned 32-bit integers, each followed by ``last``."""
        return encode_texts(texts, self.pieces, self.split_first, self.whole, last)

    def __call__(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()


def tokenized(path: str, pattern: str) -> Tokenized:
    """The tokenizer of a file, loaded once per worker."""
    return kept((Tokenized, path, pattern), lambda: Tokenized(path, pattern))


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to n: the longest as often as it fits, then falling."""
    rest = n % longest
    digits = [1 << k for k in reversed(range(longest.bit_length())) if rest >> k & 1]
    return [longest] * (n // longest) + digits


def decompose(docs: DataFrame, path: str, pattern: str, longest: int = LONGEST) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket (the power), ids (binary)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")

    def run(batches: Batches) -> Batches:
        encode = tokenized(path, pattern)
        end = np.array([END], "<u4").tobytes()
        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                ids = encode.encode_all(b["text"], end)
                sizes = np.diff(np.frombuffer(ids.buffers()[1], np.int64)) // 4
                cuts = [binary_lengths(n, longest) for n in sizes.tolist()]
                pieces = np.array([len(own) for own in cuts])
                length = np.array([n for own in cuts for n in own], np.int64)
                ends = np.append(0, np.cumsum(length))  # pieces lie end to end, as the texts do
                first = np.repeat(np.cumsum(sizes) - sizes, pieces)
                offsets = pa.py_buffer((4 * ends).tobytes())
                laid = [None, offsets, ids.buffers()[2]]
                yield batch(
                    doc_id=b["doc_id"].take(pa.array(np.repeat(np.arange(b.num_rows), pieces))),
                    start=ends[:-1] - first,
                    length=length,
                    doc_tokens=np.repeat(sizes, pieces),
                    bucket=np.log2(length).astype(np.int32),
                    ids=pa.Array.from_buffers(pa.large_binary(), len(length), laid).cast(pa.binary()),
                )

    schema = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, bucket int, ids binary"
    return mapped(documents(docs), run, schema)


def pack(pieces: DataFrame) -> DataFrame:
    """Give each piece its sequence: a number of its own, at offset 0."""
    return pieces.withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder per length, so that a batch has one shape."""
    packed.write.partitionBy("bucket").parquet(path)
