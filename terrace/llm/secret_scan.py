"""Finding secrets: fixed forms, and random strings by the token-efficiency test.

A vocabulary built from natural text needs few tokens for words and many for random
characters. Runs of at least ``MIN_RUN`` key characters with a letter are encoded, whole and cut
into words and numbers at separators, capitals and digits; fewer than ``CHARS_PER_TOKEN``
characters per token both ways expose a random string, so that identifiers and words in capitals
are told by their parts. Known digests (hexadecimal of a digest's length, UUIDs), times of day and
runs without a letter (card and phone numbers) are left out of this test.

Every row is scanned where it is read, whole; nothing is shuffled. NULL and empty texts
have no spans; repeated rows give repeated results; other columns are ignored by ``scan`` and
kept by ``redact``.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Batches, as_bytes, batch, documents, kept, mapped, slices

KINDS = ("assign", "access", "hex", "random")  # in the order of spans with one start
BASE_KINDS = KINDS[:3]
MIN_RUN = 16
CHARS_PER_TOKEN = 2.0
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

# The patterns of the base kinds.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE,
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(rb"(?i)[0-9a-f]+")
UUID = re.compile(rb"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
TIME = re.compile(rb"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[Tt_-][0-9]{2}[-_]?[0-9]{2}[-_]?[0-9]{2}[Zz]?")
LETTER = re.compile(rb"[A-Za-z]")
BYTES_AT_ONCE = 1 << 20

_HEX_CLASS = bytes(b"h"[0] if chr(b) in "0123456789abcdef" else b"."[0] for b in range(256))
_RUN_CLASS = bytes(b"x"[0] if RUN.fullmatch(bytes([b]) * MIN_RUN) else b"."[0] for b in range(256))
_PARTS = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def encoder(path: str, pattern: str):
    """The ``tiktoken`` encoding of a rank file, loaded once per worker."""

    def load():
        import tiktoken

        with open(path, "rb") as lines:
            rows = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(t): int(r) for t, r in rows}
        return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return kept((encoder, path, pattern), load)


def digest(run: bytes) -> bool:
    """Hexadecimal of a digest's length, or a UUID."""
    known = len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run)
    return bool(known or UUID.fullmatch(run))


def excluded(run: bytes) -> bool:
    """Whether a run is no candidate of the token test."""
    core = run.strip(b"-_=+/")
    return not LETTER.search(core) or digest(core) or bool(TIME.fullmatch(core))


def random_string(run: bytes, encode) -> bool:
    """Whether a run has few characters per token, as it stands and by its words and numbers.

    The words are encoded in small letters; in a random string parts have a character or two, or
    are as random as the whole.
    """
    if len(run) >= CHARS_PER_TOKEN * len(encode(run.decode())):
        return False
    parts = _PARTS.findall(run)
    tokens = sum(len(encode(part.decode().lower())) for part in parts)
    return sum(map(len, parts)) < CHARS_PER_TOKEN * tokens


def byte_spans(text: bytes, encode) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted."""
    spans = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_VALUE:
                spans.append((m.start(), 0, m.end()))
    if b"AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                spans.append((m.start(), 1, m.end()))
    if b"h" * MIN_HEX in text.translate(_HEX_CLASS):
        for m in HEX.finditer(text):
            if m.end() - m.start() >= MIN_HEX:
                spans.append((m.start(), 2, m.end()))
    if b"x" * MIN_RUN in text.translate(_RUN_CLASS):
        for m in RUN.finditer(text):
            run = m.group()
            if not excluded(run) and random_string(run, encode):
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    if not spans or text.isascii():
        return spans
    places = sorted({p for start, _, end in spans for p in (start, end)})
    at, counted, before = {}, 0, 0
    for p in places:
        counted += len(text[before:p].decode())
        at[p], before = counted, p
    return [(at[start], kind, at[end]) for start, kind, end in spans]


def scan(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and its spans (kind, start, end; code points, end exclusive) in order."""
    span = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    )

    def run(batches: Batches) -> Batches:
        encode = encoder(path, pattern).encode_ordinary
        for b in batches:
            found = []
            for text in b["text"].to_pylist():
                spans = code_points(text, byte_spans(text, encode))
                found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield batch(doc_id=b["doc_id"], spans=pa.array(found, span))

    schema = "doc_id bigint, spans array<struct<kind string, start bigint, `end` bigint>>"
    return mapped(as_bytes(documents(docs)), run, schema)


def redact(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The same rows with every span of the text replaced by ``[secret]``."""
    names, schema = docs.columns, docs.schema

    def run(batches: Batches) -> Batches:
        encode = encoder(path, pattern).encode_ordinary
        for whole in batches:
            for b in slices(whole, text_col, BYTES_AT_ONCE):
                texts = []
                for text in b[text_col].cast(pa.binary()).to_pylist():
                    spans = byte_spans(text, encode) if text else ()
                    kept, at = [], 0
                    for start, _, end in spans:
                        if end > at:
                            kept += [text[at:start] if start >= at else b"", b"[secret]" * (start >= at)]
                            at = end
                    texts.append(b"".join([*kept, text[at:]]) if spans else text)
                column = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [column if n == text_col else b[n] for n in names], names
                )

    return docs.mapInArrow(run, schema)


def listed(spans, kinds: tuple[str, ...] = KINDS):
    """Spans of the kinds as ``kind:start:end``, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(
            chosen,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
