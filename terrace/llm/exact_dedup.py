"""Exact deduplication by a tree merge of sorted digest runs.

Texts are equal when they are identical after every run of white space (``[\\x20\\x09-\\x0D]+``)
has become one space. Each row becomes an entry: SHA-256 of the normalised text, a witness
(a second hash and the length in bytes), the smallest identifier so far, and a count.

1. Each task sorts its entries into runs, in which equal texts are already one entry.
2. Partitions exchange runs in binomial rounds. In each round those that differ only in one
   digit of their number hand each other the digests that belong there, so that after the
   last round partition p has all digests that begin with p, and no partition ever has more
   than its share. Runs travel in blocks; a task merges any number of them at once, block
   after block in the order of their first digests, and holds one block of each run. At every
   level entries of one digest become one if their witnesses agree (otherwise they stay
   apart), with the smallest identifier and the sum of the counts.
3. Groups of more than one row go back to the rows. Groups larger than an even share of all
   rows, of which there are fewer than partitions, are broadcast; the others are joined.

A text that a third of all rows share is one entry per run from the start. Identifiers are
(doc_id, place of the row): of repeated rows with the smallest doc_id exactly one stays. A NULL
doc_id comes after all others, and is the keep_id of a group that has no other. NULL texts are
empty ones, and equal to each other; texts of white space alone equal one space. Other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Batches, batch, documents, put

FAN_IN = 8  # partitions that exchange runs in one round: three binomial steps
ENTRIES_PER_PARTITION = 2_000_000
RUN_ENTRIES = 500_000  # entries sorted at once
BLOCK_ENTRIES = 4096
WHITE = r"[\x20\x09-\x0D]+"
SIGN = np.uint64(1 << 63)

# Columns of an entry, all uint64: four words of the digest, witness, identifier, count.
DIGEST, WITNESS, IDENTIFIER, COUNT = 0, 4, 6, 9
WIDTH = 10
BLOCKS = "target int, run bigint, first bigint, entries binary"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (its number when it was first read), digest, hash and length of every text."""
    text = F.regexp_replace("text", WHITE, " ")
    found = documents(docs).select("doc_id", text.alias("text")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.xxhash64("text").alias("hash"),
        F.octet_length("text").alias("length"),
    )
    return put(found)


def as_entries(b: pa.RecordBatch) -> np.ndarray:
    """Entries of single rows."""
    n = b.num_rows
    entries = np.zeros((n, WIDTH), np.uint64)
    words = np.frombuffer(b"".join(b["digest"].to_pylist()), ">u8").reshape(n, 4)
    entries[:, DIGEST:WITNESS] = words
    entries[:, WITNESS] = b["hash"].to_numpy().view(np.uint64)
    entries[:, WITNESS + 1] = b["length"].to_numpy().astype(np.uint64)
    missing = b["doc_id"].is_null().to_numpy(zero_copy_only=False)
    entries[:, IDENTIFIER] = missing
    known = b["doc_id"].fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
    entries[:, IDENTIFIER + 1] = known ^ SIGN  # in order as unsigned numbers
    entries[:, IDENTIFIER + 2] = b["row"].to_numpy().view(np.uint64)
    entries[:, COUNT] = 1
    return entries


def merge(parts: list[np.ndarray]) -> np.ndarray:
    """One ascending run: entries of one digest and witness are one, with the smallest
    identifier and all counts."""
    entries = np.concatenate(parts)
    if not len(entries):
        return entries
    entries = entries[np.lexsort([entries[:, c] for c in reversed(range(COUNT))])]
    other = (entries[1:, :IDENTIFIER] != entries[:-1, :IDENTIFIER]).any(axis=1)
    first = np.flatnonzero(np.append(True, other))
    counts = np.add.reduceat(entries[:, COUNT], first)
    entries = entries[first]
    entries[:, COUNT] = counts
    return entries


class Rounds:
    """Which digits of a partition's number are exchanged in which round.

    Numbers have ``bits`` bits and name the digests that begin with them; the digits are
    taken from the first bits on.
    """

    def __init__(self, bits: int, fan_in: int = FAN_IN):
        step = max(1, fan_in.bit_length() - 1)
        self.bits, self.partitions = bits, 1 << bits
        ends = [*range(step, bits, step), bits] if bits else []
        self.cuts = list(zip([0, *ends], ends))  # (first bit, end) of each round

    def targets(self, number: int, k: int, first_words: np.ndarray) -> np.ndarray:
        """Where the entries of a partition go in round k, by the first word of the digest."""
        begin, end = self.cuts[k]
        below = self.bits - end
        digit = (first_words >> np.uint64(64 - end)) & np.uint64((1 << end - begin) - 1)
        mask = ((1 << end - begin) - 1) << below
        return (number & ~mask) | (digit.astype(np.int64) << below)


def blocks(run: np.ndarray, number: int, name: int, rounds: Rounds, k: int) -> Iterator[pa.RecordBatch]:
    """An ascending run cut by target and size."""
    if not len(run):
        return
    targets = rounds.targets(number, k, run[:, DIGEST])
    starts = np.flatnonzero(np.append(True, np.diff(targets) != 0))
    for start, end in zip(starts, np.append(starts[1:], len(run))):
        for at in range(start, end, BLOCK_ENTRIES):
            part = run[at : min(end, at + BLOCK_ENTRIES)]
            yield batch(
                target=pa.array([targets[start]], pa.int32()),
                run=pa.array([name], pa.int64()),
                # the sign bit turned: signed order is that of the unsigned word
                first=pa.array((part[:1, DIGEST] ^ SIGN).view(np.int64), pa.int64()),
                entries=pa.array([part.tobytes()], pa.binary()),
            )


def local_runs(rows: DataFrame, rounds: Rounds) -> DataFrame:
    """The runs of each task, cut for the first round."""

    def run(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId()
        held, size, name = [], 0, 0

        def sorted_run():
            return blocks(merge(held), number % rounds.partitions, number << 20 | name, rounds, 0)

        for b in batches:
            if b.num_rows:
                held.append(as_entries(b))
                size += b.num_rows
            if size >= RUN_ENTRIES:
                yield from sorted_run()
                held, size, name = [], 0, name + 1
        if held:
            yield from sorted_run()

    columns = rows.select("doc_id", "row", "digest", "hash", "length")
    return columns.mapInArrow(run, BLOCKS)


def merged(rows: Iterator[tuple[int, bytes]], at_once: int = 16 * BLOCK_ENTRIES) -> Iterator[np.ndarray]:
    """Ascending merged entries from the blocks (first word, entries) of many runs, by first word.

    What is smaller than the first word of the next block cannot meet another entry. What is
    not is the rest of the last block of each run.
    """
    held: list[np.ndarray] = []
    size = rest = 0
    for first, entries in rows:
        if size >= max(at_once, 2 * rest):
            together = merge(held)
            done = int(np.searchsorted(together[:, DIGEST], np.uint64(first)))
            if done:
                yield together[:done]
            held = [together[done:].copy()]
            size = rest = len(together) - done
        held.append(np.frombuffer(entries, np.uint64).reshape(-1, WIDTH))
        size += len(held[-1])
    if held:
        yield merge(held)


def exchange(sent: DataFrame, rounds: Rounds, k: int) -> DataFrame:
    """Merge what each partition got in round k, and cut it for the next round if there is one."""
    last = k + 1 == len(rounds.cuts)

    def run(batches: Batches) -> Batches:
        number = None

        def received():
            nonlocal number
            for b in batches:
                for target, first, entries in zip(*(b[c].to_pylist() for c in ("target", "first", "entries"))):
                    number = target  # a task has one target
                    yield (first & (1 << 64) - 1) ^ (1 << 63), entries

        for done in merged(received()):
            if not last:
                yield from blocks(done, number, number, rounds, k + 1)
                continue
            known = done[:, IDENTIFIER] == 0
            keep_id = (done[:, IDENTIFIER + 1] ^ SIGN).view(np.int64)
            yield batch(
                digest=pa.array([x.tobytes() for x in done[:, DIGEST:WITNESS].astype(">u8")], pa.binary()),
                hash=np.ascontiguousarray(done[:, WITNESS]).view(np.int64),
                length=done[:, WITNESS + 1].astype(np.int32),
                keep_id=pa.array(keep_id, pa.int64(), mask=~known),
                keep_row=np.ascontiguousarray(done[:, IDENTIFIER + 2]).view(np.int64),
                group_size=np.ascontiguousarray(done[:, COUNT]).view(np.int64),
            )

    together = sent.repartitionById(rounds.partitions, "target").sortWithinPartitions("first", "run")
    groups = "digest binary, hash bigint, length int, keep_id bigint, keep_row bigint, group_size bigint"
    return together.mapInArrow(run, groups if last else BLOCKS)


def tree_merge(rows: DataFrame, rounds: Rounds) -> DataFrame:
    """One row per different text: digest, hash, length, keep_id, keep_row, group_size."""
    sent = local_runs(rows, rounds)
    for k in range(len(rounds.cuts)):
        sent = exchange(sent, rounds, k)
    return sent


def dedup(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows = digests(docs)
    total = rows.count()
    share = max(
        int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        -(-total // ENTRIES_PER_PARTITION),
        2,
    )
    rounds = Rounds((share - 1).bit_length(), fan_in)
    groups = put(tree_merge(rows, rounds).filter("group_size > 1"))

    key = ["digest", "hash", "length"]
    even = total // rounds.partitions
    large = F.broadcast(groups.filter(F.col("group_size") > even))  # fewer than partitions
    small = groups.filter(F.col("group_size") <= even)
    columns = ["doc_id", "row", "digest", "keep_id", "keep_row", "group_size"]
    in_large = rows.join(large, key).select(*columns)
    others = rows.join(large.select(*key), key, "left_anti").join(small, key, "left").select(*columns)
    both = in_large.unionByName(others)
    alone = F.col("group_size").isNull()
    return both.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
