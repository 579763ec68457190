"""Scoring texts with a Brown class-based bigram model.

P(text) is the product over its words, and an end, of P(class | class before) and
P(word | class). Classes come from exchange clustering: words move, each to the class that
raises the likelihood of the training text most, until the rounds are over.

Words with at least one in ``COMMON`` training tokens (at most ``COMMON`` words, whatever the
input) are clustered one by one, together with ``ENDINGS`` groups of other words that end alike.
With these classes fixed, every other word seen ``SEEN`` times or more in training joins the class
that gains most by its own neighbours; only words seen less often keep their group's. Emissions use the count of every single word, common or not.

Passes over the text, each read whole where it lies:
1. the training tokens of every word, summed by its hash: which words are common, which further;
2. pairs of neighbours among common words and groups, summed by pair;
   the classes of the neighbours of each further word, gathered in each task, shuffled by bucket
   of words;
   class pairs, counted anew with the classes found for them;
3. all other words: gathered in each task, shuffled by word, and counted; each word's
   contribution goes back to the texts that hold it;
4. transitions and common words of each text, joined with what pass 3 found for it.
Every count is exact and moves are made in fixed parts and order, so that scores do not depend on
how the input is cut into partitions (but for the last bits of sums).
The driver sees common words, their classes and class counts, all bounded, and nine bytes (a hash
and a class) of each other word seen ``SEEN`` times; classes are exact up to that 64-bit hash. A word that many
texts share is either common or has less than one in ``COMMON`` tokens, so no task gathers a hot
word.

Counts are smoothed by adding 0.5; every class keeps one place for unknown words. NULL and
empty texts are one end; repeated rows count as often as they come; a NULL doc_id counts
as the text '' when rows are held out; other columns are ignored. Without training rows the
model is uniform.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Batches, as_bytes, batch, mix, put, slices

COMMON = 10_000
ENDINGS = 256
SEEN = 20  # training tokens from which a word has a class by its own neighbours
CLASSES = 64
ROUNDS = 16
PARTS = 8  # of the words, in each of which moves are made one after the other
MOVED_AT_ONCE = 4  # one in so many words may move in a round
ADDED = 0.5
BACKOFF = 10.0  # tokens that the unconditional class share counts as
BYTES_AT_ONCE = 1 << 20
PAIRS_HELD = 1 << 22
ENTRIES_HELD = 1 << 21
WORD_BUCKETS = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _FACTOR)


def prepared(docs: DataFrame, folds: int = 5, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, key (equal for repeated rows only) and the text as bytes."""
    number = F.col("doc_id").cast("bigint")
    fold = F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary")) % folds
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        number.alias("doc_id"),
        (fold == held_fold).alias("held_out"),
        F.xxhash64(number, text).alias("key"),
        text.alias("text"),
    )
    return as_bytes(rows)


@dataclass
class Words:
    """Different words: 64-bit hashes in order, their last three bytes, and where they are."""

    hashes: np.ndarray
    endings: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: bytes

    def named(self, which: np.ndarray) -> list[bytes]:
        return [self.data[i:j] for i, j in zip(self.begin[which].tolist(), self.end[which].tolist())]


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """The number of each token's word, -1 for an end; where each text begins; the words."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    inside = ~_SPACE[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(low))]  # words end where texts do
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = end - begin
    starts = np.cumsum(sizes) - sizes
    letters = low[inside]
    power = np.cumprod(np.full(int(sizes.max(initial=1)), _FACTOR))
    terms = _LETTER[letters] * power[np.arange(len(letters)) - np.repeat(starts, sizes)]
    hashes = mix(np.add.reduceat(terms, starts) if len(starts) else np.zeros(0, np.uint64))
    distinct, at, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    begin, end = begin[at], end[at]
    endings = np.zeros(len(at), np.int64)
    for back in (1, 2, 3):
        there = end - begin >= back
        endings[there] = endings[there] * 256 + low[end[there] - back]
    bounds = np.searchsorted(np.flatnonzero(first), bounds)
    numbers = np.insert(numbers.astype(np.int64), bounds[1:], -1)
    return numbers, bounds[:-1] + np.arange(len(texts)), Words(distinct, endings, begin, end, low.tobytes())


def words_from(words: list[bytes]) -> tuple[Words, np.ndarray]:
    """Given words, which are all different, and at which place each of them now is."""
    numbers, _, found = tokens_of(pa.array(words, pa.binary()))
    return found, numbers[numbers >= 0]


def places_in(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted values are in an ordered table, -1 for nowhere."""
    if not len(table):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, at, -1)


def word_counts(training: DataFrame, common: int = COMMON) -> DataFrame:
    """hash, n: the training tokens of every word, counted exactly (up to that 64-bit hash), and
    of ends (NULL); and the word itself where it is common in some slice of the text, as a
    word that is common at all must be."""

    def run(batches: Batches) -> Batches:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        names: dict[int, bytes] = {}
        size = texts = 0

        def flushed() -> pa.RecordBatch:
            hashes, n = summed(*map(np.concatenate, zip(*parts)))
            number = hashes.view(np.int64)
            end = np.arange(len(n) + 1) == len(n)
            word = [*map(names.get, hashes.tolist()), None]
            return batch(
                hash=pa.array(np.append(number, 0), mask=end),
                n=np.append(n, texts).astype(np.int64),
                word=pa.array(word, pa.binary()),
            )

        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                numbers, _, words = tokens_of(b["text"])
                n = np.bincount(numbers[numbers >= 0], minlength=len(words.hashes))
                often = np.flatnonzero(n * common >= len(numbers))
                names.update(zip(words.hashes[often].tolist(), words.named(often)))
                parts.append((words.hashes, n))
                size, texts = size + len(n), texts + b.num_rows
                if size > ENTRIES_HELD:
                    parts = [summed(*map(np.concatenate, zip(*parts)))]
                    size = len(parts[0][0])
                    if size > ENTRIES_HELD // 2:
                        yield flushed()
                        names.clear()
                        parts, size, texts = [], 0, 0
        if parts:
            yield flushed()

    found = training.select("text").mapInArrow(run, "hash bigint, n bigint, word binary")
    return put(found.groupBy("hash").agg(F.sum("n").alias("n"), F.max("word").alias("word")))


def common_words(counted: DataFrame, common: int = COMMON) -> list[bytes]:
    """Words with at least one in ``common`` training tokens."""
    total = counted.agg(F.sum("n")).collect()[0][0] or 0
    rows = counted.filter(F.col("word").isNotNull() & (F.col("n") * common >= total)).select("word").collect()
    return sorted(bytes(r["word"]) for r in rows)


@dataclass
class Nodes:
    """Numbers of the common words, then of the groups by ending, then of the end."""

    common: list[bytes]
    endings: int = ENDINGS

    def __post_init__(self):
        words, place = words_from(self.common)
        self.hashes, self.number = words.hashes, np.argsort(place)

    @property
    def end(self) -> int:
        return len(self.common) + self.endings

    @property
    def count(self) -> int:
        return self.end + 1

    def of(self, words: Words) -> np.ndarray:
        at = places_in(self.hashes, words.hashes)
        group = mix(words.endings.astype(np.uint64)) % np.uint64(self.endings)
        found = len(self.common) + group.astype(np.int64)
        found[at >= 0] = self.number[at[at >= 0]]
        return found

    def sequences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of all tokens of the texts one after the other, and where each text begins."""
        numbers, starts, words = tokens_of(texts)
        return np.append(self.of(words), self.end)[numbers], starts


@dataclass
class Lookup:
    """The class of every word: common words' own, further words' by hash, others' by group."""

    nodes: Nodes
    own: np.ndarray
    hashes: np.ndarray  # of the further words, sorted
    classes: np.ndarray

    @property
    def width(self) -> int:
        return int(self.own[self.nodes.end]) + 1

    def of_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The node and the class of each of the words."""
        nodes = self.nodes.of(words)
        classes = self.own[nodes]
        at = places_in(self.hashes, words.hashes)
        classes[at >= 0] = self.classes[at[at >= 0]]
        return nodes, classes

    def sequences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and classes of all tokens, one text after the other, and where each text begins."""
        numbers, starts, words = tokens_of(texts)
        nodes, classes = self.of_words(words)
        return np.append(nodes, self.nodes.end)[numbers], np.append(classes, self.width - 1)[numbers], starts


def further_words(
    training: DataFrame,
    counted: DataFrame,
    nodes: Nodes,
    own: np.ndarray,
    between: np.ndarray,
    seen: int = SEEN,
) -> Lookup:
    """Every word that is not common and has ``seen`` training tokens joins its best class."""
    spark = training.sparkSession
    often = counted.filter(F.col("hash").isNotNull() & (F.col("n") >= seen)).select("hash").toArrow()
    hashes = np.setdiff1d(often["hash"].to_numpy().view(np.uint64), nodes.hashes)
    if not len(hashes):
        return Lookup(nodes, own, hashes, np.zeros(0, np.uint8))
    held = spark.sparkContext.broadcast((nodes, own, between, hashes))
    width = len(between)
    places = 2 * width + 1  # classes after, classes before, pairs with itself
    # Each task sends a row for each bucket of words, of which there are as many whatever the input.
    buckets = max(WORD_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = np.arange(buckets + 1) * len(hashes) // buckets

    def gather(batches: Batches) -> Batches:
        nodes, own, _, hashes = held.value
        group = np.zeros(len(hashes), np.int32)
        parts, size = [], 0

        def flushed() -> pa.RecordBatch:
            """A row for each bucket of words, with all that belongs there."""
            codes, counts = summed(*map(np.concatenate, zip(*parts)))
            word = codes // places
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            cuts = np.searchsorted(word, edges), np.searchsorted(word[first], edges)
            local = codes - np.repeat(edges[:-1] * places, np.diff(cuts[0]))
            lists = (cuts[0], local.astype(np.int32)), (cuts[0], counts.astype(np.int64)), (cuts[1], group[word[first]])
            at, n, node = (pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(x)) for c, x in lists)
            rows = batch(bucket=np.arange(buckets, dtype=np.int32), at=at, n=n, node=node)
            return rows.filter(pa.array(np.diff(cuts[0]) > 0))

        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                numbers, _, words = tokens_of(b["text"])
                of_word, place = nodes.of(words), places_in(hashes, words.hashes)
                group[place[place >= 0]] = of_word[place >= 0]
                place = np.append(place, -1)[numbers]
                classes = own[np.append(of_word, nodes.end)[numbers]]
                tokens = np.flatnonzero(place >= 0)
                if not len(tokens):
                    continue
                base = place[tokens] * places
                same = numbers[tokens] == numbers[tokens + 1]  # an end follows at last
                before = np.append(width - 1, classes[:-1])[tokens]
                codes = [base + classes[tokens + 1], base + width + before, base[same] + 2 * width]
                parts.append(np.unique(np.concatenate(codes), return_counts=True))
                size += len(parts[-1][0])
                if size > ENTRIES_HELD:
                    parts = [summed(*map(np.concatenate, zip(*parts)))]
                    size = len(parts[0][0])
                    if size > ENTRIES_HELD // 2:
                        yield flushed()
                        parts, size = [], 0
        if parts:
            yield flushed()

    def assign(batches: Batches) -> Batches:
        _, own, between, _ = held.value

        def best(node: int, total: np.ndarray) -> int:
            now, self_pairs = int(own[node]), total[-1]
            rest, out, into = without(now, total[:width], total[width:-1], self_pairs, between)
            gain = gains(rest, out, into, self_pairs)
            top = int(gain.argmax())
            return top if gain[top] > gain[now] + 1e-6 else now

        def settled() -> pa.RecordBatch:
            """Every word of a bucket, its counts from all tasks together."""
            codes, counts = summed(*map(np.concatenate, zip(*parts)))
            word = codes // places
            cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
            found = np.empty(len(cuts) - 1, np.int32)
            for i, (start, end) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                total = np.zeros(places)
                total[codes[start:end] % places] = counts[start:end]
                found[i] = best(int(node_of[word[start]]), total)
            return batch(word=edges[last] + word[cuts[:-1]], best=found)

        last, parts, size, node_of = -1, [], 0, np.zeros(0, np.int32)
        for b in batches:
            for i in range(b.num_rows):
                bucket = b["bucket"][i].as_py()
                if bucket != last:
                    if parts:
                        yield settled()
                    last, parts, size = bucket, [], 0
                    node_of = np.zeros(edges[bucket + 1] - edges[bucket], np.int32)
                codes, counts, own_nodes = (b[c].slice(i, 1).flatten().to_numpy() for c in ("at", "n", "node"))
                node_of[np.unique(codes // places)] = own_nodes
                parts.append((codes, counts))
                size += len(codes)
                if size > ENTRIES_HELD:
                    parts, size = [summed(*map(np.concatenate, zip(*parts)))], 0
        if parts:
            yield settled()

    gathered = training.select("text").mapInArrow(
        gather, "bucket int, at array<int>, n array<bigint>, node array<int>"
    )
    together = gathered.repartition("bucket").sortWithinPartitions("bucket")
    found = together.mapInArrow(assign, "word bigint, best int").toArrow()
    classes = np.zeros(len(hashes), np.uint8)
    classes[found["word"].to_numpy()] = found["best"].to_numpy()
    return Lookup(nodes, own, hashes, classes)


def class_pairs_of(training: DataFrame, lookup: Lookup) -> np.ndarray:
    """How often each class follows each, with the classes of all words."""
    held = training.sparkSession.sparkContext.broadcast(lookup)
    width = lookup.width

    def run(batches: Batches) -> Batches:
        total = np.zeros(width * width, np.int64)
        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                _, after, _ = held.value.sequences(b["text"])
                before = np.append(width - 1, after[:-1])
                total += np.bincount(before * width + after, minlength=width * width)
        pair = np.flatnonzero(total)
        yield batch(pair=pair, n=total[pair])

    pairs = training.select("text").mapInArrow(run, "pair bigint, n bigint")
    total = np.zeros(width * width)
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        total[r["pair"]] = r["n"]
    return total.reshape(width, width)


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else order
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def merged(keys: np.ndarray, logs: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of both by key."""
    order = np.argsort(keys, kind="stable")
    keys, logs, known = keys[order], logs[order], known[order]
    if not len(keys):
        return keys, logs, known
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(logs, first), np.add.reduceat(known, first)


def bucketed(
    keys: np.ndarray, logs: np.ndarray, known: np.ndarray, buckets: int, first: int = 0
) -> pa.RecordBatch:
    """A row for each bucket of keys, with all that belongs there."""
    bucket = keys % buckets
    order = np.argsort(bucket, kind="stable")
    offsets = pa.array(np.searchsorted(bucket[order], np.arange(buckets + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (keys, logs, known)]
    number = np.arange(first, first + buckets).astype(np.int32)
    return batch(bucket=number, keys=lists[0], logs=lists[1], known=lists[2])


def neighbours(training: DataFrame, nodes: Nodes) -> DataFrame:
    """before, after, n: how often each pair of nodes is adjacent; an end stands before a text."""
    held = training.sparkSession.sparkContext.broadcast(nodes)
    width = nodes.count

    def run(batches: Batches) -> Batches:
        nodes = held.value
        parts, size = [], 0
        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                after, _ = nodes.sequences(b["text"])
                before = np.append(nodes.end, after[:-1])
                parts.append(np.unique(before * width + after, return_counts=True))
                size += len(parts[-1][0])
                if size > PAIRS_HELD:
                    parts = [summed(*map(np.concatenate, zip(*parts)))]
                    size = len(parts[0][0])
                    if size > PAIRS_HELD // 2:
                        yield batch(pair=parts[0][0], n=parts[0][1].astype(np.int64))
                        parts, size = [], 0
        if parts:
            codes, counts = summed(*map(np.concatenate, zip(*parts)))
            yield batch(pair=codes, n=counts.astype(np.int64))

    pairs = training.select("text").mapInArrow(run, "pair bigint, n bigint")
    pairs = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    before, after = F.expr(f"pair div {width}"), F.col("pair") % width
    return put(pairs.select(before.alias("before"), after.alias("after"), "n"))


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def without(own: int, out: np.ndarray, into: np.ndarray, self_pairs: float, between: np.ndarray):
    """Class pairs without one word of class ``own``, and its neighbours without itself."""
    rest = between.astype(float).copy()
    rest[own] -= out
    rest[:, own] -= into
    rest[own, own] += self_pairs
    out, into = out.astype(float).copy(), into.astype(float).copy()
    out[own] -= self_pairs
    into[own] -= self_pairs
    return rest, out, into


def gains(rest: np.ndarray, out: np.ndarray, into: np.ndarray, self_pairs: float) -> np.ndarray:
    """What the log-likelihood gains when the word left out joins each class.

    ``out`` and ``into`` count the word's neighbours by class, ``rest`` all other pairs.
    """
    # Whichever class the word joins, its neighbours' classes get these pairs back.
    rows, columns = rest.sum(1) + into, rest.sum(0) + out
    # Classes that are no neighbours keep their pairs.
    after, ahead = np.flatnonzero(out), np.flatnonzero(into)
    as_row = _entropy(rest[:, after] + out[after]) - _entropy(rest[:, after])
    as_column = _entropy(rest[ahead] + into[ahead, None]) - _entropy(rest[ahead])
    gain = as_row.sum(1) + as_column.sum(0)
    gain[after] -= as_row[after, np.arange(len(after))]
    gain[ahead] -= as_column[np.arange(len(ahead)), ahead]
    corner = np.diag(rest)
    gain += _entropy(corner + out + into + self_pairs) - _entropy(corner)
    gain -= _entropy(rows + out.sum() + self_pairs) - _entropy(rows)
    gain -= _entropy(columns + into.sum() + self_pairs) - _entropy(columns)
    gain[-1] = -np.inf  # the end's class is its own
    return gain


def log_likelihood(between: np.ndarray) -> float:
    """Of the classes, up to what the classes do not change."""
    sides = _entropy(between.sum(0)).sum() + _entropy(between.sum(1)).sum()
    return float(_entropy(between).sum() - sides)


def cluster(pairs: DataFrame, nodes: Nodes, classes: int = CLASSES, rounds: int = ROUNDS):
    """Class of every node, the counts of class pairs, and the count of every node."""
    spark = pairs.sparkSession
    entry = lambda other: F.collect_list(F.struct(F.col(other).alias("node"), "n"))
    out = pairs.groupBy(F.col("before").alias("own")).agg(entry("after").alias("out"))
    into = pairs.groupBy(F.col("after").alias("own")).agg(entry("before").alias("into"))
    joined = out.join(into, "own", "full")
    sides = {
        f"{side}_{part}": F.coalesce(F.col(f"{side}.{part}"), F.array().cast("array<bigint>"))
        for side in ("out", "into")
        for part in ("node", "n")
    }
    # Words that move at once know of each other's moves within one of eight fixed parts only.
    words = joined.select("own", (F.col("own") % PARTS).alias("part"), *[c.alias(n) for n, c in sides.items()])
    words = put(words.repartition(PARTS, "part").sortWithinPartitions("part", "own"))
    width = classes + 1

    counts = np.zeros(nodes.count, np.int64)
    for r in pairs.groupBy("after").agg(F.sum("n").alias("n")).collect():
        counts[r["after"]] = r["n"]
    own = np.empty(nodes.count, np.int64)
    own[np.argsort(-counts, kind="stable")] = np.arange(nodes.count) % classes
    own[nodes.end] = classes

    def entries(b: pa.RecordBatch, side: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Neighbours and counts of each word of the batch."""
        nodes, n = b[f"{side}_node"], b[f"{side}_n"]
        ends = np.cumsum([0, *nodes.value_lengths().to_pylist()])
        flat = nodes.flatten().to_numpy(), n.flatten().to_numpy()
        return [tuple(x[i:j] for x in flat) for i, j in zip(ends, ends[1:])]

    def by_class(side: tuple[np.ndarray, np.ndarray], own: np.ndarray) -> np.ndarray:
        return np.bincount(own[side[0]], side[1], minlength=width)

    def class_pairs(own: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(own)

        def run(batches: Batches) -> Batches:
            own, total = held.value, np.zeros((width, width))
            for b in batches:
                for node, out in zip(b["own"].to_pylist(), entries(b, "out")):
                    total[own[node]] += by_class(out, own)
            yield batch(total=pa.array([total.tobytes()], pa.binary()))

        found = words.select("own", "out_node", "out_n").mapInArrow(run, "total binary").collect()
        arrays = [np.frombuffer(r["total"]).reshape(width, width) for r in found]
        return sum(arrays, np.zeros((width, width)))

    between = class_pairs(own)
    for turn in range(rounds):
        held = spark.sparkContext.broadcast((own, between))

        def moves(batches: Batches, held=held, turn=turn) -> Batches:
            found, last = [], None
            for b in batches:
                names = b["part"].to_pylist(), b["own"].to_pylist()
                for part, node, out, into in zip(*names, entries(b, "out"), entries(b, "into")):
                    if part != last:
                        own, between = (x.copy() for x in held.value)  # as this part's moves change them
                        last = part
                    if node == nodes_end or node // 8 % MOVED_AT_ONCE != turn % MOVED_AT_ONCE:
                        continue
                    self_pairs = float(out[1][out[0] == node].sum())
                    sides = by_class(out, own), by_class(into, own)
                    rest, *sides = without(own[node], *sides, self_pairs, between)
                    gain = gains(rest, *sides, self_pairs)
                    best = int(gain.argmax())
                    if gain[best] > gain[own[node]] + 1e-6:
                        rest[best] += sides[0]
                        rest[:, best] += sides[1]
                        rest[best, best] += self_pairs
                        between, own[node] = rest, best
                        found.append((node, best))
            yield batch(
                node=pa.array([n for n, _ in found], pa.int64()),
                best=pa.array([c for _, c in found], pa.int64()),
            )

        nodes_end = nodes.end
        found = words.mapInArrow(moves, "node bigint, best bigint").collect()
        best = np.array([(r["node"], r["best"]) for r in found], np.int64).reshape(-1, 2)
        for part in (1, 2, 4):  # moves made at the same time may spoil each other
            moved = own.copy()
            chosen = best[best[:, 0] // 8 // MOVED_AT_ONCE % part == 0]
            moved[chosen[:, 0]] = chosen[:, 1]
            now = class_pairs(moved)
            if log_likelihood(now) > log_likelihood(between):
                own, between = moved, now
                break
    return own, between, counts


def rare_words(rows: DataFrame, nodes: Nodes, lookup: Lookup) -> tuple[DataFrame, np.ndarray]:
    """What the words that are not common add to each text: key, logs (the sum of
    log10(count + 0.5)) and known tokens; and how many known such words each class has."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(nodes)
    classes = spark.sparkContext.broadcast(lookup)
    width = lookup.width

    def gather(batches: Batches) -> Batches:
        nodes = held.value
        place: dict[bytes, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []  # word, key, times, times in training
        size = 0

        def flushed() -> pa.RecordBatch:
            word, key, times, train = map(np.concatenate, zip(*parts))
            order = np.argsort(word, kind="stable")
            offsets = np.searchsorted(word[order], np.arange(len(place) + 1))
            lists = [
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x[order]))
                for x in (key, times)
            ]
            trained = np.bincount(word, train, minlength=len(place)).astype(np.int64)
            words = pa.array(list(place), pa.binary())
            return batch(word=words, trained=trained, keys=lists[0], times=lists[1])

        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                numbers, starts, words = tokens_of(b["text"])
                name = np.full(len(words.hashes) + 1, -1)
                rare = np.flatnonzero(nodes.of(words) >= len(nodes.common))
                name[rare] = [place.setdefault(w, len(place)) for w in words.named(rare)]
                word = name[numbers]
                text = np.repeat(np.arange(b.num_rows), np.diff(np.append(starts, len(numbers))))
                rare = np.flatnonzero(word >= 0)
                cells, times = np.unique(word[rare] * b.num_rows + text[rare], return_counts=True)
                word, text = cells // b.num_rows, cells % b.num_rows
                held_out = b["held_out"].to_numpy(zero_copy_only=False)[text]
                parts.append((word, b["key"].to_numpy()[text], times, np.where(held_out, 0, times)))
                size += len(cells)
                if size > ENTRIES_HELD:
                    yield flushed()
                    place.clear()
                    parts, size = [], 0
        if size:
            yield flushed()

    schema = "word binary, trained bigint, keys array<bigint>, times array<bigint>"
    gathered = rows.select("key", "held_out", "text").mapInArrow(gather, schema)
    together = gathered.repartition("word").sortWithinPartitions("word")

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Batches) -> Batches:
        known_words = np.zeros(width, np.int64)
        parts: list[tuple[np.ndarray, ...]] = []  # key, logs, known
        size = 0
        words, trained, lengths = [], *(np.zeros(0, np.int64) for _ in range(2))
        keys, times = (np.zeros(0, np.int64) for _ in range(2))

        def settle(words, trained, lengths, keys, times) -> None:
            """Whole words: what each adds to the texts that hold it."""
            new = np.array([True, *(a != b for a, b in zip(words, words[1:]))])
            number = np.cumsum(new) - 1
            total = np.bincount(number, trained)
            seen = [words[i] for i in np.flatnonzero(new) if total[number[i]]]
            _, of_class = classes.value.of_words(words_from(seen)[0])
            known_words[:] += np.bincount(of_class, minlength=width)
            at = np.repeat(number, lengths)
            logs = np.log10(total + ADDED)[at] * times
            parts.append(merged(keys, logs, np.where(total[at] > 0, times, 0)))

        for b in batches:
            if not b.num_rows:
                continue
            words = words + b["word"].to_pylist()
            trained = np.append(trained, b["trained"].to_numpy())
            lengths = np.append(lengths, b["keys"].value_lengths().to_numpy())
            keys = np.append(keys, b["keys"].flatten().to_numpy())
            times = np.append(times, b["times"].flatten().to_numpy())
            cut = len(words) - 1
            while cut and words[cut - 1] == words[-1]:
                cut -= 1
            if cut:  # the last word may go on in the next batch
                at = int(lengths[:cut].sum())
                settle(words[:cut], trained[:cut], lengths[:cut], keys[:at], times[:at])
                words, trained, lengths = words[cut:], trained[cut:], lengths[cut:]
                keys, times = keys[at:], times[at:]
                size += len(parts[-1][0])
            if size > ENTRIES_HELD:
                parts = [merged(*map(np.concatenate, zip(*parts)))]
                size = len(parts[0][0])
                if size > ENTRIES_HELD // 2:
                    yield bucketed(*parts[0], buckets)
                    parts, size = [], 0
        if words:
            settle(words, trained, lengths, keys, times)
        if parts:
            yield bucketed(*merged(*map(np.concatenate, zip(*parts))), buckets)
        number = np.arange(len(known_words))
        yield bucketed(number, np.zeros(len(number)), known_words, 1, first=-1)

    def total(batches: Batches) -> Batches:
        for_class = {True: [], False: []}
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                columns = tuple(row[n].flatten().to_numpy() for n in ("keys", "logs", "known"))
                for_class[row["bucket"][0].as_py() < 0].append(columns)
        for is_class, parts in for_class.items():
            if parts:
                key, logs, known = merged(*map(np.concatenate, zip(*parts)))
                none = pa.nulls(len(key), pa.int64())
                names, both = ["key", "class", "logs", "known"], (none, pa.array(key))
                yield pa.RecordBatch.from_arrays(
                    [*(both if is_class else both[::-1]), pa.array(logs), pa.array(known)], names
                )

    lists = "bucket int, keys array<bigint>, logs array<double>, known array<bigint>"
    counted = together.mapInArrow(count, lists).repartition("bucket")
    found = put(counted.mapInArrow(total, "key bigint, class bigint, logs double, known bigint"))
    vocabulary = np.zeros(width, np.int64)
    for r in found.filter(F.col("class").isNotNull()).collect():
        vocabulary[r["class"]] = r["known"]
    return found.filter(F.col("class").isNull()).select("key", "logs", "known"), vocabulary


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    rows = prepared(docs)
    training = rows.filter(~F.col("held_out"))
    counted = word_counts(training)
    nodes = Nodes(common_words(counted))
    own, between, counts = cluster(neighbours(training, nodes), nodes)
    lookup = further_words(training, counted, nodes, own, between)
    between = class_pairs_of(training, lookup)
    rare, rare_known = rare_words(rows, nodes, lookup)

    tokens = int(counts.sum())
    single = np.append(np.arange(len(nodes.common)), nodes.end)  # nodes that are one word
    known = single[counts[single] > 0]
    words_in = rare_known + np.bincount(own[known], minlength=len(between))
    vocabulary = int(words_in.sum())
    in_class = between.sum(0)
    share = (in_class + 1) / (in_class.sum() + len(between))
    transition = (between + BACKOFF * share) / (between.sum(1) + BACKOFF)[:, None]
    emission = np.log10(in_class + ADDED * (words_in + 1))
    one_word = np.zeros(nodes.count, bool)
    one_word[single] = True
    model = (
        lookup,
        np.log10(transition) - emission[None, :],
        np.where(one_word, np.log10(counts + ADDED), 0.0),
        one_word & (counts > 0),
    )
    held = spark.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        lookup, step, log_count, is_known = held.value
        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                found, classes, starts = lookup.sequences(b["text"])
                steps = step[np.append(lookup.width - 1, classes[:-1]), classes]
                yield batch(
                    doc_id=b["doc_id"],
                    held_out=b["held_out"],
                    key=b["key"],
                    n_tokens=np.diff(np.append(starts, len(found))),
                    n_known=np.add.reduceat(is_known[found].astype(np.int64), starts),
                    logs=np.add.reduceat(log_count[found], starts),
                    steps=np.add.reduceat(steps, starts),
                )

    schema = (
        "doc_id bigint, held_out boolean, key bigint, n_tokens bigint, n_known bigint,"
        " logs double, steps double"
    )
    own_part = rows.mapInArrow(run, schema)
    # Repeated rows share a key: what was found for it is theirs in equal parts.
    whole = own_part.groupBy("key").agg(
        F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in own_part.columns if c != "key"]
    )
    rare = rare.select("key", F.col("logs").alias("rare_logs"), F.col("known").alias("rare_known"))
    joined = whole.join(rare, "key", "left")
    times = F.col("times")
    logs = F.col("logs") + F.coalesce(F.col("rare_logs") / times, F.lit(0.0))
    all_known = F.col("n_known") + F.coalesce(F.expr("rare_known div times"), F.lit(0))
    base = logs - F.col("n_tokens") * float(np.log10(tokens + ADDED * (vocabulary + 1)))
    scored = joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        all_known.alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (logs + F.col("steps")).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), times)).alias("copy"),
    )
    return scored.drop("copy")
