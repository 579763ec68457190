"""Ranked lexical search over classes of documents with equal bags.

Only the words that items ask for matter to a score, and the length of the document by its
rounded m. So documents are restricted to the items' vocabulary, and those of one m and one
vector of term frequencies are one class, which is scored once:

1. One pass over the texts gives each document its number of terms and its bag (numbers of
   vocabulary terms, and how often each occurs). It is written once.
2. Sums over all documents give N and L, and with them each m. Classes are grouped by a hash,
   and verified by the grouping on m and the whole bag, copies being counted where they are
   read. The classes' counts give each term's document frequency.
3. Each task scores its classes for all items and keeps the best k for each item, by score and
   smallest doc_id. Of these the best k of all are taken: no document of another class can be
   among an item's k best.
4. The chosen classes, at most k for an item, go back to the documents. The k smallest doc_ids
   of each are its members that can count; they are ranked by score and ascending doc_id.

Items are a stated set: they are taken in blocks, closed by their number, their terms, and
the table of weights (terms times items), so that what is broadcast is at most 32 MB.

NULL and empty texts have no terms; documents without terms count for nothing. Each row of
the items is an item of its own, also when ids repeat or are NULL; items without terms have
no result. A repeated document is listed as often as it comes, a NULL doc_id after all others.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import Batches, as_bytes, batch, documents, put

K = 10
ITEMS_AT_ONCE = 4096
TERMS_AT_ONCE = 1 << 16
WEIGHTS_AT_ONCE = 1 << 22
CLASSES_AT_ONCE = 256
TF_SCALE, TF_FACTOR, LENGTH_FACTOR = 1_000_000_000, 1000, 8
RANKED = "item_id bigint, rank int, doc_id bigint, score bigint"

TERM_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | set(range(128, 256))
#: Bytes of terms, in lower case, and a space for any other: in UTF-8, bytes from 128 on make
#: up the characters that are not ASCII.
FOLDED = bytes(b if b in TERM_BYTES else 32 for b in range(256)).lower()

BAG = np.dtype([("term", "<u2"), ("tf", "<u4")])


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


class Block:
    """Some items, their vocabulary, and how often each item has each term."""

    def __init__(self):
        self.items: list[int | None] = []  # their ids
        self.asked: list[Counter] = []
        self.number: dict[bytes, int] = {}

    def fits(self, own: Counter) -> bool:
        """Whether another item keeps the block within its bounds (one item always does)."""
        size = len(self.number) + sum(t not in self.number for t in own)
        items = len(self.items) + 1
        return not self.items or (
            items <= ITEMS_AT_ONCE and size <= TERMS_AT_ONCE and size * items <= WEIGHTS_AT_ONCE
        )

    def add(self, item_id: int | None, own: Counter) -> None:
        self.items.append(item_id)
        self.asked.append(own)
        for term in own:
            self.number.setdefault(term, len(self.number))

    def asked_table(self) -> np.ndarray:
        """Terms by items: how often the item has the term."""
        table = np.zeros((len(self.number), len(self.items)), np.int64)
        for column, own in enumerate(self.asked):
            for term, n in own.items():
                table[self.number[term], column] = n
        return table


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The items in blocks, read one partition at a time."""
    block = Block()
    for item in documents(items, id_col, text_col).toLocalIterator():
        own = Counter(terms(item["text"].encode()))
        if len(own) > TERMS_AT_ONCE:
            raise ValueError(f"an item has more than {TERMS_AT_ONCE} different terms")
        if not own:
            continue
        if not block.fits(own):
            yield block
            block = Block()
        block.add(item["doc_id"], own)
    if block.items:
        yield block


def bags(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the text) and bag (numbers and frequencies of vocabulary terms)."""
    held = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Batches) -> Batches:
        number = held.value
        known = number.keys()
        for b in batches:
            sizes, found = [], []
            for text in b["text"].to_pylist():
                words = terms(text)
                counts = Counter(words)
                own = np.array([(number[t], counts[t]) for t in known & counts.keys()], BAG)
                own.sort(order="term")
                sizes.append(len(words))
                found.append(own.tobytes())
            yield batch(
                doc_id=b["doc_id"], n=pa.array(sizes, pa.int64()), bag=pa.array(found, pa.binary())
            )

    return as_bytes(documents(docs)).mapInArrow(run, "doc_id bigint, n bigint, bag binary")


def frequencies(classes: DataFrame, size: int) -> np.ndarray:
    """Documents that have each vocabulary term: one sum per task and term, then in all."""

    def run(batches: Batches) -> Batches:
        sums = np.zeros(size, np.int64)
        for b in batches:
            for bag, members in zip(b["bag"].to_pylist(), b["members"].to_pylist()):
                sums[np.frombuffer(bag, BAG)["term"]] += members
        some = np.flatnonzero(sums)
        yield batch(term=some, df=sums[some])

    sums = classes.select("bag", "members").mapInArrow(run, "term bigint, df bigint")
    df = np.zeros(size, np.int64)
    for r in sums.groupBy("term").agg(F.sum("df").alias("df")).collect():  # size rows at most
        df[r["term"]] = r["df"]
    return df


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()])


def class_scores(bag: np.ndarray, m: int, weights: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The score of a class for every item."""
    tf = bag["tf"].astype(np.int64)
    each = weights[bag["term"]] * (TF_SCALE * tf // (TF_FACTOR * tf + LENGTH_FACTOR * m))
    return each @ asked[bag["term"]]


class Best:
    """The k best (score, then smallest doc_id) of every item among the classes seen."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.zeros(items, np.int64)  # the k-th score so far
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, doc_id, place

    def add(self, scores: np.ndarray, least_ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Take in classes (rows of scores by item); gives the places of all that remain."""
        at, item = np.nonzero((scores > 0) & (scores >= self.least))
        new = (item, scores[at, item], least_ids[at], places[at])
        item, score, doc, place = (np.concatenate(x) for x in zip(self.rows, new))
        order = np.lexsort((doc, -score, item))
        item, score, doc, place = (x[order] for x in (item, score, doc, place))
        begins = np.searchsorted(item, item)
        rank = np.arange(len(item)) - begins
        last = rank == self.k - 1
        self.least[item[last]] = score[last]
        self.rows = [x[rank < self.k] for x in (item, score, doc, place)]
        return self.rows[3]


def best_classes(classes: DataFrame, weights: np.ndarray, asked: np.ndarray, k: int) -> DataFrame:
    """Per task: item, score, and the class (hash, m, digest of the bag, smallest doc_id)."""
    held = classes.sparkSession.sparkContext.broadcast((weights, asked))

    def run(batches: Batches) -> Batches:
        weights, asked = held.value
        best = Best(asked.shape[1], k)
        kept: dict[int, tuple] = {}
        seen = 0
        for whole in batches:
            for start in range(0, whole.num_rows, CLASSES_AT_ONCE):
                b = whole.slice(start, CLASSES_AT_ONCE)
                names = list(zip(*(b[c].to_pylist() for c in ("hash", "m", "digest", "least"))))
                scores = np.stack([
                    class_scores(np.frombuffer(bag, BAG), m, weights, asked)
                    for bag, m in zip(b["bag"].to_pylist(), b["m"].to_pylist())
                ])
                ids = b["least"].fill_null(np.iinfo(np.int64).max).to_numpy()
                left = set(best.add(scores, ids, np.arange(seen, seen + len(names))).tolist())
                kept |= {seen + i: own for i, own in enumerate(names)}
                kept = {i: own for i, own in kept.items() if i in left}
                seen += len(names)
        item, score, _, place = best.rows
        columns = list(zip(*(kept[i] for i in place.tolist()))) or [[]] * 4
        yield batch(
            item=item.astype(np.int32),
            score=score,
            hash=pa.array(columns[0], pa.int64()),
            m=pa.array(columns[1], pa.int64()),
            digest=pa.array(columns[2], pa.string()),
            least=pa.array(columns[3], pa.int64()),
        )

    schema = "item int, score bigint, hash bigint, m bigint, digest string, least bigint"
    found = classes.select("hash", "m", "digest", "least", "bag").mapInArrow(run, schema)
    return first_rows(found, ["item"], [F.desc("score"), F.asc_nulls_last("least")], k)


def first_rows(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of each group, and their rank; each task sends on k of a group at most."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """item (place in the block), rank, doc_id and score."""
    rows = put(bags(docs, block.number))
    sums = rows.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).collect()[0]
    n_docs, length = int(sums[0]), int(sums[1])
    m = F.lit(100 - 75) + F.expr(f"(75 * n * {n_docs}L) div {length}L")
    shared = rows.filter(F.octet_length("bag") > 0).select("doc_id", m.alias("m"), "bag")
    named = shared.withColumn("hash", F.xxhash64("m", "bag"))
    grouped = named.groupBy("hash", "m", "bag").agg(
        F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("least")
    )
    digest = F.sha2("bag", 256)
    classes = put(grouped.withColumn("digest", digest))
    weights = term_weights(frequencies(classes, len(block.number)), n_docs)
    chosen = put(best_classes(classes, weights, block.asked_table(), k).drop("rank", "least"))
    # k rows for each item of the block at most, each of a hundred bytes
    members = named.select("doc_id", "hash", "m", "bag").join(
        F.broadcast(chosen.select("hash").distinct()), "hash", "left_semi"
    )
    members = members.select("doc_id", "hash", "m", digest.alias("digest"))
    name = ["hash", "m", "digest"]
    by_id = F.asc_nulls_last("doc_id")
    members = first_rows(members, name, [by_id], k).drop("rank")  # none further can be among the k best
    ranked = first_rows(members.join(F.broadcast(chosen), name), ["item"], [F.desc("score"), by_id], k)
    return ranked.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of every item's k best documents of a score above 0."""
    spark: SparkSession = docs.sparkSession
    found = []
    for block in item_blocks(items):
        names = spark.createDataFrame(
            list(enumerate(block.items)), "item int, item_id bigint"
        )
        ranked = search_block(docs, block, k).join(F.broadcast(names), "item")
        found.append(ranked.select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], RANKED)
    return reduce(DataFrame.unionByName, found)
