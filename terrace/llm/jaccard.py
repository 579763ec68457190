"""N-gram Jaccard join: texts whose sets of word n-grams are alike, and their components.

Elements are 62-bit hashes of five-word shingles, ordered by value everywhere. Every text becomes
a set; equal sets are one node. Two sets are linked if they share 4/9 of the sum of their sizes,
that is, if no more than a ninth of that sum, D, is in one of them only.

1. Candidates. The range of all values is cut into m > D equal parts, and each ordered set falls
   into m runs. A linked pair differs in at most D of them, and so has a run in common: the sets
   are stored in a forest of prefix trees, one for each part, by their runs, and pairs meet where
   whole runs are equal. A run has some four elements: texts that share but a passage hardly
   ever meet. Sizes are put in bands, each with an m of its own; a pair meets in the band
   of the larger set. Runs leave out common elements (at least one in ``COMMON`` of all, so at
   most ``COMMON``, whatever the input). Sets that would so have too few runs to be sure
   are stored by their runs with common elements, too, and if need be by their empty runs.
2. Groups of equal runs give pairs of nodes with the number of runs they share, which must be
   enough for their sizes. Large groups give only pairs with a few leaders.
3. Each node's most promising pair is checked first, and components are formed.
4. Pairs of different components from small groups are checked. Nodes that large groups tie
   together are a family (of near copies, mostly): those outside its largest component are
   checked, in blocks, against all of it, and only links that connect components are kept. So
   no link is lost, and no pairs inside a component are written out.

A check stores the ordered sets of a node's partners in a prefix tree (its leaves in order, each
with the depth it shares with the one before), walks down with the node's set, keeps the overlap
along shared paths, and leaves a subtree when what remains cannot reach the overlap that any
of its leaves needs.

Equal sets are dropped in each task before they are posted; sets are fetched only for nodes
with candidate pairs, by a Bloom filter of fixed size. Nodes are known by a 64-bit digest.
Texts without words are linked with nothing; NULL texts are empty; repeated rows and equal
texts share a component; a NULL doc_id takes part but names no component; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import (
    Batches,
    as_bytes,
    batch,
    documents,
    join_groups,
    mix,
    put,
    slices,
)

N_GRAM = 5
COMMON = 4_000_000
GROUP = 128  # nodes of one key that are paired directly
LEADERS = 3
QUERY_BLOCK, TREE_BLOCK = 256, 2048  # nodes of a family that meet in one task
BLOCK_BYTES = 16 << 20
BANDS = [1]  # the least sizes of the bands: a linked pair lies in one or in neighbours
while BANDS[-1] < 1 << 32:
    BANDS.append(max(BANDS[-1] + 1, -(-5 * BANDS[-1] // 4)))
LONG = 64  # bytes of a word up to which words are hashed together
PAIRS_HELD = 1 << 19
BYTES_AT_ONCE = 4 << 20
RUNS, FURTHER = (1 << 23) - 1, 1 << 23
STEP = 128  # elements per step down the tree
BLOOM_BITS = 1 << 24
BLOOM_HASHES = 3

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first bytes


def least_overlap(size: int, other: int) -> int:
    """Elements that two sets of a coefficient of 0.8 or more must share."""
    return (4 * (size + other) + 8) // 9


def most_different(band: int) -> int:
    """D: elements in one set only, for linked pairs whose larger set is of this band."""
    return 2 * (BANDS[band + 1] - 1) // 9


def parts_of(band: int) -> int:
    """m: more than D, by so many that a set of the band hardly ever has as many empty runs."""
    most = most_different(band)
    return most + most // 8 + 3


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-case text begin, and a 64-bit hash of each, by its size and its
    bytes, eight at once; that of a word up to eight bytes long is its own among such of its size."""
    inside = np.concatenate([[False], ~_SPACE[np.frombuffer(data, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, size = edges[::2], edges[1::2] - edges[::2]
    padded = data + bytes(8)
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each on
    hashes = size.astype(np.uint64) * _FACTOR
    which = np.flatnonzero(size <= LONG)
    for done in range(0, LONG, 8):
        which = which[size[which] > done]
        if not len(which):
            break
        more = eight[begin[which] + done] & _FIRST[np.minimum(size[which] - done, 8)]
        hashes[which] = mix(hashes[which] ^ more) * _FACTOR
    for i in np.flatnonzero(size > LONG).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[begin[i] : begin[i] + size[i]])
    return begin, hashes


def sets_of(texts: list[bytes], n: int = N_GRAM) -> Iterator[np.ndarray]:
    """The set of each text, ascending; shorter texts are one shingle."""
    begin, flat = word_hashes(b" ".join(texts).lower())
    ends = np.cumsum([len(t) + 1 for t in texts])  # each text and the space that follows
    sizes = np.diff(np.searchsorted(begin, ends), prepend=0)
    rolled = flat.copy()
    for k in range(1, n):
        following = np.zeros(len(flat), np.uint64)
        following[: len(flat) - k] = flat[k:]
        rolled = (rolled ^ (rolled >> np.uint64(29))) * _FACTOR + following
    rolled = (mix(rolled) >> np.uint64(2)).view(np.int64)
    start = 0
    for size in sizes.tolist():
        if size >= n:
            own = np.sort(rolled[start : start + size - n + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif size:
            whole = xxhash.xxh3_64_intdigest(flat[start : start + size].tobytes(), seed=size)
            yield np.array([whole >> 2], np.int64)
        else:
            yield np.zeros(0, np.int64)
        start += size


def digest(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def runs_of(elements: np.ndarray, band: int, kind: int) -> np.ndarray:
    """A key for each run of the set that is not empty: the part, and a hash of its elements."""
    m = parts_of(band)
    part = ((elements.view(np.uint64) >> np.uint64(30)) * np.uint64(m)) >> np.uint64(32)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
    sums = np.add.reduceat(mix(elements.view(np.uint64)), starts) if len(starts) else np.zeros(0, np.uint64)
    return _named(sums, part[starts], band, kind)


def _named(sums: np.ndarray, part: np.ndarray, band: int, kind: int) -> np.ndarray:
    names = part * np.uint64(256) + np.uint64(band * 2 + kind)
    return mix(sums + names * _FACTOR).view(np.int64)


def keys_of(elements: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, runs, keys) for each band in which the set can meet a linked one.

    Keys are those of its runs without common elements, as many as ``runs``. A set of too few
    has more keys: its runs with common elements, as many as ``runs`` without the mark
    ``FURTHER``, and if need be its empty ones.
    """
    n = len(elements)
    own = int(np.searchsorted(BANDS, n, side="right")) - 1
    at = np.minimum(np.searchsorted(common, elements), max(len(common) - 1, 0))
    rare = elements[common[at] != elements] if len(common) else elements
    for band in (own, own + 1):
        if 5 * n < 4 * BANDS[band]:
            continue  # too small for a set of that band
        m, most = parts_of(band), most_different(band)
        keys = runs_of(rare, band, 0)
        runs = len(keys)
        if runs <= most:  # a linked set may share empty runs only
            whole = runs_of(elements, band, 1)
            keys, runs = np.append(keys, whole), len(whole) | FURTHER
            if len(whole) <= most:
                part = ((elements.view(np.uint64) >> np.uint64(30)) * np.uint64(m)) >> np.uint64(32)
                none = np.setdiff1d(np.arange(m, dtype=np.uint64), part)
                keys = np.append(keys, _named(np.zeros(len(none), np.uint64), none, band, 1))
        yield band, runs, keys


def least_shared(n, other, runs, of_other):
    """Runs that a linked pair shares at least: all but D of those of either set.

    Of a set that is stored in further ways those with common elements count, and only if
    the other set is, too.
    """
    further, of_both = runs & FURTHER > 0, runs & of_other & FURTHER > 0
    own = np.where(~further | of_both, runs & RUNS, 0)
    theirs = np.where((of_other & FURTHER == 0) | of_both, of_other & RUNS, 0)
    return np.maximum(np.maximum(own, theirs) - (n + other) // 9, 1)


def nodes(texts: DataFrame) -> DataFrame:
    """Per row doc_id, n and node; and rows of element and n for elements that are common in
    one partition (an element that is common at all is common in some partition)."""

    def run(batches: Batches) -> Batches:
        seen, held = set(), []
        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                sizes, names = [], []
                for elements in sets_of(b["text"].to_pylist()):
                    name = digest(elements)
                    sizes.append(len(elements))
                    names.append(name)
                    if name not in seen:
                        seen.add(name)
                        held.append(elements)
                yield batch(
                    doc_id=b["doc_id"],
                    n=pa.array(sizes, pa.int64()),
                    node=pa.array(names, pa.int64()),
                    element=pa.nulls(len(sizes), pa.int64()),
                )
        every = np.concatenate([np.zeros(0, np.int64), *held])
        held.clear()
        found, counts = np.unique(every, return_counts=True)
        often = (counts > 1) & (counts * COMMON >= len(every))
        rows = int(often.sum())
        yield batch(
            doc_id=pa.nulls(rows + 1, pa.int64()),
            n=np.append(counts[often], len(every)).astype(np.int64),
            node=pa.nulls(rows + 1, pa.int64()),
            element=np.append(found[often], -1),  # -1: all elements of the partition
        )

    return put(texts.mapInArrow(run, "doc_id bigint, n bigint, node bigint, element bigint"))


def common_elements(found: DataFrame) -> np.ndarray:
    sums = found.filter("element is not null").groupBy("element").agg(F.sum("n").alias("n"))
    total = sums.filter("element = -1").collect()
    total = total[0]["n"] if total else 0
    often = sums.filter((F.col("element") >= 0) & (F.col("n") * COMMON >= total)).select("element")
    return np.sort(often.toArrow()["element"].to_numpy())


def postings(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """key, node and meta (size, band, runs) for every run of every set, once per partition.

    ``runs`` is what ``keys_of`` says.
    """
    held = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Batches) -> Batches:
        seen = set()
        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                parts, names, metas = [], [], []
                for elements in sets_of(b["text"].to_pylist()):
                    name = digest(elements)
                    if len(elements) and name not in seen:
                        seen.add(name)
                        for band, runs, keys in keys_of(elements, held.value):
                            parts.append(keys)
                            names.append(name)
                            metas.append(len(elements) << 31 | band << 24 | runs)
                if parts:
                    lengths = [len(p) for p in parts]
                    yield batch(
                        key=np.concatenate(parts),
                        node=np.repeat(np.array(names, np.int64), lengths),
                        meta=np.repeat(np.array(metas, np.int64), lengths),
                    )

    return texts.select("text").mapInArrow(run, "key bigint, node bigint, meta bigint")


def groups(batches: Batches, names: list[str]) -> Iterator[list[np.ndarray]]:
    """Rows ordered by the first column, several whole groups at a time."""
    rest = None
    for b in batches:
        columns = [b[n].to_numpy(zero_copy_only=False) for n in names]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns)]
        key = columns[0]
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        rest = [c[cut:] for c in columns]
        if cut:
            yield [c[:cut] for c in columns]
    if rest is not None and len(rest[0]):
        yield rest


class Pairs:
    """Counts pairs of nodes; gives them up when many are held."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> bool:
        """Pairs and the runs they must share; True if it is time to take what is held."""
        self.parts.append([np.minimum(a, b), np.maximum(a, b), least, np.ones(len(a), np.int64)])
        self.size += len(a)
        if self.size > PAIRS_HELD:
            self._sum()
        return self.size > PAIRS_HELD // 2

    def _sum(self) -> None:
        a, b, least, shared = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        order = np.lexsort((b, a))
        a, b, least, shared = a[order], b[order], least[order], shared[order]
        first = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0)))
        self.parts = [[a[first], b[first], least[first], np.add.reduceat(shared, first)]]
        self.size = len(first)

    def take(self) -> pa.RecordBatch | None:
        if not self.size:
            return None
        self._sum()
        (a, b, least, shared), self.parts, self.size = self.parts[0], [], 0
        return _rows(0, a, a, b, least, shared)


PAIR = "kind int, key bigint, a bigint, b bigint, least bigint, shared bigint"


def _rows(kind: int, key, a, b, least=None, shared=None) -> pa.RecordBatch:
    one = np.ones(len(key), np.int64)
    least, shared = one if least is None else least, one if shared is None else shared
    return batch(kind=np.full(len(key), kind, np.int32), key=key, a=a, b=b, least=least, shared=shared)


def grouped(posted: DataFrame) -> DataFrame:
    """Kind 0: pairs and the runs they share, from small groups. Kind 1: a member of a large
    group and one of its leaders. Kind 2: a member (on both sides) of a large group."""

    def run(batches: Batches) -> Batches:
        pairs = Pairs()
        bounds = np.array(BANDS)
        for key, meta, node in groups(batches, ["key", "meta", "node"]):
            keep = np.append(True, (np.diff(key) != 0) | (np.diff(node) != 0))
            key, meta, node = (x[keep] for x in (key, meta, node))
            n, band, runs = meta >> 31, (meta >> 24) & 127, meta & (RUNS | FURTHER)
            starts = np.flatnonzero(np.append(True, np.diff(key) != 0))
            sizes = np.diff(np.append(starts, len(key)))
            wide = np.repeat(sizes, sizes)
            small = np.flatnonzero((wide > 1) & (wide <= GROUP))
            own, size, has, who, zone = key[small], n[small], runs[small], node[small], band[small]
            for apart in range(1, int(sizes[sizes <= GROUP].max(initial=1))):
                i = np.flatnonzero(own[apart:] == own[:-apart])
                if not len(i):
                    break
                j = i + apart  # sorted by size within a key: not the smaller one
                good = (5 * size[i] >= 4 * size[j]) & (size[j] >= bounds[zone[j]])
                i, j = i[good], j[good]
                least = least_shared(size[i], size[j], has[i], has[j])
                if len(i) and pairs.add(who[i], who[j], least):
                    yield pairs.take()
            large = (sizes > GROUP) & (n[starts + sizes - 1] >= bounds[band[starts]])
            for at, size in zip(starts[large], sizes[large]):
                own, members = key[at : at + size], node[at : at + size]
                yield _rows(2, own, members, members)
                for seed in range(LEADERS):
                    leader = members[mix(members.view(np.uint64) + np.uint64(seed)).argmin()]
                    others = np.flatnonzero(members != leader)
                    yield _rows(1, own[others], members[others], np.full(len(others), leader))
        found = pairs.take()
        if found is not None:
            yield found

    together = posted.repartition("key").sortWithinPartitions("key", "meta", "node")
    return put(together.mapInArrow(run, PAIR))


def summed_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that share as many runs as linked ones of their sizes do."""
    found = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least"))
    return found.filter("shared >= least").select("a", "b", "shared")


def _bits(name: Column) -> Column:
    seeds = [F.xxhash64(name, F.lit(i)) for i in range(BLOOM_HASHES)]
    return F.explode(F.array(*[F.pmod(s, F.lit(BLOOM_BITS)) for s in seeds]))


def bloom(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size over the ids, as a table of booleans; its words reach the driver."""
    bits = ids.select(_bits(F.col("doc_id")).alias("bit"))
    word, one = F.expr("bit div 32"), F.expr("shiftleft(1L, cast(bit % 32 as int))")
    words = bits.select(word.alias("w"), one.alias("one")).groupBy("w").agg(F.bit_or("one").alias("v"))
    table = np.zeros(BLOOM_BITS // 32, np.uint32)
    for r in words.collect():
        table[r["w"]] = r["v"]
    return np.unpackbits(table.view(np.uint8), bitorder="little")


def fetch_sets(texts: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its elements in order (binary), for the wanted nodes and a few others."""
    ids = known.join(wanted, "node", "left_semi").select(F.col("least").alias("doc_id"))
    held = texts.sparkSession.sparkContext.broadcast(bloom(ids))
    places = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(BLOOM_BITS)) for i in range(BLOOM_HASHES)]

    def run(batches: Batches) -> Batches:
        table = held.value
        seen = set()
        for b in batches:
            hit = np.ones(b.num_rows, bool)
            for i in range(BLOOM_HASHES):
                hit &= table[b[f"p{i}"].to_numpy()] == 1
            for part in slices(b.filter(pa.array(hit)), "text", BYTES_AT_ONCE):
                names, values = [], []
                for elements in sets_of(part["text"].to_pylist()):
                    name = digest(elements)
                    if len(elements) and name not in seen:
                        seen.add(name)
                        names.append(name)
                        values.append(elements.tobytes())
                yield batch(node=pa.array(names, pa.int64()), elements=pa.array(values, pa.binary()))

    placed = texts.select("text", *[p.alias(f"p{i}") for i, p in enumerate(places)])
    return put(placed.mapInArrow(run, "node bigint, elements binary"))


class PrefixTree:
    """Ordered sets as the leaves of a prefix tree, in order.

    ``shared`` is the depth of the inner node from which a leaf leaves the path of the leaf
    before.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.place = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.leaves = [sets[i] for i in self.place]
        self.smallest, self.longest = (f(map(len, self.leaves), default=0) for f in (min, max))
        self.visited = 0  # leaves that the last query came to
        self.shared = [0]
        for before, leaf in zip(self.leaves, self.leaves[1:]):
            n = min(len(before), len(leaf))
            different = np.flatnonzero(before[:n] != leaf[:n])
            self.shared.append(int(different[0]) if len(different) else n)

    def linked(self, query: np.ndarray, skip=lambda place: False) -> list[int]:
        """Which of the sets, but those to skip, have a coefficient of 0.8 or more with the query."""
        found = []
        hits = np.zeros(0, np.int64)  # overlap of the path so far, by depth
        left_at = len(query)  # where the path leaves that of the last leaf walked down
        dead = self.longest + 1  # the depth below which no leaf can be linked
        self.visited = 0
        for place, leaf, shared in zip(self.place, self.leaves, self.shared):
            left_at = min(left_at, shared)
            if shared > dead:
                continue  # in a subtree that was left
            dead = self.longest + 1
            if skip(place):
                continue
            self.visited += 1
            needed = least_overlap(len(leaf), len(query))
            depth = min(left_at, len(hits))
            left_at = len(leaf)
            steps = [hits[:depth]]
            overlap = int(hits[depth - 1]) if depth else 0
            while depth < len(leaf):
                of_query = len(query) - int(np.searchsorted(query, leaf[depth]))
                if overlap + min(len(leaf) - depth, of_query) < needed:
                    # the size that could still reach most, compared with what it needs
                    best = min(max(depth + of_query, self.smallest), self.longest)
                    if overlap + min(best - depth, of_query) < least_overlap(best, len(query)):
                        dead = depth
                    break
                part = leaf[depth : depth + STEP]
                at = np.minimum(np.searchsorted(query, part), len(query) - 1)
                steps.append(overlap + np.cumsum(query[at] == part))
                overlap = int(steps[-1][-1])
                depth += len(part)
            hits = np.concatenate(steps)
            if depth == len(leaf) and overlap >= needed:
                found.append(place)
        return found


def check(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    distinct = sets.dropDuplicates(["node"])
    of_b = distinct.select(F.col("node").alias("b"), F.col("elements").alias("set_b"))
    of_a = distinct.select(F.col("node").alias("a"), F.col("elements").alias("set_a"))

    def run(batches: Batches) -> Batches:
        for b in batches:
            a, other = b["a"].to_pylist(), b["b"].to_pylist()
            links = []
            start = 0
            while start < len(a):
                end = start
                while end < len(a) and a[end] == a[start]:
                    end += 1
                partners = b["set_b"].slice(start, end - start)
                tree = PrefixTree([np.frombuffer(x.as_buffer(), np.int64) for x in partners])
                query = np.frombuffer(b["set_a"][start].as_buffer(), np.int64)
                links += [(a[start], other[start + i]) for i in tree.linked(query)]
                start = end
            yield batch(
                a=pa.array([x for x, _ in links], pa.int64()),
                b=pa.array([y for _, y in links], pa.int64()),
            )

    joined = pairs.select("a", "b").join(of_b, "b").join(of_a, "a")
    return put(joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint"))


def components(links: DataFrame) -> DataFrame:
    """node and its component's least node, for all nodes with links.

    Alternating stars: neighbours above a node, then those below, are tied to the least of its
    neighbourhood, until nothing changes.
    """
    def around(edges: DataFrame) -> DataFrame:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.join(least, "u")

    def below(edges: DataFrame) -> DataFrame:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        return edges.join(least, "u")

    def canonical(edges: DataFrame) -> DataFrame:
        high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        return edges.filter("u != v").select(high, low).distinct()

    def sign(edges: DataFrame) -> tuple:
        row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
        return tuple(row)

    edges = put(canonical(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    before = None
    now = sign(edges)
    while now != before:
        large = canonical(
            around(edges).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        small = below(large)
        tied = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))
        )
        edges = put(canonical(tied))
        before, now = now, sign(edges)
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of nodes in different components."""
    of_a = parts.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    other = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    return joined.filter(other).select(*pairs.columns)


class Joined:
    """Which of a task's nodes are connected so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(above, above)
            x = above
        return x

    def tie(self, x: int, y: int) -> bool:
        """Connect two nodes; False if they were connected."""
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def within_families(votes: DataFrame, members: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect different components of nodes tied together by large groups."""
    families = components(votes).withColumnRenamed("component", "family")
    nodes = members.select(F.col("a").alias("node")).distinct().join(families, "node")
    nodes = nodes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    nodes = put(nodes.select("node", "family", "part"))
    nodes = put(nodes.join(sets.dropDuplicates(["node"]), "node"))
    held = F.sum(F.octet_length("elements")).alias("bytes")
    counts = nodes.groupBy("family", "part").agg(F.count(F.lit(1)).alias("size"), held)
    by_family = counts.groupBy("family").agg(
        F.max(F.struct("size", "part"))["part"].alias("main"),
        F.sum("size").alias("all"),
        F.sum("bytes").alias("all_bytes"),
        (F.sum("size") - F.max("size")).alias("outside"),
    )
    open_families = put(by_family.filter("outside > 0"))

    def blocks(n: str, size: int) -> Column:
        """As many that one holds ``size`` sets, and no more of the family than ``BLOCK_BYTES``
        if sets were of one size."""
        share = F.col("all_bytes") / F.col("all") * F.col(n) / BLOCK_BYTES
        return F.ceil(F.greatest(F.col(n) / size, share)).cast("int")

    placed = nodes.join(open_families, "family")
    placed = placed.withColumns(
        {"queries": blocks("outside", QUERY_BLOCK), "trees": blocks("all", TREE_BLOCK)}
    )
    columns = ["family", "query", "tree", "is_query", "node", "part", "elements"]
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = placed.withColumns({"tree": own("trees"), "query": every("queries"), "is_query": F.lit(False)})
    asked = placed.filter("part != main").withColumns(
        {"query": own("queries"), "tree": every("trees"), "is_query": F.lit(True)}
    )

    def meet(key, rows):
        joined, links = Joined(), []
        names = list(zip(*(rows[c].to_pylist() for c in ("is_query", "node", "part"))))
        sets = [np.frombuffer(x, np.int64) for x in rows["elements"].to_pylist()]
        for _, node, part in names:
            joined.tie(node, part)  # components count as nodes
        inside = [i for i, (is_query, *_) in enumerate(names) if not is_query]
        tree = PrefixTree([sets[i] for i in inside])
        for i, (is_query, node, _) in enumerate(names):
            if is_query:
                root = joined.root
                skip = lambda place, node=node: root(names[inside[place]][1]) == root(node)
                for place in tree.linked(sets[i], skip):
                    other = names[inside[place]][1]
                    if joined.tie(node, other):
                        links.append((min(node, other), max(node, other)))
        return pa.table(
            {"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())}
        )

    rows = stored.select(*columns).unionByName(asked.select(*columns))
    return put(rows.groupBy("family", "query", "tree").applyInArrow(meet, "a bigint, b bigint"))


def best_partners(pairs: DataFrame) -> DataFrame:
    """For each node the pair that shares most."""
    both = pairs.select("a", "b", "shared").union(pairs.select("b", "a", "shared"))
    best = both.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best"))
    low, high = F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")
    return best.select(low, high).distinct()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links)."""
    texts = as_bytes(documents(docs))
    found = nodes(texts)
    near = grouped(postings(texts, common_elements(found)))

    rows = found.filter("element is null").select("doc_id", "n", "node")
    known = rows.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    known = put(known)
    pairs = put(summed_pairs(near.filter("kind = 0")))
    votes = near.filter("kind = 1")
    votes = votes.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    first = put(best_partners(pairs).union(best_partners(votes)).distinct())
    ends = pairs.select("a", "b").union(votes.select("a", "b"))
    wanted = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = fetch_sets(texts, known, wanted)

    links = check(first, sets)
    parts = put(components(links))
    left = put(apart(pairs.select("a", "b"), parts).join(first, ["a", "b"], "left_anti"))
    more = within_families(votes, near.filter("kind = 2"), parts, sets)
    parts = put(components(links.union(check(left, sets)).union(more)))

    # the least doc_id of each component, for its nodes; then of each node, for its rows
    tied = put(known.join(parts, "node").select("node", "component", "least", "copies"))
    whole = tied.groupBy("component").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("size"))
    named = join_groups(tied, whole, ["component"], tied.count())
    named = named.select("node", "name", F.col("copies").alias("size"))
    alone = known.join(parts, "node", "left_anti").filter("copies > 1")
    named = put(named.unionByName(alone.selectExpr("node", "least AS name", "copies AS size")))
    final = join_groups(rows.filter("n > 0"), named, ["node"], rows.count())
    none = rows.filter("n = 0").selectExpr("doc_id", "n AS n_shingles", "doc_id AS component_id")
    name = F.coalesce("name", "doc_id").alias("component_id")
    return final.select("doc_id", F.col("n").alias("n_shingles"), name).unionByName(none)
