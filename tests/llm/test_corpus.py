"""Operators over whole tables: joins, models, archives, conversations, the pipeline."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrace.llm import brown, chat, jaccard, multi_index, oracle, warc
from terrace.llm import queries as registered
from tests.llm.data import brute_components, docs, no_docs, prose, rows
from tests.oracle_check import connect, differences


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_its_sql(name, spark, data):
    with connect(data) as duck:
        assert differences(registered.QUERIES[name](spark, data), duck, oracle.ORACLE[name]) == []


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14))


# Jaccard join


def components(frame):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(frame).collect())


def test_components_are_those_of_all_pairs(spark):
    pairs = [(r[0], r[1]) for r in rows()]
    assert components(docs(spark)) == Counter(brute_components(pairs))
    assert jaccard.join(no_docs(spark)).count() == 0


def test_families_larger_than_a_group(spark, monkeypatch):
    """Near copies in families, with and without a passage that all texts share."""
    monkeypatch.setattr(jaccard, "GROUP", 6)
    passage = prose(50, 60)
    pairs = []
    for family in range(3):
        base = prose(60 + family, 150).split()
        for copy in range(20):
            words = list(base)
            for k in range(copy % 4):
                words[(copy * 37 + k * 53) % len(words)] = f"w{copy}x{k}"
            pairs.append((len(pairs), " ".join(words) + (f" {passage}" if family else "")))
    pairs += [(len(pairs) + i, f"{prose(90 + i, 120)} {passage}") for i in range(12)]
    frame = spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(4)
    assert components(frame) == Counter(brute_components(pairs))


def test_words_are_hashed_together(monkeypatch):
    """No digest is called for each word; words differ by any byte, wherever texts end."""
    called = []
    one_by_one = jaccard.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(jaccard.xxhash, "xxh3_64_intdigest", lambda *a, **b: called.append(a) or one_by_one(*a, **b))
    words = [f"w{i}{'x' * (i % 60)}" for i in range(3000)]
    (found,) = jaccard.sets_of([" ".join(words).encode()])
    assert len(found) == 2996 and (np.diff(found) > 0).all() and not called
    odd = [b"", b" \n", b"a", b"A\x0b", b"a\x00", b"ab c d e f", b"a bc d e f", b"\tab  c\rd\ne\x0cF ", b"a b c d e f"]
    odd += [b"%sy b c d e" % (b"x" * n) for n in (7, 8, 63, 64, 65)]
    sets = [frozenset(x.tolist()) for x in jaccard.sets_of(odd)]
    assert list(map(len, sets)) == [0, 0, 1, 1, 1, 1, 1, 1, 2, 1, 1, 1, 1, 1]
    assert sets[2] == sets[3] and sets[5] == sets[7] and len(set(sets)) == len(odd) - 3
    assert list(jaccard.sets_of([])) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=25), min_size=2, max_size=8))
def test_the_prefix_tree_finds_the_links(sets):
    ordered = [np.array(sorted(s), np.int64) for s in sets]
    tree = jaccard.PrefixTree(ordered[1:])
    expected = [i for i, s in enumerate(sets[1:]) if 100 * len(s & sets[0]) >= 80 * len(s | sets[0])]
    assert sorted(tree.linked(ordered[0])) == expected


@settings(max_examples=300, deadline=None)
@given(n=st.integers(1, 400), out=st.integers(0, 100), new=st.integers(0, 100), often=st.sampled_from([0, 0.5, 0.9, 1]), seed=st.integers(0, 99))
def test_linked_sets_share_runs(n, out, new, often, seed):
    """As many as are asked, in the band of the larger set, whatever elements are common."""
    rng = np.random.default_rng(seed)
    first = np.unique(rng.integers(0, 1 << 62, n))
    second = np.union1d(first[out:], rng.integers(0, 1 << 62, new))
    both = len(np.intersect1d(first, second))
    if not len(second) or 100 * both < 80 * (len(first) + len(second) - both):
        return
    common = np.unique(rng.choice(first, int(often * len(first)), replace=False)) if often else first[:0]
    found = [{band: (runs, set(keys.tolist())) for band, runs, keys in jaccard.keys_of(x, common)} for x in (first, second)]
    band = int(np.searchsorted(jaccard.BANDS, max(len(first), len(second)), side="right")) - 1
    (one, mine), (two, theirs) = found[0][band], found[1][band]
    least = jaccard.least_shared(*map(np.array, (len(first), len(second), one, two)))
    assert len(mine & theirs) >= least >= 1


def test_subtrees_are_left():
    """Sets of one beginning that the query lacks: one of them is come to."""
    rng = np.random.default_rng(4)
    query = np.sort(rng.choice(1 << 40, 300, replace=False)) + (1 << 20)
    unlike = [np.append(np.arange(200), 1000 + np.sort(rng.choice(9000, 100, replace=False))) for _ in range(50)]
    near = [np.delete(query, [i]) for i in range(5)]
    tree = jaccard.PrefixTree([*unlike, *near])
    assert sorted(tree.linked(query)) == [50, 51, 52, 53, 54]
    assert tree.visited <= 6


def test_texts_that_share_a_passage_hardly_ever_meet(spark):
    passage = prose(50, 60)
    texts = [(i, f"{prose(300 + i, 200)} {passage} {prose(900 + i, 200)}") for i in range(100)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    posted = jaccard.postings(jaccard.as_bytes(jaccard.documents(frame)), np.zeros(0, np.int64))
    met = jaccard.grouped(posted)
    assert met.count() < 1500  # of 4950 pairs
    assert jaccard.summed_pairs(met).count() < 50  # share enough runs for their sizes


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101)]
    found = jaccard.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {(r.node, r.component) for r in found} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# Class model


def test_base_scores_counts_and_copies(spark):
    found = brown.score(docs(spark)).collect()
    expected = []
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows()]
    tokens = [[*(r[1] or "").encode().lower().split(), None] for r in rows()]
    counts = Counter(t for own, h in zip(tokens, held) if not h for t in own)
    n, v = sum(counts.values()), len(counts)
    for r, own, h in zip(rows(), tokens, held):
        base = sum(np.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        expected.append((str(r[0]), h, len(own), sum(counts[t] > 0 for t in own), n, round(base, 6)))
    ours = [
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in found
    ]
    assert sorted(ours) == sorted(expected)
    assert all(r.score < 0 and np.isfinite(r.score) for r in found)
    assert brown.score(no_docs(spark)).count() == 0


def test_classes_find_structure_and_lower_perplexity(spark, data):
    found = registered.QUERIES["op1_brown_scores"](spark, data).filter("held_out").collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_scores_do_not_depend_on_how_the_input_is_cut(spark, data):
    whole = spark.read.parquet(f"{data}/documents.parquet")
    scores = []
    for parts in (1, 9):
        found = brown.score(whole.repartition(parts)).collect()
        scores.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in found})
    assert scores[0].keys() == scores[1].keys()
    for doc_id, values in scores[0].items():
        assert np.allclose(values, scores[1][doc_id], rtol=1e-9)


def test_tokens_are_those_of_bytes():
    texts = ["", " \t ", "A b\x0bB  a\n", "É\u00a0É x\x1cy", "a\x00b a\x00b", "end "]
    for part in (texts, texts[2:], texts[:2], []):
        sliced = pa.array(["zz", *part], pa.string()).slice(1)
        numbers, starts, words = brown.tokens_of(sliced.cast(pa.binary()))
        named = words.named(np.arange(len(words.hashes)))
        found = [named[i] if i >= 0 else None for i in numbers]
        expected = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [None] for t in part]
        assert found == [w for own in expected for w in own]
        assert list(starts) == list(np.cumsum([0, *map(len, expected)])[:-1])


def test_words_below_the_common_ones_have_classes_by_their_neighbours(spark, monkeypatch):
    """Words of one ending and of two uses, like those of two common words."""
    monkeypatch.setattr(brown, "common_words", lambda training: [b"aa", b"bb", b"cc", b"dd", b"p", b"q"])
    monkeypatch.setattr(brown, "cluster", partial(brown.cluster, classes=7))
    texts = [f"aa w{i}xyz bb cc v{i}xyz dd aa p bb cc q dd" for i in range(10) for _ in range(40)]
    odd = ["aa w1xyz bb cc v1xyz dd", "aa v1xyz bb cc w1xyz dd"]
    frame = spark.createDataFrame(list(enumerate(texts + odd)), "doc_id bigint, text string")
    score = {r.doc_id: r.score for r in brown.score(frame).collect()}
    assert score[400] > score[401] + 1


def test_each_task_sends_a_row_for_each_bucket_of_words(spark, monkeypatch):
    """However many further words there are: the rows that are shuffled follow the tasks."""
    kind, sent = type(spark.range(1)), []
    dealt = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *on: sent.append(df) or dealt(df, *on))
    monkeypatch.setattr(brown, "cluster", partial(brown.cluster, classes=3, rounds=1))
    monkeypatch.setattr(brown, "common_words", lambda training: [b"aa", b"bb"])
    words = 4000
    texts = [" ".join(f"aa w{i + j} bb" for j in range(100)) for i in range(0, words, 100) for _ in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    assert brown.score(frame).count() == len(texts)
    gathered = [df for df in sent if "node" in df.columns]
    most = 2 * max(brown.WORD_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert len(gathered) == 1 and 0 < gathered[0].count() <= most < words


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 20, (12, 12)).astype(float)
    own = np.array([*(i % 3 for i in range(11)), 3])

    def between(classes):
        one = np.zeros((12, 4))
        one[np.arange(12), classes] = 1
        return one.T @ pairs @ one

    for word in range(11):
        out, into = np.bincount(own, pairs[word], 4), np.bincount(own, pairs[:, word], 4)
        rest, out, into = brown.without(own[word], out, into, pairs[word, word], between(own))
        gain = brown.gains(rest, out, into, pairs[word, word])
        for other in range(3):
            moved = own.copy()
            moved[word] = other
            change = brown.log_likelihood(between(moved)) - brown.log_likelihood(between(own))
            assert abs(gain[other] - gain[own[word]] - change) < 1e-6


# Chat


def test_turns_come_back_and_neighbours_are_merged(spark):
    said = [
        (1, 0, "user", "hi </turn> \\l"), (1, 1, "user", "<text>again\\"), (1, 2, "assistant", "ok"),
        (1, 3, "assistant", ""), (1, 4, None, None), (1, 4, "user", "tie"), (2, 0, "assistant", "only"),
        (2, 0, "assistant", "only"), (None, None, "user", "lost"),
    ]
    frame = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").withColumn("segments", F.lit(1))
    made = chat.format_chat(frame)
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"),
                       chat.learned_text(F.col("segments")).alias("learned"))
    by_id = {r.conv_id: r for r in read.collect()}
    turns = sorted((r for r in said if r[0] == 1), key=lambda r: (r[1], r[2] or "", r[3] or ""))
    assert [(t.role, t.text) for t in by_id[1].t] == [(r[2] or "", r[3] or "") for r in turns]
    assert by_id[1].learned == "ok" and by_id[2].learned == "onlyonly"
    assert by_id[1].formatted.count("<turn>") == 4  # two users and two assistants are merged
    assert [(t.role, t.text) for t in by_id[None].t] == [("user", "lost")]
    assert chat.format_chat(frame.limit(0)).count() == 0


# Nearest neighbours


def vectors(spark, n=300):
    rng = np.random.default_rng(5)
    made = [(i, rng.normal(size=8).astype(np.float32).tolist(), 1) for i in range(n)]
    made[40] = (40, made[3][1], 1)  # equal vectors: a tie
    odd = [(1000, None, 1), (1020, [0.0] * 8, 1), (1040, [1.0, float("nan")] + [0.0] * 6, 1),
           (1060, [float("inf")] * 8, 1), (1080, [1.0, None] + [0.0] * 6, 1), (1100, [1.0], 1), (None, [1.0] * 8, 1)]
    return made, spark.createDataFrame(made + odd, "vec_id bigint, embedding array<float>, rank int")


def searched(spark, frame, k, visited):
    usable = multi_index.usable(frame)
    centres = multi_index.fit(usable)
    indexed = multi_index.index(usable, centres)
    queries = indexed.filter("vec_id % 20 = 0").select("vec_id", "row", "vector")
    return multi_index.search(indexed, queries, centres, k, visited).collect()


def test_visiting_all_is_exact_and_half_is_close(spark):
    made, frame = vectors(spark)
    m = np.array([v for _, v, _ in made], np.float64)
    exact = set()
    for q in range(0, 300, 20):
        scores = (m * m[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(300), -scores)) if i != q][:10]
        exact |= {(q, rank + 1, i, float(scores[i])) for rank, i in enumerate(order)}
    assert {tuple(r) for r in searched(spark, frame, 10, 1.0)} == exact
    found = {(r.query_id, r.vec_id) for r in searched(spark, frame, 10, multi_index.VISITED)}
    assert len(found & {(q, i) for q, _, i, _ in exact}) >= 0.9 * len(exact)


@pytest.mark.parametrize("spread", [0.25, 0.5, 1.0])
def test_recall_holds_for_unequal_norms(spark, spread):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(1000, 32))
    m *= np.exp(spread * rng.normal(size=(1000, 1))) / np.sqrt((m**2).sum(1))[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in searched(spark, frame, 10, multi_index.VISITED)}
    exact = set()
    for q in range(0, 1000, 20):
        exact |= {(q, int(i)) for i in [i for i in np.argsort(-(m @ m[q])) if i != q][:10]}
    assert len(found & exact) >= 0.9 * len(exact)


def test_repeated_rows_are_queries_and_candidates_of_their_own(spark):
    made, frame = vectors(spark, 60)
    twice = frame.unionByName(frame.filter("vec_id = 20"))
    found = Counter((r.query_id, r["rank"], r.vec_id) for r in searched(spark, twice, 5, 1.0))
    m = np.array([v for _, v, _ in made] + [made[20][1]], np.float64)
    ids, expected = [*range(60), 20], Counter()
    for row in [i for i, name in enumerate(ids) if name % 20 == 0]:
        near = sorted((i for i in range(61) if i != row), key=lambda i: (-(m[i] * m[row]).sum(), ids[i]))
        expected.update((ids[row], rank + 1, ids[i]) for rank, i in enumerate(near[:5]))
    assert found == expected


def test_few_vectors_give_all_and_none_give_none(spark):
    _, frame = vectors(spark, 300)
    few = searched(spark, frame.filter("vec_id < 5"), 20, 0.1)
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert searched(spark, frame.filter("vec_id is null"), 20, 0.5) == []


def test_cells_are_visited_in_order():
    sizes = np.ones((3, 4), int)
    first, second = np.array([0.0, 2.0, 5.0]), np.array([1.0, 0.0, 9.0, 3.0])
    visited = multi_index.traverse(first, second, sizes, 4)
    sums = first[:, None] + second[None, :]
    assert visited.sum() == 4 and sums[visited].max() <= sums[~visited].min()


# Archives


def test_archives_hold_every_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_ARCHIVE", 3)
    pages = [(i, f"http://a{i % 3}.example.com/x?{i}", f"<p>{i % 4}\r\n\r\nWARC/1.1\r\n é</p>") for i in range(20)]
    pages += [(20, None, None), (21, "not a url\r\nX: y", ""), (22, "http://[bad", "z"), (22, "http://[bad", "z"), (None, "u", "z")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    found = warc.archive_index(frame).collect()
    largest = {}
    for name, _, html in pages:
        if name is not None:
            largest[html or ""] = max(largest.get(html or "", name), name)
    expected = []
    for name, _, html in pages:
        payload = (html or "").encode()
        refers = None if largest[html or ""] == name else largest[html or ""]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected.append((name, len(payload), digest, "revisit" if refers is not None else "response", refers))
    ours = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert Counter(ours) == Counter(expected)
    keys = [(r.url_key, r.captured_at) for r in found]
    assert keys == sorted(keys)
    assert warc.archive_index(frame.limit(0)).count() == 0


@given(st.lists(st.lists(st.integers(0, 30)), max_size=7))
def test_the_loser_tree_merges(lists):
    merged = list(warc.LoserTree([sorted(x) for x in lists], lambda x: x))
    assert merged == sorted(x for own in lists for x in own)


# Pipeline


def test_every_page_has_one_language(spark, data):
    found = registered.QUERIES["page_languages"](spark, data).collect()
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    known = {r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("lang").collect()}
    assert sorted(r.page_id for r in found) == sorted(r.page_id for r in pages)
    blank = {r.page_id for r in pages if not re.sub(r"(?s)<[^>]*>", "", r.html or "").strip()}
    for r in found:
        assert r.lang in known | {"und"} and 0 < r.probability <= 1 + 1e-9
        assert r.kept == (r.lang != "und") and not (r.kept and r.page_id in blank)


def test_workers_of_the_pipeline_return_what_they_free(spark, monkeypatch):
    """Large arrays that one stage has freed are not held while the next one runs."""
    import corpus_pipeline

    def held(batches):
        for b in batches:
            before = int(open("/proc/self/statm").read().split()[1])
            arrays = [np.ones(2 << 17) for _ in range(32)]  # of 2 MB, 64 in all
            arrays.clear()
            pages = int(open("/proc/self/statm").read().split()[1]) - before
            pool = pa.default_memory_pool().backend_name
            yield pa.RecordBatch.from_pydict({"pages": pa.array([pages]), "pool": pa.array([pool])})

    monkeypatch.setattr(spark.sparkContext, "environment", dict(spark.sparkContext.environment))
    corpus_pipeline.bounded(spark)
    (found,) = spark.range(1).coalesce(1).mapInArrow(held, "pages bigint, pool string").collect()
    assert found.pool == "system" and found.pages * 4096 < 16 << 20


def test_the_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    good = [prose(200 + i, 150) for i in range(30)]
    near = " ".join(good[4].split()[:148] + ["quite", "new"])
    texts = good + [good[3], near, None, "", "too short", "again and again the same " * 20,
                    good[5] + ' token: "hunter2hunter2"']
    table = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame(table, schema).withColumn("component_id", F.lit(0)).withColumn("kept", F.lit(0))
    kept = frame
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "")
        kept.write.parquet(str(tmp_path / name.replace(" ", "_")))
        kept = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = {r.doc_id for r in kept.select("doc_id").collect()}
        if name != "packing":
            assert kept.columns == corpus_pipeline.COLUMNS
    everything = set(range(len(texts)))
    assert seen["language ID"] == everything - {32, 33}
    assert seen["quality rules"] == everything - {32, 33, 34, 35}
    assert seen["n-gram Jaccard join"] == everything - {30, 31, 32, 33, 34, 35, 36}
    assert seen["packing"] == seen["secret scans"] == seen["n-gram Jaccard join"]
    none = frame.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0
