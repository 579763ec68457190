"""Exact deduplication, lexical search and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrace.llm import exact_dedup, lexical_search, repair
from tests.llm.data import BASE, docs, no_docs, rows

# Exact deduplication


def brute_groups(table):
    """(doc_id, text) to the rows of the operator; of a doc_id's equal rows one stays."""
    groups = {}
    for at, (name, text) in enumerate(table):
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()
        groups.setdefault(digest, []).append((name is None, name or 0, at, name))
    found = []
    for digest, own in groups.items():
        own.sort(key=lambda x: x[:3])
        found += [(n, own[0][3], len(own), at == 0, digest) for at, (*_, n) in enumerate(own)]
    return Counter(found)


@pytest.mark.parametrize("fan_in, partitions", [(8, 3), (2, 5), (4, 1)])
def test_rows_that_stay_are_those_of_brute_force(spark, fan_in, partitions):
    frame = docs(spark).repartition(partitions)
    found = Counter(tuple(r) for r in exact_dedup.dedup(frame, fan_in).collect())
    assert found == brute_groups([(r[0], r[1]) for r in rows()])
    assert exact_dedup.dedup(no_docs(spark)).count() == 0


def test_a_group_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUN_ENTRIES", 64)
    monkeypatch.setattr(exact_dedup, "BLOCK_ENTRIES", 8)
    table = [(i, "one  text" if i % 3 == 0 else f"text\t{i // 2}") for i in range(3000)]
    frame = spark.createDataFrame(table, "doc_id bigint, text string").repartition(7)
    assert Counter(tuple(r) for r in exact_dedup.dedup(frame).collect()) == brute_groups(table)


def test_texts_of_one_digest_and_other_witnesses_stay_apart():
    entries = np.zeros((4, exact_dedup.WIDTH), np.uint64)
    entries[:, exact_dedup.COUNT] = 1
    entries[1:3, exact_dedup.WITNESS] = 7
    entries[:, exact_dedup.IDENTIFIER + 1] = [5, 9, 4, 6]
    merged = exact_dedup.merge([entries[:2], entries[2:]])
    assert merged[:, exact_dedup.COUNT].tolist() == [2, 2]
    assert merged[:, exact_dedup.IDENTIFIER + 1].tolist() == [5, 4]


@settings(max_examples=60, deadline=None)
@given(
    runs=st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=30), max_size=6),
    size=st.integers(1, 7),
)
def test_streams_of_blocks_merge(runs, size):
    sent = []
    for words in runs:
        run = np.zeros((len(words), exact_dedup.WIDTH), np.uint64)
        run[:, 0], run[:, exact_dedup.COUNT] = words, 1
        run = exact_dedup.merge([run])
        sent += [(int(run[i, 0]), run[i : i + size].tobytes()) for i in range(0, len(run), size)]
    done = list(exact_dedup.merged(iter(sorted(sent)), at_once=1))
    found = np.concatenate(done) if done else np.zeros((0, exact_dedup.WIDTH), np.uint64)
    expected = Counter(w for own in runs for w in own)
    assert [(int(r[0]), int(r[exact_dedup.COUNT])) for r in found] == sorted(expected.items())


@given(bits=st.integers(1, 12), fan_in=st.sampled_from([2, 4, 8, 16]), number=st.integers(0, 4095), word=st.integers(0, 2**64 - 1))
def test_rounds_lead_every_digest_to_its_partition(bits, fan_in, number, word):
    rounds = exact_dedup.Rounds(bits, fan_in)
    at = number % rounds.partitions
    for k in range(len(rounds.cuts)):
        went = int(rounds.targets(at, k, np.array([word], np.uint64))[0])
        assert bin(went ^ at).count("1") <= (fan_in - 1).bit_length()
        at = went
    assert at == word >> (64 - bits)


# Lexical search


def own_terms(text):
    folded = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute_search(table, items, k=10):
    bags = [(name, Counter(own_terms(text))) for name, text in table]
    bags = [(name, bag, sum(bag.values())) for name, bag in bags if bag]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    found = []
    for item_id, text in items:
        scored = []
        for name, bag, n in bags:
            m = 25 + 75 * n * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in own_terms(text)
                if t in bag
            )
            if score > 0:
                scored.append((-score, name is None, name, score))
        scored.sort(key=lambda x: x[:2] + (x[2] or 0,))
        found += [(item_id, i + 1, name, score) for i, (*_, name, score) in enumerate(scored[:k])]
    return Counter(found)


ITEMS = [
    (0, "THE of, the! to-and 12 été"),
    (1, BASE),
    (2, None),
    (3, "... \n"),
    (4, "no such word zzzz"),
    (4, "five words ARE one shingle"),
    (None, "dont DON'T we'll \U0001f600中文"),
]


def searched(spark, table, items=ITEMS, parts=3):
    frame = spark.createDataFrame(table, "doc_id bigint, text string").withColumn("bag", F.lit(1))
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("m", F.lit("x"))
    return Counter(tuple(r) for r in lexical_search.search(frame.repartition(parts), asked).collect())


def test_ranks_are_those_of_brute_force(spark):
    table = [(r[0], r[1]) for r in rows()] + [(100 + i, f"the été {'of ' * (i % 4)}") for i in range(60)]
    expected = brute_search(table, ITEMS)
    assert len({e[0] for e in expected}) == 4
    assert searched(spark, table) == expected
    assert searched(spark, [], ITEMS) == Counter()
    assert searched(spark, table, []) == Counter()
    assert searched(spark, [(1, None), (2, "?!")], ITEMS) == Counter()


def test_items_in_blocks_have_the_same_ranks(spark, monkeypatch):
    table = [(r[0], r[1]) for r in rows()]
    items = [i for i in ITEMS if i[0] is not None]
    monkeypatch.setattr(lexical_search, "ITEMS_AT_ONCE", 2)
    monkeypatch.setattr(lexical_search, "CLASSES_AT_ONCE", 3)
    assert searched(spark, table, items) == brute_search(table, items)


def test_blocks_keep_their_bounds(monkeypatch):
    monkeypatch.setattr(lexical_search, "TERMS_AT_ONCE", 5)
    monkeypatch.setattr(lexical_search, "WEIGHTS_AT_ONCE", 8)
    block = lexical_search.Block()
    assert block.fits(Counter("abcdef"))
    block.add(1, Counter("abca"))
    assert block.fits(Counter("abd")) and not block.fits(Counter("de")) and not block.fits(Counter("defg"))
    block.add(2, Counter("ab"))
    assert block.asked_table().tolist() == [[2, 1], [1, 1], [1, 0]]


def test_copies_are_scored_once(spark):
    """Documents of equal bags are one class, whatever stands between their asked words."""
    table = [(i, f"alpha x{i} beta") for i in range(50)] + [(50 + i, "beta alpha  alpha?") for i in range(50)]
    frame = spark.createDataFrame(table, "doc_id bigint, text string").repartition(4)
    block = next(lexical_search.item_blocks(spark.createDataFrame([(7, "alpha beta")], "item_id int, text string")))
    bags = lexical_search.bags(frame, block.number).select("bag").distinct().count()
    assert bags == 2
    assert searched(spark, table, [(7, "alpha beta")]) == brute_search(table, [(7, "alpha beta")])


# Conversation repair

SPACE = " \t\n\x0b\x0c\r"


def brute_faults(own):
    seen, found = set(), []
    for _, role, text in own:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else ""
        found.append(fault or ("" if bare[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return found


def brute_repair(own, faults, most=6):
    """Cheapest edits by trying all of them, insertions up to ``most`` in all."""
    best = [None]
    grammar = re.compile(r"(s?(ua)+)?")

    def go(i, cost, audit, said, initials):
        if best[0] and cost > best[0][0]:
            return
        if not re.fullmatch(r"s?(ua)*u?", initials):
            return
        if i == len(own) and grammar.fullmatch(initials):
            best[0] = min(filter(None, [best[0], (cost, audit, said)]))
        if audit.count("I") < most:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", (*said, f"{role}:"), initials + role[0])
        if i < len(own):
            _, role, text = own[i]
            go(i + 1, cost + 3, audit + "D", said, initials)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                go(i + 1, cost + more, audit + "K", (*said, f"{role}:{text}"), initials + (role[:1] or "-"))
                for given in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", (*said, f"{given}:{text}"), initials + given[0])

    # the cost of deleting all is a bound to begin with
    best[0] = (3 * len(own) + 1, "~", ())
    go(0, 0, "", (), "")
    return best[0]


def brute_result(own):
    """Rows (turn, role, text) of one conversation, after damage and in order."""
    faults = brute_faults(own)
    turns = [t for t, *_ in own if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in own]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    cost, audit, said = brute_repair(own, faults)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def repaired(spark, table):
    frame = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string")
    return {r.conv_id: tuple(r)[1:] for r in repair.repair(frame.withColumn("fault", F.lit(9))).collect()}


def in_order(own):
    return sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def test_repairs_are_the_cheapest_of_all(spark):
    """All sequences of up to four rows of three roles, odd ones and faults among them."""
    conversations = []
    for size in range(1, 4):
        conversations += list(product(["system", "user", "assistant", "tool"], repeat=size))
    said = ["Yes.", "no", " ", "Yes."]
    table, expected = [], {}
    for name, roles in enumerate(conversations):
        own = [(i, r, said[(name + i) % 4]) for i, r in enumerate(roles)]
        table += [(name, *r) for r in own]
        expected[name] = brute_result(in_order(own))
    assert repaired(spark, table) == expected


@settings(max_examples=40, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.sampled_from([None, 0, 1, 1, 5]),
            st.sampled_from(["system", "user", "assistant", "", " ", "ünknown", "usr"]),
            st.sampled_from(["a.", "b?", "c", "", "\x0b", "a.\n", "é!"]),
        ),
        max_size=5,
    )
)
def test_the_parser_finds_the_cheapest_repair(own):
    own = in_order(own)
    faults = brute_faults(own)
    codes = ["", "blank", "duplicate", "truncated"]
    parser = repair.Repair()
    for (_, role, text), fault in zip(own, faults):
        parser.row(role, text.encode(), codes.index(fault))
        assert len(parser.stacks) <= repair.STATES
    cost, audit, said = brute_repair(own, faults)
    assert parser.end() == (cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def test_long_conversations_ties_and_odd_rows(spark):
    long = [(9, i, ("user", "assistant")[i % 2], f"Text {i}.") for i in range(3001) if i != 1500]
    odd = [(1, None, "user", "hm."), (1, 3, "user", "b."), (1, 3, "assistant", "a."), (1, 3, "user", "b."),
           (None, None, "system", "rules"), (2, 0, "", ""), (3, 0, "assistant", "x" * 200_000)]
    found = repaired(spark, long + odd)
    for name in (1, None, 2, 3):
        assert found[name] == brute_result(in_order([r[1:] for r in odd if r[0] == name]))
    gaps, *_, illegal, cost, audit, digest = found[9]
    # without turn 1500, turn 1499 and 1501 are of one role, and turn 3000 has no answer
    assert (gaps, illegal, cost) == (1, 1, 4) and audit == "K" * 1500 + "I" + "K" * 1500 + "I"
    said = [f"{r[2]}:{r[3]}" for r in long]
    said = [*said[:1500], "user:", *said[1500:], "assistant:"]
    assert digest == hashlib.sha256("\n".join(said).encode()).hexdigest()
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.repair(repair.damaged(empty)).count() == 0


def test_damage_by_hash(spark):
    table = [(c, t, r, x) for c in (1, 2, None) for t in (*range(40), None) for r, x in (("system", "A. b? c!"), (None, None))]
    frame = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string")
    expected = Counter()
    for c, t, r, x in table:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(name.encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        text = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        expected[c, t, "user" if kind == 4 else r, text, kind == 0] += 2 if kind == 3 else 1
    assert Counter(tuple(r) for r in repair.damaged(frame).collect()) == expected


def test_conversations_that_lose_all_rows_remain(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(lost, 0, "user", "a.")], "conv_id bigint, turn bigint, role string, text string")
    found = repair.repair(repair.damaged(frame)).collect()
    assert [tuple(r) for r in found] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
