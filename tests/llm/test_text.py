"""Tokenizing, packing, scanning and measuring single texts."""

from __future__ import annotations

import base64
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrace.llm import bpe, common, host_rules, language, packing, secret_scan
from tests.llm.data import TEXTS, docs, no_docs, prose, rows

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.load(MULTI, PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("abet hT,.'\n\t éß中1½-")), max_size=60))
def test_ids_are_those_of_the_library(codec, reference, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_the_perfect_hash_is_minimal(codec):
    table = codec.table
    assert sorted(table.number) == list(range(table.n)) and all(table.keys)
    assert table.find(b"surely no token of it") == -1
    assert bpe.PerfectHash([]).find(b"a") == -1


def test_encode_and_decode(spark, reference):
    done = bpe.decode(bpe.encode(docs(spark), MULTI, PATTERN), MULTI, PATTERN).collect()
    expected = Counter(
        (r[0], np.array(reference.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode())
        for r in rows()
    )
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in done) == expected
    assert bpe.encode(no_docs(spark), MULTI, PATTERN).count() == 0


def test_pieces_are_the_ids_in_powers_of_two(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    packed = packing.pack(packing.decompose(docs(spark), JSON, PATTERN)).collect()
    assert len({r.sequence_id for r in packed}) == len(packed) and {r.offset for r in packed} == {0}
    assert all(r.length == 1 << r.bucket and r.length <= 1024 for r in packed)
    for name, text in {r[0]: r[1] for r in rows() if r[0] != 7}.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in packed if r.doc_id == name), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes()
        assert {r.doc_tokens for r in own} == {len(ids)}
    assert packing.decompose(no_docs(spark), JSON, PATTERN).count() == 0
    assert packing.binary_lengths(2053) == [1024, 1024, 4, 1]


def test_buckets_hold_one_length(spark, tmp_path):
    packed = packing.pack(packing.decompose(docs(spark), JSON, PATTERN))
    packing.write_buckets(packed, str(tmp_path / "b"))
    read = spark.read.parquet(str(tmp_path / "b"))
    assert read.selectExpr("bucket", "length").distinct().count() == read.select("bucket").distinct().count()


def spans_by_pattern(text: str) -> list[str]:
    keys = "password passwd secret token api_?key".split()
    either = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in keys)
    assign = rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_base_spans_and_random_strings(spark):
    found = secret_scan.scan(docs(spark), RANKS, PATTERN).collect()
    by_id = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in found}
    for name, text, *_ in rows():
        base = [s for s in by_id[name] if not s.startswith("random")]
        assert base == spans_by_pattern(text or "")
    text = TEXTS[18]
    assert by_id[18] == [f"random:3:{text.index(' and')}"]  # not the UUID, not the identifier
    assert secret_scan.scan(no_docs(spark), RANKS, PATTERN).count() == 0


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "letters": UPPER + LOWER, "upper": UPPER, "lower": LOWER, "base32": UPPER + "234567",
    "lower and digits": LOWER + DIGITS, "upper and digits": UPPER + DIGITS,
    "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/",
}


def is_random(run: str) -> bool:
    encode = secret_scan.encoder(RANKS, PATTERN).encode_ordinary
    spans = secret_scan.byte_spans(run.encode(), encode)
    return any(secret_scan.KINDS[kind] == "random" for _, kind, _ in spans)


@pytest.mark.parametrize("alphabet", sorted(ALPHABETS))
@pytest.mark.parametrize("length", [16, 20, 32, 40])
def test_random_strings_of_every_alphabet_are_found(alphabet, length):
    rng = np.random.default_rng(length)
    made = ["".join(rng.choice(list(ALPHABETS[alphabet]), length)) for _ in range(300)]
    assert sum(map(is_random, made)) >= (0.8 if length < 32 else 0.93) * len(made)


def test_words_identifiers_and_known_forms_are_no_random_strings():
    known = (
        "some_long_identifier_name_42 getUserNameFromCache HttpServletRequestWrapper internationalization"
        " donaudampfschifffahrtsgesellschaft CONSTITUTIONALISATION MAX_CONNECTION_COUNT_8 order-20240115-abc123"
        " src/main/java/org/apache xxxxxxxxxxxxxxxxxxxx 2024-01-15T10-20-30 4111-1111-1111-1111 4952935900253052"
        " 0b5e0f5c-1c5e-4b0a-9d7b-2f6c1e8a9b10 9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    )
    assert [w for w in known.split() if is_random(w)] == []


def test_redaction_replaces_spans_only(spark):
    frame = docs(spark)
    done = secret_scan.redact(frame, RANKS, PATTERN)
    assert done.schema == frame.schema
    texts = {r.doc_id: r.text for r in done.collect()}
    assert texts[16] == '[secret]" and [secret] [secret]'
    assert all(texts[r[0]] == r[1] for r in rows() if not (by := spans_by_pattern(r[1] or "")) and r[0] != 18), by


def brute_measures(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    places = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(places)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab \n#é ")), max_size=80))
def test_measures(text):
    assert host_rules.measure(text.encode()) == brute_measures(text)


def test_documents_are_judged(spark):
    judged = host_rules.judge(docs(spark)).collect()
    assert Counter((r.doc_id, *(r[m] for m in host_rules.MEASURES)) for r in judged) == Counter(
        (r[0], *brute_measures(r[1])) for r in rows()
    )
    for r in judged:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and (not failed or not r.kept)
    assert host_rules.judge(no_docs(spark)).count() == 0


def test_a_bad_host_is_rejected_and_a_small_one_is_not(spark):
    good, bad = prose(4, 60), "same words again and " * 30
    texts = [(good, "good")] * 200 + [(bad, "bad")] * 200 + [(good, "bad"), (bad, "few"), (good, "few")]
    frame = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(texts)], "doc_id int, text string, source string")
    kept = {r.doc_id: r.kept for r in host_rules.judge(frame).collect()}
    assert all(kept[i] for i in range(200))
    assert not kept[400] and not kept[401] and kept[402]


SAMPLES = {
    "en": "the house was on the hill and the road went through the wood to the town where they lived",
    "de": "das haus stand auf dem berg und die strasse ging durch den wald in die stadt wo sie wohnten",
}


def labelled(spark, n=60):
    found = []
    for i in range(n):
        lang = ["en", "de"][i % 2]
        words = SAMPLES[lang].split()
        text = " ".join(words[(i * 7 + j * 5) % len(words)] for j in range(30))
        found.append((i, text, lang, f"{lang}.example"))
    return spark.createDataFrame(found, "doc_id bigint, text string, lang string, source string")


def test_languages_held_out_and_odd_rows(spark):
    frame = labelled(spark)
    import pyspark.sql.functions as F

    model = language.fit(frame.filter("doc_id < 40").withColumn("label", F.col("lang")))
    assert model.languages == ("de", "en", "und")
    held = language.identify(frame.filter("doc_id >= 40").drop("lang"), model, host=F.col("source"))
    wanted = {r.doc_id: r.lang for r in frame.collect()}
    assert all(r.lang == wanted[r.doc_id] and r.kept for r in held.collect())

    odd = language.identify(docs(spark), model, declared=F.col("lang"), host=F.col("source"))
    result = odd.collect()
    assert Counter(r.doc_id for r in result) == Counter(r[0] for r in rows())
    by_id = {r.doc_id: r for r in result}
    assert by_id[0].lang == by_id[1].lang == "und" and not by_id[0].kept
    assert language.identify(no_docs(spark), model, host=F.col("source")).count() == 0
    nothing = language.fit(no_docs(spark).withColumn("label", F.col("lang")))
    assert nothing.languages == ("und",)
    assert {r.kept for r in language.identify(docs(spark), nothing).collect()} == {False}


def test_every_label_is_in_the_model_however_rare(spark):
    import pyspark.sql.functions as F

    texts = [(SAMPLES["en"], "en")] * 3000 + [(SAMPLES["de"], "de")] * 3 + [(SAMPLES["en"], None)] * 3000
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id bigint, text string, label string")
    same = spark.createDataFrame([(None, "uno dos tres cuatro", "es")] * 2000, frame.schema)
    model = language.fit(frame.unionByName(same), sample_rows=10)
    assert model.languages == ("de", "en", "es", "und")
    found = language.identify(frame, model).filter(F.col("doc_id").between(3000, 3002)).collect()
    assert {(r.lang, r.kept) for r in found} == {("de", True)}


def test_evidence_beyond_the_text_decides_short_texts(spark):
    import pyspark.sql.functions as F

    frame = labelled(spark)
    model = language.fit(frame.withColumn("label", F.col("lang")))
    short = spark.createDataFrame([(100, "ho", None, "en.example"), (101, "ix", "de-AT", "de.example")], frame.schema)
    found = language.identify(frame.unionByName(short), model, declared=F.col("lang"), host=F.col("source"))
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[101].lang == "de" and by_id[100].lang == "en" and by_id[100].kept




def test_workers_keep_one_thing_and_give_it_back():
    """What one stage has loaded is not held beside what the next one loads."""
    made = []
    load = lambda name: common.kept(name, lambda: made.append(name) or [name])
    assert load("a") is load("a") and made == ["a"]
    assert load("b") == ["b"] and load("a") == ["a"] and made == ["a", "b", "a"]
    common.release()
    assert load("a") == ["a"] and made == ["a", "b", "a", "a"]
    common.release()
