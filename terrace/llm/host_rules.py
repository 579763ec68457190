"""Quality rules by document and by host.

Each document is measured once, whole; the measures, a few numbers a document, are staged.
Failures of each rule are summed by host. A host's failure rate is shrunk towards that of
all hosts by a beta prior whose mean and strength come from the hosts themselves (method of
moments), so that a host with few documents is not judged by them alone. A host is
rejected when the rate of a rule is above ``HOST_LIMIT`` by ``CERTAINTY`` posterior standard
deviations: most of its documents fail, beyond doubt. Verdicts are joined back to documents.

Hosts are summed in the map tasks first; the join back is salted, so that a host with a
third of all documents is spread. NULL and empty texts have no words and fail; a NULL host
counts as the host ''; repeated rows count as often as they come; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Batches, as_bytes, batch, mapped, put, release, slices

MIN_WORDS = 10
REPEATED_SHARE = 20  # per cent of the words
DUPLICATE_LINE_SHARE = 50  # per cent of the words' number, in lines
SYMBOL_SHARE = 200  # symbols per 100 words
WINDOW = 5
HOST_LIMIT = 0.5
CERTAINTY = 3.0
SALTS = 16
BYTES_AT_ONCE = 1 << 20
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
_NOT_COUNTED = SPACE + bytes(range(0x80, 0xC0))  # white space, and bytes inside a code point

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five words that are found twice or more in the text."""
    if len(words) <= WINDOW:
        return 0
    counts = Counter(words)
    # Only windows of words that all repeat can repeat; most texts have few of these.
    often = bytes([counts[w] > 1 for w in words])
    run = b"\x01" * WINDOW
    starts = []
    at = often.find(run)
    while at >= 0:
        starts.append(at)
        at = often.find(run, at + 1)
    if len(starts) < 2:
        return 0
    number = {w: i for i, w in enumerate(counts)}
    ids = [number[w] for w in words]
    windows = [tuple(ids[s : s + WINDOW]) for s in starts]
    found = Counter(windows)
    total, until = 0, 0
    for start, window in zip(starts, windows):
        if found[window] > 1:
            total += start + WINDOW - max(start, until)
            until = start + WINDOW
    return total


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        duplicate_lines(text),
        repeated_words(words),
    )


def measured(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host and the measures of every text."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Batches) -> Batches:
        release()
        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                found = zip(*map(measure, b["text"].to_pylist()))
                columns = {n: pa.array(c, pa.int64()) for n, c in zip(MEASURES, found)}
                yield batch(doc_id=b["doc_id"], host=b["host"], **columns)

    schema = "doc_id bigint, host string, " + ", ".join(f"{n} bigint" for n in MEASURES)
    return mapped(as_bytes(rows), run, schema)


def rule_failures() -> dict:
    """Rule name to whether a measured document fails it."""
    words = F.col("n_words")
    return {
        "short": words < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEATED_SHARE * words,
        "lines": 100 * F.col("n_dup_lines") > DUPLICATE_LINE_SHARE * words,
        "symbols": 100 * F.col("n_symbols") > SYMBOL_SHARE * words,
    }


def base_failed():
    rules = rule_failures()
    return rules["short"] | rules["repeats"]


def host_rates(measures: DataFrame) -> DataFrame:
    """host, rule, documents, failures, shrunk rate, its deviation, and whether rejected."""
    rules = rule_failures()
    sums = measures.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(failed.cast("bigint")).alias(name) for name, failed in rules.items()],
    )
    names = ", ".join(f"'{r}', {r}" for r in rules)
    by_rule = sums.selectExpr("host", "n", f"stack({len(rules)}, {names}) as (rule, failures)")
    by_rule = put(by_rule)

    # Mean and spread of the rates over hosts, each host weighing as its documents.
    moments = by_rule.groupBy("rule").agg(
        F.sum("n").alias("docs"),
        F.count(F.lit(1)).alias("hosts"),
        (F.sum("failures") / F.sum("n")).alias("mean"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("squares"),
        F.sum(F.col("n") * F.col("n")).alias("sizes"),
    )
    mean, docs, hosts = F.col("mean"), F.col("docs"), F.col("hosts")
    between = F.col("squares") - docs * mean * mean - (hosts - 1) * mean * (1 - mean)
    scale = docs - F.col("sizes") / docs - (hosts - 1)
    variance = F.greatest(between / F.greatest(scale, F.lit(1.0)), F.lit(1e-6))
    strength = F.greatest(mean * (1 - mean) / variance - 1, F.lit(1.0))
    prior = moments.select("rule", mean.alias("mean"), strength.alias("strength"))

    n, failures = F.col("n"), F.col("failures")
    rate = (failures + F.col("mean") * F.col("strength")) / (n + F.col("strength"))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (n + F.col("strength") + 1))
    shrunk = by_rule.join(prior, "rule").withColumn("rate", rate)
    shrunk = shrunk.withColumn("deviation", deviation)
    rejected = F.col("rate") - CERTAINTY * F.col("deviation") > HOST_LIMIT
    return shrunk.select("host", "rule", "n", "failures", "rate", "deviation", rejected.alias("rejected"))


def judge(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host, the measures, base_failed and kept."""
    measures = put(measured(docs, host_col))
    rejected = host_rates(measures).filter("rejected").select("host").distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rejected = put(rejected).select("host", salts.alias("salt"), F.lit(True).alias("bad_host"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    judged = measures.withColumn("salt", salt).join(rejected, ["host", "salt"], "left")
    failed = base_failed()
    kept = ~failed & F.col("bad_host").isNull()
    return judged.select("doc_id", "host", *MEASURES, failed.alias("base_failed"), kept.alias("kept"))
