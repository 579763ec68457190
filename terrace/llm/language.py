"""Language identification by fusing evidence with Bayes' rule.

Four kinds of evidence meet in one posterior per document:

* the text: byte-trigram likelihoods of each language, fitted on a bounded sample of the rows of
  each label, so that every label with a text is a language of the model; the whole text counts, as the mean over its trigrams times at most ``EVIDENCE``
  trigrams, since neighbours in a text are not independent;
* the declared markup language, trusted as far as it agrees with the texts: a table of
  declared by likely language is summed over all documents;
* the address suffix and the host: priors summed over all documents, smoothed in levels, the
  host's towards its suffix's, that towards all documents'.

``und`` stands for no known language: every trigram equally likely. A document is kept unless
``und`` has most of the posterior or there is nothing but white space; a text too short for a
trigram is judged by the other evidence.

Documents are scored once and the scores staged; sums are made in the map tasks first; host
priors are joined back with salt, so that a host with a third of all documents is spread.
NULL, empty and blank texts are ``und`` and rejected; a NULL host, suffix or declaration is ''; repeated
rows count as often as they come; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Batches, batch, put, release, slices

SAMPLE_ROWS = 4000  # rows of each label that the text model is fitted on, about
FITTING_TASKS = 4
CELLS = 1 << 16
EVIDENCE = 60.0
UNKNOWN = "und"
UNKNOWN_SHARE = 1e-3
SMOOTHING = 0.5
HOST_WEIGHT = 20.0  # documents that a parent's prior counts as
DECLARED_WEIGHT = 1.0
SALTS = 16
BYTES_AT_ONCE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]  # the last is UNKNOWN
    scores: np.ndarray  # language by cell: log probability


def cells_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigram cell at every byte of the texts, and where each text begins and ends."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    low = _LOWER[data]
    if len(low) < 3:
        return np.zeros(0, np.uint16), offsets - offsets[0]
    mixed = low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA6B)
    mixed = (mixed ^ low[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(16)).astype(np.uint16), offsets - offsets[0]


def spans_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts have trigrams, and where these begin and end."""
    having = np.flatnonzero(np.diff(offsets) >= 3)
    return having, offsets[having], offsets[having + 1] - 2


def sums_of(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values[begin:end], span by span; the spans do not overlap."""
    if not len(begin):
        return np.zeros(0)
    edges = np.ravel(np.column_stack([begin, end]))
    padded = np.append(values, 0)
    return np.add.reduceat(padded, edges, dtype=np.float64)[::2]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Trigram probabilities of each label from about ``sample_rows`` of its rows.

    A label's rows with a text of a trigram are counted, and rows are chosen by a hash of id and
    text: all of a label with up to ``sample_rows``, and always the row with its least hash. Each of
    a few tasks returns the cells it has seen of each label.
    """
    rows = labelled.select(
        F.col("text"),
        F.col("label"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("place"),
    ).filter("label is not null and label != '' and octet_length(text) >= 3")
    share = F.lit(float(sample_rows)) / F.col("n")
    limits = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    limits = limits.select("label", F.greatest("least", share * float(1 << 40)).alias("limit"))
    chosen = rows.join(F.broadcast(limits), "label").filter("place <= limit")

    def run(batches: Batches) -> Batches:
        release()
        counts: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                cells, offsets = cells_of(b["text"])
                labels = b["label"].to_pylist()
                for i, begin, end in zip(*spans_of(offsets)):
                    own = counts.setdefault(labels[i], np.zeros(CELLS, np.int64))
                    own += np.bincount(cells[begin:end], minlength=CELLS)
        for label, own in counts.items():
            seen = np.flatnonzero(own)
            sent = (pa.array([x.tobytes()], pa.binary()) for x in (seen, own[seen]))
            yield batch(label=[label], **dict(zip(("cells", "counts"), sent)))

    found: dict[str, np.ndarray] = {}
    spread = chosen.select("text", "label").repartition(FITTING_TASKS)
    for row in spread.mapInArrow(run, "label string, cells binary, counts binary").collect():
        own = found.setdefault(row["label"], np.zeros(CELLS, np.int64))
        own[np.frombuffer(row["cells"], np.int64)] += np.frombuffer(row["counts"], np.int64)
    languages = sorted(found)
    scores = [
        np.log((found[n] + SMOOTHING) / (found[n].sum() + SMOOTHING * CELLS)) for n in languages
    ]
    scores.append(np.full(CELLS, -np.log(CELLS)))
    return TextModel((*languages, UNKNOWN), np.array(scores, np.float32))


def score(rows: DataFrame, model: TextModel) -> DataFrame:
    """Replace ``text`` by ``n_grams`` and ``evidence``: a log-likelihood for each language."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Batches) -> Batches:
        release()
        scores = held.value.scores
        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                cells, offsets = cells_of(b["text"])
                having, begin, end = spans_of(offsets)
                n = np.zeros(b.num_rows, np.int64)
                n[having] = end - begin
                evidence = np.zeros((b.num_rows, len(scores)))
                for k, own in enumerate(scores):
                    evidence[having, k] = sums_of(own[cells], begin, end)
                evidence *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                values = pa.array(evidence.ravel())
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(scores)), values
                )
                yield batch(**{c: b[c] for c in others}, n_grams=n, evidence=lists)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, n_grams bigint, evidence array<double>")


def normalised(logs: Column) -> Column:
    """Logarithms of weights to shares."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _totals(df: DataFrame, keys: list[str], shares: str, width: int) -> DataFrame:
    """Sums of the shares, place by place."""
    sums = [F.sum(F.get(shares, F.lit(i))).alias(f"s{i}") for i in range(width)]
    array = F.array(*[F.col(f"s{i}") for i in range(width)])
    return df.groupBy(*keys).agg(*sums).select(*keys, array.alias("total"))


def _smoothed(own: Column, parent: Column, weight: float) -> Column:
    """(own + weight * parent) / (sum of own + weight)"""
    size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + weight
    return F.zip_with(own, parent, lambda x, p: (x + weight * p) / size)


def identify(
    docs: DataFrame,
    model: TextModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
) -> DataFrame:
    """doc_id, lang, probability (of lang), text_lang (by the text alone), n_grams, kept."""
    text_of = lambda c: F.lit("") if c is None else F.coalesce(F.lower(c.cast("string")), F.lit(""))
    width, names = len(model.languages), model.languages
    tag = F.regexp_extract(text_of(declared), "^[a-z]*", 0)  # de-AT and DE are de
    tag = F.when(tag.isin(*names), tag).when(tag == "", "").otherwise("other")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        tag.alias("declared"),
        text_of(host).alias("host"),
        text_of(suffix).alias("suffix"),
        F.coalesce(F.col(text_col).rlike(r"\S"), F.lit(False)).alias("has_text"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    base = [np.log((1 - UNKNOWN_SHARE) / max(1, width - 1))] * (width - 1) + [np.log(UNKNOWN_SHARE)]
    base = F.array(*[F.lit(float(x)) for x in base])
    scored = put(score(rows, model).withColumn("shares", normalised(plus(F.col("evidence"), base))))
    heard = scored.filter("has_text and n_grams > 0")

    # All levels from one grouping: its rows are at most declarations times hosts.
    cells = put(_totals(heard, ["suffix", "host", "declared"], "shares", width))
    everywhere = _totals(cells, [], "total", width).collect()
    overall = np.array((everywhere[0]["total"] if everywhere else None) or [0.0] * width, float)
    overall = np.array([x or 0.0 for x in overall])
    start = np.full(width, (1 - UNKNOWN_SHARE) / max(1, width - 1))
    start[-1] = UNKNOWN_SHARE
    overall = (overall + HOST_WEIGHT * start) / (overall.sum() + HOST_WEIGHT)
    overall_prior = F.array(*[F.lit(float(x)) for x in overall])

    suffixes = _totals(cells, ["suffix"], "total", width)
    suffixes = suffixes.select(
        "suffix", _smoothed(F.col("total"), overall_prior, HOST_WEIGHT).alias("suffix_prior")
    )
    hosts = _totals(cells, ["suffix", "host"], "total", width).join(suffixes, "suffix")
    hosts = put(
        hosts.select(
            "suffix",
            "host",
            _smoothed(F.col("total"), F.col("suffix_prior"), HOST_WEIGHT).alias("prior"),
        )
    )

    # How often each language is declared as what: at most as many rows as languages and two.
    tables = {r["declared"]: r["total"] for r in _totals(cells, ["declared"], "total", width).collect()}
    by_language = sum((np.array(t, float) for t in tables.values()), np.zeros(width))
    likelihood = {}
    for name, total in tables.items():
        agree = np.array([1.0 if n == name else 1.0 / (width + 1) for n in names])
        likelihood[name] = np.log(
            (np.array(total, float) + DECLARED_WEIGHT * agree) / (by_language + 2 * DECLARED_WEIGHT)
        )
    said = F.array(*[F.lit(0.0)] * width)
    for name, logs in likelihood.items():
        if name:  # no declaration is no evidence
            said = F.when(F.col("declared") == name, F.array(*[F.lit(float(x)) for x in logs])).otherwise(said)

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    priors = hosts.withColumn("salt", salts)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    joined = scored.withColumn("salt", salt).join(priors, ["suffix", "host", "salt"], "left")
    prior = F.transform(F.coalesce("prior", overall_prior), lambda p: F.log(p))
    posterior = normalised(plus(plus(F.col("evidence"), prior), said))
    best = joined.select("doc_id", "n_grams", "has_text", "shares", posterior.alias("posterior"))
    labels = F.array(*[F.lit(n) for n in names])

    def named(shares: str) -> Column:
        place = F.array_position(shares, F.array_max(shares)).cast("int") - 1
        return F.when(F.col("has_text"), F.get(labels, place)).otherwise(UNKNOWN)

    lang = named("posterior")
    found = best.select(
        "doc_id",
        lang.alias("lang"),
        F.array_max("posterior").alias("probability"),
        named("shares").alias("text_lang"),
        "n_grams",
    )
    return found.withColumn("kept", F.col("lang") != UNKNOWN)
