"""Language identification as a mixture over languages.

Byte trigrams around the letters of a word are counted by language over labelled
documents; a word's likelihood in a language is the product over its trigrams.
A document's words are drawn from a mixture of languages whose proportions
expectation-maximisation estimates; of the nested sets of its likeliest
languages the one with the best likelihood less a penalty for each language
is kept.  The language with the largest proportion is the prediction, its
proportion the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import bounded_batches

from .textbytes import per_document, runs

UNKNOWN = "und"
#: Expected number of labelled documents of each language that a model is fitted on (whole texts); chosen by a hash of the id.
TRAIN_DOCS = 1_000
#: Trigrams share 2**BUCKET_BITS counters.
BUCKET_BITS = 17
SMOOTHING, PENALTY = 0.5, 2.0
#: Expectation-maximisation ends when no proportion of a document moves further, at the latest after EM_STEPS.
EM_STEPS, EM_TOLERANCE = 1_000, 1e-4
#: Logarithms of likelihoods that are looked up at once.
LOOKED_UP = 1 << 22
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


@dataclass(frozen=True)
class LanguageModel:
    """``log_likelihood[bucket, language]`` of a trigram; ``background`` is that of one drawn evenly from all learned ones."""

    languages: tuple[str, ...]
    log_likelihood: np.ndarray
    background: float = 0.0


def trigram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter byte, first letter of each word among them, words before each document).

    What is no letter counts as a space; words end with their document."""
    letter = LETTER[data]
    code = np.where(letter, data, 0x20).astype(np.uint32)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    previous = np.where(edge[:-1], 0x20, np.concatenate(([0x20], code[:-1]))).astype(np.uint32)
    following = np.where(edge[1:], 0x20, np.concatenate((code[1:], [0x20]))).astype(np.uint32)
    at = np.flatnonzero(letter)
    key = (previous[at] << 16) | (code[at] << 8) | following[at]
    bucket = (key * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    starts = np.flatnonzero(previous[at] == 0x20)
    return bucket, starts, np.searchsorted(at[starts], offsets)


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.string()) if pa.types.is_large_string(column.type) else column)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Counts trigrams by language over labelled rows (non-null text and language).

    About ``train_docs`` whole documents of each language are read, those with
    the smallest hashes of their ids; fewer labelled rows are all read.  Rows without an
    id share a hash; rows that repeat an id are read together.  Every label is learned, a
    blank one as well.  What reaches the driver is a count for each language and bucket that
    occurs; the model takes half a megabyte a language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = labelled.groupBy("lang").count().toArrow().sort_by("lang")
    languages = tuple(sizes["lang"].to_pylist())
    if not languages:
        return LanguageModel((), np.zeros((1 << BUCKET_BITS, 0), np.float32))
    n = len(languages)
    drawn = pa.table({"lang": sizes["lang"], "own": pa.array(range(n), pa.int32()), "share": pa.array(train_docs / sizes["count"].to_numpy())})
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(spark.createDataFrame(drawn)), "lang").filter(draw < F.col("share")).select("own", "text")  # a row a language

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        slots, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return slots, np.bincount(back, np.concatenate([p[1] for p in parts]), len(slots)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64)
            for first, end, data, offs in runs(_lower(batch.column(1))):
                bucket, starts, words = trigram_buckets(data, offs)
                letters = np.append(starts, len(bucket))[words]
                parts.append(np.unique((np.repeat(own[first:end], np.diff(letters)) << BUCKET_BITS) + bucket, return_counts=True))
                if sum(len(p[0]) for p in parts[1:]) > 1 << 22:
                    parts = [merged(parts)]
        slots, counts = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts)], names=["slot", "n"])

    rows = sample.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((n, 1 << BUCKET_BITS), np.float32)
    counts.ravel()[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    total = counts.sum(axis=1, keepdims=True, dtype=np.float64)
    used = max(1, int((counts > 0).any(axis=0).sum()))
    return LanguageModel(languages, np.log((counts + SMOOTHING) / (total + SMOOTHING * used)).T.astype(np.float32).copy(), -float(np.log(used)))


def word_scores(model: LanguageModel, bucket: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word of each word, log-likelihood of each distinct word in each language); words are runs of buckets from ``starts``."""
    size = np.diff(np.append(starts, len(bucket)))
    place = np.arange(len(bucket)) - np.repeat(starts, size)
    power = np.full(int(size.max()), WORD_BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    letter = (bucket.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    names = np.add.reduceat((letter ^ (letter >> np.uint64(29))) * power[place], starts)
    _, first, own = np.unique(names, return_index=True, return_inverse=True)
    size, n = size[first], len(model.languages)
    word = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(word)) + np.repeat(starts[first] - (np.cumsum(size) - size), size)
    score, step = np.zeros((len(first), n)), max(1, LOOKED_UP // n)
    for a in range(0, len(word), step):
        w = word[a : a + step]
        cut = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        score[w[cut]] += np.add.reduceat(model.log_likelihood[bucket[at[a : a + step]]], cut, axis=0)
    return own, score


def mixtures(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Proportions of the model's languages in each document; zero rows where no letter is."""
    return judged(model, data, offsets)[0]


def judged(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions as in :func:`mixtures`, evidence) of each document.

    Evidence is how much likelier its mixture makes a trigram than the background
    does, as a mean logarithm over the document's trigrams: below 0, letters drawn without a language explain it better."""
    docs, n = len(offsets) - 1, len(model.languages)
    out, evidence = np.zeros((docs, n)), np.zeros(docs)
    if not n or not len(data):
        return out, evidence
    bucket, starts, bounds = trigram_buckets(data, offsets)
    if not len(starts):
        return out, evidence
    own, score = word_scores(model, bucket, starts)
    words = np.maximum(np.diff(bounds), 1)
    # a word that a document repeats is one row with its count
    pairs, weight = np.unique(np.repeat(np.arange(docs), np.diff(bounds)) * len(score) + own, return_counts=True)
    doc, score = pairs // len(score), score[pairs % len(score)]
    most = score.max(axis=1, keepdims=True)
    like = np.exp(score - most) + 1e-12
    rows = np.searchsorted(doc, np.arange(docs + 1))

    def some(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of these documents, where each one's begin among them)"""
        size = np.diff(rows)[which]
        begin = np.concatenate(([0], np.cumsum(size)))
        return np.arange(begin[-1]) + np.repeat(rows[which] - begin[:-1], size), begin

    def em(which: np.ndarray, proportion: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log-likelihood) of documents, from their starting proportions."""
        proportion = proportion.copy()
        live, (at, begin) = np.arange(len(which)), some(which)
        part, count = like[at], weight[at]
        for _ in range(EM_STEPS):
            joint = part * np.repeat(proportion[live], np.diff(begin), axis=0)
            joint *= (count / joint.sum(axis=1))[:, None]
            new = per_document(joint, begin) / words[which[live], None]
            moved = np.abs(new - proportion[live]).max(axis=1) >= EM_TOLERANCE
            proportion[live] = new
            if not moved.any():
                break
            if moved.mean() < 0.8:
                live = live[moved]
                at, begin = some(which[live])
                part, count = like[at], weight[at]
        at, begin = some(which)
        fit = np.log((like[at] * np.repeat(proportion, np.diff(begin), axis=0)).sum(axis=1)) * weight[at]
        return proportion, per_document(fit, begin)

    open_ = np.flatnonzero(np.diff(bounds))
    full, _ = em(open_, np.full((len(open_), n), 1.0 / n))
    rank = np.zeros((docs, n), np.int64)
    rank[open_] = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best = np.full(docs, -np.inf)
    for k in range(1, n + 1):  # one more language as long as that pays
        proportion, value = em(open_, (rank[open_] < k) / k)
        value = value - PENALTY * (k - 1) * np.log(words[open_] + 1)
        better = value > best[open_]
        open_, proportion = open_[better], proportion[better]
        if not len(open_):
            break
        best[open_], out[open_] = value[better], proportion
    total = per_document((most[:, 0] + np.log(np.maximum((like * out[doc]).sum(axis=1), 1e-300))) * weight, rows)
    letters = np.diff(np.append(starts, len(bucket))[bounds])
    return out, np.divide(total, letters, out=evidence, where=letters > 0) - np.where(letters > 0, model.background, 0.0)


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", min_share: float = 0.01, prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``mixture`` (map of language to proportion) and ``evidence`` (see :func:`judged`).

    Whole texts are read.  Null text, text without a letter, and every text if the
    model knows no language: ``und``, score and evidence 0, empty map.  Ties go to the language
    that sorts first.  Repeated rows get equal results.  The names begin with
    ``prefix``; columns of these names in ``docs`` are replaced."""
    added = [f"{prefix}{c}" for c in ("lang_pred", "score", "mixture", "evidence")]
    bounded_batches(docs.sparkSession)
    keep = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    languages = np.array([*model.languages, UNKNOWN], dtype=object)
    position = keep.columns.index(text_col)
    schema = keep.select("*", F.lit("").alias(added[0]), F.lit(0.0).alias(added[1]), F.create_map(F.lit(""), F.lit(0.0)).alias(added[2]), F.lit(0.0).alias(added[3])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(position)
            model = shared.value
            parts = [judged(model, data, offs) for _, _, data, offs in runs(_lower(text), max(1 << 16, (4 << 20) // max(1, len(languages) - 1)))]
            share = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, len(model.languages)))
            evidence = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
            no_letter = np.array(pc.fill_null(pc.invert(pc.match_substring_regex(text, r"\pL")), True))
            top = share.argmax(axis=1) if share.shape[1] else np.zeros(len(share), int)
            score = share[np.arange(len(share)), top] if share.shape[1] else np.zeros(len(share))
            unknown = no_letter | (score <= 0)
            share[unknown] = 0
            row, col = np.nonzero(share >= min_share)
            counts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(share)))))
            mixture = pa.MapArray.from_arrays(pa.array(counts, pa.int32()), pa.array(languages[col], pa.string()), pa.array(share[row, col]))
            label = pa.array(languages[np.where(unknown, len(languages) - 1, top)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, label, pa.array(np.clip(np.where(unknown, 0.0, score), 0, 1)), mixture, pa.array(np.where(unknown, 0.0, evidence))], names=[*batch.schema.names, *added])

    return keep.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True where the CRC-32 of the id as text is divisible by five (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    out = predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.to_json("mixture").alias("mixture"))
