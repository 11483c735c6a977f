"""Language identification by nearest centroid.

A text is the TF-IDF vector of its hashed byte trigrams, normalised to length one. Each
language is described by several centroids, found by spherical k-means over a bounded sample
of its labelled rows. A text gets the language of the nearest centroid by cosine. It is
rejected as of no known language if it is farther from it than nearly all of that language's
own sample rows were.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import pieces, slices

#: Rows of each language that the classifier is fitted on, at most; chosen by a hash of doc_id and text.
SAMPLE_ROWS = 600
#: Rows of all languages together, at most; with many languages each has fewer, but LEAST_ROWS.
ALL_SAMPLE_ROWS = 10_000
LEAST_ROWS = 30
CENTROIDS = 4
#: Hash buckets of trigrams.
DIMENSIONS = 4096
ITERATIONS = 8
#: A text is rejected if its cosine is under this share of the lowest hundredth of its language's own sample.
REJECT_SHARE = 0.4
#: A text of fewer different trigrams can't come as near; its bound falls as their square root.
FULL_TRIGRAMS = 200
UNKNOWN = "und"

_RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
_LETTER = regex.compile(r"\p{L}")


def _buckets(text: str) -> np.ndarray:
    """The bucket of each trigram of the lower-cased bytes; a run of ASCII characters other than letters is one blank."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    raw = np.where(letter, raw, 32)[letter | np.concatenate([[True], letter[:-1]])].astype(np.uint32)
    mixed = (raw[:-2] * np.uint32(65536) + raw[1:-1] * np.uint32(256) + raw[2:]) * np.uint32(2654435761)
    return mixed >> np.uint32(20)


def term_counts(text: str) -> np.ndarray:
    return np.bincount(_buckets(text), minlength=DIMENSIONS).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # of each centroid, the index of its language
    least: np.ndarray  # of each language, the cosine under which a text is rejected

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: index of the language, cosine, rejected."""
        cosine = _unit(np.log1p(counts) * self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        reach = np.sqrt(np.minimum(1, (counts > 0).sum(axis=1) / FULL_TRIGRAMS))
        return self.owner[best], score, score < self.least[self.owner[best]] * reach


def _cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from the rows least like those already taken."""
    taken = [rows.mean(axis=0)]
    for _ in range(min(k, len(rows)) - 1):
        taken.append(rows[(rows @ _unit(np.stack(taken)).T).max(axis=1).argmin()])
    centroids = _unit(np.stack(taken))
    for _ in range(ITERATIONS):
        of = (rows @ centroids.T).argmax(axis=1)
        centroids = _unit(np.stack([rows[of == c].sum(axis=0) if (of == c).any() else centroids[c] for c in range(len(centroids))]))
    return centroids


def fit_model(labels: list[str], counts: np.ndarray) -> Model:
    languages = sorted(set(labels))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    rows, of = np.log1p(counts), np.array([languages.index(x) for x in labels], dtype=int)
    rows *= idf  # in place, for a sample of many languages is large
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    groups = [_cluster(rows[of == i], CENTROIDS) for i in range(len(languages))]
    least = [REJECT_SHARE * np.quantile((rows[of == i] @ g.T).max(axis=1), 0.01) for i, g in enumerate(groups)]
    owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    centroids = np.concatenate(groups) if groups else np.zeros((0, DIMENSIONS))
    return Model(languages, idf, centroids.astype(np.float32), owner, np.array(least))


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of the Unicode version that Python knows; the one judge of letters here."""
    return any(unicodedata.category(m.group()).startswith("L") for m in _LETTER.finditer(text or ""))


def _letters(texts: pa.Array) -> pa.Array:
    return pa.array([has_letter(t) for part in slices(texts) for t in part.to_pylist()], pa.bool_())


def held_out(column):
    """crc32 of the decimal doc_id leaves 2 when divided by 4. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = [np.unique(_buckets(t), return_counts=True) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())),
                pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())),
            ],
            names=["lang", "mark", "buckets", "counts"],
        )


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the rows of docs whose lang isn't null, whose text has a letter and that aren't held out.

    About 1.3 times sample_rows different rows of every language reach the driver, as sparse
    counts, and sample_rows are used; a hash of doc_id and text chooses them. Repeated rows count
    once. Without labelled rows the model knows no language.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = labelled.filter(F.arrow_udf(_letters, "boolean")("text"))
    labelled = labelled.withColumn("mark", F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1_000_000_000)))
    # repeated rows count once; a language of few different rows has them all
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("mark").alias("count")).orderBy("lang").collect()
    if not sizes:
        return fit_model([], np.zeros((0, DIMENSIONS), np.float32))
    sample_rows = max(1, min(sample_rows, max(LEAST_ROWS, ALL_SAMPLE_ROWS // len(sizes))))
    # a third more than wanted, by a bound on the hash, so that nearly always enough rows are left
    bounds = {r["lang"]: min(1_000_000_000, max(1, int(1_300_000_000 * sample_rows / r["count"]))) for r in sizes}
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col("lang"))
    chosen = labelled.filter(F.col("mark") < bound).select("lang", "text", "mark").dropDuplicates(["lang", "mark"])
    picked = chosen.mapInArrow(_sample_counts, "lang string, mark long, buckets array<int>, counts array<int>").collect()
    taken: dict[str, int] = dict.fromkeys(bounds, 0)
    labels, rows = [], np.zeros((sample_rows * len(bounds), DIMENSIONS), np.float32)
    for r in sorted(picked, key=lambda r: (r["lang"], r["mark"], r["buckets"])):
        if taken[r["lang"]] < sample_rows:
            taken[r["lang"]] += 1
            rows[len(labels), np.array(r["buckets"], int)] = r["counts"]
            labels.append(r["lang"])
    return fit_model(labels, rows[: len(labels)])


def _judged(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether rejected, of each text."""
    lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    known = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    for at in range(0, len(known), 256):
        part = known[at : at + 256]
        of, near, out = model.predict(np.stack([term_counts(texts[i]) for i in part]))
        score[part], rejected[part] = near, out
        for i, k in zip(part, of, strict=True):
            lang[i] = model.languages[k]
    return lang, score, rejected


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs (doc_id, text, any others).

    A text that is null or has no letter is 'und' with score 0 and rejected; so is every text
    if the model knows no language. A text far from every centroid keeps the nearest language
    in lang_pred but is rejected. Null and repeated doc_ids and repeated rows are judged row by row;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches):
            lang, score, rejected = _judged(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, _RESULT)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from docs (doc_id, text, lang, any others) and predict every row of it; see fit and predict."""
    return predict(docs, fit(docs, sample_rows))


def keep_known(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs (doc_id, text, lang, any others) without the rows that are rejected.

    Rows are judged where they stand, without a shuffle, by their text alone: null and repeated
    doc_ids and repeated rows are carried along. Null texts and texts without a letter go; without
    labelled rows all go; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_rows))

    def known(texts: pa.Array) -> pa.Array:
        return pa.array([not x for part in slices(texts) for x in _judged(part.to_pylist(), shared.value)[2]], pa.bool_())

    return docs.filter(F.arrow_udf(known, "boolean")(F.col("text").cast("string")))
