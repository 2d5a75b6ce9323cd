"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its words, its pieces of four bytes (so that languages and
spellings share some), both hashed into ``BINS`` bins, and how its words repeat
at short distances.  A term weighs the square root of its share of the text, by
its inverse document frequency among the labelled sample.  A truncated singular
value decomposition of the sample, less its mean, gives the latent directions,
and a text's vector is its projection on them.  The labelled vectors are broadcast (``SAMPLE``
rows a label at most, a fixed size); every document's cosines with all of them
are computed in blocks, exactly, and the ``NEIGHBOURS`` nearest vote with their
similarity as weight.

The model is fitted on a bounded sample of labelled rows: of each label the
``SAMPLE`` ids of smallest hash, one row an id.  Scoring covers every document
and its whole text, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .hashing import U64, loads, mix64, slices, text_buffer, word_hashes

SAMPLE, NEIGHBOURS, DIMENSIONS = 1500, 15, 48
#: Bins of hashed words and of hashed pieces, and bytes of a piece.
BINS, PIECE = 2048, 4
#: Distances at which a word may repeat.
NEAR = (1, 2, 3)
#: Kinds of terms: words, pieces, repeats (and words that don't repeat).
KINDS = (BINS, BINS, len(NEAR) + 1)
TERMS = sum(KINDS)
#: Bytes of text, and texts, whose terms are counted together.
STEP_BYTES, STEP_ROWS = 1 << 20, 500


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each term occurs in each text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, TERMS), np.float32)
    own, first = word_hashes(data, offsets, 21)
    doc = np.repeat(np.arange(rows), np.diff(first))
    bins = lambda values, of: np.bincount(of * BINS + (mix64(values) & U64(BINS - 1)).astype(np.int64), minlength=rows * BINS).reshape(rows, BINS)
    out[:, :BINS] = bins(own, doc)
    nearest = np.full(len(own), len(NEAR))
    for i, far in reversed(list(enumerate(NEAR))):
        nearest[far:][(own[far:] == own[:-far]) & (doc[far:] == doc[:-far])] = i
    out[:, 2 * BINS :] = np.bincount(doc * KINDS[2] + nearest, minlength=rows * KINDS[2]).reshape(rows, -1)
    for a in range(0, len(data), STEP_BYTES):  # a long text in steps
        part = np.concatenate([data[a : a + STEP_BYTES + PIECE - 1], np.zeros(8 - PIECE, np.uint8)])
        pieces = loads(part) & U64((1 << 8 * PIECE) - 1)
        at = np.arange(a, a + len(pieces))
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + PIECE <= offsets[text + 1]
        low = int(text[0]) if len(text) else 0
        rest = text[inside] - low
        some = int(rest.max()) + 1 if len(rest) else 0
        if some:
            code = rest * BINS + (mix64(pieces[inside]) & U64(BINS - 1)).astype(np.int64)
            out[low : low + some, BINS : 2 * BINS] += np.bincount(code, minlength=some * BINS).reshape(some, BINS)
    return out


def shares(terms: np.ndarray) -> np.ndarray:
    """The square root of each count's share of its kind, in place."""
    at = 0
    for size in KINDS:
        block = terms[:, at : at + size]
        block /= np.maximum(block.sum(axis=1, keepdims=True), 1)
        np.sqrt(block, out=block)
        at += size
    return terms


@dataclass
class Model:
    """What is broadcast; ``prior`` is the score of a text without terms."""

    weight: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, terms: np.ndarray) -> np.ndarray:
        return _unit((weighted(terms, self.weight) - self.mean) @ self.axes)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """The neighbours' vote for each row of ``shares``."""
        empty = ~terms.any(axis=1)
        if not len(self.labels):
            return np.full(len(terms), self.prior)
        cosines = self.project(terms) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, best, axis=1), 1e-6).astype(np.float64)
        score = (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)
        return np.where(empty, self.prior, np.clip(score, 0.0, 1.0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Shares by the terms' weights: words and pieces a unit vector each, repeats as long as both."""
    out = terms * weight
    for a in (0, BINS):
        block = out[:, a : a + BINS]
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-12)
    return out


def learnt(terms: np.ndarray, truth: np.ndarray) -> Model:
    """A model from the ``shares`` of labelled texts."""
    weight = (np.log((1 + len(terms)) / (1 + (terms > 0).sum(axis=0))) + 1).astype(np.float32)
    weight[2 * BINS :] = np.sqrt(2)
    table = weighted(terms, weight)
    mean = table.mean(axis=0)
    table -= mean
    # the leading right singular vectors, by iteration in a subspace a little larger
    basis = np.random.default_rng(5).standard_normal((TERMS, min(DIMENSIONS + 16, *table.shape))).astype(np.float32)
    for _ in range(12):
        basis = np.linalg.qr(table.T @ (table @ basis))[0]
    low = (table @ basis).astype(np.float64)
    values, turned = np.linalg.eigh(low.T @ low)
    some = np.flatnonzero(values > 1e-9 * max(values.max(), 1e-12))[::-1][:DIMENSIONS]
    axes = (basis @ turned[:, some]).astype(np.float32)
    return Model(weight, mean, axes, _unit(table @ axes), truth, float(truth.mean()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from labelled documents; rows whose label or id is null teach nothing.

    Of an id labelled twice the smaller label counts, of documents of one id the
    first text in code point order.  Without any labels every score is the
    prior, 0.5.
    """
    known = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.min(f"`{label_col}`").cast("int").alias("_label"))
    # the smallest hashes of each label: two top-k, each bounded
    first = [known.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)]
    chosen = first[0].unionByName(first[1])
    rows = docs.select(F.col(f"`{id_col}`").alias("_own"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), F.col("_own") == F.col("_id"))
    rows = rows.groupBy("_id", "_label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, terms in _blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(a, b - a).cast(pa.int64()), batch.column("_label").slice(a, b - a).cast(pa.int32()), pa.array([t.astype(np.float16).tobytes() for t in terms], pa.binary())], names=["i", "y", "x"])

    found = common.mapped(rows, run, "i long, y int, x binary").toArrow().sort_by("i")  # 2 * sample rows at most
    if not found.num_rows:
        return Model(np.ones(TERMS, np.float32), np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    truth = found["y"].to_numpy().astype(np.float64)
    terms = np.empty((len(truth), TERMS), np.float32)
    for i, x in enumerate(found["x"]):
        terms[i] = np.frombuffer(x.as_buffer(), np.float16)
    del found
    return learnt(terms, truth)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = text_buffer(texts)
    for a, b in slices(offsets, STEP_BYTES):
        for c in range(a, b, STEP_ROWS):  # short texts: bound the rows too
            d = min(b, c + STEP_ROWS)
            yield c, d, shares(counts(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]))


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with a score between 0 and 1 (higher: label 1 is likelier).

    Texts without terms (null, empty) get the model's prior.  Other columns,
    nulls among them, stay as they are, and so do repeated rows; ``name`` gets
    underscores in front while another column has it.  Beside its texts a task
    needs 8 bytes for each word of its longest one.
    """
    name = common.free(name, docs.columns)
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.score(terms) for _, _, terms in _blocks(batch.column(batch.schema.get_field_index(text_col)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else np.zeros(0))], names=[*batch.schema.names, name])

    return common.mapped(docs, run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row may only be scored, not learnt from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score is ``least`` or more; columns stay as they are."""
    model = fit(docs, labels.where(~held_out()))
    out = scored(docs, model)
    return out.where(F.col(out.columns[-1]) >= least).drop(out.columns[-1])


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document's quality score, learnt from the rows that aren't held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels").where(~held_out()))
    out = scored(docs, model, name="score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
