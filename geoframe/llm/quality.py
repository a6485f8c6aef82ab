"""Operator 1: quality by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed counts of byte trigrams, once of the bytes themselves and once of their shapes (letters,
capitals, digits, each mark).  A bounded sample of labelled texts gives the weights of the terms and the leading
singular vectors; every text is projected on them.  The labelled vectors, bounded by the sample, are broadcast,
and every document is compared with all of them by exact cosine products, a block of documents at a time; the
labels of its nearest neighbours are weighted by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, pick, release, ship, with_text_ids

RAW_TERMS, SHAPE_TERMS = 2048, 1024
TERMS = RAW_TERMS + SHAPE_TERMS
#: Labelled texts of each label that are learnt from, at most; latent dimensions; voters.
PER_LABEL, DIMENSIONS, VOTERS = 2000, 64, 25
THRESHOLD = 0.7
#: Cosines are compared and weighed in units of one part in so many, so that no rounding of a block's products shows.
EXACT = 1 << 20
CHUNK = 1 << 20


def _shapes() -> np.ndarray:
    shape = np.arange(256, dtype=np.uint32)
    shape[ord("a") : ord("z") + 1] = ord("a")
    shape[ord("A") : ord("Z") + 1] = ord("A")
    shape[ord("0") : ord("9") + 1] = ord("0")
    shape[0x80:] = ord("a")
    return shape


def counts(texts: list[bytes]) -> np.ndarray:
    """Hashed trigram counts, a row for each text; all bytes of it count."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    out = np.zeros((len(texts), TERMS), np.float32)
    if len(raw) < 3:
        return out
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), size)
    same = owner[2:] == owner[:-2]
    row = owner[:-2][same] * TERMS
    shape = _shapes()[raw]
    for b, at, n in ((raw.astype(np.uint32), 0, RAW_TERMS), (shape, RAW_TERMS, SHAPE_TERMS)):
        code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[same]
        h = (code * np.uint32(2654435761)) >> np.uint32(16)
        found = np.bincount(row + at + h % n, minlength=out.size)
        out += found.reshape(out.shape)
    return out


@dataclass
class Model:
    """weight by term, projection (terms by dimensions), unit vectors and labels of the sample, share of label 1."""

    weight: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, texts: list[bytes]) -> np.ndarray:
        x = weigh(counts(texts), self.weight).astype(np.float64) @ self.projection.astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Weighted share of label 1 among the neighbours; the sample's labels are reweighted to their share in all."""
        texts = [t or b"" for t in texts]
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        share = max(self.labels.mean(), 1e-9)
        of = np.where(self.labels == 1, self.prior / share, (1 - self.prior) / max(1 - share, 1e-9))
        lo = total = 0
        for hi in range(1, len(texts) + 1):
            total += len(texts[hi - 1])
            if hi < len(texts) and total < CHUNK and hi - lo < 256:
                continue
            cosine = np.rint(self.latent(texts[lo:hi]) @ self.vectors.T * EXACT)
            k, n = min(VOTERS, cosine.shape[1]), cosine.shape[1]
            # of equal cosines the earlier of the sample votes, whatever else is in the block
            near = np.argpartition(np.arange(n) - cosine * n, k - 1, axis=1)[:, :k]
            near.sort(axis=1)
            w = np.maximum(np.take_along_axis(cosine, near, 1) / EXACT, 0) ** 8 * of[near]
            all_w = w.sum(1)
            out[lo:hi] = np.where(all_w > 1e-12, (w * self.labels[near]).sum(1) / np.maximum(all_w, 1e-12), self.prior)
            lo, total = hi, 0
        return np.clip(out, 0.0, 1.0)


def weigh(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Damped counts by term weight, each half of unit length."""
    x = np.log1p(x) * weight
    for part in (x[:, :RAW_TERMS], x[:, RAW_TERMS:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return x


def fit(x: np.ndarray, labels: np.ndarray, prior: float, dimensions: int = DIMENSIONS) -> Model:
    """Latent-semantic model of the sample's counts, by a randomised singular value decomposition."""
    n = len(x)
    weight = (np.log((1 + n) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = weigh(x, weight)
    if not n:
        return Model(weight, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, prior)
    d = min(dimensions, n)
    q = np.random.default_rng(7).standard_normal((TERMS, d + 16)).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    projection = np.ascontiguousarray((q @ vt.T)[:, :d], np.float32)
    model = Model(weight, projection, np.zeros((0, d), np.float32), labels, prior)
    v = x @ projection
    model.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, *, per_label: int = PER_LABEL, label_col: str = "quality") -> Model:
    """Learn from at most per_label texts of each label, those of least hash, never from held-out rows.

    docs: doc_id, text; labels: doc_id and a label 0 or 1.  Rows without id or label are left out; a document with
    several labels counts once, with the largest.  Without any labelled text every score is 0.5.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(f"`{label_col}`").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # labels without a text in docs fall away in the join and make the sample smaller
    some = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        some = part if some is None else some.union(part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.iloc[lo : lo + 64]
                x = counts([t or b"" for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "x": [zlib.compress(r.tobytes(), 1) for r in x]})

    # of several texts of one id the least counts, so that the sample is the same in every run
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = sample.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x binary").limit(2 * per_label).toPandas().sort_values("doc_id")
    x = np.array([np.frombuffer(zlib.decompress(r), np.float32) for r in got["x"]], np.float32).reshape(len(got), TERMS)
    total = sum(n.values())
    return fit(x, got["y"].to_numpy(np.int64), n.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) to doc_id, score; map only.  Null and empty texts get the share of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": shared.value.score(list(b["text"]))})

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Repeated rows and null ids are kept (a null id counts as the empty text for held_out); null and empty texts get the
    share of label 1; texts of any length are scored whole; of equally near voters those earlier in the sample (by doc_id)
    vote; an empty table gives an empty one; only the two named columns of docs are read.  Only the sample's ids are broadcast (2 * per_label) and the
    model (per_label and the dimensions bound it); the texts aren't shuffled.
    """
    ship(docs.sparkSession)
    d = pick(docs, doc_id=id_col, text=text_col)
    model = train(d, labels, per_label=per_label)
    out = with_text_ids(d, lambda x: score(x, model))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(pick(docs, doc_id=id_col, text=text_col), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array(shared.value.score(texts) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
