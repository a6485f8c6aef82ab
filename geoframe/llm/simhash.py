"""Operator 8: SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint has 64 bits in three segments of 22, 21 and 21 bits.  Two fingerprints that differ in at most
two bits agree wholly in one segment at least, and in the next one differ in two bits at most.  The binary
Golay code of length 23 is perfect with radius 3: two words at a distance of at most two have a word between
them, at most one bit from either, whose nearest codeword lies within four bits of both.  So the codewords
within four bits of a word (six for most words, one for the rest) are keys of which such a pair shares one.
A key is the exact segment with the index of one of those codewords; fingerprints with equal keys are
compared bit by bit.  A key with many fingerprints isn't expanded into pairs: there every fingerprint names
the 65 words within one bit of it, and two of them are linked exactly if they name a common word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .common import ROW, cut, drop, load, pick, release, scanned, ship, with_rows, with_text_ids
from .graph import components

#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED, SHINGLE, RADIUS = 42, 3, 2
#: Keys with more fingerprints than this are linked through the words between them.
PAIRS_UP_TO = 8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(raw: bytes | None) -> int:
    """SimHash of a UTF-8 text as an unsigned 64-bit number."""
    import xxhash

    words = raw.translate(LOWER).split() if raw else []
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(line, SEED)
    width = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(width + 1) - 1
    start, stop = (stop - width)[: 1 - SHINGLE].tolist(), stop[SHINGLE - 1 :].tolist()
    count = np.zeros(64, np.int64)
    for i in range(0, len(start), 1 << 16):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(start[i : i + (1 << 16)], stop[i : i + (1 << 16)])], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(start), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The other columns of docs with fp (a signed 64-bit number) in place of text; map only."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(x) for x in b["text"]], np.uint64).view(np.int64)
            yield b[rest].assign(fp=fp)
        release()

    return docs.withColumn("text", F.col("text").cast("binary")).mapInPandas(run, f"{fields}, fp long")


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of each 12-bit half, up to six error patterns of weight at most four by remainder; -1: none)."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GOLAY << (bit - 11)
        return v

    of = np.array([[remainder(v) for v in range(4096)], [remainder(v << 12) if v < 2048 else 0 for v in range(4096)]], np.int64)
    errors: list[list[int]] = [[] for _ in range(2048)]
    single = [remainder(1 << i) for i in range(23)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            r = e = 0
            for i in bits:
                r, e = r ^ single[i], e | 1 << i
            errors[r].append(e)
    table = np.full((2048, max(map(len, errors))), -1, np.int64)
    for r, found in enumerate(errors):
        table[r, : len(found)] = found
    return of, table


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every fingerprint."""
    of, table = golay()
    fp = fp.view(np.uint64)
    parts = [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, out = [], []
    for i in range(3):
        near = parts[(i + 1) % 3]
        errors = table[of[0][near & 4095] ^ of[1][near >> 12]]
        row, j = np.nonzero(errors >= 0)
        index = (near[row] ^ errors[row, j]) >> 11  # the code is systematic: its upper 12 bits tell a codeword
        rows.append(row)
        out.append((i << 40) + (parts[i][row] << 12) + index)
    return np.concatenate(rows), np.concatenate(out)


def keyed(fps: DataFrame) -> DataFrame:
    """fp, key: up to 18 rows for each fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy()
            row, key = keys(fp)
            yield pd.DataFrame({"fp": fp[row], "key": key})

    return fps.select("fp").mapInPandas(run, "fp long, key long")


def links(fps: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """a, b: links between distinct fingerprints that differ in at most two bits.

    All of them, or within a crowded key as many as keep the components.
    """
    k = cut(keyed(fps), "keys")
    count = cut(k.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-counts")
    k = cut(k.join(count, "key"), "shared-keys")
    few = k.where(F.col("n") <= pairs_up_to).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    crowd = k.where(F.col("n") > pairs_up_to).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    words = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("word", "a")
    stars = words.join(least, "word").where("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars)


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def grouped(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp, any others) with component_id: the smallest doc_id of the fingerprints reachable.

    Null doc_ids are left out of the minimum; a component without any other doc_id has null.
    """
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("lo")), "fingerprints")
    root = cut(components(links(fps), "a", "b"), "roots")
    low = root.join(fps, root["node"] == fps["fp"]).groupBy("root").agg(F.min("lo").alias("low"))
    linked = root.join(low, "root").select(F.col("node").alias("fp"), "low", F.lit(True).alias("is_linked"))
    # cut first: a join of two plain shuffles may be split where a third of all rows are copies of one text
    of = cut(fps.join(linked, "fp", "left").select("fp", F.when(F.col("is_linked"), F.col("low")).otherwise(F.col("lo")).alias("component_id")), "groups")
    return prints.join(of, "fp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row of docs.

    Null and empty texts have fingerprint zero and are linked like any other; texts of fewer than three words have
    one shingle; repeated rows and ids are kept; an empty table gives an empty one; other columns aren't read.
    The texts are read once and never shuffled; equal fingerprints are one node, so copies cost nothing.
    """
    prints = cut(with_text_ids(pick(docs, doc_id=id_col, text=text_col), fingerprints), "prints")
    return grouped(prints).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(load(spark, sf_dir, "documents"))


def golay_pairs(found: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: sets (fp, sim) whose SimHashes are linked, one of each SimHash, and the others of each SimHash with that one.

    found: every row's sim; sets: the distinct sets that may be near to any other.
    """
    close = cut(links(cut(found.select(F.col("sim").alias("fp")).distinct(), "fingerprints")), "close")
    first = cut(sets.groupBy("sim").agg(F.min("fp").alias("a")), "first-sets")
    equal = sets.join(first, "sim").where("fp > a").select("a", F.col("fp").alias("b"))
    one, two = first.select(F.col("sim").alias("sim_a"), "a"), first.select(F.col("sim").alias("sim_b"), F.col("a").alias("b"))
    return equal.union(close.select(F.col("a").alias("sim_a"), F.col("b").alias("sim_b")).join(one, "sim_a").join(two, "sim_b").select("a", "b"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of smallest doc_id stays.

    Near are texts whose five-word shingles have a Jaccard similarity of 0.8 or more.  SimHashes of these shingles are
    linked by their Golay keys, as op8 does, over all rows; an exact check of the sets keeps the links that are near.
    Two bits of 64 miss many near texts, so what is near across the groups found so is looked for exactly (see jaccard.py).
    Texts without words are equal.  Of rows with that doc_id the first in file order of the first file stays; null ids come last.
    """
    docs = scanned(docs)
    rows = with_rows(docs, doc_id=id_col, text=text_col)
    found = cut(jaccard.prints(rows), "prints")
    wanted = jaccard.resembling(found)
    one = found.select(*ROW, "fp", "sim").join(wanted, "fp").groupBy("fp", "sim").agg(F.min(F.struct(*ROW)).alias("at")).select("fp", "sim", "at.*")
    # the texts pass by, what is wanted of them is held
    sets = cut(jaccard.sets(rows.select(*ROW, "text").join(one.hint("shuffle_hash"), ROW).select("fp", "sim", "text")), "sets")
    by_golay = jaccard.verified(golay_pairs(found, sets), sets)
    groups = cut(components(by_golay, "a", "b"), "groups")
    near = jaccard.links(sets, groups=groups)
    root = cut(components(by_golay.union(near), "a", "b"), "roots").withColumnRenamed("node", "fp")
    in_group = found.select("fid", "rix", "doc_id", "fp").join(root, "fp", "left").select("fid", "rix", "doc_id", F.coalesce("root", "fp").alias("group"))
    stays = in_group.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fid", "rix")).alias("m")).select(F.col("m.fid").alias("_near_fid"), F.col("m.rix").alias("_near_rix"))
    stays = cut(stays, "stays")
    drop(found, wanted, sets, by_golay, groups, near)
    at = docs.metadataColumn("_metadata")
    return docs.join(stays, (F.xxhash64(at["file_path"]) == stays["_near_fid"]) & (at["row_index"] == stays["_near_rix"]), "left_semi")
