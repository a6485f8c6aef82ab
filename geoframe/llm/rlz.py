"""Operator 5: substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks at content-defined anchors: in every window of `window`
words the least hash of GRAM consecutive words is an anchor, so equal windows hold an equal anchor wherever
they stand.  A block reaches from one anchor as far as the windows that start before the next one.  The index
keeps each distinct block once, under a hash.  A document is factored greedily: block after block is looked up
and a run of blocks that occur elsewhere is one factor, all of whose windows repeat.  At the boundaries of
factors, where a repeated passage begins or ends inside a block, the windows are checked one by one, but only
those whose anchor occurs elsewhere; of the factors, the one copy in the index takes part in that check, so
that long passages and copies of whole documents cost one row a block, however many copies there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, cut, drop, load, release, ship, with_rows, with_text_ids
from .numeric import IN_SEQUENCE, SECOND, Prefix, chunks, sliding_min, words

WINDOW, GRAM = 35, 5
CHUNK = 1 << 21


class Parsed:
    """Anchors, blocks and windows of a run of texts."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        h, first = words(texts)
        self.h, self.first, self.window = h, first, window
        self.ok = bool(len(h) >= window)
        if not self.ok:
            return
        self.n = np.diff(first)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.hash = Prefix(h, IN_SEQUENCE)
        at = np.arange(len(h) - gram + 1)
        grams = Prefix(h, SECOND).slices(at, at + gram)
        self.least, where = sliding_min(grams, window - gram + 1)
        last = len(h) - window + 1
        self.valid = self.doc[:last] == self.doc[window - 1 :]
        self.least, where = self.least[:last], where[:last]
        # blocks begin at anchors and at the first word of a text that has a window
        begins = np.zeros(len(h) + 1, bool)
        begins[where[self.valid]] = True
        begins[first[:-1][self.n >= window]] = True
        self.begin = np.flatnonzero(begins)
        owner = self.doc[self.begin]
        after = np.minimum(np.append(self.begin[1:], len(h)), first[owner + 1])
        windows = np.maximum(np.minimum(after, first[owner + 1] - window + 1) - self.begin, 0)
        self.owner, self.count, self.anchor = owner, windows, grams[np.minimum(self.begin, len(grams) - 1)]
        stop = self.begin + np.where(windows > 0, windows + window - 1, 0)
        self.block = self.hash.slices(self.begin, stop)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """fid, rix, at, anchor, block, n, total: each block's first word, hashes and number of windows, and the text's number of windows."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, fid, rix = [x or b"" for x in b["text"]], b["fid"].to_numpy(), b["rix"].to_numpy()
            for lo, hi in chunks(texts, CHUNK):
                p = Parsed(texts[lo:hi], window, gram)
                if p.ok and len(p.begin):
                    yield pd.DataFrame({"fid": fid[lo:hi][p.owner], "rix": rix[lo:hi][p.owner], "at": p.begin - p.first[p.owner], "anchor": _signed(p.anchor), "block": _signed(p.block), "n": p.count, "total": p.n[p.owner] - window + 1})

    return docs.select(*ROW, "text").mapInPandas(run, "fid long, rix long, at int, anchor long, block long, n int, total int")


def boundary_windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """docs (with flags: at, anchor, n, kind of its blocks whose anchor repeats) to h1, h2, fid, rix, at, open.

    Windows of blocks that the index keeps (kind 2; open is false) and windows outside factors whose anchor repeats.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, fid, rix = [x or b"" for x in b["text"]], b["fid"].to_numpy(), b["rix"].to_numpy()
            for lo, hi in chunks(texts, CHUNK):
                p = Parsed(texts[lo:hi], window, gram)
                if not p.ok:
                    continue
                part = b.iloc[lo:hi]
                doc = np.repeat(np.arange(hi - lo), [len(x) for x in part["ats"]])
                if not len(doc):
                    continue
                at, anchor, n, kind = (np.concatenate([np.asarray(x, np.int64) for x in part[c]]) for c in ("ats", "anchors", "ns", "kinds"))
                at = at + p.first[doc]
                salt = lambda d, v: v.view(np.uint64) + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                with np.errstate(over="ignore"):
                    known = np.isin(salt(p.doc[: len(p.least)], p.least), salt(doc, anchor))
                state = np.zeros((2, len(p.h) + 1), np.int64)
                for row, keep in ((0, kind >= 1), (1, kind == 2)):
                    np.add.at(state[row], at[keep], 1)
                    np.add.at(state[row], at[keep] + n[keep], -1)
                inside, kept = (np.cumsum(s)[: len(p.least)] > 0 for s in state)
                s = np.flatnonzero(p.valid & (kept | (known & ~inside)))
                owner = p.doc[s]
                yield pd.DataFrame({"h1": _signed(p.hash.slices(s, s + window)), "h2": _signed(Prefix(p.h, SECOND).slices(s, s + window)), "fid": fid[lo:hi][owner], "rix": rix[lo:hi][owner], "at": s - p.first[owner], "open": ~inside[s]})

    return docs.mapInPandas(run, "h1 long, h2 long, fid long, rix long, at int, open boolean")


def repeated(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """fid, rix, at, n: runs of n windows, the first at word `at`, whose words also start anywhere else.

    rows: fid, rix, doc_id, text (binary).
    """
    all_blocks = cut(blocks(rows, window, gram), "blocks")
    # the aggregated sides are cut first: a join of two plain shuffles may be split where one anchor is very common
    shared = cut(all_blocks.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "shared-anchors")
    some = cut(all_blocks.join(shared, "anchor"), "shared-blocks")
    drop(all_blocks, shared)
    index = cut(some.where("n > 0").groupBy("block", "anchor").agg(F.count("*").alias("c"), F.min(F.struct("fid", "rix", "at")).alias("first")).where("c > 1"), "block-index")
    kind = F.when(F.col("first").isNull(), 0).when(F.struct("fid", "rix", "at") == F.col("first"), 2).otherwise(1)
    factored = cut(some.join(index, ["block", "anchor"], "left").select(*ROW, "at", "anchor", "n", "total", F.when(F.col("n") > 0, kind).otherwise(0).alias("kind")), "factors")
    drop(some, index)
    per_row = (
        factored.groupBy(*ROW)
        .agg(F.collect_list(F.struct("at", "anchor", "n", "kind")).alias("f"), F.max("total").alias("total"), F.sum(F.when(F.col("kind") > 0, F.col("n")).otherwise(0)).alias("inside"), F.max("kind").alias("top"))
        .where("top = 2 or inside < total")
        .select(*ROW, *[F.col(f"f.{c}").alias(f"{c}s") for c in ("at", "anchor", "n", "kind")])
    )
    found = cut(boundary_windows(rows.join(per_row, ROW), window, gram), "windows")
    twice = cut(found.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.max("open").alias("o")).where("c > 1 and o").select("h1", "h2"), "window-index")
    single = found.where("open").join(twice, ["h1", "h2"]).select(*ROW, "at", F.lit(1).alias("n"))
    return factored.where("kind > 0").select(*ROW, "at", "n").union(single)


def kept_words(raw: bytes | None, at: list[int] | None, n: list[int] | None, window: int) -> tuple[list[bytes], int]:
    """(words that stay, number of all words)."""
    found = raw.split() if raw else []
    if at is None or not len(at):
        return found, len(found)
    edge = np.zeros(len(found) + 1, np.int64)
    a = np.asarray(at, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, a + np.asarray(n, np.int64) + window - 1, -1)
    stays = np.cumsum(edge)[:-1] == 0
    return [found[i] for i in np.flatnonzero(stays).tolist()], len(found)


def _with_runs(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    rows = with_rows(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    runs = cut(repeated(rows, window), "runs").groupBy(*ROW).agg(F.collect_list(F.struct("at", "n")).alias("r"))
    return rows.join(runs.select(*ROW, F.col("r.at").alias("at"), F.col("r.n").alias("n")), ROW, "left").select("doc_id", "text", "at", "n")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, text (the words that stay, joined by a space), n_words, n_removed for every row of docs.

    A word goes if a window of `window` consecutive words that covers it starts anywhere else in the table, be it in
    the same text.  Null text has no words; texts shorter than a window keep all; repeated rows are copies and lose
    every window; an empty table gives an empty one; other columns aren't read.
    """
    return _finish(docs, id_col, text_col, window, False)


def _finish(docs: DataFrame, id_col: str, text_col: str, window: int, digest: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw, at, n in zip(b["text"], b["at"], b["n"]):
                kept, total = kept_words(raw, at, n, window)
                line = b" ".join(kept)
                out.append((total, total - len(kept), hashlib.sha256(line).hexdigest() if digest else line.decode("utf-8", "replace")))
            total, gone, last = map(list, zip(*out)) if out else ([], [], [])
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": total, "n_removed": gone, "kept_sha256" if digest else "text": last})

    schema = f"doc_id string, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string"
    return with_text_ids(_with_runs(docs, id_col, text_col, window), lambda d: d.mapInPandas(run, schema))


def op5_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 35 words removed from every document."""
    return _finish(load(spark, sf_dir, "documents"), "doc_id", "text", WINDOW, True)


OP5_SQL = """
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), s AS (
  SELECT rid, i, array_to_string(words[i:i + 34], ' ') AS seq
  FROM w, unnest(range(1, len(words) - 33)) AS t(i)
), twice AS (
  SELECT seq FROM s GROUP BY seq HAVING count(*) > 1
), hit AS (
  SELECT rid, i FROM s SEMI JOIN twice USING (seq)
), gone AS (
  SELECT DISTINCT rid, i + k AS j FROM hit, unnest(range(0, 35)) AS t(k)
), kept AS (
  SELECT w.rid, string_agg(word, ' ' ORDER BY j) AS line, count(*) AS n
  FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w) w
  ANTI JOIN gone USING (rid, j)
  GROUP BY w.rid
)
SELECT w.doc_id, len(w.words) AS n_words, len(w.words) - coalesce(kept.n, 0) AS n_removed,
       sha256(coalesce(kept.line, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""
