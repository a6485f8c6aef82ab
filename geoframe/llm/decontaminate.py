"""Operator 2: benchmark decontamination by template canonicalisation.

Words are lower-cased and freed of marks around them; numbers, names (capitalised within a sentence) and units (after
a number) become typed placeholders, so that a question whose figures or people were changed keeps its template.  Windows
of the template are hash-joined with the benchmark's windows; windows of little but placeholders, and items shorter
than a window, are joined by their words as they are, so that verbatim copies are met whatever they are made of.  The values that stand in the slots of matched windows must map one to one, per alignment
of document and item: a re-parameterised question replaces each value by one other value throughout.  An item
counts as leaked if the consistent windows cover at least half of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, cut, load, pick, release, scanned, ship, with_rows, with_text_ids
from .numeric import IN_SEQUENCE, Prefix, chunks, tokens

WINDOW, COVERAGE = 8, 0.5
#: Words other than placeholders that a window needs to be joined by its template; with fewer it is joined by its words.
LITERALS = 4
#: Items of fewer words say too little to be told from chance within a text: they match whole texts only.
LEAST = 3
#: Benchmark windows whose hashes may be broadcast as a filter; with more, all windows are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
CHUNK, CACHE = 1 << 19, 100_000
WORD, NUMBER, UNIT, NAME = range(4)
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent % degrees mph kmh w kw v a hz".split()
_STRIP = b".,;:!?\"'()[]{}<>*_`|#$%&~"
_ENDS = (b".", b"!", b"?", b":")


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 5)


_SLOT = {kind: np.uint64(_hash(name)) for kind, name in ((NUMBER, b"<num>"), (UNIT, b"<unit>"), (NAME, b"<name>"))}


class Words(dict):
    """Raw word to what is known of it: (hash, kind, capitalised, ends a sentence). Bounded."""

    def __init__(self):
        self.units, self.numbers = ({w.encode() for w in x} for x in (UNITS, NUMBER_WORDS))

    def __missing__(self, raw: bytes) -> tuple[int, int, bool, bool]:
        bare = raw.strip(_STRIP) or raw.strip(b".,;:!?") or raw
        text = bare.decode("utf-8", "replace")
        low = text.lower().encode()
        digits = any(c.isdigit() for c in text)
        kind = NUMBER if digits and not any(c.isalpha() for c in text.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ%")) or low in self.numbers else UNIT if low in self.units else WORD
        capital = len(text) > 1 and text[0].isupper() and text[1:].islower()
        self[raw] = out = (_hash(low), kind, capital, raw.rstrip(b"\"')]}").endswith(_ENDS))
        return out


_WORDS = Words()


def forget() -> None:
    """At the end of a task: workers live on, into stages that have no use for the words."""
    global _WORDS
    _WORDS = Words()


#: Sets hashes of words as they are apart from those of templates.
_AS_IT_IS = np.uint64(0x5851F42D4C957F2D)


class Templates:
    """Template hashes of a run of texts: windows of WINDOW words, or the whole of a shorter text, and all windows of the lengths in short."""

    def __init__(self, texts: list[bytes], short: list[int]):
        global _WORDS
        if len(_WORDS) > CACHE:
            _WORDS = Words()
        self.index, self.found, self.first = tokens(texts)
        self.size = np.diff(self.first)
        n = len(self.index)
        rows = list(map(_WORDS.__getitem__, self.found))
        h, kind, capital, ends = (np.array([r[i] for r in rows], t)[self.index] for i, t in enumerate((np.uint64, np.int8, bool, bool)))
        opens = np.zeros(n + 1, bool)  # the first word of a sentence is capitalised anyway
        opens[self.first] = True
        opens[1:] |= np.append(ends, True)[:n]
        number_before = np.concatenate([[False], kind[:-1] == NUMBER])[:n] & ~_at(self.first, n)
        kind = np.where((kind == UNIT) & ~number_before, WORD, kind)
        self.kind = np.where((kind == WORD) & capital & ~opens[:n], NAME, kind)
        as_it_is = Prefix(h, IN_SEQUENCE)
        for k, v in _SLOT.items():
            h = np.where(self.kind == k, v, h)
        template = Prefix(h, IN_SEQUENCE)
        literal = np.concatenate([[0], np.cumsum(self.kind == WORD)])
        parts = []
        for width in [0, *short]:  # 0: the usual windows
            width = np.minimum(self.size, WINDOW) if not width else np.full(len(texts), width)
            count = np.where(self.size > 0, np.maximum(self.size - width + 1, 0), 0)
            if parts:
                count[(self.size < WINDOW) & (self.size == width)] = 0  # taken as a whole
            stop = np.cumsum(count)
            owner = np.repeat(np.arange(len(texts)), count)
            pos = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - count, count)
            start = self.first[owner] + pos
            end = start + width[owner]
            full = (width[owner] == WINDOW) & (literal[end] - literal[start] >= LITERALS)
            window = np.where(full, template.slices(start, end), as_it_is.slices(start, end) ^ _AS_IT_IS)
            parts.append((owner, pos, start, end, full, window.view(np.int64)))
        self.owner, self.pos, self.start, self.end, self.full, self.window = (np.concatenate(x) for x in zip(*parts))

    def slots(self, i: int) -> list[str]:
        """The values in the slots of window i; none if it is joined by its words."""
        if not self.full[i]:
            return []
        return [self.found[self.index[j]].strip(_STRIP).decode("utf-8", "replace").lower() for j in range(self.start[i], self.end[i]) if self.kind[j] != WORD]


def _at(first: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[first] = True
    return out[:n]


def windows(rows: DataFrame, keep: list[str], short: list[int], only=None) -> DataFrame:
    """The columns `keep` of rows with window, pos, words (of the text), slots; only: a broadcast of sorted hashes."""
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [x or b"" for x in b["text"]]
            for lo, hi in chunks(texts, CHUNK):
                t = Templates(texts[lo:hi], short)
                if only is None:
                    i = np.arange(len(t.window))
                else:
                    known = only.value
                    at = np.searchsorted(known, t.window)
                    i = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == t.window) if len(known) else np.zeros(0, np.int64)
                out = b[keep].iloc[lo:hi].iloc[t.owner[i]].reset_index(drop=True)
                slots = pd.Series([t.slots(j) for j in i.tolist()], dtype="object")  # of no rows, too
                yield out.assign(window=t.window[i], pos=t.pos[i], words=t.size[t.owner[i]], slots=slots)
        forget()
        release()

    return rows.mapInPandas(run, f"{fields}, window long, pos int, words int, slots array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """fid, rix, doc_id, item_id, coverage: the rows of docs that hold a benchmark item, with the share covered.

    Null and empty texts and items hold nothing; an item of LEAST words to one less than a window matches wherever its
    words stand, one of fewer only a text of just its words; repeated rows are reported each; repeated item ids with different
    texts are joined to one item; texts of any length are read whole; an empty table gives an empty one; other columns aren't read.
    Documents are read once and not shuffled: the hashes of the benchmark, if they are at most BROADCAST_WINDOWS, filter
    the windows before the join.
    """
    spark = docs.sparkSession
    ship(spark)
    items = cut(windows(pick(benchmark, item_id="item_id", text="text").where("item_id is not null").withColumn("text", F.col("text").cast("binary")), ["item_id"], []), "items")
    short = sorted(r[0] for r in items.where(F.col("words").between(LEAST, WINDOW - 1)).select("words").distinct().collect())
    items = items.select("window", "item_id", F.col("pos").alias("item_pos"), F.col("words").alias("item_words"), F.col("slots").alias("item_slots"))
    hashes = items.select("window").distinct()
    only = None
    if hashes.count() <= BROADCAST_WINDOWS:
        only = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hashes.collect()], np.int64)))
    rows = with_rows(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    found = with_text_ids(rows, lambda d: windows(d, [*ROW, "doc_id"], short, only))
    met = found.join(items, "window")
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    # one alignment: the window's place in the document less its place in the item
    aligned = met.groupBy(*ROW, "doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.max("item_words").alias("item_words"), F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    distinct = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    aligned = aligned.where((distinct("a") == F.size("pairs")) & (distinct("b") == F.size("pairs")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, F.least(p + WINDOW, F.col("item_words")) - 1)))))
    # several alignments (words put in or left out) cover an item together
    whole = aligned.groupBy(*ROW, "doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"))
    return whole.withColumn("coverage", covered / F.col("item_words")).where(F.col("coverage") >= coverage).select(*ROW, "doc_id", "item_id", "coverage")


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    docs = scanned(docs)
    hit = cut(leaks(docs, benchmark).select(F.col("fid").alias("_leak_fid"), F.col("rix").alias("_leak_rix")).distinct(), "leaks")
    at = docs.metadataColumn("_metadata")
    return docs.join(hit, (F.xxhash64(at["file_path"]) == hit["_leak_fid"]) & (at["row_index"] == hit["_leak_rix"]), "left_anti")
