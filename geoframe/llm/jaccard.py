"""Near-duplicates by word shingles: all pairs of texts with a Jaccard similarity of at least 0.8, exactly.

A text is the set of hashes of its five-word shingles.  Two sets of which each shares four fifths with the other
must share a member among the first ones of both in any common order (prefix filter).  In the order of the hashes
that leaves out the texts that nothing resembles; only the others' sets are held whole.  Those are ordered by how many of
them hold a shingle, rarest first, so that a passage of many texts makes no candidates.  Shingles that no other text
holds bound how much a text can share, and so the size of any partner.  Candidates are compared as whole sets.

A crowded key isn't expanded: its texts are compared with a leader, the one that has the fewest shingles of its own, and
those that resemble it are linked through it.  What a text that doesn't resemble the leader may still resemble is looked
for among the differences from the leader: two texts x and y differ as much as their differences D(x) and D(y) do, so if x
is far from the leader and near to y, then more than half of D(y), less what the sizes allow, lies in D(x), too.  That is
a prefix filter again, over the elements of the differences, which few texts share; what is crowded there gets leaders of
its own, for LEVELS levels, and is then expanded.

What is expanded is filtered within the join: sets that differ in d members have sketches (parities of the members that fall
into each of SKETCH places) that differ in at most d bits, so that a pair with sketches farther apart than near sets may be
is not made.  Nor is a pair of which both sets are already known to be of one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, cut, drop, release, ship
from .numeric import IN_SEQUENCE, Prefix, chunks, majority, words

SHINGLE = 5
#: Keys with more sets than this are linked through one of them.  A set meets at most so many others under a key; that
#: is far less than the differences from leaders take where the sets of a key have little more than the key in common.
PAIRS_UP_TO = 256
#: Levels of leaders.
LEVELS = 3
#: Bits of a sketch.
SKETCH = 512
CHUNK, SALTS = 1 << 19, 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words none."""
    h, first = words([t.translate(LOWER) for t in texts])
    size = np.diff(first)
    prefix, out = Prefix(h, IN_SEQUENCE), []
    start = np.arange(len(h))
    stop = np.minimum(start + SHINGLE, len(h))
    whole = size < SHINGLE
    stop[first[:-1][whole & (size > 0)]] = first[1:][whole & (size > 0)]
    values = prefix.slices(start, stop).view(np.int64)
    for a, n in zip(first[:-1].tolist(), np.where(whole, np.minimum(size, 1), size - SHINGLE + 1).tolist()):
        out.append(np.unique(values[a : a + n]))
    return out


def _mapped(rows: DataFrame, fields: str, columns) -> DataFrame:
    """The other columns of rows with those that columns() makes of the shingle sets in place of text; map only."""
    ship(rows.sparkSession)
    rest = [c for c in rows.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            for lo, hi in chunks(texts, CHUNK):
                new = columns(shingle_sets(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in rest], *new.values()], names=[*rest, *new])
        release()

    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def _lists(found: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found), pa.int64()))


def prints(rows: DataFrame) -> DataFrame:
    """The other columns of rows with fp (equal for equal sets), n (members), shown (the least of them) and sim in place of text.

    sim is the SimHash of the members, zero without any.  A set of n shows its n // 5 + n // 50 + 1 least; a near one, of 4 / 5 n at least, has (4 n / 5) // 50 + 1 of them, too.
    """

    def columns(found: list[np.ndarray]) -> dict[str, pa.Array]:
        fp = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
        return {"fp": pa.array(fp), "n": pa.array(np.array([len(x) for x in found], np.int32)), "shown": _lists([x[: len(x) // 5 + len(x) // 50 + 1] for x in found]), "sim": pa.array(np.array([majority(x) for x in found], np.uint64).view(np.int64))}

    return _mapped(rows, "fp long, n int, shown array<bigint>, sim long", columns)


def _sketch(found: np.ndarray) -> np.ndarray:
    odd = np.bincount(found & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sets(rows: DataFrame) -> DataFrame:
    """The other columns of rows with toks, the set, and its sketch in place of text."""
    return _mapped(rows, "toks array<bigint>, sketch array<bigint>", lambda found: {"toks": _lists(found), "sketch": _lists([_sketch(x) for x in found])})


def resembling(found: DataFrame) -> DataFrame:
    """fp of the distinct sets that share enough of their least hashes with any others. found: fp, n, shown."""
    shown = found.where("n > 0").select("fp", (F.floor(4 * F.col("n") / 250) + 1).alias("least"), F.explode("shown").alias("tok"))
    shared = cut(shown.groupBy("tok").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("tok"), "shared")
    enough = shown.join(shared, "tok", "left_semi").distinct().groupBy("fp", "least").agg(F.count("*").alias("k")).where("k >= least").select("fp")
    out = cut(enough, "resembling")
    drop(shared)
    return out


def _compared(pairs: DataFrame, found: DataFrame, cuts: Cuts, diff: bool = False) -> DataFrame:
    """pairs (a, b) with is_near and, if asked for, diff, what only one of them has; a set named by many pairs is dealt out with them."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = pairs.select("a", "salt").distinct().join(found.select(F.col("fp").alias("a"), F.col("toks").alias("x")), "a")
    both = pairs.join(found.select(F.col("fp").alias("b"), F.col("toks").alias("y")), "b").join(left, ["a", "salt"])
    one = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"), *([F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("diff")] if diff else []))
    # in whole numbers: i / (s - i) >= 4 / 5
    return cuts(one.select("a", "b", (9 * F.col("i") >= 4 * F.col("s")).alias("is_near"), *(["diff"] if diff else [])), "compared")


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) of found (fp, toks) that have a similarity of 0.8 or more (a cut); pairs of which one isn't there go."""
    cuts = Cuts()
    out = cut(_compared(pairs.distinct(), found, cuts).where("is_near").select("a", "b"), "verified")
    drop(*cuts.made)
    return out


def _ordered(rows: DataFrame, group: list[str], keep: list[str], element: str, cuts: Cuts) -> DataFrame:
    """group, keep and order: of each row's elements those that others of the group have, too, rarest first."""
    held = cuts(rows.groupBy(*group, element).agg(F.count("*").alias("df")).where("df > 1"), "held")
    return rows.join(held, [*group, element]).groupBy(*group, *keep).agg(F.sort_array(F.collect_list(F.struct("df", F.col(element).alias("e")))).alias("order"))


def links(found: DataFrame, pairs_up_to: int = PAIRS_UP_TO, levels: int = LEVELS, groups: DataFrame | None = None) -> DataFrame:
    """a, b (a cut): links between distinct sets of similarity 0.8 or more, from found (fp, toks, sketch; fp distinct).

    All of them, or within a crowded key as many as keep the components.  groups (node, root): components of links that are
    known already; with them, those between different groups suffice.
    """
    cuts = Cuts()
    extra = found.select("fp", "sketch")
    if groups is None:
        extra = extra.withColumn("group", F.col("fp"))
    else:
        extra = extra.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "sketch", F.coalesce("root", "fp").alias("group"))
    extra = cuts(extra, "sketches")
    found = found.withColumn("n", F.size("toks"))
    order = _ordered(found.select("fp", "n", F.explode("toks").alias("tok")), [], ["fp", "n"], "tok", cuts)
    # shingles that no other set holds come first and take places of the prefix
    left = F.floor(F.col("n") / 5) + 1 - (F.col("n") - F.size("order"))
    # i >= 4 / 9 (n + o) members are shared with a near set of o, and at most those that others hold
    largest = (F.floor(9 * F.size("order") / 4) - F.col("n")).cast("int")
    shared = cuts(order.select("fp", "n", largest.alias("largest"), F.lit(0).alias("far"), F.explode(F.slice("order", F.lit(1), F.greatest(left, F.lit(0)).cast("int"))).alias("o")).select("fp", "n", "largest", "far", F.col("o.e").alias("key")), "keys")
    alike = (5 * F.least("n", "o") >= 4 * F.greatest("n", "o")) & (F.col("n") <= F.col("o_largest")) & (F.col("o") <= F.col("largest"))
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("o_sketch")[i])) for i in range(SKETCH // 64)])
    alike &= (F.col("group") != F.col("o_group")) & (9 * apart <= F.col("n") + F.col("o"))
    pairs = stars = None
    for level in range(levels + 1):
        # far has a bit for each level: of a pair that is still looked for, one at least is far from the leader of each
        own = F.struct((F.col("n") - F.col("largest")).alias("own"), "fp", "n")
        count = cuts(shared.groupBy("key").agg(F.count("*").alias("m"), F.min(own).alias("l"), F.min("n").alias("smallest"), F.bit_or("far").alias("all")).where(f"m > 1 and all = {(1 << level) - 1}").select("key", "m", "smallest", F.col("l.fp").alias("leader"), F.col("l.n").alias("ln")), "key-counts")
        # a set that is too much its own for even the smallest of the key has no partner there
        met = cuts(shared.join(count, "key").where("largest >= smallest"), "shared-keys")
        drop(shared, count)
        few = met if level == levels else met.where(F.col("m") <= pairs_up_to)
        few = cuts(few.join(extra, "fp"), "few")
        other = few.select("key", F.col("fp").alias("b"), F.col("n").alias("o"), F.col("largest").alias("o_largest"), F.col("far").alias("o_far"), F.col("sketch").alias("o_sketch"), F.col("group").alias("o_group"))
        new = few.join(other, "key").where(F.col("fp") < F.col("b")).where(alike).where(F.col("far").bitwiseOR(F.col("o_far")) == (1 << level) - 1).select(F.col("fp").alias("a"), "b")
        new = cuts(new.distinct(), "candidates")
        drop(few)
        pairs = new if pairs is None else pairs.union(new)
        crowd = met.where((F.col("m") > pairs_up_to) & (F.col("fp") != F.col("leader"))).groupBy("leader", "fp", "n", "largest", "far", "ln").agg(F.lit(1)) if level < levels else met.where("false")
        crowd = cuts(crowd.select("leader", "fp", "n", "largest", "far", "ln"), "crowds")
        if crowd.isEmpty():
            break
        star = _compared(crowd.select(F.col("leader").alias("a"), F.col("fp").alias("b")).distinct(), found, cuts, diff=True)
        stars = star.select("a", "b", "is_near") if stars is None else stars.union(star.select("a", "b", "is_near"))
        rest = crowd.join(star.select(F.col("a").alias("leader"), F.col("b").alias("fp"), "is_near", "diff"), ["leader", "fp"])
        rest = rest.withColumn("far", F.col("far").bitwiseOR(F.when(F.col("is_near"), 0).otherwise(1 << level))).withColumn("size", F.size("diff"))
        mine = ["fp", "n", "largest", "far", "ln", "is_near", "size"]
        order = _ordered(rest.select("leader", *mine, F.explode("diff").alias("tok")), ["leader"], mine, "tok", cuts)
        as_near = F.col("size") - F.floor((F.col("size") + (F.col("ln") - F.col("n")) / 9) / 2)
        as_far = F.col("size") - F.greatest(F.lit(1), F.ceil(F.col("size") - F.col("n") / 4)) + 1
        left = F.when(F.col("is_near"), as_near).otherwise(F.greatest(as_near, as_far)) - (F.col("size") - F.size("order"))
        keyed = order.select("leader", "fp", "n", "largest", "far", F.explode(F.slice("order", F.lit(1), F.greatest(left, F.lit(0)).cast("int"))).alias("o"))
        shared = cuts(keyed.select("fp", "n", "largest", "far", F.xxhash64("leader", "o.e").alias("key")), "keys")
    near = _compared(pairs.distinct(), found, cuts)
    out = cut((near if stars is None else near.union(stars)).where("is_near").select("a", "b").distinct(), "links")
    drop(*cuts.made)
    return out
