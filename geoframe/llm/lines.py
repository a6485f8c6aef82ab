"""Operator 7 [native]: line dedup by a deletion-neighbourhood join.

Two lines are near if one edit (a character put in, taken out or replaced) turns one into the other.  Then both
hold a common string with one character taken out of one or both of them.  Lines emit these variants as hashed keys
and equal keys are joined:

* two lines that lose a character at the same place and agree in the rest differ by a replacement; all lines
  under such a key are near to each other, so each is joined to the earliest of them only;
* a line that loses a character and then equals another line differs by an insertion; the other line is the one
  centre of that key.

So a group never becomes pairs.  Variants that can't match aren't emitted: one edit leaves all of a line but one
part as it was, so the part is bisected, and a half stays open only if another line shares the whole rest of the
line, by hash.  Variants are taken in open parts of at most OPEN + 1 characters.  The work on a line grows with its length times
its logarithm.  Matches are verified with levenshtein() on the lines themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, Cuts, cut, drop, load, scanned, with_rows

MIN_CHARS, OPEN = 16, 8
#: Lines that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
LINE = ["h1", "h2"]


def _order() -> Column:
    """Earlier documents first (null ids last); rows of one id by the hash of their text, then by place."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", *ROW, "pos")


def _lines(rows: DataFrame) -> DataFrame:
    """fid, rix, doc_id, th, pos, line, h1, h2 of every line that isn't blank."""
    out = rows.select(*ROW, "doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    out = out.select(*ROW, "doc_id", "th", "pos", F.trim("raw").alias("line")).where("line <> ''")
    return out.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _half_keys(line: Column) -> Column:
    """What _halves() gives for a whole line, hashes only and without lambdas, so that it stays in generated code."""
    n = F.length(line)

    def both(h: Column) -> list[Column]:
        return [F.xxhash64(F.lit(0), h, F.left(line, h)), F.xxhash64(F.lit(1), h, F.right(line, h))]

    one, two = F.shiftright(n, 1), F.shiftright(n - 1, 1)
    return F.when(n % 2 == 1, F.array(*both(one))).otherwise(F.array(*both(one), *both(two)))


def _halves(a: Column, c: Column) -> Column:
    """Open parts after a bisection of the part between the first a and the last c characters: (a, c, key).

    A line of one character more or less has its half elsewhere, so both places are taken.
    """
    line, m = F.col("line"), F.length("line") - a - c
    parts = []
    for h in (F.floor(m / 2).cast("int"), F.floor((m - 1) / 2).cast("int")):
        for x, y in ((a + h, c), (a, c + h)):
            parts.append(F.struct(x.alias("a"), y.alias("c"), F.xxhash64(x, y, F.left(line, x), F.right(line, y)).alias("key")))
    return F.array_distinct(F.array(*parts))


def _shared(parts: DataFrame) -> DataFrame:
    """key: rests that two different lines have."""
    return parts.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("key")


def _open_parts(texts: DataFrame, cuts: Cuts) -> DataFrame:
    """h1, h2, line, a, c, key: the parts of at most OPEN + 1 characters of each line outside which another line agrees."""
    zero = F.lit(0)
    parts, done = texts.select(*LINE, "line", zero.alias("a"), zero.alias("c"), F.lit(0).cast("long").alias("key")), []
    while not parts.isEmpty():
        halves = cuts(parts.select(*LINE, "line", F.explode(_halves(F.col("a"), F.col("c"))).alias("p")).select(*LINE, "line", "p.*").dropDuplicates([*LINE, "a", "c"]), "line-parts")
        now = cuts(halves.join(cuts(_shared(halves), "line-rests"), "key", "left_semi"), "line-parts")
        drop(halves)
        size = F.length("line") - F.col("a") - F.col("c")
        # a partner may be a character longer: at OPEN + 1 a part is both taken and bisected
        done.append(now.where(size <= OPEN + 1))
        parts = now.where(size > OPEN)
    return reduce(lambda x, y: x.unionByName(y), done) if done else parts


def _variants(parts: DataFrame) -> DataFrame:
    """h1, h2, key, at: at is the place of the character taken out, -1 for the whole line."""
    mid = F.substr(F.col("line"), F.col("a") + 1, F.length("line") - F.col("a") - F.col("c"))
    whole = F.array(F.struct(F.xxhash64("key", "mid").alias("key"), F.lit(-1).alias("at")))
    less = F.transform(F.sequence(F.lit(1), F.length("mid")), lambda i: F.struct(F.xxhash64(F.col("key"), F.concat(F.left(F.col("mid"), i - 1), F.substr(F.col("mid"), i + 1))).alias("key"), (F.col("a") + i).alias("at")))
    some = F.when(F.length("mid") > 0, less).otherwise(F.slice(whole, 1, 0))
    return parts.withColumn("mid", mid).select(*LINE, F.explode(F.concat(whole, some)).alias("v")).select(*LINE, "v.key", "v.at").distinct()


def _near(first: DataFrame, lines: DataFrame, min_chars: int, cuts: Cuts) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier line within one edit.

    first: h1, h2, ord (place of the first occurrence), keys (half keys, null for short lines); lines: every line.
    """
    halves = first.where("keys is not null").select(*LINE, F.explode("keys").alias("key"))
    # the small side is cut first: a join of two plain shuffles may be split where one half is very common
    some = cuts(halves.join(cuts(_shared(halves), "line-rests"), "key", "left_semi").select(*LINE).distinct(), "line-candidates")
    places = first.join(some, LINE, "left_semi").select(*LINE, "ord", *[F.col(f"ord.{c}").alias(c) for c in (*ROW, "pos")])
    places = cuts(places, "line-places")
    small = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    texts = cuts(lines.select(*ROW, "pos", "line").join(small, [*ROW, "pos"]).select(*LINE, "ord", "line"), "line-texts")
    v = cuts(_variants(_open_parts(texts.select(*LINE, "line"), cuts)), "line-variants")
    # one character replaced: every line under (key, at) with the earliest
    o = texts.select(*LINE, "ord")
    sub = v.where("at > 0")
    crowd = cuts(sub.groupBy("key", "at").agg(F.count("*").alias("c")).where("c > 1").select("key", "at"), "line-crowds")
    sub = cuts(sub.join(crowd, ["key", "at"]).join(o, LINE), "line-replaced")
    least = cuts(sub.groupBy("key", "at").agg(F.min(F.struct("ord", *LINE)).alias("m")).select("key", "at", F.col("m.h1").alias("g1"), F.col("m.h2").alias("g2")), "line-least")
    pairs = sub.join(least, ["key", "at"]).select("h1", "h2", "g1", "g2")
    # one character more: the longer lines with the line that is left
    centre = v.where("at = -1").select("key", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    longer = v.where("at > 0").join(centre, "key").select("h1", "h2", "g1", "g2")
    pairs = pairs.union(longer).where("h1 <> g1 or h2 <> g2").distinct()
    a, b = (texts.select(F.col("h1").alias(f"{p}1"), F.col("h2").alias(f"{p}2"), F.col("ord").alias(f"{p}_ord"), F.col("line").alias(f"{p}_line")) for p in "hg")
    checked = pairs.join(a, LINE).join(b, ["g1", "g2"]).where(F.levenshtein("h_line", "g_line", 1) == 1)
    later = F.col("h_ord") > F.col("g_ord")
    return checked.select(F.when(later, F.col("h1")).otherwise(F.col("g1")).alias("h1"), F.when(later, F.col("h2")).otherwise(F.col("g2")).alias("h2")).distinct()


def repeated_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """fid, rix, gone (places, from 0, of the lines that go), cut. rows: fid, rix, doc_id, text."""
    cuts = Cuts()
    lines = _lines(rows)
    keys = F.when(F.length("line") >= min_chars, _half_keys(F.col("line")))
    # the half keys of a short line stay null; equal lines have equal keys
    seen = cuts(lines.select(*ROW, "doc_id", "th", "pos", *LINE, keys.alias("keys")), "lines")
    first = cuts(seen.groupBy(*LINE).agg(F.min(_order()).alias("ord"), F.first("keys").alias("keys")), "first-lines")
    near = cuts(_near(first, lines, min_chars, cuts), "near-lines").withColumn("near", F.lit(True))
    of = first.select(*LINE, "ord").join(near, LINE, "left")
    gone = seen.join(of, LINE).where(F.col("near").isNotNull() | (F.col("ord.pos") != F.col("pos")) | reduce(lambda x, y: x | y, [F.col(f"ord.{c}") != F.col(c) for c in ROW]))
    out = cut(gone.groupBy(*ROW).agg(F.collect_list("pos").alias("gone")), "gone-lines")
    drop(*cuts.made)
    return out


def _kept(text: str, parts: str, gone: str) -> Column:
    """The text without the parts that go; parts is a column of its own, so that it isn't split again for each part."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.concat_ws("\n", F.transform(stay, lambda i: F.col(parts)[i])))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text (what stays), n_lines (not blank), n_removed for every row of docs.

    Lines are compared without blanks around them.  A line goes if an equal line comes earlier in the table, or, from
    min_chars characters, one within one edit; the earlier line counts even if it goes itself.  Earlier means a smaller
    doc_id (null ids last), then a smaller place in the text; rows of one id stand in the order of their texts' hashes,
    equal rows in file order.  Blank lines stay.  Null text gives null and no lines; an empty table gives an
    empty one; other columns aren't read.  Two shuffles of hashes and one of the texts.
    """
    rows = with_rows(docs, doc_id=id_col, text=text_col)
    gone = repeated_lines(rows, min_chars)
    # dealt out alike at every size: a list for most documents outgrows any broadcast; a partition's lists are held, its texts pass by
    out = rows.join(gone.hint("shuffle_hash"), ROW, "left").withColumn("parts", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    n_lines = F.size(F.filter("parts", lambda x: F.trim(x) != ""))
    return out.select("doc_id", _kept("text", "parts", "gone").alias("text"), n_lines.cast("long").alias("n_lines"), F.size(F.coalesce("gone", F.array().cast("array<int>"))).cast("long").alias("n_removed"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs, all columns, without the lines that dedup_lines() takes; chars_col, if there, is the new length."""
    docs = scanned(docs)
    gone = repeated_lines(with_rows(docs, doc_id=id_col, text=text_col), min_chars)
    gone = gone.select(F.col("fid").alias("_line_fid"), F.col("rix").alias("_line_rix"), F.col("gone").alias("_line_gone")).hint("shuffle_hash")
    at = docs.metadataColumn("_metadata")
    out = docs.join(gone, (F.xxhash64(at["file_path"]) == gone["_line_fid"]) & (at["row_index"] == gone["_line_rix"]), "left")
    own = [docs[f"`{c}`"] for c in docs.columns]
    out = out.select(*own, "_line_gone", F.when(F.col("_line_gone").isNotNull(), F.split(docs[f"`{text_col}`"], "\n", -1)).alias("_line_parts"))
    out = out.select(*own, "_line_gone", _kept(f"`{text_col}`", "_line_parts", "_line_gone").alias("_line_text"))
    new = {text_col: F.col("_line_text")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("_line_gone").isNull(), F.col(f"`{chars_col}`")).otherwise(F.length("_line_text").cast(docs.schema[chars_col].dataType))
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op7_line_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines removed from every document."""
    out = dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
         unnest(range(0, len(string_split(text, chr(10))))) AS pos
  FROM documents
), t AS (
  SELECT doc_id, pos, trim(raw, ' ') AS line, raw FROM l
), f AS (
  SELECT line, min((doc_id, pos)) AS ord, length(line) AS n FROM t WHERE line <> '' GROUP BY line
), halves AS (
  SELECT line, ord, n, unnest(list_distinct([
    'p' || (n // 2) || left(line, n // 2), 'p' || ((n - 1) // 2) || left(line, (n - 1) // 2),
    's' || (n // 2) || right(line, n // 2), 's' || ((n - 1) // 2) || right(line, (n - 1) // 2)])) AS key
  FROM f WHERE n >= 16
), near AS (
  SELECT DISTINCT a.line FROM halves a JOIN halves b
    ON a.key = b.key AND a.ord > b.ord AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) = 1
), g AS (
  SELECT t.doc_id, t.pos, t.raw, t.line,
         t.line <> '' AND ((t.doc_id, t.pos) <> f.ord OR near.line IS NOT NULL) AS gone
  FROM t LEFT JOIN f ON f.line = t.line LEFT JOIN near ON near.line = t.line
)
SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, coalesce(count(*) FILTER (gone), 0) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
