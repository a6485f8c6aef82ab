"""Operator 10 [native]: secret scans weighed by corpus-wide ownership frequency.

Base patterns give spans that always count.  Other long tokens that mix letters and digits are only candidates:
the values of all candidates, as hashes, are counted over distinct repositories (documents) and owners (sources).
A value that several owners hold, or more than a handful of repositories of one, is a copied example; one that a
single owner holds in few places looks live, and its tokens are added as spans of kind `owned`.  Texts are read once and never shuffled; only spans and hashes move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, cut, load, with_rows

#: Patterns (fixed values): name, pattern, group of the value, least length of that group.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
]
CANDIDATE = r"([A-Za-z0-9_-]{20,})"
#: Candidate tokens hold a digit and a letter at least.
MIXED = r"(?<![A-Za-z0-9_-])" + CANDIDATE.replace("(", r"((?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])", 1)
#: A value of more owners, or of more repositories, is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 1, 5
#: Matches of a text whose places are summed up at once.
RUN = 256
SPAN = "array<struct<start:int,stop:int,kind:int,value:bigint>>"


def _found(text: Column, pattern: str, group: int) -> Column:
    """(gap, size, value) of each match, leftmost and not overlapping: the pieces between, from split(), tell where it starts."""
    p = F.lit(pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda v: F.struct(F.xxhash64(v).alias("hash"), F.length(v).alias("length"))).alias("value"),
    )
    return F.when(F.regexp_instr(text, p) > 0, found)


def _spans(found: str, least: int, kind: int) -> tuple[Column, Callable[[str], Column]]:
    """(spans with places from the start of their run of RUN matches, what makes of those, as a column, spans with places in the text).

    In two steps, each a column of its own: a sum over all matches at once would copy all that is found for each of them.
    """
    none = F.array().cast(SPAN)
    cell = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("stop"), F.lit(kind).alias("kind"), x["value"]["hash"].alias("value"))
    step = lambda acc, x: F.when(x["size"].isNull(), acc).otherwise(F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.when(x["value"]["length"] < least, acc["out"]).otherwise(F.concat(acc["out"], F.array(cell(acc["at"], x)))).alias("out")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(F.col(found), i * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), none.alias("out")), step))

    def placed(column: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(column, start, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        moved = F.zip_with(column, bases, lambda r, base: F.transform(r["out"], lambda x: F.struct((x["start"] + base).alias("start"), (x["stop"] + base).alias("stop"), x["kind"].alias("kind"), x["value"].alias("value"))))
        return F.when(F.col(column).isNull(), none).otherwise(F.flatten(moved))

    return F.when(F.col(found).isNotNull(), runs), placed


def scan(rows: DataFrame) -> DataFrame:
    """fid, rix, doc_id, owner, base (spans in order), extra (candidates outside the base spans). Map only."""
    keep, text = [*ROW, "doc_id", "owner"], F.col("text")
    kinds = [*BASE, ("extra", MIXED, 1, 20)]
    found = rows.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    found = found.select(*keep, *[(F.when(text.contains("AKIA"), _found(text, p, g)) if name == "access" else _found(text, p, g)).alias(name) for name, p, g, _ in kinds])
    steps = {name: _spans(name, least, i) for i, (name, _, _, least) in enumerate(kinds)}
    found = found.select(*keep, *[runs.alias(name) for name, (runs, _) in steps.items()])
    found = found.select(*keep, *[placed(name).alias(name) for name, (_, placed) in steps.items()])
    found = found.select(*keep, F.array_sort(F.concat(*[F.col(name) for name, *_ in BASE])).alias("base"), "extra")
    apart = F.filter("extra", lambda x: ~F.exists("base", lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])))
    return found.select(*keep, "base", F.when((F.size("extra") > 0) & (F.size("base") > 0), apart).otherwise(F.col("extra")).alias("extra"))


def owned_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """fid, rix, doc_id, base, added (spans of owner-specific candidates), n_copied, n_owned (base spans by frequency).

    Null text is empty; a null owner is one owner of its own; repeated rows are further repositories of their owner;
    an empty table gives an empty one; other columns aren't read.  Values are counted per owner first, within each task,
    so that a value found in most rows costs one row a task; the counts are cut before they are joined back, so that
    the spans of such a value may be split over tasks.
    """
    rows = cut(scan(with_rows(docs, doc_id=id_col, text=text_col, owner=owner_col)), "secrets")
    each = rows.where("size(base) + size(extra) > 0").select(*ROW, "owner", F.explode(F.concat("base", "extra")).alias("s")).select(*ROW, "owner", "s.*")
    values = rows.select("owner", F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda s: s["value"]))).alias("value"))
    frequency = cut(values.groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories")), "frequency")
    judged = each.join(frequency, "value").withColumn("owned", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    is_base = F.col("kind") < len(BASE)
    added = judged.groupBy(*ROW).agg(
        F.array_sort(F.collect_list(F.when(~is_base & F.col("owned"), F.struct("start", "stop", "kind", "value")))).alias("added"),
        F.count_if(is_base & F.col("owned")).alias("n_owned"),
        F.count_if(is_base & ~F.col("owned")).alias("n_copied"),
    )
    out = rows.select(*ROW, "doc_id", "base").join(added, ROW, "left")
    return out.select(*ROW, "doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"), F.coalesce("n_owned", F.lit(0)).alias("n_owned"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def _line(found: Column) -> Column:
    names = F.array(*[F.lit(n) for n, *_ in BASE], F.lit("owned"))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def _by_start(found: Column) -> Column:
    """By start, then by kind."""
    key = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return F.array_sort(key)


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the owner-specific candidates of the whole corpus."""
    found = owned_secrets(load(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)],
        F.sha2(_line(_by_start(F.col("base"))), 256).alias("base_sha256"),
        _line(_by_start(F.concat("base", "added"))).alias("spans"),
        "n_owned",
        "n_copied",
    )


_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
_SQL_PATTERNS = [f"({_CASE})" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", BASE[1][1], BASE[2][1], CANDIDATE]

OP10_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), p(kind, name, pattern, grp, least) AS (
  VALUES (0, 'assign', '{_SQL_PATTERNS[0]}', 2, 6), (1, 'access', '{_SQL_PATTERNS[1]}', 1, 20),
         (2, 'hex', '{_SQL_PATTERNS[2]}', 1, 24), (3, 'owned', '{_SQL_PATTERNS[3]}', 1, 20)
), m AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT rid, {k} AS kind, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {2 if k == 0 else 1}) AS vals FROM d"
    for k, p in enumerate(_SQL_PATTERNS)
) + """
), each AS (
  SELECT rid, kind, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, vals FROM m WHERE len(hits) > 0
), placed AS (
  SELECT rid, kind, vals[i] AS val, length(hits[i]) AS size,
         list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0) AS a
  FROM each
), good AS (
  SELECT rid, kind, val, a::BIGINT AS a, (a + size)::BIGINT AS b FROM placed JOIN p USING (kind)
  WHERE length(val) >= least AND (kind < 3 OR regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]'))
), s AS (
  SELECT * FROM good g WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM good h WHERE h.rid = g.rid AND h.kind < 3 AND g.a < h.b AND h.a < g.b)
), freq AS (
  SELECT val, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT rid) AS repositories FROM s JOIN d USING (rid) GROUP BY val
), j AS (
  SELECT s.*, owners <= 1 AND repositories <= 5 AS owned, name || ':' || a || ':' || b AS span FROM s JOIN freq USING (val) JOIN p USING (kind)
), r AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
         string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3 OR owned) AS spans,
         count(*) FILTER (kind < 3 AND owned) AS n_owned, count(*) FILTER (kind < 3 AND NOT owned) AS n_copied
  FROM j GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN r USING (rid)
"""
