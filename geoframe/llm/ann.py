"""Operator 4: approximate nearest neighbours by largest inner product, on a graph made by NN-descent.

Equal vectors are one node.  Inner products become neighbourhoods by one more component, sqrt(M^2 - |x|^2) with M the
largest norm, which makes all vectors equally long.  The graph starts from the nearest neighbours within random
buckets; then, round by round, every node introduces its neighbours (and those it is a neighbour of) to each
other, by Spark joins.  Queries walk the graph greedily: the best nodes found that haven't been expanded are looked
up, their neighbours are scored where their vectors lie, and what beats the worst of the query's pool joins it; a query
ends when all of its pool is expanded.

Nodes are dealt to parts, bounded by the bytes that a part may need at once.  What passes between parts are messages of
packed arrays, one row for each pair of parts that have something to tell each other, joined by part; a vector is
sent once to each part that needs it, as 16-bit floats, and only for nodes that have new neighbours to introduce.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, load, pick, ship
from .numeric import mix, spread

TOP, DEGREE, POOL, EXPAND = 20, 32, 256, 64
#: Nodes of a part at most, bytes of vectors that it may need of others in a round at most, parts at least.
PART, NEEDED, PARTS = 4096, 64 << 20, 8
#: Queries of a part at most, rows of a bucket, rounds at most, share of new edges that ends.
QUERIES, BUCKET, ROUNDS, SETTLED = 1024, 256, 12, 0.02
#: Sets of random planes that the graph starts from.
TREES = 3
#: A message: the part that it goes to, the one that it comes from (or a count), what it is, and packed arrays.
MESSAGE = "p int, frm long, kind string, a binary, b binary, c binary, d binary"
NAMES = ["p", "frm", "kind", "a", "b", "c", "d"]


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array of doubles) of the vectors that take part: no null, no zero vector, all components finite."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return pick(df, id=id_col, vec=vec_col).where("id is not null").withColumn("vec", v.cast("array<double>")).where(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))


def nodes(vectors: DataFrame, keep: int) -> DataFrame:
    """node (least id of equal vectors), ids (the `keep` least), vec. Each task sends at most `keep` ids of a vector."""
    from pyspark.sql import Window

    ranked = vectors.withColumn("key", F.xxhash64("vec")).withColumn("r", F.row_number().over(Window.partitionBy("key", "vec").orderBy("id"))).where(F.col("r") <= keep)
    return ranked.groupBy("key", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "vec")


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of each node."""
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _messages(rows: list[tuple]) -> pd.DataFrame:
    """Rows of (part, from, kind, arrays...)."""
    return pd.DataFrame([(int(p), int(frm), kind, *(x.tobytes() for x in arrays), *[b""] * (4 - len(arrays))) for p, frm, kind, *arrays in rows], columns=NAMES)


def _dealt(parts: np.ndarray, frm: int, kind: str, *arrays: np.ndarray) -> list[tuple]:
    """A message for each part that occurs, with what of the arrays is meant for it."""
    o = np.argsort(parts, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(parts[o]) != 0])) if len(o) else np.zeros(0, np.int64)
    return [(parts[o[i]], frm, kind, *(x[o[i:j]] for x in arrays)) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(o)])]


def _joined(rows: pd.DataFrame, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column]), kind)


def _together(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """Messages of f(rows of a, rows of b) for each part."""
    return a.groupBy("p").cogroup(b.groupBy("p")).applyInPandas(f, MESSAGE)


def best(u: np.ndarray, w: np.ndarray, s: np.ndarray, flag: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest s of each u, each w once (that of the larger flag), by u and falling s."""
    o = np.lexsort((-flag, w, u))
    first = np.ones(len(o), bool)
    first[1:] = (u[o][1:] != u[o][:-1]) | (w[o][1:] != w[o][:-1])
    o = o[first]
    o = o[np.lexsort((w[o], -s[o], u[o]))]
    return o[_rank(u[o]) < k]


def _rank(u: np.ndarray) -> np.ndarray:
    """Place of each row among those of its u, of which equals stand together."""
    start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    return np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))


class Graph:
    """The neighbours of the nodes of a part: u sorted, w, s and old by node and place; s of minus infinity is no edge."""

    def __init__(self, rows: pd.DataFrame, k: int):
        rows = rows[rows["kind"] == "graph"]
        self.u = _joined(rows, "a", np.int64)
        self.w, self.s, self.old = (_joined(rows, c, t).reshape(-1, k) for c, t in (("b", np.int64), ("c", np.float32), ("d", np.uint8)))

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of u, w, s, old) of all edges."""
        i, j = np.nonzero(self.s > -np.inf)
        return i, self.w[i, j], self.s[i, j], self.old[i, j]


class Vectors:
    """The vectors of the nodes of a part, ids sorted."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows[rows["kind"] == "vectors"]
        ids = _joined(rows, "a", np.int64)
        o = np.argsort(ids)
        self.ids, self.x = ids[o], _joined(rows, "b", np.float16).reshape(len(ids), -1)[o] if len(ids) else np.zeros((0, 1), np.float16)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.x[np.searchsorted(self.ids, ids)]


def pack(base: DataFrame, largest: float, parts: int) -> DataFrame:
    """Messages with the vectors of each part, scaled by the largest norm and made equally long."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, np.float64) for v in b["vec"]]) / largest
        more = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
        ids = b["node"].to_numpy(np.int64)
        return _messages([(b["p"].iloc[0], 0, "vectors", ids, np.column_stack([x, more]).astype(np.float16))])

    def deal(batches):
        for b in batches:
            yield b.assign(p=part_of(b["node"].to_numpy(np.int64), parts).astype(np.int32))

    return base.select("node", "vec").mapInPandas(deal, "node long, vec array<double>, p int").groupBy("p").applyInPandas(run, MESSAGE)


def start_edges(packed: DataFrame, n: int, k: int, parts: int) -> DataFrame:
    """Messages with the nearest neighbours within buckets of about BUCKET nodes on the same side of random planes."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))

    def side(batches):
        for b in batches:
            for i in range(len(b)):
                v = Vectors(b.iloc[i : i + 1])
                x = v.x.astype(np.float32)
                for t in range(TREES):  # neighbours in different buckets of different trees tie the buckets together
                    plane = np.random.default_rng(11 + t).standard_normal((x.shape[1], max(bits, 1))).astype(np.float32)
                    code = ((x @ plane)[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    yield pd.DataFrame({"bucket": code * TREES + t, "node": v.ids, "vec": [r.tobytes() for r in v.x]})

    def near(b: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.frombuffer(b"".join(b["vec"]), np.float16).reshape(len(b), -1).astype(np.float32), b["node"].to_numpy()
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        m = min(k, len(ids) - 1)
        if m < 1:
            return _messages([])
        at = np.argpartition(-s, m - 1, axis=1)[:, :m]
        u = np.repeat(ids, m)
        return _messages(_dealt(part_of(u, parts), 0, "edges", u, ids[at].ravel(), np.take_along_axis(s, at, 1).ravel()))

    coded = cut(packed.mapInPandas(side, "bucket long, node long, vec binary"), "ann-buckets")
    crowd = coded.groupBy("bucket").agg(F.ceil(F.count("*") / (2 * BUCKET)).alias("split"))
    dealt = coded.join(crowd, "bucket").withColumn("deal", F.pmod(F.xxhash64("node"), F.col("split")))
    return dealt.groupBy("bucket", "deal").applyInPandas(near, MESSAGE)


def merge(held: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Messages with the k best edges of each node, of those held (graph, or vectors for a start) and those found; frm counts the new."""

    def run(have: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(have):
            return _messages([])
        if (have["kind"] == "graph").any():
            g = Graph(have, k)
            nodes_, i, w, s, old = g.u, *g.edges()
        else:
            nodes_ = Vectors(have).ids
            i, w, s, old = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.uint8)
        i = np.concatenate([i, np.searchsorted(nodes_, _joined(got, "a", np.int64))])
        w, s = np.concatenate([w, _joined(got, "b", np.int64)]), np.concatenate([s, _joined(got, "c", np.float32)])
        fresh = np.arange(len(i)) >= len(old)
        o = best(i, w, s, (~fresh).astype(int), k)
        place = _rank(i[o])
        out_w, out_s, out_old = np.zeros((len(nodes_), k), np.int64), np.full((len(nodes_), k), -np.inf, np.float32), np.ones((len(nodes_), k), np.uint8)
        out_w[i[o], place], out_s[i[o], place], out_old[i[o], place] = w[o], s[o], ~fresh[o]
        return _messages([(have["p"].iloc[0], int(fresh[o].sum()), "graph", nodes_, out_w, out_s, out_old)])

    return cut(_together(held, found, run), "ann-graph")


def reversed_edges(graph: DataFrame, k: int, parts: int) -> DataFrame:
    """Messages with edges by the node that they lead to, of each sender the k best a node."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                g = Graph(b.iloc[i : i + 1], k)
                at, w, s, old = g.edges()
                o = best(w, g.u[at], s, old, k)
                yield _messages(_dealt(part_of(w[o], parts), 0, "reversed", w[o], g.u[at[o]], s[o], old[o]))

    return graph.mapInPandas(run, MESSAGE)


def _around(own: pd.DataFrame, back: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, place of a node, one of its neighbours or of the k best nodes that it is a neighbour of, whether that is old), by place."""
    g = Graph(own, k)
    i, w, _, old = g.edges()
    a, b, s, f = (_joined(back, c, t) for c, t in (("a", np.int64), ("b", np.int64), ("c", np.float32), ("d", np.uint8)))
    o = best(a, b, s, f, k)
    i, w, old = np.concatenate([i, np.searchsorted(g.u, a[o])]), np.concatenate([w, b[o]]), np.concatenate([old, f[o]])
    o = np.lexsort((old, w, i))
    first = np.ones(len(o), bool)
    first[1:] = (i[o][1:] != i[o][:-1]) | (w[o][1:] != w[o][:-1])
    o = o[first]
    return g.u, i[o], w[o], old[o]


def introduce(graph: DataFrame, packed: DataFrame, k: int, parts: int) -> DataFrame:
    """One round of NN-descent: the graph after every node has introduced its neighbours to each other."""

    def members(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return _messages([])
        p = own["p"].iloc[0]
        u, i, w, old = _around(own, back, k)
        new = np.zeros(len(u), bool)
        new[i[old == 0]] = True
        keep = new[i]
        i, w, old = i[keep], w[keep], old[keep]
        needed = np.unique(w)
        return _messages([(p, p, "members", i, w, old), *_dealt(part_of(needed, parts), p, "ask", needed)])

    def reply(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return _messages([])
        v, g = Vectors(own), Graph(own, k)
        worst = g.s.min(1)
        out = []
        for frm, raw in zip(asked["frm"], asked["a"]):
            ids = np.frombuffer(raw, np.int64)
            out.append((frm, 0, "reply", ids, v.of(ids), worst[np.searchsorted(g.u, ids)]))
        return _messages(out)

    def meet(mine: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(sent):
            return _messages([])
        ids = _joined(sent, "a", np.int64)
        o = np.argsort(ids)
        ids, x, worst = ids[o], _joined(sent, "b", np.float16).reshape(len(o), -1)[o].astype(np.float32), _joined(sent, "c", np.float32)[o]
        c, at, old = _joined(mine, "a", np.int64), np.searchsorted(ids, _joined(mine, "b", np.int64)), _joined(mine, "c", np.uint8) > 0
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(first, len(c)))
        out: list = []
        for lo in range(0, len(first), 128):
            f, n = first[lo : lo + 128], size[lo : lo + 128]
            width = np.arange(int(n.max()))
            slot, real = f[:, None] + np.minimum(width, n[:, None] - 1), width < n[:, None]
            who, new = at[slot], ~old[slot] & real
            v = x[who]
            s = v @ v.transpose(0, 2, 1)
            good = (new[:, :, None] | new[:, None, :]) & real[:, :, None] & real[:, None, :] & (s > worst[who][:, :, None]) & (who[:, :, None] != who[:, None, :])
            i, a, b = np.nonzero(good)
            out.append((who[i, a], who[i, b], s[i, a, b]))
            if sum(len(t[0]) for t in out) > 2_000_000:
                out = [_least(out, k)]
        u, w, s = _least(out, k)
        return _messages(_dealt(part_of(ids[u], parts), 0, "edges", ids[u], ids[w], s))

    told = cut(_together(graph, reversed_edges(graph, k, parts), members), "ann-members")
    replies = _together(packed.union(graph), told.where("kind = 'ask'"), reply)
    out = merge(graph, _together(told.where("kind = 'members'"), replies, meet), k)
    drop(told)
    return out


def _least(out: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, w, s = (np.concatenate([t[i] for t in out]) for i in range(3))
    o = best(u, w, s, np.zeros(len(u)), k)
    return u[o], w[o], s[o]


def build(packed: DataFrame, n: int, parts: int, k: int = DEGREE) -> DataFrame:
    """The neighbour graph over n nodes; rounds end when few edges are new, after ROUNDS at the latest."""
    graph = merge(packed, start_edges(packed, n, k, parts), k)
    for _ in range(ROUNDS):
        before, graph = graph, introduce(graph, packed, k, parts)
        drop(before)
        if graph.agg(F.sum("frm")).first()[0] <= SETTLED * n * k:
            break
    return graph


class Pool:
    """Queries of a part: q, their vectors, and ids, s and done of their pools; s of minus infinity is an empty place."""

    def __init__(self, rows: pd.DataFrame, size: int):
        rows = rows[rows["kind"] == "pool"]
        self.q = _joined(rows, "a", np.int64)
        n = len(self.q)
        self.x = _joined(rows, "b", np.float16).reshape(n, -1) if n else np.zeros((0, 1), np.float16)
        self.ids = _joined(rows, "c", np.int64).reshape(n, size)
        last = _joined(rows, "d", np.float32).reshape(2, n, size) if n else np.zeros((2, 0, size), np.float32)
        self.s, self.done = last[0], last[1] > 0

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of the EXPAND best of each pool that haven't been expanded."""
        i, j = np.nonzero((self.s > -np.inf) & ~self.done)
        o = np.lexsort((self.ids[i, j], -self.s[i, j], i))
        o = o[_rank(i[o]) < EXPAND]
        return i[o], j[o]

    def message(self, p: int) -> pd.DataFrame:
        open_ = int(((self.s > -np.inf) & ~self.done).sum())
        return _messages([(p, open_, "pool", self.q, self.x, self.ids, np.stack([self.s, self.done]).astype(np.float32))])


def search(graph: DataFrame, packed: DataFrame, queries: DataFrame, parts: int, *, k: int = DEGREE, pool_size: int = POOL) -> DataFrame:
    """q, id: each query's pool. queries: q, a node that is searched for."""
    few = max(PARTS, math.ceil(queries.count() / QUERIES))
    near = cut(_together(graph, reversed_edges(graph, k, parts), lambda own, back: _neighbours(own, back, k)), "ann-near")

    def begin(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return _messages([])
        q = np.sort(_joined(asked, "a", np.int64))
        return _messages([(p, 0, "start", ids, x) for p, _, _, ids, x in _dealt(part_of(q, few), 0, "", q, Vectors(own).of(q))])

    def deal(batches):
        for b in batches:
            q = b["q"].to_numpy(np.int64)
            yield _messages(_dealt(part_of(q, parts), 0, "ask", q))

    def pooled(b: pd.DataFrame) -> pd.DataFrame:
        q = _joined(b, "a", np.int64)
        ids, s = np.zeros((len(q), pool_size), np.int64), np.full((len(q), pool_size), -np.inf, np.float32)
        ids[:, 0], s[:, 0] = q, 2.0  # the query itself, above all others
        return _messages([(b["p"].iloc[0], len(q), "pool", q, _joined(b, "b", np.float16).reshape(len(q), -1), ids, np.stack([s, np.zeros_like(s)]))])

    pool = cut(_together(packed, queries.mapInPandas(deal, MESSAGE), begin).groupBy("p").applyInPandas(pooled, MESSAGE), "ann-pool")

    def choose(batches):
        for b in batches:
            for r in range(len(b)):
                x = Pool(b.iloc[r : r + 1], pool_size)
                i, j = x.chosen()
                nodes_ = x.ids[i, j]
                yield _messages(_dealt(part_of(nodes_, parts), b["p"].iloc[r], "look", i, nodes_))

    def look(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return _messages([])
        u, w, first = (_joined(own, c, np.int64) for c in "abc")
        out = []
        for frm, i, ids in zip(asked["frm"], asked["a"], asked["b"]):
            at = np.searchsorted(u, np.frombuffer(ids, np.int64))
            n = first[at + 1] - first[at]
            got = w[spread(first[at], n)]
            i = np.repeat(np.frombuffer(i, np.int64), n)
            o = np.lexsort((got, i))
            o = o[np.concatenate([[True], (np.diff(i[o]) != 0) | (np.diff(got[o]) != 0)])] if len(o) else o
            out.append((frm, 0, "found", i[o], got[o]))
        return _messages(out)

    def screen(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """What isn't in the pools goes, with the queries' vectors and worst, to where it can be scored."""
        if not len(own) or not len(found):
            return _messages([])
        p, x = own["p"].iloc[0], Pool(own, pool_size)
        i, ids = _joined(found, "a", np.int64), _joined(found, "b", np.int64)
        row, place = np.nonzero(x.s > -np.inf)
        flag = np.concatenate([np.ones(len(row)), np.zeros(len(i))])
        i, ids = np.concatenate([row, i]), np.concatenate([x.ids[row, place], ids])
        o = np.lexsort((-flag, ids, i))
        first = np.ones(len(o), bool)
        first[1:] = (np.diff(i[o]) != 0) | (np.diff(ids[o]) != 0)
        o = o[first & (flag[o] == 0)]
        worst = x.s.min(1)
        out = []
        for to, _, _, i, ids in _dealt(part_of(ids[o], parts), p, "", i[o], ids[o]):
            q, at = np.unique(i, return_inverse=True)
            out.append((to, p, "score", np.concatenate([q, at]), ids, x.x[q], worst[q]))
        return _messages(out)

    def score(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return _messages([])
        v, out = Vectors(own), []
        for frm, qs, ids, x, worst in zip(asked["frm"], asked["a"], asked["b"], asked["c"], asked["d"]):
            ids, worst = np.frombuffer(ids, np.int64), np.frombuffer(worst, np.float32)
            q, at = np.split(np.frombuffer(qs, np.int64), [len(worst)])
            x = np.frombuffer(x, np.float16).reshape(len(q), -1).astype(np.float32)
            x[:, -1] = 0
            s = np.concatenate([np.zeros(0, np.float32), *(np.einsum("ij,ij->i", x[at[a : a + 65536]], v.of(ids[a : a + 65536]).astype(np.float32)) for a in range(0, len(ids), 65536))])
            good = s > worst[at]
            out.append((frm, 0, "scored", q[at[good]], ids[good], s[good]))
        return _messages(out)

    def top(own: pd.DataFrame, scored: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return _messages([])
        x = Pool(own, pool_size)
        done = x.done.copy()
        done[x.chosen()] = True
        row, place = np.nonzero(x.s > -np.inf)
        i = np.concatenate([row, _joined(scored, "a", np.int64)])
        ids = np.concatenate([x.ids[row, place], _joined(scored, "b", np.int64)])
        s = np.concatenate([x.s[row, place], _joined(scored, "c", np.float32)])
        flag = np.concatenate([done[row, place], np.zeros(len(i) - len(row))])
        o = best(i, ids, s, flag, pool_size)
        at = _rank(i[o])
        x.ids, x.s, x.done = np.zeros_like(x.ids), np.full_like(x.s, -np.inf), np.zeros_like(done)
        x.ids[i[o], at], x.s[i[o], at], x.done[i[o], at] = ids[o], s[o], flag[o]
        return x.message(own["p"].iloc[0])

    while pool.agg(F.sum("frm")).first()[0]:
        found = _together(near, pool.mapInPandas(choose, MESSAGE), look)
        scored = _together(packed, _together(pool, found, screen), score)
        before, pool = pool, cut(_together(pool, scored, top), "ann-pool")
        drop(before)

    def pairs(batches):
        for b in batches:
            for r in range(len(b)):
                x = Pool(b.iloc[r : r + 1], pool_size)
                i, j = np.nonzero(x.s > -np.inf)
                yield pd.DataFrame({"q": x.q[i], "id": x.ids[i, j]})

    return pool.mapInPandas(pairs, "q long, id long")


def _neighbours(own: pd.DataFrame, back: pd.DataFrame, k: int) -> pd.DataFrame:
    """Messages with nodes, all their neighbours either way, and where each node's begin."""
    if not len(own):
        return _messages([])
    u, i, w, _ = _around(own, back, k)
    return _messages([(own["p"].iloc[0], 0, "near", u, w, np.searchsorted(i, np.arange(len(u) + 1)))])


def dot(a: str, b: str):
    """Inner product in double precision, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", queries: str = "id % 20 = 0", top: int = TOP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `top` nearest found of every query, a row of the table itself.

    queries: SQL condition on id.  Null ids, and vectors that are null, empty, zero or hold null or non-finite components
    take no part; all others must be of one length.  A query's own id is no candidate, its equals are.  Ties go to the
    smaller id; of equal vectors the top + 1 least ids are kept, more can't be among the nearest.  Repeated rows (id and
    vector) count once.  Fewer rows than top give fewer; an empty table gives an empty one; other columns aren't read.
    """
    ship(vectors.sparkSession)
    rows = valid(vectors, id_col, vec_col).distinct()
    base = cut(nodes(rows, top + 1), "ann-nodes")
    norm = F.sqrt(dot("vec", "vec"))
    n, largest = base.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return base.select(F.col("node").alias("query_id"), F.lit(0).alias("rank"), F.col("node").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    dimension = base.select(F.size("vec")).first()[0]
    parts = max(PARTS, math.ceil(n / max(64, min(PART, NEEDED // (4 * DEGREE * (dimension + 1))))))
    packed = cut(pack(base, largest, parts), "ann-packed")
    of = rows.where(queries).select("id", "vec").join(base.select("node", F.col("vec").alias("nvec")), F.col("vec") == F.col("nvec")).select("id", "node")
    of = cut(of, "ann-queries")
    asked = of.select(F.col("node").alias("q")).distinct()
    if n == 1:
        pool = asked.select("q", F.col("q").alias("id"))
    else:
        pool = cut(search(build(packed, n, parts), packed, asked, parts), "ann-pairs")
    scored = (
        pool.join(base.select(F.col("node").alias("id"), "ids", F.col("vec").alias("x")), "id")
        .join(base.select(F.col("node").alias("q"), F.col("vec").alias("y")), "q")
        .select("q", dot("y", "x").alias("score"), "ids")
        .select("q", "score", F.explode("ids").alias("vec_id"))
    )
    from pyspark.sql import Window

    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    found = cut(scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top + 1).drop("r"), "ann-found")
    lists = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worse"), "vec_id"))).alias("f"))
    mine = of.join(lists, of["node"] == lists["q"]).select(F.col("id").alias("query_id"), F.slice(F.filter("f", lambda x: x["vec_id"] != F.col("id")), 1, top).alias("f"))
    return mine.select("query_id", F.posexplode("f").alias("r", "x")).select("query_id", (F.col("r") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.worse")).alias("score"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20."""
    return nearest(load(spark, sf_dir, "embeddings"))
