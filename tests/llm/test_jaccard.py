"""Near-duplicates of the pipeline's copies stage against a Jaccard brute force."""

import random
from itertools import combinations

import pytest
from geoframe.llm import jaccard
from geoframe.llm.common import cut


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y) > 0


def corpus():
    r = random.Random(3)
    prose = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passage, rows = prose(60), []
    for n in [3, 5, 6, 9, 14, 30, 60, 150, 400, 900]:
        base = prose(n)
        for k in range(7):
            t = list(base)
            for _ in range(k * n // 60 + (k > 3)):
                t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
            rows += [" ".join(t), " ".join(t + prose(k * n // 20)).upper()]
    rows += [" ".join(passage + prose(40)) for _ in range(45)]  # a common passage
    for _ in range(60):  # near copies of one text, near its leader or not
        t = list(passage) * 2 + ["end"]
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            t[r.randrange(len(t))] = f"y{r.randrange(10**6)}"
        rows.append(" ".join(t))
    rows += ["", None, " \n", "one", "One", "two words"]
    r.shuffle(rows)
    return list(enumerate(rows))


def kept(rows):
    s = {i: shingles(t) for i, t in rows}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(s, 2):
        if near(s[a], s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in s}


def test_copies_stage_finds_all_of_four_fifths(spark):
    import corpus_pipeline

    rows = corpus()
    d = cut(spark.createDataFrame(rows, "doc_id long, text string"), "in")
    assert {r["doc_id"] for r in corpus_pipeline.copies_stage(spark, d, "").collect()} == kept(rows)


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def same(one, two):
    return len(set(zip(one.values(), two.values()))) == len(set(one.values())) == len(set(two.values()))


@pytest.mark.parametrize("pairs_up_to, levels", [(1, 0), (1, 1), (1, 3), (8, 3), (1000, 3)])
def test_links(spark, pairs_up_to, levels):
    """All links, or as many as keep the components, whatever is expanded and however many leaders there are."""
    rows = corpus()
    d = cut(spark.createDataFrame(rows, "doc_id long, text string"), "in")
    prints = cut(jaccard.prints(d), "prints")
    text = {r["fp"]: shingles(dict(rows)[r["doc_id"]]) for r in prints.collect()}
    assert len(text) == len(set(text.values()))
    true = {tuple(sorted(x)) for x in combinations(text, 2) if near(text[x[0]], text[x[1]])}
    wanted = {r["fp"] for r in jaccard.resembling(prints).collect()}
    assert {x for pair in true for x in pair} <= wanted
    sets = cut(jaccard.sets(d.join(prints.select("doc_id", "fp"), "doc_id").dropDuplicates(["fp"]).select("fp", "text")), "sets")
    got = {tuple(sorted(x)) for x in jaccard.links(sets, pairs_up_to, levels).collect()}
    assert got <= true and same(reach(text, got), reach(text, true)) and (pairs_up_to < 1000 and levels or got == true)


def test_chains_of_near_texts(spark):
    """Clusters without a middle: each text near to the next ones only, some of them in a very large group."""
    r = random.Random(4)
    rows = []
    for _ in range(3):
        t = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(60):
            rows.append(" ".join(t))
            t[r.randrange(len(t))] = f"v{r.randrange(10**6)}"
    base = [f"u{i}" for i in range(100)]
    for _ in range(150):
        t = list(base)
        for _ in range(r.choice([1, 2, 2, 3, 3, 4])):
            t[r.choice([5, 20, 40, 60, 80, r.randrange(100)])] = r.choice(["a", "b", f"x{r.randrange(10**6)}"])
        rows.append(" ".join(t))
    rows = list(enumerate(rows))
    d = cut(spark.createDataFrame(rows, "doc_id long, text string"), "in")
    from geoframe.llm import simhash

    assert {x["doc_id"] for x in simhash.one_of_each(d).collect()} == kept(rows)


def test_groups_that_may_be_expanded_make_no_differences(spark, monkeypatch):
    """texts that share passages, but little else, are compared under their rare shingles; nothing grows level by level."""
    r = random.Random(5)
    parts = [[f"p{j}x{i}" for i in range(20)] for j in range(12)]
    rows = list(enumerate(" ".join(w for j in r.sample(range(12), 9) for w in parts[j]) for _ in range(120)))
    rows += [(1000 + i, t + " end") for i, t in rows[:10]]
    made, plain = [], jaccard.cut

    def counted(df, label):
        out = plain(df, label)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr("geoframe.llm.common.cut", counted)
    monkeypatch.setattr(jaccard, "cut", counted)
    d = cut(spark.createDataFrame(rows, "doc_id long, text string"), "in")
    from geoframe.llm import simhash

    assert {x["doc_id"] for x in simhash.one_of_each(d).collect()} == kept(rows)
    keys = [n for label, n in made if label == "keys"]
    assert sum(keys) <= 2 * sum(len(shingles(t)) for _, t in rows), keys


def test_golay_keys_find_copies_and_sets_are_checked(spark, monkeypatch):
    """the stage links by SimHash and Golay keys, checks these links exactly and looks elsewhere for the rest only."""
    from geoframe.llm import simhash

    r = random.Random(6)
    rows = []
    for i in range(12):
        t = [f"w{r.randrange(10**6)}" for _ in range(900)]
        rows += [(3 * i, " ".join(t)), (3 * i + 1, " ".join([*t, f"z{i}"])), (3 * i + 2, " ".join([*t[300:], f"v{i}"]))]
    d = cut(spark.createDataFrame(rows, "doc_id long, text string"), "in")
    assert {x["doc_id"] for x in simhash.one_of_each(d).collect()} == kept(rows) == {3 * i + k for i in range(12) for k in (0, 2)}
    # without the search for the rest
    monkeypatch.setattr(jaccard, "links", lambda found, **_: found.select(found["fp"].alias("a"), found["fp"].alias("b")).where("false"))
    left = {x["doc_id"] for x in simhash.one_of_each(d).collect()}
    assert {3 * i + k for i in range(12) for k in (0, 2)} <= left and len(left) < 36
    # equal SimHashes alone are no link
    sets = spark.createDataFrame([(1, 7, [1, 2, 3, 4, 5]), (2, 7, [1, 2, 3, 4, 6]), (3, 6, [1, 2, 3, 4, 5, 9]), (4, -1, [1, 2, 3, 4, 5, 8])], "fp long, sim long, toks array<bigint>")
    pairs = simhash.golay_pairs(sets, sets)
    assert {tuple(sorted(x)) for x in pairs.collect()} == {(1, 2), (1, 3)}
    assert {tuple(sorted(x)) for x in jaccard.verified(pairs, sets).collect()} == {(1, 3)}
