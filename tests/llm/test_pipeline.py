"""Each stage on its own input, against brute force, over the smallest tables."""

import os

import pytest
from geoframe.llm import bpe, quality
from geoframe.llm.common import cut, load
from test_jaccard import kept as all_pairs
from test_llm_operators import one_edit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    import corpus_pipeline

    docs, out = load(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = cut(stage(spark, docs, SF), name)
        out[name] = (given, docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(stages):
    names = stages["quality"][0].columns
    for name, (_, kept) in stages.items():
        assert kept.columns[: len(names)] == names and (name == "tokens" or len(kept.columns) == len(names))
        assert kept.schema[names[0]].dataType == stages["quality"][0].schema[names[0]].dataType


def test_quality_stage(spark, stages):
    given, kept = stages["quality"]
    scores = quality.classify(given, load(spark, SF, "labels")).collect()
    assert set(rows(kept)) == {r["doc_id"] for r in scores if r["predicted"]}
    assert all(rows(given)[i] == r for i, r in rows(kept).items())


def test_lines_stage(stages):
    given, kept = (rows(x) for x in stages["lines"])
    assert set(given) == set(kept)
    seen = []
    for i in sorted(given):
        stay = []
        for s in given[i]["text"].split("\n"):
            bare = s.strip(" ")
            if not (bare and any(bare == x or min(len(bare), len(x)) >= 16 and one_edit(bare, x) for x in seen)):
                stay.append(s)
            if bare:
                seen.append(bare)
        assert kept[i]["text"] == "\n".join(stay) and kept[i]["n_chars"] == len(kept[i]["text"])


def test_copies_stage(stages):
    """Against all pairs: five-word shingles, four fifths."""
    given, out = (rows(x) for x in stages["copies"])
    assert set(out) == all_pairs([(i, r["text"]) for i, r in sorted(given.items())])


def test_benchmark_stage(spark, stages):
    given, kept = (rows(x) for x in stages["benchmark"])
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r["text"]) for r in load(spark, SF, "benchmark").collect()]
    assert set(kept) == {i for i, r in given.items() if not any(x in flat(r["text"]) for x in items)}


def test_tokens_stage(stages):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    true = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.default_ranks()), special_tokens={})
    given, kept = (rows(x) for x in stages["tokens"])
    assert set(given) == set(kept) and all(r["n_tokens"] == len(true.encode_ordinary(r["text"])) for r in kept.values())


def test_rows_without_ids_and_texts_pass_all_stages(spark):
    import corpus_pipeline

    d = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "A text that is read as it stands.", "en", None, 33)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        d = cut(stage(spark, cut(d, "in"), SF), "out")
    assert d.count() == 2 and sum(r["text"] is not None and len(r["text"]) > 0 for r in d.collect()) == 1


def test_empty_tables_and_columns_with_the_names_of_our_own(spark):
    """Columns that the operators use themselves pass all stages; none of them minds a table without rows, nulls or a plan that is no scan."""
    import corpus_pipeline

    own = ["fid", "rix", "key", "gone", "parts", "toks", "fp", "n", "window", "text2", "line", "_metadata_", "y", "score"]
    text = "A plain text of a few words, which stands here as it is. " * 3
    d = spark.createDataFrame([(1, text, "en", "a", len(text), *[7] * len(own)), (None, None, None, None, None, *[None] * len(own))], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in own))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d.distinct(), SF)  # no plain scan
        assert set(d.columns) <= set(out.columns) and out.count() <= 2, name
        assert {r["key"] for r in out.collect()} <= {7, None}
        assert stage(spark, cut(d.where("false"), "none"), SF).count() == 0, name
