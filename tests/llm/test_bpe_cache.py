"""The tokenizer's cache may be smaller than the distinct pieces of one text."""

import random

import pytest
from geoframe.llm import bpe, rlz


@pytest.mark.parametrize("size", [0, 1, 10, 300])
def test_text_of_more_pieces_than_the_cache_takes(size):
    pytest.importorskip("public_tokenizers")
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 12)))
    warm = " ".join(word() for _ in range(200))
    texts = [" ".join(word() for _ in range(2000)) + " " + "z" * 90, warm, ""]
    small, large = bpe.Coder(bpe.default_ranks(), cache=size), bpe.Coder(bpe.default_ranks())
    for given in ([warm], texts, texts[::-1]):
        want = [x.tolist() for x in large.encode(given)]
        assert [x.tolist() for x in small.encode(given)] == want
        assert [small.decode(x).decode() for x in small.encode(given)] == given
        assert len(small.cache) <= size


def thue_morse(n):
    text = "A"
    while len(text) < n:
        text += text.translate(str.maketrans("AB", "BA"))
    return text, text.translate(str.maketrans("AB", "BA"))


@pytest.mark.parametrize("n", [2048, 4096])
def test_words_that_polynomial_hashes_confuse(spark, n):
    """Pieces and words are told apart by their bytes."""
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    one, two = thue_morse(n)
    coder = bpe.coder(bpe.default_ranks())
    true = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=coder.rank, special_tokens={})
    text = f"{one}\n{two} {two}"
    (ids,) = coder.encode([text])
    assert ids.tolist() == true.encode_ordinary(text) and coder.decode(ids).decode() == text
    common = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, f"{common} {one} {common}"), (2, f"{common} {two} {common}")], "doc_id long, text string")
    assert [r["n_removed"] for r in rlz.remove_repeats(d).collect()] == [0, 0]
