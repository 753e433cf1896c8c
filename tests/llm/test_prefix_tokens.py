import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parallax.llm.prefix_tokens import PrefixCounter, token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [
    "", " ", "  ", "a  b", "it's  we'll 'S 's\n\n x's ..'s\t\ty ", "<|endoftext|>", "hi <|endoftext|> there<|endoftext|>",
    "é ñ 　x 日本語テキスト 🙂🙂 x", "12 345 6.7\r\n\r\n  end  ", " a \u0085b\x1cc d\x1f e", " '", " 's a'sb", "a" * 48, "#" * 40,
    "a​b   c", "x" * 300, "''s", "'", "don't we'd they're I'm you've ll 'll",
]


@pytest.fixture(scope="module")
def both():
    return PrefixCounter(PATH), Tokenizer.from_file(PATH)


def count(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_prefix_and_budget(both):
    counter, tokenizer = both
    for text in ODD:
        table = counter.table(text)
        want = [count(tokenizer, text[:i]) for i in range(len(text) + 1)]
        assert [table.count(i) for i in range(len(text) + 1)] == want, text
        for budget in {0, 1, 2, want[-1] // 2, want[-1]}:
            assert table.truncate(budget) == max(i for i, n in enumerate(want) if n <= budget)
            assert table.fits(budget) == (want[-1] <= budget)


def test_random_texts(both):
    counter, tokenizer = both
    rng = random.Random(7)
    letters = "etaoin shrdlu\n\t'.,#é0123 <|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(300)]
    assert counter.counts(texts) == [count(tokenizer, t) for t in texts]


def test_sf_tables_and_odd_rows(spark, sf, docs_of):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts(docs, PATH).collect():
        n = count(tokenizer, texts[r.doc_id] or "")
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 512)
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (5, "word " * 100_000)]
    got = sorted((r.doc_id or 0, r.n_tokens, r.over_limit) for r in token_counts(docs_of(rows), PATH).collect())
    assert got == [(0, 1, False), (1, 0, False), (2, 0, False), (3, 2, False), (3, 2, False), (5, 100_001, True)]
    assert token_counts(docs.limit(0), PATH).count() == 0
