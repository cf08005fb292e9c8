import pytest

import public_tokenizers

ODD_TEXTS = [None, "", " ", "\n\n", "the cat sat on the mat", "the cat sat on the mat", "Le chat!! est  là,\nici. ", "中文 テスト ok",
             "a<|endoftext|>b <|startoftext|> c", "x" * 5000, "it's we'll DON'T 12 3.5 \t tab", "é́ Σς İ ǅ ﬁ ²Ⅷ", "\x00 \x1c \u0085  ", "word " * 3000]


@pytest.fixture(scope="session")
def odd(spark):
    """Texts of every awkward kind, with repeated rows, null keys and columns whose names operators use themselves."""
    rows = [(i, t, "s" if i % 3 else None, "x", 1.5, i, "y") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], (None, "the cat sat on the mat", None, "x", 0.0, 1, "y"), (None, None, "s", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, component_id double, key int, unit string")


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("byte_bpe_50k.json")
