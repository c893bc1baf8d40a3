import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.08 else "") for w in words)


@pytest.fixture(scope="session")
def awkward():
    """Nulls in any column, empty and blank and long texts, repeated rows, ties, several scripts and white spaces."""
    rng = random.Random(7)
    long = prose(rng, 12_000)
    texts = [None, "", "", " ", "\n\n", "a", "a b", " lead", "trail ", "two  spaces", "tab\tand\nline\r\nend", "▁mark ▁ here", "naïve café ñandú ß", "中文 字符 测试", "a b　c", "\x0bv\x0cf", "🙂 smile 🙂🙂", "x" * 5000, long, long, long + " tail", long[:40_000], "<|endoftext|> a <|endoftext|>", "line one is here\nline two is there\nline one is here", "a \n b", "a  \n  b   c", "end \n", "don't we'll 123 4,5!"]
    rows = [(i, t, "en", "s1") for i, t in enumerate(texts)]
    rows += [(i + 100, prose(rng, rng.randrange(1, 300)), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None])) for i in range(60)]
    rows += [(5, "a", "en", "s1"), (None, "no id", None, None), (None, None, None, None)]
    return rows
