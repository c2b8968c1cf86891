import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_words import words  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, ids string, score string, kept string, spans int"


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    base = words(rng, 120)
    long = words(rng, 30_000)
    texts = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (None, base), (None, None),
        (7, base.replace("a", "á", 1)), (8, words(rng, 60) + "\n" + base[:250] + "\n" + words(rng, 40)),
        (9, long), (10, long[5:] + " end"), (11, "one two"), (12, "one  two"), (13, "x"), (14, "日本語の文章。" * 60), (15, "日本語の文章。" * 60 + "！"),
        (16, "a" * 900), (17, "ab" * 450), (18, "  lead and trail \r\n"), (19, words(rng, 80)), (20, words(rng, 80)),
    ]
    return [(i, t, "en", "s", 3, 99, "x", "y", "z", 1) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("doc_id = -1")
