"""Rule-based labels as expressions over one text or rating column."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from plaintide.functions.text import parse_double


def rating_sentiment(rating: Column, numeric: bool = True) -> Column:
    """1-2 negative, 3 neutral, any other number positive.

    A missing rating counts as positive; text that is no number has no label.
    """
    value = rating.cast("double") if numeric else parse_double(rating)
    label = (
        F.when(value.isNull() | F.isnan(value), "positive")
        .when(value <= 2, "negative")
        .when(value == 3, "neutral")
        .otherwise("positive")
    )
    return label if numeric else F.when(rating.isNull() | value.isNotNull(), label)


def _words(keywords: Sequence[str]) -> Column:
    return F.array(*[F.lit(k) for k in keywords]).cast("array<string>")


def any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Does any keyword occur in ``text`` as a substring ('os' is found in 'those')?

    A loop over a constant array: the same scan written as a chain of conditions
    grows generated methods past the size the JVM compiles.
    """
    return F.exists(_words(keywords), lambda k: F.contains(text, k))


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur in ``text`` (each counts once)."""
    return F.size(F.filter(_words(keywords), lambda k: F.contains(text, k)))


def phrase(keyword: str) -> str:
    """The words of a keyword, lower case and one blank apart: 'Wi-Fi' is 'wi fi'."""
    return " ".join(re.findall(r"\w+", keyword.lower()))


def phrases_found(words: Column, keywords: Sequence[str]) -> Column:
    """The phrases of ``keywords`` that occur in the array ``words`` as whole words, each once.

    One look-up per word in a hash set of all phrases, whatever their number; longer
    phrases are put together only where their first word stands.
    """
    phrases = sorted({phrase(k) for k in keywords} - {""})

    def placed(n: int) -> Column:
        starts = sorted({p.split(" ")[0] for p in phrases if p.count(" ") + 1 == n})
        return F.transform(words, lambda w, i: F.when(w.isin(starts), F.concat_ws(" ", F.slice(words, i + 1, n))))

    seen = [words, *[placed(n) for n in sorted({p.count(" ") + 1 for p in phrases} - {1})]]
    return F.array_intersect(F.concat(*seen), _words(phrases))


def first_phrase(found: Column, rules: Mapping[str, Sequence[str]], other: str = "other") -> Column:
    """Label of the first rule with a keyword among the phrases ``found``."""
    hits = [F.when(F.arrays_overlap(found, _words([phrase(k) for k in words])), label) for label, words in rules.items()]
    return F.coalesce(*hits, F.lit(other))


def phrase_hits(found: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords are among the phrases ``found``; keywords of the same words count one by one."""
    return F.size(F.filter(_words([phrase(k) for k in keywords]), lambda k: F.array_contains(found, k)))


def first_match(text: Column, rules: Mapping[str, Sequence[str]], other: str = "other") -> Column:
    """Label of the first rule with a keyword in ``text`` (lower case already)."""
    hits = [F.when(any_keyword(text, words), label) for label, words in rules.items()]
    return F.coalesce(*hits, F.lit(other))


def first_best(scores: Mapping[str, Column], best: Column, other: str) -> Column:
    """Label of the first score equal to ``best``; ``other`` when nothing scored."""
    labels = [F.when((best > 0) & (score == best), label) for label, score in scores.items()]
    return F.coalesce(*labels, F.lit(other))


def one_of(label: Column, labels: Sequence[str], other: str = "other") -> Column:
    return F.when(label.isin(list(labels)), label).otherwise(other)
