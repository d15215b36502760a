"""Token vocabularies. A vocabulary is a parameter everywhere; this small one is the default."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

DEFAULT = """
# /* */ // <- -> => := :: ;; {} [] () <? ?> </ /> == != && || ++ += -- @ $ % ` ~ \\ " '
and as begin break case char class const continue def default do double elif else end enum except export extends
final finally float fn for from func function goto if implements import in include int interface lambda let local
long loop match module mut namespace new nil not null object of or override package print private protected public
raise return self static string struct super switch table then this throw true try type typedef union until use
using val var virtual void when where while with yield SELECT FROM WHERE INSERT CREATE the der die das und les des
que para con una est dans pour pas nicht ing tion ung ment
""".split()


def vocabulary(tokens: Iterable[str] = DEFAULT) -> list[str]:
    """Distinct tokens in code-point order."""
    return sorted(set(tokens))


def vocabulary_from_groups(groups: dict[str, Iterable[str]]) -> list[str]:
    return vocabulary(t for tokens in groups.values() for t in tokens)


def with_space(tokens: Iterable[str]) -> list[str]:
    """Tokens that only count with a space after them."""
    return vocabulary(f"{t} " for t in tokens)


def vocabulary_table(spark: SparkSession, tokens: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(tokens)), "idx int, token string")
