"""The Porter stemmer of 1980 as a table of rules, and its use on a column of terms.

A rule is (suffix, replacement, condition on the stem); in each step the first rule whose suffix fits
decides.  Terms are stemmed once per distinct term and joined back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rule = tuple[str, str, Callable[[str], bool]]


def shape(stem: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for letter in stem:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def over(least: int) -> Callable[[str], bool]:
    return lambda stem: measure(stem) > least


def always(stem: str) -> bool:
    return True


def has_vowel(stem: str) -> bool:
    return "v" in shape(stem)


def doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def short_end(stem: str) -> bool:
    """Consonant, vowel, consonant, the last not w, x or y."""
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def rules(text: str, condition: Callable[[str], bool]) -> list[Rule]:
    pairs = (pair.partition(":") for pair in text.split())
    return [(suffix, replacement, condition) for suffix, _, replacement in pairs]


#: The suffixes of the published algorithm.
STEP_1A = rules("sses:ss ies:i ss:ss s:", always)
STEP_1B = rules("eed:ee", over(0)) + rules("ed: ing:", has_vowel)
STEP_1C = rules("y:i", has_vowel)
STEP_2 = rules("""ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize
ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble""", over(0))
STEP_3 = rules("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:", over(0))
STEP_4 = rules("al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ou: ism: ate: iti: ous: ive: ize:", over(1)) + rules(
    "ion:", lambda stem: measure(stem) > 1 and stem[-1:] in ("s", "t"))


def apply(word: str, step: list[Rule]) -> tuple[str, str]:
    """The word after the step, and the suffix that was taken off."""
    for suffix, replacement, condition in step:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return (stem + replacement, suffix) if condition(stem) else (word, "")
    return word, ""


def tidy(word: str) -> str:
    """What follows the loss of -ed or -ing."""
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if doubled(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if measure(word) == 1 and short_end(word) else word


def finish(word: str) -> str:
    """The last step: a final e, and one l of two."""
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one word; words of other than letters, or of two letters, only in lower case."""
    word = word.lower()
    if len(word) <= 2 or not word.isalpha():
        return word
    word, _ = apply(word, STEP_1A)
    word, lost = apply(word, STEP_1B)
    if lost in ("ed", "ing"):
        word = tidy(word)
    for step in (STEP_1C, STEP_2, STEP_3, STEP_4):
        word, _ = apply(word, step)
    return finish(word)


@F.pandas_udf(T.StringType())
def stem_udf(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in words:
        yield some.map(lambda w: stem(w) if isinstance(w, str) and w.isascii() else w)


def stem_terms(df: DataFrame, column: str = "term") -> DataFrame:
    """``df`` with ASCII terms stemmed: the stemmer sees each distinct term once."""
    distinct = df.select(F.col(column).alias("__term")).distinct().withColumn("__stem", stem_udf("__term"))
    return df.join(distinct, F.col(column) == F.col("__term")).withColumn(column, F.col("__stem")).drop("__term", "__stem")
