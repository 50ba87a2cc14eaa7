"""What must stay as it is: protected keys, linked names, protected values, visible and internal texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import any_of


def protected_key(key: Column, always: list[str], never: list[str], prefixes: list[str], patterns: list[str]) -> Column:
    """Listed keys first (``always`` before ``never``), then families by prefix, then by pattern."""
    families = [key.startswith(p) for p in prefixes] + [key.rlike(p) for p in patterns]
    return F.when(key.isin(*always), True).when(key.isin(*never), False).otherwise(any_of(families))


def titles(rows: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """The distinct trimmed values of a family of keys."""
    return rows.where(F.col(key).startswith(prefix)).select(F.trim(value).alias("title")).where("title <> ''").distinct()


def linked(rows: DataFrame, key: str, value: str, prefixes: list[str], of: DataFrame) -> DataFrame:
    """Rows of the families ``prefixes`` whose trimmed value is a title of another family."""
    own = rows.where(any_of([F.col(key).startswith(p) for p in prefixes]))
    return own.join(of.withColumnRenamed("title", "_title"), F.trim(value) == F.col("_title"), "left_semi")


def protected_values(titles_: DataFrame, names: list[str]) -> DataFrame:
    """Titles and explicit names, and each in lower case: ``value, folded``."""
    spark = titles_.sparkSession
    both = titles_.select(F.col("title").alias("value")).union(spark.createDataFrame([(n,) for n in names], "value string")).distinct()
    return both.select("value", F.lower("value").alias("folded"))


def keeps_value(rows: DataFrame, value: str, category: str, values: DataFrame, exempt: list[str]) -> DataFrame:
    """``rows`` with ``protected``: their value is a protected one and their category is not exempt."""
    known = values.select(F.col("value").alias("_value"), F.lit(True).alias("_known")).distinct()
    out = rows.join(known, F.col(value) == F.col("_value"), "left").drop("_value")
    return out.withColumn("protected", F.coalesce("_known", F.lit(False)) & ~F.col(category).isin(*exempt)).drop("_known")


@dataclass(frozen=True)
class Prose:
    """When words make prose: how many there are, and how many of them begin in lower case."""

    words: int
    low: int


# Prose with a sign of sentences or markup, and prose without one.
SIGNED, BARE = Prose(4, 2), Prose(7, 3)
SIGN = r"\\n|<|[.!?;:]"


def visible_world(text: Column, singles: list[str], descriptor: str, prose: tuple[Prose, Prose] = (SIGNED, BARE)) -> Column:
    """A known single word, a text with a descriptor, or prose by the shape of its words: see ``Prose``."""
    plain = F.regexp_replace(text, r"\\n|<[^>]+>", " ")
    low, all_ = F.regexp_count(plain, F.lit(r"(?<![\p{L}'’-])\p{Ll}")), F.regexp_count(plain, F.lit(r"\p{L}[\p{L}'’-]*"))
    enough = lambda p: (all_ >= p.words) & (low >= p.low)
    return F.lower(F.trim(text)).isin(*singles) | plain.rlike(descriptor) | F.when(text.rlike(SIGN), enough(prose[0])).otherwise(False) | enough(prose[1])


def internal_text(text: Column, markers: str) -> Column:
    """A developer's note: a marker, a name with underscores and no blank, or a text all in brackets."""
    return text.rlike(markers) | (text.rlike("_") & ~text.rlike(r"\s")) | text.rlike(r"^\s*\[[^\]]*\]\s*$")


def worth_translating(text: Column, long: int = 600) -> Column:
    """Two characters or more, and a Latin or Cyrillic letter among them unless the text is long."""
    return (F.length(text) >= 2) & ((F.length(text) > long) | text.rlike(r"\p{IsLatin}|\p{IsCyrillic}"))


def untranslated(status: Column, key_protected: Column, open_: list[str]) -> Column:
    return status.isin(*open_) & ~key_protected


def item_names(rows: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """Names for chat matching: trimmed, 2 to 100 characters, no markup, two letters in a row, unique ignoring case, with ``rank`` from the longest.

    Of spellings that differ in case the least one in code-point order stays.
    """
    name = F.trim(value)
    fit = (F.length(name) >= 2) & (F.length(name) <= 100) & ~name.rlike(r"[<>{}\[\]]") & name.rlike(r"\p{L}{2}")
    return rows.where(F.col(key).startswith(prefix) & fit).groupBy(F.lower(name).alias("folded")).agg(F.min(name).alias("name")).select("name", F.length("name").alias("length"))
