"""String expressions that the operators share. All are built-in functions, so they stay in generated code."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEARCHED = ("text", "name", "canonical_name")
CHAT_SEARCHED = ("name", "text", "description", "disease", "symptom", "title")


def whole(n: int, least: int = 0, name: str = "limit") -> int:
    """A checked number that comes from a caller."""
    if isinstance(n, bool) or not isinstance(n, int) or n < least:
        raise ValueError(f"{name} must be a whole number of at least {least}, not {n!r}")
    return n


def holds(needle: Column, columns=SEARCHED) -> Column:
    """Whether one of the columns contains the needle, whatever the case. An empty needle is in every value but null."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lower(needle)), F.lit(False)) for c in columns))


def relevance(needle: Column) -> Column:
    """10 for a name that is the needle, 5 for one that contains it, 1 for a text that does."""
    q = F.lower(needle)
    return (
        F.when((F.lower("name") == q) | (F.lower("canonical_name") == q), 10)
        .when(F.contains(F.lower("name"), q) | F.contains(F.lower("canonical_name"), q), 5)
        .when(F.contains(F.lower("text"), q), 1)
        .otherwise(0)
    )


def label(column: str = "labels") -> Column:
    """The first label, or Node."""
    return F.coalesce(F.get(F.col(column), F.lit(0)), F.lit("Node"))


def shown(prefix: str = "") -> Column:
    """The first of text, name and canonical name that isn't empty; else an empty string."""
    return F.coalesce(*[F.nullif(F.col(f"{prefix}{c}"), F.lit("")) for c in SEARCHED], F.lit(""))


def clipped(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def stars(score: Column) -> Column:
    return F.repeat(F.lit("★"), F.least(F.lit(3), (score / 3).cast("int")))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def entity(question: Column) -> Column:
    """The first capitalized word of more than four characters, else the first of more than five, without marks around
    it; null if there is none."""
    words = F.split(question, r"\s+")
    upper = F.filter(words, lambda w: (F.length(w) > 4) & F.substring(w, 1, 1).rlike(r"^\p{Lu}"))
    long_ = F.filter(words, lambda w: F.length(w) > 5)
    return F.btrim(F.coalesce(F.get(upper, F.lit(0)), F.get(long_, F.lit(0))), F.lit("?,.:;!"))


def entity_plain(question: Column) -> Column:
    """The first word of more than four characters, without marks around it."""
    return F.btrim(F.get(F.filter(F.split(question, r"\s+"), lambda w: F.length(w) > 4), F.lit(0)), F.lit("?,.:;"))
