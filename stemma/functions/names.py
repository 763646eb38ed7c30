"""Identifiers, paths and lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.schema import EXTENSIONS, STOP_WORDS

LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def words_of(name: Column) -> Column:
    """The words of a camelCase or snake_case identifier."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, "[_\\s]+"), lambda w: w != "")


def telling_words(name: Column, longer_than: int = 1) -> Column:
    """Lower-case words of an identifier that aren't stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.transform(words_of(name), lambda w: F.lower(w)), lambda w: (F.length(w) > longer_than) & ~F.array_contains(stop, w))


def titled(words: Column, most: int = 3) -> Column:
    """The first words in title case, or null if there are none."""
    label = F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.initcap(w)), " ")
    return F.when(label != "", label)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    """The parser for a file, null for files that aren't read."""
    pairs = [F.lit(x) for pair in EXTENSIONS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?<=.)\\.[^.]*$", "")


def top_directory(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def prefixes(path: Column) -> Column:
    """All directories above a path, and the path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def lines_of(text: Column) -> Column:
    """Lines without their ends; an end at the end of the text starts no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, f"(?:{LINE_END})$", ""), LINE_END))


def line_kinds(text: Column) -> Column:
    """``total``, ``blank``, ``comment`` and ``logical`` lines of a source, as a struct.

    Comments are lines that begin with ``#`` or a triple quote, and what stands
    between a line that begins with one triple quote and the next such line.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("blank", "comment", "logical")], F.lit(False).alias("within"))

    def one(s: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, "^\\s+|\\s+$", "")
        quotes = [F.size(F.split(bare, q)) - 1 for q in ('"""', "'''")]
        opens = bare.startswith('"""') | bare.startswith("'''")
        blank = bare == ""
        comment = ~blank & (bare.startswith("#") | opens | s["within"])
        turned = opens & ((quotes[0] == 1) | (quotes[1] == 1))
        return F.struct(
            (s["blank"] + blank.cast("long")).alias("blank"),
            (s["comment"] + comment.cast("long")).alias("comment"),
            (s["logical"] + (~blank & ~comment).cast("long")).alias("logical"),
            (s["within"] != turned).alias("within"),
        )

    lines = lines_of(text)
    return F.aggregate(lines, zero, one, lambda s: F.struct(F.size(lines).cast("long").alias("total"), s["blank"].alias("blank"), s["comment"].alias("comment"), s["logical"].alias("logical")))


def string_prefix(a: Column, b: Column) -> Column:
    """The characters that two texts both begin with."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    same = F.size(F.filter(places, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.substring(a, F.lit(1), F.least(same, F.length(a), F.length(b)))


def shortened(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def common_prefix(parts: Column) -> Column:
    """The elements that all arrays in an array begin with."""
    return F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.element_at(parts, 1),
        lambda a, b: F.slice(a, 1, F.coalesce(F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: F.when((i >= F.least(F.size(a), F.size(b))) | (F.get(a, i) != F.get(b, i)), i)), lambda i: i.isNotNull())), F.lit(0))),
    )


def ascii_only(text: Column) -> Column:
    """With any other character as an underscore, so that word boundaries agree everywhere."""
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "_")
