"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.plans import rules

#: The line ends of universal newlines and the other separators that split text into lines.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def any_of(text: Column, words: list[str]) -> Column:
    """Whether a text contains one of the words, as they are."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def first_of(text: Column, rows: list[tuple[str, list[str]]], other: str) -> Column:
    """The name of the first row with a word in the text."""
    found = None
    for name, words in rows:
        found = (F if found is None else found).when(any_of(text, words), F.lit(name))
    return found.otherwise(F.lit(other))


def key_of(*parts: Column, length: int = 16) -> Column:
    """A stable identifier from parts."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def lines_of(text: Column) -> Column:
    """The lines of a text, without an empty one after a final line end."""
    cut = F.split(F.coalesce(text, F.lit("")), LINE_ENDS)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def line_count(text: Column) -> Column:
    return F.size(lines_of(text))


def lines_of_code(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(lines_of(text), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""))


def table_name(class_name: Column) -> Column:
    """CamelCase to snake_case, in the plural."""
    snake = F.lower(F.regexp_replace(class_name, "(?<!^)(?=[A-Z])", "_"))
    return F.when(snake.endswith("s"), snake).otherwise(F.concat(snake, F.lit("s")))


def snippet(text: Column, size: int = 300) -> Column:
    """A text on one line, cut to ``size`` characters with an ellipsis."""
    flat = F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(flat) <= size, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, size - 1), r"\s+$", ""), F.lit("…")))


def file_module(path: Column) -> Column:
    """The module that a file belongs to."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    p = F.split(clean, "/")
    two = F.concat_ws("/", F.get(p, F.lit(0)), F.get(p, F.lit(1)))
    return (
        F.when(F.coalesce(path, F.lit("")) == "", F.lit(""))
        .when((F.size(p) >= 3) & p[0].isin("backend", "frontend", "src", "packages"), two)
        .when((F.size(p) >= 2) & p[0].isin("app", "lib", "components"), two)
        .otherwise(p[0])
    )


def import_module(module: Column) -> Column:
    """The module that an import names."""
    clean = F.regexp_replace(F.replace(module, F.lit("\\"), F.lit("/")), "^[./]+", "")
    p, dotted = F.split(clean, "/"), F.filter(F.split(clean, r"\."), lambda x: x != "")
    return (
        F.when(F.coalesce(module, F.lit("")) == "", F.lit(""))
        .when(F.size(p) >= 2, F.concat_ws("/", p[0], F.get(p, F.lit(1))))
        .when(clean.contains(".") & (F.size(dotted) >= 2) & F.get(dotted, F.lit(0)).isin("app", "src", "backend", "frontend"), F.concat_ws("/", F.get(dotted, F.lit(0)), F.get(dotted, F.lit(1))))
        .when(clean.contains(".") & (F.size(dotted) >= 1), F.get(dotted, F.lit(0)))
        .otherwise(p[0])
    )


def is_relative(module: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | module.startswith(".") | module.startswith("app.") | module.startswith("src.")


def language_of(path: Column) -> Column:
    """A language by a path's extension, in lower case; null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in rules.LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.lower(extension_of(path)))


def extension_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1)


def is_code(path: Column) -> Column:
    found = F.lit(False)
    for end in rules.CODE_EXTENSIONS:
        found = found | path.endswith(end)
    return found


def hash_vector(text: Column) -> Column:
    """A deterministic stand-in for an embedding: the bytes of a digest, from 0 to 1."""
    digest = F.sha2(text.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def reasoning_type(question: Column) -> Column:
    return first_of(F.lower(question), rules.REASONING, "general")


def intent(question: Column) -> Column:
    return first_of(F.lower(question), rules.INTENTS, "overview")


def severity_weight(severity: Column, weights: dict[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(known, severity), F.lit(0))
