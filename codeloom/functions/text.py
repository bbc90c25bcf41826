"""Text expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.tokens import TOKEN_PATTERN

TERM_PATTERN = r"[\p{L}\p{N}]+"


def token_count(text: str | Column) -> Column:
    """Tokens of a text by TOKEN_PATTERN; 0 for a null or empty text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.regexp_extract_all(column, F.lit(TOKEN_PATTERN), F.lit(0))), F.lit(0)).cast("bigint")


def terms(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(TERM_PATTERN), F.lit(0))


def code_tokens(text: str | Column) -> Column:
    """Words of identifiers: camel case, snake case and operators split, lower-cased."""
    column = F.col(text) if isinstance(text, str) else text
    split = F.regexp_replace(F.regexp_replace(F.coalesce(column, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(split), "[^a-z0-9]+"), lambda x: x != "")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def l2_normalized(vector: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    length = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ** any folders, * within one, ? one character."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in "\\.^$|()[]{}+" else c
        i += 1
    return "^" + out + "$"
