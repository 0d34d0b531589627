"""String functions of reports and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a record label can't have as they are, and what stands for them (fixed values).
LABEL = (("\n", "\\l"), ("{", "\\{"), ("}", "\\}"), ("<", "\\<"), (">", "\\>"), ('"', '\\"'), ("|", "\\|"), (" ", "\\ "))
LABEL_LENGTH = 50


def label(text: Column) -> Column:
    """A statement's text for a graph: escaped, after at most 50 characters of it are taken."""
    text = F.substring(text, 1, LABEL_LENGTH)
    for old, new in LABEL:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def plain_name(path: Column) -> Column:
    """A file's name without folders and extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def plain_path(path: Column) -> Column:
    """A path without the word that some tools put before it."""
    return F.regexp_replace(path, "^file ", "")


def with_extension(path: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(extension))
