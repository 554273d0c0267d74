"""Path expressions: base name, extension, glob matching."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def raw_extension(path: Column) -> Column:
    """Last extension with its dot, '' when there is none (a leading dot is no extension)."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)\z", 1)


def extension(path: Column) -> Column:
    return F.lower(raw_extension(path))


def stem(path: Column) -> Column:
    """The path without its last extension."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(raw_extension(path)))


def glob_to_regex(pattern: str) -> str:
    """Whole-name glob (``*``, ``?``, ``[...]``, ``[!...]``) as a Java regex."""
    out, rest = [], pattern
    while rest:
        head, rest = rest[0], rest[1:]
        if head == "*":
            out.append(".*")
        elif head == "?":
            out.append(".")
        elif head == "[":
            # a ']' right after the opening (or after '!') is an ordinary member
            found = re.match(r"(!?)(\]?[^\]]*)\]", rest)
            if found is None:
                out.append(r"\[")
            else:
                members = re.sub(r"([\[\]\\^&])", r"\\\1", found.group(2))
                out.append(f"[{'^' if found.group(1) else ''}{members}]")
                rest = rest[found.end():]
        else:
            out.append(re.escape(head))
    return r"(?s)\A" + "".join(out) + r"\z"


def glob_match(name: Column, pattern: str) -> Column:
    return name.rlike(glob_to_regex(pattern))
