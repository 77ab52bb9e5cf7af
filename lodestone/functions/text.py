"""Column functions on text, paths and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as C

#: White space as Unicode has it, at both ends or inside.
BLANK = r"(?U)\s+"
#: What ends a line: CR LF, or any one of the others.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\u0085\\u2028\\u2029]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def normalize_title(title: Column) -> Column:
    """Strip, lower, one space for any run of white space, no closing . ! ?, strip again."""
    t = F.regexp_replace(F.lower(strip(title)), BLANK, " ")
    return strip(F.regexp_replace(t, r"[.!?]+\z", ""))


def tokenize(text: Column) -> Column:
    """Each identifier in lower case, then its parts if it has more than one; in order, repeats kept. Null: null."""

    def parts(x: Column) -> Column:
        p = F.regexp_extract_all(x, F.lit(C.SUBTOKEN), F.lit(0))
        whole = F.array(x)
        return F.transform(F.when(F.size(p) > 1, F.concat(whole, p)).otherwise(whole), F.lower)

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), parts))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the base name on; empty if it has none."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)\z", 1)


def is_excluded(path: Column) -> Column:
    out = basename(path).isin(*C.EXCLUDED_BASENAMES) | extension(path).isin(*C.EXCLUDED_EXTENSIONS)
    for pattern in C.EXCLUDED_PATHS:
        out = out | path.rlike(pattern)
    return out


def document_text(title: Column, body: Column, files: Column) -> Column:
    """Title, body and base names of the files, a line each; null parts are empty lines."""
    lines = F.concat(F.array(F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))), F.transform(F.coalesce(files, F.array().cast("array<string>")), basename))
    return F.array_join(lines, "\n")


def slug(full_name: Column) -> Column:
    return F.replace(full_name, F.lit("/"), F.lit("__"))


def page_number(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"_page_(\d+)", 1).cast("int")


def is_bot(author: Column, author_type: Column) -> Column:
    login = F.regexp_replace(F.lower(author), r"\[bot\]\z", "")
    return F.coalesce((author_type == "Bot") | login.isin(*C.BOT_ACCOUNTS), F.lit(False))


def is_housekeeping(title: Column, *, ignore_case: bool = False) -> Column:
    out = F.lit(False)
    for pattern in C.HOUSEKEEPING_TITLES:
        out = out | title.rlike(("(?i)" if ignore_case else "") + pattern)
    return F.coalesce(out, F.lit(False))


def is_source(path: Column) -> Column:
    return path.rlike(r"\.(js|mjs|ts)\z") & ~path.startswith("translations/") & ~path.startswith("test/")


def area_labels(labels: Column) -> Column:
    """The labels that name an area, whatever their case."""
    return F.filter(labels, lambda x: F.startswith(F.lower(x), F.lit(C.AREA_PREFIX)))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|spec|__tests__)/|(^|/)test_[^/]*\z|[._]test\.[a-z]+\z")
