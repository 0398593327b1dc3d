"""Text, path and file-name expressions."""

from pyspark.sql import Column, functions as F

# Fixed value: runs of characters between white space, Unicode spaces included.
WORD_PATTERN = (
    r"[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def msg_length(msg) -> Column:
    """Characters of a message; none for a missing one."""
    return F.length(F.coalesce(_c(msg), F.lit("")))


def words(msg) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(msg), F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def msg_word_count(msg) -> Column:
    return F.size(words(msg))


def tokenize_message(msg) -> Column:
    return words(F.lower(_c(msg)))


def base_name(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def directory(path) -> Column:
    """Path without its last segment, `root` when there is only one."""
    c = _c(path)
    upto = F.length(c) - F.length(F.substring_index(c, "/", -1)) - 1
    return F.when(c.contains("/"), c.substr(F.lit(1), upto)).otherwise(F.lit("root"))


def file_extension(name) -> Column:
    """Extension with its dot; leading dots do not start one, the last dot wins."""
    visible = F.ltrim(base_name(name), F.lit("."))
    return F.when(visible.contains("."), F.concat(F.lit("."), F.substring_index(visible, ".", -1))).otherwise(F.lit(""))


def plain_extension(name) -> Column:
    """Text after the last dot of the whole name, `no_ext` without a dot."""
    c = _c(name)
    return F.when(c.contains("."), F.substring_index(c, ".", -1)).otherwise(F.lit("no_ext"))


def shorten_filename(name, max_length: int = 15) -> Column:
    """Cut a long name, keeping a short extension when at least four letters stay."""
    c = _c(name)
    ext_length = F.length(F.substring_index(c, ".", -1))
    room = F.lit(max_length - 1) - ext_length
    keeps_ext = c.contains(".") & (ext_length < 5) & (room > 3)
    # cut the stem, not the whole name: a stem shorter than the room stays as it is
    stem = c.substr(F.lit(1), F.length(c) - ext_length - 1)
    with_ext = F.concat(stem.substr(F.lit(1), room), F.lit("."), F.substring_index(c, ".", -1))
    cut = F.concat(F.substring(c, 1, max_length - 3), F.lit("..."))
    return F.when(F.length(c) <= max_length, c).when(keeps_ext, with_ext).otherwise(cut)


def truncated(name, keep: int, mark: str = "...") -> Column:
    """First `keep` characters, marked when something was cut."""
    c = _c(name)
    return F.when(F.length(c) > keep, F.concat(F.substring(c, 1, keep), F.lit(mark))).otherwise(c)


def strip_set_repr(text) -> Column:
    """Drop the braces and quotes around a printed one-element set."""
    return F.regexp_replace(_c(text), r"\{'|'\}|[{}]", "")


def repo_name_from_url(url) -> Column:
    return F.replace(F.substring_index(_c(url), "/", -1), F.lit(".git"), F.lit(""))


def parse_file_list(cell, split_commas: bool = False) -> Column:
    """A cell holding a printed list becomes an array of strings.

    Other text is one file, or comma-separated files with `split_commas`. Missing
    and blank cells, and lists that cannot be read, give null.
    """
    c = _c(cell)
    as_json = F.regexp_replace(c, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    listed = F.from_json(as_json, "array<string>", {"allowSingleQuotes": "true"})
    if split_commas:
        other = F.transform(F.split(c, ","), lambda x: F.trim(x))
        is_list = c.startswith("[")
    else:
        other = F.array(c)
        is_list = c.startswith("[") & c.endswith("]")
    return F.when(c.isNull() | (c == ""), F.lit(None)).when(is_list, listed).otherwise(other)


def visible_name(path) -> Column:
    """Base name of a visible, non-blank file; null for anything else."""
    c = _c(path)
    name = base_name(c)
    keep = (F.trim(c) != "") & (name != "") & ~name.startswith(".")
    return F.when(keep, name)


def clean_basket(files) -> Column:
    """Base names of the visible, non-blank files of an array."""
    return F.filter(F.transform(_c(files), visible_name), lambda x: x.isNotNull())
