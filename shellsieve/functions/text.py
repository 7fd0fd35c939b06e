"""Text helpers as column expressions."""

from pyspark.sql import functions as F

from shellsieve.functions.dialect import SPACE


def has_extension(path, extension):
    """The last extension of the file name equals ``extension``, case-sensitively."""
    return extension_of(path) == F.lit(extension)


def extension_of(path):
    """Last extension, '' when there is none. A leading dot starts no extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)


def lines_of(text):
    r"""Lines without their ``\n`` or ``\r\n``; no empty line after a final break."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def count_lines(text):
    breaks = newline_count(text)
    unfinished = (text != "") & ~F.endswith(text, F.lit("\n"))
    return breaks + F.when(unfinished, 1).otherwise(0)


def newline_count(text):
    kept = F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.octet_length(text) - kept).cast("long")


def count_trailing_newlines(text):
    return (F.octet_length(text) - F.octet_length(F.rtrim(text, F.lit("\n")))).cast("long")


def escape_html(text):
    for raw, escaped in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def get_line_number(text, byte_offset):
    """Line holding the byte at ``byte_offset``; the number of lines beyond the end."""
    before = F.substring(text.cast("binary"), F.lit(1), byte_offset.cast("int")).cast("string")
    return F.when(byte_offset >= F.octet_length(text), count_lines(text)).otherwise(
        newline_count(before) + 1
    )


def get_line_start_offset(text, line):
    """Byte offset at which a 1-based line starts, NULL when there is no such line."""
    before = F.call_function("substring_index", text, F.lit("\n"), (line - 1).cast("int"))
    return (
        F.when(line == 1, F.lit(0))
        .when((line > 1) & (newline_count(text) >= line - 1), F.octet_length(before) + 1)
        .cast("long")
    )


def strip_quotes(text):
    """Trimmed text without one pair of equal quotes around it."""
    trimmed = F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")
    paired = (F.length(trimmed) >= 2) & (
        (F.startswith(trimmed, F.lit("'")) & F.endswith(trimmed, F.lit("'")))
        | (F.startswith(trimmed, F.lit('"')) & F.endswith(trimmed, F.lit('"')))
    )
    return F.when(paired, F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)).otherwise(trimmed)


def snippet_at(lines, line):
    """One line before ``line``, the line and two after it, as far as they exist."""
    at = line.cast("int")
    return F.concat_ws("\n", *[F.get(lines, at + step) for step in (-2, -1, 0, 1)])
