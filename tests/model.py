"""Brute-force Python models the column expressions are checked against."""

import re

# For use inside a character class.
SPACE = (
    "\t\n\x0b\f\r \x85\xa0  -     　"
)


def python_pattern(pattern):
    return (
        pattern.replace(r"[^\s]", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        .replace(".*", "[^\n]*")
    )


def position(text, offset):
    return text.count("\n", 0, offset) + 1, offset - text.rfind("\n", 0, offset)


def regex_hits(text, pattern):
    return [position(text, m.start()) for m in re.finditer(python_pattern(pattern), text)]


def lines(text):
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
        return [part.removesuffix("\r") for part in parts]
    return [part.removesuffix("\r") for part in parts[:-1]] + [parts[-1]]


def snippet(text, line):
    numbered = enumerate(lines(text), 1)
    return "\n".join(part for n, part in numbered if line - 1 <= n <= line + 2)
