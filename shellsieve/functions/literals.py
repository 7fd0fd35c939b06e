"""Literal text that every match of a pattern holds."""

import re
from re import _constants as kinds
from re import _parser as parser


def required_literal(pattern):
    """The longest run of ASCII characters that any match holds, letters lowered; may be empty.

    Lowered, since the text it is looked for in is lowered too. A pattern that the parser does not
    read has none, which is safe: such a rule is tried on every text.
    """
    body = pattern[4:] if pattern.startswith("(?i)") else pattern
    try:
        runs = _runs(parser.parse(body))
    except (re.error, OverflowError, RecursionError):
        return ""
    return max(runs, key=len, default="").lower()


def _runs(items):
    """Runs of characters in a sequence that each match goes through as a whole."""
    out, run = [], []

    def cut():
        out.append("".join(run))
        run.clear()

    for kind, value in items:
        if kind is kinds.LITERAL and value < 128:
            run.append(chr(value))
        elif kind is kinds.AT:
            continue
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] >= 1:
            cut()
            out += _runs(value[2])
        elif kind is kinds.SUBPATTERN:
            cut()
            out += _runs(value[-1])
        else:
            cut()
    cut()
    return out
