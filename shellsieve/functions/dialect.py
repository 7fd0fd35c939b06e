r"""Rule patterns are written in one regex dialect and run in Java's.

The rule dialect is the Unicode, backtracking-free one most scanners use: ``\s`` is
Unicode white space, ``.`` stops at ``\n`` only, ``$`` is the end of the text and
``(?i)`` is Unicode simple case folding. ``java.util.regex`` differs on all four, so
``portable`` spells them out.

Java's own ``(?iu)`` is not used: it also lets U+0130 and U+0131 (Turkish dotted and
dotless i) match ``i``, which simple case folding does not.
"""

import re

SPACE = r"\p{IsWhite_Space}"
WORD = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"

# Non-ASCII characters that fold to an ASCII letter.
_FOLDS_TO_ASCII = {"s": r"\x{17F}", "k": r"\x{212A}"}

# What patterns may not hold, since Java means something else by it, and how it is named.
_UNSUPPORTED = (
    (re.compile(r"\(\?[a-zA-Z]*-?[a-zA-Z]+[):]"), "flags other than a leading (?i)"),
    (re.compile(r"\[[^\]]*(?:\[:|&&|--|~~)"), "a class inside a class"),
    (re.compile(r"\[\^?\]"), "a class that begins with ]"),
    (re.compile(r"\(\?(?:[=!>]|<[=!])"), "a look-around or an atomic group"),
    (re.compile(r"\\[1-9kQEGZzAhHRXN]"), "a back-reference or an anchor of Java's own"),
)


def unsupported(pattern):
    """What a pattern holds that ``portable`` does not translate, or None."""
    body = pattern[4:] if pattern.startswith("(?i)") else pattern
    # A backslash takes the next character out of consideration, but for escapes.
    bare = re.sub(r"\\[^1-9kQEGZzAhHRXN]", "..", body)
    if pattern.startswith("(?i)") and re.search(r"\\(?:x|u)", body):
        return "an escaped character in a caseless pattern"
    return next((what for test, what in _UNSUPPORTED if test.search(bare)), None)


_TOKEN = re.compile(
    r"""
      (?P<class>\[\^?\]?(?:\\.|[^\]\\])*\])
    | (?P<escape>\\(?:[xpPu]\{[^}]*\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[pP][A-Z]|.))
    | (?P<group>\(\?(?::|P?<[A-Za-z][A-Za-z0-9]*>))
    | (?P<other>.)
    """,
    re.VERBOSE | re.DOTALL,
)
_CLASS_ITEM = re.compile(
    r"(?P<low>\\(?:[xpPu]\{[^}]*\}|x[0-9A-Fa-f]{2}|.)|[^\\])(?:-(?P<high>[^\\]))?", re.DOTALL
)


def portable(pattern):
    """Rewrite a rule pattern so that Java matches what the rule dialect means."""
    caseless = pattern.startswith("(?i)")
    body = pattern[4:] if caseless else pattern
    rewritten = "".join(_rewrite(token, caseless) for token in _TOKEN.finditer(body))
    return (_first_letters(body) if caseless else "") + rewritten


# A pattern that opens with alternative words.
_WORDS_FIRST = re.compile(r"\(\?:((?:[A-Za-z][^()|\\]*)(?:\|[A-Za-z][^()|\\]*)*)\)(?![?*{])")


def _first_letters(body):
    """Look-ahead for the first letter, tested once instead of once per alternative."""
    opening = _WORDS_FIRST.match(body)
    if not opening or re.search(r"(?:^|\|).[?*{]", opening.group(1)):
        return ""
    letters = dict.fromkeys(word[0].lower() for word in opening.group(1).split("|"))
    return "(?=[" + "".join(map(_case_variants, letters)) + "])"


def _rewrite(token, caseless):
    text = token.group()
    if token.lastgroup == "class":
        return _rewrite_class(text, caseless)
    if token.lastgroup == "escape":
        return _ESCAPES.get(text, text)
    if token.lastgroup == "group":
        return "(?:" if text == "(?:" else "("
    if text == ".":
        return r"[^\n]"
    if text == "$":
        return r"\z"
    if caseless and text.isalpha():
        return "[" + _case_variants(text) + "]"
    return text


_ESCAPES = {
    r"\s": SPACE,
    r"\S": r"\P{IsWhite_Space}",
    r"\d": r"\p{Nd}",
    r"\D": r"\P{Nd}",
    r"\w": f"[{WORD}]",
    r"\W": f"[^{WORD}]",
    r"\b": r"(?U:\b)",
    r"\B": r"(?U:\B)",
    r"\v": r"\x0B",
    r"\a": r"\x07",
}
_CLASS_ESCAPES = {r"\s": SPACE, r"\d": r"\p{Nd}", r"\w": WORD, r"\v": r"\x0B", r"\a": r"\x07"}


def _rewrite_class(text, caseless):
    negated = text.startswith("[^")
    body = text[2 if negated else 1:-1]
    items = []
    for item in _CLASS_ITEM.finditer(body):
        low, high = item.group("low"), item.group("high")
        if high is None:
            low = _CLASS_ESCAPES.get(low, "\\[" if low == "[" else low)
            items.append(_case_variants(low) if caseless and low.isalpha() else low)
        else:
            items.append(f"{low}-{high}")
            if caseless:
                items.append(_range_variants(low, high))
    return ("[^" if negated else "[") + "".join(items) + "]"


def _case_variants(letter):
    variants = dict.fromkeys(
        form for form in (letter, letter.lower(), letter.upper()) if len(form) == 1
    )
    return "".join(variants) + _FOLDS_TO_ASCII.get(letter.lower(), "")


def _range_variants(low, high):
    extra = ""
    for first, last, swap in (("a", "z", str.upper), ("A", "Z", str.lower)):
        start, end = max(low, first), min(high, last)
        if start <= end:
            extra += f"{swap(start)}-{swap(end)}"
            extra += "".join(
                fold for letter, fold in _FOLDS_TO_ASCII.items()
                if start.lower() <= letter <= end.lower()
            )
    return extra
