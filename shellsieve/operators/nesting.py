"""Commands of a shell text by an automaton with a stack.

The text is cut into tokens, and one fold over them carries a stack of contexts: code, quotes,
substitutions, arithmetic, here-documents, case arms, tests, arrays. What a word is is decided
where it ends, by the context it stands in, so nesting may go to any depth. The result is
the text with a marker before each known name in command position, or NULL for a text that
ends within a quote, which is no shell program.

Contexts, the innermost last in the stack: ``c`` the text itself, ``s`` parentheses, ``k``
backticks, ``B`` commands of a case arm (these four are code); ``F`` the parentheses of a
function, ``C`` what case looks at, ``P`` patterns of an arm, ``x`` a test in double brackets, ``A`` an
array or a pattern group (words without commands); ``d`` ``q`` ``Q`` double, single and ANSI quotes;
``a`` ``b`` arithmetic, ``p`` a parameter, ``h`` ``H`` a here-document with and without substitutions, ``#`` a
comment.
"""

from pyspark.sql import functions as F

from shellsieve.functions.positions import MARK, STAND_IN, STOP

_TOKEN = (
    r"\\(?:\r?\n|(?s:.))?|\$(?:\(\(?|['\"{])?|<<<|<<-?|[<>]\(|&>>?|[<>]&|>[>|]|<>|[<>]"
    r"|;;&|;[;&]?|&&?|\|[|&]?|\n|[ \t\r\f\x0B]+|\(\(?|[)`'\"{}#=]"
    r"|[^\\$<>;&|\n \t\r\f\x0B()`'\"{}#=]+"
)
# What the automaton can see otherwise than the patterns do.
_NESTS = r"[`({]|<<|\bcase\b|\bfunction\b|\[\["
_OPENED = r"<<-?[ \t]*+['\"\\]?([^\s'\"\;&|<>()]++)"

_CODE, _WORDS = "'cskB'", "'cskBFCPxA'"
_DELIMITERS = "' \t\r\f\x0B\n;&|<>()'"
_KEEPING = "'then', 'elif', 'else', 'do', 'if', 'while', 'until', '!', '{'"

# State: stack; in a word; the word if it is one token; whether a command may come (2: after the name of
# a function to come); token the word began with; 1 or 2 after a first word (2: a hit); token before;
# here-document word being read; here-documents to come; line of a here-document; hits, lately and before.
_FIELDS = {
    "st": "'c'", "wd": "0", "w": "''", "cm": "1", "wi": "0", "ju": "0", "pv": "''",
    "hd": "CAST(NULL AS STRING)", "dq": "CAST(array() AS ARRAY<STRING>)", "ln": "''",
    "rec": "CAST(array() AS ARRAY<INT>)", "old": "CAST(array() AS ARRAY<ARRAY<INT>>)", "i": "0",
}


def _state(of=None, **changes):
    """A state: the first one, or ``of`` with changes."""
    values = {name: f"{of}.{name}" if of else first for name, first in _FIELDS.items()} | changes
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in values.items()) + ")"


def _cases(*arms, other):
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in arms) + f" ELSE {other} END"


def _with(value, name, body):
    """``body`` with ``name`` for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_TOP = "right({s}.st, 1)"
_POPPED = "left({s}.st, length({s}.st) - 1)"


def _in(contexts, s):
    return f"instr({contexts}, {_TOP.format(s=s)}) > 0"


def _pushed(s, what, **changes):
    return _state(s, st=f"concat({s}.st, '{what}')", **changes)


def _swapped(s, what, **changes):
    return _state(s, st=f"concat({_POPPED.format(s=s)}, '{what}')", **changes)


def _dropped(s, **changes):
    return _state(s, st=_POPPED.format(s=s), **changes)


def _delimiter(s):
    return (
        f"(instr({_DELIMITERS}, left(t, 1)) > 0 OR t IN ('\\\\\n', '\\\\\r\n')"
        f" OR (t = '`' AND {_TOP.format(s=s)} = 'k'))"
    )


def _word_ended(s, names):
    """The word before a delimiter decides."""
    hits = _state(
        s, wd="0", cm="0", ju="2",
        rec=f"CASE WHEN size({s}.rec) >= 256 THEN array({s}.wi) ELSE array_append({s}.rec, {s}.wi) END",
        old=f"CASE WHEN size({s}.rec) >= 256 THEN array_append({s}.old, {s}.rec) ELSE {s}.old END",
    )
    top = _TOP.format(s=s)
    return _cases(
        (f"{s}.cm = 2", _state(s, wd="0", cm="1", ju="0")),
        (
            f"{s}.cm = 1 AND {_in(_CODE, s)}",
            _cases(
                (f"{s}.w IN ({_KEEPING})", _state(s, wd="0", ju="0")),
                (f"{s}.w IN ({names})", hits),
                (f"{s}.w = 'function'", _state(s, wd="0", cm="2", ju="0")),
                (f"{s}.w = 'case'", _pushed(s, "C", wd="0", cm="0", ju="0")),
                (f"{s}.w = '[['", _pushed(s, "x", wd="0", cm="0", ju="0")),
                (f"{s}.w = 'esac' AND {top} = 'B'", _dropped(s, wd="0", cm="0", ju="0")),
                other=_state(s, wd="0", cm="0", ju="1"),
            ),
        ),
        (f"{top} = 'C' AND {s}.w = 'in'", _swapped(s, "P", wd="0", ju="0")),
        (
            f"({top} = 'P' AND {s}.w = 'esac') OR ({top} = 'x' AND {s}.w = ']]')",
            _dropped(s, wd="0", cm="0", ju="0"),
        ),
        other=_state(s, wd="0", ju="0"),
    )


def _opening(s, **changes):
    """What opens a substitution in code, strings, arithmetic and here-documents."""
    return (
        ("t = '$('", _pushed(s, "s", cm="1", wd="0", ju="0", **changes)),
        ("t = '$(('", _pushed(s, "ab", **changes)),
        ("t = '${'", _pushed(s, "p", **changes)),
        (
            f"t = '`' AND {s}.st RLIKE 'k[dpabh]*$'",
            _state(s, st=f"regexp_replace({s}.st, 'k[dpabh]*$', '')", wd="1", w="''", cm="0"),
        ),
        ("t = '`'", _pushed(s, "k", cm="1", wd="0", ju="0", **changes)),
    )


def _document_line(s):
    """The end of a line of a here-document."""
    line = f"CASE WHEN left({s}.dq[0], 1) = '-' THEN ltrim('\t', {s}.ln) ELSE {s}.ln END"
    rest = f"slice({s}.dq, 2, greatest(size({s}.dq) - 1, 0))"
    return _cases(
        (f"{line} <> substring({s}.dq[0], 3)", _state(s, ln="''")),
        (f"size({s}.dq) > 1", _swapped(s, "' || " + _body(f"{s}.dq[1]") + " || '", dq=rest, ln="''")),
        other=_dropped(s, dq=rest, ln="''", cm="1", wd="0", ju="0"),
    )


def _body(document):
    return f"CASE WHEN substring({document}, 2, 1) = 'q' THEN 'H' ELSE 'h' END"


def _line_ended(s):
    return _cases(
        (
            f"{_in(_CODE, s)} AND size({s}.dq) > 0",
            _pushed(s, "' || " + _body(f"{s}.dq[0]") + " || '", ln="''", cm="1", wd="0", ju="0"),
        ),
        (_in(_CODE, s), _state(s, cm="1", wd="0", ju="0")),
        other=_state(s, wd="0", ju="0"),
    )


def _in_words(s):
    """A token where words and commands are."""
    top, code = _TOP.format(s=s), _in(_CODE, s)
    part = {"wd": "1", "w": "''", "wi": f"CASE WHEN {s}.wd = 0 THEN {s}.i ELSE {s}.wi END", "ju": "0"}
    without_hit = f"CASE WHEN {s}.ju = 2 THEN slice({s}.rec, 1, greatest(size({s}.rec) - 1, 0)) ELSE {s}.rec END"
    return _cases(
        ("t = '\n'", _line_ended(s)),
        (
            "left(t, 1) IN (' ', '\t', '\r', '\f', '\x0B') OR t IN ('\\\\\n', '\\\\\r\n')",
            _state(s, wd="0"),
        ),
        (f"left(t, 2) IN (';;', ';&') AND {top} = 'B'", _swapped(s, "P", cm="0", wd="0", ju="0")),
        (
            "left(t, 1) IN (';', '|') OR t IN ('&', '&&')",
            _cases((code, _state(s, cm="1", wd="0", ju="0")), other=_state(s, wd="0", ju="0")),
        ),
        (f"t IN ('<<', '<<-') AND {code}", _state(s, cm="0", wd="0", ju="0", hd="CASE t WHEN '<<-' THEN '- ' ELSE '  ' END")),
        (f"t IN ('<(', '>(') AND {top} <> 'x'", _pushed(s, "s", cm="1", wd="0", ju="0")),
        ("left(t, 1) IN ('<', '>') OR left(t, 2) = '&>'", _state(s, cm="0", wd="0", ju="0")),
        (
            f"t = '(' AND {s}.wd = 1 AND ({top} = 'A' OR right({s}.pv, 1) IN ('=', '?', '*', '+', '@', '!'))",
            _pushed(s, "A", wd="0", ju="0"),
        ),
        (
            f"t = '(' AND {code} AND (({s}.wd = 1 AND {s}.cm > 0) OR {s}.ju > 0)",
            _pushed(s, "F", wd="0", cm="0", ju="0", rec=without_hit),
        ),
        (f"t = '(' AND {code}", _pushed(s, "s", cm="1", wd="0", ju="0")),
        (f"t = '((' AND {code}", _pushed(s, "ab", cm="0", ju="0")),
        (f"left(t, 1) = '(' AND {top} = 'A'", _state(s, st=f"concat({s}.st, repeat('A', length(t)))", wd="0")),
        (
            "t = ')'",
            _cases(
                (f"{top} = 's'", _dropped(s, cm="0", wd="1", w="''", ju="0")),
                (f"{top} = 'F'", _dropped(s, cm="1", wd="0", ju="0")),
                (f"{top} = 'A'", _dropped(s, wd="1", w="''", ju="0")),
                (f"{top} = 'P'", _swapped(s, "B", cm="1", wd="0", ju="0")),
                other=_state(s, wd="0", ju="0"),
            ),
        ),
        (f"t = '`' AND {top} = 'k'", _dropped(s, cm="0", wd="1", w="''", ju="0")),
        *_opening(s),
        ("t IN ('\\'', '$\\'')", _pushed(s, "' || CASE t WHEN '\\'' THEN 'q' ELSE 'Q' END || '", **part)),
        ("t IN ('\"', '$\"')", _pushed(s, "d", **part)),
        (f"t = '#' AND {s}.wd = 0", _pushed(s, "#")),
        (f"{s}.wd = 0", _state(s, wd="1", w="t", wi=f"{s}.i", ju="0")),
        other=_state(s, w="''"),
    )


def _token_read(s):
    """The token by the context it stands in."""
    top = _TOP.format(s=s)
    below = f"substring({s}.st, -2, 1)"
    line_end = "t = '\n'"
    in_word = {"wd": "1", "w": "''"}
    return _cases(
        (_in(_WORDS, s), _in_words(s)),
        (f"{top} = 'q'", _cases(("right(t, 1) = '\\''", _dropped(s)), other=s)),
        (f"{top} = 'Q'", _cases(("t = '\\''", _dropped(s)), other=s)),
        (
            f"{top} = 'd'",
            _cases(("t IN ('\"', '$\"')", _dropped(s, **in_word)), *_opening(s), other=s),
        ),
        (
            f"{top} = 'p'",
            _cases(
                ("t = '}'", _dropped(s, **in_word)),
                ("t IN ('\"', '$\"')", _pushed(s, "d")),
                (f"t IN ('\\'', '$\\'') AND {below} NOT IN ('d', 'h')", _pushed(s, "q")),
                *_opening(s),
                other=s,
            ),
        ),
        (
            f"{top} IN ('a', 'b')",
            _cases(
                ("t = ')'", _dropped(s, **in_word)),
                ("left(t, 1) = '('", _state(s, st=f"concat({s}.st, repeat('b', length(t)))")),
                ("t IN ('\"', '$\"')", _pushed(s, "d")),
                *_opening(s),
                other=s,
            ),
        ),
        (
            f"{top} = 'h'",
            _cases(
                (line_end, _document_line(s)),
                *_opening(s, ln="'\\\\'"),
                other=_state(s, ln=f"CASE WHEN length({s}.ln) > 256 THEN {s}.ln ELSE concat({s}.ln, t) END"),
            ),
        ),
        (
            f"{top} = 'H'",
            _cases(
                (line_end, _document_line(s)),
                ("t IN ('\\\\\n', '\\\\\r\n')", _state(s, ln="''")),
                other=_state(s, ln=f"CASE WHEN length({s}.ln) > 256 THEN {s}.ln ELSE concat({s}.ln, t) END"),
            ),
        ),
        # A comment.
        ("t = '\n' OR t IN ('\\\\\n', '\\\\\r\n')", _with(_dropped(s), "ended", _line_ended("ended"))),
        (f"t = '`' AND {below} = 'k'", _state(s, st=f"left({s}.st, length({s}.st) - 2)", wd="1", w="''", cm="0")),
        other=s,
    )


def _document_word(s):
    """A token of the word that ends a here-document."""
    return _cases(
        ("t IN ('\\'', '\"', '$\\'', '$\"')", _state(s, hd=f"concat(left({s}.hd, 1), 'q', substring({s}.hd, 3))")),
        ("left(t, 1) = '\\\\'", _state(s, hd=f"concat(left({s}.hd, 1), 'q', substring({s}.hd, 3), substring(t, 2))")),
        other=_state(s, hd=f"concat({s}.hd, t)"),
    )


def _step(names):
    read = _with(
        _cases(
            (
                "s0.hd IS NOT NULL AND array_contains(ends.words, substring(s0.hd, 3))",
                _state("s0", hd=_FIELDS["hd"], dq="array_append(s0.dq, s0.hd)"),
            ),
            ("s0.hd IS NOT NULL", _state("s0", hd=_FIELDS["hd"])),
            other="s0",
        ),
        "s1",
        _with(
            _cases(
                (f"s1.wd = 1 AND t <> '(' AND {_in(_WORDS, 's1')} AND {_delimiter('s1')}", _word_ended("s1", names)),
                other="s1",
            ),
            "s2", _token_read("s2"),
        ),
    )
    step = _cases(
        ("s0.hd IS NOT NULL AND length(s0.hd) = 2 AND left(t, 1) IN (' ', '\t')", "s0"),
        (f"s0.hd IS NOT NULL AND NOT {_delimiter('s0')}", _document_word("s0")),
        other=read,
    )
    return _with(step, "s9", _state("s9", i="s0.i + 1", pv="t"))


def _quoted(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def may_nest(text):
    """Cheap test for what only the automaton sees rightly."""
    return text.rlike(_NESTS)


def nested_commands(text_col, names):
    """The text in ``text_col`` with a marker before every command in ``names``.

    NULL if it ends within a quote.
    """
    text = "`" + text_col.replace("`", "``") + "`"
    clean = f"replace(replace({text}, '{MARK}', '{STAND_IN}'), '{STOP}', '{STAND_IN}')"
    opened = f"regexp_extract_all({clean}, {_quoted(_OPENED)}, 1)"
    lines = f"transform(split({clean}, '\n'), line -> ltrim('\t', line))"
    ends = f"CASE WHEN contains({text}, '<<') THEN array_intersect({opened}, {lines}) ELSE CAST(array() AS ARRAY<STRING>) END"
    tokens = f"regexp_extract_all({clean}, {_quoted('(' + _TOKEN + ')')}, 1)"
    # The closing line end ends the last word, and no more than that.
    fold = f"aggregate(array_append(found.tokens, '\n'), {_state()}, (s0, t) -> {_step(', '.join(map(_quoted, names)))})"
    # The tokens between two hits are put together again.
    at = "concat(array(0), flatten(last.old), last.rec, array(size(found.tokens)))"
    piece = "array_join(slice(found.tokens, start + 1, at[n + 1] - start), '')"
    marked = _with(
        at, "at", f"array_join(transform(slice(at, 1, size(at) - 1), (start, n) -> {piece}), '{MARK}')"
    )
    last = f"CASE WHEN last.st RLIKE '[dqQ]' THEN CAST(NULL AS STRING) ELSE {marked} END"
    folded = _with(f"named_struct('words', {ends})", "ends", _with(fold, "last", last))
    return F.expr(_with(f"named_struct('tokens', {tokens})", "found", folded))
