"""Simple commands of a shell text, found with patterns.

Three replacements do the work. The first marks what needs a closer look: here-documents
and the double-quoted strings that hold a command substitution. The second marks the
substitutions in there. The third walks over everything that is not code and puts a
marker before each known name in command position. They stand in for a syntax tree, so
the result is an approximation; README.md lists where it differs from a real parse.
"""

import re

from pyspark.sql import functions as F

from shellsieve.functions.positions import MARK, let, match_starts, pieces_of, without_marks
from shellsieve.operators.nesting import may_nest, nested_commands

# After a command name; around a here-document taken as it is; around a region in which
# only substitutions are code; around a substitution in such a region. Control characters
# keep the character classes below within Latin-1, which Java tests with a bit set.
_NAME_END = "\x01"
_RAW, _RAW_END = "\x02", "\x03"
_REGION, _REGION_END = "\x04", "\x05"
_CODE, _CODE_END = "\x06", "\x07"
_ANY_MARK = "[" + _NAME_END + _RAW + _RAW_END + _REGION + _REGION_END + _CODE + _CODE_END + "]"
_INSTEAD_OF_MARK = "\x08"

_ESCAPED = r"\\(?s:.)"
_ANSI_QUOTED = r"\$'(?:[^'\\]++|\\(?s:.))*+'"
_QUOTED = r"'[^']*+'"
_STRING = r'"(?:[^"\\]++|\\(?s:.))*+"'
_COMMENT = r"#(?<![^\s;&|()]#)[^\n]*+"
_REGEX_OPERAND = r"=~[ \t]++\S++"
_ARITHMETIC = r"\(\((?:[^()\n]++|\([^()\n]*+\))*+\)\)"
_NO_CODE = (_ESCAPED, _ANSI_QUOTED, _QUOTED, _REGEX_OPERAND, _COMMENT)
_NOT_CODE = "|".join((*_NO_CODE, _ARITHMETIC))

_BACKTICKED = r"`(?:[^`\\]++|\\(?s:.))*+`"
_NESTED = rf"\((?:[^()\"'\\]++|{_ESCAPED}|{_STRING}|{_QUOTED})*+\)"
_DOLLAR_PAREN = rf"\$\((?:[^()\"'\\]++|{_ESCAPED}|{_STRING}|{_QUOTED}|{_NESTED})*+\)"
_SUBSTITUTION = f"(?:{_DOLLAR_PAREN}|{_BACKTICKED})"
_PLAIN_STRING = rf'"(?:[^"\\$`]++|{_ESCAPED}|\$(?!\())*+"'
_PLAIN_ARITHMETIC = r"\(\((?:[^()\n$`]++|\$(?!\()|\((?:[^()\n$`]++|\$(?!\())*+\))*+\)\)"
_SUBSTITUTING_ARITHMETIC = (
    rf"\(\((?:[^()\n$`]++|{_SUBSTITUTION}|\$(?!\()|\((?:[^()\n$`]++|{_SUBSTITUTION}|\$(?!\())*+\))*+\)\)"
)
_SUBSTITUTING_STRING = rf'"(?:[^"\\$`]++|{_ESCAPED}|{_SUBSTITUTION}|[$`])*+"'

# The rest of the opening line. A line is taken from its last opener on, so that a line
# full of shift operators is not searched once per operator.
_OPENING_LINE = r"[^\n<]*+(?:<(?!<)[^\n<]*+)*+"
# Stands for the words that end a here-document of the text at hand. A word that no line
# consists of opens none, and the rest of the text need not be searched for its end.
_END_WORDS, _NO_WORD = "END-WORDS", "(?!)"
_REGIONS = (
    rf"(?<skip>{'|'.join(_NO_CODE)}|{_PLAIN_STRING}|{_PLAIN_ARITHMETIC})"
    rf"|(?<rawopener>(?<!<)<<-?[ \t]*+['\"\\](?<rawend>(?:{_END_WORDS})(?!\w))['\"]?{_OPENING_LINE})"
    r"(?<raw>\n(?:(?s:.)*?\n)??\t*+\k<rawend>)(?=\n|\z)"
    rf"|(?<opener>(?<!<)<<-?[ \t]*+(?<end>(?:{_END_WORDS})(?!\w)){_OPENING_LINE})"
    r"(?<body>\n(?:(?s:.)*?\n)??\t*+\k<end>)(?=\n|\z)"
    rf"|(?<string>{_SUBSTITUTING_STRING}|{_SUBSTITUTING_ARITHMETIC})"
)
_REGIONS_MARKED = (
    "${skip}${rawopener}" + _RAW + "${raw}" + _RAW_END
    + "${opener}" + _REGION + "${body}${string}" + _REGION_END
)

# Every match ends before a region, or inside one right after a substitution; so what
# the next match starts with tells where it is.
_REGION_TEXT = (
    rf"{_REGION}?+(?:[^\\$`{_REGION}{_REGION_END}]++|{_ESCAPED}|(?!{_SUBSTITUTION})[$`])*+"
)
_SUBSTITUTIONS = (
    rf"(?<skip>\A[^{_REGION}]++|{_REGION_TEXT}{_REGION_END}[^{_REGION}]*+)"
    rf"|(?<text>{_REGION_TEXT})(?<code>{_SUBSTITUTION})"
)
_SUBSTITUTIONS_MARKED = "${skip}${text}" + _CODE + "${code}" + _CODE_END

_REGION_SKIPPED = (
    rf"{_RAW}[^{_RAW_END}]*+{_RAW_END}"
    rf"|[{_REGION}{_CODE_END}][^{_CODE}{_REGION_END}]*+(?:{_REGION_END}|(?={_CODE}))"
)

_BLANK = r"(?:[ \t]|\\\r?\n)"
_KEYWORDS = rf"(?:(?:then|elif|else|do|if|while|until|!|\{{){_BLANK}++)*+"
_START = (
    r"(?:(?<![^\n;&|`])(?<!\\\n)|(?<=\()(?<!=\()|(?<=[ \t)]\{)(?=\s))"
)
_CASE_WORD = r"""(?:[^\s()'"`;&|<>#$\\]++|"[^"\n]*+"|'[^'\n]*+')++"""
_CASE_ARM = (
    rf"(?:(?<![^\n])|(?<=;;)|(?<=[\s;]in[ \t]))[ \t\n]*+\(?{_CASE_WORD}"
    rf"(?:[ \t]*+\|[ \t]*+{_CASE_WORD})*+[ \t]*+\)"
)
_NAME_BEFORE = r"(?<![^ \t\n\r\f\x0B;&|`(){])"
_NAME_FOLLOW = r"(?=[ \t\n\r\f\x0B;&|)<>`]|\z)"


def _lead_pattern():
    return rf"(?<![^\n;&|`({{ \t)])(?>{_CASE_ARM}|{_START}){_BLANK}*+{_KEYWORDS}"


# Words on one line after a word that is no command; `in` may open a case arm.
_IN_WORD = rf"[^ \t\n\r;&|`({{\\$'\"){_ANY_MARK[1:-1]}]"
_WORDS = rf"(?:(?!in[ \t]|[=#]){_IN_WORD}++[ \t]*+)++"
_SKIPPED_AHEAD = rf"(?=[\\$'\"=(#{_RAW}{_REGION}{_CODE_END}])"


def _commands_pattern(names):
    name, lead = _any_of(names), _lead_pattern()
    return (
        rf"(?<skip>(?:{_SKIPPED_AHEAD}(?:{_REGION_SKIPPED}|{_NOT_CODE}|{_PLAIN_STRING})"
        rf"|(?!{lead}{name}{_NAME_FOLLOW})(?:{_CASE_ARM}|{_WORDS}|in(?=[ \t])|(?s:.)))++)"
        rf"|(?<lead>{lead})(?<name>{name}){_NAME_FOLLOW}"
    )


_COMMANDS_MARKED = "${skip}${lead}" + MARK + "${name}" + _NAME_END


def _any_of(names):
    ordered = sorted(names, key=lambda name: (-len(name), name))
    return "(?:" + "|".join(re.sub(r"([^\w])", r"\\\1", name) for name in ordered) + ")"


def _marked(text, pattern, replacement, *pairs):
    """Replace, then drop the mark pairs around groups that took no part in a match."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.regexp_replace(text, pattern, F.lit(replacement))
    for first, last in pairs:
        marked = F.replace(marked, F.lit(first + last), F.lit(""))
    return marked


def _end_words(text):
    """Alternatives of a pattern: words after an opener that are a line of their own."""
    opened = F.regexp_extract_all(text, F.lit(r"<<-?[ \t]*+['\"\\]?(\w++)"), F.lit(1))
    lines = F.transform(F.split(text, "\n"), lambda line: F.ltrim(line, F.lit("\t")))
    words = F.array_join(F.array_intersect(opened, lines), "|")
    return F.when(F.contains(text, F.lit("<<")) & (words != ""), words).otherwise(_NO_WORD)


def _with_regions(text):
    pattern = F.replace(F.lit(_REGIONS), F.lit(_END_WORDS), _end_words(text))
    marked = _marked(
        text, pattern, _REGIONS_MARKED, (_RAW, _RAW_END), (_REGION, _REGION_END)
    )
    nested = F.contains(text, F.lit("((")) & (
        F.contains(text, F.lit("$(")) | F.contains(text, F.lit("`"))
    )
    regions = text.rlike(r"\"[^\"]*(?:\$\(|`)|<<")
    return F.when(nested | regions, marked).otherwise(text)


def _with_substitutions(text):
    marked = _marked(text, _SUBSTITUTIONS, _SUBSTITUTIONS_MARKED, (_CODE, _CODE_END))
    return F.when(F.contains(text, F.lit(_REGION)), marked).otherwise(text)


def marked_commands(text_col, names):
    """The text in ``text_col`` with a marker before every command in ``names``.

    Texts that nest go through the automaton; the patterns take the others, and those that end
    within a quote, in which a quote that is not closed counts as any character.
    """
    text, pattern = F.col(quoted(text_col)), _commands_pattern(names)

    def marked(prepared):
        commands = _marked(prepared, pattern, _COMMANDS_MARKED, (MARK, _NAME_END))
        return F.regexp_replace(commands, _ANY_MARK, "")

    clean = without_marks(F.regexp_replace(text, _ANY_MARK, _INSTEAD_OF_MARK))
    by_pattern = let(
        clean, lambda t: let(_with_regions(t), lambda r: marked(let(r, _with_substitutions)))
    )
    nested = F.when(may_nest(text), nested_commands(text_col, names))
    return let(nested, lambda found: F.coalesce(found, by_pattern))


def quoted(name):
    """A column of exactly this name."""
    return "`" + name.replace("`", "``") + "`"


def may_hold_command(text, names):
    """Cheap test for a name between separators; every text with a command passes it."""
    return text.rlike(_NAME_BEFORE + _any_of(names) + _NAME_FOLLOW)


def name_at_start(piece, names):
    return F.regexp_extract(piece, "^" + _any_of(names), 0)


# What a command spans: up to an operator, a redirection, a comment or the line end.
_SPAN = (
    rf"(?:(?!(?<=\s)(?:#|\d{{1,9}}[<>]))(?:[^\n;&|<>()\"'`$\\]|{_ESCAPED}|{_ANSI_QUOTED}"
    rf"|{_SUBSTITUTING_STRING}|{_QUOTED}|{_SUBSTITUTION}|\$(?!\()))*+"
)
_WORD = (
    rf"(?:[^\s\"'`$\\]++|\\[^\n]|{_ANSI_QUOTED}|{_SUBSTITUTING_STRING}|{_QUOTED}"
    rf"|{_SUBSTITUTION}|\$\{{[^}}]*+\}}|\$)++"
)
_UNQUOTED_OR_STRING = rf'\A(?:(?:[^\s"\'`$\\]|\\[^\n])+|{_SUBSTITUTING_STRING})\z'


def arguments_at_start(piece, names):
    """Plain words and double-quoted strings after the name; nothing else is an argument."""
    span = F.regexp_extract(piece, rf"^{_any_of(names)}({_SPAN})", 1)
    words = F.regexp_extract_all(span, F.lit(_WORD), F.lit(0))
    return F.filter(words, lambda word: word.rlike(_UNQUOTED_OR_STRING))


def commands(scripts, names, id_col="path", text_col="content", keep=()):
    """One row per command in ``names``: name, position and arguments.

    The column counts bytes.
    """
    text = F.col(text_col)

    def hits(pieces):
        return F.transform(
            match_starts(pieces, in_bytes=F.lit(True)),
            lambda at, i: F.struct(
                F.get(pieces, i + 1).alias("piece"), at["line"].alias("line"),
                at["column"].alias("column"),
            ),
        )

    found = let(pieces_of(marked_commands(text_col, names)), lambda pieces: hits(pieces))
    return (
        scripts.select(*keep, id_col, F.when(may_hold_command(text, names), found).alias("__hits"))
        .select(*keep, id_col, F.explode_outer("__hits").alias("__hit"))
        .where(F.col("__hit").isNotNull())
        .select(*keep, id_col, name_at_start(F.col("__hit.piece"), names).alias("command_name"),
                "__hit.line", "__hit.column",
                arguments_at_start(F.col("__hit.piece"), names).alias("args"))
    )
