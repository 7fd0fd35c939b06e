"""Where each match of a pattern lies in a text, as column expressions.

One ``regexp_replace`` puts a marker before every match and one ``split`` cuts the text
there, so piece 0 is the text before the first match and piece i starts with match i.
What a piece adds to the position is (line breaks, size of the text after the last line
break), and adding two pieces up is associative. ``_running`` therefore scans the pieces
by doubling strides: m matches cost m log m element steps inside the row, without a
window, a shuffle or a UDF, and the text itself never leaves its task.
"""

from pyspark.sql import functions as F

MARK = "\ufdd0"
# Ends a match where a search also matches what it passes over.
STOP = "\ufdd1"
# Takes the place of a marker that occurs in the text itself. All are unassigned
# noncharacters of the same size, so positions and matches stay the same.
STAND_IN = "\ufddf"

_STRIDES = "array(" + ", ".join(str(1 << bit) for bit in range(31)) + ")"


def let(value, body):
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def without_marks(text):
    return F.replace(
        F.replace(text, F.lit(MARK), F.lit(STAND_IN)), F.lit(STOP), F.lit(STAND_IN)
    )


def has_marks(text):
    return F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(STOP))


def marked_before(text, pattern):
    return F.regexp_replace(text, F.lit(pattern), F.lit(MARK + "$0"))


def marked_by_line(text, pattern, loose=None):
    """As ``marked_before``, for a pattern of the groups skip and hit.

    ``loose`` is a second pattern, looked for outside the matches of the first.
    """
    replacement = "${skip}" + MARK + "${hit}" + STOP

    def marked(text, pattern):
        found = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
        return F.replace(found, F.lit(MARK + STOP), F.lit(""))

    found = marked(text, pattern)
    if loose:
        found = marked(found, f"(?<skip>{MARK}[^{STOP}]*+{STOP})|(?<hit>{loose})")
    return F.replace(found, F.lit(STOP), F.lit(""))


def pieces_of(marked):
    return F.split(marked, MARK)


def match_starts(pieces, in_bytes=None):
    """Array of ``(line, column)``, 1-based, one per match.

    The column counts characters, or bytes where the column ``in_bytes`` is true.
    """

    def step(piece):
        def sized(lines):
            tail = F.element_at(lines, -1)
            size = F.length(tail)
            if in_bytes is not None:
                size = F.when(in_bytes, F.octet_length(tail)).otherwise(size)
            return F.struct((F.size(lines) - 1).alias("breaks"), size.alias("tail"))

        return let(F.split(piece, "\n"), sized)

    steps = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), step)
    return F.transform(
        let(steps, _running),
        lambda at: F.struct(
            (at["breaks"] + 1).cast("long").alias("line"),
            (at["tail"] + 1).cast("long").alias("column"),
        ),
    )


def _running(steps):
    """Running combination of ``steps``: element i covers steps 0..i."""
    doubled = F.aggregate(
        F.filter(F.expr(_STRIDES), lambda stride: stride < F.size(steps)),
        steps,
        lambda reached, stride: F.transform(
            reached,
            lambda step, i: F.when(i < stride, step).otherwise(
                _joined(F.get(reached, i - stride), step)
            ),
        ),
    )
    return F.when(F.size(steps) > 1, doubled).otherwise(steps)


def _joined(before, after):
    return F.struct(
        (before["breaks"] + after["breaks"]).alias("breaks"),
        F.when(after["breaks"] > 0, after["tail"])
        .otherwise(before["tail"] + after["tail"])
        .alias("tail"),
    )
