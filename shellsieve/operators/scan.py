"""The scan: a table of texts in, one row per match of a rule out.

Everything about a text is worked out inside its own row, so the scan is a projection and
one explode: no shuffle, no UDF, and it runs unchanged on streams. Only findings leave the
task, never the text.
"""

from pyspark.sql import functions as F

from shellsieve.catalog import active_rules, builtin_rules, check_pattern, rules_table
from shellsieve.functions.levels import risk_rank, risk_score
from shellsieve.functions.positions import (
    has_marks, let, marked_before, marked_by_line, match_starts, pieces_of, without_marks,
)
from shellsieve.functions.text import lines_of, snippet_at
from shellsieve.operators.commands import marked_commands, may_hold_command, name_at_start

# Columns of the text under scan, its lower-case form, and what was found in it.
TEXT, FOLDED, HITS, _LINES = "__text", "__folded", "__hits", "__lines"
_HAS_MARK, _COMMAND_GATE = "__has_mark", "__may_command"

# The one character outside ASCII that lower() does not bring to the ASCII letter it folds to.
_LONG_S = "\u017f"


def matches(texts, rules, text_col="content", keep=(), snippet=False, value=False):
    """One row per match: ``keep`` columns, rule_id, match_no, line, column.

    ``snippet`` adds the lines around the match, ``value`` the text of the pattern's first
    group (of the whole match where there is none). ``rules`` must be active rules.
    """
    keep = list(keep)
    if not rules:
        return _no_matches(texts, keep, snippet, value)
    hits = _all_hits(F.col(TEXT), rules, value).alias(HITS)
    found = prepared(texts, rules, text_col, keep)
    extra = []
    if snippet:
        # The lines go through the explode once; a snippet is cut for one match at a time.
        lines = F.when(F.size(HITS) > 0, lines_of(F.col(TEXT)))
        found = found.select(*keep, TEXT, hits).select(*keep, HITS, lines.alias(_LINES))
        extra = [snippet_at(F.col(_LINES), F.col(f"{HITS}.line")).alias("code_snippet")]
    else:
        found = found.select(*keep, hits)
    return (
        # Outer, then filtered: a plain explode would have its input evaluated a second
        # time by an inferred "array is not empty" filter below the projection.
        found.select(*keep, F.explode_outer(HITS).alias(HITS), *([_LINES] if snippet else []))
        .where(F.col(HITS).isNotNull())
        .select(*keep, f"{HITS}.*", *extra)
    )


def scan(scripts, rules=None, min_risk=None, id_col="path", text_col="content", keep=(),
         snippet=True):
    """Findings of ``scripts`` in the ``FINDINGS`` schema, preceded by ``keep`` columns."""
    active = active_rules(builtin_rules() if rules is None else rules, min_risk)
    for rule in active:
        check_pattern(rule)
    columns = list(dict.fromkeys([*keep, id_col]))
    found = matches(scripts, active, text_col, columns, snippet=snippet)
    return describe(found, active, id_col, keep, snippet)


def describe(found, rules, id_col="path", keep=(), snippet=True):
    """Attach type, level, texts and score of the rule to every match."""
    rules_df = rules_table(found.sparkSession, rules).drop(
        "kind", "pattern", "command_name", "enabled"
    )
    # The rule list is a Python list that was just turned into literals: its size is known.
    described = found.join(F.broadcast(rules_df), "rule_id").withColumn(
        "file_path", F.col(id_col).cast("string")
    )
    return described.select(
        *keep,
        "finding_type",
        "risk_level",
        "file_path",
        "line",
        "column",
        *(["code_snippet"] if snippet else []),
        "description",
        "recommendation",
        risk_score(F.col("risk_level"), F.col("file_path"), F.col("line"), F.col("column"),
                   F.col("rule_id")).alias("risk_score"),
        "rule_id",
        risk_rank(F.col("risk_level")).alias("risk_rank"),
        "phase",
        "rule_no",
    )


def _all_hits(text, rules, value):
    """All matches of a text in discovery order.

    Every rule contributes the text with a marker before each of its matches; positions
    are then worked out by one expression for all rules. Rules take turns, so that only
    one marked copy of the text is held.
    """
    commands = {rule.command_name: rule.rule_id for rule in rules if rule.kind == "command"}
    names = list(commands)
    marked = [_marked_by_rule(text, rule, value) for rule in rules if rule.kind == "regex"]
    if commands:
        marked.insert(0, if_commands_possible(_marked(
            None, marked_commands(TEXT, names), F.lit(None).cast("array<string>"), value)))

    def hits(rule, pieces):
        by_command = rule["rule_id"].isNull()
        starts = match_starts(pieces, in_bytes=by_command if commands else None)

        def hit(at, i):
            rule_id, matched = rule["rule_id"], F.get(rule["values"], i) if value else None
            if commands:
                name = name_at_start(F.get(pieces, i + 1), names)
                rule_id = F.when(by_command, _lookup(commands)[name]).otherwise(rule_id)
                if value:
                    matched = F.when(by_command, name).otherwise(matched)
            columns = [
                rule_id.alias("rule_id"),
                (i + 1).cast("long").alias("match_no"),
                at["line"].alias("line"),
                at["column"].alias("column"),
            ]
            return F.struct(*columns, *([matched.alias("value")] if value else []))

        return F.transform(starts, lambda at, i: hit(at, i))

    def turn(number):
        chosen = F.when(number == 0, marked[0])
        for i, other in enumerate(marked[1:], 1):
            chosen = chosen.when(number == i, other)
        # A marker makes the text longer.
        return let(chosen, lambda rule: F.when(
            F.octet_length(rule["marked"]) > F.octet_length(text),
            let(pieces_of(rule["marked"]), lambda pieces: hits(rule, pieces)),
        ))

    turns = F.transform(F.sequence(F.lit(0), F.lit(len(marked) - 1)), turn)
    return F.flatten(F.filter(turns, lambda found: found.isNotNull()))


def _marked_by_rule(text, rule, value):
    pattern = rule.java_pattern
    clean = clean_text(text)
    group = 1 if _has_group(pattern) else 0
    return if_possible(rule, _marked(
        rule.rule_id,
        marked_by_rule(clean, rule),
        F.regexp_extract_all(clean, F.lit(pattern), F.lit(group)) if value else None,
        value,
    ))


def marked_by_rule(text, rule):
    """``text`` with a marker before every match of a text rule."""
    if rule.by_line:
        return marked_by_line(text, *rule.by_line)
    return marked_before(text, rule.java_pattern)


def _marked(rule_id, marked, values, value):
    columns = [F.lit(rule_id).cast("string").alias("rule_id"), marked.alias("marked")]
    return F.struct(*columns, *([values.alias("values")] if value else []))


def command_names(names):
    """Array of the names of all commands in ``names``, in order, in a table made by ``prepared``."""
    pieces = pieces_of(marked_commands(TEXT, names))
    return F.transform(
        let(pieces, lambda p: F.slice(p, F.lit(2), F.size(p))),
        lambda piece: name_at_start(piece, names),
    )


def _lookup(mapping):
    return F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])


def _has_group(pattern):
    escaped = False
    in_class = False
    for i, char in enumerate(pattern):
        if escaped:
            escaped = False
        elif char == "\\":
            escaped = True
        elif in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
        elif char == "(" and pattern[i + 1:i + 2] != "?":
            return True
    return False


def prepared(texts, rules, text_col, keep):
    """``keep`` columns, the text, and per rule whether it can match the text at all.

    These tests stay in a projection of their own, where they are compiled; the array
    functions above it are not. A literal that several rules need is looked for once, and
    texts are folded to lower case only where a caseless rule still can match.
    """
    shared = _shared_literals(rules)
    # A text that could not be read has no findings, and how it was found need not be worked out.
    base = texts.where(F.col(text_col).isNotNull()).select(*keep, F.col(text_col).alias(TEXT)).select(
        "*", *[F.contains(TEXT, F.lit(literal)).alias(name) for literal, name in shared.items()]
    )
    caseless = [_raw_condition(rule, shared) for rule in rules if rule.caseless]
    folded = F.lower(TEXT)
    if not caseless:
        folded = F.lit(None).cast("string")
    elif all(caseless):
        folded = F.when(
            F.expr(" OR ".join(f"({test})" for test in dict.fromkeys(caseless))), folded
        )
    gates = [
        F.expr(_needs_condition(rule, shared)).alias(_gate_name(rule))
        for rule in rules if rule.kind == "regex" and rule.needs
    ]
    names = [rule.command_name for rule in rules if rule.kind == "command"]
    if names:
        gates.append(may_hold_command(F.col(TEXT), names).alias(_COMMAND_GATE))
    return base.withColumn(FOLDED, folded).select(
        *keep, TEXT, has_marks(F.col(TEXT)).alias(_HAS_MARK), *gates
    )


def clean_text(text):
    """The text of a table made by ``prepared``, without the scan's own marker."""
    return F.when(F.col(_HAS_MARK), without_marks(text)).otherwise(text)


def if_possible(rule, value):
    """``value`` where ``prepared`` found that ``rule`` can match, else NULL."""
    return F.when(F.col(f"`{_gate_name(rule)}`"), value) if rule.needs else value


def if_commands_possible(value):
    return F.when(F.col(_COMMAND_GATE), value)


def _gate_name(rule):
    return "__may_" + rule.rule_id.replace("`", "")


def _needs_condition(rule, shared):
    """Cheap literal test that every text with a match passes."""
    conditions = [_raw_condition(rule, shared)]
    folded = [group for group in rule.needs if rule.caseless and _has_letters(group)]
    if folded:
        tests = " AND ".join(_any_literal(FOLDED, group, {}) for group in folded)
        conditions.append(f"({tests} OR contains({TEXT}, '{_LONG_S}'))")
    return " AND ".join(filter(None, conditions))


def _raw_condition(rule, shared):
    """The tests of a rule that do not depend on letter case."""
    groups = [group for group in rule.needs if not (rule.caseless and _has_letters(group))]
    return " AND ".join(_any_literal(TEXT, group, shared) for group in groups)


def _shared_literals(rules):
    """Literals that more than one rule needs, with the name of their column."""
    single = [
        group[0] for rule in rules for group in rule.needs
        if len(group) == 1 and not (rule.caseless and _has_letters(group))
    ]
    repeated = [literal for literal in dict.fromkeys(single) if single.count(literal) > 1]
    return {literal: f"__has_{i}" for i, literal in enumerate(repeated)}


def _any_literal(source, group, shared):
    def quoted(literal):
        return "'" + literal.replace("\\", "\\\\").replace("'", "\\'") + "'"

    tests = [shared.get(one) or f"contains({source}, {quoted(one)})" for one in group]
    return "(" + " OR ".join(tests) + ")"


def _has_letters(group):
    return any(char.isalpha() for literal in group for char in literal)


def _no_matches(texts, keep, snippet, value):
    names = ["rule_id string", "match_no bigint", "line bigint", "column bigint"]
    names += ["value string"] if value else []
    names += ["code_snippet string"] if snippet else []
    added = [F.lit(None).cast(n.split()[1]).alias(n.split()[0]) for n in names]
    return texts.select(*keep, *added).where(F.lit(False))
