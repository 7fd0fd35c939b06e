"""The built-in rules and the operations on a rule list.

A rule list is plan-time configuration: levels, ignored rules and disabled rules act on
the list before a scan is built, so a rule that cannot contribute costs nothing.
"""

from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from shellsieve.functions.dialect import portable, unsupported
from shellsieve.functions.levels import rank_of
from shellsieve.schemas import FINDING_TYPES, RISK_LEVELS, RULES

COMMAND_PHASE = 0
CUSTOM_PHASE = 5


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str  # 'command' or 'regex'
    finding_type: str
    risk_level: str
    pattern: str | None = None
    command_name: str | None = None
    description: str = ""
    recommendation: str | None = None
    phase: int = CUSTOM_PHASE
    rule_no: int = 0
    enabled: bool = True
    # Text a match cannot do without: every group must have one member in the text. Groups
    # that are rare in ordinary text come first. Letters are lower-case in (?i) patterns.
    needs: tuple[tuple[str, ...], ...] = ()

    @property
    def risk_rank(self):
        return rank_of(self.risk_level)

    @property
    def caseless(self):
        return bool(self.pattern) and self.pattern.startswith("(?i)")

    @property
    def java_pattern(self):
        return portable(self.pattern)

    @property
    def by_line(self):
        """Pattern and loose alternative for a search that takes linear time, or None."""
        return _BY_LINE.get(self.pattern)


# Command name, level.
DANGEROUS_COMMANDS = [
    ("eval", "High"),
    ("source", "Medium"),
    ("exec", "High"),
    ("sudo", "Medium"),
    ("chmod", "Medium"),
    ("curl", "Medium"),
    ("wget", "Medium"),
    ("rm", "Medium"),
    (">", "Low"),
    ("base64", "Low"),
]

# Id, finding type, level, pattern.
TEXT_PATTERNS = [
    ("SEC01", "HardcodedSecret", "Critical",
     r"""(?i)(?:password|passwd|pwd)\s*=\s*['"](.*?)['"]"""),
    ("SEC02", "HardcodedSecret", "Critical",
     r"""(?i)(?:api[-_]?key|apikey|api[-_]?token|access[-_]?token|secret[-_]?key)\s*=\s*['"](.*?)['"]"""),
    ("SEC03", "HardcodedSecret", "Critical",
     r"""(?i)(?:private[-_]?key|ssh[-_]?key)\s*=\s*['"](.*?)['"]"""),
    ("SEC04", "HardcodedSecret", "Critical",
     r"""(?i)(?:aws[-_]?access[-_]?key[-_]?id)\s*=\s*['"](.*?)['"]"""),
    ("SEC05", "HardcodedSecret", "High",
     r"""https?://(?:[^:@/]+:[^:@/]+@)"""),
    ("INJ01", "CommandInjectionRisk", "Critical",
     r"""eval\s+[\$"].*\$\{?[a-zA-Z0-9_]+\}?"""),
    ("INJ02", "CommandInjectionRisk", "High",
     r"""(?:^|\s)(?:bash|sh)\s+-c\s+["']?.*\$\{?[a-zA-Z0-9_]+\}?"""),
    ("INJ03", "CommandInjectionRisk", "High",
     r"""(?:^|\s)(?:exec|system)\s+["']?.*\$\{?[a-zA-Z0-9_]+\}?"""),
    ("FIL01", "FilePermissionIssue", "Critical",
     r"""rm\s+-[rf]{1,2}\s+(?:/|\$HOME|\$\{HOME\}|~)"""),
    ("FIL02", "FilePermissionIssue", "High",
     r"""chmod\s+-[R]{0,1}\s+(?:777|a\+[rwx]{1,3})\s+["']?(?:/[^\s]+)"""),
    ("FIL03", "FilePermissionIssue", "High",
     r""">\s+/(?:etc|bin|sbin|usr|var)/"""),
    ("NET01", "InsecureNetworkAccess", "High",
     r"""curl\s+.*--insecure|-k"""),
    ("NET02", "InsecureNetworkAccess", "High",
     r"""wget\s+.*--no-check-certificate"""),
    ("NET03", "InsecureNetworkAccess", "Medium",
     r"""ssh\s+.*-o\s+StrictHostKeyChecking=no"""),
]

_COMMAND_TEXTS = {
    "eval": ("Builds a command from text and runs it.",
             "Call the command directly, or check the text against a list of allowed values."),
    "source": ("Runs another file inside the current shell.",
               "Load trusted files only, by a fixed path."),
    "exec": ("Replaces the shell by another program.",
             "Start the program as a child process and fix its name."),
    "sudo": ("Runs a program with raised privileges.",
             "Limit the privileges to the single program that needs them."),
    "chmod": ("Changes who may access a file.",
              "Grant the fewest permissions that still work."),
    "curl": ("Transfers data over the network.",
             "Use https and verify what was downloaded."),
    "wget": ("Downloads data over the network.",
             "Use https and verify what was downloaded."),
    "rm": ("Deletes files for good.",
           "Check the path before deleting and keep variables out of it."),
    ">": ("Redirects output over a file.",
          "Write to a new file first and keep a copy of the old one."),
    "base64": ("Encodes data, which hides but does not protect it.",
               "Encrypt secrets and keep them in a secret store."),
}

_PATTERN_TEXTS = {
    "SEC01": ("A password is written in the script.",
              "Read passwords from the environment or a secret store."),
    "SEC02": ("An API key or access token is written in the script.",
              "Read keys and tokens from the environment or a secret store."),
    "SEC03": ("A private key is written in the script.",
              "Keep private keys in files only their owner can read."),
    "SEC04": ("A cloud access key id is written in the script.",
              "Use instance roles or short-lived credentials."),
    "SEC05": ("A URL carries a user name and a password.",
              "Pass credentials outside of the URL."),
    "INJ01": ("Expanded text is evaluated as a command.",
              "Do not evaluate text that comes from outside."),
    "INJ02": ("A shell runs a command line holding an expansion.",
              "Pass values as arguments instead of pasting them into the command line."),
    "INJ03": ("An executed program line holds an expansion.",
              "Fix the program name and check its arguments."),
    "FIL01": ("Deletes the root directory, a home directory or an absolute path.",
              "Delete by a checked path below a known directory."),
    "FIL02": ("Gives every user full access to an absolute path.",
              "Grant access to the owner or a group only."),
    "FIL03": ("Writes into a system directory.",
              "Leave system directories to the package manager."),
    "NET01": ("Transfers data without checking the certificate.",
              "Keep certificate checks on and add the missing authority instead."),
    "NET02": ("Downloads data without checking the certificate.",
              "Keep certificate checks on and add the missing authority instead."),
    "NET03": ("Connects without checking the host key.",
              "Add the host key to the known hosts."),
}

_NEEDS = {
    "SEC01": (("=",), ("passw", "pwd")),
    "SEC02": (("=",), ("key", "token")),
    "SEC03": (("=",), ("key",)),
    "SEC04": (("=",), ("aws",)),
    "SEC05": (("@",), ("http",)),
    "INJ01": (("$",), ("eval",)),
    "INJ02": (("$",), ("-c",), ("sh",)),
    "INJ03": (("$",), ("exec", "system")),
    "FIL01": (("-r", "-f"), ("rm",)),
    "FIL02": (("chmod",), ("777", "a+")),
    "FIL03": ((">",), ("/etc/", "/bin/", "/sbin/", "/usr/", "/var/")),
    "NET01": (("-k", "--insecure"),),
    "NET02": (("--no-check-certificate",),),
    "NET03": (("=",), ("StrictHostKeyChecking=no",)),
}

# Patterns that look for something up to the end of the line, anywhere after their start, cost
# the square of a line that is full of starts and lacks it. For those: the start where it is
# known that the rest of the line lacks it, and a start that may go on in the next line. From
# a start of the first kind on, the line holds no match but of a start of the second kind, so
# it is passed over in one step.
_BLANKS = r"(?:(?!\n)\s)*+"
_NO_NAME = r"(?!.*\$\{?[a-zA-Z0-9_])"
_LINE_STARTS = {
    "INJ01": (rf"""eval(?=\s++[\$"]{_NO_NAME})""", r"eval"),
    "INJ02": (rf"(?:^|\s)(?:bash|sh)(?=\s++-c\s++{_NO_NAME})",
              rf"\s(?:bash|sh)(?:{_BLANKS}-c)?+"),
    "INJ03": (rf"(?:^|\s)(?:exec|system)(?=\s++{_NO_NAME})", r"\s(?:exec|system)"),
    "NET01": (r"curl(?=\s++(?!.*--insecure))", r"curl"),
    "NET02": (r"wget(?=\s++(?!.*--no-check-certificate))", r"wget"),
    "NET03": (r"ssh(?=\s++(?!.*-o\s++StrictHostKeyChecking=no))", r"ssh"),
}
# The alternative of a pattern that is not bound to a line.
_LOOSE = {"NET01": "-k"}


def _line_patterns():
    """By pattern: what to look for line by line, with groups skip and hit, and the rest."""
    found = {}
    for rule_id, _, _, pattern in TEXT_PATTERNS:
        if rule_id in _LINE_STARTS:
            start, open_start = _LINE_STARTS[rule_id]
            loose = _LOOSE.get(rule_id)
            bound = pattern.removesuffix(f"|{loose}")
            skip = portable(rf"{start}(?:(?!{open_start}{_BLANKS}\n).)*+")
            found[pattern] = f"(?<skip>{skip})|(?<hit>{portable(bound)})", loose
    return found


_PHASES = {"SEC": 1, "INJ": 2, "FIL": 3, "NET": 4}


_BY_LINE = _line_patterns()


def builtin_rules():
    """All built-in rules in discovery order.

    The rule named ``>`` stays disabled: a redirection is never a command name.
    """
    commands = [
        Rule(
            rule_id="CMD_" + ("REDIRECT" if name == ">" else name.upper()),
            kind="command",
            finding_type="DangerousCommand",
            risk_level=level,
            command_name=name,
            description=_COMMAND_TEXTS[name][0],
            recommendation=_COMMAND_TEXTS[name][1],
            phase=COMMAND_PHASE,
            enabled=name != ">",
        )
        for name, level in DANGEROUS_COMMANDS
    ]
    patterns = [
        Rule(
            rule_id=rule_id,
            kind="regex",
            finding_type=finding_type,
            risk_level=level,
            pattern=pattern,
            description=_PATTERN_TEXTS[rule_id][0],
            recommendation=_PATTERN_TEXTS[rule_id][1],
            phase=_PHASES[rule_id[:3]],
            rule_no=int(rule_id[3:]),
            needs=_NEEDS[rule_id],
        )
        for rule_id, finding_type, level, pattern in TEXT_PATTERNS
    ]
    return commands + patterns


def regex_rule(rule_id, pattern, risk_level, finding_type="HardcodedSecret", description="",
               recommendation=None, rule_no=1, needs=()):
    """A custom text rule; ``needs`` as in ``Rule``, without which every text is tried."""
    return Rule(rule_id, "regex", finding_type, risk_level, pattern=pattern,
                description=description, recommendation=recommendation, rule_no=rule_no,
                needs=needs)


def active_rules(rules, min_risk=None):
    """Rules that can contribute to a scan."""
    floor = rank_of(min_risk) if min_risk else 1
    return [rule for rule in rules if rule.enabled and rule.risk_rank >= floor]


def ignore_rules(rules, rule_ids):
    dropped = set(rule_ids)
    return [rule for rule in rules if rule.rule_id not in dropped]


def add_rules(rules, custom):
    """``rules`` followed by ``custom``, whose ids and command names must be new."""
    combined = list(rules)
    for rule in custom:
        if any(rule.rule_id == other.rule_id for other in combined):
            raise ValueError(f"rule id {rule.rule_id!r} is already taken")
        if rule.kind == "command" and any(
            rule.command_name == other.command_name for other in combined
        ):
            raise ValueError(f"command {rule.command_name!r} already has a rule")
        combined.append(rule)
    return combined


def check_fields(rule):
    """Reject a rule whose fixed-choice fields hold something else."""
    if rule.kind not in ("command", "regex"):
        raise ValueError(f"{rule.rule_id}: kind must be 'command' or 'regex'")
    if rule.risk_level not in RISK_LEVELS:
        raise ValueError(f"{rule.rule_id}: unknown risk level {rule.risk_level!r}")
    if rule.finding_type not in FINDING_TYPES:
        raise ValueError(f"{rule.rule_id}: unknown finding type {rule.finding_type!r}")
    if rule.kind == "regex" and not rule.pattern:
        raise ValueError(f"{rule.rule_id}: a regex rule needs a pattern")
    if rule.kind == "command" and not rule.command_name:
        raise ValueError(f"{rule.rule_id}: a command rule needs a command name")


def check_pattern(rule):
    """Reject a pattern that Java would take for something else."""
    if rule.kind == "regex" and (what := unsupported(rule.pattern)):
        raise ValueError(f"{rule.rule_id}: the pattern has {what}, which is not supported")


def rules_table(spark, rules):
    """The rule list as a table."""
    names = RULES.fieldNames()
    rows = [{name: getattr(rule, name) for name in names} for rule in rules]
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(RULES)), RULES)


def rules_from_rows(rows):
    known = {field.name for field in fields(Rule)}
    return [
        Rule(**{k: v for k, v in row.asDict().items() if k in known and v is not None})
        for row in rows
    ]
