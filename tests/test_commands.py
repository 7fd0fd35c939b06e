"""The command lexer on single texts."""

import random

from shellsieve.catalog import active_rules, builtin_rules
from shellsieve.operators.commands import commands

NAMES = [rule.command_name for rule in active_rules(builtin_rules()) if rule.kind == "command"]

# Text, names in order.
CASES = [
    ('curl -k x', ['curl']),
    (' sudo x', ['sudo']),
    ('rm', ['rm']),
    ('FOO=1 curl x', []),
    ('> out curl x', []),
    ('x=$(curl y)', ['curl']),
    ('`wget a`', ['wget']),
    ('echo a | sudo rm -rf /', ['sudo']),
    ('# curl x', []),
    ('echo "curl x"', []),
    ('echo rm', []),
    ('time rm x', []),
    ("echo 'rm a' ; rm b", ['rm']),
    ('a;rm b', ['rm']),
    ('! rm x', ['rm']),
    ('if true; then rm a; fi', ['rm']),
    ('{ rm a; }', ['rm']),
    ('f() { source x; }', ['source']),
    ('while read l; do base64 $l; done', ['base64']),
    ('a && eval "$x" || exec y', ['eval', 'exec']),
    ('/usr/bin/curl x', []),
    ('"rm" x', []),
    ('curly x', []),
    ('mycurl x', []),
    ('echo a#rm\ncurl', ['curl']),
    ('cat <<EOF\nrm x\nEOF\nrm y', ['rm']),
    ("cat <<'E'\nwget x\nE\n", []),
    ('echo \\\n rm', []),
    ('echo $(x) rm', []),
    ('echo "$(curl y)"', ['curl']),
    ('case $x in\n a) rm b ;;\nesac', ['rm']),
    ('echo do rm', []),
    ('case $x in a) rm b;; b|c) curl z ;; *) wget q;; esac', ['rm', 'curl', 'wget']),
    ('x="$(curl -s "http://a b" | base64)"; rm y', ['curl', 'base64', 'rm']),
    ('a && \\\n  rm b', ['rm']),
    ("echo $'it\\'s' ; rm x", ['rm']),
    ('[[ $x =~ (rm|curl) ]] && rm z', ['rm']),
    ('a=(rm b)', []),
    ('rm() { x; }', []),
    ('cat <<-E\n\trm x\n\tE\nrm y', ['rm']),
    ('echo "a $(date) it\'s; rm x"; rm \'q\'', ['rm']),
    ('echo "a $(rm 1) b $(curl 2) c"; wget', ['rm', 'curl', 'wget']),
    ('echo "`rm x` y"; curl z', ['rm', 'curl']),
    ('x <<< rm\nrm', ['rm']),
    ('if ! curl x; then exec y; else rm z; fi', ['curl', 'exec', 'rm']),
    ('for f in rm curl; do\n rm $f\ndone', ['rm']),
    ('case $1 in\n rm|curl) echo x;;\n -h|--help)\n   sudo y;;\nesac', ['sudo']),
    ('echo \ufdd0\ufdd1 é; rm x', ['rm']),
    ('trap "rm -f x" EXIT', []),
    ("alias rm='rm -i'", []),
    ('', []),
    ('echo "unterminated\nrm x', ['rm']),
    ('cmd &\nrm x & curl y', ['rm', 'curl']),
    ('(rm x)', ['rm']),
    ('a=$(( rm ))', []),
    ('echo "a\\"b" ; rm x', ['rm']),
    ('diff <(curl a) <(curl b)', ['curl', 'curl']),
    ('cat <<EOF\nit\'s $(curl x) and `rm y` "z\nEOF\nsudo q', ['curl', 'rm', 'sudo']),
    ('a "x $(b "c $(rm d)" e) f" ; curl', ['rm', 'curl']),
    ("cat <<'E' | sudo tee\n$(rm x)\nE\ncurl", ['sudo', 'curl']),
    ('cat <<EOF | sudo tee x\nfoo\nEOF\nrm y', ['sudo', 'rm']),
    ("(( rm > 3 )) && curl x", ["curl"]),
    ("echo $# ; rm x", ["rm"]),
    ("rm\tx", ["rm"]),
    ("cat <<\\E\n$(rm x)\nE\ncurl", ["curl"]),
    ("cat <<A <<B\nrm\nA\nrm\nB\ncurl", ["curl"]),
    ("\x01\x02rm x; \x04curl y\n\x06sudo\n rm", ["rm"]),
    ("case w in a) rm x;; esac", ["rm"]),
    ("echo $(( $(rm x) + 1 )); curl", ["rm", "curl"]),
    ("(( `rm x` > (2) )) && curl y", ["rm", "curl"]),
    ("(( (1 + $(rm x)) * $y ))", ["rm"]),
    ("x=$(( y + $z )); (( rm )); ((i++)); rm q", ["rm"]),
]

# Nesting, and words that open something only in command position.
NESTED = [
    ("echo `date` rm", []),
    ("echo { rm", []),
    ('a "$(b "$(c "$(rm 1)")")"; curl x', ["rm", "curl"]),
    ('echo "a $(echo "b $(echo "c $(rm x) d") e") f" rm', ["rm"]),
    ("cat <<A <<'B' <<-C\n$(rm a)\nA\n$(curl b)\nB\n\t`wget c`\n\tC\nsudo x", ["rm", "wget", "sudo"]),
    ("for x in rm curl) do rm; done", []),
    ("for f in a b; do case $f in a) rm x;; (b|c) `curl y`;; esac; done; wget", ["rm", "curl", "wget"]),
    ("case $x in a) case $y in b) rm 1;; esac;; c) curl;; esac", ["rm", "curl"]),
    ("case rm in rm) ;; esac\nrm", ["rm"]),
    ("rm a $(curl b) c; wget", ["rm", "curl", "wget"]),
    ("${x:-$(rm a)} ; echo ${y:+\"`curl`\"}", ["rm", "curl"]),
    ("echo \"${x:-it's}\"; rm y", ["rm"]),
    ("a=(rm $(curl x) wget); sudo y", ["curl", "sudo"]),
    ("function rm { curl x; }", ["curl"]),
    ("function f() { rm x; }; rm () ( wget y )", ["rm", "wget"]),
    ("[[ -f rm && $(curl x) ]] && rm y", ["curl", "rm"]),
    ("[[ a < b ]]; rm", ["rm"]),
    ("echo $(( 1 + $(rm x; echo \"$(curl y)\") )) ; wget", ["rm", "curl", "wget"]),
    ("x=$(cat <<E\nrm $(curl a)\nE\n); rm b", ["curl", "rm"]),
    ("( (rm x); { curl y; } )", ["rm", "curl"]),
    ("echo a{rm,b} ; { rm; }", ["rm"]),
    ("echo `rm a # curl` ; wget # rm `curl`", ["rm", "wget"]),
    ("# it's $(rm\ncurl", ["curl"]),
    ("! { rm x; } | while read; do sudo y; done", ["rm", "sudo"]),
    ("rm$(x) ; rm\"a\" ; \\rm ; r\\m", []),
    ("cat <<\"A B\"\nrm\nE\ncurl", ["rm", "curl"]),
    ("cmd &> out; cmd >& out; cmd 2>&1 | rm", ["rm"]),
    ("shopt; !(a|rm) ; ls @(rm|b)", []),
]

POSITIONS = [
    ("é=1; sudo x", "sudo", 1, 7, ["x"]),
    ("a\n  😀; rm -rf \"$a b\" $c 'd' e.f", "rm", 2, 9, ["-rf", '"$a b"', "e.f"]),
    ('x="$(curl -s "http://a b" | jq .)"', "curl", 1, 6, ["-s", '"http://a b"']),
    ("rm a\\ b 2>/dev/null", "rm", 1, 1, ["a\\ b"]),
    ("rm a \\\n  b # c", "rm", 1, 1, ["a", "b"]),
    ("wget ${x} $y ~/z", "wget", 1, 1, ["~/z"]),
]


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "path int, content string").repartition(8)
    found = {i: [] for i in range(len(texts))}
    for row in commands(df, NAMES).collect():
        found[row.path].append(row)
    return [sorted(found[i], key=lambda row: (row.line, row.column)) for i in range(len(texts))]


def test_names(spark):
    cases = CASES + NESTED
    for (text, expected), rows in zip(cases, run(spark, [text for text, _ in cases])):
        assert [row.command_name for row in rows] == expected, repr(text)


def test_positions_and_arguments(spark):
    for case, rows in zip(POSITIONS, run(spark, [case[0] for case in POSITIONS])):
        assert [(r.command_name, r.line, r.column, r.args) for r in rows] == [case[1:]], case[0]


def test_long_texts(spark):
    """Possessive loops: no stack overflow and no blow-up on long quotes and runs."""
    texts = [
        ('echo "a $(date) \\" b" \'c\' ' * 20000 + "\nrm x", 1),
        ("x=$( " + "curl a; " * 20000 + ")", 20000),
        ("'" + "a\\" * 200000 + "' ; rm x", 1),
        ('"' + "\\n" * 200000 + '" ; rm x', 1),
        (") $(x) " * 30000 + "\nrm x", 1),
        ("`" * 20001 + "\nrm", 1),
        ('"$(' * 20001 + "\nrm", 1),
        ("a " * 200000 + "\nrm", 1),
        ("<< x " * 20000 + "\nrm", 1),
        ("x << y\n" * 140000 + "rm", 1),
        ("cat << E\nrm\nE\n" * 20000 + "rm", 1),
    ]
    counts = [len(rows) for rows in run(spark, [text for text, _ in texts])]
    assert counts == [count for _, count in texts]


class Program:
    """Random shell text with the commands it holds, built from the outside in."""

    def __init__(self, rng, depth):
        self.rng, self.hits, self.text = rng, [], ""
        self.list(depth)

    def put(self, *parts):
        self.text += "".join(parts)

    def list(self, depth):
        for i in range(self.rng.randint(1, 2)):
            if i:
                self.put(self.rng.choice([" ; ", " && ", " | ", " || "]))
            self.command(depth)

    def command(self, depth):
        kind = self.rng.randrange(9) if depth > 0 else 0
        if kind == 1:
            self.put("{ ")
            self.list(depth - 1)
            self.put("; }")
        elif kind == 2:
            self.put("( ")
            self.list(depth - 1)
            self.put(" )")
        elif kind == 3:
            self.put("if true; then ")
            self.list(depth - 1)
            self.put("; else :; fi")
        elif kind == 4:
            self.put("case \"$x\" in a|rm) ")
            self.list(depth - 1)
            self.put(" ;; (*) ")
            self.list(depth - 1)
            self.put(" ;; esac")
        elif kind == 5:
            self.put("while [[ -f rm ]]; do ")
            self.list(depth - 1)
            self.put("; done")
        else:
            name = self.rng.choice(["echo", "ls", *NAMES[:8]])
            if name in NAMES:
                self.hits.append((len(self.text.encode()), name))
            self.put(name)
            for _ in range(self.rng.randint(0, 2)):
                self.put(" ")
                self.word(depth - 1)

    def word(self, depth, quoted=False):
        kind = self.rng.randrange(8)
        if kind == 0 or depth <= 0:
            self.put(self.rng.choice(["a", "rm", "do", "é", "x#y", "{", "in", "esac", "then"]))
        elif kind == 1:
            self.put("'rm `$(curl \"'")
        elif kind in (2, 3):
            self.put('"b ')
            self.inside(depth - 1)
            self.put(' rm"')
        elif kind == 4:
            self.put("$(( 1 + (2) * ")
            self.inside(depth - 1)
            self.put(" ))")
        elif kind == 5:
            self.put("${v:-")
            self.inside(depth - 1)
            self.put("}")
        else:
            self.inside(depth)

    def inside(self, depth):
        """A substitution, or nothing of the kind."""
        if depth <= 0 or self.rng.random() < 0.2:
            self.put("$y")
            return
        # With a blank, since two opening parentheses are arithmetic.
        self.put("$( ")
        self.list(depth - 1)
        self.put(")")


def test_random_nesting(spark):
    programs = []
    for seed in range(400):
        program = Program(random.Random(seed), 1 + seed % 20)
        if len(program.text) < 20_000:
            programs.append(program)
    assert len(programs) > 300 and max(p.text.count("$(") for p in programs) > 20
    found = run(spark, [p.text for p in programs])
    for program, rows in zip(programs, found):
        assert [(r.column - 1, r.command_name) for r in rows] == program.hits, program.text
