"""A table of shell scripts derived from the whole ``events`` table.

A script is a block of 64 consecutive event ids, one line per event, so the group that is
collected into a text never exceeds 64 rows however the users are distributed
(``event_id`` is the key of ``events``). Lines are ordered by user, then by event.
"""

from pyspark.sql import functions as F

EVENTS_PER_SCRIPT = 64

# Line of an event by its id modulo the number of templates. The expressions are plain
# SQL; {text} is the name of the string type.
LINE_TEMPLATES = [
    "concat('curl -k https://h', CAST(user_id AS {text}), '.example.com')",
    "concat('wget --no-check-certificate https://h/', CAST(event_id AS {text}))",
    "concat('wget https://u', CAST(user_id AS {text}), ':p', CAST(event_id AS {text}),"
    " '@example.com/f.zip')",
    "concat('PASSWORD=\"pw', CAST(event_id AS {text}), '\"')",
    "concat('api_key = ', chr(39), 'k', CAST(event_id AS {text}), chr(39))",
    "concat('SSH_KEY=\"s', CAST(event_id AS {text}), '\"')",
    "concat('AWS_ACCESS_KEY_ID=\"A', CAST(event_id AS {text}), '\"')",
    "'eval \"$a\" $b'",
    "'eval $userInput'",
    "'sh -c \"$command\"'",
    "'exec $cmd'",
    "'sudo rm -rf /'",
    "'rm -rf $HOME/tmp'",
    "'rm -rf ./temp/'",
    "'chmod -R 777 /srv/x'",
    "'chmod 777 ./temp'",
    "concat('echo x > /etc/h', CAST(user_id AS {text}))",
    "concat('ssh -o StrictHostKeyChecking=no h', CAST(user_id AS {text}))",
    "'source ./env.sh'",
    "concat('echo ', CAST(event_id AS {text}), ' | base64')",
    "concat('# curl in a comment ', CAST(event_id AS {text}))",
    "'echo \"rm inside a string\"'",
    "concat('FOO=1 curl https://h', CAST(user_id AS {text}))",
    "concat('echo plain ', CAST(event_id AS {text}))",
    "'pwd = \"\"'",
    "'ls -la'",
    # Non-ASCII text before a command and before a secret; a match over two lines; a
    # carriage return; two matches on a line.
    "concat('é=ü; sudo id ', CAST(user_id AS {text}))",
    "concat('ğü passwd=', chr(39), 'ş', CAST(event_id AS {text}), chr(39))",
    "concat('access-token =', chr(10), '  \"t', CAST(event_id AS {text}), '\"')",
    "concat('ls', chr(13))",
    "concat('pwd=\"a', CAST(user_id AS {text}), '\" Pwd = ', chr(39), 'b', chr(39), ' # -k -k')",
]


# Texts that nest, by event. A name that is followed by `hit` is a command, any other is none.
NESTING_TEMPLATES = [
    "concat('echo `date` rm no; rm hit', CAST(event_id AS {text}))",
    "concat('echo { rm no; }; { rm hit; }; echo ', CAST(user_id AS {text}))",
    "'a \"$(b \"$(c \"$(curl hit) rm no\")\" rm no)\"; wget hit'",
    "concat('cat <<A <<B', chr(10), '$(rm hit) curl no', chr(10), 'A', chr(10), '`wget hit`', chr(10),"
    " 'B', chr(10), 'sudo hit', CAST(user_id AS {text}))",
    "concat('cat <<', chr(39), 'E', CAST(user_id AS {text}), chr(39), ' | sudo hit', chr(10), '$(rm no)', chr(10),"
    " 'E', CAST(user_id AS {text}), chr(10), 'rm hit')",
    "'for x in rm curl; do case $x in rm|curl) eval hit;; *) wget hit ;; esac; done'",
    "'for x in rm no) do rm no'",
    "'case rm in a) case $y in rm) curl hit;; esac;; esac; rm hit'",
    "'a=(rm no $(curl hit)); function rm { wget hit; }; rm () { rm hit; }'",
    "'[[ rm < curl && $(rm hit) ]] && curl hit; echo $(( rm + $(wget hit) ))'",
    "'x=${a:-$(rm hit)}; echo \"${b:-it' || chr(39) || 's $(curl hit)}\"; # $(rm no)'",
]


def nesting_sql(text_type):
    """The nesting text of an event as a SQL expression over event_id and user_id."""
    cases = " ".join(
        f"WHEN {i} THEN {template.replace('{text}', text_type)}"
        for i, template in enumerate(NESTING_TEMPLATES)
    )
    return f"CASE event_id % {len(NESTING_TEMPLATES)} {cases} END"


def line_sql(text_type):
    """The line of an event as a SQL expression over event_id and user_id."""
    cases = " ".join(
        f"WHEN {i} THEN {template.format(text=text_type)}"
        for i, template in enumerate(LINE_TEMPLATES)
    )
    return f"CASE event_id % {len(LINE_TEMPLATES)} {cases} END"


def sample_scripts(spark, sf_dir):
    """(script_id, path, content)"""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = events.select(
        F.expr(f"event_id div {EVENTS_PER_SCRIPT}").alias("script_id"),
        F.struct("user_id", "event_id", F.expr(line_sql("STRING")).alias("text")).alias("line"),
    )
    ordered = F.array_sort(F.collect_list("line"))
    return (
        lines.groupBy("script_id")
        .agg(F.array_join(ordered["text"], "\n").alias("content"))
        .select(
            "script_id",
            F.format_string("jobs/%d.sh", "script_id").alias("path"),
            "content",
        )
    )


def scripts_with_paths(spark, sf_dir):
    """Scripts whose names and first lines exercise the classifier."""
    scripts = sample_scripts(spark, sf_dir)
    kind = F.col("script_id") % 6
    name = F.col("script_id").cast("string")
    return scripts.select(
        "script_id",
        F.when(kind == 0, F.concat(F.lit("a/"), name, F.lit(".sh")))
        .when(kind == 1, F.concat(F.lit("a/"), name, F.lit(".bash")))
        .when(kind == 2, F.concat(F.lit("a/"), name, F.lit(".SH")))
        .when(kind == 3, F.concat(F.lit("a/"), name, F.lit(".txt")))
        .when(kind == 4, F.lit("a/.sh"))
        .otherwise(F.concat(F.lit("a.sh/"), name))
        .alias("path"),
        F.when(kind == 2, F.concat(F.lit("#!/bin/sh\n"), "content"))
        .when(kind == 5, F.concat(F.lit("#!/usr/bin/env bash\n"), "content"))
        .otherwise(F.col("content"))
        .alias("content"),
    )
