from pyspark.sql import functions as F

from shellsieve.functions import levels, text
from tests import model

TEXTS = [
    "", "\n", "a", "a\n", "a\nb", "a\n\n", "é\nü\n\n\n", "'q'", '"q"', "'", '  "x" ',
    '<a href="x">&\'</a>', "a\r\nb\r\n", "a\r", "\r\n", "x\r\n\r\ny", "' a\"", "''", "　'z' ",
    "😀\n😀x\n",
]


def line_number(value, offset):
    data = value.encode()
    if offset >= len(data):
        return len(model.lines(value))
    return data[:offset].count(b"\n") + 1


def line_start(value, line):
    data = value.encode()
    if line <= 1:
        return 0 if line == 1 else None
    at = -1
    for _ in range(line - 1):
        at = data.find(b"\n", at + 1)
        if at < 0:
            return None
    return at + 1


def stripped(value):
    value = value.strip()
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
        return value[1:-1]
    return value


def test_helpers_match_their_models(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    t = F.col("t")
    rows = df.select(
        "t",
        text.count_lines(t).alias("lines"),
        text.lines_of(t).alias("split"),
        text.count_trailing_newlines(t).alias("trailing"),
        text.escape_html(t).alias("html"),
        text.strip_quotes(t).alias("stripped"),
        F.array(*[text.get_line_number(t, F.lit(n)) for n in range(7)]).alias("numbers"),
        F.array(*[text.get_line_start_offset(t, F.lit(n)) for n in range(6)]).alias("starts"),
    ).collect()
    for row in rows:
        value = row.t
        assert row.split == model.lines(value), repr(value)
        assert row.lines == len(model.lines(value)), repr(value)
        assert row.trailing == len(value) - len(value.rstrip("\n"))
        assert row.html == (
            value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            .replace('"', "&quot;").replace("'", "&#39;")
        )
        assert row.stripped == stripped(value), repr(value)
        assert row.numbers == [line_number(value, n) for n in range(7)], repr(value)
        assert row.starts == [line_start(value, n) for n in range(6)], repr(value)


def test_extensions(spark):
    cases = [
        ("a.sh", "sh"), ("x/a.tar.gz", "gz"), (".sh", ""), ("x/.sh", ""), ("a", ""), ("a.", ""),
        ("a.SH", "SH"), ("a.sh/b", ""), (".a.sh", "sh"), ("é .bash", "bash"),
    ]
    df = spark.createDataFrame(cases, "path string, expected string")
    p = F.col("path")
    for row in df.select("*", text.extension_of(p).alias("e"),
                         text.has_extension(p, "sh").alias("sh")).collect():
        assert row.e == row.expected and row.sh == (row.expected == "sh"), row


def test_levels(spark):
    words = ["critical", "KRITIK", "Yüksek", "HIGH", "orta", "Medium", "düşük", "low", "", "x"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [row[0] for row in df.select(levels.parse_risk_level(F.col("w"))).collect()]
    assert got == ["Critical", "Critical", "High", "High", "Medium", "Medium", "Low", "Low",
                   None, None]
    named = spark.createDataFrame([("High",), ("None",)], "l string").select(
        levels.risk_level_name(F.col("l"), "tr"), levels.risk_rank(F.col("l"))).collect()
    assert [tuple(row) for row in named] == [("Yüksek", 3), (None, None)]
