import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shellsieve import scan
from shellsieve.catalog import regex_rule
from shellsieve.functions.literals import required_literal
from shellsieve.operators import literal_search, rule_index
from shellsieve.operators.rule_index import scan_rule_table

LITERALS = [
    ("abcd", "abcd"), ("(?i)Token\\s*=", "token"), ("a|bcdef", ""), ("(?:x|y)longer?[ab]", "longe"), ("ab+cd", "cd"),
    ("(abc)+def", "abc"), ("ab{0,3}cdef", "cdef"), ("\\bword\\b", "word"), ("x.y", "x"), ("[abc]", ""),
    ("café bar", " bar"), ("\\p{L}+abcde", ""), ("(", ""), ("a(?:b(?:cdefg)h)?ij", "ij"),
]


def test_literals():
    assert [(p, required_literal(p)) for p, _ in LITERALS] == LITERALS


def test_literals_are_in_every_match():
    rng = random.Random(3)
    for _ in range(400):
        pieces = [rng.choice(["ab", "C", "d+", "(?:ef|g)", "(h)", "[ij]", "k?", "l{2}", ".", "\\s", "(m|n)*"]) for _ in range(6)]
        pattern = "".join(pieces)
        literal = required_literal(pattern)
        for _ in range(20):
            text = "".join(rng.choice("abCdefghijkllmn ") for _ in range(12))
            for match in re.finditer(pattern, text):
                assert literal in match.group().lower(), pattern


def rules_of(rng, n):
    """Rules with and without literals, caseless ones, ones of common parts only."""
    out = []
    for i in range(n):
        a, b = rng.choice(WORDS), rng.choice(WORDS)
        out.append((f"R{i}", rng.choice([
            f"{a} {b}", f"(?i){a}\\s+{b}", f"{a}[0-9]*{b}", f"the {a}", f"{a[:2]}", f"({a}|{b})", f"{a}.{{0,3}}{b}", "[0-9]{9}",
        ])))
    return out


WORDS = [f"{a}{b}{c}" for a in ("al", "Be", "ka", "so") for b in ("ta", "mi", "ns", "the ") for c in ("x", "rk", "es", "ing")]


def texts_of(rng, n):
    texts = [" ".join(rng.choices([*WORDS, "the", "9", "\n", "ſoKal"], k=rng.randint(0, 60))) for _ in range(n)]
    return [*texts, None, "", "the the ﷐ alta", "alta" * 3000]


def rows(df):
    return sorted((r.path, r.rule_id, r.line, r.column) for r in df.collect())


@pytest.mark.parametrize("at_once", [50_000, 40])
def test_equal_to_a_scan(spark, monkeypatch, at_once):
    monkeypatch.setattr(rule_index, "RULES_AT_ONCE", at_once)
    rng = random.Random(1)
    rules = rules_of(rng, 120)
    texts = spark.createDataFrame(list(enumerate(texts_of(rng, 60))), "path int, content string").select(
        F.col("path").cast("string").alias("path"), "content"
    )
    table = spark.createDataFrame(rules, "rule_id string, pattern string")
    found = rows(scan_rule_table(texts, table))
    expected = scan(texts, [regex_rule(i, p, "Low") for i, p in rules], snippet=False)
    assert found == sorted((r.file_path, r.rule_id, r.line, r.column) for r in expected.collect())
    assert len(found) > 500
    assert scan_rule_table(texts.limit(0), table).collect() == []
    assert scan_rule_table(texts, table.limit(0)).collect() == []


def test_the_plan_does_not_grow_with_the_rules(spark):
    texts = spark.createDataFrame([("p", "x")], "path string, content string")

    def size(n):
        table = spark.range(n).select(F.format_string("R%d", "id").alias("rule_id"), F.format_string("literal%d", "id").alias("pattern"))
        return len(scan_rule_table(texts, table)._jdf.queryExecution().optimizedPlan().toString())

    assert abs(size(5) - size(500)) < 200


def test_five_thousand_rules_on_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    words = sorted({w for t in texts.values() for w in re.findall("[A-Za-z]{5,}", t)})[:5000]
    table = spark.createDataFrame([(w, w) for w in words], "rule_id string, pattern string")
    found = scan_rule_table(documents, table, "doc_id", "text").groupBy("doc_id", "rule_id").count().collect()
    expected = {(i, w): t.count(w) for i, t in texts.items() for w in words if w in t}
    assert len(words) == 5000
    assert {(r.doc_id, r.rule_id): r["count"] for r in found} == expected


def test_what_is_no_rule(spark):
    texts = spark.createDataFrame([("p", "x")], "path string, content string")
    for pattern in ("a*", "(?=a)b", None):
        table = spark.createDataFrame([("BAD", pattern)], "rule_id string, pattern string")
        with pytest.raises(ValueError, match="BAD"):
            scan_rule_table(texts, table)


def test_plain_rules_are_cut_out_as_a_scan_finds_them(spark):
    """Overlaps, line breaks, letters that grow when lowered, signs that mean something to Java."""
    texts = spark.createDataFrame(
        [("a", "aa aa aa aa aa\nAA AA aa"), ("b", "İx AA aa aa\n\n  aa aa"), ("c", "ſo Kalt aa aa\\E \n -aa aa-"), ("d", "aa aa﷐aa aa")],
        "path string, content string",
    )
    patterns = ["aa aa", "(?i)aa aa", "(?i)so kalt", "so kalt", "\naa aa", "aa aa\n", "-aa aa-", "aa\\b aa", "aa"]
    rules = [(f"R{i}", p) for i, p in enumerate(patterns)]
    table = spark.createDataFrame(rules, "rule_id string, pattern string")
    compiled = {r.rule_id: r.plain for r in rule_index.compiled_rules(table).collect()}
    assert compiled == {i: None if "\\" in p else p for i, p in rules}
    found = scan_rule_table(texts, table)
    expected = scan(texts, [regex_rule(i, p, "Low") for i, p in rules], snippet=False)
    assert rows(found) == sorted((r.file_path, r.rule_id, r.line, r.column) for r in expected.collect())


def test_long_literals_are_filed_under_long_parts(spark):
    """Parts of four characters made most texts meet rules whose literal they do not hold."""
    rules = spark.createDataFrame([("A", "abcdefghij"), ("B", "abcde")], "rule_id string, pattern string")
    texts = spark.createDataFrame([("abcdefghij abcde",)], ["__folded"])
    filed = rule_index._filed(rule_index.compiled_rules(rules), texts, rule_index.Scratch(spark))
    assert {r.rule_id: len(r.gram) for r in filed.collect()} == {"A": 8, "B": 4}


def test_short_literals_are_filed_too(spark):
    """Rules with a literal of fewer than four characters were tried on every text."""
    rules = spark.createDataFrame([("A", "ab"), ("B", "(?i)x y"), ("C", "q[0-9]"), ("D", "zz")], "rule_id string, pattern string")
    texts = spark.createDataFrame([("ab x y q7",)], ["__folded"])
    filed = rule_index._filed(rule_index.compiled_rules(rules), texts, rule_index.Scratch(spark))
    assert {r.rule_id: r.gram for r in filed.collect()} == {"A": "ab", "B": "x y", "C": "q"}


def test_places_are_told_by_the_bytes_of_a_text(spark):
    """Texts are searched as bytes, some together; a place is still one of characters in its own text."""
    parts = [b"aa aa", b"AA", b" aa\n", "ſK".encode(), "éİ".encode(), b"\xff\xc3", b"sk Sk", b"", "﷐".encode()]
    rng = random.Random(7)
    texts = [(i, bytearray(b"".join(rng.choices(parts, k=rng.randint(0, 12))))) for i in range(300)]
    # Bytes that are no text are what a pattern takes them for.
    texts = spark.createDataFrame(texts, "id int, b binary").select(
        F.col("id").cast("string").alias("path"), F.col("b").cast("string").alias("content")
    )
    patterns = ["aa", "(?i)aa", "(?i)aa aa", "sk", "(?i)sk", "(?i)k s", "k[ \n]?S", "a", "(?i)aa aaaa", "\naa aa", "(?i)sksksksk"]
    rules = [(f"R{i}", p) for i, p in enumerate(patterns)]
    found = rows(scan_rule_table(texts, spark.createDataFrame(rules, "rule_id string, pattern string")))
    expected = scan(texts, [regex_rule(i, p, "Low") for i, p in rules], snippet=False)
    assert found == sorted((r.file_path, r.rule_id, r.line, r.column) for r in expected.collect())
    assert len({rule for _, rule, _, _ in found}) >= 10


def test_search_equals_one_by_one(monkeypatch):
    rng = random.Random(5)
    for letters in ("ab", "abAB \n", "asſkKKSé\n İ", "abcdefgh \n"):
        for chunk, group, pairs in ((3, 1, 1), (16, 30, 5), (1 << 15, 1 << 22, 1 << 20)):
            monkeypatch.setattr(literal_search, "_CHUNK", chunk)
            monkeypatch.setattr(literal_search, "_GROUP", group)
            monkeypatch.setattr(literal_search, "_PAIRS", pairs)
            texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(8)]
            ascii_letters = [c for c in letters if c.isascii()]
            plain = {"".join(rng.choices(ascii_letters, k=rng.choice([1, 2, 3, 4, 7, 8, 9, 16, 25]))) for _ in range(30)}
            plain |= {t[i:j] for t in texts for i in (0, 9) for j in (11, 30) if t[i:j] and t[i:j].isascii()}
            # Parts that a literal holds twice.
            plain |= {"a" * 16, "ab" * 8, "abcdefgh a abcdefgh"}
            texts += ["a" * 15, "a" * 33, "ab" * 7, "ab" * 9 + "a" * 8, "abcdefgh a abcdefgh", "abcdefgh b abcdefgh"]
            plain = sorted(plain)
            literals, kinds = [folded_text(p) for p in plain], [rng.choice(["", "(?i)", None]) for _ in plain]
            starts = [rng.randint(0, len(x) - literal_search.part_size(len(x))) for x in literals]
            search = literal_search.Literals(
                range(len(plain)), [x[i:i + literal_search.part_size(len(x))] for x, i in zip(literals, starts)], literals,
                [None if kind is None else kind + p for p, kind in zip(plain, kinds)],
            )
            found = search.search(pa.array(["before", *texts], pa.string()).slice(1)).to_pylist()
            assert found == [
                [hit for n, p in enumerate(plain) if (hit := one_by_one(n, t, p, literals[n], kinds[n]))] for t in texts
            ]


def folded_text(text):
    return "".join({"ſ": "s", "K": "k"}.get(c, c.lower() if c.isascii() else c) for c in text)


def one_by_one(number, text, plain, literal, kind):
    low = folded_text(text)
    if kind is None:
        return {"number": number, "starts": None} if literal in low else None
    where, what, starts = (low, literal, []) if kind else (text, plain, [])
    at = where.find(what)
    while at >= 0:
        starts.append({"line": text.count("\n", 0, at) + 1, "column": at - text.rfind("\n", 0, at)})
        at = where.find(what, at + len(what))
    return {"number": number, "starts": starts} if starts else None
