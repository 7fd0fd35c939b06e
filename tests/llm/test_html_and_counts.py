import random
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import models

from shellsieve.llm import tokencount
from shellsieve.llm.htmltext import extract_text, page_text
from shellsieve.llm.queries import vocabulary_path
from shellsieve.llm.tokencount import Counter, token_counts

PAGES = {
    "<p>one<p>two": "one\n\ntwo",
    "a<div>b</div>c": "a\nb\nc",
    "a <b> b</b>  c\n d": "a b c d",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z": "- a\n- b\n\n  3. x\n  4. y\n\nz",
    "<table><tr><th>name<th>n<tr><td>long name<td>1<br>2</table>": "name       n\nlong name  1\n           2",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide</table>": "a  b\n   c\nwide",
    "<title>t</title><script>if (a<b) '</p>'</script>x<style>y</style>": "x",
    "<div hidden>a</div><p style='color:red; display: none'>b</p>c": "c",
    "<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>": "s\ns\nyes",
    "<pre>  a\n   b </pre>": "  a\n   b",
    "&lt;x&gt; &amp;copy; &copy; 1 < 2 <3": "<x> &copy; © 1 < 2 <3",
    "<!-- c --><!DOCTYPE html><?x?>a<!-- open": "a",
    "x<br><br>y<br>z": "x\n\ny\nz",
    "<a href='>'>l</a><img alt=\"<p>\">m": "lm",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "<blockquote>q<p>r</blockquote>": "  q\n\n  r",
    "": "", "   ": "", "</p></div></b>": "", "<script>open": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert page_text(page) == PAGES[page]


class Words(HTMLParser):
    """All words outside elements that are not shown; ends of tags are all written out here."""

    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in {"title", "script", "style"}

    def handle_endtag(self, tag):
        self.off -= tag in {"title", "script", "style"}

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_all_words_of_given_pages_in_order():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        parser = Words()
        parser.feed(page)
        parser.close()
        lines = (x.removeprefix("- ") for x in page_text(page).split("\n"))
        assert "".join("".join(lines).split()) == "".join("".join(parser.words).split())


HIDING = ["hidden", "style='display:none'", "style='VISIBILITY: hidden; x: y'"]


def random_tree(rng, depth, words):
    """Markup of nested elements, each closed, and what of its words is shown, level by level."""
    page, close, visible, shows = [], [], True, []
    for level in range(depth):
        word = f"w{len(words)}"
        words.append(word)
        tag = rng.choice(["div", "span", "b", "section"])
        hidden = rng.random() < 0.01
        if hidden and rng.random() < 0.3:
            # A hidden element beside the way down.
            page.append(f"<{tag} {rng.choice(HIDING)}>no{level}<i>no</i></{tag}>")
            hidden = False
        visible = visible and not hidden
        page.append(f"<{tag} {rng.choice(HIDING) if hidden else ''}> {word} ")
        close.append((f" e{word} </{tag}>", visible, f"e{word}"))
        if visible:
            shows.append(word)
    for text, was_visible, word in reversed(close):
        page.append(text)
        if was_visible:
            shows.append(word)
    return "".join(page), shows


@pytest.mark.parametrize("depth", [5, 150, 199, 203, 1000])
def test_what_is_hidden_stays_hidden_at_any_depth(depth):
    rng = random.Random(depth)
    for _ in range(20):
        page, shows = random_tree(rng, depth, [])
        assert page_text(page).split() == shows


def test_deep_details_and_blocks():
    deep = "<div>" * 250
    assert page_text(deep + "<p hidden>SECRET</p><span style='display:none'>S2</span>y") == "y"
    assert page_text(deep + "a<p>b</p>c<details>no<summary>s</summary><summary>no</summary>no</details>d").split() == [
        "a", "b", "c", "s", "d",
    ]
    assert page_text(deep + "a<div>b</div>c<br>d") == "a\nb\nc\nd"


def plain_table(rows):
    """Cells of one line, columns as wide as the widest of them."""
    widths = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(max(map(len, rows)))]
    starts = [sum(w + 2 for w in widths[:c] if w) for c in range(len(widths))]
    out = []
    for row in rows:
        line = ""
        for c, cell in enumerate(row):
            if cell:
                line = line.ljust(starts[c]) + cell
        if line:
            out.append(line)
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(15))
def test_tables_equal_a_plain_layout(seed):
    rng = random.Random(seed)
    rows = [[rng.choice(["", "a", "bb", "word " * 3 + "x", "é"]) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
    assert page_text(page) == plain_table(rows)


def test_long_cells_and_many_rows():
    """What is put in for alignment grows with the rows, not with rows times widths."""
    cell = "x" * 20_000
    page = f"<table><tr><td>{cell}<td>y" + "<tr><td>a<td>b" * 2000 + "</table>"
    text = page_text(page)
    lines = text.split("\n")
    assert lines[0] == f"{cell}  y" and lines[1] == "a".ljust(82) + "b" and len(text) < 4 * len(page) + 400 * 2001
    wide = "<table><tr>" + f"<td>{'z' * 80}" * 900 + "<tr><td colspan=899><td>q" * 3000 + "</table>"
    text = page_text(wide)
    assert len(text) < 20 * len(wide) and text.count("q") == 3000
    assert len(page_text("<table>" + "<tr>" + "<td colspan=1000>c" * 20_000 + "</table>")) < 500_000
    tall = "<table><tr><td>" + "l<br>" * 20_000 + "<td>m" * 2000 + "</table>"
    assert page_text(tall).count("l") == 20_000


def test_many_ends_of_nothing_open():
    assert page_text("<td><div>" * 20_000 + "</p></b>" * 20_000 + "x").split()[-1] == "x"


def test_deep_long_and_broken_pages(spark):
    assert page_text("<div>" * 50_000 + "x") == "x"
    assert page_text("<b " * 2000 + ">x") is not None
    assert page_text('<a "' * 3000) is not None
    assert page_text("<" * 3000) == "<" * 3000
    rows = [(1, None), (2, ""), (None, "<p>a<p>b"), (1, "x" * 1_000_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, html string, text string")
    found = {(r.page_id, r.text if r.text is None or len(r.text) < 9 else len(r.text), r.n_lines) for r in extract_text(df).collect()}
    assert found == {(1, None, 0), (2, "", 0), (None, "a\n\nb", 3), (1, 1_000_000, 1)}
    assert extract_text(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def counter():
    return Counter.load(vocabulary_path())


def test_counts_equal_the_library(counter, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path())
    unigram = models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], 0, True)
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab te\n▁é中😀  the.\t", k=rng.randint(1, 40))) for _ in range(800)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:40]
    for bytes_at_once in (1 << 20, 7):
        monkeypatch.setattr(tokencount, "PIECE_BYTES", bytes_at_once)
        for text in texts:
            assert counter.count(text.encode()) == len(unigram.tokenize("▁" + text.replace(" ", "▁")))


def test_ties_go_to_the_earlier_start():
    pieces = {"a": -1.0, "b": -1.0, "ab": -2.0, "abc": -4.0, "c": -1.0, "bc": -3.0, "▁": -1.0}
    unigram = models.Unigram([("<unk>", 0.0), *pieces.items(), *((f"<0x{i:02X}>", 0.0) for i in range(256))], 0, True)
    own = Counter(pieces)
    for text in ("ab", "abc", "abab", "bc", "cab", "abcabc"):
        assert own.best("▁" + text) == len(unigram.tokenize("▁" + text))
    with pytest.raises(ValueError, match="crosses words"):
        Counter({"a▁b": 0.0})


def test_count_table(docs_of, counter):
    two = counter.count(b"the the")
    rows = [(1, None), (2, ""), (None, "the the"), (3, "the the"), (3, "é" * 100_000), (4, " ")]
    found = sorted(map(tuple, token_counts(docs_of(rows), vocabulary_path()).collect()), key=repr)
    assert (1, 0, 0) in found and (2, 0, 0) in found and (None, 7, two) in found and (3, 7, two) in found
    assert len(found) == 6 and token_counts(docs_of([]), vocabulary_path()).collect() == []
