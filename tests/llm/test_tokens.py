import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shellsieve.llm import dac, tokens
from shellsieve.llm.queries import tokenizer_path
from shellsieve.llm.tokens import Encoder, open_tokens, read_tokens, token_files, write_tokens


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def written(docs, segment_ids):
    out = io.BytesIO()
    writer = dac.Writer(out, segment_ids)
    for doc_id, ids in docs:
        writer.add(doc_id, packed(ids))
    writer.close()
    data = out.getvalue()
    return dac.Reader(lambda offset, size: data[offset: offset + size], len(data))


ids = st.integers(0, (1 << 32) - 1) | st.integers(0, 300) | st.sampled_from([0, 255, 256, 65535, 65536])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-5, 5), st.lists(ids, max_size=40)), max_size=12), st.integers(1, 30))
def test_round_trip_and_random_access(docs, segment_ids):
    reader = written(docs, segment_ids)
    every = [x for _, part in docs for x in part]
    assert reader.n_ids == len(every) and reader.n_docs == len(docs)
    assert [reader.token(i) for i in range(len(every))] == every
    back = [(i, start, [int(x) for part in parts for x in part]) for i, start, parts in reader.documents()]
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x in docs])]).tolist()
    assert back == [(i, s, list(x)) for (i, x), s in zip(docs, starts, strict=False)]


def test_ranks_across_blocks():
    values = np.random.default_rng(0).integers(0, 1 << 20, 5000)
    reader = written([(1, values)], 4096)
    assert all(reader.token(i) == values[i] for i in range(0, 5000, 7))
    with pytest.raises(IndexError):
        reader.token(5000)


def test_encoder_equals_the_library(monkeypatch):
    library = Tokenizer.from_file(tokenizer_path())
    texts = [
        "", " ", "It's THE end, isn't it?", "É é İ ΑΣ ΑΣ. ß", "ẖ H̱ Ḧ̈", "<|endoftext|> x<|startoftext|>",
        "a\x0bb\x1cc\u00a0d\u2003e\u2028f\x00g", "x" * 300, "日本語 テキスト", "1234 5６7", "😀👍🏽", "don't'll 've'",
        "\u0301a \u0301", "A\u030a ÅÅ ﬁ", "ÀÉÎÕÜß×÷ÿÞ", "été, (été) É!! a.b c,d 'a ''s !!' __x__ \\n`", "a" * 200 + "," * 80,
        "hello <|endoftext|> world <|startoftext|>x", "a<|endoftext|>b", "<|ENDOFTEXT|> <|endoftext|>",
        "É<|endoftext|><|endoftext|>É <|EndOfText|>X", "Word " * 50 + "<|startoftext|>", "<|endoftext|", "<|end<|endoftext|>",
        "é\u0301, ,\u0338 x=\u0338 q\xad", "".join(map(chr, range(33, 256))),
    ]
    expected = [packed(library.encode(t, add_special_tokens=False).ids) for t in texts]
    encoder = Encoder(tokenizer_path())
    assert encoder.encode([t.encode() for t in texts]) == expected
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    assert [encoder.encode([t.encode()])[0] for t in texts] == expected


ROWS = [(3, "three words here"), (1, None), (2, ""), (2, "two"), (2, "two"), (None, "null"), (-7, "é " * 3000)]


def test_files_of_a_table(spark, docs_of, tmp_path, monkeypatch):
    library = Tokenizer.from_file(tokenizer_path())
    folder = f"file://{tmp_path}/ids"
    manifest = write_tokens(docs_of(ROWS), tokenizer_path(), folder)
    found = sorted(map(tuple, read_tokens(manifest).collect()), key=lambda r: r[1])
    encode = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert [r[0] for r in found] == [None, -7, 1, 2, 2, 2, 3]
    start = 0
    texts = {(i, zlib.crc32(packed(encode(t))), len(encode(t))) for i, t in ROWS}
    for doc_id, at, n, crc in found:
        assert at == start and (doc_id, crc, n) in texts
        start += n
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == start
    last = max(manifest.collect(), key=lambda r: r.part)
    assert open_tokens(last.path).token(last.n_tokens - 1) == 2


def test_empty_table(docs_of):
    assert token_files(docs_of([]), tokenizer_path()).collect() == []
