import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwright.llm import bpe
from sparkwright.llm.workloads import QUERIES

from .helpers import SF, docs_frame, documents

PATHS = {k: public_tokenizers.path(f"{k}.json") for k in ("word_bpe_49k", "byte_bpe_50k")}
THEIRS = {k: Tokenizer.from_file(p) for k, p in PATHS.items()}
OURS = {k: bpe.Bpe(open(p, encoding="utf-8").read()) for k, p in PATHS.items()}


def ids_of(kind, text):
    return [i for block in OURS[kind].encode(text) for i in block]


def test_query_equals_library(spark):
    t = THEIRS["word_bpe_49k"]
    want = []
    for i, text in documents().items():
        ids = t.encode(text, add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(back)))
    got = [tuple(r) for r in QUERIES["op1_bpe"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


TEXTS = [
    "", " ", "it's we'RE ''s !!'s", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <|end", "ΑΣ ΣΑΣ. Σ", "İSTANBUL ǅ ﬁ",
    "éẹ́ ́x a̸ 각 한국어", "x\x1cy\x1f z\x85w v u　t​s﻿r", "²³ ١٢٣ 1234.5", "\U0001f600\U0001f468‍\U0001f469 ©®",
    "#" * 3000 + "'s" + "!" * 5000, "ab" * 6000 + "1" * 5000 + "é" * 4100, "the" * 9000 + " the", "a" * 4096 + "́" * 50 + "b" * 5000,
    " " * 5000 + "x" + "\n" * 4500, "'" * 4094 + "re" + "'" * 4095 + "ll", "漢字" * 3000,
    " " * 9000 + "x", "\n" * 13_000 + "y z", "\t " * 5000 + "'s", " " + "q" * 9000 + " " * 8200, "7" * 9000 + " " + "8" * 8192 + "x",
]


@pytest.mark.parametrize("kind", PATHS)
@pytest.mark.parametrize("text", TEXTS)
def test_encode_and_decode_equal_library(kind, text):
    want = THEIRS[kind].encode(text, add_special_tokens=False).ids
    got = ids_of(kind, text)
    assert got == want
    for step in (1, 2, 7, 1000):
        d = bpe.Decoder(OURS[kind])
        back = "".join(d.feed(got[at : at + step]) for at in range(0, len(got), step)) + d.finish()
        assert back == THEIRS[kind].decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("kind", PATHS)
@settings(max_examples=400, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FF), st.sampled_from(list("'sretvdlm <|>\n\taé1!Σ́\x1c")), st.characters(codec="utf-8")), max_size=60))
@example(text="<|endoftext|>'s")
def test_any_text_equals_library(kind, text):
    assert ids_of(kind, text) == THEIRS[kind].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", PATHS)
def test_broken_ids_decode_as_library(kind):
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(49_000) if rng.random() < 0.3 else rng.randrange(256) for _ in range(30)]
        d = bpe.Decoder(OURS[kind])
        assert "".join(d.feed([i]) for i in ids) + d.finish() == THEIRS[kind].decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("kind", PATHS)
def test_lookahead_is_sufficient(kind):
    """What follows beyond the lookahead never changes a stable token."""
    b, rng = OURS[kind], random.Random(4)
    reach = b.lookahead()
    assert 8 <= reach <= 2000
    tokens = [t for t in b.vocab if not t.endswith("</w>") and len(t) > 1]
    for _ in range(60):
        text = "".join(rng.choice(tokens) for _ in range(400))[: 600 + reach]
        whole = b.merge(list(text))
        for end in (reach + 200, reach + 350):
            stable, n = [], 0
            for t in b.merge(list(text[:end])):
                if n + len(t) > end - reach:
                    break
                stable.append(t)
                n += len(t)
            assert stable == whole[: len(stable)]


def test_rows(spark):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "twice"), (3, "twice"), (4, "word " * 50_000)]
    docs = docs_frame(spark, rows).withColumns({c: F.lit(1) for c in ("ids", "id", "n_tokens")})
    path, t = PATHS["byte_bpe_50k"], THEIRS["byte_bpe_50k"]
    enc = bpe.encode(docs, path)
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in enc.collect())
    assert got == sorted((i or 0, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows)
    back = bpe.decode(enc.withColumn("text", F.lit("clash")), path)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == sorted((i or 0, x or "") for i, x in rows)
    assert bpe.round_trip(docs_frame(spark, []), path).collect() == []
