import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwright.llm import token_output
from sparkwright.llm.workloads import QUERIES

from .helpers import SF, docs_frame, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(rows, docs, capacity, pad_id=0):
    """Segments put together again are the ids of every document; the rest of a
    row is padding. Returns (rows, tokens)."""
    got, tokens = [], 0
    for r in rows:
        ids, cu = np.frombuffer(r["ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == capacity and cu[0] == 0 and cu[-1] <= capacity and (np.diff(cu) > 0).all()
        assert r["position_resets"] == cu[:-1] and (ids[cu[-1] :] == pad_id).all()
        assert len(r["doc_ids"]) == len(r["pieces"]) == len(r["starts"]) == len(cu) - 1
        for k, (s, e) in enumerate(zip(cu, cu[1:])):
            got.append((r["doc_ids"][k], r["pieces"][k], r["starts"][k], ids[s:e].tolist()))
            tokens += e - s
    want = []
    for i, text in docs:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        lead = len(ids) % capacity or capacity
        cuts = [0, *range(lead, len(ids) + 1, capacity)]
        want += [(i, k, s, ids[s:e]) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    return len(rows), tokens


def test_query_round_trip_in_few_rows(spark):
    n, tokens = check(QUERIES["op2_token_output"](spark, SF).collect(), documents().items(), 2048)
    assert n <= 1.02 * -(-tokens // 2048) + 1


def test_edge_rows_packers_and_matrices(spark, tmp_path):
    docs = [(1, None), (2, ""), (None, "x"), (3, "same"), (3, "same"), (4, "word " * 9000), (5, "<|endoftext|> a")]
    docs += [(10 + i, "tok " * (i % 70)) for i in range(300)]
    df = docs_frame(spark, docs).withColumns({c: F.lit(1) for c in ("id", "ids", "piece", "length", "starts")})
    for n in (8000, 40):
        packed = token_output.packed_rows(df, PATH, capacity=128, pad_id=7, packer_pieces=n)
        rows = packed.collect()
        check(rows, docs, 128, 7)
    token_output.write_matrices(packed, str(tmp_path / "m"), rows=16)
    blocks = spark.read.parquet(str(tmp_path / "m")).collect()
    assert sum(b["n_rows"] for b in blocks) == len(rows) and all(b["n_rows"] <= 16 for b in blocks)
    seen = []
    for b in blocks:
        matrix = np.frombuffer(b["ids"], "<u2").reshape(b["n_rows"], 128)
        cu, at = np.frombuffer(b["cu_seqlens"], "<i4"), 0
        for r, k in zip(matrix, b["segments"]):
            seen.append((r.tobytes(), cu[at : at + k + 1].tolist()))
            at += k + 1
    assert sorted(seen) == sorted((r["ids"], r["cu_seqlens"]) for r in rows)
    assert token_output.packed_rows(docs_frame(spark, []), PATH).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_placement_is_best_fit_decreasing(seed):
    rng, capacity = random.Random(seed), rng_capacity(seed)
    lengths = np.array([rng.randint(1, capacity) for _ in range(200)])
    order, row, offset = token_output.best_fit_decreasing(lengths, capacity)
    gaps = []
    for n, r, o in zip(lengths[order], row, offset):
        fits = [g for g in gaps if g >= n]
        if fits:
            assert gaps[r] == min(fits) and o == capacity - gaps[r]
        else:
            assert (r, o) == (len(gaps), 0)
            gaps.append(capacity)
        gaps[r] -= n
    assert list(lengths[order]) == sorted(lengths, reverse=True)


def rng_capacity(seed):
    return [7, 8, 20, 31, 32, 100][seed]


def test_gap_tree_finds_the_first_gap():
    rng, tree, gaps = random.Random(1), token_output.GapTree(50), [0] * 51
    for _ in range(2000):
        g = rng.randint(0, 50)
        change = -1 if gaps[g] and rng.random() < 0.5 else 1
        gaps[g] += change
        tree.add(g, change)
        want = rng.randint(0, 50)
        assert tree.first(want) == next((k for k in range(want, 51) if gaps[k]), None)


def test_position_ids_restart():
    assert token_output.position_ids([0, 2, 5], 8).tolist() == [0, 1, 0, 1, 2, 0, 1, 2]
    assert token_output.position_ids([0, 3], 3).tolist() == [0, 1, 2]


def test_equal_rows_spread_over_the_packers(spark):
    docs = [(None, "the same words")] * 2000
    rows = token_output.packed_rows(docs_frame(spark, docs), PATH, capacity=64, packer_pieces=100).collect()
    check(rows, docs, 64)
    held = {}
    for r in rows:
        packer = r["sequence_id"] >> 40
        held[packer] = held.get(packer, 0) + len(r["pieces"])
    assert max(held.values()) <= 200
