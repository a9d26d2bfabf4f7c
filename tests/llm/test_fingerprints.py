import hashlib
import random

import pytest
import xxhash

from sparkwright.llm import fingerprints as fp
from sparkwright.llm.workloads import QUERIES

from .helpers import SF, docs_frame, documents


def slow_fingerprint(data):
    """Byte by byte, from the definition."""
    if not data:
        return "4::"
    ones = []
    for i in range(len(data)):
        h = 0
        for back in range(min(7, i + 1)):
            h += (data[i - back] + 1) * pow(0x9E3779B1, back, 1 << 32)
        h &= 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
        n = 0
        while h >> n & 1:
            n += 1
        ones.append(n)
    k = 2
    while 64 * 2**k < len(data):
        k += 1
    while k > 2 and sum(n >= k for n in ones) < 32:
        k -= 1

    def codes(level):
        chunks, start = [], 0
        for i, n in enumerate(ones):
            if n >= level and len(chunks) < 63:
                chunks.append(data[start : i + 1])
                start = i + 1
        if start < len(data):
            chunks.append(data[start:])
        out = ""
        for c in chunks:
            v = xxhash.xxh3_64_intdigest(c) >> 52
            out += fp.DIGITS[v // 64] + fp.DIGITS[v % 64]
        return out

    return f"{2**k}:{codes(k)}:{codes(k + 1)}"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] if x == y else 1 + min(above[j], row[j - 1]))
    return row[-1]


def brute(rows):
    """rows: (id, text); the next document by falling id, then text digest."""
    order = sorted(
        ((i, t or "") for i, t in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, changed, other = (fp.fingerprint(x.encode()) for x in (t, edited, following))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed,
                    fp.likeness(own, changed), fp.likeness(own, other)))
    return sorted(out, key=repr)


def report(docs, **kw):
    return sorted((tuple(r) for r in fp.edit_report(docs, **kw).collect()), key=repr)


def test_fingerprint_equals_its_definition(monkeypatch):
    rng = random.Random(1)
    texts = [b"", b"a", b"abcdef", b"a" * 3000, b"ab" * 2000, bytes(range(256)) * 5]
    texts += [bytes(rng.choice(b"abcde fgh\n") for _ in range(n)) for n in (5, 63, 64, 65, 700, 5000)]
    texts += [t.encode() for t in list(documents().values())[:30] if t]
    want = [slow_fingerprint(t) for t in texts]
    assert [fp.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(fp, "SLICE", 50)  # positions do not depend on the slices
    assert [fp.fingerprint(t) for t in texts] == want


def test_edit_distance_equals_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert fp.edit_distance(a, b) == slow_distance(a, b)


def test_likeness_follows_edits():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = " ".join(word() for _ in range(2000))
    other = " ".join(word() for _ in range(2000))
    grown = text[:5000] + " inserted words here " + text[5000:]
    half = text[: len(text) // 2] + other[: len(text) // 2]
    a, b, c, d = (fp.fingerprint(t.encode()) for t in (text, grown, half, other))
    assert fp.likeness(a, a) == 1.0 and fp.likeness(a, b) > 0.9 and 0.35 < fp.likeness(a, c) < 0.65
    assert fp.likeness(a, d) < 0.1 and fp.likeness(a, b) == fp.likeness(b, a)
    assert fp.likeness(a, fp.fingerprint(b"tiny")) == 0.0 and fp.likeness("4::", a) == 0.0


def test_query_equals_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op12_fingerprints"](spark, SF).collect()), key=repr)
    assert got == brute(list(documents().items()))


@pytest.mark.parametrize("range_bytes", [300, 1 << 20])
def test_ranges_change_nothing(spark, range_bytes):
    rng = random.Random(4)
    rows = [(rng.randrange(300), " ".join(rng.choice("ab cd é \U0001f600".split()) for _ in range(rng.randrange(30))))
            for _ in range(700)]
    docs = docs_frame(spark, rows).repartition(5)
    assert report(docs, range_bytes=range_bytes) == brute(rows)


EDGES = [(1, None), (2, ""), (3, "x"), (3, "x"), (3, "xy"), (None, "a b"), (None, "a b"), (None, None),
         (7, "long " * 60_000), (8, "\U0001f600 café 한" * 3)]


def test_edge_rows(spark):
    names = "range ahead id digest body copies copy n_chars".split()
    docs = docs_frame(spark, EDGES).selectExpr("*", *(f"1 AS {c}" for c in names))
    assert report(docs) == brute(EDGES)


@pytest.mark.parametrize("rows", [[], [(4, "only one")], [(None, None)], [(5, "a b c d")] * 3])
def test_few_rows(spark, rows):
    assert report(docs_frame(spark, rows)) == brute(rows)


def test_many_equal_rows_move_once_a_task(spark):
    rows = [(None, "the same text " * 9)] * 12_000 + [(i, f"text number {i}") for i in range(50)]
    docs = docs_frame(spark, rows).repartition(8)
    assert report(docs) == brute(rows)


def test_column_of_fingerprints(spark):
    docs = docs_frame(spark, EDGES).selectExpr("*", "1 AS doc", "2 AS body")
    got = fp.add_fingerprint(docs).select("doc.doc_id", "doc.text", "fingerprint").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, t, fp.fingerprint((t or "").encode()))) for i, t in EDGES)
    assert fp.add_fingerprint(docs.limit(0)).collect() == []
