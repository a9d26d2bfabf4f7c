"""Small inputs and brute-force pieces for the operator tests."""

import re

import pyarrow.parquet as pq

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(text or "")


def documents(sf=SF):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}


def docs_frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def components(nodes, links):
    """node -> smallest node reachable."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
