"""Fingerprints bit by bit, and links against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spotweave.llm import catalog, simhash
from tests.llm.test_llm import SF


def fingerprint_by_force(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_by_force(prints, most=4):
    """For each fingerprint the place of the first one reachable."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= most):
            a, b = sorted((find(int(j)), find(i)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def test_op13_over_a_whole_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [fingerprint_by_force(t) for _, t in docs]
    roots = roots_by_force(prints)
    found = catalog.op13_simhash(spark, SF)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in found.collect()}
    assert got == {i: (f"{p:016x}", docs[r][0]) for (i, _), p, r in zip(docs, prints, roots, strict=True)}
    assert max(Counter(roots).values()) > 1


def clustered(rng, n):
    """Numbers of 64 bits in chains and balls, some alone."""
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 40])):
            out.add(x)
            y = x
            for b in rng.sample(range(64), rng.randint(1, 7)):
                y ^= 1 << b
            x = y if rng.random() < 0.5 else x
            out.add(y)
    return sorted(out)


@pytest.mark.parametrize(("crowd", "cell_most"), [(64, 1 << 16), (1, 1 << 16), (1e9, 300), (0.001, 50)])
def test_links_lose_nothing(spark, crowd, cell_most):
    prints = clustered(random.Random(5), 2500)
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "node long")
    found = simhash.links(nodes, len(prints), crowd=crowd, cell_most=cell_most).collect()
    pairs = {(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64))) for r in found}
    assert all((a ^ b).bit_count() <= 4 and a != b for a, b in pairs)
    at = {p: k for k, p in enumerate(prints)}
    root = list(range(len(prints)))
    for _ in range(60):  # labels go along the links
        for a, b in pairs:
            root[at[a]] = root[at[b]] = min(root[at[a]], root[at[b]])
    assert root == roots_by_force(prints)


def test_manhattan_distance_is_a_lower_bound(spark):
    rng = random.Random(3)
    x = [rng.getrandbits(64) for _ in range(500)]
    y = [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for v in x]
    counts = lambda v: [(v >> 2 * k & 3).bit_count() for k in range(32)]
    a, b = simhash.counts_in(np.array(x, np.uint64)), simhash.counts_in(np.array(y, np.uint64))
    apart = np.bitwise_count(a ^ b).tolist()
    assert apart == [sum(abs(p - q) for p, q in zip(counts(u), counts(v), strict=True)) for u, v in zip(x, y, strict=True)]
    assert all(d <= (u ^ v).bit_count() for d, u, v in zip(apart, x, y, strict=True))
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in x], "node long").select(simhash.counts_of(F.col("node")).alias("c"))
    assert [np.int64(r.c).astype(np.uint64) for r in df.collect()] == a.tolist()


def test_odd_rows(spark):
    long = " ".join(random.Random(1).choices([f"w{i}" for i in range(500)], k=120_000))
    rows = [(3, long), (9, long + " tail"), (1, None), (2, ""), (4, " \t\n"), (5, "one TWO"), (6, "One two"), (6, "one two"), (None, "one two"), (None, "nobody else says this"), (7, "É é"), (8, "é É")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, fingerprint string, node long, component_id long")
    got = sorted(((r.id, r.fingerprint, r.component_id) for r in simhash.similar_groups(docs).collect()), key=str)
    prints = {t: f"{fingerprint_by_force(t):016x}" for _, t in rows}
    groups = {long: 3, long + " tail": 3, None: 1, "": 1, " \t\n": 1, "one TWO": 5, "One two": 5, "one two": 5, "É é": 7, "é É": 8}
    assert got == sorted(((i, prints[t], groups.get(t, i)) for i, t in rows), key=str)
    assert simhash.similar_groups(docs.limit(0)).collect() == []
