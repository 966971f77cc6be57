"""The Merkle manifest against a plain tree, with proofs checked from the leaf up."""

import hashlib

from pyspark.sql import functions as F

from spotweave.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree long, _at long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    for nodes in levels[:-1]:
        first = at - at % 3
        yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])
        at //= 3


def by_force(rows, changed):
    """(id, leaf, subroot, root, proof, folded, verified) of each row."""
    null_first = lambda v: (v is not None, v or 0)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (null_first(r[0]), leaf(r))) for s in sources}
    trees = {s: tree_of([leaf(r) for r in own[s]]) for s in sources}
    top = tree_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(own[s]):
            steps = [*way(trees[s], at), *way(top, k)]
            value = leaf(changed(r))
            for left, right in steps:
                value = sha(left + value + right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), value, value == top[-1][0]))
    return out


def tampered(r):
    return (*r[:4], r[4].replace("\n", "")) if r[0] is not None and r[0] % 2 == 0 and r[4] is not None else r


def test_manifest_of_small_and_large_sources(spark):
    rows = [(i, "big", "en", i, f"text {i}\n" * (i % 3)) for i in range(0, 3000, 4)]  # more than one block, even a third level of blocks' sizes
    rows += [(i, "one", None, None, "x") for i in [5]] + [(i, "four", "de", 1, "a\nb") for i in range(10, 14)]
    rows += [(7, None, None, None, None), (None, None, "en", 3, "tie"), (None, None, "en", 3, "other"), (7, "é", "fr", 2, "é\n"), (7, "é", "fr", 2, "é\n"), (8, "", "", 0, "")]
    rows += [(9000, "long", "en", 1, "word\n" * 200_000)]
    df = spark.createDataFrame([(*r, "clash", 5, 6) for r in rows], SCHEMA).repartition(7)
    got = merkle.manifest(df, changed={"text": F.translate("text", "\n", "")}, where=F.col("doc_id") % 2 == 0)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, by_force(rows, tampered)))
    assert got.where(~F.col("verified")).count() > 200


def test_blocks_of_a_deep_tree(spark):
    rows = [(i, "s", "en", 0, str(i)) for i in range(merkle.BLOCK * 4 + 1)]
    got = merkle.manifest(spark.createDataFrame([(*r, "", 0, 0) for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(by_force(rows, lambda r: r)) and all(r.verified for r in got)


def test_a_table_without_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_midstates_fold_any_place():
    for n in (1, 2, 3, 4, 9, 10, 100, merkle.BLOCK):
        nodes = [sha(str(i)) for i in range(n)]
        block = merkle.Midstates(nodes, merkle.levels_of(n))
        for at in {0, n // 2, n - 1}:
            changed = [*nodes]
            changed[at] = sha("new")
            assert block.fold(at, sha("new")) == tree_of(changed)[-1][0] and block.fold(at, nodes[at]) == tree_of(nodes)[-1][0]
