"""The Merkle manifest against a plain tree of lists."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from catloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, _hash string, _pos string, _tree int"
LONG = "Word " * 50_000


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def climb(nodes, index):
    """(root, siblings by level) of a list of nodes."""
    beside = []
    while len(nodes) > 1:
        start = index // 8 * 8
        beside += nodes[start:index] + nodes[index + 1:start + 8]
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        index //= 8
    return nodes[0], beside


def slow(rows):
    none_first = lambda v: (v is not None, v)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (none_first(r[0]), leaf(r))) for g in langs}
    tops = [climb([leaf(r) for r in trees[g]], 0)[0] for g in langs]
    out = []
    for place, g in enumerate(langs):
        leaves = [leaf(r) for r in trees[g]]
        for index, r in enumerate(trees[g]):
            root, upper = climb(tops, place)
            top, lower = climb(leaves, index)
            folded = root
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                changed = climb([*leaves[:index], leaf((r[0], text, *r[2:])), *leaves[index + 1:]], index)[0]
                folded = climb([*tops[:place], changed, *tops[place + 1:]], place)[0]
            out.append((r[0], leaves[index], top, root, h(*lower, *upper), folded, folded == root))
    return sorted(out, key=str)


def rows_of(n, langs):
    return [(i, f"Text {i} É" if i % 5 else f"text {i}", langs[i % len(langs)], f"s{i % 3}", i * 2) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest(spark, levels):
    rows = rows_of(150, ["en", None, "", "de", "en", "en"]) + [
        (None, None, None, None, None), (None, "A", "x", None, 3), (900, LONG, "x", "s", 1), (901, "", "é", "s", None), (7, "Other", "de", "s", 1),
        (12, "B", "y", "s", 1), (12, "B", "y", "s", 1),
    ] + [(1000 + i, "T", f"l{i}", "s", 1) for i in range(70)]
    df = spark.createDataFrame([(*r, "a", 1, "b", "c", 2) for r in rows], SCHEMA)
    out = merkle.merkle_manifest(df, block_levels=levels)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "version_nodes"]
    got = out.collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == slow([r for r in rows])
    assert any(r["verified"] for r in got) and not all(r["verified"] for r in got)
    for r in got:  # a version copies the ancestors of its leaf and nothing else
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        assert (r["version_nodes"] is not None) == tampered
        if tampered:
            assert r["version_nodes"][-1] == r["folded_root"]


def test_single_leaf_and_empty(spark):
    rows = [(3, "One", "en", None, 1)]
    df = spark.createDataFrame([(*r, "a", 1, "b", "c", 2) for r in rows], SCHEMA)
    got = merkle.merkle_manifest(df).collect()
    assert [tuple(r)[:7] for r in got] == slow(rows)
    assert got[0]["leaf"] == got[0]["subroot"] == got[0]["root"] and got[0]["proof_sha256"] == h("")
    assert merkle.merkle_manifest(df.limit(0)).count() == 0


def test_other_tampering(spark):
    rows = rows_of(40, ["en", "de"])
    df = spark.createDataFrame([(*r, "a", 1, "b", "c", 2) for r in rows], SCHEMA)
    got = merkle.merkle_manifest(df, tampered=F.lit(None).cast("boolean")).collect()
    assert all(r["verified"] and r["version_nodes"] is None for r in got)


def test_versions_share_nodes():
    tree = merkle.PersistentTree()
    leaves = [h(str(i)) for i in range(100)]
    root = tree.build(leaves, 3)
    size = len(tree.hashes)
    version = tree.replace(root, 37, 3, h("new"))
    assert len(tree.hashes) == size + 4  # the leaf and its three ancestors
    assert tree.hashes[root] == climb(leaves, 0)[0] and tree.hashes[version] == climb([*leaves[:37], h("new"), *leaves[38:]], 0)[0]
    old, new = tree.children[root], tree.children[version]
    assert sum(a != b for a, b in zip(old, new, strict=True)) == 1
    tree.forget(size)
    assert len(tree.hashes) == size and tree.siblings(root, 37, 3)[0] == ("".join(leaves[32:37]), "".join(leaves[38:40]))


@pytest.mark.parametrize("n, levels", [(1, 0), (2, 1), (8, 1), (9, 2), (64, 2), (65, 3), (8**7, 7), (8**7 + 1, 8)])
def test_levels(spark, n, levels):
    assert spark.range(1).select(merkle._levels(F.lit(n)).alias("k")).first()["k"] == levels
