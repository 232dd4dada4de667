"""The Merkle manifest against a plain version."""

import hashlib
import zlib

import pytest
from test_edges import BASE, CLASH, ROWS

from pulseline.llm import merkle
from pulseline.llm.common import table

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(level):
    levels = [level]
    while len(level) > 1:
        level = [digest(*level[i : i + 8]) for i in range(0, len(level), 8)]
        levels.append(level)
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        yield level[first:i], level[i + 1 : first + 8]
        i //= 8


def plain(rows):
    by_lang = {}
    for r in rows:
        order = (r[0] is not None, r[0] or 0, leaf(r))
        by_lang.setdefault(r[2], []).append((order, r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted(by_lang[x], key=lambda m: m[0]) for x in langs}
    trees = {x: tree([order[2] for order, _ in members[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for j, lang in enumerate(langs):
        for i, (order, r) in enumerate(members[lang]):
            path = [*siblings(trees[lang], i), *siblings(top, j)]
            own = order[2]
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                own = leaf((*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)})))
            for left, right in path:
                own = digest(*left, own, *right)
            proof = digest(*(x for left, right in path for x in left + right))
            root = top[-1][0]
            out.append((r[0], order[2], trees[lang][-1][0], root, proof, own, own == root))
    return out


def same(docs):
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    key = lambda r: (r[0] is not None, r)
    got = sorted((tuple(r) for r in merkle.proofs(docs).collect()), key=key)
    assert got == sorted(plain(rows), key=key)
    return got


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_proofs_of_the_given_documents(spark, sf):
    got = same(table(spark, f"/root/testdata/sf{sf}", "documents"))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n, langs", [(1, 1), (2, 1), (8, 1), (9, 1), (65, 1), (600, 1), (9, 9), (40, 20), (200, 70)])
def test_shapes_of_trees(spark, n, langs):
    rows = [(i, f"Text {i}", f"l{i % langs}" if i % langs else None, "s", 7) for i in range(n)]
    same(spark.createDataFrame(rows, BASE.rstrip(", ")).repartition(5))


def test_trees_of_uneven_height(spark):
    sizes = {"": 1, None: 3, "a|1": 700, "b": 64, "-": 9, "é": 1}
    langs = [lang for lang, n in sizes.items() for _ in range(n)]
    rows = [(i, "Same Text", lang, None, None) for i, lang in enumerate(langs)]
    same(spark.createDataFrame(rows, BASE.rstrip(", ")))


def test_edges(spark):
    rows = [(*r, len(r[1] or ""), *["x"] * len(CLASH)) for r in ROWS]
    names = ", ".join(f"{c} string" for c in CLASH)
    extra = ["_at", "_tie", "_g", "_part", "tree", "idx", "node", "digest", "run", "path", "up", "leaf"]
    docs = spark.createDataFrame(rows, BASE + names)
    for c in extra:
        docs = docs.withColumn(c, docs.text)
    got = same(docs)
    # Repeated rows are leaves each, with the same digest.
    assert len([r for r in got if r[0] == 8]) == 2
    assert merkle.proofs(docs.limit(0)).count() == 0
    assert merkle.manifest(docs.limit(0)).columns == merkle.manifest(docs).columns


def test_hot_id(spark):
    rows = [(7 if i % 3 else i, "Repeated Row", "en", "s", 12) for i in range(500)]
    same(spark.createDataFrame(rows, BASE.rstrip(", ")).repartition(7))


def test_a_proof_shows_any_change(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = merkle.manifest(docs).limit(20).collect()
    for r in rows:
        own = r.leaf
        for step in r.path:
            own = digest(step.left, own, step.right)
        assert own == r.root
        assert sum(len(s.left + s.right) for s in r.path) % 64 == 0
