"""A Merkle manifest of a table of documents, with a proof of membership for every row.

Each document's digest is a leaf. The leaves of a language form a tree whose inner nodes hash up to
``FAN`` consecutive nodes below; the roots of the languages form one more tree of the same kind.

Proofs come from pointer jumping. Every inner node holds a pointer to an ancestor and the sibling segments on the
way there, at first those of one step to its parent. A self-join appends to each node's segments those of
the ancestor it points to and takes over that one's pointer, so the distance doubles with every join
and all nodes reach the root after as many joins as the logarithm of the height. The siblings of a
leaf are the rest of its run, which all leaves of the run share; they are the last segment to be added, when
runs are opened into their leaves again, so texts never move and segments move once per run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseline.llm.common import prepare, stored

#: Nodes of a run, which become one node of the next level.
FAN = 8
#: Copies of an ancestor's row that share the nodes pointing to it, at most.
SALTS = 4096
#: The tree of the languages' roots. Trees of languages start with a sign.
TOP = ""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(*parts: Column) -> Column:
    """Lowercase hex digest of the parts, one after another."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(value: Column) -> Column:
    """A value with its length, so that no two rows have the same encoding; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return sha(*(field(c) for c in (doc_id, source, lang, n_chars, text)))


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 within their group, in ``order``.

    Rows are dealt into ranges by group and order, so a group of any size is spread over many tasks;
    the place in a range plus the sizes of the ranges before give the place in the group. What windows
    see is one row per range and group.
    """
    placed = (
        rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(F.col(group), *order, F.col("_tie"))
        .sortWithinPartitions(F.col(group), *order, F.col("_tie"))
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_tie")
    )
    # The places hold for what is written here, whatever a later run deals.
    placed = stored(placed, "placed")
    part = F.shiftright("_at", 33)
    spans = placed.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    spans = stored(spans.drop("_n"), "spans")
    joined = placed.withColumn("_p", part).join(
        spans, (F.col(group) == F.col("_g")) & (F.col("_p") == F.col("_part"))
    )
    idx = F.col("_at") - F.col("_first") + F.col("_before")
    return joined.withColumn("idx", idx).drop("_at", "_p", "_g", "_part", "_first", "_before")


def _node(level, idx: Column | str = "idx") -> Column:
    """A node's name; the tree may hold any sign, the numbers behind it none."""
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.concat_ws("|", "tree", F.lit(level).cast("string"), idx.cast("string"))


def _runs(nodes: DataFrame, level: int, payload: list[str]) -> DataFrame:
    """The nodes of ``level`` over nodes (tree, idx, node, digest): with their runs in order."""
    held = F.struct("idx", "node", "digest", *payload)
    runs = nodes.groupBy("tree", F.floor(F.col("idx") / FAN).alias("idx_")).agg(
        F.array_sort(F.collect_list(held)).alias("run")
    )
    runs = runs.withColumnRenamed("idx_", "idx")
    digests = F.transform("run", lambda x: x["digest"])
    return runs.withColumn("digest", sha(F.array_join(digests, ""))).withColumn("node", _node(level))


def _levels(nodes: DataFrame, most: int, payload: list[str]) -> list[DataFrame]:
    """Stored levels above nodes (tree, idx, n, node, digest): runs with n, the nodes of their level.

    ``most`` is the largest n; trees whose n is 1 have reached their root.
    """
    out, level = [], 0
    while most > 1:
        level += 1
        runs = _runs(nodes.filter("n > 1"), level, ["n", *(payload if level == 1 else [])])
        n = F.ceil(F.col("run")[0]["n"] / FAN)
        out.append(stored(runs.withColumn("n", n), "level"))
        nodes, most = out[-1].select("tree", "idx", "n", "node", "digest"), -(-most // FAN)
    return out


def _beside(run: Column | str, place: Column) -> list[Column]:
    """The digests to the left and to the right of a place (from 0) in a run, each in one string."""
    digests = F.transform(run, lambda x: x["digest"])
    left = F.array_join(F.slice(digests, F.lit(1), place), "")
    right = F.array_join(F.slice(digests, place + 2, F.lit(FAN)), "")
    return [left.alias("left"), right.alias("right")]


def _steps(level: DataFrame, height: Column) -> DataFrame:
    """One step up for each node in the runs of a level: node, up, path and a bound of its height."""
    each = level.select("run", F.col("node").alias("up"), F.posexplode("run").alias("place", "own"))
    return each.select(
        F.col("own.node").alias("node"),
        "up",
        F.array(F.struct(*_beside("run", F.col("place")))).alias("path"),
        height.alias("height"),
    )


def paths_to_root(steps: DataFrame, root: str, height: int) -> DataFrame:
    """node and path (sibling segments up to the root) from single steps (node, up, path, height).

    ``height`` bounds the number of steps of any node. A node that points to the root is done. The others are joined with
    the nodes they point to; after the r-th join 2^r steps are behind one pointer. Up to 8^(2^r) nodes then
    point to the same ancestor, so each ancestor has copies, of which a node takes one by its hash.
    """
    table, distance = steps, 1
    ended = F.col("up") == root
    while distance < height:
        salts = min(FAN ** (distance - 1), SALTS)
        going = table.filter(~ended).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)))
        # Only what has nodes that far below can be met.
        ahead = table.filter(F.col("height") >= distance).select(
            F.col("node").alias("_node"),
            F.col("up").alias("_up"),
            F.col("path").alias("_path"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"),
        )
        met = going.join(ahead, (F.col("up") == F.col("_node")) & (F.col("salt") == F.col("_salt")))
        moved = met.select(
            "node", F.col("_up").alias("up"), F.concat("path", "_path").alias("path"), "height"
        )
        # Nodes that are done are still pointed to by others.
        table = stored(moved.unionByName(table.filter(ended)), "jumps")
        distance *= 2
    return table.select("node", "path")


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    lang_col: str = "lang",
    chars_col: str = "n_chars",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, lang, leaf, tampered_leaf, subroot, root, path of every document.

    ``path`` holds, from the leaf to the root, the digests of the siblings to the left and to the right on
    every level. ``tampered_leaf`` is the digest of the row with A-Z of its text in lower case where 3
    divides the crc32 of its id, else null.

    Null values are encoded as such; a null language is a language of its own, first in order, and
    an empty one is another. Null ids come first in their language and are never tampered with. Rows
    that share an id are ordered by their digests; repeated rows are leaves each. A single row is its own
    root and its path is empty. An empty table gives no rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    key = F.col(id_col).cast("long")
    others = [F.col(c) for c in (source_col, lang_col, chars_col)]
    text = F.col(text_col).cast("string")
    marked = F.crc32(key.cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(
        key.alias("doc_id"),
        # Sorts as null, then by bytes.
        F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("-")).alias("tree"),
        leaf_digest(key, *others, text).alias("digest"),
        F.when(
            marked & text.isNotNull(), leaf_digest(key, *others, F.translate(text, UPPER, LOWER))
        ).alias("tampered"),
    )
    # Stored, for texts are hashed once and not again where ranges are sampled.
    leaves = numbered(stored(leaves, "leaves"), "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    leaves = stored(leaves, "numbered")
    trees = stored(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "trees")
    most = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    if not most[0]:
        return docs.sparkSession.createDataFrame([], MANIFEST)
    sized = leaves.join(trees, "tree").withColumn("node", _node(0))
    levels = _levels(sized, most[0], ["doc_id", "tampered"])
    single = sized.filter("n = 1")
    roots = single.select("tree", "node", "digest")
    for level in levels:
        roots = roots.unionByName(level.filter("n = 1").select("tree", "node", "digest"))
    roots = stored(roots, "subroots")
    top = numbered(roots.withColumn("group", F.lit(TOP)).withColumnRenamed("tree", "_tree"), "group", [F.col("_tree")])
    top = stored(top.select(F.col("group").alias("tree"), "idx", "node", "digest", F.lit(most[1]).alias("n")), "top")
    above = _levels(top, most[1], [])
    last = above[-1] if above else roots
    root = last.select("node", "digest").first()
    # Runs of leaves are the lowest nodes that point; trees of languages stand below the top tree.
    ladder = [_steps(level, F.lit(i)) for i, level in enumerate([*levels[1:], *above])]
    ways = None
    if ladder:
        steps = stored(reduce(DataFrame.unionByName, ladder), "steps")
        ways = paths_to_root(steps, root.node, len(ladder))
    # Runs and single leaves, with what lies above them; that of the root itself is empty.
    none = F.array().cast(PATH)
    alone = F.array(F.struct("idx", "node", "digest", "n", "doc_id", "tampered"))
    held = single.select("tree", "node", alone.alias("run"))
    if levels:
        held = held.unionByName(levels[0].select("tree", "node", "run"))
    if ways is not None:
        held = held.join(ways.withColumnRenamed("path", "above"), "node", "left")
    else:
        held = held.withColumn("above", none)
    held = held.join(roots.select("tree", F.col("digest").alias("subroot")), "tree")
    each = held.select("tree", "subroot", "above", "run", F.posexplode("run").alias("place", "own"))
    # A leaf alone in its language is no run: its path starts at the language's root.
    inside = F.when(F.col("own.n") > 1, F.array(F.struct(*_beside("run", F.col("place"))))).otherwise(none)
    return each.select(
        F.col("own.doc_id").alias("doc_id"),
        F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30)).alias("lang"),
        F.col("own.digest").alias("leaf"),
        F.col("own.tampered").alias("tampered_leaf"),
        "subroot",
        F.lit(root.digest).alias("root"),
        F.concat(inside, F.coalesce("above", none)).alias("path"),
    )


def proof_digest(path: Column | str) -> Column:
    """Digest of all siblings of a path, from the leaf upwards, left to right."""
    return sha(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def folded(path: Column | str, start: Column) -> Column:
    """The root that follows from a leaf's digest and the siblings on its path."""
    return F.aggregate(path, start, lambda own, x: sha(x["left"], own, x["right"]))


def proofs(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; see ``manifest``.

    ``folded_root`` follows from the tampered leaf, if there is one, and the siblings of the original tree.
    """
    rows = manifest(docs, **columns)
    start = F.coalesce("tampered_leaf", "leaf")
    rows = rows.withColumn("folded_root", folded("path", start))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest("path").alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


PATH = "array<struct<left:string,right:string>>"
MANIFEST = (
    "doc_id long, lang string, leaf string, tampered_leaf string, subroot string, root string, "
    f"path {PATH}"
)
