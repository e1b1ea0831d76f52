"""Merkle manifest of a dataset: a persistent, path-copying tree of digests.

Every row is a leaf, the SHA-256 of its fields.  Leaves of one language are one tree,
in key order; every ``ARITY`` consecutive nodes become the digest of their digests,
the last run with fewer, until one node is left, the subroot.  The subroots, in the
order of their languages, form one more tree in the same way; its top is the root.

A tree is cut into aligned blocks of ``ARITY ** BLOCK_LEVELS`` nodes, so a block's
inner nodes depend on nothing outside it.  Blocks are built in parallel; their tops are
the nodes of the next, 4096 times smaller tree, which is built in the same way, until
every tree is one block.  A block's way from its top to the root, with the siblings
met on it, then comes back down to it: a row per block, not per leaf.

A changed leaf makes a new *version* of its block: the nodes on its path are copied,
all others are shared with the versions before (:class:`PersistentTree`).  The
version goes on above the block by folding its top with the siblings of the
block's way, which is the copying of the ancestors there, in the task of the block.

Cases: a null field is written ``-``, any other as its size in bytes, ``:`` and its
value, so null and empty differ; rows without a language form a tree of their own,
the first; rows without a key come first in their tree and are never tampered with;
rows of equal key follow each other by digest, and equal rows by input position, so
they have equal digests and each a place of its own; a lone leaf is its own subroot, and
a lone subroot the root; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldsieve.durable import written
from goldsieve.operators.numbering import with_row_no

ARITY = 8
BLOCK_LEVELS = 4
SALTS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Step = tuple[int, list[str]]


def joint(digests: Sequence[str]) -> str:
    """The digest of a node from its children's, as hex text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def fold(digest: str, path: Sequence[Step]) -> str:
    """The top above a node: its own place and its siblings, level by level."""
    for at, others in path:
        digest = joint([*others[:at], digest, *others[at:]])
    return digest


class PersistentTree:
    """Nodes of an aligned block, of all its versions.

    A node is a number; ``digest`` and ``children`` never change once written.  A version
    is the number of its top.  ``levels``: how far to build; ``None``: up to one node.
    """

    def __init__(self, leaves: Sequence[str], levels: int | None = None):
        self.digest = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        level = list(range(len(leaves)))
        self.levels = 0
        while self.levels < levels if levels is not None else len(level) > 1:
            level = [self._node(tuple(level[at : at + ARITY])) for at in range(0, len(level), ARITY)]
            self.levels += 1
        (self.top,) = level

    def _node(self, children: tuple[int, ...]) -> int:
        self.digest.append(joint([self.digest[child] for child in children]))
        self.children.append(children)
        return len(self.digest) - 1

    def _way(self, top: int, leaf: int) -> list[tuple[int, int]]:
        """Inner nodes from the top to a leaf, each with the place of the next below."""
        way = []
        for level in range(self.levels - 1, -1, -1):
            place = leaf // ARITY**level % ARITY
            way.append((top, place))
            top = self.children[top][place]
        return way

    def path(self, leaf: int, top: int | None = None) -> list[Step]:
        """Places and sibling digests from a leaf up to the top of a version."""
        steps = []
        for node, place in reversed(self._way(self.top if top is None else top, leaf)):
            children = self.children[node]
            steps.append((place, [self.digest[c] for c in children[:place] + children[place + 1 :]]))
        return steps

    def version(self, leaf: int, digest: str, top: int | None = None) -> int:
        """The top of a version with another leaf; only the nodes above it are new."""
        way = self._way(self.top if top is None else top, leaf)
        self.digest.append(digest)
        self.children.append(())
        node = len(self.digest) - 1
        for above, place in reversed(way):
            children = self.children[above]
            node = self._node((*children[:place], node, *children[place + 1 :]))
        return node


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row's fields, with another ``text`` if one is given."""
    columns = {name: F.col(name) for name in FIELDS} | ({} if text is None else {"text": text})
    return F.sha2(F.concat(*(_field(columns[name]) for name in FIELDS)), 256)


def tampered(key: Column) -> Column:
    """Whether 3 divides the crc32 of the key as text; null keys are left alone."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))


_STEP = pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))])
_PATH = "array<struct<at int, others array<string>>>"


def _steps(path: Sequence[Step]) -> list[dict]:
    return [{"at": at, "others": others} for at, others in path]


def _levels(n: int, height: int) -> int | None:
    """A tree's only block ends in one node; other blocks are built to full height."""
    return None if n <= ARITY**height else height


def _blocks(nodes: DataFrame, *carry: str) -> DataFrame:
    """``tree, block, n, nodes``: the nodes of each aligned block, in order of place.

    ``nodes(tree, place, n, digest)``; at most ``ARITY ** BLOCK_LEVELS`` of them meet in a row.
    """
    block = F.floor(F.col("place") / ARITY**BLOCK_LEVELS).cast("bigint")
    held = F.struct("place", "digest", *carry)
    return nodes.groupBy("tree", block.alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(held)).alias("nodes")
    )


def _tops(blocks: DataFrame) -> DataFrame:
    """``tree, place, n, digest`` of the blocks' tops, nodes of the next tree."""

    height = BLOCK_LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for n, nodes in zip(batch.column(2).to_pylist(), batch.column(3)):
                tree = PersistentTree(nodes.values.field("digest").to_pylist(), _levels(n, height))
                tops.append(tree.digest[tree.top])
            above = [-(-n // ARITY**height) for n in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(above, pa.int64()), pa.array(tops, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "place", "n", "digest"])

    return blocks.mapInArrow(run, "tree string, place bigint, n bigint, digest string")


def paths(nodes: DataFrame) -> DataFrame:
    """``tree, place, path, top`` of ``nodes(tree, place, n, digest)``: the way to the top.

    For tops of blocks, of which there are few: a row holds all siblings on its way.
    """
    blocks = written(_blocks(nodes), "merkle-blocks")
    if blocks.where("block > 0").limit(1).count():
        above = paths(written(_tops(blocks), "merkle-tops"))
        above = above.withColumnRenamed("place", "block")
        blocks = blocks.join(above, ["tree", "block"])
    else:
        blocks = blocks.withColumns({"path": F.lit(None).cast(_PATH), "top": F.lit(None).cast("string")})
    types, height = [pa.string(), pa.int64(), pa.list_(_STEP), pa.string()], BLOCK_LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, held, path, top in zip(*(column.to_pylist() for column in batch.columns)):
                tree = PersistentTree([node["digest"] for node in held], _levels(n, height))
                top = tree.digest[tree.top] if top is None else top
                rows = [
                    (name, node["place"], _steps(tree.path(at)) + (path or []), top)
                    for at, node in enumerate(held)
                ]
                for low in range(0, len(rows), 512):
                    columns = zip(*rows[low : low + 512])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types)], ["tree", "place", "path", "top"]
                    )

    wanted = blocks.select("tree", "n", "nodes", "path", "top")
    return written(wanted.mapInArrow(run, f"tree string, place bigint, path {_PATH}, top string"), "merkle-paths")


def _with_tree(rows: DataFrame, trees: DataFrame, place: str) -> DataFrame:
    """``rows`` joined with their tree's one row; a tree's rows are dealt by place as well."""
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(place), F.lit(SALTS)))
    return salted.join(trees.select("*", salts.alias("salt")), ["tree", "salt"]).drop("salt")


def placed_leaves(docs: DataFrame) -> DataFrame:
    """``tree, place, n, doc_id, digest, changed``; one range sort of digests, not of texts.

    ``changed`` is the digest of the row after tampering, null for rows left alone.
    """
    lowered = F.translate("text", _UPPER, _LOWER)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_digest().alias("digest"),
        F.when(tampered(F.col("doc_id")), leaf_digest(lowered)).alias("changed"),
    )
    numbered = with_row_no(written(leaves, "leaves"), ["tree", "doc_id", "digest"], spread_ties=True)
    starts = numbered.groupBy("tree").agg(F.min("row_no").alias("start"), F.count(F.lit(1)).alias("n"))
    return _with_tree(numbered, starts, "row_no").select(
        "tree", (F.col("row_no") - F.col("start")).alias("place"), "n", "doc_id", "digest", "changed"
    )


RESULT = (
    "doc_id bigint, leaf string, subroot string, root string, "
    f"proof {_PATH}, folded_root string, verified boolean"
)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded_root, verified`` of every row of ``docs``.

    ``proof`` has the siblings from the leaf to the root; ``folded_root`` is the root of
    the version with the tampered leaf, or is recomputed from the leaf as it is.
    """
    blocks = written(_blocks(placed_leaves(docs), "doc_id", "changed"), "merkle-leaves")
    inner = paths(written(_tops(blocks), "merkle-tops")).withColumnRenamed("place", "block")
    subroots = inner.groupBy("tree").agg(F.first("top").alias("digest"))
    ranked = written(with_row_no(written(subroots, "subroots"), ["tree"], "place"), "subroots")
    outer = paths(ranked.select(F.lit("").alias("tree"), "place", F.lit(ranked.count()).alias("n"), "digest"))
    outer = ranked.join(outer.select("place", "path", "top"), "place").select(
        "tree", F.col("digest").alias("subroot"), F.col("path").alias("last"), F.col("top").alias("root")
    )
    ways = _with_tree(inner.select("tree", "block", "path"), outer, "block")
    joined = blocks.join(ways, ["tree", "block"])
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(_STEP), pa.string(), pa.bool_()]
    height = BLOCK_LEVELS
    names = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, held, path, subroot, last, root in zip(*(column.to_pylist() for column in batch.columns)):
                above = path + last
                ways = [(step["at"], step["others"]) for step in above]
                tree = PersistentTree([node["digest"] for node in held], _levels(n, height))
                tops = {}  # a version's top below the block's way, and the root that it comes to
                rows = []
                for at, node in enumerate(held):
                    own = tree.path(at)
                    if node["changed"] is None:
                        top = fold(node["digest"], own)
                    else:
                        top = tree.digest[tree.version(at, node["changed"])]
                    folded = tops[top] = tops.get(top) or fold(top, ways)
                    proof = _steps(own) + above
                    rows.append((node["doc_id"], node["digest"], subroot, root, proof, folded, folded == root))
                for low in range(0, len(rows), 512):
                    columns = zip(*rows[low : low + 512])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return joined.select("n", "nodes", "path", "subroot", "last", "root").mapInArrow(run, RESULT)


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings on a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda step: step["others"])), ""), 256)
