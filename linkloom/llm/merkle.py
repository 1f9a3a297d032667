"""Merkle dataset manifest: trees of SHA-256 digests whose parents keep hash midstates.

Every document is a leaf, the digest of its five columns.  Per language the
leaves ascend by doc_id and every eight consecutive nodes (fewer in the last
run) get a parent until one is left, the subroot; the subroots give the root in
the same way.

A parent is hashed child by child, and the hash state before each child's slot
is copied and kept.  To fold a changed leaf into the root, the state kept before its
slot takes up the replacement and the siblings to the right only; what stands
to the left is never hashed again.  The same states, one per level, serve all
leaves below a node.

How it is spread: leaves are range-sorted by (lang, doc_id) and numbered within
their language; ``8 ** TIER_LEVELS`` consecutive nodes are one block, whose
whole subtree is hashed in one task from 32-byte digests.  The roots of the
blocks are the nodes of the next tier, so a language of n documents takes
log_4096(n) tiers, however large its share of all rows.  Paths (siblings level
by level) then come down tier by tier: a block meets its root's path as
one more row, and its task folds its own leaves with states of its subtree and of the path.
Texts are read once, and only digests are shuffled.

Cases: a null in any column is hashed as ``-``; a null doc_id comes first
and is never tampered with; an empty text is ``0:``; rows of one doc_id are
ordered by their leaf, and equal rows are leaves of their own with
equal digests; a language of one document has its leaf as subroot, and a single
language's subroot is the root; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.runs import run_starts, whole_runs
from linkloom.operators.common import sized_broadcast
from linkloom.operators.graph import dense_index
from linkloom.session import materialize

FANOUT = 8
#: Levels hashed by one task from one block of FANOUT ** TIER_LEVELS nodes.
TIER_LEVELS = 4
#: Columns of a leaf, in the order in which they are hashed.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = 64


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The 32-byte digest of a document with this text."""
    fields = [_field(text if c == "text" else F.col(c)) for c in LEAF_COLUMNS]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def tampered_digest() -> Column:
    """The leaf's digest where the checked tampering changes the row (null elsewhere): text's A-Z in lower case."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(hit, leaf_digest(F.translate("text", _UPPER, _LOWER)))


# -- a block's subtree, in one task ---------------------------------------------------

def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Subtree:
    """Levels above a block's nodes, with the hash state kept before each child's slot."""

    def __init__(self, digests: list[str], levels: int):
        self.levels = [digests]
        self.states: list[list] = []
        self.runs: list[list[str]] = []
        for _ in range(levels):
            below = self.levels[-1]
            states, runs, parents = [], [], []
            for at in range(0, len(below), FANOUT):
                children = below[at:at + FANOUT]
                h = hashlib.sha256()
                for child in children:
                    states.append(h.copy())
                    h.update(child.encode())
                runs.append("".join(children))
                parents.append(h.hexdigest())
            self.states.append(states)
            self.runs.append(runs)
            self.levels.append(parents)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[tuple[str, str]]:
        """(left, right) siblings of node ``i`` and of its ancestors, as hex text."""
        out = []
        for runs in self.runs:
            up, slot = divmod(i, FANOUT)
            out.append((runs[up][:_HEX * slot], runs[up][_HEX * (slot + 1):]))
            i = up
        return out

    def fold(self, i: int, digest: str) -> tuple[str, list[str]]:
        """The block's root with ``digest`` in place of node ``i``, and the siblings on the way."""
        beside = []
        for states, runs in zip(self.states, self.runs, strict=True):
            up, slot = divmod(i, FANOUT)
            right = runs[up][_HEX * (slot + 1):]
            h = states[i].copy()
            h.update((digest + right).encode())
            beside.append(runs[up][:_HEX * slot] + right)
            digest, i = h.hexdigest(), up
        return digest, beside


class Path:
    """The levels above a block: per level the state before its slot and the siblings."""

    def __init__(self, packed: bytes):
        self.levels, at = [], 0
        while at < len(packed):
            left, right = (32 * n for n in packed[at:at + 2])
            before, after = packed[at + 2:at + 2 + left].hex(), packed[at + 2 + left:at + 2 + left + right].hex()
            at += 2 + left + right
            self.levels.append((hashlib.sha256(before.encode()), after, before + after))

    @staticmethod
    def pack(levels: list[tuple[str, str]]) -> bytes:
        return b"".join(bytes((len(a) // _HEX, len(b) // _HEX)) + bytes.fromhex(a + b) for a, b in levels)

    def fold(self, digest: str, proof) -> str:
        for state, after, beside in self.levels:
            h = state.copy()
            h.update((digest + after).encode())
            proof.update(beside.encode())
            digest = h.hexdigest()
        return digest


def _hex(rows: pa.Table, name: str, a: int, b: int) -> list[str | None]:
    return [x if x is None else x.hex() for x in rows.column(name).slice(a, b - a).to_pylist()]


def _blocks(rows: pa.Table, tier_levels: int, lead: int = 0) -> Iterator[tuple[int, int, Subtree]]:
    """(first row, end, subtree) of each block; ``lead`` rows of its own stand before its nodes."""
    tree, block, n = (rows.column(i).to_numpy() for i in range(3))
    starts = run_starts(tree, block).tolist()
    for a, b in zip(starts, [*starts[1:], len(n)], strict=True):
        yield a, b, Subtree(_hex(rows, "digest", a + lead, b), min(tier_levels, height(int(n[b - 1]))))


def _roots(batches, tier_levels):
    """One row per block: the node of the next tier."""
    for rows in whole_runs(batches, 2):
        out = []
        for a, _, sub in _blocks(rows, tier_levels):
            tree, block, n = (rows.column(i)[a].as_py() for i in range(3))
            for _ in sub.states:
                n = -(-n // FANOUT)
            out.append((tree, block, n, bytes.fromhex(sub.root)))
        yield _rows_of(out, _NODE)


def _paths(batches, tier_levels):
    """The path of every node: its siblings in the block, then its block's path."""
    for rows in whole_runs(batches, 2, 1 << 13):
        out = []
        for a, b, sub in _blocks(rows, tier_levels, 1):
            tree, top, above = (rows.column(c)[a].as_py() for c in ("tree", "subroot", "path"))
            places = rows.column("pos").slice(a + 1, b - a - 1).to_pylist()
            out += [(tree, pos, top, Path.pack(sub.siblings(i)) + above) for i, pos in enumerate(places)]
        yield _rows_of(out, _PATH)


def _folds(batches, tier_levels):
    """The manifest's rows of every leaf."""
    for rows in whole_runs(batches, 2):
        subroots, proofs, folded, keep = [], [], [], np.ones(rows.num_rows, dtype=bool)
        for a, b, sub in _blocks(rows, tier_levels, 1):
            keep[a] = False
            path, top = Path(rows.column("path")[a].as_py()), rows.column("subroot")[a].as_py()
            for i, (old, new) in enumerate(zip(sub.levels[0], _hex(rows, "changed", a + 1, b), strict=True)):
                digest, beside = sub.fold(i, new or old)
                proof = hashlib.sha256("".join(beside).encode())
                folded.append(path.fold(digest, proof))
                proofs.append(proof.hexdigest())
                subroots.append(top)
        table = rows.select(["doc_id", "lang", "digest", "changed"]).filter(pa.array(keep))
        for name, column, kind in (("subroot", subroots, pa.binary()), ("proof_sha256", proofs, pa.string()), ("folded_root", folded, pa.string())):
            table = table.append_column(name, pa.array(column, kind))
        yield from table.to_batches()


_NODE = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
_PATH = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("subroot", pa.binary()), ("path", pa.binary())])


def _rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _with_block(nodes: DataFrame, tier_levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", tier_levels * (FANOUT.bit_length() - 1)))


def _in_blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """(tree, block, n, digest, pos, ...): each block in one partition, in order."""
    return nodes.select("tree", "block", "n", "digest", "pos", *more).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


# -- tiers ------------------------------------------------------------------------------

def tiers(nodes: DataFrame, name: str, tier_levels: int = TIER_LEVELS) -> list[DataFrame]:
    """(tree, pos, n, digest) of the nodes, of the blocks' roots above them, and so on to one node a tree."""
    out = [nodes]
    while out[-1].filter("n > 1").limit(1).count():
        blocks = _in_blocks(_with_block(out[-1].filter("n > 1"), tier_levels)).mapInArrow(lambda b: _roots(b, tier_levels), "tree bigint, pos bigint, n bigint, digest binary")
        out.append(materialize(blocks.unionByName(out[-1].filter("n = 1").select("tree", "pos", "n", "digest")), f"merkle-{name}"))
    return out


def _with_path(nodes: DataFrame, above: DataFrame, tier_levels: int, *more: str) -> DataFrame:
    """Blocks of a tier; the first row of each is no node but brings the path and subroot of the block's root."""
    up = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), "subroot", "path")
    both = _with_block(nodes, tier_levels).unionByName(up, allowMissingColumns=True).withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return _in_blocks(both, "subroot", "path", *more)


def node_paths(nodes: DataFrame, above: DataFrame, tier_levels: int) -> DataFrame:
    """(tree, pos, subroot, path) of a tier's nodes."""
    return _with_path(nodes, above, tier_levels).mapInArrow(lambda b: _paths(b, tier_levels), "tree bigint, pos bigint, subroot binary, path binary")


def paths_down(levels: list[DataFrame], top: DataFrame, name: str, tier_levels: int = TIER_LEVELS) -> DataFrame:
    """Paths of the nodes of the second tier (of the first if it is the only one) from those of the last."""
    path = top
    for nodes in reversed(levels[1:-1]):
        path = materialize(node_paths(nodes, path, tier_levels), f"merkle-{name}-paths")
    return path


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, digest, changed, tree, pos, n): leaves numbered within their language; trees ascend by lang."""
    hashed = docs.select("lang", "doc_id", leaf_digest(F.col("text")).alias("digest"), tampered_digest().alias("changed"), F.monotonically_increasing_id().alias("row"))
    order = ("lang", "doc_id", "digest", "row")
    ordered = hashed.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id())
    # places are read back from the written table, so they stay the same whatever is run again later
    ordered = materialize(ordered, "merkle-leaves").withColumn("part", F.shiftright("at", 33))
    runs = ordered.groupBy("lang", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    whole = Window.partitionBy("lang")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", F.col("lang").alias("run_lang"), F.min("first").over(whole).alias("tree"), F.sum("rows").over(whole).alias("n"),
                       (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    rows = ordered.alias("o").join(sized_broadcast(runs).alias("r"), (F.col("o.part") == F.col("r.part")) & F.col("lang").eqNullSafe(F.col("run_lang")))
    return rows.select("lang", "doc_id", "digest", "changed", "tree", (F.col("at") + F.col("shift")).alias("pos"), "n")


def manifest(docs: DataFrame, tier_levels: int = TIER_LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang, tampered."""
    leaf = leaves(docs)
    trees = tiers(leaf, "tree", tier_levels)
    subroots = trees[-1].select(F.col("tree").alias("of"), "digest")
    numbered = materialize(dense_index(subroots, "of", "pos").select(F.lit(0).cast("bigint").alias("tree"), "pos", "digest", "of"), "merkle-subroots")
    n_trees = numbered.count()
    of_trees = tiers(numbered.withColumn("n", F.lit(n_trees).cast("bigint")).select("tree", "pos", "n", "digest"), "root", tier_levels)
    root = of_trees[-1].first()
    root = root["digest"].hex() if root else ""
    top = of_trees[-1].select("tree", "pos", F.lit(None).cast("binary").alias("subroot"), F.lit(b"").alias("path"))
    if len(of_trees) > 1:
        top = node_paths(of_trees[0], paths_down(of_trees, top, "root", tier_levels), tier_levels)
    top = top.join(numbered.select("pos", "of", F.col("digest").alias("own")), "pos")
    top = materialize(top.select(F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("pos"), F.col("own").alias("subroot"), "path"), "merkle-tops")
    path = paths_down(trees, top, "tree", tier_levels)
    kinds = dict(docs.dtypes)
    out = f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, digest binary, changed binary, subroot binary, proof_sha256 string, folded_root string"
    rows = _with_path(leaf, path, tier_levels, "doc_id", "lang", "changed").mapInArrow(lambda b: _folds(b, tier_levels), out)
    text = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), F.lit(root).alias("root"), "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.lit(root)).alias("verified"), "lang", F.col("changed").isNotNull().alias("tampered"))
