"""Merkle manifest of a dataset: a hash tree per source, one tree over the sources, and proofs.

Trees are built and taken apart by time-forward processing. Nodes are labelled by (last leaf below,
level), so that children come before their parents; a priority queue ordered by label delivers the digests
of children to their parent, and a reversed sweep from the root down delivers to each leaf what its
proof holds. Both sweeps read their nodes in order from a sorted, spilling Spark shuffle, which is the
queue's external part; what a sweep keeps in memory are the few messages under way, at most ``ARITY``
a level.

A tree of any size is cut into blocks of ``ARITY ** LEVELS`` consecutive leaves. A block is swept by one
task and leaves one node, the blocks' nodes are the leaves of the next round, so that a few rounds end
in the root (four for 280 billion leaves). Leaves are numbered by range partitioning and offsets of the partitions,
never by a window over a source, hence a source may hold any share of the rows.

Null values count as ``-``; null sources form a tree of their own, the first; null ids come first in
their tree and are never tampered with. Equal ids are ordered by their leaf digest, and equal rows are
alike. A lone leaf is its own subroot, and the only subroot the root, with an empty proof. Long texts are
hashed whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from hitlens.operators.grouping import attach
from hitlens.session import shared_folder

ARITY, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows of one output batch of a sweep; a label after that of every node.
_ROWS, _ABOVE = 20_000, 1 << 62


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """sha256 over the columns, each as length in bytes, colon and value, or ``-`` for null."""
    def written(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(written, columns)).cast("binary"), 256)


def without_line_feeds(text: Column, key: Column) -> Column:
    """The text as tampered with: without line feeds where 2 divides the key's checksum."""
    chosen = F.crc32(key.cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def climb(digests: Iterator[tuple[int, str]], last: int, levels: int,
          tell: Callable[[int, int, int, list[str]], None]) -> str:
    """Forward sweep over the (number, digest) of one block's leaves, ending with leaf ``last``.

    ``tell(first leaf, last leaf, level, child digests)`` is called for each inner node, children first.
    Returns the digest of the node at ``levels``.
    """
    queue: list[tuple[tuple[int, int], int, str]] = []  # label of the parent, first leaf, digest

    def send(leaf: int, level: int, value: str) -> None:
        width = ARITY ** (level + 1)
        heapq.heappush(queue, ((min(leaf // width * width + width - 1, last), level + 1), leaf, value))

    value = ""
    for leaf, value in digests:
        if levels:
            send(leaf, 0, value)
        while queue and queue[0][0][0] == leaf:
            label, first, value = heapq.heappop(queue)
            children = [value]
            while queue and queue[0][0] == label:
                children.append(heapq.heappop(queue)[2])
            value = digest("".join(children))
            tell(first, leaf, label[1], children)
            if label[1] < levels:
                send(first, label[1], value)
    return value


class Descent:
    """Reversed sweep over the nodes of one block, greatest label first.

    A proof is a linked list (left siblings, right siblings, rest of the proof), so that all nodes
    below share its rest. ``above`` is the proof of the block's node.
    """

    def __init__(self, above: tuple | None):
        self.above, self.queue, self.sent = above, [], 0

    def proof(self, first: int, last: int, level: int, children: list[str] | None) -> tuple | None:
        """Proof of the next node; its children's are sent to them."""
        own = heapq.heappop(self.queue)[2] if self.sent else self.above
        width = ARITY ** max(level - 1, 0)
        for place in range(len(children or ())):
            self.sent += 1  # also keeps ties from comparing proofs
            end = min(first + (place + 1) * width - 1, last)
            heapq.heappush(self.queue, ((-end, 1 - level), self.sent, (
                "".join(children[:place]), "".join(children[place + 1:]), own)))
        return own


def _path(proof: tuple | None) -> list[tuple[str, str]]:
    out = []
    while proof is not None:
        out.append(proof[:2])
        proof = proof[2]
    return out


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _height(leaves: int, levels: int) -> int:
    """Levels that a block climbs in a tree of so many leaves: to its root, ``levels`` at most."""
    height = 0
    while leaves > 1 and height < levels:
        leaves, height = -(-leaves // ARITY), height + 1
    return height


_STEPS = "array<struct<left:string,right:string>>"
_STEP_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _with_steps(leaves: pa.RecordBatch, paths: list) -> pa.RecordBatch:
    steps = [[{"left": a, "right": b} for a, b in path] for path in paths]
    return pa.RecordBatch.from_arrays([leaves.column("tree"), leaves.column("last"), pa.array(steps, _STEP_TYPE)],
                                      names=["tree", "at", "steps"])


class Forest:
    """Hash trees over leaves (tree, at, of, digest, own): number of the tree, of the leaf in it, leaves
    of the tree, digest, and a struct that proofs carry along.

    ``roots``: (tree, root). ``folder`` takes the nodes of each round.
    """

    def __init__(self, leaves: DataFrame, folder: str, *, levels: int = LEVELS):
        self.spark, self.folder, self.levels = leaves.sparkSession, folder, levels
        self.rounds: list[tuple[DataFrame, DataFrame]] = []  # leaves and nodes of each
        self.ended: list[DataFrame] = []
        while True:
            nodes = self._written(self._swept(leaves), f"nodes{len(self.rounds)}")
            self.rounds.append((leaves, nodes))
            tops = nodes.where("top is not null")
            span = ARITY ** (levels * len(self.rounds))
            self.ended.append(tops.where(F.col("of") <= span).select("tree", F.col("top").alias("root")))
            leaves = tops.where(F.col("of") > span).select(
                "tree", F.col("block").alias("at"), "of", F.col("top").alias("digest"),
                F.lit(None).cast("struct<none:int>").alias("own"))
            if leaves.isEmpty():
                break
        self.roots = reduce(DataFrame.unionByName, self.ended)

    def _written(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def _swept(self, leaves: DataFrame) -> DataFrame:
        """Inner nodes (tree, block, of, first, last, level, children), and a row with the digest
        ``top`` for each block."""
        levels = self.levels
        size, shrunk = ARITY ** levels, ARITY ** (levels * len(self.rounds))
        names = ("tree", "block", "of", "first", "last", "level", "children", "top")
        types = (*[pa.int64()] * 6, pa.list_(pa.string()), pa.string())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            leaves_of = (row for batch in batches
                         for row in zip(*[c.to_pylist() for c in batch.columns]))
            for (tree, block), rows in groupby(leaves_of, key=lambda row: row[:2]):
                first = next(rows)
                here = -(-first[3] // shrunk)
                top = climb(((row[2], row[4]) for row in chain([first], rows)),
                            min((block + 1) * size, here) - 1, _height(here, levels),
                            lambda *node: out.append((tree, block, first[3], *node, None)))
                out.append((tree, block, first[3], None, None, None, None, top))
                if len(out) >= _ROWS:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        return (leaves.withColumn("block", F.floor(F.col("at") / size)).select(
            "tree", "block", "at", "of", "digest").repartition("tree", "block")
            .sortWithinPartitions("tree", "block", "at").mapInArrow(
                run, "tree long, block long, of long, first long, last long, level long, "
                     "children array<string>, top string"))

    def proofs(self, finish=_with_steps, schema: str | T.StructType = f"tree long, at long, steps {_STEPS}", *,
               upper: DataFrame | None = None) -> DataFrame:
        """Leaves with the siblings left and right of their paths, from their level up.

        ``upper`` (tree, steps) prolongs the paths of a tree beyond its root. ``finish(leaves, paths)``
        makes the rows of ``schema`` from a batch with ``tree``, ``last`` (the leaf's number) and ``own``.
        """
        above = None
        for number in range(len(self.rounds) - 1, -1, -1):
            if upper is not None:
                begun = upper.join(self.ended[number].select("tree"), "tree").select(
                    "tree", F.lit(0).cast("long").alias("at"), "steps")
                above = begun if above is None else above.unionByName(begun)
            if number == 0:
                return self._proved(0, above, finish, schema)
            above = self._written(self._proved(
                number, above, _with_steps, f"tree long, at long, steps {_STEPS}"), f"proofs{number}")

    def _proved(self, number: int, above: DataFrame | None, finish, schema) -> DataFrame:
        leaves, nodes = self.rounds[number]
        own = leaves.schema["own"].dataType
        none = {"first": "long", "children": "array<string>", "above": _STEPS, "own": own}

        def completed(rows: DataFrame, level: Column | str, last: Column | str) -> DataFrame:
            rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in none.items() if n not in rows.columns})
            return rows.select("tree", "block", F.lit(last).cast("long").alias("last") if isinstance(
                last, int) else F.col(last).alias("last"), F.col(level).alias("level") if isinstance(
                level, str) else F.lit(level).cast("long").alias("level"), "first", "children", "above", "own")

        block = F.floor(F.col("at") / ARITY ** self.levels)
        rows = completed(nodes.where("top is null").drop("top"), "level", "last").unionByName(completed(
            leaves.withColumns({"block": block, "first": F.col("at")}), 0, "at"))
        if above is not None:  # the proof of a block's node comes before all its nodes
            rows = rows.unionByName(completed(above.withColumnsRenamed(
                {"at": "block", "steps": "above"}), -1, _ABOVE))
        rows = rows.repartition("tree", "block").sortWithinPartitions(
            "tree", "block", F.desc("last"), F.desc("level"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, descent = None, None
            for batch in batches:
                kept, paths = [], []
                columns = [batch.column(n).to_pylist() for n in (
                    "tree", "block", "first", "last", "level", "children", "above")]
                for i, (tree, block, first, last, level, children, suffix) in enumerate(zip(*columns)):
                    if at != (tree, block):
                        at, proof = (tree, block), None
                        for step in reversed(suffix or []):
                            proof = (step["left"], step["right"], proof)
                        descent = Descent(proof)
                        if level < 0:
                            continue
                    proof = descent.proof(first, last, level, children)
                    if level == 0:
                        kept.append(i)
                        paths.append(_path(proof))
                if kept:
                    yield finish(batch.take(pa.array(kept)), paths)

        return rows.mapInArrow(run, schema)


def numbered(rows: DataFrame, tree: str, order: Sequence[Column], folder: str) -> DataFrame:
    """Add ``at`` and ``of``: the place of a row in its tree by ``order``, and the rows of the tree.

    Rows are range-partitioned by tree and order and written, which fixes them; a place is the offset of
    the row's part of its tree plus the place inside that part.
    """
    spark = rows.sparkSession
    # equal rows are told apart by where they were read, so that any number of them can be cut
    read = rows.withColumn("_read", F.monotonically_increasing_id())
    keys = [F.col(tree), *order, F.col("_read")]
    placed = read.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read").withColumn(
        "_row", F.monotonically_increasing_id())
    placed.write.parquet(folder)
    written = spark.read.schema(placed.schema).parquet(folder).withColumn("_part", F.shiftright("_row", 33))
    parts = written.groupBy(tree, "_part").agg(F.min("_row").alias("_from"), F.count("*").alias("_n"))
    of_tree = Window.partitionBy(tree)
    parts = parts.withColumns({
        "_before": F.sum("_n").over(of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        "of": F.sum("_n").over(of_tree)})
    parts = parts.select(tree, "_part", "of", (F.coalesce("_before", F.lit(0)) - F.col("_from")).alias("_shift"))
    return attach(written, parts, [tree, "_part"]).withColumn(
        "at", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


class Manifest:
    """Leaves, subroots, root and proofs of a table of documents.

    ``leaves``: (source, tree, at, of, digest, own), where ``own`` holds the id and ``extra`` columns;
    ``sources``: (source, tree, sources, subroot); ``root``: one row, none for an empty table.
    """

    def __init__(self, df: DataFrame, folder: str, *, fields: Sequence[str] = FIELDS,
                 id_col: str = "doc_id", source_col: str = "source", levels: int = LEVELS,
                 extra: dict[str, Column] | None = None):
        extra = {n: c.alias(n) for n, c in (extra or {}).items()}
        rows = df.select(df[source_col].cast("string").alias("source"), F.struct(
            df[id_col].alias("id"), *extra.values()).alias("own"),
            leaf_digest([df[c] for c in fields]).alias("digest"))
        leaves = numbered(rows, "source", [F.col("own.id"), F.col("digest")], f"{folder}/leaves")
        # sources are trees numbered in their own order
        named = numbered(leaves.where("at = 0").select(F.lit(0).cast("long").alias("all"), "source"),
                         "all", [F.col("source")], f"{folder}/sources").select(
            "source", F.col("at").alias("tree"), F.col("of").alias("sources"))
        self.leaves = attach(leaves, named.select("source", "tree"), ["source"])
        self.forest = Forest(self.leaves, f"{folder}/trees", levels=levels)
        self.sources = named.join(self.forest.roots, "tree").withColumnRenamed("root", "subroot")
        self.top = Forest(self.sources.select(
            F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("sources").alias("of"),
            F.col("subroot").alias("digest"), F.struct("source").alias("own")), f"{folder}/top",
            levels=levels)
        self.root = self.top.roots.select("root")

    def proofs(self, finish=_with_steps, schema: str | T.StructType = f"tree long, at long, steps {_STEPS}"):
        """Paths of all leaves to the root, see ``Forest.proofs``."""
        upper = self.top.proofs().select(F.col("at").alias("tree"), "steps")
        return self.forest.proofs(finish, schema, upper=upper)


def tampered_proofs(df: DataFrame, *, id_col: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """Documents -> (id_col, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``folded_root`` is what the leaf of the text as tampered with (``without_line_feeds``) and the
    original siblings give, ``verified`` whether it is the root.
    """
    folder = f"{shared_folder(df.sparkSession)}/manifest-{uuid.uuid4().hex}"
    leaf = leaf_digest([df[c] for c in FIELDS])
    tampered = leaf_digest([without_line_feeds(df[c], df[id_col]) if c == "text" else df[c] for c in FIELDS])
    manifest = Manifest(df, folder, id_col=id_col, levels=levels, extra={"leaf": leaf, "tampered": tampered})
    id_field = T.StructField("id", df.schema[id_col].dataType)
    schema = T.StructType([id_field] + T._parse_datatype_string(
        "tree long, leaf string, proof_sha256 string, folded_root string").fields)

    def finish(leaves: pa.RecordBatch, paths: list) -> pa.RecordBatch:
        own = leaves.column("own")
        proofs = [digest("".join([left + right for left, right in path])) for path in paths]
        folded = [fold(leaf, path) for leaf, path in zip(own.field("tampered").to_pylist(), paths)]
        return pa.RecordBatch.from_arrays(
            [own.field("id"), leaves.column("tree"), own.field("leaf"), pa.array(proofs, pa.string()),
             pa.array(folded, pa.string())], names=schema.names)

    rows = attach(manifest.proofs(finish, schema), manifest.sources.select("tree", "subroot"), ["tree"])
    return attach(rows, manifest.root).select(
        F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    values = [f"cast({text if c == 'text' else c} as varchar)" for c in FIELDS]
    return "sha256(" + " || ".join(
        f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


# Trees, paths and folding as recursive queries; the checksum of decimal digits bit by bit.
ORACLE = f"""
with recursive
d as (select *, row_number() over () r, coalesce(cast(doc_id as varchar), '') k from documents),
e as (select r, list_reduce([4294967295::bigint] || list_transform(string_split(k, ''), lambda c: ord(c)::bigint),
  lambda x, c: list_reduce([xor(x, c)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0],
    lambda y, _: xor(y >> 1, (y & 1) * 3988292384))) crc from d),
t as (select d.*, case when doc_id is not null and xor(crc, 4294967295) % 2 = 0
  then replace(text, chr(10), '') else text end changed from d join e using (r)),
l as (select r, doc_id, source,
  {_sql_leaf('text')} leaf,
  {_sql_leaf('changed')} tampered from t),
n as (select *, row_number() over (partition by source order by doc_id nulls first, leaf, r) - 1 pos,
  dense_rank() over (order by source nulls first) tree from l),
up(tree, level, pos, node) as (
  select tree, 0, pos, leaf from n
  union all
  select tree, level + 1, pos // 3, sha256(string_agg(node, '' order by pos)) from (
    select *, count(*) over (partition by tree) c from up) where c > 1 group by tree, level, pos // 3),
sub as (select tree, arg_max(node, level) subroot from up group by tree),
upper(level, pos, node) as (
  select 0, row_number() over (order by tree) - 1, subroot from sub
  union all
  select level + 1, pos // 3, sha256(string_agg(node, '' order by pos)) from (
    select *, count(*) over () c from upper) where c > 1 group by level, pos // 3),
root as (select arg_max(node, level) root from upper),
height as (select tree, max(level) h from up group by tree),
steps as (
  select r, level, coalesce(string_agg(u.node, '' order by u.pos) filter (u.pos < n.pos // pow(3, level)::bigint), '') a,
    coalesce(string_agg(u.node, '' order by u.pos) filter (u.pos > n.pos // pow(3, level)::bigint), '') b
  from n join height using (tree) join up u using (tree)
  where level < h and u.pos // 3 = n.pos // pow(3, level + 1)::bigint group by r, level
  union all
  select r, h + level, coalesce(string_agg(u.node, '' order by u.pos) filter (u.pos < (tree - 1) // pow(3, level)::bigint), ''),
    coalesce(string_agg(u.node, '' order by u.pos) filter (u.pos > (tree - 1) // pow(3, level)::bigint), '')
  from n join height using (tree) join upper u on u.pos // 3 = (tree - 1) // pow(3, level + 1)::bigint
  where level < (select max(level) from upper) group by r, h, level, tree),
fold(r, level, node) as (
  select r, 0, tampered from n
  union all
  select r, level + 1, sha256(a || node || b) from fold join steps using (r, level)),
folded as (select r, arg_max(node, level) folded_root from fold group by r),
proof as (select r, sha256(coalesce(string_agg(a || b, '' order by level), '')) proof_sha256
  from n left join steps using (r) group by r)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root verified
from n join sub using (tree) join folded using (r) join proof using (r), root"""
