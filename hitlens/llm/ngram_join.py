"""Similarity join of documents on word n-grams with a prefix tree, and its groups.

A document is the set of its distinct ``k``-word shingles. Shingles have one global order (common
ones last, otherwise by hash), and sets are compared as sorted sequences in a trie: sets with the
same beginning share a path, a set is matched against a whole path at once, and a subtree is
left when the shingles that remain cannot bring the overlap it needs any more.

Before that, sets that cannot be linked are kept apart, without losing a link:

* Two sets linked by the threshold share at least ``l`` shingles of their first
  ``n - ceil(t n) + l`` ones (``l`` grows to 8 with the size). So only shingles that two sets have
  in these prefixes matter, and only sets with at least ``l`` of them.
* Equal sets are one; the prefix of a set is handed on once per task.
* First each set joins the group of its most common prefix shingle; sets found linked there become
  one component. Then every group that still holds two components is joined; a pair is
  compared in the first of its groups only.
* In both rounds parity maps travel first, a bit or two per shingle: maps differ in no more places than
  their sets do, so a set goes on to a group only if its map leaves a link with another one there possible.
* Large groups are cut into blocks of bounded numbers of sets and bytes. In the first round each block
  meets one block of pivots; in the second all pairs of blocks meet.

No pair list leaves a task: a trie returns links that span what it has found connected, which is all
that components need. Shingles are 64-bit hashes. Null and empty texts, and those without words, have no
shingles and are linked with nothing; repeated rows are linked with each other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from hitlens.llm.batches import pieces
from hitlens.llm.words import shingles, words
from hitlens.operators.components import connected_components
from hitlens.operators.grouping import BROADCAST_BYTES, attach, measured_bytes
from hitlens.session import delete_folder, shared_folder

K, THRESHOLD = 4, (85, 100)
# Common shingles that come last in the order: it changes the work, never the result.
COMMON = 1 << 16
# Sets, or their parity maps, per block of a large group, and bytes of them.
BLOCK, LIKELY_BLOCK, BLOCK_BYTES = 500, 4000, 32 << 20
# Shingles that a task counts at once, and how often one has to occur among them to be common.
_COUNTED, _OFTEN = 4_000_000, 4
# Sets whose prefix a task remembers to have handed on.
_REMEMBERED = 1_000_000


def least_overlap(a, b, threshold=THRESHOLD):
    """Least intersection of linked sets of sizes ``a`` and ``b``."""
    num, den = threshold
    return -(-num * (a + b) // (den + num))


def shared_prefix(n):
    """How many shingles two linked sets share at least in their prefixes, by size."""
    return np.clip(np.asarray(n) // 8, 1, 8)


def prefix_length(n: int, threshold=THRESHOLD) -> int:
    num, den = threshold
    return min(n, n - -(-num * n // den) + int(shared_prefix(n)))


def required(n: int, threshold=THRESHOLD) -> int:
    """How many shared prefix shingles a set of size ``n`` needs to be linked with any other."""
    num, den = threshold
    return int(shared_prefix(-(-num * n // den)))


class Order:
    """The global order: a common shingle becomes 2**62 plus its rank, another one its hash."""

    def __init__(self, common: np.ndarray):
        """``common``: shingles from the least to the most common."""
        self.sorted = np.sort(common)
        self.rank = np.argsort(common, kind="stable").astype(np.int64)

    def keys(self, shingle: np.ndarray) -> np.ndarray:
        """Sorted keys of a set of shingles."""
        out = (shingle >> np.uint64(2)).astype(np.int64)
        if len(self.sorted) and len(out):
            at = np.searchsorted(self.sorted, shingle)
            at[at == len(self.sorted)] = 0
            known = self.sorted[at] == shingle
            out[known] = (1 << 62) + self.rank[at[known]]
        out.sort()
        return out


def class_of(keys: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(keys.tobytes())).astype(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for piece in pieces(batch, "__text"):
            texts = [(t or "").encode() for t in piece.column("__text").to_pylist()]
            yield piece, shingles(*words(texts), k)


def _common(source: DataFrame, k: int, most: int, folder: str) -> np.ndarray:
    """Shingles that a few sets of some stretch of the input share, at most ``most`` of them, the
    most common last."""
    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(found), return_counts=True)
        often = n >= _OFTEN
        return pa.RecordBatch.from_arrays(
            [pa.array(value[often].view(np.int64)), pa.array(n[often].astype(np.int64))],
            names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for _, sets in _sets(batches, k):
            found += sets
            size += sum(map(len, sets))
            if size > _COUNTED:
                yield counted(found)
                found, size = [], 0
        if found:
            yield counted(found)

    path = f"{folder}/common"
    (source.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
     .write.parquet(path))
    counts = source.sparkSession.read.schema("shingle long, n long").parquet(path)
    size = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for row in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["size"]
    if least is None:
        return np.zeros(0, np.uint64)
    rows = counts.where(size >= least).toArrow()
    shingle, n = rows.column("shingle").to_numpy(), rows.column("n").to_numpy()
    return shingle[np.lexsort((shingle, n))].view(np.uint64)


class Trie:
    """Sorted sets by shared beginnings. A node covers the sets ``low`` to ``high``."""

    def __init__(self, sets: list[np.ndarray]):
        """``sets`` in lexicographic order."""
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.common = [self._shared(a, b) for a, b in zip(sets, sets[1:])]
        self.nodes: list[tuple] = []
        self.children: list[list[int]] = []
        todo = [(0, len(sets), 0, None)]
        while todo:
            low, high, depth, parent = todo.pop()
            end = min(self.common[low:high - 1], default=len(sets[low]))
            sizes = self.sizes[low:high]
            number = len(self.nodes)
            self.nodes.append((low, high, end, sets[low][depth:end], sizes.min(), sizes.max()))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(number)
            start = low
            if high - low > 1:
                cuts = [i + 1 for i in range(low, high - 1) if self.common[i] == end]
                for stop in [*cuts, high]:
                    todo.append((start, stop, end, number))
                    start = stop

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def matches(self, own: np.ndarray, wanted: np.ndarray, threshold) -> Iterator[int]:
        """Sets linked with ``own`` among those marked in ``wanted``, which may change meanwhile."""
        num, den = threshold
        n = len(own)
        if not n or not wanted.any():
            return
        smallest, largest = -(-num * n // den), den * n // num
        stack = [(0, 0)]
        while stack:
            number, overlap = stack.pop()
            low, high, depth, edge, least, most = self.nodes[number]
            if most < smallest or least > largest or not wanted[low:high].any():
                continue
            left = n
            if len(edge):
                at = np.searchsorted(own, edge)
                at[at == n] = 0
                overlap += int((own[at] == edge).sum())
                left = n - int(np.searchsorted(own, edge[-1], "right"))
            else:
                left = n if depth == 0 else n - int(
                    np.searchsorted(own, self.sets[low][depth - 1], "right"))
            possible = overlap + min(left, int(most) - depth)
            if possible < least_overlap(n, max(int(least), smallest), threshold):
                continue
            if self.children[number]:
                stack += [(child, overlap) for child in self.children[number]]
            else:
                for i in range(low, high):  # one set, as equal ones are one
                    if wanted[i] and overlap >= least_overlap(n, int(self.sizes[i]), threshold):
                        yield i


def trie_links(classes: np.ndarray, sets: list[np.ndarray], component: np.ndarray,
               allowed=None, threshold=THRESHOLD) -> list[tuple[int, int]]:
    """Links (least class, class) that join the components of a block as far as its sets are
    linked: a star over one class of each.

    ``allowed(i)`` marks the sets that ``i`` may be compared with here (default: all).
    """
    order = sorted(range(len(sets)), key=lambda i: (sets[i].astype(">i8").tobytes(), i))
    keep = [i for n, i in enumerate(order) if n == 0 or classes[i] != classes[order[n - 1]]]
    if len(keep) < 2:
        return []
    tree = Trie([sets[i] for i in keep])
    classes, before = classes[keep], component[keep]
    root = before.copy()
    for x in range(len(keep)):
        wanted = root != root[x]
        wanted[:x] = False
        if allowed is not None:
            wanted &= allowed(keep[x])[keep]
        for y in tree.matches(tree.sets[x], wanted, threshold):
            if root[x] != root[y]:
                root[root == root[y]] = root[x]
                wanted &= root != root[x]
    links = []
    for own in np.unique(root[root != before]):
        members = classes[root == own]
        least = int(members.min())
        # a star to one member of each component that was there before
        _, at = np.unique(before[root == own], return_index=True)
        links += [(least, int(m)) for m in members[at] if m != least]
    return links


def parity(shingle: np.ndarray) -> bytes:
    """A bit per place ``shingle % bits``: whether an odd number of the set's shingles fall there.

    ``bits`` is the least power of two not below the size, 64 at least. Two such maps differ in no more
    places than their sets differ in shingles.
    """
    bits = max(64, 1 << max(0, len(shingle) - 1).bit_length())
    at = (shingle & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def _narrowed(maps: list[bytes], words: int) -> np.ndarray:
    """Parity maps as rows of ``words`` 64-bit words; wider ones are folded, which keeps parities."""
    out = np.empty((len(maps), words), np.uint64)
    for i, own in enumerate(maps):
        row = np.frombuffer(own, np.uint64)
        out[i] = np.bitwise_xor.reduce(row.reshape(-1, words), axis=0)
    return out


def likely_sets(sizes: np.ndarray, maps: list[bytes], component: np.ndarray, allowed=None,
                threshold=THRESHOLD) -> np.ndarray:
    """Marks the sets that may be linked with one of another component, by sizes and parity maps.

    Linked sets of sizes n and m differ in at most ``n + m - 2 * least overlap`` shingles, so that pairs
    whose maps differ in more places are none.
    """
    num, den = threshold
    order = np.argsort(sizes, kind="stable")
    size, part = sizes[order], component[order]
    words = np.array([len(maps[i]) // 8 for i in order], np.int64)
    keep = np.zeros(len(order), bool)
    for width in np.unique(words):
        low, high = np.searchsorted(words, width), np.searchsorted(words, width, "right")
        stop = np.searchsorted(size, den * size[high - 1] // num, "right")
        rows = _narrowed([maps[i] for i in order[low:stop]], int(width))
        for i in range(low, high):
            end = int(np.searchsorted(size, den * size[i] // num, "right"))
            wanted = part[i + 1:end] != part[i]
            if keep[i]:
                wanted &= ~keep[i + 1:end]
            if allowed is not None and wanted.any():
                wanted &= allowed(order[i])[order[i + 1:end]]
            at = i + 1 + np.flatnonzero(wanted)
            if not len(at):
                continue
            differ = np.bitwise_count(rows[at - low] ^ rows[i - low]).sum(axis=1, dtype=np.int64)
            most = size[i] + size[at] - 2 * least_overlap(size[i], size[at], threshold)
            at = at[differ <= most]
            keep[at] = True
            keep[i] |= len(at) > 0
    out = np.zeros(len(order), bool)
    out[order] = keep
    return out


class _Block:
    """The rows of one task, and which pairs are to be compared here."""

    def __init__(self, table: pa.Table):
        self.classes = table.column("class").to_numpy()
        self.component = table.column("component").to_numpy()
        self.blocks = table.column("block").to_numpy()
        self.first, self.second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        self.home = table.column("home").to_numpy()
        # groups before this one that several of the sets are in: those meet in the first of them
        lists, self.shared = self.lists(table, "earlier"), None
        if table.column("later")[0].as_py():
            number = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
            value, at, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
            often = n > 1
            column = np.cumsum(often) - 1
            self.shared = np.zeros((len(lists), int(often.sum())), bool)
            mark = often[at]
            self.shared[number[mark], column[at[mark]]] = True

    @staticmethod
    def lists(table: pa.Table, name: str) -> list[np.ndarray]:
        return [np.asarray(s.values) for chunk in table.column(name).chunks for s in chunk]

    def allowed(self, i: int) -> np.ndarray:
        """Sets that ``i`` meets in this task: in the second round not those of its first
        round's group, and those of several common groups in the first one only."""
        if self.shared is None:
            return np.ones(len(self.classes), bool)
        ok = self.home != self.home[i]
        if self.first != self.second:
            ok &= self.blocks != self.blocks[i]
        own = np.flatnonzero(self.shared[i])
        if len(own):
            ok &= ~self.shared[:, own].any(axis=1)
        return ok


def _links_of(assigned: DataFrame, threshold) -> DataFrame:
    """Links found in each block of rows (group, block, first, second, class, keys, component,
    home, earlier, later)."""
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table)
        links = trie_links(block.classes, block.lists(table, "keys"), block.component, block.allowed,
                           threshold)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()),
                         "b": pa.array([x[1] for x in links], pa.int64())})

    return assigned.groupBy("group", "first", "second").applyInArrow(run, "a long, b long")


def _likely_of(assigned: DataFrame, threshold) -> DataFrame:
    """Of rows as above with ``marks`` and ``size`` for ``keys``: the (group, class, size) that may be
    linked with another one there."""
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table)
        keep = likely_sets(table.column("size").to_numpy(), table.column("marks").to_pylist(),
                           block.component, block.allowed, threshold)
        return table.select(["group", "class", "size"]).filter(pa.array(keep))

    return assigned.groupBy("group", "first", "second").applyInArrow(
        run, "group long, class long, size long")


def _blocks(members, total, most: int, unit: float):
    """Blocks that a group of so many sets and shingles is cut into, ``unit`` bytes a shingle."""
    return F.greatest(F.ceil(members / most), F.ceil(total * unit / BLOCK_BYTES)).cast("int")


def _meetings(rows: DataFrame, blocks, pivots: bool) -> DataFrame:
    """Rows in a block of their group and in each pair of blocks (first, second) that meet: all of
    them, or those with the first block (``pivots``)."""
    block = F.pmod(F.xxhash64("class"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    if pivots:
        meets = F.transform(F.when(block == 0, every).otherwise(F.array(block)), lambda j: F.struct(
            F.lit(0).alias("first"), j.alias("second")))
    else:
        meets = F.transform(every, lambda j: F.struct(
            F.least(block, j).alias("first"), F.greatest(block, j).alias("second")))
    return rows.select("class", "group", "component", "home", "size", "earlier", "later",
                       block.alias("block"), F.inline(meets))


def similarity_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                          k: int = K, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Documents -> (id_col, n_shingles, component_id): the smallest id reachable by links.

    Two sets are linked when ``den * |both| >= num * |either|`` for ``threshold = (num, den)``.
    Intermediate tables in the shared folder are deleted once read; the result stays there.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/ngrams-{uuid.uuid4().hex}"

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    def done_with(*names: str) -> None:
        for name in names:
            delete_folder(spark, f"{folder}/{name}")

    def beside(rows: DataFrame, small: DataFrame, on) -> DataFrame:
        """Inner join that broadcasts ``small`` up to a measured size."""
        few = measured_bytes(small) <= BROADCAST_BYTES
        return rows.join(F.broadcast(small) if few else small, on)

    source = df.select(df[id_col].alias("__id"), df[text_col].cast("string").alias("__text"))
    order = Order(_common(source, k, COMMON, folder))
    done_with("common")
    id_field = T.StructField("__id", df.schema[id_col].dataType)
    numbers = T.ArrayType(T.LongType())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for piece, sets in _sets(batches, k):
            size, group, need, prefix, marks = [], [], [], [], []
            for found in sets:
                n = len(found)
                keys = order.keys(found)
                own = class_of(keys) if n else None
                size.append(n), group.append(own), need.append(required(n) if n else None)
                new = n > 0 and own not in told
                prefix.append(keys[:prefix_length(n, threshold)] if new else None)
                marks.append(parity(found) if new else None)
                if new:
                    told = told if len(told) < _REMEMBERED else set()
                    told.add(own)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(size, pa.int64()),
                 pa.array(group, pa.int64()), pa.array(need, pa.int32()),
                 pa.array(prefix, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["__id", "__mark", "n", "class", "need", "prefix", "marks"])

    # a row is told from others by its id and a hash of its text, as ids may repeat or be null
    keyed = source.select("__id", F.xxhash64("__text").alias("__mark"), "__text")
    documents = written(keyed.mapInArrow(sketch, T.StructType([
        id_field, T.StructField("__mark", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("class", T.LongType()), T.StructField("need", T.IntegerType()),
        T.StructField("prefix", numbers), T.StructField("marks", T.BinaryType())])), "documents")

    # prefix shingles that several sets have, and sets that have enough of them
    by_shingle, by_class = Window.partitionBy("shingle"), Window.partitionBy("class")
    rows = (documents.where(F.col("prefix").isNotNull())
            .select(F.explode("prefix").alias("shingle"), "class", "need")
            .repartition("shingle").dropDuplicates(["shingle", "class"]))
    rows = rows.withColumn("n", F.count("*").over(by_shingle)).where("n > 1").drop("n")
    rows = rows.withColumn("n", F.count("*").over(by_class)).where("n >= need").drop("n")
    core = written(rows.withColumn("n", F.count("*").over(by_shingle)).where("n > 1")
                   .select("shingle", "class", "n"), "core")

    # of each class in the core: one document, size and parity map
    leads = written(documents.where("class is not null").join(
        core.select("class").distinct(), "class", "left_semi").groupBy("class").agg(
        F.min(F.struct("__id", "__mark")).alias("lead"), F.max("n").alias("size"),
        F.max("marks").alias("marks")), "leads")
    ids = written(documents.select("__id", "n", "class"), "ids")
    done_with("documents")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for piece, sets in _sets(batches, k):
            keys = [order.keys(found) for found in sets]
            own = piece.column("class").to_pylist()
            same = []
            for i, found in enumerate(keys):  # repeated rows are handed on once per task
                if len(found) and own[i] not in told and class_of(found) == own[i]:
                    told = told if len(told) < _REMEMBERED else set()
                    told.add(own[i])
                    same.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own[i] for i in same], pa.int64()),
                 pa.array([keys[i] for i in same], pa.list_(pa.int64()))], names=["class", "keys"])

    def links_in(members: DataFrame, name: str, pivots: bool) -> DataFrame:
        """Links of the groups (group, class, component, home, size, earlier, later, members, total).

        Parity maps tell most pairs apart, so that whole sets travel for the few others only.
        """
        members = written(members, f"members{name}")
        cut = _blocks(F.col("members"), F.col("total"), LIKELY_BLOCK, 0.25)
        likely = written(_likely_of(_meetings(members, cut, pivots).join(
            leads.select("class", "marks"), "class"), threshold).distinct(), f"likely{name}")
        wanted = likely.select("class").distinct().join(leads, "class").select(
            "class", F.col("lead.__id").alias("_id"), F.col("lead.__mark").alias("_mark"))
        chosen = beside(keyed, wanted, F.col("__id").eqNullSafe(F.col("_id"))
                        & (F.col("__mark") == F.col("_mark"))).select("class", "__text")
        sets = written(chosen.mapInArrow(whole, "class long, keys array<long>"), f"sets{name}")
        stats = likely.groupBy("group").agg(F.count("*").alias("members"), F.sum("size").alias("total"))
        rest = attach(members.drop("members", "total").join(
            likely.select("group", "class"), ["group", "class"]), stats, ["group"])
        places = written(_meetings(rest, _blocks(F.col("members"), F.col("total"), BLOCK, 8), pivots),
                         f"places{name}")
        links = written(_links_of(beside(sets, places, "class"), threshold), f"links{name}")
        done_with(*[f"{part}{name}" for part in ("members", "likely", "sets", "places")])
        return links

    # first round: every set in its most common group, blocks against pivots
    home = written(core.groupBy("class").agg(F.max_by("shingle", F.struct("n", "shingle")).alias("group")).join(
        leads.select("class", "size"), "class"), "home")
    home = attach(home, home.groupBy("group").agg(
        F.count("*").alias("members"), F.sum("size").alias("total")), ["group"])
    none = F.array().cast(numbers)
    links = links_in(home.select(
        "group", "class", F.col("class").alias("component"), F.col("class").alias("home"), "size",
        none.alias("earlier"), F.lit(False).alias("later"), "members", "total"), "1", True)

    # second round: the groups that still hold several components, all blocks against all; the
    # least class a set was linked with in the first round names its component
    label = links.groupBy(F.col("b").alias("class")).agg(F.min("a").alias("component"))
    # all pairs of a group that is one block have been compared; else a set stands for itself
    done = home.join(label, "class", "left").select("class", "size", F.when(
        _blocks(F.col("members"), F.col("total"), BLOCK, 8) == 1, F.col("group")).otherwise(
        F.col("class")).alias("home"), F.coalesce("component", "class").alias("component"))
    labelled = written(core.select("shingle", "class").join(done, "class"), "labelled")
    groups = labelled.groupBy("shingle").agg(
        F.count("*").alias("members"), F.sum("size").alias("total"),
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.min("home").alias("home1"), F.max("home").alias("home2"),
        F.bit_xor(F.xxhash64("class")).alias("mark"),
        F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("mark2")).where(
        "low < high and home1 < home2")
    # groups of the same sets are one
    groups = groups.groupBy("members", "total", "mark", "mark2").agg(F.min("shingle").alias("group"))
    placed = written(labelled.join(groups.select("group", "members", "total"),
                                   F.col("shingle") == F.col("group")).drop("shingle"), "placed")
    lists = placed.groupBy("class").agg(F.sort_array(F.collect_list("group")).alias("lists"))
    second = placed.join(lists, "class").withColumn(
        "earlier", F.filter("lists", lambda g: g < F.col("group"))).withColumn("later", F.lit(True))
    more = links_in(second.select("group", "class", "component", "home", "size", "earlier", "later",
                                  "members", "total"), "2", False)
    done_with("core", "leads", "home", "labelled", "placed")
    found = connected_components(links.unionByName(more))

    # the smallest id of each component
    least = ids.where("class is not null").groupBy("class").agg(F.min("__id").alias("least"))
    least = least.join(found.withColumnsRenamed({"node": "class"}), "class", "left").withColumn(
        "root", F.coalesce("component", "class"))
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    names = written(least.select("class", "root").join(smallest, "root").select(
        F.col("class").alias("_class"), "component_id"), "names")
    result = written(ids.join(names, F.col("class") == F.col("_class"), "left").select(
        F.col("__id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("__id")).otherwise(F.col("component_id"))
        .alias("component_id")), "result")
    done_with("links1", "links2", "ids", "names")
    return result
