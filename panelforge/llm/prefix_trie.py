"""Tries of conversation prefixes by adaptive radix trees.

A turn's id is a big-endian number of 16 bytes, so a conversation is a byte string, and two conversations share their first d
turns just if they share their first 16 d bytes. The strings are sorted by ranges over all conversations. Each task puts
blocks of its range into radix trees; only byte depths that are whole turns become nodes of the trie, wherever on a compressed
path they lie. A node that neither the first nor the last string of its block goes through lies in one block alone and is
finished there. The others, two paths a block, are summed up over the blocks by joins and windows, so that neither a common
first turn nor a thousand copies of one conversation meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm import radix_tree
from panelforge.llm.common import Scratch

#: Bytes of a turn's id.
WIDTH = 16
#: A block ends when it has so many conversations or bytes.
BLOCK_ROWS, BLOCK_BYTES = 20_000, 32_000_000
TURNS = "array<struct<id:string,size:bigint>>"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _said(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, id, role, text) of rows, without nulls in role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    return rows.select("conv_id", "turn", name.alias("id"), role.alias("role"), text.alias("text"))


def turn_lists(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) for each conv_id of rows (conv_id, turn, role, text): the ids (hex) of its turns and the UTF-8 bytes of their texts, in order.

    Turns go by turn, null first, equal ones by id. Null roles and texts are empty; repeated rows are turns of their own; a null
    conv_id is one conversation. Texts are read and left: a turn takes some 50 bytes from here on. A conversation's
    turns are one row, which bounds it to some ten million. Further columns aren't read; an empty table gives an empty one.
    """
    slim = _said(rows).select("conv_id", "turn", "id", F.octet_length("text").cast("long").alias("size"))
    listed = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("_turns"))
    return listed.select("conv_id", F.transform("_turns", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("turns"))


class _Block:
    """The trie of one block of sorted conversations; some of its nodes stay open until the other blocks are known."""

    def __init__(self, number: int, convs: list, keys: list[bytes], sizes: list[list[int]]):
        self.number, self.convs, self.keys, self.sizes = number, convs, keys, sizes

    def _order(self, conv: object) -> tuple:
        return (conv is None, conv)

    def _paths(self) -> tuple[list[bytes], list[bytes]]:
        """The names of the prefixes of the first and of the last key, by depth."""
        out = []
        for key in (self.keys[0], self.keys[-1]):
            running, names = sha256(), [sha256().digest()]
            for at in range(0, len(key), WIDTH):
                running.update(key[at : at + WIDTH])
                names.append(running.digest())
            out.append(names)
        return out[0], out[1]

    def rows(self) -> Iterator[dict]:
        last = len(self.keys) - 1
        first_names, last_names = self._paths()
        # parents come before their children
        nodes, parents = [radix_tree.build(self.keys)], [-1]
        for i, node in enumerate(nodes):
            for kid in node.kids:
                nodes.append(kid)
                parents.append(i)
        size = len(nodes)
        least, lows, highs = [None] * size, [0] * size, [0] * size
        n, leaves, saved, tops = [0] * size, [0] * size, [0] * size, [0] * size
        for i, node in enumerate(nodes):
            n[i] = len(node.ends)
            own = min((self.convs[x] for x in node.ends), key=self._order) if node.ends else None
            least[i] = (own,) if node.ends else None
            lows[i], highs[i] = (min(node.ends), max(node.ends)) if node.ends else (last + 1, -1)
        spans = [(0, 0)] + [(nodes[parents[i]].upto // WIDTH + 1, nodes[i].upto // WIDTH) for i in range(1, size)]
        below = [0] * size  # trie nodes right below the node's deepest whole turn
        for i in range(size - 1, -1, -1):
            if not leaves[i]:
                leaves[i] = 1
            low, high = spans[i]
            below[i] = tops[i]
            saved[i] += (n[i] - 1) * sum(self.sizes[nodes[i].row][low - 1 : high]) if i and high >= low else 0
            if i:
                up = parents[i]
                n[up] += n[i]
                least[up] = min(least[up], least[i], key=lambda x: self._order(x[0])) if least[up] else least[i]
                lows[up], highs[up] = min(lows[up], lows[i]), max(highs[up], highs[i])
                leaves[up] += leaves[i]
                saved[up] += saved[i]
                tops[up] += 1 if high >= low else tops[i]
        opened: list[dict] = []
        above: list = [None] * size  # the trie node that what follows hangs on: (conv, name if open, record if open)
        for i, node in enumerate(nodes):
            low, high = spans[i]
            hang, rest, conv = above[parents[i]] if i else (None, None, None), saved[i], least[i][0]
            starts, stops = lows[i] == 0, highs[i] == last
            is_open = starts or stops
            names = first_names if starts else last_names
            for depth in range(low, high + 1):
                deepest = depth == high
                children = below[i] if deepest else 1
                ends = ",".join("null" if self.convs[x] is None else str(self.convs[x]) for x in sorted(node.ends)) if deepest and node.upto == depth * WIDTH else ""
                weight = self.sizes[node.row][depth - 1] if depth else 0
                row = {"conv_id": conv, "depth": depth, "n_convs": n[i], "block": self.number, "is_open": is_open, "parent_name": hang[1]}
                if is_open:
                    row |= {"name": names[depth], "branch": 0 if starts and stops else 1 if starts else 2, "size": weight, "kids": children, "closed_kids": 0, "n_leaves": 0, "saved_tokens": 0, "ends": ends or None}
                    hang = (conv, names[depth], row)
                else:
                    if hang[2] is not None:
                        hang[2]["closed_kids"] += 1
                        hang[2]["n_leaves"] += leaves[i]
                        hang[2]["saved_tokens"] += rest
                    row |= {"parent_conv_id": None if hang[1] else hang[0], "n_children": children, "n_leaves": leaves[i], "saved_tokens": rest, "ends_sha256": sha256(ends.encode()).hexdigest()}
                    hang = (conv, None, None)
                    yield row
                if is_open:
                    opened.append(row)
                rest -= (n[i] - 1) * weight
            above[i] = hang if high >= low else above[parents[i]]
        yield from opened


def _pieces(keyed: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Finished nodes and the parts of open ones, from keyed (conv_id, key, sizes) sorted by ranges of key and conv_id."""
    kind = keyed.schema["conv_id"].dataType.simpleString()

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, schema = TaskContext.get().partitionId() << 32, None
        convs, keys, sizes, held = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            found = []
            for row in _Block(number, convs, keys, sizes).rows():
                found.append(row)
                if len(found) == 8192:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)

        for batch in batches:
            conv = batch.schema.field(0).type
            schema = schema or pa.schema([("conv_id", conv), ("depth", pa.int64()), ("parent_conv_id", conv), *((x, pa.int64()) for x in NODE[3:7]), ("ends_sha256", pa.string()), ("block", pa.int64()), ("is_open", pa.bool_()), ("name", pa.binary()), ("parent_name", pa.binary()), ("branch", pa.int32()), ("size", pa.int64()), ("kids", pa.int64()), ("closed_kids", pa.int64()), ("ends", pa.string())])
            for conv, key, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                convs.append(conv)
                keys.append(key)
                sizes.append(size)
                held += len(key)
                if len(convs) >= block_rows or held >= block_bytes:
                    yield from out()
                    number, convs, keys, sizes, held = number + 1, [], [], [], 0
        if convs:
            yield from out()

    schema = f"conv_id {kind}, depth long, parent_conv_id {kind}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, block long, is_open boolean, name binary, parent_name binary, branch int, size long, kids long, closed_kids long, ends string"
    order = [F.col("key"), F.col("conv_id").asc_nulls_last()]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(built, schema)


def _digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of ends (name, block, ends): the lists of one name, joined by commas in the order of their blocks, streamed."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, sha256()
        for batch in batches:
            done: list[dict] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name == now:
                    running.update(b",")
                elif now is not None:
                    done.append({"name": now, "ends_sha256": running.hexdigest()})
                if name != now:
                    now, running = name, sha256()
                running.update(text.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"name": now, "ends_sha256": running.hexdigest()}], schema)

    schema = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])
    return ends.select("name", "block", "ends").repartition("name").sortWithinPartitions("name", "block").mapInArrow(hashed, "name binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The trie of convs (conv_id, turns), as turn_lists() makes them, a row per node: the columns of NODE.

    A node is a distinct sequence of the first depth turns of conversations; these are its members, n_convs of them, and conv_id
    is the smallest one, so that (conv_id, depth) names a node; with_turns() gives its last turn. parent_conv_id is the parent's
    conv_id, null for the root. n_children counts its children, n_leaves the childless nodes of its subtree, itself included.
    saved_tokens sums, over its subtree, each node's members but one times the size of its last turn. ends_sha256 is of
    the decimal ids of the members that have no more turns, ascending, joined by commas.

    Conversations without turns, or with null turns, are members of the root alone. conv_ids are distinct; a null one is a
    member like others, the largest, and written null in the digests. Turns of any length count alike. An empty table gives an
    empty result; further columns aren't read.
    """
    scratch = Scratch(convs.sparkSession, "trie")
    turns = F.coalesce("turns", F.expr(f"cast(array() as {TURNS})"))
    key = F.unhex(F.array_join(F.transform(turns, lambda x: x["id"]), ""))
    keyed = scratch.write(convs.select("conv_id", key.alias("key"), F.transform(turns, lambda x: x["size"]).alias("sizes")), "keys")
    pieces = scratch.write(_pieces(keyed, block_rows, block_bytes), "pieces")
    scratch.drop("keys")

    parts = pieces.where("is_open").drop("parent_conv_id", "n_children", "ends_sha256")
    whole = parts.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("kids").alias("_kids"), F.sum("closed_kids").alias("_closed"),
        F.min("block").alias("_owner"), F.first("size").alias("_size"), F.first("parent_name", True).alias("parent_name"),
    )
    whole = scratch.write(whole, "open")
    # what an open node adds to its ancestors' sums is added in the first block that it lies in
    mine = parts.join(whole.select("name", F.col("n_convs").alias("_n"), "_kids", "_owner"), "name")
    owned = F.col("block") == F.col("_owner")
    mine = mine.select(
        "name", "block", "branch", "depth",
        (F.col("n_leaves") + F.when(owned & (F.col("_kids") == 0), 1).otherwise(0)).alias("_leaves"),
        (F.col("saved_tokens") + F.when(owned, (F.col("_n") - 1) * F.col("size")).otherwise(0)).alias("_saved"),
    )
    # the open nodes of a block are a stem and two branches: below a node of the stem is all that is deeper
    deeper = Window.partitionBy("block").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, 0)
    branch = Window.partitionBy("block", "branch").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, 0)
    under = lambda x: F.when(F.col("branch") == 0, F.sum(x).over(deeper)).otherwise(F.sum(x).over(branch))
    sums = mine.select("name", under("_leaves").alias("_leaves"), under("_saved").alias("_saved")).groupBy("name").agg(F.sum("_leaves").alias("n_leaves"), F.sum("_saved").alias("saved_tokens"))
    kids = whole.where("parent_name is not null").groupBy(F.col("parent_name").alias("name")).agg(F.count(F.lit(1)).alias("_open"))
    parents = whole.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"))
    ends = _digests(parts.where("ends is not null"))
    opened = whole.join(sums, "name").join(kids, "name", "left").join(ends, "name", "left").join(parents, "parent_name", "left")
    opened = opened.select("conv_id", "depth", "parent_conv_id", "n_convs", (F.col("_closed") + F.coalesce("_open", F.lit(0))).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"))

    # finished nodes below an open one take its conv_id from their own block's copy, so that none is looked up by all
    closed = pieces.where("not is_open")
    copies = parts.select("block", F.col("name").alias("parent_name")).join(parents, "parent_name")
    below = closed.where("parent_name is not null").drop("parent_conv_id").join(copies, ["block", "parent_name"])
    return closed.where("parent_name is null").select(*NODE).unionByName(below.select(*NODE)).unionByName(opened)


def with_turns(trie: DataFrame, rows: DataFrame) -> DataFrame:
    """trie with role and text of each node's last turn, from the rows (conv_id, turn, role, text) that it was made of by turn_lists(); null for the root.

    Nodes are joined to the turns of their smallest member by place, so every node looks up a turn of its own.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "id"))
    turns = _said(rows).select(F.col("conv_id").alias("_conv"), place.cast("long").alias("_place"), "role", "text")
    found = trie.join(turns, trie["conv_id"].eqNullSafe(turns["_conv"]) & (trie["depth"] == turns["_place"]), "left")
    return found.drop("_conv", "_place")
