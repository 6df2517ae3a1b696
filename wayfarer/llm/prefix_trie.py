"""The trie of conversation prefixes: members, leaves and shared tokens of every prefix, by an Euler tour.

1. Turns are numbered by a range-partitioned running count, so that a conversation with a
   third of all turns is spread like any other (``running``). Texts become digests and lengths
   where they are read and are never shuffled.
2. A rebuilt conversation is the first h turns of its base and its own turns after the h-th.
   The name of a prefix is the sum, in four 32-bit parts, of the MD5 digests of (depth, turn);
   it is another running sum, and its parent's name is that sum without the last turn.
3. Nodes come from grouping members by name. A node is known by its smallest member and its
   depth. The first child and the next sibling (by smallest member) give every node an enter
   and an exit arc with their successors: one list, the Euler tour.
4. The list is ranked in two steps. Arcs are dealt by ranges of nodes; inside a block of at
   most ``BLOCK`` nodes the stretches of the list are ranked by pointer jumping over arrays,
   and each becomes one link of a shorter list. Links are ranked by pointer jumping in
   Spark: each round a link adds what its successor knows and takes over its successor,
   so rounds are the logarithm of the links. Ranks and the sums of leaves and savings
   travel together.
5. A subtree's sums are the differences between its enter and its exit arc.
6. The ids that end at a node are joined in sorted pieces of ``PIECE`` ids before they meet,
   and hashed as a stream: a third of all conversations may end at one node.

Joins of children with their parent are many to one and unsalted; adaptive execution splits
a hot parent's children.

Defined results: null roles and texts are empty; turns of equal number are ordered by the
digest of role and text; repeated rows are turns of their own; rows with a null conv_id belong
to no conversation; an empty table has no nodes, not even a root. Only the four columns are
read, so further ones cannot clash. Very long texts only cost their digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import cut

#: Conversations whose prefixes are shared lie in groups of so many ids; at most so many turns are shared.
GROUP, SHARED = 100, 6
#: Nodes ranked at a time in a task, and ids of one piece.
BLOCK, PIECE = 500_000, 10_000
NONE = -(2**63)

ARC_SCHEMA = (
    "conv_id long, depth long, in_c long, in_d long, in_s int, in_leaves long, in_saved long, "
    "out_c long, out_d long, out_s int, out_leaves long, out_saved long"
)
LINK_SCHEMA = "c long, d long, s int, next_c long, next_d long, next_s int, arcs long, leaves long, saved long"
_ARC, _LINK = ([c.split(" ")[0] for c in s.split(", ")] for s in (ARC_SCHEMA, LINK_SCHEMA))


def running(rows: DataFrame, key: str, order: list[str], **terms: Column) -> DataFrame:
    """``rows`` with running sums per key in the given order, this row included.

    Rows are dealt by ranges of key and order, so a key may lie in several partitions. What
    lies before a partition is known for at most one key each, so these sums are broadcast.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, key, *order).withColumn("pid", F.spark_partition_id()))
    upto = Window.partitionBy("pid", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("pid", key).agg(*[F.sum(t).alias(name) for name, t in terms.items()])
    bases = parts.select("pid", key, *[F.sum(name).over(before).alias(f"{name}_before") for name in terms])
    bases = bases.filter(F.col(f"{next(iter(terms))}_before").isNotNull())
    out = dealt.withColumns({name: F.sum(t).over(upto) for name, t in terms.items()}).join(F.broadcast(bases), ["pid", key], "left")
    total = {name: F.col(name) + F.coalesce(f"{name}_before", F.lit(0)) for name in terms}
    return out.withColumns(total).drop("pid", *[f"{name}_before" for name in terms])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i, digest, chars: the turns of each conversation, numbered from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        digest.alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    return running(rows, "conv_id", ["turn", "digest"], i=F.lit(1).cast("long")).drop("turn")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, chars, size) of all rebuilt turns, and (conv_id, size) of all conversations."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED))
    own = numbered.groupBy("conv_id").agg(F.max("i").alias("n_own"))
    bases = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    sizes = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": h}).join(bases, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    sizes = cut(
        sizes.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("size"))
    )
    after = numbered.join(sizes, "conv_id").filter("i > h").withColumn("depth", F.col("taken") + F.col("i") - F.col("h"))
    heads = numbered.filter((F.col("conv_id") % GROUP == 0) & (F.col("i") < SHARED)).withColumnRenamed("conv_id", "base")
    before = heads.join(sizes, "base").filter("i <= taken").withColumn("depth", F.col("i"))
    columns = ["conv_id", "depth", "digest", "chars", "size"]
    return before.select(columns).unionAll(after.select(columns)), sizes.select("conv_id", "size")


_SUMS = ["n0", "n1", "n2", "n3"]


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in (depth, *sums)]))


def members(rows: DataFrame) -> DataFrame:
    """conv_id, depth, name, parent, chars, size of each prefix of each rebuilt conversation but the empty one."""
    tagged = rows.withColumn("tag", F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest"))).drop("digest")
    part = lambda k: F.conv(F.substring("tag", 1 + 8 * k, 8), 16, 10).cast("long")
    summed = running(tagged, "conv_id", ["depth"], **{n: part(k) for k, n in enumerate(_SUMS)})
    above = [F.col(n) - part(k) for k, n in enumerate(_SUMS)]
    return summed.select(
        "conv_id",
        "depth",
        _name(F.col("depth"), [F.col(n) for n in _SUMS]).alias("name"),
        _name(F.col("depth") - 1, above).alias("parent"),
        "chars",
        "size",
    )


def nodes_of(prefixes: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node with its parent, first child and next sibling, dealt by ranges of (conv_id, depth)."""
    zero = F.lit(0).cast("long")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(
        _name(zero, [zero] * 4).alias("name"), zero.alias("depth"), F.lit(None).cast("string").alias("parent"), "conv_id", "n_convs", zero.alias("chars")
    )
    grouped = prefixes.groupBy("name", "depth").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars")
    )
    nodes = cut(root.unionByName(grouped))
    below = nodes.filter("depth > 0").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("child"))
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.join(below.withColumnRenamed("parent", "name"), "name", "left").join(above, "parent", "left")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(
        known.select("name", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "child", "chars")
        .repartitionByRange(n, "conv_id", "depth")
        .withColumn("pid", F.spark_partition_id())
    )
    # siblings of one range follow each other; the last of a range is followed by the first of the next range that has any
    parent = ["parent_conv_id", "depth"]
    here = Window.partitionBy(*parent, "pid").orderBy("conv_id")
    heads = dealt.filter("depth > 0").groupBy(*parent, "pid").agg(F.min("conv_id").alias("head"))
    on = heads.withColumn("on", F.lead("head").over(Window.partitionBy(*parent).orderBy("pid"))).filter("on is not null").drop("head")
    known = dealt.withColumn("sibling", F.when(F.col("depth") > 0, F.lead("conv_id").over(here)))
    return known.join(on, [*parent, "pid"], "left").withColumn("sibling", F.coalesce("sibling", "on")).drop("on", "pid")


def ranked_block(block: dict[str, np.ndarray]):
    """Arc rows and link rows of one block of nodes sorted by (conv_id, depth).

    Arc 2i enters node i, arc 2i + 1 leaves it; ``NONE`` stands for a missing parent, child or sibling.
    """
    conv, depth, parent, child, sibling = (block[c] for c in ("conv_id", "depth", "parent_conv_id", "child", "sibling"))
    m = len(conv)
    to_c = np.empty(2 * m, np.int64)
    to_d, to_s = np.empty(2 * m, np.int64), np.zeros(2 * m, np.int64)
    inner, last = child != NONE, sibling == NONE
    to_c[::2], to_d[::2], to_s[::2] = np.where(inner, child, conv), np.where(inner, depth + 1, depth), ~inner
    to_c[1::2], to_d[1::2], to_s[1::2] = np.where(last, parent, sibling), np.where(last, depth - 1, depth), last
    end = to_d < 0  # the root's exit
    # a conversation's own nodes are consecutive depths, so a node's place follows from its conversation's first
    convs, first, count = np.unique(conv, return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(convs, to_c), len(convs) - 1)
    place = to_d - depth[first[at]]
    here = (convs[at] == to_c) & (place >= 0) & (place < count[at]) & ~end
    arcs = np.arange(2 * m)
    hop = np.where(here, 2 * (first[at] + place) + to_s, arcs)
    head = np.ones(2 * m, bool)
    head[hop[here]] = False
    weights = np.zeros((3, 2 * m), np.int64)
    weights[0] = 1
    weights[1, ::2] = ~inner
    weights[2, ::2] = (block["n_convs"] - 1) * block["chars"]
    sums = weights.copy()  # from an arc to the one before ``hop``, at last to the end of its stretch
    sums[:, hop == arcs] = 0
    while True:
        far = hop[hop]
        if np.array_equal(far, hop):
            break
        sums += np.where(hop != arcs, sums[:, hop], 0)
        hop = far
    sums += weights[:, hop]
    # the stretch is named after its first arc
    name = np.empty(2 * m, np.int64)
    name[hop[head]] = arcs[head]
    name = name[hop]
    link = arcs[head]
    tail = hop[link]
    missing = end[tail]
    key = lambda a: (conv[a // 2], depth[a // 2], (a % 2).astype(np.int32))
    links = [*key(link), *(pa.array(x[tail], mask=missing) for x in (to_c, to_d, to_s.astype(np.int32))), *sums[:, link]]
    into, out = arcs[::2], arcs[1::2]
    rows = [conv, depth, *key(name[into]), *sums[1:, into], *key(name[out]), *sums[1:, out]]
    return rows, links


def _batch(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def local_lists(nodes: DataFrame) -> DataFrame:
    """Struct columns arc and link, one of them set in each row: the arcs within their stretch, and the stretches."""
    names = ["conv_id", "depth", "parent_conv_id", "child", "sibling", "n_convs", "chars"]

    def rank(held):
        table = pa.Table.from_batches(held)
        block = {c: table.column(c).combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False) for c in names}
        order = np.lexsort((block["depth"], block["conv_id"]))
        rows, links = ranked_block({c: v[order] for c, v in block.items()})
        for columns, fields, other, flip in ((rows, _ARC, _LINK, False), (links, _LINK, _ARC, True)):
            one = _batch(columns, fields).to_struct_array()
            none = pa.nulls(len(one), _struct_type(ARC_SCHEMA if flip else LINK_SCHEMA))
            yield pa.RecordBatch.from_arrays([none, one] if flip else [one, none], names=["arc", "link"])

    def of(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BLOCK:
                yield from rank(held)
                held, size = [], 0
        if size:
            yield from rank(held)

    dealt = nodes.select(names).repartitionByRange(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id", "depth")
    ordered = dealt.sortWithinPartitions("conv_id", "depth")
    return cut(ordered.mapInArrow(of, f"arc struct<{_fields(ARC_SCHEMA)}>, link struct<{_fields(LINK_SCHEMA)}>"))


def _fields(schema: str) -> str:
    return schema.replace(" ", ": ").replace(",: ", ", ")


def _struct_type(schema: str) -> pa.DataType:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.struct([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in schema.split(", ")])


def ranked(links: DataFrame) -> DataFrame:
    """c, d, s, arcs, leaves, saved: for every link the sums from it to the end of the tour, by pointer jumping."""
    now = cut(links)
    while not now.filter("next_d is not null").isEmpty():
        ahead = now.select(
            F.col("c").alias("next_c"), F.col("d").alias("next_d"), F.col("s").alias("next_s"),
            F.struct("next_c", "next_d", "next_s", "arcs", "leaves", "saved").alias("far"),
        )
        more = {x: F.col(x) + F.coalesce(f"far.{x}", F.lit(0)) for x in ("arcs", "leaves", "saved")}
        more |= {x: F.col(f"far.{x}") for x in ("next_c", "next_d", "next_s")}
        now = cut(now.join(ahead, ["next_c", "next_d", "next_s"], "left").withColumns(more).drop("far"))
    return now.drop("next_c", "next_d", "next_s")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: the tour's sums at a node's enter arc less those at its exit arc."""
    lists = local_lists(nodes)
    arcs = lists.filter("arc is not null").select("arc.*")
    after = ranked(lists.filter("link is not null").select("link.*"))
    links = lists.filter("link is not null").select("link.c", "link.d", "link.s", "link.leaves", "link.saved")
    # what follows a stretch: its sums to the end less its own
    tails = cut(
        after.join(links.withColumnsRenamed({"leaves": "own_leaves", "saved": "own_saved"}), ["c", "d", "s"]).select(
            "c", "d", "s", (F.col("leaves") - F.col("own_leaves")).alias("leaves"), (F.col("saved") - F.col("own_saved")).alias("saved")
        )
    )
    one = (F.col("in_c") == F.col("out_c")) & (F.col("in_d") == F.col("out_d")) & (F.col("in_s") == F.col("out_s"))
    own = lambda x: F.col(f"in_{x}") - F.col(f"out_{x}")
    within = arcs.filter(one).select("conv_id", "depth", own("leaves").alias("n_leaves"), own("saved").alias("saved_tokens"))
    side = lambda p: tails.select(*[F.col(x).alias(f"{p}_{x}" if x in "cds" else f"{p}_more_{x}") for x in tails.columns])
    apart = arcs.filter(~one).join(side("in"), ["in_c", "in_d", "in_s"]).join(side("out"), ["out_c", "out_d", "out_s"])
    apart = apart.select(
        "conv_id", "depth", (own("leaves") + own("more_leaves")).alias("n_leaves"), (own("saved") + own("more_saved")).alias("saved_tokens")
    )
    return within.unionAll(apart)


def ends_digests(ends: DataFrame) -> DataFrame:
    """name, ends_sha256 from (name, conv_id): the digest of a node's ids, ascending and joined by commas."""

    def pieces(batches):
        held = None
        for batch in batches:
            out = []
            for name, conv_id in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()):
                if held is None or held[0] != name or len(held[2]) >= PIECE:
                    if held:
                        out.append(held)
                    held = (name, conv_id, [])
                held[2].append(str(conv_id))
            yield _pieces(out)
        if held:
            yield _pieces([held])

    def hashes(batches):
        name, state = None, None
        for batch in batches:
            out = []
            for now, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if now != name:
                    if state:
                        out.append((name, state.hexdigest()))
                    name, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _hashes(out)
        if state:
            yield _hashes([(name, state.hexdigest())])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ends.repartitionByRange(n, "name", "conv_id").sortWithinPartitions("name", "conv_id")
    joined = ordered.mapInArrow(pieces, "name string, first long, ids string")
    return joined.repartition(n, "name").sortWithinPartitions("name", "first").mapInArrow(hashes, "name string, ends_sha256 string")


def _pieces(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([",".join(r[2]) for r in rows], pa.string())],
        names=["name", "first", "ids"],
    )


def _hashes(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["name", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, sizes = rebuilt(cut(turns(conversations)))
    prefixes = cut(members(rows))
    nodes = cut(nodes_of(prefixes, sizes))
    zero = F.lit(0).cast("long")
    turnless = sizes.filter("size = 0").select(_name(zero, [zero] * 4).alias("name"), "conv_id")
    ends = prefixes.filter(F.col("depth") == F.col("size")).select("name", "conv_id").unionAll(turnless)
    return (
        nodes.join(subtree_sums(nodes), ["conv_id", "depth"])
        .join(ends_digests(ends), "name", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
