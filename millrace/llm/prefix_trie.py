"""Conversation prefix trie by partition refinement.

All conversations start in one class, the root. A class is split by the next turn of its members; the digest of a
prefix names the class, so a split is an expression and no class is ever gathered. A conversation that is alone in its
class retires: the rest of it is a chain of nodes with one member, emitted as it stands. The others go on. Turns are
taken in blocks of 16, 32, 64 ... LEVELS turns, a job each, so that two long conversations that part late take few
rounds. Then the blocks are folded back from the deepest: a node's own values (leaves, saved bytes) travel along the
path of its smallest member to all nodes above it in the block, are summed there, and the sums of a block's top nodes
go to their parents in the block before.

How it moves: turns are numbered by a prefix scan, so a conversation of any size is never one task. Only digests (32
bytes a turn) travel after that; a class that a third of all conversations share is a count with partial sums, and
the joins on classes have one row per class on one side. The digest of a node's ending members is over their sorted
ids by definition: they are sorted by ranges and joined to texts of up to CHUNK_IDS ids, and only those meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import CRC32_TABLE_SQL, crc32_sql, discard, lean, read_table, written
from millrace.operators import scans

FIRST_LEVELS, LEVELS = 16, 256
CHUNK_IDS = 8192
#: Conversations of one base share its first turns in the contract's tables.
GROUP, MOST_HEAD = 5, 8
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
#: The root's class.
ROOT = b""


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, symbol, bytes): the turns of each conversation numbered from 1; a symbol is a SHA-256 of role and text.

    Null turns come first, null roles and texts count as empty; rows that share a turn are ordered by role, then by the
    SHA-256 of their text, and repeated rows are turns of their own. Rows without a conv_id are no conversation.
    """
    c = F.col
    role = F.coalesce(c("role").cast("string"), F.lit(""))
    text = F.coalesce(c("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("th"), F.octet_length(text).cast("long").alias("bytes")
    )
    numbered = scans.numbered(turns, [c("turn").asc_nulls_first(), "role", "th"], ["conv_id"], "at")
    # the text's digest has a fixed length, so role and text cannot run into each other
    return numbered.select("conv_id", "at", F.unhex(F.sha2(F.concat(c("role").cast("binary"), c("th")), 256)).alias("symbol"), "bytes")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (conv_id, depth, symbol, bytes) and (conv_id, length).

    A conversation c takes the first h turns of c - c % 5 (fewer if there are fewer), h = crc32(c) % 9, and then its
    own turns after its first h.
    """
    c = F.col
    h = (F.crc32(c("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("own")).withColumns({"h": h, "base": c("conv_id") - c("conv_id") % GROUP})
    heads = turns.where((c("at") <= MOST_HEAD) & (c("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    bases = sizes.where(c("conv_id") % GROUP == 0).select(c("conv_id").alias("base"), c("own").alias("of_base"))
    plan = sizes.join(bases, "base", "left").select("conv_id", "base", "h", "own", F.least("h", F.coalesce("of_base", F.lit(0))).alias("head"))
    plan = written(plan, "trie-plan")
    copied = heads.join(plan.select("conv_id", "base", "h"), "base").where("at <= h").select("conv_id", c("at").alias("depth"), "symbol", "bytes")
    own = turns.join(plan.select("conv_id", "h", "head"), "conv_id").where("at > h").select("conv_id", (c("at") - c("h") + c("head")).alias("depth"), "symbol", "bytes")
    return copied.union(own), plan.select("conv_id", (c("head") + F.greatest(c("own") - c("h"), F.lit(0))).alias("length"))


def _paths(turns: DataFrame, active: DataFrame, low: int, size: int) -> DataFrame:
    """(conv_id, length, digests, bytes): the classes of each active conversation at the next ``size`` turns."""
    rows = turns.where(F.col("depth").between(low + 1, low + size)).join(active, "conv_id")
    packed = rows.groupBy("conv_id", "length", "digest").agg(F.array_sort(F.collect_list(F.struct("depth", "symbol", "bytes"))).alias("t"))  # at most ``size`` turns
    step = lambda seen, t: F.concat(seen, F.array(F.unhex(F.sha2(F.concat(F.element_at(seen, -1), t["symbol"]), 256))))
    return packed.select("conv_id", "length", F.aggregate("t", F.array("digest"), step).alias("digests"), F.col("t.bytes").alias("bytes"))


def _chain_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) as (node, first id, ids joined by commas), a node in pieces of CHUNK_IDS."""
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
    held: list = [None, []]

    def piece():
        return (held[0], held[1][0], ",".join(map(str, held[1])).encode())

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    done = []
    for batch in batches:
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held[1] and (node != held[0] or len(held[1]) >= CHUNK_IDS):
                done.append(piece())
                held[1] = []
            held[0] = node
            held[1].append(conv)
        if len(done) >= 1000:
            yield out(done)
            done = []
    if held[1]:
        done.append(piece())
    if done:
        yield out(done)


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as (node, SHA-256 of all its ids): a running hash, one piece at a time."""
    schema = pa.schema([("node", pa.binary()), ("ends", pa.string())])
    node, running = None, None
    for batch in batches:
        done = []
        for of, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if running is not None and of == node:
                running.update(b"," + ids)
                continue
            if running is not None:
                done.append((node, running.hexdigest()))
            node, running = of, hashlib.sha256(ids)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], schema=schema)


def _ends(members: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the sorted ids of the members that end at a node."""
    order = ["node", "conv_id"]
    pieces = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_chain_ids), "node binary, first long, ids binary")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(lean(_hash_ids), "node binary, ends string")


def _nodes(paths: DataFrame, low: int) -> DataFrame:
    """(node, parent, depth, bytes, n, conv_id): the classes of a block, counted."""
    each = paths.select("conv_id", F.posexplode(F.arrays_zip(F.expr("slice(digests, 2, size(bytes))").alias("node"), F.expr("slice(digests, 1, size(bytes))").alias("parent"), "bytes")).alias("k", "e"))
    # parent, depth and bytes follow from the node
    return each.groupBy("e.node", "e.parent", (F.col("k") + low + 1).cast("long").alias("depth"), "e.bytes").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))


def _fold(paths: DataFrame, own: DataFrame, low: int) -> DataFrame:
    """(node, leaves, saved): sums over the subtrees of a block's shared nodes, from their own values."""
    chains = own.groupBy("conv_id").agg(F.max("depth").alias("deepest"), F.collect_list(F.struct("depth", "leaves", "saved")).alias("chain"))  # at most a block's levels
    reach = lambda name: F.aggregate(F.filter("chain", lambda x: x["depth"] >= F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x[name])
    levels = paths.join(chains, "conv_id").select("chain", "digests", F.explode(F.sequence(F.lit(low + 1).cast("long"), "deepest")).alias("at"))
    return levels.select(F.element_at("digests", (F.col("at") - low + 1).cast("int")).alias("node"), reach("leaves").alias("leaves"), reach("saved").alias("saved")).groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(turns: DataFrame, lengths: DataFrame, first_levels: int = FIRST_LEVELS, most_levels: int = LEVELS) -> DataFrame:
    """The prefix trie of sequences: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends).

    ``turns`` has (conv_id, depth from 1 without gaps, symbol binary, bytes), ``lengths`` (conv_id, length) of every
    conversation, turnless ones included. A node is named by its smallest member and its depth: (conv_id, depth) is
    also the place of its last turn, and (parent_conv_id, depth - 1) its parent. No conversations give no nodes, not
    even a root. A conversation in several rows of ``lengths`` is an error of the caller.
    """
    c = F.col
    turns, lengths = written(turns, "trie-turns"), written(lengths, "trie-lengths")
    spare = [turns, lengths]
    whole = lengths.agg(F.count("*"), F.min("conv_id")).first()
    count, least = whole[0], whole[1] or 0
    active = lengths.where("length > 0").withColumn("digest", F.lit(ROOT))
    blocks, tails, low, size = [], [], 0, first_levels
    while True:
        paths = written(_paths(turns, active, low, size), "trie-paths")
        nodes = written(_nodes(paths, low), "trie-nodes")
        spare += [paths, nodes]
        blocks.append((paths, nodes, low))
        onward = paths.where(c("length") > low + size)
        alone = nodes.where((c("n") == 1) & (c("depth") == low + size)).select("conv_id")
        tails.append(onward.join(alone, "conv_id", "left_semi").select("conv_id", "length", F.lit(low + size).cast("long").alias("after")))
        active = written(onward.join(alone, "conv_id", "left_anti").select("conv_id", "length", F.element_at("digests", -1).alias("digest")), "trie-active")
        spare.append(active)
        low, size = low + size, min(2 * size, most_levels)
        if active.isEmpty():
            break

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    nodes = union([n for _, n, _ in blocks])
    children = written(nodes.groupBy(c("parent").alias("of")).agg(F.count("*").alias("n_children"), F.count_if(c("n") == 1).alias("n_single")), "trie-children")
    ending = union([p.where(c("length") <= at + F.size("bytes")).select(F.element_at("digests", -1).alias("node"), "conv_id") for p, _, at in blocks])
    ends = written(_ends(ending.union(lengths.where("length = 0").select(F.lit(ROOT).alias("node"), "conv_id"))).withColumnRenamed("node", "at_node"), "trie-ends")
    spare += [children, ends]

    # fold back, deepest block first
    below, folded = None, []
    for paths, of_block, low in reversed(blocks):
        shared = of_block.where("n > 1").join(children, c("node") == c("of"), "left")
        own = shared.select("node", "conv_id", "depth", (F.coalesce("n_single", F.lit(0)) + c("n_children").isNull().cast("long")).alias("leaves"), ((c("n") - 1) * c("bytes")).alias("saved"))
        if below is not None:
            own = own.join(below, c("node") == c("under"), "left").select("node", "conv_id", "depth", (c("leaves") + F.coalesce("u_leaves", F.lit(0))).alias("leaves"), (c("saved") + F.coalesce("u_saved", F.lit(0))).alias("saved"))
        sums = written(_fold(paths, own, low), "trie-sums")
        spare.append(sums)
        folded.append(sums)
        tops = of_block.where((c("n") > 1) & (c("depth") == low + 1)).select("node", "parent")
        below = written(sums.join(tops, "node").groupBy(c("parent").alias("under")).agg(F.sum("leaves").alias("u_leaves"), F.sum("saved").alias("u_saved")), "trie-below")
        spare.append(below)

    # a parent that is not shared is the node's own conversation; the root's is the least of all
    owners = nodes.where("n > 1").select(c("node").alias("o_node"), c("conv_id").alias("o_conv"))
    placed = nodes.join(owners, c("parent") == c("o_node"), "left").withColumn("parent_conv_id", F.when(c("depth") == 1, F.lit(least)).otherwise(F.coalesce("o_conv", "conv_id")))
    none = F.lit(NO_MEMBERS)
    joined = placed.join(children, c("node") == c("of"), "left").join(ends, c("node") == c("at_node"), "left").join(union(folded).select(c("node").alias("f_node"), "leaves", "saved"), c("node") == c("f_node"), "left")
    alone = c("n") == 1
    # a single node at the end of a block may go on as a tail, which is no node of a block
    going = union(tails).select(c("conv_id").alias("t_conv"), c("after"))
    joined = joined.join(going, alone & (c("conv_id") == c("t_conv")) & (c("depth") == c("after")), "left")
    inner = joined.select(
        "conv_id", "depth", "parent_conv_id", c("n").alias("n_convs"), F.when(c("after").isNotNull(), F.lit(1)).otherwise(F.coalesce("n_children", F.lit(0))).cast("long").alias("n_children"),
        F.when(alone, 1).otherwise(c("leaves")).cast("long").alias("n_leaves"), F.when(alone, 0).otherwise(c("saved")).cast("long").alias("saved"), F.coalesce("ends", none).alias("ends"),
    )
    last = c("depth") == c("length")
    chains = turns.join(union(tails), "conv_id").where("depth > after").select(
        "conv_id", c("depth").cast("long"), c("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"), F.when(last, F.sha2(c("conv_id").cast("string"), 256)).otherwise(none).alias("ends"),
    )
    root = children.where(c("of") == F.lit(ROOT)).agg(F.max("n_children").alias("k"), F.max("n_single").alias("s"))
    under = below.where(c("under") == F.lit(ROOT)).agg(F.max("u_leaves").alias("l"), F.max("u_saved").alias("v"))
    at_root = ends.where(c("at_node") == F.lit(ROOT)).agg(F.max("ends").alias("e"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    top = root.join(under).join(at_root).where(F.lit(count > 0)).select(  # three single rows
        F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(count).cast("long").alias("n_convs"), zero("k").alias("n_children"),
        F.when(c("k").isNull(), F.lit(1).cast("long")).otherwise(zero("s") + zero("l")).alias("n_leaves"), zero("v").alias("saved"), F.coalesce("e", none).alias("ends"),
    )
    out = written(inner.union(chains).union(top), "trie")
    for t in spare:
        discard(t)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(ordered_turns(read_table(spark, sf_dir, "conversations")), "trie-ordered")
    found = prefix_trie(*rebuild(turns))
    discard(turns)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


OP13_SQL = f"""
with {CRC32_TABLE_SQL}
, t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as place
  from conversations where conv_id is not null
), c as (select conv_id, conv_id - conv_id % {GROUP} base, {crc32_sql("conv_id")} % {MOST_HEAD + 1} h from (select distinct conv_id from t), crc32_table
), r as (
  select c.conv_id, 1 part, place, role, text from c join t on t.conv_id = c.base where place <= h
  union all select conv_id, 2, place, role, text from c join t using (conv_id) where place > h
), s as (select conv_id, list(struct_pack(role := role, text := text) order by part, place) turns from r group by conv_id
), m as (select conv_id, coalesce(turns, []) turns from c left join s using (conv_id)
), p as (select conv_id, unnest(range(len(turns) + 1)) depth, turns from m
), n as (
  select depth, turns[:depth] prefix, min(conv_id) conv_id, count(*) n_convs, coalesce(string_agg(conv_id, ',' order by conv_id) filter (where len(turns) = depth), '') ends
  from p group by all
), kids as (select prefix[:depth - 1] prefix, count(*) k from n where depth > 0 group by 1
), v as (
  select n.*, coalesce(k, 0) k, case when depth > 0 then (n_convs - 1) * strlen(prefix[depth].text) else 0 end saved from n left join kids using (prefix)
), up as (select conv_id, depth, prefix, k, saved, unnest(range(depth + 1)) d from v
), subtree as (select prefix[:d] prefix, sum(case when k = 0 then 1 else 0 end) n_leaves, sum(saved) saved from up group by 1
)
select v.conv_id, v.depth, a.conv_id parent_conv_id, v.n_convs, v.k n_children, cast(b.n_leaves as bigint) n_leaves, cast(b.saved as bigint) saved_tokens, sha256(v.ends) ends_sha256
from v join subtree b using (prefix) left join n a on v.depth > 0 and a.prefix = v.prefix[:v.depth - 1]
"""
