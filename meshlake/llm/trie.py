"""The prefix trie of rebuilt conversations, merged from partial tries.

A conversation c is rebuilt from the first h turns of conversation ``c - c % family`` (all, if it has fewer; none, if it
isn't there) and its own turns after its first h, where h is ``crc32(c) % most``. Every distinct sequence of first turns of rebuilt
conversations is a node; a node's members are the conversations that begin with it.

* Turns are placed by ranges: an order within range partitions, and one number for each range of a conversation, so that a
  conversation of any length is spread over tasks. Ties of ``turn`` go by role, then text; null turns come first.
* A prefix is known by the sums of four 32-bit parts of its turns' hashes (each with its depth), so a running sum names all of its nodes.
* Partial tries: every task combines its nodes before the shuffle; partial node tables of 1,024 neighbouring conversation
  ids each merge into one row a node (count, smallest member, list of ended conversations), and these rows merge again by the node's
  hash. Lists of any length are digested as a stream, so none is ever held whole.
* Roll-up: a node belongs to its smallest member, so a conversation owns the last part of its path, a chain, that hangs on a node of
  another chain. Totals of hanging chains are summed by pointer doubling (as many rounds as the logarithm of the nesting), then running sums
  within chains, cut into blocks, give every subtree's sums.

Rows with a null conv_id are in no conversation and are left out; null role and text count as empty; repeated rows are turns of their own;
texts of any length count by their code points. Other columns don't matter, whatever their names. An empty table gives no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.columns import only
from meshlake.llm.scratch import forget, keep

#: Turns of a conversation, and nodes of a chain, that one window group takes at most: 2 ** BLOCK.
BLOCK = 12
#: Neighbouring conversation ids whose partial tries merge first.
LANE = 1024
PARTS = ("s0", "s1", "s2", "s3")


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 0), t1 and t2 (hashes of role and text), size (code points) of every turn."""
    rows = only(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = ordered.select(
        "conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit("turn"), "role").alias("t2"), F.char_length("text").cast("long").alias("size")
    )
    ordered = keep(ordered).withColumn("range", F.shiftright("at", 33))
    starts = ordered.groupBy("conv_id", "range").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("conv_id", "range", (F.col("low") - F.coalesce(before, F.lit(0))).alias("low"))
    placed = keep(ordered.join(starts, ["conv_id", "range"]).select("conv_id", (F.col("at") - F.col("low")).alias("i"), "t1", "t2", "size"))
    forget(ordered)
    return placed


def rebuilt(turns: DataFrame, family: int, most: int) -> DataFrame:
    """conv_id, depth, t1, t2, size, ended of every turn of every rebuilt conversation, and of depth 0."""
    conv = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.select("conv_id", "n", (conv - conv % family).alias("base"), F.pmod(F.crc32(conv.cast("string")), F.lit(most)).alias("h"))
    heads = turns.where((conv % family == 0) & (F.col("i") < most - 1)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "t1", "t2", "size"))).alias("head"))
    info = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    info = info.withColumn("k", F.least("h", F.coalesce(F.size("head"), F.lit(0)).cast("long"))).withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.col("k").cast("int")))
    info = keep(info.select("conv_id", "n", "h", "k", "head"))
    columns = ["conv_id", "depth", "t1", "t2", "size", "ended"]
    none = F.lit(0).cast("long")
    roots = info.select("conv_id", none.alias("depth"), none.alias("t1"), none.alias("t2"), none.alias("size"), ((F.col("k") == 0) & (F.col("n") <= F.col("h"))).alias("ended"))
    given = info.select("conv_id", "n", "h", "k", F.explode("head").alias("t"))
    given = given.select("conv_id", (F.col("t.i") + 1).alias("depth"), "t.t1", "t.t2", "t.size", ((F.col("n") <= F.col("h")) & (F.col("t.i") + 1 == F.col("k"))).alias("ended"))
    own = turns.join(info.select("conv_id", "n", "h", "k"), "conv_id").where("i >= h")
    own = own.withColumn("depth", F.col("i") - F.col("h") + F.col("k") + 1).withColumn("ended", F.col("i") == F.col("n") - 1)
    return roots.select(columns).union(given.select(columns)).union(own.select(columns))


def running(rows: DataFrame, key: str, order: Column, names: tuple[str, ...]) -> DataFrame:
    """Every row with the named columns summed over the rows of its key up to it; order: a whole number, one row of a key for each."""
    rows = rows.withColumn("_order", order).withColumn("_block", F.shiftright("_order", BLOCK))
    blocks = rows.groupBy(key, "_block").agg(*(F.sum(c).alias(f"_{c}") for c in names))
    span = Window.partitionBy(key).orderBy("_block")
    before = blocks.select(key, "_block", F.lag("_block").over(span).alias("_last"), *(F.sum(f"_{c}").over(span.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{c}") for c in names))
    before = before.where("_last IS NOT NULL").drop("_last")  # few keys have a second block
    within = Window.partitionBy(key, "_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.sum(c).over(within) for c in names}).join(before, [key, "_block"], "left")
    return rows.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in names}).drop("_order", "_block", *(f"_{c}" for c in names))


def paths(rows: DataFrame) -> DataFrame:
    """Rows of ``rebuilt`` with their node's key (na, nb) and that of its parent (pa, pb)."""
    low = F.lit((1 << 32) - 1)
    p, q = F.xxhash64("depth", "t1", "t2"), F.xxhash64("t2", F.lit("depth"), "t1", "depth")
    parts = [p.bitwiseAND(low), F.shiftrightunsigned(p, 32), q.bitwiseAND(low), F.shiftrightunsigned(q, 32)]
    parts = [F.when(F.col("depth") > 0, x).otherwise(F.lit(0)).alias(f"x{i}") for i, x in enumerate(parts)]
    rows = keep(rows.select("conv_id", "depth", "size", "ended", *parts).withColumns({c: F.col(f"x{i}") for i, c in enumerate(PARTS)}))
    sums = running(rows, "conv_id", F.col("depth"), PARTS)
    before = [F.col(c) - F.col(f"x{i}") for i, c in enumerate(PARTS)]
    return sums.select(
        "conv_id", "depth", "size", "ended", F.xxhash64("depth", *PARTS).alias("na"), F.xxhash64(*PARTS[::-1], F.lit("node"), "depth").alias("nb"),
        F.xxhash64(F.col("depth") - 1, *before).alias("pa"), F.xxhash64(*before[::-1], F.lit("node"), F.col("depth") - 1).alias("pb"),
    )


def digests(lists: DataFrame) -> DataFrame:
    """na, nb, sha (lower-case SHA-256 hex of a node's lists, joined by commas in the order of ``lane``), read as a stream."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None
        for batch in batches:
            done = []
            for na, nb, ends in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if (na, nb) != now:
                    if now:
                        done.append((*now, hashed.hexdigest()))
                    now, hashed = (na, nb), hashlib.sha256(ends.encode())
                else:
                    hashed.update(b"," + ends.encode())
            yield rows_of(done)
        if now:
            yield rows_of([(*now, hashed.hexdigest())])

    def rows_of(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        a, b, sha = zip(*done, strict=True) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string())], ["na", "nb", "sha"])

    dealt = lists.select("na", "nb", "lane", "ends").repartition("na", "nb").sortWithinPartitions("na", "nb", "lane")
    return dealt.mapInArrow(digest, "na long, nb long, sha string")


def hanging_totals(chains: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Chains with the named columns summed over all chains that hang on them, directly or not: conv_id and up (null at the top) are their links."""
    level = chains
    while not level.where("up IS NOT NULL").isEmpty():
        gains = level.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(*(F.sum(c).alias(f"_{c}") for c in names))
        further = level.select(F.col("conv_id").alias("up"), F.col("up").alias("_up"))
        above = level.join(further, "up", "left").join(gains, "conv_id", "left")
        above = keep(above.select("conv_id", F.col("_up").alias("up"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names)))
        if level is not chains:
            forget(level)
        level = above
    return level.drop("up")


def nodes(conversations: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie."""
    turns = placed_turns(conversations)
    ends = F.collect_list(F.when(F.col("ended"), F.col("conv_id")))
    merged = paths(rebuilt(turns, family, most)).withColumn("lane", F.expr(f"conv_id div {LANE}"))
    merged = merged.groupBy("na", "nb", "lane").agg(
        *(F.min(c).alias(c) for c in ("conv_id", "depth", "size", "pa", "pb")), F.count("*").alias("n_convs"), F.array_join(F.sort_array(ends).cast("array<string>"), ",").alias("ends")
    )
    merged = keep(merged)
    summed = keep(merged.groupBy("na", "nb").agg(*(F.min(c).alias(c) for c in ("conv_id", "depth", "size", "pa", "pb")), F.sum("n_convs").alias("n_convs")))
    sha = digests(merged.where("ends <> ''"))
    parents = summed.select(F.col("na").alias("pa"), F.col("nb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    tree = keep(summed.join(parents, ["pa", "pb"], "left").join(sha, ["na", "nb"], "left").drop("na", "nb", "pa", "pb"))
    kids = tree.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = tree.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = keep(tree.withColumns({"saved_tokens": (F.col("n_convs") - 1) * F.col("size"), "n_leaves": (F.col("n_children") == 0).cast("long")}))
    names = ("saved_tokens", "n_leaves")
    head = F.col("parent_conv_id") != F.col("conv_id")
    chains = tree.groupBy("conv_id").agg(F.max(F.when(head, F.col("parent_conv_id"))).alias("up"), F.max(F.when(head, F.col("depth") - 1)).alias("depth"), *(F.sum(c).alias(c) for c in names))
    chains = keep(chains)
    totals = hanging_totals(chains.select("conv_id", "up", *names), names)
    hung = chains.where("up IS NOT NULL").select("conv_id", "up", "depth").join(totals, "conv_id")
    hung = hung.groupBy(F.col("up").alias("conv_id"), "depth").agg(*(F.sum(c).alias(f"_{c}") for c in names))
    tree = tree.join(hung, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in names})
    tree = running(keep(tree.drop("size", *(f"_{c}" for c in names))), "conv_id", -F.col("depth"), names)
    empty = hashlib.sha256().hexdigest()
    return tree.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(empty)).alias("ends_sha256"))
