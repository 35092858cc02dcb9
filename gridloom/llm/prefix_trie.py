"""A trie of conversation prefixes: what conversations share from their first turn on.

Turns are digests and lengths from the start; texts go no further. Places of turns come from one sort dealt out by range,
so a conversation of any length is spread. Conversations are hash-partitioned by their first turn's digest, and each
partition builds its tries from dictionaries of pointers inside ``applyInPandas``; nodes are numbered as they are met, so a
walk backwards over the numbers is the postorder that sums leaves and savings.

A first turn that more than ``most`` turns stand under isn't built in one task. Its node, and all below it up to where its
conversations part, come from counts by depth; what lies beyond is partitioned again by the next turn, round by round
until all parts are small (a round goes to the next fork, so many copies of a conversation or a long common beginning cost
one). A part of one conversation needs no trie either: its nodes are counts too, however long it is. Sums of the parts go
up the rounds in reverse. Rows meet the row of their part or conversation with hot ones dealt out. Identifiers that end at
such a node are sorted by range, packed into chunks and digested in order: SHA-256 is sequential, but its task only reads
chunks and holds one.

Defined results: null turn numbers come first; null role or text is empty; turns of one number are in the order of their
digests; repeated rows are turns of their own; rows without conv_id form one conversation that sorts last, builds on no
other and shows as null (decimal form: empty; a real identifier of 2^63-1 would count as this one); an empty table has no
nodes; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, hot_keys, spread_join
from gridloom.operators.ordering import numbered

#: Rebuilt conversations begin with those of this many identifiers, and with fewer turns than this of them.
FAMILY, HEADS = 100, 6
#: Turns of one part of the trie that a task builds.
MOST = 4096
#: Depths of a shared beginning that are summed in one step, and bytes of identifiers in a chunk.
BLOCK, CHUNK = 1024, 1 << 16
_NONE = (1 << 63) - 1

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = [x.strip().split()[0] for x in NODES.split(",")]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _decimal(c: Column) -> Column:
    return F.when(c == _NONE, "").otherwise(c.cast("string"))


def turns(conversations: DataFrame, work: Workspace) -> DataFrame:
    """(c, k, digest, points): turns of each conversation numbered from 1."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(_NONE)).alias("c"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("points"))
    placed = numbered(rows, ["c", F.col("turn").asc_nulls_first(), "digest"], lambda x: work.keep(x, "sorted"), "k", ["c"])
    return placed.select("c", "k", "digest", "points")


def rebuilt(own: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(rows: c, depth, digest, points, last; conversations: c, n). The beginning of each comes from its family's first."""
    total = own.groupBy("c").agg(F.max("k").alias("own"))
    c = F.col("c")
    base = F.when(c != _NONE, c - c % FAMILY)
    heads = (F.crc32(_decimal(c).cast("binary")) % HEADS).cast("long")
    each = total.select("c", "own", base.alias("base"), heads.alias("h"))
    there = total.select(F.col("c").alias("base"), F.col("own").alias("there"))
    # A base has a family of fewer than 200 conversations.
    each = each.join(there, "base", "left").withColumn("there", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    each = work.keep(each.withColumn("n", F.col("there") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    first = own.where(F.col("k") < HEADS).select(F.col("c").alias("base"), "k", "digest", "points")
    begin = each.where("there > 0").select("c", "base", "there", "n").join(first, "base").where("k <= there")
    begin = begin.select("c", F.col("k").alias("depth"), "digest", "points", (F.col("k") == F.col("n")).alias("last"))
    sizes = each.select("c", "h", "there", "n")
    hot = hot_keys(total, "c", "own", own.count())
    rest = spread_join(own, sizes, "c", hot, F.col("k")).where("k > h")
    depth = F.col("k") - F.col("h") + F.col("there")
    rest = rest.select("c", depth.alias("depth"), "digest", "points", (depth == F.col("n")).alias("last"))
    return work.keep(begin.unionByName(rest), "rebuilt"), each


def _tries(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the parts of one partition: up (of the first node of a part), top and the columns of NODES."""
    frame = frame.sort_values(["gid", "c", "depth"], kind="stable")
    children: list[dict[bytes, int]] = []
    above, depth, conv, count, points, ends, ups, parents = [], [], [], [], [], [], [], []
    roots: dict[bytes, int] = {}
    before = at = None
    for gid, up, c, d, digest, n, last, pconv in zip(*(frame[x].tolist() for x in ("gid", "up", "c", "depth", "digest", "points", "last", "pconv")), strict=True):
        if (gid, c) != before:
            before, at = (gid, c), None
        top = at is None
        known, key = (roots, gid) if top else (children[at], digest)
        node = known.get(key)
        if node is None:
            known[key] = node = len(children)
            children.append({})
            for column, value in ((above, None if top else at), (depth, d), (conv, c), (count, 0), (points, n), (ends, []), (ups, up if top else None), (parents, pconv if top else conv[at])):
                column.append(value)
        count[node] += 1
        if last:
            ends[node].append(c)
        at = node
    leaves, saved = [0] * len(children), [0] * len(children)
    for node in range(len(children) - 1, -1, -1):  # children have larger numbers: a postorder
        leaves[node] = leaves[node] or 1
        saved[node] += (count[node] - 1) * points[node]
        if above[node] is not None:
            leaves[above[node]] += leaves[node]
            saved[above[node]] += saved[node]
    joined = lambda e: ",".join("" if c == _NONE else str(c) for c in sorted(e))
    sha = [hashlib.sha256(joined(e).encode()).hexdigest() if e else _EMPTY for e in ends]
    return pd.DataFrame({"up": ups, "top": [a is None for a in above], "conv_id": conv, "depth": depth, "parent_conv_id": parents, "n_convs": count, "n_children": [len(x) for x in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha})


def _digested(ends: DataFrame) -> DataFrame:
    """ends (gid, depth, c) to (gid, depth, ends_sha256): decimal forms in order of c, joined by commas. No task holds the
    identifiers of a node: they are sorted by range and packed, and the chunks are digested in order."""

    def packed(rows: Iterable[tuple]) -> Iterator[tuple]:
        key, first, held, size = None, None, [], 0
        for gid, depth, c, text in rows:
            if (gid, depth) != key or size > CHUNK:
                if held:
                    yield *key, first, ",".join(held)
                key, first, held, size = (gid, depth), c, [], 0
            held.append(text)
            size += len(text) + 1
        if held:
            yield *key, first, ",".join(held)

    def digested(rows: Iterable[tuple]) -> Iterator[tuple]:
        key = state = None
        for gid, depth, _, chunk in rows:
            if (gid, depth) == key:
                state.update(b"," + chunk.encode())
                continue
            if state is not None:
                yield *key, state.hexdigest()
            key, state = (gid, depth), hashlib.sha256(chunk.encode())
        if state is not None:
            yield *key, state.hexdigest()

    def over(rows: DataFrame, step, schema: str) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = []
            for row in step(r for f in frames for r in zip(*(f[c].tolist() for c in f.columns), strict=True)):
                out.append(row)
                if len(out) == 1000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

        return rows.mapInPandas(each, schema)

    rows = ends.select("gid", "depth", "c", _decimal(F.col("c")).alias("text")).orderBy("gid", "depth", "c")
    chunks = over(rows, packed, "gid binary, depth long, first long, chunk string")
    return over(chunks.repartition("gid", "depth").sortWithinPartitions("gid", "depth", "first"), digested, "gid binary, depth long, ends_sha256 string")


def _chains(straight: DataFrame, work: Workspace, hot: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Large parts and those of one conversation: (their nodes up to the first fork, identifiers that end there with others,
    what goes on behind it). The nodes lack the sums of what is below."""
    ended = F.col("last")
    stats = straight.groupBy("gid", "up", "start", "pconv", "depth").agg(
        F.min("c").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("points").alias("points"), F.count(F.when(ended, 1)).alias("ends"),
        F.min(F.when(ended, F.col("c"))).alias("end"), (F.min("digest") != F.max("digest")).alias("parts"),
    )
    stats = work.keep(stats, f"depths{turn}")
    forks = work.keep(stats.groupBy("gid").agg(F.coalesce(F.min(F.when(F.col("parts"), F.col("depth"))), F.lit(_NONE)).alias("fork")), f"forks{turn}")
    nodes = work.keep(spread_join(stats.drop("parts"), forks, "gid", hot, F.col("depth")).where("depth < fork"), f"chains{turn}")
    ends = spread_join(straight.where("last AND convs > 1").select("gid", "depth", "c"), forks, "gid", hot, F.col("c")).where("depth < fork")
    last = nodes.where(F.col("depth") == F.col("fork") - 1).select("gid", "fork", F.col("conv").alias("above"))
    rest = straight.select("gid", "c", "depth", "digest", "points", "last")
    behind = spread_join(rest, last, "gid", hot, F.struct("c", "depth")).where("depth >= fork")
    return nodes, ends, work.keep(behind, f"behind{turn}")


def _summed(nodes: DataFrame, ends: DataFrame, below: DataFrame, hot: DataFrame) -> DataFrame:
    """Nodes of chains with what is below them: below (up, kids, leaves, saved) by part."""
    own = (F.col("n") - 1) * F.col("points")
    # Sums from the deepest node up: by blocks of depths first, so that no task sees a whole chain.
    rows = nodes.withColumn("block", F.floor(F.col("depth") / BLOCK))
    deeper = Window.partitionBy("gid").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("gid", "block").agg(F.sum(own).alias("t")).select("gid", "block", F.coalesce(F.sum("t").over(deeper), F.lit(0)).alias("deeper"))
    inside = Window.partitionBy("gid", "block").orderBy(F.desc("depth"))
    rows = rows.join(blocks, ["gid", "block"]).withColumn("own", F.sum(own).over(inside) + F.col("deeper"))
    parts = nodes.groupBy("gid").agg(F.max("depth").alias("deepest")).join(below.withColumnRenamed("up", "gid"), "gid", "left").na.fill(0, ["kids", "leaves", "saved"])
    rows = spread_join(rows, parts, "gid", hot, F.col("depth"))
    rows = rows.join(nodes.select("gid", (F.col("depth") + 1).alias("depth"), F.col("conv").alias("over")), ["gid", "depth"], "left")
    rows = rows.join(_digested(ends), ["gid", "depth"], "left")
    sha = F.when(F.col("ends") == 0, F.lit(_EMPTY)).when(F.col("ends") == 1, F.sha2(_decimal(F.col("end")).cast("binary"), 256)).otherwise(F.col("ends_sha256"))
    return rows.select(
        "up", (F.col("depth") == F.col("start")).alias("top"), F.col("conv").alias("conv_id"), "depth", F.coalesce("over", "pconv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("depth") == F.col("deepest"), F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("own") + F.col("saved")).cast("long").alias("saved_tokens"), sha.alias("ends_sha256"),
    )


_BELOW = "up binary, kids long, leaves long, saved long"
_ROOT = b""


def prefix_trie(conversations: DataFrame, work: Workspace, most: int = MOST) -> DataFrame:
    """One row a node, with the columns of NODES."""
    spark = conversations.sparkSession
    rows, each = rebuilt(work.keep(turns(conversations, work), "turns"), work)
    whole = each.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).first()
    if not whole["n"]:
        return spark.createDataFrame([], NODES)
    total = rows.count()
    long = work.keep(hot_keys(each, "c", "n", total), "long")
    heads = rows.where("depth = 1").select("c", F.col("digest").alias("gid"))
    active = spread_join(rows, heads, "c", long, F.col("depth"))
    active = active.select("gid", F.lit(_ROOT).alias("up"), F.lit(whole["c"]).alias("pconv"), F.lit(1).cast("long").alias("start"), *rows.columns)
    buckets = max(1, -(-total // most))
    rounds = []
    while True:
        turn = len(rounds)
        active = work.keep(active, f"parts{turn}")
        sizes = work.keep(active.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("depth") == F.col("start"), 1)).alias("convs")), f"sizes{turn}")
        hot = work.keep(hot_keys(sizes, "gid", "size", total), f"hot{turn}")
        marked = spread_join(active, sizes, "gid", hot, F.struct("c", "depth"))
        straight = (F.col("size") > most) | (F.col("convs") == 1)
        small = marked.where(~straight).select("gid", "up", "pconv", "c", "depth", "digest", "points", "last", F.pmod(F.xxhash64("gid"), F.lit(buckets)).alias("bucket"))
        tries = work.keep(small.groupBy("bucket").applyInPandas(_tries, f"up binary, top boolean, {NODES}"), f"tries{turn}")
        nodes, ends, behind = _chains(work.keep(marked.where(straight).drop("size"), f"straight{turn}"), work, hot, turn)
        rounds.append((tries, nodes, ends, hot))
        if behind.isEmpty():
            break
        heads = behind.where("depth = fork").select("c", F.unhex(F.sha2(F.concat("gid", "digest"), 256)).alias("next"))
        active = spread_join(behind, heads, "c", long, F.col("depth"))
        active = active.select(F.col("next").alias("gid"), F.col("gid").alias("up"), F.col("above").alias("pconv"), F.col("fork").alias("start"), *rows.columns)
    below = spark.createDataFrame([], _BELOW)
    out = []
    for turn, (tries, nodes, ends, hot) in reversed(list(enumerate(rounds))):
        chains = work.keep(_summed(nodes, ends, below, hot), f"summed{turn}")
        tops = tries.unionByName(chains).where("top")
        sums = tops.groupBy("up").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        below = work.keep(sums, f"below{turn}")
        out += [tries.select(*_COLUMNS), chains.select(*_COLUMNS)]
    root = F.lit(_ROOT).alias("gid"), F.lit(0).cast("long").alias("depth")
    turnless = _digested(each.where("n = 0").select(*root, "c"))
    top = spark.range(1).select(*root).join(below.withColumnRenamed("up", "gid"), "gid", "left").join(turnless, ["gid", "depth"], "left")
    out.append(top.select(
        F.lit(whole["c"]).alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole["n"]).alias("n_convs"), F.coalesce("kids", F.lit(0)).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    ))
    nodes = out[0]
    for part in out[1:]:
        nodes = nodes.unionByName(part)
    shown = lambda c: F.when(F.col(c) != _NONE, F.col(c)).alias(c)
    return nodes.select(shown("conv_id"), "depth", shown("parent_conv_id"), *_COLUMNS[3:])
