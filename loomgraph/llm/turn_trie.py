"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Two prefixes are one node when the sums of their turns' hashes (128 bits, each
turn hashed with its place) and their depth agree; that every node has a single parent and a single last turn (by 120 bits of its
sha256) is checked on all nodes, so that equal nodes are equal sequences. Sums make a prefix a running total, which a very long
conversation computes in many tasks.

Each node has an arc in and an arc out. Children follow each other by their smallest member; every arc knows the next one: into the
first child, or out again; from there into the next child of the parent, or out of the parent. The list of all arcs is ranked
distributedly: in each round an independent third of the arcs (those whose hash is above both neighbours') is spliced out, until the
rest fits a bounded base case, and the spliced ones get their places back in reverse order. Work is in proportion to the arcs, and
rounds to their logarithm. Along the ranked arcs, running sums of leaves and savings give each subtree's figures: the sum on the way
out less the sum before the way in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import frozen, partitions, prefix_sums

#: Conversations of a hundred share its first turns; how many is the checksum of their number modulo HEADS.
HUNDRED, HEADS = 100, 6
#: Arcs that are ranked in one task; arcs of a stretch of running sums; numbers joined to one string before they are hashed.
BASE, STRETCH, IDS = 50_000, 50_000, 8_192
KEY = ["depth", "s1", "s2", "s3", "s4"]


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, depth, t1, t2, chars): every turn's place in its conversation, the digest of role and text, the code points of its text.

    Order is by turn (null first), ties by role and text; repeated rows stay. A null role or text is empty. Rows without a
    conversation number belong to no conversation and are left out. Other columns are not read.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    number = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = rows.withColumn("digest", digest).withColumns({"t1": number(1), "t2": number(16), "chars": F.length("text").cast("long")})
    return prefix_sums(rows, "c", [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], {"depth": F.lit(1)}, ["t1", "t2", "chars"])


def numbers(own: DataFrame) -> DataFrame:
    """(c, h, b) of every conversation: how many turns it takes from the first of its hundred, and which that is."""
    c = F.col("c")
    return own.select("c").distinct().select("c", (F.crc32(c.cast("string").cast("binary")) % HEADS).alias("h"), (c - c % HUNDRED).alias("b"))


def rebuilt(own: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, depth, t1, t2, chars) after every conversation's first h turns are replaced by those of conversation b, at most HEADS - 1."""
    head = own.where((F.col("c") % HUNDRED == 0) & (F.col("depth") < HEADS)).select(F.col("c").alias("b"), "depth", "t1", "t2", "chars")
    taken = convs.join(head, "b").where("depth <= h").select("c", "depth", "t1", "t2", "chars")
    # own turns move to the left where conversation b has fewer than h
    short = convs.join(head.groupBy("b").agg(F.max("depth").alias("most")), "b", "left").select("c", "h", (F.col("h") - F.least("h", F.coalesce("most", F.lit(0)))).alias("shift"))
    kept = own.join(short, "c").where("depth > h").select("c", (F.col("depth") - F.col("shift")).alias("depth"), "t1", "t2", "chars")
    return taken.unionByName(kept)


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, depth, s1..s4, p1..p4, t1, t2, chars): the key of every prefix of every conversation, and that of the prefix one shorter."""
    both = [F.xxhash64(F.lit(seed), "depth", "t1", "t2") for seed in (1, 2)]
    halves = {f"o{2 * k + j + 1}": F.shiftrightunsigned(both[k], 32 * j).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(2) for j in range(2)}
    rows = turns.withColumns(halves)
    sums = prefix_sums(rows, "c", [F.col("depth")], {f"s{k}": F.col(f"o{k}") for k in range(1, 5)}, ["depth", "t1", "t2", "chars", "o1", "o2", "o3", "o4"])
    return sums.withColumns({f"p{k}": F.col(f"s{k}") - F.col(f"o{k}") for k in range(1, 5)}).drop("o1", "o2", "o3", "o4")


def nodes_of(pre: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, KEY, conv_id, n_convs, chars, parent, parent_conv_id), the root included; `node` is an arbitrary number."""
    last = F.struct("t1", "t2", "p1", "p2", "p3", "p4")
    same = pre.groupBy(*KEY).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min(last).alias("low"), F.max(last).alias("high"))
    checked = F.when(F.col("low") == F.col("high"), F.col("chars")).otherwise(F.raise_error(F.lit("two sequences of turns share a key")).cast("long"))
    none = [F.lit(0).cast("long")] * 4
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), *[z.alias(f"p{k}") for k, z in enumerate(none, 1)])
    found = same.select(*[F.col(k).cast("long").alias(k) for k in KEY], "conv_id", "n_convs", checked.alias("chars"), *[F.col(f"low.p{k}").alias(f"p{k}") for k in range(1, 5)]).unionByName(root)
    found = frozen(found.withColumn("node", F.monotonically_increasing_id()), "nodes")
    up = found.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), *[F.col(f"s{k}").alias(f"p{k}") for k in range(1, 5)])
    link = ["depth", "p1", "p2", "p3", "p4"]
    top = up.where("depth = 1").first()  # the root, one row
    first = found.where("depth = 1").withColumns({n: F.lit(top[n] if top else None).cast("long") for n in ("parent", "parent_conv_id")})
    deeper = found.where("depth > 1").join(up.where("depth > 1"), link)
    alone = found.where("depth = 0").withColumns({"parent": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    columns = ["node", *KEY, "conv_id", "n_convs", "chars", "parent", "parent_conv_id"]
    return frozen(alone.select(*columns).unionByName(first.select(*columns)).unionByName(deeper.select(*columns)), "trie")


def followers(nodes: DataFrame) -> DataFrame:
    """(node, parent, sibling): the next child of the same parent, by smallest member; null for the last one.

    Children are dealt out by ranges of parent and member, so that a node with very many children spans many tasks; the last row of a
    range looks at the first one of the next (a row per range).
    """
    below = nodes.where("parent is not null").select("parent", "conv_id", "node")
    ranged = frozen(below.repartitionByRange(partitions(nodes.sparkSession), "parent", "conv_id").withColumn("range", F.spark_partition_id()), "siblings")
    inside = Window.partitionBy("range", "parent").orderBy("conv_id")
    firsts = ranged.groupBy("range").agg(F.min(F.struct("parent", "conv_id", "node")).alias("f"))
    after = firsts.select("range", F.lead("f").over(Window.orderBy("range")).alias("f")).where("f is not null")
    rows = ranged.withColumn("near", F.lead("node").over(inside)).join(F.broadcast(after), "range", "left")
    return rows.select("node", "parent", F.coalesce("near", F.when(F.col("f.parent") == F.col("parent"), F.col("f.node"))).alias("sibling"))


def tour(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """(id, next) of the list of all arcs: node n is entered by arc 2n and left by arc 2n + 1; the root's way out is the last."""
    rows = nodes.select("node").join(children.select(F.col("parent").alias("node"), "first"), "node", "left").join(followers(nodes), "node", "left")
    into = rows.select((F.col("node") * 2).alias("id"), F.coalesce(F.col("first") * 2, F.col("node") * 2 + 1).alias("next"))
    out = rows.select((F.col("node") * 2 + 1).alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"))
    return into.unionByName(out)


def ranked(links: DataFrame, base: int = BASE) -> DataFrame:
    """(id, pos): places, from 0, in the list whose rows (id, next) know their follower only; `next` of the last is null."""
    void = F.lit(None).cast("long")
    both = links.select("id", "next", void.alias("prev")).unionByName(links.where("next is not null").select(F.col("next").alias("id"), void.alias("next"), F.col("id").alias("prev")))
    rows = frozen(both.groupBy("id").agg(F.max("next").alias("next"), F.max("prev").alias("prev")).withColumn("gap", F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long")), "list")
    spliced: list[DataFrame] = []
    while rows.count() > base:
        rank = lambda c, n=len(spliced): F.xxhash64(F.lit(n), F.col(c))
        goes = F.col("prev").isNotNull() & (rank("id") > rank("prev")) & (F.col("next").isNull() | (rank("id") > rank("next")))
        marked = frozen(rows.withColumn("goes", goes), "marked")
        gone, stays = marked.where("goes").drop("goes"), marked.where("not goes").drop("goes")
        own = stays.withColumns({"told": F.lit(False), "after": void, "before": void, "more": F.lit(0).cast("long")})
        back = gone.select(F.col("prev").alias("id"), F.lit(True).alias("told"), F.col("next").alias("after"))
        ahead = gone.where("next is not null").select(F.col("next").alias("id"), F.col("prev").alias("before"), F.col("gap").alias("more"))
        merged = own.unionByName(back, allowMissingColumns=True).unionByName(ahead, allowMissingColumns=True).groupBy("id").agg(
            F.when(F.max("told"), F.max("after")).otherwise(F.max("next")).alias("next"), F.coalesce(F.max("before"), F.max("prev")).alias("prev"), (F.max("gap") + F.coalesce(F.sum("more"), F.lit(0))).alias("gap"))
        rows = frozen(merged, "list")
        spliced.append(gone)

    def walk(table: pa.Table) -> pa.Table:
        ids, after, gap = table.column("id").to_numpy(), table.column("next").to_pylist(), dict(zip(table.column("id").to_pylist(), table.column("gap").to_pylist(), strict=True))
        follow = dict(zip(ids.tolist(), after, strict=True))
        at, pos, found = next(iter(set(follow) - set(after)), None), 0, []
        while at is not None:
            pos += gap[at]
            found.append((at, pos))
            at = follow[at]
        return pa.table({"id": pa.array([i for i, _ in found], pa.int64()), "pos": pa.array([p for _, p in found], pa.int64())})

    places = frozen(rows.groupBy(F.lit(0).alias("one")).applyInArrow(walk, "id long, pos long"), "places")
    for gone in reversed(spliced):
        back = gone.join(places.select(F.col("id").alias("prev"), "pos"), "prev").select("id", (F.col("pos") + F.col("gap")).alias("pos"))
        places = frozen(places.unionByName(back), "places")
    return places


def subtrees(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) from running sums over arcs; `nodes` has (node, leaf, saved)."""
    arcs = places.select(F.shiftright("id", 1).alias("node"), (F.col("id") % 2 == 0).alias("enters"), "pos", F.floor(F.col("pos") / STRETCH).alias("stretch"))
    values = arcs.join(nodes, "node").withColumns({n: F.when(F.col("enters"), F.col(n)).otherwise(0) for n in ("leaf", "saved")})
    values = frozen(values, "arcs")
    inside = Window.partitionBy("stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    before = values.groupBy("stretch").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).select("stretch", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_before") for n in ("leaf", "saved")])
    sums = values.withColumns({f"{n}_sum": F.sum(n).over(inside) for n in ("leaf", "saved")}).join(before, "stretch")
    total = lambda n: F.sum((F.col(f"{n}_before") + F.col(f"{n}_sum") - F.col(n)) * F.when(F.col("enters"), -1).otherwise(1))
    return sums.groupBy("node").agg(total("leaf").alias("n_leaves"), total("saved").alias("saved_tokens"))


def ends(pre: DataFrame, convs: DataFrame) -> DataFrame:
    """(KEY, ends_sha256): the digest of the conversations that end in a node.

    Numbers are sorted and joined to strings of at most IDS numbers in ranges of (node, number); only these strings of one node meet in
    a task, where they are hashed one after the other, as the digest asks for.
    """
    spark = pre.sparkSession
    whole = pre.groupBy("c").agg(F.max(F.struct(*KEY)).alias("k")).select("c", "k.*")
    zero = convs.select("c").join(whole.select("c"), "c", "left_anti").select("c", *[F.lit(0).cast("long").alias(k) for k in KEY])
    rows = whole.select("c", *[F.col(k).cast("long").alias(k) for k in KEY]).unionByName(zero)
    schema = ", ".join(f"{k} long" for k in KEY)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in KEY])
            c = batch.column("c").to_pylist()
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            starts = [a for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(c)], strict=True) for a in range(x, y, IDS)]
            stops = [*starts[1:], len(c)]
            yield pa.RecordBatch.from_arrays([*[pa.array(keys[k][starts]) for k in range(len(KEY))], pa.array([c[a] for a in starts]), pa.array([",".join(map(str, c[a:b])) for a, b in zip(starts, stops, strict=True)])], [*KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch.column(k).to_pylist() for k in KEY], batch.column("ids").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows_of(done)
        if now is not None:
            yield rows_of([(*now, state.hexdigest())])

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([d[k] for d in done], pa.int64()) for k in range(len(KEY))], pa.array([d[-1] for d in done], pa.string())], [*KEY, "ends_sha256"])

    many = partitions(spark)
    strings = rows.repartitionByRange(many, *KEY, "c").sortWithinPartitions(*KEY, "c").mapInArrow(join, f"{schema}, first long, ids string")
    return strings.repartition(many, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, f"{schema}, ends_sha256 string")


def trie(turns: DataFrame, base: int = BASE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node; nothing for an empty table."""
    own = frozen(ordered(turns), "turns")
    convs = frozen(numbers(own), "conversations")
    pre = frozen(prefixes(rebuilt(own, convs)), "prefixes")
    nodes = nodes_of(pre, convs)
    children = frozen(nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"), F.min(F.struct("conv_id", "node"))["node"].alias("first")), "children")
    places = ranked(tour(nodes, children), base)
    figures = nodes.join(children.select(F.col("parent").alias("node"), "n_children"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    figures = frozen(figures.withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "figures")
    sums = subtrees(places, figures.select("node", "leaf", "saved"))
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    whole = figures.join(sums, "node").join(ends(pre, convs), KEY, "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


_BYTES = "list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)"
_CRC = "xor(4294967295, list_reduce(list_transform(range(8 * len(bytes)), lambda i: (bytes[i // 8 + 1] >> (i % 8)) & 1), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT))"
SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, {_CRC} % {HEADS} AS h, c - c % {HUNDRED} AS b FROM (SELECT c, {_BYTES} AS bytes FROM (SELECT DISTINCT c FROM t))
), r AS (
  SELECT v.c, 0 AS part, t.pos, t.role, t.text FROM convs v JOIN t ON t.c = v.b AND t.pos <= v.h
  UNION ALL SELECT v.c, 1, t.pos, t.role, t.text FROM convs v JOIN t ON t.c = v.c AND t.pos > v.h
), seqs AS (
  SELECT v.c, coalesce(s.seq, []) AS seq, coalesce(s.chars, []) AS chars FROM convs v LEFT JOIN (
    SELECT c, list(sha256(length(role) || ':' || role || text) ORDER BY part, pos) AS seq, list(length(text) ORDER BY part, pos) AS chars FROM r GROUP BY c) s USING (c)
), pre AS (
  SELECT c, seq[1:d] AS p, d, len(seq) = d AS ends, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS size FROM seqs, unnest(range(0, len(seq) + 1)) u(d)
), nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM pre GROUP BY p, d
), kids AS (SELECT p[1:d-1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT n.p[1:k] AS p, sum(n.saved) AS saved_tokens, count(*) FILTER (kids.n IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN kids ON kids.p = n.p, unnest(range(0, n.d + 1)) u(k) GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, below.n_leaves, below.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below ON below.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN nodes up ON n.d > 0 AND up.p = n.p[1:n.d-1]"""
