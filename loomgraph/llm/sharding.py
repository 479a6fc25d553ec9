"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard, each by weighted draws of a document's id.

At every level each child draws -ln(u) / weight, where u in (0, 1) comes from the md5 of seed, child and document id, and the smallest
draw wins. A child's draw depends on nothing but its own name and weight, so a changed weight moves rows only between that child
and the others beside it; subtrees whose weights stay keep the order of their draws.

A shard that is added later belongs to a later generation. Children of different generations are different children, even where
they share a region or rack: the new one draws with its own weight alone, and the older ones keep theirs. So one more shard takes
its share of rows from all others, and no row moves between older shards (law `key`: document id and tree decide). Spark
expressions only: the tree is a constant of the plan, and a row costs one draw per child on its way down.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import frozen, shared_path

SEED = "loom"
#: Regions, racks of a region and shards of a rack of the tree that `grid` builds.
REGIONS, RACKS, SHARDS = 2, 2, 4
#: Rows of a bucket within which slots are numbered; repeated rows that one task writes out.
BUCKET, COPIES = 20_000, 10_000
#: 13 hexadecimal digits: as many bits as a double holds exactly.
DIGITS = 13


class Shard(NamedTuple):
    number: int
    region: str
    rack: str
    weight: float = 1.0
    generation: int = 0


Tree = tuple[Shard, ...]


def grid(regions: int = REGIONS, racks: int = RACKS, shards: int = SHARDS) -> Tree:
    """Shards of weight 1 in equal racks and regions, numbered in that order."""
    return tuple(Shard((g * racks + r) * shards + s, f"g{g}", f"r{r}") for g in range(regions) for r in range(racks) for s in range(shards))


def grown(tree: Tree, region: str = "g0", rack: str = "r0", weight: float = 1.0) -> Tree:
    """The tree with one more shard, of a generation of its own, in the given rack."""
    return (*tree, Shard(1 + max((s.number for s in tree), default=-1), region, rack, weight, 1 + max((s.generation for s in tree), default=-1)))


def path_of(shard: Shard) -> tuple[str, str, str]:
    region = f"{shard.generation}/{shard.region}"
    return region, f"{region}/{shard.rack}", f"{region}/{shard.rack}/{shard.number}"


def levels(tree: Tree) -> list[dict[str, list[tuple[str, float]]]]:
    """For regions, racks and shards: the children (name, weight) of every node above; weights are sums over shards."""
    out: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for shard in tree:
        if shard.weight > 0:
            for depth, (up, name) in enumerate(zip(("", *path_of(shard)), path_of(shard), strict=False)):
                children = out[depth].setdefault(up, {})
                children[name] = children.get(name, 0.0) + shard.weight
    return [{up: list(children.items()) for up, children in level.items()} for level in out]


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def hashed(name: Column, key: Column) -> Column:
    """DIGITS hexadecimal digits as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), name, key)), 1, DIGITS), 16, 10).cast("long")


def draw(name: Column, weight: Column, key: Column) -> Column:
    return -F.ln((hashed(name, key) + 0.5) / float(16**DIGITS)) / weight


def child(children: list[tuple[str, float]], key: Column) -> Column:
    """The name of the child that draws the least."""
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in children])
    return F.array_min(F.transform(listed, lambda c: F.struct(draw(c["name"], c["weight"], key).alias("d"), c["name"].alias("name"))))["name"]


def place(docs: DataFrame, tree: Tree, id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """`docs` with the number of the shard that its id falls to, without a shuffle.

    A null id is a key like any other (all such rows share a shard). Rows that repeat an id share a shard; other columns are not
    read. The columns `out`, `out`_region and `out`_rack are set and replace ones of that name.
    """
    if not any(s.weight > 0 for s in tree):
        raise ValueError("a tree needs a shard of positive weight")
    key, node = key_of(F.col(id_col)), None
    names = [f"{out}_region", f"{out}_rack", out]
    for name, level in zip(names, levels(tree), strict=True):
        picked = None
        for up, children in level.items():
            own = F.lit(children[0][0]) if len(children) == 1 else child(children, key)
            picked = own if node is None else (F if picked is None else picked).when(F.col(node) == up, own)
        docs, node = docs.withColumn(name, picked), name
    return docs.withColumn(out, F.substring_index(F.col(out), "/", -1).cast("int"))


def slots(keys: DataFrame) -> DataFrame:
    """`keys` (doc_id, size, text_crc32, shard, more columns that these decide) with `slot`: 0, 1, ... within every shard, by a hash of the id.

    Rows that are equal are counted first, so that an id with very many rows is one row until its slots are written out. Slots are
    numbered in buckets of the hash; a bucket's first slot is the number of rows in the buckets before it.
    """
    spark = keys.sparkSession
    counted = frozen(keys.groupBy(*keys.columns).agg(F.count("*").alias("n")).withColumn("h", hashed(F.lit("slot"), key_of(F.col("doc_id")))), "sharded")
    most = counted.groupBy("shard").count().agg(F.max("count")).first()[0] or 1
    many = -(-most // BUCKET)
    own = counted.withColumn("bucket", F.floor(F.col("h") / float(16**DIGITS) * many))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = own.groupBy("shard", "bucket").agg(F.sum("n").alias("rows")).select("shard", "bucket", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(inside), F.lit(0))
    at = frozen(own.withColumn("within", first).join(before, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("within")).drop("before", "within", "bucket", "h"), "slots")
    copies = at.where("n > 1").withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES)))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slot", "start")
    copies = copies.withColumn("copy", F.explode(F.sequence("start", F.least(F.col("start") + COPIES, F.col("n")) - 1)))
    return at.where("n = 1").select(*keys.columns, "slot").unionByName(copies.select(*keys.columns, (F.col("slot") + F.col("copy")).alias("slot")))


def assigned(docs: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of `docs`, repeated ones too.

    `size` is the text's UTF-8 bytes and 1; a null text has none and the checksum of no bytes. `grown_shard` is the shard in the tree
    with one more. Under the law `key` the id alone decides, so equal texts of different ids are spread over all shards. An empty
    table gives an empty result.
    """
    tree = tree or grid()
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    both = place(place(keys, tree), grown(tree), out="grown_shard")
    found = slots(both.select("doc_id", "size", "text_crc32", "shard", "grown_shard"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")


def write(docs: DataFrame, path: str | None = None, tree: Tree | None = None, id_col: str = "doc_id", files: int = 8) -> str:
    """Writes whole rows, a folder `shard=k` of at least `files` files for each shard, and returns the path; the rows of one id may lie in several files."""
    path = path or shared_path(docs.sparkSession, "shards")
    placed = place(docs, tree or grid(), id_col).drop("shard_region", "shard_rack")
    placed.repartition("shard", F.pmod(F.monotonically_increasing_id(), F.lit(files))).write.partitionBy("shard").parquet(path)
    return path


def _sql_level(level: dict[str, list[tuple[str, float]]], up: str, name: str) -> str:
    rows = ", ".join(f"('{u}', '{n}', {w})" for u, children in level.items() for n, w in children)
    drawn = f"-ln((('0x' || substr(md5('{SEED}|' || c.name || '|' || d.key), 1, {DIGITS}))::BIGINT + 0.5) / {float(16**DIGITS)}) / c.weight"
    return f"SELECT d.key, arg_min(c.name, {drawn}) AS {name} FROM {up} d JOIN (VALUES {rows}) c(up, name, weight) ON d.{'node' if up == 'ids' else 'name'} = c.up GROUP BY d.key"


def _sql_tree(tree: Tree, name: str) -> str:
    region, rack, shard = levels(tree)
    return f"""{name}_region AS ({_sql_level(region, 'ids', 'name')}), {name}_rack AS ({_sql_level(rack, name + '_region', 'name')}),
{name} AS (SELECT key, split_part(name, '/', 4)::INT AS shard FROM ({_sql_level(shard, name + '_rack', 'name')}))"""


#: A bitwise CRC-32, least bit first, of a list of byte values.
SQL_CRC = "xor(4294967295, list_reduce(list_transform(range(8 * len(bytes)), lambda i: (bytes[i // 8 + 1] >> (i % 8)) & 1), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT))"
SQL_BYTES = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::BIGINT)"
SQL = f"""
WITH sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {SQL_BYTES.format("coalesce(text, '')")} AS bytes, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents
), ids AS (SELECT DISTINCT key, '' AS node FROM sized),
{_sql_tree(grid(), 'own')},
{_sql_tree(grown(grid()), 'more')}
SELECT doc_id, size, text_crc32, 'key' AS law, own.shard, more.shard AS grown_shard,
  row_number() OVER (PARTITION BY own.shard ORDER BY md5('{SEED}|slot|' || key)[1:{DIGITS}], doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM (SELECT doc_id, size, key, {SQL_CRC} AS text_crc32 FROM sized) JOIN own USING (key) JOIN more USING (key)"""
