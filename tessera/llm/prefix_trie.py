"""Operator 11: the prefix trie of conversations, built level by level.

A node is a distinct sequence of first turns, named by its depth and its smallest member.  Per level, the live conversations are grouped by
(parent node, next turn); the smallest conv_id becomes the node's name.  A conversation alone in its node is no longer live: the rest of it is a
chain of nodes of its own, written out at once.  Beyond ``SINGLE`` levels a step takes a band of levels, twice as wide each time up to ``WIDEST``: a level's key is then
the node above the band with the chained digest of the turns since, which says the same as (parent, next turn), and one shuffle serves the band.
Then joins level by level, from the deepest node that two conversations share up to the root, roll up leaves and savings.  Steps grow with the
deepest shared turn, not with the longest conversation.

Turns are digests of 128 bits of (role, text) after one shuffle that puts the rows of a conversation in order; that shuffle deals ranges, so a conversation of any length is cut over tasks.
Groups are counted before they are shuffled, so a turn that a third of all conversations share is one row a task.  The ids that end in a node are hashed in order, as a stream of chunks of digits.

Defined cases: rows without a conv_id take no part; null roles and texts are empty; a null turn comes first; rows of one conversation with one turn are ordered by role, then text, and each is a turn, also if equal;
a conversation may have no turns left after it is rebuilt and then ends in the root; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, work_table
from tessera.operators.numbering import numbered

SINGLE, WIDEST = 8, 256
CHUNK = 8192
OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_in_order(rows: DataFrame) -> DataFrame:
    """(c, p, turn digest, words) of the original conversations; p from 1."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    flat = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"), role.alias("r"), text.alias("x"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length("r").cast("string"), F.lit(":"), F.col("r"), F.col("x")), 256)), 1, 16)
    return numbered(flat.withColumns({"dig": digest, "words": F.regexp_count("x", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")}), ["c"], ["t", "r", "x"], ["dig", "words"], "p")


def rebuilt(rows: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(c, total) of every conversation and (c, d, dig, words, last) of its turns after its head is that of the first of its group."""
    own = turns_in_order(rows)
    size = work_table(own.groupBy("c").agg(F.max("p").alias("n")), "conversation-sizes")
    base = F.col("c") - F.col("c") % group
    head = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    of = size.select(F.col("c").alias("b"), F.col("n").alias("nb"))
    convs = size.select("c", "n", base.alias("b"), head.alias("h")).join(of, "b", "left").withColumn("k", F.least("h", F.coalesce("nb", F.lit(0))))
    convs = work_table(convs.select("c", "b", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversation-heads")
    first = own.where(F.col("p") < heads).select(F.col("c").alias("b"), F.col("p").alias("d"), "dig", "words")
    lead = convs.join(first, "b").where("d <= h").select("c", "d", "dig", "words", "total")
    rest = own.join(convs.select("c", "h", "k", "total"), "c").where("p > h").select("c", (F.col("p") - F.col("h") + F.col("k")).alias("d"), "dig", "words", "total")
    turns = lead.unionByName(rest).select("c", "d", "dig", "words", (F.col("d") == F.col("total")).alias("last"))
    return convs.select("c", "total"), turns


def keyed(rows: DataFrame, width: int) -> DataFrame:
    """(c, node, d, words, last, key, above): the key of a turn's node below ``node``, and of the node before it (null at the band's first level)."""
    if width == 1:
        return rows.select("c", "node", "d", "words", "last", F.col("dig").alias("key"), F.lit(None).cast("binary").alias("above"))
    band = rows.groupBy("c", "node").agg(F.sort_array(F.collect_list(F.struct("d", "dig", "words", "last"))).alias("t"))
    upto = lambda i: F.unhex(F.md5(F.aggregate(F.slice("t", F.lit(1), i), F.lit(b"").cast("binary"), lambda s, e: F.concat(s, e["dig"]))))
    step = F.transform("t", lambda e, i: F.struct(e["d"].alias("d"), e["words"].alias("words"), e["last"].alias("last"), upto(i + 1).alias("key"), F.when(i > 0, upto(i)).alias("above")))
    return band.select("c", "node", F.explode(step).alias("s")).select("c", "node", "s.*")


def grouped(rows: DataFrame) -> DataFrame:
    """Nodes (node above the band, d, key, conv_id, parent_conv_id, n_convs, words, last) of keyed turns."""
    return rows.groupBy("node", "d", "key").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("above").alias("above"), F.max("last").alias("last"))


def with_parents(nodes: DataFrame, width: int) -> DataFrame:
    if width == 1:
        return nodes.withColumn("parent_conv_id", F.col("node"))
    over = nodes.select("node", (F.col("d") + 1).alias("d"), F.col("key").alias("above"), F.col("conv_id").alias("over"))
    return nodes.join(over, ["node", "d", "above"], "left").withColumn("parent_conv_id", F.coalesce("over", "node")).drop("over")


def ends_hash(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (conv_id, depth, c): ids are put in order over ranges, written as chunks of digits, and the chunks of a node hashed in a stream."""

    def text(batches):
        node, ids = None, []

        def chunk():
            return pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "first": ids[0], "digits": ",".join(map(str, ids))}], schema=shape)

        shape = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("digits", pa.string())])
        for b in batches:
            for m, d, c in zip(*(x.to_pylist() for x in b.columns)):
                if ids and ((m, d) != node or len(ids) == CHUNK):
                    yield chunk()
                    ids = []
                node = (m, d)
                ids.append(c)
        if ids:
            yield chunk()

    def digest(batches):
        node, h = None, None
        for b in batches:
            done = []
            for m, d, s in zip(*(b.column(x).to_pylist() for x in (0, 1, 3))):
                if (m, d) == node:
                    h.update(b"," + s.encode())
                else:
                    done += [(*node, h.hexdigest())] if node else []
                    node, h = (m, d), hashlib.sha256(s.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, h.hexdigest())], ["conv_id", "depth", "ends_sha256"])

    sorted_ids = ends.select("conv_id", "depth", "c").repartitionByRange("conv_id", "depth", "c").sortWithinPartitions("conv_id", "depth", "c")
    chunks = sorted_ids.mapInArrow(text, "conv_id long, depth long, first long, digits string")
    return chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row of ``OUT`` for each node of the trie of the rebuilt conversations."""
    spark = rows.sparkSession
    small_batches(spark)
    convs, turns = rebuilt(rows)
    root, n = convs.agg(F.min("c"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], OUT)
    return built(convs, turns, root, n)


def built(convs: DataFrame, turns: DataFrame, root: int, n: int) -> DataFrame:
    """The trie of ``n`` conversations: level steps while some node below has two members, then the roll-up."""
    spark = convs.sparkSession
    alone = convs.agg(F.bool_and(F.col("total") == 0)).first()[0]
    top = spark.createDataFrame([(root, 0, None, n, 0, alone)], "conv_id long, depth long, parent_conv_id long, n_convs long, words long, last boolean")
    nodes, tails = [top], []
    ends = [convs.where("total = 0").select(F.lit(root).alias("conv_id"), F.lit(0).cast("long").alias("depth"), "c")]
    live = work_table(turns.withColumns({"node": F.lit(root).cast("long"), "alone": F.lit(n == 1)}), "trie-turns")
    done, deepest, name = 0, 0 if n > 1 else -1, uuid.uuid4().hex[:8]
    tails.append(live.where("alone"))
    live = live.where("not alone")
    while not live.isEmpty():
        width = 1 if done < SINGLE else min(done, WIDEST)
        last_level = done + width
        band = keyed(live.where(F.col("d") <= last_level), width)
        found = work_table(with_parents(grouped(band), width), f"trie-{name}-nodes")
        nodes.append(found.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "words", "last"))
        deepest = max(deepest, found.where("n_convs > 1").agg(F.max("d")).first()[0] or 0)
        place = found.select("node", "d", "key", "conv_id", "n_convs")
        met = band.join(place, ["node", "d", "key"])
        ends.append(met.where("last and n_convs > 1").select("conv_id", F.col("d").alias("depth"), "c"))
        at = met.where(F.col("d") == last_level).where("not last").select("c", F.col("conv_id").alias("__node"), (F.col("n_convs") == 1).alias("__alone"))
        rest = live.where(F.col("d") > last_level).drop("node", "alone").join(at, "c").withColumnsRenamed({"__node": "node", "__alone": "alone"})
        rest = work_table(rest, f"trie-{name}-turns")
        tails.append(rest.where("alone"))
        live = rest.where("not alone")
        done = last_level
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return finished(work_table(union(nodes), f"trie-{name}-all"), union(tails), ends_hash(union(ends)), deepest)


def finished(nodes: DataFrame, tails: DataFrame, ends: DataFrame, deepest: int) -> DataFrame:
    """Roll up level by level; nodes of one member and the chains below them need no roll-up."""
    parts, below = [], None
    single = nodes.where("n_convs = 1")
    for d in range(deepest, -1, -1):
        kids = single.where(F.col("depth") == d + 1).select("parent_conv_id", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        if below is not None:
            kids = kids.unionByName(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        kids = kids.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_below"))
        level = nodes.where((F.col("n_convs") > 1) & (F.col("depth") == d)).select("conv_id", "depth", "parent_conv_id", "n_convs", "words").join(kids, "conv_id", "left")
        level = level.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
                             ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"))
        below = work_table(level, "trie-level")
        parts.append(below)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone_hash = lambda: F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NOTHING)
    chain = tails.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("c").alias("parent_conv_id"), "last")
    out = single.select("conv_id", "depth", "parent_conv_id", "last").unionByName(chain)
    out = out.select("conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), alone_hash().alias("ends_sha256"))
    if parts:
        shared = parts[0]
        for p in parts[1:]:
            shared = shared.unionByName(p)
        shared = shared.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
        out = out.unionByName(shared)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


#: The checksum of a conversation's id picks its head: bitwise CRC-32 over the id's digits.
SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 4 AS h FROM o),
n AS (SELECT c, count(*) AS n FROM o GROUP BY c),
k AS (SELECT ids.c, h, ids.c - ids.c % 20 AS b, least(h, coalesce(n.n, 0)) AS k FROM ids LEFT JOIN n ON n.c = ids.c - ids.c % 20),
t AS (SELECT k.c, o.p AS d, r, x FROM k JOIN o ON o.c = k.b AND o.p <= k.h UNION ALL SELECT k.c, o.p - h + k.k, r, x FROM k JOIN o ON o.c = k.c AND o.p > h),
l AS (SELECT k.c, coalesce(max(d), 0) AS total FROM k LEFT JOIN t USING (c) GROUP BY k.c),
m AS (SELECT c, 0::BIGINT AS d, 0::BIGINT AS words, min(c) OVER () AS node, NULL::BIGINT AS parent FROM l
  UNION ALL
  SELECT t.c, t.d, len(regexp_extract_all(t.x, '[^\x20\x09-\x0D]+')), min(t.c) OVER (PARTITION BY m.node, t.r, t.x), m.node FROM m JOIN t ON t.c = m.c AND t.d = m.d + 1),
g AS (SELECT m.node, m.d, min(m.parent) AS parent, count(*) AS n, min(m.words) AS words, count(*) FILTER (WHERE l.total = m.d) AS ended,
        coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (WHERE l.total = m.d), '') AS ends FROM m JOIN l USING (c) GROUP BY m.node, m.d),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS kids FROM g WHERE d > 0 GROUP BY ALL),
f AS (SELECT g.*, coalesce(kids, 0) AS kids, (n - 1) * words AS saved FROM g LEFT JOIN kids USING (node, d)),
up AS (SELECT node AS tn, d AS td, parent AS an, d - 1 AS ad FROM f WHERE d > 0 UNION ALL SELECT up.tn, up.td, f.parent, f.d - 1 FROM up JOIN f ON f.node = up.an AND f.d = up.ad WHERE f.d > 0),
every AS (SELECT node AS tn, d AS td, node AS an, d AS ad FROM f UNION ALL SELECT * FROM up),
s AS (SELECT an AS node, ad AS d, count(*) FILTER (WHERE f.kids = 0) AS leaves, sum(f.saved)::BIGINT AS saved FROM every JOIN f ON f.node = every.tn AND f.d = every.td GROUP BY an, ad)
SELECT f.node AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(f.ends) AS ends_sha256 FROM f JOIN s USING (node, d)
"""
