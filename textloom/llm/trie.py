"""The trie of conversation prefixes, named by prefix doubling.

Equal turns get equal names, whole numbers without gaps. Blocks of 2, 4, 8 ... turns that begin at
multiples of their length are named from the names of their halves, one join for each
doubling. The prefix of d turns is the blocks of d's binary digits, longest first, so it
is named by as many compositions at most as the longest conversation's length has digits.
Prefixes of one length and name are a node.

A node is known by its depth and its smallest member; that conversation's own prefixes are
the node's ancestors, so no search is needed to climb. Sums over subtrees double their reach each
round: from within 2^k turns below a node to within 2^(k+1).

Only names travel, never texts. Copies of a conversation are rows of a sum, and of a
join with one row for each node, which Spark splits; no group is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.textvec import release
from textloom.session import cut, discard, table

#: Turns that a conversation takes from its base at most, and how many ids share a base.
MOST_LEAD = 5
BASE = 100
#: Parts in which distinct keys are numbered; the driver gets one count for each.
PARTS = 1024
#: Turns of a conversation that are ordered together, as a power of two.
RUN_BITS = 8
#: Consecutive ids that become one piece of a node's list, as a power of two.
PIECE_BITS = 9


def lead_of(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_LEAD + 1)).cast("int")


def dense(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``name``: each distinct key with a number from 0, without gaps.

    Keys are dealt to ``PARTS`` parts by a hash and numbered within each; a part starts where the one before ends.
    """
    part = Window.partitionBy("part").orderBy(*keys)
    kinds = rows.select(*keys).distinct().withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)))
    numbered = cut(kinds.withColumn("nth", F.row_number().over(part)))
    before, total = [], 0
    for r in sorted(numbered.groupBy("part").agg(F.max("nth").alias("n")).collect()):
        before.append((r["part"], total))
        total += r["n"]
    starts = rows.sparkSession.createDataFrame(before, "part bigint, before bigint")
    return numbered.join(F.broadcast(starts), "part").select(*keys, (F.col("before") + F.col("nth") - 1).alias("name"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), digest (of role and text), chars (code points of the text), by turn, nulls first, then by digest.

    A conversation's turns are numbered within runs of turn numbers and first bytes of digests,
    and equal rows are counted, so a conversation of any length is no single task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turn = F.coalesce(F.col("turn").cast("bigint"), F.lit(0))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").isNotNull().alias("known"), turn.alias("turn"), digest.alias("digest"), F.length(text).cast("bigint").alias("chars")
    )
    run, byte = F.shiftright("turn", RUN_BITS).alias("run"), F.substring("digest", 1, 1).alias("byte")
    kinds = rows.groupBy("conv", "known", run, "turn", byte, "digest", "chars").agg(F.count(F.lit(1)).alias("n"))

    def before(rows: DataFrame, within: list[str], by: list[str], name: str) -> DataFrame:
        earlier = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    run_of, byte_of = ["conv", "known", "run"], ["conv", "known", "run", "turn", "byte"]
    kinds = cut(before(kinds, byte_of, ["digest"], "in_byte"))
    bytes_ = before(kinds.groupBy(*byte_of).agg(F.sum("n").alias("n")), run_of, ["turn", "byte"], "in_run").drop("n")
    runs = before(kinds.groupBy(*run_of).agg(F.sum("n").alias("n")), ["conv"], ["known", "run"], "in_conv").drop("n")
    placed = kinds.join(bytes_, byte_of).join(runs, run_of)
    first = F.col("in_conv") + F.col("in_run") + F.col("in_byte")
    return placed.select("conv", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("pos"), "digest", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs). turns: conv, pos, name, chars of every rebuilt conversation; convs: conv of every one, also of turnless ones."""
    turns = cut(ordered_turns(conversations))
    own = cut(turns.join(dense(turns, ["digest"]), "digest").select("conv", "pos", "name", "chars"))
    discard(turns)
    lead = lead_of(F.col("conv"))
    bases = cut(own.filter((F.col("conv") % BASE == 0) & (F.col("pos") < MOST_LEAD)).withColumnRenamed("conv", "base"))
    held = bases.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    convs = own.select("conv").distinct().withColumn("base", F.col("conv") - F.col("conv") % BASE).join(held, "base", "left")
    convs = cut(convs.select("conv", "base", F.least(lead, F.coalesce("held", F.lit(0))).alias("lead")))
    led = convs.join(bases, "base").filter("pos < lead").select("conv", "pos", "name", "chars")
    rest = own.filter(F.col("pos") >= lead).join(convs.select("conv", "lead"), "conv")
    rest = rest.select("conv", (F.col("pos") - lead + F.col("lead")).alias("pos"), "name", "chars")
    out = cut(led.unionByName(rest))
    discard(own, bases)
    return out, convs


def named_prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """conv, depth, name, chars: every prefix of every conversation; equal names of a depth are equal prefixes."""
    blocks = [turns.select("conv", F.col("pos").alias("at"), "name")]
    while longest >> len(blocks):
        half = blocks[-1]
        side = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = half.groupBy("conv", F.shiftright("at", 1).alias("at")).agg(side(0).alias("a"), side(1).alias("b"))
        pairs = cut(pairs.filter("b IS NOT NULL"))
        blocks.append(cut(pairs.join(dense(pairs, ["a", "b"]), ["a", "b"]).select("conv", "at", "name")))
        discard(pairs)
    rows = turns.select("conv", (F.col("pos") + 1).alias("depth"), F.lit(None).cast("bigint").alias("name"), "chars")
    for k in reversed(range(len(blocks))):
        upper = F.shiftright("depth", k)  # its last digit says whether block k is part of the prefix
        with_block = rows.filter(upper % 2 == 1).withColumn("at", upper - 1).join(blocks[k].withColumnRenamed("name", "block"), ["conv", "at"])
        whole = with_block.filter("at = 0").select("conv", "depth", F.col("block").alias("name"), "chars")
        parts = cut(with_block.filter("at > 0").select("conv", "depth", "at", F.col("name").alias("start"), "block", "chars"))
        key = ["at", "start", "block"]
        joined = parts.join(dense(parts, key), key).select("conv", "depth", "name", "chars") if longest >> k > 1 else whole.limit(0)
        new = cut(rows.filter(upper % 2 == 0).unionByName(whole).unionByName(joined))
        discard(rows, parts, *blocks[k : k + 1] if k else ())
        rows = new
    return rows


def list_digests(ends: DataFrame) -> DataFrame:
    """depth, rep, ends_sha256 of ``ends`` (depth, rep, conv): the digest of each node's ids in order, joined by commas.

    Ids become pieces of at most 2**PIECE_BITS; a node's pieces stream through one hash, in constant memory.
    """
    piece = F.shiftright("conv", PIECE_BITS).alias("piece")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("depth", "rep", piece).agg(ids.alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for depth, rep, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == (depth, rep):
                    hashed.update(b",")
                else:
                    if node:
                        done.append((*node, hashed.hexdigest()))
                    node, hashed = (depth, rep), hashlib.sha256()
                hashed.update(ids.encode())
            yield _rows(done)
        yield _rows([(*node, hashed.hexdigest())] if node else [])
        release()

    streamed = pieces.repartition("depth", "rep").sortWithinPartitions("depth", "rep", "piece").select("depth", "rep", "ids")
    return streamed.mapInArrow(digests, "depth bigint, rep bigint, ends_sha256 string")


def _rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, rep, digest = zip(*done, strict=True) if done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(rep, pa.int64()), pa.array(digest, pa.string())], names=["depth", "rep", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Null turn: first. Null role or text: empty. Equal turns of a conversation: by a digest of role and text.
    Repeated rows: turns like others. Rows without a conv_id: no part of any conversation.
    Very long texts: named whole. Other columns, of any names, are not looked at. Empty table: no node, no rows.
    """
    turns, convs = rebuilt(conversations)
    n_convs, root = convs.agg(F.count(F.lit(1)), F.min("conv")).first()
    longest = turns.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    spark = turns.sparkSession
    prefixes = named_prefixes(turns, longest)
    nodes = prefixes.groupBy("depth", "name").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("rep"), F.max("chars").alias("chars"))
    nodes = cut(nodes)
    # the node of each conversation at each depth, by its smallest member
    chain = cut(prefixes.join(nodes.select("depth", "name", "rep"), ["depth", "name"]).select("conv", "depth", "rep"))
    discard(turns, prefixes)
    top = spark.createDataFrame([(0, n_convs, root, 0)] if n_convs else [], "depth bigint, n_convs bigint, rep bigint, chars bigint")
    nodes_and_root = nodes.drop("name").unionByName(top)

    def ancestors(rows: DataFrame, up: int) -> DataFrame:
        """``rows`` (depth, rep, ...) at least ``up`` deep, with ``above``: the ancestor's smallest member."""
        at = chain.select(F.col("conv").alias("rep"), (F.col("depth") + up).alias("depth"), F.col("rep").alias("above"))
        found = rows.filter(F.col("depth") >= up).join(at, ["depth", "rep"], "left")
        return found.withColumn("above", F.coalesce("above", F.lit(root).cast("bigint")))

    parents = cut(ancestors(nodes_and_root, 1).select("depth", "rep", F.col("above").alias("parent")))
    children = parents.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("rep")).agg(F.count(F.lit(1)).alias("n_children"))
    base = nodes_and_root.join(children, ["depth", "rep"], "left").join(parents, ["depth", "rep"], "left")
    base = cut(base.withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    sums = cut(base.select("depth", "rep", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")))
    up = 1
    while up <= longest:
        below = ancestors(sums, up).groupBy((F.col("depth") - up).alias("depth"), F.col("above").alias("rep"))
        below = below.agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        new = sums.join(below, ["depth", "rep"], "left").select(
            "depth", "rep", *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_leaves", "leaves"), ("saved_tokens", "saved"))]
        )
        new = cut(new)
        discard(sums)
        sums, up = new, up * 2
    last = F.max_by("rep", "depth")
    ends = chain.groupBy("conv").agg(F.max("depth").alias("depth"), last.alias("rep"))
    ends = convs.select("conv").join(ends, "conv", "left").select("conv", F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.coalesce("rep", F.lit(root)).cast("bigint").alias("rep"))
    digests = list_digests(ends)
    empty = hashlib.sha256(b"").hexdigest()
    out = cut(
        base.join(sums, ["depth", "rep"]).join(digests, ["depth", "rep"], "left").select(
            F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )
    discard(convs, nodes, chain, parents, base, sums)
    return out


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 is written out with its table (the reversed polynomial 0xEDB88320).
OP12_SQL = f"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))||':'||coalesce(role, '')||coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), leads AS (
  SELECT conv_id, turns, (xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {MOST_LEAD + 1})::BIGINT AS h FROM own, crc
), convs AS (
  SELECT l.conv_id, list_concat(coalesce(list_slice(o.turns, 1, h), []), list_slice(l.turns, h + 1, len(l.turns))) AS turns
  FROM leads l LEFT JOIN own o ON o.conv_id = l.conv_id - l.conv_id % {BASE}
), prefixes AS (
  SELECT conv_id, turns, d, sha256(to_json(list_slice(turns, 1, d))::VARCHAR) AS k FROM convs, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)
), nodes AS (
  SELECT d, k, count(*) AS n, min(conv_id) AS rep, max(CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END) AS chars,
    sha256(coalesce(string_agg(CASE WHEN len(turns) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends FROM prefixes GROUP BY d, k
), chain AS (
  SELECT conv_id, d, rep FROM prefixes JOIN nodes USING (d, k)
), parents AS (
  SELECT n.d, n.rep, c.rep AS parent FROM nodes n LEFT JOIN chain c ON c.conv_id = n.rep AND c.d = n.d - 1
), children AS (
  SELECT d - 1 AS d, parent AS rep, count(*) AS n FROM parents WHERE d > 0 GROUP BY ALL
), sums AS (
  SELECT c.d, c.rep, sum((n.n - 1) * n.chars) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes n JOIN chain c ON c.conv_id = n.rep AND c.d <= n.d LEFT JOIN children k ON k.d = n.d AND k.rep = n.rep GROUP BY ALL
)
SELECT n.rep AS conv_id, n.d::BIGINT AS depth, p.parent AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN parents p USING (d, rep) JOIN sums s USING (d, rep) LEFT JOIN children k USING (d, rep)
"""
