"""Prefix trie of conversations, from the sorted order alone.

Conversations, as sequences of turns, are sorted; ``lcp[i]`` is the number of leading
turns that row i shares with row i - 1.  The conversations that begin with row i's
first d turns are an interval of the order: it reaches as far to either side as the
least lcp stays at d or more.  Every candidate prefix (i, d) finds its two ends by a
binary search of its own over a sparse table of lcp minima, so there is no stack and
no order of work.  Candidates whose left end is their own row are the trie's nodes.
A node's numbers are sums and minima over its interval:

* members: its length; conv_id: a range minimum;
* children: rows inside with lcp = d and more than d turns, and the first row's own next turn;
* leaves: rows that the next row does not extend;
* saved bytes: per row after the first, the turns from depth d on that it shares with
  the row before.

The order is cut into blocks of about ``BLOCK_TURNS`` turns (at most ``MAX_BLOCKS`` of
them), each with the rows on both sides of it.  A block finishes all nodes inside it.  A
node that crosses a border is one partial row per block, under the name (block in which
it begins, depth), which a second sparse table, over the blocks' lcp minima, finds by
binary search; partial rows of a name are summed.

A turn is the first 16 bytes of the SHA-256 of its role and text: texts do not travel.
A conversation is one row of 24 bytes a turn, so its digests must fit a row (80 million
turns); texts of any length do.  Copies of a conversation are rows of their own, ordered by id;
the list of ids that ``ends_sha256`` covers is one stream by definition, and is hashed as
such, batch by batch, in one task for each node that crosses a border.

Nulls: rows with a null conversation id belong to none and are left out; a null turn
comes first, a null role or text is empty.  Turns that tie are ordered by digest.  Repeated
rows are turns of their own.  An empty table has no nodes, a root neither.  Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

DIGEST = 16
BLOCK_TURNS = 4096
MAX_BLOCKS = 1 << 18
CLOSED, OPEN, END, SUMMARY = range(4)
# of a node's parent: none, inside the block, open and begun here, open from an earlier block
NO_PARENT, PARENT_INSIDE, PARENT_BEGINS, PARENT_CONTINUES = range(4)
FAR = np.iinfo(np.int32).max

PARTS = ("kind int, block long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, continues boolean, parent int, parent_conv_id long, border long, inner long")


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, turns array<struct<turn, digest, bytes>>), one row per conversation, in turn order."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(convs: DataFrame, group: int = 5, longest: int = 8) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % group, then its
    own after its first h; h = crc32(decimal c) % (longest + 1)."""
    convs = stage(convs, "trie-conversations")
    c = F.col("conv")
    h = (F.crc32(c.cast("string").cast("binary")) % (longest + 1)).cast("int")
    heads = convs.where(c % group == 0).select(c.alias("head_of"), F.slice("turns", 1, longest).alias("head"))
    met = convs.select("conv", "turns", h.alias("h"), (c - c % group).alias("head_of")).join(heads, "head_of", "left")
    head = F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(turns, 1, 0)"))
    return met.select("conv", F.concat(head, F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")).alias("turns"))


# --- the order, in blocks ------------------------------------------------------------------

def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, path, sizes) with their partition, row number and the turns before them."""
    part, row, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        weight = np.asarray(pc.binary_length(batch.column("path"))).astype(np.int64) // DIGEST + 1
        ends = before + np.cumsum(weight)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(row, row + n)), pa.array(ends - weight), pa.array(weight)],
            [*batch.schema.names, "part", "row", "before", "weight"])
        row, before = row + n, int(ends[-1]) if n else before


def _in_blocks(convs: DataFrame, block_turns: int, max_blocks: int) -> tuple[DataFrame, int]:
    """The sorted rows (conv, path, sizes, pos, block, home): a block's first and last row
    also have a copy whose home is the block before or after.  Row counts per partition
    and per block are all that reaches the driver."""
    spark = convs.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path")
    rows = stage(convs.select("conv", path, F.transform("turns", lambda t: t["bytes"]).alias("sizes")), "trie-rebuilt")
    ordered = rows.repartitionByRange("path", "conv").sortWithinPartitions("path", "conv")
    placed = stage(ordered.mapInArrow(_numbered, "conv long, path binary, sizes array<bigint>, part int, row long, before long, weight long"),
                   "trie-order")
    firsts, n_rows, n_turns = [], 0, 0
    for r in sorted(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()):
        firsts.append((r["part"], n_rows, n_turns))
        n_rows, n_turns = n_rows + r["n"], n_turns + r["w"]
    turns = max(block_turns, -(-n_turns // max_blocks))
    starts = spark.createDataFrame(firsts, "part int, rows_before long, turns_before long")
    at = placed.join(F.broadcast(starts), "part").select(
        "conv", "path", "sizes", (F.col("row") + F.col("rows_before")).alias("pos"),
        F.floor((F.col("before") + F.col("turns_before")) / turns).cast("long").alias("number"))
    cuts = sorted(at.groupBy("number").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).collect())
    blocks = spark.createDataFrame([(r["number"], i, r["first"], r["last"]) for i, r in enumerate(cuts)],
                                   "number long, block long, first long, last long")
    last = len(cuts) - 1
    homes = F.array("block", F.when((F.col("pos") == F.col("first")) & (F.col("block") > 0), F.col("block") - 1),
                    F.when((F.col("pos") == F.col("last")) & (F.col("block") < last), F.col("block") + 1))
    homed = at.join(F.broadcast(blocks), "number").withColumn("home", F.explode(F.array_compact(homes)))
    return homed.select("conv", "path", "sizes", "pos", "block", "home"), len(cuts)


# --- range minima ------------------------------------------------------------------------

class Minima:
    """Sparse table: minima over all runs of 2^j values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (1 << len(self.levels) - 1) <= len(values):
            half = self.levels[-1]
            step = 1 << len(self.levels) - 1
            self.levels.append(np.minimum(half[:-step], half[step:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of the values lo..hi, both included."""
        j = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for level in np.unique(j):
            m = j == level
            values = self.levels[level]
            out[m] = np.minimum(values[lo[m]], values[hi[m] - (1 << int(level)) + 1])
        return out

    def left_end(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest l with values l+1..at all ``least`` or more, by halving steps."""
        at = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            step = 1 << j
            go = np.flatnonzero(at - step >= 0)
            go = go[self.levels[j][at[go] - step + 1] >= least[go]]
            at[go] -= step
        return at

    def right_end(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Largest r with values at+1..r all ``least`` or more."""
        at, n = at.copy(), len(self.levels[0])
        for j in range(len(self.levels) - 1, -1, -1):
            step = 1 << j
            go = np.flatnonzero(at + step < n)
            go = go[self.levels[j][at[go] + 1] >= least[go]]
            at[go] += step
        return at


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for ``sizes[i]`` values each, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def shared_turns(digests: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Leading turns that each row (from the second) shares with the row before it."""
    least = np.minimum(lengths[:-1], lengths[1:])
    out = least.copy()
    some = np.flatnonzero(least)
    if len(some):
        n = least[some]
        a, b = _ragged(starts[some], n), _ragged(starts[some + 1], n)
        place = _ragged(np.zeros(len(some), np.int64), n)
        differs = np.where((digests[a] != digests[b]).any(axis=1), place, FAR)
        out[some] = np.minimum(n, np.minimum.reduceat(differs, np.cumsum(n) - n))
    return out


def _block(table: pa.Table) -> pa.Table:
    """One block's nodes, whole or partial, the ends of its open nodes and its lcp minima."""
    home = table.column("home")[0].as_py()
    table = table.sort_by("pos")
    block = np.asarray(table.column("block"))
    lengths = np.asarray(pc.binary_length(table.column("path"))).astype(np.int64) // DIGEST
    starts = np.cumsum(lengths) - lengths
    digests = np.frombuffer(b"".join(table.column("path").to_pylist()), np.uint64).reshape(-1, 2)
    shared = shared_turns(digests, starts, lengths)
    own = np.flatnonzero(block == home)
    first, n = int(own[0]), len(own)
    # lcp of each own row with the row before, and of the row after with the last; -1 outside the table
    lcp = np.concatenate([[-1], shared, [-1]])[first:first + n + 1]
    after = int(lcp[n])
    lcp = lcp[:n]
    conv = np.asarray(table.column("conv"))[own].astype(np.int64)
    length, start = lengths[own], starts[own]
    sizes = np.concatenate(table.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False)[None]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])

    def spent(row, depth):
        """Bytes of the first ``depth`` turns of the rows."""
        return total[start[row] + np.maximum(depth, 0)] - total[start[row]]

    row = np.repeat(np.arange(n), length + 1)
    base = np.cumsum(length + 1) - (length + 1)
    depth = _ragged(np.zeros(n, np.int64), length + 1)
    minima, least_conv = Minima(lcp), Minima(conv)
    left, right = minima.left_end(row, depth), minima.right_end(row, depth)
    continues = (left == 0) & (lcp[0] >= depth)
    goes_on = (right == n - 1) & (after >= depth)

    saved = np.where(lcp >= 0, spent(np.arange(n), lcp), 0)
    saved_to = np.concatenate([[0], np.cumsum(saved)])
    leaf_to = np.concatenate([[0], np.cumsum(np.append(lcp[1:], after) < length)])
    children = np.zeros(len(row), np.int64)
    forks = np.flatnonzero((lcp >= 0) & (lcp < length))
    at = base[forks] + lcp[forks]  # the candidate whose node the row adds a child to
    np.add.at(children, base[left[at]] + lcp[forks], 1)
    ends = np.zeros(len(row), np.int64)
    at = base + length
    np.add.at(ends, base[left[at]] + length, 1)

    node = np.flatnonzero(left == row)
    l, r, d = left[node], right[node], depth[node]
    cont = continues[node]
    is_open = cont | goes_on[node]
    rows_after = (r - l) + cont
    out_children = children[node] + np.where(~cont & (length[l] > d), 1, 0)
    out_saved = saved_to[r + 1] - saved_to[l + 1] + np.where(cont, saved[l], 0) - rows_after * spent(l, d - 1)
    parent = np.full(len(node), NO_PARENT)
    parent_conv = np.zeros(len(node), np.int64)
    deep = np.flatnonzero(d > 0)
    up = base[l[deep]] + d[deep] - 1
    parent[deep] = np.where(continues[up], PARENT_CONTINUES, np.where(goes_on[up], PARENT_BEGINS, PARENT_INSIDE))
    parent_conv[deep] = least_conv.between(left[up], right[up])
    empty = hashlib.sha256(b"").hexdigest()
    hashes = [None if o else hashlib.sha256(",".join(map(str, conv[a:a + e].tolist())).encode()).hexdigest() if e else empty
              for o, a, e in zip(is_open.tolist(), l.tolist(), ends[node].tolist(), strict=True)]
    k = len(node)
    nodes = [np.where(is_open, OPEN, CLOSED), np.full(k, home), d, least_conv.between(l, r), r - l + 1, out_children,
             leaf_to[r + 1] - leaf_to[l], out_saved, hashes, cont, parent, parent_conv, None, None]
    at = base + length
    held = np.flatnonzero(continues[at] | goes_on[at])  # rows that end in an open node
    m = len(held)
    tails = [np.full(m, END), np.full(m, home), length[held], conv[held], None, None, None, None, None, continues[at][held], None, None, None, None]
    summary = [np.array([SUMMARY]), np.array([home]), None, np.array([conv.min()]), None, None, None, None, None, None, None, None,
               np.array([lcp[0]]), np.array([lcp[1:].min() if n > 1 else FAR])]
    schema = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[kind])
                        for name, kind in (c.split() for c in PARTS.split(", "))])
    tables = []
    for size, columns in ((k, nodes), (m, tails), (1, summary)):
        tables.append(pa.Table.from_arrays([pa.nulls(size, f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                                           schema=schema))
    return pa.concat_tables(tables)


# --- nodes that cross borders ----------------------------------------------------------------

def _begin(border: np.ndarray, inner: np.ndarray):
    """Block in which the node of a depth begins that runs over a block's left border."""
    whole = Minima(np.minimum(border, inner))  # a block is inside an interval if all its lcp are

    def begin(block: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return whole.left_end(block - 1, depth)

    return begin


def _named(sent):
    """Adds the name of the row's own node (home) and of its open parent (parent_home)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = _begin(*sent.value)
        for batch in batches:
            block, depth = np.asarray(batch.column("block")), np.asarray(batch.column("depth"))
            home = block.copy()
            m = np.flatnonzero(np.asarray(batch.column("continues")))
            home[m] = begin(block[m], depth[m])
            parent = np.asarray(pc.fill_null(batch.column("parent"), NO_PARENT))
            up = block.copy()
            m = np.flatnonzero(parent == PARENT_CONTINUES)
            up[m] = begin(block[m], depth[m] - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(up)], [*batch.schema.names, "home", "parent_home"])

    return run


def _stream_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (home, depth, conv_id) to (home, depth, ends_sha256), batch by batch."""
    key, state, done = None, None, []

    def close():
        if key is not None:
            done.append((*key, state.hexdigest()))

    for batch in batches:
        home, depth = np.asarray(batch.column("home")), np.asarray(batch.column("depth"))
        ids = batch.column("conv_id").to_pylist()
        cuts = [0, *(np.flatnonzero((home[1:] != home[:-1]) | (depth[1:] != depth[:-1])) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            now = (int(home[a]), int(depth[a]))
            if now != key:
                close()
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids[a:b])).encode())
    close()
    columns = list(zip(*done, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                                     ["home", "depth", "ends_sha256"])


NUMBERS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
NODE = ["conv_id", "depth", "parent_conv_id", *NUMBERS, "ends_sha256"]


def trie(convs: DataFrame, block_turns: int = BLOCK_TURNS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per node of the trie over ``convs`` (conv, turns): conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    rows, n_blocks = _in_blocks(convs, block_turns, max_blocks)
    parts = stage(rows.groupBy("home").applyInArrow(_block, PARTS), "trie-parts")
    seen = sorted(parts.where(F.col("kind") == SUMMARY).select("block", "border", "inner", "conv_id").collect())  # a row per block
    whole = parts.where((F.col("kind") == CLOSED) & F.col("parent").isin(NO_PARENT, PARENT_INSIDE))
    whole = whole.withColumn("parent_conv_id", F.when(F.col("parent") == PARENT_INSIDE, F.col("parent_conv_id"))).select(*NODE)
    if n_blocks < 2:
        return whole
    sent = spark.sparkContext.broadcast((np.array([r["border"] for r in seen], np.int64), np.array([r["inner"] for r in seen], np.int64)))
    cross = parts.where(F.col("kind").isin(OPEN, END) | ((F.col("kind") == CLOSED) & (F.col("parent") >= PARENT_BEGINS)))
    named = stage(cross.mapInArrow(_named(sent), f"{PARTS}, home long, parent_home long"), "trie-named")
    ends = (named.where(F.col("kind") == END).select("home", "depth", "conv_id").repartition("home", "depth")
            .sortWithinPartitions("home", "depth", "conv_id").mapInArrow(_stream_hash, "home long, depth long, ends_sha256 string"))
    opened = named.where(F.col("kind") == OPEN).groupBy("home", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in NUMBERS], F.max("parent_home").alias("parent_home"))
    opened = stage(opened.join(ends, ["home", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "trie-open")
    first = min(r["conv_id"] for r in seen)  # the root's smallest member
    below = (named.where(F.col("kind") == CLOSED).select("conv_id", "depth", *NUMBERS, "ends_sha256", "parent_home")
             .unionByName(opened.select("conv_id", "depth", *NUMBERS, "ends_sha256", "parent_home")))
    under_root = below.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first))).select(*NODE)
    parents = opened.select(F.col("home").alias("parent_home"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    deeper = below.where("depth > 1").join(parents, ["parent_home", "depth"]).select(*NODE)
    return whole.unionByName(under_root).unionByName(deeper)


def trie_sql(group: int = 5, longest: int = 8) -> str:
    """All prefixes of all rebuilt conversations, grouped and summed over their ancestors."""
    crc = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
    return f"""WITH own AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST) AS a FROM conversations
  WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {crc} % {longest + 1} AS h FROM own),
made AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.a, 1, c.h), []), list_slice(c.a, c.h + 1, len(c.a))) AS a
  FROM h c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {group}),
pre AS (SELECT conv_id, len(a) AS n, d, list_slice(a, 1, d) AS p FROM (SELECT conv_id, a, unnest(range(0, len(a) + 1)) AS d FROM made)),
node AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM pre GROUP BY d, p),
kids AS (SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, p)),
up AS (
  SELECT e, list_slice(p, 1, e) AS p, n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(p[d][2]) END AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM full_node)),
sums AS (SELECT e AS d, p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_node f JOIN sums USING (d, p) LEFT JOIN node q ON q.d = f.d - 1 AND q.p = list_slice(f.p, 1, f.d - 1)"""
