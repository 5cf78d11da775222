"""Text-similarity joins, exact, without forming all pairs.

Three similarities (names as the scalar function that defines them):

* ``cosine`` — Jaccard of the lower-cased *character* sets (the name is
  historical; it is not a vector cosine);
* ``jaccard`` — Jaccard of the lower-cased whitespace-word sets;
* ``levenshtein`` — 1 - edit distance / longer length (case-sensitive).

Candidate pairs come from prefix filtering: tokens are ordered globally
rarest-first (document frequency, then token), and a record only indexes its
first few tokens — as many as the threshold allows a qualifying partner to
miss.  Any pair reaching the threshold shares a token inside both prefixes,
so candidates are complete; every candidate is then verified exactly.
Frequent tokens sort last and rarely reach a prefix, which keeps hot tokens
out of the candidates.

Neither texts nor token sets are sent to pairs.  Texts go, with the tokens of
their prefixes, to the groups of records that have a token; pairs are verified
there, and each is reported by the first token it shares.  Token sets are
larger: pairs are found by token hashes alone, few bits of each set drop most
that are not similar, and the sets of those left go once to each group.

For edit similarity the tokens are padded q-grams numbered by occurrence
(q = 2 when the threshold is >= 0.5, else single characters), with prefix
length q·tau + 1 where tau is the largest distance a partner may have.

Before any of this, identical records (same token set, or same text) are
collapsed into one representative with a ``copies`` count, so a group of
copies never expands into all of its pairs; set similarities also apply the
positional bound of the first shared token before verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as tx
from quarry.operators import lexical
from quarry.operators.blocks import block_top_k, order_key
from quarry.operators.slices import ELEMENTS, TEXT_BYTES, parts
from quarry.session import materialize

METHODS = ("cosine", "jaccard", "levenshtein")
# So many of the most frequent tokens, with their counts, go to every task.
FREQUENT = 1 << 19
# So many pairs of a group are verified by one task.
GROUP_PAIRS = 1 << 20
# Bytes of groups that a task works on at once, if no group is larger.
GROUP_BYTES = 1 << 24
# So many records with a token, at most, are a group; more are dealt to groups by two.
GROUP_RECORDS = 1 << 14
# Pairs that are filtered at once.
MET_PAIRS = 1 << 19
# So many keys, at most, tell the records whose tokens are wanted again (a power of two).
SIEVE = 1 << 20
PAD_LEFT, PAD_RIGHT = "\u0001", "\u0002"


def chars(col: Column) -> Column:
    """Code points of a string, in order."""
    return F.regexp_extract_all(col, F.lit("(?s)."), 0)


def char_set(col: Column) -> Column:
    return F.array_distinct(chars(F.lower(col)))


def word_set(col: Column) -> Column:
    return F.array_distinct(tx.split_words(F.lower(col)))


def set_jaccard(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| for arrays of distinct elements (|A ∪ B| = |A| + |B| - |A ∩ B|)."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def text_similarity(a: Column, b: Column, method: str = "cosine") -> Column:
    """Scalar similarity of two text columns (method dispatch)."""
    if method == "cosine":
        return set_jaccard(char_set(a), char_set(b))
    if method == "jaccard":
        return set_jaccard(word_set(a), word_set(b))
    if method == "levenshtein":
        return edit_similarity(a, b)
    raise ValueError(f"no similarity called {method!r}; choose one of {', '.join(METHODS)}")


def _keys(df: DataFrame, id_col: str, text_col: str, method: str) -> DataFrame:
    """(id, key, h0, h1): the exact value two identical records share (the sorted
    distinct token set, or the text itself for edit similarity) and its 128-bit
    hash, which is what groups and joins go by."""
    t = F.col(text_col)
    if method == "cosine":
        key = F.sort_array(char_set(t))
    elif method == "jaccard":
        key = F.sort_array(word_set(t))
    else:
        key = t
    # a record without text has no similarity to anything
    keys = df.where(t.isNotNull()).select(F.col(id_col).alias("id"), key.alias("key"))
    return keys.select("id", "key", F.xxhash64(F.lit(0), "key").alias("h0"), F.xxhash64(F.lit(1), "key").alias("h1"))


def _representatives(keys: DataFrame, method: str) -> DataFrame:
    """One row per distinct key: (id = smallest id, copies, payload, n).

    A combinable aggregate (min, count), so a key shared by a third of all
    rows costs no more than any other key."""
    reps = keys.groupBy("h0", "h1").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("key").alias("key"))
    if method == "levenshtein":
        return reps.select("id", "copies", F.col("key").alias("text"), F.length("key").alias("n"))
    return reps.select("id", "copies", F.col("key").alias("toks"), F.size("key").alias("n"))


def duplicate_groups(df: DataFrame, method: str = "jaccard", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(rep_id, member_id) for every record whose key (token set or text) is
    shared with a smaller id: each copy is linked to its representative,
    never to every other copy.  The representatives are staged, so that the
    join is of two plain shuffles and a hot key is split."""
    keys = _keys(df, id_col, text_col, method).select("id", "h0", "h1")
    reps = materialize(keys.groupBy("h0", "h1").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("_n"))
                       .where(F.col("_n") > 1).drop("_n"), "representatives")
    return (keys.join(reps, ["h0", "h1"]).where(F.col("id") != F.col("rep_id"))
            .select("rep_id", F.col("id").alias("member_id")))


def gram_size(t: float) -> int:
    """Longer q-grams are rarer, but an edit spoils q of them: the higher the threshold, the longer they may be."""
    return 4 if t >= 0.85 else 2 if t >= 0.5 else 1


def _edit_tokens(rec: DataFrame, q: int) -> DataFrame:
    """(id, n, token) with padded q-grams numbered by occurrence."""
    if q == 1:
        grams = F.concat(chars(F.col("text")), F.array(F.lit(PAD_LEFT)))  # a sentinel so empty strings still meet
    else:
        padded = F.concat(F.lit(PAD_LEFT * (q - 1)), F.col("text"), F.lit(PAD_RIGHT * (q - 1)))
        staged = rec.withColumn("_p", padded)
        grams = F.transform(F.sequence(F.lit(1), F.length("_p") - q + 1), lambda i: F.substring("_p", i, q))
        rec = staged
    ex = rec.select("id", "n", F.posexplode_outer(grams).alias("pos", "gram")).where(F.col("gram").isNotNull())
    occ = F.row_number().over(Window.partitionBy("id", "gram").orderBy("pos"))
    return ex.select("id", "n", F.xxhash64("gram", occ).alias("token"))


def _spread(seed: np.ndarray) -> np.ndarray:
    """64 bits of which all depend on all of ``seed`` (uint64)."""
    seed = (seed ^ (seed >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    seed = (seed ^ (seed >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return seed ^ (seed >> np.uint64(33))


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and how many each text has."""
    n = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32), n


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of ``sizes``."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _gram_tokens(texts: pa.Array, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of texts, padded q-grams numbered by occurrence, as hashes; and how many each text has.

    Two grams with one hash only add candidates."""
    codes, n = _code_points(texts)
    left, right = (q - 1, q - 1) if q > 1 else (0, 1)  # for q = 1 a sentinel, so that empty strings still meet
    padded = np.full(int((n + left + right).sum()), ord(PAD_RIGHT), np.uint64)
    starts = np.cumsum(n + left + right) - (n + left + right)
    for k in range(left):
        padded[starts + k] = ord(PAD_LEFT)
    padded[np.repeat(starts + left, n) + _within(n)] = codes
    sizes = n + left + right - q + 1
    row, first = np.repeat(np.arange(len(n)), sizes), np.repeat(starts, sizes) + _within(sizes)
    grams = np.zeros(len(first), np.uint64)
    for k in range(q):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + padded[first + k] + np.uint64(1)
    grams = _spread(grams)
    grams = grams[np.lexsort((grams, row))]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    nth = np.arange(len(grams)) - np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))
    return _spread(grams + nth.astype(np.uint64)).view(np.int64), sizes


def _counted(records: DataFrame, tokens, column: str, most: int) -> DataFrame:
    """(token, df) of all records; ``tokens`` gives the tokens of a column, and how many each row has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, column, most):
            names, counts = np.unique(tokens(batch.column(column))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts.astype(np.int64))], ["token", "df"])

    return records.select(column).mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


def _known(counts: DataFrame):
    """The ``FREQUENT`` most frequent tokens with their counts, for all tasks; and whether every
    other token is a single record's."""
    # a bounded number of pairs of numbers
    top = counts.where("df > 1").orderBy(F.desc("df"), "token").limit(FREQUENT).toArrow()
    tokens, dfs = (top.column(c).to_numpy().astype(np.int64) for c in ("token", "df"))
    order = np.argsort(tokens)
    return counts.sparkSession.sparkContext.broadcast((tokens[order], dfs[order], len(tokens) < FREQUENT))


def _in_order(flat: np.ndarray, sizes: np.ndarray, known: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, token, rank, df) of all records' tokens in the order that all records share.

    Any such order is good for prefixes; here the known tokens come last, by frequency (df), and
    all others before them, by hash (df 0).  So the tasks get a bounded table, and tokens are
    neither joined nor sorted across tasks."""
    at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
    df = np.where(known[at] == flat, frequency[at], 0) if len(known) else np.zeros(len(flat), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, df, row))
    return row, flat[order], _within(sizes) + 1, df[order]


def _list(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _list_tokens(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(), np.asarray(pc.list_value_length(lists)).astype(np.int64)


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows that are sorted by ``group`` in tables of about ``most`` bytes that cut no group."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.nbytes
        if size >= most:
            table = pa.Table.from_batches(kept).combine_chunks()
            groups = table.column("group").to_numpy()
            cut = int(np.searchsorted(groups, groups[-1]))
            if cut:
                yield table.slice(0, cut).combine_chunks()
            # a group that fills the table alone is tried again when it is twice as large
            kept = table.slice(cut).to_batches()
            size = 0 if not cut else sum(x.nbytes for x in kept)
            most = max(most, table.nbytes) if not cut else most
    if sum(x.num_rows for x in kept):
        yield pa.Table.from_batches(kept).combine_chunks()


def _dealt(tokens: np.ndarray, df: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, part): records with a frequent token are dealt to parts by their seeds, and each
    two parts meet; ``part`` is 0 but in a group of two parts."""
    cuts = -(-np.maximum(df, 1) // GROUP_RECORDS)
    part = (_spread(seeds.view(np.uint64)) % cuts.astype(np.uint64)).astype(np.int64)
    again, other = np.repeat(np.arange(len(cuts)), cuts), _within(cuts)
    part, cuts = part[again], cuts[again]
    least, most = np.minimum(part, other), np.maximum(part, other)
    group = _spread(tokens[again].view(np.uint64) + (least * cuts + most).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return again, group.view(np.int64), np.where(least < most, part + 1, 0).astype(np.int32)


def _meeting(group: np.ndarray, part: np.ndarray, side: np.ndarray, n: np.ndarray, last: np.ndarray, t: float,
             self_join: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group that may be near by their lengths; rows are sorted by group and length.

    A pair that shares the token just before this one (``last``) has met there."""
    number = np.cumsum(np.diff(group, prepend=group[:1]) != 0)
    key = number * (1 << 32) + n
    lefts, rights = (np.arange(len(n)),) * 2 if self_join else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    lo = np.searchsorted(key[rights], number[lefts] * (1 << 32) + np.ceil(n[lefts] * t - 1e-9).astype(np.int64))
    hi = lefts if self_join else np.searchsorted(key[rights], number[lefts] * (1 << 32) + np.floor(n[lefts] / t + 1e-9).astype(np.int64), side="right")
    ends = np.cumsum(hi - lo)
    at = 0
    while at < len(lefts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MET_PAIRS, side="right")))
        sizes = (hi - lo)[at:to]
        left, right = np.repeat(lefts[at:to], sizes), rights[np.repeat(lo[at:to], sizes) + _within(sizes)]
        keep = np.flatnonzero(np.repeat(last[lefts[at:to]], sizes) != last[right])
        left, right = left[keep], right[keep]
        # where a token's records are dealt to parts, records of one part meet in that part alone
        if part[left].any():
            keep = (part[left] != part[right]) | (part[left] == 0)
            left, right = left[keep], right[keep]
        yield left, right
        at = to


# --- token sets ---------------------------------------------------------------------------


def _set_prefixes(keys: DataFrame, sent, t: float) -> DataFrame:
    """(id, h0, h1, n, tokens, ranks, bits) of token sets: the tokens of the prefix that other
    records may have, and their ranks among all tokens of the record.

    ``bits`` has a bit for every second token at least: whether an odd number of tokens falls on
    it.  Where the bits of two records differ, a token is missing in one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequency, whole = sent.value
        for batch in parts(batches, "h", ELEMENTS):
            flat, n = _list_tokens(batch.column("h"))
            row, flat, rank, df = _in_order(flat, n, known, frequency)
            # a partner reaching t may miss at most n - ceil(t*n) of this record's tokens
            keep = np.flatnonzero((rank <= (n - np.ceil(n * t - 1e-9).astype(np.int64) + 1)[row]) & ((df > 0) | (not whole)))
            words = 1 << np.ceil(np.log2(np.maximum(n, 128) / 128)).astype(np.int64)
            starts = np.cumsum(words) - words
            bit = _spread(flat.view(np.uint64)) & (words * 64 - 1).astype(np.uint64)[row]
            odd = np.zeros(int(words.sum()), np.uint64)
            np.bitwise_xor.at(odd, starts[row] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            sizes = np.bincount(row[keep], minlength=len(n))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "h0", "h1")), pa.array(n.astype(np.int32)), _list(pa.array(flat[keep]), sizes),
                 _list(pa.array(rank[keep].astype(np.int32)), sizes), _list(pa.array(odd.view(np.int64)), words)],
                ["id", "h0", "h1", "n", "tokens", "ranks", "bits"])

    hashed = _hashed(keys)
    longs = T.ArrayType(T.LongType())
    return hashed.mapInArrow(run, T.StructType([*(hashed.schema[c] for c in ("id", "h0", "h1")), T.StructField("n", T.IntegerType()),
                                                T.StructField("tokens", longs), T.StructField("ranks", T.ArrayType(T.IntegerType())),
                                                T.StructField("bits", longs)]))


def _hashed(keys: DataFrame) -> DataFrame:
    """Tokens as hashes.  Two tokens of a pair would have to share a 64-bit hash to change a result."""
    return keys.select("id", "h0", "h1", F.transform("key", lambda w: F.xxhash64(w)).alias("h"))


def _set_records(keys: DataFrame, sent, t: float) -> DataFrame:
    """Representatives with their prefixes; the sets themselves stay where they are."""
    reps = _set_prefixes(keys, sent, t).groupBy("h0", "h1").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "tokens", "ranks", "bits")))
    return materialize(reps.where(F.col("id").isNotNull()), "records")


def _differing_bits(a: Column, b: Column) -> Column:
    """How many bits differ; the longer of two is folded, bits that differ by more than a fold are not compared."""
    def folded(x):
        half = F.floor(F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))

    def count(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, m: n + m)

    return (F.when(F.size(a) == F.size(b), count(a, b)).when(F.size(a) == 2 * F.size(b), count(folded(a), b))
            .when(F.size(b) == 2 * F.size(a), count(a, folded(b))).otherwise(0))


def _set_postings(rec: DataFrame, side: int, sent) -> DataFrame:
    """(group, part, side, id, n, r, before) for every token of a record's prefix that another
    record may have: its rank, and such a token before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequency, _ = sent.value
        for batch in parts(batches, "tokens", ELEMENTS):
            flat, sizes = _list_tokens(batch.column("tokens"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            df = np.where(known[at] == flat, frequency[at], 0) if len(known) else np.zeros(len(flat), np.int64)
            again, group, part = _dealt(flat, df, batch.column("hash").to_numpy()[row])
            before = pa.array(np.roll(flat, 1)[again], mask=(_within(sizes) == 0)[again])
            of = pa.array(row[again])
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(part), *(batch.column(c).take(of) for c in ("side", "id", "n")),
                                              batch.column("ranks").flatten().take(pa.array(again)), before], out.fieldNames())

    rows = rec.select(F.lit(side).alias("side"), "id", "n", "tokens", "ranks", F.xxhash64("id").alias("hash"))
    out = T.StructType([T.StructField("group", T.LongType()), T.StructField("part", T.IntegerType()), *(rows.schema[c] for c in ("side", "id", "n")),
                        T.StructField("r", T.IntegerType()), T.StructField("before", T.LongType())])
    return rows.mapInArrow(run, out)


def _set_candidates(lrec: DataFrame, rrec: DataFrame, sent, t: float, self_join: bool) -> DataFrame:
    """(lid, rid, group): pairs that may reach ``t``, and a group in which both are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, GROUP_BYTES):
            group, part, side, n = (table.column(c).to_numpy().astype(np.int64) for c in ("group", "part", "side", "n"))
            order = np.lexsort((n, group))
            table = table.take(pa.array(order))
            group, part, side, n = (x[order] for x in (group, part, side, n))
            r, ids = table.column("r").to_numpy(), table.column("id").combine_chunks()
            last = _last(_list(table.column("before").combine_chunks().drop_null(), np.asarray(table.column("before").is_valid()).astype(np.int64)))
            apart = np.cumsum(np.diff(group, prepend=group[:1]) != 0)
            for left, right in _meeting(apart, part, side, n, last, t, self_join):
                # positional filter (exact): both records list tokens in the same global
                # order, so after their first shared token at their ranks r at most
                # 1 + min(n - r) tokens can be shared; Jaccard >= t needs an overlap of
                # t / (1 + t) * (n + n).  A qualifying pair passes at its first token, so
                # pairs are dropped before anything is shuffled
                bound = 1 + np.minimum(n[left] - r[left], n[right] - r[right])
                keep = np.flatnonzero(bound >= (n[left] + n[right]) * (t / (1 + t)) - 1e-9)
                left, right = left[keep], right[keep]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(group[left])], out.fieldNames())

    rows = _set_postings(lrec, 0, sent)
    if not self_join:
        rows = rows.unionByName(_set_postings(rrec, 1, sent))
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("lid", kind), T.StructField("rid", kind), T.StructField("group", T.LongType())])
    cand = rows.repartition(_tasks(rows), "group").sortWithinPartitions("group").mapInArrow(run, out)
    lid, rid = F.col("lid"), F.col("rid")
    if self_join:  # reported with the smaller id on the left
        cand = cand.where(lid != rid)
        lid, rid = F.least(lid, rid), F.greatest(lid, rid)
    pairs = cand.select(lid.alias("lid"), rid.alias("rid"), "group").groupBy("lid", "rid").agg(F.min("group").alias("group"))
    # few bytes of each record, in place of its tokens, tell most of the others
    lv = lrec.select(F.col("id").alias("lid"), F.col("n").alias("ln"), F.col("bits").alias("lw"))
    rv = rrec.select(F.col("id").alias("rid"), F.col("n").alias("rn"), F.col("bits").alias("rw"))
    near = pairs.join(lv, "lid").join(rv, "rid").where(
        _differing_bits(F.col("lw"), F.col("rw")) <= (F.col("ln") + F.col("rn")) * ((1 - t) / (1 + t)) + 1e-9)
    return materialize(near.select("lid", "rid", "group").distinct(), "pairs")


def _shared(members: pa.Table, pairs: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left row, right row, tokens that both have) of the pairs of each group."""
    m = members.select(["group", "side", "id"]).to_pandas().assign(row=np.arange(members.num_rows))
    p = pairs.select(["group", "id", "other"]).to_pandas()
    right = m[m.side == (1 if (m.side == 1).any() else 0)].rename(columns={"id": "other", "row": "right"})
    met = p.merge(m[m.side == 0], on=["group", "id"]).merge(right[["group", "other", "right"]], on=["group", "other"]).sort_values("row", kind="stable")
    flat, n = _list_tokens(members.column("toks").combine_chunks())
    names, flat = np.unique(flat, return_inverse=True)
    at, mark = np.cumsum(n) - n, np.zeros(len(names), bool)
    lefts, rights = met["row"].to_numpy(), met["right"].to_numpy()
    ends = np.flatnonzero(np.diff(lefts, append=-1)) + 1
    lo = 0
    for hi in ends.tolist():
        left = lefts[lo]
        own = flat[at[left]:at[left] + n[left]]
        mark[own] = True
        for k in range(lo, hi, 256):
            some = rights[k:min(k + 256, hi)]
            hits = mark[flat[np.repeat(at[some], n[some]) + _within(n[some])]]
            yield np.full(len(some), left), some, np.add.reduceat(hits, np.cumsum(n[some]) - n[some], dtype=np.int64)
        mark[own] = False
        lo = hi


def _verified_sets(pairs: DataFrame, sources: list, t: float) -> DataFrame:
    """(lid, rid, ln, rn, shared, left_copies, right_copies) of the pairs.

    The sets of a group's records are sent there once, not to each of their pairs: a group of
    near copies gives many pairs of few records.  ``sources`` has (df, id, keys of df, records)
    of the left side and, if it is another, of the right one."""
    # the pairs of a large group are dealt to parts of it, by both records
    hot = pairs.groupBy("group").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / GROUP_PAIRS)).cast("int").alias("cuts")).where("cuts > 1")
    cut = pairs.join(F.broadcast(hot), "group", "left").select("lid", "rid", F.when(F.col("cuts").isNull(), F.col("group")).otherwise(
        F.xxhash64("group", F.pmod(F.xxhash64("lid"), F.col("cuts")), F.pmod(F.xxhash64("rid"), F.col("cuts")))).alias("group"))
    rows = cut.select("group", F.lit(2).alias("side"), F.col("lid").alias("id"), F.col("rid").alias("other"), F.lit(None).cast("long").alias("copies"),
                      F.lit(None).cast("array<long>").alias("toks"))
    for side, (df, id_col, keys, rec) in enumerate(sources):
        ids = F.array("lid", "rid") if len(sources) == 1 else F.array("lid" if side == 0 else "rid")
        wanted = cut.select(F.explode(ids).alias("id"), "group").groupBy("id").agg(F.collect_set("group").alias("groups"))
        wanted = materialize(rec.select("id", "h0", "h1", "copies").join(wanted, "id"), "members")
        # a bounded number of keys keeps most other texts from being sent
        sieve = wanted.select(F.xxhash64("id").bitwiseAND(F.lit(SIEVE - 1)).alias("_sieve")).distinct()
        some = df.join(F.broadcast(sieve), F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(SIEVE - 1)) == F.col("_sieve"), "left_semi")
        sets = _hashed(keys(some)).join(wanted, ["id", "h0", "h1"]).groupBy("id", "h0", "h1").agg(
            *(F.first(c).alias(c) for c in ("copies", "groups", "h")))
        rows = rows.unionByName(sets.select(F.explode("groups").alias("group"), F.lit(side).alias("side"), "id",
                                            F.lit(None).cast(pairs.schema["rid"].dataType).alias("other"), "copies", F.col("h").alias("toks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, GROUP_BYTES):
            side = table.column("side").to_numpy()
            members, pairs = table.filter(pa.array(side < 2)), table.filter(pa.array(side == 2))
            if not members.num_rows or not pairs.num_rows:
                continue
            n = np.asarray(pc.list_value_length(members.column("toks"))).astype(np.int64)
            for left, right, both in _shared(members, pairs):
                keep = both >= (n[left] + n[right] - both) * t - 1e-9
                left, right = left[keep], right[keep]
                ids, copies = members.column("id").combine_chunks(), members.column("copies").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(n[left]), pa.array(n[right]), pa.array(both[keep]),
                     copies.take(pa.array(left)), copies.take(pa.array(right))], out.fieldNames())

    out = T.StructType([T.StructField("lid", pairs.schema["lid"].dataType), T.StructField("rid", pairs.schema["rid"].dataType),
                        *(T.StructField(c, T.LongType()) for c in ("ln", "rn", "shared", "left_copies", "right_copies"))])
    dealt = rows.repartition(_tasks(pairs), "group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, out)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _set_join(sources: list, method: str, t: float) -> DataFrame:
    keys = [_keys(df, i, text, method) for df, i, text in sources]
    raw = [(df, i, lambda some, i=i, text=text: _keys(some, i, text, method)) for df, i, text in sources]
    if method == "cosine":
        # characters are few, and dear to find: they are kept
        keys = [materialize(k, "keys") for k in keys]
        raw = [(k, "id", lambda some: some) for k in keys]
    hashed = _hashed(keys[0]).select("h")
    for k in keys[1:]:
        hashed = hashed.unionByName(_hashed(k).select("h"))
    sent = _known(_counted(hashed, _list_tokens, "h", 4 * ELEMENTS))
    recs = [_set_records(k, sent, t) for k in keys]
    pairs = _set_candidates(recs[0], recs[-1], sent, t, len(recs) == 1)
    v = _verified_sets(pairs, [(*r, rec) for r, rec in zip(raw, recs)], t)
    union = F.col("ln") + F.col("rn") - F.col("shared")
    return v.select(F.col("lid").alias("left_id"), F.col("rid").alias("right_id"),
                    (F.col("shared") / union).alias("similarity"), "left_copies", "right_copies")


# --- edit distance ------------------------------------------------------------------------

# Code points of a text that is sent to its groups, where distances are worked out: they fit a
# byte.  Pairs with a longer text are sent to their texts.
LONG = 127
# Pairs whose distances are worked out at once.
EDIT_PAIRS = 1 << 15
HIGH, ONES = np.uint64(0x8080808080808080), np.uint64(0x0101010101010101)


def _edit_postings(rec: DataFrame, side: int, sent, t: float, q: int, texts: bool) -> DataFrame:
    """(group, token, part, side, id, n, copies, text, earlier) for every token of a record's
    prefix that another record may have; ``earlier`` are those before it.  ``part`` is 0 but in
    a group of two parts of a token's records.  Without ``texts`` no text and no earlier tokens are sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequency, whole = sent.value
        for batch in parts(batches, "text", TEXT_BYTES >> 3):
            flat, sizes = _gram_tokens(batch.column("text"), q)
            n = batch.column("n").to_numpy().astype(np.int64)
            row, flat, rank, df = _in_order(flat, sizes, known, frequency)
            # an edit spoils q grams: of the first q * tau + 1 a partner has one, where tau is the
            # largest distance any partner may have
            keep = np.flatnonzero((rank <= (q * np.floor(n * ((1 - t) / t) + 1e-9).astype(np.int64) + 1)[row]) & ((df > 0) | (not whole)))
            row, flat, df = row[keep], flat[keep], df[keep]
            counts = np.bincount(row, minlength=len(n))
            nth = _within(counts)
            again, group, part = _dealt(flat, df, batch.column("hash").to_numpy()[row])
            of = pa.array(row[again])
            mine = (nth if texts else np.zeros_like(nth))[again]
            earlier = np.repeat((np.cumsum(counts) - counts)[row[again]], mine) + _within(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group), pa.array(flat[again]), pa.array(part),
                 *(batch.column(c).take(of) for c in ("side", "id", "n", "copies")),
                 batch.column("text").take(of) if texts else pa.nulls(len(of), pa.string()), _list(pa.array(flat[earlier]), mine)], out.fieldNames())

    rows = rec.select(F.lit(side).alias("side"), "id", F.col("n").cast("int").alias("n"), "copies", "text", F.xxhash64("text").alias("hash"))
    out = T.StructType([T.StructField("group", T.LongType()), T.StructField("token", T.LongType()), T.StructField("part", T.IntegerType()),
                        *(rows.schema[c] for c in ("side", "id", "n", "copies", "text")), T.StructField("earlier", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, out)


def _last(lists: pa.Array) -> np.ndarray:
    """A number for the last token of each list; an empty list has a number of its own."""
    flat, sizes = _list_tokens(lists)
    some = np.flatnonzero(sizes)
    out = -1 - np.arange(len(sizes), dtype=np.int32)
    out[some] = np.unique(flat[np.cumsum(sizes)[some] - 1], return_inverse=True)[1]
    return out


def _letters(codes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How often the code points of each of 16 kinds come in a text, a byte for each (2, rows)."""
    counts = np.bincount(row * 16 + (codes & 15), minlength=rows * 16).astype(np.uint8)
    return np.ascontiguousarray(counts.reshape(rows, 16).view(np.uint64).T)


def _excess(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of what bytes of ``a`` have more than those of ``b``, modulo 256; no byte is over 127."""
    d = (a | HIGH) - b
    more = (d & HIGH) >> np.uint64(7)
    return ((d & ~HIGH & ((more << np.uint64(8)) - more)) * ONES) >> np.uint64(56)


def _edit_distances(codes: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Distances of rows ``a`` and ``b`` of ``codes``, as far as they are not over ``most``; else some number over it.

    The pairs are worked on together, one place of the shorter text after the other.  A way
    that leaves the diagonals kept costs more than ``most``."""
    swap = n[a] > n[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    order = np.argsort(-n[a], kind="stable")
    found = np.empty(len(a), np.int64)
    for lo in range(0, len(a), EDIT_PAIRS):
        some = order[lo:lo + EDIT_PAIRS]
        na, nb, limit = n[a[some]], n[b[some]], int(most[some].max())
        more = nb - na
        down, up = max(0, (limit - int(more.min())) // 2), max(0, (limit + int(more.max())) // 2)
        x = np.ascontiguousarray(codes[a[some], :max(1, int(na.max()))].T)
        y = np.ascontiguousarray(codes[b[some], :max(1, int(nb.max()))].T)
        d = np.full((down + up + 1, len(some)), 200, np.uint8)
        for k in range(up + 1):
            d[down + k] = k
        ends = np.searchsorted(-na, -np.arange(int(na.max()) + 2), side="right")  # texts of i or more places
        done = np.zeros(len(some), np.int64)
        for i in range(int(na.max()) + 1):
            m = int(ends[i])
            if i:
                for k in range(down + up + 1):
                    j = i + k - down
                    if j < 0 or j > len(y):
                        continue
                    if j == 0:
                        d[k, :m] = i
                        continue
                    best = d[k, :m]
                    best += x[i - 1, :m] != y[j - 1, :m]
                    if k < down + up:
                        np.minimum(best, d[k + 1, :m] + np.uint8(1), out=best)
                    if k:
                        np.minimum(best, d[k - 1, :m] + np.uint8(1), out=best)
            over = int(ends[i + 1])
            if over < m:  # these end here
                k = np.clip(more[over:m] + down, 0, down + up)
                done[over:m] = np.where(more[over:m] <= up, d[k, np.arange(over, m)], limit + 1)
        found[some] = done
    return found


def _met_before(rows: pa.ChunkedArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs have a token in both lists."""
    flat, sizes = _list_tokens(rows.combine_chunks())
    names, flat = np.unique(flat, return_inverse=True)
    both = np.zeros(len(left), bool)
    if not len(names):
        return both
    have = np.sort(np.repeat(np.arange(len(sizes)), sizes) * len(names) + flat)
    starts = np.cumsum(sizes) - sizes
    for lo in range(0, len(left), EDIT_PAIRS):
        a, b = left[lo:lo + EDIT_PAIRS], right[lo:lo + EDIT_PAIRS]
        asked = np.repeat(b, sizes[a]) * len(names) + flat[np.repeat(starts[a], sizes[a]) + _within(sizes[a])]
        hit = have[np.minimum(np.searchsorted(have, asked), len(have) - 1)] == asked
        both[lo:lo + EDIT_PAIRS] = np.bincount(np.repeat(np.arange(len(a)), sizes[a]), weights=hit, minlength=len(a)) > 0
    return both


def _met(postings: DataFrame, t: float, self_join: bool, texts: bool) -> DataFrame:
    """(lid, rid, distance, longest, left_copies, right_copies) of the near pairs that meet in a
    group, each once; without ``texts``, all pairs with a text over ``LONG`` that may be near, with distance null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, GROUP_BYTES >> 2):
            group, token, part, side, n = (table.column(c).to_numpy().astype(np.int64) for c in ("group", "token", "part", "side", "n"))
            order = np.lexsort((n, token, group))
            table = table.take(pa.array(order))
            # two tokens with one group hash stay apart
            group, token, part, side, n = (x[order] for x in (group, token, part, side, n))
            apart = np.cumsum((np.diff(group, prepend=group[:1]) != 0) | (np.diff(token, prepend=token[:1]) != 0))
            if texts:
                codes, sizes = _code_points(table.column("text").combine_chunks())
                row = np.repeat(np.arange(len(n)), sizes)
                letters = _letters(codes, row, len(n))
                names, codes = np.unique(codes, return_inverse=True)
                text = np.zeros((len(n), max(1, int(sizes.max(initial=0)))), np.min_scalar_type(len(names) + 1))
                text[row, _within(sizes)] = codes + 1
            ids, copies = table.column("id").combine_chunks(), table.column("copies").combine_chunks()
            last = _last(table.column("earlier").combine_chunks())
            for left, right in _meeting(apart, part, side, n, last, t, self_join):
                longest = np.maximum(n[left], n[right])
                most = np.floor(longest * (1 - t) + 1e-9).astype(np.int64)
                if texts:
                    excess = _excess(letters[0][left], letters[0][right]) + _excess(letters[1][left], letters[1][right])
                    excess = excess.astype(np.int64)
                    keep = np.flatnonzero((excess <= most) & (excess - n[left] + n[right] <= most))
                    left, right, longest, most = left[keep], right[keep], longest[keep], most[keep]
                    distance = _edit_distances(text, n, left, right, most)
                    keep = np.flatnonzero(distance <= most)
                    keep = keep[~_met_before(table.column("earlier"), left[keep], right[keep])]
                    distance = pa.array(distance[keep].astype(np.int32))
                else:
                    keep = np.flatnonzero(longest > LONG)
                    distance = pa.nulls(len(keep), pa.int32())
                left, right = pa.array(left[keep]), pa.array(right[keep])
                yield pa.RecordBatch.from_arrays([ids.take(left), ids.take(right), distance, pa.array(longest[keep].astype(np.int32)),
                                                  copies.take(left), copies.take(right)], out.fieldNames())

    kind = postings.schema["id"].dataType
    out = T.StructType([T.StructField("lid", kind), T.StructField("rid", kind), T.StructField("distance", T.IntegerType()),
                        T.StructField("longest", T.IntegerType()), T.StructField("left_copies", T.LongType()), T.StructField("right_copies", T.LongType())])
    pairs = postings.repartition(_tasks(postings), "group").sortWithinPartitions("group").mapInArrow(run, out)
    if not self_join:
        return pairs
    # reported with the smaller id on the left
    turned = F.col("lid") > F.col("rid")
    return pairs.where(F.col("lid") != F.col("rid")).select(
        F.least("lid", "rid").alias("lid"), F.greatest("lid", "rid").alias("rid"), "distance", "longest",
        *(F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("left_copies", "right_copies"), ("right_copies", "left_copies"))))


def _edit_join(sources: list, t: float) -> DataFrame:
    # few bytes that much is made of: dealt to all tasks
    recs = [materialize(_representatives(_keys(df, i, text, "levenshtein"), "levenshtein").where(F.col("id").isNotNull())
                        .repartition(_tasks(df), "id"), "records") for df, i, text in sources]
    q, self_join = gram_size(t), len(sources) == 1
    texts = recs[0].select("text")
    for rec in recs[1:]:
        texts = texts.unionByName(rec.select("text"))
    sent = _known(_counted(texts, lambda x: _gram_tokens(x, q), "text", TEXT_BYTES >> 3))

    def met(recs: list, short: bool) -> DataFrame:
        rows = _edit_postings(recs[0], 0, sent, t, q, short)
        for rec in recs[1:]:
            rows = rows.unionByName(_edit_postings(rec, 1, sent, t, q, short))
        return _met(rows, t, self_join, short)

    similarity = F.when(F.col("longest") == 0, F.lit(1.0)).otherwise(1 - F.col("distance") / F.col("longest")).alias("similarity")
    columns = [F.col("lid").alias("left_id"), F.col("rid").alias("right_id"), similarity, "left_copies", "right_copies"]
    found = met([rec.where(F.col("n") <= LONG) for rec in recs], True).select(*columns)
    if all(rec.where(F.col("n") > LONG).isEmpty() for rec in recs):
        return found
    # pairs with a long text are sent to the texts
    pairs = materialize(met([rec.where(F.col("n") >= LONG * t) for rec in recs], False).select("lid", "rid").distinct(), "pairs")
    lv = recs[0].select(F.col("id").alias("lid"), F.col("text").alias("lp"), F.col("copies").alias("left_copies"))
    rv = recs[-1].select(F.col("id").alias("rid"), F.col("text").alias("rp"), F.col("copies").alias("right_copies"))
    longest = F.greatest(F.length("lp"), F.length("rp"))
    # distances are worked out up to the largest that reaches t; beyond it they are -1
    v = pairs.join(lv, "lid").join(rv, "rid").withColumn("longest", longest).withColumn("_most", F.floor(longest * (1 - t) + 1e-9).cast("int"))
    v = v.withColumn("distance", F.expr("levenshtein(lp, rp, _most)")).where(F.col("distance") >= 0)
    return found.unionByName(v.where(F.col("longest") > LONG).select(*columns))


def similarity_join(left: DataFrame, right: DataFrame | None = None, method: str = "jaccard",
                    threshold: float = 0.8, left_id: str = "id", left_text: str = "text",
                    right_id: str | None = None, right_text: str | None = None,
                    per_left: int | None = None) -> DataFrame:
    """Pairs with similarity >= ``threshold`` in compact form:
    (left_id, right_id, similarity, left_copies, right_copies).

    Records with the same key (token set, or text for edit similarity) are
    one representative (the smallest id) standing for ``copies`` records;
    pairs are reported between representatives, so a large group of copies
    never turns into all of its pairs.  ``duplicate_groups`` lists the copies
    behind each representative; together they give every pair.  With
    ``right=None`` the table is joined with itself and each pair of distinct
    representatives is reported once (left_id < right_id); copies of one
    record are similar to each other with similarity 1.  With ``per_left`` each
    left record keeps that many partners: the most similar, then the smallest ids.
    """
    if method not in METHODS:
        raise ValueError(f"no similarity called {method!r}; choose one of {', '.join(METHODS)}")
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]; a zero threshold asks for every pair")
    # identical records collapse to one representative first; representatives
    # feed the prefixes and the verification
    sources = [(left, left_id, left_text)]
    if right is not None:
        sources.append((right, right_id or left_id, right_text or left_text))
    t = float(threshold)
    out = _edit_join(sources, t) if method == "levenshtein" else _set_join(sources, method, t)
    out = out.where(F.col("similarity") >= t - 1e-12)
    if per_left is None:
        return out
    w = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_left).drop("_r")


# --- top-k without a threshold ------------------------------------------------------------

FIRST_BOUND = 0.6
FALL = 0.5
# Below this a record's prefix is all of it: every partner that shares a token is a candidate.
LEAST_BOUND = 0.02
# Up to so many left token sets are sent to the right records.
SHIPPED_RECORDS = 2048
# Different shares of tokens differ within so many places, equal ones do not.
EXACT_DECIMALS = 15


def _needed(n: Column, t: Column, method: str) -> Column:
    """Tokens, rarest first, of which a record of ``n`` shares one with every partner of
    similarity ``t`` or more."""
    if method == "levenshtein":
        return F.when(t <= 0, n + 1).otherwise(F.least(n + 1, F.floor(n * (1 - t) / F.greatest(t, F.lit(1e-9)) + 1e-9) + 1))
    return n - F.ceil(n * t - 1e-9) + 1


def _ranked_tokens(rec: DataFrame, side: int, method: str) -> DataFrame:
    tokens = _edit_tokens(rec, 1) if method == "levenshtein" else rec.select("id", "n", F.explode("toks").alias("token"))
    return tokens.withColumn("side", F.lit(side))


def _overlaps(rows: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """Token sets as terms of weight 1, and their sizes."""
    sizes, flat = np.asarray(pc.list_value_length(rows.field("terms"))).astype(np.int64), rows.field("terms").flatten()
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    lists = [pa.ListArray.from_arrays(at, flat), pa.ListArray.from_arrays(at, pa.array(np.ones(len(flat))))]
    return pa.StructArray.from_arrays(lists, ["terms", "weights"]), sizes


def _shipped_top_k(lrec: DataFrame, rrec: DataFrame, k: int, self_join: bool) -> DataFrame:
    """(lid, rid, rank, similarity) of few left sets: they go to the right records, which stay
    where they are, and the tokens that two sets share are counted there."""
    shared = lexical._scorer(True)

    def prepare(rows: pa.Array):
        sets, sizes = _overlaps(rows)
        flat = sets.field("terms").flatten()
        names = flat.unique()
        at = np.asarray(pc.index_in(flat, value_set=names)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(names)))]).astype(np.int64)
        query = np.repeat(np.arange(len(rows)), sizes)[order]
        return (len(rows), names, starts, query, np.ones(len(query))), sizes, order_key(rows.field("query_id"))

    def score(ready, docs: pa.Array) -> np.ndarray:
        known, n, ids = ready
        sets, m = _overlaps(docs)
        both = shared(known, sets)
        s = np.where(both > 0, both / np.maximum(n[:, None] + m - both, 1), -np.inf)
        return np.where(ids[:, None] == order_key(docs.field("id")), -np.inf, s) if self_join else s

    q = lrec.select(F.col("id").alias("query_id"), F.col("toks").alias("terms"))
    docs = rrec.select("id", F.col("toks").alias("terms"))
    hits = block_top_k(docs, q, prepare, score, k, pack_rows=lexical.PACK_ROWS, decimals=EXACT_DECIMALS, **lexical._size(q))
    return hits.select(F.col("query_id").alias("lid"), F.col("doc_id").alias("rid"), "rank", F.col("score").alias("similarity"))


def _prefix_top_k(lrec: DataFrame, rrec: DataFrame, method: str, k: int, self_join: bool) -> DataFrame:
    """(lid, rid, rank, similarity) in rounds of growing prefixes.

    Every left record has a bound under which partners may be unseen.  A round joins
    prefixes as long as the record's bound asks for and verifies what meets; the bound then
    falls to the record's k-th similarity, or to a share of itself where there are fewer than
    k partners yet, and the prefix grows with it.  A record is done when its k-th similarity
    reaches the bound of its last round, so only records without near partners go on to
    frequent tokens.
    """
    both = _ranked_tokens(lrec, 0, method).unionByName(_ranked_tokens(rrec, 1, method))
    df = both.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("side", "id").orderBy("df", "token")
    ranked = materialize(both.join(df, "token").withColumn("r", F.row_number().over(w)).select("side", "id", "n", "token", "r"), "ranked")
    a = ranked.where("side = 0").select(F.col("id").alias("lid"), F.col("n").alias("ln"), "token", F.col("r").alias("lr"))
    b = ranked.where("side = 1").select(F.col("id").alias("rid"), F.col("n").alias("rn"), "token", F.col("r").alias("rr"))
    payload = "text" if method == "levenshtein" else "toks"
    lv = lrec.select(F.col("id").alias("lid"), F.col(payload).alias("lp"))
    rv = rrec.select(F.col("id").alias("rid"), F.col(payload).alias("rp"))
    sim = (edit_similarity if method == "levenshtein" else set_jaccard)(F.col("lp"), F.col("rp"))
    best = Window.partitionBy("lid").orderBy(F.desc("similarity"), "rid")

    active = lrec.select(F.col("id").alias("lid"), F.lit(FIRST_BOUND).alias("t"))
    found = None
    while True:
        active = materialize(active, "active")
        if active.isEmpty():
            break
        t = F.col("t")
        mine = a.join(active, "lid").where(F.col("lr") <= _needed(F.col("ln"), t, method))
        met = mine.join(b, "token").where((F.col("rr") <= _needed(F.col("rn"), t, method))
                                          & (F.col("ln") >= F.col("rn") * t - 1e-9) & (F.col("rn") >= F.col("ln") * t - 1e-9))
        if self_join:
            met = met.where(F.col("lid") != F.col("rid"))
        firsts = met.groupBy("lid", "rid").agg(F.min(F.struct("lr", "rr")).alias("f"), F.first("ln").alias("ln"), F.first("rn").alias("rn"),
                                               F.first("t").alias("t"))
        if method != "levenshtein":  # after the first shared token at most so many more can be shared
            bound = 1 + F.least(F.col("ln") - F.col("f.lr"), F.col("rn") - F.col("f.rr"))
            firsts = firsts.where(bound >= (F.col("ln") + F.col("rn")) * t / (1 + t) - 1e-9)
        pairs = firsts.select("lid", "rid")
        if found is not None:
            pairs = pairs.join(found.select("lid", "rid"), ["lid", "rid"], "left_anti")
        scored = pairs.join(lv, "lid").join(rv, "rid").select("lid", "rid", sim.alias("similarity")).where("similarity > 0")
        scored = scored if found is None else found.select("lid", "rid", "similarity").unionByName(scored)
        found = materialize(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")
        kth = found.where(F.col("rank") == k).select("lid", F.col("similarity").alias("kth"))
        # all partners at the bound or above have been seen; a full list's k-th similarity is the next, and last, bound
        active = (active.join(kth, "lid", "left").where((t > 0) & (F.col("kth").isNull() | (F.col("kth") < t - 1e-12)))
                  .withColumn("fallen", t * FALL)
                  .select("lid", F.coalesce("kth", F.when(F.col("fallen") < LEAST_BOUND, F.lit(0.0)).otherwise(F.col("fallen"))).alias("t")))
    return found


def similarity_top_k(left: DataFrame, right: DataFrame | None = None, method: str = "jaccard", k: int = 5, left_id: str = "id",
                     left_text: str = "text", right_id: str | None = None, right_text: str | None = None) -> DataFrame:
    """The ``k`` most similar right records of every left record, without a threshold:
    (left_id, rank, right_id, similarity, left_copies, right_copies).

    Records are representatives of their copies, as in ``similarity_join``; with
    ``right=None`` a record's own group is no partner.  Partners of similarity 0 are none;
    equal similarities go by id.
    """
    if method not in METHODS:
        raise ValueError(f"no similarity called {method!r}; choose one of {', '.join(METHODS)}")
    if k < 1:
        raise ValueError("k must be 1 or more")
    self_join = right is None
    lrec = materialize(_representatives(_keys(left, left_id, left_text, method), method), "records")
    rrec = lrec if self_join else materialize(_representatives(
        _keys(right, right_id or left_id, right_text or left_text, method), method), "records")
    # a few left sets are sent to the right records; more, and texts, go through prefixes
    if method != "levenshtein" and len(lrec.select("id").limit(SHIPPED_RECORDS + 1).collect()) <= SHIPPED_RECORDS:
        found = _shipped_top_k(lrec, rrec, k, self_join)
    else:
        found = _prefix_top_k(lrec, rrec, method, k, self_join)
    copies = [rec.select(F.col("id").alias(c), F.col("copies").cast("long").alias(name)) for rec, c, name in
              ((lrec, "lid", "left_copies"), (rrec, "rid", "right_copies"))]
    return (found.join(copies[0], "lid").join(copies[1], "rid")
            .select(F.col("lid").alias("left_id"), "rank", F.col("rid").alias("right_id"), "similarity", "left_copies", "right_copies"))


__all__ = ["similarity_join", "similarity_top_k", "duplicate_groups", "text_similarity"]
