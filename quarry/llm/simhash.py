"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are made of whole texts, where they lie.  Distinct fingerprints
are then compared: the 64 bits form a ring of ``SEGMENTS`` segments, and with a
budget of ``distance`` differing bits some chain of consecutive segments has,
at each length l, at most ``floor(l * distance / SEGMENTS)`` differing bits in
its first l segments.  The lengths whose budget is zero are the join key; the
rest of the chain prunes candidates before the full Hamming check.

Defined results: a null or empty text has fingerprint zero and links like any
other; a null id is ignored by the smallest id of a group (a group of null ids
alone has a null component); repeated rows share fingerprint and component;
columns beside id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import component_ids, field, spaced_words, stage

SEGMENTS = 7
# A key shared by more fingerprints than this is linked by one-flip neighbours,
# whose groups never exceed 65, instead of pair by pair.  Both ways are exact.
DENSE_KEY = 128
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority vote over the XXH64 of all word shingles, repeats included; unsigned."""
    w = spaced_words(text)
    if not w:
        return 0
    if len(w) <= shingle:
        h = [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    else:
        whole = b" ".join(w)
        stops = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = [0, *stops[:-shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        h = [digest(whole[a:b], SEED) for a, b in zip(starts, (stops[shingle - 1:] - 1).tolist(), strict=True)]
    seen = np.array(h, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(seen), 65536):
        bits = np.unpackbits(seen[i:i + 65536].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(seen), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fp): the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("id", field(docs, id_col)), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _chains(distance: int, segments: int = SEGMENTS) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Per chain start: the mask that must agree, and (mask, budget) of longer chains."""
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    part = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(segments)]
    keys, rest = [], []
    for start in range(segments):
        mask, key, more = 0, 0, []
        for length in range(1, segments + 1):
            mask |= part[(start + length - 1) % segments]
            budget = length * distance // segments
            if budget == 0:
                key = mask
            else:
                more.append((_signed(mask), budget))
        keys.append(_signed(key))
        rest.append(more)
    return keys, rest


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``prints`` (fp): their components are
    those of all pairs at ``distance`` or fewer bits, and each edge is such a pair."""
    if not 0 < distance < SEGMENTS:
        raise ValueError(f"the distance must be from 1 to {SEGMENTS - 1}")
    masks, rest = _chains(distance)
    keys = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
        .alias("k")).select("fp", "k.ring", "k.key")
    sizes = stage(keys.groupBy("ring", "key").count().where("count > 1"), "simhash-keys")

    met = keys.join(sizes.where(F.col("count") <= DENSE_KEY), ["ring", "key"]).select("ring", "key", "fp")
    a, b = met.alias("a"), met.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    chain = F.lit(False)
    for i, more in enumerate(rest):
        within = F.col("a.ring") == i
        for mask, budget in more:
            within = within & (F.bit_count(differ.bitwiseAND(F.lit(mask))) <= budget)
        chain = chain | within
    pairs = (a.join(b, (F.col("a.ring") == F.col("b.ring")) & (F.col("a.key") == F.col("b.key"))
                    & (F.col("a.fp") < F.col("b.fp")))
             .where(chain & (F.bit_count(differ) <= distance))
             .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))

    dense = stage(keys.join(sizes.where(F.col("count") > DENSE_KEY), ["ring", "key"]).select("fp").distinct(),
                  "simhash-dense")
    return pairs.unionByName(_dense_links(dense, distance)).distinct()


def _dense_links(dense: DataFrame, distance: int) -> DataFrame:
    """Two fingerprints at ``distance`` bits or fewer share a value that lies at most
    half as far from each; all that share one are linked through its smallest."""
    edges = None
    near, reach = dense.select("fp", F.col("fp").alias("hub")), distance // 2
    flips = [F.lit(_signed(1 << i)) for i in range(64)]
    for _ in range(reach):
        near = near.select("fp", F.explode(F.array(F.col("hub"), *[F.col("hub").bitwiseXOR(f) for f in flips]))
                           .alias("hub")).distinct()
    far = near
    if distance % 2:
        far = near.select("fp", F.explode(F.array(F.col("hub"), *[F.col("hub").bitwiseXOR(f) for f in flips]))
                          .alias("hub")).distinct()
        # odd: one end reaches one bit further than the other
        least = near.groupBy("hub").agg(F.min("fp").alias("m"))
        edges = far.join(least, "hub").where("fp != m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
        edges = edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    least = near.groupBy("hub").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    even = near.join(least, "hub").where("fp != m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return even if edges is None else even.unionByName(edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    distance: int = 2) -> DataFrame:
    """One row per input row: id column, fingerprint (16 hex digits), component_id."""
    made = stage(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    distinct = stage(made.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    placed = component_ids(distinct.select(F.col("fp").alias("node"), "least"), links(distinct.select("fp"), distance),
                           "simhash")
    ids = placed.select(F.col("node").alias("fp"), "component_id")
    return made.join(ids, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                       "component_id")
