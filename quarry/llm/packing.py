"""Best-fit packing of token sequences through a configuration linear program.

Texts are tokenised where they lie; only the lengths' histogram (at most
``capacity`` numbers) reaches the driver.  There the covering program "use as
few configurations as possible such that each length is covered as often as it
occurs" is solved by multiplicative weights: a length's price falls as it is
covered, and a knapsack dynamic program prices the best filling of every space.
One such table serves a whole turn: each open length, the longest first, gets the
best configuration that holds it, which covers at most ``STEP`` of any length in it,
in sequences rounded down.  Turns go on until all but ``REST`` of the pieces are
covered; those are packed by best fit, length by length in bulk.  The result is a list
of configurations with multiplicities, bounded by the capacity and not by the number of
documents.

Pieces of one length are interchangeable: a global sort numbers them and the
number decides configuration, copy and offset, in every task by itself.

Defined results: a null or empty text is the end token alone; a text longer than
``capacity`` is cut into full pieces, the first of which may be shorter; repeated
rows are packed like others; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import field, global_rank, per_process, stage

CAPACITY = 2048
END = 0
STEP = 0.5
RATE = 0.1
REST = 0.01
KNOWN_WORDS = 400_000  # entries of a task's word cache

_OTHER_SPACE = re.compile(r"[^\S \n]")
# Marks that end a word: letters before and marks after never share a token.
_MARKS = ".,!?;:|*#$%&)"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class _Words:
    """Token ids (little-endian, unsigned 32 bit) of words after ``lead`` (a blank
    or nothing), worked out by the tokenizer when first asked for."""

    def __init__(self, made, lead: str):
        self.made, self.model, self.lead, self.letters = made, made.model, lead, _byte_letters()
        self.known: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def of(self, words: list[str]) -> list[bytes]:
        """The ids of each word; a plain dictionary's look-up, and the tokenizer for the rest."""
        found = list(map(self.known.get, words))
        return [self[w] if x is None else x for w, x in zip(words, found, strict=True)] if None in found else found

    def __getitem__(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is not None:
            return ids
        core = word.rstrip(_MARKS)
        if not core.isalpha():
            ids = np.array(self.made.encode(self.lead + word, add_special_tokens=False).ids, "<u4").tobytes()
        elif core != word:
            end = word[len(core):]
            if end not in self.ends:
                self.ends[end] = np.array(self.made.encode(end, add_special_tokens=False).ids, "<u4").tobytes()
            ids = self[core] + self.ends[end]
        else:
            letters = (self.lead + word).encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        self.known[word] = ids
        return ids


def _tokenizer(path: str):
    """The tokenizer and its words at line starts and after blanks, once per process."""
    known = per_process("tokenizers")
    if path not in known:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        made = Tokenizer.from_file(path)
        added = [t.content for t in made.get_added_tokens_decoder().values()]
        known[path] = made, _Words(made, ""), _Words(made, " "), added
    return known[path]


def _plain(text: str) -> bool:
    """Whether all white space is lone blanks and line breaks between words; the
    library's own splitting decides elsewhere."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"
                or _OTHER_SPACE.search(text))


def encode(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text by the tokenizer file, ``add_special_tokens`` false.

    The byte-level splitting never joins what a lone blank or line break
    parts, so a text without other white space is the chain of its words (a
    blank belongs to the word after it), and words are encoded once.  A text that
    holds an added token's content goes to the library as it is.
    """
    made, first, after, added = _tokenizer(path)
    break_ = first["\n"]
    out = []
    for text in texts:
        if not text:
            out.append(np.zeros(0, "<u4"))
        elif not _plain(text) or any(t in text for t in added):
            out.append(np.array(made.encode(text, add_special_tokens=False).ids, "<u4"))
        else:
            lines = []
            for line in text.split("\n"):
                words = line.split(" ")
                lines.append(first[words[0]] + b"".join(after.of(words[1:])))
            out.append(np.frombuffer(break_.join(lines), "<u4"))
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           keep_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids])."""
    schema = T.StructType([T.StructField("id", field(docs, id_col)), T.StructField("piece", T.IntegerType()),
                           *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")),
                           *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                who, rows = [], []
                for k, ids in enumerate(encode(part.column(1).to_pylist(), tokenizer)):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    start = 0
                    for piece in range(-(-len(ids) // capacity)):
                        stop = len(ids) - capacity * (-(-len(ids) // capacity) - piece - 1)
                        raw = ids[start:stop].tobytes()
                        who.append(k)
                        rows.append((piece, start, stop - start, zlib.crc32(raw), *([raw] if keep_ids else [])))
                        start = stop
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(who)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))],
                    [f.name for f in schema.fields])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(cut, schema)


def _table(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack table: for every space, the index of a length in its filling of the
    highest price, or -1 where the space is best left as the next smaller one."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for space in range(1, capacity + 1):
        n = fit[space]
        value[space] = value[space - 1]
        if n:
            gain = value[space - lengths[:n]]
            gain += price[:n]
            k = int(gain.argmax())
            if gain[k] > value[space]:
                value[space], last[space] = gain[k], k
    return last


def _configuration(last: np.ndarray, lengths: np.ndarray, left: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """The table's best configuration that holds length ``first``: {index: count}.  Where it
    asks for more of a length than is left, the longest length that fits stands in."""
    used = {first: 1}
    space = capacity - int(lengths[first])
    while space > 0:
        k = int(last[space])
        if k < 0:
            space -= 1
            continue
        if used.get(k, 0) >= left[k]:
            k = int(np.searchsorted(lengths, space, side="right")) - 1
            while k >= 0 and used.get(k, 0) >= left[k]:
                k -= 1
            if k < 0:
                break
        used[k] = used.get(k, 0) + 1
        space -= int(lengths[k])
    return used


def solve(counts: dict[int, int], capacity: int = CAPACITY, step: float = STEP, rate: float = RATE,
          rest: float = REST) -> list[tuple[dict[int, int], int]]:
    """Configurations with whole multiplicities [({length: count}, how often)] by
    multiplicative weights, for all but a share ``rest`` of the pieces."""
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[int(x)] for x in lengths], np.int64)
    left = need.copy()
    found: dict[tuple, int] = {}
    while left.sum() > rest * need.sum():
        at = np.flatnonzero(left)
        covered = 1 - left[at] / need[at]
        # a length is worth less the more it is covered
        last = _table(lengths[at], lengths[at] * np.exp(-rate * (covered - covered.min())), capacity)
        for first in range(len(at) - 1, -1, -1):
            if not left[at[first]]:
                continue
            config = _configuration(last, lengths[at], left[at], first, capacity)
            k, n = at[list(config)], np.array(list(config.values()))
            often = min(int(np.min(left[k] // n)), max(1, int(step * np.min(need[k] / n))))
            left[k] -= often * n
            key = tuple(sorted(zip(lengths[k].tolist(), n.tolist(), strict=True)))
            found[key] = found.get(key, 0) + often
    return [(dict(k), v) for k, v in found.items()]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram, equal sequences handled together."""
    groups: dict[int, list[list]] = {}  # free space -> [[configuration, how many]]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for free in sorted(f for f in groups if f >= length):
            per = free // length
            for group in groups[free]:
                if not left:
                    break
                full = min(group[1], left // per)
                if full:
                    group[1] -= full
                    left -= per * full
                    groups.setdefault(free - per * length, []).append([group[0] | {length: per}, full])
                if left and group[1]:  # fewer than per are left
                    group[1] -= 1
                    groups.setdefault(free - left * length, []).append([group[0] | {length: left}, 1])
                    left = 0
            groups[free] = [g for g in groups[free] if g[1]]
            if not groups[free]:
                del groups[free]
            if not left:
                break
        per = capacity // length
        if left // per:
            groups.setdefault(capacity - per * length, []).append([{length: per}, left // per])
        if left % per:
            groups.setdefault(capacity - left % per * length, []).append([{length: left % per}, 1])
    return [(c, n) for gs in groups.values() for c, n in gs]


def configurations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole configurations with multiplicities that cover the histogram exactly."""
    left = {int(k): int(v) for k, v in counts.items() if v}
    plan = solve(left, capacity)
    for config, often in plan:
        for k, n in config.items():
            left[k] -= often * n
    return plan + best_fit({k: v for k, v in left.items() if v}, capacity)


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, pieces per sequence, first sequence, offset)."""
    at: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for config, often in plan:
        offset = 0
        for length, n in sorted(config.items(), reverse=True):
            rows.setdefault(length, []).append((at.get(length, 0), n, sequence, offset))
            at[length] = at.get(length, 0) + n * often
            offset += n * length
        sequence += often
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _place_tasks(slots, first_rank: dict[int, int]):
    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                table = slots.value[int(x)]
                r = rank[rows] - first_rank[int(x)]
                s = table[np.searchsorted(table[:, 0], r, side="right") - 1]
                sequence[rows] = s[:, 2] + (r - s[:, 0]) // s[:, 1]
                offset[rows] = s[:, 3] + (r - s[:, 0]) % s[:, 1] * x
            cols = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    cut = stage(pieces(docs, tokenizer, id_col, text_col, capacity, keep_ids), "packing-pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    slots = docs.sparkSession.sparkContext.broadcast(_slots(configurations(counts, capacity)))
    first_rank, total = {}, 0
    for length in sorted(counts):
        first_rank[length], total = total, total + counts[length]
    ranked = global_rank(cut, ["length", "id", "piece", "start", "ids_crc32"], "packing-order")
    longs = [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")]
    placed = ranked.mapInArrow(_place_tasks(slots, first_rank), T.StructType([*cut.schema.fields, *longs]))
    return placed.withColumnRenamed("id", id_col)
