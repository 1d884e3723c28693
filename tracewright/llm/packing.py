"""Best-fit packing of token pieces into fixed-length sequences by exact-complement hashing.

The pieces are tokenised once and written to the shared folder. Everything that decides the packing
is a histogram of piece lengths (at most `limit` rows, whatever the corpus size): the driver turns it
into patterns (lengths that fill one sequence) with multiplicities. Every pattern leaves some length with
fewer pieces than it needs, so there are a few patterns per length at most, whatever the corpus size, and
the table of slot ranges stays bounded and is broadcast.
Pieces are numbered within their length in parallel (length x salt buckets with prefix sums), and a
piece's number falls into exactly one slot range, which gives its sequence and offset.

Defined results: a null text counts as empty and yields one piece holding only the end id; repeated
rows are packed once per row; an empty table gives an empty result; null ids are kept as rows. Pieces of one
length are ordered by id, piece, start and checksum, so rows that are alike in all of them are interchangeable.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, need

END_ID, LIMIT, SALTS = 2, 1024, 64

#: Below U+0250 and in common punctuation the two tokenizer libraries share character classes for sure;
#: other texts go to the slower library, whose ids are the contract.
_UNSURE = re.compile("[^\\x00-ɏ‐-‧€]")


class Encoder:
    """Token ids of texts by the byte-level BPE of a tokenizers JSON file, as its library gives them without added ones.

    A special token written out in a text is that token's id, as the library has it.

    The .tiktoken file of the same vocabulary gives the same ids several times faster; it is used for
    texts in the character range where both libraries split alike, if it is given.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not _UNSURE.search(text) and not (self.special and self.special.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(total: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` ids: only the first may be short."""
    if total <= limit:
        return [(0, total)]
    first = total % limit
    return ([(0, first)] if first else []) + [(s, limit) for s in range(first, total, limit)]


def tokenize_pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids as binary if with_ids)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        encoder = Encoder(json_path, ranks_path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encoder.ids(text.as_py() or ""), end])
                raw = ids.tobytes()
                for k, (start, length) in enumerate(cut(len(ids), limit)):
                    part = raw[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(part), part)[: len(names)])
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    return need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class ComplementIndex:
    """Available lengths with counts, indexed by single, pair and triple sums."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.left = np.zeros(limit + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def take(self, pattern: tuple[int, ...]) -> int:
        """Use the pattern as often as its lengths allow."""
        uses = Counter(pattern)
        times = min(int(self.left[x]) // k for x, k in uses.items())
        for x, k in uses.items():
            self.left[x] -= times * k
        return times

    def _enough(self, *lengths: int) -> bool:
        return all(self.left[x] >= k for x, k in Counter(lengths).items())

    def complement(self, length: int, gap: int) -> tuple[int, ...] | None:
        """Lengths that together fill the gap exactly beside one piece of `length`: one, else two, else three."""
        if self._enough(length, gap):
            return (gap,)
        live = self.left > 0
        if pair := self._pair(gap, live, (length,)):
            return pair
        for a in np.flatnonzero(live[: max(gap - 1, 0)])[::-1]:
            a = int(a)
            if self._enough(length, a) and (rest := self._pair(gap - a, live, (length, a))):
                return (a, *rest)
        return None

    def _pair(self, gap: int, live: np.ndarray, beside: tuple[int, ...]) -> tuple[int, int] | None:
        if gap < 2:
            return None
        half = np.arange(1, gap // 2 + 1)
        for b in half[live[half] & live[gap - half]]:
            if self._enough(*beside, int(b), gap - int(b)):
                return (gap - int(b), int(b))
        return None


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal bins are kept as one group with a multiplicity.

    A bin whose room holds several pieces of the length at hand takes them all, as one by one best fit would.
    """
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {limit: []}  # by room left
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        for room in sorted(r for r in groups if length <= r < limit):
            each = room // length
            while left and groups[room]:
                pattern, times = groups[room].pop()
                full, rest = min(times, left // each), 0
                if full < times:
                    rest = left - full * each  # fewer than a bin's worth goes to one more bin
                    if kept := times - full - bool(rest):
                        groups[room].append((pattern, kept))
                for n, k in ((each, full), (rest, int(rest > 0))):
                    if k:
                        groups.setdefault(room - n * length, []).append((pattern + (length,) * n, k))
                left -= full * each + rest
                if full < times:
                    break
            if not left:
                break
        each = limit // length
        for n, k in ((each, left // each), (left % each, int(left % each > 0))):
            if k:
                groups.setdefault(limit - n * length, []).append(((length,) * n, k))
    return [g for found in groups.values() for g in found]


def pack_with(counts: dict[int, int], limit: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact complements for pieces of `least` tokens or more, longest first; the rest best-fit."""
    index, found = ComplementIndex(counts, limit), []
    if index.left[limit]:
        found.append(((limit,), index.take((limit,))))
    for length in range(limit - 1, least - 1, -1):
        while index.left[length]:
            if not (rest := index.complement(length, limit - length)):
                break
            found.append(((length, *rest), index.take((length, *rest))))
    return found + best_fit({int(x): int(index.left[x]) for x in np.flatnonzero(index.left)}, limit)


def pack_histogram(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) with multiplicities that use every piece once.

    Complements spend small pieces that best fit may need later, so a few thresholds for the shortest
    piece that asks for complements are tried on the histogram; the fewest sequences win.
    """
    tried = (pack_with(counts, limit, max(1, limit * k // 16)) for k in (0, 2, 4, 6, 8, 10, 12, 14))
    return min(tried, key=lambda found: sum(times for _, times in found))


def slot_ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, stop, times, sequence, offset): piece numbers [first, stop) of a length go here."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, k in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, used[length], used[length] + k * times, times, sequence, offset))
            used[length] += k * times
            offset += k * length
        sequence += times
    return rows


def pack_pieces(pieces: DataFrame, limit: int = LIMIT, salts: int = SALTS) -> DataFrame:
    """pieces with sequence_id and offset added; `pieces` must be stable when read again (see materialize)."""
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `limit` rows
    ranges = slot_ranges(pack_histogram(counts, limit))
    slots = spark.createDataFrame(ranges, "s_length long, s_first long, s_stop long, s_times long, s_sequence long, s_offset long")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)).cast("int"))
    starts = (
        salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .select(F.col("length").alias("b_length"), F.col("_salt").alias("b_salt"), "_base")
    )  # at most limit x salts rows
    numbered = salted.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    numbered = numbered.join(F.broadcast(starts), (F.col("length") == F.col("b_length")) & (F.col("_salt") == F.col("b_salt")))
    numbered = numbered.withColumn("_i", F.col("_base") + F.col("_k"))
    placed = numbered.join(F.broadcast(slots), (F.col("length") == F.col("s_length")) & (F.col("_i") >= F.col("s_first")) & (F.col("_i") < F.col("s_stop")))
    j = F.col("_i") - F.col("s_first")
    return placed.select(
        *pieces.columns,
        (F.col("s_sequence") + j % F.col("s_times")).alias("sequence_id"),
        (F.col("s_offset") + F.expr("(_i - s_first) div s_times") * F.col("s_length")).alias("offset"),
    )


def best_fit_pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents (doc_id, text); see the module's docstring."""
    pieces, _ = materialize(tokenize_pieces(docs, json_path, ranks_path, limit, end_id, with_ids), "pieces")
    return pack_pieces(pieces, limit)
