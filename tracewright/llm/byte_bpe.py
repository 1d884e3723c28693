"""Byte-level BPE encoding and decoding with ranked merges folded by higher-order functions.

1. Each task splits its texts and numbers the distinct words of a block of texts: a document becomes a run of
   word numbers, a block carries its distinct words. Blocks are written to the shared folder.
2. Words that stand in several blocks are folded once (the HEAD of them found in most blocks) and travel to the
   workers as a broadcast of bounded size, sorted by hash. All other words are folded once in their block.
3. A document's results are put together from those of its words.

The fold goes over the word's bytes with the rank map as a literal of the plan. The state is an array of one
integer a token: the rank of its merge with the next token, its place and its id, so the smallest one is the
leftmost lowest-ranked merge. It starts as one token a byte, laid out with the ranks of neighbouring bytes; every merge
is the fold's. The rank map is a perfect hash of the mergeable pairs of ids. Arrays are joined by
flatten, as concat is slow where expressions are interpreted. Words of more than LONG bytes keep their state in blocks, so that a merge touches a few blocks only.
A block's words go to the fold in rows of ROW_TOKENS bytes, so that no task holds the states of a whole block.

Defined results: null and empty texts have no ids; decoding gives back the text's UTF-8 bytes; repeated
rows are encoded one by one; words of any length are folded whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, need
from .textstats import span_hashes

HEAD, HEAD_BYTES = 393_216, 40
BLOCK_BYTES = 8 << 20
LONG, PART = 256, 1024
ROW_TOKENS = 32_768
PLAN_TEXT = 65_536
BATCH_BYTES = 8 << 20

#: A token's integer: rank (ID bits), place (PLACE bits), id (ID bits), from the highest bit down.
ID, PLACE = 18, 27
TOP = ID + PLACE
NONE = (1 << ID) - 1  # no such merge
EDGE = 256  # stands for the ends of a word, beside its byte values

#: Texts of these code points only are split by the standard library with the classes written out; others by `regex`.
_PLAIN = re.compile("[\\x00-\\x7f\\xa1-\\xa9\\xab-\\xac\\xae-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf-\\u024f\\u2010-\\u2027]*")
_LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_SPACE = "\\t\\n\\v\\f\\r "


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def splitter(pattern: str):
    """A function from a text to its words by the pattern (each match of it)."""
    import regex

    whole = regex.compile(pattern)
    plain = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{_SPACE}{_LETTER}0-9]").replace("\\p{L}", f"[{_LETTER}]").replace("\\p{N}", "[0-9]")
    plain = re.compile(plain.replace("\\S", f"[^{_SPACE}]").replace("\\s", f"[{_SPACE}]"))

    def split(text: str) -> list[str]:
        return (plain if (text.isascii() or _PLAIN.fullmatch(text)) and "\x1c" not in text and "\x1d" not in text and "\x1e" not in text and "\x1f" not in text else whole).findall(text)

    return split


class PairTable:
    """The mergeable pairs of ids as a perfect hash: a pair's bucket has a shift, its place exclusive-or the shift is its slot.

    A slot holds the pair and its merged id, so that any other pair is told from it. `edge` is an id that merges with
    nothing, for the ends of a word.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= NONE - 1:
            raise ValueError(f"ids must be below {NONE - 1}")
        self.edge = max(ranks.values()) + 1
        self.first = np.array([*(ranks[bytes([k])] for k in range(256)), self.edge], dtype=np.int64)  # by byte; EDGE is none
        self.next = np.full((EDGE + 1) ** 2, NONE, dtype=np.int32)  # rank by two bytes
        for piece, rank in ranks.items():
            if len(piece) == 2:
                self.next[piece[0] * (EDGE + 1) + piece[1]] = rank
        found = [(a, b, rank) for piece, rank in ranks.items() for k in range(1, len(piece)) if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None]
        left, right, merged = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64),) * 3
        self.size = 1 << max(4, int(1.25 * len(found)).bit_length())  # as small as is quickly found: the table is part of plans
        self.buckets = self.size >> 2
        rng = np.random.default_rng(1)
        while True:  # until no two pairs share both bucket and place
            self.left, self.right = (int(x) * 2 + 1 for x in rng.integers(1 << 39, 1 << 40, 2))
            mixed = left * self.left + right * self.right
            bucket, place = (mixed >> 20) & (self.buckets - 1), (mixed >> 39) & (self.size - 1)
            if len(np.unique(bucket * self.size + place)) == len(found):
                break
        self.shift, self.slots = np.zeros(self.buckets, dtype=np.int64), np.full(self.size, (self.edge << ID | self.edge) << ID, dtype=np.int64)
        taken = np.zeros(self.size, dtype=bool)
        order = np.argsort(bucket, kind="stable")
        names, at, counts = np.unique(bucket[order], return_index=True, return_counts=True)
        for k in np.argsort(-counts, kind="stable"):
            own = order[at[k] : at[k] + counts[k]]
            n = 16
            while True:
                tries = rng.integers(0, self.size, n)
                fits = tries[~taken[place[own][None, :] ^ tries[:, None]].any(axis=1)]
                if len(fits):
                    break
                n = min(4 * n, 65_536)
            self.shift[names[k]] = fits[0]
            taken[place[own] ^ fits[0]] = True
            self.slots[place[own] ^ fits[0]] = (left[own] << ID | right[own]) << ID | merged[own]

    def rank(self, a: Column, b: Column, shifts: Column, slots: Column) -> Column:
        """The merged id of the pair, or NONE."""
        mixed = a * _long(self.left) + b * _long(self.right)
        shift = shifts[F.shiftright(mixed, 20).bitwiseAND(_long(self.buckets - 1))]
        slot = slots[F.shiftright(mixed, 39).bitwiseAND(_long(self.size - 1)).bitwiseXOR(shift)]
        return F.least(slot.bitwiseXOR(F.shiftleft(F.shiftleft(a, ID).bitwiseOR(b), ID)), _long(NONE))


def _literal(values) -> Column:
    return F.from_json(F.lit(json.dumps([int(x) for x in values], separators=(",", ":"))), "array<bigint>")


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _let(value: Column, kind: str, body) -> Column:
    """body(value) of the type `kind`, value being computed once.

    A fold over one element: reading an element of a transformed array would work out the type of the whole body anew
    for every word.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x))


def encode_words(words: Column, table: PairTable) -> Column:
    """array<array<bigint>> last states (see final_ids) of an array of words, each in its first state (see first_states).

    The rank map is bound once, as variables of outer lambdas, so the plan and each task hold one copy.
    """
    kind = "array<array<bigint>>"

    def bound(shifts, slots):
        return F.transform(words, lambda w: _encode_word(w, lambda a, b: table.rank(a, b, shifts, slots)))

    return _let(_literal(table.shift), kind, lambda y: _let(_literal(table.slots), kind, lambda z: bound(y, z)))


def _encode_word(word: Column, rank) -> Column:
    """The state of a word between its edges in which the lowest-ranked pair was merged, leftmost first, until none is left."""
    state, parts = "array<bigint>", "array<struct<m:bigint,e:array<bigint>>>"
    least = _long(NONE << TOP)
    id_of = lambda e: e.bitwiseAND(_long(NONE))
    ranked = lambda e, r: F.shiftleft(r, TOP).bitwiseOR(e.bitwiseAND(_long((1 << TOP) - 1)))

    def joined(m, after):
        """The token that the merge m makes, before the token `after`."""
        new = F.shiftright(m, TOP)
        placed = m.bitwiseAND(_long(((1 << TOP) - 1) ^ NONE)).bitwiseOR(new)
        return F.shiftleft(rank(new, id_of(after)), TOP).bitwiseOR(placed)

    def merged(a, m, i):
        """The token before the merge m at i, with its new rank, and the token that it makes."""
        left = a[i - 2]
        return F.array(ranked(left, rank(id_of(left), F.shiftright(m, TOP))), joined(m, a[i + 1]))

    def step(a, _):
        def merge(m):
            def at(i):
                return F.flatten(F.array(F.slice(a, 1, i - 2), merged(a, m, i), F.slice(a, i + 2, F.size(a))))

            return F.when(m >= least, a).otherwise(_let(F.array_position(a, m).cast("int"), state, at))

        return _let(F.array_min(a), state, merge)

    def cut(a):
        piece = lambda j: F.slice(a, j * PART + 1, PART)
        return F.transform(F.sequence(F.lit(0), F.expr("0") + ((F.size(a) - 1) / PART).cast("int")), lambda j: F.struct(F.array_min(piece(j)).alias("m"), piece(j).alias("e")))

    def long_step(bs, _):
        """Like step, on a run of blocks: the merge's block, the one before it and the two after it are made anew."""

        def merge(m):
            def inside(w):
                def at(i):
                    return _let(F.flatten(F.array(F.slice(w, 1, i - 2), merged(w, m, i), F.slice(w, i + 2, F.size(w)))), parts, cut)

                return _let(F.array_position(w, m).cast("int"), parts, at)

            def around(k):
                low = F.greatest(k - 1, F.lit(1))
                window = F.flatten(F.transform(F.slice(bs, low, k - low + 3), lambda b: b["e"]))
                return F.concat(F.slice(bs, 1, low - 1), _let(window, parts, inside), F.slice(bs, k + 3, F.size(bs)))

            return F.when(m >= least, bs).otherwise(_let(F.array_position(F.transform(bs, lambda b: b["m"]), m).cast("int"), parts, around))

        return _let(F.array_min(F.transform(bs, lambda b: b["m"])), parts, merge)

    size = F.size(word) - 2
    steps = F.slice(word, 1, F.greatest(size - 1, F.lit(0)))
    folded = F.aggregate(steps, word, step)
    in_parts = F.aggregate(steps, _let(word, parts, cut), long_step, lambda bs: F.flatten(F.transform(bs, lambda b: b["e"])))
    return F.when(size > LONG, in_parts).otherwise(folded)


class _Numbers(dict):
    """Words to their numbers, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


_BLOCK = "doc_ids array<long>, sizes array<int>, codes binary, words array<binary>"


def word_blocks(texts: DataFrame, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block of texts (doc_id, text): ids and word counts of its documents, all word numbers, the distinct words."""

    def run(batches):
        split = splitter(pattern)
        numbers, ids, sizes, codes, room = _Numbers(), [], [], [], 0

        def row():
            words = [w.encode() for w in numbers]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(codes)], pa.binary()), pa.array([words], pa.list_(pa.binary()))],
                names=["doc_ids", "sizes", "codes", "words"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = array("I", map(numbers.__getitem__, split(text)))
                ids.append(doc_id)
                sizes.append(len(found))
                codes.append(found.tobytes())
                room += len(text)
                if room >= block_bytes:
                    yield row()
                    numbers, ids, sizes, codes, room = _Numbers(), [], [], [], 0
        if ids:
            yield row()

    return texts.mapInArrow(run, _BLOCK)


def frequent_words(blocks: DataFrame, most: int = HEAD, longest: int = HEAD_BYTES) -> DataFrame:
    """The words that stand in most blocks, `most` at most, each in two blocks or more and none over `longest` bytes.

    Cut at a step of a logarithmic scale of counts.
    """
    counts = blocks.select(F.explode("words").alias("word")).where(F.octet_length("word") <= longest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts, _ = materialize(counts.withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")), "words")
    left, cut = most, None
    for row in sorted(counts.groupBy("step").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["step"]):  # about a thousand rows at most
        if row["words"] > left:
            break
        left, cut = left - row["words"], row["step"]
    return counts.where(F.lit(False) if cut is None else F.col("step") >= cut).select("word")


def _sorted_words(words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, ends of ids, ids), by hash."""
    h1, h2 = _hashes(*_word_buffers(words))
    order = np.argsort(h1, kind="stable")
    n = sizes[order]
    ends = np.cumsum(n)
    shift = ((np.cumsum(sizes) - sizes)[order] - (ends - n)).astype(np.int32)  # ids of the sorted words, from where they stood
    flat = ids[np.repeat(shift, n) + np.arange(int(n.sum()), dtype=np.int32)]
    return h1[order], h2[order], ends.astype(np.int32), flat.astype("<u4")


def _hashes(data: np.ndarray, sizes: np.ndarray, rows: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word; some rows at a time, as the sums take many times the room of the words."""
    ends, out = np.concatenate([[0], np.cumsum(sizes)]), np.empty((2, len(sizes)), dtype=np.uint64)
    for s in range(0, len(sizes), rows):
        cut = ends[s : s + rows + 1] - ends[s]
        part = data[ends[s] : ends[s] + cut[-1]]
        for k in (0, 1):
            out[k, s : s + rows] = span_hashes(part, cut[:-1], cut[1:], other=k == 1)
    return out[0], out[1]


#: The last broadcast used, kept while a worker serves other functions in between.
_KEPT: dict[str, tuple] = {}


def _known(sent, key: str):
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = sent.value
    return _KEPT[key]


def word_runs(words: pa.Array, tokens: int = ROW_TOKENS) -> list[pa.Array]:
    """words in order, cut into runs of about `tokens` bytes and edges, one at least; a run goes beyond them by a word at most."""
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(_word_buffers(words)[1] + 2) // tokens)) + 1).tolist(), len(words)]
    return [words.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def first_states(words: pa.Array, first: np.ndarray, following: np.ndarray) -> pa.ListArray:
    """States of binary words between two edges: one token a byte (PairTable.first and .next)."""
    data, sizes = _word_buffers(words)
    flat = np.full(len(data) + 2 * len(sizes) + 1, EDGE, dtype=np.int64)
    flat[np.arange(len(data)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)] = data
    ends = np.concatenate([[0], np.cumsum(sizes + 2)])
    rank = following[flat[:-1] * (EDGE + 1) + flat[1:]].astype(np.int64)
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes + 2)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rank << TOP | place << ID | first[flat[:-1]]))


def final_ids(states: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and their counts, without the edges."""
    if not len(states):
        return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
    sizes = np.asarray(states.value_lengths(), dtype=np.int64)
    flat = (np.asarray(states.flatten()) & NONE).astype("<u4")
    inner, ends = np.ones(len(flat), dtype=bool), np.cumsum(sizes)
    inner[ends - 1] = inner[ends - sizes] = False
    return flat[inner], sizes - 2


def _word_buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of a binary array."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]] if len(words) else np.empty(0, dtype=np.uint8)
    return data, np.diff(ends)


class Ids:
    """What encode() returns by default: ids as binary, little-endian unsigned 32-bit."""

    fields = (("ids", "binary", pa.binary()),)

    def words(self, flat: np.ndarray, ends: list[int]) -> None:
        raw = flat.astype("<u4", copy=False).tobytes()
        self.raw = [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]

    def document(self, codes: list[int]) -> tuple:
        return (b"".join(map(self.raw.__getitem__, codes)),)


class Digests:
    """The contract's columns: count and digest of the ids, digest of the bytes they decode to."""

    fields = (("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string()))

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = self.names = None

    def words(self, flat: np.ndarray, ends: list[int]) -> None:
        if self.pieces is None:
            self.pieces = pieces_of(self.ranks)
            self.names = [b"%d" % k for k in range(len(self.pieces))]
        numbers = flat.tolist()
        parts = [numbers[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.counts = list(map(len, parts))
        self.decimal = [b",".join(map(self.names.__getitem__, x)) for x in parts]
        self.decoded = [b"".join(map(self.pieces.__getitem__, x)) for x in parts]

    def document(self, codes: list[int]) -> tuple:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return sum(map(self.counts.__getitem__, codes)), sha(b",".join(map(self.decimal.__getitem__, codes))), sha(b"".join(map(self.decoded.__getitem__, codes)))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, head: int = HEAD, result=None, block_bytes: int = BLOCK_BYTES, rows_out: int = 512, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """doc_id and the columns of `result` (Ids() if None, or Digests(ranks)) of every text."""
    result = result or Ids()
    texts = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pairs = PairTable(ranks)
    # the rank map is part of the plan; the driver need not keep its text for every query it has run
    conf = docs.sparkSession.conf
    asked = re.fullmatch(r"(\d+)b?", conf.get("spark.sql.maxPlanStringLength"))
    if asked and int(asked[1]) > PLAN_TEXT:
        conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # else all blocks of a task travel at once
    # a block is one row, so that it is never split; row groups may close after any of them
    blocks, _ = materialize(word_blocks(texts, pattern, block_bytes), "blocks", **{"compression": "zstd", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})
    words = frequent_words(blocks, head)
    whole = docs.sparkSession.createDataFrame(pa.table({"piece": pa.array(ranks, pa.binary())}))
    words = words.join(F.broadcast(whole), F.col("word") == F.col("piece"), "left_anti")  # pieces are their own ids

    first, following = pairs.first, pairs.next

    def spell(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), first_states(batch.column(0), first, following)], names=["word", "state"])

    spelled = words.mapInArrow(spell, "word binary, state array<bigint>")
    folded, _ = materialize(spelled.select("word", encode_words(F.array("state"), pairs)[0].alias("state")), "head")

    def spelt(batches):
        for batch in batches:
            flat, sizes = final_ids(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.view("<i4")))], names=["word", "ids"])

    found = folded.mapInArrow(spelt, "word binary, ids array<int>").toArrow()  # at most `head` words of HEAD_BYTES and as many ids
    ids = found.column("ids").combine_chunks()
    sizes = np.asarray(ids.value_lengths(), dtype=np.int64) if len(found) else np.empty(0, dtype=np.int64)
    flat = np.asarray(ids.flatten(), dtype="<u4") if len(found) else np.empty(0, dtype="<u4")
    table = _sorted_words(
        pa.concat_arrays([pa.array(ranks, pa.binary()), found.column("word").combine_chunks().cast(pa.binary())]), np.concatenate([np.array(list(ranks.values()), dtype="<u4"), flat]), np.concatenate([np.ones(len(ranks), dtype=np.int64), sizes])
    )
    del found, ids, sizes, flat
    # what finds the words and what they become travel apart, as no worker needs both at once
    sent_hashes, sent_ids = (docs.sparkSession.sparkContext.broadcast(x) for x in (table[:2], table[2:]))
    hashes_key, ids_key = uuid.uuid4().hex, uuid.uuid4().hex
    del table

    looked_at = [pa.field("doc_ids", pa.list_(pa.int64())), pa.field("sizes", pa.list_(pa.int32())), pa.field("codes", pa.binary()), pa.field("place", pa.binary())]

    def look_up(batches):
        h1, h2 = _known(sent_hashes, hashes_key)
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(3)[k].values
                a, b = _hashes(*_word_buffers(words))
                at = np.minimum(np.searchsorted(h1, a), len(h1) - 1)
                there = (h1[at] == a) & (h2[at] == b)
                place = np.where(there, at, -1).astype("<i8")
                runs = word_runs(words.filter(pa.array(~there)), row_tokens)
                for n, run in enumerate(runs, 1):  # the block itself comes with the last of its words
                    states = first_states(run, first, following)
                    own = [c.slice(k, 1) for c in batch.columns[:3]] + [pa.array([place.tobytes()], pa.binary())] if n == len(runs) else [pa.nulls(1, f.type) for f in looked_at]
                    yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array([0, len(states)], pa.int32()), states)], names=[*(f.name for f in looked_at), "absent"])

    names = ["doc_id", *[f[0] for f in result.fields]]
    kinds = [pa.int64(), *[f[2] for f in result.fields]]

    def fill(batches):
        ends, flat = _known(sent_ids, ids_key)
        parts = []
        for batch in batches:
            for k in range(batch.num_rows):
                parts.append(final_ids(batch.column(4)[k].values))
                if not batch.column(3)[k].is_valid:
                    continue
                place = np.frombuffer(batch.column(3)[k].as_py(), dtype="<i8")
                own, sizes = map(np.concatenate, zip(*parts, strict=True))
                parts = []
                there = place >= 0
                n, start = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
                n[there] = ends[place[there]] - np.where(place[there] > 0, ends[place[there] - 1], 0)
                start[there] = ends[place[there]] - n[there]
                n[~there], start[~there] = sizes, len(flat) + np.cumsum(sizes) - sizes
                stop = np.cumsum(n)
                every = np.concatenate([flat, own])[np.repeat(start - (stop - n), n) + np.arange(int(n.sum()))]
                result.words(every, stop.tolist())
                codes = np.frombuffer(batch.column(2)[k].as_py(), dtype="<u4")
                ids, counts = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                at, rows = 0, []
                for doc_id, count in zip(ids, counts, strict=True):
                    rows.append((doc_id, *result.document(codes[at : at + count].tolist())))
                    at += count
                    if len(rows) >= rows_out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    looked = blocks.mapInArrow(look_up, "doc_ids array<long>, sizes array<int>, codes binary, place binary, absent array<array<bigint>>")
    done = looked.select("doc_ids", "sizes", "codes", "place", encode_words(F.col("absent"), pairs).alias("folded"))
    return done.mapInArrow(fill, "doc_id long, " + ", ".join(f"{n} {t}" for n, t, _ in result.fields))


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded with bytes: the binary pieces of the ids, concatenated."""
    pieces = pieces_of(ranks)

    def run(batches):
        for batch in batches:
            found = [b"".join(map(pieces.__getitem__, np.frombuffer(x.as_py(), dtype="<u4").tolist())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")
