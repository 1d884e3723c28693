"""Document statistics and shingle hashes over whole texts, a document at a time in numpy.

Words are runs without ASCII white space ([^\\x20\\x09-\\x0D]+), which is what bytes.split() cuts at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_SPACES = b" \t\n\v\f\r"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_FOLLOWING = bytes(range(0x80, 0xC0))  # UTF-8 bytes that don't start a code point

#: A random odd base and a random value for each byte, fixed so that hashes agree on every executor.
_rng = np.random.default_rng(20240607)
_BASE = np.uint64(int(_rng.integers(1 << 62)) * 2 + 1)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_OTHER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse, grown as longer texts come."""

    size = 0
    up = down = np.empty(0, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if n > cls.size:
            cls.size = max(n, 1 << 16, 2 * cls.size)
            cls.up, cls.down = _powers(_BASE, cls.size), _powers(_INVERSE, cls.size)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, other: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes [first, last) of each span; `other` is a second, independent one."""
    _Tables.upto(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_OTHER if other else _VALUE)[data] * _Tables.up[: len(data)], out=prefix[1:])
    return mix((prefix[last] - prefix[first]) * _Tables.down[first] + (last - first).astype(np.uint64))


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each window of `size` consecutive words (none if there are fewer)."""
    if len(words) < size:
        return np.empty(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - size + 1], ends[size - 1 :]
    return span_hashes(data, first, last)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that stand twice or more in the text, the first included."""
    hashes = window_hashes(words, size)
    if len(hashes) < 2:
        return 0
    order = np.sort(hashes)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines (split at \\n) with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.encode().strip(_SPACES))
        seen.add(line)
    return n


#: name -> Spark type; the first five are the contract's base statistics.
COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_lines": "long", "n_distinct": "long", "n_upper": "long", "n_digits": "long", "n_punct": "long", "longest_word": "long", "n_wide": "long",
}


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of COLUMNS for one text; all zero for a null or empty one."""
    if not text:
        return (0,) * len(COLUMNS)
    data = text.encode()
    words = data.split()
    deleted = lambda b: len(data) - len(data.translate(None, b))
    n_chars = len(data) - deleted(_FOLLOWING)
    return (
        len(words), n_chars - deleted(_SPACES), deleted(SYMBOLS.encode()), repeated_lines(text), repeated_words(words),
        text.count("\n") + 1, len(set(words)), deleted(_UPPER), deleted(_DIGITS), deleted(_PUNCT), max(map(len, words), default=0), len(data) - n_chars,
    )


def document_statistics(docs: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns named in keep, and COLUMNS; no shuffle."""
    source = need(docs, id_col, *keep, text_col).withColumn(text_col, F.col(text_col).cast("string"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    schema = ", ".join(fields + [f"{k} {v}" for k, v in COLUMNS.items()])
    names = source.columns[:-1] + list(COLUMNS)

    def run(batches):
        for batch in batches:
            found = [statistics(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = zip(*found, strict=True) if found else [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return source.mapInArrow(run, schema)


#: Scale-free features of a document for the quality models, as SQL over COLUMNS.
FEATURES = {
    "log_words": "ln(1D + n_words)", "mean_word": "word_chars / greatest(n_words, 1L)", "symbols": "n_symbols / greatest(n_words, 1L)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1L)", "repeats": "n_repeat_words / greatest(n_words, 1L)",
    "distinct": "n_distinct / pow(greatest(n_words, 1L), 0.75D)", "upper": "n_upper / greatest(word_chars, 1L)", "digits": "n_digits / greatest(word_chars, 1L)",
    "punct": "n_punct / greatest(n_words, 1L)", "words_per_line": "ln(1D + n_words / greatest(n_lines, 1L))", "longest": "ln(1D + longest_word)",
}


def features(stats: DataFrame, *keep: str) -> DataFrame:
    return stats.select(*keep, *[F.expr(f"cast({sql} as double)").alias(name) for name, sql in FEATURES.items()])


def label_sample(labels: DataFrame, target: str, most: int, train_only: bool = True) -> DataFrame:
    """(_id, _y, _h): about `most` labels 0 or 1, the first by hash order; several labels of one id are one row each.

    Only rows below a hash bound go on, and the bound comes from a count, so what is gathered doesn't grow with the table.
    """
    from .common import train_fold

    marks = labels.select(F.col("doc_id").alias("_id"), F.col(target).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    if train_only:
        marks = marks.where(train_fold(F.col("_id")))
    marks = marks.distinct().withColumn("_h", F.xxhash64("_id"))
    n = marks.count()
    share = min(1.0, (most + 6 * most**0.5) / max(n, 1))  # `most` rows at least, but for one case in a thousand million
    return marks if share >= 1 else marks.where(F.pmod("_h", F.lit(1 << 40)) < int(share * (1 << 40)))


def labelled_sample(values: DataFrame, labels: DataFrame, target: str, columns: list[str], most: int, train_only: bool = True):
    """(X, y) of at most `most` labelled rows (the bound is the caller's documented parameter), by hash order.

    Equal rows of one document count once; several labels of one document count as one row each; null labels and ids
    are left out.
    """
    marks = label_sample(labels, target, most, train_only)
    rows = values.join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("_h", "_id", "_y", *columns).distinct()
    got = rows.orderBy(F.pmod("_h", F.lit(1 << 40)), "_id", "_y", *columns).limit(most).drop("_h", "_id").toPandas()
    return got[columns].to_numpy(dtype=float), got["_y"].to_numpy(dtype=float)
