"""Periodic runs of words by a sparse diagonal recurrence.

A run is a stretch of consecutive words with smallest period q whose length is
at least ``min_words`` and ``min_repeats`` periods, and which no neighbouring
word extends.  The recurrence runs over cells (word, lag): a cell is the match
length of the words with those ``lag`` before them, one more than that of the
word before on the same diagonal, and a diagonal that ends with a sufficient
length is a run.

Filling the cells of all earlier occurrences of every word costs the square of a
frequent word's count, so only cells that can lie on a sufficient diagonal are
filled.  A run of period q has at least ``max(min_words - q, (min_repeats - 1) q)``
matches on its diagonal.  Lags are taken in classes (m/2, m], m a power of two
(the first class is 1..m), and a word takes part in a class only if the m words from
it occur earlier in the text; of these occurrences the nearest one alone is
a cell.  That loses nothing: m words of a run with q <= m hold a whole
period, and the rotations of a smallest period are all different, so within the run the
nearest occurrence is exactly q words back.  For the same reason every
diagonal that is long enough has its smallest period as lag.  There is one cell
at most for a word and class, and a class only looks at words whose m/2 words
recur, so the work is n log n at worst and little more than one pass in usual
texts.  Names of m words come from pairs of names of m/2 words: no hash decides.

Edge cases: a null, empty or blank text has no words and no runs; repeated rows give
repeated results; a null id is kept; extra columns are not read; an empty table gives
an empty result.  Runs never cross documents.  Of a very long text a task holds
its bytes and some arrays with a number for each word, never a list of its words.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices_by_bytes
from .repeats import covered
from .words import text_column, word_chunks

MIN_WORDS = 24
MIN_REPEATS = 3
SLICE_BYTES = 1 << 20
_NO_RUNS = np.empty((0, 3), np.int64)


def _recurring(pos: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions whose key occurs twice or more, the keys' numbers from 0, and how many there are."""
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    keep = times[number] > 1
    return pos[keep], number[keep], len(times)


def _diagonals(pos: np.ndarray, name: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(lag, first word, last word) of the diagonals of one class of lags.

    ``pos`` ascends.  A cell is a word and the lag of its nearest earlier
    occurrence; along a diagonal the match length grows by one from word to word.
    """
    order = np.argsort(name, kind="stable")
    word, before = pos[order][1:], pos[order][:-1]
    lag = word - before
    cell = (name[order][1:] == name[order][:-1]) & (lag > low) & (lag <= high)
    lag, word = lag[cell], word[cell]
    along = np.lexsort((word, lag))
    lag, word = lag[along], word[along]
    starts = np.ones(len(lag), bool)
    starts[1:] = (lag[1:] != lag[:-1]) | (word[1:] != word[:-1] + 1)
    first = np.flatnonzero(starts)
    last = np.append(first[1:], len(lag)) - 1 if len(first) else first
    return lag[first], word[first], word[last]


def find_runs(names: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period.

    ``names`` has a number for each word of one or more documents; words of
    different documents have different numbers.
    """
    if min_repeats < 3:
        raise ValueError("a run has three periods at least")
    n = len(names)
    if not n:
        return _NO_RUNS
    first_class = 1 << max(0, (2 * min_words // 3).bit_length() - 1)
    at = np.full(n, -1, np.int64)
    pos, name, kinds = _recurring(np.arange(n), names)
    m, low, found = 1, 0, []
    while len(pos) and min_repeats * (low + 1) <= n:
        if m >= first_class:
            lag, begin, end = _diagonals(pos, name, low, m)
            start, length = begin - lag, end + m - begin + lag
            long = length >= np.maximum(min_words, min_repeats * lag)
            found.append(np.column_stack((start, length, lag))[long])
            low = m
        # names of 2m words from those of m words
        at[pos] = name
        here = pos[pos + m < n]
        after = at[here + m]
        key = at[here] * kinds + after
        at[pos] = -1
        pos, name, kinds = _recurring(here[after >= 0], key[after >= 0])
        m *= 2
    runs = np.concatenate(found) if found else _NO_RUNS
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, a number for each word); numbers are not shared between texts."""
    fresh, sizes, parts = count(), [], []
    for data in texts:
        number, size = defaultdict(fresh.__next__), 0
        for words in word_chunks(data):
            parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            size += len(words)
        sizes.append(size)
    return np.array(sizes, np.int64), np.concatenate(parts) if parts else np.empty(0, np.int64)


def _kept_text(data: bytes, size: int, runs: np.ndarray) -> bytes:
    """The words outside all runs or in the first period of those that hold them, joined by one blank."""
    if not len(runs):
        return b" ".join(b" ".join(words) for words in word_chunks(data))
    keep, at, parts = ~covered(size, runs[:, 0] + runs[:, 2], runs[:, 0] + runs[:, 1]), 0, []
    for words in word_chunks(data):
        kept = b" ".join(compress(words, keep[at:at + len(words)].tolist()))
        if kept:
            parts.append(kept)
        at += len(words)
    return b" ".join(parts)


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
             min_repeats: int = MIN_REPEATS) -> DataFrame:
    """``id_col, n_words, runs array<struct<start, length, period>>, collapsed`` of every row.

    ``collapsed`` keeps of each run its first period.  A map without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            column, offsets = text_column(batch.column(1))
            for lo, hi in slices_by_bytes(offsets, SLICE_BYTES):
                texts = [column[i].as_buffer().to_pybytes() for i in range(lo, hi)]
                sizes, names = _numbers(texts)
                runs = find_runs(names, min_words, min_repeats)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                cut = np.searchsorted(runs[:, 0], bounds)
                runs[:, 0] -= np.repeat(bounds[:-1], np.diff(cut))
                kept = [_kept_text(x, int(sizes[i]), runs[cut[i]:cut[i + 1]]) for i, x in enumerate(texts)]
                rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in range(3)],
                                                  fields=list(run_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), rows),
                     pa.array(kept, pa.binary()).cast(pa.string())], [id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; ties go to the smallest start, then period (null without runs)."""
    def better(best, x):
        # runs come by start and period, so the first of equals stays
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the strongest run and SHA-256 digests of the runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))),
                                                  F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col`` with every tenth document (by crc32 of its id) made periodic from some word on.

    With h the crc32, g = h // 10 and n words: from word a = g % n on the first
    p = 1 + (n - a) // (3 + g % 8) words repeat to the end.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = docs.select(id_col, text_col, h.alias("h"), F.when(h % 10 == 0, F.filter(
        F.split(F.col(text_col), "[ \\t-\\r]+"), lambda x: x != "")).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    sized = words.withColumn("n", n.cast("long")).withColumn("g", g)
    placed = sized.withColumn("a", F.col("g") % F.greatest(F.col("n"), F.lit(1)))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p, size = (F.col(c).cast("int") for c in ("a", "p", "n"))
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((size - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", 1, a), F.slice(again, 1, size - a)), " ")
    return placed.select(id_col, F.when(F.col("w").isNotNull() & (F.col("n") > 0), planted)
                         .otherwise(F.col(text_col)).alias(text_col))
