"""Periodic runs of words in each document, found in its suffix tree.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and a length of at least
``least`` and 2 * q that no neighbouring word extends. A task strings documents together to blocks, numbers their
words, builds the suffix trees of a block at once (suffix array and common prefixes, NumPy), finds branching tandem
repeats by the smaller halves of its nodes, rotates them left and merges them into maximal runs (``suffix_tree``).
Nothing is shuffled, and documents don't meet. Memory follows the block: ``BLOCK_WORDS`` words, or the longest
document by itself at some 150 bytes a word.

Defined results: a null or empty text, or one of white space, has no words, no runs and an empty collapsed text; null ids
stay null; repeated rows and ids are answered each for itself; an empty table gives an empty result; columns other than id
and text are ignored; texts of any length are taken whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brickyard.llm._shared import named, release, small_batches
from brickyard.llm.suffix_tree import maximal_runs

BLOCK_WORDS = 300_000
RESULT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _blocks(words: list[list[bytes]]):
    """Ranges of documents of about BLOCK_WORDS words."""
    start = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) > BLOCK_WORDS:
            yield start, i
            start, size = i, 0
        size += len(w)
    if start < len(words):
        yield start, len(words)


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside of all runs, and those in the first period of each run that has them."""
    if not len(runs):
        return b" ".join(words)
    turns = np.zeros(len(words) + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(turns[:-1]) == 0).tolist()])


def _runs_of(words: list[list[bytes]], least: int) -> list[np.ndarray]:
    """For each document rows (start, end, period)."""
    sizes = np.array([len(w) for w in words], np.int64)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(x for doc in words for x in doc))}
    symbol = np.fromiter(map(numbers.__getitem__, (x for doc in words for x in doc)), np.int64, int(sizes.sum()))
    sequence = np.repeat(np.arange(len(words)), sizes)
    runs = maximal_runs(sequence, symbol, least) if len(symbol) else np.zeros((0, 3), np.int64)
    offset = np.cumsum(sizes) - sizes
    of = sequence[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    runs[:, :2] -= offset[of][:, None]
    cuts = np.searchsorted(of, np.arange(len(words) + 1))
    return [runs[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _find(least: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            words = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            for a, b in _blocks(words):
                found = _runs_of(words[a:b], least)
                every = np.concatenate(found)
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in found])), pa.int32())
                parts = [pa.array(x, pa.int64()) for x in (every[:, 0], every[:, 1] - every[:, 0], every[:, 2])]
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(_RUNS.value_type)))
                kept = pa.array([_kept(w, r) for w, r in zip(words[a:b], found, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([len(w) for w in words[a:b]], pa.int64()), runs.cast(_RUNS), kept], names=["doc_id", "n_words", "runs", "collapsed"])
        release()

    return run


def periodic_runs(docs: DataFrame, least: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), and collapsed, the
    text's words without those that repeat a run's first period."""
    if least < 2:
        raise ValueError("a run has two words at least")
    small_batches(docs.sparkSession)
    return docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text")).mapInArrow(_find(least), RESULT)
