"""Spelling variants: words one edit apart, found by probing generated edits against length-sharded Bloom filters.

Words and their counts are made on the JVM. The vocabulary is cut into parts of whole word lengths (a length too large for
one part is cut by hash), each with a blocked Bloom filter of at most ``FILTER_BYTES``: a word sets one bit in each of
the eight 64-bit words of one 512-bit block. Filters are made by a ``bit_or`` per block and broadcast, one part at a time.
Every word probes its deletions, and its replacements by a later letter, so each near pair comes up once; edits are
hashed without being written out, from a polynomial hash of the word. Only positives become strings and are shuffled to
the exact join with the vocabulary, which removes the false ones. Both ends of a pair then learn of each other by an
aggregation, and chains of forms are followed by doubling.

A null text has no words. A null id counts as the empty text before the colon. Rows that repeat an id count each
by themselves; extra columns are ignored; an empty table gives an empty result. Equally frequent near words are ordered by
code point. Words of any length are handled: positions are probed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.llm.common import documents_of, stored

# The contract's letters and its way of damaging runs.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 199
SHORTEST, RAREST, TIMES = 6, 5, 5

FILTER_BYTES = 32 << 20
BITS_PER_WORD = 16
#: Words of this length and more share filters.
LONGEST = 64
#: Edits that are hashed at a time.
CELLS = 1 << 21
FIRST_LETTER, LAST_LETTER = 0x41, 0xFF
WORDS = "word string, n long"


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """``(word, n)``: the words of at least ``shortest`` letters that occur at least ``rarest`` times.

    Shorter runs cannot give such a word, so they are not looked at.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    plain = documents_of(docs, id_column, text_column).toDF("id", "text")
    run = plain.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("raw"))
    lowered = run.select("id", F.when(F.col("raw").rlike(r"[À-Þ]"), F.translate("raw", UPPER, LOWER)).otherwise(F.lower("raw")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    hurt = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = lowered.select(F.when(h % DAMAGE == 0, hurt).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rarest)


# ---- hashes -----------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A value per code point; a word's hash is the sum of its letters' values times powers of ``_ODD``.
VALUES = mixed(np.arange(1, 0x102, dtype=np.uint64) * _ODD)


def powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), _ODD, dtype=np.uint64))])[:n]


def codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def hashes(letters: np.ndarray) -> np.ndarray:
    return (VALUES[letters] * powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def slots(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and the bits from which its eight places are taken."""
    x = mixed(h)
    return ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), mixed(x ^ _ODD)


def place(bits: np.ndarray, k: int) -> np.ndarray:
    return (bits >> np.uint64(6 * k)) & np.uint64(63)


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return mixed(h + _ODD) % np.uint64(slices)


def share(length: int) -> int:
    return min(length, LONGEST)


# ---- filters ----------------------------------------------------------------

@dataclass
class Part:
    """Lengths whose words are looked up together; one slice of ``slices`` by hash. ``blocks`` and ``first`` by length."""

    blocks: dict[int, int]
    slices: int = 1
    slice: int = 0

    def first(self) -> dict[int, int]:
        starts, at = {}, 0
        for length, n in self.blocks.items():
            starts[length] = at
            at += n
        return starts


def parts_of(counts: dict[int, int], most_blocks: int) -> list[Part]:
    """Whole lengths together while their filters fit; a larger length by itself, in slices."""
    parts, room = [], 0
    for length, n in sorted(counts.items()):
        blocks = -(-n * BITS_PER_WORD // 512)
        if blocks > most_blocks:
            slices = -(-blocks // most_blocks)
            parts += [Part({length: -(-blocks // slices)}, slices, k) for k in range(slices)]
            room = 0
        elif blocks > room:
            parts.append(Part({length: blocks}))
            room = most_blocks - blocks
        else:
            parts[-1].blocks[length] = blocks
            room -= blocks
    return parts


def filter_of(words: DataFrame, part: Part) -> np.ndarray:
    """The part's filter, eight words a block; its rows on the driver are bounded by ``FILTER_BYTES``."""
    first, blocks, slices, own = part.first(), part.blocks, part.slices, part.slice

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, group in _by_length(batch.column(0).to_pylist()).items():
                if share(length) not in blocks:
                    continue
                h = hashes(codes(group))
                h = h[slice_of(h, slices) == own] if slices > 1 else h
                block, bits = slots(h, blocks[share(length)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.astype(np.int64) + first[share(length)]),
                     *(pa.array((np.uint64(1) << place(bits, k)).view(np.int64)) for k in range(8))],
                    names=["block", *(f"w{k}" for k in range(8))])

    bits = words.select("word").mapInArrow(set_bits, "block long, " + ", ".join(f"w{k} long" for k in range(8)))
    found = bits.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8))).toArrow()
    table = np.zeros((sum(blocks.values()), 8), dtype=np.int64)
    at = found.column("block").to_numpy()
    for k in range(8):
        table[at, k] = found.column(f"w{k}").to_numpy()
    return table.view(np.uint64)


def _by_length(words: list[str]) -> dict[int, list[str]]:
    found: dict[int, list[str]] = {}
    for w in words:
        found.setdefault(len(w), []).append(w)
    return found


# ---- edits ------------------------------------------------------------------

def replacements(letters: np.ndarray, h: np.ndarray, alphabet: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
    """Word, position, letter and hash of every replacement by a later letter at the positions from ``first`` to ``last``."""
    old = letters[:, first:last]
    word, at, new = np.nonzero(alphabet[None, None, :] > old[:, :, None])
    power = powers(last)[first:]
    change = (VALUES[alphabet[new]] - VALUES[old[word, at]]) * power[at]
    return word, at + first, alphabet[new], h[word] + change


def deletions(letters: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word, position and hash of every distinct deletion: of equal letters in a row, the first goes."""
    terms = VALUES[letters] * powers(letters.shape[1])
    before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
    after = (h[:, None] - before - terms) * _INVERSE
    fresh = np.ones(letters.shape, dtype=bool)
    fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
    word, at = np.nonzero(fresh)
    return word, at, (before + after)[word, at]


def probe(words: DataFrame, part: Part, table, alphabet: np.ndarray) -> DataFrame:
    """``(word, n, edit)`` for the edits that the part's filter lets through; ``table`` is the broadcast filter."""
    first, blocks, slices, own = part.first(), part.blocks, part.slices, part.slice

    def positive(h: np.ndarray, length: int) -> np.ndarray:
        """Places in ``h`` that the filter of ``length`` may hold."""
        at = np.flatnonzero(slice_of(h, slices) == own) if slices > 1 else np.arange(len(h))
        block, bits = slots(h[at], blocks[share(length)])
        block = block.astype(np.int64) + first[share(length)]
        for k in range(8):
            hit = (table.value[block, k] >> place(bits, k)) & np.uint64(1) == 1
            at, block, bits = at[hit], block[hit], bits[hit]
        return at

    def edits(group: list[str], length: int) -> Iterator[tuple[int, str]]:
        letters = codes(group)
        h = hashes(letters)
        if share(length) in blocks:
            wide = max(1, CELLS // (len(group) * max(1, len(alphabet))))
            for start in range(0, length, wide):
                word, at, new, changed = replacements(letters, h, alphabet, start, min(length, start + wide))
                for k in positive(changed, length):
                    w = group[word[k]]
                    yield word[k], f"{w[:at[k]]}{chr(new[k])}{w[at[k] + 1:]}"
        if share(length - 1) in blocks:
            word, at, changed = deletions(letters, h)
            for k in positive(changed, length - 1):
                w = group[word[k]]
                yield word[k], w[:at[k]] + w[at[k] + 1:]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for length, group in _by_length(list(counts)).items():
                few = max(1, CELLS // (length * max(1, len(alphabet))))
                for k in range(0, len(group), few):
                    own_group = group[k:k + few]
                    found = [(own_group[w], edit) for w, edit in edits(own_group, length)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w for w, _ in found], type=pa.string()), pa.array([counts[w] for w, _ in found], type=pa.int64()),
                         pa.array([e for _, e in found], type=pa.string())], names=["word", "n", "edit"])

    return words.mapInArrow(probed, "word string, n long, edit string")


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``(word, n, other, other_n)``, each pair of words at one edit once."""
    lengths = words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in lengths.collect()}
    seen = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().agg(
        F.array_sort(F.collect_set("c")).alias("c")).first().c  # of at most 90 letters
    alphabet = np.array([ord(c) for c in seen], dtype=np.uint8)
    found = None
    for part in parts_of(counts, max(1, filter_bytes // 64)):
        table = words.sparkSession.sparkContext.broadcast(filter_of(words, part))
        positives = stored(probe(words, part, table, alphabet))
        table.unpersist()
        found = positives if found is None else found.unionByName(positives)
    if found is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    exact = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.join(exact, found["edit"] == exact["other"]).select("word", "n", "other", "other_n")


# ---- forms ------------------------------------------------------------------

def _best(n: Column, word: Column) -> Column:
    return F.min(F.struct((-n).alias("less"), word.alias("form")))


def followed(forms: DataFrame, longest: int) -> DataFrame:
    """``(word, root)``: the last word of each chain of forms, by doubling; no chain has more than ``longest`` steps."""
    roots, reach = forms.select("word", F.col("form").alias("root")), 1
    while reach < longest:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("last"))
        roots = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("last", "root").alias("root")))
        reach *= 2
    return roots


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST, rarest: int = RAREST,
                      times: int = TIMES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word.

    The form is the most frequent near word, if it is at least ``times`` as frequent; counts grow that much along a
    chain, which bounds its length.
    """
    words = stored(word_counts(docs, id_column, text_column, shortest, rarest).repartition("word"))
    pairs = near_pairs(words, filter_bytes)
    ends = pairs.select(F.explode(F.array(
        F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), _best(F.col("near_n"), F.col("near")).alias("best"))
    far = -F.col("best.less") >= times * F.col("n")
    known = stored(words.join(best, "word", "left").select(
        "word", F.when(far, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, -F.col("best.less")).alias("form_n")))
    most = known.agg(F.max("form_n")).first()[0]
    longest = 0
    while most is not None and rarest * times ** longest <= most:
        longest += 1
    roots = followed(known.where("form IS NOT NULL"), longest)
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
