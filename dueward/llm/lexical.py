"""Ranked lexical search: MaxScore over document shards, with bounds on pairs of terms.

Documents are read once: each gives its length and the counts of its terms that some query has (a fixed-size bitmap of
term hashes decides; whatever else slips through is removed by the exact join with the queries' terms). They are dealt by
a hash into shards of about ``SHARD_DOCUMENTS``, or fewer where these have more than ``SHARD_ENTRIES`` terms of queries.
The index of a block of queries holds, per shard, a list per term
(documents and impacts, with the largest impact) and a list per term pair of a query: the documents that hold both, and
the largest joint impact there. A query's terms are paired by falling weight, so that pairs are of like, rare terms.
A shard's index is made and searched by one task, which holds one shard at a time, and the pairs of as many queries as have
``ENTRIES_AT_ONCE`` entries; it is never a row of a table, since such a row is as large as the shard.

In a shard, a pair adds at most the largest of its joint maximum and its terms' own maxima: no document outside the
intersection has both. Units (pairs or single terms) are sorted by that bound. Those whose bounds together stay below the
k-th score known so far cannot bring in a document by themselves: only the other units' lists are merged, and documents
are dropped as soon as their score so far and the bounds of the units left fall short. The intersection lists are read
first, since their joint impacts raise the k-th score early. A first wave over a few shards gives each query a floor
for the others (see ``topk``). Queries go in blocks of about ``TERMS_AT_ONCE`` terms; only a block is on the driver.

A null or termless text has no terms and is not counted in the averages; a null or termless query finds nothing. Every
query row is answered by itself, equal ids included; every document row is a result of its own. Equal scores go to the
smaller id, rows without an id last. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.llm.common import documents_of, stored
from dueward.llm.topk import FOUND, ranked, two_waves

# The contract's terms, weights and length norm.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LENGTH_SHARE = 90

SHARD_DOCUMENTS = 8_192
#: Entries of a shard's term lists, on average, and of the pair lists that are held at a time.
SHARD_ENTRIES = ENTRIES_AT_ONCE = 1 << 20
#: Documents whose counts leave a task together.
DOCUMENTS_AT_ONCE = 512
TERMS_AT_ONCE = 200_000
#: Bits of the bitmap that picks the queries' terms out of the documents; two megabytes whatever the queries.
BITMAP = 1 << 24
CACHE = 200_000
#: Terms longer than this stand under their SHA-256.
LONG_TERM = 40
COUNTS = "row long, id long, n long, terms array<string>, tfs array<int>"
INDEX = ("shard long, ids array<long>, rows array<long>, terms array<int>, ends array<int>, places array<int>, impacts array<long>, "
         "pairs array<int>, joint array<long>, pair_ends array<int>, pair_places array<int>, pair_impacts array<long>")


def _lower(word: str) -> str:
    """A-Z lower-cased and nothing else."""
    return word.lower() if word.isascii() else word.translate(_TO_LOWER)


_TO_LOWER = str.maketrans(UPPER, LOWER)


def keyed(term: str) -> str:
    """The term, or ``#`` and its SHA-256 if it is long; no term begins with ``#``."""
    return term if len(term) <= LONG_TERM else "#" + hashlib.sha256(term.encode()).hexdigest()


def term_counts(table: DataFrame, id_column: str, text_column: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """``COUNTS`` rows: all terms of a text in ``n``, and the counts of those in the bitmap (of all, without one)."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        known: dict[str, str] = {}

        def key(word: str) -> str:
            """The word's key, or nothing if no query has it."""
            term = keyed(_lower(word))
            h = zlib.crc32(term.encode()) % BITMAP
            return term if bitmap is None or bitmap[h >> 3] >> (h & 7) & 1 else ""

        for batch in (whole.slice(k, DOCUMENTS_AT_ONCE) for whole in batches for k in range(0, whole.num_rows, DOCUMENTS_AT_ONCE)):
            sizes, terms, tfs = [], [], []
            for text in batch.column("text"):
                words = find(text.as_py() or "")
                own: Counter = Counter()
                for w, n in Counter(words).items():
                    term = known.get(w)
                    if term is None:
                        if len(known) > CACHE:
                            known.clear()
                        term = key(w)
                        if len(w) <= LONG_TERM:
                            known[w] = term
                    if term:
                        own[term] += n
                sizes.append(len(words))
                terms.append(list(own))
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(sizes, type=pa.int64()),
                 pa.array(terms, type=pa.list_(pa.string())), pa.array(tfs, type=pa.list_(pa.int32()))],
                names=["row", "id", "n", "terms", "tfs"])

    plain = documents_of(table, id_column, text_column).toDF("id", "text")
    return plain.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), "text").mapInArrow(counted, COUNTS)


def term_bitmap(asked: DataFrame) -> np.ndarray:
    """One bit per hash of a query's term, gathered as 64-bit words: at most ``BITMAP / 64`` rows."""
    h = F.crc32(F.col("term").cast("binary")) % BITMAP
    words = asked.select((h / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, CAST(crc32(CAST(term AS BINARY)) % {BITMAP} % 64 AS INT))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP // 64, dtype=np.int64)
    bitmap[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return bitmap.view(np.uint8)


def weight(n: Column, df: Column) -> Column:
    """Thousandths of the logarithm of a term's rarity."""
    return F.floor(F.lit(1000.0) * F.ln((F.lit(2.0) * n + 2.0) / (F.lit(2.0) * df + 1.0))).cast("long")


def weighted_terms(counts: DataFrame, asked: DataFrame) -> tuple[DataFrame, int, int]:
    """``(query, term, df, w)`` of the queries' terms that documents hold, the documents with terms, and all terms."""
    n, total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return stored(asked.join(held, "term").select("query", "term", "df", weight(F.lit(n), F.col("df")).alias("w"))), n, total


class Block:
    """A block of queries: the weights of their terms, and per query the terms paired by falling weight."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        self.terms: dict[str, int] = {}
        self.weights: list[int] = []
        by_query: dict[int, list[tuple[int, str]]] = {}
        for query, term, w in rows:
            if term not in self.terms:
                self.terms[term] = len(self.weights)
                self.weights.append(w)
            if w > 0:
                by_query.setdefault(query, []).append((-w, term))
        self.units: dict[int, list[tuple[int, ...]]] = {}
        for query, own in by_query.items():
            order = [self.terms[t] for _, t in sorted(own)]
            self.units[query] = [tuple(order[k:k + 2]) for k in range(0, len(order), 2)]
        self.pairs = sorted({u for units in self.units.values() for u in units if len(u) == 2})


def term_lists(group: pa.Table, block: Block, n: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's terms of the block, where their lists end, and the lists: places in the shard and impacts."""
    terms, weights = block.terms, np.array(block.weights, dtype=np.int64)
    size = group.column("n").to_numpy()
    norm = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(k) * n // max(total, 1) for k in size], dtype=np.int64)
    held = group.column("terms").combine_chunks()
    offsets = held.offsets.to_numpy()
    names = held.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    number = np.array([terms.get(t, -1) for t in names.dictionary.to_pylist()], dtype=np.int64)
    term = number[names.indices.to_numpy()] if len(names) else np.empty(0, dtype=np.int64)
    tf = group.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
    place = np.repeat(np.arange(len(size), dtype=np.int32), np.diff(offsets))
    kept = term >= 0
    term, tf, place = term[kept], tf[kept], place[kept]
    impact = weights[term] * ((1_000_000_000 * tf) // (1_000 * tf + 8 * norm[place])) if len(term) else np.empty(0, dtype=np.int64)
    order = np.lexsort((place, term))
    term, place, impact = term[order], place[order], impact[order]
    own, first = np.unique(term, return_index=True)
    return own, np.append(first[1:], len(term)), place, impact


def dealt(counts: DataFrame, shards: int) -> DataFrame:
    """The documents with terms, by shard."""
    return counts.where("n > 0").select(F.pmod(F.xxhash64("row"), F.lit(max(1, shards))).alias("shard"), "row", "id", "n", "terms", "tfs")


def build_index(counts: DataFrame, block: Block, n: int, total: int, shards: int) -> DataFrame:
    """The block's index as a table, to look at: a row per shard with the lists of its terms and of its pairs, impacts included."""
    def build(group: pa.Table) -> pa.Table:
        ids, rows = group.column("id").to_pylist(), group.column("row").to_numpy()
        own, ends, place, impact = term_lists(group, block, n, total)
        shard = Shard(ids, rows, own, ends, place, impact)
        shard.hold(block.pairs)
        number = {pair: k for k, pair in enumerate(block.pairs)}
        joint, places, sums = zip(*shard.pairs.values()) if shard.pairs else ((), (), ())
        row = [group.column("shard")[0].as_py(), ids, rows, own, ends, place, impact, [number[p] for p in shard.pairs], list(joint),
               np.cumsum([len(x) for x in places], dtype=np.int64), np.concatenate([np.empty(0, dtype=np.int32), *places]),
               np.concatenate([np.empty(0, dtype=np.int64), *sums])]
        long, short = pa.list_(pa.int64()), pa.list_(pa.int32())
        return pa.Table.from_arrays([pa.array([x], type=t) for x, t in zip(row, (
            pa.int64(), long, long, short, short, short, long, short, long, short, short, long))],
            names=[f.split()[0] for f in INDEX.split(", ")])

    return dealt(counts, shards).groupBy("shard").applyInArrow(build, INDEX)


class Shard:
    """One shard's lists. ``read`` counts the list entries that searches have merged or looked up."""

    def __init__(self, ids, rows, terms, ends, places, impacts, pairs=(), joint=(), pair_ends=(), pair_places=(), pair_impacts=(), pair_names=()):
        self.n, self.rows = len(rows), rows
        self.ids = np.array([2**63 - 1 if k is None else k for k in ids], dtype=np.int64)
        self.named = np.array([k is not None for k in ids])
        starts = np.append(0, ends[:-1])
        self.lists = {int(t): (places[a:b], impacts[a:b]) for t, a, b in zip(terms, starts, ends)}
        self.most = {t: int(own.max()) for t, (_, own) in self.lists.items()}
        starts = [0, *pair_ends[:-1]]
        self.pairs = {pair_names[k]: (int(m), pair_places[a:b], pair_impacts[a:b])
                      for k, m, a, b in zip(pairs, joint, starts, pair_ends)}
        self.scores = np.zeros(self.n, dtype=np.int64)
        self.read = 0

    def hold(self, pairs: Iterable[tuple[int, int]]) -> None:
        """Make the lists of these pairs, in place of any others."""
        self.pairs = {}
        for a, b in pairs:
            if a in self.lists and b in self.lists:
                (in_a, own_a), (in_b, own_b) = self.lists[a], self.lists[b]
                both, at_a, at_b = np.intersect1d(in_a, in_b, assume_unique=True, return_indices=True)
                if len(both):
                    sums = own_a[at_a] + own_b[at_b]
                    self.pairs[a, b] = int(sums.max()), both, sums

    def parts(self, units: dict[int, list[tuple[int, ...]]], entries: int) -> Iterator[dict[int, list[tuple[int, ...]]]]:
        """The queries in parts, for each of which the lists of its pairs are held: of at most so many entries, or of one query."""
        part, held, seen = {}, 0, set()
        for query, own in units.items():
            new = {u for u in own if len(u) == 2 and u not in seen}
            more = sum(min(len(self.lists[t][0]) if t in self.lists else 0 for t in u) for u in new)
            if part and held + more > entries:
                self.hold(sorted(seen))
                yield part
                part, held, seen = {}, 0, set()
                new = {u for u in own if len(u) == 2}
                more = sum(min(len(self.lists[t][0]) if t in self.lists else 0 for t in u) for u in new)
            part[query] = own
            held, seen = held + more, seen | new
        self.hold(sorted(seen))
        yield part

    def bound(self, unit: tuple[int, ...], paired: bool) -> int:
        """The most that a unit adds to a document of this shard."""
        own = [self.most.get(t, 0) for t in unit]
        if not paired or len(unit) == 1:
            return sum(own)
        return max(*own, self.pairs[unit][0] if unit in self.pairs else 0)

    def _kth(self, values: np.ndarray, k: int) -> int:
        return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0

    def top(self, units: list[tuple[int, ...]], floor: int, k: int, paired: bool = True) -> list[tuple[int, int]]:
        """``(score, place)`` of the best ``k`` documents with a score above 0 that reach ``floor``.

        ``paired=False`` bounds every term by itself, as plain MaxScore does.
        """
        units = sorted(((self.bound(u, paired), u) for u in units), reverse=True)
        units = [(b, u) for b, u in units if b > 0]
        bar, scores = floor, self.scores
        if paired:
            for _, u in units:
                if u in self.pairs:
                    _, places, sums = self.pairs[u]
                    scores[places] += sums
                    self.read += len(places)
            bar = max(bar, self._kth(scores[np.flatnonzero(scores)], k))
            scores.fill(0)
        left = np.cumsum([b for b, _ in units][::-1])[::-1].tolist() + [0]  # what units from here on may add together
        at = 0
        while at < len(units) and left[at] >= bar:
            for t in units[at][1]:
                if t in self.lists:
                    places, impacts = self.lists[t]
                    scores[places] += impacts
                    self.read += len(places)
            at += 1
            bar = max(bar, self._kth(scores[np.flatnonzero(scores)], k))
        hit = np.flatnonzero(scores)
        own = scores[hit]
        scores.fill(0)
        for u in range(at, len(units)):
            bar = max(bar, self._kth(own, k))
            able = own + left[u] >= bar
            hit, own = hit[able], own[able]
            for t in units[u][1]:
                if t in self.lists and len(hit):
                    places, impacts = self.lists[t]
                    if len(places) < len(hit):  # search with the shorter side
                        at_hit = np.minimum(np.searchsorted(hit, places), len(hit) - 1)
                        same = hit[at_hit] == places
                        own[at_hit[same]] += impacts[same]
                    else:
                        found = np.minimum(np.searchsorted(places, hit), len(places) - 1)
                        own += np.where(places[found] == hit, impacts[found], 0)
                    self.read += min(len(hit), len(places))
        order = np.lexsort((self.rows[hit], self.ids[hit], -own))[:k]
        return [(int(own[o]), int(hit[o])) for o in order if own[o] > 0 and own[o] >= floor]


def search(documents: DataFrame, block: Block, n: int, total: int, floors: dict[int, int], k: int, entries: int = ENTRIES_AT_ONCE) -> DataFrame:
    """``FOUND`` rows: each shard's best for each query of the block, from an index that the shard's task makes and drops."""
    units = block.units

    def found(group: pa.Table) -> pa.Table:
        shard = Shard(group.column("id").to_pylist(), group.column("row").to_numpy(), *term_lists(group, block, n, total))
        out = [(query, int(shard.ids[p]) if shard.named[p] else None, int(shard.rows[p]), score)
               for part in shard.parts(units, entries) for query, own in part.items() for score, p in shard.top(own, floors.get(query, 0), k)]
        columns = zip(*out) if out else ([],) * 4
        return pa.Table.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["query", "id", "row", "score"])

    return documents.groupBy("shard").applyInArrow(found, FOUND)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", query_id: str = "item_id", text_column: str = "text",
                  shard_documents: int = SHARD_DOCUMENTS, terms_at_once: int = TERMS_AT_ONCE,
                  shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the ``k`` documents with the highest score above 0 for each query row."""
    items = stored(term_counts(queries, query_id, text_column))
    asked = items.select(F.col("row").alias("query"), F.explode("terms").alias("term"))
    counts = stored(term_counts(docs, doc_id, text_column, term_bitmap(asked)))
    weighted, n, total = weighted_terms(counts, asked)
    entries = weighted.select("term", "df").distinct().agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    shards = max(-(-n // shard_documents), -(-entries // shard_entries))
    documents = dealt(counts, shards)
    blocks = -(-weighted.count() // terms_at_once)
    found = None
    for number in range(blocks):
        own = weighted.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number).select("query", "term", "w").orderBy("query", "term")
        block = Block(list(zip(*(c.to_pylist() for c in own.toArrow().columns))))
        part = two_waves(documents, shards, lambda own, floors, block=block: search(own, block, n, total, floors, k), k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], FOUND)
    names = items.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return ranked(found, k).join(names, "query").select(
        F.col("query_id").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")
