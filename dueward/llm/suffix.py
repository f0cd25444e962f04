"""Removal of repeated byte strings, by a difference cover and suffix buckets sorted one at a time.

Two suffixes matter to each other only when their first ``length`` bytes agree, so a bucket is ordered by fingerprints
of prefixes rather than by the bytes: equality is all that is asked. The steps:

1. *Cover sample.* The cover D modulo v holds a start i + d and j + d (d < v) for any two starts i and j. Suffixes at
   cover positions are fingerprinted over ``length - v + 1`` bytes, dealt into buckets, and each bucket is sorted by
   itself. A start can only repeat if a sample suffix within the next v bytes is tied; all others leave here.
2. *Sample ranks.* Tied sample suffixes are ranked over the full ``length`` bytes, again bucket by bucket. Ties of
   these ranks settle the inside of long repeats without sorting the suffixes between the samples.
3. *Demand.* Bytes that may repeat and are not yet settled (the ends of a repeat, and repeats shorter than about
   ``length + v``) name the sample classes that they need; every member of such a class hears of it.
4. *Suffix buckets.* All starts next to a demanded sample suffix are dealt into buckets and sorted, one at a time.
   A stretch that is one repeat of an earlier stretch (its ranks all name the same leader at the same distance) leaves
   that to the leader: leaders come first in the order of (text key, position), so one of the equal stretches is sent.

A bucket holds about ``BUCKET_ROWS`` suffixes of a few bytes each, a shard about ``SHARD_BYTES`` of text; their numbers
grow with the input. A string that a third of all rows share is one entry per batch, not per row: a batch settles its
own ties and sends a witness. Texts travel once, by shard; every round reads the same exchange.

Fingerprints are polynomial sums modulo 2^64 over random byte values: 40 bits beside the bucket's for the sample, which
only chooses candidates, and 72 bits beside the bucket's for the decisions.

Null texts count as empty. Rows are told apart by (id, text), so a null or repeated id does no harm; two equal rows
repeat each other. Texts shorter than ``length`` are returned whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dueward.llm.common import documents_of

LENGTH = 400
#: Prime order of the cover: v = q * q + q + 1 residues, q + 1 of them in the cover.
ORDER = 13
SHARD_BYTES = 6 << 20
BATCH_BYTES = 16 << 20
BUCKET_ROWS = 1_500_000
#: Starts of a shard that are sorted together before they are dealt out.
FLUSH_ROWS = 500_000
CHUNK = 1 << 18
#: Bytes of the two fingerprints that decide, beside the bits that the bucket's number holds.
LOW, WIDE = 6, 3
_ENTRY = "bucket int, weight int, shards binary, keys binary, counts binary, pos binary, low binary, high binary"
_REPLY = "shard int, kind int, keys binary, counts binary, pos binary, marks binary"


@cache
def difference_cover(order: int) -> tuple[int, tuple[int, ...]]:
    """(v, D): a perfect difference set, from the zeros of a linear recurrence of degree three modulo ``order``."""
    v = order * order + order + 1
    for c in range(1, order):
        for b in range(order):
            for a in range(order):
                x, y, z = 0, 0, 1
                zeros = []
                for k in range(v):
                    if x == 0:
                        zeros.append(k)
                    x, y, z = y, z, (c * x + b * y + a * z) % order
                if len({(i - j) % v for i in zeros for j in zeros}) == v and len(zeros) == order + 1:
                    return v, tuple(sorted((k - zeros[0]) % v for k in zeros))
    raise ValueError(f"no cover of order {order}")


@cache
def _tables(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of the base, and powers of its inverse."""
    draw = np.random.default_rng(1_000_003 + which)
    values = draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(draw.integers(1 << 61, 1 << 62)) * 8 + 5
    inverse = pow(base, -1, 1 << 64)

    def powers(x: int) -> np.ndarray:
        factors = np.full(CHUNK, x, dtype=np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    return values, powers(base % (1 << 64)), powers(inverse)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Text:
    """Bytes of a text and their prefix sums, which all windows of a chunk share."""

    def __init__(self, data: bytes | None) -> None:
        self.data = np.frombuffer(data or b"", dtype=np.uint8)
        self._sums: dict[tuple[int, int], np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.data)

    def _prefix(self, start: int, which: int) -> np.ndarray:
        if (start, which) not in self._sums:
            if start:
                self._sums.clear()
            values, up, _ = _tables(which)
            part = self.data[start:start + CHUNK]
            sums = self._sums[start, which] = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(values[part] * up[:len(part)], out=sums[1:])
        return self._sums[start, which]

    def prints(self, pos: np.ndarray, length: int, which: int) -> np.ndarray:
        """Fingerprints of ``length`` bytes at sorted positions; long texts go by overlapping chunks."""
        down = _tables(which)[2]
        out = np.empty(len(pos), dtype=np.uint64)
        step = CHUNK - length
        for start in range(0, max(len(self) - length + 1, 0), step):
            first, last = np.searchsorted(pos, (start, start + step))
            if first < last:
                at = pos[first:last] - start
                sums = self._prefix(start, which)
                out[first:last] = _mixed((sums[at + length] - sums[at]) * down[at])
        return out


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of the numbers, plane by plane: planes of zeros compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


class Places:
    """Positions in texts: shard and key of the text, the start, and the leader's mark (0: none), as parallel arrays."""

    def __init__(self, shard: np.ndarray, key: np.ndarray, pos: np.ndarray, mark: np.ndarray | None = None) -> None:
        self.shard, self.key, self.pos = shard, key, pos
        self.mark = np.zeros(len(pos), dtype=np.uint64) if mark is None else mark

    def __len__(self) -> int:
        return len(self.pos)

    def take(self, at: np.ndarray) -> Places:
        return Places(self.shard[at], self.key[at], self.pos[at], self.mark[at])

    @staticmethod
    def joined(parts: list[Places]) -> Places:
        if not parts:
            return Places(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))
        return Places(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("shard", "key", "pos", "mark")))

    def led(self, first: np.ndarray, size: np.ndarray) -> Places:
        """With marks for classes laid end to end, each led by its first place."""
        lead = np.repeat(first, size)
        same = (self.key[lead] == self.key) & (self.pos[lead] == self.pos)
        apart = (self.pos[lead] - self.pos).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        mark = (_mixed(self.key[lead].view(np.uint64) * np.uint64(0xA0761D6478BD642F) + apart) | np.uint64(1)) & np.uint64((1 << 48) - 1)
        return Places(self.shard, self.key, self.pos, np.where(same, np.uint64(0), mark))

    def packed(self, cover: Cover | None = None) -> dict[str, bytes]:
        """One entry per run of a text, and the gaps between its positions, or between their numbers in the cover."""
        pos = self.pos if cover is None else cover.numbered(self.pos)
        new = np.ones(len(self), dtype=bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.shard[1:] != self.shard[:-1]) | (pos[1:] < pos[:-1])
        first = np.flatnonzero(new)
        gaps = np.diff(pos, prepend=0)
        gaps[first] = pos[first]
        return {
            "shards": _planes(self.shard[first].astype(np.uint64), 4), "keys": self.key[first].astype("<i8").tobytes(),
            "counts": _planes(np.diff(np.append(first, len(self))), 4), "pos": _planes(gaps, 4),
        }

    @staticmethod
    def unpacked(shards: bytes | int, keys: bytes, counts: bytes, pos: bytes, cover: Cover | None = None) -> Places:
        n = _numbers(counts, 4).astype(np.int64)
        gaps = _numbers(pos, 4).astype(np.int64)
        total = np.cumsum(gaps)
        first = np.cumsum(n) - n
        starts = total - np.repeat(total[first] - gaps[first], n)
        starts = starts if cover is None else cover.placed(starts)
        key = np.repeat(np.frombuffer(keys, dtype="<i8"), n)
        shard = np.full(len(starts), shards, np.int32) if isinstance(shards, int) else np.repeat(_numbers(shards, 4).astype(np.int32), n)
        return Places(shard, key, starts)


def _arrow_type(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}[kind]


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], type=_arrow_type(k)) for n, k in columns], names=[n for n, _ in columns])


def _by_shard(places: Places, kind: int, cover: Cover | None) -> list[dict]:
    """Reply rows: positions by shard."""
    if not len(places):
        return []
    places = places.take(np.lexsort((places.pos, places.key, places.shard)))
    cut = np.flatnonzero(np.diff(places.shard)) + 1
    rows = []
    for part in np.split(np.arange(len(places)), cut):
        own = places.take(part)
        rows.append({"shard": int(own.shard[0]), "kind": kind, "marks": _planes(own.mark, 6) if kind in (RANKED, DEMANDED) else b""}
                    | {k: v for k, v in own.packed(cover).items() if k != "shards"})
    return rows


def _dealt(places: Places, low: np.ndarray, high: np.ndarray | None, weight: np.ndarray, buckets: int, cover: Cover | None,
           width: int = WIDE) -> list[dict]:
    """Entry rows: one per bucket and weight. Without ``high``, 40 bits beside the bucket's are enough for candidates."""
    bucket = (low >> np.uint64(40)).astype(np.int64) % buckets
    rows = []
    order = np.argsort(bucket * 4 + weight, kind="stable")
    cut = np.flatnonzero(np.diff((bucket * 4 + weight)[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        rows.append({
            "bucket": int(bucket[part[0]]), "weight": int(weight[part[0]]), **places.take(part).packed(cover),
            "low": _planes(low[part], LOW if high is not None and width == WIDE else 5),
            "high": b"" if high is None else _planes(high[part], width),
        })
    return rows


def _settled(places: Places, buckets: int, cover: Cover | None) -> dict:
    """An entry row that a bucket only passes on."""
    at = int(places.key[0]) % buckets
    return {"bucket": at, "weight": -1, **places.packed(cover), "low": _planes(places.mark, 6), "high": b""}


def _in_classes(places: Places, low: np.ndarray, high: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by class, the first of each class, and the classes' sizes.

    With ``high``, a class is in the order of (key, position); only what shares ``low`` is compared further.
    """
    order = np.argsort(low)
    new = np.ones(len(order), dtype=bool)
    new[1:] = low[order][1:] != low[order][:-1]
    if high is not None:
        alike = ~new
        alike[:-1] |= ~new[1:]
        part = order[alike]
        part = part[np.lexsort((places.pos[part], places.key[part], high[part], low[part]))]
        order[alike] = part
        new[1:] |= high[order][1:] != high[order][:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def _entries(places: Places, low: np.ndarray, high: np.ndarray | None, buckets: int, cover: Cover | None) -> list[dict]:
    """Entries of a batch: what repeats within it is settled here and leaves one witness of weight two."""
    if not len(places):
        return []
    order, first, size = _in_classes(places, low, high)
    led = places.take(order).led(first, size)
    witness = np.zeros(len(order), dtype=bool)
    witness[first] = True
    weight = np.zeros(len(order), dtype=np.int64)
    weight[order[first]] = np.minimum(size, 2)
    sent = np.flatnonzero(weight)
    rows = _dealt(places.take(sent), low[sent], None if high is None else high[sent], weight[sent], buckets, cover)
    known = led.take(np.flatnonzero(~witness & ((led.mark > 0) | (high is None))))
    if len(known):
        known = known.take(np.lexsort((known.pos, known.key)))
        rows.append(_settled(known, buckets, cover))
    return rows


def _ties(entries: DataFrame, wide: bool, kind: int, cover: Cover | None) -> DataFrame:
    """Sort one bucket at a time; positions of classes of two or more go back to their shards."""
    def of_bucket(part: pa.Table) -> pa.Table:
        places, low, high, weight, done = [], [], [], [], []
        for r in part.to_pylist():
            own = Places.unpacked(r["shards"], r["keys"], r["counts"], r["pos"], cover)
            if r["weight"] < 0:
                own.mark = _numbers(r["low"], 6)
                done.append(own)
                continue
            places.append(own)
            low.append(_numbers(r["low"], LOW if wide else 5))
            high.append(_numbers(r["high"], WIDE) if wide else None)
            weight.append(np.full(len(own), r["weight"], dtype=np.int64))
        if places:
            order, first, size = _in_classes(every := Places.joined(places), np.concatenate(low), np.concatenate(high) if wide else None)
            total = np.add.reduceat(np.concatenate(weight)[order], first)
            done.append(every.take(order).led(first, size).take(np.repeat(total > 1, size)))
        return pa.Table.from_batches([_batch(_by_shard(Places.joined(done), kind, cover), _REPLY)])

    return entries.groupBy("bucket").applyInArrow(of_bucket, _REPLY)


def _demanded(entries: DataFrame, cover: Cover) -> DataFrame:
    """Members of the classes that anyone needs, marked with the distances from which a start needs them."""
    def of_bucket(part: pa.Table) -> pa.Table:
        places, low, span, weight = [], [], [], []
        for r in part.to_pylist():
            places.append(Places.unpacked(r["shards"], r["keys"], r["counts"], r["pos"], cover))
            low.append(_numbers(r["low"], 5))
            span.append(_numbers(r["high"], 4))
            weight.append(np.full(len(places[-1]), r["weight"], dtype=np.int64))
        order, first, size = _in_classes(every := Places.joined(places), np.concatenate(low), None)
        asked = np.maximum.reduceat(np.concatenate(weight)[order], first) > 0
        every = every.take(order)
        every.mark = np.repeat(_widest(np.concatenate(span)[order], first), size)
        return pa.Table.from_batches([_batch(_by_shard(every.take(np.repeat(asked, size)), DEMANDED, cover), _REPLY)])

    return entries.groupBy("bucket").applyInArrow(of_bucket, _REPLY)


#: Distances of a sample suffix that no start needs: the least is larger than the most.
_NOBODY = np.uint64(0xFFFF)


def _widest(span: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the (least, most) distances, packed in 16 bits each, the widest of each class."""
    least, most = span & np.uint64(0xFFFF), span >> np.uint64(16)
    return np.minimum.reduceat(least, first) | (np.maximum.reduceat(most, first) << np.uint64(16))


_OTHER = 1 << 31


class Cover:
    """The difference cover for one match length."""

    def __init__(self, length: int, order: int) -> None:
        self.v, d = difference_cover(order)
        self.length, self.window = length, length - self.v + 1
        if self.window < 8:
            raise ValueError("the cover is too wide for this length")
        self.d = np.array(d, dtype=np.int64)
        self._at = np.full(self.v, -1, dtype=np.int64)
        self._at[self.d] = np.arange(len(d))

    def numbered(self, pos: np.ndarray) -> np.ndarray:
        """Positions as their numbers in the cover; others above all of those."""
        at = self._at[pos % self.v]
        return np.where(at >= 0, pos // self.v * len(self.d) + at, pos + _OTHER)

    def placed(self, number: np.ndarray) -> np.ndarray:
        return np.where(number < _OTHER, number // len(self.d) * self.v + self.d[number % len(self.d)], number - _OTHER)

    def sample(self, n: int) -> np.ndarray:
        """Cover positions of a text of n bytes, and its last start."""
        if n < self.length:
            return np.empty(0, dtype=np.int64)
        last = n - self.window
        pos = (np.arange(0, last + 1, self.v)[:, None] + self.d[None, :]).ravel()
        pos = pos[pos <= last]
        return np.union1d(pos, [n - self.length])


def _cover_entries(cover: Cover, buckets: int):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, prints, size = [], [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            if places:
                rows = _entries(Places.joined(places), np.concatenate(prints), None, buckets, cover)
                places.clear()
                prints.clear()
                yield _batch(rows, _ENTRY)

        for batch in batches:
            for shard, key, text in zip(batch.column("shard").to_numpy(), batch.column("key").to_numpy(), batch.column("text")):
                data = Text(text.as_py())
                pos = cover.sample(len(data))
                if not len(pos):
                    continue
                places.append(Places(np.full(len(pos), shard, np.int32), np.full(len(pos), key, np.int64), pos))
                prints.append(data.prints(pos, cover.window, 0))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return sampled


_PACK = "shard int, keys binary, ids array<{kind}>, sizes binary, texts binary"


def _packed(kind: pa.DataType):
    """Texts by shard, compressed together: one row per shard and batch."""
    schema = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("ids", pa.list_(kind)), ("sizes", pa.binary()), ("texts", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        press = zstandard.ZstdCompressor(level=3)

        def flushed() -> pa.RecordBatch:
            rows = [{
                "shard": shard, "keys": np.array([k for k, _, _ in own], dtype="<i8").tobytes(), "ids": [i for _, i, _ in own],
                "sizes": np.array([len(t) for _, _, t in own], dtype="<i8").tobytes(), "texts": press.compress(b"".join(t for _, _, t in own)),
            } for shard, own in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        size = 0
        for batch in batches:
            for shard, key, i, text in zip(*(batch.column(c) for c in ("shard", "key", "id", "text"))):
                held.setdefault(shard.as_py(), []).append((key.as_py(), i.as_py(), text.as_py() or b""))
                size += len(held[shard.as_py()][-1][2])
                if size >= BATCH_BYTES:
                    yield flushed()
                    size = 0
        yield flushed()

    return packed


def _texts(packs: pa.Table, keys: Iterable[int] | None = None) -> Iterator[tuple[int, int, object, Text]]:
    """(shard, key, id, text) of the texts that have one of the keys, or of all."""
    wanted = None if keys is None else set(keys)
    if wanted is not None and not wanted:
        return
    open_ = zstandard.ZstdDecompressor()
    for pack in packs.to_pylist():
        own = np.frombuffer(pack["keys"], dtype="<i8")
        ends = np.cumsum(np.frombuffer(pack["sizes"], dtype="<i8"))
        data = None
        for key, i, end, size in zip(own.tolist(), pack["ids"], ends.tolist(), np.diff(ends, prepend=0).tolist()):
            if wanted is None or key in wanted:
                data = open_.decompress(pack["texts"]) if data is None else data
                yield pack["shard"], key, i, Text(data[end - size:end])


def _told(replies: pa.Table, cover: Cover) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """kind -> key of the text -> its sorted positions and their marks."""
    by_kind: dict[int, list[Places]] = {}
    for r in replies.to_pylist():
        own = Places.unpacked(int(r["shard"]), r["keys"], r["counts"], r["pos"], None if r["kind"] == REPEATED else cover)
        if r["marks"]:
            own.mark = _numbers(r["marks"], 6)
        by_kind.setdefault(r["kind"], []).append(own)
    told: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for kind, parts in by_kind.items():
        own = Places.joined(parts)
        own = own.take(np.lexsort((own.mark, own.pos, own.key)))
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own.key[1:] != own.key[:-1]) | (own.pos[1:] != own.pos[:-1])
        own = own.take(np.flatnonzero(new))
        cut = np.flatnonzero(np.diff(own.key)) + 1
        told[kind] = {int(k[0]): (p, m) for k, p, m in zip(*(np.split(x, cut) for x in (own.key, own.pos, own.mark))) if len(k)}
    return told


def _covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def _next_to(n: int, sample: np.ndarray, length: int, least: np.ndarray | int, most: np.ndarray | int) -> np.ndarray:
    """Starts that have a sample suffix from ``least`` to ``most`` bytes further on, as a mask over the starts."""
    inside = sample - least >= 0
    first, last = np.maximum(sample - most, 0)[inside], (sample - least)[inside]
    edge = np.bincount(first, minlength=n + 2) - np.bincount(last + 1, minlength=n + 2)
    return np.cumsum(edge)[:n - length + 1] > 0


def _led_elsewhere(n: int, pos: np.ndarray, mark: np.ndarray, length: int) -> np.ndarray:
    """Starts, as a mask, whose whole string lies in a stretch with one leader that is not the stretch itself."""
    out = np.zeros(n - length + 1, dtype=bool)
    if len(pos):
        cut = np.flatnonzero((mark[1:] != mark[:-1]) | (np.diff(pos) > length)) + 1
        first, last = np.append(0, cut), np.append(cut, len(pos)) - 1
        for a, b, m in zip(pos[first], pos[last], mark[first]):
            if m:
                out[a:b + 1] = True
    return out


TIED, RANKED, DEMANDED, REPEATED = range(4)
_NONE = (np.empty(0, np.int64), np.empty(0, np.uint64))


def _places(shard: int, key: int, pos: np.ndarray) -> Places:
    return Places(np.full(len(pos), shard, np.int32), np.full(len(pos), key, np.int64), pos)


def _rank_entries(cover: Cover, buckets: int):
    def of_shard(packs: pa.Table, replies: pa.Table) -> pa.Table:
        tied = _told(replies, cover).get(TIED, {})
        places, low, high = [], [], []
        for shard, key, _, text in _texts(packs, tied):
            pos = tied[key][0]
            pos = pos[pos + cover.length <= len(text)]
            places.append(_places(shard, key, pos))
            low.append(text.prints(pos, cover.length, 0))
            high.append(text.prints(pos, cover.length, 1))
        rows = _entries(Places.joined(places), np.concatenate(low), np.concatenate(high), buckets, cover) if places else []
        return pa.Table.from_batches([_batch(rows, _ENTRY)])

    return of_shard


def _demand_entries(cover: Cover, buckets: int):
    def of_shard(packs: pa.Table, replies: pa.Table) -> pa.Table:
        told = _told(replies, cover)
        tied, ranked = told.get(TIED, {}), told.get(RANKED, {})
        places, prints, spans = [], [], []
        for shard, key, _, text in _texts(packs, tied):
            pos, n = tied[key][0], len(text)
            bare = np.concatenate(([0], np.cumsum(~_covered(n, ranked.get(key, _NONE)[0], cover.length))))
            last = n - cover.length + 1
            unsettled = np.flatnonzero(_next_to(n, pos, cover.length, 0, cover.v - 1) & (bare[cover.length:] > bare[:last]))
            span = np.full(len(pos), _NOBODY)
            if len(unsettled):
                upto = np.searchsorted(unsettled, pos, side="right") - 1
                since = np.searchsorted(unsettled, pos - cover.v + 1)
                asked = since <= upto
                span[asked] = ((pos - unsettled[upto]).astype(np.uint64) | ((pos - unsettled[np.minimum(since, len(unsettled) - 1)]).astype(np.uint64) << np.uint64(16)))[asked]
            places.append(_places(shard, key, pos))
            prints.append(text.prints(pos, cover.window, 0))
            spans.append(span)
        if not places:
            return pa.Table.from_batches([_batch([], _ENTRY)])
        # One entry per class and shard: the shard knows its own members.
        own, low, span = Places.joined(places), np.concatenate(prints), np.concatenate(spans)
        order, first, _ = _in_classes(own, low, None)
        widest, one = _widest(span[order], first), order[first]
        sort = np.argsort(one)
        one, widest = one[sort], widest[sort]
        rows = _dealt(own.take(one), low[one], widest, (widest != _NOBODY).astype(np.int64), buckets, cover, 4)
        return pa.Table.from_batches([_batch(rows, _ENTRY)])

    return of_shard


def _suffix_entries(cover: Cover, buckets: int):
    def of_shard(packs: pa.Table, replies: pa.Table) -> pa.Table:
        told = _told(replies, cover)
        tied, demanded, ranked = (told.get(k, {}) for k in (TIED, DEMANDED, RANKED))
        rows: list[dict] = []
        places, low, high, size = [], [], [], 0

        def flush() -> None:
            nonlocal size
            if places:
                rows.extend(_entries(Places.joined(places), np.concatenate(low), np.concatenate(high), buckets, None))
            for x in (places, low, high):
                x.clear()
            size = 0

        if demanded:
            found = [(text.prints(demanded[key][0], cover.window, 0), demanded[key][1]) for _, key, _, text in _texts(packs, demanded)]
            classes, spans = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(classes, kind="stable")
            classes, first = np.unique(classes[order], return_index=True)
            spans = _widest(spans[order], first)
            for shard, key, _, text in _texts(packs, tied):
                pos = tied[key][0]
                prints = text.prints(pos, cover.window, 0)
                at = np.minimum(np.searchsorted(classes, prints), len(classes) - 1)
                member = classes[at] == prints
                if not member.any():
                    continue
                span = spans[at[member]].astype(np.int64)
                near = _next_to(len(text), pos[member], cover.length, span & 0xFFFF, span >> 16)
                starts = np.flatnonzero(near & ~_led_elsewhere(len(text), *ranked.get(key, _NONE), cover.length))
                places.append(_places(shard, key, starts))
                low.append(text.prints(starts, cover.length, 0))
                high.append(text.prints(starts, cover.length, 1))
                size += len(starts)
                if size > FLUSH_ROWS:
                    flush()
            flush()
        return pa.Table.from_batches([_batch(rows, _ENTRY)])

    return of_shard


def remove_repeats(docs: DataFrame, length: int = LENGTH, order: int = ORDER, id_column: str = "doc_id",
                   text_column: str = "text", shard_bytes: int = SHARD_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept)``: every byte that a repeated string of ``length`` bytes covers is removed."""
    cover = Cover(length, order)
    chosen = documents_of(docs, id_column, text_column)
    total = chosen.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    shards = int(total // shard_bytes) + 1
    buckets = int(total * (order + 1) // cover.v // bucket_rows) + 1
    kind = docs.schema[id_column].dataType
    texts = chosen.select(
        F.pmod(F.hash(id_column, text_column), F.lit(shards)).alias("shard"), F.xxhash64(id_column, text_column).alias("key"),
        F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    here = texts.mapInArrow(_packed(to_arrow_type(kind)), _PACK.format(kind=kind.simpleString())).groupBy("shard")

    def round_of(replies: DataFrame, step, schema: str) -> DataFrame:
        return here.cogroup(replies.groupBy("shard")).applyInArrow(step, schema)

    tied = _ties(texts.mapInArrow(_cover_entries(cover, buckets), _ENTRY), False, TIED, cover)
    ranked = _ties(round_of(tied, _rank_entries(cover, buckets), _ENTRY), True, RANKED, cover)
    demanded = _demanded(round_of(tied.unionByName(ranked), _demand_entries(cover, buckets), _ENTRY), cover)
    needed = tied.unionByName(ranked).unionByName(demanded)
    repeated = _ties(round_of(needed, _suffix_entries(cover, 2 * buckets), _ENTRY), True, REPEATED, None)
    out_schema = pa.schema([(id_column, to_arrow_type(kind)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(packs: pa.Table, replies: pa.Table) -> pa.Table:
        told = _told(replies, cover)
        out = []
        for _, key, i, text in _texts(packs):
            starts = np.concatenate([told.get(k, {}).get(key, _NONE)[0] for k in (RANKED, REPEATED)])
            gone = _covered(len(text), np.unique(starts), length)
            spans = int(gone[:1].sum()) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            out.append((i, len(text), int(gone.sum()), spans, text.data[~gone].tobytes()))
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out) if out else [[]] * 5, out_schema.types)], schema=out_schema)

    return round_of(ranked.unionByName(repeated), cut,
                    f"`{id_column}` {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
