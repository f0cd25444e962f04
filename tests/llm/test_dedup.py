"""Exact dedup, SimHash near-dedup, byte-string dedup and line dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from dueward.llm import exact, lines, simhash, suffix
from dueward.llm.components import connected_components
from tests.llm.conftest import EDGE_TEXTS


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


# ---- exact ------------------------------------------------------------------

@pytest.mark.parametrize("clash", [False, True])
def test_exact_groups_equal_brute_force(docs_of, clash):
    rows = EDGE_TEXTS + [(100 + i, f"copy {i % 7}") for i in range(40)]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    expected = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        expected.append((i, keep, len(ids), i == keep, sha(norm(t).encode())))
    found = exact.exact_groups(docs_of(rows, clash))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_texts_of_equal_length_and_prefix_stay_apart(docs_of):
    a, b = "p" * 200 + "a", "p" * 200 + "b"
    found = {r.doc_id: r.keep_id for r in exact.exact_groups(docs_of([(1, a), (2, b), (3, a)])).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


# ---- SimHash ----------------------------------------------------------------

def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(values, budget):
    values = np.array(values, dtype=np.uint64)
    label = [-1] * len(values)
    for i in range(len(values)):
        if label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                for y in np.flatnonzero(np.bitwise_count(values ^ values[stack.pop()]) <= budget):
                    if label[y] < 0:
                        label[y] = i
                        stack.append(y)
    return label


@pytest.mark.parametrize("clash", [False, True])
def test_near_duplicates_equal_brute_force(docs_of, clash):
    random.seed(3)
    base = [" ".join(random.choice(("Ab", "cd", "EF", "gh", "ij")) for _ in range(60)) for _ in range(12)]
    rows = EDGE_TEXTS + [(200 + i, base[i % 12] + (" end" if i % 3 else "")) for i in range(60)]
    prints = [fingerprint(t) for _, t in rows]
    label = components(prints, 2)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    expected = [(i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, label)]
    found = simhash.near_duplicates(docs_of(rows, clash)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_words_are_hashed_like_the_builtin_function(spark):
    assert spark.sql("SELECT xxhash64('ab c é')").first()[0] % 2**64 == xxhash.xxh64_intdigest("ab c é".encode(), 42)


@pytest.mark.parametrize("pair_rows", [1 << 15, 64])
def test_trie_walk_loses_no_link(spark, pair_rows):
    rng = random.Random(pair_rows)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(30):
            y = x
            for _ in range(rng.randint(0, 5)):
                y ^= 1 << rng.randrange(64)
            values.add(y)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    root = {r.node: r.root for r in connected_components(simhash.linked(prints, 2, pair_rows)).collect()}
    found, expected = collections.defaultdict(list), collections.defaultdict(list)
    for k, c in enumerate(components(values, 2)):
        expected[c].append(k)
        found[root.get(signed[k], signed[k])].append(k)
    assert sorted(found.values()) == sorted(expected.values())


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(5, 5), (None, 7), (300, 301), (300, 301)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- byte strings -----------------------------------------------------------

def repeats(rows, length):
    where = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        where.update(b[k:k + length] for k in range(len(b) - length + 1))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if where[b[k:k + length]] > 1:
                gone[k:k + length] = True
        gone = gone[:-1]
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        yield i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize(("length", "order", "shard"), [(60, 5, 1 << 12), (40, 3, 1 << 20)])
def test_repeated_strings_equal_brute_force(docs_of, length, order, shard):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    pool = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(25)]
    rows = [
        (i, " ".join(rng.choice(pool) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 40)))
                     for _ in range(rng.randint(0, 8)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "ab" * 500), (1003, "x" * (length - 1)), (None, rows[3][1])]
    rows += [(2000 + k, rows[7][1]) for k in range(20)] + [(2000, rows[7][1]), (5, rows[7][1] + "!")]
    found = suffix.remove_repeats(docs_of(rows, True), length, order, shard_bytes=shard, bucket_rows=3_000).collect()
    ours = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=str)
    assert ours == sorted(repeats(rows, length), key=str)


@pytest.mark.parametrize("order", [2, 3, 5, 7, 17])
def test_every_difference_is_covered(order):
    v, d = suffix.difference_cover(order)
    assert {(a - b) % v for a in d for b in d} == set(range(v)) and 0 in d and len(d) == order + 1


def test_prints_do_not_depend_on_chunks(monkeypatch):
    data = random.Random(1).randbytes(2_000) * 3
    pos = np.arange(0, len(data) - 400, 5)
    classes = lambda x: np.unique(x, return_inverse=True)[1]
    plain = classes(np.array([data[p:p + 400] for p in pos]))
    assert len(set(zip(plain, suffix.Text(data).prints(pos, 400, 0)))) == len(set(plain))
    monkeypatch.setattr(suffix, "CHUNK", 1 << 10)
    suffix._tables.cache_clear()
    parts = suffix.Text(data).prints(pos, 400, 0)
    suffix._tables.cache_clear()
    assert len(set(zip(plain, parts))) == len(set(plain)) == len(set(parts))


# ---- lines ------------------------------------------------------------------

def test_lines_on_many_sites_go(docs_of):
    rows = [(i, f"own {i}\n  Follow   us\n\nnear", f"site{i % 6}") for i in range(12)]
    rows += [(50 + i, "four sites only\nthe end", f"site{i}") for i in range(4)] + [(90, None, "a"), (91, "", None), (None, "x\nFollow us", None)]
    found = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.without_boilerplate(docs_of(rows, True)).collect()}
    assert found[0] == (4, 2, "own 0\n") and found[50] == (2, 0, "four sites only\nthe end")
    assert found[90] == (1, 0, "") and found[91] == (1, 0, "") and found[None] == (2, 1, "x") and len(found) == len(rows)


def test_spread_near_the_threshold_is_counted_exactly(spark):
    rows = [(line, site) for line in range(60) for site in range(line) for _ in range(2)]
    found = lines.boilerplate(spark.createDataFrame(rows, "line long, site long"), 30)
    assert sorted(r.line for r in found.collect()) == list(range(30, 60))


@pytest.mark.parametrize("operator", [
    exact.exact_groups, simhash.near_duplicates, suffix.remove_repeats, lines.without_boilerplate])
def test_empty_table(docs_of, operator):
    assert operator(docs_of([])).collect() == []
