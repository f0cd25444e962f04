"""Spelling variants, ranked lexical search and exact top-k vectors against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dueward.llm import lexical, nearest, spelling, topk
from dueward.llm.common import stored
from tests.llm.conftest import CLASHES, EDGE_TEXTS

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- spelling variants ------------------------------------------------------

def words_by_hand(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(TO_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants_by_hand(rows):
    n = words_by_hand(rows)
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {w: min(own, key=lambda x: (-n[x], x)) for w, own in near.items() if own}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}
    found = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        found.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return found


def variants(docs, **how):
    rows = [tuple(r) for r in spelling.spelling_variants(docs, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def misspelt():
    """Families of words with one edit and more, in frequencies that make chains of forms."""
    rng = random.Random(3)
    words = []
    for family in ("kalender", "Ähnlichkeit", "façade", "strasse", "aaaaaaa", "l" * 3_000):
        base = family.lower() if family.isascii() else family
        words += [base] * 800
        for n in (130, 25, 24, 5, 5, 4):
            k, c = rng.randrange(len(base)), rng.choice("abcéÀzß")
            other = rng.choice((base[:k] + c + base[k + 1:], base[:k] + base[k + 1:], base[:k] + c + base[k:]))
            words += [other] * n
            base = rng.choice((base, other))
    rng.shuffle(words)
    return [(k, " ".join(words[k::40]) + ". Short 12 öl") for k in range(40)]


def test_variants_equal_brute_force(docs_of, misspelt):
    want = variants_by_hand(misspelt)
    assert max(len(w[0]) for w in want) > 2_900 and any(w[1] and w[2] != w[1] for w in want)
    assert variants(docs_of(misspelt, clash=True)) == want
    # one block for each part: lengths fall apart into parts, and large ones into slices
    assert variants(docs_of(misspelt), filter_bytes=64) == want


def test_variants_of_edges(docs_of):
    assert variants(docs_of([])) == set()
    rows = EDGE_TEXTS + [(None, "wörter " * 9), (6, "WÖrter " * 7), (7, "worter " * 90), (8, None)]
    assert variants(docs_of(rows)) == variants_by_hand(rows) and variants_by_hand(rows)


def test_edits_hash_as_their_words():
    letters = spelling.codes(["anna", "aaab"])
    h = spelling.hashes(letters)
    word, at, new, changed = spelling.replacements(letters, h, np.array([97, 98, 255], dtype=np.uint8), 1, 3)
    for w, k, c, x in zip(word, at, new, changed):
        t = ["anna", "aaab"][w]
        assert c > ord(t[k]) and spelling.hashes(spelling.codes([t[:k] + chr(c) + t[k + 1:]]))[0] == x
    word, at, changed = spelling.deletions(letters, h)
    edits = [["anna", "aaab"][w][:k] + ["anna", "aaab"][w][k + 1:] for w, k in zip(word, at)]
    assert sorted(edits) == ["aaa", "aab", "ana", "ann", "nna"]
    assert [spelling.hashes(spelling.codes([e]))[0] for e in edits] == list(changed)


def test_filters_hold_their_words_and_little_else(spark):
    rng = random.Random(5)
    own = sorted({"".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(4_000)})
    words = stored(spark.createDataFrame([(w, 5) for w in own], spelling.WORDS))
    part = spelling.parts_of({8: len(own)}, 1 << 20)[0]
    table = spelling.filter_of(words, part)
    assert table.nbytes <= len(own) * 2 + 64

    def held(some):
        block, bits = spelling.slots(spelling.hashes(spelling.codes(some)), part.blocks[8])
        return np.all([table[block.astype(int), k] >> spelling.place(bits, k) & np.uint64(1) == 1 for k in range(8)], axis=0)

    assert held(own).all()
    assert held(["".join(rng.choice("ijklmnop") for _ in range(8)) for _ in range(20_000)]).mean() < 0.01


# ---- ranked search ----------------------------------------------------------

def terms_of(text):
    return re.findall(lexical.TERM, (text or "").translate(TO_LOWER))


def ranks_by_hand(docs, items, k=10):
    counts = [Counter(terms_of(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    w = {t: int(np.floor(1000 * np.log((2 * n + 2) / (2 * d + 1)))) for t, d in df.items()}
    found = []
    for item, text in items:
        scored = []
        for (doc, _), c, size in zip(docs, counts, sizes):
            m = 10 + 90 * size * n // total if total else 0
            score = sum(w[t] * (1_000_000_000 * c[t] // (1_000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                scored.append((-score, float("inf") if doc is None else doc, doc))
        found += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeföß") for _ in range(1 + k % 5)) for k in range(120)] + ["x" * 50_000]
    pick = lambda n: [vocabulary[min(int(rng.expovariate(0.05)), 120)] for _ in range(n)]
    docs = [(k, " ".join(pick(rng.randrange(1, 60))).title()) for k in range(400)]
    docs += [(7, docs[3][1]), (None, docs[3][1]), (500, docs[3][1]), (501, None), (502, ""), (503, "-- ; --"), (504, " ".join(pick(30_000)))]
    items = [(k, ", ".join(pick(1 + 2 * k))) for k in range(14)]
    items += [(3, items[5][1]), (20, None), (21, ""), (22, "unheard"), (None, items[4][1]), (23, "x" * 50_000), (24, docs[3][1])]
    return docs, items


def test_ranked_search_equals_brute_force(spark, docs_of, library):
    docs, items = library
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHES if c != "row"))
    want = ranks_by_hand(docs, items)
    for how in ({}, {"shard_documents": 20, "terms_at_once": 40}):
        rows = lexical.ranked_search(docs_of(docs, clash=True), asked, **how).collect()
        assert sorted((tuple(r) for r in rows), key=str) == want


def test_ranked_search_of_empty_tables(spark, docs_of):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked_search(docs_of([]), asked).collect() == []
    assert lexical.ranked_search(docs_of([(1, None), (2, "!")]), asked).collect() == []
    assert lexical.ranked_search(docs_of([(1, "a b"), (2, "c")]), asked.limit(0)).collect() == []


def shards_for(spark, docs, items):
    counts = lexical.term_counts(docs, "doc_id", "text")
    asked = lexical.term_counts(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").select(
        F.col("row").alias("query"), F.explode("terms").alias("term"))
    weighted, n, total = lexical.weighted_terms(counts, asked)
    block = lexical.Block([tuple(r) for r in weighted.select("query", "term", "w").orderBy("query", "term").collect()])
    names = [f.split()[0] for f in lexical.INDEX.split(", ")]
    for row in lexical.build_index(counts, block, n, total, 2).collect():
        yield block, lexical.Shard(row["ids"], *(np.array(row[c], dtype=np.int64) for c in names[2:]), block.pairs)


def test_pair_bounds_hold_and_read_less_than_single_maxima(spark, docs_of):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(60)], k=rng.randrange(3, 30)))) for k in range(1_500)]
    items = [(k, " ".join(rng.sample(words, 12))) for k in range(30)]
    read = {True: 0, False: 0}
    for block, shard in shards_for(spark, docs_of(docs), items):
        for pair, (joint, places, sums) in shard.pairs.items():
            lists = [dict(zip(*shard.lists[t])) for t in pair]
            assert {int(p): int(s) for p, s in zip(places, sums)} == {
                int(p): int(lists[0][p] + lists[1][p]) for p in lists[0].keys() & lists[1].keys()}
            assert joint == max(sums) and shard.bound(pair, True) <= shard.bound(pair, False)
        for units in block.units.values():
            found = {}
            for paired in read:
                shard.read = 0
                found[paired] = shard.top(units, 0, 3, paired)
                read[paired] += shard.read - (sum(len(shard.pairs[u][1]) for u in units if u in shard.pairs) if paired else 0)
            assert found[True] == found[False]
            assert shard.top(units, found[True][-1][0], 3) == found[True]
    assert read[True] < read[False]


def test_no_stored_row_is_as_large_as_a_shard(spark, docs_of, library, monkeypatch):
    docs, items = library
    longest = []

    def watched(df):
        kept = stored(df)
        for c, kind in kept.dtypes:
            if kind.startswith("array"):
                longest.append((kept.agg(F.max(F.size(c))).first()[0] or 0, c))
        return kept

    for module in (lexical, topk):
        monkeypatch.setattr(module, "stored", watched)
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = lexical.ranked_search(docs_of(docs), asked, shard_documents=200).collect()
    assert sorted((tuple(r) for r in rows), key=str) == ranks_by_hand(docs, items)
    assert longest and max(longest)[0] <= 121, max(longest)  # the terms of a document


def test_shards_of_few_entries_equal_brute_force(spark, docs_of, library):
    docs, items = library
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = lexical.ranked_search(docs_of(docs), asked, shard_entries=1_000).collect()
    assert sorted((tuple(r) for r in rows), key=str) == ranks_by_hand(docs, items)


def test_pairs_are_held_for_a_part_of_the_queries(spark, docs_of, library):
    docs, items = library
    for block, shard in shards_for(spark, docs_of(docs), items):
        want = {query: shard.top(own, 0, 3) for query, own in block.units.items()}
        every, parts = dict(shard.pairs), 0
        for part in shard.parts(block.units, 400):
            own = {u for units in part.values() for u in units}
            assert {p: m for p, (m, _, _) in shard.pairs.items()} == {p: m for p, (m, _, _) in every.items() if p in own}
            assert len(part) == 1 or sum(len(places) for _, places, _ in shard.pairs.values()) <= 400
            for query, units in part.items():
                assert shard.top(units, 0, 3) == want.pop(query)
            parts += 1
        assert not want and parts > 3


# ---- exact top-k ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def nearest_by_hand(rows, k=5):
    whole = [(n, i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for n, (i, v) in enumerate(rows)
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    for n, i, q in whole:
        if i is not None and i % 50 == 0:
            scored = sorted((-int(q @ v), float("inf") if j is None else j, str(j), j) for m, j, v in whole if m != n and len(v) == len(q))
            found += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(found, key=str)


def found_nearest(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(5).selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHES if c != "row"))
    return sorted((tuple(r) for r in nearest.nearest(df, F.col("id") % 50 == 0, **how).collect()), key=str)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=16).round(2).tolist()) for k in range(700)]
    rows += [(k, rows[k % 7][1]) for k in range(700, 800)] + [(50, rows[3][1]), (None, rows[5][1]), (-50, rows[6][1])]
    rows += [(900, [0.0] * 16), (901, [float("nan")] + [0.0] * 15), (950, [None] + [1.0] * 15), (1000, None), (1050, []), (1051, []),
             (1100, [1.0, -2.0]), (1101, [0.5, 0.25]), (1150, [float("inf")] * 2), (1200, [3.0] * 40_000), (1201, [-2.0] * 40_000)]
    want = nearest_by_hand(rows)
    assert found_nearest(spark, rows) == want
    assert found_nearest(spark, rows, shard_cells=700, queries_at_once=7) == want
    assert found_nearest(spark, [(0, [1.0])]) == []
    assert found_nearest(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert nearest.nearest(spark.createDataFrame([], VECTORS), F.col("id") % 50 == 0).collect() == []


def test_lists_are_not_read_to_their_ends(spark):
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.normal(size=(4_000, 16)))
    v[:40] *= 3
    places = np.argsort(-v.T, axis=1, kind="stable")
    shard = nearest.Shard(list(range(4_000)), np.arange(4_000), places.ravel(), np.take_along_axis(v.T, places, 1).ravel(), 16)
    queries, none = v[:20], np.full(20, -np.inf)
    got = shard.top(queries, np.arange(20), none, 5)
    for k in range(20):
        scores = v @ v[k]
        scores[k] = -np.inf
        assert got[k] == [(int(scores[p]), int(p)) for p in np.lexsort((np.arange(4_000), -scores))[:5]]
    assert shard.top(queries, np.arange(20), np.array([float(own[-1][0]) for own in got]), 5) == got
    assert shard.cells_read < 0.8 * 40 * v.size
