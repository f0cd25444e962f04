"""Decontamination, personal data, toxicity, mixing, URL filters and license scans on small fixtures."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from dueward.llm import decontaminate, licenses, mixing, pii, toxicity, urls
from tests.llm.conftest import EDGE_TEXTS

# ---- decontamination --------------------------------------------------------

QUESTION = "Yesterday the farmer called Tom bought 12 apples and then sold 5 of the 12 apples to a neighbour for 7 dollars each"


def pairs(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}


def test_templates_catch_other_parameters(spark, docs_of):
    other = QUESTION.replace("Tom", "Jim").replace("12", "30").replace("5", "9")
    crossed = QUESTION.replace("Tom", "Jim").replace("sold 5 of the 12", "sold 9 of the 30").replace(" 7 ", " 8 ")
    rows = EDGE_TEXTS + [(20, f"so {QUESTION} etc"), (21, f"so {other} etc"), (22, f"so {crossed} etc"), (23, "the farmer bought apples and then went home"), (20, f"so {QUESTION} etc")]
    found = pairs(spark, docs_of(rows, True), [(1, QUESTION), (2, None), (3, ""), (1, QUESTION)])
    assert set(found) == {(20, 1), (21, 1)}
    assert not found[20, 1].reparameterised and found[21, 1].reparameterised and found[21, 1].slot_consistency == 1.0


def test_short_items_and_parts_of_long_ones(spark, docs_of):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    rows = [(1, "a b alpha beta gamma delta c"), (2, "zz " + " ".join(words[10:24]) + " zz"), (3, "zz " + " ".join(words[10:22]) + " zz")]
    found = pairs(spark, docs_of(rows), [(1, "alpha beta gamma delta"), (2, " ".join(words))])
    assert set(found) == {(1, 1), (2, 2)} and found[2, 2].run_tokens == 14


def test_an_item_may_be_aligned_more_than_once(spark, docs_of):
    other = QUESTION.replace("Tom", "Jim").replace("12", "30").replace("5", "9")
    phrase = "a train leaves at 12 km per hour for 3 hours and a train leaves at 15 km per hour for 4 hours"
    found = pairs(spark, docs_of([(1, f"{QUESTION} or {other} etc"), (2, f"so {phrase} etc"), (3, f"{other} or {other.replace('30', '31')}")]), [(1, QUESTION), (2, phrase)])
    assert set(found) == {(1, 1), (2, 2), (3, 1)}
    assert [found[k].reparameterised for k in ((1, 1), (2, 2), (3, 1))] == [False, False, True]


def test_items_of_numbers_and_names_are_found_verbatim(spark, docs_of):
    sums, names = "What is 12 + 7 * 3 - 5 / 2?", "capitals, Paris, Rome, Berlin, Madrid, Vienna, Oslo, Bern, Lisbon, Athens"
    mixed = QUESTION + " at 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27"
    other = QUESTION.replace("Tom", "Jim").replace("12", "30").replace("5", "9")
    rows = [(1, f"so {sums} yes"), (2, f"so {sums.replace('12', '13')} yes"), (3, f"the {names} etc"), (4, f"the {names.replace('Rome', 'Bonn').replace('Oslo', 'Riga')} etc"), (5, f"so {other} etc")]
    found = pairs(spark, docs_of(rows), [(1, sums), (2, names), (3, mixed)])
    assert set(found) == {(1, 1), (3, 2), (5, 3)} and not found[1, 1].reparameterised and found[5, 3].reparameterised


def test_nothing_to_look_for(spark, docs_of):
    assert pairs(spark, docs_of(EDGE_TEXTS), []) == {} and pairs(spark, docs_of([]), [(1, QUESTION)]) == {}


def test_shuffled_join_gives_the_same(spark, docs_of, monkeypatch):
    docs = docs_of([(i, f"{i} so {QUESTION} etc") for i in range(20)])
    before = set(pairs(spark, docs, [(1, QUESTION)]))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert set(pairs(spark, docs, [(1, QUESTION)])) == before == {(i, 1) for i in range(20)}


# ---- personal data ----------------------------------------------------------

def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(found))


def test_base_spans_equal_plain_regular_expressions(docs_of):
    rng = random.Random(4)
    pieces = ["a@b.c", "_d@e.f", " x@y", "..", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "5555555555554444", "+1 (499) 555-6503", "+1+1(2)3", "+12345678901234567", "😀", " ", "  ", "-", "é@é.com", "9", "12 3", "@", "+", "x.org"]
    rows = EDGE_TEXTS + [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))) for i in range(300)]
    rows += [(500, "x" * 20_000 + "@"), (501, "a@" + "b." * 9_000 + "c"), (502, "1" * 20_000), (503, "1 2 3 4 5 6 7 8 9 0 1 2 3")]
    found = pii.digest(pii.personal_data(docs_of(rows, True))).collect()
    assert len(found) == len(rows)
    ours = sorted((str(r.doc_id), r.base_sha256) for r in found)
    assert ours == sorted((str(i), hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in rows)


def test_terms_that_give_an_entity_away_are_added(docs_of):
    rows = [(i, f"word{i} Fleeb secret.mail@x.com the end") for i in range(6)] + [(100 + i, f"the end word{i}") for i in range(60)]
    found = {r.doc_id: r for r in pii.digest(pii.personal_data(docs_of(rows))).collect()}
    assert found[0].spans == "term:6:11,email:12:29" and found[0].n_term == 1 and found[100].spans == ""
    texts = {r.doc_id: r.text for r in pii.sanitised(docs_of(rows)).collect()}
    assert texts[0] == "word0 <term> <email> the end" and texts[100] == "the end word0"


@pytest.mark.parametrize("broadcast", [pii.BROADCAST_ROWS, 0])
def test_copies_count_once_for_terms_too(docs_of, monkeypatch, broadcast):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", broadcast)
    rows = [(i, "Fleeb secret.mail@x.com said this") for i in range(1_000)] + [(1_000, "then Fleeb secret.mail@x.com went")]
    rows += [(2_000 + i, f"another text {i}") for i in range(30)]
    found = {r.doc_id: r.spans for r in pii.digest(pii.personal_data(docs_of(rows))).collect()}
    assert all(found[i] == "term:0:5,email:6:23" for i in range(1_000)) and found[1_000] == "term:5:10,email:11:28"
    assert not any(found[2_000 + i] for i in range(30))


def test_disclosing_terms_are_tagged_wherever_they_stand(docs_of):
    rows = [(i, f"Fleeb é_d.e@f.com word{i} " + "so on " * 40 + "mail to secret.mail@x.com ok") for i in range(6)]
    rows += [(50, "alone 😀 FLEEB and fleeb"), (51, "xfleeb secret")] + [(100 + i, f"so on the mail word{i} to ok") for i in range(90)]
    found = {r.doc_id: r.spans for r in pii.digest(pii.personal_data(docs_of(rows))).collect()}
    assert all(found[i].startswith("term:0:5,term:6:7,email:7:17,email:") for i in range(6))
    assert found[50] == "term:8:13,term:18:23" and not found[51] and not any(found[100 + i] for i in range(90))
    texts = {r.doc_id: r.text for r in pii.sanitised(docs_of(rows)).collect()}
    assert texts[50] == "alone 😀 <term> and " and texts[0].startswith("<term> <email> word0")


# ---- toxicity ---------------------------------------------------------------

def toxic_rows(n=400):
    rng = random.Random(9)
    calm = ["river", "stone", "cloud", "garden", "window", "letter", "summer", "bridge"]
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("nastyword", "vileone", "badbadbad")))
        yield i, " ".join(words), int(toxic)


def test_held_out_rows_are_scored_right(spark, docs_of):
    rows = list(toxic_rows())
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    docs = docs_of([(i, t) for i, t, _ in rows] + [(9_001, None), (9_002, ""), (None, "river")], True)
    found = {r.doc_id: r for r in toxicity.toxic_documents(docs, labels).collect()}
    assert len(found) == len(rows) + 3 and found[9_001].predicted == found[9_002].predicted == 0
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(found[i].predicted, y) for i, _, y in rows if found[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    text = dict((i, t) for i, t, _ in rows)[0]
    assert {text[s.start:s.end] for s in found[0].spans} <= {"nastyword", "vileone", "badbadbad"} and found[0].n_spans == 3


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    model = toxicity.Model(start=0.3, moves=np.array([[0, -0.7], [0.4, 0.9]]))
    lengths = np.array([3, 1, 5])
    e = rng.normal(size=9)
    expected, first = [], 0
    for n in lengths:
        weight = np.zeros(n)
        total = 0.0
        for y in np.ndindex(*(2,) * n):
            s = y[0] * model.start + sum(e[first + t] * y[t] for t in range(n)) + sum(model.moves[y[t], y[t + 1]] for t in range(n - 1))
            total += np.exp(s)
            weight += np.exp(s) * np.array(y)
        expected += list(weight / total)
        first += n
    assert np.allclose(toxicity.marginals(e, lengths, model), expected)


def test_one_class_or_no_labels_gives_a_constant(spark, docs_of):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxic_documents(docs_of(EDGE_TEXTS), labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.toxic_documents(docs_of([(1, "a"), (2, "b")]), labels).collect()} == {1.0}
    assert toxicity.toxic_documents(docs_of([]), labels).collect() == []


# ---- mixing -----------------------------------------------------------------

def water(sizes):
    """Targets by repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    rest = 1.5 * sum(sizes.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
        rest -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sources", [["a"], ["a", "b", None], ["hot"] * 6 + ["b", "c", "d", None]])
def test_mix_meets_its_targets(docs_of, sources):
    rng = random.Random(len(sources))
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 5, 300, 900))), rng.choice(sources)) for i in range(200)]
    rows += [(None, "a b c", sources[0]), (7, None, sources[0]), (7, "x y", sources[0]), (7, "x y", sources[0])]
    docs = docs_of(rows, True)
    sizes, taken = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    found = mixing.mixed(docs).collect()
    expected = water(sizes)
    assert len(found) == len(rows)
    by_size = {v: k for k, v in sizes.items()}
    for r in found:
        source = by_size[r.source_size]
        taken[source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and abs(r.target - expected[source]) < 1e-6 * max(1.0, r.target)
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in found) == sorted((str(r.doc_id), r.taken) for r in again)


def test_shards_share_the_draws_and_hold_their_words(docs_of):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(700)), "ab"[i % 2]) for i in range(40)]
    parts = mixing.shard_texts(docs_of(rows)).collect()
    per_shard = collections.Counter(r.shard for r in parts)
    assert set(per_shard) == set(range(16)) and max(per_shard.values()) - min(per_shard.values()) <= 4
    total = collections.Counter()
    for r in parts:
        total.update({r.doc_id: len(r.words.split())})
        assert all(w.startswith(f"d{r.doc_id}w") for w in r.words.split())
    assert dict(total) == {r.doc_id: r.taken for r in mixing.mixed(docs_of(rows)).collect() if r.taken}


def test_empty_mix(docs_of):
    assert mixing.mixed(docs_of([])).collect() == []
    assert [r.taken for r in mixing.mixed(docs_of([(1, None), (2, "")])).collect()] == [0, 0]


# ---- URL filters ------------------------------------------------------------

def test_captures_meet_the_entries_of_their_day(spark):
    entries = spark.createDataFrame([
        ("domain", "bad.example.com", 10, "block"), ("domain", "bad.example.com", 20, "remove"), ("host", "ok.bad.example.com", 5, "allow"),
        ("path", "bad.example.com/x", 15, "allow"), ("domain", "bad.example.com", 30, "allow"), ("domain", "bad.example.com", 30, "block"),
        ("domain", "", 1, "block"), ("host", "bad.example.com", None, "block")], "kind string, key string, day int, action string")
    captures = spark.createDataFrame([
        (1, "http://bad.example.com/a", 9), (2, "http://bad.example.com/a", 10), (3, "https://www.BAD.example.com:80/x?y", 15),
        (4, "http://bad.example.com/a", 20), (5, "http://u@ok.bad.example.com/", 12), (6, None, 12), (7, "no url", 12),
        (8, "http://bad.example.com", 31), (9, "http://bad.example.com", None), (2, "http://bad.example.com/a", 10)], "capture long, url string, day int")
    found = sorted((r.capture, r.blocked, r.n_active, r.rule_kind) for r in urls.evaluated(captures, entries).collect())
    assert found == [
        (1, False, 0, None), (2, True, 1, "domain"), (2, True, 1, "domain"), (3, False, 2, "path"), (4, False, 0, None),
        (5, False, 2, "host"), (6, False, 0, None), (7, False, 0, None), (8, True, 1, "domain"), (9, False, 0, None)]
    assert urls.evaluated(captures.limit(0), entries).collect() == []


# ---- licenses ---------------------------------------------------------------

def test_licenses_are_found_and_inherited(spark):
    files = spark.createDataFrame([
        ("1", "r/a/LICENSE", "Released under the MIT License."), ("2", "r/a/b/c.py", "code here\nmore code"), ("3", "r/a/b/d.py", "x\nLicensed under CC BY-NC 4.0."),
        ("4", "r/e/f.py", None), ("5", None, "Licensed under the Apache License, Version 2.0."), ("6", "r/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("7", "r/a/g.py", "this is a text under the sun of the sea"), ("7", "r/a/g.py", ""), ("8", "r/a/b/h/i.py", "")], "file string, path string, text string")
    found = sorted((r.file, r.license, r.inherited_license, r.inherited_from, r.effective_license) for r in licenses.license_scan(files).collect())
    assert found == [
        ("1", "MIT", "MIT", "r/a", "MIT"), ("2", None, "GPL-3.0", "r/a/b", "GPL-3.0"), ("3", "CC-BY-NC-4.0", "GPL-3.0", "r/a/b", "CC-BY-NC-4.0"),
        ("4", None, None, None, None), ("5", "Apache-2.0", None, None, "Apache-2.0"), ("6", "GPL-3.0", "GPL-3.0", "r/a/b", "GPL-3.0"),
        ("7", None, "MIT", "r/a", "MIT"), ("7", None, "MIT", "r/a", "MIT"), ("8", None, "GPL-3.0", "r/a/b", "GPL-3.0")]
    assert licenses.license_scan(files.limit(0)).collect() == []
