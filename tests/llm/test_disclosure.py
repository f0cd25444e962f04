"""Terms that disclose protected entities and their parts: against brute force, and planted among chance words."""

import math
import random
import re
from collections import Counter

import pytest

from dueward.llm import pii
from dueward.llm.common import stored

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def disclosing_by_hand(texts, false_alarms=pii.FALSE_ALARMS):
    """Terms that disclose an address, its domain or its name, over different texts; texts hold no other kind."""
    texts, held, bare, df = sorted(set(texts)), [], [], Counter()
    for text in texts:
        own, masked = set(), text
        for m in re.finditer(EMAIL, text):
            name, domain = m[0].lower().split("@")
            own |= {(m[0].lower(), False), ("d:" + domain, True)} | ({("n:" + n, True)} if (n := re.sub("[0-9._%+-]+", "", name)) else set())
            masked = masked[:m.start()] + re.sub(r"[^\W_]", "\x01", m[0]) + masked[m.end():]
        held.append(own)
        bare.append({w.lower() for w in re.findall(r"(?:[^\W_]|\x01)+", masked) if "\x01" not in w} if own else set())
        df.update({w.lower() for w in re.findall(r"[^\W_]+", text)})
    n, with_entity = len(texts), Counter(e for own in held for e in own)
    kept = {e: k for e, k in with_entity.items() if k >= pii.MIN_TEXTS and math.log2(n / k) >= pii.MIN_BITS}
    most = max(kept.values(), default=0)
    tried = sum(1 for k in df.values() if k >= pii.MIN_TEXTS and most / k >= pii.MIN_SHARE)
    limit = math.log(max(tried * len(kept), 1) / false_alarms)
    both = Counter((e, t) for own, words in zip(held, bare) for e in own if e in kept for t in words)
    found = set()
    for (e, t), k in both.items():
        share, chance = k / df[t], kept[e] / n
        if k < pii.MIN_TEXTS or share < pii.MIN_SHARE or math.log2(share / chance) < pii.MIN_BITS:
            continue
        evidence = df[t] * (share * math.log(share / chance) + ((1 - share) * math.log((1 - share) / (1 - chance)) if share < 1 else 0))
        if not e[1] or evidence >= limit:
            found.add(t)
    return found


def tagged(docs):
    """Terms that were found, and the texts they stand in."""
    found, texts = set(), {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.personal_data(docs).collect():
        found |= {texts[r.doc_id][s.start:s.end].lower() for s in r.terms}
    return found


@pytest.fixture(scope="module")
def planted():
    """Two thousand texts of chance words; six domains, one of which a project's words go with."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(25_000)]
    rows = []
    for k in range(2_000):
        text = [rng.choice(words) for _ in range(30)]
        if k % 12 == 0:
            text.insert(rng.randrange(30), f"{rng.choice('qrst')}{k}.user@mail{k % 5}.example.com")
        if k % 160 == 1:
            text.insert(rng.randrange(30), f"user{k}@acme.example")
            text.insert(rng.randrange(30), "Zyxproj")
        if k % 700 == 3:
            text += ["odd", "boss.man@acme.example", "Kryptonym"]
        rows.append((k, " ".join(text)))
    return rows + [(5_000, None), (5_001, ""), (5_002, rows[1][1]), (None, "zyxproj of nobody")]


def test_terms_of_parts_equal_brute_force_and_chance_stays_out(docs_of, planted):
    docs = docs_of(planted, clash=True)
    want = disclosing_by_hand([t or "" for _, t in planted])
    assert tagged(docs) == want
    assert {"zyxproj", "kryptonym"} <= want  # planted: both found
    assert not want - {"zyxproj", "kryptonym", "odd"}  # false alarms: none


def test_without_the_bound_chance_words_would_pass(docs_of, planted):
    found = disclosing_by_hand([t or "" for _, t in planted], false_alarms=1e12)
    assert len(found - {"zyxproj", "kryptonym", "odd"}) > 5


def test_an_empty_table_has_no_spans(docs_of):
    assert pii.digest(pii.personal_data(docs_of([]))).collect() == []


def test_what_leads_to_the_terms_writes_no_files(spark, docs_of, planted, monkeypatch):
    files, kept = [], spark.sparkContext._jsc.getPersistentRDDs().size()
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}

    def counted(df):
        table = stored(df)
        files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(pii, "stored", counted)
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        found = tagged(docs_of(planted))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"zyxproj", "kryptonym"} <= found
    assert len(files) == 2  # the rows by input task, the rows with a term
    assert files[0] <= 3 and files[1] <= 20
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
