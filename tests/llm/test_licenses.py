"""License scans against a brute-force cosine over every unit and template."""

import math
import random
import re
from collections import Counter

import pytest

from dueward.llm import licenses
from tests.llm.conftest import CLASHES

TEXT = dict()
for _name, _text in licenses.TEMPLATES:
    TEXT.setdefault(_name, []).append(_text)


def terms(text):
    return re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())


def units(text, path):
    bare = re.sub(r"(?m)^[ \t]*(?:[#*;%/]+|<!--|--)?[ \t]*", "", re.sub(r"\r\n?", "\n", text))
    whole = [bare] if path and re.search(r"(?i)(?:^|/)(?:licen[cs]e|copying)[^/]*$", path) else []
    return bare.split("\n") + [b for b in re.split(r"\n(?:[ \t]*\n)+", bare) if "\n" in b] + whole


def cosines_by_hand(files, threshold=licenses.THRESHOLD):
    df = Counter(t for _, _, text in files for t in set(terms(text or "")))
    idf = {t: math.log((len(files) + 1) / (df.get(t, 0) + 1)) + 1 for t in set(df) | {t for _, x in licenses.TEMPLATES for t in terms(x)}}

    def vector(words):
        return {t: (1 + math.log(n)) * idf[t] for t, n in Counter(words).items()}

    known = [(n, vector(w)) for n, w in licenses.templates_with_files(licenses.TEMPLATES)]
    found = {}
    for file, path, text in files:
        best = None
        for unit in units(text or "", path):
            v = vector(terms(unit))
            if len(v) < licenses.MIN_TERMS:
                continue
            for name, t in known:
                dot = sum(w * t.get(x, 0) for x, w in v.items())
                cosine = round(dot / math.sqrt(sum(w * w for w in v.values()) * sum(w * w for w in t.values())), 6)
                if cosine >= threshold and (best is None or (-cosine, name) < best):
                    best = (-cosine, name)
        found[file] = (None, None) if best is None else (best[1], -best[0])
    return found


def wrapped(text, width, mark=""):
    lines, line = [], ""
    for word in text.split():
        line = f"{line} {word}".strip()
        if len(line) > width:
            lines.append(mark + line)
            line = ""
    return "\n".join(lines + [mark + line])


@pytest.fixture(scope="module")
def files():
    rng = random.Random(8)
    common = "the software file you by license with of and is to in this that for copyright notice any use source public".split()
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(common if rng.random() < 0.4 else words) for _ in range(n))
    rows = [(f"p{k}", f"a/{k % 7}/{k}.txt", "\n".join(prose(rng.randrange(1, 14)) for _ in range(rng.randrange(1, 9)))) for k in range(250)]
    for n, (name, text) in enumerate(licenses.TEMPLATES):
        rows.append((f"w{n}", f"src/{n}.py", f"{prose(9)}\n\n{wrapped(text, 40, '# ')}\n\n{prose(30)}"))
        rows.append((f"l{n}", f"lib/{n}.c", f"{prose(5)}\r\n * {text}\r\n{prose(8)}"))
    for name, texts in TEXT.items():
        rows.append((f"f-{name}", f"{name}/LICENSE", f"Copyright 2024 {prose(2)}\n\n" + "\n\n".join(wrapped(t, 70) for t in texts)))
        rows.append((f"near-{name}", f"{name}/x/near.py", wrapped(texts[-1], 60) + f" {prose(2)}"))
    rows += [("e0", "q/e", ""), ("e1", None, TEXT["MIT"][0]), ("e2", "q/n", None), ("long", "q/long.txt", prose(60_000) + "\n" + TEXT["MIT"][0])]
    rows += [("p1", "a/1/1.txt", rows[1][2]), ("same", "q/same", TEXT["MIT"][0] + "\n" + TEXT["MIT"][0])]
    return rows


def test_scan_equals_brute_force(spark, files):
    df = spark.createDataFrame(files, "file string, path string, text string").repartition(4).selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHES if c != "row"))
    got = {}
    for r in licenses.scanned(df).collect():
        got.setdefault(r.file, set()).add((r.license, r.cosine))
    want = cosines_by_hand(files)
    for file, (name, cosine) in want.items():
        assert len(got[file]) == 1
        (found, near), = got[file]
        assert found == name and (near is None) == (cosine is None) and (near is None or abs(near - cosine) < 2e-6), file
    # A header wrapped over lines and a comment mark is found, and prose of common words is not.
    assert all(want[f"w{n}"][0] for n in range(len(licenses.TEMPLATES))) and not any(want[f"p{k}"][0] for k in range(250))
    assert 0.75 <= min(c for _, c in want.values() if c) < 0.95


def test_scores_keep_with_the_size_of_the_table(spark, files):
    """The same files ten times over: frequencies grow in proportion and a line's score stays."""
    line = ("line", "z/line", "Files of this kind are licensed under the Apache License, Version 2.0")
    scores = [cosines_by_hand(files * k + [line], 0.1)["line"][1] for k in (1, 10)]
    assert abs(scores[0] - scores[1]) < 0.03
    df = spark.createDataFrame(files * 10 + [line], "file string, path string, text string")
    got = {r.cosine for r in licenses.scanned(df, threshold=0.5).where("file = 'line'").collect()}
    assert len(got) == 1 and abs(got.pop() - scores[1]) < 2e-6


def test_no_unit_without_an_anchor_can_reach_the_threshold():
    idf = {t: 1 + len(t) / 3 for _, x in licenses.TEMPLATES for t in terms(x)}
    for _, v in licenses._vectors(licenses.templates_with_files(licenses.TEMPLATES), idf):
        chosen = licenses.anchors(v, 0.75)
        rest = math.sqrt(sum(w * w for t, w in v.items() if t not in chosen))
        assert rest < 0.75 and chosen


def test_ties_and_empty_tables(spark):
    schema = "file string, path string, text string"
    tied = (("B", "alpha beta gamma delta"), ("A", "alpha beta gamma delta"))
    df = spark.createDataFrame([("1", "d/LICENSE", "alpha beta gamma delta"), ("2", "d/e/x", "other"), ("3", "d/LICENSE", "alpha beta gamma delta")], schema)
    found = {(r.file, r.license, r.inherited_license, r.inherited_from) for r in licenses.license_scan(df, tied).collect()}
    assert found == {("1", "A", "A", "d"), ("2", None, "A", "d"), ("3", "A", "A", "d")}
    assert licenses.license_scan(df.limit(0)).collect() == []
