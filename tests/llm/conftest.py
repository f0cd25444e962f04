from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string"
#: Columns whose names the operators use themselves.
CLASHES = ("key", "shard", "row", "size", "n", "h", "fp", "line", "base", "tokens", "score", "spans", "digest", "length", "taken")


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) or (id, text, source) rows, with clashing extra columns on request."""
    def build(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s") for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if clash:
            for name in CLASHES:
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return build


EDGE_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "same text here twice"), (6, "same text here twice"),
    (7, "same  text\there twice"), (8, "w" * 20_000), (9, "long words here " * 3_000), (None, "no id at all"), (10, "é😀 naïve ﬁn"),
]
