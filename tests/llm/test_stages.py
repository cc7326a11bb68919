"""The pipeline's stages on empty tables, nulls, repeated rows, very long texts and more columns."""

import random
from collections import Counter

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, hub string, words string, _n string"


def text(r, n):
    return " ".join("".join(r.choice(("ba", "de", "ki", "lo", "mu", "né")) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    r = random.Random(41)
    item = text(r, 25)
    long = text(r, 260_000)  # over 2 MB
    rows = [(1, long), (2, text(r, 90)), (3, f"{text(r, 80)} {item} {text(r, 80)}"), (4, None), (5, ""), (None, text(r, 70)), (None, None), (6, f"{text(r, 60)} token = 'Zq81kd93Kd02' end"), (7, f"{long} {item}")]
    rows += [(2, rows[1][1]), (8, rows[1][1]), (9, text(r, 60)), (9, text(r, 60))]
    rows = [(i, t, "en", ("a", None)[(i or 0) % 2], len(t or ""), "own", "own", "own", "own") for i, t in rows]
    spark.createDataFrame(rows, KIND).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x y z")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(2, 1, 0), (6, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


@pytest.mark.parametrize("k", range(5))
def test_every_stage_takes_empty_tables_and_odd_rows(spark, tables, k):
    import corpus_pipeline

    at, rows = tables
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    none = stage(spark, docs.limit(0), at)
    assert none.count() == 0 and set(docs.columns) - {"size"} <= set(none.columns)
    got = [r.asDict() for r in stage(spark, docs, at).collect()]
    ids = Counter(g["doc_id"] for g in got)
    texts = {(r[0], r[1]) for r in rows}
    if name == "secrets":
        assert len(got) == len(rows) and all(("[secret]" in (g["text"] or "")) == (g["doc_id"] == 6) for g in got)
    else:
        assert all((g["doc_id"], g["text"]) in texts for g in got)
    assert all(g["hub"] == g["words"] == "own" for g in got)
    if name == "quality_rules":
        assert all(g["text"] for g in got) and ids[4] == ids[5] == 0
    elif name == "near_dedup":
        assert (ids[2], ids[8], ids[9], ids[4], ids[5], ids[None]) == (1, 0, 1, 1, 1, 2) and ids[1] + ids[7] == 1
    elif name == "decontaminate":
        assert ids[3] == ids[7] == 0 and len(got) == len(rows) - 2
    elif name == "mixing":
        assert len(got) == len(rows) and all(0 <= g["taken"] <= 3 * g["size"] and g["size"] == len((g["text"] or "").split()) for g in got)
