"""The pipeline against plain Python, stage by stage, and its registration."""

import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, odd_rows, tmp_path):
    clean = [(500 + i, " ".join(f"c{i}x{k}" for k in range(40 + i))) for i in range(30)]
    rows = odd_rows + clean
    sources = ["s0", "s1", "s2"]
    df = spark.createDataFrame([(i, t, "xx", sources[i % 3], None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, t) for i, t in rows if not brute.rules(t)["base_failed"]]
    out = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, _ in kept}
    groups = brute.groups(kept, 5)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    out = corpus_pipeline.near_dedup(spark, out, str(tmp_path))
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _ in kept)
    left = {i: x for i, x in brute.without_repeats(kept).items() if x[1] == 0 or x[1] < x[0]}
    out = corpus_pipeline.substring_dedup(spark, out, str(tmp_path))
    got = {r["doc_id"]: r for r in out.collect()}
    old = dict(kept)
    assert out.columns == docs.columns and set(got) == set(left)
    for i, (_, gone, words) in left.items():
        assert got[i]["text"] == (" ".join(words) if gone else old[i]) and got[i]["n_chars"] == len(got[i]["text"])
    packed = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r["n_tokens"] for i, r in packed.items()} == {i: len(x[2]) for i, x in left.items()}
    assert len({(r["batch"], r["place"]) for r in packed.values()}) == len(packed)
    assert {i for i, _ in clean} <= set(packed)


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, " ".join(f"v{k}" for k in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    alone = docs.filter("doc_id is null or doc_id = 3").union(docs.filter("doc_id is null"))
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.near_dedup(spark, alone, "").collect()) == [0, 3]
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_rows_of_one_id_with_different_texts_stay(spark):
    """Only near copies go, whatever ids they share."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, c), (3, c + " end"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"][:2]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == [(1, "a0"), (1, "b0"), (3, "c0"), (4, "")]
    out = corpus_pipeline.substring_dedup(spark, docs.filter("doc_id <> 4"), "")
    assert sorted(r["text"][:3] for r in out.collect()) == ["b0 ", "end"]


def test_names():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
