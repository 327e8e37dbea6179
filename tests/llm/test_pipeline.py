"""The pipeline on the smallest tables, stage by stage, against plain Python."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "language_id":
            assert len(after) >= 0.97 * len(before) and all(any(c.isalpha() for c in r.text) for r in after.values())
        if name == "line_dedup":
            assert set(after) == set(before)
            assert all(set(after[i].text.split("\n")) <= set(before[i].text.split("\n")) | {""} for i in after)
            assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
        if name == "near_dedup":
            sets = {i: shingles(r.text) for i, r in before.items()}
            group = {i: i for i in sets}
            for a in sorted(sets):
                for b in sorted(sets):
                    if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        lo, hi = sorted((group[a], group[b]))
                        group = {i: lo if g == hi else g for i, g in group.items()}
            assert set(after) == {i for i in group if group[i] == i}
        if name == "decontamination":
            exact = {i for i, r in before.items() if any(x in r.text for x in items)}
            assert not exact & set(after) and len(set(before) - set(after)) <= 2 * len(exact) + 2
        before = after
    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == set(before)


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_odd_rows_and_clashing_names(spark):
    """Every stage keeps all columns as they are, whatever their names, and takes repeated rows and missing ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    names = ["_kept", "_gone", "_doc", "score", "lang_pred", "rejected", "row", "at", "id", "component", "n_lines", "n_dropped", "gone", "lines", "key", "comp", "held by the operator"]
    rows = docs
    for c in names:
        rows = rows.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    rows = rows.union(rows.where("doc_id = 5")).union(rows.where("doc_id IN (5, 6)").withColumn("doc_id", F.lit(None).cast("long")))
    rows = corpus_pipeline.cut(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, rows, SF))
        assert out.columns == rows.columns
        assert out.where(" OR ".join(f"`{c}` <> concat('{c}', doc_id)" for c in names)).count() == 0
        if name == "near_dedup":
            assert out.where("doc_id IS NULL").count() == 0 and out.where("doc_id = 5").count() == 1
        rows = out
    assert corpus_pipeline.pack(spark, rows, SF).count()


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        assert docs.count() == 0
