import corpus_pipeline
from pyspark.sql import functions as F

from .conftest import frame, prose


def edited(seed, n):
    """Copies with one word changed each: any two are over the similarity."""
    words = prose(seed, 120).split()
    return [" ".join([*words[: 20 * i], f"edit{i}", *words[20 * i + 1 :]]) for i in range(n)]


def test_stages_in_turn(spark, odd):
    """Each stage against what it must do to its own input."""
    passage = prose(77, 60)
    rows = [(1000 + i, prose(i, 120), "en", "ab"[i % 2]) for i in range(30)] + [(100 + i, t, "en", "a") for i, t in enumerate(edited(500, 5))]
    rows += [(200 + i, f"{prose(600 + i, 80)} {passage}", "en", "b") for i in range(6)] + [(300, "# $ % & " * 50, "en", "a"), (301, "too short", "en", "a")]
    docs = frame(spark, rows).unionByName(odd)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], "")
        out = spark.createDataFrame(out.toPandas(), out.schema) if name != "packing" else out
        seen.append(out)
        if name != "packing":
            assert out.columns == docs.columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    assert not ids[1] & {1, 2, 300, 301} and set(range(1000, 1030)) <= ids[1]
    assert ids[2] & set(range(100, 105)) == {100} and set(range(1000, 1030)) <= ids[2]
    with_passage = seen[3].filter(F.col("text").contains(passage)).count()
    assert with_passage == 1 and seen[2].filter(F.col("text").contains(passage)).count() == 6
    sizes = seen[3].agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    mixed = seen[4].agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert abs(mixed - sizes) < 0.02 * sizes
    assert seen[4].filter("n_chars <> char_length(text)").count() == 0
    packed = seen[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert packed <= 1024


def test_run_over_a_table(spark, tmp_path):
    frame(spark, [(i, prose(i, 100), "en", "a") for i in range(12)]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() > 6
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "mixing", "packing"]


def test_stages_over_no_rows_and_a_very_long_blank(spark, nothing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, "")
        assert out.count() == 0 and (name == "packing" or out.columns == nothing.columns), name
    blank = frame(spark, [(1, "a" + " " * 1_000_000 + "b <|endoftext|>"), (2, "\n" * 1_000_000)])
    assert corpus_pipeline.packed(spark, blank, "").agg(F.countDistinct("doc_id")).first()[0] == 2
