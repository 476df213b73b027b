"""Stages of the pipeline, each on its own input, against plain versions."""

import corpus_pipeline as P
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quire.llm import toxicity

from . import brute
from .test_near_copies import kept


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    seen = []
    for name, stage in P.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        old, new = pairs(before), pairs(docs) if name != "best_fit_packing" else None
        seen.append(name)
        if new is not None:
            assert docs.columns == columns
        if name == "toxicity":
            machine = toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            low = toxicity.scored(before, machine).filter("score < 0.5").select("doc_id").collect()
            assert sorted(r.doc_id for r in low) == sorted(i for i, _ in new) and 0 < len(new) < len(old)
        elif name == "simhash_near_dedup":
            # the stage's contract: five words, a similarity of 0.8; held against brute-force Jaccard
            assert sorted(i for i, _ in new) == kept(old) and len(new) < len(old)
        elif name == "suffix_dedup":
            want = {i: n - gone for i, n, gone, _, _ in brute.suffix(old)}
            assert {i for i, _ in new} == set(want)
            # a text keeps its bytes but for pieces of cut code points
            assert all(want[i] - 6 * 50 <= len(t.encode()) <= want[i] for i, t in new)
            assert any(want[i] < len((t or "").encode()) for i, t in old)
        elif name == "decontamination":
            clean = {i for i, *_, hit in brute.decontaminate(old, items) if not hit}
            assert {i for i, _ in new} == clean and len(new) < len(old)
        else:
            got = docs.toPandas()
            assert set(got.doc_id) == {i for i, _ in old}
            assert (got.groupby("sequence_id").length.sum() <= 4096).all()
    assert seen == ["toxicity", "simhash_near_dedup", "suffix_dedup", "decontamination", "best_fit_packing"]


def test_run(spark, sf_dir):
    got = P.run(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_edge_rows(spark, docs, sf_dir):
    """Null ids and texts, repeats and further columns go through every stage."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        before, rows = rows, stage(spark, rows, sf_dir)
        assert rows.count() > 0
    assert before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


CLASHES = ["score", "_f", "_r", "_b", "_text", "root", "key", "id", "a.b", "shard", "_metadata", "bands", "fp", "n", "_label", "_h", "SCORE_", "candidate", "list", "member"]


def test_columns_of_any_name_come_out_as_they_went_in(spark, sf_dir, tmp_path):
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = plain
    for name in CLASHES:
        rows = rows.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    rows.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, wide, sf_dir).write.parquet(str(tmp_path / f"wide{k}"))
        stage(spark, plain, sf_dir).write.parquet(str(tmp_path / f"plain{k}"))
        before, wide, plain = wide, spark.read.parquet(str(tmp_path / f"wide{k}")), spark.read.parquet(str(tmp_path / f"plain{k}"))
        assert wide.columns == before.columns
        assert sorted(map(str, wide.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        assert not wide.filter(" OR ".join(f"NOT `{c}` <=> concat('{c}', doc_id)" for c in CLASHES)).count()


def test_run_leaves_only_the_stages_tables(spark, sf_dir):
    import os

    from quire.llm import _spark as S

    S.cleanup(spark)
    P.run(spark, sf_dir)
    left = os.listdir(f"{S.shared_dir(spark)}/quire")
    assert left == ["tables"]


def test_cleanup_removes_intermediate_tables(spark, docs):
    import os

    from quire.llm import _spark as S
    from quire.llm.substring_dedup import substring_dedup

    assert substring_dedup(docs).count() and os.listdir(f"{S.shared_dir(spark)}/quire")
    S.cleanup(spark)
    assert not os.path.exists(f"{S.shared_dir(spark)}/quire")


def test_rows_go_without_moving_texts(spark, sf_dir, monkeypatch):
    """Rows that go are sent to the texts, whatever Spark's own threshold, up to a bound; beyond it a shuffle gives the same."""
    from quire.llm import _spark as S

    docs = S.stable(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = S.keyed_all(docs, "f", "r").filter("r % 3 = 0").select("f", "r")
    want = [r.doc_id for r in S.keyed_all(docs, "f", "r").filter("r % 3 <> 0").select("doc_id").collect()]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, join in ((1 << 21, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(P, "BROADCAST", most)
            left = P._without(docs, gone)
            assert join in left._jdf.queryExecution().executedPlan().toString()
            assert sorted(r.doc_id for r in left.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_decoded_where_they_are_cut(spark, docs):
    """The suffix stage has no second Python function, and so no second worker, beside the one that cuts; texts are those of the kept bytes."""
    from quire.llm import _spark as S
    from quire.llm.suffix_dedup import suffix_dedup

    # the shared bytes end inside a code point
    halves = spark.createDataFrame([(900, "q7" * 40 + "é end", 84), (901, "q7" * 40 + "è other", 86)], "doc_id long, text string, n_chars long")
    rows = S.stable(docs.select("doc_id", "text", "n_chars").unionByName(halves))
    assert "EvalPython" not in P.suffix(spark, rows, "")._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r._f, r._r)
    kept, texts = (sorted(suffix_dedup(rows, as_text=t).collect(), key=key) for t in (False, True))
    assert [bytes(r.kept).decode("utf-8", "ignore") for r in kept] == [r.kept for r in texts]
    assert any(bytes(r.kept) != t.kept.encode() for r, t in zip(kept, texts, strict=True))
