"""Codecs, sources, streams and models beyond what SQL can check."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import codecs
from quire.operators import corpus, models, select, transforms
from quire.sources import files
from quire.streaming import appends


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=300))
def test_arithmetic_coder_gives_back_its_symbols(symbols):
    assert codecs.arithmetic_decode(codecs.arithmetic_encode(symbols, 16), 16, len(symbols)) == symbols


def test_arithmetic_coder_beats_fixed_width_on_skewed_symbols():
    r = random.Random(1)
    symbols = [0 if r.random() < 0.95 else r.randrange(16) for _ in range(4000)]
    assert len(codecs.arithmetic_encode(symbols, 16)) < 4000 * 4 / 8 * 0.5


@given(st.binary(max_size=500))
@settings(max_examples=40, deadline=None)
def test_byte_codecs_give_back_their_bytes(data):
    for c in codecs.CODECS:
        assert codecs.unpack(codecs.pack(data, c), c) == data


def test_unknown_codec_and_filter_are_errors(spark):
    with pytest.raises(ValueError):
        codecs.pack(b"x", "brotli")
    with pytest.raises(ValueError):
        transforms.filtered(spark.range(1).select(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(1).alias("v")), "other", [])


def test_dct_is_numpys(spark):
    x = np.random.default_rng(3).normal(size=(8, 8))
    rows = [(1, i, j, float(x[i, j])) for i in range(8) for j in range(8)]
    got = {(r.i, r.j): r.v for r in transforms.dct(spark.createDataFrame(rows, "blk long, i int, j int, v double"), ["blk"]).collect()}
    k = np.arange(8)
    basis = np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    assert np.allclose(basis @ x @ basis.T, [[got[i, j] for j in range(8)] for i in range(8)])


def test_pareto_is_the_plain_one(spark):
    r = random.Random(9)
    rows = [(k, r.randrange(30), r.randrange(30), r.randrange(30)) for k in range(300)]
    got = {x.id for x in select.pareto(spark.createDataFrame(rows, "id long, a int, b int, c int"), "id", ["a", "b"], ["c"]).collect()}
    better = lambda x, y: x[1] <= y[1] and x[2] <= y[2] and x[3] >= y[3] and x[1:] != y[1:]
    assert got == {y[0] for y in rows if not any(better(x, y) for x in rows)}


def test_netpbm_and_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PGM").write_bytes(b"P5 3 2 255\n" + bytes(range(6)))
    (tmp_path / "in/b.ppm").write_bytes(b"P6\n1 2\n255\n" + bytes(range(6)))
    (tmp_path / "in/c.txt").write_bytes(b"no image")
    assert [r.path[-5:] for r in files.listed(spark, str(tmp_path / "in"), files.IMAGE_SUFFIXES).collect()] == "a.PGM b.ppm".split()
    got = {r.path[-5:]: r for r in files.netpbm(spark.read.format("binaryFile").load(str(tmp_path / "in"))).collect()}
    assert (got["a.PGM"].h, got["a.PGM"].w, got["a.PGM"].c, list(got["a.PGM"].pixels)) == (2, 3, 1, list(range(6)))
    assert (got["b.ppm"].h, got["b.ppm"].w, got["b.ppm"].c) == (2, 1, 3) and got["c.txt"].pixels is None


def test_atlas_reads_by_id(spark, tmp_path):
    atlas = files.Atlas(spark, str(tmp_path / "atlas"))
    atlas.append(spark.range(50).withColumn("x", F.col("id") * 2))
    atlas.append(spark.range(50, 80).withColumn("x", F.col("id") * 2))
    assert atlas.read(63).first().x == 126
    with pytest.raises(IndexError):
        atlas.read(80)


def test_streams_append_once_and_queue_keeps_errors(spark, tmp_path):
    inbox = str(tmp_path / "in")
    spark.range(20).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).cast("binary").alias("payload")).write.parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    for _ in range(2):
        appends.append_atlas(appends.records(spark, inbox, schema), str(tmp_path / "out"), str(tmp_path / "at"), "id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    work = lambda df: df.withColumn("size", F.octet_length("payload"))
    appends.drain(appends.records(spark, inbox, schema), work, str(tmp_path / "done"), str(tmp_path / "at2"), 15, "payload").awaitTermination()
    done = spark.read.parquet(str(tmp_path / "done"))
    assert done.filter("error IS NULL").count() == 16 and done.filter("error IS NOT NULL").count() == 4


def test_batch_and_streamed_appends_lie_side_by_side(spark, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "atlas")
    spark.range(10).select("id", (F.col("id") * 2).alias("x")).write.parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    atlas = files.Atlas(spark, path)
    appends.append_atlas(appends.records(spark, inbox, schema), path, str(tmp_path / "at"), "id").awaitTermination()
    atlas.append(spark.range(10, 30).select("id", (F.col("id") * 2).alias("x")))
    assert atlas.all().count() == 30 and atlas.read(25).first().x == 50 and atlas.read(3).first().x == 6


def test_a_batch_that_is_done_again_gives_no_repeats(spark, tmp_path):
    import shutil

    inbox = str(tmp_path / "in")
    spark.range(10).select("id", F.lit(b"x").alias("payload")).write.parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    for _ in range(2):
        appends.append_atlas(appends.records(spark, inbox, schema), str(tmp_path / "out"), str(tmp_path / "at"), "id").awaitTermination()
        appends.drain(appends.records(spark, inbox, schema), lambda df: df, str(tmp_path / "done"), str(tmp_path / "at2"), 15, "payload").awaitTermination()
        # as if both had stopped after writing the batch and before saying so
        for place in ("at", "at2"):
            shutil.rmtree(tmp_path / place / "commits")
    assert files.Atlas(spark, str(tmp_path / "out")).all().count() == 10
    assert spark.read.parquet(str(tmp_path / "done")).count() == 10


def test_sine_network_learns(spark):
    grid = transforms.grid(spark, 8).select(F.lit(1).alias("blk"), "y", "x", F.sin(F.col("x") * 2 + F.col("y")).alias("v"))
    r = models.sine_fit(grid, "blk", steps=300).first()
    assert r.last_loss < r.first_loss / 20 and r.psnr > 20


def test_chain_that_is_too_long_is_an_error(spark):
    ring = spark.createDataFrame([(0, None), *((k, k - 1) for k in range(1, 9))], "node long, parent long")
    assert {r.depth for r in corpus.chain_lengths(ring).collect()} == set(range(9))
    with pytest.raises(ValueError):
        corpus.chain_lengths(ring, most=4)


def test_average_linkage_is_the_plain_one(spark):
    r = random.Random(11)
    x = [r.random() + 5 * (k % 3) for k in range(24)]
    pairs = spark.createDataFrame([(a, b, abs(x[a] - x[b])) for a in range(24) for b in range(a + 1, 24)], "a long, b long, d double")
    got = {q.node: q.cluster for q in corpus.average_linkage(pairs, 3).collect()}
    assert all((got[a] == got[b]) == (a % 3 == b % 3) for a in range(24) for b in range(24))
    with pytest.raises(ValueError):
        corpus.average_linkage(pairs, 3, most=10)
