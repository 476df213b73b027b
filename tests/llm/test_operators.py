"""Every operator against a plain version, on rows with nulls, ties, repeats, empty and long texts."""

import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import decontamination, fingerprints, language, lm_scoring, packing, simhash, substring_dedup, suffix_dedup, toxicity, warc
from quire.llm import _bytes as B
from quire.llm import _learn as L
from quire.llm import _lists

from . import brute


def table(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(got, want):
    assert got == sorted(want, key=repr)


@pytest.fixture(scope="module")
def items(rows):
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    return [(1, " ".join(texts[0].split()[5:30])), (2, texts[1]), (2, texts[1]), (None, texts[2]), (3, ""), (4, None), (5, "The the"), (6, "x"), (7, texts[3].upper())]


@pytest.mark.parametrize("most", [decontamination.BROADCAST, 0])
def test_decontamination(spark, docs, rows, items, most, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST", most)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs, benchmark)
    same(table(got, "id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), brute.decontaminate(rows, items))


def test_decontamination_of_nothing(spark, docs, empty):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert not decontamination.decontaminate(docs, benchmark).filter("contaminated").count()
    assert decontamination.decontaminate(empty, benchmark).count() == 0


@pytest.mark.parametrize("many", [suffix_dedup.MANY, 2])
def test_suffix_dedup(docs, rows, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    got = suffix_dedup.suffix_dedup(docs)
    same(table(got, "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)), brute.suffix(rows))


@pytest.mark.parametrize("size", [2, 7, 21])
def test_suffix_dedup_of_other_sizes(docs, rows, size):
    short = docs.filter("length(text) < 600 OR text IS NULL")
    got = suffix_dedup.suffix_dedup(short, size=size)
    same(table(got, "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)), brute.suffix([r for r in rows if len(r[1] or "") < 600], size))


def test_suffix_dedup_keeps_whole_code_points(docs):
    texts = [r[0] for r in suffix_dedup.suffix_dedup(docs).select(suffix_dedup.kept_text("kept")).collect()]
    assert all(t.encode().decode() == t for t in texts)


def test_substring_dedup(docs, rows):
    got = substring_dedup.substring_dedup(docs)
    same(table(got, "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)), brute.substring(rows))
    spans = got.select("n_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x.after - x.first).alias("n"))
    assert not spans.filter("n_removed <> n").count()


def test_simhash(docs, rows):
    got = simhash.near_duplicates(docs).select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    same(table(got, *got.columns), brute.components(rows))


@pytest.mark.parametrize(("long", "together"), [(3, 1), (3, 3), (1024, 2)])
def test_simhash_of_long_lists_and_other_keys(docs, rows, long, together, monkeypatch):
    monkeypatch.setattr(_lists, "LONG", long)
    monkeypatch.setattr(_lists, "PART", 50)
    monkeypatch.setattr(simhash, "TOGETHER", together)
    got = simhash.near_duplicates(docs).select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    same(table(got, *got.columns), brute.components(rows))


@pytest.mark.parametrize(("bits", "together", "long"), [(2, 3, 1024), (4, 1, 40), (4, 3, 1024), (7, 3, 40)])
def test_index_loses_no_link(spark, bits, together, long, monkeypatch):
    """Random fingerprints near each other: the index's components are those of all pairs."""
    import numpy as np

    from quire.llm._components import components, roots

    monkeypatch.setattr(_lists, "LONG", long)
    monkeypatch.setattr(simhash, "TOGETHER", together)
    r = random.Random(bits)
    near = [r.getrandbits(64) for _ in range(40)]
    fps = np.array(sorted({c ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for c in near * 8}), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    postings = frame.select(F.explode(simhash.lists(F.col("fp"), bits)).alias("list"), F.col("fp").alias("member"))
    found = {x.node: x.root for x in components(_lists.met(postings, lambda k, m, _: simhash.links(k, m, bits))).collect()}
    every = fps.view(np.int64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits)
    order = np.argsort(every)
    at = np.argsort(order)
    want = roots(len(fps), at[a], at[b])
    assert [found.get(int(x), int(x)) for x in every] == [int(every[order[want[k]]]) for k in at]


def test_pairs_below_the_minimum_are_tallied_out():
    import numpy as np

    a = np.zeros(3, np.uint64)
    b = np.array([0x01010101, 0x0101010101, 0x0F], np.uint64)
    assert simhash.tally(a, b).tolist() == [4, 3, 7]
    assert simhash.linked(a, b, 4).tolist() == [True, False, True]
    # of pairs that share three bytes, so that they meet, most are tallied out at four
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, 5000, np.uint64)
    y = x ^ r.integers(0, 1 << 63, 5000, np.uint64) & np.uint64(0xFFFFFFFFFF)
    assert (simhash.tally(x, y) >= 3).all() and (simhash.tally(x, y) < 4).mean() > 0.9 and not simhash.linked(x, y, 4).any()


def test_components_around_hubs(spark, monkeypatch):
    from quire.llm import _components

    monkeypatch.setattr(_components, "MANY", 3)
    edges = [(0, k) for k in range(1, 30)] + [(100, k) for k in range(20, 50)] + [(200, 201), (201, 202)]
    got = {(x.node, x.root) for x in _components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(k, 0) for k in [*range(1, 50), 100]} | {(201, 200), (202, 200)}


@pytest.mark.parametrize("batch", [10_000, 7])
def test_lm_scoring(spark, docs, rows, batch):
    """Batches of few rows cut blocks into parts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check_lm_scoring(docs, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check_lm_scoring(docs, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    got = lm_scoring.lm_score(docs, L.held_out("doc_id", 7, 2))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (repr(r[:5]), r[5], r[6])
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), sorted(brute.lm(rows, held), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-4)


def test_lm_codings_are_distributions():
    import numpy as np

    r = random.Random(9)
    text = pa.array(["".join(r.choice("abc d") for _ in range(300)) for _ in range(5)])
    found = np.concatenate([x for x, _ in lm_scoring.strings(*B.buffer(text))])
    levels = [lm_scoring.Level(lm_scoring.ORDER, *np.unique(found, return_counts=True))]
    for size in range(lm_scoring.ORDER - 1, -1, -1):
        symbols, plain, updates = levels[0].below(size)
        levels.insert(0, lm_scoring.Level(size, symbols, updates, plain))
    for start in lm_scoring.STARTS:
        for context in [*np.unique(found >> np.uint64(8))[:50].tolist(), 12345]:
            strings = (np.uint64(context) << np.uint64(8) | np.arange(256, dtype=np.uint64)) & lm_scoring._mask(start)
            assert (10 ** lm_scoring.coded(start, strings, levels)).sum() == pytest.approx(1)


def test_squeezed_numbers_come_back():
    import numpy as np

    for kind in (np.uint64, np.uint32, np.float32):
        for n in (0, 1, 1000):
            x = np.arange(n).astype(kind) * 3
            assert (B.spread(B.squeezed(x), kind) == x).all()


def test_lm_scoring_without_training(docs):
    got = lm_scoring.lm_score(docs, F.lit(True)).select(F.max("n_known"), F.max("train_tokens"), F.max("score")).first()
    assert got[0] == 0 and got[1] == 0 and got[2] < 0


def test_fingerprints(docs, rows):
    found = fingerprints.S.row_keyed(docs, 1, id=F.col("doc_id"), text=F.col("text")).select("_f", "_r", "id", "text").collect()
    # the written rows have other places than those that the operator writes, so rows that share an id are left out of the comparison of neighbours
    want = brute.fingerprints([(r.id, r.text) for r in sorted(found, key=lambda r: (r.id is not None, r.id or 0, r._f, r._r), reverse=True)])
    got = fingerprints.compared(docs).collect()
    assert len(got) == len(want) and sorted(r.fingerprint for r in got) == sorted(w[3] for w in want)
    ids = [i for i, _ in rows]
    once = [w for w, after in zip(want, want[1:], strict=False) if w[0] is not None and ids.count(w[0]) == 1 and ids.count(after[0]) == 1]
    by = {r.doc_id: tuple(r) for r in got if r.doc_id is not None}
    assert len(once) > 30
    for w in once:
        assert by[w[0]][:5] == w[:5] and by[w[0]][5:] == pytest.approx(w[5:])


def test_fingerprints_of_ranges_that_split_an_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprints, "STEP", 3)
    rows = [(7, f"w{k} text of many rows") for k in range(60)] + [(8, "x"), (None, "y"), (6, "z z z")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "t"))
    table_ = spark.read.parquet(str(tmp_path / "t"))
    place = fingerprints.S.row_keyed(table_, 1, id=F.col("doc_id"), text=F.col("text")).collect()
    want = brute.fingerprints([(r.id, r.text) for r in sorted(place, key=lambda r: (r.id is not None, r.id or 0, r._f, r._r), reverse=True)])
    got = [tuple(r) for r in fingerprints.compared(table_).collect()]
    assert sorted(map(repr, (g[:5] for g in got))) == sorted(map(repr, (w[:5] for w in want)))
    assert sorted(round(g[5] + 10 * g[6], 6) for g in got) == sorted(round(w[5] + 10 * w[6], 6) for w in want)


def test_packing(docs, rows):
    path = packing.tokenizer_path()
    got = packing.pack(docs, length=100).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    lengths = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sorted(got.groupby(["doc_id", "piece"], dropna=False).length.sum()) and got.length.sum() == sum(lengths)
    for _, bin_ in got.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert list(bin_.offset) == [0, *bin_.length.cumsum()[:-1]] and bin_.length.sum() <= 100


def test_pieces_of_a_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END]
        for start in range(0, len(ids), 100):
            part = ids[start : start + 100]
            want.append((i, start // 100, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    same(table(packing.pack(docs, length=100), "doc_id", "piece", "start", "length", "ids_crc32"), want)


def test_best_two_fit():
    import numpy as np

    r = random.Random(11)
    for _ in range(200):
        size = r.choice([10, 37, 100])
        lengths = np.array([r.randint(1, r.choice([size, size // 2, size // 3])) for _ in range(r.randint(0, 60))], np.int64)
        sequence, offset = packing.best_two_fit(lengths, size)
        bins = {}
        for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
            assert o == sum(bins.setdefault(s, []))
            bins[s].append(n)
        assert sorted(sorted(b) for b in bins.values()) == sorted(sorted(b) for b in brute.two_fit(lengths.tolist(), size))


def test_word_ids_are_the_tokenizers():
    ids = packing.WordIds(packing.tokenizer_path())
    r = random.Random(3)
    chars = "aAbÉé'.,!%<|>0 5́̇İß½\n\t_-xyzsK\x1c\x85"
    texts = ["a<|endoftext|>b", "<|ENDOFTEXT|> AB<|", "don't won't'd. DON'T.", *("".join(r.choice(chars) for _ in range(r.randint(1, 40))) for _ in range(3000))]
    for part in (texts, [*texts[2:1500], ""], ["", ""]):
        got, at = ids.of(*B.buffer(pa.array(part)))
        for a, z, want in zip(at, at[1:], ids.tokenizer.encode_batch(part, add_special_tokens=False), strict=False):
            assert list(got[a : z - 1]) == want.ids and got[z - 1] == packing.END


def test_warc(spark, tmp_path):
    pages = [(1, "u", "p" * 150), (2, None, "p" * 150), (1, "u", "p" * 150), (3, "a b\r\nc", None), (4, "", ""), (5, "x", "short"), (6, "x", "short"), (None, "n", "q" * 100), (9, "é", "é" * 60), (8, "é", "é" * 60), (None, "n", "p" * 150)]
    df = spark.createDataFrame([(*p, "extra", 1) for p in pages], "page_id long, url string, html string, record string, bytes int")
    index = warc.archive(df, str(tmp_path / "w"))
    got = warc.read_archives(index, str(tmp_path / "w")).collect()
    assert len(got) == len(pages)
    by = sorted((r.id or "", r.record_type, r.refers_to or "", r.payload_bytes) for r in got)
    assert by == sorted([("1", "response", "", 150), ("1", "revisit", "1", 150), ("2", "revisit", "1", 150), ("3", "response", "", 0), ("4", "response", "", 0), ("5", "response", "", 5), ("6", "response", "", 5), ("", "response", "", 100), ("8", "response", "", 120), ("9", "revisit", "8", 120), ("", "revisit", "1", 150)])
    one = warc.read_archives(index.filter(F.col("at") > 0).limit(1), str(tmp_path / "w")).first()
    assert one.payload is None or len(one.payload) == one.payload_bytes


def test_warc_of_small_bundles_and_long_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE", 1 << 18)
    monkeypatch.setattr(warc, "TASK", 1 << 17)
    r = random.Random(5)
    html = ["".join(r.choices("abc <p>é", k=n)) for n in [200] * 300 + [300_000, 140_000] + [1000] * 200]
    pages = spark.createDataFrame(list(enumerate([*html, *html[:50]])), "page_id long, html string").withColumn("url", F.lit("u")).repartition(3)
    index = warc.archive(pages, str(tmp_path / "w"))
    assert index.select("bundle").distinct().count() > 3 and index.filter(f"length > {warc.FRAME}").count() == 2
    read = warc.read_archives(index, str(tmp_path / "w"))
    assert read.select(F.spark_partition_id()).distinct().count() > 1
    got = {int(x.id): x for x in read.collect()}
    assert sorted(got) == list(range(len(html) + 50))
    for k, t in enumerate(html):
        assert got[k].payload.decode() == t and got[k].refers_to is None
    assert all(got[len(html) + k].refers_to == str(k) for k in range(50))


def test_warc_tells_of_damage(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(1, "u", "plain text " * 30)], "page_id long, url string, html string")
    index = warc.archive(pages, str(tmp_path / "w")).cache()
    place = index.first()
    path = f"{tmp_path}/w/{place.bundle}"
    with open(path, "rb") as file:
        data = zstandard.ZstdDecompressor().decompress(file.read())
    with open(path, "wb") as file:
        writer = warc.BundleWriter(file)
        writer.add(data.replace(b"plain", b"plane"))
        writer.close()
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_archives(index, str(tmp_path / "w")).collect()


def test_empty_tables(spark, empty, tmp_path):
    for got in (
        suffix_dedup.suffix_dedup(empty), substring_dedup.substring_dedup(empty), simhash.near_duplicates(empty), lm_scoring.lm_score(empty, F.lit(False)),
        fingerprints.compared(empty), packing.pack(empty), language.predicted(empty, language.train(empty)),
        toxicity.scored(empty, toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))),
        warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e")),
    ):
        assert got.count() == 0


def test_toxicity(spark):
    r = random.Random(4)
    plain = ["tree", "house", "river", "stone", "cloud", "bread", "light", "water"]
    rows = []
    for k in range(400):
        w = [r.choice(plain) for _ in range(20)]
        # either word alone is harmless; together they are not
        kind = k % 4
        w += {0: ["alpha"], 1: ["omega"], 2: ["alpha", "omega"], 3: []}[kind]
        rows.append((k, " ".join(w), int(kind == 2)))
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(None, None, "x"), (1000, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    assert sum((got[k] >= 0.5) == y for k, _, y in rows) >= 396
    assert 0 <= got[None] <= 1 and 0 <= got[1000] <= 1


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x.score for x in toxicity.scored(docs, toxicity.train(docs, none)).select("score").collect()} == {0.25}


def test_language(spark):
    r = random.Random(6)
    words = {"aa": ["bana", "kana", "lamana", "tama"], "bb": ["strikt", "krumpf", "zwickt", "plotz"]}
    rows = [(k, " ".join(r.choice(words[x]) for _ in range(12)), x) for k, x in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame([*rows, (900, "krumpfstrikt zwick", None), (901, None, "aa"), (902, "12 -- !", "bb"), (903, "", None)], "doc_id long, text string, lang string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in language.predicted(docs, language.train(docs)).collect()}
    assert all(got[k][0] == x for k, _, x in rows) and got[900][0] == "bb"
    assert [got[k] for k in (901, 902, 903)] == [("und", 0.0)] * 3


def test_components_of_a_long_path(spark):
    from quire.llm._components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(k, 0) for k in range(1, 41)} | {(101, 100)}


def test_suffix_order_is_the_order_of_suffixes():
    import numpy as np

    from quire.llm._columns import suffix_order

    r = random.Random(8)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 30))) for _ in range(50)]
    text, size, lcp = suffix_order(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), 9)
    found = [strings[t][len(strings[t]) - n :] for t, n in zip(text.tolist(), size.tolist(), strict=True)]
    assert found == sorted(found)
    for k in range(1, len(found)):
        a, b = found[k - 1], found[k]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert lcp[k] == min(n, 9)
