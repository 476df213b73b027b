"""The machine learns from all of 15,000 labelled rows, rare terms included."""

import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from quire.llm import _learn as L
from quire.llm import _spark as S
from quire.llm import language, toxicity


def test_rare_terms_of_many_labels_are_learned(spark):
    rare = [f"rare{k}" for k in range(10)]
    rows = [(i, f"plain words {rare[i // 30]}" if i % 10 == 0 and i < 300 else "plain words", int(i % 10 == 0)) for i in range(15_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    _, bucket = toxicity.terms(pa.array([" ".join(rare)]))
    assert len(bucket) == 10 and np.isin(bucket, machine.buckets).all()


def test_sample_is_bounded_whatever_the_ids(spark, tmp_path):
    spark.range(40_000).select(F.lit(7).alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(4).write.parquet(str(tmp_path / "t"))
    keys = S.row_keyed(spark.read.parquet(str(tmp_path / "t")), 1, id=F.col("doc_id"), part=F.col("text").cast("int") % 10)
    drawn = L.sample(keys, 12_000).select("_f", "_r").collect()
    assert len(drawn) == len(set(drawn)) == 12_000 and sorted(drawn) == sorted(L.sample(keys, 12_000).select("_f", "_r").collect())
    assert {r["part"]: r["count"] for r in L.sample(keys, 3_000, "part").groupBy("part").count().collect()} == dict.fromkeys(range(10), 3_000)
    assert L.sample(keys, 40_000).count() == 40_000


def test_rows_of_one_id_are_bounded(spark):
    rows = [(1, f"word{k % 7}", k % 2) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic").limit(5), most=100)
    assert np.isfinite(machine.bias)


def test_a_word_that_matters_only_beside_another(spark):
    """A group's name is as frequent in harmless texts as in toxic ones; only beside an insult it is toxic."""
    r = random.Random(12)
    plain = [f"plain{k}" for k in range(30)]
    rows = []
    for k in range(1200):
        kind = k % 6
        # the name comes with insults (toxic) and, as often, with threats that are toxic without it
        words = {0: ["insult", "name"], 1: ["insult"], 2: ["name"], 3: ["threat"], 4: ["name"], 5: []}[kind]
        rows.append((k, " ".join([*r.choices(plain, k=12), *words]), int(kind in (0, 3))))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    _, bucket = toxicity.terms(pa.array(["name"]))
    assert np.isin(bucket, machine.buckets).all()
    got = {x.doc_id: x.score >= 0.5 for x in toxicity.scored(frame.select("doc_id", "text"), machine).collect()}
    assert sum(got[k] == bool(y) for k, _, y in rows) >= 1180


def test_scores_of_repeated_and_long_texts(spark):
    long = " ".join(["tree house"] * 30_000 + ["awful"])
    rows = [(k, "awful words" if k % 2 else "fine words", k % 2) for k in range(200)]
    frame = spark.createDataFrame([*rows, (900, long, None), (901, long, None), (902, "awful words", None), (902, "awful words", None)], "doc_id long, text string, toxic int")
    machine = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    got = [(x.doc_id, x.score) for x in toxicity.scored(frame.select("doc_id", "text"), machine).collect()]
    score = dict(got)
    assert len(got) == frame.count() and score[900] == score[901] >= 0.5 and score[902] == score[1]


def test_machine_is_the_formula():
    """Scores and one step's slopes against sums over pairs."""
    r = np.random.default_rng(1)
    buckets = np.sort(r.choice(1000, 6, replace=False))
    machine = toxicity.Machine(0.3, buckets, r.normal(size=6), r.normal(size=(6, toxicity.FACTORS)))
    text, bucket = np.array([0, 0, 0, 2, 2, 3]), np.array([*buckets[:3], *buckets[3:5], 2000])
    got = machine.scores(4, text, bucket)
    for k in range(4):
        held = [int(np.searchsorted(buckets, b)) for t, b in zip(text, bucket, strict=True) if t == k and b in buckets]
        z = machine.bias + sum(machine.weights[a] for a in held) + sum(machine.vectors[a] @ machine.vectors[b] for n, a in enumerate(held) for b in held[n + 1 :])
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-12


def test_language_against_a_plain_version(spark):
    r = random.Random(13)
    syllables = {"aa": ["ba", "na", "ka", "mi", "lo"], "bb": ["str", "krü", "plo", "zwi", "ft"], "cc": ["ée", "ba", "ou", "lo", "xi"]}
    word = lambda x: "".join(r.choice(syllables[x]) for _ in range(r.randint(1, 3)))
    rows = [(k % 50, " ".join(word(x) for _ in range(r.randint(1, 25))), x) for k, x in enumerate(["aa", "bb", "cc", "aa"] * 50)]
    rows += [(300, rows[0][1], None), (300, rows[0][1], None), (None, "BA na! Krü-plo 12 ééé", None), (301, " ".join(["ba krü"] * 20_000), None), (302, "b", None), (303, "日本", None), (304, "", None), (305, "Q7", None)]
    frame = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, lang string, word string, n int")
    got = language.predicted(frame, language.train(frame)).collect()
    want = plain_language([(t, x) for _, t, x in rows], [t for _, t, _ in rows])
    assert sorted(map(repr, ((x.doc_id, x.lang_pred) for x in got))) == sorted(map(repr, ((i, w[0]) for (i, _, _), w in zip(rows, want, strict=True))))
    assert np.allclose(sorted(x.score for x in got), sorted(w[1] for w in want), atol=1e-5)


def plain_language(train, texts):
    import math
    import re
    from collections import Counter, defaultdict

    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    runs = lambda w, n: [x for x in (f" {w} "[k : k + n] for k in range(len(w) + 3 - n)) if x.strip()]
    counts = [defaultdict(Counter) for _ in range(language.LONGEST + 1)]
    for t, x in train:
        if x is not None:
            for w in words(t):
                counts[0][w][x] += 1
                for n in range(1, language.LONGEST + 1):
                    for run in runs(w, n):
                        counts[n][run][x] += 1
    languages = sorted({x for _, x in train if x is not None})
    logs = []
    for table in counts:
        known = {k: {x: c for x, c in v.items() if c >= language.SEEN} for k, v in table.items()}
        known = {k: v for k, v in known.items() if v}
        total = {x: sum(v.get(x, 0) for v in known.values()) for x in languages}
        logs.append({k: [math.log((v.get(x, 0) + 0.5) / (total[x] + 0.5 * len(known) + 1)) for x in languages] for k, v in known.items()})
    out = []
    for t in texts:
        values = []
        for w in words(t):
            value = logs[0].get(w)
            for n in range(language.LONGEST, 0, -1):
                if value is None and (found := [logs[n][x] for x in runs(w, n) if x in logs[n]]):
                    value = [sum(f[k] for f in found) / len(found) for k in range(len(languages))]
            values.append(value or [0.0] * len(languages))
        if not values:
            out.append(("und", 0.0))
            continue
        mean = [sum(v[k] for v in values) / len(values) for k in range(len(languages))]
        share = [math.exp((m - max(mean)) * math.sqrt(len(values))) for m in mean]
        out.append((languages[mean.index(max(mean))], 1 / sum(share)))
    return out
