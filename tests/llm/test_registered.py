"""The registered queries against brute force, forward passes in plain Python, and tables without rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import fmindex, langid, pseudonyms, queries, subword, toxicity

from .common import components, corpus, frame, words
from .test_pairs import fingerprint
from .test_texts import plain_hits, sample_texts


def tables(spark, folder, rows, items):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_decontamination_query(spark, tmp_path):
    rows = corpus(30)
    items = [(k, " ".join(rows[k][1].split()[2 : 2 + n])) for k, n in enumerate([12, 9, 8, 5, 3])] + [(7, rows[0][1]), (8, None), (9, "")]
    folder = tables(spark, tmp_path, rows, items)
    real = [(str(i), t) for i, t in items if t]
    want, long = [], {r[0] for r in rows if r[1] and len(r[1]) >= 20000}  # too long for brute force
    for doc_id, text, *_ in (r for r in rows if r[0] not in long):
        n, hit, found = plain_hits(text, real)
        names = sorted(found)
        want.append((doc_id, n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= 2))
    got = [tuple(r) for r in queries.op4_fmindex(spark, folder).collect()]
    assert sorted(map(repr, (r for r in got if r[0] not in long))) == sorted(map(repr, want))
    assert len(got) == len(rows) and all(r[1] == 30000 for r in got if r[0] in long)


def test_simhash_query(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None]
    folder = tables(spark, tmp_path, rows, [(1, "x")])
    prints = [fingerprint(r[1]) for r in rows]
    label = components(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    least = {c: min(r[0] for r, x in zip(rows, label, strict=True) if x == c) for c in label}
    want = [(r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, label, strict=True)]
    assert sorted(tuple(r) for r in queries.op8_simhash(spark, folder).collect()) == sorted(want)


def test_mixing_query_is_the_same_on_any_layout(spark, tmp_path):
    one = tables(spark, tmp_path / "a", corpus(), [(1, "x")])
    frame(spark).repartition(5, "n_chars").write.parquet(f"{tmp_path}/b/documents.parquet")
    got = [sorted(map(repr, queries.op5_sainte_lague(spark, d).collect())) for d in (one, f"{tmp_path}/b")]
    assert got[0] == got[1] and len(got[0]) == len(corpus())
    sizes = sorted(len(words(r[1])) for r in corpus())
    assert sorted(r["size"] for r in queries.op5_sainte_lague(spark, one).collect()) == sizes


def plain_grams(text, table, sizes, bits):
    """Buckets of each word's n-grams, a blank on both sides of the word."""
    raw, out, word = text.encode() + b" ", [], b""
    for byte in raw:
        if table[byte]:
            word += bytes([byte + 32 if 65 <= byte <= 90 else byte])
        elif word:
            padded, grams = b" " + word + b" ", []
            for n in sizes:
                for k in range(len(padded) - n + 1):
                    value = int.from_bytes(padded[k : k + n], "little")
                    grams.append((value + n) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - bits))
            out.append(grams)
            word = b""
    return out


def test_language_scores_against_a_plain_forward_pass(spark):
    rows = sample_texts() + [(900, "Unë flas shqip ändern", None, "s", 0), (901, "der der und", None, "s", 0)]
    model = langid.fit(frame(spark, rows))
    got = {r.doc_id: r.found for r in langid.identify(frame(spark, rows), model, "found").collect()}
    for doc_id, text, *_ in rows:
        grams = [g for w in plain_grams(text, subword.LETTERS, langid.SIZES, langid.BITS) for g in w]
        z = [sum(float(model.table[g, c]) for g in grams) / len(grams) + float(model.bias[c]) for c in range(len(model.labels))]
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(len(p)), key=p.__getitem__)
        fit = sum(float(model.typical[g, best]) for g in grams) / (len(grams) + langid.DAMP)
        assert got[doc_id].lang_pred == model.labels[best] and abs(got[doc_id].score - p[best] / sum(p)) < 1e-6
        assert got[doc_id].rejected == (p[best] / sum(p) < model.threshold or fit < model.floor)


def toxic_corpus(noise=0.0, quotes=0):
    rng = random.Random(9)
    calm, rude = ["table", "river", "window", "green", "walking", "paper", "sound"], ["grumpf" + e for e in ("el", "ling", "isch", "o", "en", "ig")]
    rows, labels = [], []
    for k in range(800):
        toxic = k % 4 == 0
        w = [rng.choice(calm) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(20, 60))]
        for _ in range(2 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(rude))
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(toxic) ^ (rng.random() < noise)))
    for k in range(quotes):  # clean texts that hold a rude word
        rows.append((1000 + k, " ".join([*rng.choices(calm, k=30), rng.choice(rude), rng.choice(rude)]), "en", "s", 0))
        labels.append((1000 + k, 1, 0))
    return rows, labels


@pytest.mark.parametrize("noise, quotes", [(0.05, 0), (0.0, 12), (0.05, 12)])
def test_toxicity_with_wrong_labels_and_quotes(spark, noise, quotes):
    rows, labels = toxic_corpus(noise, quotes)
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows[:800]), model).collect()}
    held = [k for k in range(800) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((got[k] >= toxicity.THRESHOLD) == (k % 4 == 0) for k in held) >= 0.93 * len(held)


def test_toxicity_scores_against_a_plain_forward_pass(spark):
    rows, labels = toxic_corpus()
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    some = [*rows[:60], (5000, "", "en", "s", 0), (5001, "one", "en", "s", 0), (5002, "grumpfel grumpfel", "en", "s", 0)]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, some), model).collect()}
    for doc_id, text, *_ in some:
        scores = [np.clip(np.mean([float(model.table[g]) for g in w]) + model.bias, toxicity.FLOOR, -toxicity.FLOOR) if w else np.clip(model.bias, toxicity.FLOOR, -toxicity.FLOOR) for w in plain_grams(text, toxicity.NOT_BLANK, toxicity.SIZES, toxicity.BITS)]
        top = (sorted(scores, reverse=True) + [toxicity.FLOOR] * 2)[:2]
        z = top[0] * model.doc[0] + top[1] * model.doc[1] + model.doc[2]
        assert abs(got[doc_id] - 1 / (1 + math.exp(-np.clip(z, -40, 40)))) < 1e-4


def test_rare_labels_keep_their_rows():
    rates = subword.sample_rates({"big": (100_000, 300_000_000), "rare": (40, 400_000), "middle": (300, 900_000)}, 600, 1 << 20)
    assert rates["rare"] == 1.0 and 49 < rates["middle"] * 300 < 300 and 49 < rates["big"] * 100_000 < 600
    assert subword.sample_rates({"a": (10, 100)}, 600, 1 << 20) == {"a": 1.0}


def test_tables_without_rows(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name in ("op1_feistel_pseudonyms", "op3_pitman_yor", "op4_fmindex", "op5_sainte_lague", "op6_subword_toxicity", "op7_orc_tokens", "op8_simhash", "op9_line_windows", "op10_langid"):
        assert queries.queries()[name](spark, folder).count() == 0, name
    assert corpus_pipeline.run(spark, folder).count() == 0
    found = fmindex.find_phrases(frame(spark), spark.createDataFrame([], "item_id long, text string"), "found")
    assert found.where(F.size("found.items") > 0).count() == 0 and found.count() == len(corpus())


def test_output_names_that_are_taken(spark):
    rows = frame(spark).withColumn("pii", F.lit(1)).withColumn("_pii", F.lit(2))
    assert pseudonyms.pseudonymize(rows, key="k").columns == [*rows.columns, "__pii"]
