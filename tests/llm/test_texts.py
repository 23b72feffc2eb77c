"""Operators on single texts and on the corpus against plain versions."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import fmindex, langid, linededup, mixing, pitmanyor, pseudonyms, queries, sql, tokenfile, toxicity
from quarry.llm.shared import materialize
from quarry.llm.subword import train_rows
from quarry.llm.textspans import text_bytes

from .common import corpus, frame, words

# ---- pseudonyms


def luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def replaced(spark, *texts, key="k"):
    rows = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id long, text string, pii string")
    out = pseudonyms.pseudonymize(rows, key=key)
    assert out.columns == ["doc_id", "text", "pii", "_pii"]
    return [(r.text, r._pii) for r in out.orderBy("doc_id").collect()]


def test_pseudonyms_keep_formats(spark):
    texts = ["4417744280351547 and 4417-7442-8035-1547", "+1 (377) 555-0271, 377-555-0271", "x.34@mail7.example.com X.34@mail7.example.com", "97.51.17.173", "1990-01-02 02.01.1990 1990/01/02 01/02/1990", "GB82 WEST 1234 5698 7654 32", "078-05-1120"]
    got = replaced(spark, *texts)
    assert all(kinds for _, kinds in got)
    plain, grouped = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", got[0][0])
    assert plain == grouped.replace("-", "") and luhn(plain)
    a, b = (re.sub(r"\D", "", t)[-10:] for t in got[1][0].split(", "))
    assert a == b
    assert got[2][0].split()[0] == got[2][0].split()[1].lower() and got[2][0].endswith("@mail7.example.com")
    assert all(int(x) < 256 for x in got[3][0].split("."))
    iso, dotted, slashed, us = got[4][0].split()
    assert iso == slashed.replace("/", "-") == "-".join(dotted.split(".")[::-1]) and us == f"{iso[5:7]}/{iso[8:]}/{iso[:4]}"
    iban = got[5][0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and re.fullmatch(r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d", got[5][0])
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", got[6][0]) and got == replaced(spark, *texts) and got != replaced(spark, *texts, key="other")


NOT_VALID = ["9807915762804490", "4417744280351548", "999.1.1.1", "CC BY-NC 4.0.", "v1.2.3.4.5", "0000-01-01", "1990-02-30", "29/02/1900", "000-000-0000", "+012345678901", "DE8937040044053201300099", "°@x.example", "000-12-3456", 'token = "681c09b8e90e7e8c9575180f595f646cf2969054"', "DE89370400440532013001", "", None, "no data", "a@b", "12345"]


def test_what_is_not_valid_stays(spark):
    assert replaced(spark, *NOT_VALID) == [(t, []) for t in NOT_VALID]


def test_permutations_are_one_to_one(spark):
    ids = spark.range(100)
    text = ids.select(pseudonyms.permute_text(F.lpad(F.col("id").cast("string"), 2, "0"), "t", F.lit("k")).alias("x"))
    assert sorted(r.x for r in text.collect()) == [f"{k:02d}" for k in range(100)]
    pair = spark.range(21).select(pseudonyms.permute_pair(F.floor(F.col("id") / 3), F.col("id") % 3, 7, 3, "p", F.lit("k")).alias("x"))
    assert sorted((r.x.a, r.x.b) for r in pair.collect()) == [(a, b) for a in range(7) for b in range(3)]


def stream(key, kind, turn, other):
    return hashlib.sha512("|".join([key, kind, str(turn), other.lower()]).encode()).hexdigest()


def plain_text(value, kind, key):
    a, b = value[: len(value) // 2], value[len(value) // 2 :]

    def shift(half, hexes):
        out = ""
        for i, c in enumerate(half):
            step = int(hexes[i % 32 * 4 :][:4], 16)
            low, size = next(((a, n) for a, n in pseudonyms.ALPHABETS if a <= ord(c) < a + n), (ord(c), 1))
            out += chr((ord(c) - low + step) % size + low)
        return out

    for r in range(pseudonyms.ROUNDS):
        if r % 2 == 0:
            a = shift(a, stream(key, kind, r, b))
        else:
            b = shift(b, stream(key, kind, r, a))
    return a + b


def plain_pair(a, b, na, nb, kind, key):
    for r in range(pseudonyms.ROUNDS):
        if r % 2 == 0:
            a = (a + int(stream(key, kind, r, str(b))[:12], 16)) % na
        else:
            b = (b + int(stream(key, kind, r, str(a))[:12], 16)) % nb
    return a, b


def plain_day(day, key):
    n = (day - date(1900, 1, 1)).days
    first, na, nb = -693595 if n < 37495 - 693595 else n // 72900 * 72900, 270, 270
    if n < 37495 - 693595:
        na, nb = 5, 7499
    elif n >= 40 * 72900:
        na, nb = 32, 1327
    a, b = plain_pair((n - first) // nb, (n - first) % nb, na, nb, "date", key)
    return date(1900, 1, 1) + timedelta(days=first + a * nb + b)


def plain_phone(d, key):
    good = [k for k in range(1000) if k >= 200 and k % 100 != 11]
    sets = {True: good, False: [*range(200), *range(211, 1000, 100)]}
    area, exchange, line = int(d[:3]), int(d[3:6]), int(d[6:])
    xs, ys = sets[area in good], sets[exchange in good]
    a, b = plain_pair(xs.index(area) * 100 + line // 100, ys.index(exchange) * 100 + line % 100, len(xs) * 100, len(ys) * 100, "phone", key)
    return f"{xs[a // 100]:03d}{ys[b // 100]:03d}{a % 100 * 100 + b % 100:04d}"


def test_pseudonyms_against_a_plain_version(spark):
    rng, key = random.Random(3), "k"
    days = [date(1, 1, 1), date(9999, 12, 31), date(102, 8, 28), date(1899, 12, 31), date(1900, 1, 1), *(date(1, 1, 1) + timedelta(days=rng.randrange(3652059)) for _ in range(30))]
    want = {f"{d.year:04d}-{d:%m-%d}": (lambda p: f"{p.year:04d}-{p:%m-%d}")(plain_day(d, key)) for d in days}
    want |= {f"{d:%m/%d}/{d.year:04d}": (lambda p: f"{p:%m/%d}/{p.year:04d}")(plain_day(d, key)) for d in days}
    for local in ("ann.lee+7", "x", "иван", "山田", "Ärger.Öl", "Ωmega9"):
        want[f"{local}@a.example"] = plain_text(local, "email", key) + "@a.example"
    for _ in range(40):
        d = "".join(rng.choices("0123456789", k=10))
        p = plain_phone(d, key)
        want[f"{d[:3]}-{d[3:6]}-{d[6:]}"] = f"{p[:3]}-{p[3:6]}-{p[6:]}"
        want[f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"] = f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}"
    want["911-555-0100"] = (lambda p: f"{p[:3]}-{p[3:6]}-{p[6:]}")(plain_phone("9115550100", key))
    want["+441632960961"] = "+441" + plain_text("632960961", "phone", key)
    want["+352621123456"] = "+3526" + plain_text("21123456", "phone", key)
    for ip in ("10.0.0.1", "255.255.255.255", "1.2.3.4"):
        o = list(map(int, ip.split(".")))
        a, b = plain_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4", key)
        want[ip] = f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    for ssn in ("078-05-1120", "899-99-9999", "667-01-0001"):
        areas = [k for k in range(1, 900) if k != 666]
        a, b = plain_pair(areas.index(int(ssn[:3])) * 99 + int(ssn[4:6]) - 1, int(ssn[7:]) - 1, 898 * 99, 9999, "ssn", key)
        want[ssn] = f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    for card in ("4417744280351547", "378282246310005"):
        new = plain_text(card[:-1], "card", key)
        want[card] = new + next(c for c in "0123456789" if luhn(new + c))
    for iban in ("GB82WEST12345698765432", "NO9386011117947"):
        new = plain_text(iban[4:], "iban", key)
        want[iban] = iban[:2] + next(c for c in (f"{k:02d}" for k in range(2, 99)) if int("".join(str(int(x, 36)) for x in new + iban[:2] + c)) % 97 == 1) + new
    got = replaced(spark, *want, key=key)
    assert {w: g[0] for w, g in zip(want, got, strict=True)} == want and all(len(k) == 1 for _, k in got)


def test_slashed_dates_stay_apart(spark):
    days = [date(1930, 1, 1) + timedelta(days=k) for k in range(0, 80 * 365, 3)] + [date(y, 2, 29) for y in range(4, 2400, 4) if y % 100 or y % 400 == 0]
    forms = sorted({f"{d:%m/%d}/{d.year:04d}" for d in days} | {f"{d:%d/%m}/{d.year:04d}" for d in days})
    got = [t for t, k in replaced(spark, " ".join(forms))][0].split(" ")
    assert len(set(got)) == len(forms) and sum(a == b for a, b in zip(forms, got, strict=True)) < len(forms) / 20
    for a, b in zip(forms, got, strict=True):
        x, y, z = map(int, b.split("/"))
        date(z, y, x) if a[:2] > "12" else date(z, x, y)
        assert (a[:2] > "12") == (b[:2] > "12")


# ---- decontamination


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items, window=8):
    w, hit, found = alnum(text), set(), set()
    for name, phrase in items:
        p = alnum(phrase)
        n = min(window, len(p))
        for k in range(len(p) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == p[k : k + n]:
                    hit |= set(range(j, j + n))
                    found.add(name)
    return len(w), hit, found


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    rng = random.Random(5)
    vocabulary = ["a", "b", "cc", "é", "d1"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 8, 12])))) for k in range(8)] + [(8, None), (None, "a b"), (3, "zz yy xx")]
    texts = []
    for _ in range(40):
        t = [rng.choice([*vocabulary, "other"]) for _ in range(rng.randint(0, 40))]
        t[3:3] = (rng.choice(items)[1] or "").split()
        texts.append(", ".join(t).upper())
    texts += [None, "", texts[0], texts[0], "zz YY-xx " * 3000]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_words long")
    got = fmindex.find_phrases(docs, spark.createDataFrame(items, "item_id long, text string"), "found", block_bytes=block_bytes)
    got = got.withColumn("hit", fmindex.n_hit("found")).orderBy("doc_id").collect()
    real = [(str(i), t) for i, t in items if i is not None]
    for r, t in zip(got, texts, strict=True):
        n, hit, found = plain_hits(t, real)
        assert (r.found.n_words, r.hit, r.found["items"]) == (n, len(hit), sorted(found))
        assert {k for s in r.found.spans for k in range(s.start, s.end)} == hit


def test_suffix_order_and_search():
    rng = np.random.default_rng(6)
    for _ in range(20):
        seq = rng.integers(0, 4, 200)
        seq[-1] = 0
        index = fmindex.FMIndex(seq, 4)
        for size in (1, 2, 5, 8):
            phrases = rng.integers(1, 4, (30, size))
            which, low, high = index.search(phrases)
            found = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, low, high, strict=True)}
            for k, p in enumerate(phrases):
                assert found.get(k, []) == [j for j in range(len(seq) - size + 1) if (seq[j : j + size] == p).all()]


# ---- mixing


def test_mixing(spark):
    docs = frame(spark)
    got = mixing.mix(docs).collect()
    rows = corpus()
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, open_ = {}, sum(size.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > 3 * size[s]]
        if not above:
            break
        for s in above:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    source = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    assert sorted((r.doc_id is None, r.doc_id, r["size"]) for r in got) == sorted((r[0] is None, r[0], len(words(r[1]))) for r in rows)
    for r in got:
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6 and r.source_size == size[source[r.doc_id]] and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(2, mixing.BLOCK_WORDS * size[s] / 30000) for s in order)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    by_id = collections.Counter()
    for r in mixed.collect():
        by_id[r.doc_id] += len(words(r.text))
    want = collections.Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert +by_id == +want
    assert mixing.mix(frame(spark, [])).count() == 0


def highest_quotients(claims, caps, house):
    seats = [0] * len(claims)
    for _ in range(house):
        open_ = [k for k in range(len(claims)) if seats[k] < caps[k]]
        best = max(open_, key=lambda k: (claims[k] / (2 * seats[k] + 1), -k))
        seats[best] += 1
    return seats


def test_apportionment_is_that_of_the_highest_quotients(spark):
    rng, rows, want = random.Random(2), [], {}
    for g in range(40):
        n = rng.randint(1, 12)
        claims = [rng.choice([0.0, 0.4, 0.5, 1.0, rng.random() * 5, rng.random() * 200]) for _ in range(n)]
        caps = [max(1, int(c * rng.choice([1, 1.01, 3])) + rng.choice([0, 1])) for c in claims]
        house = min(round(sum(claims)) + rng.choice([0, 0, 0, n // 3, -(n // 3)]), sum(c for c, x in zip(caps, claims, strict=True) if x))
        house = max(0, house)
        rows += [(g, k, claims[k], caps[k], house) for k in range(n)]
        want |= {(g, k): s for k, s in enumerate(highest_quotients(claims, caps, house))} if sum(claims) else {(g, k): 0 for k in range(n)}
    got = mixing.apportion(spark.createDataFrame(rows, "g int, k int, claim double, cap long, house long"), ["g"], ["k"]).collect()
    assert {(r.g, r.k): r.seats for r in got} == want


def test_quotas_of_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    monkeypatch.setattr(mixing, "GROUP", 3)
    sizes = materialize(mixing.sized(frame(spark).select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")), "s")
    plan = materialize(mixing.targets(sizes), "p")
    got = mixing.quotas(mixing.dealt(sizes, plan), plan).orderBy("sid", "shard").collect()
    rate = {r.sid: r.target / r.source_size for r in plan.collect()}
    by_source, by_group = collections.Counter(), collections.Counter()
    for r in got:
        by_source[r.sid] += r.blocks
        by_group[r.sid, r.shard // 3] += r.blocks
    house = round(sum(n * rate[k] for k, n in by_source.items()))
    seats = dict(zip(by_source, highest_quotients([n * rate[k] for k, n in by_source.items()], [3 * n for n in by_source.values()], house), strict=True))
    assert sum(r.quota for r in got) == house and len(got) > 20
    for sid in by_source:
        groups = sorted(g for s, g in by_group if s == sid)
        in_group = dict(zip(groups, highest_quotients([by_group[sid, g] * rate[sid] for g in groups], [3 * by_group[sid, g] for g in groups], seats[sid]), strict=True))
        for g in groups:
            shards = [r for r in got if r.sid == sid and r.shard // 3 == g]
            assert [r.quota for r in shards] == highest_quotients([r.blocks * rate[sid] for r in shards], [3 * r.blocks for r in shards], in_group[g])


# ---- token files


def test_token_files(spark, tmp_path):
    tokenizer = tokenfile._load(tokenfile.vocabulary_path())
    rows = sorted((r for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = tokenfile.round_trip(frame(spark), str(tmp_path / "t")).orderBy(F.asc_nulls_first("doc_id"), "start").collect()
    at = 0
    for r, (doc_id, text, *_) in zip(got, rows, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    one = tokenfile.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 5").first()
    assert list(one["ids"]) == [*tokenizer.encode(rows[6][1], add_special_tokens=False).ids, 0] and one.doc_id == 5
    assert tokenfile.round_trip(frame(spark, []), str(tmp_path / "e")).count() == 0


def test_pieces_are_safe_to_encode_apart():
    rng = random.Random(7)
    parts = ["a", "the", "Ti", "'s", "'", "1", "42", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "é", "ß", ".", ",", "|", "-", "_", "<|endoftext|>", "😀", "́", "ñ", "\r", "!", " ", "一"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    encoder, tokenizer = tokenfile.Encoder(tokenfile.vocabulary_path(), remembered=300), tokenfile._load(tokenfile.vocabulary_path())
    for k in range(0, len(texts), 50):
        data, offsets = text_bytes(pa.array(texts[k : k + 50]))
        ids, n = encoder.encode(data, offsets)
        cut = [0, *itertools.accumulate(n.tolist())]
        for j, t in enumerate(texts[k : k + 50]):
            assert ids[cut[j] : cut[j + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# ---- line dedup


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "r\nr\nr\nr\nr\nend"), (7, "\n\n\n\n\n"), (8, "b\nc\nd\nq"), (None, "k\nl\nm"), (9, "k\nl\nm\nn"), (10, "\n".join(str(k) for k in range(5000)) + "\na\nb\nc")]
    got = linededup.dedup_lines(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, mark_id long")).orderBy(F.asc_nulls_first("doc_id")).collect()
    want = {1: "a\nb\nc\nd", 2: "x\ny", 3: "a\nb", 4: None, 5: "", 6: "r\nend", 7: "\n\n\n\n\n", 8: "q", None: "k\nl\nm", 9: "n", 10: "\n".join(str(k) for k in range(5000))}
    assert {r.doc_id: r.text for r in got} == want
    assert {r.doc_id: r.lines.n_removed for r in got if r.lines.n_removed} == {2: 3, 6: 4, 8: 3, 9: 3, 10: 3}
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_of_short_texts(spark):
    rows = [(1, "one line"), (2, "one line"), (3, "two\nlines"), (4, "two\nlines"), (5, "two"), (6, " \n"), (7, " \n"), (8, "one line\ntwo\nlines"), (None, "one line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.lines.n_removed) for r in linededup.dedup_lines(docs).collect()}
    assert got == {r[0]: (r[1], 0) for r in rows} | {1: ("", 1), 2: ("", 1), 4: ("", 2)}
    assert all(r.lines.n_removed == 0 for r in linededup.dedup_lines(docs, short=False).collect())


def test_line_windows_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    awkward = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (None, "b\nc\nd"), (None, "b\nc\nd"), (3, None), (3, None), (4, ""), (5, "x\ny"), (5, "x\ny"), (5, "q\na\nb\nc"), (6, "\n\n\n"), (6, "\n\n\n")]
    spark.createDataFrame(awkward, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, files in (("/root/testdata/sf0.001", "documents.parquet"), (str(tmp_path), "documents.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/{files}'")
        want = sorted(con.execute(sql.OP9).fetchall(), key=repr)
        assert sorted(map(tuple, queries.op9_line_windows(spark, folder).collect()), key=repr) == want


# ---- classifiers


def sample_texts():
    rng = random.Random(8)
    words_of = {"xx": ["the", "and", "that", "with", "from"], "yy": ["der", "und", "nicht", "über", "schön"], "zz": ["le", "très", "élève", "que", "nous"]}
    rows = []
    for k in range(300):
        lang = "xyz"[k % 3] * 2
        rows.append((k, " ".join(rng.choice(words_of[lang]) for _ in range(rng.randint(1, 40))), lang, "s", 0))
    return rows


def test_language_id(spark):
    rows = sample_texts()
    extra = [(1000, None, "xx", "s", 0), (1001, "", None, "s", 0), (1002, "123 !? €", "xx", "s", 0), (1003, "Ω", None, "s", 0), (None, "the and that", None, "s", 0)]
    docs = frame(spark, rows + extra)
    model = langid.fit(docs)
    got = {r.doc_id: r.found for r in langid.identify(docs, model, "found").collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and all(got[k].rejected for k in (1000, 1001, 1002)) and got[1003].lang_pred != "und" and got[None].lang_pred == "xx"
    assert all(0 <= f.score <= 1 for f in got.values()) and sum(got[r[0]].rejected for r in rows) == 0
    swapped = frame(spark, [(r[0], r[1], "zz" if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[2], "t", 1) for r in rows])
    assert np.array_equal(langid.fit(swapped).table, langid.fit(frame(spark, rows)).table)
    empty = langid.fit(frame(spark, []))
    assert langid.identify(frame(spark, rows[:1]), empty, "f").first().f.lang_pred == "und"


def test_language_id_rejects_what_was_not_learnt(spark):
    rng = random.Random(6)
    rows = sample_texts()
    other = ["że", "wszystko", "człowiek", "jest", "który", "powiedział"]
    unlearnt = [(2000 + k, " ".join(rng.choice(other) for _ in range(20)), None, "s", 0) for k in range(50)]
    gibberish = [(3000 + k, " ".join("".join(rng.choice("bcdfghjkmpqvwxz") for _ in range(6)) for _ in range(20)), None, "s", 0) for k in range(50)]
    docs = frame(spark, rows + unlearnt + gibberish)
    got = {r.doc_id: r.found.rejected for r in langid.identify(docs, langid.fit(docs), "found").collect()}
    assert all(got[r[0]] for r in unlearnt + gibberish) and not any(got[r[0]] for r in rows)


def test_toxicity(spark):
    rng = random.Random(9)
    calm = ["table", "river", "window", "green", "walking", "paper", "sound"]
    rude = ["gr" + "umpf" + e for e in ("el", "ling", "isch", "o", "en", "ig")]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        w = [rng.choice(calm) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(20, 60))]
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(rude))
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    docs, labels = frame(spark, [*rows, (700, None, None, None, None), (701, "", "en", "s", 0), (702, "grumpfetto grumpfig", "en", "s", 0), (703, "river", "en", "s", 0)]), spark.createDataFrame([*labels, (9999, 1, 1), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum((got[k] >= toxicity.THRESHOLD) == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert got[702] >= toxicity.THRESHOLD > max(got[700], got[701], got[703]) and all(0 <= v <= 1 for v in got.values())
    nothing = toxicity.fit(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_training_rows(spark):
    got = {r.doc_id: r.t for r in spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long").select("doc_id", train_rows().alias("t")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 != 2 for k in range(50)} | {None: False}


# ---- language model


def test_pitman_yor_counts(spark):
    got = {(r.doc_id, r.n_tokens): r for r in pitmanyor.score_documents(frame(spark)).collect()}
    rows = corpus()
    toks = [words(r[1]) + [None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    count = collections.Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    total, kinds = sum(count.values()), len(count)
    assert len(pitmanyor.score_documents(frame(spark)).collect()) == len(rows)
    for row, t, h in zip(rows, toks, held, strict=True):
        r = got[(row[0], len(t))]
        assert (r.held_out, r.n_known, r.train_tokens) == (h, sum(count[w] > 0 for w in t), total)
        assert abs(r.base_score - sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in t)) < 1e-6 * max(1, len(t))
        assert r.score < 0
    assert pitmanyor.score_documents(frame(spark, [])).count() == 0


def rounds(texts, ids, partitions=8, seed=11):
    """What score_documents does, in this process: its scores, and what is needed to sum up each context."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    word, count = pitmanyor.tokens(data, offsets)
    none = np.zeros(0, np.uint64)
    splits = pitmanyor.Splits(none, none, none, none)
    held = pitmanyor.is_held(ids)
    blobs = collections.defaultdict(list)
    for pid, raw in pitmanyor.dealt_blobs((0, 0), word, count, held, np.zeros(len(ids), np.uint16), splits, partitions):
        blobs[pid].append(raw)
    parts = {k: pitmanyor.Partition(b, splits) for k, b in sorted(blobs.items())}

    def roots(columns):
        asked = collections.defaultdict(list)
        for k, part in parts.items():
            for bucket, raw in pitmanyor.ask(part, columns(k, part), partitions):
                asked[bucket].append((k, raw))
        return {k: pitmanyor.Root(v) for k, v in sorted(asked.items())}

    def told(by_bucket, columns):
        replies = collections.defaultdict(list)
        for k, root in by_bucket.items():
            for pid, raw in root.replies(k, columns(k)):
                replies[pid].append(raw)
        return {k: pitmanyor.answers(part, replies[k], partitions) for k, part in parts.items()}

    first = {k: p.first_seating() for k, p in parts.items()}
    by_bucket, tally = roots(lambda k, p: [p.count, p.seats(first[k])]), pitmanyor.Tally()
    for k, p in parts.items():
        tally.add_seating(p, first[k])
        tally.add_counts(1, first[k].c2)
        tally.add_counts(2, p.c3)
    for r in by_bucket.values():
        tally.add_counts(0, r.columns[1])
    d = tally.discounts()
    model = pitmanyor.Model(d, (1.0, tally.strength(1, d[1]), tally.strength(2, d[2])), sum(int(r.columns[0].sum()) for r in by_bucket.values()), sum(int((r.columns[0] > 0).sum()) for r in by_bucket.values()))
    seats, tables = (sum(f(r.columns[1]) for r in by_bucket.values()) for f in (np.sum, np.count_nonzero))
    known = told(by_bucket, lambda k: by_bucket[k].columns)
    chains = {k: list(p.chain(pitmanyor.root_prediction(known[k][1], np.minimum(known[k][1], 1), seats, tables, model), model, np.random.default_rng([seed, k]))) for k, p in parts.items()}
    last = roots(lambda k, p: [p.seats(s) for s in chains[k]])
    drawn = {k: pitmanyor.root_tables(r, model, tables, seed, k) for k, r in last.items()}
    total = [(sum(r.columns[s].sum() for r in last.values()), sum(drawn[k][s].sum() for k in last)) for s in range(pitmanyor.SAMPLES)]
    tally = pitmanyor.Tally()
    for k, p in parts.items():
        tally.add_seating(p, chains[k][-1])
    settled = pitmanyor.Model(d, (1.0, tally.strength(1, d[1]), tally.strength(2, d[2])), model.tokens, model.vocabulary)
    predict = lambda k: [pitmanyor.root_prediction(c, t, *total[s], settled) for s, (c, t) in enumerate(zip(last[k].columns, drawn[k], strict=True))]
    sent = told(last, lambda k: [*last[k].columns, *drawn[k]])
    p0 = {k: [pitmanyor.root_prediction(v[s], v[pitmanyor.SAMPLES + s], *total[s], settled) for s in range(pitmanyor.SAMPLES)] for k, v in sent.items()}
    score = np.zeros(len(ids))
    for k, p in parts.items():
        mean = sum(p.lower(s, q, settled) for s, q in zip(chains[k], p0[k], strict=True)) / pitmanyor.SAMPLES
        score += np.bincount(p.rows[0][p.doc], weights=np.log10(mean)[p.type_of], minlength=len(ids))
    everywhere = {k: dict(zip(r.words.tolist(), zip(by_bucket[k].columns[0].tolist(), *predict(k), strict=True), strict=True)) for k, r in last.items()}
    return score, parts, chains, p0, settled, total, {w: v for m in everywhere.values() for w, v in m.items()}


def test_scores_are_those_of_a_model_whose_predictions_sum_to_one(spark):
    rows = corpus()
    score, parts, chains, p0, model, total, words_ = rounds([r[1] for r in rows], [r[0] for r in rows], int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = sorted((r.doc_id is not None, r.doc_id, round(r.score, 4)) for r in pitmanyor.score_documents(frame(spark).repartition(3)).collect())
    assert got == sorted((r[0] is not None, r[0], round(s, 4)) for r, s in zip(rows, score, strict=True))
    (d0, d2, d3), (e0, e2, e3) = model.d, model.e
    for s in range(pitmanyor.SAMPLES):
        known = {w: v[1 + s] for w, v in words_.items() if v[0] > 0}
        customers, tables = total[s]
        unknown = (e0 + d0 * tables) / (model.vocabulary + 1) / (e0 + customers)
        assert len(known) == model.vocabulary and abs(sum(known.values()) + unknown - 1) < 1e-6
        for k, part in parts.items():
            seat = chains[k][s]
            upper, lower = part.upper(seat, p0[k][s], model), part.lower(seat, p0[k][s], model)
            for r in range(part.n2):
                here = np.flatnonzero(part.r2 == r)
                back = (e2 + d2 * seat.t2[here].sum()) / (e2 + seat.c2[here].sum())
                p2 = {w: back * p for w, p in known.items()} | {w: p for w, p in zip(part.words[part.w2[here]].tolist(), upper[here].tolist(), strict=True) if w in known}
                assert abs(sum(p2.values()) + back * unknown - 1) < 1e-6
                for q in np.unique(part.r3[np.isin(part.in2, here)])[:20]:
                    at = np.flatnonzero(part.r3 == q)
                    more = (e3 + d3 * seat.t3[at].sum()) / (e3 + part.c3[at].sum())
                    seen = {w: p for w, p in zip(part.words[part.w2[part.in2[at]]].tolist(), lower[at].tolist(), strict=True) if w in known}
                    assert abs(sum(seen.values()) + more * (sum(p for w, p in p2.items() if w not in seen) + back * unknown) - 1) < 1e-6


def seated_by_customer(tokens_, p0, d, e, rounds_, rng):
    """A plain sampler: every customer in turn leaves and is seated again; mean tables in both levels."""
    low, high = collections.defaultdict(list), collections.defaultdict(list)  # customers of each table, by (context, word)

    def total(book, context):
        rows = [v for (u, _), v in book.items() if u == context]
        return sum(map(sum, rows)), sum(map(len, rows))

    def upper(one, w):
        c, t = total(high, one)
        own = high[one, w]
        return (sum(own) - d[1] * len(own) + (e[1] + d[1] * t) * p0[w]) / (e[1] + c)

    def sit(book, context, w, parent, dd, ee):
        own = book[context, w]
        weights = [n - dd for n in own] + [(ee + dd * total(book, context)[1]) * parent]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(0)
        own[k] += 1
        return own[k] == 1

    def leave(book, context, w):
        own = book[context, w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            return True
        return False

    def enter(two, one, w):
        if sit(low, (two, one), w, upper(one, w), d[2], e[2]):
            sit(high, one, w, p0[w], d[1], e[1])

    for t in tokens_:
        enter(*t)
    out = []
    for _ in range(rounds_):
        for two, one, w in tokens_:
            if leave(low, (two, one), w):
                leave(high, one, w)
            enter(two, one, w)
        out.append((sum(map(len, low.values())), sum(map(len, high.values()))))
    return np.mean(out[rounds_ // 5 :], axis=0)


def test_seating_agrees_with_a_plain_sampler():
    rng = random.Random(5)
    text = [" ".join(rng.choices("abc", [5, 2, 1], k=12)) for _ in range(14)]
    data, offsets = text_bytes(pa.array(text))
    word, count = pitmanyor.tokens(data, offsets)
    none = np.zeros(0, np.uint64)
    splits = pitmanyor.Splits(none, none, none, none)
    part = pitmanyor.Partition([raw for _, raw in pitmanyor.dealt_blobs((0, 0), word, count, np.zeros(14, bool), np.zeros(14, np.uint16), splits, 1)], splits)
    model = pitmanyor.Model((0.4, 0.3, 0.5), (1.0, 1.5, 0.8), 0, 4)
    p0 = np.full(len(part.words), 0.2)
    one, two = pitmanyor.before(word, count)
    want = seated_by_customer(list(zip(two.tolist(), one.tolist(), word.tolist(), strict=True)), dict.fromkeys(word.tolist(), 0.2), model.d, model.e, 1200, rng)
    got = [(s.t3.sum(), s.t2.sum()) for k in range(120) for s in part.chain(p0, model, np.random.default_rng(k))]
    assert np.abs(np.mean(got, axis=0) / want - 1).max() < 0.05


def dealt(texts, splits, held=None, flushes=1):
    """The token blobs of some texts, all of them in one partition."""
    salt = np.array([zlib.crc32(t.encode()) % 65536 for t in texts], np.uint16)
    held = np.zeros(len(texts), bool) if held is None else held
    blobs, salts = [], []
    for k, at in enumerate(np.array_split(np.arange(len(texts)), flushes)):
        data, offsets = text_bytes(pa.array([texts[i] for i in at]))
        word, count = pitmanyor.tokens(data, offsets)
        blobs += [raw for _, raw in pitmanyor.dealt_blobs((0, k), word, count, held[at], salt[at], splits, 1)]
        salts.append((word, *pitmanyor.before(word, count), np.repeat(salt[at], count), np.repeat(held[at], count)))
    return blobs, [np.concatenate(x) for x in zip(*salts, strict=True)]


def hot_splits(one, two):
    words_, n = np.unique(one, return_counts=True)
    pairs, m = np.unique(pitmanyor.mixed(two, one), return_counts=True)
    top, often = np.sort(words_[n > n.max() // 2]), np.sort(pairs[m > m.max() // 2])
    return pitmanyor.Splits(top, np.full(len(top), 3), often, np.full(len(often), 2))


@pytest.mark.parametrize("bits", [64, 30])
def test_partitions_count_each_word_of_each_context(monkeypatch, bits):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefgh", range(1, 9), k=rng.randint(0, 60))) for _ in range(300)]
    held = np.arange(300) % 5 == 1
    none = np.zeros(0, np.uint64)
    splits = hot_splits(*dealt(texts, pitmanyor.Splits(none, none, none, none))[1][1:3])
    monkeypatch.setattr(pitmanyor, "KEY_BITS", bits, raising=False)
    blobs, (word, one, two, salt, out) = dealt(texts, splits, held, 3)
    near = splits.near(one, two, salt)
    assert len(np.unique(near)) > len(np.unique(one))
    part, short = pitmanyor.Partition(blobs, splits), pitmanyor.Partition(blobs, splits, tokens=False)
    of_word = part.words[part.w2[part.in2]]
    assert (of_word[part.type_of] == word).all() and (part.count == [((word == w) & ~out).sum() for w in part.words]).all()
    for numbers, keys in ((part.type_of, (near, two, word)), (part.r3[part.type_of], (near, two)), (part.in2[part.type_of], (near, word)), (part.r2[part.in2][part.type_of], (near,))):
        pairs = set(zip(numbers.tolist(), zip(*(k.tolist() for k in keys), strict=True), strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == numbers.max() + 1
    assert (part.c3 == np.bincount(part.type_of, weights=~out)).all() and (np.diff(part.in2) >= 0).all() and (np.diff(part.r2) >= 0).all()
    for name in ("words", "c3", "in2", "r3", "w2", "r2", "count", "n3", "n2"):
        assert np.array_equal(getattr(part, name), getattr(short, name)), name
    model, p0 = pitmanyor.Model((0.4, 0.3, 0.5), (1.0, 1.5, 0.8), 0, 8), np.full(len(part.words), 0.1)
    for s in short.chain(p0, model, np.random.default_rng(3)):
        assert (s.c2 == np.bincount(part.in2, weights=s.t3)).all()
        for t, c in ((s.t3, part.c3), (s.t2, s.c2)):
            assert (t[c < 2] == c[c < 2]).all() and (t >= np.minimum(c, 1)).all() and (t <= c).all() and (t[c > 1] > 1).any()


def test_seating_costs_a_few_sorts_of_the_tokens():
    """CPU seconds to number a partition's words and to draw all of its samples, against a stable sort of its tokens."""
    rng = np.random.default_rng(2)
    word = (rng.zipf(1.4, 1_000_000) % 50_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) & np.uint64((1 << pitmanyor.WORD_BITS) - 1)
    none, count = np.zeros(0, np.uint64), np.full(2000, 500)
    splits = pitmanyor.Splits(none, none, none, none)
    blobs = [raw for _, raw in pitmanyor.dealt_blobs((0, 0), word, count, np.zeros(2000, bool), np.zeros(2000, np.uint16), splits, 1)]
    model = pitmanyor.Model((0.5, 0.7, 0.8), (1.0, 2.0, 2.0), len(word), 50_000)

    def seconds(work):
        out = []
        for _ in range(3):
            began = time.process_time()
            work()
            out.append(time.process_time() - began)
        return min(out)

    def sampled():
        part = pitmanyor.Partition(blobs, splits)
        list(part.chain(np.full(len(part.words), 1e-4), model, np.random.default_rng(1)))

    assert seconds(sampled) < 7 * seconds(lambda: np.argsort(word, kind="stable"))


def test_waiting_workers_keep_no_freed_memory():
    kept = []

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    def work(n):
        blocks = [np.ones(8000) for _ in range(n)]
        kept.extend(blocks[::-100])  # so that the heap's end is in use
        yield len(blocks)

    before = resident()
    assert list(pitmanyor.lean(work)(4000)) == [4000]
    assert resident() - before < 64


def test_splits_are_counted_over_all_rows(spark, monkeypatch):
    texts = ["hot " * 5000] + [f"a{k} b{k}" for k in range(6000)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, scatter = [], pitmanyor._scatter
    monkeypatch.setattr(pitmanyor, "_scatter", lambda docs, splits, partitions: seen.append(splits) or scatter(docs, splits, partitions))
    assert pitmanyor.score_documents(docs).count() == len(texts)
    counts = collections.Counter()
    for text in texts:
        data, offsets = text_bytes(pa.array([text], pa.string()))
        one, two = pitmanyor.before(*pitmanyor.tokens(data, offsets))
        counts.update(zip(itertools.repeat(0), one.tolist()))
        counts.update(zip(itertools.repeat(1), pitmanyor.mixed(two, one).tolist()))
    want = {k: -(-n // pitmanyor.LEAST_SPLIT) for k, n in counts.items() if n > pitmanyor.LEAST_SPLIT}
    got = [dict(zip(itertools.product([kind], keys.tolist()), parts.tolist(), strict=True)) for kind, keys, parts in ((0, seen[0].words, seen[0].word_parts), (1, seen[0].pairs, seen[0].pair_parts))]
    assert got[0] | got[1] == want and sorted(want.values()) == [3, 3, 4, 4]


def test_split_words_keep_whole_contexts():
    rng = np.random.default_rng(3)
    words_ = np.sort(rng.integers(1, 2**63, 2, dtype=np.uint64))
    splits = pitmanyor.Splits(words_, np.array([3, 4]), np.sort(pitmanyor.mixed(words_[:1], words_[1:])), np.array([5]))
    two, one, salt = rng.choice(words_, 2000), rng.choice(np.r_[words_, np.uint64(9)], 2000), rng.integers(0, 65536, 2000).astype(np.uint16)
    near = splits.near(one, two, salt)
    of = collections.defaultdict(set)
    for a, b, n in zip(two.tolist(), one.tolist(), near.tolist(), strict=True):
        of[a, b].add(n)
    assert {k: len(v) for k, v in of.items()} == {(int(a), int(b)): 5 if (a, b) == (words_[0], words_[1]) else 1 for a in words_ for b in np.r_[words_, np.uint64(9)]}


def test_table_draws_follow_the_conditional():
    rng = np.random.default_rng(4)
    d, e, p, others = 0.4, 0.9, 0.5, 2
    draws = pitmanyor.draw_tables(np.full(20000, 3), np.full(20000, others), pitmanyor.Fixed(np.full(20000, p)), d, e, rng)
    new = [(e + d * (others + k)) * p for k in range(3)]
    weights = np.array([(1 - d) * (2 - d) * new[0], 3 * (1 - d) * new[0] * new[1], new[0] * new[1] * new[2]])
    assert np.abs(np.bincount(draws, minlength=4)[1:] / 20000 - weights / weights.sum()).max() < 0.02
    many = pitmanyor.draw_tables(np.full(500, 5000), np.zeros(500), pitmanyor.Fixed(np.ones(500)), 1e-9, 2.0, rng)
    assert abs(many.mean() - sum(2.0 / (2.0 + k) for k in range(5000))) < 1.5
    assert (pitmanyor.draw_tables(np.array([0, 1]), np.zeros(2), pitmanyor.Fixed(np.ones(2)), 0.5, 1.0, rng) == [0, 1]).all()
