"""Each operator against brute force, and on awkward and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from papyra.llm import audio, language, neardup, quality, toxicity, urls
from papyra.llm.decontaminate import decontaminate, leak_report
from papyra.llm.language import identify_languages
from papyra.llm.lines import drop_lines, line_bitmaps
from papyra.llm.mixing import mix
from papyra.llm.neardup import duplicate_classes, keep_one
from papyra.llm.quality import Discriminant, keep_quality, quality_scores
from papyra.llm.toxicity import grade_toxicity
from papyra.llm.urls import judge_urls
from tests.llm.helpers import COLUMNS, LOWER, TOKEN, awkward, empty, row, words

SF = "/root/testdata/sf0.001"


def sample_rows(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ka lo mi nu pe ri so tu".split() for b in "ban den fin gol hus".split()]
    return [row(100 + i, "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4))), "en", f"s{i % 4}") for i in range(n)]


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def held(i, modulus, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == remainder


# 2


def test_url_rules(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"), "HTTP://EXAMPLE.NET/en/1?q#f": ("example.net", "/en/1", "example.net/en/", "allow"),
        "http://www.example.com/de/": ("www.example.com", "/de/", "example.com/de/", "block"), "http://b.org/fr/9": ("b.org", "/fr/9", "org/fr/", "allow"),
        "http://a.net": ("a.net", "", None, None), "http://annet/x": ("annet", "/x", None, None), "no scheme/x": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
        "x://net/?a=1&b=2": ("net", "/", "net/", "block"), "a://b.org#/fr/": ("b.org", "", None, None), "http://É.net/È://q": ("É.net", "/È://q", "net/", "block"),
        "http://" + "long-" * 5000 + ".net/p": ("long-" * 5000 + ".net", "/p", "net/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(cases)], "page_id INT, url STRING, host STRING, y INT")
    got = {r["page_id"]: r for r in judge_urls(pages).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    assert judge_urls(pages.where("page_id < 0")).collect() == []
    assert {r["verdict"] for r in judge_urls(pages.where("rule IS NULL") if "rule" in pages.columns else pages.where("url IS NULL")).collect()} == {"allow"}


def test_url_trees_match_their_expression(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    u = urls.split_urls(pages)
    feats = urls.lexical(u).withColumn("suffix1", F.lit(0.0)).withColumn("suffix2", F.lit(1.0)).cache()
    rows = [[float(r[c]) for c in urls.FEATURES] for r in feats.select(*urls.FEATURES).collect()]
    model = urls.boost(rows, [int(r[2] > sorted(x[2] for x in rows)[len(rows) // 2]) for r in rows])
    got = [r[0] for r in feats.select(model.column()).collect()]
    assert np.allclose(got, [model.of(r) for r in rows]) and len(model.trees) == 20
    texts = [r["_url"] for r in u.collect()]
    entropy = [-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) for t in texts]
    assert np.allclose([r[3] for r in rows], entropy)


def test_url_verdicts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bins = {r["page_id"]: (r["bin1"], r["bin2"]) for r in urls.lexical(urls.split_urls(pages)).collect()}
    got = {r["page_id"]: r for r in judge_urls(pages).collect()}
    rules = sorted(urls.RULES, key=lambda r: -len(r[0]))
    rows, by_rule = {}, {}
    for r in pages.select("page_id", "url").collect():
        u, own = r["url"] or "", got[r["page_id"]]
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group().translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fits = [(n, v) for n, v in rules if ("." + host).endswith("." + n.split("/")[0]) and path.startswith(n[n.index("/") :])]
        assert (own["host"], own["path"], own["rule"]) == (host, path, fits[0][0] if fits else None)
        query = u.rsplit("?", 1)[1] if "?" in u else ""
        entropy = -sum(n / len(u) * math.log2(n / len(u)) for n in Counter(u).values())
        rows[r["page_id"]] = [len(u), path.count("/"), sum(c in "0123456789" for c in u) / max(len(u), 1), entropy, query.count("="), host.count("."), host.count("-"), len(path)]
        if fits:
            by_rule[r["page_id"]] = int(fits[0][1] == "block")
    sums = [defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])]
    for i, y in by_rule.items():
        for k in (0, 1):
            sums[k][bins[i][k]][0] += y
            sums[k][bins[i][k]][1] += 1
    first = {r["page_id"]: r["url"] or "" for r in pages.collect()}
    learn = sorted(by_rule, key=lambda i: (first[i], str(i)))
    odds = lambda y, n: math.log((y + 1) / (n - y + 1))
    own = lambda i, k: odds(sums[k][bins[i][k]][0] - by_rule[i], sums[k][bins[i][k]][1] - 1)
    model = urls.boost([rows[i] + [own(i, 0), own(i, 1)] for i in learn], [by_rule[i] for i in learn])
    assert 0 < sum(by_rule.values()) < len(by_rule)
    for i, r in got.items():
        p = 1 / (1 + math.exp(-model.of(rows[i] + [odds(*sums[k][bins[i][k]]) if bins[i][k] in sums[k] else 0.0 for k in (0, 1)])))
        assert math.isclose(r["score"], p, abs_tol=1e-6)
        assert r["verdict"] == ("block" if by_rule[i] else "allow") if i in by_rule else abs(p - 0.5) < 1e-6 or r["verdict"] == ("block" if p > 0.5 else "allow")
    # Trees fitted on half of the labelled urls, on the other half.
    half = [i for k, i in enumerate(learn) if k % 2]
    trees = urls.boost([rows[i] for i in half], [by_rule[i] for i in half])
    rest = [i for k, i in enumerate(learn) if not k % 2]
    right = sum((trees.of(rows[i]) > 0) == by_rule[i] for i in rest)
    most = max(sum(by_rule[i] for i in rest), sum(1 - by_rule[i] for i in rest))
    assert right >= most - 0.05 * len(rest)


def test_url_ties_and_repeats(spark):
    rows = [(1, "http://a.net/x")] * 3 + [(2, None)] * 2 + [(None, "http://a.net/x"), (3, "no url"), (4, "http://EXAMPLE.net/en/"), (4, "http://b.org/fr/" + "y" * 50_000)]
    got = judge_urls(spark.createDataFrame(rows, "page_id INT, url STRING")).collect()
    assert len(got) == len(rows) and Counter(str((r["page_id"], r["rule"], r["verdict"], r["score"])) for r in got).most_common(1)[0][1] == 3
    assert {r["rule"] for r in got if r["page_id"] == 4} == {"example.net/en/", "org/fr/"}
    few = judge_urls(spark.createDataFrame(rows, "page_id INT, url STRING"), sample=2)
    assert few.count() == len(rows)


# 3


def test_audio_alignment(spark):
    rng = np.random.default_rng(0)
    songs = [rng.normal(0, 0.15, 64) for _ in range(12)]
    pcm = [audio.render(s) for s in songs]
    noisy = (np.frombuffer(pcm[0], "<i2") + rng.normal(0, 1500, 64 * audio.NOTE)).clip(-32768, 32767).astype("<i2").tobytes()
    shifted = audio.render(np.concatenate([songs[1][:12] * 0, songs[0]]))
    media = [*enumerate(pcm), (20, noisy), (21, shifted), (22, None), (23, b""), (24, b"x" * 99), (None, pcm[0]), (40, pcm[3]), (41, bytes(200_000)), (60, bytes(190_001)), (40, pcm[3])]
    df = spark.createDataFrame([(i, p, 1) for i, p in media], "id BIGINT, audio BINARY, key INT")
    found = {(r["query_id"], r["match_id"]): r for r in audio.match_recordings(df).collect()}
    assert {(0, 20), (20, 0), (0, 21), (40, 3), (20, 21)} <= set(found) and found[0, 20]["offset"] == 0 and found[0, 21]["offset"] == 13  # 12 notes
    assert found[40, 3]["bit_error"] == 0 and not any(a in (0, 20) and b in range(1, 12) for a, b in found)
    assert not any(41 in pair or 60 in pair for pair in found)  # silence matches nothing
    prints = {i: audio.fingerprint(p) for i, p in media if i is not None}
    for q in (0, 20, 40, 60):  # brute force over all pairs
        for i in prints:
            if i != q and len(prints[q]) and len(prints[i]):
                _, n, e = audio.align(prints[q], prints[i])
                assert ((q, i) in found) == (n >= audio.MIN_FRAMES and e <= audio.MAX_ERROR)
    lists = audio.grouped_matches(audio.match_recordings(df)).collect()
    assert sorted((r["query_id"], m["match_id"]) for r in lists for m in r["matches"]) == sorted(found)


def noised(rng, fp, share):
    return fp ^ (rng.random((len(fp), 32)) < share) @ (np.uint32(1) << np.arange(32, dtype=np.uint32))


def every_offset(a, b):
    """Errors and key agreements of all offsets that overlap enough, brute force."""
    for off in range(audio.MIN_FRAMES - len(a), len(b) - audio.MIN_FRAMES + 1):
        x, y = a[max(0, -off) :], b[max(0, off) :]
        n = min(len(x), len(y))
        yield off, np.bitwise_count(x[:n] ^ y[:n]).mean() / 32, int((x[:n] >> 8 == y[:n] >> 8).sum())


def test_audio_compares_all_offsets(spark):
    rng = np.random.default_rng(2)
    song = rng.integers(0, 1 << 32, 30, dtype=np.uint32)
    still = np.zeros(40, np.uint32)  # 21 offsets tie at 20 silent frames
    ends = rng.integers(0, 1 << 32, (2, 30), dtype=np.uint32)
    a, b = np.concatenate([song, still[:20], ends[0]]), np.concatenate([ends[1], still, noised(rng, song, 0.04)])
    off, n, error = audio.align(a, b)
    assert off == 70 and n == 30 and error < 0.08

    prints = {}
    for k in range(60):  # queries 0, 20, 40...; each with a copy of 4 to 15 % wrong bits, whole or of few frames
        song = rng.integers(0, 1 << 32, 46, dtype=np.uint32)
        song = np.concatenate([song, still[:10]]) if k % 3 == 0 else song
        prints[20 * k] = song
        prints[20 * k + 1] = noised(rng, song[: 9 if k % 5 == 0 else 46], 0.02 + 0.13 * k / 60)
    df = spark.createDataFrame([(i, v.view(np.int32).tolist()) for i, v in prints.items()], "id BIGINT, fp ARRAY<INT>")
    found = {(r["query_id"], r["match_id"]) for r in audio.match_prints(df).collect()}
    want, true = set(), set()
    for q in range(0, 1200, 20):
        for i in prints:
            ok = [votes for _, error, votes in every_offset(prints[q], prints[i]) if error <= audio.MAX_ERROR] if i != q else []
            true |= {(q, i)} if ok else set()
            want |= {(q, i)} if any(ok) else set()
    assert found == want  # all that any key leads to
    assert len(found) > 0.8 * len(true)  # of all there are, however few frames and many errors


def test_audio_query_finds_what_brute_force_finds(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 120")
    media = audio.clips(vectors)
    prints = {r["id"]: audio.fingerprint(r["audio"]) for r in media.collect()}
    want = {(q, i) for q in prints for i in prints if q % 20 == 0 and i != q and any(e <= audio.MAX_ERROR for _, e, _ in every_offset(prints[q], prints[i]))}
    found = {(r["query_id"], r["match_id"]) for r in audio.match_recordings(media).collect()}
    assert {(20 * k, 20 * k + 1) for k in range(12)} <= want and found <= want and len(found) >= 0.9 * len(want)


def test_audio_of_one_id_that_differs(spark):
    rng = np.random.default_rng(6)
    a, b = (audio.render(rng.normal(0, 0.15, 64)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (20, b), (40, a)], "id BIGINT, audio BINARY")
    assert {(r["query_id"], r["match_id"]) for r in audio.match_recordings(df).collect()} == {(20, 1), (40, 1)}


# 4


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    far = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in far) >= 0.9 * len(far)
    again = identify_languages(docs.where("NOT (crc32(cast(cast(doc_id as string) as binary)) % 3 = 1)").unionByName(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").withColumn("lang", F.lit("zz"))))
    assert sorted((r["doc_id"], r["lang_pred"]) for r in again.collect()) == sorted((r["doc_id"], r["lang_pred"]) for r in got)


def test_language_model_by_brute_force(spark):
    """Grams, weights and cosines in plain Python, with the fitted centroids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL")
    model = language.fit_language(docs.where("NOT (crc32(cast(cast(doc_id as string) as binary)) % 3 = 1)").select(F.col("doc_id").alias("id"), "lang", "text"))
    got = {r["doc_id"]: r for r in identify_languages(docs).collect()}

    def grams(text):
        b = b" " + b" ".join(bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in text.lower().encode()).split()) + b" "
        two = ((b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA6B & 0xFFFFFFFF) >> 21 for i in range(len(b) - 1))
        three = ((b[i] * 0xC2B2AE35 + b[i + 1] * 0x27D4EB2F + b[i + 2] * 0x165667B1 & 0xFFFFFFFF) >> 21 for i in range(len(b) - 2))
        return Counter([*two, *three])

    learn = [grams(r["text"]) for r in docs.where("lang IS NOT NULL").collect() if not held(r["doc_id"], 3, 1)]
    df = Counter(k for g in learn for k in g)
    idf = [math.log((1 + len(learn)) / (1 + df[i])) + 0.1 for i in range(language.DIMS)]
    assert np.allclose(idf, model.idf, atol=1e-5)
    for r in docs.orderBy("doc_id").limit(60).collect():
        v = {k: math.log1p(n) * idf[k] for k, n in grams(r["text"]).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[k]) for k, x in v.items()) / size for c in model.rows]
        best = {name: max(x for x, n in zip(cos, model.langs) if n == name) for name in set(model.langs)}
        top = max(best, key=best.get)
        score = 1 / sum(math.exp((x - best[top]) / model.temperature) for x in best.values())
        assert got[r["doc_id"]]["lang_pred"] == top and math.isclose(got[r["doc_id"]]["score"], score, abs_tol=1e-3)


def test_language_counts_of_long_texts(monkeypatch):
    text = "ein ziemlich langer Satz, und noch einer " * 40
    whole = language.counts([text, "kurz"])
    monkeypatch.setattr(language, "_PIECE", 100)
    assert (language.counts([text, "kurz"]) == whole).all() and whole.max() > 100
    many = language.counts(["aa " * 30_000_0])
    assert many.max() == 300_000  # more than 16 bits hold


def test_languages_awkward(spark):
    got = identify_languages(awkward(spark)).collect()
    assert len(got) == 15 and {r["lang_pred"] for r in got} <= {"und", "en", "de"}
    by = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is not None}
    assert all(by[i] == "und" for i in (1, 2, 3, 7, 9)) and by[4] != "und"
    assert identify_languages(empty(spark)).collect() == []
    alone = identify_languages(spark.createDataFrame([row(1, "text", None)], COLUMNS)).collect()
    assert [(r["lang_pred"], r["score"]) for r in alone] == [("und", 0.0)]


# 5


def test_toxicity(spark):
    base = [row(i, f"a plain text about thing{i % 7} and place{i % 5} " * (1 + i % 3)) for i in range(200)]
    toxic = [row(1000 + i, f"a text about thing{i % 7} you {'foulword ' * (1 + i % 4)} nastyone") for i in range(80)]
    docs = awkward(spark, base + toxic)
    labels = spark.createDataFrame([(r[0], 0) for r in base] + [(r[0], 1) for r in toxic[:60]] + [(None, 1), (3, None)], "doc_id BIGINT, toxic INT")
    got = {r["doc_id"]: r for r in grade_toxicity(docs, labels, learn=F.lit(True)).collect() if r["doc_id"] is not None}
    assert all(got[r[0]]["toxic"] for r in toxic) and not any(got[r[0]]["toxic"] for r in base) and not got[1]["toxic"] and not got[6]["toxic"]
    assert got[1000]["severity"] < got[1001]["severity"] < got[1003]["severity"] <= 3 and all(0 <= r["grade"] <= 3 for r in got.values())
    assert grade_toxicity(empty(spark), labels).collect() == []
    assert not any(r["toxic"] for r in grade_toxicity(docs, labels.where("toxic = 0")).collect())


def test_toxicity_by_brute_force(spark):
    """Severity from the fitted weights in plain Python; and accuracy on labels that weren't learnt from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in grade_toxicity(docs, labels).collect()}
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    assert list(model.cuts) == sorted(model.cuts) and len(weight) > 0
    for r in docs.where("doc_id % 50 = 0").collect():
        n = Counter()
        for w in (r["text"] or "").translate(LOWER).encode().translate(bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))).split():
            n[xxhash.xxh3_64_intdigest(w) % (1 << 20)] += 1
            if len(w) > 5:
                n[xxhash.xxh3_64_intdigest(b"^" + w[:5]) % (1 << 20)] += 1
        x = sum(weight.get(k, 0.0) * math.log1p(c) for k, c in n.items())
        above = [1 / (1 + math.exp(-max(-60, min(60, x - t)))) for t in model.cuts]
        assert math.isclose(got[r["doc_id"]]["severity"], sum(above), abs_tol=1e-6) and math.isclose(got[r["doc_id"]]["p_toxic"], above[0], abs_tol=1e-6)
    far = [(got[r["doc_id"]]["toxic"], r["toxic"] == 1) for r in labels.where("toxic IS NOT NULL").collect() if held(r["doc_id"], 4, 2) and r["doc_id"] in got]
    assert all(r["held_out"] == held(i, 4, 2) for i, r in got.items())
    assert sum(a == b for a, b in far) >= 0.97 * len(far) and sum(a and b for a, b in far) >= 0.8 * sum(b for _, b in far) > 0


# 6


def brute_mix(rows):
    size = [len(TOKEN.findall(t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free = {}, set(names)
    left = sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= 3 * total[s]
        free -= over
    return size, total, target


def test_mixing(spark):
    docs = awkward(spark, sample_rows())
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    size, total, target = brute_mix(rows)
    got = mix(docs).collect()
    assert sorted(str((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6))) for r in got) == sorted(str((i, n, total[s], round(float(target[s]), 6))) for (i, _, s), n in zip(rows, size))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = defaultdict(int)
    for r in got:
        by[r["source_size"], round(r["target"], 6)] += r["taken"]
    want = defaultdict(int)
    for s in total:
        want[total[s], round(float(target[s]), 6)] += math.floor(target[s] + 0.5)
    assert by == want
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, got)) and mix(empty(spark)).collect() == []


# 7


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows) and all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_calibration_converges():
    """Whatever the densities, the curve is the best one: nearly separable, few of one class, far out."""
    rng = np.random.default_rng(3)
    y = (rng.random(20_000) < 0.865).astype(int)
    for d in (np.where(y == 1, 55.0, -60.0) + rng.normal(0, 3, len(y)), np.where(y == 1, 20.0, -50.0) * rng.random(len(y)), rng.normal(0, 1e-3, len(y)), np.where(y == 1, 60.0, 60.0 - 100 * rng.random(len(y)))):
        m = Discriminant(*[np.zeros(1)] * 5)
        m._calibrate(np.clip(d, -60, 60), y)
        loss = lambda a, b: np.logaddexp(0, -(2 * y - 1) * (a * np.clip(d, -60, 60) + b)).sum() + 5e-4 * (a * a + b * b)  # noqa: E731, B023
        assert all(loss(m.slope, m.shift) <= loss(max(1e-3, m.slope * f), m.shift + g) + 0.5 for f in (0.5, 1, 2) for g in (-1, 0, 1))


def test_quality_by_brute_force(spark):
    """The query's scores from a model fitted and applied outside Spark."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    text, y = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    learn = sorted((i, y[i], quality.statistics(text[i].encode())) for i in y if i in text and not held(i, 4, 2))
    x, t = np.array([v for *_, v in learn]), np.array([v for _, v, _ in learn])
    m = Discriminant.fit(x, t)
    for r in quality_scores(docs, labels).collect():
        z = np.clip((np.array(quality.statistics(text[r["doc_id"]].encode())) - m.center) / m.scale, -8, 8)
        dens = [-0.5 * ((z - u) @ np.linalg.inv(s)) @ (z - u) - 0.5 * np.linalg.slogdet(s)[1] for u, s in zip(m.means, (np.linalg.inv(f.T @ f) for f in m.factors))]
        d = min(60, max(-60, dens[1] - dens[0]))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-(m.slope * d + m.shift))), abs_tol=1e-4)


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (20, None), (None, 1)], "doc_id BIGINT, quality INT")
    docs = awkward(spark)
    got = quality_scores(docs, labels).collect()
    assert len(got) == 15 and all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"], 4, 2) for r in got)
    assert quality_scores(empty(spark), labels).collect() == [] and keep_quality(docs, labels, threshold=0.0).columns == docs.columns
    assert keep_quality(docs, labels, threshold=1.1).count() == 15  # nothing learnt
    more = spark.createDataFrame([(1, 1), (4, 1), (3, 0), (8, 0), (9, 1), (7, 0)], "doc_id BIGINT, quality INT")
    assert keep_quality(docs, more, threshold=0.0).count() == 15 and keep_quality(docs, more, threshold=1.1).count() == 0


def test_discriminant_matches_the_formula():
    rng = np.random.default_rng(1)
    x, y = np.concatenate([rng.normal(0, 1, (80, 3)), rng.normal(1.5, 2, (60, 3))]), np.array([0] * 80 + [1] * 60)
    m = Discriminant.fit(x, y)
    z = (x - m.center) / m.scale
    covs = [np.linalg.inv(f.T @ f) for f in m.factors]
    dens = [-0.5 * np.einsum("ni,ij,nj->n", z - u, np.linalg.inv(s), z - u) - 0.5 * np.linalg.slogdet(s)[1] for u, s in zip(m.means, covs)]
    assert np.allclose(m.difference(x), np.clip(dens[1] - dens[0], -60, 60)) and m.score(x)[y == 1].mean() > 0.7


# 8


def brute_leaks(rows, items):
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in rows:
        w, hit, who = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                own = grams.get(tuple(w[k : k + n]))
                if own is not None:
                    hit |= set(range(k, k + n))
                    who |= {str(x) for x in own if x is not None}
        out.append((str(d), len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("most", [50_000, 0])
def test_decontamination(spark, most):
    docs = sample_rows(40)
    text = docs[3][1]
    items = [(1, " ".join(words(text)[:14])), (2, "Kaban"), (3, "so so"), (11, None), (12, "?!"), (None, " ".join(words(docs[5][1]))), (4, "lobAN-denis nothing like it"), (1, docs[7][1]), (5, "word0 Ünïcode word1 Ünïcode word2")]
    df = awkward(spark, docs)
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id BIGINT, text STRING, h INT")
    got = leak_report(df, bench, broadcast_windows=most)
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
    want = brute_leaks(plain(df), items)
    assert sorted(map(key, got.collect())) == want
    if most:
        clean = decontaminate(df, bench)
        assert clean.columns == df.columns and clean.count() == sum(not r[-1] for r in want)
        cut = {r["doc_id"]: r["text"] for r in decontaminate(df, bench, remove="spans").collect() if r["doc_id"] is not None}
        hits = {d for d, *_, bad in want if bad}
        for d, t in plain(df):
            if d is not None and str(d) not in hits:
                assert cut[d] == t
        assert words(cut[103]) != words(text) and len(cut) == len({d for d, _ in plain(df) if d is not None})
        assert leak_report(empty(spark), bench).collect() == [] and not any(r["contaminated"] for r in leak_report(df, bench.where("false")).collect())


# 9


def brute_lines(rows, least=20, docs=3):
    clean = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(clean(x)) >= least:
                holders[clean(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(holders.get(clean(x), ())) < docs or d == max(holders[clean(x)])]
        out.append((str(d), len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark):
    shared = ["A shared line of enough length", "  a SHARED line of enough length\t", "Ünïcode lines with twenty chars é", "short one", "exactly twenty chars", "hot line that everybody has here"]
    rng = random.Random(5)
    rows = [row(200 + i, "\n".join([rng.choice(shared) for _ in range(3)] + [f"own line {i}", shared[5]])) for i in range(40)]
    rows += [row(201, rows[1][1]), row(202, shared[0] + "\n" + shared[2]), row(None, shared[5])]
    df = awkward(spark, rows)
    got = line_bitmaps(df)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()) == brute_lines(plain(df))
    for r in got.collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bytes(r["keep_bitmap"])), np.uint8))[: r["n_lines"]]
        assert r["n_lines"] - bits.sum() == r["n_dropped"]
    kept = drop_lines(df)
    assert kept.columns == df.columns and sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect()) == sorted((a, d) for a, _, _, d in brute_lines(plain(df)))
    assert line_bitmaps(empty(spark)).collect() == []


# 10


def plain_similarity(a, b, weight):
    """Weighted Jaccard of two bags of shingles."""
    both = sum(min(a[x], b[x]) * weight[x] for x in a if x in b)
    return both / (sum(n * weight[x] for x, n in a.items()) + sum(n * weight[x] for x, n in b.items()) - both)


def brute_classes(rows):
    """Components of all pairs at 0.8 or more, from the words alone."""
    sets = []
    for _, t in rows:
        w = words(t)
        k = min(5, len(w))
        sets.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter())
    df = Counter(x for s in sets for x in s)
    weight = {x: math.log1p(len(rows) / n) + 0.1 for x, n in df.items()}
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and plain_similarity(sets[i], sets[j], weight) >= 0.8:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    return rows, sets, members


@pytest.mark.parametrize("group", [512, 3])
def test_near_duplicates(spark, monkeypatch, group):
    monkeypatch.setattr(neardup, "GROUP", group)
    rng = random.Random(9)
    rows = sample_rows(30)
    for k in range(25):  # a family of near copies, some too far from others
        w = rows[2][1].split() * 3
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 99)}"
        rows.append(row(500 + k, " ".join(w)))
    rows += [row(600, rows[4][1]), row(601, rows[4][1].upper()), row(None, rows[4][1])]
    df = awkward(spark, rows)
    docs, sets, members = brute_classes(plain(df))
    want = []
    for m in members.values():
        ids = [docs[i][0] for i in m if docs[i][0] is not None]
        want += [(str(docs[i][0]), str(min(ids) if ids else None), len(m)) for i in m]
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in duplicate_classes(df).collect()) == sorted(want)
    if group == 512:
        kept = keep_one(df)
        assert kept.columns == df.columns and kept.count() == len(members) - 0
        assert duplicate_classes(empty(spark)).collect() == []


def test_document_frequencies_are_exact(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 40_000))) for _ in range(30)]  # 1.2 million shingles
    texts = [t + " the same passage is at the end of a third of all texts" * (i % 3 == 0) for i, t in enumerate(texts)]
    blocks, docs = neardup._counted(spark.createDataFrame([(i, i, i, t) for i, t in enumerate(texts)], "doc_id BIGINT, t BIGINT, u BIGINT, text STRING").repartition(3))
    sets = [neardup.shingles(t.encode()) for t in texts]
    df = Counter(x for h, _ in sets for x in h.tolist())
    assert docs == 30 and max(df.values()) == 10
    got = 0
    for r in blocks.collect():
        for i, (h, n, w) in zip(r["ids"], neardup._weighted(bytes(r["types"]), bytes(r["at"]), r["ends"], r["known"], docs)):
            true = n * (np.log1p(docs / np.array([df[x] for x in h.tolist()])) + 0.1)
            assert (h == sets[i][0]).all() and np.allclose(w, true, rtol=1e-5)
            got += 1
    assert got == 30


def test_short_texts_have_64_bit_hashes():
    seen = {neardup.shingles(b"w%d" % i)[0].tobytes() for i in range(300_000)}  # 32 bits: some ten collide
    assert len(seen) == 300_000


def test_samples_estimate_the_similarity():
    rng = np.random.default_rng(4)
    hits = []
    for _ in range(60):
        h = np.unique(rng.integers(0, 1 << 32, 400, dtype=np.uint64).astype(np.uint32))
        w = rng.uniform(0.5, 3, len(h)).astype(np.float32)
        a, b = np.sort(rng.choice(len(h), 340, replace=False)), np.sort(rng.choice(len(h), 340, replace=False))
        true = neardup.jaccard(h[a], w[a], h[b], w[b])
        hits.append((neardup.samples(h[a], np.log(w[a])) == neardup.samples(h[b], np.log(w[b]))).mean() - true)
    assert abs(np.mean(hits)) < 0.02
