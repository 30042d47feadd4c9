"""Every stage of the pipeline against a plain version, on odd, repeated and empty input."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import ODD, plain_components

import corpus_pipeline as cp
from confero.llm import language, packing, quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_most_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, n = docs, docs.count()
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        kept = kept.cache()
        assert 0.5 * n < kept.count() <= n, name
        n = kept.count()
    packed = cp.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


SAY = {"en": "the of and that with thing reading house", "fr": "le de et que avec chose lecture maison", "es": "el los y con cosa lectura casa para"}
#: Columns with names that the stages use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, kept boolean, component_id long, text_hash long, node long"


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng, rows, labels = random.Random(3), [], []
    for i in range(240):
        lang = rng.choice(list(SAY))
        w = [rng.choice(SAY[lang].split()) + rng.choice(["", "s", str(i % 7)]) for _ in range(rng.randint(20, 80))]
        good = i % 4 > 0
        text = " ".join(w) + "." if good else "|".join(x.upper() + "###" for x in w)
        rows.append((i, text, lang if i % 5 else None))
        labels.append((i, int(good), 0))
    for i in range(0, 40, 4):  # near copies, of rows that are good
        w = rows[i + 1][1].split()
        rows.append((300 + i, " ".join(["changed", *w[1:]]), "en"))
    rows += [(1, rows[5][1], "en"), rows[9], rows[9]]  # another text under an id, and a row repeated
    rows += [(400 + k, t, None) for k, t in enumerate(ODD)] + [(None, "no id at all the of and", "en"), (500, " ".join(rng.choice(SAY["en"].split()) for _ in range(200_000)), "en")]
    path = str(tmp_path_factory.mktemp("sf"))
    table = [(*r, "s", len(r[1] or ""), 0.1, 7, False, 8, 9, 10) for r in rows]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def plain_language(rows):
    """Trigram counts and expectation-maximisation with dictionaries: the main language and its share."""
    def grams(t):
        b = b" " + re.sub(rb"[\x00-@\[-`{-\x7f]+", b" ", t.encode().lower()) + b" "
        return Counter(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(len(b) - 2))

    counts = {}
    for i, t, lang in rows:
        if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(grams(t))
    total = {k: sum(c.values()) + 0.5 * 65536 for k, c in counts.items()}
    names = sorted(counts)
    p = lambda g, k: (counts[k][g] + 0.5) / total[k]

    def em(seen, some, theta, rounds):
        for _ in range(rounds):
            new = dict.fromkeys(some, 0.0)
            for g, n in seen.items():
                mix = {k: p(g, k) * theta[k] for k in some}
                for k in some:
                    new[k] += n * mix[k] / sum(mix.values())
            theta = {k: v / sum(seen.values()) for k, v in new.items()}
        return theta, sum(n * math.log(sum(p(g, k) * theta[k] for k in some)) for g, n in seen.items())

    def infer(t):
        if not t or not re.search(r"[^\W\d_]", t):
            return "und", 0.0
        seen = grams(t)
        theta, _ = em(seen, names, dict.fromkeys(names, 1 / len(names)), 8)
        order = sorted(names, key=lambda k: (-theta[k], k))
        share, best = {order[0]: 1.0}, em(seen, order[:1], {order[0]: 1.0}, 0)[1]
        for m in range(2, len(names) + 1):
            some, like = em(seen, order[:m], {k: theta[k] / sum(theta[j] for j in order[:m]) for k in order[:m]}, 6)
            if like - language.PENALTY * (m - 1) <= best - language.PENALTY * (m - 2):
                break
            share, best = some, like
        top = max(share, key=lambda k: share[k])
        return top, share[top]

    return [infer(t) for _, t, _ in rows]


def test_language_stage(spark, fixture):
    path, rows = fixture
    docs = spark.read.parquet(f"{path}/documents.parquet")
    plain = plain_language(rows)
    key = lambda i: -1 if i is None else i
    got = sorted((key(r["doc_id"]), r["lang_pred"], r["score"]) for r in language.identify(docs).collect())
    want = sorted((key(i), lang, s) for (i, _, _), (lang, s) in zip(rows, plain))
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-3)
    kept = cp.language_stage(spark, docs, path)
    assert kept.columns == docs.columns
    assert rows_of(kept) == sorted(((i, t) for (i, t, _), (lang, s) in zip(rows, plain) if lang != "und" and s >= cp.LEAST_SHARE), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    assert cp.language_stage(spark, docs.limit(0), path).count() == 0


def plain_features(t):
    """Measures of a text, by characters and words."""
    shape = re.sub(rb"A{2,}", b"AA", re.sub(rb"a{2,}", b"aa", t.encode().translate(quality._SHAPE)))
    b, out = b" " + shape + b" ", [0] * quality._SLOTS
    n = len(b) - 2
    for i in range(n):
        out[(b[i] * 961 + b[i + 1] * 31 + b[i + 2]) * 0x9E3779B1 % 2**32 >> 23] += 1
    return [math.log1p(x * 1000 / max(n, 1)) for x in out]


def plain_descent(p, u, prior, weights):
    """The risk that is minimised, its parts by loops."""
    soft = lambda z: math.log1p(math.exp(-abs(z))) + max(z, 0)
    z = lambda x: sum(a * b for a, b in zip(x, weights)) + weights[-1]
    plus = sum(soft(-z(x)) for x in p) / len(p)
    minus = sum(soft(z(x)) for x in u) / len(u) - prior * sum(soft(z(x)) for x in p) / len(p)
    return prior * plus + max(0.0, minus)


def test_quality_stage(spark, fixture):
    path, rows = fixture
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    for t in ("", "a", "One two.\nThree 44!", "É ß 中文"):
        assert quality.features(t.encode())[: quality._SLOTS].tolist() == pytest.approx(plain_features(t))
    model = quality.learn(docs, labels, 3, 1, 6000, 6000)
    may = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 != 1
    good = {i for i in range(240) if i % 4}
    p = [quality.features(t.encode()) for i, t, _ in rows if may(i) and i in good and t is not None]
    u = [quality.features(t.encode()) for i, t, _ in rows if may(i) and t is not None]
    share = sum(i in good or 300 <= i < 400 or i >= 400 for i, t, _ in rows if may(i) and t is not None) / len(u)
    assert model.prior == pytest.approx(share, abs=0.12)
    scaled = [[[*((x - model.mean) / model.scale), 1.0] for x in xs] for xs in (p, u)]
    best = plain_descent(*scaled, model.prior, model.w.tolist())
    rng = random.Random(1)
    for _ in range(20):  # no step aside does better by much
        assert best < plain_descent(*scaled, model.prior, [w + rng.gauss(0, 0.05) for w in model.w]) + 0.02
    want = [(i, t) for i, t, _ in rows if model.score(quality.features((t or "").encode())) >= 0.5]
    kept = cp.quality_stage(spark, docs, path)
    assert kept.columns == docs.columns
    assert rows_of(kept) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    held = {i for i in range(240) if not may(i)}
    assert sum((i in good) != ((i, t) in want) for i, t, _ in rows[:240] if i in held) <= 3
    assert cp.quality_stage(spark, docs.limit(0), path).count() == 0


def test_neardup_stage(spark, fixture):
    path, rows = fixture
    docs = spark.read.parquet(f"{path}/documents.parquet")
    some = [(i, t) for i, t, _ in rows if i is not None]
    groups = {}
    for (i, t), (_, n, component) in zip(some, plain_components(some, 5, 80)):
        groups.setdefault((component, n > 0 and "set", None if n else (i, t or "")), set()).add((i, t))
    kept = rows_of(cp.neardup_stage(spark, docs, path))
    # groups of several links may share a component id only where two texts share a doc_id
    for (component, *_), members in groups.items():
        held = [x for x in kept if x in members]
        assert held and all(i == component for i, _ in held) and len(held) == len(set(held))
    assert len(kept) == len({(i, t or "") for i, t in kept}) and 9 in {i for i, _ in kept} and 309 not in {i for i, _ in kept}
    assert cp.neardup_stage(spark, docs, path).columns == docs.columns and cp.neardup_stage(spark, docs.limit(0), path).count() == 0


def test_whole_pipeline(spark, fixture):
    path, rows = fixture
    got = cp.run(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = docs
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, path)
    bpe = packing.word_bpe()
    want = []
    for r in kept.collect():
        ids = bpe.tokenizer.encode(r["text"], add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want.append((r["doc_id"] if r["doc_id"] is not None else -1, k // 2048, k, len(part) // 4, zlib.crc32(part)))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= math.ceil(sum(ends.values()) / 2048) + 2
