"""The corpus operators against brute force, and on empty, null, repeated and odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from confero.llm import attention, bpe, fingerprint, language, lm, mtree, neardup, packing, quality, toxicity, warc, wordids

DOCS = "doc_id long, text string, lang string, source string, score double, bucket long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", 0.5, 1) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \t\n", "a", "one two", "one two", "x " * 3000, "ÀÉ ß 中文 𝔘 \x1c\x85", "…!?", "the cat sat on the mat " * 4]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_top_k(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-9, 9) for _ in range(4)]) for i in range(300)] + [(1000 + i, [1, 2, 3, 4]) for i in range(40)] + [(2000, None), (2001, [1, 2]), (2002, []), (None, [1, 2, 3, 4])]
    rows += [*rows[:3], *[(1020, [1, 2, 3, 4])] * 30, *[(1001, [1, 2, 3, 4])] * 4, (20, [5, 5, 5, 5]), (2020, [9, 9])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, v array<bigint>, block long, page string")
    asked = sorted({(i, tuple(v)) for i, v in rows if i is not None and i % 20 == 0 and v})
    want = []
    for i, v in asked:
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j is not None and j != i and w and len(w) == len(v))[:10]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    for block, part, page in ((8192, 1024, 256), (64, 4, 8)):
        monkeypatch.setattr(mtree, "BLOCK", block)
        monkeypatch.setattr(mtree, "QUERIES", part)
        monkeypatch.setattr(mtree, "PAGE", page)
        got = mtree.top_k(df, df.where("vec_id % 20 = 0")).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert mtree.top_k(df.limit(0), df.limit(0)).count() == 0 and mtree.top_k(df.limit(0), df).count() == 0


def test_tree_passes_pages_over():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (40, 8))
    vectors = np.concatenate([c + rng.integers(-9, 9, (100, 8)) for c in centres])
    tree = mtree.MTree.build(np.arange(4000), vectors, 11)
    for i in range(0, 4000, 250):
        found = tree.search(vectors[i], 10, i)
        scores = vectors @ vectors[i]
        assert found == sorted(((int(s), j) for j, s in enumerate(scores.tolist()) if j != i), key=lambda x: (-x[0], x[1]))[:10]
    assert tree.computed < 16 * 4000 / 4


def test_integers(spark):
    df = spark.createDataFrame([(1, [0.5, -0.0001]), (2, [float("nan"), 1.0]), (3, None), (4, [None, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], list(r["v"])) for r in mtree.integers(df).collect()] == [(1, [512, -1])]


def test_byte_bpe(spark):
    import tiktoken

    b = bpe.byte_bpe()
    e = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    texts = [*ODD, "abab" * 400, "it's  I'LL <|endoftext|> 123456", "x" * 1_000_000, " \n" * 2000, "word and " * 120_000]
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = np.frombuffer(got[i]["ids"], "<u4").tolist()
        assert ids == e.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()
    assert bpe.encode_documents(docs(spark, texts).limit(0)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [*ODD, *(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 1500))) for _ in range(60))]
    texts += ["x <|startoftext|> <|endoftext|>", "in<|endoftext|>side", "<|ENDOFTEXT|> <|endoftext", "<|endoftext|>É" * 3000, "w" * 1_000_000, "a b " * 250_000]
    t = Tokenizer.from_file(packing.WORD_BPE)
    rows = packing.pack(docs(spark, texts), with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = [k for r in pieces for k in np.frombuffer(r["ids"], "<u4").tolist()]
        assert ids == [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert all(r["length"] == 2048 for r in pieces[:-1])
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by_seq) <= 1.03 * sum(r["length"] for r in rows) / 2048 + 2
    assert packing.pack(docs(spark, texts).limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(5)
    say = {"en": "the of and that with thing reading", "fr": "le de et que avec chose lecture"}
    rows = [(i, " ".join(rng.choice(say[l].split()) for _ in range(30)), l) for i, l in enumerate(itertools.islice(itertools.cycle(say), 80))]
    rows += [(500, None, None), (501, "12 !?", "en"), (502, "", "fr"), (503, "the of and that with thing " * 5 + "le de et que avec chose lecture " * 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert all(got[i]["lang_pred"] == l for i, _, l in rows[:80])
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503)] == ["und", "und", "und", "fr"]
    assert set(got[503]["shares"]) == {"en", "fr"} and 0 <= got[503]["score"] <= 1
    assert language.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_components(rows, size, percent):
    """(n_shingles, component) of each (doc_id, text), every row a document."""
    sets = []
    for _, t in rows:
        w = words(t)
        n = min(size, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)]


def near_texts(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return [*texts, *[texts[-1]] * 5, "long " + " ".join(rng.choice(vocabulary) for _ in range(60_000))]


def test_near_duplicates(spark, monkeypatch):
    texts = near_texts(random.Random(7))
    want = sorted(plain_components(list(enumerate(texts)), 3, 85))
    for block in (512, 8):  # small blocks: buckets and clusters are cut
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = neardup.near_duplicates(docs(spark, texts).withColumns({c: F.lit(1) for c in ("node", "key", "row", "part", "component", "text_hash")}), 3, 85).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    repeated = docs(spark, ["a b c d e f", "a b c d e f"]).withColumn("doc_id", F.lit(4).cast("long"))
    assert [(r["component_id"], r["kept"]) for r in neardup.near_duplicates(repeated).collect()] == [(4, True)] * 2
    assert neardup.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_near_duplicates_of_one_id(spark):
    rng = random.Random(8)
    a, b = (" ".join(f"{x}{rng.randrange(99)}" for _ in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, a), (4, None), (4, None), (5, ""), (0, b + " less")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(rows, 3, 85))
    assert len({r["group_id"] for r in got}) == 5


def test_components_of_a_path(spark):
    order = list(range(10_000))
    random.Random(4).shuffle(order)
    scratch = neardup.Scratch(spark, "t")
    saved = []
    scratch.save = lambda df, name, save=scratch.save: saved.append(name) or save(df, name)
    got = neardup.components(spark.createDataFrame(list(zip(order, order[1:])) + [(20_000, 20_001)], "a long, b long"), scratch, "path").collect()
    assert sorted((r["node"], r["component"]) for r in got) == [(i, 0) for i in range(10_000)] + [(20_000, 20_000), (20_001, 20_000)]
    assert len(saved) <= 2 * 20


def test_fingerprints(spark):
    rng = random.Random(9)
    texts = [*ODD, *(" ".join(rng.choice(["red", "blue", "green", "cat", "dog", f"u{i}"]) for _ in range(rng.randint(5, 50))) for i in range(80))]
    rows = {r["doc_id"]: r for r in fingerprint.i_match(docs(spark, texts), low=0.05, high=0.9, buckets=7).collect()}
    n, seen = len(texts), {}
    for i in range(n):
        t, nxt = texts[i] or "", texts[i - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
        if edited == t:
            assert rows[i]["near_edited"] == 1 and rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]
        assert seen.setdefault(t, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
    assert fingerprint.i_match(docs(spark, texts).limit(0)).count() == 0
    assert fingerprint.i_match(docs(spark, ["one"])).first()["near_next"] == 1


def plain_fingerprints(rows, low, high):
    """What i_match says of (doc_id, text), worked out text by text: shown fingerprints and likenesses."""
    import math
    import struct

    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def chained(xs, h=42):
        for x in xs:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return h

    terms = lambda t: sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words(t)})

    def sketches(ts):
        for i in range(fingerprint.SKETCHES if ts else 0):
            place = (i << 64) // fingerprint.SKETCHES - (1 << 63)
            some = ([x for x in ts if x >= place] + ts if i else ts)[: fingerprint.LEAST]
            yield i, chained(some, xxhash.xxh64_intdigest(struct.pack("<i", i), 42))

    n, groups, df, shares = len(rows), {}, {}, {}
    for _, t in rows:
        for k in sketches(terms(t)):
            groups[k] = groups.get(k, 0) + 1
    for _, t in rows:
        size = max([1, *(groups[k] for k in sketches(terms(t)) if groups[k] >= max(2, math.ceil(fingerprint.GROUP * n)))])
        for x in terms(t):
            df[x], shares[x] = df.get(x, 0) + 1, shares.get(x, 0) + max(1, fingerprint.ONE // size)
    band = {x for x in df if df[x] >= max(2, math.ceil(low * n)) and shares[x] <= max(2, math.floor(high * n)) * fingerprint.ONE}

    def hashes(t):
        kept = [x for x in terms(t) if x in band] or terms(t)
        return [chained([x for x in kept if x >> skip & parts - 1 == s]) for skip, parts in fingerprint.SUBSETS for s in range(parts)]

    def like(a, b):
        both = [x == y for x, y in zip(a, b) if (x, y) != (42, 42)]
        return sum(both) / len(both) if both else 1.0

    shown = lambda f: "-".join("" if x == 42 else f"{x:X}" for x in f)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        own, edited, after = hashes(t), hashes(t[: len(t) - half] + u[:half]), hashes(u)
        out.append((i, len(t), shown(own), shown(edited), like(own, edited), like(own, after)))
    return out


def test_fingerprints_against_plain(spark):
    rng = random.Random(29)
    text = lambda: " ".join(rng.choice(["red", "blue", "green", f"u{rng.randrange(30)}", f"v{rng.randrange(9)}"]) for _ in range(rng.randint(1, 60)))
    base = text()
    rows = [(i, t) for i, t in enumerate([*ODD, *(text() for _ in range(60)), *(base + f" w{k}" for k in range(30)), "long " * 250_000 + base])]
    rows += [(5, "another"), (5, "another"), (7, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows] + [(None, "no id", 1, "x")], "doc_id long, text string, n_chars long, next_text string")
    want = sorted(plain_fingerprints(rows, 0.02, 0.5))
    for buckets in (1, 9, 70):
        got = sorted((r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprint.i_match(df, low=0.02, high=0.5, buckets=buckets).collect())
        assert [x[:4] for x in got] == [x[:4] for x in want]
        assert [x[4:] for x in got] == [pytest.approx(x[4:]) for x in want]


def test_fingerprint_terms(spark, monkeypatch):
    import struct

    import xxhash

    texts = [*ODD, "ÉCOLE École école\tABC\x0babc  Ünï İSTANBUL ẞA", "ΑΒΓ \u212aELVIN ABC\r\nabc\x0c", "\x1fPlain ABC\x85D  abc ", "Ž" * 3000 + " A"]
    df = docs(spark, texts).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = lambda h: struct.unpack("<q", struct.pack("<Q", h))[0]
    for r in df.select("doc_id", fingerprint.terms(F.col("text")).alias("t")).collect():
        assert r["t"] == sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words(texts[r["doc_id"]])})
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    assert fingerprint.lexicon(df, 0.1, 0.9)
    # no filter in front of an explode works a text's terms out a second time
    assert any("split(" in p for p in plans) and not any("Filter" in x and "split(" in x for p in plans for x in p.splitlines())


def test_fingerprints_of_a_large_group(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    weights = [1 / (i + 5) for i in range(4000)]

    def text():
        return rng.choices(vocabulary, weights, k=150)

    for own in (False, True):  # the group's words are everyone's, or its own
        base = [f"own{i}" for i in range(150)] if own else text()
        texts = []
        for _ in range(200):
            copy = list(base)
            for _ in range(3):
                copy[rng.randrange(150)] = rng.choices(vocabulary, weights)[0]
            texts.append(" ".join(copy))
        texts += [" ".join(text()) for _ in range(400)]
        near = {r["doc_id"]: r["near_next"] for r in fingerprint.i_match(docs(spark, texts)).collect()}
        assert sum(near[i] for i in range(1, 200)) / 199 > 0.6
        assert sum(near[i] for i in range(201, 600)) / 399 < 0.1


def test_warc(spark):
    big = "é<p>x</p>" * 20000
    pages = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 40), (8, "http://é/" + "u" * 200_000, "x" * 999_999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    scratch = warc.Scratch(spark, "t")
    got = {r["page_id"]: r for r in warc.read_records(warc.write_records(df, scratch, chunk=1000), scratch).collect()}
    for i, _, html in pages:
        p = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["intact"]) == (len(p), hashlib.sha256(p).hexdigest(), True)
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] != "response"} == {2: ("revisit", 1)}
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_repeated_rows(spark):
    one, two = "<p>one</p>" * 300, "<p>two</p>" * 300
    pages = [(1, "u", one), (1, "u", one), (1, "v", one), (1, "u", two), (2, "u", one), (2, "u", one), (3, None, None), (3, None, None), (4, "u", "alone")]
    df = spark.createDataFrame(pages * 2, "page_id long, url string, html string")
    scratch = warc.Scratch(spark, "t")
    archive = warc.write_records(df, scratch, chunk=1000)
    heads = [bytes(r["data"]).decode() for r in archive.where("chunk = 0").collect()]
    ids = {re.search("WARC-Record-ID: <(.*)>", h)[1] for h in heads}
    assert len(ids) == len(heads) == 2 * len(pages)
    assert {r[1] for h in heads if (r := re.search("WARC-Refers-To: <(.*)>", h))} <= ids
    assert sorted(re.findall("WARC-Target-URI: (.*)\r", "".join(heads))) == sorted(u for _, u, _ in pages * 2 if u)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0, r["intact"]) for r in warc.read_records(archive, scratch).collect())
    want = sorted((i, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", 1) if i == 2 else ("response", 0)), True) for i, _, h in pages * 2)
    assert got == want


def test_warc_damage(spark):
    pages = [(1, None, "<p>one</p>" * 300), (2, None, "<p>one</p>" * 300), (3, "u", "other" * 300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    scratch = warc.Scratch(spark, "t")
    archive = warc.write_records(df, scratch, chunk=1000)
    for at in ("chunk = 1", "chunk = 0"):  # a byte of the payload, in a further chunk or the first
        hurt = archive.withColumn("data", F.expr(f"if(record_id like 'urn:page:1:%' and {at}, cast(replace(cast(data as string), 'one</p><p>one', 'two</p><p>one') as binary), data)"))
        assert {r["page_id"]: r["intact"] for r in warc.read_records(hurt, scratch).collect()} == {1: False, 2: False, 3: True}
    assert warc.read_records(archive.where("chunk <> 1"), scratch).where("intact").count() == 0


def labelled(spark):
    rng = random.Random(11)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [rng.choice(plain) for _ in range(30)]
        if bad:
            for _ in range(4):
                w[rng.randrange(30)] = rng.choice(["idiot", "scum", "idiotic"])
        text = " ".join(w) + "." if i % 8 < 6 else " ".join(x + "###" for x in w)
        rows.append((i, text))
        labels.append((i, int(i % 8 < 6), int(bad)))
    rows += [(900, None), (901, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    d, l = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, l).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) > 0.97 * len(held)
    assert got[900]["score"] == got[901]["score"] and got[901]["predicted"] == 0
    odd = d.where("doc_id in (4, 5, 900)").union(d.where("doc_id = 4")).union(spark.createDataFrame([(4, "scum"), (950, "word1 " * 200_000), (None, "word2")], "doc_id long, text string"))
    more = toxicity.score_toxicity(d.union(odd).withColumns({c: F.lit(1) for c in ("y", "score", "predicted", "held_out", "lang")}), l).collect()
    assert len(more) == 402 + 7 and len({r["score"] for r in more if r["doc_id"] == 5}) == 1 and sum(r["doc_id"] == 4 for r in more) == 4
    assert [r["predicted"] for r in more if r["doc_id"] in (950, None)] == [0, 0]
    assert toxicity.score_toxicity(d, l.limit(0)).count() == 402 and toxicity.score_toxicity(d.limit(0), l).count() == 0


def plain_kneser_ney(rows):
    """Log-likelihood ratios of words and of pairs, from counts that are taken anew for each question."""
    import math

    docs_ = [[w for w in (x.strip(".,;:!?\"'()[]*#$%&|-") for x in t.lower().split()) if w] for t, _ in rows]
    kinds = [y for _, y in rows]
    depth = toxicity.DEPTH
    starts = lambda w: [w[:i] for i in range(min(len(w), depth) + 1)]
    later = lambda w: [" " + w[i - depth : i] for i in range(depth + 1, len(w) + 1)]

    def count(c, x):  # documents' different words that begin so; documents that hold such letters inside a word
        if x[:1] == " ":
            return sum(any(x in later(w + "$") for w in set(ws)) for ws, y in zip(docs_, kinds) if y == c)
        return sum(starts(w + "$").count(x) for ws, y in zip(docs_, kinds) if y == c for w in set(ws))

    known = {x for ws in docs_ for w in ws for x in starts(w + "$") + later(w + "$") if x}
    n = {(c, x): count(c, x) for c in (0, 1) for x in known | {""}}
    d = lambda k: (1.0 if k < 2 else 0.75) if k else 0.0

    def p(c, x):
        like = [y for y in known if y[-3:] == x[-3:]]
        shared = (len(like) + 0.5) / (sum(y[-3:-1] == x[-3:-1] for y in known) + 128)
        after = [y for y in known if y[:-1] == x[:-1]]
        before = sum(n[c, y] for y in after) if x[:1] == " " else n.get((c, x[:-1]), 0)
        if not before:
            return shared
        return max(n.get((c, x), 0) - d(n.get((c, x), 0)), 0) / before + sum(d(n[c, y]) for y in after) / before * shared

    parts = lambda w: starts(w + "$")[1:] + later(w + "$")
    whole = lambda c, w: math.prod(p(c, x) for x in parts(w))

    def ratio(w):
        total, cut = 0.0, False
        for x in parts(w):
            seen = n.get((0, x), 0) + n.get((1, x), 0) >= toxicity.RARE
            cut = cut or (x[:1] != " " and not seen)
            if seen and (x[:1] == " " or not cut):
                total += math.log(p(1, x) / p(0, x))
        return total

    pairs = [{(c, *x) for c in [y] for x in zip(ws, ws[1:])} for ws, y in zip(docs_, kinds)]

    def pair(v, w):
        def q(c):
            by = {}
            for some in pairs:
                for k, a, b in some:
                    if k == c and a == v:
                        by[b] = by.get(b, 0) + 1
            if not by:
                return whole(c, w)
            return (max(by.get(w, 0) - d(by.get(w, 0)), 0) + sum(map(d, by.values())) * whole(c, w)) / sum(by.values())

        return math.log(q(1) / q(0))

    return ratio, pair


def test_kneser_ney_against_plain():
    rng = random.Random(31)
    rows = [(" ".join(rng.choice(["good", "goods", "fool", "foolishness", "foolishnesses", "and", "so,", "中文字坏人们", f"x{rng.randrange(40)}"] + ["scum"] * (i % 3 == 0)) for _ in range(9)), int(i % 3 == 0)) for i in range(36)]
    model = toxicity.KneserNey()
    model.fit_counts((t.encode(), y) for t, y in rows)

    as_bytes = [(t.encode().decode("latin-1"), y) for t, y in rows]  # a letter is a byte
    ratio, pair = plain_kneser_ney(as_bytes)
    for w in ("good", "goods", "fool", "foolishnesses", "scum", "scums", "new", "x3", "中文字坏人们", "foolishnesx"):
        assert model.ratio(w.encode()) == pytest.approx(ratio(w.encode().decode("latin-1"))), w
    assert len(model.pair) > 5
    for (v, w), r in model.pair.items():
        assert r == pytest.approx(pair(v.decode("latin-1"), w.decode("latin-1"))), (v, w)
    many = b" ".join([b"and"] * 300_000)
    assert np.isfinite(model.evidence(many)).all() and model.evidence(b"").tolist() == [0, 0, 0]


def test_toxicity_of_word_ends():
    texts = [(f"x{i} understanding{'scum' if i % 4 == 0 else 'well'} y{i} {'中文字' * 9}{'坏人' if i % 4 == 0 else '好人'}中{'文' * (i % 5)}".encode(), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.KneserNey()
    model.fit_counts(iter(texts))
    for bad, good in ((b"understandingscum", b"understandingwell"), (("中文字" * 9 + "坏人中").encode(), ("中文字" * 9 + "好人中").encode())):
        assert model.ratio(bad) > 1 > model.ratio(good)


def test_quality(spark):
    d, l = labelled(spark)
    got = {r["doc_id"]: r for r in quality.score_quality(d, l).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 8 < 6) for i in held) > 0.95 * len(held)
    assert 0 <= got[900]["score"] == got[901]["score"] <= 1
    again = quality.score_quality(d.repartition(3).orderBy(F.desc("doc_id")), l).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {i: r["score"] for i, r in got.items()}
    assert {r["score"] for r in quality.score_quality(d, l.limit(0)).collect()} == {0.5} and quality.score_quality(d.limit(0), l).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in attention.initial(np.full(attention.CLASSES, 1 / attention.CLASSES)).items()}
    x = rng.normal(size=(3, attention.WINDOW, attention.WIDTH))
    y, asked = rng.integers(0, attention.CLASSES, (3, attention.WINDOW)), rng.random((3, attention.WINDOW)) < 0.8
    loss = lambda q, x: attention.gradient(q, x, y, asked)[0]
    _, g, dx = attention.gradient(p, x, y, asked)
    for name in g:
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        step = np.zeros_like(p[name])
        step[at] = 1e-5
        assert (loss(p | {name: p[name] + step}, x) - loss(p | {name: p[name] - step}, x)) / 2e-5 == pytest.approx(g[name][at], rel=0.02, abs=1e-6), name
    step = np.zeros_like(x)
    step[1, 5, 2] = 1e-5
    assert (loss(p, x + step) - loss(p, x - step)) / 2e-5 == pytest.approx(dx[1, 5, 2], rel=0.02, abs=1e-6)


def test_attention_windows():
    for lengths in ([1], [2, 23, 24, 25], [42, 43, 6, 300]):
        lengths = np.array(lengths)
        at, asked = attention.windows(lengths)
        assert sorted(at[asked].tolist()) == list(range(lengths.sum()))  # each input once
        text = np.repeat(np.arange(len(lengths)), lengths)
        assert (text[at] == text[at[:, :1]]).all()  # no window leaves its text
        start = (np.cumsum(lengths) - lengths)[text[at[:, 0]]]
        for row, ask, first in zip(at, asked, start):
            for j in np.flatnonzero(ask):
                assert j >= min(attention.OVERLAP, row[j] - first)


def plain_attention(p, columns, inputs):
    """Class log-probabilities after each input of one text, position by position, over the windows that hold it."""
    d, w, stride = attention.WIDTH, attention.WINDOW, attention.WINDOW - attention.OVERLAP
    x = np.array([np.mean([p["E"][c] for c in columns[i]], axis=0) for i in inputs], float)
    out = []
    for t in range(len(inputs)):
        nth = 0 if t < w else 1 + (t - w) // stride
        begin = nth * stride
        s = np.array([x[t] @ p["Wq"] @ (x[u] @ p["Wk"]) / d**0.5 + p["rel"][t - u] for u in range(begin, t + 1)])
        a = np.exp(s - s.max())
        g = (a / a.sum()) @ (x[begin : t + 1] @ p["Wv"]) + x[t] @ p["Wr"]
        z = g @ p["U"] + p["b"]
        out.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
    return out


def test_lm_scores_are_those_of_a_plain_model():
    """Texts scored in windows and by tables, against loops over words and ids."""
    rng = random.Random(23)
    texts = ["", "one", *(" ".join(rng.choice(["red", "blue", "house", "ünder", f"u{i}"]) for _ in range(n)) for i, n in enumerate((3, 22, 23, 24, 90, 200)))]
    model, frequent, ends = small_model(texts)
    scored, known = lm._Scored(model, frequent, ends), wordids.WordIds()
    split = [words(t) for t in texts]
    numbers = known.numbers([w.encode() for ws in split for w in ws])
    scored.update(known)
    lengths = np.array([len(ws) for ws in split])
    tokens = np.insert(numbers, np.cumsum(lengths), wordids.END)
    like = scored.scorer.score(scored.mean.all[np.insert(numbers, np.cumsum(lengths) - lengths, wordids.START)], scored.klass.all[tokens], lengths + 1) + scored.own.all[tokens]
    want = []
    for ws in split:
        ids = [known.encode([w.encode()])[0].tolist() for w in ws]
        columns = [[attention.COLUMNS - 1], *([int(model.lex.column[i]) for i in x] for x in ids)]
        log_p = plain_attention(model.weights, columns, range(len(columns)))
        for t, (w, x) in enumerate(zip(ws, ids)):
            c = int(model.lex.klass[x[0]])
            spelt = model.left[c] + model.first[x[0]]
            for i, j in zip(x, x[1:]):
                spelt += model.after[model.lex.column[i], model.lex.column[j]] + model.lex.inside[j]
            p = np.exp(spelt + model.after[model.lex.column[x[-1]], lm.STOP])
            if w.encode() in frequent:
                p += (frequent[w.encode()] - lm.DISCOUNT) / model.total[c]
            want.append(log_p[t][c] + np.log(p))
        want.append(log_p[len(ws)][lm.END_CLASS])
    assert like.tolist() == pytest.approx(want, abs=1e-3)


def small_model(texts):
    """A model of some texts, learned without Spark."""
    import pyarrow as pa

    count = {}
    for t in texts:
        for w in words(t):
            count[w.encode()] = count.get(w.encode(), 0) + 1
    batch = pa.RecordBatch.from_pydict({"word": pa.array(list(count), pa.binary()), "n": list(count.values())})
    size = wordids.word_ids().size
    cells = np.zeros(3 * size)
    for cell, n in lm._id_counts(iter([batch])):
        cells[cell] += n
    counts, begun, kinds = cells.reshape(3, size)
    lex = attention.lexicon(counts, begun, np.random.default_rng(1).integers(0, attention.GROUPS, attention.TOP))
    follow = np.zeros((lm.ROWS, lm.ROWS + 1))
    for cell, n in lm._followers(lex)(iter([batch])):
        follow.ravel()[cell] += n
    base = follow.sum(axis=0) + 0.1
    after = np.log((follow + 4 * base / base.sum()) / (follow.sum(axis=1, keepdims=True) + 4))
    by_class = lambda x: np.bincount(lex.klass, x, attention.CLASSES)
    total, left = by_class(begun) + lm.FLOOR, np.log((lm.DISCOUNT * by_class(kinds) + lm.FLOOR) / (by_class(begun) + lm.FLOOR))
    first = np.log((kinds + 0.1) / by_class(kinds + 0.1)[lex.klass])
    weights = attention.initial(np.full(attention.CLASSES, 1 / attention.CLASSES))
    return lm.Model(weights, lex, first, after, total, left), count, len(texts)


def test_lm_is_a_distribution():
    """What the model gives to a class's words, read or spelt, and to what may follow in a word, sums to one."""
    model, frequent, _ = small_model(["red blue house under underneath red red", "blue haus " * 9])
    lex, known = model.lex, wordids.word_ids()
    assert np.exp(model.after).sum(axis=1) == pytest.approx(1, abs=1e-5)
    for band in range(attention.BANDS):
        assert np.exp(lex.inside[lex.column == attention.TOP + band]).sum() == pytest.approx(1)
    flat, counts = known.encode(list(frequent))
    klass = lex.klass[flat[np.cumsum(counts) - counts]]
    for c in range(attention.CLASSES - 1):
        assert np.exp(model.first[lex.klass == c]).sum() == pytest.approx(1)
        held = sum(n - lm.DISCOUNT for n, k in zip(frequent.values(), klass) if k == c) / model.total[c]
        assert held + np.exp(model.left[c]) == pytest.approx(1)


def test_word_ids():
    known = wordids.WordIds()
    some = [w for t in ODD for w in words(t)] + ["hello", "hello,", ",", "É", "é", "x" * 5000, "中文" * 700, "\x1c\x85"]
    numbers = known.numbers([w.encode() for w in some])
    vocabulary = {i: b for b, i in known.coder._mergeable_ranks.items()}
    stop = np.cumsum(known.counts.all)
    for w, k in zip(some, numbers.tolist()):
        ids = known.ids.all[stop[k] - known.counts.all[k] : stop[k]].tolist()
        assert b"".join(vocabulary[i] for i in ids) == b" " + w.encode()  # whole, and apart from the next
        assert ids == known.coder.encode_ordinary(" " + w)
    assert len(set(numbers.tolist())) == len(set(some))


def test_lm(spark):
    import math
    import zlib
    from collections import Counter

    rng = random.Random(13)
    texts = [*ODD, "w" * 300_000, "red blue " * 60_000, *(" ".join(rng.choice(["red", "blue", "house", f"u{i}"]) for _ in range(rng.randint(1, 150))) for i in range(120))]
    rows = [*enumerate(texts), (5, "another text"), *[(7, texts[7])] * 2]
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows] + [(None, "no id", 1, "x", 2, "y")], "doc_id long, text string, row long, word string, n long, held_out string")
    got = lm.score_texts(df, head=6).collect()
    tokens = [(i, [*words(t), ""]) for i, t in rows]
    count = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    key = lambda r: (r[0], r[1], r[4])
    have = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    want = sorted(((i, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens), key=key)
    assert [r[:4] for r in have] == [r[:4] for r in want] and [r[4] for r in have] == pytest.approx([r[4] for r in want])
    assert all(r["score"] < 0 for r in got) and len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    assert lm.score_texts(df.limit(0)).count() == 0
    alone = lm.score_texts(df.where("crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")).collect()  # nothing to learn from
    assert alone and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in alone)


def test_lm_remembers_rare_words(spark):
    rng = random.Random(17)
    texts = [*ODD, *(" ".join(rng.choice(["red", "blue", "house", f"u{i % 40}", f"v{i}"]) for _ in range(rng.randint(1, 60))) for i in range(120))]
    few, many = ({r["doc_id"]: r["score"] for r in lm.score_texts(docs(spark, texts), head=head).collect()} for head in (3, 10_000))
    assert few == {i: pytest.approx(s, abs=1e-3) for i, s in many.items()}  # the list's bound changes no score
