"""I-Match fingerprints in DataFrame operations only.

Terms (words, hashed to 64 bits) whose document frequency lies in a band form the lexicon; the share at its
lower end bounds its size, whatever the corpus: no more than (mean distinct terms of a document) / share.
At the band's upper end a large group of copies or near copies counts as about one document, so that a group
does not push its own terms out.
A text keeps its distinct terms of the lexicon in order and hashes those of several random subsets of the
lexicon, coarse subsets for short texts and fine ones for long texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import table, text_or_empty

#: Random partitions of the lexicon, as (bits skipped, number of subsets).
SUBSETS = ((8, 8), (16, 128))
#: Sketches of a text, each of some neighbours in the order of terms: near copies share one of them nearly always,
#: texts that have no more than frequent words in common hardly ever.
SKETCHES, LEAST = 4, 4
#: Groups with this share of the rows and more count once, which bounds their list; ten of the smaller ones
#: make no more than the band's lower end.
GROUP = 0.0005
ONE = 1 << 30


def lower_letters(word: Column) -> Column:
    """A-Z in lower case and no other letter: going letter by letter is slow, so only for words that need it."""
    by_letter = F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).when(F.lower(word) == word, word).otherwise(by_letter)


def terms(text: Column) -> Column:
    """Hashes of the distinct words, A-Z in lower case, in order.

    A text whose characters are one byte each is lowered as a whole.  Words are cut at each blank, 20 and 09 to 0D; the
    empty ones between two blanks go by their hash."""

    def hashes(of: Column, lowered) -> Column:
        return F.transform(F.split(of, "\\s"), lambda w: F.xxhash64(lowered(w)))

    found = F.when(F.octet_length(text) == F.char_length(text), hashes(F.lower(text), lambda w: w)).otherwise(hashes(text, lower_letters))
    return F.sort_array(F.array_remove(F.array_distinct(found), F.xxhash64(F.lit(""))))


def sketched(docs: DataFrame) -> DataFrame:
    """t and its sketches k0, k1, ...: hashes of the LEAST terms that come first from each of SKETCHES places on, the
    last followed by the first; null for a text without terms.

    The leading bits of a term say between which places it stands (SKETCHES is a power of two)."""
    bits = 65 - SKETCHES.bit_length()
    docs = docs.select("t", F.transform("t", lambda x: F.shiftright(x, bits)).alias("part"))
    starts = [F.size("t").cast("long") + 1]
    for part in range(SKETCHES // 2 - 1, -SKETCHES // 2, -1):
        starts.append(F.coalesce(F.nullif(F.array_position("part", F.lit(part).cast("long")), F.lit(0).cast("long")), starts[-1]))
    starts = [F.lit(1), *starts[:0:-1]]
    docs = docs.select("t", *(x.cast("int").alias(f"start{i}") for i, x in enumerate(starts)))
    around = F.concat("t", F.slice("t", 1, LEAST))
    some = [F.slice(around if i else F.col("t"), F.col(f"start{i}"), F.lit(LEAST)) for i in range(SKETCHES)]
    return docs.select("t", *(F.when(F.size("t") > 0, F.xxhash64(F.lit(i), x)).alias(f"k{i}") for i, x in enumerate(some)))


def lexicon(docs: DataFrame, low: float, high: float) -> list[int]:
    """Terms in at least max(2, low * documents), and in at most high * documents when a text of a large group of
    near copies counts as its share of the group.

    The group's size is that of the largest set of texts with one of the text's sketches.
    """
    n = docs.count()
    read = docs.select(terms(F.col("text")).alias("t"))
    found = sketched(read).select(F.explode(F.array(*(f"k{i}" for i in range(SKETCHES)))).alias("sketch"))
    large = found.where("sketch is not null").groupBy("sketch").agg(F.count("*").alias("size")).where(F.col("size") >= max(2, math.ceil(GROUP * n)))
    large = [(r["sketch"], r["size"]) for r in large.collect()]
    counted, size = read, F.lit(1).cast("long")
    if large:
        table = F.broadcast(docs.sparkSession.createDataFrame(large, "sketch long, size long"))
        counted = sketched(counted)
        for i in range(SKETCHES):
            counted = counted.join(table.select(F.col("sketch").alias(f"k{i}"), F.col("size").alias(f"size{i}")), f"k{i}", "left")
        size = F.coalesce(F.greatest(*(F.col(f"size{i}") for i in range(SKETCHES))), F.lit(1))
    share = F.greatest(F.lit(1), F.floor(F.lit(ONE) / size)).cast("long")
    # explode() would have Spark work the terms out a second time, to leave empty lists out first
    counts = counted.select(share.alias("share"), "t").select("share", F.explode_outer("t").alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"), F.sum("share").alias("shares"))
    band = (F.col("df") >= max(2, math.ceil(low * n))) & (F.col("shares") <= max(2, math.floor(high * n)) * ONE)
    return [r[0] for r in counts.where(band).select("term").collect()]


#: A subset's number and a term's place in its text, as one number.
PLACES = 32


def fingerprint(docs: DataFrame, band: list[int], name: str) -> DataFrame:
    """Replaces the terms t by the subsets that the text's terms in the lexicon touch, in order ({name}_subsets), and by
    the hashes of these terms ({name}); a text without a term in the lexicon goes by all its terms.

    The lexicon stands in the plan as the constants of one IN, which Spark turns into a hash table.  Terms are sorted by
    subset once; each subset's terms then stand together, in their own order.
    """
    others = [c for c in docs.columns if c != "t"]
    if band:
        docs = docs.withColumn("inside", F.expr(f"filter(t, x -> x in ({','.join(f'{x}L' for x in band)}))"))
        docs = docs.select(*others, F.when(F.size("inside") > 0, F.col("inside")).otherwise(F.col("t")).alias("t"))

    def dealt(before: int, skip: int, parts: int) -> Column:
        mask, left = (parts - 1) << skip, PLACES - skip
        return F.transform("t", lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(mask).cast("long")), left) + (i + F.lit(before << PLACES)))

    placed, before = [], 0
    for skip, parts in SUBSETS:
        placed.append(dealt(before, skip, parts))
        before += parts
    docs = docs.select(*others, "t", F.sort_array(F.concat(*placed)).alias("placed"))
    docs = docs.select(*others, "t", "placed", F.transform("placed", lambda p: F.shiftright(p, PLACES).cast("smallint")).alias("subset"))
    # the place after the last term of each subset; a subset's terms begin where those before it end
    ends = F.filter(F.sequence(F.lit(1), F.size("subset")), lambda i: ~F.get(F.col("subset"), i).eqNullSafe(F.get(F.col("subset"), i - 1)))
    docs = docs.select(*others, "t", "placed", "subset", F.when(F.size("subset") > 0, ends).otherwise(F.array().cast("array<int>")).alias("ends"))

    def hashed(end, i):  # in a lambda, slice() would copy its whole list each time
        begin = F.when(i > 0, F.get(F.col("ends"), i - 1)).otherwise(0)
        return F.xxhash64(F.transform(F.sequence(begin, end - 1), lambda j: F.get(F.col("t"), F.get(F.col("placed"), j).bitwiseAND(F.lit((1 << PLACES) - 1)).cast("int"))))

    return docs.select(*others, F.array_distinct("subset").alias(f"{name}_subsets"), F.transform("ends", hashed).alias(name))


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes among the subsets that either text touches; two texts without terms are alike.

    Lists of different subsets of one partition differ, those of two partitions need not."""
    touched, equal, before = F.size(F.array_union(f"{a}_subsets", f"{b}_subsets")), F.lit(0), 0
    for _, parts in SUBSETS:

        def of(name: str, low: int = before, high: int = before + parts) -> Column:
            start = F.size(F.filter(f"{name}_subsets", lambda s: s < low)) if low else F.lit(0)
            return F.slice(name, start + 1, F.size(F.filter(f"{name}_subsets", lambda s: s < high)) - start)

        equal, before = equal + F.size(F.array_intersect(of(a), of(b))), before + parts
    return F.when(touched == 0, F.lit(1.0)).otherwise(equal / touched)


def shown(name: str) -> Column:
    """The hashes of all subsets with a dash between two of them; nothing stands for a subset without terms."""
    subset, last = F.col(f"{name}_subsets"), sum(parts for _, parts in SUBSETS) - 1
    dashes = lambda n: F.substring(F.lit("-" * last), F.lit(1), n.cast("int"))
    each = F.transform(name, lambda h, i: F.concat(dashes(F.get(subset, i) - F.when(i > 0, F.get(subset, i - 1)).otherwise(0)), F.hex(h)))
    return F.concat(F.array_join(each, ""), dashes(F.lit(last) - F.coalesce(F.get(subset, F.size(subset) - 1), F.lit(0))))


def below(bounds: list[int], x: Column) -> Column:
    """How many of the sorted bounds are less than x, in two steps of about the root of their number."""
    step = math.isqrt(len(bounds)) + 1
    every = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    less = lambda some: F.size(F.filter(some, lambda b: b < x))
    coarse = less(F.split(F.lit(",".join(map(str, bounds[::step]))), ",").cast("array<bigint>"))
    return let(F.greatest(coarse - 1, F.lit(0)) * step, lambda before: before + less(F.slice(every, before + 1, F.lit(step))))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Adds the next row's columns (next_*) in descending doc_id, the first row's after the last.

    Rows are dealt to ranges of doc_id; the first rows of a range stand at the end of the range before it
    as well, so that no window spans two ranges.  Equal doc_ids follow each other by the hash of their text.
    """
    bounds = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], F.lit(20 * buckets)).alias("b")).first()["b"] if buckets > 1 else None
    bounds = sorted(set(bounds or []))
    at = below(bounds, F.col("doc_id")) if bounds else F.lit(0)
    firsts = sorted((r[0], r[1]) for r in docs.select(at.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id")).collect())
    if not firsts:
        firsts = [(0, 0)]
    lower = {top: firsts[i + 1][0] if i + 1 < len(firsts) else firsts[0][0] for i, (_, top) in enumerate(firsts)}  # the range before, in descending order
    tops = F.create_map(*(F.lit(x) for pair in lower.items() for x in pair))
    also = F.when(F.col("doc_id").isin(list(lower)), F.array(F.struct(at.alias("bucket"), F.lit(0).alias("copy")), F.struct(F.element_at(tops, F.col("doc_id")).alias("bucket"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(at.alias("bucket"), F.lit(0).alias("copy"))))
    names = docs.columns
    dealt = docs.select("*", F.explode(also).alias("place")).select(*names, "place.bucket", "place.copy")
    w = Window.partitionBy("bucket").orderBy("copy", F.desc("doc_id"), F.xxhash64("text"))
    return dealt.select(*names, "copy", *(F.lead(c).over(w).alias(f"next_{c}") for c in names)).where("copy = 0").drop("copy")


def i_match(docs: DataFrame, low: float = 0.005, high: float = 0.05, buckets: int | None = None) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts.

    Null texts are empty, texts of any length are read whole.  Equal texts have equal fingerprints.  Rows without a
    doc_id take no part; an empty table gives no rows; repeated rows each get a row, one after another, and rows of one
    doc_id follow each other by the hash of their texts; columns other than doc_id and text are not looked at.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    band = lexicon(docs, low, high)
    buckets = buckets or 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = fingerprint(docs.select("doc_id", "text", terms(F.col("text")).alias("t")), band, "f")
    both = with_next(own, buckets).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(f"{x}f{y}" for x in ("", "next_") for y in ("", "_subsets")), terms(F.col("edited")).alias("t"))
    both = fingerprint(both, band, "e")
    return both.select("doc_id", "n_chars", "edited_sha256", shown("f").alias("fingerprint"), shown("e").alias("edited_fingerprint"), likeness("f", "e").alias("near_edited"), likeness("f", "next_f").alias("near_next"))


def op7_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i_match(table(spark, sf_dir, "documents"))
