"""Line dedup: an exact set-similarity join of lines, which removes later matches.

A line is the set of its distinct lower-case words. A line is removed if an earlier line (by doc_id,
then position) has the same set, or one with Jaccard similarity of THRESHOLD percent or more; lines
with fewer than MIN_TOKENS words are not compared as sets, but with `short_copies` (as the query and
the pipeline have it) they are removed as well if an earlier line is the same byte for byte.

1. Tokens are ordered by rarity. Counts over all texts go into a hashed table of fixed size, whose
   logarithms serve as tiers; ties and collisions are settled by the token's hash. Any total order
   gives exact results, the tiers only make the prefixes rare.
2. Equal lines collapse to their first; of each only the prefix of its tokens is kept. Lines are
   numbered in their order.
3. Prefix filter: two similar sets share one of the first n - ceil(t n) + 1 tokens of the longer one
   and of the first n - ceil(2t / (1 + t) n) + 1 of the shorter one. The length and positional filters
   bound the overlap from the sizes and from where the shared token stands.
4. First round: each set is compared with the first one of its tokens' buckets, the best such only.
   A large group of near copies so costs as many comparisons as it has members. Second round: sets
   without a match yet, with every earlier member of their buckets.
5. The lines of candidate pairs are fetched and compared as full token sets.

DataFrame operations only. Buckets meet in plain equi-joins that adaptive execution may split;
nothing but the fixed-size table of counts reaches the driver.

Cases: null or empty text has no lines to remove; a blank line is kept; repeated rows (one doc_id and
text) are one document's lines twice, both rows lose the same lines; rows that share a doc_id but not
the text are documents of their own, in the order of their texts' hashes; rows without doc_id are each
a document, before all others, so of two with one text the second has copies only; an empty table
gives an empty table; a very long line is one set; further columns of the input, whatever their names,
are ignored unless asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_text, let, partitions

THRESHOLD = 85
MIN_TOKENS = 4
CELLS = 1 << 17
TIERS = 5  # of counts, for each doubling


def _doc() -> Column:
    """A document's key: its id and a hash of its text, as neither null nor repeated ids name one."""
    return F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("hash"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc, pos, line and its 128-bit key, for all lines."""
    rows = docs.select(_doc().alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc", "pos", "line", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(977), "line", F.length("line")).alias("k2"))


def _tokens(line: Column) -> Column:
    """The lower-case words of a line or text; equal ones, and empty strings between blanks, stay."""
    plain = F.lower(line)
    for blank in "\n\t\x0b\x0c\r":  # a search for each is far cheaper than translate()
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return F.split(plain, " ")


def _words(line: Column) -> Column:
    return F.array_remove(F.array_distinct(_tokens(line)), "")


def _cell(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(CELLS)).cast("int")


def rarity_tiers(texts: DataFrame) -> list[int]:
    """For each cell the logarithm of how often its tokens occur."""
    counted = texts.select(F.explode(_tokens(F.col("text"))).alias("token")).groupBy(_cell(F.xxhash64("token")).alias("cell")).count()
    tiers = [0] * CELLS
    for row in counted.toLocalIterator():
        tiers[row["cell"]] = min(127, int(TIERS * math.log2(row["count"] + 1)))
    return tiers


def _ranked(line: Column, tiers: list[int]) -> Column:
    """The distinct words of a line from the rarest on. A word is its tier and 55 bits of its hash, which
    sort in this order as one integer."""
    table = F.split(F.lit(",".join(map(str, tiers))), ",").cast("array<tinyint>")  # folds to one literal
    hashes = F.array_distinct(F.transform(_tokens(line), lambda t: F.xxhash64(t)))
    keys = F.transform(
        F.array_remove(hashes, F.xxhash64(F.lit(""))),
        lambda h: F.shiftleft(F.get(table, _cell(h)).cast("long"), 55).bitwiseOR(F.shiftrightunsigned(h, 9)))
    return F.sort_array(keys)


def _need(n: Column, m: Column) -> Column:
    """Least overlap of two sets of n and m tokens with the similarity."""
    return F.ceil(THRESHOLD * (n + m) / F.lit(100 + THRESHOLD) - 1e-9)


def distinct_lines(lines: DataFrame, tiers: list[int], scratch: Scratch) -> DataFrame:
    """ord, k1, k2, doc, pos, copies, n, m0, m1, prefix: one row for each distinct line, where it stands
    first, numbered in that order; m0 and m1 are a map of 128 bits with one for each word. Lines of fewer
    than MIN_TOKENS words have neither map nor prefix."""

    def head(w: Column) -> Column:
        n = F.size(w)
        none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        bit = lambda k: F.call_function("shiftleft", one, k.bitwiseAND(63).cast("int"))
        half = lambda j: F.aggregate(w, none, lambda m, k: m.bitwiseOR(F.when(k.bitwiseAND(64) == 64 * j, bit(k)).otherwise(none)))
        maps = [half(0), half(1)]
        return F.struct(n.alias("n"), *[F.when(n >= MIN_TOKENS, m).alias(f"m{j}") for j, m in enumerate(maps)], F.when(n >= MIN_TOKENS, F.slice(w, F.lit(1), n - F.ceil(n * THRESHOLD / 100 - 1e-9).cast("int") + 1)).alias("prefix"))

    rows = lines.select("k1", "k2", F.struct("doc", "pos").alias("at"), let(_ranked(F.col("line"), tiers), head).alias("w"))
    first = rows.groupBy("k1", "k2").agg(F.min("at").alias("at"), F.count("*").alias("copies"), F.any_value("w").alias("w"))
    first = first.select("at.doc", "at.pos", "k1", "k2", "copies", "w.n", "w.m0", "w.m1", "w.prefix")
    ranged = first.repartitionByRange(partitions(lines.sparkSession), "doc", "pos").sortWithinPartitions("doc", "pos")
    return scratch.save(ranged.withColumn("ord", F.monotonically_increasing_id()))


def _verified(pairs: DataFrame, known: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Of pairs ord after x, the later lines of those that are similar."""
    wanted = pairs.select("ord").union(pairs.select("x")).distinct().join(known.select("ord", "doc", "pos"), "ord")
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("pos", "ord")).alias("wanted"))
    found = texts.select(_doc().alias("doc"), F.split("text", "\n").alias("lines")).join(wanted, "doc")
    found = found.select(F.inline(F.transform("wanted", lambda w: F.struct(w["ord"].alias("ord"), F.get("lines", w["pos"]).alias("line")))))
    words = scratch.save(found.select("ord", _words(F.col("line")).alias("words")).dropDuplicates(["ord"]))
    met = pairs.join(words, "ord").join(words.toDF("x", "other"), "x")
    counted = met.select("ord", F.size("words").alias("n"), F.size("other").alias("m"), F.size(F.array_intersect("words", "other")).alias("k"))
    out = scratch.save(counted.where(f"100 * k >= {THRESHOLD} * (n + m - k)").select("ord").distinct())
    scratch.drop(words)
    return out


def similar_later(known: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """ord of the lines whose sets resemble an earlier one."""

    def fits() -> Column:
        """The length, positional and bit map filters: a word whose bit the other set lacks is not shared."""
        sizes = f"100 * least(n, xn) >= {THRESHOLD} * greatest(n, xn)"
        most = "least(n - bit_count(m0 & ~x0) - bit_count(m1 & ~x1), xn - bit_count(x0 & ~m0) - bit_count(x1 & ~m1))"
        need = _need(F.col("n"), F.col("xn"))
        return F.expr(sizes) & (F.least(F.col("n") - F.col("i"), F.col("xn") - F.col("xi")) >= need) & (F.expr(most) >= need)

    def met(rows: DataFrame) -> DataFrame:
        """Pairs that may be similar, from a row for each token that they share in their prefixes: the c
        shared ones up to the last, and all that stands behind it on either side, are enough."""
        both = rows.groupBy("ord", "x", "n", "xn").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("xi").alias("xi"))
        return both.where(F.col("c") + F.least(F.col("n") - F.col("i"), F.col("xn") - F.col("xi")) - 1 >= _need(F.col("n"), F.col("xn")))

    prefixes = known.where("prefix is not null").select("ord", "n", "m0", "m1", F.posexplode("prefix").alias("i", "token"))
    theirs = [F.col(f"lead.{a}").alias(b) for a, b in (("ord", "x"), ("n", "xn"), ("m0", "x0"), ("m1", "x1"), ("i", "xi"))]
    leads = scratch.save(prefixes.groupBy("token").agg(F.min(F.struct("ord", "n", "m0", "m1", "i")).alias("lead"), F.max("ord").alias("last"))
                         .where("lead.ord < last").select("token", *theirs))
    led = met(prefixes.join(leads, "token").where("x < ord").where(fits()))
    tried = scratch.save(led.groupBy("ord").agg(F.max(F.struct("c", "x")).alias("best")).select("ord", "best.x"))
    scratch.drop(leads)
    done = _verified(tried, known, texts, scratch)

    # the shorter set of a pair is looked for by its shorter prefix; pairs of two done ones are not made
    marked = prefixes.join(done.withColumn("done", F.lit(True)), "ord", "left")
    n = F.col("n")
    shorter = marked.where(F.col("i") < n - _need(n, n) + 1).toDF("x", "xn", "x0", "x1", "xi", "token", "x_done")
    pairs = [marked.where("done is null").join(shorter, "token"), marked.where("done").join(shorter.where("x_done is null"), "token")]
    rows = [p.where("(xn < n or xn = n and x < ord) and if(x < ord, done is null, x_done is null)").where(fits()) for p in pairs]
    rows = [r.select(F.greatest("ord", "x").alias("ord"), F.least("ord", "x").alias("x"), *[
        F.expr(f"if(x < ord, {a}, {b})").alias(c) for a, b, c in (("n", "xn", "n"), ("xn", "n", "xn"), ("i", "xi", "i"), ("xi", "i", "xi"))]) for r in rows]
    rest = scratch.save(met(rows[0].union(rows[1])).select("ord", "x").join(tried, ["ord", "x"], "left_anti"))
    more = _verified(rest, known, texts, scratch)
    return done.union(more)


def _numbered(texts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """texts and `copy`, which counts the rows of one text that have no doc_id; 1 for all others."""
    w = Window.partitionBy(F.xxhash64("text")).orderBy("text", *columns)
    return texts.where("doc_id is not null").withColumn("copy", F.lit(1)).union(texts.where("doc_id is null").withColumn("copy", F.row_number().over(w)))


def dedup_lines(docs: DataFrame, columns: tuple[str, ...] = (), short_copies: bool = False) -> DataFrame:
    """doc_id, further columns, text without the removed lines, n_lines and n_removed."""
    least = 1 if short_copies else MIN_TOKENS  # words of a line that is judged
    scratch = Scratch(docs.sparkSession, "lines")
    texts = id_text(docs, columns)
    lines = _lines(texts)
    known = distinct_lines(lines, rarity_tiers(texts), scratch)
    similar = similar_later(known, texts, scratch).select("ord", F.lit(True).alias("similar"))
    judged = known.drop("prefix").join(similar, "ord", "left").where(f"similar or copies > 1 and n >= {least}")
    judged = scratch.save(judged.select("k1", "k2", F.col("doc").alias("fd"), F.col("pos").alias("fp"), "similar"))
    scratch.drop(known)
    out = lines.select("doc", "pos", "k1", "k2").join(judged, ["k1", "k2"]).where("similar or doc <> fd or pos <> fp")
    gone = scratch.save(out.groupBy("doc").agg(F.collect_set("pos").alias("gone")))
    rows = _numbered(texts, columns).withColumn("doc", _doc()).join(gone, "doc", "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x, k: ~F.array_contains("gone", k))
    short, later = F.filter(parts, lambda x: F.size(_words(x)) < least), F.col("copy") > 1
    return rows.select(
        "doc_id", *columns, F.when(later, F.array_join(short, "\n")).when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(parts).cast("long").alias("n_lines"), F.when(later, F.size(parts) - F.size(short)).otherwise(F.coalesce(F.size("gone"), F.lit(0))).cast("long").alias("n_removed"))


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs, short_copies=True).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
