"""Secret scans: fixed patterns, and strings whose sliding windows have high Shannon entropy.

Everything here is a per-row expression: no shuffle, no state between rows, so a lost executor
costs one task's rows and a hot source or copied text changes nothing.

Cases: null text is read as empty and gives no span; ties and repeated rows are judged alike; an
empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, let

# The base patterns and the least length of what they must hold.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters at least
HEX = r"[0-9a-f]{32,}"
#: Strings that the entropy windows slide over: whole runs of token characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Candidates with one of these (in either case) are placeholders, not secrets.
ALLOW = ("example", "sample", "placeholder", "changeme", "dummy", "xxxx", "0123456789", "abcdefgh", "123456789", "your_", "test")
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
WINDOW = 20
#: Character classes: name, members, least bits a character that a window wholly inside needs.
CLASSES = (
    ("hex", "0123456789abcdef", 3.0),
    ("HEX", "0123456789ABCDEF", 3.0),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.7),
    ("base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.9),
)
UNIT = 1_000_000  # entropies are sums of whole millionths, so updates carry no rounding


def weight(count: int) -> int:
    """count * log2(count) in millionths."""
    return round(UNIT * count * math.log2(count)) if count > 1 else 0


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches whose group has `least` characters, as (start, kind, end).

    Matches come without positions; the pieces between them, which a split by the same pattern
    gives, have the lengths from which the positions follow."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    pat = F.lit(pattern)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        kept = F.when(F.length(x["part"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), kept.alias("out")))

    def found(hits: Column) -> Column:
        part = F.regexp_extract_all(text, pat, F.lit(group)) if group else hits
        zipped = F.arrays_zip(hits.alias("hit"), F.split(text, pattern, -1).alias("piece"), part.alias("part"))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(zipped, start, step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, pat, F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(found(hits)))


def _windows(candidate: Column) -> Column:
    """First start and last end (both from 0, end exclusive; -1 for none) of the windows of one
    candidate that reach their class's entropy and hold a digit and a letter.

    The state has a count for each character code, the sum of count * log2(count) and the members of
    each class in the window; a step changes only what the incoming and the outgoing character
    change."""
    weights = F.array(*[F.lit(weight(c)).cast("long") for c in range(WINDOW + 2)])
    whole = weight(WINDOW)
    codes = F.transform(F.sequence(F.lit(1), F.length(candidate)), lambda i: F.ascii(F.substring(candidate, i, F.lit(1))))
    members = [*[m for _, m, _ in CLASSES], "0123456789"]

    def inside(code: Column, chars: str) -> Column:
        return F.when(code.isin([ord(c) for c in chars]), 1).otherwise(0)

    def step(acc: Column, i: Column, codes: Column) -> Column:
        new = F.element_at(codes, i)
        old = F.when(i > WINDOW, F.get(codes, i - WINDOW - 1)).otherwise(F.lit(-1))
        gone = F.transform(acc["counts"], lambda c, k: F.when(k == old, c - 1).otherwise(c))
        out = F.when(old < 0, F.lit(0)).otherwise(F.get(weights, F.get(acc["counts"], old)) - F.get(weights, F.get(acc["counts"], old) - 1))

        def arrive(counts: Column) -> Column:
            had = F.get(counts, new)
            total = acc["total"] - out + F.get(weights, had + 1) - F.get(weights, had)
            now = F.transform(counts, lambda c, k: F.when(k == new, c + 1).otherwise(c))
            held = [acc[f"in{j}"] + inside(new, m) - F.when(old < 0, 0).otherwise(inside(old, m)) for j, m in enumerate(members)]
            enough = F.lit(False)
            for j, (_, _, bits) in enumerate(CLASSES):
                enough = enough | ((held[j] == WINDOW) & (total <= whole - round(bits * WINDOW * UNIT)))
            digits = held[len(CLASSES)]
            hit = (i >= WINDOW) & enough & (digits > 0) & (digits < WINDOW)
            return F.struct(
                now.alias("counts"), total.alias("total"),
                *[h.cast("int").alias(f"in{j}") for j, h in enumerate(held)],
                F.when(hit & (acc["first"] < 0), i - WINDOW).otherwise(acc["first"]).alias("first"),
                F.when(hit, i).otherwise(acc["last"]).alias("last"),
            )

        return let(gone, arrive)

    begin = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0).cast("long").alias("total"),
        *[F.lit(0).alias(f"in{j}") for j in range(len(members))], F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )
    return let(codes, lambda cs: F.aggregate(
        F.sequence(F.lit(1), F.size(cs)), begin, lambda acc, i: step(acc, i, cs),
        lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))


def _entropy_spans(text: Column) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def judged(span: Column) -> Column:
        candidate = F.substring(text, span["start"] + 1, span["end"] - span["start"])

        def one(c: Column) -> Column:
            low = F.lower(c)
            listed = F.rlike(c, F.lit(UUID))
            for word in ALLOW:
                listed = listed | F.contains(low, F.lit(word))
            odd = listed | ~F.rlike(c, F.lit("[0-9]")) | ~F.rlike(c, F.lit("[A-Za-z]"))
            nothing = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))
            return let(F.when(odd, nothing).otherwise(_windows(c)), lambda w: F.struct(
                (span["start"] + w["first"]).alias("start"), F.lit(3).alias("kind"),
                F.when(w["first"] < 0, -1).otherwise(span["start"] + w["last"]).alias("end")))

        return let(candidate, one)

    return let(_spans(text, CANDIDATE, 3), lambda cs: F.when(F.size(cs) == 0, none).otherwise(
        F.filter(F.transform(cs, judged), lambda s: s["end"] >= 0)))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, an array of (start, kind, end) in code points by start and kind.

    Kinds 0 to 2 are the base patterns; 3 are entropy spans, left out where a base span overlaps
    them (it has reported the string already)."""
    rows = id_text(docs)
    text = F.col("text")
    found = rows.select(
        "doc_id", "text",
        _spans(text, ASSIGN, 0, group=2, least=8).alias("assign"),
        _spans(text, ACCESS, 1).alias("access"),
        _spans(text, HEX, 2).alias("hex"),
        _entropy_spans(text).alias("entropy"),
    )
    base = F.concat("assign", "access", "hex")
    fresh = F.filter("entropy", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select("doc_id", F.array_sort(F.concat(base, fresh)).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(docs: DataFrame) -> DataFrame:
    """The query's columns, derived from scan_secrets()."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan_secrets(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"), count(3).alias("n_entropy"),
    )
