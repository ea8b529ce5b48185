"""Line deduplication by an exact set-similarity join. DataFrame functions only.

A line is the set of its words. Words are ordered by rarity (a count of all words of the corpus, in ``SKETCH`` hashed
counters), ties by hash; a word is its rarity and 55 bits of its hash. A line goes if a line before it (by id, row, number) is
as similar as ``t``, whether that one goes or not.

Prefix filter on runs of words: let two sets of n1 and n2 words share ``o``, so that a = n1 - o and b = n2 - o words are not
shared. In rarity order, each of those a + b words parts at most one pair of neighbouring shared words. Among the first
r * (a + b + 1) such gaps, r in a row are whole: r + 1 shared words that are neighbours in both sets. They end at place
r * (a + b + 1) + 1 + a at most, which is (r + 1) * (1 - t) * n + r + 1 at most where the Jaccard similarity is ``t`` or more.
So similar lines have a run of r + 1 words of their prefixes of that length in common. With r = 1 (pairs), such a run is rarely
shared by chance, and most runs occur once in the corpus.

Runs are counted by an aggregation, in ``SLICES`` passes, so that a part of them is on disk at a time. A line has parities: of its
words in 53 classes, or in 106 if it is long, which differ in no more places than the sets in words. Of two or
three lines that share a run by chance none become a pair. Lines of more common runs are held against the first line of the run, if
parities allow it, then those without a match against all others of the run. Whole sets decide.

A run in more than ``CROWD`` lines is crowded: lines with such a run meet by longer runs (r = 2, 3), which exist for every
similar pair. What is crowded even then, and what is too small for them, asks by a semi join whether an earlier line of the run
is similar by its whole set: pairs are no rows, and a line stops at its first match. Spark splits such a join.

Equal sets meet by a partial aggregation first, so a line that a third of all documents share is one row.

Defined results: null text has no lines and stays null; lines without a word take no part and stay; null ids come last;
rows of one id are documents of their own, in the order in which they are read, the later ones lose their lines; an empty
table gives an empty result; columns beside id and text are not read, ``clean`` passes them through.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered

SKETCH = 1 << 16
#: White space inside a line, but for the blank.
BLANKS = "\t\x0b\x0c\r"
#: Up to so many names of lines or runs are sent to all tasks and texts stay where they are; beyond, both are shuffled.
NAMED = 500_000
#: A run of words in more lines than this is crowded.
CROWD = 64
#: Passes over the runs; each holds a part of them in its shuffle.
SLICES = 3
#: Low bits of a line's second parities hold its size, up to this.
SIZES = (1 << 11) - 1
#: Sets of more words than this have second parities.
WIDE = 64
#: About so many runs are one task's.
RUNS_A_TASK = 500_000
#: Words between two shared ones: the lengths of runs, less one, that are tried in turn.
RUNS = (1, 2, 3)


def plain(text: Column) -> Column:
    """The text with a blank for every white space of a line; most texts have no other."""
    odd = text.contains(BLANKS[0])
    for c in BLANKS[1:]:
        odd = odd | text.contains(c)
    return F.when(odd, F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)


def rarity_table(docs: DataFrame) -> Column:
    """An array constant of ``SKETCH`` counters: four times the log2 of the occurrences of the words hashed to each."""
    words = docs.select(F.explode(F.split(F.replace(plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w != ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(SKETCH - 1)).alias("c")).count()
    table = [0] * SKETCH
    for r in counts.select("c", F.least(F.floor(4 * F.log2("count")), F.lit(255)).alias("q")).collect():  # SKETCH rows at most
        table[r["c"]] = r["q"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")


def keyed_lines(docs: DataFrame, rarity: Column) -> DataFrame:
    """The columns of ``docs`` but its text, number, keys (rarest first) and n of each line with a word."""
    others = [c for c in docs.columns if c != "text"]
    lines = docs.select(*others, F.posexplode(F.split(plain(F.col("text")), "\n")).alias("number", "line")).filter(F.trim("line") != "")
    mask, zero = F.lit(SKETCH - 1).cast("long"), F.lit(0).cast("long")
    # Never null, so that arrays are sorted as plain longs. Words of one key are one word from here on. Each word is hashed once.
    key = lambda h: F.shiftleft(F.coalesce(F.get(rarity, h.bitwiseAND(mask).cast("int")), zero), 55).bitwiseOR(F.shiftrightunsigned(h, 9))
    hashes = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    keys = F.array_remove(F.array_distinct(F.transform(hashes, key)), key(F.xxhash64(F.lit(""))))
    return lines.select(*others, "number", F.sort_array(keys).alias("keys")).withColumn("n", F.size("keys"))


def prefix_length(n: Column, r: int, t: float) -> Column:
    """Within so many of the rarest words of a set of ``n`` ends a run of r + 1 that a similar set shares."""
    return F.least(n, (F.floor((r + 1) * (1 - t) * n + 1e-9) + r + 1).cast("int"))


def least_size(r: int, t: float) -> int:
    """Two similar sets of so many words or more have such runs (both have o >= r * (a + b + 1) + 1)."""
    slope = t - r * (1 - t)
    return math.ceil((r + 1) * (1 + t) / slope / 2 - 1e-9) if slope > 1e-9 else 1 << 30


def runs(sets: DataFrame, words: str, r: int, t: float, part: int | None = None) -> DataFrame:
    """key, unit and parities p, q of each run of r + 1 neighbours in the prefix of each set; ``words`` holds hashes, rarest first.

    ``part``: only the runs of that slice of their first words.
    """
    last = prefix_length(F.col("n"), r, t)
    at = sets.select("unit", "n", "p", "q", words, F.posexplode(F.slice(words, 1, last)).alias("i", "w"))
    if part is not None:
        at = at.filter(F.pmod("w", F.lit(SLICES)) == part)
    others = [F.get(words, F.col("i") + k) for k in range(1, r + 1)]
    return at.filter(F.col("i") + r < last).select(F.xxhash64("w", *others).alias("key"), "unit", "p", "q")


def fits(n1: Column, n2: Column, t: float) -> Column:
    return (n1 >= t * n2 - 1e-9) & (n2 >= t * n1 - 1e-9)


def size_of(q: Column) -> Column:
    return q.bitwiseAND(F.lit(SIZES).cast("long"))


def apart(total: Column, t: float) -> Column:
    """In how many words similar sets of so many words together differ, at most."""
    return total - 2 * F.ceil(t / (1 + t) * total - 1e-9)


def with_parities(lines: DataFrame) -> DataFrame:
    """``lines`` with p: parities of the words in 53 classes; q: of those with an odd key alone, for sets over ``WIDE``, and the size, ``SIZES`` at most.

    So two wide sets have 106 classes: those of q, and those of p without q.
    """
    zero, one, low = (F.lit(x).cast("long") for x in (0, 1, SIZES))
    class_of = lambda k: F.shiftright(k, 1).bitwiseAND(F.lit(63).cast("long")).cast("int")
    folded = lambda c: F.col(c).bitwiseXOR(F.col(c).bitwiseAND(low)).bitwiseXOR(F.shiftleft(F.col(c).bitwiseAND(low), 11))  # noqa: E731 (64 classes to 53)
    p = F.aggregate("keys", zero, lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", one, class_of(k))))
    q = F.aggregate("keys", zero, lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", k.bitwiseAND(one), class_of(k))))
    raw = lines.withColumns({"p": p, "q": F.when(F.col("n") > WIDE, q).otherwise(zero)})
    return raw.withColumns({"p": folded("p"), "q": folded("q").bitwiseOR(F.least("n", F.lit(SIZES)).cast("long"))})


def differences(p: Column, q: Column, wide: Column) -> Column:
    """In how many classes two lines differ, by the exclusive or of their parities; ``wide``: both are."""
    odd = F.shiftrightunsigned(q, 11)
    return F.when(wide, F.bit_count(odd) + F.bit_count(F.shiftrightunsigned(p, 11).bitwiseXOR(odd))).otherwise(F.bit_count(p))


def near(p1: Column, q1: Column, p2: Column, q2: Column, t: float) -> Column:
    """Whether two lines may be similar, as far as sizes and parities tell."""
    n, m = size_of(q1), size_of(q2)
    may = fits(n, m, t) & (differences(p1.bitwiseXOR(p2), q1.bitwiseXOR(q2), (n > WIDE) & (m > WIDE)) <= apart(n + m, t))
    return may | (n == SIZES) | (m == SIZES)


def sent(names: DataFrame) -> DataFrame:
    """Written names: sent to all tasks if they are few, else joined by a shuffle."""
    return F.broadcast(names) if names.count() <= NAMED else names


def alike(w: str, v: str, t: float) -> Column:
    """Whether two whole sets reach ``t``."""
    n, m, common = F.size(w), F.size(v), F.size(F.array_intersect(w, v))
    return fits(n, m, t) & (common >= t * (n + m - common) - 1e-9)


def similar(pairs: DataFrame, keyed: DataFrame, t: float) -> DataFrame:
    """unit of the later line of each pair (unit, earlier; written) whose whole sets reach ``t``, written; ``keyed``: unit, keys."""
    pairs = sent(pairs)
    x = keyed.select("unit", F.col("keys").alias("w")).join(pairs, "unit")
    y = keyed.select(F.col("unit").alias("earlier"), F.col("keys").alias("v")).join(pairs, "earlier")
    return materialise(x.join(y, ["unit", "earlier"]).filter(alike("w", "v", t)).select("unit").distinct(), "line-found")


def place_of(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` with null ids last, and a line's place in the order: its document's id, then its number; unique to the line.

    One long where ids do not repeat and id and number fit, as they nearly always do; else a decimal of the id and the line's
    number among all lines. Either is a value that a hash aggregation can take the least of.
    """
    r = docs.agg(F.count("*").alias("n"), F.count("id").alias("some"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"), F.max("n_lines").alias("most")).first()
    bits = int(r["most"] or 0).bit_length()
    last = (r["high"] or 0) + 1
    if r["some"] == r["ids"] and r["n"] - r["some"] <= 1 and (r["low"] is None or r["low"] >= 0) and last.bit_length() + bits <= 62:
        return docs.withColumn("id", F.coalesce("id", F.lit(last))), F.shiftleft(F.col("id"), bits).bitwiseOR(F.col("number").cast("long"))
    wide = "decimal(38,0)"
    id_ = F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return docs, ((id_ * F.lit(str(1 << 62)).cast("decimal(19,0)")).cast(wide) + F.col("line").cast("decimal(19,0)")).cast(wide)


def duplicate_lines(docs: DataFrame, t: float = 0.8) -> DataFrame:
    """row and number of every line that goes; ``docs``: row, id, text, n_lines, written (see ``numbered``).

    The least place of the lines with a set names its unit. ``t`` is over 3/4.
    """
    if not 0.75 < t <= 1:
        raise ValueError("t must be over 0.75 and at most 1")
    rarity = rarity_table(docs)
    texts, place = place_of(docs)
    # Only equality of prefix words matters from here on: 32 bits of each will do, a chance match fails a later test.
    prefix = F.transform(F.slice("keys", 1, prefix_length(F.col("n"), RUNS[0], t)), lambda k: F.hash(k))
    lines = with_parities(keyed_lines(texts.select("row", "id", "text"), rarity)).withColumn("line", F.monotonically_increasing_id())
    lines = materialise(lines.select("row", "number", place.alias("unit"), "n", F.xxhash64("keys").alias("hash"), "p", "q", prefix.alias("prefix")), "line-sets")
    units = materialise(lines.groupBy("n", "hash", "prefix").agg(F.min("unit").alias("unit"), F.min("p").alias("p"), F.min("q").alias("q")).select("unit", "n", "p", "q", "prefix"), "line-units")

    def sets(named: DataFrame) -> DataFrame:
        """unit, keys and n of the named units, from the texts."""
        named = materialise(named.distinct(), "line-named")
        names = sent(named)
        at = lines.select("unit", "row", "number").join(names, "unit")
        wanted = at.groupBy("row").agg(F.collect_list(F.struct("number", "unit")).alias("named"))
        own = docs.select("row", "text").join(F.broadcast(wanted) if names is not named else wanted, "row")
        parts = own.select(F.explode("named").alias("x"), F.split("text", "\n").alias("parts")).select("x.unit", F.get("parts", F.col("x.number")).alias("text"))
        return materialise(keyed_lines(parts, rarity).select("unit", "keys", "n"), "line-keys")

    def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        """Rows whose line found no match yet."""
        return rows.join(sent(gone), "unit", "left_anti")

    p, q, ep, eq = (F.col(c) for c in ("p", "q", "ep", "eq"))
    led = (F.col("unit") != F.col("head")) & near(p, q, ep, eq, t)

    def shared(rows: DataFrame) -> DataFrame:
        """Lines of runs of two or more, with how many have it (c), the first of them (head) and its parities (ep, eq), written.

        Of two or three lines, only those that may be similar to another; the third's parities follow from those of all.
        The runs are shuffled once, for the aggregation and the join.
        """
        rows = rows.repartition(tasks, "key")
        by = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("unit").alias("head"), F.min_by("p", "unit").alias("ep"), F.min_by("q", "unit").alias("eq"), F.bit_xor("p").alias("xp"), F.bit_xor("q").alias("xq"))
        x, y = rows.alias("x"), by.filter("c > 1").alias("y").hint("shuffle_hash")
        third = (F.col("c") == 3) & (F.col("unit") != F.col("head")) & near(p, q, F.col("xp").bitwiseXOR(p).bitwiseXOR(ep), F.col("xq").bitwiseXOR(q).bitwiseXOR(eq), t)
        kept = (F.col("c") > CROWD) | (F.col("c") > 3) & (F.col("unit") != F.col("head")) | led | third
        return materialise(x.join(y, (F.col("x.key") == F.col("y.key")) & kept).select("x.key", "unit", "p", "q", "c", "head", "ep", "eq"), "line-runs")

    def earlier_than(others: DataFrame, *more: str) -> DataFrame:
        return others.select("key", F.col("unit").alias("earlier"), F.col("p").alias("ep"), F.col("q").alias("eq"), *more)

    before = (F.col("earlier") < F.col("unit")) & near(p, q, ep, eq, t)
    gone, keyed = None, None
    source, words = units.filter("n >= 4"), "prefix"  # smaller sets have no similar set but themselves
    most = source.agg(F.sum(prefix_length(F.col("n"), RUNS[0], t))).first()[0] or 0
    tasks = max(1, math.ceil(most / SLICES / RUNS_A_TASK))
    for r in RUNS:
        parts = range(SLICES) if r == RUNS[0] else [None]
        found = reduce(DataFrame.union, [shared(runs(source, words, r, t, part)) for part in parts])
        members = found.filter(F.col("c").between(3, CROWD)).drop("ep", "eq")
        crowd = found.filter(F.col("c") > CROWD).drop("ep", "eq")
        crowded = crowd.head() is not None
        first = found.filter(led).select("unit", F.col("head").alias("earlier")).distinct()
        first = materialise(first if gone is None else without(first, gone), "line-pairs")
        if keyed is None:
            named = first.select("unit").union(first.select("earlier"))
            keyed = sets(named.union(crowd.select("unit")) if crowded else named)
        found = similar(first, keyed, t)
        gone = found if gone is None else materialise(gone.union(found), "line-gone")
        others = without(members, gone).join(earlier_than(members), "key").filter(before).select("unit", "earlier").distinct()
        others = materialise(others.join(first, ["unit", "earlier"], "left_anti"), "line-pairs")
        if others.head() is not None:
            more = sets(others.select("unit").union(others.select("earlier"))) if r == RUNS[0] else keyed
            gone = materialise(gone.union(similar(others, more, t)), "line-gone")
        if not crowded:
            break
        # Those too small for longer runs, or all if there are no longer ones.
        small = least_size(r + 1, t) if r != RUNS[-1] else None
        # Only sets of crowded lines go on, and only those that may meet here are shuffled.
        source, words = keyed.join(sent(materialise(crowd.select("unit", "p", "q").distinct(), "line-crowd")), "unit"), "keys"
        pool, own = (x if small is None else x.filter(size_of(F.col("q")) < small / t) for x in (crowd, source))
        whole = pool.join(own.select("unit", "keys"), "unit")
        match = (F.col("x.key") == F.col("y.key")) & before & alike("x.keys", "y.v", t)
        held = without(whole, gone).alias("x").join(earlier_than(whole, F.col("keys").alias("v")).alias("y"), match, "left_semi")
        gone = materialise(gone.union(held.select("unit").distinct()), "line-gone")
    kept = units.select("unit").join(gone, "unit", "left_anti")
    return lines.select("unit", "row", "number").join(kept, "unit", "left_anti").select("row", "number")


def removed_lines(docs: DataFrame, t: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, in order): one row for each row of ``docs``."""
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    rows, row = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("n_lines", n_lines), "row")
    per = duplicate_lines(rows, t).groupBy(row).agg(F.sort_array(F.collect_list("number")).alias("removed"))
    out = rows.select(row, "id", "n_lines").join(per, row, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return out.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def clean(docs: DataFrame, t: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``; every row and column stays."""
    keep = docs.columns
    own, row = numbered(docs)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    rows = own.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("n_lines", n_lines)
    gone = duplicate_lines(rows, t).groupBy("row").agg(F.collect_set("number").alias("gone"))
    x, y = own.alias("x"), gone.alias("y")
    parts = F.filter(F.split("x.text", "\n"), lambda _x, i: ~F.array_contains("y.gone", i))
    text = F.when(F.col("y.gone").isNull(), F.col("x.text")).otherwise(F.array_join(parts, "\n"))
    return x.join(y, F.col(f"x.{row}") == F.col("y.row"), "left").select(*[text.alias(c) if c.lower() == "text" else F.col(f"x.`{c}`") for c in keep])
