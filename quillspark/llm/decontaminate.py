"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Canonical form: runs of digits (with separators), units of measure or currency beside a number, and capitalised words
become placeholders of three types (private code points), the rest is folded to one case. White space stays as it is, so token i of the canonical
text is token i of the text. A second, plain form leaves capitalised words as folded literals, so that copies in another
case match. Templates are compared in windows of WINDOW tokens (a shorter item is one window):

1. Windows of all documents, in both forms, are hashed and joined with the benchmark's (broadcast if its windows fit in
   BROADCAST_BYTES, else by shuffle). A window whose first two tokens begin no window of the benchmark is not made: a bit
   map of these pairs tells, unless the benchmark has more than MAX_LEADS. Windows with fewer than LITERALS literal tokens in the first
   form don't count, unless an item has no other.
2. Matches are gathered on alignments (document position minus item position). Candidates are each alignment alone, the
   alignments of one passage (shifts that follow within GAP tokens) and all alignments of a document and item; together
   they give each window of the item once, to the longest. A candidate counts if it holds at least COVERAGE of the
   item's windows or of the tokens in them, or RUN tokens in a row: inserted and dropped words, and quotations of a
   part of a long item, leave the rest in place.
3. Slot consistency: over the aligned tokens each value of the item must stand for one value of the document; two
   values may be drawn alike. Re-parameterised copies pass, chance mixtures of templates fail.

The result has a row for each contaminated (doc_id, item_id). Null or empty texts, null ids and empty tables give no row;
repeated rows count once. Tokens are [^\\x20\\x09-\\x0D]+ of whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import _common as C

WINDOW, LITERALS, COVERAGE, RUN, GAP = 8, 3, 0.5, 40, 32
BROADCAST_BYTES = 32 << 20
#: Pairs of leading tokens that a bit map may hold, at 64 bits a pair.
MAX_LEADS = 200_000

#: Units that may stand beside a number.
UNITS = "kg|mg|g|lbs?|oz|km|cm|mm|m|mi|miles?|ft|feet|inch(?:es)?|in|yd|ml|cl|l|litres?|liters?|hours?|hrs?|h|minutes?|mins?|min|seconds?|secs?|s|days?|weeks?|months?|years?|usd|eur|gbp|dollars?|euros?|pounds?|cents?|percent|mph|kmh|kph|°c|°f|%"
#: Placeholders of numbers, names and units.
NUM, NAME, UNIT = "\ue000", "\ue001", "\ue002"
NUMBER = r"\d+(?:[.,:/]\d+)*"
BLANK = r"[\x20\x09-\x0D]"


def _fold(text: Column) -> Column:
    """One case for all letters: ß is SS in capitals, and σ has two small forms. Most texts have neither."""
    swapped = lambda t, a, b: F.when(F.contains(t, F.lit(a)), F.replace(t, F.lit(a), F.lit(b))).otherwise(t)
    return _let(F.lower(text), lambda low: _let(swapped(low, "ß", "ss"), lambda t: swapped(t, "ς", "σ")))


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def _typed(text: Column) -> Column:
    """Placeholders in place of numbers and units."""
    t = F.regexp_replace(text, NUMBER, NUM)
    t = F.regexp_replace(t, rf"(?i)({NUM}{BLANK}*)(?:{UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}")
    return F.regexp_replace(t, rf"[$€£](?={NUM})", UNIT)


def _named(text: Column) -> Column:
    return F.regexp_replace(text, r"(?=\p{Lu})(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", NAME)


def canonical(text: Column) -> Column:
    """Typed placeholders in place of numbers, units and names; white space untouched."""
    return _fold(_named(_typed(text)))


def plain(text: Column) -> Column:
    """The canonical form with names left as words: alike for every case of a text."""
    return _fold(_typed(text))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{BLANK}+"), "")


def windows(hashes: Column, size: int) -> Column:
    """Hashes of the windows of the given size, by position: a window joins two halves, or a shorter one and a token."""
    joined = lambda a, b, shift: F.zip_with(a, F.slice(b, F.lit(shift + 1), F.size(b)), lambda x, y: F.xxhash64(x, y))

    def of(k: int, h: Column) -> Column:
        if k == 1:
            return h
        if k % 2:
            return _let(of(k - 1, h), lambda w: joined(w, h, k - 1))
        return _let(of(k // 2, h), lambda w: joined(w, w, k // 2))

    last = F.size(hashes) - size
    return F.when(last >= 0, F.slice(of(size, hashes), F.lit(1), F.greatest(last + 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def window_at(hashes: Column, i: Column, size: int) -> Column:
    """The hash of the one window that starts at position i (from 0), as windows gives it."""

    def of(k: int, shift: int) -> Column:
        if k == 1:
            return F.get(hashes, i + shift)
        a = k - 1 if k % 2 else k // 2
        return F.xxhash64(of(a, shift), of(k - a, shift + a))

    return of(size, 0)


def bit_map(values: list[int]) -> tuple[str, int]:
    """A map of 64-bit hashes as a list of words in text, and the number of its bits as a power of two."""
    bits = max(12, (64 * max(1, len(values)) - 1).bit_length())
    words: dict[int, int] = {}
    for v in values:
        v &= (1 << 64) - 1
        place = v >> (70 - bits)
        words[place] = words.get(place, 0) | 1 << (v & 63)
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    return ",".join(str(signed(words.get(i, 0))) for i in range(1 << (bits - 6))), bits


def _hits(hashes: Column, size: int, held: tuple[str, int]) -> Column:
    """(pos, key) of the windows whose leading tokens are in the bit map."""
    text, bits = held
    words = F.split(F.lit(text), ",").cast("array<bigint>")  # folded to a constant

    def there(x: Column) -> Column:
        return F.getbit(F.get(words, F.shiftrightunsigned(x, 70 - bits).cast("int")), x.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1

    places = F.sequence(F.lit(0), F.size(hashes) - size)
    leads = F.zip_with(hashes, F.slice(hashes, F.lit(2), F.size(hashes)), lambda x, y: F.xxhash64(x, y)) if size > 1 else hashes
    kept = _let(leads, lambda p: F.filter(places, lambda i: there(F.get(p, i))))
    return F.transform(kept, lambda i: F.struct(i.alias("pos"), window_at(hashes, i, size).alias("key")))


def _hashes(tok: Column) -> Column:
    return F.transform(tok, lambda x: F.xxhash64(x))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(key, lead, item_id, bpos, n_windows, n_tokens, size): the windows that count, of every item, in one or both forms."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null").distinct()
    t = items.select("item_id", tokens(canonical(F.col("text"))).alias("tok"), tokens(plain(F.col("text"))).alias("low")).filter(F.size("tok") > 0)
    size = F.least(F.lit(WINDOW), F.size("tok"))
    of_size = lambda c: F.coalesce(*[F.when(F.col("size") == s, windows(F.col(c), s)) for s in range(1, WINDOW + 1)])
    t = t.withColumn("size", size).withColumn("h", _hashes(F.col("tok"))).withColumn("g", _hashes(F.col("low"))).withColumn("wh", of_size("h")).withColumn("wg", of_size("g"))
    rows = t.select(
        "item_id",
        "size",
        F.posexplode(F.expr("transform(sequence(1, size(tok) - size + 1), i -> struct(array_distinct(array(struct(wh[i - 1] as key, if(size > 1, xxhash64(h[i - 1], h[i]), h[i - 1]) as lead), struct(wg[i - 1] as key, if(size > 1, xxhash64(g[i - 1], g[i]), g[i - 1]) as lead))) as keys, size(filter(slice(tok, i, size), x -> x = translate(x, '%s', ''))) as literals))" % (NUM + NAME + UNIT))).alias("bpos", "w"),
    ).select("item_id", "size", "bpos", F.col("w.keys").alias("keys"), (F.col("w.literals") >= F.least(F.lit(LITERALS), F.col("size"))).alias("counts"))
    some = rows.groupBy("item_id").agg(F.max("counts").alias("any"), F.sum(F.col("counts").cast("int")).alias("n_good"), F.count("*").alias("n_all"))
    rows = rows.join(some, "item_id").filter("counts or not any")
    inside = rows.groupBy("item_id").agg(F.expr("size(array_distinct(flatten(collect_list(sequence(bpos, bpos + size - 1)))))").alias("n_tokens"))
    rows = rows.join(inside, "item_id")
    rows = rows.withColumn("k", F.explode("keys"))
    return rows.select("k.key", "k.lead", "item_id", "bpos", "size", F.when(F.col("any"), F.col("n_good")).otherwise(F.col("n_all")).alias("n_windows"), "n_tokens")


def _sets(lined: DataFrame) -> DataFrame:
    """Candidates: (doc_id, item_id, n_windows, n_tokens, size, lines), lines being (shift, at) that share no window of the item."""
    keys = ["doc_id", "item_id", "n_windows", "n_tokens", "size"]
    single = lined.select(*keys, F.array(F.struct("shift", "at")).alias("lines"))
    by_shift = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    leap = F.coalesce((F.col("shift") - F.lag("shift").over(by_shift) > GAP).cast("int"), F.lit(0))
    placed = lined.withColumn("leap", leap).withColumn("passage", F.sum("leap").over(by_shift))
    line = F.collect_list(F.struct(F.size("at").alias("n"), "shift", "at")).alias("found")
    passages = placed.groupBy(*keys, "passage").agg(line).filter(F.size("found") > 1).drop("passage")
    whole = placed.groupBy(*keys).agg(line, F.max("passage").alias("last")).filter("last > 0").drop("last")
    # the longest alignment first; the others add the windows that are still missing
    took = """aggregate(sort_array(found, false), struct(cast(array() as array<int>) as seen, cast(array() as array<struct<shift:int,at:array<int>>>) as kept),
        (a, l) -> transform(array(array_except(l.at, a.seen)), f -> if(size(f) = 0, a, struct(concat(a.seen, f) as seen, concat(a.kept, array(struct(l.shift as shift, f as at))) as kept)))[0], a -> a.kept)"""
    several = passages.union(whole).select(*keys, F.expr(took).alias("lines")).filter(F.size("lines") > 1)
    return single.union(several)


def _enough(sets: DataFrame) -> DataFrame:
    """The candidates that hold enough of their item, with n_matched."""
    covered = "size(array_distinct(flatten(transform(flatten(lines.at), b -> sequence(b, b + size - 1)))))"
    run = """array_max(transform(lines, l -> aggregate(array_sort(l.at), struct(l.at[0] as start, -1 as last, 0 as best),
        (r, b) -> transform(array(if(r.last < 0 or b - r.last > size, b, r.start)), f -> struct(f as start, b as last, greatest(r.best, b + size - f) as best))[0], r -> r.best)))"""
    sets = sets.withColumn("n_matched", F.expr("size(flatten(lines.at))"))
    return sets.filter((F.col("n_matched") >= F.col("n_windows") * F.lit(COVERAGE)) | (F.expr(covered) >= F.col("n_tokens") * F.lit(COVERAGE)) | (F.expr(run) >= RUN))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, exact (no slot differs)."""
    spark = C.tune(docs.sparkSession)
    bench = C.stage(item_windows(benchmark))
    leads = bench.select("size", "lead").distinct()
    sizes = {r["size"]: r["n"] for r in leads.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most WINDOW values
    maps = {s: bit_map([r["lead"] for r in leads.filter(F.col("size") == s).select("lead").collect()]) for s, n in sizes.items() if n <= MAX_LEADS}
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    # the typed text is made once for both forms
    forms = F.transform(F.array(_typed(F.col("text"))), lambda t: F.array(_hashes(tokens(_fold(_named(t)))), _hashes(tokens(_fold(t)))))
    # exploding the one row of forms makes them columns of a plan node: a filter on their size is not computed from the text
    hashed = slim.select("doc_id", F.explode(forms).alias("forms")).select("doc_id", F.col("forms")[0].alias("h"), F.col("forms")[1].alias("g"))
    per_size = []
    for s in sorted(sizes):
        long = hashed.filter(F.size("h") >= s)
        if s in maps:
            # the plain form gives only the windows that differ
            other = F.filter(_hits(F.col("g"), s, maps[s]), lambda w: w["key"] != window_at(F.col("h"), w["pos"], s))  # noqa: B023  called at once
            found = long.select("doc_id", F.explode(F.concat(_hits(F.col("h"), s, maps[s]), other)).alias("w"))
            per_size.append(found.select("doc_id", "w.pos", "w.key", F.lit(s).alias("size")))
            continue
        keys = F.transform(F.array(windows(F.col("h"), s)), lambda w: F.concat(w, F.zip_with(windows(F.col("g"), s), w, lambda a, b: F.when(a != b, a))))[0]  # noqa: B023  called at once
        both = long.select("doc_id", (F.size("h") - s + 1).alias("n"), F.posexplode(keys).alias("at", "key"))
        per_size.append(both.filter("key is not null").select("doc_id", F.expr("at % n").alias("pos"), "key", F.lit(s).alias("size")))
    if not per_size:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, n_matched bigint, n_windows bigint, exact boolean")
    wide = per_size[0]
    for more in per_size[1:]:
        wide = wide.union(more)
    n = bench.count()
    keys = bench.drop("lead").withColumnRenamed("size", "bsize")
    side = F.broadcast(keys) if n * 48 <= BROADCAST_BYTES else keys
    hits = wide.join(side, (wide["key"] == keys["key"]) & (wide["size"] == keys["bsize"])).select("doc_id", "item_id", "bpos", (F.col("pos") - F.col("bpos")).alias("shift"), "n_windows", "n_tokens", "bsize")
    # repeated rows of a document give the same matches again: distinct positions count
    lined = C.stage(hits.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("bpos").alias("at"), F.first("n_windows").alias("n_windows"), F.first("n_tokens").alias("n_tokens"), F.first("bsize").alias("size")))
    candidates = C.stage(_enough(_sets(lined)).withColumn("lines", F.expr("transform(lines, l -> struct(l.shift as shift, l.at as at, array_min(l.at) as low, array_max(l.at) + size - array_min(l.at) as span))")))
    # a document meets all its alignments at once, and each keeps only the tokens that it covers
    asked = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "lines", "n_windows", "size", "n_matched")).alias("all"))
    few = candidates.select("doc_id").distinct()
    wanted = F.broadcast(few) if few.count() * 16 <= BROADCAST_BYTES else few
    raw_docs = slim.join(wanted, "doc_id", "left_semi").distinct().select("doc_id", tokens(F.col("text")).alias("dtok"))
    inside = "forall(c.lines, l -> l.shift + l.low >= 0 and l.shift + l.low + l.span <= size(dtok))"
    pieces = asked.join(raw_docs, "doc_id").withColumn("all", F.expr(f"transform(filter(all, c -> {inside}), c -> struct(c as c, transform(c.lines, l -> struct(l.at as at, l.low as low, slice(dtok, l.shift + l.low + 1, l.span) as seg)) as parts))"))
    aligned = pieces.select("doc_id", F.explode("all").alias("x")).select("doc_id", "x.c.item_id", "x.c.n_windows", "x.c.size", "x.c.n_matched", "x.parts")
    raw_items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), tokens(F.col("text").cast("string")).alias("btok")).distinct()
    if int(benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 64)).first()[0] or 0) <= BROADCAST_BYTES // 4:
        raw_items = F.broadcast(raw_items)  # by the bytes of its texts; tokens and array slots take a few times as much
    strip = "regexp_replace(x, '^[^\\\\p{L}\\\\p{N}]+|[^\\\\p{L}\\\\p{N}]+$', '')"
    aligned = aligned.join(raw_items, "item_id").withColumn("pairs", F.expr("array_distinct(flatten(transform(parts, l -> transform(array_distinct(flatten(transform(l.at, b -> sequence(b, b + size - 1)))), i -> struct(btok[i] as b, l.seg[i - l.low] as d)))))"))
    aligned = aligned.withColumn("slots", F.expr(f"array_distinct(transform(pairs, p -> struct(transform(array(p.b), x -> {strip})[0] as b, transform(array(p.d), x -> {strip})[0] as d)))"))
    # tokens that differ in case alone stand for themselves
    low_b, low_d = (f"translate(replace(lower(s.{c}), 'ß', 'ss'), 'ς', 'σ')" for c in "bd")
    aligned = aligned.withColumn("slots", F.expr(f"array_distinct(transform(slots, s -> if({low_b} = {low_d}, struct({low_b} as b, {low_d} as d), s)))"))
    consistent = F.size(F.array_distinct(F.col("slots.b"))) == F.size("slots")
    sound = aligned.filter(consistent).withColumn("exact", F.forall("slots", lambda s: s["b"] == s["d"]))
    return sound.groupBy("doc_id", "item_id").agg(F.max("n_matched").cast("bigint").alias("n_matched"), F.max("n_windows").cast("bigint").alias("n_windows"), F.max("exact").alias("exact"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they were; rows with a null doc_id stay."""
    bad = C.stage(contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct())
    side = F.broadcast(bad) if bad.count() * 16 <= BROADCAST_BYTES else bad
    return docs.join(side, docs["doc_id"] == side["_bad"], "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
