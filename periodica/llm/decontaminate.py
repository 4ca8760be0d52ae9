"""Benchmark decontamination by templates, with DataFrame and SQL functions only.

A text becomes a sequence of tokens; numbers, names and units become typed placeholders. Windows of this
template are joined by hash with those of the benchmark, and the values behind the placeholders must
map one to one along the match, or clash little against what agrees: the same question with other numbers or names is caught, a chance match
of the template is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe, one_row_each, table, without_rows

#: Units and number words.
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years l ml liter liters litre litres gallon gallons dollar dollars euro euros cent cents usd eur gbp percent degree degrees celsius fahrenheit kmh mph".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
TOKEN = r"[0-9]+(?:[.,:][0-9]+)*|[\p{L}\p{M}]+"
#: Tokens of a window; a window with at least so many that are no placeholders is evidence by itself; the benchmark's windows are broadcast up to so many.
WINDOW, LITERALS, BROADCAST = 10, 5, 200_000
#: Tokens of an item whose windows, all found, are evidence together; tokens of a stretch that counts whatever clashes outside it; literal tokens that make up for a clash of numbers.
WHOLE, STRETCH, CLASH = 5, 13, 2


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def template(words: Column, names: bool = True) -> Column:
    """Each token's lower case or placeholder. A word of a capital and small letters counts as a name, also where a sentence begins: its value is compared then. Without `names` only numbers and units have placeholders."""

    def place(x: Column) -> Column:
        low = F.lower(x)
        kind = F.when(x.rlike("^[0-9]") | low.isin(NUMBERS), "\x01number").when(low.isin(UNITS), "\x01unit")
        return (kind.when(x.rlike(r"^\p{Lu}\p{Ll}"), "\x01name") if names else kind).otherwise(low)

    return F.transform(words, place)


def _windows(length: int) -> Column:
    """Hashes of all windows of `length` tokens of k, token hashes, by position. Elements are read one by one: slice() copies its whole array first."""
    count = F.size("k") - (length - 1)
    found = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(F.col("k"), i + n) for n in range(length)]))
    return F.when(count > 0, found).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, j, length, h, values, shape, literals, size of every window with a literal token; a short item is one window of its own length."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.coalesce("text", F.lit(""))).alias("w"))
    items = items.withColumn("t", template(F.col("w"))).where("size(w) > 0")
    items = items.withColumn("length", F.least(F.size("w"), F.lit(window))).withColumn("k", F.transform("t", lambda x: F.xxhash64(x)))
    hashes = F.coalesce(*[F.when(F.col("length") == n, _windows(n)) for n in range(1, window + 1)])
    items = items.select("item_id", "w", "t", "length", F.size("w").alias("size"), F.posexplode_outer(hashes).alias("j", "h"))
    items = items.withColumn("shape", F.slice(F.col("t"), F.col("j") + 1, F.col("length"))).withColumn("literals", F.size(F.filter("shape", lambda x: ~x.startswith("\x01"))))
    return items.where("literals > 0").select("item_id", "j", "length", "h", F.slice(F.col("w"), F.col("j") + 1, F.col("length")).alias("values"), "shape", "literals", "size")


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """doc_id, item_id, n_windows, verbatim: documents that hold a benchmark item's template with consistent values.

    Evidence at one alignment is a window with `literals` literal tokens (of a short item, all but one), or a window
    without a differing value, or all windows of an item of WHOLE tokens; windows without a literal token are
    not matched. Values must map one to one, but each clash of numbers can be made up for by CLASH more
    literal tokens than `literals`, and a stretch of STRETCH tokens, `literals` of them literal, that holds no
    differing value of a clash counts whatever clashes elsewhere.

    n_windows counts the item's windows found at one alignment; verbatim: no placeholder's value differs.
    Items shorter than a window are matched whole. Null and empty texts match nothing. Rows that repeat a doc_id, or have none, are
    searched and reported each. Very long texts are searched whole. Only doc_id and text are read, so other columns may have any
    names. Empty tables give no rows.
    """
    return _contaminated(one_row_each(documents), benchmark, window, literals).select(F.col("own_id").alias("doc_id"), "item_id", "n_windows", "verbatim")


def _contaminated(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """doc_id (the key), own_id, item_id, n_windows, verbatim for rows (doc_id, own_id, text)."""
    asked = table(benchmark_windows(benchmark, window))
    lengths = [r[0] for r in asked.select("length").distinct().orderBy("length").collect()]  # 1 to `window`
    keys = asked.groupBy("h", "length").agg(F.collect_list(F.struct("item_id", "j")).alias("at"))
    if asked.count() <= BROADCAST:
        keys = F.broadcast(keys)
    words = rows.select("doc_id", F.transform(template(tokens(F.col("text"))), lambda x: F.xxhash64(x)).alias("k"))
    hits = None
    for length in lengths:
        each = words.select("doc_id", _windows(length).alias("hs")).select("doc_id", F.posexplode_outer("hs").alias("i", "h"))  # outer: else a filter on hs is pushed down, with all of hs computed anew per element
        found = each.join(keys.where(F.col("length") == length), "h").select("doc_id", "i", F.lit(length).alias("length"), F.explode("at").alias("at"))
        found = found.select("doc_id", "i", "length", "at.item_id", "at.j")
        hits = found if hits is None else hits.union(found)
    if hits is None:
        return rows.select("doc_id", "own_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(False).alias("verbatim")).limit(0)
    hits = table(hits)
    held = maybe(rows, "doc_id", hits.select("doc_id").distinct()).where("maybe").select("doc_id", "own_id", "text")
    held = hits.select("doc_id", "i", "length").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("i", "length")).alias("at")).join(held, "doc_id")
    # the tokens are bound to a lambda's variable: a column that is named once inside a lambda is computed anew for each element
    seen_at = "transform(ws, w -> transform(at, x -> struct(x.i, x.length, transform(sequence(0, x.length - 1), n -> get(w, x.i + n)) as seen)))[0]"
    held = held.withColumn("ws", F.array(tokens(F.col("text")))).select("doc_id", "own_id", F.expr(seen_at).alias("at"))
    seen = held.select("doc_id", "own_id", F.explode_outer("at").alias("at")).select("doc_id", "own_id", "at.*")  # outer, as above
    pairs = hits.join(seen, ["doc_id", "i", "length"]).join(asked, ["item_id", "j", "length"])
    places = F.expr("transform(arrays_zip(shape, values, seen), (z, n) -> struct(j + n as p, if(z.shape like '\x01%', z.shape, '') as shape, lower(z.values) as a, lower(z.seen) as b))")
    pairs = pairs.select("doc_id", "own_id", "item_id", (F.col("i") - F.col("j")).alias("shift"), "j", "size", "literals", "length", places.alias("places"))
    least = F.least(F.lit(literals), F.col("length") - 1)
    same = F.expr("forall(places, z -> z.shape = '' OR z.a = z.b)")
    pairs = pairs.withColumn("rich", F.col("literals") >= least).withColumn("same", same)
    whole = asked.groupBy("item_id").agg(F.count("*").alias("all"))
    matched = pairs.groupBy("doc_id", "own_id", "item_id", "shift").agg(
        F.countDistinct("j").alias("n_windows"), F.max("rich").alias("rich"), F.max("same").alias("same"), F.first("size").alias("size"), F.collect_set("places").alias("places")
    ).join(F.broadcast(whole), "item_id")
    matched = matched.withColumn("places", F.expr("array_sort(array_distinct(flatten(places)))"))  # by p
    matched = matched.withColumn("slots", F.expr("array_distinct(transform(filter(places, z -> z.shape <> ''), z -> struct(z.shape, z.a, z.b)))"))
    for side in "ab":
        matched = matched.withColumn(f"twice_{side}", F.expr(f"transform(slots, z -> struct(z.shape, z.{side} as x))"))
        matched = matched.withColumn(f"twice_{side}", F.expr(f"filter(array_distinct(twice_{side}), x -> size(filter(twice_{side}, y -> y = x)) > 1)"))
    clashes = "filter(slots, z -> z.a <> z.b AND (array_contains(twice_a, struct(z.shape, z.a as x)) OR array_contains(twice_b, struct(z.shape, z.b as x))))"
    matched = matched.withColumn("clashes", F.expr(clashes))
    # the longest stretch without a clash
    begin = "named_struct('last', -1, 'run', 0, 'literal', 0, 'best', 0)"
    on = "named_struct('last', z.p, 'run', if(z.p = s.last + 1, s.run, 0) + 1, 'literal', if(z.p = s.last + 1, s.literal, 0) + if(z.shape = '', 1, 0), 'best', s.best)"
    best = f"element_at(transform(array({on}), y -> named_struct('last', y.last, 'run', y.run, 'literal', y.literal, 'best', greatest(y.best, if(y.literal >= {literals}, y.run, 0)))), 1)"
    step = f"if(array_contains(clashes, struct(z.shape, z.a, z.b)), named_struct('last', z.p, 'run', 0, 'literal', 0, 'best', s.best), {best})"
    matched = matched.withColumn("stretch", F.expr(f"aggregate(places, {begin}, (s, z) -> {step}, s -> s.best)"))
    evidence = f"(rich OR same OR (n_windows = all AND size >= {WHOLE}))"
    literal = "size(filter(places, z -> z.shape = ''))"
    numbers = f"forall(clashes, z -> z.shape = '\x01number') AND rich AND {literal} >= {literals} + {CLASH} * size(clashes)"
    matched = matched.where(f"(size(clashes) = 0 AND {evidence}) OR (size(clashes) > 0 AND {numbers}) OR stretch >= {STRETCH}")
    matched = matched.withColumn("verbatim", F.expr("forall(slots, z -> z.a = z.b)"))
    return matched.groupBy("doc_id", "own_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("verbatim").alias("verbatim"))


def keep_uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, columns as they are, without those that hold a benchmark item; each row is judged by its own text."""
    return without_rows(documents, lambda rows: _contaminated(rows, benchmark))
