"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import stage

#: A paragraph is a line; longer lines count as paragraphs of so many characters, from the line's start.
PARAGRAPH = r"[^\n]{1,200}"
#: Cells of the sketch that a fingerprint shows: three tables of a third each.
BASE_CELLS = 24
#: Rounds of peeling, each over one of the three tables: for the base sketch; for the larger ones at first; and then at a time, for pairs
#: whose cells still change.
BASE_ROUNDS, ROUNDS, FIRST_ROUNDS, MORE_ROUNDS = 6, 15, 9, 3


def paragraph_digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _cells(key: Column, third: Column) -> list[Column]:
    """The cell of a digest in each of the three tables of `third` cells."""
    return [(F.pmod(F.xxhash64(key, F.lit(t)), third) + t * third).cast("int") for t in range(3)]


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(99)).bitwiseAND(0xFFFFFFFF)


def _entry(cell: Column, n: Column, key: Column, check: Column) -> Column:
    return F.struct(cell.alias("cell"), n.cast("int").alias("n"), key.alias("key"), check.alias("check"))


def _folded(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys, "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check")).where("n != 0 OR key != 0 OR check != 0")


def sketch(rows: DataFrame, keys: list[str], digests: Column, cells: int = BASE_CELLS) -> DataFrame:
    """keys, sketch string: the non-empty cells of each row's sketch as cell:count:digests:checks, in hexadecimal, in order.

    A cell holds how many digests fell into it and the XOR of them and of their check values. Expects rows
    partitioned by a prefix of keys, and then adds no shuffle.
    """
    each = rows.select(*keys, F.explode(digests).alias("d"))
    third = F.lit(cells // 3)
    entries = each.select(*keys, F.explode(F.array(*(_entry(c, F.lit(1), F.col("d"), _check(F.col("d"))) for c in _cells(F.col("d"), third)))).alias("e")).select(*keys, "e.*")
    shown = F.concat_ws(":", F.hex("cell"), F.hex("n"), F.lpad(F.hex("key"), 16, "0"), F.lpad(F.hex("check"), 8, "0"))
    return _folded(entries, keys).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", shown.alias("s")))), lambda x: x["s"]), " ").alias("sketch"))


def _peel_round(cells: DataFrame, keys: list[str], table: int) -> DataFrame:
    """Takes every digest that is alone in a cell of one table out of its cells in the other two.

    Within one table a digest has one cell, so none is taken twice. What is recovered is counted under cell -1
    (only in the first) or -2 (only in the second).
    """
    key, third = F.col("key"), F.col("third")
    alone = (F.col("cell") >= 0) & F.floor(F.col("cell") / third).eqNullSafe(F.lit(table)) & (F.abs("n") == 1) & (F.col("check") == _check(key))
    own = _entry(F.col("cell"), F.col("n"), key, F.col("check"))
    others = [_entry(c, -F.col("n"), key, F.col("check")) for t, c in enumerate(_cells(key, third)) if t != table]
    found = _entry(F.when(F.col("n") > 0, -1).otherwise(-2), F.lit(1), F.lit(0).cast("long"), F.lit(0).cast("long"))
    peeled = cells.select(*keys, F.explode(F.when(alone, F.array(*others, found)).otherwise(F.array(own))).alias("e")).select(*keys, "e.*")
    return _folded(peeled, keys)


def _difference(pairs: DataFrame) -> DataFrame:
    """The cells of the sketch of a less that of b, from pairs (row, which, third, a, b)."""
    keys = ["row", "which", "third"]
    signed = F.concat(F.transform("a", lambda d: F.struct(d.alias("d"), F.lit(1).alias("n"))), F.transform("b", lambda d: F.struct(d.alias("d"), F.lit(-1).alias("n"))))
    each = pairs.select(*keys, F.explode(signed).alias("s")).select(*keys, "s.*")
    entries = each.select(*keys, F.explode(F.array(*(_entry(c, F.col("n"), F.col("d"), _check(F.col("d"))) for c in _cells(F.col("d"), F.col("third"))))).alias("e")).select(*keys, "e.*")
    return _folded(entries, keys)


def decode(pairs: DataFrame, rounds: int, more: int = 0) -> DataFrame:
    """row, which, ok, only_a, only_b from pairs (row, which, third, a, b: arrays of distinct digests, third: cells in each of three tables).

    The sketch of b is subtracted from that of a, cell by cell, and the difference is peeled. ok: every cell came out
    empty, so that only_a and only_b are the numbers of digests that the other side lacks. Pairs with equal digests leave
    no cell and are not in the result. Pairs with open cells get `more` rounds at a time for as long as that empties any; the others are done
    with. Expects pairs partitioned by row, and then adds no shuffle to the first rounds.
    """
    keys, cells, at, found, left = ["row", "which", "third"], _difference(pairs), 0, None, None
    count = lambda c: F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).cast("int")
    while True:
        for _ in range(rounds):
            cells, at = _peel_round(cells, keys, at % 3), at + 1
        cells = stage(cells) if more else cells
        summed = cells.groupBy("row", "which").agg((F.max("cell") < 0).alias("ok"), count(-1).alias("only_a"), count(-2).alias("only_b"))
        if not more:
            return summed
        summed = stage(summed)
        open_ = cells.join(summed.where("NOT ok").select("row", "which").hint("merge"), ["row", "which"], "left_semi")
        now = open_.where("cell >= 0").count()
        stuck = now == 0 or now == left
        found = summed.where("ok") if found is None else found.unionByName(summed.where("ok"))
        if stuck:
            return found.unionByName(summed.where("NOT ok"))
        cells, rounds, left = open_, more, now


def differences(rows: DataFrame, base_cells: int = BASE_CELLS) -> DataFrame:
    """row, which, only_a, only_b from rows (row, pairs: array of (which, a, b)): how many digests each side of a pair has alone; no row where none.

    The base sketch is tried first, but where the counts of both sides already differ by more than its cells. Where its difference can't be
    peeled, a larger one is made, of twice the cells that the digests of both could need, and then of twice the last, until every
    difference has been peeled.
    """
    far = F.abs(F.size("a") - F.size("b")) > base_cells
    each = rows.select("row", F.explode("pairs").alias("p")).select("row", "p.*")
    got = stage(decode(each.where(~far).repartition("row").withColumn("third", F.lit(base_cells // 3)), BASE_ROUNDS))
    done = got.where("ok")
    failed, factor = got.where("NOT ok").select("row", "which"), 1
    bound = F.ceil((F.size("a") + F.size("b")) * 2 / 3 + 4).cast("int")
    open_ = stage(each.where(far).unionByName(each.where(~far).join(failed.hint("merge"), ["row", "which"])).withColumn("bound", bound))
    while not open_.isEmpty():
        got = stage(decode(open_.withColumn("third", F.col("bound") * factor).repartition("row"), FIRST_ROUNDS, MORE_ROUNDS))
        done = done.unionByName(got.where("ok"))
        failed, factor = got.where("NOT ok"), factor * 2
        if failed.isEmpty():
            break
        open_ = stage(open_.join(failed.select("row", "which").hint("merge"), ["row", "which"]))
    return done.drop("ok")


#: What tells a document: its id (0 for null), whether that is null, and a hash of its text.
_KEY = ["kid", "knull", "tie"]


def _with_next(docs: DataFrame) -> DataFrame:
    """_KEY, n, text, tail, next_text_digests of each distinct row of docs (doc_id, text), n times there: what the edit of its last copy takes from the next document.

    Keys alone are put in order, by ranges over all tasks; the last of each range and the first of the next one are neighbours too.
    Each text then moves once, to its key, and from there the part that the document before it needs, to that one.
    """
    named = docs.select(F.coalesce("doc_id", F.lit(0)).alias("kid"), F.col("doc_id").isNull().cast("int").alias("knull"), F.xxhash64("text").alias("tie"), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    keys = named.select(*_KEY, F.length("text").alias("n_chars")).groupBy(*_KEY).agg(F.max("n_chars").alias("n_chars")).select(*_KEY, half.alias("half"))
    order = [F.col("knull").asc(), F.col("kid").desc(), F.col("tie").desc()]
    ranged = stage(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    own = F.struct(*_KEY, "half")
    within = Window.partitionBy("range").orderBy(*order)
    # A row a range: its last key, which comes before the first of the next range that has any; the very last one before the very first.
    ends = ranged.groupBy("range").agg(F.max(F.struct("knull", -F.col("kid"), F.bitwise_not("tie"), own.alias("own")))["own"].alias("last"))
    by_range = Window.orderBy("range")
    ends = ends.select(F.col("range").alias("__range"), F.coalesce(F.lag("last").over(by_range), F.last("last").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    led = ranged.withColumn("before", F.lag(own).over(within))
    led = led.join(ends, (F.col("range") == F.col("__range")) & F.col("before").isNull(), "left").withColumn("before", F.coalesce("before", "end"))
    befores = led.select(*_KEY, *(F.col("before")[c].alias(f"b_{c}") for c in (*_KEY, "half")))

    whole = named.groupBy(*_KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    # Both sides use all columns of `whole`, so that they share its one shuffle.
    sent = whole.join(befores.hint("merge"), _KEY).where("n > 0")
    sent = sent.select(*(F.col(f"b_{c}").alias(c) for c in _KEY), F.substring("text", F.lit(1), F.col("b_half")).alias("tail"), paragraph_digests(F.col("text")).alias("next_digests"))
    return whole.join(sent.hint("merge"), _KEY)


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id, text).

    The edited text keeps the first half and ends with as many characters of the next document (by descending id, after
    the last the first). A fingerprint is the number of distinct paragraph digests and the base sketch of them; a likeness is the
    share of digests that two sketches have in common, from their peeled difference. A null text counts as empty; two texts without
    paragraphs have likeness 1. Null ids come last and tied ids go by a hash of the text. Rows that repeat follow each other and keep a
    result each: of n copies n - 1 have an equal one next. Other columns are not used. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = _with_next(texts).withColumns({"n_chars": F.length("text").cast("long"), "digests": paragraph_digests(F.col("text"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    last = F.struct(F.lit(1).cast("long").alias("copies"), "tail", "next_digests")
    others = F.struct((F.col("n") - 1).alias("copies"), F.substring("text", F.lit(1), half).alias("tail"), F.col("digests").alias("next_digests"))
    each = paired.withColumn("v", F.explode(F.when(F.col("n") > 1, F.array(last, others)).otherwise(F.array(last))))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("v.tail"))
    doc_id = F.when(F.col("knull") == 0, F.col("kid")).alias("doc_id")
    versions = each.withColumn("edited", edited).select(F.monotonically_increasing_id().alias("row"), doc_id, F.col("v.copies").alias("copies"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "digests", paragraph_digests(F.col("edited")).alias("edited_digests"), F.col("v.next_digests").alias("next_digests"))
    kept = stage(versions)

    pair = lambda k, other: F.struct(F.lit(k).alias("which"), F.col("digests").alias("a"), F.col(other).alias("b"))
    found = differences(kept.select("row", F.array(pair(0, "edited_digests"), pair(1, "next_digests")).alias("pairs")))
    alone = lambda k, c: F.coalesce(F.max(F.when(F.col("which") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    found = found.groupBy("row").agg(*(alone(k, c) for k in (0, 1) for c in ("only_a", "only_b")))

    dealt = kept.select("row", "digests", "edited_digests").repartition("row")
    both = dealt.select("row", F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("digests")), F.struct(F.lit(1).alias("version"), F.col("edited_digests").alias("digests")))).alias("v")).select("row", "v.*")
    shown = sketch(both, ["row", "version"], F.col("digests")).groupBy("row").agg(F.max(F.when(F.col("version") == 0, F.col("sketch"))).alias("s0"), F.max(F.when(F.col("version") == 1, F.col("sketch"))).alias("s1"))
    sizes = kept.select("row", "doc_id", "copies", "n_chars", "edited_sha256", *(F.size(c).alias(s) for c, s in (("digests", "n0"), ("edited_digests", "n1"), ("next_digests", "n2"))))
    joined = sizes.join(shown, "row", "left").join(found, "row", "left")

    def near(k: int) -> Column:
        a, b = F.coalesce(f"only_a{k}", F.lit(0)), F.coalesce(f"only_b{k}", F.lit(0))
        return F.when(F.col("n0") + b == 0, 1.0).otherwise((F.col("n0") - a) / (F.col("n0") + b))

    print_ = lambda n, s: F.concat(F.col(n).cast("string"), F.lit(";"), F.coalesce(s, F.lit("")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "n_chars", "edited_sha256", print_("n0", "s0").alias("fingerprint"), print_("n1", "s1").alias("edited_fingerprint"), near(0).alias("near_edited"), near(1).alias("near_next"))
