"""Language-model scores by prediction by partial matching: byte contexts, escapes with symbol exclusion, code lengths per document."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import python_batches, stage

#: Bytes of context. A gram is a context and the symbol after it, BITS bits a symbol, the oldest in front.
ORDER, BITS = 5, 9
#: What stands before a text, and what ends it. Bytes are 0 to 255; a text's symbols are its bytes and END.
START, END, SYMBOLS = 256, 257, 257
#: Shares above which a gram or word goes to the workers by broadcast: there can't be more than these of them, whatever the corpus.
HEAVY_GRAMS, HEAVY_WORDS, LONGEST_HEAVY_WORD = 1 << 22, 1 << 20, 64
#: Bytes of text, and windows, that a worker handles at a time.
FLUSH = 1 << 22


def held_out(doc_id: Column) -> Column:
    """Ids whose CRC32 (as text) leaves 2 modulo 7; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _texts(batches, column: int):
    """Lists of (batch, rows from, rows to, texts as lower-case bytes): whole texts, about FLUSH bytes at a time."""
    for batch in batches:
        first, held, size = 0, [], 0
        for k in range(batch.num_rows):
            held.append((batch.column(column)[k].as_py() or "").encode().lower())  # of bytes, lower() knows A-Z only
            size += len(held[-1])
            if size >= FLUSH:
                yield batch, first, k + 1, held
                first, held, size = k + 1, [], 0
        if held:
            yield batch, first, batch.num_rows, held


def windows(raws: list[bytes], order: int):
    """(grams, number of their text) of all positions of the texts, FLUSH at a time. A text is START * order, its bytes, END."""
    sizes = np.array([len(r) + order + 1 for r in raws], np.int64)
    ends = np.cumsum(sizes)
    s = np.full(int(ends[-1]), START, np.uint16)
    for raw, end in zip(raws, ends):
        s[end - 1 - len(raw) : end - 1] = np.frombuffer(raw, np.uint8)
        s[end - 1] = END
    own = np.repeat(np.arange(len(raws), dtype=np.int32), sizes)
    for a in range(0, len(s) - order, FLUSH):
        part = s[a : a + FLUSH + order]
        n = len(part) - order
        grams = np.zeros(n, np.int64)
        for j in range(order + 1):
            grams <<= BITS
            grams |= part[j : j + n]
        whole = own[a : a + n] == own[a + order : a + order + n]
        yield grams[whole], own[a : a + n][whole]


def _gram_counts(order: int):
    def run(batches):
        for _, _, _, raws in _texts(batches, 0):
            for grams, _ in windows(raws, order):
                found, times = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], names=["g", "n"])

    return run


def _word_counts(batches):
    for _, _, _, raws in _texts(batches, 0):
        counts = Counter()
        for raw in raws:
            counts.update(raw.split())  # of bytes, split() knows the space and \x09-\x0D only
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])


def _suffix(symbols: int) -> Column:
    """The last symbols of gram g."""
    return F.col("g").bitwiseAND(F.lit((1 << BITS * symbols) - 1))


def trie(grams: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(seen, nodes) from grams (g, n). seen: g, n, lp, the log10 probability of g's last symbol after its whole context.

    nodes: a row for each context of each order: k, c, total, distinct, excluded, next (symbol -> count, at most 257). The counts of the whole
    order are those of the corpus; a symbol counts in a shorter context once for each longer one in which it was seen, as with
    update exclusion. Escapes are by method D: a context gives distinct / (2 total) to the symbols that it lacks, half a count for each it has.
    excluded: what the context's symbols count in the next shorter context, which leaves them out after an escape. As each of them
    is known there too, sums are all that exclusion needs. Every level is a grouping by integers, no group of more than 258 rows.
    """
    level, nodes = stage(grams), None
    around = Window.partitionBy(F.shiftright("g", BITS))
    seen = stage(level.withColumn("lp", F.log10((2 * F.col("n") - 1) / (2 * F.sum("n").over(around)))))
    for k in range(order, -1, -1):
        shorter = F.count(F.lit(1)).over(Window.partitionBy(_suffix(k))) if k else F.lit(0).cast("long")
        symbol = F.col("g").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        own = level.select(F.shiftright("g", BITS).alias("c"), symbol.alias("b"), "n", shorter.alias("p"))
        following = F.map_from_entries(F.collect_list(F.struct("b", "n")))
        found = own.groupBy("c").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("p").alias("excluded"), following.alias("next"))
        found = found.select(F.lit(k).alias("k"), "*")
        nodes = found if nodes is None else nodes.unionByName(found)
        if k:
            level = stage(level.groupBy(_suffix(k).alias("g")).agg(F.count(F.lit(1)).alias("n")))
    return seen, stage(nodes)


def escaped(grams: DataFrame, nodes: DataFrame, order: int) -> DataFrame:
    """g, lp of distinct grams (g): from the longest context down, escapes until one knows the symbol; at last all symbols left are alike.

    A gram meets its contexts in one join, and is judged from the at most order + 1 that are known. Contexts of up to one symbol, at
    most 259, are broadcast.
    """
    context = F.expr(f"shiftright(g, {BITS}) & (shiftleft(1L, {BITS} * k) - 1)")
    each = grams.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(order)))).withColumn("c", context)
    short = each.where("k <= 1").join(F.broadcast(nodes.where("k <= 1")), ["k", "c"], "left")
    found = short.unionByName(each.where("k > 1").join(nodes.where("k > 1").hint("merge"), ["k", "c"]))
    own = F.try_element_at("next", F.col("g").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    level = F.struct((-F.col("k")).alias("k"), "total", "distinct", "excluded", own.alias("n"))
    gathered = found.groupBy("g").agg(F.array_sort(F.collect_list(level)).alias("levels"))

    def step(acc: Column, x: Column) -> Column:
        new = x["distinct"] - acc["gone"]
        room = 2 * (x["total"] - acc["mass"])
        state = lambda lp, mass, gone, done: F.struct(lp.alias("lp"), mass.alias("mass"), gone.alias("gone"), done.alias("done"))
        known = state(acc["lp"] + F.log10((2 * x["n"] - 1) / room), acc["mass"], acc["gone"], F.lit(True))
        missed = state(acc["lp"] + F.when(new > 0, F.log10(new / room)).otherwise(0.0), x["excluded"], x["distinct"], F.lit(False))
        return F.when(acc["done"] | x["total"].isNull(), acc).when(x["n"].isNotNull(), known).otherwise(missed)

    zero = F.lit(0).cast("long")
    begin = F.struct(F.lit(0.0).alias("lp"), zero.alias("mass"), zero.alias("gone"), F.lit(False).alias("done"))
    end = F.aggregate("levels", begin, step)
    judged = gathered.select("g", end.alias("end"))
    return judged.select("g", F.when(F.col("end.done"), F.col("end.lp")).otherwise(F.col("end.lp") - F.log10(SYMBOLS - F.col("end.gone"))).alias("lp"))


def _scores(order: int, kind, heavy, words):
    """For mapInArrow over (row, doc_id, held_out, text): sums over the grams and words at hand, and the others with their counts."""

    def run(batches):
        grams, lps, known = heavy.value[0], heavy.value[1], words.value
        for batch, first, last, raws in _texts(batches, 3):
            n = len(raws)
            score, missed = np.zeros(n), []
            for found, own in windows(raws, order):
                at = np.searchsorted(grams, found)
                at[at == len(grams)] = 0
                hit = grams[at] == found if len(grams) else np.zeros(len(found), bool)
                score += np.bincount(own[hit], lps[at[hit]] if len(grams) else None, n)
                missed.append((own[~hit], found[~hit]))
            own, rest = (np.concatenate(x) for x in zip(*missed))
            ranked = np.lexsort((rest, own))
            own, rest = own[ranked], rest[ranked]
            starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (rest[1:] != rest[:-1])][: len(own)])
            times = np.diff(np.r_[starts, len(own)])
            gram_ends = np.searchsorted(own[starts], np.arange(n + 1)).astype(np.int32)

            tokens, hits, base, tail, tail_times, tail_ends = [], [], [], [], [], [0]
            for raw in raws:
                counts = Counter(raw.split())
                tokens.append(counts.total())
                inside, sum_ = 0, 0.0
                for w, c in counts.items():
                    if (lp := known.get(w)) is None:
                        tail.append(w)
                        tail_times.append(c)
                    else:
                        inside += c
                        sum_ += c * lp
                hits.append(inside)
                base.append(sum_)
                tail_ends.append(len(tail))
            lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            columns = [batch.column(k).slice(first, last - first) for k in range(3)]
            columns += [pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(score)]
            columns += [lists(tail_ends, pa.array(tail, pa.binary())), lists(tail_ends, pa.array(tail_times, pa.int64()))]
            columns += [lists(gram_ends, pa.array(rest[starts])), lists(gram_ends, pa.array(times.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    schema = f"row long, doc_id {kind}, held_out boolean, words_n long, known_n long, base double, ppm double, words array<binary>, word_times array<long>, grams array<long>, gram_times array<long>"
    return run, schema


_NAMES = ["row", "doc_id", "held_out", "words_n", "known_n", "base", "ppm", "words", "word_times", "grams", "gram_times"]


def scored(docs: DataFrame, order: int = ORDER, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text), learnt from those that aren't held out.

    Texts are read whole with A-Z in lower case. score is the log10 probability of all their bytes and their end under a byte model of `order`
    bytes of context (see trie and escaped); it counts white space and marks too, which base_score, a model of single words and the
    end with one added to every count, does not. The counts are those of the whole training part. Grams of at least 1 in
    HEAVY_GRAMS positions and words of at least 1 in HEAVY_WORDS are looked up in the workers; the others are counted per
    document and joined, so that no table grows on the driver or in a worker, and no join has a hot key.
    A null text is an empty one: its end is its one token. Rows that repeat are rows of their own, null ids are trained on. Without
    training rows every symbol has probability 1/257 and every token 1. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    python_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    is_held = held_out(F.col("doc_id")) if held is None else held
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", is_held.alias("held_out"), "text")
    train = rows.where("NOT held_out").select("text")

    words = stage(train.mapInArrow(_word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = train.count()
    train_tokens, types = n_words + ends, distinct + (ends > 0)
    common = words.where((F.col("c") * HEAVY_WORDS >= train_tokens) & (F.octet_length("word") <= LONGEST_HEAVY_WORD)).toArrow()
    table = spark.sparkContext.broadcast({bytes(w): math.log10(c + 1) for w, c in zip(common["word"].to_pylist(), common["c"].to_pylist())})

    counts = train.mapInArrow(_gram_counts(order), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    seen, nodes = trie(counts, order)
    positions = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = seen.where(F.col("n") * HEAVY_GRAMS >= positions).select("g", "lp").toArrow()
    ranked = np.argsort(keys := frequent["g"].to_numpy())
    heavy = spark.sparkContext.broadcast((keys[ranked], frequent["lp"].to_numpy()[ranked]))

    found = stage(rows.mapInArrow(*_scores(order, kind, heavy, table)))
    rare_words = found.select("row", F.explode(F.arrays_zip("words", "word_times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.word_times").alias("times"))
    by_word = rare_words.join(words.hint("merge"), "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_base"))

    rare = found.select("row", "held_out", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("row", "held_out", F.col("x.grams").alias("g"), F.col("x.gram_times").alias("times"))
    new = stage(rare.where("held_out").select("g").distinct().join(seen.select("g").hint("merge"), "g", "left_anti"))  # trained rows know all their grams
    probabilities = seen.where(F.col("n") * HEAVY_GRAMS < positions).select("g", "lp").unionByName(escaped(new, nodes, order))
    by_gram = rare.join(probabilities.hint("merge"), "g").groupBy("row").agg(F.sum(F.col("times") * F.col("lp")).alias("more_ppm"))

    both = found.drop("words", "word_times", "grams", "gram_times").join(by_word.hint("merge"), "row", "left").join(by_gram.hint("merge"), "row", "left")
    n_tokens = F.col("words_n") + 1
    smoothed = math.log10(train_tokens + types + 1)
    more = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("base") + more("more_base") + F.lit(math.log10(ends + 1)) - n_tokens * F.lit(smoothed)
    return both.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known_n") + more("more_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("ppm") + more("more_ppm")).alias("score"),
    )
