"""Line deduplication by a deletion-neighbourhood join, DataFrame operations only.

Two lines are near when their word sequences are within one edit (a word
replaced, inserted or deleted) and that edit is at most a fifth of the longer
line, a similarity of 0.8: so lines of ``LEAST_WORDS`` words or more may have one
edit, shorter ones none. Every line emits its deletion neighbourhood: the
sequence without its i-th word, as hashed keys. A replacement makes equal
variants at one place, an insertion makes a variant equal to the other's full
line. Lines that share a key all lie within the bound, so the group passes on
its earliest line by an aggregate and no pairs within a group are made; each
line's edit distance to that earliest line is then verified on the words.

Two such lines also agree in their first or last half. So halves are hashed
first (three keys a line), and only lines that share a half with a different
line emit their variants, and only for the other half's words.

A line goes when a line within the bound occurs earlier, in order of document
id and line number; all is judged on the input. Exact copies are within the
bound, whatever their length. With ``characters``, a line without spaces in a
script that uses none is a sequence of characters instead of one word, so its
edits are of one character.

Defined cases: a null text stays null. A null id sorts last. Rows that repeat
both id and text are one document: their lines are equally early and all stay
or go together. Rows without id are ordered by line number alone, and lines of
one number are equally early there. Blank lines (ASCII white space only) stay. Lines and texts of any length are taken
whole. Other columns are returned as they are, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, saved

#: Rows of a side that is broadcast; beyond it the join is left to a shuffle.
BROADCAST_ROWS = 300_000
LAST = (1 << 63) - 1
#: ASCII white space that a line can hold.
BLANK = " \t\x0b\f\r"
#: Words of which one edit is a fifth.
LEAST_WORDS = 5
#: Words whose sums are kept together, so that a variant of a long line needs few steps.
SUM_BLOCK = 64
#: Scripts written without spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def _small(df: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _split(docs: DataFrame) -> DataFrame:
    """(_id, _rk, _no, line): every line with its document's id, row key and its number."""
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("_id"),
        F.xxhash64("doc_id", "text").alias("_rk"),
        F.posexplode(F.split("text", "\n")).alias("_no", "line"),
    )


def _lines(docs: DataFrame, characters: bool) -> DataFrame:
    """Lines that are not blank, without their words: _id, row key _rk, _no, hashes _h and _g, and _halves.

    Narrow and saved, so that texts are not split again by each of its readers. Lines too short for an edit have no halves.
    """
    every = _split(docs).where(F.ltrim("line", F.lit(BLANK)) != "")
    sized = every.select("*", _unspaced(characters).alias("_un"), _size(characters).alias("_n"))
    halves = F.when(F.col("_n") >= LEAST_WORDS - 1, _halves("_n", characters))
    made = sized.select("_id", "_rk", "_no", F.xxhash64("line").alias("_h"), F.hash("line").alias("_g"), halves.alias("_halves"))
    return saved(made, "line-hashes").withColumn("pos", F.struct("_id", "_no"))


def _unspaced(characters: bool) -> Column:
    return ~F.contains("line", F.lit(" ")) & F.col("line").rlike(UNSPACED) if characters else F.lit(False)


def _units(characters: bool) -> Column:
    """What edits of a line change: its words, or marked characters, which equal no word."""
    words = F.split("line", " ")
    if not characters:
        return words
    marked = F.transform(F.filter(F.split("line", ""), lambda c: c != ""), lambda c: F.concat(F.lit("\n"), c))
    return F.when(_unspaced(characters), marked).otherwise(words)


def _size(characters: bool) -> Column:
    """The number of a line's units, without making them."""
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return F.when(_unspaced(characters), F.length("line")).otherwise(words).cast("int")


def _slice(words: Column, start: Column | int, length: Column) -> Column:
    return F.slice(words, start, F.greatest(length, F.lit(0)))


def _halves(n: str, characters: bool) -> Column:
    """Keys of which two lines within one edit share at least one: (head, key), from the line's own bytes."""
    n, k = F.col(n), F.floor(F.col(n) / 2).cast("int")
    even = n % 2 == 0

    def head(size: Column) -> Column:
        part = F.when(F.col("_un"), F.substring("line", F.lit(1), size)) if characters else F.when(F.lit(False), "")
        part = part.otherwise(F.call_function("substring_index", "line", F.lit(" "), size))
        return F.struct(F.lit(True).alias("head"), F.xxhash64(F.lit("head"), part).alias("key"))

    def tail(size: Column) -> Column:
        part = F.when(F.col("_un"), F.right("line", size)) if characters else F.when(F.lit(False), "")
        part = part.otherwise(F.call_function("substring_index", "line", F.lit(" "), -size))
        return F.struct(F.lit(False).alias("head"), F.xxhash64(F.lit("tail"), part).alias("key"))

    return F.array(head(k), tail(k), F.when(even, tail(k - 1)).otherwise(head(k + 1)))


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def _with_sums(lines: DataFrame, words: Column) -> DataFrame:
    """Adds sums (by xor) from which each variant's key follows without reading the words again.

    _here: hash of each word and its place; _all: their sum. _shift: what a word
    adds when it moves one place down; _blocks: sums of these by SUM_BLOCK words.
    The caller saves the result, so that each array is computed once a line.
    """

    def moved(w: Column, j: Column) -> Column:
        return F.xxhash64(w, j).bitwiseXOR(F.xxhash64(w, j - 1))

    here = F.transform(words, lambda w, j: F.xxhash64(w, j))
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(SUM_BLOCK))
    blocks = F.transform(starts, lambda s: _xor(F.transform(F.slice(words, s + 1, SUM_BLOCK), lambda w, j: moved(w, j + s))))
    return lines.select(
        "*", F.size(words).alias("n"), here.alias("_here"), _xor(here).alias("_all"), F.transform(words, moved).alias("_shift"), blocks.alias("_blocks")
    )


def _variants(chosen: DataFrame) -> DataFrame:
    """(_h, _g, pos, i, kind, key): every line without its i-th word, replaced (r) or deleted (d), and whole (w)."""
    k = F.floor(F.col("n") / 2).cast("int")
    # a shared first half leaves edits behind it, a shared last half edits before it
    low = F.when(F.col("by_head") & F.col("by_both"), k).otherwise(F.lit(1))
    high = F.when(F.col("by_head"), F.col("n")).otherwise(F.col("n") - k + 1)
    places = F.sequence(F.greatest(low, F.lit(1)), F.least(high, F.col("n")))

    def item(kind: str, i: Column, key: Column) -> Column:
        return F.struct(i.alias("i"), F.lit(kind).alias("kind"), key.alias("key"))

    def without(i: Column) -> Column:
        return F.col("_all").bitwiseXOR(F.get("_here", i - 1))

    def shifted(i: Column) -> Column:
        """What moving the words behind place i adds: the rest of its block, then whole blocks."""
        block = F.floor(i / SUM_BLOCK).cast("int")
        rest = F.slice("_shift", i + 1, (block + 1) * SUM_BLOCK - i)
        later = F.slice("_blocks", block + 2, F.size("_blocks"))
        return _xor(rest).bitwiseXOR(_xor(later))

    places = F.when(F.col("n") >= LEAST_WORDS, places).otherwise(F.array().cast("array<int>"))  # only whole, for a longer line
    replaced = F.transform(places, lambda i: item("r", i, F.xxhash64(F.lit("r"), "n", i, without(i))))
    shorter = F.transform(places, lambda i: item("d", i, F.xxhash64(F.lit("d"), F.col("n") - 1, without(i).bitwiseXOR(shifted(i)))))
    whole = F.array(item("w", F.lit(0), F.xxhash64(F.lit("d"), "n", "_all")))
    return chosen.select("_h", "_g", "pos", F.inline(F.concat(replaced, shorter, whole)))


def _near_cuts(docs: DataFrame, lines: DataFrame, characters: bool) -> DataFrame:
    """(_h, _g, cut): for lines within one edit of another line, the earliest place of such a line."""
    units = _units(characters)
    halves = lines.select("pos", "_rk", "_h", "_g", F.inline("_halves"))
    shared = halves.groupBy("key").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).where("lo != hi").select("key")
    shared = _small(saved(shared, "line-halves"))
    wanted = (
        halves.join(shared, "key")
        .groupBy("_h", "_g")
        .agg(F.min(F.struct("pos", "_rk")).alias("at"), F.max("head").alias("by_head"), F.min("head").alias("by_both"))
        .select("_h", "_g", "at.pos", "by_head", "by_both", F.col("at._rk").alias("_rk"), F.col("at.pos._no").alias("_no"))
    )
    wanted = _small(saved(wanted, "line-wanted"))
    # only the first of equal lines is read again, by its row and number; rows that repeat id and text give it again
    chosen = _split(docs).select("_rk", "_no", "line").join(wanted, ["_rk", "_no"])
    chosen = chosen.groupBy("_h", "_g").agg(*[F.first(c).alias(c) for c in ("pos", "line", "by_head", "by_both")])
    chosen = saved(_with_sums(chosen, units), "line-candidates").withColumn("_w", units)
    variants = _variants(chosen)
    shared = variants.groupBy("key").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).where("lo != hi").select("key")
    variants = saved(variants.join(_small(saved(shared, "line-shared")), "key"), "line-variants")
    first = F.struct("pos", "_h", "_g", "i")
    groups = variants.groupBy("key").agg(
        F.min(F.when(F.col("kind") == "w", first)).alias("full"), F.min(F.when(F.col("kind") != "w", first)).alias("cut_out")
    )
    groups = _small(saved(groups, "line-groups"))
    # a replaced line meets replaced ones, a shortened line full ones, a full line shortened ones
    other = F.when(F.col("kind") == "d", F.col("full")).otherwise(F.col("cut_out"))
    pairs = variants.join(groups, "key").select("_h", "_g", "i", "kind", "pos", other.alias("o")).where("o is not null and o.pos < pos")
    pairs = pairs.dropDuplicates(["_h", "_g", "o"]).select(
        "_h", "_g", "kind", "i", F.col("o.pos").alias("cut"), F.col("o._h").alias("_oh"), F.col("o._g").alias("_og"), F.col("o.i").alias("_oi")
    )
    mine = chosen.select("_h", "_g", F.col("_w").alias("a"))
    theirs = chosen.select(F.col("_h").alias("_oh"), F.col("_g").alias("_og"), F.col("_w").alias("b"))
    both = pairs.join(mine, ["_h", "_g"]).join(theirs, ["_oh", "_og"])

    def without(words: str, i: str) -> Column:
        w, at = F.col(words), F.col(i)
        return F.concat(_slice(w, 1, at - 1), _slice(w, at + 1, F.size(w) - at))

    replacement = (F.size("a") == F.size("b")) & (F.size(F.filter(F.zip_with("a", "b", lambda x, y: x != y), lambda t: t)) <= 1)
    within = F.when(F.col("kind") == "r", replacement).when(F.col("kind") == "d", without("a", "i") == F.col("b")).otherwise(without("b", "_oi") == F.col("a"))
    return both.where(within).groupBy("_h", "_g").agg(F.min("cut").alias("cut"))


def mark_lines(docs: DataFrame, characters: bool = False) -> DataFrame:
    """(_id, _rk, removed): the sorted line numbers that go, for the documents that lose any."""
    docs = docs.select("doc_id", "text")
    lines = _lines(docs, characters)
    exact = lines.groupBy("_h", "_g").agg(F.min("pos").alias("cut"), F.count("*").alias("n")).where("n > 1").drop("n")
    cuts = exact.unionByName(_near_cuts(docs, lines, characters)).groupBy("_h", "_g").agg(F.min("cut").alias("cut"))
    cuts = _small(saved(cuts, "line-cuts"))
    gone = lines.select("_id", "_rk", "_no", "pos", "_h", "_g").join(cuts, ["_h", "_g"]).where("pos > cut")
    return gone.groupBy("_id", "_rk").agg(F.array_sort(F.collect_set("_no")).alias("removed"))


def dedup_lines(docs: DataFrame, characters: bool = False, name: str = "_removed") -> DataFrame:
    """docs with the text's later copies of lines taken out, and ``name``, the numbers of these lines (or null)."""
    removed = mark_lines(docs, characters)
    others = F.struct(*[column(c) for c in docs.columns if c != "text"])  # they travel as one column, so that no name clashes
    keyed = docs.select(
        others.alias("_row"), F.split("text", "\n").alias("_parts"), F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("_id"), F.xxhash64("doc_id", "text").alias("_rk")
    )
    joined = keyed.join(removed, ["_id", "_rk"], "left")
    # the lines are a column of the join's input: split here, a text would be split again for each of its lines
    left = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("removed"))
    kept = F.when(F.col("removed").isNull(), F.col("_parts")).otherwise(F.transform(left, lambda i: F.get("_parts", i)))
    text = F.array_join(kept, "\n")
    return joined.select(*[(text if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns], F.col("removed").alias(name))


def drop_repeated_lines(docs: DataFrame, characters: bool = False) -> DataFrame:
    """docs without repeated lines; a document left with nothing but white space goes."""
    removed = free_name(docs, "removed")
    out = dedup_lines(docs, characters, removed)
    return out.where(F.col(removed).isNull() | F.col("text").rlike(r"\S")).drop(removed)
