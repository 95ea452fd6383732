"""Recurring lines by a log-template tree, in DataFrame functions only.

A line's tokens are masked where they hold a digit. The tree has fixed depth: the number of tokens,
then the leading ``DEPTH`` tokens; a path ends in a leaf. Within a leaf a token that is rare at its
place is a variable field, and so is a masked one however common, so a line's template is the sequence
of its tokens with variable ones replaced. A template with enough constant tokens that recurs across documents is boilerplate, and
all its lines are dropped.

Copies of one document would make all their lines recur. So a template recurs when it is in
``MIN_DOCUMENTS`` different texts no two of which are copies, and a passage (whole lines on end, of
``PASSAGE_TOKENS`` tokens together) when it is in two. Two texts are copies by what they hold *outside*
the lines that they share: if one holds nothing else (and ``HELD_PERCENT`` is shared), or if the neighbouring tokens of the rest overlap
by ``COPY_PERCENT``, as estimated from the lowest hashes of each. So pages that are mostly template are
no copies while what they have of their own differs. A token is constant by the number of different
texts, copies included, that have it at its place.

A text is known by its size and a 64-bit hash. Only leaves and lines that recur are looked into. Equal
masked lines of a leaf are one pattern: tokens are counted once per pattern, with the first
``MIN_DOCUMENTS`` texts that have it, which settles whether a token is in so many. A template is a sum of
hashes, so no line or group is ever gathered.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..operators.joins import fits_broadcast, lookup_join, possible, sieved_join, spread_join
from ..session import cut_lineage

DEPTH = 3
# Texts in which a token, and a template, must occur.
MIN_DOCUMENTS = 4
MIN_TOKENS = 3
# Whole lines of so many tokens recur from two texts on.
PASSAGE_TOKENS = 50
# Lowest hashes that a text is known by; the percentage of overlap outside shared lines that makes a copy (set low, as
# short texts leave few hashes to estimate it from: a near copy of 65 % was taken for less than 60); and the
# percentage that is shared where one text holds the other.
SKETCH = 64
COPY_PERCENT = 30
HELD_PERCENT = 60
# Of a template's tokens at least this many percent are constant.
CONSTANT_PERCENT = 80
# A key's largest texts, which are compared before all others are.
LEADING = 8
# Copies of one text that one task takes for the join of its dropped lines.
ROWS_PER_SALT = 20_000
_MASK = "<*>"


def _spaced(text: Column) -> Column:
    """Single spaces for runs of the characters [\\x20\\x09\\x0B-\\x0D]; most texts are so already."""
    odd = F.contains(text, F.lit("  "))
    for blank in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(blank))
    return F.when(odd, F.regexp_replace(text, r"[\x20\t\x0B\f\r]+", " ")).otherwise(text)


def _masked(tokens: Column) -> Column:
    """Tokens (single spaces between) that hold a digit, masked."""
    # Possessive from each token's start, so a long token is passed over once.
    return F.when(tokens.rlike("[0-9]"), F.regexp_replace(tokens, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", _MASK)).otherwise(tokens)


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _identity(text: Column) -> list[Column]:
    return [F.octet_length(text).alias("row_size"), F.xxhash64(text).alias("row_hash")]


def _lines(df: DataFrame, text_col: str) -> DataFrame:
    """row_size and row_hash (of the text), place among the lines that are not blank, line_no, line, size in tokens, leaf.

    The leaf takes the number of tokens and the leading ones only; lines with too few tokens have none.
    """
    text = _text(text_col)
    numbered = F.transform(F.split(_spaced(text), "\n"), lambda line, n: F.struct(n.alias("line_no"), F.trim(line).alias("line")))
    rows = df.select(*_identity(text), F.posexplode(F.filter(numbered, lambda x: x["line"] != "")).alias("place", "at"))
    size = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    leading = _masked(F.substring_index("line", " ", DEPTH))
    return (
        rows.select("row_size", "row_hash", "place", "at.line_no", "at.line").withColumn("size", size)
        .withColumn("leaf", F.when(F.col("size") >= MIN_TOKENS, F.xxhash64("size", leading))))


def _in_documents(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur in enough texts."""
    return (
        df.select(*keys, "row_hash").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"))
        .where(F.col("documents") >= MIN_DOCUMENTS).select(*keys))


def _sketches(df: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """row_hash, sketch of the given texts: their lowest (hash of neighbouring tokens, hash of their line), as one number each.

    There may be sketches of other texts too. No text is shuffled.
    """
    text = _text(text_col)
    rows = df.select(F.xxhash64(text).alias("row_hash"), text.alias("text"))
    if fits_broadcast(texts):
        wanted = rows.join(F.broadcast(texts), "row_hash", "left_semi")
    else:
        wanted = possible(rows, texts, ["row_hash"], "wanted").where("wanted")
    trimmed = F.transform(F.split(_spaced(F.col("text")), "\n"), lambda line: F.trim(line))
    lines = F.transform(F.filter(trimmed, lambda line: line != ""),
                        lambda line: F.struct(F.split(line, " ").alias("tokens"), F.hash(line).cast("long").bitwiseAND(0xFFFFFFFF).alias("line")))
    pairs = F.flatten(F.transform(lines, lambda x: F.zip_with(
        x["tokens"], F.slice(x["tokens"], 2, F.greatest(F.size(x["tokens"]) - 1, F.lit(0))),
        lambda a, b: F.shiftleft(F.hash(a, b).cast("long"), 32).bitwiseOR(x["line"]))))
    sketch = F.slice(F.sort_array(F.array_distinct(pairs)), 1, SKETCH)
    return wanted.select("row_hash", sketch.alias("sketch")).groupBy("row_hash").agg(F.min("sketch").alias("sketch"))


def _copies(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those pairs (row_hash, first) that are copies."""
    firsts = sieved_join(sketches, pairs.select(F.col("first").alias("row_hash")).distinct(), "row_hash", "left_semi")
    known = cut_lineage(firsts.select(F.col("row_hash").alias("first"), F.col("sketch").alias("other")))
    both = lookup_join(pairs.join(sketches, "row_hash"), known, "first").withColumn(
        "lowest", F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH))

    def own(one: str, other: str) -> Column:
        rest = F.array_except(F.array_intersect("lowest", one), other)
        return F.array_distinct(F.transform(rest, lambda x: F.shiftright(x, 32)))

    # Neighbouring tokens outside the lines that both have.
    shared = F.size(F.array_intersect(F.array_intersect("sketch", "other"), F.col("lowest")))
    sets = F.struct(F.size("lowest").alias("n"), shared.alias("shared"), own("sketch", "other").alias("one"), own("other", "sketch").alias("two"))
    # A filter is pushed through columns, and then takes each use of a set as a computation of its own; not through rows made.
    rests = both.select("row_hash", "first", F.explode(F.array(sets)).alias("of")).select("row_hash", "first", "of.*")
    alike = F.size(F.array_intersect("one", "two")) * 100 >= F.size(F.array_union("one", "two")) * COPY_PERCENT
    held = ((F.size("one") == 0) | (F.size("two") == 0)) & (F.col("shared") * 100 >= F.col("n") * HELD_PERCENT)
    return rests.where(alike | held).select("row_hash", "first")


def _enough(found: DataFrame, least: int) -> DataFrame:
    """key, row_size, row_hash of the keys in at least so many texts, each text once."""
    texts = found.select("key", "row_size", "row_hash").distinct()
    enough = cut_lineage(texts.groupBy("key").count().where(F.col("count") >= least).select("key"))
    return cut_lineage(lookup_join(texts, enough, "key"))


def _unlike(left: DataFrame, sketches: DataFrame) -> DataFrame:
    """least, key of those in ``least`` texts no two of which are copies.

    Of each key the largest text (then that of the highest hash) is taken and its copies are left out, until
    enough are taken. A text that holds little but the key comes late, so it does not stand for all others.
    """
    found = []
    for enough in range(2, MIN_DOCUMENTS + 1):
        first = cut_lineage(left.groupBy("least", "key").agg(F.max(F.struct("row_size", "row_hash"))["row_hash"].alias("first")))
        beside = cut_lineage(lookup_join(left, first, ["least", "key"]).where(F.col("row_hash") != F.col("first")))
        copies = cut_lineage(_copies(cut_lineage(beside.select("row_hash", "first").distinct()), sketches))
        left = cut_lineage(lookup_join(beside, copies, ["row_hash", "first"], "left_anti").select(*left.columns))
        found.append(left.where(F.col("least") == enough).select("least", "key").distinct())
        left = left.where(F.col("least") > enough)
    return cut_lineage(functools.reduce(DataFrame.unionByName, found))


def _recurring(df: DataFrame, holders: DataFrame, text_col: str) -> DataFrame:
    """least, key of the keys of ``holders`` (least, key, row_size, row_hash) in ``least`` texts no two of which are copies.

    Texts are taken from the largest on, so a key that has enough among its first few needs no more of them;
    only of the other keys all texts are compared.
    """
    def found(held: DataFrame) -> DataFrame:
        return _unlike(held, cut_lineage(_sketches(df, cut_lineage(held.select("row_hash").distinct()), text_col)))

    order = Window.partitionBy("least", "key").orderBy(F.desc("row_size"), F.desc("row_hash"))
    leading = found(cut_lineage(holders.withColumn("n", F.row_number().over(order)).where(F.col("n") <= LEADING).drop("n")))
    more = holders.groupBy("least", "key").count().where(F.col("count") > LEADING).drop("count")
    undecided = cut_lineage(more.join(leading, ["least", "key"], "left_anti"))
    if undecided.isEmpty():
        return leading
    return cut_lineage(leading.unionByName(found(cut_lineage(lookup_join(holders, undecided, ["least", "key"])))))


def _patterns(df: DataFrame, lines: DataFrame, leaves: DataFrame, text_col: str) -> DataFrame:
    """leaf, pattern, masked, some: the distinct masked lines of the leaves, with the first few texts of each."""
    texts = sieved_join(lines.select("leaf", "pattern", "row_hash", "line_no"), leaves, "leaf").groupBy(
        "leaf", "pattern", "row_hash").agg(F.min("line_no").alias("line_no"))
    order = Window.partitionBy("leaf", "pattern").orderBy("row_hash")
    some = cut_lineage(
        texts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MIN_DOCUMENTS)
        .groupBy("leaf", "pattern").agg(F.collect_list("row_hash").alias("some"), F.min(F.struct("row_hash", "line_no")).alias("at")))
    # Equal patterns are read in one place only, so few texts are cut into lines again.
    at = cut_lineage(some.select("leaf", "pattern", "at.row_hash", "at.line_no"))
    text = _text(text_col)
    rows, read = df.select(F.xxhash64(text).alias("row_hash"), text.alias("text")), cut_lineage(at.select("row_hash").distinct())
    # A text too many does no harm here, so no text is shuffled.
    held = rows.join(F.broadcast(read), "row_hash", "left_semi") if fits_broadcast(read) else possible(rows, read, ["row_hash"], "held").where("held")
    inner = sieved_join(_lines(held, "text").select("row_hash", "line_no", "line"), at, ["row_hash", "line_no"])
    masked = inner.groupBy("leaf", "pattern").agg(F.min(_masked(F.col("line"))).alias("masked"))
    return cut_lineage(masked.join(some.drop("at"), ["leaf", "pattern"]))


def _templates(df: DataFrame, hashed: DataFrame, text_col: str) -> DataFrame:
    """row_size, row_hash, line_no, key of every line with enough tokens and constant ones among them."""
    lines = hashed.where("leaf IS NOT NULL").select("row_size", "row_hash", "line_no", "leaf", "pattern")
    leaves = cut_lineage(_in_documents(lines, "leaf"))
    patterns = _patterns(df, lines, leaves, text_col)
    tokens = patterns.select("leaf", "pattern", "some", F.posexplode(F.split("masked", " ")).alias("place", "word")).withColumn(
        "token", F.xxhash64("word")).drop("word")
    # A mask stands for different tokens: it is part of the template, but never constant.
    mask = F.xxhash64(F.lit(_MASK))
    held = tokens.where(F.col("token") != mask).select("leaf", "place", "token", F.explode("some").alias("row_hash"))
    constant = cut_lineage(_in_documents(held, "leaf", "place", "token").withColumn("constant", F.lit(1)))
    marked = lookup_join(tokens.drop("some"), constant, ["leaf", "place", "token"], "left").withColumn("constant", F.coalesce("constant", F.lit(0)))
    field = F.when((F.col("constant") == 1) | (F.col("token") == mask), F.col("token")).otherwise(F.lit(0).cast("long"))
    # A sum of hashes over places, in halves so that it cannot overflow.
    whole = F.xxhash64("place", field)
    keys = cut_lineage(
        marked.groupBy("leaf", "pattern")
        .agg(F.sum(F.shiftright(whole, 32)).alias("high"), F.sum(whole.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
             F.sum("constant").alias("constant"), F.count(F.lit(1)).alias("n"))
        .where(F.col("constant") * 100 >= F.col("n") * CONSTANT_PERCENT)
        .select("leaf", "pattern", F.xxhash64("leaf", "high", "low").alias("key")))
    return cut_lineage(sieved_join(lines, keys, ["leaf", "pattern"]).select("row_size", "row_hash", "line_no", "key"))


def _passages(hashed: DataFrame) -> DataFrame:
    """row_size, row_hash, key, numbers (of the lines) of the shortest passages from each line on and up to it.

    Together they hold every line of every longer passage. Only lines of two texts are looked at.
    """
    hashed = hashed.select("row_size", "row_hash", "place", "line_no", F.col("size").cast("long").alias("size"), "line_hash")
    shared = cut_lineage(
        hashed.groupBy("line_hash").agg(F.min("row_hash").alias("least"), F.max("row_hash").alias("most"))
        .where(F.col("least") != F.col("most")).select("line_hash"))
    # Rows that repeat a text are one.
    inner = sieved_join(hashed, shared, "line_hash").dropDuplicates(["row_size", "row_hash", "place"])
    row = Window.partitionBy("row_size", "row_hash").orderBy("place")
    line = F.struct("place", "line_no", "size", "line_hash", "upto")
    # A line has a token at least, so this many lines are enough.
    sides = inner.withColumn("upto", F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, 0))).select(
        "row_size", "row_hash", F.collect_list(line).over(row.rowsBetween(0, PASSAGE_TOKENS - 1)).alias("on"),
        F.collect_list(line).over(row.rowsBetween(1 - PASSAGE_TOKENS, 0)).alias("back"), line.alias("own"))
    own = F.col("own")
    on = F.filter("on", lambda x: x["upto"] - x["size"] - own["upto"] + own["size"] < PASSAGE_TOKENS)
    back = F.filter("back", lambda x: own["upto"] - x["upto"] < PASSAGE_TOKENS)
    both = sides.select("row_size", "row_hash", F.explode(F.array(on, back)).alias("run"))
    first, last = F.element_at("run", 1), F.element_at("run", -1)
    return cut_lineage(
        both.where((last["upto"] - first["upto"] + first["size"] >= PASSAGE_TOKENS) & (last["place"] - first["place"] == F.size("run") - 1))
        .select("row_size", "row_hash", F.xxhash64(F.transform("run", lambda x: x["line_hash"])).alias("key"),
                F.transform("run", lambda x: x["line_no"]).alias("numbers")))


def recurring_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """row_size, row_hash (of the text), line_no of every line whose template, or a passage that holds it, recurs across documents.

    Each text is told of once, however many rows have it. A null text counts as empty; it has no line, and an empty table none.
    """
    hashed = cut_lineage(_lines(df, text_col).select(
        "row_size", "row_hash", "place", "line_no", "size", "leaf", F.xxhash64("line").alias("line_hash"),
        F.when(F.col("size") >= MIN_TOKENS, F.xxhash64(_masked(F.col("line")))).alias("pattern")))
    templates, passages = _templates(df, hashed, text_col), _passages(hashed)
    several, twice = _enough(templates, MIN_DOCUMENTS), _enough(passages, 2)
    holders = cut_lineage(
        several.select(F.lit(MIN_DOCUMENTS).alias("least"), "*").unionByName(twice.select(F.lit(2).alias("least"), "*")))
    keys = _recurring(df, holders, text_col)
    alone = lookup_join(templates, keys.where(F.col("least") == MIN_DOCUMENTS).select("key"), "key", "left_semi")
    runs = lookup_join(passages, keys.where(F.col("least") == 2).select("key"), "key", "left_semi")
    return alone.select("row_size", "row_hash", "line_no").unionByName(
        runs.select("row_size", "row_hash", F.explode("numbers").alias("line_no"))).distinct()


def _cleaned(df: DataFrame, text_col: str) -> DataFrame:
    """row (all columns), cleaned text, and counts of lines and of dropped ones."""
    # Numbers of one text's own lines: bounded by the text.
    dropped = cut_lineage(
        recurring_lines(df, text_col).groupBy("row_size", "row_hash").agg(F.sort_array(F.collect_set("line_no")).alias("numbers")))
    plain = [F.col(f"`{field.name}`") for field in df.schema if not isinstance(field.dataType, (ArrayType, MapType, StructType))]
    rows = df.select(F.struct(*[F.col(f"`{column}`") for column in df.columns]).alias("row"), *_identity(_text(text_col)),
                     F.xxhash64(*plain).alias("spread"))
    # A shuffle at every size: how much is dropped does not change the plan. Copies of one text spread, and most rows that lose nothing stay where they are.
    sieve = possible(rows, dropped, ["row_size", "row_hash"], "possible")
    joined = spread_join(sieve.where("possible"), dropped.hint("merge"), ["row_size", "row_hash"], "left", ROWS_PER_SALT, ["spread"])
    joined = joined.select("row", "numbers").unionByName(
        sieve.where("NOT possible").select("row", F.lit(None).cast(dropped.schema["numbers"].dataType).alias("numbers")))
    raw = F.col("row")[text_col]
    lines = F.split(F.coalesce(raw.cast("string"), F.lit("")), "\n")
    numbered = F.transform(lines, lambda line, n: F.struct(line.alias("line"), n.alias("n")))
    kept = F.filter(numbered, lambda x: ~F.array_contains("numbers", x["n"]))
    cleaned = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    return joined.select(
        "row", F.size(lines).alias("lines"), F.coalesce(F.size("numbers"), F.lit(0)).alias("dropped"),
        F.when(F.col("numbers").isNull(), raw).otherwise(cleaned).alias("cleaned"))


def drop_recurring_lines(
    df: DataFrame, text_col: str = "text", drop_emptied: bool = False,
) -> DataFrame:
    """The table with recurring lines taken out of ``text_col``; all other columns as they are.

    Lines end at ``\\n``; those with fewer than ``MIN_TOKENS`` tokens stay, unless a passage holds them. A null text stays null. Rows that
    repeat a text get equal results, whatever their ids. An empty table stays empty. With
    ``drop_emptied``, rows that had nothing but recurring lines go.
    """
    cleaned = _cleaned(df, text_col)
    if drop_emptied:
        cleaned = cleaned.where((F.col("dropped") == 0) | (F.trim("cleaned") != ""))
    return cleaned.select(*[
        (F.col("cleaned") if column == text_col else F.col("row")[column]).alias(column) for column in df.columns])


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, n_chars, text_sha256: one row per input row, of the cleaned text.

    A null text counts as empty (one line). See :func:`drop_recurring_lines`.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    text = F.coalesce("cleaned", F.lit(""))
    return _cleaned(rows, "text").select(
        "row.doc_id", F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"),
        F.length(text).alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))
