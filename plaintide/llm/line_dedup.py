"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Lines within ``threshold`` edits share one of threshold + 1 segments of the shorter line, at
nearly the same place.  Each distinct line is indexed by the hashes of its own segments
and probes with the substrings that could be a segment of a line of its length or up to
``threshold`` shorter.  Pairs that meet under a key are verified by Spark's banded edit
distance, as DataFrame functions offer no bit-parallel one.  A line goes when an equal or linked
line stands earlier.

Short lines take part as well, with fewer edits: a pair may differ by one edit for every
EDIT_CHARS characters of its shorter line, up to ``threshold``.  Below EDIT_CHARS only equal
lines belong together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintide.llm.common import fresh, sieve, written

THRESHOLD = 2
EDIT_CHARS = 10
BLOCK = 64  # lines that are compared with as many others at a time
#: Blanks that are cut from both ends of a line.
BLANKS = "\t\v\f\r "


def lines_of(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(place, line, n, h1, h2) of all lines with at least ``min_chars`` characters.

    ``place`` orders lines: by document id (null ids last), row, line number.  ``h1``, ``h2``
    together name the line's content.
    """
    # rows are numbered before they are spread into lines
    whole = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = whole.select("id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    line = F.btrim("raw", F.lit(BLANKS))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row", "line_no")
    return (
        rows.select(place.alias("place"), line.alias("line"))
        .withColumn("n", F.char_length("line"))
        .filter(F.col("n") >= min_chars)
        .withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    )


def _slots(threshold: int) -> list[tuple[int, int, int]]:
    """(less, segment, shift) of the substrings that a line looks up, in order; a line's own segments are those with 0, i, 0.

    With i segments to the left and threshold - i to the right of segment i, more edits than
    there are segments on one side leave a segment intact on that side, which finds the
    pair as well; so only small shifts need to be probed.
    """
    return [
        (less, i, shift)
        for less in range(threshold + 1) for i in range(threshold + 1) for shift in range(-i, i + 1) if abs(shift - less) <= threshold - i
    ]


def entries(lines: DataFrame, threshold: int) -> DataFrame:
    """(h1, h2, key, slot, own): a row per substring that a line looks up; its own segments are also the index.

    The length of the shorter line of a pair gives its edits and with them the number of
    segments.  One expression serves all slots, so it stays small enough to be compiled, and
    lines of ASCII are cut by bytes, where no characters need to be counted.
    """
    slots = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip((k, *slot), ("slot", "less", "segment", "shift"))]) for k, slot in enumerate(_slots(threshold))])
    plain = F.when(F.octet_length("line") == F.col("n"), F.col("line").cast("binary")).alias("bytes")
    rows = lines.filter(F.col("n") >= EDIT_CHARS).select("h1", "h2", "n", "line", plain, F.inline(slots))
    rows = rows.withColumn("length", F.col("n") - F.col("less"))
    rows = rows.withColumn("edits", F.least(F.lit(threshold), F.floor(F.col("length") / EDIT_CHARS)).cast("int"))
    rows = rows.filter((F.greatest("segment", "less") <= F.col("edits")) & (F.abs(F.col("shift") - F.col("less")) <= F.col("edits") - F.col("segment")))
    # the last segments take what is left over
    base = F.floor(F.col("length") / (F.col("edits") + 1)).cast("int")
    short = F.col("edits") + 1 - F.pmod(F.col("length"), F.col("edits") + 1)
    rows = rows.withColumns({
        "start": F.col("segment") * base + F.greatest(F.col("segment") - short, F.lit(0)) + F.col("shift") + 1,
        "size": base + (F.col("segment") >= short).cast("int"),
    })
    cut = F.when(F.col("bytes").isNotNull(), F.substr("bytes", "start", "size")).otherwise(F.substr("line", "start", "size").cast("binary"))
    own = (F.col("less") == 0) & (F.col("shift") == 0)
    return rows.select("h1", "h2", F.xxhash64("length", "segment", cut).alias("key"), "slot", own.alias("own"))


def shared_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """(h1, h2, slots): the (slot, key, own) that a line shares with another line, in the order of slots.

    Keys are counted in the tasks first, so a hot one is a number; keys with a single line or
    without an indexed line are dropped, and only the other entries are moved.
    """
    found = entries(lines, threshold)
    counts = found.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max(F.col("own").cast("int")).alias("owned"))
    keys = written(counts.filter((F.col("low") != F.col("high")) & (F.col("owned") == 1)).select("key"))
    held = sieve(found, keys, "key").filter("_maybe").drop("_maybe").distinct().join(keys, "key", "left_semi")
    return held.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("slot", "key", "own"))).alias("slots"))


def _bind(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _compared(probes: Column, owners: Column, key: Column, threshold: int) -> Column:
    """Of each line of both blocks the number of linked lines in the other and the first place of one.

    The longer line of a pair probes, of equally long ones the one with the larger name.  A pair that
    shares several keys counts under the first that the probing line looks up.
    """

    def linked(p: Column, x: Column) -> Column:
        longer = (p["n"] > x["n"]) | (p["n"] == x["n"]) & ((p["h1"] > x["h1"]) | (p["h1"] == x["h1"]) & (p["h2"] > x["h2"]))
        first = F.filter(p["keys"], lambda k: F.array_contains(x["own"], k))
        allowed = F.least(F.lit(threshold), F.floor(x["n"] / EDIT_CHARS)).cast("int")
        close = F.levenshtein(p["line"], x["line"], threshold)
        return longer & (p["n"] - x["n"] <= allowed) & (F.get(first, F.lit(0)) == key) & (close >= 0) & (close <= allowed)

    def summed(line: Column, near: Column) -> Column:
        return F.struct(line["h1"].alias("h1"), line["h2"].alias("h2"), F.size(near).alias("n"), F.array_min(near).alias("nearest"))

    def both(table: Column) -> Column:
        there = F.transform(probes, lambda p, i: summed(p, F.transform(F.filter(F.get(table, i), lambda y: y >= 0), lambda y: F.get(owners, y)["first"])))
        back = F.transform(owners, lambda x, j: summed(x, F.filter(F.transform(probes, lambda p, i: F.when(F.get(F.get(table, i), j) >= 0, p["first"])), lambda f: f.isNotNull())))
        return F.concat(there, back)

    return _bind(F.transform(probes, lambda p: F.transform(owners, lambda x, j: F.when(linked(p, x), j).otherwise(-1))), both)


def links(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(h1, h2, n_links, nearest) of lines with a different line within the allowed edits.

    ``nearest`` is the first place of such a line.  The lines of a key are dealt into blocks
    of about BLOCK, and blocks are compared as a whole: no table holds the pairs of a key.
    """
    keys = written(shared_keys(lines, threshold))
    sifted = sieve(lines, keys, "h1").filter("_maybe")
    texts = sifted.join(keys.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line"), F.min("place").alias("first"))
    texts = written(texts.join(keys, ["h1", "h2"]).withColumn("n", F.char_length("line")))
    spread = keys.select("h1", "h2", F.inline("slots")).groupBy("h1", "h2", "key").agg(F.max("own").alias("own"))
    sizes = spread.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    every = texts.withColumn("key", F.explode(F.array_distinct("slots.key"))).join(sizes, "key")
    part = F.pmod(F.xxhash64("h1", "h2"), F.col("parts")).alias("part")
    own = F.transform(F.filter("slots", lambda s: s["own"]), lambda s: s["key"])
    line = ["h1", "h2", "n", "line", "first"]
    probes = every.groupBy("key", part).agg(F.collect_list(F.struct(*line, F.col("slots.key").alias("keys"))).alias("probes"))
    owners = every.filter(F.array_contains(own, F.col("key"))).groupBy("key", part).agg(F.collect_list(F.struct(*line, own.alias("own"))).alias("owners"))
    pairs = probes.drop("part").join(owners.drop("part"), "key")
    found = pairs.select(F.inline(_compared(F.col("probes"), F.col("owners"), F.col("key"), threshold)))
    return found.filter("n > 0").groupBy("h1", "h2").agg(F.sum("n").alias("n_links"), F.min("nearest").alias("nearest"))


def judged_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, min_chars: int = 1) -> DataFrame:
    """One row per line of at least ``min_chars`` characters: where it stands, its class, its links, whether it stays.

    Columns: place, first (place of the first equal line: the class), copies, n_links (different
    lines within the allowed edits), kept.  Lines are compared without blanks at both ends;
    shorter lines, empty lines and null texts give no row and always stay.  Lines come in
    order of document id, null ids last, then row, then number, so one of repeated rows is the
    first.  A line goes when an equal line or a linked line comes before it.
    """
    # five passes read the lines: texts are split and hashed once
    lines = written(lines_of(docs, id_col, text, min_chars))
    near = links(lines, threshold)
    narrow = lines.select("place", "h1", "h2")
    classes = narrow.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = classes.join(near, ["h1", "h2"], "left").filter((F.col("copies") > 1) | F.col("n_links").isNotNull())
    return narrow.join(classes, ["h1", "h2"], "left").select(
        "place",
        F.coalesce("first", "place").alias("first"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.col("first").isNull() | (F.col("place") == F.col("first")) & F.coalesce(F.col("nearest") > F.col("first"), F.lit(True))).alias("kept"),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 1, **options) -> DataFrame:
    """``docs`` without the lines that ``judged_lines`` lets go, all columns as they were.

    Every line that isn't blank takes part.  A document left without any text goes, unless it had none before.  ``docs`` must be a table.
    """
    row, gone, kept_text = fresh(docs, "_row", "_gone", "_kept")
    dropped = judged_lines(docs, id_col, text, min_chars=min_chars, **options).filter(~F.col("kept"))
    dropped = dropped.groupBy(F.col("place.row").alias(row)).agg(F.collect_list("place.line_no").alias(gone))
    joined = docs.withColumn(row, F.monotonically_increasing_id()).join(dropped, row, "left")
    stays_at = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = _bind(F.split(F.col(text), "\n"), lambda lines: F.transform(stays_at(lines), lambda i: F.get(lines, i)))
    changed = F.col(gone).isNotNull()
    joined = joined.withColumn(kept_text, F.when(changed, F.array_join(left, "\n")).otherwise(F.col(text)))
    stays = ~changed | (F.btrim(kept_text, F.lit(BLANKS + "\n")) != "")
    return joined.filter(stays).withColumn(text, F.col(kept_text)).select(*docs.columns)
