"""Removal of lines that repeat across documents, by pieces of neighbouring lines. DataFrame functions only.

Every two neighbouring lines are a piece, with the lines without words between them, and every long line is one of its own, so
that what stands beside a passage does not decide whether it is found. Pieces with equal hashes are copies once their bytes are
compared with the first occurrence. Copies that overlap or touch join to runs; a run of several lines, or of one long line, goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import copied_out, dealt_out, hot, row_key, settle, spare

#: Words from which a line is a piece of its own and goes alone.
LONG_LINE = 40
#: Words that a repeated run of several lines has at least.
RUN_WORDS = 16


#: A word is a run of characters that are not white, in any script.
WORD = r"[^\s\p{Z}]+"


def _word_count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _pieces(lines: Column, long_line: int) -> Column:
    """array<struct<start, lines, hash>>: the pieces of an array of lines, numbered from 0."""

    def piece(all_lines: Column, start: Column, end: Column) -> Column:
        n = end - start + 1
        return F.struct(start.cast("int").alias("start"), n.cast("int").alias("lines"), F.xxhash64(F.slice(all_lines, start + 1, n)).alias("hash"))

    def cut(all_lines: Column, words: Column) -> Column:
        at = F.filter(F.transform(words, lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())
        single = F.transform(F.filter(at, lambda i: words[i] >= long_line), lambda i: piece(all_lines, i, i))

        def pairs(at: Column) -> Column:
            ends = F.filter(F.transform(at, lambda i, k: F.struct(i.alias("i"), F.get(at, k + 1).alias("j"))), lambda p: p["j"].isNotNull())
            # two long lines side by side are found one by one
            ends = F.filter(ends, lambda p: (p["j"] > p["i"] + 1) | (words[p["i"]] < long_line) | (words[p["j"]] < long_line))
            return F.transform(ends, lambda p: piece(all_lines, p["i"], p["j"]))

        return F.concat(single, _bind(at, pairs))

    return _bind(lines, lambda ls: _bind(F.transform(ls, _word_count), lambda words: cut(ls, words)))


def repeated_lines(docs: DataFrame, long_line: int = LONG_LINE, run_words: int = RUN_WORDS) -> DataFrame:
    """(row long, first int, last int): ranges of lines, from 0, that go from the document with that hash of doc_id and text.

    Every line's first occurrence, by doc_id (null last), hash and place, stays.
    """
    (row,) = spare(docs, "line_row")
    return _ranges(docs.withColumn(row, row_key()), row, long_line, run_words)


def _ranges(keyed: DataFrame, row: str, long_line: int, run_words: int) -> DataFrame:
    lines = F.split("text", "\n")
    found = keyed.where("text is not null").select("doc_id", F.col(row).alias("row"), F.explode_outer(_pieces(lines, long_line)).alias("p")).where("p is not null")
    # start and number of lines in one long, which sorts by start. Few hashes repeat: only their pieces are written, the others are made twice
    narrow = found.select("doc_id", "row", (F.shiftleft(F.col("p.start").cast("long"), 32) + F.col("p.lines")).alias("span"), "p.hash")
    several = settle(narrow.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), few=True)
    frequent = hot(several, "hash")  # their pieces are dealt over tasks, and what they are compared with goes to each
    narrow = settle(dealt_out(narrow, "hash", frequent, "row", "span").join(copied_out(several.select("hash"), "hash", frequent), ["hash", "deal"], "left_semi"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "span")
    groups = narrow.groupBy("hash").agg(F.min(place).alias("first"))
    groups = settle(groups.select("hash", F.col("first.row").alias("from_row"), F.col("first.span").alias("from_span")))
    # what overlaps its own first occurrence, as in a line said three times over, is no copy
    apart = (F.col("row") != F.col("from_row")) | (F.shiftright("span", 32) >= F.shiftright("from_span", 32) + F.col("from_span").bitwiseAND(2**32 - 1))
    copies = narrow.join(copied_out(groups, "hash", frequent), ["hash", "deal"]).where(apart).select("row", "span", "hash", F.lit(True).alias("copy"))

    # first occurrences and claimed copies are cut out of the texts together, each text split once. The condition needs all columns of the
    # documents and the pieces, so the texts are dealt by row with all their columns, and the last join of dedup_lines can read the same exchange again
    firsts = groups.select(F.col("from_row").alias("row"), F.col("from_span").alias("span"), "hash", F.lit(False).alias("copy"))
    pieces = copies.distinct().unionByName(firsts).groupBy(F.col("row").alias("piece_row")).agg(F.collect_list(F.struct("span", "hash", "copy")).alias("piece_list"))
    whole = F.hash(*[F.col(c) for c in keyed.columns if c != "text"], F.size("piece_list")) >= -(2**31)
    cut = keyed.join(pieces, F.col(row) == F.col("piece_row")).where(whole)

    def say(all_lines: Column, p: Column) -> Column:
        start, n = F.shiftright(p["span"], 32).cast("int"), p["span"].bitwiseAND(2**32 - 1).cast("int")
        own = F.slice(all_lines, start + 1, n)
        words = lambda some: F.aggregate(some, F.lit(0), lambda a, x: a + _word_count(x))
        return F.struct(
            start.alias("start"),
            (start + n - 1).alias("end"),
            p["hash"].alias("hash"),
            p["copy"].alias("copy"),
            F.when(p["copy"], words(own)).alias("words"),
            F.when(p["copy"], words(F.slice(own, 1, 1))).alias("head"),
            F.array_join(own, "\n").alias("said"),
        )

    cut = cut.select("piece_row", "piece_list", "text").select(F.col("piece_row").alias("row"), F.inline_outer(_bind(lines, lambda ls: F.transform("piece_list", lambda p: say(ls, p)))))
    originals = cut.where("not copy").groupBy("hash").agg(F.first("said").alias("original"))
    claimed = dealt_out(cut.where("copy"), "hash", frequent, "row", "start")
    same = claimed.join(copied_out(originals, "hash", frequent), ["hash", "deal"]).where(F.encode("said", "utf-8") == F.encode("original", "utf-8")).select("row", "start", "end", "words", "head").distinct()

    order = Window.partitionBy("row").orderBy("start", "end")  # the pieces of one document
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = same.withColumn("reach", reach).withColumn("begins", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + 1), 1).otherwise(0))
    # of a piece whose first line is already in the run, the other lines count
    counted = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("words")).when(F.col("end") > F.col("reach"), F.col("words") - F.col("head")).otherwise(0)
    new = new.withColumn("counted", counted).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = new.groupBy("row", "run").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.sum("counted").alias("words"))
    return runs.where(((F.col("last") > F.col("first")) & (F.col("words") >= run_words)) | (F.col("words") >= long_line)).select("row", "first", "last")


def dedup_lines(docs: DataFrame, counts: bool = False, **how) -> DataFrame:
    """docs with their text less the repeated runs of lines; a document that loses all has an empty text, a null text stays null.

    Rows equal in doc_id and text are one document, treated alike. With counts, n_lines and n_removed (longs) follow the columns;
    all other columns stay as they are.
    """
    row, ranges = spare(docs, "line_row", "line_ranges")
    keyed = docs.withColumn(row, row_key())
    how = {"long_line": LONG_LINE, "run_words": RUN_WORDS, **how}
    gone = _ranges(keyed, row, **how).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias(ranges)).withColumnRenamed("row", row)
    joined = keyed.join(gone, row, "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists(ranges, lambda r: (i >= r["first"]) & (i <= r["last"])))
    removed = F.aggregate(ranges, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    extra = [
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    ]
    text = F.when(F.col(ranges).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    return joined.select(*[text if c == "text" else F.col(c) for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))], *(extra if counts else []))
