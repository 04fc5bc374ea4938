"""Per-document text statistics, and the kind of text they show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are not seen: soft hyphen, zero-width space and joiners, word joiner, byte order mark.
INVISIBLE = "­​‌‍⁠﻿"
#: Vowels of the scripts the texts are in.
VOWELS = "aeiouàáâãäåèéêëìíîïòóôõöùúûüœæаеёиоуыэюя"

#: A line of at least three cells: tabs, bars, ampersands, semicolons or commas without a blank, or columns of blanks with a number among them.
ROW = r"(?m)^(?=[^\n]{3,400}$)(?![^\n]*[\p{L})][.!?…]\s+\p{Lu}\p{Ll})(?:\s*\S[^\n\t]*\t[^\n\t]*\t[^\n]*|[^\n|]*\|[^\n|]*\|[^\n]*|[^\n&]+ & [^\n&]+ & [^\n]*|[^\n;]*;[^\s;][^\n;]*;[^\n]*|[^\n,]*,[^\s,][^\n,]*,[^\s][^\n]*|(?=(?:[^\n]* {2})?[\d.,%]+(?: {2}[^\n]*)?$)\S[^\n]*? {2,}\S[^\n]*? {2,}\S[^\n]*|[^\n]*?\S {3,}\S[^\n]*? {2,}\S[^\n]*|[^\n]*?\S {2}\S[^\n]*? {3,}\S[^\n]*|\s*[+|]?-{2,}[-+| ]*)$\n?"
#: A row of a table without letters.
NUMBER_ROW = r"(?m)^[\s|]*-?\d+(?:[.,]\d+)?(?:\s*(?:\t|\||;|,|&| {2,})\s*-?\d+(?:\.\d+)?)+[\s|\\]*$"
#: A list entry: a bullet, a number, a box or a short key before a short text.
ENTRY = r"(?m)^(?=[^\n]{1,160}$)(?:\s*(?:[-*•–—+‣◦·]|\|-|`-|\(?\d{1,4}[.)]|\(?\p{L}[.)]|\[[ xX]?\]|TODO:?)\s+(?![^\n]*[\p{L})][.!?…]\s+\p{Lu}\p{Ll})[^\n]*|\s*\p{L}[\p{L}\p{N}_-]*(?: [\p{L}\p{N}_-]+){0,3}:\s(?![^\n]*[.!?…]$)[^\n]*)$\n?"
_SENTENCE_BREAK = r"[\p{L})][.!?…][\"”»)]*\s+\p{Lu}"


def _length(c: Column) -> Column:
    return F.length(c).cast("bigint")


def plain_text(text: Column) -> Column:
    """Without invisible characters; HTML rows and entries as lines, its cells behind tabs, other tags as blanks."""
    s = F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    hidden = F.lit(False)
    for c in INVISIBLE:
        hidden = hidden | text.contains(c)
    s = F.when(hidden, F.translate(s, INVISIBLE, "")).otherwise(s)
    h = F.regexp_replace(s, r"(?i)<li\b[^<>]{0,80}>", "\n- ")
    h = F.regexp_replace(h, r"(?i)</t[dh]>\s*(?=<t[dh])", "\t")
    h = F.regexp_replace(h, r"(?i)</?(?:tr|p|div|br|h\d|ul|ol|table|blockquote)\b[^<>]{0,80}/?>", "\n")
    h = F.regexp_replace(h, r"</?\p{L}[^<>]{0,80}>", " ")
    return F.when(text.contains("<"), h).otherwise(s)


#: A place where a text may be cut: not within a tag, not between two cells of a row.
_FREE = r"(?![^<>]{0,90}>)(?!\s*<t[dh])"
_BLOCK = r"(?i:</?(?:li|tr|p|div|br|h\d|ul|ol|table|blockquote)\b)"
_BLOCK_START = r"\A\s*" + _BLOCK


def pieces(text: Column, size: int) -> Column:
    """Array of structs: pieces of at most ``size`` characters, and the state at their edges.

    A cut is made behind the last line break of the window, else before its last tag that makes one,
    else behind its last white space, else
    behind its last character that is in no word, else anywhere. ``mid_start`` and ``mid_end`` say
    that a line runs over the edge, ``word_start`` and ``word_end`` that a word does, ``stopped`` that
    a sentence ended before the piece, ``several`` that the text has more than one piece.
    """
    w = r"[\p{L}\p{M}\p{N}'’]"
    cut = F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{size}}}\z|.{{1,{size}}}(?<=\n){_FREE}|.{{1,{size}}}(?={_BLOCK})|.{{1,{size}}}(?<=\s)(?!\n){_FREE}|.{{1,{size}}}(?<!{w}){_FREE}|.{{1,{size}}})"), F.lit(1))

    def state(all: Column, x: Column, i: Column) -> Column:
        def over(a: Column, b: Column) -> Column:
            return ~a.rlike(r"[\n\r]\z") & ~b.rlike(_BLOCK_START)

        before, after = F.get(all, i - 1), F.get(all, i + 1)
        return F.struct(
            x.alias("s"), i.alias("at"), F.coalesce(over(before, x), F.lit(False)).alias("mid_start"), F.coalesce(over(x, after), F.lit(False)).alias("mid_end"),
            F.coalesce(before.rlike(w + r"\z") & x.rlike(r"\A" + w), F.lit(False)).alias("word_start"), F.coalesce(x.rlike(w + r"\z") & after.rlike(r"\A" + w), F.lit(False)).alias("word_end"),
            F.coalesce(before.rlike(r"[\p{L})][.!?…][\"”»)]*\s+\z"), F.lit(False)).alias("stopped"), F.lit(True).alias("several"),
        )

    single = F.array(F.struct(text.alias("s"), F.lit(0).alias("at"), *[F.lit(False).alias(c) for c in ("mid_start", "mid_end", "word_start", "word_end", "stopped", "several")]))
    once = F.get(F.transform(F.array(cut), lambda all: F.transform(all, lambda x, i: state(all, x, i))), F.lit(0))  # the text is cut once, not once for each piece
    return F.when(F.length(text) <= size, single).otherwise(once)


def quality_statistics(df: DataFrame, id: str, text: str, common: Sequence[str], size: int = 32_768) -> DataFrame:
    """One row for each id and text: counts, ratios and ``kind`` (prose, list, table or junk).

    Markup and invisible characters aside, ``words`` are runs of letters and digits with inner
    apostrophes; ``symbol_ratio`` is the share of visible characters that are neither letters nor digits; ``line_end_ratio`` the share of
    non-blank lines that end in punctuation; ``common_ratio`` the share of words among ``common``
    (a fixed short list). A null or blank text has zero counts, null ratios and a null kind.
    Repeated rows of the same id and text give one row. Other columns play no role.

    Texts beyond ``size`` characters are cut into pieces before anything else is done to them;
    each piece gives sums, corrected by what runs over its edges, and the pieces' sums are merged by
    partial and final aggregation. No text is collected or shuffled.
    """
    known = sorted({w.lower() for w in common})
    raw = F.col(f"`{text}`")
    edges = ("mid_start", "mid_end", "word_start", "word_end", "stopped", "several")
    cut = df.select(F.col(f"`{id}`").alias("_id"), F.xxhash64(raw).alias("_h"), F.coalesce(raw.rlike(r"\S"), F.lit(False)).alias("_seen"), F.explode_outer(pieces(raw, size)).alias("_p"))
    part = cut.select("_id", "_h", "_seen", F.col("_p.at").alias("_at"), F.coalesce(plain_text(F.col("_p.s")), F.lit("")).alias("s"), *[F.coalesce(F.col(f"_p.{c}"), F.lit(False)).alias(c) for c in edges])
    part = part.withColumn("low", F.lower("s")).withColumn("w", F.split("low", r"[^\p{L}\p{M}\p{N}'’]+")).withColumn("other", F.regexp_replace("s", r"[\p{L}\p{M}]+", ""))
    # parts of lines at the edges are never rows or entries; they come back behind those rules
    head, tail = F.when(F.col("mid_start"), F.regexp_extract("s", r"\A[^\n]*", 0)), F.when(F.col("mid_end"), F.regexp_extract("s", r"[^\n]*\z", 0))
    part = part.withColumn("head", F.coalesce(head, F.lit(""))).withColumn("tail", F.when(F.col("mid_start") & ~F.col("s").contains("\n"), "").otherwise(F.coalesce(tail, F.lit(""))))
    core = F.when(F.col("mid_start") | F.col("mid_end"), F.expr("substring(s, length(head) + 1, length(s) - length(head) - length(tail))")).otherwise(F.col("s"))
    part = part.withColumn("core", core).withColumn("quoted", F.when(F.col("core").contains(">"), F.regexp_replace("core", r"(?m)^> ?", "")).otherwise(F.col("core")))
    part = part.withColumn("no_rows", F.regexp_replace("quoted", ROW, "")).withColumn("core_left", F.regexp_replace("no_rows", ENTRY, "")).withColumn("no_entries", F.when(F.col("mid_start") | F.col("mid_end"), F.concat("head", "core_left", "tail")).otherwise(F.col("core_left")))
    line_end = r"(?m)[.!?…:;。][\"”»'’)\]]*[ \t]*$"
    edge_length = _length(F.col("head")) + _length(F.col("tail"))
    goes_on = (F.col("mid_start") & F.col("s").rlike(r"\A[ \t]*\S")).cast("bigint")  # its first line was counted by an earlier piece
    # words of a text that keeps saying the same: where the first ones differ, that is settled
    varied = F.size(F.array_distinct(F.array_remove(F.slice("w", 1, 12), ""))) > 3
    different = F.when(~varied, F.array_distinct(F.array_remove("w", "")))
    few = F.when(F.size(different) <= 3, different)

    def place(seed: int) -> Column:
        def mark(m: Column, x: Column) -> Column:
            return m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(x, F.lit(seed)), F.lit(64)).cast("int")))

        return F.coalesce(F.aggregate(few, F.lit(0).cast("bigint"), mark), F.lit(0).cast("bigint"))

    lines_left = F.col("no_entries").contains("\n") | F.col("several")  # list rules need several lines
    sums = {
        # empty strings stand at the ends only, where the text starts or ends with something else
        "words": F.greatest(F.lit(0), F.size("w") - (F.element_at("w", 1) == "").cast("int") - (F.element_at("w", -1) == "").cast("int")) - F.col("word_start").cast("int"),
        "common": F.size(F.filter("w", lambda x: x.isin(known))) - (F.col("word_start") & F.element_at("w", 1).isin(known)).cast("int") - (F.col("word_end") & F.element_at("w", -1).isin(known)).cast("int"),
        "letters": _length(F.col("s")) - _length(F.col("other")),
        "visible": _length(F.col("s")) - _length(F.regexp_replace("other", r"\S+", "")),
        "digits": _length(F.regexp_replace("other", r"[^\p{N}]+", "")),
        "broken": _length(F.regexp_replace("other", "[^�\u0080-\u009f]+", "")),
        "vowels": _length(F.col("low")) - _length(F.translate("low", VOWELS, "")),
        "lines": F.regexp_count("s", F.lit(r"(?m)^[ \t]*[^\s]")) - goes_on,
        "line_ends": F.regexp_count("s", F.lit(line_end)) - F.col("mid_end").cast("bigint") * F.col("s").rlike(r"[.!?…:;。][\"”»'’)\]]*[ \t]*\z").cast("bigint"),
        "number_rows": F.regexp_count("quoted", F.lit(NUMBER_ROW)),
        "wordless": _length(F.col("other")), "size": _length(F.col("s")),
        "all": _length(F.col("quoted")) + edge_length,
        "rows": _length(F.col("quoted")) - _length(F.col("no_rows")),
        "entries": _length(F.col("no_rows")) - _length(F.col("core_left")),
        "rest": _length(F.col("no_entries")),
        "rest_lines": F.regexp_count("no_entries", F.lit(r"(?m)^[ \t]*[^\s]")) - goes_on,
        "rest_upper": F.when(lines_left, F.regexp_count("no_entries", F.lit(r"(?m)^[ \t]*[^\p{L}\s]*\p{Lu}")) - (F.col("mid_start") & F.col("s").rlike(r"\A[ \t]*[^\p{L}\s]*\p{Lu}")).cast("bigint")).otherwise(0),
        "breaks": F.when(lines_left, F.regexp_count("no_entries", F.lit(_SENTENCE_BREAK)) + (F.col("stopped") & F.col("no_entries").rlike(r"\A\s*\p{Lu}")).cast("bigint")).otherwise(0),
    }
    marks = {"many": (varied | (F.size(different) > 3)).cast("int"), "most": F.coalesce(F.size(few), F.lit(0)), "place0": place(0), "place1": place(1)}
    counts = part.select("_id", "_h", "_seen", "_at", *[c.cast("bigint").alias(k) for k, c in sums.items()], *[c.alias(k) for k, c in marks.items()])
    whole = counts.groupBy("_id", "_h").agg(F.max("_seen").alias("_seen"), F.sum(F.when(F.coalesce("_at", F.lit(0)) == 0, 1)).alias("copies"), *[F.sum(k).alias(k) for k in sums], F.max("many").alias("many"), F.max("most").alias("most"), *[F.bit_count(F.bit_or(k)).alias(k) for k in ("place0", "place1")])
    distinct = F.when(F.col("many") > 0, 1_000).otherwise(F.greatest("most", "place0", "place1"))
    whole = whole.select("_id", "_h", "_seen", *[(F.col(k) / F.col("copies")).alias(k) for k in sums], distinct.alias("distinct"))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))

    letters, vowels, common_ratio = F.coalesce(share("letters", "visible"), F.lit(0.0)), F.coalesce(share("vowels", "letters"), F.lit(0.0)), F.coalesce(share("common", "words"), F.lit(0.0))
    repeated = (F.col("words") >= 6) & (F.col("distinct") <= 3) & (F.col("words") >= 3 * F.col("distinct"))
    numbers = (F.col("number_rows") >= 0.5 * F.col("lines")) & (F.col("wordless") > 0.8 * F.col("size"))
    unreadable = (F.col("words") == 0) | repeated | (F.col("broken") > 0.05 * F.col("visible"))
    length = (F.col("letters") + F.col("digits")) / F.greatest("words", F.lit(1))
    table = (F.col("rows") > 0.5 * F.col("all")) & ((letters >= 0.12) | numbers) | numbers
    strange = (letters < 0.45) | (vowels < 0.27) | (length > 20) | ((length < 2.4) & (F.col("words") >= 10))
    per_line = F.col("rest") / F.greatest("rest_lines", F.lit(1))
    names = (F.col("rest_lines") >= 2) & (per_line <= 55) & (common_ratio < 0.12) & (F.col("breaks") <= 1 + 0.2 * F.col("rest_lines"))
    few = (F.col("rest_lines") >= 3) & (per_line <= 40) & (common_ratio < 0.25) & (F.col("breaks") == 0) & (F.col("line_ends") <= 1)
    tasks = (F.col("rest_lines") >= 3) & (per_line <= 95) & (per_line >= 15) & (F.col("breaks") == 0) & (F.col("rest_upper") <= 1 + 0.15 * F.col("rest_lines"))
    listed = F.col("entries") + F.when(names | few | tasks, F.col("rest")).otherwise(0)
    kind = (
        F.when(~F.col("_seen"), F.lit(None).cast("string"))
        .when(unreadable, "junk").when(table, "table").when(strange & ((F.col("entries") < 0.5 * F.col("all")) | (length > 20) | (letters + F.col("digits") / F.greatest("visible", F.lit(1)) < 0.45)), "junk")
        .when(listed > 0.5 * F.col("all"), "list").otherwise("prose")
    )
    return whole.select(
        F.col("_id").alias(id), F.col("visible").cast("bigint").alias("visible_chars"), F.col("words").cast("bigint").alias("words"), F.col("lines").cast("bigint").alias("lines"),
        F.when(F.col("words") > 0, (F.col("letters") + F.col("digits")) / F.col("words")).alias("mean_word_length"), F.when(F.col("visible") > 0, (F.col("visible") - F.col("letters") - F.col("digits")) / F.col("visible")).alias("symbol_ratio"),
        share("line_ends", "lines").alias("line_end_ratio"), share("common", "words").alias("common_ratio"), share("rows", "all").alias("row_ratio"), F.when(F.col("all") > 0, listed / F.col("all")).alias("entry_ratio"), kind.alias("kind"),
    )
