"""Operator 7 [native]: benchmark decontamination by winnowing.

Hashes of ``gram`` consecutive words are winnowed: of each window of
``span - gram + 1`` neighbouring hashes the smallest is kept, so every shared
passage of ``span`` words leaves a common fingerprint on both sides. Fingerprints
are joined; each hit is extended to the windows of the text around it, and these
are compared with the items' windows as text, so work is in proportion to the words
of both sides, whatever repeats. Items shorter than ``span`` words are one window each and are looked up
by the hash of all their words at every place.

Everything here is DataFrame and SQL expressions. A bitmap of the benchmark's
fingerprints, of bounded size, tells in the first pass which fingerprints of a text
may be an item's; most texts have none and are done. Only the others are joined with
the fingerprints, which are broadcast behind a check of their size (beyond it the
same join is shuffled), and only their texts are shuffled, to meet their hits.

Defined cases: a null or empty text has no words and no hits; an item without
words matches nothing; a repeated row gets a repeated result, and rows of one id or of none are judged each by its text; items with the same
id count once; empty tables give an empty result or no hits; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import stored

#: Bytes that separate words before lower-casing A-Z.
WORD_BREAK = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LOWER = "if(octet_length(w) = char_length(w), lower(w), translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"


def _words(text: str) -> str:
    """SQL: the lower-cased words of a text."""
    return f"transform(filter(split(coalesce({text}, ''), '{WORD_BREAK}'), w -> w <> ''), w -> {_LOWER})"


def _ahead(a: str, by: int, how: str, b: str | None = None) -> str:
    """SQL: ``how`` of each element x of an array and the element y ``by`` places on (of b, if given); null beyond the end."""
    b = b or a
    return f"zip_with({a}, slice({b}, {by + 1}, size({b})), (x, y) -> {how})"


def _prepared(rows: DataFrame, text: str, gram: int, span: int) -> DataFrame:
    """Adds row, words, hw (their hashes) and marks (places and hashes of the winnowed fingerprints, with the length 0).

    Hashes, minima and maxima over neighbouring elements are built up from spans
    of two, four and so on, so an element costs a few steps whatever the text's
    length is. Filters on the marks stay above the row number, which is not
    deterministic; below it they would repeat the whole expression.
    """
    if gram != 5 or span != 10:
        raise ValueError("the steps below are laid out for 5-word hashes in 10-word spans")
    rows = rows.withColumn("words", F.expr(_words(text))).drop(text)
    rows = rows.withColumn("hw", F.expr("transform(words, w -> xxhash64(w))"))
    pair = "xxhash64(x, y)"
    rows = rows.withColumn("h2", F.expr(_ahead("hw", 1, pair)))
    rows = rows.withColumn("h4", F.expr(_ahead("h2", 2, pair))).drop("h2")
    rows = rows.withColumn("g", F.expr(f"if(size(hw) >= {span}, slice({_ahead('h4', 4, pair, 'hw')}, 1, size(hw) - 4), array())")).drop("h4")
    rows = rows.withColumn("m2", F.expr(_ahead("g", 1, "least(x, y)")))
    rows = rows.withColumn("m4", F.expr(_ahead("m2", 2, "least(x, y)")))
    rows = rows.withColumn("low", F.expr(f"if(size(g) > 0, concat(array_repeat(cast(null as long), 5), slice({_ahead('m4', 4, 'least(x, y)', 'm2')}, 1, size(g) - 5)), array())")).drop("m2", "m4")
    # the largest minimum of the six windows around a hash: the hash itself if one of them keeps it
    rows = rows.withColumn("m2", F.expr(_ahead("low", 1, "greatest(x, y)")))
    rows = rows.withColumn("m4", F.expr(_ahead("m2", 2, "greatest(x, y)")))
    rows = rows.withColumn("top", F.expr(_ahead("m4", 4, "greatest(x, y)", "m2"))).drop("m2", "m4", "low")
    kept = f"filter(transform(zip_with(g, top, (x, y) -> if(x = y, x, null)), (h, i) -> struct(i + 1 as pos, h as h, 0 as len)), x -> x.h is not null)"
    return rows.withColumn("marks", F.expr(kept)).drop("g", "top").withColumn("row", F.monotonically_increasing_id()).filter("row >= 0")


def _window(at: str, span: int) -> str:
    """SQL: the words of a window as text; words hold no space."""
    return f"array_join(slice(words, {at}, {span}), ' ')"


def _short(span: int) -> str:
    """SQL: hash of all words of an item of fewer than ``span``."""
    return "CASE size(hw) " + " ".join(f"WHEN {m} THEN xxhash64({', '.join(f'get(hw, {k})' for k in range(m))})" for m in range(1, span)) + " END"


def _in_bitmap(marks: DataFrame) -> str:
    """SQL: whether the hash of a fingerprint m may be among the marks: three of its bits are set in a bitmap of 64 bits a mark, at most 2**22."""
    n = marks.count()
    bits = 1 << min(max((64 * n - 1).bit_length(), 6), 22) if n else 64
    places = F.explode(F.array(*(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(bits - 1).cast("long")) for k in (0, 21, 42))))
    set_ = marks.select(places.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    table = [0] * (bits // 64)
    for word, value in set_.collect():  # one row for each word of the bitmap at most
        table[word] = value
    array = f"cast(split('{','.join(map(str, table))}', ',') as array<long>)"  # folded to one literal
    test = lambda k: f"(shiftrightunsigned(get({array}, cast(shiftrightunsigned(shiftrightunsigned(m.h, {k}) & {bits - 1}L, 6) as int)), cast(shiftrightunsigned(m.h, {k}) & 63L as int)) & 1L) = 1L"
    return " AND ".join(map(test, (0, 21, 42)))


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, gram: int = 5, broadcast_words: int = 200_000, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the kept columns of docs (as kept_0, kept_1, ...): one row per document.

    The fingerprints of the benchmark, and its windows, are broadcast while it has at
    most ``broadcast_words`` words; a window takes about a hundred bytes.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("item_text")).filter("item IS NOT NULL").distinct()
    prepared = _prepared(items, "item_text", gram, span).filter("size(words) > 0")
    total, *short = prepared.select(F.size("words").alias("n")).groupBy(F.when(F.col("n") < span, F.col("n")).alias("m")).agg(F.sum("n").alias("words")).agg(F.sum("words"), F.collect_set("m")).first() or (0, [])
    short = sorted(short[0]) if short else []  # lengths below span: fewer than span values
    few = (total or 0) <= broadcast_words
    marks = prepared.select(F.explode(F.expr(f"if(size(words) < {span}, array(struct(1 as pos, {_short(span)} as h, size(hw) as len)), marks)")).alias("m")).select("m.h", "m.len").distinct()
    at = f"if(size(words) < {span}, array(1), sequence(1, size(words) - {span - 1}))"
    windows = prepared.select("item", F.explode(F.expr(f"transform({at}, i -> struct(least(size(words), {span}) as n, {_window('i', span)} as win))")).alias("w")).select("item", "w.n", "w.win").distinct()

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text"), F.col(text_col).alias("own_text"), *(F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)))
    rows = _prepared(source, "doc_text", gram, span)
    extra = "".join(f", if(size(hw) >= {m}, transform(sequence(1, size(hw) - {m - 1}), i -> struct(i as pos, xxhash64({', '.join(f'get(hw, i + {k - 1})' for k in range(m))}) as h, {m} as len)), array())" for m in short)
    own = [f"kept_{k}" for k in range(len(keep))]
    # the first pass keeps the text, and the marks that may be an item's, of the few rows that have such marks
    rows = rows.select("row", "doc_id", *own, F.expr("cast(size(words) as long)").alias("n_words"), "own_text", F.expr(f"filter(concat(marks{extra}), m -> {_in_bitmap(marks)})").alias("marks"))
    met = F.size("marks") > 0
    rows = rows.withColumn("doc_text", F.when(met, F.col("own_text"))).withColumn("marks", F.when(met, F.col("marks"))).drop("own_text")
    rows = stored(rows.withColumn("r", F.monotonically_increasing_id()).filter("r >= 0").drop("r"), "decontaminate-rows")
    maybe = rows.filter("marks IS NOT NULL")
    found = maybe.select("row", F.explode("marks").alias("d")).select("row", F.col("d.pos").alias("pos"), F.col("d.h").alias("h"), F.col("d.len").alias("len"))
    # a place is kept once however many places of however many items have its fingerprint
    found = found.join(F.broadcast(marks) if few else marks, ["h", "len"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("pos", "len")).alias("hits"))
    # hits are extended to all windows of the text around them, and these are compared with the items' as text
    around = f"if(x.len = 0, if(x.pos >= 1 and size(words) >= {span}, transform(sequence(greatest(x.pos - {span - gram}, 1), least(x.pos, size(words) - {span - 1})), i -> struct(i as at, {span} as n)), array()), array(struct(x.pos as at, x.len as n)))"
    near = maybe.select("row", "doc_text").join(found.hint("merge"), "row").withColumn("words", F.expr(_words("doc_text")))
    near = near.select("row", F.explode(F.expr(f"transform(array_distinct(flatten(transform(hits, x -> {around}))), a -> struct(a.at as at, a.n as n, array_join(slice(words, a.at, a.n), ' ') as win))")).alias("a")).select("row", "a.at", "a.n", "a.win")
    known = windows.select("n", "win").distinct()
    hit_at = near.join(F.broadcast(known) if few else known, ["n", "win"], "left_semi")
    hit_at = stored(hit_at, "decontaminate-hits")
    places = hit_at.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("places"))
    of_item = hit_at.select("row", "n", "win").distinct().join(windows, ["n", "win"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))

    # each text is judged by itself, whatever other texts have its id
    merged = maybe.select("row", "doc_id", *own, "n_words").join(places.join(of_item, "row").hint("merge"), "row", "left").drop("row")
    none = rows.filter("marks IS NULL").select("doc_id", *own, "n_words").withColumn("places", F.lit(None).cast(places.schema["places"].dataType)).withColumn("items", F.lit(None).cast("array<string>"))
    merged = merged.unionByName(none).withColumn("places", F.expr("coalesce(places, array())")).withColumn("items", F.expr("coalesce(items, array())"))
    hit = "aggregate(places, struct(0L as covered, 0 as until), (a, s) -> struct(a.covered + greatest(s.at + s.n - greatest(s.at, a.until), 0) as covered, greatest(a.until, s.at + s.n) as until), a -> a.covered)"
    out = merged.select("doc_id", *own, "n_words", F.expr(hit).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    # the row number is not deterministic, so a caller's filter stays above the expressions and does not repeat them
    return out.withColumn("contaminated", F.col("n_hit") > 0).withColumn("row", F.monotonically_increasing_id()).filter("row >= 0").drop("row")
