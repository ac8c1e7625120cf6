"""Line dedup by winnowing over hashes, in DataFrame operations only.

What is hashed are runs of a few words and not lines, as a repeated passage need not hold a complete line. The smallest hash in each window
of min_words words is the window's fingerprint (the leftmost of equal ones), so two equal windows always choose the same place in them. A place is a chosen
fingerprint with all the windows next to each other that chose it; the words of these windows are its context.

Places are joined by fingerprint and context: of places with equal contexts all windows of all but the first are later repeats, which is the
match extended both ways to the ends of the context. Where a fingerprint has several contexts, the windows of the first place of each
are compared one by one, which finds the matches that end inside a context.

Windows that occurred earlier (by id, then position) are later repeats; those that overlap or touch join to the maximal repeated passage,
whose words are deleted.

Winnowing costs many steps a word, so it is left out where no window can be repeated. Copies of whole texts go first. Then texts are cut before words that begin with certain letters,
which takes a few steps a piece, and the pieces are counted: two equal windows have the same pieces inside them, so a window with a piece that is nowhere else is not repeated (see _zones for
those at its ends). Only the zones between such pieces that have min_words words are winnowed, all windows in them.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, free_name, materialise, quoted, small

MIN_WORDS = 50
#: Words of a hashed run, if min_words allows.
RUN_WORDS = 8
#: Windows of a text that are looked at together; a longer text is several blocks.
BLOCK = 1 << 16
#: Bits of a chosen value that hold its position in the block, which has BLOCK + min_words words.
_PLACE = (1 << 20) - 1
_WORD = r"[^\x20\x09-\x0D]"
#: Most texts have none, and replacing by pattern takes three times the time of all that is done with the words.
_UNEVEN = ("  ", "\t", "\x0b", "\x0c", "\r")
_BLANKS = r"[\x20\x09-\x0D]+"
#: A text is cut before these words, about one in six of Latin script; what is too long then before these too, and what is still too long into words.
#: Other letters or scripts only change how much is winnowed.
_CUT = " (?=[ADHadh])"
_CUT_AGAIN = " (?=[ADEHIOSadehios\u00E9])"
#: What is added to the words of the first part of a piece that is cut again, and of a single word of a part that is still too long.
_FIRST, _SINGLE = 1 << 20, 1 << 21
#: Pieces of so few words are everywhere and count as repeated.
_COMMON = 2
#: A word with the blanks before it.
_PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
_KEY = ("_mm_id", "_mm_text_hash")
_CONTEXT = ["fp", "off", "span", "d1", "d2"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"_mm_id": F.col(id_col), "_mm_text_hash": F.xxhash64(text_col)})


def _once(value: Column, then) -> Column:
    """then(value) with value computed once: a column that is used inside a lambda may be put in its place by the optimizer and computed for each element."""
    return F.transform(F.array(value), then)[0]


def _plain(text_col: str) -> Column:
    """The text's words with one blank between them."""
    uneven = lambda line: functools.reduce(operator.or_, (line.contains(c) for c in _UNEVEN))
    even = lambda line: F.when(uneven(line), F.regexp_replace(line, _BLANKS, " ")).otherwise(line)
    return F.trim(_once(F.replace(F.col(text_col), F.lit("\n"), F.lit(" ")), even))


def word_hashes(text_col: str) -> Column:
    """Of a text with a word."""
    return F.transform(F.split(_plain(text_col), " "), lambda w: F.xxhash64(w))


def _joined(values: str, step: int) -> Column:
    """The hash of each value and the one step places further, as far as there is one."""
    return F.zip_with(F.slice(values, F.lit(1), F.size(values) - step), F.slice(values, F.lit(1 + step), F.size(values) - step), lambda a, b: F.xxhash64(a, b))


def _least(values: str, step: int) -> Column:
    """Each value or the one step places further, whichever is less, as far as there is one."""
    return F.zip_with(F.slice(values, F.lit(1), F.size(values) - step), F.slice(values, F.lit(1 + step), F.size(values) - step), lambda a, b: F.least(a, b))


def _doubled(rows: DataFrame, name: str, wide: int, step_of) -> DataFrame:
    """name's values put together over each wide places next to each other, in steps that double."""
    covered = 1
    while covered < wide:
        step = min(covered, wide - covered)
        rows = rows.withColumn(name, step_of(name, step))
        covered += step
    return rows


def _digests(words: Column) -> tuple[Column, Column]:
    return F.xxhash64(words).alias("d1"), F.xxhash64(F.lit(11), words).alias("d2")


def _run(min_words: int) -> int:
    return min(RUN_WORDS, (min_words + 1) // 2)


def _with_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """runs: the hash of each run of words in hashes."""
    return _doubled(rows.withColumn("runs", F.col("hashes")), "runs", _run(min_words), _joined)


def _covering(start: Column, length: Column, run: int) -> Column:
    """Those of runs that cover length words from start on, one after the other and the last one."""
    end = start + length - run
    return F.concat(F.transform(F.sequence(start, end, F.lit(run)), lambda i: F.get("runs", i)), F.array(F.get("runs", end)))


def places_of(texts: DataFrame, text_col: str, min_words: int, block: int = BLOCK) -> DataFrame:
    """A row for each chosen fingerprint of a block of a zone (texts' column zones, of from and to): fp, at (the first window that chose it), off (of the fingerprint from there),
    span (windows after the first), digests of the context by the runs that cover it."""
    run = _run(min_words)
    rows = texts.select(*_KEY, "zones", word_hashes(text_col).alias("all"))
    stop = lambda z: F.least(z["to"], F.size("all"))
    starts = lambda z: F.when(stop(z) - z["from"] >= min_words, F.sequence(z["from"], stop(z) - min_words, F.lit(block)))
    cut = lambda z, b: F.struct(b.alias("base"), F.slice("all", b + 1, F.least(F.lit(block + min_words - 1), stop(z) - b)).alias("hashes"))
    blocks = F.flatten(F.transform("zones", lambda z: F.coalesce(F.transform(starts(z), lambda b: cut(z, b)), F.array())))
    rows = _with_runs(rows.select(*_KEY, F.inline(blocks)), min_words)
    wide = min_words - run + 1
    rows = rows.withColumn("low", F.transform("runs", lambda h, i: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))))
    rows = _doubled(rows, "low", wide, _least)
    rows = rows.select(*_KEY, "base", "runs", F.array_distinct("low").alias("chosen"), (F.size("low") - 1).alias("last"))
    at_of = lambda c: c.bitwiseAND(F.lit(_PLACE)).cast("int")
    # a fingerprint takes over when it comes into the window, if it is smaller, or else when the one before has left
    entry = lambda c, before: F.when(c < before, at_of(c) - (wide - 1)).otherwise(at_of(before) + 1)
    opens = F.transform("chosen", lambda c, j: F.when(j == 0, 0).otherwise(entry(c, F.get("chosen", j - 1))))
    rows = rows.withColumn("opens", opens)

    def place(c: Column, j: Column) -> Column:
        o = F.get("opens", j)
        span = F.coalesce(F.get("opens", j + 1) - 1, F.col("last")) - o
        row = lambda context: F.struct(F.get("runs", at_of(c)).alias("fp"), (F.col("base") + o).cast("long").alias("at"), (at_of(c) - o).alias("off"), span.alias("span"), *_digests(context))
        return _once(_covering(o, span + min_words, run), row)

    return rows.select(*_KEY, F.inline(F.transform("chosen", place)))


def _firsts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, first and last place of each content. Both are kept before the shuffle, so a hot one is one row a task."""
    place = F.struct(*_KEY, "at")
    return rows.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last"))


def _later(rows: DataFrame, firsts: DataFrame, by: list[str], length: Column) -> DataFrame:
    """Stretches (at, end) of rows whose content occurred at an earlier place."""
    return rows.join(firsts.select(*by, "first"), by).where(F.struct(*_KEY, "at") != F.col("first")).select(*_KEY, "at", (F.col("at") + length).alias("end")).distinct()


def _windows(texts: DataFrame, spots: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """The windows of each place in spots (fp, at, off, span): fp, where it is in the window, digests of the window by the runs that cover it."""
    spots = materialise(spots.groupBy(*_KEY).agg(F.collect_list(F.struct("fp", "at", "off", "span")).alias("spots")), "spots")
    on = F.col("l._mm_id").eqNullSafe(F.col("r._mm_id")) & (F.col("l._mm_text_hash") == F.col("r._mm_text_hash"))
    both = texts.alias("l").join(small(spots).alias("r"), on)
    # each place's words alone, so that what follows takes no more than them
    own = lambda words, s: F.struct(s.alias("s"), F.slice(words, (s["at"] + 1).cast("int"), s["span"] + min_words).alias("hashes"))
    own_words = _once(word_hashes(text_col), lambda words: F.transform("spots", lambda s: own(words, s)))
    both = both.select(*(F.col(f"l.{k}") for k in _KEY), F.inline(own_words))
    both = _with_runs(both, min_words).select(*_KEY, "s", "runs", F.explode(F.sequence(F.lit(0), F.col("s.span"))).alias("k"))
    run = _run(min_words)
    ends = sorted({*range(0, min_words - run + 1, run), min_words - run})
    content = F.array(*(F.get("runs", F.col("k") + i) for i in ends))
    return both.select(*_KEY, F.col("s.fp").alias("fp"), (F.col("s.at") + F.col("k")).alias("at"), (F.col("s.off") - F.col("k")).alias("off"), *_digests(content))


def _copies(texts: DataFrame) -> DataFrame:
    """_mm_text_hash, _mm_more (another hash of the text), first (id) of texts that several ids have."""
    each = texts.groupBy("_mm_text_hash", "_mm_more").agg(F.min(F.struct("_mm_id")).alias("first"), F.max(F.struct("_mm_id")).alias("last"))
    return materialise(each.where("first != last").select("_mm_text_hash", "_mm_more", "first"), "copied-texts")


def _pieces(texts: DataFrame, text_col: str, most: int) -> DataFrame:
    """_mm_text_hash, hashes and sizes of a text's pieces in order: words, or in parts of a piece that had more than most, minus words and marks."""
    words = lambda c: F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1
    long = lambda c: (F.octet_length(c) > 2 * most) & (words(c) > most)
    part = lambda c, n: F.struct(F.xxhash64(c).alias("h"), n.cast("int").alias("n"))
    single = lambda c, j, k: part(c, F.when((j == 0) & (k == 0), -1 - _SINGLE - _FIRST).otherwise(-1 - _SINGLE))
    parts = lambda c, j: F.when(long(c), F.transform(F.split(c, " "), lambda w, k: single(w, j, k))).otherwise(F.array(part(c, F.when(j == 0, -words(c) - _FIRST).otherwise(-words(c)))))
    of = lambda c: F.when(long(c), F.flatten(F.transform(F.split(c, _CUT_AGAIN), parts))).otherwise(F.array(part(c, words(c))))
    rows = texts.select("_mm_text_hash", F.flatten(F.transform(F.split(_plain(text_col), _CUT), of)).alias("p"))
    return rows.select("_mm_text_hash", F.col("p.h").alias("hashes"), F.col("p.n").alias("sizes"))


def _zones(pieces: DataFrame, min_words: int, most: int) -> DataFrame:
    """_mm_text_hash, zones (array of from, to): stretches of words that have every window of min_words words which occurs elsewhere. The last one may end behind the text.

    Let a window occur in two places. A piece of most words at most that it holds, with a word before and one behind, is a piece in the other place too. Twice most is less than min_words, so the window
    holds such a piece or has more than most words of a longer one, which is then cut into parts in both places, and the same goes for these parts. So the pieces in it are a run of repeated ones, with at
    most one other (or a bit of it) at either end. Where a run meets another long piece, or words of a part that is cut again, these may be uncut in the other place: most words of them at most belong to the window.
    """
    size = lambda n: F.abs(n) % _FIRST
    each = pieces.select("_mm_text_hash", F.posexplode("hashes").alias("i", "h"), "sizes").select("_mm_text_hash", "i", "h", size(F.get("sizes", F.col("i"))).alias("n"))
    each = each.where(F.col("n") > _COMMON).select("_mm_text_hash", "i", "h")
    known = materialise(each.groupBy("h").count().where("count > 1").select("h"), "repeated-pieces")
    found = each.join(small(known), "h", "left_semi").groupBy("_mm_text_hash").agg(F.collect_list("i").alias("known"))
    found = materialise(found, "pieces-found")
    rows = pieces.select("_mm_text_hash", "sizes").join(small(found), "_mm_text_hash", "left")
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, n: a + size(n))
    first = lambda n: F.abs(n) % (2 * _FIRST) >= _FIRST
    # all of a run in one long piece
    inside = lambda run: F.forall(run, lambda n: n < 0) & ~F.exists(F.slice(run, 2, F.size(run)), first)

    def edge(i: Column, inside: Column) -> Column:
        n = F.get("sizes", i)
        return F.when(n.isNull(), 0).when((n < 0) & (~inside | (n <= -_SINGLE)), most).otherwise(size(n))

    def measured(r: Column) -> Column:
        run = F.slice("sizes", r["i"] + 1, r["m"])
        behind = r["i"] + r["m"]
        return F.struct(r["i"].alias("i"), total(run).alias("n"), edge(r["i"] - 1, inside(run) & ~first(F.get("sizes", r["i"]))).alias("before"), edge(behind, inside(run) & ~first(F.get("sizes", behind))).alias("behind"))

    rare = F.filter(F.transform("sizes", lambda n, i: F.when(size(n) > _COMMON, i)), lambda i: i.isNotNull())
    stops = F.concat(F.array(F.lit(-1)), F.array_except(rare, F.coalesce("known", F.array().cast("array<int>"))), F.array(F.size("sizes")))
    between = lambda stops: F.filter(F.transform(stops, lambda i, k: F.struct((i + 1).alias("i"), (F.get(stops, k + 1) - i - 1).alias("m"))), lambda r: r["m"] > 0)
    runs = F.filter(F.transform(_once(stops, between), measured), lambda r: r["before"] + r["n"] + r["behind"] >= min_words)
    zone = "struct<from:int,to:int>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(f"array<{zone}>").alias("out"))
    at = lambda acc, r: acc["at"] + total(F.slice("sizes", acc["i"] + 1, r["i"] - acc["i"]))

    def step(acc: Column, r: Column) -> Column:
        here = at(acc, r)
        new = F.struct(F.greatest(here - r["before"], F.lit(0)).alias("from"), (here + r["n"] + r["behind"]).alias("to"))
        return F.struct(here.alias("at"), r["i"].alias("i"), F.concat(acc["out"], F.array(new.cast(zone))).alias("out"))

    return rows.select("_mm_text_hash", F.aggregate(runs, start, step, lambda acc: acc["out"]).alias("zones"))


def repeats(texts: DataFrame, text_col: str, min_words: int, block: int = BLOCK) -> DataFrame:
    """Stretches (at, end) of words that are covered by windows of min_words words which occurred earlier."""
    texts = texts.where(F.col(text_col).rlike(_WORD)).withColumn("_mm_more", F.xxhash64(F.lit(11), text_col))
    copied = _copies(texts)
    marked = texts.join(small(copied), ["_mm_text_hash", "_mm_more"], "left")
    is_copy = F.struct("_mm_id") != F.col("first")
    n_words = F.when(is_copy, F.size(F.split(_plain(text_col), " ")))  # of copies only, wherever the filter is put
    copies = marked.where(is_copy).select(*_KEY, F.lit(0).cast("long").alias("at"), n_words.cast("long").alias("end")).where(F.col("end") >= min_words).distinct()
    texts = marked.where(F.col("first").isNull() | ~is_copy).select(*_KEY, text_col)
    most = (min_words - 1) // 2
    pieces = materialise(_pieces(texts, text_col, most), "pieces")
    all_zones = materialise(_zones(pieces, min_words, most), "zones")
    zones = materialise(all_zones.where(F.size("zones") > 0).distinct(), "texts-with-zones")
    texts = texts.join(small(zones), "_mm_text_hash").select(*_KEY, text_col, "zones")
    places = materialise(places_of(texts, text_col, min_words, block), "places")
    contexts = materialise(_firsts(places, _CONTEXT), "contexts")
    again = materialise(contexts.where("first != last").select(*_CONTEXT, "first"), "repeated-contexts")
    same = _later(places, small(again), _CONTEXT, F.col("span") + min_words)
    context = F.struct(*_CONTEXT[1:])
    several = contexts.groupBy("fp").agg(F.min(context).alias("a"), F.max(context).alias("b")).where("a != b").select("fp")
    several = materialise(several, "fingerprints-in-contexts")
    spots = contexts.join(small(several), "fp", "left_semi").select("first.*", "fp", "off", "span")
    windows = materialise(_windows(texts, spots, text_col, min_words), "windows")
    by = ["fp", "off", "d1", "d2"]
    inside = _later(windows, _firsts(windows, by).where("first != last"), by, F.lit(min_words))
    out = materialise(same.union(inside).union(copies), "later-stretches")
    discard(copied, pieces, all_zones, zones, places, contexts, again, several, windows)
    return out


def passages(stretches: DataFrame) -> DataFrame:
    """_mm_id, _mm_text_hash, cuts: what overlaps or touches is one passage, from and to are its first and last word."""
    order = W.partitionBy(*_KEY).orderBy("at")
    seen = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = stretches.withColumn("opens", F.when(seen >= F.col("at"), 0).otherwise(1))
    numbered = opens.withColumn("passage", F.sum("opens").over(order.rangeBetween(W.unboundedPreceding, 0)))
    each = numbered.groupBy(*_KEY, "passage").agg(F.min("at").cast("long").alias("from"), (F.max("end") - 1).cast("long").alias("to"))
    return each.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("cuts"))


def _kept(text: Column, cuts: Column) -> Column:
    """A word goes with the blanks before it; with the first word goes a line break behind the passage too."""
    words = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), words.alias("words"), F.array().cast("array<string>").alias("out"))
    upto = lambda acc, stop: F.array_join(F.slice(acc["words"], (acc["at"] + 1).cast("int"), (stop - acc["at"]).cast("int")), "")
    step = lambda acc, c: F.struct((c["to"] + 1).alias("at"), acc["words"].alias("words"), F.concat(acc["out"], F.array(upto(acc, c["from"]))).alias("out"))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), upto(acc, F.size(acc["words"])), F.substr(text, F.length(F.array_join(acc["words"], "")) + 1))
    rest = F.aggregate(cuts, start, step, end)
    return F.when(cuts.isNull(), text).when(cuts[0]["from"] == 0, F.regexp_replace(rest, r"\A\n", "")).otherwise(rest)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the words of later repeated passages deleted from the text, and _mm_cuts: array of (from, to) word numbers, or null.

    A passage is words covered by windows of min_words words that occurred earlier, wherever lines begin and end in it; blanks between words don't count.
    A word goes with the blanks before it. A text with fewer words, a null or an empty one stays as it is. Of equal passages the first stays by id (null first),
    then position, also within one text. A row repeated with the same id and text is the same document and gets the same result; rows that share an id but not a text are ordered by the text's hash.
    All other columns are kept, whatever their names; the last one is called _mm_cuts, with underscores behind it if docs has one of that name.
    """
    texts = keyed(docs, id_col, text_col).select(*_KEY, text_col)
    cuts = materialise(passages(repeats(texts, text_col, min_words)), "line-cuts")
    own_id, own_hash = (free_name(docs, k) for k in _KEY)
    left = docs.withColumns({own_id: F.col(id_col), own_hash: F.xxhash64(text_col)}).alias("l")
    on = F.col(f"l.{own_id}").eqNullSafe(F.col(f"r.{_KEY[0]}")) & (F.col(f"l.{own_hash}") == F.col(f"r.{_KEY[1]}"))
    joined = left.join(small(cuts).alias("r"), on, "left")
    kept = (_kept(quoted(c, "l."), F.col("r.cuts")).alias(c) if c == text_col else quoted(c, "l.") for c in docs.columns)
    return joined.select(*kept, F.col("r.cuts").alias(free_name(docs, "_mm_cuts")))


def cut_words(cuts: Column) -> Column:
    return F.when(cuts.isNull(), 0).otherwise(F.aggregate(cuts, F.lit(0).cast("long"), lambda a, c: a + c["to"] - c["from"] + 1)).cast("long")
