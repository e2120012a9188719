"""Benchmark decontamination by templates: passages with other names, numbers or units
are still the passage.

Words are canonicalised: numbers, units after a number, and runs of capitalised words inside
a sentence become typed placeholders; punctuation and case go. Windows of 5 template words
are hashed and joined with those of the benchmark. On one alignment of a document with
an item, or on alignments a few words apart (inserted and missing words, names of other
length), the windows that match must cover half of the item's windows or 13 words. The values
in the placeholders must map one to one: of the partners of a value only the one at the
most places counts, none on a tie, and a window with another pair is left out unless all
its values are the item's. So a question with new names and numbers is caught, and one
that only shares its frame with scrambled values is not. A window also matches by its
lower-cased words as they are, names unmarked, so copies in any case are caught; one with
fewer than 3 plain words matches in this way only.

The windows of all texts are first met as mere hashes; words, places and slot values are
worked out for the texts that share one with an item.

Defined results: texts and items shorter than a window are one window, whole; null or
blank ones have none; repeated rows give one result row per id, text and item; an empty
table gives an empty result; further columns are ignored (``keep_clean`` returns them
all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import GAP

WINDOW = 5
PLAIN = 3  # plain words a window needs to count as a template
COVERAGE, LONG_RUN = 0.5, 13
BAND = 16  # alignments in one half of so many words are judged together
# Benchmark windows up to this many are sent to all executors (24 bytes and a few slot
# words each); beyond, both sides are shuffled by window hash.
SENT_WINDOWS = 500_000

# Units that may follow a number.
UNITS = [
    "%", "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yards", "mi", "mile", "miles",
    "mg", "g", "kg", "t", "oz", "lb", "lbs", "pound", "pounds", "ton", "tons", "gram", "grams", "kilogram", "kilograms",
    "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "kilometre", "kilometres", "mph", "kmh", "s", "sec", "second", "seconds", "min",
    "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "usd", "eur", "hz", "khz", "mhz", "ghz", "w",
    "kw", "v", "a", "j", "kj", "cal", "kcal", "kb", "mb", "gb", "tb", "degree", "degrees",
]
_UNIT = "(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + ")"
_SLOTS = "array<struct<word:string,nth:int>>"
_MARK = "\ue001"  # stands before a name until it is replaced
_MORE = "\ue002"  # stands between the words of one name
_PUNCTUATION = r"""[.,;:!?"'()\[\]{}*|`´“”‘’«»¿¡…]+"""


def base_text(text: Column) -> Column:
    """Lower-cased words without punctuation; names carry a mark, numbers and units stand apart."""
    plain = F.coalesce(text, F.lit(""))
    for mark in (_MARK, _MORE):
        plain = F.replace(plain, F.lit(mark), F.lit(""))
    spaced = F.regexp_replace(plain, rf"(?i)(?<=[0-9])(?={_UNIT}(?![\p{{L}}\p{{N}}]))", " ")
    # points and commas inside numbers stay
    joined = F.regexp_replace(spaced, r"[.,:](?<=[0-9].)(?=[0-9])", "·")
    # most texts have no digit and skip the two passes above
    counted = F.when(plain.rlike("[0-9]"), joined).otherwise(plain)
    named = F.regexp_replace(counted, r"(?=\p{Lu})(?<=[\p{L}\p{N},;:)][\x20\x09-\x0D])", _MARK)
    return F.btrim(F.lower(F.regexp_replace(named, _PUNCTUATION, "")), F.lit(" \t\n\x0b\f\r"))


def with_whole_names(base: Column) -> Column:
    """Adjacent name words as one word."""
    joined = F.regexp_replace(base, rf"({_MARK}[^\x20\x09-\x0D]+){GAP}(?={_MARK})", "$1" + _MORE)
    return F.when(F.contains(base, F.lit(_MARK)), joined).otherwise(base)


def words_apart(joined: Column) -> Column:
    """The words of ``with_whole_names``; those that go on with a name begin with a mark."""
    return F.split(F.replace(joined, F.lit(_MORE), F.lit(" " + _MORE)), GAP)


def canonical_text(base: Column) -> Column:
    """Typed placeholders for names, numbers and units; as many words as before."""
    numbers = F.regexp_replace(base, r"[0-9]+(?:[·/-][0-9]+)*", "<num>")
    units = F.regexp_replace(numbers, rf"(?<=<num>[\x20\x09-\x0D]){_UNIT}(?=[\x20\x09-\x0D]|$)", "<unit>")
    counted = F.when(base.rlike("[0-9]"), units).otherwise(base)
    named = F.regexp_replace(counted, rf"{_MARK}[^\x20\x09-\x0D]+", "<name>")
    return F.when(F.contains(base, F.lit(_MARK)), named).otherwise(counted)


def template_windows(texts: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """``keys, pos, hash, slots``: a row for the words of each window and, if it has
    placeholders and enough plain words, one for its template, both at the place of their first word. ``slots`` has the words
    behind the placeholders in order and where in the window they stand, null without any.

    The word arrays are zipped with themselves, shifted, and exploded, so that all work on a
    window is plain column code on its words.
    """
    # blank texts go behind the windows: a filter here would work out every text twice, and
    # run before a join that leaves few of them
    based = texts.select(*keys, base_text(F.col("text")).alias("base"))
    named = based.select(*keys, "base", with_whole_names(F.col("base")).alias("joined"))
    canonical = named.select(*keys, "base", "joined", canonical_text(F.col("joined")).alias("canonical"))
    slotted = F.col("joined") != F.col("canonical")
    apart = words_apart(F.col("joined"))
    places = F.filter(F.sequence(F.lit(1), F.size("apart")), lambda i: ~F.startswith(F.element_at("apart", i), F.lit(_MORE)))
    none = F.array().cast("array<string>")
    # texts without a placeholder carry one array of words
    split = canonical.select(
        *keys,
        F.split(F.replace("base", F.lit(_MARK), F.lit("")), GAP).alias("v"),
        F.when(slotted, F.split("canonical", GAP)).otherwise(none).alias("c"),
        F.when(slotted, F.split("joined", GAP)).otherwise(none).alias("b"),
        F.when(F.contains("joined", F.lit(_MORE)), apart).otherwise(none).alias("apart"),
    )
    # where the words of a template begin, if some are names of several words
    begins = F.when(F.size("apart") > 0, places).otherwise(F.array().cast("array<int>")).alias("begins")
    rest = F.lit(1 << 30)
    shifted = [F.slice(side, F.lit(i + 1), rest).alias(f"{side}{i}") for side in "vcb" for i in range(window)]
    names = [f"{side}{i}" for side in "vcb" for i in range(window)]
    rows = split.select(*keys, F.size("v").alias("words"), F.size("c").alias("many"), begins, *shifted)
    rows = rows.select(*keys, "words", "many", F.posexplode(F.arrays_zip("begins", *names)).alias("at", "w"))
    first = F.col("at") == 0
    words, canon, plain = [[F.col(f"w.{side}{i}") for i in range(window)] for side in "vcb"]
    # a window is full, or it is a whole text that is shorter
    whole = (words[-1].isNotNull() | (first & (F.col("words") < window))) & (words[0] != "")
    opens = [F.coalesce(b != c, F.lit(False)) for b, c in zip(plain, canon)]
    slots = sum((o.cast("int") for o in opens), F.lit(0))
    size = F.least(F.lit(window), F.col("many"))
    templated = (canon[-1].isNotNull() | (first & (F.col("many") < window))) & (slots > 0) & (
        size - slots >= F.least(F.lit(PLAIN), size)
    )
    in_slots = [F.when(o, F.struct(b.alias("word"), F.lit(i).alias("nth"))) for i, (o, b) in enumerate(zip(opens, plain))]
    pos = (F.col("at") + 1).alias("pos")
    as_words = F.struct(pos, F.xxhash64(*words).alias("hash"), F.lit(None).cast(_SLOTS).alias("slots"))
    begin = F.coalesce("w.begins", F.col("at") + 1).alias("pos")
    as_template = F.struct(
        begin, F.xxhash64(F.lit("template"), *canon).alias("hash"), F.array_compact(F.array(*in_slots)).alias("slots")
    )
    both = rows.select(*keys, F.explode(F.array(F.when(whole, as_words), F.when(templated, as_template))).alias("row"))
    return both.where(F.col("row").isNotNull()).select(*keys, "row.pos", "row.hash", "row.slots")


def window_hashes(texts: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """``keys, hash``: of each window of words, and of each of template words with a
    placeholder, whatever ``template_windows`` makes of it, but without places and slots.

    One pattern with a look-ahead gives all overlapping windows of a text as strings.
    """
    based = texts.select(*keys, base_text(F.col("text")).alias("base"))
    canonical = canonical_text(with_whole_names(F.col("base")))
    plain = F.replace("base", F.lit(_MARK), F.lit(""))
    # a window has single spaces between its words
    two = based.select(*keys, *[F.regexp_replace(c, GAP, " ").alias(n) for c, n in ((plain, "v"), (canonical, "c"))])
    rest = "".join([" [^ ]+"] * (window - 1))

    pattern = F.lit(f"(?=([^ ]+{rest}))[^ ]+")
    none = F.array().cast("array<string>")
    slotted = F.when(F.col("c").rlike("<(?:num|unit|name)>"), F.regexp_extract_all("c", pattern, F.lit(1))).otherwise(none)
    # columns of their own, so that each pattern runs once
    found = two.select(*keys, "v", "c", F.regexp_extract_all("v", pattern, F.lit(1)).alias("plain"), slotted.alias("open"))

    def whole(side: str, text: str) -> Column:
        """A text shorter than a window is one."""
        return F.when(F.size(side) > 0, F.col(side)).otherwise(F.array(text))

    both = F.concat(whole("plain", "v"), F.when(F.contains("c", F.lit("<")), whole("open", "c")).otherwise(none))
    plain_ones = F.greatest(F.size("plain"), F.lit(1)).alias("plain_ones")
    each = found.select(*keys, plain_ones, F.posexplode(both).alias("at", "words"))
    template = F.col("at") >= F.col("plain_ones")
    counts = (F.col("words") != "") & (~template | F.contains("words", F.lit("<")))
    return each.where(counts).select(*keys, F.xxhash64(template, "words").alias("hash"))


def suspects(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, text`` of the documents that share a window with an item: no
    other can hold one, and places and slots are only needed for these."""
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    wanted = window_hashes(items.select("text"), [], window).distinct()
    # 8 bytes each
    wanted = cut(wanted)
    if wanted.count() <= SENT_WINDOWS:
        wanted = F.broadcast(wanted)
    shared = window_hashes(keyed, ["doc_id", "text_hash"], window).join(wanted, "hash", "left_semi")
    met = cut(shared.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("of")).distinct())
    return keyed.join(met, keyed["doc_id"].eqNullSafe(met["id"]) & (keyed["text_hash"] == met["of"]), "left_semi")


def item_cells(texts: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """``keys, pos, cell, item_windows``: the window of template words that each word counts
    for, and how many there are."""
    based = texts.select(*keys, base_text(F.col("text")).alias("base")).where(F.col("base") != "")
    each = based.select(*keys, F.posexplode(words_apart(with_whole_names(F.col("base")))).alias("at", "word"))
    begun = F.sum((~F.startswith("word", F.lit(_MORE))).cast("int"))
    counted = each.select(
        *keys, (F.col("at") + 1).alias("pos"), begun.over(Window.partitionBy(*keys).orderBy("at")).cast("int").alias("nth"),
        F.greatest(begun.over(Window.partitionBy(*keys)) - window + 1, F.lit(1)).alias("item_windows"),
    )
    return counted.select(*keys, "pos", F.least("nth", "item_windows").cast("int").alias("cell"), "item_windows")


def _distinct_windows(met: Column) -> Column:
    """Item windows among those met."""
    return F.size(F.array_distinct(F.transform(met, lambda m: m["cell"])))


def _outvoted(aligned: DataFrame) -> DataFrame:
    """``alignment, outvoted``: the pairs of slot values for which another partner of either
    value stands at as many places of the item or more."""
    each = aligned.select("alignment", F.explode("met").alias("m")).select("alignment", F.explode("m.pairs").alias("p"))
    each = each.select("alignment", F.struct("p.mine", "p.theirs").alias("pair"), F.col("p.place").alias("place"))
    votes = each.groupBy("alignment", "pair").agg(F.count_distinct("place").alias("votes"))
    first = F.lit(True)
    for side in ("pair.mine", "pair.theirs"):
        rank = F.rank().over(Window.partitionBy("alignment", side).orderBy(F.desc("votes")))
        tied = F.count(F.lit(1)).over(Window.partitionBy("alignment", side, "votes"))
        first = first & (rank == 1) & (tied == 1)
    judged = votes.withColumn("first", first)
    return judged.where(~F.col("first")).groupBy("alignment").agg(F.collect_set("pair").alias("outvoted"))


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, item_id, windows, item_windows, coverage``: a row for each
    document (``doc_id, text``) and item (``item_id, text``) it holds."""
    keys = ["item_id", "item_hash"]
    items = benchmark.select("item_id", F.xxhash64("text").alias("item_hash"), "text").distinct()
    theirs = template_windows(items, keys, window).join(item_cells(items, keys, window), [*keys, "pos"]).select(
        *keys, "item_windows", F.col("pos").alias("item_pos"), "cell", "hash", F.col("slots").alias("their_slots")
    )
    theirs = cut(theirs)
    if theirs.count() <= SENT_WINDOWS:
        theirs = F.broadcast(theirs)
    mine = template_windows(suspects(documents, items, window), ["doc_id", "text_hash"], window)
    nothing = F.array().cast(_SLOTS)
    pairs = F.zip_with(
        F.coalesce("slots", nothing),
        F.coalesce("their_slots", nothing),
        lambda a, b: F.struct(a["word"].alias("mine"), b["word"].alias("theirs"), (F.col("cell") + b["nth"]).alias("place")),
    )
    at = F.col("pos") - F.col("item_pos")
    # each alignment by itself, and in two grids of bands: any two within half a band share one
    bands = [F.struct(F.lit(0).alias("grid"), at.alias("at"))]
    bands += [F.struct(F.lit(1 + i).alias("grid"), F.floor((at + i * (BAND // 2)) / BAND).cast("int").alias("at")) for i in (0, 1)]
    met = mine.join(theirs, "hash").select(
        "doc_id", "text_hash", *keys, "item_windows", "cell", F.explode(F.array(*bands)).alias("band"), pairs.alias("pairs")
    )
    enough = (F.col("windows") >= F.col("item_windows") * COVERAGE) | (F.col("windows") + window - 1 >= LONG_RUN)
    aligned = met.groupBy("doc_id", "text_hash", *keys, "item_windows", "band").agg(
        F.collect_set(F.struct("cell", "pairs")).alias("met")
    )
    # numbered once: the table is written with its numbers
    aligned = aligned.withColumn("windows", _distinct_windows(F.col("met"))).where(enough)
    aligned = cut(aligned.withColumn("alignment", F.monotonically_increasing_id()))
    judged = aligned.join(_outvoted(aligned), "alignment", "left")
    verbatim = lambda m: F.forall(m["pairs"], lambda p: p["mine"] == p["theirs"])
    paired = lambda m: F.transform(m["pairs"], lambda p: F.struct(p["mine"].alias("mine"), p["theirs"].alias("theirs")))
    counted = F.when(F.col("outvoted").isNull(), F.col("met")).otherwise(
        F.filter("met", lambda m: verbatim(m) | ~F.arrays_overlap(paired(m), F.col("outvoted")))
    )
    held = judged.withColumn("windows", _distinct_windows(counted)).where(enough)
    coverage = (F.col("windows") / F.col("item_windows")).alias("coverage")
    best = held.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct(coverage, "windows", "item_windows")).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", "best.windows", "best.item_windows", "best.coverage")


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark item."""
    found = cut(contaminated(documents, benchmark).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("of")).distinct())
    packed = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_hash"))
    same = packed["row_id"].eqNullSafe(found["id"]) & (packed["row_hash"] == found["of"])
    return packed.join(found, same, "left_anti").select("row.*")
