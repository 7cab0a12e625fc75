"""Gates on authored parts and whole batches: rows against what was assigned, against each other and against the bank."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbank.functions import text as T
from lumenbank.operators.bank import values
from lumenbank.sources.adapters import LETTERS, TIERS

# Shortest option text that two rows may not share, tolerances in characters, and how numbers are written.
SHARED, BAND_ROOM, TARGET_ROOM = 18, 4, 8
DECIMAL = r"\d\.\d"
FIGURE = r"\d[\d,]*(?:\.\d+)?"
ARTICLE = r"\b(an?)\s+\$?\d"

HARD, SOFT, NOTE = "hard", "soft", "note"


def option_lengths() -> Column:
    return F.transform(values(F.col("options")), lambda o: F.length(F.trim(o)))


def fired(rows: DataFrame, gates: list[tuple[str, str, Column]]) -> DataFrame:
    """(cand_id, level, finding): a row for each gate (level, name, test) that is true, in one pass; an unknown test is false."""
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(level).alias("level"), F.lit(name).alias("finding"))) for level, name, test in gates]))
    # For explode() Spark puts a filter before it, in which all gates are tested a second time.
    return rows.select("cand_id", F.explode_outer(found).alias("f")).filter("f IS NOT NULL").select("cand_id", "f.level", "f.finding")


def each_option(measure: Callable[[Column], Column]) -> Column:
    """The measure of the options A to D, without a lambda, so that it is compiled."""
    return F.array(*[measure(F.col("options")[x]) for x in LETTERS])


def shape_gates(plain: Column | None = None) -> list[tuple[str, str, Column]]:
    """What a row must have whatever was assigned: four different options, a key among them, no empty field, a known tier. ``plain`` has the options' plain texts, if they are there."""
    plain = each_option(T.plain_norm) if plain is None else plain
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    blank = lambda c: empty(F.col(c))
    return [
        (HARD, "empty option", reduce(lambda a, b: a | b, [empty(F.col("options")[x]) for x in LETTERS])),
        (HARD, "same options", F.size(F.array_distinct(F.filter(plain, lambda o: o != ""))) < F.size(F.filter(plain, lambda o: o != ""))),
        (HARD, "no such key", ~F.coalesce(F.col("answer").isin(LETTERS), F.lit(False))),
        (HARD, "no such tier", ~F.coalesce(F.col("difficulty").isin(TIERS), F.lit(False))),
        *[(HARD, f"empty {c}", blank(c)) for c in ("question", "explanation", "pi", "area")],
    ]


def assignment_gates(post_referee: bool = False) -> list[tuple[str, str, Column]]:
    """The row against its assignment (columns ``want_...``; null where nothing was assigned): letter, tier, indicator, area, and the lengths of its options.

    Lengths: the rank of the key (hard; a tie with it soft), the longest letter, the band, the key's target, and the largest gap.
    """
    lens = option_lengths()
    key = F.length(F.trim(F.col("options")[F.col("answer")]))
    rank = F.size(F.filter(lens, lambda n: n > key)) + 1
    tied = F.size(F.filter(lens, lambda n: n == key)) > 1
    of = lambda letter: F.length(F.trim(F.col("options")[letter]))
    top = F.array_max(lens)
    winners = F.size(F.filter(lens, lambda n: n == top))
    wanted = of(F.col("want_longest"))
    gap = top - F.element_at(F.array_sort(lens), -2)
    return [
        (HARD, "answer is not the assigned letter", F.col("answer") != F.col("want_answer")),
        (SOFT if post_referee else HARD, "difficulty is not the requested one", ~F.col("difficulty").eqNullSafe(F.col("want_difficulty"))),
        (HARD, "indicator was rewritten", ~F.col("pi").eqNullSafe(F.col("want_pi"))),
        (HARD, "area was rewritten", ~F.col("area").eqNullSafe(F.col("want_area"))),
        (HARD, "key has another rank", F.col("want_rank").isNotNull() & (rank != F.col("want_rank"))),
        (SOFT, "a distractor ties with the key", F.col("want_rank").isNotNull() & (rank == F.col("want_rank")) & tied),
        (SOFT, "assigned longest option ties", F.col("want_rank").isNull() & (wanted == top) & (winners > 1)),
        (SOFT, "another option is the longest", F.col("want_rank").isNull() & (wanted < top)),
        (SOFT, "an option is outside the band", F.exists(lens, lambda n: (n < F.col("want_low") - BAND_ROOM) | (n > F.col("want_high") + BAND_ROOM))),
        (SOFT, "key misses its target", F.abs(key - F.col("want_key_length")) > TARGET_ROOM),
        (SOFT, "top gap over the cap", gap > F.col("want_gap")),
    ]


def check_part(items: DataFrame, payload: DataFrame, bank: DataFrame, post_referee: bool = False) -> DataFrame:
    """(cand_id, level, finding) of an authored part: ``items`` with cand_id, the bank's columns and its hashes, against its payload and the committed bank.

    Rows that were not asked for or came back more than once; the shape; for
    rows of right shape the assignment, and collisions: the same content in the
    bank or the part (from its second row on), the same stem in the same cluster
    and level (hard) or another one (soft). An assigned row that never came back is hard ``missing``.
    """
    asked = payload.select(F.col("cand_id").alias("_asked"), *[c for c in payload.columns if c.startswith("want_")])
    rows = items.join(asked, F.col("cand_id") == F.col("_asked"), "left")
    counts = items.groupBy("cand_id").agg(F.count("*").alias("_times"))
    rows = rows.join(counts, "cand_id", "left")
    shape = shape_gates()
    sound = ~reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for _, _, t in shape])
    known = F.col("_asked").isNotNull()
    contents = bank.groupBy("content_hash").agg(F.lit(True).alias("_in_bank"))
    stems = bank.groupBy("stem_hash").agg(F.array_distinct(F.collect_list(F.struct("cluster", "level"))).alias("_homes"))
    own = lambda h: items.groupBy(h).agg(F.min("cand_id").alias(f"_first_{h}"))
    rows = rows.join(contents, "content_hash", "left").join(stems, "stem_hash", "left").join(own("content_hash"), "content_hash", "left").join(own("stem_hash"), "stem_hash", "left")
    here = F.array_contains("_homes", F.struct("cluster", "level"))
    gates = [
        (HARD, "not in the payload", ~known),
        (HARD, "returned more than once", known & (F.col("_times") > 1)),
        *shape,
        *[(level, name, sound & known & test) for level, name, test in assignment_gates(post_referee)],
        (HARD, "content is in the bank", sound & F.col("_in_bank")),
        (HARD, "content is in this part", sound & (F.col("_first_content_hash") < F.col("cand_id"))),
        (HARD, "stem is in the bank's slice", sound & here),
        (SOFT, "stem is elsewhere in the bank", sound & F.col("_homes").isNotNull() & ~here),
        (HARD, "stem is in this part", sound & (F.col("_first_stem_hash") < F.col("cand_id"))),
    ]
    missing = payload.join(items.select("cand_id").distinct(), "cand_id", "left_anti").select("cand_id", F.lit(HARD).alias("level"), F.lit("missing").alias("finding"))
    return fired(rows, gates).unionByName(missing)


def numbers(c: Column) -> Column:
    """Figures as they are written, without commas."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({FIGURE})"), 1), lambda x: F.translate(x, ",", "")))


def places(figures: Column) -> Column:
    """Significant decimal places of the only one of a text's figures, null if it has none or several."""
    only = F.get(figures, F.lit(0))
    decimals = F.when(F.contains(only, F.lit(".")), F.length(F.rtrim(F.substring_index(only, ".", -1), F.lit("0")))).otherwise(0)
    return F.when(F.size(figures) == 1, decimals)


def measured(rows: DataFrame) -> DataFrame:
    """Rows with what the gates of a batch ask of the options, each in a column, so that it is found once: plain texts, figures and their places, decimals, articles, and which option is the key."""
    rows = rows.withColumns({
        "_plain": each_option(T.plain_norm),
        "_figures": each_option(lambda o: F.regexp_extract_all(o, F.lit(f"({FIGURE})"), 1)),
        "_dec": each_option(lambda o: F.rlike(o, F.lit(DECIMAL))),
        "_said": each_option(lambda o: F.regexp_extract(F.lower(o), ARTICLE, 1)),
        "_key": F.array_position(F.array(*map(F.lit, LETTERS)), F.col("answer")).cast("int") - 1,
    })
    rows = rows.withColumn("_places", F.transform("_figures", places))
    return rows.withColumn("_sound", ~reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for _, _, t in shape_gates(F.col("_plain"))]))


def batch_tells() -> list[tuple[str, str, Column]]:
    """What lets a reader pick the key of a measured row without the stem's facts: a shared figure, the odd decimal, the roundest number, the odd article."""
    of_key = lambda c: F.get(F.col(c), F.col("_key"))
    plain = lambda figures: F.transform(figures, lambda x: F.translate(x, ",", ""))
    shared = F.exists(F.array_intersect(plain(of_key("_figures")), numbers(F.col("question"))), lambda x: F.length(F.translate(x, ".", "")) >= 2)
    dec = F.size(F.filter("_dec", lambda d: d))
    odd = ((dec == 1) & of_key("_dec")) | ((dec == 3) & ~of_key("_dec"))
    whole = ~F.exists("_places", lambda n: n.isNull())
    least = F.array_min("_places")
    roundest = whole & (of_key("_places") == least) & (F.size(F.filter("_places", lambda n: n == least)) == 1)
    mine = F.size(F.filter("_said", lambda x: x == of_key("_said")))
    return [
        (SOFT, "key shares a figure with its stem", shared),
        (SOFT, "key is the odd one by its decimal", odd),
        (SOFT, "key is the roundest number", roundest),
        (SOFT, "an article before a number", F.exists("_said", lambda x: x != "")),
        (SOFT, "the article names the key", ~F.exists("_said", lambda x: x == "") & (F.size(F.array_distinct("_said")) == 2) & (mine == 1)),
    ]


def may_be_long(o: Column) -> Column:
    """Whether an option's plain text may have ``SHARED`` characters: a minus and a digit become five, and no other character becomes more than one."""
    return F.length(F.lower(o)) * F.when(F.contains(o, F.lit("-")), 2.5).otherwise(1.0) >= SHARED


def check_batch(rows: DataFrame, payload: DataFrame | None = None) -> DataFrame:
    """(cand_id, level, finding) over all parts of a batch: the shape, the assigned letters, texts that options of two rows share, and tells.

    A cand_id in more than one file makes the letters undecidable: with a
    payload each such id is hard, and no letter of it is judged. An option text is compared from 18 characters on.
    """
    parts = [fired(measured(rows), [*shape_gates(F.col("_plain")), *[(level, name, F.col("_sound") & test) for level, name, test in batch_tells()]])]
    texts = each_option(lambda o: F.when(may_be_long(o), T.plain_norm(o)))
    each = rows.select("cand_id", F.explode_outer(F.array_distinct(texts)).alias("option")).filter(F.length("option") >= SHARED)
    # A text of many rows is reduced before it is shuffled, and its rows find it again by a semi-join.
    common = each.groupBy("option").agg((F.min("cand_id") < F.max("cand_id")).alias("shared")).filter("shared")
    parts.append(each.join(common, "option", "left_semi").select("cand_id").distinct().select("cand_id", F.lit(HARD).alias("level"), F.lit("an option is another row's too").alias("finding")))
    if payload is not None:
        files = rows.groupBy("cand_id").agg(F.count_distinct("file").alias("files"))
        met = rows.join(files, "cand_id").join(payload.select("cand_id", "want_answer"), "cand_id", "left")
        several = F.col("files") > 1
        parts.append(fired(met, [(HARD, "id in several files", several), (HARD, "answer is not the assigned letter", ~several & (F.col("answer") != F.col("want_answer")))]))
    return reduce(DataFrame.unionByName, parts)
