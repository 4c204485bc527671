"""Near-duplicate lines by a deletion-neighbourhood join, as DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import WORD_GAP, let, packed_rows, unpacked_rows, with_groups, written


@dataclass(frozen=True)
class Unit:
    """What an edit changes: how many a line has, its first and last k of them, and all as an array."""

    count: Callable[[Column], Column]
    first: Callable[[Column, Column], Column]
    last: Callable[[Column, Column], Column]
    each: Callable[[Column], Column]


#: Lines come with single spaces between words and none at their ends.
UNITS = {
    "word": Unit(
        lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1,
        lambda s, k: F.call_function("substring_index", s, F.lit(" "), k),
        lambda s, k: F.call_function("substring_index", s, F.lit(" "), -k),
        lambda s: F.split(s, " "),
    ),
    "char": Unit(
        lambda s: F.length(s),
        lambda s, k: F.substring(s, F.lit(1), k),
        lambda s, k: F.substring(s, -k, k),
        lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)),
    ),
}


def dedup_lines(docs: DataFrame, *, unit: str = "word", units_per_edit: int = 8, edits_in: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""Removes each line that an earlier line of the corpus (smaller id, or same document and line before) repeats with at
    most one unit changed, missing or extra: docs with `text` replaced and one struct column `line_dedup`
    (n_lines, n_repeated, n_near; long). Lines are parted by \n and judged on the input, not on what is left.

    Lines are compared lower-cased, with runs of ASCII white space as one space and none at the ends. A unit is a word, or
    a character where `unit` is "char" (for scripts without spaces). The edit bound is relative as well as absolute: one edit,
    and no more than one in `units_per_edit` units of either line; so lines with fewer units must be equal.

    Equal lines first become one, at the earliest place. An edit leaves a line's first or its last half as it is, so only lines
    that share such a half with another one can be near it. These emit their whole deletion neighbourhood: a hash of the
    line without each of its units, and of the whole line. Lines of one length that are equal without the unit at the same
    place differ by a changed unit there; a line that is equal to another one without a unit, by a missing unit. The
    earliest line of each variant is found by a grouping that pre-aggregates, written and joined back, so adaptive execution can
    split a variant that many lines have. Pairs are as many as variants; units are compared before a line goes.

    With `edits_in`, a line of words also goes if it is within one edit in `edits_in` words of an earlier one, so with several edits in lines of
    2 `edits_in` words or more. Neighbourhoods of several deletions would be too many, so such lines are found by whole parts: lines are
    cut at words that a hash chooses, each meets the earliest line that has a part of its own, and their edit distance is
    taken. What goes is near; a line stays if it shares no part with a near one, or its parts stand earlier in lines that are not near.

    Null texts stay null and empty texts empty. Lines without a word stay. A null id sorts first. Lines of any length are
    handled: variants are hashed by running sums over the line's rows. Rows with the same id and text count as one document and
    get one result each; other texts of an id are other documents, in an order that their hashes give. Extra columns stay,
    whatever their names; one named line_dedup is replaced. An empty table gives an empty one.
    """
    if units_per_edit < 2:
        raise ValueError("units_per_edit must be 2 or more")
    if edits_in is not None and (unit != "word" or edits_in < 2):
        raise ValueError("edits_in is for words, and 2 or more")
    of = UNITS[unit]
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("tag", F.xxhash64("text"))
    at = F.struct("doc_id", "tag", "line_no")
    each = _lines(text, "doc_id", "tag")
    parts = _parts(F.col("line"), of, edits_in) if edits_in else F.lit(None).cast("array<bigint>")
    keyed = each.select(at.alias("at"), F.xxhash64("line").alias("key"), F.xxhash64(F.lit("second"), "line").alias("key2"), _halves(F.col("line"), of, units_per_edit).alias("halves"), parts.alias("parts"))
    distinct = keyed.groupBy("key", "key2").agg(F.min("at").alias("at"), F.first("halves").alias("halves"), F.first("parts").alias("parts"))
    distinct = written(distinct.select("at", "halves", "parts"), "distinct")

    halves = distinct.filter("halves is not null").select("at", F.explode("halves").alias("half"))
    asked = with_groups(halves, ["half"], F.count("*").alias("n"), name="halves", having="n > 1").select("at").distinct()
    asked = asked.groupBy("at.doc_id", "at.tag").agg(F.collect_list("at.line_no").alias("asked"))
    candidates = written(_lines(_with(text, asked, ["doc_id", "tag"], "inner"), "doc_id", "tag", asked="asked").select(at.alias("at"), "line"), "candidates")
    near = _near(candidates, of)
    if edits_in:
        near = near.unionByName(_near_by_parts(distinct, text, of, edits_in)).distinct()
    near = written(near, "near")

    found = distinct.select("at").join(near.withColumn("near", F.lit(True)), "at", "left").select("at.*", "near")
    line = F.struct("line_no", F.coalesce("near", F.lit(False)).alias("near"))
    first = found.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(line)).alias("first"))
    rows = packed_rows(docs, drop=["line_dedup"]).select("row", F.col("row")[id_col].alias("doc_id"), F.xxhash64(F.col("row")[text_col]).alias("tag"))
    joined = _with(rows, first, ["doc_id", "tag"], "left")
    return _without(joined, text_col, [c for c in docs.columns if c != "line_dedup"])


def _flags(numbers: Column) -> Column:
    """From the sorted numbers of a text's chosen lines, a flag for each line up to the last of them."""

    def flags(k: Column) -> Column:
        return F.flatten(F.transform(k, lambda n, i: F.concat(F.array_repeat(F.lit(False), n - F.coalesce(F.get(k, i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))

    return let(numbers, flags)


def _lines(text: DataFrame, *kept: str, asked: str | None = None) -> DataFrame:
    """(kept columns, line_no, line) of each line with a word, or of those whose numbers `asked` has, as it is compared."""
    plain = F.lower("text")
    for gap in WORD_GAP.replace("\n", ""):
        plain = F.replace(plain, F.lit(gap), F.lit(" "))
    all_lines = F.split(plain, "\n")
    if asked:
        numbered = F.transform(all_lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
        some = let(_flags(F.sort_array(asked)), lambda f: F.filter(numbered, lambda x: F.coalesce(F.get(f, x["line_no"]), F.lit(False))))
        each = text.select(*kept, F.explode(some).alias("l")).select(*kept, "l.*")
    else:
        each = text.select(*kept, F.posexplode(all_lines).alias("line_no", "line"))
    single = F.when(F.contains("line", F.lit("  ")), F.regexp_replace("line", " +", " ")).otherwise(F.col("line"))
    return each.withColumn("line", F.trim(single)).filter("line <> ''")


def _halves(line: Column, of: Unit, least: int) -> Column:
    """Hashes of the line's first and last units, as many as the half of the largest power of two that it has; null for lines
    that must be equal. A line whose count is a power of two also gives the halves that lines of one unit less have."""

    def both(k: Column) -> list[Column]:
        return [F.xxhash64(F.lit("first"), of.first(line, k)), F.xxhash64(F.lit("last"), of.last(line, k))]

    def found(n: Column) -> Column:
        k = F.pow(F.lit(2.0), F.floor(F.log2(n + 0.5)) - 1).cast("int")
        return F.when(n < least, None).when((n == 2 * k) & (k > 1), F.array(*both(k), *both((k / 2).cast("int")))).otherwise(F.array(*both(k)))

    return found(of.count(line))


#: A unit ends a part of a line if its hash says so, one in so many.
_PART_UNITS = 5
#: What stands for the units of two lines when they are compared.
_LETTERS = "".join(map(chr, range(0x4E00, 0x9E00)))


def _parts(line: Column, of: Unit, edits_in: int) -> Column:
    """Hashes of a line's parts of three units or more, null of lines too short for two edits. Parts end at units that a hash chooses, so a missing
    or extra unit moves no other part."""
    ends = lambda u: F.pmod(F.xxhash64(u), F.lit(_PART_UNITS)) == 0
    cut = lambda units: F.split(F.array_join(F.transform(units, lambda u: F.concat(u, F.when(ends(u), "\n").otherwise(" "))), ""), "\n")
    long = lambda part: of.count(F.trim(part)) >= 3
    keys = lambda units: F.array_distinct(F.transform(F.filter(cut(units), long), lambda p: F.xxhash64(p)))
    return F.when(of.count(line) >= 2 * edits_in, let(of.each(line), keys))


def _near_by_parts(distinct: DataFrame, text: DataFrame, of: Unit, edits_in: int) -> DataFrame:
    """at of the lines that are within one edit in `edits_in` units of the earliest line that has a part of theirs."""
    keyed = distinct.filter("parts is not null").select("at", F.explode("parts").alias("part"))
    stars = with_groups(keyed, ["part"], F.min("at").alias("earlier"), F.count("*").alias("n"), name="parts", having="n > 1")
    pairs = written(stars.filter("at <> earlier").select("at", "earlier").distinct(), "part-pairs")
    asked = pairs.select("at").unionByName(pairs.select(F.col("earlier").alias("at"))).distinct()
    asked = asked.groupBy("at.doc_id", "at.tag").agg(F.collect_list("at.line_no").alias("asked"))
    lines = _lines(_with(text, asked, ["doc_id", "tag"], "inner"), "doc_id", "tag", asked="asked").select(F.struct("doc_id", "tag", "line_no").alias("at"), "line")
    lines = written(lines.dropDuplicates(["at"]), "part-lines")
    both = pairs.join(lines, "at").join(lines.select(F.col("at").alias("earlier"), F.col("line").alias("earlier_line")), "earlier")
    return both.filter(_few_edits(of.each(F.col("line")), of.each(F.col("earlier_line")), edits_in)).select("at").distinct()


def _few_edits(a: Column, b: Column, edits_in: int) -> Column:
    """Whether two arrays of units are at most one edit in `edits_in` units of the shorter one apart: a letter stands for each unit that they
    have between them. Lines with more different units than there are letters are not near."""

    def near(x: Column) -> Column:
        a, b, known = x["a"], x["b"], x["known"]
        letters = lambda units: F.array_join(F.transform(units, lambda u: F.substring(F.lit(_LETTERS), F.array_position(known, u).cast("int"), F.lit(1))), "")
        most = F.floor(F.least(F.size(a), F.size(b)) / edits_in).cast("int")
        able = (F.abs(F.size(a) - F.size(b)) <= most) & (F.size(known) <= len(_LETTERS))
        return F.when(able, F.levenshtein(letters(a), letters(b)) <= most).otherwise(F.lit(False))

    return let(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("known")), near)


def _with(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """left joined with right's other columns by keys, of which the first may be null."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(named, same[0] & same[1], how).drop(*[f"_{k}" for k in keys])


def _variants(candidates: DataFrame, of: Unit) -> DataFrame:
    """(at, place, variant): the hash of each line without the unit at place, and at place 0 of the whole.

    A hash is the xor of the units' own, each with its place: those before the deleted one keep theirs, those after it move up.
    """
    unit = candidates.dropDuplicates(["at"]).select("at", F.posexplode(of.each(F.col("line"))).alias("p", "unit"))
    placed = unit.select("at", "p", F.xxhash64("unit", "p").alias("a"), F.xxhash64("unit", F.col("p") - 1).alias("b"))
    so_far, line = Window.partitionBy("at").orderBy("p").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("at")
    summed = placed.select("at", "p", "a", F.bit_xor("a").over(so_far).alias("a_to"), F.bit_xor("b").over(so_far).alias("b_to"), F.bit_xor("a").over(line).alias("a_all"), F.bit_xor("b").over(line).alias("b_all"))
    rest = F.col("a_to").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b_all")).bitwiseXOR(F.col("b_to"))
    deleted = F.struct((F.col("p") + 1).alias("place"), rest.alias("variant"))
    whole = F.struct(F.lit(0).alias("place"), F.col("a_all").alias("variant"))
    return summed.select("at", F.explode(F.when(F.col("p") == 0, F.array(deleted, whole)).otherwise(F.array(deleted))).alias("v")).select("at", "v.*")


def _near(candidates: DataFrame, of: Unit) -> DataFrame:
    """at of the candidates that are one edit from an earlier candidate."""
    variants = written(_variants(candidates, of), "variants")
    deleted, whole = variants.filter("place > 0"), variants.filter("place = 0").select("variant", F.col("at").alias("other"))
    changed = with_groups(deleted, ["variant", "place"], F.min("at").alias("other"), F.count("*").alias("n"), name="earliest", having="n > 1").select("at", "other")
    missing = deleted.select("variant", "at").join(whole, "variant").select("at", "other")
    pairs = changed.unionByName(missing).filter("at <> other")
    pairs = pairs.select(F.greatest("at", "other").alias("at"), F.least("at", "other").alias("earlier")).distinct()
    both = pairs.join(candidates, "at").join(candidates.select(F.col("at").alias("earlier"), F.col("line").alias("earlier_line")), "earlier")
    return both.filter(_one_edit(of.each(F.col("line")), of.each(F.col("earlier_line")))).select("at").distinct()


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of units are at most one changed, missing or extra one apart."""

    def common(x: Column, y: Column) -> Column:
        same = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: z["x"].eqNullSafe(z["y"]))
        stop = F.array_position(same, False)
        return F.when(stop > 0, stop - 1).otherwise(F.least(F.size(x), F.size(y)))

    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longer - 1)


def _without(joined: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
    """The rows with their lines that are first in the corpus and near none, and the lines without a word."""
    text = F.col("row")[text_col]
    numbers = F.transform(F.filter("first", lambda x: ~x["near"]), lambda x: x["line_no"])
    lines = F.split(text, "\n")
    blank = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]")
    left = let(_flags(numbers), lambda f: F.filter(lines, lambda x, i: F.coalesce(F.get(f, i), F.lit(False)) | blank(x)))
    near = F.coalesce(F.size(F.filter("first", lambda x: x["near"])), F.lit(0)).cast("long")
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    done = joined.withColumn("first", F.coalesce("first", F.array().cast("array<struct<line_no:int,near:boolean>>"))).select("row", "first", left.alias("left"))
    facts = F.when(text.isNull(), F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n_lines", "n_repeated", "n_near")])).otherwise(
        F.struct(n_lines.alias("n_lines"), (n_lines - F.size("left") - near).alias("n_repeated"), near.alias("n_near"))
    )
    kept = F.when(text.isNotNull(), F.array_join("left", "\n"))
    return unpacked_rows(done, columns, {text_col: kept}, {"line_dedup": facts})
