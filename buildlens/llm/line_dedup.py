"""Line deduplication by an exact set-similarity join.

A line is removed if an earlier line, in the order of (document id, text hash,
line number), has a word set with a Jaccard similarity of at least 4/5. Only
DataFrame functions are used.

1. Equal lines become one row, their first occurrence. Copies are combined
   before the shuffle and never meet in pairs. The rows, with the first of their
   ordered words as numbers, are written once to the shared folder in buckets of
   the line's key: later steps read the columns they need and join by line without
   a shuffle. Shuffle files of finished steps are removed at once.
2. Words are ordered by rarity: occurrences are counted in ``2 ** 16`` hash
   buckets over all texts, and a word's place in the order is its bucket's
   binary order of magnitude, then its hash. Any fixed order is exact; rare
   words first keep the groups below small.
3. Lines that share the three words after or before one of three places in the
   circle of their sorted hashes meet the earliest of them only. Those that are similar to
   it are settled. This is linear, and settles nearly all of a large group of
   similar lines.
4. Two similar sets share a word among the first few of both (prefix filter),
   not too far from the start of either (positional filter), and have similar
   sizes (length filter). Each entry also has 64 or 128 parity bits of its set: the
   sets differ in at least as many words as these differ in bits. All four are
   conditions of one join, which lists no pair of two settled lines.
5. The candidates' word sets are compared in full.

Words are what single spaces, tabs, form feeds and carriage returns separate,
known by 57 bits of their hash in the search and by 64 in the comparison. Blank lines stay, and lines of fewer than ``least``
words. Lines are
known by 64 bits of their hash; different lines of the same 64 bits, told by 64
others, all stay. Sets of up to three words are similar only to equal sets: their lines are
known by the set, so that step 1 settles them and they never enter the join. A
line that white space does not part is one word, and only equal lines repeat it.

Defined cases: null texts have no lines. Rows with a null id come first. Rows
that agree in id and text are one document, so both copies keep the same
lines. Lines of any length take part whole.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import checkpointed, scratch_folder, shuffles_removed

BUCKETS = 1 << 16
#: What an entry of the join is for: looking for smaller sets, being found by larger ones.
SEEKS, FOUND = 1, 2
HASH_BITS = 57
#: Sets of up to so many words are similar only to equal ones.
SMALL = 3
#: Sets of so many words have twice the parity bits.
LARGE = 64
#: Where the sorted hashes of a set are cut: for bands at the thirds, for parity bits in halves.
CUTS = (-(1 << 63) + (1 << 64) // 3, 0, -(1 << 63) + (1 << 65) // 3)
#: From so many words on, 128 parity bits are too few to part two sets of similar sizes.
HUGE = 1024


def _spaced(text: Column) -> Column:
    """Other white space inside lines as spaces, where there is any."""
    other = [F.contains(text, F.lit(c)) for c in "\t\r\f\v"]
    return F.when(other[0] | other[1] | other[2] | other[3],
                  F.regexp_replace(text, "[\t\r\f\x0b]", " ")).otherwise(text)


def _words(line: Column) -> Column:
    return F.split(line, " ")


def _full(line: Column, least: int) -> Column:
    """Whether a line has at least ``least`` words."""
    if least <= 1:
        return F.trim(line) != ""
    return F.rlike(line, F.lit(f"^ *+[^ ]++(?: ++[^ ]++){{{least - 1}}}"))


def _known_by(line: Column) -> Column:
    """What equal lines have in common: the line; for lines with small sets, the set."""

    def words(pieces: Column) -> Column:
        return F.array_distinct(F.array_remove(pieces, ""))

    # most lines have more different words than that among their first pieces
    few = F.size(words(_words(F.substring_index(line, " ", 7)))) <= SMALL
    small = few & (F.size(words(_words(line))) <= SMALL)
    # the marked set is no other line's text: a line has no line break
    return F.when(small, F.concat(F.lit("\n"), F.array_join(
        F.sort_array(words(_words(line))), " "))).otherwise(line)


def _key(known: Column) -> Column:
    return F.xxhash64(known)


def _early(kind, value: Column) -> Column:
    """A number that grows with an id, if not always strictly; null first."""
    if isinstance(kind, IntegralType):
        number = value.cast("long")
    else:
        number = F.conv(F.rpad(F.substring(F.hex(value.cast("string")), 1, 14), 14, "0"), 16, 10).cast("long")
    return F.coalesce(number, F.lit(-(1 << 63)).cast("long"))


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, text_key, no, line) of all lines of at least ``least`` words."""
    # The key and the lines before the generator: else it would carry the text
    # along with each line, and the key be computed for each.
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"),
                        F.split(_spaced(F.col(text_col)), "\n").alias("lines"))
    # outer: else Spark splits the text twice more, to filter out texts without lines
    lines = split.select("id", "text_key", F.posexplode_outer("lines").alias("no", "line"))
    # a line of ``least`` words has more characters than that; the cheap test comes first
    return lines.filter((F.octet_length("line") >= 2 * least - 1) & _full(F.col("line"), least))


def _rarity(docs: DataFrame, text: Column) -> Column:
    """The order of magnitude of every bucket's count, as an array; of all texts' words."""
    words = docs.select(F.explode(_words(F.replace(_spaced(text), F.lit("\n"), F.lit(" ")))).alias("w"))
    bucket = F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    counts = words.select(bucket.alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    # one small number for each of a fixed number of buckets
    found = {r["b"]: r["n"].bit_length() for r in counts.collect()}
    # becomes one array literal, as only one expression uses it
    ranks = F.lit(",".join(str(found.get(b, 0)) for b in range(BUCKETS)))
    return F.split(ranks, ",").cast("array<bigint>")


def _hashes(line: Column) -> Column:
    """A line's different words as numbers."""
    # pieces between adjacent spaces are no words
    return F.array_distinct(F.transform(F.array_remove(_words(line), ""), lambda word: F.xxhash64(word)))


def _ranked(hashes: Column, rarity: Column) -> Column:
    """Hashes of different words as numbers that are smaller for rare ones."""

    def number(code: Column) -> Column:
        # every bucket has a rank; that no number is null makes for a faster sort
        rank = F.coalesce(rarity[code.bitwiseAND(F.lit(BUCKETS - 1))], F.lit(0).cast("long"))
        return F.shiftleft(rank, HASH_BITS).bitwiseOR(F.shiftrightunsigned(code, 64 - HASH_BITS))

    return F.transform(hashes, number)


def _once(value: Column) -> Column:
    """The value, computed once: a generator's result is not computed again for each use."""
    return F.explode(F.array(value))


def _parity(words: Column) -> Column:
    """64 parity bits of a set: every word flips one."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, word: bits.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63)).cast("int"))))


def _below(marked: Column, cut: int) -> Column:
    """How many of a sorted set's words lie below a cut; ``marked`` is the set with the cuts in it."""
    place = F.array_position(marked, F.lit(CUTS[cut]).cast("long"))
    return (place - (cut + 1)).cast("int")


def _bands(ring: Column, starts: list[Column]) -> Column:
    """Hashes of the three words after and before each start in the circle of the sorted words.

    Read from any start, the circle is a pseudorandom order of the words. ``ring`` has
    three words more at each end.
    """
    return F.array(*[F.xxhash64(F.slice(ring, start + first, F.lit(3))) for start in starts for first in (4, 1)])


def _first_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Each different line, or small set, and where it first occurs; stored by key.

    (key, mixed, id, text_key, no) of every line, ``mixed`` if another line has its
    key; itself, the ``prefix`` of its ordered
    words, their number ``n``, parity bits ``p0`` and ``p1``, its ``bands`` and ``early``,
    all null if its words are few.
    """
    spark = docs.sparkSession
    rarity = _rarity(docs, F.col(text_col))
    lines = _lines(docs, id_col, text_col, least)
    known = lines.select("id", "text_key", "no", "line", _once(_known_by(F.col("line"))).alias("known"))
    # by the key alone, so that a task's rows are those of one bucket
    other = F.xxhash64(F.lit(1), "known")
    firsts = known.groupBy(_key(F.col("known")).alias("key")).agg(
        F.min(F.struct("id", "text_key", "no", "line")).alias("m"), (F.min(other) != F.max(other)).alias("mixed"))
    # Functions with a lambda are interpreted, with all that stands inside them;
    # the others are compiled. So each step is a column, used more than once.
    sets = firsts.select("key", "mixed", "m.id", "m.text_key", "m.no", "m.line",
                         _hashes(F.col("m.line")).alias("hashes"))
    sets = sets.select("key", "mixed", "id", "text_key", "no", "line", F.size("hashes").alias("n"),
                       F.sort_array("hashes").alias("sorted"), F.sort_array(_ranked(F.col("hashes"), rarity)).alias("words"))
    marked = F.sort_array(F.concat("sorted", F.array(*[F.lit(cut).cast("long") for cut in CUTS])))
    sets = sets.withColumn("marked", marked)
    below = [_below(F.col("marked"), cut) for cut in range(len(CUTS))]
    ring = F.concat(F.slice("sorted", -3, 3), "sorted", F.slice("sorted", 1, 3))
    sets = sets.withColumns({"low": below[0], "half": below[1], "high": below[2], "ring": ring})
    n, half = F.col("n"), F.col("half")
    sets = sets.withColumns({"lower": _parity(F.slice("sorted", F.lit(1), half)),
                             "upper": _parity(F.slice("sorted", half + 1, n))})
    # 64 bits tell sets of up to as many words apart, larger ones have 128; the
    # two halves of a large set's bits, combined, are its 64
    lower, upper = F.col("lower"), F.col("upper")
    p0 = F.when(n >= LARGE, lower).otherwise(lower.bitwiseXOR(upper))
    p1 = F.when(n >= LARGE, upper).otherwise(F.lit(0).cast("long"))
    # at least 4/5 of a set must be in the other one
    prefix = F.slice("words", F.lit(1), (n - F.ceil(n * 4 / 5) + 1).cast("int"))
    early = _early(docs.schema[id_col].dataType, F.col("id")).alias("early")
    bands = _bands(F.col("ring"), [F.lit(0), F.col("low"), F.col("high")])
    searched = [F.col("line"), n.alias("n"), p0.alias("p0"), p1.alias("p1"), prefix.alias("prefix"), early, bands.alias("bands")]
    stored = sets.select("key", "mixed", "id", "text_key", "no",
                         F.when((n > SMALL) & ~F.col("mixed"), F.struct(*searched)).alias("s")).select(
        "key", "mixed", "id", "text_key", "no", "s.*")
    # as many buckets as the shuffle has partitions: each is written by one task
    name = f"lines_{uuid.uuid4().hex}"
    stored.write.format("parquet").option("path", scratch_folder(spark, "lines")).option(
        "compression", "zstd").bucketBy(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "key").saveAsTable(name)
    table = spark.table(name)
    # the files stay, and the frame knows them; only the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def _plausible(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Those pairs whose sizes and parity bits allow a similarity of 4/5; no words are moved for the others."""
    known = firsts.filter("n IS NOT NULL").select("key", "n", "p0", "p1")
    one, other = (known.select(F.col("key").alias(key), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "p0", "p1")])
                  for key, side in (("key", "a"), ("other", "b")))
    n, m = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    p0, p1 = (F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b")) for p in ("p0", "p1"))
    differ = F.when(n >= LARGE, F.bit_count(p0) + F.bit_count(p1)).otherwise(F.bit_count(p0.bitwiseXOR(p1)))
    return pairs.join(one, "key").join(other, "other").filter(
        (5 * n >= 4 * m) & (9 * differ <= n + m)).select("key", "other")


def _settled_by_leaders(firsts: DataFrame) -> DataFrame:
    """(key): lines that are similar to the earliest of those they share a band with."""
    bands = firsts.filter("n IS NOT NULL").select(
        "key", "early", F.explode("bands").alias("band"))
    # the numbers of a group only, combined before the shuffle
    leaders = bands.groupBy("band").agg(
        F.min_by("key", "early").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = bands.select("band", "key").join(leaders, "band").filter(F.col("key") != F.col("leader"))
    # a line's leaders are at most as many as its bands
    pairs = checkpointed(_plausible(met.select("key", F.col("leader").alias("other")).distinct(), firsts))
    return checkpointed(_similar(pairs, firsts))


def _entries(firsts: DataFrame, settled: DataFrame) -> DataFrame:
    """(key, p0, p1, packed): the prefix of every line's set.

    ``packed`` is the word, by 39 bits, the size class (4) it is looked for or
    found under, the size of the set (10), the place of the word in it (8), whether
    the line is open (1) and its role (2). Two words that agree in their bits only
    make a candidate more. Sets that are too large for this have size 0 there, and
    size and place in ``p1`` instead of parity bits, which would tell nothing at
    that size.
    """
    closed = settled.withColumn("open", F.lit(False))
    large = firsts.filter("n IS NOT NULL").select("key", "n", "p0", "p1", "prefix").join(closed, "key", "left")
    size = F.col("n")
    # Sizes are classed by powers of 4. A set is looked for under its own class;
    # as the smaller one it can be found there, with the words that 8/9 of it
    # allow, and under the class of the largest similar set where that differs.
    def scale_of(largest: Column) -> Column:
        return F.floor(F.log(largest + 0.5) / math.log(4)).cast("int")

    # before the generator: what stands beside it is computed for each of its rows
    sets = large.select(
        "key", F.coalesce("open", F.lit(True)).cast("long").alias("open"), "n", "p0", "p1",
        scale_of(size).alias("scale"), scale_of(size * 5 / 4).alias("upper"),
        (size - F.ceil(size * 8 / 9) + 1).cast("int").alias("found"), "prefix")
    entries = sets.select("key", "open", "n", "p0", "p1", "scale", "upper", "found",
                          F.posexplode("prefix").alias("at", "word"))
    early = F.col("at") < F.col("found")
    # role and class in one number
    own = F.when(early, SEEKS + FOUND).otherwise(SEEKS) + 4 * F.col("scale")
    following = FOUND + 4 * F.col("upper")
    entries = entries.select("key", "open", "n", "p0", "p1", "at", "word", F.explode(
        F.when(early & (F.col("upper") > F.col("scale")), F.array(own, following)).otherwise(F.array(own))).alias("as"))
    # a class is below 16: sizes are below 2 ** 31
    word = F.shiftleft(F.col("word").bitwiseAND(F.lit((1 << 39) - 1)), 4).bitwiseOR(
        F.shiftright("as", 2).cast("long"))
    n, at = F.col("n").cast("long"), F.col("at").cast("long")
    huge = F.col("n") >= HUGE
    here = F.when(huge, F.lit(0).cast("long")).otherwise(F.shiftleft(n, 11).bitwiseOR(F.shiftleft(at, 3)))
    role = F.col("as").bitwiseAND(F.lit(3)).cast("long")
    return entries.select(
        "key", "p0", F.when(huge, F.shiftleft(n, 32).bitwiseOR(at)).otherwise(F.col("p1")).alias("p1"),
        F.shiftleft(word, 21).bitwiseOR(here).bitwiseOR(F.shiftleft("open", 2)).bitwiseOR(role).alias("packed"))


def _candidates(entries: DataFrame) -> DataFrame:
    """(key, other): lines that pass all filters, one of them open."""
    # Both sides of the join use every column and no side is filtered before
    # it, so both read one and the same shuffle.
    a, b = entries.alias("a"), entries.alias("b")

    def bits(value: Column, low: int, count: int) -> Column:
        return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << count) - 1))

    def size_and_place(side: str) -> tuple[Column, Column, Column]:
        packed, p1 = F.col(f"{side}.packed"), F.col(f"{side}.p1")
        huge = bits(packed, 11, 10) == 0
        return (huge, F.when(huge, bits(p1, 32, 31)).otherwise(bits(packed, 11, 10)),
                F.when(huge, bits(p1, 0, 32)).otherwise(bits(packed, 3, 8)))

    (huge_a, n, at_a), (huge_b, m, at_b) = size_and_place("a"), size_and_place("b")
    # an overlap of 4/9 of both sizes together is a similarity of 4/5
    shared = F.shiftrightunsigned("a.packed", 21) == F.shiftrightunsigned("b.packed", 21)
    roles = bits(F.col("a.packed"), 1, 1).bitwiseAND(F.col("b.packed")) == 1
    either = bits(F.col("a.packed").bitwiseOR(F.col("b.packed")), 2, 1) == 1
    order = (n < m) | ((n == m) & (F.col("a.key") < F.col("b.key")))
    length = 5 * n >= 4 * m
    rest = F.least(n - at_a, m - at_b)
    position = 9 * rest >= 4 * (n + m)
    # the first set is the smaller one
    p0, p1 = (F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}")) for p in ("p0", "p1"))
    differ = F.when(n >= LARGE, F.bit_count(p0) + F.bit_count(p1)).otherwise(
        F.bit_count(p0.bitwiseXOR(p1)))
    parity = huge_a | huge_b | (9 * differ <= n + m)
    return a.join(b, shared & roles & either & order & length & parity & position).select(
        F.col("a.key").alias("key"), F.col("b.key").alias("other")).distinct()


def _similar(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key): the later line of each of those pairs whose word sets are similar, compared in full."""
    wanted = pairs.select(F.explode(F.array("key", "other")).alias("key")).distinct()
    place = F.struct("id", "text_key", "no")
    # Each line once: both sides read this shuffle. It is by another column than
    # the key, or it would be left out, and a line with very many partners could
    # not be split.
    known = firsts.filter("n IS NOT NULL").join(wanted, "key").select(
        F.bitwise_not("key").alias("ref"), place.alias("place"),
        _hashes(F.col("line")).alias("words")).repartition("ref")
    one, other = (known.select(*[F.col(c).alias(f"{c}_{side}") for c in known.columns]) for side in "ab")
    n, m = F.size("words_a"), F.size("words_b")
    both = F.size(F.array_intersect("words_a", "words_b"))
    later = F.col("place_a") > F.col("place_b")
    referred = pairs.select(F.bitwise_not("key").alias("ref_a"), F.bitwise_not("other").alias("ref_b"))
    found = referred.join(one, "ref_a").join(other, "ref_b").filter(9 * both >= 4 * (n + m))
    return found.select(F.bitwise_not(
        F.when(later, F.col("ref_a")).otherwise(F.col("ref_b"))).alias("key")).distinct()


def _repeats(firsts: DataFrame) -> DataFrame:
    """(key): lines with a similar line before them."""
    settled = _settled_by_leaders(firsts)
    pairs = checkpointed(_candidates(_entries(firsts, settled)))
    return checkpointed(settled.union(_similar(pairs, firsts)).distinct())


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               least: int = 5) -> DataFrame:
    """(id, text_key, kept): for each document the full lines that stay, by number from 0.

    Documents of which no full line stays are not listed.
    """
    with shuffles_removed(docs.sparkSession):
        firsts = _first_lines(docs, id_col, text_col, least)
        repeats = _repeats(firsts)
    stay = firsts.filter("NOT mixed").join(repeats, "key", "left_anti").select("id", "text_key", "no")
    mixed = firsts.filter("mixed").select("key")
    if not mixed.isEmpty():
        lines = _lines(docs, id_col, text_col, least).withColumn("key", _key(_known_by(F.col("line"))))
        stay = stay.union(lines.join(mixed, "key", "left_semi").select("id", "text_key", "no"))
    # lines of one document lie scattered, so lists begun before the shuffle
    # would only be wider than the numbers
    stay = stay.repartition("id", "text_key")
    return stay.groupBy("id", "text_key").agg(F.collect_list("no").alias("kept"))


def _joined(docs: DataFrame, kept: DataFrame, id_col: str, text_key: Column) -> DataFrame:
    """``docs`` with ``_kept``, an empty array where nothing is kept."""
    here = docs.withColumn("_text_key", text_key)
    found = kept.select(F.col("id").alias("_doc"), F.col("text_key").alias("_its_key"), F.col("kept").alias("_kept"))
    on = F.col(id_col).eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_its_key"))
    return here.join(found, on, "left").withColumn(
        "_kept", F.coalesce("_kept", F.array().cast("array<int>"))).drop("_doc", "_its_key", "_text_key")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least: int = 5) -> DataFrame:
    """(id, n_lines, n_removed, removed) of every row; line numbers from 0, ascending."""
    kept = kept_lines(docs, id_col, text_col, least)
    split = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"),
                        _once(F.split(_spaced(F.col(text_col)), "\n")).alias("_lines"))
    full = F.filter(F.transform("_lines", lambda line, i: F.when(_full(line, least), i)),
                    lambda i: i.isNotNull())
    slim = split.select(
        "_id", "_key", F.greatest(F.coalesce(F.size("_lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(full, F.array().cast("array<int>")).alias("_full"))
    joined = _joined(slim, kept, "_id", F.col("_key"))
    removed = F.array_except("_full", "_kept")
    return joined.select(F.col("_id").alias(id_col), "n_lines", F.size(removed).cast("long").alias("n_removed"),
                         removed.alias("removed"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    least: int = 5) -> DataFrame:
    """``docs`` with the removed lines gone from their texts; no row is dropped."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_id"),
                         F.col(text_col).alias("_text"))
    kept = kept_lines(docs, id_col, text_col, least)
    joined = _joined(packed, kept, "_id", F.xxhash64("_text"))
    lines = F.split("_text", "\n")
    stays = F.filter(lines, lambda line, i: ~_full(_spaced(line), least) | F.array_contains(F.col("_kept"), i))
    text = F.when(F.size("_kept") == F.size(lines), F.col("_text")).otherwise(F.array_join(stays, "\n"))
    return joined.withColumn("_text", text).select(
        *[F.col("_text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
