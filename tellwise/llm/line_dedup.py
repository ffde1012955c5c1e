"""Near-duplicate lines, with DataFrame operations only.

Lines are compared in lower case and without outer blanks, as sets of character shingles. Equal lines
meet by hash. Of each different line a signature of 6 x 9 MinHash values is computed, each value the
least hash of its own hash function: a shingle is hashed once and dealt to one of six groups by that
hash, which takes nine values of it. So a signature costs nine values a shingle and not 54, and a value
still agrees with the chance of the coefficient, as a group is a random part of the union of two sets.
Groups of small sets would be nearly alike in all nine values; lines with few shingles therefore put
every shingle into each of six other groups. Lines of a middle size have both signatures, so that
lines that are similar share a kind; so have long lines that repeat few shingles, which their values
give away.

Three values of different groups make a band, no two bands from the same three groups. Lines that
agree on a band are candidates. Pairs of candidates are first held against each other by two bits of
each value, so that texts are read only for pairs that may reach the similarity, and then verified by
the exact Jaccard coefficient of their shingle sets. Verified pairs are edges, components are classes, and
of each class the first line in order of (doc_id, position) stays.

Pairs are not formed within a band's group at large. A group's members are compared with one of them, which
has then met all of the group and leaves it, and components are contracted, in two turns; the members of groups
that still fall apart are then dealt into chunks, and chunks are compared with chunks by their bitmaps, members of one component left out. Pairs
inside one component can't change it.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.llm.base import discard, fresh, quoted, settled, text_or_empty
from tellwise.llm.components import components, merged

SHINGLE = 7
SIMILARITY = 0.8
GROUPS, VALUES = 6, 9
#: Groups of each band: all threes but two that share none, so each group is in nine bands.
BANDS = [t for t in itertools.combinations(range(GROUPS), 3) if t not in ((0, 1, 2), (3, 4, 5))]
#: Lines with fewer shingles have the signature for small sets, those with more than FEW the other one.
SMALL, FEW = 60, 40
#: A line whose estimated number of different shingles is below this is small, however long.
REPETITIVE = 50
#: Differing values (of 54, by two bits each) up to which a pair is verified: a pair at 0.8 has 8.1 on
#: average and more than 22 with a chance of one in a million.
DIFFERING = 22
#: Members of a chunk; longs of a line's bitmap; ids that may be broadcast to find their lines (8 MB).
CHUNK, WORDS, LOOKUP = 256, 16, 1 << 20
#: Turns in which members are compared with one of their group, before chunks are compared.
TURNS = 2
#: Bits of a band's key (the last one is the kind). Each line moves with eighteen keys, so they are kept short;
#: a key that two bands share by chance makes candidates that the values tell apart.
KEY = (1 << 48) - 2
_PART, _LONG_PART = 256, 4096


def _constants(n: int) -> list[int]:
    """Fixed pseudo-random 64-bit numbers (a multiplicative sequence)."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        out.append((x ^ (x >> 29)) - (1 << 63))
    return out


def normalised(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r\f\x0b")))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, pos, norm, id) of every line that isn't blank."""
    cut = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_hash"), F.posexplode(F.split(text_or_empty(quoted(text_col)), "\n")).alias("pos", "line"))
    lines = cut.select("doc_id", "text_hash", "pos", normalised(F.col("line")).alias("norm")).where("norm <> ''")
    return lines.withColumn("id", F.xxhash64("norm"))


def told_apart(lines: DataFrame) -> DataFrame:
    """lines, different ones with different ids: the ids that two lines share (a few in 10 ** 11
    lines, normally none) are replaced by hashes of both of a line's hashes."""
    shared = settled(lines.groupBy("id").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select(F.col("id").alias("twin")))
    if shared.isEmpty():
        return lines
    own = F.when(F.col("twin").isNull(), F.col("id")).otherwise(F.xxhash64("id", "check"))
    return lines.join(shared, F.col("id") == F.col("twin"), "left").withColumn("id", own).drop("twin")


def _shingle(encoded: Column, byte: Column, size: int) -> Column:
    return F.xxhash64(F.substring(encoded, byte, F.lit(2 * size)))


def _bytes(encoded: Column, size: int) -> Column:
    """The first byte (from 1) of each shingle of an encoded line, of the line if it is shorter."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(encoded) - (2 * size - 1)), F.lit(2))


def _n_shingles(encoded: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.length(encoded) / 2 - (size - 1)).cast("int")


def _shingles(norm: str, size: int) -> Column:
    """The set of hashes of a line's shingles of `size` UTF-16 units (a shorter line is one). The
    line is cut into parts first, as a lambda evaluates what it reads from outside for each element."""
    line = F.encode(norm, "UTF-16BE")
    parts = F.transform(F.sequence(F.lit(0), _n_shingles(line, size) - 1, F.lit(_LONG_PART)), lambda at: F.substring(line, 2 * at + 1, F.lit(2 * (_LONG_PART + size - 1))))
    hashed = F.transform(parts, lambda part: F.transform(_bytes(part, size), lambda byte: _shingle(part, byte, size)))
    return F.array_distinct(F.flatten(hashed))


def _different(lines: DataFrame) -> DataFrame:
    return lines.groupBy("id").agg(F.any_value("norm").alias("norm"))


def signatures(different: DataFrame, shingle: int = SHINGLE, small: int = SMALL, few: int = FEW) -> DataFrame:
    """(id, kind, keys, low, high, shingles): kind 0 for lines of at least `few` shingles, 1 for those of
    fewer than `small`; the keys of the bands (the last bit is the kind), two bits of each value in two
    longs, and in kind 0 an estimate of the number of different shingles. Lines shorter than a
    shingle are like no other line and have no row."""
    # A line of so many characters has as many units at least; only others are encoded to see.
    long_enough = (F.length("norm") >= shingle) | (F.length(F.encode("norm", "UTF-16BE")) >= 2 * shingle)
    encoded = different.where(long_enough).select("id", F.encode("norm", "UTF-16BE").alias("encoded"))
    n = _n_shingles(F.col("encoded"), shingle)
    each = [F.lit(k) for k in range(1, GROUPS + 1)]
    copies = F.when(n >= small, F.array(F.lit(0))).when(n >= few, F.array(F.lit(0), *each)).otherwise(F.array(*each))
    # A row for each part of a line, then for every shingle of a part: a row's line is copied whenever
    # it is read. No array is empty; an explode that allows for it has no filter put before it, which
    # would encode each line again.
    parts = (encoded.select("id", "encoded", copies.alias("copies"), F.explode_outer(F.sequence(F.lit(0), n - 1, F.lit(_PART))).alias("start"))
             .select("id", F.explode_outer("copies").alias("copy"), F.substring("encoded", 2 * F.col("start") + 1, F.lit(2 * (_PART + shingle - 1))).alias("part")))
    rows = (parts.select("id", "copy", "part", F.explode_outer(_bytes(F.col("part"), shingle)).alias("byte"))
            .select("id", "copy", _shingle(F.col("part"), F.col("byte"), shingle).alias("hashed")))
    slot = F.when(F.col("copy") == 0, F.pmod("hashed", F.lit(GROUPS))).otherwise(F.col("copy") + (GROUPS - 1)).cast("int")
    dealt = rows.select("id", slot.alias("slot"), "hashed").select("id", "slot", F.xxhash64("hashed", "slot").alias("hashed"))
    least = dealt.groupBy("id", "slot").agg(*(F.min(F.xxhash64(F.col("hashed").bitwiseXOR(F.lit(c)))).alias(f"m{j}") for j, c in enumerate(_constants(VALUES))))
    group = F.col("slot") % GROUPS
    kind = F.when(F.col("slot") < GROUPS, F.lit(0)).otherwise(F.lit(1)).alias("kind")
    own = [F.col(f"m{j}") for j in range(VALUES)]
    # Two bits of each value, in the place of the group, and an estimate of its number of shingles: the sum of its
    # least values, as parts of the whole range, tells that. Both are made here, group by group: over all values
    # of a line they would be one method too large for the JVM to compile.
    bits = functools.reduce(Column.bitwiseOR, (F.shiftleft(m.bitwiseAND(F.lit(3)), 2 * j) for j, m in enumerate(own)))
    place = (2 * VALUES * (group % (GROUPS // 2))).cast("int")
    counted = (VALUES - 1) / sum((m.cast("double") / 2.0 ** 64 + 0.5 for m in own), F.lit(0.0))
    least = least.select("*", F.call_function("shiftleft", bits, place).alias("bits"), counted.alias("counted"))
    half = group < GROUPS // 2
    low, high = (F.coalesce(F.bit_or(F.when(side, F.col("bits"))), F.lit(0).cast("long")) for side in (half, ~half))
    whole = least.groupBy("id", kind).agg(*(F.min(F.when(group == g, F.col(f"m{j}"))).alias(f"v{g}_{j}") for g in range(GROUPS) for j in range(VALUES)),
                                          low.alias("low"), high.alias("high"), F.sum("counted").alias("shingles"))
    used, keys = [0] * GROUPS, []
    for b, band in enumerate(BANDS):
        values = [F.col(f"v{g}_{used[g]}") for g in band]
        for g in band:
            used[g] += 1
        key = F.xxhash64(F.lit(b), *values).bitwiseAND(F.lit(KEY)).bitwiseOR(F.col("kind").cast("long"))
        keys.append(F.when(values[0].isNotNull() & values[1].isNotNull() & values[2].isNotNull(), key))
    # array_except and not array_compact, which is a lambda: the hashes in it would not be compiled.
    return whole.select("id", "kind", F.array_except(F.array(*keys), F.array(F.lit(None).cast("long"))).alias("keys"), "low", "high", "shingles")


def candidates(lines: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(key, id, low, high) of the lines that share a band with another, in Parquet."""
    signed = [settled(signatures(_different(lines), shingle), release=True)]
    # Long lines of few different shingles get the signature for small sets as well.
    small = signed[0].where("kind = 1").select("id")
    again = settled(signed[0].where((F.col("kind") == 0) & (F.col("shingles") < REPETITIVE)).join(small, "id", "left_anti").select("id"))
    if not again.isEmpty():
        signed.append(settled(signatures(_different(_among(lines, again)), shingle, 1 << 30, 1 << 30)))
    both = signed[0].unionByName(signed[-1]) if len(signed) > 1 else signed[0]
    # One exchange serves both the look for shared keys and their members.
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = both.select("id", F.explode("keys").alias("key")).repartition(partitions, "key")
    shared = banded.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("key")
    members = settled(banded.join(shared.hint("shuffle_hash"), "key"), release=True)
    bits = both.select("id", F.col("kind").cast("long").alias("kind"), "low", "high")
    found = settled(members.withColumn("kind", F.col("key").bitwiseAND(F.lit(1))).join(bits, ["id", "kind"]).select("key", "id", "low", "high"), release=True)
    for table in (*signed, members):
        discard(table)
    return found


def _among(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """lines with one of the (settled, different) ids. These are broadcast if they are few."""
    return lines.join(F.broadcast(ids) if ids.count() <= LOOKUP else ids, "id", "left_semi")


def _alike(a_low: str, a_high: str, b_low: str, b_high: str) -> Column:
    """May two signatures of one kind belong to lines of the similarity?"""
    def differing(x: str, y: str) -> Column:
        bits = F.col(x).bitwiseXOR(F.col(y))
        return F.bit_count(bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return differing(a_low, b_low) + differing(a_high, b_high) <= DIFFERING


def _bitmaps(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, n, words): the number of a line's different shingles, and a bitmap in which each of them flips the
    bit that its hash names. In the exclusive or of two bitmaps the shingles of both lines cancel
    out, however many there are. A line's shingles are made different as an array, within its row: a
    distinct of (id, shingle) would hold all of them in memory or spill."""
    rows = texts.select("id", F.explode(_shingles("norm", shingle)).alias("hashed"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("hashed").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright("hashed", 6).bitwiseAND(F.lit(WORDS - 1))
    rows = rows.select("id", bit.alias("bit"), word.alias("word"))
    words = [F.coalesce(F.bit_xor(F.when(F.col("word") == k, F.col("bit"))), F.lit(0).cast("long")).alias(f"w{k}") for k in range(WORDS)]
    return rows.groupBy("id").agg(F.count("*").alias("n"), *words)


def _reachable(left: str, right: str, similarity: float) -> Column:
    """May two bitmaps belong to lines of the similarity? See _verified()."""
    n, m = F.col(f"{left}_n"), F.col(f"{right}_n")
    differing = sum((F.bit_count(F.col(f"{left}{k}").bitwiseXOR(F.col(f"{right}{k}"))) for k in range(WORDS)), F.lit(0))
    return (F.least(n, m) + 1e-6 >= similarity * F.greatest(n, m)) & (differing <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6)


def _side(maps: DataFrame, name: str, *more: str) -> DataFrame:
    """Bitmaps (id, n, words) with the columns named after one side of a pair."""
    return maps.select(*more, F.col("id").alias(name), F.col("n").alias(f"{name}_n"), *(F.col(f"w{k}").alias(f"{name}{k}") for k in range(WORDS)))


def _verified(pairs: DataFrame, lines: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b; settled) whose lines have at least the similarity.

    A bit that differs in two bitmaps stands for at least one shingle of one line only, so
    pairs with too many of those can't reach the similarity: with D shingles that are in one of two
    sets, the coefficient is (|A| + |B| - D) / (|A| + |B| + D). Nor can pairs of too different numbers.
    The sets themselves are compared for the others."""
    ids = settled(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = settled(_different(_among(lines, ids)), packed=True)
    maps = settled(_bitmaps(texts.repartition("id"), shingle))
    near = pairs.join(_side(maps, "a"), "a").join(_side(maps, "b"), "b").where(_reachable("a", "b", similarity)).select("a", "b")
    a = texts.select(F.col("id").alias("a"), F.col("norm").alias("a_line"))
    b = texts.select(F.col("id").alias("b"), F.col("norm").alias("b_line"))
    sets = near.join(a, "a").join(b, "b").select("a", "b", _shingles("a_line", shingle).alias("x"), _shingles("b_line", shingle).alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    found = settled(sets.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"), release=True)
    for table in (ids, texts, maps):
        discard(table)
    return found


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _apart(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members with root, those of the groups that are in more than one component."""
    known = members.join(classes, "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = known.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return known.join(split, "key")


def _centers(members: DataFrame, turn: int) -> DataFrame:
    """(key, c_id, c_root, c_low, c_high): one member (with root) of each group. In each turn a member of
    another component may be that one."""
    order = F.xxhash64("root", F.lit(turn)) if turn else F.col("root")
    center = members.groupBy("key").agg(F.min(F.struct(order.alias("order"), "root", "id", "low", "high")).alias("c"))
    return center.select("key", *(F.col(f"c.{x}").alias(f"c_{x}") for x in ("id", "root", "low", "high")))


def _with_center(members: DataFrame, centers: DataFrame) -> DataFrame:
    """Pairs of each group's members with its center, in other components, that may be similar."""
    near = members.join(centers, "key").where((F.col("root") != F.col("c_root")) & _alike("low", "high", "c_low", "c_high"))
    return _distinct(near.select(F.col("id").alias("a"), F.col("c_id").alias("b")))


def _others(members: DataFrame, centers: DataFrame) -> DataFrame:
    """members (without root) but the centers, which have been compared with all of their group."""
    return members.join(centers.select("key", "c_id"), "key").where("id <> c_id").drop("c_id", "root")


def _by_chunks(members: DataFrame, similarity: float) -> DataFrame:
    """All pairs of members of a group (with bitmaps, and the keys of all groups that an id is a member
    of), in different components, that may be similar; each in the first group that both are in. Groups
    are dealt into chunks of about CHUNK members; a cell (key, l, r) compares two chunks."""
    chunks = members.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = members.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    left = _side(dealt, "a", "key", F.col("chunk").alias("l"), F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("r"),
                 F.col("root").alias("a_root"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("keys").alias("a_keys"))
    right = _side(dealt, "b", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunk"))).alias("l"), F.col("chunk").alias("r"),
                  F.col("root").alias("b_root"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.col("keys").alias("b_keys"))
    same = (left["key"] == right["key"]) & (left["l"] == right["l"]) & (left["r"] == right["r"])
    wanted = (F.col("a_root") != F.col("b_root")) & ((left["l"] < right["r"]) | (F.col("a") < F.col("b"))) & _alike("a_low", "a_high", "b_low", "b_high") & _reachable("a", "b", similarity)
    first = left["key"] == F.array_min(F.array_intersect("a_keys", "b_keys"))
    return _distinct(left.join(right, same & wanted & first).select("a", "b"))


def line_classes(lines: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, root) of the lines that are in a class with a different line."""
    found = candidates(lines, shingle)
    members = found.withColumn("root", F.col("id"))
    centers = settled(_centers(members, 0))
    seen = settled(_with_center(members, centers))
    classes = settled(components(_verified(seen, lines, shingle, similarity)))
    for turn in range(1, TURNS + 1):
        apart = settled(_apart(_others(members, centers), classes), release=True)
        discard(found)
        if turn < TURNS:
            found, members, centers = apart, apart, settled(_centers(apart, turn))
            pairs = settled(_with_center(apart, centers).join(seen, ["a", "b"], "left_anti"))
            classes = merged(classes, _verified(pairs, lines, shingle, similarity))
            seen = seen.union(pairs)
    ids = settled(apart.groupBy("id").agg(F.collect_list("key").alias("keys")))
    maps = settled(_bitmaps(_different(_among(lines, ids.select("id"))), shingle).join(ids, "id"))
    rest = settled(_by_chunks(apart.join(maps, "id"), similarity).join(seen, ["a", "b"], "left_anti"), release=True)
    for table in (apart, ids, maps):
        discard(table)
    return merged(classes, _verified(rest, lines, shingle, similarity))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, text_hash, removed): the positions of the lines that go, for documents with any."""
    # The second hash isn't kept, as it is read only once, with the lines.
    lines = told_apart(settled(_lines(docs, id_col, text_col), packed=True).withColumn("check", F.xxhash64(F.lit(1), "norm")))
    classes = line_classes(lines, **how)
    places = lines.select("id", "doc_id", "text_hash", "pos")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "pos")
    first = places.groupBy("id").agg(F.min(place).alias("first"))
    classed = first.join(classes, "id", "left")
    heads = classed.where("root is not null").groupBy("root").agg(F.min("first").alias("head"))
    keep = classed.join(heads, "root", "left").select("id", F.coalesce("head", "first").alias("head"))
    gone = places.join(keep, "id").where(place != F.col("head"))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, removed (positions from 0 of the lines
    that go, in order).

    Lines end at line feeds; a null text is one blank line. Blank lines always stay. Rows that
    repeat whole (id and text) are judged as one, so each keeps the lines that one of them would.
    A null doc_id comes last in order. Other columns are not read; an empty table gives no rows.
    """
    gone = removed_lines(docs, id_col, text_col, **how)
    text = text_or_empty(quoted(text_col))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    rows = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_hash"), n_lines.alias("n_lines"))
    same = rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["text_hash"] == gone["text_hash"])
    removed = F.coalesce(gone["removed"], F.array().cast("array<int>"))
    return rows.join(gone, same, "left").select(rows["doc_id"], "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns and rows, with the lines that go taken out of the text. A document that
    loses all its lines keeps its row and has an empty text. Null texts stay null; rows that repeat whole
    lose the same lines; columns may have any names; an empty table gives no rows."""
    own, hashed, removed = fresh(docs, "gone_id", "gone_hash", "gone")
    gone = removed_lines(docs, id_col, text_col, **how).select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed), F.col("removed").alias(removed))
    same = quoted(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(quoted(text_col)) == F.col(hashed))
    cut = F.split(quoted(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(removed))
    text = F.when(F.col(removed).isNull(), quoted(text_col)).otherwise(F.array_join(F.transform(kept, lambda at: F.get(cut, at)), "\n"))
    return docs.join(gone, same, "left").select(*((text if c == text_col else quoted(c)).alias(c) for c in docs.columns))
