"""Near-duplicate lines against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tellwise.llm import line_dedup
from tellwise.llm.components import components
from tellwise.llm.line_dedup import SHINGLE, candidates, drop_repeated_lines, line_decisions, told_apart


def _norm(line):
    return line.strip(" \t\r\f\x0b").lower()


def _set(line):
    raw = line.encode("utf-16-be")
    n = max(1, len(raw) // 2 - SHINGLE + 1)
    return frozenset(raw[2 * i:2 * (i + SHINGLE)] for i in range(n))


def brute(rows):
    """(doc_id, removed) by comparing all lines; rows of (doc_id, text)."""
    places = [(d is None, d, i, _norm(line)) for d, t in rows for i, line in enumerate((t or "").split("\n")) if _norm(line)]
    norms = sorted({p[3] for p in places})
    root = {n: n for n in norms}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    sets = {n: _set(n) for n in norms}
    for i, a in enumerate(norms):
        for b in norms[i + 1:]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    first = {}
    for nameless, d, i, n in places:
        first[top(n)] = min(first.get(top(n), (True, 10 ** 9, 0)), (nameless, d or 0, i))
    gone = {}
    for nameless, d, i, n in places:
        if first[top(n)] != (nameless, d or 0, i):
            gone.setdefault(d, []).append(i)
    return sorted(((d, tuple(sorted(set(gone.get(d, []))))) for d, _ in rows), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 40))) for _ in range(60)]

    def variant(line):
        words = line.split(" ")
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        return " ".join(words).upper() if rnd.random() < 0.1 else " ".join(words)

    out = [(i, "\n".join(variant(rnd.choice(base[:10] if rnd.random() < 0.5 else base)) for _ in range(rnd.randint(0, 6)))) for i in range(80)]
    long = " ".join(rnd.choice(vocabulary) for _ in range(900))
    return out + [(100, None), (101, ""), (102, "\n \n"), (None, base[0] + "\nä ö ü ß 日本語 line"), (103, long), (104, long[:-9] + "x\nä ö ü ß 日本語 line")]


def test_lines_match_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({})
    got = sorted(((r.doc_id, tuple(r.removed)) for r in line_decisions(docs).collect()), key=str)
    assert got == brute(rows)


def test_texts_lose_these_lines_and_other_columns_stay(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, id string, removed int")
    cut = {r.doc_id: r for r in drop_repeated_lines(docs).collect()}
    assert len(cut) == len(rows) and drop_repeated_lines(docs).columns == docs.columns
    gone = dict(brute(rows))
    for d, t in rows:
        lines = (t or "").split("\n")
        expected = "\n".join(x for i, x in enumerate(lines) if i not in gone[d])
        assert (cut[d].text or "") == expected


@pytest.mark.parametrize("shingles", [9, 27, 90])
def test_candidates_miss_next_to_no_pair_of_similarity_0_8(spark, shingles):
    rnd = random.Random(shingles)
    changed = shingles // 9  # so many of each line's shingles are not the other's
    pairs = []
    for _ in range(2500):
        a = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(shingles + SHINGLE - 1))
        pairs.append((a, a[:-changed] + "".join(chr(rnd.randrange(0x3041, 0x3096)) for _ in range(changed))))
    lines = spark.createDataFrame([(x,) for pair in pairs for x in pair], "norm string").withColumn("id", F.xxhash64("norm"))
    lines = lines.withColumn("check", F.xxhash64(F.lit(1), "norm"))
    found = {r.norm for r in lines.join(candidates(lines), "id", "left_semi").collect()}
    assert sum(not found.issuperset(pair) for pair in pairs) <= 1
    assert all(abs(len(_set(a) & _set(b)) / len(_set(a) | _set(b)) - 0.8) < 0.01 for a, b in pairs)


def test_no_rows(spark):
    assert line_decisions(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rnd = random.Random(5)
    name = {i: rnd.getrandbits(62) for i in range(400)}
    edges = [(i, i + 1) for i in range(99)] + [(100, i) for i in range(101, 200)] + [(200, 200), (301, 300), (300, 301), (301, 302)]
    got = {r.id: r.root for r in components(spark.createDataFrame([(name[a], name[b]) for a, b in edges], "a long, b long")).collect()}
    groups = [range(100), range(100, 200), (300, 301, 302)]
    assert got == {name[i]: min(name[j] for j in g) for g in groups for i in g}


def test_short_and_repetitive_lines(spark):
    rnd = random.Random(12)
    texts = ["-" * n for n in (5, 6, 7, 8, 9, 10, 11, 300)] + ["-=" * n for n in (4, 5, 60)] + ["\U0001F600" * n for n in (3, 4, 9, 90)]
    texts += ["abcdefg", "abcdefgh", "bcdefgh", "abcdefghijklm", "abcdefghijklmn", "x", "", "né" * 30, "NÉ" * 80]
    unit = [rnd.choice("abcdefgh") for _ in range(45)]
    texts += ["".join(unit * k) for k in (2, 3, 9)] + ["".join(unit * 4) + "z"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, tuple(r.removed)) for r in line_decisions(docs).collect()), key=str)
    assert got == brute(rows)


def test_lines_of_one_hash_are_told_apart(spark):
    rows = [(1, 10, "a"), (1, 11, "b"), (1, 10, "a"), (2, 12, "c")]
    lines = spark.createDataFrame(rows, "id long, check long, norm string")
    got = {(r.norm, r.id) for r in told_apart(lines).collect()}
    assert len(got) == 3 and ("c", 2) in got and len({i for _, i in got}) == 3


def test_groups_over_many_chunks(spark, monkeypatch, rows):
    monkeypatch.setattr(line_dedup, "CHUNK", 3)
    monkeypatch.setattr(line_dedup, "LOOKUP", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, tuple(r.removed)) for r in line_decisions(docs).collect()), key=str)
    assert got == brute(rows)


def test_any_column_names(spark):
    docs = spark.createDataFrame([(1, "same line here\nsame line here", 5, 6, "x.y")], "doc_id long, text string, gone int, gone_id int, `a.b` string")
    cut = drop_repeated_lines(docs)
    assert cut.columns == docs.columns and tuple(cut.first()) == (1, "same line here", 5, 6, "x.y")


def _in_groups(spark, norms, keys):
    """Members of all groups (keys), each a component of its own, with bitmaps; signatures that agree."""
    texts = spark.createDataFrame(list(enumerate(norms)), "id long, norm string")
    maps = line_dedup._bitmaps(texts.repartition("id"), SHINGLE)
    keyed = F.array(*map(F.lit, keys)).cast("array<long>")
    members = texts.select("id", F.explode(keyed).alias("key"), F.col("id").alias("root"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    return members.join(maps, "id").withColumn("keys", keyed)


def test_bits_that_differ_are_no_more_than_shingles_that_do(spark):
    rnd = random.Random(21)
    norms = ["".join(rnd.choice("ab") for _ in range(rnd.randint(7, 4000))) for _ in range(12)] + ["abc" * 300, "abc" * 301 + "d"]
    norms += [n[:-3] + "xyz" for n in norms]
    rows = {r.id: r for r in line_dedup._bitmaps(spark.createDataFrame(list(enumerate(norms)), "id long, norm string").repartition("id"), SHINGLE).collect()}
    for i, a in enumerate(norms):
        assert rows[i].n == len(_set(a))
        for j, b in enumerate(norms):
            differing = sum(((rows[i][f"w{k}"] ^ rows[j][f"w{k}"]) & (2 ** 64 - 1)).bit_count() for k in range(line_dedup.WORDS))
            assert differing <= len(_set(a) ^ _set(b))


def test_long_lines_below_the_similarity_make_no_pairs(spark):
    """Two thirds in common, in one large group: a bitmap that only fills up can't tell them apart."""
    rnd = random.Random(22)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(9))
    common = " ".join(word() for _ in range(80))
    norms = [common + " " + " ".join(word() for _ in range(40)) for _ in range(60)] + [common + " tail one", common + " tail two"]
    pairs = {(r.a, r.b) for r in line_dedup._by_chunks(_in_groups(spark, norms, [1]), 0.8).collect()}
    assert pairs == {(60, 61)}


def test_a_pair_comes_in_the_first_of_its_groups(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_distinct", lambda pairs: pairs)
    members = _in_groups(spark, ["the same line but for one", "the same line but for two", "nothing like the others"], [5, -3, 9, 12])
    assert [tuple(r) for r in line_dedup._by_chunks(members, 0.7).collect()] == [(0, 1)]


def test_a_center_has_met_its_group_and_leaves_it(spark):
    rows = [(1, i, 0, 0, i) for i in (4, 2, 7)] + [(2, i, 0, 0, i) for i in (5, 9)]
    members = spark.createDataFrame(rows, "key long, id long, low long, high long, root long")
    centers = line_dedup._centers(members, 0)
    assert {(r.a, r.b) for r in line_dedup._with_center(members, centers).collect()} == {(2, 4), (2, 7), (5, 9)}
    left = line_dedup._others(members, centers)
    assert {(r.key, r.id) for r in left.collect()} == {(1, 4), (1, 7), (2, 9)}
    classes = spark.createDataFrame([], "id long, root long")
    assert {(r.key, r.id, r.root) for r in line_dedup._apart(left, classes).collect()} == {(1, 4, 4), (1, 7, 7)}


def test_edges_are_put_onto_small_classes_without_shuffles(spark, monkeypatch):
    """Each shuffle has as many tasks as there are shuffle partitions, and the driver keeps a record of each task."""
    from tellwise.llm import components as graphs

    rnd = random.Random(6)
    name = [rnd.getrandbits(62) for _ in range(300)]
    first = [(i, i + 1) for i in range(0, 200, 2)]
    more = [(i, i + 2) for i in range(0, 100, 2)] + [(250, 251), (251, 252), (7, 250), (150, 150)]
    settled, plans = graphs.settled, []

    def watched(df, *how, **more_of_it):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df, *how, **more_of_it)

    def edges(pairs):
        return settled(spark.createDataFrame([(name[a], name[b]) for a, b in pairs], "a long, b long").repartition(3))

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        classes, added = settled(components(edges(first))), edges(more)
        monkeypatch.setattr(graphs, "settled", watched)
        got = {r.id: r.root for r in graphs.merged(classes, added).collect()}
        # The first plan puts edges onto the classes they join.
        assert plans[0].count("LeftOuter") == 2 and "Exchange" not in plans[0]
        monkeypatch.setattr(graphs, "SMALL", 0)
        assert got == {r.id: r.root for r in graphs.merged(classes, added).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    top = {i: i for pair in first + more for i in pair}
    for _ in range(300):
        for a, b in first + more:
            top[a] = top[b] = min(top[a], top[b])
    least = {t: min(name[i] for i in top if top[i] == t) for t in set(top.values())}
    assert got == {name[i]: least[t] for i, t in top.items()}


def test_keys_are_short_and_the_second_hash_is_not_kept(spark):
    rnd = random.Random(7)
    lines = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (20, 50, 90)]
    signed = line_dedup.signatures(spark.createDataFrame(list(enumerate(lines)), "id long, norm string")).collect()
    assert all(0 <= key < 1 << 48 and key & 1 == r.kind for r in signed for key in r["keys"])
    assert {len(r["keys"]) for r in signed} == {18} and {r.kind for r in signed} == {0, 1}
    assert "check" not in line_dedup._lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text").columns


def test_signatures_encode_a_line_once_and_compile_their_keys(spark):
    """A filter before an explode would encode each line again, and what a lambda reads is not compiled."""
    lines = spark.createDataFrame([(1, "a line of some length"), (2, "\U0001F600" * 4), (3, "short"), (4, "\U0001F600" * 3)], "id long, norm string")
    signed = line_dedup.signatures(lines)
    plan = signed._jdf.queryExecution().optimizedPlan().toString()
    # Once to be cut, and once for lines that may be too short.
    assert plan.count("UTF-16BE") == 2 and "lambda" not in plan
    assert {r.id for r in signed.collect()} == {1, 2}
