"""Toxicity: restored words, held-out labels, what a score may depend on."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tellwise.llm.toxicity import Reader, drop_toxic, features, fit, hidden_parts, language_model, restore, toxicity_scores, undoubled


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(9)
    plain = ["meadow", "river", "stone", "garden", "window", "letter", "summer", "kettle", "ladder", "forest"]
    rude = ["blatherer", "pillock", "wazzock", "numpty"]
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 40))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(rude))
        rows.append((i, " ".join(words), "en", 1.0))
        if i % 5:
            labels.append((i, 1, int(i % 4 == 0)))
    rows += [(2000, None, None, None), (2001, "", "en", 1.0), (None, "a wazzock and a numpty", "en", 1.0), (7, rows[7][1], "en", 1.0)]
    labels += [(3000, 1, 1), (None, 1, 1), (1, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores(spark, tables):
    docs, labels = tables
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 900:
            assert r.predicted == int(r.doc_id % 4 == 0)
    other = toxicity_scores(docs.withColumn("lang", F.lit("xx")), labels.where("doc_id is not null")).collect()
    assert sorted(map(str, got)) == sorted(map(str, other))


def test_hidden_words_are_restored_and_scored(spark, tables):
    docs, labels = tables
    model = spark.sparkContext.broadcast(language_model(docs))
    fitted, reader = fit(docs, labels, model), Reader(model.value)
    for hidden in ("p1ll0ck", "p i l l o c k", "p.i.l.l.o.c.k", "nuuumpty", "nnuummppttyy", "numpty99", "w@zz0ck"):
        assert [restore(p, model.value) for p in hidden_parts(hidden)][0] in ("pillock", "numpty", "wazzock"), hidden
        assert fitted.score(reader.words(f"you {hidden} and {hidden}")) > fitted.score(reader.words("you garden and river"))
    assert hidden_parts("a plain meadow, (stone); garden!") == []


def test_every_token_with_a_look_alike_or_a_doubled_letter_is_read(spark, tables):
    docs, _ = tables
    more = docs.select("text").unionByName(spark.createDataFrame([("idiot ass loss clown trash scum moron stupid troll " * 40,)], "text string"))
    reader = Reader(language_model(more))
    for hidden, word in (("idio7", "idiot"), ("idio7,", "idiot"), ("trol1", "troll"), ("5cum", "scum"), ("a$$", "ass"), ("a$$!", "ass"), ("@$$", "ass"),
                         ("lo$$", "loss"), ("(lown", "clown"), ("+rash", "trash"), ("stuupid", "stupid"), ("mooron.", "moron")):
        assert word in reader.words(f"you {hidden} there"), hidden
    assert {"you", "stuupid", "idio"} <= reader.words("you stuupid idio7")
    assert reader.words("in 1999 it was 455") == {"in", "it", "was"}


def test_doubled_letters_are_decided_as_the_lattice_does(spark, tables):
    rnd = random.Random(4)
    flat = language_model(tables[0]).ravel().tolist()
    for _ in range(2000):
        word = "".join(rnd.choice("aeilmnt") * rnd.choice((1, 1, 2)) for _ in range(rnd.randint(2, 7)))
        if all(3 * c not in word for c in word):
            assert undoubled(word, flat) == restore(word, flat), word


def test_signs_and_letters_beyond_ascii(spark, tables):
    docs, _ = tables
    more = docs.select("text").unionByName(spark.createDataFrame([("loser troll idiot clown " * 40,)], "text string"))
    reader = Reader(language_model(more))
    for hidden, word in (("los€r", "loser"), ("€ los€r –", "loser"), ("tro££", "troll"), ("¡diot", "idiot"), ("l\u043es\u0435r", "loser"), ("l\u03bfser", "loser"),
                         ("lo\u0301ser", "loser"), ("\uff4c\uff4f\uff53\uff45\uff52", "loser"), ("tr\u043e11", "troll"), ("c l \u043e w n", "clown")):
        assert word in reader.words(f"you {hidden} there"), hidden
    assert reader.words("злой человек, κακός 悪い “quoted” – пять") == {"злой", "человек", "κακός", "悪い", "quoted", "пять"}


def test_words_of_other_scripts_are_learned(spark):
    rude = ["дурак", "осёл"]
    rows = [(i, f"тихий сад {'и ' + rude[i % 2] if i % 4 < 2 else 'у реки'} номер") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 < 2)) for i in range(400)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id % 4 < 2, r.predicted) for r in toxicity_scores(docs, labels).collect()} == {(True, 1), (False, 0)}


def test_dropping_takes_nulls_any_names_and_no_rows(spark, tables):
    docs, labels = tables
    odd = docs.select("doc_id", "text").limit(300).unionByName(spark.createDataFrame([(None, None), (None, None), (-1, "")], "doc_id long, text string")).withColumn("score", F.lit("s")).withColumn("_id", F.lit(1))
    left = drop_toxic(odd, labels)
    assert left.columns == odd.columns
    rows = left.where("doc_id is null or doc_id < 0").collect()
    assert len(rows) == 3 and 0 < left.count() < 303
    assert drop_toxic(odd.limit(0), labels).count() == 0


def test_no_labels_and_no_rows(spark, tables):
    docs, labels = tables
    assert {r.score for r in toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity_scores(docs.limit(0), labels).count() == 0


def test_held_out_labels_of_the_given_table(spark):
    """Labels that the model hasn't learned from: at least nine of ten found, nine of ten right."""
    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    known = toxicity_scores(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    right = sum(r.predicted == r.toxic == 1 for r in known)
    assert len(known) > 500
    assert right / sum(r.toxic == 1 for r in known) >= 0.85 and right / sum(r.predicted == 1 for r in known) >= 0.9


def test_a_reader_of_wanted_features_finds_them_all_and_little_else(spark, tables):
    model = language_model(tables[0])
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("aeilmnt") * rnd.choice((1, 1, 1, 2)) for _ in range(rnd.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(200)] + ["you idio7 trо11 c l o w n", "looser losers lost losing", ""]
    every = Reader(model)
    seen = sorted({x for text in texts for x in features(every.words(text))})
    wanted = rnd.sample([x for x in seen if "-" not in x or len(x) > 6], 200) + ["lose-", "lose-2", "los", "nothing"]
    some = Reader(model, wanted)
    told = 0
    for text in texts * 2:  # read, then remembered
        told += len(some.words(text))
        assert features(some.words(text)) & set(wanted) == features(every.words(text)) & set(wanted), text
    assert 0 < told < 0.3 * sum(len(every.words(text)) for text in texts * 2)
    assert Reader(model, []).words(texts[0]) == set()
