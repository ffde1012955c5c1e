"""Personal data: rules against the plain patterns, added spans in disguise."""

from __future__ import annotations

import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tellwise.llm.pii import COMMON, KINDS, Trees, _endings, _Taken, added_spans, base_spans, fit, luhn, personal_data, proposals

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = {}
    for kind, pattern in PLAIN.items():
        spans = []
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(n) <= 19 and kind == "card" and luhn(n), "phone": 9 <= len(n) <= 15}[kind]
            if good:
                spans.append(m.span())
        out[kind] = spans
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-_ 1290+()%é\n", max_size=60))
def test_rules_are_the_plain_patterns(text):
    assert base_spans(text) == plain(text)


def _docs(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        card = "".join(rnd.choice("0123456789") for _ in range(15))
        card = next(card + d for d in "0123456789" if luhn(card + d)) if i % 2 else card + "0"
        rows.append((i, f"word user{i}@mail{i % 9}.example.com {rnd.randint(0, 400)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.3 and {card} "
                        f"call +1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)} version 3.{i} in {rnd.randint(1900, 2030)} é"))
    rows += [(1000, None), (1001, ""), (None, "a@b.cd"), (7, rows[7][1]), (7, rows[7][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' base", "1 spans"), rows


def test_every_row_keeps_what_the_rules_find(spark):
    docs, rows = _docs(spark)
    got = sorted(((r.doc_id, [tuple(s) for s in r.base], {tuple(s) for s in r.spans}) for r in personal_data(docs).collect()), key=str)
    want = sorted(((i, sorted(((k, *s) for k, spans in plain(t or "").items() for s in spans), key=lambda x: (x[1], KINDS.index(x[0]))), set()) for i, t in rows), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(set(g[1]) <= g[2] for g in got)


def test_disguised_addresses_are_added_and_clean_text_is_left(spark):
    docs, _ = _docs(spark)
    trees = fit(docs)
    text = "please write to jane.doe [at] mail3 [dot] example [dot] com soon"
    assert ("email", 16, 59) in added_spans(text, base_spans(text), trees)
    clean = "In 1999 we met at the dot of noon, version 3.11, page 12 of 480."
    assert added_spans(clean, base_spans(clean), trees) == []


def test_a_rare_kind_has_a_threshold_however_many_documents_lack_it(spark):
    docs, _ = _docs(spark)
    no_cards = docs.selectExpr("doc_id", "regexp_replace(text, '[0-9]{16}', 'none') text")
    many = no_cards.crossJoin(spark.range(12)).selectExpr("10000 + 20 * doc_id + id doc_id", "text")
    rare = many.unionByName(spark.createDataFrame([(1, "pay with 4111 1111 1111 1111 now")], "doc_id long, text string"))
    trees = fit(rare)
    assert trees.thresholds["card"] <= 1 and trees.thresholds["email"] <= 1
    assert fit(many).thresholds["card"] > 1


def test_no_rows(spark):
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spelt_addresses_of_any_ending_and_long_names_are_proposed():
    for text in ("write to anna at post dot de now", "x at mail dot example dot co dot uk", f"{'a' * 90} at host dot uk", f"{'b' * 70} (at) host (dot) fr"):
        found = [text[a:b] for kind, a, b in proposals(text, frozenset(("de", "uk"))) if kind == "email"]
        assert any(x.endswith(("dot de", "dot uk", "(dot) fr")) for x in found), text


def test_endings_come_from_the_corpus(spark):
    texts = ["a@b.example.de, c@d.co.uk.", "e@f.FR!", "none", "g@h.i-j", "k@l.it.5"]
    assert _endings(spark.createDataFrame([(t,) for t in texts], "text string")) == COMMON | {"de", "uk", "fr"}


def test_overlaps_are_found_by_bisection():
    rnd = random.Random(2)
    for _ in range(300):
        spans = [(a, a + rnd.randint(1, 6)) for a in (rnd.randint(0, 60) for _ in range(rnd.randint(0, 6)))]
        taken = _Taken(spans)
        for _ in range(20):
            a = rnd.randint(0, 66)
            b = a + rnd.randint(1, 6)
            assert taken.meets(a, b) == any(a < e and s < b for s, e in spans)
            if not taken.meets(a, b):
                taken.add(a, b)
                spans.append((a, b))


def test_time_grows_with_the_length_of_a_text():
    text = " and ".join(str(10 ** 12 + i) for i in range(40_000))
    trees = Trees((1.0,), ((5.0,),), dict.fromkeys(KINDS, 0.0))
    began = time.process_time()
    assert len(added_spans(text, {}, trees)) == 40_000
    assert time.process_time() - began < 20
