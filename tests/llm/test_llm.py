import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwell.llm import glyphs, leaks, mixing, names, personal, scans, splits, stuffing


def rows(df):
    return [tuple(r) for r in df.collect()]


# Look-alike text -----------------------------------------------------------------


@pytest.mark.parametrize(
    "a, b",
    [
        ("Ｊüｒｇｅｎ", "Jürgen"), ("Zoë", "Zoë"), ("Gilbeach La⁠wyers", "Gilbeach Lawyers"), ("R Quill\xadford", "R Quillford"),
        ("Lаwуers", "Lawyers"), ("ﬁlm", "film"), ("Κ.G.\xa0X", "K.G. X"), ("πόνoς", "πόνος"), ("", ""),
        ("\U0002f800", "\u4e3d"), ("\U0001d15e", "\U0001d157\U0001d165"), ("\U00011131\U00011127", "\U0001112e"), ("\u1112\u1161\u11ab", "\ud55c"), ("\u09c7\u09be", "\u09cb"),
    ],
)
def test_texts_that_look_the_same_become_equal(a, b):
    assert glyphs.settle_text(a) == glyphs.settle_text(b)


@pytest.mark.parametrize("a, b", [("Zoë", "Zoe"), ("Lee", "lee"), ("a-b", "a‐b"), ("O", "0"), ("l1", "ll"), ("a\nb", "a b"), ("x²", "x2"), ("①", "1"), ("боль", "6oль")])
def test_texts_that_look_different_stay_different(a, b):
    assert glyphs.settle_text(a) != glyphs.settle_text(b)


def test_consistent_form_is_stable_and_null_safe():
    rng = random.Random(1)
    pool = "abcXYZ .,-\n" + "éö" + "аеоср" + "οιν" + "ｆＵ" + "́​ ﬁ"
    for _ in range(500):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(30)))
        once = glyphs.settle_text(t)
        assert glyphs.settle_text(once) == once
        assert unicodedata.is_normalized("NFC", once)
    assert glyphs.settle_text(None) is None
    assert len(glyphs.settle_text("é​" * 200_000)) == 200_000


def test_same_look_pairs(spark):
    data = [("d", 1, 1, "Zoë"), ("d", 1, 2, "Zoë"), ("d", 1, 3, "Zoë"), ("d", 1, 3, "Zoë"), ("d", 2, 4, "Zoë"), (None, 1, 5, "Zoë"), ("d", 1, 6, None), ("d", 1, 7, "Zoe")]
    df = spark.createDataFrame(data, "document_id string, page int, page_id long, text string").withColumn("_h", F.lit(1)).withColumn("id_a", F.lit(2))
    got = {(r["id_a"], r["id_b"]) for r in glyphs.same_look_pairs(df, ["document_id", "page"], "page_id", "text").collect()}
    assert got == {("1", "2"), ("2", "3")}
    assert rows(glyphs.same_look_pairs(df.limit(0), ["document_id", "page"], "page_id", "text")) == []


# Related records -------------------------------------------------------------------


def _components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_hash_to_min_against_union_find(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(80):02}", f"n{rng.randrange(80):02}") for _ in range(60)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)]
    got = dict(rows(splits.hash_to_min(spark.createDataFrame([*edges, (None, "x")], "a string, b string"))))
    assert got == _components(edges)
    assert rows(splits.hash_to_min(spark.createDataFrame([], "a string, b string"))) == []


def test_related_documents_and_splits(spark):
    m = [("d1", "M1", "h1"), ("d2", "m1 ", None), ("d3", "m2", "H1"), ("d4", "m3", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), ("d5", "m4", "unknown"), ("d4", "m3", "n/a"), (None, "m1", "h1")]
    manifest = spark.createDataFrame(m, "document_id string, matter_id string, source_name_sha256 string")
    gold = spark.createDataFrame([("d4", "registry/person_unassigned"), ("d5", "Registry/Person_Unassigned"), ("d5", None)], "document_id string, canonical_id string")
    comp = splits.related_documents(manifest, gold)
    assert dict(rows(comp)) == {"d1": "d1", "d2": "d1", "d3": "d1", "d4": "d4", "d5": "d5"}
    assert set(rows(splits.groups_across_matters(manifest, comp))) == {("d1", "m1"), ("d2", "m1"), ("d3", "m1")}
    done = splits.assign_splits(comp).collect()
    assert len(done) == 5 and len({r["split"] for r in done if r["component"] == "d1"}) == 1
    lone = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("document_id"), F.concat(F.lit("c"), "id").alias("component"))
    first = {r["document_id"]: r["split"] for r in splits.assign_splits(lone).collect()}
    share = {r["split"]: r["share"] for r in splits.split_report(splits.assign_splits(lone)).collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03
    giant = spark.range(1500).select(F.concat(F.lit("g"), "id").alias("document_id"), F.lit("giant").alias("component"))
    later = {r["document_id"]: r["split"] for r in splits.assign_splits(lone.union(giant)).collect()}
    assert all(later[d] == s for d, s in first.items()) and len({later[f"g{i}"] for i in range(1500)}) == 1
    pinned = {r["document_id"]: r["split"] for r in splits.assign_splits(lone.union(giant), pins={"giant": "test"}).collect()}
    assert pinned["g7"] == "test" and all(pinned[d] == s for d, s in first.items())
    assert rows(splits.assign_splits(comp.limit(0))) == []


# Spellings ---------------------------------------------------------------------------


def test_spellings_of_one_person_and_organisation(spark):
    people = ["Jürgen Thornburn", "THORNBURN, Jürgen", "Jurgen Thornburn", "Thorburn, Jürgen", "Renée Thornburn", "Robert Hawshaw", "Bob Hawshaw", "R. Hawshaw", "Mr Hawshaw", "Hawshaw Robert"]
    orgs = ["Eumfield Medical Centre", "The Eumfield Medical Centre", "EMC", "Medical Centre, Eumfield", "Eumfield Med Ctr", "Eumfield Lawyers", "Eumfield Medical Centre P/L"]
    data = [("m", "PERSON", f"p{i}", t) for i, t in enumerate(people)] + [("m", "ORGANIZATION", f"o{i}", t) for i, t in enumerate(orgs)]
    data += [("m2", "PERSON", "x", "Jürgen Thornburn"), ("m", "PERSON", "n", None), ("m", "PERSON", "e", ""), (None, "PERSON", "q", "Jürgen Thornburn"), ("m", "PERSON", "p0", people[0])]
    got = {r["id"]: r["entity"] for r in names.spelling_entities(spark.createDataFrame(data, "matter string, etype string, id string, text string")).collect()}
    assert len({got[f"p{i}"] for i in (0, 1, 2, 3)}) == 1 and got["p4"] != got["p0"]
    assert len({got[f"p{i}"] for i in (5, 6, 7, 8, 9)}) == 1 and got["p5"] != got["p0"]
    assert len({got[f"o{i}"] for i in (0, 1, 2, 3, 4, 6)}) == 1 and got["o5"] != got["o0"]
    assert got["x"] != got["p0"] and not {"n", "e", "q"} & set(got)


def test_names_on_empty_tables(spark):
    empty = spark.createDataFrame([], "matter string, etype string, id string, text string")
    assert rows(names.spelling_entities(empty)) == []


def test_edit_distance_against_recursion():
    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        d = min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            d = min(d, slow(a[2:], b[2:]) + 1)
        return d

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in "ab")
        assert names.edits(a, b) == min(slow(a, b), 3)


# Personal information -------------------------------------------------------------------


LEX = personal.Lexicon({"harriet", "timothy", "zoe", "deborah"}, {"garwell", "wexridge", "brackbury"}, {"the", "report", "told", "me", "by", "and"}, {"marie"})


@pytest.mark.parametrize(
    "text, want",
    [
        ("Statements by Harriet Garwell and GARWELL, Harriet were enclosed.", [("Harriet Garwell", "PERSON"), ("GARWELL, Harriet", "PERSON")]),
        ("Mr Wexridge's recovery; Dr Harriet\nGarwell", [("Wexridge", "PERSON"), ("Harriet\nGarwell", "PERSON")]),
        ("T.Wexridge and zoe marie wexridge met", [("T.Wexridge", "PERSON"), ("zoe marie wexridge", "PERSON")]),
        ("Brackbury Lawyers and Brackbury Foundation, Garwell Street", []),
        ("mail a.b+c@post.example.com. or x_y [at] mail[dot]example", [("a.b+c@post.example.com", "EMAIL"), ("x_y [at] mail[dot]example", "EMAIL")]),
        ("call (08) 7010\n3113, +61 491 570 156 or 0491 57B 008", [("(08) 7010\n3113", "PHONE"), ("+61 491 570 156", "PHONE"), ("0491 57B 008", "PHONE")]),
        ("TFN 123 456 782, Medicare card number 2123 45670 1; Passp-\nort PA1000877; licence no. 339 221 201", [("123 456 782", "TFN"), ("2123 45670 1", "MEDICARE"), ("PA1000877", "PASSPORT"), ("339 221 201", "DRIVER_LICENCE")]),
        ("ABN 51 824 753 556, invoice number 545 577 972, batch 52438753", []),
        ("at Unit 4, 18/221 Fernrow Ct Lindvale 3447 with, PO Box 30 Oxenmont WA 7344.", [("Unit 4, 18/221 Fernrow Ct Lindvale 3447", "ADDRESS"), ("PO Box 30 Oxenmont WA 7344", "ADDRESS")]),
        ("[PERSON] c/o [MEDICARE]", []),
        ("Ζоё​ Wexridge", [("Ζоё​ Wexridge", "PERSON")]),
        ("", []),
    ],
)
def test_personal_spans(text, want):
    assert [(text[a:b], k) for a, b, k in personal.find_personal(text, LEX)] == want


def test_masking_keeps_the_rest():
    text = "Dear Harriet Garwell, call 0491 570 156."
    assert personal.masked(text, personal.find_personal(text, LEX)) == "Dear [PERSON], call [PHONE]."


def test_names_beyond_the_bound_are_found_by_join(spark):
    people = ["Garwell, Harriet", "Wexridge, Timothy", "Brackbury, Deborah", "Thornfield-Oakes, Zoe"]
    mentions = spark.createDataFrame([(p,) for p in people for _ in range(3)], "text string")
    texts = ["Harriet Garwell met Deborah Brackbury.", "the MacWexridge file and Zoe Thornfield-Oakes", "Mr Brackbury, then tirnothy wexridge; Tirnothy Wexridge", None, "", "no name at all"]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, text string").withColumn("h", F.lit("x")).withColumn("extra", F.lit(1))
    whole, cut = personal.name_lexicon(mentions, pages), personal.name_lexicon(mentions, pages, bound=1)
    assert whole.rest is None and cut.rest is not None and len(cut.surnames) <= 1
    found = [sorted(rows(personal.personal_spans(pages, "page_id", "text", x))) for x in (whole, cut)]
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 3
    masks = [sorted((r["page_id"], r["masked_text"]) for r in personal.masked_text(pages, "text", x).select("page_id", "masked_text").collect() if r["page_id"] != 3) for x in (whole, cut)]
    assert masks[0] == masks[1] and dict(masks[0])[0] == "[PERSON] met [PERSON]."


def test_long_texts_are_read_in_linear_time():
    text = "Dr Harriet Garwell of 12 Long Street Lindvale 3447 (0491 570 156), a.b@c.example. " * 3000
    assert len(personal.find_personal(text, LEX)) == 12000


def test_personal_spans_of_tables(spark):
    pages = spark.createDataFrame([(1, "Dear Harriet Garwell,"), (1, "Dear Harriet Garwell,"), (2, None), (3, ""), (None, "Harriet Garwell")], "page_id long, text string").withColumn("hint", F.lit(1)).withColumn("t", F.lit("x"))
    assert rows(personal.personal_spans(pages, "page_id", "text", LEX)) == [(1, 5, 20, "PERSON")]
    edits = spark.createDataFrame([(7, "[TFN] (orig. 824-271-067)", "TFN")], "edit_id long, replacement string, entity_type string")
    assert rows(personal.personal_spans(edits, "edit_id", "replacement", LEX, F.col("entity_type"))) == [(7, 13, 24, "TFN")]
    lex = personal.name_lexicon(spark.createDataFrame([("Garwell, Harriet",)] * 3, "text string"), pages.select("text"))
    assert "harriet" in lex.given and "garwell" in lex.surnames
    assert personal.name_lexicon(pages.limit(0).select("text"), pages.limit(0).select("text")).surnames == set()


# Scans ------------------------------------------------------------------------------------


def test_misread_words():
    for seen, meant in [("disturbecl", "disturbed"), ("premiiim", "premium"), ("rev!ew", "review"), ("weaknes5", "weakness"), ("shffness", "stiffness"), ("restrlcfion", "restriction")]:
        assert scans.misread_steps(seen, meant) <= scans.MOST_STEPS
        assert set(scans.index_keys(seen)) & set(scans.index_keys(meant))
    assert scans.misread_steps("house", "horse") > scans.MOST_STEPS
    assert scans.odd_digits("kneelin9") and scans.odd_digits("8718S") and scans.odd_digits("O491")
    assert not any(map(scans.odd_digits, ["70B", "WC4974444", "N9044054", "3rd", "0491570156", "20/04/2015", "zebshaw30"]))


def _pages():
    body = "the review of the schedule was done with care for the patient in the clinic"
    out = []
    for d in range(6):
        for p in (1, 2, 3):
            text = f"File ref: {d}7/1-2 Page {p} of 3\n{body}\nthe work-hardening pro-\ngramme and the programme of work-\nhardening went on\n{body}\nlast words {d} of {'abc'[p - 1] * 3} here"
            if p == 2:
                text += "\nthe revicw was sched-\nuled"
            out.append((d * 10 + p, f"d{d}", p, "ocr" if p < 3 else "hybrid", text))
    out.append((99, "d9", 1, "text_layer", body + " the revicw"))
    return [*out, (98, "d8", 1, "ocr", None), (97, "d8", 2, "ocr", ""), (1, "d0", 1, "ocr", out[0][4])]


def test_scan_noise(spark):
    df = spark.createDataFrame(_pages(), "page_id long, document_id string, page int, method string, text string").withColumn("line", F.lit(1)).withColumn("w", F.lit("x"))
    furniture, hyphens, wrong, _ = scans.read_scans(df)
    assert {r["line"] for r in furniture.collect()} == {0} and furniture.count() == 18
    assert {(r["line"], r["joined"]) for r in hyphens.collect()} >= {(2, "programme")} and not {r["line"] for r in hyphens.collect()} & {3}
    got = {(r["page_id"], r["w"], r["repair"]) for r in wrong.collect()}
    assert (2, "revicw", "review") in got
    fixed = {r["page_id"]: r["repaired_text"] for r in scans.repaired_pages(df).collect()}
    assert "File ref" not in fixed[2] and "programme and the programme of work-hardening" in fixed[2] and "review" in fixed[2] and "revicw" not in fixed[2]
    assert [rows(x) for x in scans.read_scans(df.limit(0))[:3]] == [[], [], []]


# Leaks ------------------------------------------------------------------------------------


def _edits_word(pattern, text):
    best = len(pattern)
    prev = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        cur = [i]
        for j, t in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (p != t)))
        prev = cur
    return min(prev, default=best)


def test_word_distance_against_dynamic_programme():
    rng = random.Random(6)
    for _ in range(300):
        p = [rng.choice("abc") for _ in range(rng.randrange(1, 8))]
        t = [rng.choice("abc") for _ in range(rng.randrange(0, 14))]
        for k in range(4):
            if len(p) > k:
                assert leaks.within(p, t, k) == (_edits_word(p, t) <= k)


def test_leaked_items_against_windows(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(5)]
    docs = []
    for d in range(40):
        noise = [rng.choice(vocab) for _ in range(80)]
        item = items[d % 5][1].split()
        n, changes = rng.choice([(18, 0), (25, 0), (32, 0), (40, 3), (60, 6), (36, 12)])
        part = item[:n]
        for k in rng.sample(range(n), changes):
            part[k] = "changed"
        docs.append((d, " ".join(noise[:40] + part + noise[40:]).title() + "."))
    docs += [(100, None), (101, ""), (0, docs[0][1])]
    ddf = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    idf = spark.createDataFrame([*items, (9, None), (8, "too short")], "item_id long, text string")
    got = set(rows(leaks.leaked_items(ddf, idf)))
    want = set()
    for d, t in docs:
        if t:
            w = leaks.words_of(t)
            for i, it in items:
                x = leaks.words_of(it)
                if any(_edits_word(x[p : p + n], w) <= n // 10 for n in range(30, 61, 10) for p in range(len(x) - n + 1)):
                    want.add((d, i))
    assert got == want and want
    assert rows(leaks.leaked_items(ddf.limit(0), idf)) == [] and rows(leaks.leaked_items(ddf, idf.limit(0))) == []


def test_a_passage_copied_into_many_rows_is_still_found(spark):
    rng = random.Random(18)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, stock = text(60), text(18)
    docs = [(d, "same start " + item) for d in range(60)]
    docs += [(100 + d, f"{text(20)} {item} {text(20)}") for d in range(40)]
    docs += [(200 + d, f"{text(30)} {stock} {text(30)}") for d in range(80)]
    ddf = spark.createDataFrame(docs, "doc_id long, text string")
    idf = spark.createDataFrame([(1, item), (2, f"{text(30)} {stock} {text(30)}")], "item_id long, text string")
    assert set(rows(leaks.leaked_items(ddf, idf))) == {(d, 1) for d, _ in docs if d < 200}


# Mixing --------------------------------------------------------------------------------------


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(1)
    tok = rng.integers(5, 300, 200).astype(float)
    pi = rng.random(200)
    out = mixing.flight(pi, np.vstack([tok, np.ones(200)]), 7)
    assert abs((out * tok).sum() - (pi * tok).sum()) < 1e-3 and abs(out.sum() - pi.sum()) < 1e-5
    assert ((out > 0) & (out < 1)).sum() <= 2


def test_mix_reaches_shares_and_caps(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice(["Big", "big ", "BIG"]) if i % 10 else "small-one", "word " * rng.randrange(5, 60)) for i in range(1200)]
    docs += [(5000, None, "x"), (5001, "big", None), (5002, "big", ""), (5003, "other", "y"), (0, "small-one", docs[0][2])]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("u", F.lit(1)).withColumn("pi", F.lit(2))
    target = spark.createDataFrame([("big", 0.7, 1), ("small_one", 0.3, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    chosen = mixing.mix_sources(df, target)
    rep = {r["source"]: r for r in mixing.mix_report(chosen, target).collect()}
    assert abs(rep["big"]["share"] - 0.7) < 0.01 and abs(rep["small_one"]["share"] - 0.3) < 0.01
    cap = {"big": 1, "small_one": 3}
    got = chosen.collect()
    assert all(1 <= r["repeats"] <= cap[r["source"]] for r in got) and len({r["doc_id"] for r in got}) == len(got)
    assert rows(mixing.mix_sources(df.limit(0), target)) == []


# Stuffing ------------------------------------------------------------------------------------


def test_stuffed_pages(spark):
    prose = "The claimant walked to the clinic on Monday. She was seen by a nurse who wrote a short note. Nothing else was found at the time."
    cases = [
        (1, prose, False), (2, " | ".join(["cheap loan", "fast loan", "Home", "loan in Perth"] * 10), True),
        (3, "\n".join(f"https://www.shop{i}.example/loan" for i in range(20)), True), (4, " ".join(["#loan", "#cheap", "#fast"] * 15), True),
        (5, "Tags: " + ", ".join(f"cheap loan ({i})" for i in range(30)), True), (6, "Our cheap loan is the cheap loan that cheap loan seekers trust. " * 8, True),
        (7, "Surname: Lee\nGiven names: Ann\nPhone: 12\nAddress: 3 Low Road\nEmployer: Acme\nRole: clerk\nDate: today", False),
        (8, prose + "\nSee https://a.example/x for more.", False), (9, "loan fast cheap claim voucher quote " * 12, True), (10, prose * 6, False), (11, None, False), (12, "", False),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in cases] + [(2, cases[1][1])], "doc_id long, text string").withColumn("share", F.lit(0)).withColumn("h", F.lit(0))
    got = {r["doc_id"] for r in stuffing.stuffed_documents(df).collect()}
    assert got == {i for i, _, bad in cases if bad}
    assert rows(stuffing.stuffed_documents(df.limit(0))) == []
