import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from maskwell.functions import births, digits, text
from maskwell.operators import detector, evaluation, forms, geometry, outputs, policy, replacement, spans, surrogates
from maskwell.plans import registry

UNIT = "document_id string, page int, field string, text_source_id string"
SPAN = f"{UNIT}, start_off int, end_off int, entity_type string, role string, action string"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"

PAGE = """Re: Marion Thistle
Date of Birth: 21/07/1968
Dear Mr Underhay,
I assessed Ms Thistle on 9 May 2023 at 7 Orchard Lane Millbrook VIC 3999.
Ms Thistle is a 54-year-old female, born in Italy, and an Australian citizen.
Her Medicare number is 2123 45670 1 and her TFN is 123 456 782.
Also 123 456 782 without a label. Call 0491 570 157 or 1300 975 707, m.thistle@example.org.
Accident on 02/02/2022. Policy number: PX998877. Marion rang Services Australia and Underhay Lawyers about ABN 51 824 753 556.
Kind regards,
Dr Edith Lowmoor"""


def test_detector_reads_a_letter(spark):
    rows = [(1, "m", PAGE), (2, "m", "Notes on Marion Thistle.pdf"), (3, "m", None), (4, None, "Dr Wren Cole rang"), (1, "m", PAGE)]
    got = detector.detected(spark.createDataFrame(rows, "u int, matter string, text string"), ["u"], "matter").collect()
    found = {(r["entity_type"], r["text"]) for r in got if r["u"] == 1}
    assert found == {
        ("PERSON", "Marion Thistle"), ("DATE_OF_BIRTH", "21/07/1968"), ("PERSON", "Underhay"), ("PERSON", "Thistle"), ("DATE", "9 May 2023"), ("ADDRESS", "7 Orchard Lane Millbrook VIC 3999"), ("AGE", "54-year-old"), ("GENDER", "female"),
        ("NATIONALITY", "Italy"), ("NATIONALITY", "Australian"), ("MEDICARE", "2123 45670 1"), ("TFN", "123 456 782"), ("PHONE", "0491 570 157"), ("PHONE", "1300 975 707"), ("EMAIL", "m.thistle@example.org"), ("DATE", "02/02/2022"),
        ("POLICY_NUMBER", "PX998877"), ("PERSON", "Marion"), ("ORGANIZATION", "Services Australia"), ("ORGANIZATION", "Underhay Lawyers"), ("ABN", "51 824 753 556"), ("PERSON", "Edith Lowmoor"),
    }
    assert sum(r["entity_type"] == "TFN" for r in got) == 1
    assert {r["text"] for r in got if r["u"] == 2} == {"Marion Thistle"} and all(r["text"] == PAGE[r["start_off"] : r["end_off"]] for r in got if r["u"] == 1)
    assert detector.date_role(PAGE, PAGE.index("02/02")) == "date_of_injury" and detector.date_role(PAGE, PAGE.index("9 May")) != "date_of_injury"


@pytest.mark.parametrize(
    "t, want",
    [
        ("31/02/2020 3/4/41 3.4.1940 2024-03-03 20240303 March 2024 3rd of March 2024 March 3rd, 2024", {"1941-04-03", "1940-04-03", "2024-03-03", "2024-03"}),
        ("", set()), ("12/13/2020", set()),
    ],
)
def test_only_real_dates(t, want):
    assert {c[6]["iso"] for c in detector.date_candidates(t)} == want


@pytest.mark.parametrize(
    "t, kind, value",
    [
        ("Policy number: PX998877", "POLICY_NUMBER", "PX998877"), ("CRN 123 456 789A", "CENTRELINK_CRN", "123 456 789A"), ("MRN: 0045123", "MEDICAL_RECORD_NUMBER", "0045123"), ("rego ABC12D", "VEHICLE_REGISTRATION", "ABC12D"),
        ("DVA file QX123456", "DVA_NUMBER", "QX123456"), ("BSB 064-000", "ACCOUNT_NUMBER", "064-000"), ("Account number\n1234 5678", "ACCOUNT_NUMBER", "1234 5678"), ("passport is PA1234567", "PASSPORT", "PA1234567"),
        ("claim no. from last year WC1234567", None, None),
    ],
)
def test_announced_values(t, kind, value):
    got = [(c[2], t[c[0] : c[1]]) for c in detector.announced_candidates(t)]
    assert got == ([(kind, value)] if kind else [])


def test_policy_takes_the_first_rule(spark):
    rows = [("ORGANIZATION", "court_tribunal", None), ("ORGANIZATION", "employer", None), ("ORGANIZATION", None, None), ("PHONE", None, {"number_class": "1300"}), ("PHONE", None, None), ("MEDICARE", None, None), ("PASSPORT", None, None), ("TFN", None, None), ("NEW", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, r string, a map<string,string>")
    got = [tuple(r) for r in df.select(policy.decided("t", "r", "a").alias("d")).select("d.action", "d.strategy", "d.rule").collect()]
    assert got == [
        ("KEEP", None, "rule[0]"), ("SYNTHETIC", "org_name", "rule[1]"), ("REVIEW", None, "default"), ("KEEP", None, "rule[5]"), ("SYNTHETIC", None, "default"), ("SYNTHETIC", "checksum_invalid", "identifier"),
        ("SYNTHETIC", "format_preserving", "identifier"), ("REDACT", None, "default"), ("REVIEW", None, "fallback"), ("REVIEW", None, "fallback"),
    ]


def test_detection_metrics_under_four_schemes(spark):
    unit = ("d", 1, None, "s")
    gold = [(*unit, 0, 8, "PERSON", "plaintiff", "SYNTHETIC", "g1"), (*unit, 20, 30, "DATE", None, "KEEP", "g2"), (*unit, 40, 50, "ORGANIZATION", None, "SYNTHETIC", "g3")]
    found = [(*unit, 0, 7, "PERSON", None, "SYNTHETIC", "p1"), (*unit, 20, 30, "PERSON", None, "SYNTHETIC", "p2"), (*unit, 2, 9, "PERSON", None, "SYNTHETIC", "p3")]
    g, p = spark.createDataFrame(gold, SPAN + ", mention_id string"), spark.createDataFrame(found, SPAN + ", edit_id string")
    got = {r["scheme"]: (r["tp"], r["fp"], r["fn"]) for r in evaluation.detection_metrics(evaluation.event_rows(g, p, "mention_id", "edit_id")).filter("level = 'micro'").collect()}
    assert got == {"strict": (0, 3, 3), "exact": (1, 2, 2), "overlap_typed": (1, 2, 2), "overlap_any": (2, 1, 1)}
    r = evaluation.protection(g, p, "pessimistic").first()
    assert (r["mentions"], r["protected"], r["keep_violations"], r["critical_missed"], r["chars"], r["covered_chars"]) == (2, 1, 1, 0, 18, 8)
    assert {x["mention_id"]: x["outcome"] for x in evaluation.attribution(g, p, p).collect()} == {"g1": "OK", "g3": "DETECTOR_MISS"}
    assert {x["state"] for x in evaluation.page_states(g, p).collect()} == {"BLOCKED"}
    empty = evaluation.protection(g.limit(0), p.limit(0), "pessimistic").first()
    assert empty["mentions"] == 0 and empty["mention_recall"] is None


def test_untouched_text_against_sets(spark):
    rng = random.Random(3)
    key = ("d", 1, None, "s")
    cut = lambda i: (*key, (a := rng.randrange(40)), a + rng.randrange(1, 10), "X", None, None, i)
    g, e = [cut(i) for i in range(6)], [cut(i) for i in range(6)]
    units = spark.createDataFrame([(*key, "x" * 60, 1)], f"{UNIT}, text string, u int")
    r = evaluation.untouched_text(units, spark.createDataFrame(g, SPAN + ", i int"), spark.createDataFrame(e, SPAN + ", i int"), "u").first()
    marked = lambda xs: {c for x in xs for c in range(x[4], x[5])}
    assert (r["chars"], r["touched"]) == (60 - len(marked(g)), len(marked(e) - marked(g)))


def test_text_metrics(spark):
    df = spark.createDataFrame([("a b c d", "a b x d"), ("Ａ  b", "a b"), ("", ""), ("", "x"), (None, None)], "r string, h string")
    got = [tuple(x["m"]) for x in df.select(evaluation.page_text_metrics("r", "h").alias("m")).collect()]
    assert got[0] == (0.1429, 0.1429, 0.25, 0.25, 0.75) and got[1][:4] == (0.3333, 0.0, 0.5, 0.0) and got[2] == (None,) * 5 and got[3][0] == 1.0
    r = spark.createDataFrame([("Brookdale", "Brookdale"), ("Brookdale", "Bro0kdale"), ("Brookdale", "xxookxxle"), ("Brookdale", " "), ("Brookdale", None)], "g string, x string")
    assert [x[0] for x in r.select(evaluation.recovery_class(F.col("g"), F.col("x"))).collect()] == ["exact", "near", "degraded", "missing", "missing"]


def test_boxes_of_spans_and_back(spark):
    words = [("d", 1, s, i, w, (50.0 + 40 * i, 80.0, 80.0 + 40 * i, 92.0), 0, 0, 6 * i, 6 * i + 5) for s in ("a", "b") for i, w in enumerate(["Marie", "Stone", "lives"])]
    w = spark.createDataFrame(words, f"document_id string, page int, text_source_id string, idx int, text string, bbox {BOX}, block int, line int, start_off int, end_off int")
    s = spark.createDataFrame([("m", "d", 1, "a", 3, 8), ("n", "d", 1, "a", 50, 55), ("o", "d", 1, "a", None, None)], "mention_id string, document_id string, page int, text_source_id string, start_off int, end_off int")
    whole = geometry.span_boxes(s, "mention_id", w)
    assert [tuple(r)[6:] for r in whole.collect()] == [(50.0, 80.0, 120.0, 92.0)]
    part = geometry.span_boxes(s, "mention_id", w, whole=False).first()
    assert (part["x0"], part["x1"]) == (68.0, 102.0)
    assert {(r["text_source_id"], r["start_off"], r["end_off"]) for r in geometry.projected(whole, "mention_id", w).collect()} == {("a", 0, 11), ("b", 0, 11)}
    assert [(r["mention_id"], r["x0"], r["x1"]) for r in geometry.nearest_line_boxes(s, "mention_id", w).collect()] == [("n", 50.0, 160.0)]
    slanted = w.filter("text_source_id = 'a'").withColumn("bbox", F.struct("bbox.x0", (F.col("bbox.y0") + F.col("idx") * 4).alias("y0"), "bbox.x1", (F.col("bbox.y1") + F.col("idx") * 4).alias("y1")))
    low = slanted.withColumn("idx", F.col("idx") + 3).withColumn("bbox", F.struct("bbox.x0", (F.col("bbox.y0") + 30).alias("y0"), "bbox.x1", (F.col("bbox.y1") + 30).alias("y1")))
    assert {r["idx"]: r["row"] for r in geometry.visual_lines(slanted.union(low), geometry.SOURCE).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_turned_boxes_come_back(spark):
    for turn in (0, 90, 180, 270):
        p = spark.range(1).select(geometry.corners_to_display(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(50.0), F.lit(turn), F.lit(100.0), F.lit(200.0)).alias("b"))
        from maskwell.functions.boxes import to_display

        d = p.select("b.*").first()
        assert d["x1"] > d["x0"] and d["y1"] > d["y0"]
        pt = to_display(F.lit(10.0), F.lit(20.0), F.lit(turn), F.lit(100.0), F.lit(200.0))
        back = spark.range(1).select(geometry.to_user(pt["x"], pt["y"], F.lit(turn), F.lit(100.0), F.lit(200.0)).alias("u")).select("u.*").first()
        assert tuple(back) == (10.0, 20.0)
    b = spark.range(1).select(geometry.pixel_box(F.struct(F.lit(10.2).alias("x0"), F.lit(0.0).alias("y0"), F.lit(20.1).alias("x1"), F.lit(9.9).alias("y1")), 144.0, F.lit(10.0), F.lit(0.0)).alias("b")).select("b.*").first()
    assert tuple(b) == (0, 0, 21, 20)


def test_log_proves_the_output(spark):
    units = spark.createDataFrame([("d", "Ann met Bob 𝄞 today."), ("e", "nothing")], "u string, text string")
    edits = spark.createDataFrame([("d", 0, 3, "[PERSON]"), ("d", 8, 11, "Al")], "u string, start_off int, end_off int, replacement string")
    out = spans.edited_texts(units, edits, ["u"])
    log = outputs.edit_log(units, edits, ["u"], b"k")
    placed = {(r["out_start"], r["out_end"]) for r in log.collect()}
    text_ = {r["u"]: r["output"] for r in out.collect()}["d"]
    assert {text_[a:b] for a, b in placed} == {"[PERSON]", "Al"}
    assert all(r["complete"] for r in outputs.log_complete(units, out, log, ["u"], b"k").collect())
    for wrong in (log.filter("start_off > 0"), outputs.edit_log(units, edits, ["u"], b"other")):
        assert {r["u"]: r["complete"] for r in outputs.log_complete(units, out, wrong, ["u"], b"k").collect()} == {"d": False, "e": True}


def test_free_text_is_restored(spark):
    vault = spark.createDataFrame([("m", "hollow", "Cole"), ("m", "ann hollow", "Bea Cole"), ("m", "grey", "Dunn"), ("m", "black", "Dunn"), ("n", "white", "Cole")], "matter_id string, value string, surrogate string")
    texts = [(1, "m", "Dr Cole called; COLE's file, cole."), (2, "m", "Bea Cole and Dunn [TFN]"), (3, "m", "Colesworth"), (4, "m", None), (5, "x", "Cole")]
    got = {r["i"]: tuple(r)[1:] for r in outputs.restored_texts(spark.createDataFrame(texts, "i int, matter_id string, text string"), vault, "i").collect()}
    assert got == {1: ("Dr hollow called; HOLLOW's file, hollow.", 3, 0), 2: ("ann hollow and Dunn [TFN]", 1, 1), 3: ("Colesworth", 0, 0), 4: (None, 0, 0), 5: ("Cole", 0, 0)}
    c = spark.createDataFrame([("a b", "x y", "x y"), ("a b", "x y", "x b"), ("a b", "x y", "a b"), ("a b", "x y", "q b")], "s string, e string, g string")
    assert [r[0] for r in c.select(outputs.restoration_class(F.col("s"), F.col("e"), F.col("g"))).collect()] == ["exact", "partial", "unchanged", "wrong"]


def test_names_are_replaced_part_by_part(spark):
    pool = spark.createDataFrame([("surname", s) for s in ("Ash", "Birch")] + [("given", g) for g in ("Una", "Vic")], "kind string, surrogate string")
    names = ["John Stone", "STONE, John", "Mr Stone", "J. Stone", "John", None, "42"]
    got = {r["text"]: r["surrogate"] for r in replacement.name_surrogates(spark.createDataFrame([("m", n) for n in names], "matter_id string, text string"), pool, b"k").collect()}
    first, last = got["John Stone"].split(" ")
    assert got["STONE, John"] == f"{last.upper()}, {first}" and got["Mr Stone"] == f"Mr {last}" and got["J. Stone"].endswith(f". {last}") and got["42"] == "42" and len(got) == 6
    assert replacement.name_parts("John", given=frozenset({"john"})) == [(0, 4, "given")] and replacement.name_parts("SMYTH John")[0][2] == "surname"
    orgs = spark.createDataFrame([("m", "Stone Lawyers"), ("m", "stone  Lawyers"), ("m", "Hill Clinic")], "matter_id string, text string")
    o = {r["text"]: r["surrogate"] for r in replacement.organisation_surrogates(orgs, spark.createDataFrame([("organisation", "Gate"), ("organisation", "Mark")], "kind string, surrogate string"), b"k").collect()}
    assert o["Stone Lawyers"] == o["stone  Lawyers"] and o["Stone Lawyers"].endswith(" Lawyers") and o["Hill Clinic"].endswith(" Clinic") and len(set(o.values())) == 2


def test_addresses_keep_kind_state_and_layout(spark):
    pool = spark.createDataFrame([(k, k.title() + x) for k in ("street", "suburb") for x in ("one", "two", "three")], "kind string, surrogate string")
    rows = [("m", "12 Long Street Milton QLD 4064"), ("m", "14 Long Street Milton QLD 4064"), ("m", "PO Box 30 Milton VIC 3064"), ("m", "nowhere"), ("m", None)]
    got = {r["text"]: r["surrogate"] for r in replacement.address_surrogates(spark.createDataFrame(rows, "matter_id string, text string"), pool, b"k").collect()}
    a, b, c = (got[rows[i][1]] for i in range(3))
    assert a.split(" ")[1:4] == b.split(" ")[1:4] and " Street " in a and " QLD 4" in a and "Long" not in a and "Milton" not in a
    assert c.startswith("PO Box ") and " VIC 3" in c and c.split(" ")[3] != a.split(" ")[3] and got["nowhere"] == "nowhere"


def test_days_of_birth_keep_their_form():
    for t in ("8/12/1968", "08/12/1968", "8-12-68", "1968-12-08", "8th of December 1968", "8 DEC 1968", "December 8th, 1968", "december 8, 1968"):
        w = births.parsed(t)
        assert w.day == dt.date(1968, 12, 8) and births.rendered(w.pattern, w.day) == t
    assert births.rendered(births.parsed("8th December 1968").pattern, dt.date(1968, 11, 3)) == "3rd November 1968" and births.parsed("31/02/1970") is None and births.parsed(None) is None
    assert births.parsed("1/1/31").day.year == 1931 and births.parsed("1/1/30").day.year == 2030
    assert ("03/11/1968", "08/12/1968") in births.form_pairs(dt.date(1968, 12, 8), dt.date(1968, 11, 3))


def test_birth_days_conflicts_and_permutation(spark):
    df = spark.createDataFrame([(dt.date(1980, 6, 15), [dt.date(2020, 6, 14), dt.date(2021, 6, 16)]), (dt.date(1980, 6, 15), [dt.date(2020, 1, 1)])], "b date, r array<date>")
    got = df.select(surrogates.issued_birth_day(F.col("b"), F.col("r"), b"k").alias("d"), "b", "r").withColumn("c", surrogates.birth_day_conflicts(F.col("b"), F.col("d"), F.col("r"))).collect()
    assert got[0]["d"] is None and got[1]["d"].year == 1980 and not got[1]["c"]
    p = surrogates.letter_permutation(spark.createDataFrame([("m",), ("n",)], "m string"), "m", b"k").collect()
    assert all(sorted(r["turned"] for r in p if r["m"] == x) == [chr(65 + i) for i in range(26)] for x in "mn")
    old = spark.createDataFrame([("m", "a", "x")], "m string, value string, surrogate string")
    new, bad = surrogates.vault_put(old, spark.createDataFrame([("m", "a", "y"), ("m", "b", "z"), ("m", "a", "x")], old.schema), ["m", "value"])
    assert [tuple(r) for r in new.collect()] == [("m", "b", "z")] and [r["issued"] for r in bad.collect()] == ["x"]


def test_forms_are_read_by_place(spark):
    rows = [("Surname:", "THORNE"), ("Given names:", "Edith May"), ("Date 0f birth:", "07/11/1985"), ("Telephone:", "0491 570 158"), ("Email:", "none"), ("Occupation:", "baker")]
    words, off, idx = [], 0, 0
    for i, (label, value) in enumerate(rows):
        for part, x in ((label, 50.0), (value, 260.0)):
            for w in part.split(" "):
                words.append((idx, w, (x, 100.0 + 30 * i, x + 7 * len(w), 112.0 + 30 * i), 0, i, off, off + len(w)))
                x, off, idx = x + 7 * len(w) + 6, off + len(w) + 1, idx + 1
    schema = f"page_id int, words array<struct<idx:int,text:string,bbox:{BOX},block:int,line:int,start_off:int,end_off:int>>"
    got = forms.form_values(spark.createDataFrame([(1, words), (2, None), (3, [])], schema), "page_id").collect()
    whole = " ".join(w[1] for w in words)
    assert {(r["entity_type"], whole[r["start_off"] : r["end_off"]]) for r in got} == {("PERSON", "THORNE"), ("PERSON", "Edith May"), ("DATE_OF_BIRTH", "07/11/1985"), ("PHONE", "0491 570 158")}


def test_form_words_are_not_shuffled_and_the_last_delivery_counts(spark, tmp_path):
    rng = random.Random(4)

    def page(surname: str, at: str | None) -> tuple:
        parts = [("Surname:", 50.0, 0), (surname, 260.0, 0)] + [("".join(rng.choice("abcdefgh") for _ in range(7)), 50.0 + 60 * (i % 6), 1 + i // 6) for i in range(120)]
        words, off = [], 0
        for i, (w, x, line) in enumerate(parts):
            words.append((i, w, (x, 100.0 + 30 * line, x + 7 * len(w), 112.0 + 30 * line), 0, line, off, off + len(w)))
            off += len(w) + 1
        return words, at

    days = [None, "2020-01-01 00:00:00", "2020-01-02 00:00:00"]
    rows = [(1, *page("THORNE", days[1])), (1, *page("9", days[2])), (2, *page("WREN", None)), (2, *page("ASHDALE", days[1])), (3, None, days[2]), (3, *page("PELORME", days[1])), (4, [], None), (None, *page("NOONE", None))]
    rows += [(i, *page(f"N{'abcdefghij'[i % 10] * 3}", days[i % 3])) for i in range(5, 205)]
    schema = f"page_id long, words array<struct<idx:int,text:string,bbox:{BOX},block:int,line:int,start_off:int,end_off:int>>, delivered_at string"
    spark.createDataFrame(rows, schema).withColumn("delivered_at", F.col("delivered_at").cast("timestamp")).write.parquet(f"{tmp_path}/page_extraction.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, quantiles, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    got = sorted((r["page_id"] or 0, r["start_off"], r["end_off"], r["label"]) for r in registry.QUERIES["form_values"](spark, str(tmp_path)).collect())
    assert got == [(0, 9, 14, "surname"), (2, 9, 16, "surname"), (3, 9, 16, "surname")] + [(i, 9, 13, "surname") for i in range(5, 205)]
    assert shuffled() - before < 100_000  # the words take some 500,000


def test_labels_are_matched_as_by_comparing_with_every_label():
    rng = random.Random(6)
    known = [*forms.LABELS]

    def plain(words: list[str]) -> tuple[int, str] | None:
        for k in range(min(5, len(words)), 0, -1):
            text = forms.label_text(" ".join(words[:k]))
            if text in known:
                return k, text
            if len(text) >= 6:
                ratio, best = max((SequenceMatcher(None, text, x).ratio(), x) for x in known)
                if len(best) >= 6 and ratio >= forms.LIKE:
                    return k, best
        return None

    cells = [["Date", "0f", "birth:"], ["---", "Surname", "|"], ["Emails"], ["Telefone", "no"], [], ["x" * 400]]
    for _ in range(1500):
        text = list(" ".join(rng.sample(known, rng.choice([1, 1, 2]))))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(["", "a", "1", " ", "é", "5", ":"])
        cells.append("".join(text).title().split(" "))
    assert [forms.matched_label(c) for c in cells] == [plain(c) for c in cells]


def test_plain_text_functions(spark):
    assert text.folded("Ａ  ﬁ\nB") == "a fi b" and text.folded(None) is None
    t = "a𝄞b"
    assert [text.code_point_offset(t, i) for i in range(5)] == [0, 1, 1, 2, 3]
    assert text.located("Ann Anna Ann\nAnn", "Ann", every=True) == [(0, 3), (9, 12), (13, 16)] and text.located("Ann\nAnn", "Ann", line=1) == [(4, 7)] and text.located("x", "") == []
    assert text.canonical_json({"b": -0.00001, "a": {2, 1}}) == '{"a":[1,2],"b":0.0}'
    with pytest.raises(ValueError):
        text.canonical_json([float("nan")])
    df = spark.createDataFrame([("One. Two words! Three", 8), (None, 1), ("x", 0)], "t string, p int")
    assert [tuple(r[0]) for r in df.select(text.sentence_bounds("t", "p").alias("b")).collect()] == [(4, 15), (None, None), (0, 1)]
    assert df.limit(1).select(text.json_strings(F.lit('{"a": "x", "b": ["' + "0" * 40 + '", "y"]}'))).first()[0] == "x\ny"


def test_check_digits_of_values_agree_with_columns(spark):
    from maskwell.functions import checks

    rng = random.Random(5)
    vals = ["".join(rng.choice("0123456789") for _ in range(rng.choice([8, 9, 10, 11, 16]))) for _ in range(400)] + ["2429581T", "123 456 782", "51 824 753 556", "", "8003601234567890"]
    df = spark.createDataFrame([(v,) for v in vals], "v string").coalesce(1)
    for name, f in checks.VALIDATORS.items():
        assert [bool(r[0]) for r in df.select(f("v")).collect()] == [digits.VALID[name](v) for v in vals], name


def test_hit_islands_and_divergences(spark):
    u = ("d", 1, None, "s")
    h = spark.createDataFrame([(*u, 0, 5, "b"), (*u, 3, 8, "a"), (*u, 8, 9, "b")], f"{UNIT}, start_off int, end_off int, method string")
    assert sorted((r["start_off"], r["end_off"], r["method"]) for r in evaluation.hit_islands(h, {"a": 0, "b": 1}).collect()) == [(0, 8, "a"), (8, 9, "b")]
    a, b = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], "d string, s int, t string"), spark.createDataFrame([("d", 1, "x"), ("d", 2, "z"), ("d", 3, "w")], "d string, s int, t string")
    assert [(r["position"], r["change"]) for r in evaluation.first_divergences(a, b, ["d"], ["s"]).collect()] == [(2, "changed"), (3, "added")]
