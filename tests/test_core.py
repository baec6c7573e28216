import datetime as dt
import hashlib
import hmac
import random
import re
import unicodedata

from pyspark.sql import functions as F

from maskwell.functions import boxes, checks, keyed, strings
from maskwell.operators import curation, layout, metrics, needles, rules, spans, surrogates
from maskwell.plans import registry

UNIT = "document_id string, page int, field string, text_source_id string"


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).first()


def test_check_digits(spark):
    rows = [("123 456 782",), ("123 456 789",), ("51 824 753 556",), ("01 824 753 556",), ("004 085 616",), ("2123 45670 1",), ("7123 45670 1",), ("2429581T",), ("2429581X",), ("",), (None,)]
    df = spark.createDataFrame(rows, "x string")
    got = df.select(checks.tfn_valid("x"), checks.abn_valid("x"), checks.acn_valid("x"), checks.medicare_valid("x"), checks.provider_valid("x")).collect()
    assert [r[0] for r in got][:2] == [True, False]
    assert [r[1] for r in got][2:4] == [True, False]
    assert got[4][2] and got[5][3] and not got[6][3] and got[7][4] and not got[8][4]
    assert not any(got[9]) and not any(got[10])


def test_hmac_matches_the_standard_library(spark):
    want = hmac.new(b"k", "a\x1fb é".encode(), hashlib.sha256).hexdigest()
    assert one(spark, "a string, b string", ("a", "b é"), keyed.hmac_hex(b"k", "a", "b"))[0] == want


def test_regex_spans_have_the_offsets_of_finditer(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1 é𝄞2") for _ in range(rng.randrange(60))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r["i"], r["start_off"], r["end_off"], r["text"]) for r in spans.regex_spans(df, "t", "[12]+a?", "i").collect()}
    want = {(i, m.start(), m.end(), m.group()) for i, t in enumerate(texts) if t for m in re.finditer("[12]+a?", t)}
    assert got == want


def _random_spans(rng, n):
    return [(i, rng.choice("ab"), rng.choice([1, None]), None, "s", (a := rng.randrange(40)), a + rng.randrange(1, 9), rng.choice("XY")) for i in range(n)]


SPAN = f"id int, {UNIT}, start_off int, end_off int, entity_type string"


def test_coverage_merge_and_semijoins_against_sets(spark):
    rng = random.Random(5)
    a, b = _random_spans(rng, 40), _random_spans(rng, 30)
    da, db = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN)
    cover = {r["id"]: r["covered"] for r in spans.covered_length(da, "id", db).collect()}
    for r in a:
        chars = {x for s in b if s[1:5] == r[1:5] for x in range(s[5], s[6])}
        assert cover[r[0]] == len(chars & set(range(r[5], r[6])))
    hit = {r["id"] for r in spans.touching(da, db).collect()}
    miss = {r["id"] for r in spans.without_overlap(da, db).collect()}
    assert hit | miss == {r[0] for r in a} and not hit & miss
    for r in spans.merged(da).collect():
        assert r["start_off"] < r["end_off"]


def test_greedy_choice_and_matching_against_plain_loops(spark):
    rng = random.Random(7)
    a, b = _random_spans(rng, 40), _random_spans(rng, 40)
    got = {r["id"] for r in spans.keep_best(spark.createDataFrame(a, SPAN), [-(F.col("end_off") - F.col("start_off")), F.col("id")]).collect()}
    want = set()
    for r in sorted(a, key=lambda r: (-(r[6] - r[5]), r[0])):
        if not any(w[1:5] == r[1:5] and w[5] < r[6] and r[5] < w[6] for w in a if w[0] in want):
            want.add(r[0])
    assert got == want
    db = spark.createDataFrame(b, SPAN).withColumnRenamed("id", "other")
    pairs = [(r["id"], r["other"]) for r in spans.match_one_to_one(spark.createDataFrame(a, SPAN), db, "id", "other").select(F.col("id").cast("int"), F.col("other").cast("int")).collect()]
    cand = []
    for x in a:
        for y in b:
            if x[1:5] == y[1:5] and (o := min(x[6], y[6]) - max(x[5], y[5])) > 0:
                cand.append((-o, -round(o / (max(x[6], y[6]) - min(x[5], y[5])), 6), x[5], y[5], str(x[0]), str(y[0])))
    used_a, used_b, want = set(), set(), []
    for c in sorted(cand):
        if c[4] not in used_a and c[5] not in used_b:
            used_a.add(c[4])
            used_b.add(c[5])
            want.append((int(c[4]), int(c[5])))
    assert sorted(pairs) == sorted(want)


def test_edits_give_the_text_of_right_to_left_replacement(spark):
    units = spark.createDataFrame([("d", "Ann met Bob."), ("e", "nothing"), ("f", "")], "document_id string, text string")
    edits = spark.createDataFrame([("d", 0, 3, "[P]"), ("d", 8, 11, "[P]")], "document_id string, start_off int, end_off int, replacement string")
    assert {r[0]: r[1] for r in spans.edited_texts(units, edits, ["document_id"]).collect()} == {"d": "[P] met [P].", "e": "nothing", "f": ""}


def test_metrics_on_known_values(spark):
    df = spark.createDataFrame([("x", "u"), ("x", "u"), ("x", "v")], "t string, f string")
    r = metrics.b_cubed(df, "t", "f").first()
    assert r["precision"] == 1.0 and abs(r["recall"] - 5 / 9) < 1e-6
    assert metrics.pairwise(df, "t", "f").first()["tp"] == 1.0
    p = metrics.prf(spark.createDataFrame([(3, 1, 2), (0, 0, 4)], "tp int, fp int, fn int")).collect()
    assert (p[0]["precision"], p[0]["recall"], p[0]["f1"]) == (0.75, 0.6, 0.6667) and p[1]["precision"] is None
    k = spark.createDataFrame([("a", "a")] * 4 + [("b", "b")] * 4 + [("a", "b"), ("b", "a")], "x string, y string")
    assert metrics.kappa(k, "x", "y").first()["kappa"] == 0.6
    b = metrics.bootstrap_interval(spark.createDataFrame([(1, 2), (2, 2)], "n int, d int"), "n", "d", 50).first()
    assert b["low"] <= b["estimate"] <= b["high"]


def test_boxes_and_strings(spark):
    row = one(
        spark, "a int", (1,),
        boxes.overlap_fraction(boxes.make(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)), boxes.make(F.lit(1.0), F.lit(1.0), F.lit(3.0), F.lit(3.0))),
        strings.like_case(F.lit("Jones"), F.lit("SMITH")),
        strings.into_layout(F.lit("(04) 1-2"), F.lit("9876")),
        strings.phone_class(F.lit("+61 491 570 156")),
        strings.completed_years(F.lit(dt.date(1972, 2, 29)), F.lit(dt.date(2023, 2, 28))),
        strings.completed_years(F.lit(dt.date(1972, 2, 29)), F.lit(dt.date(2023, 3, 1))),
    )
    assert tuple(row) == (0.25, "JONES", "(98) 7-6", "mobile", 50, 51)


def test_surrogates_are_injective_and_reserved(spark):
    vals = spark.createDataFrame([("m", "surname", f"n{i}") for i in range(30)], "matter_id string, kind string, value string")
    pool = spark.createDataFrame([("surname", s) for s in ("Ash", "Birch", "Cole", "Dunn")], "kind string, surrogate string")
    got = surrogates.issue(vals, pool, b"k").collect()
    assert len(got) == 30 and len({r["surrogate"] for r in got}) >= 20
    nums = ["0491 999 123", "+61 491 999 124", "(02) 9555 1234", "(07) 9555 1234", "1300 111 222", "13 12 34", "no number", None] + [f"0400 000 {i:03d}" for i in range(60)]
    got = {r["p"]: r for r in surrogates.issued_phones(spark.createDataFrame([("m", n) for n in nums], "m string, p string"), b"k", "m", "p").withColumn("ok", surrogates.is_reserved_phone("surrogate")).collect()}
    real = [r for p, r in got.items() if p not in ("13 12 34", "no number")]
    assert all(r["ok"] for r in real) and len({re.sub(r"\D", "", r["surrogate"]).replace("61491", "0491") for r in real}) == len(real)
    assert got["(07) 9555 1234"]["surrogate"].startswith("(07) ") and got["1300 111 222"]["surrogate"].startswith("1300 975 7") and got["13 12 34"]["surrogate"] == "[PHONE]"
    plate = one(spark, "p string", ("AB-12 cd",), surrogates.format_preserving("p", b"k"))[0]
    assert re.fullmatch(r"[A-Z]{2}-\d\d [a-z]{2}", plate) and plate != "AB-12 cd"
    days = one(spark, "b date", (dt.date(1980, 6, 15),), surrogates.born_same_year(F.col("b"), F.array(F.lit(dt.date(2020, 6, 14)), F.lit(dt.date(2021, 6, 16)))))[0]
    assert days and all(d.year == 1980 and d.month == 6 for d in days)


def test_needles(spark):
    texts = spark.createDataFrame([(1, "Seen by WREN  Ashdale, wren ashdale; id 2123-45670-1."), (2, "F1 0.4213"), (3, None)], "i int, t string")
    n = spark.createDataFrame([("wren ashdale",), ("2123 45670 1",), ("Ashdalo",)], "n string")
    assert {(r[0], r[1], r[2]) for r in needles.scan_exact(texts, "i", "t", n, "n").collect() if r[1] == "wren ashdale"} == {(1, "wren ashdale", 2)}
    assert [(r[0], r[1]) for r in needles.scan_digits(texts, "i", "t", n, "n").collect()] == [(1, "2123456701")]
    assert {r["word"] for r in needles.scan_fuzzy(texts, "i", "t", n, "n").collect()} == {"ashdale"}


def test_curation(spark):
    m = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "i string, at int, v string")
    assert {r["i"]: r["v"] for r in curation.latest(m, ["i"], [F.col("at")]).collect()} == {"a": "y", "b": "z"}
    c = spark.createDataFrame([("s", 20), ("b", 10)], "k string, n int")
    assert {r[0]: r[1] for r in curation.largest_remainder(c, "k", "n", 6).collect()} == {"s": 4, "b": 2}
    d = curation.hash_changes(spark.createDataFrame([("a", "1"), ("b", "2")], "i string, h string"), spark.createDataFrame([("b", "3"), ("c", "4")], "i string, h string"), "i", "h")
    assert {(r[0], r[1]) for r in d.collect()} == {("a", "missing"), ("b", "changed"), ("c", "added")}
    people = [("m", "PERSON", "1", "Ann Lee"), ("m", "PERSON", "2", "A Lee"), ("m", "PERSON", "3", "Lee"), ("m", "PERSON", "4", None)]
    g = curation.linked_groups(spark.createDataFrame(people, "matter_id string, entity_type string, entity_id string, text string")).collect()
    assert {r["link_key"] for r in g} == {"lee|a"} and len(g) == 3


def test_layout_rebuilds_the_page(spark):
    w = [(0, "Ann", 0, 0), (1, " ", 0, 0), (2, "Lee", 0, 0), (3, "again", 0, 1)]
    df = spark.createDataFrame([(1, *x) for x in w], "p int, idx int, text string, block int, line int")
    assert layout.assembled(df, ["p"]).first()["text"] == "Ann Lee\nagain"


def test_rules_on_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "mail a.b@x.example.com on 03/04/2020")], "i int, t string")
    assert {(r["rule"], r["text"]) for r in rules.rule_spans(df, "i", "t").collect()} == {("email", "a.b@x.example.com"), ("date.dmy", "03/04/2020")}


def test_context_values_and_roles(spark):
    from maskwell.operators import detection

    df = spark.createDataFrame([(1, "Passport no. PA1234567 was shown. Paid on 03/04/2020. Examined 05/04/2020."), (2, None), (3, "")], "page_id int, text string")
    got = detection.context_spans(df, "page_id", "text").collect()
    assert [(r["rule"], r["text"], r["start_off"]) for r in got] == [("ctx.passport", "PA1234567", 13)]
    dates = rules.rule_spans(df, "page_id", "text", "date.dmy")
    roles = detection.nearest_before(df, dates, "page_id", "text", {"examination": ["examined"], "payment": ["paid on"]})
    assert {r["text"]: r["role"] for r in roles.collect()} == {"03/04/2020": "payment", "05/04/2020": "examination"}


def test_votes_disagreements_and_ladder(spark):
    from maskwell.operators import detection

    rows = [("d", 1, None, "s", 0, 5, "X", "a"), ("d", 1, None, "s", 3, 6, "X", "b"), ("d", 1, None, "s", 9, 12, "Y", "a")]
    df = spark.createDataFrame(rows, f"{UNIT}, start_off int, end_off int, entity_type string, detector string")
    assert {r["start_off"] for r in detection.combined(df, "detector", 2).collect()} == {0, 3}
    d = detection.disagreements(df.filter("detector = 'a'"), df.filter("detector = 'b'")).collect()
    assert {(r["start_off"], r["kind"]) for r in d} == {(0, "boundary"), (9, "missed")}
    tries = spark.createDataFrame([("p", 0, 40.0), ("p", 1, 95.0), ("p", 2, 99.0), ("q", 0, 30.0), ("q", 1, 50.0)], "page string, rung int, mean_conf double")
    assert {(r["page"], r["rung"], r["rescued"]) for r in detection.ladder(tries, ["page"], 90.0).collect()} == {("p", 1, True), ("q", 1, False)}


def test_two_word_sources_are_joined(spark):
    from maskwell.operators import detection

    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    a = spark.createDataFrame([(1, "Ann", (0.0, 0.0, 10.0, 10.0))], f"page int, text string, bbox {box}")
    b = spark.createDataFrame([(1, "Ann", (0.0, 1.0, 10.0, 9.0)), (1, "Lee", (20.0, 0.0, 30.0, 10.0)), (2, "Far", (0.0, 0.0, 1.0, 1.0))], f"page int, text string, bbox {box}")
    assert sorted(r["text"] for r in detection.joined_sources(a, b, ["page"]).collect()) == ["Ann", "Far", "Lee"]


def test_files(spark, tmp_path):
    from maskwell.sources import files

    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "a.tsv").write_text(head + '5\t1\t2\t3\t4\t1\t300\t0\t300\t30\t-1\t"Ann\n4\t1\t2\t3\t4\t0\t0\t0\t0\t0\t-1\t\n')
    r = files.recognised_words(spark, str(tmp_path / "a.tsv"), 300).collect()
    assert len(r) == 1 and r[0]["text"] == '"Ann' and r[0]["conf"] is None and r[0]["bbox"]["x0"] == 72.0 and r[0]["block"] == 203
    (tmp_path / "d.jsonl").write_text('{"item_id": "1", "decision": "not_pii"}\n')
    assert files.decisions(spark, str(tmp_path / "d.jsonl")).first()["decision"] == "not_pii"
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "y.pdf").write_bytes(b"no")
    assert files.registered_files(spark, str(tmp_path / "*.pdf")).count() == 1


def test_streaming_scan_equals_batch(spark, tmp_path):
    from maskwell.streaming import intake

    data = [(i, "d", f"mail u{i}@x.example.com", dt.datetime(2024, 1, 1)) for i in range(20)]
    df = spark.createDataFrame(data, "page_id long, document_id string, text string, delivered_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = intake.span_stream(intake.text_stream(spark, str(tmp_path / "in")), rules.RULES["email"][2], "page_id")
    q = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in spans.regex_spans(df, "text", rules.RULES["email"][2], "page_id").collect()}
    assert {tuple(r) for r in spark.sql("select * from found").collect()} == want and len(want) == 20


def test_registry_names_and_flagship(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
    assert entry.entry(spark).count() > 0


def test_written_dates(spark):
    from maskwell.functions import dates

    want = {
        "03/04/2020": dt.date(2020, 4, 3), "3.4.41": dt.date(1941, 4, 3), "3-4-40": dt.date(2040, 4, 3), "2024-03-03": dt.date(2024, 3, 3), "20240303": dt.date(2024, 3, 3),
        "3rd of March 2024": dt.date(2024, 3, 3), "March 3rd, 2024": dt.date(2024, 3, 3), "12 AUG 2021": dt.date(2021, 8, 12), "31/02/2020": None, "": None, "soon": None,
    }
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", dates.parsed("t").alias("d")).collect()}
    assert got == {**want, None: None}
    assert "3 March 2024" in df.limit(1).select(dates.forms(F.lit(dt.date(2024, 3, 3))).alias("f")).first()["f"]


def test_surrogate_numbers_never_pass_their_check(spark):
    df = spark.createDataFrame([("123 456 782",), ("459-599-230",), ("",), (None,)], "x string").coalesce(1)
    rows = surrogates.with_unusable(df, "x", "tfn", b"k", out="s").withColumn("ok", checks.tfn_valid("s")).collect()
    many = spark.range(3000).select(F.concat(F.lit("2"), F.lpad((F.col("id") * 7919 % 1000000).cast("string"), 7, "0"), F.lpad(F.col("id").cast("string"), 2, "1")).alias("x"))
    assert surrogates.with_unusable(many, "x", "medicare", b"k", out="s").filter(checks.medicare_valid("s")).count() == 0
    assert not any(r["ok"] for r in rows) and re.fullmatch(r"\d{3} \d{3} \d{3}", rows[0]["s"]) and re.fullmatch(r"\d{3}-\d{3}-\d{3}", rows[1]["s"])


def test_error_rate_of_whole_texts_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("ab é\nﬁ𝄞") for _ in range(rng.randrange(40)))
    pages = [(2 * d + s, d, 1, text()) for d in range(40) for s in (0, 1)]
    pages += [(100, 50, 1, "same\nline two é"), (101, 50, 1, "same\nline tw0 e"), (102, 51, 1, None), (103, 51, 1, "x"), (104, 52, 1, " \n"), (105, 52, 1, None), pages[0]]
    spark.createDataFrame(pages, "page_id long, document_id long, page int, text string").write.parquet(f"{tmp_path}/page_extraction.parquet")

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    by = {}
    for p in set(pages):
        by.setdefault(p[1], []).append((p[0], " ".join(unicodedata.normalize("NFKC", p[3] or "").split())))
    want = {(r[0], h[0], round(brute(r[1], h[1]) / len(r[1]), 4) if r[1] else 1.0 if h[1] else None) for r, h in map(sorted, by.values())}
    got = registry.QUERIES["text_error_rate"](spark, str(tmp_path)).collect()
    assert len(got) == 43 and {tuple(r) for r in got} == want


def test_short_and_several_word_names_are_searched(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([("PERSON", "Ashdale"), ("PERSON", "Wren\nAshdale"), ("DATE", "May")], "entity_type string, text string").write.parquet(f"{base}/gold_mention.parquet")
    spark.createDataFrame([(1, "Ms Ashdale met Wren Ashdale in May."), (2, None)], "doc_id long, text string").write.parquet(f"{base}/documents.parquet")
    got = {tuple(r) for r in registry.QUERIES["leaked_names"](spark, base).collect()}
    assert got == {(1, "Ashdale", 2), (1, "Wren\nAshdale", 1)}
    spark.createDataFrame([(["Wilson", "van  Dijken", "O'Brien", "Li"],)], "surnames array<string>").write.parquet(f"{base}/link_group.parquet")
    pages = [(1, "Mr Wilsen, (W1LSON) and Wilson."), (2, "van Dijkem; von Dijken; van dijken; van den Dijken"), (3, "OBrien, O'Brian, O'Brien"), (4, None), (5, "Wi|son/Wilton's")]
    spark.createDataFrame(pages, "page_id long, text string").write.parquet(f"{base}/page_extraction.parquet")
    got = {tuple(r) for r in registry.QUERIES["near_names"](spark, base).collect()}
    assert got == {
        (1, "wilson", "wilsen"), (1, "wilson", "w1lson"), (2, "van dijken", "van dijkem"), (2, "van dijken", "von dijken"),
        (3, "o'brien", "obrien"), (3, "o'brien", "o'brian"), (3, "o'brien", "o brian"), (5, "wilson", "wilton"),
    }


def test_near_names_shuffle_only_runs_near_a_needle(spark, tmp_path):
    base = str(tmp_path)
    rng = random.Random(9)
    letters = "abeilnorstvw015|é"
    made = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(4, 8)))
    names = ["van Dijken", "van der Bergen", "O'Brien", "St. John-Ward", "Wilson", "Li", *(made() for _ in range(30))]

    def misread() -> str:
        x, k = rng.choice(names), rng.random()
        i = rng.randrange(len(x))
        return x if k < 0.2 else x[:i] + (rng.choice(letters) if k < 0.6 else "") + x[i + (k < 0.8) :]

    said = [misread() for _ in range(300)]
    pages = [(i, " ".join(rng.choice(["({}),", "{}\n", "{}."]).format(said.pop() if said and rng.random() < 0.1 else made()) for _ in range(60))) for i in range(400)] + [(None, "Wi1son"), (400, None), (1, "")]
    spark.createDataFrame([(names,), (names,), (None,), ([None, ""],)], "surnames array<string>").write.parquet(f"{base}/link_group.parquet")
    spark.createDataFrame(pages, "page_id long, text string").write.parquet(f"{base}/page_extraction.parquet")
    fold = str.maketrans(*needles.CONFUSED)

    def close(a: str, b: str) -> bool:
        a, b = sorted((a.translate(fold), b.translate(fold)), key=len)
        if len(b) - len(a) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :] or a == b

    def readings(x: str) -> list[list[str]]:
        return [[z for y in x.lower().split() if (z := y.strip(".,;:()\"'"))], re.findall(r"[^\W_]+", x.lower())]

    forms = {(" ".join(x.lower().split()), " ".join(w), len(w)) for x in names for w in [x.lower().split(), *readings(x)]}
    forms = {f for f in forms if len(f[0]) >= 6 and len(f[1]) >= 6}
    want = set()
    for page, text in pages:
        runs = {(" ".join(w[i : i + k]), k) for w in readings(text or "") for k in {f[2] for f in forms} for i in range(len(w) - k + 1)}
        want |= {(page, n, r) for r, k in runs if len(r) >= 5 for n, f, fk in forms if fk == k and close(f, r) and (n, r) not in {x[:2] for x in forms}}
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, quantiles, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = [tuple(r) for r in registry.QUERIES["near_names"](spark, base).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {"van dijken", "van der bergen", "o'brien"} <= {n for _, n, _ in want} and (None, "wilson", "wi1son") in want
    assert shuffled() - before < 12_000  # there are some 24,000 words


def test_digits_inside_longer_runs_are_found(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([("PHONE", "0412 345 678"), ("PHONE", "13 12 34"), ("TFN", "123 456 782"), ("PHONE", "12345"), ("DATE", "2020")], "entity_type string, text string").write.parquet(f"{base}/gold_mention.parquet")
    docs = [(1, "call 0412.345.678 now"), (2, "no. 7 0412 345 678 12"), (3, "13/12/34"), (4, "ref 99123456782"), (5, "0412 345 67"), (6, None), (7, "12345 0412a345678")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{base}/documents.parquet")
    got = {tuple(r) for r in registry.QUERIES["leaked_digits"](spark, base).collect()}
    assert got == {(1, "0412345678"), (2, "0412345678"), (3, "131234"), (4, "123456782")}
    n = spark.createDataFrame([(None,)], "n string")
    assert needles.scan_digits(spark.createDataFrame(docs, "i long, t string"), "i", "t", n, "n").count() == 0


def test_recall_and_audit_pool_run_every_rule(spark, tmp_path):
    base = str(tmp_path)
    lines = ["3 May 2020", "2020-05-03", "(02) 9999 1234", "1300 123 456", "1800 123 456", "PO Box 12", "12 Long Street", "N1234567", "www.a.com/b", "a@b.com", "3/5/2020", "0412 345 678", "WC1234567", "ABN 51 824 753 556", "Dr Wren"]
    unit = "document_id string, page int, field string, text_source_id string"
    text = "\n".join(lines)
    spark.createDataFrame([(1, "d", 1, "s", text), (2, "e", 1, "s", text)], "page_id long, document_id string, page int, text_source_id string, text string").write.parquet(f"{base}/page_extraction.parquet")
    kinds = {r: k for r, (k, _, _) in rules.RULES.items()}
    found = {(p, r["rule"]): (r["start_off"], r["end_off"]) for r in rules.rule_spans(spark.createDataFrame([(1, text)], "p long, t string"), "p", "t").collect() for p in (1, 2)}
    assert {r for _, r in found} == set(rules.RULES)
    gold = [(f"m{i}", "d", 1, None, "s", *found[1, r], k) for i, (r, k) in enumerate(sorted(kinds.items()))]
    spark.createDataFrame(gold, f"mention_id string, {unit}, start_off int, end_off int, entity_type string").write.parquet(f"{base}/gold_mention.parquet")
    got = {r["entity_type"]: (r["n"], r["found"]) for r in registry.QUERIES["rule_recall"](spark, base).collect()}
    want = {k: list(kinds.values()).count(k) for k in kinds.values()}
    assert got == {k: (n, n) for k, n in want.items()}
    pool = {(r["page_id"], r["rule"], r["start_off"]) for r in registry.QUERIES["audit_pool_anti"](spark, base).collect()}
    assert pool == {(2, r, found[2, r][0]) for r in kinds}


def test_opaque_ids_stay_apart_beyond_a_thousand(spark):
    g = spark.createDataFrame([("m", "PERSON", i) for i in range(1, 1102)], "s string, k string, g long")
    got = {r["g"]: r["opaque_id"] for r in curation.opaque_ids(g, "s", "k", "g").collect()}
    assert got == {i: f"m/person_{i:03d}" for i in range(1, 1102)}


def test_every_value_has_its_own_surrogate_beyond_all_pairs(spark):
    vals = spark.createDataFrame([("m", k, f"n{i}") for k, n in (("surname", 95), ("single", 5)) for i in range(n)], "matter_id string, kind string, value string")
    pool = spark.createDataFrame([("surname", s) for s in ("Ash", "Birch", "Cole", "Dunn", None)] + [("single", "Elm")], "kind string, surrogate string")
    got = surrogates.issue(vals, pool, b"k")
    forms = [r["surrogate"] for r in got.filter("kind = 'surname'").collect()]
    assert len(forms) == len(set(forms)) == 95 and sorted(map(lambda f: f.count("-"), forms)) == [0] * 4 + [1] * 16 + [2] * 64 + [3] * 11
    assert {r["surrogate"] for r in got.filter("kind = 'single'").collect()} == {"-".join(["Elm"] * n) for n in range(1, 6)}
    index = surrogates.reverse_index(got.filter("kind = 'surname'"))
    back = surrogates.restored_tokens(index.select("matter_id", F.col("surrogate").alias("token")), index).collect()
    assert {r["restored"].lower() for r in back} == {f"n{i}" for i in range(95)}
