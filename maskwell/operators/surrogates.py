"""Keyed surrogates, one-way tokens and restoration.

Issue is injective per matter and kind: the candidates of a kind are ranked by
keyed hash, real values are ranked by keyed hash, and equal ranks meet. Both
sides are joined; no row waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.functions.checks import digits_only
from maskwell.functions.keyed import hmac_hex, hmac_int
from maskwell.functions.strings import into_layout, like_case, phone_class

# Number ranges and domains reserved for fiction and documentation.
RESERVED_MOBILES = [
    f"0491{x}" for x in "570006 570156 570157 570158 570159 570110 570313 570737 571266 571491 571804 572549 572665 572983 573770 573087 574118 574632 575254 575789 576398 576801 577426 577644 578957 578148 578888 579212 579760 579455".split()
]
RESERVED_LANDLINES = ["5550", "7010"]
RESERVED_FREE = {"1300": [f"13009757{x:02d}" for x in range(7, 12)], "1800": ["1800160401", *(f"18009757{x:02d}" for x in range(7, 12))]}
RESERVED_DOMAINS = ["example.com", "example.org", "example.net"]


def issue(values: DataFrame, pool: DataFrame, key: bytes, scope: str = "matter_id", kind: str = "kind", value: str = "value") -> DataFrame:
    """(scope, kind, value, surrogate): injective within scope and kind.

    ``pool``: kind, surrogate. Values beyond the pool get hyphenated runs of
    pool entries, pairs first, as many parts as their rank needs, so none goes
    without and none shares one (pool entries with hyphens could imitate a run).
    Nulls are left out.
    """
    real = values.select(scope, kind, value).dropna().distinct()
    size = pool.groupBy(kind).agg(F.countDistinct("surrogate").alias("_size"))
    rank = F.row_number().over(Window.partitionBy(scope, kind).orderBy(hmac_hex(key, scope, kind, value), value)) - 1
    real = real.withColumn("_r", rank.cast("long")).join(size, kind)
    place = F.row_number().over(Window.partitionBy(kind).orderBy(hmac_hex(key, kind, "surrogate"), "surrogate")) - 1
    ranked = pool.select(kind, "surrogate").dropna().distinct().withColumn("_p", place.cast("long"))
    # The rank in base pool size without a zero digit, lowest place first: ranks and runs are one to one.
    most = F.when(F.col("_size") == 1, F.col("_r") + 1).otherwise(F.floor(F.log2(F.col("_r") + 2)) + 1).cast("int")
    start = F.struct(F.col("_r").alias("q"), F.array().cast("array<bigint>").alias("parts"))

    def step(s: Column, _: Column) -> Column:
        digit = s["q"] % F.col("_size")
        more = F.struct((((s["q"] - digit) / F.col("_size")).cast("long") - 1).alias("q"), F.array_append(s["parts"], digit).alias("parts"))
        return F.when(s["q"] >= 0, more).otherwise(s)

    parts = F.aggregate(F.sequence(F.lit(1), most), start, step)["parts"]
    each = real.select(scope, kind, value, F.posexplode(parts).alias("_i", "_p")).join(ranked, [kind, "_p"])
    whole = each.groupBy(scope, kind, value).agg(F.array_sort(F.collect_list(F.struct("_i", "surrogate"))).alias("_s"))
    return whole.select(scope, kind, value, F.concat_ws("-", F.col("_s.surrogate")).alias("surrogate"))


def lookup_key(key: bytes, *parts: Column | str) -> Column:
    """The keyed hash a vault row is found by; the value itself is not kept."""
    return hmac_hex(key, *parts)


def keyed_stream(key: bytes, length: Column, *parts: Column | str) -> Column:
    """At least ``length`` pairs of keyed hex digits: HMACs of the parts with a counter."""
    return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.floor(length / 32).cast("int")), lambda i: hmac_hex(key, *parts, i.cast("string"))))


def format_preserving(col: Column | str, key: bytes, *scope: Column | str) -> Column:
    """Digits replaced by keyed digits and letters by keyed letters of the same case; everything else stays."""
    c = F.col(col) if isinstance(col, str) else col
    stream = keyed_stream(key, F.length(c), *scope, c)

    def one(i: Column) -> Column:
        ch = F.substring(c, i, F.lit(1))
        n = F.conv(F.substring(stream, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
        letter = F.chr(F.lit(65) + n % 26)
        return F.when(ch.rlike("^[0-9]$"), (n % 10).cast("string")).when(ch.rlike("^[A-Z]$"), letter).when(ch.rlike("^[a-z]$"), F.lower(letter)).otherwise(ch)

    return F.when(F.length(c) > 0, F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(c)), one))).otherwise(c)


def with_unusable(df: DataFrame, col: str, kind: str, key: bytes, *scope: str, out: str = "surrogate") -> DataFrame:
    """Adds a number in the layout of the original that fails its check digit.

    Ten candidates differ in the digit the scheme checks (the ninth of a Medicare
    number, else the last), of which at most one can pass. Numbers too short for
    that digit fail by their length.
    """
    from maskwell.functions.checks import VALIDATORS

    made = df.withColumn("_made", format_preserving(col, key, *scope)).withColumn("_d", digits_only("_made"))
    at = F.lit(9) if kind == "medicare" else F.length("_d")
    last = F.substring(F.col("_d"), at, F.lit(1)).try_cast("int")
    tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.substring(F.col("_d"), F.lit(1), at - 1), ((last + i) % 10).cast("string"), F.substring(F.col("_d"), at + 1, F.length("_d"))))
    bad = F.get(F.filter(tries, lambda x: ~VALIDATORS[kind](x)), F.lit(0))
    made = made.withColumn("_bad", F.when(F.length("_d") >= at, bad))
    return made.withColumn(out, F.when(F.col("_bad").isNull(), F.col("_made")).otherwise(into_layout(F.col("_made"), F.col("_bad")))).drop("_made", "_d", "_bad")


def issued_phones(values: DataFrame, key: bytes, scope: str, value: str) -> DataFrame:
    """(scope, value, number_class, surrogate): reserved numbers of the same class and area, one each within the scope.

    Numbers are ranked by keyed hash within scope, class and area. The reserved
    mobiles and free-call numbers are few; ranks beyond them take reserved
    landline numbers, 20,000 an area. What is no phone number gets ``[PHONE]``,
    and so does a six-digit 13 number, of which none is reserved.
    """
    v = values.select(scope, value).dropna().distinct()
    d = digits_only(value)
    d = F.when((F.length(d) == 11) & d.startswith("61"), F.concat(F.lit("0"), F.substring(d, 3, 9))).otherwise(d)
    v = v.withColumn("number_class", phone_class(value)).withColumn("_area", F.when(F.col("number_class") == "landline", F.substring(d, 1, 2)).otherwise(F.lit("02")))
    w = Window.partitionBy(scope, "number_class", "_area").orderBy(hmac_hex(key, "number_class", value), value)
    v = v.withColumn("_r", (F.row_number().over(w) - 1).cast("long"))
    land = lambda r: F.concat("_area", F.when(r < 10000, RESERVED_LANDLINES[0]).otherwise(RESERVED_LANDLINES[1]), F.lpad((r % 10000).cast("string"), 4, "0"))
    few = {"mobile": RESERVED_MOBILES, **RESERVED_FREE}
    full = F.when(F.col("number_class") == "landline", land(F.col("_r")))
    for k, (cls, pool) in enumerate(few.items(), 1):
        # Each class has its own run of landline numbers beyond its pool.
        spare = land(F.col("_r") - len(pool) + 10000 + 3000 * k)
        full = full.when(F.col("number_class") == cls, F.coalesce(F.get(F.array(*[F.lit(x) for x in pool]), F.col("_r").cast("int")), spare))
    own = digits_only(value)
    shown = F.when(own.startswith("61") & (F.length(own) == 11), F.concat(F.lit("61"), F.substring(full, 2, 9))).otherwise(full)
    out = F.when(F.length(own) == F.length(shown), into_layout(F.col(value), shown)).otherwise(F.coalesce(full, F.lit("[PHONE]")))
    return v.select(scope, value, "number_class", F.when(F.col("number_class") == "13", F.lit("[PHONE]")).otherwise(out).alias("surrogate"))


def is_reserved_phone(col: Column | str) -> Column:
    """Whether a number is one that belongs to nobody."""
    d = digits_only(col)
    d = F.when((F.length(d) == 11) & d.startswith("61"), F.concat(F.lit("0"), F.substring(d, 3, 9))).otherwise(d)
    return F.coalesce(d.isin([*RESERVED_MOBILES, *RESERVED_FREE["1300"], *RESERVED_FREE["1800"]]) | d.rlike(r"^0[2378](?:5550|7010)\d{4}$"), F.lit(False))


def url_surrogate(col: Column | str, key: bytes, *scope: Column | str) -> Column:
    """An address on a reserved domain: scheme and www kept, the path keyed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.regexp_extract(c, r"^(https?://)?", 0), F.when(c.rlike(r"^(https?://)?www\."), "www.").otherwise(""), F.lit(RESERVED_DOMAINS[0] + "/"), F.substring(hmac_hex(key, *scope, c), 1, 10))


def free_pool(pool: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """``pool`` less the entries all of whose words stand in the texts, so that no surrogate is a real name of them."""
    word = F.filter(F.split(F.lower(name), r"[^\p{L}]+"), lambda w: w != "")
    parts = pool.select(name).distinct().select(name, F.explode(word).alias("_w"), F.size(word).alias("_n"))
    seen = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))).alias("_w")).distinct()
    used = parts.join(seen, "_w").groupBy(name, "_n").agg(F.countDistinct("_w").alias("_k")).filter("_k >= _n").select(name)
    return pool.join(used, name, "left_anti")


def letter_permutation(scopes: DataFrame, scope: str, key: bytes) -> DataFrame:
    """(scope, letter, turned): A to Z in the order of their keyed hashes, per scope."""
    letters = scopes.select(scope).distinct().withColumn("turned", F.explode(F.array(*[F.lit(chr(65 + i)) for i in range(26)])))
    w = Window.partitionBy(scope).orderBy(hmac_hex(key, scope, "turned"), "turned")
    return letters.select(scope, F.chr(F.lit(64) + F.row_number().over(w)).alias("letter"), "turned")


def group_gender(groups: DataFrame, ident: str, honorifics: str, given: str, lexicon: dict[str, str] | None = None) -> DataFrame:
    """(ident, gender): the majority of the honorifics, a tie alphabetically, else the given names' lexicon, else unknown."""
    shown = {"mr": "male", "sir": "male", "mrs": "female", "ms": "female", "miss": "female", "dame": "female"}
    table = F.create_map(*[F.lit(x) for kv in shown.items() for x in kv])
    known = F.create_map(*[F.lit(x) for kv in (lexicon or {"": "unknown"}).items() for x in kv])
    said = F.filter(F.transform(honorifics, lambda h: table[F.lower(F.regexp_replace(h, r"\.", ""))]), lambda g: g.isNotNull())
    f, m = F.size(F.filter(said, lambda g: g == "female")), F.size(F.filter(said, lambda g: g == "male"))
    by_name = F.get(F.filter(F.transform(given, lambda g: known[F.lower(g)]), lambda g: g.isNotNull()), F.lit(0))
    return groups.select(ident, F.when((f > 0) & (f >= m), "female").when(m > 0, "male").otherwise(F.coalesce(by_name, F.lit("unknown"))).alias("gender"))


def issued_birth_day(born: Column, refs: Column, key: bytes, *scope: Column | str, least: int = 14) -> Column:
    """A keyed day of the days that give the same ages; null where fewer than ``least`` do."""
    days = born_same_year(born, refs)
    return F.when(F.size(days) >= least, F.get(days, (hmac_int(key, *scope, born.cast("string")) % F.size(days)).cast("int")))


def birth_day_conflicts(born: Column, surrogate: Column, refs: Column) -> Column:
    """Whether a later reference date gives the surrogate another age."""
    from maskwell.functions.strings import completed_years

    return F.exists(refs, lambda r: (r >= born) & (completed_years(born, r) != completed_years(surrogate, r)))


def vault_put(vault: DataFrame, new: DataFrame, keys: list[str], value: str = "surrogate") -> tuple[DataFrame, DataFrame]:
    """(rows to add, conflicts): mappings are frozen; a key that has another value already is a conflict."""
    old = vault.select(*keys, F.col(value).alias("_old"))
    both = new.distinct().join(old, keys, "left")
    return both.filter("_old IS NULL").drop("_old"), both.filter(F.col("_old") != F.col(value)).withColumnRenamed("_old", "issued")


def reserved_email(key: bytes, *scope: Column | str) -> Column:
    """An address on a domain reserved for documentation."""
    h = hmac_int(key, *scope)
    domain = F.element_at(F.array(*[F.lit(d) for d in RESERVED_DOMAINS]), (h % len(RESERVED_DOMAINS) + 1).cast("int"))
    return F.concat(F.lit("user"), F.lpad((h % 1000000).cast("string"), 6, "0"), F.lit("@"), domain)


def born_same_year(born: Column, refs: Column) -> Column:
    """Days of the year of birth that give the same age at every reference date."""
    from maskwell.functions.strings import completed_years

    year = F.year(born)
    days = F.sequence(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31)), F.expr("interval 1 day"))
    ok = lambda d: (d != born) & ~((F.month(d) == 2) & (F.dayofmonth(d) == 29)) & F.forall(refs, lambda r: (r < born) | (completed_years(d, r) == completed_years(born, r)))
    return F.filter(days, ok)


def cased(surrogate: Column | str, original: Column | str) -> Column:
    return like_case(F.col(surrogate) if isinstance(surrogate, str) else surrogate, F.col(original) if isinstance(original, str) else original)


def reverse_index(vault: DataFrame, scope: str = "matter_id") -> DataFrame:
    """(scope, surrogate, value, ambiguous): forms that stand for one value, or for several."""
    per = vault.groupBy(scope, "surrogate").agg(F.countDistinct("value").alias("n"), F.min("value").alias("value"))
    return per.select(scope, "surrogate", F.when(F.col("n") == 1, F.col("value")).alias("value"), (F.col("n") > 1).alias("ambiguous"))


def restored_tokens(tokens: DataFrame, index: DataFrame, scope: str = "matter_id") -> DataFrame:
    """``tokens`` (scope, token, ...) with ``restored``; ambiguous and unknown stay."""
    low = index.select(scope, F.lower("surrogate").alias("_k"), F.col("value").alias("_v"))
    out = tokens.withColumn("_k", F.lower("token")).join(low, [scope, "_k"], "left")
    return out.withColumn("restored", F.coalesce(cased("_v", "token"), F.col("token"))).drop("_k", "_v")
