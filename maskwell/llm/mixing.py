"""Mixing sources to target weights.

Method: cube-method balanced sampling. Every document gets an inclusion
intensity: what its source must contribute divided by what the source holds,
capped at the allowed repeats. The whole part is a sure number of repeats; the
fractional part is the inclusion probability of one more. Probabilities walk
through the null space of the balancing constraints (tokens, documents) until
they are 0 or 1: first inside small blocks of one source (flight, in parallel),
then over what the blocks leave (at most as many rows a block as there are
constraints), level by level, until a landing problem of a few rows remains per
source, which is rounded so that the token total is met as closely as it can.

The achievable total is the largest for which no source needs more than its
capped repeats; sources that are short of it are used in full and the shares
reached are reported. Spellings of a source differ in case, blanks, hyphens and
underscores only. Copies of a record (same doc_id) count once; null or unknown
sources, null texts and texts without a token are left out of the mix. Sources
without a target get none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.runtime import stage

#: Rows per flight block; blocks are salted, so a source of any size spreads over tasks.
BLOCK = 256
DEFAULT_TOKENIZER = "byte_bpe_50k.tiktoken"


def source_key(col: Column | str) -> Column:
    """Plain spelling of a source name."""
    c = F.col(col) if isinstance(col, str) else col
    k = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_.]+", "_")
    return F.when(k != "", k)


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counter(path: str) -> Callable[[str], int]:
    """A function that counts the tokens of one whole text; vocabularies of ranks (.tiktoken) or of the tokenizers library (.json)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda x: len(t.encode(x, add_special_tokens=False).ids)
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda x: len(e.encode_ordinary(x))


def token_counts(df: DataFrame, text: str = "text", path: str | None = None, out: str = "tokens") -> DataFrame:
    """``df`` with the number of tokens of the whole text; null for null."""
    where = path or tokenizer_path()

    @F.pandas_udf(T.LongType())
    def count(batches: pd.Series) -> pd.Series:
        global _TOKENIZER
        if globals().get("_TOKENIZER", (None,))[0] != where:
            _TOKENIZER = (where, token_counter(where))
        return pd.Series([_TOKENIZER[1](x) if x else 0 for x in batches], dtype="int64")

    return df.withColumn(out, F.when(F.col(text).isNotNull(), count(F.col(text))))


def flight(pi: np.ndarray, balance: np.ndarray, seed: int) -> np.ndarray:
    """Walk ``pi`` through the null space of the constraints until few are left.

    ``balance`` (constraints x rows) must satisfy that sums of balance * pi are
    kept. Ends with at most ``constraints`` values strictly inside (0, 1).
    """
    rng = np.random.default_rng(seed)
    pi = pi.astype(float).copy()
    eps = 1e-9
    p = balance.shape[0]
    open_rows = [i for i in range(len(pi)) if eps < pi[i] < 1 - eps]
    active, nxt = open_rows[: p + 1], p + 1
    while len(active) > p:
        a = balance[:, active]
        _, _, vt = np.linalg.svd(a / np.maximum(np.abs(a).max(axis=1, keepdims=True), 1e-12))
        u = vt[-1]
        x = pi[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > eps, (1 - x) / u, np.where(u < -eps, -x / u, np.inf)).min()
            down = np.where(u > eps, x / u, np.where(u < -eps, (x - 1) / u, np.inf)).min()
        step = up if rng.random() < down / (up + down) else -down
        x = np.clip(x + step * u, 0, 1)
        x[x < 1e-7], x[x > 1 - 1e-7] = 0, 1
        pi[active] = x
        active = [i for i in active if 0 < pi[i] < 1]
        while len(active) <= p and nxt < len(open_rows):
            active.append(open_rows[nxt])
            nxt += 1
        if len(active) <= p:
            break
    return pi


def landing(pi: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Round the few open rows so that the token total is met best."""
    pi = pi.copy()
    rest = [i for i in range(len(pi)) if 0 < pi[i] < 1]
    want = sum(pi[i] * tokens[i] for i in rest)
    best, pick = None, 0
    for mask in range(1 << len(rest)):
        got = sum(tokens[i] for b, i in enumerate(rest) if mask >> b & 1)
        score = (abs(got - want), mask)
        if best is None or score < best:
            best, pick = score, mask
    for b, i in enumerate(rest):
        pi[i] = 1.0 if pick >> b & 1 else 0.0
    return pi


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()[:8], "big")


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    return _block(pdf, False)


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    return _block(pdf, True)


def _block(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["u", "doc_id"], kind="stable").reset_index(drop=True)
    pi, tok = pdf["pi"].to_numpy(float), pdf["tokens"].to_numpy(float)
    done = flight(pi, np.vstack([tok, np.ones(len(tok))]), _seed(pdf["source"].iloc[0], pdf["block"].iloc[0], len(pdf)))
    pdf["pi"] = landing(done, tok) if last else done
    return pdf


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, held, wanted, intensity) per target source.

    ``sizes``: source, tokens totals. One row per source of ``targets``, a table
    the caller states and which is small by nature.
    """
    t = targets.select(source_key("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    t = t.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").dropDuplicates(["source"])
    both = t.join(sizes.groupBy("source").agg(F.sum("tokens").alias("held")), "source", "left").fillna(0, ["held"])
    # The total that the scarcest source with any tokens still reaches.
    total = both.filter("held > 0").agg(F.min(F.col("held") * F.col("max_repeats") / F.col("target_share")).alias("total"))
    both = both.crossJoin(F.broadcast(total))
    wanted = F.least(F.col("held") * F.col("max_repeats"), F.col("total") * F.col("target_share"))
    both = both.withColumn("wanted", F.coalesce(wanted, F.lit(0.0)))
    return both.withColumn("intensity", F.when(F.col("held") > 0, F.col("wanted") / F.col("held")).otherwise(F.lit(0.0))).drop("total")


def mix_sources(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the chosen documents, repeats >= 1."""
    rows = docs.select("doc_id", source_key("source").alias("source"), "text").dropna()
    # Counted where the text is read, so that no text is shuffled; copies of a record are told by the hash of theirs.
    rows = token_counts(rows, path=path).select("doc_id", "source", "tokens", F.md5("text").alias("h"))
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("source", "tokens"), F.struct("source", "h")).alias("r")).select("doc_id", "r.*").filter("tokens > 0")
    rows, _ = stage(rows, "tokens")
    plan, _ = stage(mix_plan(rows, targets), "plan")
    rows = rows.join(F.broadcast(plan.select("source", "intensity", "max_repeats")), "source")
    rows = rows.withColumn("sure", F.floor("intensity").cast("int")).withColumn("pi", F.col("intensity") - F.floor("intensity"))
    whole = (F.col("pi") < 1e-9) | (F.col("sure") >= F.col("max_repeats"))
    settled = rows.filter(whole).select("doc_id", "source", "tokens", F.col("sure").alias("repeats"))
    u = F.xxhash64("doc_id", F.lit("mix"))
    left = rows.filter(~whole).select("doc_id", "source", "tokens", "sure", "pi", u.alias("u"))
    most = max([r["n"] for r in left.groupBy("source").agg(F.count("*").alias("n")).collect()], default=0)
    schema = "doc_id long, source string, tokens long, sure int, pi double, u long, block long"
    schema = schema.replace("doc_id long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    done = None
    while True:
        blocks = max(1, -(-most // BLOCK))
        salted = left.withColumn("block", F.pmod(F.xxhash64("u", F.lit(blocks)), F.lit(blocks)))
        last = blocks == 1
        flown = salted.groupBy("source", "block").applyInPandas(_land if last else _fly, schema).drop("block")
        flown, _ = stage(flown, "flight")
        fixed = flown.filter("pi <= 0 OR pi >= 1")
        done = fixed if done is None else done.union(fixed)
        if last:
            break
        left = flown.filter("pi > 0 AND pi < 1")
        # Each block leaves two rows at most.
        most = 2 * blocks
    drawn = done.select("doc_id", "source", "tokens", (F.col("sure") + F.round("pi").cast("int")).alias("repeats"))
    return settled.union(drawn).filter("repeats > 0")


def mix_report(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, documents, copies, tokens, share, target_share) reached, one row per target."""
    t = targets.select(source_key("source").alias("source"), "target_share").dropDuplicates(["source"])
    got = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum("repeats").alias("copies"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    total = got.agg(F.sum("tokens").alias("total"))
    both = t.join(got, "source", "left").fillna(0, ["documents", "copies", "tokens"]).crossJoin(F.broadcast(total))
    return both.select("source", "documents", "copies", "tokens", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("share"), "target_share")
