"""Secret scans in DataFrame functions only: fixed patterns, and strings a Markov model finds random.

The model is a pair of character-bigram chains: one of random strings, one of ordinary
identifiers. A candidate's log-likelihood ratio decides. Both chains are trained from
labelled samples: random ones are digests in several spellings and what the fixed patterns
find in the sampled documents; ordinary ones are the words of these documents, alone and
joined as identifiers are. The sample is ``SAMPLE_DOCS`` documents, whatever the size of
the table; every document is scanned whole.

Positions come from splitting a text at its matches: they are sums of the lengths of what
lies before. Only texts that hold a match pay for that.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns, and the least length of the group that counts. The look-ahead
# only lets most characters fail fast.
KINDS = {
    "assign": (r"""(?=[pstaPSTA])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ that are long enough
}

SAMPLE_DOCS = 2048
RANDOM_STRINGS = 2000
# A candidate has so many characters, a digit and a letter.
CANDIDATE = r"(?<![A-Za-z0-9_+=/-])[A-Za-z0-9_+=/-]{20,}"
MODEL_KIND = "random"
LEAST_RATIO = 20.0
LEAST_MEAN = 0.8
MARK = "[SECRET]"

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+=/-"
_SMOOTHING = 0.5
_BLOCK = 256
_SPAN = "array<struct<start:bigint,order:int,end:bigint,kind:string,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """Sum of all elements before each, in blocks, so that long arrays stay cheap."""
    numbers = F.sequence(F.lit(0), ((F.size(lengths) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))

    def within(block: Column, base: Column) -> Column:
        return F.transform(block, lambda _, j: base + _total(F.slice(block, F.lit(1), j)))

    return _let(blocks, lambda blocks: _let(
        F.transform(blocks, _total),
        lambda sums: F.flatten(F.transform(
            blocks, lambda block, b: _let(_total(F.slice(sums, F.lit(1), b)), lambda base: within(block, base))
        )),
    ))


def _found(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Matches as spans in code points, leftmost first, whose ``group`` has ``least`` characters."""
    parts = F.struct(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint")).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def spans(p: Column) -> Column:
        lengths = F.transform(p["whole"], lambda w, i: p["gaps"][i] + F.length(w))
        return _let(_let(lengths, _before), lambda before: F.transform(p["whole"], lambda w, i: F.struct(
            (before[i] + p["gaps"][i]).alias("start"), F.lit(order).alias("order"),
            (before[i] + p["gaps"][i] + F.length(w)).alias("end"), F.lit(kind).alias("kind"), p["value"][i].alias("value"),
        )))

    found = F.filter(_let(parts, spans), lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Spans of all fixed patterns by start, then kind as listed."""
    found = [_found(text, kind, i, *rule) for i, (kind, rule) in enumerate(KINDS.items())]
    return F.array_sort(F.concat(*found))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


# --- the model ----------------------------------------------------------------


def samples(docs: DataFrame, bound: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled strings (random boolean, value string) from at most ``bound`` documents."""
    spark = docs.sparkSession
    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.join(F.broadcast(chosen.distinct()), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    drawn = spark.range(RANDOM_STRINGS).select(F.explode(F.array(
        digest, F.upper(F.substring(digest, 1, 40)), F.base64(F.unhex(digest)),
        F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", ""),
    )).alias("value"))
    seen = texts.select(F.explode(F.transform(base_spans(F.col("text")), lambda s: s["value"])).alias("value"))
    plain = F.col("text")
    for pattern, _, _ in KINDS.values():
        plain = F.regexp_replace(plain, pattern, " ")
    word = texts.select(F.explode(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9_+=/-]{2,}"), F.lit(0))).alias("w")).distinct()
    word = word.where(F.col("w").rlike("^([A-Za-z]+([_/=-][A-Za-z]+)*[0-9]{0,3}|[0-9]+)$"))
    w, number = F.col("w"), F.pmod(F.xxhash64("w"), F.lit(100000)).cast("string")
    ordinary = word.select(F.explode(F.array(
        w, F.concat(w, F.initcap("w"), F.initcap("w")), *[F.concat(w, F.lit(s), w) for s in "_-/"], *[F.concat(w, F.lit(s), number) for s in "_-/="],
        F.concat(number, F.lit("/"), w),
    )).alias("value"))
    return drawn.union(seen).select(F.lit(True).alias("random"), "value").union(
        ordinary.select(F.lit(False).alias("random"), "value"))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of every bigram of the alphabet, row after row; larger is more random."""
    numbers = F.sequence(F.lit(1), F.length("value") - 1)
    pairs = labelled.where(F.length("value") > 1).select(
        "random", F.explode(F.transform(numbers, lambda i: F.substring("value", i, F.lit(2)))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    size = len(_ALPHABET)
    logs = {}
    for label in (True, False):
        rows = {a: sum(counts.get((label, a + b), 0) for b in _ALPHABET) for a in _ALPHABET}
        logs[label] = [
            (counts.get((label, a + b), 0) + _SMOOTHING) / (rows[a] + _SMOOTHING * size) for a in _ALPHABET for b in _ALPHABET
        ]
    return [round(math.log(r / o), 6) for r, o in zip(logs[True], logs[False], strict=True)]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string under ``model``."""
    table = F.array(*[F.lit(x) for x in model])
    size = len(_ALPHABET)

    def code(i: Column) -> Column:
        return F.instr(F.lit(_ALPHABET), F.substring(value, i, F.lit(1)))

    return F.aggregate(
        F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0),
        lambda total, i: total + F.element_at(table, (code(i) - 1) * size + code(i + 1)),
    )


# --- the operator -----------------------------------------------------------------


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """``docs`` (text string, doc_id for the training sample, any others) with two columns.

    ``base_spans`` are the matches of the fixed patterns, ``all_spans`` these and the random
    strings that touch none of them: arrays of (start, order, end, kind, value), positions
    in code points, end exclusive, by start, then kind. Null and empty texts have none.
    Columns of these two names are replaced. Repeated rows are scanned each; an empty table
    gives an empty one, its model knowing random strings only.
    """
    model = train(samples(docs)) if model is None else model
    text = F.coalesce("text", F.lit(""))
    docs = docs.drop("base_spans", "all_spans").withColumn("base_spans", base_spans(text))
    candidates = _found(text, MODEL_KIND, len(KINDS), CANDIDATE, 0, 20)

    def random(s: Column) -> Column:
        apart = ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        mixed = s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
        score = ratio(s["value"], model)
        return apart & mixed & (score >= F.greatest(F.lit(LEAST_RATIO), LEAST_MEAN * (F.length(s["value"]) - 1)))

    return docs.withColumn("all_spans", F.array_sort(F.concat("base_spans", F.filter(candidates, random))))


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """``text`` with a mark in place of each span; spans that overlap become one."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        return F.when(s["start"] < done["at"], F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(done["out"], gap, F.lit(mark)).alias("out")))

    out = F.aggregate(
        spans, begin, step,
        lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, out).otherwise(text)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and listings of a scan, one row per document."""
    count = {k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in KINDS}
    return scanned.select(
        "doc_id", *count.values(), F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"),
        _listed(F.col("all_spans")).alias("spans"))
