"""Secrets in texts: fixed patterns, and a randomness test battery with false-discovery control. Native only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from catloom.llm.common import stored, text_of

# The base patterns. A run shorter than its limit would be dropped, so the limits of the last two are
# part of the pattern; a failing assignment takes its text with it, so that limit is tested afterwards.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the battery: unbroken runs over the characters of common encodings, with a digit and a letter.
LEAST_LENGTH = 20
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, the narrowest first; a run belongs to the first that has all of its characters.
ENCODINGS = (
    ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("base32", UPPER + "234567"), ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER), ("base62", DIGITS + UPPER + LOWER), ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"), ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
)
BANDS = (20, 32, 64)  # a band has its own error control: short runs carry less evidence
BIN = 0.05  # of log10 p


def pattern_spans(text: Column, kind: str, pattern: str, keep=None) -> Column:
    """Array of (start, order, kind, end, value) of the matches; code points, end exclusive.

    The text between matches and the matches themselves alternate, so positions are running lengths.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    order = KINDS.index(kind)
    empty = F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,end:int,value:string>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["0"])
        stop = begin + F.length(pair["1"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), stop.alias("end"), pair["1"].alias("value"))
        kept = F.lit(True) if keep is None else keep(pair["1"])
        return F.struct(stop.alias("at"), F.when(kept, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    pairs = F.filter(F.arrays_zip(between.alias("0"), found.alias("1")), lambda p: p["1"].isNotNull())
    return F.aggregate(pairs, start, step, lambda state: state["spans"])


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,end:int,value:string>>)")


def base_spans(text: Column) -> dict[str, Column]:
    lowered = F.lower(text)
    may_assign = F.lit(False)
    for word in ASSIGN_WORDS:
        may_assign = may_assign | F.contains(lowered, F.lit(word))
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    return {
        "assign": F.when(may_assign, pattern_spans(text, "assign", ASSIGN, long_enough)).otherwise(_none()),
        "access": F.when(F.contains(text, F.lit("AKIA")), pattern_spans(text, "access", ACCESS)).otherwise(_none()),
        "hex": F.when(text.rlike(HEX), pattern_spans(text, "hex", HEX)).otherwise(_none()),
    }


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


# --- The battery: p-values of "this run is random", so ordinary text gets small ones ----------------


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable by a five-term rational approximation of the error function."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding_of(run: Column) -> Column:
    """(name, alphabet) of the first encoding that has every character of the run."""
    out = None
    for name, alphabet in reversed(ENCODINGS):
        here = F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))
        fits = F.translate(run, alphabet, "") == ""
        out = here if out is None else F.when(fits, here).otherwise(out)
    return out


def battery(runs: DataFrame) -> DataFrame:
    """Add encoding, n and p to rows with ``value``: the smallest of three p-values, times three.

    Chi-squared of the symbol counts against the uniform alphabet (upper tail, cube-root normal form), runs
    above and below the middle of the alphabet, and lag-one serial correlation of the symbol places (both sides).
    """
    df = runs.withColumn("_e", encoding_of(F.col("value"))).withColumn("encoding", F.col("_e.name"))
    df = df.withColumn("_m", F.length("_e.alphabet").cast("double")).withColumn("_chars", F.split("value", ""))
    places = F.transform("_chars", lambda c: (F.instr(F.col("_e.alphabet"), c) - 1).cast("double"))
    df = df.withColumn("_x", places).withColumn("n", F.size("_x").cast("double"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    # Squared counts: of each character, how many characters equal it.
    squares = F.aggregate(
        F.array_distinct("_x"), F.lit(0.0),
        lambda a, v: a + F.pow(F.size(F.filter("_x", lambda y: y == v)).cast("double"), F.lit(2.0)))
    df = df.withColumn("_chi", F.col("_m") / F.col("n") * squares - F.col("n"))
    free = F.col("_m") - 1
    z_chi = (F.cbrt(F.col("_chi") / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    df = df.withColumn("_high", F.transform("_x", lambda v: (v >= F.col("_m") / 2).cast("double")))
    df = df.withColumn("_n1", total(F.col("_high"))).withColumn("_n2", F.col("n") - F.col("_n1"))
    size = F.size("_x")
    pairs = lambda name: F.arrays_zip(F.slice(name, F.lit(1), size - 1).alias("a"), F.slice(name, F.lit(2), size - 1).alias("b"))
    n, n1, n2 = F.col("n"), F.col("_n1"), F.col("_n2")
    crossings = total(F.transform(pairs("_high"), lambda p: (p["a"] != p["b"]).cast("double"))) + 1
    middle = 2 * n1 * n2 / n + 1
    spread = F.sqrt(F.greatest(2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1)), F.lit(1e-9)))
    df = df.withColumn("_z_runs", F.when((n1 == 0) | (n2 == 0), F.lit(40.0)).otherwise((crossings - middle) / spread))
    df = df.withColumn("_mean", total(F.col("_x")) / n)
    variance = total(F.transform("_x", lambda v: (v - F.col("_mean")) * (v - F.col("_mean"))))
    serial = total(F.transform(pairs("_x"), lambda p: (p["a"] - F.col("_mean")) * (p["b"] - F.col("_mean"))))
    # Under randomness the lag-one coefficient has mean -1/n and variance about 1/n.
    df = df.withColumn("_z_serial", F.when(variance == 0, F.lit(40.0)).otherwise((serial / variance + 1 / n) * F.sqrt(n)))
    smallest = F.least(
        upper_tail(z_chi), 2 * upper_tail(F.abs(F.col("_z_runs"))), 2 * upper_tail(F.abs(F.col("_z_serial"))))
    p = F.greatest(F.least(3 * smallest, F.lit(1.0)), F.lit(1e-30))
    return df.select(*runs.columns, "encoding", "n", p.alias("p"))


def false_discovery_limits(tested: DataFrame, rate: float) -> DataFrame:
    """(band, limit): runs of the band with p at or below the limit are told from random at this rate of error.

    Step-up procedure on a histogram of log10 p, at most 600 bins for each band: a bin is rejected if its upper
    edge is at most rate * rank / tests.
    """
    bins = tested.groupBy("band", F.floor(F.log10("p") / BIN).alias("bin")).agg(F.count("*").alias("k"))
    ordered = Window.partitionBy("band").orderBy("bin")
    edge = F.pow(F.lit(10.0), (F.col("bin") + 1) * BIN)
    ranked = bins.withColumn("rank", F.sum("k").over(ordered)).withColumn("tests", F.sum("k").over(Window.partitionBy("band")))
    return ranked.where(edge <= rate * F.col("rank") / F.col("tests")).groupBy("band").agg(F.max(edge).alias("limit"))


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", rate: float = 0.05) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, n_random, spans.

    Base spans follow the fixed patterns. The battery adds kind ``random``: unbroken runs of at
    least 20 characters that it cannot tell from random symbols of their encoding, outside base spans. Which p-values
    count as ordinary text is settled over all runs of all documents, for each band of lengths apart, at the false-discovery
    ``rate``. Null and empty texts have no spans; repeated rows repeat their result; a null id is kept.
    """
    content = text_of(text)
    kinds = base_spans(content)
    runs = F.when(content.rlike(r"[A-Za-z0-9+/_-]{20}"), pattern_spans(content, "random", RUN)).otherwise(_none())
    found = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id).alias("_id"),
        *[kinds[k].alias(k) for k in KINDS[:3]], runs.alias("runs"),
    )
    found = found.withColumn("base", F.concat("assign", "access", "hex"))
    apart = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    # Written once: row numbers must not be drawn twice, and texts are scanned once.
    found = stored(found.withColumn("runs", apart))
    band = F.lit(BANDS[0])
    for least in BANDS[1:]:
        band = F.when(F.length("value") >= least, F.lit(least)).otherwise(band)
    each = found.select("_row", F.inline("runs")).withColumn("band", band)
    tested = stored(battery(each))
    limits = false_discovery_limits(tested, rate).withColumnRenamed("band", "_band")
    # One row per band of lengths.
    marked = tested.join(F.broadcast(limits), F.col("band") == F.col("_band"), "left")
    random = marked.where(F.col("p") > F.coalesce("limit", F.lit(0.0))).groupBy(F.col("_row").alias("_r")).agg(
        F.collect_list(F.struct("start", "ord", "kind", "end", "value")).alias("random"))  # runs of one document
    out = found.join(random, F.col("_row") == F.col("_r"), "left")
    extra = F.coalesce(F.col("random"), _none())
    return out.select(
        F.col("_id").alias(id),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        F.size(extra).cast("long").alias("n_random"), joined(F.concat("base", extra)).alias("spans"),
    )
