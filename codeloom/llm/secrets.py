"""Secret scans in native DataFrame functions: three base patterns, and a randomness test battery for all other tokens.

Base patterns give spans by the gaps between matches (split) and the matches themselves (regexp_extract_all).

Battery: every run of 20 or more token characters gets an inferred encoding (decimal, hex, base 32, 36, 62, 64 ...). Chi-squared
uniformity over that alphabet, a runs test about its middle and the lag-1 serial correlation give normal scores, which Fisher's rule
combines to the p-value of "drawn evenly". Tokens fall into classes by length, each doubling in two steps, and false discovery is held within each class, twice:
Benjamini-Hochberg on the battery's p-values finds the tokens that aren't random (of random ones at most the share `LOST` of these), which are no secrets. For the others the likelihood of the
token under uniform drawing is set against the best of three models of ordinary wording (lower-case words, upper-case words, numbers).
That ratio is an e-value, of mean at most 1 for ordinary wording, and it grows with length. The e-value form of Benjamini-Hochberg over the class
sets the cut, so the false discovery rate stays under `FDR` whatever dependence copies bring. Both cuts need only
histograms in quarter steps, rounded to the safe side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

FDR, LOST = 0.001, 0.01
_STEP, _LOW, _HIGH = 0.25, -200, 1200
#: Length classes, and matches that are gathered at once: an array that grows match by match would be copied each time.
_CLASSES, _RUN = 16, 256

# The patterns of the base spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_KINDS = ["assign", "access", "hex", "random"]
_SPAN = "array<struct<start: int, kind: int, end: int, value: string>>"
_COMMON, _RARE = "etaoinsrhldu", "bcfgjkmpqvwxyz"
_DIGITS, _SIGNS = "0123456789", "+/_-="
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_ENCODINGS = [
    (r"^[0-9]+$", _DIGITS),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[a-z]+$", _LOWER),
    (r"^[A-Z]+$", _LOWER.upper()),
    (r"^[A-Z2-7]+=*$", _LOWER.upper() + "234567"),
    (r"^[0-9a-z]+$", _DIGITS + _LOWER),
    (r"^[0-9A-Z]+$", _DIGITS + _LOWER.upper()),
    (r"^[0-9A-Za-z]+$", _DIGITS + _LOWER.upper() + _LOWER),
    (r"^.*$", _DIGITS + _LOWER.upper() + _LOWER + "+/_-"),
]


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """The matches of pattern in text as (start, kind, end, value), in code points; keep: a test of a match's second group."""
    p = F.lit(pattern)
    parts = [F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit")]
    if keep is not None:
        parts.append(F.regexp_extract_all(text, p, F.lit(2)).alias("group"))
    none = F.expr(f"cast(array() as {_SPAN})")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("value")))
        more = span if keep is None else F.when(keep(x["group"]), span).otherwise(none)
        return F.when(x["hit"].isNull(), done).otherwise(F.struct(end.alias("at"), F.concat(done["out"], more).alias("out")))

    return F.when(text.rlike(pattern), _running(F.arrays_zip(*parts), none, step)).otherwise(none)


def _running(items: Column, none: Column, step) -> Column:
    """What step adds to `out` along items, with `at` carried on; gathered in runs of _RUN, so that the work grows in proportion."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(_RUN)), lambda i: F.slice(items, i + 1, _RUN))

    def add(done: Column, run: Column) -> Column:
        got = F.aggregate(run, F.struct(done["at"].alias("at"), none.alias("out")), step)
        return _let(got, lambda g: F.struct(g["at"].alias("at"), F.concat(done["out"], F.array(g["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.slice(F.array(none), 1, 0).alias("out"))
    return F.aggregate(runs, start, add, lambda done: F.flatten(done["out"]))


def _count(token: Column, of: str) -> Column:
    return F.length(token) - F.length(F.translate(token, of, ""))


def _two_sided(z: Column) -> Column:
    """A logistic approximation of the normal's two-sided tail, kept above 0."""
    a = F.abs(z)
    return F.greatest(F.lit(1e-300), F.lit(2.0) / (F.lit(1.0) + F.exp(F.least(F.lit(600.0), 1.5976 * a + 0.070566 * a * a * a))))


def _battery(token: Column, alphabet: Column) -> Column:
    """Fisher's combination of the three tests' p-values for a token over its alphabet."""
    size = F.length(alphabet).cast("double")
    plain = F.regexp_replace(token, "=+$", "")
    values = F.transform(F.split(plain, ""), lambda ch: F.instr(alphabet, ch).cast("double"))

    def measured(v: Column) -> Column:
        """What the tests need of the values, each computed once: inside a lambda it would be computed at every step."""
        n = F.size(v).cast("double")
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(
            v.alias("v"), n.alias("n"), pairs.alias("pairs"), (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n).alias("mean"), F.size(F.filter(v, lambda x: x > size / 2)).cast("double").alias("high")
        )

    def tests(c: Column) -> Column:
        v, n, mean, high = c["v"], c["n"], c["mean"], c["high"]
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda s, x: s + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), 2))
        chi = squares * size / n - n
        z_chi = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        low = n - high
        runs = 1.0 + F.size(F.filter(c["pairs"], lambda p: (p["a"] > size / 2) != (p["b"] > size / 2)))
        expected = 1 + 2 * high * low / n
        spread = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(spread > 0, (runs - expected) / F.sqrt(spread)).otherwise(F.sqrt(n))
        square = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(x - mean, 2))
        cross = F.aggregate(c["pairs"], F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean))
        z_serial = F.when(square > 0, (cross / square + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        # too even a spread of characters is as little random as too uneven a one, and so with the others
        half = F.least(F.lit(700.0), -(F.log(_two_sided(z_chi)) + F.log(_two_sided(z_runs)) + F.log(_two_sided(z_serial))))
        return _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return _let(_let(values, measured), tests)


def _log_e(token: Column, alphabet: Column) -> Column:
    """Log likelihood ratio: uniform drawing over the alphabet against the best model of ordinary wording."""
    common, rare = _count(token, _COMMON), _count(token, _RARE)
    common_up, rare_up = _count(token, _COMMON.upper()), _count(token, _RARE.upper())
    digits, signs = _count(token, _DIGITS), _count(token, _SIGNS)

    def model(c: float, r: float, cu: float, ru: float, d: float, s: float) -> Column:
        return (
            common * math.log(c / 12) + rare * math.log(r / 14) + common_up * math.log(cu / 12) + rare_up * math.log(ru / 14) + digits * math.log(d / 10) + signs * math.log(s / 5)
        )

    ordinary = F.greatest(model(0.72, 0.17, 0.03, 0.03, 0.03, 0.02), model(0.03, 0.03, 0.72, 0.17, 0.03, 0.02), model(0.02, 0.02, 0.02, 0.02, 0.86, 0.06))
    return -F.length(token) * F.log(F.length(alphabet).cast("double")) - ordinary


def _judged(token: Column) -> Column:
    alphabet = F.lit(_ENCODINGS[-1][1])
    for pattern, letters in reversed(_ENCODINGS[:-1]):
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    e = lambda a: F.greatest(F.lit(_LOW), F.least(F.lit(_HIGH), _log_e(token, a) / _STEP))
    size = F.least(F.lit(_CLASSES - 1), F.floor(2 * F.log2(F.length(token) / 20.0))).cast("int")
    return _let(
        alphabet,
        lambda a: _let(
            _battery(token, a),
            lambda p: F.struct(
                size.alias("size"), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(_HIGH)), -F.log(F.greatest(p, F.lit(1e-300))) / _STEP))).cast("int").alias("odd"), F.floor(e(a)).cast("int").alias("bin")
            ),
        ),
    )


def _held(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """keep, base and tokens (span, told) of each row, as a saved table."""
    long_enough = lambda group: F.length(group) >= 12
    docs = docs.select(F.coalesce(text.cast("string"), F.lit("")).alias("text_"), *keep)
    t = F.col("text_")
    rest = [c for c in docs.columns if c != "text_"]
    base = F.array_sort(F.concat(_spans(t, ASSIGN, 0, long_enough), _spans(t, ACCESS, 1), _spans(t, HEX, 2)))
    base = F.filter(base, lambda s: (s["kind"] != 1) | (F.length(s["value"]) >= 18))
    tokens = docs.select(*rest, base.alias("base"), _spans(t, CANDIDATE, 3).alias("tokens"))
    free = F.filter("tokens", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return saved(tokens.select(*rest, "base", F.transform(free, lambda s: F.struct(s.alias("span"), _judged(s["value"]).alias("told"))).alias("tokens")))


def _cuts(told: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """By length class: the step of -log p from which tokens aren't random, and the step of the log ratio from which random ones are secrets.

    told (size, odd, bin). What is gathered has one row a class at most; classes without a cut are missing.
    """
    below = Window.partitionBy("size")

    def cut(counts: DataFrame, step: str, level: float, evidence: Column) -> dict[int, int]:
        """The least step with m / k times its bound within the level, k being the tokens from that step on."""
        steps = counts.groupBy("size", step).agg(F.sum("n").alias("n"))
        above = steps.withColumn("k", F.sum("n").over(below.orderBy(F.desc(step)))).join(F.broadcast(counts.groupBy("size").agg(F.max("m").alias("m"))), "size")
        return {r["size"]: r["cut"] for r in above.where(F.log("m") - F.log("k") - evidence <= math.log(level)).groupBy("size").agg(F.min(step).alias("cut")).collect()}

    counts = saved(told.groupBy("size", "odd", "bin").agg(F.count("*").alias("n")))  # at most classes x steps x steps
    counts = counts.join(F.broadcast(counts.groupBy("size").agg(F.sum("n").alias("m"))), "size")
    odd = cut(counts, "odd", LOST, F.col("odd") * _STEP)
    return odd, cut(counts.where(~_at_least("size", "odd", odd)), "bin", FDR, F.col("bin") * _STEP)


def _at_least(size: Column | str, step: Column | str, cuts: dict[int, int]) -> Column:
    """Whether a token's step reaches the cut of its class."""
    size, step = (F.col(c) if isinstance(c, str) else c for c in (size, step))
    out = F.lit(False)
    for k, low in cuts.items():
        out = F.when(size == k, step >= low).otherwise(out)
    return out


def _random(held: DataFrame) -> Column:
    """The spans of those tokens that both cuts leave."""
    odd, sure = _cuts(held.select(F.explode("tokens").alias("x")).select("x.told.*"))
    told = lambda x: x["told"]
    chosen = F.filter("tokens", lambda x: ~_at_least(told(x)["size"], told(x)["odd"], odd) & _at_least(told(x)["size"], told(x)["bin"], sure))
    return F.transform(chosen, lambda x: x["span"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, base, random: arrays of (start, kind, end, value), in code points; one row per row of docs.

    base holds the spans of the three patterns by start, random those that the battery adds: they meet no base span and pass the
    cuts of their length class. Null texts count as empty and have no spans. Copies count as often as they occur. Other columns are ignored. The result
    rests on a table written to the shared folder: one pass over the texts, then one over its small rows.
    """
    held = _held(docs, F.col("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return held.select("doc_id", "base", _random(held).alias("random"))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of docs. Cases as in scan_secrets()."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every found span replaced by a mark; overlapping spans become one. Other columns stay as they are, whatever their names.

    Each row is cut by its own spans, which are saved beside it, so ids may repeat or be null. Texts without spans, null ones too, come back unchanged.
    """
    held = _held(docs, F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    held = held.select("row", F.array_sort(F.concat("base", _random(held))).alias("found"))
    text = F.col("row.text").cast("string")
    none = F.expr("cast(array() as array<struct<low: int, start: int, end: int>>)")

    def step(done: Column, s: Column) -> Column:
        """The gap before a span that doesn't begin inside one before."""
        fresh = F.array(F.struct(done["at"].alias("low"), s["start"].alias("start"), s["end"].alias("end")))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] >= done["at"], F.concat(done["out"], fresh)).otherwise(done["out"]).alias("out"))

    gaps = _running(F.col("found"), none, step)
    last = F.array_max(F.transform("found", lambda s: s["end"]))
    parts = F.concat(F.transform(gaps, lambda g: F.concat(F.substring(text, g["low"] + 1, g["start"] - g["low"]), F.lit(mark))), F.array(F.substring(text, last + 1, F.length(text))))
    clean = F.when(F.size("found") == 0, text).otherwise(F.array_join(parts, ""))
    return held.select(*[(clean if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
