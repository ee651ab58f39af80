"""Find secrets in texts: three fixed patterns, and tokens that look random to a pair of character Markov models.

Everything is a DataFrame expression. Positions count code points: the gaps between matches, from ``split``, and the
matches themselves are summed up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainscope.llm.columns import bind


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# The kinds in their order. A quantifier stands for the least length where no shorter match could
# hide a longer one; the length of an assigned value is tested after matching.
KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(" + "|".join(map(either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]
LEAST_VALUE = 8

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
CANDIDATE = f"(?<!{TOKEN}){TOKEN}{{20,}}"       # a run of token characters, 20 or more
ORDINARY = f"(?<!{TOKEN}){TOKEN}{{4,}}"
PER_CHARACTER, IN_ALL = 0.5, 12.0               # log-likelihood ratio that a secret reaches, in nats


def prefix_sums(a: Column, block: int = 64) -> Column:
    """Inclusive prefix sums of an array, by blocks: work stays near linear for long arrays."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)

    def bases(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")),
                             lambda b: total(F.slice(x, b * block + 1, F.lit(block))))
        return F.aggregate(blocks, F.array(F.lit(0).cast("long")),
                           lambda s, y: F.concat(s, F.array(F.element_at(s, -1) + y)))

    return bind(a, lambda x: bind(bases(x), lambda base: F.transform(x, lambda _, i: F.get(
        base, F.floor(i / block).cast("int")) + total(F.slice(
            x, F.floor(i / block).cast("int") * block + 1, i % block + 1)))))


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None,
          group: int = 0) -> Column:
    """Array of (start, kind, end) of all matches; ``keep`` tests the given group of each match."""
    def place(found: Column) -> Column:
        lengths = F.transform(found, lambda m: F.length(m).cast("long"))
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        ends = prefix_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), lengths, lambda g, m: g + m))
        kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found,
                           keep or (lambda m: F.lit(True)))
        rows = F.transform(F.arrays_zip(ends.alias("e"), lengths.alias("m"), kept.alias("k")), lambda x: F.struct(
            (x["e"] - x["m"]).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), x["k"].alias("k")))
        return F.when(F.size(found) > 0, F.transform(F.filter(rows, lambda s: s["k"]), lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).otherwise(
            F.lit([]).cast(SPANS))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then kind."""
    return F.array_sort(F.concat(
        spans(text, ASSIGN, 0, lambda v: F.length(v) >= LEAST_VALUE, group=2),
        F.when(F.contains(text, F.lit("AKIA")), spans(text, ACCESS, 1)).otherwise(F.lit([]).cast(SPANS)),
        spans(text, HEX, 2)))


# ---------------------------------------------------------------- Markov models
def labelled_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Training tokens (token, secret) of all documents, in one pass without an exchange.

    What the patterns find is labelled secret; the other words are ordinary. Secrets may be rare, so no sample is taken:
    ``pair_weights`` only keeps counts.
    """
    text = F.col(text_col)
    values = F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE)
    secret = F.concat(values, F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    rest = text
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))

    def marked(tokens: Column, label: bool) -> Column:
        return F.transform(F.coalesce(tokens, F.lit([]).cast("array<string>")), lambda x: F.struct(
            x.alias("token"), F.lit(label).alias("secret")))

    return docs.select(F.inline(F.concat(marked(secret, True), marked(words, False))))


def pair_weights(tokens: DataFrame, prior: float = 8.0) -> list[float]:
    """log P(next | character, random) - log P(next | character, ordinary) for all pairs of the alphabet.

    Pairs are counted over all labelled tokens; one row per label and pair reaches the driver. Rare characters lean on
    the frequency of the next one alone, with the weight of ``prior`` pairs. Without samples of one label all weights
    are 0, and nothing is found.
    """
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, 2)))
    counts = tokens.where(F.length("token") >= 2).select("secret", pair.alias("pair")).groupBy("secret", "pair").count()
    k = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    table = {True: [[0] * k for _ in range(k)], False: [[0] * k for _ in range(k)]}
    for secret, two, n in counts.toLocalIterator():
        if two[0] in at and two[1] in at:
            table[secret][at[two[0]]][at[two[1]]] += n
    if not all(any(map(any, t)) for t in table.values()):
        return [0.0] * (k * k)
    logs = {}
    for secret, t in table.items():
        single = [sum(row[j] for row in t) + 1 for j in range(k)]
        all_singles = sum(single)
        logs[secret] = [[math.log((n + prior * single[j] / all_singles) / (sum(row) + prior)) for j, n in enumerate(row)]
                        for row in t]
    return [round(logs[True][i][j] - logs[False][i][j], 4) for i in range(k) for j in range(k)]


def likelihood_ratio(token: Column, weights: Sequence[float]) -> Column:
    """Sum of the weights of all pairs of neighbouring characters."""
    table = F.expr("cast(split('" + ",".join(f"{w:g}" for w in weights) + "', ',') as array<double>)")
    k = len(ALPHABET)

    def index(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(token, i, 1)) - 1

    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0),
                       lambda s, i: s + F.get(table, (index(i) * k + index(i + 1)).cast("int")))


def scan_secrets(docs: DataFrame, weights: Sequence[float], text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``base`` and ``found``: arrays of (start, kind, end), by start, then kind.

    ``base`` holds the matches of the fixed patterns; ``found`` adds runs of token characters whose
    log-likelihood ratio speaks for a random string, where no base span overlaps them. NULL and empty texts have
    none. Columns of these two names are replaced; all others, repeated rows and their number stay. One pass
    without an exchange.
    """
    def with_random(base: Column, text: Column) -> Column:
        random = spans(text, CANDIDATE, 3, lambda t: likelihood_ratio(t, weights) >= F.greatest(
            F.lit(IN_ALL), F.length(t) * PER_CHARACTER))
        return F.array_sort(F.concat(base, F.filter(random, lambda s: ~F.exists(
            base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))))

    text = F.coalesce(F.col(text_col), F.lit(""))
    both = bind(base_spans(text), lambda base: F.struct(base.alias("base"), with_random(base, text).alias("found")))
    others = docs.drop("base", "found")
    return others.select("*", F.inline(F.array(both)))


def count_kind(found: str, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def as_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, weights: Sequence[float], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span that ``scan_secrets`` finds replaced by ``mark``; overlapping spans become one."""
    def widen(s: Column, x: Column) -> Column:
        last = F.element_at(s, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"))
        return F.when(F.size(s) == 0, F.array(own)).when(
            x["start"] < last["end"], F.concat(F.slice(s, 1, F.size(s) - 1), F.array(joined))).otherwise(
            F.concat(s, F.array(own)))

    def cut(text: Column, merged: Column) -> Column:
        def after(i: Column) -> Column:
            return F.when(i > 0, F.get(merged, i - 1)["end"]).otherwise(F.lit(0).cast("long"))

        return F.concat(
            F.array_join(F.transform(merged, lambda m, i: F.concat(F.substring(
                text, (after(i) + 1).cast("int"), (m["start"] - after(i)).cast("int")), F.lit(mark))), ""),
            F.substring(text, (F.element_at(merged, -1)["end"] + 1).cast("int"), F.length(text)))

    found = scan_secrets(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), weights, "_text")
    merged = F.aggregate("found", F.lit([]).cast("array<struct<start:bigint,end:bigint>>"), widen)
    clean = F.when(F.size("found") > 0, bind(merged, lambda m: cut(F.col("_text"), m))).otherwise(F.col("_text"))
    return found.select(*[clean.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
