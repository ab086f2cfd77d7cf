"""Secrets in texts: known shapes by pattern, others by entropy. DataFrame functions only.

Candidates are runs of characters of one class. A window slides over each; the counts of its
characters change by one in and one out at every step, and so does the sum of n*log2(n) that gives
Shannon's entropy. Sums are whole numbers (in units of 2**-20), so the order of steps cannot change a
verdict. Allowed parts cut a candidate: only windows that touch none of them are judged.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, letters, picked
from .quality_rules import let

SPAN = "array<struct<start:int,kind:int,stop:int>>"
KINDS = ("assign", "access", "hex", "entropy")
UNIT = 1 << 20

# The shapes that are always secrets.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``alphabet`` that hold a match of each of ``needs`` are candidates; a window of
    ``window`` characters is high from ``bits`` of entropy on."""

    run: str
    alphabet: str
    window: int
    bits: float
    needs: tuple[str, ...]


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_HEX = "[0-9A-Fa-f]"
# Where prose, names and addresses do not come near, limits are what 999 in 1,000 random strings of a
# class reach. Runs with marks in them (addresses) have a higher one, and so have letters of one case:
# long words reach 3.80 bits, so limits that find every random string would take words too.
CLASSES = (
    EntropyClass(
        r"[A-Za-z0-9+/=_-]{24,}",
        _UPPER + _LOWER + _DIGITS + "+/=_-",
        24,
        4.05,
        ("[A-Z]", "[a-z]", "[0-9]"),
    ),
    EntropyClass(
        r"[A-Za-z0-9]{20,}", _UPPER + _LOWER + _DIGITS, 20, 3.48, ("[A-Z]", "[a-z]", "[0-9]")
    ),
    EntropyClass(r"[a-z0-9]{20,}", _LOWER + _DIGITS, 20, 3.2, ("[a-z]", "[0-9]")),
    EntropyClass(r"[A-Z0-9]{20,}", _UPPER + _DIGITS, 20, 3.14, ("[A-Z]", "[0-9]")),
    EntropyClass(r"[0-9a-f]{20,}", _DIGITS + "abcdef", 20, 2.73, ("[a-f]", "[0-9]")),
    EntropyClass(r"[0-9A-F]{20,}", _DIGITS + "ABCDEF", 20, 2.73, ("[A-F]", "[0-9]")),
    # Two capitals in a row and two changes of case: names in camel case seldom have both.
    EntropyClass(
        r"[A-Za-z]{20,}", _UPPER + _LOWER, 20, 3.38, ("[A-Z][A-Z]", "[a-z][A-Z].*[a-z][A-Z]")
    ),
    EntropyClass(r"[a-z]{24,}", _LOWER, 24, 3.85, ()),
    EntropyClass(r"[A-Z]{24,}", _UPPER, 24, 3.85, ()),
    EntropyClass(
        f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}",
        _DIGITS + "abcdefABCDEF-",
        36,
        2.9,
        ("[0-9]",),
    ),
)
ALLOWED = ("example", "placeholder", "0123456789", "abcdefghij", "xxxxxx")


def _none() -> Column:
    return F.array().cast(SPAN)


def _span(start: Column, kind: int, stop: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), F.lit(kind).alias("kind"), stop.cast("int").alias("stop")
    )


def _matches(text: Column, pattern: str, kind: int, spans_of) -> Column:
    """Spans that ``spans_of(match, its start, i, all)`` gives for the matches of a pattern.

    Matches and the pieces between them follow each other, so lengths add up to positions.
    """

    def walk(b: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

        def step(a: Column, i: Column) -> Column:
            begin = a["at"] + F.length(b["s"][i])
            return F.struct(
                (begin + F.length(b["m"][i])).cast("int").alias("at"),
                F.concat(a["out"], spans_of(b["m"][i], begin)).alias("out"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(b["m"]) - 1), start, step, lambda a: a["out"])

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.split(text, pattern, -1).alias("s"),
    )
    return F.when(text.rlike(pattern), let(both, walk)).otherwise(_none())


def _base(text: Column, kind: int, pattern: str) -> Column:
    def whole(match: Column, begin: Column) -> Column:
        found = F.array(_span(begin, kind, begin + F.length(match)))
        if kind:
            return found
        value = F.regexp_extract(match, ASSIGN, 2)
        return F.when(F.length(value) >= MIN_ASSIGNED, found).otherwise(_none())

    return _matches(text, pattern, kind, whole)


def _terms(window: int) -> list[int]:
    """n*log2(n) in whole units, for n up to the window."""
    return [0] + [round(n * math.log2(n) * UNIT) for n in range(1, window + 1)]


def high_part(text: Column, how: EntropyClass) -> Column:
    """First and one after the last character of the windows with high entropy, or nulls."""
    terms = F.array(*map(F.lit, _terms(how.window)))
    # entropy = log2(w) - sum/w >= bits
    limit = math.floor((math.log2(how.window) - how.bits) * how.window * UNIT)

    def walk(chars: Column) -> Column:
        zero = F.array_repeat(F.lit(0), len(how.alphabet))
        none = F.lit(None).cast("int")
        start = F.struct(
            zero.alias("c"), F.lit(0).alias("s"), none.alias("lo"), none.alias("hi")
        )

        def step(a: Column, i: Column) -> Column:
            came = chars[i]
            went = F.when(i >= how.window, F.get(chars, i - how.window)).otherwise(-1)
            minus = F.transform(a["c"], lambda n, j: n - F.when(j == went, 1).otherwise(0))
            left = a["s"] + F.when(
                went >= 0, _term(F.get(a["c"], went) - 1) - _term(F.get(a["c"], went))
            ).otherwise(0)

            def add(c: Column) -> Column:
                total = (left + _term(c[came] + 1) - _term(c[came])).cast("int")
                high = (i >= how.window - 1) & (total <= limit)
                return F.struct(
                    F.transform(c, lambda n, j: n + F.when(j == came, 1).otherwise(0)).alias("c"),
                    total.alias("s"),
                    F.when(high, F.coalesce(a["lo"], i - (how.window - 1)))
                    .otherwise(a["lo"])
                    .alias("lo"),
                    F.when(high, i + 1).otherwise(a["hi"]).alias("hi"),
                )

            return let(minus, add)

        def _term(n: Column) -> Column:
            return F.get(terms, n)

        return F.aggregate(
            F.sequence(F.lit(0), F.size(chars) - 1),
            start,
            step,
            lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")),
        )

    numbers = F.transform(
        F.split(text, ""), lambda x: (F.instr(F.lit(how.alphabet), x) - 1).cast("int")
    )
    return let(numbers, walk)


def without_allowed(text: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Blanks in place of allowed parts, in either case, one kind after the other."""
    blank = text
    for part in allowed:
        blank = F.regexp_replace(blank, f"(?i){re.escape(part)}", " " * len(part))
    any_part = "|".join(map(re.escape, allowed))
    return F.when(text.rlike(f"(?i){any_part}"), blank).otherwise(text) if allowed else text


def _entropy(text: Column, how: EntropyClass) -> Column:
    def spans(match: Column, begin: Column) -> Column:
        wanted = F.lit(True)
        for need in how.needs:
            wanted = wanted & match.rlike(need)
        part = let(
            high_part(match, how),
            lambda p: F.when(
                p["lo"].isNotNull(),
                F.array(_span(begin + p["lo"], len(KINDS) - 1, begin + p["hi"])),
            ).otherwise(_none()),
        )
        return F.when(wanted, part).otherwise(_none())

    return _matches(text, how.run, len(KINDS) - 1, spans)


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.sort_array(spans), lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"], x["stop"])
        ),
        ",",
    )


def with_spans(
    docs: DataFrame,
    text_col: str = "text",
    classes: tuple[EntropyClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
    base_name: str = "base_spans",
    all_name: str = "all_spans",
    meeting: bool = False,
) -> DataFrame:
    """Add two arrays of (start, kind, stop), in code points: the spans of fixed shapes, and those
    with what spans of high entropy have beside them, or with all of those if ``meeting``. Columns
    of the caller that have these two names are replaced.

    A null text counts as empty and has no spans. Kinds are positions in KINDS.
    """
    rows = boxed(docs.drop(base_name, all_name), text=letters(F.col(f"`{text_col}`")))
    text, plain = F.col("text"), F.col("plain")
    rows = rows.select("row", "text", without_allowed(text, allowed).alias("plain"))
    base = F.concat(*[_base(text, k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX))])
    found = F.array_distinct(F.concat(*[_entropy(plain, c) for c in classes]))
    rows = rows.select("row", F.sort_array(base).alias("base"), found.alias("found"))

    def beside(e: Column) -> Column:
        """The pieces of a span that the sorted base spans leave."""

        def step(a: Column, b: Column) -> Column:
            piece = F.array(_span(a["at"], len(KINDS) - 1, b["start"]))
            return F.struct(
                F.greatest(a["at"], b["stop"]).alias("at"),
                F.concat(a["out"], F.when(a["at"] < b["start"], piece).otherwise(_none())).alias("out"),
            )

        def rest(a: Column) -> Column:
            last = F.array(_span(a["at"], len(KINDS) - 1, e["stop"]))
            return F.concat(a["out"], F.when(a["at"] < e["stop"], last).otherwise(_none()))

        met = F.filter("base", lambda b: (b["start"] < e["stop"]) & (e["start"] < b["stop"]))
        start = F.struct(e["start"].alias("at"), _none().alias("out"))
        return F.aggregate(met, start, step, rest)

    high = F.col("found")
    more = high if meeting else F.array_distinct(F.flatten(F.transform(high, beside)))
    every = F.sort_array(F.concat("base", more))
    return rows.select("row.*", F.col("base").alias(base_name), every.alias(all_name))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row, in any order.

    Without spans the counts are 0, spans is empty and the digest is that of an empty text. Repeated
    rows give repeated results, other columns are not carried, no rows give no rows.
    """
    rows = with_spans(picked(docs, doc_id=id_col, text=text_col))
    base = F.col("base_spans")

    def count(kind: int) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint")

    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("all_spans")).alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """Put ``mark`` in place of every secret; other texts stay as they are, null ones null.

    Spans that overlap get one mark, so what a span of high entropy has beside a fixed shape goes too.
    """
    rows = with_spans(boxed(docs, text=text_col), meeting=True)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        before = F.substring(text, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        put = F.when(x["start"] >= a["at"], F.concat(a["out"], before, F.lit(mark)))
        return F.struct(
            F.greatest(a["at"], x["stop"]).alias("at"), put.otherwise(a["out"]).alias("out")
        )

    cleaned = F.aggregate(
        F.col("all_spans"),
        start,
        step,
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    changed = F.when(F.size("all_spans") > 0, cleaned).otherwise(text)
    return rows.select(F.col("row").withField(f"`{text_col}`", changed).alias("row")).select("row.*")
