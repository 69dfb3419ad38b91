"""Scalar expressions: ratios, scales, periods, names, and text rules."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The legal suffixes that a stem drops.
LEGAL_SUFFIXES = ("co", "company", "corp", "corporation", "group", "holding", "holdings", "inc", "incorporated", "limited", "llc", "ltd", "plc")


def safe_ratio(n: Column, d: Column, positive: bool = True) -> Column:
    """Null for a null, a zero, or (unless allowed) a negative denominator."""
    return F.when((d > 0) if positive else (d != 0), n / d)


def safe_growth(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before) / F.abs(before))


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, dict[str, str]]:
    """By the rule of Unicode, for code points up to U+2FFF and of the presentation forms: letters and the one that stands for each, marks to drop last; and those that become several."""
    one, drop, several = {}, "", {}
    for cp in (*range(0x80, 0x3000), *range(0xFB00, 0xFB50), *range(0xFF00, 0xFFF0)):
        c = chr(cp)
        plain = "".join(x for x in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).casefold()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            one[c] = plain
        elif not plain:
            drop += c
        elif len(plain) > 1:
            several[c] = plain
    return "".join(one) + drop, "".join(one.values()), several


def fold(text: Column) -> Column:
    """Compatibility decomposition without marks, and full case folding: ``Straße`` and ``STRASSE``, ``ﬁ`` and ``fi`` are one."""
    letters, plain, several = _foldings()
    each = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    found = F.rlike(text, F.lit("[" + "".join(several) + "]"))
    spell = lambda c: F.when(c < F.lit("\u0080"), c).otherwise(F.coalesce(F.try_element_at(each, c), c))  # noqa: E731  # the map is searched entry by entry
    spelt = F.when(found, F.array_join(F.transform(F.split(text, ""), spell), "")).otherwise(text)
    return F.lower(F.translate(spelt, letters, plain))


def normalize_name(name: Column) -> Column:
    """Decomposed, folded, letters and digits only."""
    return F.regexp_replace(fold(name), r"[^\p{L}\p{N}]", "")


def name_stem(name: Column, suffixes: Sequence[str] = LEGAL_SUFFIXES) -> Column:
    """A normalised name without a leading or trailing "the", a share class, and legal suffixes."""
    plain = F.trim(F.regexp_replace(fold(name), r"[^\p{L}\p{N}]+", " "))
    plain = F.regexp_replace(plain, r"^the | the$| class [a-z]$", "")
    plain = F.regexp_replace(plain, f"( ({'|'.join(suffixes)}))+$", "")
    return F.regexp_replace(plain, " ", "")


def normalize_ticker(ticker: Column) -> Column:
    return F.translate(F.upper(F.trim(ticker)), ".", "-")


def nearest_month_end(day: Column) -> Column:
    """The month end nearest to a day; of two equally near ones the earlier."""
    own, before = F.last_day(day), F.last_day(F.add_months(day, -1))
    return F.when(F.datediff(day, before) <= F.datediff(own, day), before).otherwise(own)


def quarter_count(start: Column, end: Column) -> Column:
    """Quarters in a period, half up; null outside 1..4."""
    n = F.floor(F.datediff(end, start) * 4 / 365.25 + 0.5).cast("int")
    return F.when(n.between(1, 4), n)


def calendar_quarter_end(day: Column, days: int = 45) -> Column:
    """The quarter end within ``days`` of a day, else null."""
    start = F.date_trunc("quarter", day).cast("date")
    before, after = F.date_sub(start, 1), F.date_sub(F.add_months(start, 3), 1)
    near = F.when(F.datediff(day, before) <= F.datediff(after, day), before).otherwise(after)
    return F.when(F.abs(F.datediff(day, near)) <= days, near)


def linear_scale(value: Column, low: float, high: float) -> Column:
    """0 at ``low``, 100 at ``high``, held between; a lower ``high`` inverts."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), (value - low) / (high - low) * 100)))


def deflate(nominal: Column, index_then: Column, index_now: Column) -> Column:
    return F.when(index_then > 0, nominal * index_now / index_then)


def real_rate(nominal: Column, inflation: Column) -> Column:
    return (1 + nominal) / (1 + inflation) - 1


def valid_unit(unit: Column) -> Column:
    """A share word or a three-letter currency."""
    return F.lower(unit).isin("shares", "share") | F.rlike(unit, F.lit("^[A-Z]{3}$"))


def document_text(html: Column, limit: int | None = None) -> Column:
    """Visible text of HTML: without scripts, styles and tags, blank lines collapsed; with ``limit``, so many characters at most."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    bare = F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\r]+", " ")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    text = F.array_join(lines, "\n")
    return text if limit is None else F.left(text, F.lit(limit))


def keyword_sentiment(text: Column, good: Sequence[str], bad: Sequence[str]) -> Column:
    """Good keywords that occur less bad ones."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in good), F.lit(0)) - sum((F.contains(low, F.lit(w)).cast("int") for w in bad), F.lit(0))


def phrase_without_negation(text: Column, phrase: str, negations: str, window: int = 300) -> Column:
    """Whether an occurrence of a phrase has no negation within ``window`` characters on either side; every occurrence is asked."""
    parts = F.split(F.lower(text), phrase, -1)
    n = F.size(parts)
    clear = lambda i: ~F.rlike(F.concat(F.right(F.get(parts, i), F.lit(window)), F.lit(" "), F.left(F.get(parts, i + 1), F.lit(window))), F.lit(negations))
    return F.when(n < 2, False).otherwise(F.exists(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), clear))


def item_value(items: Column, codes: Sequence[str], code: str = "item_code", value: str = "value") -> Column:
    """The value of the first item with one of the codes."""
    return F.get(F.filter(items, lambda x: x[code].isin(*codes)), 0)[value]


def reasons(gates: Sequence[tuple[Column, str]]) -> Column:
    """Names of the gates that do not hold; an unknown gate does not."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in gates)))


def content_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("<NULL>")) for p in parts)), 256)


def rotation_start(day: Column, anchor: Column, weeks: int) -> Column:
    """First day of the rotation of ``weeks`` weeks since ``anchor`` that holds a day."""
    span = weeks * 7
    return F.date_add(anchor, (F.floor(F.datediff(day, anchor) / span) * span).cast("int"))


def parse_grouped_number(text: Column) -> Column:
    """A number with dots between thousands and a comma before decimals."""
    return F.translate(F.regexp_replace(text, r"\.", ""), ",", ".").try_cast("double")


def peg_score(peg: Column) -> Column:
    """100 up to 0.5, falling by pieces to 0 from 3 on; null or not positive: null."""
    piece = lambda a, b, hi, lo: hi - (peg - a) / (b - a) * (hi - lo)
    return F.when(peg <= 0, None).when(peg <= 0.5, 100.0).when(peg <= 1, piece(0.5, 1, 100, 75)).when(peg <= 2, piece(1, 2, 75, 25)).when(peg <= 3, piece(2, 3, 25, 0)).when(peg > 3, 0.0)
