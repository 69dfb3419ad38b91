"""Secret scans by linking the parts of multipart credentials; DataFrame expressions only.

Access identifiers, secrets and endpoints are found by patterns. Strong spans are reported as
they are. Weak ones (a short secret, an identifier of a user, an endpoint) are reported only if a
complementary part lies within the same scope, which an interval join over scope-wide bins finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Code points around a weak span within which a complementary part counts.
SCOPE = 256

_VALUE = r"[A-Za-z0-9+/_.=-]"
#: (kind, pattern, group whose length counts, least length for the strong kind); the first three are the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(""" + _VALUE + "+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENT = r"""(?i:access_?key_?id|client_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]{3,})"""
ENDPOINT = r"(?i:https?|ftp|sftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@/?=&%+-]{4,}"

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "short", "ident", "endpoint")
BASE_KINDS = 3
MIN_ASSIGN, MIN_SHORT = 12, 4
#: The part that each kind plays, and the parts that make a weak kind reportable.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "short": "secret", "ident": "id", "endpoint": "endpoint"}
NEEDS = {"short": ("id", "endpoint"), "ident": ("secret",), "endpoint": ("secret",)}


def _found(text: Column, pattern: str, may: Column, value_group: int = 0) -> Column:
    """Array of (gap, size, value): lengths of the text before a match, of the match, of its group."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), F.length) if value_group else sizes
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), values.alias("value")), lambda x: x["size"].isNotNull())
    none = F.array().cast("array<struct<gap:int,size:int,value:int>>")
    return F.when(may & F.rlike(text, F.lit(pattern)), rows).otherwise(none)


def _parts(text: Column) -> Column:
    """Array over patterns; a pattern can only match where its literal characters occur, which is asked first."""
    eq = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return F.array(
        _found(text, ASSIGN, eq, 2),
        _found(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        _found(text, HEX, F.lit(True)),
        _found(text, IDENT, eq, 1),
        _found(text, ENDPOINT, F.contains(text, F.lit("://"))),
    )


def _located(rows: DataFrame) -> DataFrame:
    """``(key..., kind, role, start, end)`` of all strong and weak spans of distinct texts."""
    each = rows.select("_id", "_hash", F.posexplode("_parts").alias("pattern", "found")).select("_id", "_hash", "pattern", F.posexplode("found").alias("i", "at"))
    run = Window.partitionBy("_id", "_hash", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("at.gap") + F.col("at.size")).over(run)
    kind = (
        F.when((F.col("pattern") == 0) & (F.col("at.value") >= MIN_ASSIGN), 0)
        .when((F.col("pattern") == 0) & (F.col("at.value") >= MIN_SHORT), 3)
        .when(F.col("pattern").isin(1, 2), F.col("pattern"))
        .when(F.col("pattern").isin(3, 4), F.col("pattern") + 1)
    )
    spans = each.withColumn("end", end).select("_id", "_hash", kind.alias("kind"), (F.col("end") - F.col("at.size")).alias("start"), "end")
    role = F.element_at(F.array(*(F.lit(ROLE[k]) for k in KINDS)), F.col("kind") + 1)
    return spans.where(F.col("kind").isNotNull()).withColumn("role", role)


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """Weak spans that have a complementary part within ``scope`` code points: an interval semi-join.

    Both sides are dealt to bins as wide as the scope, so a bin of a text holds a bounded number of
    spans and an equality on text and bin precedes the comparison of the intervals.
    """
    wide = F.lit(scope)
    parts = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / wide), F.floor((F.col("end") - 1) / wide))))
    parts = parts.select(F.col("_id").alias("p_id"), F.col("_hash").alias("p_hash"), "bin", F.col("role").alias("p_role"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    weak = spans.where(F.col("kind") >= BASE_KINDS).withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - wide) / wide), F.floor((F.col("end") + wide - 1) / wide))))
    complement = F.lit(False)
    for kind, needs in NEEDS.items():
        complement = complement | ((F.col("kind") == KINDS.index(kind)) & F.col("p_role").isin(*needs))
    near = (F.col("p_start") < F.col("end") + wide) & (F.col("p_end") > F.col("start") - wide)
    on = weak["_id"].eqNullSafe(parts["p_id"]) & (weak["_hash"] == parts["p_hash"]) & (weak["bin"] == parts["bin"]) & near & complement
    return weak.join(parts, on, "left_semi").select("_id", "_hash", "kind", "start", "end")


def credential_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``(id_col, text_hash, spans)``, one row per row of ``docs``.

    spans is an array of ``(start, kind, end)`` in code points, sorted by start, then by the place
    of the kind in :data:`KINDS`, then by end. Base spans always stay; weak ones are linked. A null
    text counts as empty and has no span. Repeated rows are searched once and each get the result;
    rows of one id with different texts are told apart by the text's hash. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialise(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), _parts(text).alias("_parts")), "secrets")
    some = rows.where(F.exists("_parts", lambda x: F.size(x) > 0)).dropDuplicates(["_id", "_hash"])
    spans = materialise(_located(some), "secret-spans")
    every = spans.where(F.col("kind") < BASE_KINDS).select("_id", "_hash", "kind", "start", "end").unionByName(_linked(spans, scope))
    found = every.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("spans"))
    found = found.withColumnsRenamed({"_id": "f_id", "_hash": "f_hash"})
    keys = rows.select("_id", "_hash")
    out = keys.join(found, keys["_id"].eqNullSafe(found["f_id"]) & (keys["_hash"] == found["f_hash"]), "left")
    none = F.array().cast(found.schema["spans"].dataType)
    return out.select(F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"), F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*(F.lit(x) for x in KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", length_col: str | None = None) -> DataFrame:
    """``docs`` with each reported span of its text replaced by ``mark``; overlapping spans by one mark.

    No row goes. Only texts in which a part was found travel through the join. ``length_col``, if
    given, gets the new length of a changed text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = credential_spans(docs, id_col, text_col).where(F.size("spans") > 0).dropDuplicates([id_col, "text_hash"])
    found = found.select(F.col(id_col).alias("_f_id"), F.col("text_hash").alias("_f_hash"), F.col("spans").alias("_spans"))
    has = F.exists(_parts(text), lambda x: F.size(x) > 0)
    whole = docs.where(has).select(F.col(id_col).alias("_k_id"), F.xxhash64(text).alias("_k_hash"), F.struct("*").alias("_doc"))  # names of other columns cannot clash
    joined = whole.join(found, F.col("_k_id").eqNullSafe(F.col("_f_id")) & (F.col("_k_hash") == F.col("_f_hash")), "left")
    own = F.col("_doc").getField(text_col)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(acc["out"], F.substring(own, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(piece.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(own, acc["at"] + 1, F.length(own))))
    untouched = F.col("_spans").isNull()
    values = {c: F.col("_doc").getField(c) for c in docs.columns}
    values[text_col] = F.when(untouched, own).otherwise(clean)
    if length_col:
        kind = docs.schema[length_col].dataType
        values[length_col] = F.when(untouched, values[length_col]).otherwise(F.length(values[text_col]).cast(kind))
    return joined.select(*(v.alias(c) for c, v in values.items())).unionByName(docs.where(~has))
