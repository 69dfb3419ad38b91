"""Vector codes by product quantisation: Lloyd's rounds over members that stay with their owners.

A vector is cut into equal parts, and every position has a codebook. The part of a vector is a member of
one entry; rows are dealt once by owner ``(position, entry, salt)`` and written. An entry's mean is formed
where its members lie, and after each round only members whose entry changed are shuffled, to the owner
of their new entry. All arithmetic is in integers, so results are the same however rows are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_unique
from .common import materialise, release, scratch

#: Parts of a vector, entries of a codebook, rounds, and the factor that turns components into integers.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are held between these bounds once scaled, so that squared distances fit a long.
MOST = 1 << 27


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` its nearest row of ``book``, the first of equals, and the squared distance: exact integers."""
    most = int(max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * max(book.shape[1], 1) < 1 << 53:  # then doubles hold every sum exactly
        x, c = parts.astype(np.float64), book.astype(np.float64)
    else:
        x, c = parts.astype(object), book.astype(object)
    far = (x * x).sum(axis=1)[:, None] - 2 * x.dot(c.T) + (c * c).sum(axis=1)[None, :]
    entry = far.argmin(axis=1)
    return entry, far[np.arange(len(far)), entry].astype(np.int64)


def _assigned(state: DataFrame, books: np.ndarray, salts: np.ndarray) -> DataFrame:
    """``state`` with ``now``: the nearest entry of each part, its squared distance, and the salt of its owner."""
    shared = state.sparkSession.sparkContext.broadcast((books, salts))

    @F.pandas_udf("entry int, error long, salt int")
    def assign(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        books, salts = shared.value
        for row, pos, part in batches:
            entry, error = np.zeros(len(pos), dtype=np.int32), np.zeros(len(pos), dtype=np.int64)
            at, spread = pos.to_numpy(), row.to_numpy()
            for p in np.unique(at).tolist():
                mine = np.flatnonzero(at == p)
                entry[mine], error[mine] = nearest(np.stack(part.iloc[mine].to_list()).astype(np.int64), books[p])
            yield pd.DataFrame({"entry": entry, "error": error, "salt": (spread % salts[at, entry]).astype(np.int32)})

    return state.withColumn("now", assign("_spread", "pos", "part"))


def _updated(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means of the members that each entry has, and their numbers; an entry without members stays as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, total = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for b in batches:
            if len(b):
                at = (b["pos"].to_numpy(), b["entry"].to_numpy())
                np.add.at(number, at, 1)
                np.add.at(total, at, np.stack(b["part"].to_list()).astype(np.int64))
        pos, entry = np.nonzero(number)
        yield pd.DataFrame({"pos": pos, "entry": entry, "n": number[pos, entry], "sums": list(total[pos, entry])})

    # an owner's members lie in few tasks, so a task has few entries to report
    own = state.select("pos", "entry", "part").mapInPandas(run, "pos int, entry int, n long, sums array<long>")
    found = own.select("pos", "entry", "n", F.posexplode("sums").alias("i", "s")).groupBy("pos", "entry", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()  # a codebook's size
    number, out = np.zeros(books.shape[:2], dtype=np.int64), books.copy()
    at = (found["pos"].to_numpy(dtype=np.int64), found["entry"].to_numpy(dtype=np.int64))
    number[at] = found["n"].to_numpy(dtype=np.int64)
    out[*at, found["i"].to_numpy(dtype=np.int64)] = found["s"].to_numpy(dtype=np.int64) // found["n"].to_numpy(dtype=np.int64)
    return out, number


def _salts(number: np.ndarray, partitions: int) -> np.ndarray:
    """How many owners share an entry: so many that none holds more than its share of the rows of a partition."""
    return np.maximum(1, -(-number * partitions // max(int(number.sum()), 1)))


def _whole(vector: Column, parts: int) -> Column:
    """Whether a vector can be cut: not null or empty, of a length that the parts divide, of finite components."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.forall(vector, sound), F.lit(False))


def codebooks_text(books: np.ndarray) -> str:
    """All components by part, entry and position, joined by commas."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """``(id_col, label_col, code, error, label_error, codebooks_sha256)``: one row per row of ``vectors`` that can be cut.

    Components become ``floor(scale * x)``, held within 2**27. A codebook starts as the parts of the ``entries`` smallest
    ids (all, if there are fewer); each round assigns every part to its nearest entry, the first of equals, and replaces an
    entry by the floor of its members' mean. code holds the final entries in hexadecimal digits, error their squared
    distances, label_error the sum of errors of all rows of the same label (null beyond a long).

    Rows whose vector is null, empty, of a length that ``parts`` does not divide, or with a null or non-finite component give
    no row; neither do vectors of another length than that of the smallest id. Null ids count as the largest, equal ids are
    ordered by their vectors, repeated rows each get their row, null labels are one label, other columns are not read, and
    an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    held = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int")
    ints = F.transform(F.col(vector_col), held)
    kept = vectors.where(_whole(F.col(vector_col), parts)).select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), ints.alias("v"))
    with scratch() as keep:
        kept = materialise(kept, "codes-vectors")
        smallest = lambda rows: [r["v"] for r in rows.orderBy(F.asc_nulls_last("_id"), "v").limit(entries).select("v").collect()]
        first = smallest(kept)
        if first and any(len(v) != len(first[0]) for v in first):
            first = smallest(kept.where(F.size("v") == len(first[0])))
        size = len(first[0]) if first else parts
        books = np.array(first, dtype=np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2)
        cut = F.explode(F.array(*(F.struct(F.lit(p).alias("pos"), F.slice("v", p * size // parts + 1, size // parts).alias("part")) for p in range(parts))))
        flat = kept.where(F.size("v") == size).select("_row", "_id", "_label", cut.alias("p"))
        once = lambda c: F.when(F.col("p.pos") == 0, F.col(c)).alias(c)  # noqa: E731  the first part carries what belongs to the row
        flat = flat.select("_row", F.pmod(F.xxhash64("_row"), F.lit(1 << 31)).alias("_spread"), once("_id"), once("_label"), "p.pos", "p.part")
        partitions, fields = int(spark.conf.get("spark.sql.shuffle.partitions")), ("_row", "_spread", "_id", "_label", "pos", "part")
        current = lambda rows: rows.select(*fields, "now.entry", "now.salt")
        one = np.ones(books.shape[:2], dtype=np.int64)
        number = one * 0
        for r in (_assigned(flat, books, one).groupBy("pos", "now.entry").count().collect() if first else ()):  # a row an entry
            number[r["pos"], r["entry"]] = r["count"]
        state = materialise(current(_assigned(flat, books, _salts(number, partitions))).repartition("pos", "entry", "salt"), "codes-members")
        for k in range(rounds if first else 0):
            books, number = _updated(state, books)
            if k + 1 < rounds:
                moved = _assigned(state.withColumnsRenamed({"entry": "_entry", "salt": "_salt"}), books, _salts(number, partitions))
                stay = moved.where("now.entry = _entry").select(*fields, F.col("_entry").alias("entry"), F.col("_salt").alias("salt"))
                after = materialise(stay.unionByName(current(moved.where("now.entry <> _entry")).repartition("pos", "entry", "salt")), "codes-members")
                release(state)
                state = after
        digits = max(2, len(f"{entries - 1:x}"))
        coded = _assigned(state.drop("entry", "salt"), books, one).withColumn("hex", F.lower(F.lpad(F.hex("now.entry"), digits, "0")))
        code = F.concat(*(F.max(F.when(F.col("pos") == p, F.col("hex"))) for p in range(parts)))
        codes = coded.groupBy("_row").agg(F.max("_id").alias(id_col), F.max("_label").alias(label_col), code.alias("code"), F.sum("now.error").alias("error"))
        label = F.col(label_col)
        codes = materialise(codes.drop("_row").withColumn("_known", label.isNotNull()).withColumn("_name", F.coalesce(label.cast("string"), F.lit(""))), "codes")
        sums = materialise(codes.groupBy("_known", "_name").agg(F.expr("try_sum(error)").alias("label_error"), F.count("*").alias("_rows")), "codes-labels")
        keep += [codes, sums]
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    out = join_unique(codes, sums, ["_known", "_name"], "_rows")
    return out.select(id_col, label_col, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
