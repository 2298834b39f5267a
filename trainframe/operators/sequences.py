"""Token streams, time-unrolled windows, masked batches and sentence pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainframe.operators.position import hash_position, prefix_sum, seeded_draw, seeded_key


def token_stream(df: DataFrame, id_col: str, tokens: str = "tokens") -> DataFrame:
    """Concatenate all rows' tokens in id order: (stream_pos, token, n). Texts are exploded after placing."""
    placed = prefix_sum(df.select(id_col, tokens), id_col, F.size(tokens).cast("bigint"), out="_start", total="n")
    each = placed.select("_start", "n", F.posexplode(tokens).alias("_i", "token"))
    return each.select((F.col("_start") + F.col("_i")).alias("stream_pos"), "token", "n")


def rescaled_start(current: Column, old_len: Column, new_len: Column) -> Column:
    """Where to go on after the stream was reshaped: the same covered share of the new length, rounded up."""
    return F.when(old_len == 0, current).otherwise(F.ceil(current * new_len / old_len))


def _pieces(stream: DataFrame) -> DataFrame:
    """The stream as pieces (start, ids, n); a stream with a row per token has pieces of one token."""
    if "ids" in stream.columns:
        return stream.select("start", F.col("ids").cast("array<bigint>").alias("ids"), "n").filter(F.size("ids") > 0)
    return stream.select(F.col("stream_pos").alias("start"), F.array(F.col("token_id").cast("bigint")).alias("ids"), "n")


def _between(first: Column, last: Column) -> Column:
    """Whole numbers first..last, none if last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _part(ids: Column, start: Column, lo: Column, hi: Column) -> Column:
    """Tokens of a piece from stream place lo up to, not including, hi."""
    return F.slice(ids, (lo - start + 1).cast("int"), (hi - lo).cast("int"))


def reshape_columns(stream: DataFrame, columns: int, pad_id: int) -> DataFrame:
    """Cut the stream into ``columns`` equal columns, the last one padded: slices (row, col, ids, length).

    A slice is the part of one piece of the stream that lies in one column, from ``row`` on. The stream is pieces
    (start, ids, n) or a row per token (stream_pos, token_id, n).
    """
    length = F.ceil(F.col("n") / columns).cast("bigint")
    missing = (length * columns - F.col("n")).cast("int")
    ends = F.col("start") + F.size("ids") == F.col("n")
    pads = F.array_repeat(F.lit(pad_id).cast("bigint"), missing)
    p = _pieces(stream).withColumn("ids", F.when(ends, F.concat("ids", pads)).otherwise(F.col("ids"))).withColumn("length", length)
    stop = F.col("start") + F.size("ids")

    def cell(c: Column) -> Column:
        lo, hi = F.greatest("start", c * F.col("length")), F.least(stop, (c + 1) * F.col("length"))
        return F.struct((lo - c * F.col("length")).alias("row"), c.alias("col"), _part(F.col("ids"), F.col("start"), lo, hi).alias("ids"))

    cols = F.sequence(F.floor(F.col("start") / F.col("length")), F.floor((stop - 1) / F.col("length")))
    # the slices are built as one array before they become rows, so no row carries the whole piece
    return p.select("length", F.explode(F.transform(cols, cell)).alias("_c")).select("_c.row", "_c.col", "_c.ids", "length")


def bptt_windows(slices: DataFrame, bptt: int, replicas: int, current: int = 0) -> DataFrame:
    """(rank, iteration, col, text, target): consecutive windows dealt to ranks, equal steps per rank.

    A window reads bptt cells and one more, the last target, which is also the first cell of the next window. From the
    rows it covers a slice tells which windows it touches and gives each its part; parts of a window are put together in
    order. Rows shuffled are slices times windows touched, not tokens.
    """
    step = bptt * replicas
    highest = current + bptt * (replicas - 1)
    steps = F.greatest(F.ceil((F.col("length") - highest) / step), F.lit(0)).cast("bigint")
    stop = F.col("row") + F.size("ids")
    first = F.greatest(F.ceil((F.col("row") - current - bptt) / bptt), F.lit(0)).cast("bigint")  # its last target is in the slice, or later cells are
    last = F.least(F.floor((stop - 1 - current) / bptt), steps * replicas - 1).cast("bigint")

    def part(seg: Column) -> Column:
        lo = F.greatest(F.col("row"), current + seg * bptt)
        hi = F.least(stop, current + (seg + 1) * bptt + 1)
        return F.struct(seg.alias("seg"), lo.alias("row"), _part(F.col("ids"), F.col("row"), lo, hi).alias("ids"))

    parts = slices.select("col", F.explode(F.transform(_between(first, last), part)).alias("_p")).select("col", "_p.seg", F.struct("_p.row", "_p.ids").alias("_p"))
    out = parts.groupBy("col", "seg").agg(F.flatten(F.sort_array(F.collect_list("_p"))["ids"]).alias("_w"))
    n = F.size("_w") - 1
    return out.filter(n > 0).select(
        (F.col("seg") % replicas).alias("rank"),
        F.floor(F.col("seg") / replicas).alias("iteration"),
        "col",
        F.slice("_w", 1, n).alias("text"),
        F.slice("_w", 2, n).alias("target"),
    )


def masked_batches(
    stream: DataFrame, batch_size: int, bptt: int, mask_frac: float, mask_id: int, cls_id: int, seed: int = 0
) -> DataFrame:
    """One row per batch row: (batch_id, row, ids, masked, target).

    A batch is a chunk of batch_size * bptt tokens viewed as bptt columns. Exactly
    int(batch_size * mask_frac) of its rows are masked whole; row 0 is the class token and never masked.
    The stream is pieces (start, ids, n) or a row per token; a piece gives each batch it covers one slice.
    """
    size = batch_size * bptt
    chosen = int(batch_size * mask_frac)
    p = _pieces(stream)
    whole = F.floor(F.col("n") / size) * size
    stop = F.least(F.col("start") + F.size("ids"), whole)

    def part(b: Column) -> Column:
        lo, hi = F.greatest("start", b * size), F.least(stop, (b + 1) * size)
        return F.struct(b.alias("batch_id"), lo.alias("start"), _part(F.col("ids"), F.col("start"), lo, hi).alias("ids"))

    covered = _between(F.floor(F.col("start") / size), F.floor((stop - 1) / size))
    parts = p.filter(F.col("start") < whole).select(F.explode(F.transform(covered, part)).alias("_p")).select("_p.batch_id", F.struct("_p.start", "_p.ids").alias("_p"))
    batches = parts.groupBy("batch_id").agg(F.flatten(F.sort_array(F.collect_list("_p"))["ids"]).alias("flat"))  # `size` tokens each
    rows = F.sequence(F.lit(0), F.lit(batch_size - 1))
    drawn = F.array_sort(F.transform(rows, lambda r: F.struct(seeded_key(seed, F.col("batch_id"), r).alias("h"), r.alias("r"))))
    picked = F.slice(F.transform(drawn, lambda x: x["r"]), 1, chosen)
    line = F.transform(F.sequence(F.lit(0), F.lit(bptt - 1)), lambda c: F.element_at("flat", (c * batch_size + F.col("_r") + 1).cast("int")))
    # Row -1 of the explode becomes the class row, so that the batches are built once.
    each = F.sequence(F.lit(-1), F.lit(batch_size - 1))
    plain = batches.withColumn("_picked", picked).withColumn("_r", F.explode(each))
    cls = F.col("_r") < 0
    plain = plain.select(
        "batch_id", (F.col("_r") + 1).alias("row"), F.when(~cls, line).alias("target"), F.array_contains("_picked", F.col("_r")).alias("masked")
    )
    same = [F.array_repeat(F.lit(i).cast("bigint"), bptt) for i in (cls_id, mask_id)]
    return plain.select(
        "batch_id",
        "row",
        F.when(F.col("row") == 0, same[0]).when(F.col("masked"), same[1]).otherwise(F.col("target")).alias("ids"),
        "masked",
        F.when(F.col("masked"), F.col("target")).alias("target"),
    )


def sentence_halves(df: DataFrame, key: list[str], ids: str = "ids", seed: int = 0) -> DataFrame:
    """Split rows of more than one token at a uniform place in 1..len-1: adds ``first``, ``second``."""
    cut = (seeded_draw(seed, *key) % (F.size(ids) - 1) + 1).cast("int")
    cuts = df.filter(F.size(ids) > 1).withColumn("_cut", cut)
    return cuts.select(
        *key, F.slice(ids, 1, F.col("_cut")).alias("first"), F.slice(F.col(ids), F.col("_cut") + 1, F.size(ids)).alias("second")
    )


def sentence_pairs(halves: DataFrame, key: list[str], frac: float, seed: int = 0) -> DataFrame:
    """For int(n * frac) rows, put another row's first half in place of the second half, label 0; else label 1.

    Rows are matched through two seeded orders of all rows; a row can meet itself.
    """
    left = hash_position(halves, seeded_key(f"{seed}.left", *key), key, out="_at", total="_n")
    right = hash_position(halves.select(*key, "first"), seeded_key(f"{seed}.right", *key), key, out="_at", total="_n")
    quota = F.floor(F.col("_n") * F.lit(frac))
    donors = right.filter(F.col("_at") < quota).select("_at", F.col("first").alias("_other"))
    joined = left.join(donors, "_at", "left")
    swapped = F.col("_other").isNotNull()
    return joined.select(
        *key, "first", F.coalesce("_other", "second").alias("second"), F.when(swapped, 0).otherwise(1).alias("label")
    )


def encode_pairs(pairs: DataFrame, bptt: int, cls_id: int, sep_id: int, pad_id: int) -> DataFrame:
    """Add ``ids`` and ``types`` of length bptt + 1: class token, first, separator, second, separator, padding.

    Types are 0 up to the first separator and 1 after it, padding included.
    """
    sep = F.array(F.lit(sep_id).cast("bigint"))
    joined = F.slice(F.concat("first", sep, "second", sep), 1, bptt)
    pads = F.array_repeat(F.lit(pad_id).cast("bigint"), F.greatest(F.lit(bptt) - F.size(joined), F.lit(0)))
    zeros = F.least(F.size("first") + 1, F.lit(bptt)) + 1
    return pairs.withColumn("ids", F.concat(F.array(F.lit(cls_id).cast("bigint")), joined, pads)).withColumn(
        "types", F.concat(F.array_repeat(F.lit(0), zeros), F.array_repeat(F.lit(1), F.lit(bptt + 1) - zeros))
    )
