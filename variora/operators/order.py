"""Order-dependent operators: positions, carried markers, islands, passage windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variora.functions.text import collapse, words
from variora.operators.linking import numbered
from variora.storage import materialise


def positions(rows: DataFrame, keys: list[str], order: str, name: str = "position") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def carry_forward(rows: DataFrame, keys: list[str], order: str, marker: str) -> DataFrame:
    return rows.withColumn(marker, F.last(marker, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows with the number of their run of equal consecutive values."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _flow(sizes: list[int], held: int, target: int, most: int) -> tuple[list[int], int]:
    """(windows ended before each passage is in one, words held at the end): one pass over
    passages that come after ``held`` words of an open window."""
    number, out = 0, []
    for n in sizes:
        if held and held + n > most:
            number, held = number + 1, 0
        out.append(number)
        held += n
        if held >= target:
            number, held = number + 1, 0
    return [*out, number], held


def _outcomes(sizes: list[int], target: int, most: int) -> tuple[list[int], list[int]]:
    """(windows ended, words held at the end) for each number of words, below ``target``, that
    may be held at the beginning. Different beginnings soon agree and go on as one."""
    held = np.arange(target)
    ended = np.zeros(target, np.int64)
    for i, n in enumerate(sizes):
        full = (held > 0) & (held + n > most)
        ended += full
        held = np.where(full, 0, held) + n
        ended += held >= target
        held = np.where(held >= target, 0, held)
        if (held == held[0]).all():
            rest, last = _flow(sizes[i + 1 :], int(held[0]), target, most)
            return (ended + rest[-1]).tolist(), [last] * target
    return ended.tolist(), held.tolist()


def passage_windows(passages: DataFrame, target: int = 150, most: int = 300, part_rows: int = 500_000) -> DataFrame:
    """(source, window, ref, n_words, text) from (source, ord, ref, text), in reading order.

    A window ends before a passage that would take it over ``most`` words and after the one
    that takes it to ``target``; a single longer passage is a window. Wordless ones are left
    out. ``ord`` orders a source's passages and doesn't repeat there.

    Only sizes go through Python. The reading order is cut into parts of about ``part_rows``
    passages; each says what it does to whatever words an open window may bring in, so that a
    short pass over the parts tells what it does bring, and the parts are walked alone.
    """
    spark = passages.sparkSession
    own = F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("z"), "ord"
    sizes = passages.select(*own, F.size(words(F.col("text"))).alias("n")).where("n > 0")
    sizes = materialise(sizes, "sizes")  # the texts are read for this once, and once for the windows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-sizes.count() // part_rows))
    placed = materialise(numbered(sizes, ["s", "z", "ord"], "_at", parts), "places")
    # a part of the numbering is told by its places
    step = F.lit(part_rows).cast("long")
    placed = placed.withColumn("part", F.floor(F.col("_at") / step))

    def outcome(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord")
        ended, held = _outcomes(part["n"].tolist(), target, most)
        return pd.DataFrame({"s": part["s"].iloc[:1], "z": part["z"].iloc[:1], "part": part["part"].iloc[:1], "ended": [ended], "held": [held]})

    def enter(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        number, now, out = 0, 0, []
        for ended, held in zip(parts["ended"], parts["held"]):
            out.append((number, now))
            number, now = number + int(ended[now]), int(held[now])
        return parts[["s", "z", "part"]].assign(number=[n for n, _ in out], now=[h for _, h in out])

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord")
        numbers, _ = _flow(part["n"].tolist(), int(part["now"].iloc[0]), target, most)
        return part[["s", "z", "ord", "n"]].assign(window=np.array(numbers[:-1], np.int64) + int(part["number"].iloc[0]))

    key = "s string, z boolean"
    outcomes = placed.groupBy("s", "z", "part").applyInPandas(outcome, f"{key}, part long, ended array<long>, held array<long>")
    entries = outcomes.groupBy("s", "z").applyInPandas(enter, f"{key}, part long, number long, now long")
    entered = placed.join(entries, ["s", "z", "part"])
    kind = sizes.schema["ord"].dataType.simpleString()
    labels = entered.groupBy("s", "z", "part").applyInPandas(label, f"{key}, ord {kind}, n int, window long")
    texts = passages.select("source", *own, "ref", collapse(F.col("text")).alias("text"))
    items = F.array_sort(F.collect_list(F.struct("ord", "ref", "text")))
    made = texts.join(labels, ["s", "z", "ord"]).groupBy("source", "window").agg(items.alias("i"), F.sum("n").alias("n_words"))
    first, last = F.col("i")[0]["ref"], F.element_at("i", -1)["ref"]
    ref = F.when(first == last, first).otherwise(F.concat(first, F.lit("–"), last))
    return made.select("source", "window", ref.alias("ref"), "n_words", F.array_join(F.transform("i", lambda x: x["text"]), " ").alias("text"))


def continuations(rows: DataFrame, text: str = "text", least: int = 20, share: float = 0.5, prompt: str = "continue: ") -> DataFrame:
    """rows with input_text (the prompt and a text's first part) and target_text (its rest)."""
    w = words(F.col(text))
    cut = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * share).cast("int")))
    rows = rows.withColumn("_w", w).withColumn("_n", F.size("_w")).where(F.col("_n") >= least).withColumn("_cut", cut)
    return rows.withColumns(
        {
            "input_text": F.concat(F.lit(prompt), F.array_join(F.slice("_w", F.lit(1), F.col("_cut")), " ")),
            "target_text": F.array_join(F.slice("_w", F.col("_cut") + 1, F.col("_n")), " ")
        }
    ).drop("_w", "_n", "_cut")
