"""Training examples from annotated, parallel text."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variora.functions.text import drop_marks, uncial, words


def annotated_examples(tokens: DataFrame, key: str, order: list[str], form: str, labels: dict[str, str], least: int = 2, most: int = 60) -> DataFrame:
    """(key, task, input_text, target_text): one ``raw`` example a group of ``least`` tokens or
    more, and, up to ``most`` tokens, one for each task of ``labels`` (task: label column)."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(form).alias("_form"), *[F.col(c).alias(f"_{task}") for task, c in labels.items()])))
    groups = tokens.groupBy(key).agg(items.alias("_i")).where(F.size("_i") >= least)
    joined = lambda field: F.array_join(F.transform("_i", lambda x: x[field]), " ")
    made = lambda task, target: F.struct(F.lit(task).alias("task"), joined("_form").alias("input_text"), target.alias("target_text"))
    raw = F.array(made("raw", joined("_form")))
    every = F.concat(raw, F.array(*[made(task, joined(f"_{task}")) for task in labels]))
    return groups.select(key, F.explode(F.when(F.size("_i") <= most, every).otherwise(raw)).alias("e")).select(key, "e.*")


def _by_member(texts: DataFrame, key: str, member: str, value: str, need: list[str]) -> DataFrame:
    """(key, _m MAP<member, text>) of groups that have a non-empty text of each of ``need``;
    texts: one row a member."""
    held = texts.where(F.length(value) > 0).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(member, value))).alias("_m"))
    return held.where(F.size(F.array_except(F.array(*map(F.lit, need)), F.map_keys("_m"))) == 0) if need else held


def directed_pairs(texts: DataFrame, key: str, member: str, value: str, directions: list[tuple[str, str]], need: list[str] = ()) -> DataFrame:
    """(key, source, target, source_text, target_text) for each direction of which both sides
    have text, over groups that hold all of ``need``."""
    pairs = [
        F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col("_m")[a].alias("source_text"), F.col("_m")[b].alias("target_text")) for a,
        b in directions
    ]
    made = _by_member(texts, key, member, value, list(need)).select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*")
    return made.where("source_text is not null and target_text is not null")


def fusion_examples(texts: DataFrame, key: str, member: str, value: str, witnesses: list[str], target: str) -> DataFrame:
    """(key, witnesses MAP<member, text>, target_text) where all of them have text."""
    held = _by_member(texts, key, member, value, [*witnesses, target])
    return held.select(key, F.map_filter("_m", lambda k, _: k.isin(*witnesses)).alias("witnesses"), F.col("_m")[target].alias("target_text"))


def source_dropout(examples: DataFrame) -> DataFrame:
    """Each example as it is and, where it has several witnesses, once with each alone."""
    alone = F.transform(F.map_entries("witnesses"), lambda e: F.map_from_entries(F.array(e)))
    return examples.withColumn("witnesses", F.explode(F.concat(F.array("witnesses"), F.when(F.size("witnesses") > 1, alone).otherwise(F.slice(alone, 1, 0)))))


def restoration_examples(rows: DataFrame, text: str = "text", prompt: str = "restore: ") -> DataFrame:
    """rows with input_text (the prompt and the text in bare capitals) and target_text; texts
    without marks are left out."""
    return rows.where(drop_marks(F.col(text)) != F.col(text)).withColumns(
        {"input_text": F.concat(F.lit(prompt), uncial(F.col(text))), "target_text": F.col(text)}
    )


def completion_probe(rows: DataFrame, text: str = "text", least: int = 6) -> DataFrame:
    """rows with the first half of a text's words as input_text, the rest as target_text."""
    rows = rows.withColumn("_w", words(F.col(text))).where(F.size("_w") >= least)
    half = F.floor(F.size("_w") / 2).cast("int")
    return rows.withColumns(
        {"input_text": F.array_join(F.slice("_w", F.lit(1), half), " "), "target_text": F.array_join(F.slice("_w", half + 1, F.size("_w")), " ")}
    ).drop("_w")


def corrupt_spans(rows: DataFrame, key: str, tokens: str, density: float = 0.15, mean_span: float = 3.0, seed: int = 42) -> DataFrame:
    """rows with ``corrupted`` and ``target``: random spans of the tokens, geometric in length,
    replaced by numbered sentinels, and the sentinels with the tokens that they stand for.

    The draw depends on seed and key alone. Fewer than two tokens stay as they are.
    """

    @F.pandas_udf("corrupted array<string>, target array<string>")
    def corrupt(ids: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for i, own in zip(ids, lists):
            own = [] if own is None else list(own)
            noise = min(max(1, round(len(own) * density)), len(own) - 1)
            if noise < 1:
                out.append((own, ["</s>"]))
                continue
            rng = np.random.default_rng([seed, zlib.crc32(str(i).encode())])
            ends = np.unique(np.minimum(np.cumsum(rng.geometric(1 / mean_span, noise)), noise))
            sizes = np.diff(ends, prepend=0)
            starts = np.sort(rng.integers(0, len(own) - noise + 1, len(sizes))) + ends - sizes
            hidden = np.zeros(len(own) + 1, bool)
            for a, n in zip(starts, sizes):
                hidden[a : a + n] = True
            left, gone, number = [], [], 0
            for at, token in enumerate(own):
                if hidden[at] and (at == 0 or not hidden[at - 1]):
                    left.append(f"<extra_id_{number}>")
                    gone.append(left[-1])
                    number += 1
                (gone if hidden[at] else left).append(token)
            out.append((left, [*gone, "</s>"]))
        return pd.DataFrame(out, columns=["corrupted", "target"])

    return rows.withColumn("_c", corrupt(F.col(key).cast("string"), F.col(tokens))).select("*", "_c.*").drop("_c")
