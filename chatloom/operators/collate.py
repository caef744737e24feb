"""Batches as rows of one width, by a collator that a data set names, a plugin file has, or the default."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators import training
from chatloom.settings import DataSettings, TrainSettings
from chatloom.sources import files

#: A collator: of rows (batch_no, input_ids, labels, ...) it makes rows whose arrays have one length in each batch.
Collator = Callable[[DataFrame, DataSettings], DataFrame]
_COLLATORS: dict[str, Collator] = {}


def register_collator(dataset: str, collator: Collator) -> None:
    _COLLATORS[dataset] = collator


def padded_to_longest(rows: DataFrame, data: DataSettings) -> DataFrame:
    """The default: ids, mask and labels filled up to the longest row of the batch."""
    width = rows.groupBy("batch_no").agg(F.max(F.size("input_ids")).alias("__width"))
    rows = rows.join(width, "batch_no")
    fill = lambda c, value: F.concat(c, F.array_repeat(F.lit(value).cast("long"), F.col("__width") - F.size(c)))
    ids = {"input_ids": fill(F.col("input_ids"), data.pad), "attention_mask": fill(F.transform("input_ids", lambda _: F.lit(1).cast("long")), 0), "labels": fill(F.col("labels"), training.IGNORED)}
    return rows.withColumns(ids).drop("__width")


def from_plugin(file: str) -> Collator | None:
    """The collator of ``path.py:function`` (``get_data_collator`` if not said); None, with a warning, if the file lacks it."""
    path, _, function = file.partition(":")
    if not path.endswith(".py"):
        raise ValueError(f"{path} is no Python file")
    try:
        return files.from_file(path, function or "get_data_collator")
    except AttributeError as e:
        warnings.warn(f"{e}: the default collator is used", stacklevel=2)
        return None


def collator_for(data: DataSettings) -> Collator:
    """That of the data set, else of its plugin file, else the default."""
    own = _COLLATORS.get(data.dataset) or (from_plugin(data.file) if data.file else None)
    return own or padded_to_longest


def batches(rows: DataFrame, key: str, train: TrainSettings, data: DataSettings, split: str = "train") -> DataFrame:
    """Rows (key, input_ids, labels) in the batches of a worker: rows that are too long go, the others are batched by the policy and collated."""
    if split == "train" and train.batching not in ("padding", "packing"):
        raise ValueError(f"no batching policy {train.batching!r}")
    rows = rows.where(F.size("input_ids") <= data.max_length)
    size = train.batch if split == "train" else train.val_batch
    policy = train.batching if split == "train" else "padding"
    placed = training.batched(rows.withColumn("__size", F.size("input_ids").cast("long")).select(key, "__size"), key, "__size", policy, size, train.chunk, data.drop_last)
    if train.ranks > 1:
        most = placed.agg(F.max("batch_no")).first()[0]
        placed = training.stripe(placed, train.ranks, train.rank, 0 if most is None else most + 1)
    return collator_for(data)(rows.join(placed, key), data)
