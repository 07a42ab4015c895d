"""Vectors of names by a local model; without one there is no semantic tier."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 64


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the states that the mask shows, of length one."""
    weight = mask[..., None].astype(np.float32)
    mean = (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-12)
    return mean / (np.linalg.norm(mean, axis=1, keepdims=True) + 1e-12)


def available(model: str | None) -> bool:
    return bool(model) and os.path.isfile(os.path.join(model, "model.onnx")) and os.path.isfile(os.path.join(model, "tokenizer.json"))


def vectors(texts: DataFrame, model: str, batch: int = 256) -> DataFrame:
    """text, vector of each distinct text, stripped. model: a folder on every executor with model.onnx and tokenizer.json.

    Texts are padded or cut to LENGTH tokens. A worker loads the model once for all its batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(os.path.join(model, "model.onnx"), providers=["CPUExecutionProvider"])
        tokenizer = Tokenizer.from_file(os.path.join(model, "tokenizer.json"))
        tokenizer.enable_truncation(LENGTH)
        tokenizer.enable_padding(length=LENGTH)
        inputs = {i.name for i in session.get_inputs()}
        for b in batches:
            for i in range(0, len(b), batch):
                part = b["text"].iloc[i : i + batch].tolist()
                coded = tokenizer.encode_batch(part)
                told = {"input_ids": [c.ids for c in coded], "attention_mask": [c.attention_mask for c in coded], "token_type_ids": [c.type_ids for c in coded]}
                feed = {k: np.array(v, np.int64) for k, v in told.items() if k in inputs}
                states = session.run(None, feed)[0]
                yield pd.DataFrame({"text": part, "vector": list(pooled(states, np.array(told["attention_mask"])))})

    some = texts.select(F.trim("text").alias("text")).filter("text <> ''").distinct()
    return some.mapInPandas(run, "text string, vector array<float>")
