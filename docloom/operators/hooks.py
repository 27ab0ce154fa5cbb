"""Where models plug in: embedders, query generators and tokenizers, each with a default that needs no model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import sentences
from docloom.operators.mining import draw


def hashed_words(texts: list[str], size: int = 256) -> np.ndarray:
    """A unit vector a text: counts of its lower-case words in `size` buckets; zeros without a word."""
    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts, strict=True):
        np.add.at(row, [zlib.crc32(w.encode()) % size for w in re.findall(r"[^\W_]+", text.lower())], 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(docs: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashed_words) -> DataFrame:
    """(docid, embedding) of docs(docid, contents), a batch of texts a call; a null text is an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors = np.asarray(embed(f["contents"].fillna("").tolist()), np.float32)
            yield pd.DataFrame({"docid": f["docid"], "embedding": list(vectors)})

    return docs.select("docid", "contents").mapInPandas(run, "docid string, embedding array<float>")


def drawn_sentences(docid: Column, contents: Column, n: int, seed: str = "5") -> Column:
    """n sentences of the text, drawn without replacement by a hash of id and place; all of them where there are fewer."""
    placed = F.transform(sentences(contents), lambda s, i: F.struct(draw(F.lit(seed), docid, i.cast("string")).alias("key"), i.alias("i"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda x: x["s"])


def pseudo_queries(docs: DataFrame, n: int = 10, generate: Callable[[Column, Column, int], Column] = drawn_sentences, done: DataFrame | None = None) -> DataFrame:
    """(docid, sample, query): n queries for each of docs(docid, contents) that is not among done(docid); generate makes an
    array of them from id and text, a pandas UDF over a model will do."""
    if done is not None:
        docs = docs.join(done.select("docid").distinct(), "docid", "left_anti")
    return docs.select("docid", F.posexplode(generate(F.col("docid"), F.col("contents"), n)).alias("sample", "query"))


def preference_tokens(pairs: DataFrame, cut: Callable[[Column], Column], longest: int, end: int = 1) -> DataFrame:
    """pairs(prompt, chosen, rejected, ...) with the columns an encoder-decoder is trained on: the prompt's ids, cut to
    leave room for the end id, their mask, and the codes of both documents as labels."""
    none = F.array().cast("array<int>")
    told = pairs.withColumn("prompt_input_ids", F.concat(F.slice(F.coalesce(cut(F.col("prompt")), none), 1, longest - 1), F.array(F.lit(end))))
    mask = F.transform("prompt_input_ids", lambda _: F.lit(1))
    return told.withColumns({"prompt_attention_mask": mask, "chosen_labels": F.col("chosen"), "rejected_labels": F.col("rejected")}).drop("prompt", "chosen", "rejected")
