"""Mixing sources to target weights, measured in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import re
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakforge.functions.numbers import running_total

#: Words whose token count each Python worker remembers before it forgets all and starts anew.
REMEMBERED = 300_000
# Fixed value: the pattern by which the byte-level vocabulary splits text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabularies lie; give your own path where they are not installed."""
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent / name) if spec else f"/opt/tokenizers/{name}"


class TokenCounter:
    """Counts tokens word by word; words seen before cost one lookup.

    Between two characters that are no white space, a single space always begins a new word of the pattern, so a text
    without runs of white space around a space can be cut there and the counts of its parts add up exactly.
    Other texts are encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}
        self.runs = re.compile(r" \s|\s ")

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.runs.search(text):
            return len(self.encode(text))
        first, *rest = text.split(" ")
        total, known = len(self.encode(first)), self.known
        for word in rest:
            n = known.get(word)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[word] = len(self.encode(" " + word))
            total += n
        return total


def counted(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents; null and empty texts have 0 tokens."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker serves many tasks; what it has learned is kept on the interpreter, as this function is sent anew each time.
        kept = sys.__dict__.setdefault("_peakforge_counters", {})
        counter = kept.get(path) or kept.setdefault(path, TokenCounter(path))
        for b in batches:
            n = pa.array(map(counter, b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), n], ["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def budgets(tokens: DataFrame, target: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeat, have, budget, total) for each source with documents or a target.

    Sources without documents can't contribute; the others share their part in proportion. ``total`` tokens, or the
    most that lets every source keep its share without exceeding max_repeat. A target named twice counts with its
    sum of shares and its smallest cap; null shares count as 0.
    """
    have = tokens.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("have"))
    goal = target.where("source is not null").groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.min("max_repeat"), F.lit(1)).alias("max_repeat"))
    s = goal.join(have, "source", "full_outer").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeat", F.lit(0)).alias("max_repeat"), F.coalesce("have", F.lit(0)).alias("have"))
    live = F.when((F.col("have") > 0) & (F.col("max_repeat") > 0), F.col("target_share")).otherwise(0.0)
    all_ = Window.partitionBy()
    s = s.withColumn("live", live).withColumn("part", F.when(F.sum("live").over(all_) > 0, F.col("live") / F.sum("live").over(all_)).otherwise(0.0))
    most = F.min(F.when(F.col("part") > 0, F.col("have") * F.col("max_repeat") / F.col("part"))).over(all_)
    s = s.withColumn("total", F.coalesce(F.lit(total).cast("double") if total is not None else most, F.lit(0.0)))
    cap = F.col("have") * F.col("max_repeat")
    return s.withColumn("budget", F.least(F.floor(F.col("part") * F.col("total")), cap).cast("bigint")).select("source", "target_share", "max_repeat", "have", "budget", "total")


def mix(tokens: DataFrame, target: DataFrame, total: int | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, n_repeats): how often each document enters the mixture; documents left out have no row.

    Within a source documents stand in the order of a keyed hash. Whole passes over the source come first; the last
    pass takes the documents whose middle token lies within what is left of the budget. Prefix sums are taken in
    hash ranges, so a source of any size is spread over many tasks.
    """
    plan = budgets(tokens, target, total).where("budget > 0")
    keyed = tokens.join(plan.select("source", "max_repeat", "have", "budget"), "source").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    placed = running_total(keyed, "n_tokens", F.shiftright("h", 50), ["h", "doc_id"], ["source"])
    passes = F.floor(F.col("budget") / F.col("have"))
    rest = F.col("budget") - passes * F.col("have")
    again = (F.col("before") + F.col("n_tokens") / 2) < rest
    n = F.least(passes + again.cast("int"), F.col("max_repeat"))
    return placed.select("doc_id", "source", "n_tokens", n.cast("int").alias("n_repeats")).where("n_repeats > 0")


def shares(tokens: DataFrame, target: DataFrame, total: int | None = None, seed: int = 17) -> DataFrame:
    """(source, target_share, have, budget, used, n_documents, actual_share) for every source, also those left out."""
    used = mix(tokens, target, total, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("used"), F.count(F.lit(1)).alias("n_documents"))
    s = budgets(tokens, target, total).join(used, "source", "left")
    s = s.select("source", "target_share", "have", "budget", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
    whole = F.sum("used").over(Window.partitionBy())
    return s.withColumn("actual_share", F.when(whole > 0, F.col("used") / whole).otherwise(0.0))
