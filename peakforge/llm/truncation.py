"""Texts cut off by a length limit or during transfer, and how often each source cuts.

Two kinds of evidence are combined per source. Lengths: a log-normal distribution is fitted by maximum likelihood with
the texts at a candidate limit as right-censored, and gives the posterior that a text of exactly this length was cut.
Endings: what sources put behind a text (page numbers, closing tags, end marks) is taken off; a text that then lacks a
sentence end is open, and all texts together tell how often its last words end a sentence, among all places at which a cut
would leave these words: a cut inside a longer word leaves its beginning. A source that leaves complete texts without full
stop shows so by many open texts with words that do. A full stop that all texts put behind a word without ever ending a line
there belongs to an abbreviation and ends no text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.session import fitting, write_shared

# Marks of a cut, and what may stand behind a complete text.
CUT_MARK = (
    r"(?:\s*(?:\[\s*(?:\.\.\.|…|cont(?:\.|inued)?|more|truncated|cut|suite|Fortsetzung)\s*\]|\(\s*(?:\.\.\.|…|cont(?:\.|inued)?|more|truncated)\s*\)"
    r"|<<[^<>]{1,40}>>|…|\.\.\.|\x{FFFD}))\s*$"
)
FURNITURE = r"(?:\s*(?:-\s*[0-9]+\s*-|[0-9]+\s*/\s*[0-9]+|(?:Page|Seite|page)\s+[0-9]+(?:\s*(?:/|of|von|sur)\s*[0-9]+)?|\((?:End|Ende|Fin)\)|\*(?: ?\*){2,}|\|[^|\n]{1,60}|(?:</[A-Za-z][A-Za-z0-9]*>\s*)+))?\s*$"
OPEN_TAG = r"<[/!]?[A-Za-z][^<>]{0,80}$|</?$"
SENTENCE_END = r"""[.。!?！？]["'”»)\]]*$"""
WORD = r"[\p{L}\p{N}]+|[.。!?！？;:](?=\s|$|<)|。"
PY_WORD = r"[^\W_]+|[.。!?！？;:](?=\s|$|<)|。"
ENDS = [".", "。", "!", "?", "！", "？"]
#: The word at the end of a text or of what stands before a full stop.
TOKEN = r"""[^\s>("“«]{1,40}"""

#: How often last words must end a sentence to look final; shares of cut and of complete open texts that do.
FINAL, CUT_FINAL, WHOLE_FINAL = 0.02, 0.05, 0.95
#: Share of complete open texts of a source below which none is taken to exist there; less where the source has more texts.
RARELY_OPEN = 0.0005
#: An abbreviation's full stop ends a line so much more rarely than full stops do, and should have ended so many lines at least.
LINE_SHARE, LINES = 0.02, 10
#: Different texts a limit must hold at least, how many times more than expected, and the odds against chance over all lengths of a source.
LEAST_AT_LIMIT, EXCESS, ODDS = 3, 5.0, 1e-3
#: Lengths on either side whose texts tell how many to expect at a length.
AROUND = 60
#: Characters of the trimmed text's end that patterns may take up.
ENDING = 500
#: Share of random places at which a text ends like a sentence.
CLOSED_BY_CHANCE = 0.015
#: Words of endings that every worker may hold.
MOST_WORDS = 1_000_000
#: A trailer that nearly all texts of a source have is missed where it is absent.
ALWAYS = 0.97


def fit_censored(logs: list[tuple[float, float]], limit: float, at_limit: float, rounds: int = 60) -> tuple[float, float]:
    """Maximum likelihood (mu, sigma) of log-normal lengths: ``logs`` are (log length, count) seen whole, ``at_limit`` texts are censored at log ``limit``."""
    n = sum(c for _, c in logs)
    if n == 0:
        return limit, 1.0
    s1, s2 = sum(x * c for x, c in logs), sum(x * x * c for x, c in logs)
    mu = s1 / n
    sd = max(0.02, math.sqrt(max(0.0, s2 / n - mu * mu)))
    for _ in range(rounds):
        z = (limit - mu) / sd
        tail = 0.5 * math.erfc(z / math.sqrt(2))
        h = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail if tail > 1e-12 else z + 1 / max(z, 1.0)
        e1 = mu + sd * h
        e2 = mu * mu + 2 * mu * sd * h + sd * sd * (1 + z * h)
        new = (s1 + at_limit * e1) / (n + at_limit)
        var = (s2 + at_limit * e2) / (n + at_limit) - new * new
        mu, sd = new, max(0.02, math.sqrt(max(var, 0.0)))
    return mu, sd


def _chance(m: float, expected: float) -> float:
    """Upper bound of the Poisson probability of at least ``m`` texts where ``expected`` are."""
    e = max(expected, 1e-6)
    return 1.0 if m <= e else math.exp(m - e + m * math.log(e / m))


def _limits(h: pd.DataFrame) -> pd.DataFrame:
    """Limits of one source and unit from its histogram of lengths: every length is a candidate that holds more texts than those around it lead to expect.

    Texts beyond a limit don't refute it, since only a part of a source may obey it; they are seen whole in the fit.
    """
    source, unit = h["source"].iloc[0], h["unit"].iloc[0]
    h = h[h["len"] > 0].sort_values("len")
    at, n = h["len"].to_numpy(np.int64), h["n"].to_numpy(np.float64)
    out = []
    if len(at):
        total, width, sums = n.sum(), 4 if unit == "bytes" else 1, np.concatenate([[0.0], np.cumsum(n)])
        held = lambda low, high: sums[np.searchsorted(at, high, "right")] - sums[np.searchsorted(at, low, "left")]
        m = held(at - width + 1, at)
        near = (held(at - AROUND, at - width) + held(at + 1, at + AROUND)) / (2 * AROUND - width + 1) * width
        for limit, m_, near_ in zip(at, m, near):
            if m_ < LEAST_AT_LIMIT or m_ < EXCESS * near_:
                continue
            inside = (at > limit - width) & (at <= limit)
            mu, sd = fit_censored(list(zip(np.log(at[~inside]), n[~inside])), math.log(limit), m_)
            z = (math.log(limit) - mu) / sd
            expected = max(near_, total * width * math.exp(-z * z / 2) / (sd * limit * math.sqrt(2 * math.pi)))
            if m_ >= EXCESS * expected and _chance(m_, expected) * at[-1] < ODDS:
                out.append((source, unit, int(limit), width, int(m_), mu, sd, 1.0 - expected / m_))
    return pd.DataFrame(out, columns=["source", "unit", "limit_at", "width", "n_at", "mu", "sigma", "p_limit"])


LIMITS = "source string, unit string, limit_at bigint, width int, n_at bigint, mu double, sigma double, p_limit double"


def length_limits(shape: DataFrame) -> DataFrame:
    """(source, unit, limit_at, width, n_at, mu, sigma, p_limit): limits found, with the posterior of a cut at exactly that length.

    ``shape`` has source, n_chars, n_bytes, print. Each source is fitted on its histogram, one row per length, aggregated before the shuffle;
    equal texts count once, so that copies make no limit.
    """
    shape = shape.select("source", "n_chars", "n_bytes", "print").distinct()
    both = shape.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("len")))).alias("v"))
    hist = both.groupBy("source", "v.unit", "v.len").agg(F.count(F.lit(1)).alias("n"))
    return hist.groupBy("source", "unit").applyInPandas(_limits, LIMITS)


def _endings(text: Column) -> dict[str, Column]:
    """Pieces of the end of the trimmed text, as far as the patterns may reach; the text itself stays whole."""
    tail = F.right(F.rtrim(text, F.lit(" \n\r\t")), F.lit(ENDING))
    furniture = F.regexp_extract(tail, FURNITURE, 0)
    body = F.regexp_replace(tail, FURNITURE, "")
    return {"tail": tail, "furniture": furniture, "body": body}


def shapes(documents: DataFrame) -> DataFrame:
    """One row per document with non-empty text: source, lengths, and what its ending looks like."""
    d = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").where("text is not null and text <> ''")
    e = _endings(F.col("text"))
    d = d.select("doc_id", "source", F.char_length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("print"), e["tail"].alias("tail"), e["furniture"].alias("furniture"), e["body"].alias("body"))
    marked = F.col("tail").rlike(CUT_MARK) | F.col("body").rlike(CUT_MARK) | F.col("tail").rlike(OPEN_TAG)
    w = F.regexp_extract_all(F.lower("body"), F.lit(WORD), 0)
    return d.select(
        "doc_id", "source", "n_chars", "n_bytes", "print", marked.alias("marked"), (~F.col("body").rlike(SENTENCE_END)).alias("open"),
        F.regexp_replace(F.trim("furniture", F.lit(" \n\r\t")), "[0-9]+", "9").alias("trailer"), F.try_element_at(w, F.lit(-1)).alias("last"), F.try_element_at(w, F.lit(-2)).alias("prev"),
        F.regexp_extract("body", rf"({TOKEN}?)\.?$", 1).alias("token"),
    )


def abbreviations(documents: DataFrame) -> DataFrame:
    """(token): words behind which a full stop stands often, but hardly ever at the end of a line or before a tag. Texts without such places say nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(TOKEN + "$").search
        for batch in batches:
            inner, ending = Counter(), Counter()
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                broken = [*text.split(".\n")[:-1], *text.split(".<")[:-1]]
                if broken:
                    ending.update(m[0] for x in broken if (m := token(x[-40:])))
                    inner.update(m[0] for x in text.split(". ")[:-1] if (m := token(x[-40:])))
            keys = list(inner.keys() | ending.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inner[k] for k in keys], pa.int64()), pa.array([ending[k] for k in keys], pa.int64())], ["token", "inner", "ending"])

    counted = documents.select("text").mapInArrow(count, "token string, inner bigint, ending bigint")
    counted = write_shared(counted.groupBy("token").agg(F.sum("inner").alias("inner"), F.sum("ending").alias("ending")), "stops")
    n, e = counted.agg(F.sum(F.col("inner") + F.col("ending")), F.sum("ending")).first()
    share = (e or 0) / max(1, n or 0)
    due = (F.col("inner") + F.col("ending")) * share
    return counted.where((due >= LINES) & (F.col("ending") < LINE_SHARE * due)).select("token")


def word_endings(documents: DataFrame, open_: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(prev, last, n, ends): how often each pair of words with a last or previous word of ``open_`` stands in all texts, and how often a sentence ends behind it.

    The last word of a text without sentence end says nothing and isn't counted. Up to ``most_words`` words go to every worker, where
    a batch of texts is counted before anything is shuffled; beyond, all pairs are joined with the words.
    """
    lasts = write_shared(open_.select("last").where("last is not null").distinct(), "lasts")
    prevs = write_shared(open_.select("prev").where("prev is not null").distinct(), "prevs")
    if lasts.count() + prevs.count() <= most_words:
        sets = documents.sparkSession.sparkContext.broadcast(({r[0] for r in lasts.toLocalIterator()}, {r[0] for r in prevs.toLocalIterator()}))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, prev = sets.value
            find, ends = re.compile(PY_WORD).findall, set(ENDS)
            for batch in batches:
                n: Counter = Counter()
                for text in batch.column("text").to_pylist():
                    if text:
                        w = find(text.lower())
                        n.update((a, b, c in ends) for a, b, c in zip(w, w[1:], w[2:]) if b in last or a in prev)
                keys = list(n)
                columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.values(), pa.int64())], ["prev", "last", "end", "n"])

        counted = documents.select("text").mapInArrow(count, "prev string, last string, end boolean, n bigint")
    else:
        w = F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)
        n = F.greatest(F.size("w") - 2, F.lit(0))
        triples = documents.where("text is not null").select(w.alias("w")).where(F.size("w") > 2)
        triples = triples.select(F.explode(F.arrays_zip(F.slice("w", 1, n).alias("prev"), F.slice("w", 2, n).alias("last"), F.slice("w", 3, n).alias("next"))).alias("t"))
        t = triples.select("t.prev", "t.last", F.col("t.next").isin(ENDS).alias("end"), F.lit(1).alias("n"))
        flags = t.join(lasts.withColumn("is_last", F.lit(True)), "last", "left").join(prevs.withColumn("is_prev", F.lit(True)), "prev", "left")
        counted = flags.where("is_last or is_prev").select("prev", "last", "end", "n")
    return counted.groupBy("prev", "last").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("end"), F.col("n"))), F.lit(0)).alias("ends"))


def finality(documents: DataFrame, open_: DataFrame) -> DataFrame:
    """(last, prev, final): estimated share of sentence ends among the places at which a cut would leave these last two words; 0 for a word never seen elsewhere.

    These are the places with the two words, and those where a longer word begins with the last one.
    """
    pairs = write_shared(word_endings(documents, open_), "endings")
    one = pairs.groupBy("last").agg(F.sum("n").alias("n1"), F.sum("ends").alias("e1"))
    two = pairs.groupBy("prev").agg(F.sum("n").alias("n2"), F.sum("ends").alias("e2"))
    asked = write_shared(open_.select("last", "prev").where("last is not null").distinct(), "asked")
    begun = pairs.join(fitting(asked.select("prev").distinct()), "prev", "left_semi").where(F.char_length("last") > 1)
    begun = begun.select("prev", "n", F.explode(F.expr("transform(sequence(1, char_length(last) - 1), i -> left(last, i))")).alias("last"))
    begun = begun.join(fitting(asked), ["prev", "last"], "left_semi").groupBy("prev", "last").agg(F.sum("n").alias("longer"))
    both = asked.join(one, "last", "left").join(two, "prev", "left").join(pairs, ["prev", "last"], "left").join(begun, ["prev", "last"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.sqrt(z("e1") / (z("n1") + 1) * (z("e2") / (z("n2") + 1)))
    return both.select("last", "prev", F.when(z("n1") > 0, (z("ends") + 2 * base) / (z("n") + z("longer") + 2)).otherwise(0.0).alias("final"))


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, p_cut, evidence, limit_at) for every document; p_cut is the posterior that its text was cut.

    ``documents`` has doc_id, source, text. Null and empty texts are no cases (p_cut 0, evidence none). Sources are
    judged by themselves, a null source is one of its own. Evidence is mark, limit, ending, trailer or none.
    """
    d = documents.select("doc_id", "source", "text")
    shape = write_shared(shapes(d), "shapes")
    limits = write_shared(length_limits(shape), "limits")
    # A text falls short of a limit in bytes only where the next character takes several.
    at = shape.select("doc_id", "source", (F.col("n_bytes") == F.col("n_chars")).alias("plain"), F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("len")))).alias("v"))
    at = at.join(limits, (at["source"] == limits["source"]) & (at["v.unit"] == limits["unit"]) & (at["v.len"] <= limits["limit_at"]) & (at["v.len"] > limits["limit_at"] - F.when(at["plain"], 1).otherwise(limits["width"])))
    at = at.groupBy("doc_id").agg(F.max("p_limit").alias("p_limit"), F.max("limit_at").alias("limit_at"))
    known = shape.groupBy("source", "trailer").agg(F.count(F.lit(1)).alias("n"))
    size = shape.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.avg((F.col("trailer") != "").cast("double")).alias("trailed"))
    rare = known.join(size, "source").where((F.col("trailer").startswith("|")) & (F.col("n") < 0.01 * F.col("docs") * F.col("trailed"))).select("source", "trailer", F.lit(True).alias("strange"))
    short = write_shared(abbreviations(d), "abbreviations").withColumn("short", F.lit(True))
    shape = shape.join(at, "doc_id", "left").join(rare, ["source", "trailer"], "left").join(fitting(short), "token", "left").drop("token")
    # A strange trailer or an abbreviation is no end, whatever stands there.
    shape = shape.withColumn("strange", F.coalesce("strange", "short", F.lit(False))).withColumn("open", F.col("open") | F.col("strange")).drop("short")
    final = finality(d, shape.where("open and not marked and not strange"))
    shape = shape.join(final, ["last", "prev"], "left").withColumn("final", F.when(F.col("strange"), 0.0).otherwise(F.coalesce("final", F.lit(0.0))))
    shape = write_shared(shape, "judged")
    free = (~F.col("marked")) & F.col("open") & F.col("p_limit").isNull()
    way = shape.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(free & (F.col("final") >= 0.3)).alias("hi"),
        F.count_if(free & (F.col("final") < FINAL)).alias("lo"),
        F.avg((F.col("trailer") != "").cast("double")).alias("trailed"),
    )
    way = way.select("source", F.greatest((F.col("hi") - 0.1 * F.col("lo")) / F.col("docs"), F.least(F.lit(RARELY_OPEN), 0.5 / F.col("docs"))).alias("q"), F.greatest((F.col("lo") + 0.5) / F.col("docs"), F.lit(0.001)).alias("prior"), "trailed")
    full = shape.where("p_limit is not null").groupBy("source", "limit_at").agg(F.count_if(F.col("open") | F.col("marked")).alias("n_open"), F.count_if(~F.col("open") & ~F.col("marked")).alias("n_closed"))
    s = shape.join(way, "source").join(full, ["source", "limit_at"], "left")
    prior = F.coalesce("p_limit", F.least("prior", F.lit(0.5)))
    odds = prior / (1 - F.least(prior, F.lit(0.999)))
    looks = F.col("final") >= FINAL
    missed = (F.col("trailed") > ALWAYS) & (F.col("trailer") == "")
    likelihood = (
        F.when(F.col("open"), F.when(looks, F.lit(CUT_FINAL / WHOLE_FINAL)).otherwise((1 - CUT_FINAL) / (1 - WHOLE_FINAL)) / F.col("q"))
        .when(missed, F.lit(50.0))
        .otherwise(F.lit(0.015))
    )
    posterior = odds * likelihood / (1 + odds * likelihood)
    # Of the closed texts at a limit, only as many as chance allows were cut; the others are complete and as long by nature or by design.
    by_chance = F.least(F.lit(0.99), F.col("n_open") * CLOSED_BY_CHANCE / F.greatest("n_closed", F.lit(1)))
    p = F.when(F.col("marked"), F.lit(0.99)).when(~F.col("open") & ~missed & F.col("p_limit").isNotNull(), by_chance).otherwise(posterior)
    evidence = F.when(F.col("marked"), "mark").when(p <= 0.5, "none").when(F.col("p_limit").isNotNull(), "limit").when(F.col("open"), "ending").otherwise("trailer")
    found = s.select("doc_id", F.round(p, 6).alias("p_cut"), evidence.alias("evidence"), "limit_at")
    return documents.select("doc_id", "source").join(found, "doc_id", "left").select("doc_id", "source", F.coalesce("p_cut", F.lit(0.0)).alias("p_cut"), F.coalesce("evidence", F.lit("none")).alias("evidence"), "limit_at")


def cut_rates(judged_: DataFrame) -> DataFrame:
    """(source, n_documents, n_cut, rate, n_at_limit) per source."""
    cut = F.col("p_cut") > 0.5
    n = judged_.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(cut).alias("n_cut"), F.count_if(cut & F.col("limit_at").isNotNull()).alias("n_at_limit"))
    return n.select("source", "n_documents", "n_cut", (F.col("n_cut") / F.col("n_documents")).alias("rate"), "n_at_limit")
