import math
import random
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from peakforge.llm import leaks, mixing, truncation, words

DROP = dict.fromkeys(map(ord, words.DROPPED))


def plain_words(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").translate(DROP).lower().replace("-\n", ""))


TEXTS = ["", None, "Straße ÉTÉ x²", "ﬁne ﬁl­ter zero​width word⁠joiner", "ｆｕｌｌ width １２", "hyph-\nenated and kept-\tapart", "【0001】 前記 sensor。", "a_b c1d ½", "été"]


def test_words_in_sql_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = {r["i"]: r["w"] for r in df.select("i", words.words(words.normal_text(F.col("text"))).alias("w")).collect()}
    assert got == {i: plain_words(t) for i, t in enumerate(TEXTS)}
    assert [words.words_of(t) for t in TEXTS] == [plain_words(t) for t in TEXTS]


def brute_leaks(docs, items, span):
    out = {}
    for i, t in docs:
        w = plain_words(t)
        for n, p in items:
            q = plain_words(p)
            best = 0
            for a in range(len(w)):
                for b in range(len(q)):
                    k = 0
                    while a + k < len(w) and b + k < len(q) and w[a + k] == q[b + k]:
                        k += 1
                    best = max(best, k)
            if best >= span:
                out[i, n] = best
    return out


@pytest.mark.parametrize("most_terms", [1_000_000, 0])
def test_leaks_equal_brute_force(spark, most_terms):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(n, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 14)))) for n in range(12)] + [(50, None), (51, ""), (None, "w1 " * 20)]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(60))) for i in range(30)] + [(97, None), (98, ""), (99, items[0][1].upper() + " " + items[0][1])]
    for i in range(100, 130):
        p = rnd.choice(items[:12])[1].split()
        a = rnd.randint(0, max(0, len(p) - 6))
        docs.append((i, "start " + ", ".join(p[a : a + rnd.randint(4, 9)]) + "\n-end " * 3))
    docs += [(200, docs[-1][1])]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id bigint, text string, item_no string")
    e = spark.createDataFrame(items, "item_no int, passage string")
    got = {(r["doc_id"], r["item_no"]): r["n_words"] for r in leaks.leaks(d, e, 5, most_terms).collect()}
    assert got == brute_leaks(docs, [x for x in items if x[0] is not None], 5)
    assert leaks.leaks(d.limit(0), e, 5).count() == 0 and leaks.leaks(d, e.limit(0), 5).count() == 0


def test_near_matches_equal_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(n, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(8, 12)))) for n in range(8)] + [(9, "too short"), (10, None)]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(40))) for i in range(20)] + [(98, None), (99, "")]
    for i in range(100, 130):
        p = rnd.choice(items[:8])[1].split()
        p[rnd.randrange(len(p))] = "changed"
        p.insert(rnd.randrange(len(p)), "put in")
        docs.append((i, "before it " + " ".join(p) + " behind it"))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_no int, passage string")
    kept = [(n, plain_words(p)) for n, p in items if len(plain_words(p)) >= 8]
    numbers = {w: i for i, w in enumerate(sorted({w for _, p in kept for w in p}))}
    n = {w: sum(plain_words(t).count(w) for _, t in docs) for w in numbers}
    want = {}
    for item, p in kept:
        half = max(2, math.ceil(len(p) / 2))
        chosen = sorted(range(len(p)), key=lambda j: (n[p[j]], numbers[p[j]], j))[:half]
        for i, t in docs:
            w, cells = plain_words(t), {}
            for j in chosen:
                for at, x in enumerate(w):
                    if x == p[j]:
                        for c in ((at - j) // 4, (at - j) // 4 - 1):
                            cells.setdefault(c, set()).add(j)
            best = max((len(c) for c in cells.values()), default=0)
            if best >= 0.8 * half:
                want[i, item] = best
    got = {(r["doc_id"], r["item_no"]): r["n_terms"] for r in leaks.near_matches(d, e, slack=4, least=8).collect()}
    assert got == want and len(got) >= 25
    assert leaks.near_matches(d.limit(0), e, least=8).count() == 0


def test_token_counts_are_exact():
    c = mixing.TokenCounter(mixing.tokenizer_path())
    rnd = random.Random(1)
    texts = ["", " lead", "trail ", "two  spaces", "tab\tand \nline", "it's 3.5%—é 前記", "<|endoftext|> x", "a" * 3000] + ["".join(rnd.choice("ab 1.,\n'é") for _ in range(80)) for _ in range(300)]
    for t in texts * 2:
        assert c(t) == len(c.encode(t)), t
    assert c(None) == 0


def _tokens(spark):
    rows = [(i, "big", 10 + i % 5) for i in range(2000)] + [(10_000 + i, "small", 20) for i in range(30)] + [(20_000, "other", 5), (20_001, None, 5), (20_002, "zero", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_mixing_keeps_shares_and_caps(spark):
    target = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("absent", 0.1, 2), ("zero", 0.1, 2)], "source string, target_share double, max_repeat int")
    t = _tokens(spark)
    s = {r["source"]: r for r in mixing.shares(t, target).collect()}
    assert s["small"]["used"] == 30 * 20 * 4 and s["absent"]["used"] == 0 and s["other"]["used"] == 0
    assert s["big"]["actual_share"] == pytest.approx(0.5 / 0.8, abs=0.01)
    m = mixing.mix(t, target)
    assert m.where("n_repeats > 4 or (source = 'big' and n_repeats > 1)").count() == 0 and m.select("doc_id").distinct().count() == m.count()
    total = {r["source"]: r["used"] for r in mixing.shares(t, target, total=800).collect()}
    assert abs(total["big"] - 500) <= 15 and abs(total["small"] - 300) <= 20
    assert mixing.mix(t.limit(0), target).count() == 0 and mixing.mix(t, target.limit(0)).count() == 0


def test_counted_documents(spark):
    d = spark.createDataFrame([(1, "a", "one two", 9), (2, "a", None, 9), (3, None, "", 9)], "doc_id bigint, source string, text string, n_tokens int")
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.counted(d).collect()} == {1: 2, 2: 0, 3: 0}


def test_censored_fit_recovers_the_distribution():
    rnd = random.Random(0)
    draws = [rnd.gauss(7.3, 0.4) for _ in range(4000)]
    limit = 7.6
    mu, sd = truncation.fit_censored([(x, 1.0) for x in draws if x < limit], limit, sum(x >= limit for x in draws))
    assert mu == pytest.approx(7.3, abs=0.03) and sd == pytest.approx(0.4, abs=0.03)


def _corpus():
    rnd = random.Random(6)
    nouns = ["valve", "rotor", "lens", "pump", "tray", "core"]
    sentence = lambda: f"The {rnd.choice(nouns)} {rnd.choice(['turns', 'lifts', 'cools'])} a {rnd.choice(['hollow', 'rigid'])} {rnd.choice(nouns)}"
    docs, cut = [], set()
    for i in range(1500):
        body = ". ".join(sentence() for _ in range(rnd.randint(6, 30)))
        kind = i % 3
        if kind == 0:  # full stops, cut at 700 characters
            text = body + "."
            if len(text) > 700:
                text = text[:700]
                if not text.endswith("."):
                    cut.add(i)
        elif kind == 1:  # page numbers behind, some cut in transfer
            text = body + "."
            if i % 30 == 1:
                text = text[: rnd.randint(60, len(text) - 3)].rstrip(". ")[:-2]
                cut.add(i)
            text += f"\n- {rnd.randint(1, 40)} -"
        else:  # half of the texts end without full stop
            text = body + ("." if i % 2 else "")
            if i % 45 == 2:
                text = re.sub(r"\W*\w+$", " The", text[: rnd.randint(60, len(text) - 40)])
                cut.add(i)
        docs.append((i, f"s{kind}", text))
    return docs, cut


@pytest.mark.parametrize("most_words", [1_000_000, 0])
def test_cut_texts(spark, monkeypatch, most_words):
    monkeypatch.setattr(truncation.word_endings, "__defaults__", (most_words,))
    docs, cut = _corpus()
    docs += [(9001, "s0", None), (9002, "s0", ""), (9003, None, "Whole text here."), (9004, "s1", "The valve turns a hol [...]"), (9005, "s0", "x" * 50_000 + ".")]
    d = spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id bigint, source string, text string, p_cut double")
    j = {r["doc_id"]: r["p_cut"] for r in truncation.judged(d).collect()}
    found = {i for i, p in j.items() if p > 0.5}
    assert len(j) == len(docs) and 9004 in found and not {9001, 9002, 9003, 9005} & found
    found -= {9004}
    assert len(found & cut) >= 0.95 * len(cut) and len(found & cut) >= 0.95 * len(found)


def test_rates(spark):
    d = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert truncation.cut_rates(truncation.judged(d)).count() == 0
    assert math.isclose(truncation._chance(2, 5), 1.0)


def _histogram(limits, shares, copies=0, n=20_000, seed=3):
    """Lengths of a log-normal source of which ``shares`` of the texts are cut at ``limits``."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        x, u = int(rnd.lognormvariate(7, 0.5)), rnd.random()
        for limit, share in zip(limits, shares):
            if u < share:
                x = min(x, limit)
                break
            u -= share
        out.append(x)
    return pd.Series(out + [777] * copies).value_counts().rename_axis("len").reset_index(name="n").assign(source="s", unit="chars")


@pytest.mark.parametrize("limits,shares", [((1500,), (1.0,)), ((1500,), (0.1,)), ((900, 1200, 1500, 1800, 2100), (0.1,) * 5), ((), ())])
def test_every_limit_is_found_and_no_other(limits, shares):
    found = truncation._limits(_histogram(limits, shares))
    assert sorted(found["limit_at"]) == list(limits) and (found["p_limit"] > 0.9).all()


def test_copies_make_no_limit(spark):
    rows = [("s", 700 + i % 400, 700 + i % 400, i) for i in range(4000)] + [("s", 777, 777, 1)] * 500
    shape = spark.createDataFrame(rows, "source string, n_chars int, n_bytes int, print bigint")
    assert truncation.length_limits(shape).count() == 0


def test_blanks_behind_a_cut(spark):
    whole = [(i, "s", f"The valve number {i} turns the lens. The rotor lifts a tray.") for i in range(60)]
    d = spark.createDataFrame([*whole, (900, "s", "The valve turns the lens. The rotor lifts a" + " \n" * 2500), (901, "s", whole[0][2] + " " * 5000)], "doc_id bigint, source string, text string")
    p = {r["doc_id"]: r["p_cut"] for r in truncation.judged(d).collect()}
    assert p[900] > 0.5 and p[901] < 0.5


def _found(spark, rows):
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    return {r["doc_id"] for r in truncation.judged(d).collect() if r["p_cut"] > 0.5}


def test_full_stops_of_abbreviations_end_no_text(spark):
    line = lambda i: f"As shown in FIG. {i}, the valve turns a lens, z. B. Glas, etc.\nThe rotor lifts a tray.\n"
    rows = [(i, "s", line(i) * 2 + f"The pump {i} cools a core.") for i in range(80)]
    rows += [(900, "s", line(1) + "As shown in FIG."), (901, "s", line(2) + "The valve turns a lens, z. B."), (902, "s", line(3) + "The rotor lifts a tray, etc.")]
    assert _found(spark, rows) == {900, 901}
    one_line = [(i, s, t.replace("\n", " ").strip()) for i, s, t in rows]
    assert _found(spark, one_line[:80]) == set()
    assert truncation.abbreviations(spark.createDataFrame([], "text string")).count() == 0


def test_a_cut_inside_a_word_may_leave_a_word(spark):
    # Half of the texts end without full stop; "plan" ends sentences elsewhere, and is the beginning of "plant".
    rows = [(i, "open", f"The valve {'x' * (i * 37 % 199)} turns a lens. Use of the pump in a small plant and in a steel plant" + "." * (i % 2)) for i in range(500)]
    rows += [(1000 + i, "other", f"The rotor {i} follows the plan. The core needs a plan.") for i in range(100)]
    rows += [(2000 + i, "open", f"The valve {'x' * i * 7} turns a lens. Use of the pump in a small pla") for i in range(20)]
    rows += [(3000, "open", "The valve 3000 turns a lens. Use of the pump in a small plant and in a steel plan")]
    assert _found(spark, rows) == {3000, *range(2000, 2020)}


def test_an_open_text_of_a_large_source_that_closes_all_others(spark):
    rows = [(i, "s", f"The valve {'x' * (i * 37 % 401)} turns a lens. The rotor lifts a tray by a lens.") for i in range(8000)]
    rows += [(9000 + i, "s", f"The valve {'x' * i * 7} turns a lens. The rotor lifts a") for i in range(20)]
    rows += [(9900, "s", "The valve 7 turns a lens. The rotor lifts a tray by a lens")]
    assert _found(spark, rows) == {9900, *range(9000, 9020)}
