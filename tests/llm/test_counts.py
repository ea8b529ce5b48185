"""Quality rules, language-model scoring, language identification and toxicity."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from placelens.llm import language_id, lm_scoring, quality_rules, toxicity
from placelens.llm.common import table
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    held = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1 if len(windows) < 3000 else False:
            held |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(held)


@pytest.mark.parametrize("text", [None, "", " \n ", "a b c a b c d", "x x x x", "l m\nl m\n\nl m\r\n", "# * $ % é|<>", "a b c d a b c d e f g a b c"])
def test_base_counts(text):
    assert quality_rules.measure(text)[:5] == brute_counts(text)


def test_base_counts_of_documents(spark, sf):
    rows = table(spark, sf, "documents").filter("n_chars < 6000 AND doc_id % 7 = 0").select("text").collect()
    assert len(rows) > 50
    for r in rows:
        assert quality_rules.measure(r["text"])[:5] == brute_counts(r["text"])


def test_binomial_tail():
    n, p = 60, 0.07
    for k in (0, 3, 10):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(quality_rules.log_binomial_tail(k, n, p)), exact, rel_tol=1e-9)


def test_safe_cutoff_stops_at_first_failure():
    assert quality_rules.safe_cutoff([0, 0, 500, 0], 1000, 0.05, 0.01) == 2
    assert quality_rules.safe_cutoff([0], 10, 0.05, 0.01) == 0  # too few labels
    assert quality_rules.safe_cutoff([], 10, 0.05, 0.01) == 0


def test_rules_reject_junk_and_keep_good(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en") for i in range(3000)]
    junk = [(10_000 + i, " ".join(f"w{i}x{j}%%%" for j in range(80)), "en") for i in range(200)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1) for i in range(3000)] + [(10_000 + i, 0) for i in range(100)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, marks).collect()}
    assert sum(not got[i]["kept"] for i in range(3000)) <= 0.02 * 3000
    assert all(not got[10_000 + i]["kept"] and "symbols" in got[10_000 + i]["broken"] for i in range(200))


def test_cutoffs_by_brute_force(spark):
    """Every stratum of many, against a search over exact tails in fractions of integers."""
    import random
    from fractions import Fraction

    rng = random.Random(7)
    rules = quality_rules.RULES
    rows = [(f"s{s}", *(rng.choice((0, 0, 0, rng.randrange(len(g) + 1))) if rng.random() < 0.15 * s else 0 for _, g in rules.values())) for s in range(3) for _ in range(700)]
    rows += [(f"t{s}", *[0] * len(rules)) for s in range(1200)]
    marked = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{r} int" for r in rules))
    got = {r["stratum"]: r for r in quality_rules.calibrate(marked, 0.3, 0.05).collect()}
    assert len(got) == 1203
    p, level = Fraction(0.3 / len(rules)), 0.05 / (len(rules) * 1203)
    for s in ("s0", "s1", "s2", "t7"):
        own = [r for r in rows if r[0] == s]
        n = len(own)
        for j, (rule, (_, grid)) in enumerate(rules.items(), 1):
            want = 0
            for c in range(1, len(grid) + 1):  # the c-th cutoff from the lenient end rejects what breaks more than g - c
                k = sum(r[j] > len(grid) - c for r in own)
                if sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > level:
                    break
                want = c
            assert got[s][f"safe_{rule}"] == want
    assert any(got[s][f"safe_{r}"] not in (0, len(g)) for s in ("s1", "s2") for r, (_, g) in rules.items())


def test_quality_rules_edges(odd, odd_rows, empty, labels):
    got = quality_rules.quality_rules(odd, labels).collect()
    assert len(got) == len(odd_rows)
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert quality_rules.quality_rules(empty, labels).collect() == []


def test_lm_models_are_distributions():
    import numpy as np

    c = np.array([[0.0, 3, 1], [2, 0, 0], [0, 0, 0]])
    first, kinds = c.sum(axis=1), (c > 0).sum(axis=1)
    for kept in (1.0, 0.3):
        for v in range(3):
            p = np.exp(-lm_scoring.loss(c[v], first[v], lm_scoring.seen(c[v], kept).sum(), c.sum(axis=0), c.sum(), kept, 3, 0.75))
            assert math.isclose(p.sum(), 1, abs_tol=1e-12)
    assert (lm_scoring.seen(c, 1.0).sum(axis=1) == kinds).all()


def test_lm_scoring_prefers_target(spark):
    docs = spark.createDataFrame([(i, ("the cat sat on the mat " if i % 2 else "buy cheap pills now online ") * 5) for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.cross_entropy_difference(docs, marks).collect()}
    assert max(got[i] for i in got if i % 2) < min(got[i] for i in got if not i % 2)


def test_lm_scoring_labels_do_not_leak(spark, sf):
    """Good documents score alike whether their labels were learnt from or left out."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    half = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)) == 0
    got = lm_scoring.cross_entropy_difference(docs, labels.filter(half)).join(labels.filter("quality = 1").withColumn("half", half), "doc_id")
    middle = {r["half"]: r["m"] for r in got.groupBy("half").agg(F.median("score").alias("m")).collect()}  # copies weigh on means
    assert abs(middle[True] - middle[False]) < 0.05


@pytest.mark.parametrize("chunk", [400, 1_000_000])
def test_lm_scoring_counts_every_word_and_pair(spark, chunk):
    import random
    from collections import Counter

    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(rng.choice((20, 4000)))}" for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(1000, "w1 zebra w1"), (1001, "w1 quokka w1"), (1000, "w1 zebra w1"), (None, "w1 zebra"), (1002, None), (1003, " ")]
    rows.append((1004, "w1 quokka"))
    good = {i for i, _ in rows if i is not None and (i % 3 == 0 or i == 1004)}
    pairs = [Counter(zip([" ", *(t or "").split()], (t or "").split())) for _, t in rows]
    known = len({b for p in pairs for _, b in p}) + 1
    lengths = [len((t or "").split()) for _, t in rows]
    kept = [sum(n for n, (i, _) in zip(lengths, rows) if i in good) / sum(lengths), 1.0]
    assert known > 1100

    def loss(at, m):
        """By the definition: counts of all other documents."""
        pair, first, second, kinds = (Counter() for _ in range(4))
        for k, (i, _) in enumerate(rows):
            if k != at and (not m or i in good):
                pair.update(pairs[k])
        for (a, b), n in pair.items():
            first[a] += n
            second[b] += n
            kinds[a] += 1 - (1 - kept[m]) ** n
        mass, total = sum(pair.values()), 0.0
        for (a, b), n in pairs[at].items():
            r = kept[m]
            word = (r * second[b] + 0.5) / (r * mass + 0.5 * known)
            p = (r * pair[a, b] - 0.75 * (1 - (1 - r) ** pair[a, b]) + 0.75 * kinds[a] * word) / (r * first[a]) if first[a] else word
            total -= n * math.log(p)
        return total / max(sum(pairs[at].values()), 1)

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, 1) for i in good], "doc_id long, quality int")
    got = lm_scoring.cross_entropy_difference(docs, marks, chunk=chunk).collect()
    want = sorted((-1 if i is None else i, len((t or "").split()), loss(k, 1), loss(k, 0)) for k, (i, t) in enumerate(rows))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["loss_target"], r["loss_background"]) for r in got)
    assert len(got) == len(want)
    assert all(g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=1e-9) for g, w in zip(got, want))
    by = {g[0]: g[2] - g[3] for g in got}
    assert abs(by[1000] - by[1001]) > 0.01  # they differ in rare words of one shape only


def test_lm_scoring_edges(odd, odd_rows, empty, labels):
    got = lm_scoring.cross_entropy_difference(odd, labels).collect()
    assert len(got) == len(odd_rows)
    assert all(r["score"] == 0 for r in got if r["n_tokens"] == 0)
    assert all(math.isfinite(r["score"]) for r in got)
    assert lm_scoring.cross_entropy_difference(empty, labels).collect() == []
    assert all(r["score"] == 0 for r in lm_scoring.cross_entropy_difference(odd, labels.filter("false")).collect())


def test_language_accuracy_on_held_out(spark, sf):
    docs = table(spark, sf, "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.avg(F.col("rejected").cast("double")).alias("r"), F.count("*").alias("n")).first()
    assert r["n"] > 150 and r["a"] > 0.97 and r["r"] < 0.03


def test_language_ignores_lang_of_held_out(spark, sf):
    docs = table(spark, sf, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = ({(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(d).collect()} for d in (docs, other))
    assert a == b


def test_language_sample_holds_every_language_beside_copies(spark):
    copies = [(i, "der hund geht heute in den wald und kommt nicht mehr", "aa") for i in range(3000)]
    others = [(10_000 + 100 * k + i, f"{w} {i} {w}{i % 7} {w[::-1]}", lang) for k, (lang, w) in enumerate([("bb", "casa grande verde"), ("cc", "maison petite bleue")]) for i in range(40)]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string, lang string").coalesce(1).sortWithinPartitions("lang")
    for seed in range(3):
        model = language_id.fit(docs, per_language=20, sample=60, seed=seed)
        assert set(model["langs"]) == {"aa", "bb", "cc"}
        found = {r["doc_id"]: r["__lang_pred"] for r in language_id.predict(docs, model, ("doc_id",)).filter("doc_id >= 10000").collect()}
        assert sum(found[i] == lang for i, _, lang in others) > 0.9 * len(others)


def test_language_learns_every_language(spark):
    stems = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + (i * 7) % 26)}" for i in range(230)]
    docs = spark.createDataFrame([(5 * i + j, " ".join(f"{w}{'xyz'[(j + k) % 3]}" for k in range(6)), f"l{i}") for i, w in enumerate(stems) for j in range(5)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    learnt = {r["lang"] for r in docs.filter(language_id.fold_of(4) != 2).select("lang").distinct().collect()}
    assert set(model["langs"]) == learnt and len(learnt) > 200
    found = language_id.predict(docs, model, ("lang",)).collect()
    assert sum(r["lang"] == r["__lang_pred"] for r in found) > 0.9 * len(found)


def test_language_nearest_centroid_by_brute_force(spark, sf):
    """Cosines to every centroid, written out by definition."""
    import numpy as np

    docs = table(spark, sf, "documents")
    model = language_id.fit(docs)
    got = {r["doc_id"]: (r["__lang_pred"], r["__score"]) for r in language_id.predict(docs, model, ("doc_id",)).collect()}
    for r in docs.filter("n_chars < 3000").limit(40).collect():
        letters = "".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in r["text"].lower())
        raw = f" {' '.join(letters.split(' '))} ".encode()
        while b"  " in raw:
            raw = raw.replace(b"  ", b" ")
        v = np.zeros(language_id.DIM)
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            v[((a | b << 8 | c << 16) * 2654435761 % 2**32) >> (32 - language_id.DIM_BITS)] += 1
        v = np.log(1 + v) * model["idf"]
        cos = [float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)) for c in model["centroids"]]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert got[r["doc_id"]][0] == model["langs"][model["of"][best]] and got[r["doc_id"]][1] == pytest.approx(cos[best], abs=1e-5)


def test_language_rejects_text_unlike_all_languages(spark):
    texts = [f"der hund geht heute {w} in den wald" for w in ("nicht", "noch", "wieder", "gern", "allein", "oft", "selten", "schnell")]
    docs = spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert (model["floors"] > 0).all()
    other = spark.createDataFrame([(100, "qxzv jqkx zzyq"), (101, "qxzv jqkx zzyq vvxk " * 40), (102, texts[0])], "doc_id long, text string")
    got = {r["doc_id"]: r["__rejected"] for r in language_id.predict(other, model, ("doc_id",)).collect()}
    assert got == {100: True, 101: True, 102: False}


def test_language_columns_whose_names_clash(spark, odd):
    clash = odd.withColumns({"__rejected": F.lit(True), "__LANG_pred": F.lit("x"), "__score": F.lit("y")})
    got = language_id.accepted(clash)
    assert got.columns == clash.columns and sorted(got.select("doc_id", "text").collect(), key=repr) == sorted(language_id.accepted(odd).select("doc_id", "text").collect(), key=repr)


def test_language_edges(odd, odd_rows, empty):
    got = language_id.identify(odd).collect()
    assert len(got) == len(odd_rows)
    none = [r for r in got if r["doc_id"] in (4, 5, 6, 11, 13)]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in none)
    assert all(r["lang_pred"] in ("en", "fr") and 0 <= r["score"] <= 1 for r in got if r["doc_id"] in (1, 2, 3, 7, 8))
    assert language_id.identify(empty).collect() == []
    assert language_id.accepted(odd).columns == odd.columns


def test_toxicity_finds_planted_words(spark):
    import random

    rng = random.Random(4)
    rows, marks = [], []
    for i in range(2000):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 300))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "filth", "brute"]) + rng.choice(["", ",", "."])
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 300
    hits = [r for r in got if r["toxic"] == 1]
    assert sum(r["predicted"] for r in hits) >= 0.9 * len(hits)
    assert sum(r["predicted"] for r in got if r["toxic"] == 0) <= 0.02 * len(got)


@pytest.mark.parametrize(("lent", "classes"), [(2.0, 2), (0.75, 2), (5.0, 2), (2.0, 1)])
def test_toxicity_models_are_kneser_ney(spark, lent, classes):
    """Written out for every context and word: each class is a distribution after every word, and evidence is by definition."""
    import random

    rng = random.Random(6)
    rows = [(" ".join(f"w{int(rng.random() ** 2 * 12)}" for _ in range(rng.randrange(1, 9))), int(classes == 2 and i % 5 == 0)) for i in range(60)]
    one, two = toxicity.models(toxicity.pair_counts(spark.createDataFrame(rows, "text string, toxic int").repartition(3)), lent)
    model = dict(zip(one.columns, toxicity.sorted_columns(one), strict=True)) | dict(zip(two.columns, toxicity.sorted_columns(two), strict=True))
    d, pairs = toxicity.DISCOUNT, [Counter(), Counter()]
    for text, y in rows:
        w = text.split()
        pairs[y].update(zip(["<"] + w, w))
    vocabulary = sorted({w for p in pairs for _, w in p})
    seen = set(pairs[0]) | set(pairs[1])
    contexts = {w: sum(x == w for p in pairs for _, x in p) for w in vocabulary}
    total = [sum(p.values()) for p in pairs]
    part = [t / sum(total) for t in total]
    shared = {w: c / sum(contexts.values()) for w, c in contexts.items()}
    prob = [{}, {}]
    for y in (0, 1):
        count = {w: sum(n for (_, x), n in pairs[y].items() if x == w) for w in vocabulary}
        whole = total[y] + lent * part[y] * len(vocabulary)
        word = {w: (count[w] + (lent - d) * part[y] + d * part[y] * len(vocabulary) * shared[w]) / whole if part[y] else shared[w] for w in vocabulary}
        for v in {v for v, _ in seen}:
            kinds = [w for w in vocabulary if (v, w) in seen]
            size = sum(pairs[y][v, w] for w in kinds) + lent * part[y] * len(kinds)
            for w in vocabulary:
                held = (pairs[y][v, w] + (lent - d) * part[y]) / size if part[y] and w in kinds else 0
                prob[y][v, w] = held + (d * part[y] * len(kinds) / size if part[y] else 1) * word[w]
            assert sum(prob[y][v, w] for w in vocabulary) == pytest.approx(1)
    ratio = {k: math.log(prob[1][k] / prob[0][k]) for k in prob[0]}
    for text in ("w0 w3 w1", "w11 w11 w0 w2 w5", "", None, "w1 strange w2"):
        w = (text or "").split()
        (peak,), (mean,), (n,) = toxicity.evidence(model, [text])
        assert n == len(w)
        if w and "strange" not in w:
            own = [ratio[p] for p in zip(["<"] + w, w, strict=False)] if all(v in {v for v, _ in seen} for v in ["<"] + w[:-1]) else None
            if own:
                assert mean == pytest.approx(sum(own) / len(own), abs=1e-5) and peak == pytest.approx(math.log(sum(map(math.exp, own)) / len(own)), abs=1e-5)
    assert [float(x[0]) for x in toxicity.evidence(model, ["strange"])[1:]] == pytest.approx([looked(model, toxicity.START), 1], abs=1e-5)


def looked(model, word):
    """The log ratio of backing off from a word: all that an unknown word after it tells."""
    return float(toxicity.looked_up(model["word"], model["back"], np.array([word]))[0])


def test_toxicity_edges(odd, odd_rows, empty, labels):
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.toxicity(empty, labels).collect() == []
    assert len(toxicity.toxicity(odd, labels.filter("false")).collect()) == len(odd_rows)
