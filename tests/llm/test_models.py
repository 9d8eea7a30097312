"""Fitted operators: accuracy on rows they didn't learn from, and awkward rows."""

import numpy as np
import pytest
from fixtures import ROWS, frame
from pyspark.sql import functions as F

from edgeloom.llm import common, langid, quality, toxicity, wordbags

DATA = "/root/testdata/sf0.01"


def labelled(spark, name):
    return {r["doc_id"]: r[name] for r in common.table(spark, DATA, "labels").collect() if r[name] is not None}


def test_toxicity_held_out(spark):
    out, marks = toxicity.op7_toxicity(spark, DATA).collect(), labelled(spark, "toxic")
    assert len(out) == common.table(spark, DATA, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [(r["predicted"], marks[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([a == b for a, b in held]) >= 0.9


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (99, 1), (8, 1), (11, 0), (8, 0)], "doc_id long, toxic int")
    model = toxicity.learn(spark, frame(spark), labels)
    out = toxicity.score(frame(spark), model)
    assert out.columns == [*frame(spark).columns, "toxicity"]
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r["toxicity"] == 0 for r in rows if not (r["text"] or "").strip())
    assert toxicity.learn(spark, frame(spark), labels.limit(0)) is None
    assert [r["toxicity"] for r in toxicity.score(frame(spark, ROWS[:2]), None).collect()] == [0, 0]
    assert toxicity.score(frame(spark, []), model).collect() == []


def test_toxicity_shares_vectors_with_misspellings():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    texts, marks = [], []
    for i in range(300):
        t = list(rng.choice(words, 30))
        if i % 3 == 0:
            t[int(rng.integers(30))] = "zorgblatt"
        texts.append(" ".join(t))
        marks.append(int(i % 3 == 0))
    model = toxicity.fit(texts, marks)
    table = wordbags.WordTable(model.values)

    def score(t):
        (rows,) = table.rows([toxicity.split(t)])
        return model.score(model.log_odds(table.values[rows]))

    clean = " ".join(rng.choice(words, 200))
    assert score(clean) < 0.5 < min(score(f"{clean} zorgblatt {clean}"), score(f"{clean} zorgblattt {clean}"))


def test_quality_held_out(spark):
    out, marks = quality.op5_quality(spark, DATA).collect(), labelled(spark, "quality")
    assert len(out) == common.table(spark, DATA, "documents").count()
    held = [(int(r["kept"]), marks[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([a == b for a, b in held]) >= 0.9


def test_quality_is_ordinal():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 4, 400)
    texts = [" ".join(["good"] * int(g) * 5 + ["bad"] * (15 - int(g) * 5) + [f"n{rng.integers(50)}" for _ in range(15)]) for g in grades]
    m = quality.fit(texts, grades.tolist())
    assert (np.diff(m.thresholds) > 0).all() and m.grades == [0, 1, 2, 3]
    table = wordbags.WordTable(m.values)
    means = []
    for g in range(4):
        (r,) = table.rows([(" ".join(["good"] * g * 5 + ["bad"] * (15 - g * 5) + [f"n{i}" for i in range(15)])).split()])
        p = m.probabilities(m.f(r, table.values))
        assert (np.diff(p) <= 0).all()
        means.append(p.sum())
    assert means == sorted(means) and abs(means[3] - 3) < 0.5 and means[0] < 0.5


def test_quality_edges(spark):
    ratings = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (99, 0), (8, 0), (11, 2)], "doc_id long, quality int")
    model = quality.learn(spark, frame(spark), ratings)
    out = quality.score(frame(spark), model)
    assert out.columns == [*frame(spark).columns, "expected_grade", "tail_probability"]
    assert len(out.collect()) == len(ROWS) and out.filter(~F.col("tail_probability").between(0, 1)).count() == 0
    assert quality.learn(spark, frame(spark), ratings.filter("quality = 1")) is None
    assert {r["tail_probability"] for r in quality.score(frame(spark), None).collect()} == {1.0}
    assert quality.score(frame(spark, []), model).collect() == []


def test_langid_held_out(spark):
    out = langid.op6_langid(spark, DATA).collect()
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in common.table(spark, DATA, "documents").select("doc_id", "lang", "text").collect()}
    assert len(out) == len(lang)
    held = [(r["lang_pred"], lang[r["doc_id"]][0]) for r in out if r["held_out"] and lang[r["doc_id"]][0] is not None and langid.LETTER.search(lang[r["doc_id"]][1] or "")]
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_langid_edges(spark):
    model = langid.learn(frame(spark))
    out = langid.predict(frame(spark), model)
    assert out.columns == [*frame(spark).columns, "lang_pred", "lang_score"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r["lang_pred"] == "und") == (not langid.LETTER.search(r["text"] or ""))
    assert langid.learn(frame(spark, [])) is None
    assert {r["lang_pred"] for r in langid.predict(frame(spark), None).collect()} == {"und"}


def test_langid_weights_are_sparse():
    texts = ["der die das und nicht"] * 40 + ["the and of with not"] * 40
    m = langid.fit(texts, ["de"] * 40 + ["en"] * 40, np.zeros(1 << langid.BITS, np.int64), 80)
    assert (m.weight != 0).mean() < 0.01
    table = wordbags.WordTable(m.values)
    (rows,) = table.rows([["und", "das"]])
    assert m.predict(table.values[rows])[0] == "de"


@pytest.mark.parametrize("rows", [1, 50])
def test_samples_are_bounded(spark, rows):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert wordbags.sample(df, rows).count() == rows
    one_id = spark.range(5000).select(F.lit(3).alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert wordbags.sample(one_id, rows).count() == rows
    assert wordbags.sample(one_id.select("doc_id"), rows).count() <= 1  # repeated rows count once
    assert sorted(r[1] for r in wordbags.sample(one_id.limit(40), 50).collect()) == sorted(str(i) for i in range(40))


def test_repeated_ids_do_not_outgrow_the_samples(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, toxic int, quality int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, marks: seen.append(len(texts)))
    monkeypatch.setattr(quality, "fit_bags", lambda bags, grades: seen.append(len(bags)))
    monkeypatch.setattr(langid, "fit_counts", lambda bags, langs, f, n: seen.append((len(bags), n)))
    toxicity.learn(spark, docs, labels, 4)
    quality.learn(spark, docs, labels, rows=30)
    langid.learn(docs, 25)
    assert seen == [20, 30, (25, 3000)]


def test_rows_without_an_id_are_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert all(r[0] is not None for r in df.select(common.held_out("doc_id", 5, 0)).collect())
    assert df.filter("doc_id is null").select(common.held_out("doc_id", 4, 2)).first()[0] is False


def test_long_texts_are_learned_from(spark):
    """No text is too long for the fit: the only toxic and the only bad text have 90,000 words."""
    long = " ".join(f"w{i % 5000}" for i in range(90_000))
    docs = spark.createDataFrame([(1, long + " zorgblatt" * 9), *((i, f"w{i} w{i + 1} w{i + 2} good") for i in range(2, 40))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1), int(i != 1)) for i in range(1, 40)], "doc_id long, toxic int, quality int")
    assert toxicity.learn(spark, docs, labels) is not None
    assert quality.learn(spark, docs, labels).grades == [0, 1]


def test_quality_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    f, y, theta = rng.normal(size=30), rng.integers(0, 4, 30), np.array([-0.7, -0.2, 0.4])

    def loss(f, theta):
        t, total = [theta[0]], 0.0
        for x in theta[1:]:
            t.append(t[-1] + np.exp(x))
        for a, k in zip(f, y, strict=True):
            above = [1.0, *(1 / (1 + np.exp(c - a)) for c in t), 0.0]
            total -= np.log(above[k] - above[k + 1])
        return total / len(f)

    by_f, by_theta = quality.gradient(f, y, theta)
    step = 1e-6
    for i in range(len(f)):
        e = np.eye(len(f))[i] * step
        assert abs((loss(f + e, theta) - loss(f - e, theta)) / (2 * step) - by_f[i]) < 1e-6
    for i in range(3):
        e = np.eye(3)[i] * step
        assert abs((loss(f, theta + e) - loss(f, theta - e)) / (2 * step) - by_theta[i]) < 1e-6


def test_quality_score_by_loops(spark):
    words = "the THE!! good good 42 x-ray the".split()
    rng = np.random.default_rng(4)
    m = quality.Model(rng.normal(size=1 << quality.BITS), np.array([-0.5, 0.3]), [1, 2, 5])
    f = 0.0
    for i, w in enumerate(words):
        f += sum(m.weight[b] for b in quality.buckets([w])[0]) + (m.weight[quality.REPEAT] if i and w == words[i - 1] else 0)
    f *= quality.SCALE / len(words)
    k, v = quality.bag(words)
    assert abs(f - m.weight[k] @ v) < 1e-9
    p = [1 / (1 + np.exp(t - f)) for t in m.thresholds]
    row = quality.score(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), m).first()
    assert abs(row["tail_probability"] - p[0]) < 1e-9 and abs(row["expected_grade"] - (1 + p[0] * 1 + p[1] * 3)) < 1e-9


def test_ftrl_one_coordinate_at_a_time():
    rng = np.random.default_rng(6)
    bags = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(30)]
    y = rng.integers(0, 3, 30)
    weight, bias = langid.ftrl(bags, y, 3)
    z, n, b, order = {}, {}, [0.0] * 3, np.random.default_rng(langid.SEED)

    def at(i, k):
        zi, ni = z.get((i, k), 0.0), n.get((i, k), 0.0)
        return 0.0 if abs(zi) <= langid.L1 else -(zi - np.sign(zi) * langid.L1) / ((langid.BETA + ni**0.5) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for j in order.permutation(30):
            keys, x = bags[j]
            w = {(i, k): at(i, k) for i in keys.tolist() for k in range(3)}
            logit = [sum(v * w[i, k] for i, v in zip(keys.tolist(), x.tolist(), strict=True)) + b[k] for k in range(3)]
            e = [np.exp(v - max(logit)) for v in logit]
            for k in range(3):
                d = e[k] / sum(e) - (k == y[j])
                for i, v in zip(keys.tolist(), x.tolist(), strict=True):
                    g, old = v * d, n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / langid.ALPHA * w[i, k]
                    n[i, k] = old + g * g
                b[k] -= 0.01 * d
    assert np.allclose(bias, b) and (weight == 0).mean() > 0.99
    for i in range(40):
        for k in range(3):
            assert abs(weight[i, k] - at(i, k)) < 1e-9


def test_langid_scores_by_loops(spark):
    text = "Der Hund und die Katze und der Hund"
    frequency = np.random.default_rng(1).integers(0, 9, 1 << langid.BITS)
    m = langid.fit(["der die das und", "the and of with"] * 9, ["de", "en"] * 9, frequency, 20)
    total = np.zeros(2)
    grams = [g for w in text.lower().split() for n in (1, 2, 3) for g in [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]]
    for w in text.lower().split():
        b, _ = wordbags.grams([w], langid.LOW, langid.HIGH, langid.BITS)
        for x in b:
            total += m.weight[x]
    logit = (langid.SCALE * total / len(grams) + m.bias) / m.temperature
    p = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
    row = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), m).first()
    assert row["lang_pred"] == m.languages[int(p.argmax())] and abs(row["lang_score"] - p.max()) < 1e-9


def test_toxicity_score_by_loops(spark):
    """The embedding average of each window, through the softmax; the mean of the top windows."""
    rng = np.random.default_rng(2)
    table, soft, bias = rng.normal(size=(1 << toxicity.BITS, toxicity.DIM)), rng.normal(size=(toxicity.DIM, 2)), rng.normal(size=2)
    m = toxicity.Model(table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]), 0.7, 0.4)
    for words in (["one"], "one two, three".split(), [f"w{i % 7}{i}" for i in range(23)]):
        odds = []
        for i in range(0, max(1, len(words) - 2), 2):
            buckets = [b for w in words[i : i + 4] for b in wordbags.grams(wordbags.bare([w]), 3, 5, toxicity.BITS)[0]]
            mean = sum(table[b] for b in buckets) / max(len(buckets), 1)
            logit = mean @ soft + bias
            odds.append(logit[1] - logit[0])
        top = sorted(odds)[-toxicity.TOP :]
        want = 1 / (1 + np.exp(-0.7 * (sum(top) / len(top) - 0.4)))
        row = toxicity.score(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), m).first()
        assert abs(row["toxicity"] - want) < 1e-9


def test_toxicity_of_a_rare_language():
    """A twentieth of the toxic texts are of another language, told by compounds with one stem; new compounds are found."""
    rng = np.random.default_rng(9)
    vocabulary = [["".join(rng.choice(list(letters), 6)) for _ in range(300)] for letters in ("abcdefghij", "klmnopqrst")]
    texts, marks = [], []
    for i in range(900):
        k, toxic = int(i % 10 == 0), int(i % 3 == 0)
        t = list(rng.choice(vocabulary[k], 40))
        for _ in range(3 if toxic else 0):
            t[int(rng.integers(40))] = f"bomente{rng.choice(vocabulary[1])[:3]}" if k else rng.choice(["zorgblatt", "quimbo"])
        texts.append(" ".join(t))
        marks.append(toxic)
    model = toxicity.fit(texts, marks)
    table = wordbags.WordTable(model.values)

    def score(words):
        (rows,) = table.rows([words])
        return model.score(model.log_odds(table.values[rows]))

    for _ in range(10):
        clean = list(rng.choice(vocabulary[1], 60))
        assert score(clean) < 0.5
        clean[20], clean[40] = (f"bomente{''.join(rng.choice(list('klmnopqrst'), 4))}" for _ in range(2))
        assert score(clean) > 0.5
