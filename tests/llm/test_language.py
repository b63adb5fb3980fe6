import random

from storyloom.llm import language as m

LETTERS = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqré"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(rng, n=200):
    return [(k, text(rng, lang, rng.randint(3, 40)), lang) for k, lang in ((k, rng.choice(list(LETTERS))) for k in range(n))]


def test_learns_predicts_and_estimates_shares(spark):
    rng = random.Random(9)
    docs = rows(rng)
    train = spark.createDataFrame(docs + [(900, None, "aa"), (901, "abc", None)], "doc_id long, text string, lang string")
    model = m.learn(train.selectExpr("*", "1 AS n", "2 AS bucket"))
    assert model.languages == ["aa", "bb", "cc"]
    new = rows(rng, 50)
    mixed = (500, text(rng, "aa", 60) + " " + text(rng, "bb", 30), "aa")
    odd = [(600, None, ""), (601, "", ""), (602, "12 ½² $$$ –", ""), (603, "A", ""), (604, "É", ""), (None, new[0][1], ""), (0, new[0][1], ""), (605, text(rng, "cc", 50_000), "cc")]
    d = spark.createDataFrame(new + [mixed] + odd, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "'x' AS lang_pred", "0 AS score").repartition(3)
    got = {}
    for r in m.predict(d, model).collect():
        got.setdefault(r.doc_id, r)
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang in new)
    assert got[500].lang_pred == "aa" and abs(got[500].score - 2 / 3) < 0.05
    assert [got[k].lang_pred for k in (600, 601, 602)] == ["und"] * 3 and got[600].score == 0
    assert got[603].lang_pred == "aa" and got[604].lang_pred == "cc" and got[605].lang_pred == "cc"
    assert got[None].lang_pred == new[0][2]


def test_nothing_learned_and_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = m.learn(empty)
    d = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [tuple(r) for r in m.predict(d, model).collect()] == [(1, "und", 0.0)]
    assert m.predict(d.limit(0), model).count() == 0


def test_one_language(spark):
    one = m.learn(spark.createDataFrame([(1, "abc def", "aa")], "doc_id long, text string, lang string"))
    assert [tuple(r) for r in m.predict(spark.createDataFrame([(1, "xyz")], "doc_id long, text string"), one).collect()] == [(1, "aa", 1.0)]


def test_choice_does_not_depend_on_the_block():
    rng = random.Random(10)
    counts = {}
    for lang in LETTERS:
        import numpy as np

        n = np.bincount(m.trigrams(m.letters(text(rng, lang, 500)))[0], minlength=m.BUCKETS)
        counts[lang] = {int(k): int(n[k]) for k in np.flatnonzero(n)}
    model = m.Model(counts)
    texts = [m.letters(t) for _, t, _ in rows(rng, 40)] + [m.letters("a"), m.letters("ab gh")]
    together = m.choose(model, texts, 3.0)
    alone = [m.choose(model, [t], 3.0)[0] for t in texts]
    assert [a for a, _ in together] == [a for a, _ in alone]
    assert all(abs(x - y) < 0.01 for (_, x), (_, y) in zip(together, alone, strict=True))


def plain_choice(raw, log_p, languages, penalty=3.0, rounds=12):
    """(language, share) of one text of letters, word by word."""
    import math

    words = [" " + w + " " for w in raw.decode().split()]
    ll = []
    for w in words:
        b = w.encode()
        grams = [m.trigrams(b[k : k + 3])[0][0] for k in range(len(b) - 2)]
        ll.append([sum(log_p[lang][g] for g in grams) for lang in languages])
    p = [[math.exp(max(x - max(row), -60)) for x in row] for row in ll]

    def em(subset, shares):
        total = sum(shares[k] for k in subset)
        s = {k: shares[k] / total for k in subset}
        for _ in range(rounds):
            new = {k: 0.0 for k in subset}
            for row in p:
                z = sum(row[k] * s[k] for k in subset)
                for k in subset:
                    new[k] += row[k] * s[k] / max(z, 1e-30) / len(p)
            new = {k: max(v, 1e-9) for k, v in new.items()}
            new = {k: v / sum(new.values()) for k, v in new.items()}
            moved, s = max(abs(new[k] - s[k]) for k in subset), new
            if moved < 1e-3:
                break
        return s, sum(math.log(max(sum(row[k] * s[k] for k in subset), 1e-30)) for row in p)

    n = len(languages)
    alone = [sum(max(row[k] - max(row), -60) for row in ll) for k in range(n)]
    best = max(range(n), key=lambda k: (alone[k], -k))
    cost, pick, share = -alone[best], best, 1.0
    every, _ = em(range(n), [1 / n] * n)
    order = sorted(range(n), key=lambda k: -every[k])
    for size in range(2, n + 1):
        s, like = em(order[:size], every)
        now = -like + penalty * (size - 1) * math.log(len(p) + 1.0)
        if now >= cost:
            break
        cost, pick = now, max(sorted(s), key=lambda k: s[k])
        share = s[pick]
    return languages[pick], share


def test_predictions_match_a_plain_version(spark):
    import math
    from collections import Counter

    rng = random.Random(21)
    docs = rows(rng, 120)
    counts = {lang: Counter() for lang in LETTERS}
    for _, t, lang in docs:
        for w in t.split():
            b = f" {w} ".encode()
            counts[lang].update(int(m.trigrams(b[k : k + 3])[0][0]) for k in range(len(b) - 2))
    log_p = {}
    for lang, c in counts.items():
        total = sum(c.values()) + 0.5 * m.BUCKETS
        log_p[lang] = [math.log((c[k] + 0.5) / total) for k in range(m.BUCKETS)]
    model = m.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3))
    new = [(k, " ".join(text(rng, lang, rng.randint(1, 25)) for lang in rng.sample(list(LETTERS), rng.randint(1, 3)))) for k in range(40)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in m.predict(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    for i, t in new:
        lang, share = plain_choice(m.letters(t), log_p, sorted(LETTERS))
        assert got[i][0] == lang or abs(got[i][1] - share) < 0.01, (t, got[i], lang, share)
        assert abs(got[i][1] - share) < 0.02
