import itertools
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import archive, ledger, normalize, similarity, stories
from storyloom.operators.components import connected_components

T0 = datetime(2026, 8, 11, 12)
AS_OF = F.lit("2026-08-11 12:00:00").cast("timestamp")
ARTICLE = "id string, title string, snippet string, url string, source_id string, source_name string, publisher string, source_tier string, published_at timestamp"


def article(i, title, hours=1.0, source="s1", publisher="p1", tier="major", snippet="", url=None):
    return (i, title, snippet, url or f"https://x/{i}", source, source.upper(), publisher, tier, T0 - timedelta(hours=hours))


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(5, 5), (None, 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_near_duplicates_compare_with_kept_ones_only(spark):
    words = [f"w{k}" for k in range(40)]
    chain = [" ".join(words[k : k + 30]) for k in (0, 2, 4)]  # each like the next, the ends less
    rows = [article(str(k), t, 10 - k) for k, t in enumerate(chain)]
    rows += [article("x", "Same words here now", 5, "s1", "p1"), article("y", "Same words here now", 4, "s2", "p1"), article("z", "Same words here now", 3, "s3", "p2"), article("e1", "é", 2), article("e2", "é", 1)]
    rows += [article("n", "Same words here now", 2, "s9", "")]
    got = {r.id for r in similarity.near_duplicates(spark.createDataFrame(rows, ARTICLE).repartition(4)).collect()}
    assert got == {"0", "2", "x", "z", "e1", "e2", "n"}


@pytest.mark.parametrize("hours", [None, 18])
@pytest.mark.parametrize("threshold", [0.2, 0.5, 1.0])
def test_jaccard_pairs_match_all_pairs(spark, hours, threshold):
    rng = random.Random(2)
    rows = [(k, T0 + timedelta(hours=rng.randint(0, 80)), sorted({rng.choice("abcdefghij") + str(rng.randint(0, 1)) for _ in range(rng.randint(0, 7))})) for k in range(80)]
    got = {(r.a, r.b): r.sim for r in similarity.jaccard_pairs(spark.createDataFrame(rows, "id long, published_at timestamp, grams array<string>").repartition(3), threshold, hours).collect()}
    want = {}
    for (a, ta, ga), (b, tb, gb) in itertools.combinations(rows, 2):
        sim = len(set(ga) & set(gb)) / len(set(ga) | set(gb)) if ga and gb else 0
        if sim >= threshold and (hours is None or abs(ta - tb) <= timedelta(hours=hours)):
            want[a, b] = sim
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_near_duplicates_of_large_mastheads_match_the_fold(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(12)]
    rows = [article(f"a{k:03}", " ".join(words[j : j + 9]) + rng.choice(["", " x", " y z"]) if k % 4 else rng.choice(["", "é", "same old title"]), rng.randint(0, 50), "s", f"p{k % 2}" if k % 9 else None)
            for k in range(160) for j in [rng.randint(0, 4)]]
    d = spark.createDataFrame(rows, ARTICLE).repartition(3)
    kept = lambda n: sorted(r.id for r in similarity.near_duplicates(d, 0.7, fold_articles=n).collect())
    assert kept(60) == kept(500) == kept(1) and 20 < len(kept(500)) < 140


@pytest.mark.parametrize("hours", [None, 18])
def test_similar_classes_connect_what_pairs_do(spark, hours):
    rng = random.Random(9)
    rows = [(k, T0 + timedelta(hours=rng.randint(0, 200)), rng.choice(["hot", "a", "b"]), [rng.choice("abcdef") for _ in range(rng.randint(0, 5))] + [None] * (k % 2)) for k in range(150)]
    rows += [(1000 + k, T0 + timedelta(hours=k), "hot", ["x", "y", "z"]) for k in range(300)]
    d = spark.createDataFrame(rows, "id long, published_at timestamp, scope string, grams array<string>").repartition(3)
    members, pairs = similarity.similar_sets(d, 0.6, hours, ("scope",))
    members, pairs = members.collect(), pairs.collect()
    sets = {r[0]: frozenset(x for x in r[3] if x) for r in rows}
    at, scope = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    links = {(a, b) for a in sets for b in sets if a < b and scope[a] == scope[b] and sets[a] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])
             and (not hours or abs(at[a] - at[b]) <= timedelta(hours=hours))}
    of = {r.id: r.class_id for r in members}
    assert sorted(of) == sorted(i for i in sets if sets[i])
    held = {c: [i for i in of if of[i] == c] for c in of.values()}
    assert all(min(held[c]) == c and r.n == len(held[c]) for r in members for c in [r.class_id])
    # Rows of one class have equal grams, and classes are paired exactly if some of their rows are linked.
    assert all(sets[i] == sets[c] for i, c in of.items())
    got = {(r.a, r.b): (r.sim, r.n_a, r.n_b) for r in pairs}
    assert len(got) == len(pairs)
    want = {tuple(sorted((of[a], of[b]))) for a, b in links if of[a] != of[b]}
    assert set(got) == want
    assert got == {(a, b): (pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b])), len(held[a]), len(held[b])) for a, b in want}
    # Equal ones in different classes aren't linked through others of their grams.
    for a, b in links:
        if sets[a] == sets[b]:
            assert of[a] == of[b]


def test_cosine_pairs_match_all_pairs(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], T0 + timedelta(hours=rng.randint(0, 60))) for k in range(90)] + [(100, [0.0] * 4, T0)]
    d = spark.createDataFrame(rows, "id long, v array<double>, published_at timestamp")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) if any(a) and any(b) else 0
    for hours in (None, 18):
        got = {(r.a, r.b) for r in similarity.cosine_pairs(d, 0.8, hours, block_rows=20).collect()}
        assert got == {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if cos(a[1], b[1]) >= 0.8 and (hours is None or abs(a[2] - b[2]) <= timedelta(hours=hours))}


def test_tfidf_shortens_rows_by_extra_stop_words(spark):
    d = spark.createDataFrame([(1, "gold rises today"), (2, "gold falls"), (3, "oil falls today")], "id long, text string")
    w = {(r.id, r.term): r.w for r in similarity.tfidf(d, extra_stop_words=("today",), max_df=0.9).collect()}
    assert (1, "today") not in w and (1, "rises today") in w
    assert sum(v * v for (i, _), v in w.items() if i == 2) == pytest.approx(1) and sum(v * v for (i, _), v in w.items() if i == 1) < 1
    assert similarity.tfidf_pairs(similarity.tfidf(d.limit(2)), 0.01).count() == 0  # with two rows a shared term is in more than 0.6


def story_rows(spark, rows, pairs=()):
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n long, " + ARTICLE)
    return stories.stories(stories.assign_stories(d, spark.createDataFrame(list(pairs), "a long, b long"), "n"))


def test_stories_lead_counts_and_ids(spark):
    rows = [article("b", "Later", 1, "s2", "p1"), article("a", "First", 2, "s1", "p1"), article("c", "Other", 3, "s3", "")]
    got = {r.lead_id: r for r in story_rows(spark, rows, [(0, 1)]).collect()}
    assert set(got) == {"a", "c"} and got["a"].headline == "First" and [x.id for x in got["a"].articles] == ["a", "b"]
    assert (got["a"].n_publishers, got["a"].n_feeds, got["a"].n_articles) == (1, 2, 2) and got["c"].articles[0].masthead == "s3"
    import hashlib

    assert got["a"].story_id == hashlib.sha1(b"cluster:a").hexdigest()[:12]


def test_tags_follow_the_watchlist(spark):
    labels = [stories.Label("themes", "Inflation", ["CPI"]), stories.Label("institutions", "Fed", ["FOMC"]), stories.Label("companies", "ITC", ["ITC"], None, "ITC"), stories.Label("indices", "Index", ["S&P 500"]), stories.Label("sectors", "Banks", ["bank"])]
    rows = story_rows(spark, [article("a", "ITC and the S&P 500", snippet="after FOMC, cpi"), article("b", "switch banker", 2)])
    got = {r.lead_id: r for r in stories.tag(rows, labels, stories.story_text(F.col("articles"))).collect()}
    assert got["a"].entities == ["Fed", "ITC", "Index"] and got["a"].themes == ["Inflation"] and got["a"].tickers == ["ITC"]
    assert not got["b"].themes and not got["b"].entities and not got["b"].sectors


def test_tags_and_novelty_by_article_are_those_of_whole_stories(spark):
    labels = [stories.Label("themes", "Inflation", ["CPI"]), stories.Label("companies", "ITC", ["ITC"], None, "ITC"), stories.Label("institutions", "Fed", ["FOMC"]), stories.Label("sectors", "Banks", [])]
    rows = [article(f"a{k:02}", f"Title {k} {'ITC' if k == 3 else ''}", k, snippet="after FOMC" if k % 4 == 1 else "cpi" if k == 7 else "") for k in range(12)]
    assigned = stories.assign_stories(spark.createDataFrame(rows, ARTICLE), spark.createDataFrame([(f"a{k:02}", f"a{k + 1:02}") for k in (0, 1, 2, 5, 6)], "a string, b string"))
    whole, own = stories.stories(assigned), stories.with_lead(assigned)
    names = ["story_id", "lead_id", "themes", "entities", "sectors", "tickers"]
    want = stories.tag(whole, labels, stories.story_text(F.col("articles"))).select(names).collect()
    got = stories.tag_by_article(own, labels, F.concat("title", F.lit(" "), "snippet")).select(names).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 7
    published = whole.limit(1).select("story_id"), spark.createDataFrame([("https://x/a06",), ("",)], "url string")
    flags = [stories.seen_before(*args).select("story_id", "already_published") for args in ((whole, *published), (whole.drop("articles"), *published, own.select("story_id", "url")))]
    assert sorted(flags[0].collect()) == sorted(flags[1].collect()) and flags[0].where("already_published").count() >= 1


def test_texts_are_cut_before_they_meet_their_times(spark, tmp_path):
    from storyloom.plans.articles import articles

    long = " ".join(f"w{k}" for k in range(5000))
    spark.createDataFrame([(k, long, f"src{k}") for k in range(20)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(20).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = articles(spark, str(tmp_path))
    assert got.count() == 20 and got.first().title == " ".join(f"w{k}" for k in range(12)) and len(got.first().snippet.split()) == 40
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "w0" not in plan
    above = plan[: plan.index("Join")]
    assert "text#" not in above and "regexp" not in above


def test_score_terms(spark):
    rows = [article("a", "One", 9, "s1", "p1", "wire"), article("b", "Sponsored two", 6, "s2", "p1", "aggregator"), article("c", "Three", 7, "s3", "p2", "other")]
    base = story_rows(spark, rows, [(0, 1), (1, 2)])
    tagged = stories.tag(base, [stories.Label("themes", "Growth", ["three"]), stories.Label("companies", "Co", ["one"])], stories.story_text(F.col("articles")))
    seen = stories.seen_before(tagged, spark.createDataFrame([], "story_id string"), spark.createDataFrame([("https://x/b",)], "url string"))
    r = stories.score(seen, AS_OF).first()
    # The publisher counts by its newest article; 12/e after six hours; a company has the default weight.
    want = {"corroboration": 4 * math.log1p(0.8 + 1.0), "macro": 7.0, "entities": 1.8, "sectors": 0.0, "recency": 12 / math.e, "novelty": -25.0, "noise": -6.0, "untagged": None}
    assert {k: r.breakdown[k] for k in want} == {k: None if v is None else pytest.approx(v, abs=0.006) for k, v in want.items()}
    assert r.score == pytest.approx(sum(v for v in want.values() if v), abs=0.006)


def test_shortlist_median_and_triage(spark):
    rows = [(f"s{k}", float(k - 3), T0) for k in range(25)]
    d = spark.createDataFrame(rows, "story_id string, score double, newest_at timestamp")
    top = stories.shortlist(d, 4).orderBy("rn").collect()
    assert [r.score for r in top] == [float(x) for x in range(21, 6, -1)] and sum(r.selected for r in top) == 4
    assert stories.upper_median(d).first().median == 9.0 and stories.upper_median(d.limit(0)).first().median == 0.0
    assert stories.upper_median(d.where("score >= 18")).first().median == 19.0
    tri = spark.createDataFrame([("s10", 100.0, False), ("s11", None, False), ("s12", 50.0, True)], "story_id string, triage_score double, explainer_worthy boolean")
    got = {r.story_id: r.score for r in stories.blend_triage(d, tri).collect()}
    assert (got["s10"], got["s11"], got["s12"], got["s13"]) == (33.5, -12.0, 24.5, 10.0)


def test_judged_entries(spark):
    cols = "source_id string, source_name string, source_tier string, publisher string, default_tz string, snippet_max_words int, entry_pos int, title string, link string, summary string, description string, published string"
    e = lambda pos, title, link, when="2026-08-11T10:00:00Z", summary="": ("s", "S", "major", "p", "UTC", 5, pos, title, link, summary, None, when)
    rows = [
        e(0, "Good", "https://a/1?utm_x=1", summary="one two three four five six"), e(1, "", "https://a/2"), e(2, "No link", None), e(3, "Stock on target price", "https://a/3"), e(4, "Old", "https://a/4", "2026-08-10T11:59:59Z"),
        e(5, "Edge", "https://a/5", "2026-08-10T12:00:00Z"), e(6, "Again", "https://a/1#x"), e(7, "Undated", "https://a/6", "soon"), e(8, "Future", "https://a/7", "2026-08-12T12:00:00Z"), e(9, "Soon", "https://a/8", "2026-08-11T12:20:00Z"),
        e(10, "Not a url", "a/9"),
    ]
    d = normalize.judge(spark.createDataFrame(rows, cols), AS_OF)
    got = {r.entry_pos: r for r in d.collect()}
    assert {k: r.drop_reason for k, r in got.items()} == {0: None, 1: "bad", 2: "bad", 3: "excluded", 4: "stale", 5: None, 6: "dupe", 7: None, 8: None, 9: None, 10: "bad"}
    assert got[0].snippet == "one two three four five…" and got[0].url == "https://a/1" and got[7].published_at == got[8].published_at == T0 and got[9].published_at > T0
    counts = {r.reason: r.n for r in normalize.drop_counts(d).collect()}
    assert counts == {"kept": 5, "bad": 3, "excluded": 1, "stale": 1, "dupe": 1}


def test_publisher_cap_and_first_seen(spark):
    rows = [article(str(k), "t", k, f"s{k % 3}", "p" if k % 2 else "") for k in range(20)]
    got = normalize.publisher_cap(spark.createDataFrame(rows, ARTICLE), 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.publisher or r.source_id, []).append(int(r.id))
    assert {k: sorted(v) for k, v in by.items()} == {"p": [1, 3, 5], "s0": [0, 6, 12], "s1": [4, 10, 16], "s2": [2, 8, 14]}
    d = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 1, None)], "k long, o long, v string")
    assert sorted(tuple(r) for r in normalize.first_seen(d, ["k"], ["o"]).collect()) == [(1, 3, "a"), (2, 1, None)]


def test_ledger(spark):
    old = spark.createDataFrame([("2026-08-11", "policy_rate", "RBI", None, "old"), ("2025-07-07", "growth_print", "Growth", "7%", "o2"), ("2025-07-06", "growth_print", "Growth", "6%", "o1")], "date string, event_type string, entity string, value string, cluster_id string")
    rows = [("a", ["Interest Rates", "Inflation", "Growth"], ["RBI", "Fed"], "cut by 25 bps; inflation at 4.4%", 1), ("b", ["Nothing", "Inflation"], [], "inflation 9%", 2), ("c", ["Fiscal & Budget"], [], "₹5 crore", 3)]
    d = spark.createDataFrame(rows, "story_id string, themes array<string>, entities array<string>, what_happened string, ord long")
    got = {(r.event_type, r.entity): (r.value, r.cluster_id) for r in ledger.record(old, d, F.lit("2026-08-11")).collect() if r.date == "2026-08-11"}
    assert got == {("policy_rate", "RBI"): (None, "old"), ("inflation_print", "Inflation"): ("4.4%", "a"), ("fiscal_action", "Fiscal & Budget"): ("₹5 crore", "c")}
    assert sorted(r.cluster_id for r in ledger.prune(old, AS_OF).collect()) == ["o2", "old"]
    found = ledger.related(old, d.withColumn("entities", F.array(F.lit("rbi"))), 2)
    assert [(r.story_id, r.cluster_id, r.rn) for r in found.orderBy("story_id", "rn").collect()] == [("a", "old", 1), ("a", "o2", 2), ("b", "old", 1), ("c", "old", 1)]
    facts = {r.story_id: r.facts for r in ledger.related_facts(found).collect()}
    assert [x.date for x in facts["a"]] == ["2026-08-11", "2025-07-07"] and facts["a"][0].event == "policy_rate"


ITEM = "cluster_id string, sources array<struct<name:string,url:string>>, published_at timestamp, updated_at timestamp"


def greedy(rows):
    claimed, kept = set(), []
    for r in sorted(rows, key=lambda r: (-r[3].timestamp(), r[0])):
        urls = {u for _, u in r[1] if u}
        if urls & claimed:
            continue
        claimed |= urls
        kept.append(r[0])
    return kept


def test_merge_matches_the_greedy_walk(spark):
    rng = random.Random(4)
    item = lambda k, t: (f"c{k}", [("n", rng.choice(["", *(f"u{j}" for j in range(40))])) for _ in range(rng.randint(0, 3))], T0 - timedelta(hours=rng.randint(0, 20)), T0 + timedelta(minutes=t))
    previous, new = [item(k, rng.randint(0, 500)) for k in range(60)], [item(k, 600 + k) for k in range(50, 80)]
    both = {r[0]: r for r in previous} | {r[0]: r for r in new}
    got = archive.merge(spark.createDataFrame(new, ITEM).repartition(3), spark.createDataFrame(previous, ITEM)).collect()
    assert sorted(r.cluster_id for r in got) == sorted(greedy(both.values()))
    assert [r.published_at for r in got] == sorted((r.published_at for r in got), reverse=True)
    ids, urls = archive.signature(spark.createDataFrame(previous, ITEM))
    assert ids.count() == 60 and urls.count() == len({u for r in previous for _, u in r[1] if u})


def test_retention(spark):
    rows = [("a", [], T0 - timedelta(hours=24), T0), ("b", [], T0 - timedelta(hours=24, seconds=1), T0), (None, [], T0, T0)]
    d = spark.createDataFrame(rows, ITEM)
    assert [r.cluster_id for r in archive.carry_forward(d, AS_OF).collect()] == ["a"]
    assert tuple(archive.retention_audit(d, AS_OF).first()) == (3, 1, False)
    assert text.masthead(F.lit(""), F.lit("x")) is not None


@pytest.mark.parametrize("frequent", [0, 7, 200_000])
def test_tfidf_by_numbers_matches_counting(spark, frequent):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)] + ["the", "été", "日本"]
    rows = [(k, " ".join(rng.choice(words[: rng.choice([3, 33])]) for _ in range(rng.randint(0, 20)))) for k in range(60)] + [(100, None), (101, "a . !"), (102, "long words " * 30_000)]
    weights, terms = similarity.tfidf_arrays(spark.createDataFrame(rows, "id long, text string").repartition(3), stop_words=("the",), extra_stop_words=("w1",), max_df=0.4, frequent=frequent)
    name = {r.k: r.term for r in terms.collect()}
    assert [name[k] for k in sorted(name)] == sorted(name.values(), key=str.encode)
    counts = {}
    for k, text in rows:
        w = [x for x in (text or "").split() if len(x) > 1 and x != "the"]
        counts[k] = Counter(w + [f"{x} {y}" for x, y in itertools.pairwise(w)])
    df = Counter(t for c in counts.values() for t in c)
    want = {}
    for k, c in counts.items():
        x = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items() if df[t] <= 0.4 * len(rows)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        if x:
            want[k] = {t: pytest.approx(v / norm) for t, v in x.items() if t != "w1"}
    assert {r.id: {name[x.k]: x.w for x in r.weights} for r in weights.collect()} == want


def test_tfidf_pairs_are_those_of_all_products(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words[: rng.choice([8, 40])]) for _ in range(rng.randint(1, 9)))) for k in range(120)]
    at = [(k, datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 90))) for k, _ in rows]
    weights = similarity.tfidf(spark.createDataFrame(rows, "id long, text string"), extra_stop_words=("w3",))
    times = spark.createDataFrame(at, "id long, published_at timestamp")
    by = {}
    for r in weights.collect():
        by.setdefault(r.id, {})[r.term] = r.w
    dot = lambda a, b: sum(w * by[b].get(t, 0.0) for t, w in by[a].items())
    want = {(a, b): s for a in by for b in by if a < b and (s := dot(a, b)) >= 0.42}
    got = {(r.a, r.b): r.sim for r in similarity.tfidf_pairs(weights, 0.42).collect()}
    assert got == pytest.approx(want)
    near = {p for p in want if abs(at[p[0]][1] - at[p[1]][1]) <= timedelta(hours=18)}
    assert {(r.a, r.b) for r in similarity.tfidf_pairs(weights, 0.42, times).collect()} == near and near < set(want)


def test_vectors_that_are_null_or_shorter_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    assert [(r.a, r.b) for r in similarity.cosine_pairs(d, 0.9).collect()] == [(1, 2)]
    assert similarity.cosine_pairs(d.where("id = 3"), 0.9).count() == 0


def test_accents_are_stripped(spark):
    d = spark.createDataFrame([("Élan naïve façade é ạ",)], "t string")
    assert d.select(similarity.without_accents(F.lower("t"))).first()[0] == "elan naive facade e a"


def test_cap_counts(spark):
    rows = [(f"s{k % 2}", f"p{k % 2}", None if k else "bad") for k in range(9)]
    d = spark.createDataFrame(rows, "source_id string, publisher string, drop_reason string")
    assert sorted((r.n_kept, r.n_capped) for r in normalize.cap_counts(d, 3).collect()) == [(4, 1), (4, 1)]


@pytest.mark.parametrize("hours", [None, 18])
def test_pairs_by_blocks_of_any_size(spark, hours):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words[: rng.choice([8, 40])]) for _ in range(rng.randint(1, 9))), T0 + timedelta(hours=rng.randint(0, 90))) for k in range(120)]
    d = spark.createDataFrame(rows, "id long, text string, published_at timestamp").repartition(3)
    weights = similarity.tfidf(d.select("id", "text"))
    times = d.select("id", "published_at") if hours else None
    of = lambda n: {(r.a, r.b): r.sim for r in similarity.tfidf_pairs(weights, 0.42, times, block_rows=n).collect()}
    assert len(of(7)) > 5 and of(7) == pytest.approx(of(1000))
    found = similarity.cosine_pairs(d.select("id", F.array(*(F.rand(k) - 0.5 for k in range(3))).alias("v"), "published_at"), 0.8, hours, block_rows=7)
    # Blocks are read from files: vectors aren't shuffled once for each block that they meet.
    assert "CoGroup" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("hours", [None, 18])
def test_copies_are_compared_once_and_paired_all(spark, hours):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words[: rng.choice([8, 60])]) for _ in range(rng.randint(1, 9))) for _ in range(50)] + ["this this w9"]
    rows = [(k, rng.choice(texts), T0 + timedelta(hours=rng.randint(0, 90))) for k in range(160)] + [(200 + k, "w1 w2 w50", T0) for k in range(40)]
    d = spark.createDataFrame(rows, "id long, text string, published_at timestamp").repartition(3)
    options = {"extra_stop_words": ("this", "w3"), "chunk_words": 150}
    plain = similarity.tfidf(d.select("id", "text"), **options)
    by, at = {}, {r[0]: r[2] for r in rows}
    for r in plain.collect():
        by.setdefault(r.id, {})[r.term] = r.w
    dot = lambda a, b: sum(w * by[b].get(t, 0.0) for t, w in by[a].items())
    near = lambda a, b: not hours or abs(at[a] - at[b]) <= timedelta(hours=hours)
    want = {(a, b): s for a in by for b in by if a < b and near(a, b) and (s := dot(a, b)) >= 0.42}
    shared, times = similarity.tfidf_shared(d.select("id", "text"), **options), d.select("id", "published_at") if hours else None
    # Few heads, so that what isn't one is bounded as well.
    for sizes in ({"block_rows": 7, "heads": 2}, {"heads": 20}):
        assert {(r.a, r.b): r.sim for r in similarity.tfidf_pairs(shared, 0.42, times, **sizes).collect()} == pytest.approx(want)
    members, pairs = similarity.weight_classes(shared, 0.42, times)
    assert members.count() < len(by) + 1 and pairs.count() < len(want) / 4  # copies cost a row each, and no pair
    if hours:
        links = {(r.a, r.b) for r in similarity.tfidf_links(shared, 0.42, times).collect()}
        assert all(dot(a, b) >= 0.42 - 1e-9 for a, b in links)
        assert len(links) < len(want) / 2 and _components(by, links) == _components(by, want)


def _components(ids, links):
    of = {k: k for k in ids}
    while any(of[a] != of[b] for a, b in links):
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    return of


@pytest.mark.parametrize("hours", [None, 18])
def test_a_gram_of_many_classes_is_dealt_to_parts(spark, hours):
    rows = [(k, T0 + timedelta(hours=k % 50), ["x", "y", f"z{k % 37}", f"z{k % 31}"]) for k in range(120)]
    d = spark.createDataFrame(rows, "id long, published_at timestamp, grams array<string>").selectExpr("id AS class_id", "struct(0 AS _) AS scope", "grams",
        "unix_micros(published_at) AS start", "unix_micros(published_at) AS end", "1L AS n")
    span = hours * 3_600_000_000 if hours else None
    pairs = lambda n: sorted(tuple(r) for r in similarity._class_pairs(d, 0.3, span, part_rows=n).collect())
    assert len(pairs(5)) > 1000 and pairs(5) == pairs(1000)


def test_links_of_rows_follow_from_classes_and_times(spark, tmp_path):
    from storyloom.plans import catalogue

    rng = random.Random(5)
    spark.createDataFrame([(k, " ".join(rng.choice("abc") for _ in range(4)), f"src{k % 5}") for k in range(80)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    at = [(k, T0 + timedelta(hours=rng.randint(0, 200))) for k in range(80)]
    spark.createDataFrame(at, "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    rows = catalogue.QUERIES["time_window_pairs"](spark, str(tmp_path)).collect()
    members = {r.b: (r.a, r.at) for r in rows if r.part == "member"}
    paired = {(r.a, r.b) for r in rows if r.part == "pair"}
    got = {(a, b) for a, (c, s) in members.items() for b, (d, t) in members.items()
           if a < b and abs(s - t) <= 18 * 3_600_000_000 and (c == d or (c, d) in paired or (d, c) in paired)}
    grams = catalogue.articles(spark, str(tmp_path)).select("id", "published_at", text.word_grams(F.col("title")).alias("grams"))
    assert got == {(r.a, r.b) for r in similarity.jaccard_pairs(grams, 0.3, 18).collect()} and len(got) > 50


def test_capped_articles_are_read_from_a_written_table(spark, tmp_path):
    from storyloom.plans import catalogue

    spark.createDataFrame([(k, f"title {k % 7} of", f"src{k % 5}") for k in range(20)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, T0) for k in range(20)], "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    assert not any(f.endswith("documents.parquet") or "documents.parquet/" in f for f in catalogue.fresh(spark, str(tmp_path)).inputFiles())


def top_terms(rows, n, stop, extra, max_df):
    """(id, term, w) by counting."""
    counts = {}
    for k, t in rows:
        w = [x for x in (t or "").split() if len(x) > 1 and x not in stop]
        counts[k] = Counter(w + [f"{x} {y}" for x, y in itertools.pairwise(w)])
    df = Counter(t for c in counts.values() for t in c)
    found = set()
    for k, c in counts.items():
        x = {t: (1 + math.log(m)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, m in c.items() if df[t] <= max_df * len(rows)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        w = sorted((-round(v / norm, 9), t.encode(), t) for t, v in x.items() if t not in extra)
        found |= {(k, t, round(-v, 6)) for v, _, t in w[:n]}
    return found


@pytest.mark.parametrize("sizes", [{}, {"chunk_words": 60, "range_bytes": 300, "sample_bytes": 64}, {"chunk_bytes": 1, "range_bytes": 1 << 20}])
def test_heaviest_terms_by_chunks_and_ranges_of_any_size(spark, sizes):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)] + ["the", "été", "日本", "𝒳y", "z_"]
    rows = [(k, " ".join(rng.choice(words[: rng.choice([4, 45])]) for _ in range(rng.randint(0, 25)))) for k in range(80)]
    rows += [(100, None), (101, "a . !"), (102, "long words " * 5_000), (103, "w1"), (104, "the the"), (105, " ".join(f"u{k}" for k in range(300)))]
    d = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = similarity.tfidf_top(d, 5, stop_words=("the",), extra_stop_words=("w1", "w2 w3", "none", "w5 none"), max_df=0.4, **sizes).collect()
    want = top_terms(rows, 5, ("the",), ("w1", "w2 w3"), 0.4)
    assert len(got) == len(want) and {(r.id, r.term, round(r.w, 6)) for r in got} == want
    assert similarity.tfidf_top(d.where("id in (100, 101, 104)"), 5, stop_words=("the",)).count() == 0
    assert similarity.tfidf_top(d.limit(0), 5).count() == 0


def test_terms_of_whole_texts_are_no_rows(spark):
    """Rows that share terms send them once for each chunk: what is shuffled are cuts of chunks, and no plan lists terms."""
    from storyloom.plans import catalogue

    rows = [(k, " ".join(f"w{(k * 7 + j) % 500}" for j in range(200))) for k in range(200)]
    counted = similarity.counted_terms(spark.createDataFrame(rows, "id long, text string").repartition(4), chunk_words=5_000, range_bytes=1 << 14)
    cuts = counted._by_range().applyInArrow(lambda t: t.select(["part", "file", "df"]), "part int, file string, df array<int>").collect()
    assert 8 <= counted.n_files <= 12 and len(counted.bounds) > 2
    assert len(cuts) <= counted.n_files * (len(counted.bounds) + 1) and sum(len(r.df) for r in cuts) < 200 * 399 / 4 and sum(sum(r.df) for r in cuts) == 200 * 399
    plan = catalogue.QUERIES["tfidf_topterms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan
