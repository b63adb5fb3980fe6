import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from storyloom import schemas
from storyloom.operators import stories
from storyloom.plans import run
from storyloom.sources import feeds, settings
from storyloom.streaming import arrivals
from tests.test_compliance import BASE

T0 = datetime(2026, 8, 11, 12)
AS_OF = F.lit("2026-08-11 12:00:00").cast("timestamp")
FEED = feeds.SCHEMA


def entry(title, link, summary, when):
    return (title, link, summary, None, when, None, None, None, None)


def test_feeds_to_items(spark):
    when = "2026-08-11T11:00:00Z"
    first = [entry("Central bank holds the repo rate steady", "https://a/1", "inflation cools as food prices fall", when), entry("Oil climbs after supply cut", "https://a/2", "tankers wait offshore", when)]
    second = [entry("Repo rate held steady by central bank", "https://b/1", "inflation cools and food prices fall", when), entry("Rain delays harvest in the north", "https://b/2", "farmers wait", when)]
    rows = spark.createDataFrame([("s1", 200, None, None, None, first), ("s2", 200, None, None, None, second), ("s3", None, "down", None, None, [])], FEED)
    conf = {"defaults": {"max_entries": 40, "snippet_max_words": 40, "default_tz": "UTC"}, "sources": [{"id": f"s{k}", "name": f"S{k}", "tier": "wire"} for k in (1, 2, 3)]}
    watch = [stories.Label("themes", "Interest Rates", ["repo rate"], 10.0), stories.Label("institutions", "RBI", ["central bank"], 10.0)]
    got = run.rank_feeds(rows, settings.sources(spark, conf), AS_OF, watch, threshold=0.3)
    ranked = got.ranked.collect()
    assert got.articles.count() == 4 and len(ranked) == 3 and ranked[0].n_publishers == 2 and ranked[0].themes == ["Interest Rates"]
    best = ranked[0].story_id
    replies = spark.createDataFrame([(best, "```json\n" + json.dumps(BASE | {"what_happened": "a cut of 25 bps"}) + "\n```"), (ranked[1].story_id, '{"headline": "x"}')], "story_id string, reply string")
    none = spark.createDataFrame([], schemas.PUBLISHED)
    checked, items, facts = run.publish_analyses(got.ranked, replies, AS_OF, spark.createDataFrame([], schemas.LEDGER), none)
    assert tuple(run.run_counts(checked).first()) == (1, 1, 0)
    assert [r.cluster_id for r in items.collect()] == [best] and [tuple(r) for r in facts.collect()] == [("2026-08-11", "policy_rate", "RBI", "25bps", best)]
    again = run.rank_feeds(rows, settings.sources(spark, conf), AS_OF, watch, threshold=0.3, previous=items).ranked.collect()
    assert {r.story_id: r.already_published for r in again}[best] and sum(r.already_published for r in again) == 1


def test_vectors_replace_tfidf(spark):
    rows = spark.createDataFrame([("s1", 200, None, None, None, [entry(f"Title {k}", f"https://a/{k}", "", "2026-08-11T11:00:00Z") for k in range(3)])], FEED)
    conf = {"defaults": {"max_entries": 40, "snippet_max_words": 40, "default_tz": "UTC"}, "sources": [{"id": "s1", "name": "S", "tier": "wire"}]}
    ids = {k: __import__("hashlib").sha1(f"https://a/{k}".encode()).hexdigest()[:16] for k in range(3)}
    vectors = spark.createDataFrame([(ids[0], [1.0, 0.0]), (ids[1], [0.9, 0.1]), (ids[2], [0.0, 1.0])], "id string, v array<double>")
    got = run.rank_feeds(rows, settings.sources(spark, conf), AS_OF, [], vectors=vectors).ranked.collect()
    assert sorted(r.n_articles for r in got) == [1, 2]


def test_streams(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    schema = "id string, source_id string, published_at timestamp"
    for k, batch in enumerate([[("a", "s", at(0)), ("a", "s", at(0)), ("b", "s", at(0.5))], [("a", "s", at(0)), ("c", "t", at(2))], [("z", "s", at(80))], [("y", "s", at(81))]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.id for r in drain(arrivals.first_arrivals(stream()), "first_seen")) == ["a", "b", "c", "y", "z"]
    counts = {(r.source_id, r.window.start.hour): r.n for r in drain(arrivals.counts_by_window(stream()), "by_window")}
    assert counts == {("s", 12): 4, ("t", 14): 1}
    assert sorted((r.source_id, r.n) for r in drain(arrivals.sessions(stream(), "source_id"), "runs")) == [("s", 4), ("t", 1)]


def test_items_are_merged_as_they_arrive(spark, tmp_path):
    schema = "cluster_id string, sources array<struct<name:string,url:string>>, published_at timestamp, updated_at timestamp"
    row = lambda c, u, m: (c, [("n", u)], T0, T0 + timedelta(minutes=m))
    table, check = f"{tmp_path}/items", f"{tmp_path}/check"
    for k, batch in enumerate([[row("a", "u1", 0), row("b", "u2", 0)], [row("c", "u1", 5)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        q = arrivals.publish_items(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), table, check, AS_OF)
        q.awaitTermination(120)
    assert sorted(r.cluster_id for r in spark.read.parquet(table).collect()) == ["b", "c"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from storyloom import __main__ as cli
    from storyloom.sources import inference
    from tests.test_sources import ATOM, RSS

    conf = tmp_path / "settings"
    conf.mkdir()
    (tmp_path / "s1.xml").write_bytes(RSS)
    (tmp_path / "s2.xml").write_bytes(ATOM)
    (conf / "sources.yml").write_text("defaults: {max_entries: 40, snippet_max_words: 40, default_tz: UTC}\nsources:\n- {id: s1, name: S1, tier: wire, url: u}\n- {id: s2, name: S2, tier: major, url: u}\n")
    (conf / "watchlist.yml").write_text("macro_themes:\n- {label: Interest Rates, weight: 10, aliases: [one]}\n")
    (conf / "compliance.yml").write_text("disclaimer: {short: No advice}\n")
    (conf / "providers.yml").write_text("quality: [{name: p, base_url: u, model: q, key_env: KEY}]\ncheap: [{name: p, base_url: u, model: c, key_env: KEY}]\n")
    for n in ("analysis", "triage", "review"):
        (conf / f"{n}.txt").write_text(n)
    (conf / ".env").write_text("KEY=x\n")
    base = ["--settings", str(conf), "--landed", f"{tmp_path}/*.xml", "--as-of", "2026-08-11 12:00:00", "--site", f"{tmp_path}/site", "--ledger", f"{tmp_path}/ledger"]
    assert cli.main([*base, "--no-llm", "--dump", f"{tmp_path}/dump"]) == 0
    assert json.loads(capsys.readouterr().out) == {"ok": True, "articles": 3, "clusters": 3, "selected": 3}
    assert [x["entries"] for x in json.loads((tmp_path / "dump/sources.json").read_text())] == [2, 1]
    clusters = json.loads((tmp_path / "dump/clusters.json").read_text())
    assert clusters[0]["tags"]["macro_themes"] == ["Interest Rates"] and clusters[0]["score"] >= clusters[1]["score"]
    assert json.loads((tmp_path / "dump/summary.json").read_text())["multi_article_clusters"] == 0
    analysis = json.dumps(BASE | {"what_happened": "a cut of 25 bps"})

    class Fake(inference.Router):
        def call(self, p, system, user, max_tokens, temperature, json_mode):
            if system == "triage":
                return 200, '{"ranked": []}'
            return 200, analysis if system == "analysis" else '{"pass": true, "violations": [], "rewritten_fields": {"hook": "A new hook"}}'

    monkeypatch.setattr(inference, "Router", Fake)
    assert cli.main(base) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["published"] == 3 and out["blocked_by_compliance"] == 0
    feed = json.loads((tmp_path / "site/api/v1/feed.json").read_text())
    assert feed["count"] == 3 and {i["hook"] for i in feed["items"]} == {"A new hook"}
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/ledger").collect()] == ["25bps"]
    assert inference.probe(Fake([inference.Provider("p", "u", "m", "KEY"), inference.Provider("q", "u", "m", "NONE")])) == [("p", "m", "OK"), ("q", "m", "no key")]


def test_models_at_no_cost(spark):
    from storyloom.sources import inference

    listed = {"data": [
        {"id": "a", "pricing": {"prompt": "0", "completion": "0"}, "context_length": 8}, {"id": "b", "pricing": {"prompt": "0.1", "completion": "0"}, "context_length": 99},
        {"id": "c", "pricing": {"prompt": 0, "completion": 0.0}, "context_length": 32}, {"id": "d"}, {"id": "e", "pricing": {"prompt": "free", "completion": "0"}},
    ]}
    asked = []
    got = inference.free_models(spark, "https://p/v1", lambda url: asked.append(url) or listed).collect()
    assert [r.model for r in got] == ["c", "a"] and asked == ["https://p/v1/models"]
    assert inference.free_models(spark, "u", lambda url: {"data": []}).count() == 0
