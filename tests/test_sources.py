import json
import os
import subprocess
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyloom import schemas
from storyloom.functions import json as fj
from storyloom.operators import normalize
from storyloom.sources import feeds, inference, providers, settings, stored

RSS = b"""<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>C</title>
<item><title>One &amp;amp; two</title><link>https://x/1</link><description>Body</description><pubDate>Tue, 11 Aug 2026 10:30:00 GMT</pubDate></item>
<item><title>Three</title><link>https://x/2</link><dc:date>2026-08-11T10:00:00Z</dc:date></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://x/self"/><link href="https://x/a"/>
<summary>S</summary><updated>2026-08-11T09:00:00Z</updated></entry></feed>"""
AS_OF = F.lit("2026-08-11 12:00:00").cast("timestamp")


def test_feeds_are_parsed():
    first, second = feeds.parse_feed(RSS)
    f = feeds.FIELDS.index
    assert (first[f("title")], first[f("link")], first[f("summary")], first[f("published")]) == ("One &amp; two", "https://x/1", "Body", "Tue, 11 Aug 2026 10:30:00 GMT")
    assert second[f("dc_date")] == "2026-08-11T10:00:00Z" and second[f("published")] is None
    atom = feeds.parse_feed(ATOM)[0]
    assert atom[f("link")] == "https://x/a" and atom[f("updated")] == "2026-08-11T09:00:00Z"
    assert feeds.parse_feed(b"<rss>") is None and feeds.parse_feed(b"<rss/>") == []


def test_one_feed_at_a_time():
    calls = []

    def get(replies):
        def one(url, headers, timeout):
            calls.append(headers)
            r = replies.pop(0)
            if isinstance(r, Exception):
                raise r
            return r

        return one

    src = {"id": "s", "url": "https://x"}
    row = feeds.fetch_one(src, {"s": {"etag": "E", "last_modified": "M"}}, get([(304, {}, b"")]))
    assert row == ("s", 304, None, "E", "M", []) and calls[-1]["If-None-Match"] == "E" and calls[-1]["If-Modified-Since"] == "M"
    row = feeds.fetch_one(src, None, get([OSError("dns"), (200, {"etag": "N"}, RSS)]), lambda s: None)
    assert row[1:5] == (200, None, "N", None) and len(row[5]) == 2
    assert feeds.fetch_one(src, None, get([OSError("a"), OSError("b")]), lambda s: None)[2] == "OSError: b"
    n = len(calls)
    assert feeds.fetch_one(src, None, get([(403, {}, b"")]))[1:3] == (403, "HTTP 403") and len(calls) == n + 1
    assert feeds.fetch_one(src, None, get([(200, {}, b"no xml")]))[2] == "unparseable feed"


def test_landed_files_to_articles(spark, tmp_path):
    (tmp_path / "s1.xml").write_bytes(RSS)
    (tmp_path / "s2.xml").write_bytes(ATOM)
    (tmp_path / "s3.xml").write_bytes(b"broken")
    rows = feeds.read_landed(spark, f"{tmp_path}/*.xml")
    assert {r.source_id: r.error for r in rows.collect()} == {"s1": None, "s2": None, "s3": "unparseable feed"}
    conf = {"defaults": {"max_entries": 1, "snippet_max_words": 40, "default_tz": "Asia/Kolkata"}, "sources": [{"id": f"s{k}", "name": f"S{k}", "tier": "wire"} for k in (1, 2, 3)]}
    entries = normalize.flatten(rows, settings.sources(spark, conf))
    got = {r.title: r for r in normalize.normalize(entries, AS_OF).collect()}
    assert set(got) == {"One & two", "A"} and got["A"].publisher == "s2" and got["A"].snippet == "S"


def test_registered_source_reads_failures_as_rows(spark):
    spark.dataSource.register(feeds.FeedSource)
    sources = json.dumps([{"id": "a", "url": "http://127.0.0.1:9/none", "timeout_seconds": 1}, {"id": "b", "url": "nonsense"}])
    got = spark.read.format("feeds").option("sources", sources).load().collect()
    assert {r.source_id for r in got} == {"a", "b"} and all(r.error and not r.entries for r in got)
    assert normalize.ok_feeds(spark.createDataFrame(got, feeds.SCHEMA)).count() == 0


def test_settings(tmp_path):
    (tmp_path / "w.yml").write_text("macro_themes:\n- {label: Growth, weight: 7, aliases: [GDP]}\ncompanies:\n- {label: Co, ticker: CO, aliases: [Co]}\nnoise_patterns: [wrap]\nhard_exclude_patterns: ['\\bx\\b']\n")
    labels, excluded, noise = settings.watchlist(settings.load(str(tmp_path / "w.yml")))
    assert [(x.group, x.label, x.ticker) for x in labels] == [("themes", "Growth", None), ("companies", "Co", "CO")] and excluded == [r"\bx\b"] and noise == ["wrap"]
    assert settings.weights(labels) == {"Growth": 7.0}
    rules, markers = settings.rules({"blocking_patterns": [{"pattern": "a", "rule": "r"}], "minor_patterns": [{"pattern": "b", "rule": "q"}], "attribution_markers": ["argue"]})
    assert rules == (("blocking", "a", "r"), ("minor", "b", "q")) and markers == ("argue",)
    (tmp_path / ".env").write_text("# no\nA=1\nB = 2\n")
    env = {"A": "0"}
    settings.dotenv(str(tmp_path / ".env"), env)
    settings.dotenv(str(tmp_path / "none"), env)
    assert env == {"A": "0", "B": "2"}


def items(spark, n=3):
    rows = [(f"c{k}", (f"Head <{k}>", "hook", ["a", "b", "c"]), ([], [], ["s"], ["t"]), [("N", "H", f"https://x/{k}", "2026-08-11")], datetime(2026, 8, 11, 11) - timedelta(hours=k), datetime(2026, 8, 11, 12), "high", "free") for k in range(n)]
    return spark.createDataFrame(rows, schemas.PUBLISHED)


def test_site_round_trip_and_publishing(spark, tmp_path):
    site = str(tmp_path / "site")
    assert stored.write_site(items(spark).limit(0), AS_OF, site, "no advice") == 0 and not os.path.exists(site)
    assert stored.write_site(items(spark), AS_OF, site, "no advice") == 3
    feed = json.loads(open(f"{site}/api/v1/feed.json").read())
    assert feed["count"] == 3 and feed["disclaimer"] == "no advice" and [i["cluster_id"] for i in feed["items"]] == ["c0", "c1", "c2"] and feed["items"][0]["tier"] == "free"
    assert sorted(os.listdir(f"{site}/story")) == ["c0.html", "c1.html", "c2.html"] and "Head &lt;0&gt;" in open(f"{site}/index.html").read()
    (tmp_path / "site/api/v1/clusters/bad.json").write_text("{")
    back = stored.load_previous(spark, site, AS_OF)
    assert sorted(r.cluster_id for r in back.collect()) == ["c0", "c1", "c2"] and back.first().analysis.gist == ["a", "b", "c"]
    remote = str(tmp_path / "remote")
    subprocess.run(["git", "init", "-q", "--bare", remote], check=True)
    assert stored.holds_one_commit(remote, "site")
    assert stored.publish(site, remote, "site") and stored.publish(site, remote, "site") and stored.holds_one_commit(remote, "site")
    from_git = stored.load_previous(spark, str(tmp_path / "nowhere"), AS_OF, remote, "site")
    assert sorted(r.cluster_id for r in from_git.collect()) == ["c0", "c1", "c2"]
    assert not stored.publish(str(tmp_path / "nowhere"), remote, "site")
    with pytest.raises(ValueError):
        stored.write_site(items(spark), AS_OF, site, "", limit=2)


def test_ledger_tables(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert stored.read_ledger(spark, path).count() == 0 and stored.read_ledger(spark, path + ".json").count() == 0
    rows = spark.createDataFrame([("2026-08-11", "policy_rate", "RBI", None, "c")], schemas.LEDGER)
    stored.replace_table(rows, path)
    stored.replace_table(stored.read_ledger(spark, path).unionByName(rows), path)
    assert stored.read_ledger(spark, path).count() == 2
    (tmp_path / "l.json").write_text(json.dumps([{"date": "2026-08-11", "event_type": "e", "entity": "x", "cluster_id": "c"}, {"date": None}]))
    assert [r.entity for r in stored.read_ledger(spark, str(tmp_path / "l.json")).collect()] == ["x"]
    (tmp_path / "broken.json").write_text("[{")
    assert stored.read_ledger(spark, str(tmp_path / "broken.json")).count() == 0


BODIES = [
    ('```json\n{"a": 1}\n```', {"a": 1}), ('```\n{"a": 1}\n```', {"a": 1}), ('Here: {"a": 1}', {"a": 1}), ('{"a": 1} done', {"a": 1}), ('{"a": 1}', {"a": 1}),
    ('{"t": "the "risk-free" rate", "a": 1}', {"t": 'the "risk-free" rate', "a": 1}), ('{"a": [1, 2,], }', {"a": [1, 2]}), ('{"t": "x: {y}, [z]"}', {"t": "x: {y}, [z]"}), ('{"t": "a \\"b\\" c"}', {"t": 'a "b" c'}),
    ("plain words", None), ("} {", None), ('{"t": "say "yes", then", "u": "v"}', None),
]


def test_replies_are_read_tolerantly(spark):
    got = [r[0] for r in spark.createDataFrame([(b,) for b, _ in BODIES], "b string").select(fj.tolerant_json(F.col("b"))).collect()]
    for (body, want), found in zip(BODIES, got, strict=True):
        assert (None if found is None else json.loads(found)) == want
        if want is None:
            with pytest.raises(ValueError):
                inference.extract(body)
        else:
            assert inference.extract(body) == want


def router(monkeypatch, replies, keys=("K1", "K2", "K3")):
    for k in ("K1", "K2", "K3"):
        monkeypatch.setenv(k, "x" if k in keys else "  ")
    calls = []

    def post(url, headers, body, timeout):
        calls.append(body["model"])
        r = replies[body["model"]].pop(0)
        if isinstance(r, Exception):
            raise r
        return r if isinstance(r, tuple) else (200, json.dumps({"choices": [{"message": {"content": r}}]}))

    found = [inference.Provider(f"p{k}", "https://p", f"m{k}", f"K{k}") for k in (1, 2, 3)]
    return inference.Router(found, post, lambda s: None), calls


def test_failover(monkeypatch):
    r, calls = router(monkeypatch, {"m1": [(429, "")], "m2": ["two", "again"], "m3": []})
    assert r.complete("s", "u") == "two" and r.complete("s", "u") == "again" and calls == ["m1", "m2", "m2"]
    r.reset()
    r, calls = router(monkeypatch, {"m1": [(401, ""), (401, "")], "m2": [(503, "")], "m3": ["three"]})
    assert r.complete("s", "u") == "three" and calls == ["m1", "m2", "m3"]
    r, calls = router(monkeypatch, {"m1": [inference.Fault("x"), "one"], "m2": [], "m3": []})
    assert r.complete("s", "u") == "one" and calls == ["m1", "m1"]
    r, calls = router(monkeypatch, {f"m{k}": [(429, "")] for k in (1, 2, 3)})
    for _ in range(2):
        with pytest.raises(inference.NoProvider):
            r.complete("s", "u")
    assert calls == ["m1", "m2", "m3"]
    r, calls = router(monkeypatch, {}, keys=())
    with pytest.raises(inference.NoProvider):
        r.complete("s", "u")
    assert calls == []


def test_triage_and_analysis(spark, monkeypatch):
    r, _ = router(monkeypatch, {"m1": ['{"ranked": [{"cluster_id": "a", "score": 5}, {"score": 1}, 3]}', "[1]", "words"], "m2": [], "m3": []})
    assert inference.triage([{"cluster_id": "a"}], r, "s") == [("a", 5.0, None, None)] and inference.triage([{}], r, "s") == [] and inference.triage([{}], r, "s") == [] and inference.triage([], r, "s") == []

    def make():
        import json as j
        import os as o

        o.environ["K"] = "x"
        seen = []

        def post(url, headers, body, timeout):
            seen.append(body)
            text = body["messages"][1]["content"]
            content = '{"ok": 1}' if "ok is 0" in text or text == "good" else '{"ok": 0}' if text == "second" else "no"
            return 200, j.dumps({"choices": [{"message": {"content": content}}]})

        return inference.Router([inference.Provider("p", "u", "m", "K")], post, lambda s: None)

    rows = spark.createDataFrame([("a", "good"), ("b", "second"), ("c", "never"), ("d", None)], "story_id string, payload string")
    got = {r.story_id: r.reply for r in inference.analyze(rows, make, "s", lambda x: None if x["ok"] else "ok is 0").collect()}
    assert got == {"a": '{"ok": 1}', "b": '{"ok": 1}', "c": None, "d": None}


def test_provider_tables(spark):
    rows = spark.createDataFrame([("m1", "p1", "K1", "x", "0", "0", 8), ("m2", "p2", "K2", None, "0", "0", 9), ("m3", "p3", "K1", "y", "a", "0", 9)], "model string, provider string, key_env string, key string, prompt string, completion string, context int")
    none = spark.createDataFrame([], "provider string")
    assert [r.model for r in providers.zero_cost(providers.live(rows, none)).collect()] == ["m1"] and providers.key_status(rows).first().status == "K1=set K2=MISSING"


def test_a_swap_that_was_broken_off_loses_no_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    rows = lambda *d: spark.createDataFrame([(x, "policy_rate", "e", None, x) for x in d], schemas.LEDGER)
    dates = lambda: sorted(r.date for r in stored.read_ledger(spark, path).collect())
    stored.replace_table(rows("1"), path)
    kept = stored._rename
    for step, want in ((1, ["1"]), (2, ["1", "2"])):  # before the first rename, and between the two
        calls = []

        def broken(fs, a, b, step=step, calls=calls):
            calls.append(a)
            if len(calls) == step:
                raise OSError("killed")
            kept(fs, a, b)

        monkeypatch.setattr(stored, "_rename", broken)
        with pytest.raises(OSError, match="killed"):
            stored.replace_table(rows("1", "2"), path)
        monkeypatch.setattr(stored, "_rename", kept)
        assert dates() == want
        stored.replace_table(rows("1"), path)
    assert dates() == ["1"]
    # An unfinished new table isn't taken for one.
    fs, p = stored._fs(spark, path)
    fs.rename(p, stored._fs(spark, path + ".old")[1])
    fs.mkdirs(stored._fs(spark, path + ".new")[1])
    assert dates() == ["1"]


def test_state_of_feeds_is_kept(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    assert stored.read_state(spark, path) == {}
    rows = spark.createDataFrame([("a", 200, None, "e1", None, []), ("b", 304, None, None, "m", []), ("c", 200, None, None, None, [])], feeds.SCHEMA)
    stored.replace_table(feeds.next_state(rows), path)
    state = stored.read_state(spark, path)
    assert state == {"a": {"etag": "e1", "last_modified": None}, "b": {"etag": None, "last_modified": "m"}}
    row = feeds.fetch_one({"id": "b", "url": "u"}, state, get=lambda url, headers, timeout: (304 if headers["If-Modified-Since"] == "m" else 200, {}, b""))
    assert row[1] == 304 and row[4] == "m"
