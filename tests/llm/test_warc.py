import json
import hashlib
import io
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.llm import warc as m

SCHEMA = "page_id long, url string, html string"


def plain(rows, min_bytes=100):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, url, html in rows:
        raw = (html or "").encode()
        to = first.get(html or "")
        revisit = len(raw) >= min_bytes and to is not None and to != i
        out.append((i, url, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return out


def corpus():
    rng = random.Random(12)
    hosts = ["a.example", "www.b.example", "sub.a.example:80", "é.example"]
    rows = [(k, f"http://{rng.choice(hosts)}/{rng.randint(0, 9)}?q={rng.randint(0, 3)}#f", rng.choice(["x" * 99, "é" * 50, "y" * 100, f"page {k}" * 30])) for k in range(300)]
    return rows + [(900, None, None), (901, "", ""), (902, "not a url\r\nX: y", "y" * 100), (None, "http://n", "y" * 100), (None, "http://n", "z" * 200), (7, *rows[7][1:]), (903, "http://long", "w" * 3_000_000)]


def test_round_trip_in_global_order(spark, tmp_path):
    rows = corpus()
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS payload", "3 AS digest").repartition(5)
    # Many small runs, merged in several passes.
    got = m.capture_histories(d, fan_in=3, run_captures=20, uri=f"file://{tmp_path}/w").collect()
    found = [(r.id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(found, key=repr) == sorted(plain(rows), key=repr)
    got.sort(key=lambda r: (r.part, r.seq))
    keys = [m.order((r.url_key, r.timestamp, r.id)) for r in got]
    assert keys == sorted(keys) and len({r.part for r in got}) >= 1


def test_ids_of_any_size_and_strings(spark):
    rows = [(10**12, "http://a/", "x"), (-1, "http://a/", "y"), (None, "http://a/", None), (2**63 - 1, "http://a/", "z")]
    got = m.in_order(m.capture_histories(spark.createDataFrame(rows, SCHEMA))).orderBy("position").collect()
    assert [(r.id, r.position) for r in got] == [(10**12, 0), (None, 1), (2**63 - 1, 2), (-1, 3)]
    d = spark.createDataFrame([("b", "http://a/", "x" * 200), ("a", "http://a/", "x" * 200)], "page_id string, url string, html string")
    assert {(r.id, r.refers_to) for r in m.capture_histories(d).collect()} == {("a", None), ("b", "a")}


def test_dates_have_four_digits_for_the_year():
    assert m.iso(-(10**15)) == "0001-01-01T00:00:00Z" and m.iso(10**15) == "9999-12-31T23:59:59Z" and m.iso(None) == "1970-01-01T00:00:00Z"


def test_a_thousand_runs_are_merged_by_ranges(spark, tmp_path, monkeypatch):
    uri = f"file://{tmp_path}"
    rng = random.Random(4)
    fs, root = m.file_system(uri)
    every, rows, want = 4, [], []
    for k in range(1000):
        w = m.RunWriter(fs, f"{root}/{k}.run", every)
        held = sorted((("k%03d" % rng.randrange(400), "t", k * 100 + j) for j in range(rng.randint(1, 12))), key=m.order)
        for c in held:
            w.add([*c, ["u", "response", "d", 1, None, "a", 0, 1]])
        want += held
        rows.append((f"{k}.run", f"{k}.run", w.n, m.json.dumps(w.close())))
    runs = spark.createDataFrame(rows, m.RUN).repartition(4)
    plans = []
    kept = m.materialize
    monkeypatch.setattr(m, "materialize", lambda df, name: plans.append((name, out := kept(df, name))) or out)
    got = m.merge_runs(runs, uri, fan_in=4, range_captures=100, every=every).collect()
    got.sort(key=lambda r: (r.part, r.seq))
    assert [(r.url_key, r.timestamp, r.id) for r in got] == sorted(want, key=m.order)
    passes = [df for name, df in plans if name == "runs"]
    assert len(passes) >= 4
    # No task wrote more than its range and what lies between two marks of each run; later passes have many files.
    assert max(r.captures for df in passes for r in df.collect()) <= 100 + 5 * 4 * every
    assert max(Counter(r.run for r in passes[-1].collect()).values()) > 10


def test_empty_table(spark):
    assert m.capture_histories(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_timestamps_order_captures(spark):
    d = spark.createDataFrame([(1, "http://a/", "p" * 200, 50), (2, "http://a/", "q" * 200, 40)], SCHEMA + ", at long")
    got = m.capture_histories(d.selectExpr("page_id", "url", "html", "timestamp_seconds(at) AS at"), time_col="at").collect()
    assert [r.id for r in sorted(got, key=lambda r: (r.part, r.seq))] == [2, 1] and {r.timestamp for r in got} == {"1970-01-01T00:00:50Z", "1970-01-01T00:00:40Z"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=8), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    tree = m.LoserTree([[((x,), (k, x)) for x in r] for k, r in enumerate(runs)])
    got = [v for _, v in tree]
    # Equal keys come in the order of their runs.
    assert got == sorted(((k, x) for k, r in enumerate(runs) for x in r), key=lambda v: (v[1], v[0]))


def test_records_are_read_piece_by_piece():
    import gzip

    rows = [{"id": k, "url": f"http://h/{k}", "payload": bytes([k]) * (k * 997), "digest": "d", "refers_to": 0 if k == 3 else None} for k in range(6)]
    raw = b"".join(gzip.compress(m.record(r, "2024-01-01T00:00:00Z")) for r in rows)
    for chunk in (1, 7, 1 << 20):
        found = list(m.read_records(io.BytesIO(raw), chunk))
        assert [int(h["X-Capture-ID"]) for _, _, h, _ in found] == list(range(6))
        assert sum(n for _, n, _, _ in found) == len(raw)
        assert found[5][3].endswith(bytes([5]) * 4985) and found[3][2]["WARC-Type"] == "revisit"


def test_url_keys():
    assert m.url_key("HTTP://user@WWW.Example.com:80/A?b#c") == "com,example)/a?b"
    assert m.url_key("https://x.org") == "org,x)/" and m.url_key(None) == "" and m.url_key("mailto:A") == "mailto:a"


def test_ranges_are_those_of_looking_through_all_files(spark):
    import random

    rng, rows, files = random.Random(6), [], {}
    for k in range(60):
        n, where = rng.randint(1, 40), rng.random()
        names = [f"k{int(where * 50) + j:03}" for j in range(30)] + ["hot"] * 10
        keys = sorted(([rng.choice(names), "2020", rng.choice([None, rng.randint(0, 99)])] for _ in range(n + 1)), key=m.order)
        marks, last = [[key, 100 * j] for j, key in enumerate(keys[:-1])], keys[-1]
        rows.append((k % 2, f"f{k:02}", 10 * n, json.dumps({"marks": marks, "last": last})))
        files[f"f{k:02}"] = (k % 2, [m.order(x) for x, _ in marks], m.order(last))
    grouped = spark.createDataFrame(rows, "g long, file string, captures long, marks string").repartition(4)
    plan = m.plan_ranges(grouped, 300, "long", task_marks=100).orderBy("part").collect()
    key = lambda x: x and m.order(json.loads(x))
    assert len(plan) > 20
    for g in (0, 1):
        own = [r for r in plan if r.g == g]
        assert own[0].low is None and own[-1].high is None and all(a.high == b.low and key(a.high) > (key(a.low) or ()) for a, b in zip(own, own[1:], strict=False))
        for r in own:
            low, high = key(r.low), key(r.high)
            want = []
            for name, (group, keys, last) in sorted(files.items()):
                if group == g and (high is None or keys[0] < high) and (low is None or last >= low):
                    before = [j for j, k in enumerate(keys) if low is not None and k < low]
                    want.append({"file": name, "at": 100 * (before[-1] if before else 0)})
            assert json.loads(r.starts) == want
