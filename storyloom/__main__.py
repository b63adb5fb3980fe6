"""A whole run from the command line.

    python -m storyloom --free-models URL
    python -m storyloom --settings DIR [--no-llm] [--dump DIR] [--limit N] [--site DIR] [--ledger PATH]
                        [--push REMOTE --branch NAME] [--landed GLOB] [--state PATH]

DIR holds sources.yml and watchlist.yml, and for more than a ranking compliance.yml, providers.yml
(tiers quality and cheap) and the prompts analysis.txt, triage.txt and review.txt; stopwords.txt, if it is
there, holds words that don't tell stories apart; .env beside it sets keys. PATH keeps what feeds told to
ask them with, so that unchanged ones aren't sent again. Prints one JSON object and exits with 0 if the run went well.
"""

from __future__ import annotations

import argparse
import functools
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from storyloom.functions import bounds
from storyloom.operators import compliance, ledger, stories
from storyloom.plans import run
from storyloom.shared import materialize
from storyloom.sources import feeds, inference, settings, stored


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="storyloom")
    p.add_argument("--settings", default=".")
    p.add_argument("--free-models", metavar="URL", help="list what a provider offers at no cost, and end")
    p.add_argument("--no-llm", action="store_true")
    p.add_argument("--dump")
    p.add_argument("--limit", type=int)
    p.add_argument("--site", default="site")
    p.add_argument("--ledger", default="ledger")
    p.add_argument("--push")
    p.add_argument("--branch", default="site")
    p.add_argument("--landed", help="read feed documents from files instead of the network")
    p.add_argument("--state", default="feed-state")
    p.add_argument("--as-of", help="a UTC time instead of now")
    args = p.parse_args(argv)
    settings.dotenv(os.path.join(args.settings, ".env"))
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.free_models:
        found = [r.asDict() for r in inference.free_models(spark, args.free_models).collect()]
        return report({"ok": bool(found), "models": found})
    as_of = F.lit(args.as_of or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    load = lambda name: settings.load(os.path.join(args.settings, name))
    conf = load("sources.yml")
    labels, excludes, noise = settings.watchlist(load("watchlist.yml"))
    if args.landed:
        rows = feeds.read_landed(spark, args.landed)
    else:
        spark.dataSource.register(feeds.FeedSource)
        state = json.dumps(stored.read_state(spark, args.state))
        rows = spark.read.format("feeds").option("sources", json.dumps(conf["sources"])).option("state", state).load()
    rows = materialize(rows, "feeds")  # so that feeds are asked once
    previous = materialize(stored.load_previous(spark, args.site, as_of, args.push, args.branch), "previous")
    got = run.rank_feeds(
        rows, settings.sources(spark, conf), as_of, labels, excludes=excludes, noise=noise, weights=settings.weights(labels), previous=previous, limit=args.limit,
        stop_words=settings.words(os.path.join(args.settings, "stopwords.txt")),
    )
    if not args.landed:  # an unchanged feed's row holds what it was asked with
        stored.replace_table(feeds.next_state(rows), args.state)
    n = got.articles.count()
    if not n:
        return report({"ok": False, "reason": "no articles"})
    selected = got.shortlist.where("selected")
    if args.dump:
        stored.write_dump(rows, stories.dump(got.ranked, selected), stories.summary(got.ranked, selected, F.date_format(as_of, "yyyy-MM-dd HH:mm:ss")), args.dump)
    out = {"ok": True, "articles": n, "clusters": got.ranked.count(), "selected": selected.count()}
    if args.no_llm:
        return report(out)

    tiers = load("providers.yml")

    def router(tier: str):
        providers = inference.load_providers(tiers, tier)  # with their keys, which executors don't have
        return lambda: inference.Router(providers)

    payload = [r.asDict(True) | {"cluster_id": r.story_id} for r in stories.triage_payload(got.shortlist, as_of).collect()]
    triaged = inference.triage(payload, router("cheap")(), settings.prompt(args.settings, "triage.txt"))
    if triaged:
        reply = spark.createDataFrame(triaged, "story_id string, triage_score double, reason string, explainer_worthy boolean")
        best = stories.rank(stories.blend_triage(got.shortlist, reply)).limit(args.limit or stories.SELECTED)
        selected = best.drop("triage_score", "reason", "explainer_worthy")
    selected = materialize(selected, "selected")
    facts = stored.read_ledger(spark, args.ledger)
    asked = stories.analysis_payload(selected, ledger.related_facts(ledger.related(facts, selected)))
    valid = functools.partial(bounds.complaint, compliance.ANALYSIS)
    analyses = materialize(inference.analyze(asked, router("quality"), settings.prompt(args.settings, "analysis.txt"), valid), "analyses")
    reviews = inference.review(analyses.withColumnRenamed("reply", "payload"), router("cheap"), settings.prompt(args.settings, "review.txt"))
    rules, markers = settings.rules(load("compliance.yml"))
    checked, items, kept = run.publish_analyses(
        selected, analyses, as_of, facts, previous, materialize(reviews, "reviews"), rules or compliance.RULES, markers or compliance.MARKERS
    )
    items = materialize(items, "items")
    stored.replace_table(kept, args.ledger)
    stored.write_site(items, as_of, args.site, load("compliance.yml").get("disclaimer", {}).get("short", ""))
    out |= {k: v for k, v in run.run_counts(checked).first().asDict().items()}
    if args.push:
        pushed = stored.publish(args.site, args.push, args.branch)
        out |= {"pushed": pushed, "ok": pushed and stored.holds_one_commit(args.push, args.branch)}
    return report(out)


def report(out: dict) -> int:
    print(json.dumps(out, indent=2))
    return 0 if out.get("ok") else 1


if __name__ == "__main__":
    sys.exit(main())
