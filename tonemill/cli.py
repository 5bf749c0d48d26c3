"""Commands: ingest, score, check-tone, sample. ``python -m tonemill.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import importlib
import json
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import scoring_sentences
from .operators import metrics, sampling
from .plans import evaluation, ingest, scoring
from .sources import files
from .sources import pages as store


def build_parser() -> argparse.ArgumentParser:
    """The argument parser of all commands."""
    parser = argparse.ArgumentParser(prog="tonemill", description=__doc__)
    parser.add_argument("--data", default="data", help="folder of tables")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("--pages", required=True, help="folder of stored pages")
    p.add_argument("--today", type=date.fromisoformat, default=date.today())
    p = sub.add_parser("score")
    p.add_argument("--validate", help="labelled sentences (JSON lines)")
    p.add_argument("--candidates", nargs="+", default=list(metrics.CANDIDATES), choices=[*scoring.scorer_names(), "supervised"], help="scorers to compare; ``supervised`` is evaluated in order of time")
    p.add_argument("--folds", type=int, default=5, help="folds of the supervised scorer's evaluation")
    p.add_argument("--scorers", help="a module that adds scorers by name (scoring.register_scorer)")
    p.add_argument("--documents", choices=["statement", "minutes"])
    p.add_argument("--scorer", choices=scoring.scorer_names())
    p.add_argument("--since", type=date.fromisoformat)
    p = sub.add_parser("check-tone")
    p.add_argument("--scorer", default="zs-large")
    p = sub.add_parser("sample")
    p.add_argument("--n", type=int, default=sampling.SIZE)
    return parser


def _report(spark: SparkSession, path: str, value: dict) -> None:
    text = json.dumps(value, indent=2, default=str) + "\n"
    files.write_text(spark, path, text)
    print(text)


def main(argv: list[str] | None = None) -> None:
    """Run one command."""
    early = argparse.ArgumentParser(add_help=False)
    early.add_argument("--scorers")
    if module := early.parse_known_args(argv)[0].scorers:
        importlib.import_module(module)  # its names are choices then
    parser = build_parser()
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    at = args.data.rstrip("/")
    if args.command == "ingest":
        pages = store.read_pages(spark, args.pages).cache()
        calendars = store.look_up(store.calendar_urls(spark), pages, "url", "html")
        meetings = ingest.load_meetings(calendars, args.today)
        store.write_table(meetings, f"{at}/meetings.parquet")
        meetings = spark.read.parquet(f"{at}/meetings.parquet")
        counts = ingest.store_documents(meetings, pages, f"{at}/documents.parquet", f"{at}/stripped.parquet")
        for title, table in ingest.summarise(meetings, spark.read.parquet(f"{at}/documents.parquet")).items():
            print(title)
            table.show(100, False)
        _report(spark, f"{at}/ingest_counts.json", counts)
    elif args.command == "score" and args.validate:
        labelled, names = store.read_sentences(spark, args.validate).cache(), [n for n in args.candidates if n != "supervised"]
        if names:
            found = scoring.validate(labelled, {n: scoring.scorer(n) for n in names})
            store.write_predictions(found[0], f"{at}/validation_predictions")
            _report(spark, f"{at}/validation_metrics.json", scoring.validation_summary(found, names))
        if "supervised" in args.candidates:
            _report(spark, f"{at}/supervised_folds.json", {"folds": [r.asDict() for r in evaluation.expanding_folds(labelled, args.folds).collect()]})
    elif args.command == "score" and args.documents and args.scorer:
        documents, name = spark.read.parquet(f"{at}/documents.parquet"), f"{at}/tone_{args.scorer}_{args.documents}"
        if args.scorer == "lexicon":
            scored, sentences = scoring.score_documents(documents, args.documents, args.since)
        else:
            scored, sentences = scoring.score_with_model(spark, documents, args.documents, scoring.scorer(args.scorer), f"{name}_partial", args.since)
        store.write_table(scored, f"{name}.parquet")
        store.write_table(sentences, f"{name}_sentences.parquet")
        scoring.forget(spark, f"{name}_partial")
    elif args.command == "score":
        parser.error("score: give --validate, or --documents with --scorer")
    elif args.command == "check-tone":
        read = lambda n: spark.read.parquet(f"{at}/{n}.parquet")
        checked = scoring.check_tone(read("documents"), read(f"tone_{args.scorer}_statement"), read("tone_lexicon_statement"))
        store.write_table(checked[2], f"{at}/statement_tone_{args.scorer}.parquet")
        _report(spark, f"{at}/statement_checks_{args.scorer}.json", scoring.check_summary(checked, args.scorer))
    else:
        docs = spark.read.parquet(f"{at}/documents.parquet").where((F.col("doc_type") == "statement") & F.col("scheduled"))
        store.write_sentences(sampling.sentence_sample(docs, scoring_sentences(F.col("clean_text")), args.n), f"{at}/statement_sentences.jsonl")


if __name__ == "__main__":
    main()
