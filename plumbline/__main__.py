"""python -m plumbline index CORPUS INDEX | ask INDEX QUESTION | eval INDEX QUESTIONS.json OUT | serve INDEX UPLOADS"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.config import MODES, Config
from plumbline.plans.engine import Corpora, Engine, summary
from plumbline.plans.service import Service, serve
from plumbline.sources.datasets import questions
from plumbline.sources.shared import stored
from plumbline.sources.store import write_json


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in (("index", ("corpus", "index")), ("ask", ("index", "question")), ("eval", ("index", "questions", "out")), ("serve", ("index", "uploads"))):
        one = commands.add_parser(name)
        for w in words:
            one.add_argument(w)
        one.add_argument("--mode", choices=MODES, default="hybrid")
        one.add_argument("--rerank", action="store_true")
        one.add_argument("-k", type=int, default=5)
        one.add_argument("--port", type=int, default=8000)
        one.add_argument("--token")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    engine = Engine(spark, Config(k=given.k, retrieval_mode=given.mode, rerank=given.rerank))
    if given.command == "index":
        engine.index_dir(given.corpus).save(given.index)
        print(f"indexed {engine.passages.count()} passages")
        return 0
    if not (given.index.find("://") > 0 or os.path.isdir(given.index)):
        parser.error(f"no index at {given.index}")
    engine.load(given.index)
    if given.command == "ask":
        r = engine.answer([given.question]).first().asDict()
        print(r.pop("answer"))
        for name, value in r.items():
            print(f"{name}: {f'{value:.3f}' if isinstance(value, float) else 'n/a' if value is None else value}")
        return 0
    if given.command == "serve":
        serve(Service(engine, Corpora(spark, given.uploads, engine.config), token=given.token), port=given.port).serve_forever()
        return 0
    asked = questions(spark, given.questions)
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    answered = stored(engine.answer(asked.filter(~blank)), "answered")
    write_json(answered, f"{given.out}/results")
    write_json(asked.filter(blank).select("qid", F.lit("an empty question").alias("error")), f"{given.out}/errors")
    write_json(summary(answered), f"{given.out}/summary")
    summary(answered).show(truncate=False, vertical=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
