"""Command line: ``python -m entityflow.cli policy|demo|health``."""

from __future__ import annotations

import argparse
import json
import sys

from entityflow.sources.policies import PolicySet, find_policy_path


def cmd_policy(args: argparse.Namespace) -> int:
    """Print the field policies and what is wrong with them; 1 if anything is."""
    policies = PolicySet.load(args.path or find_policy_path())
    for kind in policies.objects:
        for name in policies.fields(kind):
            p = policies.for_field(name, kind)
            print(f"{kind}.{name:<18} {p.direction:<18} {p.strategy:<16} {','.join(p.ranking)}")
    problems = policies.validate()
    print("\n".join(problems) or "no problems")
    return 1 if problems else 0


def _pipeline(folder: str | None):
    from entityflow.plans.pipeline import Pipeline
    from entityflow.session import get_spark
    from entityflow.sources.database import Database

    return Pipeline(Database(get_spark("entityflow"), folder))


def cmd_demo(args: argparse.Namespace) -> int:
    """Match a synthetic corpus and print what was found and how good it is."""
    from entityflow.operators import matching
    from entityflow.testing import EPOCH_US, synthetic_corpus, true_pairs

    pipeline = _pipeline(args.folder)
    corpus = synthetic_corpus(pipeline.db.spark, args.people)
    pipeline.ingest_records(corpus.drop("person"), EPOCH_US)
    found = pipeline.match(corpus.drop("person"), EPOCH_US)
    recall = matching.blocking_recall(found.scored.select("l", "r"), true_pairs(corpus)).first()
    print(json.dumps({"counts": found.counts(), "model": found.model.report, "blocking_recall": recall.recall}, indent=1))
    return 0


def cmd_health(args: argparse.Namespace) -> int:
    """Print the numbers to watch of the tables in a folder."""
    print(json.dumps(_pipeline(args.folder).health(), indent=1, default=str))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="entityflow")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("policy")
    one.add_argument("path", nargs="?")
    one.set_defaults(run=cmd_policy)
    for name, run in (("demo", cmd_demo), ("health", cmd_health)):
        one = commands.add_parser(name)
        one.add_argument("--folder")
        one.add_argument("--people", type=int, default=60)
        one.set_defaults(run=run)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
