"""Command line: run, eval, ablate, info."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict
from pathlib import Path

from drillmill.settings import load_settings, setup_logging


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="drillmill")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="a folder of forms to CSV rows")
    run.add_argument("--input")
    run.add_argument("--output")
    run.add_argument("--single-file", action="store_true", help="gather the rows into one file, in one task")
    run.add_argument("--verbose", action="store_true")
    ev = sub.add_parser("eval", help="labels to an evaluation report")
    ev.add_argument("--predictor", choices=("mock", "real"), default="mock")
    ev.add_argument("--input", help="the folder of the labelled files, for the real predictor")
    ev.add_argument("--labels", required=True)
    ev.add_argument("--out-dir", default="outputs")
    ev.add_argument("--seed", type=int, default=0)
    ab = sub.add_parser("ablate", help="the evaluation under each configuration, against the baseline")
    ab.add_argument("--labels", required=True)
    ab.add_argument("--input")
    ab.add_argument("--out-dir", default="outputs")
    sub.add_parser("info", help="the settings in force")
    args = parser.parse_args(argv)
    settings = load_settings(env_file=".env")
    setup_logging(getattr(args, "verbose", False))
    if args.command == "info":
        for name, value in asdict(settings).items():
            print(f"{name} = {'***' if 'token' in name and name.startswith('hf') and value else value}")
        return 0
    from drillmill.session import build_session

    if args.command in ("eval", "ablate") and not Path(args.labels).exists():
        print(f"no labels at {args.labels}", file=sys.stderr)
        return 1
    spark = build_session()
    if args.command == "run":
        from drillmill.plans.pipeline import run_batch
        from drillmill.sources.labels import read_text
        from drillmill.sources.sinks import write_csv

        rows = run_batch(spark, args.input or settings.input_folder, settings, read_text(settings.prompt_file) if settings.prompt_file else "")
        write_csv(rows, args.output or settings.output_csv, single_file=args.single_file)
        return 0
    from drillmill.operators.predict import MockPredictor
    from drillmill.plans.pipeline import RealPredictor, run_ablations, run_eval
    from drillmill.sources.labels import read_labels, read_text
    from drillmill.sources.sinks import render_ablations, render_markdown, write_text

    labels, folder = read_labels(spark, args.labels), args.input or settings.input_folder
    prompt = read_text(settings.prompt_file) or "" if settings.prompt_file else ""
    if args.command == "ablate":
        write_text(render_ablations(run_ablations(labels, folder, settings, prompt)), f"{args.out_dir}/ablations.md")
        return 0
    scores, summary = run_eval(labels, MockPredictor(args.seed) if args.predictor == "mock" else RealPredictor(folder, settings, prompt))
    write_text(render_markdown(scores, summary), f"{args.out_dir}/metrics.md")
    return 0


if __name__ == "__main__":
    sys.exit(main())
