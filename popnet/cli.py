"""``python -m popnet.cli prepare|infer``: flags named as the settings."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import MISSING, fields

from popnet.config import CHOICES, InferConfig, PrepareConfig
from popnet.operators.checks import InputError
from popnet.storage import session


def max_features(text: str) -> str | int | float:
    """``1`` is one feature, ``1.0`` is all of them."""
    if text in ("sqrt", "log2"):
        return text
    return int(text) if text.lstrip("+-").isdigit() else float(text)


def bandwidth(text: str) -> str | float:
    """``auto`` or a number."""
    return text if text == "auto" else float(text)


def threads(text: str) -> str | int:
    """``auto`` or a number."""
    return text if text == "auto" else int(text)


_KINDS = {"threads": threads, "max_features": max_features, "bandwidth": bandwidth, "report": None, "bootstrap": None}


def _flags(parser: argparse.ArgumentParser, config: type) -> None:
    for f in fields(config):
        flag = "--" + f.name.replace("_", "-")
        if f.name in ("report", "bootstrap"):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
            continue
        kind = _KINDS.get(f.name) or (int if str(f.type).startswith("int") else float if str(f.type).startswith("float") else str)
        flags = [flag, "--tenx-h5"] if f.name == "counts" else [flag]
        parser.add_argument(*flags, dest=f.name, required=f.default is MISSING, default=None if f.default is MISSING else f.default, type=kind, choices=CHOICES.get(f.name))


def parser() -> argparse.ArgumentParser:
    """The command line."""
    top = argparse.ArgumentParser(prog="popnet", description="Prepare counts and infer population-weighted networks.")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("prepare", help="sparse counts to per-unit inference inputs")
    _flags(one, PrepareConfig)
    two = sub.add_parser("infer", help="one weighted network per cell group")
    _flags(two, InferConfig)
    two.add_argument("--resume", action="store_true")
    two.add_argument("--checkpoint", action=argparse.BooleanOptionalAction, default=True)
    for p in (one, two):
        p.add_argument("--master", default=None)
        p.add_argument("--log-level", choices=("DEBUG", "INFO", "WARNING", "ERROR"), default="WARNING")
    return top


def main(argv: list[str] | None = None) -> int:
    """0: done; 2: invalid input or settings; 130: interrupted."""
    args = vars(parser().parse_args(argv))
    command, master, level = args.pop("command"), args.pop("master"), args.pop("log_level")
    logging.basicConfig(level=level, stream=sys.stderr)
    try:
        if command == "prepare":
            from popnet.plans.prepare import prepare

            done = prepare(session(master=master), PrepareConfig(**args))
            print(f"{len(done.prepared_analysis_units)} units in {done.output_dir}")
        else:
            from popnet.plans.infer import infer

            resume, checkpoint = args.pop("resume"), args.pop("checkpoint")
            run = infer(session(master=master), InferConfig(**args), lambda phase, info: print(phase, *info.items(), file=sys.stderr), resume, checkpoint)
            print(f"{run.n_edges} edges from {run.trained_models} of {run.total_models} models in {run.output_dir}")
    except (InputError, ValueError, TypeError, FileExistsError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
