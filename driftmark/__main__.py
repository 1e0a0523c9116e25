"""python -m driftmark prepare|estimate|decode|frames --root ROOT [--tags FOLDER --model URI --settings FILE]"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace
from datetime import timedelta

from driftmark.operators.movement import Predictor
from driftmark.operators.tracks import frames
from driftmark.plans import workflow
from driftmark.session import create_session
from driftmark.sources import store
from driftmark.sources.model import load_model
from driftmark.sources.tags import load_tag


def settings_from(path: str | None) -> workflow.Settings:
    """Settings from a JSON object by their names; ``step`` in seconds, ``predictor`` as kind and settings."""
    if not path:
        return workflow.Settings()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if "step" in given:
        given["step"] = timedelta(seconds=given["step"])
    if "predictor" in given:
        given["predictor"] = Predictor(**given["predictor"])
    return replace(workflow.Settings(), **given)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="driftmark")
    p.add_argument("command", choices=("prepare", "estimate", "decode", "frames"))
    p.add_argument("--root", required=True)
    p.add_argument("--tags")
    p.add_argument("--model")
    p.add_argument("--grid", type=float, nargs=3, metavar=("LAT0", "LON0", "STEP"))
    p.add_argument("--settings")
    p.add_argument("--master")
    a = p.parse_args(args)
    spark, settings = create_session(master=a.master), settings_from(a.settings)
    if a.command == "prepare":
        if not (a.tags and a.model and a.grid):
            p.error("prepare needs --tags, --model and --grid")
        tags, slices = load_tag(spark, a.tags)
        workflow.prepare(spark, tags, slices, load_model(spark, a.model), a.root, settings, tuple(a.grid))
    elif a.command == "estimate":
        workflow.estimate(spark, a.root, settings)
    elif a.command == "decode":
        workflow.decode(spark, a.root)
    else:
        states, combined, grid = (store.open_table(spark, f"{a.root}/{n}") for n in ("states", "combined", "grid"))
        store.save(frames(states, combined, grid), f"{a.root}/frames")


if __name__ == "__main__":
    main()
