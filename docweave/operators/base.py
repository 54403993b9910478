"""The registry of stages and the run of a pipeline."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from docweave.errors import InvalidStage, UnsupportedStage
from docweave.plans.frame import Context, Frame

Stage = Callable[[Any, Frame | None, Context], Frame]
STAGES: dict[str, Stage] = {}
#: Stages that make their own rows, and so come first.
SOURCES: set[str] = set()
#: Stages that end a pipeline.
SINKS: set[str] = set()


def stage(*names: str, source: bool = False, sink: bool = False):
    def note(function: Stage) -> Stage:
        for name in names:
            STAGES[name] = function
            if source:
                SOURCES.add(name)
            if sink:
                SINKS.add(name)
        return function

    return note


def parse(pipeline: Any) -> list[tuple[str, Any]]:
    if not isinstance(pipeline, list):
        raise InvalidStage("a pipeline is an array of stages")
    out = []
    for i, s in enumerate(pipeline):
        if not isinstance(s, dict) or len(s) != 1:
            raise InvalidStage("a stage is a document with one name")
        ((name, spec),) = s.items()
        if name not in STAGES:
            raise UnsupportedStage(name)
        if name in SOURCES and i:
            raise InvalidStage(f"{name} is only possible as the first stage")
        if name in SINKS and i != len(pipeline) - 1:
            raise InvalidStage(f"{name} is only possible as the last stage")
        out.append((name, spec))
    return out


def run_pipeline(pipeline: list, frame: Frame | None, context: Context) -> Frame:
    """Compile all stages onto one lazy plan. frame is None where the pipeline has no collection."""
    from docweave.operators.rewrite import rewritten

    stages = rewritten(parse(pipeline))
    for i, (name, spec) in enumerate(stages):
        if name in SINKS and context.nested:
            raise InvalidStage(f"{name} is not possible inside {context.nested}")
        if frame is None and not (i == 0 and name in SOURCES):
            raise InvalidStage(f"{name} needs a collection")
        frame = STAGES[name](spec, frame, context)
    if frame is None:
        raise InvalidStage("an empty pipeline needs a collection")
    return frame
