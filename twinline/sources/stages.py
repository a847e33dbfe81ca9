"""Which stages are done, from what, and where their outputs are.

Each stage has one small JSON record. A run of a stage writes its outputs to a folder of
its own, and the record is what points to it, so until a run is finished everybody sees
the outputs of the one before. The record also names the records that the run was
built on. A stage is *sound* if those are still the ones in force, all the way back; else
it holds answers for an earlier input.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import Row, SparkSession

from twinline.sources.files import children, delete, exists, output_ready, rename

SCHEMA = "stage string, completed_at string, config string, metadata string"
NAME = re.compile(r"[A-Za-z0-9_-]+")
STAGES = "stages"


class StaleStage(RuntimeError):
    """A stage was built on a run of another stage that has been replaced since."""


def stage_path(folder: str, stage: str) -> str:
    """Place of a stage's record; the name must be fit to be a file's."""
    if not NAME.fullmatch(stage):
        raise ValueError(f"a stage name has letters, digits, _ and - only: {stage!r}")
    return f"{folder}/{stage}.ok"


def _next_records(spark: SparkSession, folder: str, stage: str) -> list[str]:
    """Records of the stage that were written and not yet put in their place, the latest last."""
    begins = f"{stage_path(folder, stage)}.next-"
    return sorted(p for p in children(spark, folder) if p.startswith(begins) and exists(spark, f"{p}/_SUCCESS"))


def mark_done(
    spark: SparkSession, folder: str, stage: str, config: str = "", metadata: dict | None = None
) -> str:
    """Record a stage as done under the given fingerprint.

    The record is written beside the one in force and then takes its place. If that
    breaks off in between, the new one counts from where it is.
    """
    path, now = stage_path(folder, stage), datetime.now(timezone.utc).isoformat()
    row = (stage, now, config, json.dumps(metadata or {}))
    fresh = f"{path}.next-{re.sub('[^0-9]', '', now)}"
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").json(fresh)
    delete(spark, path)
    rename(spark, fresh, path)
    for left in _next_records(spark, folder, stage):
        delete(spark, left)
    return path


def stage_record(spark: SparkSession, folder: str, stage: str) -> Row | None:
    """The record of a stage, if it was finished."""
    path = stage_path(folder, stage)
    found = [*([path] if exists(spark, f"{path}/_SUCCESS") else []), *_next_records(spark, folder, stage)]
    return spark.read.schema(SCHEMA).json(found[-1]).first() if found else None


def is_done(
    spark: SparkSession, folder: str, stage: str, config: str | None = "", artifacts: tuple[str, ...] = ()
) -> bool:
    """True if the stage finished under the same fingerprint and its outputs are whole.

    None is the fingerprint of inputs that nobody has named: such a stage runs again.
    """
    record = stage_record(spark, folder, stage) if config is not None else None
    return record is not None and record["config"] == config and all(output_ready(spark, a) for a in artifacts)


def clear_stage(spark: SparkSession, folder: str, stage: str) -> None:
    for left in _next_records(spark, folder, stage):
        delete(spark, left)
    delete(spark, stage_path(folder, stage))


# --- stages that build on each other ---------------------------------------------------


def _metadata(record: Row) -> dict:
    return json.loads(record["metadata"])


def identity(record: Row) -> list[str]:
    """What tells one run of a stage from another."""
    return [record["config"], record["completed_at"]]


def sound(spark: SparkSession, base: str, stage: str) -> bool:
    """True if the stage is done and every record that it was built on, and those on, is in force."""
    record = stage_record(spark, f"{base}/{STAGES}", stage)
    if record is None:
        return False
    for before, known in _metadata(record).get("built_on", {}).items():
        current = stage_record(spark, f"{base}/{STAGES}", before)
        if current is None or identity(current) != known or not sound(spark, base, before):
            return False
    return True


def require_sound(spark: SparkSession, base: str, *stages: str) -> dict[str, list[str]]:
    """What a stage that builds on ``stages`` records of them; raises if one is missing or not sound."""
    found = {}
    for stage in stages:
        record = stage_record(spark, f"{base}/{STAGES}", stage)
        if record is None:
            raise FileNotFoundError(f"run the {stage} stage first: {base} has no record of it")
        if not sound(spark, base, stage):
            raise StaleStage(f"run the {stage} stage again: what it was built on has been replaced ({base})")
        found[stage] = identity(record)
    return found


def new_run(base: str, stage: str) -> str:
    """A fresh folder for the outputs of a run of a stage."""
    return f"{base}/{stage}/{uuid.uuid4().hex[:12]}"


def located(spark: SparkSession, base: str, stage: str, artifact: str) -> str:
    """Where the finished output ``artifact`` of a stage is; where it is by hand if no run made it."""
    record = stage_record(spark, f"{base}/{STAGES}", stage)
    run = _metadata(record).get("run") if record else None
    return f"{base}/{run}/{artifact}" if run else f"{base}/{artifact}"


def publish(
    spark: SparkSession, base: str, stage: str, config: str, run: str, built_on: dict[str, list[str]], metadata: dict
) -> None:
    """Put a finished run in force and remove the outputs of runs before it."""
    known = {"run": run.removeprefix(f"{base}/"), "built_on": built_on}
    mark_done(spark, f"{base}/{STAGES}", stage, config, metadata | known)
    for left in children(spark, f"{base}/{stage}"):
        if left != run:
            delete(spark, left)
