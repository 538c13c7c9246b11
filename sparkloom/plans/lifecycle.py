"""Staged runs on the driver: frozen plans, manifests with a state machine, resume checks, tamper and capability gates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from sparkloom.sources.records import file_digest, write_json

#: Where each state may go.
MOVES = {
    "planned": {"running"},
    "running": {"completed", "failed", "interrupted"},
    "failed": {"running"},
    "interrupted": {"running"},
    "completed": set(),
}
#: Parts of a key that make its value a secret.
SECRET_KEYS = ("token", "secret", "password", "api_key", "authorization")
ALWAYS_AGAIN = ("validate_environment", "validate_data")
SCHEMA = 1


@dataclass
class Plan:
    """What a run does: its stages in order, its inputs (name -> path), its settings."""

    name: str
    stages: list[str]
    inputs: dict[str, str]
    settings: dict = field(default_factory=dict)
    resume: bool = False

    def digest(self) -> str:
        """Of all but whether it resumes, so that a resumed run is the same plan."""
        body = {k: v for k, v in asdict(self).items() if k != "resume"}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def faults(self) -> list[str]:
        out = []
        if not self.name or any(ch in self.name for ch in "/\\") or self.name in (".", ".."):
            out.append("the name must be a single path part")
        if not self.stages or len(set(self.stages)) != len(self.stages):
            out.append("stages must be distinct and there must be one")
        paths = {k: Path(v).resolve() for k, v in self.inputs.items()}
        for a, p in paths.items():
            for b, q in paths.items():
                if a < b and (p == q or p in q.parents or q in p.parents):
                    out.append(f"{a} and {b} must be distinct and not nested")
        return out


@dataclass
class Manifest:
    plan_sha256: str
    inputs_sha256: dict[str, str]
    state: str = "planned"
    done: list[str] = field(default_factory=list)
    outputs_sha256: dict[str, str] = field(default_factory=dict)
    error: str | None = None
    schema_version: int = SCHEMA
    updated: str = ""

    def move(self, state: str) -> None:
        if state not in MOVES.get(self.state, set()):
            raise ValueError(f"a {self.state} run can't become {state}")
        self.state = state


def scrub(value):
    """value with what secret keys hold replaced, at any depth of dicts and lists."""
    if isinstance(value, dict):
        return {k: "[redacted]" if any(s in str(k).lower() for s in SECRET_KEYS) else scrub(v) for k, v in value.items()}
    return [scrub(v) for v in value] if isinstance(value, list) else value


def save(path: str, manifest: Manifest) -> None:
    manifest.updated = datetime.now(timezone.utc).isoformat()
    write_json(path, scrub(asdict(manifest)))


def load(path: str) -> Manifest:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if value.get("schema_version") != SCHEMA:
        raise ValueError(f"unsupported manifest version {value.get('schema_version')}")
    return Manifest(**value)


def run(plan: Plan, folder: str, actions: dict[str, Callable[[Plan], dict[str, str] | None]], dry: bool = False) -> Manifest:
    """Runs the plan's stages, with the manifest written around each; a stage returns its output files (name -> path).

    A dry run checks and hashes only. Resuming takes an interrupted or failed manifest of the same plan and inputs;
    finished stages whose outputs are unchanged are skipped, validation never is. An input that changes in the
    meantime stops the run."""
    if faults := plan.faults() + [f"no action for {s}" for s in plan.stages if s not in actions]:
        raise ValueError("; ".join(faults))
    inputs = {k: file_digest(v) for k, v in plan.inputs.items()}
    path = f"{folder}/{plan.name}.manifest.json"
    manifest = Manifest(plan.digest(), inputs)
    if dry:
        return manifest
    if Path(path).exists():
        if not plan.resume:
            raise FileExistsError(path)
        manifest = load(path)
        if (manifest.plan_sha256, manifest.inputs_sha256) != (plan.digest(), inputs):
            raise ValueError("the plan or its inputs differ from those of the run to resume")
        if manifest.state == "running":
            manifest.move("interrupted")
    manifest.move("running")
    manifest.error = None
    save(path, manifest)
    try:
        for stage in plan.stages:
            if stage in manifest.done and stage not in ALWAYS_AGAIN and unchanged(manifest, stage):
                continue
            for name, digest in inputs.items():
                if file_digest(plan.inputs[name]) != digest:
                    raise ValueError(f"input {name} changed during the run")
            for name, output in (actions[stage](plan) or {}).items():
                manifest.outputs_sha256[f"{stage}:{name}:{output}"] = file_digest(output)
            if stage not in manifest.done:
                manifest.done.append(stage)
            save(path, manifest)
        manifest.move("completed")
    except KeyboardInterrupt:
        manifest.move("interrupted")
        raise
    except Exception as e:
        manifest.move("failed")
        manifest.error = f"{type(e).__name__}: {e}"
        raise
    finally:
        save(path, manifest)
    return manifest


def unchanged(manifest: Manifest, stage: str) -> bool:
    """Whether the stage's outputs are there as they were."""
    own = {k: v for k, v in manifest.outputs_sha256.items() if k.split(":", 1)[0] == stage}
    return all(Path(p := k.split(":", 2)[2]).is_file() and file_digest(p) == v for k, v in own.items())
