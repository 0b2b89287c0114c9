"""Project settings from a small TOML file or a package file: bad values are dropped and reported, never raised."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields

from tessera.functions.scoring import GRADE_ORDER
from tessera.operators.rules import Thresholds, merge_thresholds

FILE_NAME, PACKAGE_KEY = "tessera.toml", "tessera"
#: Names in settings files, without regard to case, and the fields they set.
KEYS = {f.name.replace("_", ""): f.name for f in fields(Thresholds)} | {"miwarning": "maintainability_warning", "micritical": "maintainability_critical"}
STARTER = """# Limits; leave out what should keep its default.
exclude = []
includePartialAnalysisInScore = true

[thresholds]
cyclomatic = 10
cognitive = 15
lineLength = 120

[gate]
minGrade = "C"
failOn = []
"""


@dataclass
class Gate:
    min_grade: str | None = None
    max_debt_ratio: float | None = None
    fail_on: tuple[str, ...] = ()


@dataclass
class ProjectConfig:
    thresholds: dict = field(default_factory=dict)
    exclude: tuple[str, ...] = ()
    include_partial: bool | None = None
    gate: Gate | None = None
    problems: list[str] = field(default_factory=list)


def _value(text: str):
    if m := re.fullmatch(r'"([^"]*)"|\'([^\']*)\'', text):
        return m[1] if m[1] is not None else m[2]
    if text in ("true", "false"):
        return text == "true"
    if text.startswith("[") and text.endswith("]"):
        return [_value(x.strip()) for x in re.findall(r'"[^"]*"|\'[^\']*\'|[^,\s]+', text[1:-1])]
    return float(text) if "." in text or "e" in text.lower() else int(text)


def parse_toml(text: str) -> tuple[dict[str, dict], list[str]]:
    """Tables of strings, numbers, booleans and one-line lists; "" is the table before the first head. Names in lower case."""
    tables: dict[str, dict] = {"": {}}
    own, problems = tables[""], []
    for n, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*$", "", raw).strip()
        if not line:
            continue
        if m := re.fullmatch(r"\[([^\]]+)\]", line):
            own = tables.setdefault(m[1].strip().lower(), {})
            continue
        name, eq, value = line.partition("=")
        try:
            if not eq or not name.strip():
                raise ValueError
            own[name.strip().lower()] = _value(value.strip())
        except ValueError:
            problems.append(f"line {n}: can't read {raw.strip()!r}")
    return tables, problems


def validate(tables: dict[str, dict], problems: list[str]) -> ProjectConfig:
    out = ProjectConfig(problems=problems)
    root, limits = tables.get("", {}) | tables.get(PACKAGE_KEY, {}), dict(tables.get("thresholds", {}))
    exclude = root.get("exclude", limits.pop("exclude", None))  # a list under [thresholds] is meant for the whole file, too
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    for name, value in limits.items():
        key = KEYS.get(name.replace("_", ""))
        least = 20 if key == "duplication_tokens" else 1
        if key is None:
            problems.append(f"no such threshold: {name}")
        elif not number(value) or value < least:
            problems.append(f"{name} must be a number of at least {least}")
        else:
            out.thresholds[key] = value
    if exclude is not None:
        if isinstance(exclude, list) and all(isinstance(x, str) for x in exclude):
            out.exclude = tuple(exclude)
        else:
            problems.append("exclude must be a list of globs")
    partial = root.get("includepartialanalysisinscore")
    if isinstance(partial, bool):
        out.include_partial = partial
    elif partial is not None:
        problems.append("includePartialAnalysisInScore must be true or false")
    if "gate" in tables:
        g, gate = tables["gate"], Gate()
        grade = g.get("mingrade")
        if grade is not None:
            if isinstance(grade, str) and len(grade) == 1 and grade.upper() in GRADE_ORDER:
                gate.min_grade = grade.upper()
            else:
                problems.append("minGrade must be a grade from A to E")
        ratio = g.get("maxdebtratio")
        if ratio is not None:
            if number(ratio) and 0 <= ratio <= 100:
                gate.max_debt_ratio = float(ratio)
            else:
                problems.append("maxDebtRatio must be a number from 0 to 100")
        fail = g.get("failon")
        if fail is not None:
            ids = [str(x).upper() for x in fail] if isinstance(fail, list) else []
            gate.fail_on = tuple(x for x in ids if re.fullmatch(r"CQ\d{3}", x))
            if not isinstance(fail, list) or len(gate.fail_on) < len(ids):
                problems.append("failOn must be a list of rule ids")
        out.gate = gate
    return out


def parse_config(text: str) -> ProjectConfig:
    return validate(*parse_toml(text))


def parse_package(text: str) -> ProjectConfig | None:
    """Settings under the package file's own key; None without it."""
    try:
        own = json.loads(text).get(PACKAGE_KEY)
    except (ValueError, AttributeError):
        return ProjectConfig(problems=["the package file isn't JSON"])
    if not isinstance(own, dict):
        return None
    low = {k.lower(): v for k, v in own.items()}
    tables = {"": {k: v for k, v in low.items() if not isinstance(v, dict)}}
    tables |= {k: {n.lower(): x for n, x in v.items()} for k, v in low.items() if isinstance(v, dict)}
    return validate(tables, [])


def load_config(root: str) -> ProjectConfig:
    for name, read in ((FILE_NAME, parse_config), ("package.json", parse_package)):
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                if (found := read(f.read())) is not None:
                    return found
    return ProjectConfig()


class ConfigWatch:
    """Settings of a folder that are read anew when their file changes."""

    def __init__(self, root: str):
        self.root = root
        self._seen = self._state()
        self.config = load_config(root)

    def _state(self) -> list[tuple[str, int, int]]:
        found = []
        for name in (FILE_NAME, "package.json"):
            try:
                s = os.stat(os.path.join(self.root, name))
                found.append((name, s.st_mtime_ns, s.st_size))
            except OSError:
                continue
        return found

    def poll(self) -> bool:
        """Whether the limits have changed since the last look, so that rules must run again; other settings are just taken over."""
        state = self._state()
        if state == self._seen:
            return False
        before, self._seen = self.config.thresholds, state
        self.config = load_config(self.root)
        return self.config.thresholds != before


def write_starter(root: str) -> str:
    """A settings file to begin with; refuses to overwrite one."""
    path = os.path.join(root, FILE_NAME)
    with open(path, "x", encoding="utf-8") as f:
        f.write(STARTER)
    return path


@dataclass
class LiveSettings:
    """Settings of a running session, clamped to their ranges; ``limits`` has the limits that were set by hand, which come before the project's."""

    live_delay_ms: int = 300
    max_symbols: int = 300
    max_file_kb: int = 1024
    limits: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.live_delay_ms = min(5000, max(50, self.live_delay_ms))
        self.max_symbols = max(1, self.max_symbols)
        self.max_file_kb = max(1, self.max_file_kb)
        if "duplication_tokens" in self.limits:
            self.limits = self.limits | {"duplication_tokens": max(20, self.limits["duplication_tokens"])}

    def thresholds(self, project: ProjectConfig) -> tuple[Thresholds, dict[str, str]]:
        """Limits in force, and where each comes from."""
        return merge_thresholds(self.limits, project.thresholds)
