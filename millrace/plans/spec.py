"""Pipelines from configuration: short names or dotted paths, nested parameters, SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import yaml

from millrace.operators.base import resolve
from millrace.sources.readers import load_yaml

KEYS = ("import_path", "lambda_func", "cfg_path")


@dataclass
class AsyncOptions:
    """How many calls run at once and how many are begun together; 0 or null leaves the backend's own numbers. Progress is Spark's to show."""

    batch_size: int = 0
    concurrency: int = 0
    show_progress: Any = None


@dataclass
class ProcessOptions:
    """num_proc: the number of tasks that rows are dealt to before the step; 0 or null leaves them as they are."""

    num_proc: int = 0
    show_progress: Any = None


@dataclass
class Spec:
    """One component: a class by `import_path`, an expression by `lambda_func`, or another file by `cfg_path`, which
    overrides both. Nested dicts with one of these keys become Specs."""

    import_path: str | None = None
    init_kwargs: dict[str, Any] = field(default_factory=dict)
    lambda_func: str | None = None
    cfg_path: str | None = None
    async_cfg: dict | None = None
    mp_cfg: dict | None = None
    original: dict = field(default_factory=dict, repr=False)

    @classmethod
    def parse(cls, raw: dict) -> Spec:
        if not isinstance(raw, dict):
            raise ValueError(f"expected a mapping, got {type(raw).__name__}")
        known = {"import_path", "init_kwargs", "lambda_func", "cfg_path", "async_cfg", "mp_cfg"}
        if extra := set(raw) - known:
            raise ValueError(f"unknown keys: {sorted(extra)}")
        if raw.get("cfg_path"):
            s = cls.parse(load_yaml(raw["cfg_path"]))
            s.original = raw
            return s
        if not raw.get("import_path") and not raw.get("lambda_func"):
            raise ValueError("import_path, lambda_func or cfg_path is needed")
        AsyncOptions(**(raw.get("async_cfg") or {}))
        ProcessOptions(**(raw.get("mp_cfg") or {}))
        return cls(raw.get("import_path"), nest(raw.get("init_kwargs") or {}), raw.get("lambda_func"), None, raw.get("async_cfg"), raw.get("mp_cfg"), raw)

    @classmethod
    def load(cls, path: str) -> Spec:
        return cls.parse(load_yaml(path))

    def dump(self) -> str:
        return yaml.safe_dump(self.original, allow_unicode=True, sort_keys=False)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.dump())

    def build(self):
        """The component, its nested ones built first."""
        if self.lambda_func:
            from millrace.operators.relational import Expression

            return Expression(expr=self.lambda_func)
        made = resolve(self.import_path)(**build(self.init_kwargs))
        if self.async_cfg and hasattr(made, "backend"):
            options = AsyncOptions(**self.async_cfg)
            made.backend.concurrency = options.concurrency or made.backend.concurrency
            made.backend.batch_size = options.batch_size or made.backend.batch_size
        if self.mp_cfg and (n := ProcessOptions(**self.mp_cfg).num_proc):
            made.num_tasks = n
        return made


def nest(x):
    if isinstance(x, dict):
        return Spec.parse(x) if any(k in x for k in KEYS) else {k: nest(v) for k, v in x.items()}
    return [nest(v) for v in x] if isinstance(x, list) else x


def build(x):
    if isinstance(x, Spec):
        return x.build()
    if isinstance(x, dict):
        return {k: build(v) for k, v in x.items()}
    return [build(v) for v in x] if isinstance(x, list) else x
