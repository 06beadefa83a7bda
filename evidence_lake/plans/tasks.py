"""Task specifications: classifiers and miners as data, checked before anything runs."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import ClassVar

from evidence_lake.functions.codes import ACCESS_LABELS, REGION_LABELS, TYPE_LABELS

KEY = re.compile(r"[a-z][a-z0-9_]*")
#: Results a task takes when its spec names no number (fixed values).
TOP_K = {"classifier": 10, "miner": 15}
MOST_ATTEMPTS = 3


@dataclass(frozen=True)
class Label:
    code: str
    name: str
    definition: str = ""
    examples: tuple[str, ...] = ()


@dataclass(frozen=True)
class Task:
    key: str
    kind: str
    label: str = ""
    description: str = ""
    top_k: int = 0
    labels: tuple[Label, ...] = ()
    multi_label: bool = True
    default_label: str | None = None
    templates: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()

    @property
    def table(self) -> dict[str, str]:
        return {x.code: x.name for x in self.labels}

    @property
    def default(self) -> str:
        """The default code, else the last one."""
        return self.default_label or self.labels[-1].code

    def queries(self) -> list[tuple[str, int, int, str]]:
        """(category, category_ord, template_ord, text): labels' examples, else their definitions, else the task's templates."""
        if self.kind == "miner":
            return [("evidence", 0, i, t) for i, t in enumerate(self.templates)]
        own = [(x.name, i, j, t) for i, x in enumerate(self.labels) for j, t in enumerate(x.examples or ((x.definition,) if x.definition else ()))]
        return own or [("evidence", 0, i, t) for i, t in enumerate(self.templates)]


def parse(raw: dict) -> Task:
    """A checked task; what is wrong raises ValueError with the field's name."""
    key, kind = str(raw.get("key", "")), raw.get("kind", "classifier")
    if not KEY.fullmatch(key):
        raise ValueError(f"key: {key!r} must be lower-case letters, digits and underscores")
    if kind not in TOP_K:
        raise ValueError(f"kind: {kind!r} must be one of {sorted(TOP_K)}")
    labels = tuple(Label(str(x["code"]), str(x.get("name") or x["code"]), x.get("definition", ""), tuple(x.get("examples", ()))) for x in raw.get("labels", ()))
    codes = [x.code for x in labels]
    if kind == "classifier" and not labels:
        raise ValueError("labels: a classifier needs one")
    if len(set(codes)) < len(codes):
        raise ValueError("labels: codes must differ")
    default = raw.get("default_label")
    if default is not None and default not in codes:
        raise ValueError(f"default_label: {default!r} is no code")
    templates = tuple(raw.get("retrieval_templates", ()))
    if kind == "miner" and not templates:
        raise ValueError("retrieval_templates: a miner needs one")
    title = raw.get("label") or key.replace("_", " ").title()
    return Task(key, kind, title, raw.get("description", ""), int(raw.get("top_k") or TOP_K[kind]), labels, bool(raw.get("multi_label", True)), default, templates, tuple(raw.get("section_filters", ()) or ()))


def _builtin(key: str, label: str, table: dict[str, str], default: str) -> Task:
    labels = tuple(Label(c, n, f"passages that show {n.lower().replace('_', ' ')}") for c, n in table.items())
    return Task(key, "classifier", label, top_k=TOP_K["classifier"], labels=labels, default_label=default)


PAPER_KINDS = {"RESEARCH": "Original research", "REVIEW": "Review", "MODEL": "Modelling study", "OTHER": "Other", "UNCLEAR": "Unclear"}


#: Eight ways in which papers speak of what a miner looks for.
MINERS = {
    "find_data_sources": (
        "data were obtained from",
        "a database or registry was used",
        "survey data set and the years it covers",
        "satellite images or remote sensing products as inputs",
        "records of an agency, an archive or a station network",
        "field samples, measurements or interviews of our own",
        "simulation output or reanalysis taken as input",
        "data availability: where the data of this paper are",
    ),
    "find_supplementary_links": (
        "supplementary material available at",
        "link to a repository",
        "supporting information can be found online",
        "code and scripts are archived under",
        "data deposited with a DOI or accession number",
        "appendix with further tables and figures",
        "additional files of this article",
        "project page, tool or dashboard on the web",
    ),
    "identify_key_references": (
        "builds on earlier work",
        "following the method of",
        "as first shown by",
        "in agreement with previous studies",
        "in contrast to what others found",
        "the theory or model that this paper adopts",
        "reviews that sum up the field",
        "the study that is replicated or extended here",
    ),
}
#: Key, label and the sections that are searched (fixed values; none: all).
MINER_KINDS = (
    ("find_data_sources", "Data sources", ()),
    ("find_supplementary_links", "Supplementary links", ()),
    ("identify_key_references", "Key references", ("Introduction", "Literature Review", "Background", "Methods", "Discussion")),
)


class Registry:
    """Tasks by key; the built-in ones can't be replaced."""

    def __init__(self) -> None:
        own = [
            _builtin("data_accessibility", "Data accessibility", ACCESS_LABELS, "F"),
            _builtin("geo", "Geographic scope", REGION_LABELS, "H"),
            _builtin("data_type", "Data type", TYPE_LABELS, "H"),
            _builtin("paper_type", "Paper type", PAPER_KINDS, "UNCLEAR"),
            *(Task(key, "miner", label, top_k=TOP_K["miner"], templates=MINERS[key], sections=where) for key, label, where in MINER_KINDS),
        ]
        self._builtin = {t.key: t for t in own}
        self._added: dict[str, Task] = {}

    def add(self, task: Task) -> None:
        if task.key in self._builtin:
            raise ValueError(f"{task.key} is built in")
        self._added[task.key] = task

    def load(self, path: str) -> list[str]:
        """Adds the task of a JSON file, or of each in a folder, by name; returns their keys."""
        p = Path(path)
        tasks = [parse(json.loads(f.read_text())) for f in (sorted(p.glob("*.json")) if p.is_dir() else [p])]
        for t in tasks:
            self.add(t)
        return [t.key for t in tasks]

    def get(self, key: str) -> Task:
        found = self._added.get(key) or self._builtin.get(key)
        if not found:
            raise ValueError(f"unknown task {key!r}; one of {self.keys()}")
        return found

    def keys(self) -> list[str]:
        return sorted({**self._builtin, **self._added})


@dataclass
class Settings:
    """What a workspace fixes; index settings stay once there are points."""

    path: str
    chunker: str = "paragraph"
    chunk_min: int = 20
    chunk_size: int = 600
    chunk_overlap: int = 100
    dims: int = 32
    mode: str = "hybrid"
    top_k: int = 5
    prefetch_k: int = 50
    rrf_k: int = 60
    threshold: float | None = None
    extra: dict = field(default_factory=dict)

    #: Section and key of each setting in a workspace file (fixed values).
    FILE: ClassVar[dict[str, tuple[str, str]]] = {
        "chunker": ("indexing", "chunker"), "chunk_min": ("indexing", "min_chunk_size"), "chunk_size": ("indexing", "chunk_size"), "chunk_overlap": ("indexing", "chunk_overlap"),
        "dims": ("indexing", "dims"), "mode": ("retrieval", "mode"), "prefetch_k": ("retrieval", "prefetch_k"), "rrf_k": ("retrieval", "rrf_k"), "threshold": ("retrieval", "threshold"),
        "top_k": ("llm", "workflow_top_k"),
    }
    FROZEN = ("chunker", "chunk_min", "chunk_size", "chunk_overlap", "dims")

    def index_settings(self) -> dict:
        return {k: getattr(self, k) for k in self.FROZEN}

    def chunker_params(self) -> dict:
        return {"paragraph": {"least_chars": self.chunk_min}, "fixed_size": {"size": self.chunk_size, "overlap": self.chunk_overlap}}.get(self.chunker, {})

    @classmethod
    def read(cls, file: str, path: str | None = None) -> Settings:
        """Settings of a workspace's TOML file; what is absent or empty takes its default, other keys go into extra. path: the workspace, else the file's folder."""
        at = Path(file)
        if not at.exists():
            raise FileNotFoundError(f"no settings under {file}")
        data = tomllib.loads(at.read_text())
        own = {name: data.get(part, {}).get(key) for name, (part, key) in cls.FILE.items()}
        known = set(cls.FILE.values())
        extra = {f"{part}.{key}": v for part, keys in data.items() if isinstance(keys, dict) for key, v in keys.items() if (part, key) not in known}
        return cls(path or at.resolve().parent.as_uri(), **{k: v for k, v in own.items() if v not in (None, "", 0)}, extra=extra)

    def write(self, file: str) -> None:
        """The settings as TOML, read again by `read`."""
        parts: dict[str, dict] = {}
        for name, (part, key) in self.FILE.items():
            if getattr(self, name) is not None:
                parts.setdefault(part, {})[key] = getattr(self, name)
        for key, value in self.extra.items():
            part, _, name = key.partition(".")
            parts.setdefault(part, {})[name] = value
        # JSON's strings, numbers, booleans and lists are TOML's, too
        Path(file).write_text("\n".join(f"[{part}]\n" + "".join(f"{k} = {json.dumps(v)}\n" for k, v in keys.items()) for part, keys in parts.items()))
