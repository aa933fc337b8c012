"""A pipeline's TOML text as checked options: names in any case, other names resolved, defaults filled in."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from strandloom.model import ConfigError
from strandloom.operators.demultiplex import check_barcodes
from strandloom.plans.steps import ALIASES, NEEDED, STEPS

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
RESERVED = {"ReadName", "read_no"}
INPUT_OPTIONS = {"interleaved", "options", "index_gzip"}


def plain(key: str) -> str:
    return key.lower().replace("-", "_")


@dataclass
class Plan:
    segments: dict[str, list[str]]  # files of each segment
    interleaved: list[str] | None
    input_options: dict
    steps: list[tuple[str, dict]]
    output: dict | None
    barcodes: dict[str, dict[str, str]]
    options: dict = field(default_factory=dict)


def filled(action: str, raw: dict) -> tuple[str, dict]:
    """The step's own name and all its options."""
    known = ALIASES.get(action.lower().replace("_", ""))
    if known is None:
        raise ConfigError(f"unknown action '{action}'")
    given = {plain(k): v for k, v in raw.items() if plain(k) != "action"}
    out = {}
    for name, (default, others) in STEPS[known].options.items():
        found = [k for k in (name, *others) if plain(k) in given]
        if len(found) > 1:
            raise ConfigError(f"{known}: {' and '.join(found)} mean the same")
        if found:
            out[name] = given.pop(plain(found[0]))
        elif default is NEEDED:
            raise ConfigError(f"{known}: {name} is missing")
        else:
            out[name] = default
    if given:
        raise ConfigError(f"{known}: unknown option {sorted(given)[0]}")
    return known, out


def check_label(label: str, segments: list[str]) -> None:
    if not NAME.fullmatch(label) or label in RESERVED or label.startswith("len_"):
        raise ConfigError(f"'{label}' can't be a tag's name")
    if label in segments:
        raise ConfigError(f"tag '{label}' has the name of a segment")


def used_labels(options: dict) -> set[str]:
    """Tags that a step's options name."""
    out = set()
    for key, value in options.items():
        if key == "in_label" or key == "if_tag":
            out.add(str(value).removeprefix("!")) if value is not None else None
        elif key in ("in_labels", "comment_tags", "comment_location_tags", "tag_histograms"):
            out |= set(value if isinstance(value, list) else [value]) if value else set()
        elif key in ("source", "target") and isinstance(value, str) and value.startswith("tag:"):
            out.add(value[4:])
        elif key == "regions":
            for r in value:
                text = r.get("source", r.get("segment", ""))
                out |= {text[4:]} if isinstance(text, str) and text.startswith("tag:") else set()
        elif key == "expression":
            words = re.findall(r"[A-Za-z_]\w*", value)
            out |= set(words) | {w[4:] for w in words if w.startswith("len_")}
    return out


def check_tags(steps: list[tuple[str, dict]], segments: list[str], barcodes: dict) -> None:
    """Every tag is declared once at a time, before it is used, and is used."""
    alive: dict[str, bool] = {}
    for action, o in steps:
        used = used_labels(o)
        if action in ("ForgetAllTags", "StoreTagsInTable") and not o.get("in_labels"):
            used |= set(alive)
        for label in used:
            if label in alive:
                alive[label] = True
            elif action not in ("EvalExpression",):
                raise ConfigError(f"{action}: no tag '{label}' at this point")
        if action == "ForgetTag":
            alive.pop(o["in_label"])
        if action == "ForgetAllTags":
            alive.clear()
        new = o.get("out_label")
        if new is not None:
            check_label(new, segments)
            if new in barcodes:
                raise ConfigError(f"tag '{new}' has the name of a barcode section")
            if new in alive:
                raise ConfigError(f"tag '{new}' is declared twice")
            alive[new] = False
    idle = sorted(x for x, used in alive.items() if not used)
    if idle:
        raise ConfigError(f"tag '{idle[0]}' is never used")


def parse(text: str) -> Plan:
    raw = {plain(k): v for k, v in tomllib.loads(text).items()}
    unknown = set(raw) - {"input", "step", "transform", "output", "barcodes", "options", "benchmark"}
    if unknown:
        raise ConfigError(f"unknown section '{sorted(unknown)[0]}'")
    given = raw.get("input")
    if not given:
        raise ConfigError("the section input is missing")
    options = {plain(k): v for k, v in given.get("options", {}).items()}
    files = {k: v if isinstance(v, list) else [v] for k, v in given.items() if plain(k) not in INPUT_OPTIONS}
    interleaved = given.get("interleaved")
    if not files:
        raise ConfigError("the section input names no files")
    if interleaved is not None and (len(files) != 1 or len(interleaved) < 2):
        raise ConfigError("interleaved input has one segment with files, and at least two names")
    segments = list(interleaved) if interleaved else sorted(files)
    for s in segments:
        if not NAME.fullmatch(s) or s.lower() == "all" or s.startswith("_internal_"):
            raise ConfigError(f"'{s}' can't be a segment's name")
    if len({len(v) for v in files.values()}) > 1:
        raise ConfigError("segments have different numbers of files")
    general = {plain(k): v for k, v in raw.get("options", {}).items()}
    paths = [p for v in files.values() for p in v]
    if len(set(paths)) < len(paths) and not general.get("accept_duplicate_files"):
        raise ConfigError("a file is named twice")
    barcodes = {}
    for section, table in raw.get("barcodes", {}).items():
        barcodes[section] = {k.upper(): v for k, v in table.items()}
        check_barcodes(barcodes[section])
        if section in segments:
            raise ConfigError(f"barcode section '{section}' has the name of a segment")
    steps = [filled(s.get("action", ""), s) for s in [*raw.get("step", []), *raw.get("transform", [])]]
    names = [o["name"] for a, o in steps if a == "Report"]
    if len(set(names)) < len(names):
        raise ConfigError("two reports have the same name")
    for name in names:
        if name in ("__", "run_info", "report_order"):
            raise ConfigError(f"a report can't be named '{name}'")
    pairing = {"ValidateReadPairing", "ValidateName"} & {a for a, _ in steps}
    if len(segments) > 1 and not pairing and general.get("spot_check_read_pairing", True) and "benchmark" not in raw:
        steps.insert(0, filled("ValidateReadPairing", {}))
    check_tags(steps, segments, barcodes)
    output = {plain(k): v for k, v in raw["output"].items()} if "output" in raw else None
    if output is not None and "prefix" not in output:
        raise ConfigError("output: prefix is missing")
    if names and not (output and (output.get("report_json") or output.get("report_html"))):
        raise ConfigError("there are reports, but output asks for none")
    return Plan(files, interleaved, options, steps, output, barcodes, general)
