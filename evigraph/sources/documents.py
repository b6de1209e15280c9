"""Configuration documents, read strictly: order kept, duplicate keys and non-finite numbers refused."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence


class DocumentError(ValueError):
    """The document cannot be read as what it claims to be; nothing is guessed from it."""


def _object(pairs: Sequence[tuple[str, object]]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise DocumentError(f"duplicate key {key!r}")
        out[key] = value
    return out


def _refuse(text: str) -> float:
    raise DocumentError(f"{text} is not a finite number")


def parse_json(data: bytes) -> object:
    try:
        return json.loads(data.decode("utf-8-sig"), object_pairs_hook=_object, parse_constant=_refuse)
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise DocumentError(str(e)) from e


_JSONC = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
_TRAILING = re.compile(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', re.S)


def parse_jsonc(data: bytes) -> object:
    """JSON with comments and trailing commas."""
    text = _JSONC.sub(lambda m: m[0] if m[0].startswith('"') else " ", data.decode("utf-8-sig", errors="strict"))
    return parse_json(_TRAILING.sub(lambda m: m[1] or m[2], text).encode())


def parse_yaml(data: bytes) -> object:
    """A YAML subset: one document of block and flow collections with unique string keys; no anchors, aliases or tags."""
    import yaml

    stack: list = [[]]
    kinds: list[str] = ["top"]

    def put(value: object, plain: bool = False) -> None:
        if kinds[-1] == "key":
            if not isinstance(value, str):
                raise DocumentError("a key must be a string")
            if value in stack[-1]:
                raise DocumentError(f"duplicate key {value!r}")
            stack.append(value)
            kinds.append("value")
        elif kinds[-1] == "value":
            kinds.pop()
            key = stack.pop()
            stack[-1][key] = value
        else:
            stack[-1].append(value)

    documents = 0
    try:
        for event in yaml.parse(data.decode("utf-8-sig"), Loader=yaml.SafeLoader):
            name = type(event).__name__
            if name == "DocumentStartEvent":
                documents += 1
                if documents > 1:
                    raise DocumentError("more than one document")
            elif name == "AliasEvent" or getattr(event, "anchor", None):
                raise DocumentError("anchors and aliases are not read")
            elif getattr(event, "tag", None):
                raise DocumentError("tags are not read")
            elif name == "ScalarEvent":
                put(event.value)
            elif name in ("MappingStartEvent", "SequenceStartEvent"):
                if kinds[-1] == "key":
                    raise DocumentError("a key must be a string")
                stack.append({} if name[0] == "M" else [])
                kinds.append("key" if name[0] == "M" else "item")
            elif name in ("MappingEndEvent", "SequenceEndEvent"):
                kinds.pop()
                put(stack.pop())
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise DocumentError(str(e)) from e
    return stack[0][0] if stack[0] else None


def parse(path: str, data: bytes) -> object:
    """By file name: package manifests are strict, tsconfig files may have comments, workspace lists are YAML."""
    name = path.rpartition("/")[2]
    if name.endswith((".yaml", ".yml")):
        return parse_yaml(data)
    return parse_jsonc(data) if name.startswith(("tsconfig", "jsconfig")) else parse_json(data)
