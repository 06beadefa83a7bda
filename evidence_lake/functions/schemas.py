"""JSON schemas of answers in the strict form that structured output takes."""

from __future__ import annotations

import re

#: Keywords that strict output rejects (fixed values).
LOOSE = frozenset(
    "default exclusiveMaximum exclusiveMinimum format maximum maxItems maxLength maxProperties minimum minItems minLength minProperties multipleOf pattern title uniqueItems".split()
)


def is_map(node) -> bool:
    """Whether the schema, or a choice in it, is an object of any keys."""
    if not isinstance(node, dict):
        return False
    keyed = node.get("type") == "object" and isinstance(node.get("additionalProperties"), dict) and "properties" not in node
    choices = node.get("anyOf")
    return keyed or any(map(is_map, choices if isinstance(choices, list) else ()))


def strict(node):
    """The schema with closed objects whose fields are all required, without maps of any keys and without LOOSE keywords; the input stays as it is."""
    if isinstance(node, list):
        return [strict(x) for x in node]
    if not isinstance(node, dict):
        return node
    closed = {k: strict(v) for k, v in node.items() if k not in LOOSE and k != "properties"}
    if "properties" in node or node.get("type") == "object":
        fields = {name: strict(v) for name, v in (node.get("properties") or {}).items() if not is_map(v)}
        closed.update(properties=fields, additionalProperties=False, required=[*fields])
    return closed


def schema_name(schema: dict, default: str = "response") -> str:
    """The schema's title as a name of up to 64 letters, digits, '_' and '-'."""
    return re.sub(r"[^\w-]", "_", str(schema.get("title") or default), flags=re.ASCII)[:64]
