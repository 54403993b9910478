"""Rewrites of stages that Catalyst cannot see: nested results that the next stage takes apart again become joins."""

from __future__ import annotations

from typing import Any

Stages = list[tuple[str, Any]]


def rewritten(stages: Stages) -> Stages:
    out: Stages = []
    i = 0
    while i < len(stages):
        name, spec = stages[i]
        after = stages[i + 1] if i + 1 < len(stages) else (None, None)
        if name == "$match" and out and out[-1][0] == "$match":
            out[-1] = ("$match", {"$and": [_bare(out[-1][1]), _bare(spec)]})
        elif name == "$lookup" and _plain(spec) and after[0] == "$unwind" and _unwinds(after[1], spec["as"]):
            preserve = isinstance(after[1], dict) and after[1].get("preserveNullAndEmptyArrays") is True
            out.append(("$lookup", {**spec, "__join": "left" if preserve else "inner"}))
            i += 1
        elif name == "$lookup" and _plain(spec) and after[0] == "$match" and (kind := _emptiness(after[1], spec["as"])):
            # the array stays, as the field is still there: empty for anti, filled for some
            out.append(("$lookup", {**spec, "__join": kind}))
            i += 1
        elif name == "$lookup" and _plain(spec) and (read := _read_later(stages[i + 1 :], spec["as"])) is not None:
            out.append(("$lookup", {**spec, "__fields": sorted(read)}))
        else:
            out.append((name, spec))
        i += 1
    return out


def _read_later(stages: Stages, field: str) -> set[str] | None:
    """The fields of an array of documents that filters read up to the projection or group that ends it; None if more of it may be read."""
    read: set[str] = set()
    if field == "_id":
        return None
    for name, spec in stages:
        if name == "$match":
            used = _filtered(spec, field)
        elif name == "$group" or name == "$project" and _included(spec) and not any(k.startswith(f"{field}.") or k == field and not _computed(v) for k, v in spec.items()):
            used = _used(spec, field)
            return None if used is None else read | used
        else:
            return None
        if used is None:
            return None
        read |= used
    return None


def _computed(v: Any) -> bool:
    """Whether a projection gives a field a new value."""
    return isinstance(v, str) or isinstance(v, dict) and len(v) == 1 and next(iter(v)).startswith("$")


def _included(spec: Any) -> bool:
    """Whether a projection names what stays."""
    return isinstance(spec, dict) and any(k != "_id" and (v is not False and v != 0) for k, v in spec.items()) and not any(k != "_id" and (v is False or v == 0) for k, v in spec.items())


def _filtered(spec: Any, field: str) -> set[str] | None:
    """What a filter reads of the array: fields on paths and in elements; None where it sees whole documents."""
    if not isinstance(spec, dict):
        return None
    read: set[str] = set()
    for key, test in spec.items():
        if key in ("$and", "$or", "$nor") and isinstance(test, list):
            parts = [_filtered(s, field) for s in test]
        elif key.startswith("$"):
            parts = [_used(test, field)]
        elif key.startswith(field + "."):
            parts = [{key.split(".")[1]}]
        elif key != field:
            parts = [set()]
        elif isinstance(test, dict) and set(test) == {"$elemMatch"} and isinstance(test["$elemMatch"], dict) and not any(k.startswith("$") for k in test["$elemMatch"]):
            parts = [{k.split(".")[0] for k in test["$elemMatch"]}]
        else:
            return None
        if None in parts:
            return None
        read = read.union(*parts)
    return read


def _used(e: Any, field: str) -> set[str] | None:
    """What an expression reads of the array: fields on paths, nothing for its size; None where it sees whole documents."""
    if isinstance(e, str):
        if e.startswith("$$") or e in (field, f"${field}"):
            return None
        return {e.split(".")[1]} if e.startswith(f"${field}.") else set()
    if isinstance(e, dict):
        if e == {"$size": f"${field}"}:
            return set()
        parts = [_used(v, field) for v in e.values()]
    elif isinstance(e, list):
        parts = [_used(v, field) for v in e]
    else:
        return set()
    return None if None in parts else set().union(*parts)


def _bare(spec: Any) -> Any:
    """A filter without its comment, which only the top level may hold."""
    return {k: v for k, v in spec.items() if k != "$comment"} if isinstance(spec, dict) else spec


def _plain(spec: Any) -> bool:
    return isinstance(spec, dict) and set(spec) == {"from", "localField", "foreignField", "as"} and isinstance(spec["as"], str) and "." not in spec["as"]


def _unwinds(spec: Any, field: str) -> bool:
    return spec == f"${field}" or isinstance(spec, dict) and spec.get("path") == f"${field}" and set(spec) <= {"path", "preserveNullAndEmptyArrays"}


def _emptiness(spec: Any, field: str) -> str | None:
    if spec in ({field: {"$size": 0}}, {field: {"$eq": []}}, {field: []}):
        return "anti"
    if spec == {field: {"$ne": []}}:
        return "some"
    return None
