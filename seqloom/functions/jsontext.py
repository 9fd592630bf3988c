"""JSON documents held as text: values set and objects merged at a path, and equality by content.

All of it is variant expressions, so documents of any shape need no schema. Results are texts in one
spelling: no blanks, keys in order, numbers without trailing zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_OBJECT = "map<string,variant>"


def _empty() -> Column:
    return F.create_map().cast(_OBJECT)


def _members(v: Column, what: str) -> Column:
    """An object's members; none of null and JSON's null; anything else fails the job."""
    m = v.try_cast(_OBJECT)
    return F.when(m.isNotNull(), m).when(v.isNull() | F.is_variant_null(v), _empty()).otherwise(F.raise_error(F.lit(what)).cast(_OBJECT))


def _with(m: Column, key: Column, new: Column) -> Column:
    return F.to_variant_object(F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, new)))


def _at(v: Column, path: Sequence[str | Column], change: Callable[[Column], Column], needed: int) -> Column:
    """``v`` with ``change`` made to what is at ``path``; where one of the first ``needed`` members is missing, all stays as it is."""
    if not path:
        return change(v)
    key = F.lit(path[0]) if isinstance(path[0], str) else path[0]
    m = _members(v, "a path leads through a value that isn't an object")
    child = F.try_element_at(m, key)
    put = _with(m, key, _at(child, path[1:], change, needed - 1))
    return F.when(child.isNull(), v).otherwise(put) if needed > 0 else put


def parsed(text: Column) -> Column:
    """A variant; null of null. What isn't JSON fails the job."""
    return F.parse_json(text)


def json_set(doc: Column, path: Sequence[str | Column], value: Column, create: bool = True, parents: bool = False) -> Column:
    """``doc`` with the JSON ``value`` at ``path`` (names or columns of names; at least one).

    A null ``doc`` counts as an empty object. Without ``create`` only a member that is there is
    replaced; where a parent is missing the document stays, unless ``parents`` are to be made. A path through a
    number, text or array fails the job. A null ``value`` or name gives null.
    """
    if not path:
        raise ValueError("a path needs a name")
    new = parsed(value)
    last = F.lit(path[-1]) if isinstance(path[-1], str) else path[-1]

    def change(v: Column) -> Column:
        m = _members(v, "a path leads through a value that isn't an object")
        put = _with(m, last, new)
        return put if create else F.when(F.map_contains_key(m, last), put).otherwise(F.coalesce(v, F.to_variant_object(_empty())))

    root = F.coalesce(parsed(doc), F.to_variant_object(_empty()))
    return F.when(value.isNotNull() & _named(path), F.to_json(_at(root, path[:-1], change, 0 if parents else len(path) - 1)))


def json_merged(doc: Column, patch: Column, path: Sequence[str | Column] = (), parents: bool = True) -> Column:
    """``doc`` with the members of the object ``patch`` put into the object at ``path``; members of ``patch`` win, whole, null ones too.

    Null documents, missing objects and JSON's null count as empty objects, a null ``patch`` as one
    without members. Without ``parents`` a missing one but the last leaves the document as it is.
    Other values at the path, or as a patch, fail the job. A null name gives null.
    """

    def change(v: Column) -> Column:
        old, new = _members(v, "what is merged into isn't an object"), _members(parsed(patch), "a patch isn't an object")
        return F.to_variant_object(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new))

    root = F.coalesce(parsed(doc), F.to_variant_object(_empty()))
    return F.when(_named(path), F.to_json(_at(root, path, change, 0 if parents else len(path) - 1)))


def _named(path: Sequence[str | Column]) -> Column:
    out = F.lit(True)
    for p in path:
        if not isinstance(p, str):
            out = out & p.isNotNull()
    return out


def same_json(a: Column, b: Column) -> Column:
    """Whether two documents have the same content: the order of members, blanks and zeros after the point don't count. Null if either is null.

    Numbers with an exponent are doubles and differ from the same number without one.
    """
    return F.to_json(parsed(a)) == F.to_json(parsed(b))
